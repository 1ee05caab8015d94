"""Join helpers: null-safe equi-joins and a splittable full outer join.

Null-safe equality (``<=>``) is still an equi-join for Catalyst: it plans a
hash / sort-merge join on ``coalesce(key) + isnull(key)``, never a nested
loop.  A hot key (including the null key) ends up in one shuffle partition;
AQE's skew-join rule splits that partition, which it can do for inner,
left-outer, left-semi and left-anti joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def nullsafe_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    right_keys: list[str] | None = None,
) -> DataFrame:
    """Equi-join where a null key matches a null key.

    The right key columns are renamed before the join and dropped after it,
    so the output has one copy of each key (the left one; for matched rows
    both are equal).
    """
    right_keys = right_keys or keys
    tmp = {rk: f"__rk{i}_{rk}" for i, rk in enumerate(right_keys)}
    r = right.withColumnsRenamed(tmp)
    cond = reduce(
        lambda a, b: a & b,
        [F.col(lk).eqNullSafe(F.col(tmp[rk])) for lk, rk in zip(keys, right_keys)],
    )
    out = left.join(r, on=cond, how=how)
    if how not in ("left_semi", "leftsemi", "semi", "left_anti", "leftanti", "anti"):
        out = out.drop(*tmp.values())
    return out


def full_outer_nullsafe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on null-safe keys with the keys merged into one column.

    Written as a left outer join and a right anti join, whose hot keys
    (the null key among them) AQE can split over many tasks; it cannot
    for a full outer join.  A key with m rows on one side and n on the other
    yields m x n rows by definition.
    """
    left_rest = [c for c in left.columns if c not in keys]
    right_rest = [c for c in right.columns if c not in keys]
    clash = set(left_rest) & set(right_rest)
    if clash:
        raise ValueError(f"non-key columns on both sides: {sorted(clash)}")
    matched = nullsafe_join(left, right, keys, "left").select(*keys, *left_rest, *right_rest)
    unmatched = nullsafe_join(right, left.select(*keys), keys, "left_anti")
    types = {f.name: f.dataType for f in left.schema.fields}
    return matched.unionByName(
        unmatched.select(*keys, *[F.lit(None).cast(types[c]).alias(c) for c in left_rest], *right_rest)
    )
