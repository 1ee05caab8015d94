"""Independent DuckDB oracle for every registered query.

Each statement runs against the driver's pre-registered test tables
(``nation``, ``part``, ``supplier``, ``customer``, ``orders``,
``lineitem``).  The stand-in ERP views are rebuilt here in SQL, apart
from the Spark code in ``ledgerlens.sources.testviews``, and each
analytic is written step by step the way the original audit recipe
does it (inner merge + distinct, all-column anti merge, two
group-bys + outer join, ...), so the oracle checks the single-pass
Spark rewrites instead of restating them.
"""

from __future__ import annotations

AS_OF = "DATE '1998-07-01'"

# Column order of the enriched invoice file (O1).
INVOICE_COLUMNS = [
    "Company_Code",
    "Account_Number_of_Vendor_or_Creditor",
    "Accounting_Document_Number",
    "Number_of_Line_Item_Within_Accounting_Document",
    "Document_Type",
    "Document_Date_in_Document",
    "Reference_Document_Number",
    "Debit_Credit_Indicator",
    "Amount_in_Local_Currency",
    "Amount_in_Document_Currency",
    "Document_Currency_Key",
    "Vendor_Name",
    "Name_of_Company_Code_or_Company",
    "Local_Currency_Key",
]

# Column order of the Task 1 report.
TASK1_COLUMNS = [
    "Company_Code",
    "Name_of_Company_Code_or_Company",
    "Account_Number_of_Vendor_or_Creditor",
    "Amount_in_Local_Currency",
    "Local_Currency_Key",
    "Amount_in_Document_Currency",
    "Document_Currency_Key",
    "Accounting_Document_Number",
    "Document_Date_in_Document",
    "Document_Type",
    "Reference_Document_Number",
]

V = "Account_Number_of_Vendor_or_Creditor"
DOC = "Accounting_Document_Number"
LINE = "Number_of_Line_Item_Within_Accounting_Document"
REF = "Reference_Document_Number"
DDATE = "Document_Date_in_Document"
AMT_LOC = "Amount_in_Local_Currency"
AMT_DOC = "Amount_in_Document_Currency"
CUST = "Customer_Number"


def _cols(alias: str, cols: list[str]) -> str:
    return ", ".join(f"{alias}.{c}" for c in cols)


def _nullsafe_eq(a: str, b: str, cols: list[str]) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)


# --------------------------------------------------------------------------
# Stand-in views (FIXTURES.md part B)
# --------------------------------------------------------------------------

T001 = """t001 AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS Company_Code,
         n_name AS Name_of_Company_Code_or_Company,
         'CUR' || CAST(n_regionkey AS VARCHAR) AS Local_Currency_Key
  FROM nation)"""


def _bsak(name: str, vendor: str, ref: str, where: str) -> str:
    return f"""{name} AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS Company_Code,
         CAST({vendor} AS VARCHAR) AS {V},
         CAST(l_orderkey AS VARCHAR) AS {DOC},
         l_linenumber AS {LINE},
         CASE WHEN l_returnflag = 'R' THEN 'ZP' ELSE l_returnflag END AS Document_Type,
         CAST(o_orderdate AS DATE) AS {DDATE},
         CAST({ref} AS VARCHAR) AS {REF},
         CASE WHEN l_returnflag = 'A' THEN 'S' ELSE 'H' END AS Debit_Credit_Indicator,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS {AMT_LOC},
         CAST(l_quantity AS DECIMAL(18,2)) AS {AMT_DOC},
         'CUR' || SUBSTR(o_orderpriority, 1, 1) AS Document_Currency_Key
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  WHERE {where})"""


_PART_YEAR = "CAST(l_partkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR)"
_CUSTOMER_MONTH = "CAST(o_custkey AS VARCHAR) || '-' || strftime(o_orderdate, '%Y%m')"

_VARIANTS = {
    # vendor = part in an order year, ref = supplier, open lines
    "part": dict(
        vendor=_PART_YEAR,
        ref="l_suppkey",
        where="l_linestatus = 'O'",
        lfa1="SELECT CAST(p_partkey AS VARCHAR) || '-' || CAST(y AS VARCHAR) AS {V}, p_name AS Vendor_Name "
        "FROM part, range(1992, 2006) AS years(y)",
    ),
    # vendor = supplier, ref = part, open lines
    "supp": dict(
        vendor="l_suppkey",
        ref="l_partkey",
        where="l_linestatus = 'O'",
        lfa1="SELECT CAST(s_suppkey AS VARCHAR) AS {V}, s_name AS Vendor_Name FROM supplier",
    ),
    # vendor = customer in an order month, ref = supplier, all lines
    "cust": dict(
        vendor=_CUSTOMER_MONTH,
        ref="l_suppkey",
        where="true",
        lfa1=f"SELECT DISTINCT {_CUSTOMER_MONTH} AS {{V}}, c_name AS Vendor_Name "
        "FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
}


def ap_views(variant: str) -> str:
    """CTEs: t001, bsak, lfa1, invoice_file, eligible, ekbe."""
    v = _VARIANTS[variant]
    lfa1 = v["lfa1"].format(V=V)
    return f"""WITH {T001},
{_bsak('bsak', v['vendor'], v['ref'], v['where'])},
lfa1 AS ({lfa1}),
invoice_file AS (
  SELECT b.*, l.Vendor_Name, t.Name_of_Company_Code_or_Company, t.Local_Currency_Key
  FROM bsak b
  LEFT JOIN lfa1 l ON b.{V} IS NOT DISTINCT FROM l.{V}
  LEFT JOIN t001 t ON b.Company_Code IS NOT DISTINCT FROM t.Company_Code),
eligible AS (
  SELECT * FROM invoice_file
  WHERE Document_Type IS DISTINCT FROM 'ZP' AND Document_Type IS DISTINCT FROM 'KZ'),
ekbe AS (
  SELECT CAST({v['vendor']} AS VARCHAR) AS Vendor_Account_Number,
         CAST({v['ref']} AS VARCHAR) AS {REF}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'),
po_paid AS (
  SELECT DISTINCT {_cols('e', INVOICE_COLUMNS)}
  FROM eligible e JOIN ekbe p
    ON e.{V} IS NOT DISTINCT FROM p.Vendor_Account_Number
   AND e.{REF} IS NOT DISTINCT FROM p.{REF}),
sundry AS (
  SELECT e.* FROM eligible e
  WHERE NOT EXISTS (SELECT 1 FROM po_paid p WHERE {_nullsafe_eq('p', 'e', INVOICE_COLUMNS)}))"""


# --------------------------------------------------------------------------
# Accounts payable
# --------------------------------------------------------------------------


def _q_invoice_file() -> str:
    return ap_views("part") + "\nSELECT * FROM invoice_file"


def _q_eligible() -> str:
    return ap_views("part") + "\nSELECT * FROM eligible"


def _q_po_paid() -> str:
    return ap_views("part") + "\nSELECT * FROM po_paid"


def _q_sundry() -> str:
    return ap_views("part") + "\nSELECT * FROM sundry"


def _both_ways_frames() -> str:
    # Task 1 recipe: vendors of PO-paid rows, their rows, the sundry part of
    # those rows, then every row of vendors that also have sundry rows.
    return f""",
avi AS (
  SELECT e.* FROM eligible e
  WHERE EXISTS (SELECT 1 FROM po_paid p WHERE p.{V} IS NOT DISTINCT FROM e.{V})),
notin AS (
  SELECT a.* FROM avi a
  WHERE NOT EXISTS (SELECT 1 FROM po_paid p WHERE {_nullsafe_eq('p', 'a', INVOICE_COLUMNS)})),
both_ways AS (
  SELECT a.* FROM avi a
  WHERE EXISTS (SELECT 1 FROM notin n WHERE n.{V} IS NOT DISTINCT FROM a.{V}))"""


def _q_vendors_paid_both_ways() -> str:
    return (
        ap_views("part")
        + _both_ways_frames()
        + f"\nSELECT {', '.join(TASK1_COLUMNS)} FROM both_ways"
    )


def _q_invoice_payment_mix() -> str:
    cols = ", ".join(INVOICE_COLUMNS)
    return (
        ap_views("part")
        + _both_ways_frames()
        + f""",
only_sundry AS (
  SELECT e.* FROM eligible e
  WHERE NOT EXISTS (SELECT 1 FROM avi a WHERE {_nullsafe_eq('a', 'e', INVOICE_COLUMNS)})),
both_po AS (
  SELECT p.* FROM po_paid p
  WHERE EXISTS (SELECT 1 FROM notin n WHERE n.{V} IS NOT DISTINCT FROM p.{V})),
only_po AS (
  SELECT p.* FROM po_paid p
  WHERE NOT EXISTS (SELECT 1 FROM notin n WHERE n.{V} IS NOT DISTINCT FROM p.{V}))
SELECT {cols}, 'both_sundry' AS type FROM notin
UNION ALL SELECT {cols}, 'only_sundry' AS type FROM only_sundry
UNION ALL SELECT {cols}, 'both_po' AS type FROM both_po
UNION ALL SELECT {cols}, 'only_po' AS type FROM only_po"""
    )


def _q_invoice_frequency() -> str:
    return (
        ap_views("part")
        + f"""
SELECT {V}, COUNT(DISTINCT {DOC}) AS Invoice_Frequency
FROM eligible WHERE {V} IS NOT NULL GROUP BY {V}"""
    )


def _doc_totals() -> str:
    return f""",
doc_totals AS (
  SELECT {V}, {DOC}, {DDATE},
         CAST(COALESCE(SUM({AMT_LOC}), 0) AS DECIMAL(28,2)) AS {AMT_LOC},
         CAST(COALESCE(SUM({AMT_DOC}), 0) AS DECIMAL(28,2)) AS {AMT_DOC}
  FROM sundry
  WHERE {V} IS NOT NULL AND {DOC} IS NOT NULL AND {DDATE} IS NOT NULL
  GROUP BY {V}, {DOC}, {DDATE}),
recur_amount AS (
  SELECT t.* FROM doc_totals t
  WHERE (SELECT COUNT(*) FROM doc_totals u
         WHERE u.{V} IS NOT DISTINCT FROM t.{V} AND u.{AMT_DOC} IS NOT DISTINCT FROM t.{AMT_DOC}) > 1)"""


def _q_sundry_document_totals() -> str:
    return ap_views("supp") + _doc_totals() + "\nSELECT * FROM doc_totals"


def _q_recurring_sundry() -> str:
    return (
        ap_views("supp")
        + _doc_totals()
        + f""",
attrs AS (
  SELECT Company_Code, Name_of_Company_Code_or_Company, {V}, {DOC}, Document_Type, {REF},
         Document_Currency_Key, Local_Currency_Key
  FROM sundry)
SELECT DISTINCT a.Company_Code, a.Name_of_Company_Code_or_Company, r.{V}, r.{AMT_LOC},
       a.Local_Currency_Key, r.{AMT_DOC}, a.Document_Currency_Key, r.{DOC}, r.{DDATE},
       a.Document_Type, a.{REF}
FROM recur_amount r
LEFT JOIN attrs a ON r.{V} IS NOT DISTINCT FROM a.{V} AND r.{DOC} IS NOT DISTINCT FROM a.{DOC}"""
    )


def _weeks_and_runs() -> str:
    # Documents of one (vendor, amount) in (document, date) order, the way the
    # grouped frame leaves them; a run continues while week = previous + 1.
    return f""",
seq AS (
  SELECT r.*, {DDATE} AS date,
         CAST(month({DDATE}) AS INTEGER) AS month,
         CAST(strftime({DDATE}, '%W') AS INTEGER) AS week,
         ROW_NUMBER() OVER (PARTITION BY {V}, {AMT_DOC}
                            ORDER BY TRY_CAST({DOC} AS BIGINT) NULLS FIRST, {DOC}, {DDATE})
           AS position
  FROM recur_amount r),
brk AS (
  SELECT s.*,
         CASE WHEN LAG(week) OVER w IS NOT NULL AND LAG(week) OVER w = week - 1
              THEN 0 ELSE 1 END AS is_start
  FROM seq s
  WINDOW w AS (PARTITION BY {V}, {AMT_DOC} ORDER BY position)),
runs_tagged AS (
  SELECT b.*, SUM(is_start) OVER (PARTITION BY {V}, {AMT_DOC} ORDER BY position
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_index
  FROM brk b),
runs AS (
  SELECT {V}, {AMT_DOC}, CAST(run_index AS BIGINT) AS run_index,
         CAST(COUNT(*) AS INTEGER) AS run_length,
         CAST(MIN(position) AS INTEGER) AS first_position,
         arg_min(week, position) AS first_week
  FROM runs_tagged GROUP BY {V}, {AMT_DOC}, run_index)"""


def _q_consecutive_run_lengths() -> str:
    return (
        ap_views("supp")
        + _doc_totals()
        + _weeks_and_runs()
        + f"\nSELECT {V}, {AMT_DOC}, run_index, run_length, first_week FROM runs"
    )


def _q_recurrence_profile() -> str:
    return (
        ap_views("supp")
        + _doc_totals()
        + _weeks_and_runs()
        + f""",
grp AS (
  SELECT {V}, {AMT_DOC}, COUNT(*) AS times, COUNT(DISTINCT month) AS month_count
  FROM seq GROUP BY {V}, {AMT_DOC}),
runmax AS (
  SELECT {V}, {AMT_DOC}, MAX(run_length) AS max_consecutive_weeks,
         COUNT(*) AS run_count
  FROM runs GROUP BY {V}, {AMT_DOC})
SELECT s.{V}, s.{DOC}, s.{DDATE}, s.{AMT_LOC}, s.{AMT_DOC}, s.date, s.month, s.week,
       CAST(s.position AS INTEGER) AS position,
       CAST(g.times AS BIGINT) AS times, CAST(g.month_count AS BIGINT) AS month_count,
       CAST(m.run_count AS BIGINT) AS run_count,
       CAST(m.max_consecutive_weeks AS INTEGER) AS max_consecutive_weeks
FROM seq s
JOIN grp g ON s.{V} = g.{V} AND s.{AMT_DOC} = g.{AMT_DOC}
JOIN runmax m ON s.{V} = m.{V} AND s.{AMT_DOC} = m.{AMT_DOC}"""
    )


# Column order of the Task 4 report.
_TASK4_COLUMNS = [
    "Company_Code",
    "Name_of_Company_Code_or_Company",
    V,
    "Debit_Credit_Indicator",
    AMT_LOC,
    "Local_Currency_Key",
    AMT_DOC,
    "Document_Currency_Key",
    DOC,
    DDATE,
    REF,
]


def _q_one_time_vendor_invoices() -> str:
    cols = ", ".join(_TASK4_COLUMNS)
    return (
        ap_views("cust")
        + f""",
freq AS (
  SELECT {V}, COUNT(DISTINCT {DOC}) AS Invoice_Frequency, COUNT(DISTINCT {LINE}) AS line_number
  FROM eligible WHERE {V} IS NOT NULL GROUP BY {V}),
z AS (SELECT DISTINCT {cols} FROM eligible)
SELECT {', '.join('z.' + c for c in _TASK4_COLUMNS)}
FROM freq f JOIN z ON f.{V} = z.{V}
WHERE f.Invoice_Frequency = 1 AND f.line_number = 1"""
    )


def _q_single_document_vendor_invoices() -> str:
    cols = [c for c in _TASK4_COLUMNS if c != "Name_of_Company_Code_or_Company"]
    return (
        ap_views("cust")
        + f""",
freq AS (
  SELECT {V}, COUNT(DISTINCT {DOC}) AS Invoice_Frequency
  FROM eligible WHERE {V} IS NOT NULL GROUP BY {V}),
z AS (SELECT DISTINCT {', '.join(cols)} FROM eligible)
SELECT {', '.join('z.' + c for c in cols)}
FROM freq f JOIN z ON f.{V} = z.{V}
WHERE f.Invoice_Frequency = 1"""
    )


# --------------------------------------------------------------------------
# PO file (O3)
# --------------------------------------------------------------------------

PO_NUM = "Purchasing_Document_Number"
PO_ITEM = "Item_Number_of_Purchasing_Document"


def _q_po_file() -> str:
    return _po_file("re.Invoice_Document_Number, h.Material_Document_Number")


def _q_po_reference_pairs() -> str:
    # Vendor and reference of every row of the PO file; missing where a receipt or line has no history.
    return f"""SELECT DISTINCT Vendor_Account_Number, {REF} FROM (
{_po_file(f"h.{PO_ITEM} AS Vendor_Account_Number, h.{PO_NUM} AS {REF}")})"""


def _po_file(columns: str) -> str:
    return f"""WITH rseg AS (
  SELECT CAST(l_partkey AS VARCHAR) AS {PO_NUM}, CAST(l_suppkey AS VARCHAR) AS {PO_ITEM},
         CAST(l_orderkey AS VARCHAR) AS Invoice_Document_Number
  FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'N'),
ekpo AS (
  SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS {PO_NUM}, CAST(l_suppkey AS VARCHAR) AS {PO_ITEM}
  FROM lineitem WHERE l_returnflag = 'N'),
ekbe AS (
  SELECT CAST(l_partkey AS VARCHAR) AS {PO_NUM}, CAST(l_suppkey AS VARCHAR) AS {PO_ITEM},
         CAST(l_orderkey AS VARCHAR) AS Material_Document_Number
  FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'N'),
re AS (
  SELECT COALESCE(r.{PO_NUM}, e.{PO_NUM}) AS {PO_NUM},
         COALESCE(r.{PO_ITEM}, e.{PO_ITEM}) AS {PO_ITEM},
         r.Invoice_Document_Number
  FROM rseg r FULL OUTER JOIN ekpo e
    ON r.{PO_NUM} IS NOT DISTINCT FROM e.{PO_NUM} AND r.{PO_ITEM} IS NOT DISTINCT FROM e.{PO_ITEM})
SELECT COALESCE(re.{PO_NUM}, h.{PO_NUM}) AS {PO_NUM},
       COALESCE(re.{PO_ITEM}, h.{PO_ITEM}) AS {PO_ITEM},
       {columns}
FROM re FULL OUTER JOIN ekbe h
  ON re.{PO_NUM} IS NOT DISTINCT FROM h.{PO_NUM} AND re.{PO_ITEM} IS NOT DISTINCT FROM h.{PO_ITEM}"""


# --------------------------------------------------------------------------
# Accounts receivable
# --------------------------------------------------------------------------

AREA = "Credit_Control_Area"
LIMIT = "Customer_s_credit_limit"

AR_VIEWS = f"""WITH {T001},
bsid AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS Company_Code,
         CAST(o_custkey AS VARCHAR) AS {CUST},
         CAST(o_orderkey AS VARCHAR) AS {REF},
         CASE WHEN l_returnflag = 'R' THEN 'H' ELSE 'S' END AS Debit_Credit_Indicator,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS {AMT_LOC},
         CAST(l_shipdate AS DATE) AS {DDATE},
         'CUR' || SUBSTR(o_orderpriority, 1, 1) AS Document_Currency_Key
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey),
knkk AS (
  SELECT CAST(c_custkey AS VARCHAR) AS {CUST},
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS {AREA},
         CASE WHEN c_acctbal < 0 THEN NULL
              ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) END AS {LIMIT}
  FROM customer
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR) AS {CUST}, 'CAN' AS {AREA},
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 10 AS DECIMAL(18,2)) AS {LIMIT}
  FROM customer WHERE c_custkey % 10 = 0),
listing AS (
  SELECT b.*, k.{AREA}, k.{LIMIT}, t.Name_of_Company_Code_or_Company, t.Local_Currency_Key
  FROM bsid b
  LEFT JOIN knkk k ON b.{CUST} IS NOT DISTINCT FROM k.{CUST}
  LEFT JOIN t001 t ON b.Company_Code IS NOT DISTINCT FROM t.Company_Code),
s_amt AS (
  SELECT {CUST}, {REF}, SUM({AMT_LOC}) AS Amount_S FROM listing
  WHERE Debit_Credit_Indicator = 'S' AND {CUST} IS NOT NULL AND {REF} IS NOT NULL
  GROUP BY {CUST}, {REF}),
h_amt AS (
  SELECT {CUST}, {REF}, SUM({AMT_LOC}) AS Amount_H FROM listing
  WHERE Debit_Credit_Indicator = 'H' AND {CUST} IS NOT NULL AND {REF} IS NOT NULL
  GROUP BY {CUST}, {REF}),
totals AS (
  SELECT COALESCE(s.{CUST}, h.{CUST}) AS {CUST}, COALESCE(s.{REF}, h.{REF}) AS {REF},
         CAST(COALESCE(s.Amount_S, 0) AS DECIMAL(28,2)) AS Amount_S,
         CAST(COALESCE(h.Amount_H, 0) AS DECIMAL(28,2)) AS Amount_H
  FROM s_amt s FULL OUTER JOIN h_amt h ON s.{CUST} = h.{CUST} AND s.{REF} = h.{REF}),
with_dates AS (
  SELECT DISTINCT t.{CUST}, t.{REF}, t.Amount_S, t.Amount_H,
         CAST(t.Amount_S - t.Amount_H AS DECIMAL(28,2)) AS Balance, l.{DDATE}
  FROM totals t LEFT JOIN listing l ON t.{CUST} = l.{CUST} AND t.{REF} = l.{REF}),
min_date AS (
  SELECT {CUST}, {REF}, MIN({DDATE}) AS {DDATE} FROM with_dates GROUP BY {CUST}, {REF}),
balances AS (
  SELECT w.{CUST}, w.{REF}, w.Amount_S, w.Amount_H, w.Balance, w.{DDATE},
         CAST(CASE WHEN w.Balance <= 0 THEN 0
                   WHEN w.Balance > 0 THEN date_diff('day', w.{DDATE}, {AS_OF}) END AS INTEGER)
           AS outstanding_days
  FROM with_dates w JOIN min_date m
    ON w.{CUST} = m.{CUST} AND w.{REF} = m.{REF}
   AND w.{DDATE} IS NOT DISTINCT FROM m.{DDATE}),
aged AS (
  SELECT b.*,
         CASE WHEN outstanding_days >= 60 AND outstanding_days <= 90 THEN '60-90'
              WHEN outstanding_days > 90 AND outstanding_days <= 120 THEN '90-120'
              WHEN outstanding_days > 120 THEN '> 120'
              WHEN outstanding_days < 60 AND outstanding_days > 0 THEN '< 60'
              WHEN outstanding_days = 0 THEN 'not outstanding' END AS type
  FROM balances b)"""


def _q_ar_listing() -> str:
    return AR_VIEWS + "\nSELECT * FROM listing"


def _q_document_balances() -> str:
    return AR_VIEWS + "\nSELECT * FROM aged"


def _q_ar_aging_by_customer() -> str:
    return (
        AR_VIEWS
        + f""",
over60 AS (SELECT * FROM aged WHERE type IN ('60-90', '90-120', '> 120')),
by_cust AS (
  SELECT {CUST},
         CAST(SUM(CASE WHEN type = '60-90' THEN Balance ELSE 0 END) AS DECIMAL(28,2)) AS b1,
         CAST(SUM(CASE WHEN type = '90-120' THEN Balance ELSE 0 END) AS DECIMAL(28,2)) AS b2,
         CAST(SUM(CASE WHEN type = '> 120' THEN Balance ELSE 0 END) AS DECIMAL(28,2)) AS b3,
         CAST(SUM(Balance) AS DECIMAL(28,2)) AS total
  FROM over60 GROUP BY {CUST}),
x AS (
  SELECT DISTINCT {CUST}, Company_Code, Name_of_Company_Code_or_Company, Local_Currency_Key,
         {LIMIT}, {AREA}
  FROM listing)
SELECT c.{CUST}, x.Company_Code, x.Name_of_Company_Code_or_Company,
       c.total AS Total_Amount_Local_Currency, x.Local_Currency_Key, x.{LIMIT},
       c.b1 AS "Local_Amount_60-90_Days", c.b2 AS "Local_Amount_90-120_Days",
       c.b3 AS "Local_Amount_>120_Days"
FROM by_cust c LEFT JOIN x ON c.{CUST} = x.{CUST}
WHERE x.{AREA} IS DISTINCT FROM 'CAN'"""
    )


def _q_credit_limit_status() -> str:
    return (
        AR_VIEWS
        + f"""
SELECT a.*, k.{AREA}, k.{LIMIT},
       CASE WHEN a.Balance > k.{LIMIT} THEN 'above limit'
            WHEN a.Balance <= k.{LIMIT} THEN 'below limit'
            ELSE 'no limit' END AS above_limit
FROM aged a LEFT JOIN knkk k ON a.{CUST} IS NOT DISTINCT FROM k.{CUST}"""
    )


def _po_cells() -> list[str]:
    return [
        "CAST(l_orderkey AS VARCHAR)",
        "CAST(l_linenumber AS VARCHAR)",
        "CAST(l_partkey AS VARCHAR)",
        "CAST(l_suppkey AS VARCHAR)",
        "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)",
        "l_returnflag || l_linestatus",
        "CASE WHEN l_linenumber % 4 = 2 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END",
        "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)",
        "CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR)",
        "CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR)",
    ] + [f"'v' || CAST((l_orderkey * {i} + l_linenumber) % 97 AS VARCHAR)" for i in range(10, 29)]


_LOST = "(l_orderkey % 64 = 5 AND l_linenumber % 4 IN (1, 2))"


def _q_repair_ragged_po_lines() -> str:
    # The damaged lines are derived from every line item; a correct repair
    # gives the original 29 fields back, where a line can be repaired.
    names = [PO_NUM, PO_ITEM] + [f"Field_{i:02d}" for i in range(2, 29)]
    cols = ",\n       ".join(f"{e} AS {n}" for e, n in zip(_po_cells(), names))
    return f"SELECT {cols}\nFROM lineitem WHERE NOT {_LOST}"


def _q_rejected_ragged_po_lines() -> str:
    f = _po_cells()
    one = "concat_ws('|', " + ", ".join(f[:6] + f[7:]) + ")"
    two = "concat_ws('|', " + ", ".join(f[:5] + [f[5] + " || ',x'"] + f[8:]) + ")"
    return f"""
SELECT CASE l_linenumber % 4 WHEN 1 THEN 28 ELSE 27 END AS n_fields,
       CASE l_linenumber % 4 WHEN 1 THEN {one} ELSE {two} END AS cells
FROM lineitem WHERE {_LOST}"""


def _q_recurrence_lists() -> str:
    text = "'[' || string_agg(CAST({} AS VARCHAR), ', ' ORDER BY {}) || ']'"
    return (
        ap_views("supp")
        + _doc_totals()
        + _weeks_and_runs()
        + f"""
SELECT s.{V}, s.{AMT_DOC}, 0 AS part, 1 AS parts, s.times, s.month_count, r.run_count, r.max_consecutive_weeks,
       s.month_lists, s.week_lists, r.week_times
FROM (SELECT {V}, {AMT_DOC}, COUNT(*) AS times, COUNT(DISTINCT month) AS month_count,
             {text.format("month", "position")} AS month_lists, {text.format("week", "position")} AS week_lists
      FROM seq GROUP BY {V}, {AMT_DOC}) s
JOIN (SELECT {V}, {AMT_DOC}, COUNT(*) AS run_count, MAX(run_length) AS max_consecutive_weeks,
             {text.format("run_length", "run_index")} AS week_times
      FROM runs GROUP BY {V}, {AMT_DOC}) r USING ({V}, {AMT_DOC})"""
    )


def _q_list_run_lengths() -> str:
    def runs(c: str) -> str:
        return f"""
{c}_runs AS (
  SELECT {V}, {AMT_DOC}, '[' || string_agg(CAST(n AS VARCHAR), ', ' ORDER BY run) || ']' AS {c}_runs FROM (
    SELECT {V}, {AMT_DOC}, run, COUNT(*) AS n FROM (
      SELECT {V}, {AMT_DOC}, SUM(starts) OVER (PARTITION BY {V}, {AMT_DOC} ORDER BY position) AS run FROM (
        SELECT *, CASE WHEN LAG({c}) OVER (PARTITION BY {V}, {AMT_DOC} ORDER BY position) = {c} - 1 THEN 0 ELSE 1 END AS starts
        FROM seq)) GROUP BY {V}, {AMT_DOC}, run) GROUP BY {V}, {AMT_DOC})"""

    return (
        ap_views("supp")
        + _doc_totals()
        + _weeks_and_runs()
        + f""",{runs("month")},{runs("week")}
SELECT {V}, {AMT_DOC}, 0 AS part, month_runs, week_runs FROM month_runs JOIN week_runs USING ({V}, {AMT_DOC})"""
    )


def _q_approximate_frequency() -> str:
    return (
        ap_views("part")
        + f"""
SELECT {V}, COUNT(DISTINCT {DOC}) AS Invoice_Frequency, true AS within_bound
FROM eligible WHERE {V} IS NOT NULL GROUP BY {V}"""
    )


def _bsak_cells() -> str:
    """The lines of the written extract, with what its damaged cells hold."""
    return f"""WITH {_bsak('bsak', _VARIANTS['part']['vendor'], _VARIANTS['part']['ref'], _VARIANTS['part']['where'])},
cells AS (
  SELECT *, CAST({DOC} AS BIGINT) AS k,
         CASE WHEN {LINE} % 3 = 0 THEN 'first, "quoted"' || chr(10) || 'second ' ELSE 'item ' END || CAST({LINE} AS VARCHAR) AS Item_Text
  FROM bsak)"""


def _q_csv_invoice_lines() -> str:
    return (
        _bsak_cells()
        + f"""
SELECT Company_Code, {V}, {DOC}, {LINE}, Document_Type, {REF}, Debit_Credit_Indicator, {AMT_DOC}, Document_Currency_Key, Item_Text,
       CASE WHEN k % 101 <> 0 THEN {DDATE} END AS {DDATE},
       CAST(CASE WHEN k % 103 = 0 THEN NULL WHEN k % 107 = 0 THEN {AMT_LOC} + 0.01 WHEN k % 3 = 2 THEN -{AMT_LOC}
            ELSE {AMT_LOC} END AS DECIMAL(18,2)) AS {AMT_LOC}
FROM cells"""
    )


def _q_csv_rejects() -> str:
    return (
        _bsak_cells()
        + f"""
SELECT 'bsak' AS file, 'cell' AS kind, '{DDATE}' AS "column", 'soon' AS "value" FROM cells WHERE k % 101 = 0
UNION ALL SELECT 'bsak', 'cell', '{AMT_LOC}', 'n/a' FROM cells WHERE k % 103 = 0
UNION ALL SELECT 'bsak', 'rounded', '{AMT_LOC}', CAST({AMT_LOC} AS VARCHAR) || '5' FROM cells WHERE k % 103 <> 0 AND k % 107 = 0"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "invoice_file": _q_invoice_file(),
        "repair_ragged_po_lines": _q_repair_ragged_po_lines(),
        "po_file": _q_po_file(),
        "po_reference_pairs": _q_po_reference_pairs(),
        "eligible_invoices": _q_eligible(),
        "po_paid_invoices": _q_po_paid(),
        "sundry_invoices": _q_sundry(),
        "vendors_paid_both_ways": _q_vendors_paid_both_ways(),
        "invoice_payment_mix": _q_invoice_payment_mix(),
        "invoice_frequency": _q_invoice_frequency(),
        "sundry_document_totals": _q_sundry_document_totals(),
        "recurring_sundry": _q_recurring_sundry(),
        "consecutive_run_lengths": _q_consecutive_run_lengths(),
        "recurrence_profile": _q_recurrence_profile(),
        "recurrence_lists": _q_recurrence_lists(),
        "list_run_lengths": _q_list_run_lengths(),
        "approximate_frequency": _q_approximate_frequency(),
        "csv_invoice_lines": _q_csv_invoice_lines(),
        "csv_rejects": _q_csv_rejects(),
        "rejected_ragged_po_lines": _q_rejected_ragged_po_lines(),
        "one_time_vendor_invoices": _q_one_time_vendor_invoices(),
        "single_document_vendor_invoices": _q_single_document_vendor_invoices(),
        "ar_listing": _q_ar_listing(),
        "document_balances": _q_document_balances(),
        "ar_aging_by_customer": _q_ar_aging_by_customer(),
        "credit_limit_status": _q_credit_limit_status(),
    }
