"""Licence scans by recognising sentences and matching their order against rules.

A text is cut into units at line ends and behind sentence marks.  A sentence is
a row of units, since notices are wrapped and a mark can stand inside a
sentence ("v. 2.0"); it begins and ends with units.  Sentences are normalised to lower-case words, and those
that are known get an identifier.  The sequence of a document's identifiers is
then matched against the licence rules in their order: at each place the first
rule whose sequence of identifiers stands there wins, and matching goes on
behind it.  Known sentences that no rule uses there are reported as such.

Every known sentence holds one of a few cues inside a single word, which no
line end or spacing breaks; texts without any are not cut up, which changes no
result.

Scale: one narrow pass over whole texts, without a shuffle.  A sentence is tried
up to the length of the longest known one.

Defined results: a null text counts as empty and has no sentences; repeated
rows are scanned each; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import parts, pick

# Licence sentences, as their licences and usual notices word them.
SENTENCES = {
    "all_rights": "All rights reserved.",
    "mit_named": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_spdx": "SPDX-License-Identifier: MIT",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache_named": "Licensed under the Apache License, Version 2.0.",
    "apache_header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache_use": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_as_is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache_spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl3_named": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_free": "This program is free software;",
    "gpl2_redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2_version": "either version 2 of the License, or (at your option) any later version.",
    "gpl_no_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl_header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc_by_nc_named": "Licensed under CC BY-NC 4.0.",
    "cc_by_named": "Licensed under CC BY 4.0.",
    "cc_by_sa_named": "Licensed under CC BY-SA 4.0.",
    "cc_by_work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0_named": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "public_domain": "This is free and unencumbered software released into the public domain.",
}

# Licence rules in their order, each a sequence of sentence identifiers.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_header", "apache_use", "apache_copy", "apache_as_is")),
    ("Apache-2.0", ("apache_header", "apache_use")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl2_redistribute", "gpl2_version")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_no_warranty")),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_named",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_spdx",)),
    ("ISC", ("isc_grant",)),
    ("Apache-2.0", ("apache_named",)),
    ("Apache-2.0", ("apache_spdx",)),
    ("GPL-3.0", ("gpl3_named",)),
    ("MPL-2.0", ("mpl_header",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_named",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_named",)),
    ("CC-BY-4.0", ("cc_by_named",)),
    ("CC-BY-4.0", ("cc_by_work",)),
    ("CC0-1.0", ("cc0_named",)),
    ("Unlicense", ("public_domain",)),
    ("all-rights-reserved", ("all_rights",)),
)

# Each known sentence has a word that holds one of these.
CUES = ("licen", "reserved", "copyright", "warrant", "permission", "redistribut", "liable", "software")

_WORD = re.compile("[a-z0-9]+(?:[.+-][a-z0-9]+)*")
_UNIT = re.compile(r"[^\n]*?(?:[.!?;](?=[\s\"')\]]|$)|\n|$)")


def _lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


class Recogniser:
    """Finds the known sentences of a text and matches their sequence against the rules."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES, cues: tuple[str, ...] = CUES) -> None:
        self.known: dict[tuple[str, ...], str] = {}
        for name, sentence in sentences.items():
            units = [s for s in _UNIT.findall(_lower(sentence) + "\n") if _WORD.search(s)]
            words = tuple(w for u in units for w in _WORD.findall(u))
            if not any(c in w for c in cues for w in words):
                raise ValueError(f"sentence {name} has no word with a cue")
            self.known[words] = name
        self.longest = max(map(len, self.known))
        self.beginnings = {w[:k] for w in self.known for k in range(len(w) + 1)}
        self.cues, self.rules = cues, rules

    def units(self, text: str) -> list[tuple[int, int, tuple[str, ...]]]:
        """(start, end, words) of each unit with words."""
        out = []
        for m in _UNIT.finditer(_lower(text)):
            found = list(_WORD.finditer(m[0]))
            if found:
                words = tuple(w[0] for w in found)
                out.append((m.start() + found[0].start(), m.start() + found[-1].end(), words))
        return out

    def sentences(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, identifier) of the known sentences, in order; the longest one at a place."""
        lower = _lower(text)
        if not any(c in lower for c in self.cues):
            return []
        units, out, i = self.units(text), [], 0
        while i < len(units):
            words, best = (), None
            for j in range(i, len(units)):
                words += units[j][2]
                if words not in self.beginnings:
                    break
                if words in self.known:
                    best = j, self.known[words]
            if best:
                out.append((units[i][0], units[best[0]][1], best[1]))
                i = best[0]
            i += 1
        return out

    def licenses(self, sentences: list[tuple[int, int, str]]) -> tuple[list[tuple[str, int, int]], list[str]]:
        """(licence, start, end) in order, and the identifiers that no rule took."""
        names = tuple(s[2] for s in sentences)
        found, loose, at = [], [], 0
        while at < len(names):
            for name, sequence in self.rules:
                if names[at : at + len(sequence)] == sequence:
                    found.append((name, sentences[at][0], sentences[at + len(sequence) - 1][1]))
                    at += len(sequence)
                    break
            else:
                loose.append(names[at])
                at += 1
        return found, loose


def scan_licenses(docs: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """doc_id, n_sentences (known ones), licenses (distinct, sorted), spans (``licence:start:end``) and unmatched."""
    recogniser = recogniser or Recogniser()
    schema = "doc_id long, n_sentences long, licenses string, spans string, unmatched string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for raw in batch.column(1).to_pylist():
                sentences = recogniser.sentences((raw or b"").decode("utf-8", "replace"))
                found, loose = recogniser.licenses(sentences)
                spans = ",".join(f"{name}:{a}:{b}" for name, a, b in found)
                rows.append((len(sentences), ",".join(sorted({f[0] for f in found})), spans, ",".join(loose)))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in schema.split(", ")])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(work, schema)
