"""Licence scan by sentence rules.

A text is cut into pieces, each piece is normalised (lower case, every run of
other characters than letters, digits, '.' and '-' one space, no '.' at the end)
and known licence sentences are looked up among the pieces. A piece that ends at
':', ';', 'v.' or a single line end may go on in the next, so a sentence may take
several pieces: hard-wrapped and commented notices read like those in one line.
Blank lines and '.', '!' and '?' end a sentence. The identifiers found, in
order, are then matched against ordered rules: a rule names the identifiers that
must follow one another, unknown sentences of the text between them or not. That
all rights are reserved is a licence only of a text that states no other one. The
tables are code, so their size is fixed; the scan is one narrow pass of built-in
column functions, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.common import documents, text_or_empty

#: Known sentences, normalised: (identifier, sentence).
SENTENCES: tuple[tuple[int, str], ...] = (
    (1, "released under the mit license"),
    (2, "licensed under the mit license"),
    (3, "this software is released under the mit license"),
    (4, "this project is licensed under the mit license"),
    (5, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    (6, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (7, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (10, "licensed under the apache license version 2.0"),
    (11, "licensed under the apache license version 2.0 the license"),
    (12, "you may not use this file except in compliance with the license"),
    (13, "you may obtain a copy of the license at"),
    (14, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    (15, "released under the apache license version 2.0"),
    (20, "this work is licensed under the gnu general public license version 3"),
    (21, "licensed under the gnu general public license version 3"),
    (22, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (23, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    (24, "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    (25, "this work is licensed under the gnu general public license version 2"),
    (26, "licensed under the gnu lesser general public license version 3"),
    (27, "licensed under the gnu affero general public license version 3"),
    (30, "licensed under cc by-nc 4.0"),
    (31, "this work is licensed under cc by-nc 4.0"),
    (32, "licensed under cc by 4.0"),
    (33, "licensed under cc by-sa 4.0"),
    (34, "licensed under cc0 1.0"),
    (35, "this work is licensed under a creative commons attribution 4.0 international license"),
    (36, "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    (37, "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    (40, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (41, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (42, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    (43, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (44, "licensed under the bsd 3-clause license"),
    (45, "licensed under the bsd 2-clause license"),
    (50, "this is free and unencumbered software released into the public domain"),
    (51, "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    (52, "all rights reserved"),
    (60, "gnu general public license version 3 29 june 2007"),
    (61, "gnu general public license version 2 june 1991"),
    (62, "gnu lesser general public license version 3 29 june 2007"),
    (63, "gnu affero general public license version 3 19 november 2007"),
    (64, "apache license version 2.0 january 2004"),
    (65, "mozilla public license version 2.0"),
)

#: Ordered rules: (licence, kind, identifiers that follow one another). All that match count: a BSD-3-Clause text states the terms of BSD-2-Clause too.
RULES: tuple[tuple[str, str, tuple[int, ...]], ...] = (
    ("MIT", "permissive", (1,)),
    ("MIT", "permissive", (2,)),
    ("MIT", "permissive", (3,)),
    ("MIT", "permissive", (4,)),
    ("MIT", "permissive", (5, 6)),
    ("Apache-2.0", "permissive", (10,)),
    ("Apache-2.0", "permissive", (15,)),
    ("Apache-2.0", "permissive", (11, 12)),
    ("GPL-3.0", "copyleft", (20,)),
    ("GPL-3.0", "copyleft", (21,)),
    ("GPL-3.0-or-later", "copyleft", (22,)),
    ("GPL-2.0-or-later", "copyleft", (23,)),
    ("GPL-2.0", "copyleft", (25,)),
    ("LGPL-3.0", "copyleft", (26,)),
    ("AGPL-3.0", "copyleft", (27,)),
    ("CC-BY-NC-4.0", "noncommercial", (30,)),
    ("CC-BY-NC-4.0", "noncommercial", (31,)),
    ("CC-BY-NC-4.0", "noncommercial", (36,)),
    ("CC-BY-4.0", "permissive", (32,)),
    ("CC-BY-4.0", "permissive", (35,)),
    ("CC-BY-SA-4.0", "copyleft", (33,)),
    ("CC-BY-SA-4.0", "copyleft", (37,)),
    ("CC0-1.0", "permissive", (34,)),
    ("BSD-3-Clause", "permissive", (40, 41, 42, 43)),
    ("BSD-2-Clause", "permissive", (40, 41, 42)),
    ("BSD-3-Clause", "permissive", (44,)),
    ("BSD-2-Clause", "permissive", (45,)),
    ("Unlicense", "permissive", (50,)),
    ("MPL-2.0", "copyleft", (51,)),
    ("GPL-3.0", "copyleft", (60,)),
    ("GPL-2.0", "copyleft", (61,)),
    ("LGPL-3.0", "copyleft", (62,)),
    ("AGPL-3.0", "copyleft", (63,)),
    ("Apache-2.0", "permissive", (64,)),
    ("MPL-2.0", "copyleft", (65,)),
    ("Proprietary", "reserved", (52,)),
)
#: Kinds that count only in a text without licences of other kinds.
YIELDING = ("reserved",)

#: Marks put into the text: a sentence ends here; a piece ends here, which a sentence may or may not.
END, SOFT = "\x01", "\x02"
#: In this order: (pattern, replacement). Each edge pattern is possessive and starts at a run's start, so long runs take linear time.
STEPS: tuple[tuple[str, str], ...] = (
    (r"(?<!\b[vV])([.!?])[ \t]++", END),
    (r"([.:;!?])[ \t]++", SOFT),
    (r"(?<!\b[vV])([.!?])\r?\n|\n(?:[ \t\r]*+\n)++", END),
    (r"\n", SOFT),
)
OTHER = rf"[^a-z0-9.{END}{SOFT}-]+"
EDGES = rf"(?<![ .-])[ .-]++(?=[{END}{SOFT}])|(?<=[{END}{SOFT}])[ .-]++"


def normalised(text: Column) -> Column:
    """The text's pieces, normalised, each between marks."""
    text = F.translate(text, END + SOFT, "  ")
    for pattern, mark in STEPS:
        text = F.regexp_replace(text, pattern, mark)
    text = F.concat(F.lit(END), F.regexp_replace(F.lower(text), OTHER, " "), F.lit(END))
    return F.regexp_replace(text, EDGES, "")


def _key(sentence: str) -> str:
    """A sentence without the full stops before blanks, which the edges of pieces lose."""
    return sentence.replace(". ", " ")


def _identifiers(text: Column, sentences: Sequence[tuple[int, str]]) -> Column:
    """Identifiers of the known sentences of a text, in order; of those that start at one piece the longest."""
    if not sentences:
        return F.array().cast("array<int>")
    keys = F.array(*(F.lit(_key(s)) for _, s in sentences))
    ids = F.array(*(F.lit(i) for i, _ in sentences))
    longest = sorted((s for _, s in sentences), key=len, reverse=True)
    forms = "|".join(re.escape(s).replace(r"\.\ ", r"\.?[ %s]" % SOFT).replace(r"\ ", f"[ {SOFT}]") for s in longest)
    hits = F.regexp_extract_all(normalised(text), F.lit(f"(?<=[{END}{SOFT}])(?:{forms})(?=[{END}{SOFT}])"), F.lit(0))
    plain = F.transform(hits, lambda s: F.replace(F.translate(s, SOFT, " "), F.lit(". "), F.lit(" ")))
    return F.transform(plain, lambda s: F.element_at(ids, F.array_position(keys, s).cast("int")))


def scan_licenses(
    docs: DataFrame,
    sentences: Sequence[tuple[int, str]] = SENTENCES,
    rules: Sequence[tuple[str, str, tuple[int, ...]]] = RULES,
    yielding: Sequence[str] = YIELDING,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, sentence_ids, licenses, kinds.

    sentence_ids are the known sentences in the order of the text, repeats
    included; licenses and kinds, sorted and without repeats, are those of all
    rules whose identifiers follow one another in it, those of the ``yielding``
    kinds only where there are no others. Null and empty texts, and
    texts without a known sentence, have empty arrays; repeated rows each give
    a row; no rows give none. Other columns are not read.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), _identifiers(text_or_empty(text_col), sentences).alias("sentence_ids"))
    line = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    matched = F.array_compact(F.array(*(F.when(F.contains(line, F.lit("," + ",".join(map(str, ids)) + ",")), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))) for name, kind, ids in rules)))
    others = F.filter(matched, lambda r: ~r["kind"].isin(*yielding)) if yielding else matched
    matched = F.when(F.size(others) > 0, others).otherwise(matched)
    found = found.withColumn("_rules", F.when(F.size("sentence_ids") > 0, matched).otherwise(F.array().cast("array<struct<name:string,kind:string>>")))
    return found.select("doc_id", "sentence_ids", F.array_sort(F.array_distinct(F.col("_rules.name"))).alias("licenses"), F.array_sort(F.array_distinct(F.col("_rules.kind"))).alias("kinds"))


def op8_license_rules(spark, sf_dir: str) -> DataFrame:
    """All documents, with the licences that they state."""
    found = scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"), F.array_join("kinds", ",").alias("kinds"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


#: The same rows by lists of pieces: a hit is a run of pieces that, joined by blanks, is a known sentence.
SQL = {
    "op8_license_rules": rf"""
        WITH known(id, s) AS (VALUES {_values((i, _key(s)) for i, s in SENTENCES)}),
        rules(name, kind, ids) AS (VALUES {_values((n, k, "," + ",".join(map(str, i)) + ",") for n, k, i in RULES)}),
        v AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), '   '), '\b([vV])\.([ \t]|\r?\n)', '\1' || chr(3) || '\2', 'g') AS t FROM documents),
        ends AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[.!?](?:[ \t]+|\r?\n)', chr(1), 'g'), '\n(?:[ \t\r]*\n)+', chr(1), 'g') AS t FROM v),
        parts AS (SELECT doc_id, generate_subscripts(l, 1) AS part, unnest(l) AS t
                  FROM (SELECT doc_id, string_split(regexp_replace(t, '[:;' || chr(3) || '][ \t]+|\n', chr(2), 'g'), chr(1)) AS l FROM ends)),
        cut AS (SELECT doc_id, part, list_transform(string_split(t, chr(2)), lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9.-]+', ' ', 'g'), '^[ .-]+|[ .-]+$', '', 'g')) AS p FROM parts),
        starts AS (SELECT doc_id, part, p, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM cut),
        hits AS (SELECT doc_id, part, i, id, list_filter(generate_series(i, least(i + 100, len(p))), lambda j: array_to_string(p[i:j], ' ') = s)[1] AS j
                 FROM starts JOIN known ON piece <> '' AND starts_with(s, piece)),
        best AS (SELECT doc_id, part, i, arg_max(id, j) AS id, max(j) AS j FROM hits WHERE j IS NOT NULL GROUP BY doc_id, part, i),
        apart AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM best c WHERE c.doc_id = b.doc_id AND c.part = b.part AND c.i < b.i AND b.i <= c.j)),
        seq AS (SELECT doc_id, count(*) AS n, ',' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY part, i) || ',' AS ids FROM apart GROUP BY doc_id),
        met AS (SELECT doc_id, name, kind, max(CASE WHEN kind IN ({", ".join(f"'{k}'" for k in YIELDING)}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS other
                FROM seq JOIN rules ON contains(seq.ids, rules.ids)),
        got AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
                FROM met WHERE other = 0 OR kind NOT IN ({", ".join(f"'{k}'" for k in YIELDING)}) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(seq.n, 0) AS n_sentences, coalesce(licenses, '') AS licenses, coalesce(kinds, '') AS kinds
        FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN got USING (doc_id)
    """
}
