"""Operator 5, licence scans: TF-IDF cosine of lines and header blocks to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import cut, lower_ascii, table

#: Fixed values: (licence, its notice, header or a paragraph of its text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Fixed values: (licence, the opening of its text). A text that begins with one is a licence file, however long.
OPENINGS = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
)

TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"

#: Least cosine of a line or block, and least share of a text's tokens in such lines or in blocks of its licence for it to be a licence file.
COSINE, FILE_SHARE = 0.8, 0.5

#: Tokens of a text among which an opening begins.
FIRST = 20


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({TOKEN})"))


def _idf(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequency of the templates' terms over all rows, and that of any other term.

    ln((1 + rows) / (1 + rows with the term)) + 1. Other terms count as never
    seen. One number per template term comes to the driver.
    """
    held = F.array_intersect(_tokens(F.coalesce(F.col(text_col), F.lit(""))), F.lit(vocabulary))
    terms = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("term"))  # the empty term stands for the row
    n = {r["term"]: r["n"] for r in terms.groupBy("term").agg(F.count("*").alias("n")).collect()}
    rows = n.get("", 0)
    return {t: math.log((1 + rows) / (1 + n.get(t, 0))) + 1 for t in vocabulary}, math.log(1 + rows) + 1


def _telling(weights: list[dict[str, float]], cosine: float) -> list[str]:
    """Terms of which a line must hold one to reach the cosine with any template.

    A line's cosine is at most the length of what it can share with the
    template, so the lightest terms may be left out while their joint length
    stays below the cosine.
    """
    found = set()
    for unit in weights:
        left = 0.0
        for term, w in sorted(unit.items(), key=lambda x: (x[1], x[0])):
            left += w * w
            if math.sqrt(left) >= cosine * 0.999:
                found.add(term)
    return sorted(found)


def scan_licences(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, openings=OPENINGS, cosine: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, path, own, score, inherited, inherited_from, licence.

    Every line of a text is compared with every template, and so is every block
    as long as a template that has one of its telling terms (:func:`_telling`) in the
    place it first takes in the template; blocks run on over lines and comment
    marks, so wrapped and commented headers are found, and notices inside
    longer lines. Of all that reach ``cosine`` the text's own licence is the one
    with the largest cosine times the root of the template's tokens (ties: the
    smaller name). A text with at least ``file_share`` of its tokens in such
    lines, or in such blocks of its own licence (each template once), or that
    begins with one of ``openings``, is a licence file, and its licence holds in its directory and below (of
    several files in a directory, the smallest path and licence). A text
    without its own licence inherits from the nearest ancestor directory that
    has one. Directories are joined once each, not once per document.

    Null and empty texts have no own licence, score 0; a null path has no
    directories. Repeated rows are answered each; an empty table gives no rows.
    Lines without a telling term cannot reach the cosine and are skipped.
    """
    kinds = _ordered(templates, openings)
    found = [re.findall(TOKEN, text.lower()) for _, text, _ in kinds]
    vocabulary = sorted({t for x in found for t in x})
    idf, unseen = _idf(docs, text_col, vocabulary)
    units, starts, entries = [], {}, []
    for k, ((name, _, opening), tokens) in enumerate(zip(kinds, found)):
        counts = Counter(tokens)
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in sorted(counts.items())))
        units.append({t: n * idf[t] / length for t, n in sorted(counts.items())})
        for t in _telling(units[-1:], cosine):
            starts.setdefault(t, []).append(f"named_struct('k', {k}, 'off', {tokens.index(t)})")
        terms = ", ".join(f"named_struct('t', '{t}', 'w', {w * idf[t]!r}D)" for t, w in units[-1].items())
        entries.append(f"named_struct('own', '{name}', 'n', {len(tokens)}, 'opening', {str(opening).lower()}, 'terms', array({terms}))")
    kind = F.expr(f"array({', '.join(entries)})")
    starting = F.expr("map(" + ", ".join(f"'{t}', array({', '.join(x)})" for t, x in sorted(starts.items())) + ")")
    telling = "|".join(re.escape(t) for t in sorted(starts))
    weight = F.expr("map(" + ", ".join(f"'{t}', {idf[t]!r}D" for t in vocabulary) + ")")

    def times(tokens: Column, term) -> Column:
        return F.size(F.filter(tokens, lambda x: x == term)).cast("double")

    def scored(tokens: Column, k: Column, at: Column) -> Column:
        each = F.transform(F.array_distinct(tokens), lambda t: times(tokens, t) * F.coalesce(F.element_at(weight, t), F.lit(unseen)))
        length = F.sqrt(F.aggregate(each, F.lit(0.0), lambda a, x: a + x * x))
        dot = F.aggregate(kind[k]["terms"], F.lit(0.0), lambda a, t: a + times(tokens, t["t"]) * t["w"])
        score = F.round(dot / length, 9)
        rank = F.round(score * F.sqrt(kind[k]["n"].cast("double")), 9)
        opens = kind[k]["opening"] & (at < FIRST)
        return F.struct(rank.alias("rank"), (-k).alias("k"), score.alias("score"), kind[k]["own"].alias("own"), F.size(tokens).alias("n"), opens.alias("opens"))

    def close(hits: Column) -> Column:
        return F.filter(hits, lambda x: x["score"] >= cosine)

    def best_of_line(tokens: Column) -> Column:
        near = F.filter(F.transform(tokens, lambda x: F.element_at(starting, x)), lambda x: x.isNotNull())
        ks = F.array_distinct(F.transform(F.flatten(near), lambda x: x["k"]))
        return F.array_max(close(F.transform(ks, lambda k: scored(tokens, k, F.lit(FIRST)))))

    def block(tokens: Column, spot: Column) -> Column:
        part = F.slice(tokens, F.greatest(spot["at"], F.lit(0)) + 1, kind[spot["k"]]["n"] + F.least(spot["at"], F.lit(0)))
        return F.transform(F.array(part), lambda x: scored(x, spot["k"], spot["at"]))[0]

    def spots(tokens: Column) -> Column:
        near = F.filter(F.transform(tokens, lambda x, i: F.struct(i.alias("i"), F.element_at(starting, x).alias("to"))), lambda x: x["to"].isNotNull())
        return F.array_distinct(F.flatten(F.transform(near, lambda x: F.transform(x["to"], lambda o: F.struct(o["k"].alias("k"), (x["i"] - o["off"]).alias("at"))))))

    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), lower_ascii(text).alias("_low"))
    some = some.withColumn("_lines", F.filter(F.split("_low", "\n"), lambda x: x.rlike(f"(?<![a-z0-9])(?:{telling})(?![a-z0-9])")))
    some = some.select("doc_id", "path", F.when(F.size("_lines") > 0, F.col("_lines")).alias("_lines"), F.when(F.size("_lines") > 0, _line_tokens(F.col("_low"))).alias("_all"))
    of_lines = F.filter(F.transform(F.transform("_lines", _line_tokens), best_of_line), lambda x: x.isNotNull())
    rows = some.select("doc_id", "path", F.size("_all").alias("_n"), of_lines.alias("_of_lines"), close(F.transform(spots(F.col("_all")), lambda x: block(F.col("_all"), x))).alias("_blocks"))
    rows = rows.withColumn("_hits", F.concat("_of_lines", "_blocks")).withColumn("_top", F.array_max("_hits"))
    mine = F.array_distinct(F.transform(F.filter("_blocks", lambda x: x["own"] == F.col("_top.own")), lambda x: F.struct(x["k"], x["n"])))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"])
    share = F.greatest(total(F.col("_of_lines")), total(mine)) / F.col("_n")
    share = F.when(F.exists("_blocks", lambda x: x["opens"] & (x["own"] == F.col("_top.own"))), F.lit(1.0)).otherwise(share)
    top = F.col("_top")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    own = cut(rows.select("doc_id", "path", parent.alias("_dir"), top["own"].alias("own"), F.coalesce(top["score"], F.lit(0.0)).alias("score"), top.isNotNull().alias("_hit"), share.alias("_share")))
    given = own.filter(F.col("_hit") & (F.col("_share") >= file_share) & F.col("path").isNotNull())
    given = given.groupBy(F.col("_dir").alias("_up")).agg(F.min(F.struct("path", "own")).alias("_given"))
    parts = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = own.filter("_dir is not null").select("_dir").distinct().select("_dir", F.posexplode(ups).alias("_depth", "_up"))
    nearest = cut(dirs.join(given, "_up").groupBy("_dir").agg(F.max(F.struct("_depth", "_up", "_given")).alias("_near")))
    found = own.join(nearest, "_dir", "left")
    without = F.col("own").isNull()
    inherited = F.when(without, F.col("_near._given.own"))
    return found.select("doc_id", "path", "own", "score", inherited.alias("inherited"), F.when(without, F.col("_near._up")).alias("inherited_from"), F.coalesce("own", inherited).alias("licence"))


def _ordered(templates, openings) -> list[tuple[str, str, bool]]:
    """(licence, text, whether it is an opening), in the order that settles ties."""
    return sorted([(*x, False) for x in templates] + [(*x, True) for x in openings])


def _line_tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({TOKEN})"))


def document_path() -> Column:
    """Documents hold no path; theirs is source / language / thousand of the id / id."""
    part = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("_"))
    return F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), part, F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_licences(docs, document_path())
    return found.withColumn("score", F.round("score", 6))


def _sql() -> str:
    quoted = [(name, text.lower().replace("'", "''"), opening) for name, text, opening in _ordered(TEMPLATES, OPENINGS)]
    values = ", ".join(f"({k}, '{name}', '{text}', {opening})" for k, (name, text, opening) in enumerate(quoted))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
  coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id // 1000 AS VARCHAR), '_') AS dir, coalesce(CAST(doc_id AS VARCHAR), '_') AS leaf FROM documents),
dt AS MATERIALIZED (SELECT r, doc_id, dir, leaf, t, regexp_extract_all(t, '{TOKEN}') AS toks FROM d),
tpl(k, name, t, opening) AS (VALUES {values}),
tp AS (SELECT k, name, opening, regexp_extract_all(t, '{TOKEN}') AS toks FROM tpl),
tt AS (SELECT k, term, count(*) AS tf, min(pos) - 1 AS off FROM (SELECT k, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM tp) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM (SELECT r, unnest(list_distinct(toks)) AS term FROM dt) GROUP BY term),
idf AS (SELECT DISTINCT tt.term, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(df.n, 0))) + 1 AS w FROM tt LEFT JOIN df USING (term)),
unseen AS (SELECT ln(1 + count(*)) + 1 AS w FROM d),
tn AS (SELECT k, sqrt(sum((tf * w) * (tf * w))) AS len, sqrt(sum(tf)) AS root, sum(tf) AS size FROM tt JOIN idf USING (term) GROUP BY k),
telling AS (SELECT k, term, off FROM (SELECT tt.k, tt.term, tt.off, sqrt(sum((tt.tf * idf.w / tn.len) * (tt.tf * idf.w / tn.len)) OVER (PARTITION BY tt.k ORDER BY tt.tf * idf.w / tn.len, tt.term)) AS c
  FROM tt JOIN idf USING (term) JOIN tn USING (k)) WHERE c >= {COSINE * 0.999!r}),
lines AS (SELECT r, row_number() OVER () AS line, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM dt)),
lt AS (SELECT r, line, term, count(*) AS tf FROM (SELECT r, line, unnest(regexp_extract_all(l, '{TOKEN}')) AS term FROM lines) GROUP BY ALL),
ln AS (SELECT r, line, sqrt(sum((tf * coalesce(w, (SELECT w FROM unseen))) * (tf * coalesce(w, (SELECT w FROM unseen))))) AS len, sum(tf) AS n FROM lt LEFT JOIN idf USING (term) GROUP BY ALL),
ld AS (SELECT lt.r, lt.line, tt.k, sum(lt.tf * tt.tf * idf.w * idf.w) AS dot FROM lt JOIN tt USING (term) JOIN idf USING (term) GROUP BY ALL),
of_lines AS (SELECT ld.r, line, k, round(dot / (ln.len * tn.len), 9) AS score, ln.n FROM ld JOIN ln USING (r, line) JOIN tn USING (k) WHERE round(dot / (ln.len * tn.len), 9) >= {COSINE}),
spots AS (SELECT DISTINCT r, k, pos - 1 - off AS start FROM (SELECT r, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM dt) JOIN telling USING (term)),
bt AS (SELECT r, k, start, term, count(*) AS tf FROM (SELECT r, k, start, unnest(toks[CAST(greatest(start, 0) + 1 AS BIGINT) : CAST(start + size AS BIGINT)]) AS term FROM spots JOIN dt USING (r) JOIN tn USING (k)) GROUP BY ALL),
bn AS (SELECT r, k, start, sqrt(sum((tf * coalesce(w, (SELECT w FROM unseen))) * (tf * coalesce(w, (SELECT w FROM unseen))))) AS len, sum(tf) AS n FROM bt LEFT JOIN idf USING (term) GROUP BY ALL),
bd AS (SELECT bt.r, bt.k, bt.start, sum(bt.tf * tt.tf * idf.w * idf.w) AS dot FROM bt JOIN tt USING (k, term) JOIN idf USING (term) GROUP BY ALL),
blocks AS (SELECT bd.r, k, start, round(dot / (bn.len * tn.len), 9) AS score, bn.n FROM bd JOIN bn USING (r, k, start) JOIN tn USING (k) WHERE round(dot / (bn.len * tn.len), 9) >= {COSINE}),
hits AS (SELECT r, k, score, round(score * root, 9) AS rank FROM (SELECT r, k, score FROM of_lines UNION ALL SELECT r, k, score FROM blocks) JOIN tn USING (k)),
per AS (SELECT r, first(name ORDER BY rank DESC, k) AS own, first(score ORDER BY rank DESC, k) AS score FROM hits JOIN tpl USING (k) GROUP BY r),
words AS (SELECT r, sum(n) AS n FROM (SELECT DISTINCT r, line, n FROM of_lines) GROUP BY r),
mine AS (SELECT r, sum(n) AS n, max(opens) AS opens FROM (SELECT r, k, n, max(CASE WHEN opening AND start < {FIRST} THEN 1 ELSE 0 END) AS opens FROM blocks JOIN tpl USING (k) JOIN per USING (r) WHERE name = own GROUP BY r, k, n) GROUP BY r),
own AS (SELECT r, doc_id, dir, dir || '/' || leaf AS path, per.own, coalesce(per.score, 0) AS score, CASE WHEN mine.opens = 1 THEN 1 ELSE greatest(coalesce(words.n, 0), coalesce(mine.n, 0)) / len(toks) END AS share
  FROM dt LEFT JOIN per USING (r) LEFT JOIN words USING (r) LEFT JOIN mine USING (r)),
given AS (SELECT dir AS up, first(own ORDER BY path, own) AS own FROM own WHERE own IS NOT NULL AND share >= {FILE_SHARE} GROUP BY dir),
ups AS (SELECT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS up, k FROM (SELECT DISTINCT dir FROM own), (VALUES (1), (2), (3)) v(k)),
near AS (SELECT ups.dir, first(given.own ORDER BY k DESC) AS own, first(ups.up ORDER BY k DESC) AS up FROM ups JOIN given ON ups.up = given.up GROUP BY ups.dir)
SELECT o.doc_id, o.path, o.own, round(o.score, 6) AS score, CASE WHEN o.own IS NULL THEN near.own END AS inherited, CASE WHEN o.own IS NULL THEN near.up END AS inherited_from, coalesce(o.own, near.own) AS licence
FROM own o LEFT JOIN near ON o.dir = near.dir
"""


SQL = _sql()
