import textwrap

from pyspark.sql import functions as F

from envspark.llm.licences import TEMPLATES, scan_licences

GPL = "This work is licensed under the GNU General Public License, version 3."
MIT = "Released under the MIT License."


def test_own_inherited_and_odd(spark, clashing):
    rows = [
        ("a/LICENSE", MIT), ("a/b/LICENSE", GPL), ("a/b/c/x", "plain words"), ("a/x", "plain words " * 40), ("a/b/y", f"code here " * 50 + "\n" + MIT.upper() + "\nmore"),
        ("d/x", None), ("d/e/x", ""), (None, "no path"), ("top", "words"), ("d/both", f"{GPL}\n{MIT}"), ("a/b/y2", "the license of this work is general"), ("a/x", "plain words " * 40),
        ("z/long", "word " * 100_000 + "\n" + GPL), ("z/w", "w"),
    ]
    docs = clashing(spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(rows)], "doc_id long, text string, place string"))
    got = {r.doc_id: r for r in scan_licences(docs, F.col("place")).collect()}
    assert len(got) == len(rows)
    assert [got[i].own for i in range(len(rows))] == ["MIT", "GPL-3.0", None, None, "MIT", None, None, None, None, "GPL-3.0", None, None, "GPL-3.0", None]
    assert [got[i].inherited for i in range(len(rows))] == [None, None, "GPL-3.0", "MIT", None, "GPL-3.0", "GPL-3.0", None, None, None, "GPL-3.0", "MIT", None, None]
    assert got[2].inherited_from == "a/b" and got[6].inherited_from == "d" and got[4].licence == "MIT"
    assert abs(got[0].score - 1) < 1e-9 and got[7].score == 0


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, place string")
    assert scan_licences(docs, F.col("place")).count() == 0


def test_skipped_lines_could_not_have_reached_the_cosine(spark):
    """Every subset of a template's words is scored as if no line were skipped."""
    words = MIT.rstrip(".").split()
    lines = [" ".join(w for k, w in enumerate(words) if n >> k & 1) for n in range(1, 1 << len(words))]
    docs = spark.createDataFrame([(i, t, "p/x") for i, t in enumerate(lines)], "doc_id long, text string, place string")
    alone = {"templates": (("MIT", MIT),), "openings": ()}  # of several, the own licence is not the one with the largest cosine
    low = {r.doc_id: r.score for r in scan_licences(docs, F.col("place"), cosine=0.01, **alone).collect()}
    got = {r.doc_id: r.score for r in scan_licences(docs, F.col("place"), cosine=0.8, **alone).collect()}
    assert all(abs(got[i] - (low[i] if low[i] >= 0.8 else 0)) < 1e-9 for i in got)


def test_real_headers_and_files(spark):
    """Licence files, wrapped and commented headers, notices inside longer lines, and prose that only mentions them."""
    grant = next(x for n, x in TEMPLATES if n == "MIT" and x.startswith("Permission"))
    notice = next(x for n, x in TEMPLATES if n == "MIT" and x.startswith("The above"))
    apache = next(x for n, x in TEMPLATES if n == "Apache-2.0" and "compliance" in x)
    bsd2, bsd3 = (max((x for n, x in TEMPLATES if n == f"BSD-{k}-Clause"), key=len) for k in (2, 3))
    wrapped = lambda x, mark: "\n".join(mark + line for line in textwrap.wrap(x, 60))
    body = "\n".join(f"def f{i}(): return {i}" for i in range(80))
    rows = [
        ("m/LICENSE", f"MIT License\n\nCopyright (c) 2024 Foo\n\n{wrapped(grant, '')}\n\n{wrapped(notice, '')}"), ("m/x", body), ("g/COPYING", "GNU GENERAL PUBLIC LICENSE\n  Version 3\n\n" + "plain words of the licence text " * 300), ("g/a/x", body),
        ("h/x", wrapped(apache, " * ") + "\n" + body), ("b/x", wrapped(bsd3, "# ") + "\n" + body), ("b/y", wrapped(bsd2, "// ") + "\n" + body), ("b/z", wrapped(bsd3[:140], "")),
        ("s/x", "// SPDX-License-Identifier: MIT\n" + body), ("s/y", MIT + " All rights reserved by the Foo authors, 2024.\n" + body), ("s/z", "the licence of this software grants permission to use a copy\n" + body), ("h/z", body),
    ]
    docs = spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(rows)], "doc_id long, text string, place string")
    got = {r.path: r for r in scan_licences(docs, F.col("place")).collect()}
    assert {p: r.own for p, r in got.items()} == {
        "m/LICENSE": "MIT", "m/x": None, "g/COPYING": "GPL-3.0", "g/a/x": None, "h/x": "Apache-2.0", "b/x": "BSD-3-Clause", "b/y": "BSD-2-Clause", "b/z": "BSD-3-Clause",
        "s/x": "MIT", "s/y": "MIT", "s/z": None, "h/z": None,
    }
    assert {p: r.licence for p, r in got.items() if r.own is None} == {"m/x": "MIT", "g/a/x": "GPL-3.0", "s/z": None, "h/z": None}
