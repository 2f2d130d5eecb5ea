import re
import textwrap

import duckdb

from placewise.llm.licenses import TEXTS, TRIGGERS, canonical, notice_rows, scan_licenses, scan_sql, untitled

from .conftest import ROWS, SF


def test_equivalent_spellings_have_one_digest(spark):
    base = TEXTS["MIT"]
    variants = [
        base,
        base.upper(),
        "Copyright (c) 2020 Somebody Else\n" + base,
        base.replace("\n\n", "\n\nCopyright 1999 A. Nother, all rights reserved\n(c) B\n\n", 1),
        base.replace(" ", "  \t").replace('"', "'"),
        base.replace("sublicense", "sub-licence"),
    ]
    others = [base + " More words.", base[:-40], ""]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(variants + others)), "doc_id long, text string")).collect()
    for r in rows:
        assert r["license_id"] == ("MIT" if r["doc_id"] < len(variants) else None)


STYLES = {"plain": "{}", "star": " * {}", "slashes": "// {}", "hash": "# {}"}


def wrapped(text, width, style):
    """The paragraphs of a text filled anew, every line with a comment mark."""
    lines = []
    for paragraph in re.split(r"\n\s*\n", text.strip()):
        lines += [*textwrap.wrap(" ".join(paragraph.split()), width, break_long_words=False, break_on_hyphens=False), ""]
    return "\n".join(STYLES[style].format(line) for line in lines)


def test_wrapping_and_comment_marks_change_nothing(spark):
    """Every text at every width from 50 to 100, with and without its title and a copyright line of the user's."""
    rows, wanted = [], {}
    for n, (license_id, text) in enumerate(TEXTS.items()):
        for width in range(50, 101):
            style = list(STYLES)[(n + width) % 4]
            body = text if width % 2 else untitled(text) or text
            made = wrapped(body, width, style)
            if license_id in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause"):
                notice = STYLES[style].format("Copyright (c) 2019-2021 Jane Doe <jane@example.org>. All rights reserved.")
                made = notice + "\n" + STYLES[style].format("") + "\n" + made
            wanted[len(rows)] = (license_id, width, style)
            rows.append((len(rows), made))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    lost = [wanted[r["doc_id"]] for r in scan_licenses(frame).collect() if r["license_id"] != wanted[r["doc_id"]][0]]
    assert not lost, (len(lost), {x[0] for x in lost}, lost[:5])


def test_sentences_about_copyright_are_kept(spark):
    texts = ["copyright holders be liable", "copyright notice and more", "(c) You must retain", "Copyright 2020 A\nbody", "(c) 2001 B\nbody", "© C\nbody", "All rights reserved.\nbody", "Copyright (C) D\nCopyright E 1999\n# copyright by F\nbody"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: r["c"] for r in rows.select("i", canonical(rows["t"]).alias("c")).collect()}
    assert [found[i] for i in range(len(texts))] == ["copyright holders be liable", "copyright notice and more", "c you must retain", "body", "body", "body", "body", "copyright e 1999 body"]


def test_notice_lines(spark):
    texts = [
        "Some prose.\nReleased under the MIT License.\nMore.",
        "LICENCED UNDER THE APACHE LICENCE, VERSION 2.0!\nlicensed under CC BY-NC 4.0",
        "The license of the author is a poetic one.",
    ]
    found = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i]["notice_ids"] for i in range(3)] == ["MIT", "Apache-2.0,CC-BY-NC-4.0", ""]
    assert [found[i]["n_notices"] for i in range(3)] == [1, 2, 0]


def test_every_known_notice_has_a_trigger(spark):
    rows = spark.createDataFrame(notice_rows(), "id string, text string")
    texts = [r["c"] for r in rows.select(canonical(rows["text"]).alias("c")).collect()]
    assert texts and all(any(t in c for t in TRIGGERS) for c in texts)


def test_agrees_with_sql(spark, odd_docs, no_docs):
    for docs, view in (
        (spark.read.parquet(f"{SF}/documents.parquet"), f"select * from '{SF}/documents.parquet'"),
        (odd_docs, "select * from odd"),
        (no_docs, "select * from odd limit 0"),
    ):
        con = duckdb.connect()
        con.register("odd", odd_docs.toPandas().astype({"doc_id": "Int64"}))
        con.execute(f"create view documents as {view}")
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        want = sorted(con.execute(scan_sql()).fetchall(), key=key)
        assert sorted((tuple(r) for r in scan_licenses(docs).collect()), key=key) == want


def test_odd_inputs(spark, odd_docs, no_docs):
    assert scan_licenses(odd_docs).count() == len(ROWS) and scan_licenses(no_docs).count() == 0
    nothing = spark.createDataFrame([], "license_id string, text string")
    assert scan_licenses(odd_docs, nothing, nothing).where("license_id is not null or n_notices > 0").count() == 0
    plan = scan_licenses(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_texts_and_header_lines(spark):
    ids = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"]
    rows = [(i, TEXTS[x].replace(" ", "  ")) for i, x in enumerate(ids)]
    rows += [(100, 'Code.\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file')]
    found = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i]["license_id"] for i in range(len(ids))] == ids
    assert found[100]["notice_ids"] == "Apache-2.0"
