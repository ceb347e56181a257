import re

import duckdb
import pytest

from tidemark.llm.licenses import ORACLE, PHRASES, TEMPLATES, license_hits, op1_license_scan

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def places(text):
    w = WORDS.findall(lowered(text))
    out = {}
    for phrase, label in PHRASES.items():
        p = phrase.split()
        out[label] = [i for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), out


def rows_of(frame, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in frame)


def both(spark, folder, d):
    got = op1_license_scan(spark, d)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}'")
    rel = con.sql(ORACLE["op1_license_scan"])
    columns = got.columns
    at = [rel.columns.index(c) for c in columns]
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = got.collect()
    assert sorted(tuple(norm(r[c]) for c in columns) for r in rows) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    return rows


TEXTS = [
    None, "", " \n", "MIT  License, mit-license mit license", "The mit\nlicense é GNU General public LICENSE", "apache license 2.0", "cc by cc-by CC by",
    "Licensed under the Apache License,\nVersion 2.0 x", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files, to deal in the Software without restriction",
    "w " * 3000 + "\nLicensed under CC BY-NC 4.0.\n" + "v " * 3000, "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0.", "mitlicense mit licenses", "MİT LICENSE", "free and software of the to",
]


def test_odd_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    for r in both(spark, f"{tmp_path}/documents.parquet/*.parquet", f"file://{tmp_path}"):
        n, at = places(TEXTS[r.doc_id])
        every = sorted(i for v in at.values() for i in v)
        assert (r.n_words, r.n_base) == (n, len(every)) and (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert r.base_labels == ",".join(sorted(k for k, v in at.items() if v)) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    rows, hits = license_hits(docs.where("doc_id = 8"))
    assert {h.label for h in hits.collect()} == {"mit"}
    rows, hits = license_hits(docs.where("doc_id < 0"))
    assert rows.collect() == hits.collect() == []


GPL3 = "This work is licensed under the GNU General Public License, version 3."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"


@pytest.mark.parametrize("text,labels", [
    (GPL3, {"gpl-3"}), (GPL3.replace("3", "2"), {"gpl-2"}), ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}), ("Licensed under CC BY 4.0", set()),
    (LGPL, {"lgpl"}), (LGPL.replace("library", "program").replace("Lesser ", ""), {"gpl"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", set()),
    ("x y z\n" * 30 + GPL3 + " w" * 500, {"gpl-3"}),
])
def test_siblings_are_told_apart(spark, text, labels):
    _, hits = license_hits(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert {h.label for h in hits.collect() if h.own} == labels


AGPL = "This program is licensed under the terms of the GNU Affero General Public License"


@pytest.mark.parametrize("text,labels", [
    ("Licensed under CC BY SA 4.0 or CC BY NC 4.0", {"cc-by-sa", "cc-by-nc"}), ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
    (AGPL + " or the GNU Lesser General Public License", {"agpl", "lgpl"}),
    (GPL3[:-1] + " or the GNU Lesser General Public License", {"gpl-3", "lgpl"}),
    (GPL3.replace("3.", "2 not version 3"), {"gpl-2", "gpl-3"}), (AGPL, {"agpl"}), (AGPL.replace("Affero", "Lesser"), {"lgpl"}),
])
def test_dual_licenses_give_both(spark, tmp_path, text, labels):
    docs = spark.createDataFrame([(1, text), (2, "w " * 40 + text + " v" * 40)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    base = {"gpl", "apache", "cc-by", "mit"}
    for r in both(spark, f"{tmp_path}/documents.parquet/*.parquet", f"file://{tmp_path}"):
        assert set(r.labels.split(",")) - (base - labels) == labels


@pytest.mark.parametrize("gap", [" ", "\n", "\n\n * ", "\n\n\n# "])
def test_a_notice_is_found_however_it_is_wrapped(spark, gap):
    words = next(body for label, body, _ in TEMPLATES if label == "bsd").split()
    text = "w " * 5000 + gap.join(words) + " v" * 5000
    _, hits = license_hits(spark.createDataFrame([(1, text), (2, " and ".join(f"{w} a b" for w in words))], "doc_id long, text string"))
    found = hits.collect()
    assert {(h.label, h.containment) for h in found if h.start_word == 5000} == {("bsd", 1.0)} and len({h.row_id for h in found}) == 1


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql(spark, sf):
    both(spark, f"/root/testdata/{sf}/documents.parquet", f"/root/testdata/{sf}")
