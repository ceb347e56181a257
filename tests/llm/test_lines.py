import hashlib

import duckdb
import pytest

from tidemark.llm.lines import ORACLE, dedup_lines, op13_line_dedup

A, B = "The same line twice", "Another line of some length"


def plain(rows, least_chars=10, least_documents=2):
    """rows of (id, text) -> list of (id, text kept, n_lines, n_dropped), by loops."""
    key = lambda l: "".join(c.lower() if "A" <= c <= "Z" else c for c in l.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: (i is None, i or 0)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= least_documents and min(held[key(x)]) != rank(i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


ROWS = [
    (5, f"{A}\n{B}\nshort\n{A}"), (3, f"  {A.upper()}\t\nshort\n"), (9, f"{A}"), (9, f"{A}"), (9, f"x\n{B} \n\n{B}"), (4, None), (6, ""), (7, "\n\n"),
    (None, f"{A}\nonly without id here\nx"), (None, "only without id here\nMİTTEL länger als zehn"), (11, "mİTTEL länger als zehn\r\nabcdefghi\n\x0babcdefghij"),
    (12, "ABCDEFGHI\nABCDEFGHIJ"), (13, "é" * 9), (14, "é" * 9), (15, "é" * 10), (16, "é" * 10), (17, f"{A} " * 5000 + f"\n{B}"), (2, "w\n" * 3000 + A),
]


@pytest.mark.parametrize("least_documents", [1, 2, 3, 4])
def test_equals_loops(spark, least_documents):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = [tuple(r) for r in dedup_lines(docs, least_documents=least_documents).collect()]
    assert sorted(got, key=str) == sorted(plain(ROWS, 10, least_documents), key=str)


def test_sql_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    equal_to_sql(spark, f"{tmp_path}/documents.parquet/*.parquet", f"file://{tmp_path}")


def equal_to_sql(spark, files, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    rel = con.sql(ORACLE["op13_line_dedup"])
    got = op13_line_dedup(spark, folder).select(*rel.columns)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_query_equals_sql(spark):
    equal_to_sql(spark, "/root/testdata/sf0.001/documents.parquet", "/root/testdata/sf0.001")


def test_clashing_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, A, 3, "a", "b"), (2, A, None, None, "c")], "doc_id long, text string, n_lines int, line_h1 string, `line.place` string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert (got[1].text, got[2].text, got[1].n_lines, got[1]._n_lines, got[2].n_dropped, got[1].line_h1) == (A, "", 3, 1, 1, "a")
    assert dedup_lines(docs.limit(0)).collect() == []


def test_digest_is_of_the_text_kept(spark):
    r = {x.doc_id: x for x in op13_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    texts = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for i, text, n, gone in plain(list(texts.items())):
        assert (r[i].n_lines, r[i].n_dropped, r[i].kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())
