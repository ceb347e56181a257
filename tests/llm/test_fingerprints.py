import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.fingerprints import TOKEN, links, op8_fingerprint, syncmers, with_next

MASK = 0xFFFFFFFF


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return signed(seed)


def anchors(text, k=4, s=2):
    h = [chain([w]) for w in re.findall(TOKEN, text)]
    if len(h) < k:
        return [(0, chain(h) & MASK)] if h else []
    g = [chain(h[i : i + s]) for i in range(len(h) - s + 1)]
    out = []
    for i in range(len(h) - k + 1):
        inner = g[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chain(inner) & MASK))
    return out


TEXTS = [None, "", "one", "a b c d", "the cat sat on the mat and the cat sat on the mat again", "日本語のテキスト abc", "x" * 100, "a b c d", " \n\t"]


def test_syncmers_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in syncmers(docs).collect():
        assert [(a.pos, a.hash) for a in r.anchors] == anchors(TEXTS[r.doc_id] or ""), r.text


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    shown = lambda a: ",".join(f"{h:08x}.{p - q}" for (p, h), (q, _) in zip(a, [(0, 0), *a]))
    got = {r.doc_id: r for r in op8_fingerprint(spark, d).collect()}
    assert len(got) == len(texts)

    def links(a):
        return {chain([h, b[0][1], b[0][0] - p] if b else [h]) for i, (p, h) in enumerate(a) for b in [a[i + 1 : i + 2]]}

    def like(a, b):
        a, b = links(a), links(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    wins = 0
    for i, (k, t) in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r, fp, efp, nfp = got[k], anchors(t), anchors(edited), anchors(nxt)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == shown(fp) and r.edited_fingerprint == shown(efp)
        assert abs(r.near_edited - like(fp, efp)) < 1e-12 and abs(r.near_next - like(fp, nfp)) < 1e-12
        wins += r.near_edited > r.near_next
    assert wins > 0.9 * len(texts)


@pytest.mark.parametrize("size", [50, 1, 5000])
def test_next_row_over_ranges(spark, size):
    keys = [None, None, *range(0, 3000, 3), 7, 7, 9]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, v int").repartition(5)
    got = {r.v: r.next_v for r in with_next(df, "k", ["v"], per_range=size).collect()}
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    assert got == {v: order[(j + 1) % len(order)] for j, v in enumerate(order)}


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert with_next(empty, "k", ["v"]).collect() == []
    one = spark.createDataFrame([(1, 5)], "k int, v int")
    assert [tuple(r) for r in with_next(one, "k", ["v"]).select("v", "next_v").collect()] == [(5, 5)]


def test_next_row_over_2000_ranges(spark):
    df = spark.range(0, 12_000, 3).selectExpr("id AS k", "id * 2 AS v")
    got = {r.k: r.next_v for r in with_next(df, "k", ["v"], per_range=2).collect()}
    assert got == {k: (k + 3) % 12_000 * 2 for k in range(0, 12_000, 3)}


def test_clashing_names_and_moved_passages(spark):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(1, base, 0, "x", "y", 1), (2, "lead words stand here " + base, 1, "x", "y", 2), (3, None, 2, None, None, 3)]
    docs = spark.createDataFrame(rows, "id long, text string, at int, anchors string, anchors_h string, next_text int")
    got = {r.id: r for r in syncmers(docs).collect()}
    assert [(a.pos, a.hash) for a in got[1].anchors] == anchors(base) and got[1].anchors_h == "y" and got[3].anchors == []
    near = with_next(docs, "id", ["text"])
    assert {r.id: r.next_text for r in near.collect()} == {1: rows[1][1], 2: None, 3: base} and near.columns.count("next_text") == 1
    both = syncmers(docs.select("id", "text")).select("id", links(F.col("anchors")).alias("l")).collect()
    a, b = set(both[0].l), set(both[1].l)
    assert len(a & b) >= len(a) - 2  # the passage is matched at its new place
