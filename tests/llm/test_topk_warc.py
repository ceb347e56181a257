import os

import numpy as np
import pytest
import zstandard as zstd

from tidemark.llm import topk
from tidemark.llm.topk import top_k
from tidemark.llm.warc import read_archives, records_of, write_archives


def brute(rows, queries, k):
    whole = lambda v: [int(np.floor(1024 * x)) for x in v]
    ok = lambda i, v: i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    rows = [(i, whole(v)) for i, v in rows if ok(i, v)]
    asked = {}
    for i, v in sorted((q for q in queries if ok(*q)), key=lambda q: (q[0], q[1])):
        asked.setdefault(i, whole(v))
    out = []
    for q, w in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, v in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard,leaf", [(10**6, 128), (60, 4), (20, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "LEAF", leaf)
    r = np.random.default_rng(0)
    rows = [(i, r.normal(0, 0.3, 6).round(2).tolist()) for i in range(400)]
    rows += [(500 + i, [0.5] * 6) for i in range(40)]  # ties
    rows += [(None, [0.1] * 6), (600, None), (601, [0.1, None]), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (604, []), (605, [1.0, 2.0]), (100, [0.2] * 6), (3, [0.3] * 6)]
    frame = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = top_k(frame, frame.where("vec_id % 50 = 0 OR vec_id IS NULL"), 7).collect()
    assert sorted(map(tuple, got)) == brute(rows, [x for x in rows if x[0] is None or x[0] % 50 == 0], 7)
    assert top_k(frame.where("vec_id < 0"), frame, 3).collect() == [] and top_k(frame, frame.where("vec_id < 0"), 3).collect() == []


def test_queries_visit_only_balls_that_can_matter(spark, monkeypatch):
    """Clusters far apart, one vector repeated in a third of the rows: all found, and few shards asked."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    r = np.random.default_rng(2)
    rows = [(i, (np.eye(12)[i % 12] * 4 + r.normal(0, 0.02, 12)).round(3).tolist()) for i in range(1200)]
    rows += [(5000 + i, (np.eye(12)[3] * 4).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = []
    real = topk.written
    monkeypatch.setattr(topk, "written", lambda df: asked.append(real(df)) or asked[-1])
    got = top_k(frame, frame.where("vec_id % 100 = 0 AND vec_id < 1200"), 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, [x for x in rows if x[0] % 100 == 0 and x[0] < 1200], 5)
    pairs = sum(a.count() for a in asked if "floor" in a.columns)
    shards = max(a.agg({"shard": "max"}).first()[0] or 0 for a in asked if "shard" in a.columns) + 1
    assert shards >= 30 and pairs < 12 * shards / 2


def test_scores_beyond_long_are_cut(spark):
    rows = [(i, [1e12 * s, 1.0]) for i, s in enumerate([1, 2, 3, -1, -2])] + [(9, [1.8e305, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(frame, frame.where("vec_id = 0"), 4).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1), (0, 3, 3, 1 - 2**63), (0, 4, 4, 1 - 2**63)]


def test_large_components(spark):
    rows = [(0, [3e9, 1.0]), (1, [1e3, 1e-3]), (2, [1e3, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(frame, frame.where("vec_id = 1"), 2).collect()
    assert sorted(map(tuple, got)) == brute(rows, rows[1:2], 2)


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "same words again and again " * 30 + "</p>"
    pages = [(i, f"http://a.example/{i}\r\nX-Evil: 1", f"<html>{i % 7} {long}</html>") for i in range(300)]
    pages += [(1000, None, None), (1001, "u", ""), (1002, "u", "short"), (1003, "u", "short"), (None, "u", "n" * 200), (None, "u", "n" * 200), (5, "u", long), (5, "u", long), (2000, "u", long), (3000, "é", "é" * 400_000)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    archives = write_archives(frame, f"file://{tmp_path}/w")
    rows = read_archives(archives).collect()
    assert len(rows) == len(pages) and sum(r.records for r in archives.collect()) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = sorted((str(i), len((h or "").encode()), str(None if first.get(h, i) == i else first.get(h))) for i, _, h in pages)
    assert sorted((str(r.page_id), r.payload_bytes, str(r.refers_to)) for r in rows) == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) and (r.payload is None) == (r.record_type == "revisit") for r in rows)
    files = os.listdir(tmp_path / "w")
    assert files and all(f.endswith(".warc.zst") for f in files)
    leads = [open(tmp_path / "w" / f, "rb").read(4) for f in files]
    assert all(x in (bytes.fromhex("5d2a4d18"), zstd.FRAME_HEADER) for x in leads) and bytes.fromhex("5d2a4d18") in leads
    with pytest.raises((ValueError, zstd.ZstdError)):
        bad = tmp_path / "bad.warc.zst"
        bad.write_bytes(open(tmp_path / "w" / files[0], "rb").read()[:-9])
        list(records_of(str(bad)))
    assert read_archives(write_archives(frame.where("page_id < 0"), f"file://{tmp_path}/e")).collect() == []


def test_archives_roll_over(spark, tmp_path):
    pages = [(i, "u", os.urandom(300).hex()) for i in range(40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    archives = write_archives(frame, f"file://{tmp_path}/w", archive_bytes=2000, train_bytes=1000)
    assert archives.count() > 5 and {r.page_id for r in read_archives(archives).collect()} == set(range(40))
