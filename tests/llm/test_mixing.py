import re

import numpy as np
import pytest

from tidemark.llm import mixing
from tidemark.llm.mixing import flight, landing, mix, op5_mixing, targets


def test_targets():
    assert targets({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 200, "b": 500 / 3, "c": 250 / 3})
    assert targets({None: 10, "b": 10}) == pytest.approx({"b": 20, None: 10})
    assert targets({}) == {} and targets({"a": 0}) == {"a": 0} and targets({"a": 10}) == {"a": 15}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 50, 2000):
        p, s = rng.random(n), rng.integers(0, 5000, n).astype(float)
        q = flight(p, s, 2, np.random.default_rng(0))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert q.sum() == pytest.approx(p.sum(), abs=1e-5) and q @ s == pytest.approx(p @ s, abs=1e-2)
    same = flight(np.full(9, 0.5), np.ones(9), 2, np.random.default_rng(0))
    assert ((same > 0) & (same < 1)).sum() <= 2
    assert landing(np.array([0.4, 1.0, 0.6]), np.array([10.0, 5, 10])).tolist() in ([1, 1, 0], [0, 1, 1])


def test_inclusion_is_unbiased():
    p, s = np.full(30, 0.3), np.arange(30.0)
    mean = np.mean([flight(p, s, 2, np.random.default_rng(i)) for i in range(2000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.05


def check(rows, docs, near=True):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, _, t in docs}
    source = {k: s for k, s, _ in docs}
    total = {}
    for k in size:
        total[source[k]] = total.get(source[k], 0) + size[k]
    goal = targets(total)
    taken = dict.fromkeys(total, 0)
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, size))
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    if near:
        for s in total:
            assert abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 20, s
    return {r.doc_id: r.taken for r in rows}


def test_query_meets_targets_and_reruns_agree(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    first = check(op5_mixing(spark, d).collect(), docs)
    assert first == check(op5_mixing(spark, d).collect(), docs)


def test_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    docs = [(i, "hot", "w " * (i % 37)) for i in range(900)] + [(900 + i, None, "a b c") for i in range(40)]
    docs += [(1000, "one", "x y"), (1001, "empty", None), (1002, "empty", ""), (None, "hot", "z")]
    frame = spark.createDataFrame([(k, s, t, 1) for k, s, t in docs], "doc_id long, source string, text string, size int")
    got = mix(frame).selectExpr("doc.doc_id", "size", "source_size", "target", "taken").collect()
    check(got, docs, near=False)
    hot = [r for r in got if r.source_size == max(x.source_size for x in got)]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= 20
    assert mix(frame.where("doc_id = -1")).collect() == []
