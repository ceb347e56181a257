import zlib

import numpy as np

import zstandard as zstd

from tidemark.llm.toxicity import STEP, THRESHOLD, WINDOW, fit, held_out, lowered, op4_toxicity, train, with_scores
from pyspark.sql import functions as F


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    rest = got[got.held_out]
    found = auc(rest.score.to_numpy(), rest.toxic.to_numpy())
    wrong = (rest.predicted[rest.toxic == 0] == 1).mean()
    hit = (rest.predicted[rest.toxic == 1] == 1).mean()
    print("AUC", found, "false alarms", wrong, "found", hit)
    assert found > 0.9 and wrong < 0.05 and hit > 0.65  # few labelled rows at this size


def test_odd_rows(spark):
    words = "the of and to in is it was for on".split()
    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice(words, 60)) + f" {i}" for i in range(200)]
    toxic = [" ".join(np.insert(rng.choice(words, 60).astype(object), [5, 30, 50], "disgusting")) + f" {i}" for i in range(100)]
    texts = plain + toxic
    model = fit(texts, [0] * 200 + [1] * 100)
    assert model is not None and fit(plain, [0] * 200) is None and fit([], []) is None
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate([*texts, None, "", "é" * 100_000])], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in with_scores(docs, train(docs, labels)).collect()}
    assert len(got) == 303 and got[0].toxic == "x"
    right = [got[i].predicted == int(i >= 200) for i in range(300)]
    assert np.mean(right) > 0.95 and got[300].predicted == got[301].predicted == 0
    none = train(docs, labels.where("toxic = 0"))
    assert {(r.score, r._score) for r in with_scores(docs, none).collect()} == {(1.0, 0.0)}  # the table's own column stays
    assert with_scores(docs.where("doc_id < 0"), none).collect() == []
    assert spark.range(1).select(held_out(F.lit(None).cast("long"))).first()[0] is False
    assert lowered(None) == b"  "


def sample_model():
    words = "the of and to in is it was for on".split()
    rng = np.random.default_rng(2)
    plain = [" ".join(rng.choice(words, 50)) + f" {i}" for i in range(150)]
    toxic = [" ".join(np.insert(rng.choice(words, 50).astype(object), [5, 30], "disgusting")) + f" {i}" for i in range(80)]
    return plain, toxic, fit(plain + toxic, [0] * 150 + [1] * 80)


def test_scores_equal_a_plain_rescoring(spark):
    """Every window compressed on its own, the four figures and the logistic in plain Python."""
    plain, toxic, model = sample_model()
    contents, w = model
    level = zstd.ZstdCompressionParameters(
        window_log=15, strategy=zstd.STRATEGY_LAZY2, min_match=4, hash_log=15, chain_log=15, search_log=5, target_length=32,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    both = [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=level) for c in contents]

    def expected(text):
        b = lowered(text)
        parts = [b[i : i + WINDOW] for i in range(0, max(1, len(b) - WINDOW + STEP), STEP)]
        d = [len(both[0].compress(p)) - len(both[1].compress(p)) for p in parts]
        total = len(d) + 20
        figures = [max(d) / 8, sum(max(x - 2, 0) for x in d) / total * 10, sum(max(x - 4, 0) for x in d) / total * 10, np.log(total), 1]
        return 1 / (1 + np.exp(-np.dot(figures, w)))

    texts = plain[:20] + toxic[:20] + ["", None, "x" * 63, "ABC " * 5000, toxic[0] * 40]
    import pickle

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in with_scores(docs, pickle.dumps(model)).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i].score - expected(t)) < 1e-9 and got[i].predicted == int(got[i].score >= THRESHOLD)


def test_conflicts_order_and_repeated_rows(spark):
    plain, toxic, model = sample_model()
    rows = [(t, 0) for t in plain] + [(t, 1) for t in toxic]
    again = rows[::-1] + rows[:30] + [(toxic[0], 0)]  # a text with both labels is toxic, wherever it stands
    same = fit([t for t, _ in again], [y for _, y in again])
    assert same[0] == model[0] and np.array_equal(same[1], model[1])
    import pickle

    docs = spark.createDataFrame([(1, toxic[0], "a")] * 3 + [(None, plain[0], None)], "doc_id long, text string, predicted string")
    got = with_scores(docs, pickle.dumps(model)).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1
