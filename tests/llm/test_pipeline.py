from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_packing import check as check_pack
from tidemark.llm.secrets import secret_digest, secret_spans
from tidemark.llm.toxicity import train, with_scores


def test_stages_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns

    def stage(i, docs):
        out = p.written(p.STAGES[i][1](spark, docs, d))
        assert i == 4 or out.columns == names
        return out, sorted(docs.collect(), key=lambda r: r.doc_id), sorted(out.collect(), key=lambda r: r.doc_id)

    labels = spark.read.parquet(f"{d}/labels.parquet")
    rejected = {r.doc_id for r in with_scores(docs, train(docs, labels)).collect() if r.predicted}
    docs, before, after = stage(0, docs)
    assert after == [r for r in before if r.doc_id not in rejected] and rejected
    docs, before, after = stage(1, docs)
    groups = [c for _, c in brute([r.text for r in before])]
    assert after == [r for i, r in enumerate(before) if groups[i] == i] and len(after) < len(before)
    rows, spans = secret_spans(docs.select("doc_id", "text"))
    found = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in secret_digest(rows, spans).collect()}
    docs, before, after = stage(2, docs)
    for a, b in zip(before, after):
        text, at = "", 0
        for s, e in sorted(found[a.doc_id]):
            if s >= at:
                text += a.text[at:s] + "[SECRET]"
            at = max(at, e)
        want = text + a.text[at:] if found[a.doc_id] else a.text
        assert (b.text, b.n_chars, b.source) == (want, len(want), a.source)
    assert any(found.values())
    docs, before, after = stage(3, docs)
    counts = {}
    for r in after:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert {r for r in after} <= {r for r in before} and max(counts.values()) <= 2
    taken = [r for r in p.mix(spark.createDataFrame(before).select("doc_id", "source", "text")).selectExpr("doc.doc_id", "size", "source_size", "target", "taken", "copies").collect()]
    check_mix(taken, [(r.doc_id, r.source, r.text) for r in before], near=False)
    assert counts == {r.doc_id: r.copies for r in taken if r.copies}
    once = docs.dropDuplicates(["doc_id"])
    _, _, packed = stage(4, once)
    check_pack(packed, {r.doc_id: r.text for r in once.collect()})
    twice = p.pack_sequences(spark, docs, d).collect()
    assert len(twice) == sum(counts[r.doc_id] for r in packed)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "other words"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "password=abcdefghijklmno x"), (None, "secret=abcdefghijklmno")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "5", "None", "None"]
    clean = {(r.doc_id, r.text) for r in p.mask_secrets(spark, docs, "").collect()}
    assert (5, "[SECRET] x") in clean and (None, "[SECRET]") in clean and (3, None) in clean
    assert p.mix_sources(spark, docs, "").columns == docs.columns
    empty = docs.where("doc_id = 99")
    for stage in (p.drop_near_duplicates, p.mask_secrets, p.mix_sources, p.pack_sequences):
        assert stage(spark, empty, "").collect() == []


def test_mixing_repeated_rows(spark):
    """Equal rows are taken as often as the mix decides for them together."""
    rows = [(None, "w " * 200, "a", 1)] * 40 + [(i, f"x{i} " * (50 + i), "ab"[i % 2], 2) for i in range(60)] + [(7, None, "a", 3), (7, "", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row_key int")
    out = p.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    mixed = p.mix(docs.select("doc_id", "source", "text"))
    want = mixed.selectExpr("sum(taken)", "sum(copies)").first()
    got = out.collect()
    assert sum(len((r.text or "").split()) for r in got) == want[0] and len(got) == want[1]
    assert set(got) <= set(docs.collect())


def test_toxicity_stage_on_odd_rows(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (None, "", "en", "s", 0)] * 2, docs.schema)
    assert p.drop_toxic(spark, odd, folder).count() == 4
    assert p.drop_toxic(spark, docs.where("doc_id < -5"), folder).collect() == []


def test_groups_without_id_keep_one_row(spark):
    words = [f"w{i}" for i in range(200)]
    whole, near = " ".join(words), " ".join(words[:90] + ["x"] + words[90:])
    alone, beside = " ".join(f"v{i}" for i in range(100)), " ".join(f"v{i}" for i in range(101))
    rows = [(1, whole), (None, near), (None, whole), (None, whole), (None, alone), (None, alone), (None, beside), (None, "far from all others here"), (None, None), (None, " \n"), (5, beside.replace("v", "u"))]
    rows += [(None, "once more and again and so on")] * 200
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, t1 int, `group` int")
    got = p.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    assert [k for k in kept if k[1] in (alone, beside)] in ([("None", alone)], [("None", beside)])
    rest = [("1", whole), ("None", ""), ("None", " \n"), ("None", "far from all others here"), ("None", "once more and again and so on"), ("5", beside.replace("v", "u"))]
    assert sorted(k for k in kept if k[1] not in (alone, beside)) == sorted(rest)


def test_stages_with_clashing_columns(spark):
    folder = "/root/testdata/sf0.001"
    names = ["score", "predicted", "scored_text", "own_print", "key", "print", "gaps", "tail", "group", "t1", "row_key", "row_number", "copy", "a.b", "__text", "row_id", "doc", "size", "n_shingles"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for _, stage in p.STAGES[:4]:
        got, want = stage(spark, more, folder), stage(spark, docs, folder)
        assert got.columns == more.columns
        rows = got.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in want.collect()) and rows
        assert all([r[c] for c in names] == list(range(len(names))) for r in rows)
