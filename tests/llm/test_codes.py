import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tidemark.llm.codes import LONG, ORACLE, compress, fit_codebooks, nearest, op11_vector_codes, sequency_order, transformed


def plain(rows, parts=8, entries=16, rounds=6):
    """(codes by row, errors, codebooks) of rows (id, vector), by loops over Python's integers."""
    ints = [[min(max(math.floor(4096 * x) if abs(x) < 1e300 else int(math.copysign(2**70, x)), -(2**62)), 2**62) for x in v] for _, v in rows]
    length = -(-max(map(len, ints)) // parts)
    ints = [v + [0] * (length * parts - len(v)) for v in ints]
    cut = [[v[p * length : (p + 1) * length] for p in range(parts)] for v in ints]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((dist(c[p], b), e) for e, b in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got) if g[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    final = assign()
    return ["".join(f"{e:02x}" for _, e in g) for g in final], [min(sum(d for d, _ in g), LONG) for g in final], books


def test_transform_keeps_scaled_distances():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 5, 8, 13):
        size = 1 << (width - 1).bit_length()
        a = rng.integers(-1000, 1000, (20, width))
        order = sequency_order(size)
        t = transformed(a, order)
        assert (((t[:1] - t) ** 2).sum(axis=1) == size * ((a[:1] - a) ** 2).sum(axis=1)).all()
        assert sorted(order) == list(range(size)) and order[0] == 0
        changes = (np.diff(np.sign(transformed(np.eye(size, dtype=np.int64), order)), axis=0) != 0).sum(axis=0)
        assert list(changes) == list(range(size))


@pytest.mark.parametrize("spread", [2, 100, 2**40])
def test_nearest_equals_loops_with_ties(spread):
    rng = random.Random(spread)
    for width in (1, 3, 8):
        points = np.array([[rng.randint(-spread, spread) for _ in range(width)] for _ in range(200)])
        entries = np.array([[rng.randint(-spread, spread) for _ in range(width)] for _ in range(15)])
        entries = np.concatenate([entries, entries[:1]])
        index, distance = nearest(points, entries)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(entries)) for p in points]
        assert [(int(d), int(i)) for i, d in zip(index, distance)] == want


@pytest.mark.parametrize("width", [16, 64, 21, 3])
def test_equals_loops(spark, width):
    rng = random.Random(width)
    rows = [(i // 2 if i % 7 else None, [rng.choice([rng.gauss(0, 0.2), 0.5, -0.25]) for _ in range(width - i % 3)]) for i in range(150)]
    df = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, k int").repartition(3)
    got, books = compress(df)
    codes, errors, want = plain(rows)
    assert {r.k: (r.code, r.error) for r in got.collect()} == {k: (c, e) for k, (c, e) in enumerate(zip(codes, errors))}
    assert [b.tolist() for b in books] == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8), (1, [0.5] * 8), (2, [1e308] + [0.0] * 7), (3, [-3e5] * 8), (4, []), (None, [0.25] * 8)]
    bad = [(5, None), (6, [nan] * 8), (7, [inf] + [0.0] * 7), (8, [None] * 8)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + bad], "vec_id long, embedding array<double>, code string, `a.b` string")
    got, books = compress(df)
    codes, errors, want = plain(rows)
    assert sorted((str(r.vec_id), r._code, r.error, r.code) for r in got.collect()) == sorted((str(i), c, e, "x") for (i, _), c, e in zip(rows, codes, errors))
    assert [b.tolist() for b in books] == want
    none, empty = compress(df.where("vec_id > 4"))
    assert none.collect() == [] and fit_codebooks(df.limit(0))[1] == 0 and len(empty) == 8


def equal_to_sql(spark, files, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{files}'")
    rel = con.sql(ORACLE["op11_vector_codes"])
    got = op11_vector_codes(spark, folder).select(*rel.columns)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_sql_on_odd_rows(spark, tmp_path):
    rows = [(i % 30, [((i * 7 + j * 3) % 11 - 5) / 16 for j in range(19)], None if i % 4 == 0 else i % 3) for i in range(60)]
    rows += [(99, None, 1), (98, [float("inf")], 1), (97, [None], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    equal_to_sql(spark, f"{tmp_path}/embeddings.parquet/*.parquet", f"file://{tmp_path}")


def test_query_equals_sql(spark):
    equal_to_sql(spark, "/root/testdata/sf0.001/embeddings.parquet", "/root/testdata/sf0.001")


def test_codebook_digest(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect() if r.embedding]
    books = plain(rows)[2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in op11_vector_codes(spark, "/root/testdata/sf0.001").collect()} == {digest}


def test_jobs_do_not_grow_with_shuffle_partitions(spark):
    df = spark.createDataFrame([(i, [math.sin(i * j) for j in range(16)]) for i in range(60)], "vec_id long, embedding array<double>").repartition(3)
    confs = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {c: spark.conf.get(c) for c in confs}

    def fitted(partitions):
        group = f"codes of {partitions}"
        spark.conf.set(confs[0], partitions)
        spark.sparkContext.setJobGroup(group, group)
        books, _ = fit_codebooks(df)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), [b.tolist() for b in books]

    try:
        spark.conf.set(confs[1], "false")
        few, many = fitted(2), fitted(60)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert few == many and 0 < few[0] < 60
