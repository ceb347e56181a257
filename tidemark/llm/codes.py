"""Vector code compression: product codes by integer clustering of vector parts.

Components become integers, vectors are cut into equal parts, and each part gets the number of the nearest
entry of its own codebook. Parts and entries are padded with zeros to a power of two and carried over by
the Walsh-Hadamard transform, which multiplies every squared distance by that power: squared
differences are added up in sequency order, slow rows first, and an entry is left out as soon as its
sum exceeds the whole distance of another. All of it is integer arithmetic, so ties are exact.

A round is one pass over the vectors: tasks assign, and send one row of sums per entry they used. Only
codebooks (parts x entries x part length integers) live on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import small, table, unused, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
EXACT = 2**62
"""Integers are held in 64 bits while no sum can reach this, else as Python's integers."""
WIDEST = 2**62
"""Components count as at most this (and at least its negative)."""
LONG = 2**63 - 1
BATCH_VALUES = 1 << 20


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of ``size`` (a power of two) by their number of sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")


def transformed(parts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, zero-padded to ``len(order)``, in sequency order."""
    n, size = parts.shape[0], len(order)
    out = np.zeros((n, size), parts.dtype)
    out[:, : parts.shape[1]] = parts
    half = 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        low, high = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
        out = np.stack([low, high], axis=2).reshape(n, size)
        half *= 2
    return out[:, order]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, the lowest index on ties; distances are exact integers."""
    size = 1 << max(0, (points.shape[1] - 1).bit_length())
    order = sequency_order(size)
    widest = max([0] + [abs(int(v)) for a in (points, entries) if a.size for v in (a.max(), a.min())])
    kind = np.int64 if size * (2 * size * widest) ** 2 < EXACT else object
    p, c = transformed(points.astype(kind), order), transformed(entries.astype(kind), order)
    first = max(1, size // 4)
    total = np.zeros((len(p), len(c)), kind)
    for i in range(first):
        total += (p[:, i : i + 1] - c[:, i]) ** 2
    # the entry that the slow rows like best bounds all others by its whole distance
    guess = total.argmin(axis=1)
    bound = ((p - c[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(total <= bound[:, None])
    held = total[row, entry]
    for i in range(first, size):
        held = held + (p[row, i] - c[entry, i]) ** 2
        stay = held <= bound[row]
        row, entry, held = row[stay], entry[stay], held[stay]
    by = np.lexsort((entry, held, row)) if kind is np.int64 else np.array(sorted(range(len(row)), key=lambda j: (row[j], held[j], entry[j])), dtype=int)
    best = by[np.r_[True, np.diff(row[by]) != 0]] if len(by) else by
    return entry[best], held[best] // size


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale x), one row a vector, missing trailing components 0; Python's integers where 64 bits are too few for sums."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values, out = pc.list_flatten(column).to_numpy(zero_copy_only=False), np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    with np.errstate(over="ignore"):
        out = np.floor(out * scale)
    if np.abs(out).max(initial=0) < 2**40:
        return out.astype(np.int64)
    return np.vectorize(lambda x: int(min(max(x, -WIDEST), WIDEST)), otypes=[object])(out)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BATCH_VALUES // max(width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def assigned(vectors: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, the vectors' components of it, entry of each, squared distance of each)."""
    at = 0
    for part, entries in enumerate(books):
        own = vectors[:, at : at + entries.shape[1]]
        at += entries.shape[1]
        yield part, own, *nearest(own, entries)


def sums(batches: Iterator[pa.RecordBatch], width: int, books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per entry that the task used: how many parts it got and the sums of their components."""
    total: dict[tuple[int, int], list] = {}
    for batch in blocks(batches, width):
        for part, own, entry, _ in assigned(integers(batch.column(0), width), books):
            for e in np.unique(entry):
                chosen = own[entry == e]
                held = total.setdefault((part, int(e)), [0, [0] * own.shape[1]])
                held[0] += len(chosen)
                held[1] = [a + int(b) for a, b in zip(held[1], chosen.sum(axis=0))]
    keys = sorted(total)
    columns = [
        pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()),
        pa.array([[Decimal(x) for x in total[k][1]] for k in keys], pa.list_(pa.decimal128(38, 0))),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])


def encoded(batches: Iterator[pa.RecordBatch], width: int, books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Codes and errors; column 0 is the vector, column 1 the row it belongs to."""
    for batch in blocks(batches, width):
        entries, errors = [], None
        for _, _, entry, distance in assigned(integers(batch.column(0), width), books):
            entries.append(entry)
            errors = distance.astype(object) if errors is None else errors + distance
        digits = [f"{i:02x}" for i in range(256)]
        codes = ["".join([digits[i] for i in row]) for row in np.stack(entries, axis=1).tolist()]
        columns = [batch.column(1), pa.array(codes, pa.string()), pa.array([min(int(e), LONG) for e in errors], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "code", "error"])


def usable(vector: str):
    """Vectors that aren't null and hold no null or non-finite component."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def fit_codebooks(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[list[np.ndarray], int]:
    """(codebooks by part, width). Every entry starts as that part of one of the ``entries`` smallest ids.

    Ids that tie are taken by their vectors, null ids last; with fewer vectors there are fewer entries. The width is that of the
    longest vector, shorter ones are filled up with zeros; if ``parts`` doesn't divide it, so is every vector.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(usable("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    length = -(-(longest or 0) // parts)
    width = length * parts
    start = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()  # at most ``entries`` rows
    points = integers(start.column("v").combine_chunks(), width) if start.num_rows else np.zeros((0, width), np.int64)
    books = [points[:, p * length : (p + 1) * length] for p in range(parts)]
    for _ in range(rounds if start.num_rows else 0):
        held = books
        found = kept.select("v").mapInArrow(lambda rows: sums(rows, width, held), "part int, entry int, n long, sums array<decimal(38,0)>")
        found = found.select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "s")).groupBy("part", "entry", "place")
        books = [b.copy() for b in held]
        # parts x entries x part length rows, by one job (an iterator takes one a shuffle partition)
        for r in found.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            if r.place is not None:
                books[r.part][r.entry, r.place] = int(r.s) // r.n
    return books, width


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): the usable rows of ``vectors`` without the vector, with new columns code and error.

    Null vectors and those with null or non-finite components are dropped; repeated rows and rows without id are coded
    like others; components beyond +-2^62 after scaling count as that, errors beyond 64 bits as the largest long. An empty
    table gives no rows and empty codebooks. New columns take underscores where ``vectors`` has such columns.
    """
    books, width = fit_codebooks(vectors, id_col, vector, parts, entries, rounds)
    rest = [c for c in vectors.columns if c != vector]
    code, error = (unused(vectors, c) for c in ("code", "error"))
    held = F.struct(*[F.col(f"`{c}`") for c in rest])
    source = vectors.where(usable(f"`{vector}`")).select(F.col(f"`{vector}`").cast("array<double>").alias("v"), held.alias("row"))
    schema = StructType([source.schema["row"], StructField("code", StringType()), StructField("error", LongType())])
    coded = source.mapInArrow(lambda rows: encoded(rows, width, books), schema)
    return coded.select(*[F.col(f"row.`{c}`") for c in rest], F.col("code").alias(code), F.col("error").alias(error)), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all usable embeddings, the errors of their labels, the digest of the codebooks.

    Odd vectors as in ``compress``; null labels are one label; sums beyond 64 bits count as the largest long.
    """
    rows, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join([str(x) for book in books for entry in book.tolist() for x in entry]).encode()).hexdigest()
    coded = written(rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(small(labels), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _oracle() -> str:
    distance = "CAST(list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    text = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rn, vec_id, label, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
n AS (SELECT CAST(ceil(max(len(v)) / {PARTS}) AS BIGINT) AS w FROM e),
p AS MATERIALIZED (SELECT rn, part, list_transform(range(1, w + 1), lambda i: coalesce(v[part * w + i], 0)) AS x FROM e, n, range({PARTS}) AS t(part)),
c0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x AS y FROM p WHERE rn <= {ENTRIES})"""
    for r in range(ROUNDS + 1):
        text += f""",
a{r} AS MATERIALIZED (SELECT rn, part, min({{'d': d, 'entry': entry}}) AS b
  FROM (SELECT p.rn, p.part, c.entry, {distance} AS d FROM p JOIN c{r} AS c ON p.part = c.part) GROUP BY rn, part)"""
        if r < ROUNDS:
            text += f""",
s{r} AS MATERIALIZED (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS y
  FROM (SELECT p.part, b.entry AS entry, place, sum(x[place]) AS s, count(*) AS n
        FROM p JOIN a{r} AS a ON p.rn = a.rn AND p.part = a.part, n, range(1, w + 1) AS t(place) GROUP BY p.part, b.entry, place) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(s.y, c.y) AS y FROM c{r} AS c LEFT JOIN s{r} AS s ON c.part = s.part AND c.entry = s.entry)"""
    return text + f""",
f AS (SELECT rn, string_agg(printf('%02x', b.entry), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rn),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN f USING (rn), h"""


ORACLE = {"op11_vector_codes": _oracle()}


def registered() -> dict:
    return {"op11_vector_codes": op11_vector_codes}
