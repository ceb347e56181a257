"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on samples of toxic and one on samples of ordinary text.
Both are laid behind one shared stretch of trained ordinary text, so that what the classes have in
common costs the same under either, and are used as raw content, so that no entropy tables differ.
Most of a toxic document is ordinary; the toxic samples are therefore the words of toxic text with
7-byte grams that stand in more different surroundings there, for the amount of text, than in
ordinary text; the ordinary samples are as many stretches of the same mean length from anywhere.

Every window of a text is compressed with either dictionary; a window that toxic text explains
better comes out shorter with the toxic one. The differences of a text's windows are summed up in
four figures, and a logistic model, fitted on labelled rows that the dictionaries haven't seen, turns
them into a score whose 0.7 is the threshold with the best F1 there. Labels, language, source and
doc_id are no inputs of a score.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import give_back, slices, table, unused

SAMPLE = {1: 2500, 0: 7500}
"""Most labelled rows of each class that the classifier is fitted on."""
SAMPLE_CHARS = 8_000
"""Longer texts are left out of that sample (not out of the scoring)."""
WINDOW, STEP = 64, 32
WINDOWS_AT_ONCE = 100_000
FOLDS = 3
GRAM, AROUND, SPREAD = 7, 6, 8
LEAST, RATIO, BOUND = 5, 4, 1.5
SHARED, OWN, OWN_PER_GRAM, SEGMENT, SHORT = 24_000, (512, 2048), 5, 40, 16
THRESHOLD = 0.7

U = np.uint64


def lowered(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "replace") + b" "


def _joined(texts: list[bytes], size: int = 1_000_000) -> Iterator[bytes]:
    """The texts, AROUND spaces about each, in buffers of about ``size`` bytes."""
    gap, held, n = b" " * AROUND, [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield gap + gap.join(held) + gap
            held, n = [], 0
    if held:
        yield gap + gap.join(held) + gap


def _grams(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as numbers, gram at each place that has AROUND bytes on either side)."""
    b = np.frombuffer(buffer, np.uint8).astype(U)
    n = len(b) - 2 * AROUND - GRAM + 1
    g = np.zeros(max(0, n), U)
    for k in range(GRAM if n > 0 else 0):
        g = (g << U(8)) | b[AROUND + k : AROUND + k + n]
    return b, g


def _among(g: np.ndarray, only: np.ndarray) -> np.ndarray:
    """Places of ``g`` whose value stands in the sorted ``only``."""
    if not len(only):
        return np.empty(0, np.int64)
    sieve = np.zeros(1 << 20, bool)
    sieve[(only * U(0x9E3779B97F4A7C15)) >> U(44)] = True
    at = np.flatnonzero(sieve[(g * U(0x9E3779B97F4A7C15)) >> U(44)])
    i = np.minimum(np.searchsorted(only, g[at]), len(only) - 1)
    return at[only[i] == g[at]]


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted different values, how often each stands)."""
    a = np.sort(a)
    at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    return a[at], np.diff(np.r_[at, len(a)])


def _surroundings(texts: list[bytes], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Grams (sorted; those in ``only``, if given) and in about how many different surroundings each stands.

    Surroundings are told apart by 2**SPREAD hashes, so that copies count once; how many there are is estimated from
    how many hashes a gram fills.
    """
    pairs = np.empty(0, U)
    for buffer in _joined(texts):
        b, g = _grams(buffer)
        hit = np.arange(len(g)) if only is None else _among(g, only)
        h = np.zeros(len(hit), U)
        for k in (*range(AROUND), *range(AROUND + GRAM, 2 * AROUND + GRAM)):
            h = h * U(0x100000001B3) ^ b[hit + k]
        h = (h * U(0x9E3779B97F4A7C15)) >> U(64 - SPREAD)
        pairs = _distinct(np.concatenate([pairs, (g[hit] << U(SPREAD)) | h]))[0]
    slots = float(1 << SPREAD)
    names, filled = _distinct(pairs >> U(SPREAD))
    return names, -slots * np.log1p(-np.minimum(filled, slots - 0.5) / slots)


def _at(names: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of ``names`` in (sorted names, counts), 0 where missing."""
    out = np.zeros(len(names))
    if len(found[0]):
        i = np.minimum(np.searchsorted(found[0], names), len(found[0]) - 1)
        same = found[0][i] == names
        out[same] = found[1][i][same]
    return out


def _stretches(texts: list[bytes], telling: np.ndarray) -> list[bytes]:
    """The stretches of the texts that telling grams cover, widened to whole words (by 12 bytes at most)."""
    out = []
    for buffer in _joined(texts):
        b, g = _grams(buffer)
        hit = _among(g, telling)
        if not len(hit):
            continue
        cut, spaces = np.flatnonzero(np.diff(hit) > 1) + 1, np.flatnonzero(b <= 32)
        start, end = hit[np.r_[0, cut]] + AROUND, hit[np.r_[cut - 1, -1]] + AROUND + GRAM
        start = np.maximum(start - 12, spaces[np.searchsorted(spaces, start, "right") - 1])
        end = np.minimum(end + 12, spaces[np.searchsorted(spaces, end - 1)] + 1)
        out += [buffer[x:y] for x, y in zip(start.tolist(), end.tolist())]
    return out


def _trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """Content of a dictionary of at most ``size`` bytes, trained on ``samples``; where they are too few to train on, the
    samples themselves."""
    try:
        made = zstd.train_dictionary(size, samples, k=segment, d=6, f=20, accel=1).as_bytes()
        return made[-max(1, len(made) - 300) :]  # what follows the entropy tables
    except zstd.ZstdError:
        return b" ".join(samples)[-size:]


def _cut_up(texts: list[bytes], n: int, length: int, rng: np.random.Generator) -> list[bytes]:
    """``n`` stretches of ``length`` bytes from anywhere in the texts."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    places = rng.integers(0, int(ends[-1]), n)
    which = np.searchsorted(ends, places, "right")
    return [texts[i][max(0, min(p, len(texts[i]) - length)) :][:length] for i, p in zip(which.tolist(), (places - (ends - sizes)[which]).tolist())]


def _dictionaries(toxic: list[bytes], plain: list[bytes], counted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[bytes, bytes] | None:
    """Contents of the ordinary and the toxic dictionary; ``counted`` holds grams and their surroundings in either class."""
    lt, lp = sum(map(len, toxic)), sum(map(len, plain))
    if not lt or not lp:
        return None
    grams, times, other = counted
    # lower bound of the rate in toxic text against the upper bound of the rate in ordinary text
    ratio = ((times - BOUND * np.sqrt(times)) / lt) / ((other + BOUND * np.sqrt(other + 1) + 1) / lp)
    telling = grams[(times >= LEAST) & (ratio > RATIO)]
    samples = _stretches(toxic, telling)
    if not samples:
        return None
    rng = np.random.default_rng(0)
    length = max(8, sum(map(len, samples)) // len(samples))
    shared = _trained(SHARED, _cut_up(plain, 60_000, WINDOW, rng), SEGMENT)
    size = min(OWN[1], max(OWN[0], OWN_PER_GRAM * len(telling)))
    own_plain = _trained(size, _cut_up(plain, len(samples), length, rng), SHORT)
    own_toxic = _trained(size, samples, SHORT)
    size = min(len(own_plain), len(own_toxic))
    return shared + own_plain[-size:], shared + own_toxic[-size:]


class Windows:
    """Window compression lengths under two dictionaries."""

    def __init__(self, contents: tuple[bytes, bytes]):
        parameters = zstd.ZstdCompressionParameters(
            window_log=15, strategy=zstd.STRATEGY_LAZY2, min_match=4, hash_log=15, chain_log=15, search_log=5, target_length=32,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS,
        )
        self.both = [
            zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=parameters)
            for c in contents
        ]

    def differences(self, buffer: bytes, segments: np.ndarray) -> np.ndarray:
        """Ordinary less toxic length of each window (start, length) of the buffer."""
        held = zstd.BufferWithSegments(buffer, segments.tobytes())
        plain, toxic = [np.fromiter(map(len, c.multi_compress_to_buffer(held, threads=1)), np.int32, len(segments)) for c in self.both]
        return plain - toxic

    def figures(self, texts: list[bytes]) -> np.ndarray:
        """Per text: largest difference, sums of differences above 2 and above 4 by window, log of the number of windows."""
        if not texts:
            return np.empty((0, 4))
        sizes = np.array([len(t) for t in texts])
        counts = np.maximum(1, -(-(sizes - WINDOW) // STEP) + 1)
        starts = np.cumsum(sizes) - sizes
        first = np.cumsum(counts) - counts
        buffer, n = b"".join(texts), int(counts.sum())
        d = np.empty(n, np.int32)
        for a in range(0, n, WINDOWS_AT_ONCE):
            at = np.arange(a, min(n, a + WINDOWS_AT_ONCE))
            of = np.searchsorted(first, at, "right") - 1
            segments = np.empty((len(at), 2), "<u8")
            segments[:, 0] = starts[of] + (at - first[of]) * STEP
            segments[:, 1] = np.minimum((starts + sizes)[of] - segments[:, 0].astype(np.int64), WINDOW)
            d[at] = self.differences(buffer, segments)
        total = counts + 20.0
        return np.stack(
            [np.maximum.reduceat(d, first) / 8.0, np.add.reduceat(np.maximum(d - 2, 0), first) / total * 10, np.add.reduceat(np.maximum(d - 4, 0), first) / total * 10, np.log(total)],
            axis=1,
        )


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last one constant) by Newton steps with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 0.1
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
    return w


def fit(texts: list[str], toxic: list[int]) -> tuple[tuple[bytes, bytes], np.ndarray] | None:
    """Dictionaries and weights from labelled texts, in any order; None if a class is missing.

    Each different text counts once; it is toxic if any of its rows is.
    """
    known: dict[str, int] = {}
    for t, y in zip(texts, toxic):
        known[t] = max(y, known.get(t, 0))
    rows = [(lowered(t), y, zlib.crc32(t.encode("utf-8", "replace")) % FOLDS) for t, y in sorted(known.items())]
    of = lambda y, folds: [t for t, z, p in rows if z == y and p in folds]
    counts = [_surroundings(of(1, [f])) for f in range(FOLDS)]
    names = _distinct(np.concatenate([c[0] for c in counts]))[0]
    times = np.stack([_at(names, c) for c in counts])
    names, times = names[times.sum(axis=0) >= 4], times[:, times.sum(axis=0) >= 4]
    other = np.stack([_at(names, _surroundings(of(0, [f]), names)) for f in range(FOLDS)])

    def made(folds: list[int]) -> tuple[bytes, bytes] | None:
        return _dictionaries(of(1, folds), of(0, folds), (names, times[folds].sum(axis=0), other[folds].sum(axis=0)))

    contents, figures, seen = made(list(range(FOLDS))), [], []
    for fold in range(FOLDS):  # the weights come from texts that the dictionaries haven't seen
        part = made([f for f in range(FOLDS) if f != fold])
        keep = [(t, y) for t, y, p in rows if p == fold]
        if part and keep:
            figures.append(Windows(part).figures([t for t, _ in keep]))
            seen += [y for _, y in keep]
    if contents is None or len(set(seen)) < 2:
        return None
    y, x = np.array(seen, float), np.concatenate(figures)
    w = _logistic(x, y)
    z = np.c_[x, np.ones(len(y))] @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    cut = (z[order][best] + z[order][min(best + 1, len(z) - 1)]) / 2
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return contents, w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> bytes:
    """The model, pickled: fitted in one task on at most SAMPLE rows of each class, none of them held out. An id counts
    once, with the least of its texts, however many rows it has."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    picked = None
    for y, n in SAMPLE.items():
        some = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.union(some)
    sample = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
        .join(F.broadcast(picked), "doc_id")  # at most sum(SAMPLE) rows of two numbers
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # one row an id, so at most sum(SAMPLE)
        .select("text", "toxic")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, toxic))], pa.binary())], names=["model"])
        give_back()

    fitted = sample.repartition(1).mapInArrow(run, "model binary").first()  # none where no labelled row was found
    return fitted["model"] if fitted else pickle.dumps(None)


def with_scores(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on), with underscores before these names where
    ``docs`` has such columns. Null texts count as empty. Without a model (no labelled rows of both classes) every score is 0."""
    names = [unused(docs, c) for c in ("score", "predicted")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    source = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(model)
        windows = Windows(fitted[0]) if fitted else None
        for part in slices(batches):
            score = np.zeros(part.num_rows)
            if windows:
                x = windows.figures([lowered(t) for t in part.column(1).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ fitted[1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["row", "score", "predicted"]
            )
        give_back()

    scored = source.mapInArrow(run, StructType([source.schema["row"], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
    return scored.select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("score").alias(names[0]), F.col("predicted").alias(names[1]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score and predicted.

    Null texts are scored as empty ones, a null doc_id isn't held out, repeated rows are all returned with one score.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def registered() -> dict:
    return {"op4_toxicity": op4_toxicity}
