"""Best-fit packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing places pieces from the longest to the shortest, each into the open sequence with
the least room that still holds it; a segment tree over the remaining capacities finds that room in
logarithmic time. Pieces of one length are interchangeable, and so are sequences with one remaining
capacity. So the plan is made from the histogram of lengths (at most ``size`` entries) with runs of
sequences, and equals the plan made piece by piece; each piece then finds its place in the plan by
its rank among the pieces of its length, which Spark computes in parallel.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, slices, table, written

MEMO = 100_000
RANK_BUCKETS = 256


class WordIds(dict):
    """Token ids (little-endian bytes) of a stretch of text without spaces, by the library's own model.

    The tokenizer drops white space, so the ids of a text are those of its stretches, joined. A
    stretch of plain Latin letters, with or without closing marks, is one or two units of the
    tokenizer's own splitting and goes to its BPE model directly; every other stretch goes through
    the whole tokenizer. At most 2 * MEMO stretches are remembered.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{1,64})([-.,;:!?#$%&*()_+=/~@\"]{0,8})")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))]
        self.bytewise = str.maketrans({c: bytewise.pre_tokenize_str(c)[0][0] for c in letters})
        self.one = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.marks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def slow(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, word: str) -> bytes:
        word = word.lower()
        found = self.model.tokenize(word if word.isascii() else word.translate(self.bytewise))
        return self.one[found[0].id] if len(found) == 1 else b"".join([self.one[t.id] for t in found])

    def mark(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self.slow(marks)
            if len(self.marks) < MEMO:
                self.marks[marks] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            m = self.PLAIN.fullmatch(word)
            if m is None:
                ids = self.slow(word) if word else b""
            elif m[2]:
                ids = self[m[1]] + self.mark(m[2])
            else:
                ids = self.plain(word)
        if len(word) <= 80:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0,
    derive: tuple[str, Callable[[bytes], object], pa.DataType] | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of every text and ``end_id``, cut after every ``size`` ids.

    ``derive`` = (column, function of the little-endian ids, Arrow type) replaces ``ids`` by a value
    made from them. Null texts count as empty: one piece with ``end_id`` alone.
    """
    column, value, kind = derive or ("ids", lambda b: np.frombuffer(b, "<u4").astype(np.int32), pa.list_(pa.int32()))
    closing = int(end_id).to_bytes(4, "little")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for part in slices(batches):
            rows = []
            for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = (words.ids(body) if body else b"") + closing
                for i, a in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[a : a + 4 * size]
                    rows.append((doc, i, a // 4, len(cut) // 4, value(cut)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind))],
                names=["doc_id", "piece", "start", "length", column],
            )
        del words
        give_back()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id long, piece int, start long, length long, {column} {kinds[kind]}")


class RoomTree:
    """Segment tree over remaining capacities 0..size that holds which of them have open sequences."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.any = [False] * (2 * self.n)

    def set(self, room: int, has: bool) -> None:
        i = room + self.n
        self.any[i] = has
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest capacity of at least ``least`` with an open sequence."""
        i = least + self.n
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces into sequences of ``size``.

    Returns records (length, first_rank, count, first_sequence, per_sequence, offset): piece number
    first_rank + r of that length lies in sequence first_sequence + r // per_sequence, at
    offset + (r % per_sequence) * length.
    """
    tree, rooms, opened, plan = RoomTree(size), defaultdict(list), 0, []

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            rooms[room].append((first, count))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            each = (room or size) // length
            if room is None:
                room, first, count = size, opened, -(-left // each)
                opened += count
            else:
                first, count = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            full = min(count, left // each)
            offset = size - room
            if full:
                plan.append((length, rank, full * each, first, each, offset))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count:
                if left:  # fewer than one sequence takes
                    plan.append((length, rank, left, first + full, each, offset))
                    put(room - left * length, first + full, 1)
                    full, rank, left = full + 1, rank + left, 0
                put(room, first + full, count - full)
    return plan


def ranked(pieces: DataFrame, by: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` plus ``rank``, a number from 0 without gaps in each value of ``by``.

    A value may hold most rows: its rows are dealt to RANK_BUCKETS windows, numbered there, and
    shifted by the rows in the buckets before (at most ``size`` * RANK_BUCKETS sums).
    """
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)).cast("int"))
    sums = dealt.groupBy(by, "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sums.select(F.col(by), "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order))
    return dealt.withColumn("own", own).join(shifts, [by, "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("own", "before", "bucket")


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) plus sequence_id and offset. Lengths must lie in 1..size.

    ``pieces`` is read twice and so should be a written table. Repeated rows are packed one by one.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    if any(not 0 < n <= size for n in counts):
        raise ValueError(f"piece lengths must lie in 1..{size}")
    plan = np.array(sorted(best_fit_plan(counts, size)) or np.empty((0, 6)), np.int64).reshape(-1, 6)
    lead = plan[:, 0] * (1 << 44) + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            p = plan[np.searchsorted(lead, length * (1 << 44) + rank, "right") - 1]
            r = rank - p[:, 1]
            keep = [i for i, c in enumerate(names) if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(p[:, 3] + r // p[:, 4]), pa.array(p[:, 5] + (r % p[:, 4]) * length)],
                names=[names[i] for i in keep] + ["sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{c}` {k}" for c, k in pieces.dtypes)
    return ranked(pieces).select(*pieces.columns, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` with their places. Null texts are empty ones (one piece, the end id); repeated rows are
    packed one by one; a null doc_id stays null."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def packed_documents(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text) packed into sequences of ``size`` ids; an empty table gives no rows."""
    pieces = written(token_pieces(docs, tokenizer, size=size, derive=("ids_crc32", zlib.crc32, pa.int64())))
    return pack(pieces, size)


def registered() -> dict:
    return {"op2_best_fit": op2_best_fit}
