"""N-gram Jaccard join by parity sketches.

Every distinct shingle of a text flips one bit of a long sparse bit sketch, so the Hamming distance
of two sketches is at most the symmetric difference of their sets. The sketch of a size band is cut
into P segments, a third more than the largest difference D of a pair whose smaller set lies in the
band; a pair that differs by d agrees in at least P - d segments. Segments are kept as a hash that is
XORed together from one random word per set bit. Of its P segments a set emits only as many as its
own largest difference from any partner in that band, and one more: those that carry most bits (ties
by hash). By the prefix argument two sets that agree in P - d segments share one of the d + 1 first
of either, and both emit as many at least. Nearly empty segments are never emitted. A set emits for
the band of its size and for those below that can hold a smaller partner.

Sets that meet are verified exactly. Nothing is capped: in each meeting one set is tried
with all others; meetings that this leaves unlinked are dealt to groups of about BLOCK sets a side,
compared there by dense sketches and verified, until no unverified pair of different components is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, give_back, slices, small, table, written

U = np.uint64
KEYS_PER_TASK = 1_000_000
KEY_BYTES = 5
MEMO = 150_000
BLOCK = 1000
STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hash by word, for at most MEMO words at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], words: WordHashes, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted distinct hashes of each text's n-word shingles one after another, and their numbers.

    A-Z are lower-cased; a text with fewer than n words has one shingle, its whole sequence.
    """
    found = [t.encode("utf-8", "replace").lower().split() if t else [] for t in texts]
    sizes = [len(w) for w in found]
    flat = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), U, sum(sizes))
    rolled = np.full(max(0, len(flat) - n + 1), n, U)
    for i in range(n if len(rolled) else 0):
        rolled = rolled * STEP + flat[i : len(flat) - n + 1 + i]
    rolled = mix(rolled)
    out, at = [], 0
    for size in sizes:
        if size >= n:
            v = np.sort(rolled[at : at + size - n + 1])
            out.append(v[np.r_[True, v[1:] != v[:-1]]] if len(v) > 1 else v)
        elif size:
            h = np.array([size], U)
            for w in flat[at : at + size]:
                h = h * STEP + w
            out.append(mix(h))
        else:
            out.append(np.empty(0, U))
        at += size
    return (np.concatenate(out) if out else np.empty(0, U)), np.array([len(v) for v in out], np.int64)


def digests(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit words that stand for each set."""
    out = np.zeros((len(counts), 2), U)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        out[full, 0] = np.bitwise_xor.reduceat(mix(s + U(1)), starts)
        out[full, 1] = np.add.reduceat(mix(s ^ U(0x5851F42D4C957F2D)), starts) + counts[full].astype(U)
    return mix(out).view(np.int64)


def most_apart(a: int, b: int, num: int, den: int) -> int:
    """Largest symmetric difference of sets of sizes a and b whose Jaccard similarity is at least num / den."""
    return (a + b) * (den - num) // (den + num)


def segments(band: int, num: int, den: int) -> int:
    """Number of segments in a band, whose smaller sets have 2**band to 2**(band + 1) - 1 shingles."""
    most = (2 << band) - 1
    d = most_apart(most, most * den // num, num, den)
    return d + d // 3 + 2


def tables(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, D) for which a set of size n emits segments: its own band, and each below with possible partners."""
    own = n.bit_length() - 1
    out = [(own, most_apart(n, n * den // num, num, den))]
    for band in range(own - 1, -1, -1):
        largest = (2 << band) - 1
        if largest * den < n * num:
            break
        out.append((band, most_apart(n, largest, num, den)))
    return out


def segment_keys(s: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner): the keys that sets emit over all their bands, and the number of the set of each."""
    known: dict[int, list[tuple[int, int]]] = {}
    plan = [(i, t, d) for i, c in enumerate(counts.tolist()) if c for t, d in known.get(c) or known.setdefault(c, tables(c, num, den))]
    if not plan:
        return np.empty(0, U), np.empty(0, np.int64)
    starts = np.cumsum(counts) - counts
    keys = []
    doc, band, d = np.array(plan, np.int64).T
    n = counts[doc]
    p = np.array([segments(t, num, den) for t in range(int(band.max()) + 1)])[band]
    base = np.cumsum(p) - p
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    salt = mix(band.astype(U) + U(1))
    x = mix(s[np.repeat(starts[doc], n) + within] ^ np.repeat(salt, n))
    segment = np.repeat(base, n) + ((x >> U(32)) * np.repeat(p.astype(U), n) >> U(32)).astype(np.int64)
    parity = np.zeros(int(p.sum()), U)
    np.bitwise_xor.at(parity, segment, mix(x ^ U(0xD6E8FEB86659FD93)))
    bits = np.bincount(segment, minlength=len(parity))
    number = np.arange(len(parity)) - np.repeat(base, p)
    key = mix(parity + number.astype(U) * STEP + np.repeat(salt, p))
    # the order of emission: segments with most bits first, then by hash
    key = ((255 - np.minimum(bits, 255)).astype(U) << U(56)) | (key >> U(8))
    for b, width, limit in zip(base.tolist(), p.tolist(), d.tolist()):
        keys.append(np.sort(key[b : b + width])[: limit + 1])
    return mix(np.concatenate(keys)), np.repeat(doc, d + 1)


def dense_sketch(s: np.ndarray, n: int) -> bytes:
    """Parity sketch of bit length 2**k >= 2 n; every shingle flips one bit."""
    size = dense_bits(n)
    odd = np.bincount((mix(s ^ U(0xA0761D6478BD642F)) % U(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def dense_bits(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length())


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """Shorten a sketch: bits that meet are XORed, so it is still a parity sketch."""
    while len(sketch) * 8 > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def set_digests(docs: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, t1, t2) per row; h1 and h2 stand for the shingle set, t1 and t2 for the text of a row
    without id (else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches):
            s, counts = shingle_sets(_texts(batch), words, n)
            h = digests(s, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column(2), batch.column(3)],
                names=["doc_id", "n_shingles", "h1", "h2", "t1", "t2"],
            )
        del words
        give_back()

    nameless = [F.when(F.col(id_col).isNull(), h) for h in text_digest(F.col(text))]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), nameless[0].alias("t1"), nameless[1].alias("t2"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, t1 long, t2 long")


def text_digest(text: Column) -> list[Column]:
    """128 bits of a text, null as an empty one."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body), F.xxhash64(F.lit(17), body)]


def _packed(k: np.ndarray) -> bytes:
    """The KEY_BYTES low bytes of each key, which tell the keys of one part apart well enough to find meetings."""
    return k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def _key_blobs(docs: DataFrame, text: str, n: int, num: int, den: int, parts: int) -> DataFrame:
    """(part, keys, sets): blobs of the keys of each part with the h1 of the set that emitted them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            k, i = np.concatenate(keys), np.concatenate(ids)
            part = ((k >> U(8 * KEY_BYTES)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            k, i, part = k[order], i[order], part[order]
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[at[1:], len(part)]
            return pa.RecordBatch.from_arrays(
                [pa.array(part[at], pa.int64()), pa.array([_packed(k[a:b]) for a, b in zip(at, ends)], pa.binary()), pa.array([i[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())],
                names=["part", "keys", "sets"],
            )

        for batch in slices(batches):
            s, counts = shingle_sets(_texts(batch), words, n)
            h = digests(s, counts)
            new = np.zeros(len(counts), bool)
            for i, pair in enumerate(map(tuple, h.tolist())):  # copies within this task's rows are met once
                new[i] = counts[i] > 0 and pair not in seen
                seen.add(pair)
            k, owner = segment_keys(s[np.repeat(new, counts)], counts[new], num, den)
            keys.append(k)
            ids.append(h[new, 0][owner])
            held += len(k)
            if held >= 500_000:
                yield flush()
                keys, ids, held = [], [], 0
        if held:
            yield flush()
        del words
        give_back()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "part long, keys binary, sets binary")


def _meetings(blobs: DataFrame) -> DataFrame:
    """(key, h1) of the keys that two sets at least emitted. A part holds about KEYS_PER_TASK keys."""

    def run(pieces: pa.Table) -> pa.Table:
        k = np.concatenate([_unpacked(b) for b in pieces.column("keys").to_pylist()])
        i = np.concatenate([np.frombuffer(b, np.int64) for b in pieces.column("sets").to_pylist()])
        order = np.argsort(k, kind="stable")
        k, i = k[order], i[order]
        same = k[1:] == k[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        k, i = k[keep], i[keep]
        order = np.lexsort((i, k))
        k, i = k[order], i[order]
        first = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])][: len(k)]
        k, i = k[first], i[first]
        same = k[1:] == k[:-1]
        keep = (np.r_[same, False] | np.r_[False, same])[: len(k)]
        k, i = k[keep], i[keep]
        if len(k):  # meetings of the same sets say the same: keep one key for each list of sets
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            lists = np.add.reduceat(mix(i.view(U)), at) + np.diff(np.r_[at, len(k)]).astype(U)
            _, pick = np.unique(lists, return_index=True)
            chosen = np.zeros(len(at), bool)
            chosen[pick] = True
            keep = np.repeat(chosen, np.diff(np.r_[at, len(k)]))
            name = np.repeat(lists, np.diff(np.r_[at, len(k)]))
            k, i = name[keep], i[keep]
        give_back()
        return pa.table({"key": pa.array(k.view(np.int64)), "h1": pa.array(i)})

    return blobs.groupBy("part").applyInArrow(run, "key long, h1 long").distinct()


def _candidate_sets(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(h1, n, items, sketch) of the given rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches):
            s, counts = shingle_sets(_texts(batch), words, n)
            each = np.split(s, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests(s, counts)[:, 0].copy()),
                    pa.array(counts),
                    pa.array([v.view(np.int64) for v in each], pa.list_(pa.int64())),
                    pa.array([dense_sketch(v, len(v)) for v in each], pa.binary()),
                ],
                names=["h1", "n", "items", "sketch"],
            )

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "h1 long, n long, items array<long>, sketch binary")


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the dense sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*[batch.column(i).to_pylist() for i in range(2, 6)]):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y)) * 8
                far = np.bitwise_count(fold(x, size) ^ fold(y, size)).sum(dtype=np.int64)
                keep.append(far <= most_apart(na, nb, num, den) and min(na, nb) * den >= num * max(na, nb))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = _both_sides(pairs, sets, "sketch").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _both_sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs`` plus n and ``column`` of either set. Only the values of sets in ``pairs`` are shuffled, if the pairs are few."""
    own = small(pairs)
    side = lambda x: own.join(sets.select(F.col("h1").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"{column}_{x}")), x)
    return side("a").join(side("b"), ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) by exact intersection."""
    common = F.size(F.array_intersect("items_a", "items_b"))
    pairs = written(pairs)
    both = _both_sides(pairs, sets, "items")
    out = written(both.select("a", "b", (den * common >= num * (F.col("n_a") + F.col("n_b") - common)).alias("linked")).distinct())
    discard(pairs)
    return out


def _dealt(met: DataFrame, nodes: DataFrame, block: int, inside: bool = False) -> tuple[DataFrame, DataFrame]:
    """(groups, members): the sets of each meeting that still holds two components, dealt to groups (key, x, y).

    A meeting of at most ``block`` sets is one group (0, 0). In a larger one the sets outside the largest
    component make up blocks 0, 1, ..., the others the blocks after these, of about ``block`` sets each by
    their hash. Group (x, y) holds two blocks, of which x is an outside one; so every pair of different
    components is in exactly one group. With ``inside`` there are only the groups (x, x) of larger meetings.
    """
    own = met.join(nodes, "h1")
    by_comp = own.groupBy("key", "comp").agg(F.count("*").alias("c"))
    stat = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("sets"), F.max(F.struct("c", "comp")).alias("top"))
    large = F.col("sets") > block
    pieces = lambda n: F.ceil(n / F.lit(block)).cast("int")
    stat = written(
        stat.where(F.col("comps") > 1 if not inside else (F.col("comps") > 1) & large).select(
            "key",
            F.when(large, F.col("top.comp")).alias("main"),
            F.when(large, pieces(F.col("sets") - F.col("top.c"))).otherwise(1).alias("outer"),
            F.when(large, pieces(F.col("top.c"))).otherwise(0).alias("inner"),
        )
    )
    at = lambda n: F.pmod(F.xxhash64("h1"), n).cast("int")
    in_main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    members = own.join(small(stat), "key").withColumn("block", F.when(in_main, F.col("outer") + at(F.greatest("inner", F.lit(1)))).otherwise(at(F.col("outer"))))
    outside = F.col("block") < F.col("outer")
    if inside:
        groups = members.where(outside).withColumn("with", F.col("block"))
    else:
        groups = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1))))
    pair = [F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y")]
    return groups.select("key", *pair, "block", "h1", "comp"), members.select("key", "block", "h1", "comp")


def _unlinked_pairs(met: DataFrame, nodes: DataFrame, sets: DataFrame, tried: DataFrame, num: int, den: int, all_pairs: bool = False, inside: bool = False) -> DataFrame:
    """(key, a, b) as _unlinked finds them in the groups of _dealt. Pairs that failed are sent to the one group that would find them."""
    groups, members = _dealt(met, nodes, BLOCK, inside)
    side = lambda x: members.select("key", F.col("h1").alias(x), F.col("block").alias(f"block_{x}"), F.col("comp").alias(f"comp_{x}"))
    fails = small(tried.where("NOT linked").select("a", "b"))
    known = fails.join(side("a"), "a").join(side("b"), ["key", "b"]).where("comp_a <> comp_b" + (" AND block_a = block_b" if inside else ""))
    known = known.select("key", F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y"), F.col("a").alias("h1"), F.col("b").alias("failed"))
    rows = groups.join(sets.select("h1", "n", "sketch"), "h1").unionByName(known, allowMissingColumns=True)
    return rows.groupBy("key", "x", "y").applyInArrow(_unlinked(num, den, all_pairs), "key long, a long, b long")


def _unlinked(num: int, den: int, all_pairs: bool = False):
    """For the sets of one group of _dealt: pairs of different components that dense sketches can't rule out.

    The pairs hold a spanning forest of all such pairs over the components, so that a group is done
    once they are verified, unless one of them fails. With ``all_pairs`` they are all such pairs that
    haven't failed before, for meetings where one did. Rows with ``failed`` name a pair that did.
    """

    def run(rows: pa.Table) -> pa.Table:
        known = rows.filter(pc.is_valid(rows.column("failed")))
        rows = rows.filter(pc.is_null(rows.column("failed")))
        if len(pc.unique(rows.column("comp"))) < 2:
            return pa.table({c: pa.array([], pa.int64()) for c in ("key", "a", "b")})
        failed = set(zip(known.column("h1").to_pylist(), known.column("failed").to_pylist()))
        h = rows.column("h1").to_numpy()
        n = rows.column("n").to_numpy()
        raw = [np.frombuffer(b, np.uint8) for b in rows.column("sketch").to_pylist()]
        size = min(len(r) for r in raw) * 8
        sk = np.stack([fold(r, size) for r in raw])
        _, label = np.unique(rows.column("comp").to_numpy(), return_inverse=True)
        start = label.copy()
        key, x, y = (rows.column(c)[0].as_py() for c in ("key", "x", "y"))
        if x != y:  # pairs within a block are another group's
            outside = np.flatnonzero(rows.column("block").to_numpy() == x)
        else:  # every pair of different components has a member outside the largest one
            outside = np.flatnonzero(label != np.bincount(label).argmax())
        rank = np.full(len(h), len(h))
        rank[outside] = np.arange(len(outside)) if x == y else -1
        out = []
        for r, i in enumerate(outside):
            j = np.flatnonzero((start != start[i]) & (rank > r) & (all_pairs | (label != label[i])))
            j = j[np.minimum(n[i], n[j]) * den >= num * np.maximum(n[i], n[j])]
            if not len(j):
                continue
            far = np.bitwise_count(sk[j] ^ sk[i]).sum(axis=1, dtype=np.int64)
            for k in j[far <= (n[i] + n[j]) * (den - num) // (den + num)]:
                a, b = sorted((int(h[i]), int(h[k])))
                if (all_pairs or label[i] != label[k]) and (a, b) not in failed:
                    if not all_pairs:
                        label[label == label[k]] = label[i]
                    out.append((a, b))
        return pa.table(
            {"key": pa.array([key] * len(out), pa.int64()), "a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())}
        )

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5, nameless: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links).

    Texts link when their sets of distinct n-word shingles have a Jaccard similarity of at least
    num / den. Null and wordless texts have an empty set and link with nothing. Rows with a null id
    are returned and link like all others; a group without any id has component_id null. With ``nameless``, rows also
    have group (equal in a component, null without words) and, where they have no id, the digest t1, t2 of their text. Repeated rows
    are all returned. Sets are told apart by a 128-bit digest and compared under its first 64 bits.
    """
    rows = written(set_digests(docs, id_col, text, n))
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(1, -(-int(total * 0.35) // KEYS_PER_TASK))
    held = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    met = written(_meetings(_key_blobs(docs, text, n, num, den, parts)))
    ids = met.select("h1").distinct()
    wanted = written(ids.join(held, "h1").select("h1", F.col("rep").alias("doc_id")))
    alone = wanted.select("h1").distinct()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chosen = source.join(small(wanted.select("doc_id").where("doc_id IS NOT NULL").distinct()), "doc_id", "left_semi")
    unnamed = not wanted.where("doc_id IS NULL").isEmpty()
    if unnamed:
        chosen = chosen.union(source.where("doc_id IS NULL"))
    sets = written(_candidate_sets(chosen, "text", n))
    if unnamed or sets.count() > alone.count():  # repeated rows, and rows of other sets
        once = written(sets.join(alone, "h1", "left_semi").dropDuplicates(["h1"]))
        discard(sets)
        sets = once

    # in each large meeting one set is tried with all others, so that less is left for the groups
    large = written(met.groupBy("key").agg(F.count("*").alias("c"), F.min("h1").alias("a")).where(F.col("c") > BLOCK))
    some = not large.isEmpty()
    if some:
        pairs = written(met.join(small(large.select("key", "a")), "key").where("h1 <> a").select("a", F.col("h1").alias("b")).distinct())
        tried = _verified(_possible(pairs, sets, num, den), sets, num, den)
        label = written(components(tried.where("linked")))
    else:
        tried = docs.sparkSession.createDataFrame([], "a long, b long, linked boolean")
        label = docs.sparkSession.createDataFrame([], "node long, comp long")
    todo = met
    # inside: larger meetings only, to link most before their blocks are compared
    for step in ("inside", "forest", "all") if some else ("forest", "all"):
        nodes = alone.join(label.withColumnRenamed("node", "h1"), "h1", "left").withColumn("comp", F.coalesce("comp", "h1"))
        found = written(_unlinked_pairs(todo, nodes, sets, tried, num, den, step == "all", step == "inside"))
        more = _verified(found.select("a", "b").distinct(), sets, num, den)
        gained, lost = more.agg(F.count_if("linked"), F.count_if(~F.col("linked"))).first()
        tried = tried.union(more)
        if gained:
            label = written(components(tried.where("linked")))
        if step == "forest":
            if not lost:
                break
            again = found.join(more.where("NOT linked"), ["a", "b"], "left_semi").select("key").distinct()
            todo = written(todo.join(again, "key", "left_semi"))
        discard(found)
    discard(sets)
    comp = label.join(held, label["node"] == held["h1"]).groupBy("comp").agg(F.min("rep").alias("lowest"))
    of_set = held.join(label, held["h1"] == label["node"], "left").join(comp, "comp", "left")
    of_set = of_set.select("h1", "h2", F.coalesce("lowest", "rep").alias("component_id"), F.coalesce("comp", "h1").alias("group"))
    marks = ["group", "t1", "t2"] if nameless else []
    return rows.join(of_set, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *marks
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every row of ``documents``; nulls, ties and repeated rows as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = {
    "op10_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON n.doc_id = m.a"""
}


def registered() -> dict:
    return {"op10_ngram_jaccard": op10_ngram_jaccard}
