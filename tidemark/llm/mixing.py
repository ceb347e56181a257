"""Mixing sources to target weights by cube-method balanced sampling.

A document's expected number of copies is its source's target over its source's size: whole copies
are certain, the fraction is an inclusion probability. The flight phase moves the fractions of three
documents at a time along the null space of the two balancing constraints (number of documents,
number of words) until one of them reaches 0 or 1, so both totals stay exact. It runs in blocks of a
source; the few documents that a block leaves undecided meet in blocks of the next level. What is
left at the end of a source, at most LANDING documents, is landed on the choice with the words
closest to the target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

BLOCK = 4096
LANDING = 14
PARTS = (0.1, 0.04, 0.015)
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Target words by source. Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    words; a target stops at ``most`` times its source's words and the excess is shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if per * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: per * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


def flight(p: np.ndarray, size: np.ndarray, keep: int, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities ``p`` to 0 or 1, but for at most max(keep, 2) of them; sum(p) and sum(p * size) stay."""
    p = p.astype(float).copy()
    todo = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))]
    at, n = 0, len(todo)
    hand: list[int] = []
    flips = rng.random(n + 1)
    while True:
        while len(hand) < 3 and at < n:
            hand.append(todo[at])
            at += 1
        if len(hand) < 3 or len(hand) + n - at <= keep:
            break
        a, b, c = hand
        # null space of ((1, 1, 1), (sa, sb, sc))
        u = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        forth = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(hand, u) if x)
        back = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(hand, u) if x)
        step = forth if flips[at] * (forth + back) < back else -back
        for i, x in zip(hand, u):
            v = p[i] + step * x
            p[i] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
        hand = [i for i in hand if 0 < p[i] < 1]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The choice of whole numbers whose words, then documents, come closest to the expected ones."""
    free = np.flatnonzero((p > 0) & (p < 1))
    p = p.copy()
    if len(free):
        options = (np.arange(1 << len(free))[:, None] >> np.arange(len(free))) & 1
        words = np.abs(options @ size[free] - p[free] @ size[free])
        docs = np.abs(options.sum(axis=1) - p[free].sum())
        p[free] = options[np.lexsort((docs, words))[0]]
    return p


def last_flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All of ``p`` to 0 or 1. Documents that hold over a tenth of the expected words are decided first, balanced among
    themselves; the rest's probabilities make up for the words that this moved. Then the same for smaller parts, and
    the flight and landing of what is left."""
    p = p.astype(float).copy()
    for part in PARTS:
        free = (p > 0) & (p < 1)
        large = free & (size > part * (p @ size))
        rest = free & ~large
        if not (large.any() and rest.any()):
            continue
        goal = p[large] @ size[large]
        q = flight(p[large], size[large], 2, rng)
        q = np.where((q > 0) & (q < 1), rng.random(len(q)) < q, q)
        moved, give = q @ size[large] - goal, p[rest] * (1 - p[rest])
        p[large] = q
        if give @ size[rest]:
            p[rest] = np.clip(p[rest] - moved * give / (give @ size[rest]), 1e-6, 1 - 1e-6)
    return landing(flight(p, size, LANDING, rng), size)


def nearest_landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, tries: int = 64, near: float = 0.001) -> np.ndarray:
    """The first of ``tries`` last flights whose words come within ``near`` of the expected ones, else the closest.

    One flight is enough but where a few documents hold much of a source."""
    best, least = p, np.inf
    for _ in range(tries):
        q = last_flight(p, size, rng)
        off = abs((q - p) @ size)
        if off < least:
            best, least = q, off
        if off <= near * (p @ size):
            break
    return best


def cube_sample(rows: DataFrame, group: str, share: str, size: str, key: str) -> DataFrame:
    """``rows`` plus ``picked`` (0 or 1): a balanced sample of each ``group`` with inclusion probabilities ``share``.

    Rows of a group go to blocks of about BLOCK by a hash of ``key``; a group may hold any share of
    all rows. The seed of a block is its number, so reruns agree. Null groups are a group.
    """
    columns = rows.columns
    blocks = rows.groupBy(group).agg(F.count("*").alias("__n")).select(
        F.col(group).alias("__g"), F.greatest(F.lit(1), F.ceil(F.col("__n") / BLOCK)).cast("long").alias("__blocks")
    )
    now = rows.join(small(blocks), F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    now = now.withColumn("__block", F.pmod(F.xxhash64(key, size), F.col("__blocks"))).withColumn("__p", F.col(share).cast("double"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in now.dtypes)
    done = None
    while True:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # large documents first: the small ones are left for the landing
            pdf = pdf.sort_values([size, key], ascending=[False, True], kind="stable").reset_index(drop=True)
            block, last = int(pdf["__block"].iloc[0]), int(pdf["__blocks"].iloc[0]) == 1
            s, p = pdf[size].to_numpy(float), pdf["__p"].to_numpy(float)
            rng = np.random.default_rng(block)
            pdf["__p"] = nearest_landing(p, s, rng) if last else flight(p, s, 2, rng)
            return pdf

        level = written(now.groupBy(group, "__block").applyInPandas(run, kinds))
        decided = level.where("__p IN (0, 1)").select(*columns, F.col("__p").cast("int").alias("picked"))
        done = decided if done is None else done.union(decided)
        now = level.where("__p NOT IN (0, 1)")
        if now.isEmpty():
            return done
        now = now.withColumn("__block", F.floor(F.col("__block") / (BLOCK // 4))).withColumn(
            "__blocks", F.ceil(F.col("__blocks") / (BLOCK // 4)).cast("long")
        )


def n_words(text: Column) -> Column:
    """Number of runs of characters other than the space and U+0009..U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, group: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without ``text`` plus size, source_size, target, copies (0, 1 or 2) and taken (copies * size).

    Null sources are a source, null texts have no words. A source without words has target 0 and takes nothing.
    """
    rest = [c for c in docs.columns if c != text]
    sized = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col(group).alias("__source"), F.col(key).alias("__key"), n_words(F.col(text)).alias("size")))
    totals = sized.groupBy("__source").agg(F.sum("size").alias("source_size")).orderBy("__source")
    sizes = {r[0]: r[1] for r in totals.collect()}  # one number a source
    goal = targets(sizes)
    plan = docs.sparkSession.createDataFrame(
        [(s, sizes[s], float(t), t / sizes[s] if sizes[s] else 0.0) for s, t in goal.items()], "__s string, source_size long, target double, rate double"
    )
    rows = sized.join(small(plan, len(goal)), F.col("__source").cast("string").eqNullSafe(F.col("__s")), "left").drop("__s")
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("share", F.col("rate") - F.col("whole"))
    picked = cube_sample(rows, "__source", "share", "size", "__key")
    copies = (F.col("whole") + F.col("picked")).cast("int")
    return picked.select("doc", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``; nulls as in mix, repeated rows are sampled one by one, an empty table gives no rows."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def registered() -> dict:
    return {"op5_mixing": op5_mixing}
