"""Document fingerprints from closed syncmers, by DataFrame functions only.

A text is a sequence of tokens (runs of at most 16 non-space characters; one character each beyond
U+2E7F). Of its k-token windows those are anchors whose smallest s-token substring, by hash, stands
at the first or last place (closed syncmers): whether a window is an anchor depends on its own
tokens only. The fingerprint of a text is all its anchors, in order, with the distance of each from
the next. Fingerprints are matched by position: a link is an anchor, the next one and the number of
tokens between them, so that a passage is matched wherever it stands, but its anchors in one order and
at the same distances only. The likeness is the Jaccard similarity of the two sets of links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unused

TOKEN = r"[^\x00-\x20⺀-￿]{1,16}|[⺀-￿]"
RANGES = 4000
"""Most ranges of ids that neighbours are looked up in; their bounds are one array literal of the plan. Ranges of more
rows than ``per_range`` follow beyond that; Spark sorts each and spills what doesn't fit."""


def _hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def with_anchors(df: DataFrame, text: Column, name: str, k: int = 4, s: int = 2, positions: bool = False) -> DataFrame:
    """Add column ``name``: the anchors of ``text``, as hashes or as (pos, hash) with the window's first token number.

    A text with fewer than k tokens has one anchor, its whole token sequence; without tokens it has none. A column
    ``name`` that ``df`` has is replaced.
    """
    h, g = unused(df, f"{name}_h"), unused(df, f"{name}_g")
    df = df.withColumn(h, _hashes(text))
    # s-token substrings, shifted against each other so that one zip shows those of a window
    grams = F.col(h)
    if s > 1:
        zipped = F.arrays_zip(*[_shifted(F.col(h), i).alias(f"t{i}") for i in range(s)])
        grams = F.slice(
            F.transform(zipped, lambda z: F.xxhash64(*[z[f"t{i}"] for i in range(s)])), 1, F.greatest(F.size(h) - (s - 1), F.lit(0))
        )
    df = df.withColumn(g, grams)
    inner = k - s + 1
    zipped = F.slice(
        F.arrays_zip(*[_shifted(F.col(g), i).alias(f"g{i}") for i in range(inner)]), 1, F.greatest(F.size(h) - (k - 1), F.lit(0))
    )
    key = lambda z: F.xxhash64(*[z[f"g{i}"] for i in range(inner)]).bitwiseAND(F.lit(0xFFFFFFFF))

    def closed(z: Column) -> Column:
        least = F.least(*[z[f"g{i}"] for i in range(inner)]) if inner > 1 else z["g0"]
        return (z["g0"] == least) | (z[f"g{inner - 1}"] == least)

    if positions:
        numbered = F.transform(zipped, lambda z, i: F.struct(i.alias("pos"), z.alias("z")))
        picked = F.transform(
            F.filter(numbered, lambda p: closed(p["z"])), lambda p: F.struct(p["pos"].alias("pos"), key(p["z"]).alias("hash"))
        )
        whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash")))
    else:
        picked = F.transform(F.filter(zipped, closed), key)
        whole = F.array(F.xxhash64(h).bitwiseAND(F.lit(0xFFFFFFFF)))
    few = F.when(F.size(h) == 0, F.slice(whole, 1, 0)).otherwise(whole)
    return df.withColumn(name, F.when(F.size(h) < k, few).otherwise(picked)).drop(h, g)


def syncmers(docs: DataFrame, text: str = "text", k: int = 4, s: int = 2) -> DataFrame:
    """``docs`` plus ``anchors``: array of (pos, hash) for positional matching. Null texts count as empty; repeated rows stay;
    a column ``anchors`` that ``docs`` has is replaced."""
    return with_anchors(docs, F.coalesce(F.col(text), F.lit("")), "anchors", k, s, positions=True)


def links(anchors: Column) -> Column:
    """One hash for each anchor (pos, hash): of it, the next anchor and the tokens between; the last one of itself alone."""
    both = F.arrays_zip(anchors.alias("a"), _shifted(anchors, 1).alias("b"))
    gap = lambda z: (z["b"]["pos"] - z["a"]["pos"]).cast("long")
    return F.transform(both, lambda z: F.xxhash64(z["a"]["hash"], z["b"]["hash"], gap(z)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of links: 0 to 1; two empty ones are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def printed(anchors: Column) -> Column:
    """All anchors in order, each as its hash (8 hexadecimal digits), a point and its distance from the one before."""
    before = F.concat(F.array(F.lit(0)), F.transform(anchors, lambda x: x["pos"]))
    both = F.slice(F.arrays_zip(anchors.alias("a"), before.alias("p")), 1, F.size(anchors))
    word = lambda z: F.concat(F.lpad(F.lower(F.hex(z["a"]["hash"])), 8, "0"), F.lit("."), (z["a"]["pos"] - z["p"]).cast("string"))
    return F.array_join(F.transform(both, word), ",")


def with_next(df: DataFrame, key: str, columns: list[str], per_range: int = 4096) -> DataFrame:
    """``df`` plus ``next_<column>``: the values of the next row in ascending ``key`` (nulls first, then ties by
    ``columns``, equal rows in any order); after the last row the first. Columns of those names that ``df`` has are replaced.

    Rows are dealt to ranges of keys by quantile bounds. The first rows of a range go to the range
    before it too, so that one shuffle and a window in each range find every successor.
    """
    n = df.count()
    ranges = max(1, min(RANGES, n // per_range))
    cuts: list = []
    if ranges > 1:
        found = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
        cuts = sorted(set(found or []))
    kind = df.select(key).schema[0].dataType
    own = df.select(F.struct("*").alias("row"))
    value = F.col("row")[key]
    bounds = F.array(*[F.lit(c).cast(kind) for c in cuts])
    bucket = F.when(value.isNull() | F.lit(not cuts), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= value))).cast("int")
    own = own.withColumn("at", bucket)
    # smallest key of each range and whether it holds nulls: at most RANGES rows
    firsts = {r[0]: (r[1], r[2]) for r in own.groupBy("at").agg(F.min(value), F.count("*") > F.count(value)).collect()}
    held = sorted(firsts)
    before = {b: held[i - 1] for i, b in enumerate(held)}
    every = range(len(cuts) + 1)
    least = F.array(*[F.lit(None if firsts.get(b, (None, 1))[1] else firsts[b][0]).cast(kind) for b in every])
    nulls = F.array(*[F.lit(bool(firsts.get(b, (0, False))[1])) for b in every])
    guest_of = F.array(*[F.lit(before.get(b, 0)) for b in every])
    first = F.coalesce(F.get(least, F.col("at")) == value, F.lit(False)) | (value.isNull() & F.get(nulls, F.col("at")))
    seat = lambda at, guest: F.struct(at.alias("at"), F.lit(guest).alias("guest"))
    seats = F.when(first, F.array(seat(F.col("at"), False), seat(F.get(guest_of, F.col("at")), True))).otherwise(F.array(seat(F.col("at"), False)))
    dealt = own.select("row", F.explode(seats).alias("seat")).select("row", "seat.at", "seat.guest")
    order = Window.partitionBy("at").orderBy("guest", value.asc_nulls_first(), *[F.col("row")[c] for c in columns])
    names = [f"next_{c}" for c in columns]
    out = dealt.select("row", "guest", *[F.lead(F.col("row")[c]).over(order).alias(f"next_{c}") for c in columns])
    return out.where("NOT guest").select(*[F.col("row")[c].alias(c) for c in df.columns if c not in names], *names)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and their likeness.

    Null texts count as empty. Repeated doc_ids follow each other in a fixed order of their texts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, "doc_id", ["text"]).select(
        "doc_id", "text", "next_text", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    for source, name in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        rows = with_anchors(rows, F.col(source), name, positions=True)
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"),
        *[links(F.col(c)).alias(c) for c in ("own", "changed", "following")],
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def registered() -> dict:
    return {"op8_fingerprint": op8_fingerprint}
