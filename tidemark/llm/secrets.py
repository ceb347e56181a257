"""Secret scans with multipart credential linking, by DataFrame functions only.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are always reported. Weak
parts (user or client identifiers, mixed tokens, endpoints) are reported only when complementary
parts stand in the same scope: within ``scope`` code points of each other in one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, unused, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
IDENT = r"""(?i:user|username|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "ident", "endpoint", "opaque")
"""Span kinds in the order in which ties at one start are listed; the first three are the strong ones."""

#: kind: pattern, group whose length counts, least length, further tests of the match
PATTERNS: dict[str, tuple[str, int, int, tuple[str, ...]]] = {
    "assign": (ASSIGN, 2, 12, ()),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, ()),  # a run is taken whole, so its least length may stand in the pattern
    "hex": (r"[0-9a-f]{16,}", 0, 16, ()),
    "ident": (IDENT, 1, 3, ()),
    "endpoint": (ENDPOINT, 0, 8, ()),
    "opaque": (r"[A-Za-z0-9+/_-]{20,}", 0, 20, ("[0-9]", "[A-Z]", "[a-z]")),
}
ROLES = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "endpoint": "endpoint", "opaque": "secret"}
NEEDS = {"ident": ("secret",), "endpoint": ("ident", "secret"), "opaque": ("ident",)}


def _matches(text: Column, pattern: str, group: int, least: int, tests: tuple[str, ...]) -> Column:
    """Array of (gap before the match, its length, kept?) in code points; null where nothing matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    graded = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def keep(value: Column) -> Column:
        ok = F.length(value) >= least
        for test in tests:
            ok = ok & value.rlike(test)
        return ok

    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("len"),
        F.transform(graded, keep).alias("ok"),
    )
    return F.when(text.rlike(pattern), F.filter(parts, lambda p: p["len"].isNotNull()))


def secret_spans(docs: DataFrame, text: str = "text", scope: int = 300) -> tuple[DataFrame, DataFrame]:
    """Return (rows, spans): ``rows`` is ``docs`` without ``text`` plus ``row_id``; ``spans`` has row_id, kind, start, end.

    Positions are code points of the whole text, end exclusive. Null texts count as empty; repeated
    rows each keep their own spans. A weak span that overlaps a strong one is not listed again.
    The scope join looks up, for the grid cell of a weak part and the two beside it, the first and
    last position of each role: its size is linear in the parts, however many share a scope.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c != text]
    scanned = written(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"),
            *[_matches(body, *PATTERNS[k]).alias(k) for k in KINDS],
        )
    )
    each = scanned.select(
        "row_id", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(k).alias("m")) for i, k in enumerate(KINDS)])).alias("x")
    ).select("row_id", "x.k", F.posexplode("x.m").alias("pos", "p"))
    upto = Window.partitionBy("row_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        each.select("row_id", "k", "p.ok", F.sum(F.col("p.gap") + F.col("p.len")).over(upto).alias("end"), F.col("p.len").alias("len"))
        .where("ok")
        .select("row_id", "k", (F.col("end") - F.col("len")).alias("start"), "end")
    )
    strong, rank = F.col("k") < 3, F.when(F.col("k") < 3, 0).when(F.col("k") < 5, 1).otherwise(2)
    order = Window.partitionBy("row_id").orderBy("start", "k")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    clear = lambda r: (
        (F.coalesce(F.max(F.when(rank < r, F.col("end"))).over(before), F.lit(0)) <= F.col("start"))
        & (F.coalesce(F.min(F.when(rank < r, F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    )
    parts = written(
        spans.withColumn("free", F.when(rank == 0, F.lit(True)).when(rank == 1, clear(1)).otherwise(clear(2)))
        .where("free")
        .select("row_id", "k", "start", "end", F.floor(F.col("start") / scope).alias("cell"))
    )
    kinds = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    grid = (
        parts.groupBy("row_id", "cell", F.get(kinds, F.col("k")).alias("role"))
        .agg(F.min("start").alias("first"), F.max("start").alias("last"))
        .select("row_id", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), "role", "first", "last")
    )
    near = (
        parts.where("k >= 3")
        .join(grid, ["row_id", "cell"])
        .where((F.col("first") <= F.col("start") + scope) & (F.col("last") >= F.col("start") - scope))
        .groupBy("row_id", "k", "start", "end")
        .agg(*[F.bool_or(F.col("role") == r).alias(r) for r in ("ident", "secret", "endpoint")])
    )
    linked = F.lit(False)
    for kind, needs in NEEDS.items():
        test = F.col("k") == KINDS.index(kind)
        for need in needs:
            test = test & F.col(need)
        linked = linked | test
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = parts.where(strong).select("row_id", "k", "start", "end").union(near.where(linked).select("row_id", "k", "start", "end"))
    rows = scanned.select("row_id", "doc")
    return rows, listed.select("row_id", "k", F.get(names, F.col("k")).alias("kind"), "start", "end")


def masked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans become one mark.

    Rows with the same id (or none) and the same text are treated alike. Texts without spans, null and empty ones among
    them, stay as they are; columns of any other name do; an empty table stays empty.
    """
    own, key, print_, gaps, tail = (unused(docs, c) for c in ("own_print", "key", "print", "gaps", "tail"))
    doc, whole = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    of_text = F.xxhash64(F.coalesce(whole, F.lit("")))
    rows, spans = secret_spans(docs.select(doc.alias("key"), of_text.alias("print"), whole.alias("text")))
    order = Window.partitionBy("row_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = spans.select("row_id", "start", "end", F.coalesce(F.max("end").over(order), F.lit(0)).alias("open"))
    cut = cuts.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("start") >= F.col("open"), F.struct(F.col("open").alias("a"), F.col("start").alias("b"))))).alias(gaps),
        F.max("end").alias(tail),
    )
    found = written(rows.join(cut, "row_id").select(F.col("doc.key").alias(key), F.col("doc.print").alias(print_), gaps, tail).dropDuplicates([key, print_]))
    pieces = F.transform(gaps, lambda g: F.substring(whole, g["a"].cast("int") + 1, (g["b"] - g["a"]).cast("int")))
    new = F.array_join(F.concat(pieces, F.array(F.substring(whole, F.col(tail).cast("int") + 1, F.length(whole)))), mark)
    joined = docs.withColumn(own, of_text).join(small(found), doc.eqNullSafe(F.col(key)) & (F.col(own) == F.col(print_)), "left")
    return joined.select(*[F.when(F.col(gaps).isNotNull(), new).otherwise(whole).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: strong span counts, digest of the strong spans, and all spans."""
    rows, spans = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_digest(rows, spans)


def secret_digest(rows: DataFrame, spans: DataFrame) -> DataFrame:
    item = F.struct("start", "k", F.concat_ws(":", "kind", "start", "end").alias("s"))
    joined = lambda cond: F.concat_ws(
        ",", F.transform(F.sort_array(F.collect_list(F.when(cond, item))), lambda x: x["s"])
    )
    found = spans.groupBy("row_id").agg(
        *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in KINDS[:3]],
        joined(F.col("k") < 3).alias("base"),
        joined(F.lit(True)).alias("spans"),
    )
    zero = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return rows.join(found, "row_id", "left").select(
        F.col("doc.doc_id").alias("doc_id"),
        *zero,
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def registered() -> dict:
    return {"op6_secret_scan": op6_secret_scan}
