"""Line dedup: lines that recur in several documents stay in one of them only.

DataFrame functions only. Normalised lines are exploded and hashed; the documents of each hash are counted
with a map-side combine, so a line that stands in a third of all documents reaches the last task as one row a
task. The lines of counted hashes give each text the places it loses, and the text is put together from the
runs of lines between these places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 10
LEAST_DOCUMENTS = 2


def line_key(line: Column) -> Column:
    """What equal lines share: no blanks at either end, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def digest(value: Column) -> list[Column]:
    """Two hashes of different seeds: 128 bits, as 64 are likely to clash among 10^10 lines."""
    return [F.xxhash64(value), F.xxhash64(F.lit(17), value)]


def kept_lines(lines: Column, places: Column) -> Column:
    """``lines`` without those at ``places`` (ascending, from 0), in time linear in the number of lines."""
    ends = F.concat(places, F.array(F.size(lines)))
    begins = F.concat(F.array(F.lit(-1)), places)
    run = lambda end, i: F.slice(lines, F.get(begins, i) + 2, end - F.get(begins, i) - 1)
    return F.flatten(F.transform(ends, run))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """``docs`` with ``text`` deduplicated by lines, and new columns n_lines and n_dropped (long).

    A key of ``least_chars`` code points or more that stands in ``least_documents`` documents or more keeps its lines
    in the document with the smallest id and loses all others; lines end at a line feed. Null and empty texts
    are one empty line (a null text becomes empty). Rows that share an id are one document; rows without id are one
    document too, after all others. Repeated rows stay and lose the same lines; an empty table stays empty.
    New columns take underscores before their names where ``docs`` has such columns already.
    """
    names = [unused(docs, c) for c in ("n_lines", "n_dropped")]
    place, line, h1, h2, t1, t2, first, places = (unused(docs, f"line_{c}") for c in "place line h1 h2 t1 t2 first places".split())
    doc = F.col(f"`{id_col}`")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = lambda c: F.split(c, "\n", -1)
    h = digest(line_key(F.col(line)))
    hashed = lambda df: df.where(F.length(line_key(F.col(line))) >= least_chars).withColumns({h1: h[0], h2: h[1]}).drop(line)

    whole = docs.select(doc.alias("id"), body.alias("body"))
    # two documents differ, so up to a threshold of 2 the least and the largest id count them
    count = F.when(F.min("id") < F.max("id"), 2).when(F.min("id").isNull(), 0).otherwise(1) if least_documents <= 2 else F.count_distinct("id")
    holders = (
        hashed(whole.select("id", F.explode(split(F.col("body"))).alias(line)))
        .groupBy(h1, h2)
        .agg(F.min("id").alias(first), count.cast("long").alias("n"), F.max(F.col("id").isNull()).cast("long").alias("unnamed"))
        .where(F.col("n") + F.col("unnamed") >= least_documents)
        .select(h1, h2, first)
    )
    # equal texts under one id lose the same lines: (id, text) stands for the row
    of_text = digest(F.col("body"))
    lines = hashed(whole.select("id", of_text[0].alias(t1), of_text[1].alias(t2), F.posexplode(split(F.col("body"))).alias(place, line)))
    lost = (
        lines.join(holders, [h1, h2])
        .where(~F.col("id").eqNullSafe(F.col(first)))
        .groupBy("id", t1, t2)
        .agg(F.sort_array(F.collect_set(place)).alias(places))
        .withColumnRenamed("id", first)
    )
    own = digest(body)
    joined = docs.withColumns({t1: own[0], t2: own[1]})
    joined = joined.join(lost, (joined[t1] == lost[t1]) & (joined[t2] == lost[t2]) & doc.eqNullSafe(F.col(first)), "left")
    dropped = F.when(F.col(places).isNull(), 0).otherwise(F.size(places))
    kept = F.when(F.col(places).isNull(), body).otherwise(F.array_join(kept_lines(split(body), F.col(places)), "\n"))
    columns = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.size(split(body)).cast("long").alias(names[0]), dropped.cast("long").alias(names[1]))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines dropped, digest of what is kept. Odd rows as in ``dedup_lines``."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = {
    "op13_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key
      HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN 1 END) >= {LEAST_DOCUMENTS}),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.first AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid"""
}


def registered() -> dict:
    return {"op13_line_dedup": op13_line_dedup}
