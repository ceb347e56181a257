"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

toxicity drops what the classifier rejects; near duplicates keep one document of each group; secret
scans mask every span; mixing repeats or leaves out documents until each source has its share of
words; packing places the token pieces in sequences. Each stage function takes (spark, docs, sf_dir);
its result is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, small, table, unused, written
from tidemark.llm.jaccard import near_duplicates, text_digest
from tidemark.llm.mixing import mix
from tidemark.llm.packing import packed_documents
from tidemark.llm.secrets import masked
from tidemark.llm.toxicity import train, with_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic. It is trained on the labelled ones among ``docs``.

    Null texts count as empty, repeated rows share one fate; without labelled rows of both classes, as in an empty
    table, all stay.
    """
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(unused(docs, "predicted")) == 0).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the smallest doc_id; of a group without any id, of the least text digest.

    Documents without words are nobody's duplicates. Of rows that share an id one stays; rows without id go where their
    group has one. An empty table stays empty.
    """
    names = [f"`{c}`" for c in docs.columns]
    groups = written(near_duplicates(docs.select("doc_id", "text"), nameless=True))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(small(gone), "doc_id", "left_anti").select(*names)
    if not groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    nameless = groups.where("doc_id IS NULL")
    if nameless.isEmpty():
        return kept
    t1, t2 = unused(docs, "t1"), unused(docs, "t2")
    marked = docs.where("doc_id IS NULL").withColumns(dict(zip((t1, t2), text_digest(F.col("text")))))
    one = nameless.where("component_id IS NULL AND group IS NOT NULL").groupBy("group").agg(F.min(F.struct("t1", "t2")).alias("t"))
    one = one.select(F.col("t.t1").alias(t1), F.col("t.t2").alias(t2))
    wordless = nameless.where("group IS NULL").select(F.col("t1").alias(t1), F.col("t2").alias(t2)).distinct()
    first = marked.join(one, [t1, t2], "left_semi").dropDuplicates([t1, t2])
    return kept.unionByName(first.unionByName(marked.join(wordless, [t1, t2], "left_semi")).select(*names))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, n_chars as of the masked text."""
    clean = masked(docs)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0, 1 or 2) as the mix takes it; of equal rows as many of each as the mix decides.

    Null sources are a source, null texts have no words; an empty table stays empty. One plan at every size: decisions
    and texts meet by a shuffle on a hash of id, source and text, in which the window over equal rows finds its rows too.
    """
    key, n, i = (unused(docs, c) for c in ("row_key", "row_number", "copy"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.coalesce("text", F.lit(""))))
    mixed = mix(keyed.select(key, "doc_id", "source", "text"))
    counts = mixed.groupBy(F.col(f"doc.{key}").alias(key)).agg(F.count_if(F.col("copies") == 2).alias("twice"), F.count_if(F.col("copies") >= 1).alias("taken"))
    counts = counts.where("taken > 0").select(key, F.struct("twice", "taken").alias(n)).hint("merge")
    rows = keyed.join(counts, key)
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))
    copies = F.when(place <= F.col(n)["twice"], 2).when(place <= F.col(n)["taken"], 1).otherwise(0)
    taken = rows.withColumn(n, copies).where(F.col(n) > 0)
    return taken.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048 tokens.

    Null texts are one piece of the end id; repeated rows are packed one by one; an empty table gives no pieces.
    """
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # a trained classifier, balanced sampling and a tokenizer: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``: the token pieces of what is kept. A stage's table goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
