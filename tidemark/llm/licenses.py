"""License scans: phrases, and an exact containment join of text blocks with license templates.

DataFrame functions only. A template's blocks in a text are the runs of words that begin with one of its
words and are ``STRETCH`` times as long as it, wherever lines break. It is found in a block when at least
``threshold`` of its distinct words stand there, in any order. Siblings share most words, so a block gives
the template's label only if a run of words stands in it that tells the template from its siblings ("lesser general"):
what else the block holds takes no label away, and a block under two licenses gives both.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Opening or notice sentences of public licenses: the label each one stands for, the sentence, and runs of
# words that must stand in the block, as the sentence's siblings differ there; | parts alternatives, a comma several runs.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general"),
    ("gpl-3", "This work is licensed under the GNU General Public License version 3", "gnu general, 3"),
    ("gpl-2", "This work is licensed under the GNU General Public License version 2", "gnu general, 2"),
    ("lgpl", "This library is free software you can redistribute it under the terms of the GNU Lesser General Public License", "lesser general"),
    ("lgpl", "This program is licensed under the terms of the GNU Lesser General Public License", "lesser general"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License", "lesser general"),
    ("agpl", "This work is licensed under the GNU Affero General Public License", "affero general"),
    ("agpl", "This program is licensed under the terms of the GNU Affero General Public License", "affero general"),
    ("apache-2", "Licensed under the Apache License Version 2.0", "apache, 2"),
    ("apache-2", "you may not use this file except in compliance with the License You may obtain a copy of the License at apache org licenses", "apache"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction", ""),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution 4|attribution 3|attribution 2|attribution international|attribution license"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0", "by nc 4|by nc 3|by nc 2|by nc license"),
    ("cc-by-sa", "Licensed under CC BY SA 4.0", "by sa 4|by sa 3|by sa 2|by sa license"),
    ("cc-by-nc-sa", "Licensed under CC BY NC SA 4.0", "by nc sa"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
)
STRETCH = 1.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Form:
    """A template as sets of words: ``need`` of ``words`` in a block of ``span`` words, and for the label one run of each of ``must``."""

    label: str
    words: tuple[str, ...]
    need: int
    span: int
    must: tuple[tuple[str, ...], ...]


def template_forms(templates=TEMPLATES, threshold: float = 0.8, stretch: float = STRETCH) -> list[Form]:
    cut = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    sets = lambda t: tuple(sorted(set(cut(t))))
    runs = lambda t: tuple(tuple(" ".join(cut(r)) for r in part.split("|")) for part in t.split(",") if part)
    return [
        Form(label, sets(body), math.ceil(threshold * len(sets(body)) - 1e-9), math.ceil(stretch * len(cut(body))), runs(must))
        for label, body, must in templates
    ]


def _spaced(text: Column) -> Column:
    """The words of a text, A-Z lowered, one space between them; empty without words."""
    return F.trim(F.translate(F.regexp_replace(text, SEPARATORS, " "), UPPER, LOWER))


def _words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def license_hits(
    docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Return (rows, hits): ``rows`` is ``docs`` without ``text`` plus row_id, n_words and phrase places;
    ``hits`` has one row per (row_id, start_word, block_words, template, label, overlap, containment, own), for every
    block that meets the threshold; ``own`` is false where the block has no run of words that is the template's own.

    One pass over the text keeps, of each text that can hold a template at all, the words that templates
    use, with their places. Their document counts order them, rarest first. Words and templates then join on
    prefix words: a block must hold one of the first ``size - need + 1`` words of the template. What stands
    around a shared word, less than a block away, must hold ``need`` words (length), and as many that are
    not before the shared one in the order (position). Blocks around survivors are verified exactly.
    Null texts count as empty, repeated rows stay apart.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c != text]
    known = template_forms(templates, threshold)
    vocabulary = sorted({w for f in known for w in (*f.words, *[w for runs in f.must for run in runs for w in run.split(" ")])})
    listed = lambda ws: F.array(*[F.lit(w) for w in ws])

    first = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), _spaced(body).alias("spaced"))
    first = first.select("doc", F.concat(F.lit(" "), "spaced", F.lit(" ")).alias("padded"), _words(F.col("spaced")).alias("words"))
    first = first.withColumn("used", F.array_intersect("words", listed(vocabulary)))

    def places(phrase: str) -> Column:
        w = phrase.split(" ")
        at = lambda i: F.get("words", i)

        def here(i: Column) -> Column:
            ok = at(i) == w[0]
            for k in range(1, len(w)):
                ok = ok & (at(i + k) == w[k])
            return ok

        return F.when(
            F.col("padded").contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
        ).otherwise(F.array().cast("array<int>"))

    may = F.lit(False)
    for f in known:
        may = may | (F.size(F.array_intersect("used", listed(f.words))) >= f.need)
    placed = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    scanned = written(
        first.select(
            F.monotonically_increasing_id().alias("row_id"), "doc", F.size("words").cast("long").alias("n_words"),
            *[places(p).alias(f"p{i}") for i, p in enumerate(phrases)], "used",
            F.when(may, F.filter(placed, lambda x: x["w"].isin(vocabulary))).alias("placed"),
        )
    )
    # document counts of at most len(vocabulary) words
    counts = {r.w: r["count"] for r in scanned.select(F.explode("used").alias("w")).groupBy("w").count().collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ranks = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])

    forms, widest = [], max(f.span for f in known)
    for t, f in enumerate(known):
        ids = sorted(order[w] for w in f.words)
        must = [[f" {' '.join(str(order[w]) for w in run.split(' '))} " for run in runs] for runs in f.must]
        forms += [(i, t, f.label, f.need, f.span, ids, must) for i in ids[: len(ids) - f.need + 1]]  # prefix
    side = docs.sparkSession.createDataFrame(forms, "id int, template int, label string, need int, span int, tids array<int>, must array<array<string>>")
    prefixes = sorted({form[0] for form in forms})

    coded = scanned.where(F.col("placed").isNotNull()).select(
        "row_id", "n_words", F.transform("placed", lambda x: F.struct(x["at"].alias("at"), F.element_at(ranks, x["w"]).alias("id"))).alias("seen")
    )
    shared = F.filter(
        F.transform("seen", lambda x, j: F.struct(x["at"].alias("at"), x["id"].alias("id"), j.alias("j"))), lambda x: x["id"].isin(prefixes)
    )
    around = F.slice("seen", F.greatest(F.lit(1), F.col("hit.j") + 2 - widest), 2 * widest - 1)  # places differ, so these hold a block each way
    cut = coded.select("row_id", "n_words", "seen", F.explode(shared).alias("hit")).select(
        "row_id", "n_words", F.col("hit.at").alias("at"), F.col("hit.id").alias("id"), around.alias("around")
    )
    near = cut.join(F.broadcast(side), "id").withColumn(  # as many rows as the templates have prefix words
        "around", F.filter("around", lambda x: F.abs(x["at"] - F.col("at")) < F.col("span"))
    )
    own = F.array_intersect("around.id", "tids")
    near = near.where(F.size(own) >= F.col("need")).where(F.size(F.filter(own, lambda x: x >= F.col("id"))) >= F.col("need"))
    starts = F.filter("around", lambda x: (x["at"] <= F.col("at")) & F.array_contains("tids", x["id"]))
    block = F.filter("around", lambda x: (x["at"] >= F.col("start")) & (x["at"] < F.col("start") + F.col("span")))
    # numbers of neighbouring words with a space between them, a bar where words are left out
    step = lambda x, i: F.concat(F.when(F.get("block", i - 1)["at"] == x["at"] - 1, "").otherwise("| "), x["id"].cast("string"))
    run = F.concat(F.lit(" "), F.array_join(F.transform("block", step), " "), F.lit(" "))
    hits = (
        near.withColumn("start", F.explode(F.transform(starts, lambda x: x["at"])))
        .dropDuplicates(["row_id", "template", "start", "id"])
        .withColumn("block", block)
        .withColumn("overlap", F.size(F.array_intersect("block.id", "tids")))
        .where("overlap >= need")
        .withColumn("run", run)
        .withColumn("own", F.forall("must", lambda runs: F.exists(runs, lambda r: F.contains(F.col("run"), r))))
        .dropDuplicates(["row_id", "template", "start"])
        .select(
            "row_id", F.col("start").alias("start_word"), F.least(F.col("span"), F.col("n_words") - F.col("start")).alias("block_words"),
            "template", "label", "overlap", (F.col("overlap") / F.size("tids")).alias("containment"), "own",
        )
    )
    rows = scanned.select("row_id", "doc", "n_words", *[f"p{i}" for i in range(len(phrases))])
    return rows, hits


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: places of license phrases, labels of phrases and of matched templates, a score.

    The score is 1 where a phrase stands, else the best containment of a template in a block, else 0. Null texts count
    as empty, repeated rows are scanned one by one, an empty table gives no rows.
    """
    rows, hits = license_hits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = hits.groupBy("row_id").agg(F.collect_set(F.when(F.col("own"), F.col("label"))).alias("found"), F.max("containment").alias("containment"))
    columns = [f"p{i}" for i in range(len(PHRASES))]
    places = F.concat(*columns)
    base = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(columns, PHRASES.values())]))
    listed = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return rows.join(best, "row_id", "left").select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    words = lambda t: f"regexp_extract_all(translate({t}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    forms = ", ".join(
        f"({t}, '{f.label}', {listed(f.words)}, {f.need}, {f.span}, [{', '.join(map(listed, f.must))}]::VARCHAR[][])" for t, f in enumerate(template_forms())
    )
    at = ", ".join(
        "list_filter(range(0, len(words)), lambda i: "
        + " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split(" ")))
        + f") AS p{i}"
        for i, p in enumerate(PHRASES)
    )
    every = "list_concat(list_concat(p0, p1), list_concat(p2, p3))"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{v}' END" for i, v in enumerate(PHRASES.values())) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS words FROM documents),
p AS (SELECT rid, doc_id, len(words) AS n_words, {at} FROM w),
f(template, label, tw, need, span, must) AS (VALUES {forms}),
u AS (SELECT rid, words, list_distinct(words) AS dw FROM w),
c AS (SELECT * FROM u, f WHERE len(list_intersect(dw, tw)) >= need),
s AS (SELECT rid, label, tw, need, must, span, words,
             unnest(list_filter(range(1, len(words) + 1), lambda i: list_contains(tw, words[i]))) AS i FROM c),
b AS (SELECT rid, label, tw, need, must, list_distinct(words[i:i + span - 1]) AS bw, ' ' || array_to_string(words[i:i + span - 1], ' ') || ' ' AS run FROM s),
h AS (SELECT rid, CASE WHEN len(list_filter(must, lambda g: len(list_filter(g, lambda p: contains(run, ' ' || p || ' '))) = 0)) = 0 THEN label END AS label,
             len(list_intersect(bw, tw)) / len(tw) AS c FROM b WHERE len(list_intersect(bw, tw)) >= need),
g AS (SELECT rid, coalesce(list(DISTINCT label) FILTER (label IS NOT NULL), []) AS found, max(c) AS c FROM h GROUP BY rid)
SELECT doc_id, n_words, len({every}) AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word,
       array_to_string(list_sort(list_distinct({base})), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat({base}, coalesce(found, [])))), ',') AS labels,
       CASE WHEN len({every}) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM p LEFT JOIN g USING (rid)"""


ORACLE = {"op1_license_scan": _oracle()}


def registered() -> dict:
    return {"op1_license_scan": op1_license_scan}
