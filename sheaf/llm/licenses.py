"""License scans by an exact set-similarity join, in DataFrame operations only.

The blocks of a text are its windows of BLOCK words, one every half window, across line breaks, so that any stretch of half a window stands whole in one; a
template is a set of words, of at most half a window. A block meets a template if it holds at least a given share of the
template's words (containment), among them those that name the license, and none that name another. Words are ordered by the number of documents they occur in over the whole table,
rarest first. Prefix filter: a block that meets a template of n words, of which k are needed, holds one of the n - k + 1 rarest. Length filter: it
has at least k of the words that templates use. Positional filter: from a shared word on, both sides have enough words left.
What passes is verified by the size of the intersection.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import table
from sheaf.session import written

#: What separates words, once A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Templates by label: the words of a statement of the license, the words that must be there to name it, and those that name another.
TEMPLATES = {
    "mit": [("released under the mit license", "mit", ""), ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted", "")],
    "apache-2": [("licensed under the apache license version 2 0", "apache 2", ""), ("you may obtain a copy of the license at apache org licenses license 2 0", "apache 2", "")],
    "cc-by-nc": [("licensed under cc by nc 4 0", "cc nc", ""), ("licensed under the creative commons attribution noncommercial 4 0 international license", "commons noncommercial", "")],
    "cc-by-sa": [("licensed under cc by sa 4 0", "cc sa", ""), ("licensed under the creative commons attribution sharealike 4 0 international license", "commons sharealike", "")],
    "gpl-3": [("this work is licensed under the gnu general public license version 3", "gnu general 3", "lesser")],
    "gpl-2": [("this work is licensed under the gnu general public license version 2", "gnu general 2", "lesser")],
    "lgpl-3": [("licensed under the gnu lesser general public license version 3", "gnu lesser 3", "")],
    "mpl-2": [("subject to the terms of the mozilla public license v 2 0", "mozilla 2", "")],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution permitted", "")],
}
CONTAINMENT = 0.8
BLOCK = 64
STEP = BLOCK // 2


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case.

    `lower` also changes other letters, which no word of ours holds; it makes an ASCII letter only of the Kelvin sign, replaced before, and of a dotted capital I,
    which keeps its dot as a mark of its own. So no word becomes one of ours, or ceases to be one, that wouldn't by A-Z alone, at a tenth of the cost of `translate`.
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), F.lit(WORD), 0)


def blocks(w: Column) -> Column:
    """The windows of a word array: one for a text of at most BLOCK words."""
    last = F.greatest(F.ceil((F.size(w) - STEP) / STEP), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * STEP + 1, F.lit(BLOCK)))


def _listed(templates: dict, share: float) -> list[tuple]:
    """(template, label, its distinct words, how many are needed, words that must be there, words that must not)."""
    flat = [(label, *t) for label, ts in templates.items() for t in ts]
    for label, text, *_ in flat:
        if len(text.split()) > STEP:
            raise ValueError(f"a template of {label} is longer than {STEP} words")
    of = lambda s: sorted(set(s.split()))
    return [(i, label, of(text), math.ceil(share * len(of(text)) - 1e-9), of(must), of(but)) for i, (label, text, must, but) in enumerate(flat)]


def _array(items) -> Column:
    return F.array(*[F.lit(x) for x in sorted(items)]).cast("array<string>")


def places(w: Column, phrase: str) -> Column:
    """The positions in a word array at which a phrase starts."""
    ws = phrase.split()
    here = lambda i: _all([F.get(w, i + k) == x for k, x in enumerate(ws)])
    empty = F.array().cast("array<int>")
    may = _all([F.array_contains(w, x) for x in sorted(ws, key=len)[-1:] + [ws[-1]]])
    return F.when(may, F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.coalesce(here(i), F.lit(False)))).otherwise(empty)


def _all(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out & x
    return out


def scanned(docs: DataFrame, text: str = "text", templates: dict | None = None, share: float = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """docs with `_row`, `_base` and `_n_words`, and (row, block, label, containment): every block of every text that meets a template.

    Words are taken from every text twice: for their document frequencies, and for phrases and blocks in one pass. Templates are a parameter
    of bounded size and are broadcast, as are the frequencies of their words; everything else stays distributed.
    """
    spark, listed = docs.sparkSession, _listed(templates or TEMPLATES, share)
    vocabulary = {w for _, _, ws, _, must, but in listed for w in [*ws, *must, *but]}
    # An order of all template words, rarest first, by document frequency.
    seen = docs.select(F.explode(F.array_intersect(words(F.col(text)), _array(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    known = {r["word"]: r["df"] for r in seen.collect()}  # a row for each word of the templates at most
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (known.get(w, 0), w)))}
    rank = lambda ws: sorted(order[w] for w in ws)
    sets = [(i, label, rank(ws), len(ws), need, rank(must), rank(but)) for i, label, ws, need, must, but in listed]
    prefixes = spark.createDataFrame([(i, r, n, need, at) for i, _, ranks, n, need, *_ in sets for at, r in enumerate(ranks[: n - need + 1])], "template int, rank int, n int, need int, at int")
    whole = spark.createDataFrame([(i, label, ranks, must, but) for i, label, ranks, _, _, must, but in sets], "template int, label string, of array<int>, must array<int>, but array<int>")
    first = {w for _, _, ws, need, *_ in listed for w in sorted(ws, key=order.get)[: len(ws) - need + 1]}
    place = F.from_json(F.lit(json.dumps(order)), "map<string,int>")
    w = F.col("_w")
    at = docs.withColumn("_w", words(F.col(text)))
    at = at.withColumns({f"_at{i}": places(w, p) for i, p in enumerate(PHRASES.values())})
    held = F.filter(F.transform(blocks(w), lambda b, i: F.struct(i.alias("block"), F.array_intersect(b, _array(vocabulary)).alias("w"))), lambda b: F.arrays_overlap(b.w, _array(first)))
    cols = [F.col(f"_at{i}") for i in range(len(PHRASES))]
    tags = F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in zip(PHRASES, cols, strict=True)]), lambda x: x.isNotNull())
    every = F.concat(*cols)
    base = F.struct(F.size(every).cast("bigint").alias("n"), F.array_min(every).cast("bigint").alias("first"), F.array_max(every).cast("bigint").alias("last"), tags.alias("labels"))
    at = at.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.size(w).cast("bigint").alias("_n_words"), base.alias("_base"), F.when(F.arrays_overlap(w, _array(first)), held).alias("_blocks"))
    at = written(at.withColumn("_row", F.monotonically_increasing_id()))
    each = at.select(F.col("_row").alias("row"), F.explode("_blocks").alias("b")).select("row", "b.block", F.array_sort(F.transform("b.w", lambda x: F.element_at(place, x))).alias("ranks"))
    probes = each.select("row", "block", "ranks", F.posexplode("ranks").alias("pos", "rank"))
    enough = (F.size("ranks") >= F.col("need")) & (1 + F.least(F.col("n") - F.col("at") - 1, F.size("ranks") - F.col("pos") - 1) >= F.col("need") - F.least("at", "pos"))
    found = probes.join(F.broadcast(prefixes), "rank").where(enough).select("row", "block", "ranks", "template", "n", "need").distinct()
    both = found.join(F.broadcast(whole), "template").withColumn("shared", F.size(F.array_intersect("ranks", "of")))
    named = (F.size(F.array_intersect("ranks", "must")) == F.size("must")) & ~F.arrays_overlap("ranks", "but")
    return at.drop("_blocks"), both.where((F.col("shared") >= F.col("need")) & named).select("row", "block", "label", (F.col("shared") / F.col("n")).alias("containment"))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict | None = None, share: float = CONTAINMENT) -> DataFrame:
    """(key, block, label, containment): every block of every text that meets a template; block i begins at word i * STEP."""
    at, met = scanned(docs.select(key, text), text, templates, share)
    return met.join(at.select(key, "_row"), F.col("row") == F.col("_row")).select(key, "block", "label", "containment")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict | None = None, share: float = CONTAINMENT) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    A null or empty text has no words and no labels, score 0. score is 1 where a phrase stands, else the largest containment of a block that
    meets a template, else 0. Texts of any length are read whole. Every row has its own labels, repeated and null keys or not; equal texts have equal
    ones; labels are sorted, so ties don't arise. Other columns aren't read. An empty table gives no rows.
    """
    at, met = scanned(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "text", templates, share)
    per = met.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("share"))
    x = at.join(per, at["_row"] == per["row"], "left")
    base = F.col("_base.labels")
    return x.select(
        F.col("doc").alias(key), F.col("_n_words").alias("n_words"), F.col("_base.n").alias("n_base"), F.col("_base.first").alias("first_word"), F.col("_base.last").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("_base.n") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text."""
    return scan(table(spark, sf_dir, "documents"))


def op7_sql() -> str:
    """The same rows by comparing every block with every template."""
    lit = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    values = ", ".join(f"({i}, '{label}', {lit(ws)}, {need}, {lit(must)}, {lit(but)})" for i, label, ws, need, must, but in _listed(TEMPLATES, CONTAINMENT))
    hit = lambda p: " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
    ats = ", ".join(f"list_filter(range(0, len(w)), lambda i: coalesce({hit(p)}, false)) AS at{k}" for k, p in enumerate(PHRASES.values()))
    every = "list_concat(list_concat(at0, at1), at2)"
    tags = "list_filter([" + ", ".join(f"CASE WHEN len(at{k}) > 0 THEN '{x}' END" for k, x in enumerate(PHRASES)) + "], lambda x: x IS NOT NULL)"
    return rf"""
WITH t(template, label, ws, need, must, but) AS (VALUES {values}),
b AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {ats} FROM b),
l AS (SELECT doc_id, list_distinct(w[k * {STEP} + 1 : k * {STEP} + {BLOCK}]) AS w FROM (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - {STEP}) / {STEP}) AS BIGINT)))) AS k FROM b)),
m AS (SELECT doc_id, label, len(list_intersect(w, ws)) / len(ws) AS share FROM l, t WHERE len(list_intersect(w, ws)) >= need AND list_has_all(w, must) AND NOT list_has_any(w, but)),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM m GROUP BY doc_id)
SELECT p.doc_id, p.n_words, CAST(len({every}) AS BIGINT) AS n_base, CAST(list_min({every}) AS BIGINT) AS first_word, CAST(list_max({every}) AS BIGINT) AS last_word,
 coalesce(array_to_string(list_sort({tags}), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat({tags}, coalesce(more, [])))), ','), '') AS labels,
 CASE WHEN len({every}) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM p LEFT JOIN g USING (doc_id)
"""
