"""Terms counted in their row, and batches of texts within bounds."""

import random

from pyspark.sql import functions as F

from sheaf.operators import search, splits


def test_terms_of_words(spark):
    r = random.Random(4)
    ends = [e[0].replace("\u0001", "") for step in search.PORTER for e in step]
    words = ["".join(r.choice("abeilnstuyz") for _ in range(r.randint(0, 5))) + r.choice(ends) + r.choice(["", "ed", "ing", "s"]) for _ in range(800)] + ["ñan", "a1", "x", "번호판", "sky", "hopping"]
    words = sorted({w for w in words if w})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", search.analysed(F.col("w")).alias("t")).collect()
    assert {x.w: sorted((t.chain, t.term) for t in x.t) for x in got} == {w: sorted(search.terms_of(w)) for w in words}


def test_only_texts_are_shuffled(spark):
    """Words were shuffled three times, and terms, nine for a word, once more."""
    d = spark.createDataFrame([(1, "Rings ring"), (1, "ring"), (2, None), (3, ""), (None, "a")], "k bigint, text string")
    df = search.term_counts(d)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert {(x.k, x.term): x.n for x in df.where("chain = 'en'").collect()} == {(1, "ring"): 3, (None, "a"): 1}


def test_batches_of_pieces_are_bounded(spark):
    """Batches of 10,000 whole texts went to Python."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert splits.split_large(spark.createDataFrame([("1", "a. " * 400)], "chunk_id string, content string")).count() > 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
