"""What training moves of a large table of texts."""

from sheaf.llm import quality


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Once both tables were large, all texts were shuffled to find a sample of some thousands."""
    docs = spark.createDataFrame([(i, f"some text {i} " * 9) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id bigint, quality int")
    plans, kept = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), kept(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        quality.train(docs, labels)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = next(p for columns, p in plans if "text" in columns)
    assert "BroadcastHashJoin [k" in plan
