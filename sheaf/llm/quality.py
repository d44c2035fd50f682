"""Quality classification by compression: zstandard dictionaries of good and bad text.

A text is compressed in blocks under a dictionary trained on good texts and under one trained on bad texts. The difference
of the two sizes, by their sum, is a score; logistic regression on labelled texts that the dictionaries have not seen
turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import chance, fold, python_ready, table, unused

SCORED = "struct<difference:double,score:double>"
BLOCK = 2048


@dataclass
class QualityModel:
    """The two dictionaries, and the calibration score = 1 / (1 + exp(-(slope * difference + offset)))."""

    good: bytes
    bad: bytes
    slope: float = 1.0
    offset: float = 0.0
    level: int = 3

    def compressors(self) -> list:
        if not hasattr(self, "_made"):
            kinds = [zstandard.ZstdCompressionDict(d) for d in (self.good, self.bad)]
            for d in kinds:
                d.precompute_compress(level=self.level)
            self._made = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False) for d in kinds]
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def difference(self, text: str) -> float:
        """(size under bad - size under good) by their sum: between -1 and 1, larger for text like the good; 0 for no text."""
        raw = text.encode("utf-8", "replace")
        if not raw:
            return 0.0
        good, bad = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in self.compressors())
        return (bad - good) / (bad + good)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -30, 30)))


def dictionary(texts: list[str], size: int) -> bytes:
    """A dictionary of blocks of texts; their last bytes as they are, where there are too few for training."""
    blocks = [b[i : i + BLOCK] for b in (t.encode("utf-8", "replace") for t in texts) for i in range(0, len(b), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:].rjust(8, b" ")


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic regression of y on x with a small ridge, by Newton steps on scaled x."""
    if not len(x) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return 0.0, float(np.log(share / (1 - share)))
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.01 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -4, 4)
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_texts: int = 3000, max_bytes: int = 8 << 20, size: int = 112 * 1024) -> QualityModel:
    """A model from the texts of docs whose label is 1 (good) or 0 (bad).

    About max_texts labelled texts of either class are learnt from, and fewer where these have more than about max_bytes bytes: those whose `chance` by key
    is smallest, so that neither their place nor their length decides. Two thirds make the dictionaries, a third the calibration; they alone come to
    the driver. Other labels and null texts teach nothing; where a key has several labels, the largest counts. With one class or none, every score is
    the share of that class, smoothed.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    sizes = rows.select("k", F.octet_length("text").alias("b")).join(known, "k").groupBy("y").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()
    share = {r["y"]: min(1.0, max_texts / r["n"], max_bytes / max(r["b"], 1)) for r in sizes}
    # Only ids are shuffled to find the sample, about 2 * max_texts rows, which is sent to the texts.
    low = F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    some = rows.select("k").where(chance("k") < max(share.values(), default=0.0)).distinct().join(known, "k").where(chance("k") < low)
    found = rows.join(F.broadcast(some), "k").select("y", "text", (F.abs(F.xxhash64(F.col("k"), F.lit("part"))) % 3 == 0).alias("held")).orderBy("y", "held", "text").collect()
    texts = {(y, held): [r["text"] for r in found if (r["y"], r["held"]) == (y, held)] for y in (0, 1) for held in (False, True)}
    m = QualityModel(dictionary(texts[1, False], size), dictionary(texts[0, False], size))
    held = [(m.difference(t), y) for y in (0, 1) for t in texts[y, True]]
    x, y = np.array([a for a, _ in held]), np.array([float(b) for _, b in held])
    m.slope, m.offset = calibrate(x, y)
    return m


def _scored(model):
    def run(texts: pa.Array) -> pa.Array:
        m = model.value
        d = np.array([m.difference(x.as_py() or "") for x in texts], np.float64)
        return pa.StructArray.from_arrays([pa.array(d), pa.array(m.score(d))], ["difference", "score"])

    return run


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with a column `out`: struct(difference, score between 0 and 1, higher for text like the good).

    A null or empty text has difference 0. Texts of any length are compressed whole. Repeated rows get equal scores, as do all texts under a model of one
    class or none; an existing column `out` is replaced, others stay whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    python_ready(spark)
    return docs.withColumn(out, F.arrow_udf(_scored(spark.sparkContext.broadcast(model)), SCORED)(F.col(text)))


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    labels = table(spark, sf_dir, "labels")
    return train(docs, labels.where(fold("doc_id", 3) != 1))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; learns labels from rows whose fold of three is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("quality_score.score")
    return score(docs, _model(spark, docs, sf_dir)).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that score 0.5 or more, with the columns of docs whatever their names.

    The model learns from the texts of docs that `labels` knows, outside the fold that op4_quality holds out. A null or empty text, of which nothing is known, has
    the score of a difference of 0. Texts are scored whole, equal ones alike, so repeated rows stay or go together; a score of just 0.5 stays. Null ids
    teach nothing and are scored like others. An empty table stays empty.
    """
    s = unused("_quality", docs)
    return score(docs, _model(spark, docs, sf_dir), out=s).where(F.col(f"{s}.score") >= 0.5).drop(s)
