"""Secret scans with a random forest that removes false positives, in DataFrame operations only.

Candidates are long unbroken runs of the characters that keys are written with, and values of four or more characters that a secret's
name is assigned to. A name before '=' is context, not part of a candidate; parts joined by dots are one. Their features: length, transitions between kinds of
characters, how much of them words of the corpus cover, hints in the path, and the words beside them. A random forest trained on labelled findings, a table,
gives each the probability of a secret, and so removes false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import findings as labelled
from sheaf.llm.common import sampled, table, unused
from sheaf.session import written

MASK = "[SECRET]"
#: Kinds of words beside a candidate, and hints in a path; words end where letters do.
_WORD = r"(?i)(?<![a-z])(?:%s)(?![a-z])"
NAMED = _WORD % r"secrets?|token|passw(?:or)?d|passwd|pwd|api[_\-. ]?key|access[_\-. ]?key|private[_\-. ]?key|credentials?|auth|authorization|bearer|signature"
HARMLESS = _WORD % r"examples?|samples?|dummy|placeholder|fixture|mock|commit|checksum|digest|sha-?\d*|md5|uuid|guid|revision|hash|fingerprint|integrity|etag|version|object|build|image"
TRIAL = _WORD % r"tests?|examples?|samples?|fixtures?|mocks?|docs?|readme"
#: What stands between a name and its value.
ASSIGN = r"""\\?["'`]?\]?[ \t]{0,8}[:=]{1,2}>?[ \t]{0,8}\\?["'`]?"""
_SHORT, _LONG = r"[A-Za-z0-9+/_\-]{1,19}+(?![A-Za-z0-9+/_\-])", r"[A-Za-z0-9+/_\-]{20,}+"
#: A run of 20 or more, with shorter parts joined by dots before and between such runs, and '=' as padding only; not a name in letters that a value is assigned to.
_RUN = (
    r"(?<![A-Za-z0-9+/_\-])(?<![A-Za-z0-9+/_\-]\.)" + rf"(?=(?:{_SHORT}\.)*+{_LONG})(?![A-Za-z_.\-]++{ASSIGN}[^\s=])"
    rf"(?:{_SHORT}\.)*+{_LONG}(?:(?:\.{_SHORT})*+\.{_LONG})*+" + r"(?:={1,2}(?![\"'`]?[A-Za-z0-9+/_=\-]))?+"
)
#: A secret's name and what assigns; names such as author, tokens or token_count aren't a secret's.
_NAME = (
    r"(?i:secret|token(?!s|i[sz])|passw(?:or)?d|pwd|api[_\-. ]?key|access[_\-. ]?key|private[_\-. ]?key|credential|auth(?!or(?!i))|bearer|signature)"
    r"(?![_\-]?(?i:type|count|len|length|size|limit|name|url|uri|path|file|ttl|policy)\b)[\w\-]{0,20}"
)
#: The start of a value that a secret's name is assigned to, which is not itself a name with a value, a scheme or a variable.
_NAMED_VALUE = rf"(?<=[:=>\s\"'`])(?<=[:=]>?[ \t]{{0,8}}\\?[\"'`]?)(?<={_NAME}{ASSIGN})(?![=:>]|//|\$[A-Za-z{{(]|(?i:bearer|basic|token|digest)\s|[\w.\-]+=+[^\s=])"
_ENDS = r"\s\"'`\\<>()\[\]{},;&|"
#: Of the named values, quoted ones reach to the closing quote; others end before what ends a value in code, queries or prose, and aren't calls.
CANDIDATE = rf"{_NAMED_VALUE}(?<=[\"'`])[^\s\"'`\\]{{4,}}+(?=\\?[\"'`])|{_RUN}|{_NAMED_VALUE}(?:[^{_ENDS}.:?]|[.:?]++(?=[^{_ENDS}])){{4,}}+(?![(\[])"
FEATURES = ["length", "transitions", "digits", "capitals", "variety", "hex", "covered", "path_trial", "named", "assigned", "quoted", "harmless"]


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(key, text_hash, place, candidate, before, after, path): every candidate of every whole text, the `place`-th of its text, with up to 60 characters on either side
    (before it, those of the last candidate too, as that may be its name)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias(key), F.xxhash64(t).alias("text_hash"), (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"), t.alias("text"))
    found = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), 0)).where(F.size("found") > 0)
    cut = found.select(key, "text_hash", "path", "found", F.split("text", CANDIDATE, -1).alias("rest"))  # before the candidates are spread, or each would cut the text anew
    each = cut.select(key, "text_hash", "path", "found", "rest", F.posexplode("found").alias("place", "candidate"))
    beside = lambda i: F.get("rest", F.col("place") + i)
    return each.select(key, "text_hash", "place", "candidate", F.right(F.concat(F.coalesce(F.get(F.col("found"), F.col("place") - 1), F.lit("")), beside(0)), F.lit(60)).alias("before"), F.left(beside(1), F.lit(60)).alias("after"), F.coalesce("path", F.lit("")).alias("path"))


def dictionary(docs: DataFrame, text: str = "text", size: int = 400, least: int = 3) -> list[str]:
    """The `size` words (a fixed bound) of `least` or more letters that most documents of the whole table hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{%d,}" % least), 0))
    top = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return [r["w"] for r in top.collect()]


def beside(before: Column) -> Column:
    """The last three words before a candidate, apart at underscores and where capitals begin; addresses of mail and sites are no words."""
    ws = F.filter(F.split(F.trim(before), r"\s+"), lambda w: ~w.rlike("@|://[^=&]*$"))
    near = F.array_join(F.slice(ws, F.greatest(F.size(ws) - 2, F.lit(1)), F.lit(3)), " ")
    return F.regexp_replace(near, r"(?<=[a-z])(?=[A-Z])", "_")


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """found with a column for each of FEATURES."""
    c, n = F.col("candidate"), F.length("candidate")
    count = lambda p: F.regexp_count(c, F.lit(p))
    flag = lambda x: x.cast("double")
    longest = sorted((w for w in words if w.isalpha()), key=lambda w: (-len(w), w))
    bare = F.regexp_replace(F.lower(c), "|".join(longest), "") if longest else c
    near, before = beside(F.col("before")), F.col("before")
    made = {
        "length": n.cast("double"),
        "transitions": count(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "digits": count("[0-9]") / n,
        "capitals": count("[A-Z]") / n,
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "covered": 1 - F.length(bare) / n,
        "path_trial": flag(F.col("path").rlike(TRIAL)),
        "named": flag(near.rlike(NAMED)),
        "assigned": flag(before.rlike(r"""[:=]>?\s*\\?["'`]?$""")),
        "quoted": flag(before.rlike("[\"'`]$") & F.col("after").rlike("^\\\\?[\"'`]")),
        "harmless": flag(near.rlike(HARMLESS)),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()})


def train(findings: DataFrame, words: list[str], label: str = "label", max_findings: int = 20_000, trees: int = 40, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (the columns of `candidates`, and label 0 or 1); None where there isn't one of each label.

    max_findings bounds the distinct findings of either label that are learnt from: about so many, drawn by their hash. Other labels teach nothing.
    """
    known = findings.where(F.col(label).isin(0, 1)).select("candidate", "before", "after", "path", F.col(label).cast("double").alias("label")).distinct()
    some = reduce(DataFrame.union, [sampled(known.where(F.col("label") == y), max_findings, "candidate", "before", "after", "path") for y in (0.0, 1.0)])
    some = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(some, words)).select("features", "label")
    if some.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed).fit(some.coalesce(1))


def score(found: DataFrame, words: list[str], model: RandomForestClassificationModel | None) -> DataFrame:
    """found with `score`, the forest's probability of a secret (0 without a forest)."""
    if model is None:
        return found.withColumn("score", F.lit(0.0))
    x = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(found, words)))
    return x.select(*found.columns, vector_to_array("probability")[1].alias("score"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(key, text_hash, place, candidate, before, after, path, score, secret): every candidate of docs; secret where score is least or more.

    findings is a table of labelled findings; without one, those of `sheaf.llm.findings` are learnt from. Labels are read only there. Null and empty texts have no
    candidates; texts of any length are read whole; repeated rows give theirs each time, null keys are keys like others; equal findings have equal scores, and one of just `least`
    is a secret; columns beside the three named aren't read; an empty table gives no rows.
    """
    words = dictionary(docs, text)
    model = train(labelled.findings(docs.sparkSession) if findings is None else findings, words)
    return score(written(candidates(docs, key, text, path)), words, model).withColumn("secret", F.col("score") >= least)


def masked(text: Column, places: Column) -> Column:
    """text with its candidates at places masked; the same characters elsewhere stay."""
    here = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), 0), lambda c, i: F.when(F.array_contains(places, i), F.lit(MASK)).otherwise(c))
    return F.array_join(F.zip_with(F.split(text, CANDIDATE, -1), here, lambda rest, c: F.concat(rest, F.coalesce(c, F.lit("")))), "")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (distinct, sorted, comma-joined), max_score of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    each = written(scan(docs).groupBy("doc_id", "text_hash", "path", "place").agg(F.max("candidate").alias("candidate"), F.max("score").alias("score"), F.bool_or("secret").alias("secret")))
    per = each.groupBy(F.col("doc_id").alias("_doc"), "text_hash", "path").agg(
        F.count("*").alias("n_candidates"), F.count_if("secret").alias("n_secrets"), F.array_sort(F.collect_set(F.when(F.col("secret"), F.col("candidate")))).alias("s"), F.max("score").alias("max_score"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("p"))
    x = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("text_hash")) & (F.col("p") == F.col("path")), "left")
    zero = F.lit(0).cast("bigint")
    return x.select("doc_id", F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_secrets", zero).alias("n_secrets"), F.coalesce(F.array_join("s", ","), F.lit("")).alias("secrets"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the secrets in their texts masked where they stand, and n_chars to match; rows without a secret as they are.

    Null and empty texts stay as they are, as do rows with null ids but for their own secrets; each text of a repeated id is masked by its own findings, repeated rows alike.
    Texts are read whole; the columns are those of docs, whatever their names; an empty table stays empty. Only texts with a candidate take part in the
    join with the findings.
    """
    d, h, at = (unused(n, docs) for n in ("_doc", "_hash", "_places"))
    per = scan(docs).where("secret").groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).agg(F.collect_set("place").alias(at))
    some = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    per = written(per)
    x = docs.where(some).join(per, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left")
    new = F.when(F.col(at).isNotNull(), masked(F.col("text"), F.col(at))).otherwise(F.col("text"))
    changed = x.withColumn("text", new).withColumn("n_chars", F.when(F.col(at).isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.where(~some).select(columns).union(changed.select(columns))
