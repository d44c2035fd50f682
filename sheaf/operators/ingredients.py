"""Ingredients of safety sheets: identifiers, concentrations, and the share of each in a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What stands for "not disclosed".
HIDDEN = ["비공개", "미공개", "공개안함", "공개하지않음", "not disclosed", "not available", "confidential", "proprietary", "n/a", "na", "n.a.", "none", "-", "—", "–"]
CAS = r"^\d{1,7}-\d{2}-\d$"
RANGE, BELOW, EQUAL = r"^\s*[~≈]?\s*(\d+(?:\.\d+)?)\s*[-–~]\s*(\d+(?:\.\d+)?)\s*%?\s*$", r"^\s*[<≤]\s*(\d+(?:\.\d+)?)\s*%?\s*$", r"^\s*(\d+(?:\.\d+)?)\s*%?\s*$"


def cas(value: Column, exact: bool = False) -> Column:
    """A CAS number as it is; 비공개 for missing and undisclosed ones (any text that holds one of the tokens, or with `exact` the tokens alone); else as given."""
    v = F.trim(value)
    hidden = F.lower(v).isin(HIDDEN) if exact else F.exists(F.array(*[F.lit(x) for x in HIDDEN]), lambda t: F.contains(F.lower(v), t))
    return F.when(v.isNull() | (v == ""), HIDDEN[0]).when(v.rlike(CAS), v).when(hidden, HIDDEN[0]).otherwise(v)


def concentration(raw: Column) -> Column:
    """struct(value, min, max, op_min, unit) of a raw concentration: a range, an upper bound (which is a range from 0), a number."""
    r = F.coalesce(raw, F.lit(""))
    num = lambda p, i: F.regexp_extract(r, p, i).try_cast("double")
    ranged, below, equal = r.rlike(RANGE), r.rlike(BELOW), r.rlike(EQUAL)
    return F.struct(
        F.when(equal, num(EQUAL, 1)).alias("value"),
        F.when(ranged, num(RANGE, 1)).when(below, 0.0).alias("min"),
        F.when(ranged, num(RANGE, 2)).when(below, num(BELOW, 1)).alias("max"),
        F.when(below, "<").alias("op_min"),
        F.when(ranged | below | equal, "%").alias("unit"),
    )


def unit_basis(unit: Column, basis: Column, text: Column) -> Column:
    """struct(unit, basis): the basis that the unit states, else the given one, else one the text states."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    own = F.when(u.contains("w/w") | u.contains("wt%") | u.contains("중량"), "w/w").when(u.contains("v/v") | u.contains("부피"), "v/v")
    said = F.when(text.rlike(r"(?i)중량\s*%|wt\s*%|w/w\s*%|%\s*\(\s*w\s*/\s*w\s*\)"), "w/w").when(text.rlike(r"(?i)부피\s*%|v/v\s*%|%\s*\(\s*v\s*/\s*v\s*\)"), "v/v")
    return F.struct(F.when(own.isNotNull(), "%").otherwise(F.nullif(unit, F.lit(""))).alias("unit"), F.coalesce(own, F.nullif(basis, F.lit("")), said).alias("basis"))


def synonyms(s: Column) -> Column:
    """Synonyms split at ; , / | and line ends, trimmed, distinct in order."""
    parts = F.flatten(F.transform(s, lambda x: F.split(F.coalesce(x, F.lit("")), r"[;,/|\n]+")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def rebuilt_raw(raw: Column, low: Column, high: Column, value: Column, unit: Column) -> Column:
    """The raw text from its parts where it is null."""
    n = lambda c: c.cast("bigint").cast("string")
    u = F.coalesce(unit, F.lit(""))
    return F.coalesce(raw, F.when(low.isNotNull() & high.isNotNull(), F.concat(n(low), F.lit("-"), n(high), u)).when(value.isNotNull(), F.concat(n(value), u)))


def confidential(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """is_cas_secret and is_conc_secret by exact token; a secret concentration's raw becomes 영업 비밀."""
    t = [x.lower() for x in (tokens or ["영업 비밀", "영업비밀", "비공개", "미공개", "자료 없음", "confidential", "trade secret"])]
    hide = F.lower(F.trim(F.col("raw"))).isin(t)
    return df.withColumns({"is_cas_secret": F.coalesce(F.lower(F.trim("cas")).isin(t), F.lit(False)), "is_conc_secret": F.coalesce(hide, F.lit(False)), "raw": F.when(hide, F.lit("영업 비밀")).otherwise(F.col("raw"))})


def to_hundred(df: DataFrame, product: str = "product_id", c: str = "c") -> DataFrame:
    """df with conc_adjusted: shares of a product that come to 100.

    Fixed values stay. Ranges get their middle, scaled to what fixed values leave. What then remains goes to rows with a lower bound only, by
    (min + 100) / 2, then to rows with an upper bound only, by max / 2. Secret rows without a range, and rows with neither, get null.
    """
    f = lambda x: F.col(f"{c}.{x}")
    secret = F.col("is_conc_secret") if "is_conc_secret" in df.columns else F.lit(False)
    op_max = f("op_max") if "op_max" in df.select(f"{c}.*").columns else F.lit(None).cast("string")
    kind = (
        F.when(secret & ~(f("min").isNotNull() & f("max").isNotNull()), F.lit(None)).when(f("value").isNotNull(), "fixed").when(f("min").isNotNull() & f("max").isNotNull(), "range")
        .when(f("min").isNotNull() & f("op_min").isin(">", ">="), "lower").when(f("max").isNotNull() & op_max.isin("<", "<="), "upper")
    )
    w = W.partitionBy(product)
    total = lambda k, x: F.coalesce(F.sum(F.when(F.col("_kind") == k, x)).over(w), F.lit(0.0))
    mid, low, up = (f("min") + f("max")) / 2, (f("min") + 100) / 2, f("max") / 2
    x = df.withColumn("_kind", kind).withColumns({"_fixed": total("fixed", f("value")), "_mid": total("range", mid), "_low": total("lower", low), "_up": total("upper", up)})
    room = F.greatest(F.lit(0.0), 100 - F.col("_fixed"))
    x = x.withColumn("_range", F.when(F.col("_kind") == "range", F.round(mid * F.when(F.col("_mid") > 0, room / F.col("_mid")).otherwise(1.0), 4)))
    x = x.withColumn("_left", F.greatest(F.lit(0.0), 100 - F.col("_fixed") - F.coalesce(F.sum("_range").over(w), F.lit(0.0))))
    share = lambda k, part, whole, left: F.when((F.col("_kind") == k) & (left > 0) & (F.col(whole) > 0), F.round(part * left / F.col(whole), 4))
    x = x.withColumn("_lower", share("lower", low, "_low", F.col("_left")))
    x = x.withColumn("_left", F.greatest(F.lit(0.0), F.col("_left") - F.coalesce(F.sum("_lower").over(w), F.lit(0.0))))
    out = F.coalesce(F.when(F.col("_kind") == "fixed", F.round(f("value"), 4)), F.col("_range"), F.col("_lower"), share("upper", up, "_up", F.col("_left")))
    return x.withColumn("conc_adjusted", out).drop("_kind", "_fixed", "_mid", "_low", "_up", "_range", "_left", "_lower")


#: Names of fields in answers, what stands for no data.
ALIASES = {"화학물질명": "name", "관용명": "common_name", "카스 번호": "cas", "카스번호": "cas", "CAS": "cas", "CAS No": "cas", "함유량 (%)": "concentration", "함유량(%)": "concentration", "함유량": "concentration", "농도": "concentration"}
NO_DATA = ["자료 없음 .", "자료없음", "-", ""]


def component(m: Column) -> Column:
    """struct(maker, product, name, cas, concentration) of an answer's map: the Korean key, else the English one, else a default."""
    pick = lambda ko, en, default: F.trim(F.coalesce(m[ko], m[en], F.lit(default)))
    return F.struct(
        pick("제조사", "manufacturer", "").alias("maker"), pick("제품명", "product_name", "").alias("product"), pick("화학물질명", "chemical_name", "").alias("name"),
        pick("CAS", "cas_number", "비공개").alias("cas"), pick("함량(%)", "concentration", "미공개").alias("concentration"))


def standard(m: Column) -> Column:
    """struct(name, common_name, cas, concentration) of a map under any of the known field names; tokens for no data are null."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    out = F.transform_keys(m, lambda k, v: F.coalesce(F.try_element_at(names, F.trim(k)), F.trim(k)))
    of = lambda k: F.when(~F.trim(out[k]).isin(NO_DATA), out[k])
    return F.struct(of("name").alias("name"), of("common_name").alias("common_name"), F.replace(of("cas"), F.lit(" "), F.lit("")).alias("cas"), of("concentration").alias("concentration"))


def simple_concentration(raw: Column) -> Column:
    """struct(value, min, max, raw): a range, a number, or the text as it is."""
    s = F.trim(raw)
    ranged, number = r"^(\d+(?:\.\d+)?)\s*[-~–—−]\s*(\d+(?:\.\d+)?)\s*[%％]?$", r"^(\d+(?:\.\d+)?)\s*[%％]?$"
    num = lambda p, i: F.regexp_extract(s, p, i).try_cast("double")
    return F.struct(num(number, 1).alias("value"), num(ranged, 1).alias("min"), num(ranged, 2).alias("max"), F.when(~s.rlike(ranged) & ~s.rlike(number), s).alias("raw"))


def answer_rows(answer: Column) -> Column:
    """Components of a model's answer as maps: fenced JSON, the longest bracketed list, the whole text, or an object."""
    x = F.translate(answer, "“”", '""')
    x = F.regexp_replace(F.regexp_replace(x, r"}\s*,\s*,\s*\{", "},{"), r",\s*\]", "]")
    fenced, listed = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(x, r"(?s)\[.*\]", 0)
    rows = lambda s: F.from_json(F.nullif(s, F.lit("")), "array<map<string,string>>")
    good = lambda s: F.when(F.trim(s).startswith("["), rows(F.trim(s)))
    one = F.from_json(F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit("")), "map<string,string>")
    return F.coalesce(good(fenced), good(listed), F.array(one))


def mixture(name: Column, synonym: Column) -> Column:
    """struct(name, synonym): `mixture` is named 혼합물, with Mixture as its first synonym."""
    is_mix = F.lower(F.trim(name)) == "mixture"
    others = F.array_remove(synonym, "Mixture")
    return F.struct(F.when(is_mix, "혼합물").otherwise(name).alias("name"), F.when(is_mix, F.concat(F.array(F.lit("Mixture")), others)).otherwise(synonym).alias("synonym"))


def load_check(stored: DataFrame, sources: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """(field, n, found, rate): the share of stored values (key, field, value) that stand verbatim in their source."""
    x = stored.select(key, "field", "value").distinct().join(sources.select(key, content), key, "left")
    g = x.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.contains(content, F.col("value")), F.lit(False))).alias("found"))
    return g.withColumn("rate", F.round(F.col("found") / F.col("n"), 6))


def table_rows(inner: Column) -> Column:
    """The JSON inside of a table tag as an array of maps: objects in a row, a list, or one object; curly quotes and stray commas are mended."""
    x = F.regexp_replace(F.translate(F.trim(inner), "“”‘’", "\"\"''"), r"\}\s*(?:,\s*)*\{", "},{")
    x = F.regexp_replace(F.regexp_replace(x, r",\s*\]$", "]"), r"^[,\s]+|[,\s]+$", "")
    return F.from_json(F.when(x.startswith("["), x).otherwise(F.concat(F.lit("["), x, F.lit("]"))), "array<map<string,string>>")


def marked(text: Column, keywords: Column, loose: bool = False) -> Column:
    """text with its keywords in <mark>, longer ones first, case as given: whole words only, or with `loose` wherever they stand."""
    longest = F.array_sort(F.array_distinct(F.filter(keywords, lambda k: F.trim(k) != "")), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    either = F.array_join(F.transform(longest, lambda k: F.regexp_replace(k, r"([^\p{L}\p{N}\s])", r"\\$1")), "|")
    rx = F.concat(F.lit("("), either, F.lit(")")) if loose else F.concat(F.lit(r"(?<![\p{L}\p{N}_])("), either, F.lit(r")(?![\p{L}\p{N}_])"))
    return F.when(F.size(longest) > 0, F.regexp_replace(text, rx, F.lit("<mark>$1</mark>"))).otherwise(text)
