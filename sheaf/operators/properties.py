"""Material properties from technical sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Property, names before the number, units after it (None: the constant %), matched name.
NUMBER = r"(\d+\.?\d*)"
PATTERNS = [
    ("Tg", r"(?i)(?:Glass Transition|Tg)[\s:]+(-?\d+\.?\d*)\s*°?\s*([CF℃])", "Glass Transition Temperature"),
    ("Tm", r"(?i)(?:Melting|Tm)[\s:]+" + NUMBER + r"\s*°?\s*([CF℃])", "Melting Temperature"),
    ("Td", r"(?i)(?:Decomposition|Td)[\s:]+" + NUMBER + r"\s*°?\s*([CF℃])", "Decomposition Temperature"),
    ("DC", r"(?i)(?:Crystallinity|DC)[\s:]+" + NUMBER + r"\s*(%)", "Degree of Crystallinity"),
    ("YS", r"(?i)(?:Yield Strength|YS)[\s:]+" + NUMBER + r"\s*(MPa|GPa|psi)", "Yield Strength"),
    ("YM", r"(?i)(?:Young's Modulus|YM)[\s:]+" + NUMBER + r"\s*(MPa|GPa|psi)", "Young's Modulus"),
    ("Tensile_Strength", r"(?i)Tensile Strength[\s:]+" + NUMBER + r"\s*(MPa|GPa|psi)", "Tensile Strength"),
    ("Elongation_Rate", r"(?i)Elongation[\s:]+" + NUMBER + r"\s*(%)", "Elongation Rate"),
    ("Density", r"(?i)Density[\s:]+" + NUMBER + r"\s*(g/cm³|kg/m³)", "Density"),
    ("Thermal_Conductivity", r"(?i)Thermal Conductivity[\s:]+" + NUMBER + r"\s*(W/m·K|W/mK)", "Thermal Conductivity"),
]


def detect(docs: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """(key, property, value, unit, matched_name, extraction_method), distinct (D1). One literal pattern for each property, in one scan."""
    one = lambda p, rx, name: F.transform(
        F.arrays_zip(F.regexp_extract_all(content, F.lit(rx), 1).alias("v"), F.regexp_extract_all(content, F.lit(rx), 2).alias("u")),
        lambda z: F.struct(F.lit(p).alias("property"), z.v.try_cast("double").alias("value"), z.u.alias("unit"), F.lit(name).alias("matched_name")),
    )
    found = docs.select(key, F.explode(F.array_distinct(F.concat(*[one(*p) for p in PATTERNS]))).alias("p"))
    return found.select(key, "p.*", F.lit("regex").alias("extraction_method")).where("value is not null")


def merge_model_first(model: DataFrame, regex: DataFrame, key: str = "document_id", order: str = "ord") -> DataFrame:
    """The last model row of each property, and regex rows for properties the model lacks."""
    last = model.groupBy(key, "property").agg(F.max_by(F.struct("value", "unit"), order).alias("r")).select(key, "property", "r.*", F.lit("model").alias("source"))
    rest = regex.join(last, [key, "property"], "left_anti").select(key, "property", "value", "unit", F.lit("regex").alias("source"))
    return last.unionByName(rest)


def merge_regex_first(regex: DataFrame, model: DataFrame, key: str = "document_id") -> DataFrame:
    """Regex rows, and model rows whose normalised name is new."""
    norm = F.regexp_replace(F.lower("property"), r"[_\-\s]", "")
    new = model.withColumn("_n", norm).join(regex.select(key, norm.alias("_n")).distinct(), [key, "_n"], "left_anti").drop("_n")
    return regex.select(key, "property", "value", "unit", F.lit("regex").alias("source")).unionByName(new.select(key, "property", "value", "unit", F.lit("model").alias("source")))


def wide(props: DataFrame, names: list[str], key: str = "document_id", order: str = "ord") -> DataFrame:
    """A row for each document with {property}_value and {property}_unit, the last by order."""
    col = {n: n.lower().replace(" ", "_").replace("(", "").replace(")", "") for n in names}
    last = lambda n, c: F.max_by(F.when(F.col("property") == n, F.col(c)), F.when(F.col("property") == n, F.col(order)))
    return props.groupBy(key).agg(*[x for n in names for x in (last(n, "value").alias(f"{col[n]}_value"), last(n, "unit").alias(f"{col[n]}_unit"))])


def long(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Wide value columns back to (key, property, value), without nulls."""
    cols = [c for c in rows.columns if c.endswith("_value")]
    return rows.select(key, *[F.col(c).cast("double").alias(c[:-6]) for c in cols]).unpivot([key], [c[:-6] for c in cols], "property", "value").where("value is not null")


def summary(docs: DataFrame, props: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents, properties, mean of these, documents with fewer than three."""
    n = docs.select(key).join(props.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.count("*").alias("documents"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") < 3).alias("few"))


def needs_review(docs: DataFrame, props: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """(key, review, reason): no rows; few for the text's lines; no core property and fewer than five."""
    core = reduce(lambda a, b: a | b, [F.col("property") == p for p in ("Tg", "Tm", "YS")])
    g = props.groupBy(key).agg(F.count("*").alias("n"), F.count_if(core).alias("core"))
    x = docs.select(key, F.size(F.split(content, "\n")).alias("lines")).join(g, key, "left").fillna(0, ["n", "core"])
    expected = F.greatest(F.lit(3), F.floor(F.col("lines") / 20))
    reason = F.when(F.col("n") == 0, "none").when(F.col("n") / expected < 0.3, "few").when((F.col("core") == 0) & (F.col("n") < 5), "core")
    return x.select(key, reason.isNotNull().alias("review"), F.coalesce(reason, F.lit("")).alias("reason"))


def unknown(docs: DataFrame, known: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """(key, property, value, unit): `name: number unit` whose name isn't among the matched ones of its document (D3). known: (key, matched_name)."""
    rx = r"([A-Za-z가-힣][A-Za-z가-힣\s]+?)\s*[:：=]\s*([0-9.]+)[^\S\n]*([A-Za-z/²³·℃°%]+)?"
    part = lambda i: F.regexp_extract_all(content, F.lit(rx), i)
    z = F.arrays_zip(part(1).alias("n"), part(2).alias("v"), part(3).alias("u"))
    x = docs.select(key, F.explode(z).alias("z")).select(key, F.trim(F.regexp_replace("z.n", r"\s+", " ")).alias("matched_name"), F.col("z.v").try_cast("double").alias("value"), F.coalesce("z.u", F.lit("")).alias("unit"))
    new = x.where((F.length("matched_name") <= 50) & F.col("value").isNotNull()).join(known.select(key, "matched_name"), [key, "matched_name"], "left_anti")
    return new.select(key, F.concat(F.lit("Unknown_"), F.replace("matched_name", F.lit(" "), F.lit("_"))).alias("property"), "value", "unit")


#: A shorter, looser set of patterns.
LOOSE = [("Tg", r"(?i)Tg.*?(\d+\.?\d*)\s*°?\s*([CF])"), ("Tm", r"(?i)Tm.*?(\d+\.?\d*)\s*°?\s*([CF])"), ("YS", r"(?i)YS.*?(\d+\.?\d*)\s*(MPa|GPa)"), ("Density", r"(?i)Density.*?(\d+\.?\d*)\s*(g/cm³|kg/m³)")]


def detect_loose(docs: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """(key, property, value, unit) by patterns that allow any text before the number, repeats kept."""
    one = lambda p, rx: F.transform(F.arrays_zip(F.regexp_extract_all(content, F.lit(rx), 1).alias("v"), F.regexp_extract_all(content, F.lit(rx), 2).alias("u")), lambda z: F.struct(F.lit(p).alias("property"), z.v.try_cast("double").alias("value"), z.u.alias("unit")))
    return docs.select(key, F.explode(F.concat(*[one(*p) for p in LOOSE])).alias("p")).select(key, "p.*")


#: Properties and their names, in the order in which they are looked for.
NAMES = {
    "Tg": ["Tg", "유리전이온도", "Glass Transition", "유리 전이 온도", "Glass Transition Temperature"],
    "Tm": ["Tm", "용융온도", "Melting Temperature", "Melting Point", "TDS", "LDS", "Tm(TDS/LDS)"],
    "Td": ["Td", "열분해온도", "Decomposition Temperature", "Td(TDS/LDS)"],
    "DC": ["DC", "유전상수", "Dielectric Constant"],
    "Eg": ["Eg", "에너지 밴드갭", "Energy Band Gap", "Band Gap"],
    "PL": ["PL", "Photoluminescence"],
    "YS": ["YS", "항복강도", "Yield Strength"],
    "YM": ["YM", "영률", "Young's Modulus", "Modulus", "Elastic Modulus"],
    "BS": ["BS", "굽힘강도", "Bending Strength", "Flexural Strength"],
    "He_permeability": ["He투과율", "He 투과율", "He barrier", "He permeability", "He"],
    "H2_permeability": ["H2투과율", "H2 투과율", "H2 barrier", "H2 permeability", "H2"],
    "O2_permeability": ["O2투과율", "O2 투과율", "O2 barrier", "O2 permeability", "O2"],
    "N2_permeability": ["N2투과율", "N2 투과율", "N2 barrier", "N2 permeability", "N2"],
    "CO2_permeability": ["CO2투과율", "CO2 투과율", "CO2 barrier", "CO2 permeability", "CO2"],
    "CH4_permeability": ["CH4투과율", "CH4 투과율", "CH4 barrier", "CH4 permeability", "CH4"],
    "Viscosity": ["점도", "Viscosity"],
    "Hardness": ["Hardness", "Shore A", "Shore D", "경도"],
    "Tensile_Strength": ["Tensile Strength", "인장강도", "Tensile"],
    "Elongation_Rate": ["Elongation Rate", "연신율", "Elongation"],
    "Thixotropic_index": ["Thixotropic index", "요변지수", "Thixotropy"],
    "HDT": ["HDT", "Heat Deflection Temperature", "열변형온도"],
    "Thermal_Conductivity": ["Thermal Conductivity", "열전도도", "열전도율"],
    "Density": ["Density", "밀도", "비중"],
}


def _first_named(text: Column, names: list[str]) -> Column:
    """struct(value, unit, matched_name) of the first name that has a number after it: behind a colon, a space, or brackets."""
    number, unit = r"([0-9.]+)", r"\s*([^\s,;]+)?"
    tries = []
    for n in names:
        for between in (r"\s*[:：=]\s*", r"\s+", r"\s*\([^)]*\)\s*[:：=]?\s*"):
            rx = rf"(?iu)\Q{n}\E{between}{number}{unit}"
            value, u = F.regexp_extract(text, rx, 1).try_cast("double"), F.regexp_extract(text, rx, 2)
            shown = F.when(u.rlike(r"[\p{L}\p{N}/·²³°℃%]"), u).otherwise("")
            tries.append(F.when(F.contains(F.lower(text), F.lit(n.lower())) & value.isNotNull(), F.struct(value.alias("value"), shown.alias("unit"), F.lit(n).alias("matched_name"))))
    return F.coalesce(*tries)


def detect_named(docs: DataFrame, more: dict[str, list[str]] | None = None, key: str = "document_id", content: str = "content") -> DataFrame:
    """(key, property, value, unit, matched_name): the first value of each property of a dictionary of names (D2), which `more` extends.

    A property's names are tried in order. A unit without a letter, digit or unit sign is dropped.
    """
    every = NAMES | (more or {})
    found = F.array(*[F.struct(F.lit(p).alias("property"), _first_named(F.col(content), ns).alias("f")) for p, ns in every.items()])
    return docs.select(key, F.explode(F.filter(found, lambda z: z.f.isNotNull())).alias("p")).select(key, "p.property", "p.f.*")
