"""The registered queries, and the SQL that gives the same rows."""

from __future__ import annotations

import html as entities
from functools import partial
from html.entities import html5

from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.operators import chunk, components, graph, ingredients, keyword_index, layout, properties, records, search, spans, tables, upsert, zones
from sheaf.plans.fixtures import spark_fixture, with_fixtures
from sheaf.session import folder

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *fixtures: str):
    """Registers f(t, x), where t reads a given table and x a fixture, under name."""

    def add(f):
        _QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), partial(spark_fixture, spark, sf_dir))
        if sql:
            _SQL[name] = with_fixtures(sql, *fixtures)
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark, sf_dir):
    """Documents to postings to the best ten by BM25 for each question, as citations by source."""
    return _QUERIES["F19"](spark, sf_dir)


joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")


# Loads and merges


@query("A2", "SELECT doc_id, n_chars FROM documents WHERE source = 'src3'")
def a2(t, x):
    return t("documents").where("source = 'src3'").select("doc_id", "n_chars")


@query("A6", "SELECT doc_id, 'batch_' || CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1 AS VARCHAR) AS batch_id FROM documents")
def a6(t, x):
    return upsert.batches(t("documents").select("doc_id"), "doc_id")


@query("A7", "SELECT doc_id, lower(c) AS collection, 'u' || CAST(doc_id AS VARCHAR) || '_0' AS doc_key FROM (SELECT doc_id, unnest([upper(source), lang]) AS c FROM documents)")
def a7(t, x):
    d = t("documents").select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("file_uuid"), F.lit(0).alias("idx"), F.array(F.upper("source"), "lang").alias("collections"))
    return upsert.fan_out(d).select("doc_id", "collection", "doc_key")


def _merged(batches, keys, add):
    """A zone that the batches are merged into one after the other."""
    spark, at = batches[0].sparkSession, folder(batches[0].sparkSession)
    for b in batches:
        zones.merge(b, at, keys, add)
    return zones.read(spark, at, ", ".join(f"{n} {t}" for n, t in batches[0].dtypes))


_UPSERT = "SELECT {k}, max_by(company_name, seq) AS company_name, max(seq) AS seq FROM products GROUP BY {k}"


@query("A8", _UPSERT.format(k="file_name, product_name"), "products")
def a8(t, x):
    p = x("products").drop("k")
    return _merged([p.where("seq % 2 = 0"), p.where("seq % 2 = 1")], ["file_name", "product_name"], lambda old, new: upsert.latest(old, new, ["file_name", "product_name"]))


@query("A8b", _UPSERT.format(k="product_name"), "products")
def a8b(t, x):
    p = x("products").select("product_name", "company_name", "seq")
    return upsert.latest(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), ["product_name"])


@query("A10", """SELECT DISTINCT ingredient_id, synonym FROM (SELECT p_partkey AS ingredient_id, trim(unnest(string_split(p_name, ' '))) AS synonym FROM part)
 WHERE synonym <> '' AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = ingredient_id AND q.p_partkey % 3 = 0 AND split_part(q.p_name, ' ', 1) = synonym)""")
def a10(t, x):
    p = t("part").select(F.col("p_partkey").alias("ingredient_id"), "p_name")
    known = p.where("ingredient_id % 3 = 0").select("ingredient_id", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("synonym"))
    return upsert.new_synonyms(p.select("ingredient_id", F.split("p_name", " ").alias("synonym")), known)


@query("A12", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v, coalesce(a.c, b.c) AS created_at FROM (SELECT o_orderkey AS k, o_custkey AS v, 1 AS c FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_custkey + 1 AS v, 2 AS c FROM orders WHERE o_orderkey % 2 = 0) b ON a.k = b.k")
def a12(t, x):
    o = t("orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.lit(1).alias("created_at"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") + 1).alias("v"), F.lit(2).alias("created_at"))
    return _merged([old, new], ["k"], lambda old, new: upsert.first_created(old, new, "k"))


@query("A15", "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = c.conv_id)")
def a15(t, x):
    return upsert.without(t("conversations"), t("labels").where("toxic = 1").select(F.col("doc_id").alias("conv_id")), "conv_id").select("conv_id", "turn")


@query("A16", "SELECT name, n FROM (SELECT p_brand AS name, p_partkey AS n FROM part WHERE NOT starts_with(p_brand, 'Brand#1')) UNION ALL SELECT 'Brand#1 mock', n_nationkey FROM nation")
def a16(t, x):
    new = t("nation").select(F.lit("Brand#1 mock").alias("name"), F.col("n_nationkey").cast("bigint").alias("n"))
    return upsert.replace_prefix(t("part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("n")), new, "name", "Brand#1")


# Chunks


@query("B1", """SELECT doc_id, page_num, CAST(s AS INT) AS "start", CAST(CASE WHEN nxt IS NULL THEN total ELSE nxt - 1 END AS INT) AS "end" FROM (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (
 SELECT doc_id, i, total, CAST(regexp_extract(p, '^(\\d+)', 1) AS INT) AS page_num, coalesce(sum(length(p) + 9) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
 SELECT doc_id, length(content) AS total, unnest(string_split(content, '>>> page_')[2:]) AS p, generate_subscripts(string_split(content, '>>> page_')[2:], 1) AS i FROM md_docs)))""", "md_docs")
def b1(t, x):
    return chunk.page_spans(x("md_docs"))


#: DuckDB's form of a text with its page markers, whatever their number, as spaces of equal length.
_BLANKED = """array_to_string(list_transform(string_split({text}, '>>> page_'), lambda p, i: CASE WHEN i = 1 THEN p WHEN NOT regexp_matches(p, '^\\d') THEN '>>> page_' || p
 ELSE repeat(' ', 9 + length(regexp_extract(p, '^\\d+'))) || regexp_replace(p, '^\\d+', '') END), '')""".format


@query("B2", f"SELECT doc_id, length(content) AS n, {_BLANKED(text='content')} AS blanked FROM md_docs", "md_docs")
def b2(t, x):
    b = x("md_docs").select("doc_id", chunk.blank_markers(F.col("content")).alias("blanked"))
    return b.select("doc_id", F.length("blanked").cast("bigint").alias("n"), "blanked")


@query("B3", "SELECT doc_id, 0 AS ord, regexp_extract(content, '!\\[(.*?)\\]\\((.*?)\\)', 2) AS content, regexp_extract(content, '!\\[(.*?)\\]\\((.*?)\\)', 1) AS metadata FROM md_docs WHERE contains(content, '![')", "md_docs")
def b3(t, x):
    return chunk.images(x("md_docs"))


_LINES = "SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM {}"


@query("B7", f"""WITH l AS (SELECT *, nullif(length(regexp_extract(line, '^(#+)\\s', 1)), 0) AS level, regexp_replace(line, '^#+\\s+', '') AS title FROM ({_LINES.format('md_docs')})),
w AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER o AS h1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER o AS h2,
 last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER o AS p1, last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER o AS p2, count(level) OVER o AS chunk_seq FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, chunk_seq, concat_ws(' > ', h1, CASE WHEN p2 > p1 OR p1 IS NULL THEN h2 END) AS path, string_agg(line, chr(10) ORDER BY pos) AS body FROM w WHERE level IS NULL AND trim(line) <> '' AND chunk_seq > 0 GROUP BY ALL""", "md_docs")
def b7(t, x):
    return spans.header_chunks(x("md_docs"))


@query("B9", """WITH p AS (SELECT doc_id, page_num, s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i) - 1, total) AS e FROM (
 SELECT doc_id, i, total, CAST(regexp_extract(p, '^(\\d+)', 1) AS INT) AS page_num, coalesce(sum(length(p) + 9) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
 SELECT doc_id, length(content) AS total, unnest(string_split(content, '>>> page_')[2:]) AS p, generate_subscripts(string_split(content, '>>> page_')[2:], 1) AS i FROM md_docs))),
c AS (SELECT doc_id, CAST(k AS INT) AS chunk, k * 60 AS cs, k * 60 + 70 AS ce FROM (SELECT doc_id, unnest(range(0, (length(content) - 1) // 60 + 1)) AS k FROM md_docs) UNION ALL SELECT doc_id, -1, 0, 0 FROM md_docs)
SELECT doc_id, chunk, CASE WHEN chunk = -1 THEN '0' ELSE array_to_string(range(a, greatest(a, b) + 1), ',') END AS page_num FROM (SELECT c.doc_id, chunk, coalesce(max(CASE WHEN cs BETWEEN s AND e THEN page_num END), 0) AS a, coalesce(max(CASE WHEN ce BETWEEN s AND e THEN page_num END), 0) AS b
 FROM c LEFT JOIN p ON p.doc_id = c.doc_id AND s <= ce AND e >= cs GROUP BY c.doc_id, chunk)""", "md_docs")
def b9(t, x):
    md = x("md_docs")
    c = md.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("cast((length(content) - 1) div 60 as int)"))).alias("chunk")).select("doc_id", "chunk", (F.col("chunk") * 60).alias("start"), (F.col("chunk") * 60 + 70).alias("end"))
    c = c.unionByName(md.select("doc_id", F.lit(-1).alias("chunk"), F.lit(0).alias("start"), F.lit(0).alias("end")))  # without a place
    return chunk.attribute_pages(c, chunk.page_spans(md)).select("doc_id", "chunk", joined("page_num").alias("page_num"))


@query("B18", "SELECT doc_id, array_to_string(regexp_extract_all(content, '\\*\\*(.*?)\\*\\*', 1), ',') AS keywords FROM md_docs", "md_docs")
def b18(t, x):
    return x("md_docs").select("doc_id", F.array_join(chunk.bold(F.col("content")), ",").alias("keywords"))


@query("B20", "SELECT p_partkey AS k, 'brand: ' || p_brand || ' | size: ' || CAST(p_size AS VARCHAR) AS line FROM part")
def b20(t, x):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return t("part").select(F.col("p_partkey").alias("k"), chunk.row_text(m).alias("line"))


@query("B24", "SELECT doc_id, regexp_replace(regexp_replace(content, '>>> page_\\d+\\n?', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS content FROM md_docs", "md_docs")
def b24(t, x):
    return x("md_docs").select("doc_id", chunk.squeeze(F.col("content")).alias("content"))


@query("B25", f"""WITH l AS (SELECT doc_id, line, pos, count(CASE WHEN starts_with(line, '>>> page_') THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS page FROM ({_LINES.format('md_docs')})),
k AS (SELECT doc_id, page, trim(line) AS line, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM l WHERE trim(line) <> '' AND NOT starts_with(line, '>>> page_') AND page > 0),
z AS (SELECT *, 'header' AS zone FROM k WHERE k <= greatest(1, floor(n * 0.3)) UNION ALL SELECT *, 'footer' FROM k WHERE k > n - greatest(1, floor(n * 0.3))), d AS (SELECT doc_id, count(DISTINCT page) AS pages, min(page) AS first FROM k GROUP BY 1)
SELECT doc_id, zone, line FROM z JOIN d USING (doc_id) WHERE pages > 1 AND (pages < 3 OR page <> first) GROUP BY doc_id, zone, line, pages HAVING count(DISTINCT page) = CASE WHEN pages >= 3 THEN pages - 1 ELSE pages END""", "md_docs")
def b25(t, x):
    l = chunk.lines(x("md_docs"))
    from pyspark.sql import Window as W

    l = l.withColumn("page", F.count_if(F.col("line").startswith(">>> page_")).over(W.partitionBy("doc_id").orderBy("pos"))).where("page > 0 and not startswith(line, '>>> page_')")
    return chunk.running_lines(l)


# Layout and tables


@query("L1", "SELECT s.doc, s.page, s.ord, b.box_ord FROM spans s JOIN boxes b ON s.doc = b.doc AND s.page = b.page AND s.x0 <= b.x1 AND s.x1 >= b.x0 AND s.y0 <= b.y1 AND s.y1 >= b.y0", "spans", "boxes")
def l1(t, x):
    s, b = x("spans").alias("s"), x("boxes").alias("b")
    return s.join(b, (F.col("s.doc") == F.col("b.doc")) & (F.col("s.page") == F.col("b.page")) & layout.overlaps("s", "b")).select("s.doc", "s.page", "s.ord", "b.box_ord")


@query("L2", """WITH f AS (SELECT s.doc, s.page, s.ord, s.y0, s.x0, s.text, min(b.box_ord) AS box_ord FROM spans s JOIN boxes b ON s.doc = b.doc AND s.page = b.page AND s.x0 <= b.x1 AND s.x1 >= b.x0 AND s.y0 <= b.y1 AND s.y1 >= b.y0 GROUP BY ALL)
SELECT doc, page, box_ord, CASE WHEN box_ord = 1 THEN '## ' ELSE '' END || string_agg(text, ' ' ORDER BY y0, x0, ord) AS text FROM f GROUP BY doc, page, box_ord""", "spans", "boxes")
def l2(t, x):
    return layout.in_boxes(x("spans"), x("boxes"))


@query("L3", """WITH n AS (SELECT doc, CAST(round(font_size) AS INT) AS size, count(*) AS n FROM spans GROUP BY 1, 2), b AS (SELECT doc, first(size ORDER BY n DESC, size) AS base, max(size) AS top FROM n GROUP BY doc),
j AS (SELECT n.doc, size, base, top, count(CASE WHEN size > base THEN 1 END) OVER (PARTITION BY n.doc) AS larger FROM n JOIN b USING (doc))
SELECT doc, size, CASE WHEN larger < 2 AND size < top THEN 0 WHEN size <= base THEN 0 WHEN size = top THEN 1 WHEN size >= base + 2 * (top - base) / 3.0 THEN 2 WHEN size >= base + (top - base) / 3.0 THEN 3 ELSE 0 END AS level FROM j""", "spans")
def l3(t, x):
    return layout.headings(x("spans"))


@query("L3b", "SELECT doc, ord, CASE WHEN font_size > 18 THEN 1 WHEN font_size > 16 THEN 2 WHEN font_size > 14 THEN 3 WHEN font_size > 12 THEN 4 ELSE 0 END AS level FROM spans", "spans")
def l3b(t, x):
    return x("spans").select("doc", "ord", layout.fixed_heading(F.col("font_size")).alias("level"))


@query("L7", "SELECT doc, ord, 100 - y1 AS y0, 100 - y0 AS y1 FROM spans", "spans")
def l7(t, x):
    s = x("spans")
    return layout.flipped(s, s.select("doc", "page").distinct().withColumn("height", F.lit(100.0))).select("doc", "ord", "y0", "y1")


def _unescaped_sql(text: str) -> str:
    """DuckDB's form of a text with its character references decoded by the rules of HTML: the longest name counts, some need no semicolon; numbers that stand for no character are mended or left out."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    names = "|".join(sorted(html5, key=lambda n: (-len(n), n)))
    named = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in html5.items()) + "}"
    mended = " ".join(f"WHEN {k} THEN chr({ord(v)})" for k, v in entities._invalid_charrefs.items())
    dropped = ", ".join(map(str, sorted(entities._invalid_codepoints)))
    digits = "regexp_extract(p, '^#(?:[0-9]+|[xX][0-9a-fA-F]+)')"
    number = f"coalesce(TRY_CAST(CASE WHEN {digits}[2:2] IN ('x', 'X') THEN '0x' || {digits}[3:] ELSE {digits}[2:] END AS BIGINT), 1114112)"
    char = f"CASE {number} {mended} ELSE CASE WHEN {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN chr(65533) WHEN {number} IN ({dropped}) THEN '' ELSE chr(CAST({number} AS INT)) END END"
    name = f"regexp_extract(p, '^(?:{names})')"
    one = f"CASE WHEN {digits} <> '' THEN {char} || regexp_replace(p, '^#[xX]?[0-9a-fA-F]+;?', '') WHEN {name} <> '' THEN {named}[{name}] || substr(p, length({name}) + 1) ELSE '&' || p END"
    one = one.replace("regexp_replace(p, '^#[xX]?[0-9a-fA-F]+;?', '')", "regexp_replace(p, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?', '')")
    return f"(SELECT string_agg(CASE WHEN i = 1 THEN p ELSE {one} END, '' ORDER BY i) FROM (SELECT unnest(string_split({text}, '&')) AS p, generate_subscripts(string_split({text}, '&'), 1) AS i))"


@query("C1", f"SELECT page_id, trim(regexp_replace({_unescaped_sql("bare")}, '[\\s\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS bare FROM pages)")
def c1(t, x):
    return t("pages").select("page_id", tables.clean(F.col("html")).alias("text"))


@query("C2", "SELECT table_id, CAST(CASE WHEN table_id % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS headers FROM html_tables", "html_tables")
def c2(t, x):
    return tables.header_rows(x("html_tables")).select("table_id", F.col("headers").cast("bigint").alias("headers"))


@query("C6", "SELECT l_orderkey AS table_id, (count(*) >= 2 AND l_orderkey % 3 = 0 AND l_orderkey % 5 <> 0) OR (count(*) >= 2 AND count(*) // 2 = 0) AS is_row_header FROM lineitem GROUP BY l_orderkey")
def c6(t, x):
    return tables.row_header_tables(x("html_tables"))


_LI = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln FROM lineitem)"


@query("C3", f"""SELECT l_orderkey AS table_id, CAST(ln AS INT) AS tr, c AS col, CASE WHEN c = 1 THEN 'No' ELSE 'Part' END AS header,
 CASE WHEN c = 1 THEN CAST(ln AS VARCHAR) WHEN c = 2 THEN CAST(l_partkey AS VARCHAR) WHEN l_orderkey % 3 = 0 THEN '' ELSE 'b' END AS value FROM {_LI}, (VALUES (1), (2), (3)) v(c) WHERE l_orderkey % 5 <> 0""")
def c3(t, x):
    return tables.single_header_rows(x("html_tables"))


@query("C8", f"SELECT l_orderkey AS table_id, CAST(ln - 1 AS INT) AS tr, 'k' || CAST(ln AS VARCHAR) AS header, 'v ' || CAST(l_partkey AS VARCHAR) AS value FROM {_LI} WHERE l_orderkey % 5 = 0")
def c8(t, x):
    return tables.key_value_rows(x("html_tables"))


# Properties

_D1 = """SELECT DISTINCT document_id, property, CAST(value AS DOUBLE) AS value, unit FROM (
 SELECT document_id, 'Density' AS property, unnest(regexp_extract_all(content, '(?i)Density[\\s:]+(\\d+\\.?\\d*)\\s*(g/cm³|kg/m³)', 1)) AS value, 'g/cm³' AS unit FROM tds_docs
 UNION ALL SELECT document_id, 'Tg', unnest(regexp_extract_all(content, '(?i)(?:Glass Transition|Tg)[\\s:]+(-?\\d+\\.?\\d*)\\s*°?\\s*([CF℃])', 1)), 'C' FROM tds_docs
 UNION ALL SELECT document_id, 'Tensile_Strength', unnest(regexp_extract_all(content, '(?i)Tensile Strength[\\s:]+(\\d+\\.?\\d*)\\s*(MPa|GPa|psi)', 1)), 'MPa' FROM tds_docs)"""


@query("D1", _D1, "tds_docs")
def d1(t, x):
    return properties.detect(x("tds_docs")).select("document_id", "property", "value", "unit")


@query("D5", f"""WITH r AS ({_D1}), m AS (SELECT document_id, property, max_by(value, ord) AS value, max_by(unit, ord) AS unit FROM llm_props GROUP BY 1, 2)
SELECT *, 'model' AS source FROM m UNION ALL SELECT r.*, 'regex' FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.document_id = r.document_id AND m.property = r.property)""", "tds_docs", "llm_props")
def d5(t, x):
    return properties.merge_model_first(x("llm_props"), properties.detect(x("tds_docs")))


@query("D6", f"""WITH r AS ({_D1}) SELECT *, 'regex' AS source FROM r UNION ALL SELECT document_id, property, value, unit, 'model' FROM llm_props m WHERE NOT EXISTS (
 SELECT 1 FROM r WHERE r.document_id = m.document_id AND regexp_replace(lower(r.property), '[_\\s-]', '', 'g') = regexp_replace(lower(m.property), '[_\\s-]', '', 'g'))""", "tds_docs", "llm_props")
def d6(t, x):
    return properties.merge_regex_first(properties.detect(x("tds_docs")), x("llm_props"))


@query("D7", f"""WITH r AS ({_D1}), g AS (SELECT document_id, count(*) AS n, count(CASE WHEN property IN ('Tg', 'Tm', 'YS') THEN 1 END) AS core FROM r GROUP BY 1),
d AS (SELECT document_id, greatest(3, floor(len(string_split(content, chr(10))) / 20)) AS e FROM tds_docs)
SELECT document_id, coalesce(n, 0) = 0 OR coalesce(n, 0) / e < 0.3 OR (core = 0 AND n < 5) AS review, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n / e < 0.3 THEN 'few' WHEN core = 0 AND n < 5 THEN 'core' ELSE '' END AS reason FROM d LEFT JOIN g USING (document_id)""", "tds_docs")
def d7(t, x):
    return properties.needs_review(x("tds_docs"), properties.detect(x("tds_docs")))


@query("D9", "SELECT document_id, max_by(CASE WHEN property = 'Density' THEN value END, CASE WHEN property = 'Density' THEN ord END) AS density_value, max_by(CASE WHEN property = 'Density' THEN unit END, CASE WHEN property = 'Density' THEN ord END) AS density_unit, max(CASE WHEN property = 'Melt Flow' THEN value END) AS melt_flow_value, max(CASE WHEN property = 'Melt Flow' THEN unit END) AS melt_flow_unit FROM llm_props GROUP BY 1", "llm_props")
def d9(t, x):
    return properties.wide(x("llm_props"), ["Density", "Melt Flow"])


@query("D10", f"""WITH r AS ({_D1}), n AS (SELECT document_id, count(value) AS n FROM tds_docs LEFT JOIN r USING (document_id) GROUP BY 1) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, count(CASE WHEN n < 3 THEN 1 END) AS few FROM n""", "tds_docs")
def d10(t, x):
    return properties.summary(x("tds_docs"), properties.detect(x("tds_docs")))


@query("D12", "SELECT document_id, CASE property WHEN 'Density' THEN 'density' ELSE 'melt_flow' END AS property, max_by(value, ord) AS value FROM llm_props WHERE property IN ('Density', 'Melt Flow') GROUP BY ALL", "llm_props")
def d12(t, x):
    return properties.long(properties.wide(x("llm_props"), ["Density", "Melt Flow"]))


# Safety sheets


@query("E4", "SELECT doc_id, count(*) AS noise FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS line FROM md_docs) WHERE regexp_matches(line, '^\\s*$|^\\s*>>>\\s*page_\\d+\\s*$') GROUP BY 1", "md_docs")
def e4(t, x):
    return chunk.lines(x("md_docs")).where(tx.is_noise(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("noise"))


@query("E1", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[*_`]', '', 'g'), '[\\x00-\\x20\\x7F]+', ' ', 'g')) AS text FROM documents")
def e1(t, x):
    return t("documents").select("doc_id", tx.norm(F.col("text")).alias("text"))


@query("E13", "SELECT document_id, trim(split_part(line, ':', 2)) AS value FROM (SELECT document_id, unnest(string_split(content, chr(10))) AS line FROM tds_docs) WHERE split_part(line, ':', 1) = 'Shelf life'", "tds_docs")
def e13(t, x):
    l = chunk.lines(x("tds_docs"), "document_id").select("document_id", tx.after_label(F.col("line"), ["shelf life"]).alias("value"))
    return l.where("value is not null")


_HIDDEN = "[" + ", ".join(f"'{x}'" for x in ingredients.HIDDEN) + "]"


@query("E20", f"SELECT product_id, seq, CASE WHEN cas IS NULL OR trim(cas) = '' THEN '비공개' WHEN regexp_full_match(trim(cas), '\\d{{1,7}}-\\d{{2}}-\\d') THEN trim(cas) WHEN len(list_filter({_HIDDEN}, lambda h: contains(lower(cas), h))) > 0 THEN '비공개' ELSE trim(cas) END AS cas FROM ingredients", "ingredients")
def e20(t, x):
    return x("ingredients").select("product_id", "seq", ingredients.cas(F.col("cas")).alias("cas"))


_E25 = """SELECT product_id, seq, raw, CASE WHEN regexp_matches(raw, '^\\d+%$') THEN CAST(replace(raw, '%', '') AS DOUBLE) END AS value,
 CASE WHEN raw LIKE '%-%' THEN CAST(split_part(raw, '-', 1) AS DOUBLE) WHEN raw LIKE '<%' THEN 0.0::DOUBLE END AS lo,
 CASE WHEN raw LIKE '%-%' THEN CAST(replace(split_part(raw, '-', 2), '%', '') AS DOUBLE) WHEN raw LIKE '<%' THEN CAST(regexp_replace(raw, '[<%]', '', 'g') AS DOUBLE) END AS hi FROM ingredients"""


@query("E25", f"SELECT product_id, seq, value, lo, hi, CASE WHEN raw LIKE '<%' THEN '<' END AS op_min, CASE WHEN raw LIKE '%\\%' ESCAPE '\\' THEN '%' END AS unit FROM ({_E25})", "ingredients")
def e25(t, x):
    return x("ingredients").select("product_id", "seq", ingredients.concentration(F.col("raw")).alias("c")).select("product_id", "seq", "c.value", F.col("c.min").alias("lo"), F.col("c.max").alias("hi"), "c.op_min", "c.unit")


@query("E26", "SELECT l_orderkey, l_linenumber, '%' AS unit, CASE WHEN l_linenumber % 2 = 1 THEN 'w/w' ELSE 'v/v' END AS basis FROM lineitem")
def e26(t, x):
    c = ingredients.unit_basis(F.when(F.col("l_linenumber") % 2 == 1, "wt%").otherwise("%"), F.lit(""), F.lit("given in % (v/v)"))
    return t("lineitem").select("l_orderkey", "l_linenumber", c.alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("E27", "SELECT p_partkey AS k, concat_ws(',', p_brand, CASE WHEN p_type <> p_brand THEN p_type END) AS synonyms FROM part")
def e27(t, x):
    s = F.array(F.concat_ws("; ", "p_brand", "p_type"), F.concat_ws(" | ", "p_type", "p_brand"))
    return t("part").select(F.col("p_partkey").alias("k"), F.array_join(ingredients.synonyms(s), ",").alias("synonyms"))


@query("E28", f"SELECT product_id, seq, coalesce(CAST(CAST(lo AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(hi AS BIGINT) AS VARCHAR) || '%', CAST(CAST(value AS BIGINT) AS VARCHAR) || '%') AS raw FROM ({_E25})", "ingredients")
def e28(t, x):
    c = x("ingredients").select("product_id", "seq", ingredients.concentration(F.col("raw")).alias("c"))
    return c.select("product_id", "seq", ingredients.rebuilt_raw(F.lit(None).cast("string"), F.col("c.min"), F.col("c.max"), F.col("c.value"), F.col("c.unit")).alias("raw"))


@query("E29", "SELECT product_id, seq, coalesce(cas = 'confidential', false) AS is_cas_secret, raw = '비공개' AS is_conc_secret, CASE WHEN raw = '비공개' THEN '영업 비밀' ELSE raw END AS raw FROM ingredients", "ingredients")
def e29(t, x):
    return ingredients.confidential(x("ingredients")).select("product_id", "seq", "is_cas_secret", "is_conc_secret", "raw")


@query("E30", f"""WITH c AS ({_E25}), s AS (SELECT *, coalesce(sum(value) OVER w, 0) AS fx, coalesce(sum((lo + hi) / 2) OVER w, 0) AS mid FROM c WINDOW w AS (PARTITION BY product_id))
SELECT product_id, seq, CASE WHEN value IS NOT NULL THEN round(value, 4) WHEN hi IS NOT NULL THEN round((lo + hi) / 2 * CASE WHEN mid > 0 THEN greatest(0, 100 - fx) / mid ELSE 1 END, 4) END AS conc_adjusted FROM s""", "ingredients")
def e30(t, x):
    i = x("ingredients").withColumn("c", ingredients.concentration(F.col("raw")))
    return ingredients.to_hundred(i).select("product_id", "seq", "conc_adjusted")


# Search

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_BM25 = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
q AS (SELECT DISTINCT q_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM queries), p AS (SELECT term, doc_id, doc_len, count(*) AS tf FROM (SELECT doc_id, len(ts) AS doc_len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT q_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term), n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)"""


def _ranked(t, x):
    return search.bm25(x("queries"), t("documents"))


@query("F3", f"SELECT term, doc_id, CAST(doc_len AS BIGINT) AS doc_len, count(*) AS tf FROM (SELECT doc_id, len({_TOKENS}) AS doc_len, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL")
def f3(t, x):
    return search.postings(t("documents")).withColumn("doc_len", F.col("doc_len").cast("bigint"))


_RULES = search.rules()
_SURFACES = "|".join(x.replace(" ", "  ") for x in sorted(_RULES, key=lambda x: (-len(x), x)))
_FORMS = "CASE split_part(p, chr(2), 1) " + " ".join(f"WHEN '{x.replace(' ', '  ')}' THEN '{y}'" for x, y in _RULES.items()) + " END"


def _rewritten_sql(text: str) -> str:
    """DuckDB's form of the words of a text after the synonym rules."""
    padded = f"' ' || replace(array_to_string({_TOKENS.replace('text', text)}, ' '), ' ', '  ') || ' '"
    marked = f"regexp_replace({padded}, ' ({_SURFACES}) ', ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g')"
    new = f"list_transform(string_split({marked}, chr(1)), lambda p: CASE WHEN contains(p, chr(2)) THEN {_FORMS} || split_part(p, chr(2), 2) ELSE p END)"
    return f"trim(replace(array_to_string({new}, ''), '  ', ' '))"


def stems_sql(of: str) -> str:
    """Common tables st0, st1 and so on, the last of which has the stem s of each word w of a table, by the steps of Porter's algorithm."""
    tables, n = [f"st0 AS (SELECT DISTINCT w, w AS s FROM {of})"], len(search.PORTER)
    for i, endings in enumerate(search.PORTER):
        whens = []
        for ending in sorted({e[0] for e in endings}, key=lambda e: -len(e)):
            stem = f"substr(s, 1, length(s) - {len(ending)})"
            ways = []
            for _, new, must, but in (e for e in endings if e[0] == ending):
                met = [f"regexp_matches({stem}, '{must}')"] * bool(must) + [f"NOT regexp_matches({stem}, '{but}')"] * bool(but)
                ways.append(f"WHEN {' AND '.join(met) or 'true'} THEN {stem} || '{new}'")
            whens.append(f"WHEN ends_with(s, '{ending}') THEN CASE {' '.join(ways)} ELSE s END")
        plain = "WHEN NOT regexp_full_match(w, '[a-z]{3,}') THEN s "
        tables.append(f"st{i + 1} AS (SELECT w, CASE {plain}{' '.join(whens)} ELSE s END AS s FROM st{i})")
    return ", ".join(tables).replace(f"st{n} AS", "stems AS")


#: DuckDB counts edits in bytes: its letters beyond ASCII, as far as the tables hold them, as one byte each.
_BYTE = "translate({}, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()')".format


def _fields_sql() -> str:
    """Common tables of weighted keyword search, up to its scores."""
    one = "coalesce(short.one, CASE WHEN length(asked) <= 2 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END)"
    pairs = "SELECT {k}, 'ko' AS chain, substr(w, i, 2) AS term FROM (SELECT *, unnest(range(1, greatest(length(w) - 1, 1) + 1)) AS i FROM {of})"
    return f"""WITH f AS (SELECT doc_id, CASE WHEN type IN ('text', 'table') THEN 'content' ELSE 'metadata' END AS branch, CASE WHEN type IN ('text', 'table') THEN content ELSE metadata END AS text FROM chunks),
w AS (SELECT doc_id, branch, unnest({_TOKENS}) AS w FROM f), qw AS (SELECT q_id, unnest(string_split({_rewritten_sql('query')}, ' ')) AS w FROM queries), every AS (SELECT w FROM w UNION SELECT w FROM qw), {stems_sql('every')},
terms AS (SELECT doc_id, branch, 'en' AS chain, s AS term FROM w JOIN stems USING (w) UNION ALL {pairs.format(k='doc_id, branch', of='w')} UNION ALL SELECT doc_id, branch, 'ngram', substr(w, 1, n) FROM w, (VALUES (2), (3), (4)) v(n) WHERE n <= length(w) AND branch = 'content'),
asked AS (SELECT DISTINCT q_id, 'en' AS chain, s AS asked FROM qw JOIN stems USING (w) UNION SELECT q_id, chain, term FROM ({pairs.format(k='q_id', of='qw')}) UNION SELECT q_id, 'ngram', w FROM qw),
near AS (SELECT DISTINCT asked, term, 1 - levenshtein({_BYTE('asked')}, {_BYTE('term')}) / least(length(asked), length(term)) AS ok FROM (SELECT DISTINCT asked, {one} AS most FROM asked LEFT JOIN (SELECT q_id, 1 AS one FROM queries WHERE length(query) <= 3) short USING (q_id) WHERE chain = 'en'), (SELECT DISTINCT term FROM terms WHERE chain = 'en') WHERE abs(length(asked) - length(term)) <= most AND levenshtein({_BYTE('asked')}, {_BYTE('term')}) <= most),
wanted AS (SELECT q_id, chain, asked, asked AS term, 1.0::DOUBLE AS ok FROM asked WHERE chain <> 'en' UNION ALL SELECT q_id, chain, asked, term, ok FROM asked JOIN near USING (asked) WHERE chain = 'en' AND ok > 0),
len AS (SELECT doc_id, branch, chain, count(*) AS len FROM terms GROUP BY ALL), st AS (SELECT branch, chain, count(*) AS n, avg(len) AS avgdl FROM len GROUP BY ALL),
tf AS (SELECT doc_id, branch, chain, term, count(*) AS tf FROM terms WHERE (chain, term) IN (SELECT (chain, term) FROM wanted) GROUP BY ALL), df AS (SELECT branch, chain, term, count(*) AS df FROM tf GROUP BY ALL),
p AS (SELECT q_id, doc_id, branch, chain, any_value(CASE WHEN branch = 'metadata' THEN 1.5 WHEN chain = 'ngram' THEN 0.5 ELSE 2.5 END) * sum(ok * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS s, count(DISTINCT CASE WHEN chain = 'en' THEN asked END) AS words
 FROM tf JOIN len USING (doc_id, branch, chain) JOIN df USING (branch, chain, term) JOIN st USING (branch, chain) JOIN wanted USING (chain, term) GROUP BY q_id, doc_id, branch, chain),
scores AS (SELECT q_id, doc_id, sum(words) AS words, round(max(s) + any_value(CASE WHEN branch = 'content' THEN 0.3 ELSE 0.2 END) * (sum(s) - max(s)), 6) AS score FROM p GROUP BY q_id, doc_id, branch)"""


@query("F5", _fields_sql() + " SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 10", "queries", "chunks")
def f5(t, x):
    c = x("chunks")
    at = folder(c.sparkSession)
    keyword_index.add(c.where("doc_id % 2 = 0").withColumn("content", F.concat("content", F.lit(" old"))), at)
    keyword_index.add(c, at)  # half of the chunks are replaced
    return keyword_index.keyword_search(x("queries"), at)


@query("F19", _BM25 + " SELECT q_id, source, min(rank) AS first_rank, count(*) AS chunks, string_agg(substr(text, 1, 200) || '...', ' | ' ORDER BY rank) AS snippets, string_agg(text, chr(10) ORDER BY rank) AS contents FROM r JOIN documents USING (doc_id) GROUP BY 1, 2", "queries")
def f19(t, x):
    d = t("documents").select("doc_id", "source", F.col("text").alias("content"), F.concat(F.substring("text", 1, 200), F.lit("...")).alias("snippet"))
    return search.citations(_ranked(t, x).join(d, "doc_id"), "source")


@query("F21", _BM25 + ", o AS (SELECT q_id, doc_id, rank, sum(length(text)) OVER (PARTITION BY q_id ORDER BY rank) AS total FROM r JOIN documents USING (doc_id)) SELECT q_id, doc_id, rank FROM o WHERE total <= 2000", "queries")
def f21(t, x):
    return search.within_budget(_ranked(t, x).join(t("documents").select("doc_id", "text"), "doc_id")).select("q_id", "doc_id", "rank")


@query("F24", "SELECT source AS collection, count(*) AS documents FROM documents GROUP BY 1")
def f24(t, x):
    return t("documents").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("documents"))


_COS = """WITH q AS (SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, label, vec_id, round(list_dot_product(qv, CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(qv, qv) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)"""


def _near(t):
    e = t("embeddings")
    return search.top_by_cosine(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv")), e)


@query("F11", _COS + " SELECT q_id, label, vec_id, score, rank FROM r")
def f11(t, x):
    return _near(t)


@query("F12", _COS + ", o AS (SELECT q_id, label, vec_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM r) SELECT * FROM o WHERE rank <= 5")
def f12(t, x):
    return search.cut_overall(_near(t))


@query("F13", """WITH q AS (SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, vec_id, round(list_sum(list_transform(list_zip(qv, CAST(embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM embeddings, q)
SELECT q_id, vec_id, round(greatest(0, 1 - d / 2), 6) AS similarity, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def f13(t, x):
    e = t("embeddings")
    return search.top_by_l2(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv")), e)


@query("F14", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS vector_id FROM documents")
def f14(t, x):
    return upsert.numbered(t("documents").select("doc_id"), "doc_id", out="vector_id")


@query("J1", _BM25 + ", h AS (SELECT q_id, min(rank) AS k FROM r JOIN documents USING (doc_id) JOIN queries USING (q_id) WHERE contains(documents.text, truth) GROUP BY 1) SELECT count(*) AS questions, round(avg(CASE WHEN k <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(1 / k, 0)), 6) AS mrr FROM queries LEFT JOIN h USING (q_id)", "queries")
def j1(t, x):
    return records.retrieval_quality(_ranked(t, x).join(t("documents").select("doc_id", "text"), "doc_id"), x("queries").select("q_id", "truth"))


# Graph


@query("G2", "SELECT entity_name AS name, array_to_string(list_sort(list(DISTINCT entity_type)), ',') AS alias FROM mentions GROUP BY 1", "mentions")
def g2(t, x):
    n = x("mentions").select(F.col("entity_name").alias("name"), F.array("entity_type").alias("alias"))
    return graph.merge_alias(n).select("name", joined("alias").alias("alias"))


@query("G3", "SELECT src_id AS src, description AS rel, tgt_id AS tgt, max(CAST(chunk_id % 10 AS DOUBLE)) AS confidence, max_by(chunk_id, seq) AS file_info FROM relations GROUP BY 1, 2, 3", "relations")
def g3(t, x):
    r = x("relations").select(F.col("src_id").alias("src"), F.col("description").alias("rel"), F.col("tgt_id").alias("tgt"), (F.col("chunk_id") % 10).cast("double").alias("confidence"), F.col("chunk_id").alias("file_info"), "seq")
    return graph.merge_directed(r)


_G7 = """SELECT entity_name, array_to_string(list_sort(list(DISTINCT description)), '§') AS description, count(DISTINCT chunk_id) AS mention_count, array_to_string(list_sort(list(DISTINCT file_path)), '§') AS file_paths,
 (SELECT first(entity_type ORDER BY n DESC, entity_type) FROM (SELECT entity_type, count(*) AS n FROM mentions k WHERE k.entity_name = m.entity_name GROUP BY 1)) AS entity_type FROM mentions m GROUP BY entity_name"""


@query("G7", _G7, "mentions")
def g7(t, x):
    return graph.merge_nodes(x("mentions"))


_G8 = "SELECT least(src_id, tgt_id) AS src_id, greatest(src_id, tgt_id) AS tgt_id, round(sum(weight), 6) AS weight, array_to_string(list_sort(list(DISTINCT description)), '§') AS description, array_to_string(list_sort(list_distinct(flatten(list(string_split(keywords, ', '))))), ',') AS keywords FROM relations GROUP BY 1, 2"


@query("G8", _G8, "relations")
def g8(t, x):
    return graph.merge_edges(x("relations"))


@query("G10", _G8, "relations")
def g10(t, x):
    r = x("relations")
    stored = graph.merge_edges(r.where("chunk_id % 2 = 0")).withColumn("keywords", F.col("keywords"))
    both = stored.withColumn("description", F.explode(F.split("description", graph.SEP))).withColumn("weight", F.col("weight") / F.count("*").over(_pair()))
    return graph.merge_edges(both.unionByName(r.where("chunk_id % 2 = 1").select(both.columns)))


def _pair():
    from pyspark.sql import Window as W

    return W.partitionBy("src_id", "tgt_id")


@query("G9", "SELECT entity_name, 'Unknown' AS entity_type, 0 AS mention_count FROM (SELECT src_id AS entity_name FROM relations UNION SELECT tgt_id FROM relations) WHERE entity_name NOT IN (SELECT entity_name FROM mentions WHERE chunk_id % 500 = 0)", "relations", "mentions")
def g9(t, x):
    return graph.missing_ends(x("relations"), x("mentions").where("chunk_id % 500 = 0"))


_BOTH = "b AS (SELECT src AS u, tgt AS v FROM edges UNION SELECT tgt, src FROM edges)"


@query("G12", f"""WITH {_BOTH}, s AS (SELECT min(src) AS s FROM edges), h1 AS (SELECT v AS node, 1 AS hop FROM b, s WHERE u = s), h2 AS (SELECT DISTINCT b.v AS node, 2 AS hop FROM h1 JOIN b ON h1.node = b.u, s WHERE b.v <> s AND b.v NOT IN (SELECT node FROM h1))
SELECT s AS start, node, hop FROM h1, s UNION ALL SELECT s, node, hop FROM h2, s""", "edges")
def g12(t, x):
    e = x("edges")
    return graph.neighbours(e, e.agg(F.min("src").alias("start")), 2)


@query("G13", "SELECT src, tgt FROM edges WHERE tgt IN ('n1', 'n2', 'n3')", "edges")
def g13(t, x):
    e = x("edges")
    names = e.where("tgt in ('n1', 'n2', 'n3')").select(F.col("src").alias("node")).union(e.where("tgt in ('n1', 'n2', 'n3')").select("tgt"))
    return graph.induced(e, names).select("src", "tgt")


_COMP = "c AS (SELECT node, min(node) OVER (PARTITION BY tgt) AS component FROM (SELECT src AS node, tgt FROM edges UNION SELECT tgt, tgt FROM edges))"


@query("G15", f"WITH {_COMP} SELECT node, component FROM c", "edges")
def g15(t, x):
    return components.connected_components(x("edges"))


@query("G16", f"WITH {_COMP}, e AS (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM edges) SELECT count(DISTINCT node) AS nodes, (SELECT count(*) FROM e) AS edges, count(DISTINCT component) AS components, round(2 * (SELECT count(*) FROM e) / count(DISTINCT node), 6) AS mean_degree FROM c", "edges")
def g16(t, x):
    return graph.stats(x("edges"))


@query("G17", "SELECT entity_type AS label, count(*) AS n FROM mentions GROUP BY 1", "mentions")
def g17(t, x):
    return x("mentions").groupBy(F.col("entity_type").alias("label")).agg(F.count("*").alias("n"))


# Records


@query("H1", "SELECT role AS type, count(*) AS n FROM conversations GROUP BY 1")
def h1(t, x):
    return t("conversations").groupBy(F.col("role").alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("H4", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def h4(t, x):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


@query("H5", "SELECT count(CASE WHEN starts_with(source, 'src1') THEN 1 END) AS mock, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def h5(t, x):
    return t("documents").agg(F.count_if(F.col("source").startswith("src1")).alias("mock"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("I3", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)")
def i3(t, x):
    return records.last_messages(t("conversations"), k=3).select("conv_id", "turn", "place")


@query("I4", "SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'user' END AS role FROM conversations")
def i4(t, x):
    return records.model_roles(t("conversations")).select("conv_id", "turn", "role")


@query("I7", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def i7(t, x):
    return records.not_ingested(t("documents"), t("labels"), ["doc_id"]).select("doc_id", "source")


@query("I9", "SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def i9(t, x):
    return records.name_conflicts(t("part"), "p_size", "p_brand")


@query("I11", "SELECT user_id, max_by(event_type, (ts, event_id)) AS status, max(ts) AS at FROM events GROUP BY 1")
def i11(t, x):
    return records.latest_status(t("events"), "user_id", "event_type", "ts", "event_id")


# Loads, continued


@query("A9", "SELECT product_id, seq, CAST(to_json([name, 'x']) AS VARCHAR) AS synonym, CAST(replace(raw, '%', '') AS DOUBLE) AS value FROM ingredients WHERE regexp_matches(raw, '^\\d+%$')", "ingredients")
def a9(t, x):
    i = x("ingredients").withColumn("concentration", ingredients.concentration(F.col("raw"))).where("concentration.value is not null")
    return i.select("product_id", "seq", F.to_json(F.array("name", F.lit("x"))).alias("synonym"), "concentration.value")


@query("A11", "SELECT k, id FROM products JOIN (SELECT file_name, product_name, row_number() OVER (ORDER BY file_name, product_name) - 1 AS id FROM products GROUP BY 1, 2) USING (file_name, product_name)", "products")
def a11(t, x):
    p = x("products")
    ids = upsert.numbered(p.select("file_name", "product_name").distinct(), "file_name", "product_name", out="id")
    return p.join(ids, ["file_name", "product_name"]).select("k", "id")


@query("A13", "SELECT document_id, property, value, CASE WHEN ord % 2 = 0 THEN 'model' ELSE 'regex' END AS extraction_method FROM llm_props", "llm_props")
def a13(t, x):
    return x("llm_props").select("document_id", "property", "value", F.coalesce(F.when(F.col("ord") % 2 == 0, "model"), F.lit("regex")).alias("extraction_method"))


@query("A14", "SELECT p_partkey AS file, CAST(to_json(coalesce(list(property ORDER BY ord) FILTER (property IS NOT NULL), [])) AS VARCHAR) AS components FROM part LEFT JOIN llm_props ON p_partkey = document_id GROUP BY 1", "llm_props")
def a14(t, x):
    j = t("part").select(F.col("p_partkey").alias("document_id")).join(x("llm_props"), "document_id", "left")
    g = j.groupBy(F.col("document_id").alias("file")).agg(F.array_sort(F.collect_list(F.when(F.col("property").isNotNull(), F.struct("ord", "property")))).alias("c"))
    return g.select("file", F.to_json(F.col("c.property")).alias("components"))


# Chunks, continued


@query("B4", """SELECT doc_id, ln - 1 AS ord, url AS content, substr(m, greatest(p - 100, 1), p - greatest(p - 100, 1)) || substr(m, p + length(url), 100) AS metadata FROM (SELECT doc_id, ln, m, url, instr(m, url || ' ') AS p FROM (
 SELECT doc_id, content AS m, unnest(regexp_extract_all(content, 'https://example.com/o/\\d+')) AS url, generate_subscripts(regexp_extract_all(content, 'https://example.com/o/\\d+'), 1) AS ln FROM mixed_docs))""", "mixed_docs")
def b4(t, x):
    return chunk.links(x("mixed_docs"))


@query("B5", f"SELECT l_orderkey AS doc_id, CAST((ln - 1) * 11 + 2 AS INT) AS \"start\", '  a   b  ' || chr(10) || '         ' || chr(10) || '  1   ' || CAST(l_partkey AS VARCHAR) || '  ' AS content FROM {_LI}")
def b5(t, x):
    return chunk.pipe_tables(x("mixed_docs"))


_B12 = "SELECT l_orderkey AS doc_id, ln AS section, '{}' AS kind, 'Item ' || CAST(ln AS VARCHAR) AS heading, {} AS ord, {} AS text FROM " + _LI


@query("B12", _B12.format("text", "0", "'Intro ' || CAST(l_partkey AS VARCHAR) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || CAST(l_partkey AS VARCHAR) || ' |' || chr(10) || 'See https://example.com/o/' || CAST(ln AS VARCHAR) || ' there.'") + " UNION ALL "
       + _B12.format("table", "ln", """'{"part": "' || CAST(l_partkey AS VARCHAR) || '"},' || chr(10) || 'no row' || chr(10) || '{"supplier": "' || CAST(l_suppkey AS VARCHAR) || '"}'"""))
def b12(t, x):
    return spans.sections(x("mixed_docs"))


@query("B19", f"SELECT l_orderkey AS doc_id, ln AS section, 'part: ' || CAST(l_partkey AS VARCHAR) || chr(10) || 'supplier: ' || CAST(l_suppkey AS VARCHAR) AS text FROM {_LI}")
def b19(t, x):
    s = spans.sections(x("mixed_docs")).where("kind = 'table'")
    return s.select("doc_id", "section", F.array_join(F.transform(chunk.json_rows(F.col("text")), chunk.row_text), "\n").alias("text"))


@query("B23", "SELECT doc_id, regexp_replace(regexp_replace(content, '!\\[.*?\\]\\(.*?\\)', '', 'g'), '>>> page_\\d+\\n', '', 'g') AS content FROM md_docs", "md_docs")
def b23(t, x):
    return x("md_docs").select("doc_id", chunk.clean_sheet(F.col("content")).alias("content"))


@query("B26", f"WITH r AS ({_SQL['B25']}) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS content FROM ({_LINES.format('md_docs')}) l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.line = trim(l.line)) GROUP BY 1", "md_docs")
def b26(t, x):
    return chunk.without_lines(chunk.lines(x("md_docs")), b25(t, x))


@query("H2", f"SELECT CAST(p AS INT) AS page, count(*) AS n FROM (SELECT unnest(string_split(page_num, ',')) AS p FROM ({_SQL['B9']})) GROUP BY 1")
def h2(t, x):
    return b9(t, x).select(F.explode(F.split("page_num", ",").cast("array<int>")).alias("page")).groupBy("page").agg(F.count("*").alias("n"))


@query("H3", f"SELECT count(*) AS n, count(CASE WHEN contains(page_num, ',') THEN 1 END) AS multi FROM ({_SQL['B9']})")
def h3(t, x):
    return b9(t, x).agg(F.count("*").alias("n"), F.count_if(F.contains("page_num", F.lit(","))).alias("multi"))


# Layout and tables, continued

_FLAGS = "(SELECT *, CAST(ord % 4 * 8 + ord % 3 AS INT) AS flags, CAST((ord + 1) // 2 AS INT) AS line FROM spans)"


@query("L4", f"""WITH g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc, line ORDER BY x0, ord) AS gap, CASE WHEN flags & 16 > 0 THEN '**' ELSE '' END || CASE WHEN flags & 2 > 0 THEN '*' ELSE '' END AS m FROM {_FLAGS})
SELECT doc, page, line, string_agg(CASE WHEN gap > 10 THEN repeat('&nbsp;', CAST(floor(gap / 5) AS INT)) ELSE '' END || m || text || reverse(m), '' ORDER BY x0, ord) AS text FROM g GROUP BY 1, 2, 3""", "spans")
def l4(t, x):
    return layout.line_text(x("spans").withColumns({"flags": (F.col("ord") % 4 * 8 + F.col("ord") % 3).cast("int"), "line": F.floor((F.col("ord") + 1) / 2).cast("int")}))


@query("L5", "SELECT doc, page, kind, ord, row_number() OVER (PARTITION BY doc, page ORDER BY y0, x0, kind, ord) AS place FROM (SELECT doc, page, 'text' AS kind, ord, x0, y0 FROM spans UNION ALL SELECT doc, page, 'table', box_ord, x0, y0 FROM boxes)", "spans", "boxes")
def l5(t, x):
    of = lambda d, kind, ord: d.select("doc", "page", F.lit(kind).alias("kind"), F.col(ord).cast("bigint").alias("ord"), "x0", "y0")
    return layout.page_order(of(x("spans"), "text", "ord"), of(x("boxes"), "table", "box_ord"))


@query("L6", "SELECT p_partkey AS k, '| ' || p_brand || ' | size |' || chr(10) || '|---|---|' || chr(10) || '| ' || CAST(p_size AS VARCHAR) || ' |  |' AS text FROM part")
def l6(t, x):
    grid = F.array(F.array(F.concat(F.lit(" "), "p_brand"), F.lit("size ")), F.array(F.lit(""), F.lit(None).cast("string")), F.array(F.col("p_size").cast("string")))
    return t("part").select(F.col("p_partkey").alias("k"), layout.pipe_table(grid).alias("text"))


@query("C5", "SELECT DISTINCT l_orderkey AS table_id, CAST(o AS INT) AS ord, 'col_' || CAST(o AS VARCHAR) AS header FROM lineitem, (VALUES (0), (1)) v(o) WHERE l_orderkey % 5 = 0")
def c5(t, x):
    return tables.fallback_headers(x("html_tables"))


@query("C7", f"SELECT l_orderkey AS table_id, 1 AS col, CAST(ln AS VARCHAR) AS header, CAST(l_partkey AS VARCHAR) AS value FROM {_LI} WHERE l_orderkey % 3 = 0 AND l_orderkey % 5 <> 0 AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2)")
def c7(t, x):
    return tables.transposed_rows(x("html_tables"))


# Properties and sheets, continued


@query("D3", "SELECT p_partkey AS document_id, 'Unknown_Shelf_life' AS property, CAST(p_size AS DOUBLE) AS value, 'months' AS unit FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'Unknown_Tg', p_size * 3, '°C' FROM part WHERE p_partkey % 2 = 0")
def d3(t, x):
    d = x("tds_docs")
    return properties.unknown(d, properties.detect(d).select("document_id", "matched_name").distinct())


@query("D4", f"SELECT document_id, count(*) AS total, count(CASE WHEN property = 'Density' THEN 1 END) AS density FROM ({_D1}) GROUP BY 1", "tds_docs")
def d4(t, x):
    return properties.detect(x("tds_docs")).groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("property") == "Density").alias("density"))


@query("D11", """SELECT p_partkey AS document_id, property, CAST(CASE property WHEN 'Tg' THEN p_size * 3 ELSE p_size END AS DOUBLE) AS value, CASE property WHEN 'Tg' THEN 'C' ELSE 'g/cm³' END AS unit
 FROM part, (VALUES ('Tg', 2), ('Density', 1), ('Density', 5)) v(property, m) WHERE p_partkey % m = 0""")
def d11(t, x):
    return properties.detect_loose(x("tds_docs"))


@query("E2", "SELECT p_partkey AS k, 'Maker ' || p_brand AS company FROM part")
def e2(t, x):
    return t("part").select(F.col("p_partkey").alias("k"), tx.norm_company(F.concat(F.lit("- Maker "), "p_brand", F.lit(" (Korea) Tel: 02-"), "p_type")).alias("company"))


@query("E3", "SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[*_`]', '', 'g'), '[\\x00-\\x20\\x7F]+', ' ', 'g'))) AS text FROM documents")
def e3(t, x):
    return t("documents").select("doc_id", tx.norm_lower(F.col("text")).alias("text"))


@query("E12", """SELECT doc_id, CASE WHEN contains(content, '## Item 2') THEN substr(content, instr(content, '## Item 1' || chr(10)), instr(content, '## Item 2' || chr(10)) - instr(content, '## Item 1' || chr(10))) ELSE substr(content, instr(content, '## Item 1' || chr(10))) END AS section FROM md_docs""", "md_docs")
def e12(t, x):
    return x("md_docs").select("doc_id", chunk.between(F.col("content"), "Item 1", "Item 2").alias("section"))


@query("E19", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '혼합물' ELSE l_returnflag END AS name, CASE WHEN l_returnflag = 'R' THEN 'Mixture,' ELSE '' END || l_linestatus AS synonym FROM lineitem")
def e19(t, x):
    name = F.when(F.col("l_returnflag") == "R", " mixture").otherwise(F.col("l_returnflag"))
    m = t("lineitem").select("l_orderkey", "l_linenumber", ingredients.mixture(name, F.array("l_linestatus")).alias("m"))
    return m.select("l_orderkey", "l_linenumber", "m.name", joined("m.synonym").alias("synonym"))


_MAP = "CASE p_partkey % 2 WHEN 0 THEN p_name ELSE p_brand END"


@query("E21", f"SELECT p_partkey AS k, {_MAP} AS name, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '비공개' END AS cas, '미공개' AS concentration FROM part")
def e21(t, x):
    even, size = F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")
    m = F.when(even, F.create_map(F.lit("화학물질명"), F.concat(F.col("p_name"), F.lit(" ")), F.lit("cas_number"), size)).otherwise(F.create_map(F.lit("chemical_name"), F.col("p_brand"), F.lit("other"), size))
    return t("part").select(F.col("p_partkey").alias("k"), ingredients.component(m).alias("c")).select("k", "c.name", "c.cas", "c.concentration")


@query("E22", "SELECT document_id, name, cas, concentration FROM (SELECT p_partkey AS document_id, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN '1' END AS cas, CASE WHEN p_partkey % 3 = 1 THEN '5-10%' END AS concentration FROM part UNION ALL SELECT p_partkey, 'b', NULL, NULL FROM part WHERE p_partkey % 3 = 2)")
def e22(t, x):
    rows = x("answers").select("document_id", F.explode(ingredients.answer_rows(F.col("answer"))).alias("m"))
    return rows.select("document_id", ingredients.standard(F.col("m")).alias("c")).select("document_id", "c.name", "c.cas", "c.concentration")


@query("E23", f"SELECT product_id, seq, value, CASE WHEN raw LIKE '%-%' THEN lo END AS lo, CASE WHEN raw LIKE '%-%' THEN hi END AS hi, CASE WHEN raw LIKE '<%' OR raw = '' OR raw = '비공개' THEN raw END AS raw FROM ({_E25})", "ingredients")
def e23(t, x):
    c = x("ingredients").select("product_id", "seq", ingredients.simple_concentration(F.col("raw")).alias("c"))
    return c.select("product_id", "seq", "c.value", F.col("c.min").alias("lo"), F.col("c.max").alias("hi"), "c.raw")


@query("E31", f"""WITH c AS (SELECT *, raw = '비공개' AS is_conc_secret FROM ({_E25})), s AS (SELECT *, coalesce(sum(value) OVER w, 0) AS fx, coalesce(sum((lo + hi) / 2) OVER w, 0) AS mid FROM c WINDOW w AS (PARTITION BY product_id))
SELECT product_id, seq, is_conc_secret, CASE WHEN value IS NOT NULL THEN round(value, 4) WHEN hi IS NOT NULL THEN round((lo + hi) / 2 * CASE WHEN mid > 0 THEN greatest(0, 100 - fx) / mid ELSE 1 END, 4) END AS conc_adjusted FROM s""", "ingredients")
def e31(t, x):
    i = ingredients.confidential(x("ingredients"))
    return ingredients.to_hundred(i.withColumn("c", ingredients.concentration(F.col("raw")))).select("product_id", "seq", "is_conc_secret", "conc_adjusted")


@query("E32", "SELECT p_partkey AS document_id, 0 AS row, p_name AS name FROM part UNION ALL SELECT p_partkey, 1, 'b' FROM part WHERE p_partkey % 3 = 2")
def e32(t, x):
    m = x("answers").select("document_id", F.posexplode(ingredients.answer_rows(F.col("answer"))).alias("row", "m"))
    return m.select("document_id", "row", F.coalesce(F.col("m")["화학물질명"], F.col("m")["chemical_name"], F.col("m")["name"]).alias("name"))


@query("E33", """SELECT field, count(*) AS n, count(CASE WHEN contains(content, value) THEN 1 END) AS found, round(count(CASE WHEN contains(content, value) THEN 1 END) / count(*), 6) AS rate
 FROM (SELECT DISTINCT document_id, property AS field, CAST(CAST(value AS BIGINT) AS VARCHAR) || ' ' || unit AS value FROM llm_props) JOIN tds_docs USING (document_id) GROUP BY 1""", "llm_props", "tds_docs")
def e33(t, x):
    s = x("llm_props").select("document_id", F.col("property").alias("field"), F.concat_ws(" ", F.col("value").cast("bigint").cast("string"), "unit").alias("value"))
    return ingredients.load_check(s, x("tds_docs"))


@query("E35", "SELECT k, product_name, string_agg(CAST(seq AS VARCHAR) || ':' || name, ',' ORDER BY seq, name) AS ingredients FROM (SELECT k, product_name FROM products) JOIN ingredients ON k = product_id GROUP BY 1, 2", "products", "ingredients")
def e35(t, x):
    j = x("products").select("k", "product_name").join(x("ingredients").select(F.col("product_id").alias("k"), "seq", "name"), "k")
    g = j.groupBy("k", "product_name").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("i"))
    return g.select("k", "product_name", F.array_join(F.transform("i", lambda z: F.concat(z.seq.cast("string"), F.lit(":"), z["name"])), ",").alias("ingredients"))


# Search, continued


@query("F1", "SELECT doc_id, coalesce(text, '') AS content, lower(upper(source)) AS file_name, CAST(doc_id % 3 AS VARCHAR) AS page_num FROM documents")
def f1(t, x):
    return t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.lower(F.upper("source")).alias("file_name"), F.array_join(F.array((F.col("doc_id") % 3).cast("string")), ",").alias("page_num"))


@query("F4", f"SELECT doc_id, {_rewritten_sql('text')} AS text FROM surfaces", "surfaces")
def f4(t, x):
    return x("surfaces").select("doc_id", search.rewritten(F.col("text")).alias("text"))


@query("F6", """WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), q AS (SELECT DISTINCT substr(word, 2) AS term FROM v)
SELECT term, word, levenshtein(term, word) AS distance FROM q, v WHERE levenshtein(term, word) <= CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END""")
def f6(t, x):
    v = t("part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return search.fuzzy_terms(v.select(F.expr("substr(word, 2)").alias("term")), v).withColumn("distance", F.col("distance").cast("bigint"))


_CONTEXTS = _BM25 + ", c AS (SELECT q_id, r.rank, doc_id, text FROM r JOIN documents USING (doc_id))"


def _with_text(t, x):
    return _ranked(t, x).join(t("documents").select("doc_id", F.col("text").alias("content"), F.lit("m").alias("metadata"), F.lit("text").alias("type")), "doc_id")


@query("F9", _CONTEXTS + " SELECT q_id, count(*) AS n, sum(length(text)) AS chars FROM c WHERE rank <= 3 GROUP BY 1", "queries")
def f9(t, x):
    c = search.contexts(_with_text(t, x).withColumn("content", F.rtrim(F.concat(F.lit("x"), "content", F.lit("x")))))
    return c.select("q_id", F.size("contexts").cast("bigint").alias("n"), (F.aggregate("contexts", F.lit(0).cast("bigint"), lambda s, v: s + F.length(v)) - 2 * F.size("contexts")).alias("chars"))


@query("F17", _CONTEXTS + " SELECT q_id, 'keyword' AS retriever, rank, doc_id, length(text) AS n, substr(text, 1, 200) || '...' AS snippet FROM c", "queries")
def f17(t, x):
    return search.normal_results(_with_text(t, x), "keyword").withColumn("n", F.length("content").cast("bigint")).drop("content")


@query("F18", _BM25 + ", w AS (SELECT q_id, doc_id, rank FROM r) SELECT *, 0 AS retriever_rank FROM w UNION ALL SELECT *, 1 FROM w WHERE rank <= 3", "queries")
def f18(t, x):
    r = _ranked(t, x).select("q_id", "doc_id", "rank")
    return search.in_order(r, r.where("rank <= 3"))


@query("F20", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)license') AND lang IN ('en', 'de') AND list_has_any([source, lang], ['en', 'src1'])")
def f20(t, x):
    return t("documents").where(F.rlike("text", F.lit("(?i)license")) & F.col("lang").isin("en", "de") & F.arrays_overlap(F.array("source", "lang"), F.array(F.lit("en"), F.lit("src1")))).select("doc_id", "lang")


@query("F22", _CONTEXTS + " SELECT q_id, string_agg('[' || CAST(rank AS VARCHAR) || '] ' || text, chr(10) || '---' || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(query) AS prompt FROM c JOIN queries USING (q_id) GROUP BY 1", "queries")
def f22(t, x):
    return search.prompts(_with_text(t, x), x("queries"))


@query("F23", "SELECT DISTINCT source AS collection FROM documents WHERE contains(lower(source), 'c1')")
def f23(t, x):
    return t("documents").where(F.contains(F.lower("source"), F.lit("c1"))).select(F.col("source").alias("collection")).distinct()


# Graph, continued


@query("G4", "SELECT DISTINCT src_id, tgt_id, description, chunk_id % 10 AS confidence FROM relations", "relations")
def g4(t, x):
    return x("relations").select("src_id", "tgt_id", "description", (F.col("chunk_id") % 10).alias("confidence")).dropDuplicates()


@query("G5", f"""WITH e AS ({_SQL['G3']}), n AS (SELECT entity_name AS name, entity_type AS called FROM mentions UNION SELECT src, src FROM e UNION SELECT tgt, tgt FROM e), b AS (SELECT called AS term, e.* FROM e JOIN n ON src = name UNION SELECT called, e.* FROM e JOIN n ON tgt = name)
SELECT term, src || ' - ' || rel || ' -> ' || tgt AS text, confidence, row_number() OVER (PARTITION BY term ORDER BY confidence DESC, src, rel, tgt) AS rank FROM b WHERE term IN (SELECT 'part ' || p_brand FROM part UNION SELECT p_type FROM part) QUALIFY rank <= 10""", "mentions")
def g5(t, x):
    p = t("part")
    return graph.lookup(g3(t, x), p.select(F.concat(F.lit("part "), "p_brand").alias("term")).union(p.select("p_type")), graph.merge_alias(x("mentions").select(F.col("entity_name").alias("name"), F.array("entity_type").alias("alias"))))


@query("G6", "SELECT chunk_id, entity_name FROM mentions WHERE chunk_id % 2 = 0 UNION ALL SELECT chunk_id, entity_name FROM mentions m WHERE chunk_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM mentions k WHERE k.chunk_id % 2 = 0 AND k.chunk_id = m.chunk_id AND k.entity_name = m.entity_name)", "mentions")
def g6(t, x):
    m = x("mentions").select("chunk_id", "entity_name")
    return graph.second_pass(m.where("chunk_id % 2 = 0"), m.where("chunk_id % 3 = 0"), ["chunk_id", "entity_name"])


@query("G14", "SELECT DISTINCT a.src AS start, b.src AS \"end\", CASE WHEN a.tgt = b.tgt THEN a.src || ',' || a.tgt || ',' || b.src END AS path FROM edges a, edges b WHERE a.src = (SELECT min(src) FROM edges) AND starts_with(b.src, 's') AND a.src <> b.src", "edges")
def g14(t, x):
    e = x("edges")
    pairs = e.where("src like 's%'").select(F.col("src").alias("end")).crossJoin(F.broadcast(e.agg(F.min("src").alias("start"))))
    return graph.shortest_path(e, pairs).select("start", "end", joined("path").alias("path"))


@query("G18", f"SELECT entity_name, entity_name || ' (' || entity_type || '): ' || replace(description, '§', ', ') AS text FROM ({_G7})", "mentions")
def g18(t, x):
    return graph.merge_nodes(x("mentions")).select("entity_name", graph.node_text().alias("text"))


@query("G19", "SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'and')), lambda w: regexp_replace(w, '^[?.,!]+|[?.,!]+$', '', 'g')), ' ') AS words FROM documents")
def g19(t, x):
    return t("documents").select("doc_id", F.array_join(graph.keywords(F.col("text"), ["the", "and"]), " ").alias("words"))


# Records, continued


@query("H6", "SELECT product_name, min(k) AS first_k, count(*) AS n FROM products WHERE product_name LIKE 'Brand#1%' GROUP BY 1", "products")
def h6(t, x):
    return x("products").where(F.col("product_name").startswith("Brand#1")).groupBy("product_name").agg(F.min("k").alias("first_k"), F.count("*").alias("n"))


@query("I1", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events")
def i1(t, x):
    from pyspark.sql import Window as W

    return t("events").select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("place"))


@query("I5", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN s ELSE 'src1' END AS collection FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT DISTINCT source AS s FROM documents) WHERE conv_id % 2 = 0 OR s = 'src1'")
def i5(t, x):
    known = t("documents").select(F.col("source").alias("collection")).distinct()
    asked = t("conversations").select("conv_id").distinct()
    some = asked.where("conv_id % 2 = 1").withColumn("collection", F.explode(F.array(F.lit("src1"), F.lit("missing"))))
    return records.chosen_collections(asked.select("conv_id"), some, known)


@query("I6", "SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN d.source WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE 'asked' END AS collection FROM documents d LEFT JOIN labels l USING (doc_id)")
def i6(t, x):
    stored = t("labels").select("doc_id", F.lit("labelled").alias("stored"))
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("available")).join(stored, "doc_id", "left")
    return d.select("doc_id", F.coalesce("available", "stored", F.lit("asked")).alias("collection"))


@query("I8", "SELECT event_type AS type, max_by(user_id, (ts, event_id)) AS latest, array_to_string(list_sort(list(DISTINCT user_id % 7)), ',') AS names FROM events GROUP BY 1")
def i8(t, x):
    return t("events").groupBy(F.col("event_type").alias("type")).agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("latest"), joined_sorted(F.col("user_id") % 7).alias("names"))


def joined_sorted(c):
    return F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",")


@query("I10", f"SELECT 'tds' AS type, document_id, count(*) AS n FROM ({_D1}) GROUP BY 2 UNION ALL SELECT 'msds', product_id, count(*) FROM ingredients GROUP BY 2", "tds_docs", "ingredients")
def i10(t, x):
    of = lambda d, kind, key: d.groupBy(F.col(key).alias("document_id")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("type"), "document_id", "n")
    return of(properties.detect(x("tds_docs")), "tds", "document_id").unionByName(of(x("ingredients"), "msds", "product_id"))


from sheaf.plans import further  # noqa: E402, F401  registers the rest
