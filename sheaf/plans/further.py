"""More registered queries: zones and streams, highlights, entity search, whole pipelines of chunks, tables and safety sheets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.operators import chunk, graph, ingredients, properties, records, search, sections, spans, splits, tables, zones
from sheaf.plans.catalog import _BLANKED, _BM25, _LI, _LINES, _SQL, _TOKENS, _fields_sql, _ranked, _with_text, f13, joined, query, stems_sql
from sheaf.session import folder
from sheaf.sources import files
from sheaf.streaming import ingest

# Zones and streams


@query("A3", "SELECT 'q' || CAST(item_id AS VARCHAR) AS question, text AS ground_truth FROM benchmark")
def a3(t, x):
    b = t("benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question"), F.col("text").alias("ground_truth"))
    at = folder(b.sparkSession)
    files.csv(b, at)
    return files.questions(b.sparkSession, at)


@query("A4", "SELECT doc_id, lang FROM documents")
def a4(t, x):
    d = t("documents").select("doc_id", "lang")
    spark, at, name = d.sparkSession, folder(d.sparkSession), f"zone_{uuid.uuid4().hex}"
    files.zone(spark, name, "doc_id bigint, lang string", at)
    d.write.insertInto(name)
    files.zone(spark, name, "doc_id bigint, lang string", at)  # it is there: nothing changes
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(d.schema).parquet(at)


@query("A5", "SELECT doc_id, n_chars FROM documents")
def a5(t, x):
    d = t("documents").select("doc_id", "n_chars")
    at = folder(d.sparkSession)
    for part in (d.where("doc_id % 2 = 0"), d.where("doc_id % 2 <> 0"), d.where("doc_id is null and doc_id = 0")):
        files.append(part, at)
    return d.sparkSession.read.schema(d.schema).parquet(at)


@query("A17", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(to_json([lang, source]) AS VARCHAR) AS contexts FROM documents")
def a17(t, x):
    d = t("documents").select("doc_id", F.array("lang", "source").alias("contexts"))
    at = folder(d.sparkSession)
    files.csv(d, at)
    return d.sparkSession.read.csv(at, header=True, escape='"', schema="doc_id string, contexts string")


def _stream(t, name, select):
    d = t(name)
    return d.sparkSession, select(ingest.table_stream(d.sparkSession, d.inputFiles()[0].rsplit(f"/{name}.parquet", 1)[0] + f"/{name}.parquet"))


@query("S1", _SQL["B7"])
def s1(t, x):
    md = x("md_docs")
    spark = md.sparkSession
    at = folder(spark)
    md.repartition(4).write.parquet(f"{at}/arrived")
    cut = ingest.table_stream(spark, f"{at}/arrived").select("doc_id", F.explode(spans.under_headers(F.col("content"))).alias("c")).select("doc_id", "c.chunk_seq", "c.path", "c.body")
    ingest.append_to(cut, f"{at}/zone", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(cut.schema).parquet(f"{at}/zone")


@query("S2", "SELECT DISTINCT user_id, event_type FROM events")
def s2(t, x):
    spark, e = _stream(t, "events", lambda d: ingest.once(d.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"))
    at = folder(spark)
    ingest.append_to(e, f"{at}/zone", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{at}/zone")


@query("S3", "SELECT l_partkey AS src, l_suppkey AS tgt, count(*) AS weight FROM lineitem GROUP BY 1, 2")
def s3(t, x):
    spark, e = _stream(t, "lineitem", lambda d: d.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("tgt"), F.lit(1).cast("bigint").alias("weight")))

    def add(stored, new):
        return stored.unionByName(new).groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))

    at = folder(spark)
    ingest.kept(e, f"{at}/zone", ["src", "tgt"], add, f"{at}/checkpoint")
    return zones.read(spark, f"{at}/zone", "src bigint, tgt bigint, weight bigint")


# Records, properties, answers


@query("I2", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def i2(t, x):
    return records.history(t("conversations")).select("conv_id", "turn", "role", "place")


_D2 = """SELECT p_partkey AS document_id, 'Density' AS property, CAST(p_size AS DOUBLE) AS value, 'g/cm³' AS unit, 'Density' AS matched_name FROM part
 UNION ALL SELECT p_partkey, 'Tg', p_size * 3, '°C', 'Tg' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'Tensile_Strength', p_size * 10, 'MPa', 'Tensile Strength' FROM part WHERE p_partkey % 3 = 0"""


@query("D2", _D2)
def d2(t, x):
    return properties.detect_named(x("tds_docs"))


@query("D8", _D2 + " UNION ALL SELECT p_partkey, 'Shelf_life', p_size, 'months', 'Shelf life' FROM part WHERE p_partkey % 4 = 0")
def d8(t, x):
    return properties.detect_named(x("tds_docs"), {"Shelf_life": ["Storage time", "Shelf life"]})


@query("E24", "SELECT p_partkey AS k, 0 AS row, p_name AS a FROM part UNION ALL SELECT p_partkey, 1, 'b' FROM part WHERE p_partkey % 3 = 1")
def e24(t, x):
    k = F.col("p_partkey") % 3
    inner = F.when(k == 0, F.concat(F.lit("[{“a”: “"), "p_name", F.lit("”},]"))).when(k == 1, F.concat(F.lit('{"a": "'), "p_name", F.lit('"},\n, {"a": "b"},'))).otherwise(F.concat(F.lit('{"a": "'), "p_name", F.lit('"}')))
    return t("part").select(F.col("p_partkey").alias("k"), F.posexplode(ingredients.table_rows(inner)).alias("row", "m")).select("k", "row", F.col("m")["a"].alias("a"))


_MARK = "replace(replace(regexp_replace(regexp_replace({text}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g'), '(?i)' || chr(1) || '(' || {words} || ')' || chr(2), '<{tag}>\\1</{tag}>', 'g'), chr(1), ''), chr(2), '')"


_KEYS = "array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(content, '\\*\\*(.*?)\\*\\*', 1)), lambda z: {'n': -length(z), 'z': z})), lambda z: z.z), '|')"


@query("E34", "SELECT doc_id, " + _MARK.format(text="content", words=_KEYS.replace("{", "{{").replace("}", "}}"), tag="mark").replace("(?i)", "").replace("{{", "{").replace("}}", "}") + f" AS content, regexp_replace(content, '(' || {_KEYS} || ')', '<mark>\\1</mark>', 'g') AS loose FROM md_docs", "md_docs")
def e34(t, x):
    c = F.col("content")
    return x("md_docs").select("doc_id", ingredients.marked(c, chunk.bold(c)).alias("content"), ingredients.marked(c, chunk.bold(c), loose=True).alias("loose"))


# Search


@query("F2", f"""WITH w AS (SELECT p_partkey AS k, unnest({_TOKENS.replace('text', "p_name || ' ' || p_type")}) AS w FROM part UNION ALL SELECT doc_id, unnest({_TOKENS}) FROM documents), {stems_sql('w')}
SELECT k, chain, term, count(*) AS n FROM (SELECT k, 'en' AS chain, s AS term FROM w JOIN stems USING (w) UNION ALL SELECT k, 'ko', substr(w, i, 2) FROM (SELECT *, unnest(range(1, greatest(length(w) - 1, 1) + 1)) AS i FROM w)
 UNION ALL SELECT k, 'ngram', substr(w, 1, n) FROM w, (VALUES (2), (3), (4)) v(n) WHERE n <= length(w)) GROUP BY ALL""")
def f2(t, x):
    texts = t("part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_type").alias("text")).union(t("documents").select("doc_id", "text"))
    return search.term_counts(texts)


_HIT = _MARK.replace("_]+", "]+").format(text="text", words="array_to_string(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+'), '|')", tag="em")


@query("F7", _BM25 + f" SELECT q_id, doc_id, {_HIT} AS snippet FROM r JOIN documents USING (doc_id) JOIN queries USING (q_id)", "queries")
def f7(t, x):
    j = _with_text(t, x).join(x("queries").select("q_id", "query"), "q_id")
    return j.select("q_id", "doc_id", search.snippet(F.col("content"), F.col("metadata"), F.array_distinct(search.tokens(F.col("query")))).alias("snippet"))


@query("F8", _BM25 + """, c AS (SELECT q_id, rank, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 2 = 0 THEN 'm' END AS c FROM r WHERE rank <= 3)
SELECT q_id, coalesce(string_agg(c, ',' ORDER BY rank), '') AS contexts FROM c GROUP BY 1""", "queries")
def f8(t, x):
    r = _ranked(t, x).withColumns({"content": F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("doc_id").cast("string")), "metadata": F.when(F.col("doc_id") % 2 == 0, F.lit("m"))})
    return search.contexts(r).select("q_id", joined("contexts").alias("contexts"))


_EMBED = """SELECT k, dim, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS weight FROM (SELECT k, CAST(CAST('0x' || substr(md5(term), 1, 6) AS BIGINT) % 64 AS INT) AS dim, count(*) AS n
 FROM (SELECT {k} AS k, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {of}) GROUP BY 1, 2)"""


@query("F10", f"SELECT k AS doc_id, dim, round(weight, 6) AS weight FROM ({_EMBED.format(k='doc_id', text='text', of='documents')})")
def f10(t, x):
    return search.embed(t("documents")).withColumn("weight", F.round("weight", 6))


@query("F16", _fields_sql() + f""", k AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE words >= 2 QUALIFY rank <= 50),
c AS (SELECT a.k AS q_id, b.k AS doc_id, round(sum(a.weight * b.weight), 6) AS cosine FROM ({_EMBED.format(k='q_id', text='query', of='queries')}) a JOIN ({_EMBED.format(k='doc_id', text='text', of='documents')}) b USING (dim) GROUP BY 1, 2),
v AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, doc_id) AS rank FROM c QUALIFY rank <= 50),
m AS (SELECT q_id, doc_id, round(coalesce(0.5 / (60 + k.rank), 0) + coalesce(0.5 / (60 + v.rank), 0), 8) AS score FROM k FULL JOIN v USING (q_id, doc_id)) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) <= 50""", "queries", "chunks")
def f16(t, x):
    return search.fuse(search.keyword_search(x("queries"), x("chunks"), k=50, least_terms=2), search.by_embedding(x("queries"), t("documents")), "doc_id")


@query("F15")
def f15(t, x):
    e = t("embeddings")
    at = folder(e.sparkSession)
    search.vector_index(e, at)
    return search.near_neighbours(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv")), at, probes=24)


# Entity search


@query("G1", "SELECT p_partkey AS chunk_id, p_brand AS src, 'is of' AS rel, p_type AS tgt, CAST(p_size AS DOUBLE) AS confidence FROM part WHERE p_partkey % 4 <> 3")
def g1(t, x):
    k = F.col("p_partkey") % 4
    one = lambda said: F.concat(F.lit('{"source_node": {"name": "'), "p_brand", F.lit('", "alias": []}, "target_node": {"name": "'), "p_type", F.lit(f'"}}, "relationship_description": "{said}", "confidence": "'), F.col("p_size").cast("string"), F.lit('"}'))
    a = t("part").select(
        F.col("p_partkey").alias("chunk_id"), F.when(k == 0, "image").otherwise("text").alias("type"), F.when(k == 1, "t").when(k == 2, "t").otherwise(" ").alias("content"), F.lit("m").alias("metadata"),
        F.concat(F.lit("["), one("is of"), F.lit(", "), one(" "), F.lit("]")).alias("answer"))
    return graph.relations(a)


_QUESTIONS = "SELECT p_partkey AS q_id, CASE p_partkey % 200 WHEN 0 THEN 'What is PART ' || p_brand WHEN 100 THEN 'about it' WHEN 150 THEN replace(p_brand, '#', ' ') || ' part' ELSE 'zz' END AS query, CASE WHEN p_partkey % 200 = 100 THEN p_brand END AS term FROM part WHERE p_partkey % 50 = 0"
_G11 = f"""WITH q AS ({_QUESTIONS}), n AS (SELECT entity_name, count(DISTINCT chunk_id) AS mention_count FROM mentions GROUP BY 1),
f AS (SELECT q_id, entity_name, CASE WHEN contains(lower(query), lower(entity_name)) OR contains(lower(entity_name), lower(query)) THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM q, n
 WHERE contains(lower(query), lower(entity_name)) OR contains(lower(entity_name), lower(query)) OR contains(lower(entity_name), lower(term)) OR contains(lower(term), lower(entity_name))),
c AS (SELECT a.k AS q_id, b.k AS entity_name, round(sum(a.weight * b.weight), 6) AS cosine FROM ({_EMBED.format(k='q_id', text='query', of='q')}) a JOIN ({_EMBED.format(k='entity_name', text='entity_name', of='n')}) b USING (dim) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY cosine DESC, b.k) <= 10),
u AS (SELECT * FROM f UNION ALL SELECT * FROM c WHERE cosine > 0.5 AND q_id NOT IN (SELECT q_id FROM f))
SELECT q_id, entity_name, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, mention_count DESC, entity_name) AS rank FROM u JOIN n USING (entity_name) QUALIFY rank <= 5"""


@query("G11", _G11, "mentions")
def g11(t, x):
    p = t("part").where("p_partkey % 50 = 0")
    q = p.selectExpr(*[c.strip() for c in ("p_partkey AS q_id", "CASE p_partkey % 200 WHEN 0 THEN 'What is PART ' || p_brand WHEN 100 THEN 'about it' WHEN 150 THEN replace(p_brand, '#', ' ') || ' part' ELSE 'zz' END AS query")])
    said = p.where("p_partkey % 200 = 100").select(F.col("p_partkey").alias("q_id"), F.col("p_brand").alias("term"))
    nodes = graph.merge_nodes(x("mentions")).select("entity_name", "mention_count")
    texts = q.groupBy("query").agg(F.min("q_id").alias("q_id"))  # equal questions are looked up once
    close = search.by_embedding(texts, nodes, "entity_name", "entity_name", k=10).join(texts, "q_id").drop("q_id", "rank").join(q, "query").select("q_id", "entity_name", "cosine")
    return graph.match_entities(q, said, nodes, close)


@query("G20", f"""WITH s AS (SELECT q_id, entity_name AS node FROM ({_SQL['G11']})), e AS ({_SQL['G8']}), d AS ({_SQL['G7']}), b AS (SELECT src_id AS u, tgt_id AS v FROM e UNION SELECT tgt_id, src_id FROM e),
m1 AS (SELECT * FROM s UNION SELECT q_id, v FROM s JOIN b ON node = u), m AS (SELECT * FROM m1 UNION SELECT q_id, v FROM m1 JOIN b ON node = u),
l AS (SELECT q_id, 0 AS kind, entity_name || ' (' || entity_type || '): ' || replace(description, '§', ', ') AS text FROM m JOIN d ON node = entity_name UNION ALL
 SELECT m.q_id, 1, src_id || ' - ' || tgt_id || ': ' || replace(description, '§', ', ') FROM e JOIN m ON src_id = m.node JOIN m n ON tgt_id = n.node AND n.q_id = m.q_id)
SELECT q_id, count(CASE WHEN kind = 0 THEN 1 END) AS n_nodes, count(CASE WHEN kind = 1 THEN 1 END) AS n_edges, string_agg(text, chr(10) ORDER BY kind, text) AS context FROM l GROUP BY 1""")
def g20(t, x):
    return graph.search(g11(t, x), graph.merge_nodes(x("mentions")), graph.merge_edges(x("relations")))


@query("G21", f"""WITH v AS (SELECT q_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS vectors FROM ({_SQL['F13']}) GROUP BY 1), g AS ({_SQL['G20']})
SELECT q_id, coalesce(vectors, '') AS vectors, coalesce(context, '') AS context FROM v FULL JOIN g USING (q_id)""")
def g21(t, x):
    v = f13(t, x).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("v")).select("q_id", joined("v.vec_id").alias("vectors"))
    asked, texts = graph.neighbourhoods(g11(t, x), graph.merge_nodes(x("mentions")), graph.merge_edges(x("relations")))
    return graph.beside(v.join(asked, "q_id", "full"), texts.select("same", "context")).select("q_id", "vectors", "context").na.fill("", ["vectors", "context"])


# Tables

_SPAN_ROWS = """SELECT l_orderkey AS doc_id, ln, CAST(ln - 1 + ln % 2 AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, CAST(CASE WHEN ln % 2 = 1 THEN l_suppkey ELSE l_partkey END AS VARCHAR) AS c
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln FROM lineitem)"""
_SPAN_JSON = f"""SELECT doc_id, 0 AS ord, '{{"[, No]":"' || a || '","[Part, Id]":"' || b || '","[Part, Code]":"' || c || '"}}' AS json, CAST(ln - 1 AS INT) AS row FROM ({_SPAN_ROWS})
 UNION ALL SELECT DISTINCT l_orderkey, 1, '{{"col_0":"a","col_1":"b","col_2":"c"}}', 0 FROM lineitem WHERE l_orderkey % 2 = 0"""


def _spans(x):
    return tables.in_documents(x("span_tables"))


@query("C4", "SELECT DISTINCT l_orderkey AS doc_id, '[, No];[Part, Id];[Part, Code]' AS names FROM lineitem")
def c4(t, x):
    r = tables.fixed(_spans(x).where("ord = 0"), "r", tables.headed(F.col("html")))
    h = r.withColumn("h", tables.grid(F.slice("r.rows", F.lit(1), F.col("r.n"))))
    return h.select("doc_id", F.array_join(tables.header_names(F.col("h")), ";").alias("names"))


@query("C9", f"SELECT doc_id, CAST(ln + 1 AS INT) AS row, a || ';' || b || ';' || c AS cells FROM ({_SPAN_ROWS})")
def c9(t, x):
    g = _spans(x).where("ord = 0").select("doc_id", F.posexplode(tables.placed(F.col("html"))).alias("row", "c"))
    return g.where("row > 1").select("doc_id", "row", F.array_join("c", ";").alias("cells"))


@query("C10", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey AS table_id, 'pairs' AS kind, 0 AS row, '{{' || string_agg('"k' || CAST(ln AS VARCHAR) || '":"v ' || CAST(l_partkey AS VARCHAR) || '"', ',' ORDER BY ln) || '}}' AS json FROM l WHERE l_orderkey % 5 = 0 GROUP BY 1
UNION ALL SELECT l_orderkey, 'row headers', 0, '{{' || string_agg('"' || CAST(ln AS VARCHAR) || '":"' || CAST(l_partkey AS VARCHAR) || '"', ',' ORDER BY ln) || '}}' FROM l WHERE l_orderkey % 5 <> 0 AND l_orderkey % 3 = 0 AND n >= 2 GROUP BY 1
UNION ALL SELECT l_orderkey, 'headers', CAST(ln - 1 AS INT), '{{"No":"' || CAST(ln AS VARCHAR) || '","Part":"' || CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'b' END || '"}}' FROM l WHERE l_orderkey % 5 <> 0 AND (l_orderkey % 3 <> 0 OR n = 1)
""".replace("{{", "{").replace("}}", "}"))
def c10(t, x):
    return tables.rows_of(x("html_tables")).select("table_id", "kind", F.posexplode("rows").alias("row", "m")).select("table_id", "kind", "row", F.to_json("m").alias("json"))


@query("B6", f"SELECT doc_id, ord, row, json FROM ({_SPAN_JSON})")
def b6(t, x):
    return tables.rows_of(_spans(x)).select("doc_id", "ord", F.posexplode("rows").alias("row", "m")).select("doc_id", "ord", "row", F.to_json("m").alias("json"))


@query("C11", f"SELECT doc_id, 'Before' || chr(10) || '<table>' || max(CASE WHEN ord = 0 THEN j END) || '</table>' || chr(10) || 'after' || coalesce('<table>' || max(CASE WHEN ord = 1 THEN j END) || '</table>', '') AS content FROM (SELECT doc_id, ord, string_agg(json, ',' ORDER BY row) AS j FROM ({_SPAN_JSON}) GROUP BY 1, 2) GROUP BY 1")
def c11(t, x):
    return tables.replaced(x("span_tables"))


# Splits and merges


def _sql_end(text, at):
    """DuckDB's form of the nearest sentence end."""
    low = f"greatest({at} - 100, 0)"
    before, after = f"reverse(substr({text}, {low} + 1, {at} - {low}))", f"substr({text}, {at} + 1, 100)"
    one = lambda k, m: f"CASE WHEN instr({before}, {m}) > 0 THEN {{'far': instr({before}, {m}) - 1, 'k': {2 * k}, 'to': {at} - instr({before}, {m}) + 1}} END, CASE WHEN instr({after}, {m}) > 0 THEN {{'far': instr({after}, {m}), 'k': {2 * k + 1}, 'to': {at} + instr({after}, {m})}} END"
    return f"coalesce(list_min([{', '.join(one(k, m) for k, m in enumerate(['chr(46)', 'chr(63)', 'chr(33)', 'chr(12290)', 'chr(10)']))}]).to, {at})"


@query("B14", f"SELECT doc_id, CAST(place AS INT) AS place, CAST({_sql_end('text', 'place')} AS INT) AS sentence_end FROM (SELECT doc_id, text, unnest(range(100, length(text) + 1, 150)) AS place FROM documents)")
def b14(t, x):
    d = t("documents").where("length(text) >= 100").select("doc_id", "text", F.explode(F.sequence(F.lit(100), F.length("text"), F.lit(150))).alias("place"))
    return d.select("doc_id", "place", splits.sentence_end(F.col("text"), F.col("place")).cast("int").alias("sentence_end"))


_TRIM = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')".format
_B15 = f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 500),
s AS (SELECT doc_id, 0 AS i, 0 AS a, 0 AS b, 0 AS go, false AS done FROM d UNION ALL
 SELECT doc_id, i + 1, go, CASE WHEN ends THEN n ELSE e END, nx, ends FROM (SELECT *, e >= n OR length({_TRIM('substr(text, nx + 1)')}) BETWEEN 1 AND 79 AS ends FROM (SELECT *, {_sql_end('text', 'f')} AS nx FROM (SELECT *, greatest(e - 75, go) AS f FROM (
 SELECT s.doc_id, i, go, n, text, CASE WHEN go + 500 < n THEN {_sql_end('text', '(go + 500)')} ELSE n END AS e FROM s JOIN d USING (doc_id) WHERE NOT done))))),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM (SELECT doc_id, i, {_TRIM('substr(text, a + 1, b - a)')} AS t FROM s JOIN d USING (doc_id) WHERE i > 0) WHERE t <> ''),
l AS (SELECT doc_id, m, max(CASE WHEN k = m - 1 THEN t END) AS prev, max(CASE WHEN k = m THEN t END) AS last FROM p GROUP BY 1, 2 HAVING m > 1 AND length(last) < 80),
c AS (SELECT *, {_sql_end('prev', '(length(prev) - 80)')} AS cut FROM l),
u AS (SELECT doc_id, k - 1 AS piece, t FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND p.k >= c.m - 1) UNION ALL SELECT doc_id, m - 2, CASE WHEN cut > 80 THEN {_TRIM('substr(prev, 1, cut)')} ELSE {_TRIM("prev || ' ' || last")} END FROM c
 UNION ALL SELECT doc_id, m - 1, {_TRIM("substr(prev, cut + 1) || ' ' || last")} FROM c WHERE cut > 80 UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 500)"""


@query("B15", _B15 + " SELECT doc_id, CAST(piece AS INT) AS piece, t AS text FROM u")
def b15(t, x):
    return t("documents").where("text is not null").select("doc_id", F.posexplode(splits.sliding(F.col("text"))).alias("piece", "text"))


@query("B17", _B15 + " SELECT CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN doc_id || '_split_' || piece ELSE CAST(doc_id AS VARCHAR) END AS chunk_id, t AS content FROM u")
def b17(t, x):
    return splits.split_large(t("documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))


_PIECES = "SELECT l_orderkey AS doc_id, ln AS pos, CAST(ln // 4 % 3 + 1 AS INT) AS level, repeat('a', CAST(l_partkey % 80 AS INT)) || CAST(ln AS VARCHAR) AS content, ln // 2 AS page FROM " + _LI


@query("B16", f"""WITH p AS ({_PIECES}), a AS (SELECT *, level > 1 AND length(content) < 50 AND coalesce(lead(level) OVER w = level, false) AS takes, lead(content) OVER w AS nc, lead(pos) OVER w AS np, lead(page) OVER w AS npg FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT *, takes AND (pos - coalesce((SELECT max(z.pos) FROM a z WHERE z.doc_id = a.doc_id AND z.pos < a.pos AND NOT z.takes), 0)) % 2 = 1 AS first FROM a)
SELECT doc_id, pos, level, CASE WHEN first THEN content || chr(10) || chr(10) || nc ELSE content END AS content, CASE WHEN first THEN pos || ',' || np ELSE CAST(pos AS VARCHAR) END AS keywords, CASE WHEN first AND page <> npg THEN page || ',' || npg ELSE CAST(page AS VARCHAR) END AS page_num
 FROM b WHERE NOT EXISTS (SELECT 1 FROM b z WHERE z.doc_id = b.doc_id AND z.pos = b.pos - 1 AND z.first)""")
def b16(t, x):
    from pyspark.sql import Window as W

    l = t("lineitem").withColumn("pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    c = l.select(F.col("l_orderkey").alias("doc_id"), "pos", F.expr("cast(pos div 4 % 3 + 1 as int)").alias("level"), F.expr("concat(repeat('a', cast(l_partkey % 80 as int)), pos)").alias("content"), F.array("pos").alias("keywords"), F.array(F.expr("pos div 2")).alias("page_num"))
    return splits.merge_small(c).withColumns({"keywords": joined("keywords"), "page_num": joined("page_num")})


#: A document with a heading in a fence, which is none, and one that is underlined.
_B13_DOCS = "SELECT doc_id, content || chr(10) || '```' || chr(10) || '# no' || chr(10) || '```' || chr(10) || chr(10) || 'Setext ' || CAST(doc_id AS STRING) || chr(10) || '---' || chr(10) || 'tail ##' || chr(10) || '   ## Closed ##' AS content FROM md_docs m"


@query("B13", f"""WITH d AS ({_B13_DOCS.replace('STRING', 'VARCHAR')}), f AS (SELECT *, count_if(starts_with(line, '```')) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS fenced, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) = '---' AS under FROM ({_LINES.format('d')})),
l AS (SELECT *, CASE WHEN fenced THEN NULL WHEN under THEN 2 ELSE nullif(length(regexp_extract(line, '^ {{0,3}}(#+) ', 1)), 0) END AS level FROM f WHERE line <> '---'),
s AS (SELECT *, CASE WHEN level IS NOT NULL THEN regexp_replace(regexp_replace(line, '^ *#+ ', ''), ' #+$', '') END AS title, count(level) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
SELECT doc_id, section, level, CASE level WHEN 1 THEN title ELSE 'Order ' || doc_id || ' > ' || title END AS path, coalesce(body, '') AS body FROM (SELECT doc_id, section, CAST(max(level) AS INT) AS level, max(title) AS title, string_agg(line, chr(10) ORDER BY pos) FILTER (level IS NULL AND trim(line) <> '') AS body FROM s WHERE section > 0 GROUP BY 1, 2)""", "md_docs")
def b13(t, x):
    md = x("md_docs")
    return spans.sections_by_path(md.sparkSession.sql(_B13_DOCS.replace("md_docs", "{md}"), md=md))


@query("B21", f"""WITH s AS (SELECT l_orderkey AS doc_id, ln, '## Item ' || ln || chr(10) || repeat('x', 60) AS section FROM {_LI}), m AS (SELECT doc_id, ln, substr(content, 1, instr(content, '## Item ' || ln) - 1) AS before, substr(content, instr(content, '## Item ' || ln), length(section)) AS inside FROM s JOIN md_docs USING (doc_id))
SELECT doc_id, ln, array_to_string(list_sort(list_distinct(CAST(list_concat(regexp_extract_all(before, '>>> page_(\\d+)', 1)[-1:], regexp_extract_all(inside, '>>> page_(\\d+)', 1)) AS BIGINT[]))), ',') AS pages FROM m""", "md_docs")
def b21(t, x):
    d = x("md_docs").withColumn("n", F.regexp_count("content", F.lit("## Item ")))
    d = d.select("doc_id", "content", F.explode(F.sequence(F.lit(1), "n")).alias("ln")).withColumn("ln", F.col("ln").cast("bigint"))
    section = F.concat(F.lit("## Item "), F.col("ln").cast("string"), F.lit("\n" + "x" * 60))
    return d.select("doc_id", "ln", joined_of(splits.page_list(F.col("content"), section)).alias("pages"))


def joined_of(c):
    return F.array_join(c.cast("array<string>"), ",")


@query("B11", """WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, s FROM (SELECT doc_id, i, CASE WHEN i > 1 THEN '## ' ELSE '' END || regexp_replace(s, '\\s+$', '') AS s FROM (SELECT doc_id, unnest(string_split(content, chr(10) || '## ')) AS s, generate_subscripts(string_split(content, chr(10) || '## '), 1) AS i FROM md_docs))),
f AS (SELECT doc_id, i, s AS held, 0 AS chunk FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN length(held) < 300 AND length(held) + 1 + length(s) <= 1000 THEN held || chr(10) || s ELSE s END, CASE WHEN length(held) < 300 AND length(held) + 1 + length(s) <= 1000 THEN chunk ELSE chunk + 1 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
SELECT doc_id, chunk, max_by(held, i) AS text FROM f GROUP BY 1, 2""".replace("WITH RECURSIVE ", "WITH "), "md_docs")
def b11(t, x):
    return splits.hybrid(x("md_docs"))


@query("B8")
def b8(t, x):
    return splits.recursive_chunks(t("documents").select("doc_id", F.col("text").alias("content")))


# Sections of safety sheets

_SDS = "SELECT doc_id, unnest(string_split(content, chr(10))) AS line, CAST(generate_subscripts(string_split(content, chr(10)), 1) - 1 AS INT) AS pos FROM sds_docs"


def _like(line, pattern):
    return f"regexp_matches({line}, '{pattern.replace(chr(39), chr(39) * 2)}')"


_NORMED = f"SELECT doc_id, pos, line, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS n FROM ({_SDS})"
_KEPT = "list_reduce(list_sort(list(pos) FILTER ({0})), lambda kept, p: CASE WHEN len(kept) = 0 OR p - kept[-1] > {1} THEN list_append(kept, p) ELSE kept END, []::INT[])"
_IS_ROOT = f"NOT regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AND NOT {_like('n', sections.SUBSECTION)} AND {_like('n', sections.ROOT)}"
_ROOTS = f"SELECT doc_id, {_KEPT.format(_IS_ROOT, 3)} AS roots, {_KEPT.format(_like('n', sections.COMPOSITION), 2)} AS hints FROM ({_NORMED}) GROUP BY 1"
_BOUNDS = f"""SELECT doc_id, "start", least(coalesce(next, titled, lines), "start" + 12000) AS stop FROM (SELECT l.doc_id, "start", max(l.pos) + 1 AS lines, min(CASE WHEN root AND no > own AND l.pos >= "start" + 8 THEN l.pos END) AS next, max_by(CASE WHEN t THEN l.pos END, CASE WHEN t THEN sc * 100000 - l.pos END) AS titled FROM (
 SELECT l.*, list_contains(roots, pos) AS root, TRY_CAST(nullif(regexp_extract(n, '^[#>\\s]*(?:section\\s*)?(\\d{{1,2}})\\s*[:.)\\s\\-]', 1), '') AS INT) AS no, {_like('n', sections.LATER)} AND NOT {_like('n', sections.SUBSECTION)} AND pos >= b."start" + 8 AND pos < b."start" + 4000 AS t,
 CASE WHEN regexp_matches(line, '^\\s*##+\\s*\\S') THEN 4 ELSE 0 END + CASE WHEN length(line) < 80 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(line, '[.!?]\\s*$') THEN 3 ELSE 0 END - CASE WHEN length(line) - length(replace(line, ',', '')) > 2 THEN 1 ELSE 0 END - CASE WHEN length(line) > 140 THEN 1 ELSE 0 END AS sc, b."start", b.own
 FROM ({_NORMED}) l JOIN (SELECT * FROM starts JOIN r USING (doc_id)) b ON b.doc_id = l.doc_id) l GROUP BY 1, 2)"""
_STARTS = f"""WITH r AS ({_ROOTS}), m AS (SELECT l.*, list_contains(roots, pos) AS root, list_contains(hints, pos) AS hint, TRY_CAST(nullif(regexp_extract(n, '^[#>\\s]*(?:section\\s*)?(\\d{{1,2}})\\s*[:.)\\s\\-]', 1), '') AS INT) AS no FROM ({_NORMED}) l JOIN r USING (doc_id)),
starts AS (SELECT doc_id, "start", (SELECT max(no) FROM m z WHERE z.doc_id = g.doc_id AND z.pos = g."start") AS own FROM (SELECT doc_id, coalesce(min(CASE WHEN hint AND no = 3 THEN pos END), min(CASE WHEN hint THEN pos END), min(CASE WHEN root THEN pos END)) AS "start" FROM m GROUP BY 1) g)"""


@query("E5", f"SELECT doc_id, pos, line FROM ({_SDS}) WHERE trim(line) <> '' AND NOT {_like('line', sections.DROPPED)}", "sds_docs")
def e5(t, x):
    return chunk.lines(x("sds_docs")).where(sections.clean_line(F.col("line")))


_E6 = f"SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS content FROM ({_SDS}) WHERE pos BETWEEN 3 AND 6 OR (pos = 1 AND doc_id % 4 = 0) GROUP BY 1"


@query("E6", _E6, "sds_docs")
def e6(t, x):
    return sections.first_section(x("sds_docs"))


@query("E7", f"SELECT doc_id, array_to_string(roots, ',') AS roots, array_to_string(hints, ',') AS hints FROM ({_ROOTS})", "sds_docs")
def e7(t, x):
    return sections.roots(x("sds_docs")).select("doc_id", joined("roots").alias("roots"), joined("hints").alias("hints"))


@query("E8", _STARTS + ' SELECT doc_id, "start" FROM starts', "sds_docs")
def e8(t, x):
    return sections.composition_bounds(x("sds_docs")).select("doc_id", "start")


@query("E9", _STARTS + f" SELECT doc_id, CAST(stop AS INT) AS stop FROM ({_BOUNDS})", "sds_docs")
def e9(t, x):
    return sections.composition_bounds(x("sds_docs")).select("doc_id", "stop")


@query("E10", _STARTS + f""", b AS ({_BOUNDS}) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS raw, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT regexp_matches(line, '^\\s*\\d+\\s*/\\s*\\d+\\s*$')) AS cleaned FROM ({_SDS}) JOIN b USING (doc_id) WHERE pos >= "start" AND pos < stop GROUP BY 1""", "sds_docs")
def e10(t, x):
    return sections.composition(x("sds_docs"))


@query("E11", f"""WITH h AS (SELECT doc_id, pos, regexp_extract(line, '^(\\D*?)(\\d+)([:.)\\s\\-]+)', 1) AS a, regexp_extract(line, '^(\\D*?)(\\d+)([:.)\\s\\-]+)', 2) AS no, regexp_extract(line, '^(\\D*?)(\\d+)([:.)\\s\\-]+)', 3) AS c FROM ({_SDS}) WHERE {_like('line', sections.ROOT)} AND NOT {_like('line', sections.SUBSECTION)})
SELECT h.doc_id, h.pos, min(z.pos) AS next_pos FROM h LEFT JOIN h z ON z.doc_id = h.doc_id AND z.a = h.a AND z.c = h.c AND z.no <> h.no AND h.no <> '' AND z.pos > h.pos GROUP BY 1, 2""", "sds_docs")
def e11(t, x):
    return sections.next_headers(chunk.lines(x("sds_docs")).where(F.col("line").rlike(sections.ROOT) & ~F.col("line").rlike(sections.SUBSECTION)))


def _contact_sql(line):
    """DuckDB's form of whether a line only says how to reach someone."""
    few, digits = f"len(regexp_extract_all({line}, '[A-Za-z가-힣]{{2,}}')) <= 2", f"length(regexp_replace({line}, '[^0-9]', '', 'g'))"
    address = _like(line, sections.ADDRESS)
    return f"({_like(line, sections.CONTACT)} OR (({address} OR {_like(line, sections.REACHED)}) AND ({few} OR {digits} >= greatest(6, length({line}) // 3) OR ({address} AND length({line}) > 40))))"


_SAID = f"SELECT doc_id, pos, line, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS n FROM ({_SDS})"
_COMPANY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\([^)]*\\)', ' ', 'g'), '(?i)\\s*(tel|fax|phone|e-?mail|www\\.|https?:|address|주소|전화|팩스).*$', ''), '^[\\-.#>\\s]+', ''), '\\s+', ' ', 'g'))".format


def _labelled_sql(label):
    """(doc_id, pos, value) behind a label on its line, else in the next of seven lines that is no noise, contact, label or header."""
    quoted = lambda p: p.replace("'", "''")
    usable = f"n <> '' AND NOT regexp_matches(line, '^\\s*\\d+\\s*/\\s*\\d+\\s*$') AND NOT {_contact_sql('n')} AND NOT {_like('n', sections.PRODUCT_LABEL)} AND NOT {_like('n', sections.COMPANY_LABEL)} AND NOT {_like('n', sections.ROOT)}"
    value = f"trim(regexp_replace(regexp_replace(n, '{quoted(label)}', ''), '^\\s*[:\\-]\\s*', ''))"
    return f"""SELECT * FROM (SELECT doc_id, pos, coalesce(nullif({value}, ''), (SELECT min_by(z.n, z.pos) FROM (SELECT * FROM ({_SAID}) WHERE {usable}) z WHERE z.doc_id = l.doc_id AND z.pos BETWEEN l.pos + 1 AND l.pos + 7)) AS value
 FROM ({_SAID}) l WHERE pos < 300 AND {_like('n', label)}) WHERE value IS NOT NULL"""


_FIRST_FIVE = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, value) AS rank, pos, value FROM (SELECT doc_id, min(pos) AS pos, arg_min(value, (pos, value)) AS value FROM ({}) GROUP BY doc_id, lower(value)) QUALIFY rank <= 5".format


@query("E14", f"SELECT doc_id, pos FROM ({_SDS}) WHERE {_contact_sql('line')}", "sds_docs")
def e14(t, x):
    return chunk.lines(x("sds_docs")).where(sections.only_contact(F.col("line"))).select("doc_id", "pos")


_E15 = _FIRST_FIVE(_labelled_sql(sections.PRODUCT_LABEL))


@query("E15", _E15, "sds_docs")
def e15(t, x):
    return sections.products(x("sds_docs"))


_FOUND = f"""SELECT doc_id, pos, {_COMPANY('value')} AS value FROM ({_labelled_sql(sections.COMPANY_LABEL)} UNION ALL SELECT doc_id, pos, line FROM ({_SDS}) WHERE pos < 120 AND {_like('line', sections.LEGAL)} AND NOT {_like('line', sections.COMPANY_LABEL)} AND NOT {_like('line', sections.PRODUCT_LABEL)})"""
_E16 = _FIRST_FIVE(f"SELECT * FROM ({_FOUND}) WHERE value <> '' AND NOT {_like('value', sections.TITLE)} AND NOT {_contact_sql('value')}")


@query("E16", _E16, "sds_docs")
def e16(t, x):
    return sections.companies(x("sds_docs"))


_E17 = f"""WITH c AS ({_E16}), l AS (SELECT doc_id, pos, {_COMPANY('n')} AS n FROM ({_SAID})), k AS (SELECT *, {_like('n', sections.COMPANY_LABEL)} AS label FROM l),
w AS (SELECT doc_id, n AS value, sum(near) AS w FROM (SELECT doc_id, n, CASE WHEN lag(label, 1) OVER o THEN 2.8::DOUBLE ELSE 0 END + CASE WHEN lag(label, 2) OVER o THEN 1.4::DOUBLE ELSE 0 END + CASE WHEN lag(label, 3) OVER o THEN 0.7::DOUBLE ELSE 0 END AS near FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) GROUP BY 1, 2),
s AS (SELECT c.doc_id, c.rank, value, round(coalesce(w, 0) - CASE WHEN {_like('value', sections.TITLE)} THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN {_like('value', sections.ADDRESS)} OR {_like('value', sections.REACHED)} OR {_like('value', sections.CONTACT)} THEN 1.5::DOUBLE ELSE 0 END
 - CASE WHEN {_contact_sql('value')} THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN {_like('value', sections.LEGAL)} THEN 0.8::DOUBLE ELSE 0 END, 4) AS score FROM c LEFT JOIN w USING (doc_id, value))"""


@query("E17", _E17 + " SELECT doc_id, value AS company, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1", "sds_docs")
def e17(t, x):
    return sections.chosen_company(x("sds_docs"))


@query("E18", f"WITH s AS ({_E6}), p AS (SELECT * FROM ({_E15}) WHERE rank = 1) SELECT doc_id, value AS product, p_brand || ' Chemicals Ltd.' AS company, content AS excerpt FROM s JOIN p USING (doc_id) JOIN part ON p_partkey = doc_id", "sds_docs")
def e18(t, x):
    return sections.first_record(x("sds_docs"))


# Whole pipelines of chunks


#: A document with its image, link and table twice, on pages of their own; a table holds a table.
_B10_DOCS = """SELECT doc_id, content || chr(10) || 'See ' || url || ' x' || chr(10) || tab || chr(10) || '>>> page_9' || chr(10) || img || ' again ' || url || chr(10) || tab || 'Tail' AS content, url, tab, img FROM (
 SELECT doc_id, content, 'https://example.com/o/' || k AS url, '<table><tr><th>a</th></tr><tr><td>' || k || '<table><tr><td>in</td></tr></table></td></tr></table>' AS tab, '![order ' || k || '](img/' || k || '.png)' AS img FROM (SELECT *, CAST(doc_id AS {string}) AS k FROM md_docs) m) n"""
_B10 = f"""WITH d AS ({_B10_DOCS.format(string='VARCHAR')}),
p AS (SELECT doc_id, page_num, s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i) - 1, total) AS e FROM (
 SELECT doc_id, i, total, CAST(regexp_extract(p, '^(\\d+)', 1) AS INT) AS page_num, coalesce(sum(length(p) + 9) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
 SELECT doc_id, length(content) AS total, unnest(string_split(content, '>>> page_')[2:]) AS p, generate_subscripts(string_split(content, '>>> page_')[2:], 1) AS i FROM d))),
occ AS (SELECT doc_id, kind, CAST(i - 1 AS INT) AS ord, what, total, sum(length(part) + length(what)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(what) AS pl FROM (
 SELECT doc_id, kind, what, length(content) AS total, unnest(string_split(content, what)) AS part, generate_subscripts(string_split(content, what), 1) AS i, len(string_split(content, what)) AS n
 FROM (SELECT doc_id, content, unnest(['image', 'link', 'table']) AS kind, unnest([img, url, tab]) AS what FROM d)) WHERE i < n),
bare AS (SELECT doc_id, length(content) AS total, {_BLANKED(text="replace(replace(replace(content, img, repeat(' ', length(img))), url, repeat(' ', length(url))), tab, repeat(' ', length(tab)))")} AS content FROM d),
l AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS pl, nullif(length(regexp_extract(line, '^(#+)\\s', 1)), 0) AS level, regexp_replace(line, '^#+\\s+', '') AS title FROM (
 SELECT doc_id, total, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM bare)),
w AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER o AS h1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER o AS h2, count(level) OVER o AS ord FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
every AS (SELECT doc_id, kind, ord, CASE kind WHEN 'image' THEN 'img/' || doc_id || '.png' WHEN 'link' THEN what ELSE '[{{"a":"' || doc_id || 'in"}}]' END AS content,
  CASE kind WHEN 'link' THEN greatest(pl - 100, 0) ELSE pl END AS a, CASE kind WHEN 'link' THEN least(pl + length(what) + 100, total) ELSE pl + length(what) - 1 END AS b FROM occ
 UNION ALL SELECT doc_id, 'text', ord, concat_ws(' > ', h1, h2) || ' ' || string_agg(line, chr(10) ORDER BY pos), min(pl), max(least(pl + length(line), total - 1)) FROM w WHERE level IS NULL AND trim(line) <> '' GROUP BY doc_id, ord, h1, h2)
SELECT doc_id, kind, ord, content, CAST(a AS INT) AS "start", array_to_string(range(pa, greatest(pa, pb) + 1), ',') AS pages FROM (
 SELECT v.doc_id, kind, ord, content, a, coalesce(max(CASE WHEN a BETWEEN s AND e THEN page_num END), 0) AS pa, coalesce(max(CASE WHEN b BETWEEN s AND e THEN page_num END), 0) AS pb FROM every v LEFT JOIN p ON p.doc_id = v.doc_id GROUP BY ALL)""".replace("{{", "{").replace("}}", "}")


def _b10_docs(x):
    md = x("md_docs")
    return md.sparkSession.sql(_B10_DOCS.format(string="STRING").replace("md_docs", "{md}"), md=md)


@query("B10", _B10, "md_docs")
def b10(t, x):
    return spans.pipeline(_b10_docs(x)).select("doc_id", "kind", "ord", "content", "start", joined("page_num").alias("pages"))


#: A document with a long lead on even ids, a page, two short sections of level 2 and one of level 3.
_B22_DOCS = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN repeat('a', 600) || chr(10) ELSE '' END || content || chr(10) || '>>> page_3' || chr(10) || '## Short a' || chr(10) || '## Short b' || chr(10) || 'x **k' || CAST(doc_id AS STRING) || '**' || chr(10) || '### Deep' || chr(10) || 'y' AS content FROM mixed_docs m"""


@query("B22", f"""WITH i AS (SELECT l_orderkey AS k, ln, CAST(l_partkey AS VARCHAR) AS p, CAST(l_suppkey AS VARCHAR) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n, 1 - l_orderkey % 2 AS e FROM {_LI})
SELECT k AS doc_id, k || '_text_0_noheading_0' AS chunk_id, 'text' AS kind, 0 AS level, repeat('a', 500) AS content, '' AS keywords, '1' AS pages FROM i WHERE ln = 1 AND e = 1 UNION ALL SELECT k, k || '_text_0_noheading_1', 'text', 0, repeat('a', 175), '', '1' FROM i WHERE ln = 1 AND e = 1
UNION ALL SELECT k, k || '_text_' || (ln - 1 + e), 'text', 1, '# Item ' || ln || chr(10) || 'Intro ' || p || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || p || ' |' || chr(10) || 'See https://example.com/o/' || ln || ' there.', '', '1' FROM i
UNION ALL SELECT k, k || '_text_' || (n + e), 'text', 2, '## Short a' || chr(10) || chr(10) || '## Short b' || chr(10) || 'x **k' || k || '**', 'k' || k, '3' FROM i WHERE ln = 1 UNION ALL SELECT k, k || '_text_' || (n + e + 2), 'text', 3, '### Deep' || chr(10) || 'y', '', '3' FROM i WHERE ln = 1
UNION ALL SELECT k, k || '_table_' || (ln - 1), 'table', 1, 'part: ' || p || chr(10) || 'supplier: ' || s, '', '1' FROM i""")
def b22(t, x):
    m = x("mixed_docs")
    d = m.sparkSession.sql(_B22_DOCS.replace("mixed_docs", "{m}"), m=m)
    return spans.assemble(d).select("doc_id", "chunk_id", "kind", "level", "content", joined("keywords").alias("keywords"), joined("page_num").alias("pages"))
