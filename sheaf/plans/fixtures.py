"""Input tables made from the given ones by SQL that reads alike in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sheaf.session import dealt

_S = "CAST({} AS STRING)".format

FIXTURES = {
    "tds_docs": f"""SELECT p_partkey AS document_id, 'Density: ' || {_S('p_size')} || ' g/cm³'
 || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Tg: ' || {_S('p_size * 3')} || ' °C' ELSE '' END
 || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Tensile Strength: ' || {_S('p_size * 10')} || ' MPa' ELSE '' END
 || CASE WHEN p_partkey % 5 = 0 THEN chr(10) || 'Density: ' || {_S('p_size')} || ' g/cm³' ELSE '' END
 || CASE WHEN p_partkey % 4 = 0 THEN chr(10) || 'Shelf life: ' || {_S('p_size')} || ' months' ELSE '' END AS content FROM @part""",
    "llm_props": """SELECT p_partkey AS document_id, 'Density' AS property, CAST(p_size + 1 AS DOUBLE) AS value, 'g/cm³' AS unit, 1 AS ord FROM @part WHERE p_partkey % 7 = 0
 UNION ALL SELECT p_partkey, 'Density', CAST(p_size + 2 AS DOUBLE), 'g/cm³', 2 FROM @part WHERE p_partkey % 14 = 0
 UNION ALL SELECT p_partkey, 'Melt Flow', CAST(p_size AS DOUBLE), 'g/10min', 3 FROM @part WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey, 'tensile-strength', CAST(p_size AS DOUBLE), 'MPa', 4 FROM @part WHERE p_partkey % 2 = 0""",
    "ingredients": f"""SELECT l_orderkey AS product_id, l_linenumber AS seq, 'part ' || {_S('l_partkey')} AS name,
 CASE WHEN l_suppkey % 12 = 0 THEN 'confidential' WHEN l_suppkey % 12 = 4 THEN 'Proprietary blend' WHEN l_suppkey % 12 = 8 THEN 'see ' || {_S('l_suppkey')} WHEN l_suppkey % 4 = 1 THEN NULL ELSE {_S('l_partkey')} || '-' || lpad({_S('l_suppkey % 100')}, 2, '0') || '-' || {_S('l_linenumber % 10')} END AS cas,
 CASE l_linenumber % 5 WHEN 1 THEN {_S('l_partkey % 20 + 1')} || '-' || {_S('l_partkey % 20 + 11')} || '%' WHEN 2 THEN '<' || {_S('l_partkey % 20 + 1')} || '%'
 WHEN 3 THEN {_S('l_partkey % 20 + 1')} || '%' WHEN 4 THEN '비공개' ELSE '' END AS raw FROM @lineitem""",
    "mentions": f"""SELECT l_orderkey AS chunk_id, 'part ' || p_brand AS entity_name, p_type AS entity_type, l_returnflag AS description, 'f' || {_S('l_orderkey % 7')} AS file_path FROM @lineitem JOIN @part ON l_partkey = p_partkey
 UNION ALL SELECT l_orderkey, 'supplier ' || s_name, 'supplier', l_linestatus, 'f' || {_S('l_orderkey % 7')} FROM @lineitem JOIN @supplier ON l_suppkey = s_suppkey""",
    "relations": """SELECT l_orderkey AS chunk_id, 'part ' || p_brand AS src_id, 'supplier ' || s_name AS tgt_id, 1.0e0 AS weight, l_returnflag AS description, l_linestatus || ', ' || l_returnflag AS keywords, l_orderkey * 10 + l_linenumber AS seq
 FROM @lineitem JOIN @part ON l_partkey = p_partkey JOIN @supplier ON l_suppkey = s_suppkey""",
    "edges": f"""SELECT 's' || {_S('s_suppkey')} AS src, 'n' || {_S('s_nationkey')} AS tgt FROM @supplier
 UNION ALL SELECT 'c' || {_S('c_custkey')}, 'n' || {_S('c_nationkey')} FROM @customer""",
    "md_docs": f"""SELECT l_orderkey AS doc_id, AGG(part) AS content FROM (SELECT l_orderkey, ln,
 CASE WHEN ln % 2 = 1 THEN '>>> page_' || {_S('CAST(floor((ln + 1) / 2) AS INT)')} || chr(10) ELSE '' END
 || CASE WHEN ln = 1 THEN '# Order ' || {_S('l_orderkey')} || chr(10) || '![order ' || {_S('l_orderkey')} || '](img/' || {_S('l_orderkey')} || '.png)' || chr(10) ELSE '' END
 || '## Item ' || {_S('ln')} || chr(10) || 'Part **' || {_S('l_partkey')} || '** of supplier **' || {_S('l_suppkey')} || '**.' || chr(10) || chr(10) || chr(10) || 'End.' AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln FROM @lineitem) li) x GROUP BY l_orderkey""",
    "html_tables": f"""SELECT l_orderkey AS table_id, CASE WHEN l_orderkey % 5 = 0 THEN '<table>' ELSE '<table><tr><th>No</th><th colspan="2">Part</th></tr>' END || ROWS(tr) || '</table>' AS html FROM (SELECT l_orderkey, ln,
 CASE WHEN l_orderkey % 5 = 0 THEN '<tr><td>k' || {_S('ln')} || '</td><td>v  ' || {_S('l_partkey')} || '</td></tr>' WHEN l_orderkey % 3 = 0 THEN '<tr><th>' || {_S('ln')} || '</th><td>' || {_S('l_partkey')} || '</td></tr>'
 ELSE '<tr><td>' || {_S('ln')} || '</td><td> ' || {_S('l_partkey')} || '</td><td>b</td></tr>' END AS tr FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln FROM @lineitem) li) x GROUP BY l_orderkey""",
    "mixed_docs": f"""SELECT l_orderkey AS doc_id, AGG(part) AS content FROM (SELECT l_orderkey, ln,
 '# Item ' || {_S('ln')} || chr(10) || 'Intro ' || {_S('l_partkey')} || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || {_S('l_partkey')} || ' |' || chr(10) || 'See https://example.com/o/' || {_S('ln')} || ' there.' || chr(10)
 || '<table>' || chr(10) || '{{"part": "' || {_S('l_partkey')} || '"}},' || chr(10) || 'no row' || chr(10) || '{{"supplier": "' || {_S('l_suppkey')} || '"}}' || chr(10) || '</table>' AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln FROM @lineitem) li) x GROUP BY l_orderkey""",
    "answers": f"""SELECT p_partkey AS document_id, CASE p_partkey % 3 WHEN 0 THEN 'So:' || chr(10) || '```json' || chr(10) || '[{{"화학물질명": "' || p_name || '", "CAS": "1 "}},]' || chr(10) || '```' WHEN 1 THEN 'Here [{{"chemical_name": "' || p_name || '", "농도": "5-10%"}}] it is'
 ELSE '{{"components": [{{"화학물질명": "' || p_name || '", "카스 번호": "-"}}, {{"name": "b"}}]}}' END AS answer FROM @part""",
    "spans": f"""SELECT {_S('l_orderkey')} AS doc, 1 AS page, ln AS ord, CAST(l_quantity AS DOUBLE) AS x0, CAST(ln * 10 AS DOUBLE) AS y0, CAST(l_quantity + 5 AS DOUBLE) AS x1, CAST(ln * 10 + 8 AS DOUBLE) AS y1,
 'w' || {_S('l_partkey')} AS text, CAST(10 + 3 * (ln % 4) AS DOUBLE) AS font_size FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln FROM @lineitem) li""",
    "boxes": f"""SELECT DISTINCT {_S('l_orderkey')} AS doc, 1 AS page, CAST(floor((ln + 1) / 2) AS INT) AS box_ord, CASE WHEN ln <= 2 THEN 'SectionHeader' ELSE 'Text' END AS label,
 0.0e0 AS x0, CAST(floor((ln + 1) / 2) * 20 - 10 AS DOUBLE) AS y0, 100.0e0 AS x1, CAST(floor((ln + 1) / 2) * 20 + 8 AS DOUBLE) AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln FROM @lineitem) li""",
    "span_tables": f"""SELECT l_orderkey AS doc_id, 'Before' || chr(10) || '<table><tr><th rowspan="2">No</th><th colspan="2">Part</th></tr><tr><th>Id</th><th>Code</th></tr>' || ROWS(tr) || '</table>' || chr(10) || 'after' || CASE WHEN l_orderkey % 2 = 0 THEN '<table><tr><td>a</td><td>b</td><td>c</td></tr></table>' ELSE '' END AS content FROM (SELECT l_orderkey, ln,
 CASE WHEN ln % 2 = 1 THEN '<tr><td rowspan="2">' || {_S('ln')} || '</td><td>' || {_S('l_partkey')} || '</td><td>' || {_S('l_suppkey')} || '</td></tr>' ELSE '<tr><td colspan="2">' || {_S('l_partkey')} || '</td></tr>' END AS tr FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln FROM @lineitem) li) x GROUP BY l_orderkey""",
    "sds_docs": f"""SELECT p_partkey AS doc_id, 'SAFETY DATA SHEET' || chr(10) || CASE WHEN p_partkey % 4 = 0 THEN 'Intro' ELSE '1. Identification' END || chr(10) || '2/12' || chr(10) || 'Product name' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ': ' || p_name END || chr(10) || 'Manufacturer' || chr(10)
 || p_brand || ' Chemicals Ltd.' || chr(10) || 'Tel: 02-123' || chr(10) || 'All rights reserved' || chr(10) || '2. Hazards identification' || chr(10) || 'Flammable' || chr(10) || '## 3. Composition/information on ingredients' || chr(10) || '3.1 Substances' || chr(10)
 || 'part ' || {_S('p_size')} || chr(10) || 'b' || chr(10) || '3/12' || chr(10) || 'd' || chr(10) || 'e' || chr(10) || 'f' || chr(10) || 'g' || chr(10) || 'h' || chr(10) || CASE WHEN p_partkey % 2 = 1 THEN '## 4. First-aid measures' ELSE '## First-aid measures' END || chr(10) || 'last'
 || chr(10) || CASE p_partkey % 9 WHEN 0 THEN '| 5. Fire | x |' WHEN 1 THEN '서울 강남구 테헤란 로 12, 06236' WHEN 2 THEN '5.1 Media' || chr(10) || '5. Fire-fighting' WHEN 3 THEN 'Fax +82 2 555 0101' WHEN 4 THEN 'Contains ingredients of the kind' WHEN 5 THEN '제 15 장 법적 규제' WHEN 6 THEN 'Trade name - Zeta (new)' WHEN 7 THEN 'Importer' || chr(10) || 'ACME (Korea) GmbH Tel 02-1' || chr(10) || 'product NAME' || chr(10) || 'Fax: 1' || chr(10) || 'Zeta 2' ELSE 'https://a.example/sheet' END AS content FROM @part""",
    "surfaces": """SELECT p_partkey AS doc_id, p_name || CASE p_partkey % 6 WHEN 0 THEN ', Flash Point' WHEN 1 THEN ' CAS No. 12 (cas-no)' WHEN 2 THEN ' wt% 인화점 ppm' WHEN 3 THEN ' m.p. and no bp' WHEN 4 THEN ' vapour pressure, no more' ELSE ' snowflash pointed' END AS text FROM @part""",
    "chunks": """SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'image' WHEN 4 THEN 'table' ELSE 'text' END AS type, CASE WHEN doc_id % 5 = 3 THEN '' ELSE text END AS content, CASE WHEN doc_id % 5 = 3 THEN text ELSE source END AS metadata FROM @documents""",
    "queries": "SELECT item_id AS q_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS query, text AS truth FROM @benchmark",
    "products": f"""SELECT p_partkey AS k, 'file' || {_S('p_partkey % 50')} AS file_name, p_brand AS product_name, p_type AS company_name, p_partkey AS seq FROM @part""",
}


def spark_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name].replace("AGG(part)", "listagg(part, chr(10)) WITHIN GROUP (ORDER BY ln)").replace("ROWS(tr)", "listagg(tr, '') WITHIN GROUP (ORDER BY ln)")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"@(\w+)", sql))}
    if "PARTITION BY l_orderkey" in sql:  # by its window's key, over all tasks: what is read from the documents costs more than the lines' size tells
        used = [c for c in tables["lineitem"].columns if c in sql]
        tables["lineitem"] = dealt(tables["lineitem"].select(*used), "l_orderkey")
    sql = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"@(\w+)", r"{\1}", sql), **tables)


def with_fixtures(body: str, *names: str) -> str:
    """DuckDB SQL of body with fixtures as common tables."""
    if not names:
        return body
    one = lambda n: FIXTURES[n].replace("@", "").replace("AGG(part)", "string_agg(part, chr(10) ORDER BY ln)").replace("ROWS(tr)", "string_agg(tr, '' ORDER BY ln)")
    head = ", ".join(f"{n} AS ({one(n)})" for n in names)
    body = body.strip()
    return f"WITH RECURSIVE {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
