"""Steps whose cost must not outgrow their input: what is shuffled, joined and broadcast."""

import random

import pyarrow as pa
import pytest

from sheaf.operators import sections, spans, tables
from sheaf.plans import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


SHEET = "SAFETY DATA SHEET\n1. Identification\nProduct name\nZeta\nManufacturer\nACME Ltd.\n2. Hazards identification\nx\n3. Composition/information on ingredients\na\nb\nc\nd\ne\nf\ng\n4. First-aid measures"


@pytest.mark.parametrize("of", [sections.chosen_company, sections.companies, sections.products, sections.first_record, sections.first_section, sections.roots, sections.composition_bounds, sections.composition])
def test_lines_of_sheets_stay_in_their_row(spark, of):
    """Lines were joined with what was found in them: a side whose size Spark took for that of the file was broadcast."""
    df = of(spark.createDataFrame([(1, SHEET), (2, None), (3, "")], "doc_id int, content string"))
    assert not {w for w in ("Join", "Aggregate", "Window") if w in plan(df)}
    assert len([r for r in df.collect() if r["doc_id"] == 1]) >= 1


def test_sheet(spark):
    d = spark.createDataFrame([(1, SHEET), (2, None)], "doc_id int, content string")
    assert [tuple(r) for r in sections.first_record(d).orderBy("doc_id").collect()] == [(1, "Zeta", "ACME Ltd.", "Product name\nZeta\nManufacturer\nACME Ltd."), (2, "UNKNOWN", "UNKNOWN", "")]
    assert [tuple(r) for r in sections.chosen_company(d).collect()] == [(1, "ACME Ltd.", 3.6)]
    assert [tuple(r) for r in sections.composition_bounds(d).collect()] == [(1, 8, 16)]


HTML = "<table><tr><th>No</th><th colspan=\"2\">Part</th></tr><tr><th>1</th><td> a  b</td></tr><tr><th>1</th><td>c</td><td>d</td></tr></table>"


@pytest.mark.parametrize("of", [tables.header_rows, tables.row_header_tables, tables.single_header_rows, tables.key_value_rows, tables.fallback_headers, tables.transposed_rows])
def test_cells_stay_in_their_row(spark, of):
    """Cells were shuffled and joined with what was found in them."""
    df = of(spark.createDataFrame([(1, HTML), (2, "<table></table>"), (3, None)], "table_id int, html string"))
    assert not {w for w in ("Join", "Aggregate", "Window", "Repartition") if w in plan(df)}
    assert {r["table_id"] for r in df.collect()} <= {1}


def test_rows_of_tables(spark):
    d = spark.createDataFrame([(1, HTML), (2, "<table><tr><td>k</td><td>v</td></tr></table>")], "table_id int, html string")
    got = lambda of: sorted(tuple(r) for r in of(d).collect())
    assert got(tables.header_rows) == [(1, 1), (2, 0)] and got(tables.row_header_tables) == [(1, True), (2, False)]
    assert got(tables.transposed_rows) == [(1, 1, "1", "c"), (1, 2, "1", "d")] and got(tables.key_value_rows) == [(2, 0, "k", "v")] and got(tables.fallback_headers) == [(2, 0, "col_0"), (2, 1, "col_1")]
    assert got(tables.single_header_rows) == [(1, t, c, h, v) for t, vs in ((1, ["1", "a b", ""]), (2, ["1", "c", "d"])) for c, (h, v) in enumerate(zip(["No", "Part", "Part"], vs), 1)]


def test_header_rows_of_a_thead(spark):
    """All rows of a thead are headers, of any cells, and no others; the thead was not looked at."""
    td, th = "<tr><td>a</td><td>b</td><td>c</td></tr>", "<tr><th>a</th><th>b</th><th>c</th></tr>"
    each = {1: (f"<thead>{td}{td}</thead>{td}", 2), 2: (f"<thead>{th}</thead><tbody>{th}{td}</tbody>", 1), 3: (f"<THEAD class='x'>{td}{th}{td}</THEAD>", 3), 4: (f"{th}{th}{td}{th}", 2), 5: (f"<thead>{th}</thead>{td}<thead>{td}</thead>", 1), 6: (f"<thead></thead>{th}{td}", 0)}
    d = spark.createDataFrame([(i, f"<table>{h}</table>") for i, (h, _) in each.items()], "table_id int, html string")
    assert {r.table_id: r.headers for r in tables.header_rows(d).collect()} == {i: n for i, (_, n) in each.items()}
    assert {r.table_id for r in tables.single_header_rows(d).collect()} == {2, 5} and {r.table_id for r in tables.fallback_headers(d).collect()} == {6}


def test_plain_html_is_read_as_by_the_parser():
    rng = random.Random(1)
    of = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", '<td rowspan="2">', '<th colspan="0">', '<td colspan="2000">', " a  b", "\n", "x"]
    for _ in range(5000):
        html = rng.choice(["", "<table>", "<table><tr>"]) + "".join(rng.choice(of) for _ in range(rng.randrange(25)))
        assert tables._PLAIN.fullmatch(html) and tables.table_cells(html) == tables.parsed_cells(html)
    assert not tables._PLAIN.fullmatch("<table><tr><td>&amp;</td></tr></table>") and not tables._PLAIN.fullmatch("<TABLE>")


@pytest.mark.parametrize("name", ["B2", "B10", "B21"])
def test_documents_of_ten_pages_and_more(spark, tmp_path, name):
    """The SQL took markers to have one digit, and pages to be in the order of their digits."""
    duckdb, pq = pytest.importorskip("duckdb"), pytest.importorskip("pyarrow.parquet")
    t = pq.read_table("/root/testdata/sf0.001/lineitem.parquet").slice(0, 100)
    at = t.schema.get_field_index("l_orderkey")
    pq.write_table(t.set_column(at, t.schema.field(at), pa.array([k // 50 for k in range(100)], t.schema.field(at).type)), f"{tmp_path}/lineitem.parquet")
    df, c = catalog.queries()[name](spark, str(tmp_path)), duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = c.sql(catalog.oracle_sql()[name])
    assert sorted(map(tuple, df.collect())) == sorted(want.select(*[f'"{n}"' for n in df.columns]).fetchall())


def test_entities_of_pages(spark, tmp_path):
    """The SQL knew four names, each with its semicolon."""
    duckdb = pytest.importorskip("duckdb")
    d = spark.createDataFrame([(1, "<p>&ampThe</p> &copy;&nbsp; &lt;b&gt; &#65;&#x42;C &#128; &notit; &unknown; & &#xD800; it&apos;s"), (2, "none")], "page_id bigint, html string")
    d.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, catalog.queries()["C1"](spark, str(tmp_path)).select("page_id", "text").collect())) == sorted(c.sql(catalog.oracle_sql()["C1"]).fetchall())


@pytest.mark.parametrize("of", [spans.sections, spans.header_chunks])
def test_lines_of_documents_stay_in_their_row(spark, of):
    """Lines went through windows and were gathered again."""
    d = spark.createDataFrame([(1, "x\n# A  \nb\n\t\n<table>\n# c\n</table>\n## D\ne"), (2, None)], "doc_id int, content string")
    assert not {w for w in ("Join", "Aggregate", "Window") if w in plan(of(d))}
    want = {
        "sections": [(1, 0, "text", None, 0, "x"), (1, 1, "text", "A", 0, "b\n\t"), (1, 1, "table", "A", 1, "# c"), (1, 2, "text", "D", 0, "e")],
        "header_chunks": [(1, 1, "A", "b\n\t\n<table>"), (1, 2, "c", "</table>"), (1, 3, "c > D", "e")],
    }
    assert [tuple(r) for r in of(d).collect()] == want[of.__name__]
