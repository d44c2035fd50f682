"""HTML tables to rows."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import ship

#: The most columns a cell spans, as in HTML: what a page asks for beyond is not more.
WIDEST = 1000


def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else entities.unescape(t) if "&" in t else t for x in texts], pa.string())


def clean(text: Column) -> Column:
    """Cell text: tags out, entities decoded, white space squeezed, trimmed."""
    ship()
    bare = F.arrow_udf(_unescaped, "string")(F.regexp_replace(text, "<[^>]*>", ""))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


class _Cells(HTMLParser):
    """Rows of cells of the first table. A cell that isn't closed ends with the next one, its row or the table; of a table in a cell, only the text is seen."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.head, self.heads = 0, False, False, None
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None
        self.text: list[str] = []

    def close_cell(self):
        if self.cell is not None:
            self.cell["text"] = " ".join("".join(self.text).split())
            self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if self.depth == 1 and not self.done:
            if tag == "thead" and self.heads is None:
                self.head, self.heads = True, 0
            elif tag == "tr":
                self.close_cell()
                self.rows.append([])
                if self.head:
                    self.heads += 1
            elif tag in ("td", "th") and self.rows:
                self.close_cell()
                span = lambda k: max(int(m[0]), 1) if (m := re.match(r"\d{1,9}", dict(attrs).get(k) or "")) else 1
                self.cell, self.text = {"tag": tag, "text": "", "rowspan": span("rowspan"), "colspan": min(span("colspan"), WIDEST)}, []
                self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.close_cell()
                self.done = True
        elif self.depth == 1 and not self.done:
            if tag in ("td", "th", "tr"):
                self.close_cell()
            elif tag == "thead":
                self.head = False

    def handle_data(self, data):
        if self.cell is not None and self.depth:
            self.text.append(data)


#: HTML whose tags are all of a few plain forms and which has no entities, and its tags: most tables.
_PLAIN = re.compile(r"""(?:[^<&]++|</?(?:table|tr|td|th)>|<t[dh] (?:rowspan|colspan)="[0-9]{1,9}">)*+""")
_PLAIN_TAG = re.compile(r"""<(/?)(table|tr|td|th)(?: (row|col)span="([0-9]+)")?>""")


def _plain_cells(html: str) -> list[list[dict]]:
    """As _Cells, of plain HTML."""
    rows: list[list[dict]] = []
    depth, cell, text = 0, None, []

    def close():
        if cell is not None:
            cell["text"] = " ".join("".join(text).split())

    parts = _PLAIN_TAG.split(html)
    for i in range(0, len(parts) - 1, 5):
        data, end, tag, span, n = parts[i : i + 5]
        if cell is not None and data:
            text.append(data)
        if tag == "table" and not end:
            depth += 1
        elif tag == "table" and depth:
            depth -= 1
            if not depth:
                break
        elif depth == 1:
            if end or tag == "tr" or rows:
                close()
                cell = None
            if end:
                continue
            if tag == "tr":
                rows.append([])
            elif rows:
                n = max(int(n), 1) if n else 1
                cell, text = {"tag": tag, "text": "", "rowspan": n if span == "row" else 1, "colspan": min(n, WIDEST) if span == "col" else 1}, []
                rows[-1].append(cell)
    else:
        if cell is not None and depth:
            text.append(parts[-1])
    close()
    return rows


def table_cells(html: str) -> tuple[list[list[dict]], int | None]:
    """The rows of cells of one table's HTML, and how many of them stand in its (first) thead, None without one."""
    if _PLAIN.fullmatch(html):
        return _plain_cells(html), None
    return parsed_cells(html)


def parsed_cells(html: str) -> tuple[list[list[dict]], int | None]:
    """As table_cells, by the standard library's parser, whatever the HTML."""
    parser = _Cells()
    parser.feed(html)
    parser.close()
    parser.close_cell()
    return parser.rows, parser.heads


def _rows(tables: DataFrame, key: str, html: str) -> DataFrame:
    """(key, _n, _r) of tables with cells: how many rows are headers (C2), and their rows as (th: whether all cells are headers, cells)."""
    x = fixed(tables.select(key, html), "_p", headed(F.col(html))).where(F.size("_p.rows") > 0)
    return fixed(x, "_r", F.transform("_p.rows", lambda r: F.struct(F.forall(r, lambda c: c.tag == "th").alias("th"), r.alias("cells")))).select(key, F.col("_p.n").alias("_n"), "_r")


def header_rows(tables: DataFrame, key: str = "table_id", html: str = "html") -> DataFrame:
    """(key, headers): how many rows are headers: all of a thead, whatever their cells, else the leading rows that are all `th`."""
    return _rows(tables, key, html).select(key, F.col("_n").alias("headers"))


def _beside(body: Column) -> Column:
    """Whether these body rows are two or more, and half of them (rounded down) start with a `th` followed by a `td`."""
    k = F.size(F.filter(body, lambda r: (F.get(r.cells, F.lit(0)).tag == "th") & F.coalesce(F.get(r.cells, F.lit(1)).tag == "td", F.lit(False))))
    return (F.size(body) >= 2) & (k >= F.floor(F.size(body) / 2))


def _with_body(tables: DataFrame, key: str, html: str) -> DataFrame:
    x = _rows(tables, key, html)
    return fixed(x, "_body", F.filter("_r", lambda r: ~r.th)).where(F.size("_body") > 0)


def row_header_tables(tables: DataFrame, key: str = "table_id", html: str = "html") -> DataFrame:
    """(key, is_row_header): two body rows or more, and half of them (rounded down) start with a `th` followed by a `td`."""
    return _with_body(tables, key, html).select(key, _beside(F.col("_body")).alias("is_row_header"))


def single_header_rows(tables: DataFrame, key: str = "table_id", html: str = "html") -> DataFrame:
    """(key, tr, header, value) of tables with one header row: header texts repeat over their colspan, short rows give "", cells beyond
    the headers and blank rows are dropped (C3, C9 without rowspans)."""
    x = _rows(tables, key, html).where("_n = 1")
    spread = F.transform("_r", lambda r: F.flatten(F.transform(r.cells, lambda c: F.array_repeat(c.text, c.colspan))))
    x = fixed(x, "_t", spread).select(key, F.get("_t", F.lit(0)).alias("_names"), F.posexplode("_t").alias("tr", "texts")).where("tr > 0")
    x = x.where(F.exists(F.slice("texts", 1, F.greatest(F.size("_names"), F.lit(1))), lambda t: t != ""))
    each = x.select(key, "tr", "texts", F.posexplode("_names").alias("i", "header"))
    return each.select(key, "tr", (F.col("i") + 1).alias("col"), "header", F.coalesce(F.get("texts", F.col("i")), F.lit("")).alias("value"))


def key_value_rows(tables: DataFrame, key: str = "table_id", html: str = "html") -> DataFrame:
    """(key, tr, header, value) of tables without `th` whose rows all have two cells."""
    x = _rows(tables, key, html).where(F.forall("_r", lambda r: (F.size(r.cells) == 2) & F.forall(r.cells, lambda c: c.tag != "th")))
    each = x.select(key, F.posexplode("_r").alias("tr", "r"))
    return each.select(key, "tr", F.col("r.cells")[0].text.alias("header"), F.col("r.cells")[1].text.alias("value"))


def fallback_headers(tables: DataFrame, key: str = "table_id", html: str = "html") -> DataFrame:
    """(key, ord, header): `col_0`, `col_1`… by the cells of the first row, for tables without header rows."""
    x = _rows(tables, key, html).where("_n = 0")
    return x.select(key, F.explode(F.sequence(F.lit(0), F.size(F.get("_r", F.lit(0)).cells) - 1)).alias("ord")).select(key, "ord", F.concat(F.lit("col_"), F.col("ord").cast("string")).alias("header"))


def transposed_rows(tables: DataFrame, key: str = "table_id", html: str = "html") -> DataFrame:
    """(key, col, header, value) of row-header tables: each column becomes a row, headers are the first cells; "" where missing,
    all-blank columns dropped, the last of repeated headers wins (C7)."""
    x = _with_body(tables, key, html).where(_beside(F.col("_body")))
    by = F.array_sort(F.transform("_body", lambda r, i: F.struct(F.get(r.cells, F.lit(0)).text.alias("header"), (-i).alias("i"))))
    x = fixed(fixed(x, "_by", by), "_last", F.filter("_by", lambda h, i: (i == 0) | (h.header != F.get("_by", i - 1).header)))
    widest = F.array_max(F.transform("_body", lambda r: F.size(r.cells))) - 1
    each = x.select(key, "_body", "_last", F.explode(F.sequence(F.lit(1), F.greatest(widest, F.lit(1)))).alias("col"))
    texts = F.transform("_last", lambda h: F.struct(h.header.alias("header"), F.coalesce(F.get(F.get("_body", -h.i).cells, F.col("col")).text, F.lit("")).alias("value")))
    each = fixed(each, "_v", texts).where(F.exists("_v", lambda v: v.value != ""))
    return each.select(key, "col", F.explode("_v").alias("v")).select(key, "col", "v.*")


# Whole tables in one row: a table is never spread over tasks, and nothing is shuffled.

CELL = "array<array<struct<tag:string,text:string,rowspan:int,colspan:int>>>"
_CELL = pa.struct([("tag", pa.string()), ("text", pa.string()), ("rowspan", pa.int32()), ("colspan", pa.int32())])
_WHOLE = pa.struct([("rows", pa.list_(pa.list_(_CELL))), ("n", pa.int32()), ("heads", pa.list_(pa.list_(pa.string()))), ("data", pa.list_(pa.list_(pa.string())))])
_HEADED = pa.struct([("rows", pa.list_(pa.list_(_CELL))), ("n", pa.int32())])
HEADED = f"struct<rows:{CELL},n:int>"
WHOLE = f"struct<rows:{CELL},n:int,heads:array<array<string>>,data:array<array<string>>>"


def _lists(of: list, make) -> pa.Array:
    """An Arrow list for each list of `of`, null for None, with the values that make gives of all elements at once: much faster than by Python objects."""
    at, ends = 0, [0]
    for x in of:
        at += len(x or ())
        ends.append(at)
    offsets = pa.array(ends, pa.int32())
    return pa.ListArray.from_arrays(offsets, make([y for x in of for y in x or ()]), mask=pa.array([x is None for x in of], pa.bool_()))


def _cell_arrays(cells: list[dict]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([c[f.name] for c in cells], f.type) for f in _CELL], fields=list(_CELL))


def _row_arrays(tables: list) -> pa.Array:
    return _lists(tables, lambda rows: _lists(rows, _cell_arrays))


def _text_arrays(grids: list) -> pa.Array:
    return _lists(grids, lambda rows: _lists(rows, lambda texts: pa.array(texts, pa.string())))


def _read(texts: pa.Array) -> tuple[list, list[int]]:
    """Of each table the rows of cells, those without left out, and how many rows are headers: those of a thead, else the leading rows of `th` alone."""
    every, ns = [], []
    for x in texts.to_pylist():
        rows, n = table_cells(x or "")
        rows = [r for r in rows if r]
        every.append(rows)
        ns.append(next((i for i, r in enumerate(rows) if any(c["tag"] != "th" for c in r)), len(rows)) if n is None else n)
    return every, ns


def _headed(texts: pa.Array) -> pa.Array:
    every, ns = _read(texts)
    return pa.StructArray.from_arrays([_row_arrays(every), pa.array(ns, pa.int32())], fields=list(_HEADED))


def headed(html: Column) -> Column:
    """One table's HTML as rows of cells (tag, text, rowspan, colspan), those without cells left out, and how many rows are headers."""
    ship()
    return F.arrow_udf(_headed, HEADED)(html)


def _placed(rows: list) -> list:
    """The texts of one table's rows on a grid: cells repeat over their spans, and later cells move to the next free column."""
    down: dict[int, tuple[int, str]] = {}
    out = []
    for row in rows:
        line, cells = {}, iter(row)
        for col, (left, text) in list(down.items()):
            line[col] = text
            down[col] = (left - 1, text)
        down = {c: v for c, v in down.items() if v[0] > 0}
        at = 0
        for c in cells:
            for _ in range(min(c["colspan"], WIDEST)):
                while at in line:
                    at += 1
                line[at] = c["text"]
                if c["rowspan"] > 1:
                    down[at] = (c["rowspan"] - 1, c["text"])
        out.append([line.get(i, "") for i in range(max(line) + 1 if line else 0)])
    return out


def _grids(rows: pa.Array) -> pa.Array:
    return _text_arrays([None if r is None else _placed(r) for r in rows.to_pylist()])


def grid(rows: Column) -> Column:
    """Rows of cells as rows of texts with their row and column spans filled."""
    return F.arrow_udf(_grids, "array<array<string>>")(rows)


def _placed_html(texts: pa.Array) -> pa.Array:
    return _text_arrays([_placed([r for r in table_cells(x or "")[0] if r]) for x in texts.to_pylist()])


def placed(html: Column) -> Column:
    """One table's HTML, parsed and placed on a grid at once."""
    ship()
    return F.arrow_udf(_placed_html, "array<array<string>>")(html)


def _wholes(texts: pa.Array) -> pa.Array:
    every, ns = _read(texts)
    heads = _text_arrays([_placed(r[:n]) for r, n in zip(every, ns, strict=True)])
    data = _text_arrays([_placed(r[n:]) for r, n in zip(every, ns, strict=True)])
    return pa.StructArray.from_arrays([_row_arrays(every), pa.array(ns, pa.int32()), heads, data], fields=list(_WHOLE))


def whole(html: Column) -> Column:
    """One table's HTML, parsed and placed at once: rows of cells, how many rows are headers (C2), and the grids of these and of the others."""
    ship()
    return F.arrow_udf(_wholes, WHOLE)(html)


def header_names(heads: Column) -> Column:
    """A name for each column of a grid of header rows: its text for one row; `[a, b]` for more, where a repeat of the text above is
    blank, and a text that stands alone comes last (C4)."""
    width = F.coalesce(F.array_max(F.transform(heads, F.size)), F.lit(0))

    def name(i):
        above = F.transform(heads, lambda r: F.coalesce(F.get(r, i), F.lit("")))
        only = F.array_distinct(F.filter(above, lambda s: s != ""))
        once = F.transform(above, lambda s, j: F.when((j > 0) & (s == F.get(above, j - 1)), F.lit("")).otherwise(s))
        last = F.concat(F.array_repeat(F.lit(""), F.size(above) - 1), only)
        return F.concat(F.lit("["), F.array_join(F.when(F.size(only) == 1, last).otherwise(once), ", "), F.lit("]"))

    many = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), name)
    return F.when(F.size(heads) == 1, F.element_at(heads, 1)).when(width > 0, many).otherwise(F.array().cast("array<string>"))


def once(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once, where later columns would each repeat its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def as_map(names: Column, values: Column) -> Column:
    """A map of names to values, "" where there are fewer values; the last of a repeated name counts."""
    last = F.filter(F.sequence(F.lit(0), F.greatest(F.size(names) - 1, F.lit(0))), lambda i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), F.get(names, i)) & F.get(names, i).isNotNull())
    return F.map_from_entries(F.transform(last, lambda i: F.struct(F.get(names, i), F.coalesce(F.get(values, i), F.lit("")))))


def rows_of(tables: DataFrame, key: str = "table_id", html: str = "html") -> DataFrame:
    """tables with `kind` and `rows`, an array of maps.

    A row-header table (two body rows or more, half of them a `th` before a `td`) gives a row for each column (C7); one with header
    rows a row for each body row (C3, C4, C9); one of pairs alone a single row of keys and values (C8); others have `col_0`,
    `col_1`… for names (C5). Blank rows are left out. HTML without rows gives no rows.
    """
    x = fixed(tables, "_w", whole(F.col(html)))
    x = x.withColumns({f"_{k}": F.col(f"_w.{k}") for k in ("rows", "n", "heads", "data")}).drop("_w")
    x = x.withColumn("_body", F.slice("_rows", F.col("_n") + 1, F.greatest(F.size("_rows"), F.lit(1))))
    beside = lambda body: F.size(F.filter(body, lambda r: (F.get(r, F.lit(0)).tag == "th") & F.coalesce(F.get(r, F.lit(1)).tag == "td", F.lit(False))))
    pairs = lambda r: F.forall(r, lambda c: (F.size(c) == 2) & F.forall(c, lambda d: d.tag == "td"))
    text = lambda body, i: F.transform(body, lambda r: F.coalesce(F.get(r, i).text, F.lit("")))
    shown = lambda v: F.exists(v, lambda s: s != "")

    def turned(body):
        widest = F.coalesce(F.array_max(F.transform(body, F.size)), F.lit(0))
        columns = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(widest - 1, F.lit(1))), lambda i: text(body, i)), shown)
        return once(text(body, F.lit(0)), lambda names: F.transform(columns, lambda v: as_map(names, v)))

    def by_tags(rows):
        """struct(kind, rows) where the tags decide; rows are null where names and grid give them."""
        body, none = F.col("_body"), F.lit(None).cast("array<map<string,string>>")
        of = lambda kind, r: F.struct(F.lit(kind).alias("kind"), r.alias("rows"))
        n = F.size(body)
        return (
            F.when((n >= 2) & (beside(body) >= F.floor(n / 2)), of("row headers", turned(body))).when(F.size(rows) == 0, of("none", F.array().cast("array<map<string,string>>"))).when(F.col("_n") > 0, of("headers", none))
            .when(pairs(rows), of("pairs", F.array(as_map(text(body, F.lit(0)), text(body, F.lit(1)))))).otherwise(of("plain", none))
        )

    plain = F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.element_at("_data", 1)) - 1, F.lit(0))), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    names = F.when(F.size("_heads") > 0, header_names(F.col("_heads"))).when(F.size("_data") > 0, plain).otherwise(F.array().cast("array<string>"))
    x = fixed(x, "_names", names)
    below = F.transform(F.filter(F.transform("_data", lambda v: F.slice(v, F.lit(1), F.greatest(F.size("_names"), F.lit(1)))), shown), lambda v: as_map(F.col("_names"), v))
    x = fixed(x, "_by", by_tags(F.col("_rows")))
    return x.withColumn("kind", F.col("_by.kind")).withColumn("rows", F.coalesce("_by.rows", below)).drop("_rows", "_n", "_body", "_heads", "_data", "_by", "_names")


TABLE = r"(?is)<table>.*?</table>"


def in_documents(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, ord, html) of each `<table>` in each document."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(content, F.lit(TABLE), 0)).alias("ord", "html"))


def replaced(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, content) with each table's HTML replaced by its rows as JSON, comma-separated, in `<table>` tags (C11)."""
    found = rows_of(in_documents(docs, key, content)).select(key, "ord", F.array_join(F.transform("rows", lambda m: F.to_json(m)), ",").alias("json"))
    g = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "json"))).alias("t"))
    parts = F.split(content, TABLE, -1)
    woven = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.concat(F.lit("<table>"), F.get("t.json", i), F.lit("</table>")), F.lit("")))), "")
    return docs.select(key, content).join(g, key, "left").select(key, F.when(F.col("t").isNull(), F.col(content)).otherwise(woven).alias(content))
