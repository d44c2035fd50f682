"""Chunks of whole documents that keep their places: one Arrow function over a column, so that batches and streams of documents are cut alike and nothing is shuffled."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators import splits, tables
from sheaf.session import python_ready

_MARKER = re.compile(r">>> page_(\d+)", re.A)
_IMAGE = re.compile(r"!\[(.*?)\]\((.*?)\)", re.S)
_URL = re.compile(r"https?://[^\s<>\"')\]]+")
_TAG = re.compile(r"<(/?)table\b[^>]*>", re.I)
_OPEN = re.compile(r"<table>", re.I)
_HEADER = re.compile(r"(#{1,6})\s(.*)")
_ASCII_HEADER = re.compile(r"(#{1,6})\s+(.*)", re.A)

CHUNK = pa.struct([("kind", pa.string()), ("ord", pa.int32()), ("content", pa.string()), ("metadata", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("page_num", pa.list_(pa.int32()))])
CHUNK_SQL = "array<struct<kind:string,ord:int,content:string,metadata:string,start:int,end:int,page_num:array<int>>>"


def blanked(text: str, places: list[tuple[int, int]]) -> str:
    """text with the given places (in order, apart) as spaces of equal length, so that other places hold."""
    out, at = [], 0
    for a, b in places:
        out += [text[at:a], " " * (b - a)]
        at = b
    return "".join(out) + text[at:]


def table_places(text: str) -> list[tuple[int, int]]:
    """From each `<table>` to the closing tag that balances it, tables inside counted; one that is never closed is none."""
    out: list[tuple[int, int]] = []
    opened: list[int] = []  # places of tags that are still open
    ends: dict[int, int] = {}
    for m in _TAG.finditer(text):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    for m in _OPEN.finditer(text):
        if (not out or m.start() >= out[-1][1]) and m.start() in ends:
            out.append((m.start(), ends[m.start()]))
    return out


def headed(text: str, header: re.Pattern = _HEADER, white: str | None = None) -> list[tuple]:
    """(number of headers so far, path, lines, start, end) of the lines between two headers, blank lines left out; text before the first header has no path. Lines of `white` alone are blank."""
    out: list[tuple] = []
    path: list[tuple[int, str]] = []
    lines, start, end, at, n = [], 0, 0, 0, 0

    def close():
        if lines:
            out.append((n, " > ".join(t for _, t in path), "\n".join(lines), start, end))
            lines.clear()

    for line in text.split("\n"):
        last = at + len(line) >= len(text)
        if m := header.match(line):
            close()
            n += 1
            level = len(m[1])
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, m[2].strip(white)))
        elif line.strip(white):
            if not lines:
                start = at
            lines.append(line)
            end = at + len(line) - last  # with its line end, if it has one
        at += len(line) + 1
    close()
    return out


def free(text: str, size: int, overlap: int) -> list[tuple]:
    """(number, piece, start, end) of recursive pieces, each looked for behind the start of the one before; (0, 0) where it isn't found."""
    out, at = [], 0
    for i, p in enumerate(splits.recursive(text, splits.SEPARATORS, size, overlap)):
        k = text.find(p, at)
        out.append((i, p, max(k, 0), k + len(p) - 1 if k >= 0 else 0))
        at = k + 1 if k >= 0 else at
    return out


def chunks_of(text: str, around: int = 100, size: int = 1000, overlap: int = 200) -> list[dict]:
    """The images, links, tables and texts of one document, in this order, with their places and pages. What one kind takes is blank for the kinds after it."""
    markers = [(int(m[1]), m.start(), m.end()) for m in _MARKER.finditer(text)]
    begins = [m[1] for m in markers]

    def page(at: int) -> int:
        k = bisect_right(begins, at) - 1
        return markers[k][0] if k >= 0 and at <= len(text) else 0

    out: list[dict] = []

    def add(kind, ord_, content, metadata, start, end):
        a, b = page(start), page(end)
        pages = [0] if start == end == 0 else list(range(a, max(a, b) + 1))
        out.append({"kind": kind, "ord": ord_, "content": content, "metadata": metadata, "start": start, "end": end, "page_num": pages})

    text = blanked(text, [m[1:] for m in markers])
    found = list(_IMAGE.finditer(text))
    for i, m in enumerate(found):
        add("image", i, m[2], m[1], m.start(), m.end() - 1)
    text = blanked(text, [m.span() for m in found])
    found = list(_URL.finditer(text))
    for i, m in enumerate(found):
        a, b = max(0, m.start() - around), min(len(text), m.end() + around)
        add("link", i, m[0], text[a : m.start()] + text[m.end() : b], a, b)
    text = blanked(text, [m.span() for m in found])
    places = table_places(text)
    for i, (a, b) in enumerate(places):
        add("table", i, text[a:b], "", a, b - 1)
    text = blanked(text, places)
    if re.search(r"^#{1,6}\s", text, re.M):
        for n, path, lines, a, b in headed(text):
            add("text", n, f"{path} {lines}" if path else lines, "", a, b)
    else:
        for n, piece, a, b in free(text, size, overlap):
            add("text", n, piece, "", a, b)
    return out


def _chunks(texts: pa.Array) -> pa.Array:
    return pa.array([chunks_of(x.as_py()) if x.is_valid else [] for x in texts], pa.list_(CHUNK))


def chunks(content: Column) -> Column:
    """The chunks of each document: array of (kind, ord, content, metadata, start, end, page_num).

    Offsets count from 0 in the document as it is, `end` included; a link's are those of the text around it. Every occurrence has its own, repeats too. Pages run from that of the start to that of
    the end; 0 stands for what precedes all markers, and a chunk at (0, 0) is on page 0. The content of a table is its HTML. A null document has no chunks.
    """
    python_ready()
    return F.arrow_udf(_chunks, CHUNK_SQL)(content)


def _under(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("chunk_seq", pa.int64()), ("path", pa.string()), ("body", pa.string())])
    return pa.array([[{"chunk_seq": n, "path": path, "body": lines} for n, path, lines, *_ in headed(x.as_py(), _ASCII_HEADER, " ") if n] if x.is_valid else [] for x in texts], pa.list_(kind))


def under_headers(content: Column) -> Column:
    """An array of (chunk_seq, path, body) for each document: without a window, so a stream can be cut too (B7, see header_chunks)."""
    python_ready()
    return F.arrow_udf(_under, "array<struct<chunk_seq:bigint,path:string,body:string>>")(content)


def header_chunks(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, chunk_seq, path, body): the non-blank lines under each header, with the titles of the headers above it joined by ' > '.

    A header's own title ends its path; a header without text gives no chunk (B7). Titles above are the last of each smaller level
    since a header of a level still smaller.
    """
    return docs.select(key, F.explode(under_headers(F.col(content))).alias("c")).select(key, "c.*")


_MARKS = re.compile(r"#+\s*", re.A)


def tabled(text: str) -> list[dict]:
    """The sections of one document as `sections` says."""
    out: dict[tuple, list[str]] = {}
    section, heading, opened, ended = 0, None, 0, 0
    for line in text.split("\n"):
        bare = line.strip(" ")
        t = bare.lower()
        opens, ends = t.startswith("<table"), t.endswith("</table>")
        opened, ended = opened + opens, ended + ends
        inside = opens or ends or opened > ended
        if line.startswith("#") and not inside:
            section, heading = section + 1, _MARKS.sub("", line, count=1).strip(" ")
        elif bare and not opens and not ends:
            out.setdefault((section, "table" if inside else "text", heading, opened if inside else 0), []).append(line)
    return [{"section": s, "kind": k, "heading": h, "ord": o, "text": "\n".join(lines)} for (s, k, h, o), lines in out.items()]


_TABLED = pa.struct([("section", pa.int64()), ("kind", pa.string()), ("heading", pa.string()), ("ord", pa.int64()), ("text", pa.string())])


def _tabled(texts: pa.Array) -> pa.Array:
    return pa.array([tabled(x.as_py()) if x.is_valid else [] for x in texts], pa.list_(_TABLED))


def sections(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, section, kind, heading, ord, text): under each `#` line its prose, and each of its `<table>` blocks by number (B12). Lines stay in their row."""
    python_ready()
    each = F.arrow_udf(_tabled, "array<struct<section:bigint,kind:string,heading:string,ord:bigint,text:string>>")(F.col(content))
    return docs.select(key, F.explode(each).alias("s")).select(key, "s.*")


def pipeline(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, kind, ord, content, metadata, page_num, start, end): images, links, tables and texts of each document (B10), of a batch or a stream.

    Tables are given as the JSON of their rows. Texts are those under headers, or recursive pieces of documents without headers.
    """
    x = docs.select(key, F.explode(chunks(F.col(content))).alias("c")).select(key, F.col("c.kind").alias("_kind"), "c.ord", "c.content", "c.metadata", "c.page_num", "c.start", "c.end")
    x = tables.rows_of(x.withColumn("_html", F.when(F.col("_kind") == "table", F.col("content"))), key, "_html")
    shown = F.when(F.col("_kind") == "table", F.to_json("rows")).otherwise(F.col("content"))
    return x.select(key, F.col("_kind").alias("kind"), F.col("ord").cast("bigint").alias("ord"), shown.alias("content"), "metadata", "page_num", "start", "end")


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")


def block_sections(text: str) -> list[dict]:
    """The sections of one document under its headings, read as blocks: `#` headings, and paragraphs underlined by `=` or `-`; within fences nothing is a heading.

    A heading's path is the one before cut to level - 1, and itself. Of lists and quotes only the lines are seen.
    """
    out: list[dict] = []
    path: list[str] = []
    fence, paragraph = "", 0  # the fence that is open; lines of the paragraph that ends here

    def heading(level: int, title: str):
        del path[level - 1 :]
        path.append(title)
        out.append({"section": len(out) + 1, "level": level, "path": " > ".join(path), "lines": []})

    before: list[str] = []  # lines under no heading
    for line in text.split("\n"):
        held = out[-1]["lines"] if out else before
        if fence:
            held.append(line)
            if (m := _FENCE.match(line)) and m[1].startswith(fence) and not m[2].strip():
                fence = ""
        elif (m := _FENCE.match(line)) and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], 0
            held.append(line)
        elif m := _ATX.match(line):
            heading(len(m[1]), (m[2] or "").strip())
            paragraph = 0
        elif paragraph and (m := _UNDER.match(line)):
            title = "\n".join(x.strip() for x in held[-paragraph:])
            del held[-paragraph:]
            heading(1 if m[1][0] == "=" else 2, title)
            paragraph = 0
        else:
            held.append(line)
            # Code is indented by four, unless it goes on with a paragraph.
            paragraph = paragraph + 1 if line.strip() and (paragraph or not re.match(r" {4}|\t", line)) else 0
    return [x | {"body": "\n".join(y for y in x.pop("lines") if y.strip())} for x in out]


_SECTION = pa.struct([("section", pa.int64()), ("level", pa.int32()), ("path", pa.string()), ("body", pa.string())])


def _by_path(texts: pa.Array) -> pa.Array:
    return pa.array([block_sections(x.as_py()) if x.is_valid else [] for x in texts], pa.list_(_SECTION))


def sections_by_path(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, section, level, path, body): sections under headings with the titles above them, and their lines that aren't blank."""
    python_ready()
    each = F.arrow_udf(_by_path, "array<struct<section:bigint,level:int,path:string,body:string>>")(F.col(content))
    return docs.select(key, F.explode(each).alias("s")).select(key, "s.*")


_PAGE_LINE = re.compile(r"\s*>{2,}\s*page[ _-]\d+\s*")
_BOLD = re.compile(r"\*\*(.*?)\*\*")


def assembled(key: str, text: str, least: int = 50, size: int = 500) -> list[dict]:
    """The chunks of one document as `assemble` says."""
    markers = [(m.start(), int(m[1])) for m in _MARKER.finditer(text)]

    def pages(start: int, n: int) -> list[int]:
        k = bisect_right(markers, (start, 1 << 60))
        return sorted({p for _, p in markers[max(k - 1, 0) : max(k, bisect_left(markers, (start + n,)))]}) or [1]

    sections: list[dict] = [{"level": 0, "lines": [], "start": 0}]
    found_tables: list[dict] = []
    inside: list[str] | None = None
    at = 0
    for line in text.split("\n"):
        t = line.strip().lower() if "<" in line else ""
        if inside is None and t.startswith("<table"):
            inside = []
            found_tables.append({"lines": inside, "start": at, "level": int(sections[-1]["level"] > 0)})
            if t.endswith("</table>"):
                inside = None
        elif inside is not None:
            if t.endswith("</table>"):
                inside = None
            else:
                inside.append(line)
        elif ">>" not in line or not _PAGE_LINE.fullmatch(line):
            if line.startswith("#"):
                sections.append({"level": len(line) - len(line.lstrip("#")), "lines": [line], "start": at})
            else:
                sections[-1]["lines"].append(line)
        at += len(line) + 1
    texts = []
    for s in sections:
        if content := "\n".join(s["lines"]).strip():
            texts.append({"chunk_id": f"{key}_text_{len(texts)}", "kind": "text", "level": s["level"], "content": content, "keywords": _BOLD.findall(content) if "**" in content else [], "page_num": pages(s["start"], len(content))})

    def pieces(c: dict, mark: str) -> list[dict]:
        if len(c["content"]) <= size:
            return [c]
        return [c | {"chunk_id": f"{c['chunk_id']}_{mark}_{i}", "content": p} for i, p in enumerate(splits.sliding_pieces(c["content"], size))]

    texts = [x for c in texts for x in (pieces(c, "noheading") if c["level"] == 0 else [c])]
    merged: list[dict] = []
    coming = iter([*texts, None])
    c = next(coming)
    while c is not None:
        n = next(coming)
        if n is not None and c["level"] != 1 and len(c["content"]) < least and n["level"] == c["level"]:
            c = c | {"content": f"{c['content']}\n\n{n['content']}", "keywords": c["keywords"] + n["keywords"], "page_num": sorted({*c["page_num"], *n["page_num"]})}
            n = next(coming)
        merged.append(c)
        c = n
    out = [x for c in merged for x in pieces(c, "split")]
    n = 0
    for t in found_tables:
        rows = [r for x in t["lines"] if (r := _json_row(x))]
        if rows:
            shown = "\n".join(" | ".join(f"{k}: {'' if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}" for k, v in r.items()) for r in rows)
            out.append({"chunk_id": f"{key}_table_{n}", "kind": "table", "level": t["level"], "content": shown, "keywords": [], "page_num": pages(t["start"], sum(map(len, t["lines"])))})
            n += 1
    return out


def _json_row(line: str) -> dict | None:
    line = line.strip()
    if not line.startswith("{"):  # no object: not worth an exception
        return None
    try:
        return json.loads(re.sub(r",\s*$", "", line))
    except ValueError:
        return None


_PART = pa.struct([("chunk_id", pa.string()), ("kind", pa.string()), ("level", pa.int32()), ("content", pa.string()), ("keywords", pa.list_(pa.string())), ("page_num", pa.list_(pa.int32()))])


def _assembled(keys: pa.Array, texts: pa.Array) -> pa.Array:
    """Lists of chunks, put together by columns: a row of Python each would cost more than the chunks."""
    ends, flat = [0], []
    for k, x in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
        if x is not None:
            flat += assembled(k, x)
        ends.append(len(flat))
    columns = [pa.array([c[f.name] for c in flat], f.type) for f in _PART]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_PART)))


def assemble(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, chunk_id, kind, level, content, keywords, page_num): sections and tables of each document as chunks (B22), of a batch or a stream.

    A section is a `#` line with what follows it, its level the number of its marks; what precedes all is level 0, and in pieces {id}_noheading_{i} if it is long. Short sections take in the next of their level, those of
    level 1 excepted (B16), and long ones are split (B17). Tables, whole, are those of JSON rows between table tags (B19, B20); their level is 1 under a heading, else 0. Keywords are what is bold (B18), pages those from
    the last marker before a section to the markers within its length, or 1 (B21). Page lines are left out.
    """
    python_ready()
    each = F.arrow_udf(_assembled, "array<struct<chunk_id:string,kind:string,level:int,content:string,keywords:array<string>,page_num:array<int>>>")(F.col(key).cast("string"), F.col(content))
    return docs.select(key, F.explode(each).alias("c")).select(key, "c.*")
