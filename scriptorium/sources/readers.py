"""Files to pages: text, slides, word-processor files, old binary files, glyph runs, HTML.

``read_files`` takes the rows of ``spark.read.format("binaryFile")``; one small parser a
kind turns a file into ``(page, text)`` rows, and a file that can't be read gives one row
with ``problem`` and no text. Everything after that is column expressions.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MOST_BYTES = 25 << 20
EXTENSIONS = ("pdf", "txt", "md", "csv", "docx", "pptx", "doc", "ppt", "png", "jpg", "jpeg", "webp")
WORDS_PER_PAGE = 450
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def validated(files: DataFrame) -> DataFrame:
    """``files(path, length, ...)`` with ``extension`` and ``problem`` (null: in order)."""
    extension = T.file_extension(F.col("path"))
    problem = F.when(~extension.isin(*EXTENSIONS), "type").when(F.col("length") <= 0, "empty").when(F.col("length") > MOST_BYTES, "size")
    return files.withColumns({"extension": extension, "problem": problem})


def _paragraphs(node, tag: str, run: str) -> Iterator[str]:
    for p in node.iter(tag):
        text = "".join(t.text or "" for t in p.iter(run)).strip()
        if text:
            yield text


def slides(data: bytes) -> list[str]:
    """The slides of a presentation in the order it names, each with its notes; without one, by number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())

        def related(part: str) -> dict[str, str]:
            folder, _, file = part.rpartition("/")
            rels = f"{folder}/_rels/{file}.rels"
            if rels not in names:
                return {}
            out = {}
            for r in ElementTree.fromstring(z.read(rels)):
                where = r.get("Target", "")
                path = where[1:] if where.startswith("/") else f"{folder}/{where}"
                parts: list[str] = []
                for x in path.split("/"):
                    parts = parts[:-1] if x == ".." else [*parts, x]
                out[r.get("Id", "")] = "/".join(parts)
            return out

        order: list[str] = []
        if "ppt/presentation.xml" in names:
            known = related("ppt/presentation.xml")
            order = [known[i] for s in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{P}sldId") if (i := s.get(f"{R}id")) in known]
        order = [n for n in order if n in names] or sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        pages = []
        for name in order:
            lines = list(_paragraphs(ElementTree.fromstring(z.read(name)), f"{A}p", f"{A}t"))
            notes = [n for n in related(name).values() if "notesSlide" in n and n in names]
            for n in notes:
                said = [x for x in _paragraphs(ElementTree.fromstring(z.read(n)), f"{A}p", f"{A}t") if not x.isdigit()]
                lines += ["Notes: " + " ".join(said)] if said else []
            pages.append("\n".join(lines))
        return pages


def word_blocks(data: bytes) -> list[tuple[str, bool]]:
    """``(text, is heading)`` of a word-processor file; a table row is its cells with bars between."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    out: list[tuple[str, bool]] = []
    for node in body if body is not None else []:
        if node.tag == f"{WORD}p":
            text = "".join(t.text or "" for t in node.iter(f"{WORD}t")).strip()
            style = node.find(f"{WORD}pPr/{WORD}pStyle")
            listed = node.find(f"{WORD}pPr/{WORD}numPr") is not None
            heading = style is not None and style.get(f"{WORD}val", "").lower().startswith(("heading", "title"))
            if text:
                out.append((f"- {text}" if listed and not heading else text, heading))
        elif node.tag == f"{WORD}tbl":
            for row in node.iter(f"{WORD}tr"):
                out.append((" | ".join("".join(t.text or "" for t in c.iter(f"{WORD}t")).strip() for c in row.iter(f"{WORD}tc")), False))
    return [x for x in out if x[0].strip(" |")]


def paginated(blocks: list[tuple[str, bool]], words: int = WORDS_PER_PAGE) -> list[str]:
    from ..operators.folds import page_numbers

    numbers = page_numbers([(len(t.split()), h) for t, h in blocks], words)
    pages: dict[int, list[str]] = {}
    for n, (t, _) in zip(numbers, blocks, strict=True):
        pages.setdefault(n, []).append(t)
    return ["\n\n".join(p) for p in pages.values()] or [""]


def legacy_text(data: bytes) -> str:
    """Readable runs of an old binary file: two-byte characters first, single bytes where they give little."""
    wide = re.findall(rb"(?:[\x20-\x7e\xa0-\xff\t]\x00){4,}", data)
    runs = [x.decode("utf-16-le", "ignore") for x in wide]
    if sum(len(x.split()) for x in runs) < 40:
        runs += [x.decode("latin-1") for x in re.findall(rb"[\x20-\x7e\xa0-\xff\t]{8,}", data)]
    kept: dict[str, None] = {}
    for x in map(str.strip, runs):
        if x and sum(c.isalpha() for c in x) >= 0.55 * len(x):
            kept.setdefault(x)
    return "\n".join(kept)


def file_pages(extension: str, data: bytes) -> list[str]:
    if extension in ("txt", "md", "csv"):
        return data.decode("utf-8", "replace").split("\f")
    if extension == "pptx":
        return slides(data)
    if extension == "docx":
        return paginated(word_blocks(data))
    if extension in ("doc", "ppt"):
        text = legacy_text(data)
        if not text:
            raise ValueError("no readable text")
        return paginated([(t, False) for t in text.split("\n")])
    raise ValueError(f"no reader for {extension}")


def read_files(files: DataFrame) -> DataFrame:
    """``path, page, text, problem`` of ``files(path, length, content)``."""

    def go(batches):
        for b in batches:
            rows = []
            for path, ext, problem, data in zip(*(b[c].to_pylist() for c in ("path", "extension", "problem", "content")), strict=True):
                if problem:
                    rows.append((path, None, None, problem))
                    continue
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(file_pages(ext, data))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, None, f"unreadable: {type(e).__name__}"))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["path", "page", "text", "problem"])

    return validated(files).select("path", "extension", "problem", "content").mapInArrow(go, "path string, page int, text string, problem string")


def page_text(glyphs: Column) -> Column:
    """Lines of ``array<struct<str, x, size, eol>>``: a line's first run is indented by its
    distance from the left in characters of 0.55 of its size, between 2 and 40."""

    def step(a: Column, g: Column) -> Column:
        indent = F.floor(g["x"] / (g["size"] * 0.55)).cast("int")
        lead = F.when(a["fresh"] & indent.between(2, 40), F.repeat(F.lit(" "), indent)).otherwise("")
        return F.struct(F.concat(a["out"], lead, g["str"], F.when(g["eol"], "\n").otherwise("")).alias("out"), g["eol"].alias("fresh"))

    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("fresh"))
    return F.aggregate(glyphs, start, step, lambda a: T.strip(F.regexp_replace(a["out"], r"[ \t]+\n", "\n")))


def pages_needing_ocr(pages: DataFrame, most: int = 80) -> DataFrame:
    """``doc_id, page`` of ``pages(doc_id, page, text, has_picture)`` to recognise: all blank
    pages where most are blank, else those with a picture; ``most`` a document."""
    from pyspark.sql import Window

    per = Window.partitionBy("doc_id")
    marked = pages.withColumn("blank", T.is_blank_page(F.col("text"))).withColumn("share", F.avg(F.col("blank").cast("int")).over(per))
    wanted = marked.where(F.col("blank") & ((F.col("share") > 0.5) | F.col("has_picture")))
    return wanted.withColumn("r", F.row_number().over(per.orderBy("page"))).where(F.col("r") <= most).select("doc_id", "page")


def resumes(pages: DataFrame, least: int = 20) -> DataFrame:
    """``path, text`` of résumés: whole texts of at least ``least`` words, white space evened out."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    whole = pages.where("problem IS NULL").groupBy("path").agg(F.array_join(ordered, "\n").alias("t"))
    even = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", "\r", ""), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return whole.select("path", T.strip(even).alias("text")).where(T.word_count(F.col("text")) >= least)
