"""Markdown: blocks and inline runs as rows and arrays."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import lists

#: So many bytes of a batch's texts (one text at least) are Python objects at once.
PARSED = 1 << 20
BLOCK = "struct<type:string,level:int,lang:string,text:string>"


def blocks(md: str | None) -> list[tuple[str, int | None, str | None, str]]:
    """``(type, level, lang, text)``: heading, code, table, rule, quote, bullet, number, image, p."""
    out: list[tuple[str, int | None, str | None, str]] = []
    para: list[str] = []

    def close() -> None:
        if para:
            out.append(("p", None, None, " ".join(para)))
            para.clear()

    lines = iter((md or "").replace("\r", "").split("\n"))
    for line in lines:
        t = line.strip()
        if m := re.match(r"```(\w*)", t):
            close()
            code = []
            for x in lines:
                if x.strip().startswith("```"):
                    break
                code.append(x)
            out.append(("code", None, m[1], "\n".join(code)))
        elif not t:
            close()
        elif m := re.match(r"(#{1,6})\s+(.*)", t):
            close()
            out.append(("heading", len(m[1]), None, m[2].strip("# ")))
        elif re.fullmatch(r"(-{3,}|\*{3,}|_{3,})", t):
            close()
            out.append(("rule", None, None, ""))
        elif t.startswith("|") and t.endswith("|"):
            close()
            if not re.fullmatch(r"[|\s:-]+", t):
                cells = " | ".join(c.strip() for c in t[1:-1].split("|"))
                if out and out[-1][0] == "table":
                    out[-1] = ("table", None, None, out[-1][3] + "\n" + cells)
                else:
                    out.append(("table", None, None, cells))
        elif m := re.match(r"!\[([^\]]*)\]\(([^)]*)\)$", t):
            close()
            out.append(("image", None, m[2], m[1]))
        elif m := re.match(r">\s?(.*)", t):
            close()
            out.append(("quote", None, None, m[1]))
        elif m := re.match(r"(\s*)[-*+]\s+(.*)", line):
            close()
            out.append(("bullet", len(m[1]) // 2, None, m[2]))
        elif m := re.match(r"(\s*)(\d+)[.)]\s+(.*)", line):
            close()
            out.append(("number", int(m[2]), None, m[3]))
        else:
            para.append(t)
    close()
    return out


def _parsed(parse: Callable[[str | None], list[tuple]], texts: Column | str) -> Column:
    """The blocks of each text; a batch of long ones is parsed part by part."""
    fields = [("type", pa.string()), ("level", pa.int32()), ("lang", pa.string()), ("text", pa.string())]

    @F.arrow_udf(f"array<{BLOCK}>")
    def run(items: pa.Array) -> pa.Array:
        ends, at, done = np.cumsum(pc.binary_length(items).fill_null(0).to_numpy(zero_copy_only=False)), 0, []
        while at < len(items) or not done:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PARSED, "right")))
            done.append(lists((zip(*parse(x.as_py()), strict=True) for x in items.slice(at, upto - at)), fields))
            at = upto
        return pa.concat_arrays(done)

    return run(texts)


def markdown_blocks(docs: DataFrame, column: str = "markdown") -> DataFrame:
    """``doc_id, block, type, level, lang, text``."""
    return docs.select("doc_id", F.posexplode(_parsed(blocks, column)).alias("block", "b")).select("doc_id", "block", "b.*")


def inline_runs(md: Column) -> Column:
    """``array<struct<text, bold, italic, code>>`` of one line."""

    def runs(text: str | None):
        out = []
        for m in re.finditer(r"`([^`]+)`|\*\*\*(.+?)\*\*\*|\*\*(.+?)\*\*|\*([^*]+)\*|([^`*]+|[`*])", text or ""):
            code, both, bold, italic, plain = m.groups()
            out.append((code or both or bold or italic or plain, bool(both or bold), bool(both or italic), bool(code)))
        return out

    return F.udf(runs, "array<struct<text:string,bold:boolean,italic:boolean,code:boolean>>", useArrow=True)(md)


def page_blocks(text: str | None) -> list[tuple[str, int | None, str | None, str]]:
    """Blocks of a plain page: headings, code of two and more lines, paragraphs."""
    code_line = re.compile(r"[{};]\s*$|^\s*(def |class |import |return\b|if\s*\(|for\s*\(|while\s*\(|function\b|const |let |var |#include|int |void |SELECT\b|INSERT\b|UPDATE\b)|=>|==")
    prose = re.compile(r"^[A-Z\"'(][^{};=]*[.!?][\"')]?$")
    out: list[tuple[str, int | None, str | None, str]] = []
    para: list[str] = []
    code: list[str] = []

    def close_code() -> None:
        while code and not code[-1].strip():
            code.pop()
        if len(code) >= 2:
            out.append(("code", None, "", "\n".join(code)))
        elif code:
            para.append(code[0].strip())
        code.clear()

    def close() -> None:
        if para:
            out.append(("p", None, None, " ".join(" ".join(para).split())))
            para.clear()

    lines = (text or "").replace("\r", "").split("\n")
    for i, line in enumerate(lines):
        t = line.strip()
        if code_line.search(line) and not prose.match(t):
            if not code:
                close()
            code.append(line)
            continue
        if code and not t:
            code.append(line)
            continue
        close_code()
        ws = t.split()
        capital = sum(w[0].isupper() or w[0].isdigit() for w in ws)
        done = not para or para[-1][-1:] in ".!?:"
        if ws and len(t) > 2 and len(ws) <= 9 and (t[0].isupper() or t[0].isdigit()) and t[-1] not in ".,;:!?)" and (len(ws) <= 4 or capital / len(ws) >= 0.6) and done and i + 1 < len(lines):
            close()
            out.append(("heading", None, None, t))
        elif t:
            para.append(t)
        else:
            close()
    close_code()
    close()
    return out


def structure(pages: DataFrame) -> DataFrame:
    """``doc_id, page, block, type, lang, text`` of ``pages(doc_id, page, text)``."""
    return pages.select("doc_id", "page", F.posexplode(_parsed(page_blocks, "text")).alias("block", "b")).select("doc_id", "page", "block", "b.type", "b.lang", "b.text")
