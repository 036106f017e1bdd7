"""Sentences and facts of a text by one pass a text, in Arrow batches.

They are those of ``text.split_sentences`` and ``text.heading_line``, which cost several times as much
as column expressions: each part of a text is a value there, here it is a slice.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W
from .counts import lists

#: White space as the JVM's patterns have it.
SPACES = " \t\n\x0b\f\r"


@functools.cache
def members(*kinds: str) -> str:
    """The characters of Unicode categories (``L``, ``Lu``) as the inside of a character class."""
    found, begun = [], None
    for i in range(sys.maxunicode + 2):
        held = i <= sys.maxunicode and unicodedata.category(chr(i)).startswith(kinds)
        if held and begun is None:
            begun = i
        elif not held and begun is not None:
            found.append(f"{re.escape(chr(begun))}-{re.escape(chr(i - 1))}")
            begun = None
    return "".join(found)


@functools.cache
def compiled(pattern: str) -> re.Pattern:
    """A pattern of the JVM's, whose ``\\s``, ``\\S``, ``\\d`` and ``\\w`` are ASCII."""
    inside = {r"\s": SPACES, r"\d": "0-9", r"\w": "A-Za-z0-9_"}

    def made(m: re.Match) -> str:
        if m[0][0] == "[":
            return re.sub(r"\\p\{(\w+)\}|\\[sdw]", lambda x: members(x[1]) if x[1] else inside[x[0]], m[0])
        return f"[^{SPACES}]" if m[0] == r"\S" else f"[{members(m[1]) if m[1] else inside[m[0]]}]"

    pattern = re.sub(r"^\(\?i\)", "(?ai)", pattern)  # there without u: ASCII letters alone have two casings
    return re.compile(re.sub(r"\[(?:\\.|[^\]\\])*\]|\\p\{(\w+)\}|\\[sSdw]", made, pattern))


def tidy_title(line: str) -> str:
    """``text.tidy_title``."""
    if line != line.upper():
        return line

    def word(i: int, w: str) -> str:
        low = w.lower()
        if i and low in W.SMALL_WORDS:
            return low
        if compiled("[0-9]").search(w) or (i and len(w) <= 4 and compiled("[A-Z]+").fullmatch(w)):
            return w
        return low if i else low[:1].upper() + low[1:]

    return " ".join(word(i, w) for i, w in enumerate(compiled(r"\s+").split(line)))


def words(low: str) -> list[str]:
    """``text.tokenize`` of a text in lower case."""
    return re.findall(r"[^\W_]+", low)


def fit(text: str, pattern: str) -> re.Pattern:
    """``compiled`` for this text: its classes without characters that the text has none of, as each of their ranges
    may take a comparison."""
    return _fit(pattern, "\x7f") if text.isascii() else compiled(pattern) if re.search("[\U00010000-\U0010ffff]", text) else _fit(pattern, "\uffff")


@functools.cache
def _fit(pattern: str, last: str) -> re.Pattern:
    known = "".join(f"{a}-{b}" for a, b in (("\x80", "\uffff"), ("\U00010000", "\U0010ffff")) if a > last)
    return re.compile(re.sub(f"[{known}]-[{known}]", "", compiled(pattern).pattern))


def squash(text: str) -> str:
    if "  " in text or any(c in text for c in "\n\t\r\x0b\f"):  # most texts are spared the search
        text = compiled(r"\s+").sub(" ", text)
    return text.strip(" ")


def strip(text: str) -> str:
    """White space at the ends goes; before a line separator that is last too, where the JVM's ``$`` stands."""
    return text[:-1].strip(SPACES) + text[-1] if text[-1:] in _SEPARATORS else text.strip(SPACES)


_SEPARATORS = frozenset("\x85\u2028\u2029")


@functools.lru_cache(100_000)
def capital(char: str) -> bool:
    return unicodedata.category(char) == "Lu"


def heading(line: str) -> bool:
    t = strip(line)
    if not t or not (t[0] in "0123456789" or capital(t[0])) or compiled("[.,;:!?)][\x85\u2028\u2029]?\\Z").search(t):
        return False
    words = compiled(r"\s+").split(t)
    return len(words) <= 4 or (len(words) <= 8 and sum(w[0] in "0123456789" or capital(w[0]) for w in words) >= len(words) * 0.6)


def _bare(parts: list[str]) -> list[str]:
    """Sentences without bullets and loose spaces; single characters are none."""
    bare = (squash(t[1:] if (t := p.lstrip(SPACES))[:1] in _BULLETS else t) for p in parts)
    return [s for s in bare if len(s) > 1]


_BULLETS = frozenset("-•*▪●")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: headings, blank lines and bullets part them too."""
    lines = (text or "").replace("\r", "").split("\n")
    if len(lines) > 1:
        filled = [bool(x.strip(SPACES)) for x in lines[1:]] + [False]
        lines = [x + "\n" if some and heading(x) else x for x, some in zip(lines, filled, strict=True)]
    joined = "\n".join(lines)
    return _bare(fit(joined, r"""(?<=[.!?])\s+(?=[\p{Lu}\p{N}"'(])|\n{2,}|\n(?=\s*[-•*▪●]\s)""").split(joined))


def paragraphs(page: str) -> Iterator[str]:
    """A line that begins in lower case or with a parenthesis continues one that doesn't end a sentence."""
    held: list[str] = []
    for line in filter(None, map(squash, page.split("\n"))):
        if held and (compiled("[.!?:][\x85\u2028\u2029]?\\Z").search(held[-1]) or not (line[0] == "(" or unicodedata.category(line[0]) == "Ll")):
            yield " ".join(held)
            held = []
        held.append(line)
    if held:
        yield " ".join(held)


def _letters(text: str) -> int:
    return len(text.encode().translate(None, _OTHER)) if text.isascii() else sum(map(str.isalpha, text))


_OTHER = bytes(i for i in range(256) if not chr(i).isalpha() or i > 127)


def facts(text: str | None) -> list[tuple[int, int, int, str]]:
    """``page, para, i, text`` of sentences of 5 to 70 words, mostly letters, each once a text in any casing;
    a form feed starts a page."""
    found, seen = [], set()
    for page, part in enumerate((text or "").split("\f")):
        for para, joined in enumerate(paragraphs(part)):
            for i, s in enumerate(_bare(fit(joined, r"""(?<=[.!?])\s+(?=[\p{Lu}\p{N}"'(])""").split(joined))):
                at = compiled(r"[0-9.) ]+").match(s).end() if s[0] in "0123456789.)" else 0
                said = strip(s[at:] if at and at < len(s) and s[at].isalpha() else s)
                if 4 <= said.count(" ") < 70 and _letters(said) >= len(said) * 0.55:
                    low = said.lower()
                    if low not in seen:
                        seen.add(low)
                        found.append((page, para, i, said))
    return found


@functools.cache
def _split():
    @F.arrow_udf("array<string>")
    def run(items: pa.Array) -> pa.Array:
        return pa.array(map(sentences, items.to_pylist()), pa.list_(pa.string()))

    return run


def split(c: Column) -> Column:
    """``text.split_sentences``."""
    return _split()(c)


FACT = [("page", pa.int32()), ("para", pa.int32()), ("i", pa.int32()), ("text", pa.string())]


def of_page(c: Column) -> Column:
    """The ``facts`` of a text as an array of structs."""

    @F.arrow_udf("array<struct<page:int,para:int,i:int,text:string>>")
    def run(items: pa.Array) -> pa.Array:
        return lists((list(zip(*facts(x), strict=True)) for x in items.to_pylist()), FACT)

    return run(c)
