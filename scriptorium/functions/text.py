"""Text functions on columns: everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def micros(ts: Column) -> Column:
    """A timestamp of either kind as whole microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """White space collapsed and stripped."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def content_terms(c: Column) -> Column:
    return F.filter(tokenize(c), lambda t: (F.length(t) > 1) & ~stop_word(t))


def stop_word(t: Column) -> Column:
    return t.isin(*W.STOP_WORDS)


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))


def runs(items: Column, made: Callable[[Column, Column], Column], kind: str) -> Column:
    """``made(first, n)`` of each run of equal ``term`` in an array of structs that begin with it, sorted first:
    what a group by term would give, within one row."""

    def cut(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i)["term"] != F.get(a, i - 1)["term"]))
        return let(starts, lambda ss: F.transform(ss, lambda i, j: made(F.get(a, i), F.coalesce(F.get(ss, j + 1), F.size(a)) - i)))

    # sort_array compares in generated code, array_sort by an expression for each pair
    return let(F.sort_array(items), lambda a: F.when(F.size(a) > 0, cut(a)).otherwise(F.array().cast(f"array<struct<{kind}>>")))


def counted(terms: Column) -> Column:
    """The distinct terms of an array in their order, each with how often and where it first stands."""
    placed = F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("first")))
    return runs(placed, lambda x, n: F.struct(x["term"].alias("term"), n.alias("tf"), x["first"].alias("first")), "term:string,tf:int,first:int")


def stem_light(t: Column) -> Column:
    """The retrieval stemmer: an ending of ing, ed, es or s goes."""
    cut = lambda n: F.substr(t, F.lit(1), F.length(t) - n)
    return F.when(F.endswith(t, F.lit("ing")), cut(3)).when(F.endswith(t, F.lit("ed")) | F.endswith(t, F.lit("es")), cut(2)).when(F.endswith(t, F.lit("s")), cut(1)).otherwise(t)


def light_forms(stem: Column) -> Column:
    """All words of a light stem."""
    return F.filter(F.array(*[F.concat(stem, F.lit(e)) for e in ("", "ing", "ed", "es", "s")]), lambda w: stem_light(w) == stem)


def stem_prefix(t: Column) -> Column:
    """The scoring stemmer."""
    return F.substring(t, 1, 5)


def stem_search(t: Column) -> Column:
    """The search stemmer: the longest suffix of the list that leaves three characters goes."""
    suffix = F.regexp_extract(t, rf"^(.{{3,}}?)({'|'.join(W.SEARCH_SUFFIXES)})$", 2)
    cut = F.concat(F.substr(t, F.lit(1), F.length(t) - F.length(suffix)), F.when(suffix == "ies", "y").otherwise(""))
    return F.when((F.length(t) <= 3) | t.rlike(r"^\d+$"), t).otherwise(cut)


def heading_line(line: Column) -> Column:
    """A short title-like line without closing punctuation."""
    t = strip(line)
    upper = r"^[\p{Lu}\d]"

    def shape(ws: Column) -> Column:
        capitals = F.size(F.filter(ws, lambda w: w.rlike(upper)))
        return (F.size(ws) <= 8) & ((F.size(ws) <= 4) | (capitals / F.size(ws) >= 0.6))

    return t.rlike(upper) & ~t.rlike(r"[.,;:!?)]$") & let(F.split(t, r"\s+"), shape)


def split_sentences(c: Column) -> Column:
    """Sentences of a text: headings, blank lines and bullets part them too."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "")

    def broken(lines: Column) -> Column:
        after = lambda i: F.coalesce(F.get(lines, i + 1), F.lit(""))
        return F.array_join(F.transform(lines, lambda x, i: F.when(heading_line(x) & after(i).rlike(r"\S"), F.concat(x, F.lit("\n"))).otherwise(x)), "\n")

    text = let(F.split(plain, "\n"), broken)
    parts = F.split(text, r"""(?<=[.!?])\s+(?=[\p{Lu}\p{N}"'(])|\n{2,}|\n(?=\s*[-•*▪●]\s)""")
    return F.filter(F.transform(parts, lambda s: squash(F.regexp_replace(s, r"^\s*[-•*▪●]\s*", ""))), lambda s: F.length(s) > 1)


def normalize(c: Column) -> Column:
    """Lower case, ``&`` as and, ``unit-2``, ``u2``, ``unit II`` and ``module 2`` as ``unit 2``."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", " and ")
    t = F.regexp_replace(t, r"\b(?:unit|module|chapter|chap|ch)[\s._-]*0*(\d+)\b|\bu[\s._-]?0*(\d+)\b", "unit $1$2")
    romans = sorted(W.ROMAN.items(), key=lambda x: -len(x[0]))

    def numbered(t: Column) -> Column:
        some = t.rlike(rf"\b(?:unit|module|chapter|chap|ch)[\s._-]*(?:{'|'.join(r for r, _ in romans)})\b")  # a scan in place of one for each number
        done = t
        for roman, n in romans:
            done = F.regexp_replace(done, rf"\b(?:unit|module|chapter|chap|ch)[\s._-]*{roman}\b", f"unit {n}")
        return F.when(some, done).otherwise(t)

    return squash(F.regexp_replace(let(t, numbered), r"[^\p{L}\p{N}\s]", " "))


def search_tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda t: (F.length(t) > 0) & ~stop_word(t))


def initials(ws: Column) -> Column:
    return F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")


def tidy_title(line: Column) -> Column:
    """A line in capitals becomes a sentence; acronyms and numbers stay."""
    small = strings(W.SMALL_WORDS)

    def word(w: Column, i: Column) -> Column:
        lower = F.lower(w)
        return (
            F.when((i > 0) & F.array_contains(small, lower), lower)
            .when(w.rlike(r"\d") | ((F.length(w) <= 4) & w.rlike("^[A-Z]+$") & (i > 0)), w)
            .when(i == 0, F.concat(F.upper(F.substring(lower, 1, 1)), F.substr(lower, F.lit(2))))
            .otherwise(lower)
        )

    return F.when(line != F.upper(line), line).otherwise(F.array_join(F.transform(F.split(line, r"\s+"), word), " "))


def heading_candidates(c: Column) -> Column:
    """``array<struct<line, strong>>`` of the first 25 lines that could head a page."""

    def one(raw: Column) -> Column:
        line = strip(F.regexp_replace(F.regexp_replace(raw, r"^[\s\d.)•*#-]+", ""), r"[\s:–-]+$", ""))
        return F.struct(line.alias("line"), (raw.rlike(r":\s*$") | (line == F.upper(line))).alias("strong"))

    def good(x: Column) -> Column:
        line = x["line"]
        n = word_count(line)
        return n.between(2, 8) & (F.length(line) <= 60) & ~line.rlike("[.,;!?]$") & ~line.rlike("[()<>{}=]") & line.rlike("[A-Za-z]{3}")

    return F.filter(F.transform(F.slice(F.split(F.coalesce(c, F.lit("")), "\n"), 1, 25), one), good)


def heading_of(c: Column) -> Column:
    """The heading of a page, or an empty string."""

    def best(found: Column) -> Column:
        strong = F.filter(found, lambda x: x["strong"])
        return F.coalesce(tidy_title(F.get(strong, F.lit(0))["line"]), tidy_title(F.get(found, F.lit(0))["line"]), F.lit(""))

    return let(heading_candidates(c), best)


def detect_language(code: Column) -> Column:
    return (
        F.when(code.rlike("#include|printf|scanf|std::|cout"), F.when(code.rlike("std::|cout|cin"), "cpp").otherwise("c"))
        .when(code.rlike(r"System\.out|public (static )?(class|void)|import java\."), "java")
        .when(code.rlike(r"(?m)\bdef |\bprint\(|import \w+$|elif |self\.|:\s*$"), "python")
        .when(code.rlike(r"\b(SELECT|INSERT|UPDATE|DELETE|CREATE TABLE)\b"), "sql")
        .when(code.rlike(r"</?(div|html|body|p|span|head)[\s>]"), "html")
        .when(code.rlike(r"console\.|=>|\bconst |\blet |function\b|document\."), "javascript")
        .otherwise("")
    )


def plain_text(md: Column) -> Column:
    """Markdown without its marks."""
    t = F.coalesce(md, F.lit(""))
    for pattern, new in (
        (r"(?s)```.*?```", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^\s{0,3}(#{1,6}|[-*+]|\d+[.)])\s+", ""),
        (r"[*_`>|~]", ""),
        (r"\s+", " "),
        (r"\s+([.,;:!?])", "$1"),
    ):
        t = F.regexp_replace(t, pattern, new)
    return strip(t)


def clip_words(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space that isn't before 60 % of them."""
    cut = F.substring(text, 1, most)
    last = F.lit(most) - F.instr(F.reverse(cut), " ")  # characters before the last space
    keep = F.greatest(F.when(F.instr(cut, " ") > 0, last).otherwise(F.lit(-1)), F.lit(int(most * 0.6)))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(strip(F.substr(cut, F.lit(1), keep)), F.lit("…")))


def clip_around(text: Column, term: Column, most: int = 38) -> Column:
    """A window of ``most`` words with ``term`` at about a third of it."""
    first = F.lower(F.element_at(F.split(term, " "), 1))

    def window(ws: Column) -> Column:
        hit = F.filter(F.transform(ws, lambda w, i: F.when(F.contains(F.lower(w), first), i)), lambda i: i.isNotNull())
        at = F.coalesce(F.get(hit, F.lit(0)), F.lit(0))
        start = F.greatest(F.lit(0), F.least(F.size(ws) - most, at - most // 3))
        body = F.array_join(F.slice(ws, start + 1, F.lit(most)), " ")
        return F.when(F.size(ws) <= most, text).otherwise(
            F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + most < F.size(ws), "…").otherwise(""))
        )

    return let(F.split(text, " "), window)


def quote(term: Column) -> Column:
    """A term as a literal inside a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def word_pattern(term: Column) -> Column:
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), quote(term), F.lit(r"(?![\p{L}\p{N}])"))


def padded(text: Column) -> Column:
    """The words of a text, each between single spaces: it contains the padded form of another
    text where it has that one's words in a row."""
    return F.concat(F.lit(" "), F.array_join(tokenize(text), " "), F.lit(" "))


def mentions(text: Column, term: Column) -> Column:
    """``term`` stands in ``text`` as whole words."""
    return F.contains(F.lower(text), F.lower(term)) & F.rlike(text, word_pattern(term))


def swap_term(text: Column, term: Column, new: Column) -> Column:
    """The first mention becomes ``new``."""
    at = F.regexp_instr(text, word_pattern(term))
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(term)))).otherwise(text)


def blank_out(text: Column, term: Column) -> Column:
    """The first mention becomes a blank."""
    return swap_term(text, term, F.lit("_____"))


def list_items(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, r"[.;]\s*$", ""), r",\s*(?:and\s+|or\s+)?|\s+and\s+")
    return F.filter(F.transform(parts, strip), lambda x: F.length(x) > 1)


def keep_real_citations(text: Column, pages: Column) -> Column:
    """``[p. n]`` marks of pages that aren't among ``pages`` (counted from 1) go."""

    def part(x: Column, i: Column) -> Column:
        n = F.regexp_extract(x, r"^(\d+)\]", 1)
        known = F.array_contains(pages, n.try_cast("int"))
        return F.when(i == 0, x).when(n == "", F.concat(F.lit("[p. "), x)).when(known, F.concat(F.lit("[p. "), x)).otherwise(F.regexp_replace(x, r"^\d+\]", ""))

    kept = F.array_join(F.transform(F.split(text, r"\[p\. "), part), "")
    return strip(F.regexp_replace(F.regexp_replace(kept, r"[ \t]{2,}", " "), r"\s+([.,;:!?])", "$1"))


def clean_transcript(c: Column) -> Column:
    """Speech-to-text output without tags, stutters and loose spacing, in canonical casing."""
    t = squash(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\[[^\]]*\]|\([^)]*(music|noise|silence|inaudible|blank)[^)]*\)|\*[^*]*\*", " "))
    for n in range(6, 0, -1):
        t = F.regexp_replace(t, rf"(?i)\b((?:\S+\s+){{{n - 1}}}\S+)(?:[\s,]+\1\b)+", "$1")
    t = F.regexp_replace(t, r"(?i)\b(\S+(?:\s+\S+){0,3})\s+and\s+\1(\s+of the time)?(?=[.!?]?$)", "$1")
    for term in W.TRANSCRIPT_TERMS:
        t = F.regexp_replace(t, rf"(?i)\b\Q{term}\E\b", term)
    t = F.regexp_replace(t, r"\s+([,.!?;:])", "$1")
    t = F.regexp_replace(t, r"([,!?;:])(?=[A-Za-z])", "$1 ")
    t = F.regexp_replace(t, r"\.(?=[A-Z][a-z])", ". ")
    # sentence starts: the parts between closing marks begin in upper case
    parts = F.split(t, r"(?<=[.!?])(?=\s+[a-z])")
    t = F.array_join(F.transform(parts, lambda s: F.concat(F.regexp_extract(s, r"^\s*", 0), F.upper(F.regexp_extract(s, r"^\s*([a-z]?)", 1)), F.regexp_replace(s, r"^\s*[a-z]?", ""))), "")
    return F.when(t == "", "").when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def clean_ocr(c: Column) -> Column:
    """Hyphenated line ends joined, spaces and blank lines collapsed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(\p{L})-\n(\p{L})", "$1$2")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def is_blank_page(c: Column) -> Column:
    """Fewer than two words of three letters."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\p{L}{3,}")) < 2


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.\\/]+$", "")


def safe_file_name(name: Column) -> Column:
    return squash(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|\x00-\x1F]', " "))


def view_kind(extension: Column) -> Column:
    return (
        F.when(extension.isin("pdf"), "pdf")
        .when(extension.isin("png", "jpg", "jpeg", "gif", "webp", "bmp"), "image")
        .when(extension.isin("txt", "md", "csv"), "text")
        .when(extension.isin("doc", "docx", "ppt", "pptx"), "office")
        .otherwise("other")
    )


def html_text(html: Column) -> Column:
    """Visible text of an HTML page: active elements, comments and tags go, common entities are read."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|template|iframe|object|embed|svg)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def sanitize_html(html: Column) -> Column:
    """Active elements, event attributes and unsafe links go; the rest stays HTML."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|iframe|object|embed|form|link|meta|base)\b.*?(</\1\s*>|(?=<)|$)", "")
    t = F.regexp_replace(t, r"""(?i)\s+on\w+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    return F.regexp_replace(t, r"""(?i)\s+(href|src)\s*=\s*("(?!\s*(https?:|mailto:|#|data:image/))[^"]*"|'(?!\s*(https?:|mailto:|#|data:image/))[^']*')""", "")


def natural_key(name: Column) -> Column:
    """A sort key under which ``Unit 2`` comes before ``Unit 10``."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "00000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")


def tech_terms(c: Column) -> Column:
    """Skills in order of appearance, without repeats in any casing."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}])({W.SKILLS})(?![\p{{L}}\p{{N}}+#])"), 1)
    return let(found, lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, F.lower), F.lower(x)) == i + 1))


def band_for(score: Column) -> Column:
    return F.when(score >= 75, "blue").when(score >= 50, "yellow").otherwise("red")


def retry_after(text: Column) -> Column:
    """Seconds to wait that a reply names, between 30 and 3600; 60 where it names none."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)retry(?:ing)?\s*(?:in|after)?\D{0,12}(\d+(?:\.\d+)?)\s*s", 1).try_cast("double")
    return F.least(F.greatest(F.ceil(F.coalesce(n, F.lit(60.0))), F.lit(30)), F.lit(3600))
