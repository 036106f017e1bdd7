"""Fragments of the check queries, which run on another engine over the same files."""

from __future__ import annotations

from ..functions import words as W


def texts(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


STOP = texts(W.STOP_WORDS)


def tokens(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"


def content(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def word_count(c: str) -> str:
    return rf"CAST(len(regexp_extract_all({c}, '\S+')) AS BIGINT)"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def heading(line: str) -> str:
    t = strip(line)
    ws = rf"regexp_split_to_array({t}, '\s+')"
    return (
        rf"(regexp_matches({t}, '^[\p{{Lu}}\d]') AND NOT regexp_matches({t}, '[.,;:!?)]$') AND len({ws}) <= 8 AND "
        rf"(len({ws}) <= 4 OR len(list_filter({ws}, lambda w: regexp_matches(w, '^[\p{{Lu}}\d]'))) / len({ws}) >= 0.6))"
    )


def sentences(c: str) -> str:
    """A list of sentences; chr(1) marks where they part."""
    lines = f"string_split(replace(coalesce({c}, ''), chr(13), ''), chr(10))"
    broken = (
        f"array_to_string(list_transform({lines}, lambda x, i: CASE WHEN {heading('x')} AND "
        rf"regexp_matches(coalesce({lines}[i + 1], ''), '\S') THEN x || chr(10) ELSE x END), chr(10))"
    )
    marked = rf"""regexp_replace({broken}, '([.!?])\s+([\p{{Lu}}\p{{N}}"''(])', '\1' || chr(1) || '\2', 'g')"""
    marked = rf"regexp_replace({marked}, '\n{{2,}}', chr(1), 'g')"
    marked = rf"regexp_replace({marked}, '\n(\s*[-•*▪●]\s)', chr(1) || '\1', 'g')"
    one = rf"trim(regexp_replace(regexp_replace(s, '^\s*[-•*▪●]\s*', ''), '\s+', ' ', 'g'))"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {one}), lambda s: length(s) > 1)"


def stem_search(c: str) -> str:
    arms = " ".join(f"WHEN ends_with({c}, '{s}') AND length({c}) >= {len(s) + 3} THEN left({c}, length({c}) - {len(s)})" + (" || 'y'" if s == "ies" else "") for s in W.SEARCH_SUFFIXES)
    return rf"CASE WHEN length({c}) <= 3 OR regexp_matches({c}, '^\d+$') THEN {c} {arms} ELSE {c} END"


def word_match(q: str, w: str) -> str:
    """How well one query word matches one word of a name."""
    sq, sw, digits = f"({stem_search(q)})", f"({stem_search(w)})", lambda c: rf"regexp_matches({c}, '^\d+$')"
    slips = f"(CASE WHEN length({q}) >= 8 THEN 2 WHEN length({q}) >= 4 THEN 1 ELSE 0 END)"
    return f"""CASE WHEN {q} = {w} THEN 1.0 WHEN {digits(q)} OR {digits(w)} THEN 0.0 WHEN {sq} = {sw} THEN 0.92 WHEN length({q}) >= 3 AND starts_with({w}, {q}) THEN 0.8
      WHEN length({sq}) >= 4 AND starts_with({sw}, {sq}) THEN 0.75 WHEN {slips} > 0 AND damerau_levenshtein({q}, {w}) <= {slips} THEN 0.68
      WHEN {slips} > 0 AND length({sq}) >= 4 AND damerau_levenshtein({sq}, {sw}) <= {slips} THEN 0.62 ELSE 0.0 END"""


SENTENCES = f"""
s AS (SELECT doc_id, unnest(x) AS text, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS sent_idx FROM (SELECT doc_id, {sentences("text")} AS x FROM documents))"""

BM25 = f"""
d AS (SELECT doc_id, {content("text")} AS terms FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest({content("text")}) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM d),
tf AS (SELECT doc_id, length, term, count(*) AS f FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.4 / (f + 1.4 * (0.25 + 0.75 * length / avg_len))), 9) AS full_score
       FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(full_score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY full_score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE full_score > 0)"""
