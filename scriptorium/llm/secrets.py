"""Secret scans: three base patterns, and a battery of randomness tests for the rest.

All of it is column expressions. A pattern's matches are bracketed in the text by two
private characters (which, where a text has them itself, first become ``?``, so that
places keep), the text is split at them, and sums of the pieces' lengths give places in code
points.

The battery reads every run of 16 or more letters, digits, ``+ / _ -`` (and closing ``=``).
Its encoding (hex, base32 or base64) is inferred from its characters; uniformity over the
encoding's alphabet (chi-squared), runs about the alphabet's middle and serial correlation
each give a normal score under randomness, and their squares are summed. A run is taken
for a secret if the sum is below the 0.1 % point of chi-squared with three degrees, and if
false discovery is controlled for its encoding and length band: runs that are plainly
words or plain numbers (letters of one case, or digits only) are decoys, counted over the
whole table in bins of the sum, and the bar of a band is the widest at which
``(1 + decoys) / others <= fdr``; so shorter bands, where words look random more often,
get a stricter bar.

Nulls and ties: a null text is empty and has no spans; a null doc_id is kept; repeated
rows come back as often as given; spans that start together are ordered assign, access,
hex, random. Further columns are kept by ``scan`` and ``redact``, whatever their names;
``secret_scan`` reads doc_id and text alone. An empty table gives no rows; very long texts
are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

# The base patterns, their least lengths and their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 or more characters in all
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
BANDS = (20, 24, 32, 40, 64)
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
FDR = 0.05
LIMIT = 16.27  # the 0.1 % point of chi-squared with three degrees of freedom
STEP = 0.5
OPEN, CLOSE = "", ""
#: Pieces whose lengths are summed one by one; between such blocks running sums are kept, so that many matches in one text stay cheap.
BLOCK = 64


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def places(text: str, pattern: str) -> Column:
    """``array<struct<s, m>>``: start and text of each leftmost match of ``pattern`` in column ``text``."""
    # where a piece begins: running sums of whole blocks of pieces, and a sum within one block
    total = "aggregate(slice({0}), 0, (a, x) -> a + x)".format
    starts = f"""
    aggregate(
      transform(sequence(0, (size(__n) - 1) div {BLOCK}), b -> {total(f"__n, b * {BLOCK} + 1, {BLOCK}")}),
      named_struct('at', 0, 'out', cast(array() as array<int>)),
      (a, x) -> named_struct('at', a.at + x, 'out', array_append(a.out, a.at)), a -> a.out)"""
    found = f"""
    transform(sequence(1, size(__p) - 1), i -> named_struct(
      's', __b[i div {BLOCK}] + {total(f"__n, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}")},
      'm', substring_index(__p[i], '{CLOSE}', 1)))"""
    lengths = "transform(__p, (x, i) -> length(x) - if(i = 0, 0, 1))"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    marked = f"split(regexp_replace({text}, {_quoted(pattern)}, '{OPEN}$0{CLOSE}'), '{OPEN}')"
    one = let("__p", marked, let("__n", lengths, let("__b", starts, found)))
    return F.expr(f"CASE WHEN {text} RLIKE {_quoted(pattern)} THEN {one} ELSE cast(array() as array<struct<s:int,m:string>>) END")


def _spans(found: str, kind: int) -> Column:
    return F.transform(F.col(found), lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), (x["s"] + F.length(x["m"])).alias("e")))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once, whatever loops stand in ``body``."""
    return F.transform(F.array(value), body)[0]


def _tests(run: Column) -> Column:
    """``struct<s, e, band, decoy, bin>`` of one candidate run."""

    def of_bare(bare: Column) -> Column:
        kind = F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
        return _let(kind, lambda k: of_kind(bare, k))

    def of_kind(bare: Column, kind: Column) -> Column:
        size = F.when(kind == "hex", 16.0).when(kind == "base32", 32.0).otherwise(64.0)
        alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        plain = F.split(F.translate(F.when(kind == "hex", F.lower(bare)).otherwise(bare), "-_", "+/"), "")
        values = _let(alphabet, lambda a: F.transform(plain, lambda c: F.instr(a, c).cast("double") - 1))
        return _let(F.struct(values.alias("v"), size.alias("a")), lambda x: _score(x["v"], x["a"], run["m"], run["s"], kind))

    return _let(F.regexp_replace(run["m"], "=+$", ""), of_bare)


def _score(v: Column, a: Column, text: Column, start: Column, kind: Column) -> Column:
    n = F.size(v).cast("double")
    squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda t, s: t + F.pow(F.size(F.filter(v, lambda x: x == s)).cast("double"), F.lit(2)))
    chi = (a / n * squares - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    changes = F.size(F.filter(pairs, lambda p: (p["x"] >= a / 2) != (p["y"] >= a / 2))).cast("double")
    runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    middle, spread = (a - 1) / 2, (a * a - 1) / 12  # of a uniform symbol
    serial = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + (p["x"] - middle) * (p["y"] - middle)) / (spread * F.sqrt(n - 1))
    total = F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2)) + runs * runs + serial * serial
    length, band = F.length(text), F.lit(0)
    for b in BANDS:
        band = band + (F.length(text) >= b).cast("int")
    return F.struct(
        start.alias("s"), (start + length).alias("e"),
        F.concat_ws(":", kind, band.cast("string")).alias("band"),
        text.rlike("^([A-Z]?[a-z_/+-]+|[A-Z_/+-]+|[0-9_/+-]+)=*$").alias("decoy"),
        F.floor(F.least(total, F.lit(1000.0)) / STEP).cast("int").alias("bin"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its columns in ``row``, its ``text``, the base spans in ``base`` and the
    tested runs in ``runs``."""
    whole = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    clean = docs.select(whole.alias("row"), "text").withColumn("t", F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, "??"))
    found = clean.withColumns({"a": places("t", ASSIGN), "k": places("t", ACCESS), "h": places("t", HEX), "r": places("t", RUN)})
    long_enough = F.filter("a", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12)
    base = found.withColumn("a", long_enough).withColumn("base", F.array_sort(F.concat(_spans("a", 0), _spans("k", 1), _spans("h", 2))))
    return base.select("row", "text", "base", F.transform("r", _tests).alias("runs"))


def bars(tested: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """The highest bin that is still taken, by encoding and length band: at most 18 of them
    reach the driver, from counts in at most 18 times 2001 bins."""
    counts = (
        tested.select(F.explode("runs").alias("r")).groupBy(F.col("r.band").alias("band"), F.least(F.col("r.bin"), F.lit(int(LIMIT / STEP))).alias("bin"))
        .agg(F.count_if(F.col("r.decoy")).alias("decoys"), F.count_if(~F.col("r.decoy")).alias("others"))
    )
    upto = "OVER (PARTITION BY band ORDER BY bin)"
    run = counts.selectExpr("band", "bin", f"sum(decoys) {upto} AS decoys", f"sum(others) {upto} AS others")
    good = run.where((F.col("bin") < int(LIMIT / STEP)) & (F.col("others") > 0) & (1 + F.col("decoys") <= fdr * F.col("others")))
    return {r["band"]: r["bin"] for r in good.groupBy("band").agg(F.max("bin").alias("bin")).collect()}


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per row of ``docs`` its columns in ``row``, its ``text``, and ``base`` and ``spans``: sorted
    arrays of ``struct<s, k, e>``, k a number in KINDS."""
    tested = settle(candidates(docs), "secrets")
    bar = bars(tested, fdr)
    most = F.lit(-1)
    pick = F.filter("runs", lambda r: ~r["decoy"] & (r["bin"] <= _of(bar, r["band"], most)))
    more = F.transform(pick, lambda r: F.struct(r["s"].alias("s"), F.lit(3).alias("k"), r["e"].alias("e")))
    return tested.select("row", "text", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _of(bar: dict[str, int], band: Column, other: Column) -> Column:
    out = other
    for k, v in sorted(bar.items()):
        out = F.when(band == k, v).otherwise(out)
    return out


def written(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"), fdr)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"),
    )


def redact(docs: DataFrame, fdr: float = FDR, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span's text replaced by ``mark`` (overlapping spans by one) and
    ``n_chars``, where there is such a column, made anew; columns and rows stay."""
    found = scan(docs, fdr)
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"]), F.lit(mark)).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    found = found.withColumn("text", F.when(F.size("spans") > 0, step).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    opening, closing = f"chr({ord(OPEN)})", f"chr({ord(CLOSE)})"
    patterns = ((0, ASSIGN), (1, ACCESS), (2, HEX), (3, RUN))
    marked = " UNION ALL ".join(rf"SELECT doc_id, {k} AS k, string_split(regexp_replace(t, {q(p)}, {opening} || '\0' || {closing}, 'g'), {opening}) AS p FROM t" for k, p in patterns)
    length = "length(m) >= 20"
    band = " + ".join(f"CAST({length.replace('20', str(b))} AS INTEGER)" for b in BANDS)
    alphabet = " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in ALPHABETS.items())
    top = int(LIMIT / STEP)
    return rf"""
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {opening} || {closing}, '??') AS t FROM documents),
    p AS ({marked}),
    m AS (SELECT doc_id, k, unnest(list_transform(range(2, len(p) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS BIGINT) - (i - 2), 'm': split_part(p[i], {closing}, 1)}})) AS x FROM p),
    f AS (SELECT doc_id, k, x.s AS s, x.s + length(x.m) AS e, x.m AS m FROM m),
    base AS (SELECT doc_id, s, k, e FROM f WHERE k IN (1, 2) OR (k = 0 AND length(regexp_extract(m, {q(ASSIGN)}, 2)) >= 12)),
    b AS (SELECT doc_id, s, e, m, regexp_replace(m, '=+$', '') AS bare FROM f WHERE k = 3),
    c AS (SELECT *, CASE WHEN regexp_matches(bare, '^([0-9a-f]+|[0-9A-F]+)$') THEN 'hex' WHEN regexp_matches(bare, '^[A-Z2-7]+$') THEN 'base32' ELSE 'base64' END AS kind FROM b),
    d AS (SELECT *, translate(CASE WHEN kind = 'hex' THEN lower(bare) ELSE bare END, '-_', '+/') AS pl, CASE kind WHEN 'hex' THEN 16.0::DOUBLE WHEN 'base32' THEN 32.0::DOUBLE ELSE 64.0::DOUBLE END AS a, CASE kind {alphabet} END AS al FROM c),
    v AS (SELECT *, list_transform(range(1, length(pl) + 1), lambda i: CAST(instr(al, substr(pl, i, 1)) AS DOUBLE) - 1) AS v, CAST(length(pl) AS DOUBLE) AS n FROM d),
    w AS (SELECT *, list_sum(list_transform(list_distinct(v), lambda y: pow(CAST(len(list_filter(v, lambda x: x = y)) AS DOUBLE), 2))) AS sq,
                 CAST(len(list_filter(range(1, len(v)), lambda i: (v[i] >= a / 2) <> (v[i + 1] >= a / 2))) AS DOUBLE) AS ch,
                 list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - (a - 1) / 2) * (v[i + 1] - (a - 1) / 2))) AS se FROM v),
    z AS (SELECT *, pow(greatest((a / n * sq - n - (a - 1)) / sqrt(2 * (a - 1) * (n - 1) / n), 0), 2) + pow((ch - (n - 1) / 2) / sqrt((n - 1) / 4), 2) + pow(se / ((a * a - 1) / 12 * sqrt(n - 1)), 2) AS total FROM w),
    r AS (SELECT doc_id, s, e, kind || ':' || ({band}) AS band, regexp_matches(m, '^([A-Z]?[a-z_/+-]+|[A-Z_/+-]+|[0-9_/+-]+)=*$') AS decoy, CAST(floor(least(total, 1000.0::DOUBLE) / {STEP}::DOUBLE) AS INTEGER) AS bin FROM z),
    g AS (SELECT band, least(bin, {top}) AS bin, count(*) FILTER (decoy) AS decoys, count(*) FILTER (NOT decoy) AS others FROM r GROUP BY ALL),
    u AS (SELECT band, bin, sum(decoys) OVER x AS decoys, sum(others) OVER x AS others FROM g WINDOW x AS (PARTITION BY band ORDER BY bin)),
    bar AS (SELECT band, max(bin) AS bar FROM u WHERE bin < {top} AND others > 0 AND 1 + decoys <= {FDR}::DOUBLE * others GROUP BY band),
    spans AS (SELECT doc_id, s, k, e FROM base UNION ALL SELECT doc_id, s, 3, e FROM r JOIN bar USING (band) WHERE NOT decoy AND bin <= bar),
    said AS (SELECT *, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e AS x FROM spans),
    per AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                   string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM said GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN per USING (doc_id)
    """


ORACLE = _oracle()
