from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import align, fim, packing, rules
from scriptorium.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "\n", "a", "é", "日本語 text 日本", "▁ is a lower block", "a▁b", "<s>x</s> <unk> <0x41> <|endoftext|>", "tabs\tand\n\n\nnew  lines   ", "😀 family 👨‍👩‍👧 ok", "\x00nul\x00", "ﬁne ① ǅ",
    "x" * 5000, "the " * 3000, "don't 1234567 $$$ %%% " * 5, "Ünïcödé Straße naïve", "a<P>b", "<S>", "no<M", "<<P>>", "<P", "A-Z [x] ^_` {}~ @", "mixed日x本y語z", " leading", "trailing ", "ABC" + "é" * 40 + "DEF",
]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def made_up(seed, n):
    r = random.Random(seed)
    alphabet = ["the", "of", "Über", "naïve", "<", ">", "P", "S", "M", " ", "  ", "\n", "日", "é", "😀", "42", "...", "x1", "-", "tion", "▁"]
    return ["".join(r.choice(alphabet[:-1]) + r.choice(["", " "]) for _ in range(r.choice([1, 3, 20, 200]))) for _ in range(n)]


# ---------------------------------------------------------------- alignment


def tables():
    import sentencepiece

    files = align.vocabularies()
    sp = sentencepiece.SentencePieceProcessor(model_file=files[1])
    with open(files[0][1], "rb") as f:
        a = {int(k): base64.b64decode(v) for v, k in map(bytes.split, f)}

    def piece(k):
        p = sp.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    return files, sp, a, piece


def two_pointers(texts):
    """Plain loops: groups, links and counts of whole texts."""
    files, sp, a_bytes, piece = tables()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(files[0][0])
    plain.encode_special_tokens = True
    rows = []
    for text in texts:
        groups = []
        if text:
            want = (" " + text).encode()
            a, b = plain.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            if b"".join(a_bytes[k] for k in a) == want == b"".join(piece(k) for k in b):
                i = j = x = y = 0
                own = ([], [])
                while i < len(a) or j < len(b):
                    if x <= y and i < len(a):
                        x += len(a_bytes[a[i]])
                        own[0].append(a[i])
                        i += 1
                    else:
                        y += len(piece(b[j]))
                        own[1].append(b[j])
                        j += 1
                    if x == y:
                        groups.append(own)
                        own = ([], [])
        rows.append(groups)
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in rows]
    count = Counter(p for own in links for p in set(own))
    best_a, best_b = Counter(), Counter()
    for (x, y), n in count.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    out = []
    for groups, own in zip(rows, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own), said,
            sum(count[p] == best_a[p[0]] for p in own), sum(count[p] == best_b[p[1]] for p in own), sum(count[p] for p in own),
        ))
    return out, count


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "n_best_b", "count_sum"]


@pytest.mark.parametrize("parts", [1, 7])
def test_alignment_equals_two_pointers(spark, parts):
    texts = ODD + made_up(1, 60) + ODD[:12]
    df = docs_of(spark, texts).withColumnRenamed("lang", "block").withColumnRenamed("source", "pairs").repartition(parts)
    got = align.cross_tokenizer_alignment(df)
    assert got.columns == ALIGNED and got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    want, _ = two_pointers(texts)
    assert sorted(tuple(r) for r in got.collect()) == [(i, *r) for i, r in enumerate(want)]
    assert want[texts.index("a▁b")] == (0, 0, 0, 0, "", 0, 0, 0) and want[8][0] == 0 and want[9][0] > 0


def test_counts_of_pairs_and_maxima(spark):
    texts = ["the cat", "the cat", "The cattle of the cat", "tion naïve", None]
    counts = align.link_counts(align.block_pairs(align.align(docs_of(spark, texts).repartition(3)))).collect()
    _, want = two_pointers(texts)
    assert {(r["a"], r["b"]): r["count"] for r in counts} == dict(want)
    assert all(r["best_a"] == max(n for (x, _), n in want.items() if x == r["a"]) for r in counts)
    assert all(r["best_b"] == max(n for (_, y), n in want.items() if y == r["b"]) for r in counts)


def test_alignment_query_and_edges(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op11_cross_tokenizer_alignment"](spark, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = two_pointers([t for _, t in rows])
    assert len(got) == len(rows)
    for (i, _), (n_a, n_b, groups, links, said, best, best_b, total) in zip(rows, want, strict=True):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["n_best_b"], r["count_sum"]) == (n_a, n_b, groups, links, best, best_b, total)
        assert r["groups_sha256"] == (hashlib.sha256(said.encode()).hexdigest() if said else "")
    none = spark.createDataFrame([], DOCS)
    assert align.cross_tokenizer_alignment(none).count() == 0
    odd = spark.createDataFrame([(None, "two words"), (None, None), (2**60 + 1, "two words"), (2**60 + 1, "two words")], "doc_id long, text string")
    found = align.cross_tokenizer_alignment(odd, digest=True).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(["None", "None", str(2**60 + 1), str(2**60 + 1)])
    assert {r["count_sum"] // r["n_links"] for r in found if r["n_links"]} == {3} and {r["groups_sha256"] for r in found if not r["n_links"]} == {""}


# ---------------------------------------------------------------- fill in the middle


def by_regex(doc_id, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(u), "plain", None, None, text
    p, q = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = "".join(u[:p]), "".join(u[p:q]), "".join(u[q:])
    if h4 % 100 < 20:
        return doc_id, len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_cuts_equal_a_regular_expression(spark):
    texts = ODD + made_up(2, 300) + ["almost <P", "S> and <M", "<", ">" * 9, "P>x<S" * 20]
    df = docs_of(spark, texts).withColumnRenamed("lang", "h1").withColumnRenamed("source", "output").repartition(3)
    got = fim.fill_in_middle(df)
    rows = sorted(got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect())
    assert [tuple(r)[:-1] for r in rows] == [by_regex(i, t) for i, t in enumerate(texts)]
    assert [r["back"] for r in rows] == [t or "" for t in texts]
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_units_of_any_text():
    for text in [t for t in ODD if t is not None] + made_up(3, 200):
        u, want = fim.Units(text), re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert u.n == len(want) and u.marked == any(s in text for s in ("<P>", "<S>", "<M>"))
        assert [u.place(k) for k in range(u.n + 1)] == [len("".join(want[:k])) for k in range(u.n + 1)]


def test_long_runs_make_no_events():
    assert len(fim.Units("日" * 100_000 + "x" * 100_000).ends) == 3


def test_fim_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op12_fill_in_middle"](spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.sql(ORACLES["op12_fill_in_middle"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_fim_edges(spark):
    rows = [(None, "some words"), (None, "some words"), (7, None), (7, ""), (7, "one")]
    got = fim.digests(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = [by_regex(*r) for r in rows]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [tuple(r) for r in got] == [(*w[:5], digest(w[5]), digest(t or "")) for w, (_, t) in zip(want, rows, strict=True)]
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- quality rules


def counted(text):
    """Plain loops over one text."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def lines_and_loops(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        stock = [" ".join(r.choice(["a", "B", "é", "#", "|", "x<y", "日本"]) for _ in range(r.randint(0, 5))) for _ in range(3)]
        out.append("\n".join(r.choice(stock) + r.choice(["", "", " ", "\r"]) for _ in range(r.randint(1, 40))))
    return out


def test_counts_equal_plain_loops(spark):
    texts = ODD + lines_and_loops(4, 120) + ["word " * 60, " ".join(map(str, range(60))), " ".join(map(str, range(49))), "a b c " * 1 + "a b c " * 20 + " ".join(map(str, range(70)))]
    df = docs_of(spark, texts).withColumnRenamed("lang", "score").withColumnRenamed("source", "symbols")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted(rules.quality_rules(df, none).collect())
    for i, r in enumerate(got):
        want = counted(texts[i])
        assert tuple(r)[:6] == (i, *want)
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"]) and r["score"] == 0.5


def sample(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = (x[:, 0] - x[:, 1] + np.sin(3 * x[:, 2]) + rng.normal(size=n) > 0).astype(float)
    return x, y


def test_trees_learn_and_keep_their_directions():
    x, y = sample()
    toward = (1, -1, 0, -1)
    model = rules.boost(x, y, toward)
    fresh, truth = sample(1)
    assert ((model.logits(fresh) > 0) == truth).mean() > 0.78
    for column, way in enumerate(toward):
        if way:
            steps = []
            for v in np.linspace(-4, 4, 60):
                moved = fresh.copy()
                moved[:, column] = v
                steps.append(model.logits(moved))
            assert (way * np.diff(np.array(steps), axis=0) >= -1e-9).all()
    free = rules.boost(x, y, (0, 0, 0, 0))
    assert np.ptp(free.logits(x)) > 1


def test_flattened_trees_equal_a_walk():
    x, y = sample(2, 800)
    model = rules.boost(x, y, (0, 0, 0, 0), trees=7, depth=3)

    def walk(row):
        total = model.base
        for t in range(7):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            total += model.value[t, node - 7]
        return total

    assert np.allclose(model.logits(x[:50]), [walk(r) for r in x[:50]])


def test_first_split_equals_trying_all():
    x, y = sample(3, 400)
    model = rules.boost(x, y, (0, 0, 0, 0), trees=1, depth=1, bins=1000)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f, cut):
        left = x[:, f] <= cut
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left) if s.any())

    best = max(gain(f, cut) for f in range(4) for cut in x[:, f])
    assert gain(model.feature[0, 0], model.threshold[0, 0]) == pytest.approx(best)


def test_one_class_or_nothing_to_learn_from():
    x, _ = sample(4, 50)
    assert (rules.boost(x, np.ones(50), (0,) * 4).logits(x) > 0).all()
    assert (rules.boost(x[:0], np.zeros(0), (0,) * 4).logits(x) == 0).all()


def test_rules_held_out_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op13_quality_rules"](spark, sf)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(rows) == 1000
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in rows.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(texts[r.doc_id])
    held = rows[rows.held_out & rows.quality.notna() & ~rows.base_failed]
    assert len(held) > 30 and (held.kept == (held.quality == 1)).mean() >= 0.95
    assert (held[held.quality == 1].kept).mean() >= 0.97


def test_shares_that_may_only_lower(spark):
    """More symbols in a document, all else equal, never raise its score."""
    sf = "/root/testdata/sf0.01"
    model = rules.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    texts = pa.array([r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(200).collect()])
    shares = np.concatenate([s for _, s in rules.statistics(texts)])
    for k, (_, way) in enumerate(rules.SHARES.items()):
        if way:
            steps = []
            for v in np.linspace(0, shares[:, k].max() * 1.2 + 0.01, 40):
                moved = shares.copy()
                moved[:, k] = v
                steps.append(model.logits(moved))
            assert (way * np.diff(np.array(steps), axis=0) >= -1e-9).all()


def test_rules_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "word " * 80), (3, " ".join(map(str, range(200)))), (3, " ".join(map(str, range(200))))], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (1, 0), (None, 0), (3, None), (99, 1)], "doc_id long, quality int")
    got = rules.quality_rules(docs, labels).collect()
    assert len(got) == 4 and [r["kept"] for r in got if r["doc_id"] == 3] == [True, True]
    assert {r["base_failed"] for r in got if r["doc_id"] != 3} == {True}
    assert rules.quality_rules(docs.where("false"), labels).count() == 0


def whole_ids(enc, text):
    a, b = enc.ids(align.units_of(text))
    return [k for ids in a for k in ids], [k for ids in b for k in ids]


def test_special_strings_are_text():
    a, b = whole_ids(align.encoders(align.vocabularies()), "<|endoftext|>")
    assert a == packing.token_ids(" <|endoftext|>", packing.vocabulary()) and 50256 not in a and b


def test_units_encode_as_whole_texts_do():
    """Ids unit by unit are those of the whole text, whatever the white space."""
    import sentencepiece

    files = align.vocabularies()
    enc, sp = align.Encoders(files), sentencepiece.SentencePieceProcessor(model_file=files[1])
    r = random.Random(9)
    spaces = [" ", "  ", "   ", "\n", "\n ", " \n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "\u2003 ", "\r\n", ""]
    for _ in range(3000):
        text = "".join(r.choice(["the", "Of", "naïve", "x1", "...", "it's", "日本", "😀", "tion", "12", "_", "\x00"]) + r.choice(spaces) for _ in range(r.randint(1, 12)))
        assert "".join(align.units_of(text)) == " " + text
        a, b = whole_ids(enc, text)
        assert a == packing.token_ids(" " + text, files[0]) and b == sp.encode(text)
