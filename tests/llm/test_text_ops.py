from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, decontaminate, licenses, ngram_join, packing, secrets
from scriptorium.llm import textkit as K

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(r, n, vocabulary=2000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# ---------------------------------------------------------------- n-gram join


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def joined(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def near_copies(seed=1):
    r = random.Random(seed)
    texts = []
    for _ in range(40):
        base = words(r, r.choice([3, 4, 5, 9, 20, 40, 80, 200, 600]))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            other = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                other[r.randrange(len(other))] = f"x{r.randrange(99)}"
            texts.append(" ".join(other))
    # a chain whose ends don't link, and many copies
    chain = words(r, 300)
    for k in range(8):
        chain = list(chain)
        chain[5 + 30 * k] = f"c{k}"
        texts.append(" ".join(chain))
    texts += [texts[0]] * 5 + ["", None, "  \t", "One", "one", "Two words", "ÀB cd ef gh", "àb cd ef gh"]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    texts = near_copies(seed)
    df = docs_of(spark, texts).withColumnRenamed("lang", "node").repartition(5)
    got = sorted(tuple(r) for r in ngram_join.ngram_jaccard_join(df).collect())
    assert got == joined(list(enumerate(texts)))


def test_keep_one_of_each_component(spark):
    texts = near_copies()
    df = docs_of(spark, texts)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    want = [i for i, n, c in joined(list(enumerate(texts))) if i == c]
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    twice = df.unionByName(df.where("doc_id < 30"))
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(twice).where(F.col("text").rlike(r"\S")).collect()) == [i for i in want if (texts[i] or "").strip()]
    unknown = spark.createDataFrame([(None, "a b c d e", None, None, None), (None, "a b c d e", None, None, None), (7, "a b c d e", None, None, None), (None, None, None, None, None)], DOCS)
    assert sorted(str(r["doc_id"]) for r in ngram_join.keep_one(unknown).collect()) == ["7", "None"]
    assert ngram_join.keep_one(df.where("false")).count() == 0


def one_cluster(seed):
    """Copies of one text with few to many edits out of a small stock, documents that share a
    passage, and copies with the same long footer: links lie near the bound all over."""
    r = random.Random(seed)
    base, stock, texts = words(r, 260), {}, []
    for k in range(70):
        other = list(base)
        for _ in range(r.randint(0, 14)):
            at = r.randrange(52) * 5
            other[at] = stock.setdefault((at, r.randrange(2)), f"e{len(stock)}")
        texts.append(" ".join(other + (words(r, 1) * 45 if k % 7 == 0 else [])))
    footer = words(r, 50)
    for k in range(12):
        other = list(base)
        other[100 + 3 * k] = "changed"
        texts.append(" ".join(other + footer))
    passage = words(r, 60)
    return texts + [" ".join(words(r, r.choice([5, 30, 90])) + passage + words(r, 8)) for _ in range(25)]


@pytest.mark.parametrize(("seed", "share", "dealt"), [(3, 16, 256), (4, 2, 4), (5, 1, 1)])
def test_links_within_large_groups_equal_brute_force(spark, monkeypatch, seed, share, dealt):
    monkeypatch.setattr(ngram_join, "SHARE", share)
    monkeypatch.setattr(ngram_join, "DEALT", dealt)
    texts = one_cluster(seed)
    want = joined(list(enumerate(texts)))
    assert 10 < len({c for _, _, c in want}) < 95
    assert sorted(tuple(r) for r in ngram_join.ngram_jaccard_join(docs_of(spark, texts).repartition(3)).collect()) == want


def test_ngram_join_on_odd_tables(spark):
    r = random.Random(2)
    long = words(r, 30_000, 10_000)
    rows = [(None, "x y z"), (4, "x y z"), (4, "x y z"), (None, None), (None, None), (5, " ".join(long)), (6, " ".join([*long[:29_000], "end"])), (7, "")]
    clash = ["row", "ROW_", "__row", "node", "size", "sig"]
    df = spark.createDataFrame([(*x, *[str(k)] * 6, {"k": k}) for k, x in enumerate(rows)], f"doc_id long, text string, {', '.join(f'{c} string' for c in clash)}, m map<string,int>")
    got = sorted(((x["doc_id"], x["component_id"]) for x in ngram_join.ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None), (None, None), (5, 5), (6, 5), (7, 7)], key=str)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(x["doc_id"]), x["row"] == x["__row"]) for x in kept.collect()) == [("4", True), ("5", True), ("7", True), ("None", True), ("None", True)]
    assert ngram_join.ngram_jaccard_join(df.where("false")).count() == 0


def test_signatures_never_lose_a_link():
    r = np.random.default_rng(4)
    bands = ngram_join.Bands()
    for n in [1, 2, 5, 6, 7, 12, 13, 30, 77, 300, 2000]:
        for _ in range(30):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            most = int(0.15 * n)
            drop = int(r.integers(0, most + 1))
            add = int(r.integers(0, most - drop + 1)) if most > drop else 0
            b = np.unique(np.append(a[: len(a) - drop], r.integers(0, 1 << 63, add).astype(np.uint64)))
            if len(b) and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) and len(a) + len(b) > 2 * len(np.intersect1d(a, b)):
                assert len(np.intersect1d(ngram_join.signatures(a, bands), ngram_join.signatures(b, bands))), (n, drop, add)


# ---------------------------------------------------------------- packing


def test_packing_round_trip(spark):
    import tokenizers

    r = random.Random(2)
    texts = [" ".join(words(r, r.choice([0, 1, 5, 60, 300, 3000]))) for _ in range(60)] + [None, "", "<|endoftext|> as text", "naïve – “quoted” 日本語 😀 ١٢٣", "a\r\n\tb  c   d e f", "x" * 5000, "Straße’s l'été"]
    df = docs_of(spark, texts).withColumnRenamed("lang", "piece").unionByName(docs_of(spark, ["twice"], 900).withColumnRenamed("lang", "piece"))
    rows = packing.best_fit_packing(df).collect()
    t = tokenizers.Tokenizer.from_file(packing.vocabulary()[0])
    t.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x["doc_id"]].append(x)
        by_seq[x["sequence_id"]].append(x)
    for i, text in [*enumerate(texts), (900, "twice")]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda x: x["piece"])
        assert [x["piece"] for x in own] == list(range(len(own)))
        at = 0
        for k, x in enumerate(own):
            assert x["start"] == at and x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            assert x["length"] == 1024 or k == 0 or len(own) == 1
            at += x["length"]
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for x in sorted(own, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 1024
    total = sum(x["length"] for x in rows)
    assert len(by_seq) <= -(-total // 1024) * 1.03 + 1
    assert packing.best_fit_packing(df.where("false")).count() == 0


def test_special_strings_as_an_untouched_tokenizer_has_them(spark):
    import tokenizers

    texts = ["<|endoftext|> as text", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "日本 <|endoftext|>", "<|endoftext |>", "plain", "", None]
    t = tokenizers.Tokenizer.from_file(packing.vocabulary()[0])
    want = {i: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in enumerate(texts)}
    got = packing.best_fit_packing(docs_of(spark, texts), special_ids=True).collect()
    assert {x["doc_id"]: x["ids_crc32"] for x in got} == want
    assert packing.token_ids("a <|endoftext|> b", packing.vocabulary()) != packing.token_ids("a <|endoftext|> b", packing.vocabulary(), True)


def test_sum_of_squares_against_plain_version():
    r = np.random.default_rng(3)
    for _ in range(20):
        lengths = r.integers(1, 33, 80)
        where, offset = packing.sum_of_squares(lengths, 32)
        gaps: dict[int, list[int]] = {}
        opened, want = 0, {}
        for k in np.argsort(-lengths, kind="stable"):
            s = int(lengths[k])
            best = None
            for g in sorted(g for g, v in gaps.items() if v and g >= s and g < 32):
                change = {q: len(v) for q, v in gaps.items()}
                before = sum(n * n for n in change.values())
                change[g] -= 1
                if g > s:
                    change[g - s] = change.get(g - s, 0) + 1
                delta = sum(n * n for n in change.values()) - before
                if best is None or delta < best[0]:
                    best = (delta, g)
            if best:
                seq, at = gaps[best[1]].pop(), 32 - best[1]
                left = best[1] - s
            else:
                seq, at, left = opened, 0, 32 - s
                opened += 1
            want[k] = (seq, at)
            if left:
                gaps.setdefault(left, []).append(seq)
        assert [(int(a), int(b)) for a, b in zip(where, offset)] == [want[k] for k in range(80)]


# ---------------------------------------------------------------- decontamination


def brute_leaks(texts, items, similarity=0.8):
    """Every window of every document against every item."""
    cut = lambda t: re.findall(r"[a-z0-9\x80-￿]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda w: [tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))] if w else []
    its = [cut(t) for t in items]
    had = defaultdict(int)
    for w in its:
        for x in set(runs(w)):
            had[x] += 1
    weight = lambda x: np.log1p(len(items) / had.get(x, 1))
    out = set()
    for d, t in enumerate(texts):
        w = cut(t)
        for i, item in enumerate(its):
            if not item or not w:
                continue
            n = min(len(item), len(w))
            for p in range(len(w) - n + 1):
                a, b = runs(w[p : p + n]), runs(item)
                ca, cb = {x: a.count(x) for x in a}, {x: b.count(x) for x in b}
                if not ca.keys() & cb.keys():
                    continue
                lo = sum(min(ca.get(x, 0), cb.get(x, 0)) * weight(x) for x in ca.keys() | cb.keys())
                hi = sum(max(ca.get(x, 0), cb.get(x, 0)) * weight(x) for x in ca.keys() | cb.keys())
                if lo / hi >= similarity:
                    out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    items = [" ".join(words(r, n, 300)) for n in [2, 5, 7, 20, 45, 60]] + ["", None]
    texts = []
    for k in range(40):
        body = words(r, r.choice([0, 3, 50, 200]), 300)
        item = (items[k % 6] or "").split()
        if k % 3 and len(item) > 20:
            for _ in range(k % 2):
                item[r.randrange(len(item))] = "changed"
        place = r.randrange(len(body) + 1)
        texts.append(" ".join(body[:place] + (item if k % 4 else []) + body[place:]))
    texts += [None, "", items[1].upper(), items[3].replace(" ", ", ")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    df = docs_of(spark, texts)
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(df, bench).collect()}
    assert got == brute_leaks(texts, items)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.leaks(df.where("false"), bench).count() == 0 and decontaminate.clean(df, bench.where("false")).count() == len(texts)


def test_leaks_do_not_depend_on_the_benchmarks_blocks(spark, monkeypatch):
    r = random.Random(12)
    common = words(r, 40)  # what most items have weighs little
    items = [" ".join(common + words(r, 12)) for _ in range(12)] + [" ".join(words(r, 40) + common[:12]) for _ in range(4)] + ["", None]
    texts = []
    for item in items[:16]:
        own = item.split()
        changed = list(own)
        changed[45 if len(own) == 52 and own[:5] == common[:5] else 20] = "changed"
        far = list(own)
        far[:7] = common[-7:]  # runs of other items only
        cut = own[:44] + common[:8]
        texts += [" ".join(["before", *own, "after"]), " ".join(changed), " ".join(far), " ".join(cut), " ".join(own[:-2] + ["x", "y"])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs_of(spark, texts).repartition(3)
    rows = lambda: sorted(tuple(x) for x in decontaminate.leaks(df, bench, radius=64).collect())
    one = rows()
    assert {x[:2] for x in one} == brute_leaks(texts, items) and len({x[0] for x in one}) < len(texts)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    assert len(list(decontaminate.blocks(bench))) > 3
    assert rows() == one
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 5)
    assert rows() == one
    assert {x["doc_id"] for x in decontaminate.clean(df, bench, radius=64).collect()} == set(range(len(texts))) - {x[0] for x in one}


def test_hamming_index_finds_all_within_radius():
    r = np.random.default_rng(7)
    prints = r.integers(0, 1 << 63, 200).astype(np.uint64)
    queries = prints[:50].copy()
    for k in range(50):
        for bit in r.choice(64, int(r.integers(0, 28)), replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(bit)
    q, i = decontaminate.HammingIndex(prints, 20).find(queries)
    want = np.argwhere(np.bitwise_count(queries[:, None] ^ prints[None]) <= 20)
    assert sorted(zip(q.tolist(), i.tolist())) == sorted(map(tuple, want.tolist()))


# ---------------------------------------------------------------- secrets


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def secret_texts():
    r = random.Random(8)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = []
    for k in range(120):
        parts = words(r, 30)
        parts.insert(r.randrange(30), "".join(r.choice(chars) for _ in range(40)))
        parts.insert(r.randrange(30), ["", "password: hunter2", 'API_KEY = "abcdefgh.1234"', "AKIA" + "Z9" * 8, hashlib.md5(str(k).encode()).hexdigest(), "naïve 😀 token=aaaabbbbcccc", "odd"][k % 7])
        texts.append(" ".join(parts))
    texts += ["antidisestablishmentarianism " * 3, "", None, "token: token=abcdefghijklmnop", "0123456789abcdef0123456789abcdef", "a" * 40]
    return texts


def test_base_spans_equal_brute_force_and_random_runs_are_found(spark):
    texts = secret_texts()
    df = docs_of(spark, texts).withColumnRenamed("lang", "spans")
    rows = {r["doc_id"]: r for r in secrets.secret_scan(df).collect()}
    found = 0
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        names = ["assign", "access", "hex"]
        said = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        r = rows[i]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in want) for j in range(3)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("random")] == (said.split(",") if said else [])
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)
        found += any(x.startswith("random") and int(x.split(":")[2]) - int(x.split(":")[1]) == 40 for x in spans)
    assert found >= 0.95 * 120  # the random runs that no base pattern has
    assert "random" not in rows[len(texts) - 6]["spans"]
    assert secrets.secret_scan(df.where("false")).count() == 0


def test_redaction(spark):
    texts = secret_texts()
    df = docs_of(spark, texts)
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_scan(df).collect()}
    for i, t in enumerate(texts):
        merged, text = [], t
        for x in filter(None, spans[i].split(",")):
            s, e = map(int, x.split(":")[1:])
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for s, e in reversed(merged):
            text = text[:s] + "[secret]" + text[e:]
        assert rows[i]["text"] == text and (text is None or not merged or rows[i]["n_chars"] == len(text))


def test_secrets_in_odd_tables(spark):
    r = random.Random(3)
    dump = "\n".join(" ".join(f"{r.randrange(1 << 64):016x}" for _ in range(4)) for _ in range(900)) + " token=abcdefgh12345678 é " + "x" * 200_000
    rows = [(1, dump), (1, dump), (None, "password: aaaabbbbcccc1"), (3, None), (4, "")]
    names = ["__t", "row", "base", "spans", "Runs", "t"]
    df = spark.createDataFrame([(*x, *[f"{n}!" for n in names], 5) for x in rows], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}, n_chars int")
    got = {(x["doc_id"], x["n_hex"], x["base_sha256"]) for x in secrets.secret_scan(df).collect()}
    said = lambda t: hashlib.sha256(",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in base_spans(t or "")).encode()).hexdigest()
    assert got == {(i, sum(k == 2 for _, k, _ in base_spans(t or "")), said(t)) for i, t in rows} and secrets.secret_scan(df).count() == 5
    out = secrets.redact(df)
    assert out.columns == df.columns and out.schema == df.schema
    texts = sorted((str(x["doc_id"]), x["text"] or "", x["n_chars"], [x[n] for n in names]) for x in out.collect())
    assert all(x[3] == [f"{n}!" for n in names] for x in texts) and texts[-1][1] == "[secret]" and texts[-1][2] == 8
    assert texts[0][1].count("[secret]") == 3601 and texts[0][1].endswith(" é " + "x" * 200_000) and texts[0] == texts[1]


# ---------------------------------------------------------------- licences, chat


def test_licenses_wrapped_at_any_width(spark):
    import textwrap

    wrap = lambda text, n: "\n\n".join("\n".join(textwrap.wrap(p, n, break_long_words=False, break_on_hyphens=False)) for p in re.split(r"\n\s*\n", text))
    cases = [(k, "Copyright (c) 2001-2024, Some Body\n\n" * (n % 2) + wrap(text, n)) for k, text in licenses.KNOWN.items() for n in range(50, 121)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs_of(spark, [t for _, t in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [k for k, _ in cases]


def test_copyright_lines():
    import re

    notice = lambda x: bool(re.match(licenses.COPYRIGHT_LINE, x))
    assert all(map(notice, ["copyright (c) 2020 x", "  copyright 2020 x", "copyright some body 1999", "(c) 2020 x", "© 2020", "copyright by x", "copyright <year> <holder>", "(c) copyright x"]))
    assert not any(map(notice, ["copyright notice and this permission notice appear", "copyright holders be liable", "(c) you must retain", "the copyright (c) 2020"]))


def test_license_variants(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;"), mit.replace("sublicense", "sub-license"), mit + " More.", "Released under the MIT Licence!", None, "", "Copyright 2020 X"]
    got = [r["license_id"] for r in licenses.license_scan(docs_of(spark, texts).withColumnRenamed("lang", "digest")).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "MIT", None, "MIT-notice", None, None, None]


def test_every_known_form_is_found_and_odd_rows_are_kept(spark):
    known = licenses.forms()
    texts = [f"{t}" if "\n" not in t else t.replace("\n", "\n\nCopyright (c) 1999, Some One. All rights reserved.\n", 1) for _, t in known] + [None, "", "word " * 40_000, known[0][1], known[0][1]]
    df = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id"))).withColumnRenamed("lang", "license_id")
    got = licenses.license_scan(df).collect()
    found = {r["doc_id"]: r["license_id"] for r in got}
    assert [found[i or None] for i in range(len(known))] == [k for k, _ in known]
    assert [found[len(known) + i] for i in range(5)] == [None, None, None, known[0][0], known[0][0]] and len(got) == len(texts)
    assert licenses.license_scan(df.where("false")).count() == 0


def brute_chat(turns):
    convs = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None and t is not None:
            convs[c].append((t, role or "", text or ""))
    full = {c: tuple(sorted(v)) for c, v in convs.items()}
    kept = []
    for c, v in full.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v and w[len(v)][0] != v[-1][0] for w in full.values())
        if not longer and not any(w == v and d < c for d, w in full.items()):
            kept.append(c)
    return sorted((c, k, f"<|{role}|>\n{text}\n") for c in kept for k, (_, role, text) in enumerate(full[c]))


def test_chat_equals_brute_force(spark):
    r = random.Random(9)
    turns, n = [], 0
    for _ in range(30):
        conv = [(t, r.choice(["user", "assistant", None]), r.choice(["hi", "there", None, "what's up"])) for t in range(r.randint(1, 7))]
        for size in {len(conv), r.randint(1, len(conv))}:
            turns += [(n, *x) for x in conv[:size]]
            n += 1
    turns += [(n, 300, "user", "far"), (n, 0, "user", "near"), (n + 1, 0, "user", "near"), (None, 0, "user", "x"), (5, None, "user", "x"), (n + 2, 0, "user", "twice"), (n + 2, 0, "user", "twice")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, n long").repartition(4)
    got = sorted((x["conv_id"], x["position"], x["piece"]) for x in chat.chat_formatting(df).collect())
    assert got == brute_chat(turns)
    assert chat.chat_formatting(df.where("false")).count() == 0


def test_word_hashes_follow_words_alone():
    import pyarrow as pa

    texts = ["One two", "two", None, "  three\tone ", "é two"]
    hashes = []
    for c in K.chunks(pa.array(texts), 4):
        s, e, at = c.spans()
        h = c.hashes(s, e)
        hashes += [h[at[i] : at[i + 1]].tolist() for i in range(c.n)]
    assert hashes[0][1] == hashes[1][0] == hashes[4][1] and hashes[0][0] == hashes[3][1] and hashes[2] == []
    assert base64.b64encode(b"x")


def test_only_sets_of_two_components_are_paired(spark):
    star = spark.createDataFrame([(a, 0, False, 100, 30, list(range(30))) for a in range(1, 7)], "a long, b long, linked boolean, size long, apart long, tokens array<long>")
    roots = lambda pairs: spark.createDataFrame(pairs, "node long, root long")
    pairs = lambda r: sorted(tuple(x) for x in ngram_join.meetings(star, r, 80, 100).collect())
    assert len(pairs(roots([]))) == 15
    assert pairs(roots([(a, 1) for a in range(1, 7)])) == []
    assert pairs(roots([(a, 1) for a in range(1, 6)])) == [(a, 6) for a in range(1, 6)]
