"""N-gram Jaccard join by partition of the universe and the pigeonhole principle.

A document's set holds the hashes of its distinct runs of ``n`` words (words are
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a shorter text is one run, an empty one no set).
Two sets link when ``den * |a & b| >= num * |a | b|``, that is when they differ in at most
``(den - num) * (|a| + |b|) / (den + num)`` elements.

* Size bands grow by ``den / num``, so linked sets lie in one band or in neighbours. For
  each band the universe is hashed into segments, a fifth more than the largest difference
  plus one, and a set's part in a segment gives a signature. Bands of small sets also get
  half as many segments, signed with their one-deletion neighbourhoods.
* Allocation by counted cost. How many sets hold a signature is counted over all data. Of
  the whole segments a set signs only its rarest, as many as its own largest difference
  plus one (threshold 0); its most common ones are left out (threshold -1). As the order
  is the same for all and two linked sets agree in all segments but at most as many as
  they differ in, they share one that both have signed. In a band of small sets that
  scheme stays, whole segments or one-deletion neighbourhoods (threshold 1), whose counted
  lists are shorter.
* Of the sets that share a signature the best-supported one is the pivot. Every other is
  compared with it by the whole texts, which gives the exact link and the elements in which
  the two differ. Two sets of a group of which at least one isn't linked to the pivot can
  only link if these differences overlap, by as much as their sizes say. So they meet by
  the first elements of the differences in a fixed order (those that the pivot lacks come
  first), of which several must agree, never as all pairs of a group, and are then compared
  by the whole texts. Sets that both link to the
  pivot are in one component already; others are first compared with one leader of those that
  share their differences, and only sets of two components are paired.

Equal sets are one node throughout: copies make no pairs. Comparison reads the whole texts
again and matches 64-bit hashes of their runs. A common signature, a pivot of many sets and
a large component are split over tasks: what one of them joins was written before, so that
skewed joins can be dealt anew, and a pivot's members are dealt out by a salt, with one copy
of its text for each.

Nulls and ties: a null doc_id takes part with its text and its component is the least
known doc_id there; repeated rows come back as often as they are given; no text or no
words: ``n_shingles`` 0 and the document's own id. Very long texts are sets like others.
Further columns, whatever their names, are ignored by the join and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .common import components, discard, prepare, row_digest, settle, unused

WORDS, NUM, DEN = 4, 85, 100
SLACK = 1.2
#: Bands up to this size are also signed by one-deletion neighbourhoods.
SMALL = 48
#: Sets that are compared with one copy of their pivot's text.
DEALT = 256
#: Two sets meet by an eighth of the elements that their differences from a pivot must share, at most by so many.
SHARE = 16
#: Parts of the signatures that are counted one after the other, so that only one part's shuffle is on disk.
PARTS = 4
#: How often the sets that share differences are compared with one of them before any two are paired.
ROUNDS = 2


class Bands:
    """Size bands, and for each the number of whole segments and of those with deletions."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(self.low[-1] * den // num + 1)
        self.plans = [self._plan(k) for k in range(len(self.low) - 1)]

    def differ(self, total: int) -> int:
        return (self.den - self.num) * total // (self.den + self.num)

    def most(self, size: int) -> int:
        """The largest difference of a set of ``size`` from one that it links with."""
        return self.differ(size + size * self.den // self.num)

    def _plan(self, k: int) -> tuple[int, int]:
        need = self.most(self.low[k + 1] - 1) + 1
        return int(np.ceil(SLACK * need)), (need + 1) // 2 if self.low[k + 1] - 1 <= SMALL else 0

    def spaces(self, size: int) -> list[tuple[int, int]]:
        """``(band, largest difference)`` of the indexes in which a set of ``size`` takes part."""
        k = int(np.searchsorted(self.low, size, "right")) - 1
        own = [(k, self.most(size))]
        if k:
            own.append((k - 1, self.differ(size + self.low[k] - 1)))
        return [(b, d) for b, d in own if d]  # with no difference allowed only equal sets link


def signed(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[int]]:
    """Signatures of one set of distinct 64-bit tokens, and how many of its whole segments it
    may leave out in bands of even and of odd number. A signature's lowest bit is the band's,
    the next tells a deletion scheme. Empty segments count as the most common ones."""
    out, spare = [], [0, 0]
    own = K.mix(tokens ^ K.U(0x5851F42D4C957F2D))
    for band, most in bands.spaces(len(tokens)):
        for deletions, m in enumerate(bands.plans[band]):
            if not m:
                continue
            seg = (own % K.U(m)).astype(np.int64)
            held = np.bincount(seg, minlength=m)
            total = np.zeros(m, K.U)
            np.add.at(total, seg, tokens)
            label = (np.arange(m, dtype=K.U) + K.U((2 * band + deletions) << 40)) * K.U(0x9E3779B97F4A7C15)
            mark = lambda x, b=K.U((band & 1) + 2 * deletions): (K.mix(x) & ~K.U(3)) | b
            if deletions:
                out += [mark(total + label), mark(total[seg] - tokens + label[seg])]
                continue
            s, need = mark(total + label), most + 1
            full, empty = s[held > 0], np.sort(s[held == 0])
            full = np.concatenate([full, empty[: max(0, need - len(full))]])
            spare[band & 1] = len(full) - need
            out.append(full)
    return (np.unique(np.concatenate(out)) if out else np.zeros(0, K.U)), spare


def signatures(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    return signed(tokens, bands)[0]


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for c in K.chunks(column):
        starts, ends, at = c.spans()
        h = c.hashes(starts, ends)
        for i in range(c.n):
            yield np.unique(K.document_shingles(h[at[i] : at[i + 1]], n))


def profile(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """Per row: doc_id, a digest of the row, the set's fingerprint, size, signatures and how
    many of them it may leave out.

    A task gives the signatures of equal sets once, so a group of copies costs each task
    one set of them.
    """

    def go(batches):
        seen: set[int] = set()
        for b in batches:
            prints, sizes, sigs, even, odd = [], [], [], [], []
            for s in shingle_sets(b["text"], n):
                sizes.append(len(s))
                p = int(K.mix(np.array([np.add.reduce(K.mix(s + K.U(9))) + K.U(len(s))]))[0].view(np.int64)) if len(s) else None
                prints.append(p)
                new = p is not None and p not in seen
                own, spare = signed(s, bands) if new else (None, (None, None))
                sigs.append(own.view(np.int64) if new else None)
                even.append(spare[0])
                odd.append(spare[1])
                if new:
                    seen.add(p)
            longs = [pa.array(x, pa.int64()) for x in (prints, sizes, even, odd)]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["row"], *longs, pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "row", "node", "size", "even", "odd", "signed"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_digest(docs).alias("row"), "text").mapInArrow(
        go, f"doc_id {kind}, row string, node long, size long, even long, odd long, signed array<long>"
    )


def allocate(rows: DataFrame, bands: Bands) -> DataFrame:
    """``(sig, node, n)``: the signatures by which a set takes part, n being how many hold it."""
    every = rows.where("signed is not null").select("node", F.explode("signed").alias("sig"))
    parts = []
    for k in range(PARTS):
        each = every.where(F.pmod(F.shiftrightunsigned("sig", 2), F.lit(PARTS)) == k)
        common = settle(each.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least <> most").select("sig", "n"), "common")
        parts.append(settle(each.join(common, "sig"), "shared"))
        discard(common)
    shared = reduce(DataFrame.union, parts).distinct()
    info = rows.where("signed is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("even").alias("even"), F.first("odd").alias("odd"))

    parity, deletions = F.col("sig").bitwiseAND(1), F.col("sig").bitwiseAND(2) > 0
    own = F.size(F.filter(F.array(*[F.lit(x) for x in bands.low if x <= SMALL]), lambda x: x <= F.col("size"))) - 1
    small = F.when(F.col("size") <= SMALL, own - (own + parity) % 2)  # the row's band, if it can have both schemes
    placed = settle(shared.join(info, "node").withColumn("band", small), "placed")
    discard(*parts)
    lists = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    scheme = placed.where("band is not null").groupBy("band").agg((lists(deletions) < lists(~deletions)).alias("delete"))
    by_size = [k for k, (_, near) in enumerate(bands.plans) if near]
    chosen = placed.join(F.broadcast(scheme.where(F.col("band").isin(by_size))), "band", "left")  # a row a small band
    delete = F.coalesce("delete", F.lit(False))

    rarest_last = Window.partitionBy("node", parity).orderBy(F.desc("n"), F.desc("sig"))
    spare = F.when(parity == 0, F.col("even")).otherwise(F.col("odd"))
    whole = chosen.where(~deletions & ~delete).withColumn("common", F.row_number().over(rarest_last)).where(F.col("common") > spare)
    live = settle(whole.select("sig", "node", "n").union(chosen.where(deletions & delete).select("sig", "node", "n")), "live")
    discard(placed)
    return live


def differences(s: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of the sorted set ``s`` isn't in ``head``, and the reverse."""
    at = np.minimum(np.searchsorted(head, s), len(head) - 1)
    both = head[at] == s
    rest = np.ones(len(head), bool)
    rest[at[both]] = False
    return s[~both], head[rest]


def compare(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per row of ``pairs(a, b)``: ``a, b, linked, size`` of a, ``apart`` (in how many elements
    they differ) and ``tokens``, the first of these in a fixed order, as many as a meeting with
    another set of b's can need. Many pairs may have one b."""
    bands = Bands(num, den)

    def go(batches):
        head = None
        for batch in batches:
            a, b, linked, sizes, apart, tokens = [], [], [], [], [], []
            for is_member, x, y, s in zip(batch["member"].to_pylist(), batch["node"].to_pylist(), batch["b"].to_pylist(), shingle_sets(batch["text"], n)):
                if not is_member:
                    head = s
                    continue
                more, less = differences(s, head)
                d = len(more) + len(less)
                link = d <= bands.differ(len(s) + len(head))
                # a set linked to b meets only unlinked ones, with which it shares over num / (den + num) of its difference
                need = SHARE + (den * d // (den + num) if link else bands.most(len(s)))
                a.append(x), b.append(y), linked.append(link), sizes.append(len(s)), apart.append(d)
                tokens.append(np.concatenate([more, less])[:need].view(np.int64))
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(apart, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.list_(pa.int64()))], ["a", "b", "linked", "size", "apart", "tokens"])

    dealt = settle(pairs.groupBy("b").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("salts")), "dealt")
    members = pairs.join(dealt, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"))
    members = members.join(texts.withColumnRenamed("node", "a"), "a").select("b", "salt", F.lit(True).alias("member"), F.col("a").alias("node"), "text")
    heads = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("b").alias("node"), "text")
    runs = heads.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", "member")
    return runs.mapInArrow(go, "a long, b long, linked boolean, size long, apart long, tokens array<long>")


def joined(links: DataFrame, star: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``links`` with more of them, and ``(node, root)``, the components that they make. Of the sets of
    one pivot that share an element of their differences and aren't all of one component, one leads (the
    one with the least hash, so that it leads wherever it is); each set is compared with the leader that
    it meets most often. That is one comparison a set, however large its group."""
    roots = settle(components(links), "roots")
    for _ in range(ROUNDS):
        each = rooted(star, roots).select("b", "a", "root", F.explode("tokens").alias("token"))
        groups = each.groupBy("b", "token").agg(F.min(F.struct(F.xxhash64("a").alias("h"), "a", "root")).alias("led"), F.min("root").alias("low"), F.max("root").alias("high"))
        led = groups.where("low <> high").select("b", "token", F.col("led.a").alias("leader"), F.col("led.root").alias("of"))
        met = each.join(led, ["b", "token"]).where("root <> of").groupBy("a", "leader").agg(F.count("*").alias("n"))
        tried = settle(met.groupBy("a").agg(F.max(F.struct("n", "leader")).alias("m")).select("a", F.col("m.leader").alias("b")), "tried")
        if tried.isEmpty():
            break
        found = settle(compare(tried, texts, n, num, den).where("linked").select("a", "b"), "found")
        if found.isEmpty():
            break
        links = links.union(found)
        roots = settle(components(links), "roots")
    return links, roots


def rooted(star: DataFrame, roots: DataFrame) -> DataFrame:
    """``star`` with the ``root`` of a's component, a itself where it has no link."""
    return star.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))


def meetings(star: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b)``: sets of one pivot and of two components, at least one of them not linked to the pivot,
    that may link: by their sizes the differences must have ``overlap`` elements in common, so their
    first ``apart - overlap + k`` elements must have k, for any k up to the overlap. An element that
    only sets of one component have pairs nothing."""
    every = rooted(star, roots).select("b", "a", "root", "linked", "size", "apart", F.posexplode("tokens").alias("pos", "token"))
    mixed = every.groupBy("b", "token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("b", "token")
    each = settle(every.join(mixed, ["b", "token"]), "each")
    ours = F.col("pos") < F.floor(den * F.col("apart") / F.lit(den + num)) + SHARE  # all that a meeting of two unlinked sets can need
    loose, tied = each.where("not linked"), each.where("linked")

    def met(u: DataFrame, v: DataFrame, once) -> DataFrame:
        u, v = u.alias("u"), v.alias("v")
        most = F.floor((den - num) * (F.col("u.size") + F.col("v.size")) / F.lit(den + num))
        overlap = F.floor((F.col("u.apart") + F.col("v.apart") - most + 1) / 2)
        fits = (F.col("u.size") * den >= F.col("v.size") * num) & (F.col("v.size") * den >= F.col("u.size") * num)
        asked = F.least(F.greatest(F.ceil(overlap / 8), F.lit(1)), F.lit(SHARE))
        places = (F.col("u.pos") < F.col("u.apart") - overlap + asked) & (F.col("v.pos") < F.col("v.apart") - overlap + asked)
        same = (F.col("u.b") == F.col("v.b")) & (F.col("u.token") == F.col("v.token")) & (F.col("u.root") != F.col("v.root"))
        return u.join(v, same & once & fits & places).select("u.b", F.col("u.a").alias("a"), F.col("v.a").alias("other"), asked.alias("asked"))

    pairs = met(loose.where(ours), loose.where(ours), F.col("u.a") < F.col("v.a")).union(met(loose, tied, F.col("u.a") != F.col("v.a")))
    enough = pairs.groupBy("b", "a", "other").agg(F.count("*").alias("n"), F.min("asked").alias("asked")).where("n >= asked")
    return enough.select("a", F.col("other").alias("b")).distinct()


def classes(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of ``docs``: doc_id, row (a digest of the row), size (of its set), class (a
    number of its component; null where the set is empty)."""
    prepare(docs.sparkSession)
    profiled = settle(profile(docs, n, Bands(num, den)), "profile")
    live = allocate(profiled, Bands(num, den))
    rows = settle(profiled.select("doc_id", "row", "node", "size", F.col("signed").isNotNull().alias("first")), "rows")
    discard(profiled)  # the signatures are most of what is on disk

    # the best-supported member of a group is most likely what the others are copies of
    support = live.groupBy("node").agg(F.sum("n").alias("support"))
    pivots = settle(live.join(support, "node").groupBy("sig").agg(F.max(F.struct("support", "node")).alias("p")).select("sig", F.col("p.node").alias("b")), "pivots")
    pairs = settle(live.join(pivots, "sig").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    discard(live, pivots)
    texts = settle(_texts(docs, rows, pairs), "texts")
    star = settle(compare(pairs, texts, n, num, den), "star")
    links, known = joined(star.where("linked").select("a", "b"), star, texts, n, num, den)
    more = settle(compare(settle(meetings(star, known, num, den), "meetings"), texts, n, num, den).where("linked").select("a", "b"), "links")
    roots = components(links.union(more))

    return rows.select("doc_id", "row", "node", "size").join(roots, "node", "left").select("doc_id", "row", "size", F.coalesce("root", "node").alias("class"))


def ngram_jaccard_join(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    named = settle(classes(docs, n, num, den), "classes")
    # written first, so that a component of very many documents can be split in the join
    least = settle(named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")), "least")
    return named.join(least, "class", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _texts(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(node, text)``: one whole text for each node of ``pairs``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = rows.where("first").groupBy("node").agg(F.min("row").alias("row")).join(wanted, "node", "left_semi")
    keyed = docs.select(row_digest(docs).alias("row"), "text")
    return keyed.join(chosen, "row").select("node", "text").dropDuplicates(["node"])


def keep_one(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id (rows without one
    come last; of rows that have it too, which one depends on all their columns, not on their
    order). Rows without words stay, all of them."""
    named = settle(classes(docs, n, num, den), "classes")
    row = unused(docs, "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    kept = named.where("class is not null").groupBy("class").agg(first).select(F.col("first.row").alias(row)).distinct()
    keyed = docs.withColumn(row, row_digest(docs))
    one = keyed.join(kept, row, "left_semi").dropDuplicates([row])
    empty = named.where("class is null").select(F.col("row").alias(row)).distinct()
    return one.unionByName(keyed.join(empty, row, "left_semi")).drop(row)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 85 * (len(sa.sh) + len(sb.sh) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT doc_id, doc_id FROM s),
r(node, reach) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(reach) AS component_id FROM s JOIN r ON doc_id = node GROUP BY ALL
"""
