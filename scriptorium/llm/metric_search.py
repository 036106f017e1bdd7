"""Exact top-k search: M-trees over the vectors, searched best-first.

The score of a query q and a vector x is their integer inner product after each component
became ``floor(scale * component)``. With one more component, ``sqrt(M - |x|^2)`` for
vectors (M: the largest squared norm) and 0 for queries, the squared Euclidean distance is
``|q|^2 + M - 2 * score``: nearest in that metric is highest in score, so a metric tree
answers the search exactly.

* Equal vectors are one object that keeps its ``k + 1`` smallest ids: no query needs more
  (its own id may be one of them), so a vector that a third of all rows repeat costs one
  object, and nothing is lost.
* A bounded number of pivots (``PIVOTS`` at most) deals objects to cells; a cell that holds
  more than ``tree_rows`` objects is split evenly by hash. Each part becomes one tree of
  pages of at most ``page`` entries, written to the shared folder. A routing entry has its
  object, covering radius, distance to the parent's object and child page; a leaf entry has
  its object, distance to the parent and ids.
* Queries go in blocks of about ``query_block`` rows, so what is broadcast is bounded. A
  block first visits the trees nearest to it, which gives every query a bound, and then all
  other trees under that bound. Within a tree a queue yields the page with the least
  possible distance; ``|d(q, parent) - d(o, parent)| - radius`` passes over entries before
  any distance to them is computed.

Bounds carry a slack for rounding; scores are exact: sums of components up to ``2**22`` after
scaling are exact in doubles, and vectors with larger ones stay out of the trees and are
scored in whole numbers of any size (scores beyond 64 bits count as the extreme long).

Nulls and ties: vectors that are null or hold null or non-finite components take no part,
nor do rows without an id; shorter vectors, empty ones too, count as filled up with zeros; a row given
twice is one; equal scores go to the smaller id. Empty tables give no rows. Further columns
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, settle

K, SCALE = 5, 256
PIVOTS, TREE_ROWS, PAGE, QUERY_BLOCK = 1024, 8192, 256, 50_000
HELD = 1 << 22
#: Levels of a tree that follow the distances; below them pages are halved evenly, so that outliers can't make it deep.
DEPTH = 12

PAGES = (
    "array<struct<leaf:boolean,objects:binary,parent_distance:binary,radius:binary,child:binary,ids:binary,id_bounds:binary>>"
)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``array<double>`` of ``floor(scale * x)``, whole numbers; null where the vector takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).otherwise(F.lit(float(scale)) * x.cast("double"))
    return F.when(good, F.transform(vector, whole))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow lists as a matrix, filled up with zeros."""
    out = np.zeros((len(column), dim))
    bounds = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(bounds[0], bounds[-1]) - np.repeat(bounds[:-1], sizes)] = flat[bounds[0] : bounds[-1]]
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes all norms equal."""
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


# ---------------------------------------------------------------- building


def build(x: np.ndarray, ids: list[np.ndarray], most: float, page: int = PAGE) -> list[dict]:
    """The pages of the tree over vectors ``x``; page 0 is the root."""
    lifted = _lifted(x, most)
    pages: list[dict | None] = []

    def leaf(members: np.ndarray, parent: np.ndarray | None) -> dict:
        own = [ids[i] for i in members]
        far = _distances(lifted[members], parent[None])[:, 0] if parent is not None else np.zeros(len(members))
        return {
            "leaf": True, "objects": x[members].astype("<i4").tobytes(), "parent_distance": far.tobytes(), "radius": b"", "child": b"",
            "ids": np.concatenate(own).astype("<i8").tobytes(), "id_bounds": np.cumsum([0, *map(len, own)]).astype("<i4").tobytes(),
        }

    def grow(members: np.ndarray, parent: np.ndarray | None, depth: int = 0) -> int:
        number = len(pages)
        pages.append(None)
        if len(members) <= page:
            pages[number] = leaf(members, parent)
            return number
        fan = min(page, -(-len(members) * 2 // page))
        chosen = members[np.linspace(0, len(members) - 1, fan).astype(np.int64)]
        near = np.concatenate([_distances(lifted[members[k : k + 4096]], lifted[chosen]).argmin(1) for k in range(0, len(members), 4096)])
        parts = [members[near == j] for j in range(fan)]
        if max(map(len, parts)) == len(members) or depth >= DEPTH:  # objects too alike to part, or parting one at a time
            parts = np.array_split(members, fan)
        kept = [j for j in range(fan) if len(parts[j])]
        radius = np.array([_distances(lifted[parts[j]], lifted[chosen[j]][None]).max() for j in kept])
        centres = lifted[chosen[kept]]
        far = _distances(centres, parent[None])[:, 0] if parent is not None else np.zeros(len(kept))
        child = np.array([grow(parts[j], lifted[chosen[j]], depth + 1) for j in kept], "<i4")
        pages[number] = {
            "leaf": False, "objects": x[chosen[kept]].astype("<i4").tobytes(), "parent_distance": far.tobytes(), "radius": radius.tobytes(),
            "child": child.tobytes(), "ids": b"", "id_bounds": b"",
        }
        return number

    grow(np.arange(len(x)), None)
    return pages


def objects(vectors: DataFrame, k: int = K) -> DataFrame:
    """``(v, ids)`` of ``vectors(vec_id, v)``: each different vector with its k + 1 smallest ids."""
    one = vectors.groupBy("v", "vec_id").agg(F.lit(1).alias("one"))
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def index(vectors: DataFrame, k: int = K, tree_rows: int = TREE_ROWS, page: int = PAGE) -> tuple[DataFrame, dict]:
    """The trees of ``vectors(vec_id, v)`` as rows ``(tree, centre, radius, pages)``, and what holds for all of them."""
    found = settle(objects(vectors, k), "objects")
    norm = F.aggregate("v", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double"))
    about = found.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("most")).first()
    n, dim, most = about["n"], about["dim"] or 0, about["most"] or 0.0
    pivots = found.orderBy(F.xxhash64("v")).limit(min(PIVOTS, max(1, -(-2 * n // tree_rows)))).collect()  # PIVOTS rows at most
    centres = np.zeros((max(1, len(pivots)), dim))
    for i, p in enumerate(pivots):
        centres[i, : len(p["v"])] = p["v"]
    lifted = _lifted(centres, most)

    def cells(batches):
        for b in batches:
            near = _distances(_lifted(_rows(b["v"], dim), most), lifted).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], ["v", "ids", "cell"])

    dealt = settle(found.mapInArrow(cells, "v array<long>, ids array<long>, cell int"), "cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / tree_rows).alias("parts"))  # PIVOTS rows at most
    placed = dealt.join(F.broadcast(sizes), "cell").withColumn("tree", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("v", F.lit(3)), "parts"))

    def tree(t: pa.Table) -> pa.Table:
        column, ids = t["v"].combine_chunks(), t["ids"].combine_chunks()
        x = _rows(column, dim)
        order = np.lexsort(x.T[::-1])  # the same tree however the rows arrive
        own = [ids[int(i)].values.to_numpy(zero_copy_only=False) for i in order]
        x = x[order]
        up = _lifted(x, most)
        centre = up.mean(0)
        made = pa.array([build(x, own, most, page)], PAGE_TYPE)
        return pa.table([t["tree"][:1], pa.array([centre.tolist()]), pa.array([float(_distances(up, centre[None]).max())]), made], ["tree", "centre", "radius", "pages"])

    trees = placed.select("tree", "v", "ids").groupBy("tree").applyInArrow(tree, f"tree long, centre array<double>, radius double, pages {PAGES}")
    return settle(trees, "trees"), {"dim": dim, "most": most}


PAGE_TYPE = pa.list_(
    pa.struct([("leaf", pa.bool_())] + [(c, pa.binary()) for c in ("objects", "parent_distance", "radius", "child", "ids", "id_bounds")])
)


# ---------------------------------------------------------------- searching


class Tree:
    """A tree's pages, decoded once for a block of queries."""

    def __init__(self, pages: list[dict], dim: int, most: float):
        self.most = most
        self.pages = []
        for p in pages:
            x = np.frombuffer(p["objects"], "<i4").reshape(-1, dim).astype(np.float64)
            read = lambda c, kind, p=p: np.frombuffer(p[c], kind)
            self.pages.append((p["leaf"], x, read("parent_distance", "f8"), read("radius", "f8"), read("child", "<i4"), read("ids", "<i8"), read("id_bounds", "<i4")))

    def search(self, q: np.ndarray, own: int, k: int, bound: float) -> list[tuple[int, int]]:
        """The k best ``(score, id)`` whose score is at least ``bound``."""
        square = float(q @ q) + self.most
        slack = 1e-6 * (1 + np.sqrt(square))
        best: list[tuple[float, int]] = []  # (-score, id), in order
        reach = np.sqrt(max(square - 2 * bound, 0)) + slack if bound > -np.inf else np.inf
        queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
        while queue:
            least, number, far = heapq.heappop(queue)
            if least > reach:
                break
            leaf, x, parent, radius, child, ids, bounds = self.pages[number]
            if far >= 0 and reach < np.inf:  # the stored distances rule entries out unseen
                near = np.abs(far - parent) - (radius if not leaf else 0) <= reach
                at = np.flatnonzero(near)
                x = x[at] if len(at) < len(near) else x
            else:
                at = np.arange(len(x))
            if not len(at):
                continue
            score = x @ q
            if not leaf:
                d = np.sqrt(np.maximum(square - 2 * score, 0))
                low = np.maximum(d - radius[at], 0)
                for j in np.flatnonzero(low <= reach):
                    heapq.heappush(queue, (float(low[j]), int(child[at[j]]), float(d[j])))
                continue
            good = np.flatnonzero(score >= bound)
            if not len(good):
                continue
            if len(good) > k + 1:  # an object has an id besides the query's own, or is the query
                good = good[score[good] >= np.partition(score[good], -k - 1)[-k - 1]]
            best += [(-float(score[j]), int(i)) for j in good for i in ids[bounds[at[j]] : bounds[at[j] + 1]] if i != own]
            best = sorted(best)[:k]
            if len(best) == k:
                bound = max(bound, -best[-1][0])
                reach = np.sqrt(max(square - 2 * bound, 0)) + slack
        return [(int(-s), i) for s, i in best]


def _search(trees: DataFrame, about: dict, block: dict, k: int, home: bool) -> DataFrame:
    """Candidates of a block's queries: from their nearest trees (``home``), or from all others."""
    sent, dim, most = trees.sparkSession.sparkContext.broadcast(block), about["dim"], about["most"]

    def go(batches):
        ids, x, near, bound = (sent.value[c] for c in ("ids", "x", "home", "bound"))
        norms = (x * x).sum(1) + most
        slack = 1e-6 * (1 + np.sqrt(norms))
        for b in batches:
            for number, centre, radius, pages in zip(b["tree"].to_pylist(), b["centre"], b["radius"].to_pylist(), b["pages"], strict=True):
                if home:
                    wanted = np.flatnonzero(near == number)
                else:
                    c = centre.values.to_numpy()
                    d = _distances(np.column_stack([x, np.zeros(len(x))]), c[None])[:, 0]
                    reach = np.sqrt(np.maximum(norms - 2 * np.where(bound > -np.inf, bound, 0), 0)) + slack
                    wanted = np.flatnonzero((near != number) & ((bound == -np.inf) | (d - radius <= reach)))
                out = []
                if len(wanted):
                    tree = Tree(pages.as_py(), dim, most)
                    for j in wanted:
                        out += [(ids[j], i, s) for s, i in tree.search(x[j], ids[j], k, bound[j])]
                cols = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    # one tree is one task: a tree's search is far longer than its reading
    return trees.repartition(max(1, trees.sparkSession.sparkContext.defaultParallelism), "tree").mapInArrow(go, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, tree_rows: int = TREE_ROWS, page: int = PAGE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding)`` for which ``is_query`` holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    prepare(spark)
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), is_query.alias("q")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    large = F.exists("v", lambda x: F.abs(x) > HELD)
    if known.where(large).limit(1).count():
        found = _tree_search(known.where(~large), k, tree_rows, page, query_block).unionByName(_exact_search(known, large, k, query_block))
    else:
        found = _tree_search(known, k, tree_rows, page, query_block)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a query id that has two vectors may meet one candidate twice: its better score counts
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact_search(known: DataFrame, large: Column, k: int, query_block: int) -> DataFrame:
    """Scores of the pairs in which one vector has components too large for exact doubles, in
    Python's integers: large candidates for all queries and all candidates for large queries.
    Queries are sent in blocks; each task keeps its k best for a query. Scores beyond 64 bits
    count as the largest or smallest long."""
    parts = []
    for asked, candidates in ((known.where("q"), known.where(large)), (known.where("q").where(large), known.where(~large))):
        asked = settle(asked.select("vec_id", "v").distinct(), "queries")
        blocks = -(-asked.count() // query_block)
        for n in range(blocks):
            rows = [(r["vec_id"], [int(x) for x in r["v"]]) for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()]  # about query_block rows

            def go(batches, rows=rows):
                best: list[dict[int, int]] = [{} for _ in rows]
                for b in batches:
                    for i, v in zip(b["vec_id"].to_pylist(), b["v"].to_pylist(), strict=True):
                        v = [int(x) for x in v]
                        for (q, w), own in zip(rows, best, strict=True):
                            if q != i:
                                s = max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w))))
                                own[i] = max(own.get(i, s), s)
                                if len(own) > 4 * k + 16:
                                    for j in sorted(own, key=lambda j: (-own[j], j))[k:]:
                                        del own[j]
                out = [(q, i, own[i]) for (q, _), own in zip(rows, best, strict=True) for i in sorted(own, key=lambda j: (-own[j], j))[:k]]
                cols = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

            parts.append(candidates.select("vec_id", "v").mapInArrow(go, "query_id long, vec_id long, score long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _tree_search(known: DataFrame, k: int, tree_rows: int, page: int, query_block: int) -> DataFrame:
    """``(query_id, vec_id, score)``: more than enough rows for each query, the k best among them."""
    spark = known.sparkSession
    known = known.withColumn("v", F.col("v").cast("array<long>"))
    trees, about = index(known.select("vec_id", "v"), k, tree_rows, page)
    asked = settle(known.where("q").groupBy("vec_id", "v").agg(F.lit(1).alias("one")).select("vec_id", "v"), "queries")
    roots = trees.select("tree", "centre").where("tree % (1L << 32) = 0").orderBy("tree").limit(PIVOTS).collect()  # one a cell: PIVOTS at most
    parts = []
    blocks = -(-asked.count() // query_block)
    for n in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()  # about query_block rows
        if not rows:
            continue
        x = np.zeros((len(rows), about["dim"]))
        for i, r in enumerate(rows):
            x[i, : len(r["v"])] = r["v"]
        centres, numbers = np.array([r["centre"] for r in roots]), np.array([r["tree"] for r in roots])
        up = np.column_stack([x, np.zeros(len(x))])
        near = np.concatenate([numbers[_distances(up[j : j + 4096], centres).argmin(1)] for j in range(0, len(up), 4096)])
        block = {"ids": [r["vec_id"] for r in rows], "x": x, "home": near, "bound": np.full(len(rows), -np.inf)}
        first = settle(_search(trees, about, block, k, True), "near")
        full = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        bound = {r["query_id"]: r["least"] for r in full.collect()}  # one row a query of the block
        block = block | {"bound": np.array([bound.get(i, -np.inf) for i in block["ids"]], float)}
        parts += [first, settle(_search(trees, about, block, k, False), "far")]
    if not parts:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id,
             CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
