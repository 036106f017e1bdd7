"""Chat formatting: cumulative snapshots collapse to maximal conversations, then rendering.

Logs often store a conversation again after every turn. Each turn gets a hash of all turns
up to it (a running sum of hashes of turn number, role and text, so equal prefixes and
nothing else agree), first summed within (conversation, turn), then over blocks of turns,
so no conversation is handled by one task. A conversation whose last hash is an inner hash
of another is a snapshot of it and goes by an anti-join; of equal ones the least conv_id
stays. Both sides of that join are grouped first, so a very common opening is one row.

What stays is rendered turn by turn: ``<|role|>`` and a newline, the text and a newline,
with its place in the rendered conversation. Joining a conversation's pieces in order
gives its training text; the pieces stay rows, so a huge conversation is many rows.

Nulls and ties: rows without conv_id or turn are left out; a null role or text is empty;
rows of one turn are ordered by role and text, and repeated rows are said twice. Equal
prefixes need equal turn numbers. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BLOCK = 256
#: Hashes are summed modulo nothing: sums of 31-bit values stay far below 2**63. Four of them make 124 bits.
SEEDS = (101, 202, 303, 404)
HASHES = [f"h{i}" for i in range(len(SEEDS))]


def _clean(turns: DataFrame) -> DataFrame:
    return turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Per conversation and turn: n (rows so far) and the hashes h0, h1 ... of all rows so far."""
    # the seed comes first: what followed a collision of one hash would collide in all
    hashed = [F.sum(F.pmod(F.xxhash64(F.lit(s), "turn", "role", "text"), F.lit((1 << 31) - 1))).alias(h) for h, s in zip(HASHES, SEEDS)]
    per_turn = turns.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), *hashed).withColumn("block", F.floor(F.col("turn") / BLOCK))
    sums = ["n", *HASHES]
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_turn.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in sums])
    base = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in sums])
    within = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = per_turn.select("conv_id", "block", "turn", *[F.sum(c).over(within).alias(c) for c in sums])
    return running.join(base, ["conv_id", "block"]).select("conv_id", "turn", *[(F.col(c) + F.col(f"{c}_0")).alias(c) for c in sums])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of every conversation that no longer or equal, earlier-numbered one contains."""
    prefixes = settle(prefix_hashes(_clean(turns)), "prefixes")
    ends = prefixes.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    last = prefixes.join(ends, ["conv_id", "turn"])
    whole = last.groupBy("n", *HASHES).agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.join(ends, ["conv_id", "turn"], "left_anti").select("n", *HASHES).distinct()
    return whole.join(inner, ["n", *HASHES], "left_anti").select("conv_id")


def rendered(turns: DataFrame) -> DataFrame:
    """Per row of ``turns``: its piece and where that starts in the conversation's text."""
    piece = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    rows = turns.withColumn("piece", piece).withColumns({"size": F.length("piece").cast("long"), "block": F.floor(F.col("turn") / BLOCK)})
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_0"))
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = rows.withColumns({
        "place": F.row_number().over(within).cast("long"),
        "upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)),
    })
    return placed.join(base, ["conv_id", "block"]).select(
        "conv_id", (F.col("rows_0") + F.col("place") - 1).alias("position"), "role", "piece",
        (F.col("size_0") + F.col("upto") - F.col("size")).alias("start_char"), (F.col("role") == "assistant").alias("trained"),
    )


def chat_formatting(turns: DataFrame) -> DataFrame:
    """Per turn of every maximal conversation: conv_id, position, role, piece, start_char, trained."""
    return rendered(_clean(turns).join(maximal(turns), "conv_id", "left_semi"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS k, string_agg(turn || chr(1) || role || chr(1) || text, chr(2)) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, turn IS DISTINCT FROM lead(turn) OVER (PARTITION BY conv_id ORDER BY k) AS closes,
             k = max(k) OVER (PARTITION BY conv_id) AS whole FROM r),
kept AS (SELECT min(conv_id) AS conv_id FROM p WHERE whole AND prefix NOT IN (SELECT prefix FROM p WHERE closes AND NOT whole) GROUP BY prefix),
s AS (SELECT conv_id, k, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS piece FROM r WHERE conv_id IN (SELECT conv_id FROM kept))
SELECT conv_id, (k - 1)::BIGINT AS position, role, piece,
       (coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_char,
       role = 'assistant' AS trained
FROM s
"""
