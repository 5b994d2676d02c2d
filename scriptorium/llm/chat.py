"""Chat formatting after collapsing cumulative snapshots (DataFrame functions only).

Logs often hold the same conversation many times, each snapshot a prefix of the
next.  A rolling hash over the turns names every prefix; a conversation whose
whole hash is a proper prefix of another is dropped by an anti join, exact copies
keep their smallest id, and the maximal conversations are rendered.

Turns are ordered by (turn, role, text), nulls first; ties keep one row each.
A null conv_id names one conversation like any other value.  A null role or text
differs from an empty one when prefixes are compared and renders as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize

#: Turns rendered into one row.
BLOCK_TURNS = 256
_ORDER = ("conv_id", "turn", "role", "text")


def _content(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, role, text, at, run, e1, e2)``: the turns in order, written once.

    Turns are sorted over all tasks by ranges, so a conversation of any length, even
    one whose turns all tie, is spread; ``run`` numbers the ranges, ``at`` rises by
    one from turn to turn of a range; e1 and e2 are digests of role and text.
    """
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    turns = conversations.select(*_ORDER).repartitionByRange(*order).sortWithinPartitions(*order)
    turns = turns.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("at"), _content(1).alias("e1"), _content(2).alias("e2"))
    return materialize(turns.withColumn("run", F.shiftright("at", 33)), "turns")


def conversation_runs(turns: DataFrame) -> DataFrame:
    """``(c, r, first, shift, n_turns)``: for each conversation and range, the first
    ``at``, the turns in earlier ranges, and the turns of the whole conversation."""
    runs = turns.groupBy(F.col("conv_id").alias("c"), F.col("run").alias("r")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("c").orderBy("r")
    earlier, rest = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return materialize(
        runs.select("c", "r", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"), F.sum("n").over(rest).alias("n_turns")), "runs"
    )


def prefix_hashes(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """``(conv_id, ord, n_turns, h1, h2)``: a 128-bit rolling hash of the first ``ord``
    turns of each conversation.

    The hash of a prefix is the running sum, modulo 2^64 each, of two digests of
    (ordinal, role, text); sums of earlier ranges are carried over.
    """
    numbered = turns.join(runs, _same("conv_id", "c") & (F.col("run") == F.col("r")))
    place = F.col("at") - F.col("first") + F.col("shift") + 1
    # decimals hold the sums without overflow
    wide = numbered.select("conv_id", "run", place.alias("ord"), "n_turns", *[F.xxhash64(place, f"e{i}").cast("decimal(20,0)").alias(f"d{i}") for i in (1, 2)])
    within = Window.partitionBy("conv_id", "run").orderBy("ord")
    summed = materialize(wide.select("conv_id", "run", "ord", "n_turns", *[F.sum(f"d{i}").over(within).alias(f"s{i}") for i in (1, 2)]), "sums")
    earlier = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    totals = summed.groupBy(F.col("conv_id").alias("c"), F.col("run").alias("r")).agg(F.max(F.struct("ord", "s1", "s2")).alias("t"))
    carried = totals.select("c", "r", *[F.sum(f"t.s{i}").over(earlier).alias(f"t{i}") for i in (1, 2)]).filter(F.col("t1").isNotNull())
    modulus = F.lit("18446744073709551616").cast("decimal(20,0)")
    whole = lambda i: F.pmod((F.col(f"s{i}") + F.coalesce(f"t{i}", F.lit(0))).cast("decimal(38,0)"), modulus)
    # only conversations of several ranges have anything to carry
    return summed.join(carried, _same("conv_id", "c") & (F.col("run") == F.col("r")), "left").select(
        "conv_id", "ord", "n_turns", *[whole(i).alias(f"h{i}") for i in (1, 2)]
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, copies)`` of the conversations that no other extends.

    ``copies`` counts the equal conversations that ``conv_id``, the smallest of
    them, stands for.
    """
    wholes = prefixes.filter("ord = n_turns").groupBy("ord", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = prefixes.filter("ord < n_turns").select("ord", "h1", "h2").distinct()
    return wholes.join(proper, ["ord", "h1", "h2"], "left_anti").select("conv_id", F.col("ord").alias("n_turns"), "copies")


def render_turn(role: Column, text: Column) -> Column:
    """``<|role|>`` line, the text, ``<|end|>`` line; null as empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def format_chats(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``(conv_id, part, n_turns, copies, rendered)`` of the maximal conversations.

    A conversation is one row, unless it has over ``block_turns`` turns: then its
    parts, numbered from 0, are to be concatenated, so no row has more turns.  Texts
    of any length are kept whole; other columns play no part.
    """
    turns = ordered_turns(conversations)
    runs = conversation_runs(turns)
    kept = maximal_conversations(prefix_hashes(turns, runs)).select(F.col("conv_id").alias("k"), "copies")
    wanted = runs.join(kept, _same("c", "k")).drop("k")
    place = F.col("at") - F.col("first") + F.col("shift")  # from 0
    pieces = turns.join(wanted, _same("conv_id", "c") & (F.col("run") == F.col("r"))).select(
        "conv_id",
        F.floor(place / block_turns).alias("part"),
        "n_turns",
        "copies",
        F.struct("at", render_turn(F.col("role"), F.col("text")).alias("piece")).alias("p"),
    )
    return pieces.groupBy("conv_id", "part", "n_turns", "copies").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("rendered")
    )


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All maximal conversations of ``conversations``, rendered in parts of 256 turns."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = r"""
WITH t AS (SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ord FROM conversations),
l AS (SELECT conv_id, list(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) ORDER BY ord) AS turns FROM t GROUP BY conv_id),
s AS (SELECT conv_id, (ord - 1) // 256 AS part, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY ord) AS rendered
  FROM t GROUP BY conv_id, part),
p AS (SELECT conv_id, k, n, md5(array_to_string(turns[1:k], '')) AS h
  FROM (SELECT conv_id, turns, len(turns) AS n, unnest(range(1, len(turns) + 1)) AS k FROM l)),
w AS (SELECT k, h, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE k = n GROUP BY k, h),
q AS (SELECT DISTINCT k, h FROM p WHERE k < n)
SELECT w.conv_id, part::BIGINT AS part, w.k AS n_turns, copies, rendered
FROM w JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.k = w.k AND q.h = w.h)
"""
