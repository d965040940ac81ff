"""Temperature mixing of sources, in DataFrame operations only.

A source's weight is its share of tokens to the power a, normalised; a is bisected so that the mix has a target
entropy, and raised as far as needed for no source to be repeated more than ``max_repeats`` times. A source's budget
is its weight of all tokens: whole passes over its rows, then a prefix of a keyed random permutation. The permutation
goes by blocks: 1024 by one hash, 1024 in each by another; sums of blocks place the end of the budget in one inner block,
and only that block's rows are ordered. So a source with a third of all rows costs no task more than a 1,048,576th of
them. Tokens are words, ``[^\\x20\\x09-\\x0D]+``.

Defined cases: rows without a source are a source of their own; a null or empty text has no tokens; a source without
tokens keeps its rows once; equal rows may be told apart by nothing, so they are taken in turn; an empty table stays
empty; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import discard, fresh, keep, quoted

BLOCKS = 1024
GRID = 64
#: Sources up to this many are broadcast (a row each, well under 10 MB); beyond it the join is salted.
BROADCAST_SOURCES = 50_000
SALTS = 64
#: Entropy aimed at, between that of the sources as they are (0) and that of equal shares (1).
EVENNESS = 0.5
MAX_REPEATS = 4.0
WHITE = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def _prepared(docs: DataFrame, seed: int) -> DataFrame:
    """The rows as one column, so that no name of theirs clashes, and what the plan needs of them."""
    return docs.select(
        F.struct(*quoted(docs.columns)).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_src"),
        n_words(F.col("text")).alias("_tok"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text")).alias("_h"),
    ).withColumns({
        "_d1": F.pmod(F.col("_h"), F.lit(BLOCKS)).cast("int"),
        "_d2": F.pmod(F.shiftrightunsigned("_h", 20), F.lit(BLOCKS)).cast("int"),
    })


def _entropy_and_repeats(sources: DataFrame, exponents: list[float], total: int) -> list[tuple[float, float, float]]:
    """(exponent, entropy of the mix, most repetitions of a source) for each exponent; three numbers each come back."""
    p = F.col("tokens") / F.lit(float(total))
    e = sources.where("tokens > 0").withColumn("a", F.explode(F.array(*[F.lit(float(x)) for x in exponents])))
    q = F.pow(p, F.col("a"))
    rows = e.groupBy("a").agg(F.sum(q).alias("z"), F.sum(q * F.log(q)).alias("qlogq"), F.max(F.pow(p, F.col("a") - 1)).alias("r")).collect()
    return sorted((r.a, math.log(r.z) - r.qlogq / r.z, r.r / r.z) for r in rows)


def exponent(sources: DataFrame, total: int, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS, rounds: int = 4) -> float:
    """Bisection in parallel: each round cuts the bracket into ``GRID`` parts. Entropy falls and repetitions fall as
    the exponent rises from 0 to 1; the result is the smallest exponent with no more than the target entropy and no
    more than the allowed repetitions."""
    ends = _entropy_and_repeats(sources, [0.0, 1.0], total)
    if not ends:
        return 1.0
    target = ends[1][1] + evenness * (ends[0][1] - ends[1][1])
    fits = lambda h, r: h <= target + 1e-12 and r <= max_repeats + 1e-12
    if fits(*ends[0][1:]):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / GRID for i in range(1, GRID)]
        for a, h, r in _entropy_and_repeats(sources, grid, total):
            if fits(h, r):
                high = min(high, a)
            else:
                low = max(low, a)
    return high


def _join(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "_src")
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(SALTS)).cast("int")).join(salted, ["_src", "_salt"]).drop("_salt")


def _end(sums: DataFrame, block: str, rest: str) -> DataFrame:
    """(_src, end block, tokens left for it): the first block that the rest of the budget doesn't cover."""
    order = Window.partitionBy("_src").orderBy(block)
    upto = sums.withColumn("_upto", F.sum("t").over(order))
    over = upto.where(F.col("_upto") > F.col(rest))
    return over.groupBy("_src").agg(F.min(F.struct(F.col(block), (F.col(rest) - F.col("_upto") + F.col("t")).alias("left"))).alias("_e")).select(
        "_src", F.col(f"_e.{block}").alias(f"_end{block}"), F.col("_e.left").alias(f"_left{block}")
    )


def _planned(docs: DataFrame, evenness: float, max_repeats: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(_row, _tok, copies) and the table of sources."""
    base = _prepared(docs, seed)
    light = keep(base.groupBy("_src", "_d1").agg(F.sum("_tok").alias("t"), F.count("*").alias("n")), "mix-blocks")
    sources = keep(light.groupBy("_src").agg(F.sum("t").alias("tokens"), F.sum("n").alias("n")), "mix-sources")
    total, n_sources = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    a = exponent(sources, total, evenness, max_repeats) if total else 1.0
    q = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))
    z = sources.where("tokens > 0").agg(F.sum(q)).first()[0] or 1.0
    budget = F.when(F.col("tokens") > 0, F.floor(q / F.lit(z) * F.lit(float(total)) + 0.5)).otherwise(F.lit(0)).cast("long")
    goal = sources.select(
        "_src", "tokens", "n", budget.alias("budget"), (F.when(F.col("tokens") > 0, q / F.lit(z)).otherwise(0.0)).alias("weight"),
        F.when(F.col("tokens") > 0, F.floor(budget / F.col("tokens"))).otherwise(1).cast("long").alias("_full"),
        F.when(F.col("tokens") > 0, budget % F.col("tokens")).otherwise(-1).cast("long").alias("_rest"),
    )
    end1 = _end(light.join(goal.select("_src", "_rest"), "_src"), "_d1", "_rest")
    goal = goal.join(end1, "_src", "left")
    inner = _join(base.select("_src", "_d1", "_d2", "_h", "_tok"), goal.select("_src", "_end_d1", "_left_d1"), n_sources).where("_d1 = _end_d1")
    end2 = _end(inner.groupBy("_src", "_d2", "_left_d1").agg(F.sum("_tok").alias("t")), "_d2", "_left_d1")
    goal = keep(goal.join(end2, "_src", "left"), "mix-goal")
    rows = _join(base, goal.select("_src", "_full", "_rest", "_end_d1", "_end_d2", "_left_d2"), n_sources)
    edge = (F.col("_d1") == F.col("_end_d1")) & (F.col("_d2") == F.col("_end_d2"))
    before = (F.col("_d1") < F.col("_end_d1")) | ((F.col("_d1") == F.col("_end_d1")) & (F.col("_d2") < F.col("_end_d2")))
    clear = rows.where(~F.coalesce(edge, F.lit(False))).withColumn("copies", F.col("_full") + F.coalesce(before, F.lit(False)).cast("long"))
    order = Window.partitionBy("_src").orderBy("_h", F.col("_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    close = rows.where(edge).withColumn("copies", F.col("_full") + (F.sum("_tok").over(order) <= F.col("_left_d2")).cast("long"))
    out = clear.unionByName(close).select("_row", "_tok", "copies")
    discard(light)
    discard(sources)
    return out, goal


def plan(docs: DataFrame, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_tok`` (tokens) and ``copies`` (how often the mix has the row), and the table of sources. Where
    ``docs`` has these names, underscores are put behind them."""
    rows, goal = _planned(docs, evenness, max_repeats, seed)
    return rows.select("_row.*", F.col("_tok").alias(fresh("_tok", docs.columns)), F.col("copies").alias(fresh("copies", docs.columns))), goal


def mix(docs: DataFrame, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS, seed: int = 11) -> DataFrame:
    """The mixed corpus: each row as often as the mix has it, with the columns of ``docs``."""
    rows, _ = _planned(docs, evenness, max_repeats, seed)
    again = rows.where("copies > 0").withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select("_row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row of ``documents``: its source, its tokens and how often the mix has it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows, _ = plan(docs)
    return rows.select("doc_id", "source", F.col("_tok").alias("n_tokens"), "copies")
