"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are powers of the sources' token shares. Each source is then passed through in epochs; every epoch deals its
documents into blocks and takes the blocks in an order of its own, until the source's budget is spent. A document's
block and place come from hashes, so a task decides about a row by comparing it with one cut point of its source:
no source is sorted or gathered, and one that holds a third of all rows is spread like any other. Sources stay a table,
however many there are: each step of the bisection is one aggregate over it, and only sums come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agendum.llm import common

#: Exponents that one aggregate tries, and how often the interval between two of them is cut again (8 bits each time).
TRIED, STEPS = 256, 6


@dataclass(frozen=True)
class Tempered:
    """Sums over the sources with tokens at one exponent: of shares to its power, and of those times the logs of the shares."""

    alpha: float
    powers: float
    logs: float

    @property
    def entropy(self) -> float:
        return log(self.powers) - self.alpha * self.logs / self.powers


@dataclass(frozen=True)
class Plan:
    """The exponent, the tokens to be spent, and the sum of all shares to its power; a source's weight is share**alpha / powers."""

    alpha: float
    tokens: int
    powers: float


def find_plan(sources: DataFrame, budget: int | None = None, target_entropy: float | None = None, repetition_limit: float | None = None) -> Plan:
    """The plan for a table of sources (tokens: long).

    target_entropy is a share of log(number of sources with tokens): alpha is the largest exponent in [0, 1] that reaches
    it. repetition_limit is how often a source may be passed through: alpha is then raised, if need be, to the smallest
    exponent that keeps to it, so the limit goes before the entropy. budget: tokens in all; without one, as many as give
    every source one whole pass at least. A limit below budget / tokens cannot be met, and alpha 1 comes nearest.
    """
    some = sources.filter("tokens > 0").select("tokens")
    n, total, least, most = some.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return Plan(1.0, 0, 1.0)
    share = F.log(F.col("tokens") / F.lit(float(total)))

    def tried(low: float, high: float) -> list[Tempered]:
        """At TRIED + 1 exponents from low to high, in one job."""
        rows = some.select(share.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(TRIED))).alias("i"))
        power = F.exp((F.lit(low) + F.lit((high - low) / TRIED) * F.col("i")) * F.col("x"))
        found = rows.groupBy("i").agg(F.sum(power).alias("powers"), F.sum(power * F.col("x")).alias("logs")).collect()  # a row for each exponent
        return [Tempered(low + (high - low) / TRIED * i, *sums) for i, *sums in sorted(found)]

    def largest(holds) -> tuple[Tempered, Tempered]:
        """The largest exponent found for which holds is true, as it is from 0 up to some exponent, and the next one tried."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            at = tried(low, high)
            if holds(at[-1]):
                return at[-1], at[-1]
            i = max((i for i, t in enumerate(at) if holds(t)), default=0)
            low, high = at[i].alpha, at[i + 1].alpha
        return at[i], at[i + 1]

    def spent(t: Tempered) -> int:
        # The largest source needs most tokens in all until its weight gives it a whole pass.
        return budget if budget is not None else ceil(total * t.powers * (most / total) ** (1 - t.alpha) - 1e-6)

    def passes(t: Tempered) -> float:
        """How often the smallest source is passed through; no other is more often, as exponents are 1 at most."""
        return spent(t) / (total * t.powers) * (least / total) ** (t.alpha - 1)

    best = Tempered(1.0, 1.0, 0.0)
    if target_entropy is not None and n > 1:
        goal = target_entropy * log(n)
        best = largest(lambda t: t.entropy >= goal)[0]
    if repetition_limit is not None and passes(best) > repetition_limit:
        best = largest(lambda t: passes(t) > repetition_limit)[1]  # passes fall as alpha grows
    return Plan(best.alpha, spent(best), best.powers)


def token_count(text: Column) -> Column:
    """Words (runs without ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", budget: int | None = None, target_entropy: float | None = 0.9,
    repetition_limit: float | None = 2.0, block_tokens: int = 100_000, max_blocks: int = 65_536, seed: int = 0, most_sent: int = 10_000,
) -> DataFrame:
    """docs with each row as often as the mix takes it, and mix_epoch (from 0), mix_block and mix_place.

    Within a source, rows ordered by mix_epoch, mix_block and mix_place are its permutation. An epoch takes every row
    once; the last takes rows in that order while all up to there fit in what is left of the budget, so budgets are
    never passed and missed by less than one row. A source's budget is its weight of all tokens, cut to whole tokens.
    Tokens are words. Null sources are one source; sources and rows without tokens cost nothing; a source without any is
    taken once, or left out where a budget is given; equal rows take equal places and stay together; columns of the added
    names are replaced; an empty table stays empty. A table of most_sent sources at most is broadcast; of a larger one
    the sources with the most rows are, and rows of the others meet theirs by a shuffle.
    """
    kept = common.without(docs, ["mix_epoch", "mix_block", "mix_place"])
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    named, value = F.col(f"`{source}`").cast("string"), F.col(f"`{text}`").cast("string")
    name = F.when(named.isNull(), "-").otherwise(F.concat(F.lit("+"), named)).alias("mix_source")  # a key that is never null
    unit = F.xxhash64(F.struct(F.col(f"`{key}`").cast("string"), F.xxhash64(value))).alias("unit")

    with common.scope():
        slim = common.stored(docs.select(name, unit, token_count(value).alias("tokens")), "mix")
        sources = common.stored(slim.groupBy("mix_source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "sources")
        n_rows, n_sources = slim.count(), sources.count()
        made = find_plan(sources, budget, target_entropy, repetition_limit)
        share = F.exp(F.lit(made.alpha) * F.log(F.col("tokens") / sources.agg(F.sum("tokens")).first()[0])) if made.tokens else F.lit(0.0)
        due = F.floor(F.lit(float(made.tokens)) * share / F.lit(made.powers) + F.lit(1e-6)).cast("long")
        plans = sources.withColumn("due", F.when(F.col("tokens") > 0, due).otherwise(0))
        once = F.lit(0 if budget is not None else 1)  # of sources without tokens
        plans = plans.select(
            "mix_source", "n", F.when(F.col("tokens") > 0, F.expr("due div tokens")).otherwise(once).cast("long").alias("epochs"),
            F.when(F.col("tokens") > 0, F.col("due") % F.col("tokens")).otherwise(0).cast("long").alias("rest"),
            F.least(F.lit(max_blocks), F.greatest(F.lit(1), F.expr(f"tokens div {block_tokens}"))).cast("long").alias("blocks"),
        )
        plans = common.stored(plans, "plans")

        def met(rows: DataFrame, of_sources: DataFrame) -> DataFrame:
            """rows with what stands in a table of the sources (mix_source, n)."""
            if n_sources <= most_sent:
                return rows.join(F.broadcast(of_sources.drop("n")), "mix_source")
            return common.join_hot(rows, of_sources, "mix_source", n_rows, most_sent)

        def placed(unit: Column, epoch: Column) -> dict[str, Column]:
            block = F.pmod(F.xxhash64(F.lit(seed), epoch, unit), F.col("blocks"))
            return {"mix_block": F.xxhash64(F.lit(seed + 1), epoch, block), "mix_place": F.xxhash64(F.lit(seed + 2), epoch, unit)}

        # The last epoch's cut point: the block where the budget ends, and the last place in it that fits.
        last = met(slim, plans.filter("rest > 0")).withColumns(placed(F.col("unit"), F.col("epochs")))
        blocks = last.groupBy("mix_source", "mix_block").agg(F.sum("tokens").alias("m"), F.first("rest").alias("rest"))
        order = Window.partitionBy("mix_source").orderBy("mix_block")  # max_blocks rows of a source at most
        blocks = blocks.withColumn("before", F.sum("m").over(order) - F.col("m"))
        ends = blocks.filter("before <= rest and before + m > rest").select("mix_source", F.col("mix_block").alias("cut_block"), (F.col("rest") - F.col("before")).alias("room"))
        ends = common.stored(ends.join(plans.select("mix_source", "n"), "mix_source"), "ends")
        inside = met(last.select("mix_source", "mix_block", "mix_place", "tokens"), ends).filter("mix_block = cut_block")
        within = Window.partitionBy("mix_source").orderBy("mix_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # one block of a source
        fits = inside.withColumn("upto", F.sum("tokens").over(within)).filter("upto <= room").groupBy("mix_source").agg(F.max("mix_place").alias("cut_place"))
        cuts = plans.withColumn("more", F.col("rest") > 0).drop("rest").join(ends.select("mix_source", "cut_block"), "mix_source", "left").join(fits, "mix_source", "left")
        cuts = common.keep(common.stored(cuts.filter("epochs > 0 or more"), "cuts"))

    own = {c: f"c{i}" for i, c in enumerate(kept)}
    rows = met(docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()], unit, name), cuts)
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - F.when(F.col("more"), 0).otherwise(1))))
    rows = rows.withColumns(placed(F.col("unit"), F.col("mix_epoch")))
    taken = (F.col("mix_epoch") < F.col("epochs")) | (F.col("mix_block") < F.col("cut_block")) | ((F.col("mix_block") == F.col("cut_block")) & (F.col("mix_place") <= F.col("cut_place")))
    return rows.filter(F.coalesce(taken, F.lit(False))).select(*[F.col(o).alias(c) for c, o in own.items()], F.col("mix_epoch").cast("int").alias("mix_epoch"), "mix_block", "mix_place")
