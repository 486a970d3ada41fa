"""Temperature mixing of sources under a repetition limit, realised as budgeted blocks of shuffled documents.

Source token shares p are raised to an exponent a in [0, 1] and normalised to weights. Lower exponents raise the
entropy of the mix and repeat small sources more; both are monotone in a, so the exponent is bisected: the largest
that reaches the target entropy, then raised where needed until no source is read more often than the limit. The
budget reads the most favoured-against source exactly once, so no document is left out.

A source's stream is its documents in a hash permutation, one permutation for each time through, cut at the
source's budget. A row's offset in that stream, as a share of the budget, gives its block, so each block holds
each source in its weight; rows of a block are permuted once more. Offsets are prefix sums over hash buckets
(bucket totals first, then inside each bucket), so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm._shared import col, materialize, partitions, whole_row

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS, FAN = 6, 33  # each round narrows the bracket by FAN - 1: 32 ** -6 is below 1e-9
DIGITS = 6  # the exponent is rounded, so that engines agree on it


class Mix(NamedTuple):
    exponent: float
    weights: DataFrame  # skey, n_tokens, weight, budget
    blocks: int


def _key(column: str):
    return F.when(col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), col(column).cast("string")))


def _row(id_col: str, text_col: str, source_col: str):
    """A hash of what tells rows apart: id, text and source. Rows that share one only trade places in the mix."""
    return F.xxhash64(col(id_col).isNull(), col(id_col).cast("string"), col(text_col), _key(source_col))


def tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keyed: bool = False) -> DataFrame:
    """Store and return ``__id, __name, skey, n_tokens``: words of each text, 1 at least so that every row has a place.

    keyed: ``__row``, a hash of id, text and source, in place of the id.
    """
    counted = F.greatest(F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)), F.lit(1)).cast("long")
    # what a row is dealt by: its id, and without one its text, so that such rows are spread too
    name = F.coalesce(col(id_col).cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(col(text_col).cast("binary"), F.lit(b"")))))
    own = _row(id_col, text_col, source_col).alias("__row") if keyed else col(id_col).alias("__id")
    return materialize(docs.select(own, name.alias("__name"), _key(source_col).alias("skey"), counted.alias("n_tokens")), "mix-tokens")


def _bisect(shares: DataFrame, wanted: str, falling: bool) -> float:
    """The exponent where ``wanted``, a condition that holds on one side only, begins or ceases to hold.

    Each round evaluates FAN exponents in one aggregation over the sources; only those FAN sums reach the driver.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / (FAN - 1) for i in range(FAN)]
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(grid)]))
        sums = (
            shares.select("p", at.alias("g")).select("p", "g.i", "g.a")
            .groupBy("i", "a").agg(F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.log("p")).alias("zl"), F.min("p").alias("least"), F.max("p").alias("most"), F.count(F.lit(1)).alias("n"))
            .withColumn("entropy", F.log("z") - F.col("a") * F.col("zl") / F.col("z"))
            .withColumn("repeats", F.pow(F.col("most") / F.col("least"), 1 - F.col("a")))
        )
        holds = {i for (i,) in sums.where(wanted).select("i").collect()}
        if falling:  # holds for small exponents: the last that does
            k = max(holds, default=0)
            low, high = grid[k], grid[min(k + 1, FAN - 1)]
        else:  # holds for large exponents: the first that does
            k = min(holds, default=FAN - 1)
            low, high = grid[max(k - 1, 0)], grid[k]
    return low if falling else high


def solve(counted: DataFrame, *, entropy_share: float, repetition_limit: float, block_tokens: int) -> Mix:
    """The exponent, weights and token budgets. entropy_share: of log(number of sources), the target entropy."""
    by_source = counted.groupBy("skey").agg(F.sum("n_tokens").alias("n_tokens"))
    by_source = materialize(by_source, "mix-sources")
    total = by_source.agg(F.sum("n_tokens")).first()[0]
    if total is None:
        return Mix(1.0, by_source.selectExpr("skey", "n_tokens", "0D as weight", "0L as budget"), 1)
    shares = by_source.withColumn("p", F.col("n_tokens") / F.lit(float(total)))
    spread = _bisect(shares, f"entropy >= {entropy_share!r}D * ln(n) - 1e-12D", True)
    calm = _bisect(shares, f"repeats <= {repetition_limit!r}D", False)
    exponent = max(math.floor(spread * 10**DIGITS) / 10**DIGITS, math.ceil(calm * 10**DIGITS) / 10**DIGITS)
    z, most = shares.agg(F.sum(F.pow("p", F.lit(exponent))), F.max("p")).first()
    # weight * budget / tokens is 1 for the largest source and larger for all others
    budget = F.round(F.lit(float(total)) * F.lit(most ** (1 - exponent)) * F.pow("p", F.lit(exponent))).cast("long")
    weights = shares.select("skey", "n_tokens", (F.pow("p", F.lit(exponent)) / F.lit(z)).alias("weight"), F.greatest(budget, F.col("n_tokens")).alias("budget"))
    asked = weights.agg(F.sum("budget")).first()[0]
    return Mix(exponent, weights, max(1, -(-asked // block_tokens)))


def mix(docs: DataFrame, *, entropy_share: float = 0.95, repetition_limit: float = 2.0, block_tokens: int = 100_000, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Return ``id_col, source_col, copy, n_tokens, block, slot``: the mixed stream, a row for each reading of a document.

    copy: 1 for the first reading; every row of docs is read at least once, and no source over repetition_limit times
    on average. block: from 0; slot: gapless from 0 in its block; reading blocks and slots in order is the stream. A
    null source is a source of its own; null and empty texts count one token; repeated rows are mixed as rows of their
    own; an empty table gives an empty result; other columns of docs are ignored.
    """
    placed = _place(tokens(docs, id_col=id_col, text_col=text_col, source_col=source_col), "__id", entropy_share, repetition_limit, block_tokens, seed)
    source = F.when(F.col("skey") != "-", F.expr("substring(skey, 2)")).cast(docs.schema[source_col].dataType)
    return placed.select(F.col("__id").alias(id_col), source.alias(source_col), "copy", "n_tokens", "block", "slot")


def _place(counted: DataFrame, own: str, entropy_share: float, repetition_limit: float, block_tokens: int, seed: str) -> DataFrame:
    """A row for each reading of each row of counted: own (the column that names a row), ``skey, copy, n_tokens, block, slot, blocks``."""
    plan = solve(counted, entropy_share=entropy_share, repetition_limit=repetition_limit, block_tokens=block_tokens)
    sources = plan.weights.select("skey", F.col("n_tokens").alias("__all"), "budget")
    copies = F.explode(F.sequence(F.lit(1), F.ceil(F.col("budget") / F.col("__all")).cast("int")))
    n = partitions(counted.sparkSession)
    # as many buckets as there are partitions: each holds its share of every source
    bucket = F.pmod(F.conv(F.substring("__md5", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32), F.lit(n))
    read = (
        counted.join(sources, "skey").select(own, "__name", "skey", "n_tokens", copies.alias("copy"))
        .withColumn("__md5", F.md5(F.concat_ws(":", F.lit(seed), "__name", F.col("copy").cast("string"))))
        .select(own, "skey", "n_tokens", "copy", F.unhex("__md5").alias("__h"), F.floor(bucket).cast("int").alias("__bucket"))
    )
    group = ["skey", "copy", "__bucket"]
    totals = read.groupBy(*group).agg(F.sum("n_tokens").alias("__sum"))
    earlier = Window.partitionBy("skey", "copy").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group).orderBy("__h", own, "n_tokens")
    offset = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        read.withColumn("__offset", offset).join(totals, group).join(sources, "skey")
        .withColumn("__start", F.col("__before") + F.col("__offset") + (F.col("copy") - 1) * F.col("__all")).where("__start < budget")
        .select(own, "skey", "copy", "n_tokens", "__h", block_of("__start", "budget", plan.blocks).alias("block"))
    )
    within = Window.partitionBy("block").orderBy("__h", "skey", own, "n_tokens")
    return placed.select(own, "skey", "copy", "n_tokens", "block", (F.row_number().over(within) - 1).cast("long").alias("slot"), F.lit(plan.blocks).cast("long").alias("blocks"))


def block_of(start: str, budget: str, blocks: int):
    """The block of a token offset in a source's budget; the product is a decimal, as it passes 64 bits from 1e12 tokens on."""
    return F.expr(f"(cast({start} as decimal(20, 0)) * cast({blocks}L as decimal(18, 0))) div cast({budget} as decimal(20, 0))")


def apply_mix(docs: DataFrame, *, entropy_share: float = 0.95, repetition_limit: float = 2.0, block_tokens: int = 100_000, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Return the rows of docs as ``mix`` reads them, each as often as it is read, in order of block and slot.

    The result is partitioned by runs of blocks and sorted, so files written of it hold the stream in order of their number.
    Rows that share an id are told apart by their text, and rows equal in id, text and source are read one by one.
    """
    placed = _place(tokens(docs, id_col=id_col, text_col=text_col, source_col=source_col, keyed=True), "__row", entropy_share, repetition_limit, block_tokens, seed)
    # equal rows are numbered on both sides
    readings = placed.select(F.col("__row").alias("__key"), "copy", "block", "slot", "blocks").withColumn("__nth", F.row_number().over(Window.partitionBy("__key", "copy").orderBy("block", "slot"))).drop("copy")
    rows = docs.select(_row(id_col, text_col, source_col).alias("__key"), whole_row(docs)).withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))
    n = partitions(docs.sparkSession)
    joined = rows.join(readings, ["__key", "__nth"]).select("block", "slot", "blocks", "__row")
    return joined.repartitionById(n, F.expr(f"cast((block * {n}) div blocks as int)")).sortWithinPartitions("block", "slot").select("__row.*")
