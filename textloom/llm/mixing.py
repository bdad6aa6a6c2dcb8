"""Mixing sources to target weights at exact token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, fresh, q

KEY_BITS = 52
ROWS_A_BUCKET = 4096


def token_count(text: Column) -> Column:
    """White-space separated tokens; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long"), F.lit(0).cast("long"))


def random_key(*parts: Column, seed: str) -> Column:
    """A 52-bit number hashed from the parts' strings and the seed."""
    joined = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("long")


def mix(df: DataFrame, source: str, tokens: str, ident: str, weights: dict[str, int] | None = None, budget: int | None = None, seed: str = "mix") -> DataFrame:
    """Rows of ``df`` drawn so that each source gives exactly its share of ``budget`` tokens.

    A source's budget is ``budget * weight div sum of weights``; ``budget`` is all tokens there are if not
    given, and without ``weights`` each weight is the square root of the source's tokens, rounded down,
    which flattens the mixture. Within a source rows are ordered by a key hashed from source, ``ident``
    and seed (then ident, then tokens), and a running sum over that order is cut at the budget: the row
    on the cut gives only its first tokens. A source smaller than its budget repeats whole epochs first.

    Adds ``epoch`` (from 0), ``start`` (tokens of the source before this row within the epoch) and ``take`` (tokens
    used of this row). Rows of no tokens, a null count or a negative one are dropped, as is a source that
    has no weight (given weights) or no tokens; a null source counts as the source ''. Repeated rows are
    drawn on their own. Equal keys fall back to ident, so the result doesn't depend on partitioning.

    The running sum is distributed: rows are shuffled once by (source, key range), with as many ranges as
    keep about 4,096 rows in each, also of the largest source; sums of ranges, a small table, give each
    range its offset.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "mix")
    s, k, r, n = (fresh(df, x) for x in ("mix_source", "mix_key", "mix_range", "mix_tokens"))
    rows = df.withColumn(s, F.coalesce(q(source).cast("string"), F.lit(""))).withColumn(n, q(tokens).cast("long")).where(q(n) > 0)
    rows = rows.withColumn(k, random_key(q(s), q(ident), seed=seed))
    bins = ws.table(rows.groupBy(q(s).alias("s"), F.shiftright(q(k), KEY_BITS - 20).alias("b")).agg(F.sum(q(n)).alias("n"), F.count("*").alias("c")), "fine-ranges")
    totals = bins.groupBy("s").agg(F.sum("n").alias("total"), F.sum("c").alias("rows"))
    largest = totals.agg(F.max("rows")).first()[0] or 0
    bits = min(20, max(0, (largest // ROWS_A_BUCKET).bit_length()))
    if weights is None:
        weighed = totals.withColumn("w", F.floor(F.sqrt(F.col("total").cast("double"))).cast("decimal(38,0)"))
    else:
        given = spark.createDataFrame([(a, int(w)) for a, w in weights.items() if w > 0], "s string, w long")
        weighed = totals.join(given, "s").withColumn("w", F.col("w").cast("decimal(38,0)"))
    sums = weighed.agg(F.sum("w").cast("decimal(38,0)").alias("sw"), F.sum("total").cast("decimal(38,0)").alias("all_tokens"))
    whole = F.col("all_tokens") if budget is None else F.lit(int(budget)).cast("decimal(38,0)")
    product = (whole * F.col("w")).cast("decimal(38,0)")
    budgets = weighed.crossJoin(sums).select("s", "total", ((product - product % F.col("sw")) / F.col("sw")).cast("decimal(38,0)").cast("long").alias("budget"))
    coarse = F.shiftright("b", 20 - bits).alias("r")
    offsets = bins.groupBy("s", coarse).agg(F.sum("n").alias("n")).withColumn("offset", F.sum("n").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))).join(budgets, "s")
    offsets = ws.table(offsets.select(F.col("s").alias(s), F.col("r").alias(r), F.coalesce("offset", F.lit(0)).alias("mix_offset"), "total", "budget"), "offsets")
    inner = Window.partitionBy(q(s), q(r)).orderBy(q(k), q(ident), q(n)).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: fresh(df, "mix_" + c) for c in ("offset", "total", "budget")}
    offsets = offsets.toDF(s, r, *names.values())
    begin = fresh(df, "mix_begin")
    placed = rows.withColumn(r, F.shiftright(q(k), KEY_BITS - bits)).join(offsets, [s, r])
    placed = placed.withColumn(begin, F.coalesce(F.sum(q(n)).over(inner), F.lit(0)) + q(names["offset"]))
    total, target = q(names["total"]), q(names["budget"])
    full, rest = F.expr(f"`{names['budget']}` div `{names['total']}`"), target % total
    times = full + F.when(q(begin) < rest, 1).otherwise(0)
    e, st, tk = (fresh(df, x) for x in ("epoch", "start", "take"))
    placed = placed.where(times > 0).withColumn(e, F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return placed.select(*(q(c) for c in df.columns), q(e), q(begin).alias(st), F.when(q(e) < full, q(n)).otherwise(F.least(q(n), rest - q(begin))).alias(tk))
