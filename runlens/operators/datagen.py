"""Deterministic parallel data generation.

Row i of a data set depends on the seed and i only. Inverse-CDF sampling of a skewed distribution is
an equi-join on equal-width slices of (0, 1) instead of a range join; the CDF is a table of as many
rows as the distribution has values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from runlens.functions.ranhash import DEFAULT_SEED, with_uniform

# Word lengths and alphabet of the random dictionary.
MIN_LENGTH, MAX_LENGTH, ALPHABET = 2, 16, 26
LENGTH_CHOICES = MAX_LENGTH - MIN_LENGTH - 1
LONGEST = MIN_LENGTH + LENGTH_CHOICES - 1
DRAWS_PER_WORD = ALPHABET + 1

# Up to this size a dictionary or CDF is joined; rows are at most about 50 bytes.
MAX_TABLE = 1_000_000
_PREFIX_BLOCK = 4096


def row_numbers(spark: SparkSession, tasks: int, rows_per_task: int) -> DataFrame:
    """The sequence 1 .. tasks * rows_per_task in ``tasks`` partitions."""
    return spark.range(1, tasks * rows_per_task + 1, numPartitions=tasks)


# -- dictionary ------------------------------------------------------------------------------


def dictionary(spark: SparkSession, size: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """(index, word) for 0 .. size-1.

    A word starts at draw 27 * index: one draw for its length (2 .. 14), then one per letter. Each
    draw is a row; a word gathers at most 15 of them.
    """
    draws = spark.range(size).select(F.col("id").alias("index"), F.explode(F.sequence(F.lit(0), F.lit(LONGEST))).alias("j"))
    draws = with_uniform(draws, F.col("index") * DRAWS_PER_WORD + F.col("j"), "u", seed)
    letter = F.char(F.floor(F.col("u") * ALPHABET) + F.lit(ord("a")))
    length = F.max(F.when(F.col("j") == 0, F.floor(F.col("u") * LENGTH_CHOICES) + MIN_LENGTH))
    letters = F.sort_array(F.collect_list(F.when(F.col("j") > 0, F.struct("j", letter.alias("c")))))
    words = draws.groupBy("index").agg(length.cast("int").alias("n"), letters.alias("letters"))
    return words.select("index", F.array_join(F.slice(F.col("letters.c"), F.lit(1), F.col("n")), "").alias("word"))


# -- distributions over 0 .. k-1 ---------------------------------------------------------------


def uniform_index(u: Column, k: int) -> Column:
    """Smallest index whose cumulative probability reaches u."""
    return F.greatest(F.ceil(u * k) - 1, F.lit(0)).cast("int")


def _cdf(weights: DataFrame) -> DataFrame:
    """(index, lo, hi] intervals from (index, w); prefix sums by block, then inside each block."""
    blocks = weights.withColumn("__b", F.floor(F.col("index") / _PREFIX_BLOCK))
    sums = blocks.groupBy("__b").agg(F.sum("w").alias("__s"))
    everything = Window.orderBy("__b")  # one row per 4096 values
    offsets = sums.select(
        "__b",
        F.coalesce(F.sum("__s").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__o"),
        F.sum("__s").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__t"),
    )
    inside = Window.partitionBy("__b").orderBy("index")
    cum = blocks.join(offsets, "__b").select(
        "index", "__b", "__t",
        (F.col("__o") + F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("__c"),
        F.col("__o"),
    )
    last = cum.select(
        "index",
        (F.coalesce(F.lag("__c").over(inside), F.col("__o")) / F.col("__t")).alias("lo"),
        (F.col("__c") / F.col("__t")).alias("hi"),
    )
    return last


def zipf_cdf(spark: SparkSession, k: int, exponent: float) -> DataFrame:
    """Probability of index i is proportional to (i+1) ** -exponent."""
    index = spark.range(k).withColumnRenamed("id", "index")
    return _cdf(index.withColumn("w", F.pow(F.col("index") + 1.0, F.lit(-float(exponent)))))


def binomial_cdf(spark: SparkSession, k: int, p: float) -> DataFrame:
    """Successes in k-1 trials, by log-factorials summed over the index range."""
    n = k - 1
    index = spark.range(k).withColumnRenamed("id", "index")
    if p in (0.0, 1.0):
        return _cdf(index.withColumn("w", (F.col("index") == (n if p else 0)).cast("double")))
    logs = index.withColumn("w", F.when(F.col("index") > 0, F.ln(F.greatest("index", F.lit(1)))).otherwise(0.0))
    blocks = logs.withColumn("__b", F.floor(F.col("index") / _PREFIX_BLOCK))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("__b").agg(F.sum("w").alias("__s")).select(
        "__b", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__o")
    )
    upto = Window.partitionBy("__b").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    fact = blocks.join(offsets, "__b").select("index", (F.col("__o") + F.sum("w").over(upto)).alias("lf"))
    mirror = fact.select((F.lit(n) - F.col("index")).alias("index"), F.col("lf").alias("lf_rest"))
    log_pmf = (
        F.lit(_log_factorial(n)) - F.col("lf") - F.col("lf_rest")
        + F.col("index") * F.ln(F.lit(p)) + (F.lit(n) - F.col("index")) * F.ln(F.lit(1.0 - p))
    )
    return _cdf(fact.join(mirror, "index").select("index", F.exp(log_pmf).alias("w")))


def _log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


def with_sampled_index(df: DataFrame, cdf: DataFrame, k: int, u: str = "u", out: str = "index") -> DataFrame:
    """Add the smallest index whose CDF reaches ``u``: lo < u <= hi.

    (0, 1) is cut into ``k`` slices and every interval is repeated for the slices it touches, at
    most 2k rows in all. The CDF side is broadcast while k is small enough.
    """
    slices = max(1, min(k, MAX_TABLE))
    # the sums may end a rounding error beside 1
    total = cdf.withColumn("hi", F.when(F.col("index") == k - 1, F.lit(1.0)).otherwise(F.col("hi")))
    spans = total.where(F.col("hi") > F.col("lo")).select(
        F.col("index").cast("int").alias(out),
        F.col("lo").alias("__lo"),
        F.col("hi").alias("__hi"),
        F.explode(
            F.sequence(
                F.floor(F.col("lo") * slices),
                F.greatest(F.floor(F.col("lo") * slices), F.least(F.floor(F.col("hi") * slices), F.lit(slices - 1))),
            )
        ).alias("__slice"),
    )
    side = F.broadcast(spans) if k <= MAX_TABLE else spans
    at = F.least(F.floor(F.col(u) * slices), F.lit(slices - 1))
    joined = df.withColumn("__at", at).join(
        side, (F.col("__at") == F.col("__slice")) & (F.col(u) > F.col("__lo")) & (F.col(u) <= F.col("__hi"))
    )
    return joined.drop("__at", "__slice", "__lo", "__hi")


# -- data sets -------------------------------------------------------------------------------


def with_distribution(
    df: DataFrame, k: int, distribution: str = "uniform", parameter: float = 1.0, u: str = "u", out: str = "index"
) -> DataFrame:
    """Sampled index by ``uniform``, ``binomial`` (success probability) or ``zipf`` (exponent)."""
    if distribution == "uniform":
        return df.withColumn(out, uniform_index(F.col(u), k))
    if distribution == "binomial":
        return with_sampled_index(df, binomial_cdf(df.sparkSession, k, parameter), k, u, out)
    if distribution == "zipf":
        return with_sampled_index(df, zipf_cdf(df.sparkSession, k, parameter), k, u, out)
    raise ValueError(f"unknown distribution {distribution!r}")


def with_sampled_word(
    df: DataFrame, i: str, dictionary_size: int, distribution: str = "uniform", parameter: float = 1.0,
    seed: int = DEFAULT_SEED, out: str = "word",
) -> DataFrame:
    """The word of row number ``i``.

    Row i draws once, from a generator seeded with seed + i. The dictionary is broadcast up to
    ``MAX_TABLE`` words and joined by shuffle beyond, where AQE splits words that are drawn often.
    """
    df = with_uniform(df, F.col(i), "__u", seed)
    df = with_distribution(df, dictionary_size, distribution, parameter, "__u", "__index").drop("__u")
    words = dictionary(df.sparkSession, dictionary_size, seed).select(
        F.col("index").cast("int").alias("__index"), F.col("word").alias(out)
    )
    side = F.broadcast(words) if dictionary_size <= MAX_TABLE else words
    return df.join(side, "__index").drop("__index")


def generate_words(
    spark: SparkSession, tasks: int, rows_per_task: int, dictionary_size: int,
    distribution: str = "uniform", parameter: float = 1.0, seed: int = DEFAULT_SEED,
) -> DataFrame:
    rows = row_numbers(spark, tasks, rows_per_task)
    return with_sampled_word(rows, "id", dictionary_size, distribution, parameter, seed).select("word")


def with_key_value(
    df: DataFrame, i: str, keys: int, distribution: str = "uniform", parameter: float = 1.0,
    values: int = 1_000_000, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Key by distribution, value one of ``values`` strings of 10 .. 20 letters.

    A value is spelled from its number: its length and letters are draws of that number's own
    stretch of the sequence, so equal numbers give equal strings on every task.
    """
    df = with_uniform(df, F.col(i) * 2, "__uk", seed)
    df = with_uniform(df, F.col(i) * 2 + 1, "__uv", seed)
    df = with_distribution(df, keys, distribution, parameter, "__uk", "k")
    df = df.withColumns({"k": F.col("k").cast("long"), "__n": uniform_index(F.col("__uv"), values).cast("long")})
    df = with_uniform(df, F.col("__n") * 3, "__ul", seed + 1)
    df = with_uniform(df, F.col("__n") * 3 + 1, "__ua", seed + 1)
    df = with_uniform(df, F.col("__n") * 3 + 2, "__ub", seed + 1)
    length = (F.floor(F.col("__ul") * 11) + 10).cast("int")
    # two draws hold 20 letters: 10 hexadecimal digits each, moved into the letters a .. p
    digits = F.concat(*[F.lpad(F.lower(F.hex(F.floor(F.col(c) * (1 << 40)))), 10, "0") for c in ("__ua", "__ub")])
    text = F.translate(digits, "0123456789abcdef", "abcdefghijklmnop")
    return df.withColumn("v", F.substring(text, F.lit(1), length)).drop("__uk", "__uv", "__n", "__ul", "__ua", "__ub")
