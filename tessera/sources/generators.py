"""Seeded synthetic relations. Values are hashes of the row number, so every run and partitioning gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform01(seed: int, *cols: str) -> Column:
    """A number in [0, 1) from 53 bits of the columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(2**53))


def primary_key(spark: SparkSession, rows: int, percent: int = 100, seed: int = 1) -> DataFrame:
    """pos and key: the keys 0..rows-1 in an order drawn by the seed; about percent % stay, the others are null.

    Places are a bijection of the keys (multiplication modulo rows by a unit and a shift), so nothing is sorted.
    """
    if not 0 <= percent <= 100:
        raise ValueError(f"percent must lie in 0..100: {percent}")
    step = next((s for s in range(int(rows * 0.6180339887) | 1, 2 * rows + 3, 2) if np.gcd(s, rows) == 1), 1) if rows > 2 else 1
    key = F.pmod(F.col("id") * F.lit(step % max(rows, 1)) + F.lit(seed), F.lit(max(rows, 1)))
    if rows * step >= 2**63:
        key = F.pmod(F.col("id").cast("decimal(38,0)") * F.lit(step) + F.lit(seed), F.lit(rows)).cast("long")
    kept = F.when(uniform01(seed + 1, "key") < percent / 100, F.col("key"))
    return spark.range(rows).select(F.col("id").alias("pos"), key.alias("key")).withColumn("key", kept)


def foreign_key_from_primary(pk: DataFrame, rows: int, seed: int = 2) -> DataFrame:
    """pos and key: the primary keys in cycle, nulls too, `rows` of them, in another order of places."""
    spark, n = pk.sparkSession, pk.count()
    if not n:
        return spark.range(0).select(F.col("id").alias("pos"), F.col("id").alias("key"))
    places = spark.range(rows).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**31)).alias("_o"), (F.col("id") % n).alias("pos"), "id")
    return places.join(pk, "pos").select(F.col("id").alias("pos"), "key")


def uniform(spark: SparkSession, rows: int, low: int, high: int, seed: int = 3, column: str = "key") -> DataFrame:
    """pos and a column of integers in [low, high)."""
    return spark.range(rows).select(F.col("id").alias("pos"), F.floor(low + uniform01(seed, "id") * (high - low)).cast("long").alias(column))


def zipf_cdf(spark: SparkSession, n: int, exponent: float) -> DataFrame:
    """rank (1..n) and cdf: the share of ranks up to it, in proportion to 1 / rank ** exponent."""
    ranks = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-exponent)).alias("w"))
    block = F.floor(F.col("rank") / 100_000)
    totals = ranks.groupBy(block.alias("b")).agg(F.sum("w").alias("t"))
    everything = Window.orderBy("b")
    totals = totals.select("b", (F.sum("t").over(everything) - F.col("t")).alias("base"), F.sum("t").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    inside = F.sum("w").over(Window.partitionBy("b").orderBy("rank"))
    return ranks.withColumn("b", block).join(totals, "b").select("rank", ((F.col("base") + inside) / F.col("all")).alias("cdf"))


def zipf(spark: SparkSession, rows: int, n: int, exponent: float, seed: int = 4, column: str = "key") -> DataFrame:
    """pos and a column of integers in [0, n), the smaller the likelier; an exponent of 0 or less is uniform.

    Ranks are drawn by rejection and inversion of the integral of x ** -exponent, so no table is held whatever n is.
    The draws of a row follow from its number and the seed.
    """
    if exponent <= 0:
        return uniform(spark, rows, 0, n, seed, column)
    s = float(exponent)
    area = (lambda x: np.log(x)) if s == 1 else (lambda x: (x ** (1 - s) - 1) / (1 - s))
    inverse = (lambda y: np.exp(y)) if s == 1 else (lambda y: (1 + y * (1 - s)) ** (1 / (1 - s)))
    first, last = area(1.5) - 1, area(n + 0.5)
    near = 2 - inverse(area(2.5) - 2.0**-s)

    def uniform_of(ids: np.ndarray, k: int) -> np.ndarray:
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + k) % 2**63)
        for shift in (30, 27, 31):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(11)) / 2.0**53

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["id"].to_numpy()
            out, open_, k = np.zeros(len(ids), np.int64), np.arange(len(ids)), 0
            while len(open_):
                u = last + uniform_of(ids[open_], k) * (first - last)
                x = inverse(u)
                rank = np.clip(np.floor(x + 0.5), 1, n)
                good = (rank - x <= near) | (u >= area(rank + 0.5) - rank**-s)
                out[open_[good]] = rank[good].astype(np.int64) - 1
                open_, k = open_[~good], k + 1
            yield pd.DataFrame({"pos": ids, column: out})

    return spark.range(rows).mapInPandas(draw, f"pos long, {column} long")


def lineitem(spark: SparkSession, scale: float, seed: int = 5) -> DataFrame:
    """The four columns of Query 6, encoded as whole numbers: day number, percent, quantity, price."""
    rows = max(0, int(4 * 1_500_000 * scale + np.sqrt(3) * np.random.default_rng(seed).standard_normal()))
    whole = lambda k, low, high: F.floor(low + uniform01(seed + k, "id") * (high - low)).cast("int")
    return spark.range(rows).select(whole(1, 0, 7 * 365 + 1).alias("shipdate"), whole(2, 0, 11).alias("discount"), whole(3, 1, 51).alias("quantity"), whole(4, 1, 2**31 - 1).alias("extendedprice"))


@dataclass(frozen=True)
class DataSet:
    """Sizes of a named join input; the probe side is uniform over the keys unless an exponent is given."""

    inner: int
    outer: int
    exponent: float = 0.0
    copied: bool = False
    #: Half-open range that payloads are drawn from; unset, a row's payload is its number from 1.
    payload: tuple[int, int] | None = None


def _bytes(inner: int, outer: int, key_bytes: int) -> DataSet:
    return DataSet(inner // (2 * key_bytes), outer // (2 * key_bytes))


def preset(name: str, key_bytes: int = 8) -> DataSet:
    """A named input: kim, blanas, blanas4mb, test, 2gib_32gib or 32gib_32gib (bytes of both relations)."""
    # Sizes of the named inputs.
    sizes = {
        "kim": DataSet(128 * 10**6, 128 * 10**6),
        "blanas": DataSet(16 * 2**20, 256 * 2**20),
        "blanas4mb": DataSet(512 * 2**10, 256 * 2**20),
        "test": DataSet(1000, 1000, copied=True),
        "2gib_32gib": _bytes(2 * 2**30, 32 * 2**30, key_bytes),
        "32gib_32gib": _bytes(32 * 2**30, 32 * 2**30, key_bytes),
    }
    return sizes[name.lower()]


def join_input(spark: SparkSession, data: DataSet, percent: int = 100, scale: float = 1.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Build and probe relations (pos, key, value) of a data set, sizes times scale."""
    inner, outer = max(1, int(data.inner * scale)), max(1, int(data.outer * scale))
    pk = primary_key(spark, inner, percent, seed)
    fk = foreign_key_from_primary(pk, outer, seed + 1) if data.copied else zipf(spark, outer, inner, data.exponent, seed + 2)
    low, high = data.payload or (0, 0)
    value = (F.floor(low + uniform01(seed + 3, "pos") * (high - low)).cast("long") if data.payload else F.col("pos") + 1).alias("value")
    return pk.select("pos", "key", value), fk.select("pos", "key", value)


def generated(spark: SparkSession, make: Callable[..., tuple[DataFrame, DataFrame]], **settings) -> tuple[DataFrame, DataFrame]:
    """A join input from a caller's own generator."""
    return make(spark, **settings)
