"""A deterministic feature matrix with bands of signal, from a linear congruential generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER, INCREMENT, MODULUS = 1664525, 1013904223, 1 << 32
MASK = MODULUS - 1


def lcg_next(state: Column) -> Column:
    return (state * F.lit(MULTIPLIER) + F.lit(INCREMENT)).bitwiseAND(F.lit(MASK))


def _jumps(bits: int) -> list[tuple[int, int]]:
    """(a, c) of 2^k steps at once: s -> a s + c modulo 2^32."""
    a, c, out = MULTIPLIER, INCREMENT, []
    for _ in range(bits):
        out.append((a, c))
        a, c = a * a % MODULUS, (a * c + c) % MODULUS
    return out


def _times(state: Column, factor: Column) -> Column:
    """state * factor modulo 2^32, in two halves so that nothing leaves 64 bits."""
    high = (state * F.shiftrightunsigned(factor, 16)).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(high, 16) + state * factor.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(MASK))


def lcg_jump(seed: int, steps: Column, bits: int = 48) -> Column:
    """The state after so many steps, on each row by itself: the steps' binary digits pick from precomputed jumps."""
    jumps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("bigint").alias("a"), F.lit(c).cast("bigint").alias("c")) for k, (a, c) in enumerate(_jumps(bits))])
    one = lambda s, j: F.when(F.getbit(steps, j["k"]) == 1, (_times(s, j["a"]) + j["c"]).bitwiseAND(F.lit(MASK))).otherwise(s)
    return F.aggregate(jumps, F.lit(seed & MASK).cast("bigint"), one)


def bands(spark: SparkSession, n: int = 400, features: int = 50, clusters: int = 4, seed: int = 42) -> DataFrame:
    """(row_id, x, grp): each row draws its group and then each feature; the group's band of features has the signal.

    The last features % clusters features belong to no band. A row takes features + 1 draws, so row i starts at
    draw i * (features + 1), and the rows are made in parallel.
    """
    if min(n, features, clusters) <= 0:
        raise ValueError("n, features and clusters must be positive")
    band = features // clusters
    steps = F.col("id") * F.lit(features + 1)
    first = F.struct(F.lit(0.0).alias("r"), lcg_jump(seed, steps).alias("s"))
    draw = lambda acc: F.struct((lcg_next(acc["s"]) / F.lit(float(MASK))).alias("r"), lcg_next(acc["s"]).alias("s"))
    states = F.aggregate(
        F.sequence(F.lit(1), F.lit(features + 1)),
        F.struct(first.alias("last"), F.array().cast("array<double>").alias("rs")),
        lambda acc, _: F.struct(draw(acc["last"]).alias("last"), F.concat(acc["rs"], F.array(draw(acc["last"])["r"])).alias("rs")),
        lambda acc: acc["rs"],
    )
    drawn = spark.range(n).select(F.col("id").alias("row_id"), states.alias("rs"))
    grp = F.least(F.floor(F.col("rs")[0] * clusters).cast("int"), F.lit(clusters - 1))
    drawn = drawn.withColumn("grp", grp)
    inside = lambda f: (f >= F.col("grp") * band) & (f < (F.col("grp") + 1) * band)
    value = F.transform(F.slice("rs", 2, features), lambda r, f: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(inside(f), F.lit(0.45) + F.lit(0.45) * r).otherwise(F.lit(0.12) * r))))
    return drawn.select("row_id", value.alias("x"), "grp")
