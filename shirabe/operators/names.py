"""Matching of file names: equal, or one inside the other, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _grams(name: Column, size: int) -> Column:
    last = F.length(name) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(name, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def contained_names(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of distinct keys where the inner one is equal to or lies inside the outer one.

    inner: (inner), outer: (outer). Each inner key looks for its rarest gram of
    three characters (or itself, if shorter) among the grams of the outer keys,
    so only names that share it meet. Null and empty keys match nothing.
    """
    outer = outer.where("outer <> ''").distinct()
    grams = outer.select("outer", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("outer"), n) for n in (1, 2, 3)])))).alias("gram"))
    held = grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("inner") < 3, F.array("inner")).otherwise(F.array_distinct(_grams(F.col("inner"), 3)))
    wanted = inner.where("inner <> ''").distinct().select("inner", F.explode(own).alias("gram")).join(held, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = wanted.withColumn("k", F.row_number().over(Window.partitionBy("inner").orderBy("n", "gram"))).where("k = 1").select("inner", "gram")
    return rarest.join(grams, "gram").where(F.contains("outer", F.col("inner"))).select("inner", "outer")
