"""Dominance counts by divide and conquer.

How many points are no larger than a query in every field? Points and queries
are dealt by ranges of the first field, points before queries where it is
equal. Inside a range they are compared as they are. A query has all ranges
before its own behind it in that field: these are the left siblings of its
range's ancestors in a binary tree of ranges, one a level, so each point is
handed to one node a level at most, and the same question is asked there in
one field less. In the last field it is a running sum. No pair of rows is made
outside a range, and a range has ROWS_A_RANGE rows, however many are equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import made, release_since, stored

ROWS_A_RANGE = 1 << 14
_AT_ONCE = 256


def below(points: DataFrame, queries: DataFrame, fields: list[str], rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(q, n) of ``queries`` (q, fields): the sum of ``n`` of the ``points`` (n, fields) that are no larger in any field.

    Queries that nothing lies below are left out.
    """
    begun = made()
    one = lambda rows, q, n: rows.select(F.lit("").alias("k"), q.alias("q"), n.alias("n"), *fields)
    rows = one(points, F.lit(None).cast("long"), F.col("n").cast("long")).unionByName(one(queries, F.col("q").cast("long"), F.lit(0).cast("long")))
    found: list[DataFrame] = []
    for at, field in enumerate(fields):
        parts = max(1, -(-rows.count() // rows_a_range))
        order = ["k", field, F.col("q").isNotNull(), F.xxhash64("q", *fields[at:])]
        placed = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
        if at == len(fields) - 1:
            found.append(_running(placed, field))
            break
        found.append(stored(placed.groupBy("part").applyInPandas(_compared(fields[at:]), "q long, n long"), "inside"))
        if parts == 1:
            break
        several = placed.groupBy("k").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select("k")
        level = F.explode(F.sequence(F.lit(0), F.lit((parts - 1).bit_length() - 1))).alias("level")
        spread = placed.join(several, "k", "left_semi").select("k", "q", "n", *fields[at + 1:], "part", level)
        node, right = F.expr("part >> level"), F.expr("(part >> level) & 1 = 1")
        mine = F.when(F.col("q").isNull(), ~right).otherwise(right)
        left = F.when(F.col("q").isNull(), node).otherwise(node - 1)
        rows = spread.where(mine).select(F.concat_ws("/", "k", "level", left).alias("k"), "q", "n", *fields[at + 1:])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    out = stored(every.groupBy("q").agg(F.sum("n").alias("n")).where("n > 0"), "below")
    release_since(begun, made()[-1])
    return out


def _compared(fields: list[str]):
    """(q, n) of the rows of a range, key by key."""
    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in pdf.groupby("k", sort=False):
            asks = rows["q"].notna().to_numpy()
            x, n = rows[fields].to_numpy(np.float64), rows["n"].to_numpy(np.int64)
            mine, theirs, ids = x[~asks], x[asks], rows["q"].to_numpy()[asks]
            for a in range(0, len(theirs), _AT_ONCE):
                under = np.ones((len(theirs[a : a + _AT_ONCE]), len(mine)), bool)
                for f in range(len(fields)):
                    under &= mine[None, :, f] <= theirs[a : a + _AT_ONCE, None, f]
                out.append(pd.DataFrame({"q": ids[a : a + _AT_ONCE].astype(np.int64), "n": under @ n[~asks]}))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})

    return counted


def _running(placed: DataFrame, field: str) -> DataFrame:
    """(q, n): sums of the points before each query within its key, over all ranges."""
    sums = placed.groupBy("k", "part").agg(F.sum("n").alias("sum"))
    earlier = sums.withColumn("earlier", F.sum("sum").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    earlier = earlier.where("earlier > 0").select("k", "part", "earlier")
    w = Window.partitionBy("part", "k").orderBy(field, F.col("q").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = placed.withColumn("here", F.sum("n").over(w)).where("q is not null")
    return here.join(earlier, ["k", "part"], "left").select("q", (F.col("here") + F.coalesce("earlier", F.lit(0))).alias("n"))


def close(points: DataFrame, fields: list[str], slack: float) -> DataFrame:
    """(q, n): the sum of ``n`` of the points within ``slack`` of each point (q, n, fields) in every field, itself included.

    Points meet in cells of 64 slacks; one near the side of its cell asks the next cell too.
    """
    if not slack:
        return points.select("q", "n")
    width = 64.0 * slack
    cell = lambda x: F.floor(x / width)
    home = points.select("n", *[F.col(f).alias(f"_{f}") for f in fields], *[cell(F.col(f)).alias(f"c_{f}") for f in fields])
    asks = points.select("q", *fields)
    for f in fields:
        asks = asks.withColumn(f"c_{f}", F.explode(F.array_distinct(F.array(cell(F.col(f) - slack), cell(F.col(f) + slack)))))
    met = asks.join(home, [f"c_{f}" for f in fields])
    for f in fields:
        met = met.where(F.abs(F.col(f) - F.col(f"_{f}")) <= slack)
    return met.groupBy("q").agg(F.sum("n").alias("n"))
