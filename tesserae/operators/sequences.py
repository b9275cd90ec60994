"""Windows over long sequences, cut by ranges so that no sequence is one task.

Rows are dealt by ranges of (sequence, order) and stored. Windows run within a
part; what they need from other parts comes as a small table: a sequence's
first or last few rows of each part as halo rows, and its count of rows as an
offset. Only sequences that lie in several parts are in these tables, at most
two a part, and in a long one a row for each of its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

PART = "_part"
RANGE_ROWS = 1 << 18


def cut(rows: DataFrame, by: str, order: str, parts: int | None = None) -> DataFrame:
    """``rows`` with the range of (``by``, ``order``) that they lie in; ``order`` is not repeated within a sequence."""
    # more ranges where there are more rows, so that a range's task is no larger for it
    parts = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    # stored, so that the ranges are the same whenever they are read
    return stored(rows.repartitionByRange(parts, by, order).withColumn(PART, F.spark_partition_id()), "ranges")


def _crossing(placed: DataFrame, by: str) -> DataFrame:
    """(by, part, count, number of earlier rows) of the sequences in several parts."""
    sizes = placed.groupBy(by, PART).agg(F.count("*").alias("_count"))
    w = Window.partitionBy(by)
    earlier = F.coalesce(F.sum("_count").over(w.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = sizes.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_parts")).where("_parts > 1")
    return sizes.join(several, F.col(by).eqNullSafe(F.col("_by")), "left_semi").withColumn("_earlier", earlier)


def numbered(placed: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Rows of ``cut`` with their number in the sequence, from 1."""
    offsets = _crossing(placed, by).select(F.col(by).alias("_by"), F.col(PART).alias("_p"), "_earlier")
    n = F.row_number().over(Window.partitionBy(PART, by).orderBy(order)) + F.coalesce("_earlier", F.lit(0))
    joined = placed.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col(PART) == F.col("_p")), "left")
    return joined.withColumn(name, n.cast("int")).select(*placed.columns, name)


def with_neighbours(placed: DataFrame, by: str, order: str, columns: list[str], back: int = 0, ahead: int = 0) -> DataFrame:
    """Rows of ``cut`` with ``_prev{i}_{c}`` and ``_next{i}_{c}``: a column's values i rows before and after."""
    crossing = _crossing(placed, by).select(F.col(by).alias("_by"), F.col(PART).alias("_p"))
    edge = placed.join(crossing, F.col(by).eqNullSafe(F.col("_by")) & (F.col(PART) == F.col("_p")), "left_semi")
    whole = placed.withColumn("_halo", F.lit(False))
    for count, way in ((ahead, 1), (back, -1)):
        if count:
            near = Window.partitionBy(PART, by).orderBy(F.col(order).asc() if way > 0 else F.col(order).desc())
            few = edge.withColumn("_nth", F.row_number().over(near)).where(F.col("_nth") <= count)
            listed = few.groupBy(by, PART).agg(F.array_sort(F.collect_list(F.struct("_nth", F.struct(*placed.columns).alias("row")))).alias("_rows"))
            # each part has a row at least, so ``count`` parts on are enough
            around = Window.partitionBy(by).orderBy(F.col(PART).asc() if way > 0 else F.col(PART).desc()).rowsBetween(1, count)
            nearest = listed.select(F.col(PART).alias("_p"), F.slice(F.flatten(F.collect_list("_rows").over(around)), 1, count).alias("_near"))
            halo = nearest.select("_p", F.explode("_near").alias("x"))
            whole = whole.unionByName(halo.select("x.row.*", "_p").withColumn(PART, F.col("_p")).select(*placed.columns, F.lit(True).alias("_halo")))
    w = Window.partitionBy(PART, by).orderBy(order)
    more = {f"_next{i}_{c}": F.lead(c, i).over(w) for i in range(1, ahead + 1) for c in columns} | {
        f"_prev{i}_{c}": F.lag(c, i).over(w) for i in range(1, back + 1) for c in columns}
    return whole.withColumns(more).where(~F.col("_halo")).drop("_halo")
