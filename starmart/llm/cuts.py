"""Cuts between two kinds of scores, found over all scores wherever they lie.

Scores are counted, dealt out by range and numbered like surrogate keys, so only the best cut reaches
the driver. Counts are compared as whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from starmart.llm.store import keep


def _running(scores: DataFrame) -> DataFrame:
    """``scores(score, low)`` to ``(score, following, lows, highs)``: each distinct score, the next one, and how
    many scores of either kind are at most as high. The last has no following score."""
    counted = scores.groupBy("score").agg(F.count_if("low").alias("lows"), F.count_if(~F.col("low")).alias("highs"))
    placed = keep(counted.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    # One row per range partition, so single-task windows are enough.
    order = Window.orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum("lows").alias("l"), F.sum("highs").alias("h"), F.min("score").alias("first")).select(
        "part", F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h"),
        F.lead("first").over(order).alias("next"),
    )
    inside = Window.partitionBy("part").orderBy("score")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(parts), "part").select(
        "score", F.coalesce(F.lead("score").over(inside), F.col("next")).alias("following"),
        (F.col("l") + F.sum("lows").over(upto)).alias("lows"), (F.col("h") + F.sum("highs").over(upto)).alias("highs"),
    )


class Cuts:
    """The scores of one table ``(score double, low boolean)``; those of the low kind should lie below a cut."""

    def __init__(self, scores: DataFrame):
        self._scores = keep(scores, "cut-scores")
        found = self._scores.agg(
            F.count_if("low").alias("lows"), F.count_if(~F.col("low")).alias("highs"), F.min("score").alias("least"), F.max("score").alias("most")
        ).first()
        self.lows, self.highs, self.least, self.most = found

    def best(self, widest: bool = False) -> Row | None:
        """The gap ``(score, following, gain)`` that best tells the kinds apart, the lowest such or the widest; ``gain`` is the
        difference of the shares below it, times both numbers. Null if there are less than two scores."""
        share = F.col("lows").cast("decimal(19,0)") * F.lit(self.highs).cast("decimal(19,0)") - F.col("highs").cast(
            "decimal(19,0)"
        ) * F.lit(self.lows).cast("decimal(19,0)")
        gaps = _running(self._scores).filter("following is not null").select("score", "following", share.alias("gain"))
        width = [(F.col("following") - F.col("score")).desc()] if widest else []
        return gaps.orderBy(F.desc("gain"), *width, "score").limit(1).first()

    def high_at(self, place: int) -> float:
        """The score of the high kind in this place, from 0."""
        return _running(self._scores).filter(F.col("highs") > place).agg(F.min("score")).first()[0]
