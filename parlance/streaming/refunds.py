"""Refund rate of purchases, from a stream of purchases and a stream of refunds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_refund(
    purchases: DataFrame, refunds: DataFrame, within: str = "24 hours", late: str = "1 hour",
    late_refunds: str = "1 hour",
) -> DataFrame:
    """(order_id, purchased_at, refunded) of every purchase (order_id, purchased_at): whether it was
    refunded (order_id, refunded_at) from the time of purchase to ``within`` later, ends included.

    An outer join of two streams over an interval: both sides keep rows only until the watermarks
    say that no partner can come, and purchases without one come out then. Several refunds of a
    purchase count once. Rows that come more than ``late`` or ``late_refunds`` after newer ones of
    their stream may be dropped.
    """
    bought = purchases.select("order_id", "purchased_at").withWatermark("purchased_at", late)
    back = refunds.select(F.col("order_id").alias("_order"), "refunded_at").withWatermark("refunded_at", late_refunds)
    near = (
        (F.col("order_id") == F.col("_order")) & (F.col("refunded_at") >= F.col("purchased_at"))
        & (F.col("refunded_at") <= F.col("purchased_at") + F.expr(f"interval {within}"))
    )
    joined = bought.join(back, near, "left_outer")
    rows = joined.select("order_id", "purchased_at", F.col("refunded_at").isNotNull().alias("refunded"))
    return rows.dropDuplicatesWithinWatermark(["order_id"])


def refund_rates(purchases: DataFrame, window: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """(window_start, window_end, purchases, refunded, refund_rate) per sliding window of the time of
    purchase, from ``with_refund``; a stream's watermark goes on through the join."""
    per_window = purchases.groupBy(F.window("purchased_at", window, slide)).agg(
        F.count(F.lit(1)).alias("purchases"), F.count_if("refunded").alias("refunded")
    )
    return per_window.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "purchases",
        "refunded", (F.col("refunded") / F.col("purchases")).alias("refund_rate"),
    )


def refund_alerts(rates: DataFrame, percent: float = 5.0, least: int = 1) -> DataFrame:
    """Windows with at least ``least`` purchases whose refund rate is above ``percent``."""
    return rates.where((F.col("refund_rate") * 100 > percent) & (F.col("purchases") >= least))
