"""Flow control: what is outstanding, buffered, due or timed out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.ordered import running_sum


def hysteresis(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, high: int, low: int
) -> DataFrame:
    """Add ``level``, the running sum of ``amount``, and ``state``.

    A buffer pauses when its level reaches ``high`` and polls again when it
    falls to ``low``; in between it stays as it is.  So the last time one of
    the marks was reached decides, which is carried from chunk to chunk.
    """
    level = running_sum(rows, keys, order, amount, "level")
    mark = F.when(F.col("level") >= high, "PAUSE").when(F.col("level") <= low, "NEED_POLL")
    marked = level.withColumn("_mark", mark)
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    last = marked.groupBy(*keys, "chunk").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), at)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "chunk", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    own = F.last("_mark", ignorenulls=True).over(inside)
    return (
        marked.withColumn("_own", own)
        .join(carried, [*keys, "chunk"])
        .withColumn("state", F.coalesce("_own", "_carried", F.lit("NEED_POLL")))
        .drop("_mark", "_own", "_carried")
    )


def timed_out(requests: DataFrame, responses: DataFrame, timeout_ms: int) -> DataFrame:
    """Requests (id, at) with their response (id, answered_at), if any, and
    whether it came too late.  Responses to unknown ids drop out."""
    late = F.col("answered_at").isNull() | (F.col("answered_at") - F.col("at") >= timeout_ms)
    return requests.join(responses, "id", "left").withColumn("timed_out", late)
