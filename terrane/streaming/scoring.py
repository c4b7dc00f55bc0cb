"""Scoring of a stream of locations against fixed observations: each micro-batch is predicted as a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.evaluate import predict, predict_independent
from ..plans.specify import specify


def score_stream(stream: DataFrame, points: DataFrame, values: DataFrame, parameters: Sequence[float], nugget: float, sink: Callable[[DataFrame, int], None], checkpoint: str, m: int = 20, once: bool = False, **options) -> StreamingQuery:
    """Starts a query that hands sink(predictions, batch_id) the rows loc_id, mean, var of each micro-batch of (loc_id,
    coords). A batch that is retried gives the same rows, so a sink that overwrites by batch_id is exactly once.

    Without options each location is predicted from its m nearest observations alone, so a batch costs what its locations
    cost and the batches' borders don't matter. With options of a plan the locations of a batch are predicted jointly,
    which orders all points anew for each batch. once: what is there is scored and the query ends.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        if not options:
            sink(predict_independent(points, values, batch, m, parameters, nugget), batch_id)
            return
        plan = specify(points, m, batch, **options)
        out = predict(plan, values, parameters, nugget)
        sink(out.where("not is_obs").select("loc_id", "mean", "var"), batch_id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
