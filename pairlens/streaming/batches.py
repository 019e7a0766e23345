"""Explanations of pairs as they arrive: each micro-batch is explained against fixed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.explain import explain


def explain_stream(pairs: DataFrame, left: DataFrame, right: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends the saliency of each batch of pairs to Parquet at ``out``/batch=<id>; a batch that is run again replaces itself."""

    def one(batch: DataFrame, batch_id: int) -> None:
        explain(batch, left, right, **options).saliency.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return pairs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
