"""Requests as they arrive, through the same batch jobs.

Each micro-batch is one call of the batch code. Its output goes to a folder
named by the batch, written with overwrite: a batch that is run again after a
failure replaces its own output. What a batch stages is deleted when its output
is written.
"""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mealgrid.operators.prompts import prompt_table
from mealgrid.plans.recommend import Recommender
from mealgrid.session import staging


def serve_requests(
    requests: DataFrame, recommender: Recommender, out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write the prompts of a stream of requests, one folder per micro-batch."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        with staging(batch.sparkSession):
            prompts = prompt_table(recommender.answer(batch))
            prompts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(requests, answer, checkpoint, trigger)


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
