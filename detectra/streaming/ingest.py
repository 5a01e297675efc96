"""New runs as a stream: each micro-batch is validated and added to a study or to a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import validate
from ..plans.study import SimulationStudy


def stream_validated(stream: DataFrame, inputs: Sequence[str], outcome: str) -> DataFrame:
    """The clean rows of a stream; the predicate needs no state."""
    return validate.split(stream, inputs, outcome)[0]


def append_runs(stream: DataFrame, inputs: Sequence[str], outcome: str, path: str, checkpoint: str) -> StreamingQuery:
    """Clean runs appended as Parquet, each exactly once."""
    return stream_validated(stream, inputs, outcome).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def feed_study(stream: DataFrame, study: SimulationStudy, checkpoint: str, after: Callable[[SimulationStudy, int], None] | None = None, path: str | None = None) -> StreamingQuery:
    """Each micro-batch is added to the study, which clears its memos; ``after`` may then analyse it.

    A batch is written to a folder of its number under ``path``, by default beside the checkpoint, and
    the study reads what it had before and all batches.  So a batch that is replayed, as after an error
    in ``after``, replaces itself.
    """
    before, folder, schema = study.data, path or f"{checkpoint.rstrip('/')}_runs", stream.schema

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
            outcome, inputs = study.outcome, study.inputs or None
            runs = batch.sparkSession.read.schema(schema).parquet(f"{folder}/batch=*")
            if before is not None:
                columns = [*study.inputs, study.outcome]
                runs = before.unionByName(runs.select(*[F.col(f"`{c}`") for c in columns]))
            study.add_data(runs, outcome, inputs, overwrite=True)
            if after:
                after(study, number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
