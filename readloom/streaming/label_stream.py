"""Label reads as files of them arrive.

The model, its layout and threshold are fitted once, on reads that are at hand; labelling has no state, so
the stream needs no watermark and is the batch plan unchanged.  Reads and counts of outcomes are written by one pass over each
micro-batch, into folders of the batch's number, so that a repeated batch replaces its own rows.

Files of mates are one stream each.  A record waits in keyed state until its mates have come (``paired``), in whatever
batch they do, and then goes on as in a batch run; what still waits is kept in the checkpoint."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import mates
from ..operators.label import READS
from ..plans.model import Options
from ..plans.run import Fitted, counted, extract_file


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Reads from Parquet files that appear in a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def label_stream(reads: DataFrame, fitted: Fitted, o: Options = Options()) -> DataFrame:
    """Labelled and filtered reads of a stream."""
    return extract_file(reads, fitted, o)


def write_stream(labelled: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append labelled reads to Parquet, exactly once, taking all that is there and then stopping."""
    return labelled.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_counted(labelled: DataFrame, out: str, checkpoint: str, combine: bool = False) -> StreamingQuery:
    """Reads and counts of outcomes of each micro-batch, from one pass; with ``combine``, mates of a record as one row (see ``paired``).

    ``<out>/reads/batch=N`` and ``<out>/counts/batch=N`` (total, and each outcome)."""

    def store(batch: DataFrame, number: int) -> None:
        rows, seen = counted(mates.combine(batch) if combine else batch)
        rows.write.mode("overwrite").parquet(f"{out}/reads/batch={number}")
        found = {k: v or 0 for k, v in seen.get.items()}
        kinds = ", ".join(f"{k} bigint" for k in found)
        batch.sparkSession.createDataFrame([tuple(found.values())], kinds).coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    return labelled.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "rows array<string>"


def paired(labelled: DataFrame, files: int) -> DataFrame:
    """The rows of a stream, each record's once it has come in so many files; all of a record's rows come in one batch.

    Only what waits is state: a record is forgotten when it is complete.  A row that comes again before that (a file
    that was read twice) replaces its like."""
    schema = labelled.schema

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {json.loads(r)["file_ix"]: r for r in (state.get[0] if state.exists else [])}
        for frame in frames:
            known |= dict(zip(frame["file_ix"].tolist(), frame["row"].tolist(), strict=True))
        if len(known) < files:
            state.update((list(known.values()),))
        else:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"row": [known[k] for k in sorted(known)]})

    rows = labelled.select("ord", "file_ix", F.to_json(F.struct("*")).alias("row")).groupBy("ord")
    return rows.applyInPandasWithState(gather, "row string", _STATE, "append", GroupStateTimeout.NoTimeout).select(F.from_json("row", schema).alias("r")).select("r.*")


def count_stream(labelled: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Counts per outcome and micro-batch, in a folder per batch."""

    def store(batch: DataFrame, number: int) -> None:
        batch.groupBy("outcome").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return labelled.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
