"""Matching of a stream of records against a static master table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.matching import match
from lodestone.plans.lineage import cut
from lodestone.plans.specs import Settings
from lodestone.sources.loaders import clean_strings, with_index


def match_stream(stream: DataFrame, master: DataFrame, output: str, checkpoint: str, columns: Sequence[Mapping] | None = None, settings: Settings | Mapping | None = None, left_key: str | None = None, right_key: str | None = None, once: bool = False) -> StreamingQuery:
    """Match each micro-batch and append the result to Parquet files in ``output``.

    The master is cleaned, indexed and written to shared storage once.  A batch
    that is run again after a failure replaces its own folder, so its rows come
    once.
    """
    known = cut(with_index(clean_strings(master), right_key))

    def write(batch: DataFrame, number: int) -> None:
        match(batch, known, columns, settings, left_key=left_key).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
