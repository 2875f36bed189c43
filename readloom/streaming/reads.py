"""Streams of reads: files that appear in a folder, and a sink that writes each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..api import stream_reads, write_reads

__all__ = ["stream_reads", "write_stream"]


def write_stream(stream: DataFrame, path: str, checkpoint: str, **options):
    """A writer, to be started, that puts each micro-batch into a folder of its own, replacing what an earlier attempt left there."""

    def batch(df: DataFrame, number: int) -> None:
        write_reads(df, f"{path}/batch-{number:08d}", mode="overwrite", **options)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
