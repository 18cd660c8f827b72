"""Streams of sequences: coverage and counts that grow with each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_counts(stream: DataFrame, width: int) -> DataFrame:
    """(msa_id, pos, aa, c) of a stream (msa_id, sequence), for output mode update or complete. State: columns times residues, however long the stream."""
    cols = stream.select("msa_id", F.posexplode(F.split(F.substring("sequence", 1, width), "")).alias("pos", "aa")).where("aa <> ''")
    return cols.groupBy("msa_id", "pos", "aa").agg(F.count(F.lit(1)).alias("c"))


def coverage_of_counts(counts: DataFrame) -> DataFrame:
    """(msa_id, pos, coverage) of such counts: each place's sequences over those of the first place."""
    reach = counts.groupBy("msa_id", "pos").agg(F.sum("c").alias("c"))
    first = F.max(F.when(F.col("pos") == 0, F.col("c"))).over(Window.partitionBy("msa_id"))
    return reach.select("msa_id", "pos", (F.col("c") / first).alias("coverage"))


def windowed_scores(stream: DataFrame, time_col: str, length: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(window, n, mean_score, best) of scored sequences by event time; rows later than `late` are left out, and their state goes."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, length)).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("best"))


def process_chunks(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, least_length: int = 1, sequence: str = "sequence"):
    """Hand sequences of a least length to `handle`, a micro-batch at a time; the offsets are kept in `checkpoint`."""
    return stream.where(F.length(sequence) >= least_length).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
