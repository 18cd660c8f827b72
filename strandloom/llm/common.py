"""What the corpus operators share: the shared work folder, row keys, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of a join's rows is hot: there are fewer than HOT_SHARES such keys, so their rows of the other side are broadcast.
HOT_SHARES = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, which has one machine, gets a temporary folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    The files go when the driver's Python ends, or with drop_stash.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stashed table that no later plan reads."""
    if path := getattr(df, "_stash_path", None):
        _remove(df.sparkSession, path)


def join_hot(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """many joined with one on key, where one has a row for each key with `_n`, its rows in many, of `total`.

    Keys with more than a thousandth of the rows, of which there are fewer than HOT_SHARES, are joined by a broadcast of
    their rows of `one`, so that the rows of a hot key stay where they are; all others go through a plain join.
    """
    hot = one.where(F.col("_n") > total // HOT_SHARES + 1)
    rest = one.where(F.col("_n") <= total // HOT_SHARES + 1)
    stay = many.join(F.broadcast(hot), key)
    return stay.unionByName(many.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)).drop("_n")


def as_text(name: str = "text") -> Column:
    """The text column as a string, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def replaced(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """df with columns added from what df holds; a column of the same name, in whatever case, goes."""
    gone = {c.lower() for c in added}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone), *(x.alias(c) for c, x in added.items()))


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes that tell documents apart also where ids are null or repeat; equal rows share a key, and get equal results."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), as_text(text_col))))


def arrow_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists; fn maps one bounded batch of columns to another."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give back to the system what a worker has freed: workers are kept for later stages, whose own need comes on top."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def by_bytes(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch of about `most` bytes, at least one row each, so a run of long texts never meets in one list."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, min(rows, int(rows * most / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)
