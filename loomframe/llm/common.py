"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import loomframe

#: Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(loomframe)

#: Rows of a decision or vocabulary table up to which it is broadcast (a row is under 100 bytes).
BROADCAST_ROWS = 300_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and the master is local, a
    temporary one of our own; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="loomframe-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def durable(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: short lineage, safe from lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark).rstrip('/')}/loomframe-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files that no DataFrame refers to any more (those of the query before may stay)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files of a durable DataFrame that nothing will read again."""
    for path in df.inputFiles()[:1]:
        folder = path.rsplit("/", 1)[0]
        for spark, known in [x for x in _written if x[1].rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]]:
            _delete(spark, known)
            _written.remove((spark, known))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it holds at most so many rows; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(docs: DataFrame, name: str = "text") -> Column:
    return F.coalesce(docs[name].cast("string"), F.lit(""))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Holds a setting of the session for what is evaluated inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows and bytes of an Arrow batch of texts, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts holds. Tighter bounds of the session stay; they are read when the result is
    worked out, so these stay set."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that equal one of gone(_id, _hash) by id and hash of the text; every column stays.

    gone is broadcast if it is small; else the join is shuffled.
    """
    key = F.xxhash64(text_of(docs, text_col))
    return docs.join(small(gone), docs[id_col].eqNullSafe(gone["_id"]) & (key == gone["_hash"]), "left_anti")


def once(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, any of them, for each id and hash of a text in repeated(_id, _hash); all other rows stay.

    One row in each task that has some is told by its number, and the smallest number stays, so no group of rows moves.
    """
    hash_, number, kind = "_hash_", "_number_", {f.name for f in docs.schema}
    while {hash_, number} & kind:
        hash_, number = hash_ + "_", number + "_"
    rows = durable(docs.withColumns({hash_: F.xxhash64(text_of(docs, text_col)), number: F.monotonically_increasing_id()}))
    first = rows.groupBy(F.col(id_col).alias("_id"), F.col(hash_).alias("_hash")).agg(F.min(number).alias("_first"))
    first = first.join(repeated.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h")), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select("_id", "_hash", "_first")
    out = rows.join(small(durable(first)), rows[id_col].eqNullSafe(F.col("_id")) & (rows[hash_] == F.col("_hash")), "left")
    return out.filter(F.col("_first").isNull() | (F.col("_first") == F.col(number))).select(*[rows[f"`{c}`"] for c in docs.columns])


ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def per_text(docs: DataFrame, make: Callable[[], Callable[[str], tuple]], columns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns that make()(text) returns, one row per row of docs; a null text counts as empty.

    make runs once a task. Ids pass through as they are, nulls included; other columns of docs are not read.
    """
    batches(docs.sparkSession)
    kinds = [ARROW[k] for k in columns.values()]
    names = ["doc_id", *columns]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in parts:
            found = list(zip(*(f(t or "") for t in b.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found, kinds)], names)

    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    schema = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"`{n}` {k}" for n, k in columns.items())
    return given.mapInArrow(rows, schema)
