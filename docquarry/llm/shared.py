"""Shared helpers: the cluster's shared folder, staged tables, text keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    on one machine (tests) a temporary folder is made and set; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = getattr(spark.sparkContext, "_docquarry_dir", None)
        if known is None:
            known = "file://" + tempfile.mkdtemp(prefix="docquarry-")
            spark.sparkContext._docquarry_dir = known
            spark.sparkContext.setCheckpointDir(known)
        base = known
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/docquarry-{uuid.uuid4().hex}-{name}"
    if not _staged:
        atexit.register(_sweep)
    _staged.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _staged:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: its folder goes with it
            return


def staged_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, staged; all tables that were staged on the way are removed."""
    before = set(_staged)
    out = staged(make(), name)
    _forget(path for kept, path in _staged if (kept, path) not in before and path != out.staged_at)
    return out


def unstaged(*tables: DataFrame) -> None:
    """Removes tables that ``staged`` gave and that nothing reads any more."""
    _forget(t.staged_at for t in tables)


def _forget(paths: Iterable[str]) -> None:
    gone = set(paths)
    for spark, path in [x for x in _staged if x[1] in gone]:
        _remove(spark, path)
    _staged[:] = [x for x in _staged if x[1] not in gone]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: what reads the result survives the loss of executors
    without recomputing what came before. The shuffle files of the finished step
    are then garbage; a collection lets Spark's cleaner delete them at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run within send Python at most ``rows`` rows at a time; both the executor and Python hold a batch whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def held_out(column: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], hot: Column, most: int) -> DataFrame:
    """``rows`` with ``fact`` of their key, null where ``facts`` (keys, fact; one row for each key) has none.

    Facts of hot keys are broadcast if there are at most ``most`` of them. The rows that find theirs so
    are dealt out at random in the shuffle that the others need, so no task gets all rows of a key.
    """
    few = broadcast_if_small(facts.where(hot).select(*keys, F.col("fact").alias("hot_fact")), most)
    met = rows.join(few, keys, "left")
    # the first key (a long or a string) is one that hardly any other row has, and its fact would not be taken
    dealt = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast(rows.schema[keys[0]].dataType)
    spread = [(F.when(F.col("hot_fact").isNull(), F.col(k)).otherwise(dealt) if k == keys[0] else F.col(k)).alias(f"{k}_spread") for k in keys]
    other = facts.where(~hot).select(*[F.col(k).alias(f"{k}_spread") for k in keys], F.col("fact").alias("other_fact"))
    joined = met.select("*", *spread).join(other, [f"{k}_spread" for k in keys], "left")
    return joined.select(*rows.columns, F.coalesce("hot_fact", "other_fact").alias("fact"))
