"""Places on shared storage, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that are there: session, path, and the thread that wrote it.
_written: list[tuple[SparkSession, str, int]] = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where the setting is missing, a session on this one machine gets a temporary
    folder; a cluster gets an error, since its executors share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="leafmill-"))
    return "file://" + _local[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Lineage ends there: a lost executor costs nothing that was computed before.
    Shuffle files behind the table are given back as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _written.append((spark, path, threading.get_ident()))
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """About `most` rows of df, or all if there are fewer: those whose keys' hash is below a bound set by a count.

    Rows are judged one by one, so nothing is sorted or sent anywhere, and reruns agree.
    """
    rows = df.count()
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(1 << 40)) < int(most / rows * (1 << 40)))


def drop(df: DataFrame | None) -> None:
    """Delete the table behind a frame that materialize returned and nothing reads any more."""
    if df is None:
        return
    names = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for entry in [e for e in _written if any(n.endswith(e[1].split("://")[-1]) for n in names)]:
        _delete(*entry[:2])
        _written.remove(entry)


def mark() -> set[str]:
    """The tables that are there now, for drop_since."""
    return {e[1] for e in _written}


def drop_since(before: set[str], *needed: DataFrame) -> None:
    """Delete the tables that this thread has written since mark() gave `before`, but those that the needed frames read."""
    read = {f.rsplit("/", 1)[0] for df in needed for f in df.inputFiles()}
    for entry in [e for e in _written if e[2] == threading.get_ident() and e[1] not in before]:
        if not any(r.endswith(entry[1].split("://")[-1]) for r in read):
            _delete(*entry[:2])
            _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path, _ in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its folder goes with the cluster
            return
