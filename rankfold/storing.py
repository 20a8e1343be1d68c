"""Tables written and read again, in the folder that driver and executors share, and small files that appear whole."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or in local mode a temporary folder that goes when the driver ends."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _made:
        _made[sc.applicationId] = tempfile.mkdtemp(prefix="rankfold-")
        atexit.register(shutil.rmtree, _made[sc.applicationId], ignore_errors=True)
    return _made[sc.applicationId]


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _files(spark, path)
    return files.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, files = _files(spark, path)
    files.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What stands in a folder, by name; nothing if there is none."""
    p, files = _files(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(p)) if files.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    p, files = _files(spark, path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file so that it appears whole or not at all; False, and no change, if it is there already.

    The text goes to a file of another name, which is renamed; of two writers one wins.
    """
    p, files = _files(spark, path)
    if files.exists(p):
        return False
    files.mkdirs(p.getParent())
    draft, _ = _files(spark, f"{p.getParent()}/.{p.getName()}-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(p) or not files.rename(draft, p):
        files.delete(draft, False)
        return False
    return True


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over one that is there."""
    remove(spark, path)
    put_once(spark, path, text)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended already
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to a folder of its own and read back: cuts the lineage and outlives executors; goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove_at_exit, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
