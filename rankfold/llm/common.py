"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of all contracts: space and \t to \r.
SPACE = " \t\n\x0b\x0c\r"
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _made:
        _made[sc.applicationId] = tempfile.mkdtemp(prefix="rankfold-")
        atexit.register(shutil.rmtree, _made[sc.applicationId], ignore_errors=True)
    return _made[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing more is read from it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the session has ended already
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A folder not used before under the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives the loss of executors.

    Shuffle files of the write go when it ends, for nothing reads them again; else they would wait for the
    driver's garbage collection, and an operator of many steps would hold the files of all.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    Where all bytes are ASCII ``lower`` does the same; else the letters are replaced one by one, which
    passes over bytes and is several times as fast as ``translate``.
    """
    each = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), zip(UPPER, LOWER), c)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(each)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name so that it is evaluated once, however often ``body`` uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column, gap: str = GAP) -> Column:
    """The runs of characters between gaps; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != "")


@dataclass
class Carried:
    """A table whose columns have neutral names, so that no column of the caller can clash with ours."""

    df: DataFrame
    names: list[str]

    def at(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, df: DataFrame, **more: Column) -> DataFrame:
        """The caller's columns under their own names; then ours, which replace columns of the same name."""
        own = [(n, F.col(f"c{i}")) for i, n in enumerate(self.names) if n.lower() not in {m.lower() for m in more}]
        return df.select(*(c.alias(n) for n, c in own), *(c.alias(n) for n, c in more.items()))


def carried(docs: DataFrame) -> Carried:
    return Carried(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), docs.columns)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and more) alone, picked by position, whatever other columns there are."""
    c = carried(docs)
    return c.df.select(*(F.col(c.at(n)).alias(n) for n in ("doc_id", "text", *more)))


def pieces(batch: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` rows and, but for a single longer row, 4 MB."""
    start = held = 0
    sizes = [pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    for i in range(batch.num_rows):
        own = sum(s[i] for s in sizes)
        if i > start and (i - start >= most or held + own > 4_000_000):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += own
    if batch.num_rows > start:
        yield batch.slice(start)


def per_batch(docs: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Map rows through Python piece by piece.

    ``make`` runs once per task and gives the function from the columns of a piece, as lists, to output rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for piece in pieces(batch):
                rows = list(f(*(c.to_pylist() for c in piece.columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)

    return docs.mapInArrow(run, schema)


def per_row(docs: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """As per_batch, with a function of one row's values."""

    def make_batch() -> Callable[..., Iterable[tuple]]:
        f = make()
        return lambda *columns: map(f, *columns)

    return per_batch(docs, schema, make_batch)
