"""Small helpers that the text operators share: reading tables, keeping results, and Arrow row loops."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows with a null doc_id sort after every other row.
LAST_ID = 2**63 - 1

_scratch: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors.

    Parquet rather than checkpoint(), for it is compressed and keeps column pruning.  The files go when the
    driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _scratch:
        atexit.register(drop_kept)
    _scratch[path] = spark
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(kept: DataFrame) -> None:
    """Delete the files of keep(), once nothing reads them any more."""
    delete(kept.kept_at)


def drop_kept() -> None:
    """Delete what keep() has written; results that still read it are lost."""
    for path in list(_scratch):
        try:
            delete(path)
        except Exception:  # the JVM may be gone already; the folder is then left to its owner
            pass


def kept_now() -> set[str]:
    """Where keep() has written what isn't deleted yet."""
    return set(_scratch)


def release(paths: set[str], docs: DataFrame | None = None) -> None:
    """Delete these of the paths of keep() that docs doesn't read."""
    read = [] if docs is None else docs.inputFiles()
    for path in paths & kept_now():
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in file for file in read):
            delete(path)


def delete(path: str) -> None:
    spark = _scratch.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def per_row(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, rows: int = 256) -> DataFrame:
    """Map each row of df to one row of `schema` inside an Arrow map.

    make() is called once for each task and returns the function of a row's columns.  Batches are cut to
    `rows` rows so that a task holds few texts as Python objects at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = [f(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out), fields.types)], schema=fields
                )

    return df.mapInArrow(run, schema)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for Arrow maps; when a task's rows are done, its allocators give free memory back, for workers outlive tasks."""

    @wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return leaner


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array, by built-in functions; null text: no words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to differ from all columns of docs."""
    known = {c.lower() for c in docs.columns}
    while name.lower() in known:
        name += "_"
    return name


def lower_az(text: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
