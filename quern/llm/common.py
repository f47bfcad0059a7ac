"""Shared helpers: the cluster's shared folder, intermediate tables, Arrow batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts UTF-8 at the same places.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Tables of at most so many rows and bytes of text are broadcast by operators that count them first.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Bytes of a row group of intermediate tables; a writing task holds about one.
ROW_GROUP = 16 << 20

_local: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local master gets a temporary one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='quern-')}"
    return _local[context.applicationId]


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is not dropped before goes when the application ends."""
    root = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    where, store = _place(spark, root)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{root}/{name}"


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and losing an executor costs nothing."""
    path = path or shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_path`` named."""
    where, store = _place(spark, path)
    store.delete(where, True)


class Scratch:
    """Intermediate tables that only an operator's own steps read: they are dropped before the operator returns."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = shared_path(self.spark, name)
        return saved(df, name, self.paths[name])

    def drop(self, name: str) -> None:
        if name in self.paths:
            dropped(self.spark, self.paths.pop(name))

    def __exit__(self, *_) -> None:
        for name in list(self.paths):
            self.drop(name)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name`` with as many underscores before it as no column in ``taken`` has."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, whose columns are numbers and texts, may be broadcast: counted, not estimated."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(0))
    found = df.agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return found["n"] <= rows and (found["bytes"] or 0) <= size


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id long, text binary, more): UTF-8 bytes, empty for null. Other columns of ``docs``, whatever their names, are left behind."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"),
        *more,
    )


def map_rows(docs: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str) -> DataFrame:
    """Apply a function of column lists to each Arrow batch; ``make`` runs once in each task and may build tables."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if batch.num_rows:
                work = work or make()
                yield pa.RecordBatch.from_pydict(work(*(batch.column(n).to_pylist() for n in names)), schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    return docs.mapInArrow(run, schema)
