"""Helpers shared by the corpus operators: session settings, stored intermediate tables, batched text functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.session import GUESSED, MEASURED, configure, fresh_folder

#: Rows handed to Python at once. A batch of long documents stays within tens of megabytes.
BATCH_ROWS = 500

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
          "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
          "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    # The caller's limits of joins; near copies, whose anchors a plan guesses too few, ask for measured sizes (``measured_only``).
    spark.conf.set(GUESSED, spark.sparkContext.getConf().get(GUESSED, "10m"))
    spark.conf.unset(MEASURED)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"{base}_{uuid.uuid4().hex[:6]}"
    return name


def struct_type(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"


def text_function(fn: Callable[[list[str]], Iterable[tuple]], fields: dict[str, str]) -> Callable[[Column], Column]:
    """A column function from a text to a struct of ``fields``: ``fn`` takes the texts of one batch (null as empty) and
    gives one tuple a text. Only the text column goes to Python; whole batches travel as Arrow data."""
    names = list(fields)
    kinds = [_ARROW[k] for k in fields.values()]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = list(fn([x or "" for x in batch.to_pylist()]))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.StructArray.from_arrays(
                [pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}

    def apply(text: Column) -> Column:
        # Not deterministic in name only, so that the optimizer never evaluates it twice for a filter and a projection.
        return F.arrow_udf(run, struct_type(fields)).asNondeterministic()(text)

    return apply


def with_text(docs: DataFrame, fn: Callable[[Column], Column], text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the struct of a text function under a name that clashes with no other column."""
    name = unused(docs, "_derived")
    return docs.withColumn(name, fn(F.col(text))), name


class Scratch:
    """Intermediate tables of one operator call, in the shared folder of ``spark.checkpoint.dir``.

    A stored table cuts lineage and outlives executors. ``drop`` removes tables that no result reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = fresh_folder(spark, name)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)
        # Shuffle files of finished steps go once the driver has collected the objects that refer to them.
        jvm.System.gc()
