"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, in Java's and in Python's syntax: a run without ASCII white space. bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is set, a temporary one for a local master,
    as in tests; on a cluster executors could not see it, so it is refused there."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tasteframe-')}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """What queries have shuffled within goes when they end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with spent_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of df, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """What a worker has freed goes back to the machine. Workers wait for their next task beside a full heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives its memory back when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


@dataclass(frozen=True)
class ArrowStep:
    """A column computed batch by batch from one source column. function() makes the worker's function, once a task."""

    name: str
    kind: T.DataType
    source: str
    function: Callable[[], Callable[[pa.Array], pa.Array]]


def add_arrow_columns(df: DataFrame, *steps: ArrowStep, without: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns of the steps, which may read those of earlier steps, in one pass of one worker; columns of
    these names are replaced, those in `without` do not come back."""
    made = {s.name: s.kind for s in steps}
    kept = [c for c in df.columns if c not in made and c not in without]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, k) for n, k in made.items())])
    first = steps[0].source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = [(s.name, s.source, s.function()) for s in steps]
        for batch in batches:
            for part in slices(batch, first):
                own = dict(zip(part.schema.names, part.columns, strict=True))
                for name, source, function in compute:
                    own[name] = function(own[source])
                yield pa.RecordBatch.from_arrays([own[c] for c in (*kept, *made)], names=[*kept, *made])

    return df.mapInArrow(tidy(run), schema)


def slices(batch: pa.RecordBatch, source: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about `most` bytes of the source column, one row at least: bounds what a worker
    holds next to the batch."""
    column = batch.column(batch.schema.get_field_index(source))
    rows = max(1, int(batch.num_rows * most / max(column.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_bytes(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text as bytes; a null text is empty."""
    return df.select(*columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
