"""Helpers of the package: the shared folder, stored intermediates, null-safe views of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python worker holds as objects at a time.
ROWS = 2_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and all runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="veilspark-llm-")
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it from there: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete what stored() wrote for df."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """mapInArrow with a function of a few rows at a time; where it gives None, nothing comes out."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, ROWS):
                if (out := rows(batch.slice(at, ROWS))) is not None:
                    yield out

    return df.mapInArrow(batches, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


class Known:
    """Values of strings met before, in two halves of bounded size: when the young one is full, it replaces the old one.

    Values are made for many strings at once, so that making them can be vectorised.
    """

    def __init__(self, make: Callable[[list], list], limit: int):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def of(self, keys: set) -> dict:
        """The values of all keys."""
        here, missing = {}, []
        young, old = self.young, self.old
        for key in keys:
            value = young.get(key)
            if value is None and (value := old.get(key)) is None:
                missing.append(key)
            else:
                here[key] = value
        if missing:
            here.update(zip(missing, self.make(missing)))
        if len(young) + len(here) > self.limit:
            self.old, self.young = young, {}
        self.young.update(here)
        return here


def slices(values: list, sizes: Callable = len, most: int = 1_000_000) -> Iterator[list]:
    """Consecutive parts of a list, each of about the given total size (one value at least)."""
    part, total = [], 0
    for value in values:
        part.append(value)
        total += sizes(value)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def renamed(df: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """df with names that clash with none for all columns but `keep`, and (name in it, name in df) of each column."""
    names = [(c if c in keep else f"__own_{i}", c) for i, c in enumerate(df.columns)]
    return df.toDF(*[inner for inner, _ in names]), names


def restored(names: list[tuple[str, str]], leave: tuple[str, ...] = ()) -> list:
    """The columns of renamed() under their own names, but those to leave out."""
    return [F.col(inner).alias(own) for inner, own in names if own not in leave]


def held_out(remainder: int, parts: int):
    """crc32(doc_id as text) mod parts == remainder; a null id is held out, as it can't be assigned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(True))
