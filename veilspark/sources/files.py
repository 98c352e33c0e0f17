"""Directories of files: gates on metadata, decoding, extraction."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.text import decode_text
from veilspark.operators.admit import EXTRACT_FAILED, MAX_SIZE, extension, file_name, file_reject_reason

FILE_COLUMNS = ("path", "filename", "file_size", "file_type", "modificationTime")
# Files that Hadoop and Spark keep for themselves.
_BOOKKEEPING = re.compile(r"(?:^|/)(?:_SUCCESS|_temporary|_spark_metadata|\.[^/]*\.crc)(?:/|$)")
_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# What a node of a run stands for (None: its text), and what holds no text.
_TYPED = {f"{_WORD_NS}t": None, f"{_WORD_NS}tab": "\t", f"{_WORD_NS}br": "\n", f"{_WORD_NS}cr": "\n"}
_PROPERTIES = {f"{_WORD_NS}pPr", f"{_WORD_NS}rPr"}


def docx_text(content: bytes) -> str:
    """Plain text of a Word document: each paragraph followed by a blank line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        info = archive.getinfo("word/document.xml")
        if info.file_size > 20 * MAX_SIZE:
            raise ValueError("document too large when unpacked")
        root = ElementTree.fromstring(archive.read(info))
    paragraphs: list[list[str]] = []
    _collect(root, [], paragraphs)
    return "".join("".join(parts) + "\n\n" for parts in paragraphs)


def _collect(node: ElementTree.Element, parts: list[str], paragraphs: list[list[str]]) -> None:
    """One walk: text goes to the paragraph it stands in; one inside another (a text box) follows it.

    Properties hold tab stops, not typed tabs; alternate content is one text in several forms.
    """
    for child in node:
        name = child.tag.rpartition("}")[2]
        if name == "p" and child.tag == f"{_WORD_NS}p":
            own: list[str] = []
            paragraphs.append(own)
            _collect(child, own, paragraphs)
        elif name == "AlternateContent":
            _collect(child[:1], parts, paragraphs)
        elif child.tag in _TYPED:
            parts.append(_TYPED[child.tag] or child.text or "")
        elif child.tag not in _PROPERTIES:
            _collect(child, parts, paragraphs)


# How each extracted file type is named in results, and what extracts it. A PDF
# needs a library; pass one as `extractors={".pdf": function}`.
SOURCE_TYPES = {".docx": "Word", ".pdf": "PDF"}
EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text}


def overlooked_files(spark: SparkSession, path: str) -> DataFrame | None:
    """Files that Spark's own listing leaves out: names that start with `.` or `_`
    (such as `.env`) and empty files. The listing gives metadata only; the bytes are
    read in tasks."""
    filesystem, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    prefix = path.split("://")[0] if "://" in path else "file"

    def hidden(info: fs.FileInfo) -> bool:
        inner = info.path[len(root) :]
        if _BOOKKEEPING.search(inner):
            return False
        return info.size == 0 or any(part.startswith((".", "_")) for part in inner.split("/"))

    if filesystem.get_file_info(root).type != fs.FileType.Directory:
        return None
    found = [
        (f"{prefix}://{i.path}" if prefix != "file" else f"file:{i.path}", i.mtime, i.size)
        for i in filesystem.get_file_info(fs.FileSelector(root, recursive=True))
        if i.type == fs.FileType.File and hidden(i)
    ]
    if not found:
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = []
            for name, size in zip(batch["path"], batch["length"], strict=True):
                reader, inner = fs.FileSystem.from_uri(name.replace("file:", "file://", 1) if name.startswith("file:/") else name)
                with reader.open_input_stream(inner) as stream:
                    contents.append(stream.read() if size <= MAX_SIZE else b"")
            yield batch.assign(content=contents)

    listed = spark.createDataFrame(found, "path string, modificationTime timestamp, length bigint").repartition(
        max(1, min(len(found), spark.sparkContext.defaultParallelism))
    )
    return listed.mapInPandas(run, "path string, modificationTime timestamp, length bigint, content binary")


def list_files(spark: SparkSession, path: str, include_hidden: bool = True, **options) -> DataFrame:
    """One row per file: metadata, content and `reject_reason` (NULL when admitted).

    `include_hidden` adds the files that Spark's listing leaves out; it needs a
    path that pyarrow can open.

    The reason depends on path and length only. A query that does not use
    `content` reads no file at all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).options(**options).load(path)
    overlooked = overlooked_files(spark, path) if include_hidden and "pathGlobFilter" not in options else None
    if overlooked is not None:
        files = files.filter(F.col("length") > 0).unionByName(overlooked)
    return files.select(
        F.col("path"),
        file_name(F.col("path")).alias("filename"),
        F.col("length").alias("file_size"),
        extension(F.col("path")).alias("file_type"),
        "modificationTime",
        "content",
        file_reject_reason(F.col("path"), F.col("length")).alias("reject_reason"),
    )


def small_parts(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about so many bytes in a column of strings or bytes (one row at least)."""
    first = total = 0
    for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        total += size or 0
        if total >= most:
            yield batch.slice(first, i + 1 - first)
            first, total = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def extract_files(df: DataFrame, extractors: dict[str, Callable[[bytes], str]] = EXTRACTORS) -> DataFrame:
    """Text of binary documents; NULL text where extraction fails or gives none.

    Bytes go in and text comes out; the metadata passes through. A worker holds the
    texts of about 1 MB of files at a time, whatever the size of a batch.
    """
    names = df.drop("content", "reject_reason").columns
    schema = ", ".join(f"{name} {kind}" for name, kind in df.select(names).dtypes) + ", text string"

    def extracted(kind: str, content: bytes) -> str | None:
        try:
            text = extractors[kind](content)
        except Exception:  # a broken document is reported as rejected, not raised
            return None
        return text if text and re.search(r"\S", text) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, "content"):
                kinds, contents = part.column("file_type").to_pylist(), part.column("content")
                texts = [extracted(k, bytes(c.as_py())) for k, c in zip(kinds, contents, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(texts, pa.string())], [*names, "text"])

    return df.mapInArrow(run, schema)


def read_files(
    spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """(texts, rejected) of a directory tree.

    Texts have the file columns, `text`, `extracted` and `source_type`; text files
    are decoded as UTF-8, even when empty. Rejected rows have `reject_reason` and
    no content.
    """
    use = {**EXTRACTORS, **(extractors or {})}
    files = list_files(spark, path, **options)
    # the size test on its own reaches the reader, which then skips the bytes
    admitted = files.filter((F.col("file_size") <= MAX_SIZE) & F.col("reject_reason").isNull())
    binary = F.col("file_type").isin(*SOURCE_TYPES)
    direct = admitted.filter(~binary).select(
        *FILE_COLUMNS, decode_text(F.col("content")).alias("text"), F.lit(False).alias("extracted"), F.lit("text").alias("source_type")
    )
    documents = extract_files(admitted.filter(binary), use)
    names = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    texts = documents.filter(F.col("text").isNotNull()).select(
        *FILE_COLUMNS, "text", F.lit(True).alias("extracted"), names[F.col("file_type")].alias("source_type")
    )
    failed = documents.filter(F.col("text").isNull()).select(*FILE_COLUMNS, F.lit(EXTRACT_FAILED).alias("reject_reason"))
    rejected = files.filter(F.col("reject_reason").isNotNull()).select(*FILE_COLUMNS, "reject_reason")
    return direct.unionByName(texts), rejected.unionByName(failed)
