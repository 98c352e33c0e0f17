"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

write_tokens() deals documents out by ranges of doc_id, encodes each range and
writes one or more ORC files in ascending doc_id order: each stripe holds ids as an
integer column (run-length encoding), a row index every `stride` rows and a Bloom
filter on doc_id. Readers take stripes in parallel; read_tokens() with ids passes
them to the scan, which skips files, stripes and row groups by their metadata.

Words (runs between white space) are encoded once per Python worker and kept in a
cache of bounded size: the tokenizer collapses white space and splits there, so a
text's ids are those of its words in order. A null text counts as empty and has the
end id alone. A null doc_id comes first. Repeated doc_ids are kept, ordered by their
ids. Further columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.bpe import WHITE
from veilspark.llm.shared import map_arrow, texts

#: The id that ends a document.
END = 2
#: Words kept per Python worker and half of the cache.
CACHE = 250_000
SPLIT = re.compile(f"[^{WHITE}]+")


def split_words(text: str) -> list[str]:
    """Runs between white space; Python's split() takes four separators more than the tokenizer does."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return SPLIT.findall(text)
    return text.split()


#: Pieces of a text in lower case, for characters up to U+00FF.
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\t-\r \x85\xa0]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level alphabet: bytes that show stand for themselves, the others for the characters from 256 on.
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class Kept(dict):
    """Values made on demand; of bounded size, as two halves: when the young one is full, it replaces the old one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of whole texts by a tokenizer file, piece by piece; ids are little-endian unsigned 32-bit integers.

    The tokenizer normalises (composed form, lower case), splits at white space and into letters, single digits and other
    signs, then its model encodes each piece. Where a text, or a word of it, holds nothing beyond U+00FF, it is in composed
    form as it is, so its pieces are cut here and the model is asked for new ones directly; all other words, and those with
    a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else re.compile("(?!)")
        self.tokenize = self.tokenizer.model.tokenize
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = Kept(self._word, CACHE)
        self.pieces = Kept(self._piece, CACHE)

    def _plain(self, text: str) -> bool:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not self.special.search(text)

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        if self._plain(word):
            return self._cut(word)
        return b"".join([self.ids[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
        return b"".join([self.ids[token.id] for token in self.tokenize(shown)])

    def encode(self, some: list[str], end: int) -> list[bytes]:
        last, word = self.ids[end], self.words.__getitem__
        return [(self._cut(text) if self._plain(text) else b"".join(map(word, split_words(text)))) + last for text in some]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END, stride: int = 1000) -> None:
    """Write (doc_id, n_tokens, ids, part) to ORC files at path, in ascending doc_id order over files and rows.

    part numbers the ranges of doc_id, in their order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = encoder(tokenizer).encode(texts(batch), end)
        counts = [len(x) // 4 for x in raw]
        flat = np.frombuffer(b"".join(raw), "<i4")
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int32()), ids], ["doc_id", "n_tokens", "ids"])

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32("text"), "text")
    encoded = map_arrow(ranged, rows, f"doc_id {kind}, n_tokens int, ids array<int>")
    (
        encoded.withColumn("part", F.spark_partition_id())
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", stride)
        .option("orc.create.index", "true")
        .option("compression", "zlib")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The rows that write_tokens() wrote, or those of some doc_ids, which prune by file, stripe and row-group metadata."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: where each document's ids begin, how many, and their hash."""
    rows = read_tokens(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        flat = memoryview(ids.values.to_numpy(zero_copy_only=True).view(np.uint8))
        at = ids.offsets.to_numpy().astype(np.int64) * 4
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        counts = pa.array(np.diff(at) // 4, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("doc_id"), counts, pa.array(crc, pa.int64())], ["part", "doc_id", "n_tokens", "ids_crc32"]
        )

    hashed = map_arrow(rows.select("part", "doc_id", "ids"), hashes, f"part int, doc_id {kind}, n_tokens long, ids_crc32 long")
    # ids before a range: a sum over ranges, of which there are as many as partitions; then a running sum inside each
    ranges = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy("doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = hashed.withColumn("upto", F.sum("n_tokens").over(own))
    return inside.join(before, "part").select(
        "doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"
    )
