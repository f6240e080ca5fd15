"""Token ids as Parquet list columns, in ascending document order, with selective reads.

Layout: one file per key range. Columns: ``doc_id`` and ``first`` (ids before the document in its file) ascend; they, the list
``ids`` and ``n_tokens`` are delta encoded and bit-packed, so an id takes the bits that its block needs; ``n_tokens`` allows
metadata reads without the ids; ``shard`` is constant in a file and has a dictionary. Row groups and pages have set sizes; the writer adds column and offset
indexes, so a filter on ``doc_id`` reads the pages that hold it. Spark's own Parquet writer commits the files, so a lost
executor costs a retried task.

Texts are cut at single spaces and line ends between other characters, where the pre-tokenizer always splits, and each piece
is encoded once and remembered; texts with other white space, and pieces of unusual form, are encoded whole.

Defined results: a null text is empty and gives the end id alone; documents with one doc_id follow each other in the order of
a hash of their texts; a null doc_id comes first; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, col, fresh_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
ROW_GROUP_BYTES = 32 * 1024 * 1024
PAGE_BYTES = 256 * 1024
#: pieces that a worker remembers (about 200 bytes each)
MEMORY_PIECES = 500_000
#: pieces of one text that is encoded for many of them
GROUP = 512

WRITE_OPTIONS = {
    "compression": "snappy", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES),
    "parquet.enable.dictionary": "false", "parquet.enable.dictionary#shard": "true",
}

TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])


class PieceEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, remembering pieces."""

    #: besides space and line end: every other white space character, and the mark that stands for a line end below
    _other = [chr(c) for c in (*range(9, 14), *range(28, 32), 1, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288) if c != 10]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(self.tokenizer.get_vocab_size(), max(vocab.values()) + 1), np.int64)
        for token, i in vocab.items():  # a byte-level token has a character for each of its bytes
            self.bytes_of[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes_of[i] = len(token.content.encode())
        self.memory: dict[str, bytes] = {}
        #: bytes of the ids of a line end, which never joins with what follows
        self.mark_bytes = len(self._whole(["\n"])[0])

    def _regular(self, text: str) -> bool:
        """Whether all white space is single spaces and line ends between other characters; substring searches are fast."""
        if text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        return not any(c in text for c in self._other)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, new: dict[str, bytes | None]) -> None:
        """Fill in the ids of pieces that begin with one separator and have no other white space at their ends."""
        keys = list(new)
        pieces = ["\n" + k[1:] if k[:1] == "\x01" else " " + k for k in keys]
        for start in range(0, len(keys), 16 * GROUP):
            stop = min(len(keys), start + 16 * GROUP)
            groups = [pieces[i : min(i + GROUP, stop)] for i in range(start, stop, GROUP)]
            joined = ["".join(g) for g in groups]
            for k, (group, text, e) in enumerate(zip(groups, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False))):
                ids = np.array(e.ids, "<u4")
                ends = np.cumsum(self.bytes_of[ids])
                want = np.cumsum(list(map(len, group)) if text.isascii() else [len(p.encode()) for p in group])
                cut = np.searchsorted(ends, want)
                names = keys[start + k * GROUP : start + k * GROUP + len(group)]
                if cut[-1] >= len(ends) or (ends[cut] != want).any():  # a token across pieces: never with this pre-tokenizer
                    new.update(zip(names, self._whole(group)))
                    continue
                raw, at = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()]
                new.update(zip(names, [raw[a:b] for a, b in zip(at, at[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        get, new, split = self.memory.get, {}, []
        odd = []
        for n, text in enumerate(texts):
            if not text or not self._regular(text):
                odd.append(n)
                continue
            parts = ("\x01" + text.replace("\n", " \x01")).split(" ")  # the first piece as if a line began; its mark goes below
            ids = list(map(get, parts))
            split.append((n, parts, ids))
            k = -1
            try:
                while True:
                    k = ids.index(None, k + 1)
                    new[parts[k]] = None
            except ValueError:
                pass
        if new:
            self._pieces(new)
        for n, parts, ids in split:
            k = -1
            try:
                while True:
                    k = ids.index(None, k + 1)
                    ids[k] = new[parts[k]]
            except ValueError:
                pass
            out[n] = b"".join(ids)[self.mark_bytes :]
        for n, ids in zip(odd, self._whole([texts[n] for n in odd])):
            out[n] = ids
        if len(self.memory) < MEMORY_PIECES:
            self.memory.update(new)
        return out


_encoders: dict[str, PieceEncoder] = {}


def _encoder(vocabulary: str) -> PieceEncoder:
    if vocabulary not in _encoders:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[vocabulary] = PieceEncoder(vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary))
    return _encoders[vocabulary]


#: bytes of scanned input for a token file
FILE_BYTES = 256 * 1024 * 1024


def _files(docs: DataFrame) -> int:
    """As many files as shuffle partitions, or more where these would be larger than ``FILE_BYTES`` by the scan's statistics."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // FILE_BYTES) if size < 1 << 56 else least  # as much is said where nothing is known


def encode_sorted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """The rows of a token file (see ``TOKENS``), range-partitioned and sorted by document."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, first = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            raw = [b + end for b in enc.encode(batch.column(1).to_pylist())]
            n = np.array([len(b) // 4 for b in raw], np.int64)
            starts = first + np.cumsum(n) - n
            first += int(n.sum())
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")), type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(raw), shard, np.int32)), pa.array(starts), pa.array(n), ids], names=TOKENS.names)

    files = files or _files(docs)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    return rows.repartitionByRange(files, "doc_id", F.xxhash64("t")).sortWithinPartitions("doc_id", F.xxhash64("t")).mapInArrow(encode, TOKENS)


def write_tokens(docs: DataFrame, path: str, **args) -> None:
    encode_sorted(docs, **args).write.options(**WRITE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A token table; select ``doc_id, n_tokens`` for metadata alone, filter on ``doc_id`` for single documents."""
    return spark.read.schema(TOKENS).parquet(path)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each file, from the n_tokens column alone; one row per file."""
    total = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    rows, start = [], 0
    for r in total:
        rows.append((r.shard, start))
        start += r.n
    return spark.createDataFrame(rows, "shard int, base long")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    bounded_batches(spark)
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("shard", T.IntegerType()), ("first", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))])

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            at = ids.offsets.to_numpy().astype(np.int64)
            sums = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at)), pa.array(sums)], names=schema.names)

    rows = read_tokens(spark, path).select("doc_id", "shard", "first", "ids").mapInArrow(crc, schema)
    return rows.join(F.broadcast(file_starts(spark, path)), "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **args) -> DataFrame:
    """Write the token files in the shared folder and return their digest."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, **args)
    return digest(spark, path)
