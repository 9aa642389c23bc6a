"""Shared pieces: the shared folder, tables written to cut lineage, and vectorised words of UTF-8 text."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on at a time in a Python worker.
SLICE_BYTES = 1_500_000
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ids(docs: DataFrame) -> DataFrame:
    """docs with doc_id as a long. One that is a long already stays the same column, so that plans over it stay alike."""
    return docs if dict(docs.dtypes)["doc_id"] == "bigint" else docs.withColumn("doc_id", docs["doc_id"].cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or on a single machine (local master) the warehouse where it is unset.

    On a cluster without the setting there is no folder that all executors are known to see: that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/sylvaframe-tables"


#: Whether a query's shuffle files go as it ends; else they stay until the driver's garbage collection comes across them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and lost executors lose nothing.

    The shuffle files of the write go with its end, so that the disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that are broadcast to pick out documents, at most (16 MB); more are joined by a shuffle.
FEW = 1_000_000


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The docs whose doc_id is among the ids (a written table with a column doc_id): so few ids leave the texts where they are."""
    from pyspark.sql import functions as F

    few = ids.limit(FEW + 1).count() <= FEW
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The docs whose doc_id is null or not among the ids."""
    return only(docs, ids, "left_anti")


#: Bytes of a batch that goes to a Python worker, at most (or one row): Spark's 64 MB take several times that in executor and worker.
_BATCH, _SPARKS_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 * SLICE_BYTES


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python workers have BATCH_BYTES at most, unless another size was set than Spark's own.

    The size belongs to the session, not to a table, and counts when the table is worked out: so it stays set.
    """
    if spark.conf.get(_BATCH, _SPARKS_BATCH) == _SPARKS_BATCH:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Free memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over batches that gives memory back as it ends: Spark keeps workers, and what they hold adds to the next task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches with at most SLICE_BYTES of text (or one row), with their texts as bytes; null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.array(col.cast(pa.large_binary()).is_valid(), dtype=np.int64)
        sizes *= np.nan_to_num(np.array(pa.compute.binary_length(col).to_pandas(), dtype=float)).astype(np.int64)
        at, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and total + n > SLICE_BYTES:
                piece = batch.slice(at, i - at)
                yield piece, [x or b"" for x in col.slice(at, i - at).cast(pa.binary()).to_pylist()]
                at, total = i, 0
            total += n
        yield batch.slice(at), [x or b"" for x in col.slice(at).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x = x ^ (x >> U(27))
    x = x * _M2
    return x ^ (x >> U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that are no letters.
NON_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])


def _named(words: pa.Array) -> np.ndarray:
    """64-bit XXH3 hashes of distinct words."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    raw, digest = data.to_pybytes(), xxhash.xxh3_64_intdigest
    return np.array([digest(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], U)


def word_hashes(texts: list[bytes], lower: bool = False, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of all texts: 64-bit hash, number of the text, first byte and end in the joined buffer, which is returned too.

    A word is a maximal run of bytes that `apart` doesn't mark. Words are told apart by their bytes (an Arrow
    dictionary), and only the distinct ones are hashed; equal words have equal hashes in every process. Hashes find
    candidates; where equality decides a result, the words themselves are compared.
    """
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    gap = apart[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64), starts, ends, joined
    if lower:
        buf = buf + np.uint8(32) * ((buf >= 65) & (buf <= 90)).astype(np.uint8)
    # Words and the gaps after them take turns as values of one Arrow array over the buffer.
    offsets = np.append(edge, len(buf)).astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = values.take(pa.array(np.arange(0, len(edge), 2, dtype=np.int32))).dictionary_encode()
    hashes = _named(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(lengths + 1) - (lengths + 1)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, doc, starts, ends, joined


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, by the position of the first."""
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, U)
    for j in range(k):
        g *= _BASE
        g += h[j : j + n]
    return mix(g)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64))
