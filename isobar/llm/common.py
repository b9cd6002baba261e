"""Pieces that several corpus operators share: chunked Arrow maps, folds, samples, word tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that a chunk holds before it is handed on (a single longer text makes a chunk of its own).
CHUNK_CHARS = 2_000_000
#: Resident bytes from which a worker hands memory back after a task.
IDLE_BYTES = 220 << 20
#: Bytes of an Arrow batch on its way to a worker, set where the session has Spark's own default (a memory bound only).
BATCH_BYTES, DEFAULT_BATCH_BYTES = 8 << 20, 64 << 20
#: Distinct words, and bytes of their rows, that a worker remembers between chunks; beyond it the memory starts anew (a speed bound, not a result bound).
WORD_MEMORY, ROW_MEMORY = 300_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_is(key: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key as text leaves this remainder; false for null keys."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def map_chunks(df: DataFrame, columns: list, schema: str, make: Callable[[], Callable[[dict[str, list]], dict]], text: str | None = "text") -> DataFrame:
    """Apply a function to chunks of rows in Arrow batches.

    ``make()`` runs once per task and returns ``fn(chunk) -> dict`` of equally long columns; a chunk
    is a dict of lists over the selected columns. Chunks are bounded by CHUNK_CHARS of ``text``, so
    memory follows one chunk (or one text), not the partition.
    """
    out_type: StructType = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, arrow = make(), to_arrow_schema(out_type)
        for batch in batches:
            for piece in _pieces(batch, text):
                out = fn({n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        del fn
        give_back()

    return map_batches(df.select(*columns), run, schema)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose batches are bounded in bytes, not only in rows."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b") == str(DEFAULT_BATCH_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand a finished task's memory back: workers live on, and what they hold counts against the next stage."""
    import ctypes
    import gc
    import os

    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < IDLE_BYTES:
                return  # little to hand back
    except OSError:  # another system
        pass
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _pieces(batch: pa.RecordBatch, text: str | None) -> Iterator[pa.RecordBatch]:
    if text is None or not batch.num_rows:
        if batch.num_rows:
            yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_CHARS, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class WordRows(dict):
    """Word -> row number of a growing table; ``fill`` computes rows of new words in bulk.

    ``lookup(words)`` returns row numbers, after the rows of unseen words were filled in.
    """

    def __init__(self, fill: Callable[[list], np.ndarray], width: int, dtype=np.float32):
        super().__init__()
        self.fill, self.new = fill, []
        self.rows = np.zeros((1024, width), dtype)

    def __missing__(self, word):
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def lookup(self, words: list) -> np.ndarray:
        if len(self) > min(WORD_MEMORY, ROW_MEMORY // self.rows[:1].nbytes):
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            if len(self) > len(self.rows):
                grown = np.zeros((max(len(self), 2 * len(self.rows)), self.rows.shape[1]), self.rows.dtype)
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            for i in range(0, len(self.new), 50_000):
                part = self.new[i : i + 50_000]
                at0 = len(self) - len(self.new) + i
                self.rows[at0 : at0 + len(part)] = self.fill(part)
            self.new = []
        return at


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (xor-shift-multiply) over uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_grams(words: list[str], sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed character n-grams of words with a blank at each end.

    Returns one (hashes, starts) pair per size: hashes of all positions (0 where a gram would cross
    the word's end) and, per word, the position where its run starts. The same in every process.
    """
    code = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    left = np.repeat(starts + lengths, lengths) - np.arange(len(code))  # characters from here to the word's end
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, max(sizes) + 1):
        h = h[: len(code) - n + 1] * _MULT + code[n - 1 :]
        if n in sizes:
            g = mix64(h + np.uint64(n * int(_MULT) & 0xFFFFFFFFFFFFFFFF)) | np.uint64(1)
            full = np.zeros(len(code), np.uint64)
            full[: len(g)] = g
            full[left < n] = 0
            out.append((full, starts))
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows, those whose key hashes lowest; the same rows at any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where all run on this machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="isobar-")
        sc.setCheckpointDir(at)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


#: Folders that written() made and nothing has discarded yet.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder under the shared one and read back: lineage ends there."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that written() made; nothing that still reads them may run afterwards."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


def folders() -> list[str]:
    """The folders made so far, oldest first."""
    return list(_made)
