"""Helpers that the training-data operators share.

Text kernels work on UTF-8 bytes: ``bytes.split()`` cuts at exactly the six characters of ``[\\x20\\x09-\\x0D]``, so words
here equal the matches of ``[^\\x20\\x09-\\x0D]+`` in SQL.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """The session's ``spark.checkpoint.dir`` holds. Where it is unset, a local session (tests) gets a temporary folder; a
    cluster is refused, as its executors would not share one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def carrying(df: DataFrame, own: tuple, made: tuple, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` over the columns ``own`` of df; all further columns travel in one struct, so their names clash with nothing.
    Back come own, further and ``made`` columns; a caller's column that is named like a made one comes back as name_in."""
    extra = [c for c in df.columns if c not in own]
    packed = df.select(*[F.col(c) for c in df.columns if c in own], *([F.struct(*[F.col(quoted(c)).alias(f"f{i}") for i, c in enumerate(extra)]).alias("carried_columns")] if extra else []))
    taken = {*df.columns, *made}

    def free(name: str) -> str:
        while name in taken:
            name += "_in"
        taken.add(name)
        return name

    names = {c: free(c) if c in made else c for c in extra}
    return stage(packed).select(*[F.col(f"carried_columns.f{extra.index(c)}").alias(names[c]) if c in extra else F.col(c) for c in df.columns], *made)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, so a lost executor costs only its own tasks. Shuffle files of what
    is written there serve nothing any more, so Spark is told to remove them at once."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts hold fewer rows than Spark's default, unless the session says otherwise itself: a worker
    and its executor hold a few batches at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def release() -> None:
    """Gives freed memory back to the system: workers live on from stage to stage, and what they keep counts against the next."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_calls = 0


def release_now_and_then(every: int = 16) -> None:
    """For kernels that are called for one group after the other."""
    global _calls
    _calls += 1
    if _calls % every == 0:
        release()


def byte_texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def nullable(t: pa.DataType) -> pa.DataType:
    """The type with all fields of structs nullable, as declared schemas have them."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in t])
    return pa.list_(nullable(t.value_type)) if pa.types.is_list(t) else t


def passed(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """A column that goes through a kernel as it is."""
    return column.cast(nullable(column.type)) if pa.types.is_nested(column.type) and not pa.types.is_map(column.type) else column


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches; ``fn`` yields any number of batches for one."""
    small_batches(df.sparkSession)

    def run(batches):
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from fn(batch)
        finally:
            release()

    return df.mapInArrow(run, schema)


def in_slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of about ``most`` bytes, so that one kernel call stays within bounded memory."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash; forgets all once ``most`` words are known. Long words are hashed anew each time, so memory stays
    bounded."""

    def __init__(self, most: int = 150_000, seed: int = 0, longest: int = 64):
        import xxhash

        super().__init__()
        self.most, self.digest, self.seed, self.longest = most, xxhash.xxh3_64_intdigest, seed, longest

    def __missing__(self, word: bytes) -> int:
        h = self.digest(word, self.seed)
        if len(word) <= self.longest:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def bucket_remainder(column: str, n: int):
    """crc32 of the id as text, modulo n: how the fixed folds are cut."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
