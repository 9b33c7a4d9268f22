"""Operator 1, quality rules: compression bands.

zstandard ratios (compressed bytes / bytes) of the whole document and of fixed chunks must lie in a band that depends on
the length: repetitive text compresses too well, incompressible text (encoded blobs, noise) not at all. Short texts carry
the frame's overhead, so their bands are wide or absent. The operator only maps: no shuffle, and one batch in memory.

Defined results: null or empty text has no words, so every count is 0 and it fails the base rule; repeated rows are judged
each by itself; other columns of the input never take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, documents, map_batches

#: Fixed values of the base rule: symbols counted, window length, least words, most repeated words in percent.
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEAT_PERCENT = 8, 20, 30
WHITE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Bands:
    """whole: (bytes below which the row holds, lowest ratio, highest ratio), the last without bound; chunk: the same for
    chunks of ``chunk_bytes``; a rest shorter than ``chunk_least`` joins no verdict. ``bad_share``: the most of a
    document's chunks that may lie outside their band."""

    whole: tuple = ((64, 0.0, 9.0), (256, 0.30, 1.30), (1024, 0.25, 0.90), (2048, 0.18, 0.80), (4096, 0.14, 0.72), (None, 0.10, 0.68))
    chunk: tuple = ((2048, 0.18, 0.80), (None, 0.14, 0.72))
    chunk_bytes: int = 4096
    chunk_least: int = 1024
    bad_share: float = 0.25
    level: int = 3

    @staticmethod
    def limits(rows: tuple, n: int) -> tuple[float, float]:
        return next((low, high) for below, low, high in rows if below is None or n < below)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window occurring twice or more. Exact: ranks of runs of 1, 2, 4, 8 words by doubling."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    if len(known) == n:
        return 0
    length, distinct, counts = 1, len(known), None
    while length < window:
        step = min(length, window - length)
        pairs = rank[: len(rank) - step] * distinct + rank[step:]
        values, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        length, distinct = length + step, len(values)
        if distinct == len(pairs):
            return 0
    starts = np.flatnonzero(counts[rank] > 1)
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[starts] += 1
    cover[starts + window] -= 1  # starts are distinct, so plain indexing adds each once
    return int((np.cumsum(cover[:n]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), len(text.translate(None, WHITE + CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def band_verdict(text: bytes, bands: Bands, compress) -> tuple[float, int, int, bool]:
    """Ratio of the whole, chunks judged, chunks outside their band, whether the document lies within all bands."""
    n = len(text)
    if not n:
        return 0.0, 0, 0, True
    ratio = len(compress(text)) / n
    low, high = bands.limits(bands.whole, n)
    judged = bad = 0
    for at in range(0, n, bands.chunk_bytes):
        piece = text[at : at + bands.chunk_bytes]
        if len(piece) >= bands.chunk_least:
            chunk_low, chunk_high = bands.limits(bands.chunk, len(piece))
            part = ratio if len(piece) == n else len(compress(piece)) / len(piece)
            judged, bad = judged + 1, bad + (not chunk_low <= part <= chunk_high)
    return ratio, judged, bad, low <= ratio <= high and bad <= bands.bad_share * judged


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def compression_bands(docs: DataFrame, bands: Bands = Bands(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:  # noqa: B008
    """One row for each row of ``docs``: id, base counts, band figures and the verdict ``kept``."""
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def judge(batch):
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress
        rows = []
        for text in byte_texts(batch):
            counts = base_counts(text)
            failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEAT_PERCENT * counts[0]
            ratio, judged, bad, within = band_verdict(text, bands, compress)
            rows.append((*counts, failed, ratio, judged, bad, within and not failed))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, zip(*rows, strict=True))], ["id", *names])

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, judge, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_column)


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(documents(spark, sf_dir))
