"""Operator 3, document fingerprints: Order MinHash.

k-mers of code points get occurrence numbers, so a repeated k-mer counts as often as it stands there. Their hashes fall
into ``sketches`` bins (one permutation instead of one for each sketch); in each bin the ``length`` smallest are taken, put
back into text order and hashed as a tuple. Two texts agree in a bin only if the same k-mers stand in the same order there,
so the signature follows edit distance, not only the set. Likeness: equal bins over bins that either text fills,
as the share of k-mers in common.

Defined results: null counts as empty; texts shorter than k are one k-mer; equal texts have equal fingerprints and likeness
1 (two empty texts too); an empty and another text have likeness 0; repeated ids follow each other in the order of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix64, release, small_batches
from .ordering import with_followers


@dataclass(frozen=True)
class Settings:
    k: int = 8
    sketches: int = 64
    length: int = 2
    seed: int = 0x5EED
    range_bytes: int = 16_000_000


EMPTY_BIN = np.uint32(0)


def kmer_hashes(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Polynomial hashes of all runs of k code points, by doubling, then mixed."""
    base = 0x9E6C63D0876A9A47
    x, length = points.astype(np.uint64) + np.uint64(seed), 1
    while length < k:
        step = min(length, k - length)
        power = np.uint64(pow(base, step, 1 << 64))
        x = x[: len(x) - step] * power + x[step:] if step == length else x[: len(x) - step] * power + kmer_tail(points, step, seed, base)[length:]
        length += step
    return mix64(x)


def kmer_tail(points: np.ndarray, length: int, seed: int, base: int) -> np.ndarray:
    x = points.astype(np.uint64) + np.uint64(seed)
    out = x[: len(x) - length + 1].copy()
    for i in range(1, length):
        out = out * np.uint64(base) + x[i : len(x) - length + 1 + i]
    return out


def signature(text: str, s: Settings = Settings()) -> np.ndarray:  # noqa: B008
    """``sketches`` 32-bit values; 0 marks a bin without k-mers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(s.sketches, dtype=np.uint32)
    n = len(points)
    if not n:
        return out
    h = kmer_hashes(points, min(s.k, n), s.seed + (n if n < s.k else 0))
    n = len(h)
    bits = np.uint64(max(1, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    where = np.arange(n, dtype=np.uint64)
    # equal k-mers stand together, each with its positions in text order: the run index is the occurrence number
    packed = np.sort((h & ~low) | where)
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(packed[1:] >> bits, packed[:-1] >> bits, out=first[1:])
    if not first.all():
        starts = np.flatnonzero(first)
        number = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        again = number > 0
        at = (packed[again] & low).astype(np.int64)
        h = h.copy()
        h[at] = mix64(h[at] + number[again].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        packed = np.sort((h & ~low) | where)
    # bins are equal slices of the hash range, so a bin's smallest stand at the start of its slice
    edges = (np.arange(s.sketches, dtype=np.uint64) * np.uint64((1 << 64) // s.sketches)) & ~low
    begin = np.searchsorted(packed, edges)
    end = np.append(begin[1:], n)
    take = np.minimum(end - begin, s.length)
    index = begin[:, None] + np.arange(s.length)
    inside = np.arange(s.length) < take[:, None]
    at = (packed[np.minimum(index, n - 1)] & low).astype(np.int64)
    at = np.sort(np.where(inside, at, n), axis=1)  # text order; what a bin lacks goes to the end
    values = np.where(at < n, h[np.minimum(at, n - 1)], np.uint64(0))
    total = np.full(s.sketches, s.seed, dtype=np.uint64)
    for j in range(s.length):
        total = mix64(total * np.uint64(0xD1342543DE82EF95) + values[:, j])
    return np.where(take > 0, (total >> np.uint64(32)).astype(np.uint32) | np.uint32(1), EMPTY_BIN)


def likeness(a: np.ndarray, b: np.ndarray, s: Settings = Settings()) -> float:  # noqa: B008
    """A bin of ``length`` k-mers is equal if all of them are, so the root brings the share back to that of k-mers."""
    filled = (a != 0) | (b != 0)
    n = int(filled.sum())
    return float(((a == b)[filled].sum() / n) ** (1 / s.length)) if n else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter (floor of code points / 4) replaced by as many first code points of the following text, or all."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, s: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None) -> DataFrame:  # noqa: B008
    """One row for each row of ``docs``: id, n_chars, fingerprint and those of its edited text and likenesses.

    Texts move once, to their range of ids, which is a partition of its own and holds about ``range_bytes`` of text; a text's
    k-mers are hashed where it is read in order, and only the first text of each range travels twice."""
    docs = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    if ranges is None:
        ranges = 1 + (docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // s.range_bytes
    kind = docs.schema["id"].dataType.simpleString()
    ranged, _ = with_followers(docs, "id", ranges, ["tie"])
    in_order = ranged.repartitionById(ranges, F.col("range_id")).sortWithinPartitions("range_id", "follower", "id", "tie", "text")

    small_batches(docs.sparkSession)

    def run(batches):
        import hashlib

        held = None  # the row whose follower has not come yet: (range, id, text, signature)
        for batch in batches:
            rows = []
            for rng, follower, key, text in zip(*(batch.column(n).to_pylist() for n in ("range_id", "follower", "id", "text")), strict=True):
                own = signature(text, s)
                if held is not None and held[0] == rng:
                    _, k, t, sig = held
                    e = edited(t, text)
                    esig = sig if e == t else signature(e, s)
                    rows.append((k, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), sig.astype(">u4").tobytes().hex(), esig.astype(">u4").tobytes().hex(), likeness(sig, esig, s), likeness(sig, own, s)))
                held = None if follower else (rng, key, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, batch.schema.field("id").type) for i, c in enumerate(zip(*rows, strict=True))], ["id", *(x.split()[0] for x in OUT.split(", "))])
        release()

    return in_order.select("range_id", "follower", "id", "text").mapInArrow(run, f"id {kind}, {OUT}").withColumnRenamed("id", id_column)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
