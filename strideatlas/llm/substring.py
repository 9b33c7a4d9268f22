"""Operator 8, substring dedup by super-k-mer partitioning.

A window of ``window`` words belongs to the smallest (by hash) of its ``minimiser``-word runs. Consecutive windows with the
same minimiser travel as one packed string, the super-k-mer, to the minimiser's bucket, where all windows of the bucket are
sorted and counted on their whole word sequences. Every window of equal words has the same minimiser, so counts are exact.

1. One pass counts runs (lossy counting within each task) and lists those with a share of ``hot_share`` or more, so 2 /
   ``hot_share`` at most. They rank behind all others as minimisers, so a passage or phrase that stands in a third of all
   documents draws only windows that lie among such runs whole.
2. Documents are dealt into groups by hash. A group sends each distinct super-k-mer once, with a mark if it occurs there
   more than once; what goes to one bucket is compressed together.
3. A bucket holds equal strings of many groups once, and answers each group with the runs of repeated windows in each of its
   strings.
4. The group, cut again from the same shuffled rows, marks words and drops them.

A group holds about ``group_bytes`` of text whatever the input's size, a bucket about as much and what its most frequent
minimiser adds, at most a share of ``hot_share`` of all runs; partitions hold about ``partition_bytes``. Nothing is capped.

Defined results: null and empty texts have no words; texts with fewer words than a window lose none; repeated rows repeat
each other's windows, so both lose them; a document may lose all its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, checkpointed, documents, in_slices, mix64, passed, quoted, release, release_now_and_then, small_batches


@dataclass(frozen=True)
class Settings:
    window: int = 35
    minimiser: int = 6
    hot_share: float = 5e-6  # of all runs; a run with a larger share ranks last
    group_bytes: int = 4_000_000
    partition_bytes: int = 16_000_000
    most_partitions: int = 50_000  # of a shuffle; beyond that partitions grow, groups and buckets do not


BASE = 0xA24BAED4963EE407
HOT = np.uint64(1 << 63)
LONGEST = 1 << 20  # bytes of a run of documents that is hashed at once
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE^i and BASE^-i (modulo 2^64) for i < n; kept, as every buffer needs them."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers


class Words:
    """Words of a buffer in which one space parts words and one line feed parts texts (none of them empty). Hashes of any
    substrings come from one running sum, whatever their length, and do not depend on where they stand."""

    def __init__(self, buffer: bytes):
        self.buffer = buffer
        b = np.frombuffer(buffer + b"\n", dtype=np.uint8)
        self.ends = np.flatnonzero((b == 32) | (b == 10))
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        last = b[self.ends] == 10
        self.owner = np.cumsum(last) - last  # the text of each word
        up, self.down = powers(len(b) + 1)
        sums = np.empty(len(b) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        self.sums = sums

    def hashes(self, first: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each of ``first``."""
        a, b = self.starts[first], self.ends[first + n - 1]
        return mix64((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """First words of all runs of n words of one text."""
        if len(self.owner) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.owner[n - 1 :] == self.owner[: len(self.owner) - n + 1])

    def slice(self, first: int, n: int) -> bytes:
        return self.buffer[self.starts[first] : self.ends[first + n - 1]]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    length = 1
    while length < n:
        step = min(length, n - length)
        x = np.minimum(x[: len(x) - step], x[step:])
        length += step
    return x


class Frequent:
    """Lossy counting: all hashes with a share of ``share`` or more of those added, with counts that miss half of that at most.
    ``missed`` is what a hash may have stood before it was taken up. Holds a number of hashes bounded by the share."""

    def __init__(self, share: float):
        self.share, self.total = share, 0
        self.values, self.counts, self.missed = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0)

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        values, counts = np.unique(hashes, return_counts=True)
        everything = np.concatenate([self.values, values])
        missed = np.concatenate([self.missed, np.full(len(values), self.total * self.share / 2)])
        order = np.argsort(everything, kind="stable")  # of equal ones the older comes first
        first = np.flatnonzero(np.concatenate([[True], everything[order][1:] != everything[order][:-1]]))
        sums = np.add.reduceat(np.concatenate([self.counts, counts])[order], first)
        self.total += len(hashes)
        keep = sums + missed[order][first] > self.total * self.share / 2
        self.values, self.counts, self.missed = everything[order][first][keep], sums[keep], missed[order][first][keep]

    def often(self) -> tuple[np.ndarray, np.ndarray]:
        keep = self.counts >= max(8, self.total * self.share / 2)
        return self.values[keep], self.counts[keep]


def survey(docs: DataFrame, s: Settings) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and the sorted hashes of frequent runs. Each task reports its own frequent runs only, 2 / hot_share at
    most, and as many at most reach the driver (8 bytes each)."""
    small_batches(docs.sparkSession)

    def run(batches):
        frequent, size = Frequent(s.hot_share), 0
        for batch in batches:
            texts = byte_texts(batch)
            for a, b in in_slices(texts, 2 * LONGEST):
                lists = [t.split() for t in texts[a:b]]
                words = Words(b"\n".join(b" ".join(w) for w in lists if len(w) >= s.window) or b"-")
                frequent.add(words.hashes(words.windows(s.minimiser), s.minimiser) >> np.uint64(1))
                size += sum(map(len, texts[a:b]))
        values, counts = frequent.often()
        none = np.zeros(len(values), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(values.view(np.int64), 0)), pa.array(np.append(counts, frequent.total)), pa.array(np.append(none, size)), pa.array(np.append(none, 1).astype(bool))], ["run", "n", "bytes", "head"])
        release()

    found = docs.select("text").mapInArrow(run, "run long, n long, bytes long, head boolean").groupBy("head", "run").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    found = checkpointed(found)
    total = found.where("head").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    runs, size = total["n"] or 0, total["bytes"] or 0
    hot = found.where(~F.col("head") & (F.col("n") >= max(8, runs * s.hot_share / 2))).select("run").toArrow().column("run")
    return size, np.sort(np.asarray(hot.to_numpy(), dtype=np.int64).view(np.uint64))


class Group:
    """The documents of one group in a fixed order, and their distinct super-k-mers by bucket."""

    def __init__(self, table: pa.Table, s: Settings, hot: np.ndarray, buckets: int):
        self.n_words, self.texts = [], []
        for t in byte_texts(table):
            w = t.split()
            self.n_words.append(len(w))
            self.texts.append(b" ".join(w))
        self.strings: dict[int, dict[bytes, int]] = {}  # bucket -> string -> number in the bucket
        self.uses: dict[int, list[list[tuple[int, int]]]] = {}  # bucket -> number -> (document, first word)
        some = [d for d, n in enumerate(self.n_words) if n >= s.window]
        for a, b in in_slices([self.texts[d] for d in some], LONGEST):
            self.cut(some[a:b], s, hot, buckets)

    def cut(self, docs: list[int], s: Settings, hot: np.ndarray, buckets: int) -> None:
        words = Words(b"\n".join(self.texts[d] for d in docs))
        m, count = s.minimiser, len(words.owner)
        r = words.hashes(np.arange(count - m + 1), m) >> np.uint64(1)
        if len(hot):
            at = np.searchsorted(hot, r)
            r = np.where(hot[np.minimum(at, len(hot) - 1)] == r, r | HOT, r)
        least = sliding_min(r, s.window - m + 1)
        window = words.windows(s.window)
        value = least[window]
        fresh = np.concatenate([[True], (np.diff(window) != 1) | (value[1:] != value[:-1])])
        begin = np.flatnonzero(fresh)
        first, last = window[begin], window[np.append(begin[1:], len(window)) - 1]
        base = np.searchsorted(words.owner, np.arange(len(docs)))  # first word of each document
        doc = words.owner[first]
        to = (mix64(value[begin]) % np.uint64(buckets)).tolist()
        rows = zip(to, np.array(docs)[doc].tolist(), (first - base[doc]).tolist(), words.starts[first].tolist(), words.ends[last + s.window - 1].tolist(), strict=True)
        buffer, strings, uses = words.buffer, self.strings, self.uses
        for bucket, d, at, i, j in rows:
            own, string = strings.setdefault(bucket, {}), buffer[i:j]
            k = own.setdefault(string, len(own))
            used = uses.setdefault(bucket, [])
            if k == len(used):
                used.append([(d, at)])
            else:
                used[k].append((d, at))


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def repeated_windows(blob: bytes, more: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(string, first window, end) of runs of windows whose word sequence starts twice or more among all strings of the
    blob (one for each line), where a marked string counts twice. Windows are sorted by a hash; equal neighbours are
    compared byte by byte, and a hash that two different sequences share is settled by the sequences themselves."""
    words = Words(blob)
    at = words.windows(window)
    h, owner = words.hashes(at, window), words.owner[at]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    run = np.concatenate([[0], np.cumsum(~same)])
    a, b = words.starts[at], words.ends[at + window - 1]
    pairs = np.flatnonzero(same)
    differ = set()
    for k, i, j, m, n in zip(pairs.tolist(), a[order[pairs]].tolist(), b[order[pairs]].tolist(), a[order[pairs + 1]].tolist(), b[order[pairs + 1]].tolist(), strict=True):
        if blob[i:j] != blob[m:n]:
            differ.add(int(run[k]))
    total = np.bincount(run, weights=1 + more[owner[order]])
    repeated = np.zeros(len(at), dtype=bool)
    repeated[order] = total[run] >= 2
    for r in differ:
        members = order[np.flatnonzero(run == r)]
        times: dict[bytes, int] = {}
        keys = [blob[a[x] : b[x]] for x in members]
        for x, key in zip(members, keys, strict=True):
            times[key] = times.get(key, 0) + 1 + int(more[owner[x]])
        repeated[members] = [times[key] >= 2 for key in keys]
    within = at - np.searchsorted(words.owner, owner)
    on = repeated & np.concatenate([[True], ~repeated[:-1] | (np.diff(at) != 1)])  # starts of runs; a string's windows stand together
    off = repeated & np.concatenate([~repeated[1:] | (np.diff(at) != 1), [True]])
    begins, ends = np.flatnonzero(on), np.flatnonzero(off)
    return list(zip(owner[begins].tolist(), within[begins].tolist(), (within[ends] + 1).tolist(), strict=True))


def substring_dedup(docs: DataFrame, s: Settings = Settings(), carry: tuple = ()) -> DataFrame:  # noqa: B008
    """doc_id, text, ``carried`` (a struct of the columns named so, which may have any names), n_words, n_removed, removed
    (spans of words, [begin, end)) and kept_text (kept words joined by one space) for each row of ``docs``."""
    size, hot = survey(docs, s)
    groups = max(1, -(-size // s.group_bytes))
    buckets = max(1, -(-3 * size // s.group_bytes))  # super-k-mers overlap: about three times the text
    parts = lambda n: int(min(s.most_partitions, max(1, -(-n // s.partition_bytes))))
    names = ["doc_id", "text", *(["carried"] if carry else [])]
    dealt = docs.select("doc_id", "text", *([F.struct(*[F.col(quoted(c)) for c in carry]).alias("carried")] if carry else [])).withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))).repartition(parts(size), "grp")

    def send(table: pa.Table) -> pa.Table:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        group = Group(in_order(table), s, hot, buckets)
        g = table.column("grp")[0].as_py()
        rows = [(b, g, compress(b"\n".join(own)), bytes(len(x) > 1 for x in group.uses[b])) for b, own in group.strings.items()]
        b, g, z, more = zip(*rows, strict=True) if rows else ((), (), (), ())
        del group
        release_now_and_then()
        return pa.table({"bucket": pa.array(b, pa.int64()), "grp": pa.array(g, pa.int64()), "z": pa.array(z, pa.binary()), "more": pa.array(more, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        table = table.sort_by("grp")
        number: dict[bytes, int] = {}  # each distinct string once, whatever the number of groups that sent it
        twice: list[int] = []
        refs: list[list[int]] = []  # of each part: its strings' numbers
        for z, more in zip(table.column("z"), table.column("more"), strict=True):
            own = []
            for string, again in zip(expand(z.as_py()).split(b"\n"), more.as_py(), strict=True):
                k = number.setdefault(string, len(number))
                if k == len(twice):
                    twice.append(again)
                else:
                    twice[k] = 1
                own.append(k)
            refs.append(own)
        runs: dict[int, list[int]] = {}
        for k, a, b in repeated_windows(b"\n".join(number), np.array(twice, dtype=np.int64), s.window):
            runs.setdefault(k, []).extend((a, b))
        del number, twice
        release_now_and_then(64)
        g, bucket = table.column("grp").to_pylist(), table.column("bucket")[0].as_py()
        out: list[tuple] = []
        for grp, own in zip(g, refs, strict=True):
            answer = [x for at, k in enumerate(own) if k in runs for a, b in zip(runs[k][::2], runs[k][1::2], strict=True) for x in (at, a, b)]
            if answer:
                out.append((grp, np.array(answer, dtype=np.int32).tobytes()))
        return pa.table({"grp": pa.array([x for x, _ in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64()), "runs": pa.array([x for _, x in out], pa.binary())})

    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in names)

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        group = Group(table, s, hot, buckets)
        marks: dict[int, np.ndarray] = {}
        for bucket, runs in zip(answers.column("bucket").to_pylist(), answers.column("runs").to_pylist(), strict=True):
            for k, a, b in np.frombuffer(runs, dtype=np.int32).reshape(-1, 3).tolist():
                for d, first in group.uses[bucket][k]:
                    mark = marks.get(d)
                    if mark is None:
                        mark = marks[d] = np.zeros(group.n_words[d] + 1, dtype=np.int64)
                    mark[first + a] += 1
                    mark[first + b + s.window - 1] -= 1
        release_now_and_then()
        removed, spans, kept = [], [], []
        for d, text in enumerate(group.texts):
            mark = marks.get(d)
            if mark is None:
                removed.append(0)
                spans.append([])
                kept.append(text)
                continue
            gone = np.cumsum(mark[:-1]) > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            removed.append(int(gone.sum()))
            spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            kept.append(b" ".join(w for w, x in zip(text.split(b" "), gone.tolist(), strict=True) if not x))
        more = [pa.array(group.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays([*(passed(table.column(c)) for c in names), *more], [*names, "n_words", "n_removed", "removed", "kept_text"])

    sent = dealt.groupBy("grp").applyInArrow(send, "bucket long, grp long, z binary, more binary")
    answers = sent.repartition(parts(3 * size), "bucket").groupBy("bucket").applyInArrow(count, "grp long, bucket long, runs binary").repartition(parts(size), "grp")
    out = f"{kinds}, n_words long, n_removed long, removed array<struct<begin:bigint,end:bigint>>, kept_text string"
    return dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(apply, out)


def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, unnest(range(1, CAST(len(w) - 33 AS BIGINT))) AS i FROM d WHERE len(w) >= 35),
k AS MATERIALIZED (SELECT p.r, p.i, sha256(array_to_string(d.w[p.i : p.i + 34], ' ')) AS h FROM p JOIN d ON d.r = p.r),
t AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT k.r, k.i + o.o AS i FROM k JOIN t ON t.h = k.h CROSS JOIN (SELECT unnest(range(35)) AS o) o),
x AS (SELECT r, list(i) AS gone, count(*) AS n FROM g GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN x.n IS NULL THEN d.w
         ELSE list_filter(d.w, lambda y, i: NOT list_contains(x.gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x ON x.r = d.r
"""
