"""Operator 6, packing: best-fit decreasing into windows of ``window`` tokens.

Texts become ids by the tokenizer file at ``vocabulary`` (a path, read where the ids are made); each document ends in
``end_id``. Overlong documents are first cut into full windows, which are sequences of their own. Rests, each shorter than a
window, are packed by decreasing length; a segment tree indexed by remaining capacity finds the tightest open window. Rests
are dealt by a hash of ids, doc_id and block of repeated rows into groups of about ``group_rows`` documents. A partition is
read in order of its groups: full windows pass straight through, and only one group's rests are held at a time, so a task's
memory is bounded by group_rows * window ids whatever the length of a document or the number of its copies. Sequence ids
are (group << 32) + number in the group.

Windows that stay open at the end of a group are dissolved as long as that saves padding: their tokens, cut freely, fill
whole windows and then powers of two, which need none.

Defined results: null counts as empty, which is the end id alone; repeated rows are packed each by itself; no document,
no sequence; further columns of the input never take part. Only the digest of ids travels with full windows unless
``keep_ids``.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK, documents, release, small_batches


@dataclass(frozen=True)
class Settings:
    window: int = 1024
    end_id: int = 0
    group_rows: int = 1024
    keep_ids: bool = False


#: Fixed value: how a byte-level vocabulary pre-splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts of characters that every Unicode version since long classes alike, so that all pattern engines split them alike.
SURE = re.compile(r"[\t-\r\x20-\x84\x86-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
#: Runs that a pattern engine may fail on; only looked for in texts as long.
LONG_RUN = 5000
LONG = re.compile(rf"[ \t-\r]{{{LONG_RUN}}}|[^ \t-\r]{{{LONG_RUN}}}")

#: Where a text may be cut without changing its ids: after a character that is surely no blank, before one that surely is.
#: No token of a byte-level vocabulary has a blank behind another character, so a blank there starts anew.
CUT = re.compile(r"(?<=[^\s\u180e])(?=[ \t-\r])")
BLANKS = frozenset(" \t\n\x0b\x0c\r")


class Ids:
    """Ids of texts as little-endian 32-bit bytes, those of the tokenizer in the file ``vocabulary``.

    The tokenizer itself takes several times the CPU of an encoder over the same file's merges and the same split pattern, so
    that one encodes texts where both surely agree: no added token, no very long run, only characters in ``SURE``. All others
    go to the tokenizer. They are cut before blanks into words; words that are not known yet are encoded in one string, which
    the tokens' lengths in bytes cut again; what came out is kept up to ``most_bytes``. A file of another kind (no plain
    byte-level split) has all its texts encoded whole by the tokenizer."""

    def __init__(self, vocabulary: str, most_bytes: int = 24_000_000, step: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most_bytes, self.step = Tokenizer.from_file(vocabulary), most_bytes, step
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        split, added, model = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", []), spec["model"]
        plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.by_word = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        tokens = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(tokens.values()) + 1, dtype=np.int64)
        for token, i in tokens.items():
            self.token_bytes[i] = len(token)  # a byte-level token spells each byte by one character
        for t in added:
            self.token_bytes[t["id"]] = len(t["content"].encode())
        self.fast = self.merges(model["vocab"], {t["content"] for t in added}) if self.by_word else None
        self.known: dict[str, bytes] = {}
        self.bytes = 0

    @staticmethod
    def merges(vocabulary: dict, added: set):
        """An encoder from the vocabulary's own tokens, which spell bytes by printable characters; ids are merge ranks."""
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in printable}
        spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(spelled[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def sure(self, text: str) -> bool:
        """Both encoders surely agree on the text."""
        return self.fast is not None and SURE.fullmatch(text) is not None and not (self.added and self.added.search(text)) and not (len(text) >= LONG_RUN and LONG.search(text))

    def of(self, text: str) -> bytes:
        if self.sure(text):
            return np.array(self.fast(text), dtype="<u4").tobytes()
        return self.by_tokenizer(text)

    def by_tokenizer(self, text: str) -> bytes:
        if not self.by_word:
            return self.encoded(text).tobytes()
        parts, at = [], 0
        while len(text) - at > self.step:  # a very long text goes a slice at a time
            found = CUT.search(text, at + self.step)
            end = found.start() if found else len(text)
            parts.append(self.of_words(CUT.split(text[at:end])))
            at = end
        return b"".join([*parts, self.of_words(CUT.split(text[at:]))])

    def of_words(self, words: list[str]) -> bytes:
        if self.bytes > self.most_bytes:
            self.known.clear()
            self.bytes = 0
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        alone = [w for w in fresh if not w or w[0] not in BLANKS or w[-1].isspace() or w[-1] == "\u180e"]  # the ends of a text
        for w in alone:
            known[w] = self.encoded(w).tobytes()
        if len(fresh) > len(alone):
            together = [w for w in fresh if w not in known]
            ids = self.encoded("".join(together))
            ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(w.encode()) for w in together])) + 1
            ids_bytes, begin = ids.tobytes(), 0
            for w, end in zip(together, (4 * ends).tolist(), strict=True):
                known[w] = ids_bytes[begin:end]
                begin = end
        self.bytes += sum(len(w) + len(known[w]) + 120 for w in fresh)
        return b"".join(map(known.__getitem__, words))


@cache
def ids_by(vocabulary: str) -> Ids:
    return Ids(vocabulary)


def token_ids(text: str, vocabulary: str, end_id: int = 0) -> np.ndarray:
    """Ids of a text and the end id behind them."""
    return np.append(np.frombuffer(ids_by(vocabulary).of(text), dtype="<u4"), np.array([end_id], dtype="<u4"))


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least capacity that holds a piece."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with room for ``need``, taken out of the tree."""
        i = self.leaves + need
        while not self.count[i]:
            while i & 1:  # a right child: what lies to its right hangs above
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last node of the level
                return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], dict[int, int]]:
    """For lengths in decreasing order: each piece's window and offset, and the windows' remaining capacities."""
    tree, at, offsets, left = CapacityTree(window), [], [], {}
    for n in lengths:
        found = tree.take(n)
        capacity, w = found if found else (window, len(left))
        at.append(w)
        offsets.append(window - capacity)
        left[w] = capacity - n
        if capacity > n:
            tree.add(capacity - n, w)
    return at, offsets, left


def padding(used: int, window: int) -> int:
    """A sequence is padded to the window unless its length is a power of two."""
    return 0 if used & (used - 1) == 0 else window - used


def pack_lengths(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start in the piece, length). Windows that would be padded by more than a 64th of the window
    are dissolved and their pieces cut to fill windows, then powers of two."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    at, _, left = best_fit_decreasing([lengths[i] for i in order], window)
    bins: list[list[int]] = [[] for _ in left]
    for i, w in zip(order, at, strict=True):
        bins[w].append(i)
    out, loose = [], []
    for w, own in enumerate(bins):
        if padding(window - left[w], window) > window // 64:
            loose += own
        else:
            out.append([(i, 0, lengths[i]) for i in own])
    total = sum(lengths[i] for i in loose)
    rooms = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if total % window >> b & 1]
    rest = [(i, 0, lengths[i]) for i in reversed(loose)]
    for room in rooms:
        seq = []
        while room:
            i, start, n = rest.pop()
            take = min(n, room)
            seq.append((i, start, take))
            room -= take
            if n > take:
                rest.append((i, start + take, n - take))
        out.append(seq)
    return out


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_windows(docs: DataFrame, vocabulary: str, s: Settings, groups: int) -> DataFrame:
    """A row for each full window of a document and one for its rest, with the group it is dealt to; ``spread`` (a long)
    tells rows of equal ids apart. Full windows need their ids no more, so they carry them only if those are kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["grp", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    small_batches(docs.sparkSession)

    def pieces(batch: pa.RecordBatch):
        """Rows of a few documents at a time: about ``most`` bytes of ids are held."""
        import xxhash
        import zlib

        of, end, size, most = ids_by(vocabulary).of, np.array([s.end_id], dtype="<u4").tobytes(), 4 * s.window, 4_000_000
        out: list[list] = [[] for _ in range(7)]
        held = 0
        for at, (text, spread) in enumerate(zip(batch.column("text"), batch.column("spread").to_pylist(), strict=True)):
            ids = of(text.as_py() or "") + end
            group = xxhash.xxh3_64_intdigest(ids, spread & MASK) % groups
            for start in range(0, len(ids), size):
                part = ids[start : start + size]
                kept = part if s.keep_ids or len(part) < size else None
                for column, value in zip(out, (at, group, start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, kept), strict=True):
                    column.append(value)
                held += 64 + len(kept or b"")
                if held > most:
                    yield rows_of(batch, out)
                    out, held = [[] for _ in range(7)], 0
        if out[0]:
            yield rows_of(batch, out)

    def rows_of(batch, out):
        types = (*[pa.int64()] * 5, pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], types, strict=True))], ["doc_id", *names])

    def run(batches):
        try:
            for batch in batches:
                yield from pieces(batch)
        finally:
            release()

    return docs.select("doc_id", "text", "spread").mapInArrow(run, f"doc_id {kind}, grp long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def spread_rows(docs: DataFrame, block: int) -> tuple[DataFrame, int]:
    """doc_id, text and ``spread``, by which copies of a text are dealt to many groups, and the number of rows.

    ``spread`` is a hash of doc_id. Ids of more than ``block`` rows also take a block number: their equal rows are counted,
    and each count is laid out anew in blocks of at most ``block``, so no task numbers or holds all rows of an id."""
    docs = docs.select("doc_id", "text")
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    plain = lambda df: df.withColumn("spread", F.xxhash64("doc_id"))
    if most <= block:
        return plain(docs), total
    many = F.broadcast(counts.where(F.col("n") > block).select(F.col("doc_id").alias("many_id")))
    same = F.col("doc_id").eqNullSafe(F.col("many_id"))
    copies = docs.join(many, same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    blocks = copies.select("doc_id", "text", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")).alias("block"))
    dealt = blocks.repartition("doc_id", "text", "block").withColumn("spread", F.xxhash64("doc_id", "block"))
    rows = dealt.select("doc_id", "text", "spread", F.explode(F.expr(f"sequence(1L, least({block}, n - block * {block}))")).alias("nth"))
    return plain(docs.join(many, same, "left_anti")).unionByName(rows.drop("nth")), total


def pack(docs: DataFrame, vocabulary: str, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if kept).

    The id column is doc_id. Groups are dealt by a hash of ids, doc_id and, for repeated rows, the block of the row, so a
    group is the same in every run and copies of one text lie in many groups."""
    dealt, total = spread_rows(docs, max(1, s.group_rows // 4))
    groups = max(1, -(-total // s.group_rows))
    rows = cut_windows(dealt, vocabulary, s, groups)
    # a group's full windows come first, then its rests by decreasing length
    in_order = rows.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "start", "doc_tokens", "ids_crc32")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if s.keep_ids else [])]

    def full_windows(rows: pa.RecordBatch, base: int) -> pa.RecordBatch:
        n = rows.num_rows
        own = [rows.column(c) for c in names[:5]]
        return pa.RecordBatch.from_arrays([*own, pa.array(np.arange(base, base + n)), pa.array(np.zeros(n, dtype=np.int64)), *([rows.column("ids")] if s.keep_ids else [])], names)

    def rests(slices: list[pa.RecordBatch], base: int) -> pa.RecordBatch:
        import zlib

        table = pa.Table.from_batches(slices).combine_chunks()
        start, length, crc, tokens = (table.column(c).to_pylist() for c in names[1:5])
        ids, out = table.column("ids").to_pylist(), [[] for _ in range(8)]
        for k, sequence in enumerate(pack_lengths(length, s.window)):
            offset = 0
            for i, a, n in sequence:
                part = ids[i][4 * a : 4 * (a + n)]
                for column, value in zip(out, (i, start[i] + a, n, crc[i] if n == length[i] else zlib.crc32(part), tokens[i], base + k, offset, part if s.keep_ids else None), strict=True):
                    column.append(value)
                offset += n
        own = [table.column("doc_id").combine_chunks().take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:7])]
        return pa.RecordBatch.from_arrays([*own, *([pa.array(out[7], pa.binary())] if s.keep_ids else [])], names)

    def run(batches):
        group, number, waiting = None, 0, []
        for batch in batches:
            groups_ = batch.column("grp").to_numpy()
            full = batch.column("length").to_numpy() == s.window
            edges = np.flatnonzero(np.diff(groups_)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(groups_)], strict=True):
                if a == b:
                    continue
                if group != groups_[a]:
                    if waiting:
                        yield rests(waiting, (group << 32) + number)
                    group, number, waiting = int(groups_[a]), 0, []
                n = int(full[a:b].sum())
                if n:
                    yield full_windows(batch.slice(a, n), (group << 32) + number)
                    number += n
                if a + n < b:
                    waiting.append(batch.slice(a + n, b - a - n))
        if waiting:
            yield rests(waiting, (group << 32) + number)
        waiting = []
        release()

    more = ", ids binary" if s.keep_ids else ""
    return in_order.mapInArrow(run, f"doc_id {kind}, {PIECE}{more}")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
