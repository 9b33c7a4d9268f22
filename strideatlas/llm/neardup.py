"""Operator 10, MinHash near-dedup by a multi-index Hamming join.

Signatures are ``chunks * per_chunk`` b-bit MinHash values. Two signatures that differ in at most
``chunks * (errors + 1) - 1`` values agree in some chunk up to ``errors`` values (pigeonhole), so every choice of
``per_chunk - errors`` values of a chunk becomes a key, and all such pairs meet under a key. Links are confirmed on the full
shingle sets with whole numbers, 100 * intersection >= percent * union.

Rows of equal word sequences (a cryptographic digest) are one class first; texts of equal sets but other sequences meet under
all keys and are confirmed like any pair. Under each key the members are compared with the key's smallest, links become
components, and only under keys where several components are left the members of different components are compared as well:
pair by pair, or, where ``hub`` nodes or more share their pivots or a key, in blocks, where each text comes once into each block task
and reports one link for each other component. So no group is ever expanded into all its pairs, and still no pair that shares a key and could join two components
goes unchecked. Hot keys are salted, hot classes and nodes are left to skewed-join splitting; texts travel compressed.

Defined results: null and empty texts have an empty set, link with nothing and are kept; a text with fewer words than a
shingle is one shingle; repeated rows are one class; rows that share a doc_id are one node; a null doc_id is left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, checkpointed, documents, map_batches, mix64, release, release_now_and_then
from .components import components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    chunks: int = 16
    per_chunk: int = 6
    errors: int = 1
    salts: int = 8
    hub: int = 16
    block: int = 512
    seed: int = 20

    @property
    def values(self) -> int:
        return self.chunks * self.per_chunk

    @property
    def distance(self) -> int:
        """Pairs up to this signature distance are guaranteed to meet."""
        return self.chunks * (self.errors + 1) - 1


ODD = np.uint64(0xA24BAED4963EE407)


def shingle_hashes(words: list[bytes], n: int, known: WordHashes) -> np.ndarray:
    """Distinct hashes of the n-word shingles, sorted; fewer words are one shingle, none is empty."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = known.of(words)
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix64(out * ODD + h[i : len(h) - n + 1 + i])
    return np.unique(mix64(out + np.uint64(n)))


def shingle_set(text: bytes, n: int) -> set:
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else {tuple(words)} - {()}


class Sketch:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.flip = rng.integers(0, 1 << 64, size=(s.values, 1), dtype=np.uint64)
        self.factor = rng.integers(0, 1 << 64, size=(s.values, 1), dtype=np.uint64) | np.uint64(1)

    def signature(self, x: np.ndarray) -> np.ndarray:
        """16-bit values: the low bits of the mixed minimum under each of the permutations."""
        least = np.full(self.s.values, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(x), 2048):
            np.minimum(least, ((x[at : at + 2048] ^ self.flip) * self.factor).min(axis=1), out=least)
        return (mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (digest of the word sequence), sig (null for an empty set). Shingles are counted by
    64-bit hashes: among a million of one text two are mistaken for one with a chance of 3e-8."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    state: dict = {}

    def run(batch):
        from hashlib import blake2b

        known = state.setdefault("known", WordHashes(seed=s.seed))
        sketch = state.setdefault("sketch", Sketch(s))
        out: list[list] = [[], [], [], []]
        for text in byte_texts(batch):
            words = text.lower().split()
            x = shingle_hashes(words, s.words, known)
            both = np.frombuffer(blake2b(b" ".join(words), digest_size=16).digest(), dtype=np.int64)
            for column, value in zip(out, (len(x), int(both[0]), int(both[1]), sketch.signature(x).tobytes() if len(x) else None), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles long, h1 long, h2 long, sig binary")


def chunk_keys(classes: DataFrame, s: Settings) -> DataFrame:
    """key, node, n: a row for each chunk of a signature and each choice of its values that may be wrong."""
    from itertools import combinations

    dropped = list(combinations(range(s.per_chunk), s.errors))

    def run(batch):
        node, n = batch.column("node").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
        for at in range(0, len(node), 4096):
            sig = np.frombuffer(b"".join(batch.column("sig")[at : at + 4096].to_pylist()), dtype=np.uint16).reshape(-1, s.chunks, s.per_chunk).astype(np.uint64)
            keys = []
            for w, drop in enumerate(dropped):
                h = (np.arange(s.chunks, dtype=np.uint64) * np.uint64(len(dropped)) + np.uint64(w + 1))[None, :] * ODD
                for i in range(s.per_chunk):
                    if i not in drop:
                        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + sig[:, :, i])
                keys.append(h)
            keys = np.concatenate(keys, axis=1)
            per = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(node[at : at + 4096], per)), pa.array(np.repeat(n[at : at + 4096], per))], ["key", "node", "n"])

    kind = classes.schema["node"].dataType.simpleString()
    return map_batches(classes.select("node", "n", "sig"), run, f"key long, node {kind}, n int")


def shared_members(classes: DataFrame, s: Settings) -> DataFrame:
    """key, node, n, pivot for keys of two nodes or more; the pivot is the smallest node. Nearly all keys stand alone, so
    pivots are few, and they are repeated for each salt to spread the members of a hot key."""
    keys = chunk_keys(classes, s)
    pivots = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last")
    pivots = pivots.select("key", "pivot", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("salt"))
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(s.salts)).cast("int"))
    return salted.join(pivots.hint("merge"), ["key", "salt"]).drop("salt")


def near_size(a, b, s: Settings):
    """Sets of such sizes can reach the similarity at all."""
    return F.lit(100) * F.least(a, b) >= F.lit(s.percent) * F.greatest(a, b)


def packed_texts(docs: DataFrame) -> DataFrame:
    """node, z: texts compressed for the way; they are lower-cased, as shingles are."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([compress(t.lower()) for t in byte_texts(batch)], pa.binary())], ["node", "z"])

    return map_batches(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), run, f"node {kind}, z binary")


def confirmed(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity."""
    texts = packed_texts(docs)
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    joined = joined.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        last, first = None, set()
        for batch in batches:
            keep = []
            for za, zb in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
                if za != last:
                    last, first = za, shingle_set(expand(za), s.words)
                second = shingle_set(expand(zb), s.words)
                both = len(first & second)
                keep.append(both > 0 and 100 * both >= s.percent * (len(first) + len(second) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])
        last, first = None, set()
        release()

    return joined.select("a", "b", "za", "zb").mapInArrow(run, f"a {kind}, b {kind}")


def block_links(tasks: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """tasks (task, side, node, label) -> (a, b): for each node of side 1 and each other label of side 0 one node that it
    links with, if there is one. Each text comes once into each task, whatever the number of its pairs there."""
    kind = tasks.schema["node"].dataType.simpleString()
    rows = tasks.join(packed_texts(docs), "node")

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        expand, known = zstandard.ZstdDecompressor().decompress, WordHashes(seed=s.seed)
        table = table.sort_by([("side", "ascending"), ("node", "ascending"), ("z", "ascending")])
        side, node, label, z = (table.column(c).to_pylist() for c in ("side", "node", "label", "z"))
        sets = [shingle_hashes(expand(x).split(), s.words, known) for x in z]
        n = sum(x == 0 for x in side)
        found: list[tuple] = []
        if n:
            sizes = np.array([len(x) for x in sets[:n]])
            flat, owner = np.concatenate(sets[:n]), np.repeat(np.arange(n), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in range(n, len(side)):
                left, right = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                span = right - left
                at = np.repeat(left - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
                both = np.bincount(owner[at], minlength=n)
                linked = {label[i]}
                for k in np.flatnonzero((both > 0) & (100 * both >= s.percent * (sizes + len(sets[i]) - both))).tolist():
                    if label[k] not in linked:
                        one, two = shingle_set(expand(z[k]), s.words), shingle_set(expand(z[i]), s.words)
                        if 100 * len(one & two) >= s.percent * len(one | two):
                            linked.add(label[k])
                            found.append((node[k], node[i]))
        t = table.schema.field("node").type
        del sets, z, known
        release_now_and_then()
        return pa.table({"a": pa.array([x for x, _ in found], t), "b": pa.array([x for _, x in found], t)})

    return rows.groupBy("task").applyInArrow(run, f"a {kind}, b {kind}")


def cross_links(members: DataFrame, labels: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links between nodes of different components that share a key."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    sized = labels.join(sizes, "label").select("node", "label", "size")
    named = members.select("key", "node", "n").join(sized, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("size", F.coalesce("size", F.lit(1)))
    mixed = named.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
    rest = named.drop("size").join(mixed.select("key", F.col("top.label").alias("top")).hint("merge"), "key")
    # nodes that share pivots lie together: a node's cluster is the smallest of its keys' pivots
    clusters = members.groupBy("node").agg(F.min("pivot").alias("cluster"))
    counts = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    place = clusters.join(counts, "cluster").select("node", F.when(F.col("members") >= s.hub, F.col("cluster")).alias("c"), F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / F.lit(s.block))).cast("int").alias("b"))
    placed = checkpointed(rest.join(place, "node"))
    # pair by pair where both lie in small clusters, unless many such share the key
    small = placed.where("c IS NULL").select("key", "node", "n", "label")
    crowds = small.groupBy("key").agg(F.count("*").alias("crowd"))
    one = small.join(crowds.where(F.col("crowd") < s.hub).select("key"), "key")
    two = one.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    pairs = one.join(two, "key").where((F.col("label") < F.col("label2")) & near_size(F.col("n"), F.col("n2"), s))
    direct = confirmed(pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct(), docs, s)
    # under a crowded key, each block of its nodes against each block from itself on
    crowded = small.join(crowds.where(F.col("crowd") >= s.hub), "key").withColumn("blocks", F.ceil(F.col("crowd") / F.lit(s.block)).cast("int")).withColumn("b", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    within = crowded.select("key", F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("o"), F.lit(0).alias("side"), "node", "label")
    against = crowded.select("key", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("o"), F.lit(1).alias("side"), "node", "label")
    by_key = within.unionByName(against).select(F.xxhash64("key", "i", "o", F.lit("key")).alias("task"), "side", "node", "label")
    # a block of a large cluster against all that met it from outside, and against the cluster's nodes of lesser components
    blocks = placed.where("c IS NOT NULL").select("key", F.col("c").alias("hub"), F.col("b").alias("i")).distinct()
    outside = placed.join(blocks, "key").where("c IS NULL OR c <> hub").select("hub", "i", "node", "label").distinct()
    lesser = placed.where("c IS NOT NULL AND label <> top").select(F.col("c").alias("hub"), "node", "label").distinct()
    lesser = lesser.join(placed.where("c IS NOT NULL").select(F.col("c").alias("hub"), F.col("b").alias("i")).distinct(), "hub").select("hub", "i", "node", "label")
    met = checkpointed(outside.unionByName(lesser))
    outer_blocks = met.groupBy("hub", "i").agg(F.ceil(F.count("*") / F.lit(s.block)).cast("int").alias("outer"))
    outer = met.join(outer_blocks, ["hub", "i"]).select("hub", "i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("outer")).cast("int").alias("o"), F.lit(1).alias("side"), "node", "label")
    inside = placed.where("c IS NOT NULL").select(F.col("c").alias("hub"), F.col("b").alias("i"), "node", "label").distinct()
    inner = inside.join(outer_blocks, ["hub", "i"]).select("hub", "i", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("o"), F.lit(0).alias("side"), "node", "label")
    tasks = inner.unionByName(outer).select(F.xxhash64("hub", "i", "o").alias("task"), "side", "node", "label")
    return direct.unionByName(block_links(tasks.unionByName(by_key), docs, s))


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    rows = checkpointed(sketches(docs, s))
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").cast("int").alias("n"), F.first("sig").alias("sig"))
    same_id = full.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")
    classes = checkpointed(classes)
    # a doc_id with several texts is one node, so it links the classes it stands in
    bridges = full.join(same_id, "doc_id", "left_semi").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    members = checkpointed(shared_members(classes, s))
    star = members.where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "n").distinct()
    star = star.join(classes.select(F.col("node").alias("a"), F.col("n").alias("pivot_n")), "a").where(near_size(F.col("n"), F.col("pivot_n"), s)).select("a", "b")
    links = confirmed(star, docs, s)
    labels = components(links if same_id.isEmpty() else links.unionByName(bridges))
    more = checkpointed(cross_links(members, labels, docs, s))
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    named = classes.select("h1", "h2", "node").join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("component"))
    out = rows.drop("sig").join(named, ["h1", "h2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op10_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), Settings(words=2))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS MATERIALIZED (SELECT d.doc_id, count(s.g) AS n FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.both >= 80 * (x.n + y.n - p.both)),
v AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c0 AS (SELECT doc_id, doc_id AS label FROM n)"""
for _k in range(10):  # labels fall to the smallest neighbour's, then jump to their label's label
    OP10_SQL += f""",
m{_k} AS MATERIALIZED (SELECT c.doc_id, least(c.label, coalesce(min(o.label), c.label)) AS label FROM c{_k} c LEFT JOIN v ON v.a = c.doc_id LEFT JOIN c{_k} o ON o.doc_id = v.b GROUP BY c.doc_id, c.label),
c{_k + 1} AS MATERIALIZED (SELECT m.doc_id, o.label FROM m{_k} m JOIN m{_k} o ON o.doc_id = m.label)"""
OP10_SQL += """
SELECT d.doc_id, n.n AS n_shingles, c10.label AS component_id, d.doc_id = c10.label AS kept
FROM d JOIN n ON n.doc_id = d.doc_id JOIN c10 ON c10.doc_id = d.doc_id"""
