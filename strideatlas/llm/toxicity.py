"""Operator 2, toxicity: a convolutional text classifier in numpy.

Every word is the mean of a few hashed embeddings (the word and its prefixes), filters of widths 1, 2 and 3 run over the
word sequence, each filter's maximum over the document goes to a logistic output. The network learns on the driver from a
bounded sample of labelled rows, taken in the order of a hash of doc_id (``most_toxic``, ``most_clean`` rows and ``most_bytes``
of texts). Scoring covers every whole text in Arrow batches with no shuffle. Scores never see labels, lang, source or doc_id.

Scores are calibrated over all labelled rows that were not fitted: their logits are counted in Spark by language, label and
bin, and the scale of the logistic output and a threshold for each language follow from the counts. Only the verdict
``rejected`` uses thresholds. Rows whose crc32(doc_id) mod 5 is 0 take part in nothing.

Word vectors and filters are whole multiples of powers of two, small enough that every response is exact in single precision,
and the output sums in one order: a text's score is the same in any batch, on any machine and in a plain loop.

Defined results: null and empty texts are scored as a text without words; a language without both labels in calibration (null
too) takes the common threshold; without both classes among the labels every score is the share of toxic labels (0 if none);
of rows that share a doc_id one, the smallest, is learned from; repeated rows get the same score each; a further column named
like an output comes back as name_in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_remainder, carrying, checkpointed, documents, in_slices, release, small_batches


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    size: int = 12
    widths: tuple = (1, 2, 3)
    filters: int = 16
    prefixes: tuple = (5, 7)
    epochs: int = 6
    rate: float = 0.08
    batch: int = 32
    most_toxic: int = 2000
    most_clean: int = 4000
    most_bytes: int = 12_000_000  # of all texts that are learned from
    held: int = 4  # one in so many labelled rows is never learned from
    bins: int = 16  # of a logit, for each unit
    miss_cost: float = 2.0  # a toxic row that is let through counts like so many clean ones that are rejected
    shrink: float = 0.25  # weight of all languages' errors in a language's threshold
    seed: int = 7
    slice_bytes: int = 400_000


#: Units of word vectors and filters, and their largest size: sums of three words' products stay under 2^24 units.
VECTOR, MOST_VECTOR, FILTER, MOST_FILTER = 64, 8, 128, 4
LOGIT = 40  # logits are counted between minus and plus this

EDGES = bytes(i for i in range(128) if not chr(i).isalnum())


def features(word: bytes, s: Settings) -> tuple[int, ...]:
    """Buckets of a word: the word without marks at its ends, and its prefixes if it is longer."""
    from zlib import crc32

    w = word.strip(EDGES).lower()
    return (crc32(w) % s.buckets, *(crc32(w[:n], n) % s.buckets if len(w) > n else crc32(w) % s.buckets for n in s.prefixes))


@dataclass
class Net:
    s: Settings
    table: np.ndarray = None
    filters: dict = field(default_factory=dict)  # width -> (width, size, filters)
    bias: np.ndarray = None
    out: np.ndarray = None
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def __post_init__(self):
        if self.table is None:
            rng = np.random.default_rng(self.s.seed)
            self.table = rng.normal(0, 0.3, (self.s.buckets, self.s.size)).astype(np.float32)
            self.filters = {w: rng.normal(0, (w * self.s.size) ** -0.5, (w, self.s.size, self.s.filters)).astype(np.float32) for w in self.s.widths}
            self.bias = np.zeros(len(self.s.widths) * self.s.filters, dtype=np.float32)
            self.out = rng.normal(0, 0.2, len(self.bias)).astype(np.float32)

    def respond(self, x: np.ndarray) -> np.ndarray:
        """Responses of all filters at every word; the sequence ends in as many zero rows as the widest filter needs."""
        n, parts = len(x) - max(self.s.widths) + 1, []
        for w in self.s.widths:
            r = x[:n] @ self.filters[w][0]
            for k in range(1, w):
                r += x[k : n + k] @ self.filters[w][k]
            parts.append(r)
        return np.concatenate(parts, axis=1)

    def vectors_of(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of words by their buckets, as whole multiples of 1 / VECTOR."""
        total = self.table[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            total = total + self.table[ids[:, j]]
        return np.clip(np.rint(total * np.float32(VECTOR / ids.shape[1])) / np.float32(VECTOR), -MOST_VECTOR, MOST_VECTOR)

    def settle(self) -> None:
        """Filters become whole multiples of 1 / FILTER, the output double precision."""
        self.filters = {w: np.clip(np.rint(f * np.float32(FILTER)) / np.float32(FILTER), -MOST_FILTER, MOST_FILTER).astype(np.float32) for w, f in self.filters.items()}
        self.bias, self.out, self.out_bias = self.bias.astype(np.float64), self.out.astype(np.float64), float(self.out_bias)

    def probability(self, logit: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.scale * logit + self.shift))))


class Scorer:
    """Scores many texts with one net; word vectors are kept up to a bound on words and their bytes."""

    def __init__(self, net: Net, most: int = 100_000, most_bytes: int = 8_000_000):
        self.net, self.most, self.most_bytes = net, most, most_bytes
        self.clear()

    def clear(self):
        self.index: dict[bytes, int] = {b"": 0}
        self.bytes = 0
        self.vectors = np.zeros((1024, self.net.s.size), dtype=np.float32)

    def learn(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self.index]
        if not fresh:
            return
        first = len(self.index)
        self.index.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        self.bytes += sum(map(len, fresh))
        if len(self.index) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros((max(len(self.index) - len(self.vectors), len(self.vectors)), self.net.s.size), dtype=np.float32)])
        self.vectors[first : first + len(fresh)] = self.net.vectors_of(np.array([features(w, self.net.s) for w in fresh]))

    def tops(self, texts: list[bytes]) -> np.ndarray:
        """Each filter's maximum over each text."""
        if len(self.index) > self.most or self.bytes > self.most_bytes:
            self.clear()
        gap = [b""] * (max(self.net.s.widths) - 1)
        flat: list[bytes] = []
        ends = []
        for t in texts:
            flat += t.split() or [b""]
            ends.append(len(flat))
            flat += gap
        self.learn(set(flat))
        ids = np.fromiter(map(self.index.__getitem__, flat), dtype=np.int64, count=len(flat))
        starts = np.array([0, *(e + len(gap) for e in ends[:-1])])
        # texts stand apart by gaps; positions in a gap belong to no text
        step, tops = 1 << 16, []
        if len(ids) <= step:
            r = self.net.respond(self.vectors[ids])
            r = np.concatenate([r, np.full((1, r.shape[1]), -np.inf, dtype=r.dtype)])
            return np.maximum.reduceat(r, np.stack([starts, np.array(ends)], axis=1).ravel())[::2]
        for a, b in zip(starts.tolist(), ends, strict=True):  # a very long text goes a stretch at a time
            best = None
            for at in range(a, b, step):
                r = self.net.respond(self.vectors[ids[at : min(b, at + step) + len(gap)]]).max(axis=0)
                best = r if best is None else np.maximum(best, r)
            tops.append(best)
        return np.stack(tops)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        h = np.maximum(self.tops(texts).astype(np.float64) + self.net.bias, 0)
        total = np.full(len(h), self.net.out_bias)
        for j, weight in enumerate(self.net.out.tolist()):  # one filter after the other, so the order of the sum is fixed
            total += h[:, j] * weight
        return total


def fit(texts: list[bytes], labels: np.ndarray, s: Settings) -> Net:
    """Adagrad on the logistic loss, both classes weighing the same; gradients pass only through the maxima."""
    net, rng = Net(s), np.random.default_rng(s.seed + 1)
    positive = labels.mean() if len(labels) else 0.0
    if not 0 < positive < 1:
        net.constant = float(positive)
        return net
    index: dict[bytes, int] = {}
    docs = [np.fromiter((index.setdefault(w, len(index)) for w in (t.split() or [b""])), dtype=np.int32) for t in texts]
    feats = np.fromiter((b for w in index for b in features(w, s)), dtype=np.int32).reshape(len(index), -1)
    index.clear()
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
    params = {"table": net.table, "bias": net.bias, "out": net.out} | {w: net.filters[w] for w in s.widths}
    squares = {k: np.full_like(v, 1e-3) for k, v in params.items()}
    pad, bias_square = max(s.widths) - 1, 1e-3
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / (s.epochs + 1))
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            grads = {k: np.zeros_like(v) for k, v in params.items() if k != "table"}
            rows, steps, out_grad = [], [], 0.0
            for i in order[at : at + s.batch]:
                x = np.concatenate([net.table[feats[docs[i]]].mean(axis=1), np.zeros((pad, s.size), dtype=np.float32)])
                r = net.respond(x)
                best = r.argmax(axis=0)
                h = np.maximum(r[best, np.arange(r.shape[1])] + net.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30)))
                d = (p - labels[i]) * weight[i]
                out_grad += d
                grads["out"] += d * h
                through = d * net.out * (h > 0)
                grads["bias"] += through
                for j, w in enumerate(s.widths):
                    cols = slice(j * s.filters, (j + 1) * s.filters)
                    pos, g = best[cols], through[cols]
                    for k in range(w):
                        grads[w][k] += x[pos + k].T * g
                        real = pos + k < len(docs[i])
                        rows.append(docs[i][(pos + k)[real]])
                        steps.append((net.filters[w][k] * g).T[real])
            for k, g in grads.items():
                squares[k] += g * g
                params[k] -= rate * g / np.sqrt(squares[k])
            bias_square += out_grad**2
            net.out_bias -= rate * out_grad / np.sqrt(bias_square)
            rows_, steps_ = np.concatenate(rows), np.concatenate(steps) / feats.shape[1]
            buckets = feats[rows_].ravel()
            touched, where = np.unique(buckets, return_inverse=True)
            g = np.zeros((len(touched), s.size), dtype=np.float32)
            np.add.at(g, where, np.repeat(steps_, feats.shape[1], axis=0))
            squares["table"][touched] += g * g
            net.table[touched] -= rate * g / np.sqrt(squares["table"][touched])
    net.settle()
    return net


def logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve: it is 0.5 where a cut makes the fewest errors (the middle, if many do), so that a
    few labels that no word explains don't move it, and as steep as fits best (Newton's method, a little ridge towards 1)."""
    edges = np.unique(np.concatenate([z, [z.max() + 1]]))
    gain = np.bincount(np.searchsorted(edges, z, side="right"), weights=np.where(y == 1, weight, -weight), minlength=len(edges) + 1)
    errors = np.cumsum(gain[: len(edges)])  # below each edge: toxic rows missed less clean rows let through
    best = np.flatnonzero(errors <= errors.min() + 1e-9 * weight.sum())
    low = z[z < edges[best[0]]].max(initial=edges[best[0]] - 1)
    cut = float((low + edges[best[-1]]) / 2)
    x, scale, ridge = z - cut, 1.0, 1e-3 * weight.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(scale * x, -30, 30)))
        step = ((weight * (p - y) * x).sum() + ridge * (scale - 1)) / ((weight * p * (1 - p) * x * x).sum() + ridge)
        scale = min(5.0, max(0.05, scale - min(1.0, max(-1.0, step))))
        if abs(step) < 1e-9:
            break
    return scale, -scale * cut


def thresholds_of(net: Net, counts: list[tuple]) -> dict:
    """counts: (lang, label, bin, rows). A threshold for each language: the one with the fewest errors among its rows, of which
    all languages' errors count ``shrink``; ties go to the one nearest 0.5. Key None holds for every other language."""
    p = np.array([net.probability((c[2] + 0.5) / net.s.bins) for c in counts])
    y, weight = np.array([c[1] for c in counts]), np.array([c[3] for c in counts], dtype=float)
    grid = np.arange(0.30, 0.81, 0.05)
    wrong = np.stack([np.where(y == 1, p < t, p >= t) * weight for t in grid], axis=1)
    common, found = wrong.sum(axis=0), {}
    for lang in [None, *sorted({c[0] for c in counts if c[0] is not None})]:
        own = np.array([lang is None or c[0] == lang for c in counts])
        if len(set(y[own].tolist())) == 2:
            cost = wrong[own].sum(axis=0) + net.s.shrink * common
            found[lang] = round(float(min(zip(cost, abs(grid - 0.5), grid, strict=True))[2]), 2)
    return found


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1) of labelled documents that may be learned from."""
    return labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(bucket_remainder("doc_id", 5) != 0)


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[Net, DataFrame]:  # noqa: B008
    """The network, and the ids that it was fitted on. The driver gets the bounded sample."""
    order = F.xxhash64("doc_id", F.lit(s.seed))
    able = known_labels(labels).where(F.pmod(order, F.lit(s.held)) != 0)
    chosen = [able.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(most) for y, most in ((1, s.most_toxic), (0, s.most_clean))]
    sample = chosen[0].unionByName(chosen[1])
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("row"), F.min("toxic").alias("toxic"))
    found = checkpointed(found.select("doc_id", "toxic", order.alias("o"), F.col("row.text").alias("text")))
    left, ids = s.most_bytes, []
    for r in sorted(found.select("doc_id", "o", F.octet_length("text").alias("n")).collect(), key=lambda r: (r["o"], r["doc_id"])):
        if r["n"] <= left:
            left -= r["n"]
            ids.append(r["doc_id"])
    fitted = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {found.schema['doc_id'].dataType.simpleString()}")
    taken = found.join(F.broadcast(fitted), "doc_id").select("o", "doc_id", "toxic", F.col("text").cast("binary").alias("text")).toArrow().sort_by([("o", "ascending"), ("doc_id", "ascending")])
    net = fit(taken.column("text").to_pylist(), np.array(taken.column("toxic").to_pylist(), dtype=int), s)
    del taken
    release()
    return net, fitted


def calibrate(net: Net, scored: DataFrame, labels: DataFrame, fitted: DataFrame) -> dict:
    """scored (doc_id, lang, toxic_logit): sets the net's scale and shift and gives the thresholds by language, from all labelled
    rows that were not fitted. The driver gets counts by language, label and bin."""
    if net.constant is not None:
        return {None: 0.5}
    known = known_labels(labels)
    rest = known.join(F.broadcast(fitted), "doc_id", "left_anti")
    bin_ = F.floor(F.greatest(F.lit(-LOGIT), F.least(F.lit(LOGIT), F.col("toxic_logit"))) * net.s.bins).cast("int").alias("bin")
    counts = [tuple(r) for r in scored.join(rest, "doc_id").groupBy("lang", "toxic", bin_).agg(F.count("*").alias("n")).collect()]
    y, n = np.array([c[1] for c in counts]), np.array([c[3] for c in counts], dtype=float)
    if len(set(y.tolist())) < 2:
        return {None: 0.5}
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weight = {v: total[v] / n[y == v].sum() * (net.s.miss_cost if v else 1.0) for v in (0, 1)}  # fitted rows are missing, more of one label than of the other
    counts = [(*c[:3], c[3] * weight[c[1]]) for c in counts]
    net.scale, net.shift = logistic(np.array([(c[2] + 0.5) / net.s.bins for c in counts]), y.astype(float), np.array([c[3] for c in counts]))
    return {None: 0.5} | thresholds_of(net, counts)


def with_logit(docs: DataFrame, net: Net) -> DataFrame:
    """docs with ``toxic_logit``. Only texts go to Python and only numbers come back; other columns stay in the JVM. The net's
    size is fixed by its settings (some 2 MB)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = None if net.constant is not None else Scorer(net)
        for column in columns:
            texts = [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
            if scorer is None:
                yield pa.array([0.0] * len(texts), pa.float64())
            else:
                yield pa.array(np.concatenate([*(scorer.logits(texts[a:b]) for a, b in in_slices(texts, net.s.slice_bytes)), np.zeros(0)]))
        del scorer
        release()

    return docs.withColumn("toxic_logit", run("text"))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """docs with ``toxic_score``."""
    return with_score(with_logit(docs, net), net).drop("toxic_logit")


def with_score(scored: DataFrame, net: Net) -> DataFrame:
    """The logistic curve over logits, worked out by the JVM's strict exponential, so it is the same everywhere."""
    if net.constant is not None:
        return scored.withColumn("toxic_score", F.lit(float(net.constant)))
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(net.scale) * F.col("toxic_logit") + F.lit(net.shift)))
    return scored.withColumn("toxic_score", F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def judged(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), keep_text: bool = True) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` with toxic_score, the language's toxic_threshold and ``rejected``. Each text is scored once: rows are
    written with their logits (texts come back null unless ``keep_text``), then scale and thresholds follow from them."""
    made = ("toxic_score", "toxic_threshold", "rejected")

    def verdict(df: DataFrame) -> DataFrame:
        net, fitted = learn(df, labels, s)
        lang = F.col("lang") if "lang" in df.columns else F.lit(None).cast("string").alias("lang")
        scored = with_logit(df, net)
        scored = checkpointed(scored if keep_text else scored.withColumn("text", F.lit(None).cast("string")))
        thresholds = calibrate(net, scored.select("doc_id", lang, "toxic_logit"), labels, fitted)
        pairs = [x for k, v in thresholds.items() if k is not None for x in (F.lit(k), F.lit(v))]
        own = F.lit(thresholds[None])
        if pairs and "lang" in df.columns:
            own = F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce("lang", F.lit(""))), own)
        return with_score(scored, net).withColumn("toxic_threshold", own).withColumn("rejected", F.col("toxic_score") >= F.col("toxic_threshold"))

    return carrying(docs, ("doc_id", "text", "lang"), made, verdict)


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    scored = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_text=False).withColumnsRenamed({"toxic_score": "score", "toxic_threshold": "threshold"})
    return scored.select("doc_id", F.coalesce(bucket_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")
