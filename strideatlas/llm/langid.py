"""Operator 5, language ID by hierarchical discrimination.

First a linear support vector machine for each family (one against the rest) picks the family, then one-versus-one linear
support vector machines between the languages of that family vote. A document is the mean of its words' hashed character
n-grams, so each machine's output is a mean of word scores: words are scored once and kept up to a bound, and whole texts
are scored in Arrow batches with no shuffle. Training takes a bounded sample of labelled rows for each language.

Defined results: null text or text without a letter gives ``und`` and score 0; a language alone in its family needs no
second step; with one learned language all text with letters gets it; with none ``und``.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_remainder, byte_texts, documents, in_slices, mix64, small_batches

#: Families of closely related languages; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}


def has_letter(text: str) -> bool:
    """A character of category L; digits in circles, fractions and numerals of one character are none."""
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 12
    grams: tuple = (1, 2, 3)
    most_per_language: int = 1000
    longest: int = 20_000  # characters of a text that is taken to learn from
    epochs: int = 30
    penalty: float = 1e-5
    rate: float = 2.0
    slice_bytes: int = 1_500_000
    seed: int = 11


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v), lang)


def word_features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams and of the words themselves, word after word, and how many each word has.

    N-grams of all words are hashed at once over one array of code points."""
    from zlib import crc32

    marked = [f"<{w.lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # code points from here to the word's end
    buckets = [np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) % s.buckets for w in marked), dtype=np.int64, count=len(marked))]
    owners = [np.arange(len(marked))]
    for n in s.grams:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = codes[:m].copy()
        for i in range(1, n):
            h = h * np.uint64(0x9E6C63D0876A9A47) + codes[i : m + i]
        inside = left[:m] >= n
        buckets.append((mix64(h[inside] + np.uint64(n << 40)) % np.uint64(s.buckets)).astype(np.int64))
        owners.append(owner[:m][inside])
    owners_ = np.concatenate(owners)
    return np.concatenate(buckets)[np.argsort(owners_, kind="stable")], np.bincount(owners_, minlength=len(marked))


def machine(x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Linear SVM (squared hinge, both classes weighing the same) by Adagrad over shuffled blocks; y is 1 or -1."""
    rng = np.random.default_rng(s.seed)
    w, squares = np.zeros(x.shape[1] + 1, dtype=np.float32), np.full(x.shape[1] + 1, 1e-2, dtype=np.float32)
    share = (y > 0).mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(s.epochs):
        for block in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            margin = y[block] * (x[block] @ w[:-1] + w[-1])
            pull = np.maximum(0, 1 - margin) * y[block] * weight[block] / len(block)
            g = np.append(-(pull @ x[block]), -pull.sum()).astype(np.float32)
            g[:-1] += s.penalty * w[:-1]
            squares += g * g
            w -= s.rate / (1 + epoch / 10) * g / np.sqrt(squares)
    return w


@dataclass
class Model:
    s: Settings
    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # (buckets + 1, machines): the families' first, then the pairs'


def doc_vectors(texts: list[str], s: Settings) -> np.ndarray:
    """A row for each text: the mean over its words of each word's n-gram shares."""
    index: dict[str, int] = {}
    lists = [np.array([index.setdefault(w, len(index)) for w in t.split()], dtype=np.int64) for t in texts]
    flat, sizes = word_features(list(index), s)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros((len(texts), s.buckets), dtype=np.float32)
    for row, own in zip(out, lists, strict=True):
        values, counts = np.unique(own, return_counts=True)
        buckets = np.concatenate([flat[starts[v] : starts[v + 1]] for v in values]) if len(values) else np.zeros(0, dtype=np.int64)
        share = np.repeat(counts / np.maximum(1, sizes[values]), sizes[values]) if len(values) else np.zeros(0)
        row += np.bincount(buckets, weights=share, minlength=s.buckets) * (s.buckets**0.5 / max(1, len(own)))
    return out


def fit(texts: list[str], langs: list[str], s: Settings = Settings()) -> Model:  # noqa: B008
    languages = sorted(set(langs))
    members = {f: [x for x in languages if family_of(x) == f] for f in sorted({family_of(x) for x in languages})}
    families = list(members)
    pairs = [p for f in families for p in itertools.combinations(members[f], 2)]
    x = doc_vectors(texts, s)
    y, columns = np.array(langs), []
    group = np.array([family_of(a) for a in langs])
    for f in families:
        columns.append(machine(x, np.where(group == f, 1, -1), s) if len(families) > 1 else np.zeros(s.buckets + 1, dtype=np.float32))
    for a, b in pairs:
        own = (y == a) | (y == b)
        columns.append(machine(x[own], np.where(y[own] == a, 1, -1), s))
    weights = np.stack(columns, axis=1) if columns else np.zeros((s.buckets + 1, 0), dtype=np.float32)
    return Model(s, families, members, pairs, weights)


class Predictor:
    def __init__(self, model: Model, most: int = 100_000, most_bytes: int = 8_000_000):
        self.model, self.most, self.most_bytes = model, most, most_bytes
        self.scale = np.float32(model.s.buckets**0.5)
        self.clear()

    def clear(self):
        self.index: dict[bytes, int] = {}
        self.bytes = 0
        self.scores = np.zeros((1024, self.model.weights.shape[1]), dtype=np.float32)

    def learn(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self.index]
        if not fresh:
            return
        first = len(self.index)
        self.index.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        self.bytes += sum(map(len, fresh))
        if len(self.index) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(len(self.index) - len(self.scores), len(self.scores)), self.scores.shape[1]), dtype=np.float32)])
        at = 0
        for a, b in in_slices(fresh, 250_000):
            flat, sizes = word_features([w.decode(errors="replace") for w in fresh[a:b]], self.model.s)
            sums = np.add.reduceat(self.model.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            self.scores[first + at : first + at + len(sizes)] = sums / sizes[:, None] * self.scale
            at += len(sizes)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        if len(self.index) > self.most or self.bytes > self.most_bytes:
            self.clear()
        lists = [t.split() or [b""] for t in texts]
        self.learn({w for words in lists for w in words})
        sizes = np.array([len(x) for x in lists])
        ids = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(lists)), dtype=np.int64, count=sizes.sum())
        sums = np.add.reduceat(self.scores[ids], np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.float64)
        return sums / sizes[:, None] + self.model.weights[-1]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        m = self.model
        if not m.families:
            return ["und"] * len(texts), np.zeros(len(texts))
        out = self.margins(texts)
        n = len(m.families)
        first = out[:, :n].argmax(axis=1)
        ranked = np.sort(out[:, :n], axis=1)
        gap = ranked[:, -1] - ranked[:, -2] if n > 1 else np.full(len(out), 30.0)
        langs, scores = np.empty(len(out), dtype=object), 1 / (1 + np.exp(-np.clip(2 * gap, -30, 30)))
        for f, name in enumerate(m.families):
            own = np.flatnonzero(first == f)
            members = m.members[name]
            votes, strength = np.zeros((len(own), len(members))), np.zeros((len(own), len(members)))
            for k, (a, b) in enumerate(m.pairs):
                if a in members:
                    margin, i, j = out[own, n + k], members.index(a), members.index(b)
                    votes[:, i] += margin > 0
                    votes[:, j] += margin <= 0
                    strength[:, i] += margin
                    strength[:, j] -= margin
            best = (votes + 1e-3 * np.tanh(strength)).argmax(axis=1)
            langs[own] = [members[b] for b in best]
            if len(members) > 1:
                scores[own] *= 1 / (1 + np.exp(-np.clip(2 * strength[np.arange(len(own)), best] / (len(members) - 1), -30, 30)))
        for i, t in enumerate(texts):
            if not has_letter(t[:400].decode(errors="ignore")) and not has_letter(t.decode(errors="replace")):
                langs[i], scores[i] = "und", 0.0
        return list(langs), scores


def learn(docs: DataFrame, s: Settings = Settings()) -> Model:  # noqa: B008
    """Learns from rows with a doc_id, lang and text whose crc32(doc_id) mod 4 is not 2: a bounded sample for each language."""
    from pyspark.sql import Window

    fit_rows = docs.where(F.col("lang").isNotNull() & (bucket_remainder("doc_id", 4) != 2))
    order = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 40))
    counts = {r["lang"]: r["n"] for r in fit_rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [], s)
    # about most_per_language rows of each by a threshold on the hash; the exact bound follows on what is left
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (1.3 * s.most_per_language + 20) / n)))]), F.col("lang"))
    some = fit_rows.where((order < share * F.lit(float(1 << 40))) & F.col("text").rlike(r"\p{L}") & (F.length("text") <= s.longest)).select("lang", "text", order.alias("o"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", "text"))
    rows = some.withColumn("r", rank).where(F.col("r") <= s.most_per_language).orderBy("o", "doc_id", "text").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], s)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with lang_pred and score."""
    small_batches(docs.sparkSession)

    def run(batches):
        predictor = Predictor(model)
        for batch in batches:
            texts, langs, scores = byte_texts(batch), [], []
            for a, b in in_slices(texts, model.s.slice_bytes):
                x, y = predictor.predict(texts[a:b])
                langs += x
                scores.append(y)
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def language_id(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    return predict(docs.select("doc_id", "text"), learn(docs, s))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir)).select("doc_id", F.coalesce(bucket_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
