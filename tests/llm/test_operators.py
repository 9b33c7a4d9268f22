"""The ten operators against brute force, round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strideatlas.llm import fingerprint, langid, linkgraph, mixing, neardup, packing, preference, quality, substring, toxicity
from strideatlas.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def prose(r, n, words=None):
    words = words or ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


#: null, empty, blank, one word, a long text, repeats, ties.
ODD = [None, "", " \n\t", "one", "é ü ñ 漢字", "x " * 5000, "same text here", "same text here", "a" * 20_000]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD, id=1, grp=2, size=3, node=4, key=5, label=6, bucket=7)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_base(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.split()]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(windows)
    cover = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_base_counts_equal_brute_force():
    r = random.Random(1)
    few = ["a", "b", "cc", "é#", "<x>"]
    for text in [*ODD, *[prose(r, r.randint(0, 200), few) + "\n" + prose(r, 5, few) + "\n\n" + prose(r, 3, few[:1]) for _ in range(60)]]:
        assert quality.base_counts((text or "").encode()) == brute_base(text)


def test_bands_reject_repetition_and_noise_and_keep_prose(spark, odd, empty):
    r = random.Random(2)
    noise = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(200))
    got = {x["doc_id"]: x["kept"] for x in quality.compression_bands(docs_of(spark, [prose(r, 900), "spam " * 900, noise])).collect()}
    assert got == {0: True, 1: False, 2: False}
    assert quality.compression_bands(odd).count() == len(ODD) and quality.compression_bands(empty).count() == 0


def plain_bands(text):
    """The verdict of the bands by its own words: (bytes below which a row holds, lowest, highest ratio)."""
    import zstandard

    raw = (text or "").encode()
    ratio = lambda x: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(x)) / len(x)
    if not raw:
        return True
    whole = ((64, 0.0, 9.0), (256, 0.30, 1.30), (1024, 0.25, 0.90), (2048, 0.18, 0.80), (4096, 0.14, 0.72))
    low, high = next(((a, b) for n, a, b in whole if len(raw) < n), (0.10, 0.68))
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    judged = [c for c in chunks if len(c) >= 1024]
    bad = [c for c in judged if not (0.18 <= ratio(c) <= 0.80 if len(c) < 2048 else 0.14 <= ratio(c) <= 0.72)]
    return low <= ratio(raw) <= high and len(bad) <= len(judged) / 4


def test_verdicts_equal_plain_bands(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd_ones = docs_of(spark, [*ODD, "ab " * 700, "x1 " * 30]).select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    rows = docs.unionByName(odd_ones)
    got = {r["doc_id"]: r for r in quality.compression_bands(rows).collect()}
    for r in rows.collect():
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute_base(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)
        failed = n_words < 20 or 100 * n_repeat > 30 * n_words
        assert g["base_failed"] == failed and g["kept"] == (not failed and plain_bands(r["text"]))


def toxic_docs(spark, n=500):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(r, 60, words).split()
        for _ in range(3 * bad):
            text[r.randrange(60)] = r.choice(["zomgrot", "vilewort"])
        rows.append((i, " ".join(text), r.choice(["en", None]), "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_score(text, net):
    """The score of a text by loops over words, filters and positions."""
    s, zero = net.s, [np.float32(0)] * net.s.size
    vectors = []
    for w in (text or "").encode().split():
        rows = [net.table[b] for b in toxicity.features(w, s)]
        total = [x for x in rows[0]]
        for row in rows[1:]:
            total = [a + b for a, b in zip(total, row)]
        unit = [float(np.rint(x * np.float32(toxicity.VECTOR / len(rows)))) / toxicity.VECTOR for x in total]
        vectors.append([min(toxicity.MOST_VECTOR, max(-toxicity.MOST_VECTOR, x)) for x in unit])
    vectors = vectors or [zero]
    n, logit, j = len(vectors), net.out_bias, 0
    for width in s.widths:
        for f in range(s.filters):
            best = max(sum(float(vectors[i + k][d]) * float(net.filters[width][k, d, f]) for k in range(width) if i + k < n for d in range(s.size)) for i in range(n))
            logit += max(best + net.bias[j], 0.0) * net.out[j]
            j += 1
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, net.scale * logit + net.shift))))


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs, labels = toxic_docs(spark)
    s = toxicity.Settings(epochs=4)
    got = toxicity.judged(docs, labels, s).join(labels, "doc_id").where(toxicity.bucket_remainder("doc_id", 5) == 0).collect()
    assert np.mean([(x["toxic_score"] >= 0.5) == (x["toxic"] == 1) for x in got]) > 0.95
    same = toxicity.judged(docs, labels, s).where("doc_id < 20").select("doc_id", "toxic_score").collect()
    assert {x["doc_id"]: x["toxic_score"] for x in got if x["doc_id"] < 20}.items() <= {x["doc_id"]: x["toxic_score"] for x in same}.items()
    net, _ = toxicity.learn(docs, labels, s)
    assert net.scale == 1.0 and all(0 <= x["toxic_score"] <= 1 for x in toxicity.score(odd.select("doc_id", "text"), net).collect())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x["toxic_score"] for x in toxicity.judged(odd, none).collect()} == {0.0} and toxicity.judged(empty, none).count() == 0


def test_toxicity_scores_equal_plain_loops_in_any_batch(spark, sf):
    net, _ = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), toxicity.Settings(epochs=2))
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    some = sorted(texts, key=len)[:60] + ["", " ", "one", "é " * 50]
    scorer = toxicity.Scorer(net)
    together = scorer.logits([t.encode() for t in texts + some]).tolist()
    alone = [toxicity.Scorer(net).logits([t.encode()])[0] for t in texts + some]
    assert together == alone
    assert [net.probability(z) for z in together[len(texts) :]] == pytest.approx([plain_score(t, net) for t in some], abs=1e-12)
    docs = docs_of(spark, some + [None], **{"toxic_score": 5, "a.b`c": 6, "rejected": 7})
    for n in (1, 3):
        got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(docs.select("doc_id", "text").repartition(n), net).collect()}
        assert [got[i] for i in range(len(some))] == pytest.approx([net.probability(z) for z in together[len(texts) :]], abs=1e-15) and got[len(some)] == got[60]
        logits = {r["doc_id"]: r["toxic_logit"] for r in toxicity.with_logit(docs.select("doc_id", "text").repartition(n), net).collect()}
        assert [logits[i] for i in range(len(some))] == together[len(texts) :]
    long = " ".join(texts)  # a text of many stretches
    step = max(scorer.tops([t.encode() for t in texts]).max(axis=0).max() for _ in (0,))
    assert scorer.tops([long.encode()]).max() >= step
    out = toxicity.judged(docs, spark.read.parquet(f"{sf}/labels.parquet").limit(0))
    assert out.columns == [*docs.columns[:5], "toxic_score_in", "a.b`c", "rejected_in", "toxic_score", "toxic_threshold", "rejected"]
    assert {tuple(r)[5:8] for r in out.collect()} == {(5, 6, 7)}


def test_toxicity_calibrates_on_all_rows_that_were_not_fitted(spark):
    docs, labels = toxic_docs(spark, 900)
    net, fitted = toxicity.learn(docs, labels, toxicity.Settings(epochs=3, most_toxic=40, most_clean=60))
    assert fitted.count() == 100
    thresholds = toxicity.calibrate(net, toxicity.with_logit(docs, net).select("doc_id", "lang", "toxic_logit"), labels, fitted)
    assert set(thresholds) == {None, "en"} and 0.3 <= thresholds["en"] <= 0.8
    z, y = np.linspace(-4, 4, 200), (np.linspace(-4, 4, 200) > 0.5).astype(float)
    scale, shift = toxicity.logistic(z, y, np.ones(200))
    assert scale > 3 and abs(-shift / scale - 0.5) < 0.1
    y[5:15] = 1  # labels that nothing explains
    scale, shift = toxicity.logistic(z, y, np.ones(200))
    assert abs(-shift / scale - 0.5) < 0.1
    twice = docs.unionByName(docs.limit(50)).unionByName(docs.limit(1).withColumn("text", F.lit("other")))
    assert toxicity.judged(twice, labels, toxicity.Settings(epochs=1)).count() == 951


def plain_likeness(a, b):
    """Bins that hold the same tuple over bins that one of both fills, brought back to the share of k-mers."""
    one, two = ([int(x) for x in fingerprint.signature(t or "")] for t in (a, b))
    filled = [(x, y) for x, y in zip(one, two) if x or y]
    return (sum(x == y for x, y in filled) / len(filled)) ** 0.5 if filled else 1.0


def test_fingerprints_follow_edits_and_order(spark, odd, empty):
    r = random.Random(4)
    text = prose(r, 300)
    other, swapped = prose(r, 300, ["q", "vv", "www"]), text[len(text) // 2 :] + text[: len(text) // 2]
    sig = fingerprint.signature
    small = text[:700] + "#" + text[702:]
    assert (sig(text) == sig(str(text))).all() and fingerprint.likeness(sig(""), sig("")) == 1.0 and fingerprint.likeness(sig(""), sig("a")) == 0.0
    assert fingerprint.likeness(sig(text), sig(small)) > 0.85 > 0.2 > fingerprint.likeness(sig(text), sig(other))
    assert fingerprint.likeness(sig(text), sig(swapped)) < 1
    long = "ab" * 3000  # one k-mer again and again: occurrence numbers tell lengths apart
    assert fingerprint.likeness(sig(long), sig(long[:3000])) < 0.9
    texts = [prose(r, r.randint(0, 60)) for _ in range(50)] + ODD
    rows = docs_of(spark, texts)
    got = {x["doc_id"]: x for x in fingerprint.fingerprints(rows, ranges=5).collect()}
    for i, t in enumerate(texts):
        e = fingerprint.edited(t or "", texts[(i + 1) % len(texts)] or "")
        assert got[i]["n_chars"] == len(t or "") and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["edited_fingerprint"] == sig(e).astype(">u4").tobytes().hex()
        assert got[i]["near_edited"] == plain_likeness(t, e) and got[i]["near_next"] == plain_likeness(t, texts[(i + 1) % len(texts)])
    assert fingerprint.fingerprints(odd).count() == len(ODD) and fingerprint.fingerprints(empty).count() == 0
    twice = rows.limit(3).unionByName(rows.limit(3)).unionByName(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert fingerprint.fingerprints(twice, ranges=3).count() == 7
    named = fingerprint.fingerprints(rows.withColumn("doc_id", F.format_string("doc-%05d", "doc_id")), ranges=5)
    assert named.rdd.getNumPartitions() >= 5 and sum(1 for n in named.rdd.glom().map(len).collect() if n) >= 4
    assert {x["doc_id"]: x["edited_sha256"] for x in named.collect()} == {f"doc-{i:05d}": got[i]["edited_sha256"] for i in got}
    small = fingerprint.fingerprints(rows, fingerprint.Settings(range_bytes=5000)).collect()
    assert sorted(map(str, small)) == sorted(str(x) for x in got.values())


def test_signature_takes_the_smallest_of_each_bin():
    r, s = random.Random(5), fingerprint.Settings(sketches=8, length=3, k=4)
    text = prose(r, 80)
    points = np.array([ord(c) for c in text], dtype=np.uint32)
    h = fingerprint.kmer_hashes(points, 4, s.seed).tolist()
    seen, numbered = collections.Counter(), []
    for x in h:
        n = seen[x]
        seen[x] += 1
        numbered.append(x if n == 0 else int(fingerprint.mix64(np.array([(x + n * 0x9FB21C651E98DF25) % 2**64], dtype=np.uint64))[0]))
    got = fingerprint.signature(text, s)
    for b in range(8):
        own = sorted((x, i) for i, x in enumerate(numbered) if x // (2**64 // 8) == b)[:3]
        total = np.array([s.seed], dtype=np.uint64)
        values = [x for _, x in sorted((i, x) for x, i in own)] + [0] * (3 - len(own))
        for v in values:
            total = fingerprint.mix64(total * np.uint64(0xD1342543DE82EF95) + np.uint64(v))
        assert got[b] == ((int(total[0]) >> 32) | 1 if own else 0)


def test_mixing_fills_targets_and_sorts_by_position(spark, odd, empty):
    r = random.Random(6)
    texts = [prose(r, r.randint(1, 120)) for _ in range(120)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}", 0) for i, t in enumerate(texts)]
    plan = mixing.plan(spark.createDataFrame(rows, DOCS)).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for x in plan:
        assert x["taken"] <= 3 * x["size"]
        b = by[x["source"]]
        b[0], b[1], b[2] = b[0] + x["size"], b[1] + x["taken"], x["target"]
    assert abs(sum(b[2] for b in by.values()) - sum(b[0] for b in by.values())) < 1e-6
    order = sorted((k for k in by if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    left, open_, want = sum(b[0] for b in by.values()), set(order), {}
    while True:  # round by round, as the rule says it
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > 3 * by[k][0]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3.0 * by[k][0]
            left -= want[k]
        open_ -= over
    for k, b in by.items():
        assert b[2] == pytest.approx(want[k]) and b[1] == int(b[2] + 1e-9)
    out = [x["position"] for x in mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()]
    assert out == sorted(out) and 0 <= out[0] and out[-1] <= 1
    assert mixing.plan(odd).count() == len(ODD) and mixing.mixed(empty).count() == 0 and mixing.plan(empty).count() == 0
    clash = odd.withColumns({"class": F.lit(8), "target": F.lit(9), "taken": F.lit(10), "a.b": F.lit(11), "position": F.lit(12)})
    for out, names in ((mixing.plan(clash), ("size", "class", "target", "taken")), (mixing.mixed(clash), ("position",))):
        kept = [c + "_in" if c in names else c for c in clash.columns]
        assert out.columns[: len(kept)] == kept
        assert {tuple(r)[5 : len(kept)] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)}
    nulls = spark.createDataFrame([(None, prose(r, 30), "en", "s", 0) for _ in range(300)], DOCS)
    got = mixing.plan(nulls).collect()
    assert len(got) == 300 and sorted(x["start"] for x in got) == [30 * i for i in range(300)] and sum(x["taken"] for x in got) == 9000


def test_schedules_are_inverted(spark):
    knots = ((0.0, 2.0), (0.3, 0.5), (1.0, 1.0))
    us = [i / 50 for i in range(51)]
    got = [x["t"] for x in spark.createDataFrame([(u,) for u in us], "u double").select("u", mixing.invert(knots, F.col("u")).alias("t")).orderBy("u").collect()]
    t = np.linspace(0, 1, 200_001)
    w = np.interp(t, *zip(*knots, strict=True))
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
    assert np.allclose(got, np.interp(us, area / area[-1], t), atol=1e-4)


def plain_language(text, model):
    """Language and score of a text by loops: each word's n-grams one by one, each machine's mean, then the votes."""
    words, s = text.split(), model.s
    total = np.zeros(model.weights.shape[1])
    for w in words:
        marked = f"<{w.lower()}>"
        own = [zlib.crc32(marked.encode()) % s.buckets]
        for n in s.grams:
            for i in range(len(marked) - n + 1):
                h = 0
                for k, c in enumerate(marked[i : i + n]):
                    h = ord(c) if k == 0 else (h * 0x9E6C63D0876A9A47 + ord(c)) % 2**64
                own.append(int(langid.mix64(np.array([(h + (n << 40)) % 2**64], dtype=np.uint64))[0]) % s.buckets)
        total += sum(model.weights[b].astype(float) for b in own) / len(own)
    out = total * s.buckets**0.5 / len(words) + model.weights[-1]
    families = out[: len(model.families)]
    family = model.families[int(families.argmax())]
    gap = np.sort(families)[-1] - np.sort(families)[-2]
    score = 1 / (1 + np.exp(-2 * gap))
    members = model.members[family]
    votes = dict.fromkeys(members, 0.0)
    strength = dict.fromkeys(members, 0.0)
    for k, (a, b) in enumerate(model.pairs):
        if a in members:
            m = out[len(model.families) + k]
            votes[a if m > 0 else b] += 1
            strength[a] += m
            strength[b] -= m
    best = max(members, key=lambda x: votes[x] + 1e-3 * np.tanh(strength[x]))
    if len(members) > 1:
        score *= 1 / (1 + np.exp(-2 * strength[best] / (len(members) - 1)))
    return best, score


def test_language_equals_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(docs)
    rows = sorted((r for r in docs.collect() if r["text"] and langid.has_letter(r["text"])), key=lambda r: len(r["text"]))[:120]
    got = {r["doc_id"]: r for r in langid.predict(docs.select("doc_id", "text").repartition(3), model).collect()}
    for r in rows:
        lang, score = plain_language(r["text"], model)
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=2e-4)
        assert got[r["doc_id"]]["lang_pred"] == lang or score < 0.26


def test_language_on_held_out_rows(spark, odd, empty):
    r = random.Random(7)
    stems = {"en": ["the", "ing", "ough"], "de": ["sch", "ung", "ich"], "fr": ["eau", "tion", "ê"], "es": ["ción", "ñ", "illa"]}
    vocabulary = {k: ["".join(r.choice(v) + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(200)] for k, v in stems.items()}
    rows = [(i, prose(r, r.randint(5, 40), vocabulary[k]), k, "s", 0) for i, k in enumerate(list(stems) * 120)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.learn(docs)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    got = langid.predict(docs.select("doc_id", "text", F.col("lang").alias("true")), model).where(langid.bucket_remainder("doc_id", 4) == 2).collect()
    assert np.mean([x["lang_pred"] == x["true"] for x in got]) > 0.97
    out = {x["doc_id"]: x for x in langid.predict(odd.select("doc_id", "text"), model).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (0, 1, 2)) and out[3]["lang_pred"] in stems
    signs = docs_of(spark, ["½ ② Ⅷ ² 7 _ !", "ª", "ж", "7" * 1000, "7" * 1000 + "x"])
    assert [x["lang_pred"] != "und" for x in sorted(langid.predict(signs.select("doc_id", "text"), model).collect(), key=lambda x: x["doc_id"])] == [False, True, True, False, True]
    assert langid.language_id(empty).count() == 0


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    r = random.Random(8)
    texts = ["", "a  b \n\n c", "don't  stop!?", "漢字 émoji 🙂 x", prose(r, 200), " \t lead", "x" * 3000, "1234 5,6", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "x<|endoftext|>y"]
    texts += ["x" + " " * 1_000_000 + "y", "x" + "\n" * 1_000_000, "a" + " " * 100_000, " " * 5000 + "z"]
    marks = ["a", "Bc", "é", "漢", "7", ".", "'s", " ", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", "\x1c", "\u180e", "\u2003", "\u200b", "\u3000", "\ufeff", "<|endoftext|>", "🙂", "\u0301", "\x00"]
    texts += ["".join(r.choice(marks) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    texts += ["".join(r.choice([x for x in marks if packing.SURE.fullmatch(x)]) for _ in range(r.randint(1, 40))) for _ in range(2000)]
    texts += ["".join(r.choice(marks) for _ in range(5000)), "".join(map(chr, range(32, 0x530))), " ".join(map(chr, range(32, 0x530))), "x" * 200_000]
    own = packing.Ids(VOCABULARY, step=1000)
    for text in texts:
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.of(text), dtype="<u4").tolist() == want
        assert np.frombuffer(own.by_tokenizer(text), dtype="<u4").tolist() == want
        assert packing.token_ids(text, VOCABULARY).tolist() == [*want, 0]


def test_best_fit_equals_a_plain_search():
    r = random.Random(9)
    for _ in range(30):
        lengths = sorted((r.randint(1, 64) for _ in range(80)), reverse=True)
        at, offsets, left = packing.best_fit_decreasing(lengths, 64)
        room: list[int] = []
        for n, w, o in zip(lengths, at, offsets, strict=True):
            fits = [c for c in room if c >= n]
            best = min(fits) if fits else None
            assert (64 - o == best) if best is not None else (w == len(room) and o == 0)
            if best is None:
                room.append(64)
            room[w] -= n
        assert room == [left[k] for k in range(len(room))]


def test_packing_is_an_exact_round_trip(spark, odd, empty):
    r = random.Random(10)
    texts = [prose(r, r.randint(0, 900)) for _ in range(60)] + ODD
    docs = docs_of(spark, texts)
    got = packing.pack(docs, VOCABULARY, packing.Settings(window=256, group_rows=16, keep_ids=True)).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        assert zlib.crc32(x["ids"]) == x["ids_crc32"] and len(x["ids"]) == 4 * x["length"]
        pieces[x["doc_id"]].append((x["start"], bytes(x["ids"])))
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for i, t in enumerate(texts):
        assert b"".join(b for _, b in sorted(pieces[i])) == packing.token_ids(t or "", VOCABULARY).tobytes()
    used = []
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        used.append(at)
    assert max(used) <= 256 and sum(packing.padding(u, 256) for u in used) < 0.03 * sum(used)
    assert packing.pack(empty, VOCABULARY).count() == 0 and packing.pack(odd, VOCABULARY).select("doc_id").distinct().count() == len(ODD)


def test_packing_deals_copies_to_many_groups(spark):
    rows = [(i, "one text in many copies", "en", "s", 0) for i in range(200)] + [(7, "the same row", "en", "s", 0)] * 200 + [(None, None, "en", "s", 0)] * 200 + [(None, "no id", "en", "s", 0)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    s = packing.Settings(window=256, group_rows=32)
    got = packing.pack(docs, VOCABULARY, s).collect()
    number = collections.Counter((x["doc_id"], x["doc_tokens"]) for x in got if x["start"] == 0)
    want = collections.Counter((i, len(packing.token_ids(t or "", VOCABULARY))) for i, t, *_ in rows)
    assert number == want
    used = collections.Counter()
    for x in got:
        used[x["doc_id"], x["doc_tokens"]] += x["length"]
    assert used == {k: n * k[1] for k, n in want.items()}
    groups = collections.Counter(x["sequence_id"] >> 32 for x in got if x["start"] == 0)
    assert len(groups) > 10 and max(groups.values()) <= 4 * 32
    again = packing.pack(docs.repartition(7, "text"), VOCABULARY, s).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_link_graph_spreads_trust_and_distrust(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    rows = [(1, "http://A.bad.net/x", link("victim.com")), (2, "https://farm.io/", link("a.bad.net")), (3, "https://good.example.net/en/1", link("friend.io")), (4, "https://friend.io/?q", None), (5, "https://mixed.io/", link("q1.io", "q2.io", "q3.io")),
            (6, None, "x"), (7, "no-scheme", "<a href='/rel'>"), (8, "https://x.example.com/de/#a", ""), (9, "https://x.org/fr/1?x=1", ""), (10, "HTTP://EXAMPLE.NET/en/", ""), (11, "https://example.net", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {x["page_id"]: x for x in linkgraph.url_filter(pages).collect()}
    assert (got[1]["host"], got[1]["rule"], got[1]["verdict"]) == ("a.bad.net", "net/", "block")
    assert got[2]["rule"] is None and got[2]["verdict"] == "block"  # the only host that links to a blocked one
    assert got[3]["rule"] == "example.net/en/" and got[4]["verdict"] == "allow" and got[4]["trust"] > 0
    assert got[6]["verdict"] == "allow" and got[6]["host"] == "" and got[7]["path"] == ""
    assert got[8]["rule"] == "example.com/de/" and got[9]["rule"] == "org/fr/" and got[10]["rule"] == "example.net/en/" and got[11]["rule"] is None
    assert linkgraph.url_filter(pages.where("false")).count() == 0


def test_link_graph_goes_on_until_scores_settle(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    farm = [f"u{i}.io" for i in range(1, 6)]
    rows = [(0, "https://b.net/", link(*farm))] + [(i, f"https://{h}/", link("b.net")) for i, h in enumerate(farm, 1)]
    s = linkgraph.Settings()
    got = {x["page_id"]: x for x in linkgraph.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), s).collect()}
    b = 0.15 / (1 - 0.85**2)  # by hand: b = 0.15 + 0.85 * 5u, u = 0.85 * b / 5
    limit = 0.075
    assert abs(got[0]["distrust"] / s.unit - b) < 0.01 * limit
    for i in range(1, 6):
        assert got[i]["verdict"] == "block" and abs(got[i]["distrust"] / s.unit - 0.17 * b) < 0.01 * limit


def plain_link_graph(pages, s):
    """host -> (trust, distrust) by loops over links, round by round, with the same whole numbers and the same end."""
    import re

    rows = []
    for _, url, html in pages:
        host = url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else ""
        path = "/" + url.split("://", 1)[1].split("/", 1)[1] if url and url.count("/") > 2 else ""
        fits = [(len(h + p), v) for v, h, p in s.rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((host, max(fits)[1] if fits else None, {x.lower() for x in re.findall(r"//([^/\"]+)/", html or "")}))
    links = {(h, x) for h, _, named in rows for x in named if h and x != h}
    start = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        for host in {h for h, _, _ in rows if h}:
            own = [v for h, v, _ in rows if h == host]
            seed = s.unit * own.count(verdict) // len(own)
            if seed:
                start[kind, host] = seed * (100 - s.damping) // 100
    edges = {}
    for a, b in links:
        edges.setdefault(("trust", a), []).append(b)
        edges.setdefault(("distrust", b), []).append(a)
    scores, n = dict(start), 0
    while True:
        before = dict(scores)
        for _ in range(s.checkpoint_every):
            new = dict(start)
            for key, to in edges.items():
                for host in to:
                    if key in scores:
                        new[key[0], host] = new.get((key[0], host), 0) + scores[key] * s.damping // 100 // len(to)
            scores, n = new, n + 1
        if not edges or max((v - before.get(k, 0) for k, v in scores.items()), default=0) <= linkgraph.limit_of(s) // s.settled:
            return rows, scores, n


def test_links_decide_most_verdicts_of_generated_pages(spark):
    r = random.Random(17)
    hosts = [f"h{i}.io" for i in range(40)] + [f"b{i}.net" for i in range(4)] + ["www.example.net", "a.org", "hub.io"]
    chain = [f"c{i}.io" for i in range(12)]
    pages, k = [], 0
    for h in [*hosts, *chain]:
        for _ in range(r.randint(1, 3) + 40 * (h == "hub.io")):
            named = r.sample(hosts, r.randint(0, 3)) + (["b0.net"] if r.random() < 0.3 else [])
            if h in chain:
                named = [chain[(chain.index(h) + 1) % len(chain)]] + (["b1.net"] if h == "c0.io" else [])  # a long cycle round a blocked seed
            pages.append((k, f"https://{h}/{r.choice(['en', 'fr', 'de'])}/{k}", "".join(f'<a href="https://{x}/y">' for x in named)))
            k += 1
    pages += pages[:2] + [(None, None, None), (k, "https://h1.io/", None)]
    s = linkgraph.Settings()
    rows, scores, rounds = plain_link_graph(pages, s)
    assert rounds > 8
    want = []
    for (i, _, _), (host, own, _) in zip(pages, rows):
        trust, distrust = scores.get(("trust", host), 0), scores.get(("distrust", host), 0)
        want.append((i, host, own or ("block" if distrust - trust >= linkgraph.limit_of(s) else "allow"), trust, distrust))
    got = [(x["page_id"], x["host"], x["verdict"], x["trust"], x["distrust"]) for x in linkgraph.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), s).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    free = [v for (_, own, _), (_, _, v, *_) in zip(rows, want) if own is None]
    assert len(free) > len(pages) / 2 and free.count("block") > 5


def brute_removed(texts, n):
    words = [(t or "").encode().split() for t in texts]
    times = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - n + 1) if times[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return words, out


def test_substring_dedup_equals_brute_force(spark, odd, empty):
    r = random.Random(11)
    shared = [prose(r, 80) for _ in range(3)]
    texts = []
    for _ in range(80):
        parts = [prose(r, r.randint(0, 60))]
        if r.random() < 0.6:
            p = r.choice(shared).split()
            a = r.randint(0, 30)
            parts.append(" ".join(p[a : a + r.randint(20, 50)]))
        texts.append(" \n".join([*parts, prose(r, r.randint(0, 30))]))
    texts += ODD + [shared[0]] * 30
    words, want = brute_removed(texts, 35)
    for s in (substring.Settings(), substring.Settings(group_bytes=3000, hot_share=1e-3)):
        got = {x["doc_id"]: x for x in substring.substring_dedup(docs_of(spark, texts), s).collect()}
        for i, w in enumerate(want):
            assert got[i]["kept_text"].encode() == b" ".join(w) and got[i]["n_removed"] == len(words[i]) - len(w)
            assert sum(x["end"] - x["begin"] for x in got[i]["removed"]) == got[i]["n_removed"]
    assert substring.substring_dedup(odd, carry=tuple(odd.columns)).count() == len(ODD) and substring.substring_dedup(empty).count() == 0


def test_frequent_hashes_are_found():
    r = np.random.default_rng(16)
    f, share = substring.Frequent(0.01), 0.01
    often = np.arange(1, 21, dtype=np.uint64)
    everything = []
    for _ in range(50):
        part = np.concatenate([r.integers(100, 1 << 40, 3000).astype(np.uint64), r.choice(often, 2000)])
        everything.append(part)
        f.add(part)
    values, counts = np.unique(np.concatenate(everything), return_counts=True)
    got = dict(zip(*(x.tolist() for x in f.often())))
    for v, n in zip(values.tolist(), counts.tolist()):
        if n >= share * f.total:
            assert n - share / 2 * f.total <= got[v] <= n
    assert set(got) <= set(often.tolist()) and len(f.values) < 2 / share * 50


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring.Words, "hashes", lambda self, first, n: np.zeros(len(first), dtype=np.uint64))
    blob = b"a b c d\na b c x\nq b c d"
    assert substring.repeated_windows(blob, np.zeros(3, dtype=np.int64), 3) == [(0, 0, 2), (1, 0, 1), (2, 1, 2)]


def test_preference_pairs(spark):
    turn = lambda i, role, text: {"turn": i, "role": role, "text": text}
    one, two, three = [turn(0, "user", "q"), turn(1, "assistant", "good")], [turn(0, "user", "q"), turn(1, "assistant", "bad one")], [turn(0, "system", None)]
    kind = "array<struct<turn:bigint,role:string,text:string>>"
    pairs = spark.createDataFrame([(1, one, two), (2, one, one), (3, three, one), (4, [], [])], f"k int, chosen {kind}, rejected {kind}")
    got = {x["k"]: x for x in preference.preference_format(pairs).collect()}
    x = got[1]
    assert x["prompt"] == "<|user|>\nq\n" and x["chosen_completion"] == "<|assistant|>\ngood\n" and x["n_prompt_turns"] == 1 and x["valid"]
    a, b = x["rejected_spans"][0]
    assert x["rejected_completion"][a:b] == "bad one\n"
    assert not got[2]["valid"] and got[2]["chosen_completion"] == "" and got[3]["prompt"] is not None and not got[4]["valid"]
    conv = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", "x"), (1, 0, "user", "b"), (1, 1, "assistant", None), (2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    assert preference.swapped_answers(conv).count() == 3 and preference.swapped_answers(conv.where("false")).count() == 0
    more = conv.unionByName(conv.where("conv_id = 0")).unionByName(spark.createDataFrame([(None, 0, "assistant", "lost"), (9, None, None, None), (7, 0, "assistant", "x"), (7, 0, "assistant", "w")], conv.schema))
    got = {x["conv_id"]: x for x in preference.preference_format(preference.swapped_answers(more).withColumn("prompt", F.lit("own")).withColumn("a.b", F.lit(1))).collect()}
    assert set(got) == {0, 1, 2, 7, 9, None} and {k: x["partner_id"] for k, x in got.items()} == {0: 1, 1: 7, 7: 0, 2: 2, 9: 9, None: None}
    assert all(x["prompt_in"] == "own" and x["a.b"] == 1 for x in got.values())
    assert not got[2]["valid"] and got[2]["chosen_completion"] == "" and got[2]["prompt"] == "<|user|>\nalone\n" and not got[None]["valid"]
    assert got[1]["rejected_completion"] == "<|assistant|>\nx\n" and got[0]["prompt"] == "<|user|>\na\n" * 2
    assert got[7]["valid"] and got[7]["chosen_completion"] == "<|assistant|>\nw\n<|assistant|>\nx\n"  # both say what the partner says


def test_partners_follow_in_order(spark):
    r = random.Random(14)
    ids = r.sample(range(-1000, 100_000), 700)
    got = {x["conv_id"]: x["partner_id"] for x in preference.next_known(spark.createDataFrame([(i,) for i in ids], "conv_id long"), 60).collect()}
    order = sorted(ids)
    assert got == dict(zip(order, [*order[1:], order[0]]))
    names = sorted({f"talk-{r.randrange(10**6):06d}" for _ in range(300)})
    got = {x["conv_id"]: x["partner_id"] for x in preference.next_known(spark.createDataFrame([(i,) for i in names], "conv_id string"), 60).collect()}
    assert got == dict(zip(names, [*names[1:], names[0]]))


def brute_components(texts, words, percent=80):
    sets = [neardup.shingle_set((t or "").encode(), words) for t in texts]
    label = list(range(len(texts)))
    while True:
        old = list(label)
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
        if label == old:
            return sets, label


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, odd, empty, words):
    r = random.Random(12)
    texts = []
    for _ in range(6):
        base = prose(r, r.randint(30, 90)).split()
        for _ in range(22):  # large enough for block tasks: near and not so near copies of one text
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = r.choice(["new", "edit", "odd", "other"])
            texts.append(" ".join(copy))
    texts += [*ODD, *[prose(r, 2) for _ in range(10)]]
    sets, want = brute_components(texts, words)
    for s in (neardup.Settings(words=words), neardup.Settings(words=words, hub=4, block=5)):
        got = {x["doc_id"]: x for x in neardup.near_duplicates(docs_of(spark, texts), s).collect()}
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(x) for x in sets]
        assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    assert neardup.near_duplicates(empty).count() == 0
    twice = odd.unionByName(odd).unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert neardup.near_duplicates(twice).count() == 2 * len(ODD) + 1


def test_near_duplicates_under_a_crowded_key(spark):
    """Short texts that share a shingle, each with one of its own: many small clusters under the same keys."""
    r = random.Random(15)
    texts = [f"a b c{i}" for i in range(60)] + [f"a b c{i} a b" for i in range(60)] + ["x y z w v u " * 3 + str(i % 7) for i in range(30)] + ["p q", "q p", "p q p", "q p q"]
    r.shuffle(texts)
    sets, want = brute_components(texts, 2)
    for s in (neardup.Settings(words=2, hub=3, block=4), neardup.Settings(words=2, hub=10**6)):
        got = {x["doc_id"]: x for x in neardup.near_duplicates(docs_of(spark, texts), s).collect()}
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(x) for x in sets]


def test_signature_distance_guarantee():
    s = neardup.Settings(words=2)
    r = np.random.default_rng(13)
    a = r.integers(0, 1 << 16, s.values, dtype=np.uint16)
    for _ in range(50):
        b = a.copy()
        for i in r.choice(s.values, s.distance, replace=False):
            b[i] ^= 1
        x, y = a.reshape(s.chunks, s.per_chunk), b.reshape(s.chunks, s.per_chunk)
        assert ((x != y).sum(axis=1) <= s.errors).any()


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def counted_checkpoints(monkeypatch, module):
    from strideatlas.llm import common

    calls = []
    monkeypatch.setattr(f"strideatlas.llm.{module}.checkpointed", lambda df: calls.append(1) or common.checkpointed(df))
    return calls


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    """Every checkpoint is a file and some processes for each partition, so none is written only to see that nothing changed."""
    calls = counted_checkpoints(monkeypatch, "components")
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame([(0, i) for i in range(1, 50)] + [(70, 60)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(50), 0), 60: 60, 70: 60} and len(calls) == 1
    assert components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0 and len(calls) == 2
    r = random.Random(21)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(90)]
    label = list(range(150))
    for _ in range(150):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for a, b in edges if a != b for x in (a, b)}


def test_mixing_writes_the_sizes_alone(spark, monkeypatch):
    calls = counted_checkpoints(monkeypatch, "mixing")
    plan = mixing.plan(docs_of(spark, ["one two three", "four", None, "five six"])).collect()
    assert len(calls) == 1 and sum(x["size"] for x in plan) == 6
