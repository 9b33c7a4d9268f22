"""Registered queries against their SQL, and the pipeline against a plain version of it."""

import collections

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strideatlas.llm import neardup, packing, queries, toxicity

TABLES = ("documents", "labels", "pages", "conversations", "benchmark", "embeddings")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(SQL[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda x: None if x is None or x != x else round(x, 9) if isinstance(x, float) else str(x)
    rows = lambda df: sorted(str([cell(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_whole_table(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline_equals_a_plain_version(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net, fitted = toxicity.learn(table, labels)
    scorer = toxicity.Scorer(net)
    logits = spark.createDataFrame([(d["doc_id"], d["lang"], float(scorer.logits([d["text"].encode()])[0])) for d in docs], "doc_id long, lang string, toxic_logit double")
    limits = toxicity.calibrate(net, logits, labels, fitted)
    docs = [d for d in docs if net.probability(scorer.logits([d["text"].encode()])[0]) < limits.get(d["lang"], limits[None])]
    sets = {d["doc_id"]: neardup.shingle_set(d["text"].encode(), 5) for d in docs}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    docs = [d for d in docs if label[d["doc_id"]] == d["doc_id"]]
    times = collections.Counter(w for d in docs for x in [d["text"].encode().split()] for w in zip(*(x[i:] for i in range(35)), strict=False))
    for d in docs:
        x = d["text"].encode().split()
        gone = {j for i in range(len(x) - 34) if times[tuple(x[i : i + 35])] > 1 for j in range(i, i + 35)}
        if gone:
            d["text"] = b" ".join(w for j, w in enumerate(x) if j not in gone).decode()
    mixed = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], len(d["text"])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    want = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, mixed, sf).collect())
    got = corpus_pipeline.run(spark, sf).collect()
    tokens = {d["doc_id"]: packing.token_ids(d["text"], public_tokenizers.path("byte_bpe_50k.json")) for d in docs}
    used = collections.Counter()
    for r in got:
        used[r["doc_id"]] += r["length"]
        assert bytes(r["ids"]) == tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()
    assert used == {k: n * len(tokens[k]) for k, n in want.items()}


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = docs.unionByName(docs.limit(2)).unionByName(docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars"))
    for name in ("rejected", "nth", "carried", "size", "position", "grp", "n_removed", "class"):
        odd = odd.selectExpr("*", f"1 AS {name}")
    odd = odd.withColumn("a.b", F.lit(1)).withColumn("c`d e", F.lit("x"))
    for d in (docs, odd, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, sf)
            assert out.columns == d.columns and out.count() <= 3 * d.count()
        assert corpus_pipeline.pack_sequences(spark, d, sf).count() >= d.select("doc_id").distinct().count()


def test_pipeline_of_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
