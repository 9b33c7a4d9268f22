"""Operator 7, URL filters by link-graph propagation (native: DataFrame functions only).

Rules judge (host, path) by suffix and prefix, the longest wins. Pages without a rule take their host's verdict: trust flows
from hosts with allowed pages along links, distrust from hosts with blocked pages against links (personalised PageRank
both), and a host is blocked when distrust less trust reaches ``threshold`` of what a wholly blocked host starts with.

Seeds are the shares of a host's pages that rules allow or block. Links are distinct pairs of different hosts named in
``href``/``src``; relative links stay on their host and carry nothing. Scores are whole numbers (fixed point) and every step
rounds down, so sums do not depend on their order. Rounds go on until no score grows by more than a thousandth of the limit
in four of them. Edges are pre-aggregated where they are found; edges and scores are
checkpointed in the shared folder. A host's scores come in ``salts`` copies, so that the pages of a hot host meet them in many
tasks; seeds and degrees of hot hosts are pre-aggregated.

Defined results: null url, or one without ``://``, has empty host and path, no rule and is allowed; null html has no links;
repeated rows are judged each by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

#: Verdict, host suffix, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""


@dataclass(frozen=True)
class Settings:
    rounds: int = 8  # of the SQL; the operator goes on until the scores have settled
    damping: int = 85  # percent of a score that links pass on
    unit: int = 10_000_000_000  # fixed point of a whole seed: sums over billions of hosts stay in 64 bits
    threshold: int = 50  # percent of the start of a wholly blocked host
    rules: tuple = RULES
    checkpoint_every: int = 4
    salts: int = 32  # a hot host's pages meet its verdict in so many tasks
    settled: int = 1000  # scores have settled when none grew by more than this part of the limit between checkpoints


def parts(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def fitting(rules: tuple) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different hosts."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    links = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    return links.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).distinct()


def limit_of(s: Settings) -> int:
    return s.unit * (100 - s.damping) // 100 * s.threshold // 100


def host_scores(pages: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """host, trust, distrust for every host with a seed or reached by one; pages have host, path, fit and html."""
    stay = 100 - s.damping
    share = lambda verdict: F.floor(F.lit(s.unit) * F.count_if(F.col("fit.verdict") == verdict) / F.count(F.lit(1))).cast("long")
    hosts = pages.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("seed")))).alias("x")).select("x.kind", "host", "x.seed").where("seed > 0")
    seeds = checkpointed(seeds)
    links = checkpointed(host_links(pages))
    out_degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    in_degree = links.groupBy("dst").agg(F.count("*").alias("degree"))
    forward = links.join(out_degree, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "degree")
    backward = links.join(in_degree, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "degree")
    edges = checkpointed(forward.unionByName(backward))
    start = seeds.select("kind", "host", F.expr(f"seed * {stay} div 100").alias("score"))
    scores = start
    if not edges.isEmpty():
        growth = None
        while growth is None or growth > limit_of(s) // s.settled:  # scores only grow, are bounded and whole, so this ends
            before = scores.withColumnRenamed("score", "before")
            for _ in range(s.checkpoint_every):
                moved = edges.join(scores, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.expr(f"(score * {s.damping} div 100) div degree").alias("score"))
                scores = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            scores = checkpointed(scores)
            grown = F.col("score") - F.coalesce("before", F.lit(0))
            growth = scores.join(before, ["kind", "host"], "left").agg(F.coalesce(F.max(grown), F.lit(0))).first()[0]
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).alias(kind)
    return scores.groupBy("host").agg(pick("trust"), pick("distrust"))


def url_filter(pages: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url, html), and the host's scores."""
    judged = parts(pages.select("page_id", "url", "html")).withColumn("fit", fitting(s.rules))
    scores = host_scores(judged, s)
    limit = limit_of(s)
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(s.salts)).cast("int")
    copies = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))))
    out = judged.select("page_id", "host", "path", "fit", salt.alias("salt")).join(copies, ["host", "salt"], "left")
    own = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0)) >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_sql(s: Settings = Settings()) -> str:  # noqa: B008
    stay, limit = 100 - s.damping, s.unit * (100 - s.damping) // 100 * s.threshold // 100
    fit = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p) if what == 'rule' else v}'" for v, h, p in sorted(s.rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))) + " END"
    text = f"""
WITH r AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS MATERIALIZED (SELECT *, {fit("rule")} AS rule, {fit("verdict")} AS own FROM h),
links AS MATERIALIZED (
  SELECT DISTINCT host AS src, translate(x, '{UPPER}', '{LOWER}') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS x FROM j)
  WHERE host <> '' AND host <> translate(x, '{UPPER}', '{LOWER}')),
edges AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS host, dst AS tohost, count(*) OVER (PARTITION BY src) AS degree FROM links
  UNION ALL SELECT 'distrust', dst, src, count(*) OVER (PARTITION BY dst) FROM links),
seeds AS (
  SELECT host, CAST(floor(CAST({s.unit} * count(*) FILTER (own = 'allow') AS DOUBLE) / count(*)) AS BIGINT) AS trust,
         CAST(floor(CAST({s.unit} * count(*) FILTER (own = 'block') AS DOUBLE) / count(*)) AS BIGINT) AS distrust
  FROM j WHERE host <> '' GROUP BY host),
start AS MATERIALIZED (
  SELECT 'trust' AS kind, host, trust * {stay} // 100 AS score FROM seeds WHERE trust > 0
  UNION ALL SELECT 'distrust', host, distrust * {stay} // 100 FROM seeds WHERE distrust > 0),
s0 AS (SELECT * FROM start)"""
    for k in range(s.rounds):
        text += f""",
s{k + 1} AS MATERIALIZED (
  SELECT kind, host, CAST(sum(score) AS BIGINT) AS score FROM (
    SELECT * FROM start UNION ALL
    SELECT e.kind, e.tohost, (s.score * {s.damping} // 100) // e.degree FROM edges e JOIN s{k} s ON e.kind = s.kind AND e.host = s.host)
  GROUP BY kind, host)"""
    return text + f""",
v AS (SELECT host, CAST(coalesce(sum(score) FILTER (kind = 'trust'), 0) AS BIGINT) AS trust,
             CAST(coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS BIGINT) AS distrust FROM s{s.rounds} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.own, CASE WHEN coalesce(v.distrust - v.trust, 0) >= {limit} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(v.trust, 0) AS trust, coalesce(v.distrust, 0) AS distrust
FROM j LEFT JOIN v ON j.host = v.host"""
