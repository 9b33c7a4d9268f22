"""Operator 9, chat formatting of preference pairs.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt; what follows is
rendered as two completions, each with the character spans of assistant turns to train on (all else is masked). Everything
is an expression over arrays of turns, so the operator itself neither shuffles nor leaves the JVM. A conversation is one
value and is gathered in one task, so it has to fit a row; conversations themselves are dealt by their ids.

Defined results: null roles and texts render as empty; a pair without any common turn has an empty prompt; a pair of equal
conversations has empty completions and ``valid`` false, as has one whose completion lacks an assistant turn; a null array
counts as empty; turns are ordered by number (null first), then role and text, so repeated numbers have one order; further
columns of pairs travel untouched, one that is named like an output comes back as name_in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carrying, checkpointed
from .ordering import cut_points, place_of, with_ranges


@dataclass(frozen=True)
class Template:
    start: str = "<|"
    after_role: str = "|>\n"
    end: str = "\n"
    trained_role: str = "assistant"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the ordered turns of a conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def render(turns: Column, t: Template) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(t.start), x["role"], F.lit(t.after_role), x["text"], F.lit(t.end))), "")


def spans(turns: Column, t: Template) -> Column:
    """Spans [begin, end) of code points, within the rendering of ``turns``, of the trained role's texts and their end mark."""
    head = len(t.start) + len(t.after_role)

    def step(acc, x):
        begin = acc["at"] + head + F.length(x["role"])
        end = begin + F.length(x["text"]) + len(t.end)
        span = F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))
        return F.struct(F.when(x["role"] == t.trained_role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"), end.cast("long").alias("at"))

    zero = F.struct(F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


MADE = ("n_prompt_turns", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans", "valid")


def preference_format(pairs: DataFrame, t: Template = Template()) -> DataFrame:  # noqa: B008
    """pairs with ``chosen`` and ``rejected`` (arrays of struct(turn, role, text)) -> their other columns, prompt,
    n_prompt_turns, completions, the spans to train on and ``valid``."""
    same = lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    plain = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(pairs.schema[c].dataType)), lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))

    def formatted(df: DataFrame) -> DataFrame:
        df = df.withColumn("one", plain("chosen")).withColumn("two", plain("rejected"))
        least = F.least(F.size("one"), F.size("two"))
        agree = F.zip_with(F.slice("one", 1, least), F.slice("two", 1, least), same)
        first_difference = F.array_position(agree, F.lit(False))
        out = df.withColumn("n_prompt_turns", F.when(first_difference > 0, first_difference - 1).otherwise(least.cast("long")))
        n = F.col("n_prompt_turns").cast("int")
        out = out.withColumn("prompt", render(F.slice("one", F.lit(1), n), t))
        for side, c in (("chosen", "one"), ("rejected", "two")):
            rest = F.slice(F.col(c), n + 1, F.greatest(F.lit(0), F.size(c) - n))
            out = out.withColumn(f"{side}_completion", render(rest, t)).withColumn(f"{side}_spans", spans(rest, t))
        return out.withColumn("valid", (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0))

    return carrying(pairs, ("chosen", "rejected"), MADE, formatted).drop("chosen", "rejected")


def next_known(ids: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """conv_id (distinct) -> conv_id, partner_id: the next one in order, the first after the last; none for a single one.

    Each task orders one range of ids; a first id for each range is all that the ranges tell each other."""
    ids = checkpointed(ids)
    place = place_of(ids, "conv_id")
    ranged = checkpointed(with_ranges(ids, place, cut_points(ids, place, max(1, -(-ids.count() // rows_per_range)))))
    firsts = [tuple(r) for r in ranged.groupBy("range_id").agg(F.min("conv_id").alias("first")).orderBy("range_id").collect()]
    after = [(k, firsts[(i + 1) % len(firsts)][1]) for i, (k, _) in enumerate(firsts)]
    table = ids.sparkSession.createDataFrame(after, f"range_id int, next_first {ids.schema['conv_id'].dataType.simpleString()}")
    follower = F.lead("conv_id").over(Window.partitionBy("range_id").orderBy("conv_id"))
    rows = ranged.join(F.broadcast(table), "range_id").withColumn("follower", F.coalesce(follower, "next_first"))  # a row for each range
    return rows.select("conv_id", F.when(F.col("follower") != F.col("conv_id"), F.col("follower")).alias("partner_id"))


def swapped_answers(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, partner_id, chosen, rejected for every conversation: the conversation up to its last assistant turn against the
    same one whose last assistant turn says what the next such conversation's says (in order of conv_id, the first after the
    last). Without an assistant turn, a partner or a conv_id, both sides are the whole conversation and partner_id is conv_id."""
    turns = checkpointed(turns_of(conversations))
    last = F.array_max(F.transform(F.filter("turns", lambda x: x["role"] == role), lambda x: x["turn"]))
    known = turns.withColumn("last", F.when(F.col("conv_id").isNotNull(), last))
    ends = known.where("last IS NOT NULL")
    answer = F.element_at(F.filter("turns", lambda x: (x["role"] == role) & (x["turn"] == F.col("last"))), -1)["text"]
    partner = next_known(ends.select("conv_id")).join(ends.select(F.col("conv_id").alias("partner_id"), answer.alias("other")), "partner_id")
    joined = known.join(partner, "conv_id", "left")
    paired = F.col("partner_id").isNotNull()
    cut = F.filter("turns", lambda x: x["turn"] <= F.col("last"))
    replaced = F.transform(cut, lambda x: F.when((x["turn"] == F.col("last")) & (x["role"] == role), F.struct(x["turn"].alias("turn"), x["role"].alias("role"), F.col("other").alias("text"))).otherwise(x))
    return joined.select("conv_id", F.coalesce("partner_id", "conv_id").alias("partner_id"), F.when(paired, cut).otherwise(F.col("turns")).alias("chosen"), F.when(paired, replaced).otherwise(F.col("turns")).alias("rejected"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference_format(swapped_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    edge = lambda c, i, what: F.when(F.col("valid"), F.element_at(F.col(c), i)[what]).otherwise(F.lit(0).cast("long"))
    return out.select("conv_id", "partner_id", "n_prompt_turns", "prompt", "chosen_completion", "rejected_completion", "valid",
                      edge("chosen_spans", 1, "begin").alias("chosen_begin"), edge("chosen_spans", -1, "end").alias("chosen_end"),
                      edge("rejected_spans", 1, "begin").alias("rejected_begin"), edge("rejected_spans", -1, "end").alias("rejected_end"))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, max(turn) AS last FROM c WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id),
n AS (
  SELECT conv_id, last, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS follower FROM l),
o AS (SELECT c.conv_id, max(c.text) AS answer FROM c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.last AND c.role = 'assistant' GROUP BY c.conv_id),
m AS (SELECT n.conv_id, n.last, n.follower AS partner_id, o.answer FROM n JOIN o ON o.conv_id = n.follower WHERE n.follower <> n.conv_id),
p AS (
  SELECT c.conv_id, coalesce(m.partner_id, c.conv_id) AS partner_id, c.turn, c.role, c.text,
         CASE WHEN c.role = 'assistant' AND c.turn = m.last THEN m.answer ELSE c.text END AS other,
         row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text) AS pos
  FROM c LEFT JOIN m ON m.conv_id = c.conv_id WHERE m.conv_id IS NULL OR c.turn <= m.last),
f AS (SELECT *, coalesce(min(pos) FILTER (text <> other) OVER (PARTITION BY conv_id), count(*) OVER (PARTITION BY conv_id) + 1) AS cut FROM p),
g AS (
  SELECT conv_id, partner_id, CAST(min(cut) - 1 AS BIGINT) AS n_prompt_turns,
         coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) FILTER (pos < cut), '') AS prompt,
         coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) FILTER (pos >= cut), '') AS chosen_completion,
         coalesce(string_agg('<|' || role || '|>' || chr(10) || other || chr(10), '' ORDER BY pos) FILTER (pos >= cut), '') AS rejected_completion
  FROM f GROUP BY conv_id, partner_id)
SELECT *, chosen_completion <> '' AS valid,
       CAST(CASE WHEN chosen_completion <> '' THEN 14 ELSE 0 END AS BIGINT) AS chosen_begin,
       CAST(CASE WHEN chosen_completion <> '' THEN length(chosen_completion) ELSE 0 END AS BIGINT) AS chosen_end,
       CAST(CASE WHEN chosen_completion <> '' THEN 14 ELSE 0 END AS BIGINT) AS rejected_begin,
       CAST(CASE WHEN chosen_completion <> '' THEN length(rejected_completion) ELSE 0 END AS BIGINT) AS rejected_end
FROM g
"""
