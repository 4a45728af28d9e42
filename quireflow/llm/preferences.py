"""Preference pairs: one prompt, and a chosen and a rejected completion with their loss masks.

The turns that both conversations of a pair begin with (the longest common prefix of equal role and text) are rendered
once as the prompt, the rest of each as its completion. A mask lists the characters, counted from the start of the
prompt, that count for the loss: the text and end mark of assistant turns of the completion. The prompt is never in it.

Turns are in the order of turn, then role, then text; equal rows of one conversation count once. A null role is read as
"user", a null text as "". In a text "<|" becomes "< |", so that it can't pass for a mark. Null pair ids are left out.
A side without turns is an empty conversation. A pair is valid if either completion has a masked turn. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, MIDDLE, END, STOP = "<|im_start|>", "\n", "<|im_end|>", "\n"


def _turn(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END + STOP))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _mask(turns: Column, before: Column) -> Column:
    """Places of the assistant turns, where ``before`` characters come before the turns."""
    size = lambda t: F.length(_turn(t))
    head = lambda t: F.length(t["role"]) + len(START + MIDDLE)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, t: Column) -> Column:
        after = done["at"] + size(t)
        span = F.struct((done["at"] + head(t)).alias("start"), (after - len(STOP)).alias("end"))
        return F.struct(after.alias("at"), F.when(t["role"] == "assistant", F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    # one pass with a running place
    return F.aggregate(turns, F.struct(before.alias("at"), none.alias("spans")), add, lambda done: done["spans"])


def paired(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask (arrays of start and end) and valid,
    from turns (pair_id, turn, role, text) of either side. One shuffle, by pair."""
    clean = lambda df, side: df.where(F.col("pair_id").isNotNull()).select(
        "pair_id", F.lit(side).alias("side"), F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")).alias("t")
    )
    side = lambda s: F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t")))))
    both = clean(chosen, 0).unionByName(clean(rejected, 1)).groupBy("pair_id").agg(side(0).alias("a"), side(1).alias("b"))
    least = F.least(F.size("a"), F.size("b"))
    differs = lambda p: (p["a"]["role"] != p["b"]["role"]) | (p["a"]["text"] != p["b"]["text"])
    zipped = F.arrays_zip(F.slice("a", F.lit(1), least).alias("a"), F.slice("b", F.lit(1), least).alias("b"))
    apart = F.array_min(F.filter(F.transform(zipped, lambda p, i: F.when(differs(p), i)), lambda i: i.isNotNull()))
    cut = both.select("pair_id", "a", "b", F.coalesce(apart, least).alias("n"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    parts = cut.select("pair_id", "n", _rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"), rest("a").alias("a"), rest("b").alias("b"))
    masked = parts.select("pair_id", F.col("n").alias("n_prompt_turns"), "prompt", _rendered(F.col("a")).alias("chosen"), _rendered(F.col("b")).alias("rejected"), _mask(F.col("a"), F.length("prompt")).alias("chosen_mask"), _mask(F.col("b"), F.length("prompt")).alias("rejected_mask"))
    return masked.withColumn("valid", (F.size("chosen_mask") > 0) | (F.size("rejected_mask") > 0))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen one; in the rejected one the last answer is that of the conversation with the next
    id (without one, an empty answer). Masks are written as start:end, joined by commas."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answers = turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("answer"))
    last = answers.select("pair_id", "last")
    other = answers.select((F.col("pair_id") - 1).alias("pair_id"), F.coalesce("answer", F.lit("")).alias("other"))
    swapped = turns.join(last.join(other, "pair_id", "left"), "pair_id", "left")
    rejected = swapped.select("pair_id", "turn", "role", F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))
    out = paired(turns, rejected)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",").alias(c)
    return out.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", text("chosen_mask"), text("rejected_mask"), "valid")


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
ans AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS answer FROM c WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn = a.last THEN coalesce(o.answer, '') ELSE c.text END AS text
      FROM c LEFT JOIN ans a ON a.conv_id = c.conv_id LEFT JOIN ans o ON o.conv_id = c.conv_id + 1),
n AS (SELECT c.conv_id, coalesce(min(CASE WHEN c.text <> r.text THEN c.turn END), count(*)) AS n FROM c JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn GROUP BY c.conv_id),
s AS (SELECT 'a' AS side, * FROM c UNION ALL SELECT 'b', * FROM r),
t AS (SELECT side, conv_id, turn, role, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM s JOIN n USING (conv_id)),
u AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY side, conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM t),
g AS (SELECT conv_id, side, any_value(n) AS n,
        coalesce(string_agg(CASE WHEN turn < n THEN shown END, '' ORDER BY turn), '') AS prompt,
        coalesce(string_agg(CASE WHEN turn >= n THEN shown END, '' ORDER BY turn), '') AS rest,
        coalesce(string_agg(CASE WHEN turn >= n AND role = 'assistant' THEN (before + 13 + length(role))::VARCHAR || ':' || (before + length(shown) - 1)::VARCHAR END, ',' ORDER BY turn), '') AS mask
      FROM u GROUP BY conv_id, side)
SELECT a.conv_id AS pair_id, a.n::INTEGER AS n_prompt_turns, a.prompt, a.rest AS chosen, b.rest AS rejected, a.mask AS chosen_mask, b.mask AS rejected_mask, a.mask <> '' OR b.mask <> '' AS valid
FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.side = 'a' AND b.side = 'b'
"""
