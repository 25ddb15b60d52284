"""Mixing sources to target weights by temperature, as budgeted block permutations.

Source s holds the share p_s of all tokens; its weight is p_s ** a, normalised. The exponent a in [0, 1] is bisected until the weights
meet a target entropy, or until no source is repeated more often than a limit. A token budget then gives each source its tokens:
whole epochs of the source, and a part of one more.

A source's documents are dealt by hash over blocks of about BLOCK_TOKENS tokens, so a source with a third of all rows is spread
over as many tasks as it has blocks. Each epoch takes the blocks in a new pseudo-random order; the last one stops where the budget
ends: only the one block a source in which that happens is gone through row by row. Prefix sums run over groups of
SPAN blocks and then inside each group, so no task sees all blocks of a source.

Built-in functions only. Weights are kept in whole parts a billion, so that they don't depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from frostline.llm.common import Scratch, maybe_broadcast, packed, unpacked

BLOCK_TOKENS, SPAN, SEED, STEPS = 1 << 18, 512, 17, 60
REPETITION = 2.0


def count_tokens(text: Column) -> Column:
    """Words between white space, at least one a document."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))).cast("long")


def _hash(*parts: Column | str) -> Column:
    """60 bits of the md5 of the parts; any order by it is a pseudo-random permutation."""
    text = F.concat_ws("|", F.lit(str(SEED)), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def source_weights(totals: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, cover: bool = False) -> DataFrame:
    """(source, tokens, exponent, ppb, budget) from totals (source, tokens): one row a source.

    entropy: the weights' entropy, as a part of its largest value, the logarithm of the number of sources; reached with the
    largest exponent that does (1 if the shares have it already). repetition: the most times that a source may be gone through
    under the budget; reached with the smallest exponent that keeps it (1 if the budget is too large for any). Just one is given.
    budget: tokens of the mixture; None: as many as there are. cover: the budget is the least that takes every source once at least.
    """
    one = totals.agg(F.sort_array(F.collect_list("tokens")).alias("ts"), F.sum("tokens").cast("double").alias("total"))
    one = one.withColumn("shares", F.transform("ts", lambda t: t / F.col("total")))
    powers = lambda a: F.transform("shares", lambda p: F.pow(p, a))
    total = F.lit(float(budget)) if budget is not None else F.col("total")

    def high(a: Column) -> Column:
        """Whether a is at or over the exponent looked for."""
        z = _sum(powers(a))
        if entropy is not None:
            h = F.log(z) - a * _sum(F.transform("shares", lambda p: F.pow(p, a) * F.log(p))) / z
            return h <= F.lit(entropy) * F.log(F.size("shares").cast("double"))
        least = F.element_at("shares", 1)
        if cover:
            most = F.element_at("shares", -1)
            return F.pow(least / most, a - 1) <= repetition
        return F.pow(least, a - 1) / z * total / F.col("total") <= repetition

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = high(mid)
        return F.struct(F.when(up, acc["lo"]).otherwise(mid).alias("lo"), F.when(up, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda acc: acc["hi"])
    one = one.select("total", "shares", F.round(at, 9).alias("exponent")).withColumn("z", _sum(powers(F.col("exponent"))))
    if cover:  # the largest source, which a exponent under 1 shortens most, is taken once
        most = F.element_at("shares", -1)
        tokens = F.ceil(F.col("total") * F.pow(most, 1 - F.col("exponent")) * F.col("z"))
    else:
        tokens = total
    one = one.select("total", "exponent", "z", tokens.cast("long").alias("budget"))
    ppb = F.round(F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z") * 1e9).cast("long")
    return totals.crossJoin(F.broadcast(one)).select("source", "tokens", "exponent", ppb.alias("ppb"), "budget")  # one row on the right


def mix(docs: DataFrame, scratch: Scratch, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, cover: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture's rows: doc_id, source, mark, n_rows, n_tokens, epoch, block, slot, ppb; one for each time a document is taken.

    slot (0 to 1) orders the mixture: sorted by it, every stretch has about the target weights. ``mark`` is the md5 of the text. Repeated
    rows (same doc_id, source and text) are taken together as one row with n_rows over 1. Null sources make a source of their own (''), null
    texts count as empty, null doc_ids as an id. A document's tokens are its words, one at least. The last document
    that the budget reaches is taken whole. An empty table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.md5(text).alias("mark"), count_tokens(text).alias("n"))
    rows = rows.groupBy("doc_id", "source", "mark").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_tokens"))
    rows = scratch.stage("rows", rows.withColumn("key", _hash("doc_id", "source", "mark")))
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    weights = source_weights(totals, repetition, entropy, budget, cover)
    goal = F.floor(F.col("ppb").cast("decimal(20,0)") * F.col("budget").cast("decimal(18,0)") / F.lit(10**9).cast("decimal(10,0)")).cast("long")
    if cover:  # a weight's rounding must not cost the largest source a document
        goal = F.greatest(goal, "tokens")
    plan = weights.withColumn("goal", goal).withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("long"))
    plan = plan.withColumn("whole", F.expr("goal div tokens")).withColumn("rest", F.col("goal") % F.col("tokens"))
    plan = scratch.stage("plan", plan)
    sources = maybe_broadcast(plan.select("source", "blocks"))
    block = F.expr(f"(key div {1 << 24}) * blocks div {1 << 36}")
    dealt = rows.join(sources, "source").withColumn("block", block).drop("blocks")
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    taken = _epochs(scratch.stage("blocks", blocks), plan)
    out = dealt.join(taken, ["source", "block"])
    whole = out.where("before + size <= take").withColumn("passed", F.lit(0).cast("long"))
    order = Window.partitionBy("source", "epoch", "block").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    cut = out.where("before + size > take").withColumn("passed", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long")))
    kept = whole.unionByName(cut.where("before + passed < take"))
    slot = F.round((F.col("epoch") * F.col("tokens") + F.col("before")) / F.col("goal"), 9)
    return kept.select("doc_id", "source", "mark", "n_rows", "n_tokens", "epoch", "block", slot.alias("slot"), "ppb")


def _epochs(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """The blocks of each epoch with the tokens before them in the epoch's order, as far as the budget goes."""
    epochs = plan.select("source", "tokens", "goal", "ppb", F.explode(F.expr("transform(sequence(0L, whole), e -> struct(e AS epoch, if(e < whole, tokens, rest) AS take))")).alias("e"))
    epochs = epochs.select("source", "tokens", "goal", "ppb", "e.epoch", "e.take").where("take > 0")
    blocks = blocks.withColumn("span", F.expr(f"block div {SPAN}"))
    spans = blocks.groupBy("source", "span").agg(F.sum("size").alias("size")).join(maybe_broadcast(epochs), "source")
    past = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    spans = spans.withColumn("order", _hash("source", "epoch", "span"))
    spans = spans.withColumn("span_before", past(Window.partitionBy("source", "epoch").orderBy("order", "span"))).where("span_before < take").drop("order", "size")
    inner = blocks.join(spans, ["source", "span"]).withColumn("order", _hash("source", "epoch", "block"))
    inner = inner.withColumn("before", F.col("span_before") + past(Window.partitionBy("source", "epoch", "span").orderBy("order", "block")))
    return inner.where("before < take").select("source", "block", "size", "epoch", "take", "before", "tokens", "goal", "ppb")


def mix_documents(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The mixture as rows of docs, with their columns, whatever their names: each as often as it is taken.

    Nulls, empty texts, repeated rows and empty tables are taken as ``mix`` says.
    """
    taken = mix(docs, scratch, **how).groupBy("doc_id", "source", "mark").agg(F.count("*").cast("int").alias("times"))
    taken = scratch.stage("taken", taken).withColumnsRenamed({"doc_id": "t_id", "source": "t_source", "mark": "t_mark"})
    scratch.drop("rows", "plan", "blocks")
    marked = packed(docs, F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("from"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("m"))
    out = marked.join(taken, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("from") == F.col("t_source")) & (F.col("m") == F.col("t_mark")))
    return unpacked(out.select("row", F.explode(F.expr("sequence(1, times)"))), docs)


ORACLE = f"""
WITH RECURSIVE rows0 AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(text, '')) AS mark,
    greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')))::BIGINT AS n FROM documents),
rows1 AS (
  SELECT doc_id, source, mark, count(*) AS n_rows, sum(n)::BIGINT AS n_tokens,
    ('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), source, mark)), 1, 15))::BIGINT AS key
  FROM rows0 GROUP BY doc_id, source, mark),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM rows1 GROUP BY source),
shares AS (SELECT list(tokens / total ORDER BY tokens) AS ps FROM totals, (SELECT sum(tokens)::DOUBLE AS total FROM totals)),
search AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM shares
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN lo ELSE mid END, CASE WHEN up THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, mid, power(ps[1], mid - 1) / list_sum(list_transform(ps, lambda p: power(p, mid))) <= {REPETITION}::DOUBLE AS up
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM search WHERE i < {STEPS}), shares)),
found AS (SELECT round(hi, 9) AS a FROM search WHERE i = {STEPS}),
z AS (SELECT a, list_sum(list_transform(ps, lambda p: power(p, a))) AS z FROM found, shares),
weights AS (
  SELECT source, tokens, total::BIGINT AS budget, round(power(tokens / total, a) / z * 1e9)::BIGINT AS ppb
  FROM totals, z, (SELECT sum(tokens)::DOUBLE AS total FROM totals)),
plan AS (
  SELECT *, goal // tokens AS whole, goal % tokens AS rest, ((tokens + {BLOCK_TOKENS} - 1) // {BLOCK_TOKENS})::BIGINT AS blocks
  FROM (SELECT *, (ppb::HUGEINT * budget // 1000000000)::BIGINT AS goal FROM weights)),
dealt AS (SELECT rows1.*, (key // {1 << 24}) * blocks // {1 << 36} AS block FROM rows1 JOIN plan USING (source)),
blocks AS (SELECT source, block, block // {SPAN} AS span, sum(n_tokens)::BIGINT AS size FROM dealt GROUP BY source, block),
epochs AS (
  SELECT source, tokens, goal, ppb, epoch, CASE WHEN epoch < whole THEN tokens ELSE rest END AS take
  FROM (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM plan)),
spans AS (
  SELECT source, span, epoch, take, tokens, goal, ppb, coalesce(sum(size) OVER (PARTITION BY source, epoch
    ORDER BY md5(concat_ws('|', '{SEED}', source, epoch::VARCHAR, span::VARCHAR)), span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span_before
  FROM (SELECT source, span, sum(size) AS size FROM blocks GROUP BY source, span) JOIN epochs USING (source) WHERE take > 0),
inner_blocks AS (
  SELECT source, block, size, epoch, take, tokens, goal, ppb, span_before + coalesce(sum(size) OVER (PARTITION BY source, epoch, span
    ORDER BY md5(concat_ws('|', '{SEED}', source, epoch::VARCHAR, block::VARCHAR)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM blocks JOIN spans USING (source, span)),
taken AS (
  SELECT d.doc_id, d.source, d.mark, d.n_rows, d.n_tokens, b.epoch, b.block, b.ppb, b.before, b.take, b.tokens, b.goal,
    coalesce(sum(d.n_tokens) OVER (PARTITION BY d.source, b.epoch, b.block ORDER BY d.key, d.doc_id, d.mark
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed
  FROM dealt d JOIN inner_blocks b USING (source, block) WHERE b.before < b.take)
SELECT doc_id, source, mark, n_rows, n_tokens, epoch, block, ppb, round((epoch * tokens + before) / goal, 9) AS slot
FROM taken WHERE before + passed < take
"""
