"""Mixing sources to target weights, by fixed-length blocks of words. DataFrame functions only.

The words of a source, document after document, are packed into blocks of ``block_words``
(the last may be shorter). Every output shard draws multinomial counts of blocks per source;
what the draws miss of a source's target, or exceed it by, is settled on the last shards that
drew it, so that the totals come out even. The n-th draw of a source takes block
``permutation(n mod blocks)`` of pass ``n div blocks``, with a pseudorandom permutation of
indices per source and pass, so blocks repeat only once all have been taken. Drawn indices
are joined with blocks by index.

Positions of documents within a source are prefix sums over hashed parts of about
``bucket_rows`` rows, so a source that holds most rows is never handled by one task; blocks are
joined on (source, index), which spreads a hot source over all tasks. Prefix sums over shards
are taken in stretches. The table of sources is metadata and is ordered in one task.

Settling makes the last shards' draws less than random: while a source is open its shards'
counts are multinomial, and only what quotas cut off is filled up from sources that lack draws.
That is about the square root of a source's draws, so a share that vanishes as the mix grows.

Defined results: a null text has size 0, as one without words; such documents are never
drawn (taken 0). Null is a source of its own, ordered last. A source of size 0 has target 0.
Rows that repeat an id are separate documents; null ids are allowed. An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import stored

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 8


@dataclass
class Mix:
    """sources: one row each with size, target, blocks, draws; slots: shard, slot, source's
    rank, pass and block; segments: which words of which document a block holds, and how often
    the mix takes them; taken: the sum of these per document."""

    sources: DataFrame
    slots: DataFrame
    segments: DataFrame
    taken: DataFrame


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeat: int) -> DataFrame:
    """sizes: source, source_size. Adds rank, weight and target.

    Targets are min(repeat * size, level * weight): with sources ordered by the level at which
    they reach their cap, a source is capped if the level without it in the cap exceeds that.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeat)
    all_, by = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(all_) * share
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("total", total).withColumn("capped", F.col("cap") / F.col("weight") < (total - capped) / left)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_), F.lit(0))
    open_ = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_)
    level = F.try_divide(rest, open_)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return t.withColumn("target", target).select("source", "rank", "source_size", "weight", "target")


def _permuted(index: Column, n: Column, rank: Column, turn: Column, seed: int) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap-or-not: in each round an index and its
    reflection about a keyed point either change places or don't)."""

    def round_(x: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(F.lit(seed), rank, turn, r), n) - x, n)
        swap = F.xxhash64(F.lit(seed + 1), rank, turn, r, F.greatest(x, mate)) % 2 == 0
        return F.when(swap, mate).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, round_)


def _cells(df: DataFrame, lo: str, hi: str, step: int) -> DataFrame:
    """Intervals [lo, hi) dealt to the cells of ``step`` that they touch, for an equi-join."""
    return df.where(f"{hi} > {lo}").withColumn("cell", F.explode(F.expr(f"sequence({lo} div {step}, ({hi} - 1) div {step})")))


def _running(df: DataFrame, value: str, by: list[str], order: str, step: int = 4096) -> DataFrame:
    """Adds ``upto``: the sum of ``value`` up to each row, of its group in order of ``order`` (distinct
    in a group): within stretches of ``step`` first, then over the stretches."""
    df = df.withColumn("_part", F.expr(f"{order} div {step}"))
    parts = df.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*by).orderBy("_part")) - F.col("_sum")
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), before.alias("_before"))
    on = F.col("_part") == F.col("_p")
    for c in by:
        on &= F.col(c) == F.col(f"_{c}")
    here = F.sum(value).over(W.partitionBy(*by, "_part").orderBy(order))
    return df.withColumn("_here", here).join(parts, on).withColumn("upto", F.col("_here") + F.col("_before")).drop("_here", "_before", "_part", "_p", *[f"_{c}" for c in by])


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    repeat: int = 3,
    block_words: int = 64,
    shard_blocks: int = 4096,
    bucket_rows: int = 100_000,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    d = stored(d, "sizes")
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(max(1024, -(-d.count() // bucket_rows)))))
    sources = _targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    draws = F.least(F.col("blocks") * repeat, F.coalesce(F.round(F.try_divide(F.col("target") * F.col("blocks"), "source_size")), F.lit(0)).cast("long"))
    hi = F.sum("draws").over(W.orderBy("rank"))
    sources = sources.withColumn("blocks", blocks).withColumn("draws", draws).withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("draws"))
    sources = stored(sources, "sources")
    total = sources.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]

    # multinomial counts: every slot of every shard draws its source on its own
    step = max(1, -(-total // 1024))
    drawn = docs.sparkSession.range(total).select(
        (F.expr(f"id div {shard_blocks}")).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("v")
    )
    within = _cells(sources.select("rank", "draws", "lo", "hi"), "lo", "hi", step)
    drawn = drawn.withColumn("cell", F.expr(f"v div {step}")).join(within, "cell").where("v >= lo and v < hi")
    counts = drawn.groupBy("shard", "rank").agg(F.count("*").alias("n"), F.first("draws").alias("draws"))
    kept = F.least("upto", "draws") - F.least(F.col("upto") - F.col("n"), F.col("draws"))
    counts = stored(_running(counts, "n", ["rank"], "shard").select("shard", "rank", "n", kept.alias("kept")), "draws")

    # what is open in shards goes to the sources that still lack draws
    open_ = counts.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("open")).where("open > 0")
    open_ = _running(open_.withColumn("all", F.lit(0)), "open", ["all"], "shard").withColumnRenamed("upto", "b").drop("all").withColumn("a", F.col("b") - F.col("open"))
    got = counts.groupBy("rank").agg(F.sum("kept").alias("got"))
    lack = sources.join(got, "rank", "left").select("rank", (F.col("draws") - F.coalesce("got", F.lit(0))).alias("lack")).where("lack > 0")
    lack = lack.withColumn("d", F.sum("lack").over(W.orderBy("rank"))).withColumn("c", F.col("d") - F.col("lack"))
    both = _cells(open_, "a", "b", 256).join(_cells(lack, "c", "d", 256), "cell")
    part = F.least("b", "d", (F.col("cell") + 1) * 256) - F.greatest("a", "c", F.col("cell") * 256)
    settled = both.select("shard", "rank", part.alias("n")).where("n > 0")
    counts = counts.select("shard", "rank", F.col("kept").alias("n")).unionAll(settled).groupBy("shard", "rank").agg(F.sum("n").alias("n"))
    counts = stored(_running(counts, "n", ["rank"], "shard").withColumn("first", F.col("upto") - F.col("n")).drop("upto").where("n > 0"), "counts")

    slots = counts.join(F.broadcast(sources.select("rank", "blocks")), "rank")
    # a row for each block of a shard and source grows by thousands: dealt first, by number so that it stays so
    slots = slots.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // (1 << 18))), "shard", "rank").withColumn("k", F.explode(F.expr("sequence(first, first + n - 1)")))
    slots = slots.withColumn("turn", F.expr("k div blocks")).withColumn("block", _permuted(F.expr("k % blocks"), F.col("blocks"), F.col("rank"), F.col("turn"), seed))
    slots = slots.select("shard", "k", "rank", "turn", "block")
    times = slots.groupBy("rank", "block").agg(F.count("*").alias("times"))

    # where each document lies in its source's stream of words
    d = d.join(sources.select(F.col("source").alias("of"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    base = d.groupBy("rank", "bucket").agg(F.sum("size").alias("sum"))
    base = base.select("rank", "bucket", (F.sum("sum").over(W.partitionBy("rank").orderBy("bucket")) - F.col("sum")).alias("base"))
    run = F.sum("size").over(W.partitionBy("rank", "bucket").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    row = F.row_number().over(W.partitionBy("rank", "bucket").orderBy("doc_id", "size"))
    d = d.withColumn("run", run).withColumn("row", row).join(base, ["rank", "bucket"])
    d = d.withColumn("lo", F.col("base") + F.col("run") - F.col("size")).withColumn("hi", F.col("base") + F.col("run"))
    held = F.when(F.col("size") > 0, F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})"))
    s = d.withColumn("block", F.explode_outer(held)).join(times, ["rank", "block"], "left")
    start = F.greatest("lo", F.col("block") * block_words) - F.col("lo")
    stop = F.least("hi", (F.col("block") + 1) * block_words) - F.col("lo")
    segments = s.select("doc_id", "rank", "bucket", "row", "size", "source_size", "target", "block", start.alias("start"), stop.alias("stop"), F.coalesce("times", F.lit(0)).alias("times"))
    words = F.coalesce(F.sum(F.col("times") * (F.col("stop") - F.col("start"))), F.lit(0))
    taken = segments.groupBy("rank", "bucket", "row", "doc_id", "size", "source_size", "target").agg(words.alias("taken"))
    return Mix(sources, slots, segments, taken.select("doc_id", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, plan: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the words that the mix takes, pass after pass, joined by spaces;
    documents of which nothing is taken go. Ids must be unique and not null."""
    got = plan.segments.where("times > 0").groupBy(F.col("doc_id").alias("of"))
    got = got.agg(F.array_sort(F.collect_list(F.struct("start", "stop", "times"))).alias("parts"))
    kept = docs.join(got, F.col(id_col) == F.col("of"))

    def made(words: Column) -> Column:
        def turn(t: Column) -> Column:
            return F.transform(F.filter("parts", lambda p: p["times"] >= t), lambda p: F.array_join(F.slice(words, (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int")), " "))

        turns = F.array_max(F.transform("parts", lambda p: p["times"].cast("int")))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), turns), turn)), " ")

    # as a variable the words are extracted once a text; as a column they would be inlined and extracted for every part
    text = F.element_at(F.transform(F.array(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))), made), 1)
    return kept.withColumn(text_col, text).select(docs.columns)
