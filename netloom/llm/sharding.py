"""Sharding by sampled splitters. DataFrame functions only.

Keys are hashes of the texts, so equal texts (a group) are neighbours. A size-weighted sample
of keys gives quantile boundaries of many more ranges than shards; exact sizes per range then
follow from one aggregation. Overfull ranges are subdivided: groups that alone exceed a range,
in bytes or in rows, are taken out and cut into pieces by id, and what is still overfull is cut
by key. The ranges are dealt to shards in key order so that the shards' bytes come out near
equal. The pieces of a group go to one shard unless the group is larger than a shard's equal
share; then they are ranges like others.

Rows are numbered within their range or piece, from where the shard's ranges before it end. A
range or piece has about as many rows as one of the ``ranges``, so no task holds a hot group;
only rows that share their text and their id stay together. Texts are not shuffled. What the
driver plans with are sums per range: there are ``shards * PER_SHARD`` ranges, one more for each
million rows, and at most four pieces for each.

Defined results: a null text has size 1 and checksum 0, and nulls form one group; a null id
is allowed; rows that repeat are numbered separately; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import stored

PER_SHARD = 64  # ranges for each shard at least
PER_RANGE = 16  # sampled keys for each range


def _deal(units: list, shards: int) -> list[tuple]:
    """units: rows of unit, grp, whole, bytes, n in key order. Gives (unit, shard, offset).

    Groups that must stay whole go first, largest first, each to the emptiest shard; the
    rest fills the shards' remaining room in key order."""
    room = [sum(u["bytes"] for u in units) / shards] * shards
    of: dict = {}
    groups: dict = {}
    large = sum(u["bytes"] for u in units) / shards / 4  # a range with one long text can be that large
    for u in units:
        if u["whole"] or u["bytes"] > large:
            groups.setdefault(u["grp"] if u["whole"] else (u["unit"],), []).append(u)
    for _, parts in sorted(groups.items(), key=lambda x: (-sum(u["bytes"] for u in x[1]), x[1][0]["unit"])):
        j = max(range(shards), key=lambda i: (room[i], -i))
        room[j] -= sum(u["bytes"] for u in parts)
        of.update((u["unit"], j) for u in parts)
    rest = [u for u in units if u["unit"] not in of]
    free = [max(0.0, r) for r in room]
    scale = sum(u["bytes"] for u in rest) / max(1e-9, sum(free))
    edge, at, done = [], 0.0, 0.0
    for f in free:
        at += f * scale
        edge.append(at)
    j = 0
    for u in rest:
        while j < shards - 1 and done + u["bytes"] / 2 > edge[j]:
            j += 1
        of[u["unit"]] = j
        done += u["bytes"]
    offset, out = [0] * shards, []
    for u in units:
        j = of[u["unit"]]
        out.append((u["unit"], j, offset[j]))
        offset[j] += u["n"]
    return out


def shard(docs: DataFrame, shards: int = 8, range_rows: int = 1_000_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size long, text_crc32 long, shard int, slot long``."""
    spark = docs.sparkSession
    text = F.col(text_col)
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    d = stored(d, "keys")
    n, total = d.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * PER_SHARD, -(-n // range_rows))
    mean, rows = max(1.0, total / ranges), max(1.0, n / ranges)

    # size-weighted sample of keys, quantile boundaries
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h", "size"), F.lit(1 << 53)) / float(1 << 53)
    hits = F.floor(F.col("size") * (PER_RANGE / mean) + u)
    sample = d.select("h", hits.alias("w")).where("w > 0").withColumn("upto", F.sum("w").over(W.orderBy("h")))
    bound = sample.withColumn("q", F.expr(f"upto div {PER_RANGE}")).groupBy("q").agg(F.min("h").alias("lo")).select("lo").distinct()
    low, high = -(1 << 63), (1 << 63) - 1
    bound = bound.unionAll(spark.range(1).select(F.lit(low).cast("long"))).distinct()
    key = W.orderBy("lo")
    bound = bound.select("lo", F.lead("lo").over(key).alias("hi"), F.row_number().over(key).alias("rid"))
    cells = F.expr(f"sequence(shiftright(lo, 52), shiftright(coalesce(hi - 1, {high}), 52))")
    bound = stored(bound.withColumn("cell", F.explode(cells)), "bounds")

    # groups beyond a range are cut by id; up to a shard's share they stay in one shard
    heavy = d.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > mean) | (F.col("n") > 2 * rows))
    cut = F.greatest(F.ceil(F.col("n") / rows), F.when(F.col("bytes") > total / shards, F.ceil(F.col("bytes") / mean)).otherwise(1))
    heavy = stored(heavy.select("h", cut.cast("long").alias("pieces"), (F.col("bytes") <= total / shards).alias("whole")), "groups")
    d = d.join(F.broadcast(heavy), "h", "left")  # fewer than twice ``ranges`` rows
    plain = d.where("pieces is null").withColumn("cell", F.shiftright("h", 52)).join(F.broadcast(bound), "cell").where("h >= lo and (hi is null or h < hi)")
    plain = stored(plain.select("doc_id", "size", "text_crc32", "h", "rid", "lo", "hi"), "ranged")

    # ranges that came out overfull are cut by key
    full = plain.groupBy("rid").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    full = full.where((F.col("bytes") > 2 * mean) | (F.col("n") > 4 * rows))
    full = stored(full.select("rid", F.greatest(F.ceil(F.col("bytes") / mean), F.ceil(F.col("n") / rows)).alias("parts")), "overfull")
    share = (F.col("h").cast("double") - F.col("lo")) / (F.coalesce(F.col("hi"), F.lit(high)).cast("double") - F.col("lo").cast("double"))
    part = F.least(F.col("parts") - 1, F.floor(share * F.col("parts")))
    plain = plain.join(F.broadcast(full), "rid", "left").select(
        "doc_id", "size", "text_crc32", "h", F.lit(False).alias("whole"), F.lit(None).cast("long").alias("grp"), F.xxhash64(F.lit(0), "rid", F.coalesce(part, F.lit(0)).cast("long")).alias("unit")
    )
    piece = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("pieces"))
    grouped = d.where("pieces is not null").select("doc_id", "size", "text_crc32", "h", "whole", F.col("h").alias("grp"), F.xxhash64(F.lit(1), "h", piece).alias("unit"))
    placed = stored(plain.unionAll(grouped), "units")

    units = placed.groupBy("unit").agg(F.min("h").alias("lo"), F.first("whole").alias("whole"), F.first("grp").alias("grp"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    dealt = spark.createDataFrame(_deal(units.orderBy("lo", "unit").collect(), shards), "unit long, shard int, offset long")
    rank = F.row_number().over(W.partitionBy("unit").orderBy("h", "doc_id", "size", "text_crc32"))
    out = placed.withColumn("rank", rank).join(F.broadcast(dealt), "unit")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))
