"""Keyed tables in a folder, merged batch by batch.

A table is a folder of versions; the newest whole one counts. A merge reads it, joins the batch
and writes the next version, so readers never see half a merge and a merge that fails leaves the
table as it was. Each batch has a name, kept with the version: a batch that was merged before
changes nothing, so merges may be repeated. The last ``keep`` versions stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import rules
from ..runtime import stored


class State:
    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep
        jvm = spark._jvm.org.apache.hadoop.fs
        self._of = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        root = self._of(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and self._fs.exists(self._of(f"{self.path}/{n}/rows/_SUCCESS")) and self._fs.exists(self._of(f"{self.path}/{n}/batches/_SUCCESS")))

    def read(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v[-1]}/rows") if v else self.spark.createDataFrame([], self.schema)

    def batches(self) -> set[str]:
        v = self._versions()
        return {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/v{v[-1]}/batches").collect()} if v else set()

    def merge(self, batch: str, with_old: Callable[[DataFrame], DataFrame]) -> bool:
        """Writes ``with_old(the rows so far)``; False if the batch was merged before."""
        done, versions = self.batches(), self._versions()
        if batch in done:
            return False
        to = f"{self.path}/v{versions[-1] + 1 if versions else 1}"
        columns = self.spark.createDataFrame([], self.schema).columns
        with_old(self.read()).select(columns).write.mode("overwrite").parquet(f"{to}/rows")
        self.spark.createDataFrame([(b,) for b in sorted(done | {batch})], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{to}/batches")
        for v in versions[: -self.keep + 1] if self.keep > 1 else versions:
            self._fs.delete(self._of(f"{self.path}/v{v}"), True)
        return True


DOMAINS = "domain string, risk_score int, decision string, first_seen long, last_seen long"
DOMAIN_IPS = "domain string, ip string, first_seen long, last_seen long"
ALERTS = "id long, domain string, severity int, alert_type string, detail string, ts long, acknowledged boolean"
PROBE_RUNS = "domain string, ts long, success boolean"
BUCKETS = "minute long, ips long, alerts long, domains long, probes long"
CACHE = "provider string, key string, ts long, status long, body binary"
SNAPSHOTS = "id long, domain string, ts long, simhash long, title string, h1 string, bigrams array<string>, css array<string>, words array<string>"


def upsert_seen(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """seen: the keys and ``ts``. First and last times of each key; other columns of old rows stay, new rows have nulls there."""
    new = seen.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    out = old.join(new, keys, "full")
    first = F.least(F.coalesce("first_seen", "_first"), F.coalesce("_first", "first_seen"))
    last = F.greatest(F.coalesce("last_seen", "_last"), F.coalesce("_last", "last_seen"))
    return out.withColumn("first_seen", first).withColumn("last_seen", last).select(old.columns)


def upsert_domain_ips(old: DataFrame, seen: DataFrame) -> DataFrame:
    return upsert_seen(old, seen.where("ip <> ''"), ["domain", "ip"])


def add_to_buckets(old: DataFrame, events: DataFrame) -> DataFrame:
    """events: ``ts`` and any of the counters; counters of their minute grow by them."""
    counters = ["ips", "alerts", "domains", "probes"]
    new = events.select((F.col("ts") - F.pmod("ts", F.lit(60))).alias("minute"), *[(F.col(c) if c in events.columns else F.lit(0)).cast("long").alias(c) for c in counters])
    return old.unionByName(new).groupBy("minute").agg(*[F.sum(c).alias(c) for c in counters])


def append_alerts(old: DataFrame, new: DataFrame) -> DataFrame:
    """new: alerts without ids: they go on from the largest, in order of (ts, domain, severity, alert_type, detail).
    Numbered by ranges of that order, not in one task. The ranges come from a sample that each run
    draws anew, so the dealt rows are written once, and both their numbers and the ranges' sizes are read from there."""
    order = ["ts", "domain", "severity", "alert_type", "detail"]
    last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # the number of the range above 33 bits that count its rows
    dealt = stored(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "alerts")
    part = F.shiftright("_at", 33).cast("int").alias("_part")
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy(part).count().collect())  # a row per partition
    at, starts = last, []
    for one, n in sizes:
        starts.append((one, at))
        at += n
    starts = old.sparkSession.createDataFrame(starts, "_part int, _start long")
    numbered = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return old.unionByName(numbered.withColumn("acknowledged", F.lit(False)).select(old.columns))


def acknowledge(old: DataFrame, ids: list[int]) -> DataFrame:
    return old.withColumn("acknowledged", F.col("acknowledged") | F.col("id").isin(ids))


def raise_risk(old: DataFrame, steps: DataFrame) -> DataFrame:
    """steps: ``domain, delta, cap`` and ``ts, id`` for their order. Each sets the score to
    min(score + delta, its cap), which can lower it. Domains that old lacks are left out.

    A run of steps is min(score + D, C) with D the sum of deltas and C = min over steps j of
    cap_j + the sum of later deltas, so steps are folded per domain before the join.
    """
    w = W.partitionBy("domain").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    run = steps.withColumn("_d", F.sum("delta").over(w))
    fold = run.groupBy("domain").agg(F.sum("delta").alias("_sum"), F.min(F.col("cap") - F.col("_d")).alias("_room"))
    score = F.least(F.coalesce("risk_score", F.lit(0)) + F.col("_sum"), F.col("_sum") + F.col("_room"))
    out = old.join(fold, "domain", "left").withColumn("risk_score", F.when(F.col("_sum").isNull(), F.col("risk_score")).otherwise(score.cast("int")))
    return out.withColumn("decision", F.when(F.col("_sum").isNull(), F.col("decision")).otherwise(rules.decision(F.col("risk_score")))).select(old.columns)


def put_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest entry of each provider and key; of one time, the batch's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(old.columns).withColumn("_new", F.lit(1)))
    rest = F.struct(*[c for c in old.columns if c not in ("provider", "key")])
    return both.groupBy("provider", "key").agg(F.max_by(rest, F.struct("_new", "ts", "status", "body")).alias("x")).select("provider", "key", "x.*")


def clear_cache(old: DataFrame, key: str | None = None) -> DataFrame:
    """Without the entries of a key (of all providers), or without any."""
    return old.where(F.col("key") != key) if key is not None else old.limit(0)


def save_snapshots(old: DataFrame, prints: DataFrame, ts: int) -> DataFrame:
    """prints: fingerprints, one a domain; they are appended with ids after the largest."""
    last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = prints.withColumn("ts", F.lit(ts).cast("long")).withColumn("id", F.lit(last) + F.row_number().over(W.orderBy("domain")))
    return old.unionByName(new.select(old.columns))


def migrate_ips(old: DataFrame, legacy: DataFrame, domains: DataFrame) -> DataFrame:
    """Adds the pairs of legacy whose domain is known and that old lacks, once each."""
    known = legacy.join(domains.select("domain"), "domain", "left_semi").groupBy("domain", "ip").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return old.unionByName(known.join(old, ["domain", "ip"], "left_anti").select(old.columns))


def prune(manifest: DataFrame, keep: int, by: str = "domain") -> DataFrame:
    """The newest ``keep`` entries of each; 0 keeps all."""
    if keep == 0:
        return manifest
    n = F.row_number().over(W.partitionBy(by).orderBy(F.col("ts").desc(), F.col("id").desc()))
    return manifest.withColumn("_n", n).where(F.col("_n") <= keep).drop("_n")
