"""From classified flows to alerts, risk steps and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from . import rules

# Watched addresses and the site that each serves.
SEEDS = [("104.21.8.244", "ohli365.org"), ("172.67.130.198", "ohli365.org"), ("2606:4700:3036::6815:8f4", "ohli365.org"), ("2606:4700:3036::ac43:82c6", "ohli365.org")]
CDN = 5


def verdicts(classified: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """classified: ``class_id, confidence``; labels: ``class_id, name, kind, typical`` (array). Adds
    ``class_name, typical, verdict``: unknown below ``least`` or without a label."""
    out = classified.join(F.broadcast(labels), "class_id", "left")  # a row a class
    unknown = F.col("kind").isNull() | (F.col("confidence") < least)
    name = F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    return out.withColumn("class_name", name).withColumn("verdict", F.when(unknown, "unknown").otherwise(F.col("kind"))).withColumn("typical", F.coalesce("typical", F.array().cast("array<string>"))).drop("name", "kind")


def watched(flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """flows: of ``verdicts``, with ``ip``; seeds: ``ip, site``. Flows to private addresses and those
    whose verdict says nothing go; benign and unknown ones to a seed become malicious ones of its
    site, with a confidence of 0.9 at least, and ``watch_only``: they give alerts on a match alone."""
    out = flows.where(~F.coalesce(rules.is_private(F.col("ip")), F.lit(False))).join(F.broadcast(seeds), "ip", "left")
    promoted = F.col("site").isNotNull() & F.col("verdict").isin("benign", "unknown")
    out = out.withColumn("watch_only", promoted)
    out = out.withColumn("class_name", F.when(promoted, F.col("site")).otherwise(F.col("class_name")))
    out = out.withColumn("typical", F.when(promoted & ~F.array_contains("typical", F.col("site")), F.concat("typical", F.array("site"))).otherwise(F.col("typical")))
    out = out.withColumn("confidence", F.when(promoted, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")))
    out = out.withColumn("verdict", F.when(promoted, "malicious").otherwise(F.col("verdict"))).drop("site")
    return out.where("verdict in ('malicious', 'known')")


def candidates(flows: DataFrame, live: DataFrame, known: DataFrame, passive: DataFrame, infra: list[str], cdn: int = CDN) -> tuple[DataFrame, DataFrame]:
    """The domains that a flow's alert names, and those to probe for addresses that serve many.

    flows: ``id, ip, class_name, typical``; live and known: ``ip, pos, domain``; passive: ``id, domain``.
    An address's domains are the live ones, then known ones that are new. Up to ``cdn`` of them all
    are candidates but infrastructure; beyond, one is: what passive DNS says, else the first under
    the class's site, else the first of all; and every domain is probed, those first that end like
    a reference's parent. Without any the address itself is the candidate.

    Gives ``id, pos, domain`` and ``id, domain, priority``.
    """
    both = live.select("ip", F.lit(0).alias("k"), "pos", "domain").unionByName(known.select("ip", F.lit(1).alias("k"), "pos", "domain"))
    both = both.join(flows.select("ip").distinct(), "ip", "left_semi")
    one = both.groupBy("ip", "domain").agg(F.min(F.struct("k", "pos")).alias("at"))
    lists = one.withColumn("pos", F.row_number().over(W.partitionBy("ip").orderBy("at", "domain"))).withColumn("n", F.count("*").over(W.partitionBy("ip")))
    short, long_ = lists.where(F.col("n") <= cdn).select("ip", "domain", "pos"), lists.where(F.col("n") > cdn).select("ip", "domain", "pos")
    few = flows.select("id", "ip").join(short, "ip").where(~rules.is_infra(F.col("domain"), infra)).select("id", "pos", "domain")

    # flows to an address and of a class share what is chosen, so its list is read once, not once a flow;
    # a domain fits a site that it equals or ends with after a dot: the sites that it fits are counted out
    site = F.when(F.col("class_name").contains("."), rules.last_two_labels(F.col("class_name"))).otherwise(F.col("class_name"))
    sites = flows.select("ip", "class_name", site.alias("site")).distinct()
    labels = F.split("domain", "[.]", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = long_.select("ip", "domain", "pos", F.explode(ends).alias("site")).join(sites, ["ip", "site"])
    fit = fit.groupBy("ip", "class_name").agg(F.min(F.struct("pos", "domain")).alias("fit"))
    first = long_.groupBy("ip").agg(F.min(F.struct("pos", "domain")).alias("first"))
    crowded = flows.select("id", "ip", "class_name").join(first, "ip").join(fit, ["ip", "class_name"], "left")
    chosen = crowded.groupBy("id").agg(F.min("fit")["domain"].alias("fit"), F.min("first")["domain"].alias("first"))
    chosen = chosen.join(passive.select("id", F.col("domain").alias("seen")), "id", "left").select("id", F.lit(1).alias("pos"), F.coalesce("seen", "fit", "first").alias("domain"))
    named = few.unionByName(chosen.where(~rules.is_infra(F.col("domain"), infra)))
    # the address stands in only where there is nothing to name and nothing to probe
    bare = flows.select("id", "ip").join(named.select("id"), "id", "left_anti").join(chosen.select("id"), "id", "left_anti")
    bare = bare.where(~rules.is_infra(F.col("ip"), infra)).select("id", F.lit(1).alias("pos"), F.col("ip").alias("domain"))

    refs = F.array_distinct(F.concat(F.array("class_name"), "typical"))
    roots = F.array_compact(F.transform(refs, rules.after_first_dot))
    many = flows.select("id", "ip", "class_name", "typical").join(long_, "ip")
    queue = many.select("id", "domain", F.exists(roots, lambda r: F.endswith(F.col("domain"), r)).alias("priority"))
    return named.unionByName(bare), queue


def references(flows: DataFrame) -> DataFrame:
    """``id, pos, ref``: the class's name and its typical domains, once each, in order."""
    return flows.select("id", F.posexplode(F.array_distinct(F.concat(F.array("class_name"), "typical"))).alias("pos", "ref"))


def probe_step(domains: DataFrame, now: int, cache_s: int) -> DataFrame:
    """domains: ``domain, last_success, has_print, fetched`` (null: the fetch failed) and ``generic``.
    Adds ``step``: Compare (with the stored or the fetched print), NoBaseline or Unreachable."""
    recent = F.coalesce(F.lit(now) - F.col("last_success") < cache_s, F.lit(False)) if cache_s > 0 else F.lit(False)
    step = F.when(~rules.probeable(F.col("domain")), "NoBaseline").when(recent & F.col("has_print"), "Compare").when(recent, "Unreachable")
    return domains.withColumn("step", step.when(F.col("fetched").isNull(), "Unreachable").when(F.col("generic"), "NoBaseline").otherwise("Compare"))


def alerts(flows: DataFrame, named: DataFrame, outcomes: DataFrame) -> DataFrame:
    """named: ``id, pos, domain``; outcomes: ``id, domain, verdict, label, distance, ref`` of the probes
    (a candidate without one has no baseline). ``id, domain, severity, alert_type, detail, delta, cap``;
    of watched flows only matches."""
    r = named.join(flows.select("id", "ip", "verdict", "class_name", "confidence", "guessed", "watch_only"), "id")
    r = r.join(outcomes.withColumnRenamed("verdict", "probe"), ["id", "domain"], "left")
    r = r.withColumn("probe", F.coalesce("probe", F.lit("NoBaseline"))).where(~F.col("watch_only") | (F.col("probe") == "Match"))
    r = r.withColumn("outcome", F.when(F.col("probe") == "Match", F.col("label")).otherwise(F.col("probe")))
    note = F.when(F.col("probe") == "Match", rules.match_note(F.col("label"), F.col("distance"), F.col("ref"))).when(F.col("probe") == "NoMatch", "[no HTML match]")
    base = rules.base_severity(F.col("verdict"), F.col("confidence"))
    risk = rules.outcome_risk(F.col("outcome"), F.col("verdict"))
    return r.select(
        "id",
        "domain",
        rules.outcome_severity(F.col("outcome"), F.col("verdict"), base).alias("severity"),
        F.when(F.col("verdict") == "malicious", "PREFILTER_MALICIOUS").otherwise("PREFILTER_CLASSIFIED").alias("alert_type"),
        rules.alert_detail(F.col("class_name"), F.col("confidence"), F.col("guessed"), note).alias("detail"),
        risk["delta"].alias("delta"),
        risk["cap"].alias("cap"),
        "outcome",
    )


def to_probe(queue: DataFrame, alerts: DataFrame, refs: DataFrame) -> DataFrame:
    """All probes that follow: of crowded addresses, of candidates that could not be reached or have
    no baseline, and of their references then. ``place, domain, priority``: each domain once, with
    priority first, then in order of flow and name."""
    again = alerts.where("outcome in ('NoBaseline', 'Unreachable')").select("id", "domain")
    wanted = alerts.where("outcome = 'NoBaseline'").select("id").distinct().join(refs, "id").select("id", F.col("ref").alias("domain"))
    every = queue.unionByName(again.unionByName(wanted).withColumn("priority", F.lit(False)))
    one = every.groupBy("domain").agg(F.max("priority").alias("priority"), F.min("id").alias("id"))
    return one.select("domain", "priority", F.struct((~F.col("priority")).alias("later"), "id", "domain").alias("place"))
