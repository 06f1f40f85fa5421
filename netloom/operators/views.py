"""What the monitoring pages show, as DataFrames over the caller's tables."""

from __future__ import annotations

from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import rules

PAGE = 200


def alert_request(query: str) -> dict:
    """``show_acked, min_severity, page`` of a query string; what is no number counts as missing."""
    given = [p.split("=", 1) for p in query.split("&") if "=" in p]

    def number(name: str, most: int, default: int) -> int:
        return next((int(v) for k, v in given if k == name and v.isascii() and v.isdigit() and int(v) <= most), default)

    return {"show_acked": "ack=show" in query, "min_severity": number("sev", 255, 0), "page": max(1, number("page", 1 << 62, 1))}


def probe_request(query: str) -> dict | None:
    """``ip, sources, verify``; None without an address."""
    out = {"ip": "", "sources": ["ptr", "hackertarget"], "verify": False}
    for k, v in parse_qsl(query, keep_blank_values=True):
        if k == "ip":
            out["ip"] = v
        elif k == "sources":
            out["sources"] = v.split(",")
        elif k == "verify":
            out["verify"] = v in ("on", "1")
    return out if out["ip"] else None


def source_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def selected(alerts: DataFrame, show_acked: bool = False, min_severity: int = 0) -> DataFrame:
    out = alerts if show_acked else alerts.where(~F.col("acknowledged"))
    return out.where(F.col("severity") >= min_severity) if min_severity > 0 else out


def alerts_page(alerts: DataFrame, show_acked: bool = False, min_severity: int = 0, page: int = 1, size: int = PAGE) -> tuple[DataFrame, int, int]:
    """The alerts of one page, newest first; the page, held between 1 and the last; and how many pages there are."""
    rows = selected(alerts, show_acked, min_severity)
    pages = -(-rows.count() // size)
    page = min(max(page, 1), max(pages, 1))
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).offset((page - 1) * size).limit(size), page, pages


def newest(rows: DataFrame, n: int, by: str | None = None, at: str = "ts", key: str = "id", up: bool = False) -> DataFrame:
    """The newest n of each ``by`` (or of all), ties to the larger key (to the smaller, if ``up``)."""
    order = [F.col(at).desc(), F.col(key).asc() if up else F.col(key).desc()]
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def severity_breakdown(alerts: DataFrame) -> DataFrame:
    """``severity, label, n, pct`` of open alerts for 1 to 5; pct: of the largest, rounded down."""
    counts = selected(alerts).groupBy("severity").agg(F.count("*").alias("n"))
    spine = alerts.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("severity"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    out = spine.join(counts, "severity", "left").select("severity", rules.severity_label(F.col("severity")).alias("label"), n.alias("n"))
    return out.withColumn("pct", F.floor(F.col("n") * 100 / F.greatest(F.max("n").over(W.partitionBy()), F.lit(1))))  # five rows


def _when(c: Column, name: str) -> Column:
    return F.count(F.when(c, 1)).alias(name)


def totals(domains: DataFrame, alerts: DataFrame, ips: DataFrame, probes: DataFrame) -> DataFrame:
    """One row: domains, open alerts and those of each kind, distinct addresses, probes and the last of them."""
    kind = F.col("alert_type")
    a = alerts.agg(_when(~F.col("acknowledged"), "open_alerts"), _when(kind == "PREFILTER_MALICIOUS", "malicious"), _when(kind == "PREFILTER_CLASSIFIED", "classified"), _when(kind == "PREFILTER_UNKNOWN", "unknown"))
    p = probes.agg(F.count("*").alias("probes"), F.max("ts").alias("last_probe_ts"))
    return domains.agg(F.count("*").alias("domains")).join(a).join(ips.agg(F.countDistinct("ip").alias("ips"))).join(p)  # one row each


def domain_list(domains: DataFrame, alerts: DataFrame, ips: DataFrame, shown: int = 5) -> DataFrame:
    """A row per domain, with its open alerts and its newest addresses."""
    open_ = selected(alerts).groupBy("domain").agg(F.count("*").alias("open_alerts"))
    last = newest(ips, shown, "domain", "last_seen", "ip", up=True).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct((-F.col("last_seen")).alias("o"), "ip"))).alias("l"))
    out = domains.join(open_, "domain", "left").join(last, "domain", "left")
    return out.select(*domains.columns, rules.risk_class(F.col("risk_score")).alias("risk_class"), F.coalesce("open_alerts", F.lit(0)).alias("open_alerts"), F.array_join(F.transform("l", lambda x: x["ip"]), ",").alias("ips"))


def domain_page(domain: str, domains: DataFrame, alerts: DataFrame, ips: DataFrame, snapshots: DataFrame, probes: DataFrame) -> dict[str, DataFrame]:
    """What the page of one domain shows: its row, addresses, alerts, twenty snapshots, risk over time."""
    one = lambda t: t.where(F.col("domain") == domain)
    last = one(probes).agg(F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success"), F.max(F.when(~F.col("success"), F.col("ts"))).alias("last_failure"))
    return {
        "domain": one(domains).select("domain", "risk_score", rules.risk_class(F.col("risk_score")).alias("risk_class")).join(last),
        "ips": one(ips).orderBy(F.col("last_seen").desc(), "ip"),
        "alerts": one(alerts).orderBy(F.col("ts").desc(), F.col("id").desc()),
        "snapshots": newest(one(snapshots), 20),
        "risk": risk_trend(one(alerts)),
    }


def risk_trend(alerts: DataFrame, most: int = 100) -> DataFrame:
    """``domain, step, ts, score``: sums of 60, 10 or 5 an alert by its kind, up to ``most``; from 0 at the first."""
    kind = F.col("alert_type")
    delta = F.when(kind == "PREFILTER_MALICIOUS", 60).when(kind == "PREFILTER_CLASSIFIED", 10).otherwise(5)
    w = W.partitionBy("domain").orderBy("ts", "id")
    steps = alerts.select("domain", F.row_number().over(w).alias("step"), "ts", F.least(F.lit(most), F.sum(delta).over(w.rowsBetween(W.unboundedPreceding, 0))).cast("long").alias("score"))
    return steps.unionByName(alerts.groupBy("domain").agg(F.min("ts").alias("ts")).select("domain", F.lit(0).alias("step"), "ts", F.lit(0).cast("long").alias("score")))


def needing_probe(domains: DataFrame, probes: DataFrame, now: int, least: int = 60, cache_s: int = 604_800, most: int = 50) -> DataFrame:
    """The riskiest domains without a probe, failed ones too, in the last ``cache_s`` seconds; names of four labels and more go."""
    recent = probes.where(F.col("ts") > now - cache_s).select("domain").distinct()
    out = domains.where((F.col("risk_score") >= least) & ~F.col("domain").like("%.%.%.%")).join(recent, "domain", "left_anti")
    return out.orderBy(F.col("risk_score").desc(), "domain").limit(most)


def tracked(labels: DataFrame, snapshots: DataFrame, probes: DataFrame, now: int, interval_days: int = 7) -> DataFrame:
    """A row per typical domain of malicious and known classes, of the first class that has it:
    snapshots, the newest one's title, the last success, and whether that is stale."""
    names = labels.where("kind in ('malicious', 'known')").select("class_id", "name", F.posexplode("typical").alias("pos", "domain")).where("domain <> ''")
    first = names.groupBy("domain").agg(F.min_by("name", F.struct("class_id", "pos")).alias("class_name"))
    s = snapshots.groupBy("domain").agg(F.count("*").alias("snapshots"), F.max_by("title", F.struct("ts", "id")).alias("title"))
    p = probes.where("success").groupBy("domain").agg(F.max("ts").alias("last_probed"))
    out = first.join(s, "domain", "left").join(p, "domain", "left").withColumn("snapshots", F.coalesce("snapshots", F.lit(0)))
    status = rules.tracked_status(F.col("snapshots"), F.col("last_probed"), F.lit(now), interval_days)
    return out.withColumn("status", status).withColumn("status_class", rules.status_class(status))


def probe_queue(asked: DataFrame, failed: DataFrame, now: int, cooldown_s: int = 300) -> DataFrame:
    """asked: ``domain, priority, seq``; failed: ``domain, ts``. Each domain once, those with priority
    first, then as asked; domains that failed within the cooldown are left out. ``domain, priority, seq``."""
    cooling = failed.where(now - F.col("ts") < cooldown_s).select("domain").distinct()
    one = asked.groupBy("domain").agg(F.max("priority").alias("priority"), F.min("seq").alias("seq"))
    return one.join(cooling, "domain", "left_anti").orderBy(F.col("priority").desc(), "seq", "domain")
