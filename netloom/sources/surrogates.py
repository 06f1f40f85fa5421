"""Relations of the monitoring domain, stated over the tables that are at hand.

Each is one common table expression, the same text for Spark and for the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .dialect import render

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CTES = {
    "alerts": """SELECT event_id AS id, concat('site', user_id, '.example.org') AS domain, CAST(event_id % 5 + 1 AS INT) AS severity,
        CASE event_type WHEN 'error' THEN 'PREFILTER_MALICIOUS' WHEN 'purchase' THEN 'PREFILTER_CLASSIFIED' ELSE upper(event_type) END AS alert_type,
        @epoch(ts) AS ts, event_id % 3 = 0 AS acknowledged, @json_int(props, k) AS conf FROM events""",
    "probe_runs": "SELECT event_id AS id, concat('site', user_id, '.example.org') AS domain, @epoch(ts) AS ts, event_type = 'click' AS success FROM events WHERE event_type IN ('click', 'view')",
    "domain_ips": """SELECT domain, concat(CASE WHEN n % 2 = 0 THEN '10.' ELSE '8.' END, @div(n, 65536), '.', @div(n, 256) % 256, '.', n % 256) AS ip, min(ts) AS first_seen, max(ts) AS last_seen, min(k) AS k FROM (
        SELECT concat('site', o_custkey, '.example.org') AS domain, @epoch(o_orderdate) AS ts, o_orderkey AS k, CASE WHEN o_orderkey % 10 < 3 THEN o_orderkey % 20 ELSE 20 + o_orderkey % 4000 END AS n FROM orders) o GROUP BY domain, n""",
    "events_of_risk": """SELECT id, domain, ts, CASE alert_type WHEN 'PREFILTER_MALICIOUS' THEN 60 WHEN 'PREFILTER_CLASSIFIED' THEN 10 ELSE 5 END AS delta,
        CASE alert_type WHEN 'PREFILTER_MALICIOUS' THEN 100 WHEN 'PREFILTER_CLASSIFIED' THEN 65 ELSE 40 END AS cap FROM alerts""",
    "risk_steps": """SELECT *, sum(delta) OVER (PARTITION BY domain ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM events_of_risk""",
    "risk": """SELECT id, domain, ts, CAST(total + least(0, min(cap - total) OVER (PARTITION BY domain ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS score,
        row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) AS back FROM risk_steps""",
    "domains": """SELECT a.domain, CAST(r.score AS INT) AS risk_score,
        CASE WHEN r.score >= 60 THEN 'probe' WHEN r.score >= 30 THEN 'watch' ELSE 'skip' END AS decision, a.first_seen, a.last_seen
        FROM (SELECT domain, min(ts) AS first_seen, max(ts) AS last_seen FROM alerts GROUP BY domain) a JOIN (SELECT * FROM risk WHERE back = 1) r ON a.domain = r.domain""",
    "labels_of_class": """SELECT n_nationkey AS class_id, lower(n_name) AS name, CASE n_regionkey WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' ELSE 'known' END AS kind,
        concat(lower(n_name), '.example.com') AS typical FROM nation""",
    "packets": """SELECT flow, seq, len, dir, CAST(sum(step) OVER (PARTITION BY flow ORDER BY seq) - (seq % 3) * 30000 AS BIGINT) AS ack, sport, dport, ts FROM (
        SELECT l_orderkey AS flow, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, CAST(l_quantity AS BIGINT) AS len,
        CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS dir, CAST(floor(l_extendedprice) AS BIGINT) % 70000 AS step, CAST(l_partkey % 60000 + 1024 AS INT) AS sport,
        CAST(CASE WHEN l_suppkey % 3 = 0 THEN 53 ELSE 443 END AS INT) AS dport, @epoch(l_shipdate) AS ts FROM lineitem) p""",
    "snapshots": """SELECT page_id AS id, @extract(url, '://([^/?#]*)', 1) AS domain, page_id % 7 * 86400 + 1700000000 AS ts, html FROM pages""",
    "lookups": """SELECT DISTINCT ip, domain, provider FROM (
        SELECT ip, domain, 'ptr' AS provider FROM domain_ips WHERE k % 3 = 0 UNION ALL
        SELECT ip, domain, 'hackertarget' FROM domain_ips WHERE k % 2 = 0 UNION ALL
        SELECT ip, domain, 'hackertarget-stale' FROM domain_ips WHERE k % 5 = 0 UNION ALL
        SELECT ip, domain, 'passive-dns' FROM domain_ips WHERE k % 7 = 0) u""",
    "answers": """SELECT concat('8.0.0.', user_id % 5) AS ip, concat('site', user_id, '.example.org') AS domain, @epoch(ts) AS ts, CAST(@json_int(props, k) * 60 AS BIGINT) AS ttl FROM events WHERE event_type <> 'error'""",
    "contacts": """SELECT event_id AS id, concat('8.0.0.', user_id % 5) AS ip, @epoch(ts) AS ts FROM events WHERE event_type = 'error'""",
    "details": """SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE concat('→ ', name, ' (', pct, '%', CASE WHEN id % 4 = 0 THEN ' ·mid-flow' WHEN id % 4 = 1 THEN ' ·dir?' ELSE '' END, ')',
        CASE id % 5 WHEN 0 THEN concat(' [EXACTmatch dist=', id % 9, ' ref=a.org]') WHEN 1 THEN ' [HIGHmatch dist=12 ref=b.org]' WHEN 2 THEN ' [MODERATEmatch dist=30 ref=c.org]' WHEN 3 THEN ' [no HTML match]' ELSE '' END) END AS detail
        FROM classified c JOIN labels_of_class l ON c.class_id = l.class_id""",
    "watch": """SELECT u.domain, u.seen, CAST(coalesce(s.n, 0) AS INT) AS snapshots, s.status, p.last_success FROM (SELECT concat('site', user_id, '.example.org') AS domain, max(@epoch(ts)) AS seen FROM events GROUP BY user_id) u
        LEFT JOIN (SELECT concat('site', user_id, '.example.org') AS domain, count(*) AS n, CAST(max(100 * (1 + event_id % 5)) AS INT) AS status FROM events WHERE event_type = 'purchase' AND user_id % 4 <> 1 GROUP BY user_id) s ON u.domain = s.domain
        LEFT JOIN (SELECT concat('site', user_id, '.example.org') AS domain, max(@epoch(ts)) AS last_success FROM events WHERE event_type = 'click' AND user_id % 3 <> 0 AND (user_id % 2 = 0 OR event_id % 1000 < 500) GROUP BY user_id) p ON u.domain = p.domain""",
    "scores": """SELECT d.doc_id, l.toxic = 1 AS label, CAST(d.doc_id * 37 % 101 AS INT) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "classified": """SELECT vec_id AS id, CAST(vec_id % 25 AS INT) AS class_id, CAST(vec_id * 13 % 101 AS INT) AS pct, CAST(vec_id % 7 AS INT) AS domains, concat('site', vec_id % 50, '.example.org') AS domain FROM embeddings""",
    "outcome_rules": """SELECT * FROM (VALUES ('EXACT', 'malicious', 60, 100), ('EXACT', 'known', 60, 100), ('HIGH', 'malicious', 45, 100), ('HIGH', 'known', 45, 100),
        ('MODERATE', 'malicious', 30, 100), ('MODERATE', 'known', 30, 100), ('NO_MATCH', 'malicious', 20, 65), ('NO_MATCH', 'known', 5, 35), ('NO_BASELINE', 'malicious', 20, 65),
        ('NO_BASELINE', 'known', 8, 40), ('UNREACHABLE', 'malicious', 15, 65), ('UNREACHABLE', 'known', 5, 40)) AS t(outcome, kind, delta, cap)""",
}
USES = {
    "events_of_risk": ["alerts"], "risk_steps": ["events_of_risk"], "risk": ["risk_steps"], "domains": ["alerts", "risk"], "lookups": ["domain_ips"], "details": ["classified", "labels_of_class"],
}


def closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*closure(USES.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


def statement(ctes: list[str], sql: str, duck: bool) -> str:
    """A statement with the relations that it reads, for one engine."""
    head = ",\n".join(f"{c} AS ({CTES[c]})" for c in closure(ctes))
    body = sql.lstrip()
    if head and (m := re.match(r"WITH (RECURSIVE )?", body)):
        return render(f"WITH {m[1] or ''}{head},\n{body[m.end():]}", duck)
    return render(f"WITH {head}\n{sql}" if head else sql, duck)


def on_files(sql: str, sf_dir: str) -> str:
    """The tables as files of a folder."""
    for t in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", sql)
    return sql


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(on_files(statement([name], f"SELECT * FROM {name}", duck=False), sf_dir))
