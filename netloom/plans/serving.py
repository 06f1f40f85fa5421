"""Relational statements: sinks as merged states, filters, joins, aggregates, windows, views.

name: (common table expressions it reads, statement). Every order has a total tie-break.
Pages of 200, thresholds 60 and 30, caches of one day.
"""

from __future__ import annotations

V4 = "(CAST(@part(ip, 1) AS BIGINT) * 16777216 + CAST(@part(ip, 2) AS BIGINT) * 65536 + CAST(@part(ip, 3) AS BIGINT) * 256 + CAST(@part(ip, 4) AS BIGINT))"
CLASSIFIED = """SELECT c.*, l.name, l.kind, CASE WHEN c.pct < 50 THEN 'unknown' ELSE coalesce(l.kind, 'unknown') END AS verdict FROM classified c LEFT JOIN labels_of_class l ON c.class_id = l.class_id"""

STATEMENTS: dict[str, tuple[list[str], str]] = {
    # alerts
    "alerts_recent": (["alerts"], "SELECT id, domain, severity, alert_type, ts, acknowledged FROM alerts ORDER BY ts DESC, id DESC LIMIT 10"),
    "alerts_paged": (["alerts"], "SELECT id, domain, severity, alert_type, ts FROM alerts WHERE NOT acknowledged AND severity >= 3 ORDER BY ts DESC, id DESC LIMIT 200 OFFSET 200"),
    "alerts_first_500": (["alerts"], "SELECT id, domain, severity, ts FROM alerts ORDER BY ts DESC, id DESC LIMIT 500"),
    "alert_counts": (["alerts"], "SELECT acknowledged, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN severity >= 4 THEN 1 END) AS BIGINT) AS severe FROM alerts GROUP BY acknowledged"),
    "alert_total": (["alerts"], "SELECT CAST(count(*) AS BIGINT) AS total, CAST(greatest(@div(count(*) + 199, 200), 1) AS BIGINT) AS pages FROM alerts WHERE NOT acknowledged AND severity >= 3"),
    "severity_histogram": (["alerts"], "SELECT severity, CAST(count(*) AS BIGINT) AS n FROM alerts WHERE NOT acknowledged GROUP BY severity"),
    "severity_breakdown": (["alerts"], """SELECT CAST(s.severity AS INT) AS severity, CASE s.severity WHEN 1 THEN 'info' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'critical' ELSE '?' END AS label,
        CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(@div(coalesce(n, 0) * 100, greatest(max(coalesce(n, 0)) OVER (), 1)) AS BIGINT) AS pct FROM (@series(1, 5, severity)) s
        LEFT JOIN (SELECT severity, count(*) AS n FROM alerts WHERE NOT acknowledged GROUP BY severity) a ON s.severity = a.severity"""),
    "prefilter_stats": (["alerts"], """SELECT CAST(count(CASE WHEN alert_type = 'PREFILTER_MALICIOUS' THEN 1 END) AS BIGINT) AS malicious, CAST(count(CASE WHEN alert_type = 'PREFILTER_CLASSIFIED' THEN 1 END) AS BIGINT) AS classified,
        CAST(count(CASE WHEN alert_type = 'PREFILTER_UNKNOWN' THEN 1 END) AS BIGINT) AS unknown, CAST(count(*) AS BIGINT) AS total FROM alerts"""),
    "alert_ack": (["alerts"], "SELECT id, CASE WHEN id = 7 THEN true ELSE acknowledged END AS acknowledged FROM alerts"),
    # counters and series
    "dashboard_stats": (["alerts", "domain_ips", "probe_runs"], """SELECT (SELECT CAST(count(DISTINCT domain) AS BIGINT) FROM alerts) AS domains, (SELECT CAST(count(*) AS BIGINT) FROM alerts WHERE NOT acknowledged) AS open_alerts,
        (SELECT CAST(count(DISTINCT ip) AS BIGINT) FROM domain_ips) AS ips, (SELECT CAST(count(*) AS BIGINT) FROM probe_runs) AS probes"""),
    "traffic_minutes": (["alerts", "probe_runs"], """SELECT minute, CAST(sum(alerts) AS BIGINT) AS alerts, CAST(sum(probes) AS BIGINT) AS probes, CAST(sum(domains) AS BIGINT) AS domains FROM (
        SELECT ts - ts % 60 AS minute, 1 AS alerts, 0 AS probes, 1 AS domains FROM alerts UNION ALL SELECT ts - ts % 60, 0, 1, 0 FROM probe_runs) x GROUP BY minute"""),
    "decision_counts": (["domains"], "SELECT decision, CAST(count(*) AS BIGINT) AS n FROM domains WHERE decision IN ('skip', 'watch', 'probe') GROUP BY decision"),
    "decision_totals": (["domains"], "SELECT CAST(count(CASE WHEN decision = 'skip' THEN 1 END) AS BIGINT) AS total_skip, CAST(count(CASE WHEN decision = 'watch' THEN 1 END) AS BIGINT) AS total_watch, CAST(count(CASE WHEN decision = 'probe' THEN 1 END) AS BIGINT) AS total_probe, CAST(count(*) AS BIGINT) AS total_decisions FROM domains"),
    "pipeline_status": (["probe_runs"], "SELECT CAST(count(*) AS BIGINT) AS total_probe, max(ts) AS last_probe_ts, CAST(0 AS BIGINT) AS queue_depth FROM probe_runs"),
    # risk
    "risk_trend": (["events_of_risk", "alerts"], """SELECT domain, CAST(0 AS BIGINT) AS step, min(ts) AS ts, CAST(0 AS BIGINT) AS score FROM events_of_risk GROUP BY domain UNION ALL
        SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY ts, id) AS BIGINT), ts, CAST(least(100, sum(delta) OVER (PARTITION BY domain ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) FROM events_of_risk"""),
    "risk_capped": (["risk"], "SELECT id, domain, score FROM risk"),
    # domains
    "domains_view": (["domains", "domain_ips", "alerts"], """SELECT d.domain, d.risk_score, d.decision, d.first_seen, d.last_seen, CAST(coalesce(a.n, 0) AS BIGINT) AS open_alerts, coalesce(i.ips, '') AS ips FROM domains d
        LEFT JOIN (SELECT domain, count(*) AS n FROM alerts WHERE NOT acknowledged GROUP BY domain) a ON d.domain = a.domain
        LEFT JOIN (SELECT domain, @listagg(ip, ',', r) AS ips FROM (SELECT domain, ip, row_number() OVER (PARTITION BY domain ORDER BY last_seen DESC, ip) AS r FROM domain_ips) x WHERE r <= 5 GROUP BY domain) i ON d.domain = i.domain"""),
    "domains_recent": (["domains"], "SELECT domain, risk_score, last_seen FROM domains ORDER BY last_seen DESC, domain LIMIT 10"),
    "domain_detail": (["domains", "alerts", "probe_runs"], """SELECT d.domain, d.risk_score, CAST(count(a.id) AS BIGINT) AS alerts, max(p.ok) AS last_success, max(p.bad) AS last_failure FROM domains d JOIN alerts a ON d.domain = a.domain
        LEFT JOIN (SELECT domain, max(CASE WHEN success THEN ts END) AS ok, max(CASE WHEN NOT success THEN ts END) AS bad FROM probe_runs GROUP BY domain) p ON d.domain = p.domain WHERE d.domain = 'site1.example.org' GROUP BY d.domain, d.risk_score"""),
    "ip_history": (["domain_ips"], "SELECT domain, ip, first_seen, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY last_seen DESC, ip) AS r FROM domain_ips) x WHERE r <= 20"),
    "domains_by_ip": (["domain_ips"], "SELECT ip, domain, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY last_seen DESC, domain) AS r FROM domain_ips) x WHERE r <= 20"),
    "domains_needing_probe": (["domains", "probe_runs"], """SELECT d.domain, d.risk_score FROM domains d WHERE d.risk_score >= 20 AND d.domain NOT LIKE '%.%.%.%'
        AND NOT EXISTS (SELECT 1 FROM probe_runs p WHERE p.domain = d.domain AND p.ts > (SELECT max(last_seen) FROM domains) - 86400) ORDER BY d.risk_score DESC, d.domain LIMIT 50"""),
    "last_probe": (["probe_runs"], "SELECT domain, max(CASE WHEN success THEN ts END) AS last_success, max(CASE WHEN NOT success THEN ts END) AS last_failure FROM probe_runs GROUP BY domain"),
    "probe_cache_state": (["domains", "probe_runs"], """SELECT d.domain, CASE WHEN p.ok IS NOT NULL THEN d.last_seen - p.ok >= 86400 ELSE coalesce(p.n, 0) = 0 END AS stale FROM domains d
        LEFT JOIN (SELECT domain, max(CASE WHEN success THEN ts END) AS ok, count(*) AS n FROM probe_runs GROUP BY domain) p ON d.domain = p.domain"""),
    # merged states of sinks
    "upsert_domains": (["alerts"], """SELECT coalesce(o.domain, n.domain) AS domain, coalesce(o.first_seen, n.first_seen) AS first_seen, greatest(coalesce(o.last_seen, n.last_seen), coalesce(n.last_seen, o.last_seen)) AS last_seen FROM
        (SELECT domain, min(ts) AS first_seen, max(ts) AS last_seen FROM alerts WHERE id % 2 = 0 GROUP BY domain) o FULL OUTER JOIN
        (SELECT domain, min(ts) AS first_seen, max(ts) AS last_seen FROM alerts WHERE id % 2 = 1 GROUP BY domain) n ON o.domain = n.domain"""),
    "upsert_domain_ips": (["domain_ips"], "SELECT domain, ip, first_seen, last_seen FROM domain_ips WHERE ip <> ''"),
    "cache_latest": (["lookups", "domain_ips"], "SELECT provider, ip, domain FROM (SELECT provider, ip, domain, row_number() OVER (PARTITION BY provider, ip ORDER BY domain DESC) AS r FROM lookups) x WHERE r = 1"),
    "cache_fresh": (["domain_ips"], "SELECT ip, domain, (604800 > 0 AND first_seen + 9000000 - last_seen < 604800) AS fresh FROM domain_ips"),
    "cache_clear": (["lookups", "domain_ips"], "SELECT provider, CAST(count(*) AS BIGINT) AS cleared FROM lookups WHERE provider <> 'ptr' GROUP BY provider"),
    "save_snapshots": (["snapshots"], "SELECT domain, CAST(min(id) AS BIGINT) AS domain_id, CAST(count(*) AS BIGINT) AS snapshots, max(ts) AS latest FROM snapshots GROUP BY domain"),
    "snapshots_latest": (["snapshots"], "SELECT domain, id, ts FROM (SELECT domain, id, ts, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) AS r FROM snapshots) x WHERE r <= 5"),
    "manifest_prune": (["snapshots"], "SELECT domain, id, ts, CAST(r AS INT) AS r FROM (SELECT domain, id, ts, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) AS r FROM snapshots) x WHERE r <= 3"),
    "manifest_index": (["snapshots"], "SELECT DISTINCT domain FROM snapshots ORDER BY domain"),
    # filters and predicates
    "skip_ports": (["packets"], "SELECT flow, seq, least(sport, dport) AS port FROM packets WHERE least(sport, dport) NOT IN (22, 23, 25, 53, 110, 123, 143, 389, 3478, 5353)"),
    # resolving
    "doh_verified": (["lookups", "domain_ips"], "SELECT DISTINCT ip, domain FROM lookups l WHERE provider = 'ptr' AND EXISTS (SELECT 1 FROM domain_ips i WHERE i.ip = l.ip AND i.domain = l.domain AND i.first_seen % 2 = 0)"),
    # flows and verdicts
    "flow_first_n": (["packets"], "SELECT flow, seq, len FROM (SELECT flow, seq, len, row_number() OVER (PARTITION BY flow ORDER BY seq) AS r FROM packets WHERE dir = 1) x WHERE r <= 3"),
    "ari_features": (["packets"], """SELECT f.flow, CAST(sum(CASE WHEN k = 1 THEN len ELSE 0 END) AS BIGINT) AS len_0, CAST(sum(CASE WHEN k = 2 THEN len ELSE 0 END) AS BIGINT) AS len_1, CAST(sum(CASE WHEN k = 3 THEN len ELSE 0 END) AS BIGINT) AS len_2,
        CAST(0 AS BIGINT) AS ari_0, CAST(sum(CASE WHEN j = 1 THEN v ELSE 0 END) AS BIGINT) AS ari_1, CAST(sum(CASE WHEN j = 2 THEN v ELSE 0 END) AS BIGINT) AS ari_2 FROM (
        SELECT flow, k, len, CASE WHEN diff > 0 THEN row_number() OVER (PARTITION BY flow, diff > 0 ORDER BY k) END AS j, CASE WHEN diff > 100000 THEN 0 ELSE -diff END AS v FROM (
        SELECT flow, k, len, ack - lag(ack) OVER (PARTITION BY flow ORDER BY k) AS diff FROM (SELECT flow, len, ack, row_number() OVER (PARTITION BY flow ORDER BY seq) AS k FROM packets WHERE dir = 1) p WHERE k <= 3) q) f GROUP BY f.flow"""),
    "class_labels": (["classified", "labels_of_class"], "SELECT id, coalesce(l.name, concat('class_', c.class_id)) AS name FROM classified c LEFT JOIN (SELECT * FROM labels_of_class WHERE class_id < 20) l ON c.class_id = l.class_id"),
    "verdicts": (["classified", "labels_of_class"], f"SELECT id, class_id, pct, verdict FROM ({CLASSIFIED}) x"),
    "probe_queue": (["alerts"], """SELECT domain, CAST(row_number() OVER (ORDER BY hi DESC, seq, domain) AS BIGINT) AS place FROM (SELECT domain, max(CASE WHEN severity >= 4 THEN 1 ELSE 0 END) AS hi, min(id) AS seq FROM alerts GROUP BY domain) x"""),
    "ip_events": (["lookups", "domain_ips"], "SELECT ip, CAST(1 AS BIGINT) AS ips, CAST(count(*) AS BIGINT) AS domains FROM lookups GROUP BY ip"),
    # evaluation
    "threshold_sweep": (["scores"], """SELECT t, tp, fp, fn, tn, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS acc, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS prec, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS rec FROM (
        SELECT CAST(t AS INT) AS t, CAST(sum(CASE WHEN label AND score >= t THEN weight ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT label AND score >= t THEN weight ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN label AND score < t THEN weight ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN NOT label AND score < t THEN weight ELSE 0 END) AS BIGINT) AS tn
        FROM (SELECT label, score, count(*) AS weight FROM scores GROUP BY label, score) s CROSS JOIN (@series(1, 99, t)) x GROUP BY t) y"""),
    "best_threshold": (["scores"], """SELECT t, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1 FROM (SELECT CAST(t AS INT) AS t, sum(CASE WHEN label AND score >= t THEN w ELSE 0 END) AS tp, sum(CASE WHEN NOT label AND score >= t THEN w ELSE 0 END) AS fp, sum(CASE WHEN label AND score < t THEN w ELSE 0 END) AS fn
        FROM (SELECT label, score, count(*) AS w FROM scores GROUP BY label, score) s CROSS JOIN (@series(1, 99, t)) x GROUP BY t) y WHERE 2 * tp + fp + fn > 0 ORDER BY f1 DESC, t LIMIT 1"""),
    "slugs": (["snapshots"], "SELECT DISTINCT replace(domain, '.', '_') AS slug, @day(ts) AS at FROM snapshots"),
    "url_parts": ([], "SELECT page_id, @extract(url, '^([a-z]+)://', 1) AS scheme, @extract(url, '://([^/?#]*)', 1) AS host, @extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages"),
    "endpoint_order": (["packets"], "SELECT flow, seq, least(sport, dport) AS low_port, greatest(sport, dport) AS high_port FROM packets"),
    "ip_numbers": (["domain_ips"], f"SELECT DISTINCT ip, {V4} AS number FROM domain_ips"),
    "level_totals": (["alerts"], "SELECT alert_type, severity, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY GROUPING SETS ((alert_type, severity), (alert_type), ())"),
}
