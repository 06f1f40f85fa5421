"""Labels, classes and predicates of alerts, domains, probes and addresses: Column in, Column out.

Fixed values throughout: thresholds, labels and address ranges. Nulls give null unless stated.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, functions as F, types

SKIP_PORTS = (22, 23, 25, 53, 110, 123, 143, 389, 3478, 5353)
SEVERITY_LABELS = {1: "info", 2: "low", 3: "medium", 4: "high", 5: "critical"}
TYPE_LABELS = {"PREFILTER_MALICIOUS": "ARI: malicious", "PREFILTER_UNKNOWN": "ARI: low conf", "PREFILTER_CLASSIFIED": "ARI: classified"}
# outcome of a probe, kind of class: what is added to the risk, and the cap of the sum
OUTCOMES = {
    ("EXACT", "malicious"): (60, 100),
    ("EXACT", "known"): (60, 100),
    ("HIGH", "malicious"): (45, 100),
    ("HIGH", "known"): (45, 100),
    ("MODERATE", "malicious"): (30, 100),
    ("MODERATE", "known"): (30, 100),
    ("NoMatch", "malicious"): (20, 65),
    ("NoMatch", "known"): (5, 35),
    ("NoBaseline", "malicious"): (20, 65),
    ("NoBaseline", "known"): (8, 40),
    ("Unreachable", "malicious"): (15, 65),
    ("Unreachable", "known"): (5, 40),
}


def _cases(of: Column, table: dict, other: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(of == k, v) if out is None else out.when(of == k, v)
    return out.otherwise(other)


def severity_label(severity: Column) -> Column:
    return _cases(severity, SEVERITY_LABELS, F.lit("?"))


def type_label(alert_type: Column) -> Column:
    return _cases(alert_type, TYPE_LABELS, alert_type)


def confidence_pct(detail: Column) -> Column:
    """The whole number before the first % after the first parenthesis; null where there is none up to 255."""
    n = F.regexp_extract(detail, r"^[^(]*[(]\s*([0-9]+)\s*%", 1)
    return F.when(F.length(n).between(1, 3) & (F.try_to_number(n, F.lit("999")) <= 255), n.cast("int"))


def conf_class(pct: Column) -> Column:
    return F.when(pct >= 90, "conf-crit").when(pct >= 75, "conf-high").when(pct >= 60, "conf-med").otherwise("conf-low")


def predicted_class(detail: Column) -> Column:
    return F.when(detail.rlike(r"(?s)^→ .*? [(]"), F.regexp_extract(detail, r"(?s)^→ (.*?) [(]", 1))


def direction_guessed(detail: Column) -> Column:
    """False for a null detail."""
    return F.coalesce(detail.contains("·dir?") | detail.contains("·mid-flow"), F.lit(False))


def probe_label(detail: Column) -> Column:
    out = F.when(detail.contains("[EXACTmatch"), "EXACT").when(detail.contains("[HIGHmatch"), "HIGH").when(detail.contains("[MODERATEmatch"), "MODERATE")
    return out.when(detail.contains("[no HTML match]"), "no-match")


def probe_distance(detail: Column) -> Column:
    n = F.regexp_extract(detail, r"(?s)^.*?dist=([0-9]*)", 1)
    return F.when(F.length(n).between(1, 9), n.cast("int"))


def alert_detail(name: Column, confidence: Column, guessed: Column, note: Column) -> Column:
    """confidence from 0 to 1, shown as a percentage that is rounded half to even."""
    pct = F.bround(confidence.cast("double") * 100).cast("int").cast("string")
    return F.rtrim(F.concat(F.lit("→ "), name, F.lit(" ("), pct, F.lit("%"), F.when(guessed, " ·mid-flow").otherwise(""), F.lit(") "), F.coalesce(note, F.lit(""))))


def match_note(label: Column, distance: Column, ref: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("match dist="), distance.cast("string"), F.lit(" ref="), ref, F.lit("]"))


def decision(risk: Column, probe: int = 60, watch: int = 30) -> Column:
    return F.when(risk >= probe, "probe").when(risk >= watch, "watch").otherwise("skip")


def risk_class(risk: Column) -> Column:
    """Empty for null."""
    return F.when(risk >= 60, "risk-high").when(risk >= 30, "risk-med").when(risk.isNotNull(), "risk-low").otherwise("")


def status_badge(code: Column) -> Column:
    return F.when(code >= 400, "sev-4").otherwise("sev-1")


def tracked_status(snapshots: Column, last_probed: Column, now: Column, interval_days: int = 7) -> Column:
    stale = F.floor((now - last_probed) / 86400) >= interval_days
    return F.when(snapshots == 0, "no baseline").when(stale, "stale").otherwise("ok")


def status_class(status: Column) -> Column:
    return F.when(status.isin("no baseline", "stale"), "sev-4").otherwise("sev-1")


def cache_fresh(now: Column, ts: Column, ttl: int) -> Column:
    """Not older than ``ttl`` seconds; nothing is, where ttl is not positive."""
    return (now - ts < ttl) if ttl > 0 else F.lit(False)


def probe_stale(last_success: Column, snapshots: Column, now: Column, cache_s: int) -> Column:
    return F.when(last_success.isNotNull(), now - last_success >= cache_s).otherwise(snapshots == 0)


def baseline_due(snapshots: Column, last_success: Column, now: Column, check_stale: bool, stale_s: int) -> Column:
    """Domains without a snapshot always; others only in a stale check, if their last success is that old."""
    stale = F.coalesce(now - last_success >= stale_s, F.lit(False)) if check_stale else F.lit(False)
    return F.when(snapshots == 0, True).otherwise(stale)


def trimmed_domain(x: Column) -> Column:
    return F.regexp_replace(x, r"[.]+$", "")


def norm_domain(x: Column) -> Column:
    return F.lower(trimmed_domain(F.trim(x)))


def looks_like_domain(x: Column) -> Column:
    x = trimmed_domain(F.trim(x))
    label = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    return (F.octet_length(x) <= 253) & x.contains(".") & (F.lower(x) != "localhost") & x.rlike(rf"^{label}([.]{label})*$")


def is_infra(domain: Column, suffixes: list[str]) -> Column:
    """Equal to a suffix without its leading dots, or ending with the suffix as it stands."""
    out = F.lit(False)
    for s in suffixes:
        out |= (domain == s.lstrip(".")) | domain.endswith(s)
    return out


def last_two_labels(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def after_first_dot(name: Column) -> Column:
    """Null for a name without a dot."""
    return F.when(name.contains("."), F.regexp_extract(name, r"(?s)^[^.]*[.](.*)$", 1))


@F.pandas_udf(types.BooleanType())
def is_private(ip: pd.Series) -> pd.Series:
    """Private, loopback, link-local and multicast addresses, v4 and v6; null where it is no address."""
    nets = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/3", "::1/128", "fe80::/10", "ff00::/8", "fc00::/7")]

    def one(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None
        return any(a.version == n.version and a in n for n in nets)

    return ip.map(one).astype("boolean")


@F.pandas_udf(types.BooleanType())
def is_address(x: pd.Series) -> pd.Series:
    def one(v):
        try:
            ipaddress.ip_address(v)
        except ValueError:
            return False
        return True

    return x.map(one).astype("boolean")


def probeable(domain: Column) -> Column:
    return domain.contains(".") & ~is_address(domain)


@F.pandas_udf(types.BinaryType())
def address_key(ip: pd.Series) -> pd.Series:
    """Bytes in whose order addresses compare: family, then octets; null where it is no address."""

    def one(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None
        return bytes([a.version]) + a.packed

    return ip.map(one)


@F.pandas_udf(types.StringType())
def url_decode(s: pd.Series) -> pd.Series:
    """Lenient: + is a space, a digit that is not hexadecimal counts as 0, missing ones too."""
    digit = {c: i % 16 if i < 16 else i - 6 for i, c in enumerate(b"0123456789abcdefABCDEF")}

    def one(x: str | None):
        if x is None:
            return None
        head, *rest = x.encode().replace(b"+", b" ").split(b"%")
        # a % may be one of the two digits of the one before
        out, todo = bytearray(head), rest
        while todo:
            part = todo.pop(0)
            while len(part) < 2 and todo:
                part += b"%" + todo.pop(0)
            pair = (part + b"00")[:2]
            out.append((digit.get(pair[0], 0) << 4 | digit.get(pair[1], 0)) & 255)
            out += part[2:]
        return bytes(out).decode("utf-8", "replace")

    return s.map(one)


def confidence(sources: Column, verified: Column) -> Column:
    """0 to 100, by the names of the sources of a domain."""
    has = lambda s: F.array_contains(sources, s)
    base = F.when(has("passive-dns"), 90).when(has("ptr") & has("hackertarget"), 65).when(has("hackertarget"), 55).when(has("ptr"), 40).otherwise(25)
    score = F.least(F.lit(100), base + F.when(verified, 15).otherwise(0))
    stale = F.exists(sources, lambda s: s.endswith("-stale"))
    return F.greatest(F.lit(0), score - F.when(stale, 25).otherwise(0)).cast("int")


def base_severity(kind: Column, conf: Column) -> Column:
    """Of malicious and known classes; null for others."""
    bad = F.when(conf >= 0.90, 5).when(conf >= 0.75, 4).otherwise(3)
    known = F.when(conf >= 0.90, 3).when(conf >= 0.75, 2).otherwise(1)
    return F.when(kind == "malicious", bad).when(kind == "known", known)


def outcome_severity(outcome: Column, kind: Column, base: Column) -> Column:
    plus = base + 1
    out = F.when(outcome == "EXACT", 5).when(outcome == "HIGH", F.least(F.lit(5), plus)).when(outcome == "MODERATE", F.least(F.lit(4), plus))
    return out.when((outcome == "NoMatch") & (kind != "malicious"), F.least(F.lit(2), base)).otherwise(F.least(F.lit(3), base))


def outcome_risk(outcome: Column, kind: Column) -> Column:
    """Struct of ``delta`` and ``cap``."""
    out = None
    for (o, k), (delta, cap) in OUTCOMES.items():
        v = F.struct(F.lit(delta).alias("delta"), F.lit(cap).alias("cap"))
        hit = (outcome == o) & (kind == k)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out
