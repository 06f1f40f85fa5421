"""Rules, resolver, flows, alerts, sinks and reports against rows written by hand."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from netloom.functions import dom, domains, text as T
from netloom.operators import alerting, components, fingerprint, flow_table, model, page_pairs, resolve, rules, views
from netloom.sinks import reports, state
from netloom.sources import files, packets


def values(spark, schema, rows, *cols):
    return [r[0] if len(cols) == 1 else tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_labels(spark):
    d = F.col("d")
    details = ["→ a.com (92%) [EXACTmatch dist=0 ref=b.com]", "→ c2 (62% ·mid-flow) [no HTML match]", "→ c2 (55%)", None, "x (75%)", "→ a (61% ·dir?) [HIGHmatch dist=12 ref=q]", "→ a (300%) [MODERATEmatch dist=]", "→ none"]
    got = values(spark, "d string", [(x,) for x in details], rules.predicted_class(d), rules.confidence_pct(d), rules.direction_guessed(d), rules.probe_label(d), rules.probe_distance(d), rules.conf_class(rules.confidence_pct(d)))
    assert got == [
        ("a.com", 92, False, "EXACT", 0, "conf-crit"),
        ("c2", 62, True, "no-match", None, "conf-med"),
        ("c2", 55, False, None, None, "conf-low"),
        (None, None, False, None, None, "conf-low"),
        (None, 75, False, None, None, "conf-high"),
        ("a", 61, True, "HIGH", 12, "conf-med"),
        ("a", None, False, "MODERATE", None, "conf-low"),
        (None, None, False, None, None, "conf-low"),
    ]
    assert values(spark, "t string", [("PREFILTER_MALICIOUS",), ("PREFILTER_UNKNOWN",), ("PREFILTER_CLASSIFIED",), ("other",)], rules.type_label(F.col("t"))) == ["ARI: malicious", "ARI: low conf", "ARI: classified", "other"]
    assert values(spark, "s int", [(i,) for i in range(0, 7)], rules.severity_label(F.col("s"))) == ["?", "info", "low", "medium", "high", "critical", "?"]
    assert values(spark, "r int", [(60,), (59,), (30,), (29,), (None,)], rules.risk_class(F.col("r")), rules.decision(F.col("r"))) == [("risk-high", "probe"), ("risk-med", "watch"), ("risk-med", "watch"), ("risk-low", "skip"), ("", "skip")]
    assert values(spark, "c int", [(200,), (399,), (400,), (None,)], rules.status_badge(F.col("c"))) == ["sev-1", "sev-1", "sev-4", "sev-1"]
    s = rules.tracked_status(F.col("n"), F.col("p"), F.lit(10 * 86400))
    assert values(spark, "n int, p long", [(0, 5), (1, None), (1, 3 * 86400), (1, 3 * 86400 + 1)], s, rules.status_class(s)) == [("no baseline", "sev-4"), ("ok", "sev-1"), ("stale", "sev-4"), ("ok", "sev-1")]
    note = rules.match_note(F.lit("EXACT"), F.lit(3), F.lit("b.com"))
    assert values(spark, "c double, g boolean", [(0.625, False), (0.635, True)], rules.alert_detail(F.lit("a"), F.col("c"), F.col("g"), F.when(F.col("g"), note))) == ["→ a (62%)", "→ a (64% ·mid-flow) [EXACTmatch dist=3 ref=b.com]"]


def test_addresses_and_names(spark):
    ips = ["10.0.0.1", "192.168.1.1", "172.16.5.5", "172.32.0.1", "127.0.0.1", "169.254.1.1", "224.0.0.1", "255.1.1.1", "::1", "fe80::1", "fc00::1", "ff02::1", "8.8.8.8", "1.1.1.1", "2001:4860:4860::8888", "x", None]
    want = [True, True, True, False, True, True, True, True, True, True, True, True, False, False, False, None, None]
    assert values(spark, "ip string", [(x,) for x in ips], rules.is_private(F.col("ip"))) == want
    nets = flow_table.networks(["100.64.0.0/10", "8.8.8.8", "1.2.3.0/33", "bad", "2001:db8::1", "::/64"])
    assert len(nets) == 3
    assert values(spark, "ip string", [(x,) for x in ["100.64.0.1", "100.127.255.255", "100.128.0.0", "1.1.1.1", "8.8.8.8", "8.8.8.9", "2001:db8::1"]], flow_table.in_networks(F.col("ip"), nets)) == [True, True, False, False, True, False, True]
    names = ["a.org", "A.org..", "localhost", "-a.org", "a-.org", "a_b.org", "a..org", "nodot", "x" * 64 + ".org", ".".join(["x" * 63] * 4), "", None]
    want = [True, True, False, False, False, False, False, False, False, False, False]
    assert values(spark, "x string", [(x,) for x in names], rules.looks_like_domain(F.col("x"))) == [*want, None]
    assert [domains.looks_like(x) for x in names[:-1]] == want and domains.norm(" A.Org.. ") == "a.org"
    assert values(spark, "x string", [(" A.Org.. ",)], rules.norm_domain(F.col("x"))) == ["a.org"]
    assert values(spark, "x string", [("cdn.net",), ("a.cdn.net",), ("acdn.net",), ("b.org",)], rules.is_infra(F.col("x"), [".cdn.net"])) == [True, True, False, False]
    assert values(spark, "x string", [("a.b.c.org",), ("org",)], rules.last_two_labels(F.col("x")), rules.after_first_dot(F.col("x"))) == [("c.org", "b.c.org"), ("org", None)]
    assert values(spark, "x string", [("a.org",), ("1.2.3.4",), ("::1",), ("nodot",)], rules.probeable(F.col("x"))) == [True, False, False, False]
    assert values(spark, "x string", [("a%20b+c",), ("%4",), ("%",), ("%zz1",), ("%%41",), ("%e2%82%ac",), ("%ff",), (None,)], rules.url_decode(F.col("x"))) == ["a b c", "@", "\0", "\x001", "\x041", "€", "�", None]
    due = lambda stale: values(spark, "n int, p long", [(0, None), (1, None), (1, 10), (1, 95)], rules.baseline_due(F.col("n"), F.col("p"), F.lit(100), stale, 10))
    assert due(True) == [True, False, True, False] and due(False) == [True, False, False, False]


def test_confidence(spark):
    sources = [["passive-dns"], ["hackertarget", "ptr"], ["hackertarget"], ["ptr"], ["hackertarget-stale"], ["hackertarget-stale", "ptr"], ["x"]]
    got = values(spark, "s array<string>", [(x,) for x in sources], rules.confidence(F.col("s"), F.lit(False)), rules.confidence(F.col("s"), F.lit(True)))
    assert got == [(90, 100), (65, 80), (55, 70), (40, 55), (0, 15), (15, 30), (25, 40)]


def test_outcomes(spark):
    o, k, c = F.col("o"), F.col("k"), F.col("c")
    base = rules.base_severity(k, c)
    rows = [("EXACT", "known", 0.1), ("HIGH", "malicious", 0.95), ("HIGH", "known", 0.75), ("MODERATE", "malicious", 0.9), ("NoMatch", "malicious", 0.9), ("NoMatch", "known", 0.9), ("NoBaseline", "known", 0.9), ("NoBaseline", "malicious", 0.8), ("Unreachable", "malicious", 0.1), ("Unreachable", "known", 0.1)]
    got = values(spark, "o string, k string, c double", rows, base, rules.outcome_severity(o, k, base), rules.outcome_risk(o, k)["delta"], rules.outcome_risk(o, k)["cap"])
    assert got == [(1, 5, 60, 100), (5, 5, 45, 100), (2, 3, 45, 100), (5, 4, 30, 100), (5, 3, 20, 65), (3, 2, 5, 35), (3, 3, 8, 40), (4, 3, 20, 65), (3, 3, 15, 65), (1, 1, 5, 40)]


def bigrams_of(spark, html):
    return set(values(spark, "h string", [(html,)], T.tag_bigrams(F.col("h")))[0])


def test_page_facts(spark):
    assert {"form>input", "form>button"} <= bigrams_of(spark, "<html><body><form><input/><button>ok</button></form></body></html>")
    assert {"nav>ul", "ul>li", "main>article", "article>h1"} <= bigrams_of(spark, "<html><body><nav><ul><li>A</li></ul></nav><main><article><h1>Title</h1></article></main></body></html>")
    void = bigrams_of(spark, "<html><body><main><img src='x'><p>Caption</p><hr><section>More</section></main></body></html>")
    assert {"main>img", "main>p", "main>hr", "main>section"} <= void and not void & {"img>p", "hr>section"}
    assert bigrams_of(spark, "<label><tfoot><div / ><p>x</label><br><video><a>") == {"_root>label", "label>tfoot", "tfoot>div", "tfoot>p", "_root>br"}
    css = values(spark, "h string", [("<p>literal class=\"noise\"</p><div class = 'real one'>hi</div>",)], T.css_classes(F.col("h")))[0]
    assert css == ["one", "real"]

    def pair(a, b):
        rows = [(1, "http://s.org/1", a), (2, "http://s.org/2", b)]
        return fingerprint.compared(fingerprint.fingerprints(spark.createDataFrame(rows, "page_id long, url string, html string"))).first()

    sparse = pair("<html><body><div><div><p>welcome</p></div></div></body></html>", "<html><body><span>welcome</span></body></html>")
    assert sparse["distance"] == 0 and sparse["kind"] not in ("identical", "high")
    assert pair(*["<p>same content same content same content</p>"] * 2)["label"] == "EXACT"
    same = pair("<html><body><nav><ul><li>Home</li><li>About</li></ul></nav><main><article><h1>Acme</h1><p>We build things for you</p></article></main><footer><p>Copyright Acme</p></footer></body></html>", "<html><body><nav><ul><li>Home</li><li>Contact</li></ul></nav><main><article><h1>Acme</h1><p>We make stuff for clients</p></article></main><footer><p>Copyright Acme 2025</p></footer></body></html>")
    other = pair("<html><body><table><thead><tr><th>Col</th></tr></thead><tbody><tr><td>Data</td></tr></tbody></table></body></html>", "<html><body><form><label>Name</label><input/><select><option>A</option></select><button>Submit</button></form></body></html>")
    assert same["shape"] >= 0.5 > other["shape"]
    titles = [("Acme Corp Home", "Acme Corp Homepage"), ("Buy Flights", "Quantum Physics Journal"), ("링크킹 - 무료 애니메이션 스트리밍", "링크킹 TV - 애니메이션"), ("", " "), ("a", None)]
    sim = values(spark, "a string, b string", titles, T.title_similarity(F.col("a"), F.col("b")))
    assert sim[0] >= 0.7 and sim[1] < 0.4 and 0 < sim[2] <= 1 and sim[3:] == [1.0, 0.0]


def test_generic_pages(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rich = f"<html><body><div class='a b'><main><section><p>{words}</p></section><ul><li>x</li></ul><table><tr><td>1</td></tr></table></main></div></body></html>" + " " * 500
    cases = [("<p>tiny</p>", True), ("<html><head><title>403 Forbidden</title></head><body><p>no</p>" + " " * 600 + "</body></html>", True), (f"<p>{words}</p>" + " " * 400, False), ("<p>few words only here</p>" + " " * 200, True), (rich, False), (rich.replace("<html>", "<title>Just a moment...</title>").replace(words, "few"), True), (rich.replace("<html>", "<title>Coming soon</title>").replace(words, "few"), False)]
    f = fingerprint.fingerprints(spark.createDataFrame([(i, "http://a.org/", h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string"))
    got = f.orderBy("page_id").select(T.is_generic(F.col("html"), F.col("bigrams"), F.col("words"), F.col("css"), F.col("title"), F.col("h1"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_site_blocks_give_each_pair_once(spark):
    rows = [(i, "a" if i < 150 else f"s{i % 7}") for i in range(200)]
    got = fingerprint.site_blocks(spark.createDataFrame(rows, "page_id long, domain string"), block=16).select("a.page_id", "b.page_id").collect()
    want = [(i, j) for i, x in rows for j, y in rows if i < j and x == y]
    assert sorted(tuple(r) for r in got) == want


def test_baselines(spark):
    page = lambda tag, n: f"<html><body><{tag}><h1>t</h1><p>" + " ".join(f"w{n}{i}" for i in range(30)) + f"</p></{tag}></body></html>"
    one = lambda rows, cols: fingerprint.fingerprints(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn(cols[0], F.col("page_id")) if cols else None
    probed = one([(1, "http://p.org/", page("main", 1)), (2, "http://q.org/", page("form", 2)), (3, "http://none.org/", page("main", 3)), (4, "http://r1.org/", page("main", 1))], ["key"]).drop("page_id")
    base = one([(10, "http://r1.org/", page("table", 9)), (11, "http://r1.org/", page("main", 1)), (12, "http://r2.org/", page("form", 2))], ["id"]).drop("page_id").withColumn("ts", F.col("id"))
    refs = spark.createDataFrame([(1, 0, "empty.org"), (1, 1, "r1.org"), (2, 0, "r1.org"), (2, 1, "r2.org"), (3, 0, "empty.org"), (4, 0, "r2.org"), (4, 1, "r1.org"), (5, 0, "r1.org")], "key long, pos int, ref string")
    got = {r["key"]: tuple(r)[1:] for r in fingerprint.against_baselines(probed, refs, base).collect()}
    assert got == {1: ("Match", "EXACT", 0, "r1.org"), 2: ("NoMatch", None, None, None), 3: ("NoBaseline", None, None, None), 4: ("NoMatch", None, None, None)}
    got = {r["key"]: tuple(r)[1:] for r in fingerprint.against_baselines(probed, refs, base, include_self=True).collect()}
    assert got[4] == ("Match", "EXACT", 0, "r1.org") and got[2][0] == "NoMatch"


PACKET = "src string, dst string, sport int, dport int, ack long, flags int, payload_len int, ts double, seq long"


def made_packets():
    c, s = ("10.0.0.1", 5000), ("8.8.8.8", 443)
    rows = []

    def add(src, dst, flags, n, ts, ack=0):
        rows.append((src[0], dst[0], src[1], dst[1], ack, flags, n, ts, len(rows)))

    add(c, s, 0x02, 0, 1.0)
    add(s, c, 0x12, 0, 1.1)
    for i, n in enumerate([1400, 800, 600]):
        add(s, c, 0x10, n, 1.2 + i / 10, 100 * i)
    add(s, c, 0x10, 5, 1.9)  # after the flow of four has ended: a guess
    m = ("1.1.1.1", 9000)
    add(m, ("9.9.9.9", 8000), 0x10, 7, 2.0)
    add(("9.9.9.9", 8000), m, 0x10, 9, 31.9)  # 29.9 s later: the same flow
    add(m, ("9.9.9.9", 8000), 0x10, 11, 61.9)  # 30 s: a new one
    add(("7.7.7.7", 22), c, 0x10, 1, 3.0)  # a port to skip
    add(("100.64.0.1", 443), c, 0x10, 1, 3.0)  # a network to skip
    add(("fe80::2", 700), ("fe80::10", 700), 0x12, 3, 4.0)
    return rows


WANT = [
    ("8.8.8.8", False, [0, 1400, 800, 600], [1, 1, 1, 1], False),
    ("8.8.8.8", True, [5], [1], True),
    ("9.9.9.9", True, [7, 9], [0, 1], True),
    ("9.9.9.9", True, [11], [0], True),
    ("fe80::2", False, [3], [1], True),
]


def flow_rows(rows):
    out = []
    for r in rows:
        first = 1 if not r["guessed"] and r["server_ip"] == "8.8.8.8" else 0
        out.append((r["server_ip"], r["guessed"], list(r["lens"])[first:], list(r["dirs"])[first:], r["aged"]))
    return sorted(out)


def test_flow_table(spark):
    kept = flow_table.kept(spark.createDataFrame(made_packets(), PACKET).repartition(3), skip_nets=flow_table.networks(["100.64.0.0/10"]))
    assert flow_rows(flow_table.flows(kept, dim=4).collect()) == sorted(WANT)


def test_flows_told_apart(spark):
    """Two captures hold packets of the same endpoints at the same times: each has flows of its own."""
    both = spark.createDataFrame([(*r, k) for k in ("x", None) for r in made_packets()], PACKET + ", capture string").repartition(3)
    kept = flow_table.kept(both, skip_nets=flow_table.networks(["100.64.0.0/10"]))
    assert flow_rows(flow_table.flows(kept, dim=4, apart=["capture"]).collect()) == sorted(WANT * 2)


def test_flow_stream_equals_table(spark, tmp_path):
    kept = flow_table.kept(spark.createDataFrame(made_packets(), PACKET), skip_nets=flow_table.networks(["100.64.0.0/10"])).withColumn("at", F.timestamp_seconds("ts"))
    kept = kept.where("ts < 1000")
    end = kept.limit(1).withColumn("flow", F.lit("z 1 z 2")).withColumn("ts", F.lit(500.0)).withColumn("at", F.timestamp_seconds("ts"))
    kept.coalesce(1).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flow_table.flow_stream(spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), dim=4)
    q = stream.writeStream.format("memory").queryName("flowing").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(180)
    got = [r for r in spark.table("flowing").collect() if not r["flow"].startswith("z")]
    assert flow_rows(got) == sorted(WANT)


def test_flow_features(spark):
    cases = [([100, 200], [10, 50], [1, 1], 4, [100, 200, 0, 0, 0, -40, 0, 0]), ([], [], [], 2, [0, 0, 0, 0]), ([1, 1, 1], [100, 100, 200], [1, 1, 1], 4, [1, 1, 1, 0, 0, -100, 0, 0]), ([1, 1, 1], [0, 200000, 200050], [1, 1, 1], 4, [1, 1, 1, 0, 0, 0, -50, 0]), ([1, 2, 3, 4], [1, 2, 3, 4], [1] * 4, 3, [1, 2, 3, 0, -1, -1]), ([9, 1, 9, 2], [5, 10, 6, 30], [0, 1, 0, 1], 2, [1, 2, 0, -20]), ([9], [9], [0], 2, [0] * 4)]
    for lens, acks, dirs, dim, want in cases:
        df = spark.createDataFrame([(lens, acks, dirs)], "lens array<long>, acks array<long>, dirs array<int>")
        assert flow_table.features(df, dim).first()["features"] == want


def test_packets_as_captured():
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 1440, 0, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([8, 8, 8, 8]))
    tcp = lambda off: struct.pack(">HHIIBBHHH", 1, 443, 1, 16, off << 4, 0x18, 0, 0, 0)
    eth = bytes(12) + b"\x08\x00"
    assert packets.tcp_packet(eth + head + tcp(5) + bytes(42))["payload_len"] == 42  # cut by the capture
    assert packets.tcp_packet(eth + head + tcp(15))["payload_len"] == 0  # a header beyond it
    assert packets.tcp_packet(eth + head + tcp(4)) is None
    assert packets.address_pair(eth + head) == ["10.0.0.1", "8.8.8.8"] and packets.address_pair(b"x") == packets.address_pair(None) == []
    v6 = bytes(12) + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, 20, 6, 1) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + tcp(5)
    assert packets.tcp_packet(v6)["src"] == "::1" and packets.address_pair(v6) == ["::1", "::2"]
    msg = struct.pack(">HHHHHH", 1, 0x8180, 0, 1, 0, 0) + b"\x01a\x03org\x00" + struct.pack(">HHIH", 1, 1, 300, 4) + bytes([1, 2, 3, 4])
    udp = lambda s, d: eth + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28 + len(msg), 0, 0, 64, 17, 0, bytes(4), bytes(4)) + struct.pack(">HHHH", s, d, 8 + len(msg), 0) + msg
    assert packets.dns_of_frame(udp(53, 9)) == packets.dns_of_frame(udp(9, 53)) == [("1.2.3.4", "a.org", 300)] and packets.dns_of_frame(udp(9, 9)) == []


def test_model_fallbacks():
    import json

    stump = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [1.5, 0, 0], "default_left": [1, 0, 0], "base_weights": [0, -2, 3]}

    def made(param, **more):
        return model.load(json.dumps({"learner": {"learner_model_param": param, "gradient_booster": {"model": {"trees": [stump], **more}}}}))

    assert made({})["base"].tolist() == [0] and made({})["features"] == 0 and made({})["class_of"] == [0]
    assert made({"base_score": "[1,2,3]", "num_class": "2"}, tree_info=[1])["base"].tolist() == [0, 0]
    assert made({"base_score": "[1, 2]", "num_class": "2"}, tree_info=[1])["base"].tolist() == [1, 2]
    assert made({"base_score": "0.5", "num_class": 2}, tree_info=[1])["base"].tolist() == [0.5, 0.5]
    assert made({"base_score": "x"})["base"].tolist() == [0]
    with pytest.raises(ValueError):
        made({"num_class": "2"})
    with pytest.raises(ValueError):
        made({}, tree_info=[0, 0])
    m = made({"num_class": "2", "num_feature": "20"}, tree_info=[1])
    model.check(m, 10, 2)
    for dim, labels in ((9, 2), (10, 3)):
        with pytest.raises(ValueError):
            model.check(m, dim, labels)


def test_resolver(spark):
    now, ttl = 1000, 100
    cache = spark.createDataFrame([("ptr", "1.1.1.1", 950, 200, b'{"domains": ["a.org", "b.org"]}'), ("ptr", "2.2.2.2", 900, 200, b'{"domains": ["old.org"]}'), ("hackertarget", "1.1.1.1", 990, 200, b"b.org\nnot a name\nC.org"), ("hackertarget", "2.2.2.2", 10, 200, b"x.org"), ("hackertarget", "3.3.3.3", 10, 200, b"y.org")], state.CACHE)
    answers = spark.createDataFrame([("1.1.1.1", "ignored.org"), ("2.2.2.2", "error: API count exceeded"), ("3.3.3.3", "z.org,1.2.3.4\nZ.org.\n"), ("4.4.4.4", "Quota used up")], "ip string, body string")
    ptr = resolve.ptr_domains(cache, now, ttl)
    found, notes, put = resolve.reverse_domains(cache, answers, now, ttl)
    assert sorted(tuple(r) for r in ptr.collect()) == [("1.1.1.1", "a.org", "ptr"), ("1.1.1.1", "b.org", "ptr")]
    assert sorted(tuple(r) for r in found.collect()) == [("1.1.1.1", "b.org", "hackertarget"), ("1.1.1.1", "c.org", "hackertarget"), ("2.2.2.2", "x.org", "hackertarget-stale"), ("3.3.3.3", "z.org", "hackertarget")]
    assert sorted(tuple(r) for r in notes.collect()) == [("2.2.2.2", "hackertarget-stale: error: API count exceeded (stale cache)"), ("4.4.4.4", "hackertarget: Quota used up")]
    assert [(r["key"], bytes(r["body"])) for r in put.collect()] == [("3.3.3.3", b"z.org")]
    every = ptr.unionByName(found)
    got = [tuple(r) for r in resolve.ranked(every).orderBy("ip", "rank").collect()]
    assert got == [("1.1.1.1", 1, "b.org", ["hackertarget", "ptr"], 65), ("1.1.1.1", 2, "c.org", ["hackertarget"], 55), ("1.1.1.1", 3, "a.org", ["ptr"], 40), ("2.2.2.2", 1, "x.org", ["hackertarget-stale"], 0), ("3.3.3.3", 1, "z.org", ["hackertarget"], 55)]
    forward = spark.createDataFrame([("1.1.1.1", "a.org")], "ip string, domain string")
    assert [tuple(r)[2:] for r in resolve.ranked(every, forward, ["ptr"]).collect()] == [("a.org", ["ptr"], 55)]
    known = spark.createDataFrame([("1.1.1.1", 1, "d.org"), ("1.1.1.1", 2, "a.org"), ("9.9.9.9", 1, "k.org")], "ip string, pos int, domain string")
    page = {r["ip"]: [(d["domain"], d["sources"]) for d in r["domains"]] for r in resolve.probe_page(resolve.ranked(every), known).collect()}
    assert page["1.1.1.1"][2:] == [("a.org", ["ptr"]), ("d.org", ["dns-cache"])] and page["9.9.9.9"] == [("k.org", ["dns-cache"])]
    text = '{"a": ["x.org", {"b": "Y.ORG."}], "c": 5, "d": "no", "e": null}'
    assert values(spark, "x string", [(text,), ("nonsense",)], resolve.json_domains(F.col("x"))) == [["x.org", "y.org"], None]
    assert '"count":3' in {r["ip"]: r["value"] for r in reports.lookup_json(resolve.ranked(every)).collect()}["1.1.1.1"]
    assert reports.lookup_tsv(resolve.ranked(every)).where("ip = '2.2.2.2'").first()["value"] == "2.2.2.2\tx.org\t0\thackertarget-stale"


def test_passive_dns(spark):
    answers = spark.createDataFrame([("1.2.3.4", "b.org", 100, 5), ("1.2.3.4", "a.org", 110, 100_000), ("1.2.3.4", "c.org", 3800, 60)], "ip string, domain string, ts long, ttl long")
    flows = spark.createDataFrame([(i, ip, t) for i, (ip, t) in enumerate([("1.2.3.4", 99), ("1.2.3.4", 100), ("1.2.3.4", 129), ("1.2.3.4", 130), ("1.2.3.4", 3709), ("1.2.3.4", 3710), ("1.2.3.4", 3859), ("9.9.9.9", 120)])], "id long, ip string, ts long")
    assert {r["id"]: r["domain"] for r in resolve.passive_first(flows, answers).collect()} == {1: "b.org", 2: "b.org", 3: "a.org", 4: "a.org", 6: "c.org"}


def test_passive_dns_of_a_busy_address(spark):
    """Rows of an address and hour are put in order, not paired; against all pairs."""
    draw = random.Random(5)
    answers = [(f"8.0.0.{draw.randrange(2)}", f"d{draw.randrange(9)}.org", draw.randrange(20_000), draw.choice([0, 29, 60, 600, 3600, 9999])) for _ in range(300)]
    flows = [(i, draw.choice(["8.0.0.0", "8.0.0.1", None]), draw.choice([None, *range(0, 24_000, 7)])) for i in range(300)]
    out = resolve.passive_first(spark.createDataFrame(flows, "id long, ip string, ts long"), spark.createDataFrame([*answers, (None, "n.org", 5, 3600)], "ip string, domain string, ts long, ttl long"))
    want = {}
    for i, ip, t in flows:
        hits = [(a, d) for p, d, a, ttl in answers if p == ip and t is not None and a <= t < a + min(max(ttl, 30), 3600)]
        if hits:
            want[i] = min(hits)[1]
    assert {r["id"]: r["domain"] for r in out.collect()} == want and len(want) > 100
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_alerts(spark):
    labels = files.labels(spark, '[[classes]]\nname = "bad.com"\nkind = "malicious"\ntypical_domains = ["x.bad.com"]\n[[classes]]\nname = "fine"\nkind = "benign"\n[[classes]]\nname = "shop.net"\n')
    rows = [(1, "8.8.8.8", 0, 0.95, False), (2, "8.8.4.4", 2, 0.8, True), (3, "8.8.8.8", 1, 0.9, False), (4, "104.21.8.244", 1, 0.6, False), (5, "10.0.0.1", 0, 0.9, False), (6, "7.7.7.7", 0, 0.4, False), (7, "5.5.5.5", 0, 0.7, False), (8, "8.8.8.8", 9, 0.9, False)]
    classified = spark.createDataFrame(rows, "id long, ip string, class_id int, confidence double, guessed boolean")
    v = alerting.verdicts(classified, labels)
    assert {r["id"]: r["verdict"] for r in v.collect()} == {1: "malicious", 2: "known", 3: "benign", 4: "benign", 5: "malicious", 6: "unknown", 7: "malicious", 8: "unknown"}
    w = alerting.watched(v, spark.createDataFrame(alerting.SEEDS, "ip string, site string"))
    assert {r["id"]: (r["verdict"], r["class_name"], r["confidence"], r["watch_only"]) for r in w.collect()} == {1: ("malicious", "bad.com", 0.95, False), 2: ("known", "shop.net", 0.8, False), 4: ("malicious", "ohli365.org", 0.9, True), 7: ("malicious", "bad.com", 0.7, False)}
    live = spark.createDataFrame([("8.8.8.8", i, d) for i, d in enumerate(["first.org", "cdn.net", "www.bad.com", "n.bad.com", "y.org"])] + [("8.8.4.4", 0, "cdn.net"), ("8.8.4.4", 1, "one.org"), ("104.21.8.244", 0, "ohli365.org")], "ip string, pos int, domain string")
    known = spark.createDataFrame([("8.8.8.8", 0, "y.org"), ("8.8.8.8", 1, "six.org"), ("8.8.4.4", 0, "two.org")], "ip string, pos int, domain string")
    passive = spark.createDataFrame([(2, "unused.org")], "id long, domain string")
    named, queue = alerting.candidates(w, live, known, passive, [".cdn.net"])
    assert sorted(tuple(r)[::2] for r in named.collect()) == [(1, "www.bad.com"), (2, "one.org"), (2, "two.org"), (4, "ohli365.org"), (7, "5.5.5.5")]
    assert sorted(tuple(r) for r in queue.collect()) == [(1, "cdn.net", False), (1, "first.org", False), (1, "n.bad.com", True), (1, "six.org", False), (1, "www.bad.com", True), (1, "y.org", False)]
    hit, _ = alerting.candidates(w, live, known, spark.createDataFrame([(1, "seen.org")], "id long, domain string"), [])
    assert [r["domain"] for r in hit.where("id = 1").collect()] == ["seen.org"]
    outcomes = spark.createDataFrame([(1, "www.bad.com", "Match", "HIGH", 2, "bad.com"), (2, "one.org", "NoMatch", None, None, None), (2, "two.org", "Unreachable", None, None, None), (4, "ohli365.org", "NoMatch", None, None, None)], "id long, domain string, verdict string, label string, distance int, ref string")
    a = alerting.alerts(w, named, outcomes)
    assert sorted(tuple(r) for r in a.collect()) == [
        (1, "www.bad.com", 5, "PREFILTER_MALICIOUS", "→ bad.com (95%) [HIGHmatch dist=2 ref=bad.com]", 45, 100, "HIGH"),
        (2, "one.org", 2, "PREFILTER_CLASSIFIED", "→ shop.net (80% ·mid-flow) [no HTML match]", 5, 35, "NoMatch"),
        (2, "two.org", 2, "PREFILTER_CLASSIFIED", "→ shop.net (80% ·mid-flow)", 5, 40, "Unreachable"),
        (7, "5.5.5.5", 3, "PREFILTER_MALICIOUS", "→ bad.com (70%)", 20, 65, "NoBaseline"),
    ]
    probes = alerting.to_probe(queue, a, alerting.references(w)).orderBy("place").collect()
    assert [r["domain"] for r in probes] == ["n.bad.com", "www.bad.com", "cdn.net", "first.org", "six.org", "y.org", "two.org", "5.5.5.5", "bad.com", "x.bad.com"]
    steps = spark.createDataFrame([("nodot", None, False, "x", False), ("1.2.3.4", None, False, "x", False), ("a.org", 950, True, None, False), ("b.org", 950, False, "x", False), ("c.org", 100, True, None, False), ("d.org", None, False, "x", True), ("e.org", 100, True, "x", False)], "domain string, last_success long, has_print boolean, fetched string, generic boolean")
    assert [r["step"] for r in alerting.probe_step(steps, 1000, 100).collect()] == ["NoBaseline", "NoBaseline", "Compare", "Unreachable", "Unreachable", "NoBaseline", "Compare"]


def test_alert_numbers_stay_with_their_order(spark):
    """The ranges that rows are dealt to come from a sample that differs from run to run."""
    at = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    new = spark.range(0, 60_000, 1, 6).select(F.lit("a.org").alias("domain"), F.lit(1).alias("severity"), F.lit("T").alias("alert_type"), F.lit(None).cast("string").alias("detail"), at.alias("ts"))
    old = spark.createDataFrame([(1000, "old.org", 1, "T", None, 0, True)], state.ALERTS)
    joined = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges are one range else
    spark.conf.set(joined, False)
    try:
        rows = state.append_alerts(old, new).where("id > 1000").select("id", "ts").collect()
    finally:
        spark.conf.unset(joined)
    assert [r["id"] for r in sorted(rows)] == list(range(1001, 61_001))
    assert [r["ts"] for r in sorted(rows)] == sorted(r[0] for r in new.select("ts").collect())


def most_rows(plan) -> int:
    """The rows of the largest step of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return most_rows(plan.plan())
    rows, below = plan.metrics().get("numOutputRows"), plan.children()
    return max([rows.get().value() if rows.isDefined() else 0] + [most_rows(below.apply(i)) for i in range(below.size())])


def test_candidates_read_a_crowded_list_once(spark):
    names = ["a.bad.com", "x.y.bad.com", "notbad.com", "bad.com.org", "shop", "n.shop", "cdn.net"]
    live = [("8.8.8.8", i, f"d{i}.org" if i >= len(names) else names[-1 - i]) for i in range(200)]
    flows = [(i, "8.8.8.8", [None, "bad.com", "www.bad.com", "shop", "none.org", "d9.org"][i % 6], ["t.org"]) for i in range(300)]
    f = spark.createDataFrame(flows, "id long, ip string, class_name string, typical array<string>")
    named, queue = alerting.candidates(f, spark.createDataFrame(live, "ip string, pos int, domain string"), spark.createDataFrame([], "ip string, pos int, domain string"), spark.createDataFrame([], "id long, domain string"), [])
    want = [["cdn.net", "x.y.bad.com", "x.y.bad.com", "n.shop", "cdn.net", "d9.org"][i % 6] for i in range(300)]
    assert [r["domain"] for r in sorted(named.collect())] == want
    assert most_rows(named._jdf.queryExecution().executedPlan()) < 3000  # 60,000 pairs of a flow and a name
    assert queue.count() == 60_000


def test_written_states(spark, tmp_path):
    s = state.State(spark, str(tmp_path / "domains"), state.DOMAINS)
    seen = spark.createDataFrame([("a.org", 10), ("a.org", 30), ("b.org", 20)], "domain string, ts long")
    for _ in range(2):  # the second time changes nothing
        s.merge("one", lambda old: state.upsert_seen(old, seen, ["domain"]))
    assert not s.merge("one", lambda old: old)
    s.merge("two", lambda old: state.upsert_seen(old, spark.createDataFrame([("a.org", 5), ("c.org", 7)], "domain string, ts long"), ["domain"]))
    steps = spark.createDataFrame([("a.org", 60, 100, 1, 1), ("a.org", 45, 100, 2, 2), ("a.org", 5, 65, 3, 3), ("b.org", 20, 65, 1, 4), ("z.org", 1, 1, 1, 5)], "domain string, delta int, cap int, ts long, id long")
    for name in ("three", "three"):
        s.merge(name, lambda old: state.raise_risk(old, steps))
    assert sorted(tuple(r) for r in s.read().collect()) == [("a.org", 65, "probe", 5, 30), ("b.org", 20, "skip", 20, 20), ("c.org", None, None, 7, 7)]
    b = state.State(spark, str(tmp_path / "buckets"), state.BUCKETS)
    for name, row in (("x", (61, 2)), ("x", (61, 2)), ("y", (119, 3)), ("z", (120, 4))):
        b.merge(name, lambda old, row=row: state.add_to_buckets(old, spark.createDataFrame([row], "ts long, alerts int")))
    assert sorted(tuple(r) for r in b.read().collect()) == [(60, 0, 5, 0, 0), (120, 0, 4, 0, 0)]
    a = state.State(spark, str(tmp_path / "alerts"), state.ALERTS)
    new = spark.createDataFrame([("a.org", i % 5, "T", None, 100 - i) for i in range(40)], "domain string, severity int, alert_type string, detail string, ts long")
    a.merge("x", lambda old: state.append_alerts(old, new))
    a.merge("y", lambda old: state.append_alerts(old, new.limit(1)))
    a.merge("z", lambda old: state.acknowledge(old, [3]))
    rows = sorted(tuple(r) for r in a.read().collect())
    assert [r[0] for r in rows] == list(range(1, 42)) and [r[5] for r in rows[:40]] == sorted(100 - i for i in range(40)) and [r[0] for r in rows if r[6]] == [3]
    c = spark.createDataFrame([("ptr", "k", 1, 200, b"a"), ("ptr", "l", 1, 200, b"b")], state.CACHE)
    put = state.put_cache(c, spark.createDataFrame([("ptr", "k", 1, 200, b"c"), ("ht", "k", 2, 200, None)], state.CACHE))
    assert sorted((r["provider"], r["key"], r["body"] and bytes(r["body"])) for r in put.collect()) == [("ht", "k", None), ("ptr", "k", b"c"), ("ptr", "l", b"b")]
    assert [r["key"] for r in state.clear_cache(put, "k").collect()] == ["l"] and state.clear_cache(put).count() == 0
    ips = spark.createDataFrame([("a.org", "1.1.1.1", 1, 2)], state.DOMAIN_IPS)
    old = spark.createDataFrame([("a.org", "1.1.1.1", 0, 9), ("a.org", "2.2.2.2", 3, 4), ("q.org", "3.3.3.3", 3, 4)], state.DOMAIN_IPS)
    assert sorted(tuple(r) for r in state.migrate_ips(ips, old, s.read()).collect()) == [("a.org", "1.1.1.1", 1, 2), ("a.org", "2.2.2.2", 3, 4)]
    assert state.upsert_domain_ips(ips, spark.createDataFrame([("a.org", "", 1), ("a.org", "1.1.1.1", 7)], "domain string, ip string, ts long")).collect()[0]["last_seen"] == 7
    m = spark.createDataFrame([("a", i, i // 2) for i in range(5)], "domain string, id int, ts int")
    assert sorted(r["id"] for r in state.prune(m, 2).collect()) == [3, 4] and state.prune(m, 0).count() == 5


def test_reports(spark):
    rows = [("s.org_240101.html", "s.org_240102.html", 0.9), ("s.org_240101.html", "t.org_240101.html", 0.8), ("s.org_240102.html", "t.org_240101.html", 0.7), ("s.org_240101.html", "u.org", 0.6), ("t.org_240101.html", "u.org", 0.95)]
    scores = spark.createDataFrame(rows, "a string, b string, score double")
    groups = spark.createDataFrame([("s.org", "g"), ("t.org", "g")], "site string, grp string")
    got = sorted((r["section"], r["grp"], r["a"], r["b"], r["place"]) for r in reports.sections(scores, groups, top=1).collect() if r["grp"])
    assert got == [("date", "s.org", rows[0][0], rows[0][1], 1), ("group", "g", rows[1][0], rows[1][1], 1), ("group", "g", rows[2][0], rows[2][1], 2)]
    assert [(r["a"], r["place"]) for r in reports.sections(scores, groups, top=1).where("section = 'top'").collect()] == [("t.org_240101.html", 1)]
    assert [r["score"] for r in reports.best_pairs(scores, ["score"], 2).orderBy("place").collect()] == [0.95, 0.9]
    assert reports.matrix(scores, "score").count() == 14
    names = ["linkkf.live_260430.html", "a_b_archive_x.html", "a_12345_b.html", "a_123456"]
    assert values(spark, "n string", [(n,) for n in names], reports.stem_site(F.col("n")), reports.file_site(F.col("n"))) == [("linkkf.live", "linkkf.live"), ("a_b", names[1]), ("a_12345_b", names[2]), ("a", "a")]
    spark_line = reports.points(spark.createDataFrame([(0, 0), (1, 5), (2, 10)], "i int, v int"), *reports.SPARKLINE)
    assert [(r["x"], r["y"]) for r in spark_line.orderBy("i").collect()] == [(2, 30), (40, 16), (78, 2)]
    two = spark.createDataFrame([("a", 0, 3), ("a", 1, 6), ("b", 0, 12), ("b", 1, 0)], "s string, i int, v int")
    assert [(r["x"], r["y"]) for r in reports.points(two, *reports.TRAFFIC, series=["s"]).orderBy("s", "i").collect()] == [(28, 94), (592, 65), (28, 8), (592, 122)]
    buckets = spark.createDataFrame([(60, 1, 2, 3, 4), (180, 5, 6, 7, 8)], state.BUCKETS)
    assert sorted(tuple(r) for r in reports.dense_minutes(buckets, 200, 3).collect()) == [(60, 1, 2, 3, 4), (120, 0, 0, 0, 0), (180, 5, 6, 7, 8)]


def test_workbook(spark, tmp_path):
    scores = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, m double")
    reports.workbook(scores, ["m"], spark.createDataFrame([], "site string, grp string"), str(tmp_path / "wb"))
    assert spark.read.option("header", True).csv(str(tmp_path / "wb" / "matrix_m")).count() == 4


def test_files(spark, tmp_path):
    for name, body in (("a.html", b"<p>x\xff</p>"), ("b.htm", b"y"), ("c.txt", b"z")):
        (tmp_path / name).write_bytes(body)
    assert sorted(tuple(r) for r in files.html_dir(spark, str(tmp_path)).collect()) == [("a.html", "<p>x</p>"), ("b.htm", "y")]
    (tmp_path / "b.htm").unlink()
    with pytest.raises(ValueError):
        files.html_dir(spark, str(tmp_path))
    (tmp_path / "urls.txt").write_text("# no\n\n  http://a.org/ \nb.org\n")
    assert [r["url"] for r in files.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["http://a.org/", "b.org"]
    assert values(spark, "u string", [("http://a",), ("b.org",)], files.with_scheme(F.col("u"))) == ["http://a", "https://b.org"]
    assert files.Settings.load("not [ toml", "[filter]\nprobe_threshold = 70\nother = 1").probe_threshold == 70 and files.Settings.load(None).skip_private
    html = "<link href='/s.css'><script src='http://x.org/a.js'></script><img src='data:abc'><img src='b/c.png'><img src='b/c.png'><a href='n'><link>"
    assert values(spark, "h string", [(html,)], files.assets(F.col("h"), F.lit("http://s.org/d/"))) == [["http://s.org/d/b/c.png", "http://s.org/s.css", "http://x.org/a.js"]]
    with pytest.raises(ValueError):
        files.labels(spark, '[[classes]]\nname = "a"\nkind = "odd"')


def test_components(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "u string, v string")).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(61)}, "x": "x", "y": "x"}


def test_requests():
    assert views.alert_request("ack=show&sev=3&page=2") == {"show_acked": True, "min_severity": 3, "page": 2}
    assert views.alert_request("sev=300&page=x") == views.alert_request("") == {"show_acked": False, "min_severity": 0, "page": 1} and views.alert_request("page=0")["page"] == 1
    assert views.probe_request("ip=1.2.3.4&sources=ptr,a%2Bb&verify=on") == {"ip": "1.2.3.4", "sources": ["ptr", "a+b"], "verify": True}
    assert views.probe_request("sources=ptr") is None and views.source_list(" ptr, ,hackertarget,passive-dns,, ") == ["ptr", "hackertarget", "passive-dns"]


def test_views(spark):
    rows = [(i, "a.org" if i % 2 else "b.org", i % 5 + 1, "PREFILTER_MALICIOUS" if i % 3 == 0 else "x", None, 100 + i // 2, i % 4 == 0) for i in range(10)]
    alerts = spark.createDataFrame(rows, state.ALERTS)
    got, page, pages = views.alerts_page(alerts, page=99, size=3)
    assert (page, pages) == (3, 3) and [r["id"] for r in got.collect()] == [1]
    got, page, pages = views.alerts_page(alerts, True, 4, -5, 3)
    assert (page, pages) == (1, 2) and [r["id"] for r in got.collect()] == [9, 8, 4]
    assert views.alerts_page(alerts.limit(0))[1:] == (1, 0)
    assert [tuple(r) for r in views.severity_breakdown(alerts).orderBy("severity").collect()] == [(1, "info", 1, 50), (2, "low", 2, 100), (3, "medium", 2, 100), (4, "high", 1, 50), (5, "critical", 1, 50)]
    domains_ = spark.createDataFrame([("a.org", 70, "probe", 1, 2), ("b.org", None, None, 1, 2), ("x.y.z.org", 90, "probe", 1, 2)], state.DOMAINS)
    ips = spark.createDataFrame([("a.org", f"1.1.1.{i}", 0, i) for i in range(7)], state.DOMAIN_IPS)
    probes = spark.createDataFrame([("a.org", 50, False), ("a.org", 40, True), ("b.org", 5, True)], state.PROBE_RUNS)
    assert tuple(views.totals(domains_, alerts, ips, probes).first()) == (3, 7, 4, 0, 0, 7, 3, 50)
    listed = {r["domain"]: (r["risk_class"], r["open_alerts"], r["ips"]) for r in views.domain_list(domains_, alerts, ips).collect()}
    assert listed["a.org"] == ("risk-high", 5, "1.1.1.6,1.1.1.5,1.1.1.4,1.1.1.3,1.1.1.2") and listed["b.org"][:2] == ("", 2)
    snaps = spark.createDataFrame([(i, "a.org", i, 0, f"t{i}", None, [], [], []) for i in range(25)], state.SNAPSHOTS)
    page = views.domain_page("a.org", domains_, alerts, ips, snaps, probes)
    assert tuple(page["domain"].first()) == ("a.org", 70, "risk-high", 40, 50) and page["snapshots"].count() == 20
    assert [r["score"] for r in page["risk"].orderBy("step").collect()] == [0, 5, 65, 70, 75, 100]
    assert [r["domain"] for r in views.needing_probe(domains_, probes, 100, 60, 45).collect()] == ["a.org"] and not views.needing_probe(domains_, probes, 100, 60, 51).collect()
    labels = spark.createDataFrame([(0, "fine", "benign", ["q.org"]), (1, "bad", "malicious", ["a.org", "", "n.org"]), (2, "shop", "known", ["a.org"])], "class_id int, name string, kind string, typical array<string>")
    assert sorted((r["domain"], r["class_name"], r["snapshots"], r["title"], r["status"]) for r in views.tracked(labels, snaps, probes, 40 + 7 * 86400).collect()) == [("a.org", "bad", 25, "t24", "stale"), ("n.org", "bad", 0, None, "no baseline")]
    asked = spark.createDataFrame([("a", False, 1), ("b", True, 5), ("a", True, 7), ("c", False, 0), ("d", True, 2)], "domain string, priority boolean, seq int")
    failed = spark.createDataFrame([("d", 900), ("c", 100)], "domain string, ts int")
    assert [r["domain"] for r in views.probe_queue(asked, failed, 1000).collect()] == ["a", "b", "c"]


def test_match_list(spark):
    html = "<html><body><div><ul><li>one two</li><li>x yy</li></ul></div><section><p>a</p><p>b</p></section></body></html>"
    rows = page_pairs.match_list(spark.createDataFrame([(1, 2, html, html.replace("one", "other")), (3, 4, None, html)], "a long, b long, html_a string, html_b string")).collect()
    a, b = dom.Page(html), dom.Page(html.replace("one", "other"))
    assert [(r["node_a"], r["node_b"]) for r in rows if r["a"] == 1] == dom.matches(a, b) and all(r["hue"] == int((1 - r["jaccard"]) * 240) for r in rows) and {r["a"] for r in rows} == {1}
