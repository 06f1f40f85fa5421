"""The monitoring side: statements against DuckDB, functions against small facts."""

import json
import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators import fingerprint, model
from netloom.plans import catalog
from netloom.sources import packets
from netloom.streaming import flows

SF = "/root/testdata/sf0.001"


def norm(v):
    return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_statement(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    r = con.execute(catalog.ORACLE[name])
    cols, theirs = sorted(df.columns), [x[0] for x in r.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    assert sorted(tuple(norm(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def row(spark, html, *cols):
    return spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string").select(*cols).first()


def test_fingerprint_facts(spark):
    h = F.col("html")
    text = lambda x: row(spark, x, T.visible_text(h).alias("t"))["t"]
    assert text("<p>Hello&amp; <b>W&nbsp;orld</b> für</p><script>x</script><!-- c -->") == "hello world fr"
    assert text("a<meta charset=x>b") == "a"  # an open block reaches to the end
    assert row(spark, "<html><body><div><p>x</p><br><img></div></body></html>", T.tag_bigrams(h).alias("b"))["b"] == ["_root>html", "body>div", "div>br", "div>img", "div>p", "html>body"]
    assert row(spark, "<div class='A b' data-class=no><p class=c>", T.css_classes(h).alias("c"))["c"] == ["a", "b", "c"]
    assert row(spark, "<title> A <b>b</b></title>", T.tag_text(h, "title").alias("t"))["t"] == "A b"
    same = spark.createDataFrame([(1, "http://a.org/1", "<html><body><h1>x</h1>hello world page</body></html>"), (2, "http://a.org/2", "<html><body><h1>x</h1>hello world page</body></html>")], "page_id long, url string, html string")
    assert fingerprint.compared(fingerprint.fingerprints(same)).select("kind", "label", "distance").first()[:] == ("identical", "EXACT", 0)


def test_simhash_against_loop(spark):
    def loop(t):
        b, votes = t.encode(), [0] * 64
        for i in range(len(b) - 2):
            h = 0xCBF29CE484222325
            for c in b[i : i + 3]:
                h = (h ^ c) * 0x100000001B3 % (1 << 64)
            votes = [v + (1 if h >> k & 1 else -1) for k, v in enumerate(votes)]
        x = sum(1 << k for k, v in enumerate(votes) if v > 0)
        return x - (1 << 64) if x >> 63 else x

    texts = ["", "ab", "abc", "hello world", "the quick brown fox"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.simhash_text(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {t: loop(t) for t in texts}


def test_trees(spark):
    stump = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [1.5, 0, 0], "default_left": [1, 0, 0], "base_weights": [0, -2, 3]}
    m = model.load(json.dumps({"learner": {"learner_model_param": {"base_score": "0", "num_class": "2", "num_feature": "1"}, "gradient_booster": {"model": {"trees": [stump], "tree_info": [1]}}}}))
    assert model.raw_scores(m, np.array([[0.0], [2.0], [np.nan], [1.5]]))[:, 1].tolist() == [-2, 3, -2, 3]
    df = spark.createDataFrame([([2.0],)], "f array<float>").select(model.predict(m, F.col("f")).alias("p"))
    assert math.isclose(df.first()["p"][1], 1 / (1 + math.exp(-3)))


def frame(payload, proto=6, vlan=False):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 0, 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([8, 8, 8, 8]))
    return bytes(12) + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + ip + payload


def test_packets(spark, tmp_path):
    tcp = struct.pack(">HHIIBBHHH", 0xABCD, 443, 1, 16, 5 << 4, 0x18, 0, 0, 0) + b"hello"
    want = {"src": "10.0.0.1", "dst": "8.8.8.8", "sport": 0xABCD, "dport": 443, "ack": 16, "flags": 0x18, "payload_len": 5}
    assert packets.tcp_packet(frame(tcp)) == packets.tcp_packet(frame(tcp, vlan=True)) == want and packets.tcp_packet(frame(tcp, 17)) is None
    name = b"\x01a\x03org\x00"
    answer = lambda n, kind, data: n + struct.pack(">HHIH", kind, 1, 300, len(data)) + data
    head = lambda flags, n: struct.pack(">HHHHHH", 1, flags, 1, n, 0, 0) + name + b"\x00\x01\x00\x01"
    msg = head(0x8180, 2) + answer(b"\xc0\x0c", 5, b"\x01b\xc0\x0e") + answer(b"\x01b\xc0\x0e", 1, bytes([1, 2, 3, 4]))
    assert packets.dns_answers(msg) == [("1.2.3.4", "b.org", 300), ("1.2.3.4", "a.org", 300)]
    assert packets.dns_answers(head(0x0100, 0)) == packets.dns_answers(head(0x8183, 0)) == []
    frames = [frame(tcp), frame(struct.pack(">HHHH", 53, 9, 8 + len(msg), 0) + msg, 17)]
    body = b"".join(struct.pack("<IIII", 7, 0, len(f), len(f)) + f for f in frames)
    (tmp_path / "x.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + bytes(20) + body)
    got = packets.read_frames(spark, str(tmp_path / "x.pcap")).select(packets.decode_tcp(F.col("frame")).alias("p"), packets.decode_dns(F.col("frame")).alias("d")).collect()
    assert got[0]["p"].asDict() == want and [x["domain"] for x in got[1]["d"]] == ["b.org", "a.org"]


def test_throttle_stream_equals_batch(spark, tmp_path):
    rows = [(k, t) for k in "ab" for t in (0, 30, 59, 61, 119, 121)]
    df = spark.createDataFrame(rows, "key string, t long")
    df.write.parquet(str(tmp_path / "in"))
    stream = flows.throttle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 60)
    q = stream.writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = sorted((k, t) for k in "ab" for t in (0, 61, 121))
    assert sorted(tuple(r) for r in spark.table("throttled").collect()) == sorted(tuple(r) for r in flows.throttle_batch(df, 60).collect()) == want
