"""Each operator against a brute-force version, on rows with nulls, repeats, ties and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import ctw, decontaminate, langid, licenses, lm, mixing, registry, sharding, simhash, tokenfiles, topk, urlfilter
from netloom.operators import components

WORDS = "the of and alpha beta gamma delta été über señor token model data spark query shard".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, row long, h long"


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = [(i, text(rng, rng.choice([3, 30, 120]))) for i in range(60)]
    base = text(rng, 200)
    rows += [(100 + i, base) for i in range(30)]
    rows += [(200 + i, base + " " + rng.choice(WORDS)) for i in range(10)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "One"), (304, "A b"), (304, "A b"), (305, "A B"), (None, base), (None, None)]
    rows += [(306, text(rng, 30_000)), (307, "x" * 3_000_000), (308, "Ünïcode… ÉTÉ!\n\nx  y\r\n'tis  don't 12½ _a_ <|endoftext|>")]
    source = lambda i: None if i is None else ["a", "b", "B", "é", None][(i % 7) % 5]
    return [(i, t, "en", source(i), len(t or ""), 1, 2, 3) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(rows, key=key)


def test_topk(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.3]) for _ in range(4)]) for i in range(400)]
    rows += [(7, rows[7][1]), (None, [0.1] * 4), (900, None), (901, [0.1, None, 0.2, 0.3]), (902, [float("nan")] * 4), (903, [float("inf")] * 4), (904, [0.5] * 3), (1000, [0.5] * 3), (905, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, q int, dim int")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), k=10, shard_rows=16, block_rows=2, fan_in=3)
    vectors = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in vectors:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:10]
            want += [(q, n + 1, i, -c) for n, (c, i) in enumerate(s)]
    same(got, want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0]), (2, [-(2.0**45), 1.0])], "vec_id long, embedding array<double>")
    same(topk.top_k(big, big.where("vec_id = 0")), [(0, 1, 1, topk.TOP), (0, 2, 2, -topk.TOP)])


def fingerprint(t, k=3):
    import xxhash

    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def brute_components(rows, radius):
    prints = [f for _, f in rows]
    of = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius])
    low = {}
    for (i, _), r in zip(rows, of):
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    return [low[r] for r in of]


def test_simhash(spark, docs, none):
    rows = [(r[0], fingerprint(r[1])) for r in corpus()]
    want = [(i, f - (1 << 64) if f >> 63 else f, c) for (i, f), c in zip(rows, brute_components(rows, 2))]
    same(simhash.near_duplicates(docs), want)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("cell_rows", [4, 100_000])
@pytest.mark.parametrize("radius", [2, 6])
def test_links_of_dense_fingerprints(spark, cell_rows, radius):
    rng = random.Random(radius)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for c in centre for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, fp long")
    got = {tuple(sorted(r)) for r in simhash.links(nodes, radius, cell_rows=cell_rows).collect()}
    assert got == {(a, b) for b in range(len(prints)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= radius}


@pytest.mark.parametrize("cell_rows", [2048, 4])
def test_joining_links(spark, cell_rows):
    """They are links, and join what all links join; dense groups give fewer than all pairs."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for c in centres for _ in range(60)})
    other = {p: rng.getrandbits(64) & 0x3FFFFF for p in prints}
    signed = simhash._signed
    nodes = spark.createDataFrame([(i, signed(p), signed(other[p])) for i, p in enumerate(prints)], "node long, fp long, fp2 long")
    every = {(j, i) for i, p in enumerate(prints) for j, q in enumerate(prints[:i]) if (p ^ q).bit_count() <= 6 and (other[p] ^ other[q]).bit_count() <= 10}
    got = {tuple(sorted(r)) for r in simhash.joining_links(nodes, 6, {"fp2": 10}, cell_rows).collect()}
    assert got <= every and len(every) > 3000

    def classes(pairs):
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in root]

    assert classes(got) == classes(every)
    if cell_rows > 1000:
        assert len(got) < len(every)
    assert simhash.joining_links(nodes.limit(0), 6, {"fp2": 10}, cell_rows).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    of = roots(300, pairs)
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(pairs + pairs[:9] + [(5, 5)], "u long, v long")).collect())
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: of[x] for x in linked}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def levels(sizes, weights):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        part = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * part > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3 * sizes[s] if full else w[s] * part
        rest -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def test_mixing(spark, docs, none):
    plan = mixing.mix(docs, block_words=8, shard_blocks=64, bucket_rows=100)
    got = plan.taken.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = corpus()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, size(r[1])) for r in rows)
    sizes, of = Counter(), {(r[0], size(r[1])): r[3] for r in rows}
    for r in rows:
        sizes[r[3]] += size(r[1])
    target, taken = levels(sizes, (5, 2, 1)), Counter()
    for r in got:
        s = of[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s]) and 0 <= r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 2 * 8), (s, taken[s], target[s])
    again = mixing.mix(docs.repartition(7), block_words=8, shard_blocks=64, bucket_rows=100).taken
    same(again, [tuple(r) for r in got])
    n = plan.slots.groupBy("rank", "turn").agg(F.count("*").alias("n"), F.countDistinct("block").alias("d"))
    assert n.where("n <> d").count() == 0
    per = [r["n"] for r in plan.slots.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sorted(per)[1:] == [64] * (len(per) - 1)
    assert mixing.mix(none).taken.count() == 0


def test_mixed_documents(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, rng.randint(0, 60)), "en", f"s{i % 3}", 0, 1, 2, 3) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix(df, block_words=8)
    taken = {r["doc_id"]: r["taken"] for r in plan.taken.collect()}
    got = {r["doc_id"]: r["text"] for r in mixing.mixed_documents(df, plan).collect()}
    assert {i for i, n in taken.items() if n} == set(got)
    for i, t in got.items():
        assert len(t.split()) == taken[i] and not Counter(t.split()) - Counter(3 * rows[i][1].split())


def brute_scores(rows, fold=5, out=1):
    train = [(t or "").encode().lower().split() for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % fold != out]
    c = Counter(w for ws in train for w in ws) + Counter({None: len(train)})
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        ws = [*(t or "").encode().lower().split(), None]
        yield i, None if i is None else zlib.crc32(str(i).encode()) % fold == out, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)


class Node:
    """One context of one decision in a context tree, brute force."""

    def __init__(self, pairs, depth, most, kept):
        self.zero, self.one = (sum(b == x for _, b in pairs) for x in (0, 1))
        self.pe = sum(math.log(((i + 0.5) / (i + 1 + 0))) for i in ()) + math.lgamma(self.zero + 0.5) + math.lgamma(self.one + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(self.zero + self.one + 1)
        self.kids, rest = {}, []
        if depth < most:
            for c in {ctx[-depth - 1] for ctx, _ in pairs}:
                mine = [(ctx, b) for ctx, b in pairs if ctx[-depth - 1] == c]
                if kept(mine[0][0][len(mine[0][0]) - depth - 1 :]):
                    self.kids[c] = Node(mine, depth + 1, most, kept)
                else:
                    rest += mine
        z, o = (sum(b == x for _, b in rest) for x in (0, 1))
        below = sum(k.pw for k in self.kids.values()) + math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1)
        self.rest = (o + 0.5) / (z + o + 1)
        self.w = 1 / (1 + math.exp(below - self.pe)) if self.kids else 1.0
        self.pw = np.logaddexp(self.pe, below) - math.log(2) if self.kids else self.pe

    def chance(self, ctx, depth, kept):
        own = (self.one + 0.5) / (self.zero + self.one + 1)
        if self.w == 1.0 and not self.kids:
            return own
        if not kept(ctx[len(ctx) - depth - 1 :]):
            low = self.rest
        else:
            low = self.kids[ctx[-depth - 1]].chance(ctx, depth + 1, kept) if ctx[-depth - 1] in self.kids else 0.5
        return self.w * own + (1 - self.w) * low


def test_context_tree(spark):
    rng = random.Random(4)
    texts = [text(rng, rng.randint(0, 25)) for _ in range(30)]
    depth, contexts = 2, 60
    tree, total = ctw.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), depth, contexts)
    data = [bytes([ctw.START] * depth) + ctw.normalised(t.encode()) + bytes([ctw.END]) for t in texts]
    seen = [(d[i - depth : i], d[i]) for d in data for i in range(depth, len(d))]
    assert total == len(seen)
    floor = -(-total // contexts)
    size = Counter(c[depth - d :] for c, _ in seen for d in range(1, depth + 1))
    kept = lambda c: size[c] >= floor
    trees = {}

    def bits(s):
        return [(1 << j | s >> 8 - j, s >> 7 - j & 1) for j in range(8)]

    by_node = {}
    for c, s in seen:
        for node, b in bits(s):
            by_node.setdefault(node, []).append((c, b))
    for node, pairs in by_node.items():
        trees[node] = Node(pairs, 0, depth, kept)
    tries = sorted(set(seen))[:60] + [(b"zq", ord("a")), (b"th", 0xFF), (b"th", ord("z"))]
    grams = np.array([int.from_bytes(c + bytes([s]), "big") for c, s in tries], np.uint64)
    got = tree.log10(grams)
    for (c, s), x in zip(tries, got):
        p = 0.0
        for node, b in bits(s):
            one = trees[node].chance(c, 0, kept) if node in trees else 0.5
            p += math.log10(one if b else 1 - one)
        assert math.isclose(x, p, rel_tol=1e-9, abs_tol=1e-9), (c, s)
    every = np.array([int.from_bytes(b"th" + bytes([s]), "big") for s in range(256)], np.uint64)
    assert math.isclose((10 ** tree.log10(every)).sum(), 1.0, rel_tol=1e-9)


def test_lm_score(spark, docs, none):
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    train = docs.where(fold != 1)
    for frequent in (4, 1 << 18):
        base = lm.word_base(train, frequent)
        tree, _ = ctw.train(train, depth=3)
        got = lm.score(docs, tree, base).collect()
        want = sorted(brute_scores([(r[0], r[1]) for r in corpus()]), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        for r, w in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])), want, strict=True):
            assert (r["doc_id"], r["n_tokens"], r["n_known"], base.total) == (w[0], *w[2:5])
            assert math.isclose(r["base_score"], w[5], rel_tol=1e-9) and r["score"] < 0
    empty, _ = ctw.train(none)
    nothing = lm.word_base(none)
    assert lm.score(none, empty, nothing).count() == 0 and nothing.total == 0
    row = lm.score(docs.where("doc_id = 303"), empty, nothing).first()
    assert math.isclose(row["score"], 4 * 8 * math.log10(0.5)) and row["n_known"] == 0


def test_token_files(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder, parts = tokenfiles.write_tokens(docs, path, folder=f"file://{tmp_path}/ids", seq_len=64, batch_rows=4, file_rows=30)
    assert len(parts) > 1
    model, start, want, by_id = Tokenizer.from_file(path), 0, [], {}
    for r in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        by_id[start] = ids
        start += len(ids)
    same(tokenfiles.read_tokens(spark, folder, parts), want)
    every = [x for s in sorted(by_id) for x in by_id[s]]
    part, _, n = tuple(parts[0])
    for i in (0, 3, 5):
        ids, mask = tokenfiles.read_sequence(f"{tmp_path}/ids/part-{part:06d}.arrow", i, 4)
        assert ids[mask].tolist() == every[64 * i : min(n, 64 * i + 64)] and len(ids) == 64
    folder, parts = tokenfiles.write_tokens(none, path)
    assert parts == [] and tokenfiles.read_tokens(spark, folder, parts).count() == 0


def test_encoder_equals_library():
    import public_tokenizers
    from hypothesis import given, settings, strategies as st

    enc = tokenfiles.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert enc.cuts
    alphabet = st.sampled_from(list("abz ABé  \n\n'sdtmlrev,.#_9½漢²\t\x00 ") + ["don't", "\n ", " \n", "the", " The", "’", "ß"])

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.lists(alphabet, max_size=14).map("".join), max_size=4))
    def check(texts):
        ids, counts = enc.encode(texts)
        assert np.split(ids, np.cumsum(counts)[:-1])[: len(texts)] == [] or [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == [enc.model.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def folded_words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


@pytest.mark.parametrize("block_bytes", [1 << 22, 200])
def test_decontaminate(spark, docs, none, block_bytes):
    rows = corpus()
    long = rows[1][1] if len((rows[1][1] or "").split()) > 20 else next(r[1] for r in rows if r[1] and len(r[1].split()) == 120)
    items = [(1, " ".join(long.split()[5:40]).upper()), (2, "nothing, of this! occurs anywhere in it at all zzz"), (3, "One"), (3, "One"), (4, None), (5, "..."), (None, "a B"), (10, " ".join(long.split()[10:22])), (11, "ünïcode ÉTÉ")]
    bench = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, n_words int")
    got = decontaminate.digest(decontaminate.contamination(docs, bench, block_bytes=block_bytes))
    want = []
    for r in rows:
        w, hit, of = folded_words(r[1]), set(), set()
        for i, t in items:
            x = folded_words(t)
            for j in range(max(1, len(x) - 9) if x else 0):
                y = x[j : j + 10]
                for p in range(len(w) - len(y) + 1):
                    if w[p] == y[0] and w[p : p + len(y)] == y:
                        hit.update(range(p, p + len(y)))
                        of.add("" if i is None else str(i))
        want.append((r[0], len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    assert any(w[5] for w in want) and not all(w[5] for w in want)
    same(got, want)
    spans = {r["doc_id"]: r["spans"] for r in decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert [rows[-1][1][s["start"] : s["stop"]] for s in spans[308]] == [] or spans[308]
    assert spans[303][0]["start"] == 0 and spans[303][0]["stop"] == 3
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0


def test_url_filter(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q#f", "https://www.Example.com/en/", "http://example.com", "http://example.com/en", "ftp://b.net/es/?x", "http://net/fr/a", "http://b.net/de/", "http://notnet/fr/", None, "", "no scheme", "http:///en/", "http://x.org#://a.com/", "http://b.net/fr/a", "http://b.net/fr/a"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, "http://a.com/", "h", "p")], "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(registry.URL_RULES, "host string, path string, verdict string")
    want = []
    for i, u in [*enumerate(urls), (None, "http://a.com/")]:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"))
    same(urlfilter.match(pages, rules), want)
    same(urlfilter.match(pages, rules, bits_per_key=1), want)
    assert urlfilter.match(pages.limit(0), rules).count() == 0
    assert urlfilter.match(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == len(want)


def test_sharding(spark, docs, none):
    rows = corpus()
    rng = random.Random(8)
    more = [(1000 + i, text(rng, rng.randint(1, 60)), "en", "a", 0, 1, 2, 3) for i in range(3000)] + [(5000 + i, "copy " * 30, "en", "a", 0, 1, 2, 3) for i in range(1500)]
    df = docs.where("doc_id is null or doc_id not in (306, 307)").unionByName(spark.createDataFrame(more, SCHEMA))
    for rows_in_range in (1_000_000, 50):
        got = sharding.shard(df, shards=8, range_rows=rows_in_range).collect()
        every = [r for r in rows if r[0] not in (306, 307)] + more
        want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in every)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        load, slots, where = Counter(), {}, {}
        for r in got:
            load[r["shard"]] += r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
            where.setdefault(r["text_crc32"], set()).add(r["shard"])
        share = sum(load.values()) / 8
        assert set(load) == set(range(8)) and all(abs(x - share) <= 0.12 * share for x in load.values()), load
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        big = zlib.crc32(("copy " * 30).encode())
        assert all(len(s) == 1 for c, s in where.items() if c not in (big, 0)) and len(where[big]) > 1
        again = sharding.shard(df.repartition(5), shards=8, range_rows=rows_in_range).collect()
        assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in got)
    assert sharding.shard(none).count() == 0


def test_language(spark, docs, none):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "li", "mo"], "bb": ["st", "er", "un"], "cc": ["ño", "que", "la"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, make(lang), lang, "s", 0, 1, 2, 3) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa", "s", 0, 1, 2, 3), (901, "12 !? \n", "aa", "s", 0, 1, 2, 3), (902, make("bb").upper() * 400, None, "s", 0, 1, 2, 3), (None, make("cc"), "cc", "s", 0, 1, 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df.where("doc_id % 4 <> 2"), sample_rows=20)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows[:120])
    assert (got[900]["lang_pred"], got[901]["lang_pred"], got[902]["lang_pred"], got[None]["lang_pred"]) == ("und", "und", "bb", "cc")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, model).count() == 0
    nothing = langid.train(none)
    assert langid.identify(df, nothing).where("lang_pred = 'und' and score = 0").count() == len(rows)
    # cross-parsing against the definition: longest phrases that occur in the sample
    sample, table = "banana band", langid.fold_table("abdn")
    codes = langid.folded(sample, table)
    move = langid.suffix_automaton(codes, 6)
    for t in ("ban", "nab", "band", "xnanad", "dddd", "banana band banana"):
        c = langid.folded(t, table).tolist()
        at, n, hay = 0, 0, codes.tolist()
        occurs = lambda w: any(hay[i : i + len(w)] == w for i in range(len(hay)))
        while at < len(c):
            k = 1
            while at + k < len(c) and occurs(c[at : at + k + 1]):
                k += 1
            at, n = at + k, n + 1
        m = np.full((langid.STRETCH, 1), langid.PAD, np.uint8)
        m[: len(c), 0] = c
        assert langid.phrases(m, move).tolist() == [n], t


def test_licenses(spark, docs, none):
    apache = "/* Licensed under the Apache License, Version 2.0 (the \"License\");\n you may not use this file except in compliance\n with the License. Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. */"
    rows = [(1, "Hello\nReleased under the MIT License.\nbye", "MIT", "permissive"), (2, apache, "Apache-2.0", "permissive"), (3, "Licensed under CC BY-NC 4.0. Released under the MIT License.", "CC-BY-NC-4.0,MIT", "noncommercial"), (4, "released under the mit license agreement", "", "none"), (5, None, "", "none"), (6, "", "", "none")]
    df = spark.createDataFrame([(i, t, 1) for i, t, _, _ in rows], "doc_id long, text string, w int")
    got = {r["doc_id"]: (r["licenses"], r["verdict"]) for r in licenses.scan(df).collect()}
    assert got == {i: (a, b) for i, _, a, b in rows}
    assert licenses.scan(docs).count() == len(corpus()) and licenses.scan(none).count() == 0


def brute_licenses(text):
    """By the definition: sentences cut twice, rules as subsequences of either cut."""
    entries = {}
    for name, s in licenses.SENTENCES:
        parts = [licenses.normalised(p) for p in re.split(r"[.!?;:]+\s+", s)]
        entries[name] = parts
    known = {p for parts in entries.values() for p in parts}
    text = text or ""
    cut = re.split(r"[.!?;:]+[ \t\r\n\f\x0b]+|\x01", text)
    lines = [x for p in cut for x in re.split(r"[\r\n]+", p)]
    found = set()
    for parts in (cut, lines):
        ids = [n for n in map(licenses.normalised, parts) if n in known]
        for lic, kind, names in licenses.RULES:
            at = iter(ids)
            if all(any(x == want for x in at) for n in names for want in entries[n]):
                found.add((lic, kind))
    verdict = next((k for k in licenses.KINDS if k in {kind for _, kind in found}), "none")
    return ",".join(sorted(lic for lic, _ in found)), verdict, sum(bool(licenses.normalised(p)) for p in cut)


def test_licenses_against_brute_force(spark):
    rng = random.Random(11)
    pieces = [s for _, s in licenses.SENTENCES]
    texts = [None, "", ". . .", "x" * 200_000 + ". Released under the MIT License.\n" + "y " * 100_000]
    for _ in range(400):
        some = [rng.choice(pieces) if rng.random() < 0.7 else "some other words" for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.5:
            lic = rng.choice(licenses.RULES)[2]
            some += [dict(licenses.SENTENCES)[n] for n in lic]
        some = [x.upper() if rng.random() < 0.2 else x.replace(" ", "\n * ", 1) if rng.random() < 0.2 else x for x in some]
        texts.append(rng.choice([". ", ".\n", "\n", "; "]).join(some))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string").repartition(5)
    got = {r["doc_id"]: (r["licenses"], r["verdict"], r["n_sentences"]) for r in licenses.scan(df).collect()}
    assert got == {i: brute_licenses(t) for i, t in enumerate(texts)}
    assert len({v[0] for v in got.values()}) > 40


def test_url_filter_with_many_entries(spark):
    rng = random.Random(12)
    made = [("d%d.%s" % (rng.randrange(60_000), rng.choice(["com", "net", "org"])), "/" + "/".join("p%d" % rng.randrange(5) for _ in range(rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(100_000)]
    made += [("com", "/", "allow"), ("only.example.org", "", "block")]
    rules = spark.createDataFrame(made, "host string, path string, verdict string")
    urls = ["http://" + rng.choice(["", "www.", "a.b."]) + "d%d.%s" % (rng.randrange(90_000), rng.choice(["com", "net", "org"])) + "/p%d/p%d/x?q" % (rng.randrange(6), rng.randrange(6)) for _ in range(3000)]
    urls += ["http://x.only.example.org", "http://hot.d1.com/p1/p2/p3"] + ["http://hot.d1.com/p1/p2/p3"] * 3000 + [None] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(6)
    best = {}
    for h, p, v in made:
        best[h, p] = max(v, best.get((h, p), v))
    want = {}
    for i, u in enumerate(urls):
        host, _, path = (u or "").partition("://")[2].partition("?")[0].partition("/")
        path = "/" + path if "/" in (u or "").partition("://")[2] else ""
        labels = host.split(".") if host else []
        fits = [(".".join(labels[j:]), path[:n]) for j in range(len(labels)) for n in range(len(path) + 1)]
        fits = [f for f in fits if f in best]
        rule = max(fits, key=lambda f: (len(f[0] + f[1]), len(f[0])), default=None)
        want[i] = (host, path, rule and rule[0] + rule[1], best[rule] if rule else "allow")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.match(pages, rules).collect()}
    assert got == want


def test_sharding_spreads_groups_of_short_texts(spark):
    rng = random.Random(13)
    rows = [(i, None if i % 3 == 0 else text(rng, rng.randint(1, 40))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard(df, shards=8).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(r["doc_id"] for r in got) == list(range(6000))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["size"] == 1}) == 1  # a small group stays in one shard
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.1 * sum(load.values()) / 8
