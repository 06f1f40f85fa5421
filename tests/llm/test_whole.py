"""Each operator does the whole job: what a cut, a cap or a filter would lose."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import ctw, lm, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_lm_learns_every_context(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(200)] + [(900, None), (None, "été xyz"), (901, "zz " * 5000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    tree, total = ctw.train(train, contexts=1 << 60)  # no context is too rare
    assert total > 3 << 16
    want = {r["doc_id"]: r["score"] for r in lm.score(docs, tree, lm.word_base(train)).collect()}
    got = {r["doc_id"]: r["score"] for r in registry.op5_lm_score(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    for r in registry.op5_lm_score(spark, str(tmp_path)).collect():
        text = dict((i, t) for i, t, *_ in rows)[r["doc_id"]]
        assert math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / (len(ctw.normalised((text or "").encode())) + 1), rel_tol=1e-9)
    few = lm.score(docs, ctw.grown(train), lm.word_base(train), common=50)
    assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in few.collect())


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_grown_tree(spark, depth):
    rng = random.Random(depth)
    texts = spark.createDataFrame([("".join(rng.choice("abc é") for _ in range(rng.randint(0, 60))),) for _ in range(50)], "text string").repartition(3)
    tree, total = ctw.train(texts, depth)
    model = ctw.grown(texts, depth)
    other = texts.unionAll(spark.createDataFrame([("zq abcab",), (None,)], "text string"))
    got = ctw.gram_scores(model, ctw.gram_counts(other, depth)).toPandas()
    assert model.total == total and len(got) == len(set(got["gram"])) == ctw.gram_counts(other, depth).count()
    assert np.allclose(got["score"], tree.log10(got["gram"].to_numpy().astype(np.uint64)), rtol=1e-9)


def brute_components(texts, least=0.8):
    """Of each text: the smallest index that similar texts join it with."""
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s, root = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] == s[j] or 5 * both >= 4 * (len(s[i]) + len(s[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_dedup_by_five_word_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([4, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(6):  # about 0.7 to 0.95 similar
            near = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    texts += [None, "", "One two", "one  TWO", "a b c d e"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    twice = [(None, "null id alone " + "x y z " * 9, "en", "s", 1)] * 2 + [(None, texts[0], "en", "s", 1), (5, "another text of id five", "fr", "s", 1)]
    docs = spark.createDataFrame(rows + twice, SCHEMA).repartition(4)
    want = {i for i, r in enumerate(brute_components(texts)) if i == r}
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    extra = {(None, twice[0][1]), (5, twice[3][1])}
    assert sorted(i for i, t in got if (i, t) not in extra) == sorted(want)
    assert extra <= set(got) and len(got) == len(want) + 2
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_documents_without_an_id_of_their_own(spark, tmp_path):
    import corpus_pipeline

    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [f"clean text number {i} " + " ".join(f"v{i}x{j}" for j in range(80)) for i in range(6)]
    rows = [(None, clean[0]), (None, clean[1]), (None, "so " + item), (7, clean[2]), (7, clean[3]), (7, item + " seven"), (8, clean[4]), (8, clean[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    want = [(i, t) for i, t in rows if item not in t]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted(want, key=key)
    # the mix takes every word of a source that is below its target
    out = corpus_pipeline.mixed(spark, got, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0 for r in out)) == [0, 0, 7, 7, 8, 8]
    for r in out:
        assert any(r["doc_id"] == i and set(r["text"].split()) <= set(t.split()) for i, t in want)


def _made(rng, syllables, words):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 3))) for _ in range(words))


def test_unlearned_languages_go(spark):
    import corpus_pipeline

    rng = random.Random(12)
    learned = {"aa": ["ka", "li", "mo", "ta", "ne"], "bb": ["st", "er", "un", "gei", "ach"]}
    rows = [(i, _made(rng, learned[k], rng.choice([1, 40, 120])), k) for i, k in enumerate(["aa", "bb"] * 120)]
    other = [(1000, _made(rng, ["zij", "voo", "wub", "hif", "quy"], 80), None), (1001, "".join(rng.choice("0123456789abcdef") for _ in range(600)), None), (1002, None, "aa"), (1003, "12 !", "aa")]
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows + other], SCHEMA).repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {r[0] for r in rows}


def test_letters_of_many_scripts_stay_apart(spark):
    from netloom.llm import langid

    rng = random.Random(13)
    common = [chr(0x4E00 + i) for i in range(150)]
    own = {"x": [chr(0x5000 + i) for i in range(120)], "y": [chr(0x6000 + i) for i in range(120)]}
    make = lambda k: "".join(rng.choice(own[k]) for _ in range(60))
    rows = [(i, make(k), k) for i, k in enumerate(["x", "y"] * 60)] + [(500 + i, "".join(rng.choice(common) for _ in range(900)), "z") for i in range(60)]
    docs = spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in rows], SCHEMA)
    model = langid.train(docs.where("doc_id % 4 <> 2"), sample_chars=4000)
    got = langid.identify(docs.where("doc_id % 4 = 2"), model, keep=["lang"]).collect()
    assert all(r["lang"] == r["lang_pred"] and r["letters"] in (60, 900) for r in got)
    alien = spark.createDataFrame([(1, "ひらがな" * 50)], "doc_id long, text string")
    far = langid.identify(alien, model).first()
    assert far["letters"] == 200 and far["phrase_bits"] > 10  # a script of no sample costs its letters one by one
    # one long row does not fill the sample
    long = [(0, "kalimota " * 9000, "x")] + [(i, f"w{'abcdefghij'[i % 10]}q" * 20, "x") for i in range(1, 40)]
    one = langid.train(spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in long], SCHEMA), sample_chars=4000)
    seen = langid.identify(spark.createDataFrame([(1, "wjq" * 20)], "doc_id long, text string"), one).first()
    assert seen["phrase_bits"] * seen["letters"] < 2 * one["bits"][0]


def test_the_pipeline_as_a_whole(spark, tmp_path):
    """One source: the mix takes every word once, so what is left is what the other stages keep."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(21)
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([("i", item), (None, None), ("short", "zz")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    langs = {"aa": ["ka", "li", "mo", "re", "sun"], "bb": ["st", "er", "un", "tt", "ox"]}
    texts = [(k, _made(rng, v, 90)) for k, v in langs.items() for _ in range(60)]
    rows = [(i, t, k, "s", len(t)) for i, (k, t) in enumerate(texts)]
    base = texts[5][1].split()
    near = base[:40] + ["kali"] + base[41:]  # 5 of 86 shingles differ on either side
    rows += [(500, texts[3][1], "aa", "s", 1), (501, " ".join(near), "aa", "s", 1), (502, texts[7][1] + " " + item, "aa", "s", 1), (503, None, None, "s", None), (504, "", "aa", "s", 0), (505, "123 456", "bb", "s", 7), (None, texts[9][1], "aa", "s", 1), (506, texts[11][1] + " " + texts[70][1], None, "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r[0]: r[1] for r in rows if r[0] not in (500, 501, 502, 503, 504, 505, None)}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    known = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert not {503, 504, 505} & known and len(set(kept) - known) <= 2
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(kept) & known
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = {i: sorted(t.split()) for i, t in kept.items()}
    start = 0
    for i in sorted(out):
        assert out[i]["start"] == start
        start += out[i]["n_tokens"]
    mixed = corpus_pipeline.mixed(spark, corpus_pipeline.decontaminated(spark, corpus_pipeline.near_dedup(spark, corpus_pipeline.language(spark, docs, str(tmp_path)), ""), str(tmp_path)), "").collect()
    for r in mixed:
        assert sorted(r["text"].split()) == words[r["doc_id"]]
        assert out[r["doc_id"]]["n_tokens"] == len(encode.encode(r["text"], add_special_tokens=False).ids) + 1


def test_encoder_keeps_the_pieces_it_meets_again(monkeypatch):
    """A full memory forgets what came once, not what comes all the time, and ids stay right."""
    import public_tokenizers
    from netloom.llm import tokenfiles

    monkeypatch.setattr(tokenfiles, "MEMO_PIECES", 100)
    enc = tokenfiles.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    common, learned, learn = [f"often{i}" for i in range(20)], [], enc.learn
    enc.learn = lambda pieces: (learned.extend(pieces), learn(pieces))
    for n in range(60):
        texts = [" ".join(["Start", *common, *(f"once{n}x{i}" for i in range(10)), "end"]), " ".join(common[::-1])]
        ids, counts = enc.encode(texts)
        want = [enc.model.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        assert len(enc.codes) == enc.known <= 150
    assert all(learned.count(" " + w) == 1 for w in common[1:-1])
    # with nothing but pieces that come again, all are forgotten at the limit
    for n in range(3):
        enc.encode([" ".join(f"all{i}" for i in range(200))] * 2)
    assert len(enc.codes) <= 400


def test_limits_of_all_held_out_rows(spark):
    from netloom.llm import langid

    rng = random.Random(21)
    own = {"aa": ["ka", "li", "mo", "ta", "ne"], "bb": ["st", "er", "un", "gei", "ach"]}
    made = [(_made(rng, own[k] + (["zq", "wy"] if rng.random() < 0.4 else []), rng.randint(20, 40)), k) for k in ["aa", "bb"] * 700]
    docs = spark.createDataFrame([(i, t, k, "s", 0) for i, (t, k) in enumerate(made)], SCHEMA).repartition(3)
    model = langid.train(docs.where("doc_id < 100"))
    rest = docs.where("doc_id >= 100")
    x = {}
    for r in langid.identify(rest, model, keep=["lang"]).where("letters >= 50 and lang = lang_pred").select("lang", langid.excess(model).alias("x")).collect():
        x.setdefault(r["lang"], []).append(r["x"])
    assert min(map(len, x.values())) > 500
    want = {k: min(2 * np.median(x[k]), (np.median(x[k]) + b) / 2) for k, b in zip(model["names"], model["bits"])}
    got = langid.limits(rest, model)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    # under five rows of a language: the median of all rows
    few = rest.where("lang = 'aa' or doc_id < 108")
    every = [r["x"] for r in langid.identify(few, model, keep=["lang"]).where("letters >= 50 and lang = lang_pred").select(langid.excess(model).alias("x")).collect()]
    b = model["bits"][1]
    assert math.isclose(langid.limits(few, model)["bb"], min(2 * np.median(every), (np.median(every) + b) / 2), rel_tol=1e-12)
    assert set(langid.limits(rest.limit(0), model).values()) == {math.inf}


def test_written_tables_free_the_drivers_jvm(spark, monkeypatch):
    from netloom import runtime

    monkeypatch.setattr(runtime, "_LIGHTENED", {}, raising=False)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    before = full()
    out = runtime.stored(spark.range(3), "kept")
    assert full() > before
    assert out.count() == 3
    runtime.discard(out)
    # at most once in some seconds, and the C library's memory too
    assert runtime.lighten(spark) is None
    runtime._LIGHTENED.clear()
    assert runtime.lighten(spark).startswith("Trim native heap")
