"""Scores of whole texts under the byte model (context-tree weighting) and a word unigram base.

Words are runs of non-space characters, A-Z lower-cased; each text ends with one end token.
The base gives a token log10((c + 0.5) / (N + 0.5 (V + 1))), c its training count, N all
training tokens, V the distinct ones.

Counts are of all training texts: words are counted in tasks first, then summed by word. The
words that make up at least 1 / ``frequent`` of all tokens each, so at most that many, are
broadcast; all others are joined with the count table by word. Byte contexts are handled
alike: the scores of the ``grams`` commonest grams are broadcast, all others are joined.

Defined results: a null text is scored as an empty one: the end token alone. Repeated rows
and null ids each give a row. Texts of any length are scored whole. With no training rows
every count is 0. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship, stored
from .ctw import Grown, Table, Tree, _pieces, gram_counts, gram_scores, grams

_BATCH = "doc_id {}, row long, n_tokens long, seen long, logs double, score double, symbols long, rare array<binary>, far array<long>"


@dataclass
class Base:
    """counts: ``word binary, n long``; the end token is counted apart."""

    counts: DataFrame
    frequent: dict[bytes, int]
    ends: int
    total: int
    vocabulary: int


def word_base(train: DataFrame, frequent: int = 1 << 18, text_col: str = "text") -> Base:
    ship(train.sparkSession)

    def run(batches):
        held: Counter = Counter()
        docs = 0

        def out():
            words = list(held)
            for i in range(0, len(words), 100_000):
                some = words[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([held[w] for w in some], pa.int64())], names=["word", "n"])
            held.clear()

        for b in batches:
            docs += b.num_rows
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t:
                    held.update(t.lower().split())
                if len(held) > 1_000_000:
                    yield from out()
        yield from out()

    parts = train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    counts = stored(parts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    total = words + ends
    least = max(1, -(-total // frequent))
    most = counts.where(F.col("n") >= least).toArrow()  # at most ``frequent`` rows
    table = dict(zip(most["word"].to_pylist(), most["n"].to_pylist()))
    return Base(counts, table, ends, total, distinct + (ends > 0))


def _common(scored: DataFrame, most: int) -> Table:
    """The scores of the commonest grams, at most ``most``."""
    level = F.floor(F.log2("n") * 8)
    rows = sorted(scored.groupBy(level.alias("level")).count().collect(), reverse=True)  # at most 8 x 64 rows
    least, held = 0, 0
    for r in rows:
        held += r["count"]
        if held > most:
            least = r["level"] + 1
            break
    got = scored.where(level >= least).toArrow()
    n, gram, value = got["n"].to_numpy(), got["gram"].to_numpy().astype(np.uint64), got["score"].to_numpy()
    order = np.lexsort([gram, -n])
    return Table(gram[order], value[order])


def score(docs: DataFrame, tree: Tree | Grown, base: Base, id_col: str = "doc_id", text_col: str = "text", common: int = 1 << 20, counted: bool = False) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score, bits_per_byte``: log10 probabilities, and the
    code length by the byte model, over the bytes of the normalised text and its end. counted: the tree was
    given all of these texts (``ctw.grown`` with ``learn``), so their grams are counted already."""
    spark = docs.sparkSession
    ship(spark)
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = None
    if isinstance(tree, Grown):
        depth = tree.depth
        scored = stored(gram_scores(tree, None if counted else gram_counts(df, depth)), "gram-scores")
        tree = _common(scored, common)
    else:
        depth = len(tree.levels) - 1
    logs = {w: math.log10(n + 0.5) for w, n in base.frequent.items()}
    shared = spark.sparkContext.broadcast((tree, logs, math.log10(base.ends + 0.5), int(base.ends > 0)))

    def run(batches):
        tree, logs, end_log, end_seen = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            n = len(texts)
            total, tokens, seen, sums, rare = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), []
            for i, t in enumerate(texts):
                words = t.lower().split() if t else []
                found = [logs.get(w) for w in words]
                known = [x for x in found if x is not None]
                tokens[i], seen[i], sums[i] = len(words) + 1, len(known) + end_seen, math.fsum(known) + end_log
                rare.append([w for w, x in zip(words, found) if x is None] if len(known) < len(words) else [])
            far: list[list] = [[] for _ in texts]
            symbols = np.zeros(n, np.int64)
            for group in _pieces(texts, depth):
                g, size = grams([p for _, *p in group], depth)
                of = np.array([i for i, *_ in group])
                np.add.at(symbols, of, size)
                values, left = tree.find(g) if isinstance(tree, Table) else (tree.scores(g), np.zeros(0, np.int64))
                np.add.at(total, of, np.add.reduceat(values, np.cumsum(size) - size))
                if len(left):
                    owner = np.repeat(of, size)[left]
                    for i in np.unique(owner).tolist():
                        lo, hi = np.searchsorted(owner, [i, i + 1])
                        far[i].append(g[left[lo:hi]].astype(np.int64))
            far = [np.concatenate(x) if x else [] for x in far]
            rows = np.arange(row, row + n)
            row += n
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, (rows, tokens, seen, sums, total, symbols)), pa.array(rare, pa.list_(pa.binary())), pa.array(far, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n_tokens", "seen", "logs", "score", "symbols", "rare", "far"],
            )

    found = stored(df.mapInArrow(run, _BATCH.format(dict(df.dtypes)["doc_id"])), "scored")
    rare = found.select("row", F.explode("rare").alias("word")).join(base.counts, "word", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs2"))
    norm = math.log10(base.total + 0.5 * (base.vocabulary + 1))
    out = found.drop("rare", "far").join(rare, "row", "left")
    if scored is not None:
        far = found.select("row", F.explode("far").alias("gram")).join(scored.select("gram", F.col("score").alias("more_score")), "gram")
        out = out.join(far.groupBy("row").agg(F.sum("more_score").alias("more_score")), "row", "left")
        out = out.withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    n_known = F.col("seen") + F.coalesce("more", F.lit(0))
    base_score = F.col("logs") + F.coalesce("logs2", F.lit(0.0)) - F.col("n_tokens") * norm
    bits = -F.col("score") * math.log2(10) / F.col("symbols")
    return out.select("doc_id", "n_tokens", n_known.alias("n_known"), base_score.alias("base_score"), "score", bits.alias("bits_per_byte"))
