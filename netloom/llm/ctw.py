"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is normalised (A-Z lower-cased, words joined by single spaces), encoded as bytes and
closed by an end symbol. Each symbol is eight binary decisions; a decision's context is the
bits of the symbol so far and the last 0 to ``depth`` bytes. Every context keeps counts of
zeros and ones and with them a Krichevsky-Trofimov estimate; a context tree mixes the
estimates of all depths, each node weighing its own estimate against its children's product
by the evidence of the training texts:

    P_w(s) = (P_kt(s) + prod over children P_w(c s)) / 2

The training counts are those of all (depth + 1)-grams of bytes of all training texts,
summed by the cluster. Every context that occurs is a context of the tree, at every corpus
size, so what is learned grows with the corpus. The tree stays a table of grams (``grown``):
grams that share their nearest ``CUT`` context bytes form a subtree, subtrees are grown in
tasks and only the levels above them, at most 65,536 contexts a level, are gathered. A
subtree's grams lie in one task's memory. ``gram_scores`` joins the grams to be scored with
their subtree. A document's score is the sum of the log10 probabilities of its symbols under
the trained tree. ``train`` gathers a whole tree, for texts whose grams fit the driver.

Defined results: a null text is scored as an empty one: the end symbol alone. With no
training texts every bit has probability 1/2. A null id is in no training set and not held
out (null). Repeated rows each count and each give a row. Texts of any length are counted and
scored whole. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import ship, stored
from .workers import lean

START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
CHUNK = 1 << 20
#: distinct grams scored at once, and scored grams that a worker keeps
SLICE, KEPT = 1 << 16, 1 << 21
#: nearest context bytes that the grams of a subtree share; grams of subtrees grown at once, if of several
CUT, GROWN = 3, 1 << 18
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def normalised(text: bytes | None) -> bytes:
    return _SPACES.sub(b" ", (text or b"").lower()).strip(b" ")


def grams(parts: list[tuple[bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """parts: (the ``depth`` bytes before, symbols). The (depth + 1)-gram that ends at each
    symbol, oldest byte first, and the number of symbols of each part."""
    joined = np.frombuffer(b"".join(before + d for before, d in parts), np.uint8)
    size = np.array([len(d) for _, d in parts], np.int64)
    g = np.zeros(max(0, len(joined) - depth), np.uint64)
    for i in range(depth + 1):
        g = (g << np.uint64(8)) | joined[i : i + len(g)]
    # positions that end inside the bytes before a part belong to no part
    begin = np.cumsum(size + depth) - (size + depth)
    keep = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return g[keep], size


def _pieces(texts: list[bytes | None], depth: int, most: int = CHUNK):
    """Groups of at most ``most`` symbols of (index of the text, the bytes before, symbols):
    all texts in order, each with its end symbol, long ones cut."""
    group, held = [], 0
    for i, t in enumerate(texts):
        d, at = normalised(t) + bytes([END]), 0
        before = bytes([START]) * depth
        while at < len(d):
            part = d[at : at + most - held]
            group.append((i, before, part))
            before = (before + part)[len(part) :]
            at, held = at + len(part), held + len(part)
            if held == most:
                yield group
                group, held = [], 0
    if group:
        yield group


def gram_counts(texts: DataFrame, depth: int) -> DataFrame:
    """texts: text string. ``gram long, n long`` over all of them, counted in tasks first."""
    return _counted(texts.select("text", F.lit(False).alias("learn")), depth).select("gram", "n")


def _counted(texts: DataFrame, depth: int) -> DataFrame:
    """texts: ``text string, learn boolean``. ``gram long, learnt long, n long``: how often each
    gram occurs in the texts to learn from, and in all."""
    ship(texts.sparkSession)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            keys, learnt, n = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            return (keys[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (learnt, n)))

        def out(k, *n):
            for i in range(0, len(k), 100_000):
                some = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(k[some].view(np.int64)), *(pa.array(x[some]) for x in n)], names=["gram", "learnt", "n"])

        for b in batches:
            learn = b.column(1).fill_null(False)
            for wanted in (True, False):
                some = b.column(0).filter(learn if wanted else pc.invert(learn)).cast(pa.binary()).to_pylist()
                for group in _pieces(some, depth):
                    k, n = np.unique(grams([p for _, *p in group], depth)[0], return_counts=True)
                    n = n.astype(np.int64)
                    held.append((k, n if wanted else np.zeros(len(n), np.int64), n))
                    size += len(k)
                    if size > 3_000_000:
                        held = [merged()]
                        size = len(held[0][0])
                        if size > 1_500_000:
                            yield from out(*held[0])
                            held, size = [], 0
        yield from out(*merged())

    counts = texts.select("text", "learn").mapInArrow(lean(run), "gram long, learnt long, n long")
    return counts.groupBy("gram").agg(F.sum("learnt").alias("learnt"), F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 1/2: Stirling's series beyond 8, the recurrence below."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift = np.where(low, shift - np.log(np.maximum(x, 1e-300)), shift)
        x = np.where(low, x + 1, x)
    s = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + s


def _kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zero + 0.5) + _lgamma(one + 0.5) - 2 * math.lgamma(0.5) - _lgamma(zero + one + 1)


class Tree:
    """Contexts of all depths. Of depth d: sorted node keys (context << 9 | 1 and the bits so
    far), the chance of a one, the weight of the node's own estimate against its children, and
    the chance of a one in the children that are no contexts of their own."""

    def __init__(self, levels: list[tuple[np.ndarray, ...]]):
        self.levels = levels
        self.forget()

    def forget(self) -> None:
        self.kept = np.zeros(0, np.uint64), np.zeros(0)

    def scores(self, gram: np.ndarray) -> np.ndarray:
        """As ``log10``, for any grams; those scored are kept, up to ``KEPT`` of them."""
        gram, where = np.unique(gram, return_inverse=True)
        keys, values = self.kept
        at, hit = self._find(keys, gram)
        out = values[at] if len(keys) else np.zeros(len(gram))
        new = np.flatnonzero(~hit)
        for i in range(0, len(new), SLICE):
            some = new[i : i + SLICE]
            out[some] = self.log10(gram[some])
        if len(new):
            if len(keys) + len(new) > KEPT:
                self.forget()
                keys, values = self.kept
            place = np.searchsorted(keys, gram[new])
            self.kept = np.insert(keys, place, gram[new]), np.insert(values, place, out[new])
        return out[where]

    @staticmethod
    def nodes(gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node keys of one depth with their zeros and ones, from grams of that depth + 1 bytes."""
        context, symbol = (gram >> np.uint64(8)) << np.uint64(9), gram & np.uint64(255)
        keys, zeros, ones = [], [], []
        for bit in range(8):
            key = context | (np.uint64(1 << bit) | (symbol >> np.uint64(8 - bit)) if bit else np.uint64(1))
            one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            keys.append(key)
            zeros.append(np.where(one, 0, n))
            ones.append(np.where(one, n, 0))
        key, zero, one = map(np.concatenate, (keys, zeros, ones))
        order = np.argsort(key, kind="stable")
        key, zero, one = key[order], zero[order], one[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            return key, zero, one
        return key[first], np.add.reduceat(zero, first), np.add.reduceat(one, first)

    @classmethod
    def grown(cls, by_depth: list[tuple[np.ndarray, np.ndarray]]) -> "Tree":
        """by_depth: sorted grams of d + 1 bytes and their counts, for d = 0, 1, ..."""
        return cls(cls.levels_of(by_depth)[0])

    @classmethod
    def levels_of(cls, by_depth: list[tuple[np.ndarray, np.ndarray]], first: int = 0, below: tuple | None = None) -> tuple[list, tuple | None]:
        """Levels ``first``, first + 1, ... and the nodes of level ``first`` (key, log of the
        mixture, zeros, ones); below: those of the level after the last."""
        levels: list = []
        for d in range(first + len(by_depth) - 1, first - 1, -1):
            key, zero, one = cls.nodes(*by_depth[d - first], d)
            pe = _kt(zero, one)
            kids, rest0, rest1, has = np.zeros(len(key)), zero.copy(), one.copy(), np.zeros(len(key), bool)
            if below is not None and len(below[0]):
                at = np.searchsorted(key, below[0] & np.uint64((1 << (8 * d + 9)) - 1))  # without the oldest byte
                np.add.at(kids, at, below[1])
                np.subtract.at(rest0, at, below[2])
                np.subtract.at(rest1, at, below[3])
                has[at] = True
            kids += _kt(rest0, rest1)  # all contexts that are too small share one child
            weight = np.where(has, 1 / (1 + np.exp(np.clip(kids - pe, -700, 700))), 1.0)
            pw = np.where(has, np.logaddexp(pe, kids) - math.log(2), pe)
            levels.append((key, (one + 0.5) / (zero + one + 1), weight, (rest1 + 0.5) / (rest0 + rest1 + 1)))
            below = (key, pw, zero, one)
        return levels[::-1], below

    @staticmethod
    def _find(key: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(key):
            return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return at, key[at] == want

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each (distinct) gram's last byte after the bytes before it.

        Works from the root down, at each depth over the distinct grams of that length whose
        context is still in the tree: ``sum`` is the mixture so far, ``left`` what weight is
        left for greater depths, for each of the eight decisions.
        """
        depth = len(self.levels) - 1
        final = np.full((len(gram), 8), 0.5)
        pos = np.arange(len(gram))  # grams still on their way, and their parents' rows
        total, left, rest = np.zeros((1, 8)), np.ones((1, 8)), np.full((1, 8), 0.5)
        parent = np.zeros(len(gram), np.int64)
        for d in range(depth + 1):
            key, chance, weight, other = self.levels[d]
            short, of = np.unique(gram[pos] & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
            up = np.zeros(len(short), np.int64)
            up[of] = parent
            if d == 0:
                up[:] = 0
            context, symbol = (short >> np.uint64(8)) << np.uint64(9), short & np.uint64(255)
            _, kept = self._find(key, context | np.uint64(1))
            t, r, o = total[up], left[up], rest[up]
            t2, r2, o2 = t.copy(), r.copy(), np.full_like(o, 0.5)
            for bit in range(8):
                node = np.uint64(1 << bit) | (symbol >> np.uint64(8 - bit)) if bit else np.full(len(short), 1, np.uint64)
                at, hit = self._find(key, context | node)
                at, w = (at, np.where(hit, weight[at], 1.0)) if len(key) else (at, np.ones(len(short)))
                own = np.where(hit, chance[at], 0.5) if len(key) else np.full(len(short), 0.5)
                t2[:, bit] += r[:, bit] * w * own
                r2[:, bit] *= 1 - w
                if len(key):
                    o2[:, bit] = np.where(hit, other[at], 0.5)
            # a context that is not in the tree: the parent's pooled child takes what is left
            ended = ~kept[of]
            final[pos[ended]] = (t + r * o)[of[ended]]
            if d == depth:
                final[pos[~ended]] = (t2 + r2 * o2)[of[~ended]]
            pos, parent = pos[~ended], of[~ended]
            total, left, rest = t2, r2, o2
            if not len(pos):
                break
        bits = (gram[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)
        return np.log10(np.where(bits == 1, final, 1 - final)).sum(axis=1)


def _shortened(gram: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the last ``size`` bytes, sorted, and their counts."""
    short, of = np.unique(gram & np.uint64((1 << (8 * size)) - 1), return_inverse=True)
    out = np.zeros(len(short), np.int64)
    np.add.at(out, of, n)
    return short, out


def _by_subtree(grams: DataFrame, cut: int) -> DataFrame:
    part = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * cut)) - 1))
    return grams.withColumn("part", part).repartition("part").sortWithinPartitions("part")


def _subtrees(batches):
    """Columns of rows sorted by the last column, some whole subtrees at a time."""
    held, size = [], 0
    for b in chain(batches, [None]):
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns] if b is not None else None
        if cols is not None:
            held.append(cols)
            size += len(cols[0])
        if not held or (b is not None and size < GROWN):
            continue
        cols = [np.concatenate(x) for x in zip(*held)]
        n = size if b is None else int(np.searchsorted(cols[-1], cols[-1][-1]))
        held, size = ([[c[n:] for c in cols]], size - n) if b is not None else ([], 0)
        if n:
            yield [c[:n] for c in cols]


@dataclass
class Grown:
    """grams: ``gram long, learnt long, n long``: counts of the training texts, and of all texts
    that were given; top: the levels above the subtrees; total: symbols of the training texts."""

    grams: DataFrame
    depth: int
    cut: int
    top: list
    total: int


def grown(texts: DataFrame, depth: int = 5, learn: Column | None = None) -> Grown:
    """The tree of all contexts of the texts, as a table. learn: which rows are training texts, if not all."""
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    counts = stored(_counted(texts.select("text", learn.alias("learn")), depth), "grams")
    total = counts.agg(F.coalesce(F.sum("learnt"), F.lit(0))).first()[0]
    cut = min(CUT, depth)
    learnt = counts.where("learnt > 0").select("gram", F.col("learnt").alias("n"))

    def roots(batches):
        up = np.uint64((1 << (8 * (cut - 1) + 9)) - 1)
        for gram, n, _ in _subtrees(batches):
            gram = gram.astype(np.uint64)
            _, (key, pw, _, _) = Tree.levels_of([_shortened(gram, n, d + 1) for d in range(cut, depth + 1)], cut)
            parent, of = np.unique(key & up, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(parent.astype(np.int64)), pa.array(np.bincount(of, pw))], names=["parent", "pw"])

    by_depth = []
    if cut:
        got = learnt.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * cut)) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most 256^cut rows
        k, n = got["gram"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(np.int64)
        by_depth = [_shortened(k, n, d + 1) for d in range(cut)]
    if not cut:
        return Grown(counts, depth, cut, [], total)
    below = _by_subtree(learnt, cut).mapInArrow(lean(roots), "parent long, pw double").groupBy("parent").agg(F.sum("pw").alias("pw")).toArrow()
    key, pw = below["parent"].to_numpy().astype(np.uint64), below["pw"].to_numpy()
    order = np.argsort(key)
    # of the children only their parents and mixtures count: the rest of each parent is empty
    key, zero, one = key[order], *_zeros_ones(key[order], by_depth[-1], cut - 1)
    return Grown(counts, depth, cut, Tree.levels_of(by_depth, 0, (key, pw[order], zero, one))[0], total)


def _zeros_ones(key: np.ndarray, level: tuple[np.ndarray, np.ndarray], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the nodes of one depth, all of which are given."""
    nodes, zero, one = Tree.nodes(*level, d)
    at = np.searchsorted(nodes, key)
    return zero[at], one[at]


def gram_scores(tree: Grown, grams: DataFrame | None = None) -> DataFrame:
    """grams: ``gram long, n long``, distinct; without them, those of all texts that the tree was
    given. ``gram, n, score``: the log10 probability of each gram's last byte after those before it."""
    ship(tree.grams.sparkSession)
    depth, cut = tree.depth, tree.cut
    shared = tree.grams.sparkSession.sparkContext.broadcast(tree.top)

    def run(batches):
        top = shared.value
        for gram, learnt, n, _ in _subtrees(batches):
            gram = gram.astype(np.uint64)
            old, want = learnt > 0, n > 0
            levels, _ = Tree.levels_of([_shortened(gram[old], learnt[old], d + 1) for d in range(cut, depth + 1)], cut)
            local, want = Tree([*top, *levels]), np.flatnonzero(want)
            for i in range(0, len(want), SLICE):
                some = want[i : i + SLICE]
                yield pa.RecordBatch.from_arrays([pa.array(gram[some].astype(np.int64)), pa.array(n[some]), pa.array(local.log10(gram[some]))], names=["gram", "n", "score"])

    both = tree.grams.select("gram", "learnt", "n")
    if grams is not None:
        zero = F.lit(0).cast("long")
        both = both.select("gram", "learnt", zero.alias("n")).unionAll(grams.select("gram", zero, "n"))
    return _by_subtree(both, cut).mapInArrow(lean(run), "gram long, n long, score double")


class Table:
    """Values of some grams by hash, for grams by the million. Grams given first are placed
    first; those whose ``TRIES`` places are taken are left out."""

    TRIES = 4

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(gram)).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, (1 << 64) - 1, np.uint64), np.zeros(1 << self.bits)
        left = np.arange(len(gram))
        for i in range(self.TRIES):
            at = self._place(gram[left], i)
            free = np.flatnonzero(self.keys[at] == (1 << 64) - 1)
            place, first = np.unique(at[free], return_index=True)
            took = free[first]
            self.keys[place], self.values[place] = gram[left[took]], value[left[took]]
            left = np.delete(left, took)

    def _place(self, gram: np.ndarray, i: int) -> np.ndarray:
        at = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (at + i) & ((1 << self.bits) - 1)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for grams not held) and the indexes of grams not held."""
        at = self._place(gram, 0)
        out = np.where(self.keys[at] == gram, self.values[at], 0.0)
        left = np.flatnonzero(self.keys[at] != gram)
        for i in range(1, self.TRIES):
            at = self._place(gram[left], i)
            hit = self.keys[at] == gram[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit]
        return out, left


def train(texts: DataFrame, depth: int = 5, contexts: int | None = None) -> tuple[Tree, int]:
    """The tree of all texts, gathered whole, and how many symbols they have. contexts: the tree
    ends above contexts that hold less than 1 / contexts of the symbols."""
    counts = stored(gram_counts(texts, depth), "grams")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    floor = max(1, -(-total // contexts)) if contexts else 1
    by_depth = []
    for d in range(depth + 1):
        mask = (1 << (8 * (d + 1))) - 1
        g = counts.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n").alias("n"))
        if d:
            context = F.shiftright("gram", 8)
            large = g.groupBy(context.alias("context")).agg(F.sum("n").alias("m")).where(F.col("m") >= floor).select("context")
            g = g.withColumn("context", context).join(large, "context", "left_semi").select("gram", "n")
        got = g.toArrow()
        k, n = got["gram"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(np.int64)
        order = np.argsort(k)
        by_depth.append((k[order], n[order]))
    return Tree.grown(by_depth), total
