"""SimHash near-duplicates found through pivot distance tables.

Every distinct fingerprint has a table of Hamming distances to fixed reference fingerprints: the
zero fingerprint, the 64 with one bit set, and ``FAR`` spread over the space. Two fingerprints at
most ``radius`` apart differ by at most ``radius`` in each coordinate (triangle inequality).
Relative to the first coordinate, those of the one-bit references say which bits are set, so for
making candidates they are taken as bits: of ``radius + 2`` bands of bits at least two agree, and
fingerprints that share two bands form a cell. The distances to the spread references are kept
as numbers: a pair of a cell is discarded by its largest difference over them, and survivors are
verified by their Hamming distance.

A cell with more than ``cell_rows`` members is divided again by the same rule over its
remaining bits, up to twice, so that no link is lost and no large cell is compared pairwise as
a whole. With a radius of 2 or less only 8 bits are open then, so no cell stays large; with 3
there are 14, and cells that stay large are joined over tasks (``_pairs``). Equal fingerprints count once: copies are never paired. Within a cell a
pair is given only if no links given before join it, so groups don't grow into all their pairs.

Defined results: a null text has no words, as an empty one, and gets fingerprint zero, linked
like any other. Repeated rows and rows that share an id each give a row. A null id takes part
with its text, but never serves as a component's id unless all ids there are null. Texts of
any length are hashed whole, in pieces. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import components
from ..runtime import discard, join_skewed, ship, stored
from . import jaccard
from .workers import lean

FAR = 16
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def far_references(n: int = FAR) -> list[int]:
    """Reference fingerprints by a rule: successive outputs of the SplitMix64 generator."""
    out, state = [], 0
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return out


def _pieces(text: bytes, size: int = 1 << 20):
    """Lists of words, a piece of the text at a time, cut at white space."""
    if len(text) <= size:
        yield text.split()
        return
    at, rest = 0, b""
    while at < len(text):
        part = rest + text[at : at + size]
        at += size
        words = part.split()
        rest = b""
        if at < len(text) and words and not part[-1:].isspace():
            rest = words.pop()
        if len(rest) > size:  # one endless word: gather it whole
            end = at
            while end < len(text) and not text[end : end + 1].isspace():
                end += 1
            rest, at = rest + text[at:end], end
            if at >= len(text):
                words.append(rest)
        yield words


def simhash(text: bytes | None, shingle: int, seed: int) -> int:
    """The 64-bit fingerprint of one text, as a signed long."""
    from functools import partial

    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    votes, total, tail, words = np.zeros(64, np.int64), 0, [], []
    for piece in _pieces((text or b"").lower()):
        words = tail + piece
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            n = len(words) - shingle + 1
            h = np.fromiter(map(digest, grams), np.uint64, n)
            for i in range(0, n, 1 << 16):
                bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes += bits.sum(axis=0, dtype=np.int64)
            total += n
            tail = words[n:] if shingle > 1 else []
        else:
            tail = words
    if not total:
        if not tail:
            return 0
        h = np.array([digest(b" ".join(tail))], np.uint64)
        votes, total = np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, kinds: dict[str, tuple[int, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long`` and one long per entry of kinds (name: (words in a shingle, seed))."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            found = [pa.array([simhash(t, *how) for t in texts], pa.int64()) for how in kinds.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), *found], names=["doc_id", *kinds])

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in kinds)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def _bands(bits: list[int], radius: int) -> list[int]:
    """Masks of two bands each, of radius + 2 bands of the given coordinates."""
    n = radius + 2
    cut = [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]
    return [sum(1 << b for b in x + y) for x, y in combinations(cut, 2)]


def _table(fp: Column) -> list[Column]:
    """Distances to the spread references, one byte each, eight to a long."""
    near = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(r)))).cast("long") for r in far_references()]
    return [sum((F.shiftleft(d, 8 * i) for i, d in enumerate(near[j : j + 8])), F.lit(0).cast("long")).alias(f"t{j // 8}") for j in range(0, FAR, 8)]


def _forest(radius: int, limits: dict[str, int]):
    """Over rows in order of (cell, key): links that join all linked members of each cell. Pairs
    are compared at growing offsets, many cells at a time; a pair whose members are joined
    already gives no row, so a cell gives fewer links than it has members."""
    width = len(limits)

    def joined(cols: list[np.ndarray], ends: np.ndarray, starts: np.ndarray):
        node, fp, t0, t1, *more = cols
        fp, more = fp.view(np.uint64), [x.view(np.uint64) for x in more]
        tables = np.stack([t0, t1], axis=1).view(np.int8)  # FAR distances, one byte each
        root, out = np.arange(len(node)), []
        left, d = np.arange(len(node)), 1
        while len(left := left[left + d < ends[left]]):
            i, j = left, left + d
            keep = np.abs(tables[i] - tables[j]).max(axis=1) <= radius  # the largest coordinate difference
            i, j = i[keep], j[keep]
            keep = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (root[i] != root[j])
            for x, most in zip(more, limits.values()):
                keep &= np.bitwise_count(x[i] ^ x[j]) <= most
            for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                lo, hi = root[x], root[y]
                if lo != hi:
                    part = root[starts[x] : ends[x]]
                    part[part == hi] = lo
                    out.append((x, y))
            d += 1
        at = np.array(out, np.int64).reshape(-1, 2)
        return node[at[:, 0]], node[at[:, 1]]

    def run(batches):
        rest = None  # the last cell of a batch may go on in the next one
        for b in chain(batches, [None]):
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns] if b is not None else None
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)] if cols else rest
            if not cols or not len(cols[0]):
                continue
            cell, key = cols[4 + width], cols[5 + width]
            first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])]))
            n = len(cell) if b is None else int(first[-1])
            rest = None if b is None else [x[n:] for x in cols]
            if n:
                sizes = np.diff(np.append(first[first < n], n))
                starts = np.repeat(first[first < n], sizes)
                u, v = joined([x[:n] for x in cols[: 4 + width]], np.repeat(first[first < n] + sizes, sizes), starts)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return run


def _cells(nodes: DataFrame, radius: int, extra: list[str], cell_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Members of cells of at most ``cell_rows``, and those of cells still larger after the last division."""
    base = stored(nodes.select("node", "fp", *extra, *_table(F.col("fp"))), "pivots")
    masks = _bands(list(range(64)), radius)
    parents = [0] * len(masks)
    cells, done, dense, first = base.withColumn("parent", F.lit(0)), [], None, 0
    for level in range(3):
        kids = nodes.sparkSession.createDataFrame(
            [(p, first + i, _signed(m)) for i, (m, p) in enumerate(zip(masks, parents))], "parent int, cell int, mask long"
        )  # a fixed table: its size depends on the radius alone
        cells = cells.join(F.broadcast(kids), "parent")
        cells = cells.select("node", "fp", "t0", "t1", *extra, "cell", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        full = cells.groupBy("cell", "key").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("cell", "key")
        full = stored(full, "full-cells")
        if full.isEmpty():
            done.append(cells)
            break
        done.append(cells.join(full, ["cell", "key"], "left_anti").select(cells.columns))
        divided = stored(cells.join(full, ["cell", "key"], "left_semi").select(cells.columns), "divided")
        if level == 2:
            dense = divided
            break
        cells = divided.withColumnRenamed("cell", "parent").drop("key")
        grown = [(_bands([b for b in range(64) if not m >> b & 1], radius), first + i, m) for i, m in enumerate(masks)]
        first += len(masks)
        masks, parents = [m | x for xs, _, m in grown for x in xs], [p for xs, p, _ in grown for _ in xs]
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionAll(more)
    return rows, dense


def _pairs(cells: DataFrame, radius: int, limits: dict[str, int]) -> DataFrame:
    """All links within cells, by a join: no task holds a cell as a whole."""
    a, b = cells.alias("a"), cells.alias("b")
    close = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node"))
    for t in ("t0", "t1"):
        for i in range(8):
            x, y = ((F.shiftright(F.col(f"{s}.{t}"), 8 * i)).bitwiseAND(F.lit(127)) for s in "ab")
            close &= F.abs(x - y) <= radius
    for c, most in {"fp": radius, **limits}.items():
        close &= F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) <= most
    return a.join(b, close).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def links(nodes: DataFrame, radius: int = 2, limits: dict[str, int] | None = None, cell_rows: int = 2048) -> DataFrame:
    """nodes: ``node long, fp long``, and a long for each entry of limits (name: bits).

    ``u long, v long``: all links, that is pairs of nodes whose fingerprints differ in at most
    ``radius`` bits and those of limits in at most so many. Repeats are possible.
    """
    limits = limits or {}
    rows, dense = _cells(nodes, radius, list(limits), cell_rows)
    return _pairs(rows if dense is None else rows.unionAll(dense), radius, limits)


def joining_links(nodes: DataFrame, radius: int = 2, limits: dict[str, int] | None = None, cell_rows: int = 2048) -> DataFrame:
    """As ``links``, but only some of them: the ends of each link left out are joined by links
    that are given. That is enough for components, and a group doesn't grow into all its pairs."""
    limits = limits or {}
    ship(nodes.sparkSession)
    rows, dense = _cells(nodes, radius, list(limits), cell_rows)
    rows = rows.repartition("cell", "key").sortWithinPartitions("cell", "key")
    found = rows.mapInArrow(lean(_forest(radius, limits)), "u long, v long")
    return found if dense is None else found.unionAll(_pairs(dense, radius, limits))


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, fp long, component_id long``, one row per input row."""
    prints = stored(fingerprints(docs, {"fp": (shingle, seed)}, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.col("fp"))
    found = components(joining_links(nodes, radius))
    of = join_skewed(found, nodes.select("node", "low"), "node")
    names = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = join_skewed(found, names, "root").select("node", "component_id")
    nodes = nodes.join(of, "node", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return join_skewed(prints, stored(nodes, "classes"), "fp").select("doc_id", "fp", "component_id")


def near_copies(rows: DataFrame, least: float = 0.8, size: int = 5, radius: int = 3) -> DataFrame:
    """rows: ``key long, text string``. ``key long, component long``: the components of all pairs
    whose sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more.

    First fingerprints of these shingles at most ``radius`` bits apart are found by the pivot
    tables; a surviving pair is verified by its sets. Pairs at the similarity of 0.8 differ in
    about 10 of 64 bits, 16 at times, where pivots discard next to nothing and cells of common
    bands hold nearly all pairs; so the others are found by their shingles (``jaccard``), exactly:
    those with the most copied member of a cell and neighbours together with the first, then all
    that are still apart.

    Null and empty texts have no shingles and are copies of each other. Rows with equal sets count
    once. An empty table gives no rows. Equal keys must have equal texts.
    """
    ship(rows.sparkSession)
    common = jaccard.common_shingles(rows, size)
    found = stored(jaccard.prefixes(rows, size, least, common), "prefixes")
    facts = found.groupBy("node").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size"), F.min("fp").alias("fp"))
    facts = stored(facts, "nodes")
    reps = found.select("key", "node", "sketch", "first").join(facts.select(F.col("rep").alias("key"), "node"), ["key", "node"], "left_semi").dropDuplicates(["key"])
    reps = stored(reps.select("node", "sketch", "first"), "sets")
    keys = stored(found.select("key", "node"), "keys")
    discard(found)
    members = stored(jaccard.cells(reps), "cells")
    if members.isEmpty():
        return keys.select("key", F.col("node").alias("component"))
    facts_of = facts.select("node", "size", "copies").join(reps.select("node", "sketch"), "node")

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "candidates")
        ends = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()
        wanted = facts.select("node", F.col("rep").alias("key")).join(ends, "node", "left_semi")
        texts = stored(rows.join(wanted, "key").dropDuplicates(["key"]).select("node", "text"), "texts")
        out = stored(jaccard.verified(pairs, texts, least, size), "similar")
        discard(pairs, texts)
        return out

    near = joining_links(facts.where("size > 0").select("node", "fp").join(members.select("node").distinct(), "node", "left_semi"), radius)
    near = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    members = members.join(facts_of, "node")
    links = similar(near.unionByName(jaccard.candidates(members.withColumn("root", F.col("node")), least, False)).distinct())
    roots = components(links)
    apart = members.join(roots.select("node", F.col("root").alias("of")), "node", "left").withColumn("root", F.coalesce("of", "node"))
    more = similar(jaccard.candidates(apart, least, True))
    if not more.isEmpty():  # they join what the roots stand for
        of = facts.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        u, v = of.select(F.col("node").alias("u"), F.col("root").alias("ru")), of.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        joined = components(more.join(u, "u").join(v, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")))
        joined = joined.select(F.col("node").alias("root"), F.col("root").alias("of"))
        roots = join_skewed(of, of.select("root").distinct().join(joined, "root", "left").select("root", F.coalesce("of", "root").alias("of")), "root").select("node", F.col("of").alias("root"))
    roots = stored(facts.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component")), "roots")
    return join_skewed(keys, roots, "node").select("key", "component")
