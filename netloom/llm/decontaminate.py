"""Benchmark decontamination with one Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z lower-cased, words are runs of ASCII
letters and digits and of all other non-ASCII characters. A window is ``window`` consecutive
words of an item; an item of fewer words is one window. Words get numbers, and one automaton
over all windows scans a document's numbers once; a hit's words map back to offsets in the
original text. The automaton's size is bounded: items are taken in blocks of at most
``block_bytes`` of text, one automaton and one pass over the documents for each block (one
block for any usual test set), and passes are merged per document.

Defined results: a null text has no words. An item without words has no window. A null item
id counts and is listed as empty text; items that repeat an id count once. Repeated documents
and null ids each give a row. Texts of any length are scanned whole. Empty tables give no
rows, or no hits; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import row_key, ship, stored
from .workers import held, lean

#: byte to byte: A-Z lowered, letters, digits and non-ASCII bytes kept, all else a space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows_of(items: list[tuple[str | None, bytes | None]], window: int):
    """Word numbers (from 1), and windows as {numbers: list of item positions}."""
    number: dict[bytes, int] = {}
    found: dict[tuple, list[int]] = {}
    for i, (_, text) in enumerate(items):
        w = [number.setdefault(x, len(number) + 1) for x in words_of(text)]
        for j in range(max(1, len(w) - window + 1) if w else 0):
            of = found.setdefault(tuple(w[j : j + window]), [])
            if not of or of[-1] != i:
                of.append(i)
    return number, found


def _automaton(windows: dict):
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, of in windows.items():
        a.add_word(w, (len(w), of))
    if windows:
        a.make_automaton()
    return a


def _scan(docs: DataFrame, items: list[tuple[str | None, bytes | None]], window: int) -> DataFrame:
    """Per document: n_words, hit word ranges [a, b) and their character spans, item ids."""
    number, windows = windows_of(items, window)
    shared = docs.sparkSession.sparkContext.broadcast((number, windows, [x for x, _ in items]))
    key = hashlib.sha256(repr(sorted((x or "", t or b"") for x, t in items)).encode()).hexdigest() + str(window)
    spans = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        number, windows, ids = shared.value
        automaton = held(key, lambda: _automaton(windows))
        get = number.get
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            n_words, hits, named = [], [], []
            for t in texts:
                words = words_of(t)
                n_words.append(len(words))
                ranges, of = [], set()
                if windows and words:
                    for end, (n, at) in automaton.iter(tuple([get(w, 0) for w in words])):
                        of.update(at)
                        a, e = end - n + 1, end + 1
                        if ranges and a <= ranges[-1][1]:
                            ranges[-1][1] = max(e, ranges[-1][1])
                            ranges[-1][0] = min(a, ranges[-1][0])
                            while len(ranges) > 1 and ranges[-2][1] >= ranges[-1][0]:
                                x = ranges.pop()
                                ranges[-1] = [min(ranges[-1][0], x[0]), max(ranges[-1][1], x[1])]
                        else:
                            ranges.append([a, e])
                if ranges:
                    at = [m.span() for m in _WORD.finditer(t.decode())]
                    hits.append([{"a": x, "b": y, "start": at[x][0], "stop": at[y - 1][1]} for x, y in ranges])
                else:
                    hits.append([])
                named.append([ids[i] for i in of])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(hits, spans), pa.array(named, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "item_ids"]
            )

    return docs.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, spans array<struct<a: long, b: long, start: long, stop: long>>, item_ids array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, spans`` (word ranges [a, b) and character offsets) and ``item_ids``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item_id"), F.encode(F.col(item_text_col), "UTF-8").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        return _scan(docs, [tuple(r) for r in items.collect()], window)  # at most block_bytes of text
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    # the passes meet per row: rows that are wholly equal have equal results
    docs = stored(docs.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("row", F.concat(F.coalesce(F.sha2("text", 256), F.lit("null")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "rows")
    passes = [
        stored(_scan(docs.select(F.col("row").alias("doc_id"), "text"), [(r[0], r[1]) for r in items.where(F.col("block") == i).collect()], window), "pass") for i in range(blocks)
    ]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionAll(p)
    every = every.groupBy(F.col("doc_id").alias("row")).agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids")
    )
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<a: long, b: long, start: long, stop: long>>), (acc, s) -> "
        "case when size(acc) > 0 and element_at(acc, -1).b >= s.a then concat(slice(acc, 1, size(acc) - 1), array(named_struct("
        "'a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, s.b), 'start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, s.stop)))) "
        "else concat(acc, array(s)) end)"
    )
    out = docs.drop("text").join(every, "row").withColumn("spans", merged).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("doc_id", "n_words", "spans", "item_ids")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of the item ids, per document."""
    ids = F.array_sort(F.array_distinct(F.transform("item_ids", lambda x: F.coalesce(x, F.lit("")))))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without those that hold a window of a test item. All columns are kept."""
    ship(docs.sparkSession)
    docs = docs.withColumn("_row", row_key(docs))  # ids may be null or shared
    found = contamination(docs, benchmark, window, id_col="_row").where(F.size("spans") > 0).select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(found, "_row", "left_anti").drop("_row")
