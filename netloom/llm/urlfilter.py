"""URL filter: a blocked Bloom filter of the listed URLs, then an exact hash join.

A listed entry is a canonical ``host/path`` prefix with a verdict; it fits a URL if the URL's
host is the entry's or a subdomain of it and the URL's path starts with the entry's. The filter
holds each entry's host and its host and path: one block of 512 bits per key, ``PROBES`` bits
inside it. A URL's host suffixes are looked up first; URLs of which none passes are done, and
never shuffled. What passes is joined with the listed hosts and the lengths that their paths
have; the prefixes of these lengths alone are looked up again, and what passes is joined with
the list on the whole key, which removes false positives. The longest entry wins.

The filter is broadcast: ``bits_per_key`` bits for each key (12 give about 1 in 200 false
positives), at most ``MOST_BYTES``; a list beyond that (28 million entries) makes for more
false positives, not for other results. Lists and verdicts are joined, never broadcast whole;
hosts and entries that very many URLs share are (``join_skewed``).

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; its path runs from there to ``?``, ``#`` or the end.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no
entry. URLs that fit no entry are allowed. Rows that repeat, and null ids, each give a row. Of
entries listed twice with different verdicts, block holds. An empty table gives no rows, an
empty list allows all; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import join_skewed, ship, stored

PROBES = 6
BLOCK_BITS = 512
MOST_BYTES = 1 << 26


def canonical_parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1))
    path = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(rest, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _places(h: np.ndarray, blocks: int) -> np.ndarray:
    """The bits of each 64-bit hash, all in one block: (n, PROBES)."""
    u = h.astype(np.uint64)
    block = (u >> np.uint64(32)) % np.uint64(blocks)
    low = u & np.uint64(0xFFFFFFFF)
    step = (low >> np.uint64(16)) | np.uint64(1)
    bits = (low[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(BLOCK_BITS)
    return block[:, None] * np.uint64(BLOCK_BITS) + bits


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; all that are in it."""
    at = _places(h, len(words) * 64 // BLOCK_BITS)
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def bloom_filter(keys: DataFrame, blocks: int) -> np.ndarray:
    """keys: h long. Each task sets the bits of its keys; the words that they fall in are joined
    by OR, and the driver gets those that hold a bit, at most the size of the filter."""
    ship(keys.sparkSession)

    def build(batches):
        for b in batches:
            at = np.unique(_places(b["h"].to_numpy(), blocks))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": bits.view(np.int64)})

    got = keys.select("h").mapInPandas(build, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(blocks * BLOCK_BITS // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match(pages: DataFrame, rules: DataFrame, bits_per_key: int = 12, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """rules: ``host string, path string, verdict string``. ``page_id, host, path, rule, verdict``."""
    spark = pages.sparkSession
    ship(spark)
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
    rules = stored(rules.select("host", "path", F.concat("host", "path").alias("rule"), "rule_verdict"), "rules")
    hosts = stored(rules.groupBy(F.col("host").alias("listed")).agg(F.collect_set(F.length("path")).alias("lengths")), "hosts")
    keys = rules.select(F.xxhash64("host", "path").alias("h")).unionAll(hosts.select(F.xxhash64("listed").alias("h")))
    blocks = -(-max(1, keys.count()) * bits_per_key // BLOCK_BITS)
    shared = spark.sparkContext.broadcast(bloom_filter(keys, min(blocks, MOST_BYTES * 8 // BLOCK_BITS)))

    host, path = canonical_parts(F.col(url_col))
    pages = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    pages = pages.withColumn("of", F.when(F.col("host") != "", F.transform(_suffixes(F.col("host")), lambda s: F.xxhash64(s))))

    def listed(batches):
        words = shared.value
        for b in batches:
            of = b.column(3)
            hit = passes(words, of.flatten().to_numpy())
            owner = of.value_parent_indices().to_numpy()
            maybe = np.zeros(b.num_rows, bool)
            maybe[owner[hit]] = True
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(maybe)], names=["page_id", "host", "path", "maybe"])

    pages = stored(pages.mapInArrow(listed, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, maybe boolean"), "urls")
    key = F.concat("host", "path").alias("url")  # a host has no slash, a path begins with one
    seen = pages.where("maybe").select("host", "path", key).distinct()
    tries = seen.select("url", "path", F.explode(_suffixes(F.col("host"))).alias("listed"))
    tries = join_skewed(tries, hosts, "listed")
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    tries = tries.select("url", "listed", F.explode(starts).alias("p"))

    @F.pandas_udf("boolean")
    def known(h: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, h.to_numpy(np.int64)))

    tries = stored(tries.where(known(F.xxhash64("listed", "p"))).select("url", F.concat("listed", "p").alias("rule"), F.length("listed").alias("n")), "tries")
    hits = join_skewed(tries, rules.select("rule", "rule_verdict"), "rule")
    found = hits.groupBy("url").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "n")).alias("best"))
    found = stored(seen.select("url").join(found, "url", "left"), "verdicts")
    rows = join_skewed(pages.where("maybe").select("page_id", "host", "path", key), found, "url").select("page_id", "host", "path", "best")
    done = pages.where("not maybe").select("page_id", "host", "path", F.lit(None).cast(dict(found.dtypes)["best"]).alias("best"))
    out = rows.unionByName(done)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"))
