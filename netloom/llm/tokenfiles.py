"""Token ids in Arrow files with fixed-size-list batches.

Every file holds the ids of a run of documents, in ascending id order, as sequences of
``seq_len`` ids (the last one padded) with a mask of the real ones: record batches of one
fixed-size-list<uint16 or uint32> and one fixed-size-list<bool> column. All batches but the
last hold ``batch_rows`` sequences, so sequence i is row i mod batch_rows of batch i div
batch_rows, and a memory-mapped file gives it without copying. A second file beside it lists
each document's first id and number of ids in the file.

Documents are range-partitioned by id, a partition to a file; texts are shuffled once. A file is written under a name of
the attempt and renamed when complete, so a lost executor or a repeated task leaves whole
files only. Starting points across files follow from the files' totals (a row per file).

Words are encoded once per worker: a text is cut where the vocabulary's own pre-tokenizer
would cut, and the ids of up to ``MEMO_PIECES`` pieces are remembered. When there are more, those
not met again are forgotten (all, if those met again are over half of them), and encoded anew when
they come; that decides the cost only.

Defined results: a null text is encoded as an empty one: the end id alone. Null ids come
first. Rows that repeat an id follow each other in order of their texts. Texts of any length
are encoded whole. An empty table writes no files and gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import chain, repeat
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..runtime import shared_dir, ship
from .workers import held, lean

MEMO_PIECES = 500_000
#: Beyond these characters the pre-tokenizer's classes may differ from Python's.
_PLAIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏА-я]")
#: With any of these inside (or white space at an end) white space doesn't come one at a time.
_GAPS = ("  ", "\n\n", " \n", "\n ", *"\x00\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_CUT = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class _Spelling(dict):
    """Code point to its byte-level spelling, as the pre-tokenizer gives it."""

    def __init__(self, spell):
        self.spell = spell

    def __missing__(self, cp: int) -> str:
        out = self[cp] = self.spell(chr(cp))[0][0]
        return out


class Encoder:
    """Ids of whole texts by the tokenizers library, words remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        cut = self.model.pre_tokenizer
        self.cuts = self.model.normalizer is None and self.model.post_processor is None and "ByteLevel" in type(cut).__name__ and [x for x, _ in cut.pre_tokenize_str(" a, b's\n c")] == ["Ġa", ",", "Ġb", "'s", "Ċ", "Ġc"]
        self.special = [str(t) for t in (x.content for x in self.model.get_added_tokens_decoder().values())]
        self.spelling = _Spelling(cut.pre_tokenize_str)
        self.reset()

    def reset(self):
        self.codes: dict[str, int] = {}
        self.short: dict[str, list[int]] = {}  # ids of words of up to three characters
        self.ids = np.zeros(1 << 16, np.uint32)  # of all known pieces, one after another
        self.starts = np.zeros(1 << 16, np.int64)  # of piece i in ids; piece i + 1 begins where it ends
        self.again = np.zeros(1 << 16, bool)  # piece i was met after the call that learned it
        self.known = 0

    def trim(self) -> None:
        """Forget the pieces that were not met again."""
        keep = np.flatnonzero(self.again[: self.known])
        if 2 * len(keep) > MEMO_PIECES:
            return self.reset()
        old, ids, starts = self.codes, self.ids, self.starts
        self.reset()
        place = np.full(len(starts), -1)
        place[keep] = np.arange(len(keep))
        place = place.tolist()
        self.codes = {p: place[c] for p, c in old.items() if place[c] >= 0}
        sizes = starts[keep + 1] - starts[keep]
        ends = np.cumsum(sizes)
        self._append(ids[np.repeat(starts[keep] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], sizes)

    def _append(self, ids: list[int] | np.ndarray, sizes: list[int] | np.ndarray) -> None:
        at, n = int(self.starts[self.known]), len(ids)
        while at + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.ids[at : at + n] = ids
        self.starts[self.known + 1 : self.known + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.known += len(sizes)

    def plain(self, text: str) -> bool:
        if not self.cuts or any(g in text for g in _GAPS) or text[:1].isspace() or text[-1:].isspace():
            return False
        return (text.isascii() or not _PLAIN.search(text)) and not any(s in text for s in self.special)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.int64) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Keep the ids of new pieces: those of their words, as the model encodes them."""
        ids: list[int] = []
        sizes: list[int] = []
        tokenize, spelling, short, cut = self.model.model.tokenize, self.spelling, self.short, _CUT.findall
        for p in pieces:
            had = len(ids)
            for w in cut(p):
                of = short.get(w)
                if of is None:
                    of = [t.id for t in tokenize(w.translate(spelling))]
                    if len(w) <= 3:
                        short[w] = of
                ids += of
            sizes.append(len(ids) - had)
        self._append(ids, sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if len(self.codes) > MEMO_PIECES:
            self.trim()
        plain = [self.plain(t) for t in texts]
        odd = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        # a space begins the next piece; so does a line end, which then takes the place of a space
        pieces = [(" \x00" + t).replace("\n", " \n").split(" ")[1:] if p and t else [] for t, p in zip(texts, plain)]
        every = list(chain.from_iterable(pieces))
        known = self.codes
        codes = np.fromiter(map(known.get, every, repeat(-1)), np.int64, len(every))
        self.again[codes[codes >= 0]] = True
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            unknown = list({every[i] for i in missing})
            first = self.known
            # \x00: first of a text, without a space before it
            self.learn([x[1:] if x[:1] == "\x00" else x if x[:1] == "\n" else " " + x for x in unknown])
            known.update(zip(unknown, range(first, self.known)))
            codes[missing] = [known[every[i]] for i in missing]
        starts = self.starts
        n_of = (starts[codes + 1] - starts[codes]) if len(codes) else np.zeros(0, np.int64)
        total = int(n_of.sum())
        ends = np.cumsum(n_of)
        ids = self.ids[np.repeat(starts[codes] - (ends - n_of), n_of) + np.arange(total)] if total else np.zeros(0, np.uint32)
        per = np.fromiter(map(len, pieces), np.int64, len(pieces))
        upto = np.concatenate([[0], ends])
        edge = np.concatenate([[0], np.cumsum(per)])
        counts = upto[edge[1:]] - upto[edge[:-1]]
        if all(plain):
            return ids, counts
        cut, out = np.split(ids, np.cumsum(counts)[:-1]), []
        for i, p in enumerate(plain):
            out.append(cut[i] if p else next(odd))
        return np.concatenate(out).astype(np.uint32), np.array([len(x) for x in out], np.int64)


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def _fs(url: str):
    """File system and path of a shared location."""
    from pyarrow import fs

    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    u = urlparse(url)
    return (fs.LocalFileSystem(), u.path) if u.scheme == "file" else fs.FileSystem.from_uri(url)


class _Writer:
    """One file of sequences and its list of documents."""

    def __init__(self, url: str, name: str, seq_len: int, batch_rows: int, wide: bool):
        self.fs, folder = _fs(url)
        self.fs.create_dir(folder, recursive=True)
        self.final = f"{folder}/{name}"
        self.own = f"{folder}/_{name}-{uuid.uuid4().hex}"
        self.len, self.rows, self.kind = seq_len, batch_rows, np.dtype("<u4" if wide else "<u2")
        item = pa.uint32() if wide else pa.uint16()
        self.types = [pa.list_(item, seq_len), pa.list_(pa.bool_(), seq_len)]
        self.schema = pa.schema([("ids", self.types[0]), ("mask", self.types[1])])
        self.to = self.fs.open_output_stream(self.own + ".arrow")
        self.out = pa.ipc.new_file(self.to, self.schema)
        self.buffer, self.held = [], 0
        self.docs, self.n_docs, self.total = [], 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.total + np.cumsum(counts) - counts
        self.docs.append(pa.record_batch([doc_ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "start", "n_tokens"]))
        self.total += len(ids)
        self.n_docs += len(counts)
        self.buffer.append(ids.astype(self.kind))
        self.held += len(ids)
        if self.held >= self.len * self.rows:
            every, block = np.concatenate(self.buffer), self.len * self.rows
            for at in range(0, len(every) - block + 1, block):
                self._batch(every[at : at + block], block)
            rest = every[len(every) // block * block :]
            self.buffer, self.held = [rest], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((ids, mask), self.types)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        rest = np.concatenate(self.buffer) if self.held else np.zeros(0, self.kind)
        if len(rest):
            self._batch(np.concatenate([rest, np.zeros(-len(rest) % self.len, self.kind)]), len(rest))
        self.out.close()
        self.to.close()
        with self.fs.open_output_stream(self.own + ".docs") as f, pa.ipc.new_file(f, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])) as w:
            for b in self.docs:
                w.write_batch(b)
        self.fs.move(self.own + ".docs", self.final + ".docs")
        self.fs.move(self.own + ".arrow", self.final + ".arrow")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, seq_len: int = 2048, batch_rows: int = 64, file_rows: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list]:
    """Write the files; gives their folder and rows of (part, n_docs, n_tokens), in id order."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(1, min(-(-docs.count() // file_rows), 100_000))
    dealt = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        writer, part, enc = None, TaskContext.get().partitionId(), encoder(tokenizer)
        wide = enc.model.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                ids, counts = enc.encode(some.column(1).to_pylist())
                ids = np.insert(ids, np.cumsum(counts), end_id)  # one end id after each document
                writer = writer or _Writer(folder, f"part-{part:06d}", seq_len, batch_rows, wide)
                writer.add(some.column(0), ids, counts + 1)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [writer.n_docs], "n_tokens": [writer.total]})

    made = dealt.mapInArrow(lean(run), "part long, n_docs long, n_tokens long")
    return folder, sorted(made.collect())  # one row per file


def read_sequence(path: str, i: int, batch_rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a file and its mask; the ids are a view into the mapped file."""
    with pa.memory_map(path) as f:
        b = pa.ipc.open_file(f).get_batch(i // batch_rows)
    size = b.column(0).type.list_size
    view = b.column(0).values.to_numpy(zero_copy_only=True)
    at = i % batch_rows * size
    return view[at : at + size], b.column(1).slice(i % batch_rows, 1).flatten().to_numpy(zero_copy_only=False)


def read_tokens(spark, folder: str, parts: list) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows, at = [], 0
    for part, _, n in parts:
        rows.append((part, at))
        at += n
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = _fs(f"{folder}/part-{part:06d}")
                with fs.open_input_file(at + ".docs") as f:
                    index = pa.ipc.open_file(f).read_all()
                local = fs.type_name == "local"
                with pa.memory_map(at + ".arrow") if local else fs.open_input_file(at + ".arrow") as f:
                    data = pa.ipc.open_file(f)
                    got, crcs, have, have_at, ends = -1, [], np.zeros(0, np.uint32), 0, index["n_tokens"].to_numpy()
                    for start, n in zip(index["start"].to_pylist(), ends.tolist()):
                        crc, need = 0, n
                        while need:
                            if start >= have_at + len(have):
                                have_at += len(have)
                                got += 1
                                batch = data.get_batch(got)
                                mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                                have = batch.column(0).values.to_numpy(zero_copy_only=True)[mask]
                                continue
                            some = have[start - have_at : start - have_at + need]
                            crc = zlib.crc32(some.astype("<u4").tobytes(), crc)
                            start, need = start + len(some), need - len(some)
                        crcs.append(crc)
                starts = pa.array(index["start"].to_numpy() + base, pa.int64())
                out = pa.table({"doc_id": index["doc_id"], "start": starts, "n_tokens": index["n_tokens"], "ids_crc32": pa.array(crcs, pa.int64())})
                yield from out.to_batches(max_chunksize=10_000)

    files = spark.createDataFrame(rows, "part long, base long").repartition(len(rows))
    return files.mapInArrow(lean(run), schema)
