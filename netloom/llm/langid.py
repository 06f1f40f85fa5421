"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled texts. A text is
parsed greedily into the longest phrases that occur in a language's sample; the number of
phrases, times the log of the sample's length, estimates the bits that the text takes given
that language. The language that needs the fewest wins; ties go to the smallest name.

Texts are folded: letters are lower-cased, all other runs become one space. They are parsed
whole, in stretches of ``STRETCH`` characters (a phrase does not run over the edge of a
stretch), many stretches at a time. A stretch's end cuts one phrase in two, so a cost is too
high by at most one phrase in ``STRETCH`` letters, for all languages alike.

Letters keep apart: the ``LETTERS`` commonest of the samples (and a to z) have codes, all others
are spelled as UTF-8 bytes; a byte that no sample has begins a phrase in each language.

The samples: spans of at most ``sample_rows`` labelled training rows per language, drawn by a
hash of id and text, of equal length but for shorter texts and ``sample_chars`` characters in
all; with many languages, ``total_chars`` for all of them together, in equal parts (2,000
characters at least). That bounds what the driver gathers and what is broadcast.

Defined results: ``und`` and score 0 if a text is null or has no letter, or if no label was
learned. Null labels teach nothing. Repeated rows and null ids each give a row. Empty tables
give no rows; extra columns are ignored. The score is 1 - best / second best cost (1 with one
language).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import discard, ship, stored
from .workers import held, lean

STRETCH = 256
#: letters with a code of their own; others are spelled as UTF-8 bytes
LETTERS = 120
SPACE, OTHER, PAD = 1, 0, 255


def fold_table(alphabet: str) -> np.ndarray:
    """Code of each code point: letters of the alphabet from 2, other letters 0, the rest 1."""
    codes = {c: i + 2 for i, c in enumerate(alphabet)}
    out = np.full(0x110000, SPACE, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = codes.get(low[0], OTHER)
    return out


def _wide(letters: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of letters beyond the alphabet, one per UTF-8 byte from ``first`` on, and how many each has."""
    kinds, of = np.unique(letters, return_inverse=True)
    low = [np.frombuffer(chr(c).lower()[0].encode("utf-8", "surrogatepass"), np.uint8) for c in kinds.tolist()]
    size = np.array([len(x) for x in low], np.int64)[of]
    out = np.concatenate([low[i] for i in of.tolist()]).astype(np.int64)
    return np.where(out >= 128, out - 128 + first, OTHER).astype(np.uint8), size


def spelled(text: str, table: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """As ``folded``, letters beyond the alphabet written as bytes; and the number of letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = folded(text, table)
    letters = int((codes != SPACE).sum())
    if not (codes == OTHER).any():
        return codes, letters
    wide, size = _wide(points[table[points] == OTHER], first)
    times = np.ones(len(codes), np.int64)
    times[codes == OTHER] = size
    at = np.repeat(codes == OTHER, times)
    codes = np.repeat(codes, times)
    codes[at] = wide
    return codes, letters


def folded(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of a text; runs of non-letters become one."""
    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = codes == SPACE
    return codes[~(gap & np.concatenate([[True], gap[:-1]]))] if len(codes) else codes


def suffix_automaton(codes: np.ndarray, letters: int) -> np.ndarray:
    """Transitions [state, code] of the automaton of all substrings; -1 where there is none. One
    more code, ``letters``, stays in its state."""
    move, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(move), letters + 1), -1, np.int32)
    out[:, letters] = np.arange(len(move))
    for s, m in enumerate(move):
        out[s, list(m)] = list(m.values())
    return out


def _table(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The automaton of a sample with columns for its own codes alone, and the column of each
    code: one without transitions for those that it lacks, the last for PAD."""
    own = np.unique(codes)
    column = np.full(256, len(own), np.int32)
    column[own] = np.arange(len(own))
    column[PAD] = len(own) + 1
    return suffix_automaton(column[codes], len(own) + 1), column


def phrases(stretches: np.ndarray, move: np.ndarray, column: np.ndarray | None = None) -> np.ndarray:
    """stretches: [position, stretch] of codes, PAD beyond the end. Phrases of each stretch.
    column: where in the table each code is, if its columns are not the codes."""
    letters = move.shape[1] - 1
    flat = move.ravel()
    stretches = column[stretches] if column is not None else np.where(stretches == PAD, letters, stretches).astype(np.int32)
    root = flat[: letters + 1].copy()
    root[root < 0] = 0
    state = np.zeros(stretches.shape[1], np.int32)
    count = np.zeros(stretches.shape[1], np.int32)
    for row in stretches:
        to = flat[state * (letters + 1) + row]
        miss = to < 0
        # a phrase ends before a letter that does not go on; the letter begins the next one
        count += miss
        state = np.where(miss, root[row], to)
    return count + 1


def _spans(rows: list[tuple[int, str]], chars: int) -> list[str]:
    """A span of each text, all of one length but for shorter texts, of ``chars`` characters in all."""
    left, span = chars, 0
    for i, n in enumerate(sorted(len(t) for _, t in rows)):
        span = left // (len(rows) - i)
        if n >= span:
            break
        left -= n
    out = []
    for order, t in rows:
        at = (order >> 20) % (len(t) - span + 1) if len(t) > span else 0
        out.append(t[at : at + max(1, span)])
    return out


def train(labelled: DataFrame, sample_rows: int = 200, sample_chars: int = 60_000, total_chars: int = 480_000, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Names, alphabet and one automaton per language, from rows with a label."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n_of = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row per language
    names = sorted(n_of)
    if not names:
        return {"names": [], "alphabet": "", "moves": [], "columns": [], "bits": []}
    chars = max(2_000, min(sample_chars, total_chars // len(names)))
    take = F.create_map(*[F.lit(x) for k, n in n_of.items() for x in (k, min(1.0, 2.0 * sample_rows / n))])
    order = F.xxhash64(F.lit("sample"), id_col, text_col)
    begin = F.expr(f"pmod(`order`, greatest(length(text) - {chars}, 0) + 1) + 1").cast("int")
    draw = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("order"))
    draw = draw.where(F.pmod("order", F.lit(1 << 40)) < F.element_at(take, F.col("lang")) * float(1 << 40))
    draw = draw.select("lang", F.substring("text", begin, F.lit(chars)).alias("text"), "order")
    got: dict[str, list] = {n: [] for n in names}
    for r in draw.toLocalIterator():
        got[r["lang"]].append((r["order"], r["text"]))
    texts = {n: "\n".join(_spans(sorted(v)[:sample_rows], chars)) for n, v in got.items()}
    seen: dict[str, int] = dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 0)
    for t in texts.values():
        for c in t.lower():
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    alphabet = "".join(sorted(sorted(seen, key=lambda c: (-(c < "\x80"), -seen[c], c))[:LETTERS]))
    table = fold_table(alphabet)
    codes = [spelled(texts[n], table, len(alphabet) + 2)[0] for n in names]
    moves, columns = zip(*map(_table, codes))
    bits = [float(np.log2(max(2, len(c)))) for c in codes]
    return {"names": names, "alphabet": alphabet, "moves": list(moves), "columns": list(columns), "bits": bits}


def _costs(texts: list[str | None], model: dict, table: np.ndarray, most: int = 1 << 22):
    """Bits per text and language, letters per text."""
    cost = np.zeros((len(texts), len(model["names"])))
    letters = np.zeros(len(texts), np.int64)
    group, owner, width = [], [], 0

    def flush():
        nonlocal group, owner, width
        if group:
            of = np.array(owner)
            m = np.full((len(group), STRETCH), PAD, np.uint8)
            for i, g in enumerate(group):
                m[i, : len(g)] = g
            m = np.ascontiguousarray(m.T)
            for k, (move, column) in enumerate(zip(model["moves"], model["columns"])):
                np.add.at(cost[:, k], of, phrases(m, move, column) * model["bits"][k])
        group, owner, width = [], [], 0

    for i, t in enumerate(texts):
        codes, letters[i] = spelled(t, table, len(model["alphabet"]) + 2) if t else (np.zeros(0, np.uint8), 0)
        if letters[i]:
            for at in range(0, len(codes), STRETCH):
                group.append(codes[at : at + STRETCH])
                owner.append(i)
                width += STRETCH
                if width >= most:
                    flush()
    flush()
    return cost, letters


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, letters, phrase_bits``; keep: columns to carry along."""
    spark = docs.sparkSession
    ship(spark)
    keep = keep or []
    if "shared" not in model:  # one broadcast a model
        model["shared"] = spark.sparkContext.broadcast(dict(model))
    shared = model["shared"]
    key = hashlib.sha256("".join([model["alphabet"], *model["names"]]).encode()).hexdigest()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])

    def run(batches):
        model = shared.value
        table = held(key, lambda: fold_table(model["alphabet"]))
        names = np.array([*model["names"], "und"], object)
        for b in batches:
            cost, letters = _costs(b.column(1).to_pylist(), model, table)
            n = len(model["names"])
            best = np.argmin(cost, axis=1) if n else np.full(len(letters), 0)
            none = (letters == 0) | (n == 0)
            least = cost.min(axis=1) if n else np.zeros(len(letters))
            other = np.partition(cost, 1, axis=1)[:, 1] if n > 1 else np.full(len(letters), np.inf)
            score = np.where(none, 0.0, 1 - least / np.maximum(other, 1e-9))
            pred = np.where(none, n, best)
            per = least / np.maximum(letters, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[b.column(2 + i) for i in range(len(keep))], pa.array(names[pred], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(letters), pa.array(per)],
                names=["doc_id", *(f"_k{i}" for i in range(len(keep))), "lang_pred", "score", "letters", "phrase_bits"],
            )

    types = dict(docs.dtypes)
    schema = ", ".join([f"doc_id {types['doc_id']}", *(f"`_k{i}` {types[f'_k{i}']}" for i in range(len(keep))), "lang_pred string, score double, letters long, phrase_bits double"])
    out = docs.mapInArrow(lean(run), schema)
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"_k{i}", c)
    return out


def excess(model: dict) -> Column:
    """Bits a letter of the language found, beyond two phrases: a short text says little."""
    bits = F.element_at(F.create_map(*[F.lit(x) for kv in zip(model["names"], model["bits"]) for x in kv]), F.col("lang_pred"))
    return F.greatest(F.lit(0.0), F.col("phrase_bits") - 2 * bits / F.greatest("letters", F.lit(1)))


def _medians(scored: DataFrame, least: int) -> dict[str | None, float]:
    """scored: ``lang, x``. The exact median of each language with ``least`` rows, and of all rows (None):
    rows are counted in bins of 1/1024 first, then values in the bins that hold the middle ones."""
    place = F.floor(F.col("x") * 1024).cast("long")
    bins: dict[str | None, dict[int, int]] = {None: {}}
    for lang, at, n in scored.groupBy("lang", place).count().collect():  # a letter costs some 16 bits at most, so under 2^15 bins a language
        for of in (lang, None):
            bins.setdefault(of, {})[at] = bins.get(of, {}).get(at, 0) + n
    bins = {k: v for k, v in bins.items() if v and (k is None or sum(v.values()) >= least)}
    middle = {}  # the bins that hold the two middle ranks, and the ranks from the first of them on
    for k, v in bins.items():
        ends = np.cumsum([v[b] for b in sorted(v)])
        ranks = [(int(ends[-1]) - 1) // 2, int(ends[-1]) // 2]
        held = [int(np.searchsorted(ends, r, side="right")) for r in ranks]
        first = int(ends[held[0] - 1]) if held[0] else 0
        middle[k] = [sorted(v)[i] for i in held], [r - first for r in ranks]
    wanted = sorted({b for held, _ in middle.values() for b in held})
    got = scored.where(place.isin(wanted)).groupBy("lang", "x").count().collect() if wanted else []  # values of a few bins
    out = {}
    for k, (held, ranks) in middle.items():
        some = sorted((x, n) for lang, x, n in got if (k is None or lang == k) and held[0] <= math.floor(x * 1024) <= held[1])
        ends = np.cumsum([n for _, n in some])
        out[k] = float(np.mean([some[int(np.searchsorted(ends, r, side="right"))][0] for r in ranks]))
    return out


def limits(labelled: DataFrame, model: dict, lang_col: str = "lang", text_col: str = "text") -> dict[str, float]:
    """Per language the most bits a letter, as by ``excess``, of a text in it: twice the median
    of all labelled rows, which the model must not have seen, but at most half way from that to a phrase a
    letter. Languages with under 5 such rows get the median of all; without any, no limit."""
    labelled = labelled.where(F.col(lang_col).isin(model["names"]) & F.col(text_col).isNotNull())
    every = labelled.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    scored = stored(identify(every, model, keep=["lang"]).where("letters >= 50 and lang = lang_pred").select("lang", excess(model).alias("x")), "excess")
    median = _medians(scored, 5)
    discard(scored)
    out = {}
    for n, bits in zip(model["names"], model["bits"]):
        mine = median.get(n, median.get(None))
        out[n] = min(2 * mine, (mine + bits) / 2) if mine is not None else float("inf")
    return out
