"""Operator 12, periodic runs by the runs theorem.

A run is a stretch of words with smallest period ``q`` that no neighbour extends; what is reported has ``max(24, 3 q)`` words or more.  By the theorem
each run holds a Lyndon root of its period, under the order of words or the inverted one, that is the *longest* Lyndon word at its place.  These longest
words end where the next smaller (next greater, for the inverted order) value of the inverse suffix array stands, so there are two candidates for each place:

1. Words are numbered; texts of a block lie one behind the other, each with a mark of its own at the end, so no comparison leaves a text.
2. The suffix array comes from prefix doubling that sorts only what is still tied, the LCP array from the ranks of the rounds.
3. Next smaller and greater values come from tables of minima and maxima over powers of two, all places at once.
4. Each candidate is extended to the right by the LCP of its place and the one a period on (sparse-table minimum over the LCP array), to the left in the same way on the
   reversed texts.  What is long enough is a run; a run that several roots give counts once.

A text in which no 16 words in a row come twice has no such run and is left out before step 2 (``length - q`` words repeat at distance ``q``, at least 16).

Texts stay in their rows and partitions: no shuffle, whatever is hot.  Memory is that of a block of about ``BLOCK`` characters or of one longer text, some 4 bytes for each word and round
(rounds: the binary logarithm of the longest repeat).

Defined results
* a null or empty text has no word and no run;
* rows that repeat an id are read one by one; a null id is kept, and nothing is planted in its text;
* an empty table gives no rows; other columns are ignored by :func:`digests` and :func:`runs`, carried by :func:`collapse`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words in a row that a run repeats at the distance of its period, at least.
REPEATED = 16
#: Characters of texts that are read at a time.
BLOCK = 1_500_000


class Numbers(dict):
    """A number for each word, given when it is met first."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass(slots=True)
class Suffixes:
    """Suffix order of ``symbols``: the inverse suffix array and, over powers of two, minima of the LCP of neighbours."""

    rank: np.ndarray
    least: list[np.ndarray]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``x`` and ``y``, two different places."""
        a, b = self.rank[x], self.rank[y]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(x), np.int64)
        # beyond the table lie suffixes of different texts
        for k in np.unique(level[level < len(self.least)]):
            at = np.flatnonzero(level == k)
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] + 1 - (1 << int(k))])
        return out


def powers(values: np.ndarray, levels: int, pick: np.ufunc) -> list[np.ndarray]:
    """``pick`` over stretches of 1, 2, 4, ... values from each place on; a stretch that would pass the end is that of its first half."""
    out = [values]
    for k in range(levels - 1):
        half, last = 1 << k, out[-1]
        more = last.copy()
        more[:-half] = pick(last[:-half], last[half:])
        out.append(more)
    return out


def suffixes(symbols: np.ndarray, longest: int) -> Suffixes:
    """Suffix order of ``symbols``, which end in a mark that comes once and hold no repeat of more than ``longest`` places."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    own = symbols[order]
    slots, rounds, half = np.arange(n), [], 1
    rank = np.empty(n, np.int32)
    while True:
        new = np.append(True, own[1:] != own[:-1])
        start = slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        rank = rank.copy()
        rank[order[slots]] = start
        rounds.append(rank)
        tied = ~(new & np.append(new[1:], True))
        slots = slots[tied]
        if not len(slots):
            break
        at = order[slots]
        own = rank[at].astype(np.int64) * n + rank[np.minimum(at + half, n - 1)]
        turn = np.argsort(own, kind="stable")
        order[slots], own = at[turn], own[turn]
        half *= 2
    x, y = order[:-1], order[1:]
    common = np.zeros(n, np.int32)
    pairs = np.flatnonzero(rounds[0][x] == rounds[0][y])
    x, y, got = x[pairs], y[pairs], np.zeros(len(pairs), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        same = rounds[k][x + got] == rounds[k][y + got]
        got += np.where(same, 1 << k, 0)
    common[pairs + 1] = got
    return Suffixes(rank, powers(common, max(1, int(longest).bit_length()), np.minimum))


def next_beyond(values: np.ndarray, ends: np.ndarray, smaller: bool, levels: int) -> np.ndarray:
    """For each place the next one with a smaller (greater) value, or ``ends``, the end of its text."""
    pick, beyond = (np.minimum, np.greater) if smaller else (np.maximum, np.less)
    at = np.arange(1, len(values) + 1)
    for k, table in reversed([*enumerate(powers(values, levels, pick))]):
        inside = at + (1 << k) <= ends
        step = inside & beyond(table[np.minimum(at, len(values) - 1)], values)
        at += np.where(step, 1 << k, 0)
    return np.minimum(at, ends)


def repeats(codes: list[np.ndarray]) -> np.ndarray:
    """Which of the texts may have ``REPEATED`` words in a row twice: no false no, a false yes by a hash's chance only."""
    sizes = np.array([len(c) for c in codes])
    text = np.repeat(np.arange(len(codes)), sizes)
    h = np.concatenate(codes).astype(np.uint64) + np.uint64(1)
    size = 1
    while size < REPEATED:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[size:] if len(h) > size else h[:0]
        size *= 2
    out = np.zeros(len(codes), bool)
    own = text[: len(h)]
    inside = own == text[REPEATED - 1 :][: len(h)]
    h, own = h[inside] ^ (own[inside].astype(np.uint64) * np.uint64(0x94D049BB133111EB)), own[inside]
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    same = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    out[own[1:][same]] = True
    return out


def runs_of(codes: list[np.ndarray]) -> list[np.ndarray]:
    """``start, length, period`` of the runs of each text of numbered words, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(codes)
    long = [i for i, c in enumerate(codes) if len(c) >= LEAST_WORDS]
    if long:
        may = repeats([codes[i] for i in long])
        long = [i for i, m in zip(long, may) if m]
    if not long:
        return out
    # each text's words and its mark are numbers of its own, the mark the smallest
    sizes = np.array([len(codes[i]) for i in long])
    width = max(int(codes[i].max()) for i in long) + 2
    symbols = np.concatenate([x for k, i in enumerate(long) for x in (codes[i] + (k * width + 1), [k * width])]).astype(np.int64)
    n, longest = len(symbols), int(sizes.max()) + 1
    levels = longest.bit_length()
    bounds = np.append(0, np.cumsum(sizes + 1))
    ends = np.repeat(bounds[1:] - 1, sizes + 1)
    ahead = suffixes(symbols, longest)
    back = suffixes(np.append(symbols[-2::-1], symbols[-1]), longest)
    place = np.delete(np.arange(n), bounds[1:] - 1)
    found = []
    for smaller in (True, False):
        period = next_beyond(ahead.rank, ends, smaller, levels)[place] - place
        fits = (place + period < ends[place]) & (LEAST_TIMES * period <= ends[place] - bounds[:-1].repeat(sizes))
        x, q = place[fits], period[fits]
        right = ahead.common(x, x + q)
        # what is missing must lie to the left
        some = (right > 0) | (symbols[x - 1] == symbols[x + q - 1])
        x, q, right = x[some], q[some], right[some]
        left = back.common(n - 1 - x, n - 1 - x - q)
        length = left + q + right
        long_enough = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * q)
        found.append(np.stack([x - left, length, q], 1)[long_enough])
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    every = every[np.append(True, (every[1:] != every[:-1]).any(1))[: len(every)]]
    cuts = np.searchsorted(every[:, 0], bounds)
    for k, i in enumerate(long):
        own = every[cuts[k] : cuts[k + 1]].copy()
        own[:, 0] -= bounds[k]
        out[i] = own
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic rest, in texts whose id's checksum ends in 0."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    rest = words[a : a + p]
    return words[:a] + (rest * ((n - a) // p + 1))[: n - a]


def dropped(n: int, own: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, own[:, 0] + own[:, 2], 1)
    np.add.at(change, own[:, 0] + own[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def strongest(own: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exact share of length and period; of equal ones the first, then the one of smaller period."""
    best = None
    for start, length, period in own.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def read(batch: pa.RecordBatch, planted: bool = False) -> Iterator[tuple[int, list[list[bytes]], list[np.ndarray]]]:
    """(offset, words, runs) of blocks of a batch's texts."""
    texts, ids = batch.column("text"), batch.column("doc_id").to_pylist() if planted else None
    start = 0
    while start < len(texts):
        numbers, words, codes, held, at = Numbers(), [], [], 0, start
        while at < len(texts) and (at == start or held < BLOCK):
            text = texts[at].as_py() or ""
            own = words_of(text)
            words.append(plant(ids[at], own) if planted else own)
            codes.append(np.fromiter(map(numbers.__getitem__, words[-1]), np.int64, len(words[-1])))
            held += len(text)
            at += 1
        yield start, words, runs_of(codes)
        start = at


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, period`` of every run."""

    def run(batches):
        for batch in batches:
            for at, words, found in read(batch):
                row = np.repeat(np.arange(at, at + len(found)), [len(f) for f in found])
                own = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *map(pa.array, own.T)], ["doc_id", "start", "length", "period"])

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, period bigint")


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that have runs replaced by their kept words, joined by one blank; other texts stay as they are."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            new = []
            for at, words, found in read(batch):
                for k, own in enumerate(found):
                    gone = dropped(len(words[k]), own)
                    new.append(b" ".join(w for w, g in zip(words[k], gone) if not g).decode() if len(own) else texts[at + k].as_py())
            yield pa.RecordBatch.from_arrays([*(c if n != "text" else pa.array(new, pa.string()) for n, c in zip(batch.schema.names, batch.columns))], batch.schema.names)

    # by place, so that no name of another column clashes
    names = docs.columns
    plain = docs.toDF(*["text" if n == text_col else f"c{i}" for i, n in enumerate(names)])
    return plain.mapInArrow(run, plain.schema).toDF(*names)


DIGESTS = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """One row per document: number of runs, the strongest one, and checksums of all runs and of the text without repeats."""

    def run(batches):
        for batch in batches:
            for at, words, found in read(batch, planted):
                best = [strongest(f) for f in found]
                lines = ["".join(f"{a},{b},{c}\n" for a, b, c in f.tolist()) for f in found]
                kept = []
                for own, f in zip(words, found):
                    gone = dropped(len(own), f) if len(f) else None
                    kept.append(hashlib.sha256(b" ".join(own if gone is None else [w for w, g in zip(own, gone) if not g])).hexdigest())
                part = lambda k: pa.array([b and b[k] for b in best], pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(at, len(found)),
                        "n_runs": pa.array([len(f) for f in found], pa.int64()),
                        "start": part(0),
                        "length": part(1),
                        "period": part(2),
                        "exponent_milli": pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                        "runs_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines], pa.string()),
                        "collapsed_sha256": pa.array(kept, pa.string()),
                    }
                )

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, DIGESTS)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, with the repeats that the contract plants."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted=True)
