"""Operator 6, byte-level BPE with a pair occurrence index.

Texts are cut into pre-tokens; the distinct unseen ones of an Arrow batch are merged together.  Their symbols
lie in one flat array, and an index maps each adjacent pair that has a merge rank to all its positions in the
batch.  Active ranks are applied in ascending order; each merge touches only the lists of the pairs around it.
A merge can only create pairs of a higher rank (they hold a symbol that did not exist before), so one ascending
pass is complete.

Ids of short pre-tokens are kept in tables of the Python worker that are bounded in bytes; they only save work, results don't depend on them.
Texts never leave their partition and are never shuffled.

Defined results
* a null text is empty: no ids, the digest of nothing; an empty table gives no rows;
* the tokenizer's added tokens (``<|endoftext|>``) become their ids wherever they stand in a text;
* rows that repeat an id give a row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from cardloom.llm.unit_cache import Known

# Fixed value: the public byte-level pre-token pattern.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BEFORE_WHITE = re.compile(r" (?=\s|\Z)")


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of the byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairs:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        #: (left id, right id) -> (rank, id of both together)
        self.merges = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in s)
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.pretoken = regex.compile(PRETOKEN)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        #: ids of units at the start of a run, of units after a blank, and of pre-tokens
        self.leading, self.spaced, self.words = Known(), Known(), Known()

    # -- cutting ---------------------------------------------------------------

    def _plain(self, text: str) -> list[str]:
        """Cut at each blank that a character other than white space follows, and drop these blanks.

        The pattern never matches across such a place, and what it matches before or after doesn't depend on the other side: a
        run of white space sees either the blank or the end there, and everything else stops at the blank.
        """
        units = text.split(" ")
        if not BEFORE_WHITE.search(text):
            return units
        out = units[:1]
        for u in units[1:]:
            if u and not u[0].isspace():
                out.append(u)
            else:
                out[-1] += " " + u
        return out

    def cut(self, text: str) -> list[list[str]]:
        """Runs of units; those of a run are joined by blanks, and each is encoded by itself with the blank before it."""
        if self.specials is None or not self.specials.search(text):
            return [self._plain(text)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), [m[0]]]
            at = m.end()
        return [*out, self._plain(text[at:])]

    # -- merging ---------------------------------------------------------------

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers; all are merged in one pass over the ranks."""
        sym: list[int] = []
        ends: list[int] = []
        first = self.first
        for w in words:
            sym += [first[b] for b in w.encode()]
            sym.append(-1)  # no pair crosses it
            ends.append(len(sym))
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        where: dict[int, list[int]] = {}  # rank -> positions of its pair
        pair_of: dict[int, tuple[int, int, int]] = {}
        for i in range(n - 1):
            if (m := merges.get((sym[i], sym[i + 1]))) is not None:
                if m[0] in where:
                    where[m[0]].append(i)
                else:
                    where[m[0]] = [i]
                    pair_of[m[0]] = (sym[i], sym[i + 1], m[1])
        ranks = list(where)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            a, b, new = pair_of[rank]
            places = where.pop(rank)
            if a == b:
                places.sort()  # runs of one symbol are paired from the left
            for i in places:
                if sym[i] != a:
                    continue
                j = after[i]
                if sym[j] != b:
                    continue
                sym[i], sym[j] = new, -2
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                for left, p, q in ((h, sym[h] if h >= 0 else -1, new), (i, new, sym[k])):
                    if (m := merges.get((p, q))) is not None:
                        if m[0] in where:
                            where[m[0]].append(left)
                        else:
                            where[m[0]] = [left]
                            pair_of[m[0]] = (p, q, m[1])
                            heapq.heappush(ranks, m[0])
        out, start = [], 0
        for end in ends:
            out.append(b"".join([s.to_bytes(4, "little") for s in sym[start : end - 1] if s >= 0]))
            start = end
        return out

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        parts = {u: self.pretoken.findall(u) for u in units}
        words = self.words
        unseen = list({w for p in parts.values() for w in p if w not in words})
        new = dict(zip(unseen, self.merge(unseen), strict=True))
        words.learn(new)
        return {u: b"".join([new[w] if w in new else words[w] for w in p]) for u, p in parts.items()}

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        leading, spaced = self.leading, self.spaced
        for held in (leading, spaced, self.words):
            held.trim()
        cut = [self.cut(t) if t else [] for t in texts]
        leading.update((s, i.to_bytes(4, "little")) for s, i in self.added.items())
        first = self._learn({run[0] for c in cut for run in c if run[0] not in leading})
        new = set()
        for c in cut:
            for run in c:
                new.update([u for u in run[1:] if u not in spaced])
        rest = {u[1:]: ids for u, ids in self._learn({" " + u for u in new}).items()}
        out = []
        for c in cut:
            parts = []
            for run in c:
                parts.append(first[run[0]] if run[0] in first else leading[run[0]])
                parts += [rest[u] if u in rest else spaced[u] for u in run[1:]]
            out.append(b"".join(parts))
        leading.learn(first)
        spaced.learn(rest)
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the text; an invalid sequence is replaced as UTF-8 decoders do."""
        out = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out


_CODECS: dict[str, BytePairs] = {}


def codec(path: str) -> BytePairs:
    """The encoder of a file, one for each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = BytePairs(path)
    return _CODECS[path]


#: Characters of text that are encoded together at most, beyond one text.
BATCH_CHARS = 4_000_000


def blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 30) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) of slices that hold about ``BATCH_CHARS`` characters and ``most`` rows at most; nulls are empty."""
    texts, start, held = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        t = x.as_py() or ""
        if texts and (held + len(t) > BATCH_CHARS or len(texts) == most):
            yield start, texts
            texts, start, held = [], i, 0
        texts.append(t)
        held += len(t)
    if texts:
        yield start, texts


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (little-endian
    unsigned 32-bit integers) and the ``decoded`` text."""
    extra = ", ids binary, decoded string" if keep_ids else ""

    def run(batches):
        own = codec(tokenizer)
        for batch in batches:
            for start, texts in blocks(batch, "text"):
                ids = own.encode_batch(texts)
                decoded = [own.decode(x) for x in ids]
                out = {
                    "doc_id": batch.column("doc_id").slice(start, len(texts)),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                }
                if keep_ids:
                    out |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array([x.decode() for x in decoded], pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + extra)


def op6_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, keep_ids=False)
