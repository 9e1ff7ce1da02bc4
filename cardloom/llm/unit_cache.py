"""Ids of whole texts from a tokenizer that drops white space, by way of distinct units.

Such a tokenizer never joins anything across white space, so a text cut at blanks and line feeds has the ids of its units
one after the other.  Units repeat a lot; each worker keeps the ids of those it has seen, up to a bound, and asks the tokenizers
library only for new ones.  Results don't depend on what is kept.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

#: Bytes that one table of known units may take; then the worker starts it anew.  Units that are longer than ``LONG`` characters, such as whole texts of
#: scripts without blanks, are not kept.
CACHE_BYTES, LONG = 96 << 20, 64
#: Bytes of an entry besides its key and value: the table's slot and two object heads.
ENTRY = 170


class Known(dict):
    """Values of short keys, bounded by the bytes they take."""

    taken = 0

    def learn(self, found: dict[str, bytes]) -> None:
        """Keep what is short enough."""
        kept = found if max(map(len, found), default=0) <= LONG else {k: v for k, v in found.items() if len(k) <= LONG}
        self.taken += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY * len(kept)
        self.update(kept)

    def trim(self, most: int | None = None) -> None:
        if self.taken > (CACHE_BYTES if most is None else most):
            self.clear()
            self.taken = 0

#: A word of precomposed Latin-1 letters, and marks after it that are a pre-token of their own.  Lower case is one letter for one letter here.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|]*)")
#: Bytes of such letters as the byte-level alphabet writes them; printable ones are themselves.
LETTERS = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


#: The marks that may end a simple unit.
MARKS = ".,;:!?#$%&*|"


class Met(Known):
    """Ids of units met so far: a simple one that is new is looked up by its word when it is asked for.  Others are a KeyError."""

    def __init__(self, own: UnitIds):
        self.words, self.merge, self.marks = own.words, own.tokenizer.model.tokenize, {"": b""}
        self.library = own

    def __missing__(self, unit: str) -> bytes:
        word = unit.rstrip(MARKS)
        if not (word.isalpha() and word.isascii()):
            m = SIMPLE.fullmatch(unit)
            if not m:
                raise KeyError(unit)
            word = m[1]
        end, low = unit[len(word) :], word.lower()
        ids = self.words.get(low)
        if ids is None:
            ids = array("I", [t.id for t in self.merge(low if low.isascii() else low.encode().decode("latin-1").translate(LETTERS))]).tobytes()
            if len(low) <= LONG:
                self.words[low] = ids
                self.words.taken += len(low) + len(ids) + ENTRY
        if end:
            if end not in self.marks:
                own = next(iter(self.library._library([end])))
                if len(end) > LONG or len(self.marks) > 10_000:
                    return ids + own
                self.marks[end] = own
            ids += self.marks[end]
        if len(unit) <= LONG:
            self[unit] = ids
            self.taken += len(unit) + len(ids) + ENTRY
        return ids


class UnitIds:
    """Encoder of one tokenizer file."""

    #: Bytes that each of its two tables may take at the start of a batch, where they aren't ``CACHE_BYTES``.
    most: int | None = None

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # does the token end a word?
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known, self.words = Known(), Known()
        #: Does the model alone give what the library gives for words?
        own = ["a", "z", "the", "abcdefghijklmnopqrstuvwxyz", "qzxjkvbpyg", *"ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"]
        self.plain = True
        self.plain = self._words(own) == dict(zip(own, self._library(own), strict=True))
        if self.plain:
            self.known = Met(self)

    def _library(self, units: list[str]) -> Iterable[bytes]:
        for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words: from the file's model itself where nothing before it changes them but the byte-level alphabet, else many in one text, told apart by the tokens that end a word."""
        out: dict[str, bytes] = {}
        if self.plain:
            merge = self.tokenizer.model.tokenize
            return {w: array("I", [t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(LETTERS))]).tobytes() for w in words}
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, starts = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out.update((w, raw[a:b]) for w, a, b in zip(part, starts, starts[1:], strict=False))
            else:
                out.update(zip(part, self._library(part), strict=True))
        return out

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units."""
        other, simple = [], []
        for u in units:
            if m := SIMPLE.fullmatch(u):
                simple.append((u, m[1].lower(), m[2]))
            else:
                other.append(u)
        words = self.words
        new = self._words(list({w for _, w, _ in simple if w not in words}))
        words.learn(new)
        ends = list({m for _, _, m in simple})
        marks = dict(zip(ends, self._library(ends), strict=True))
        found = dict(zip(other, self._library(other), strict=True))
        found.update((u, (new[w] if w in new else words[w]) + marks[m]) for u, w, m in simple)
        return found

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        self.known.trim(self.most)
        self.words.trim(self.most)
        self.known[""] = b""
        get = self.known.get
        at_once = self.known.__getitem__ if self.plain else None
        out, later, new = [], [], set()
        for t in texts:  # each unit is looked up once
            units = (t or "").replace("\n", " ").split(" ")
            if at_once:
                try:
                    out.append(b"".join(map(at_once, units)))
                    continue
                except KeyError:  # some need the library
                    pass
            ids = list(map(get, units))
            try:
                out.append(b"".join(ids))
            except TypeError:  # some are not known yet
                gaps = [(k, u) for k, (u, x) in enumerate(zip(units, ids, strict=True)) if x is None]
                new.update([u for _, u in gaps])
                later.append((len(out), ids, gaps))
                out.append(b"")
        found = self._learn(list(new))
        for i, ids, gaps in later:
            for k, u in gaps:
                ids[k] = found[u]
            out[i] = b"".join(ids)
        self.known.learn(found)
        return out


_ENCODERS: dict[str, UnitIds] = {}


def unit_ids(path: str, most: int | None = None) -> UnitIds:
    """The encoder of a file, one for each Python worker, with tables of ``most`` bytes each."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitIds(path)
    _ENCODERS[path].most = most
    return _ENCODERS[path]
