"""Operator 3, token counts that follow edits.

A document keeps the lengths and token counts of its pre-tokens in blocks, and a segment tree over the blocks with sums of
characters and of tokens.  An edit descends to the block it touches, cuts pre-tokens anew from ``CONTEXT`` characters before
it until a new boundary falls on an old one behind it, counts the tokens of these few only, and updates the sums above the blocks concerned.
Everything before and behind keeps its counts: a boundary that both versions share divides what the pattern sees.

Defined results
* a null text is empty; positions outside the text are moved to its ends; a null insert is empty, a null edit list or edit does nothing;
* edits of a document apply in order, each to the text that the ones before have left;
* stored counts that don't add up to the text's length are left aside, and the text is cut anew;
* rows that repeat an id are documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.bpe import BytePairs, blocks, codec
from cardloom.llm.unit_cache import CACHE_BYTES, ENTRY, LONG

#: Characters before an edit whose pre-tokens it may change by the pattern's look ahead; added tokens that are longer count with their length.
CONTEXT = 16
#: Pre-tokens in a block.
BLOCK = 64


def pretokens(own: BytePairs, text: str, at: int = 0) -> Iterator[str]:
    """Pre-tokens and added tokens of ``text`` from a boundary on."""
    while True:
        special = own.specials.search(text, at) if own.specials else None
        end = special.start() if special else len(text)
        # the pattern must see the end of this stretch as an end
        for m in own.pretoken.finditer(text, at, end):
            yield m[0]
        if not special:
            return
        yield special[0]
        at = special.end()


class Counter:
    """Tokens of pre-tokens, with the codec's merges; those of short ones are kept, up to a bound in bytes."""

    def __init__(self, own: BytePairs):
        self.own, self.known = own, dict.fromkeys(own.added, 1)
        self.context = max([CONTEXT, *map(len, own.added)])

    def counts(self, parts: list[str]) -> list[int]:
        if len(self.known) * (ENTRY + LONG) > CACHE_BYTES:
            self.known = dict.fromkeys(self.own.added, 1)
        known = self.known
        new = list({w for w in parts if w not in known})  # looks up the parts only; taking keys() away would walk all that is known
        found = {w: len(ids) // 4 for w, ids in zip(new, self.own.merge(new), strict=True)}
        out = [found[w] if w in found else known[w] for w in parts]
        known.update((w, n) for w, n in found.items() if len(w) <= LONG)
        return out


class TokenTree:
    """Segment tree over blocks of pre-tokens of one document."""

    def __init__(self, counter: Counter, text: str, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.counter, self.text = counter, text
        if chars is None or sum(chars) != len(text):
            parts = list(pretokens(counter.own, text))
            chars, tokens = list(map(len, parts)), counter.counts(parts)
        self.recounted = 0
        self._build(chars, tokens)

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.chars = [chars[i : i + BLOCK] for i in range(0, len(chars), BLOCK)] or [[]]
        self.tokens = [tokens[i : i + BLOCK] for i in range(0, len(tokens), BLOCK)] or [[]]
        self.leaves = 1 << (len(self.chars) - 1).bit_length()
        self.char_sum = [0] * self.leaves + [sum(b) for b in self.chars] + [0] * (self.leaves - len(self.chars))
        self.token_sum = [0] * self.leaves + [sum(b) for b in self.tokens] + [0] * (self.leaves - len(self.chars))
        for i in range(self.leaves - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        self.char_sum[i] = self.char_sum[2 * i] + self.char_sum[2 * i + 1]
        self.token_sum[i] = self.token_sum[2 * i] + self.token_sum[2 * i + 1]

    @property
    def total(self) -> int:
        return self.token_sum[1]

    def state(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of all pre-tokens; with the text they give the tree back."""
        return [x for b in self.chars for x in b], [x for b in self.tokens for x in b]

    def _find(self, place: int) -> tuple[int, int]:
        """Block that holds character ``place``, and the place of the block's first character."""
        i, start = 1, 0
        while i < self.leaves:
            i *= 2
            if place >= start + self.char_sum[i] and self.char_sum[i + 1]:
                start += self.char_sum[i]
                i += 1
        return i - self.leaves, start

    def edit(self, start: int, delete: int, insert: str) -> None:
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(delete, 0), len(self.text))
        shift = len(insert) - (stop - start)
        context = self.counter.context
        block, at = self._find(max(0, start - context))
        first = 0
        own = self.chars[block]
        while first < len(own) and at + own[first] <= start - context:
            at += own[first]
            first += 1
        self.text = self.text[:start] + insert + self.text[stop:]

        # new pre-tokens from here until they meet an old boundary behind the edit
        last, after, old = block, first, at
        parts, now = [], at
        ended = False
        for w in pretokens(self.counter.own, self.text, at):
            parts.append(w)
            now += len(w)
            if now < start + len(insert):
                continue
            while old < now - shift:
                if after == len(self.chars[last]):
                    if last + 1 == len(self.chars):
                        break
                    last, after = last + 1, 0
                    continue
                old += self.chars[last][after]
                after += 1
            if old == now - shift and old >= stop:
                ended = True
                break
        if not ended:
            last, after = len(self.chars) - 1, len(self.chars[-1])
        chars, tokens = list(map(len, parts)), self.counter.counts(parts)
        self.recounted += len(parts)
        tail = self.chars[last][after:], self.tokens[last][after:]
        self.chars[block] = self.chars[block][:first] + chars + tail[0]
        self.tokens[block] = self.tokens[block][:first] + tokens + tail[1]
        for b in range(block + 1, last + 1):
            self.chars[b], self.tokens[b] = [], []
        if len(self.chars[block]) > 8 * BLOCK:
            self._build(*self.state())
            return
        touched = set()
        for b in range(block, last + 1):
            self.char_sum[self.leaves + b], self.token_sum[self.leaves + b] = sum(self.chars[b]), sum(self.tokens[b])
            touched.add((self.leaves + b) // 2)
        while touched - {0}:
            for i in touched:
                self._pull(i)
            touched = {i // 2 for i in touched if i > 1}


EDITS = "array<struct<start:bigint,delete:bigint,insert:string>>"


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", keep_state: bool = False) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, n_tokens_edited, n_recounted`` of each document and its list of edits (an ``EDITS`` column).

    ``keep_state`` adds ``text, leaf_chars, leaf_tokens`` after the edits.  An input with ``leaf_chars`` and ``leaf_tokens`` columns starts from these
    instead of cutting the whole text.
    """
    stored = {"leaf_chars", "leaf_tokens"} <= set(docs.columns)
    extra = ", text string, leaf_chars array<int>, leaf_tokens array<int>" if keep_state else ""

    def run(batches):
        counter = Counter(codec(tokenizer))
        for batch in batches:
            for at, texts in blocks(batch, "text"):
                part = batch.slice(at, len(texts))
                edits = part.column("edits").to_pylist()
                leaves = zip(part.column("leaf_chars").to_pylist(), part.column("leaf_tokens").to_pylist(), strict=True) if stored else [(None, None)] * len(texts)
                out = {k: [] for k in ("n_pretokens", "n_tokens", "n_tokens_edited", "n_recounted", "text", "leaf_chars", "leaf_tokens")}
                for text, todo, (chars, tokens) in zip(texts, edits, leaves, strict=True):
                    tree = TokenTree(counter, text, chars, tokens)
                    out["n_pretokens"].append(sum(map(len, tree.chars)))
                    out["n_tokens"].append(tree.total)
                    for e in todo or []:
                        if e and e["start"] is not None:
                            tree.edit(e["start"], e["delete"] or 0, e["insert"] or "")
                    out["n_tokens_edited"].append(tree.total)
                    out["n_recounted"].append(tree.recounted)
                    if keep_state:
                        for k, x in zip(("text", "leaf_chars", "leaf_tokens"), (tree.text, *tree.state()), strict=True):
                            out[k].append(x)
                columns = {"doc_id": part.column("doc_id")} | {k: pa.array(out[k], pa.int64()) for k in ("n_pretokens", "n_tokens", "n_tokens_edited", "n_recounted")}
                if keep_state:
                    columns |= {"text": pa.array(out["text"], pa.string()), "leaf_chars": pa.array(out["leaf_chars"], pa.list_(pa.int32())), "leaf_tokens": pa.array(out["leaf_tokens"], pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_pydict(columns)

    edits = F.col(edits_col).cast(EDITS) if edits_col in docs.columns else F.lit(None).cast(EDITS)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), edits.alias("edits")]
    if stored:
        columns += [F.col("leaf_chars"), F.col("leaf_tokens")]
    return docs.select(*columns).mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint, n_tokens_edited bigint, n_recounted bigint" + extra)


def sample_edits(text: F.Column) -> F.Column:
    """Three edits for each text: a new beginning, a word put in the middle in place of three characters, and a cut of ten near the end."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    one = lambda start, delete, insert: F.struct(start.cast("long").alias("start"), F.lit(delete).cast("long").alias("delete"), F.lit(insert).alias("insert"))
    return F.array(one(F.lit(0), 0, "New: "), one(F.floor(n / 2), 3, " edited's 12"), one(n - 20, 10, ""))


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    """Token counts of all ``documents`` before and after three edits of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs.withColumn("edits", sample_edits(F.col("text"))), tokenizer)
