"""Operator 5, token ids as packed binary rows: best-fit-decreasing with a segment tree over capacities.

Each task packs the texts it reads, a block of about ``BLOCK_TOKENS`` tokens at a time: no token is shuffled, memory is bounded by the block,
and a task that is lost is run again on its own input alone.  Pieces of a block are placed by descending length into the fullest row that takes them; the
row is found in a segment tree over capacities, whose leaf ``c`` says whether an open row has room ``c``.  Overlong documents are cut into pieces of a
full row and a remainder; nothing is dropped.

A packed row has the ids (little-endian, two bytes each where the vocabulary allows, else four; padded), the cumulative segment lengths, and position ids
that restart at 0 with each segment.

Defined results
* a null or empty text is a segment that holds the end token alone; rows that repeat an id are segments each;
* ``row_id`` counts from the partition's number times 2^33; it is unique, and stable for the same input files;
* an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.bpe import blocks
from cardloom.llm.unit_cache import unit_ids

LENGTH = 2048
BLOCK_TOKENS = 2_000_000
PAD = 0


class CapacityTree:
    """Counts of open rows by capacity 0..length, with the smallest capacity of at least ``c`` in O(log length)."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def at_least(self, capacity: int) -> int | None:
        i = self.leaves + capacity
        if self.count[i]:
            return capacity
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # a left child whose sibling has rows
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.count[2 * i])
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows of places in ``lengths``; each row's lengths sum to at most ``length``."""
    tree, rows = CapacityTree(length), []
    open_rows: dict[int, list[int]] = defaultdict(list)  # capacity -> rows
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        room = tree.at_least(size)
        if room is None:
            at, room = len(rows), length
            rows.append([])
        else:
            at = open_rows[room].pop()
            tree.add(room, -1)
        rows[at].append(i)
        open_rows[room - size].append(at)
        tree.add(room - size, 1)
    return rows


def id_bytes(tokenizer: str) -> int:
    """Bytes of an id: two where all ids of the vocabulary fit, else four."""
    return 2 if len(unit_ids(tokenizer).ends) <= 1 << 16 else 4


def pack_rows(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per packed row: ``row_id, n_segments, n_tokens, doc_ids, starts, cu_seqlens, ids_crc32, positions_crc32`` and, unless
    left out, the binaries ``ids`` and ``position_ids``."""
    kind = f"<u{id_bytes(tokenizer)}"
    extra = ", ids binary, position_ids binary" if keep_ids else ""

    def emit(held, first):
        """Rows of the pieces held: (doc_id, start, ids)."""
        out = {k: [] for k in ("row_id", "n_segments", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids_crc32", "positions_crc32", "ids", "position_ids")}
        for k, row in enumerate(best_fit_decreasing(np.array([len(x[2]) for x in held]), length)):
            ids, positions, ends = np.full(length, PAD, kind), np.zeros(length, "<u2" if length <= 1 << 16 else "<u4"), [0]
            for i in row:
                part = held[i][2]
                ids[ends[-1] : ends[-1] + len(part)] = part
                positions[ends[-1] : ends[-1] + len(part)] = np.arange(len(part))
                ends.append(ends[-1] + len(part))
            ids, positions = ids.tobytes(), positions.tobytes()
            for name, x in zip(out, (first + k, len(row), ends[-1], [held[i][0] for i in row], [held[i][1] for i in row], ends, zlib.crc32(ids), zlib.crc32(positions), ids, positions), strict=True):
                out[name].append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = {n: pa.array(x, t) for (n, x), t in zip(out.items(), kinds, strict=True)}
        if not keep_ids:
            del columns["ids"], columns["position_ids"]
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        own = unit_ids(tokenizer)
        first = TaskContext.get().partitionId() << 33
        held, tokens = [], 0
        for batch in batches:
            for at, texts in blocks(batch, "text"):
                doc_ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                for doc_id, ids in zip(doc_ids, own.encode_batch(texts), strict=True):
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(0)).astype(kind)
                    for start in range(0, len(ids), length):
                        part = ids[start : start + length]
                        if tokens + len(part) > BLOCK_TOKENS:
                            out = emit(held, first)
                            yield out
                            first += out.num_rows
                            held, tokens = [], 0
                        held.append((doc_id, start, part))
                        tokens += len(part)
        if held:
            yield emit(held, first)

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(
        run, "row_id bigint, n_segments int, n_tokens int, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, ids_crc32 bigint, positions_crc32 bigint" + extra
    )


def unpack(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, start, ids array<int>`` of every segment, read back from the binaries."""
    kind = f"<u{id_bytes(tokenizer)}"

    def run(batches):
        for batch in batches:
            out = {"doc_id": [], "start": [], "ids": []}
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], kind)
                for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
                    for name, x in zip(out, (d, s, ids[a:b].tolist()), strict=True):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], pa.int64()), "start": pa.array(out["start"], pa.int64()), "ids": pa.array(out["ids"], pa.list_(pa.int32()))})

    return rows.select("doc_ids", "starts", "cu_seqlens", "ids").mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")


def op5_token_matrix(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    """All ``documents`` as packed rows of 2048 ids, in binary."""
    return pack_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)
