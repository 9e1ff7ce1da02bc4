"""Operator 9, packing into sequences by linear grouping and best fit.

The plan is made from counts, the documents follow it in Spark:

1. Each document becomes pieces of at most ``LENGTH`` tokens; only their lengths and checksums travel on.  A full piece is a sequence by itself.
2. The number of pieces of each length (at most ``LENGTH`` numbers, whatever the corpus) goes to the driver.
3. Linear grouping: pieces longer than the small ones, in descending order, are dealt into a few groups of equal cardinality, and each counts with
   the largest length of its group.  For these few sizes the configurations are optimised together: the linear programme over all configurations, solved by column generation with
   a knapsack for the next configuration, and its times rounded down.  Each configuration leaves some room to small pieces where there are enough of these.
4. Actual pieces take the places: the rank of a piece in its group says which copy of which configuration it belongs to.
5. Small pieces, and those that the rounded times leave over, go by descending length to the fullest sequence that still takes them, with the room that the actual pieces left.  Where
   small pieces can't fill these rooms, a share of the sequences, the emptiest, is dissolved before and its pieces go the same way by their actual lengths, which regains what rounding up has lost.
   This runs on counts as well: the number of sequences for each room, the number of pieces for each length.

Ranks are numbered in parts of each length, one for every ``PART`` pieces, so pieces of one length are spread over many tasks.  What is broadcast (plan rows,
offsets) is bounded by ``LENGTH``, the groups and a row for every ``PART`` pieces.

Defined results
* a null or empty text is one piece that holds the end token alone;
* rows that repeat an id (or a whole row) are packed one by one; ties of length are ordered by id, piece and checksum;
* an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.bpe import blocks
from cardloom.llm.scratch import arrow_rows, stage
from cardloom.llm.unit_cache import unit_ids

LENGTH = 2048
#: Pieces up to so many tokens are small; larger ones are dealt into so many groups, each of which is tried.
SMALL, GROUPS = 512, (64, 96, 128)
#: Room of a sequence that is left to small pieces where there are enough of them: it is filled better than the few tokens that rounding up leaves.
RESERVE = 512
#: Turns of the column generation at most, for each size; share of the sequences that are dissolved where small pieces can't fill all rooms.
TURNS, DISSOLVED = 30, 0.7
#: Pieces of one length that are numbered together.
PART = 100_000
#: Offsets of parts that are broadcast at most, 24 MB; beyond that they are merged.
MOST_OFFSETS = 1_000_000
#: Texts that a task takes at once.
TEXTS = 1000
END = (0).to_bytes(4, "little")


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, known: int | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece and, if asked for, its ``ids`` (little-endian unsigned 32-bit); ``known`` bounds the bytes of each of the encoder's tables."""

    def run(batches):
        own = unit_ids(tokenizer, known)
        for batch in batches:
            for at, texts in blocks(batch, "text"):
                row, number, start, size, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(own.encode_batch(texts)):
                    ids += END
                    for k, a in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[a : a + 4 * length]
                        row.append(at + i)
                        number.append(k)
                        start.append(a // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part)
                out = {
                    "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(kept, pa.binary())} if keep_ids else {}))

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else ""))


# -- plans from counts ---------------------------------------------------------


def group_sizes(counts: dict[int, int], groups: int) -> tuple[int, list[int], list[int]]:
    """Cardinality of a group, and for each group the size it is rounded up to and the pieces it has."""
    total = sum(counts.values())
    if not total:
        return 1, [], []
    each = -(-total // groups)
    lengths = sorted(counts, reverse=True)
    upto = np.cumsum([counts[x] for x in lengths])
    firsts = range(0, total, each)
    return each, [lengths[int(np.searchsorted(upto, f, "right"))] for f in firsts], [min(each, total - f) for f in firsts]


class Ranked:
    """Lengths of pieces by rank, longest first, from their counts."""

    def __init__(self, counts: dict[int, int]):
        self.lengths = np.array(sorted(counts, reverse=True))
        self.upto = np.cumsum([counts[x] for x in self.lengths.tolist()])

    def rooms(self, times: int, used: list[tuple[int, int]], length: int) -> dict[int, int]:
        """Copies by room of a configuration whose copy ``j`` holds the pieces from rank ``first + j * k`` on, ``k`` of them, for each ``(first, k)``: the lengths change at few copies."""
        turns = [np.array([0])] + [-(-(self.upto - first - i) // k) for first, k in used for i in range(k)]
        starts = np.unique(np.concatenate(turns))
        starts = starts[(starts >= 0) & (starts < times)]
        taken = sum(self.lengths[np.searchsorted(self.upto, first + starts * k + i, "right")] for first, k in used for i in range(k))
        out: dict[int, int] = defaultdict(int)
        for room, n in zip((length - taken).tolist(), np.diff(np.append(starts, times)).tolist()):
            out[room] += n
        return out

    def between(self, first: int, end: int) -> dict[int, int]:
        """Pieces by length from rank ``first`` to ``end``."""
        n = np.diff(np.clip(np.append(0, self.upto), first, end))
        return {int(x): int(k) for x, k in zip(self.lengths, n) if k}


def priciest(sizes: np.ndarray, worth: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """Knapsack: the configuration (pieces of each size) that holds most worth, and its worth."""
    best, added = np.zeros(length + 1), []  # by room; one piece more in each turn
    while True:
        new, last = best.copy(), np.full(length + 1, -1)
        for g, (size, w) in enumerate(zip(sizes, worth)):
            more = best[: length + 1 - size] + w
            better = more > new[size:] + 1e-12
            new[size:][better], last[size:][better] = more[better], g
        if (last < 0).all():
            break
        best = new
        added.append(last)
    used, room = np.zeros(len(sizes)), length
    for last in reversed(added):
        if last[room] >= 0:
            used[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[length]), used


def configurations(sizes: list[int], counts: list[int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(times, {group: pieces}) that use up the counts but for a few pieces of each configuration.

    The linear programme of all configurations at once, with the fewest sequences: configurations come in one by one, the one that the prices of the sizes make the most worth (column generation with a
    knapsack), until none is worth more than the sequence it takes.  There are as many configurations as sizes; the times are rounded down.
    """
    if not sizes:
        return []
    own, left = np.array(sizes), list(counts)
    base = np.diag((length // own).astype(float))
    times = np.array(counts) / base.diagonal()
    for _ in range(TURNS * len(sizes)):
        worth, column = priciest(own, np.linalg.solve(base.T, np.ones(len(sizes))), length)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(base, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(times, 0) / step, np.inf)
        out = int(ratio.argmin())
        times = times - ratio[out] * step
        times[out], base[:, out] = ratio[out], column
    plan = []
    for n, column in sorted(zip(times, base.T), key=lambda x: (-x[0], x[1].tolist())):
        used = {g: int(k) for g, k in enumerate(column) if k > 0.5}
        whole = min([int(n + 1e-6), *(left[g] // k for g, k in used.items())])
        if whole > 0:
            for g, k in used.items():
                left[g] -= whole * k
            plan.append((whole, used))
    return plan


def fill_rooms(rooms: dict[int, int], counts: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit of small pieces, ``counts`` by length, into ``rooms`` (sequences by room; numbered by room, then on).

    Returns rows (length, first rank, pieces, first sequence, pieces for each sequence) and the number of sequences with the new ones.
    """
    spans: dict[int, list[tuple[int, int]]] = {}
    total = 0
    for room in sorted(rooms):
        spans[room] = [(total, total + rooms[room])]
        total += rooms[room]
    plan = []
    for size in sorted(counts, reverse=True):
        rank, n = 0, counts[size]
        while rank < n:
            room = min((r for r in spans if r >= size), default=None)
            if room is None:
                each = length // size
                more = -(-(n - rank) // each)
                spans[length] = [(total, total + more)]
                total += more
                continue
            a, b = spans[room].pop()
            if not spans[room]:
                del spans[room]
            each = min(room // size, n - rank)
            use = min(b - a, (n - rank) // each)
            plan.append((size, rank, use * each, a, each))
            rank += use * each
            if room - each * size:
                spans.setdefault(room - each * size, []).append((a, a + use))
            if a + use < b:
                spans.setdefault(room, []).append((a + use, b))
    return plan, total


# -- following the plan --------------------------------------------------------


def ranked(rows: DataFrame, by: str, order: list[str], counts: dict[int, int]) -> DataFrame:
    """``rows`` with ``rank``, gapless from 0 among the rows with the same ``by`` (a column of few values, ``counts`` rows each)."""
    # a row for each value; then one for each part of a value
    parts = rows.sparkSession.createDataFrame([(v, 1 + n // PART) for v, n in counts.items()], f"{by} bigint, parts bigint")
    rows = rows.join(F.broadcast(parts), by).withColumn("part", F.pmod(F.xxhash64(*order), F.col("parts"))).drop("parts")
    sizes = rows.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n")
    offsets = stage(sizes.select(by, "part", before.alias("before")), "ranks")
    within = F.row_number().over(Window.partitionBy(by, "part").orderBy(*order)) - 1
    few = sum(1 + n // PART for n in counts.values()) <= MOST_OFFSETS
    offsets = F.broadcast(offsets) if few else offsets.hint("merge")
    return rows.withColumn("rank", within).join(offsets, [by, "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def counted(rows: DataFrame, by: str) -> dict[int, int]:
    """Rows for each value of a column that has few values."""
    return {int(r[0]): r[1] for r in rows.groupBy(by).agg(F.count(F.lit(1))).collect()}


def reserves(large: int, small: int, length: int) -> list[int]:
    """Rooms that sequences of large pieces may leave to small ones: none, and steps up to what ``small`` tokens of them can fill, ``RESERVE`` at most."""
    most, step = RESERVE * length // LENGTH, max(1, RESERVE * length // LENGTH // 8)
    return [r for r in range(0, most + 1, step) if not r or r * large <= 0.8 * small * (length - r)]


def plan_large(counts: dict[int, int], length: int, groups: tuple[int, ...] = GROUPS, small: dict[int, int] | None = None) -> tuple[int, list[tuple[int, int, int, int, int]], int]:
    """Cardinality of a group, 2 at least, places (group, first rank in it, pieces, first sequence, pieces for each sequence) of the configurations, and the number of sequences that this comes to.

    Each configuration leaves a room for small pieces (``small``, numbers by length), but for pieces that are longer than that allows, which have a sequence each.  Plans are made for several such rooms
    and numbers of groups, and the one that needs the fewest sequences is taken: the rooms that the actual pieces leave are known from the counts.
    """
    small = small or {}
    tokens = lambda own: sum(x * n for x, n in own.items())
    line, best = Ranked(counts), None
    bound = -(-(tokens(counts) + tokens(small)) // length)
    choices = [(own, r) for own in groups for r in reserves(tokens(counts), tokens(small), length)]
    for own, reserve in choices:
        each, sizes, members = group_sizes(counts, max(1, min(own, sum(counts.values()) // 2)))
        alone = sum(s > length - reserve for s in sizes)  # the first groups
        plan = [(members[g], {g: 1}) for g in range(alone)]
        plan += [(times, {alone + g: k for g, k in used.items()}) for times, used in configurations(sizes[alone:], members[alone:], length - reserve)]
        places, taken, sequences, rooms, loose = [], [0] * len(sizes), 0, defaultdict(int), defaultdict(int, small)
        for times, used in plan:
            for room, n in line.rooms(times, [(g * each + taken[g], k) for g, k in used.items()], length).items():
                rooms[room] += n
            for g, k in used.items():
                places.append((g, taken[g], times * k, sequences, k))
                taken[g] += times * k
            sequences += times
        for g in range(len(sizes)):
            for x, n in line.between(g * each + taken[g], g * each + members[g]).items():
                loose[x] += n
        needed = fill_rooms(rooms, loose, length)[1]
        if best is None or needed < best[0]:
            best = needed, each, places
        if needed <= bound:
            break
    return best[1], best[2], best[0]


def least_room(rooms: dict[int, int], small: int) -> int:
    """Room from which a sequence is dissolved: none where ``small`` tokens of small pieces fill all rooms, else the emptiest ``DISSOLVED`` of the sequences."""
    if small >= sum(r * n for r, n in rooms.items()):
        return 1 << 30
    most, upto = sum(rooms.values()) * DISSOLVED, 0
    for room in sorted(rooms, reverse=True):
        upto += rooms[room]
        if upto > most:
            return room + 1 if upto > 2 * most else room
    return 1 << 30


def pack(items: DataFrame, length: int = LENGTH, groups: tuple[int, ...] = GROUPS, small: int = SMALL) -> DataFrame:
    """``items`` (``doc_id, piece, length`` and more columns) with ``sequence_id`` and ``offset``."""
    spark = items.sparkSession
    counts = counted(items, "length")
    small = min(small, length - 1)
    large = {x: n for x, n in counts.items() if small < x < length}
    minor_counts = {x: n for x, n in counts.items() if x <= small}
    each, places, _ = plan_large(large, length, groups, minor_counts)
    order = ["doc_id", "piece", "ids_crc32"]
    upto, above = 0, {}
    for x in sorted(large, reverse=True):
        above[x] = upto
        upto += large[x]

    full = items.where(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    steps = spark.createDataFrame([*above.items()], "length bigint, above bigint")
    ranks = ranked(items.where((F.col("length") > small) & (F.col("length") < length)), "length", order, large)
    own = ranks.join(F.broadcast(steps), "length").withColumn("rank", F.col("rank") + F.col("above"))
    own = own.withColumn("g", F.expr(f"CAST(rank div {each} AS int)")).withColumn("q", F.pmod("rank", F.lit(each)))
    # as many configurations as groups, of LENGTH / SMALL sizes at most
    spots = F.broadcast(spark.createDataFrame(places, "pg int, low bigint, n bigint, first bigint, each bigint"))
    placed = own.join(spots, (F.col("g") == F.col("pg")) & (F.col("q") >= F.col("low")) & (F.col("q") < F.col("low") + F.col("n")), "left")
    placed = placed.withColumn("sequence_id", F.expr("first + (q - low) div each"))
    # pieces beyond the whole configurations have no sequence yet
    placed = stage(placed.select(*items.columns, "sequence_id"), "placed")

    room = (F.lit(length) - F.sum("length")).alias("room")
    rooms = stage(placed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(room), "rooms")
    with_room = counted(rooms, "room")
    least = least_room(with_room, sum(x * n for x, n in minor_counts.items()))
    rooms, with_room = rooms.where(F.col("room") < least), {r: n for r, n in with_room.items() if r < least}
    kept = rooms.select("sequence_id", F.lit(True).alias("stays")).hint("merge")
    told = stage(placed.join(kept, "sequence_id", "left"), "told")
    placed = told.where("stays").select(*items.columns, "sequence_id")
    loose = items.where(F.col("length") <= small).unionByName(told.where("stays IS NULL").select(*items.columns))
    loose_counts = minor_counts | counted(told.where("stays IS NULL"), "length")
    fill, total = fill_rooms(with_room, loose_counts, length)
    upto, below = 0, {}
    for x in sorted(with_room):
        below[x] = upto
        upto += with_room[x]
    numbers = ranked(rooms, "room", ["sequence_id"], with_room)
    numbers = numbers.join(F.broadcast(spark.createDataFrame([*below.items()], "room bigint, below bigint")), "room")
    numbers = numbers.select((F.col("rank") + F.col("below")).alias("number"), "sequence_id")

    minor = ranked(loose, "length", order, loose_counts)
    # a row for each length and room at most
    spots = F.broadcast(spark.createDataFrame(fill, "size bigint, low bigint, n bigint, first bigint, each bigint"))
    minor = minor.join(spots, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("n")))
    minor = minor.withColumn("number", F.expr("first + (rank - low) div each")).select(*items.columns, "number")
    # sequences of their own follow those of the configurations
    after = max((first + n // k for _, _, n, first, k in places), default=0)
    minor = minor.join(numbers, "number", "left").withColumn("sequence_id", F.coalesce("sequence_id", F.col("number") + after))

    everything = placed.unionByName(minor.select(*placed.columns))
    line = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, 0)
    return everything.withColumn("offset", F.sum("length").over(line) - F.col("length")).unionByName(full.withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, tokenizer: str = public_tokenizers.path("word_bpe_49k.json"), length: int = LENGTH, known: int | None = None) -> DataFrame:
    """Pieces of all documents with their places; ``known`` bounds the encoder's tables and changes no row."""
    with arrow_rows(docs.sparkSession, TEXTS):
        made = stage(pieces(docs, tokenizer, length, known=known), "pieces")
    made = pack(made, length)
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
