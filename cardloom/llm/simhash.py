"""Operator 7, SimHash near-dedup by anchor points of a covering code.

A 64-bit fingerprint is cut into three blocks of 22, 21 and 21 bits.  Of two fingerprints at 4 or fewer differing bits, either one block is
equal, or two blocks differ in one bit each and the third in one or two.

* An equal block: every word of the block is an anchor (covering radius 0, threshold 0), and the fingerprint is at home there.
* A block that differs in one bit: its anchors are the 4096 words of the perfect binary Golay code of length 23, whose covering radius is 3
  (shorter blocks are padded with zero bits).  If ``x`` lies at distance ``r(x)`` from its nearest anchor, then any ``y`` that differs from it in one
  bit lies within ``r(x) + 1`` of that anchor.  So each fingerprint has one home anchor per block and is replicated to every anchor within
  ``min(3, its own distance) + 1``: of two linked fingerprints the one that is nearer to its home is met there by the other.  The bits outside the block
  differ in 3 at most, so of four parts of them one is equal: each anchor is divided by the values of each part.  Two of the blocks are enough.

For ``N`` random fingerprints that is some 45 replicas each and ``N ** 2 / 70,000`` comparisons.  Nothing is left out or capped; the comparison at an anchor is exact.

At each anchor the links found are reduced to a spanning forest before they leave the task, so a group of near
copies gives as many edges as it has members, not pairs.  Anchors that a sample shows to be crowded are dealt over a grid of cells
(``HOMES`` by ``GUESTS``) that bounds what a task holds.  Copies with one fingerprint are reduced to one node first.

Defined results
* a null or empty text has fingerprint zero and is linked like any other; a text of fewer words than a shingle has one
  shingle, the whole sequence;
* rows that repeat an id are one document with several fingerprints' links: each row gets the component of its own fingerprint;
* a null id is never the smallest unless a group has no other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.components import components, keep_first, text_hash
from cardloom.llm.scratch import stage

SHINGLE = 4
BITS = 4
SEED = 42
#: (first bit, length) of the blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints in one cell of a crowded anchor: at home, and from elsewhere.
HOMES, GUESTS = 8192, 32768
#: One fingerprint in so many is read to find the crowded anchors, and the number of anchors that get a grid at most; this has no
#: influence on the links that are found.
SAMPLE, CROWDED = 64, 10_000
#: Cells up to this size are compared many at a time.
TINY = 64

_LOWER = bytes(b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes are split at exactly the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(blanks[: n - 1] + 1).tolist()]
    ends = [*blanks[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of each row, and ``text_hash`` where it is asked for."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], np.uint64)
            own = {"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))}
            yield pa.RecordBatch.from_pydict(own | ({"text_hash": batch.column("text_hash")} if hashed else {}))

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    if hashed:
        rows = rows.withColumn("text_hash", text_hash(F.col("text")))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint" + (", text_hash bigint" if hashed else ""))


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The perfect binary Golay code of length 23 with the generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1.

    Returns the syndromes of single bits, and for each syndrome the error patterns (leader first, then by weight) that lead
    to an anchor at most one bit farther than the nearest, with their number.
    """
    poly, n, k = 0b110001110101, 23, 12
    unit = []
    for bit in range(n):
        rest = 1 << bit
        for top in range(n - 1, n - k - 1, -1):
            if rest >> top & 1:
                rest ^= poly << (top - (n - k))
        unit.append(rest)
    found: list[list[int]] = [[] for _ in range(1 << (n - k))]
    for weight in range(5):
        for bits in combinations(range(n), weight):
            syndrome, word = 0, 0
            for b in bits:
                syndrome, word = syndrome ^ unit[b], word | 1 << b
            own = found[syndrome]
            if not own or weight <= own[0].bit_count() + 1:
                own.append(word)
    count = np.array([len(x) for x in found])
    table = np.zeros((len(found), count.max()), np.uint32)
    for i, x in enumerate(found):
        table[i, : len(x)] = x
    return np.array(unit, np.uint32), table, count


def _homes_and_neighbours(part: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home?) of the Golay anchors that ``part``, words of ``length`` bits, are replicated to."""
    unit, table, count = golay()
    syndrome = np.zeros(len(part), np.uint32)
    for bit in range(length):
        syndrome ^= np.where(part >> np.uint32(bit) & np.uint32(1), unit[bit], np.uint32(0))
    row, col = np.nonzero(np.arange(table.shape[1]) < count[syndrome][:, None])
    word = part[row] ^ table[syndrome[row], col]
    return row, (word >> 11).astype(np.int64), col == 0  # the code is systematic: 12 high bits name the word


def anchors(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home?) of all replicas of ``fps``; anchors of different kinds have different numbers."""
    rows, keys, home = [], [], []

    def add(kind, row, key, own):
        rows.append(row)
        keys.append((kind << 58) + key)
        home.append(own)

    everyone = np.arange(len(fps))
    words = [(fps >> np.uint64(first) & np.uint64((1 << length) - 1)).astype(np.uint32) for first, length in BLOCKS]
    for block, word in enumerate(words):
        add(block, everyone, word.astype(np.int64), np.ones(len(fps), bool))
    # where no block is equal: so many of any two, or of all three, that one differs in a single bit
    for block in range(max(0, bits - 2)):
        first, length = BLOCKS[block]
        row, anchor, own = _homes_and_neighbours(words[block], length)
        others = (fps & np.uint64((1 << first) - 1)) | (fps >> np.uint64(first + length) << np.uint64(first))
        cuts = np.linspace(0, 64 - length, bits + 1).astype(int)  # bits - 1 differences at most in as many parts as bits
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            value = (others >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            add(3 + block * bits + k, row, (anchor << 22) + value[row], own)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect the rows that ``left`` and ``right`` connect; the root has the smallest id."""
    root = np.arange(len(ids))
    while True:  # hook the larger root to the smaller, then halve the paths
        a, b = root[left], root[right]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def compare(ids: np.ndarray, fps: np.ndarray, home: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between the rows at home and all rows of one cell."""
    order = np.argsort(ids, kind="stable")
    ids, fps, home = ids[order], fps[order], home[order]
    at_home = np.flatnonzero(home)
    left, right = [], []
    step = max(1, 2_000_000 // max(1, len(ids)))
    for at in range(0, len(at_home), step):
        own = at_home[at : at + step]
        near = np.bitwise_count(fps[own][:, None] ^ fps[None, :]) <= bits
        near[np.arange(len(own)), own] = False
        x, y = np.nonzero(near)
        if len(x):  # reduced step by step, so that a dense group never holds all its pairs
            a, b = forest(np.arange(len(ids)), own[x], y)
            left.append(a)
            right.append(b)
    if not left:
        return ids[:0], ids[:0]
    return forest(ids, np.concatenate(left), np.concatenate(right))


def compare_cells(cell: np.ndarray, fps: np.ndarray, home: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links of all cells; rows come sorted by cell.  Large cells are compared one by one, all others together."""
    starts = np.unique(cell, return_index=True)[1]
    ends = np.append(starts[1:], len(cell))
    left, right = [], []
    ids = fps.view(np.int64)
    for a, b in zip(starts[ends - starts > TINY].tolist(), ends[ends - starts > TINY].tolist(), strict=True):
        x, y = compare(ids[a:b], fps[a:b], home[a:b], bits)
        left.append(x)
        right.append(y)
    # rows left in their small cell after each row: the row and the one ``step`` after it
    after = np.where(np.repeat(ends - starts, ends - starts) <= TINY, np.repeat(ends, ends - starts) - np.arange(len(cell)) - 1, 0)
    at, step = np.flatnonzero(after > 0), 1
    while len(at):
        other = at + step
        near = (home[at] | home[other]) & (np.bitwise_count(fps[at] ^ fps[other]) <= bits)
        left.append(ids[at[near]])
        right.append(ids[other[near]])
        step += 1
        at = at[after[at] >= step]
    if not left:
        return ids[:0], ids[:0]
    met, at = np.unique(np.concatenate(left + right), return_inverse=True)
    return forest(met, at[: len(at) // 2], at[len(at) // 2 :])


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges ``a, b`` between the fingerprints ``fp`` of ``nodes`` (each once) that differ in ``bits`` or fewer bits, up to
    transitivity.  The blocks allow for ``bits`` up to 5."""
    if bits // len(BLOCKS) > 1:
        raise ValueError("three blocks find at most 5 differing bits")

    def replicate(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4_000):
                row, key, home = anchors(fps[at : at + 4_000], bits)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(key), "fp": pa.array(fps[at + row].view(np.int64)), "home": pa.array(home)})

    columns = "anchor bigint, fp bigint, home boolean"
    # a grid of cells for the crowded anchors, CROWDED rows at most
    homes, rows = SAMPLE * F.count_if("home"), SAMPLE * F.count(F.lit(1))
    some = nodes.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(replicate, columns)
    crowd = some.groupBy("anchor").agg(homes.alias("homes"), rows.alias("rows")).where((F.col("homes") > HOMES) | (F.col("rows") > GUESTS))
    crowd = crowd.orderBy(F.desc(F.col("homes") * F.col("rows")), "anchor").limit(CROWDED)
    grid = stage(crowd.select("anchor", F.ceil((F.col("homes") + 1) / HOMES).cast("int").alias("hs"), F.ceil(F.col("rows") / GUESTS).cast("int").alias("gs")), "crowded-anchors")
    dealt = nodes.select("fp").mapInArrow(replicate, columns).join(F.broadcast(grid), "anchor", "left")
    h, g = F.pmod(F.xxhash64("fp"), F.col("hs")), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("gs"))
    # at home in row h of the grid, in all its columns; as a guest (one at home meets its neighbours as a guest) in column g, in all rows
    as_home = F.transform(F.sequence(F.lit(0), F.col("gs") - 1), lambda k: F.struct(F.xxhash64("anchor", h, k.cast("long")).alias("cell"), F.lit(True).alias("home")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda k: F.struct(F.xxhash64("anchor", k.cast("long"), g.cast("long")).alias("cell"), F.lit(False).alias("home")))
    alone = F.array(F.struct(F.col("anchor").alias("cell"), F.col("home")))
    places = F.when(F.col("hs").isNull(), alone).when(F.col("home"), F.concat(as_home, as_guest)).otherwise(as_guest)
    cells = dealt.select("fp", F.explode(places).alias("at")).select("at.cell", "fp", "at.home")

    def meet(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def done():
            table = pa.Table.from_batches(held)
            x, y = compare_cells(table.column("cell").to_numpy(), table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(), bits)
            if len(x):
                yield pa.RecordBatch.from_pydict({"a": pa.array(x), "b": pa.array(y)})

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            # rows come sorted by cell: all but the last cell of the batch are complete
            cut = int(np.searchsorted(cell, cell[-1]))
            if held and (cut or cell[0] != last):
                held.append(batch.slice(0, cut))
                yield from done()
                held = [batch.slice(cut)]
            elif held:
                held.append(batch)
            else:
                held = [batch]
                if cut:
                    held = [batch.slice(0, cut)]
                    yield from done()
                    held = [batch.slice(cut)]
            last = cell[-1]
        if held:
            yield from done()

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cells.repartition(parts, "cell").sortWithinPartitions("cell")
    return met.mapInArrow(meet, "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """``doc_id, fp, component_id`` of each row; the component is named by its smallest id.

    Components can share that name where ids repeat or are null; ``hashed`` adds ``text_hash`` and ``root``, which no two share.
    """
    extra = ["text_hash", "root"] if hashed else []
    rows = stage(fingerprints(docs, id_col, text_col, shingle, hashed), "fingerprints")
    # a fingerprint is a node with the smallest id that has it; ids that repeat may name several, so nodes have numbers of their own order
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    edges = stage(links(nodes, bits), "links")
    roots = components(edges)
    comp = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    comp = stage(comp, "members")
    least = stage(comp.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    named = stage(comp.join(least, "root").select("fp", "component_id", *extra[1:]), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", *extra)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Rows of ``docs`` that are first in their group by id, with their columns; rows that share an id and a text stay or go together."""
    groups = near_groups(docs, id_col, text_col, bits, hashed=True)
    return keep_first(docs, groups, id_col, text_col)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
