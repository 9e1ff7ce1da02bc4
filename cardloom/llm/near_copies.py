"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what they connect.

Operator 7 gives the first links: each text gets a fingerprint of its five-word shingles, and those that meet at an anchor at ``BITS`` or fewer
differing bits are verified on their whole sets.  A 64-bit fingerprint can't hold the rule, though: at 0.8 two fingerprints differ in some 10
bits and often in more than 14.  So the links that are left are found by the prefix filter for set similarity, which misses none: under any one order of the
shingles, two sets of similarity 0.8 or more share some of their first ``n - ceil(0.8 n) + 1`` shingles, and the number they share there bounds
what they can share at all.  The order puts frequent shingles last, so a common passage is in a prefix only where a text has little else.  Which are frequent
is read off a sample of the texts; the order has no influence on the result, only on the number of candidates.  Every candidate is verified on the whole sets.

A large group of near copies is not compared pair by pair: in each round the texts of a prefix group are compared with ``LEADERS`` of them,
and in the end only those that no link has joined yet.  Where very many of a group are left (copies of one text that differ by a little too much), each is written as what it
differs in from one of them, its centre: two sets differ in as much as their differences do, so near copies that aren't both joined with the centre share some of the
first of these, and what all have of the common text meets nothing any more.

Texts are read where they lie: prefixes are shuffled once, sets only of texts in candidate pairs, texts only where they may be dropped.

Defined results
* words are split at ASCII blanks and ASCII letters compared without case; a text of fewer than five words has one shingle, all of it, and a
  null text is the empty one;
* of a group (connected component) the row with the smallest id stays, null ids last; of texts that share that id the one with the
  smaller text hash; rows that repeat id *and* text stay or go together (exact dedup thins them);
* an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm import simhash
from cardloom.llm.bpe import blocks
from cardloom.llm.components import components, keep_first, text_hash
from cardloom.llm.rows_out import maybe
from cardloom.llm.scratch import forget, stage

SHINGLE = 5
#: Differing bits up to which fingerprints give the first links.  What more of them would find, the prefixes find as well.
BITS = 3
#: Texts that the members of a prefix group are compared with in one round, and rounds at most.
LEADERS, ROUNDS = 4, 6
#: Rounds end when the pairs left are no more than so many for each row of a prefix group, or a round has joined few of them.
PAIRS = 64
#: A prefix group with more open partners than so many for each of its texts is met by differences from its centre; the others hold half as many pairs for each row at most.
CROWD = 4 * PAIRS
#: Times that each text is compared with its strongest partner before all pairs that are left.
STRONGEST = 1
#: One text in so many is read for the frequent shingles; as many of these are set last at most.
SAMPLE, FREQUENT = 32, 200_000
#: A shingle that so many texts have by the sample has its group of texts spread over tasks.
HOT = 50_000
#: Shingles of a long text that are hashed at a time.
CHUNK = 100_000

#: Factor of the rolling hash (its powers repeat after 2 ** 62 places) and a random value for each byte.
_FACTOR = 0x5851F42D4C957F2D
_BYTES = np.random.default_rng(simhash.SEED).integers(0, 1 << 64, 256, dtype=np.uint64)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2 ** 64."""
    both = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        own = np.full(size, base, np.uint64)
        own[0] = 1
        both.append(np.cumprod(own, dtype=np.uint64))
    return both[0], both[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: a rolling hash over the bytes, mixed."""
    raw = np.frombuffer(b" ".join((text or "").encode().translate(simhash._LOWER).split()), np.uint8)
    blanks = np.flatnonzero(raw == 32)
    n = max(1, len(blanks) + 2 - SHINGLE)
    starts = np.concatenate([[0], blanks[: n - 1] + 1])
    ends = np.concatenate([blanks[SHINGLE - 1 :] if n > 1 else blanks[:0], [len(raw)]])
    own = np.empty(n, np.uint64)
    for at in range(0, n, CHUNK):
        first, last = starts[at], ends[min(n, at + CHUNK) - 1]
        power, back = _powers(1 << int(last - first + 1).bit_length())
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTES[raw[first:last]] * power[: last - first], out=sums[1:])
        a, b = starts[at : at + CHUNK] - first, ends[at : at + CHUNK] - first
        own[at : at + CHUNK] = (sums[b] - sums[a]) * back[a]
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        own = (own ^ (own >> np.uint64(shift))) * np.uint64(times)
    own = np.sort((own ^ (own >> np.uint64(31))).view(np.int64))
    return own[np.append(True, own[1:] != own[:-1])]


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def prefix(own: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles of ``own`` that come first: those not among ``frequent`` (sorted) by hash, then the others by rank."""
    order = np.zeros(len(own), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        order = np.where(frequent[at] == own, ranks[at] + 1, 0)
    return own[np.argsort(order, kind="stable")[: prefix_length(len(own))]]


def sets_of(texts: DataFrame) -> DataFrame:
    """``node, shingles`` of ``node, text``."""

    def run(batches):
        for batch in batches:
            for start, part in blocks(batch, "text"):
                own = pa.array([shingles(x) for x in part], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(start, len(part)), "shingles": own})

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of two or more sampled texts, sorted, their ranks by frequency and about how many texts have them."""
    counts = sets_of(texts.where(F.pmod("node", F.lit(SAMPLE)) == 0)).select(F.explode("shingles").alias("s")).groupBy("s").count()
    top = counts.where("count > 1").orderBy(F.desc("count"), "s").limit(FREQUENT).toPandas()[::-1]
    tokens = top["s"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], order.astype(np.int64), top["count"].to_numpy(np.int64)[order] * SAMPLE


def signatures(texts: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """``token, node, n, at``: prefix shingles that two or more texts have, the size of the text's set and the shingle's place in its order, without rows
    whose neighbours by size in the group are too small and too large to be near copies; and for each text a row with its fingerprint as token and size 0."""
    frequent, ranks, texts_of = common
    hot = frequent[texts_of >= HOT]

    def run(batches):
        for batch in batches:
            for start, part in blocks(batch, "text"):
                own = [shingles(x) for x in part]
                first = [prefix(x, frequent, ranks) for x in own]
                times = [len(x) for x in first]
                nodes = batch.column("node").slice(start, len(part)).to_numpy()
                fps = np.array([simhash.majority(x.view(np.uint64)) for x in own], np.uint64).view(np.int64)
                token = np.concatenate([*first, fps])
                node = np.concatenate([np.repeat(nodes, times), nodes])
                # size of the set, and place of the shingle, in one number
                size = np.concatenate([np.repeat(np.array([len(x) for x in own], np.int64) << 32, times), np.zeros(len(own), np.int64)])
                size[: len(size) - len(own)] += np.concatenate([*map(np.arange, times), np.zeros(0, np.int64)])
                # fingerprints, and shingles that very many texts have, are spread by text: token and node change places
                turned = np.isin(token, hot) | (size == 0)
                yield pa.RecordBatch.from_pydict({"token": np.where(turned, node, token), "node": np.where(turned, token, node), "size": np.where(turned, -size, size)})

    rows = texts.select("node", "text").mapInArrow(run, "token bigint, node bigint, size bigint")
    group = Window.partitionBy("token").orderBy("size", "node")
    n = lambda size: F.shiftright(F.abs(size), 32)
    less, more, turned = F.lag("size").over(group), F.lead("size").over(group), F.col("size") <= 0
    both = rows.withColumn("less", less).withColumn("more", more).withColumn("again", (less == F.col("size")) & (F.lag("node").over(group) == F.col("node")))
    like = ((F.col("less") > 0) & (5 * n("less") >= 4 * n("size"))) | (5 * n("size") >= 4 * n("more"))
    kept = both.where((like | turned) & ~F.coalesce("again", F.lit(False)))
    ends = [F.when(turned, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("node", "token"), ("token", "node"))]
    return kept.select(*ends, n("size").cast("int").alias("n"), F.abs("size").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))


def with_sets(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, x, y``: ``pairs`` (a table ``a, b`` of nodes) with both sets."""
    ends = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct())
    chosen = maybe(texts, "node", ends)
    sets = sets_of(chosen).groupBy("node").agg(F.first("shingles").alias("shingles"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # grows with the corpus: never broadcast
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs`` (``a, b``, two nodes) those with a similarity of 0.8 or more, as a table."""
    pairs = stage(pairs, "candidates")
    met = with_sets(pairs, texts)
    found = stage(met.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "near-links")
    forget(pairs)
    return found


def fingerprint_pairs(fps: DataFrame) -> DataFrame:
    """Candidate pairs by operator 7: texts with one fingerprint, and texts whose fingerprints are linked."""
    nodes = stage(fps.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    one = fps.join(nodes.withColumnRenamed("node", "b").hint("merge"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    edges = simhash.links(nodes, BITS)
    left = nodes.select(F.col("fp").alias("a"), F.col("node").alias("x")).hint("merge")
    right = nodes.select(F.col("fp").alias("b"), F.col("node").alias("y")).hint("merge")
    return one.union(edges.join(left, "a").join(right, "b").select("x", "y"))


def may_be_near() -> F.Column:
    """Can two sets of ``n`` and ``m`` shingles whose prefixes share ``shared``, the last of them at ``i`` and ``j``, be near copies?

    If the prefix of the first ends before that of the second, the first can share only what lies behind its prefix besides, and the second what lies
    behind ``j``; and the other way round.
    """
    behind = lambda n: F.ceil(0.8 * n - 1e-6) - 1
    first = F.least(behind(F.col("n")), F.col("m") - 1 - F.col("j"))
    second = F.least(behind(F.col("m")), F.col("n") - 1 - F.col("i"))
    return 9 * (F.col("shared") + F.greatest(first, second)) >= 4 * (F.col("n") + F.col("m"))


def pairs_met(rows: DataFrame, others: DataFrame, apart) -> DataFrame:
    """``a, b, shared, n, m, i, j`` of the pairs (``node, n, at`` of ``rows`` and ``other, m, there`` of ``others``, joined by token) of like size."""
    sizes = 5 * F.least("n", "m") >= 4 * F.greatest("n", "m")
    met = rows.join(others.hint("merge"), "token").where(sizes & apart)
    turned = F.col("node") > F.col("other")
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    ordered = met.select(pick("node", "other", "a"), pick("other", "node", "b"), pick("n", "m", "n"), pick("m", "n", "m"), pick("at", "there", "i"), pick("there", "at", "j"))
    return ordered.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"), F.max("i").alias("i"), F.max("j").alias("j"))


def leader_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """Pairs of each row of ``token, node, n, at, root`` with ``LEADERS`` texts of its group that it isn't joined with.  A pair may have
    its leader in some of its groups only, so what it shares there counts twice."""
    own = lambda k: F.struct(F.xxhash64("node", F.lit(seed + k)).alias("h"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("at").alias("there"), F.col("root").alias("far"))
    heads = rows.groupBy("token").agg(F.array_distinct(F.array(*(F.min(own(k)) for k in range(LEADERS)))).alias("heads")).select("token", F.explode("heads").alias("head"))
    met = pairs_met(rows, heads.select("token", "head.other", "head.m", "head.there", "head.far"), F.col("root") != F.col("far"))
    return met.withColumn("shared", 2 * F.col("shared")).where(may_be_near()).select("a", "b")


def difference_prefix(added: np.ndarray, removed: np.ndarray, n: int, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set's difference from its centre (those ``added`` to it and those ``removed``), as many as tell it from all that are no near copies.

    Of two near copies of ``n`` and ``m`` shingles the one lacks ``(n + m) / 9``, that is ``n / 4``, of the other's difference at most.  The order puts those first that few
    texts of a group differ in: rare ones that are added, then frequent ones that are removed.
    """

    def rank(own):
        if not len(frequent):
            return np.full(len(own), -1, np.int64)
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        return np.where(frequent[at] == own, ranks[at], -1)

    more, less, top = rank(added), rank(removed), len(frequent)
    # rare added ones; frequent removed ones, the most frequent first; frequent added ones, the rarest first; rare removed ones
    order = np.concatenate([np.where(more < 0, 0, 1 + top + more), np.where(less < 0, 1 + 2 * top, top - less)])
    own = np.concatenate([added, removed])
    return own[np.lexsort((own, order))[: n // 4 + 1]]


def differences(rows: DataFrame, texts: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Links of the nodes of ``token, node`` with the centres of their groups, and ``token, node, n, d, at`` of the first shingles of their differences.

    Two near copies of a group are both linked with its centre, or they share one of these at which :func:`room` holds.  If neither set's difference had a shingle of the other's, the two
    would differ in the sum of both, and as sets that differ by ``(n + m) / 9`` at most they would both be as near to the centre.
    """
    frequent, ranks, _ = common
    centre = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(-1)), "node"))["node"].alias("b"))
    pairs = stage(rows.join(centre.hint("merge"), "token").select(F.col("node").alias("a"), "b").distinct(), "centres")
    size = F.size("x").alias("n")
    apart = with_sets(pairs, texts).select("a", "b", size, F.size("y").alias("m"), F.array_except("x", "y").alias("added"), F.array_except("y", "x").alias("removed"))
    apart = apart.withColumn("d", F.size("added") + F.size("removed"))

    def run(batches):
        for batch in batches:
            added, removed, sizes = batch.column("added"), batch.column("removed"), batch.column("n").to_pylist()
            first = [difference_prefix(added[i].values.to_numpy(), removed[i].values.to_numpy(), n, frequent, ranks) for i, n in enumerate(sizes)]
            own = {k: batch.column(k) for k in ("a", "b", "n", "m", "d")}
            yield pa.RecordBatch.from_pydict(own | {"first": pa.array(first, pa.list_(pa.int64()))})

    cut = stage(apart.mapInArrow(run, "a bigint, b bigint, n int, m int, d int, first array<bigint>"), "differences")
    forget(pairs)
    linked = cut.where("a <> b AND 9 * d <= n + m").select("a", "b")
    return linked, cut.select("b", F.col("a").alias("node"), "n", "d", F.posexplode("first").alias("at", "s")).select(F.xxhash64("b", "s").alias("token"), "node", "n", "d", "at")


def room() -> F.Column:
    """Can the first shingle that two differences of ``d`` and ``e`` share stand at ``at`` and ``there``, if sets of ``n`` and ``m`` are near copies?  What comes before it is missing in the other."""
    both, more = F.col("n") + F.col("m"), 9 * (F.col("d") - F.col("e"))
    return (18 * F.col("at") <= both + more) & (18 * F.col("there") <= both - more)


def differences_met(rows: DataFrame, others: DataFrame, apart) -> DataFrame:
    """``a, b, shared`` of the pairs (``token, node, n, d, at, root`` of ``rows`` and ``token, other, m, e, there, far`` of ``others``) that may be near copies."""
    sizes = 5 * F.least("n", "m") >= 4 * F.greatest("n", "m")
    met = rows.join(others.hint("merge"), "token").where(sizes & room() & apart)
    return met.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def crowds(rows: DataFrame, edges: DataFrame, texts: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """More ``edges``, and the open pairs ``a, b, shared`` of the crowded groups ``token, node``."""
    linked, firsts = differences(rows, texts, common)
    edges = stage(edges.union(linked), "links")

    def rooted():
        roots = components(edges).hint("merge")
        named = stage(firsts.join(roots, "node", "left").select("token", "node", "n", "d", "at", F.coalesce("root", "node").alias("root")), "named-differences")
        several = named.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("token")
        return named.join(several.hint("merge"), "token", "left_semi")

    names = {"node": "other", "n": "m", "d": "e", "at": "there", "root": "far"}
    own = F.struct(F.xxhash64("node", F.lit(-2)).alias("h"), *(F.col(k).alias(v) for k, v in names.items()))
    named = rooted()
    heads = named.groupBy("token").agg(F.min(own).alias("head")).select("token", *(f"head.{v}" for v in names.values()))
    edges = stage(edges.union(similar(differences_met(named, heads, F.col("root") != F.col("far")).select("a", "b"), texts)), "links")
    named = rooted()
    return edges, differences_met(named, named.withColumnsRenamed(names), (F.col("node") < F.col("other")) & (F.col("root") != F.col("far")))


def strongest_first(met: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """``edges`` and what all of ``met`` (``a, b, shared``) adds: first each text is compared with the one that shares most with it, and
    only pairs that this hasn't joined are compared then.  Every pair is compared or joined."""
    for _ in range(STRONGEST):
        one = met.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
        two = met.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
        best = stage(one.union(two).distinct(), "best-pairs")
        edges = stage(edges.union(similar(best, texts)), "links")
        roots = components(edges)
        near, far = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")).hint("merge") for x in "ab")
        apart = met.join(best.hint("merge"), ["a", "b"], "left_anti").join(near, "a", "left").join(far, "b", "left")
        met = stage(apart.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "shared"), "open-pairs")
    return edges.union(similar(met.select("a", "b"), texts))


def links(shared: DataFrame, found: DataFrame, texts: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Edges ``a, b`` that connect the texts of each group; ``found`` are candidates by fingerprint."""
    edges, before = similar(found, texts), float("inf")
    for turn in range(ROUNDS + 1):
        # what is joined already comes as stars
        roots = components(edges)
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        named = shared.join(roots.hint("merge"), "node", "left").select("token", "node", "n", "at", F.coalesce("root", "node").alias("root"))
        named = stage(named, "named-prefixes")
        groups = named.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        groups = stage(groups.select("token", F.expr("k * k - kk").alias("open"), (F.expr("k * k - kk") > CROWD * F.col("k")).alias("crowded")).where("open > 0"), "open-groups")
        open_ = stage(named.join(groups.select("token", "crowded").hint("merge"), "token"), "open-prefixes")
        left, crowded = groups.agg(F.coalesce(F.sum(F.col("open").cast("double")), F.lit(0.0)), F.count_if("crowded")).first()
        rows = open_.count()
        forget(named, groups)
        if not rows:
            return edges
        if left / 2 <= PAIRS * rows or left > 0.7 * before or turn == ROUNDS:
            few = open_.where("NOT crowded")
            other = few.select("token", F.col("node").alias("other"), F.col("n").alias("m"), F.col("at").alias("there"), F.col("root").alias("far"))
            met = pairs_met(few, other, (F.col("node") < F.col("other")) & (F.col("root") != F.col("far")))
            met = met.where(may_be_near()).select("a", "b", "shared")
            if crowded:
                edges, more = crowds(open_.where("crowded").select("token", "node"), edges, texts, common)
                met = met.union(more).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
            return strongest_first(stage(met, "open-pairs"), edges, texts)
        edges = stage(edges.union(similar(leader_pairs(open_, LEADERS * turn), texts)), "links")
        forget(open_)
        before = left


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, node, root`` of each row: the hash of its text, and the hash that names its group."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_hash(docs[text_col]).alias("node"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = stage(texts.select("doc_id", "node"), "text-hashes")
    common = frequent_shingles(texts)
    signed = stage(signatures(texts, common), "signatures")
    found = fingerprint_pairs(signed.where("n = 0").select(F.col("token").alias("fp"), "node"))
    roots = components(links(signed.where("n > 0"), found, texts, common)).hint("merge")
    return rows.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without near copies of a row that comes first in its group, with their columns."""
    return keep_first(docs, near_groups(docs, id_col, text_col).withColumnRenamed("node", "text_hash"), id_col, text_col)
