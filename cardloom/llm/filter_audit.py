"""Operator 13, filter interaction audit: what each of five filters removes in each of the 120 orders in which they can be applied.

1. Each document becomes a mask, one bit for each filter it fails, from Column functions on its own row.  Whether its text has been seen under a smaller id is told by
   the text's SHA-256: rows are counted by (text, part, mask, labels) with the smallest id of each, these counts meet the smallest id of the text.
2. The counts of a part are at most 32 cells, a number for each mask, with its good and its toxic documents.
3. The orders of a part are visited by single swaps of neighbours (plain changes).  A swap of the filters at two neighbouring steps changes what these two remove and
   what is kept between them, nothing else, so only these are read anew from the cells; what each filter removes is added up along the walk, which gives its Shapley sum.

Texts never leave their rows: what is shuffled is a checksum, an id and small numbers.  Rows that share text and id are counted before, so a text that a third of all documents
have is as many partial counts as it has parts, labels and tasks.  Parts are walked side by side, ``PARTS`` in a block.

Defined results
* a null text is the empty one, a null part the empty string; both have cells like any other;
* ids that repeat: rows with the smallest id of a text don't fail E, all others of that text do; a null id is no smaller one and has none;
* labels of an id that has several rows in ``labels`` count as 1 if any of them is 1; without labels, or with null ones, a document is neither good nor toxic;
* an empty table gives no rows; other columns are ignored, clashing names too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.scratch import stage

FILTERS = "ABCDE"
#: Parts that are walked side by side.
PARTS = 64
ROWS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def own_failures(text: Column, own: Column) -> list[Column]:
    """Failures A to D of a text and its words, a plain column each."""
    n, distinct = F.size(own), F.size(F.array_distinct(own))
    return [n < 50, 100 * distinct < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of a part that fail exactly the filters of a mask (bit 0 is A)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = base.withColumn("own", words(F.col("text")))
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(own_failures(F.col("text"), F.col("own")))]
    rows = split.select("doc_id", "part", F.sha2("text", 256).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    # rows that share id and text are one from here on
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    known = rows.where("doc_id IS NOT NULL").join(marks.hint("merge"), "doc_id", "left").na.fill(0, ["quality", "toxic"])
    every = known.unionByName(rows.where("doc_id IS NULL").withColumns({c: F.lit(0) for c in ("quality", "toxic")}))
    # by text: how many rows, and the smallest id with its rows
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    counts = [F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), least]
    # written once, so that the two readings below don't read the texts twice
    by_text = stage(every.groupBy("digest", "part", "mask", "quality", "toxic").agg(*counts), "texts-by-part")
    firsts = by_text.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    met = by_text.join(firsts.hint("merge"), "digest")
    new = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), new.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - new).alias("n")))
    counted = met.select("part", "quality", "toxic", F.inline(both)).groupBy("part", "mask")
    return counted.agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("quality", "toxic")]).withColumnsRenamed({"quality": "good"})


def plain_changes(size: int) -> Iterator[int]:
    """Places ``k`` whose item changes with the one behind it, so that all orders of ``size`` items come by: the last item runs through an order of
    the others, one of which changes each time that it has come to an end."""
    if size < 2:
        return
    inner = plain_changes(size - 1)
    down = True
    while True:
        yield from range(size - 2, -1, -1) if down else range(size - 1)
        step = next(inner, None)
        if step is None:
            return
        # the last item stands in front of the others, or behind them
        yield step + 1 if down else step
        down = not down


def disjoint(counts: np.ndarray) -> np.ndarray:
    """Of ``counts`` (parts, 32 masks): for each set of filters what fails none of them."""
    sets = np.arange(32)
    clear = (sets[:, None] & sets[None, :]) == 0
    return counts @ clear.T.astype(np.int64)


def walk(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> tuple[list[str], dict[str, np.ndarray]]:
    """Orders as they are visited and, for each part, order and step, the figures of the audit; cells are arrays (parts, 32)."""
    size = len(FILTERS)
    left, left_good, left_toxic = disjoint(n), disjoint(good), disjoint(toxic)
    masks = np.arange(1 << size)
    fails = np.stack([n[:, masks >> f & 1 == 1].sum(1) for f in range(size)], 1)
    alone = np.stack([n[:, 1 << f] for f in range(size)], 1)
    order = list(range(size))
    before = [(1 << k) - 1 for k in range(size + 1)]  # filters in front of each step
    now = {c: np.zeros((len(n), size), np.int64) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
    by_filter = np.zeros((len(n), size), np.int64)  # what each filter removes in the order that is visited

    def read(k: int) -> None:
        a, b, f = before[k], before[k + 1], order[k]
        now["kept"][:, k], now["removed"][:, k] = left[:, b], left[:, a] - left[:, b]
        now["redundant"][:, k], now["unique_fails"][:, k] = fails[:, f] - now["removed"][:, k], alone[:, f]
        now["good_lost"][:, k], now["toxic_lost"][:, k] = left_good[:, a] - left_good[:, b], left_toxic[:, a] - left_toxic[:, b]
        by_filter[:, f] = now["removed"][:, k]

    for k in range(size):
        read(k)
    names, seen, filters, shapley = [], [], [], by_filter.copy()
    swaps = plain_changes(size)
    while True:
        names.append("".join(FILTERS[f] for f in order))
        filters.append(list(order))
        seen.append({c: a.copy() for c, a in now.items()})
        k = next(swaps, None)
        if k is None:
            break
        order[k], order[k + 1] = order[k + 1], order[k]
        before[k + 1] = before[k] | 1 << order[k]
        read(k)
        read(k + 1)
        shapley += by_filter
    out = {c: np.stack([s[c] for s in seen], 1) for c in now}
    return names, out | {"shapley": shapley[:, np.array(filters)]}


def audit(cells_: DataFrame) -> DataFrame:
    """Rows of the audit from ``part, mask, n, good, toxic``."""
    own = F.map_from_entries(F.collect_list(F.struct("mask", F.array("n", "good", "toxic"))))  # 32 at most
    filled = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.coalesce(F.try_element_at(F.col("own"), m), F.array(*[F.lit(0).cast("long")] * 3)))
    parts = cells_.groupBy("part").agg(own.alias("own")).select("part", F.flatten(filled).alias("cells"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                part = batch.slice(at, PARTS)
                counts = part.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, 32, 3)
                names, figures = walk(*(counts[:, :, k] for k in range(3)))
                each = len(names) * len(FILTERS)
                row = np.repeat(np.arange(part.num_rows), each)
                out = {
                    "part": part.column("part").take(pa.array(row)),
                    "filter_order": pa.array(np.tile(np.repeat(np.array(names, object), len(FILTERS)), part.num_rows), pa.string()),
                    "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names) * part.num_rows)),
                }
                yield pa.RecordBatch.from_pydict(out | {c: pa.array(a.reshape(-1)) for c, a in figures.items()})

    return parts.mapInArrow(run, ROWS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the five filters over all ``documents``, by source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit(cells(docs, labels))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), g AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (
  SELECT unnest(range(5)) AS k
), o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
  SELECT array_to_string(list_transform(ks, lambda k: substr('ABCDE', (k + 1)::INT, 1)), '') AS filter_order, step,
    (1 << ks[step])::INT AS bit, coalesce(list_sum(list_transform(ks[1:step - 1], lambda k: 1 << k)), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""
