"""Votes as streaming state: the text variants of a document come in any number of batches, and its record is that of one batch.

What each variant says is read by Column functions as it arrives, for every kind of card, since the kind is only known with the best variant.  The state of a document
is what a vote needs and no more: how often each value of each field was read and by which variant first in rank, and what the best variant reads, which counts twice.  Texts are not kept.

A document is closed when nothing new has come for ``quiet`` milliseconds: a timer gives its counts out, and the records of a batch are settled from them by the same code as in
:func:`cardloom.operators.records.build_records`.  The state stays for ``keep`` milliseconds more.  A variant that comes late is counted in and closes the document again, as its next
revision; one that comes when the state has gone begins a new document, revision 1.

Defined results
* a reading that comes again, same document, label and mode, is counted once, whatever its text; so a file that is delivered twice changes nothing;
* a null text is empty; a null id is a document like any other, and null labels and modes rank as ``''`` and -1;
* ties of votes go by score, label and mode of the variants, as in a batch, where a batch of texts has one text for each label and mode.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cardloom.functions import addresses as ax
from cardloom.functions import fields as fx
from cardloom.functions import names as nx
from cardloom.functions.text import clean_text, first_of, strip
from cardloom.operators import records
from cardloom.streaming.drop_folder import TEXTS

#: Kinds that a reading is for: family cards, all others, one kind alone, or any.
FAMILY, OTHERS, ANY = "kk", "!kk", ""
FOUND = "doc_id bigint, revision int, field string, value string, ord bigint, weight bigint"
_PLACE = "score int, label string, psm int"
_READ = "field string, kinds string, value string, late int"
STATE = (
    f"seen array<struct<label string, psm int>>, counts array<struct<field string, kinds string, value string, n bigint, late int, {_PLACE}>>, "
    f"best struct<{_PLACE}, kind string, votes array<struct<{_READ}>>, alone array<struct<{_READ}>>>, "
    f"elsewhere struct<{_PLACE}, value string, below boolean>, revision int, is_open boolean, due bigint"
)


def _reading(field: str, kinds: str, value: Column, late: int = 0) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(kinds).alias("kinds"), F.coalesce(value, F.lit("")).alias("value"), F.lit(late).alias("late"))


def readings(texts: DataFrame) -> DataFrame:
    """One row per variant: ``doc_id, score, label, psm, kind``, its ``votes``, what it says if it is the best (``alone``), and its address elsewhere on a licence."""
    scored = records.score_variants(texts).withColumn("text", clean_text(F.col("text")))
    text = F.col("text")
    below = ax.licence_address_below_gender(text)
    rows = scored.withColumn("below", below).withColumn("beside", F.when(F.col("below") == "", ax.licence_address_elsewhere(text)).otherwise(""))
    place = fx.birth_place(text)
    votes = [_reading(f, FAMILY, read(text)) for f, read in records.FAMILY.items()]
    votes += [_reading(f, OTHERS, read(text)) for f, read in records.OTHERS.items() if f != "tempat_lahir"]
    votes += [
        _reading("tempat_lahir", OTHERS, F.when(F.length(place) > 2, place)),
        _reading("no_sim", "sim", fx.licence_number(text)),
        _reading("nama", OTHERS, nx.plausible(fx.name_from_label(text))),
        *[_reading("nama", kind, nx.unlabelled_name(text, F.lit(kind)), 1) for kind in ("ktp", "sim")],
        _reading("alamat_sim", "sim", F.col("below")),
    ]
    kind = F.when(strip(text) == "", "unknown").otherwise(fx.classify(text))
    alone = [_reading("alamat", OTHERS, fx.address(text)), _reading("jenis_kelamin", OTHERS, fx.gender(text))]
    filled = lambda rows: F.filter(F.array(*rows), lambda r: r["value"] != "")
    address = F.struct(first_of(F.col("below"), F.col("beside")).alias("value"), (F.col("below") != "").alias("below"))
    label, psm = F.coalesce("label", F.lit("")).alias("label"), F.coalesce("psm", F.lit(-1)).alias("psm")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("score").cast("int").alias("score"), label, psm, kind.alias("kind"), filled(votes).alias("votes"), filled(alone).alias("alone"), address.alias("address"))


def _plain(x: Any) -> Any:
    """Structs, which come as rows or as dictionaries, as tuples."""
    if isinstance(x, list):
        return [_plain(y) for y in x]
    return tuple(_plain(y) for y in (x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, tuple)) else x


class Votes(StatefulProcessor):
    """Counts of one document at a time; one read and one write of its state for each batch that has something of it."""

    def __init__(self, quiet: int, keep: int):
        self.quiet, self.keep = quiet, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("votes", STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = _plain(self.state.get()) if self.state.exists() else None
        seen, counts, best, elsewhere, revision, is_open, due = old or ([], [], None, None, 0, False, 0)
        seen = set(seen)
        counts = {c[:3]: [c[3], (c[5:], -c[4])] for c in counts}
        new = 0
        for row in rows:
            if (row["label"], row["psm"]) in seen:
                continue
            new += 1
            seen.add((row["label"], row["psm"]))
            place = (row["score"], row["label"], row["psm"])
            read, alone = _plain(row["votes"]), _plain(row["alone"])
            for field, kinds, value, late in read:
                own = counts.setdefault((field, kinds, value), [0, (place, -late)])
                own[0] += 1
                own[1] = max(own[1], (place, -late))
            if best is None or place > best[:3]:
                best = (*place, row["kind"], read, alone)
            if row["address"]["value"] and (elsewhere is None or place > elsewhere[:3]):
                elsewhere = (*place, row["address"]["value"], row["address"]["below"])
        if new:
            if old:
                self.handle.deleteTimer(due)
            due = int(timerValues.getCurrentProcessingTimeInMs()) + self.quiet
            self.handle.registerTimer(due)
            kept = [(*what, n, -late, *place) for what, (n, (place, late)) in counts.items()]
            self.state.update((sorted(seen), kept, best, elsewhere, revision, True, due))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        seen, counts, best, elsewhere, revision, is_open, _ = _plain(self.state.get())
        if not is_open:
            self.state.clear()
            return
        due = int(timerValues.getCurrentProcessingTimeInMs()) + self.keep
        self.handle.registerTimer(due)
        self.state.update((seen, counts, best, elsewhere, revision + 1, False, due))
        yield from (Row(doc_id=key[0], revision=revision + 1, field=f, value=v, ord=o, weight=n) for f, v, o, n in closed(counts, best, elsewhere))


def closed(counts: list[tuple], best: tuple, elsewhere: tuple | None) -> Iterator[tuple[str, str, int, int]]:
    """``field, value, ord, weight`` of a document's votes, as :func:`records.candidates` would give them, added up."""
    kind = best[3]
    holds = lambda kinds: kinds in (ANY, kind) or kinds == OTHERS and kind != FAMILY
    own: dict[tuple[str, str], list] = {}
    for field, kinds, value, n, late, *place in counts:
        if holds(kinds):
            vote = own.setdefault((field, value), [0, (tuple(place), -late)])
            vote[0] += n
            vote[1] = max(vote[1], (tuple(place), -late))
    for field, kinds, value, _ in best[4]:
        if holds(kinds):
            own[field, value][0] += 1
    if kind == "sim" and elsewhere and not elsewhere[4]:
        # counts once, as no variant of a higher rank has an address
        vote = own.setdefault(("alamat_sim", elsewhere[3]), [0, (elsewhere[:3], 0)])
        vote[0] += 1
        vote[1] = max(vote[1], (elsewhere[:3], 0))
    ranks = {place: i for i, place in enumerate(sorted({v[1] for v in own.values()}, reverse=True), 1)}
    for (field, value), (n, place) in own.items():
        yield field, value, ranks[place], n
    for field, kinds, value, _ in [*best[5], ("jenis_dokumen", ANY, kind, 0)]:
        if holds(kinds):
            yield field, value, 1, 2


def stream_votes(texts: DataFrame, quiet: int, keep: int) -> DataFrame:
    """Votes (``doc_id, revision, field, value, ord, weight``) of documents as they close; ``texts`` is a stream of ``doc_id, label, psm, text``."""
    return readings(texts).groupBy("doc_id").transformWithState(Votes(quiet, keep), FOUND, "Append", "ProcessingTime")


def settled_records(found: DataFrame) -> DataFrame:
    """Records of the closed documents of a batch, with their ``revision``."""
    revision = found.groupBy("doc_id").agg(F.max("revision").alias("revision"))
    return records.judged(records.settle(found).join(revision, F.lit(True) & found["doc_id"].eqNullSafe(revision["doc_id"])).drop(revision["doc_id"]))


def run_name(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def stream_revisions(spark: SparkSession, source: str, target: str, checkpoint: str, quiet: int = 60_000, keep: int = 3_600_000, every: str = "10 seconds") -> StreamingQuery:
    """Records of documents whose variants come as Parquet files below ``source``, in any number of them, are written to ``target`` as they close.

    State lies in RocksDB, on disk beside the executors and in ``checkpoint``; the setting that asks for it is the session's.  A batch that is run again overwrites its own folder.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = f"{target}/run={run_name(checkpoint)}"

    def write(batch: DataFrame, number: int) -> None:
        settled_records(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    found = stream_votes(spark.readStream.schema(TEXTS).parquet(source), quiet, keep)
    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def latest_records(spark: SparkSession, target: str, checkpoint: str) -> DataFrame:
    """The last revision of each document that the run of ``checkpoint`` has written."""
    rows = spark.read.parquet(f"{target}/run={run_name(checkpoint)}")
    last = Window.partitionBy("doc_id").orderBy(F.desc("batch"), F.desc("revision"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch")
