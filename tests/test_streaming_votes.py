import time

import pytest
from pyspark.sql import functions as F

from cardloom.operators import records
from cardloom.plans import cards
from cardloom.streaming import votes
from cardloom.streaming.drop_folder import TEXTS

LICENCE = "SURAT IZIN MENGEMUDI\nPOLRI\n1223-0301-000680\nNama : {}\n{}\nGolongan : B1"


@pytest.fixture(scope="module")
def texts(spark):
    made = cards.cards(spark, "/root/testdata/sf0.001").select("doc_id", F.concat(F.lit("v"), "variant").alias("label"), F.lit(6).alias("psm"), "text")
    # licences whose address stands elsewhere in some variants and below the gender in others, an empty document, and one without texts but null
    ways = ["JL MERDEKA NO 1", "LAKI-LAKI\nGANG DUA RAYA", "3. JL SUDIRMAN NO 4", "x", "JL MERDEKA NO 1"]
    more = [(9000 + d, f"v{v}", 6, LICENCE.format("Sri Rejeki", ways[(v * (d + 1) + d) % 5])) for d in range(5) for v in range(5)]
    more += [(9100, "v0", 6, ""), (9101, "v1", 3, None), (None, "v0", 6, LICENCE.format("Budi Santoso", ways[0]))]
    return made.unionByName(spark.createDataFrame(more, TEXTS)).withColumn("psm", F.col("psm").cast("int")).persist()


def rows_of(df, *without):
    names = sorted(c for c in df.columns if c not in without)
    return sorted(map(repr, df.select(*names).collect()))


def test_closed_votes_are_the_batch_votes(spark, texts):
    """The state's arithmetic alone, without a stream: each document's variants in an order of their own."""
    class Held:
        def __init__(self):
            self.value, self.timers = None, []

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

        def clear(self):
            self.value = None

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    out, early, left_out = [], [], []
    groups = {}
    for r in votes.readings(texts).orderBy(F.xxhash64("doc_id", "label")).collect():
        groups.setdefault(r["doc_id"], []).append(r)
    for doc_id, own in groups.items():
        state, held = votes.Votes(5, 7), Held()
        state.init(held)
        take = lambda rows: [*state.handleInputRows((doc_id,), iter(rows), Clock())]
        expire = lambda: [*state.handleExpiredTimer((doc_id,), Clock(), None)]
        on_time = own[:-1] if len(own) > 1 and (doc_id or 0) % 2 else own
        for part in (on_time[:1], on_time[:3], on_time[1:], on_time):
            assert take(part) == []
        assert held.timers == [1005]
        held.timers.clear()
        rows = expire()
        assert held.timers == [1007] and {r["revision"] for r in rows} == {1}
        if on_time != own:
            # late: counted in, and closed once more
            early += rows
            assert take(own) == [] and held.timers == [1005]
            held.timers.clear()
            rows = expire()
            assert held.timers == [1007] and {r["revision"] for r in rows} == {2}
            left_out.append((doc_id, own[-1]["label"]))
        out += rows
        # what was counted before changes nothing
        assert take(own) == [] and held.timers == [1007]
        assert expire() == [] and held.value is None
    got = votes.settled_records(spark.createDataFrame(out, votes.FOUND))
    assert rows_of(got, "revision") == rows_of(records.build_records(texts))
    late = spark.createDataFrame(left_out, "doc_id bigint, label string")
    before = texts.join(late.select("doc_id"), "doc_id", "left_semi").join(late, ["doc_id", "label"], "left_anti").select(texts.columns)
    assert rows_of(votes.settled_records(spark.createDataFrame(early, votes.FOUND)), "revision") == rows_of(records.build_records(before))


def test_variants_of_three_batches_and_repeated_files(spark, texts, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    put = lambda rows: rows.coalesce(1).write.mode("append").parquet(source)
    some = texts.where("doc_id IN (4, 8, 9, 10, 12, 9000, 9001, 9100)").persist()
    part = lambda *labels: some.where(F.col("label").isin(*labels))
    put(part("v0"))
    query = votes.stream_revisions(spark, source, target, checkpoint, quiet=30_000, keep=120_000, every="1 second")

    def taken(rows, most=60):
        """Until so many rows have been read."""
        began = time.time()
        while sum(p.numInputRows for p in query.recentProgress) < rows:
            assert query.isActive and time.time() - began < most, query.exception()
            time.sleep(0.5)

    def closed(documents, most=120):
        """Records as soon as so many documents have one."""
        began = time.time()
        while query.isActive and time.time() - began < most:
            try:
                rows = votes.latest_records(spark, target, checkpoint).collect()
                if len(rows) >= documents:
                    return rows
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
            time.sleep(1)
        raise AssertionError(f"not closed: {query.exception()}")

    try:
        taken(8)
        put(part("v1", "v2"))
        taken(22)
        put(part("v0", "v2"))  # delivered again
        put(part("v3"))
        last = closed(8)
        assert {r["revision"] for r in last} == {1}
        want = records.build_records(some.where("label <> 'v4'"))
        # one that came in one variant only was closed before the others
        assert rows_of(spark.createDataFrame(last, votes.latest_records(spark, target, checkpoint).schema), "revision") == rows_of(want)
    finally:
        query.stop()
