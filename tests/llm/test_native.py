"""The native operators: odd tables, and what SQL over the driver's tables doesn't show."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from cardloom.llm import chat_format, exact_dedup, quality_rules, sharding
from cardloom.llm.scratch import fresh_path

DOCS = [(5, "a b", "s", 1), (3, "a\t b", "s", 2), (3, "a\n\nb", "s", 3), (9, None, None, 4), (8, "", "s", 5), (None, "", "s", 6), (2, "x " * 60000, "s", 7)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string, kept int")


def test_exact_dedup(spark, docs):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), buckets=3)
    rows = index.ingest(docs).collect()
    assert len(rows) == len(DOCS)
    by_text = defaultdict(list)
    for r in rows:
        by_text[bytes(r.digest)].append(r)
    assert sorted((len(g), sum(r.kept for r in g), g[0].keep_id, g[0].group_size) for g in by_text.values()) == [(1, 1, 2, 1), (3, 1, 3, 3), (3, 1, 8, 3)]
    assert hashlib.sha256(b"a b").digest() in by_text
    # a second batch meets what the first has kept, also through an index that is opened again
    again = exact_dedup.DigestIndex(spark, index.path, buckets=7)
    assert again.buckets == 3
    later = spark.createDataFrame([(1, "a  b"), (20, "new"), (21, "new")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again.ingest(later).collect()) == [(1, 3, False), (20, 20, True), (21, 20, False)]
    assert again.ingest(later.limit(0)).count() == 0


def test_a_batch_that_comes_again_gets_its_verdict(spark, docs):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), buckets=2)
    verdict = lambda name: sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in index.ingest(docs, batch=name).collect())
    once = verdict("monday")
    assert sum(r[3] for r in once) == 3
    assert verdict("monday") == once and not any(r[3] for r in verdict("tuesday"))
    before = sorted(map(tuple, index.entries().collect()))
    index.compact()
    assert sorted(map(tuple, index.entries().collect())) == before and verdict("monday") == once
    again = exact_dedup.DigestIndex(spark, index.path)
    assert (again.folder, again.buckets) == (index.folder, 2)
    index.close()
    assert not spark.catalog.tableExists(index.table)


def test_the_index_is_joined_as_it_lies(spark, docs):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), buckets=4)
    index.ingest(docs).collect()
    batch = spark.createDataFrame([(b"x",)], "digest binary")
    for how in ("left_anti", "inner"):
        plan = batch.join(index.entries().hint("merge"), "digest", how)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 4 out of 4" in plan


def test_user_columns_survive(spark):
    data = spark.createDataFrame([(1, "a", "x", "y"), (2, "a", "z", "u"), (1, "a", "v", "w")], "doc_id long, text string, __digest string, drop_id string")
    kept = exact_dedup.drop_duplicates(data)
    assert kept.columns == data.columns and [r["__digest"] in "xv" for r in kept.collect()] == [True]


def test_drop_duplicates(docs):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 8]


def jump(key, shards):
    key, at, to = key % (1 << 64), -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        to = int((at + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return at


def test_shards_are_jump_hashes(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 4000, 7)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9):
        got = rows.select("k", sharding.shard_of(sharding.jump_path(rows["k"], n), n).alias("s")).collect()
        assert {r.k: r.s for r in got} == {k: jump(k, n) for k in keys}


def test_sharding(docs):
    rows = sharding.assign_shards(docs, 2).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in DOCS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 2)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_chat(spark):
    turns = [
        (1, 1, "assistant", "x\\y <|im_end|> \\| \\\\<|"),
        (1, 0, "user", None),
        (2, 0, "ro\nle<|", "\n"),
        (2, 1, None, "z\\"),
        (None, 0, "system", ""),
        (None, 1, "user", "q" * 100000),
    ]
    rows = chat_format.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = rows.withColumn("turns", chat_format.parse(rows["formatted"])).withColumn("trained", chat_format.loss_text(rows["segments"]))
    got = {r.conv_id: r for r in rows.collect()}
    for c, r in got.items():
        own = [((x[2] or ""), (x[3] or "")) for x in sorted((t for t in turns if t[0] == c), key=lambda t: t[1])]
        assert [tuple(t) for t in r.turns] == own
        assert r.trained == "".join(t for role, t in own if role == "assistant")
    assert (got[1].valid, got[2].valid, got[2].bad_turn, got[None].valid) == (True, False, 0, True)
    assert rows.limit(0).count() == 0


def plain_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(hit)


def test_quality(spark, docs):
    texts = [" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i % 9}" for i in range(40)), "#a $b\n#a $b\n \n \nc", "same " * 30, *[t for _, t, _, _ in DOCS[:-1]]]
    rows = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality_rules.judge(rows).collect():
        words = (texts[r.doc_id] or "").split()
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), plain_repeats(words), sum(map(len, words)))
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
    assert quality_rules.judge(docs.limit(0)).count() == 0
    assert quality_rules.judge(docs).count() == len(DOCS)


def test_a_bad_host_goes_and_a_small_one_does_not(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    data = [("good", good)] * 90 + [("bad", bad)] * 80 + [("bad", good)] * 10 + [("small", bad), ("small", good)]
    data = [(i, t, h) for i, (h, t) in enumerate(data)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert all(i in kept for i, t, h in data if h == "good")
    assert not any(i in kept for i, t, h in data if h == "bad")
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == kept


def test_sql_agrees_where_hosts_fail(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(30))
    data = [(i, "short" if i % 10 else good, "bad") for i in range(60)] + [(100 + i, good if i % 5 else None, "good") for i in range(60)] + [(200, "short", None), (201, good, "small")]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(con.execute(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE})").fetchall())
    got = {r.doc_id: r.kept for r in quality_rules.op8_quality_rules(spark, str(tmp_path)).collect()}
    assert got == want and not got[0] and got[101] and len(got) == len(data)


def test_a_clean_text_stays_beside_a_rejected_one_of_its_id_and_length(spark):
    good, bad = " ".join(f"w{i:03}" for i in range(30)), "same " * 30
    assert len(good.replace(" ", "")) == len(bad.replace(" ", ""))
    rows = [(None, good, "h"), (None, bad, "h"), (7, bad, "h"), (7, good, "h"), *((i, good + str(i), "h") for i in range(100, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = quality_rules.keep_good(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t, _ in rows if t != bad)
