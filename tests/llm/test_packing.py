import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cardloom.llm import best_fit, token_matrix, unit_cache

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_units_have_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(unit_cache, "CACHE_BYTES", 5000)
    monkeypatch.setattr(unit_cache, "LONG", 6)
    rng, library, own = random.Random(2), Tokenizer.from_file(PATH), unit_cache.UnitIds(PATH)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "́", "ß", "Σ", "日", "7", "'s", "'LL", "!", "<|endoftext|>", "<|startof", "😀", "the", "İ", "\r\n", "Word", "Été.", "ab,", "x,."]
    for _ in range(200):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(10)]
        for t, ids in zip(texts, own.encode_batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_long_units_are_not_kept():
    """Texts of a script without blanks are units of their own."""
    own = unit_cache.UnitIds(PATH)
    texts = [chr(0x4E00 + i) * 500 for i in range(20)]
    own.encode_batch(texts)
    assert max(map(len, own.known)) <= unit_cache.LONG and max(map(len, own.words), default=0) <= unit_cache.LONG


def check_places(rows, length):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def test_pack_places_everything(spark):
    rng = random.Random(7)
    for n, length, small in ((0, 64, 8), (1, 64, 8), (400, 64, 8), (400, 64, 64), (300, 64, 0)):
        lengths = [rng.choice([rng.randint(1, 64), rng.randint(20, 40), 33, 5]) for _ in range(n)]
        rows = [(i // 3, 0, x, 5) for i, x in enumerate(lengths)]
        items = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long")
        out = best_fit.pack(items, length, (64,), small).collect()
        assert sorted((r.doc_id, r.length) for r in out) == sorted((a, x) for a, _, x, _ in rows)
        used = check_places(out, length)
        plain = len(token_matrix.best_fit_decreasing(np.array(lengths, int), length))
        assert -(-sum(lengths) // length) <= used <= 1.02 * plain + 1


def test_as_few_sequences_as_best_fit_decreasing(spark, monkeypatch):
    """On the tables' documents; parts of a length are numbered apart."""
    monkeypatch.setattr(best_fit, "PART", 50)
    rows = best_fit.op9_best_fit(spark, "/root/testdata/sf0.01").collect()
    plain = len(token_matrix.best_fit_decreasing(np.array([r.length for r in rows]), best_fit.LENGTH))
    assert check_places(rows, best_fit.LENGTH) <= plain


def worth_of_all(sizes, length):
    """Sums of all configurations of three sizes."""
    a, b, c = sizes
    return [(i, j, k) for i in range(length // a + 1) for j in range(length // b + 1) for k in range(length // c + 1) if i * a + j * b + k * c <= length]


def test_knapsack_finds_the_most_worth():
    rng = random.Random(8)
    for _ in range(30):
        sizes, worth = sorted(rng.sample(range(5, 40), 3), reverse=True), [rng.random() for _ in range(3)]
        best, used = best_fit.priciest(np.array(sizes), np.array(worth), 60)
        want = max(sum(n * w for n, w in zip(c, worth)) for c in worth_of_all(sizes, 60))
        assert abs(best - want) < 1e-9 and abs(used @ np.array(worth) - want) < 1e-9 and used @ np.array(sizes) <= 60


def test_configurations_are_optimised_together():
    # one of each fills a sequence, which no size by itself does
    plan = best_fit.configurations([900, 700, 448], [1000, 1000, 1000], 2048)
    assert plan == [(1000, {0: 1, 1: 1, 2: 1})]
    rng = random.Random(9)
    for _ in range(5):
        sizes = sorted((rng.randint(513, 2047) for _ in range(20)), reverse=True)
        counts = [rng.randint(50, 100) for _ in sizes]
        plan = best_fit.configurations(sizes, counts, 2048)
        used = [0] * 20
        for times, own in plan:
            assert sum(sizes[g] * k for g, k in own.items()) <= 2048
            for g, k in own.items():
                used[g] += times * k
        assert all(u <= n for u, n in zip(used, counts)) and len(plan) <= 20
        # what is left over is less than one more turn of each configuration
        assert sum(n - u for u, n in zip(used, counts)) <= 3 * 20
        assert sum(times for times, _ in plan) <= len(token_matrix.best_fit_decreasing(np.repeat(sizes, counts), 2048))


def test_groups_are_few_and_hold_many(spark):
    """Linear grouping on the lengths of a table: cardinality far above 1, sequences with two or more large pieces."""
    rng = random.Random(10)
    lengths = [rng.randint(1, 2047) for _ in range(6000)]
    counts = {x: lengths.count(x) for x in set(lengths) if x > best_fit.SMALL}
    each, places, _ = best_fit.plan_large(counts, 2048, small={x: lengths.count(x) for x in set(lengths) if x <= best_fit.SMALL})
    assert len({g for g, *_ in places}) <= best_fit.GROUPS[-1] < len(counts) / 10 and each > 30
    held = defaultdict(int)
    for _, _, n, first, k in places:
        held[first] += k
    assert sum(k >= 2 for k in held.values()) > 10


def test_pieces_and_documents(spark):
    long = "word " * 3000
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "a b", 3), (None, "a b", 4), (4, long, 5)], "doc_id long, text string, length int")
    rows = best_fit.pack_documents(docs, PATH, 2048).collect()
    texts = [None, "", "a b", "a b", long]
    want = []
    for d, t in zip([1, 2, 2, None, 4], texts, strict=True):
        ids = [*library_ids(t), 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            want.append((d, k, a, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: (x[0] is None, x)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    check_places(rows, 2048)
    assert best_fit.pack_documents(docs.limit(0), PATH).count() == 0


def test_capacity_tree_finds_the_tightest_row():
    rng, tree, held = random.Random(4), token_matrix.CapacityTree(100), []
    for _ in range(3000):
        if held and rng.random() < 0.5:
            tree.add(held.pop(rng.randrange(len(held))), -1)
        else:
            held.append(rng.randint(0, 100))
            tree.add(held[-1], 1)
        c = rng.randint(0, 100)
        assert tree.at_least(c) == min((x for x in held if x >= c), default=None)


def test_ids_above_two_bytes_take_four(spark, monkeypatch):
    own = token_matrix.unit_ids(PATH)
    monkeypatch.setattr(own, "ends", np.zeros(70_000, bool))
    assert token_matrix.id_bytes(PATH) == 4


def test_the_query_has_position_resets(spark):
    assert "position_ids" in token_matrix.op5_token_matrix(spark, "/root/testdata/sf0.001").columns


def test_binary_rows_read_back(spark, monkeypatch):
    monkeypatch.setattr(token_matrix, "BLOCK_TOKENS", 200)
    rng = random.Random(6)
    data = [(i % 50, "".join(rng.choice(["the ", "cat ", "sat\n", "on "]) for _ in range(rng.randint(0, 90))), i) for i in range(120)] + [(7, None, 0), (8, "w " * 500, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, row_id int")
    packed = token_matrix.pack_rows(docs, PATH, length=64)
    rows = packed.collect()
    assert len({r.row_id for r in rows}) == len(rows)
    for r in rows:
        ids, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert at[a:b].tolist() == list(range(b - a))
    got = defaultdict(list)
    for r in token_matrix.unpack(packed, PATH).collect():
        got[r.doc_id].append((r.start, tuple(r.ids)))
    want = defaultdict(list)
    for d, t, _ in data:
        ids = [*library_ids(t), 0]
        want[d] += [(a, tuple(ids[a : a + 64])) for a in range(0, len(ids), 64)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_matrix.pack_rows(docs.limit(0), PATH).count() == 0
