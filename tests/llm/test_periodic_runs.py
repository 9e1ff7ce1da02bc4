import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cardloom.llm import periodic_runs as pr


def plain_runs(words):
    """(start, length, period) by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(24, 3 * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(kept)))


def made_up(rng, n, alphabet):
    words = [rng.randrange(alphabet) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 30:
            a = rng.randrange(n)
            p, b = 1 + rng.randrange((n - a) // 3 + 1), rng.randrange(a, n + 1)
            words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
    return words


def test_runs_are_those_of_all_periods_at_all_places():
    rng = random.Random(1)
    for _ in range(120):
        texts = [made_up(rng, rng.choice([0, 1, 5, 23, 24, 30, 60, 120, 200]), rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(1, 6))]
        got = pr.runs_of([np.array(t, np.int64) for t in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in texts]


def test_words_with_many_runs_inside_each_other():
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 800:
        fibonacci, before = fibonacci + before, fibonacci
    squares = ([0] * 30 + [1]) * 5
    got = pr.runs_of([np.array(x, np.int64) for x in (fibonacci, squares, [0] * 5000)])
    assert [tuple(r) for r in got[0].tolist()] == plain_runs(fibonacci)
    assert [tuple(r) for r in got[1].tolist()] == plain_runs(squares) and len(got[1]) == 6
    assert got[2].tolist() == [[0, 5000, 1]]


def test_screen_lets_no_repeat_through():
    rng = random.Random(2)
    for n in (16, 17, 31, 32, 40, 100):
        words = [rng.randrange(1000) for _ in range(n)]
        again = words + words[:16] if n >= 16 else words
        assert pr.repeats([np.array(again, np.int64), np.array([7], np.int64)]).tolist() == [True, False]


@pytest.fixture(scope="module")
def odd(spark):
    block = "a b\tc\vd e\n"
    texts = [None, "", " \n\t", "x " * 24, "x " * 23, block * 9, "é\x85 ß\xa0 " * 40, "un " * 70000 + "end", " ".join(map(str, range(300)))]
    rows = [(i, t, "clash") for i, t in enumerate(texts * 4)] + [(None, block * 9, None), (3, "x " * 24, None)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(3)


def test_digests_of_odd_tables(spark, odd):
    rows, docs = odd
    # trying all periods takes too long on the longest text
    got = [tuple(r) for r in pr.digests(docs, planted=True).collect()]
    short = [(i, t) for i, t, _ in rows if len(t or "") < 5000]
    assert sorted((g for g in got if g[0] is None or g[0] % 9 != 7), key=repr) == sorted((plain_row(*r) for r in short), key=repr)
    assert len(got) == len(rows)
    (plain,) = pr.digests(docs.where("doc_id = 7")).collect()
    assert tuple(plain)[1:6] == (1, 0, 70000, 1, 70_000_000)
    assert pr.digests(docs.limit(0)).count() == 0


def test_digests_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(tuple, pr.digests(docs, planted=True).collect())) == sorted(plain_row(i, t) for i, t in rows)


def test_runs_and_collapsed_texts(spark, odd):
    rows, docs = odd
    found = sorted(map(tuple, pr.runs(docs.where("doc_id = 5")).collect()))
    assert found == [(5, 0, 45, 5)]
    kept = pr.collapse(docs)
    assert kept.columns == docs.columns
    by_id = {r["doc_id"]: r["text"] for r in kept.where("doc_id < 9").collect()}
    assert by_id[0] is None and by_id[1] == "" and by_id[2] == " \n\t"
    assert by_id[3] == "x" and by_id[4] == "x " * 23 and by_id[5] == "a b c d e" and by_id[7] == "un end"
    assert kept.count() == len(rows)
