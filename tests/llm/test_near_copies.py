import random

import numpy as np

import corpus_pipeline
from cardloom.llm import near_copies, simhash


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Rows that stay, by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if 9 * len(sets[i] & sets[k]) >= 4 * (len(sets[i]) + len(sets[k])):
                root[find(i)] = find(k)
    best = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        best[find(i)] = min(best.get(find(i), (True, 1 << 62)), key)
    return sorted((d is None, d or 0) for i, (d, _) in enumerate(rows) if (d is None, d or 0) == best[find(i)])


def corpus(seed):
    """Texts of many lengths, a common passage, and copies with one to many words changed, near 0.8 on both sides."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice((3, 20, 60, 250, 900)))] + common * rng.randrange(2)
        texts.append(base)
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for i in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 35))):
                copy[i] = word()
            texts.append(copy)
    hub = [word() for _ in range(200)]
    for _ in range(60):  # copies of one text, not all within reach of each other
        texts.append([word() if rng.random() < 0.015 else w for w in hub])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_a_long_text_with_a_few_words_changed_is_dropped(spark):
    words = [f"w{i}" for i in range(250)]
    other = list(words)
    for i in (20, 90, 140, 210):
        other[i] = "new"
    docs = spark.createDataFrame([(1, " ".join(words), "s"), (2, " ".join(other), "s"), (3, " ".join(reversed(words)), "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [1, 3]


def test_kept_rows_equal_all_pairs(spark, monkeypatch):
    for seed, leaders in ((1, 8), (2, 1)):
        monkeypatch.setattr(near_copies, "LEADERS", leaders)
        monkeypatch.setattr(near_copies, "SAMPLE", leaders)
        rows = corpus(seed)
        want = plain_kept(rows)
        assert 40 < len(want) < len(rows) - 60
        got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == want


def test_empty_and_short(spark):
    docs = spark.createDataFrame([(5, None, "a"), (3, "", "b"), (8, " \n", "c"), (7, "one two three four five six", "d"), (9, "ONE two\tthree four five six", "f"), (2, "w " * 5000, "g")], "doc_id long, text string, root string")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 7]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    """Each row is judged by its own text, whatever rows share its id."""
    words = lambda k: [f"{k}-{i}" for i in range(100)]
    near = lambda k: " ".join([*words(k)[:99], "end"])
    full = lambda k: " ".join(words(k))
    rows = [(1, full("a")), (None, near("a")), (None, full("b")), (2, full("c")), (5, near("c")), (5, full("d")), (None, full("e")), (None, near("e")), (5, full("f")), (5, near("f"))]
    docs = spark.createDataFrame([(i, t, t.split("-")[0]) for i, t in rows], "doc_id long, text string, kind string")
    for keep, bits in ((near_copies.keep_one, ()), (simhash.keep_one, ("doc_id", "text", 5))):
        kept = sorted((r.kind, r.doc_id) for r in keep(docs, *bits).collect())
        assert kept == [("a", 1), ("b", None), ("c", 2), ("d", 5), ("e", kept[4][1]), ("f", 5)]


def crowd(m, seed=5):
    """Copies of one text with two to four of its 150 words changed: most of them are a little too different from each other."""
    rng = random.Random(seed)
    hub, rows = [f"h{i}" for i in range(150)], []
    for d in range(m):
        copy = list(hub)
        for i in rng.sample(range(150), rng.choice((2, 3, 3, 4))):
            copy[i] = f"n{rng.randrange(300)}"
        rows.append((d, " ".join(copy)))
    return rows


def test_a_crowd_of_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    rows, compared, similar = crowd(400), [], near_copies.similar

    def counted(pairs, texts):
        compared.append(pairs.count())
        return similar(pairs, texts)

    monkeypatch.setattr(near_copies, "similar", counted)
    monkeypatch.setattr(near_copies, "SAMPLE", 4)
    monkeypatch.setattr(near_copies, "CROWD", 16)
    want = plain_kept(rows)
    assert 100 < len(want) < 390
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == want
    assert sum(compared) < 40 * len(rows)  # all pairs are 200 for each row


def test_first_differences_meet_for_all_near_copies():
    """Of two sets with similarity 0.8 or more, each cut at what its difference from a third allows, both are near the third or share one at which there is room."""
    rng = np.random.default_rng(3)
    frequent = np.arange(0, 150, 2)
    ranks, met, far = rng.permutation(len(frequent)), 0, 0
    for _ in range(400):
        sets = []
        for _ in range(3):
            own = set(range(150)) - set(rng.choice(150, rng.integers(0, 30), replace=False).tolist())
            sets.append(np.array(sorted(own | set(rng.choice(60, rng.integers(0, 20), replace=False) + 150))))
        x, y, c = sets
        d, e = (len(np.setxor1d(s, c)) for s in (x, y))
        if 9 * len(np.setxor1d(x, y)) > len(x) + len(y):
            far += 1
        elif not (9 * d <= len(x) + len(c) and 9 * e <= len(y) + len(c)):
            first = [near_copies.difference_prefix(np.setdiff1d(s, c), np.setdiff1d(c, s), len(s), frequent, ranks).tolist() for s in (x, y)]
            both, more = len(x) + len(y), 9 * (d - e)
            assert any(18 * first[0].index(s) <= both + more and 18 * first[1].index(s) <= both - more for s in set(first[0]) & set(first[1]))
            met += 1
    assert met > 10 and far > 100
