import random

import numpy as np
import xxhash

from cardloom.llm import simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{(id, fp): smallest id} by comparing all pairs."""
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        r = find(f)
        least[r] = min(least.get(r, i), i)
    return {(i, f): least[find(f)] for i, f in rows}


def test_fingerprint_is_the_plain_one():
    for t in (None, "", " \t\n", "One", "a b c", "A b C d", "a b c d e f\va b\x85c É é " * 9, "x " * 70000):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_linked_fingerprints_meet_at_an_anchor():
    rng = random.Random(3)
    for _ in range(500):
        x = y = rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            y ^= 1 << b
        for bits in range((x ^ y).bit_count(), 6):
            row, key, home = simhash.anchors(np.array([x, y], np.uint64), bits)
            at = [set(key[row == i]) for i in (0, 1)]
            homes = [set(key[(row == i) & home]) for i in (0, 1)]
            assert homes[0] & at[1] or homes[1] & at[0]


def test_comparisons_at_anchors_are_few():
    """Pairs with one at home in the cell, for random fingerprints: about 1 in 70,000 of all pairs."""
    n = 100_000
    row, key, home = simhash.anchors(np.random.default_rng(1).integers(0, 1 << 64, n, dtype=np.uint64))
    assert len(row) < 46 * n
    cells, at, size = np.unique(key, return_inverse=True, return_counts=True)
    homes = np.bincount(at, home, len(cells))
    pairs = (homes * (homes - 1) / 2 + homes * (size - homes)).sum()
    assert pairs < n * n / 65_000


def test_golay_code_is_perfect():
    unit, table, count = simhash.golay()
    weights = [int(x).bit_count() for x in table[:, 0]]
    assert [weights.count(w) for w in range(4)] == [1, 23, 253, 1771] and len(weights) == 2048


def test_groups_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps[:20]):  # chains of near fingerprints, and one dense group
        for _ in range(5):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.append(f)
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    rows = [(i, f) for i, f in enumerate(fps)] + [(1000 + i, f) for i, f in enumerate(fps[::7])]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    want = plain_components(rows)
    for homes, guests, sample, tiny in ((8192, 32768, 64, 64), (4, 8, 1, 3)):
        monkeypatch.setattr(simhash, "HOMES", homes)
        monkeypatch.setattr(simhash, "GUESTS", guests)
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        monkeypatch.setattr(simhash, "TINY", tiny)
        monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(signed, "doc_id long, fp long"))
        got = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in simhash.near_groups(None).collect()}
        assert got == want


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(5, None, "a"), (3, "", "b"), (None, " \n", "c"), (7, "one two three four five six", "d"), (7, "one two three four five six", "e"), (9, "ONE two\tthree four five six", "f"), (2, "w " * 50000, "g")],
        "doc_id long, text string, fp string",
    )
    got = {(r.doc_id, r.fp != 0): r.component_id for r in simhash.near_groups(docs).collect()}
    assert got == {(5, False): 3, (3, False): 3, (None, False): 3, (7, True): 7, (9, True): 7, (2, True): 2}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 7]
    assert simhash.near_groups(docs.limit(0)).count() == 0
