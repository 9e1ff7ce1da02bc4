"""The whole pipeline against plain Python, on a table with everything odd in it."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
from test_native import plain_repeats
from test_near_copies import plain_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, gone_id long"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def plain_quality(rows):
    """Base rules, and hosts whose shrunk share of failures is above one half."""
    failed = [len(words_of(r[1])) < 20 or 100 * plain_repeats(words_of(r[1])) > 30 * len(words_of(r[1])) for r in rows]
    n, f = Counter(r[3] or "" for r in rows), Counter(r[3] or "" for r, bad in zip(rows, failed, strict=True) if bad)
    total = sum(n.values())
    mean = sum(f.values()) / total
    spread = sum(f[h] ** 2 / n[h] for h in n) / total - mean**2
    noise = mean * (1 - mean) * len(n) / total
    weight = 1e6 if spread <= noise else min(1e6, max(1.0, mean * (1 - mean) / (spread - noise) - 1))
    good = {h for h in n if (f[h] + weight * mean) / (n[h] + weight) <= 0.5}
    assert len(good) < len(n)
    return [r for r, bad in zip(rows, failed, strict=True) if not bad and (r[3] or "") in good]


def plain_exact(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if key not in best or (r[0] is None, r[0] or 0) < (best[key][0] is None, best[key][0] or 0):
            best[key] = r
    return list(best.values())


def plain_near(rows):
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if 9 * len(sets[i] & sets[k]) >= 4 * (len(sets[i]) + len(sets[k])):
                root[find(i)] = find(k)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return groups.values()


def table():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []

    def add(doc_id, text, source="a", n=1):
        rows.extend((doc_id, text, "en", source, len(text or ""), f"r{len(rows) + k}", rng.choice([None, 5])) for k in range(n))

    passage = [word() for _ in range(60)]
    for i in range(40):
        base = [word() for _ in range(rng.choice((30, 120, 400)))] + passage * (i % 3 == 0)
        add(100 + i, " ".join(base), rng.choice("abc"))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 40))):
                copy[at] = word()
            add(rng.choice([None, 100 + i, 500 + len(rows)]), " ".join(copy), rng.choice("abc"))
        if i % 4 == 0:  # exact copies, but for white space
            add(rng.choice([None, 7, 900 + i]), "\n ".join(base), None)
            add(100 + i, " ".join(base), "b", 2)
    for k, text in enumerate((None, "", " \n", "too short", "same " * 60, "again and again " * 40)):
        add(k, text, "a")
    for i in range(12):  # a host that fails
        add(2000 + i, "short" if i % 6 else " ".join(word() for _ in range(50)), "bad")
    add(3000, " ".join(word() for _ in range(9000)), "c")
    rng.shuffle(rows)
    return rows


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    key = lambda rs: Counter((r[0], r[1]) for r in rs)

    good = corpus_pipeline.quality(spark, docs, "")
    want = plain_quality(rows)
    assert good.columns == docs.columns and Counter(map(tuple, good.collect())) == Counter(want)
    once = corpus_pipeline.exact(spark, good, "")
    left = once.collect()
    plain = plain_exact(want)
    white = lambda rs: Counter((r[0], " ".join(words_of(r[1]))) for r in rs)
    assert once.columns == docs.columns and white(left) == white(plain) and len(left) < len(want)
    near = corpus_pipeline.near(spark, once, "")
    kept = near.collect()
    groups = list(plain_near([tuple(r) for r in left]))
    assert near.columns == docs.columns and len(groups) < len(left) - 10
    for g in groups:
        first = min((r[0] is None, r[0] or 0) for r in g)
        mine = [r for r in kept if (r[0], r[1]) in key(g)]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == first
    assert len(kept) == len(groups)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for r in kept:
        n = len(library.encode(r[1], add_special_tokens=False).ids) + 1
        pieces.update((r[0], k, a, min(2048, n - a)) for k, a in enumerate(range(0, n, 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in packed) == pieces


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
