import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cardloom.llm import bpe, unit_cache

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "日", "١", "5", "7", "'s", "'ll", "'", "!", "??", "<|endoftext|>", "<|endof", "😀", "the", "ing", "\x00", "²", "\r\n", "_", "aaaa"]


def test_same_as_the_library():
    rng = random.Random(1)
    own, library = bpe.BytePairs(PATH), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_cache_may_start_anew(monkeypatch):
    monkeypatch.setattr(unit_cache, "CACHE_BYTES", 2)
    monkeypatch.setattr(unit_cache, "LONG", 3)
    own, library = bpe.BytePairs(PATH), Tokenizer.from_file(PATH)
    for t in ("one two three", "two three four", "four five one"):
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, "x y", 5), (None, "x y", 6), (4, "ab " * 100000, 7)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode(docs, PATH).collect()
    assert [r.decoded for r in rows] == ["", "", "x y", "x y", "ab " * 100000]
    assert rows[0].n_tokens == 0 and rows[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].ids == rows[3].ids and rows[2].n_tokens * 4 == len(rows[2].ids)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
