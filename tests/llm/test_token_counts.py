import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardloom.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b ", " ", "  ", "\n", "é", "7", "'s", "'l", "l", "'", "!", "<|endoftext|>", "<|endof", "text|>", "the ", "ing"]


def test_edited_trees_equal_counting_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    rng, own = random.Random(8), bpe.BytePairs(PATH)
    counter = token_counts.Counter(own)
    make = lambda n: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))
    for _ in range(150):
        tree = token_counts.TokenTree(counter, make(60))
        for _ in range(8):
            text = tree.text
            start, delete, insert = rng.randint(-2, len(text) + 3), rng.choice([0, 1, 3, 20]), make(6)
            tree.edit(start, delete, insert)
            at = min(max(start, 0), len(text))
            assert tree.text == text[:at] + insert + text[min(at + delete, len(text)) :]
            fresh = token_counts.TokenTree(counter, tree.text)
            assert tree.state() == fresh.state() and tree.total == fresh.total
        assert tree.total == len(Tokenizer.from_file(PATH).encode(tree.text, add_special_tokens=False).ids)


def test_few_pretokens_are_counted_again():
    counter = token_counts.Counter(bpe.BytePairs(PATH))
    tree = token_counts.TokenTree(counter, "some words here " * 5000)
    tree.edit(40000, 3, "x")
    assert tree.recounted < 20


def test_rows(spark):
    library = Tokenizer.from_file(PATH)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    data = [(1, None, [(0, 0, "ab")]), (2, "one two", None), (2, "one two", [(4, 3, None), (0, 1, "O"), None]), (None, "x " * 20000, [(9999, 1, "y")])]
    docs = spark.createDataFrame(data, "doc_id long, text string, edits " + token_counts.EDITS)
    out = token_counts.count_tokens(docs, PATH, keep_state=True)
    rows = out.collect()
    assert [r.text for r in rows[:3]] == ["ab", "one two", "One "]
    assert [r.n_tokens for r in rows] == [count(t or "") for _, t, _ in data]
    assert [r.n_tokens_edited for r in rows] == [count(r.text) for r in rows]
    again = token_counts.count_tokens(out.withColumn("edits", F.lit(None)), PATH).collect()
    assert [r.n_tokens for r in again] == [r.n_tokens_edited for r in rows]
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0
