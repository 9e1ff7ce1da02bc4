"""Operator 10, main text of HTML pages by a recurrent block labeller.

A page is cut into blocks (:mod:`html_blocks`); a bidirectional LSTM in numpy reads the vectors of all its blocks and says of each whether it
belongs to the article.  The weights come from :mod:`html_training`, which trains on pages made up from a seed; they are stored beside this module.
Pages of a batch are run together, padded by length; a page of more than ``CELLS`` blocks is read in slices that hand the state on, so a task holds one Arrow batch and the
vectors of ``CELLS`` blocks.

Defined results
* a null or empty page, and one without article blocks, has the empty text;
* rows that repeat an id or a page give a row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.bpe import blocks
from cardloom.llm.html_blocks import WIDTH, cut, vectors

WEIGHTS = Path(__file__).with_name("html_model.npz")
#: Blocks, with padding, that are run together at most, beyond one page.
CELLS = 20_000
#: Pages that are cut together at most.
PAGES = 500


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
    """Hidden states [time, page, hidden] of inputs [time, page, width]; where the mask is 0 the state stays.

    ``keep`` collects what training needs of each step; ``state`` is where to begin, if it isn't empty, and holds where the last step ended.
    """
    steps, pages, _ = x.shape
    hidden = u.shape[0]
    h, c = state or (np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32))
    given = x @ w + b
    out = np.empty((steps, pages, hidden), np.float32)
    for t in range(steps):
        z = given[t] + h @ u
        i, f, o = sigmoid(z[:, :hidden]), sigmoid(z[:, hidden : 2 * hidden] + 1), sigmoid(z[:, 2 * hidden : 3 * hidden])
        g = np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        new = f * c + i * g
        if keep is not None:
            keep.append((h, c, i, f, o, g, new, m))
        c = m * new + (1 - m) * c
        h = m * (o * np.tanh(new)) + (1 - m) * h
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out


@cache
def weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return {k: f[k] for k in f.files}


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs [time, page, width] and mask [time, page]."""
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def scores(pages: list[np.ndarray], model: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
    """For each page the log odds that its blocks belong to the article."""
    m = model or weights()
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= CELLS:
            end += 1
        group = order[at:end]
        x, mask = pad([pages[k] for k in group])
        ahead = lstm(x, mask, m["w0"], m["u0"], m["b0"])
        back = lstm(x[::-1], mask[::-1], m["w1"], m["u1"], m["b1"])[::-1]
        odds = ahead @ m["v0"] + back @ m["v1"] + m["c"]
        for j, k in enumerate(group):
            out[k] = odds[: len(pages[k]), j]
        at = end
    return out


def long_scores(blocks: list, model: dict[str, np.ndarray] | None = None, cells: int = CELLS) -> np.ndarray:
    """:func:`scores` of one page of very many blocks, ``cells`` of which have their vectors at a time."""
    m = model or weights()
    before = np.append(0, np.cumsum([len(b.text) for b in blocks]))
    odds = np.full(len(blocks), m["c"], np.float32)
    parts = [(a, min(len(blocks), a + cells)) for a in range(0, len(blocks), cells)]
    for d, turn in (("0", 1), ("1", -1)):
        state: list = []
        for a, e in parts[::turn]:
            x = vectors(blocks, a, e, int(before[a]))[::turn, None]
            odds[a:e] += (lstm(x, np.ones(x.shape[:2], np.float32), m["w" + d], m["u" + d], m["b" + d], state=state)[:, 0] @ m["v" + d])[::turn]
    return odds


def main_texts(pages: list[str | None]) -> list[str]:
    """Article text of each page."""
    cuts = [cut(p) for p in pages]
    labels = scores([vectors(b) if len(b) <= CELLS else vectors([]) for b in cuts])
    labels = [long_scores(b) if len(b) > CELLS else s for b, s in zip(cuts, labels)]
    return [" ".join(b.text for b, s in zip(own, odds, strict=True) if s > 0) for own, odds in zip(cuts, labels, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""

    def run(batches):
        for batch in batches:
            for start, pages in blocks(batch, "html", PAGES):
                part = batch.slice(start, len(pages))
                texts = main_texts(pages)
                yield pa.RecordBatch.from_pydict(
                    {"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())}
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
