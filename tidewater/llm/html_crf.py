"""Main-text extraction from HTML by a linear-chain conditional random field over leaf blocks (operator 12).

1. ``dom_blocks`` cuts a page into leaf blocks: texts between borders of block elements, with features of their open
   elements (tags, names), their own tag, length, links, ending and words.
2. The model (labels: main text or not) is trained on labelled pages: ``GENERATED`` pages laid out at random with known
   labels (``labelled_pages``), and up to ``SAMPLE`` pages of the table whose ``article`` element tells main text.  The sample is
   bounded: ids are chosen by hash, one text of ``SAMPLE_CHARS`` characters at most for each.
3. Every page is decoded by Viterbi in its own task, whole, in one pass; nothing is shuffled.

Texts: character references are decoded in each stretch of text, white space (line breaks as well) inside a block is one
space, blocks are joined by one newline.

Defined cases: a null page is empty; an empty page, or one without main text, has an empty text; a page of any length is
read whole; equal scores count as main text; repeated rows return a row each, null ids and urls stay null; an empty table
returns no rows.  Only ``page_id``, ``url`` and ``html`` are read, other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import slices, small_batches
from tidewater.llm.crf import train
from tidewater.llm.dom_blocks import Block, blocks
from tidewater.llm.labelled_pages import Layouts, by_markup, labelled

#: Made pages, pages of the table and characters of one that the model learns from; what a feature must be seen in.
GENERATED = 1200
SAMPLE = 150
SAMPLE_CHARS = 40_000
LEAST_PAGES = 3
#: Share of the table's pages whose elements' features are left out, so that texts and own tags are learned too.
BLIND = 4
RESULT = "page_id long, url string, text string, n_chars long"


def viterbi(scores: list[float], trans: np.ndarray, first: np.ndarray) -> list[bool]:
    """The best labels of a chain of two; ``scores``: of label 1 against label 0."""
    if not scores:
        return []
    (t00, t01), (t10, t11) = trans.tolist()
    a, b = float(first[0]), float(first[1]) + scores[0]
    back: list[tuple[bool, bool]] = []
    for s in scores[1:]:
        from_a, from_b = (b + t10 >= a + t00), (b + t11 >= a + t01)
        a, b = (b + t10 if from_a else a + t00), (b + t11 if from_b else a + t01) + s
        back.append((from_a, from_b))
    label = b >= a
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


@dataclass
class Extractor:
    """Weights of main text against the rest by feature, log transitions and first-block scores."""

    weights: dict[str, float]
    trans: np.ndarray
    first: np.ndarray

    def labels(self, page_blocks: list[Block]) -> list[bool]:
        weight, shared, scores = self.weights.get, {}, []
        for b in page_blocks:
            around = shared.get(b.around)
            if around is None:
                around = shared[b.around] = sum(weight(f, 0.0) for f in b.around)
            scores.append(around + sum(weight(f, 0.0) for f in b.own))
        return viterbi(scores, self.trans, self.first)

    def text(self, page: str | None) -> str:
        found = blocks(page or "", self.weights)
        return "\n".join(b.text for b, main in zip(found, self.labels(found), strict=True) if main)


def fit(pages: list[tuple[list[Block], list[int]]]) -> Extractor:
    """Train on pages as lists of blocks with labels."""
    pages = [p for p in pages if p[0]]
    features = [[*b.around, *b.own] for found, _ in pages for b in found]
    seen, at = Counter(), 0
    for found, _ in pages:
        seen.update({f for own in features[at:at + len(found)] for f in own})
        at += len(found)
    own = [tuple(f for f in fs if seen[f] >= LEAST_PAGES) for fs in features]
    distinct = {fs: i for i, fs in enumerate(dict.fromkeys(own))}
    sizes = np.array([len(found) for found, _ in pages])
    start = np.zeros(int(sizes.sum()), bool)
    start[np.cumsum(sizes) - sizes] = True
    crf = train([list(fs) for fs in distinct], np.fromiter((distinct[fs] for fs in own), np.int64, len(own)), start,
                np.fromiter((y for _, labels in pages for y in labels), np.int64, len(own)), 2, rounds=60, rate=0.25, decay=1e-5)
    apart = (crf.weights[:, 1] - crf.weights[:, 0]).astype(float)
    return Extractor({f: float(apart[i]) for f, i in crf.rows.items() if f}, crf.trans, crf.first)


def sampled(pages: DataFrame, most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[str]:
    """Texts of pages chosen by a hash of their ids; the smallest of an id's texts.  Ids are read before any text."""
    ids = [r["page_id"] for r in pages.select(F.col("page_id").cast("long").alias("page_id")).filter("page_id is not null").distinct()
           .orderBy(F.xxhash64("page_id"), "page_id").limit(most).collect()]
    if not ids:
        return []
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
            .filter(F.col("page_id").isin(ids) & (F.length("html") <= chars))
            .groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect())
    return [r["html"] for r in rows]


def fit_pages(pages: DataFrame, generated: int = GENERATED, seed: int = 11) -> Extractor:
    """Model of made pages and of the table's own pages."""
    made = Layouts(seed)
    known = [labelled(made.page()) for _ in range(generated)]
    for i, page in enumerate(sampled(pages)):
        found, labels = by_markup(page)
        if i % BLIND == 0:
            found = [Block(b.text, ("t:body",), b.own) for b in found]
        known.append((found, labels))
    return fit(known)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = fit_pages(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [model.text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                                       F.col("html").cast("string").alias("html")).mapInArrow(run, RESULT)
