"""Toxicity by a linear-chain conditional random field (operator 2).

Fitting (driver, on a bounded sample: ``PER_CLASS`` labelled texts of each class in order of their id's hash, those of up
to ``MAX_CHARS`` first, then stretches of longer ones, none held out, texts that mostly repeat earlier ones left out): cues are words, first four or
five letters, or four letters anywhere in a word, that occur in toxic texts ``ODDS`` times as often as in the others.  They are chosen greedily, the cue
of the most texts not yet explained by ``DEPTH`` others first, so that a word which only keeps company with cues is none.
Words of a toxic text with a cue are labelled toxic tokens; all other words are clean tokens.  The field learns from
these tokens; a logistic layer over the documents' aggregated marginals learns from their labels.

Scoring (every whole text, on Spark): forward-backward marginals of all words; the largest, their sum and their share
make the score; runs of words with a marginal of a half or more are the offending spans (character offsets).

Unspaced scripts have pairs of letters for words.

Defined cases: null and empty texts have no words and get the score of no evidence; labels that are null are not used,
several labels of one id count as toxic if one is; without labels of both classes all scores are the share of toxic
labels (0 without any); a class that has labels but no text to learn from is an error, unless docs is empty; held_out is false for a null id, which is never learned from.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import saved, small_batches, spread
from tidewater.llm.crf import Crf, WordScores, train, with_marks, word_spans, words_in

FOLDS = 5
PER_CLASS = 1200
MAX_CHARS = 6_000
ODDS = 20.0
#: Toxic texts that a cue explains at least: three, or this share of them.
LEAST_SHARE = 0.005
LEAST_TEXTS = 3
DEPTH = 2
#: Characters scored at once.
SLICE_CHARS = 1_000_000
#: Letters, digits and underscores, with their combining marks.
_WORD = with_marks(r"\w")
RESULT = "score double, spans array<struct<start:long,end:long>>"


def features(word: str) -> list[str]:
    """Features of a lower-cased word: itself, its prefixes, its ending, all its runs of four letters, one that all share."""
    return [word, "4" + word[:4], "5" + word[:5], "e" + word[-3:], "all", *_grams(word)]


def _grams(word: str) -> list[str]:
    return ["g" + word[i:i + 4] for i in range(max(1, len(word) - 3))]


def _signs(word: str) -> list[str]:
    """What may be a cue: the word, its marked prefixes, its runs of four letters."""
    return [word, "4" + word[:4], "5" + word[:5], *_grams(word)]


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


@dataclass
class ToxicityModel:
    crf: Crf | None
    layer: np.ndarray  # bias, and weights of the aggregates
    constant: float = 0.0

    def aggregate(self, toxic: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per document: largest marginal, log of 1 + their sum, their share."""
        out = np.zeros((len(sizes), 3))
        full = np.flatnonzero(sizes)
        if len(full):
            at = (np.cumsum(sizes) - sizes)[full]
            total = np.add.reduceat(toxic, at)
            out[full] = np.stack([np.maximum.reduceat(toxic, at), np.log1p(total), total / sizes[full]], 1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.crf is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.layer[0] + x @ self.layer[1:], -30, 30)))

    def tag(self, texts: list[str | None], scores: WordScores) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and offending spans as character offsets, of whole texts."""
        words = [words_in(_WORD, (t or "").lower()) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        if self.crf is None:
            return self.score(np.zeros((len(texts), 3))), [[] for _ in texts]
        start = np.zeros(int(sizes.sum()), bool)
        start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        toxic = self.crf.marginals(scores.potentials(words), start)[:, 1]
        spans, at = [], 0
        for t, n in zip(texts, sizes, strict=True):
            hit = toxic[at:at + n] >= 0.5
            at += n
            spans.append(_spans(t, hit) if hit.any() else [])
        return self.score(self.aggregate(toxic, sizes)), spans


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of marked words as (start, end)."""
    low = text.lower()
    if len(low) != len(text):  # a few characters have longer lower-case forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = word_spans(_WORD, low)
    if len(places) != len(hit):
        return [(0, len(text))]
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(places[a][0], places[b - 1][1]) for a, b in edges.reshape(-1, 2)]


def _fresh(docs: list[list[str]], size: int = 5) -> list[int]:
    """Places of the texts of which less than half of the word shingles stand in earlier ones."""
    seen: set[int] = set()
    out = []
    for i, words in enumerate(docs):
        own = {hash(tuple(words[j:j + size])) for j in range(max(1, len(words) - size + 1))}
        if 2 * len(own & seen) < len(own):
            out.append(i)
        seen |= own
    return out


def _cues(docs: list[list[str]], y: np.ndarray) -> set[str]:
    """Signs of words (``_signs``) that explain the toxic texts (greedy cover)."""
    where: dict[str, list[int]] = {}
    clean: Counter[str] = Counter()
    for i, (words, label) in enumerate(zip(docs, y, strict=True)):
        for f in {f for w in set(words) for f in _signs(w)}:
            if label:
                where.setdefault(f, []).append(i)
            else:
                clean[f] += 1
    n_clean, n_toxic = int((y == 0).sum()), int((y == 1).sum())
    least = max(LEAST_TEXTS, int(LEAST_SHARE * n_toxic))
    where = {f: d for f, d in where.items() if len(d) >= least
             and (len(d) + 0.5) / (n_toxic + 1) >= ODDS * (clean[f] + 0.5) / (n_clean + 1)}
    heap = [(-len(d), f) for f, d in where.items()]
    heapq.heapify(heap)
    explained, out = Counter(), set()
    while heap:
        n, f = heapq.heappop(heap)
        left = sum(explained[i] < DEPTH for i in where[f])
        if left < least:
            continue
        if -n != left:
            heapq.heappush(heap, (-left, f))
            continue
        out.add(f)
        explained.update(where[f])
    return out


def fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    """Model of a bounded sample of labelled texts."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(None, np.zeros(4), float(y.mean()) if len(y) else 0.0)
    docs = [words_in(_WORD, (t or "").lower()) for t in texts]
    fresh = _fresh(docs)
    docs, y = [docs[i] for i in fresh], y[fresh]
    cue = _cues(docs, y)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words in docs for w in words))}
    is_cue = np.array([not cue.isdisjoint(_signs(w)) for w in vocabulary], bool)
    sizes = np.array([len(w) for w in docs])
    words = np.fromiter((vocabulary[w] for d in docs for w in d), np.int64, int(sizes.sum()))
    start = np.zeros(len(words), bool)
    start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    tokens = (is_cue[words] & (np.repeat(y, sizes) == 1)).astype(np.int64)
    # what stands in fewer texts than any cue would only learn its own words by heart
    own = [features(w) for w in vocabulary]
    seen = Counter(f for d in docs for f in {f for w in set(d) for f in own[vocabulary[w]]})
    own = [[f for f in fs if f == "all" or seen[f] >= LEAST_TEXTS] for fs in own]
    model = ToxicityModel(train(own, words, start, tokens, 2), np.zeros(4))
    scores = WordScores(model.crf, features, max_words=len(vocabulary) + 1)
    x = model.aggregate(model.crf.marginals(scores.potentials(docs), start)[:, 1], sizes)
    x1, layer = np.c_[np.ones(len(x)), x], np.zeros(4)
    for _ in range(50):  # Newton steps of a lightly damped logistic regression
        p = 1 / (1 + np.exp(-np.clip(x1 @ layer, -30, 30)))
        damp = 0.1 * np.eye(4)
        layer -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + damp, x1.T @ (p - y) + damp @ layer)
    model.layer = layer
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS,
                  folds: int = FOLDS) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows that are not held out."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
             .filter("_id is not null and _toxic is not null").filter(fold("_id", folds) != 0)
             .groupBy("_id").agg(F.max("_toxic").alias("_toxic")))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    texts = texts.filter("length(trim(_text)) > 0")
    # ids and lengths only; long texts fill a class up after the others
    able = saved(texts.select("_id", F.length("_text").alias("_n")).join(known, "_id")
                 .groupBy("_id", "_toxic").agg(F.min("_n").alias("_n")), "toxic-candidates")
    pick = [able.filter(F.col("_toxic") == c).orderBy(F.col("_n") > max_chars, F.xxhash64("_id"), "_id").limit(per_class)
            for c in (0, 1)]
    chosen = pick[0].union(pick[1]).select("_id", "_toxic").collect()  # at most 2 * per_class ids: a fixed bound
    n = Counter(int(r["_toxic"]) for r in chosen)
    if len(n) < 2:
        labelled = {int(r["_toxic"]) for r in known.select("_toxic").distinct().collect()}
        if missing := ({0, 1} & labelled) - set(n):
            if not docs.isEmpty():
                raise ValueError(f"no text to learn from for the toxic labels {sorted(missing)}")
    if not chosen:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame([(r["_id"], r["_toxic"]) for r in chosen], "_id long, _toxic int")
    # a class of few texts may take longer stretches of them: the same characters in all
    most = F.when(F.col("_toxic") == 1, max(max_chars, per_class * max_chars // max(1, n[1]))).otherwise(
        max(max_chars, per_class * max_chars // max(1, n[0])))
    sample = (texts.join(F.broadcast(ids), "_id").select("_id", "_toxic", spread("_text", most).alias("_text"))
              .groupBy("_id", "_toxic").agg(F.min(F.struct(F.length("_text"), "_text")).alias("_t"))
              .orderBy(F.xxhash64("_id"), "_id").select("_toxic", "_t._text").collect())
    return fit([r["_text"] for r in sample], [int(r["_toxic"] == 1) for r in sample])


def tagger(model: ToxicityModel):
    """Column function: text -> struct of score and spans."""

    @F.pandas_udf(RESULT)
    def tag(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = None if model.crf is None else WordScores(model.crf, features)
        for part in parts:
            texts, rows, at = part.tolist(), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < SLICE_CHARS):
                    size += len(texts[to] or "")
                    to += 1
                s, spans = model.tag(texts[at:to], scores)
                rows += zip(s.tolist(), spans, strict=True)
                at = to
            yield pd.DataFrame({"score": [r[0] for r in rows],
                                "spans": [[{"start": a, "end": b} for a, b in r[1]] for r in rows]})

    return tag


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row."""
    tag = tagger(fit_documents(docs, labels))
    scored = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), tag(F.col("text").cast("string")).alias("t"))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("t.score").alias("score"),
                         (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.spans").alias("spans"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    tag = tagger(fit_documents(docs, labels))
    return small_batches(docs).withColumn("_tw_t", tag(F.col("text").cast("string"))).filter("_tw_t.score < 0.5").select(*docs.columns)
