"""Language identification by a linear-chain conditional random field over words (operator 9).

Labels are the languages of the sample.  Features of a word: itself if the lexicon (words of several sample texts)
holds it, a prefix, suffixes and all character trigrams with the word's borders.  Unspaced scripts have pairs of letters
for words.  The field is fitted on the driver from a bounded sample:
``PER_LANG`` texts of every language in order of their id's hash, of long ones stretches of ``MAX_CHARS`` in all (less with
many languages, ``SAMPLE_CHARS`` over all texts), none held out.  Sample texts are cut into stretches and spliced at random (fixed seed), so that the
transitions learn how rarely the language changes inside a text, as it does in code-switched ones.

Scoring (every whole text, on Spark): forward-backward marginals label the words; the language with the largest sum is
the prediction, its share of the sum the score.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any language to learn from, all
are; held_out is false for a null id, which is never learned from; repeated rows are judged each.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import saved, small_batches, spread
from tidewater.llm.crf import Crf, WordScores, train, with_marks, words_in
from tidewater.llm.toxicity_crf import fold

FOLDS, HELD = 4, 2
PER_LANG = 200
MAX_CHARS = 6_000
#: Characters of all sample texts together, and of each at least.
SAMPLE_CHARS = 12_000_000
LEAST_CHARS = 200
SLICE_CHARS = 1_000_000
#: Letters with their combining marks.
_WORD = with_marks(r"[^\W\d_]")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, pairs of letters in unspaced scripts; none if the text has no letter at all."""
    words = words_in(_WORD, (text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


@dataclass
class Features:
    lexicon: frozenset[str]

    def __call__(self, word: str) -> list[str]:
        mark = f"^{word}$"
        return [word if word in self.lexicon else "", mark[:4], mark[-2:], mark[-4:],
                *(mark[i:i + 3] for i in range(len(mark) - 2))]


@dataclass
class LanguageModel:
    langs: list[str]
    crf: Crf | None
    features: Features

    def predict(self, texts: list[str | None], scores: WordScores | None) -> list[tuple[str, float]]:
        if self.crf is None:
            return [("und", 0.0)] * len(texts)
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        full = np.flatnonzero(sizes)
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if len(full):
            at = (np.cumsum(sizes) - sizes)[full]
            start = np.zeros(int(sizes.sum()), bool)
            start[at] = True
            share = np.add.reduceat(self.crf.marginals(scores.potentials(words), start), at) / sizes[full, None]
            for i, s in zip(full, share, strict=True):
                out[i] = (self.langs[int(s.argmax())], min(1.0, float(s.max())))
        return out


def fit(texts: list[str], langs: list[str], seed: int = 7) -> LanguageModel:
    names = sorted(set(langs))
    label_of = {lang: i for i, lang in enumerate(names)}
    docs = [(words_of(t), label_of[lang]) for t, lang in zip(texts, langs, strict=True)]
    docs = [d for d in docs if d[0]]
    if not docs:
        return LanguageModel(names, None, Features(frozenset()))
    seen = Counter(w for words, _ in docs for w in set(words))
    features = Features(frozenset(w for w, n in seen.items() if n >= 3))
    rng = random.Random(seed)
    stretches = []
    for words, label in docs:
        at = 0
        while at < len(words):
            n = rng.randint(20, 80)
            stretches.append((words[at:at + n], label))
            at += n
    rng.shuffle(stretches)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s, _ in stretches for w in s))}
    words = np.array([vocabulary[w] for s, _ in stretches for w in s], np.int64)
    labels = np.repeat([label for _, label in stretches], [len(s) for s, _ in stretches])
    ends = np.cumsum([len(s) for s, _ in stretches])
    start = np.zeros(len(words), bool)
    start[np.r_[0, ends[3:-1:4]]] = True  # four stretches make a text
    return LanguageModel(names, train([features(w) for w in vocabulary], words, start, labels, len(names)),
                         features)


def first_ids(ids: DataFrame, most: int) -> DataFrame:
    """The ``most`` ids (``_id``) of every language (``_lang``) whose hashes are the smallest.

    Hashes of fewer bits are smaller, and each bit less halves their number.  Counts by language and bits (63 rows a language)
    tell the bits that ``most`` ids have; only ids up to these, about twice ``most`` a language, are ranked.
    """
    d = ids.withColumn("_h", F.xxhash64("_id").bitwiseAND(F.lit(2 ** 63 - 1))).withColumn("_bits", F.length(F.bin("_h")))
    upto = Window.partitionBy("_lang").orderBy("_bits")
    counts = d.groupBy("_lang", "_bits").agg(F.count("*").alias("_n")).withColumn("_sum", F.sum("_n").over(upto))
    cut = saved(counts.groupBy("_lang").agg(F.coalesce(F.min(F.when(F.col("_sum") >= most, F.col("_bits"))), F.max("_bits")).alias("_cut")),
                "language-cuts")
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id"))
    near = d.join(cut, "_lang").filter(F.col("_bits") <= F.col("_cut"))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= most).select("_id", "_lang")


def fit_documents(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS,
                  sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("_lang"),
                        F.col("text").cast("string").alias("_text"))
    known = known.filter("_lang is not null").filter(fold("_id", FOLDS) != HELD).filter(F.col("_text").rlike(r"\p{L}"))
    pick = saved(first_ids(saved(known.select("_id", "_lang").distinct(), "language-ids"), per_lang), "language-sample")
    n_langs = pick.select("_lang").distinct().count()
    most = min(max_chars, max(LEAST_CHARS, sample_chars // max(1, n_langs * per_lang)))
    sample = (known.join(pick, ["_id", "_lang"]).select("_id", "_lang", spread("_text", F.lit(most)).alias("_text"))
              .groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))
              .orderBy(F.xxhash64("_id"), "_id", "_lang").collect())
    return fit([r["_text"] for r in sample], [r["_lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = model or fit_documents(docs)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = None if model.crf is None else WordScores(model.crf, model.features)
        most = SLICE_CHARS * 8 // max(8, len(model.langs))  # marginals are words x languages
        for part in parts:
            texts, rows, at = part.tolist(), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < most):
                    size += len(texts[to] or "")
                    to += 1
                rows += model.predict(texts[at:to], scores)
                at = to
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    judged = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), predict(F.col("text").cast("string")).alias("p"))
    return judged.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "p.lang_pred",
                         "p.score")
