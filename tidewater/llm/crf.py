"""Linear-chain conditional random fields over words: features, forward-backward, training.

A word's emission depends on the word alone, so every distinct word is scored once per task.  Forward and backward
messages run over all documents of a slice at once: the concatenated words are cut into equal blocks, each block's
matrix product is built for all blocks in step, the products are chained, and the messages inside all blocks are again
built in step.  A document's first word has a transition that forgets what stands before, so the work per word does
not depend on how long single documents are.  Block products cost the cube of the labels, so with many labels the documents
themselves, grouped by length, are walked through in step.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

#: Words kept with their emissions in a task, and words that a block walks through in step.
MAX_WORDS = 150_000
#: Longer words (joined text, encoded data) are scored each time, so that the table is bounded in bytes as well.
LONG_WORD = 80
STEPS = 128
#: Weights that stay below this for all labels after training are left out of a model.
LEAST_WEIGHT = 0.02
#: Labels from which documents are walked through instead of blocks; words x labels trained or kept at once.
MANY_LABELS = 17
CELLS = 4_000_000
#: Letters of scripts that put no spaces between words (Thai, Lao, Burmese, Khmer, Japanese, Chinese).
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
                      "\u4e00-\u9fff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+")


def with_marks(letters: str) -> re.Pattern:
    """Runs of a class of characters together with the combining marks (vowel signs and the like) that follow them.

    All marks stand beyond U+0300, so the end of a run mostly costs one comparison.
    """
    marks = [i for i in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "M"]
    heads = [i for i, (a, b) in enumerate(zip([-2, *marks], marks, strict=False)) if b != a + 1]
    ranges = "".join(f"\\U{marks[i]:08x}-\\U{marks[j - 1]:08x}" for i, j in zip(heads, [*heads[1:], len(marks)], strict=True))
    return re.compile(f"{letters}+(?:(?=[^\\x00-\\u02ff])[{ranges}]+{letters}*)*")


def word_spans(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Places of the words of a text; stretches of an unspaced script are cut into overlapping pairs of letters."""
    out = []
    for m in pattern.finditer(text):
        at, end = m.span()
        for u in UNSPACED.finditer(text, at, end):
            a, b = u.span()
            if a > at:
                out.append((at, a))
            out += [(i, i + 2) for i in range(a, b - 1)] or [(a, b)]
            at = b
        if at < end:
            out.append((at, end))
    return out


def words_in(pattern: re.Pattern, text: str) -> list[str]:
    """The words at ``word_spans``."""
    if text.isascii() or not UNSPACED.search(text):
        return pattern.findall(text)
    return [text[a:b] for a, b in word_spans(pattern, text)]


def _by_block(e: np.ndarray, start: np.ndarray, trans: np.ndarray, first: np.ndarray, steps: int) -> list[np.ndarray]:
    """Forward and backward messages (words x labels each), in equal blocks."""
    n, k = e.shape
    steps = min(steps, n)
    blocks = -(-n // steps)
    pad = blocks * steps - n
    grid = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, steps, k).transpose(1, 0, 2).copy()
    begin = np.concatenate([start, np.ones(pad, bool)]).reshape(blocks, steps).T.copy()
    begin[0, 0] = True
    whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(steps):
        step, s = (whole.reshape(-1, k) @ trans).reshape(whole.shape), begin[t]
        if s.any():
            step[s] = whole[s].sum(2, keepdims=True) * first
        step *= grid[t][:, None, :]
        whole = step / step.sum((1, 2), keepdims=True)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    a = b = np.full(k, 1 / k)
    for i in range(blocks):
        into[i] = a
        a = a @ whole[i]
        a = a / a.sum()
    for i in reversed(range(blocks)):
        out[i] = b
        b = whole[i] @ b
        b = b / b.sum()
    alpha, beta = np.empty_like(grid), np.empty_like(grid)
    a = into
    for t in range(steps):
        s, x = begin[t], a @ trans
        if s.any():
            x[s] = a[s].sum(1, keepdims=True) * first
        x *= grid[t]
        a = alpha[t] = x / x.sum(1, keepdims=True)
    b = out
    for t in reversed(range(steps)):
        beta[t] = b
        s, x = begin[t], grid[t] * b
        y = x @ trans.T
        if s.any():
            y[s] = (x[s] @ first)[:, None]
        b = y / y.sum(1, keepdims=True)
    return [x.transpose(1, 0, 2).reshape(-1, k)[:n] for x in (alpha, beta)]


def _by_document(e: np.ndarray, start: np.ndarray, trans: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """As ``_by_block``, in step over documents whose lengths differ by less than a factor of two."""
    n, k = e.shape
    heads = np.union1d([0], np.flatnonzero(start))
    sizes = np.diff(np.r_[heads, n])
    kind = np.ceil(np.log2(sizes)).astype(int)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    for c in np.unique(kind):
        head, size = heads[kind == c], sizes[kind == c]
        for t in range(int(size.max())):
            on = np.flatnonzero(size > t)
            at = head[on] + t
            x = (alpha[at - 1] @ trans if t else first) * e[at]
            alpha[at] = x / x.sum(1, keepdims=True)
        for t in range(int(size.max()) - 1, -1, -1):
            beta[head[size == t + 1] + t] = 1 / k
            at = head[size > t + 1] + t
            if len(at):
                y = (e[at + 1] * beta[at + 1]) @ trans.T
                beta[at] = y / y.sum(1, keepdims=True)
    return [alpha, beta]


def forward_backward(e: np.ndarray, start: np.ndarray, trans: np.ndarray, first: np.ndarray,
                     steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (words x labels), and expected transitions (labels x labels, documents' first words left out).

    ``e``: positive emission potentials; ``start``: marks documents' first words; ``trans`` and ``first``: positive
    transition and first-word potentials.
    """
    n, k = e.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    flat = _by_document(e, start, trans, first) if k >= MANY_LABELS else _by_block(e, start, trans, first, steps)
    marginal = flat[0] * flat[1]
    marginal /= marginal.sum(1, keepdims=True)
    inner = np.flatnonzero(~start[1:]) + 1
    left, right = flat[0][inner - 1], e[inner] * flat[1][inner]
    weight = ((left @ trans) * right).sum(1, keepdims=True)
    return marginal, trans * ((left / weight).T @ right)


def _ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows one after another, the place of the list that each is from, and the number of lists."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return (np.fromiter((r for own in rows for r in own), np.int64, int(sizes.sum())), np.repeat(np.arange(len(rows)), sizes),
            len(rows))


@dataclass
class Crf:
    """Features' rows (0: none), weights (rows x labels), log transitions, log first-word scores."""

    rows: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray

    def emissions(self, features: Iterable[Iterable[str]]) -> np.ndarray:
        """Positive potentials of words from their features (any number for each word)."""
        row = self.rows.get
        slot, owner, n = _ragged([[row(f, 0) for f in own] for own in features])
        s = np.stack([np.bincount(owner, w[slot], n) for w in self.weights.T], 1)
        return np.exp(np.maximum(s - s.max(1, keepdims=True), -30))

    def marginals(self, e: np.ndarray, start: np.ndarray) -> np.ndarray:
        return forward_backward(e, start, np.exp(self.trans), np.exp(self.first))[0]


def train(features: list[list[str]], words: np.ndarray, start: np.ndarray, labels: np.ndarray, n_labels: int,
          rounds: int = 20, rate: float = 0.4, decay: float = 1e-6) -> Crf:
    """Maximum conditional likelihood by Adam on the full gradient.

    ``features``: those of each distinct word (any number); ``words``: the sequences' words as places in ``features``;
    ``start`` marks first words; ``labels``: the label of each word.  Sequences run in parts of some ``CELLS`` marginals.
    """
    k, n = n_labels, len(words)
    rows = {"": 0}
    slot, owner, distinct = _ragged([[rows.setdefault(f, len(rows)) for f in own] for own in features])
    used = np.arange(len(rows))
    model = Crf(rows, np.zeros((0, k)), np.zeros((k, k)), np.zeros(k))
    inner = np.flatnonzero(~start[1:]) + 1
    seen = np.bincount(labels[inner - 1] * k + labels[inner], minlength=k * k).reshape(k, k)
    heads = np.flatnonzero(start)
    part = np.searchsorted(heads, np.arange(0, n, max(1, CELLS // k)))
    parts = np.unique(np.r_[0, heads[part[part < len(heads)]], n])
    w = np.zeros((len(used), k))
    params = [w, model.trans, model.first]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        s = np.stack([np.bincount(owner, w[slot, j], distinct) for j in range(k)], 1)
        word_e = np.exp(np.maximum(s - s.max(1, keepdims=True), -30))
        per_word, pairs, at_first = np.zeros((distinct, k)), np.zeros((k, k)), np.zeros(k)
        for a, b in zip(parts, parts[1:], strict=False):
            miss, part_pairs = forward_backward(word_e[words[a:b]], start[a:b], np.exp(model.trans), np.exp(model.first))
            miss[np.arange(b - a), labels[a:b]] -= 1
            pairs += part_pairs
            at_first += miss[start[a:b]].sum(0)
            for j in range(k):
                per_word[:, j] += np.bincount(words[a:b], miss[:, j], distinct)
        per_slot = np.stack([np.bincount(slot, per_word[owner, j], len(used)) for j in range(k)], 1)
        per_slot[used == 0] = 0
        grads = [per_slot / n + decay * w, (pairs - seen) / n, at_first / n]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-12)
        np.clip(model.trans, -8, 8, out=model.trans)
    keep = np.abs(w).max(1) >= LEAST_WEIGHT
    keep[0] = True
    place = np.cumsum(keep) - 1
    model.rows = {f: int(place[i]) for f, i in rows.items() if keep[i]}
    model.weights = w[keep].astype(np.float32)
    return model


class WordScores:
    """Emissions of words, each distinct word's computed once; the table is bounded."""

    def __init__(self, crf: Crf, features: Callable[[str], list[str]], max_words: int = MAX_WORDS):
        self.crf, self.features = crf, features
        self.max_words = min(max_words, CELLS // crf.weights.shape[1])
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, crf.weights.shape[1]))

    def potentials(self, texts: list[list[str]]) -> np.ndarray:
        """Emission potentials of the words of several documents, one after another."""
        if len(self.at) > self.max_words:
            self.at, self.table = {}, self.table[:0]
        at = self.at
        new = list({w for words in texts for w in words if w not in at})
        kept = [w for w in new if len(w) <= LONG_WORD]
        if kept:
            self.table = np.concatenate([self.table, self.crf.emissions(map(self.features, kept))])
            at.update(zip(kept, range(len(at), len(at) + len(kept)), strict=True))
        n = sum(map(len, texts))
        if len(kept) == len(new):
            return self.table[np.fromiter((at[w] for words in texts for w in words), np.int64, n)]
        row = np.fromiter((at.get(w, -1) for words in texts for w in words), np.int64, n)
        long = {w: i for i, w in enumerate(w for w in new if len(w) > LONG_WORD)}
        out = self.table[row] if len(self.table) else np.zeros((n, self.table.shape[1]))
        out[row < 0] = self.crf.emissions(map(self.features, long))[[long[w] for words in texts for w in words if w in long]]
        return out
