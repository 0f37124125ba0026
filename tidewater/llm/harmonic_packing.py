"""Harmonic packing of documents into fixed-length sequences (operator 3).

Class k holds what is longer than capacity / (k + 1) and not longer than capacity / k, and its bins take k whole
documents each.  What a bin then lacks is shorter than any member of its class, so the head of the class's next document
fills it to the last token; the tail of that document goes on to the class of its own length.  So a bin has one cut at
most and no padding, and a document stays whole unless it fills a bin or is longer than a sequence (full sequences are
cut off first).  Every task packs its own partition: a bin leaves as soon as it is full, so a task holds fewer than k + 1
documents of a class, less than a sequence of ids for each of the about 2 * sqrt(capacity) classes.  At its end a task
lays what is open side by side, longest first, cut where a sequence ends; the last, partly filled sequence is cut at its
powers of two, which need no padding either.

Token ids: white space cannot be inside a token here, so each distinct word between ASCII white space is tokenized
once per task and its ids are joined back by position (the table of words is bounded).

Defined cases: null is an empty text; an empty text is its closing id alone; repeated rows are separate documents.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewater.llm.common import slices, small_batches

CAPACITY = 4096
END_ID = 2
MAX_WORDS = 350_000
ID_BYTES = 4
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{f} long" for f in FIELDS)


#: Words of printable ASCII and Latin-1 letters are split here as the tokenizer splits them (lower case, then
#: contractions, letters, single digits, other characters); all other words, and special tokens, go to it whole.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class _Places(dict):
    """Word -> its place in the table; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class _Parts(dict):
    """Lower-cased part of a word -> its ids by the model's merges over its bytes."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        # the byte alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.bytes = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def __missing__(self, part: str) -> list[int]:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes)
        ids = self[part] = [t.id for t in self.model.tokenize(shown)]
        return ids


class WordIds:
    """Ids of texts through a bounded table of distinct words (flat ids and offsets)."""

    def __init__(self, path: str, end_id: int = END_ID, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.max_words = end_id, max_words
        self._clear()

    def _clear(self) -> None:
        self.at, self.parts = _Places(), _Parts(self.tokenizer.model)
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _ids(self, word: str) -> list[int]:
        if "<|" in word or not _PLAIN.fullmatch(word):
            return self._whole(word)
        parts = _PARTS.findall(word.lower())
        return self.parts[parts[0]] if len(parts) == 1 else [i for p in parts for i in self.parts[p]]

    def _learn(self, words: list[bytes]) -> None:
        ids = [self._ids(w.decode()) for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self.flat = np.concatenate([self.flat, new])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + lengths.cumsum()])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text and its closing id."""
        if len(self.at) > self.max_words:
            self._clear()
        known = len(self.at)
        place = self.at.__getitem__
        placed = []
        for t in texts:
            words = (t or "").encode().split()
            placed.append(np.fromiter(map(place, words), np.int32, len(words)))
        if len(self.at) > known:
            self._learn(list(islice(self.at, known, None)))
        for i in placed:
            first = self.offsets[i]
            n = self.offsets[i + 1] - first
            before = n.cumsum() - n
            out = np.empty(int(n.sum()) + 1, np.uint32)
            out[:-1] = self.flat[np.repeat(first - before, n) + np.arange(len(out) - 1)]
            out[-1] = self.end_id
            yield out


class Packer:
    """Fills bins of one task; ``rows`` are finished pieces.  An item is (document, start, raw ids, tokens of the document)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, items: list[tuple]) -> None:
        offset = 0
        for doc, start, raw, tokens in items:
            n = len(raw) // ID_BYTES
            self.rows.append((doc, start, n, zlib.crc32(raw), tokens, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """A whole document: its full sequences, then what is left."""
        raw, tokens = memoryview(ids).cast("B"), len(ids)
        full = tokens - tokens % self.capacity
        for start in range(0, full, self.capacity):
            self._close([(doc, start, raw[ID_BYTES * start:ID_BYTES * (start + self.capacity)], tokens)])
        if full < tokens:
            self._place((doc, full, bytes(raw[ID_BYTES * full:]), tokens))  # a copy, so that a long text's ids can go

    def _place(self, item: tuple) -> None:
        """Put an item into its class's bin; a tail that it leaves is shorter and goes on to its own class."""
        while item:
            length = len(item[2]) // ID_BYTES
            k = self.capacity // length
            members = self.open.setdefault(k, [])
            full = len(members) == k
            head, item = _split(item, self._lacks(members) if full else length)
            members.append(head)
            if full or len(members) == k and not self._lacks(members):
                self._close(members)
                self.open[k] = []

    def _lacks(self, members: list[tuple]) -> int:
        return self.capacity - sum(len(m[2]) for m in members) // ID_BYTES

    def finish(self) -> None:
        """What is open side by side, longest first; the last partial sequence ends at powers of two."""
        rest = [m for k in sorted(self.open) for m in self.open[k]][::-1]
        self.open, left = {}, sum(len(m[2]) for m in rest) // ID_BYTES
        while left:
            size, n, items = min(self.capacity, 1 << (left.bit_length() - 1)), 0, []
            while n < size:
                head, tail = _split(rest.pop(), size - n)
                items.append(head)
                n += len(head[2]) // ID_BYTES
                if tail:
                    rest.append(tail)
            self._close(items)
            left -= size


def _split(item: tuple, n: int) -> tuple[tuple, tuple | None]:
    """The first ``n`` ids of an item and what is left of it."""
    doc, start, raw, tokens = item
    if ID_BYTES * n >= len(raw):
        return item, None
    return (doc, start, raw[:ID_BYTES * n], tokens), (doc, start + n, raw[ID_BYTES * n:], tokens)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place, ids' CRC and place in a sequence.  ``capacity``: a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer, end_id)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def flush() -> pa.RecordBatch:
            columns = zip(*packer.rows, strict=True)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=FIELDS)

        for b in slices(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), words.encode(b.column("text").to_pylist()), strict=True):
                packer.add(doc, ids)
                if len(packer.rows) > 50_000:
                    yield flush()
        packer.finish()
        if packer.rows:
            yield flush()

    return small_batches(docs).selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)
