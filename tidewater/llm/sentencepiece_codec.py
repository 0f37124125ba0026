"""SentencePiece encoding and decoding with a distinct-chunk table (operator 10).

A piece of the model may hold white-space markers only in front, so no merge crosses from a character into a
following marker.  Each text is therefore cut before every run of markers; every distinct marked word is segmented
once per task by the library, and ids and decoded text are joined back in order.  The table is bounded: it is
cleared between slices once it holds ``max_chunks`` words; words longer than ``LONG`` characters are never kept.

Defined cases: null is an empty text; an empty text has no ids and decodes to an empty text.  A model with a piece
that has a marker behind another character, or that changes white space, is encoded text by text instead.  User-defined
pieces that hold white space are such pieces too; others lie within a word and need no special case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import slices

MARK = "▁"
LONG = 80
MAX_CHUNKS = 200_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_RUNS = re.compile(r" +[^ ]*")


class ChunkCodec:
    """Encodes and decodes texts through a table: marked word -> (number of ids, ids as text, decoded word)."""

    def __init__(self, model: str, max_chunks: int = MAX_CHUNKS):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.separable = not any(MARK in p.lstrip(MARK) for p in pieces if p != MARK) and MARK in pieces
        # the library must leave white space as it is, and put one marker in front
        self.separable &= self.sp.decode(self.sp.encode(" a  b ")) == " a  b "
        self.max_chunks, self.chunks = max_chunks, {}

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first marker."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _RUNS.findall(" " + text)]
        return text.split(" ")

    def _learn(self, words: list[str]) -> dict[str, tuple[int, str, str]]:
        ids = self.sp.encode(words, num_threads=1)
        texts = self.sp.decode(ids, num_threads=1)
        known = {w: (len(i), ",".join(map(str, i)), t) for w, i, t in zip(words, ids, texts, strict=True)}
        if "" in known:  # a marker with nothing behind it: the library leaves out the first one of an empty text
            known[""] = (1, str(self.sp.piece_to_id(MARK)), "")
        return known

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        if not self.separable:
            for t in texts:
                ids = self.sp.encode(t or "")
                yield len(ids), ",".join(map(str, ids)), self.sp.decode(ids)
            return
        if len(self.chunks) > self.max_chunks:
            self.chunks.clear()
        split = [self.words(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.chunks})
        learned = self._learn(new) if new else {}
        long = {w: v for w, v in learned.items() if len(w) > LONG}
        self.chunks.update((w, v) for w, v in learned.items() if len(w) <= LONG)
        for words in split:
            found = [self.chunks.get(w) or long[w] for w in words]
            yield sum(f[0] for f in found), ",".join([f[1] for f in found]), " ".join([f[2] for f in found])


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                     max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Digest of every text's ids and decoded text: one row per input row, repeated rows included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model, max_chunks)
        for b in slices(batches):
            rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                    for n, ids, t in codec.encode(b.column("text").to_pylist())]
            n, ids, out = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(out)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)
