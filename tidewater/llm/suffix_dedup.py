"""Exact substring deduplication with per-shard suffix arrays (operator 4).

Every byte covered by a ``WIDTH``-byte string that also starts elsewhere in the corpus is removed.  Windows are the
strings of ``WIDTH`` bytes; matches never cross documents.

1. Cores.  The core of a window is its leftmost smallest hashed ``CORE``-byte gram, so equal windows have equal cores.
   Successive windows with the same core form a context (about 65 windows in 265 bytes).  Each context becomes a row of
   hashes and numbers: core hash, hash of its bytes, row key, place, windows.
   The rows are written once: they are counted, and joined to what the counts leave.
2. Grouped by core (partial counts first): a core seen once has no repeat, and its contexts go.
3. Contexts with equal bytes are one text with a count.  Texts are dealt into shards by core.  A core with more
   than ``GROUP`` texts is dealt over several shards.  Every shard builds the suffix array of its texts in numpy by
   Larsson-Sadakane refinement (ranks of 8 bytes are doubled; only groups that are still tied are sorted again) and
   Kasai's common prefixes; neighbours that share ``WIDTH`` bytes are repeats.
4. Cores dealt over several shards are merged: each shard gives one fingerprint per distinct window of them; these are
   dealt by fingerprint, and sorted shard lists are merged by binary search.
5. Repeated windows come back as intervals by row key; every text drops what they cover.

Rows are keyed by id and a hash of the text.  Rows equal in both have equal texts, so they repeat each other and share
their result.  No group is gathered beyond its bound: groups by core are counted, texts of a shard are bounded, and
intervals are gathered by document.

Defined cases: null is an empty text; texts shorter than the width keep all; a null id is a key of its own; removed
bytes may split a character, and the kept text then drops the rest of it (the digest is over the bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import saved, slices, small_batches

WIDTH = 200
CORE = 48
#: Texts of one core in a shard, and bytes of text aimed at in a shard.
GROUP = 2048
SHARD_BYTES = 700_000
SLICE = 1_000_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _words(raw: bytes, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places as numbers that sort like the bytes."""
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)


def contexts(raw: bytes, ends: np.ndarray, width: int = WIDTH, core: int = CORE) -> tuple[np.ndarray, ...]:
    """Contexts of texts laid end to end: first window, number of windows, core hash.  ``ends``: where texts end."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.astype(np.uint64)
    w = _words(raw, n)
    grams = n - core + 1
    h = w[:grams]
    for i in range(8, core, 8):
        h = _mix(h + _ODD[i // 8 % 3]) ^ w[i:i + grams]
    h = _mix(h)
    del w
    low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(grams, dtype=np.uint64)  # smallest hash, then leftmost place
    span, done = width - core + 1, 1
    while done * 2 <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if span > done:
        low = np.minimum(low[:-(span - done)], low[span - done:])
    text_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n - width + 1]
    starts = np.flatnonzero(np.arange(n - width + 1) + width <= ends[text_of])
    if not len(starts):
        return none, none, none.astype(np.uint64)
    owner = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text_of[starts[1:]] != text_of[starts[:-1]])])
    return starts[new], np.diff(np.r_[new, len(starts)]), h[owner[new]]


def _keyed(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("k1", F.coalesce("doc_id", F.lit(-(2 ** 63) + 1))).withColumn("k2", F.xxhash64("text"))


def context_rows(keyed: DataFrame, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """core, bytes (hashes), k1, k2 (row key), place (first window << 16 | windows) of every context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max_bytes=SLICE):
            texts = [t.encode() for t in b.column("text").to_pylist()]
            raw, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
            first, n, h = contexts(raw, ends, width, core)
            if not len(first):
                continue
            digest = xxhash.xxh3_64_intdigest
            same = np.fromiter((digest(raw[a:a + m + width - 1]) for a, m in zip(first.tolist(), n.tolist(), strict=True)),
                               np.uint64, len(first))
            doc = np.searchsorted(ends, first, "right")
            place = ((first - np.r_[0, ends[:-1]][doc]) << 16) | n
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(same.view(np.int64)), b.column("k1").take(pa.array(doc)),
                 b.column("k2").take(pa.array(doc)), pa.array(place)], names=["core", "bytes", "k1", "k2", "place"])

    return keyed.select("text", "k1", "k2").mapInArrow(run, "core long, bytes long, k1 long, k2 long, place long")


def suffix_array(raw: bytes, first: np.ndarray, size: np.ndarray, windows: np.ndarray,
                 width: int = WIDTH) -> np.ndarray:
    """Window starts in the order of their ``width`` bytes, by Larsson-Sadakane refinement.

    Texts stand at ``first`` with ``size`` bytes; ``windows`` are places with at least ``width`` bytes left.  A rank of
    depth h is known for every place with h bytes left; a rank of depth g + h joins two of them.
    """
    n = len(raw)
    left = np.zeros(n, np.int32)
    for a, m in zip(first.tolist(), size.tolist(), strict=True):
        left[a:a + m] = np.arange(m, 0, -1)
    depth = min(8, width)
    places = np.flatnonzero(left >= depth)
    key = _words(raw, n)[places] >> np.uint64(8 * (8 - depth))
    order = np.argsort(key)  # ties share a rank, in any order
    places, key = places[order], key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.zeros(n, np.int32)
    rank[places] = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    while depth < width:
        step = min(depth, width - depth)
        # only tied groups are refined; single members keep their rank
        tied = places[~(new & np.r_[new[1:], True])]
        tied = tied[left[tied] >= depth + step]
        if not len(tied):
            break
        pair = rank[tied].astype(np.int64) << 32 | rank[tied + step]
        order = np.argsort(pair)
        tied, pair = tied[order], pair[order]
        group = pair >> 32
        head = np.r_[True, group[1:] != group[:-1]]
        new = np.r_[True, pair[1:] != pair[:-1]]
        at = np.arange(len(tied))
        rank[tied] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        depth += step
        places = tied
    # equal windows in the order of their places: numbers that all differ need no stable sort
    return windows[np.argsort(rank[windows].astype(np.int64) << 32 | np.arange(len(windows)))]


def _leading(differ: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers.  Halves of 32 bits are exact as floats."""
    high = differ >> np.uint64(32)
    half = np.where(high > 0, high, differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return (64 - np.frexp(half)[1] - 32 * (high > 0)) // 8


def common_prefixes(raw: bytes, order: np.ndarray, limit: int = WIDTH) -> np.ndarray:
    """Kasai: bytes (up to ``limit``) that each window shares with its predecessor in the order.

    A window whose predecessor stands one place behind that of the window before it shares one byte less at least; all
    texts walk on in step.
    """
    n = len(order)
    words = _words(raw + bytes(limit + 8), len(raw) + limit)
    before = np.full(len(raw) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.sort(order)
    lane = np.r_[True, np.diff(at) != 1]
    heads = np.flatnonzero(lane)
    length = np.diff(np.r_[heads, n])
    by_length = np.argsort(-length, kind="stable")
    heads, length = heads[by_length], length[by_length]
    shared = np.zeros(len(raw) + 1, np.int64)
    last = np.zeros(len(heads), np.int64)
    for t in range(int(length[0]) if n else 0):
        live = int(np.searchsorted(-length, -t, "left"))  # texts with a window t
        here = at[heads[:live] + t]
        there = before[here]
        follows = (there >= 0) & (t > 0)
        if t:
            follows &= before[here - 1] == there - 1
        h = np.where(follows, np.maximum(last[:live] - 1, 0), 0)
        go = np.flatnonzero((there >= 0) & (h < limit))
        while len(go):
            differ = words[here[go] + h[go]] ^ words[there[go] + h[go]]
            equal = _leading(differ)
            h[go] += equal
            go = go[(equal == 8) & (h[go] < limit)]
        h = np.minimum(h, limit)
        last[:live] = h
        shared[here] = h
    return shared[order]


def shard_repeats(texts: list[bytes], counts: np.ndarray, merged: np.ndarray, width: int = WIDTH,
                  ) -> tuple[list[list[tuple[int, int]]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Repeated windows of a shard's distinct texts, and what goes on to the merge.

    First: for each text, runs (from, to) of windows that occur twice in the shard.  Second: text, window and both
    halves of the fingerprint of one window per distinct content, for texts with ``merged``.
    """
    size = np.array([len(t) for t in texts], np.int64)
    raw, first = b"".join(texts), np.cumsum(size) - size
    per = size - width + 1
    text_of = np.repeat(np.arange(len(texts)), per)
    offset = np.arange(len(text_of)) - np.repeat(np.cumsum(per) - per, per)
    windows = first[text_of] + offset
    number = np.zeros(len(raw) + 1, np.int64)
    number[windows] = np.arange(len(windows))
    order = suffix_array(raw, first, size, windows, width)
    shared = common_prefixes(raw, order, width) >= width
    shared[:1] = False
    again = shared | np.r_[shared[1:], False]
    hit = np.zeros(len(windows), bool)
    hit[number[order[again]]] = True
    hit |= counts[text_of] > 1
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)) != 0)
    # runs never cross texts
    cuts = np.union1d(edges, (np.cumsum(per) - per)[1:])
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    bounds = np.r_[0, cuts, len(windows)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a < b and hit[a]:
            runs[text_of[a]].append((int(offset[a]), int(offset[b - 1]) + 1))
    one = order[~shared]
    one = one[merged[text_of[number[one]]]]
    prints = np.array([divmod(xxhash.xxh3_128_intdigest(raw[p:p + width]), 1 << 64) for p in one.tolist()],
                      np.uint64).reshape(-1, 2)
    return runs, (text_of[number[one]], offset[number[one]], prints[:, 0], prints[:, 1])


def _texts(keyed: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """core, bytes, n (occurrences), text of each distinct context."""
    one = hits.groupBy("core", "bytes").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at"))
    wanted = one.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("core", "bytes", "n", F.col("at.place").alias("place")))
                                               .alias("cuts"))  # bounded by the document's length
    both = _packed(keyed).dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("packed", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches, "packed", SLICE // 2):
            out = []
            for packed, cuts in zip(b.column("packed").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                raw = unpack.decompress(packed) if packed else b""
                for c in cuts:
                    a, m = c["place"] >> 16, c["place"] & 0xFFFF
                    out.append((c["core"], c["bytes"], c["n"], raw[a:a + m + width - 1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(
                    zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)],
                    names=["core", "bytes", "n", "text"])

    return both.mapInArrow(run, "core long, bytes long, n long, text binary")


def _packed(keyed: DataFrame) -> DataFrame:
    """Texts compressed one by one, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, max_bytes=SLICE):
            packed = [pack.compress(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(packed, pa.binary())],
                                             names=["doc_id", "k1", "k2", "packed"])

    return keyed.select("text", "doc_id", "k1", "k2").mapInArrow(run, "doc_id long, k1 long, k2 long, packed binary")


def _searched(texts: DataFrame, width: int, group: int, shard_bytes: int) -> DataFrame:
    """core, bytes, low, high: repeated windows of the contexts, through suffix arrays and the merge."""
    # only cores beyond the bound; a written table, so the join below can be split on skew
    parts = saved(texts.groupBy("core").agg(F.ceil(F.count("*") / group).alias("parts")).filter("parts > 1"), "parts")
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    # groups of one core stay together unless they pass the bound
    dealt = (texts.join(parts, "core", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("part", F.pmod("bytes", "parts"))
             .withColumn("shard", F.pmod(F.xxhash64("core", "part"), F.lit(shards)).cast("int")))

    def search(table: pa.Table) -> pa.Table:
        content = table.column("text").to_pylist()
        cores, same = table.column("core").to_numpy(), table.column("bytes").to_numpy()
        runs, (of, at, f1, f2) = shard_repeats(content, table.column("n").to_numpy(),
                                               table.column("parts").to_numpy() > 1, width)
        flat = [(i, a, b) for i, r in enumerate(runs) for a, b in r]
        i = np.array([f[0] for f in flat], np.int64)
        text = np.r_[i, of].astype(np.int64)
        low = np.r_[np.array([f[1] for f in flat], np.int64), at].astype(np.int64)
        high = np.r_[np.array([f[2] for f in flat], np.int64), at + 1].astype(np.int64)
        halves = [pa.array(np.r_[np.zeros(len(i), np.uint64), f.astype(np.uint64)].view(np.int64),
                           mask=np.r_[np.ones(len(i), bool), np.zeros(len(of), bool)]) for f in (f1, f2)]
        return pa.table({"core": cores[text], "bytes": same[text], "low": low, "high": high, "f1": halves[0],
                         "f2": halves[1]})

    found = saved(dealt.groupBy("shard").applyInArrow(
        search, "core long, bytes long, low long, high long, f1 long, f2 long"), "shards")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by fingerprint: those with an equal neighbour, found by binary search."""
        kept: list[pa.RecordBatch] = []
        for b in batches:
            kept.append(b)
            t = pa.Table.from_batches(kept)
            f = t.column("f1").to_numpy()
            end = int(np.searchsorted(f, f[-1], "left")) if len(f) else 0  # the last fingerprint may go on
            yield from _equal(t.slice(0, end))
            kept = t.slice(end).combine_chunks().to_batches()
        if kept:
            yield from _equal(pa.Table.from_batches(kept))

    across = (found.filter("f1 is not null").repartition("f1").sortWithinPartitions("f1", "f2")
              .select("f1", "f2", "core", "bytes", "low", "high")
              .mapInArrow(merge, "core long, bytes long, low long, high long"))
    return found.filter("f1 is null").select("core", "bytes", "low", "high").union(across)


def _equal(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of a table sorted by (f1, f2) whose fingerprint occurs more than once."""
    if not t.num_rows:
        return
    pair = np.empty(t.num_rows, [("a", np.int64), ("b", np.int64)])
    pair["a"], pair["b"] = t.column("f1").to_numpy(), t.column("f2").to_numpy()
    n = np.searchsorted(pair, pair, "right") - np.searchsorted(pair, pair, "left")
    yield from t.filter(pa.array(n > 1)).select(["core", "bytes", "low", "high"]).combine_chunks().to_batches()


def repeated(docs: DataFrame, width: int = WIDTH, core: int = CORE, group: int = GROUP,
             shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Keyed documents, and (k1, k2, spans): window starts [low, high) of each row key that repeat elsewhere."""
    keyed = _keyed(docs)
    rows = saved(context_rows(keyed, width, core), "contexts")
    cores = saved(rows.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "cores")
    hits = saved(rows.join(cores, "core"), "hits")
    found = _searched(saved(_texts(keyed, hits, width), "texts"), width, group, shard_bytes)
    first = F.shiftright("place", 16)
    spans = hits.join(found, ["core", "bytes"]).select("k1", "k2", (first + F.col("low")).alias("low"),
                                                       (first + F.col("high")).alias("high"))
    # rows equal in key have the same spans: a set of them is bounded by the document
    return keyed, spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def covered(spans: list[dict] | None, width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in the spans."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"] + width - 1) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(r) for r in out]


def dedup_documents(docs: DataFrame, width: int = WIDTH, core: int = CORE, group: int = GROUP,
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    keyed, spans = repeated(docs, width, core, group, shard_bytes)
    both = _packed(keyed).join(spans, ["k1", "k2"], "left").select("doc_id", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches, "packed", SLICE // 2):
            out = []
            for packed, s in zip(b.column("packed").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw, runs = unpack.decompress(packed), covered(s, width)
                out.append((len(raw), sum(e - a for a, e in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest()))
            n, removed, spans_, digest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans_)),
                                              pa.array(digest)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, e in runs:
        out.append(raw[at:a])
        at = e
    return b"".join([*out, raw[at:]])


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows with their texts cut (and ``n_chars``, if there, counted anew); all columns stay."""
    _, spans = repeated(docs, width)
    spans = spans.withColumnsRenamed({"k1": "_k1", "k2": "_k2", "spans": "_spans"})
    columns = docs.columns
    keyed = docs.withColumn("_k1", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2 ** 63) + 1))) \
        .withColumn("_k2", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))

    @F.pandas_udf("string")
    def kept(texts, found):
        import pandas as pd
        return pd.Series([t if t is None or s is None or not len(s) else
                          cut(t.encode(), covered(list(s), width)).decode(errors="ignore")
                          for t, s in zip(texts, found, strict=True)], dtype=object)

    out = keyed.join(spans, ["_k1", "_k2"], "left").withColumn("text", kept(F.col("text").cast("string"), "_spans"))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*columns)
