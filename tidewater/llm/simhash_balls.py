"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 8).

Two fingerprints link at ``RADIUS`` = 3 or fewer differing bits.  A ball of half that radius around both meets in the
middle: the 64 bits are dealt into three blocks, and with one block masked every distinct fingerprint emits itself and
all variants with one other bit flipped (3 + 128 keys).  Rows are shuffled on the masked variant and sorted by it.

Inside a key, members are at most two unmasked bits apart, so
* members with an equal masked block link (two bits or fewer), as a star around the smallest;
* groups whose masked blocks differ in one bit link by their smallest members (three bits or fewer);
* members that equal the key itself (no flip) and differ in three bits of the masked block link likewise, found by a
  second ball: single flips of one meet double flips of the other.
Two fingerprints three bits apart have either a block with exactly one of the bits (masked there: the second rule) or
all three in one block (the third); two bits or fewer leave a block without any (the first).  Every link is verified by
its bit distance.  No pairs within a group are emitted: links are stars, and a key's members are bounded by the block.

Fingerprints: 3-word shingles (repeats included) of the A-Z lower-cased words, XXH64 with seed 42, majority per bit.

Defined cases: null and blank texts have fingerprint zero and link like any other; equal fingerprints are one node;
a document without links is its own component; null ids take part but are never a component's id unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import saved, slices, small_batches
from tidewater.llm.graph import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: First bit and width of the three masked blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n], last, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, same (a hash of the text), fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), pa.array(fp)],
                                             names=["doc_id", "same", "fp"])

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) same",
                           "cast(text as string) text").mapInArrow(run, "doc_id long, same long, fp long")


def _block(fp: np.ndarray, block: int) -> np.ndarray:
    first, width = BLOCKS[block]
    return (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)


def _key(fp: np.ndarray, block: int) -> np.ndarray:
    """The unmasked bits, closed up, and the block's number above them."""
    first, width = BLOCKS[block]
    low = fp & np.uint64((1 << first) - 1)
    high = (fp >> np.uint64(first + width)) << np.uint64(first) if first + width < 64 else np.uint64(0)
    return low | high | np.uint64(block << 60)


def variants(fps: DataFrame) -> DataFrame:
    """key, fp: the masked ball of half the radius around every distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at:at + 4096]
                for block, (_, width) in enumerate(BLOCKS):
                    flips = np.array([0, *(1 << i for i in range(64 - width))], np.uint64)
                    key = (_key(part, block)[:, None] ^ flips).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)),
                                                      pa.array(np.repeat(part, len(flips)).view(np.int64))],
                                                     names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _first_of(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's run of equal values."""
    new = np.r_[True, sorted_values[1:] != sorted_values[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a, b) of whole buckets; rows sorted by key.  Both arrays are unsigned 64-bit."""
    run = _first_of(key)
    size = np.bincount(run, minlength=len(run))[run]
    key, fp = key[size > 1], fp[size > 1]
    if not len(key):
        return fp, fp
    bucket = np.cumsum(np.r_[0, key[1:] != key[:-1]]).astype(np.uint64)
    out = [[], []]

    def link(a: np.ndarray, b: np.ndarray) -> None:
        near = (a != b) & (np.bitwise_count(a ^ b) <= radius)
        out[0].append(a[near])
        out[1].append(b[near])

    for block, (_, width) in enumerate(BLOCKS):
        of = (key >> np.uint64(60)) == block
        if not of.any():
            continue
        k, f = bucket[of], fp[of]
        exact = _key(f, block) == key[of]
        place = (k << np.uint64(width)) | _block(f, block)
        order = np.lexsort((f, place))
        place, f, exact = place[order], f[order], exact[order]
        first = _first_of(place)
        link(f, f[first])
        heads = np.unique(first)
        hp, hf = place[heads], f[heads]
        if len(hp) > 1:
            for bit in range(width):
                to = hp ^ np.uint64(1 << bit)
                at = np.minimum(np.searchsorted(hp, to), len(hp) - 1)
                ok = hp[at] == to
                link(hf[ok], hf[at[ok]])
        # three bits of the masked block: single flips of one member meet double flips of another
        ep, ef = place[exact], f[exact]
        many = np.bincount((ep >> np.uint64(width)).astype(np.int64))[(ep >> np.uint64(width)).astype(np.int64)] > 1
        ep, ef = ep[many], ef[many]
        if len(ep):
            one = (ep[:, None] ^ np.array([1 << i for i in range(width)], np.uint64)).ravel()
            who = np.repeat(ef, width)
            order = np.argsort(one, kind="stable")
            one, who = one[order], who[order]
            for i, j in combinations(range(width), 2):
                to = ep ^ np.uint64((1 << i) | (1 << j))
                at = np.minimum(np.searchsorted(one, to), len(one) - 1)
                ok = one[at] == to
                link(ef[ok], who[at[ok]])
    return np.concatenate(out[0]), np.concatenate(out[1])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest node of each component of a few links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def links(keyed: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (as signed longs), of rows shuffled on ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def found(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = bucket_links(key, fp)
            if len(a):
                a, b = _forest(a, b)
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))],
                                                 names=["a", "b"])

        for batch in batches:
            key = np.concatenate([rest_key, batch.column("key").to_numpy().view(np.uint64)])
            fp = np.concatenate([rest_fp, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(key):
                continue
            end = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # the last bucket may go on
            yield from found(key[:end], fp[:end])
            rest_key, rest_fp = key[end:], fp[end:]
        yield from found(rest_key, rest_fp)

    return (keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long"))


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """fp, root: every distinct fingerprint that has a link, and its component's smallest fingerprint."""
    distinct = fps.select("fp").distinct()
    # few bytes, but every row becomes 131: as many tasks as a shuffle has, not as few as the bytes ask for
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # (dealt by another expression than the distinct's own, which would make this one void)
    return components(links(variants(distinct.repartition(parts, F.xxhash64("fp"))))).withColumnRenamed("node", "fp")


def _members(fps: DataFrame) -> DataFrame:
    """fp, root, low (smallest id of the fingerprint): pre-aggregated, a group of copies is one row from here on."""
    smallest = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    return smallest.join(fingerprint_components(fps), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row."""
    fps = saved(fingerprints(docs, shingle), "simhash")
    roots = saved(_members(fps), "members")
    ids = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return (fps.join(roots.join(ids, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id (then the smallest text hash)."""
    fps = saved(fingerprints(docs, shingle), "simhash")
    roots = saved(_members(fps).select("fp", "root"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same"))
    # partial minima: a component of any size is one row per task before the shuffle
    kept = (fps.join(roots, "fp").groupBy("root").agg(first.alias("k"))
            .select(F.col("k.doc_id").alias("_tw_id"), F.col("k.same").alias("_tw_same"), F.col("root").alias("_tw_root")))
    rows = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_tw_id"))
                     & (F.xxhash64(F.col("text").cast("string")) == F.col("_tw_same")))
    return rows.dropDuplicates(["_tw_root"]).select(*docs.columns)  # repeated rows: one stays
