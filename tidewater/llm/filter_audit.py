"""How five quality filters interact, per language, over all orders of applying them (operator 13).

Failure conditions of a text (words: maximal runs outside the space, tab and line characters):
A under ``MIN_WORDS`` words; B ``100 * distinct words < 50 * words``; C ``100 * [A-Z] > 3 * characters``;
D any of ``#$%&*|``; E the text of a smaller ``doc_id``, table-wide.

1. One pass over the texts gives each row its conditions A to D and a 256-bit digest of its text; rows equal in digest, id,
   part and conditions are counted before the shuffle.  Nothing longer than a digest is moved.
2. E: the smallest id of each digest is a partial aggregate, so a group of copies of any size meets as one row per task.  It
   is joined back by (digest, id), a key that only repeated rows share, and those are one counted row by now.
3. Counts of all, good and toxic documents by part and pattern of failures: 32 cells a part at most.
4. The cells of a part are three 2x2x2x2x2 tensors.  For every order and step one selector per axis takes pass, fail or
   both, and one einsum over parts, tensors and the 600 steps gives all counts.

Defined cases: a null text is empty, a null language is the part ``""``; a null id is neither smaller nor larger than
another, so its row neither fails E nor makes others fail; repeated rows count each, and do not fail E by each other; of
several label rows of one id, one with the value 1 is enough; an empty table has no parts and returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import saved

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
WORD = r"([^\x20\x09-\x0D]+)"
#: Parts whose 600 rows each are made at once.
PARTS = 50
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def selectors() -> dict[str, np.ndarray]:
    """Steps x axes x 2: which of (pass, fail) an axis lets through, for what is kept, removed, failed at all, failed alone."""
    only_pass, only_fail, both = (1, 0), (0, 1), (1, 1)
    out: dict[str, list] = {"kept": [], "removed": [], "failing": [], "alone": []}
    for order in ORDERS:
        for step, name in enumerate(order):
            earlier = order[:step]
            out["kept"].append([only_pass if f in earlier or f == name else both for f in FILTERS])
            out["removed"].append([only_fail if f == name else only_pass if f in earlier else both for f in FILTERS])
            out["failing"].append([only_fail if f == name else both for f in FILTERS])
            out["alone"].append([only_fail if f == name else only_pass for f in FILTERS])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """parts x measures x 2x2x2x2x2 counts, summed over what the steps' selectors let through: parts x measures x steps."""
    return np.einsum("pmabcde,ka,kb,kc,kd,ke->pmk", tensors, *(chosen[:, i] for i in range(len(FILTERS))), optimize=True)


def audit(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """The result's counts (parts x 600 steps) of parts x (all, good, toxic) x 2x2x2x2x2 tensors."""
    pick = selectors()
    removed = contract(tensors, pick["removed"])
    every = tensors[:, :1]
    own = np.array([FILTERS.index(name) for order in ORDERS for name in order])
    by_filter = np.stack([removed[:, 0, own == i].sum(1) for i in range(len(FILTERS))], 1)
    return {"kept": contract(every, pick["kept"])[:, 0], "removed": removed[:, 0],
            "redundant": contract(every, pick["failing"])[:, 0] - removed[:, 0],
            "unique_fails": contract(every, pick["alone"])[:, 0],
            "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": by_filter[:, own]}


def _conditions(text: Column, words: Column) -> Column:
    """Failures of A to D as bits 16, 8, 4 and 2."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text),
             text.rlike("[#$%&*|]")]
    return sum((F.when(c, 16 >> i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits (failures of A to E as 16, 8, 4, 2, 1), n, good, toxic: documents of each pattern."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "part", "text", F.regexp_extract_all("text", F.lit(WORD), 1).alias("words"))
    counted = saved(rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                                _conditions(F.col("text"), F.col("words")).alias("bits"))
                    .groupBy("digest", "id", "part", "bits").agg(F.count("*").alias("n")), "audit-rows")
    first = counted.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    flags = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q"),
                           F.col("toxic").cast("int").alias("t")).filter("id is not null").groupBy("id")
             .agg(F.max(F.when(F.col("q") == 1, 1).otherwise(0)).alias("good"),
                  F.max(F.when(F.col("t") == 1, 1).otherwise(0)).alias("toxic")))
    named = (counted.filter("id is not null").join(first, ["digest", "id"], "left").join(flags, "id", "left")
             .select("part", F.when(F.col("is_first"), F.col("bits")).otherwise(F.col("bits") + 1).alias("bits"), "n",
                     F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    nameless = counted.filter("id is null").select("part", "bits", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.union(nameless).groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), PARTS):
            part, cells = frame["part"].iloc[at:at + PARTS].tolist(), frame["cells"].iloc[at:at + PARTS]
            tensors = np.zeros((len(part), 3, 32), np.int64)
            for i, own in enumerate(cells):
                for c in own:
                    tensors[i, :, c["bits"]] = c["n"], c["good"], c["toxic"]
            counts = audit(tensors.reshape(-1, 3, 2, 2, 2, 2, 2))
            steps = len(ORDERS) * len(FILTERS)
            yield pd.DataFrame({"part": np.repeat(np.array(part, object), steps),
                                "filter_order": np.tile(np.repeat(np.array(ORDERS, object), len(FILTERS)), len(part)),
                                "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(part) * len(ORDERS)),
                                **{k: v.ravel() for k, v in counts.items()}})


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    cells = patterns(docs, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    return cells.mapInPandas(_steps, RESULT)


#: Walks every pattern through every order: the first failing filter removes it.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part,
        (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END)
        || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
      FROM w),
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
      FROM f LEFT JOIN lab USING (doc_id) GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x FROM o, range(1, 6) r(step)),
p AS (SELECT c.*, s.*, coalesce(list_min([instr(filter_order, z) FOR z IN string_split(fails, '') IF z <> '']), 6) AS gone
      FROM c, s),
r AS (SELECT part, filter_order, step, x,
        sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN contains(fails, x) AND gone < step THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
      FROM p GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
