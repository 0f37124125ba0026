"""Document rules and host verdicts (operator 5).

Every text is measured once; base rules reject single documents.  Soft rules mark weak documents; their failures are
counted by host (``source``), the hosts' failure rates are shrunk towards an empirical beta prior fitted by moments
over all hosts, and a host whose shrunk rate reaches ``BAD_RATE`` is bad.  So is a host that stands out from the others:
its posterior rate, less ``SIGMAS`` posterior deviations, is above the mean of the prior fitted to all other hosts by more
than ``SIGMAS`` of that prior's deviations.  The verdict is joined back: a document of a bad host goes if it fails a soft
rule itself; clean documents of any host stay.

Measures are kept in a scratch table, so that the counts and the join read numbers and no text.  Counts are partial
sums before their shuffle, so one host may hold any share of the rows.  The bad hosts are written before the join:
the optimizer broadcasts them only if their exact size is below its threshold, else it shuffles (and splits skew).

Defined cases: null or blank text has no words and fails the base rules; a null source is a host of its own;
repeated rows are measured each; with fewer than two hosts, or no spread between hosts, the prior is the overall rate
with weight ``MIN_WEIGHT``; a lone host has no others to stand out from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import saved, small_batches

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS = 50
#: Shrunk failure rate from which a host is bad, and the least weight (in documents) of the prior.
BAD_RATE = 0.8
MIN_WEIGHT = 10.0
#: A host against the others: deviations it stands out by, the most weight and the least deviation of their prior (so
#: that the prior of many like hosts neither outweighs a host's own documents nor makes every small difference a verdict).
SIGMAS = 3.0
MAX_WEIGHT = 100.0
MIN_SPREAD = 0.05


def _repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    at: dict[bytes, int] = {}
    w = np.fromiter((at.setdefault(x, len(at)) for x in words), np.int64, len(words))
    if len(at) == len(words):
        return 0
    n = len(at)
    pair = w[:-1] * n + w[1:]
    if n > 2_000_000:  # the product of three ids could pass 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * n + w[2:]
    order = np.argsort(window, kind="stable")
    s = window[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(s), bool)
    again[1:] = same
    again[:-1] |= same
    hit = np.zeros(len(words), bool)
    i = order[again]
    hit[i] = hit[i + 1] = hit[i + 2] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.translate(None, SPACE)]
    return (len(words), len(text) - (len(raw) - len(raw.translate(None, SPACE))),
            len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeated_words(words))


def measures(text: Column) -> Column:
    """Struct of the measures of a text column."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([measure(t) for t in part], columns=MEASURES)

    # not deterministic for the optimizer, which then doesn't run it a second time for a filter
    return run.asNondeterministic()(text.cast("string"))


def base_failed(of: Callable[[str], Column]) -> Column:
    """``of`` gives the column of a measure."""
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def soft_failed(of: Callable[[str], Column]) -> Column:
    """Rules whose failures are counted by host: base, many symbols, odd word lengths, repeated lines or words."""
    n = F.greatest(of("n_words"), F.lit(1))
    mean = of("word_chars") / n
    return (of("base_failed") | (of("n_symbols") * 10 > n) | (mean < 2.5) | (mean > 12)
            | (of("n_dup_lines") >= 10) | (100 * of("n_repeat_words") > 30 * n))


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failed, rate, lower, limit: failure rates shrunk towards a beta prior fitted by moments over the hosts;
    posterior lower bounds and their limits under the prior of the other hosts (null for a lone host)."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(soft_failed(F.col).cast("long")).alias("failed"))
    p, inverse = F.col("failed") / F.col("n"), 1 / F.col("n")
    # one row of sums over the hosts
    mean, between, inverse_n, size, sum_p, sum_pp, sum_inverse = hosts.agg(
        F.sum("failed") / F.sum("n"), F.var_pop(p), F.avg(inverse), F.count("*"), F.sum(p), F.sum(p * p),
        F.sum(inverse)).first()
    mean, spread = mean or 0.0, (mean or 0.0) * (1 - (mean or 0.0))
    true_var = (between or 0.0) - spread * (inverse_n or 0.0)  # without the spread of finite hosts
    weight = max(spread / true_var - 1, MIN_WEIGHT) if true_var > 0 else MIN_WEIGHT
    rates = hosts.withColumn("rate", (F.col("failed") + mean * weight) / (F.col("n") + weight))
    if size < 2:
        return rates.withColumns({"lower": F.lit(None).cast("double"), "limit": F.lit(None).cast("double")})
    others, rest = size - 1, F.lit(sum_p) - p
    raw = rest / others
    rates = rates.withColumn("_mean", F.least(F.greatest((rest + 0.5) / (others + 1), F.lit(0.0)), F.lit(1.0)))
    m = F.col("_mean")
    var = (F.lit(sum_pp) - p * p) / others - raw * raw - m * (1 - m) * (F.lit(sum_inverse) - inverse) / others
    fitted = F.when(var > 0, F.least(F.greatest(m * (1 - m) / var - 1, F.lit(MIN_WEIGHT)), F.lit(MAX_WEIGHT)))
    rates = rates.withColumn("_weight", F.coalesce(fitted, F.lit(MAX_WEIGHT)))  # others without spread are alike
    w = F.col("_weight")
    rates = rates.withColumn("_own", (F.col("failed") + m * w) / (F.col("n") + w))
    own = F.col("_own")
    rates = rates.withColumns({
        "lower": own - SIGMAS * F.sqrt(own * (1 - own) / (F.col("n") + w + 1)),
        "limit": m + SIGMAS * F.greatest(F.sqrt(m * (1 - m) / (w + 1)), F.lit(MIN_SPREAD))})
    return rates.drop("_mean", "_weight", "_own")


def bad_hosts(measured: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame:
    bad = (F.col("rate") >= bad_rate) | F.coalesce(F.col("lower") > F.col("limit"), F.lit(False))
    return saved(host_rates(measured).filter(bad).select("host"), "bad-hosts")


def _measured(docs: DataFrame) -> DataFrame:
    m = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"),
                    measures(F.col("text")).alias("m"))
    return m.select("doc_id", "host", "m.*").withColumn("base_failed", base_failed(F.col))


def judge(docs: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame:
    """doc_id, host, measures, base_failed, kept: one row per input row."""
    m = saved(_measured(docs), "quality")
    bad = bad_hosts(m, bad_rate).select(F.col("host").alias("_bad"), F.lit(True).alias("_is_bad"))
    marked = m.join(bad, F.col("host").eqNullSafe(F.col("_bad")), "left")
    return marked.select("doc_id", "host", *MEASURES, "base_failed",
                         (~F.col("base_failed") & ~(F.coalesce("_is_bad", F.lit(False)) & soft_failed(F.col)))
                         .alias("kept"))


def keep_documents(docs: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame:
    """The kept rows with all their columns; texts are measured again rather than shuffled."""
    bad = bad_hosts(_measured(docs), bad_rate).select(F.col("host").alias("_tw_bad"), F.lit(True).alias("_tw_is_bad"))
    of = lambda name: F.col(f"_tw_m.{name}")
    rows = small_batches(docs).withColumn("_tw_m", measures(F.col("text")))
    rows = rows.withColumn("_tw_m", F.col("_tw_m").withField("base_failed", base_failed(of))).filter("not _tw_m.base_failed")
    rows = rows.join(bad, F.col("source").cast("string").eqNullSafe(F.col("_tw_bad")), "left")
    return rows.filter(~(F.coalesce("_tw_is_bad", F.lit(False)) & soft_failed(of))).select(*docs.columns)
