"""News articles -> attributed event rows (N10-N18), all Column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.functions import text as T

RECORD_COLUMNS = ["event_id", "source", "query_name", "query", "fetched_at", "seen_at", "title", "url", "domain",
                  "language", "source_country", "port_code", "port_name", "attribution_reason", "event_category",
                  "severity_score", "matched_terms"]


def _first_non_empty(df: DataFrame, *names: str):
    cols = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def query_text(query_name) -> F.Column:
    m = F.create_map(*[x for name, q in R.EVENT_QUERIES for x in (F.lit(name), F.lit(q))])
    return F.coalesce(F.element_at(m, query_name), F.lit(""))


def articles_from_view(news: DataFrame) -> DataFrame:
    """Raw article records as a news API returns them, from the derived ``news`` view."""
    qord = F.create_map(*[x for i, (name, _q) in enumerate(R.EVENT_QUERIES) for x in (F.lit(name), F.lit(i))])
    return news.select(
        F.col("title"), F.col("url"), F.lit(None).cast("string").alias("url_mobile"),
        F.date_format("seen_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
        F.lit("example.com").alias("domain"), F.lit("English").alias("language"),
        F.lit(None).cast("string").alias("sourcecountry"),
        F.col("query_name"), query_text(F.col("query_name")).alias("query"),
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("fetched_at"),
        F.coalesce(F.element_at(qord, F.col("query_name")), F.lit(99)).alias("query_ordinal"),
        F.col("event_id").alias("article_ordinal"))


def normalise_articles(articles: DataFrame, include_unattributed: bool = True) -> DataFrame:
    """One article -> one row per attributed port, or one unattributed row."""
    title = F.coalesce(_first_non_empty(articles, "title"), F.lit(""))
    url = F.coalesce(_first_non_empty(articles, "url", "url_mobile"), F.lit(""))
    a = (articles.withColumn("_title", title).withColumn("_url", url)
         .filter(~((F.col("_title") == "") & (F.col("_url") == ""))))
    a = a.withColumn("_seen", T.seen_date_parse(_first_non_empty(a, "seendate", "seenDate", "seen_date")))
    a = a.withColumn("_text", T.normalize_text(F.concat(F.col("_title"), F.lit(" "), F.col("_url"))))
    # each term is looked for once; what follows reads bits and first terms
    a = a.withColumns({"_masks": T.category_masks(F.col("_text")), "_sev": T.severity(F.col("_text")),
                       "_base": T.event_base_id(F.col("_url"), F.col("_title"), F.col("_seen")), "_reasons": T.port_reasons(F.col("_text"))})
    a = a.withColumns({"_cat": T.categorise_masks(F.col("_masks"), F.col("query_name")),
                       "_attrs": F.array_compact(T.attributions(F.col("_reasons")))})
    gen = F.explode_outer("_attrs") if include_unattributed else F.explode("_attrs")
    a = a.withColumn("_a", gen)
    extra = [c for c in ("query_ordinal", "article_ordinal") if c in a.columns]
    return a.select(
        F.concat(F.col("_base"), F.lit("-"), F.coalesce(F.col("_a.port_code"), F.lit("unattributed"))).alias("event_id"),
        F.lit(R.NEWS_SOURCE).alias("source"),
        F.col("query_name"), F.col("query"), F.col("fetched_at"), F.col("_seen").alias("seen_at"),
        F.col("_title").alias("title"), F.col("_url").alias("url"),
        _first_non_empty(a, "domain").alias("domain"), _first_non_empty(a, "language").alias("language"),
        _first_non_empty(a, "sourcecountry", "sourceCountry", "source_country").alias("source_country"),
        F.col("_a.port_code").alias("port_code"), F.col("_a.port_name").alias("port_name"),
        F.coalesce(F.col("_a.attribution_reason"), F.lit("unattributed")).alias("attribution_reason"),
        F.col("_cat.event_category").alias("event_category"), F.col("_sev").alias("severity_score"),
        F.col("_cat.matched_terms").alias("matched_terms"), *extra)


def dedup_first(records: DataFrame, run_col: str = "fetched_at") -> DataFrame:
    """Keep the first row per event id within a fetch run, in query then article order.

    All rows of a run carry the same ``run_col``; ``row_number`` over (run,
    event_id) keeps the first, which ``dropDuplicates`` would not guarantee.
    """
    w = Window.partitionBy(F.col(run_col), F.col("event_id")).orderBy("query_ordinal", "article_ordinal")
    return records.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def news_records(news_view: DataFrame) -> DataFrame:
    """Normalised and de-duplicated raw news table from the derived view."""
    return dedup_first(normalise_articles(articles_from_view(news_view))).select(*RECORD_COLUMNS)
