"""Golden rows from the source pipeline's unit tests, run through the Column rules."""

from pyspark.sql import functions as F

from tidewater.functions import rules, text as T
from tidewater.operators.spatial import within_zones
from tidewater.plans import news as NW
from tidewater.sources.geo import scan_geojson


def test_vessel_state_golden(spark):
    rows = [  # distance, sog, nav, delta, destination match, eta ok, expected
        (5.0, 0.1, 5, 0.0, False, False, "at_berth"),
        (20.0, 0.2, 1, 0.0, False, False, "waiting_anchor"),
        (12.0, 0.2, 15, 1.2, False, False, "outbound"),
        (80.0, 10.0, 0, -2.5, False, False, "inbound"),
        (120.0, 8.0, 0, None, True, True, "inbound"),
        (45.0, 6.0, 15, 0.1, False, False, "transit_unknown"),
    ]
    df = spark.createDataFrame(rows, "d double, s double, n int, dl double, dm boolean, eta boolean, want string")
    got = df.select(rules.vessel_state("d", "s", "n", "dl", F.col("dm"), F.col("eta")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def _articles(spark, rows):
    return spark.createDataFrame(rows, "title string, url string, seendate string, query_name string")\
        .withColumn("query", F.lit("")).withColumn("fetched_at", F.lit("2026-06-12T11:00:00+00:00"))\
        .withColumn("query_ordinal", F.lit(0)).withColumn("article_ordinal", F.monotonically_increasing_id())


def test_news_attribution_golden(spark):
    rows = [("Port of Rotterdam faces delays", "", "20260612T104500Z", "labor"),
            ("US port terminals face customs outage", "", "20260612104500", "labor"),
            ("US election polling shows a close race", "", None, "labor"),
            ("Customs outage affects port terminals", "", None, "labor"),
            ("Global shipping rates rise after container delays", "", None, "infrastructure"),
            ("American port terminals brace for labor strike", "", None, "labor")]
    out = NW.normalise_articles(_articles(spark, rows)).collect()
    by_title = {}
    for r in out:
        by_title.setdefault(r.title, []).append(r)
    rtm = by_title["Port of Rotterdam faces delays"]
    assert [(r.port_code, r.attribution_reason) for r in rtm] == [("NLRTM", "port_term:rotterdam")]
    assert rtm[0].seen_at == "2026-06-12T10:45:00+00:00"
    assert by_title["US port terminals face customs outage"][0].seen_at == "2026-06-12T10:45:00+00:00"
    assert sorted(r.port_code for r in by_title["US port terminals face customs outage"]) == ["USLAX", "USNYC"]
    assert [r.port_code for r in by_title["US election polling shows a close race"]] == [None]
    assert [r.port_code for r in by_title["Customs outage affects port terminals"]] == [None]
    g = by_title["Global shipping rates rise after container delays"]
    assert len(g) == 1 and g[0].port_code is None and g[0].event_category == "infrastructure"
    assert g[0].severity_score == 0.65 and g[0].attribution_reason == "unattributed"
    am = by_title["American port terminals brace for labor strike"]
    assert sorted(r.port_code for r in am) == ["USLAX", "USNYC"]
    assert {r.event_category for r in am} == {"labor"} and {r.severity_score for r in am} == {0.9}


def test_news_dedup_same_article(spark):
    rows = [("Shanghai port congestion", "https://x/1", "20260612T104500Z", "infrastructure")] * 2
    out = NW.dedup_first(NW.normalise_articles(_articles(spark, rows))).collect()
    assert [r.port_code for r in out] == ["CNSHA"]


def test_normalize_text_matches_literal_rule(spark):
    s = "  Port of N.Y./N.J. -- U.S.  "
    got = spark.range(1).select(T.normalize_text(F.lit(s)).alias("t")).first().t
    assert got == T.normalize_literal(s)


def test_geofence_golden(spark):
    pts = spark.createDataFrame([(1, 33.731, -118.218), (2, 33.9, -118.5)], "id int, lat double, lon double")
    hits = within_zones(pts, scan_geojson(spark)).select("id", "zone_id").collect()
    assert [(h.id, h.zone_id) for h in hits] == [(1, "uslax_anchorage_b")]


def test_board_rules(spark):
    df = spark.createDataFrame([(30.0, 10.0, "approaching"), (200.0, 10.0, "transit"), (5.0, 0.0, "berth"),
                                (10.0, 0.5, "approaching"), (9.0, 9.0, "approaching"), (1000.0, 10.0, "transit")],
                               "d double, s double, z string")
    got = df.select(rules.eta_text("d", "s", "z").alias("e"), rules.confidence("d", "s", "z").alias("c")).collect()
    assert [r.e for r in got] == ["3h 00m", "20h 00m", "Berthed", "Unknown", "1h 00m", ">72h"]
    assert [r.c for r in got] == [92, 74, 99, 74, 92, 74]
    score = spark.range(1).select(rules.congestion_score(F.lit(10), F.lit(5), F.lit(3.0), F.lit(1.5)).alias("s"))
    assert score.first().s == round(0.65 * 0.5 + 0.25 * 0.5 + 0.10 * 0.5, 2)
