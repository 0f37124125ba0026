"""URL filter with pattern rules indexed by their rarest literal token (operator 7).

A rule is a regular expression over host and path together with literal tokens (runs of ASCII letters and digits,
A-Z lower-cased) that every matching URL holds as whole tokens.  The tokens' frequencies are counted over the whole table (only tokens that
rules hold, so the counts are bounded by the rules); each rule is filed under its rarest token.  A URL's tokens fetch
candidate rules, and only those run their expressions.  The longest matching host and path rule decides, else any
matching pattern rule, else the URL is allowed.  The rules are a parameter; ``pattern_rules`` makes them from lists of
host labels, path segments and file endings.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is allowed; repeated rows are judged
each; only A-Z are lower-cased, in the host that is reported; pattern rules read the path in lower case too.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_TOKEN = re.compile("[0-9A-Za-z]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_AFTER_HOST = re.compile("[/?#]")
_AFTER_PATH = re.compile("[?#]")


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.translate(_LOWER))


@dataclass(frozen=True)
class Rule:
    """``name``: what is reported (None: a pattern rule, which reads the path in lower case); ``pattern`` matches the
    whole of host + path, in the syntax that Python and RE2 share."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None


def host_rule(text: str, verdict: str) -> Rule:
    """``host/path``: the host and its subdomains, paths that start with the path."""
    host, _, path = text.partition("/")
    inner = tokens_of("/" + path)
    if path and path[-1].isalnum():
        inner.pop()  # a URL's token may go on there
    return Rule(verdict, rf"(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}.*", (*tokens_of(host), *inner), text)


def label_rule(label: str) -> Rule:
    """A whole label of the host, not its last."""
    return Rule("block", rf"(?:[^/]*\.)?{re.escape(label)}\..*", tuple(tokens_of(label)))


def segment_rule(segment: str) -> Rule:
    """A whole segment of the path, or its part before the first dot."""
    return Rule("block", rf"[^/]*/(?:.*/)?{re.escape(segment)}(?:[/.].*)?", tuple(tokens_of(segment)))


def ending_rule(ending: str) -> Rule:
    """A path that ends with this file ending."""
    return Rule("block", rf"[^/]*/.*\.{re.escape(ending)}", (ending,))


#: Host and path rules.
NAMED_RULES = (
    host_rule("org/", "allow"),
    host_rule("example.org/es/", "block"),
    host_rule("example.org/en/1", "block"),
    host_rule("com/fr/", "allow"),
    host_rule("com/de/", "block"),
)
#: Hosts of advertising, counting and short links; pages of accounts, shops, searches and servers; files that hold no text.
HOST_LABELS = """ad adclick adimg ads ads-track adserv adserver adservice adsrv adx affiliate affiliates banner banners
    beacon casino clicks clicktrack counter metrics pixel poker popunder promo-click shortlink stats-pixel telemetry
    track tracker tracking traffic-exchange webcam-chat""".split()
PATH_SEGMENTS = """account-recovery add-to-cart addtocart admin basket calendar-export captcha cart cgi-bin checkout
    compare-products create-account edit-profile forgot-password forgotpassword log-in log-out login logon logout lostpassword
    my-account myaccount oauth oauth2 order-status password-reset phpmyadmin print-preview register registration
    reset-password search-results server-status share-by-email shopping-cart sign-in sign-out sign-up signin signout
    signup sso subscribe tell-a-friend trackback unsubscribe wishlist wp-admin wp-cron wp-json wp-login
    xmlrpc""".split()
FILE_ENDINGS = """7z aac apk avi bin bmp bz2 cab css dat deb dll dmg doc docx eot exe flac flv gif gz ico iso jar jpeg jpg
    js m4a m4v mid mkv mov mp3 mp4 mpeg mpg msi ogg ogv pkg png ppt pptx psd rar rpm svg swf tar tgz tif tiff torrent
    ttf wav webm webp wma wmv woff woff2 xls xlsx xz zip zst""".split()


def pattern_rules(labels: Iterable[str] = HOST_LABELS, segments: Iterable[str] = PATH_SEGMENTS,
                  endings: Iterable[str] = FILE_ENDINGS) -> tuple[Rule, ...]:
    return (*map(label_rule, labels), *map(segment_rule, segments), *map(ending_rule, endings))


RULES = (*NAMED_RULES, *pattern_rules())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = _AFTER_HOST.search(rest)
    host = rest[:end.start()] if end else rest
    return host.translate(_LOWER), _AFTER_PATH.split(rest[len(host):], maxsplit=1)[0]


class RuleIndex:
    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        self.always: list[tuple[Rule, re.Pattern]] = []  # rules without a literal token
        for r in rules:
            entry = (r, re.compile(r.pattern, re.S))
            if r.tokens:
                self.by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule, verdict)."""
        whole, low = host + path, host + path.translate(_LOWER)
        found = list(self.always)
        for token in set(_TOKEN.findall(low)):
            found += self.by_token.get(token, ())
        hits = [r for r, p in found if p.fullmatch(whole if r.name else low)]
        named = [r for r in hits if r.name]
        if named:
            best = max(named, key=lambda r: (len(r.name), r.name))
            return best.name, best.verdict
        return None, "block" if any(r.verdict == "block" for r in hits) else "allow"


def token_counts(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> dict[str, int]:
    """In how many rows each token of the rules occurs."""
    wanted = {t for r in rules for t in r.tokens}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for url in b.column("url").to_pylist():
                n.update(wanted.intersection(tokens_of("".join(split_url(url)))))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())],
                                         names=["token", "n"])

    rows = urls.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    urls = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url")
    counts = token_counts(urls.select("url"), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for b in batches:
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            judged = [index.judge(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), *(pa.array([x[i] for x in rows], pa.string()) for rows in (parts, judged)
                                        for i in (0, 1))], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, SCHEMA)


#: The same judgement as DuckDB SQL.
ORACLE_SQL = rf"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (
  SELECT page_id, host, path,
    CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_full_match(host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '{"|".join(r.pattern for r in RULES if not r.name)}', 's') THEN 'block'
       ELSE 'allow' END AS verdict
FROM d
"""
