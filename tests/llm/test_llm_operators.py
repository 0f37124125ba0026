"""Training-data operators against brute force on small tables with nulls, empty texts, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidewater.llm import (harmonic_packing, language_crf, license_scan, maxscore, quality_rules, queries,
                           sentencepiece_codec, simhash_balls, suffix_dedup, toxicity_crf, url_rules)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, core string, score string"


def make_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñß") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    base = text(150)
    near = base.split(" ")
    near[70] = "changed"
    texts = [None, "", " \n ", "x", base, base, " ".join(near), text(60) + "\n" + passage + "\n" + text(60),
             passage + text(40), text(20) + " " + passage, "ab " * 400, "ab " * 400, "é" * 500, text(6000),
             "Stupid LINE\nStupid LINE\n\nother # $ |", "a  b   c ", " lead", "▁ odd ▁▁ <|endoftext|> 's 't",
             "1 2 3\x1c4", "Über STRAßE İstanbul"]
    return texts + [text(rng.randint(1, 120)) for _ in range(30)]


@pytest.fixture(scope="module")
def rows():
    texts = make_texts()
    out = [(i, t, ["en", "de", None][i % 3], ["h1", "h2", None][i % 3], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    out.append(out[4])  # a repeated row
    out.append((None, texts[5], None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def records(df):
    return Counter(tuple(r) for r in df.collect())


def test_sentencepiece(docs, rows, empty):
    import sentencepiece
    model = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = Counter()
    for r in rows:
        ids = sp.encode(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    assert records(sentencepiece_codec.encode_documents(docs, model)) == want
    assert records(sentencepiece_codec.encode_documents(docs, model, max_chunks=5)) == want
    assert sentencepiece_codec.encode_documents(empty, model).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = harmonic_packing.pack_documents(docs.dropDuplicates(["doc_id"]), path).collect()
    for doc, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], np.uint32)
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        assert all(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        total = sum(p.length for p in own)
        assert total <= 4096 and total & (total - 1) == 0  # no padding at all
    assert harmonic_packing.pack_documents(empty, path).count() == 0
    assert harmonic_packing.pack_documents(docs, path).groupBy("doc_id").count().count() == len({r[0] for r in rows})


def test_packing_keeps_documents_whole():
    """Each closed bin: k whole items of class k and at most one head; few pieces; every id once; little held open."""
    rng = np.random.default_rng(4)
    lengths = np.r_[np.ones(9000, int), [4096, 8192, 4097, 2048, 2048, 1], rng.geometric(1 / 500, 4000), [90_000],
                    rng.integers(1, 60, 3000), np.full(70, 59)]
    packer, held = harmonic_packing.Packer(4096, 7 << 40), 0
    docs = [np.arange(n, dtype=np.uint32) + 1000 * i for i, n in enumerate(lengths)]
    for i, ids in enumerate(docs):
        packer.add(i, ids)
        for k, members in packer.open.items():
            assert len(members) <= k and all(4096 // (len(m[2]) // 4) == k for m in members)
        if i % 500 == 0:
            held = max(held, sum(len(m[2]) for members in packer.open.values() for m in members))
    packer.finish()
    assert held <= 4 * 4096 * 128 and not packer.open
    assert len(packer.rows) <= len(lengths) + packer.next_id - (7 << 40)  # one cut a sequence at most
    at = {}
    for doc, start, n, crc, tokens, sequence, offset in sorted(packer.rows, key=lambda r: (r[0], r[1])):
        assert start == at.get(doc, 0) and tokens == lengths[doc]
        assert crc == zlib.crc32(docs[doc][start:start + n].tobytes())
        at[doc] = start + n
    assert at == dict(enumerate(lengths))
    size = Counter()
    for r in packer.rows:
        size[r[5]] += r[2]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in size.values()) and sum(n < 4096 for n in size.values()) <= 12


def naive_repeats(rows, width):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i:i + width] for _, b in raw for i in range(len(b) - width + 1))
    out = Counter()
    for doc, b in raw:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                hit[i:i + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        spans = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        out[(doc, len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("group,shard", [(2048, 700_000), (2, 3_000)])
def test_suffix_dedup(docs, rows, empty, group, shard):
    """The second case splits nearly every group over shards and merges them by fingerprint."""
    assert records(suffix_dedup.dedup_documents(docs, group=group, shard_bytes=shard)) == naive_repeats(rows, 200)
    if group == 2:
        assert suffix_dedup.dedup_documents(empty).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    raw = bytes(rng.choice(b"ab\0") for _ in range(400)) * 2
    first, size = np.array([0, 300]), np.array([300, 500])
    windows = np.r_[np.arange(0, 281), np.arange(300, 781)]
    order = suffix_dedup.suffix_array(raw, first, size, windows, 20)
    assert [raw[p:p + 20] for p in order] == sorted(raw[p:p + 20] for p in windows)
    shared = suffix_dedup.common_prefixes(raw, order, 20)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1]:order[k - 1] + 20], raw[order[k]:order[k] + 20]
        assert shared[k] == next((i for i in range(20) if a[i] != b[i]), 20)


def test_quality_measures(docs, rows, empty):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == len({r[0] for r in rows})
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        n, hit, seen, lines = Counter(windows), set(), set(), 0
        for i, w in enumerate(windows):
            if n[w] > 1:
                hit |= {i, i + 1, i + 2}
        for line in (r[1] or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                lines += line in seen
                seen.add(line)
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), lines, len(hit))
        assert g.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (g.kept and g.base_failed)
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.keep_documents(docs).columns == docs.columns


def test_quality_hosts(spark):
    """A host full of failures rejects its weak documents only; clean documents of any host stay."""
    clean = " ".join(f"word{i}" for i in range(80))
    weak = " ".join(f"word{i}" for i in range(80)) + " # # # # # # # # # # #"
    data = [(i, weak, None, "bad", 0, "", "") for i in range(200)] + [(900, clean, None, "bad", 0, "", "")]
    data += [(1000 + i, clean, None, f"good{i % 5}", 0, "", "") for i in range(200)] + [(5000, weak, None, "good1", 0, "", "")]
    kept = {r.doc_id for r in quality_rules.judge(spark.createDataFrame(data, SCHEMA)).filter("kept").collect()}
    assert kept == {900, 5000, *range(1000, 1200)}


def test_quality_failing_host_among_many(spark):
    """One wholly failing host among a thousand of 20 % failures is bad; small and slightly weaker hosts are not."""
    from pyspark.sql import functions as F
    good = spark.range(1000 * 500).selectExpr("concat('good', id % 1000) host", "id div 1000 % 5 = 0 weak")
    more = spark.range(500).selectExpr("'failing' host", "true weak")
    more = more.union(spark.range(3).selectExpr("'tiny' host", "true weak"))
    more = more.union(spark.range(500).selectExpr("'weaker' host", "id % 10 < 3 weak"))
    zero = {m: F.lit(0) for m in quality_rules.MEASURES}
    rows = good.union(more).withColumns({**zero, "n_words": F.lit(100), "word_chars": F.lit(500), "base_failed": F.lit(False),
                                         "n_symbols": F.when(F.col("weak"), 50).otherwise(0)})
    assert {r.host for r in quality_rules.bad_hosts(rows).collect()} == {"failing"}
    # a tenth of the hosts failing, and a lone host without failures
    some = rows.withColumn("n_symbols", F.when(F.col("host").rlike("^good..?$"), 50).otherwise(F.col("n_symbols")))
    assert {r.host for r in quality_rules.bad_hosts(some).collect()} == {"failing", *(f"good{i}" for i in range(100))}
    assert quality_rules.bad_hosts(rows.filter("host = 'good1' and not weak")).count() == 0


def naive_bad_hosts(counts):
    """Hosts that go by the documented rule; each prior fitted anew, in plain numbers."""
    def moments(hosts, mean):
        rates = [f / n for n, f in hosts]
        raw = sum(rates) / len(rates)
        between = sum((r - raw) ** 2 for r in rates) / len(rates)
        return between - mean * (1 - mean) * sum(1 / n for n, _ in hosts) / len(hosts)

    bad = set()
    everyone = list(counts.values())
    overall = sum(f for _, f in everyone) / sum(n for n, _ in everyone)
    true_var = moments(everyone, overall)
    weight = max(overall * (1 - overall) / true_var - 1, 10.0) if true_var > 0 else 10.0
    for host, (n, failed) in counts.items():
        if (failed + overall * weight) / (n + weight) >= 0.8:
            bad.add(host)
        others = [c for h, c in counts.items() if h != host]
        if not others:
            continue
        mean = (sum(f / m for m, f in others) + 0.5) / (len(others) + 1)
        var = moments(others, mean)
        w = min(max(mean * (1 - mean) / var - 1, 10.0), 100.0) if var > 0 else 100.0
        own = (failed + mean * w) / (n + w)
        lower = own - 3 * (own * (1 - own) / (n + w + 1)) ** 0.5
        if lower > mean + 3 * max((mean * (1 - mean) / (w + 1)) ** 0.5, 0.05):
            bad.add(host)
    return bad


@pytest.mark.parametrize("seed", range(8))
def test_quality_host_verdict_equals_brute_force(spark, seed):
    """Random hosts of all sizes and rates, a null host among them."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(seed)
    base = rng.uniform(0, 0.5)
    counts = {}
    for h in [None, *(f"h{i}" for i in range(int(rng.choice([0, 1, 2, 12, 60]))))]:
        n = int(rng.choice([1, 3, 20, 150, 400]))
        rate = rng.uniform(0.5, 1) if rng.random() < 0.2 else np.clip(rng.normal(base, 0.1 * seed / 8), 0, 1)
        counts[h] = (n, int(rng.binomial(n, rate)))
    hosts = spark.createDataFrame([(h, *c) for h, c in counts.items()], "host string, n int, failed int")
    zero = {m: F.lit(0) for m in quality_rules.MEASURES}
    rows = hosts.select("host", "failed", F.explode(F.expr("sequence(1, n)")).alias("i")).withColumns(
        {**zero, "n_words": F.lit(100), "word_chars": F.lit(500), "base_failed": F.col("i") <= F.col("failed")})
    assert {r.host for r in quality_rules.bad_hosts(rows).collect()} == naive_bad_hosts(counts)


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64(" ".join(words[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if words and 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_rows(docs, rows, empty):
    fps = {r[0]: naive_fingerprint(r[1]) for r in rows}
    root = naive_components(sorted(set(fps.values())))
    low = {}
    for doc, f in fps.items():
        if doc is not None:
            low[root[f]] = min(low.get(root[f], doc), doc)
    want = Counter((r[0], f"{fps[r[0]]:016x}", low[root[fps[r[0]]]]) for r in rows)
    assert records(simhash_balls.near_duplicates(docs)) == want
    kept = simhash_balls.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(low.values())
    assert simhash_balls.near_duplicates(empty).count() == 0


def test_simhash_balls_find_all_distances(spark):
    """Chains and clusters up to three bits apart, in one block and across blocks, and pairs four bits apart."""
    rng = random.Random(11)
    fps = set()
    for _ in range(150):
        f = rng.getrandbits(64)
        fps.add(f)
        for n in (1, 2, 3, 3, 4):
            low = rng.choice([0, 22, 43, 0])
            bits = rng.sample(range(64) if rng.random() < 0.5 else range(low, min(64, low + 20)), n)
            fps.add(f ^ sum(1 << b for b in bits))
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    want = naive_components(sorted(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {int(np.int64(r.fp).astype(np.uint64)): r.root for r in simhash_balls.fingerprint_components(df).collect()}
    groups = lambda m: {frozenset(g) for g in _invert(m).values() if len(g) > 1}
    assert groups(got) == groups(want)


def _invert(m):
    out = {}
    for k, v in m.items():
        out.setdefault(v, set()).add(k)
    return out


def test_maxscore(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(size=12).round(1)]) for i in range(300)]
    data += [(300 + i, [0.5] * 12) for i in range(60)]  # ties
    data += [(400, None), (420, [None] * 12), (440, [float("nan")] * 12), (460, [float("inf")] * 12), (480, [1.0, 2.0]),
             (None, [1.0] * 12), (20, data[20][1])]
    df = spark.createDataFrame([(*d, "x") for d in data], "vec_id long, embedding array<float>, rank string")
    ok = {i: np.floor(64 * np.pad(np.float32(v).astype(float), (0, 12 - len(v)))).astype(int) for i, v in data
          if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in ok:
        if q % 20 == 0:
            best = sorted(((-int(ok[q] @ ok[c]), c) for c in ok if c != q))[:20]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    for shard, block in ((8192, 2048), (50, 7)):
        assert {tuple(r) for r in maxscore.top_k(df, shard_rows=shard, block_queries=block).collect()} == want
    assert maxscore.top_k(df.filter("false")).count() == 0


@pytest.mark.parametrize("scale,offset", [(20, 0), (3, 0), (20, 15), (3_000_000, 0)])
def test_maxscore_search_prunes_without_loss(scale, offset):
    """Equal to brute force for known and unknown thresholds, whatever the components' size; probing ends early."""
    rng = np.random.default_rng(scale + offset)
    d = np.floor(rng.normal(offset, scale, (3000, 64))).astype(np.int64)
    d[100:140] = d[100]  # ties
    d[200:230] = 0
    ids, asked = rng.permutation(3000) * 2, np.arange(0, 3000, 29)
    product = d[asked].astype(object) @ d.T.astype(object) if scale > 10 ** 6 else d[asked] @ d.T
    want = [sorted(((-int(s), int(i)) for s, i in zip(row, ids, strict=True) if i != ids[q]))[:20]
            for q, row in zip(asked, product, strict=True)]
    reached = np.array([-w[-1][0] for w in want], float)
    shares = []
    for theta in (None, reached):
        work = Counter()
        s, i = maxscore.search(ids, d, ids[asked], d[asked], step=512, theta=theta, work=work)
        assert [[(-int(a), int(b)) for a, b in zip(x, y, strict=True)] for x, y in zip(s, i, strict=True)] == want
        assert work["pairs"] == len(asked) * 3000
        shares.append(work["scored"] / work["pairs"])
    assert max(shares) < (0.9 if offset else 0.2)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://Example.ORG/es/x?y", "http://a.example.org/en/12", "http://example.org",
            "https://x.com/fr/", "https://x.com/de/#a", "http://notcom/fr/", "http://m.ads-track.example.net/en/1",
            "http://ads-track.example.com/de/1", "http://a.net/login", "http://a.net/x/login.html?b", "a://b://c/d",
            "http://É.org/É", "http://a.org:80/x", "http://x.example.org/en/1", "http://example.org/en/2"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")],
                               "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5] == ("example.org", "", None, "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7] == ("x.com", "/de/", "com/de/", "block")
    assert got[8][2:] == (None, "allow") and got[9][2:] == (None, "block") and got[10][2:] == ("com/de/", "block")
    assert got[11][3] == got[12][3] == "block" and got[13] == ("b:", "//c/d", None, "allow")
    assert got[14][0] == "É.org" and got[15][2:] == (None, "allow")
    # the index finds what running every rule finds
    for host, path in [(g[0], g[1]) for g in got.values()]:
        every = url_rules.RuleIndex(tuple(url_rules.Rule(r.verdict, r.pattern, (), r.name) for r in url_rules.RULES), {})
        assert every.judge(host, path) == url_rules.RuleIndex(url_rules.RULES, {"org": 9, "com": 1}).judge(host, path)
    assert url_rules.judge_urls(df.filter("false")).count() == 0


def test_url_index_equals_every_rule(spark, tmp_path):
    """Random URLs of the rules' own words, in both cases, with odd borders and a very long one: index, all rules and SQL."""
    import duckdb
    rng = random.Random(8)
    words = [*url_rules.HOST_LABELS, *url_rules.PATH_SEGMENTS, *url_rules.FILE_ENDINGS, "org", "com", "net", "example", "es",
             "en", "de", "fr", "1", "a", "É", "ſign-in", "ads track", "x\ny"]

    def part(most, between):
        out = "".join(rng.choice(words) + rng.choice(between) for _ in range(rng.randint(0, most)))
        return out.upper() if rng.random() < 0.3 else out
    urls = [f"http://{part(4, '...-')}{rng.choice(['com', 'org', 'net', ''])}{rng.choice(['/', ''])}"
            f"{part(5, '//..-_')}{rng.choice(['', '/', '?login', '#/login'])}" for _ in range(3000)]
    urls += ["http://a.net/" + "x/" * 200_000 + "Login", "http://a.net/Sign-In.php?x", "http://a.net/design-in/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {tuple(r) for r in url_rules.judge_urls(df).collect()}
    every = url_rules.RuleIndex(tuple(url_rules.Rule(r.verdict, r.pattern, (), r.name) for r in url_rules.RULES), {})
    parts = [url_rules.split_url(u) for u in urls]
    assert got == {(i, *p, *every.judge(*p)) for i, p in enumerate(parts)}
    verdicts = [r[4] for r in sorted(got)]
    assert verdicts[-3:] == ["block", "block", "allow"] and 600 < verdicts.count("block") < 2900
    path = str(tmp_path / "pages.parquet")
    df.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"create view pages as from '{path}'")
    assert set(con.execute(url_rules.ORACLE_SQL).fetchall()) == got
    # few candidates a URL, whatever the number of rules
    index = url_rules.RuleIndex(url_rules.RULES, url_rules.token_counts(df))
    runs = [len(index.always) + sum(len(index.by_token.get(t, ())) for t in set(url_rules.tokens_of("".join(p))))
            for p in parts]
    assert sum(runs) < len(url_rules.RULES) * len(runs) / 10


def test_license_alignment(spark, docs, rows, empty):
    notice = license_scan.TEMPLATES["mit-notice"]
    near = notice.replace("free of charge", "for free").replace("modify, merge", "change")
    filler = " ".join(f"w{i}" for i in range(500))
    data = [(0, f"{filler}\n{notice}\n{filler}"), (1, f"{filler} {near} {filler}"), (2, filler), (3, None),
            (4, notice + " " + notice), (5, "The work is licensed, the License says."), (6, "Released under the MIT License.")]
    got = {r.doc_id: r for r in license_scan.scan_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(7)] == ["mit-notice", "mit-notice", None, None, "mit-notice", None, "mit"]
    assert got[0].coverage == 1.0 and 0.8 <= got[1].coverage < 1
    assert data[0][1][got[0].start:got[0].end].split() == notice.rstrip(".").split()
    pairs = license_scan.align(list("xaybzcxd"), list("abcd"))
    assert pairs == [(1, 0), (3, 1), (5, 2), (7, 3)]
    assert license_scan.scan_documents(docs).count() == len(rows)
    assert license_scan.scan_documents(empty).count() == 0


def test_license_neighbours():
    """Neighbouring licenses and versions get their own name; all hits come with their spans."""
    gnu = "This work is licensed under the GNU {} Public License, {}."
    want = {"Licensed under CC BY 4.0.": "cc-by-4.0", "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0",
            "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
            "Licensed under CC BY-NC 3.0.": "cc-by-nc-3.0", gnu.format("General", "version 2"): "gpl-2.0",
            gnu.format("General", "version 3"): "gpl-3.0", gnu.format("Lesser General", "version 3"): "lgpl-3.0",
            gnu.format("Lesser General", "version 2.1"): "lgpl-2.1", gnu.format("Affero General", "version 3"): "agpl-3.0",
            gnu.format("General", "version 2.0"): "gpl-2.0", gnu.format("General", "version 2.7"): None,
            "Licensed under the Apache License, Version 1.1.": "apache-1.1",
            "Licensed under the Apache License 2.0.": "apache-2.0", "Released under the BSD 3-Clause License.": "bsd-3-clause",
            "Released under the ISC License.": "isc", "Licensed under the Mozilla Public License, version 2.0.": "mpl-2.0",
            "Released under the Unknown License.": None, "Licensed under the MIT License.": "mit"}
    scanner = license_scan.Scanner()
    assert {t: scanner.scan(f"Some words. {t} More words.")[0] for t in want} == want
    for name, template in license_scan.TEMPLATES.items():
        assert scanner.scan(template)[:2] == (name, 1.0)
    text = "Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0. Filler. Released under the MIT License. x Licensed under CC BY 4.0."
    hits = scanner.scan(text)[6]
    assert [(h["license"], text[h["start"]:h["end"]]) for h in hits] == [
        ("cc-by-4.0", "Licensed under CC BY 4.0"), ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
        ("mit", "Released under the MIT License"), ("cc-by-4.0", "Licensed under CC BY 4.0")]
    assert scanner.scan(text)[5] == 3


def labelled(spark):
    rng = random.Random(3)
    words = [f"plain{i}" for i in range(300)]
    data, labels = [], []
    for i in range(400):
        text = rng.choices(words, k=60)
        toxic = i % 5 == 0
        if toxic:
            for cue in rng.sample(["vile", "rotten", "nastyish", "nastyful"], 2):
                text[rng.randrange(60)] = cue
        data.append((i, " ".join(text), None, "s", 0, "", ""))
        labels.append((i, 1, int(toxic)))
    data += [(900, None, None, None, 0, "", ""), (901, "", None, None, 0, "", ""), (None, "vile", None, None, 0, "", "")]
    labels += [(None, 1, 1), (901, 1, None), (0, 1, 0)]
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    got = toxicity_crf.score_documents(docs, labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    assert {r.predicted for r in got if r.doc_id in (900, 901)} == {0}
    texts = {r.doc_id: r.text for r in docs.collect()}
    marked = {texts[r.doc_id][s.start:s.end] for r in got if r.predicted for s in r.spans}
    assert marked & {"vile", "rotten", "nastyish", "nastyful"}
    kept = toxicity_crf.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    none = toxicity_crf.score_documents(empty, labels.filter("false"))
    assert none.count() == 0
    assert {r.score for r in toxicity_crf.score_documents(docs, labels.filter("false")).collect()} == {0.0}


def test_toxicity_of_long_texts(spark):
    """A class that has only long texts is learned from stretches; one without any text is an error."""
    from pyspark.sql import functions as F
    docs, labels = labelled(spark)
    toxic = labels.filter("toxic = 1 and doc_id is not null").select("doc_id").distinct()
    long = docs.join(toxic, "doc_id").withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 40))
    mixed = long.select(docs.columns).union(docs.join(toxic, "doc_id", "left_anti").select(docs.columns))
    model = toxicity_crf.fit_documents(mixed, labels, per_class=300, max_chars=1_000)
    assert model.crf is not None
    scores = toxicity_crf.WordScores(model.crf, toxicity_crf.features)
    rows = mixed.filter("doc_id < 400").collect()
    got = model.tag([r.text for r in rows], scores)[0]
    assert sum((s >= 0.5) == (r.doc_id % 5 == 0) for s, r in zip(got, rows, strict=True)) >= 0.95 * len(rows)
    with pytest.raises(ValueError):
        toxicity_crf.fit_documents(docs.join(toxic, "doc_id", "left_anti"), labels)


def test_many_languages_and_long_texts(spark):
    """Every language is a label, be it the 104th or one whose texts are all long."""
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(104 * 5)]
    say = lambda lang, n: " ".join(rng.choice(stems[5 * lang:5 * lang + 5]) for _ in range(n))
    data = [(i * 200 + j, say(i, 3000 if i == 0 else 12), f"l{i:03}", "s", 0, "", "")
            for i in range(104) for j in range(4 if i == 103 else 6)]
    model = language_crf.fit_documents(spark.createDataFrame(data, SCHEMA))
    assert model.langs == sorted({d[2] for d in data})
    got = model.predict([d[1] for d in data], language_crf.WordScores(model.crf, model.features))
    assert all(g[0] == d[2] for g, d in zip(got, data, strict=True))


def test_forward_backward_matches_enumeration():
    from itertools import product

    from tidewater.llm.crf import forward_backward
    rng = np.random.default_rng(4)
    k, n = 3, 7
    e, trans, first = rng.random((n, k)) + 0.1, rng.random((k, k)) + 0.1, rng.random(k) + 0.1
    start = np.array([1, 0, 0, 1, 0, 0, 0], bool)
    total, pairs, weight_sum = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in product(range(k), repeat=n):
        w = np.prod([e[t, path[t]] * (first[path[t]] if start[t] else trans[path[t - 1], path[t]]) for t in range(n)])
        weight_sum += w
        for t in range(n):
            total[t, path[t]] += w
            if not start[t]:
                pairs[path[t - 1], path[t]] += w
    for steps in (1, 2, 3, 128):
        m, p = forward_backward(e, start, trans, first, steps)
        np.testing.assert_allclose(m, total / weight_sum, rtol=1e-9)
        np.testing.assert_allclose(p, pairs / weight_sum, rtol=1e-9)


def test_language(spark, empty):
    rng = random.Random(8)
    stems = {"aa": ["koro", "miku", "sata", "nori"], "bb": ["strag", "blenk", "thurm", "grost"]}
    say = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(["", "x", "yy"]) for _ in range(n))
    data = [(i, say(lang, 30), lang, "s", 0, "", "") for i in range(120) for lang in [["aa", "bb"][i % 2]]]
    data += [(500, None, "aa", None, 0, "", ""), (501, "12 -- 3", "aa", None, 0, "", ""), (502, say("bb", 5), None, None, 0, "", ""),
             (None, say("aa", 5), "aa", None, 0, "", ""), (503, say("aa", 6) + " " + say("bb", 30), None, None, 0, "", "")]
    got = {r.doc_id: r for r in language_crf.identify(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(got[i].lang_pred == ["aa", "bb"][i % 2] for i in range(120))
    assert (got[500].lang_pred, got[500].score) == (got[501].lang_pred, got[501].score) == ("und", 0.0)
    assert got[502].lang_pred == "bb" and got[None].lang_pred == "aa" and not got[None].held_out
    assert got[503].lang_pred == "bb" and 0.7 < got[503].score < 0.95  # words of both languages are told apart
    assert language_crf.identify(empty).count() == 0


def test_messages_by_document_match_blocks():
    from tidewater.llm import crf
    rng = np.random.default_rng(6)
    e, trans, first = rng.random((40, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    start = rng.random(40) < 0.2
    start[0] = True
    a, b = crf._by_block(e, start, trans, first, 8), crf._by_document(e, start, trans, first)
    for x, y in zip(a, b, strict=True):
        np.testing.assert_allclose(x / x.sum(1, keepdims=True), y / y.sum(1, keepdims=True), rtol=1e-9)


def test_letters_in_the_middle_are_read():
    """Languages that differ only in the middle of long words, and unspaced scripts; toxic stems inside joined words."""
    rng = random.Random(9)
    joined = lambda stem: "".join(rng.choices("abcde", k=9)) + stem + "".join(rng.choices("abcde", k=9))
    texts = [(" ".join(joined(rng.choice(stems)) for _ in range(12)), lang) for _ in range(60)
             for lang, stems in (("xx", ["korom", "mikul"]), ("yy", ["strag", "thurm"]))]
    han = {"zh": "的一是不了人我在有他", "ja": "日本語学校食水火木金"}
    texts += [("一" * 8 + "".join(rng.choices(own, k=40)) + "一" * 3, lang) for _ in range(60) for lang, own in han.items()]
    model = language_crf.fit([t for t, _ in texts[:200]], [lang for _, lang in texts[:200]])
    got = model.predict([t for t, _ in texts[200:]], language_crf.WordScores(model.crf, model.features))
    assert [g[0] for g in got] == [lang for _, lang in texts[200:]]
    assert language_crf.words_of("abc日本語 x") == ["abc", "日本", "本語", "x"]
    test = [" ".join(joined(s) for s in (["korom"] if lang == "xx" else ["strag"]) * 6) for lang in ("xx", "yy")]
    assert [p[0] for p in model.predict(test, language_crf.WordScores(model.crf, model.features))] == ["xx", "yy"]
    docs = [" ".join(joined("vile" if i % 3 == 0 and j == 5 else "") for j in range(10)) for i in range(300)]
    tox = toxicity_crf.fit(docs[:240], [int(i % 3 == 0) for i in range(240)])
    scores, spans = tox.tag(docs[240:], toxicity_crf.WordScores(tox.crf, toxicity_crf.features))
    assert sum((s >= 0.5) == (i % 3 == 0) for i, s in enumerate(scores, 240)) >= 54  # 40 are clean
    assert all("vile" in docs[240 + i][a:b] for i, own in enumerate(spans) for a, b in own)


def test_held_out_language_on_documents(spark):
    from tidewater.llm.common import table
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = language_crf.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    rows = got.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 0


def test_pipeline(spark):
    import corpus_pipeline
    docs, _ = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), None
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001").cache()
        assert after.columns == docs.columns, name
        assert after.count() <= before.count()
        before = after
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {
        r.doc_id for r in before.select("doc_id").collect()}


def test_suffix_dedup_many_equal_rows(spark):
    """Thousands of equal rows without ids: their spans are a set bounded by the text."""
    text = "".join(random.Random(9).choices("abcdefgh ", k=3000))
    docs = spark.createDataFrame([(None, text)] * 3000 + [(1, text), (2, "short")], "doc_id long, text string").repartition(4)
    _, spans = suffix_dedup.repeated(docs)
    assert spans.selectExpr("max(size(spans))").first()[0] < 100
    got = records(suffix_dedup.dedup_documents(docs))
    digest = hashlib.sha256(b"").hexdigest()
    assert got == {(None, 3000, 3000, 1, digest): 3000, (1, 3000, 3000, 1, digest): 1,
                   (2, 5, 0, 0, hashlib.sha256(b"short").hexdigest()): 1}


def test_leading_zero_bytes():
    rng = np.random.default_rng(3)
    x = np.r_[rng.integers(0, 2 ** 64, 2000, np.uint64) >> rng.integers(0, 64, 2000).astype(np.uint64),
              np.uint64(2 ** 64 - 1), np.uint64(0), np.uint64(1), np.uint64(2 ** 53 + 1), np.uint64(2 ** 56 - 1)]
    assert suffix_dedup._leading(x).tolist() == [8 - (int(v).bit_length() + 7) // 8 for v in x]


@pytest.mark.parametrize("text,words", [("हिन्दी भाषा है", ["हिन्दी", "भाषा", "है"]), ("مُحَمَّد كِتاب", ["مُحَمَّد", "كِتاب"]), ("été naïve", ["été", "naïve"]),
                                        ("עִבְרִית", ["עִבְרִית"]), ("a1b c_d", ["a", "b", "c", "d"])])
def test_letters_keep_their_marks(text, words):
    assert language_crf.words_of(text) == words


def test_unspaced_scripts_keep_their_marks():
    """Thai vowel and tone signs are letters of the pairs; every character is read."""
    pairs = language_crf.words_of("ภาษาที่นี้")
    assert all(len(p) == 2 for p in pairs) and {c for p in pairs for c in p} == set("ภาษาที่นี้")


def test_toxicity_words_with_marks():
    assert toxicity_crf._WORD.findall("गाली_1 न x²") == ["गाली_1", "न", "x²"]


def test_word_scores_hold_no_long_words():
    from tidewater.llm.crf import Crf, WordScores
    crf = Crf({"": 0, "a": 1}, np.array([[0.0, 0.0], [1.0, -1.0]]), np.zeros((2, 2)), np.zeros(2))
    scores = WordScores(crf, lambda w: [w[:1]])
    got = scores.potentials([["a", "b" * 500, "b"], ["a" * 500, "a"]])
    assert set(scores.at) == {"a", "b"} and len(scores.table) == 2
    assert (got == crf.emissions([["a"], ["b"], ["b"], ["a"], ["a"]])).all()


def test_language_sample_is_the_smallest_hashes(spark):
    rows = [(i, "hot" if i % 20 else f"l{i % 60}") for i in range(6000)]
    ids = spark.createDataFrame(rows, "_id long, _lang string")
    got = Counter(r._lang for r in language_crf.first_ids(ids, 100).collect())
    sizes = Counter(r[1] for r in rows)
    assert got == Counter({lang: min(100, n) for lang, n in sizes.items()})
    hashed = ids.selectExpr("_id", "_lang", "xxhash64(_id) & 9223372036854775807 h").collect()
    want = sorted((r.h, r._id) for r in hashed if r._lang == "hot")[:100]
    assert {r._id for r in language_crf.first_ids(ids, 100).filter("_lang = 'hot'").collect()} == {i for _, i in want}


def brute_licenses(scanner, text, name):
    """All stretches of a text against a template, then the same choice of stretches without overlap."""
    words = [scanner.ids.get(w, -1) for w in license_scan._WORD.findall(text.lower())]
    template = scanner.templates[name]
    reach, found = int(license_scan.REACH * len(template)) + 1, set()
    for a in range(len(words)):
        for b in range(a + 1, min(len(words), a + reach) + 1):
            found |= scanner._stretches(words, name, set(), a, b)
    return sorted((a, b) for _, a, b in license_scan._apart(found))


def test_license_short_templates_equal_brute_force():
    rng = random.Random(12)
    templates = {"a": "licensed under the open work license 2", "b": "the work is free for all of the world and the sea",
                 "c": "public domain"}
    scanner = license_scan.Scanner(templates, keys={"a": ["open work license"], "b": ["free for all"]})
    pool = sorted({w for t in templates.values() for w in t.split()}) + ["x", "y", "z"]
    hits = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            t = templates[rng.choice("abc")].split()
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(max(1, len(t)))
                t = rng.choice([t[:i] + t[i + 1:], t[:i] + [rng.choice(pool)] + t[i:], t])
            parts += t + [rng.choice(pool) for _ in range(rng.randint(0, 4))]
        text = " ".join(parts)
        spans = [m.span() for m in license_scan._WORD.finditer(text)]
        got = scanner.scan(text)[-1]
        for name in templates:
            want = [(spans[a][0], spans[b][1]) for a, b in brute_licenses(scanner, text, name)]
            assert sorted((h["start"], h["end"]) for h in got if h["license"] == name) == want, (name, text)
            hits += len(want)
    assert hits > 200


@pytest.mark.parametrize("n", [1, 2, 5, 10, 300])
@pytest.mark.parametrize("name", ["mit-notice", "isc-notice", "bsd-3-clause-notice"])
def test_license_adjacent_notices(n, name):
    notice = license_scan.TEMPLATES[name]
    hits = [h for h in license_scan.Scanner().scan("\n".join([notice] * n))[-1] if h["license"] == name]
    assert len(hits) == n and all(h["coverage"] == 1 for h in hits)


def test_license_word_after_it():
    got = license_scan.Scanner().scan("Licensed under the Common Development and Distribution License 1.1. The license")
    assert got[0] is not None and got[0].startswith("cddl")


def naive_kept(texts, width=200):
    """Texts without the bytes of strings that occur twice."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for t, b in zip(texts, raw, strict=True):
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                hit[i:i + width] = True
        out.append(t if t is None or not hit.any() else bytes(np.frombuffer(b, np.uint8)[~hit]).decode(errors="ignore"))
    return out


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns: each stage on its own input against its operator or brute force."""
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    long = " ".join(f"w{i % 300}x" for i in range(900))
    odd = [(9000, None, None, None, None), (9001, "", "en", "h", 0), (None, long, None, None, None), (None, long, None, None, None),
           (9002, long, "en", "h", 1), (9002, long, "en", "h", 1), (None, None, None, None, None)]
    docs = base.union(spark.createDataFrame(odd, base.schema))
    for name in ("core", "score", "spans", "root", "fp", "key", "toxic", "kept", "packed"):
        docs = docs.withColumn(name, docs["source"])
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    docs = written(docs, "docs")
    clean = written(stages["toxicity"](spark, docs, sf), "clean")
    flags = toxicity_crf.score_documents(docs, labels).groupBy("doc_id").agg({"predicted": "sum"}).collect()
    toxic = {r[0] for r in flags if r[1]}
    assert clean.columns == docs.columns and pairs(clean) == Counter({k: n for k, n in pairs(docs).items() if k[0] not in toxic})
    good = written(stages["quality_rules"](spark, clean, sf), "good")
    kept = Counter(r.doc_id for r in quality_rules.judge(clean).filter("kept").collect())
    assert good.columns == docs.columns and Counter(k[0] for k in pairs(good).elements()) == kept
    one = written(stages["simhash_near_dedup"](spark, good, sf), "one")
    groups = simhash_balls.near_duplicates(good).select("component_id").distinct().count()
    assert one.columns == docs.columns and one.count() == groups and not pairs(one) - pairs(good)
    cut = written(stages["suffix_array_dedup"](spark, one, sf), "cut")
    rows = one.select("doc_id", "text").collect()
    want = Counter(zip([r.doc_id for r in rows], naive_kept([r.text for r in rows]), strict=True))
    assert cut.columns == docs.columns and pairs(cut) == want
    assert cut.filter("n_chars <> length(text)").count() == 0
    pieces = stages["packing"](spark, cut, sf).collect()
    assert {p.doc_id for p in pieces} == {k[0] for k in want}


def test_pipeline_empty_table(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns


def test_suffix_array_sorts_windows_by_bytes_then_place():
    """Few letters and many repeats: windows equal a plain sort of their bytes, ties in the order of their places."""
    import random

    import numpy as np
    from tidewater.llm.suffix_dedup import suffix_array
    rng = random.Random(4)
    for width in (5, 8, 20, 200):
        texts = [bytes(rng.choice(b"ab") if rng.random() < 0.1 else 97 for _ in range(width + rng.randint(0, 40))) for _ in range(30)]
        size = np.array([len(t) for t in texts])
        raw, first = b"".join(texts), np.cumsum(size) - size
        windows = np.concatenate([np.arange(a, a + n - width + 1) for a, n in zip(first, size, strict=True)])
        got = suffix_array(raw, first, size, windows, width).tolist()
        assert got == sorted(windows.tolist(), key=lambda p: (raw[p:p + width], p))
