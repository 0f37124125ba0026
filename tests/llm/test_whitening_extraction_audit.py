"""Whitening, HTML extraction and the filter audit against brute force, with nulls, odd values and repeated rows."""

import html
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import filter_audit, html_crf, labelled_pages, queries, whitening
from tidewater.llm.dom_blocks import blocks

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, x string, n string, component string"


# --- whitening -------------------------------------------------------------------------------------------------------

def eigen_cases():
    rng = np.random.default_rng(0)
    b, q = rng.standard_normal((40, 90)), np.linalg.qr(rng.standard_normal((8, 8)))[0]
    low = rng.standard_normal((24, 5))
    return {"random": b @ b.T, "low rank": low @ low.T, "identity": 3 * np.eye(9), "zero": np.zeros((4, 4)),
            "equal values": np.diag([1.0, 1, 1, 5, 5, 0]), "graded": np.diag(10.0 ** -np.arange(14)), "one": np.array([[2.0]]),
            "signs": np.array([[0.0, 1], [1, 0]]),
            "cluster": q @ np.diag([1, 1 + 1e-9, 1 + 2e-9, 2, 2, 3, 7, 7 + 1e-7]) @ q.T}


@pytest.mark.parametrize("name", list(eigen_cases()))
def test_spectral_divide_and_conquer(name):
    a = eigen_cases()[name]
    e, v = whitening.spectral(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * size
    assert np.abs(a @ v - v * e).max() <= 1e-14 * size
    assert np.abs(v.T @ v - np.eye(len(a))).max() <= 1e-14


def test_polar_factor():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - v @ np.diag(np.sign(e)) @ v.T).max() < 1e-13


def brute_whitening(rows, k=16):
    rows = [(r[0], r[1]) for r in rows if r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    length = Counter(len(v) for v in {tuple(r[1]) for r in rows})
    d = max(length, key=lambda n: (length[n], n))
    ints = [(i, tuple(int(np.floor(64 * c)) + 1000000 for c in v)) for i, v in rows if len(v) == d]
    fit = sorted({x for _, x in ints})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([c / n for c in s])
    c = np.array(fit) - mean
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [(i, n, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x) - mean) @ v / np.sqrt(e), e / np.trace(c.T @ c / n))
            for i, x in ints]


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(6) * [5, 4, 3, 2, 1, 0.5]).tolist(), "x", None, "c") for i in range(300)]
    rows += [rows[3]] * 40 + [(900, rows[3][1], None, None, None), (None, rows[5][1], None, None, None)]
    return rows + [(901, None, "x", "y", "z"), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0], "", "", ""), (903, [float("nan")] * 6, "", "", ""),
                   (904, [float("inf")] + [0.0] * 5, "", "", ""), (905, [], "", "", ""), (906, [1.0, 2.0], "", "", "")]


def test_whitening_against_numpy(spark):
    rows = odd_vectors()
    got = whitening.whiten_vectors(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    want = brute_whitening(rows)
    assert len(got) == len(want) * 6
    assert Counter(r.vec_id for r in got) == Counter({k: 6 * v for k, v in Counter(w[0] for w in want).items()})
    by_id = defaultdict(dict)
    for r in got:
        by_id[r.vec_id][r.component] = r
    sign = None
    for i, n, deviation, white, explained in want:
        own = [by_id[i][c] for c in range(1, 7)]
        assert all(r.n == n and r.deviation == deviation for r in own)
        assert np.allclose([r.explained for r in own], explained, rtol=1e-9)
        mine = np.array([r.whitened for r in own])
        sign = np.sign(mine * white) if sign is None else sign
        assert np.abs(mine - sign * white).max() < 1e-9
        assert all(r.identity_error < 1e-9 for r in own)


def test_whitening_defined_cases(spark):
    none = whitening.whiten_vectors(spark.createDataFrame([], VECTORS))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert none.count() == 0
    same = whitening.whiten_vectors(spark.createDataFrame([(1, [0.5, 2.0], "", "", ""), (2, [0.5, 2.0], "", "", "")], VECTORS)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == \
        {(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    flat = [(i, [float(i), 7.0, float(-i)], "", "", "") for i in range(50)]  # one direction only
    rows = whitening.whiten_vectors(spark.createDataFrame(flat, VECTORS)).collect()
    assert all((r.whitened is not None) == (r.component == 1) for r in rows) and all(r.identity_error < 1e-9 for r in rows)
    huge = [(1, [1e300], "", "", ""), (2, [-1e300], "", "", ""), (3, [0.0], "", "", "")]
    rows = whitening.whiten_vectors(spark.createDataFrame(huge, VECTORS)).collect()
    assert {r.deviation for r in rows if r.vec_id != 3} == {2 ** 63 - 1} and len(rows) == 3


def test_whitening_query_whole_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.op11_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    want = {w[0]: w for w in brute_whitening([tuple(r) for r in vectors])}
    ids = got.vec_id.to_numpy()[::16]
    assert sorted(want) == ids.tolist() and (got.deviation.to_numpy()[::16] == [want[i][2] for i in ids]).all()
    mine, white = got.whitened.to_numpy().reshape(-1, 16), np.stack([want[i][3] for i in ids])
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-9 and got.identity_error.max() < 1e-12


# --- HTML extraction -------------------------------------------------------------------------------------------------

def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def model(spark):
    return html_crf.fit_pages(spark.read.parquet(f"{SF}/pages.parquet"))


def test_extraction_query_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op12_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_extraction_unseen_layouts(model):
    made, right, n, whole = labelled_pages.Layouts(4711), 0, 0, 0
    for _ in range(300):
        found, labels = labelled_pages.labelled(made.page())
        mine = model.labels(found)
        right += sum(a == bool(b) for a, b in zip(mine, labels))
        n += len(labels)
        whole += [int(a) for a in mine] == labels
    assert right / n > 0.985 and whole / 300 > 0.88


@pytest.mark.parametrize("page,want", [
    ("", ""), (None, ""), ("<html><body></body></html>", ""), ("<script>a()</script><style>p{}</style>", ""),
    ("<nav><a href=a>Home</a> <a href=b>News</a></nav><article><h1>On &amp; off</h1><p>Be.</p><p>a &lt;b&gt; &amp;amp; c&nbsp;d  e\n f<br>g</article>",
     "On & off\nBe.\na <b> &amp; c d e f g"),
    ("<header><a href=/>Site</a></header><main><p>The story began in the old town, where nobody came.<p>It went on.</main>"
     "<aside class=sidebar><p>Most read stories of the week.</p></aside><form><p>Sign up for our letter, please.</p><button>Send</button></form>"
     "<section id=comments><h3>2 comments</h3><div class=comment><p>I liked this story very much, thank you.</p></div></section>"
     "<footer>&copy; 2020 All rights reserved.</footer>", "The story began in the old town, where nobody came.\nIt went on."),
    ("<div class=cookie-notice><p>This page stores a few things on your device.</p></div><div class=post-content><p>All rights reserved.</p>"
     "<p>Subscribe, said the man in the long coat.</p></div><div class=advert>Buy the new coat of the season now.</div>",
     "All rights reserved.\nSubscribe, said the man in the long coat."),
    ("<article><p>Unclosed <b>bold<p>next <i>one</article><footer>x", "Unclosed bold\nnext one"),
])
def test_extraction_pages(model, page, want):
    assert model.text(page) == want


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7):
        scores, trans, first = rng.standard_normal(n).tolist(), rng.standard_normal((2, 2)), rng.standard_normal(2)
        value = lambda y: (first[y[0]] if y else 0) + sum(s for s, a in zip(scores, y) if a) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert [int(a) for a in html_crf.viterbi(scores, trans, first)] == list(best)


@pytest.mark.parametrize("page", ['<p class="' * 20000, "<!--" * 20000, "<div>" * 20000 + "x", "<a b='\"" * 20000, "<" * 30000,
                                  "<table>" * 9000 + "<p>x</div>" * 9000, "<p><button>" * 9000 + "<div>" * 9000 + "</p>" * 9000,
                                  "<section><table>" + "<div>" * 9000 + "</section>" * 9000])
def test_blocks_broken_pages(page):
    assert isinstance(blocks(page), list)


def test_blocks_end_what_html_ends():
    got = [(b.text, b.around) for b in blocks("<ul><li>a<li>b<ul><li>c</ul>d</ul><dl><dt>e<dd>f</dl><table><tr><td>g<td>h<tr><td>i</table>j")]
    assert [g[0] for g in got] == list("abcdefghij")
    assert [len(g[1]) for g in got] == [2, 2, 2, 2, 2, 2, 3, 3, 3, 0]


def test_extraction_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = "<article><p>One two three.</p></article>"
    rows = [(1, "u", page, "t", "n"), (1, "u", page, "t", "n"), (None, None, page, None, None), (2, None, None, None, None), (3, "", "", "", ""),
            (4, "long", "<article>" + "<p>word word.</p>" * 40000, "", "")]
    got = Counter((r.page_id, r.url, r.n_chars) for r in html_crf.extract_pages(spark.createDataFrame(rows, schema)).collect())
    assert got == {(1, "u", 14): 2, (None, None, 14): 1, (2, None, 0): 1, (3, "", 0): 1, (4, "long", 11 * 40000 - 1): 1}
    assert html_crf.extract_pages(spark.createDataFrame([], schema)).count() == 0


# --- filter audit ----------------------------------------------------------------------------------------------------

def brute_audit(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and i > smallest[t]}
        docs.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        left = list(docs)
        for step, f in enumerate(order, 1):
            for part in {d[0] for d in docs}:
                own = [d for d in left if d[0] == part]
                gone = [d for d in own if d[1][f]]
                out[part, "".join(order), step] = [
                    len(own) - len(gone), len(gone), sum(d[0] == part and d[1][f] for d in docs) - len(gone),
                    sum(d[0] == part and d[1][f] and sum(d[1].values()) == 1 for d in docs), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
            left = [d for d in left if not d[1][f]]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAéß") for _ in range(rng.randint(1, 6)))
    texts = [None, "", " \t\n", "a" * 9, "AB #", "x|y", *(" ".join(word() for _ in range(rng.randint(1, 400))) for _ in range(25)),
             "w " * 300, "\x0b".join(word() for _ in range(250)), "w\x1cw  " * 150]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [rows[7]] * 5 + [(None, texts[9], "en"), (None, texts[9], "en"), (None, "only nameless", "fr"), (500, "w " * 20000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, lang string, part string, bits string, id string")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit_documents(docs.repartition(5), marks).collect()
    assert {tuple(r) for r in got} == brute_audit(rows, labels) and len(got) == 600 * 4
    assert filter_audit.audit_documents(docs.limit(0), marks).count() == 0
    assert filter_audit.audit_documents(docs, marks.limit(0)).filter("good_lost > 0 or toxic_lost > 0").count() == 0
