"""Periodic runs, url filters and embedding whitening against brute force."""

import hashlib
import random
import zlib
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from llm_inputs import AWKWARD, documents, rows, with_clashes

from sitehex.llm import periodic_runs, queries, url_filters, whitening

WORDS = "start length period n_runs exponent_milli runs_sha256 collapsed_sha256".split()


def all_runs(words, least=12):
    """Every maximal repetition by comparing each word with the one each period on."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(i, j) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_words(rng):
    kind, n = rng.random(), rng.randint(0, 150)
    if kind < 0.2:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind < 0.3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b
    words = []
    while len(words) < n:
        unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 11))]
        words += (unit * rng.randint(1, 14))[: rng.randint(1, 90)]
    # Touching repetitions of one word sequence in different phases, and all of it repeated.
    return words if kind < 0.7 else (words[: rng.randint(0, 40)] * rng.randint(1, 4) + words[:7]) * rng.randint(1, 3)


def test_runs_of_numbers_equal_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        words = some_words(rng)
        got = [tuple(map(int, r)) for r in zip(*periodic_runs.find_runs(np.array(words, np.int64)))]
        assert got == all_runs(words), words
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(20, np.int64), 5)


def brute_row(words):
    runs = all_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    digests = (sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))
    if not runs:
        return (0, None, None, None, None, *digests)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return (len(runs), s, n, q, 1000 * n // q, *digests)


def test_runs_of_documents_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["\t".join(f"w{w}é\x85" for w in some_words(rng)) for _ in range(120)]
    data = [(i % 100, t, "en", "a", 1) for i, t in enumerate(texts)] + [r for r in AWKWARD if r[0] != 6]
    df = with_clashes(documents(spark, data)).repartition(3)
    got = rows(periodic_runs.periodic_runs(df), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    split = lambda t: [w.decode() for w in (t or "").encode().split()]
    assert got == sorted(((d, *brute_row(split(t))) for d, t, *_ in data), key=repr)


def test_runs_of_a_long_text(spark):
    text = "x y " + "a b c " * 40_000 + "z"
    row = periodic_runs.periodic_runs(documents(spark, [(1, text, None, None, 0)])).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 2, 120_000, 3)
    assert row.collapsed_sha256 == hashlib.sha256(b"x y a b c z").hexdigest()
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0


def test_query_repeats_words_of_one_document_in_ten(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    changed = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        if n < 900:
            assert tuple(got[d.doc_id][1:]) == brute_row(words), d.doc_id
    assert changed > 5


def linked_pages(seed=1):
    """Pages of 60 hosts: links to blocked hosts, to trusted ones and to both, some in comments and scripts."""
    rng = random.Random(seed)
    hosts = [f"h{i}.example.{t}" for i in range(20) for t in ("com", "org", "net")] + ["x.NET", "plain"]
    styles = [
        '<a href="https://{}/en/1">x</a>', "<a class=x href='//{}/fr/2?y#z'>y</a>", "<A HREF=http://{}/de/>z</A>",
        '<!-- <a href="http://{}/">c</a> -->', "<script>'<a href=http://{}/>'</script>", '<a href="/local/{}">l</a>',
        '<a data-href="http://{}/">d</a>', '<link href="http://{}/">',
    ]
    out = []
    for i in range(200):
        html = "".join(rng.choice(styles).format(g) for g in rng.sample(hosts, rng.randint(0, 3)))
        out.append((i % 190, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{i}?q", f"<html>{html}</html>"))
    long = "<a <!-- " * 20_000 + "<script>" * 5_000
    return out + [
        (None, None, None), (7, "no scheme", ""), (8, "http://", None), (9, "http://a.net", ""), (9, "http://a.net", ""),
        (10, "HTTP://A.Example.NET/en/?x", long), (11, "https://é.org/fr/", "<a href='//h1.example.net/'>"), (12, "", "<a href=>"),
    ]


PAGES = "page_id bigint, url string, html string"
VERDICT = ("page_id", "host", "path", "rule", "verdict")


def test_url_verdicts_equal_sql(spark):
    pages = spark.createDataFrame(linked_pages(), PAGES)
    got = rows(url_filters.judge_urls(with_clashes(pages).withColumn("host", pages.url)), *VERDICT)
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    want = sorted(con.execute(url_filters.URL_SQL).fetchall(), key=repr)
    assert got == want
    by_links = [r for r in got if r[3] is None]
    assert {r[4] for r in by_links} == {"block", "allow"}
    assert sum(r[:3] == (9, "a.net", "") for r in got) == 2
    assert (10, "a.example.net", "/en/", "example.net/en/", "allow") in got


def test_scores_equal_matrix_iteration(spark):
    pages = spark.createDataFrame(linked_pages(2), PAGES)
    links = url_filters.staged(url_filters.host_links(pages), "links")
    judged = url_filters._judged(pages.select(*[c.alias(n) for c, n in zip(url_filters.host_and_path(pages.url), ("host", "path"))]), url_filters.RULES)
    hosts = url_filters._hosts(judged, links).collect()
    index = {h.host: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for link in links.collect():
        m[index[link.source], index[link.target]] = 1
    eye = np.eye(len(hosts))

    def solve(flow, seeds):
        share = flow / np.maximum(flow.sum(axis=1, keepdims=True), 1)
        return np.linalg.solve(eye - 0.85 * share.T, 0.15 * np.array(seeds))

    trust, distrust = solve(m, [h.trusted for h in hosts]), solve(m.T, [h.blocked for h in hosts])
    assert distrust.max() > 0 and trust.max() > 0
    scored = url_filters.propagate(spark.createDataFrame(hosts), links)
    for r in scored.collect():
        assert abs(r.trust - trust[index[r.host]]) < 1e-3 and abs(r.distrust - distrust[index[r.host]]) < 1e-3


def test_urls_of_an_empty_table(spark):
    assert url_filters.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_longest_rule_wins(spark):
    rules = (("com/", "block"), ("a.com/x", "allow"), ("a.com/y", "block"), ("a.com/y", "allow"))
    urls = ["http://a.com/", "http://b.a.com/xyz", "http://ba.com/x", "http://a.com/y", "http://acom/", "http://a.com"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    got = [r[3:] for r in rows(url_filters.judge_urls(pages, rules), *VERDICT)]
    assert got == [("com/", "block"), ("a.com/x", "allow"), ("com/", "block"), ("a.com/y", "block"), (None, "allow"), (None, "block")]


VECTORS = "vec_id bigint, embedding array<float>"


def brute_white(vectors, wanted=16):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    _, sizes, vt = np.linalg.svd((n * u - s) / n, full_matrices=False)
    e = sizes**2 / n
    keep = (e > 1e-12 * e.sum()) & (np.arange(len(e)) < wanted)
    z = ((n * x - s) / n) @ vt[keep].T / np.sqrt(e[keep])
    return n, ((n * x - s) ** 2).sum(axis=1), z, e[keep] / e.sum()


def check_white(df, ids, vectors, **options):
    got = whitening.whiten(df, **options).toPandas()
    n, deviation, z, explained = brute_white(vectors)
    count = z.shape[1]
    assert len(got) == len(ids) * count
    at = {i: k for k, i in enumerate(ids)}
    signs = {}
    for r in got.itertuples():
        k, c = at[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == deviation[k] and r.deviation_exact == str(deviation[k])
        assert abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9
        sign = signs.setdefault(c, np.sign(r.whitened * z[k, c])) if abs(z[k, c]) > 1e-6 else signs.get(c, 1)
        assert abs(r.whitened - sign * z[k, c]) < 1e-6
    return got


def test_whitening_equals_singular_values(spark):
    rng = np.random.default_rng(1)
    spread = np.linspace(1, 9, 24)
    vectors = rng.standard_normal((90, 24)) * spread
    vectors[60:] = vectors[0]
    table = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    bad = [
        (500, None), (501, [None] * 24), (502, [float("nan")] * 24), (503, [float("inf")] + [0.0] * 23), (504, []), (505, [1.0] * 3),
    ]
    df = with_clashes(spark.createDataFrame(table + bad, VECTORS).repartition(4)).withColumnRenamed("x", "y")
    df = df.selectExpr("*", "'own' as component", "'own' as whitened")
    check_white(df, list(range(90)), vectors)


def test_whitening_of_few_vectors(spark):
    vectors = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.5], [9.0, 2.0, 3.0], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], VECTORS)
    assert check_white(df, list(range(4)), vectors).component.max() == 2
    assert whitening.whiten(df.where("vec_id in (0, 3)")).count() == 0
    assert whitening.whiten(df.where("false")).count() == 0
    repeated = df.union(df).withColumn("vec_id", df.vec_id % 2)
    assert whitening.whiten(repeated).count() == 16
    assert whitening.whiten(df.selectExpr("cast(null as bigint) vec_id", "embedding")).where("vec_id is null").count() == 8


def test_deviation_beyond_a_long(spark):
    vectors = [[3e18, 0.0], [-3e18, 1.0], [3e38, 2.0]]
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], VECTORS)).where("component = 1").collect()
    held = [[min(max(int(np.float32(c)) * 64, -(1 << 61)), 1 << 61) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(column) for column in zip(*held)]
    for r in got:
        assert Decimal(r.deviation_exact) == sum((3 * x - s) ** 2 for x, s in zip(held[r.vec_id], sums)) and r.deviation is None


def bidiagonal(x, wanted, **options):
    x = x - x.mean(axis=0)

    def product(p, w):
        t = x @ p
        return x.T @ t, float(t @ t), (x @ w).T @ t

    return x, *whitening.bidiagonalise(product, x.shape[1], wanted, float(np.linalg.norm(x)), **options)


def test_bidiagonalisation_of_equal_and_missing_directions():
    rng = np.random.default_rng(2)
    basis, turn = np.linalg.qr(rng.standard_normal((200, 32)))[0], np.linalg.qr(rng.standard_normal((32, 32)))[0]
    equal = basis * np.r_[[5.0] * 6, [3.0] * 6, [1.0] * 20] @ turn
    low_rank = rng.standard_normal((100, 4)) @ rng.standard_normal((4, 32))
    for x in (equal, low_rank, rng.standard_normal((3, 32)), np.eye(12), rng.standard_normal((300, 32)) * np.logspace(5, -3, 32)):
        x, values, right, _ = bidiagonal(x, 10)
        want = np.r_[np.linalg.svd(x, compute_uv=False), np.zeros(32)][: len(values)]
        assert np.abs(values - want).max() < 1e-12 * np.linalg.norm(x)
        kept = right[:, values > 1e-6 * values[0]] / values[values > 1e-6 * values[0]]
        assert np.abs(kept.T @ x.T @ x @ kept - np.eye(kept.shape[1])).max() < 1e-9


def test_wide_vectors_stop_early():
    rng = np.random.default_rng(3)
    x, values, right, steps = bidiagonal(rng.standard_normal((500, 300)) * np.linspace(3, 1, 300) ** 4, 8, full_steps=64)
    assert steps < 200
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:8], rtol=1e-12)
