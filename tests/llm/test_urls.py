"""URL filters: rules against a plain reading, trees by held-out accuracy."""

import numpy as np

from rewardframe.llm import urls
from rewardframe.llm.common import read

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", "no scheme", "://", "http://", "http://COM", "http://a.COM/", "http://www.example.com/en/x", "http://example.com/en/",
    "http://x.www.example.com/en/?q", "http://badexample.com/en/1", "http://a.net/es", "http://a.net/es/", "http://net/fr/?a=1#b",
    "http://a.com?x=/en/", "http://a.com#x", "x://y://a.com/", "http://a.com/p?u=http://b.net/es/", "http://a.com/\nq", "http://é.net/fr/é",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules(spark):
    pages = spark.createDataFrame(list(enumerate(ODD)) + [(99, ODD[6]), (99, ODD[6]), (None, ODD[6])], "page_id int, url string")
    rows = urls.op7_urls(pages.withColumn("label", pages["url"])).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        if r.page_id is not None and r.page_id < 99:
            host, path, rule, verdict = plain(ODD[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule), ODD[r.page_id]
            assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")


def test_given_pages(spark):
    pages = read(spark, SF, "pages")
    want = {r.page_id: plain(r.url) for r in pages.select("page_id", "url").collect()}
    rows = urls.op7_urls(pages).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in rows} == {k: v[:3] for k, v in want.items()}
    assert all(r.verdict == want[r.page_id][3] for r in rows if r.rule)


def test_held_out_urls(spark):
    """Verdicts of the trees on labelled URLs whose labels they have not learned from."""
    pages = read(spark, "/root/testdata/sf0.1", "pages")
    want = {r.page_id: plain(r.url)[3] for r in pages.select("page_id", "url").collect()}
    rows = [r for r in urls.judge(pages, leave_out=2).collect() if r.fold == 2 and want[r.page_id]]
    right = [(r.block_odds > 0) == (want[r.page_id] == "block") for r in rows]
    blocked = np.mean([want[r.page_id] == "block" for r in rows])
    # the rules go by paths, which lexical features do not tell: about 0.72, where one verdict for all has 0.68
    assert len(rows) > 100 and np.mean(right) > max(blocked, 1 - blocked)


def test_no_labels_tell_on_themselves(spark):
    """Suffix statistics of a labelled row hold no labels of its own fold."""
    rows = [(i, f"http://h{i % 7}.net/{'es' if i % 3 else 'en'}/{i}") for i in range(300)] + [(1000, "http://h1.org/")]
    df = spark.createDataFrame([(i, u, i % 5, (i % 3 > 0) * 1 if i < 1000 else None, "net" if i < 1000 else "org", f"h{i % 7}.net") for i, u in rows], "id int, url string, fold int, label int, last1 string, last2 string")
    for r in urls.with_suffixes(df).collect():
        others = [(i % 3 > 0) * 1 for i, _ in rows if i < 1000 and i % 5 != r.fold] if r.label is not None else [] if r.last1 == "org" else None
        overall = np.mean([(i % 3 > 0) * 1 for i in range(300)])
        share = (sum(others) + urls.PRIOR_WEIGHT * overall) / (len(others) + urls.PRIOR_WEIGHT)
        assert abs(r.u_last1_share - share) < 1e-12 and abs(r.u_last1_count - np.log1p(len(others))) < 1e-12


def test_sample_is_bounded(spark):
    df = spark.range(5000).selectExpr("id", "xxhash64(id) as draw", "cast(id % 2 as int) as label", "double(id) as u")
    x, y = urls.labelled_sample(df, ["u"], 700)
    order = df.selectExpr("id", "shiftrightunsigned(draw, 40) as d").orderBy("d").limit(700).collect()
    assert 600 < len(y) <= 700 and {int(v) for v in x[:, 0]} <= {r.id for r in order}
    same = spark.range(5000).selectExpr("7L as draw", "1 as label", "double(id) as u")
    assert len(urls.labelled_sample(same, ["u"], 700)[1]) == 700
    assert len(urls.labelled_sample(same.limit(0), ["u"], 700)[1]) == 0


def plain_boost(x, y):
    """Boosting by trying every feature and cut for every node."""
    share = y.mean()
    odds = np.full(len(y), np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, urls.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    for _ in range(urls.TREES):
        p = 1 / (1 + np.exp(-odds))
        slope, weight = y - p, p * (1 - p)

        def grow(rows, depth):
            if depth == urls.DEPTH:
                odds[rows] += urls.RATE * slope[rows].sum() / (weight[rows].sum() + urls.RIDGE)
                return
            total = slope[rows].sum() ** 2 / (weight[rows].sum() + urls.RIDGE)
            best, choice = 1e-6, None
            for j in range(x.shape[1]):
                for c in cuts[j]:
                    low = x[rows, j] <= c
                    gain = sum(slope[rows][m].sum() ** 2 / (weight[rows][m].sum() + urls.RIDGE) for m in (low, ~low)) - total
                    if gain > best + 1e-12:
                        best, choice = gain, low
            low = choice if choice is not None else np.ones(len(rows), dtype=bool)
            grow(rows[low], depth + 1)
            grow(rows[~low], depth + 1)

        grow(np.arange(len(y)), 0)
    return odds


def test_trees_equal_plain_boosting(monkeypatch):
    monkeypatch.setattr(urls, "TREES", 6)
    monkeypatch.setattr(urls, "DEPTH", 3)
    monkeypatch.setattr(urls, "BINS", 8)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(160, 4)), 2)
    y = ((x[:, 0] + x[:, 1] > 0) ^ (rng.random(160) < 0.1)).astype(float)
    assert np.allclose(urls.boost(x, y).log_odds(x), plain_boost(x, y), atol=1e-9)


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] + 0.2 * x[:, 5] > 0)).astype(float)
    trees = urls.boost(x[:2000], y[:2000])
    assert np.mean((trees.log_odds(x[2000:]) > 0) == y[2000:]) > 0.93


def test_no_labels_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.op7_urls(pages).collect()} == {"allow"}
    assert urls.op7_urls(pages.limit(0)).count() == 0
