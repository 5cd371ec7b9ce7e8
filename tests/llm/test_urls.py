import random

import numpy as np
from pyspark.sql import functions as F

from promptloom.llm import urls
from promptloom.llm.queries import QUERIES

from .conftest import rows_of


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def rule(host, path):
    fits = []
    for verdict, text in urls.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "x", "http://", "HTTP://A.NET", "http://a.net/", "http://net/x", "http://xnet/", "http://Example.NET/en/1", "http://example.net/EN/1",
    "https://a.example.net/en/?q=1://b", "http://a.org/fr/", "http://a.org/fr", "http://org/fr/x#y/z", "http://sub.example.com/de/", "http://example.com?x=/de/",
    "a://b://c.net/", "http://ÄB.net/é", "http://a.net\n/x", "//a.net/", "http://user:pw@example.net/en/", "http://" + "a" * 20000 + ".net/" + "x/" * 3000,
]


def test_hosts_paths_and_rules(spark):
    rows = [(k, u, "x", 1.0) for k, u in enumerate(URLS)] + [(3, URLS[3], "y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, block_score double")
    ours = rows_of(urls.judge(pages), "page_id", "host", "path", "rule")
    want = sorted(((k, *split(u), rule(*split(u))[0]) for k, u, _, _ in rows), key=repr)
    assert ours == want
    verdicts = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    assert all(verdicts[k] == rule(*split(u))[1] for k, u, _, _ in rows if rule(*split(u))[1])
    assert set(verdicts.values()) <= {"allow", "block"}


def test_empty_and_undecided(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages).count() == 0
    pages = spark.createDataFrame([(1, "http://a.io/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(pages).collect()} == {"allow"}


def test_trees_on_held_out_urls(spark):
    draw = random.Random(6)
    rows = []
    for k in range(1200):
        bad = draw.random() < 0.4
        name = "".join(draw.choices("abcdefgh", k=8))
        if bad:
            url = f"http://{name}-win{draw.randint(10, 99)}.biz/x{draw.randint(1000, 99999)}?a=1&b={draw.randint(0, 999)}&c=3"
        else:
            url = f"https://www.{name}.io/articles/{name}/"
        rows.append((k, url, int(bad)))
    frame = spark.createDataFrame(rows, "page_id long, url string, label int")
    frame = frame.withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))})
    model = urls.learn(frame.where("page_id % 3 != 0"))
    held = model.score(frame.where("page_id % 3 = 0")).collect()
    assert np.mean([(r.block_score >= 0.5) == bool(r.label) for r in held]) > 0.97


def test_trees_on_held_out_endings(spark):
    """Endings that occur once say nothing of others, though they know their own label."""
    draw = random.Random(12)
    rows = []
    for k in range(900):
        bad = int(draw.random() < 0.5)
        name = "".join(draw.choices("abcdefgh", k=10))
        rows.append((k, f"http://{name}.e{k}/" + (f"p{draw.randint(1000, 99999)}?a=1&b=2" if bad else "articles/one/two/"), bad))
    frame = spark.createDataFrame(rows, "page_id long, url string, label int")
    frame = frame.withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))})
    model = urls.learn(frame.where("page_id % 3 != 0"), trees=5)
    held = model.score(frame.where("page_id % 3 = 0")).collect()
    assert np.mean([(r.block_score >= 0.5) == bool(r.label) for r in held]) > 0.97


def test_statistics_count_all_rows_and_copies_do_not_fill_the_sample(spark, monkeypatch):
    draw = random.Random(8)
    urls_of = [(f"http://{''.join(draw.choices('abcdefgh', k=8))}.e{k % 1500}.io/", int(k % 1500 < 700)) for k in range(3000)]
    frame = spark.createDataFrame(urls_of, "url string, label int")
    least = frame.orderBy(F.xxhash64("url")).first()
    frame = frame.unionByName(spark.createDataFrame([(least.url, least.label)] * 500, "url string, label int"))
    frame = frame.withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))})
    model = urls.learn(frame, rows=200, trees=2)
    assert model.trees is not None and model.endings.count() == 1500
    plain = rows_of(model.score(frame), "url", "block_score")
    assert len(plain) == 3500
    monkeypatch.setattr(urls, "BROADCAST_ENDINGS", 10)
    assert rows_of(model.score(frame), "url", "block_score") == plain


def test_entropy(spark):
    row = spark.sql("select 'abab' a, '' b, 'aaaa' c").select(*(urls.entropy(F.col(c)).alias(c) for c in "abc")).first()
    assert tuple(row) == (1.0, 0.0, 0.0)


def test_query(spark, sf):
    pages = rows_of(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "url")
    ours = rows_of(QUERIES["op8_urls"](spark, sf), "page_id", "host", "path", "rule", "verdict")
    assert len(ours) == len(pages)
    for (i, url), (page, host, path, own, verdict) in zip(pages, ours):
        assert (page, host, path, own) == (i, *split(url), rule(*split(url))[0])
        assert verdict == (rule(*split(url))[1] or verdict)
