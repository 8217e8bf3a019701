import math
import random

from pyspark.sql import functions as F

from panelweave.llm import q_url_filter, url_filter

RULES = q_url_filter.RULES


def brute(url):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.partition(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


URLS = ["http://www.example.com/en/1", "HTTPS://Example.COM/en/", "https://a.example.com/en/x?y", "https://example.com/en", "http://b.net/es/q#z", "http://net/fr/",
        "http://badnet/fr/1", "no scheme", "", None, "://", "x://h", "http://h?x=/en/", "http://a.com", "http://a.com?b", "http://ÀÉ.com/", "http://x.org/a://b.net/es/",
        "https://deep.www.example.com/en/x", "https://www.example.com/fr/x\nnext"]


def spam(i):
    return f"http://cheap{i % 90}-pills-{i}.example{i % 7}.biz/buy-{i * 37}?id={i * i}&ref=2&aff={i}", 1


def ham(i):
    return f"https://news{i % 40}.site{i % 5}.org/articles/title-of-story/{i % 30}", 0


def labelled(spark, n=1500):
    random.seed(6)
    return spark.createDataFrame([random.choice((spam, ham))(i) for i in range(n)], "url string, bad int")


def test_rules_match_definition(spark):
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("mine"))
    model = url_filter.fit(labelled(spark, 10).filter("false"))
    out = {r["page_id"]: r for r in url_filter.judge(urls, RULES, model).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == (host, path, rule, verdict or "allow")


def test_held_out_accuracy(spark):
    data = labelled(spark).withColumn("held", F.xxhash64("url") % 4 == 0)
    model = url_filter.fit(data.filter("NOT held"))
    scored = url_filter.judge(data.filter("held"), [], model)
    assert scored.agg(F.avg(((F.col("verdict") == "block") == (F.col("bad") == 1)).cast("int"))).first()[0] > 0.97


def test_noise_is_not_learnt(spark):
    random.seed(8)
    rows = [(f"https://h{i % 60}.example.org/en/{i}", int(random.random() < 0.15)) for i in range(2000)]
    model = url_filter.fit(spark.createDataFrame(rows, "url string, bad int"))
    fresh = spark.createDataFrame([(f"https://h{i % 60}.example.org/en/{i}",) for i in range(5000, 6000)], "url string")
    assert url_filter.judge(fresh, [], model).filter("verdict = 'block'").count() < 50


def test_entropy_and_edges(spark):
    texts = ["", "aaaa", "abab", "abcdefgh"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(url_filter.entropy(F.col("t"))).collect()]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, [0, 0, 1, 3], strict=True))
    model = url_filter.fit(labelled(spark, 300), fit_rows=100)
    empty = spark.createDataFrame([], "page_id long, url string, rule string, verdict string")
    assert url_filter.judge(empty, RULES, model).count() == 0
    one_class = url_filter.fit(labelled(spark, 300).filter("bad = 1"))
    assert url_filter.judge(spark.createDataFrame([("http://x.org/",), ("http://x.org/",)], "url string"), [], one_class).select("verdict").collect() == [("block",)] * 2
    none_bad = url_filter.fit(labelled(spark, 300).filter("bad = 0"))
    assert url_filter.judge(spark.createDataFrame([("http://x.org/",)], "url string"), [], none_bad).select("verdict").collect() == [("allow",)]


def test_a_url_repeated_very_often_leaves_room_for_others(spark):
    data = labelled(spark, 600)
    often = data.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n")
    model = url_filter.fit(data.unionByName(often), fit_rows=400)
    assert model.trees is not None
    fresh = spark.createDataFrame([(*spam(i), ) for i in range(5000, 5100)], "url string, bad int")
    assert url_filter.judge(fresh, [], model).filter("verdict = 'block'").count() > 90


def test_suffixes_are_counted_from_all_labels(spark):
    data = labelled(spark, 1000)
    model = url_filter.fit(data, fit_rows=100)
    want = data.groupBy(url_filter.suffix(url_filter.host_and_path(F.col("url"))[0])).agg(F.count("*"), F.sum("bad"))
    assert sorted(map(tuple, model.suffixes.select("_pw_suffix", "_pw_n", "_pw_b").collect())) == sorted(map(tuple, want.collect()))
    assert model.trees is not None and model.share == data.agg(F.avg("bad")).first()[0]
