"""URL filter: rules and parsing against a direct reading, trees on held-out URLs."""

import math
import random
import re

from kinfold.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def direct(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (low == h or low.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return low, path, best[1], best[2]


def test_parsing_and_rules(spark):
    rng = random.Random(1)
    hosts = ["a.NET", "example.net", "x.example.net", "notexample.net", "example.com", "b.example.com", "w.org", "org", "ÀÉ.de", "", "h:80"]
    paths = ["", "/", "/en/", "/en", "/de/1?x=/y", "/fr/?a", "/fr/#t", "?q=1/2", "#f", "/de/\n2"]
    made = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', '://', ':'])}{h}{p}" for h in hosts for p in paths]
    made += [None, "", "://", "http://a.net/http://b.org/fr/", "http://net/" + "9" * 50_000]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(made)], "page_id long, url string, host string, verdict string")
    got = urls.judge(pages, keep=("page_id", "url", "host")).collect()
    assert len(got) == len(made)
    for r in got:
        host, path, rule, verdict = direct(r["row"]["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"])
        assert r["verdict"] in ("allow", "block")


def test_trees_learn_from_the_rules_examples(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        spam = i % 2
        word = "".join(rng.choice("abcdefgh0123456789" if spam else "abcdefgh") for _ in range(12))
        rows.append((i, f"http://{word}.{'net' if i % 3 == 0 and spam else 'org' if i % 3 == 0 else 'com'}/{'fr' if not spam else 'z'}/{word}"))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule IS NULL").collect()
    right = sum((r["verdict"] == "block") == bool(r["row"]["page_id"] % 2) for r in got)
    assert right >= 0.9 * len(got) > 0


def test_one_verdict_only_and_empty(spark):
    schema = "page_id long, url string"
    only = urls.judge(spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], schema)).collect()
    assert [r["verdict"] for r in only] == ["block", "block"]
    assert [r["verdict"] for r in urls.judge(spark.createDataFrame([(2, "http://b.com/")], schema)).collect()] == ["allow"]
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0


def test_suffix_statistics_count_all_decided_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    sites = [f"{word()}.com" for _ in range(40)]
    rules = [(h, "/x/", ("block", "allow")[k % 2]) for k, h in enumerate(sites)]
    made = [(k, f"http://{h}/x/{word()}") for k, h in enumerate(sites) for _ in range(50)] + [(k, f"http://{h}/y/{word()}") for k, h in enumerate(sites) for _ in range(5)]
    got = urls.judge(spark.createDataFrame(made, "page_id long, url string"), rules, max_examples=20).collect()
    assert len(got) == len(made)
    open_rows = [r for r in got if r["rule"] is None]
    assert len(open_rows) == 200
    assert all(r["verdict"] == ("block", "allow")[r["row"]["page_id"] % 2] for r in open_rows)


def test_suffix_table_against_direct_counts(spark):
    rng = random.Random(9)
    rows = [(f"{rng.choice(['a.', 'b.', ''])}{rng.choice(['x', 'y', 'z'])}.{rng.choice(['net', 'de'])}", rng.choice(["block", "allow", None])) for _ in range(3000)] + [("", None)]
    got = {r["suffix2"]: r for r in urls.suffix_table(spark.createDataFrame(rows, "host string, decided string").withColumn("url", urls.F.col("host"))).collect()}
    assert set(got) == {".".join(h.split(".")[-2:]) for h, _ in rows}
    for suffix, r in got.items():
        under = [d for h, d in rows if ".".join(h.split(".")[-2:]) == suffix]
        above = [d for h, d in rows if h.split(".")[-1] == suffix.split(".")[-1]]
        assert r["rows"] == len(under)
        for k, seen in ((1, above), (2, under)):
            n = len([d for d in seen if d])
            assert abs(r[f"suffix{k}_blocked"] - (seen.count("block") + 5) / (n + 10)) < 1e-12
            assert abs(r[f"suffix{k}_seen"] - math.log1p(n)) < 1e-12


def test_copies_of_one_url_do_not_fill_the_sample(spark):
    made = [f"http://{k}.{'net/' if k % 2 else 'org/fr/'}" for k in range(60)]
    least = spark.createDataFrame([(u,) for u in made], "url string").selectExpr("min_by(url, xxhash64(url))").first()[0]
    rows = [(0, u) for u in made + [least] * 400 + ["http://open.com/"]]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), max_examples=50).collect()
    assert len(got) == len(rows)
    assert [r["blocked"] is not None for r in got if r["rule"] is None] == [True]


def test_plan_has_no_python(spark, sf_dir):
    from kinfold.llm import queries

    plan = queries.QUERIES["op7_urls"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_example_counts_for_its_own_statistics(spark):
    rng = random.Random(6)
    made = [(f"http://{rng.choice('ab')}.{rng.choice(['one.net', 'two.net', 'three.de'])}/{i % 80}", "block" if i % 3 else "allow") for i in range(300)]
    host, path = urls.host_and_path(urls.F.col("url"))
    parsed = spark.createDataFrame(made, "url string, decided string").select("url", host.alias("host"), path.alias("path"), "decided", urls._fold().alias("f"))
    fold = {r["url"]: r["f"] for r in parsed.collect()}
    examples = parsed.select("url", "host", "path", urls.F.lit(1.0).alias("label")).distinct()
    got = urls._complete(urls.with_features(examples), urls.suffix_table(parsed)).collect()
    for r in got:
        for k in (1, 2):
            suffix = ".".join(r["host"].split(".")[-k:])
            seen = [d for u, d in made if fold[u] != fold[r["url"]] and u.split("/")[2].endswith("." + suffix)]
            assert abs(r[f"suffix{k}_blocked"] - (seen.count("block") + 5) / (len(seen) + 10)) < 1e-12
            assert abs(r[f"suffix{k}_seen"] - math.log1p(len(seen))) < 1e-12


def test_lexical_features_carry_over_to_unseen_suffixes(spark):
    """Every site has a suffix of its own, so that only lexical features can tell what is blocked on sites never seen."""
    rng = random.Random(12)
    rules, made = [], []
    for k in range(60):
        site = "".join(rng.choice("abcdefgh") for _ in range(6)) + f".t{k}"
        spam = k % 2
        rules.append((site, "/", "block" if spam else "allow"))
        for _ in range(30):
            word = "".join(rng.choice("ab0123456789" if spam else "abcdefgh") for _ in range(10))
            made.append((k, f"http://{site}/{word}?{'a=1&b=2' if spam else ''}"))
    area, importance = urls.held_out_auc(spark.createDataFrame(made, "page_id long, url string"), rules)
    assert area > 0.95 and sum(v for f, v in importance.items() if not f.startswith("suffix")) > 0.5
