"""Nothing is cut, capped or dropped on the way: literal rows for each case."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crowdtape.functions import payloads as PL
from crowdtape.operators import evidence as E
from crowdtape.operators import posts as P
from crowdtape.operators import ranking as R
from crowdtape.operators import trading as X
from crowdtape.plans import backtest as B
from crowdtape.plans.snapshot import technical_snapshot

T0 = dt.datetime(2024, 1, 1)


def test_terms_of_any_script_are_found(spark):
    posts = spark.createDataFrame([("1", "about 日本 and Toyota"), ("2", "日本"), ("3", "cost 5€, c++ & more"), ("4", "naïve Ünal co.")], "post_id string, body string")
    terms = spark.createDataFrame([("日本",), ("toyota",), ("€",), ("c++",), ("ünal co",), ("ïve",), (" ",), ("&",)], "term string")
    got = sorted((r.term, r.post_id) for r in E.contained_terms(posts, terms).collect())
    assert got == sorted([("&", "3"), ("c++", "3"), ("toyota", "1"), ("€", "3"), ("ïve", "4"), ("ünal co", "4"), ("日本", "1"), ("日本", "2")])


def test_claims_may_use_all_their_words(spark):
    claim = spark.createDataFrame([("s", "c", " ".join(f"word{c}" for c in "abcdefghijkl"), None, T0)], "set_id string, claim_id string, text string, entity string, as_of timestamp")
    posts = spark.createDataFrame([("p", "wordl here", T0)], "post_id string, body string, at timestamp")
    assert E.evidence_scores(claim, posts).count() == 0
    assert [r.score for r in E.evidence_scores(claim, posts, first_words=None).collect()] == [1.0]


def test_relevance_accepts_any_minimum(spark):
    req = spark.createDataFrame([("r", T0, ["acme"], [])], "ref_id string, at timestamp, aliases array<string>, keywords array<string>")
    posts = spark.createDataFrame([("a", "acme up", "blog", T0), ("b", "none", "rss", T0), ("c", "none", "x", T0), ("d", "none", "blog", T0), ("e", "none", "rss", T0 - dt.timedelta(days=9))],
                                  "post_id string, body string, platform string, at timestamp")
    ids = lambda m: {r.post_id for r in E.relevance_scan(req, posts, before_days=3, min_score=m).collect()}
    assert ids(2.0) == {"a"} and ids(1.5) == {"a", "b"} and ids(0.5) == {"a", "b", "c"} and ids(0.0) == {"a", "b", "c", "d"}


def test_rule_sets_keep_their_time_stops(spark):
    rules = B.sample_rules(spark, 3, time_stop_bars=30)
    paths = spark.createDataFrame([(i,) for i in range(5)], "x int")
    got = B.with_rules(paths, rules, batch=2)
    assert got.count() == 15 and got.select("x", "run_id").distinct().count() == 15
    days = [T0 + dt.timedelta(days=i) for i in range(60)]
    bars = spark.createDataFrame([("A", "1d", d, 10.0, 10.0, 10.0, 10.0, 1.0) for d in days], "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double")
    calls = spark.createDataFrame([("v", "A", T0 + dt.timedelta(days=2), "1d")], "signal_id string, symbol string, ts timestamp, interval string")
    path = X.signal_paths(calls, X.number_bars(bars), int(rules.agg(F.max("rule.time_stop_bars")).first()[0]))
    assert max(longest_list(r) for r in path.collect()) >= 30


def longest_list(row):
    return max((len(v) for v in row.asDict().values() if isinstance(v, list)), default=0)


def test_sentiment_at_any_depth(spark):
    leaf = '{"des_raw": 0.5, "confidence": 0.7}'
    for _ in range(9):
        leaf = '{"a": [%s], "b": "x { \\" ["}' % leaf
    df = spark.createDataFrame([("p", leaf)], "post_id string, j string").select("post_id", F.parse_json("j").alias("v"))
    rows = PL.sentiment_nodes(df, "post_id", "v").collect()
    assert [(r.des_raw, r.conf, r.level) for r in rows] == [(0.5, 0.7, 18)]
    assert PL.sentiment_nodes(df, "post_id", "v", depth=5).count() == 0


def test_long_look_backs_are_not_cut(spark):
    bars = spark.range(1500).select(
        F.lit("A").alias("symbol"), F.lit("1d").alias("interval"), (F.lit(T0) + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"),
        *[(F.lit(100.0) + F.when(F.col("id") < 300, F.col("id") * -0.5).otherwise(F.col("id") * 0.1)).alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    short = technical_snapshot(bars, trend_days=1400).collect()
    long = technical_snapshot(bars, trend_days=1400, depth=5000).collect()
    assert short == long


def test_limits_are_obeyed(spark):
    posts = spark.range(700).select(F.col("id").cast("string").alias("post_id"), (F.lit(T0) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("scraped_at"))
    assert P.next_after(posts, limit=600).count() == 600
    ids = posts.select("post_id", F.col("post_id").cast("long").alias("ordinal"))
    assert P.batch_targets(ids, None).count() == 700 and P.batch_targets(ids).count() == 200


def test_ranks_with_one_value_in_most_rows(spark):
    rows = [("g", i, -1.0 if i % 3 else float(i)) for i in range(300)] + [("g", 999, None), ("h", 1, 5.0)]
    df = spark.createDataFrame(rows, "grp string, id long, v double")
    got = {(r.grp, r.id): r.rank_x for r in R.min_ranks(df, ["grp"], {"x": F.col("v")}, ["id"]).collect()}
    for g, i, v in rows:
        if v is not None:
            assert got[g, i] == 1 + sum(1 for h, _, u in rows if h == g and ((u is None and v < 0) or (u is not None and u > v)))


def test_novelty_counts_shared_shingles(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("t", "1", T0, text), ("t", "2", T0 + dt.timedelta(days=1), text), ("t", "3", T0 + dt.timedelta(days=2), " ".join(f"w{i}" for i in range(15))),
            ("t", "4", T0 + dt.timedelta(days=3), "short"), ("t", "5", T0 + dt.timedelta(days=60), text), ("u", "6", T0, text)]
    got = {r.post_id: (r.novelty, r.samples) for r in E.novelty(spark.createDataFrame(rows, "ticker string, post_id string, at timestamp, text string")).collect()}
    assert got["1"] == (0.7, 0) and got["2"] == (0.0, 1) and got["3"] == (pytest.approx(1 - 11 / 26), 2) and got["4"] == (0.7, 3) and got["5"] == (0.7, 0) and got["6"] == (0.7, 0)


def test_chained_duplicates_take_few_rounds(spark, monkeypatch):
    """Each row shares one key with the row before it: every second row is accepted."""
    n, cuts = 10_000, []
    cut = P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    rows = spark.range(n).select(
        F.col("id").alias("n"), F.concat(F.lit("k"), F.floor(F.col("id") / 2).cast("string")).alias("k"),
        F.concat(F.lit("u"), F.floor((F.col("id") + 1) / 2).cast("string")).alias("u"))
    log = spark.createDataFrame([("none", "none")], "k string, u string")
    got = sorted(r.n for r in P.dedup_against_log(rows, log, [["k"], ["u"]], ["n"]).collect())
    assert got == list(range(0, n, 2)) and len(cuts) <= 20


@pytest.mark.parametrize("seed", range(3))
def test_dedup_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"k{rng.randint(0, 25)}" if rng.random() < 0.9 else None, f"u{rng.randint(0, 40)}" if rng.random() < 0.9 else "", f"v{rng.randint(0, 60)}") for i in range(150)]
    seen = [{"k3"}, {"u5"}, set()]
    want = []
    for i, *vals in rows:
        if not any(v and v in s for v, s in zip(vals, seen)):
            want.append(i)
            for v, s in zip(vals, seen):
                if v:
                    s.add(v)
    df = spark.createDataFrame(rows, "n long, k string, u string, v string")
    log = spark.createDataFrame([("k3", "u5", None)], "k string, u string, v string")
    assert sorted(r.n for r in P.dedup_against_log(df, log, [["k"], ["u"], ["v"]], ["n"]).collect()) == want


def test_site_selectors_and_furniture():
    from crowdtape.sources.articles import candidate_texts

    text = "A paragraph of the story that is long enough to be kept by everyone. "
    page = (f"<main><div class='ad-slot'><p>{text}ad</p></div><article><div data-test-id='comments'><p>{text}comment</p></div>"
            f"<div data-test-id='post-content'><p>{text}one</p><p>See also this</p><ul><li>two</li></ul></div><p>{text}outside</p></article></main>")
    got = candidate_texts(page, "https://seekingalpha.com/news/1")
    assert got["site_text"] == f"{text}one\n\ntwo"
    assert got["candidates"][0] == f"{text}one\n\ntwo\n\n{text}outside"
    assert candidate_texts(page, "https://e.example/1")["site_text"] == ""
    fed = "<main><div class='x col-md-8 col-xs-12'><p>fed text</p></div></main>"
    assert candidate_texts(fed, "https://www.federalreserve.gov/a")["site_text"] == "fed text"
    assert candidate_texts("<div id='ctl_MainContent'><div class='content'>loose</div></div>", "http://www.nasdaqtrader.com/x")["site_text"] == "loose"
