"""Further cases of the third round's findings, each wrong before its mend."""

import datetime as dt
import re

from pyspark.sql import functions as F

UTC = dt.timezone.utc


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interest_searches_a_text_once(spark, tmp_path, monkeypatch):
    """no join of the scores carries texts, and the last step searches none; a mover counts as before."""
    from crowdtape.plans import reports as R

    day = dt.datetime(2024, 1, 1, tzinfo=UTC)
    posts = [(str(i), "src", "reddit", "t", "Shares HALT after hours" if i % 2 else "nothing", day + dt.timedelta(days=40, hours=i)) for i in range(8)]
    posts = spark.createDataFrame(posts, "post_id string, source string, platform string, title string, text string, posted_at timestamp").withColumn("scraped_at", F.col("posted_at"))
    said = '{"claimed_catalysts": ["yes"], "numbers_mentioned": [], "author_stance": "neutral", "spam_likelihood_pct": 0}'
    stages = posts.select("post_id", F.lit("summariser").alias("stage"), F.col("scraped_at").alias("created_at"), F.lit(said).alias("payload"))
    tickers = posts.select("post_id", F.lit("AA").alias("ticker"), F.lit(0.9).alias("confidence"))
    bars = [("AA", "1d", day + dt.timedelta(days=i), 10.0, 11.0, 9.0, 10.0 + i % 3 / 10, 5.0) for i in range(40)]
    bars = spark.createDataFrame(bars, "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double")
    out = R.interest_scores(posts, stages, tickers, bars)
    plan = _plan(out)
    assert not re.search(r"\btext#|\btitle#|\bsurge\b", plan)
    got = {r["post_id"]: r for r in out.collect()}
    assert len(got) == 8 and all(r["status"] == "ok" for r in got.values())
    assert all(("mover heuristics" in got[str(i)]["interest_why"]) == bool(i % 2) for i in range(8))


def test_words_of_a_list_are_found_wherever_they_stand(spark):
    """the plain searches find what the pattern found, blanks and signs included."""
    from crowdtape.functions import text as T

    said = ["Up 5% AH today", "ah: 3", "blah", "SURGEd", "", None, "after-hrs", "(halt)"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    pattern = F.lower(F.coalesce("s", F.lit(""))).rlike("|".join(re.escape(p) for p in T.MOVER_TOKENS))
    rows = df.select(T.any_of(F.col("s"), T.MOVER_TOKENS).alias("a"), pattern.alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] == [True, True, False, True, False, False, False, True]


def test_novelty_sorts_thin_rows(spark):
    """what is sorted by shingle holds no id, time or size of a post."""
    from crowdtape.operators import evidence as E

    p = spark.createDataFrame([("T", "1", dt.datetime(2024, 1, 1, tzinfo=UTC), "a b c d e f")], "ticker string, post_id string, at timestamp, text string")
    assert re.findall(r"collect_list\((\w+)", _plan(E.novelty(p)))[0] == "position"


def test_context_filter_cuts_texts_once(spark, monkeypatch):
    """F32: texts are cut up once, and neither their words nor texts are shuffled when few names are looked up."""
    from crowdtape.operators import evidence as E

    cut, post_runs = [], E.post_runs
    monkeypatch.setattr(E, "post_runs", lambda *a: cut.append(1) or post_runs(*a))
    p = spark.createDataFrame([("1", "Acme, Robot-Works rose"), ("2", "the acmerobotworks"), ("3", "zacme robot worksy"), ("4", None), ("5", "nothing")], "post_id string, body string")
    tags = spark.createDataFrame([("5", "B")], "post_id string, symbol string")
    dim = spark.createDataFrame([("A", "Acme Robot Works", "s", None, None), ("B", "Bee", "t", None, None)], "symbol string, long_name string, sector string, industry string, asset_type string")
    out = E.context_filter(p, tags, dim, spark.createDataFrame([("A",), ("B",)], "symbol string"))
    assert len(cut) == 1 and not re.search(r"\bbody#|\brun#", _plan(out))
    assert sorted(tuple(r) for r in out.collect()) == [("A", "1"), ("A", "3"), ("B", "5")]
    found = E.contained_terms(p, spark.createDataFrame([("a",), ("ro",), ("robot-w",), ("acme, robot",), (" ",)], "term string"))
    assert sorted(tuple(r) for r in found.collect()) == [("1", "a"), ("1", "acme, robot"), ("1", "ro"), ("1", "robot-w"), ("2", "a"), ("2", "ro"), ("3", "a"), ("3", "ro")]


def test_depth_buckets_bound_the_rows_of_a_task(spark, monkeypatch):
    """twice the rows go to twice the tasks, the answers are those of buckets of time."""
    from crowdtape.operators import asof as A

    monkeypatch.setattr(A, "TASK_ROWS", 200, raising=False)

    def tables(n):
        t = lambda c: (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=c.cast("int"))).alias("ts")
        key = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("K"), (F.col("id") % 7).cast("string"))).alias("key")
        bars = spark.range(n).select(key, t(F.col("id") * 5), F.col("id").alias("v")).withColumnRenamed("ts", "bar_ts")
        return spark.range(n).select(key, t(F.col("id") * 4 + 1), F.col("id").alias("ask")), bars

    tasks = []
    for n in (1000, 2000):
        left, right = tables(n)
        out = A.asof_join(left, right, ["key"], right_ts="bar_ts", bucket=50)
        tasks.append(max(int(x) for x in re.findall(r"hashpartitioning\(key#\d+, ts#\d+, (\d+)\)", _plan(out))))
        want = A.asof_join(left, right, ["key"], right_ts="bar_ts")
        assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    assert tasks == [10, 20]
