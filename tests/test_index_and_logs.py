"""Posting lists, split CSV, trade log and live members against plain versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from crowdtape.operators import asof as A
from crowdtape.operators import evidence as E
from crowdtape.operators import postings as P
from crowdtape.operators import sentiment as S
from crowdtape.queries import fixtures as X
from crowdtape.sources import delta_log as DL
from crowdtape.sources import split_csv
from crowdtape.sources import store as ST
from crowdtape.streaming import ingest as G
from crowdtape.streaming import trades as TR

_random = random.Random(23)
_VOCABULARY = ["wheat", "wheat-based", "Glencore", "PLC", "plc,", "copper", "lead", "leads", "of", "offer", "a", "Zürich", "日本", "日本語", "b2b", "$HOOD", "x.y", "--", "été"]
DAY = datetime(2024, 1, 1)


def _posts(n):
    rows = []
    for i in range(n):
        ws = [_random.choice(_VOCABULARY) for _ in range(_random.randint(0, 12))]
        sep = _random.choice([" ", "  ", "\n"])
        rows.append((str(i), sep.join(ws) or None, DAY + timedelta(hours=_random.randint(0, 3000)) if i % 17 else None, f"u{i % 60}" if i % 3 else f"v{i}", i // 2))
    return rows


CLAIMS = [
    ("s1", "c1", "Wheat of Zürich and 日本 leads", "Glencore PLC", DAY + timedelta(days=60)), ("s1", "c2", "copper offer of HOOD", None, DAY + timedelta(days=90)),
    ("s2", "c3", "of a b2b offer", None, DAY + timedelta(days=120)), ("s3", "c4", "nothing here x.y", "日本", DAY + timedelta(days=30)), ("s4", "c5", "", "  ", DAY + timedelta(days=30)),
]


def _claims(spark):
    return spark.createDataFrame(CLAIMS, "set_id string, claim_id string, text string, entity string, as_of timestamp")


def test_index_finds_what_the_texts_hold(spark):
    posts = spark.createDataFrame(_posts(400), "post_id string, body string, at timestamp, url string, ordinal long")
    index = P.scratch_index(posts, segment=2000)
    assert index.count() > 5
    for days in (120, 20, None):
        want = {tuple(r) for r in E.evidence_scores(_claims(spark), posts.na.fill("", ["body"]), days).select("set_id", "claim_id", "post_id", "score").collect()}
        got = P.evidence_scores(index, _claims(spark), posts, days).select("set_id", "claim_id", "post_id", "score").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want


def test_best_evidence_needs_few_rows(spark):
    """One row per address, ties by ordinal; a second set of claims only opens the index."""
    posts = spark.createDataFrame(_posts(400), "post_id string, body string, at timestamp, url string, ordinal long")
    claims = _claims(spark).withColumn("entity", F.lit(None).cast("string"))
    scores = E.evidence_scores(claims, posts.na.fill("", ["body"]))
    for segment in (2000, 1 << 20):
        index = P.scratch_index(posts, segment)
        best = P.evidence_scores(index, claims, k=3)
        assert best.count() <= 3 * 5 * index.count()
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert "body" not in plan and "Join" not in plan.replace("BroadcastExchange", "").split("MapInArrow")[0]
        want = E.top_evidence(scores, posts, 3, claims.select("claim_id", F.col("set_id").alias("post_id")))
        got = P.evidence_map(index, claims, posts, 3)
        pick = lambda df: sorted((r.claim_id, r["rank"], r.post_id, r.score) for r in df.collect())
        assert pick(got) == pick(want)


def test_posts_are_added_to_an_index(spark, tmp_path):
    rows = _posts(120)
    schema = "post_id string, body string, at timestamp, url string, ordinal long"
    one, two = spark.createDataFrame(rows[:70], schema), spark.createDataFrame(rows[70:], schema)
    P.build(one, str(tmp_path / "i"), 500)
    index = P.build(two, str(tmp_path / "i"), 500)
    claims = _claims(spark).withColumn("entity", F.lit(None).cast("string"))
    pick = lambda df: sorted(tuple(r) for r in df.select("claim_id", "post_id", "score").collect())
    assert pick(P.evidence_scores(index, claims)) == pick(E.evidence_scores(claims, one.unionByName(two).na.fill("", ["body"])))
    empty = P.build(one.limit(0), str(tmp_path / "none"))
    assert P.evidence_scores(empty, claims).count() == 0 and P.evidence_scores(index, claims.limit(0)).count() == 0


def test_a_file_is_read_by_ranges(spark, tmp_path):
    texts = ["plain", 'a "quoted" word', "two\nlines", '"\n"', "", None, "end,\r\nwith, commas", "é\n\n日本", '""', "x" * 3000 + '\n"y"']
    rows = [(str(i), texts[i % len(texts)], f"t{i}", str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "post_id string, text string, title string, source string").withColumns(
        {c: F.lit("x") for c in ("platform", "url", "scraped_at")})
    path = str(tmp_path / "log")
    df.coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, "4k")
    try:
        assert split_csv.lines(spark, path).rdd.getNumPartitions() > 8
        got = {r.post_id: (r.text, r.title, r.source) for r in ST.read_raw_posts(spark, path).collect()}
    finally:
        spark.conf.set(key, was)
    assert got == {i: (t or "", title, s) for i, t, title, s in rows}


def test_rows_that_do_not_fit_are_kept(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,2\n3\n4,5,6\n"7\n8",9\n')
    got = {(r.a, r.b, r._rescued) for r in split_csv.read_csv(spark, str(tmp_path), rescued=True).collect()}
    assert ("1", "2", None) in got and ("7\n8", "9", None) in got and ("3", None, "3") in got and ("4", "5", "4,5,6") in got and len(got) == 4


def test_trades_are_placed_and_closed_once(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    first = [("a", "CLOSE", 30, 3), ("a", "PLACED", 10, 1), ("b", "PLACED", 5, 4), ("a", "PLACED", 12, 2), ("c", "CLOSE", 5, 5), ("d", "PLACED", 50, 6)]
    second = [("a", "CLOSE", 30, 3), ("a", "CLOSE", 20, 7), ("c", "PLACED", 20, 8), ("b", "CLOSE", 4, 9), ("b", "CLOSE", 5, 10), (None, "CLOSE", 9, 1), ("z", "PLACED", 500, 11)]
    rows, ck, out = (str(tmp_path / n) for n in ("rows", "ck", "out"))
    kind = "trade_id string, event_type string, at timestamp, event_id long, payload string"
    for part in (first, second):
        spark.createDataFrame([(t, k, at(m), i, "p") for t, k, m, i in part], kind).write.mode("append").parquet(rows)
        TR.run(G.file_stream(spark, rows, spark.read.parquet(rows).schema), ck, out)
    got = sorted((r.trade_id, r.event_type, r.event_id) for r in spark.read.parquet(out).collect())
    assert got == [("a", "CLOSE", 7), ("a", "PLACED", 1), ("b", "CLOSE", 10), ("b", "PLACED", 4), ("c", "PLACED", 8), ("d", "PLACED", 6)]


def test_moments_meet_live_members_only(spark):
    """A sector of many members, few of them live: probes follow the live ones, the scores stay."""
    d = X.deltas(spark, "/root/testdata/sf0.001")
    named = d.select("ticker").distinct()
    silent = spark.range(500).select(F.concat(F.lit("Q"), F.col("id").cast("string")).alias("ticker"))
    dim = named.unionByName(silent).select(F.col("ticker").alias("symbol"), F.lit("all").alias("sector"))
    requests = d.select("ticker", (F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).alias("as_of")).distinct()
    member = dim.select(F.upper("symbol").alias("ticker"), F.lower("sector").alias("sector"))
    moments = requests.select(F.lit("all").alias("sector"), "as_of").distinct()
    live = S.live_members(moments, member, d, 7)
    assert live.count() <= moments.count() * named.count()
    pick = lambda df: sorted((r.ticker, r.as_of, round(r.des_sector, 9), round(r.des_adj, 9)) for r in df.collect())
    assert pick(S.with_peers(requests, d, dim)) == pick(S.with_peers(requests, d, dim.filter("symbol NOT LIKE 'Q%'")))


def test_one_ticker_opens_few_files(spark, tmp_path):
    """A third of all deltas is of one ticker; after compaction any ticker's days lie in a few files."""
    path = str(tmp_path / "log")
    d = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), (F.col("id") % 50).cast("string"))).alias("ticker"),
        (F.lit(DAY).cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 700).cast("int"))).alias("ts"), "id")
    for k in range(6):
        DL.append(d.filter(F.col("id") % 6 == k).repartition(8), path)
    before, rows = DL.manifest(spark, path).count(), sorted(r.id for r in DL.read(spark, path).collect())
    assert rows == list(range(30_000))
    old = DL.versions(spark, path)[-1]
    assert DL.compact(spark, path, target_bytes=16 << 10) == old + 1
    files = DL.manifest(spark, path).count()
    assert 8 < files < before and sorted(r.id for r in DL.read(spark, path).collect()) == rows
    one = DL.chosen(spark, path, ["T7"], F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-09").cast("timestamp"))
    assert one.count() <= 2
    assert DL.chosen(spark, path, ["HOT"], F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-09").cast("timestamp")).count() <= files // 4
    got = DL.read(spark, path, ["HOT"], F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-09").cast("timestamp"))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in d.filter("ticker = 'HOT' AND ts >= '2024-01-05' AND ts <= '2024-01-09'").collect())
    assert DL.read(spark, path, ["nobody"]).count() == 0
    assert DL.vacuum(spark, path, keep=1) > 0 and sorted(r.id for r in DL.read(spark, path).collect()) == rows


def test_buckets_hold_as_many_rows_for_a_hot_key(spark):
    """A third of all rows is of one key and crowded into a few hours: no bucket holds twice the median."""
    hot = spark.range(20_000).select(F.lit("HOT").alias("key"), (F.lit(DAY).cast("timestamp") + F.make_dt_interval(secs=(F.col("id") * F.col("id") % 90_000).cast("int"))).alias("t"), "id")
    rest = spark.range(40_000).select(F.concat(F.lit("K"), (F.col("id") % 40).cast("string")).alias("key"), (F.lit(DAY).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("t"), "id")
    rows = hot.unionByName(rest).dropDuplicates(["key", "t"])
    probes = rows.select("key", (F.col("t") + F.make_dt_interval(secs=F.lit(17))).alias("ts")).sample(0.3, 5)
    cells = A.depth_buckets([rows.withColumnRenamed("t", "_t"), probes.withColumnRenamed("ts", "_t")], ["key"], 500)
    held = rows.withColumn("_g", F.date_trunc("minute", "t")).join(cells, ["key", "_g"]).groupBy("key", "_b").count()
    sizes = sorted(r["count"] for r in held.filter("key = 'HOT'").collect())
    assert len(sizes) > 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    for direction in ("backward", "forward"):
        by = [sorted(map(str, A.asof_join(probes, rows, ["key"], right_ts="t", direction=direction, bucket=b).collect())) for b in ("month", 500)]
        assert by[0] == by[1] and len(by[0]) > 1000
