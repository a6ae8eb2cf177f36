"""Write, then read: the post log, listings, bars, histories and results through their own files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tickers as TK
from ..sources import bars as B
from ..sources import delta_log as DL
from ..sources import store as ST
from ..streaming.ingest import scratch
from . import fixtures as X
from .market import r8, sql
from .registry import query


@query("s01_raw_log_file", "S1 H-D1", sql("SELECT post_id, source, md5(text) AS text_md5, md5(title) AS title_md5, scraped_at AS ts FROM posts"))
def s01_file(spark, sf):
    path = scratch(spark, "raw-log")
    rows = ST.canonical_row(X.posts(spark, sf))
    # a file per task; those larger than a range have their records found across ranges
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    df = ST.read_raw_posts(spark, path, ST.RAW_COLUMNS)
    return df.select("post_id", "source", F.md5("text").alias("text_md5"), F.md5("title").alias("title_md5"), "ts")


@query("s03_canonical_rows", "S3", sql("""
    SELECT post_id, platform, source, url, md5(title) AS title, md5(text) AS text, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at, '' AS final_url, '' AS fetch_status, '' AS domain FROM posts"""))
def s03(spark, sf):
    return ST.canonical_row(X.posts(spark, sf)).withColumns({"title": F.md5("title"), "text": F.md5("text")})


@query("s05_archive_file", "S5", sql("SELECT source, count(*) AS posts, max(scraped_at) AS newest, CAST(sum(length(text)) AS BIGINT) AS chars FROM posts GROUP BY source"))
def s05(spark, sf):
    path = scratch(spark, "archive")
    ST.write_archive(X.posts(spark, sf).select("source", "text", "scraped_at"), path, max_records=5000)
    df = spark.read.schema("source string, text string, scraped_at timestamp").json(path)
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("posts"), F.max("scraped_at").alias("newest"), F.sum(F.length("text")).alias("chars"))


@query("s06_evidence_posts", "S6", sql("SELECT post_id, platform, source, url, md5(title) AS title, length(text) AS chars, scraped_at FROM posts"))
def s06(spark, sf):
    return ST.evidence_posts(X.posts(spark, sf)).select("post_id", "platform", "source", "url", F.md5("title").alias("title"), F.length("text").cast("long").alias("chars"), "scraped_at")


@query("s07_ticker_file", "S7", sql("""
    SELECT 'P' || p_partkey AS symbol, p_name AS long_name, CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN' ELSE p_brand END AS sector, p_type AS industry,
      CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'EQUITY' END AS asset_type, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS market_cap,
      'N' || p_partkey || '|' || upper(p_name) AS aliases, 'ai|' || p_brand AS themes FROM part"""))
def s07(spark, sf):
    path = scratch(spark, "tickers")
    k = F.col("p_partkey")
    X.table(spark, sf, "part").select(
        F.concat(F.lit(" p"), k.cast("string")).alias("Symbol"), F.col("p_name").alias("longName"), F.when(k % 5 == 0, " ").otherwise(F.col("p_brand")).alias("sector"),
        F.col("p_type").alias("industry"), F.when(k % 7 == 0, "").otherwise("EQUITY").alias("asset_type"),
        F.when(k % 3 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("marketCap"),
        F.concat(F.lit("n"), k.cast("string"), F.lit(", "), F.col("p_name"), F.lit(",, N"), k.cast("string")).alias("aliases"), F.concat(F.lit("ai, ,"), F.col("p_brand")).alias("themes"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return TK.read_tickers(spark, path).withColumns({"aliases": F.array_join("aliases", "|"), "themes": F.array_join("themes", "|")})


LISTED = "CASE WHEN k % 10 = 0 THEN 'ZXYZT' WHEN k % 4 = 1 THEN 'P' || k || '-W' ELSE 'P' || k END"


@query("s08_listing_file", "S8 P8", f"""
    SELECT {LISTED} AS symbol, p_name AS name, 'NASDAQ' AS listing, 'Q' AS category, k % 6 = 0 AS etf, 'listed' AS source, 2 AS priority
    FROM (SELECT p_partkey AS k, p_name FROM part) WHERE k % 9 <> 0 AND k % 10 <> 0 AND k % 4 <> 1""")
def s08(spark, sf):
    path = scratch(spark, "listing")
    k = F.col("p_partkey")
    symbol = F.when(k % 10 == 0, "ZXYZT").when(k % 4 == 1, F.concat(F.lit("P"), k.cast("string"), F.lit("-W"))).otherwise(F.concat(F.lit("p"), k.cast("string")))
    columns = ["Symbol", "Security Name", "Market Category", "Test Issue", "ETF"]
    line = F.concat_ws("|", symbol, "p_name", F.lit("Q"), F.when(k % 9 == 0, "Y").otherwise("N"), F.when(k % 6 == 0, "Y").otherwise("N"))
    # every file has a header and a footer of its own
    ends = spark.createDataFrame([("|".join(columns),), ("File Creation Time: 0101202400:00|||",)], "value string")
    X.table(spark, sf, "part").select(line.alias("value")).unionByName(ends).write.text(path)
    return TK.listing_rows(TK.read_listing(spark, path, columns), "Symbol", F.lit("NASDAQ"), "listed", 2, derived=False)


@query("s09_seed_file", "S9", sql("SELECT 'P' || p_partkey AS symbol FROM part WHERE p_partkey % 3 <> 0"))
def s09(spark, sf):
    path = scratch(spark, "seeds")
    k = F.col("p_partkey")
    name = F.concat(F.lit("$p"), k.cast("string"), F.lit(", "), F.col("p_brand"))
    head = spark.createDataFrame([("Symbol",), ("",), ("# a list",)], "value string")
    X.table(spark, sf, "part").select(F.when(k % 3 == 0, F.concat(F.lit("#"), name)).otherwise(name).alias("value")).unionByName(head).write.text(path)
    return TK.read_seed_list(spark, path)


@query("s10_bars_file", "S10", sql("""
    SELECT symbol, interval, ts, round(open,8) AS open, round(high,8) AS high, round(low,8) AS low, round(close,8) AS close, volume FROM bars
    WHERE ts >= TIMESTAMP '1995-02-10' AND ts <= TIMESTAMP '1996-03-05'"""))
def s10(spark, sf):
    path = scratch(spark, "bars")
    B.write_bars(X.daily_bars(spark, sf), path)
    # the same bars come again, as a later download would bring them; compacting keeps one of each
    B.write_bars(X.daily_bars(spark, sf).filter("symbol = 'S1'"), path)
    B.compact_bars(spark, path, compact := scratch(spark, "bars"))
    df = B.read_bars(spark, compact, "1d", start="1995-02-10", end="1996-03-05", compacted=True)
    return r8(df, "open", "high", "low", "close")


@query("p23_crop_last", "P23", sql("""
    SELECT symbol, ts, round(close, 8) AS close FROM bars WHERE ts <= TIMESTAMP '1996-03-05' AND ts >= TIMESTAMP '1996-03-05' - INTERVAL 20160 MINUTE"""))
def p23(spark, sf):
    return r8(B.crop_last(X.daily_bars(spark, sf), 20160, F.to_timestamp(F.lit("1996-03-05"))).select("symbol", "ts", "close"), "close")


@query("s11_missing_series", "S11", sql("""
    SELECT DISTINCT symbol AS ticker, '1h' AS interval FROM signals"""))
def s11_missing(spark, sf):
    calls = X.signals(spark, sf).select(F.col("symbol").alias("ticker"), F.lit("swing_days").alias("timeframe"), F.col("side").alias("implied_direction"))
    return B.missing_series(B.needed_series(calls), X.daily_bars(spark, sf))


@query("s12_delta_log_file", "S12 J18", sql("""
    SELECT ticker, delta_id, ts FROM deltas"""))
def s12(spark, sf):
    path = scratch(spark, "deltas")
    d = X.deltas(spark, sf).select("ticker", "delta_id", "ts")
    # four arrivals, the log compacted after the third
    for k in range(4):
        DL.append(d.filter(F.pmod("delta_id", F.lit(4)) == k), path)
        if k == 2:
            DL.compact(spark, path)
    return DL.read(spark, path)


@query("s12_one_ticker", "S12 J18", sql("""
    SELECT ticker, delta_id, ts FROM deltas WHERE ticker = 'U7' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'"""))
def s12_one(spark, sf):
    """A ticker's look-back from the compacted log: few of its files are opened."""
    path = scratch(spark, "deltas")
    d = X.deltas(spark, sf).select("ticker", "delta_id", "ts")
    for k in range(2):
        DL.append(d.filter(F.pmod("delta_id", F.lit(2)) == k), path)
    DL.compact(spark, path, target_bytes=16 << 10)
    return DL.read(spark, path, ["U7"], F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))


@query("s14_stage_history_file", "S14", sql("""
    SELECT post_id, stage, created_at, quality FROM stages"""))
def s14(spark, sf):
    path = scratch(spark, "stages")
    st = X.stages(spark, sf)
    for stage in ("summariser", "chairman"):
        ST.append_rows(ST.append_stage(st.filter(F.col("stage") == stage), F.col("post_id"), stage, F.col("payload"), F.col("created_at")), path)
    return spark.read.parquet(path).select("post_id", "stage", "created_at", F.get_json_object("payload", "$.quality").cast("int").alias("quality"))


@query("s15_strip_extra", "S15", sql("""
    SELECT post_id, stage, created_at, TRUE AS had_key, quality, toxic FROM stages"""))
def s15_strip(spark, sf):
    df = ST.strip_extra(X.stages(spark, sf).withColumnRenamed("payload", "payload_json"), "source")
    key = lambda k: F.get_json_object("payload_json", f"$.{k}")
    return df.filter(key("source").isNull()).select("post_id", "stage", "created_at", "had_key", key("quality").cast("int").alias("quality"), key("toxic").cast("int").alias("toxic"))


@query("s16_result_files", "S16", sql("""
    SELECT post_id, source, title, 3 AS copies FROM (SELECT post_id, source, md5(title) AS title FROM posts)"""))
def s16(spark, sf):
    df = X.posts(spark, sf).select("post_id", "source", "title", F.array("source").alias("tags"))
    path = scratch(spark, "results")
    for fmt in ("csv", "json", "parquet"):
        ST.write_results(df, f"{path}/{fmt}", fmt)
    told = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/csv"), spark.read.schema(df.schema).json(f"{path}/json"), spark.read.parquet(f"{path}/parquet")]
    every = ST.union_all([x.select("post_id", "source", F.md5(F.coalesce("title", F.lit(""))).alias("title")) for x in told])
    return every.groupBy("post_id", "source", "title").agg(F.count(F.lit(1)).cast("int").alias("copies"))
