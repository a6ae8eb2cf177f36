"""Market and post tables derived from the driver's test tables, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare
from ..sources.bars import bars_from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, with zone-less timestamps read as UTC instants."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bars_from_ticks(
        li, "1d",
        symbol=F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
        ts=F.date_trunc("day", "l_shipdate"), price=price, volume=F.col("l_quantity"),
        # (order, line) as one number: the aggregation stays a hash aggregation
        order=[F.col("l_orderkey") * 8 + F.col("l_linenumber")],
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return bars_from_ticks(
        ev, "1h", symbol=F.col("event_type"), ts=F.date_trunc("hour", "ts"), price=F.col("value"),
        volume=F.lit(1.0), order=[F.col("ts"), F.col("event_id")],
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on a ticker at a moment, from orders: id, ticker, ts, side, confidence."""
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("_n"))
    return o.join(F.broadcast(n)).select(
        F.col("o_orderkey").alias("signal_id"),
        F.concat(F.lit("S"), ((F.col("o_custkey") % F.col("_n")) + 1).cast("string")).alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "long")
        .otherwise("short").alias("side"),
        (F.col("o_totalprice") / 500000.0).alias("confidence"),
    )


# events priced in constants, so that a delta does not depend on other rows
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ticker = F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string"))
    return ev.select(
        F.col("event_id").alias("delta_id"), ticker.alias("ticker"), "ts",
        F.array(ticker).alias("who"),
        F.when(F.col("event_type").isin("purchase", "signup"), "up")
        .when(F.col("event_type") == "error", "down").otherwise("neutral").alias("dir"),
        F.when(F.col("value") >= 60, "high").when(F.col("value") >= 20, "med")
        .otherwise("low").alias("impact"),
        F.when(k % 2 == 0, "social").otherwise("news").alias("chan"),
        F.col("event_type").alias("sum"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    hours = (F.col("doc_id") % 720).cast("int")
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), hours)
    return d.select(
        F.col("doc_id").cast("string").alias("post_id"), "source",
        F.element_at(F.split("source", "-"), 1).alias("platform"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/p/"), F.col("doc_id").cast("string")).alias("url"),
        F.element_at(F.split("text", "\n"), 1).alias("title"), "text", "lang",
        at.alias("posted_at"),
        (at + F.make_dt_interval(F.lit(0), F.lit(2))).alias("scraped_at"),
    )


def interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    raw = F.lit(100.0) * F.col("quality") - F.lit(60.0) * F.col("toxic") + F.lit(20.0)
    return lb.select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)).alias("interest_score"),
        F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"),
        F.when(F.col("toxic") == 1, "price_data_unavailable").alias("error_code"),
    )


STAGE_BASE = "2024-02-01 00:00:00"


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two summary versions per labelled post, and a verdict where quality is 1."""
    lb = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    j = lb.join(d, "doc_id")
    pid = F.col("doc_id").cast("string").alias("post_id")
    base = F.to_timestamp(F.lit(STAGE_BASE))

    def version(stage, days, quality):
        body = F.to_json(F.struct(
            quality.alias("quality"), F.col("toxic").alias("toxic"), F.col("source").alias("source")
        ))
        at = base + F.make_dt_interval(F.lit(days))
        return pid, F.lit(stage).alias("stage"), at.alias("created_at"), body.alias("payload")

    old = j.select(*version("summariser", 0, F.lit(-1)))
    new = j.select(*version("summariser", 1, F.col("quality")))
    verdict = j.filter(F.col("quality") == 1).select(*version("chairman", 2, F.col("quality")))
    return old.unionByName(new).unionByName(verdict)


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    sym = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    return p.select(
        sym.alias("symbol"), F.initcap("p_name").alias("long_name"), F.col("p_brand").alias("sector"),
        F.col("p_type").alias("industry"),
        F.when(F.col("p_size") < 40, "EQUITY").otherwise("ETF").alias("asset_type"),
        F.col("p_retailprice").alias("market_cap"),
        F.array(F.concat(F.lit("N"), F.col("p_partkey").cast("string")), F.upper("p_name")).alias("aliases"),
        F.col("p_partkey").alias("ord"),
    )


CTES = {
    "bars": """
        SELECT symbol, '1d' AS interval, ts,
               first(px ORDER BY l_orderkey, l_linenumber, px) AS open, max(px) AS high, min(px) AS low,
               last(px ORDER BY l_orderkey, l_linenumber, px) AS close, sum(l_quantity) AS volume
        FROM (SELECT 'S' || l_suppkey AS symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts,
                     l_extendedprice / l_quantity AS px, l_quantity, l_orderkey, l_linenumber
              FROM lineitem) GROUP BY symbol, ts""",
    "hbars": """
        SELECT event_type AS symbol, '1h' AS interval, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bts,
               first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
               last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events GROUP BY event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP)""",
    "ordbars": """
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ord,
               row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars""",
    "signals": """
        SELECT o_orderkey AS signal_id, 'S' || ((o_custkey % (SELECT count(*) FROM supplier)) + 1) AS symbol,
               o_orderdate AS ts,
               CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'long' ELSE 'short' END AS side,
               o_totalprice / 500000.0 AS confidence FROM orders""",
    "deltas": """
        SELECT event_id AS delta_id, 'U' || (user_id % 20) AS ticker, ts,
               CASE WHEN event_type IN ('purchase','signup') THEN 'up' WHEN event_type = 'error' THEN 'down' ELSE 'neutral' END AS dir,
               CASE WHEN value >= 60 THEN 'high' WHEN value >= 20 THEN 'med' ELSE 'low' END AS impact,
               CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 'social' ELSE 'news' END AS chan,
               event_type AS "sum" FROM events""",
    "posts": """
        SELECT CAST(doc_id AS VARCHAR) AS post_id, source, split_part(source, '-', 1) AS platform,
               'https://' || source || '.example.com/p/' || doc_id AS url,
               split_part(text, chr(10), 1) AS title, text, lang,
               TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS posted_at,
               TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 + 2 AS INTEGER)) AS scraped_at FROM documents""",
    "interest": """
        SELECT CAST(doc_id AS VARCHAR) AS post_id,
               least(100.0, greatest(0.0, 100.0 * quality - 60.0 * toxic + 20.0))::DOUBLE AS interest_score,
               CASE WHEN toxic = 1 THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN toxic = 1 THEN 'price_data_unavailable' END AS error_code FROM labels""",
    "stages": """
        SELECT CAST(l.doc_id AS VARCHAR) AS post_id, v.stage,
               TIMESTAMP '2024-02-01' + to_days(CAST(v.d AS INTEGER)) AS created_at,
               CASE WHEN v.d = 0 THEN -1 ELSE l.quality END AS quality, l.toxic, d.source
        FROM labels l JOIN documents d USING (doc_id),
             (VALUES ('summariser', 0), ('summariser', 1), ('chairman', 2)) v(stage, d)
        WHERE v.stage = 'summariser' OR l.quality = 1""",
    "tickers": """
        SELECT 'P' || p_partkey AS symbol, p_name AS raw_name, p_brand AS sector, p_type AS industry,
               CASE WHEN p_size < 40 THEN 'EQUITY' ELSE 'ETF' END AS asset_type,
               p_retailprice AS market_cap, p_partkey AS ord FROM part""",
}
