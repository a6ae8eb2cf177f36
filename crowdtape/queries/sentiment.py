"""Directional evidence scores over deltas derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sentiment as S
from . import fixtures as X
from .market import big, r4, sql
from .registry import query


def requests(spark, sf):
    """Every ticker at the end of each day it was mentioned."""
    d = X.deltas(spark, sf)
    return d.select("ticker", (F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).alias("as_of")).distinct()


REQ = "SELECT DISTINCT ticker, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS as_of FROM deltas"
SCORED = f"""
  q AS ({REQ}),
  bu AS (SELECT q.ticker, q.as_of, count(d.ts) AS burst FROM q LEFT JOIN deltas d ON d.ticker = q.ticker AND d.chan = 'social' AND d.ts <= q.as_of AND d.ts >= q.as_of - INTERVAL 6 HOUR GROUP BY ALL),
  pr AS (SELECT q.ticker, q.as_of, bu.burst, d.chan, CASE WHEN d.dir = 'up' THEN 1.0 WHEN d.dir = 'down' THEN -1.0 ELSE 0.0 END AS s,
      exp(-0.12::DOUBLE * (epoch_us(q.as_of) - epoch_us(d.ts)) / 86400e6) * (CASE d.impact WHEN 'high' THEN 1.4::DOUBLE WHEN 'med' THEN 1.0 ELSE 0.6 END)
        * (CASE WHEN d.chan = 'social' THEN least(1.5, 1.0 + 0.2::DOUBLE * ln(1.0 + bu.burst)) ELSE 1.0 END) AS w
    FROM q JOIN bu USING (ticker, as_of) JOIN deltas d ON d.ticker = q.ticker AND d.ts <= q.as_of AND d.ts >= q.as_of - INTERVAL 7 DAY),
  ch AS (SELECT * FROM (VALUES ('all'), ('news'), ('social')) c(channel)),
  ag AS (SELECT q.ticker, q.as_of, ch.channel, bu.burst, sum(w) AS sw, sum(w*s) AS sws, sum(w*s*s) AS swa, sum(w*w) AS sw2, count(w) AS n
    FROM q JOIN bu USING (ticker, as_of) CROSS JOIN ch LEFT JOIN pr ON pr.ticker = q.ticker AND pr.as_of = q.as_of AND (ch.channel = 'all' OR pr.chan = ch.channel) GROUP BY ALL),
  sc AS (SELECT ticker, as_of, channel, burst, n AS n_deltas, sw, sw2, CASE WHEN sw > 0 THEN sws/sw ELSE 0 END AS des_raw,
      CASE WHEN sw > 0 THEN greatest(0, swa/sw - (sws/sw)*(sws/sw)) ELSE 0 END AS variance FROM ag),
  des AS (SELECT *, CASE WHEN sw > 0 THEN least(1, greatest(0, tanh(sw*sw/sw2/4.0) / (1 + 1.8::DOUBLE*sqrt(variance)))) ELSE 0 END AS confidence FROM sc)"""


@query("c16_des_scores", "C16 A6 A7 A8 A10 J18 H-D2 H-S8", sql(f"""WITH {SCORED}
    SELECT ticker, as_of, channel, round(des_raw,4) AS des_raw, round(variance,4) AS variance, round(confidence,4) AS confidence, n_deltas, burst FROM des"""))
def c16(spark, sf):
    return r4(S.des_scores(requests(spark, sf), X.deltas(spark, sf)), "des_raw", "variance", "confidence")


@query("a09_des_with_peers", "A9 J22 C16", sql(f"""WITH {SCORED},
    dm AS (SELECT ticker, as_of, des_raw, confidence, n_deltas, burst, channel, CAST(substr(ticker, 2) AS INTEGER) % 4 AS sector FROM des WHERE channel = 'all'),
    mo AS (SELECT DISTINCT sector, as_of FROM dm),
    al AS (SELECT m.sector, m.as_of, t.ticker FROM mo m JOIN (SELECT DISTINCT ticker, CAST(substr(ticker, 2) AS INTEGER) % 4 AS sector FROM deltas) t USING (sector)),
    pa AS (SELECT al.sector, al.as_of, al.ticker, count(d.ts) AS n FROM al LEFT JOIN deltas d ON d.ticker = al.ticker AND d.ts <= al.as_of AND d.ts >= al.as_of - INTERVAL 7 DAY GROUP BY ALL),
    bu2 AS (SELECT al.ticker, al.as_of, count(d.ts) AS burst FROM al LEFT JOIN deltas d ON d.ticker = al.ticker AND d.chan = 'social' AND d.ts <= al.as_of AND d.ts >= al.as_of - INTERVAL 6 HOUR GROUP BY ALL),
    pw AS (SELECT al.sector, al.as_of, al.ticker, sum(w*s)/sum(w) AS des FROM (
       SELECT al.*, CASE WHEN d.dir = 'up' THEN 1.0 WHEN d.dir = 'down' THEN -1.0 ELSE 0.0 END AS s, exp(-0.12::DOUBLE * (epoch_us(al.as_of) - epoch_us(d.ts)) / 86400e6) * (CASE d.impact WHEN 'high' THEN 1.4::DOUBLE WHEN 'med' THEN 1.0 ELSE 0.6 END)
        * (CASE WHEN d.chan = 'social' THEN least(1.5, 1.0 + 0.2::DOUBLE * ln(1.0 + bu2.burst)) ELSE 1.0 END) AS w
       FROM al JOIN bu2 USING (ticker, as_of) JOIN deltas d ON d.ticker = al.ticker AND d.ts <= al.as_of AND d.ts >= al.as_of - INTERVAL 7 DAY) al GROUP BY ALL),
    ps AS (SELECT dm.ticker, dm.as_of, avg(pw.des) AS m FROM dm JOIN pw ON pw.sector = dm.sector AND pw.as_of = dm.as_of AND pw.ticker <> dm.ticker GROUP BY ALL)
    SELECT dm.ticker, dm.as_of, channel, round(des_raw,4) AS des_raw, round(coalesce(m,0),4) AS des_sector, round(des_raw-coalesce(m,0),4) AS des_idio, round(confidence,4) AS confidence, n_deltas, burst,
      round((des_raw-coalesce(m,0))*confidence,4) AS des_adj FROM dm LEFT JOIN ps USING (ticker, as_of)"""))
def a09(spark, sf):
    d = X.deltas(spark, sf)
    sector = (F.substring("ticker", 2, 9).cast("int") % 4).cast("string")
    dim = d.select("ticker").distinct().select(F.col("ticker").alias("symbol"), sector.alias("sector"))
    out = S.with_peers(requests(spark, sf), d, dim)
    return r4(out, "des_raw", "des_sector", "des_idio", "confidence", "des_adj")


@query("j18_recent_deltas", "J18", sql(f"""
    WITH q AS ({REQ}) SELECT ticker, as_of, delta_id, rank FROM (
      SELECT q.ticker, q.as_of, d.delta_id, row_number() OVER (PARTITION BY q.ticker, q.as_of ORDER BY d.ts DESC, d.delta_id DESC) AS rank
      FROM q JOIN deltas d ON d.ticker = q.ticker AND d.ts <= q.as_of AND d.ts >= q.as_of - INTERVAL 3 DAY) WHERE rank <= 5"""))
def j18(spark, sf):
    from ..operators.evidence import recent_deltas

    out = recent_deltas(requests(spark, sf), X.deltas(spark, sf), days=3, limit=5)
    return big(out.select("ticker", "as_of", "delta_id", "rank"), "rank")


@query("t06_sliding_scores", "T6", sql(f"""WITH {SCORED}
    SELECT ticker, as_of, channel, round(des_raw,4) AS des_raw, n_deltas, burst FROM des WHERE channel = 'all'"""))
def t06(spark, sf):
    out = S.sliding_scores(X.deltas(spark, sf))
    return r4(out, "des_raw").select("ticker", "as_of", "channel", "des_raw", "n_deltas", "burst")
