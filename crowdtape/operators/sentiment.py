"""Directional evidence score (DES) of tickers as of any moment.

A request (ticker, as_of) asks for sums over the deltas of the last ``days`` days, weighted by
``exp(-decay * age) * impact``.  Pairing requests with deltas would emit every pair of a hot ticker,
so each sum is the difference of two decayed running totals instead:

    window(as_of) = G(as_of) - exp(-decay * days) * G(just before as_of - days)

``G(p)`` is the total over all deltas up to ``p``, each decayed to ``p``.  It is computed in one sweep
over (ticker, hour) groups of deltas and probes; what an hour inherits comes from one partially
aggregated row per (ticker, hour).  Social deltas carry a burst multiplier that depends on the
request, so social and other sums are kept apart and combined at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECAY = 0.12
CHANNELS = ("all", "news", "social")
_BLOCK_DAYS = 256.0  # exp(2 * DECAY * 256) stays far inside double range


def direction_value(d: Column) -> Column:
    """H-S8."""
    x = F.lower(d)
    return F.when(x == "up", 1.0).when(x == "down", -1.0).otherwise(0.0)


def impact_weight(i: Column) -> Column:
    x = F.lower(i)
    return F.when(x == "high", 1.4).when(x == "med", 1.0).otherwise(0.6)


def burst_multiplier(n: Column) -> Column:
    """A8."""
    return F.least(F.lit(1.5), 1.0 + 0.2 * F.log1p(F.greatest(n, F.lit(0))))


def confidence(sum_w: Column, sum_w2: Column, variance: Column) -> Column:
    """Coverage of effective samples times agreement."""
    neff = sum_w * sum_w / F.greatest(sum_w2, F.lit(1e-300))
    agree = 1.0 / (1.0 + 1.8 * F.sqrt(F.greatest(variance, F.lit(0.0))))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.tanh(neff / 4.0) * agree))
    return F.when(sum_w > 0, value).otherwise(0.0)


def _days(ts: Column) -> Column:
    return F.unix_micros(ts) / 86400e6


_GROUPS = ("s", "n", "o")  # social, news, other
_DECAYED = {"w": 1, "ws": 1, "wa": 1, "w2": 2}


def _in_group(g: str) -> Column:
    chan = F.col("chan")
    return {"s": chan == "social", "n": chan == "news"}.get(g, ~chan.isin("social", "news"))


def _value_columns() -> list[str]:
    return [f"{g}_{v}" for g in _GROUPS for v in (*_DECAYED, "k")]


def own_deltas(deltas: DataFrame) -> DataFrame:
    """Deltas whose ``who`` list names their ticker."""
    named = F.exists("who", lambda w: F.upper(w) == F.upper(F.col("ticker")))
    return deltas.filter(named).withColumn("ticker", F.upper("ticker"))


def _points(deltas: DataFrame, bucket: str) -> DataFrame:
    """Impact sums per (ticker, time), scaled to the start of their bucket; equal times merge on the
    map side."""
    d = own_deltas(deltas).select(
        "ticker", "ts", F.coalesce("chan", F.lit("other")).alias("chan"),
        impact_weight(F.col("impact")).alias("i"), direction_value(F.col("dir")).alias("s"),
    )
    raw = {"w": F.col("i"), "ws": F.col("i") * F.col("s"), "wa": F.col("i") * F.abs("s"),
           "w2": F.col("i") * F.col("i")}
    aggs = []
    for g in _GROUPS:
        cond = _in_group(g)
        aggs += [F.sum(F.when(cond, raw[v]).otherwise(0.0)).alias(f"{g}_{v}") for v in raw]
        aggs.append(F.count_if(cond).cast("double").alias(f"{g}_k"))
    p = d.groupBy("ticker", "ts").agg(*aggs).withColumn("_b", F.date_trunc(bucket, "ts"))
    since = _days(F.col("ts")) - _days(F.col("_b"))
    return p.withColumns(
        {
            f"{g}_{v}": F.col(f"{g}_{v}") * F.exp(DECAY * m * since)
            for g in _GROUPS for v, m in _DECAYED.items()
        }
    )


def _power(name: str) -> float:
    return DECAY * _DECAYED.get(name.split("_")[1], 0)


def _carry(points: DataFrame, probes: DataFrame) -> DataFrame:
    """Totals each probed (ticker, bucket) inherits, decayed to the bucket's start."""
    cols = _value_columns()
    sums = points.groupBy("ticker", "_b").agg(*[F.sum(c).alias(c) for c in cols])
    asked = probes.select("ticker", "_b").distinct().withColumn("_asked", F.lit(1))
    t = sums.unionByName(asked, allowMissingColumns=True).groupBy("ticker", "_b").agg(
        *[F.sum(c).alias(c) for c in cols], F.max("_asked").alias("_asked")
    ).na.fill(0.0, cols)
    t = t.withColumn("_d", _days(F.col("_b"))).withColumn("_blk", F.floor(F.col("_d") / _BLOCK_DAYS))
    into = F.col("_d") - F.col("_blk") * _BLOCK_DAYS
    t = t.withColumns({f"_x_{c}": F.col(c) * F.exp(_power(c) * into) for c in cols})
    inside = W.partitionBy("ticker", "_blk").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    by_block = W.partitionBy("ticker").orderBy("_blk")
    by_time = W.partitionBy("ticker").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    out = {}
    for c in cols:
        if _power(c) == 0:
            out[f"c_{c}"] = F.coalesce(F.sum(c).over(by_time), F.lit(0.0))
            continue
        total = F.coalesce(F.sum(f"_x_{c}").over(inside), F.lit(0.0)) * F.exp(-_power(c) * into)
        for j in (1, 2, 3):
            older = F.sum(f"_x_{c}").over(by_block.rangeBetween(-j, -j))
            total = total + F.coalesce(older, F.lit(0.0)) * F.exp(
                -_power(c) * (into + j * _BLOCK_DAYS)
            )
        out[f"c_{c}"] = total
    t = t.withColumns(out)  # over all buckets, before keeping the probed ones
    return t.filter("_asked = 1").select("ticker", "_b", *out)


def totals_at(deltas: DataFrame, probes: DataFrame, bucket: str = "hour") -> DataFrame:
    """``probes(ticker, at, before)`` -> the running totals up to ``at`` (``before`` excludes deltas
    exactly at ``at``), decayed to ``at``."""
    cols = _value_columns()
    points = _points(deltas, bucket)
    asked = probes.select("ticker", F.col("at").alias("ts"), "before").distinct().withColumn(
        "_b", F.date_trunc(bucket, "ts")
    )
    carry = _carry(points, asked)
    swept = points.withColumn("_kind", F.lit(1)).unionByName(
        asked.withColumn("_kind", F.when(F.col("before"), 0).otherwise(2)), allowMissingColumns=True
    )
    w = W.partitionBy("ticker", "_b").orderBy("ts", "_kind").rowsBetween(W.unboundedPreceding, 0)
    swept = swept.withColumns({f"g_{c}": F.coalesce(F.sum(c).over(w), F.lit(0.0)) for c in cols})
    out = swept.filter("_kind <> 1").join(carry, ["ticker", "_b"])
    since = _days(F.col("ts")) - _days(F.col("_b"))
    return out.select(
        "ticker", F.col("ts").alias("at"), "before",
        *[
            ((F.col(f"g_{c}") + F.col(f"c_{c}")) * F.exp(-_power(c) * since)).alias(c)
            for c in cols
        ],
    )


def window_sums(
    requests: DataFrame, deltas: DataFrame, days: int = 7, burst_hours: int = 6, bucket: str = "hour",
) -> DataFrame:
    """Per distinct (ticker, as_of) the decayed sums of the window, by channel group, and
    the number of social deltas in the last ``burst_hours`` (``burst``)."""
    cols = _value_columns()
    req = requests.select(F.upper("ticker").alias("ticker"), "as_of").distinct()
    edges = [
        ("hi", F.col("as_of"), F.lit(False)),
        ("lo", F.col("as_of") - F.make_dt_interval(F.lit(days)), F.lit(True)),
        ("bu", F.col("as_of") - F.make_dt_interval(F.lit(0), F.lit(burst_hours)), F.lit(True)),
    ]
    probes = req.select(
        "ticker", "as_of",
        F.explode(F.array(*[F.struct(F.lit(n).alias("edge"), t.alias("at"), b.alias("before")) for n, t, b in edges])).alias("p"),
    ).select("ticker", "as_of", "p.*")
    found = probes.join(totals_at(deltas, probes, bucket), ["ticker", "at", "before"], "left")

    def at(edge, c):
        return F.coalesce(F.max(F.when(F.col("edge") == edge, F.col(c))), F.lit(0.0))

    aggs = []
    for c in cols:
        keep = F.exp(F.lit(-_power(c) * days))
        aggs.append((at("hi", c) - keep * at("lo", c)).alias(c))
    aggs.append((at("hi", "s_k") - at("bu", "s_k")).alias("burst"))
    out = found.groupBy("ticker", "as_of").agg(*aggs)
    # a window without deltas of a group is exactly zero, whatever rounding left behind
    return out.withColumns(
        {
            f"{g}_{v}": F.when(F.col(f"{g}_k") > 0.5, F.col(f"{g}_{v}")).otherwise(0.0)
            for g in _GROUPS for v in _DECAYED
        }
    )


def score(sums: DataFrame, channels=CHANNELS) -> DataFrame:
    """DES, variance, confidence and count per channel choice."""
    m = burst_multiplier(F.col("burst"))

    def pick(groups, v, boost):
        f = (m * m if boost == 2 else m) if boost else F.lit(1.0)
        terms = [F.col(f"{g}_{v}") * (f if g == "s" else F.lit(1.0)) for g in groups]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    members = {"all": "sno", "news": "n", "social": "s"}
    variants = []
    for name in channels:
        g = members[name]
        variants.append(
            F.struct(
                F.lit(name).alias("channel"), pick(g, "w", 1).alias("sum_w"),
                pick(g, "ws", 1).alias("sum_ws"), pick(g, "wa", 1).alias("sum_wa"),
                pick(g, "w2", 2).alias("sum_w2"), pick(g, "k", 0).alias("k"),
            )
        )
    df = sums.select("ticker", "as_of", "burst", F.explode(F.array(*variants)).alias("v")).select(
        "ticker", "as_of", "burst", "v.*"
    )
    some = F.col("sum_w") > 0
    df = df.withColumn("des_raw", F.when(some, F.col("sum_ws") / F.col("sum_w")).otherwise(0.0))
    var = F.greatest(F.lit(0.0), F.col("sum_wa") / F.col("sum_w") - F.col("des_raw") * F.col("des_raw"))
    df = df.withColumn("variance", F.when(some, var).otherwise(0.0))
    return df.select(
        "ticker", "as_of", "channel", "des_raw", "variance",
        confidence(F.col("sum_w"), F.col("sum_w2"), F.col("variance")).alias("confidence"),
        F.round("k").cast("long").alias("n_deltas"), F.round("burst").cast("long").alias("burst"),
    )


def des_scores(
    requests: DataFrame, deltas: DataFrame, days: int = 7, burst_hours: int = 6, channels=CHANNELS,
) -> DataFrame:
    """C16 without peers."""
    return score(window_sums(requests, deltas, days, burst_hours), channels)


def live_members(moments: DataFrame, member: DataFrame, deltas: DataFrame, days: int) -> DataFrame:
    """(ticker, as_of): the sector's members that have a delta on a day within ``days`` before the moment.

    A delta enters on its day and leaves ``days`` later; a member's days of activity are merged before they
    meet the moments of its sector, by an equality join on (sector, day). So a moment costs what is live at
    it, not what the sector lists.
    """
    day = lambda c: F.unix_date(F.to_date(c))
    active = own_deltas(deltas).select("ticker", day(F.col("ts")).alias("_from")).distinct()
    active = active.join(member, "ticker").filter("sector is not null").select(
        "sector", "ticker", F.explode(F.sequence(F.col("_from"), F.col("_from") + days)).alias("_day")).distinct()
    return moments.withColumn("_day", day(F.col("as_of"))).join(active, ["sector", "_day"]).select("ticker", "as_of")


def with_peers(requests: DataFrame, deltas: DataFrame, dim: DataFrame, days: int = 7,
               burst_hours: int = 6, channels=("all",)) -> DataFrame:
    """Also the mean DES of the ticker's sector peers at the same moment.

    Each sector member with deltas in reach is scored once per (sector, moment), shared by all requests
    there; a request's peer mean is the sector's sum minus its own share.  Peers without deltas are left out.
    """
    member = dim.select(F.upper("symbol").alias("ticker"), F.lower("sector").alias("sector"))
    req = requests.select(F.upper("ticker").alias("ticker"), "as_of").distinct().join(member, "ticker", "left")
    moments = req.filter("sector is not null and sector <> ''").select("sector", "as_of").distinct()
    probes = live_members(moments, member, deltas, days)
    scored = des_scores(probes.unionByName(req.select("ticker", "as_of")), deltas, days, burst_hours, channels)
    known = scored.join(member, "ticker", "left")
    live = F.col("n_deltas") > 0
    sector = known.filter("sector is not null").groupBy("sector", "as_of", "channel").agg(
        F.sum(F.when(live, F.col("des_raw")).otherwise(0.0)).alias("_sum"), F.count_if(live).alias("_cnt")
    )
    own = req.join(scored, ["ticker", "as_of"])
    out = own.join(sector, ["sector", "as_of", "channel"], "left")
    peers = F.col("_cnt") - F.when(live, 1).otherwise(0)
    mean = F.when(peers > 0, (F.col("_sum") - F.when(live, F.col("des_raw")).otherwise(0.0)) / peers).otherwise(0.0)
    out = out.withColumn("des_sector", F.coalesce(mean, F.lit(0.0)))
    idio = F.col("des_raw") - F.col("des_sector")
    return out.select(
        "ticker", "as_of", "channel", "des_raw", "des_sector", idio.alias("des_idio"), "confidence",
        "n_deltas", "burst", (idio * F.col("confidence")).alias("des_adj"),
    )


def sliding_scores(deltas: DataFrame, days: int = 7, burst_hours: int = 6, step: str = "day") -> DataFrame:
    """T6 in batch: every ticker scored at the end of each step it has deltas in."""
    req = deltas.select("ticker", (F.date_trunc(step, "ts") + F.expr(f"INTERVAL 1 {step}")).alias("as_of")).distinct()
    return des_scores(req, deltas, days, burst_hours, ("all",))
