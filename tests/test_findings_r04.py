"""Cases of the fourth round's findings, each wrong before its mend."""

from harness import compare, duck

SF = "/root/testdata/sf0.001"


def test_texts_decide_rows_of_the_context_query(spark, monkeypatch):
    """without the words of its posts the query loses rows, and with them it equals its SQL."""
    from pyspark.sql import functions as F

    from crowdtape.operators import evidence as E
    from crowdtape.queries.registry import ORACLES
    from crowdtape.queries.text import p19

    ok, n, _, _, msg = compare(spark, duck(SF), "p19_context_filter", p19, ORACLES["p19_context_filter"], SF)
    assert ok, msg
    whole = E.context_filter
    monkeypatch.setattr(E, "context_filter", lambda posts, *rest: whole(posts.withColumn("body", F.lit("")), *rest))
    assert 0 < p19(spark, SF).count() < n


def test_blocks_of_bars_are_shuffled_once_and_narrow(spark):
    """blocks meet the signals where they were collected, hold what the rules read, and give the same exits."""
    from pyspark.sql import functions as F

    from crowdtape.operators import trading as T
    from crowdtape.queries import fixtures as X

    s = X.signals(spark, SF).withColumn("interval", F.lit("1d"))
    bars, k = T.number_bars(X.daily_bars(spark, SF)), T.rules(use_rsi_exit=False, use_macd_exit=False)
    narrow = T.signal_paths(s, bars, 15, bucket="year", columns=T.PRICES)
    lines = narrow._jdf.queryExecution().executedPlan().toString().split("\n")
    final = next(i for i, line in enumerate(lines) if "ObjectHashAggregate" in line and "collect_list" in line)
    assert "Sort [_key" in lines[final - 1]  # no exchange between the blocks and their join
    assert not any("_t_" in line or "macd" in line or "_l_" in line for line in lines)
    read = ["signal_id", "exit_time", "exit_reason", "exit_price", "partial", "pnl_per_share"]
    both = [sorted(map(repr, T.barrier_exit(p, k).select(*read).collect())) for p in (narrow, T.signal_paths(s, bars, 15))]
    assert both[0] == both[1] and len(both[0]) > 100


def test_a_signal_finds_its_fill_across_blocks(spark):
    """before the first bar, on bars, between them, at block ends and after the last one."""
    import datetime as dt

    from crowdtape.operators import trading as T

    day = dt.datetime(2024, 1, 1)
    bars = [("A", "1d", day + dt.timedelta(days=i), *[float(i)] * 4, 1.0) for i in range(24)]
    bars = T.number_bars(spark.createDataFrame(bars, "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double"))
    calls = [(h, "A", "1d", day + dt.timedelta(hours=h)) for h in range(-12, 24 * 24 + 24, 12)]
    out = T.signal_paths(spark.createDataFrame(calls, "signal_id long, symbol string, interval string, ts timestamp"), bars, 2)
    got = {r.signal_id: (r.fill.ord, r.snap.ord, [b.ord for b in r.path]) for r in out.collect()}
    want = {}
    for h, *_ in calls:
        fill, snap = max(0, h // 24 + 1), max(0, -(-h // 24))
        if fill < 24:
            want[h] = (fill, snap, list(range(fill, min(fill + 2, 24))))
    assert got == want


def test_sliding_look_backs_are_no_windows(spark):
    """no sum, line or list is made anew at every bar by a window; the series form equals the tail form at any bar,
    on prices that move, stand still or are missing."""
    import datetime as dt
    import math
    import random

    from pyspark.sql import functions as F

    from crowdtape.plans.snapshot import snapshot_series, technical_snapshot

    draw, day, rows = random.Random(4), dt.datetime(2024, 1, 1), []
    for name in ("A", "B", "C"):
        price = 50.0
        for i in range(260 if name == "A" else 90):
            price = price if name == "B" or i % 90 > 60 else max(1.0, price * (1 + draw.uniform(-0.05, 0.05)))
            close = 0.0 if name == "C" and i == 40 else price
            rows.append((name, "1d", day + dt.timedelta(days=i), close, close * 1.01, close * 0.99, close, float(draw.randint(1, 50))))
    bars = spark.createDataFrame(rows, "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double")
    series = snapshot_series(bars)
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert not any(f in plan for f in ("regr_", "collect_list", "stddev", "avg("))
    got = {(r.symbol, r.asof): r.asDict() for r in series.collect()}
    assert len(got) == len(rows)
    for i in (4, 41, 89):
        for r in technical_snapshot(bars, as_of=F.lit(day + dt.timedelta(days=i))).collect():
            other = got[r.symbol, r.asof]
            for c, v in r.asDict().items():
                same = math.isclose(v, other[c], rel_tol=1e-8, abs_tol=1e-8) if isinstance(v, float) and other[c] is not None else v == other[c]
                assert same, (i, r.symbol, c, v, other[c])
