"""Post queries, texts and payloads on hand-made rows."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdtape.functions import payloads as PL
from crowdtape.functions import text as T
from crowdtape.operators import evidence as E
from crowdtape.operators import posts as P
from crowdtape.operators import records as R
from crowdtape.operators import sentiment as D
from crowdtape.operators import tickers as K
from crowdtape.sources import articles as AR
from crowdtape.sources import store as ST


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


def ts(s):
    return pd.Timestamp(s).to_pydatetime()


STAGE = "post_id string, stage string, created_at timestamp, payload string"
POST = "post_id string, title string, text string, platform string, source string, posted_at timestamp, scraped_at timestamp"
INTEREST = "post_id string, interest_score double, status string, error_code string"


def test_latest_payload_wins(spark):
    s = rows(spark, STAGE, ("p", "summariser", ts("2024-01-01"), '{"spam": 5}'), ("p", "summariser", ts("2024-02-01"), '{"spam": 95}'))
    assert P.latest_payload(s).first()["payload"] == '{"spam": 95}'


def test_spam_values_and_reasons(spark):
    s = PL.summary(PL.load(F.lit('{"spam_likelihood_pct": "60%", "spam_why": " ", "spam_reasons": ["Reason one", null, "Reason two"]}')))
    out = value(spark, s)
    assert (out["spam_pct"], out["spam_why"]) == (60, "Reason one; Reason two")


def test_interest_filter_and_queue(spark):
    p = rows(spark, POST, *[(x, "", "", "", "", ts(f"2024-01-0{i}"), None) for i, x in enumerate("abc", 1)])
    i = rows(spark, INTEREST, ("a", 82.0, "ok", None), ("b", 35.0, "ok", None), ("c", 90.0, "error", None))
    assert [r[0] for r in P.interesting(p, i, 70).select("post_id").collect()] == ["a"]
    none = rows(spark, STAGE).limit(0)
    i2 = rows(spark, INTEREST, ("a", 78.0, "ok", None), ("b", 32.0, "ok", None))
    q = P.verdict_queue(p.filter("post_id <> 'c'"), none, i2, 60, repair=True)
    assert P.queue_counts(q).first().asDict() == {"total": 1, "skipped_with_verdict": 0, "skipped_below_threshold": 1, "repairs": 1}
    done = rows(spark, STAGE, ("a", "chairman", ts("2024-01-05"), "{}"))
    i3 = rows(spark, INTEREST, ("a", 92.0, "ok", None), ("b", 58.0, "ok", None), ("c", 81.0, "ok", None))
    q3 = P.verdict_queue(p, done, i3, 50)
    assert P.queue_counts(q3).first()["total"] == 2 and P.queue_counts(q3).first()["skipped_with_verdict"] == 1
    assert [r[0] for r in q3.filter("mode = 'interest'").orderBy(*P.queue_order()).select("post_id").collect()] == ["b", "c"]


def test_calendar_counts_the_first_day(spark):
    p = rows(spark, POST, ("a", "", "", "", "", ts("2024-02-05 08:00"), None), ("b", "", "", "", "", ts("2024-02-05 12:00"), None),
             ("c", "", "", "", "", None, ts("2024-02-07 01:00")), ("d", "", "", "", "", ts("2024-01-31 23:59:59"), None), ("e", "", "", "", "", ts("2024-02-01 08:00"), None))
    none = rows(spark, STAGE).limit(0)
    got = {str(r["day"]): r["posts"] for r in P.calendar(p, none, 2024, 2).collect()}
    assert got == {"2024-02-05": 2, "2024-02-07": 1, "2024-02-01": 1}
    assert P.calendar(p, none, 2024, 3).count() == 0


def test_clear_keeps_preserved_stages(spark):
    names = ["summariser", "conversation_hub", "researcher", "for", "against", "chairman"]
    s = rows(spark, STAGE, *[("p", n, ts("2024-01-01"), "{}") for n in names])
    kept, gone = ST.clear_analysis(s)
    assert kept.count() == 2 and gone.count() == 4
    x = ST.strip_extra(rows(spark, "post_id string, payload_json string", ("p", '{"research":"r","other":"o"}'))).first()
    assert x["had_key"] and x["payload_json"] == '{"other":"o"}'


def test_claim_entities(spark):
    out = value(spark, PL.claims(PL.load(F.lit('{"claims":[{"text":"a","entity":["Glencore PLC","Teck Resources"]},{"text":"b","entity":"   "}]}'))))
    assert [c["entity"] for c in out] == ["Glencore PLC", None]


@pytest.mark.parametrize("raw", ['```json\n{"a": 1}\n```', 'sure: {"a": 1} ok', '{"a": 1 /* note */}', '{"a": 1} // end'])
def test_tolerant_json(spark, raw):
    assert value(spark, PL.get(PL.parse(F.lit(raw)), "a", "int")) == 1


def test_one_delta_score(spark):
    d = rows(spark, "ticker string, ts timestamp, who array<string>, dir string, impact string, chan string",
             ("HOOD", ts("2025-01-01"), ["HOOD"], "up", "med", "news"))
    req = rows(spark, "ticker string, as_of timestamp", ("HOOD", ts("2025-01-02")))
    out = D.des_scores(req, d, channels=("all",)).first()
    assert (out["des_raw"], out["n_deltas"]) == (pytest.approx(1.0), 1) and out["confidence"] == pytest.approx(0.2449, abs=1e-4)


def test_future_deltas_change_nothing(spark):
    schema = "ticker string, ts timestamp, who array<string>, dir string, impact string, chan string"
    past = ("A", ts("2025-01-01"), ["A"], "up", "high", "social")
    later = ("A", ts("2025-01-03"), ["A"], "down", "high", "social")
    req = rows(spark, "ticker string, as_of timestamp", ("A", ts("2025-01-02")))
    one = D.des_scores(req, rows(spark, schema, past), channels=("all",)).first()
    two = D.des_scores(req, rows(spark, schema, past, later), channels=("all",)).first()
    assert one == two


def test_dedup_equals_one_by_one(spark):
    rng = random.Random(5)
    data = [(i, f"k{rng.randint(0, 25)}", f"u{rng.randint(0, 25)}") for i in range(80)]
    log = [("k0", "u1"), ("k2", "u3")]
    b = rows(spark, "n int, k string, u string", *data)
    got = sorted(r["n"] for r in P.dedup_against_log(b, rows(spark, "k string, u string", *log), [["k"], ["u"]], ["n"]).collect())
    ks, us, want = {k for k, _ in log}, {u for _, u in log}, []
    for n, k, u in data:
        if k not in ks and u not in us:
            want.append(n)
            ks.add(k)
            us.add(u)
    assert got == want


def test_blank_addresses_match_nothing(spark):
    b = rows(spark, "n int, k string, u string", (1, "a", ""), (2, "b", ""), (3, "c", None), (4, "a", "x"), (5, "", "x"), (6, "", "y"))
    out = P.dedup_against_log(b, rows(spark, "k string, u string", ("z", "")), [["k"], ["u"]], ["n"])
    assert sorted(r["n"] for r in out.collect()) == [1, 2, 3, 5, 6]


def test_terms_inside_words_are_found(spark):
    bodies = ["The union of coal-fired plants", "nio rises", "Glencore PLC and Teck", "x.y-z 42", ""]
    terms = ["nio", "coal", "glencore plc", "y-z", "a", "zz", "coal-fired"]
    p = rows(spark, "post_id string, body string", *[(str(i), b) for i, b in enumerate(bodies)])
    got = {(r[0], r[1]) for r in E.contained_terms(p, rows(spark, "term string", *[(t,) for t in terms])).collect()}
    assert got == {(str(i), t) for (i, b), t in itertools.product(enumerate(bodies), terms) if t in b.lower()}


def test_context_filter_by_name(spark):
    dim = rows(spark, "symbol string, long_name string, sector string, industry string, asset_type string", ("HOOD", "Robinhood Markets, Inc.", "", "", ""), ("X", "Other Corp", "", "", ""))
    target = rows(spark, "symbol string", ("HOOD",))
    p = rows(spark, "post_id string, body string", ("1", "robinhood outage"), ("2", "nothing here"))
    no_tags = rows(spark, "post_id string, symbol string").limit(0)
    assert [r["post_id"] for r in E.context_filter(p, no_tags, dim, target).collect()] == ["1"]
    tagged = rows(spark, "post_id string, symbol string", ("1", "X"), ("2", "X"))
    assert [r["post_id"] for r in E.context_filter(p, tagged, dim, target).collect()] == ["1"]


def test_resolve_and_default_sector(spark):
    raw = rows(spark, "Symbol string, longName string, sector string, industry string, asset_type string, marketCap string, aliases string, themes string",
               (" hood ", "Robinhood", "", "", "EQUITY", "x", "robinhood, HOODIE", "fintech, ai"))
    dim = K.load_tickers(raw).withColumn("ord", F.lit(1))
    assert dim.first()["sector"] == "UNKNOWN"
    got = K.resolve(rows(spark, "t string", ("hood",), ("Hoodie",), ("none",)), "t", K.alias_map(dim)).collect()
    assert {r["t"]: r["symbol"] for r in got} == {"hood": "HOOD", "Hoodie": "HOOD", "none": None}


def test_sessions_follow_daylight_saving(spark):
    f = lambda d: value(spark, K.session_utc(F.to_date(F.lit(d)), F.lit("America/New_York"), F.lit("09:30")))
    assert (f("2024-01-10"), f("2024-07-10")) == ("14:30", "13:30")


def test_symbol_forms(spark):
    alt = lambda s: value(spark, K.symbol_alternatives(F.lit(s)))
    assert alt("BRK.B") == ["BRK-B"] and alt("AAM.U") == ["AAM-U", "AAM-UN"] and alt("ABR$D") == ["ABR-PD"]
    al = value(spark, K.build_aliases(F.lit("GC=F"), F.lit("FUTURES"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert "gold spot" in al and "GC contract" in al
    assert value(spark, K.theme_tags(F.lit("Blue tanker"), F.lit("packaging"))) == []


def test_channel_is_word_bounded(spark):
    assert value(spark, T.channel(F.lit("fox"), F.lit(""))) == "other"
    assert value(spark, T.channel(F.lit("x"), F.lit(""))) == "social"


def test_article_extraction(spark):
    para = "This is a sentence of the story with enough words to matter. " * 5
    html = f"<html><head><title>T</title></head><body><nav><p>menu</p></nav><article><h1>T</h1><p>{para}</p><div class='ad'><p>buy</p></div><p>{para}</p><p>{para}</p><p>SOURCE: wire</p></article></body></html>"
    pages = rows(spark, "page_id long, url string, html string", (1, "https://a.example.com/x", html), (2, "https://a.example.com/y", "<p>tiny"))
    out = {r["page_id"]: r for r in AR.articles(pages).collect()}
    assert out[1]["fetch_status"] == "ok" and "menu" not in out[1]["text"] and "buy" not in out[1]["text"] and out[1]["text"].count("\n\n") == 2
    assert out[2]["text"] is None
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","articleBody":"%s"}]}</script>' % ("b" * 200)
    assert AR.candidate_texts(ld)["candidates"][1] == "b" * 200
    text = "menu\nMon, January 6, 2025\nBody line\nHelp\nafter"
    assert value(spark, AR.bulletin_slice(F.lit(text))) == "Mon, January 6, 2025\n\nBody line"


def test_atom_feed(spark):
    xml = '<feed><title>F</title><entry><id>i1</id><title>One</title><link href="https://e/1"/><summary>S</summary></entry></feed>'
    r = AR.feed_posts(rows(spark, "feed_url string, feed_name string, xml string", ("https://f", None, xml))).first()
    assert (r["post_id"], r["url"], r["title"], r["text"], r["source"]) == ("i1", "https://e/1", "One", "One S", "F")


def test_gate_skips_late_arrivals(spark):
    d = rows(spark, "ticker string, delta_id int, ts timestamp, arrived timestamp", *[("A", i, ts(f"2024-01-01 0{h}:00"), ts(f"2024-01-02 {10 + i}:00")) for i, h in enumerate([1, 3, 2, 4])])
    got = [r["action"] for r in R.running_gate(d, ["arrived", "delta_id"]).orderBy("delta_id").collect()]
    assert got == ["ADD", "ADD", "SKIP", "ADD"]


def test_interest_points_by_hand(spark):
    from crowdtape.plans.reports import interest_points

    summ = '{"claimed_catalysts":["fda","deal"],"numbers_mentioned":["1"],"author_stance":"bullish","spam_likelihood_pct":20}'
    df = spark.range(1).select(
        PL.summary(PL.load(F.lit(summ))).alias("summ"), F.lit("t").alias("title"), F.lit("b").alias("text"), F.lit("sec").alias("platform_name"), F.lit(0.9).alias("novelty"),
        F.lit(3.0).alias("ret1d_pct"), F.lit(None).cast("double").alias("ret5d_pct"), F.lit(1.0).alias("ret_std_pct"), F.lit(1.75).alias("vol_ratio"), F.lit(3).alias("trend_strength"),
        F.lit(0.4).alias("slope_pct_per_day"), F.lit(0.5).alias("trend_r2"), F.lit(0.0).alias("distance_to_support_pct"), F.lit(None).cast("double").alias("distance_to_resistance_pct"),
        F.lit(False).alias("golden_cross"), F.lit(75.0).alias("rsi14"),
    )
    r = interest_points(df).first()
    tech, text, fresh = 10 + 5 + 10 + 10 + 5, 5 + 1 + 10, 9 + 10
    assert (r["tech_points"], r["text_points"], r["novelty_source_points"]) == (tech, text, fresh)
    assert r["interest_score"] == round((tech + text + fresh) * (1 - 0.7 * 0.2)) and r["council_recommended"]
