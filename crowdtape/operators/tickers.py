"""The ticker dimension: loading, resolving, enriching, filtering and leaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import market_tables as M
from ..sources.store import all_strings, blank_to_null
from .ranking import min_ranks


def literal_map(table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


# ---- loading ------------------------------------------------------------------------------------
def load_tickers(df: DataFrame) -> DataFrame:
    """Typed dimension from the all-string enriched file."""
    sym = F.upper(F.trim(F.col("Symbol")))
    aliases = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), lambda a: F.upper(F.trim(a))), lambda a: a != "")
    themes = F.filter(F.transform(F.split(F.coalesce("themes", F.lit("")), ","), lambda x: F.trim(x)), lambda a: a != "")
    return df.select(
        sym.alias("symbol"), blank_to_null(F.col("longName")).alias("long_name"),
        F.coalesce(blank_to_null(F.col("sector")), F.lit("UNKNOWN")).alias("sector"),
        blank_to_null(F.col("industry")).alias("industry"), blank_to_null(F.col("asset_type")).alias("asset_type"),
        F.col("marketCap").try_cast("double").alias("market_cap"), F.array_distinct(aliases).alias("aliases"),
        themes.alias("themes"),
    ).filter("symbol <> ''")


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    return load_tickers(spark.read.option("header", True).option("multiLine", True).csv(path))


def yes(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit("")))).isin("Y", "YES", "TRUE", "T", "1")


def clean_symbol(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\$", ""))


def skip_symbol(c: Column) -> Column:
    """Vendor test symbols."""
    return c.rlike(r"^Z[A-Z]{3}T$")


def is_derived_security(c: Column) -> Column:
    """Warrants, units and rights."""
    return c.rlike(r"(?:-?W$|/W$|-?U$|/U$|-?R$|/R$)")


def read_listing(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Pipe-delimited listing; short rows padded, header and footer dropped."""
    df = spark.read.schema(all_strings(columns)).option("sep", "|").option("mode", "PERMISSIVE").csv(path)
    first = F.col(f"`{columns[0]}`")
    return df.filter(~first.startswith("File Creation Time") & (first != columns[0])).na.fill("")


def listing_rows(df: DataFrame, symbol: str, listing: Column, source: str, priority: int, derived: bool = True) -> DataFrame:
    """Listing rows in universe form; test issues dropped."""
    sym = clean_symbol(F.col(f"`{symbol}`"))
    has = set(df.columns)
    cat = F.col("`Market Category`") if "Market Category" in has else F.lit("")
    out = df.filter(~yes(F.col("`Test Issue`"))).select(
        sym.alias("symbol"), F.col("`Security Name`").alias("name"), listing.alias("listing"),
        cat.alias("category"), yes(F.col("ETF")).alias("etf"), F.lit(source).alias("source"),
        F.lit(priority).alias("priority"),
    ).filter((F.col("symbol") != "") & ~skip_symbol(F.col("symbol")))
    return out if derived else out.filter(~is_derived_security(F.col("symbol")))


def read_seed_list(spark: SparkSession, path: str, header: str = "Symbol") -> DataFrame:
    """One symbol per line, ``#`` comments and a header line skipped."""
    line = F.trim("value")
    return (
        spark.read.text(path).filter((line != "") & ~line.startswith("#") & (F.lower(line) != header.lower()))
        .select(clean_symbol(F.element_at(F.split(line, ","), 1)).alias("symbol"))
    )


def seed_rows(df: DataFrame, listing: str, source: str, priority: int) -> DataFrame:
    return df.select(
        "symbol", F.lit("").alias("name"), F.lit(listing).alias("listing"), F.lit("").alias("category"),
        F.lit(False).alias("etf"), F.lit(source).alias("source"), F.lit(priority).alias("priority"),
    ).filter((F.col("symbol") != "") & ~skip_symbol(F.col("symbol")))


def currency_pairs(currencies: DataFrame) -> DataFrame:
    """Pair symbols of a small currency list, base not USD, legs distinct."""
    a, b = currencies.select(F.col("ccy").alias("a")), currencies.select(F.col("ccy").alias("b"))
    pairs = a.join(F.broadcast(b), (F.col("a") != F.col("b")) & (F.col("a") != "USD"))
    return pairs.select(F.concat("a", "b", F.lit("=X")).alias("symbol"))


def assemble_universe(rows: DataFrame) -> DataFrame:
    """One row per symbol: the first source wins, blank names and listings are filled from later
    listings, the fund flag is kept if any listing sets it."""
    order = F.struct("priority", "source", "name", "listing")
    def filled(c):
        return F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order)), F.lit(""))

    return rows.groupBy("symbol").agg(
        filled("name").alias("name"), filled("listing").alias("listing"),
        F.min_by("category", order).alias("category"), F.bool_or("etf").alias("etf"),
        F.min_by("source", order).alias("source"),
    )


# ---- resolving ----------------------------------------------------------------------------------
def alias_map(dim: DataFrame, order: str = "ord") -> DataFrame:
    """Key -> symbol; a symbol beats an alias, an earlier owner of an alias beats a later one."""
    own = dim.select(F.col("symbol").alias("key"), "symbol", F.lit(0).alias("prio"), F.col(order).alias("o"))
    other = dim.select(F.explode("aliases").alias("key"), "symbol", F.lit(1).alias("prio"), F.col(order).alias("o"))
    both = own.unionByName(other.withColumn("key", F.upper(F.trim("key"))))
    return both.groupBy("key").agg(F.min_by("symbol", F.struct("prio", "o", "symbol")).alias("symbol"))


def resolve(df: DataFrame, col: str, aliases: DataFrame, name: str = "symbol") -> DataFrame:
    """Canonical symbol of a free-form ticker, or NULL.  The map is small, but its size is left
    for the planner to see; it is broadcast only below the session's limit."""
    key = F.upper(F.trim(F.coalesce(F.col(col), F.lit(""))))
    keyed = aliases.select(F.col("key").alias("_k"), F.col("symbol").alias(name))
    return df.withColumn("_k", key).join(keyed, "_k", "left").drop("_k")


def with_metadata(df: DataFrame, col: str, dim: DataFrame, fields: list[str]) -> DataFrame:
    """J8."""
    d = dim.select(F.col("symbol").alias("_s"), *fields)
    return df.withColumn("_s", F.upper(F.trim(F.col(col)))).join(d, "_s", "left").drop("_s")


def symbol_alternatives(sym: Column, limit: int = 5) -> Column:
    """Other spellings of preferred shares, units, warrants and share classes."""
    preferred = F.regexp_replace(F.regexp_replace(F.regexp_replace(sym, r"\$", "-P"), r"\^", "-P"), r"(?i)\.PR\.", "-P")
    stem = F.substring_index(sym, ".", 1)
    after = F.when(F.instr(sym, ".") > 0, F.regexp_replace(sym, r"^[^.]*\.", ""))
    class_share = F.when(
        F.upper(after).rlike("^[A-Z]$"), F.concat(stem, F.lit("-"), F.upper(after))
    ).when(F.upper(after).isin("PR", "PRA", "PRB", "PRC"), F.replace(sym, F.lit(".PR"), F.lit("-P")))
    base = F.substring(sym, F.lit(1), F.length(sym) - 2)
    unit = F.when(sym.endswith(".U"), F.array(F.concat(base, F.lit("-U")), F.concat(base, F.lit("-UN"))))
    warrant = F.when(sym.endswith(".W"), F.array(*[F.concat(base, F.lit(s)) for s in ("-W", "-WS", "-WT")]))
    none = F.array().cast("array<string>")
    found = F.concat(
        F.array(preferred), F.coalesce(unit, none), F.coalesce(warrant, none), F.array_compact(F.array(class_share))
    )
    return F.slice(F.array_distinct(F.filter(found, lambda x: (x != sym) & (x != ""))), 1, limit)


def vendor_suffix(*fields: Column) -> Column:
    """Suffix of the first field that names a known market."""
    out = F.lit(None).cast("string")
    for f in reversed(fields):
        text = F.upper(F.trim(F.coalesce(f, F.lit(""))))
        hit = F.lit(None).cast("string")
        for word, sfx in reversed(M.SUFFIXES):
            hit = F.when(F.contains(text, F.lit(word)), sfx).otherwise(hit)
        out = F.coalesce(hit, out)
    return F.coalesce(out, F.lit(""))


def resolve_vendor_symbols(requested: DataFrame, mapped: DataFrame, have: DataFrame) -> DataFrame:
    """The vendor symbol of each distinct ticker, or NULL: an enriched mapping if it has prices,
    nothing for known dead names, else the first suffix candidate with prices.

    Candidates are exploded with their rank and checked by a semi join on the symbols that have bars.
    ``requested(ticker)``, ``mapped(ticker, vendor)``, ``have(symbol)``.
    """
    raw = F.upper(F.regexp_replace(F.trim("ticker"), r"^\$", ""))
    req = requested.select(raw.alias("ticker")).filter("ticker <> ''").distinct()
    df = req.join(mapped.select(F.upper("ticker").alias("ticker"), "vendor"), "ticker", "left")
    bare = F.col("ticker").rlike(r"^[A-Z]{1,5}$")
    probe = F.transform(F.array(*[F.lit(s) for s in M.PROBE_SUFFIXES]), lambda s: F.concat("ticker", s))
    dead = F.col("ticker").isin(M.DEAD_ALIASES)
    cands = (
        F.when(F.col("vendor").isNotNull(), F.array("vendor")).when(dead, F.array().cast("array<string>"))
        .when(bare, probe).otherwise(F.array("ticker"))
    )
    flat = df.select("ticker", F.posexplode(cands).alias("rank", "symbol"))
    good = flat.join(have.select("symbol").distinct(), "symbol", "left_semi")
    best = good.groupBy("ticker").agg(F.min_by("symbol", "rank").alias("vendor_symbol"))
    return req.join(best, "ticker", "left")


# ---- enriching ----------------------------------------------------------------------------------
def symbol_class(sym: Column) -> Column:
    """H-S13: security class by suffix."""
    return F.when(sym.rlike(r"-?W$|/W$"), "WARRANT").when(sym.rlike(r"-?U$|/U$"), "UNIT").when(
        sym.rlike(r"-?R$|/R$"), "RIGHTS"
    )


def split_suffix(sym: Column) -> Column:
    """H-S13: (base, class) of a suffixed symbol."""
    s = F.upper(F.trim(sym))
    pat = r"^(.*)[-/](W|WS|WT|U|UN|R)$"
    suf = F.regexp_extract(s, pat, 2)
    kind = F.when(suf.isin("W", "WS", "WT"), "WARRANT").when(suf.isin("U", "UN"), "UNIT").when(suf == "R", "RIGHTS")
    return F.struct(F.when(suf != "", F.regexp_extract(s, pat, 1)).otherwise(s).alias("base"), kind.alias("kind"))


def asset_type(quote_type: Column, sym: Column, name: Column) -> Column:
    """H-S14."""
    q, s, n = F.lower(F.coalesce(quote_type, F.lit(""))), F.upper(sym), F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(q.isin("etf", "mutualfund", "closedendfund", "index"), "ETF")
        .when(q.isin("futures", "future"), "FUTURES").when(q.isin("currency", "forex"), "FOREX")
        .when(q.isin("crypto", "cryptocurrency"), "CRYPTO").when(s.endswith("=F"), "FUTURES")
        .when(s.endswith("=X"), "FOREX").when(s.endswith("-USD"), "CRYPTO")
        .when(symbol_class(s).isNotNull(), symbol_class(s)).when(F.contains(n, F.lit("adr")), "ADR")
        .when(n.rlike(r"\bacquisition\b|\bholdings\b|\bcapital\b|\bblank check\b"), "SPAC?").otherwise("EQUITY")
    )


def futures_root(sym: Column) -> Column:
    return F.substring_index(sym, "=F", 1)


def fill_missing(df: DataFrame) -> DataFrame:
    """H-S15: names, sector and theme of futures, currency pairs and coins from fixed tables."""
    s, at = F.upper("symbol"), F.upper(F.coalesce("asset_type", F.lit("")))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    fut, fx, coin = (at == "FUTURES") | s.endswith("=F"), (at == "FOREX") | s.endswith("=X"), (at == "CRYPTO") | F.contains(s, F.lit("-USD"))
    root = futures_root(s)
    human = lookup({k: v[0] for k, v in M.FUTURES.items()}, root)
    fsec = lookup({k: v[1] for k, v in M.FUTURES.items() if v[1]}, root)
    fth = lookup({k: v[2] for k, v in M.FUTURES.items()}, root)
    pair = F.when(s.endswith("=X"), F.regexp_replace(s, "=X$", "")).otherwise(s)
    a, b = F.substring(pair, 1, 3), F.substring(pair, 4, 3)
    named = F.length(pair) >= 6
    ccy = lambda c: F.coalesce(lookup(M.CURRENCY_NAMES, c), c)
    c = F.substring_index(s, "-USD", 1)
    theme = F.when(fut, fth).when(coin, F.lit("crypto_blockchain"))
    themes = F.coalesce(F.col("themes"), F.lit(""))
    return df.withColumns(
        {
            "long_name": F.coalesce(
                blank("long_name"), F.when(fut & human.isNotNull(), F.concat(human, F.lit(" Futures"))),
                F.when(fx & named, F.concat(ccy(a), F.lit(" / "), ccy(b))),
                F.when(coin, F.coalesce(lookup(M.CRYPTO_NAMES, c), c)),
            ),
            "short_name": F.coalesce(
                blank("short_name"), F.when(fut, human), F.when(fx & named, F.concat(a, F.lit("/"), b)), F.when(coin, c)
            ),
            "sector": F.coalesce(blank("sector"), F.when(fut, fsec)),
            "industry": F.coalesce(F.col("industry"), F.when(fut | fx, F.lit(""))),
            "themes": F.when(
                theme.isNotNull() & ~F.contains(themes, theme),
                F.array_join(F.filter(F.array(themes, theme), lambda t: t != ""), ", "),
            ).otherwise(themes),
        }
    )


def strip_company_suffix(name: Column) -> Column:
    pat = r"(?i)\b(inc(orporated)?|corp(oration)?|co(mpany)?|plc|sa|nv|ag|ltd|limited|s\.?a\.?)\b\.?,?"
    return F.trim(F.regexp_replace(name, pat, ""))


def build_aliases(sym: Column, kind: Column, long_name: Column, short_name: Column) -> Column:
    """H-S16: sorted distinct spellings by asset class."""
    s, at = F.upper(sym), F.upper(F.coalesce(kind, F.lit("")))
    names = F.array_compact(F.array(F.nullif(long_name, F.lit("")), F.nullif(short_name, F.lit(""))))
    none = F.array().cast("array<string>")
    pick = lambda cond, arr: F.when(cond, arr).otherwise(none)
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    equity = at.isin("EQUITY", "ADR", "ETF", "WARRANT", "UNIT", "RIGHTS", "SPAC?", "")
    cleaned = F.transform(names, strip_company_suffix)
    share_class = F.transform(cleaned, lambda n: F.concat(n, F.lit(" Class "), F.right(s, F.lit(1))))
    fut, fx, coin = (at == "FUTURES") | s.endswith("=F"), (at == "FOREX") | s.endswith("=X"), (at == "CRYPTO") | F.contains(s, F.lit("-USD"))
    root = futures_root(s)
    human = lookup({k: v[0] for k, v in M.FUTURES.items()}, root)
    pair = F.when(s.endswith("=X"), F.regexp_replace(s, "=X$", "")).otherwise(s)
    a, b = F.substring(pair, 1, 3), F.substring(pair, 4, 3)
    an, bn = (F.coalesce(lookup(M.CURRENCY_NAMES, x), x) for x in (a, b))
    c = F.substring_index(s, "-USD", 1)
    coin_name = lookup(M.CRYPTO_NAMES, c)
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    parts = [
        F.array(s), pick(equity, names), pick(equity, cleaned), pick(equity & s.rlike(r"[-.][ABCD]$"), share_class),
        pick(equity & ((at == "WARRANT") | s.rlike(r"(-W|-WS|\.W)$")), lits("warrant", "warrants")),
        pick(equity & ((at == "UNIT") | s.rlike(r"(-U|-UN|\.U)$")), lits("unit", "units")),
        pick(fut & human.isNotNull(), F.array(human, join(human, " futures"), join(human, " price"))),
        pick(fut, F.array(join(root, " futures"), join(root, " contract"), join(root, " front-month"))),
        pick(fut & human.isin("gold", "silver", "copper", "platinum", "palladium", "aluminum"), F.array(join(human, " spot"))),
        pick(fx & (F.length(pair) >= 6), F.array(
            pair, join(a, "/", b), join(a, b), join(a, "-", b), join(a, " ", b),
            join(an, " / ", bn), join(an, "-", bn), join(an, " vs ", bn))),
        pick(coin, F.array_compact(F.array(F.nullif(long_name, F.lit("")), c, join(c, " price"), join(c, "/USD"), join(c, " USD"), join(c, "-USD")))),
        pick(coin & coin_name.isNotNull(), F.array(coin_name, join(coin_name, " price"), join(coin_name, " to USD"))),
    ]
    flat = F.transform(F.array_compact(F.concat(*parts)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(flat, lambda x: x != "")))


def theme_tags(name: Column, industry: Column, themes: dict | None = None) -> Column:
    """H-S18: sorted themes whose pattern occurs in "name | industry"; containers and packaging are
    no shipping."""
    table = themes or {k: v[0] for k, v in M.THEMES.items()}
    hay = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" | "), F.coalesce(industry, F.lit(""))))
    box = F.contains(hay, F.lit("packaging")) | F.contains(F.lower(F.coalesce(industry, F.lit(""))), F.lit("container"))
    tags = []
    for theme in sorted(table):
        hit = hay.rlike("(?i)" + table[theme])
        if theme == "shipping":
            hit = hit & ~box
        tags.append(F.when(hit, F.lit(theme)))
    return F.array_compact(F.array(*tags))


def primary_themes(themes: Column, sector: Column, n: int = 3) -> Column:
    """H-S18: the first ``n`` themes, those typical of the sector first, then by name."""
    sec = F.lower(F.coalesce(sector, F.lit("")))
    typical = F.array().cast("array<string>")
    for name, members in M.SECTOR_BIAS.items():
        typical = F.when(F.contains(sec, F.lit(name)), F.concat(typical, F.array(*[F.lit(m) for m in members]))).otherwise(typical)
    keyed = F.transform(themes, lambda t: F.struct(F.when(F.array_contains(typical, t), 0).otherwise(1).alias("w"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["t"])


EXCHANGE_FIELDS = ["source_key", "market", "tz", "days", "open_local", "close_local", "split_session"]


def exchange_meta(code: Column, label: Column, sym: Column) -> Column:
    """Symbol class, else exchange code, else first market name inside the label, else a
    fallback, as one struct.  The table has fixed size and is folded into the expression."""
    def row(r):
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(EXCHANGE_FIELDS, r)])

    s, c, text = F.upper(F.coalesce(sym, F.lit(""))), F.upper(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    by_code = F.try_element_at(
        F.create_map(*[x for r in M.EXCHANGES for x in (F.lit(r[0]), row(r))]), c
    )
    rows = F.array(*[row(r) for r in M.EXCHANGES])
    by_label = F.try_element_at(F.filter(rows, lambda r: F.contains(text, F.lower(r["market"]))), F.lit(1))
    sp = M.SPECIAL_EXCHANGES
    return (
        F.when(s.endswith("=X"), row(sp["fx"])).when(s.endswith("-USD"), row(sp["crypto"]))
        .when(s.endswith("=F"), row(sp["futures"]))
        .otherwise(F.coalesce(by_code, by_label, row(sp["fallback"])))
    )


def session_utc(day: Column, tz: Column, hhmm: Column) -> Column:
    """H-D3: a local session time of a day as UTC HH:mm, daylight saving included."""
    local = F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), hhmm), "yyyy-MM-dd HH:mm")
    return F.date_format(F.to_utc_timestamp(local, tz), "HH:mm")


def universe_filter(df: DataFrame, min_cap: float, min_adv: float, allow: list[str]) -> DataFrame:
    """P7."""
    at = F.upper("asset_type")
    cap = F.coalesce("market_cap", F.lit(0.0)) >= min_cap
    adv = F.coalesce("adv_value", F.lit(0.0)) >= min_adv
    equity = at.isin(M.EQUITY_TYPES)
    other = F.col("last_close").isNotNull() & (F.col("adv_value").isNull() | (F.col("adv_value") >= 0))
    return df.filter(at.isin(allow) & F.when(equity, cap & adv).otherwise(other))


def sparse_rows(df: DataFrame, limit: int | None = None, order: str = "symbol") -> DataFrame:
    """Rows whose metadata is missing; ``limit`` takes the first ones by ``order``."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    hit = df.filter(
        empty("long_name") | (F.col("sector").isNull() & F.col("industry").isNull())
        | empty("market") | (F.upper("market") == "UNKNOWN")
    )
    return hit.orderBy(order).limit(limit) if limit else hit


def apply_patch(df: DataFrame, patch: DataFrame, threshold: float) -> DataFrame:
    """Fill blanks from a patch, and take its asset type if it is a hard one, sure enough and
    the present one is only a default.  ``applied`` marks changed types."""
    p = patch.select("symbol", F.upper("detected").alias("_t"), "conf", "name", F.upper(F.trim("label")).alias("_x"))
    j = df.join(p, "symbol", "left")
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    unknown = F.upper(F.coalesce("market", F.lit("UNKNOWN"))) == "UNKNOWN"
    market = lookup({k: v[0] for k, v in M.EXCHANGE_LABELS.items()}, F.col("_x"))
    code = lookup({k: v[1] for k, v in M.EXCHANGE_LABELS.items()}, F.col("_x"))
    take = F.coalesce(
        F.col("_t").isin(M.HARD_TYPES) & (F.coalesce("conf", F.lit(0.0)) >= threshold)
        & F.upper(F.coalesce("asset_type", F.lit(""))).isin("", "EQUITY", "UNKNOWN"),
        F.lit(False),
    )
    found = unknown & market.isNotNull()
    return j.withColumns(
        {
            "long_name": F.when(empty("long_name") & (F.trim("name") != ""), F.trim("name")).otherwise(F.col("long_name")),
            "exchange": F.when(found & empty("exchange"), code).otherwise(F.col("exchange")),
            "market": F.when(found, market).otherwise(F.col("market")),
            "themes": F.when(take & (F.col("_t") == "ETF") & empty("themes"), "asset_management").otherwise(F.col("themes")),
            "asset_type": F.when(take, F.col("_t")).otherwise(F.col("asset_type")),
            "applied": take,
        }
    ).drop("_t", "_x", "conf", "name")


def enrich(info: DataFrame, perf: DataFrame, on_day: Column) -> DataFrame:
    """The whole enrichment as one plan over info(symbol, quote_type, long_name, short_name,
    sector, industry, exchange, full_exchange, market_cap, average_volume) and W20's performance.

    A row costs much and is small, so a whole table may lie in one split: rows are dealt to all tasks first.
    """
    df = info.repartition("symbol").withColumn("symbol", clean_symbol(F.col("symbol"))).withColumn(
        "asset_type", asset_type(F.col("quote_type"), F.col("symbol"), F.col("long_name"))
    ).withColumn("themes", F.lit(""))
    df = fill_missing(df)
    df = df.withColumn("aliases", build_aliases(F.col("symbol"), F.col("asset_type"), F.col("long_name"), F.col("short_name")))
    tags = theme_tags(F.coalesce(F.nullif("long_name", F.lit("")), F.col("short_name")), F.col("industry"))
    df = fill_missing(df.withColumn("themes", F.array_join(tags, ", ")))
    df = df.withColumn("ex", exchange_meta(F.col("exchange"), F.col("full_exchange"), F.col("symbol")))
    df = df.select("*", "ex.*").drop("ex").withColumns(
        {
            "open_utc": session_utc(on_day, F.col("tz"), F.col("open_local")),
            "close_utc": session_utc(on_day, F.col("tz"), F.col("close_local")),
        }
    )
    df = df.join(perf, "symbol", "left")
    lacks = F.col("adv_value").isNull() | (F.col("adv_value") <= 0)
    est = F.coalesce("average_volume", F.lit(0.0)) * F.coalesce("last_close", F.lit(0.0))
    df = df.withColumn("adv_value", F.when(lacks & F.col("asset_type").isin(M.EQUITY_TYPES), est).otherwise(F.col("adv_value")))
    split = F.filter(F.transform(F.split("themes", ","), lambda x: F.trim(x)), lambda t: t != "")
    return df.withColumn("themes_primary", F.array_join(primary_themes(split, F.col("sector")), ", "))


def coverage(df: DataFrame, fields: list[str], by: str | None = None) -> DataFrame:
    """Share of non-null values per field, and counts per ``by``."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.avg(F.col(f).isNotNull().cast("double")).alias(f"{f}_share") for f in fields]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


# ---- leaders ------------------------------------------------------------------------------------
def _leader_scores(df: DataFrame, group: list[str], weights: tuple[float, float, float]) -> DataFrame:
    miss = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    ranks = min_ranks(
        df, group,
        {"cap": miss("market_cap", 0.0), "liq": miss("adv_value", 0.0), "r3": miss("ret_3m", -1.0),
         "r6": miss("ret_6m", -1.0), "r12": miss("ret_12m", -1.0)},
        ["symbol"],
    )
    momentum = (F.col("rank_r3") + F.col("rank_r6") + F.col("rank_r12")) / 3.0
    a, b, c = weights
    # equal weighted ranks must tie, so that the symbol decides and not the last bit of a sum
    score = F.round(a * F.col("rank_cap") + b * F.col("rank_liq") + c * momentum, 9)
    return ranks.select(*group, "symbol", score.alias("leader_score"))


def _first(scored: DataFrame, group: str, n: int, order: str) -> DataFrame:
    """L7."""
    s = F.col("leader_score")
    w = W.partitionBy(group).orderBy(s.desc() if order == "reference" else s.asc(), "symbol")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def sector_leaders(df: DataFrame, n: int = 12, order: str = "best") -> DataFrame:
    """C14: weighted rank over the whole universe, the ``n`` best per sector (rank 1 is best; the
    original sort that lists the weakest is ``order="reference"``)."""
    one = df.withColumn("_all", F.lit(0))
    scored = _leader_scores(one, ["_all"], (0.4, 0.3, 0.3)).drop("_all").join(df.select("symbol", "sector"), "symbol")
    top = _first(scored, "sector", n, order)
    return top.withColumn("proxy", lookup(M.SECTOR_FUNDS, F.col("sector")))


def theme_leaders(df: DataFrame, n: int = 20, order: str = "best") -> DataFrame:
    """C14: ranks inside each theme."""
    split = F.filter(F.transform(F.split(F.coalesce("themes", F.lit("")), ","), lambda x: F.trim(x)), lambda t: t != "")
    flat = df.withColumn("theme", F.explode(F.array_distinct(split)))
    top = _first(_leader_scores(flat, ["theme"], (0.35, 0.35, 0.30)), "theme", n, order)
    return top.withColumn("proxies", F.coalesce(lookup({k: v[1] for k, v in M.THEMES.items()}, F.col("theme")), F.lit("")))


# ---- lexicon ------------------------------------------------------------------------------------
def symbol_samples(posts: DataFrame, tagged: DataFrame, per_symbol: int) -> DataFrame:
    """The first ``per_symbol`` posts of each symbol as (title, bullet, snippet) rows; the
    limit is applied before the shuffle.  ``tagged(post_id, symbol)``."""
    from ..functions.text import clip

    w = W.partitionBy("symbol").orderBy("post_id")
    first = tagged.distinct().withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= per_symbol)
    p = posts.select("post_id", clip(F.col("title"), 160).alias("title"), clip(F.col("text"), 240).alias("snippet"))
    return first.join(p, "post_id").select("symbol", "pos", "post_id", "title", "snippet")


def keyword_list(words: Column) -> Column:
    """Lower case, blanks collapsed, at most 24 characters, distinct, first 12."""
    t = F.transform(words, lambda w: F.lower(F.trim(F.regexp_replace(w, r"\s+", " "))))
    return F.slice(F.array_distinct(F.filter(t, lambda w: (w != "") & (F.length(w) <= 24))), 1, 12)


def gate_preview(lex: DataFrame) -> DataFrame:
    """What a symbol's word lists let in and keep out."""
    k = lambda c: F.coalesce(keyword_list(F.col(c)), F.array().cast("array<string>"))
    return lex.select(
        "symbol", F.concat(k("must_hooks"), k("finance_core"), k("sector_terms")).alias("include_any"),
        k("macro_terms").alias("include_macro"), k("regulatory_terms").alias("regulatory"),
        k("exclusions").alias("exclude_any"), F.substring(F.coalesce("why", F.lit("ok")), 1, 120).alias("why"),
    )


def prediction_board(universe: DataFrame, calls: DataFrame, trades: DataFrame, limit: int) -> DataFrame:
    """Universe with the number of calls, the latest call and the latest trade of each ticker,
    most called first; the limit is the board's length."""
    c = calls.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("calls"), F.max_by(F.struct("ts", "direction", "confidence"), F.struct("ts", "call_id")).alias("call")
    )
    t = trades.groupBy("ticker").agg(F.max_by(F.struct("ts", "exit_reason", "pnl"), F.struct("ts", "call_id")).alias("trade"))
    j = universe.join(c, "ticker", "left").join(t, "ticker", "left")
    return j.select(
        "ticker", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.col("call.ts").alias("last_call"),
        F.col("call.direction").alias("direction"), F.col("trade.pnl").alias("last_pnl"),
    ).orderBy(F.desc("calls"), "ticker").limit(limit)
