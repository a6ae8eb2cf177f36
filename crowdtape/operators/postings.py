"""Inverted index of posts: which posts contain a term, answered without reading texts.

Posts are dealt into segments of a month and about ``SEGMENT`` characters each. A segment is one row: its
vocabulary (the distinct runs of its posts, joined by line ends), the posts of every run as ascending
numbers inside the segment, and the fields that rank a post. Text is tiled by runs, so a term that is one
run occurs in a post if and only if it occurs in one of the post's runs: containment is decided on the
vocabulary, exactly, in any script. Parquet keeps the numbers delta-encoded.

A search passes over the segments of the asked months. Each distinct term is found in the vocabulary once,
its posts become one bit row, and a claim's scores are the sum of its terms' rows: a stop word costs a row
of bits, not a row per post. For the best ``k`` per claim only ``k`` rows per segment leave a task, so no
table of claims times posts is ever made. Claims go in batches of at most ``BATCH``, one pass each.

Terms of several runs (company names) are looked up in the texts, and only they.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage, stored
from . import evidence as E

SEGMENT = 4 << 20
BATCH = 4096
FILE_OPTIONS = {"parquet.writer.version": "v2", "parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false", "compression": "zstd"}
_FOUND = "set_id string, claim_id string, post_id string, score double, named boolean, url string, ordinal long"
_SEGMENT = ("slot date, part int, n int, vocabulary string, starts array<int>, members array<int>, post_id array<string>, "
            "at array<long>, url array<string>, ordinal array<long>")


def _segment(t: pa.Table) -> pa.Table:
    """One row of all posts of a segment."""
    t = t.combine_chunks()
    runs = t["runs"].combine_chunks()
    coded = runs.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    who = np.repeat(np.arange(t.num_rows), runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    code = coded.indices.to_numpy()
    order = np.lexsort((who, code))
    starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    row = {
        "slot": t["slot"][0], "part": t["part"][0], "n": t.num_rows, "vocabulary": "\n".join(coded.dictionary.to_pylist()),
        "starts": starts.tolist(), "members": who[order].tolist(), "post_id": t["post_id"].to_pylist(), "at": t["at"].to_pylist(),
        "url": t["url"].to_pylist(), "ordinal": t["ordinal"].to_pylist(),
    }
    kinds = [pa.date32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()),
             pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.table({c: pa.array([v.as_py() if isinstance(v, pa.Scalar) else v], k) for (c, v), k in zip(row.items(), kinds)})


def build(posts: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Write the index of ``posts(post_id, body, at[, url, ordinal])`` under ``path`` and open it. More posts
    are added by building into the same path again (an id must not come twice)."""
    there = set(posts.columns)
    p = posts.select(
        F.col("post_id").cast("string").alias("post_id"), F.coalesce("body", F.lit("")).alias("body"), F.unix_micros("at").alias("at"),
        F.trunc("at", "month").alias("slot"), *[(F.col(c) if c in there else F.lit(None)).cast(k).alias(c) for c, k in (("url", "string"), ("ordinal", "long"))])
    sizes = p.groupBy("slot").agg(F.ceil((F.sum(F.length("body")) + 1) / segment).cast("int").alias("parts")).withColumnRenamed("slot", "_slot")
    part = F.pmod(F.xxhash64("post_id"), F.col("parts")).cast("int")
    # one row per month: joined by key, the posts of a month would all meet in one task
    dealt = p.join(F.broadcast(sizes), p["slot"].eqNullSafe(sizes["_slot"])).select(
        "slot", part.alias("part"), "post_id", "at", "url", "ordinal",
        F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(E.RUN), F.lit(0))).alias("runs"))
    dealt.groupBy("slot", "part").applyInArrow(_segment, _SEGMENT).write.mode("append").options(**FILE_OPTIONS).parquet(path)
    return open_index(posts.sparkSession, path)


def open_index(spark, path: str) -> DataFrame:
    return spark.read.schema(_SEGMENT).parquet(path)


class _Vocabulary:
    """Finds the posts of a term in one segment."""

    def __init__(self, text: str, starts: np.ndarray, members: np.ndarray, n: int):
        self.text, self.starts, self.members, self.n = text, starts, members, n
        self.begin = None

    def posts(self, term: str) -> np.ndarray | None:
        """Bits of the posts that contain ``term``, or None where none does."""
        if self.n == 0 or term not in self.text:
            return None
        if self.begin is None:
            self.begin = np.append(0, np.cumsum(np.fromiter(map(len, self.text.split("\n")), np.int64) + 1)[:-1])
        # a hit takes the rest of its run, so the next one lies in a later run
        at = np.fromiter((m.start() for m in re.finditer(re.escape(term) + "[^\n]*", self.text)), np.int64)
        run = np.searchsorted(self.begin, at, "right") - 1
        first, size = self.starts[run].astype(np.int64), self.starts[run + 1] - self.starts[run]
        bits = np.zeros(self.n, bool)
        bits[self.members[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]] = True
        return bits


def _search(claims: list, k: int | None, need_name: bool):
    """A pass over segments; ``claims`` are (set_id, claim_id, lo, hi, terms, names, weights of the terms)."""
    terms = sorted({t for c in claims for t in (*c[4], *c[5])})
    place = {t: i for i, t in enumerate(terms)}
    asked = [([(place[t], w) for t, w in zip(c[4], c[6])], [place[t] for t in c[5]]) for c in claims]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[r]  # noqa: E731, B023
                n, at = get("n").as_py(), np.array([x if x is not None else np.iinfo(np.int64).min for x in get("at").as_py()], np.int64)
                v = _Vocabulary(get("vocabulary").as_py(), get("starts").values.to_numpy(), get("members").values.to_numpy(), n)
                rows = [v.posts(t) for t in terms]
                ids, url, ordinal = get("post_id").values, get("url").values, get("ordinal").values
                for c, (ts, ns) in zip(claims, asked):
                    have = [rows[t] * w for t, w in ts if rows[t] is not None]
                    named = [rows[t] for t in ns if rows[t] is not None]
                    if not have or need_name and ns and not named:  # no post here can have a score
                        continue
                    score = np.sum(have, 0, dtype=np.float64)
                    has_name = np.any(named, 0) if named else np.full(n, not ns)
                    ok = score > 0
                    if need_name:
                        ok &= has_name
                    if c[2] is not None:
                        ok &= (at >= c[2]) & (at <= c[3])
                    hit = np.flatnonzero(ok)
                    if k is not None and len(hit) > k:
                        hit = _best(hit, score, ordinal, url, ids, k)
                    if len(hit):
                        take = pa.array(hit)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([c[0]] * len(hit), pa.string()), pa.array([c[1]] * len(hit), pa.string()), ids.take(take),
                             pa.array(score[hit]), pa.array(has_name[hit]), url.take(take), ordinal.take(take)],
                            names=["set_id", "claim_id", "post_id", "score", "named", "url", "ordinal"])

    return run


def _best(hit: np.ndarray, score: np.ndarray, ordinal, url, ids, k: int) -> np.ndarray:
    """The best post of each of the first ``k`` addresses: by score, then the smaller ordinal, then the
    larger id, the order in which addresses are merged afterwards."""
    least = np.sort(score[hit])[::-1]
    out, seen = [], set()
    for level in np.unique(least)[::-1]:
        same = [(ordinal[i].as_py() if ordinal[i].is_valid else np.inf, ids[i].as_py(), int(i)) for i in hit[score[hit] == level].tolist()]
        same.sort(key=lambda x: x[1], reverse=True)
        same.sort(key=lambda x: x[0])
        for _, _, i in same:
            address = url[i].as_py()
            if address not in seen:
                seen.add(address)
                out.append(i)
                if len(seen) == k:
                    return np.array(out)
    return np.array(out)


def _scored(index: DataFrame, claims: DataFrame, lookback_days: int | None, first_words: int | None, k: int | None, need_name: bool) -> DataFrame:
    """(set_id, claim_id, post_id, score, named, url, ordinal) by terms of one run."""
    one_run = lambda a: F.filter(a, lambda t: F.size(F.regexp_extract_all(t, F.lit(E.RUN), F.lit(0))) == 1)
    plain = lambda a: one_run(F.filter(a, lambda t: ~t.rlike(r"\s")))
    c = claims.select("set_id", "claim_id", "as_of", E.claim_terms(first_words).alias("terms"), E.claim_aliases().alias("names"))
    names = c.groupBy("set_id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    hi = F.unix_micros("as_of")
    lo = hi - (lookback_days or 0) * 86_400_000_000
    c = c.drop("names").join(names, "set_id").select(
        "set_id", "claim_id", lo.alias("lo"), hi.alias("hi"), plain(F.col("terms")).alias("terms"), plain(F.col("names")).alias("names"), F.size("names").alias("n_names"))
    # a set whose names all have several runs has none here, but isn't free of them
    only_long = F.when((F.size("names") == 0) & (F.col("n_names") > 0), F.array(F.lit(" \n"))).otherwise(F.col("names"))
    c = c.withColumns({"names": only_long, "weights": F.transform("terms", lambda t: F.lit(1.0))})
    return _passes(index, c if lookback_days is not None else c.withColumn("lo", F.lit(None).cast("long")), k, need_name)


def _passes(index: DataFrame, requests: DataFrame, k: int | None, need_name: bool) -> DataFrame:
    """(set_id, claim_id, post_id, score, named, url, ordinal) of ``requests(set_id, claim_id, lo, hi, terms,
    names, weights)``, in batches of about ``BATCH``; a pass opens the segments of its months."""
    batches = max(1, -(-requests.count() // BATCH))
    numbered = requests if batches == 1 else cut_lineage(requests.withColumn("_b", F.pmod(F.xxhash64("set_id", "claim_id"), F.lit(batches))))
    out = None
    for b in range(batches):
        mine = (numbered if batches == 1 else numbered.filter(F.col("_b") == b)).collect()  # about BATCH rows
        rows = [(r.set_id, r.claim_id, r.lo, r.hi, list(r.terms), list(r.names), list(r.weights)) for r in mine]
        segments = index
        if rows and all(r[2] is not None for r in rows):
            since, until = (F.timestamp_micros(F.lit(x)) for x in (min(r[2] for r in rows), max(r[3] for r in rows)))
            segments = index.filter(F.col("slot").between(F.trunc(since, "month"), until.cast("date")))
        part = segments.mapInArrow(_search(rows, k, need_name), _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def _long_terms(claims: DataFrame, first_words: int | None) -> DataFrame:
    """(set_id, claim_id, as_of, term, is_name) for terms that are not one run."""
    c = claims.select("set_id", "claim_id", "as_of", E.claim_terms(first_words).alias("terms"), E.claim_aliases().alias("names"))
    t = c.select("set_id", "claim_id", "as_of", F.explode("terms").alias("term"), F.lit(False).alias("is_name"))
    n = c.select("set_id", "claim_id", "as_of", F.explode("names").alias("term"), F.lit(True).alias("is_name"))
    runs = F.regexp_extract_all("term", F.lit(E.RUN), F.lit(0))
    return t.unionByName(n).filter((F.size(runs) != 1) | F.col("term").rlike(r"\s"))


def evidence_scores(index: DataFrame, claims: DataFrame, posts: DataFrame | None = None, lookback_days: int | None = 120,
                    first_words: int | None = 8, k: int | None = None) -> DataFrame:
    """J20 from the index: the rows of ``evidence.evidence_scores``, with url and ordinal of each post; with
    ``k`` only what the best ``k`` addresses of each claim may need (L4). ``posts(post_id, body, at, url,
    ordinal)`` are read only if a term has several runs."""
    long = _long_terms(claims, first_words)
    if long.isEmpty():
        return _scored(index, claims, lookback_days, first_words, k, True).drop("named")
    if posts is None:
        raise ValueError("terms of several runs need the posts")
    short = _scored(index, claims, lookback_days, first_words, None, False)
    p = posts.select("post_id", "at", *[(F.col(c) if c in posts.columns else F.lit(None)).cast(t).alias(c) for c, t in (("url", "string"), ("ordinal", "long"))])
    hits = long.join(E.contained_terms(posts, long.select("term")), "term").join(p, "post_id")
    if lookback_days is not None:
        hits = hits.filter((F.col("at") <= F.col("as_of")) & (F.col("at") >= F.col("as_of") - F.make_dt_interval(F.lit(lookback_days))))
    # a name of the set counts for each of its claims
    own = hits.filter("not is_name").select("set_id", "claim_id", "post_id", F.lit(1.0).alias("score"), F.lit(False).alias("named"), "url", "ordinal")
    by_name = hits.filter("is_name").select("set_id", "post_id").distinct()
    both = short.unionByName(own).groupBy("set_id", "claim_id", "post_id").agg(
        F.sum("score").alias("score"), F.max("named").alias("named"), F.max("url").alias("url"), F.max("ordinal").alias("ordinal"))
    named = both.filter("named").unionByName(both.filter("not named").join(by_name, ["set_id", "post_id"], "left_semi").select(*both.columns))
    return named.drop("named")


def relevance_scan(index: DataFrame, requests: DataFrame, posts: DataFrame, *, before_days: int, after_days: int = 0, **options) -> DataFrame:
    """J21/L5 from the index: the rows of ``evidence.relevance_scan``. Texts are read only for aliases and
    keywords of several runs; of ``posts`` else the platform and time."""
    terms = E.weighted_terms(requests)
    long = (F.size(F.regexp_extract_all("term", F.lit(E.RUN), F.lit(0))) != 1) | F.col("term").rlike(r"\s")
    at = F.unix_micros("at")
    short = terms.filter(~long).groupBy("ref_id").agg(F.collect_list(F.struct("term", "w")).alias("t"))
    asked = requests.join(short, "ref_id").select(
        F.col("ref_id").alias("set_id"), F.lit("").alias("claim_id"), (at - before_days * 86_400_000_000).alias("lo"), (at + after_days * 86_400_000_000).alias("hi"),
        F.col("t.term").alias("terms"), F.array().cast("array<string>").alias("names"), F.col("t.w").alias("weights"))
    hits = _passes(index, asked, None, False).select(F.col("set_id").alias("ref_id"), "post_id", F.col("score").alias("hit_score"))
    several = terms.filter(long)
    if not several.isEmpty():
        more = several.join(E.contained_terms(posts, several), "term").groupBy("ref_id", "post_id").agg(F.sum("w").alias("hit_score"))
        hits = hits.unionByName(more).groupBy("ref_id", "post_id").agg(F.sum("hit_score").alias("hit_score"))
    return E.relevance_scan(requests, posts, before_days=before_days, after_days=after_days, hits=hits, **options)


def evidence_map(index: DataFrame, claims: DataFrame, posts: DataFrame, k: int = 3, lookback_days: int | None = 120) -> DataFrame:
    """L4/C4 from the index: (claim_id, post_id, url, score, rank): the claim's own post first, then the best
    posts, one per address. ``posts(post_id, body, at, url, ordinal)`` give the address of own posts."""
    own = claims.select("claim_id", F.col("set_id").cast("string").alias("post_id")).distinct()
    s = evidence_scores(index, claims, posts, lookback_days, k=k + 1)  # the own post may be among the best
    s = s.select("claim_id", "post_id", "url", "ordinal", "score", F.lit(0).alias("forced"))
    at = posts.select("post_id", "url", "ordinal")
    s = s.unionByName(own.join(at, "post_id").select("claim_id", "post_id", "url", "ordinal", F.lit(0.0).alias("score"), F.lit(1).alias("forced")))
    best = F.struct("forced", "score", (-F.col("ordinal")).alias("o"), "post_id")
    one = s.groupBy("claim_id", "url").agg(F.max(best).alias("b")).select("claim_id", "url", "b.*")
    w = W.partitionBy("claim_id").orderBy(F.desc("forced"), F.desc("score"), F.desc("o"), "post_id")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("o")


def evidence_snippets(index: DataFrame, claims: DataFrame, posts: DataFrame, k: int = 3, lookback_days: int | None = 120) -> DataFrame:
    """C4 from the index: the rows of ``evidence.evidence_map``. ``posts(post_id, title, text, url, platform,
    at, ordinal)`` give the texts of the few rows that are ranked, which are stored first."""
    p = posts.withColumn("body", E.post_body())
    return E.with_snippets(stored(evidence_map(index, claims, p, k, lookback_days), "evidence"), claims, p)


def scratch_index(posts: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """An index in a fresh folder under the shared checkpoint folder."""
    import uuid

    return build(posts, f"{checkpoint_dir(posts.sparkSession)}/postings-{uuid.uuid4().hex}", segment)
