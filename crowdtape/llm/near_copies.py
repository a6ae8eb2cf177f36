"""Near copies by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles (lower-cased A-Z): a shingle weighs its term
frequency times the mean inverse document frequency of its words. Words' document frequencies are
counted over all documents, in 2**18 hash buckets, so the table has a fixed size whatever the corpus.
(A shingle's own frequency is 1 nearly everywhere, and within a large group of copies it would weigh down
just what the copies share; its words' frequencies do neither.)

Improved consistent weighted sampling draws 48 samples (shingle, level) from each set; two sets agree in
a sample with the probability of their weighted Jaccard similarity. Four samples make a band, and
documents that share one of twelve bands are candidates: a pair of similarity 0.8 is missed with
probability 0.002, one of 0.9 with 0.00002. Candidates are verified by their exact weighted Jaccard
similarity, and classes are the connected components of verified links.

Scale: texts with the same words are one node, so copies cost nothing beyond their first. The members of
a bucket meet in the group of its smallest node. Up to ``CHUNK`` members are linked completely in one
task (union-find, pruned by size and by the triangle inequality). A larger group is dealt over chunks that
all hold the leader; what a chunk can't connect to the leader, and every member near enough to be its
partner, is then compared block against block: no link is given up, and no list of pairs is made.

Texts with fewer than five words are one shingle of what they have. Texts without words (null, empty,
blank) are equal to each other. Null ids, repeated rows and repeated ids are kept; of each class the row
with the smallest id stays (one of them, if several share it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, query, read, renamed, restored, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
WORD_BUCKETS = 1 << 18
CHUNK = 512
SEED = 11

_U = np.uint64
_STEPS = 1024  # shingles that are sampled at a time: their tables fit the cache


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PLACE = _mix(np.arange(1, SHINGLE + 1, dtype=_U)) | _U(1)


class _WordHashes(dict):
    """64-bit hashes of words; what has been hashed is remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


_hashes = _WordHashes()


def split_words(text: bytes | None) -> list[bytes]:
    """bytes.split() cuts at exactly the blank and the controls from tab to carriage return."""
    return (text or b"").lower().split()


def hashed(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, ws), _U, len(ws))


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> _U(46)).astype(np.int64)


def weighted_set(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order, and their weights."""
    n = min(SHINGLE, len(h))
    if not n:
        return np.empty(0, _U), np.empty(0, np.float32)
    m = len(h) - n + 1
    word = idf[buckets(h)]
    s, weight = np.zeros(m, _U), np.zeros(m, np.float32)
    for j in range(n):
        s += h[j:j + m] * _PLACE[j]
        weight += word[j:j + m]
    s, first, count = np.unique(_mix(s), return_index=True, return_counts=True)
    return s, (weight[first] / np.float32(n) * count).astype(np.float32)


class Sampler:
    """Draws of improved consistent weighted sampling. A hash of (shingle, sample) picks the two gamma
    variates and the uniform one from fixed tables, so that equal shingles draw alike everywhere."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        u = lambda: 1.0 - rng.random(1 << 16)  # noqa: E731  in (0, 1]
        gamma = lambda: np.maximum(-np.log(u() * u()), 1e-4)  # noqa: E731  of shape 2
        self.r = gamma().astype(np.float32)
        self.per_r = (1.0 / self.r.astype(np.float64)).astype(np.float32)
        self.log_c = np.log(gamma()).astype(np.float32)
        self.beta = rng.random(1 << 16).astype(np.float32)
        self.keys = _mix(np.arange(1, samples + 1, dtype=_U) + _U(seed * 1_000_003))

    def draw(self, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One hash per sample, of the chosen shingle and its level."""
        n, every = len(self.keys), np.arange(len(self.keys))
        best, chosen, level = np.full(n, np.inf, np.float32), np.zeros(n, _U), np.zeros(n, np.float32)
        log_w = np.log(weight)
        steps = min(_STEPS, len(s))
        hashes, shifted = np.empty((steps, n), _U), np.empty((steps, n), _U)
        for a in range(0, len(s), steps):
            part = s[a:a + steps]
            x, y = hashes[:len(part)], shifted[:len(part)]
            np.bitwise_xor(part[:, None], self.keys[None, :], out=x)
            x *= _U(0x9E3779B97F4A7C15)
            x ^= np.right_shift(x, _U(29), out=y)
            x *= _U(0xBF58476D1CE4E5B9)
            x ^= np.right_shift(x, _U(32), out=y)
            picks = x.view(np.uint16).reshape(len(part), n, 4)  # four picks from the tables in each hash
            at_r, beta = picks[..., 0], self.beta.take(picks[..., 1])
            t = self.per_r.take(at_r)
            t *= log_w[a:a + steps, None]
            t += beta
            np.floor(t, out=t)
            down = np.subtract(t, beta, out=beta)
            down += np.float32(1)
            down *= self.r.take(at_r)
            log_a = self.log_c.take(picks[..., 2])
            log_a -= down
            at = log_a.argmin(axis=0)
            value = log_a[at, every]
            better = np.flatnonzero(value < best)
            best[better], chosen[better], level[better] = value[better], part[at[better]], t[at[better], better]
        return _mix(chosen + level.astype(np.int64).view(_U) * _U(0xD6E8FEB86659FD93))

    def bands(self, s: np.ndarray, weight: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """One hash per band, different for each band."""
        drawn = self.draw(s, weight).reshape(-1, rows)
        key = np.arange(1, len(drawn) + 1, dtype=_U)
        for j in range(rows):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + drawn[:, j])
        return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of the lesser weights over sum of the greater ones."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0]
    low = float(np.minimum(a[1][at[hit]], b[1][hit]).sum(dtype=np.float64))
    return low / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - low)


def linked(sets: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> tuple[list[int], list[float]]:
    """Component root (an index) of each set under similarity >= least, and distances to the first set.

    All pairs are decided, though few are computed: those already connected, of too different total
    weight, or too far apart by their distances to the first set (the distance 1 - similarity obeys the
    triangle inequality) need no look at their shingles."""
    n, far = len(sets), 1.0 - least + 1e-9
    total = np.array([s[1].sum(dtype=np.float64) for s in sets])
    pivot = np.array([0.0] + [1.0 - similarity(sets[0], s) for s in sets[1:]])
    root = np.arange(n)
    for i in range(n):
        near = np.flatnonzero((np.abs(pivot[:i] - pivot[i]) <= far) & (np.minimum(total[:i], total[i]) >= (least - 1e-9) * np.maximum(total[:i], total[i])))
        for j in near[np.argsort(pivot[near], kind="stable")]:
            if root[i] != root[j] and similarity(sets[i], sets[j]) >= least:
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
    return root.tolist(), pivot.tolist()


def word_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequency per word bucket; a table of WORD_BUCKETS numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(WORD_BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                n += 1
                found[np.unique(buckets(hashed(split_words(text))))] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(WORD_BUCKETS)
    n = int(rows.loc[rows.bucket < 0, "n"].sum())
    rows = rows[rows.bucket >= 0]
    df[rows.bucket.to_numpy(np.int64)] = rows.n.to_numpy(np.float64)
    return (1.0 + np.log((n + 1.0) / (np.minimum(df, n) + 1.0))).astype(np.float32), n


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, text_key, words_key, bands); words_key is a 128-bit hash of the word sequence."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, table = Sampler(), idf.value
        for batch in batches:
            keys, bands = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                ws = split_words(text)
                keys.append(hashlib.blake2b(b" ".join(ws), digest_size=16).digest())
                bands.append(sampler.bands(*weighted_set(hashed(ws), table)) if ws else np.empty(0, np.int64))
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in bands])), pa.int32())
            values = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "text_key", "words_key", "bands"])

    return docs.mapInArrow(sign, "doc_id long, text_key long, words_key binary, bands array<long>")


def _verified(groups: DataFrame, key: list[str], idf) -> DataFrame:
    """Links inside each group: (leader, node, root, from_leader). The leader comes first if it is there."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_first=pdf.node != pdf.leader).sort_values(["_first", "node"])
        sets = [weighted_set(hashed(split_words(bytes(t))), idf.value) for t in pdf.text]
        root, pivot = linked(sets)
        node = pdf.node.to_numpy()
        least: dict[int, int] = {}
        for x, r in zip(node.tolist(), root):
            least[r] = min(x, least.get(r, x))
        return pd.DataFrame({"leader": pdf.leader.to_numpy(), "node": node, "root": [least[r] for r in root],
                             "with_leader": [r == root[0] for r in root], "from_leader": pivot})

    # small in bytes, long in computing: keep the groups apart over all partitions
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(parts, *key).groupBy(*key).applyInPandas(link, "leader long, node long, root long, with_leader boolean, from_leader double")


def _texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``members`` with the text of their node, by one merge join at every size."""
    m = members.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    both = docs.join(m.hint("merge"), docs["doc_id"].eqNullSafe(m["_id"]) & (docs["text_key"] == m["_key"]))
    return both.select(*[c for c in members.columns if c not in ("doc_id", "text_key")], F.encode("text", "utf-8").alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component. Labels flow along edges and through
    labels of labels, so the rounds grow with the logarithm of a component's diameter."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = stored(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.join(heard.withColumnRenamed("a", "node").hint("merge"), "node").select(
            "node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        new = stored(new, "near-labels")
        up = new.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(new.join(up.hint("merge"), "label").select("node", "was", F.least("label", "up").alias("label")), "near-labels")
        labels = new.select("node", "label")
        if new.filter("was <> label").isEmpty():
            return labels


def near_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_key, class_id, class_size, kept) for every row; ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    arrow_rows(spark)
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", F.xxhash64(body).alias("text_key"), body.alias("text"))
    idf = spark.sparkContext.broadcast(word_frequencies(docs)[0])
    rows = stored(signatures(docs, idf), "near-rows")
    nodes = stored(rows.groupBy("words_key").agg(F.min(F.struct("doc_id", "text_key")).alias("m")).select(
        "words_key", "m.*", F.monotonically_increasing_id().alias("node")), "near-nodes")

    # buckets, by their smallest node
    n = nodes.select("node", F.col("words_key").alias("_w"), F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"))
    lead = rows.join(n.hint("merge"), (rows["words_key"] == n["_w"]) & rows["doc_id"].eqNullSafe(n["_d"]) & (rows["text_key"] == n["_t"]))
    keyed = stored(lead.select("node", F.explode("bands").alias("band")), "near-bands")
    found = stored(keyed.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).filter("leader < _last").select("band", "leader"), "near-buckets")
    members = stored(keyed.join(found.hint("merge"), "band").select("leader", "node").distinct(), "near-members")
    sizes = stored(members.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).select(
        "leader", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "near-sizes")
    dealt = members.join(sizes.hint("merge"), "leader")
    place = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    dealt = dealt.select("leader", "node", "chunks", F.explode(place).alias("chunk"))
    # all documents are shuffled once for the texts that are in a bucket; both rounds of comparison read those
    ids = nodes.select("node", "doc_id", "text_key")
    texts = stored(_texts(members.select("node").distinct().join(ids.hint("merge"), "node"), docs), "near-texts")
    local = stored(_verified(dealt.select("leader", "chunk", "node").join(texts.hint("merge"), "node"), ["leader", "chunk"], idf), "near-links")

    # groups of several chunks: what isn't with the leader meets all that may be its partner
    several = local.join(sizes.filter("chunks > 1").select("leader").hint("merge"), "leader")
    apart = stored(several.filter("NOT with_leader").groupBy("leader").agg(F.min("from_leader").alias("nearest")), "near-apart")
    rest = several.join(apart.hint("merge"), "leader").filter(~F.col("with_leader") | (F.col("from_leader") >= F.col("nearest") - (1 - SIMILARITY + 1e-6)))
    rest = rest.select("leader", "node").distinct()
    counts = rest.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("blocks"))
    rest = stored(rest.join(counts.hint("merge"), "leader").select("leader", "node", "blocks", F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col("blocks")).cast("int").alias("own")), "near-rest")
    edges = local.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not rest.isEmpty():
        pairs = rest.select("leader", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
            "leader", "node", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
        more = stored(_verified(pairs.join(texts.hint("merge"), "node"), ["leader", "one", "two"], idf), "near-links")
        edges = edges.unionByName(more.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))

    labels = components(edges)
    placed = nodes.join(labels.hint("merge"), "node", "left").select("words_key", F.coalesce("label", "node").alias("class"))
    out = stored(rows.select("doc_id", "text_key", "words_key").join(stored(placed, "near-placed").hint("merge"), "words_key").select(
        "doc_id", "text_key", "class", F.monotonically_increasing_id().alias("_row")), "near-classes")
    classes = stored(out.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "near-class")
    out = stored(out.join(classes.hint("merge"), "class"), "near-out")
    stays = out.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("_row").alias("_row"))
    return out.join(stays.select("_row", F.lit(True).alias("_stays")).hint("merge"), "_row", "left").select(
        "doc_id", "text_key", "class_id", "class_size", F.coalesce("_stays", F.lit(False)).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class."""
    stay = near_copies(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    df, to = renamed(docs)
    df = df.withColumn("_text_key", F.xxhash64(F.coalesce(F.col(to["text"]), F.lit(""))))
    kept = df.join(stay, df[to["doc_id"]].eqNullSafe(stay["_id"]) & (df["_text_key"] == stay["_key"]), "left_semi")
    return restored(kept.dropDuplicates([to["doc_id"], "_text_key"]), to)


@query("op6_near_copies")
def op6_near_copies(spark, sf_dir):
    """One row per document with its class: class_id is the smallest doc_id of the class."""
    return near_copies(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", "kept")
