"""Jaccard join of five-word shingle sets by R-trees over count vectors.

A document is the set of its distinct five-word shingles (lower-cased A-Z, hashed to 64 bits); with fewer
words the whole sequence is its one shingle; without words it is empty and linked with nothing. Two
documents link when 100 times their intersection is at least 80 times their union. The result is each
document's set size and the smallest id that it reaches by links.

Shingles are hashed into groups, and the counts per group are a point. No two sets share more than the sum
of their points' coordinate minima, so R-trees over the points (boxes with the coordinate maxima and the
totals of what is below) leave out subtree against subtree; pairs that the bound can't exclude are verified
on the sets. The groups grow with the set (about two shingles a group), else the bound would tell nothing
of long texts; points of neighbouring classes meet by folding the finer one.

One tree over everything would not help at scale: the boxes of its upper levels overlap whatever the
packing, so all leaves would meet. The top level is therefore a lossless routing. Sets that link share at
least one of the first n - ceil(0.8 n) + 1 shingles of any common order; the order here is by hash, with
frequent shingles last (counted in 2**18 buckets over all documents: a fixed size, and a wrong guess costs
time only). Sets that share such a shingle meet in the group of the smallest set that has it.

Work and bounds: equal sets are one node, so copies cost nothing more. First each node meets only the
smallest set that it shares a shingle with: points whose bound reaches a link are verified on the texts, and
what links is one component. Groups that still hold several components are searched by trees of points,
block by block: at most ``CHUNK`` nodes of similar size a block, and no block meets one of its own component.
A round lets each node through with its first few partners (256 times as many in the next), verifies
those, and joins components; rounds go on until nothing had to wait, so no link is given up, and large
groups settle without a list of all their pairs. Points hold a twelfth of a text's bytes; texts are fetched
for candidates only, after a bit map of fixed size has left out most others.

Two different sets would be taken for one with the chance of a 64-bit collision (10**-3 for 2*10**8
different texts). Null ids, repeated ids and repeated rows are kept, each a row of the result; a component
without any id has none. Null texts are empty; an empty document's component is itself. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, query, read, stored
from .near_copies import _mix, components, split_words

SHINGLE = 5
CHUNK = 512
LEAF = 16
PER_GROUP = 2
LEAST_GROUPS = 16
BUCKETS = 1 << 18
FREQUENT = 4.0
REMEMBERED = 200_000
PARTNERS = 3
BITS = 1 << 25

_U = np.uint64
_PLACE = _mix(np.arange(101, 101 + SHINGLE, dtype=_U)) | _U(1)


class _WordHashes(dict):
    """64-bit hashes of words; what has been hashed is remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


# ---- sets, points and trees -------------------------------------------------------------------------
def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the text's shingles, one per place."""
    ws = split_words(text)
    h = np.fromiter(map(_hashes.__getitem__, ws), _U, len(ws))
    n = min(SHINGLE, len(h))
    if not n:
        return np.empty(0, _U)
    s = np.zeros(len(h) - n + 1, _U)
    for j in range(n):
        s += h[j:j + len(s)] * _PLACE[j]
    return _mix(s + _U(n))


def bucket(s: np.ndarray) -> np.ndarray:
    return (s & _U(BUCKETS - 1)).astype(np.int64)


def routing(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the common order, those in frequent buckets apart; of sets that link, at least
    one is the same."""
    most = len(s) - (4 * len(s) + 4) // 5 + 1
    late = frequent[bucket(s)]
    first = s[~late][:most]
    return first, s[late][:most - len(first)]


def groups_for(n: int) -> int:
    g = LEAST_GROUPS
    while g * PER_GROUP < n:
        g *= 2
    return g


def point(s: np.ndarray) -> np.ndarray:
    """Counts per group."""
    g = groups_for(len(s))
    return np.bincount(((s >> _U(20)) & _U(g - 1)).astype(np.int64), minlength=g).astype(np.int32)


def packed(p: np.ndarray) -> bytes:
    """A point as its smallest counts allow: one, two or four bytes a group."""
    return p.astype(next(k for k in ("u1", "<u2", "<u4") if p.max() <= np.iinfo(k).max)).tobytes()


def unpacked(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, {1: "u1", 2: "<u2", 4: "<u4"}[len(b) // groups_for(n)]).astype(np.int32)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    return p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.int32)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return 9 * int((a[at] == b).sum()) >= 4 * (len(a) + len(b))


class Tree:
    """R-tree over points: a node's box is what the bound needs, the coordinate maxima and least total."""

    __slots__ = ("at", "below", "high", "least", "own")

    def __init__(self, at: np.ndarray, points: np.ndarray, totals: np.ndarray, label: np.ndarray):
        self.at, self.below = at, ()
        self.high, self.least = points[at].max(0), int(totals[at].min())
        own = label[at]
        self.own = own[0] if (own == own[0]).all() else None  # the one component below
        if len(at) > LEAF:
            spread = points[at].max(0) - points[at].min(0)
            by = totals[at] if np.ptp(totals[at]) >= spread.max() * 4 else points[at, spread.argmax()]
            order = at[np.argsort(by, kind="stable")]
            self.below = tuple(Tree(part, points, totals, label) for part in np.array_split(order, 2))


def tree_pairs(a: Tree, b: Tree, pa_: np.ndarray, pb: np.ndarray, ta: np.ndarray, tb: np.ndarray, la: np.ndarray, lb: np.ndarray) -> Iterator[tuple[int, int]]:
    """Indices of pairs of different labels that the bound doesn't exclude; of a tree with itself, each once."""
    self_join, todo = a is b, [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.own is not None and x.own == y.own:
            continue
        if 9 * int(np.minimum(x.high, y.high).sum()) < 4 * (x.least + y.least):
            continue
        if not x.below and not y.below:
            over = np.minimum(pa_[x.at][:, None, :], pb[y.at][None, :, :]).sum(2, dtype=np.int64)
            fits = (9 * over >= 4 * (ta[x.at][:, None] + tb[y.at][None, :])) & (la[x.at][:, None] != lb[y.at][None, :])
            for i, j in zip(*np.nonzero(fits)):
                p, q = int(x.at[i]), int(y.at[j])
                if not self_join or x is not y or p < q:
                    yield p, q
        elif x is y:
            one, two = x.below
            todo += [(one, one), (one, two), (two, two)]
        elif len(x.at) >= len(y.at) and x.below:
            todo += [(z, y) for z in x.below]
        else:
            todo += [(x, z) for z in y.below]


def candidates(points: list[np.ndarray], totals: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of different labels whose bound reaches a link: one tree per class of sizes, each searched
    with itself and, folded, with the next."""
    of: dict[int, list[int]] = {}
    for i, p in enumerate(points):
        of.setdefault(len(p), []).append(i)

    def tree(groups: int, ids: list[int]):
        p, t, own = np.array([folded(points[i], groups) for i in ids]), totals[ids], label[ids]
        return Tree(np.arange(len(ids)), p, t, own), p, t, own

    for groups, ids in of.items():
        a, pa_, ta, la = tree(groups, ids)
        for i, j in tree_pairs(a, a, pa_, pa_, ta, ta, la, la):
            yield ids[i], ids[j]
        if more := of.get(2 * groups):
            b, pb, tb, lb = tree(groups, more)
            for i, j in tree_pairs(a, b, pa_, pb, ta, tb, la, lb):
                yield ids[i], more[j]


def near_first(points: list[np.ndarray], totals: np.ndarray) -> list[int]:
    """Which of the other points may link to the first."""
    out = []
    for i in range(1, len(points)):
        g = min(len(points[0]), len(points[i]))
        over = int(np.minimum(folded(points[0], g), folded(points[i], g)).sum())
        if 9 * over >= 4 * int(totals[0] + totals[i]):
            out.append(i)
    return out


# ---- the join ---------------------------------------------------------------------------------------
def frequent_buckets(docs: DataFrame) -> np.ndarray:
    """Which buckets hold a frequent shingle: a fixed number of counts, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            all_of = [shingles(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            found += np.bincount(bucket(np.concatenate([*all_of, np.empty(0, _U)])), minlength=BUCKETS)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(BUCKETS, np.int64)
    n[rows.bucket.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return n > n.mean() + FREQUENT * np.sqrt(n.mean()) + 8.0  # beyond what chance puts into a bucket


def described(docs: DataFrame, frequent) -> DataFrame:
    """(doc_id, text_key, n, node, first, late, point) of every row; a task tells of equal sets once what
    only the set's node needs (its routing shingles, rare ones and frequent ones, and its point)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, told = frequent.value, set()
        for batch in batches:
            size, node, first, rest, points = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = np.unique(shingles(text))
                key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None
                new = len(s) > 0 and key not in told
                if new:
                    if len(told) >= REMEMBERED:
                        told.clear()
                    told.add(key)
                size.append(len(s))
                node.append(key)
                one, two = routing(s, late) if new else (None, None)
                first.append(one.view(np.int64) if new else None)
                rest.append(two.view(np.int64) if new else None)
                points.append(packed(point(s)) if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
                 pa.array(first, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                names=["doc_id", "text_key", "n", "node", "first", "late", "point"])

    return docs.mapInArrow(describe, "doc_id long, text_key long, n long, node long, first array<long>, late array<long>, point binary")


def by_group(df: DataFrame, key: list[str], fn, schema: str) -> DataFrame:
    """Rows of longs that ``fn`` yields for each group, from its columns. Groups are small and many: they are
    dealt over all partitions, come sorted, and are cut out of Arrow batches without a frame for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            t = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if t is None or not t.num_rows:
                continue
            keys = [t[c].to_numpy() for c in key]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if batch is None:
                ends, held = np.append(ends, t.num_rows), None
            else:
                held = t.slice(int(ends[-1])) if len(ends) else t
            rows, columns = [], {c: t[c].to_pylist() if pa.types.is_binary(t[c].type) else t[c].to_numpy() for c in t.column_names} if len(ends) else {}
            for x, y in zip(np.append(0, ends[:-1]), ends):
                rows += fn({c: v[x:y] for c, v in columns.items()})
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64)) for v in zip(*rows)], names=names)

    names = [f.split()[0] for f in schema.split(",")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def groups_met(rows: DataFrame) -> DataFrame:
    """(leader, node): every node with the smallest node that it shares a routing shingle with, for each
    shingle. Rare shingles take one exchange; frequent ones, where a shingle may be in a third of all sets,
    are aggregated first and joined by a merge join that is split at run time."""
    least = [F.min("node").alias("leader"), F.max("node").alias("_last")]
    rare = rows.filter("first is not null").select("node", F.explode("first").alias("shingle")).repartition("shingle")
    often = rows.filter("late is not null").select("node", F.explode("late").alias("shingle"))
    met = [x.join(x.groupBy("shingle").agg(*least).filter("leader < _last").hint("merge"), "shingle").select("leader", "node") for x in (rare, often)]
    return stored(met[0].unionByName(met[1]).distinct(), "tree-members")


def near_leader(members: DataFrame, points: DataFrame, chunk: int) -> DataFrame:
    """(a, b): the smallest set that node b shares a shingle with, where the points allow a link."""
    own = members.groupBy("node").agg(F.min("leader").alias("leader")).filter("node <> leader")
    chunks = own.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    dealt = own.join(chunks.hint("merge"), "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    leaders = chunks.select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    met = dealt.unionByName(leaders).join(points.hint("merge"), "node")

    def near(g: dict) -> list[tuple]:
        order = np.argsort(g["node"] != g["leader"], kind="stable")
        found = near_first([unpacked(g["point"][i], g["n"][i]) for i in order], g["n"][order])
        return [(g["leader"][0], g["node"][order[i]]) for i in found]

    return by_group(met, ["leader", "chunk"], near, "a long, b long")


def texts_of(nodes: DataFrame, where: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of ``nodes``. ``where`` tells a row of each node; a bit map of ``BITS`` bits leaves out most
    other rows before texts move (when it is full it leaves out none)."""
    asked = nodes.distinct().join(where.hint("merge"), "node")
    asked = stored(asked.select("node", "_id", "_key", F.pmod(F.xxhash64("_id", "_key"), F.lit(BITS)).alias("_bit")), "tree-asked")
    place = F.col("_bit") + 1  # the built-in maps count places from 1
    maps = asked.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in maps.collect():  # at most 1,024 rows of 4 kB
        bits[r["at"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    there = docs.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.pandas_udf("boolean")
    def may_be(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy()
        return pd.Series(((there.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1) > 0)

    some = docs.filter(may_be(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(BITS))))
    here = some["doc_id"].eqNullSafe(asked["_id"]) & (some["text_key"] == asked["_key"])
    return some.join(asked.hint("merge"), here).select("node", F.encode("text", "utf-8").alias("text")).dropDuplicates(["node"])


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(leader, node, label) of the groups that still hold several components."""
    known = members.join(labels.hint("merge"), "node", "left").select("leader", "node", F.coalesce("label", "node").alias("label"))
    known = stored(known, "tree-known")
    several = known.groupBy("leader").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a < _b").select("leader")
    return stored(known.join(several.hint("merge"), "leader"), "tree-unsettled")


def blocks_met(rest: DataFrame, points: DataFrame, chunk: int) -> DataFrame:
    """(one, two, block, label, node, n, point): blocks that have to meet. A group that fits is one block;
    else blocks hold nodes of one class of sizes, and of one component where that is large. Points come last."""
    r = rest.join(points.select("node", "n").hint("merge"), "node")
    sizes = rest.groupBy("leader").agg(F.count(F.lit(1)).alias("_size"))
    sides = rest.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("_same"))
    large = F.col("_size") > chunk
    r = r.join(sizes.hint("merge"), "leader").join(sides.hint("merge"), ["leader", "label"])
    r = r.withColumn("band", F.when(large, F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9)).otherwise(0))
    r = r.withColumn("side", F.when(large & (F.col("_same") > chunk // 2), F.col("label"))).withColumn("_sided", F.col("side").isNotNull())
    key = ["leader", "_sided", "side", "band"]
    r = stored(r.select(*key, "node", "label"), "tree-rest")
    parts = r.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    blocks = stored(parts.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts").withColumn(
        "block", F.monotonically_increasing_id()), "tree-blocks")
    same = F.col("x._sided").eqNullSafe(F.col("y._sided")) & F.col("x.side").eqNullSafe(F.col("y.side"))
    near = blocks.select("leader", "_sided", "side", "block", F.explode(F.array("band", F.col("band") - 1, F.col("band") + 1)).alias("band"))
    # both directions of a pair come up; the smaller block number is the first
    pairs = blocks.alias("x").join(near.alias("y").hint("merge"), (F.col("x.leader") == F.col("y.leader")) & (F.col("x.band") == F.col("y.band")))
    pairs = pairs.filter((F.col("x.block") <= F.col("y.block")) & ~(same & F.col("x._sided"))).select(F.col("x.block").alias("one"), F.col("y.block").alias("two"))
    pairs = stored(pairs, "tree-block-pairs")
    at = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    inside = [r[k].eqNullSafe(blocks[k]) for k in key]
    cond = inside[0] & inside[1] & inside[2] & inside[3] & (blocks["part"] == at)
    placed = stored(r.join(blocks.hint("merge"), cond).select("block", "node", "label"), "tree-placed")
    first = pairs.withColumn("block", F.col("one"))
    second = pairs.filter("one <> two").withColumn("block", F.col("two"))
    return first.unionByName(second).join(placed.hint("merge"), "block").join(points.hint("merge"), "node").select("one", "two", "block", "label", "node", "n", "point")


def tree_search(met: DataFrame, partners: int) -> DataFrame:
    """(a, b, waits): pairs of different components that the trees let through, while one of the two has
    fewer than ``partners``; one more row with ``waits`` where others have to wait."""

    def search(g: dict) -> list[tuple]:
        node, block, apart = g["node"].tolist(), g["block"], g["one"][0] != g["two"][0]
        met_so_far, found, waits = [0] * len(node), [], False
        for i, j in candidates([unpacked(p, n) for p, n in zip(g["point"], g["n"])], g["n"], g["label"]):
            if apart and block[i] == block[j]:
                continue
            if met_so_far[i] >= partners and met_so_far[j] >= partners:
                waits = True
                continue
            met_so_far[i] += 1
            met_so_far[j] += 1
            found.append((*sorted((node[i], node[j])), 0))
        return found + [(0, 0, 1)] * waits

    return by_group(met, ["one", "two"], search, "a long, b long, waits long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, chunk: int) -> DataFrame:
    """The pairs (a, b) that link."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    dealt = pairs.join(chunks.hint("merge"), "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
    firsts = chunks.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def link(g: dict) -> list[tuple]:
        first, sets = g["a"][0], {}
        for b, t in zip(g["node"].tolist(), g["text"]):
            sets[b] = np.unique(shingles(t))
        one = sets.pop(int(first))
        return [(first, b) for b, s in sets.items() if links(one, s)]

    return by_group(dealt.unionByName(firsts).join(texts.hint("merge"), "node"), ["a", "chunk"], link, "a long, b long")


def jaccard_components(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    arrow_rows(spark)
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_buckets(docs))
    rows = stored(described(docs, frequent), "tree-rows")

    members = groups_met(rows)
    asked = members.select("node").distinct()
    some = rows.filter("node is not null").join(asked.hint("merge"), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("of"), F.max("n").alias("n"), F.max("point").alias("point"))
    some = stored(some.select("node", "n", "point", F.col("of.doc_id").alias("_id"), F.col("of.text_key").alias("_key")), "tree-points")
    points, where = some.select("node", "n", "point"), some.select("node", "_id", "_key")

    def checked(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), where, docs)
        return stored(verified(pairs, stored(texts, "tree-texts"), chunk), "tree-links")

    decided = stored(near_leader(members, points, chunk), "tree-near")
    edges, partners = checked(decided), PARTNERS
    labels = components(edges)
    while not (rest := unsettled(members, labels)).isEmpty():
        found = stored(tree_search(blocks_met(rest, points, chunk), partners), "tree-pairs")
        pairs = stored(found.filter("waits = 0").select("a", "b").join(decided.hint("merge"), ["a", "b"], "left_anti"), "tree-new-pairs")
        if not pairs.isEmpty():
            edges, decided = edges.unionByName(checked(pairs)), decided.unionByName(pairs)
            labels = components(edges)
        if found.filter("waits = 1").isEmpty():
            break
        partners *= 256

    # equal sets are of one component; its smallest id is the component's
    least = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    least = stored(least.join(labels.hint("merge"), "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label")), "tree-nodes")
    ids = least.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = stored(least.join(ids.hint("merge"), "label").select("node", "component_id"), "tree-ids")
    out = rows.select("doc_id", "n", "node").join(ids.hint("merge"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@query("op12_count_tree")
def op12_count_tree(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))
