"""Prefix trie of conversations by whole-sequence collapse.

Every conversation is rebuilt: the first h turns of the conversation that opens its block of ids, then its
own turns after its first h. Equal rebuilt conversations collapse into one weighted sequence with the list
of those that end there. Sequences that are proper prefixes of others go out by an anti-join; what stays
are the leaves. Nodes are the weighted prefixes of the sequences, aggregated by prefix.

A prefix is named by the sum of its turns' SHA-256 digests (of place, role and text, in six 32-bit parts),
so prefixes need running sums only, no list of a conversation's turns. A subtree's total would ask every
node to visit all its ancestors; instead each node is owned by one leaf below it, a leaf's sequence carries
the totals of the nodes it owns from its end to its start, and a node sums what its leaves carry there. So
the work grows with the turns of the distinct sequences, whatever the depth.

Scale: numbering and running sums go by blocks of 1,024 turn numbers or places (turns that all share one
number are one block), first turns shared by many conversations only meet partial aggregates and merge joins
that are split at run time. The ids that end at one node are joined per block of 4,096 ids first; the last
step, as the contract hashes them as one text, holds them in one row.

Turns run by turn number (null first), then role, then text; null role or text is empty. Repeated rows are
turns of their own. Rows without a conversation id belong to no conversation and are left out. Further
columns are ignored. No conversations give no node, not even a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import query, read, stored, words

GROUP = 20
HEAD_MODULUS = 4
BLOCK_BITS = 10
END_BLOCK_BITS = 12
PARTS = [f"s{i}" for i in range(6)]


def _pieces(digest: Column) -> list[Column]:
    """Six 32-bit numbers of a hex digest; sums of up to two billion of them fit a long."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(p) for i, p in enumerate(PARTS)]


def _name(place: Column, parts: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", place, *parts), 256))


def rebuilt(conversations: DataFrame, group: int = GROUP, modulus: int = HEAD_MODULUS) -> tuple[DataFrame, DataFrame]:
    """(conv) of all conversations, and their rebuilt turns (conv, place, words, digest parts)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    block = F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(2**63)))
    n = running(t, ["conv"], block, ["turn", "role", "text"], {"n": ("sum", F.lit(1).cast("long"))}).select(
        "conv", "n", digest.alias("digest"), F.size(words(F.col("text"))).cast("long").alias("words"))
    n = stored(n, "trie-turns")
    h = F.crc32(F.col("conv").cast("string")) % modulus
    first = n.filter(F.col("n") < modulus).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("n", "digest", "words"))).alias("first"))
    convs = n.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("first", F.array()), 1, F.greatest("h", F.lit(1)).cast("int")))
    convs = convs.join(first.withColumnRenamed("conv", "base").hint("merge"), "base", "left").select("conv", "h", head.alias("head"))
    convs = stored(convs.withColumn("n_head", F.greatest(F.size("head"), F.lit(0)).cast("long")), "trie-heads")
    heads = convs.select("conv", F.explode("head").alias("t")).select("conv", F.col("t.n").alias("place"), "t.digest", "t.words")
    own = n.join(convs.select("conv", "h", "n_head").hint("merge"), "conv").filter("n > h").select(
        "conv", (F.col("n") - F.col("h") + F.col("n_head")).alias("place"), "digest", "words")
    placed = heads.unionByName(own)
    parts = _pieces(F.sha2(F.concat_ws(":", "place", "digest"), 256))
    return convs.select("conv"), stored(placed.select("conv", "place", "words", *parts), "trie-rebuilt")


def joined_ids(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, ids): the ids of each key as decimals in ascending order, joined by commas."""
    some = rows.groupBy(key, F.shiftright(id_col, END_BLOCK_BITS).alias("_b")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string"))).alias("_ids"))
    return some.groupBy(key).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_b", "_ids"))), lambda x: x["_ids"])).alias("ids"))


def sequences(convs: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (seq, conv of the smallest member, weight, length), and (seq, ids) that end there."""
    whole = placed.groupBy("conv").agg(F.max("place").alias("length"), *[F.sum(p).alias(p) for p in PARTS])
    whole = convs.join(whole.hint("merge"), "conv", "left").na.fill(0)
    whole = stored(whole.select("conv", "length", _name(F.col("length"), [F.col(p) for p in PARTS]).alias("seq")), "trie-whole")
    seqs = whole.groupBy("seq").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"), F.max("length").alias("length"))
    return stored(seqs, "trie-sequences"), joined_ids(whole, "seq", "conv")


def trie(conversations: DataFrame, group: int = GROUP, modulus: int = HEAD_MODULUS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words that its subtree shares), ends_sha256."""
    convs, placed = rebuilt(conversations, group, modulus)
    seqs, ends = sequences(convs, placed)

    # weighted prefixes of the distinct sequences, each turn's and the root's
    of = placed.join(seqs.hint("merge"), "conv")
    sums = running(of, ["seq"], F.shiftright("place", BLOCK_BITS), ["place"], {f"r_{p}": ("sum", F.col(p)) for p in PARTS})
    here = [F.col(f"r_{p}") for p in PARTS]
    before = [F.col(f"r_{p}") - F.col(p) for p in PARTS]
    none = [F.lit(0).cast("long") for _ in PARTS]
    key = ["seq", "conv", "weight", "length"]
    prefixes = sums.select(*key, "place", "words", _name(F.col("place"), here).alias("node"), _name(F.col("place") - 1, before).alias("parent"))
    zero = F.lit(0).cast("long")
    roots = seqs.select(*key, zero.alias("place"), zero.alias("words"), _name(zero, none).alias("node"), F.lit(None).cast("binary").alias("parent"))
    prefixes = stored(prefixes.unionByName(roots), "trie-prefixes")

    proper = prefixes.filter("place < length").select("node").distinct().withColumnRenamed("node", "seq")
    leaves = stored(seqs.join(proper.hint("merge"), "seq", "left_anti").select("seq", F.lit(1).alias("leaf")), "trie-leaves")
    marked = stored(prefixes.join(leaves.hint("merge"), "seq", "left"), "trie-marked")
    nodes = stored(marked.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("place").alias("depth"), F.max("words").alias("words"), F.min("conv").alias("conv_id"),
        F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("seq"))).alias("owner")), "trie-nodes")

    # subtree totals: from the end of each leaf's sequence to its start, over the nodes it owns
    value = nodes.select(F.col("owner").alias("seq"), F.col("depth").alias("place"), ((F.col("n_convs") - 1) * F.col("words")).alias("value"))
    path = marked.filter("leaf = 1").select("seq", "place", "node").join(value.hint("merge"), ["seq", "place"], "left")
    path = path.select("seq", "node", (-F.col("place")).alias("back"), F.coalesce("value", zero).alias("value"))
    carried = running(path, ["seq"], F.shiftright("back", BLOCK_BITS), ["back"], {"carried": ("sum", F.col("value"))})
    saved = carried.groupBy("node").agg(F.sum("carried").alias("saved_tokens"))

    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(saved.hint("merge"), "node").join(children.hint("merge"), "node", "left")
    out = out.join(ends.withColumnRenamed("seq", "node").hint("merge"), "node", "left").join(parents.hint("merge"), "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("ends_sha256"))


@query("op13_prefix_trie", r"""
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
head AS (
  SELECT c, s, c - c % 20 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)),
    4294967295::BIGINT) % 4 AS h
  FROM own),
rebuilt AS (SELECT a.c, list_concat(coalesce(o.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM head a LEFT JOIN own o ON o.c = a.b),
pre AS (SELECT c, len(s) AS m, unnest(range(len(s) + 1)) AS d, s FROM rebuilt),
node AS (
  SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (m = d), '') AS ends,
    CASE WHEN d > 0 THEN len(regexp_extract_all(any_value(s[d].x), '[^\x20\x09-\x0D]+')) ELSE 0 END AS w
  FROM pre GROUP BY 1, 2),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON k.p = n.p),
up AS (SELECT p, d, (n_convs - 1) * w AS v, (n_children = 0)::BIGINT AS leaf, unnest(range(d + 1)) AS a FROM full_node),
sub AS (SELECT p[1:a] AS p, sum(v)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM up GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node n JOIN sub s ON s.p = n.p LEFT JOIN full_node q ON n.d > 0 AND q.p = n.p[1:n.d - 1] AND q.d = n.d - 1""")
def op13_prefix_trie(spark, sf_dir):
    return trie(read(spark, sf_dir, "conversations"))
