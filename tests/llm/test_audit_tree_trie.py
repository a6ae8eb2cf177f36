"""Filter audit, count-vector tree and prefix trie on awkward small tables, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from harness import compare, duck
from pyspark.sql import functions as F

from crowdtape.llm import count_tree, filter_audit, prefix_trie, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_random = random.Random(17)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    found, sql = queries.load_all()
    ok, n, _, _, msg = compare(spark, duck(SF), name, found[name], sql[name], SF)
    assert ok, msg
    assert n > 0


# 11: filter audit

LONG = " ".join(f"w{i}" for i in range(150))
DOCS = [
    (40, LONG, "en"), (30, LONG, "de"), (30, LONG, "en"), (30, LONG, "en"), (35, LONG, None), (None, LONG, "en"), (None, LONG, "en"),
    (1, None, None), (2, "", "en"), (3, " \n", ""), (9, "same same " * 80, "en"), (8, "same same " * 80, "en"), (7, "same same " * 80, "fr"),
    (11, "UPPER CASE " * 30, "en"), (12, LONG + " #tag", "en"), (5, LONG + " #tag", "de"), (13, "É" * 300, "en"), (14, LONG.upper(), "de"),
]
LABELS = [(40, 1, 0), (30, 1, 1), (30, 0, 0), (9, None, 1), (8, 1, None), (None, 1, 1), (12, 2, 2), (99, 1, 1)]


def plain_masks(docs, labels):
    out = Counter()
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in docs:
        text = t or ""
        w = WORD.findall(text)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 bool(re.search(r"[#$%&*|]", text)), i is not None and i > least[text]]
        mine = [x for x in labels if i is not None and x[0] == i]
        out[(lang or "", sum(1 << k for k, f in enumerate(fails) if f), int(any(x[1] == 1 for x in mine)), int(any(x[2] == 1 for x in mine)))] += 1
    return out


def plain_report(masks):
    rows = {}
    for part in {k[0] for k in masks}:
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            for step in range(1, 6):
                kept = removed = redundant = unique = good = toxic = 0
                bit, before = 1 << (ord(order[step - 1]) - 65), sum(1 << (ord(f) - 65) for f in order[:step - 1])
                for (p, m, g, x), n in masks.items():
                    if p != part:
                        continue
                    kept += n * (not m & (before | bit))
                    removed += n * bool(m & bit and not m & before)
                    redundant += n * bool(m & bit and m & before)
                    unique += n * (m == bit)
                    good += n * bool(m & bit and not m & before and g)
                    toxic += n * bool(m & bit and not m & before and x)
                share[order[step - 1]] += removed
                rows[(part, "".join(order), step)] = [kept, removed, redundant, unique, good, toxic]
        for (p, order, step), v in rows.items():
            if p == part:
                v.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in rows.items()}


def _write(spark, docs, path):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    df.withColumns({"part": F.lit("own"), "mask": F.lit(7), "key": F.lit("x"), "_id": F.lit(3)}).coalesce(1).write.mode("append").parquet(path)


def _masks(df):
    return Counter({(r.part, r.mask, r.good, r.toxic): r.n for r in df.collect()})


def test_smaller_ids_take_masks_back(spark, tmp_path):
    """Files arrive with falling ids, in runs that share state; the counters are right after each."""
    path, counters, state = str(tmp_path / "docs"), str(tmp_path / "counters"), str(tmp_path / "state")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    falling = sorted(DOCS, key=lambda r: -(r[0] or 0))
    seen = []
    for part in (falling[:6], falling[6:12], falling[12:]):
        seen += part
        for rows in (part[:3], part[3:]):
            _write(spark, rows, path)
        filter_audit.count_files(spark, path, labels, counters, state, batches=2)
        assert _masks(filter_audit.counts(spark, counters)) == plain_masks(seen, LABELS)
    assert spark.read.parquet(counters).filter("n < 0").count() > 0  # some were taken back


def test_audit_of_awkward_rows(spark, tmp_path):
    path = str(tmp_path / "docs")
    _write(spark, DOCS, path)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in filter_audit.audit(spark, path, labels).collect()}
    assert got == plain_report(plain_masks(DOCS, LABELS))
    _write(spark, [], str(tmp_path / "none"))
    assert filter_audit.audit(spark, str(tmp_path / "none"), labels).count() == 0


# 12: count-vector tree


def plain_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        t = top(k)
        if i is not None:
            least[t] = min(i, least.get(t, i))
    return Counter((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def _prose(n):
    return [f"v{_random.randint(0, 3000)}" for _ in range(n)]


def _edited(ws, share):
    return [f"e{_random.randint(0, 10**6)}" if _random.random() < share else w for w in ws]


def _family(size, share, length=120):
    """Chains of near copies, some of them beside the threshold, and others around a common passage."""
    first, passage, rows = _prose(length), _prose(60), []
    for _ in range(size):
        rows.append(" ".join(_edited(first, share)))
    rows += [" ".join(passage + _prose(k)) for k in (3, 9, 12, 15, 40, 80)] + [" ".join(_prose(k) + passage) for k in (3, 9, 12, 15)]
    step = first
    for _ in range(6):
        step = _edited(step, 0.03)
        rows.append(" ".join(step))
    return rows


AWKWARD = [None, "", " \n\t", "one two three", "ONE two three", "one two", "one two three four five", "one two three four five six", "é É é É é", "É É é É é",
           "a " * 500, "a " * 3000, " ".join(_prose(6000))]


@pytest.mark.parametrize("chunk", [512, 3])
def test_components_equal_brute_force(spark, chunk):
    texts = AWKWARD + [AWKWARD[-1] + " end", AWKWARD[-1]] + _family(25, 0.01) + _family(12, 0.022) + _family(6, 0.0)
    _random.shuffle(texts)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "no id here at all"), (3, "x y z"), (3, "x y z"), (3, texts[5])]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, node string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in count_tree.jaccard_components(df, chunk).collect())
    assert got == plain_components(rows)


def test_no_documents(spark):
    assert count_tree.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bound_and_routing_lose_no_link():
    """Linked sets share a routing shingle, and their points' bound reaches the threshold."""
    late = np.zeros(count_tree.BUCKETS, bool)
    late[::3] = True
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(400):
        n = int(rng.integers(1, 1500))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) >= rng.choice([0, 0.05, 0.1, 0.15])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(len(a) * rng.choice([0, 0.05, 0.1]))).astype(np.uint64)]))
        if not len(b) or not count_tree.links(a, b):
            continue
        met += 1
        assert (count_tree.unpacked(count_tree.packed(count_tree.point(a)), len(a)) == count_tree.point(a)).all()
        assert set(np.concatenate(count_tree.routing(a, late))) & set(np.concatenate(count_tree.routing(b, late)))
        assert count_tree.near_first([count_tree.point(a), count_tree.point(b)], np.array([len(a), len(b)])) == [1]
        found = list(count_tree.candidates([count_tree.point(a), count_tree.point(b)], np.array([len(a), len(b)]), np.array([0, 1])))
        assert len(found) == 1
    assert met > 100


def test_trees_leave_out_what_is_apart():
    """Over unlike sets of like size the tree looks at few pairs; the linked ones are all there."""
    sets = [np.unique(np.random.default_rng(i).integers(0, 2**63, 300 + i % 40).astype(np.uint64)) for i in range(200)]
    sets += [s[7:] for s in sets[:20]]
    found = set(map(tuple, map(sorted, count_tree.candidates([count_tree.point(s) for s in sets], np.array([len(s) for s in sets]), np.arange(len(sets))))))
    assert {(i, 200 + i) for i in range(20)} <= found and len(found) < 200


# 13: prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = Counter(), Counter()
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return Counter((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest()) for p, m in nodes.items())


def _trie_rows(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in prefix_trie.trie(df).select(cols).collect())


def test_trie_equals_brute_force(spark):
    rows = [(c, t, _random.choice(["user", "assistant"]), _random.choice(["hi", "a b c", "", None, "é\tx"])) for c in range(-25, 90) if c % 7 for t in range(_random.randint(1, 5))]
    rows += [(c, t, "user", "same text here") for c in range(6000, 6060) for t in range(3)]  # more ends than one block of ids
    rows += [(c, None, r, x) for c in (200, 201, 220) for r, x in (("user", "b"), (None, "a"), ("user", "b"), ("user", None))]
    rows += [(300, 1, "user", "one"), (301, 5, "user", "short"), (9_000_000_000, 1, "user", "one"), (None, 1, "user", "nobody's"), (321, 1, "u", "ab"), (322, 1, "ua", "b")]
    rows += [(400 + k, t, "user", f"turn {t}") for k in range(2) for t in range(1100)]  # several blocks of turns
    rows += [(402, t, "user", f"turn {t}" if t < 1040 else "else") for t in range(1060)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, place int")
    assert _trie_rows(df) == plain_trie(rows)
    assert _trie_rows(df.limit(0)) == Counter()

