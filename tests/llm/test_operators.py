"""The operators on awkward small tables, against plain versions, and all SQL checks at the small size."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from harness import compare, duck
from pyspark.sql import functions as F

import plain
from crowdtape.llm import (chat_layouts, line_blocks, mixing, near_copies, piece_dropout, quality_ledger, queries,
                           radix_dedup, secret_ledger, surrogates, token_files)
from crowdtape.llm.common import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_random = random.Random(5)
_WORDS = ["the", "of", "Réaux", "ölig", "thing", "日本", "a", "b1", "#x", "cat", "dog", "run", "blue"]
_LONG = " ".join(_random.choice(_WORDS) + str(_random.randint(0, 400)) for _ in range(30_000))
_PARA = " ".join(f"word{_random.randint(0, 99999)}" for _ in range(120))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "b", 0), (3, "   \n\t ", "en", "b", 5), (4, _PARA, "en", "a", 1), (5, _PARA.upper(), "en", "a", 1),
    (6, _PARA, "en", None, 1), (6, _PARA, "en", None, 1), (7, _PARA.replace("word", "Word", 3), "en", "a", 1), (8, _LONG, "en", "c", 1),
    (9, _LONG[:-5], "de", "c", 1), (10, "one two three", "en", "ü", 1), (11, "one two three", "en", "Z", 1), (None, "one two four", "en", "Z", 1),
    (12, "x\ny\nx\n\nx y x y x y", None, "a", 1), (13, "<|a|> \\ [INST] ", "en", "a", 1), (14, "É é ß ſ K", "en", "", 1), (15, "é É ß ſ k", "en", "", 1),
]
ORACLES = ["op3_source_mix", "op4_secret_ledger", "op5_quality_ledger", "quality_ablations", "op9_radix_dedup", "op10_chat_layouts"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns with names that operators use themselves."""
    names = ["kept", "keep_id", "group_size", "n_words", "failed_bits", "ids", "n_tokens", "class_id", "times", "h", "_text", "_w", "_row", "_id", "target", "entities", "in0"]
    return docs.select("*", *[F.lit("own").alias(n) for n in names])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    found, sql = queries.load_all()
    ok, n, _, _, msg = compare(spark, duck(SF), name, found[name], sql[name], SF)
    assert ok, msg
    assert n > 0


# 1: piece dropout


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_dropout.model_file())
    p = piece_dropout.pieces(piece_dropout.model_file())
    texts = [t or "" for _, t, *_ in ROWS] + ["  a  b ", "\x00\x01", "x" * 2000, "日本" * 300, "fi ﬁ 😀 ½ ", "<s> </s>"]
    for text, ids in zip(texts, piece_dropout.encode(p, texts, [1] * len(texts), 0.0)):
        assert ids.tolist() == model.encode(text)


@pytest.mark.parametrize("dropout", [0.1, 0.6, 1.0])
def test_dropout_follows_the_agenda_and_decodes(dropout):
    p = piece_dropout.pieces(piece_dropout.model_file())
    texts = [(t or "")[:300] for _, t, *_ in ROWS] + ["a▁b ▁", "x" * 600]
    keys = [piece_dropout.document_key(3, i) for i in range(len(texts))]
    got = piece_dropout.encode(p, texts, keys, dropout)
    for text, key, ids in zip(texts, keys, got):
        assert p.decode(ids.tolist()) == text
        if len(text) < 400:
            assert ids.tolist() == plain.agenda(p, text, key, dropout, piece_dropout._skipped)
    small = piece_dropout.encode(p, texts, keys, dropout, run=40)
    assert all((a == b).all() for a, b in zip(got, small))


def test_dropout_varies_by_seed_and_place_and_repeats():
    p = piece_dropout.pieces(piece_dropout.model_file())
    text = "international conversations " * 40
    a, b, c = (piece_dropout.encode(p, [text], [piece_dropout.document_key(s, 7)])[0].tolist() for s in (1, 1, 2))
    assert a == b and a != c
    assert len({tuple(piece_dropout.encode(p, [text], [piece_dropout.document_key(s, 7)])[0]) for s in range(20)}) > 15


def test_encoded_rows(spark, clash, none):
    model = piece_dropout.model_file()
    out = piece_dropout.encoded(clash, model)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r.lossless and r.n_tokens == len(r.ids) and r.kept == "own" for r in rows)
    back = piece_dropout.decoded(piece_dropout.encoded(clash, model, keep=["doc_id"]), model).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t, *_ in ROWS)
    assert piece_dropout.encoded(none, model).count() == 0


# 2: token files


def _ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_chunks_equal_whole_texts():
    import public_tokenizers

    texts = [t or "" for _, t, *_ in ROWS] + ["don't I'll 's", "a\x1cb \x1d c", "  \n x  y ", "1 22  333", "a <|endoftext|>b"]
    texts += ["".join(_random.choice(" \n\tab1'é日.\x1c ") for _ in range(_random.randint(0, 12))) for _ in range(500)]
    texts += ["x's 's's it's.", "don't!?", "ß.é, naïve#", "Ωmega ωord, слово.", "a<|endoftext|> b<|endoftext", "３ ４5 _a_ a_b", "A\u0301b"] * 2
    enc = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for size in (len(texts), 7):  # the second time from what is remembered
        for a in range(0, len(texts), size):
            ids, n = enc.encode(texts[a:a + size])
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == _ids(texts[a:a + size])


def test_token_files(spark, clash, none):
    import public_tokenizers

    file, path = public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "t")
    token_files.write_token_files(clash, path, file)
    got = token_files.digests(token_files.read_tokens(spark, path)).collect()
    want = Counter()
    for (i, *_), ids in zip(ROWS, _ids([t or "" for _, t, *_ in ROWS])):
        want[i, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    meta = token_files.read_tokens(spark, path, ids=False)
    plan = meta.filter("doc_id = 8")._jdf.queryExecution().executedPlan().toString()
    assert "ids#" not in plan and "EqualTo(doc_id,8)" in plan
    token_files.write_token_files(none, empty := new_path(spark, "t"), file)
    assert token_files.digests(token_files.read_tokens(spark, empty)).count() == 0


def test_token_file_layout(spark, tmp_path):
    import pyarrow.parquet as pq
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    f = sorted((tmp_path / "t").glob("part-*"))[0]
    row = pq.ParquetFile(f).metadata.row_group(0)
    columns = {row.column(i).path_in_schema: row.column(i) for i in range(row.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in x for x in columns["ids.list.element"].encodings)
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


# 3: mixing


def test_mixing_equals_plain(spark, docs, clash, none):
    sizes = [(i, s, len(plain.WORD.findall(t or ""))) for i, t, _, s, _ in ROWS]
    times, _ = plain.mix(sizes)
    got = Counter((r.doc_id, r.source, r.text, r.kept) for r in mixing.mixed(clash).collect())
    want = Counter()
    for (i, t, _, s, _), n in zip(ROWS, times):
        want[i, s, t, "own"] += n
    assert got == +want
    assert mixing.mixed(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_water_fill_and_nearness(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"s{rng.choice('abcdefgh')}", rng.randint(0, 30)) for i in range(400)] + [(i, "hot", rng.randint(1, 60)) for i in range(400, 900)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("h", mixing.order_hash(F.col("doc_id")))
    plan = mixing.mix_plan(sizes)
    times, target = plain.mix(rows)
    got = {r.source: r.target for r in plan.collect()}
    assert got == pytest.approx(target)
    taken = {r.doc_id: r.t for r in mixing._planned(sizes, plan).select("doc_id", mixing.times(F.col("h")).alias("t")).collect()}
    assert [taken[r[0]] for r in rows] == times
    total = Counter()
    for (_, s, z), n in zip(rows, times):
        total[s] += n * z
        assert n <= 2
    assert all(abs(total[s] - target[s]) <= max(2, 0.02 * target[s]) for s in target)


# 4: secrets


def test_ledger_scans_only_what_is_new(spark):
    rows = [("a", 1, "password = hunter22 x"), ("b", 1, "password = hunter22 x"), ("a", 2, None), ("c", 1, "AKIA" + "Q" * 16 + " token: abc"), ("c", 1, "AKIA" + "Q" * 16 + " token: abc")]
    first = spark.createDataFrame(rows, "path string, version int, text string")
    paths, led = secret_ledger.scan(first, ["path", "version"], secret_ledger.empty_ledger(spark))
    assert led.count() == 3
    found = secret_ledger.findings_by_path(paths, ["path", "version"], led).select("path", "version", secret_ledger.written(F.col("findings")).alias("s")).collect()
    assert Counter((r.path, r.version, r.s) for r in found) == Counter([("a", 1, "assign:0:19"), ("b", 1, "assign:0:19"), ("a", 2, ""), ("c", 1, "access:0:20"), ("c", 1, "access:0:20")])
    again = spark.createDataFrame([*rows, ("d", 9, "secret: " + "f" * 24)], "path string, version int, text string")
    paths, more = secret_ledger.scan(again, ["path", "version"], led)
    assert more.count() == 1
    new_rule = (*secret_ledger.RULES, secret_ledger.Rule("word", 1, "hunter"))
    paths, third = secret_ledger.scan(again, ["path", "version"], led.unionByName(more), rules=new_rule)
    assert third.count() == 4 and {tuple(r.scanned) for r in third.collect()} == {("word@1",)}
    every = led.unionByName(more).unionByName(third)
    found = secret_ledger.findings_by_path(paths, ["path", "version"], every, new_rule)
    assert {(r.path, r.version): [x.kind for x in r.findings] for r in found.collect()}["a", 1] == ["assign", "word"]


def _base_spans(text):
    out = []
    for kind, order, pattern, group, least in (("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
                                               ("access", 1, "AKIA[A-Z0-9]+", 0, 20), ("hex", 2, "[0-9a-f]+", 0, 24)):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return [s for *_, s in sorted(out)]


def test_secret_spans_equal_plain(spark):
    bits = ["password", "=", ":", " ", "'", '"', "token", "api_key", "APIKEY", "AKIA", "Q" * 16, "deadbeef" * 3, "é", "日", "", "abcdef", "-", "secret", "\n", "A1"]
    texts = ["".join(_random.choice(bits) for _ in range(_random.randint(0, 14))) for _ in range(400)] + [None, "", "secret: token: abcdefgh", "x" * 50_000 + " token=" + "a" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    paths, led = secret_ledger.scan(df, ["doc_id"], secret_ledger.empty_ledger(spark))
    got = {r.doc_id: [f"{x.kind}:{x.start}:{x.end}" for x in r.findings if x.kind in secret_ledger.BASE] for r in secret_ledger.findings_by_path(paths, ["doc_id"], led).collect()}
    assert got == {i: _base_spans(t or "") for i, t in enumerate(texts)}
    empty, nothing = secret_ledger.scan(df.limit(0), ["doc_id"], secret_ledger.empty_ledger(spark))
    assert empty.count() == nothing.count() == 0


# 5: quality


def test_quality_measures_equal_plain(spark, clash, none):
    texts = ["".join(_random.choice(["a", "b", "c", " ", " ", "\n", "#", "\t", "é"]) for _ in range(_random.randint(0, 80))) for _ in range(300)] + [t for _, t, *_ in ROWS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_ledger.measured(df).collect():
        assert {k: r[k] for k in quality_ledger.MEASURES} == plain.measures(texts[r.doc_id])
    led = quality_ledger.ledger(clash)
    assert led.count() == len(ROWS) and dict(led.dtypes)["n_words"] == "bigint" and {r.kept for r in led.collect()} == {"own"}
    assert quality_ledger.ledger(none).count() == 0
    assert quality_ledger.ablations(quality_ledger.ledger(none), (quality_ledger.FULL,)).count() == 0


def test_filters_on_the_ledger_stay_above_it(spark, docs):
    led = quality_ledger.ledger(docs)
    plan = led.filter(quality_ledger.keeps(quality_ledger.FULL)).filter("n_words > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") <= 2


def test_equal_hashes_hide_no_repetition(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.lit(7).cast("long"))  # every window collides
    texts = ["a b c a b c", "a b c d a b c e f g d a b", "a b c d e", "a b", "", None, "x x x x"]
    for r in quality_ledger.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert r.n_repeat_words == plain.measures(texts[r.doc_id])["n_repeat_words"], texts[r.doc_id]


# 6: near copies


def _idf(docs):
    table, _ = near_copies.word_frequencies(docs)
    return lambda w: float(table[near_copies.buckets(near_copies.hashed([w]))[0]])


def _same_classes(spark, df, rows, chunk=near_copies.CHUNK):
    texts = [t for _, t in rows]
    want, margin = plain.near_classes(texts, _idf(df))
    least = defaultdict(list)
    for (i, _), c in zip(rows, want):
        least[c].append(i)
    got = near_copies.near_copies(df, chunk).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == Counter(
        (i, min(x for x in least[c] if x is not None) if any(x is not None for x in least[c]) else None, len(least[c])) for (i, _), c in zip(rows, want))
    assert Counter(r.class_id for r in got if r.kept) == Counter(
        min((x for x in m if x is not None), default=None) for m in least.values())


def test_near_copies_of_test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    _same_classes(spark, df, [(r.doc_id, r.text) for r in df.collect()])


def test_near_copies_of_awkward_rows(spark, docs, clash, none):
    _same_classes(spark, docs, [(i, t) for i, t, *_ in ROWS])
    assert near_copies.near_copies(none).count() == 0
    stay = near_copies.without_near_copies(clash)
    assert stay.columns == clash.columns and {r.kept for r in stay.collect()} == {"own"}


def _edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("chunk", [3, 10, 512])
def test_large_groups_lose_no_link(spark, chunk):
    """Copies that resemble their original but not always each other, and texts that share a passage only."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = [(100 + i, _edited(base, rng.choice([1, 2, 3, 4, 5]), rng)) for i in range(40)] + [(1000, " ".join(base))]
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(100))
    rows += [(2000 + i, passage + " " + " ".join(f"o{rng.randint(0, 10**6)}" for _ in range(rng.choice([20, 40, 80])))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _same_classes(spark, df, rows, chunk)


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    s = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.uniform(1, 9, len(s)).astype(np.float32)
    other = w.copy()
    other[::3] *= 2
    sampler = near_copies.Sampler(samples=4000)
    alike = float((sampler.draw(s, w) == sampler.draw(s[40:], other[40:])).mean())
    assert abs(alike - near_copies.similarity((s, w), (s[40:], other[40:]))) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 99), (200, 201)]
    got = {r.node: r.label for r in near_copies.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99, 101: 99, 200: 200, 201: 200}


# 7: surrogates


def test_surrogates_keep_type_format_and_coreference(spark):
    texts = ["Mail Anna.Bell@Corp.com or anna.bell@corp.com, call +1 (555) 010-2233 or +1 555 010 2233, card 4111 1111 1111 1111.",
             "Frau Müller met Mr. Smith; Frau Müller left 10.0.0.7. card 4111111111111111", "", None, "nothing here 12 34",
             "IBAN DE44 5001 0517 5407 3249 31; Госпожа Иванова; MR SMITH"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, entities string")
    out = {r.doc_id: r for r in surrogates.replaced(df).collect()}
    assert [out[i].text for i in (2, 3, 4)] == texts[2:5] and out[4].entities == 0
    mails = re.findall(r"\S+@\S+\.example", out[0].text)
    assert len(mails) == 2 and mails[0].strip(",") == mails[1].strip(",")
    phones = re.findall(r"\+\d \(\d{3}\) \d{3}-\d{4}|\+\d \d{3} \d{3} \d{4}", out[0].text)
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", out[0].text)[0]
    assert card.replace(" ", "") in out[1].text and card != "4111 1111 1111 1111"
    a, b = re.findall(r"Frau (\w+)", out[1].text)
    assert a == b != "Müller" and re.search(r"Mr\. [A-Z][a-z]+", out[1].text) and "10.0.0.7" not in out[1].text
    assert re.search(r"Госпожа [А-Я][а-я]+ова", out[5].text) and re.search(r"DE\d\d \d{4} \d{4}", out[5].text)
    for t in ("Bell", "Smith", "5001", "Иванова"):
        assert all(t not in (r.text or "") for r in out.values())


def test_check_digits_decide_and_stay_valid():
    assert surrogates.found("order 4111111111111112 of 36974748794293dd and GB82 WEST 1234 5698 7654 33") == []
    text = "+1 (826) 555-4081 190.12.3.4 4845168114407329 7536784127813050 GB82 WEST 1234 5698 7654 32"
    kinds = [(k, text[a:b]) for a, b, k in surrogates.found(text)]
    assert kinds == [("phone", "+1 (826) 555-4081"), ("ip", "190.12.3.4"), ("number", "4845168114407329"), ("number", "7536784127813050"), ("iban", "GB82 WEST 1234 5698 7654 32")]
    for kind, t in kinds:
        norm = surrogates.normal(kind, t)
        new = surrogates.surrogate(kind, norm)
        assert new != norm and len(new) == len(norm) or kind == "ip"
        assert surrogates.is_valid(kind, new)


def test_digits_are_permuted():
    assert len({surrogates.permuted(f"{i:04d}", b"k", "phone") for i in range(10_000)}) == 10_000


def test_redraws_end_without_collisions(spark):
    ips = [("ip", f"{a}.{b}.1.1") for a in range(1, 100) for b in range(1, 41)] + [("ip", surrogates.surrogate("ip", "1.1.1.1"))]
    df = spark.createDataFrame(ips, "kind string, norm string")
    turn = {(r.kind, r.norm): r.turn for r in surrogates.redraws(df).collect()}
    new = [surrogates.surrogate(k, n, turn=turn.get((k, n), 0)) for k, n in ips]
    assert len(set(new)) == len(new) and not set(new) & {n for _, n in ips}
    assert turn[("ip", "1.1.1.1")] >= 1


def test_signs_cut_nothing(spark, monkeypatch):
    texts = ["dns 8.8.8.8 or 1.1.1.1", "dns 8.8.8.8 in 2024", "9.9.9.9", "a@b.cc", "Mr. Bell", "call 555-12-4567", "DE44500105175407324931", "1.2.3", "+1 (555) 010-2233 a@b.cc 7.7.7.7", "", "no sign 1 2 3"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r for r in surrogates.replaced(df).collect()}
    assert [out[i].entities for i in range(3)] == [2, 1, 1]
    assert "8.8.8.8" not in out[0].text + out[1].text and out[0].text.split()[1] == out[1].text.split()[1]
    # a plain version of the whole query, every pattern tried on every text
    every = surrogates._pattern(*[True] * surrogates._pattern.__wrapped__.__code__.co_argcount)
    monkeypatch.setattr(surrogates, "_pattern", lambda *signs: every)
    known = sorted({e for t in texts if t for e in plain.private(surrogates, t)})
    turn = {(r.kind, r.norm): r.turn for r in surrogates.redraws(spark.createDataFrame(known, "kind string, norm string")).collect()}
    for i, t in enumerate(texts):
        assert (out[i].text, out[i].entities) == plain.without_private(surrogates, t, turn), t


def test_failed_checks_hide_nothing():
    card = "4111 1111 1111 1111"
    es, de = "ES91 2100 0418 4502 0005 1332", "DE44 5001 0517 5407 3249 31"
    cases = [(f"{card} 123", card), (f"{card} 12 items", card), (f"2024 {card}", card), (f"2024 {card} 99", card), (f"9999 8888 {card} 7777", card), (f"{card} 12ab", card),
             ("4111111111111111 123", "4111111111111111"), ("3782 822463 10005", "3782 822463 10005"), ("3056 930902 5904 77", "3056 930902 5904"),
             (f"{es} BIC CAIXESBB", es), (f"{es} 2024", es), (f"{es} ABCDEFGH 12", es), (f"{de} BIC", de), (f"GB82 {es}", es), (f"AB12 {card}", card), (es.replace(" ", "") + " PAID NOW", es.replace(" ", "")),
             ("NO93 8601 1117 947 OSLO", "NO93 8601 1117 947"), ("4111 1111 1111 1112", None), ("ES91 2100 0418 4502 0005 1333 BIC", None), ("411111111111111", None)]
    for t, want in cases:
        for text in (t, f"pay {t}.", f"({t})"):
            assert [text[a:b] for a, b, _ in surrogates.found(text)] == ([want] if want else []), text


def test_forms_of_a_name_agree(spark):
    texts = ["Mr. John Smith came. Smith said so; JOHN SMITH left, Smith's car, John did not. Dr. Smith and MR SMITH and Prof. J. R. Smith", "Mr. Smith", "Dr. Smith", "Frau Prof. Dr. Müller",
             "Mrs. Anna O'Brien-Lee and Mr and Mrs Bell; Herr von Braun; Herr Braun, Braun", "Господин Иванов и Госпожа Иванова, Иванова", "Mr. John F. Kennedy, Kennedy",
             "call 555.123.4567 or 555 123 4567 or 555-123-4567", "from 2001:db8:85a3::8a2e:370:7334, [2606:4700:4700::1111]. ::ffff:12:30:45 at 12:30:45 std::vector a::b FE80::0001:ABCD:12", "Smith and MS Windows", "Mr. John Kent met Sir John"]
    out = [r.text for r in surrogates.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()]
    last = re.fullmatch(r"Mr\. ([A-Z][a-z]+)", out[1])[1]
    first = re.match(r"Mr\. ([\w-]+) ", out[0])[1]
    assert last != "Smith" and first != "John" and out[2] == f"Dr. {last}"
    assert re.sub(r"Prof\. [A-Z]\. [A-Z]\.", "Prof.", out[0]) == f"Mr. {first} {last} came. {last} said so; {first.upper()} {last.upper()} left, {last}'s car, {first} did not. Dr. {last} and MR {last.upper()} and Prof. {last}"
    assert re.fullmatch(r"Frau Prof\. Dr\. [A-Z][a-z]+", out[3]) and "Müller" not in out[3]
    a, b, c = re.search(r"Mr and Mrs [A-Z][a-z]+; Herr von (\w+); Herr (\w+), (\w+)$", out[4]).groups()
    assert a == b == c != "Braun" and not re.search("Anna|Brien|Lee|Bell", out[4])
    a, b, c = re.fullmatch(r"Господин (\w+) и Госпожа (\w+), (\w+)", out[5]).groups()
    assert a + "а" == b == c and a != "Иванов"
    assert re.fullmatch(r"Mr\. [\w-]+ [A-Z]\. (\w+), \1", out[6]) and "Kennedy" not in out[6]
    phones = re.fullmatch(r"call (\d{3}\.\d{3}\.\d{4}) or (\d{3} \d{3} \d{4}) or (\d{3}-\d{3}-\d{4})", out[7]).groups()
    assert len({re.sub(r"\D", "", x) for x in phones}) == 1 and "555" not in phones[0][:3]
    assert not re.search("85a3|4700|0001:ABCD", out[8]) and out[8].endswith(tuple("0123456789ABCDEF")) and " at 12:30:45 std::vector a::b " in out[8] and "]. " in out[8]
    assert surrogates.found("a Professor of Physics, the Lord of men, Mr and Mr mueller") == [(48, 58, "person")]
    assert out[9] == texts[9]  # nothing introduced Smith here, and MS is no title before Windows
    assert re.fullmatch(r"Mr\. ([\w-]+) \w+ met Sir \1", out[10])


def test_surrogates_on_awkward_rows(spark, clash, none):
    out = surrogates.replaced(clash)
    assert out.count() == len(ROWS) and set(out.columns) == set(clash.columns)
    assert surrogates.replaced(none).count() == 0


# 8: pages


def test_pages_equal_plain(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    for r in line_blocks.extracted(df).collect():
        assert r.text == plain.article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_pages_of_other_shapes(spark):
    text = "A sentence of the article that is long enough to count as text. "
    cases = [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<nav>menu</nav><footer>foot</footer>", ""),
        (f"<div class='menu'>m</div><div><h2>Head</h2><p>{text}<p>Short.<p>{text}</div><div id='comments'><p>{text}</p></div>", f"Head\n{text.strip()}\nShort.\n{text.strip()}"),
        (f"<article><header><h1>T &amp; &#233;</h1></header><p>a  b\n c</p><aside>{text}</aside><p>d<form>{text}</form></article><p>{text}</p>", "T & é\na b c\nd"),
        (f"<main><p>x &lt;b&gt;</p><script>if (a < b) '</p>'</script><!-- <p>no</p> --><p title='a>b'>y</p></main><div class='cookie-notice'>{text}</div>", "x <b>\ny"),
        ("<p>one<br>two<ul><li>three<li>four</ul>", "one\ntwo\nthree\nfour"),
    ]
    df = spark.createDataFrame([(i, None, h, 1) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in line_blocks.extracted(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}
    assert line_blocks.extracted(df.limit(0)).count() == 0


def test_hostile_pages_take_linear_time():
    """Unclosed tags and quotes: four times the page takes about four times as long."""
    import time

    for unit in ("<div class='a ", "<a ", "<!", '<div title="x<y ', "<script", "<p title='<"):
        took = []
        for n in (5_000, 20_000):
            began = time.process_time()
            line_blocks.main_text(unit * n + ">")
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.2
    assert line_blocks.main_text('<article><p title="a < b > c">One.</p><p data-x=\'<b>x</b>\'>Two.</p></article>') == "One.\nTwo."


def test_light_parts_of_the_container_stay():
    ad = "<ul class='related'><li>a<li>b<li>c</ul>"
    p = lambda c, n: f"<p>{c * n}</p>"
    body = p("b", 5000)
    for head, tail in (("", ""), ("<html><body>", "</body></html>"), ("<div><section>", "</section></div>")):
        assert line_blocks.main_text(f"{head}{p('i', 600)}{ad}{body}{ad}{p('e', 300)}{tail}") == "\n".join(("i" * 600, "b" * 5000, "e" * 300))
    # another container stays out
    assert line_blocks.main_text(f"<div>{p('x', 90)}</div>{ad}<div>{p('i', 60)}{ad}{body}{p('c', 40)}{ad}{p('e', 30)}</div>") == "\n".join(("i" * 60, "b" * 5000, "c" * 40, "e" * 30))
    # a teaser card is no article; an article with the page's heading and a main element are
    assert line_blocks.main_text(f"<article><h3>Read</h3><p>more</p></article>{ad}<div>{body}</div>") == "b" * 5000
    assert line_blocks.main_text(f"<article><h1>T</h1><p>t</p></article><div>{body}</div>") == "T\nt"
    assert line_blocks.main_text(f"<main><p>t</p></main><div>{body}</div>") == "t"


# 9: exact copies


def test_radix_equals_plain(spark, docs, clash, none):
    want = plain.exact_groups([(i, t) for i, t, *_ in ROWS])
    got = radix_dedup.radix_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (r[0], *want[i], hashlib.sha256(plain.lower_ascii(r[1] or "").encode()).hexdigest()) for i, r in enumerate(ROWS))
    assert Counter(r.keep_id for r in got if r.kept) == Counter({k: 1 for k, _ in want.values()})
    stay = radix_dedup.without_copies(clash)
    assert stay.columns == clash.columns and stay.count() == len({v for v in want.values()}) and {r.kept for r in stay.collect()} == {"own"}
    assert radix_dedup.radix_dedup(none).count() == 0


def test_radix_goes_to_the_end_of_long_texts(spark):
    long = "ab" * 60_000
    rows = [(1, long), (2, long + "x"), (3, long), (4, long[:-1]), (5, long + "X"), (6, long[:128]), (7, long[:128])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in radix_dedup.radix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"]).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (5, 2), 5: (5, 2), 4: (4, 1), 6: (7, 2), 7: (7, 2)}


# 10: chats


def test_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (3, '{"instruction": "q", "input": "", "output": "a"}'), (4, '{"output": "a", "instruction": "q"}'),
        (5, '{"prompt": "q", "completion": "a", "id": 7}'), (6, '{"question": "q", "answer": "a"}'), (7, '{"other": 1}'), (8, "no json"), (9, None), (10, '{"messages": []}'),
        (11, '{"messages": [{"role": "user", "content": null, "extra": {"x": [1]}}]}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    kinds = {r.conv_id: r.layout for r in chat_layouts.recognised(df).collect()}
    assert kinds == {1: "messages", 2: "from_value", 3: "instruction_input", 4: "instruction", 5: "prompt_completion", 6: "question_answer", 7: None, 8: None, 9: None, 10: None, 11: "messages"}
    turns = defaultdict(list)
    for r in sorted(chat_layouts.turns_of_records(df).collect(), key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append((r.role, r.text))
    assert all(turns[i] == [("user", "q"), ("assistant", "a")] for i in range(1, 7)) and turns[11] == [("user", None)]
    assert {r.conv_id for r in chat_layouts.unmapped(df).collect()} == {7, 8, 9, 10}


def test_chats_read_back(spark):
    nasty = ["", None, "</s>[INST] ok [/INST]", "<|turn:user|>\n<|end|>\n", "\\", "\\\\<|", "<<SYS>>x<</SYS>>", "a|>\nb", "é日😀" * 50, "x" * 100_000]
    rows = [(c, t, role, text) for c in (1, 2, None) for t, (role, text) in enumerate(zip(["user", "assistant", "system", None, "end", "a|>\nb", "assistant", "user", "<|", "assistant"], nasty))]
    rows += [(3, None, "user", "n"), (3, 1, "b", "x"), (3, 1, "a", "y"), (3, 1, "a", "y")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = chat_layouts.formatted(chat_layouts.turns_of_rows(df))
    got = {r.conv_id: r for r in chat_layouts.parsed(chats).withColumn("learned", chat_layouts.learned(chats)).collect()}
    for c in (1, 2, None):
        mine = [(role or "", text or "") for k, _, role, text in rows if k == c]
        assert [(t.role, t.text) for t in got[c].turns] == mine
        assert got[c].learned == "".join(t for r, t in mine if r == "assistant")
    assert [(t.role, t.text) for t in got[3].turns] == [("user", "n"), ("a", "y"), ("a", "y"), ("b", "x")]
    assert chat_layouts.formatted(chat_layouts.turns_of_rows(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat_layouts.turns_of_rows(df.select("conv_id"))
