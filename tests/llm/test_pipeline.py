"""The pipeline's stages on the small tables against a plain version of the whole run."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import plain
from crowdtape.llm import near_copies, piece_dropout
from crowdtape.llm.common import stored

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _plain_run(spark, rows):
    """Rows (doc_id, text, source) after each stage: quality, exact, near, mix."""
    steps = []
    rows = [r for r in rows if plain.good(r[1])]
    steps.append(rows)
    groups = plain.exact_groups([(i, t) for i, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if groups[k][0] == r[0]]
    steps.append(rows)
    if rows:
        df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
        table, _ = near_copies.word_frequencies(df)
        idf = lambda w: float(table[near_copies.buckets(near_copies.hashed([w]))[0]])
        classes, _ = plain.near_classes([t for _, t, _ in rows], idf)
        least = defaultdict(list)
        for r, c in zip(rows, classes):
            least[c].append(r)
        rows = [min(m) for m in least.values()]
    steps.append(rows)
    times, _ = plain.mix([(i, s, len(plain.WORD.findall(t))) for i, t, s in rows]) if rows else ([], {})
    steps.append([r for r, n in zip(rows, times) for _ in range(n)])
    return steps


def test_run_equals_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = _plain_run(spark, raw)
    got = docs
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want):
        got = stored(stage(spark, got, SF), "t")
        assert got.columns == docs.columns, name
        assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == Counter(rows), name
    out = corpus_pipeline.run(spark, SF).collect()
    p = piece_dropout.pieces(piece_dropout.model_file())
    ids = {i: piece_dropout.encode(p, [t], [piece_dropout.document_key(piece_dropout.SEED, i)])[0].tolist() for i, t, _ in want[-1]}
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, tuple(ids[i])) for i, *_ in want[-1])
    assert all(r.lossless for r in out)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_tables(spark, name, stage):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, good, None, None, 1), (2, good, None, None, 1), (3, good.upper(), "en", "a", 1), (4, good + " x", "en", "a", 1), (5, "few", "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(7).alias(c) for c in ("kept", "n_words", "ids", "class_id", "times", "_text", "h")])
    out = stage(spark, docs, SF)
    if name != "tokens":
        assert out.columns == docs.columns and {r.kept for r in out.collect()} <= {7}
    # exact: {null, ""}, {2, 2, 3}, {4}, {5}; near: 4 joins 2 and 3
    want = {"quality": 4, "exact_dedup": 4, "near_dedup": 3, "tokens": 7}
    if name in want:
        assert out.count() == want[name]
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_clean_documents_pass_the_quality_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 AND toxic = 0")
    clean = docs.join(labels, "doc_id").filter(F.size(F.split("text", " ")) >= 60).filter(~F.col("text").rlike(r"(\b\w+\b)( \1){4}"))
    kept = corpus_pipeline.STAGES[0][1](spark, clean.select(*docs.columns), SF).count()
    assert kept >= 0.97 * clean.count()
