"""How filters interact, counted by a stream that takes masks back.

Every document has a mask of the filters it fails. Four of them look at the text alone; the fifth fails a
document whose text a document with a smaller id has, anywhere in the table. Files are processed as
micro-batches that run until all that is there is done. State per text (its SHA-256) holds the smallest id
seen so far and what the rows with that id counted as. A smaller id that arrives later takes the earlier
mask back from the counters of its part and adds it again with the fifth filter failed, so the counters are
right after every batch, in whatever order files arrive. (Texts share a state by their digests, some 64 in
each, to save calls to the store.) A later run with the same folders goes on with
files that came since.

From the counters (part, mask, labels) follow all orders of the filters: what each step keeps and removes,
what an earlier step had removed already, what its filter alone would catch, what good or toxic documents it
costs, and its share over all orders.

Scale: texts are read once, made into masks and digests, and never shuffled. Equal texts of an Arrow batch
merge before the shuffle, so a text that a third of all rows share sends one row per batch of ten thousand.
State lives in RocksDB on the executors' disks with its changelog in the shared folder; counters are one
small file per batch, written under the batch's number, so a replayed batch replaces its own.

Null texts are empty; null languages are the part ''. A row without an id fails no comparison and makes no
other fail. Rows with the same id and text count each; none of them is a copy of the other. A document with
several labels is good (toxic) if one of them says so. An empty table gives no rows. Further columns and
their names don't matter. Labels are read when a file is processed.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import streaming_state
from .common import new_path, query, read, stored, words

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
BATCHES = 4
TEXTS = 64
COUNTERS = "part string, mask int, good int, toxic int, n long"
_COMBINED = "key binary, part string, mask int, good int, toxic int, lo long, n_lo long, n_rest long"


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone."""
    w = words(text)
    return F.transform(F.array(F.struct(w.alias("w"), text.alias("t"))), lambda x: (
        F.when(F.size(x["w"]) < 100, BIT["A"]).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(x["w"])) < 80 * F.size(x["w"]), BIT["B"]).otherwise(0)
        + F.when(100 * F.regexp_count(x["t"], F.lit("[A-Z]")) > 10 * F.length(x["t"]), BIT["C"]).otherwise(0)
        + F.when(x["t"].rlike("[#$%&*|]"), BIT["D"]).otherwise(0)))[0].cast("int")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an Arrow batch with the same text and counters as one row: its smallest id, how many rows
    have that id, and how many have larger ones."""
    by = ["key", "part", "mask", "good", "toxic"]
    names = [*by, "lo", "n_lo", "n_rest"]
    for batch in batches:
        t = pa.Table.from_batches([batch])
        per_id = t.group_by([*by, "doc_id"]).aggregate([([], "count_all")])
        no_id = per_id.filter(pa.compute.is_null(per_id["doc_id"]))
        per_id = per_id.filter(pa.compute.is_valid(per_id["doc_id"]))
        first = per_id.group_by(by).aggregate([("doc_id", "min"), ("count_all", "sum")])
        at_first = per_id.join(first, keys=[*by, "doc_id"], right_keys=[*by, "doc_id_min"], join_type="inner")
        rest = pa.compute.subtract(at_first["count_all_sum"], at_first["count_all"])
        out = pa.table([*[at_first[c] for c in by], at_first["doc_id"], at_first["count_all"], rest], names=names)
        alone = pa.table([*[no_id[c] for c in by], no_id["doc_id"], no_id["count_all"], pa.array([0] * len(no_id), pa.int64())], names=names)
        for part in (out, alone):
            yield from part.combine_chunks().to_batches()


class MinimumIds(StatefulProcessor):
    """For every text the smallest id so far and the counters of the rows that have it. A state holds the
    texts of one slot of digests, so that a call to the store serves several."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getValueState("least", "texts string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        change: dict[tuple, int] = defaultdict(int)
        before, dirty, copy = self.least.get(), False, BIT["E"]
        texts = {t: (lo, {tuple(k): n for k, n in held}) for t, lo, held in json.loads(before[0])} if before else {}
        for r in rows:
            place = (r.part, r.mask, r.good, r.toxic)
            if r.lo is None:
                change[place] += r.n_lo
                continue
            as_copy = (r.part, r.mask | copy, r.good, r.toxic)
            if r.n_rest:
                change[as_copy] += r.n_rest
            text = r.key.hex()
            lo, held = texts.get(text, (None, {}))
            if lo is not None and r.lo > lo:
                change[as_copy] += r.n_lo
                continue
            if lo is None or r.lo < lo:  # what held the smallest id is a copy from now on
                for (part, mask, good, toxic), n in held.items():
                    change[(part, mask, good, toxic)] -= n
                    change[(part, mask | copy, good, toxic)] += n
                held = {}
            held[place] = held.get(place, 0) + r.n_lo
            texts[text], dirty = (r.lo, held), True
            change[place] += r.n_lo
        if dirty:
            self.least.update((json.dumps([[t, lo, [[list(k), n] for k, n in held.items()]] for t, (lo, held) in texts.items()]),))
        for (part, mask, good, toxic), n in change.items():
            if n:
                yield Row(part=part, mask=mask, good=good, toxic=toxic, n=n)

    def close(self) -> None:
        pass


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row per labelled document."""
    one = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).cast("int")
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def masked(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """(key, doc_id, part, mask, good, toxic) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    d = d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), text_mask(F.col("text")).alias("mask"))
    # rows without an id have no label; they are spread by their text
    d = d.withColumn("_salt", F.when(F.col("doc_id").isNull(), F.xxhash64("key"))).withColumn("_at", F.coalesce("doc_id", "_salt"))
    j = d.join(flags, (d["_at"] == flags["_id"]) & d["_salt"].isNull(), "left")
    return j.select("key", "doc_id", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def _pattern(path: str) -> str:
    """``path`` as a pattern that only it matches: a stream takes a single file only by a pattern."""
    return re.sub(r"(\w)(/*)$", r"[\1]\2", path)


def _slots(source: DataFrame, path: str) -> int:
    """How many states the texts are dealt to: about ``TEXTS`` each when a checkpoint begins, the same ever after."""
    spark = source.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        rows = source.count()  # from the files' footers
        spark.createDataFrame([(max(1, rows // TEXTS),)], "slots long").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first().slots


def count_files(spark: SparkSession, path: str, labels: DataFrame, counters: str, checkpoint: str, batches: int = BATCHES) -> None:
    """Process the Parquet files under ``path`` that ``checkpoint`` has not seen, in about ``batches``
    micro-batches, and add their changes to the ``counters`` folder."""
    source = spark.read.parquet(path)
    slots = _slots(source, f"{checkpoint}-slots")
    flags = stored(label_flags(labels), "audit-labels")
    per_batch = max(1, math.ceil(len(source.inputFiles()) / batches))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", per_batch).parquet(_pattern(path))
    merged = masked(stream, flags).mapInArrow(_merged, _COMBINED)

    def add(batch: DataFrame, batch_id: int) -> None:
        change = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        change.write.mode("overwrite").parquet(f"{counters}/batch={batch_id}")

    with streaming_state(spark):
        slot = F.pmod(F.xxhash64("key"), F.lit(slots))
        changes = merged.withColumn("slot", slot).groupBy("slot").transformWithState(MinimumIds(), COUNTERS, "Update", "None")
        run = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
        run.awaitTermination()


def counts(spark: SparkSession, counters: str) -> DataFrame:
    """(part, mask, good, toxic, n) after all batches."""
    rows = spark.read.schema(f"{COUNTERS}, batch long").parquet(counters)
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def orders() -> list[dict]:
    """Every step of every order: the step's bit and the bits before it."""
    return [{"filter_order": "".join(p), "step": k + 1, "bit": BIT[p[k]], "before": sum(BIT[f] for f in p[:k])}
            for p in permutations(FILTERS) for k in range(len(p))]


def report(masks: DataFrame) -> DataFrame:
    """One row per part, order and step. ``masks`` has one row per (part, mask, good, toxic) at most, so
    there are at most 128 for a part, each met by all steps."""
    kind = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    steps = masks.select("*", F.inline(F.from_json(F.lit(json.dumps(orders())), kind)))
    mask, bit, n = F.col("mask"), F.col("bit"), F.col("n")
    fails = mask.bitwiseAND(bit) != 0
    reached = mask.bitwiseAND(F.col("before")) == 0
    total = lambda cond, what=n: F.coalesce(F.sum(F.when(cond, what)), F.lit(0)).cast("long")
    each = F.lit(math.factorial(len(FILTERS))) / F.bit_count(mask)  # orders in which this filter is the first that fails
    return steps.groupBy("part", "filter_order", "step").agg(
        total(reached & ~fails).alias("kept"), total(reached & fails).alias("removed"), total(fails & ~reached).alias("redundant"),
        total(mask == bit).alias("unique_fails"), total(reached & fails & (F.col("good") == 1)).alias("good_lost"),
        total(reached & fails & (F.col("toxic") == 1)).alias("toxic_lost"), total(fails, n * each.cast("long")).alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The report on all files under ``path``."""
    counters = new_path(spark, "audit-counters")
    spark.createDataFrame([], COUNTERS).write.parquet(f"{counters}/batch=-1")
    count_files(spark, path, labels, counters, new_path(spark, "audit-state"), batches)
    return report(counts(spark, counters))


@query("op11_filter_audit", r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lo FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce((doc_id > lo)::INT, 0) AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS g, count(*) FILTER (toxic = 1) AS x FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum(list_prepend(0, list_transform(string_split(filter_order[1:step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END))) AS before
    FROM o, range(1, 6) r(step)),
p AS (SELECT part, filter_order, step::INT AS step, bit,
    coalesce(sum(n) FILTER (mask & (before::INT | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before::INT = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before::INT <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (mask & before::INT = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER (mask & before::INT = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM p""")
def op11_filter_audit(spark, sf_dir):
    return audit(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels"))
