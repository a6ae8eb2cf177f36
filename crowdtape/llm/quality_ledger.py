"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; a policy is a versioned mask over those bits, so policies are applied, compared and ablated by
bitwise arithmetic on the ledger, without reading a text again.

Nulls and texts without a word have zero measurements (and fail ``few_words``). Repeated rows each get
their own ledger row; columns of the input are kept under their own names, the ledger's columns are
named in ``MEASURES`` and must not clash with kept ones (they replace them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, query, read, renamed, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` is true; ``bit`` is fixed for ever, also when a rule is retired."""

    bit: int
    name: str
    fails: str


#: Public heuristics for web text: length, repetition, symbols, word length, repeated lines.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 3 * n_words"),
    Rule(4, "long_words", "word_chars > 10 * n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 30 * n_lines AND n_dup_lines > 1"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what to reject: any failed bit inside ``mask``."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[name] for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(r.name for r in RULES))
NO_LENGTH = Policy("no-length-1", tuple(r.name for r in RULES if r.name != "few_words"))


def _bits(n: Column) -> Column:
    """Bits that hold the positions 0..n-1."""
    return F.length(F.bin(n))


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements, all computed inside the row.

    Words in repeated three-word windows: each window becomes one long whose high bits are a hash of the
    window and whose low bits are its position, so that sorting the longs brings equal windows together.
    Windows with an equal neighbour are then sorted and compared by their words, which removes chance
    collisions and lets none hide a repetition.
    """
    kept = [c for c in docs.columns if c not in MEASURES]
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*kept, words(F.col(text)).alias("_w"), F.split(body, "\n").alias("_l"), body.alias("_t"))
    df = df.select(
        *kept, "_w", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter("_l", lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("_l"),
        _bits(F.size("_w")).alias("_b"),
    )
    df = df.select(
        *kept, "_w", "n_words", "word_chars", "n_symbols", "_b",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    # one long per window: hash above, position below
    df = df.withColumn("_k", F.transform(
        F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))),
        lambda x, i: F.call_function("shiftleft", F.xxhash64(x, _at("_h", i + 1), _at("_h", i + 2)), F.col("_b")).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_k", F.sort_array("_k"))
    same = lambda a, b: F.call_function("shiftrightunsigned", a.bitwiseXOR(b), F.col("_b")) == 0
    low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b")) - F.lit(1).cast("long"))
    # places in the sorted array whose successor has an equal hash, then those and their successors
    df = df.withColumn("_c", F.when(F.size("_k") < 2, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), F.size("_k") - 2), lambda j: same(_at("_k", j), _at("_k", j + 1)))))
    df = df.withColumn("_c", F.sort_array(F.array_union("_c", F.transform("_c", lambda j: j + 1))))
    df = df.withColumn("_c", F.transform("_c", lambda j: low(_at("_k", j)).cast("int")))
    # of these windows the words decide: sorted by words and position, equal windows stand side by side,
    # whatever else has their hash
    df = df.withColumn("_x", F.sort_array(F.transform("_c", lambda i: F.struct(F.array_join(F.slice(F.col("_w"), i + 1, 3), " ").alias("w"), i.alias("i")))))
    alike = lambda x, j: F.coalesce(x["w"] == _at("_x", j)["w"], F.lit(False))
    df = df.withColumn("_c", F.sort_array(F.transform(F.filter("_x", lambda x, j: alike(x, j + 1) | alike(x, j - 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.zip_with("_c", F.slice("_c", 2, F.size("_c")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0).cast("long"), lambda s, x: s + x,
    )
    df = df.withColumn("n_repeat_words", covered)
    # A zero that the optimizer can't know. Without it a filter on a measurement would be pushed below
    # these steps, and each step's expression would be evaluated anew inside the lambdas of the next.
    zero = F.call_function("shiftrightunsigned", F.monotonically_increasing_id(), F.lit(63))
    return df.select(*kept, *[F.col(m).bitwiseOR(zero).alias(m) for m in MEASURES])


def rule_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its measurements and ``failed_bits``; the input's own column of that name goes."""
    df, to = renamed(docs)
    own = [*MEASURES, "failed_bits"]
    led = measured(df, to[text]).withColumn("failed_bits", rule_bits(rules))
    return led.select(*[F.col(new).alias(old) for old, new in to.items() if old not in own], *own)


def keeps(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policy(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return led.withColumn("policy", F.lit(policy.version)).withColumn("kept", keeps(policy, rules))


def ablations(led: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents that the policy keeps, that the rule fails, and that only this rule
    rejects (what leaving it out would give back). Texts are not read: rows are first counted per
    bit pattern, of which there are at most 2 to the number of rules."""
    patterns = led.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.explode(F.array(*[
        F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for p in policies for r in rules if r.name in p.rules
    ]))
    hit = F.col("failed_bits").bitwiseAND(F.col("c.mask"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return patterns.select("failed_bits", "n", cases.alias("c")).groupBy("c.policy", "c.rule").agg(
        count(hit == 0).alias("kept"), count(hit.bitwiseAND(F.col("c.bit")) != 0).alias("failed"), count(hit == F.col("c.bit")).alias("only_this_rule"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM t),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
win AS (SELECT doc_id, i, w[i:i + 2] AS x FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(w.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 3 * n_words THEN 8 ELSE 0 END
      + CASE WHEN word_chars > 10 * n_words THEN 16 ELSE 0 END
      + CASE WHEN 100 * n_dup_lines > 30 * n_lines AND n_dup_lines > 1 THEN 32 ELSE 0 END AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""


@query("op5_quality_ledger", SQL)
def op5_quality_ledger(spark, sf_dir):
    led = ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (~keeps(BASE)).alias("base_failed"), keeps(FULL).alias("kept"), "failed_bits")


@query("quality_ablations", f"""
WITH q AS ({SQL}), r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 8), ('long_words', 16), ('repeated_lines', 32)),
p(policy, mask) AS (VALUES ('base-1', 3), ('full-1', 63), ('no-length-1', 62))
SELECT policy, rule, count(*) FILTER (WHERE failed_bits & mask = 0) AS kept, count(*) FILTER (WHERE failed_bits & bit <> 0) AS failed,
       count(*) FILTER (WHERE failed_bits & mask = bit) AS only_this_rule
FROM q, r, p WHERE mask & bit <> 0 GROUP BY policy, rule""")
def quality_ablations(spark, sf_dir):
    return ablations(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")), (BASE, FULL, NO_LENGTH))
