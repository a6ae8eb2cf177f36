"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content (a blob). A blob is scanned once
per rule version: the ledger holds, per blob, the rule versions it has met and what they found, and a
scan reads only blobs with a pair the ledger lacks. Findings are then joined back to all paths and
versions that hold the blob, so a thousand copies cost one scan and a new rule meets only what it must.

Null texts are empty blobs. Repeated rows are paths of their own. Rules match leftmost and without
overlap, each rule by itself; a match that fails the rule's length is dropped, not retried. Offsets are
code points, the end is exclusive. Columns of the input besides the path columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, read, stored

#: Stands around matches while a text is cut up; a text's own use of it is exchanged for its neighbour first.
MARK, OTHER = "\ue000", "\ue001"

FINDINGS = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``least`` is the least length of group ``group``; ``hint`` is a string that every match contains.
    A changed pattern takes a new ``version``."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    hint: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# --- fixed values: the three base rules, then public key formats ---
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint="_"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY"),
)
BASE = ("assign", "access", "hex")


def matches(text: Column, rule: Rule, order: int) -> Column:
    """The rule's findings in a text (without MARK), by position."""
    parts = F.split(F.regexp_replace(text, f"({rule.pattern})" if not rule.group else rule.pattern, MARK + "$0" + MARK), MARK)
    step = lambda s, p: F.struct(
        (s["at"] + F.length(p)).alias("at"), (~s["inside"]).alias("inside"),
        F.when(s["inside"], F.concat(s["found"], F.array(F.struct(
            s["at"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (s["at"] + F.length(p)).alias("end"),
            (F.length(F.regexp_extract(p, rule.pattern, rule.group)) if rule.group else F.length(p)).alias("n")))
        )).otherwise(s["found"]).alias("found"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"),
                     F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint,n:int>>").alias("found"))
    found = F.aggregate(parts, begin, step, lambda s: s["found"])
    found = F.transform(F.filter(found, lambda x: x["n"] >= rule.least), lambda x: F.struct(x["start"], x["ord"], x["kind"], x["end"]))
    maybe = F.contains(text, F.lit(rule.hint)) & text.rlike(rule.pattern) if rule.hint else text.rlike(rule.pattern)
    return F.when(maybe, found).otherwise(F.array().cast(FINDINGS))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob string, scanned array<string>, findings {FINDINGS}")


def addressed(versions: DataFrame, path: list[str], text: str = "text") -> DataFrame:
    """Path columns and blob of every version, without texts."""
    return versions.select(*path, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def scan(versions: DataFrame, path: list[str], known: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths with blobs, new ledger rows) for whatever ``known`` lacks. Both are written tables."""
    paths = stored(addressed(versions, path, text), "secret-paths")
    wanted = F.array(*[F.lit(r.id) for r in rules])
    met = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("_met"))
    todo = paths.groupBy("blob").agg(F.min(F.struct(*path)).alias("_path")).join(met, "blob", "left").select(
        "blob", "_path", F.array_except(wanted, F.coalesce("_met", F.array().cast("array<string>"))).alias("scanned")).filter(F.size("scanned") > 0)
    # one path per blob lends the text
    texts = versions.select(F.struct(*path).alias("_path"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = texts.withColumn("blob", F.sha2("_text", 256))
    texts = texts.join(todo.withColumnRenamed("_path", "_lender"), (texts["blob"] == todo["blob"]) & texts["_path"].eqNullSafe(F.col("_lender"))).select(
        texts["blob"], "scanned", F.translate("_text", MARK, OTHER).alias("_text"))
    found = [F.when(F.array_contains("scanned", r.id), matches(F.col("_text"), r, i)).otherwise(F.array().cast(FINDINGS)) for i, r in enumerate(rules)]
    rows = texts.select("blob", "scanned", F.flatten(F.array(*found)).alias("findings")).dropDuplicates(["blob"])
    return paths, stored(rows, "secret-ledger")


def findings_by_path(paths: DataFrame, path: list[str], ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path with the findings of its blob under the rules' present versions, by start, then rule."""
    current = F.array(*[F.lit(r.id) for r in rules])
    version = reduce(lambda c, r: F.when(F.col("f.kind") == r.kind, F.lit(r.id)).otherwise(c), rules, F.lit(None).cast("string"))
    # at most one ledger row counts for a (blob, rule version) pair; blobs without findings need no row
    rows = ledger.filter((F.size("findings") > 0) & F.arrays_overlap("scanned", current)).select("blob", "scanned", F.explode("findings").alias("f"))
    rows = rows.filter(F.array_contains("scanned", version))
    per_blob = rows.groupBy("blob").agg(F.sort_array(F.collect_set("f")).alias("findings"))
    out = paths.join(per_blob, "blob", "left")
    return out.select(*path, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def written(findings) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _sql() -> str:
    cuts, found = [], []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        cuts.append(f"string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS p{i}")
        size = f"length(regexp_extract(p{i}[i], '{pattern}', {r.group}))"
        found.append(f"[{{'s': list_sum([length(x) for x in p{i}[1:i - 1]]), 'o': {i}, 'k': '{r.kind}', 'n': length(p{i}[i])}} "
                     f"for i in range(2, len(p{i}), 2) if {size} >= {r.least}]")
    line = "array_to_string([x.k || ':' || x.s || ':' || (x.s + x.n) for x in {}], ',')"
    count = ", ".join(f"CAST(len([x for x in f if x.k = '{k}']) AS BIGINT) AS n_{k}" for k in BASE)
    return f"""WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents),
c AS (SELECT doc_id, {', '.join(cuts)} FROM t),
f AS (SELECT doc_id, list_sort(flatten([{', '.join(found)}])) AS f FROM c)
SELECT doc_id, {count}, sha256({line.format("[x for x in f if x.k IN ('assign', 'access', 'hex')]")}) AS base_sha256, {line.format('f')} AS spans FROM f"""


@query("op4_secret_ledger", _sql())
def op4_secret_ledger(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    paths, ledger = scan(docs, ["doc_id"], empty_ledger(spark))
    found = findings_by_path(paths, ["doc_id"], ledger)
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"))
