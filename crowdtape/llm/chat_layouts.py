"""Chat formatting by schema fingerprints.

A record's layout is recognised by the hash of its nested field paths. Known fingerprints select a
declarative mapping into canonical turns (conv_id, turn, role, text); a record with further fields falls
to the first mapping whose required paths it has; others are returned by ``unmapped``. The rows of a typed
table are records whose paths are those of its schema: the same fingerprint picks the mapping, whether a row
is a turn or a conversation. Turns are then written with markers, control
strings inside texts are escaped reversibly, and the spans that training should learn from (assistant
texts) are kept beside the text as code-point offsets.

Null texts and roles count as empty. Turns run by turn number (null first), then role, then text; equal
rows are turns of their own. A null conversation id is a conversation like any other. Extra columns or
fields are ignored. A record without turns gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, query, read

# --- fixed values: markers, and strings that chat models take for control ---
HEAD, HEAD_END, TURN_END = "<|turn:", "|>\n", "<|end|>\n"
CONTROLS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


@dataclass(frozen=True)
class Layout:
    """``paths`` are the nested fields as the schema writes them; ``schema`` reads the record; ``turns``
    is SQL over the record ``r`` giving an array of (role, text)."""

    name: str
    paths: str
    required: tuple[str, ...]
    schema: str
    turns: str


def _fields(*parts: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{role}', 'text', {field})" for role, field in parts) + ")"


LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", ("messages: ARRAY<OBJECT<", "content", "role"),
           "messages array<struct<role string, content string>>",
           "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("from_value", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", ("conversations: ARRAY<OBJECT<", "from", "value"),
           "conversations array<struct<`from` string, value string>>",
           "transform(r.conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))"),
    Layout("instruction_input", "OBJECT<input, instruction, output>", ("input", "instruction", "output"),
           "instruction string, input string, output string",
           _fields(("user", "concat_ws('\n\n', r.instruction, nullif(r.input, ''))"), ("assistant", "r.output"))),
    Layout("instruction", "OBJECT<instruction, output>", ("instruction", "output"),
           "instruction string, output string", _fields(("user", "r.instruction"), ("assistant", "r.output"))),
    Layout("system_prompt", "OBJECT<prompt, response, system>", ("prompt", "response", "system"),
           "system string, prompt string, response string",
           _fields(("system", "r.system"), ("user", "r.prompt"), ("assistant", "r.response"))),
    Layout("prompt_response", "OBJECT<prompt, response>", ("prompt", "response"),
           "prompt string, response string", _fields(("user", "r.prompt"), ("assistant", "r.response"))),
    Layout("prompt_completion", "OBJECT<completion, prompt>", ("completion", "prompt"),
           "prompt string, completion string", _fields(("user", "r.prompt"), ("assistant", "r.completion"))),
    Layout("question_answer", "OBJECT<answer, question>", ("answer", "question"),
           "question string, answer string", _fields(("user", "r.question"), ("assistant", "r.answer"))),
)

#: Records that are one turn: ``turns`` gives their (conv_id, turn, role, text).
ROW_LAYOUTS = (
    Layout("turn", "OBJECT<conv_id, role, text, turn>", ("conv_id", "role", "text", "turn"), "conv_id long, turn long, role string, text string",
           "array(named_struct('conv_id', r.conv_id, 'turn', r.turn, 'role', r.role, 'text', r.text))"),
    Layout("indexed_message", "OBJECT<content, id, index, role>", ("content", "id", "index", "role"), "id long, `index` long, role string, content string",
           "array(named_struct('conv_id', r.id, 'turn', r.`index`, 'role', r.role, 'text', r.content))"),
)


def nested_paths(record: Column) -> Column:
    """The record's nested field paths without types, in sorted order; null if it is not JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, r"(?<!<)(?<!ARRAY): (?!ARRAY<|OBJECT<)[A-Z]+(\([0-9, ]*\))?", "")


def fingerprint(paths: Column) -> Column:
    return F.sha2(paths, 256)


def schema_paths(kind: T.DataType) -> str:
    """The nested field paths of a typed record, written as ``nested_paths`` writes those of a JSON record."""
    if isinstance(kind, T.ArrayType):
        inner = schema_paths(kind.elementType)
        return f"ARRAY<{inner}>" if inner else ""
    if not isinstance(kind, T.StructType):
        return ""
    inner = ((f.name, schema_paths(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name))
    return "OBJECT<" + ", ".join(f"{name}: {p}" if p else name for name, p in inner) + ">"


def layout_of(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Name of the mapping: by fingerprint, else by the first layout whose required paths are there."""
    known = F.lit(None).cast("string")
    for x in reversed(layouts):
        known = F.when(fingerprint(paths) == hashlib.sha256(x.paths.encode()).hexdigest(), x.name).otherwise(known)
    partly = F.lit(None).cast("string")
    for x in reversed(layouts):
        there = F.lit(True)
        for p in x.required:
            there = there & paths.rlike(r"(^|[<, ])" + re.escape(p) + r"($|[>:, ]|(?<=<))")
        partly = F.when(there, x.name).otherwise(partly)
    return F.coalesce(known, partly)


def recognised(records: DataFrame, record: str = "record") -> DataFrame:
    return records.withColumn("_paths", nested_paths(F.col(record))).withColumn(
        "fingerprint", fingerprint(F.col("_paths"))).withColumn("layout", layout_of(F.col("_paths"))).drop("_paths")


def turns_of_records(records: DataFrame, conv: str = "conv_id", record: str = "record") -> DataFrame:
    """Canonical turns of JSON records of any known layout."""
    df = recognised(records.select(F.col(conv).alias("conv_id"), F.col(record).alias("_json")), "_json")
    turns = F.lit(None).cast("array<struct<role string, text string>>")
    for x in LAYOUTS:
        df = df.withColumn(f"_{x.name}", F.when(F.col("layout") == x.name, F.from_json("_json", x.schema)))
        turns = F.when(F.col("layout") == x.name, F.expr(x.turns.replace("r.", f"_{x.name}."))).otherwise(turns)
    return df.select("conv_id", F.posexplode(turns).alias("turn", "_t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "_t.role", "_t.text")


def unmapped(records: DataFrame, record: str = "record") -> DataFrame:
    """Records that no mapping knows, with their fingerprints, for whoever writes the next mapping."""
    return recognised(records, record).filter(F.col("layout").isNull())


def turns_of_rows(table: DataFrame, conv: str | None = None) -> DataFrame:
    """Canonical turns of a typed table. All of its rows have the nested paths of its schema, so their
    fingerprint is looked up once, as that of a JSON record is. Rows that are conversations need ``conv``,
    the column of their id."""
    record = T.StructType([f for f in table.schema.fields if f.name != conv])
    paths = F.lit(schema_paths(record))
    layouts = LAYOUTS if conv else ROW_LAYOUTS
    name = table.sparkSession.range(1).select(layout_of(paths, layouts).alias("layout")).first().layout
    if name is None:
        raise ValueError(f"no layout for the paths {schema_paths(record)}")
    turns = F.expr(next(x.turns for x in layouts if x.name == name))
    rows = table.select(*([F.col(conv).alias("conv_id")] if conv else []), F.struct(*[F.col(f"`{f.name}`") for f in record.fields]).alias("r"))
    if not conv:
        return rows.select(F.explode(turns).alias("_t")).select("_t.conv_id", F.col("_t.turn").cast("long").alias("turn"), "_t.role", "_t.text")
    return rows.select("conv_id", F.posexplode(turns).alias("turn", "_t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "_t.role", "_t.text")


def escaped(text: Column) -> Column:
    """A backslash after the first character of every control string; backslashes are doubled first."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted text, loss_spans (start and length, in code points)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    df = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id", F.row_number().over(order).alias("n"), "role",
        F.concat(F.lit(HEAD), escaped(F.col("role")), F.lit(HEAD_END)).alias("head"), escaped(F.col("text")).alias("body"))
    df = df.withColumn("piece", F.concat("head", "body", F.lit(TURN_END)))
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head"))
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "n", "piece", "start", F.length("body").cast("long").alias("length"), F.col("role").isin(*learn).alias("learn")))).alias("t"))
    return df.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"], x["length"])).alias("loss_spans"))


def parsed(chats: DataFrame) -> DataFrame:
    """``chats`` with its turns (role, text), read from the formatted text alone."""
    pieces = F.split("formatted", re.escape(TURN_END))
    piece = lambda x: F.struct(
        unescaped(F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), HEAD_END, 1)).alias("role"),
        unescaped(F.substr(x, F.call_function("locate", F.lit(HEAD_END), x) + len(HEAD_END))).alias("text"))
    return chats.withColumn("_p", pieces).withColumn(
        "turns", F.transform(F.slice("_p", 1, F.size("_p") - 1), piece)).drop("_p")


def learned(chats: DataFrame) -> Column:
    """The text under the loss mask, unescaped."""
    cut = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))
    return unescaped(F.array_join(cut, ""))


_ESCAPED = "replace({}, chr(92), chr(92) || chr(92))"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"

SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS a,
  sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + {len(HEAD) + len(HEAD_END) + len(TURN_END)}) AS f
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, CAST(length(a) AS BIGINT) AS loss_chars, sha256(a) AS loss_sha256,
  CAST(f AS BIGINT) AS formatted_chars FROM g"""


@query("op10_chat_layouts", SQL)
def op10_chat_layouts(spark, sf_dir):
    said = '</s>[INST] ok [/INST]'
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(
        f'{{"messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}]}}').alias("record"))
    turns = turns_of_rows(read(spark, sf_dir, "conversations")).unionByName(turns_of_records(own))
    path = new_path(spark, "chats")
    formatted(turns).write.parquet(path)
    chats = spark.read.parquet(path)
    told = parsed(chats).withColumn("_learned", learned(chats))
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"), F.sha2("_learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
