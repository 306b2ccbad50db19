"""Chat formatting: layouts recognised by a fingerprint of their field paths, turned into one template.

A layout's fingerprint is the hash of its nested field paths, types left out. Declarative mappings, keyed by
fingerprint, say how to get turns (role, text) from it. The template marks turns with control strings;
the same strings inside roles and texts are escaped, reversibly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, BODY, CLOSE, CLOSE_TRAINED = "<s>", "[INST]", "[/INST]", "</s>"
#: Every control string of the template, broken up inside texts after its first character.
CONTROL = r"([<\[])(?=/?s>|/?INST\])"
TRAINED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """paths: the fields of the layout. turns: SQL for array<struct<role,text>> over its columns.
    get: the same over a variant ``v``. Rows that are single turns have role, text and order instead."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    get: str = ""
    rows: tuple[str, ...] = ()


def _two(first: str, second: str) -> str:
    return f"array(struct('user' as role, {first} as text), struct('assistant' as role, {second} as text))"


_TASK = "concat(coalesce({0}, ''), case when coalesce({1}, '') = '' then '' else concat('\\n\\n', {1}) end)"


def _v(path: str, kind: str = "string") -> str:
    return f"try_variant_get(v, '$.{path}', '{kind}')"


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), "transform(messages, m -> struct(m.role as role, m.content as text))", f"transform({_v('messages', 'array<struct<role string, content string>>')}, m -> struct(m.role as role, m.content as text))"),
    Mapping("from/value", ("conversations", "conversations[].from", "conversations[].value"), "transform(conversations, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))", f"transform({_v('conversations', 'array<struct<from string, value string>>')}, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))"),
    Mapping("prompt/completion", ("completion", "prompt"), _two("prompt", "completion"), _two(_v("prompt"), _v("completion"))),
    Mapping("prompt/response", ("prompt", "response"), _two("prompt", "response"), _two(_v("prompt"), _v("response"))),
    Mapping("question/answer", ("answer", "question"), _two("question", "answer"), _two(_v("question"), _v("answer"))),
    Mapping("instruction", ("instruction", "output"), _two("instruction", "output"), _two(_v("instruction"), _v("output"))),
    Mapping("instruction with input", ("input", "instruction", "output"), _two(_TASK.format("instruction", "input"), "output"), _two(_TASK.format(_v("instruction"), _v("input")), _v("output"))),
)


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}
KNOWN_FIELDS = {p.split("[")[0] for m in MAPPINGS for p in m.paths}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; array elements are ``[]``."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        own = f"{at}.{f.name}" if at else f.name
        out += [own, *field_paths(f.dataType, own)]
    return out


def mapping_of(schema: T.StructType) -> Mapping:
    """The mapping for a table's layout.

    Columns that no layout knows are ignored. If columns of several layouts are mixed, so that the
    fingerprint is new, the largest layout that is whole is used.
    """
    paths = field_paths(T.StructType([f for f in schema.fields if f.name in KNOWN_FIELDS]))
    whole = [m for m in MAPPINGS if set(m.paths) <= set(paths)]
    found = BY_FINGERPRINT.get(fingerprint(paths)) or max(whole, key=lambda m: len(m.paths), default=None)
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return found


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\``, and ``\e`` is put behind the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\"), CONTROL, r"$1\\e")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:e|(\\))", "$1")


def turns_of(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout; null or missing turns give no rows."""
    m = mapping_of(df.schema)
    if m.rows:
        return df.select(F.col(m.rows[0]).cast("long").alias("conv_id"), F.col(m.rows[1]).cast("long").alias("turn"), F.col(m.rows[2]).cast("string").alias("role"), F.col(m.rows[3]).cast("string").alias("text"))
    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.posexplode(F.expr(m.turns)).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def turns_of_json(df: DataFrame, id_col: str = "conv_id", json_col: str = "json") -> DataFrame:
    """(conv_id, layout, turn, role, text) of rows whose JSON may be in a different layout each.

    The fingerprint is taken per row from the row's own field paths. A row that is no JSON object, or in
    an unknown layout, gives one row with a null layout and null turn, role and text.
    """
    v = df.select(F.col(id_col).cast("long").alias("conv_id"), F.expr(f"try_parse_json(`{json_col}`)").alias("v"))
    # OBJECT<messages: ARRAY<OBJECT<content: STRING>>>: scalar kinds go, names and nesting stay.
    shape = F.regexp_replace(F.expr("schema_of_variant(v)"), r": (STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\([0-9]+,[0-9]+\))", "")
    v = v.withColumn("print", F.sha2(shape, 256))
    turns = F.expr("cast(null as array<struct<role string, text string>>)")
    name = F.lit(None).cast("string")
    for m in MAPPINGS:
        if m.get:
            same = F.col("print") == shape_fingerprint(m)
            name, turns = F.when(same, m.name).otherwise(name), F.when(same, F.expr(m.get)).otherwise(turns)
    out = v.withColumn("layout", name).withColumn("turns", turns)
    return out.select("conv_id", "layout", F.posexplode_outer("turns").alias("turn", "t")).select("conv_id", "layout", F.col("turn").cast("long"), "t.role", "t.text")


def shape_fingerprint(m: Mapping) -> str:
    top = sorted(p for p in m.paths if "[" not in p)
    inner = {t: sorted(p.split("[].")[1] for p in m.paths if p.startswith(f"{t}[].")) for t in top}
    shape = "OBJECT<" + ", ".join(f"{t}: ARRAY<OBJECT<{', '.join(inner[t])}>>" if inner[t] else t for t in top) + ">"
    return hashlib.sha256(shape.encode()).hexdigest()


SPAN = "array<struct<start:bigint,length:bigint,byte_start:bigint,byte_length:bigint>>"


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) from (conv_id, turn, role, text).

    Turns are in the order of turn, then role, then text (as given, not as escaped); null roles and texts are
    empty, null turns come last, and each row without conv_id is a conversation of its own. loss_spans are the escaped texts of the
    assistant's turns, in code points and in bytes of ``formatted``. A conversation is one value of the
    output and has to fit a task. Repeated rows are repeated turns; an empty table gives no rows.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    trained = F.coalesce(F.col("role") == TRAINED, F.lit(False))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    t = turns.select("conv_id", alone.alias("alone"), "turn", F.coalesce("role", F.lit("")).alias("by_role"), F.coalesce("text", F.lit("")).alias("by_text"), trained.alias("trained"), F.concat(F.lit(TURN), role, F.lit(BODY)).alias("head"), text.alias("body"), F.when(trained, CLOSE_TRAINED).otherwise(CLOSE).alias("tail"))
    order = Window.partitionBy("conv_id", "alone").orderBy(F.col("turn").asc_nulls_last(), "by_role", "by_text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat("head", "body", "tail")
    t = t.withColumn("piece", piece)
    t = t.select("conv_id", "alone", "trained", "piece", F.length("head").alias("h"), F.length("body").alias("b"), F.octet_length("head").alias("hb"), F.octet_length("body").alias("bb"),
                 F.row_number().over(order).alias("no"), F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)).alias("at"), F.coalesce(F.sum(F.octet_length("piece").cast("long")).over(before), F.lit(0)).alias("at_b"))
    span = F.struct((F.col("at") + F.col("h")).alias("start"), F.col("b").cast("long").alias("length"), (F.col("at_b") + F.col("hb")).alias("byte_start"), F.col("bb").cast("long").alias("byte_length"))
    g = t.groupBy("conv_id", "alone").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("no", "piece"))).alias("pieces"), F.sort_array(F.collect_list(F.when(F.col("trained"), span))).alias("loss_spans"))
    return g.select("conv_id", "n_turns", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> back from the output."""
    raw = F.split(formatted, rf"\Q{TURN}\E")
    raw = F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0)))

    def one(x: Column) -> Column:
        body = F.substring_index(x, BODY, -1)
        return F.struct(unescape(F.substring_index(x, BODY, 1)).alias("role"), unescape(F.regexp_replace(body, r"(</s>|\[/INST\])\z", "")).alias("text"))

    return F.transform(raw, one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. Spans are cut out by bytes, so time is linear in the length."""
    both = F.array(F.struct(formatted.cast("binary").alias("b"), spans.alias("s")))
    parts = F.transform(both, lambda x: F.array_join(F.transform(x["s"], lambda s: unescape(F.decode(F.substring(x["b"], (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")), "UTF-8"))), ""))
    return F.element_at(parts, 1)
