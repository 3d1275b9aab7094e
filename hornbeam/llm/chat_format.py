"""Chat formatting: heterogeneous layouts become canonical turns, and turns become one marked-up training text.

A layout is recognised by its schema fingerprint, the hash of its sorted nested field paths; the fingerprint selects a
declarative mapping.  For each mapping the fingerprint is taken over its own paths alone, so other fields change nothing;
the mapping with most paths wins.  Everything is DataFrame expressions.

Template, once for each turn, joined without anything between::

    ### <role>\\n<text>\\n</turn>\\n

Within roles and texts ``\\`` is written ``\\b``, ``<`` is ``\\l`` and ``#`` is ``\\h`` (in roles a line feed is ``\\n``), so
no text can hold a mark and the original comes back exactly.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "\n</turn>\n"
TURN = "struct<turn:bigint,role:string,text:string>"
#: JSON strings of any length; the parser's own limit is 20 million characters, and longer ones would be lost.
LONG = {"maxStringLen": "2147483647"}


@dataclass(frozen=True)
class Mapping:
    """``paths`` are the field paths that make the layout; ``turns`` is an SQL expression for an array of TURN over the
    parsed record ``r``, whose type is ``record``."""

    name: str
    paths: tuple[str, ...]
    record: str
    turns: str


def _pair(user: str, assistant: str) -> str:
    return (
        f"array(struct(0L as turn, 'user' as role, {user} as text), struct(1L as turn, 'assistant' as role, {assistant} as text))"
    )


#: Layouts known from the start; a caller may pass others.
MAPPINGS = (
    Mapping("prompt", ("prompt", "response"), "prompt string, response string", _pair("r.prompt", "r.response")),
    Mapping("completion", ("completion", "prompt"), "prompt string, completion string", _pair("r.prompt", "r.completion")),
    Mapping(
        "instruction",
        ("input", "instruction", "output"),
        "instruction string, input string, output string",
        _pair("concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))", "r.output"),
    ),
    Mapping("bare_instruction", ("instruction", "output"), "instruction string, output string", _pair("r.instruction", "r.output")),
    Mapping(
        "messages",
        ("messages", "messages[].content", "messages[].role"),
        "messages array<struct<role:string,content:string>>",
        "transform(r.messages, (m, i) -> struct(cast(i as bigint) as turn, m.role as role, m.content as text))",
    ),
    Mapping(
        "conversations",
        ("conversations", "conversations[].from", "conversations[].value"),
        "conversations array<struct<`from`:string,value:string>>",
        "transform(r.conversations, (m, i) -> struct(cast(i as bigint) as turn, "
        "case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))",
    ),
    Mapping(
        "turn_row",
        ("role", "text", "turn"),
        "turn bigint, role string, text string",
        "array(struct(r.turn as turn, r.role as role, r.text as text))",
    ),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def fingerprint_of(paths: tuple[str, ...]) -> Column:
    return F.lit(fingerprint(paths))


def _object(json: Column) -> Column:
    """A JSON object as a map of strings; null for anything else."""
    return F.when(json.rlike(r"^\s*\{"), F.from_json(json, "map<string,string>", LONG))


def json_paths(record: Column) -> Column:
    """Sorted field paths of a JSON object: its keys, and below a key those of an object or of any object in an array."""
    none = F.array().cast("array<string>")

    def paths(fields: Column) -> Column:
        top = F.coalesce(F.map_keys(fields), none)

        def below(k: Column) -> Column:
            value = F.try_element_at(fields, k)
            members = F.flatten(F.transform(F.from_json(value, "array<string>", LONG), lambda e: F.coalesce(F.map_keys(_object(e)), none)))
            listed = F.when(value.rlike(r"^\s*\["), F.transform(F.array_distinct(members), lambda x: F.concat(k, F.lit("[]."), x)))
            return F.coalesce(listed, F.transform(F.map_keys(_object(value)), lambda x: F.concat(k, F.lit("."), x)), none)

        return F.array_sort(F.array_distinct(F.concat(top, F.flatten(F.transform(top, below)))))

    # a list of one, so that the record is parsed once
    return F.get(F.transform(F.array(_object(record)), paths), F.lit(0))


def canonical_turns(records: DataFrame, id_column: str, json_column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``conv_id, turn, role, text, mapping`` from JSON records of mixed layouts, one row for each turn.

    A record that is null, no JSON object, or of no known layout, or whose turns cannot be read, gives one row with null
    ``mapping``, ``turn``, ``role`` and ``text``: nothing is lost silently.  No messages give no turns, unless the record
    has another layout too.
    """
    base = records.select(F.col(id_column).alias("conv_id"), F.col(json_column).cast("string").alias("record"))
    base = base.withColumn("paths", json_paths(F.col("record")))
    # below an empty array any path would be found
    fields = _object(F.col("record"))
    empty = F.filter(F.map_keys(fields), lambda k: F.size(F.from_json(F.try_element_at(fields, k), "array<string>", LONG)) == 0)
    base = base.withColumn("empty", F.coalesce(empty, F.array().cast("array<string>")))
    fits, ordered = [], sorted(mappings, key=_rank)
    for m in ordered:
        own = F.filter("paths", lambda p: p.isin(*m.paths))  # noqa: B023
        fits.append((m, F.sha2(F.array_join(own, "\n"), 256) == fingerprint_of(m.paths)))
    for m in ordered:
        lists = {p.split("[]")[0] for p in m.paths if "[]." in p}
        if lists:
            own = [p for p in m.paths if p.split("[]")[0] not in lists]
            there = [F.array_contains("paths", p) for p in own] + [F.array_contains("empty", k) for k in sorted(lists)]
            fits.append((m, functools.reduce(lambda x, y: x & y, there)))
    turns = F.lit(None).cast(f"array<{TURN}>")
    name = F.lit(None).cast("string")
    for m, hit in reversed(fits):
        # the parsed record is named in the mapping as r
        value = F.element_at(F.expr(f"transform(array(from_json(record, '{_quoted(m.record)}', map('maxStringLen', '{LONG["maxStringLen"]}'))), r -> {m.turns})"), 1).cast(f"array<{TURN}>")
        turns = F.when(hit, value).otherwise(turns)
        name = F.when(hit, F.lit(m.name)).otherwise(name)
    out = base.select("conv_id", name.alias("mapping"), turns.alias("turns"))
    out = out.select("conv_id", F.when(F.col("turns").isNotNull(), F.col("mapping")).alias("mapping"), F.explode_outer("turns").alias("t"))
    return out.where("t is not null or mapping is null").select("conv_id", "t.turn", "t.role", "t.text", "mapping")


def _rank(m: Mapping) -> tuple[int, str]:
    """Most paths first, then by name."""
    return -len(m.paths), m.name


def _quoted(s: str) -> str:
    return s.replace("'", "\\'")


def struct_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Field paths of a Spark type, arrays marked by ``[]``."""
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            out += [at + f.name, *struct_paths(f.dataType, f"{at}{f.name}.")]
        return out
    if isinstance(kind, T.ArrayType):
        return struct_paths(kind.elementType, at[:-1] + "[]." if at else "[].")
    return []


def turns_of(frame: DataFrame, id_column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """As :func:`canonical_turns` for a typed table: all its rows have one layout, so its fingerprints are constants."""
    own = struct_paths(frame.schema)
    # the layout with most paths wins where a table holds the fields of several
    fits = [m for m in sorted(mappings, key=_rank) if fingerprint(p for p in own if p in m.paths) == fingerprint(m.paths)]
    if not fits:
        known = {p for m in mappings for p in m.paths}
        raise ValueError(f"no mapping fits the fields {sorted(known.intersection(own))}")
    m = fits[0]
    record = F.struct(*(F.col(c) for c in sorted({p.split("[")[0].split(".")[0] for p in m.paths}))).alias("r")
    return (
        frame.select(F.col(id_column).alias("conv_id"), record)
        .select("conv_id", F.explode(F.expr(m.turns).cast(f"array<{TURN}>")).alias("t"), F.lit(m.name).alias("mapping"))
        .select("conv_id", "t.turn", "t.role", "t.text", "mapping")
    )


def as_records(turns: DataFrame) -> DataFrame:
    """``conv_id, record``: conversations of ``turns(conv_id, turn, role, text)`` as JSON of mixed layouts, as corpora from
    several places hold them; :func:`canonical_turns` reads them back in the same order.

    A hash of the id deals conversations out to lists of messages under two names and to one record for each turn; a user's
    and an assistant's turn alone may be a prompt and a response.  A null role or text is empty.  The order is that of
    :func:`format_chats`.  One conversation is one output text, so its turns meet in one task here too.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    rows = turns.select("conv_id", F.struct(turn.isNull().alias("last"), turn.alias("turn"), role, text).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # crc32 of the id, so that the layout does not go with Spark's own partitioning hash
    layout = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    coded = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    plain = ~F.exists("t", lambda t: t["role"].isin("human", "gpt"))  # else the second name could not be read back
    json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    messages = json(F.struct(F.lit("mixed").alias("id"), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    others = json(F.struct(F.transform("t", lambda t: F.struct(coded(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"), F.lit(1).alias("version")))
    two = (F.size("t") == 2) & (F.get("t.role", F.lit(0)) == "user") & (F.get("t.role", F.lit(1)) == "assistant")
    prompt = json(F.struct(F.get("t.text", F.lit(0)).alias("prompt"), F.get("t.text", F.lit(1)).alias("response")))
    each = F.transform("t", lambda t: json(F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"))))
    records = F.when(two & (layout < 2), F.array(prompt)).when(layout == 0, F.array(messages)).when((layout == 1) & plain, F.array(others)).otherwise(each)
    return rows.select("conv_id", F.explode(records).alias("record"))


def escape(c: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_chats(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of canonical turns; spans are (start, length) in code points from 0.

    Turns go by ``turn`` (nulls last), then role, then text; repeated rows are repeated turns.  A null role or text is
    empty, a null ``conv_id`` is a conversation of its own.  One conversation is one output text, so its turns meet in
    one task; offsets come from a running sum, not from repeated concatenation.
    """
    t = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    t = t.withColumn("head", head).withColumn("body", escape(F.col("text")))
    t = t.withColumn("segment", F.concat("head", "body", F.lit(END))).withColumn("at", F.row_number().over(order))
    through = F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("start", through - F.length("segment") + F.length("head"))
    span = F.when(F.col("role").isin(*learned), F.struct("start", F.length("body").cast("long").alias("length")))
    t = t.select("conv_id", "at", "segment", span.alias("span"))
    rows = F.array_sort(F.collect_list(F.struct("at", "segment", "span")))
    return (
        t.groupBy("conv_id")
        .agg(rows.alias("rows"))
        .select(
            "conv_id",
            F.array_join(F.col("rows.segment"), "").alias("formatted"),
            F.filter(F.col("rows.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def read_back(chats: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text``: roles and texts as they were before formatting, and the text under the mask."""
    parts = F.split("formatted", END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def one(p: Column) -> Column:
        cut = F.instr(p, "\n")
        role = unescape(F.replace(F.substr(p, F.lit(5), cut - 5), F.lit("\\n"), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(F.substr(p, cut + 1)).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", "formatted", F.transform(parts, one).alias("turns"), F.array_join(masked, "").alias("loss_text"))
