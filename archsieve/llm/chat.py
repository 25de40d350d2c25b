"""Chat formatting of records in many layouts.

A layout is declared by the type of its record and by where its turns stand in it. The nested paths of the fields that layouts name,
hashed, are a record's fingerprint, and the fingerprint selects the layout: for a table its schema is hashed once, for JSON each record,
by the schema of its VARIANT. Other fields don't count. What no layout fits (or is no JSON) keeps null as its layout and its turns.

Canonical turns are marked like ``<|im_start|>role``, a line end, the text, ``<|im_end|>``, a line end. Inside roles and texts every
``<|``, with any backslashes between both signs, gets one backslash more, so that no text can hold a mark; in roles, backslashes and line
ends are written with a backslash too. Spans over the formatted text (code points) are its loss mask: the texts of the roles to learn.
``read`` gets turns and learned text back from the formatted text and its spans alone.

Null roles and texts are empty. Turns of one conversation follow their order column, then role and text, so repeated rows and ties
have one order; nulls come first. Rows without a conversation id are one conversation without an id. An empty table gives an empty
one. Columns that are not named are not read. A conversation is one value of a column, and so are its texts.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archsieve.llm.common import tidy

START, END = "<|im_start|>", "<|im_end|>"
LEARN = ("assistant",)
TURNS = "array<struct<role string, text string>>"
SPANS = "array<struct<start long, stop long>>"
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


@dataclass(frozen=True)
class Layout:
    """record: its type. Either ``each`` names the list of turns (blank: the record is the list; None: the record is one turn)
    with the fields of role and text, or ``parts`` name a role and the fields that make its text; a part without text is no turn
    where its role is ``system``. speakers: names of roles in this layout."""

    name: str
    record: str
    each: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    speakers: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def type(self) -> T.DataType:
        return T.DataType.fromDDL(self.record)

    def turns(self, record: Column) -> Column:
        def one(m: Column) -> Column:
            role = functools.reduce(lambda c, name: c.when(m[self.role] == name, F.lit(self.speakers[name])), self.speakers, F.when(F.lit(False), F.lit(""))).otherwise(m[self.role])
            outer, _, inner = self.text.partition("[].")
            return turn(role, F.array_join(m[outer][inner], "") if inner else m[outer])

        def joined(names: tuple[str, ...]) -> Column:
            return F.array_join(F.filter(F.array(*[record[n] for n in names]), lambda t: t != ""), "\n\n")

        if self.parts:
            made = F.array(*[turn(F.lit(role), joined(names)) for role, names in self.parts])
            return F.filter(made, lambda t: (t["role"] != "system") | (t["text"] != ""))
        if self.each is None:
            return F.array(one(record))
        return F.transform(record[self.each] if self.each else record, one)


def messages(fields: str) -> str:
    return f"array<struct<{fields}>>"


LAYOUTS = (
    Layout("turn", "role string, text string", text="text"),
    Layout("messages", f"messages {messages('role string, content string')}", "messages"),
    Layout("message list", messages("role string, content string"), ""),
    Layout("message parts", f"messages {messages('role string, content array<struct<type string, text string>>')}", "messages", text="content[].text"),
    Layout("from and value", f"conversations {messages('`from` string, value string')}", "conversations", "from", "value", speakers=SPEAKERS),
    Layout("prompt and completion", "prompt string, completion string", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", "prompt string, response string", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system, prompt and response", "system string, prompt string, response string", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction and output", "instruction string, output string", parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction, input and output", "instruction string, input string, output string", parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question and answer", "question string, answer string", parts=(("user", ("question",)), ("assistant", ("answer",)))),
)

#: What the schema of a VARIANT is made of: names of fields, opened and closed types, scalar types.
PARTS_OF_SCHEMA = re.compile(r"(?:`((?:[^`]|``)*)`|(\w+)): |(OBJECT<|ARRAY<)|(>)|(\w+)(?:\([^)]*\))?")


def paths_of_schema(schema: str) -> set[str]:
    """The paths of all values in a VARIANT's schema, such as ``messages[].role``. A value of several types ends in a star."""
    found, opened, now = set(), [""], ""
    for quoted, name, opens, closes, scalar in PARTS_OF_SCHEMA.findall(schema):
        if quoted or name:
            now = f"{opened[-1]}.{quoted.replace('``', '`') or name}".removeprefix(".")
        elif opens:
            now += "[]" if opens == "ARRAY<" else ""
            opened.append(now)
        elif closes:
            opened.pop()
        elif scalar:
            found.add(now + "*" * (scalar == "VARIANT"))
    return found


def paths_of_type(kind: T.DataType, at: str = "") -> set[str]:
    """The same for a type of Spark."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in paths_of_type(f.dataType, f"{at}.{f.name}".removeprefix("."))}
    if isinstance(kind, T.ArrayType):
        return paths_of_type(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


class Registry:
    """Layouts by their fingerprints. A list of turns may be empty: then it is all that a record shows."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.shapes: dict[str, Layout] = {}
        self.named: set[str] = set()
        for layout in layouts:
            for paths in [paths_of_type(layout.type)] + ([{f"{layout.each}[]"}] if layout.each is not None else []):
                self.named |= paths
                self.shapes.setdefault(fingerprint(paths), layout)

    def hashed(self, paths: set[str]) -> str:
        return fingerprint(paths & self.named)


def from_table(rows: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = (), registry: Registry | None = None) -> DataFrame:
    """(keep.., layout, turns) of a table whose columns ``fields`` are the record: one fingerprint for all rows."""
    registry = registry or Registry()
    columns = [rows[c] for c in fields]
    layout = registry.shapes.get(registry.hashed(paths_of_type(rows.select(*columns).schema)))
    if layout is None:
        raise ValueError(f"no layout has the fields {fields}")
    return rows.select(*[rows[c] for c in keep], F.lit(layout.name).alias("layout"), layout.turns(F.struct(*columns)).cast(TURNS).alias("turns"))


def from_json(rows: DataFrame, record: str, keep: tuple[str, ...] = (), registry: Registry | None = None) -> DataFrame:
    """(keep.., layout, turns) of records in JSON: each record's own fingerprint selects its layout."""
    registry = registry or Registry()

    @F.pandas_udf("string")
    def shape(schemas: pd.Series) -> pd.Series:
        hashed = functools.lru_cache(10_000)(lambda s: registry.hashed(paths_of_schema(s)))
        return schemas.map(hashed, na_action="ignore")

    parsed = rows.select(*[rows[c] for c in keep], F.try_parse_json(rows[record]).alias("_record"))
    parsed = parsed.withColumn("_shape", shape(F.schema_of_variant("_record")))
    name, turns = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(None).cast(TURNS))
    for hashed, layout in registry.shapes.items():
        typed = F.try_variant_get(F.col("_record"), "$", layout.type.simpleString())
        name = name.when(F.col("_shape") == hashed, F.lit(layout.name))
        turns = turns.when(F.col("_shape") == hashed, layout.turns(typed).cast(TURNS))
    return parsed.select(*keep, name.alias("layout"), turns.alias("turns"))


def assemble(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, turns): the turns of all rows of a conversation in their order."""
    sorted_ = F.sort_array(F.collect_list(F.struct(F.col(order), F.col("turns"))))
    return rows.groupBy(key).agg(F.flatten(F.transform(sorted_, lambda r: r["turns"])).alias("turns"))


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(turns: list[tuple[str, str]], learn: tuple[str, ...] = LEARN) -> tuple[str, list[tuple[int, int]]]:
    """The marked text of a conversation and the spans to learn."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"
        if role in learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def turns_of(text: str) -> list[tuple[str, str]]:
    """The turns that a marked text holds."""
    *blocks, rest = text.split(f"{END}\n")
    if rest or not all(b.startswith(START) for b in blocks):
        raise ValueError("not a formatted conversation")
    heads = (b[len(START) :].partition("\n") for b in blocks)
    return [(unescape_role(role), unescape(body)) for role, _, body in heads]


def mapped(rows: DataFrame, names: tuple[str, ...], one, schema: str) -> DataFrame:
    """Rows with further columns: ``one`` gets the values of the columns ``names`` and gives those of ``schema``."""
    added = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if f.dataType == T.StringType() else pa.list_(pa.struct([(x.name, pa.string() if x.dataType == T.StringType() else pa.int64()) for x in f.dataType.elementType])) for f in added]
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            made = [one(*values) for values in zip(*columns)]
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.names])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, *added.fields]))


def format(conversations: DataFrame, learn: tuple[str, ...] = LEARN) -> DataFrame:
    """The rows with ``formatted`` and ``loss_spans`` instead of ``turns``; null turns give nulls."""

    def one(turns: list[dict] | None):
        if turns is None:
            return None, None
        text, spans = formatted([(t["role"], t["text"]) for t in turns], learn)
        return text, [{"start": a, "stop": b} for a, b in spans]

    return mapped(conversations, ("turns",), one, f"formatted string, loss_spans {SPANS}").drop("turns")


def read(made: DataFrame) -> DataFrame:
    """The rows of ``format`` with ``turns`` and ``loss_text``, from the formatted text and its spans alone."""

    def one(text: str | None, spans: list[dict] | None):
        if text is None:
            return None, None
        return [{"role": r, "text": t} for r, t in turns_of(text)], "".join(unescape(text[s["start"] : s["stop"]]) for s in spans or ())

    return mapped(made, ("formatted", "loss_spans"), one, f"turns {TURNS}, loss_text string")
