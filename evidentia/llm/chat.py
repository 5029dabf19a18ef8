"""Chat formatting by schema fingerprints, in SQL functions only.

A record is a VARIANT of any shape. Its nested field paths (two levels, arrays as ``[]``), without the types of
their leaves, are hashed to a fingerprint; the fingerprint selects a declarative mapping (``Layout``) that says
where the turns, roles and texts are. A record with fields that no layout knows has a fingerprint of its own; it
gets the layout with the most paths among those whose paths it has all. Records that fit no layout are not
dropped: ``unmatched`` gives them with their fingerprint.

Canonical turns are written as ``### role: text</turn>\\n``. Inside roles and texts a
backslash is doubled and control strings are broken by one (``#\\##``, ``<\\/turn>``), so that no text can
end a turn, and taking away one backslash before any character gives the text back. A loss mask holds the
spans of the assistant's texts.

Defined results: ids are strings, whatever their type (1 and "1" are one conversation). Turns are ordered by their
position, then role, then text; equal rows are separate turns. A null role or text is empty, one that is an object
or array is its JSON. Null or missing ids form one conversation. A conversation without a turn (an empty array) is
unmatched. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
TURNS = "array<struct<pos:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``needs``: the paths that a record must have; ``may``: paths that the mapping reads where they are there.

    Turns are an array at ``turns`` with fields ``role`` and ``text``; or the record is one turn at
    ``position``; or each of ``fixed`` is a role and the fields whose texts, joined by a blank line, it says.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ("id",)
    id: str = "id"
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    position: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = field(default=())

    def fingerprints(self) -> list[str]:
        """Of records that have what the layout needs and any of what it may read, and nothing else."""
        some = chain.from_iterable(combinations(self.may, n) for n in range(len(self.may) + 1))
        return [hashlib.sha256("\n".join(sorted((*self.needs, *x))).encode()).hexdigest()[:16] for x in some]

    def _role(self, role: Column) -> Column:
        out = F.coalesce(role, F.lit(""))
        for old, new in self.roles:
            out = F.when(role == old, F.lit(new)).otherwise(out)
        return out

    def canonical(self, record: Column) -> Column:
        """The record's turns as an array."""
        get = lambda v, name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
        turn = lambda pos, v: F.struct(pos.alias("pos"), self._role(get(v, self.role)).alias("role"), F.coalesce(get(v, self.text), F.lit("")).alias("text"))
        if self.position:
            return F.array(turn(get(record, self.position, "bigint"), record))
        if self.turns:
            return F.transform(get(record, self.turns, "array<variant>"), lambda v, i: turn(i.cast("long"), v))
        said = []
        for i, (role, names) in enumerate(self.fixed):
            parts = F.filter(F.array(*(get(record, n) for n in names)), lambda x: x.isNotNull() & (x != ""))
            said.append(F.struct(F.lit(i).cast("long").alias("pos"), F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
        return F.array(*said)


LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), may=(), id="conv_id", position="turn", text="text"),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), turns="messages"),
    Layout("from and value", ("conversations", "conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", ("instruction", "output"), may=("id", "input"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt and completion", ("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system, prompt and response", ("prompt", "response", "system"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def paths(record: Column) -> Column:
    """The record's field paths, sorted; none for what is no object."""
    keys = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    none = F.array().cast("array<string>")
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    inner = lambda v: F.coalesce(
        F.transform(keys(v), lambda f: F.concat(F.lit("."), f)),
        F.flatten(F.transform(items(v), lambda x: F.transform(F.coalesce(keys(x), none), lambda f: F.concat(F.lit("[]."), f)))), none)
    fields = F.map_entries(F.try_variant_get(record, "$", "map<string,variant>"))
    each = F.transform(fields, lambda e: F.concat(F.array(e["key"]), F.transform(F.array_distinct(inner(e["value"])), lambda f: F.concat(e["key"], f))))
    return F.array_sort(F.array_distinct(F.flatten(F.coalesce(each, F.array().cast("array<array<string>>")))))


def fingerprint(record: Column) -> Column:
    return F.substring(F.sha2(F.array_join(paths(record), "\n"), 256), 1, 16)


def _mapped(records: DataFrame, record_col: str, layouts: tuple[Layout, ...]) -> DataFrame:
    """(record, print, layout, conv_id, turns); layout is null where none fits."""
    known = records.select(F.col(record_col).alias("record"), paths(F.col(record_col)).alias("paths"))
    known = known.withColumn("print", F.substring(F.sha2(F.array_join("paths", "\n"), 256), 1, 16))
    layout = F.lit(None).cast("string")
    for x in sorted(layouts, key=lambda x: len(x.needs)):
        layout = F.when(F.size(F.array_except(F.array(*map(F.lit, x.needs)), "paths")) == 0, F.lit(x.name)).otherwise(layout)
    for x in layouts:
        layout = F.when(F.col("print").isin(x.fingerprints()), F.lit(x.name)).otherwise(layout)
    known = known.withColumn("layout", layout)
    pick = lambda values, kind: reduce(lambda out, xv: F.when(F.col("layout") == xv[0].name, xv[1]).otherwise(out), zip(layouts, values), F.lit(None).cast(kind))
    ids = pick([F.try_variant_get("record", f"$.{x.id}", "string") for x in layouts], "string")
    return known.select("record", "print", "layout", ids.alias("conv_id"), pick([x.canonical(F.col("record")) for x in layouts], TURNS).alias("turns"))


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, pos, role, text, layout), one row a turn, whatever the shape of the record."""
    return _mapped(records, record_col, layouts).select("conv_id", "layout", F.explode("turns").alias("t")).select("conv_id", "t.pos", "t.role", "t.text", "layout")


def unmatched(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(record, fingerprint, paths) of the records that ``canonical_turns`` gives no turn of."""
    rest = _mapped(records, record_col, layouts).filter("coalesce(size(turns), 0) <= 0")
    return rest.select("record", F.col("print").alias("fingerprint"), paths(F.col("record")).alias("paths"))


def escape(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "#(?=##)", r"#\\"), F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\#:<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): mask holds (start, length) in characters of what the model is to learn."""
    head = F.concat(F.lit(OPEN), escape_role("role"), F.lit(ROLE_END))
    written = turns.select("conv_id", "pos", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    written = written.withColumn("said", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("pos", "role", "text")
    placed = written.select(
        "conv_id", F.row_number().over(order).alias("n"), "said",
        (F.coalesce(F.sum(F.length("said")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")).alias("start"),
        F.when(F.col("role") == LOSS_ROLE, F.length("body")).alias("length"),
    )
    all_turns = F.array_sort(F.collect_list(F.struct("n", "said", "start", "length")))
    grouped = placed.groupBy("conv_id").agg(all_turns.alias("turns"))
    learnt = F.transform(F.filter("turns", lambda t: t["length"].isNotNull()), lambda t: F.struct(t["start"].alias("start"), t["length"].cast("long").alias("length")))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"), learnt.alias("mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, learnt): turns as (role, text) and the unescaped texts under the mask, read from the formatted text."""
    said = F.slice(F.split("formatted", CLOSE, -1), F.lit(1), F.size(F.split("formatted", CLOSE, -1)) - 1)
    form = r"(?s)^### ((?:[^:\\]|\\.)*+): (.*)$"
    turns = F.transform(said, lambda x: F.struct(unescape(F.regexp_extract(x, form, 1)).alias("role"), unescape(F.regexp_extract(x, form, 2)).alias("text")))
    learnt = F.transform("mask", lambda m: unescape(F.col("formatted").substr((m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return chats.select("conv_id", "formatted", turns.alias("turns"), learnt.alias("learnt"))
