"""Chat formatting with DataFrame and SQL functions only.

Records of any layout become variants. The field paths of each record, nested ones included, are hashed to a schema
fingerprint, which selects a declarative mapping into canonical turns (role, text). Turns are then written with a
template that marks each turn, escapes its control strings inside texts so that they can be restored, and notes which
characters are under the loss mask (the assistants' texts).

Template: ``<|turn|>ROLE\\nTEXT<|end|>\\n`` for each turn. In roles and texts a backslash is put before the bar wherever
``<``, any backslashes and ``|`` follow each other, which taking one backslash away undoes; in roles, backslashes and
newlines are escaped before that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. ``turns``: path of the list of turns, with the fields of role and text; or ``fixed``: role
    and field of each turn in order (a field may be absent or null where ``optional``); or one turn for each record."""

    name: str
    paths: tuple[str, ...]
    role: str = ""
    text: str = ""
    turns: str = ""
    turn: str = ""
    conversation: str = ""
    fixed: tuple[tuple[str, str], ...] = ()


LAYOUTS = [
    Layout("rows", ("conv_id", "turn", "role", "text"), role="role", text="text", turn="turn", conversation="conv_id"),
    Layout("messages", ("messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Layout("from-value", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Layout("instruction", ("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("instruction", "input", "output"), fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "completion"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Layout("system prompt", ("system", "prompt", "response"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("question", "answer"), fixed=(("user", "question"), ("assistant", "answer"))),
]
#: Names of speakers in lists of turns, as text, and the canonical roles. A row's role is kept as it is.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(record: Column) -> Column:
    """Sorted paths of a variant's fields: a.b for nested objects, a[].b for objects in lists; scalars' types don't count.

    Derived from the variant's own schema text, in which objects list their fields in order.
    """
    shape = F.regexp_replace(F.schema_of_variant(record), r": (?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP(?:_NTZ)?|BINARY|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>])", "")
    flat = F.regexp_replace(shape, r"^OBJECT<(.*)>$", "$1")
    lists = F.regexp_replace(flat, r": ARRAY<(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\(\d+,\d+\))>", "[]")
    return F.regexp_replace(lists, r", ", "|")


def _schema_shape(layout: Layout) -> str:
    """What ``field_paths`` gives for a record of the layout."""
    top = sorted(p for p in layout.paths if "[]" not in p)
    groups: dict[str, list[str]] = {}
    for p in layout.paths:
        if "[]" in p:
            head, tail = p.split("[].")
            groups.setdefault(head, []).append(tail)
    parts = top + [f"{h}: ARRAY<OBJECT<{'|'.join(sorted(t))}>>" for h, t in groups.items()]
    return "|".join(sorted(parts))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_turns(records: DataFrame, record: str, conv: str | None = None, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """conv, turn, role, text and layout of every turn of variant records.

    ``conv``: column that identifies a record's conversation where its layout has no such field. Records of an unknown
    layout, and null records, give one row with a null layout and null turn, so that nothing is lost unseen. Null texts
    become empty, null roles too; nulls in optional lists give no turns. Other columns of the records' table are ignored,
    whatever their names; an empty table gives no rows.
    """
    shape = fingerprint(field_paths(F.col(record)))
    get = lambda path, kind: F.try_variant_get(F.col(record), path, kind)
    role = lambda r: F.coalesce(*[F.when(r == k, F.lit(v)) for k, v in ROLES.items()], r, F.lit(""))
    turn = lambda at, who, said: F.struct(at.cast("bigint").alias("turn"), who.alias("role"), F.coalesce(said, F.lit("")).alias("text"))

    def listed(x: Layout):
        return lambda v, i: turn(i, role(F.try_variant_get(v, f"$.{x.role}", "string")), F.try_variant_get(v, f"$.{x.text}", "string"))

    turns = F.lit(None).cast("array<struct<turn: bigint, role: string, text: string>>")
    name, group = F.lit(None).cast("string"), F.col(conv).cast("bigint") if conv else F.lit(None).cast("bigint")
    for x in layouts:
        if x.turns:
            made = F.transform(get(f"$.{x.turns}", "array<variant>"), listed(x))
        elif x.fixed:
            made = F.array(*[turn(F.lit(i), F.lit(who), get(f"$.{field}", "string")) for i, (who, field) in enumerate(x.fixed)])
        else:
            made = F.array(turn(get(f"$.{x.turn}", "bigint"), F.coalesce(get(f"$.{x.role}", "string"), F.lit("")), get(f"$.{x.text}", "string")))
        here = shape == fingerprint(F.lit(_schema_shape(x)))
        turns, name = F.when(here, made).otherwise(turns), F.when(here, F.lit(x.name)).otherwise(name)
        if x.conversation:
            group = F.when(here, get(f"$.{x.conversation}", "bigint")).otherwise(group)
    return records.select(group.alias("conv_id"), name.alias("layout"), F.explode_outer(turns).alias("x")).select("conv_id", "layout", "x.turn", "x.role", "x.text")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    held = F.replace(F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\0")), F.lit("\\n"), F.lit("\n"))
    return F.replace(held, F.lit("\\\0"), F.lit("\\"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start and end code point, exclusive, of every assistant text) by conversation.

    Turns are ordered by (turn, role, text), nulls first, so that ties and repeated rows have one order. Rows whose layout
    is unknown are left out. A null conv_id is a conversation like any other. A conversation becomes one string, so one
    conversation must fit a task; its pieces meet there only after their lengths are summed by a window.
    """
    known = turns.filter(F.col("layout").isNotNull() & F.col("role").isNotNull())
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    pieces = known.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    order = ["turn", "role", "text"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    placed = pieces.withColumn("start", start.cast("bigint"))
    entry = F.struct("start", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", F.struct(F.col("start").alias("s"), (F.col("start") + F.length("body")).alias("e"))).alias("loss"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return grouped.select(
        "conv_id", F.array_join(F.transform("x", lambda p: p["piece"]), "").alias("formatted"),
        F.filter(F.transform("x", lambda p: p["loss"]), lambda p: p.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array of (role, text) read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda p, i: i > 0)
    role = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(parts, lambda p: F.struct(
        unescape_role(role(p)).alias("role"),
        unescape(F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))).alias("text"),
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["s"].cast("int") + 1, (s["e"] - s["s"]).cast("int")))), "")
