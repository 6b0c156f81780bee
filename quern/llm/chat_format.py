r"""Chat formatting by schema fingerprints.

A record is a JSON object in one of several layouts. Its schema, the paths of all its nested fields with their types, is read
from the record less its texts, at any depth. The paths are hashed; the hash selects a declarative mapping that turns the
record into canonical turns; a record with further fields is mapped by the layout whose paths it has. A template writes the
turns as one string and says which code points are under the loss mask. Only DataFrame expressions are used.

Template, for each turn: <|im_start|>role\ntext<|im_end|>\n. Inside roles and texts a backslash is doubled and "<|" becomes
"<\|", so no control string can appear there; in roles a newline becomes "\n". parse() undoes it exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How one layout gives turns.

    paths are those of its texts, as field_paths() writes them: a list element is []; a text may be null. optional ones may be
    absent. messages = (path of the list, role field, text field, or its path in a list of parts), or fields =
    ((role, (path, ...)), ...): one turn for each role, its texts joined by a blank line. An optional system field goes first.
    roles renames role values.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


# The layouts known by default.
LAYOUTS = [
    Layout("messages", ("messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Layout("parts", ("messages[].content[].text", "messages[].role"), ("messages[].content[].type",), messages=("messages", "role", "content[].text")),
    Layout("turns", ("turns[].role", "turns[].text"), messages=("turns", "role", "text")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("system",), messages=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("instruction", "output"), ("input", "system"), fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "completion"), ("system",), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), ("system",), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("asked", ("prompt",), ("system",), fields=(("system", ("system",)), ("user", ("prompt",)))),
    Layout("nested", ("data.prompt", "data.response"), fields=(("user", ("data.prompt",)), ("assistant", ("data.response",)))),
]

_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PARTS = rf"({_TEXT}\s*+:|[\[\]{{}},]|[^\s\"\[\]{{}},:]++)|{_TEXT}"
_NAMES = r"`(?:[^`]|``)*+`:|[^\s<>,:`]++:|[^\s<>,:`]++<|>|[^\s<>,:`]++"
LONG_TEXTS = {"maxStringLen": str(2**31 - 1)}  # the parser's own limit is 20 million characters


def skeleton(record: Column) -> Column:
    """The record's JSON with every text replaced by an empty one."""
    return F.array_join(F.transform(F.regexp_extract_all(record, F.lit(_PARTS), 1), lambda t: F.when(t == "", '""').otherwise(t)), "")


def schema_of(record: Column) -> Column:
    """The nested fields and their types, lists merged; null for null, for what is no JSON object, and for fields that come twice."""
    parsed = F.schema_of_variant(F.try_parse_json(skeleton(record)))
    return F.when(parsed.startswith("OBJECT<"), parsed)


def field_paths(schema: Column) -> Column:
    """Sorted paths of a schema's innermost fields, at any depth, as path:TYPE; a list element is written [], an empty object OBJECT."""
    joined = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("."), b))
    top = lambda s: F.element_at(s["open"], -1)
    at = lambda s: F.when(s["key"].isNull(), top(s)).otherwise(joined(top(s), s["key"]))
    state = lambda s, opened, key, paths: F.struct(opened.alias("open"), key.cast("string").alias("key"), paths.alias("paths"), F.size(paths).alias("n"))

    def step(s: Column, t: Column) -> Column:
        name = F.when(t.startswith("`"), F.replace(F.substr(t, F.lit(2), F.length(t) - 3), F.lit("``"), F.lit("`"))).otherwise(F.substr(t, F.lit(1), F.length(t) - 1))
        none = F.lit(None).cast("string")
        return (
            F.when(t.endswith(":"), state(s, s["open"], name, s["paths"]))
            .when(t == "OBJECT<", state(s, F.array_append(s["open"], at(s)), none, s["paths"]))
            .when(t == "ARRAY<", state(s, F.array_append(s["open"], F.concat(at(s), F.lit("[]"))), none, s["paths"]))
            .when((t == ">") & s["paths"].isNotNull(), state(s, F.slice(s["open"], 1, F.size(s["open"]) - 1), none, s["paths"]))
            .otherwise(state(s, s["open"], none, F.array_append(s["paths"], F.concat(at(s), F.lit(":"), t))))
        )

    # An empty object has no field of its own; it gets one.
    filled = F.regexp_replace(F.replace(schema, F.lit("OBJECT<>"), F.lit("OBJECT")), r"DECIMAL\([0-9]+,[0-9]+\)", "DECIMAL")
    empty = state(None, F.array(F.lit("")), F.lit(None), F.array().cast("array<string>"))
    found = F.aggregate(F.regexp_extract_all(filled, F.lit(_NAMES), 0), empty, step, lambda s: s["paths"])
    return F.array_sort(F.array_distinct(found))


def fingerprint(paths: Column) -> Column:
    """Hash of the sorted paths and types."""
    return F.sha2(F.array_join(paths, "\n"), 256)


def _typed(path: str) -> list[str]:
    return [f"{path}:STRING", f"{path}:VOID"]


def _prints(layout: Layout) -> list[str]:
    """Fingerprints that the layout covers: its own paths with each choice of optional ones and of nulls, and an empty list."""
    sets: list[list[str]] = [[]]
    for path in layout.paths:
        sets = [[*s, t] for s in sets for t in _typed(path)]
    for path in layout.optional:
        sets += [[*s, t] for s in sets for t in _typed(path)]
    if layout.messages:
        sets += [[f"{layout.messages[0]}[]:VOID"]] + [[f"{layout.messages[0]}[]:VOID", t] for p in layout.optional if "[" not in p for t in _typed(p)]
    return [hashlib.sha256("\n".join(sorted(s)).encode()).hexdigest() for s in sets]


def layout_of(paths: Column, printed: Column, layouts: list[Layout]) -> Column:
    """The name of the layout whose fingerprint it is; else of the first whose paths are all among these, as texts or nulls."""
    exact = [F.when(printed.isin(_prints(lay)), F.lit(lay.name)) for lay in layouts]
    has = lambda p: F.arrays_overlap(paths, F.array(*map(F.lit, _typed(p))))
    more = [F.when(reduce(lambda a, b: a & b, map(has, lay.paths)), F.lit(lay.name)) for lay in layouts]
    return F.coalesce(*exact, *more)


def _turns(record: Column, layout: Layout) -> Column:
    role_of = F.create_map(*[F.lit(x) for kv in layout.roles.items() for x in kv]) if layout.roles else None
    named = lambda r: F.coalesce(role_of[r], r) if role_of is not None else r
    if layout.messages:
        path, role, text = layout.messages
        inner, _, part = text.partition("[].")
        kind = f"array<struct<`{part}`:string>>" if part else "string"
        parsed = F.from_json(record, f"`{path}` array<struct<`{role}`:string,`{inner}`:{kind}>>, `system` string", LONG_TEXTS)
        said = lambda m: F.array_join(F.transform(m[inner], lambda p: p[part]), "") if part else m[inner]
        body = F.transform(parsed[path], lambda m: F.struct(F.coalesce(named(m[role]), F.lit("")).alias("role"), F.coalesce(said(m), F.lit("")).alias("text")))
        if "system" not in layout.optional:
            return body
        system = F.array(F.struct(F.lit("system").alias("role"), parsed["system"].alias("text")))
        return F.concat(F.when(parsed["system"].isNotNull(), system).otherwise(F.array().cast(TURNS)), body)
    tops: dict[str, list[str]] = {}
    for path in (p for _, paths in layout.fields for p in paths):
        head, _, rest = path.partition(".")
        tops.setdefault(head, []).append(rest)
    parsed = F.from_json(record, ", ".join(f"`{h}` struct<{','.join(f'`{r}`:string' for r in rest)}>" if rest[0] else f"`{h}` string" for h, rest in tops.items()), LONG_TEXTS)
    turn = lambda role, paths: F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[reduce(lambda c, k: c[k], p.split("."), parsed) for p in paths]), lambda t: t.isNotNull() & (t != "")), "\n\n").alias("text"))
    listed = F.array(*[turn(role, paths) for role, paths in layout.fields])
    return F.filter(listed, lambda t: (t["role"] != "system") | (t["text"] != ""))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undo escape and escape_role: split at doubled backslashes, which end no other escape, then undo the rest."""
    undo = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), undo), "\\")


def render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column, trained: str = "assistant") -> Column:
    """(start, end) code points of the trained role's texts in what render() writes."""
    begin = lambda at, t: at + len(START) + F.length(escape_role(t["role"])) + 1
    step = lambda s, t: F.struct(
        (begin(s["at"], t) + F.length(escape(t["text"])) + len(END)).alias("at"),
        F.when(t["role"] == trained, F.array_append(s["spans"], F.struct(begin(s["at"], t).alias("start"), (begin(s["at"], t) + F.length(escape(t["text"]))).alias("end")))).otherwise(s["spans"]).alias("spans"),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted string."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)  # before the first mark is nothing
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text"),
    )
    return F.transform(pieces, turn)


def format_chats(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: list[Layout] = LAYOUTS, trained: str = "assistant") -> DataFrame:
    """(id_col, fingerprint, layout, turns, formatted, loss_spans), a row for each record.

    A record that no layout covers, a null or one that is no JSON object keeps its row, with null layout, turns, formatted and
    loss_spans (and null fingerprint, if it has no schema). Fields beyond a layout's are left out, empty lists give no turns,
    a message with null role or text has an empty one, texts may have any length. Repeated rows are formatted each; an empty
    table gives an empty one; other input columns are not carried.
    """
    df = records.select(F.col(id_col).alias(id_col), F.col(record_col).alias("_record"))
    df = df.withColumn("_schema", schema_of(F.col("_record"))).withColumn("_paths", field_paths(F.col("_schema")))
    df = df.withColumn("fingerprint", fingerprint(F.col("_paths")))
    df = df.withColumn("layout", layout_of(F.col("_paths"), F.col("fingerprint"), layouts))
    turns = F.coalesce(*[F.when(F.col("layout") == lay.name, _turns(F.col("_record"), lay)) for lay in layouts])
    df = df.withColumn("turns", turns)
    return df.select(id_col, "fingerprint", "layout", "turns", render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns"), trained).alias("loss_spans"))


def records_of_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, record): a JSON object for each conversation, from rows by turn.

    One turn of a user and one of an assistant are a prompt with its response; a system turn before turns of users and
    assistants is a field of its own; all else is a list of messages. Order: turn, nulls first, then role and text, so that
    ties give the same result each time. Null roles and texts are empty, a null id is one conversation. A conversation is one
    row of output and so is gathered whole, as any format of it must be; an empty table gives an empty one; other columns,
    whatever their names, are not carried.
    """
    rows = conversations.select(F.col(id_col).alias(id_col), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    message = F.struct(F.col("_turn").alias("turn"), F.coalesce("_role", F.lit("")).alias("role"), F.coalesce("_text", F.lit("")).alias("content"))
    listed = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(message)).alias("_rows"))
    said = F.transform("_rows", lambda r: r["role"])
    text = lambda i: F.get("_rows", F.lit(i))["content"]
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    spoken = lambda r: F.struct(F.when(r["role"] == "user", "human").otherwise("gpt").alias("from"), r["content"].alias("value"))
    rest = F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))
    with_system = F.to_json(F.struct(text(0).alias("system"), F.transform(rest, spoken).alias("conversations")))
    has_system = (F.size("_rows") > 1) & (F.get(said, F.lit(0)) == "system") & F.forall(rest, lambda r: r["role"].isin("user", "assistant"))
    body = F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    record = F.when(said == F.array(F.lit("user"), F.lit("assistant")), pair).when(has_system, with_system).otherwise(F.to_json(F.struct(body.alias("messages"))))
    return listed.select(id_col, record.alias("record"))
