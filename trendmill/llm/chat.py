"""Chat records of several layouts brought into one, formatted with a loss mask, and read back.

A layout is recognised by the hash of its nested field paths.  Each known layout has a declarative
mapping: where the conversation's id and its turns are.  Everything is a DataFrame expression.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: What a text may not contain as it is: this template's marks and those of common others.
_CONTROL = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"

#: Roles as they are called in the wild; others stay as they are.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Mappings by layout.  rows: one row per turn; turns: arrays of structs, one after the other, with the fields of role and
#: text; pairs: columns with their roles, after the turns.  A text made of parts has its texts put together.  Of a preference
#: pair the chosen answer is the conversation.
LAYOUTS = {
    "turn_rows": {"paths": ["conv_id", "role", "text", "turn"], "rows": ("conv_id", "turn", "role", "text")},
    "messages": {"paths": ["messages", "messages.content", "messages.role"], "turns": [("messages", "role", "content")]},
    "message_parts": {"paths": ["messages", "messages.content", "messages.content.text", "messages.role"],
                      "turns": [("messages", "role", "content")]},
    "wrapped": {"paths": ["data", "data.messages", "data.messages.content", "data.messages.role"],
                "turns": [("data.messages", "role", "content")]},
    "sharegpt": {"paths": ["conversations", "conversations.from", "conversations.value"],
                 "turns": [("conversations", "from", "value")]},
    "instruction": {"paths": ["instruction", "output"], "pairs": [("user", ["instruction", "input"]),
                                                                  ("assistant", ["output"])]},
    "prompt": {"paths": ["completion", "prompt"], "pairs": [("system", ["system"]), ("user", ["prompt"]),
                                                            ("assistant", ["completion"])]},
    "chat_prompt": {"paths": ["completion", "prompt", "prompt.content", "prompt.role"],
                    "turns": [("prompt", "role", "content")], "pairs": [("assistant", ["completion"])]},
    "chat_completion": {"paths": ["completion", "completion.content", "completion.role",
                                  "prompt", "prompt.content", "prompt.role"],
                        "turns": [("prompt", "role", "content"), ("completion", "role", "content")]},
    "preference": {"paths": ["chosen", "prompt", "rejected"], "pairs": [("user", ["prompt"]), ("assistant", ["chosen"])]},
    "chat_preference": {"paths": ["chosen", "chosen.content", "chosen.role", "rejected", "rejected.content", "rejected.role"],
                        "turns": [("chosen", "role", "content")]},
    "question": {"paths": ["answer", "question"], "pairs": [("user", ["question"]), ("assistant", ["answer"])]},
}

#: Layouts with more paths are tried first.
_TRIED = sorted(LAYOUTS, key=lambda name: (-len(LAYOUTS[name]["paths"]), name))


def _leaves(layout: dict) -> list[str]:
    """Paths that hold a value as it is, optional ones too: nothing may be nested below them."""
    every = {*layout["paths"], *(f for _, fields in layout.get("pairs", []) for f in fields)}
    return sorted(p for p in every if not any(q.startswith(f"{p}.") for q in every))


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths in order; arrays add no step."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix)
    if not isinstance(schema, T.StructType):
        return []
    found = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        found += [path, *field_paths(field.dataType, f"{path}.")]
    return sorted(found)


def fingerprint(paths: list[str]) -> int:
    return zlib.crc32("\n".join(sorted(paths)).encode())


FINGERPRINTS = {fingerprint(layout["paths"]): name for name, layout in LAYOUTS.items()}


def layout_of(schema: T.StructType) -> str:
    """The layout with this schema's fingerprint; paths that no layout knows don't count unless they lie below a value."""
    paths = field_paths(schema)
    for name in _TRIED:
        layout = LAYOUTS[name]
        known = [p for p in paths if p in layout["paths"]]
        nested = any(p.startswith(f"{leaf}.") for p in paths for leaf in _leaves(layout))
        if FINGERPRINTS.get(fingerprint(known)) == name and not nested:
            return name
    raise ValueError(f"no mapping for a layout with the paths {paths}")


def record_paths(shape: Column) -> Column:
    """Nested field paths in a variant's schema text, as an array; arrays add no step.

    The text is read as names and brackets: a bracket opens the level of the last name, or closes one.
    """
    signs = F.regexp_extract_all(shape, F.lit(r"(`(?:[^`]|``)*`(?=: )|\w+(?=: )|[<>])"), 1)
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("last"), F.array().cast("array<string>").alias("paths"))

    def step(state, sign):
        stack, last, paths = state["stack"], state["last"], state["paths"]
        path = F.concat(F.element_at(stack, -1), F.replace(F.btrim(sign, F.lit("`")), F.lit("``"), F.lit("`")))
        below = F.when(last == "", F.lit("")).otherwise(F.concat(last, F.lit(".")))
        opened = F.struct(F.array_append(stack, below).alias("stack"), last.alias("last"), paths.alias("paths"))
        closed = F.struct(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(1))).alias("stack"), last.alias("last"),
                          paths.alias("paths"))
        named = F.struct(stack.alias("stack"), path.alias("last"), F.array_append(paths, path).alias("paths"))
        return F.when(sign == "<", opened).when(sign == ">", closed).otherwise(named)

    return F.array_sort(F.array_distinct(F.aggregate(signs, start, step, lambda state: state["paths"])))


def _layout_by_paths(paths: Column) -> Column:
    """``layout_of`` for an array of paths; null if no layout has the fingerprint."""
    name_of = F.lit(None).cast("string")
    for name in reversed(_TRIED):
        layout = LAYOUTS[name]
        if "rows" in layout:
            continue
        known = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, layout["paths"]))))
        same = F.crc32(F.array_join(known, "\n").cast("binary")) == fingerprint(layout["paths"])
        nested = F.exists(paths, lambda p: F.greatest(*(p.startswith(f"{leaf}.") for leaf in _leaves(layout)), F.lit(False)))
        name_of = F.when(same & ~nested, F.lit(name)).otherwise(name_of)
    return name_of


def _role(column: Column) -> Column:
    out = F.coalesce(column.cast("string"), F.lit(""))
    for name, role in ROLES.items():
        out = F.when(out == name, role).otherwise(out)
    return out


def canonical_turns(df: DataFrame, ident: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text), one row per turn, from a table in any known layout.

    Null text is empty, null roles too.  A layout without ids keeps the column ``ident`` if there is one.
    """
    layout = LAYOUTS[layout_of(df.schema)]
    if "rows" in layout:
        key, turn, role, text = layout["rows"]
        return df.select(F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                         _role(F.col(role)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.col(ident) if ident in df.columns else F.lit(None).cast("long")
    return (df.select(key.alias("conv_id"), F.posexplode(_in_order(
        _column_turns(layout, df.schema) + _pair_turns(layout, df.columns, lambda f: F.col(f).cast("string")))).alias("turn", "t"))
            .select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("t.role")).alias("role"),
                    F.coalesce(F.col("t.text"), F.lit("")).alias("text")))


def _joined_parts(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"].cast("string")), "")


def _struct_turn(role: str, text: str, made: bool):
    return lambda m: F.struct(m[role].cast("string").alias("role"),
                              (_joined_parts(m[text]) if made else m[text].cast("string")).alias("text"))


def _column_turns(layout: dict, schema: T.StructType) -> list[Column]:
    """The layout's arrays of (role, text) from columns; a text may be an array of parts."""
    arrays = []
    for field, role, text in layout.get("turns", []):
        element = schema
        for name in field.split("."):
            element = element[name].dataType
        made = isinstance(element.elementType[text].dataType, T.ArrayType)
        arrays.append(F.transform(F.col(field), _struct_turn(role, text, made)))
    return arrays


def _pair_turns(layout: dict, names: list[str], at) -> list[Column]:
    """The layout's columns as one array of (role, text); columns that are null make no turn."""
    turns = []
    for role, fields in layout.get("pairs", []):
        parts = [at(f) for f in fields if f in names]
        if parts:
            text = F.concat_ws("\n", *(F.when(p != "", p) for p in parts))
            given = F.greatest(*(p.isNotNull() for p in parts)) if len(parts) > 1 else parts[0].isNotNull()
            turns.append(F.when(given, F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return [F.filter(F.array(*turns), lambda t: t.isNotNull())] if turns else []


_TURNS = "array<struct<role:string,text:string>>"


def _in_order(arrays: list[Column]) -> Column:
    """Arrays of turns one after the other; a null array has none."""
    return F.concat(*(F.coalesce(a.cast(_TURNS), F.array().cast(_TURNS)) for a in arrays))


def canonical_from_json(df: DataFrame, record: str = "record", ident: str = "conv_id") -> DataFrame:
    """Canonical turns of JSON records whose layouts differ from row to row.

    The nested paths come from each record's own variant schema; their hash picks the row's mapping.  Returns conv_id,
    layout, turn, role, text.  A record of no known layout, one that is no JSON and one without turns give one row with
    null turn, the first two with null layout.  Null ids stay; repeated records each give their rows; an empty table gives none.
    """
    parsed = df.select(F.col(ident).alias("conv_id"), F.try_parse_json(F.col(record)).alias("v"))
    shaped = parsed.withColumn("layout", _layout_by_paths(record_paths(F.schema_of_variant("v"))))
    turns = F.lit(None).cast(_TURNS)
    for name, spec in LAYOUTS.items():
        if "rows" in spec:
            continue
        arrays = [F.transform(F.try_variant_get("v", f"$.{field}", "array<variant>"), _variant_turn(role, text))
                  for field, role, text in spec.get("turns", [])]
        fields = [f for _, fs in spec.get("pairs", []) for f in fs]
        arrays += _pair_turns(spec, fields, lambda f: F.try_variant_get("v", f"$.{f}", "string"))
        turns = F.when(F.col("layout") == name, _in_order(arrays)).otherwise(turns)
    return (shaped
            .select("conv_id", "layout", F.posexplode_outer(turns).alias("turn", "t"))
            .select("conv_id", "layout", F.col("turn").cast("long").alias("turn"),
                    F.when(F.col("turn").isNotNull(), _role(F.col("t.role"))).alias("role"),
                    F.when(F.col("turn").isNotNull(), F.coalesce(F.col("t.text"), F.lit(""))).alias("text")))


def _variant_turn(role: str, text: str):
    """(role, text) of a variant message; a text that is a list of parts is their texts put together."""
    def turn(m):
        parts = F.try_variant_get(m, f"$.{text}", "array<variant>")
        joined = F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), "")
        return F.struct(F.try_variant_get(m, f"$.{role}", "string").alias("role"),
                        F.when(parts.isNotNull(), joined).otherwise(F.try_variant_get(m, f"$.{text}", "string")).alias("text"))
    return turn


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first sign of every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, n_turns) from canonical turns.

    Each turn becomes mark, role, mark, text, mark with control strings escaped; loss_spans has
    (start from 0, length) in code points of each ``trained`` role's text.  Turns are formatted as
    rows before they meet; a conversation's string is one value, so its turns end in one task.
    Turns that tie come by role and text; null turns come last; rows of a null id are one conversation.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    pieces = turns.select("conv_id", "turn", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    before = (Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "body")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(before), F.lit(0))
    piece = F.struct(F.col("start").cast("int").alias("start"), "role", "head", "body")
    gathered = (pieces.withColumn("start", start).groupBy("conv_id")
                .agg(F.array_sort(F.collect_list(piece)).alias("turns")))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == trained),
                        lambda t: F.struct((t["start"] + F.length(t["head"])).alias("start"),
                                           F.length(t["body"]).alias("length")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return gathered.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"),
                           F.size("turns").cast("long").alias("n_turns"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted string."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p.startswith(OPEN))
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), MIDDLE, 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, MIDDLE, 1)) + len(MIDDLE) + 1, F.length(p)))
        .alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, spans joined with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
