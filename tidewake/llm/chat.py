"""Chat formatting by schema fingerprint.

A record's nested field paths, without their types, are hashed; the hash selects a declarative
mapping (which path holds the turns, which the role and the text, or which fields make which
turn). New layouts are added as data, not code. All steps are built-in functions.

Template, per turn: ``<turn>`` role newline text ``</turn>`` newline. Inside roles and texts a
backslash becomes ``\\b``, the first character of a control string ``<turn`` or ``</turn`` becomes
``\\l``, every ``#`` that two more follow becomes ``\\h`` (so none of the control strings ``###``
of a longer run is left), and in roles a newline becomes ``\\e``: every backslash is followed by
one of these letters, so the way back is unambiguous and no text can forge a marker.

Defined results: null roles and texts count as empty; turns go by their number, nulls last, ties
by role and text; repeated rows are repeated turns; rows without a conversation id form one
conversation; a record of an unknown layout keeps its row with a null layout and no turns; extra
columns are ignored; an empty table gives an empty table. A conversation is one string by
definition, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"

#: Turns under ``path``, an array of objects with these role and text fields; ``names`` renames roles.
#: ``turns``: one turn for each (role, field), left out where the field is null.
#: ``order``: the record is one turn; this field numbers it, and ``turns`` names its role and text fields.
MAPPINGS: list[dict] = [
    {"layout": "messages", "path": "messages", "role": "role", "text": "content"},
    {"layout": "turn_row", "order": "turn", "turns": [("role", "text")]},
    {"layout": "sharegpt", "path": "conversations", "role": "from", "text": "value", "names": {"human": "user", "gpt": "assistant"}},
    {"layout": "completion", "turns": [("user", "prompt"), ("assistant", "completion")]},
    {"layout": "response", "turns": [("user", "prompt"), ("assistant", "response")]},
    {"layout": "instruction", "turns": [("user", "instruction"), ("assistant", "output")]},
    {"layout": "instruction_input", "turns": [("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"layout": "system_instruction", "turns": [("system", "system"), ("user", "instruction"), ("assistant", "output")]},
]


def paths_of(mapping: dict) -> str:
    """The field paths of a mapping, written as ``schema_paths`` writes a record's."""
    if "path" in mapping:
        return f"OBJECT<{mapping['path']}:ARRAY<OBJECT<{','.join(f'{f}:' for f in sorted((mapping['role'], mapping['text'])))}>>>"
    fields = {f for _, f in mapping["turns"]}
    if "order" in mapping:
        fields |= {mapping["order"], *(f for f, _ in mapping["turns"])}
    return f"OBJECT<{','.join(f'{f}:' for f in sorted(fields))}>"


def schema_paths(record: Column) -> Column:
    """Nested field paths of a variant, sorted, without scalar types: ``OBJECT<messages:ARRAY<OBJECT<content:,role:>>>``."""
    return F.replace(F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT|ARRAY)[A-Z_]+(?:\(\d+, ?\d+\))?", ":"), F.lit(" "), F.lit(""))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_turns(df: DataFrame, record: Column, id_col: str = "conv_id") -> DataFrame:
    """conv_id, layout, ord, pos, role, text from variant records of any known layout.

    ``record`` is a variant: ``try_parse_json`` of a JSON text or ``to_variant_object`` of typed
    columns. ``ord`` is the record's own turn number where its layout has one, ``pos`` the turn's
    place in the record; an unknown layout gives one row with null layout and pos.
    """
    source = df.select(F.col(id_col).alias("conv_id"), record.alias("record"))
    source = source.withColumn("print", fingerprint(schema_paths(F.col("record"))))
    layout, order = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in MAPPINGS:
        hit = F.col("print") == fingerprint(F.lit(paths_of(m)))
        if "path" in m:
            found = F.try_variant_get("record", f"$.{m['path']}", f"array<struct<`{m['role']}`:string,`{m['text']}`:string>>")
            found = F.transform(found, _reader(m))
        elif "order" in m:
            (role, text), = m["turns"]
            found = F.array(_turn(F.try_variant_get("record", f"$.{role}", "string"), F.try_variant_get("record", f"$.{text}", "string"), {}))
            order = F.when(hit, F.try_variant_get("record", f"$.{m['order']}", "bigint")).otherwise(order)
        else:
            fields = [F.struct(F.lit(role).alias("role"), F.try_variant_get("record", f"$.{f}", "string").alias("text")) for role, f in m["turns"]]
            found = F.filter(F.array(*fields), lambda x: x["text"].isNotNull())
        layout = F.when(hit, F.lit(m["layout"])).otherwise(layout)
        turns = F.when(hit, found).otherwise(turns)
    flat = source.select("conv_id", layout.alias("layout"), order.alias("ord"), F.posexplode_outer(turns).alias("pos", "turn"))
    return flat.select("conv_id", "layout", "ord", "pos", "turn.role", "turn.text")


def _reader(mapping: dict):
    return lambda x: _turn(x[mapping["role"]], x[mapping["text"]], mapping.get("names", {}))


def _turn(role: Column, text: Column, names: dict[str, str]) -> Column:
    named = F.coalesce(role, F.lit(""))
    for old, new in names.items():
        named = F.when(role == old, F.lit(new)).otherwise(named)
    return F.struct(named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turn_rows(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Canonical turns of a table with one row for each turn: each row is a record of the ``turn_row`` layout."""
    record = F.to_variant_object(F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    return canonical_turns(df, record, id_col)


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for plain, kept in (("<turn", "\\lturn"), ("</turn", "\\l/turn")):
        out = F.replace(out, F.lit(plain), F.lit(kept))
    out = F.regexp_replace(out, "#(?=##)", r"\\h")
    return F.replace(out, F.lit("\n"), F.lit("\\e")) if role else out


def unescape(text: Column) -> Column:
    out = text
    for kept, plain in (("\\l", "<"), ("\\h", "#"), ("\\e", "\n"), ("\\b", "\\")):
        out = F.replace(out, F.lit(kept), F.lit(plain))
    return out


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, layout, formatted, loss_spans: one string per conversation of canonical turns.

    loss_spans lists (start, length) in code points, from 1, of what the loss covers: the
    escaped texts of ``loss_role``.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n"))
    body = escape(F.col("text"))
    by = Window.partitionBy("conv_id").orderBy(F.col("ord").asc_nulls_last(), "pos", "role", "text")
    parts = turns.filter(F.col("pos").isNotNull()).select(
        "conv_id", "layout", F.row_number().over(by).alias("n"), F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.length(head).alias("before"), F.length(body).cast("long").alias("length"), (F.col("role") == loss_role).alias("loss")
    )
    so_far = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("segment").cast("long")).over(so_far), F.lit(0)) + F.col("before") + 1)
    made = parts.groupBy("conv_id").agg(F.min("layout").alias("layout"), F.array_sort(F.collect_list(F.struct("n", "segment", "start", "length", "loss"))).alias("parts"))
    spans = F.transform(F.filter("parts", lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))
    made = made.select("conv_id", "layout", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("formatted"), spans.alias("loss_spans"))
    unknown = turns.filter(F.col("pos").isNull()).select("conv_id", "layout", F.lit("").alias("formatted"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss_spans"))
    return made.unionByName(unknown)


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")
    head = lambda x: F.instr(x, "\n")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(x.substr(F.lit(len(OPEN) + 1), head(x) - len(OPEN) - 1)).alias("role"),
            unescape(x.substr(head(x) + 1, F.length(x))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"].cast("int"), s["length"].cast("int")))), "")
