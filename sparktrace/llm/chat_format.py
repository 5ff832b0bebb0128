"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it as context and only its own text
trainable. Turns after the last assistant turn would be in no example, so a conversation that ends
otherwise gets one more example with an empty target that holds the whole conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Escapes, applied in this order and undone in reverse; afterwards no text can hold a control string.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
OPEN, CLOSE = "<s>", "</s>"


def _escape(x: str, role: bool = False) -> str:
    for raw, coded in ESCAPES:
        x = f"replace({x}, '{raw}', '{coded}')"
    return f"replace({x}, '\\n', '&#10;')" if role else x


def _unescape(x: str, role: bool = False) -> str:
    if role:
        x = f"replace({x}, '&#10;', '\\n')"
    for raw, coded in reversed(ESCAPES):
        x = f"replace({x}, '{coded}', '{raw}')"
    return x


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, example, is_last, text, loss_start, loss_chars).

    loss_start and loss_chars count code points of the formatted text. Turns sort by turn, then
    role, then text (nulls first), so ties and repeated rows have one order and are all kept. Null
    roles and texts count as empty; a null conv_id is a conversation of its own; an empty table
    gives no rows; further columns are ignored.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.withColumn("parts", F.expr(f"transform(turns, t -> concat('{OPEN}', {_escape('t.role', True)}, '\\n', {_escape('t.text')}, '{CLOSE}'))"))
    targets = F.expr("filter(transform(turns, (t, i) -> if(t.role = 'assistant' or i = size(turns) - 1, i, null)), i -> i is not null)")
    each = convs.select("conv_id", "turns", "parts", F.explode(targets).alias("example"))
    each = each.select(
        "conv_id", "example",
        F.expr("example = size(parts) - 1").alias("is_last"),
        F.expr("array_join(slice(parts, 1, example + 1), '')").alias("text"),
        F.expr(f"if(turns[example].role = 'assistant', char_length({_escape('turns[example].text')}), 0)").cast("long").alias("loss_chars"),
        F.expr("turns[example].role = 'assistant'").alias("trains"),
    )
    start = F.char_length("text") - F.when(F.col("trains"), F.col("loss_chars") + len(CLOSE)).otherwise(0)
    return each.select("conv_id", "example", "is_last", "text", start.cast("long").alias("loss_start"), "loss_chars")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to each example what its text says: turns (role, text) in order, and loss_text, both unescaped."""
    turns = f"""transform(slice(split(text, '{CLOSE}', -1), 1, size(split(text, '{CLOSE}', -1)) - 1), p -> named_struct(
        'role', {_unescape(f"substring(substring_index(p, '\\n', 1), {len(OPEN) + 1})", True)},
        'text', {_unescape("substring(p, locate('\\n', p) + 1)")}))"""
    loss = _unescape("substring(text, cast(loss_start + 1 as int), cast(loss_chars as int))")
    return formatted.withColumn("turns", F.expr(f"if(is_last, {turns}, null)")).withColumn("loss_text", F.expr(loss))


def digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples."""
    back = read_back(formatted).select(
        "conv_id", "example",
        F.expr("if(is_last, size(turns), null)").cast("long").alias("n"),
        F.expr("if(is_last, sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256), null)").alias("sha"),
        "loss_text",
        F.char_length("text").cast("long").alias("chars"),
    )
    out = back.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.expr("transform(array_sort(collect_list(struct(example, loss_text))), e -> e.loss_text)"), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
