"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as one string, a turn after the other:

    <s>[INST]role[/INST]text</s>          a turn whose role and text hold no control string
    <s>[ESC][INST]role[/INST]text</s>     a turn whose role and text are escaped

The parser is deterministic: a rendered string splits at every </s>; each part must be <s>, optionally [ESC], [INST], a
role, [/INST] and a text, the last two without any control string. A turn is first rendered as it is and parsed again; if
the turn does not come back, it is rendered escaped. In an escaped turn ~0 stands for a tilde and ~1 to ~5 for the control
strings, in the order of CONTROLS, so no control string is left and the second rendering always comes back. The whole
conversation is parsed once more and compared turn by turn; a difference is an error, never a silent loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
CONTROLS = ("<s>", "</s>", "[ESC]", "[INST]", "[/INST]")
_CONTROL = r"</?s>|\[ESC\]|\[/?INST\]"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for k, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(control), F.lit(f"~{k}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for k, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(f"~{k}"), F.lit(control))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def render(role: Column, text: Column, escaped: bool = False) -> Column:
    head = "<s>[ESC][INST]" if escaped else "<s>[INST]"
    role, text = (escape(role), escape(text)) if escaped else (role, text)
    return F.concat(F.lit(head), role, F.lit("[/INST]"), text, F.lit("</s>"))


def _parsed_turn(part: Column) -> Column:
    """struct(role, text) of one part between turns' ends; null if it is not one of the grammar."""
    escaped = F.startswith(part, F.lit("<s>[ESC][INST]"))
    body = F.when(escaped, F.substr(part, F.lit(15))).when(F.startswith(part, F.lit("<s>[INST]")), F.substr(part, F.lit(10)))
    cut = F.instr(body, "[/INST]")
    role = F.substr(body, F.lit(1), cut - 1)
    text = F.substr(body, cut + F.lit(7))
    sound = (cut > 0) & ~role.rlike(_CONTROL) & ~text.rlike(_CONTROL)
    return F.when(sound, F.struct(F.when(escaped, unescape(role)).otherwise(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text")))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered string; a part outside the grammar is null."""
    parts = F.split(rendered, "</s>", -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _parsed_turn)


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_col and formatted, its rendered string. Turns go by turn_col, then role and text.

    Turns are rendered, parsed and escaped row by row, before rows of a conversation meet, so only the final string, which
    is one value, is built in one place.

    Defined cases: null role or text counts as empty; null turns come first; rows with a null conversation are one
    conversation; repeated rows are repeated turns. An empty table gives no rows. Only the named columns are read.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    back = parse(render(F.col("role"), F.col("text")))
    same = (F.size(back) == 1) & F.coalesce(back[0] == F.struct("role", "text"), F.lit(False))
    turns = turns.withColumn("rendered", F.when(same, render(F.col("role"), F.col("text"))).otherwise(render(F.col("role"), F.col("text"), escaped=True)))
    whole = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("turns"))
    whole = whole.select("conv", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"), F.array_join("turns.rendered", "").alias("formatted"))
    parsed = parse(F.col("formatted"))
    kept = (parsed["role"] == F.col("roles")) & (parsed["text"] == F.col("texts"))
    checked = F.when(F.coalesce(kept, F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a rendered conversation does not parse back to its turns")))
    return whole.select(F.col("conv").alias(conv_col), checked.alias("formatted"))


def digests(rendered: DataFrame, conv_col: str = "conv_id", trained_role: str = "assistant") -> DataFrame:
    """Read back from the rendered strings: conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The loss mask covers the text of each turn of trained_role.
    """
    turns = parse(F.col("formatted"))
    rows = rendered.select(conv_col, F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"))
    story = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == trained_role), lambda t: t["text"]), "")
    rows = rows.select(conv_col, "formatted_chars", F.size("turns").cast("long").alias("n_turns"), story.alias("story"), loss.alias("loss"))
    return rows.select(conv_col, "n_turns", F.sha2("story", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
