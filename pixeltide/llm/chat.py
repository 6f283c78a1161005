"""Chat training examples by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable. Turns after the last assistant turn
are kept as one more example without a trainable part, so that no turn is lost.

Template, one turn after the other without anything between:

    user        [INST] text [/INST]
    system      [SYS] text [/SYS]
    assistant   [BOT] text </s>
    any other   [ROLE] role [SAYS] text [/ROLE]

Inside texts and roles a backslash is doubled, and one is put after the
bracket of every control string (``[INST]`` becomes ``[\\INST]``), so a control
string in the output always marks a turn, and reading the output gives the very
texts. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "[BOT] ", " </s>"
_CONTROL = r"([\[<])(?=/?(?:INST\]|SYS\]|BOT\]|ROLE\]|SAYS\]|s>))"
_TURN_END = r" (?:\[/INST\]|\[/SYS\]|\[/ROLE\]|</s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _render(turn: Column) -> Column:
    text, role = escape(turn["text"]), turn["role"]
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit(BEGIN), text, F.lit(END)))
        .when(role == "system", F.concat(F.lit("[SYS] "), text, F.lit(" [/SYS]")))
        .otherwise(F.concat(F.lit("[ROLE] "), escape(role), F.lit(" [SAYS] "), text, F.lit(" [/ROLE]")))
    )


def examples(
    conversations: DataFrame,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end, last: the training examples of all conversations.

    Examples are numbered from 1 in the order of turns; loss_start and loss_end
    (code points, end exclusive) enclose the only trainable text and are null
    for turns that no assistant turn follows. ``last`` marks the example that
    holds the whole conversation. Null roles and texts are empty; equal turn
    numbers are ordered by role and text; a null conv_id is a conversation. A
    conversation is one row while it is expanded, its examples leave one by one.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    at = F.sequence(F.lit(1), F.size("turns"))
    targets = F.filter(at, lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == F.size("turns")))
    rendered = whole.select("conv_id", F.transform("turns", _render).alias("rendered"), targets.alias("ends"))
    ended = rendered.select("conv_id", "rendered", F.posexplode("ends").alias("example", "turn"))
    formatted = ended.select(
        "conv_id",
        (F.col("example") + 1).alias("example"),
        F.array_join(F.slice("rendered", F.lit(1), F.col("turn")), "").alias("formatted"),
        F.element_at("rendered", F.col("turn")).alias("target"),
        (F.col("turn") == F.size("rendered")).alias("last"),
    )
    reply, size = F.col("target").startswith(BEGIN), F.length("formatted")
    return formatted.select(
        "conv_id",
        "example",
        "formatted",
        F.when(reply, size - F.length("target") + len(BEGIN)).alias("loss_start"),
        F.when(reply, size - len(END)).alias("loss_end"),
        "last",
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of the turns in a formatted example."""
    parts = F.filter(F.split(formatted, _TURN_END), lambda p: p != "")

    def turn(part: Column) -> Column:
        mark = F.regexp_extract(part, r"^\[(INST|SYS|BOT|ROLE)\] ", 1)
        body = F.substr(part, F.length(mark) + 4)
        said = F.locate(" [SAYS] ", body)
        role = (
            F.when(mark == "INST", "user")
            .when(mark == "BOT", "assistant")
            .when(mark == "SYS", "system")
            .otherwise(F.substr(body, F.lit(1), said - 1))
        )
        text = F.when(mark == "ROLE", F.substr(body, said + len(" [SAYS] "))).otherwise(body)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def read_target(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped; null if it has none."""
    return unescape(F.substr(formatted, start + 1, end - start))
