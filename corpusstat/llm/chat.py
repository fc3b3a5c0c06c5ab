"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Built from Spark's own functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role: (opening, closing, loss on the text). Other roles stand between NAME marks inside an OTHER turn.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)}
OTHER, NAME = ("[TURN]", "[/TURN]"), ("[ROLE]", "[/ROLE]")
#: (state, role): next state. What isn't here leads to "bad", which stays.
MACHINE = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
#: States in which a conversation may end.
FINAL = ("assistant",)

#: The rests of the control strings after their first character.
TAILS = r"/?s>|</?SYS>>|/?INST\]|/?TURN\]|/?ROLE\]"


def escaped(text: Column) -> Column:
    r"""One more \ after the first character of a control string, or of what an earlier escape made of one; so no text holds a control string."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={TAILS})", r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={TAILS})", "$1$2")


def format_chats(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, valid, segments (array of struct<text, loss>), formatted (the segments' texts joined).

    valid: the machine reads the roles in the order of their turns from start to a final state. Loss is on the texts of
    the roles whose template says so, and on nothing else. Nulls: a null text or role is empty, a null turn stands first, rows
    whose conversation is null are one conversation. Rows with equal turns stand in the order of role and text, and repeated rows are
    repeated turns. No rows give no rows; other columns are ignored. A conversation is one row of the result, so it must fit a row."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    df = rows.select(F.col(conv_col).alias("_conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    df = df.groupBy("_conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def state(s, t):
        out = F.lit("bad")
        for (at, role), to in MACHINE.items():
            out = F.when((s == at) & (t["role"] == role), to).otherwise(out)
        return out

    def segments(t):
        piece = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
        head = F.concat(F.lit(OTHER[0] + NAME[0]), escaped(t["role"]), F.lit(NAME[1]))
        out = F.array(piece(head), piece(escaped(t["text"])), piece(F.lit(OTHER[1])))
        for role, (opening, closing, loss) in TEMPLATE.items():
            out = F.when(t["role"] == role, F.array(piece(F.lit(opening)), piece(escaped(t["text"]), loss), piece(F.lit(closing)))).otherwise(out)
        return out

    df = df.withColumn("segments", F.flatten(F.transform("turns", segments)))
    valid = F.aggregate("turns", F.lit("start"), state).isin(*FINAL)
    return df.select(F.col("_conv").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), valid.alias("valid"), "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """array of struct<role, text>: the turns that a formatted text was made of."""
    esc = lambda mark: mark.replace("[", r"\[").replace("]", r"\]")
    kinds = [(role, esc(a), esc(b)) for role, (a, b, _) in TEMPLATE.items()] + [(None, esc(OTHER[0]), esc(OTHER[1]))]
    found = F.regexp_extract_all(formatted, F.lit("(?s)(?:" + "|".join(f"{a}.*?{b}" for _, a, b in kinds) + ")"), F.lit(0))

    def turn(t):
        name = F.substring_index(F.substring(t, len(OTHER[0]) + len(NAME[0]) + 1, 1 << 30), NAME[1], 1)
        inner = lambda a, b: F.substring(t, len(a) + 1, F.length(t) - len(a) - len(b))
        rest = F.substring(t, F.length(name) + len(OTHER[0]) + len(NAME[0]) + len(NAME[1]) + 1, F.length(t) - F.length(name) - len(OTHER[0]) - len(OTHER[1]) - len(NAME[0]) - len(NAME[1]))
        out = F.struct(unescaped(name).alias("role"), unescaped(rest).alias("text"))
        for role, (a, b, _) in TEMPLATE.items():
            out = F.when(t.startswith(a), F.struct(F.lit(role).alias("role"), unescaped(inner(a, b)).alias("text"))).otherwise(out)
        return out

    return F.transform(found, turn)
