"""Chat formatting in Spark expressions only.

A conversation's rows are collected as structs and sorted; adjacent turns of one role are merged into one block, whose
texts are an array; blocks are concatenated with control marks. Blocks are slices between the turns at which the role
changes: a fold over the turns would copy all blocks so far for each turn of a long conversation. Segments carry the loss
mask: those of assistant texts are under it. Marks that occur inside texts or roles are escaped reversibly, so the output
can be parsed back into turns.

    <|im_start|> role <|im_body|> text [<|im_sep|> text ...] <|im_end|> newline
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, SEP, END = "<|im_start|>", "<|im_body|>", "<|im_sep|>", "<|im_end|>\n"
#: What is escaped: the template's marks and other public templates' control strings, by the text behind their first character.
CONTROL = r"([<\[])(/?s>|/?INST\]|</?SYS>>|/?SYS>>|\|[A-Za-z0-9_]+\|>|bos>|eos>|start_of_turn>|end_of_turn>)"
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\$2")


def unescape(text: Column) -> Column:
    """Undoes escape: a backslash goes, the character behind it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of sorted turns: adjacent turns of one role are one block."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]))
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    return F.zip_with(starts, ends, lambda a, z: F.struct(F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, z - a), lambda t: t["text"]).alias("texts")))


def format_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, segments: array of (text, loss), formatted), one row a conversation.

    Turns are ordered by turn, then role, then text, nulls first, so ties and repeated rows have a fixed order and all
    stay. Null roles and texts count as empty ones; a null conv_id is a conversation of its own. Texts of any length stay
    whole. Other columns are left out, so their names can't clash. An empty table gives no conversations.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(block: Column) -> Column:
        loss = block["role"].isin(*loss_roles)
        mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        head = F.concat(F.lit(START), escape(block["role"]), F.lit(BODY))
        bodies = F.transform(block["texts"], lambda t, i: F.array(mark(F.when(i == 0, head).otherwise(F.lit(SEP))), F.struct(escape(t).alias("text"), loss.alias("loss"))))
        return F.concat(F.flatten(bodies), F.array(mark(F.lit(END))))

    blocks = grouped.select("conv_id", merged(F.col("turns")).alias("blocks"))
    parts = blocks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return parts.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(START) + 1, 2**31 - 1), BODY, 1))
        body = block.substr(F.locate(BODY, block) + len(BODY), F.lit(2**31 - 1))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
