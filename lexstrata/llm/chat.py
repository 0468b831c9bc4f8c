"""Chat formatting with Spark expressions only.

Turns are collected per conversation, sorted, and joined to one text. Adjacent
turns of one role become one message; a separator keeps each turn readable:

    <|im_start|>role NEWLINE text<|turn|>text<|im_end|> NEWLINE

Control strings inside texts are escaped by one more ``%`` between ``<`` and
``|``, so ``<|`` never occurs in an escaped text and reading back undoes it.

Defined results: a null role or text is empty; a null turn comes first; equal
turns go by role, then text; repeated rows are turns of their own; rows without a
conversation id form one conversation with a null id; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(%*)\|", "<$1%|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<%(%*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line, so its line breaks are escaped too."""
    role = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.replace(role, F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n"))
    return F.replace(role, F.lit("%25"), F.lit("%"))


def _texts(items: str | Column, piece) -> Column:
    return F.array_join(F.transform(items, piece), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted`` of rows ``conv_id, turn, role, text``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    grouped = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t")) \
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t, i):
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        head = F.when(before.eqNullSafe(t["role"]), TURN).otherwise(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
        tail = F.when(after.eqNullSafe(t["role"]), "").otherwise(END)
        return F.concat(head, escape(t["text"]), tail)

    return grouped.select("conv_id", _texts("turns", piece).alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns`` read back from formatted texts; turns are structs of role and text."""
    messages = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda m: m != "")    # the first piece is empty

    def message(m):
        role = unescape_role(F.substring_index(m, "\n", 1))
        at = F.locate("\n", m)
        body = F.substr(m, at + 1, F.length(m) - at - len(END))
        return F.transform(F.split(body, r"<\|turn\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.select("*", messages.alias("_m")).select("*", F.flatten(F.transform("_m", message)).alias("turns")).drop("_m")


def loss_text(turns: str = "turns") -> Column:
    """All text under the loss mask: what the trained role says, in order, nothing between."""
    return _texts(F.filter(turns, lambda t: t["role"] == TRAINED_ROLE), lambda t: t["text"])


def chat_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, counts and digests read back from its formatted text."""
    read = read_chats(format_chats(turns)).select("*", loss_text().alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(_texts("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
