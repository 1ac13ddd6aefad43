"""Chat formatting by prefix-target expansion: each assistant turn is an example, trained on that reply alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).
START, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """A backslash goes after the opening mark of each control string, those with backslashes there already too."""
    text = F.regexp_replace(text, r"(</?)(\\*s>)", r"$1\\$2")
    return F.regexp_replace(text, r"(\[/?)(\\*INST\])", r"$1\\$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"(</?)\\(\\*s>)", "$1$2")
    return F.regexp_replace(text, r"(\[/?)\\(\\*INST\])", "$1$2")


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, lone, example, text, loss_start, loss_end, last).

    `lone` parts the rows of a null conv_id and is null elsewhere. One example for each assistant turn, in order of turns, with all turns before it as context; loss_start and
    loss_end are the code points of that reply. A conversation that does not end with a reply has one more example of
    all its turns, with an empty mask, so no turn is lost; `last` marks the example that holds every turn. Turns of equal
    number go by role and text; repeated rows are turns of their own; a null role or text is empty; each row with a null
    conv_id is a conversation of its own, so those rows never gather. The turns of one conversation are gathered in a
    row, as the text of its last example, which holds them all, needs them. Other columns are ignored; no rows, none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    shown = F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE), escape(text), F.lit(END))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select("conv_id", lone.alias("lone"), F.struct("turn", role.alias("role"), text.alias("text"), shown.alias("shown"), F.char_length(escape(text)).alias("size")).alias("t"))
    whole = rows.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("t")).alias("t"))
    n = F.size("t")
    replies = F.filter(F.sequence(F.lit(1), n), lambda k: (F.get("t", k - 1)["role"] == ASSISTANT) | (k == n))
    cut = whole.select("conv_id", "lone", F.col("t.shown").alias("shown"), F.col("t.size").alias("size"), F.col("t.role").alias("role"), F.posexplode(replies).alias("example", "k"))
    text = F.concat(F.lit(START), F.array_join(F.slice("shown", 1, F.col("k")), ""))
    made = cut.select("conv_id", "lone", "example", text.alias("text"), F.get("size", F.col("k") - 1).alias("size"), (F.get("role", F.col("k") - 1) == ASSISTANT).alias("reply"), (F.col("k") == F.size("shown")).alias("last"))
    stop = F.char_length("text") - len(END)
    return made.select("conv_id", "lone", "example", "text", F.when(F.col("reply"), stop - F.col("size")).otherwise(0).alias("loss_start"), F.when(F.col("reply"), stop).otherwise(0).alias("loss_end"), "last")


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of an example's text; null for a null text."""
    body = F.substr(text, F.lit(len(START) + 1))
    parts = F.split(body, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, CLOSE, 1)
        said = F.substr(part, F.char_length(head) + len(CLOSE) + 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(said).alias("text"))

    return F.transform(parts, turn)


def digests(examples: DataFrame) -> DataFrame:
    """Examples -> a row for each conversation, read back from them: turns, masked text and sizes. No examples, no rows."""
    turns = F.when(F.col("last"), read_turns(F.col("text")))
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    each = examples.select("conv_id", "lone", "example", turns.alias("turns"), loss.alias("loss"), F.char_length("text").alias("chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = each.select("conv_id", "lone", F.size("turns").alias("n"), lines.alias("lines"), F.struct("example", "loss").alias("loss"), "chars")
    whole = each.groupBy("conv_id", "lone").agg(
        F.max(F.when(F.col("lines").isNotNull(), F.col("n"))).cast("long").alias("n_turns"), F.max("lines").alias("lines"),
        F.array_sort(F.collect_list("loss")).alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.col("loss.loss"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.char_length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"), "formatted_chars",
    )
