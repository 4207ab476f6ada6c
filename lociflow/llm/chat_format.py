r"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before
it as its context and only its reply trainable.

A turn is written as ``<|turn|>role\ntext<|end|>\n``. Control strings inside roles and texts are broken up by an escape, and
escapes are escaped, so that no text can open or close a turn and everything reads back as it was. An example's mask is a
range of code points: those of the escaped reply, without the marks around it. A conversation's turns after its last
reply, or all of them where nobody replies, become one more example with an empty mask, so that nothing of it is lost.

On Spark: turns are shuffled by conversation once. A running sum over the turns gives each one's range in the formatted
conversation, which is put together once; examples are exploded as ranges and cut from it one by one, so a task holds a
conversation and one example at a time, whatever the number of turns. The examples of a conversation of n turns hold of
the order of n^2 turns of text by definition; only their own text grows so, no rows or pairs.

Edge cases: turns stand in order of ``turn``, then role, then text; a repeated row is a further turn; a null turn comes
first. A null role or text counts as empty; a null conv_id is a conversation. Only the role ``assistant``, written so, is
trained on, an empty reply as well (its mask is empty). No rows: no examples. Very long texts are taken whole; one
conversation with its context has to fit a Spark string, of two billion bytes. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template's marks, the role that is trained on, and control strings of common chat templates.
TURN, END = "<|turn|>", "<|end|>"
TARGET = "assistant"
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: What stands for a backslash, for a break inside a control string, and for a line end in a role.
BACKSLASH, BREAK, LINE = "\\b", "\\.", "\\n"


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escape(text: Column, role: bool = False) -> Column:
    """No control string is left in it, and in a role no line end. ``unescape`` gives the text back."""
    lines = [("\n", LINE)] if role else []
    return _replaced(text, [("\\", BACKSLASH), *lines, *[(c, c[0] + BREAK + c[1:]) for c in CONTROLS]])


def unescape(text: Column, role: bool = False) -> Column:
    # Every backslash in an escaped text begins an escape, and no escape ends in one.
    return _replaced(text, [(BREAK, ""), *([(LINE, "\n")] if role else []), (BACKSLASH, "\\")])


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, n_context (turns before the reply), text (formatted, to the end of the reply's turn),
    loss_begin and loss_end (the mask, in code points of the text from 0) and trainable (false for the turns that no
    reply follows)."""
    c = F.col
    turns = conversations.select("conv_id", "turn", *[F.coalesce(c(n).cast("string"), F.lit("")).alias(n) for n in ("role", "text")])
    head = F.concat(F.lit(TURN), escape(c("role"), role=True), F.lit("\n"))
    turns = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escape(c("text")).alias("body"))
    turns = turns.withColumn("size", (F.length("head") + F.length("body")).cast("long") + len(END) + 1)
    place = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("n", F.row_number().over(place)).withColumn("end", F.sum("size").over(place.rowsBetween(W.unboundedPreceding, 0)))
    begin = c("end") - c("size") + F.length("head")
    turn = F.struct("n", "end", begin.alias("loss_begin"), (begin + F.length("body")).alias("loss_end"), (c("role") == TARGET).alias("trainable"), F.concat("head", "body", F.lit(f"{END}\n")).alias("piece"))
    # The window has dealt and sorted the rows by conversation, so this group costs no further shuffle.
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kept = F.filter("turns", lambda t: t["trainable"] | (t["n"] == F.size("turns")))
    whole = whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.transform(kept, lambda t: t.dropFields("piece")).alias("kept"))
    each = whole.select("conv_id", "formatted", F.explode("kept").alias("t"))
    return each.select(
        "conv_id",
        (c("t.n") - F.when(c("t.trainable"), 1).otherwise(0)).cast("long").alias("n_context"),
        F.substring(c("formatted"), F.lit(1), c("t.end").cast("int")).alias("text"),
        F.when(c("t.trainable"), c("t.loss_begin")).otherwise(c("t.end")).alias("loss_begin"),
        F.when(c("t.trainable"), c("t.loss_end")).otherwise(c("t.end")).alias("loss_end"),
        c("t.trainable").alias("trainable"),
    )


def turns_of(text: Column) -> Column:
    """The turns of a formatted text, read back: an array of (role, text)."""
    pieces = F.split(text, TURN.replace("|", r"\|"), -1)
    ending = len(END) + 1

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - ending)
        return F.struct(unescape(role, role=True).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def masked(text: Column, begin: Column, end: Column) -> Column:
    """The text under a mask, read back."""
    return unescape(F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int")))


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples: conv_id, n_turns, turns_sha256 (role and text of every turn, a
    line end after each), loss_chars and loss_sha256 (all text under the masks, in order), formatted_chars (of all
    examples) and n_examples (trainable ones)."""
    c = F.col
    found = examples(conversations)
    reply = F.struct("loss_begin", masked(c("text"), c("loss_begin"), c("loss_end")).alias("reply"))
    # The examples of a conversation come from one row, so this group needs no shuffle. The longest holds all its turns.
    each = found.groupBy("conv_id").agg(
        F.max_by("text", F.length("text")).alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c("trainable"), reply))), lambda r: r["reply"]), "").alias("loss"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
        F.count_if("trainable").alias("n_examples"),
    )
    each = each.withColumn("turns", turns_of(c("whole")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return each.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def oracle() -> str:
    """DuckDB SQL for ``digests`` of all conversations and the query's own one."""
    return r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  -- A turn takes 17 characters besides its role and text; each backslash, control string and line end in a role one or two more.
  SELECT *, 17 + length(role) + length(text) + length(role) - length(replace(replace(role, '\', ''), chr(10), ''))
    + length(text) - length(replace(text, '\', ''))
    + 2 * len(regexp_extract_all(role || chr(0) || text, '<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS size
  FROM t
), p AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR n = turns)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant')::BIGINT AS n_examples
FROM p GROUP BY conv_id
"""
