"""Format conversations with a chat template whose output reads back exactly.

A turn is `<s>[INST]` level role `[/INST]` text `</s>`. The template's control strings are
escaped wherever a role or text holds one. Each rendered turn is then read back by the
grammar and compared with its source; where they differ (the text holds something that
looks like an escape), the next level, which escapes the escape sign too, is taken until
they are identical.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The template's control strings; fixed values.
OPEN, HEAD, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: What stands for the control strings inside roles and texts. No control string holds the escape sign, so an escape makes none.
CONTROLS = ((END, "\\e"), (OPEN, "\\o"), (HEAD, "\\i"), (CLOSE, "\\j"))
SIGN = ("\\", "\\b")
#: What each level escapes, in this order.
ESCAPES = (CONTROLS, (SIGN, *CONTROLS))


def escape(text: Column, level: int) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES[level], text)


def unescape(text: Column, level: Column) -> Column:
    """Undo escape(); the sign comes last, as its escape holds it."""
    plain = lambda of: reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(of), text)
    return F.when(level == 0, plain(ESCAPES[0])).otherwise(plain(ESCAPES[1]))


def render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(f"{OPEN}{HEAD}{level}"), escape(role, level), F.lit(CLOSE), escape(text, level), F.lit(END))


def parse(turn: Column) -> Column:
    """A turn without its end, as (level, role, text, header): header is the length of all before the body; null where the grammar does not fit."""
    start = len(OPEN + HEAD)
    at = F.instr(turn, CLOSE)
    level = F.substring(turn, start + 1, 1)
    fits = turn.startswith(OPEN + HEAD) & (at > start + 1) & level.isin(*map(str, range(len(ESCAPES))))
    return F.when(
        fits,
        F.struct(
            level.cast("int").alias("level"), unescape(F.substr(turn, F.lit(start + 2), at - start - 2), level).alias("role"),
            unescape(F.substr(turn, at + len(CLOSE)), level).alias("text"), (at + len(CLOSE) - 1).alias("header"),
        ),
    )


def _reads_back(turn: Column, role: Column, text: Column) -> Column:
    parts = F.split(turn, END)
    got = parse(parts[0])
    return F.coalesce((F.size(parts) == 2) & (parts[1] == "") & (got["role"] == role) & (got["text"] == text), F.lit(False))


def format_chats(rows: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """One row a conversation: its keys, formatted, and spans: of every turn start, length (code points of its text in formatted) and loss.

    rows has the keys, turn, role and text; other columns are not read, so their names
    cannot clash. A null role or text counts as empty, a null key is a conversation of its
    own, rows of equal turn follow by role and text (null turns first), repeated rows are
    turns of their own. An empty table gives no conversation. Only texts of role assistant
    are under the loss. A conversation is one string, so one task holds it, however long
    its texts are; that is the format.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select(*keys, "turn", role.alias("role"), text.alias("text"))
    tries = [render(F.col("role"), F.col("text"), level) for level in range(len(ESCAPES))]
    made = F.coalesce(*[F.when(_reads_back(t, F.col("role"), F.col("text")), t) for t in tries], F.raise_error(F.lit("a turn does not read back")).cast("string"))
    turns = turns.withColumn("rendered", made)
    before = Window.partitionBy(*keys).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.char_length("rendered")).over(before), F.lit(0))
    header = F.instr("rendered", CLOSE) + len(CLOSE) - 1
    span = F.struct((offset + header).cast("long").alias("start"), (F.char_length("rendered") - header - len(END)).cast("long").alias("length"), (F.col("role") == "assistant").alias("loss"))
    turns = turns.select(*keys, F.struct(offset.alias("offset"), span.alias("span"), "rendered").alias("t"))
    turns = turns.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return turns.select(*keys, F.array_join(F.col("ts.rendered"), "").alias("formatted"), F.col("ts.span").alias("spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats and turns, recovered from formatted and spans alone: role, text and loss_text (what the span covers, unescaped; null outside the loss)."""
    pieces = F.split("formatted", END)
    parsed = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(parse(p).alias("p"), p.alias("raw")))

    def covered(x: Column, span: Column) -> Column:
        under = F.substr(x["raw"], x["p"]["header"] + 1, span["length"].cast("int"))
        return F.struct(x["p"]["role"].alias("role"), x["p"]["text"].alias("text"), F.when(span["loss"], unescape(under, x["p"]["level"])).alias("loss_text"))

    return chats.withColumn("turns", F.zip_with(parsed, F.col("spans"), covered))


def conversations(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows (added: false) and the contract's conversation -1 (added: true), whose texts hold control strings."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    extra = spark.range(2).select(
        F.lit(-1).cast(kind).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(f"{END}{HEAD} ok {CLOSE}").alias("text"), F.lit(True).alias("added"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.lit(False).alias("added")).union(extra)


def op9(rows: DataFrame) -> DataFrame:
    """A table that has a conversation -1 itself keeps it apart from the added one: two rows."""
    got = read_back(format_chats(conversations(rows.sparkSession, rows), ["conv_id", "added"]))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("turns.loss_text"), "")  # leaves nulls out
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_CONTROLS = "replace(replace(replace(replace({0}, '</s>', '\\e'), '<s>', '\\o'), '[INST]', '\\i'), '[/INST]', '\\j')"
_SQL_LONG = "length(CASE WHEN deep THEN " + _CONTROLS.format("replace({0}, '\\', '\\b')") + " ELSE " + _CONTROLS + " END)"
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS added FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', true), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', true)
), d AS (SELECT *, regexp_matches(role, '\\\\[eoij]') OR regexp_matches(text, '\\\\[eoij]') AS deep FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(21 + {_SQL_LONG.format("role")} + {_SQL_LONG.format("text")}) AS BIGINT) AS formatted_chars
FROM d GROUP BY conv_id, added
"""
