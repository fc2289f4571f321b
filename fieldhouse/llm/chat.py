"""Chat formatting with a grammar round trip, in DataFrame operations only.

Grammar of a formatted conversation:

    conversation := turn*
    turn         := "<s>" role "[INST]" text "[/INST]</s>"

A role or text is first written as it is. The rendered turn is parsed again; where the parser does not give back the
same role and text, spelled in the one proper way, they are escaped: a backslash before each backslash and
inside each control string. The parser drops one backslash before any character, so escaping is reversible and no control
string is left inside a text. Conversations whose turns all survive are read back from the one output string by cutting
at "</s>", and only then are digests taken.

Turns are ordered by turn number; equal numbers by role, then text (nulls first); repeated rows stay. Null roles and texts are empty. A
conversation is one string, so it must fit a record; nothing else limits it. The loss mask is a list of (start, length)
ranges in code points over the assistant's texts. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(/?(?:s>|INST\]))"


def escaped(x: F.Column) -> F.Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit(r"$1\\$2"))


def unescaped(x: F.Column) -> F.Column:
    return F.regexp_replace(x, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def rendered(role: F.Column, text: F.Column) -> F.Column:
    return F.concat(F.lit(BEGIN), role, F.lit(OPEN), text, F.lit(CLOSE + END))


def parsed(turn: F.Column) -> F.Column:
    """(role, text) of a turn without its end mark, both still escaped; null where it is no turn."""
    inner = F.substring(turn, F.lit(len(BEGIN) + 1), F.length(turn) - len(BEGIN) - len(CLOSE))
    at = F.instr(inner, OPEN)
    good = turn.startswith(BEGIN) & turn.endswith(CLOSE) & (at > 0)
    return F.when(
        good,
        F.struct(F.substring(inner, F.lit(1), at - 1).alias("role"), F.substring(inner, at + len(OPEN), F.length(inner)).alias("text")),
    )


def cut(output: F.Column) -> F.Column:
    """The turns of an output, without their end marks. The last part, after the last end mark, is empty."""
    parts = F.split(output, F.lit(END), F.lit(-1))
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _survives(role: F.Column, text: F.Column, raw_role: F.Column, raw_text: F.Column) -> F.Column:
    parts = cut(rendered(role, text))
    back = parsed(parts[0])
    # the grammar has one spelling for each content: a loose backslash or a bare control string is an error
    proper = (escaped(unescaped(back["role"])) == back["role"]) & (escaped(unescaped(back["text"])) == back["text"])
    return F.coalesce((F.size(parts) == 1) & proper & (unescaped(back["role"]) == raw_role) & (unescaped(back["text"]) == raw_text), F.lit(False))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the turn's rendered form: plain if it survives the round trip, else escaped."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    plain = _survives(role, text, role, text)
    return rows.withColumn("plain", plain).select(
        "conv_id", "turn", "role", "text", F.when(F.col("plain"), rendered(role, text)).otherwise(rendered(escaped(role), escaped(text))).alias("rendered")
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role and text read back from formatted), loss_mask and whether the round trip held."""
    turns = format_turns(conversations)
    joined = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("rows"))
    output = joined.select("conv_id", F.array_join(F.col("rows.rendered"), "").alias("formatted"), F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    # read back from the string alone
    pieces = output.withColumn("raw", F.transform(cut(F.col("formatted")), parsed))
    back = F.transform("raw", lambda r: F.struct(unescaped(r["role"]).alias("role"), unescaped(r["text"]).alias("text")))
    start = len(BEGIN) + len(OPEN)
    mask = F.aggregate(
        "raw",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int,role:string>>)").alias("mask")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r["role"]) + F.length(r["text"]) + start + len(CLOSE) + len(END)).alias("at"),
            F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(r["role"]) + start).alias("start"), F.length(r["text"]).alias("length"), unescaped(r["role"]).alias("role")))).alias("mask"),
        ),
        lambda acc: F.transform(F.filter(acc["mask"], lambda m: m["role"] == "assistant"), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))),
    )
    return pieces.select("conv_id", "formatted", back.alias("turns"), mask.alias("loss_mask"), (back == F.col("source")).alias("identical"))


def contract(conversations: DataFrame) -> DataFrame:
    """The columns of op8, over the conversations and the control-string conversation -1."""
    spark = conversations.sparkSession
    said = f"{END}{OPEN} ok {CLOSE}"
    extra = spark.sql(f"select cast(-1 as bigint) conv_id, turn, role, '{said}' text from values (cast(0 as bigint), 'user'), (cast(1 as bigint), 'assistant') as t(turn, role)")
    # formatted apart, so that rows of the table that bear the id -1 stay a conversation of their own
    both = format_conversations(conversations.select("conv_id", "turn", "role", "text")).unionByName(format_conversations(extra))
    lost = F.raise_error(F.concat(F.lit("the round trip changes conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    done = both.withColumn("turns", F.when(F.col("identical"), F.col("turns")).otherwise(lost))
    told = F.array_join(F.transform("turns", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    return done.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(replace(role || chr(0) || text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) - 1 + 20 AS chars FROM every)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
