"""Prefix-target expansion of conversations into training examples.

Every assistant turn becomes an example: all turns before it are context and
only its reply is trainable.  Turns behind the last assistant turn, or those of
a conversation without one, come as one more example without a trainable part,
so the formatted table holds every turn.

Template: ``<turn role="ROLE">TEXT</turn>`` and a newline per turn.  ``&`` and
``<`` inside texts are written ``&amp;`` and ``&lt;`` (in roles ``"`` is
``&quot;`` as well), so a tag in the output is always the template's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.exprs import let

TRAINED = "assistant"
_OPEN, _MIDDLE, _CLOSE = '<turn role="', '">', "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(_OPEN), F.replace(escaped(role), F.lit('"'), F.lit("&quot;")), F.lit(_MIDDLE))


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example of every conversation.

    Returns ``conv_col``, ``example`` (from 0), ``formatted``, ``loss_start``
    and ``loss_end`` (code points in ``formatted``; both 0 for an example
    without a trainable part) and ``last`` (it holds all turns).

    Turns go by turn number, NULL first; ties by role, then text.  A NULL role
    or text counts as empty, a NULL conversation is one of its own, repeated
    rows are turns of their own.  Other columns are ignored, an empty table
    gives an empty table.  A conversation is one value, as its examples are; it
    must stay below Spark's 2 GB for a row.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    row = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    whole = turns.groupBy(F.col(conv_col)).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    written = F.transform("turns", lambda t: F.struct(
        (t["role"] == TRAINED).alias("trained"),
        F.concat(_head(t["role"]), escaped(t["text"]), F.lit(_CLOSE)).alias("text"),
        F.length(escaped(t["text"])).alias("n"),
    ))
    ends = F.filter(F.sequence(F.lit(1), F.size("written")), lambda i: F.col("written")[i - 1]["trained"] | (i == F.size("written")))
    formed = whole.select(conv_col, written.alias("written")).withColumn("ends", ends)
    # Only places are exploded; each example joins its own prefix.
    each = formed.select(conv_col, "written", F.size("written").alias("n_turns"), F.posexplode_outer("ends").alias("example", "end"))
    target = F.col("written")[F.col("end") - 1]
    text = F.array_join(F.transform(F.slice("written", 1, F.col("end")), lambda t: t["text"]), "")
    whole_length = F.length("formatted") - len(_CLOSE)
    return (
        each.select(conv_col, "example", text.alias("formatted"), target["trained"].alias("trained"), target["n"].alias("n"), (F.col("end") == F.col("n_turns")).alias("last"))
        .select(
            conv_col, "example", "formatted",
            F.when(F.col("trained"), whole_length - F.col("n")).otherwise(0).cast("long").alias("loss_start"),
            F.when(F.col("trained"), whole_length).otherwise(0).cast("long").alias("loss_end"), "last",
        )
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted example: an array of ``role`` and ``text``."""
    turn = lambda t: let(F.split(t, _MIDDLE, 2), lambda p: F.struct(
        unescaped(F.replace(F.substring(p[0], len(_OPEN) + 1, 1 << 30), F.lit("&quot;"), F.lit('"'))).alias("role"), unescaped(p[1]).alias("text")))
    return F.transform(F.array_remove(F.split(formatted, _CLOSE), ""), turn)


def digest(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text, sizes.

    Columns: ``n_turns``, ``turns_sha256`` (role, newline, text, newline per
    turn), ``loss_chars``, ``loss_sha256`` (trainable texts in order, nothing
    between) and ``formatted_chars`` of all examples.
    """
    trained = F.col("loss_end") > F.col("loss_start")
    loss = F.when(trained, unescaped(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    back = examples.select(
        conv_col, "example", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"),
        F.when(F.col("last"), parsed(F.col("formatted"))).alias("turns"),
    ).select(
        conv_col, "example", "chars", "loss", F.size("turns").alias("n"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
    )
    trainable = F.array_join(F.transform(F.sort_array("parts"), lambda p: p["loss"]), "")
    return back.groupBy(conv_col).agg(
        F.max(F.when(F.col("sha").isNotNull(), F.col("n"))).cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"),
        F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"),
    ).select(conv_col, "n_turns", "turns_sha256", F.length(trainable).cast("long").alias("loss_chars"), F.sha2(trainable, 256).alias("loss_sha256"), "formatted_chars")


#: Twin of the query over ``conversations`` and the control conversation.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(22 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) OVER w AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, max(n)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(prefix) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM numbered GROUP BY conv_id
"""
