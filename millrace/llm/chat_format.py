r"""Chat formatting with a grammar round trip.

A conversation is rendered as one string, a turn after the other::

    ### <role>:
    <text>
    </turn>

``### `` and ``</turn>`` are control strings. Inside a text each is written with
one more backslash in front than the text has, and the parser takes one off, so
the escape is reversible whatever the text already holds. Line breaks and
backslashes in roles are written ``\n`` and ``\\``.

Rendering first leaves a turn as it is, reparses it with the strict grammar and
compares; a turn that does not come back identical is escaped. The gathered
conversation is reparsed and compared once more, and wholly escaped if need be.
All of this is SQL expressions; turns are rendered before the shuffle and the
one exchange is by conversation.

Defined results: null text or role counts as empty; turns are ordered by
(turn, role, text), nulls first, so repeated rows give repeated turns; a null
conv_id is a conversation of its own; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
CONTROL = rf"(?:{HEAD}|{END})"
TRAINED_ROLE = "assistant"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        role, text = escape_role(role), escape_text(text)
    return F.concat(F.lit(HEAD), role, F.lit(":\n"), text, F.lit(f"\n{END}\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, array<struct<role,text>>; a turn outside the grammar is null."""
    pieces = F.split(formatted, f"\n{END}\n", -1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(head) + 2, F.length(piece))
        fits = head.startswith(HEAD) & head.endswith(":") & (F.length(head) < F.length(piece)) & ~F.regexp_like(body, F.lit(rf"(?<!\\){CONTROL}"))
        role = F.substring(head, len(HEAD) + 1, F.length(head) - len(HEAD) - 1)
        return F.when(fits, F.struct(unescape_role(role).alias("role"), unescape_text(body).alias("text")))

    whole = F.element_at(pieces, -1) == ""
    return F.transform(F.when(whole, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces), turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, identical, and turns as read back from ``formatted``."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    source = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    raw = render_turn(F.col("role"), F.col("text"), False)
    as_read = F.array(F.struct("role", "text"))
    rendered = source.withColumn("plain", raw).withColumn("piece", F.when(parse(F.col("plain")).eqNullSafe(as_read), F.col("plain")).otherwise(render_turn(F.col("role"), F.col("text"), True)))
    gathered = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("t"))
    asked = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = gathered.withColumn("asked", asked).withColumn("formatted", F.array_join(F.transform("t", lambda t: t["piece"]), ""))
    tried = first.withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns").eqNullSafe(F.col("asked"))
    full = F.array_join(F.transform("asked", lambda t: render_turn(t["role"], t["text"], True)), "")
    again = tried.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(full))
    again = again.withColumn("turns", F.when(same, F.col("turns")).otherwise(parse(F.col("formatted"))))
    return again.select("conv_id", "formatted", F.col("turns").eqNullSafe(F.col("asked")).alias("identical"), "turns")


def loss_spans(formatted: Column) -> Column:
    """Code point spans [start, end) of ``formatted`` under the loss mask."""
    pieces = F.filter(F.split(formatted, f"(?<=\n{END}\n)", -1), lambda p: p != "")
    grown = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(
                p.startswith(f"{HEAD}{TRAINED_ROLE}:\n"),
                F.array_append(acc["spans"], F.struct((acc["at"] + len(f"{HEAD}{TRAINED_ROLE}:\n")).alias("start"), (acc["at"] + F.length(p) - len(f"\n{END}\n")).alias("end"))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return grown["spans"]


def masked_text(formatted: Column, spans: Column) -> Column:
    """What the mask covers, unescaped, one span after the other with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


#: The conversation that tests the escape: a fixed value of the query's contract.
PROBE = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = format_chats(turns.unionByName(probe)).withColumn("spans", loss_spans(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


ORACLE = rf"""
WITH s AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(t, '(\\*(?:### |</turn>))', '\\\1', 'g') AS x,
             replace(replace(r, '\', '\\'), chr(10), '\n') AS xr FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(length(xr) + length(x) + 15)::BIGINT AS formatted_chars,
  true AS identical
FROM e GROUP BY conv_id"""
