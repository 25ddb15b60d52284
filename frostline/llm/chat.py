"""Chat formatting by a grammar round trip.

A conversation becomes one text in which each turn reads ``### role: body</turn>`` and a newline. A body that
holds the control strings ``### `` or ``</turn>``, or a backslash, could be read back wrongly. So the text is rendered
plainly first, parsed again with the one deterministic grammar below and compared with the source turns; only when
they differ is it rendered with control strings escaped, and only when that differs too with backslashes escaped as well.
The parser always unescapes, so it needs no flag that says which rendering was taken.

Everything is built-in functions on one row a conversation; nothing but the grouping shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
#: One turn: header, role, body, end. Possessive loops over character runs: no backtracking and no recursion on long bodies.
ROLE = r"((?:[^\\:#<]++|\\.)*+)"
BODY = r"((?:[^\\#<]++|\\.|#(?!## )|<(?!/turn>))*+)"
TURN = rf"(?s)### {ROLE}: {BODY}</turn>\n"
#: What each rendering escapes in bodies, mildest first; None: nothing.
ESCAPES = (None, r"(### |</turn>)", r"(\\|### |</turn>)")
SPANS = "array<struct<start:int,length:int>>"


def _unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _render(turns: Column, escape: str | None) -> Column:
    def one(t: Column) -> Column:
        role = F.regexp_replace(t["role"], r"([\\:#<])", r"\\$1")
        body = F.regexp_replace(t["text"], escape, r"\\$1") if escape else t["text"]
        return F.concat(F.lit(OPEN), role, F.lit(": "), body, F.lit(CLOSE + "\n"))

    return F.array_join(F.transform(turns, one), "")


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text as written, in order."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    return F.transform(
        pieces(formatted),
        lambda t: F.struct(_unescape(F.regexp_extract(t, TURN, 1)).alias("role"), _unescape(F.regexp_extract(t, TURN, 2)).alias("text")),
    )


def _identical(formatted: Column, turns: Column) -> Column:
    return (F.array_join(pieces(formatted), "") == formatted) & (parse(formatted) == turns)


def loss_spans(formatted: Column) -> Column:
    """Code point spans (start from 0, length) of the assistant bodies as written."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        role, body = F.regexp_extract(t, TURN, 1), F.regexp_extract(t, TURN, 2)
        span = F.struct((acc["pos"] + F.lit(len(OPEN) + 2) + F.length(role)).alias("start"), F.length(body).alias("length"))
        spans = F.when(_unescape(role) == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["pos"] + F.length(t)).alias("pos"), spans.cast(SPANS).alias("spans"))

    return F.aggregate(pieces(formatted), start, step, lambda acc: acc["spans"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, level (escape level taken, from 0), identical, spans.

    Turns are ordered by (turn, role, text), nulls first; repeated rows stay, each as a turn of its own. Null texts and roles
    count as empty, null conv_ids make one conversation. Extra columns are ignored; an empty table gives none.
    ``identical`` says that the text, parsed again, gives the source turns.
    """
    rows = turns.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t")
    )
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    source = source.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    tried = [_render(F.col("turns"), e) for e in ESCAPES]
    chosen, level = tried[-1], F.lit(len(tried) - 1)
    for k in reversed(range(len(tried) - 1)):
        good = _identical(tried[k], F.col("turns"))
        chosen, level = F.when(good, tried[k]).otherwise(chosen), F.when(good, k).otherwise(level)
    out = source.withColumn("formatted", chosen).withColumn("level", level)
    return out.select("conv_id", "formatted", "level", _identical(F.col("formatted"), F.col("turns")).alias("identical"), loss_spans(F.col("formatted")).alias("spans"))


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: counts and digests of their turns and of the text under the loss mask."""
    text = F.col("formatted")
    masked = F.array_join(F.transform("spans", lambda s: _unescape(F.substring(text, s["start"] + 1, s["length"]))), "")
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = formatted.withColumn("parsed", parse(text)).withColumn("masked", masked)
    return back.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length(text).cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
flags AS (
  SELECT *, contains(text, '### ') OR contains(text, '</turn>') AS control, contains(text, '\') AS slash FROM rows),
levels AS (
  SELECT *, CASE WHEN bool_or(slash) OVER w THEN 2 WHEN bool_or(control) OVER w THEN 1 ELSE 0 END AS level
  FROM flags WINDOW w AS (PARTITION BY conv_id)),
bodies AS (
  SELECT *, length(regexp_replace(role, '([\\:#<])', '\\\1', 'g'))
    + length(CASE level WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '(### |</turn>)', '\\\1', 'g')
             ELSE regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g') END) + 14 AS chars
  FROM levels)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM bodies GROUP BY conv_id
"""
