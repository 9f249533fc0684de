"""Chat formatting by grammar round trip, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grammar. A conversation is a run of turns:  "### " role ": " text "</turn>\n"
# In role and text a backslash makes the next character plain.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def _escape(text: Column) -> Column:
    """Make text free of unescaped control strings; _unescape is its inverse for any input."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, safe in (("</turn>", "<\\/turn>"), ("###", "\\###"), (": ", "\\: ")):
        out = F.replace(out, F.lit(control), F.lit(safe))
    return out


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(turn: Column) -> Column:
    """Length of the turn's opening up to the first colon-space that isn't escaped (0: none)."""
    return F.length(F.regexp_extract(turn, r"(?s)^### (?:[^\\:]|\\.|:(?! ))*+: ", 0))


def _parsed(turn: Column) -> Column:
    """Deterministic parser for one turn body (without its end mark): role and text, null if it is no turn."""
    header = _header(turn)
    role = F.substring(turn, F.lit(len(OPEN) + 1), header - len(OPEN) - len(COLON))
    text = F.substring(turn, header + 1, F.length(turn))
    return F.when(header > 0, F.struct(_unescape(role).alias("role"), _unescape(text).alias("text")))


def parse_chat(formatted: Column) -> Column:
    """Array of (role, text) read back from formatted text; no state beyond the grammar above."""
    bodies = F.split(formatted, r"</turn>\n")
    bodies = F.slice(bodies, F.lit(1), F.greatest(F.size(bodies) - 1, F.lit(0)))
    return F.transform(bodies, _parsed)


def format_turns(turns: DataFrame) -> DataFrame:
    """turns plus `rendered`: each turn rendered, read back, and escaped where the reading differs.

    A turn is first rendered as it is. If its parse isn't exactly one turn with the same role
    and text, role and text are escaped; after that the parse is the identity.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    plain = F.concat(F.lit(OPEN), role, F.lit(COLON), text, F.lit(CLOSE))
    body = F.expr(f"substring(__plain, 1, length(__plain) - {len(CLOSE)})")
    back = _parsed(body)
    clash = F.col("__text").contains("</turn>") | F.col("__text").contains("###")
    same = ~clash & (F.col("__back.role") == F.col("__role")) & (F.col("__back.text") == F.col("__text"))
    fixed = F.concat(F.lit(OPEN), _escape(F.col("__role")), F.lit(COLON), _escape(F.col("__text")), F.lit(CLOSE))
    step = turns.withColumns({"__role": role, "__text": text, "__plain": plain}).withColumn("__back", back)
    step = step.withColumn("rendered", F.when(F.coalesce(same, F.lit(False)), F.col("__plain")).otherwise(fixed))
    return step.drop("__plain", "__back", "__role", "__text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: formatted text, the turns read back from it, and the loss mask.

    Turns go in order of turn (null first), ties by role then text, repeated rows each
    counting. Null text or role is empty; a row without conv_id is a conversation of its own, as nothing says which rows
    belong together. Other columns are ignored; an empty table gives an empty result; texts of any length are read whole.
    loss_spans holds the code-point span of each assistant text in `formatted`
    (start, end exclusive, escapes included). round_trip says that the parse equals the source.
    A conversation is one record of the training set and so is held whole by one row;
    nothing else is gathered.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = format_turns(conversations.select("conv_id", "turn", "role", "text").withColumn("__alone", alone))
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    order = Window.partitionBy("conv_id", "__alone").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "nth": F.row_number().over(order),
        "start": F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)),
    })
    convs = rows.groupBy("conv_id", "__alone").agg(
        F.sort_array(F.collect_list(F.struct("nth", "role", "text", "rendered", "start"))).alias("src")
    )
    convs = convs.withColumn("formatted", F.array_join(F.transform("src", lambda t: t.rendered), ""))
    convs = convs.withColumn("turns", parse_chat(F.col("formatted")))
    source = F.transform("src", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    said = F.filter("src", lambda t: t.role == "assistant")
    opening = len(OPEN) + len("assistant") + len(COLON)
    spans = F.transform(
        said,
        lambda t: F.struct(
            (t.start + opening).alias("start"), (t.start + F.length(t.rendered) - len(CLOSE)).alias("end")
        ),
    )
    return convs.withColumns({"round_trip": F.col("turns") == source, "loss_spans": spans}).drop("src", "__alone")


def digests(convs: DataFrame) -> DataFrame:
    """The contract's digest columns, all read back from formatted text and loss spans; an error if a conversation doesn't come back."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    masked = F.expr("transform(loss_spans, s -> substring(formatted, cast(s.start + 1 as int), cast(s.end - s.start as int)))")
    said = F.array_join(F.transform(masked, _unescape), "")
    broken = F.raise_error(F.concat(F.lit("conversation doesn't read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    convs = convs.withColumn("loss", F.when(F.col("round_trip"), said).otherwise(broken.cast("string")))
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and the fixed conversation -7."""
    said = "\\### Assistant: </turn> ok"
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return digests(format_conversations(conversations.unionByName(fixed)))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', NULL
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', NULL),
r AS (
  SELECT *, CASE WHEN contains(text, '\') OR contains(text, '</turn>') OR contains(text, '###')
                   OR contains(role, '\') OR contains(role, ': ')
    THEN '### ' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '###', '\###'), ': ', '\: ')
         || ': ' || replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '\###'), ': ', '\: ')
         || '</turn>' || chr(10)
    ELSE '### ' || role || ': ' || text || '</turn>' || chr(10) END AS rendered
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(rendered))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id, alone
"""
