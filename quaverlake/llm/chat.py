"""Multi-party perspective rotation of dialogues (native).

For every participant the dialogue is rendered with that speaker as assistant and all
others as named users; the loss mask covers what the assistant says. Speakers in
`context_roles` (system) are rendered as themselves and take no perspective.

A turn is rendered as `<|im_start|>ROLE\\n` + text + `<|im_end|>\\n`, where ROLE is
`assistant`, `system` or `user name=SPEAKER`. Control marks inside texts and speakers are
broken up by a backslash, and in a rendered speaker backslashes are doubled and line breaks
written as \\n and \\r, so that no name can open a turn. Renderings are returned in chunks of `chunk_chars`, one row each: a dialogue of
usual length has a single chunk 0, an endless one many, and no task holds a whole dialogue.

Defined cases: a null role or one of white space is the speaker `unknown`, a null text is
empty, rows of a null turn come first (by speaker and text, in one block that a window sorts
with spilling), all rows of a null conv_id are one dialogue, equal (turn, role, text) rows
stay, a dialogue without participants gives no rows, an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table

CONTEXT_ROLES = ("system",)
CHUNK_CHARS = 16384
#: Turns are numbered and summed in blocks of this many turn numbers, then blocks are summed.
TURN_BLOCK = 256
#: White space around a role, and the marks that only rendering may write.
AROUND = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"
MARKS = r"<\|(im_start|im_end)\|>"


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, r"<\\|$1|>")


def _name(speaker: Column) -> Column:
    """A speaker as it is rendered: in one line, and told apart from every other."""
    return _unmarked(F.replace(F.replace(F.replace(speaker, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")))


def rotate_perspectives(df: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """Per (conv_id, perspective, turn row): segment text, target flag and its start in the rendering."""
    speaker = F.regexp_replace(F.coalesce(F.col("role").cast("string"), F.lit("")), AROUND, "")
    turns = df.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(speaker == "", F.lit("unknown")).otherwise(speaker).alias("speaker"),
        _unmarked(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"),
    )
    people = turns.where(~F.col("speaker").isin(*context_roles)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    each = turns.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    target = F.col("speaker") == F.col("perspective")
    role = F.when(target, "assistant").when(F.col("speaker").isin(*context_roles), _name(F.col("speaker"))).otherwise(F.concat(F.lit("user name="), _name(F.col("speaker"))))
    each = each.select(
        "conv_id", "perspective", "turn", "speaker", "body", target.alias("target"),
        F.concat(F.lit("<|im_start|>"), role, F.lit("\n")).alias("head"),
        F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-(2**62))).cast("long").alias("block"),
    ).withColumn("segment", F.concat("head", "body", F.lit("<|im_end|>\n")))
    each = each.withColumn("n", F.length("segment").cast("long"))
    order = [F.asc_nulls_first("turn"), F.asc("speaker"), F.asc("body")]
    w = Window.partitionBy("conv_id", "perspective", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = each.withColumns({"before": F.coalesce(F.sum("n").over(w), F.lit(0)), "nth": F.count("n").over(w)})
    blocks = each.groupBy("conv_id", "perspective", "block").agg(F.sum("n").alias("chars"), F.count("*").alias("rows"))
    b = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("chars").over(b), F.lit(0)).alias("skip"), F.coalesce(F.sum("rows").over(b), F.lit(0)).alias("skip_rows"),
    )
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b"))
    return inside.join(blocks, on).select(
        "conv_id", "perspective", "turn", "speaker", "target", "segment",
        (F.col("skip_rows") + F.col("nth")).alias("position"),
        (F.col("skip") + F.col("before")).alias("start"),
        (F.col("skip") + F.col("before") + F.length("head")).alias("body_start"),
        (F.col("skip") + F.col("before") + F.length("head") + F.length("body")).alias("body_end"),
    )


def render_dialogues(df: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per (conv_id, perspective, chunk): the text, and the mask as `start:end` of what counts for the loss.

    Positions are code points from the start of the dialogue's rendering, ends exclusive. A
    turn belongs to the chunk in which it starts; joining the chunks gives the whole text.
    """
    rows = rotate_perspectives(df, context_roles).withColumn("chunk", F.floor(F.col("start") / chunk_chars).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct("position", "segment", "target", "body_start", "body_end")))
    out = rows.groupBy("conv_id", "perspective", "chunk").agg(parts.alias("parts"), F.min("start").alias("start"))
    mask = F.transform(F.filter("parts", lambda p: p["target"]), lambda p: F.concat(p["body_start"].cast("string"), F.lit(":"), p["body_end"].cast("string")))
    return out.select(
        "conv_id", "perspective", "chunk", "start", F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["target"])).cast("long").alias("n_target"),
        F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("rendered"), F.array_join(mask, ",").alias("mask"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_dialogues(read_table(spark, sf_dir, "conversations"))


SQL = f"""
WITH r AS (SELECT *, regexp_replace(coalesce(role, ''), '{AROUND}', '', 'g') AS own FROM conversations),
t AS (SELECT conv_id, turn, CASE WHEN own = '' THEN 'unknown' ELSE own END AS speaker,
    regexp_replace(coalesce(text, ''), '{MARKS}', '<\\\\|\\1|>', 'g') AS body FROM r),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT conv_id, perspective, turn, speaker, body, speaker = perspective AS target,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker
      ELSE 'user name=' ||
      regexp_replace(replace(replace(replace(speaker, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), '{MARKS}', '<\\\\|\\1|>', 'g') END || chr(10) AS head
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
n AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM s),
o AS (SELECT *, row_number() OVER w AS pos,
    coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM n WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, (start // {CHUNK_CHARS})::BIGINT AS chunk, min(start)::BIGINT AS start, count(*)::BIGINT AS n_turns,
  count(*) FILTER (target)::BIGINT AS n_target, string_agg(segment, '' ORDER BY pos) AS rendered,
  coalesce(string_agg((start + length(head))::BIGINT || ':' || (start + length(head) + length(body))::BIGINT, ',' ORDER BY pos) FILTER (target), '') AS mask
FROM o GROUP BY conv_id, perspective, start // {CHUNK_CHARS}"""
