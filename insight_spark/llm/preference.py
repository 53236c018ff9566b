"""Preference formatting: one prompt and two masked completions per pair of conversations.

The turns that chosen and rejected have in common from the start are rendered
once, as the prompt; what follows is rendered per side. The output has a row per
turn, so a conversation of any length is never gathered into one row or task;
in the order of ``turn`` the rows of a part make up its text. Built-in functions
only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The ChatML signs around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _side(df: DataFrame, side: str, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.col(pair_col).alias("pair_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.lower(F.trim(F.coalesce(F.col(role_col), F.lit("")))).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.lit(side == "chosen").alias("_c"), F.lit(side == "rejected").alias("_r"),
    )


def format_pairs(
    chosen: DataFrame,
    rejected: DataFrame,
    pair_col: str = "pair_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows (pair_id, part, turn, role, context, target, paired) from two tables of turns.

    ``part`` is prompt, chosen or rejected. ``context`` is rendered but masked;
    ``target`` is what the loss is taken on: in a completion the text and end of
    an assistant's turn, elsewhere empty. ``paired`` says that both sides of the
    pair have a target. Signs of the template within a text are broken up.

    A null role or text counts as empty, roles are compared in lower case
    without outer blanks. Turns go by their number, a null number is the last. A
    repeated turn counts once; different rows of one number stand in the order
    of role and text, and are common only if all of them are. A null pair id is
    a pair of its own. A pair that is on one side only, or has no difference,
    stays: all its turns are that side's completion, or the prompt. Empty tables
    give no rows; other columns are not read.
    """
    names = (pair_col, turn_col, role_col, text_col)
    both = _side(chosen, "chosen", *names).unionByName(_side(rejected, "rejected", *names))
    last = F.coalesce("turn", F.lit((1 << 63) - 1))
    turns = (
        both.groupBy("pair_id", "turn", "role", "text").agg(F.max("_c").alias("_c"), F.max("_r").alias("_r"))
        .withColumn("_at", last)
    )
    trained = F.col("role") == TRAINED_ROLE
    pairs = turns.groupBy(F.col("pair_id").alias("_pair")).agg(
        F.min(F.when(F.col("_c") != F.col("_r"), F.col("_at"))).alias("_split"),
        F.max(F.when(F.col("_c") & trained, F.col("_at"))).alias("_chosen_last"),
        F.max(F.when(F.col("_r") & trained, F.col("_at"))).alias("_rejected_last"),
    )
    placed = turns.join(pairs, F.col("pair_id").eqNullSafe(F.col("_pair")))
    prompt = F.col("_split").isNull() | (F.col("_at") < F.col("_split"))
    parts = F.when(prompt, F.array(F.lit("prompt"))).otherwise(
        F.array_compact(F.array(F.when(F.col("_c"), F.lit("chosen")), F.when(F.col("_r"), F.lit("rejected"))))
    )
    paired = F.coalesce(
        (F.col("_chosen_last") >= F.col("_split")) & (F.col("_rejected_last") >= F.col("_split")), F.lit(False)
    )
    learned = trained & (F.col("part") != "prompt")
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"))
    body = F.concat(F.replace("text", F.lit("<|"), F.lit("< |")), F.lit(CLOSE))
    return placed.select("*", F.explode(parts).alias("part")).select(
        "pair_id", "part", "turn", "role", F.when(learned, head).otherwise(F.concat(head, body)).alias("context"),
        F.when(learned, body).otherwise(F.lit("")).alias("target"), paired.alias("paired"),
    )


def echo_rejections(conversations: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The conversations as an assistant would have them that repeats what it was just told.

    The text of the last assistant's turn becomes the text of the turn numbered
    just before it, or empty. Other turns stay.
    """
    last = (
        conversations.filter(F.lower(F.trim(F.col(role_col))) == TRAINED_ROLE)
        .groupBy(F.col(pair_col).alias("_pair")).agg(F.max(turn_col).alias("_last"))
    )
    rows = conversations.select(pair_col, turn_col, role_col, text_col).join(
        last, F.col(pair_col).eqNullSafe(F.col("_pair")), "left"
    )
    told = rows.filter(F.col(turn_col) == F.col("_last") - 1).groupBy(
        F.col(pair_col).alias("_told"), (F.col(turn_col) + 1).alias("_told_turn")
    ).agg(F.min(text_col).alias("_echo"))
    heard = (
        F.col(pair_col).eqNullSafe(F.col("_told")) & (F.col(turn_col) == F.col("_told_turn"))
        & (F.lower(F.trim(F.col(role_col))) == TRAINED_ROLE)
    )
    replaced = (F.col(turn_col) == F.col("_last")) & (F.lower(F.trim(F.col(role_col))) == TRAINED_ROLE)
    return rows.join(told, heard, "left").select(
        pair_col, turn_col, role_col,
        F.when(replaced, F.coalesce("_echo", F.lit(""))).otherwise(F.col(text_col)).alias(text_col),
    )


ORACLE = f"""
WITH last AS (
  SELECT conv_id, max(turn) AS last FROM conversations WHERE lower(trim(role)) = '{TRAINED_ROLE}' GROUP BY conv_id
), told AS (
  SELECT c.conv_id, c.turn + 1 AS turn, min(c.text) AS echo
  FROM conversations c JOIN last l ON c.conv_id = l.conv_id AND c.turn = l.last - 1 GROUP BY c.conv_id, c.turn
), both_sides AS (
  SELECT conv_id, turn, role, text, true AS c, false AS r FROM conversations
  UNION ALL
  SELECT c.conv_id, c.turn, c.role,
         CASE WHEN c.turn = l.last AND lower(trim(c.role)) = '{TRAINED_ROLE}' THEN coalesce(t.echo, '') ELSE c.text END,
         false, true
  FROM conversations c LEFT JOIN last l ON c.conv_id = l.conv_id
  LEFT JOIN told t ON c.conv_id = t.conv_id AND c.turn = t.turn
), turns AS (
  SELECT conv_id, turn, role, text, bool_or(c) AS c, bool_or(r) AS r
  FROM (SELECT conv_id, turn, lower(trim(coalesce(role, ''))) AS role, coalesce(text, '') AS text, c, r FROM both_sides)
  GROUP BY conv_id, turn, role, text
), pairs AS (
  SELECT conv_id, min(CASE WHEN c <> r THEN turn END) AS split,
         max(CASE WHEN c AND role = '{TRAINED_ROLE}' THEN turn END) AS chosen_last,
         max(CASE WHEN r AND role = '{TRAINED_ROLE}' THEN turn END) AS rejected_last
  FROM turns GROUP BY conv_id
), parts AS (
  SELECT t.*, p.split, coalesce(chosen_last >= split AND rejected_last >= split, false) AS paired,
         unnest(CASE WHEN split IS NULL OR turn < split THEN ['prompt'] WHEN c AND r THEN ['chosen', 'rejected']
                     WHEN c THEN ['chosen'] ELSE ['rejected'] END) AS part
  FROM turns t JOIN pairs p ON t.conv_id = p.conv_id
), rendered AS (
  SELECT *, '{OPEN}' || role || chr(10) AS head, replace(text, '<|', '< |') || '{CLOSE.strip()}' || chr(10) AS body,
         role = '{TRAINED_ROLE}' AND part <> 'prompt' AS learned
  FROM parts
)
SELECT conv_id AS pair_id, part, turn, role, CASE WHEN learned THEN head ELSE head || body END AS context,
       CASE WHEN learned THEN body ELSE '' END AS target, paired
FROM rendered
"""
