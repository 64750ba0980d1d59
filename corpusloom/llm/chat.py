"""Chat formatting: a dialogue from the perspective of each of its participants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNNAMED = "system", "unknown"
#: The turns of a rendered part: what one cell holds is bounded, however long a dialogue is.
PART = 1024


def perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """For every participant of a conversation, every turn as it reads with that participant as the assistant.

    A row per turn and participant: the conversation, speaker (whose perspective it is), turn, chat_role (assistant for the
    speaker's own turns, system for system turns, user for all others), name (the others' role), segment (the rendered turn)
    and the part of it that is trained on: code points mask_start to mask_end, the speaker's words and the end mark; empty
    (0, 0) elsewhere. A rendering is its segments in the order of turn. System turns belong to every rendering and are no
    participant's. Null role: the participant `unknown`. Null text: empty. Null conversation: a conversation of its own.
    Repeated or tied turns are rendered each; a conversation of system turns only has no rendering. Empty input: no rows.
    Turns are kept as rows, so a conversation of any length is spread over tasks; one join of turns with the distinct
    participants of their conversation, which Spark splits where a conversation is very long.
    """
    turns = conversations.select(
        F.col(conv_col).alias("c"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(UNNAMED)).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    speakers = turns.filter(F.col("role") != SYSTEM).select(F.col("c").alias("sc"), F.col("role").alias("speaker")).distinct()
    seen = turns.join(speakers, F.col("c").eqNullSafe(F.col("sc")))
    kind = F.when(F.col("role") == SYSTEM, SYSTEM).when(F.col("role") == F.col("speaker"), "assistant").otherwise("user")
    seen = seen.withColumn("chat_role", kind).withColumn("name", F.when(F.col("chat_role") == "user", F.col("role")))
    head = F.concat(F.lit(OPEN), "chat_role", F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(F.lit("")), F.lit("\n"))
    seen = seen.withColumn("head", head).withColumn("segment", F.concat("head", "t", F.lit(CLOSE)))
    trained = F.col("chat_role") == "assistant"
    return seen.select(
        F.col("c").alias(conv_col), "speaker", F.col("turn").alias(turn_col), "chat_role", "name", "segment",
        F.when(trained, F.length("head")).otherwise(0).cast("long").alias("mask_start"), F.when(trained, F.length("segment") - 1).otherwise(0).cast("long").alias("mask_end"),
    )


def dialogues(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The renderings of perspectives() as whole texts: conversation, speaker, part, text and masks.

    text is the segments in the order of turn (ties: of segment); masks are the trained runs of code points in it (from, to).
    Turns 0 to PART - 1 are part 0, the next part 1 and so on (null turns: part null); a rendering is its parts joined in order, and most
    dialogues have one. Nulls, repeats and empty input: as in perspectives().
    """
    rows = perspectives(conversations, conv_col, turn_col, role_col, text_col).withColumn("part", F.floor(F.col(turn_col) / PART).cast("long"))
    group = [conv_col, "speaker", "part"]
    before = F.sum(F.length("segment")).over(Window.partitionBy(*group).orderBy(turn_col, "segment").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0)))
    parts = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "segment", "mask_start", "mask_end"))).alias("p"))
    trained = F.filter("p", lambda x: x["mask_end"] > x["mask_start"])
    masks = F.transform(trained, lambda x: F.struct((x["at"] + x["mask_start"]).alias("from"), (x["at"] + x["mask_end"]).alias("to")))
    return parts.select(*group, F.array_join(F.col("p.segment"), "").alias("text"), masks.alias("masks"))
