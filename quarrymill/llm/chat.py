"""Multi-party chats rendered from every participant's side.

For each participant the dialogue is written with that speaker as the assistant and all others as named
users; the mask holds the assistant's own words. Long conversations are cut into parts by the rank of their turns,
so no row holds more than PART_TURNS turns, whatever their numbers; parts in order make up the whole. Ranks come from range parts of the
sorted turns, so that no task holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.llm.common import BROADCAST_IDS, materialize

PART_TURNS = 512
#: Speakers that are never a perspective; their turns are shown as they are.
NEUTRAL = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _head(role: Column, perspective: Column) -> Column:
    name = (
        F.when(role == perspective, F.lit("assistant"))
        .when(role.isin(*NEUTRAL), role)
        .otherwise(F.concat(F.lit("user name="), role))
    )
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def ranked(turns: DataFrame) -> DataFrame:
    """Adds ``rank``, 0, 1, ... by conversation in order of turn, role and text.

    Turns are range-partitioned by conversation and order (equal ones by a random number); ranks inside a partition are
    shifted by the turns of the conversation in the partitions before.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = turns.withColumn("_z", F.rand(7)).repartitionByRange(n, "conv_id", "t", "_z")
    cut = materialize(spread.drop("_z").withColumn("_p", F.spark_partition_id()), "turns")
    sizes = cut.groupBy(F.col("conv_id").alias("_c"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_c").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("conv_id", "_p").orderBy("t")) - 1
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_p") == F.col("_q"))
    return cut.withColumn("_own", own).join(starts, same).select("conv_id", "t", (F.col("_start") + F.col("_own")).alias("rank"))


def _by_length(turns: DataFrame, part_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """The turns of conversations of up to ``part_turns`` turns, and those of longer ones, which alone need ranks; None if there are none."""
    n = turns.groupBy(F.col("conv_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    ids = materialize(n.where(F.col("_n") > part_turns).select("_c"), "long")
    several = ids.limit(BROADCAST_IDS + 1).count()
    if not several:
        return turns, None
    ids = F.broadcast(ids) if several <= BROADCAST_IDS else ids
    of = turns["conv_id"].eqNullSafe(F.col("_c"))
    return turns.join(ids, of, "left_anti"), turns.join(ids, of, "left_semi")


def rotate_perspectives(conversations: DataFrame, part_turns: int | None = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part: conv_id, perspective, part, n_turns, rendered, mask, n_masked.

    With ``part_turns`` None no conversation is cut: each is one row for each participant, with part 0 and places in the whole text. Such a row
    holds all of its dialogue, so that this is for tables whose longest conversation fits a task.

    ``conversations`` has conv_id, turn, role, text. Turns are in order of turn, role, text; null turns
    come first. A null role is the participant "unknown", a null text is empty. mask lists
    start:end in code points, end exclusive, of the perspective's words in ``rendered``, joined by commas
    (empty texts too); it is empty in parts where they say nothing. Repeated rows are turns of their own. A null
    conv_id is a conversation. Conversations with neutral speakers alone have no perspective and no row. An empty table gives an empty
    result; other columns are ignored, whatever their names. Long texts stay whole. Jobs run while the plan is built.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    short, long = (turns, None) if part_turns is None else _by_length(turns, part_turns)
    roles = F.array_distinct(F.transform("turns", lambda t: t["role"]))
    sides = short.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id",
        F.lit(0).cast("long").alias("part"),
        "turns",
        F.explode(F.array_except(roles, F.array(*[F.lit(x) for x in NEUTRAL]))).alias("perspective"),
    )
    if long is not None:
        cut = ranked(long)
        parts = cut.groupBy("conv_id", F.floor(F.col("rank") / part_turns).cast("long").alias("part")).agg(F.sort_array(F.collect_list("t")).alias("turns"))
        people = cut.select(F.col("conv_id").alias("c"), F.col("t.role").alias("perspective")).distinct()
        people = people.where(~F.col("perspective").isin(*NEUTRAL))
        sides = sides.unionByName(parts.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))

    def side(t: Column) -> Column:
        head = _head(t["role"], F.col("perspective"))
        return F.struct(head.alias("head"), t["text"].alias("text"), (t["role"] == F.col("perspective")).alias("own"))

    shown = sides.withColumn("shown", F.transform("turns", side))
    done = F.length(F.lit(CLOSE))
    spans = F.aggregate(
        "shown",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("n")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["text"]) + done).cast("long").alias("at"),
            F.when(
                t["own"],
                F.array_append(
                    acc["spans"],
                    F.concat_ws(
                        ":",
                        (acc["at"] + F.length(t["head"])).cast("string"),
                        (acc["at"] + F.length(t["head"]) + F.length(t["text"])).cast("string"),
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
            (acc["n"] + F.when(t["own"], F.length(t["text"])).otherwise(0)).cast("long").alias("n"),
        ),
    )
    return shown.withColumn("m", spans).select(
        "conv_id",
        "perspective",
        "part",
        F.size("shown").cast("long").alias("n_turns"),
        F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE))), "").alias("rendered"),
        F.array_join("m.spans", ",").alias("mask"),
        F.col("m.n").alias("n_masked"),
    )
