"""Chat formatting with rotated perspectives.

For every participant of a dialogue the whole dialogue is rendered with that
speaker as the assistant and all others as named users; the mask has the
character ranges of the assistant's own words and end marks, which are to be
learned. Turns of `system_roles` stay system turns and are nobody's
perspective; a dialogue with no other turns gives no rows.

Long dialogues come in parts of `part_turns` turns, so that none has to fit in
one task: positions are counted within chunks of turn numbers and digests and
carried across chunks by sums over one row per chunk.

Turns follow turn number (null first), then a digest of role and text.
Repeats of a whole turn (same dialogue, number, role and text) count once. A
null dialogue id is a dialogue; a null role is called `unknown`; a null text is
empty. `<|` within texts and names is written `< |`, so that no text can forge
a mark. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 64
TURN_BLOCK = 4096
END = "<|end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def ordered_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, role, text, position) with positions from 0 in each dialogue."""
    role, text = F.coalesce(F.col(role_col), F.lit("unknown")), F.coalesce(F.col(text_col), F.lit(""))
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).distinct()
    digest = F.md5(F.concat_ws("\n", "role", "text").cast("binary"))
    turns = turns.select("*", digest.alias("digest"), F.floor(F.col("turn") / TURN_BLOCK).alias("block")).withColumn("cell", F.left("digest", F.lit(2)))
    cells = turns.groupBy("conv", "block", "turn", "cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = cells.groupBy("conv", "block").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("conv", "block", earlier(Window.partitionBy("conv").orderBy(F.asc_nulls_first("block"))).alias("blocks_before"))
    cells = cells.select("conv", "block", "turn", "cell", earlier(Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "cell")).alias("cells_before"))
    within = Window.partitionBy("conv", "block", "turn", "cell").orderBy("digest", "role", "text")
    ranked = turns.withColumn("within", F.row_number().over(within) - 1)

    def matched(left, right, keys):
        right = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], right.columns[-1])
        condition = F.lit(True)
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"r_{k}"))
        return left.join(right, condition).drop(*[f"r_{k}" for k in keys])

    placed = matched(matched(ranked, cells, ["conv", "block", "turn", "cell"]), blocks, ["conv", "block"])
    return placed.select("conv", "role", "text", (F.col("blocks_before") + F.col("cells_before") + F.col("within")).alias("position"))


def rotate(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *,
    system_roles: tuple[str, ...] = ("system",), part_turns: int = PART_TURNS,
) -> DataFrame:
    """(conv id, speaker, part, n_turns, text, mask array of (start, stop)) per participant and part."""
    turns = ordered_turns(df, conv_col, turn_col, role_col, text_col).withColumn("part", F.floor(F.col("position") / part_turns))
    parts = turns.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    speakers = turns.where(~F.col("role").isin(*system_roles)).select(F.col("conv").alias("of"), F.col("role").alias("speaker")).distinct()
    rotated = parts.join(speakers, F.col("conv").eqNullSafe(F.col("of")))

    def rendered(turn):
        own = turn["role"] == F.col("speaker")
        head = F.when(own, F.lit("<|assistant|>\n")).when(turn["role"].isin(*system_roles), F.lit("<|system|>\n")).otherwise(
            F.concat(F.lit("<|user name="), _safe(turn["role"]), F.lit("|>\n"))
        )
        return F.struct(own.alias("own"), F.length(head).alias("head"), F.concat(head, _safe(turn["text"]), F.lit(END)).alias("text"))

    rotated = rotated.withColumn("pieces", F.transform("turns", rendered))

    def step(state, piece):
        stop = state["at"] + F.length(piece["text"])
        span = F.struct((state["at"] + piece["head"]).alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(piece["own"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    return rotated.select(
        F.col("conv").alias(conv_col), "speaker", "part", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
        F.aggregate("pieces", start, step, lambda state: state["spans"]).alias("mask"),
    )
