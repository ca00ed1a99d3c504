"""Transcripts as text parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.operators.scan import SEQ_CHUNK, by_width, ordered_scan

LIMIT = 30_000  # fixed values: longer transcripts are cut into chunks
CHUNK = 25_000


def transcript_lines(messages: DataFrame) -> DataFrame:
    """(session_id, seq, idx, line): what the user and the assistant said, tools by name."""
    user = messages.where("is_human").where(F.substring("text", 1, 500).rlike(r"\S")).select(
        "session_id", "seq", F.lit(0).alias("idx"), F.concat(F.lit("[User]: "), F.substring("text", 1, 500)).alias("line")
    )
    block = messages.where("role = 'assistant'").select("session_id", "seq", F.posexplode("blocks").alias("idx", "b"))
    line = F.when((F.col("b.type") == "text") & (F.col("b.text") != ""), F.concat(F.lit("[Assistant]: "), F.substring("b.text", 1, 300))).when(
        (F.col("b.type") == "toolCall") & (F.col("b.name") != ""), F.concat(F.lit("[Tool: "), F.col("b.name"), F.lit("]"))
    )
    said = block.select("session_id", "seq", "idx", line.alias("line")).where("line is not null")
    return user.unionByName(said)


def header_lines(sessions: DataFrame) -> DataFrame:
    """The opening lines of a transcript, before every record."""
    lines = F.array(
        F.concat(F.lit("Session: "), F.substring("session_id", 1, 8)),
        F.concat(F.lit("Date: "), F.col("start_time")),
        F.concat(F.lit("Project: "), F.col("project_path")),
        F.concat(F.lit("Duration: "), F.col("duration_minutes"), F.lit(" min")),
        F.lit(""),
    )
    return sessions.select("session_id", F.lit(-1).cast("bigint").alias("seq"), F.posexplode(lines).alias("idx", "line"))


def transcript_parts(lines: DataFrame, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(session_id, part, parts, text): whole transcripts in bounded parts.

    A transcript up to `limit` characters is one part; a longer one is cut
    every `chunk` characters. Each line is placed by its offset first, so no
    group ever holds more text than one part.
    """
    size = F.length("line") + 1
    placed = ordered_scan(
        lines, ["session_id"], ["seq", "idx"], by_width(F.col("seq") + 1, SEQ_CHUNK),
        sums={"stop": size}, totals={"total": size},
    )
    start = F.col("stop") - size
    width = F.when(F.col("total") - 1 > limit, F.lit(chunk)).otherwise(F.lit(limit + 1))
    body = F.when(F.col("stop") == F.col("total"), F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    spread = placed.withColumn("start", start).withColumn("width", width).withColumn("body", body).where("length(body) > 0").withColumn(
        "part", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("start") + F.length("body") - 1) / F.col("width"))))
    )
    skip = F.greatest(F.lit(0), F.col("part") * F.col("width") - F.col("start"))
    upto = (F.col("part") + 1) * F.col("width") - F.col("start")
    piece = F.substr("body", (skip + 1).cast("int"), (upto - skip).cast("int"))
    parts = F.ceil((F.col("total") - 1) / F.col("width"))
    return spread.withColumn("piece", piece).groupBy("session_id", "part").agg(
        F.max(parts).alias("parts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("text"),
    )


def score_parts(
    parts: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Run a user's scorer (a model call, a rule set) over transcript parts.

    The scorer sees Arrow batches of session_id, part, parts, text and returns
    rows of `schema`.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return parts.select("session_id", "part", "parts", "text").mapInPandas(run, schema)
