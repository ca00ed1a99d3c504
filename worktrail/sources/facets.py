"""Session labels (facets) read from JSON, one object per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.operators.labels import is_valid_facet, normalise_keys

COUNTS = {"goal": "goal_categories", "satisfaction": "user_satisfaction_counts", "friction": "friction_counts"}
SCHEMA = (
    "session_id string, underlying_goal string, goal_categories map<string,double>, outcome string, user_satisfaction_counts map<string,double>, "
    "assistant_helpfulness string, session_type string, friction_counts map<string,double>, friction_detail string, primary_success string, "
    "brief_summary string, user_instructions_to_assistant array<string>, abort_labels array<struct<ts:string,label:string>>"
)


def parse_facets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Facets with a `status`: valid, incomplete (no id, summary or outcome) or broken (no JSON object).

    One pass tells the three apart; fields of a wrong type read as missing.
    """
    whole = F.try_parse_json(F.trim(F.col(column)))
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    read = lines.select(is_object.alias("_object"), F.from_json(column, SCHEMA).alias("f")).select("_object", "f.*")
    status = F.when(~F.col("_object"), "broken").when(is_valid_facet(), "valid").otherwise("incomplete")
    return read.withColumn("status", status).drop("_object").withColumnRenamed("user_instructions_to_assistant", "instructions")


def read_facets(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Facets of text files, a JSON object per line."""
    return parse_facets(spark.read.text(path).where(F.trim("value") != ""))


def facet_status(facets: DataFrame) -> DataFrame:
    """(status, n) of all three, zeros included."""
    cells = F.array(*[F.struct(F.lit(s).alias("status"), F.count_if(F.col("status") == s).alias("n")) for s in ("valid", "incomplete", "broken")])
    return facets.agg(cells.alias("cells")).select(F.inline("cells"))


def facet_counts(facets: DataFrame) -> DataFrame:
    """(session_id, dim, key, n) of valid facets; friction keys are cleaned up."""
    good = facets.where("status = 'valid'")
    long = lambda dim, column: good.select("session_id", F.lit(dim).alias("dim"), F.explode(column).alias("key", "n"))
    friction = normalise_keys(long("friction", COUNTS["friction"]), ["session_id", "dim"]).select("session_id", "dim", "key", "n")
    plain = [long(dim, column).where("n is not null") for dim, column in COUNTS.items() if dim != "friction"]
    return plain[0].unionByName(plain[1]).unionByName(friction)
