"""Word budgets of blank, missing and oddly spaced texts against their SQL."""

import check_oracle
import duckdb

import __spark_entry__ as entry

TEXTS = ["", " ", "\n\t ", None, "\x0b", "a\x0bb", "\x0ba b\x0b", " \x0b a \x0b ", "a\x0cb\rc", "a b", "a\x1cb\x85c", "\x0b".join("abcdefghijkl"), " \x0b ".join("abcdefghijkl") + " ", "x  y\n" * 21]


def test_word_budget(spark, tmp_path):
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    name = "c8_word_budget"
    ok, message = check_oracle.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert ok, message
