"""Every registered query against its SQL, on the smallest tables."""

import __spark_entry__ as entry
import duckdb
import pytest
from corpus_jobs.operators import keyword_index
from corpus_jobs.storage import materialize
from pyspark.sql import functions as F

from .compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.registry.QUERIES, entry.registry.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    cards = entry.entry(spark)
    assert cards.count() > 0 and "document_id" in cards.columns


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Parts whose numbers repeat: fifteen of each identifier."""
    folder = str(tmp_path_factory.mktemp("repeated") / "sf")
    part = spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey < 12").crossJoin(spark.range(15))
    part.withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 89999).drop("id").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["j3_identifier_phrase", "k5_identifier_search"])
def test_repeated_identifiers(spark, repeated, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{repeated}/part.parquet/*.parquet')")
    assert difference(spark, con, QUERIES[name], SQL[name], repeated) is None


@pytest.mark.parametrize("name", ["j3_identifier_phrase", "k5_identifier_search"])
def test_repeated_identifiers_make_no_rows_of_other_collections(spark, repeated, monkeypatch, name):
    made = []

    def counted(df, name):
        out = materialize(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(keyword_index, "materialize", counted)
    QUERIES[name](spark, repeated)
    starts = [n for name, n in made if name == "starts"]
    n_parts = spark.read.parquet(f"{repeated}/part.parquet").count()
    assert starts and 0 < max(starts) <= n_parts
