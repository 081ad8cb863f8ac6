"""Every query of the catalogue against its SQL, or for rows where SQL can't express it."""

import shutil

import duckdb
import pytest
from oracle import same

import __spark_entry__ as entry
from rastrel.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["c8_inspector", "k5_export_union"])
def test_lengths_between_cents_round_as_sql(spark, sf_dir, tmp_path, name):
    """Balances of every half: a hundredth of them lies, but for its last bits, between two cents."""
    shutil.copy(f"{sf_dir}/supplier.parquet", tmp_path / "supplier.parquet")
    rows = "SELECT (35 * i + 1)::BIGINT AS c_custkey, 'n' AS c_name, 1::INTEGER AS c_nationkey, i / 2.0::DOUBLE AS c_acctbal, 's' AS c_mktsegment FROM range(-2000, 20000) t(i)"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    same(catalogue.QUERIES[name](spark, str(tmp_path)), catalogue.ORACLE_SQL[name], str(tmp_path))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
