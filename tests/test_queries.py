"""Every registered query of the reference's operators against its SQL in DuckDB, on the smallest tables."""

import glob
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__
from strandloom import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def told(x):
    if isinstance(x, float):
        return "NULL" if x != x else repr(round(x, 6))
    return "NULL" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, con, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(told(r[c]) for c in columns) for r in df.collect())
    own = con.execute(plans.oracle_sql()[name])
    there = [d[0] for d in own.description]
    assert sorted(there) == columns
    want = sorted(tuple(told(r[there.index(c)]) for c in columns) for r in own.fetchall())
    assert got == want


def test_registry():
    names = set(__spark_entry__.queries())
    assert set(plans.queries()) <= names and set(__spark_entry__.oracle_sql()) <= names
    if importlib.util.find_spec("strandloom.llm"):
        assert {f"op{i}_" for i in range(1, 11)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names


def test_contigs_reach_all_calls(spark, tmp_path):
    """Positions past 36,000, as the larger tables have them, keep their context."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_partkey >= 2")  # the start of a contig cuts windows
    rows.write.parquet(f"{tmp_path}/near/lineitem.parquet")
    far = rows.withColumn("l_partkey", (rows.l_partkey + 9 * 28_000).cast(rows.schema["l_partkey"].dataType))  # the same place in the period
    far.write.parquet(f"{tmp_path}/far/lineitem.parquet")
    for name in ("motif_filter", "split_by_motif"):
        near, moved = (sorted(map(tuple, plans.queries()[name](spark, f"{tmp_path}/{d}").collect())) for d in ("near", "far"))
        assert near and near == moved
