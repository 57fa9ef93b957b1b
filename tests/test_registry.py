"""Registered queries give what their oracles give."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from treeledger import registry

#: A share of the queries; the driver compares all of them.
CHECKED = ["ledger_deltas", "paths_at", "listdir_at", "effective_rights", "inode_read_allowed", "diff_root", "merge_conflicts", "merge_plan_ops", "retain_bindings", "events_by_kind", "gc_counts", "grep_scoped", "grep_over_lines", "stat_by_path", "walk_dfs", "index_reorganized_and_pruned", "preconditions_over_tables", "merge_execution", "namespace_statistics"]


def rows(frame):
    plain = lambda v: "~" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
