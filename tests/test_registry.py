"""Registration rules, and a few queries against their oracle on the smallest tables."""
import re

import duckdb
import pytest

import __spark_entry__ as entry
from modalframe.fixtures import TABLES

PREFIXES = {"s": 14, "p": 35, "j": 38, "a": 72, "w": 18, "k": 6, "u": 5}
SAMPLE = ["j03_mode_candidates", "a05_comac", "j05_nearest_frequency", "w03_close_groups", "a23_cmif_singular_values", "j06_nearest_node", "j16_branch_tracking",
          "a31_trigger_groups", "a59_bounded_fit", "a46_leave_one_family_out", "j13_reconciled_frequencies", "s09_matrix_files", "s07_log_eigenvalues",
          "a45_shared_against_separate_k3", "a46_leave_one_family_out_k3", "a46_robustness_range_k3", "a59_bounded_fit_k3", "a59_fit_residuals_k3", "a16_subspace_mac_of_three", "a18_energy_in_span_of_three"]


def test_every_operator_of_the_inventory_has_a_query():
    have = {name.split("_")[0] for name in entry.queries()}
    want = {f"{p}{i:02d}" for p, n in PREFIXES.items() for i in range(1, n + 1)}
    assert want <= have
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_read_whole_tables():
    for text in entry.oracle_sql().values():
        assert not re.search(r"\bLIMIT\b", text, re.IGNORECASE)


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    got = sorted(map(repr, (tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in df.collect())))
    cur = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    want = sorted(map(repr, (tuple(round(r[i], 4) if isinstance(r[i], float) else r[i] for i in order) for r in cur.fetchall())))
    assert got == want
