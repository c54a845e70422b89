import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidewake import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
#: One or two queries of each module and kind; all of them at larger sizes are compared outside of the tests.
SAMPLE = [
    "canonical_dedup", "case_workflow", "snapshot_case_summary", "reconciliation_full_outer", "rejection_chain", "timezone_offsets", "json_numbers", "code_in_columns", "many_to_one_contract", "rank_auc", "average_precision", "reliability_bins_wilson", "km_rmst", "psi_quantile",
    "two_sided_p_values", "logistic_calibration_toxic", "did_service_effects", "before_after_z51", "subgroup_effects", "sensitivity_shifts", "missingness_effects", "uplift_bins", "weekly_metrics", "weekly_monitor", "replay_conflicts", "metric_provenance", "components",
    "component_listing", "component_members", "trailing_sketches", "study_clocks", "bias_ledger", "endpoint_sensitivity", "guarded_template_16", "guarded_answers", "two_way_fixed_effects", "monitor_snapshot",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.FLAGSHIP in catalog.queries()


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for part in ("tidewake", "__spark_entry__.py"):
        source = ROOT / part
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / part, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(s) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    text = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted([text(r[c]) for c in columns] for r in df.collect())
    want = sorted([text(v) for v in r] for r in con.sql(f"""SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.oracle_sql()[name]})""").fetchall())
    assert got == want
