"""A few registered queries against DuckDB at the smallest size, and the contract of the entry module."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from kernelweave.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SOME = ["cox_fit", "multinomial_fit", "multi_response_path", "default_path", "glm_cross_validation", "trial_image_raw", "trial_image_modelled", "parameter_curves", "parameter_image", "interval_sets", "grouped_quantiles", "marginal_average", "residual_signal", "active_runs", "event_density", "topographies", "yuen_test", "sparse_fit", "kept_predictors", "epoch_first_event", "design_custom_spline", "weighted_auc", "gram", "expand_splines", "impute_marginal", "model_r2", "model_partial_r2", "model_cv_partial_r2", "tidy_export", "artefact_bursts", "model_events", "design_reference", "design_effects", "hazen_quantiles", "expand_sticks", "overlap_fit", "epoch_fit", "merge_intervals", "exclude_intervals", "artefact_amplitude"]


@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, sf).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)

    def rows(df):
        return sorted(tuple("" if pd.isna(v) else f"{v:.8g}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False, name=None))

    assert rows(got) == rows(want)


def test_entry_has_every_query():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 55


def test_entry_without_the_llm_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "kernelweave", copy / "kernelweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; assert 'overlap_fit' in e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
