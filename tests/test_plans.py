"""A selection of registered queries against their SQL on the smallest tables, and plan checks."""

import inspect
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of
from tabulens.operators import explain, models, scores, splits
from tabulens.plans import modelling, relations

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CHOSEN = [
    "profile_numeric", "classify_columns", "suggest_target", "missing_heatmap", "clean_missing",
    "tx_quantile_bin", "hist_numeric", "kde_on_bins", "box_outliers", "outliers_present",
    "corr_kendall_matrix", "score_mutual_info_reg", "roc_align", "bootstrap_ci_class", "drift_ks",
    "apply_meta", "stratified_kfold_assign", "predict_batch", "stream_score",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = db.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 8


@needs_data
def test_scans_read_only_the_needed_columns(spark):
    plan = entry.queries()["fill_median"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]
    split = entry.queries()["train_test_split"](spark, FOLDER)
    text = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Sort" not in text  # the cut needs no shuffle of the rows


def asked(monkeypatch, home, frame, owner, operator, query):
    """All arguments, defaults included, that a query gives to its operator, which does not run."""
    seen, real = {}, inspect.signature(getattr(owner, operator))

    def noted(*args, **kw):
        bound = real.bind(*args, **kw)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(home, frame, lambda spark, folder: None)
    monkeypatch.setattr(owner, operator, noted)
    with pytest.raises(InterruptedError):
        entry.queries()[query](None, "")
    return seen


def test_boosting_query_runs_all_rounds(monkeypatch):
    seen = asked(monkeypatch, modelling, "_multi_frame", modelling, "_holdout", "clf_boost")
    assert {**models.DEFAULTS[models.BOOST], **(seen["params"] or {})} == models.DEFAULTS[models.BOOST]


def test_learning_curve_query_grows_whole_forests(monkeypatch):
    seen = asked(monkeypatch, modelling, "_reg_frame", explain, "learning_curve", "learning_curve")
    assert {**models.DEFAULTS[models.FOREST], **(seen["params"] or {})} == models.DEFAULTS[models.FOREST]
    assert seen["folds"] == splits.FOLDS and seen["fractions"] == explain.FRACTIONS


def test_elimination_query_grows_whole_forests(monkeypatch):
    seen = asked(monkeypatch, modelling, "_reg_frame", explain, "rfecv", "rfecv")
    assert (seen["folds"], seen["step"], seen["trees"], seen["max_depth"]) == (splits.FOLDS, 1, explain.ELIMINATION_TREES, 10)


def test_forest_importance_query_grows_all_trees(monkeypatch):
    seen = asked(monkeypatch, relations, "_reg", scores, "score_rf_importance", "score_rf_importance")
    assert seen["trees"] == scores.FOREST_TREES == 100
