"""From CSV files to CSV results."""

import pandas as pd
import pytest

from entitymill.operators import models as md
from entitymill.plans import histories as h
from entitymill.plans import runs
from entitymill.queries import Tables, derived
from entitymill.sources.tables import FILE_ORDER, read_csv

FOLDER = "/root/testdata/sf0.001"
ROW_KEYS = {
    "application": ["SK_ID_CURR"], "application_test": ["SK_ID_CURR"],
    "bureau": ["SK_ID_BUREAU"], "previous_application": ["SK_ID_PREV"],
    "credit_card": ["ROW_TIME", "SK_ID_PREV"],
}


@pytest.fixture(scope="module")
def csv_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    tables = derived.tables(Tables(spark, FOLDER))
    base = tables["application"]
    tables["application"] = base.filter("TARGET IS NOT NULL")
    tables["application_test"] = base.filter("TARGET IS NULL").drop("TARGET")
    for name, df in tables.items():
        keys = ROW_KEYS.get(name, [c for c in df.columns if c.startswith("ROW_")])
        pdf = df.toPandas()
        pdf = pdf.sort_values(keys) if keys else pdf
        pdf = pdf.drop(columns=[c for c in pdf.columns if c.startswith("ROW_")])
        pdf.to_csv(folder / runs.FILES[name], index=False)
    return str(folder)


def test_file_order_replaces_a_key(spark, csv_folder):
    tables = runs.load_tables(spark, csv_folder)
    by_file = h.previous_features(tables["previous_application"], [FILE_ORDER])
    by_key = h.previous_features(derived.tables(Tables(spark, FOLDER))["previous_application"])
    a, b = (d.toPandas().set_index("SK_ID_CURR").sort_index() for d in (by_file, by_key))
    pd.testing.assert_frame_equal(a[b.columns], b, rtol=1e-9, atol=1e-9)


def test_first_rows_per_table(spark, csv_folder):
    tables = runs.load_tables(spark, csv_folder, num_rows=20)
    assert {name: df.count() for name, df in tables.items()} == dict.fromkeys(runs.FILES, 20)


def test_whole_run(spark, csv_folder, tmp_path):
    stage = str(tmp_path / "stage")
    trial = runs.build_matrix(spark, csv_folder, stage, num_rows=20, reuse=True)
    matrix = runs.build_matrix(spark, csv_folder, stage, reuse=True)
    assert trial.count() <= 40 < matrix.count()
    again = runs.build_matrix(spark, csv_folder, stage, reuse=True)
    assert set(again.inputFiles()) == set(matrix.inputFiles())
    assert again.columns == matrix.columns and len(matrix.columns) > 1000
    few = [c for c in matrix.columns if c.startswith("NEW_")][:20]
    learner = md.random_forest(numTrees=5)
    out = {}
    for name in ("a", "b"):
        folder = str(tmp_path / name)
        runs.train_and_write(matrix, learner, folder, k=2, features=few, oof_label=name == "b")
        out[name] = folder
        kept = ["SK_ID_CURR", "TARGET", "OOF_PRED"] if name == "b" else ["SK_ID_CURR", "OOF_PRED"]
        assert read_csv(spark, f"{folder}/oof").columns == kept
        assert read_csv(spark, f"{folder}/importance").count() == 20
    sets = {
        kind: {n: read_csv(spark, f"{f}/{kind}") for n, f in out.items()}
        for kind in ("oof", "submission")
    }
    labels = matrix.filter("TARGET IS NOT NULL")
    cutoffs, auc = runs.blend_and_write(
        labels, sets["oof"], sets["submission"], str(tmp_path / "blend"),
        low_grid=[0.0, 0.05], high_grid=[0.95, 0.99],
    )
    assert 0.5 < auc <= 1 and cutoffs.low_level in (0.0, 0.05)
    blended = read_csv(spark, str(tmp_path / "blend"))
    assert blended.columns == ["SK_ID_CURR", "TARGET"]
    assert blended.count() == matrix.filter("TARGET IS NULL").count()


def test_selected_table_and_search_runs(spark, csv_folder, tmp_path):
    tables = derived.tables(Tables(spark, FOLDER))
    signals = ["EXT_SOURCE_1", "EXT_SOURCE_2", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH"]
    matrix = tables["application"].select("SK_ID_CURR", "TARGET", *signals)
    result = runs.select_and_train(spark, matrix, str(tmp_path), md.random_forest(numTrees=3), k=2)
    selected = spark.read.parquet(str(tmp_path / "selected"))
    assert {"SK_ID_CURR", "TARGET"} < set(selected.columns) and result.oof.count() > 0
    assert read_csv(spark, str(tmp_path / "oof")).count() == result.oof.count()
    found = runs.search_and_write(
        matrix, str(tmp_path / "best"), bounds={"max_depth": (1, 3)}, k=2, init_points=1, n_iter=1, maxIter=2
    )
    assert read_csv(spark, str(tmp_path / "best")).first().max_depth == pytest.approx(found.best["max_depth"])
