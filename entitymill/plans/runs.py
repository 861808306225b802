"""Whole runs from CSV files to CSV results: features, training, blending."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitymill.functions.scalar import blend_of, named
from entitymill.operators.aggregate import importance_totals
from entitymill.operators.attach import join_predictions, top_features
from entitymill.operators.blend import Cutoffs, blend, cut_by, find_cutoffs
from entitymill.operators.metrics import roc_auc_value
from entitymill.operators.models import KFoldResult, Learner, kfold, random_forest
from entitymill.operators.search import SearchResult, search
from entitymill.operators.select import select_features
from entitymill.plans.histories import APPLICANT
from entitymill.plans.matrix import feature_matrix
from entitymill.sources.staging import file_facts
from entitymill.sources.tables import (
    FILE_ORDER,
    head_rows,
    read_csv,
    read_parquet,
    write_csv,
    write_oof,
    write_params,
    write_submission,
)

LABEL = "TARGET"
# Table name -> file name of the published data set.
FILES = {
    "application": "application_train.csv",
    "application_test": "application_test.csv",
    "bureau": "bureau.csv",
    "bureau_balance": "bureau_balance.csv",
    "previous_application": "previous_application.csv",
    "pos_cash": "POS_CASH_balance.csv",
    "instalments": "installments_payments.csv",
    "credit_card": "credit_card_balance.csv",
}


def load_tables(
    spark: SparkSession,
    folder: str,
    num_rows: int | None = None,
    schemas: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All input tables; ``num_rows`` keeps the first rows of each file.

    Types are found by a pass over each file unless ``schemas`` declares them.
    Every table has the order of its file as a column.
    """
    tables = {}
    for name, file in FILES.items():
        df = read_csv(spark, f"{folder}/{file}", (schemas or {}).get(name), file_order=True)
        tables[name] = head_rows(df, [FILE_ORDER], num_rows)
    return tables


def build_matrix(
    spark: SparkSession,
    folder: str,
    stage_folder: str,
    num_rows: int | None = None,
    reuse: bool = False,
    **options,
) -> DataFrame:
    """The feature matrix of a folder of CSV files, with staged table features.

    With ``reuse`` table features are read again if they were written from the same
    files (name, size, time of change), number of rows, orders and options.
    """
    tables = load_tables(spark, folder, num_rows)
    orders = {name: (FILE_ORDER,) for name in tables}
    made_from = None
    if reuse:
        files = {name: file_facts(spark, f"{folder}/{file}") for name, file in FILES.items()}
        made_from = {"files": files, "num_rows": num_rows}
    return feature_matrix(tables, orders, stage_folder=stage_folder, made_from=made_from, **options)


def train_and_write(
    matrix: DataFrame,
    learner: Learner,
    folder: str,
    k: int = 10,
    stratified: bool = True,
    debug: bool = False,
    oof_label: bool = False,
    **options,
) -> KFoldResult:
    """K-fold training; unless ``debug`` writes predictions and importances.

    Writes ``submission``, ``oof`` (with the label if ``oof_label``, as the dense
    net's run does), ``importance`` (sums over the folds) and ``top_importance``
    (the fold rows of the 40 best features).
    """
    result = kfold(matrix, learner, APPLICANT, LABEL, k, stratified, **options)
    if not debug:
        write_submission(result.test, f"{folder}/submission", APPLICANT, LABEL)
        oof = result.oof.withColumnRenamed("label", LABEL)
        write_oof(oof, f"{folder}/oof", APPLICANT, LABEL if oof_label else None)
        if result.importances is not None:
            write_csv(importance_totals(result.importances), f"{folder}/importance")
            write_csv(top_features(result.importances), f"{folder}/top_importance")
    return result


def select_and_train(
    spark: SparkSession,
    matrix: DataFrame,
    folder: str,
    learner: Learner | None = None,
    k: int = 5,
    **options,
) -> KFoldResult:
    """The run on selected features: selection, the selected table written and scanned
    again, and a forest on it (or another learner)."""
    selected = select_features(matrix, keep=(APPLICANT, LABEL))
    path = f"{folder}/selected"
    selected.write.mode("overwrite").parquet(path)
    table = read_parquet(spark, path)
    return train_and_write(table, learner or random_forest(), folder, k, **options)


def search_and_write(matrix: DataFrame, path: str, **options) -> SearchResult:
    """The search run: its best parameters end in a file of one row."""
    found = search(matrix, APPLICANT, LABEL, **options)
    write_params(matrix.sparkSession, found.best, path)
    return found


def blend_and_write(
    labels: DataFrame,
    oof: Mapping[str, DataFrame],
    submissions: Mapping[str, DataFrame],
    path: str,
    weights: Sequence[float] = (0.5, 0.5),
    mode: str = "level_as_value",
    low_grid: Sequence[float] | None = None,
    high_grid: Sequence[float] | None = None,
    ids: DataFrame | None = None,
) -> tuple[Cutoffs, float | None]:
    """Blend models, find the best cuts on OOF predictions, write the blend.

    ``ids`` lists the rows of the result, as the sample submission does; without it
    every id of any submission is there. Returns the cuts and the AUC of the uncut blend.
    """
    base = labels.select(named(APPLICANT), named(LABEL))
    train = join_predictions(base, oof, APPLICANT)
    train = train.select(LABEL, blend_of(list(oof), weights).alias("score"))
    cutoffs = find_cutoffs(train, LABEL, "score", mode, low_grid, high_grid)
    blended = blend(submissions, weights, APPLICANT, LABEL, ids)
    out = cut_by(blended, LABEL, cutoffs, mode)
    write_csv(out.select(named(APPLICANT), F.col(LABEL)), path)
    return cutoffs, roc_auc_value(train, LABEL, "score")
