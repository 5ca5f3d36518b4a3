"""Driver contract and oracle agreement on the smallest fixture."""

import pytest

import __spark_entry__ as E
from quillscope.plans.registry import REGISTRY
from tests.conftest import SF001
from tests.oracle_harness import compare, duck


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"feature", "n0", "n1", "mean0", "mean1", "t", "df"}


def test_registry_consistent():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 80


FAST = [
    "basic_features", "extended_features", "outlier_reasons", "pos_histogram", "t_welch", "class_summary",
    "split_stratified", "training_table", "score_all_models", "paired_t", "encode_ids", "stream_verdicts",
    "epoch_loss", "durbin_watson", "spearman",
]


@pytest.mark.parametrize("name", FAST)
def test_oracle_sf0001(spark, name):
    ok, msg = compare(spark, duck(SF001), SF001, name, E.queries()[name], E.oracle_sql()[name])
    assert ok, msg


# builders that run whole trainings / ML fits while building (their plans read small results)
TRAINING = {
    "sentiment", "sentiment_attach", "model_ablation", "train_multitask", "validation_loss",
    "train_shared", "train_shared_weights", "resume_training", "stream_text_verdicts",
    "train_checkpoints", "loss_history", "checkpoint_heads",
}


def test_no_cartesian_product_in_any_plan(spark):
    """Scale check: no query plans a cartesian product or a nested-loop join."""
    bad = {}
    qs = E.queries()
    for name in REGISTRY:
        if name in TRAINING:
            continue
        plan = qs[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def _plan(spark, name):
    return E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["score_linear", "score_all_models", "threshold_predictions", "verdicts", "eval_metrics", "eval_metrics_by_model",
     "compare_matrix", "compare_matrix_labelled", "paired_t", "paired_t_pvalues", "asymmetric_loss", "score_model_glob"],
)
def test_scoring_reads_no_text(spark, name):
    plan = _plan(spark, name)
    assert "documents.parquet" not in plan and "embeddings.parquet" in plan


def test_token_filter_tokenizes_once_above_the_barrier(spark):
    plan = _plan(spark, "token_limit_filter")
    assert plan.count("regexp_extract_all") == 1
    lines = plan.split("\n")
    # the filter on the count stands above the generator that holds the tokenizer's result
    assert next(i for i, x in enumerate(lines) if "token_count" in x and "Filter" in x) < next(i for i, x in enumerate(lines) if "Generate" in x)


def test_python_workers_import_the_shipped_package(spark):
    """Python-side operators run in workers that import the package shipped with addPyFile."""
    from quillscope.session import _SHIPPED

    E.queries()["density_grid"](spark, SF001).count()
    assert spark.sparkContext.applicationId in _SHIPPED
