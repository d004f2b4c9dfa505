"""Parameters of the model catalogue reach Spark's learners; unknown ones are refused."""

import pytest

from millrace.operators import models


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting", "xgboost"])
@pytest.mark.parametrize("task", ["classification", "regression"])
def test_tree_parameters(spark, name, task):
    given = {"min_samples_leaf": 7, "max_features": "sqrt", "min_samples_split": 2, **({"subsample": 0.5} if name != "random_forest" else {})}
    e = models.estimator(name, task, 100, 2, 3, given)
    assert e.getMinInstancesPerNode() == 7 and e.getFeatureSubsetStrategy() == "sqrt"
    assert name == "random_forest" or e.getSubsamplingRate() == 0.5
    plain = models.estimator(name, task, 100, 2, 3, {})
    assert plain.getMinInstancesPerNode() == 1 and plain.getFeatureSubsetStrategy() == ("auto" if name == "random_forest" else "all")
    for f, want in ((None, "all"), (0.3, "0.3"), (2, "2"), (1.0, "all")):
        assert models.estimator(name, task, 100, 2, 3, {"max_features": f}).getFeatureSubsetStrategy() == want


def test_refusals(spark):
    for name, params in (("random_forest", {"subsample": 0.5}), ("ridge", {"alhpa": 1.0}), ("random_forest", {"min_samples_split": 5}), ("naive_bayes", {"C": 1}),
                         ("random_forest", {"min_samples_leaf": 0.1}), ("random_forest", {"max_features": "most"}), ("no_such_model", {})):
        with pytest.raises(ValueError):
            models.estimator(name, "classification", 100, 2, 3, params)
    assert models.estimator("logistic_regression", "classification", 100, 2, 3, {"solver": "lbfgs", "C": 0.5}).getRegParam() == 0.02


def test_leaf_size_changes_a_fit(spark):
    df = spark.range(60).selectExpr("cast(id as double) x", "cast(id % 2 as int) y")
    small, large = (models.fit(df, "random_forest", ["x"], "y", params={"n_estimators": 3, "max_depth": 8, "min_samples_leaf": n, "max_features": None}) for n in (1, 25))
    nodes = lambda f: f.model.stages[-1].totalNumNodes
    assert nodes(large) < nodes(small)
