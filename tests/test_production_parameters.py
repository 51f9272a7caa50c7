"""Registered queries run their operators with the production parameters."""

import os

import pytest

from sigwarden.operators import agreement, causal, fairness, models, reliability
from sigwarden.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


class Called(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "module", "operator", "want"),
    [
        ("model_leaderboard", models, "train_baselines", {"trees": 200, "depth": 12}),
        ("weight_sensitivity", fairness, "sensitivity_table", {"magnitudes": (0.05, 0.1, 0.2, 0.4), "draws": 50}),
        ("learned_weights", fairness, "learn_weights", {"candidates": 400, "rounds": 6, "holdout": 0.3}),
        ("fairness_bootstrap", fairness, "fairness_audit", {"replicates": 100}),
        ("auroc_bootstrap", agreement, "auroc_interval", {"replicates": 200}),
        ("test_retest_bootstrap", reliability, "cohort_test_retest", {"replicates": 200}),
        ("aipw_effect", causal, "aipw", {"replicates": 200}),
    ],
)
def test_production_parameters(spark, monkeypatch, name, module, operator, want):
    import inspect

    shape = inspect.signature(getattr(module, operator))

    def record(*args, **options):
        held = shape.bind(*args, **options)
        held.apply_defaults()
        raise Called(held.arguments)

    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Called) as e:
        queries.queries()[name](spark, SF)
    assert {k: e.value.args[0][k] for k in want} == want


def test_learned_weights_rows(spark):
    rows = queries.queries()["learned_weights"](spark, SF).collect()
    assert len(rows) == 6 and abs(sum(r.weight for r in rows) - 1) < 1e-5 and rows[0].evaluations >= 400
