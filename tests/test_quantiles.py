"""Exact quantiles against brute force."""
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from fareloom.operators import stats

PROBS = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.99, "q10": 1.0}


def _check(spark, frame, keys):
    df = spark.createDataFrame(frame).repartition(3)
    got = stats.exact_quantiles(df, keys, "x", PROBS).toPandas()
    groups = frame.dropna(subset=["x"]).groupby(keys, dropna=False)["x"] if keys else [((), frame["x"].dropna())]
    want = {k: np.quantile(x, list(PROBS.values())) for k, x in groups if len(x)}
    assert len(got) == len(want)
    for _, row in got.iterrows():
        key = tuple(row[k] for k in keys)
        assert list(row[list(PROBS)]) == pytest.approx(list(want[key]), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_hot_group_negative_zero_and_tied_values(spark, monkeypatch, limit):
    monkeypatch.setattr(stats, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(7)
    hot = pd.DataFrame({"k": "hot", "x": rng.lognormal(9, 1, 4000).round(2)})
    tied = pd.DataFrame({"k": "tied", "x": rng.choice([5.0, 7.5, 100.0], 301)})
    signed = pd.DataFrame({"k": "signed", "x": np.concatenate([rng.normal(0, 10, 200), [0.0, 0.0, -1e-300, 1e300]])})
    single = pd.DataFrame({"k": ["one", "two", "two"], "x": [3.0, 1.0, 2.0]})
    _check(spark, pd.concat([hot, tied, signed, single]), ["k"])
    _check(spark, pd.concat([hot, tied]), [])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=40))
def test_any_small_table(spark, data):
    _check(spark, pd.DataFrame(data, columns=["k", "x"]), ["k"])


def test_empty_table_has_no_groups(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert stats.exact_quantiles(df, ["k"], "x", {"m": 0.5}).count() == 0
