"""The registered queries resample as often as the reference."""

import inspect

import pytest

from trackloom.operators import cube, resampling
from trackloom.plans import kernels, summaries

WANTED = [
    (summaries.f_fbm_bootstrap, resampling, "bootstrap_fbm", "iterations", 300), (summaries.f_tau_bootstrap, cube, "tau_bootstrap", "iterations", 200),
    (summaries.f_window_means, resampling, "bootstrap_window_means", "iterations", 500), (summaries.f_bootstrap_exponents, resampling, "cluster_bootstrap", "iterations", 500),
    (kernels.k_persistence_null, resampling, "shuffled_persistence", "shuffles", 100),
]


@pytest.mark.parametrize("query, module, name, argument, count", WANTED)
def test_replicates_of_the_reference(spark, data, monkeypatch, query, module, name, argument, count):
    of = inspect.signature(getattr(module, name))
    used = []

    def note(*a, **k):
        bound = of.bind(*a, **k)
        bound.apply_defaults()
        used.append(bound.arguments[argument])

    monkeypatch.setattr(module, name, note)
    query(spark, data)
    assert used == [count]
