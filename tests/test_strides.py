"""Fits of hidden states on runs of equal readings: the sums of every reading, and the whole search."""

import numpy as np
import pytest

from diurna import params, queries
from diurna.operators import hmm


@pytest.mark.parametrize("emission", ["zip", "gaussian", "categorical"])
@pytest.mark.parametrize("constraint", ["soft", "hard", "none"])
def test_strides_have_the_sums_of_their_readings(emission, constraint):
    rng, settings = np.random.default_rng(5), params.Hmm(emission=emission, constraint=constraint)
    seqs = [(rng.random(n) < 0.1) * rng.poisson(2, n).astype(float) for n in (1, 2, 0, 5, 40, 300, 3)]
    seqs += [np.zeros(2000), np.ones(9), np.zeros(1), np.array([2.0]), np.array([0.0, 0.0, 3.0]), rng.random(30)[:0] if emission == "zip" else rng.random(30)]
    weights = [1 + i % 3 for i in range(len(seqs))]
    models = [hmm.start_of(np.array([0.5, 1.0, 2.0, 5.0]), 1.0, settings, i) for i in range(hmm.BESIDE + 2)]
    wanted = [sum(w * hmm.sums_of(s, m, settings) for s, w in zip(seqs, weights) if len(s)) for m in models]
    for steps in (1, 1 << 14):
        got = sum(pack.sums(models, settings) for pack in packs_of(seqs, weights, steps))
        assert np.allclose(got, wanted, rtol=1e-9, atol=1e-9)


def packs_of(seqs, weights, steps):
    before, hmm.STEPS = hmm.STEPS, steps
    try:
        return list(hmm.strides(seqs, weights))
    finally:
        hmm.STEPS = before


def test_equal_sequences_weigh_as_often_as_they_stand(spark):
    seen = spark.createDataFrame([(i, t, float(t % (3 + i % 2))) for i in range(6) for t in range(40)], "id int, t int, x double")
    who = spark.createDataFrame([(i, "a") for i in range(6)], "id int, grp string")
    settings = params.Hmm(n_states=2, n_restarts=2, n_iter=5)
    found = hmm.train(seen, who, settings).collect()[0]
    series = [np.array([t % (3 + i % 2) for t in range(40)], float) for i in range(6)]
    wanted = max((hmm.fit(series, settings, n) for n in range(2)), key=lambda f: f["ll"])
    assert abs(found["ll"] - wanted["ll"]) < 1e-6 and np.allclose(found["trans"], wanted["trans"])
    assert hmm.packed(hmm.sequences(seen, who), 240).count() == 1


def test_hidden_states_searches_with_the_default_settings(spark, monkeypatch):
    class Seen(Exception):
        pass

    def train(seen, groups, settings):
        raise Seen(settings)

    monkeypatch.setattr(hmm, "train", train)
    with pytest.raises(Seen) as found:
        queries.hidden_states(spark, "/root/testdata/sf0.001")
    assert found.value.args[0] == params.Hmm()
