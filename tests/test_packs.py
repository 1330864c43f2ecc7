"""Sequences side by side give what each gives alone."""

import numpy as np

from diurna import params
from diurna.operators import hmm


def test_a_pack_is_its_sequences():
    rng, settings = np.random.default_rng(1), params.Hmm(n_states=3)
    seqs = [rng.poisson(rng.choice([0.2, 3.0, 9.0], n)).astype(float) for n in (1, 40, 7, 40, 0, 113)]
    start, a, p = hmm.start_of(np.array([0.5, 3.0, 8.0]), 1.0, settings, 0)
    model, whole = (start, a, p), [s for s in seqs if len(s)]
    assert np.allclose(hmm.sums_of_many(seqs, model, settings), sum(hmm.sums_of(s, model, settings) for s in whole), rtol=1e-9)
    seen = set()
    for places, pack in hmm.packs(seqs):
        g, path = hmm.posteriors(pack, model, settings)[0], hmm.paths(pack, model, settings)
        for i, j in enumerate(pack.order):
            seq = seqs[places[j]]
            b = hmm.log_emission(seq, p, settings.emission)
            assert np.allclose(g[: len(seq), i], hmm.forward_backward(b, start, a)[0])
            assert (path[: len(seq), i] == hmm.viterbi(b, start, a)).all()
            seen.add(places[j])
    assert seen == {0, 1, 2, 3, 5}


def test_models_do_not_ride_on_every_reading(spark):
    seen = spark.createDataFrame([(i, t, float(t % 3 * i)) for i in (1, 2) for t in range(50)], "id int, t int, x double")
    who = spark.createDataFrame([(1, "a"), (2, "b")], "id int, grp string")
    settings = params.Hmm(n_states=2, n_restarts=1, n_iter=2)
    found = hmm.decode(seen, who, hmm.train(seen, who, settings), settings)
    assert found.count() == 100 and "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
