import itertools

import numpy as np

from tessera.llm.tagger import Tagger


def setup(seed=0, steps=5, n=3, k=3):
    rng = np.random.default_rng(seed)
    m = Tagger(6, k, 4, seed)
    m.p = {name: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for name, v in m.p.items()}
    x, y = rng.integers(0, 6, (steps, n)), rng.integers(0, k, (steps, n))
    mask = np.arange(steps)[:, None] < np.array([steps, steps - 2, 1])[None, :n]
    return m, x, y, mask


def score(m, e, tags):
    return m.p["s"][tags[0]] + sum(e[i, t] for i, t in enumerate(tags)) + sum(m.p["t"][a, b] for a, b in zip(tags, tags[1:]))


def test_likelihood_and_viterbi_against_all_paths():
    m, x, y, mask = setup()
    e = m.emissions(x).astype(float)
    total, best = 0.0, np.zeros(x.shape, int)
    for w in range(x.shape[1]):
        length = int(mask[:, w].sum())
        paths = {p: score(m, e[:, w], p) for p in itertools.product(range(m.tags), repeat=length)}
        total += np.log(sum(np.exp(v) for v in paths.values())) - paths[tuple(y[:length, w])]
        best[:length, w] = max(paths, key=paths.get)
    assert abs(m.loss(x, y, mask)[0] - total / x.shape[1]) < 1e-3
    assert (m.decode(x, mask) == best).all()


def test_gradients_against_differences():
    m, x, y, mask = setup(1)
    _, grad = m.loss(x, y, mask)
    rng = np.random.default_rng(0)
    for name, value in m.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            kept = value[at]
            value[at] = kept + 1e-2
            up = m.loss(x, y, mask)[0]
            value[at] = kept - 1e-2
            down = m.loss(x, y, mask)[0]
            value[at] = kept
            assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-2, name


def test_the_bound_skips_nothing():
    for seed in range(20):
        m, x, y, mask = setup(seed, 6, 3)
        m.p["c"] = m.p["c"] + np.array([2.0, 0, 0])
        e = m.emissions(x)
        full = m._viterbi(e, mask, m.p["t"], m.p["s"]) * mask
        assert (m.decode(x, mask) == full).all()
