import itertools

import numpy as np

from tidewake.llm.langid import viterbi


def value(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * np.count_nonzero(np.diff(path))


def test_paths_without_the_best_constant_language_are_found():
    scores = np.array([[2.0, 0, -10], [-10, 0, 2]])
    assert viterbi(scores, 3.0).tolist() == [0, 2]


def test_paths_are_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(400):
        scores, penalty = rng.normal(0, 3, (int(rng.integers(1, 6)), 3)), float(rng.uniform(0.5, 8))
        best = max(value(scores, np.array(p), penalty) for p in itertools.product(range(3), repeat=len(scores)))
        assert np.isclose(value(scores, viterbi(scores, penalty), penalty), best)
