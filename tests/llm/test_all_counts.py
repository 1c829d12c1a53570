import numpy as np

from bizfit.llm import language_model


def test_the_rounds_pass_every_count_once():
    """Counts far below a piece's tokens, which a draw could pass over, take part with their weight."""
    counts = np.concatenate([np.random.default_rng(3).integers(1, 200, 5_000), [1, 10**7]])
    codes, unit, passed, rounds = np.arange(len(counts), dtype=np.int32) * 7, 37.5, np.zeros(len(counts)), []
    for number in range(language_model.ROUNDS):
        at, weight = language_model.pieces(codes, counts, unit, number)
        assert (weight <= 1 + 1e-6).all()
        passed += np.bincount(at, weight.astype(np.float64), len(counts))
        rounds.append(weight.sum(dtype=np.float64))
    assert np.allclose(passed * unit, counts, rtol=1e-5)
    assert max(rounds) < 1.05 * min(rounds)
