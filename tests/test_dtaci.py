import math
import random

from tideline.operators import steps


def test_loss_is_of_the_level_at_each_feedback():
    rng = random.Random(4)
    errs = [rng.random() < (0.02 if i < 250 else 0.3) for i in range(400)]
    s = steps.DtAci()
    state = s.initial
    for e in errs:
        state, (got,) = s(state, e)
    levels = {}
    for g in s.gammas:
        a, levels[g] = 0.05, []
        for e in errs:
            a = min(0.5, max(0.001, a + g * (e - 0.05)))
            levels[g].append(a)
    loss = {g: sum(abs(a - e) for a, e in list(zip(x, errs))[-200:]) / 200 for g, x in levels.items()}
    w = {g: math.exp(-2 * v) for g, v in loss.items()}
    assert math.isclose(got, sum(w[g] * levels[g][-1] for g in w) / sum(w.values()), abs_tol=1e-12)
    assert s(s.initial, None)[1] == (0.05,)
