import random

import pytest

from voxframe.operators import transitions as X
from voxframe.operators.fold import SegmentFold, SegmentOptions


def case(rnd):
    w = 0.032
    hard = rnd.choice([3 * w, 2.5 * w, 5 * w, 9.3 * w, 16 * w, 40.5 * w, 0.7, 1.37, 2.0])
    o = SegmentOptions(
        min_speech_s=rnd.choice([0.05, w, 3 * w, 0.1, 0.3]), soft_limit_s=rnd.choice([None, hard, hard / 2, hard * 0.8]), hard_limit_s=hard,
        min_silence_ms=rnd.choice([0, 32, 64, 100, 200]), look_back_s=rnd.choice([0, w, 0.1, 0.5]))
    runs, at = [], rnd.randint(0, 5)
    for _ in range(rnd.randint(1, 12)):
        for speech in (True, False):
            n = rnd.choice([1, 1, 2, 3, rnd.randint(1, 40)])
            runs.append((at, n, speech))
            at += n
    return o, runs[: len(runs) - rnd.randrange(2)]


def reached(o, first, rnd):
    """A state that some earlier windows lead to."""
    fold, at = SegmentFold(o), first - 200
    while at < first:
        n = min(rnd.choice([1, 2, 5, rnd.randint(1, 30)]), first - at)
        fold.feed(at, n, rnd.random() < 0.55)
        at += n
    return fold


@pytest.mark.parametrize("seed", range(4))
def test_maps_equal_the_fold(seed):
    rnd = random.Random(seed)
    for _ in range(120):
        o, runs = case(rnd)
        one = X.StateMap.unpack(X.stretch_map(o, runs).pack())
        cut = 2 * rnd.randint(0, len(runs) // 2)
        two = X.stretch_map(o, runs[:cut]).then(X.stretch_map(o, runs[cut:]), o) if 0 < cut < len(runs) else one
        for _ in range(5):
            fold = reached(o, runs[0][0], rnd)
            x, shift = X.entering(fold)
            for run in runs:
                fold.feed(*run)
            assert one.apply(x, shift, o) == two.apply(x, shift, o) == X.entering(fold), (o, runs, x)


def test_defaults_settle_soon():
    """Pauses of two seconds make all states one; flags without them keep few pieces."""
    o, rnd = SegmentOptions(), random.Random(1)
    runs, at = [], 0
    for _ in range(200):
        for n, speech in ((rnd.randint(20, 200), True), (rnd.randint(1, 90), False)):
            runs.append((at, n, speech))
            at += n
    assert X.stretch_map(o, runs).is_constant
    steady = [(i * 5, n, n == 3) if n == 3 else (i * 5 + 3, n, False) for i in range(600) for n in (3, 2)]
    assert len(X.stretch_map(o, steady).low) < 2000
