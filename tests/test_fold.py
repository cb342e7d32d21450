"""Segmentation goldens: lengths and starts in windows."""

import random

import pytest

from voxframe.operators.fold import SegmentFold, SegmentOptions

W = 0.032
# flags, min, soft, hard, silence ms, look-back, finish, lengths, starts
GOLDENS = [
    (".S...", 0.1, 10, None, 0, None, False, [5], [0]),
    ("SS.", 0.064, 10, None, 0, None, False, [3], [0]),
    ("SS..", 0.05, 10, None, 64, None, False, [4], [0]),
    ("SS..S....", 0.05, 10, None, 100, None, False, [9], [0]),
    ("SS.S....", 0.05, 10, None, 100, None, False, [8], [0]),
    ("SS.", 0.05, 10, None, 200, None, True, [3], [0]),
    ("S..S..S..S....", 0.05, 10, None, 100, None, False, [14], [0]),
    ("SSS.S", W, 10 * W, None, 200, None, True, [5], [0]),
    ("SSSSS.", W, 3 * W, None, 2000, None, False, [6], [0]),
    ("SSS...S....", W, 20 * W, None, 128, None, False, [11], [0]),
    ("SSS.", W, 10 * W, None, 0, None, False, [4], [0]),
    ("SSSSS.", W, 3 * W, None, 0, None, False, [6], [0]),
    (".SS...SS.", 0.05, 10, None, 0, None, False, [4, 5], [0, 4]),
    ("SS", 0.05, 10, None, None, None, True, [2], [0]),
    ("S.SS.", 2 * W, 2.5 * W, None, 100, None, False, [5], [0]),
    ("SS...SS.", W, 10 * W, None, 0, W, False, [3, 4], [0, 4]),
    ("SS..SS", W, 10 * W, None, 0, None, True, [3, 3], [0, 3]),
    ("SS.SS", W, 1.5 * W, None, 0, None, True, [3, 2], [0, 3]),
    ("SS." + "." * 6 + "SS", W, 3 * W, None, 0, None, True, [3, 8], [0, 3]),
    ("SS." + "." * 20 + "SS", W, 3 * W, None, 0, None, True, [3, 17], [0, 8]),
    ("S" * 8, W, 5 * W, 5 * W, 2000, None, True, [5, 3], [0, 5]),
    ("S" * 7, W, 3 * W, 3 * W, 2000, None, True, [3, 3, 1], [0, 3, 6]),
    ("S" * 7, W, 3 * W, 3 * W, 2000, 0, True, [3, 3, 1], [0, 3, 6]),
    ("SSSSS.", W, 3 * W, 3 * W, 0, None, False, [3, 3], [0, 3]),
    ("SSS..", W, 5 * W, 5 * W, 96, None, False, [5], [0]),
    ("SSS.S", W, None, 6 * W, 96, None, True, [5], [0]),
    ("S" * 7, W, None, 3 * W, 2000, None, True, [3, 3, 1], [0, 3, 6]),
    ("S" * 6, W, 2.5 * W, 2.5 * W, 2000, None, True, [2.5, 2.5, 1], [0, 2.5, 5]),
]


def options(mn, soft, hard, sil, back, **kw):
    o = dict(min_speech_s=mn, soft_limit_s=soft)
    if hard is not None:
        o["hard_limit_s"] = hard
    if sil is not None:
        o["min_silence_ms"] = sil
    if back is not None:
        o["look_back_s"] = back
    return SegmentOptions(**o, **kw)


def runs(flags):
    i = 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j] == flags[i]:
            j += 1
        yield i, j - i, flags[i] == "S"
        i = j


def fold(flags, o, finish=True, cuts=()):
    """Feed by runs; at each cut position hand the state to a fresh fold."""
    out, state, edges = [], None, [0, *cuts, len(flags)]
    for a, b in zip(edges, edges[1:]):
        f = SegmentFold(o, state)
        for first, n, s in runs(flags[a:b]):
            f.feed(a + first, n, s)
        state = f.state()
        out += f.out
    f = SegmentFold(o, state)
    if finish:
        f.finish()
    return out + f.out


@pytest.mark.parametrize("case", GOLDENS, ids=lambda c: c[0][:12])
def test_goldens(case):
    flags, *opts, finish, lengths, starts = case
    segs = fold(flags, options(*opts), finish)
    assert [s[1] / 512 for s in segs] == lengths
    assert [s[0] / 512 for s in segs] == starts


def test_reset_drops_open_segment():
    assert fold("S", options(0.05, 10, None, None, None, discard_open=True)) == []


def test_soft_above_hard_raises():
    with pytest.raises(ValueError):
        SegmentOptions(soft_limit_s=61, hard_limit_s=60)


def random_case(rnd):
    flags = ""
    while len(flags) < 400:
        flags += rnd.choice("S.") * rnd.choice([1, 1, 2, 3, 8, 40])
    hard = rnd.choice([2.5, 4, 7.25, 9.5, 20, 60]) * W
    soft = rnd.choice([None, hard, hard * 0.5, hard * 0.2])
    return flags, SegmentOptions(
        min_speech_s=rnd.choice([0.0, W, 2 * W, 0.1, 5 * W]), soft_limit_s=soft, hard_limit_s=hard,
        min_silence_ms=rnd.choice([0, 32, 40, 100, 200]), look_back_s=rnd.choice([-1, 0, W, 3 * W, 0.2]),
    )


def by_sample(flags, o):
    """Independent check: walk single windows and hold actual sample numbers in lists."""
    w, sr = o.window, o.rate
    cap, segs, talk, quiet, back, quiet_ms, active = o.hard_samples, [], [], [], [], 0.0, False
    for i, c in enumerate(flags):
        chunk, voice = list(range(i * w, i * w + w)), c == "S"
        sec = (len(talk) + len(quiet)) / sr
        if not active and not voice:
            back = (back + [chunk])[-o.back_windows:] if o.back_windows else []
            continue
        if not active:
            talk, back, active = [x for b in back for x in b], [], True
        limit = o.min_silence_ms
        if o.soft_limit_s is not None and o.soft_limit_s < o.hard_limit_s and sec > o.soft_limit_s and limit > 0:
            limit = 32
        if voice or sec < o.min_speech_s:
            talk, quiet, quiet_ms = talk + quiet, [], 0.0
            while chunk:
                room = max(0, cap - len(talk))
                talk, chunk = talk + chunk[:room], chunk[room:]
                if len(talk) >= cap:
                    segs.append(talk)
                    talk, active = [], bool(chunk)
        else:
            room = max(0, cap - len(talk) - len(quiet))
            quiet, rest = quiet + chunk[:room], chunk[room:]
            quiet_ms += (w - len(rest)) / sr * 1000
            if len(talk) + len(quiet) >= cap or quiet_ms >= limit:
                segs.append(talk + quiet)
                talk, quiet, quiet_ms, active = [], [], 0.0, False
                back = [rest] if rest and o.back_windows else []
    if talk or quiet:
        segs.append(talk + quiet)
    assert all(s == list(range(s[0], s[-1] + 1)) for s in segs)
    return [(s[0], len(s)) for s in segs]


def test_random_against_sample_walk_and_split_state():
    rnd = random.Random(11)
    for _ in range(60):
        flags, o = random_case(rnd)
        whole = fold(flags, o)
        assert [s[:2] for s in whole] == by_sample(flags, o)
        cuts = sorted(rnd.sample(range(1, len(flags)), 5))
        assert fold(flags, o, cuts=cuts) == whole
        assert all(s[1] <= o.hard_samples or o.back_windows * 512 >= o.hard_samples for s in whole)


def test_quiet_run_makes_entry_state_irrelevant():
    rnd = random.Random(4)
    for _ in range(200):
        _, o = random_case(rnd)
        q = o.quiet_windows
        if q is None:
            continue
        head = "".join(rnd.choice("SS.") for _ in range(rnd.randint(0, 40)))
        f = SegmentFold(o)
        for first, n, s in runs(head + "." * q):
            f.feed(first, n, s)
        g = SegmentFold(o)
        g.idle_with_look_back(q)
        assert f.state() == g.state()
