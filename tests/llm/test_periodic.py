import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.plain import words
from voxframe.llm import periodic
from voxframe.llm.queries import QUERIES


def plain_runs(w, min_length=24, exponent=3):
    """Each period's stretches of equal words at its distance; of equal stretches the smallest period."""
    n, found = len(w), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_length, exponent * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapse(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rng, pieces):
    w = []
    for _ in range(pieces):
        block = [rng.choice("abcdefghijklmnop"[: rng.choice((1, 2, 16))]) for _ in range(rng.randint(1, 40))]
        w += (block * rng.choice((1, 1, 2, 3, 5, 12)))[: rng.randint(1, 400)]
    return w


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=80))
def test_z_function(x):
    z = periodic.z_function(x)
    for i in range(1, len(x)):
        assert z[i] == next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i)


def test_shorter_periods():
    assert periodic.shorter(1) == () and periodic.shorter(7) == (1,) and set(periodic.shorter(60)) == {30, 20, 12}


def rows():
    rng = random.Random(3)
    many = [" ".join(some_words(rng, rng.randint(1, 6))) for _ in range(120)]
    long = [" ".join(some_words(rng, 300)), "la " * 30_000, "tick tock " * 9_000 + "end", " ".join(f"w{i % 7001}" for i in range(30_000))]
    odd = [None, "", " \n\t ", "one", "a\xa0b " * 24, "é\x1cü\n" * 25, "x " * 23, "x " * 24, "a b c " * 8, "x" * 5000]
    texts = many + long + odd
    return [(i, t) for i, t in enumerate(texts)] + [(0, many[0]), (0, many[0]), (None, "z " * 40), (None, "z " * 40), (None, None)]


def test_find_runs(spark):
    clash = "doc_id long, text string, key string, runs string, `row` int, codes string, `open` string, s int, period string"
    docs = spark.createDataFrame([(i, t, "k", "r", 1, "c", "o", 2, "p") for i, t in rows()], clash)
    out = periodic.find_runs(docs)
    assert out.columns == ["doc_id", "key", "row", "codes", "open", "s", "period", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.key, r.period) for r in out.collect()]
    want = []
    for i, t in rows():
        w = words(t)
        # Long texts have their runs by construction; the plain search is quadratic.
        found = plain_runs(w) if len(w) < 6000 else None
        want.append((i, len(w), found, found and plain_collapse(w, found), "k", "p"))
    assert len(got) == len(want)
    by = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        if b[2] is None:
            assert a[:2] == b[:2] and all(length >= max(24, 3 * p) for _, length, p in a[2])
        else:
            assert a == (b if b[2] else (*b[:3], " ".join(words(dict(rows())[b[0]] if b[0] is not None else "")), *b[4:]))
    long = {r[0]: r for r in got}
    assert long[121][2] == [(0, 30_000, 1)] and long[121][3] == "la"
    assert long[122][2] == [(0, 18_000, 2)] and long[122][3] == "tick tock end"
    assert long[123][2] == [(0, 30_000, 7001)] and long[123][1] == 30_000
    assert periodic.find_runs(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, min_exponent=2)


@pytest.mark.parametrize("min_length", [3, 10, 60])
def test_other_lengths(spark, min_length):
    some = [(i, t) for i, t in rows() if i is not None and i < 60]
    out = periodic.find_runs(spark.createDataFrame(some, "doc_id long, text string"), min_length=min_length, min_exponent=4).collect()
    texts = dict(some)
    for r in out:
        w = words(texts[r.doc_id])
        assert [tuple(x) for x in r.runs] == [x for x in plain_runs(w, min_length, 3) if x[1] >= 4 * x[2]]


def test_tiles_travel_alone(spark):
    """Texts without repeats send no tiles, and a long run is many pieces of few words."""
    import numpy as np

    codes = np.arange(5000)
    for low, end in periodic.octaves(5000, 16):
        assert len(periodic.repeating(codes, np.array([0]), np.array([5000]), low, end)[0]) == 0
    text, at = periodic.repeating(codes % 100, np.array([0]), np.array([5000]), 64, 128)
    assert at.tolist() == list(range(0, 4900, 128))


def test_query(spark, tmp_path):
    rng = random.Random(9)
    some = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 500)))) for i in range(300)] + [(None, "q"), (300, None), (301, "")]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert len(got) == len(some)
    for i, t in some:
        w, h = words(t), zlib.crc32(b"" if i is None else str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        assert got[i] == (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest(),
            hashlib.sha256(plain_collapse(w, runs).encode()).hexdigest())
