import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from voxframe.functions import text as X

FILLER = "Item 7: the harbour office opens at nine, closes at noon, and charges 3 crowns per crate; keep receipt no. 48 dry."
PH = X.CLIP_PLACEHOLDER


def column(spark, rows, expr, schema="t string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def clip(spark, texts, **kw):
    return [(r.text, r.patterns) for r in column(spark, [(t,) for t in texts], X.clip_repetitions(F.col("t"), **kw))]


def test_clip_goldens(spark):
    prefix = "Second notice, row 12: 64 barrels of tar, 9 coils of rope, unloaded on the east quay at dawn"
    cases = [
        ("", "", []), ("short", "short", []), ("a" * 99, "a" * 99, []), (FILLER, FILLER, []),
        (FILLER + " " + "ab" * 15, FILLER + " ab" + PH, ["ab"]),
        (FILLER + " " + "ab" * 15 + " crates counted twice",
         FILLER + " ab" + PH + " crates counted twice", ["ab"]),
        (FILLER + " " + "quay!" * 12 + " tide turns",
         FILLER + " quay!" + PH + " tide turns", ["quay!"]),
        ("ab" * 60, "ab" + PH, ["ab"]),
        (FILLER + " " + "ab" * 9 + " end", FILLER + " " + "ab" * 9 + " end", []),
        (prefix + " " + "morva " * 30, prefix + " morva" + PH, [" morva"]),
        ("好" * 120, "好好" + PH, ["好好"]),
        ("morva " * 30, "morva " + PH, ["morva "]),
        ("morva " * 30 + "tide turns", "morva " + PH + "tide turns", ["morva "]),
    ]
    got = clip(spark, [c[0] for c in cases])
    assert got == [(c[1], c[2]) for c in cases]
    assert clip(spark, ["ab" * 60], min_repeats=5) == [("ab" + PH, ["ab"])]
    with pytest.raises(ValueError, match="min_repeats must be at least 2"):
        X.clip_repetitions(F.col("t"), min_repeats=1)


def brute_clip(t, r, most):
    """Every start of every period, checked directly."""
    if len(t) < 100:
        return t, []
    for p in range(2, most + 1):
        for start in range(0, len(t) - p * r + 1):
            if t[start:start + p * r] == t[start:start + p] * r:
                end = start + p * r
                while end < len(t) and t[end] == t[end - p]:
                    end += 1
                return t[:start + p] + PH + t[end:], [t[start:start + p]]
    return t, []


def test_clip_matches_brute_force(spark):
    rnd = random.Random(5)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            unit = "".join(rnd.choice("ab 好😀\n") for _ in range(rnd.randint(1, 8)))
            parts.append("".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 60))))
            parts.append(unit * rnd.randint(1, 14) + unit[: rnd.randint(0, len(unit))])
        texts.append("".join(parts))
    texts.append("xy" * 40000 + "!" + FILLER)
    for r, most in ((10, 30), (4, 6), (2, 3)):
        assert clip(spark, texts, min_repeats=r, max_pattern_len=most) == [brute_clip(t, r, most) for t in texts]


def test_repetitive(spark):
    cases = [("", False), ("a a a a", True), ("a a a", False), ("a b c d", False), ("A a a　A", True),
             ("好好好好", True), ("好好好", False), ("你好吗我们走", False), (None, False), ("好 x 好 好 好", True)]
    got = column(spark, [(c[0],) for c in cases], X.is_repetitive(F.col("t")))
    assert got == [c[1] for c in cases]


def test_near_duplicate(spark):
    rnd = random.Random(3)
    pairs = [("", "a"), ("a", ""), (" ", "a"), ("Hello ", "hello"), (None, "x"), ("x", None), (" x", "X")]
    for _ in range(300):
        a = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 260)))
        b = "".join(c if rnd.random() > 0.06 else rnd.choice("xyz") for c in a)
        pairs.append((a, b))

    def direct(cur, prior):
        a, b = (cur or "").strip().lower(), (prior or "").strip().lower()
        return bool(a and b) and (a == b or SequenceMatcher(None, a, b).ratio() >= 0.9)

    got = column(spark, pairs, X.is_near_duplicate(F.col("a"), F.col("b")), "a string, b string")
    want = [direct(a, b) for a, b in pairs]
    assert got == want and any(want) and not all(want)
    equal_only = column(spark, pairs, X.is_near_duplicate(F.col("a"), F.col("b"), 1.0), "a string, b string")
    assert equal_only == [direct(a, b) and a.strip().lower() == b.strip().lower() if a and b else False for a, b in pairs]


def test_conditioning_context(spark):
    pairs = [("  new text ", "old", "new text"), ("", "x", ""), ("go go go go", "x", ""),
             ("Same line", "same line ", ""), (None, "x", "")]
    got = column(spark, [p[:2] for p in pairs], X.conditioning_context(F.col("a"), F.col("b")), "a string, b string")
    assert got == [p[2] for p in pairs]


def test_script_and_cjk_spaces(spark):
    assert column(spark, [("简体中文",)], X.convert_script(F.col("t"), "简体", "簡體", "traditional")) == ["簡體中文"]
    assert column(spark, [("简体中文",)], X.convert_script(F.col("t"), "简体", "簡體")) == ["简体中文"]
    got = column(spark, [("你 好　 吗 a 你", ), ("a b",)], X.strip_cjk_spaces(F.col("t")))
    import re
    wide = X.CJK_WIDE_CLASS
    want = [re.sub(f"(?<={wide})\\s+(?={wide})", "", t) for t in ("你 好　 吗 a 你", "a b")]
    assert got == want
    by_language = column(spark, [("你 好", "zh"), ("你 好", "en"), ("你 好", None)],
                         X.strip_cjk_spaces(F.col("t"), F.col("l")), "t string, l string")
    assert by_language == ["你好", "你 好", "你 好"]


def test_character_bound_loses_no_near_duplicate(spark):
    import random
    from difflib import SequenceMatcher

    from pyspark.sql import functions as F

    from voxframe.functions import text as T

    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        a = "".join(rnd.choice("abcdé 😀") for _ in range(rnd.randint(0, 40)))
        b = "".join(c if rnd.random() < 0.93 else rnd.choice("xyz") for c in a) if rnd.random() < 0.7 else a[::-1]
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", T.shared_characters(F.col("a"), F.col("b")).alias("n"), T.may_be_near_duplicate(F.col("a"), F.col("b")).alias("may")).collect()
    for r in got:
        quick = SequenceMatcher(None, r.a, r.b).quick_ratio()
        assert 2 * r.n == round(quick * (len(r.a) + len(r.b))) or not (r.a and r.b)
        if r.a and r.b:
            assert r.may == (quick >= T.NEAR_DUPLICATE_RATIO or r.a == r.b)


def test_trigrams_never_lose_a_match():
    """The bound holds for whatever the matching-block ratio accepts, and keeps unlike prose from that search."""
    rnd = random.Random(4)
    hits = 0
    for _ in range(1500):
        a = "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 60)))
        b = "".join(rnd.choice("ab c") if rnd.random() < 0.08 else c for c in a if rnd.random() > 0.05)
        for threshold in (0.8, 0.9, 0.95):
            if b and SequenceMatcher(None, a, b).ratio() >= threshold:
                hits += 1
                assert X.shares_trigrams(a, b, threshold)
    assert hits > 500
    prose = "the quick brown fox jumps over the lazy dog and the cat"
    assert not X.shares_trigrams(prose, "".join(sorted(prose)), 0.9)
