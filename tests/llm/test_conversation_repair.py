import hashlib
import itertools
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import conversation_repair as repair
from voxframe.llm.queries import QUERIES

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def by_states(turns, begin, ends):
    """Least (cost, audit) by a walk over the states of the grammar."""
    far = (10**9, "~")

    def with_inserts(c):
        for _ in range(4):
            for (s, (k, a)), x in itertools.product(list(c.items()), "ua"):
                if (s, x) in NEXT:
                    c[NEXT[s, x]] = min(c.get(NEXT[s, x], far), (k + 5, a + "I"))
        return c

    now = with_inserts({begin: (0, "")})
    for t in turns:
        then = {}
        for s, (k, a) in now.items():
            steps = [(s, k + 2, "D")]
            if t != "x":
                late = 5 * t.isupper()
                steps += [(NEXT[s, t.lower()], k + late, "K")] if (s, t.lower()) in NEXT else []
                steps += [(NEXT[s, x], k + late + 1, "R") for x in "ua" if (s, x) in NEXT]
            for to, cost, op in steps:
                then[to] = min(then.get(to, far), (cost, a + op))
        now = with_inserts(then)
    return min((now[e] for e in ends if e in now), default=None)


@settings(max_examples=300, deadline=None)
@given(st.text("sssuuuuaaaaoxxSUAO", max_size=12), st.integers(0, 3), st.integers(0, 3))
def test_pieces(turns, begin, end):
    assert repair.best(turns, begin, end) == by_states(turns, begin, [end])


@settings(max_examples=60, deadline=None)
@given(st.text("suax", max_size=7), st.text("sua", max_size=6))
def test_align(turns, want):
    """Against all edit strings."""
    def cost(audit):
        i = j = total = 0
        for op in audit:
            if op in "KRD" and i == len(turns) or op in "KRI" and j == len(want):
                return None
            if op == "K" and turns[i] != want[j] or op == "R" and (turns[i] == "x" or want[j] == "s") or op == "I" and want[j] == "s":
                return None
            total += {"K": 0, "R": 1, "D": 2, "I": 5}[op]
            i, j = i + (op != "I"), j + (op != "D")
        return total if (i, j) == (len(turns), len(want)) else None

    every = [(c, "".join(a)) for k in range(max(len(turns), len(want)), min(len(turns) + len(want), 9) + 1)
             for a in itertools.product("KRDI", repeat=k) if (c := cost(a)) is not None] if len(turns) + len(want) <= 8 else []
    for bound in (60, 5):
        got = repair.align(turns, want, bound)
        if every:
            assert got == (min(every) if min(every)[0] <= bound else None)
        assert got is None or got[0] <= bound


def expected(rows, gone=()):
    """{conv_id: report} of (conv_id, turn, role, text) rows; ``gone`` rows stand for their conversation."""
    out = {}
    for conv in {r[0] for r in [*rows, *gone]}:
        own = sorted(
            [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv],
            key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        blank = duplicate = truncated = 0
        code, seen = "", set()
        for _, role, text in own:
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            if not last:
                blank, letter = blank + 1, "x"
            elif (role, text) in seen:
                duplicate, letter = duplicate + 1, "x"
            elif last[0] not in ".!?":
                truncated, letter = truncated + 1, letter.upper()
            seen.add((role, text))
            code += letter
        turns = [t for t, _, _ in own if t is not None]
        initials = [role[:1] for _, role, _ in own]
        cost, audit = by_states(code, 0, (0, 3))
        kept, i, n = [], 0, 0
        head = (len(audit) - audit.count("D")) % 2
        for op in audit:
            name = "user" if (n - head) % 2 == 0 else "assistant"
            if op == "I":
                kept.append(name + ":")
            elif op != "D":
                kept.append((own[i][1] if op == "K" else name) + ":" + own[i][2])
            i, n = i + (op != "I"), n + (op != "D")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated,
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def some_rows(rng):
    rows = []
    texts = ["Yes.", "No!", "Is it?", "open", "", " \n", None, "é ü.", "A. ", "tail,\t", "x\n\ny."]
    for conv in [None, *range(60)]:
        for t in range(rng.choice((0, 1, 2, 5, 9, 30, 60))):
            turn = rng.choice((t, t, t, t + 1, None))
            text = rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.randrange(40)}."
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "", "usher")) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((conv, turn, role, text))
            rows += [rows[-1]] * rng.choice((0, 0, 0, 1, 3))
    # A conversation that spans many pieces and partitions, and one with equal rows only.
    rows += [(500, t, ("user", "assistant")[(t + t // 70) % 2] if t % 13 else "system", f"Say {t % 900}" + "." * (t % 11 > 0)) for t in range(3000)]
    rows += [(501, 4, "user", "Same.")] * 700
    rng.shuffle(rows)
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rows = some_rows(random.Random(6))
    out = repair.repair_conversations(spark.createDataFrame([(*r, "c", 1, "g") for r in rows], COLUMNS + ", conv string, part int, said string"))
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = expected(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    assert repair.repair_conversations(spark.createDataFrame([], COLUMNS)).count() == 0


def test_repaired_turns(spark):
    rows = some_rows(random.Random(8))
    table = spark.createDataFrame(rows, COLUMNS).withColumn("conv_id", repair.F.col("conv_id").cast("string"))
    turns = repair.repaired_turns(table).collect()
    by = {}
    for r in sorted(turns, key=lambda r: r.position):
        by.setdefault(r.conv_id, []).append(r)
    for conv, report in expected(rows).items():
        own = by.get(None if conv is None else str(conv), [])
        assert [r.position for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == report[-1]


def test_long_text_and_gone(spark):
    rows = [(1, 0, "user", "long " * 400_000 + "."), (1, 1, "assistant", "Ok."), (2, None, None, None)]
    gone = [(3, 5, "user", "Hi."), (3, 6, "user", "Hi."), (1, 2, "user", "Hi."), (None, 0, "user", "Hi.")]
    table = spark.createDataFrame([(*r, False) for r in rows] + [(*r, True) for r in gone], COLUMNS + ", gone boolean")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(table, gone="gone").collect()}
    assert got == expected(rows, gone) and got[3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query(spark, tmp_path):
    rng = random.Random(12)
    rows = [
        (c, t, ("system" if t == 0 and c % 3 == 0 else ("user", "assistant")[(t + (c % 3 == 0)) % 2]), f"Words of {t} {rng.randrange(50)}.")
        for c in range(150) for t in range(rng.randint(1, 9))]
    rows += [(None, 3, "user", "Ok."), (7, None, "user", None), (None, None, None, "Yes.")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "conversations.parquet"))
    after, gone = [], []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            gone.append((c, t, role, text))
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == expected(after, gone)
