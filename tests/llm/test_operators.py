import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import plain
from voxframe.llm import kdtree, pareto, quality, sentencepiece_lattice, superminhash, tokencount, toxicity, urlfilter, wavelet
from voxframe.llm.common import job_folder

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SYLLABLES = "ba de fi go ku la me ni po ru sa te vi wo xu ya zé ßa ñi".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def texts():
    """Nulls, empty and odd texts, a very long one, ties and repeated rows; with ids that are null or come twice."""
    rng = random.Random(7)
    base = [sentence(rng, 60) for _ in range(12)]
    long = " ".join(sentence(rng, 40) for _ in range(400))
    odd = [None, "", " ", "\n\n", "one", "  two  spaces ", "▁mark", "It's <|endoftext|> 12ab\tx\x1cy", "😀 é́ Á H̱ 中文字 ½²", "x" * 3000, long]
    near = [base[0].replace("ba", "be", 1), base[0].upper(), base[1] + " more", base[0]]
    rows = [(i, t) for i, t in enumerate(base + odd + near)]
    return rows + [(3, base[3]), (3, base[3]), (None, base[4]), (None, None), (None, base[4])]


SCHEMA = "doc_id long, text string, score string, ids int, size string, kept string, n int, node int, word string, key string"


def frame(spark, rows=None):
    """The texts with columns named like results and internals."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(d, t, "s", 1, "z", "k", 2, 3, "w", "y") for d, t in rows], SCHEMA)


def multiset(rows):
    return sorted(rows, key=repr)


# --- wavelet files ------------------------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300))
def test_wavelet_questions(ids):
    m = wavelet.WaveletMatrix(b"".join(wavelet.build(np.array(ids, np.uint32), [5, None], np.array([len(ids) // 2, len(ids)]))))
    assert m.decode().tolist() == ids and m.doc_ids == [5, None] and m.starts.tolist() == [0, len(ids) // 2, len(ids)]
    for i in range(0, len(ids), 7):
        assert m.access(i) == ids[i]
        assert m.rank(ids[i], i) == ids[:i].count(ids[i])
    for token in {*ids[:5], 70_001}:
        at = [i for i, x in enumerate(ids) if x == token]
        assert m.count(token) == len(at) and m.occurrences(token) == at
    with pytest.raises(IndexError):
        m.select(70_001, 0)


def test_wavelet_over_blocks():
    ids = np.random.default_rng(3).zipf(1.4, 700_000).clip(0, 60_000).astype(np.uint32)
    m = wavelet.WaveletMatrix(b"".join(wavelet.build(ids, [1], np.array([len(ids)]))))
    assert (m.decode() == ids).all()
    for token in (1, 2, 900):
        at = np.flatnonzero(ids == token)
        assert m.count(token) == len(at) and m.rank(token, 600_000) == (at < 600_000).sum()
        assert [m.select(token, j) for j in (0, len(at) // 2, len(at) - 1)] == at[[0, len(at) // 2, -1]].tolist()


def test_token_shards(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    want = [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in texts()]
    for options in ({}, {"shard_ids": 150, "docs_per_range": 5}, {"by_part": False}):
        rows = wavelet.token_shards(frame(spark), WORD_BPE, end_id=2, **options).withColumn("crc", wavelet.crc32_of()).collect()
        got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
        assert multiset(got) == multiset(want)
        assert all(r.crc == zlib.crc32(r.ids) and r.n_tokens * 4 == len(r.ids) for r in rows)
        in_order = sorted(rows, key=lambda r: r.start)
        assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order[:-1])]).tolist()
        ids = [r.doc_id for r in in_order]
        assert ids == sorted(ids, key=lambda d: (d is not None, d))
    assert wavelet.token_shards(frame(spark, []), WORD_BPE, end_id=2).count() == 0


def test_find_tokens(spark):
    folder = job_folder(spark, "wavelet")
    wavelet.write_shards(frame(spark).select("doc_id", "text"), WORD_BPE, folder, end_id=2, shard_ids=200, docs_per_range=7).count()
    encoder = wavelet.WholeEncoder(WORD_BPE)
    ids = [(d, [*encoder.ids([t or ""])[0], 2]) for d, t in texts()]
    some = [2, ids[0][1][0], ids[3][1][1], 49_000]
    counts = {}
    for r in wavelet.find_tokens(spark, folder, some).collect():
        counts[r.token] = counts.get(r.token, 0) + r.n
    assert counts == {t: n for t in some if (n := sum(own.count(t) for _, own in ids))}
    places = wavelet.find_tokens(spark, folder, some, places=True).collect()
    assert multiset((r.token, r.doc_id, r.position) for r in places) == multiset(
        (t, d, i) for d, own in ids for i, t in enumerate(own) if t in some)


def test_part_encoder_only_where_the_file_allows(spark):
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert wavelet.PartEncoder.suits(WORD_BPE) and not wavelet.PartEncoder.suits(other)
    with pytest.raises(ValueError):
        wavelet.PartEncoder(other)
    tok = Tokenizer.from_file(other)
    rows = wavelet.token_shards(frame(spark), other).collect()
    assert multiset((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == multiset(
        (d, tok.encode(t or "", add_special_tokens=False).ids) for d, t in texts())


def test_part_encoder_case_and_marks():
    """Capitals with combining marks, special tokens in either case, and letters whose small form is longer."""
    encoder = wavelet.PartEncoder(WORD_BPE)
    some = ["H\u0331 J\u030c I\u0307 \u0130 E\u0301", "<|ENDOFTEXT|> <|endoftext|> A<|B", "HELLO Hello hello, HELLO!", "ẞ ß Σ ς ÀB àb", "K\u212a \u017f"]
    ids, counts = encoder.encode(pa.array(some))
    want = encoder.ids(some)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_part_encoder_forgets():
    encoder, rng = wavelet.PartEncoder(WORD_BPE, remember=50), random.Random(1)
    for _ in range(5):
        some = [sentence(rng, 30), "Don't, STOP! 3x", "", "é's ñi,"]
        ids, counts = encoder.encode(pa.array(some))
        want = encoder.ids(some)
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_part_encoder_words_skip_normalizer_and_split():
    """Words of small letters go to the model once for all groups of a call; what stands beside them does not change."""
    encoder, given_texts = wavelet.PartEncoder(WORD_BPE), []
    library = encoder.ids
    encoder.ids = lambda some: given_texts.extend(some) or library(some)
    groups = [pa.array(["sandig großer été, latte!! (no", "", "latte. sandig"]), pa.array([" \n"]), pa.array(["été großer? latte"])]
    got = [(ids.tolist(), counts.tolist()) for ids, counts in encoder.encode_groups(groups)]
    assert {w for t in given_texts for w in t.split() if w.isalpha()} == {"no"}  # of "(no", which does not begin with letters
    for (ids, counts), group in zip(got, groups, strict=True):
        want = library(group.to_pylist())
        assert counts == list(map(len, want)) and ids == [i for x in want for i in x]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("abzßéÿ÷ªµÉAİΣς's<|>.,!?-`^\\_~ \n\t\x1c\x85\xa0\u0301\u0338½2中", max_size=25), min_size=1, max_size=4), min_size=1, max_size=4))
def test_part_encoder_any_text(groups):
    encoder = part_encoder()
    for (ids, counts), group in zip(encoder.encode_groups([pa.array(g, pa.string()) for g in groups]), groups, strict=True):
        want = encoder.ids(group)
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


@functools.cache
def part_encoder():
    return wavelet.PartEncoder(WORD_BPE)


# --- token counts --------------------------------------------------------------------------------

def test_token_counts_and_cache(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    sp, tok = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORD_BPE)
    cache = job_folder(spark, "cache")
    for path, count in ((PIECES, lambda t: len(sp.encode(t))), (WORD_BPE, lambda t: len(tok.encode(t, add_special_tokens=False).ids))):
        df = tokencount.count_tokens(frame(spark), path, cache, limit=500)
        got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()]
        want = [(d, len((t or "").encode()), count(t or ""), count(t or "") > 500) for d, t in texts()]
        assert multiset(got) == multiset(want)
    stored = spark.read.parquet(cache)
    size = stored.count()
    assert size == 2 * len({t or "" for _, t in texts()})
    # A poisoned entry shows that stored counts are used, and nothing is added for known contents.
    assert tokencount.count_tokens(frame(spark), PIECES, cache).count() == len(texts()) and spark.read.parquet(cache).count() == size
    assert tokencount.count_tokens(frame(spark, []), PIECES, job_folder(spark, "cache")).count() == 0


def test_token_counts_of_many_misses(spark, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(tokencount, "FEW_MISSES", 3)
    got = [(r.doc_id, r.n_tokens) for r in tokencount.count_tokens(frame(spark), PIECES).collect()]
    assert multiset(got) == multiset((d, len(sp.encode(t or ""))) for d, t in texts())


def test_token_counts_edges(spark):
    """Columns named like internals, a content that two runs appended, and a known corpus that moves no text."""
    rows = [(i, t, "c", "r", 5) for i, t in enumerate(["one two", "one two", None, "three"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _content string, content string, `row` int")
    cache = job_folder(spark, "cache")
    first = tokencount.count_tokens(docs, PIECES, cache).collect()
    assert [r._content + r.content + str(r.row) for r in first] == ["cr5"] * 4
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    again = tokencount.count_tokens(docs, PIECES, cache)
    assert multiset(map(tuple, again.collect())) == multiset(map(tuple, first))
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "left_semi" not in plan.lower()
    assert spark.read.parquet(cache).count() == 6


# --- toxicity ------------------------------------------------------------------------------------

def toxic_rows(n=240):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        body = sentence(rng, rng.randint(20, 80))
        if i % 4 == 0:
            body += " " + " ".join(rng.choice(["grumbly", "Snotface,", "wartig" + rng.choice(["es", "em", "er"])]) for _ in range(3))
        rows.append((i, body, int(i % 4 == 0)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "grumbly Snotface grumbly"), (None, None)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (7, 0), (7, 0)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert all(by[i].predicted == y for i, _, y in rows if by[i].held_out)
    assert by[900].score == by[901].score < 0.5 and by[900].evidence == []
    assert max(r.score for r in out if r.doc_id is None) >= 0.5
    assert all(by[e.doc_id].held_out is False for r in out for e in r.evidence)


def test_toxicity_without_examples(spark):
    docs = frame(spark, [(1, "grumbly"), (2, None)])
    for labels in ([], [(1, 0)], [(1, None)]):
        out = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert [r.predicted for r in out] == [0, 0]
    assert toxicity.score_toxicity(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12))
def test_block_max_search_is_exact(seed, k):
    rng = np.random.default_rng(seed)
    idf = rng.uniform(1, 5, 12)
    bags = [np.sort(rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(60)]
    counts = [rng.integers(1, 4, len(b)) for b in bags]
    index = toxicity.Index.build(list(range(60)), bags, counts, [i % 2 for i in range(60)], [1.0] * 60, idf, block=4, k=5)
    dense = np.zeros((60, 12))
    for i, (b, c) in enumerate(zip(bags, counts, strict=True)):
        t, v = toxicity._unit(b, c, idf)
        dense[i, t] = v
    for i in range(0, 60, 9):
        found = [(s, int(index.ids[at])) for s, at in index.search(*toxicity._unit(bags[i], counts[i], idf), k)]
        scores = dense @ dense[i]
        want = sorted(((round(float(s), 9), j) for j, s in enumerate(scores) if s > 1e-12), key=lambda x: (-x[0], x[1]))[:k]
        assert [round(s, 9) for s, _ in found] == [s for s, _ in want]
        assert {j for s, j in found if s > want[-1][0] + 1e-8} == {j for s, j in want if s > want[-1][0] + 1e-8} if want else not found


# --- sentencepiece -------------------------------------------------------------------------------

def test_sentencepiece_numbers_a_block_in_bounded_memory():
    """Numbers of words take four bytes each, and temporary arrays do not grow with the block."""
    import tracemalloc

    import pyarrow as pa

    model = sentencepiece_lattice.pieces_of(PIECES)
    texts = pa.array(["one two, three four five six seven " * 5000, "", " two  one"] * 20)
    tracemalloc.start()
    words, codes, ends = sentencepiece_lattice._coded(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(codes) == ends[-1] > 800_000 and peak < 20 * len(codes)
    assert "".join(words[i] for i in codes[ends[0] : ends[1]]) == "▁" + texts[0].as_py().replace(" ", "▁")
    assert ends[1] == ends[2] and "".join(words[i] for i in codes[ends[2] : ends[3]]) == "▁▁two▁▁one"


def test_lattice_against_plain_viterbi(spark):
    model = sentencepiece_lattice.pieces_of(PIECES)
    out = sentencepiece_lattice.encode(frame(spark).coalesce(2), PIECES)
    rows = sentencepiece_lattice.decode(out, PIECES).collect()
    want = [(d, plain.encode(t, model)) for d, t in texts()]
    assert multiset([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]) == multiset(want)
    lossy = {d for d, t in texts() if "▁" in (t or "")}
    bodies = {d: t or "" for d, t in texts() if d is not None}
    for r in rows:
        assert r.round_trip == (r.doc_id not in lossy)
        if r.doc_id is not None and r.round_trip:
            assert r.decoded == bodies[r.doc_id] and r.n_pieces * 4 == len(r.ids)
    assert sentencepiece_lattice.encode(frame(spark, []), PIECES).count() == 0


def test_merges_against_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(9)
    english = "the government's information: \tif (x == 10):\n      return  self.values[0]  # naïve Übergrößenträger 中文 😀"
    rows = texts() + [(100, english), (101, "ab" + " " * 40 + "the"), (102, " " * 300), (103, "x\n" + " " * 17 + "y")]
    rows += [(200 + i, "".join(rng.choice(["a", "e", "th", "in", "s", "A", "é", "中", "1", ".", "\n", " ", " " * rng.randint(1, 40)]) for _ in range(60)))
             for i in range(60)]
    out = sentencepiece_lattice.encode(frame(spark, rows).coalesce(2), PIECES, merges=True).collect()
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in out]
    assert multiset(got) == multiset((d, library.encode(t or "")) for d, t in rows)
    assert all(r.n_pieces * 4 == len(r.ids) for r in out)


def test_long_runs(spark):
    """Unbroken runs of 100,000 characters, in both modes, and columns named like internals."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    runs = ["-" * 100_000, "a" * 50_001 + "." * 4000, "".join(rng.choice("thea") for _ in range(100_000)), "中文字" * 20_000, "😀é" * 700]
    rows = spark.createDataFrame(
        [(i, t, 7, 8, "c", "r", 9) for i, t in enumerate(runs)], "doc_id long, text string, _block int, _crc int, _codes string, _row string, _own0 int")
    out = sentencepiece_lattice.encode(rows, PIECES, merges=True)
    assert out.columns == ["doc_id", "_block", "_crc", "_codes", "_row", "_own0", "n_pieces", "ids", "round_trip"]
    for r in out.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(runs[r.doc_id]) and r.round_trip
        assert (r._block, r._crc, r._codes, r._row, r._own0) == (7, 8, "c", "r", 9)
    model = sentencepiece_lattice.pieces_of(PIECES)
    some = rows.filter("doc_id in (1, 4)").collect() and sentencepiece_lattice.encode(rows.filter("doc_id in (1, 4)"), PIECES).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in some) == [(i, plain.encode(runs[i], model)) for i in (1, 4)]


def test_query_has_library_ids(spark, tmp_path):
    import sentencepiece

    from voxframe.llm.queries import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(1, "the government of information"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_sentencepiece"](spark, str(tmp_path)).collect()
    want = [(d, np.array(library.encode(t or ""), "<u4")) for d, t in rows]
    assert sorted((r.doc_id, r.n_pieces, r.ids_crc32) for r in got) == [(d, len(i), zlib.crc32(i.tobytes())) for d, i in want]


def test_lattice_long_run_and_cuts(spark):
    model = sentencepiece_lattice.pieces_of(PIECES)
    assert model.by_class
    rng = random.Random(5)
    for _ in range(50):
        chunk = "".join(rng.choice("abcéñßü中文1.,(▁") for _ in range(rng.randint(0, 90)))
        atoms = model.atoms(chunk)
        assert "".join(atoms) == "▁" + chunk
        pieces = {p: (i, s) for p, i, s in model.rows}
        whole = [i for *_, i in plain.viterbi("▁" + chunk, pieces, model.unknown_score)]
        assert [i for a in atoms for *_, i in plain.viterbi(a, pieces, model.unknown_score)] == whole


# --- top-k ---------------------------------------------------------------------------------------

def brute_top(rows, k, queries):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append([int(np.floor(float(np.float32(x)) * 256)) for x in v])
    out = []
    for q in queries:
        if q in good:
            own = min(good[q])
            scores = sorted(((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, vs in good.items() if i != q for v in vs if len(v) == len(own)))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)]  # one very common vector
    rows += [(400, None), (401, [None] + [0.1] * 5), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (None, [0.1] * 6),
             (410, [1.0, 2.0]), (411, [1.0, 3.0]), (412, [9.0]), (7, [rng.random() for _ in range(6)]), (7, [2.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    for options in ({}, {"shard_rows": 16, "query_rows": 4}):
        got = kdtree.top_k(df, F.col("vec_id") % 10 == 0, **options).collect()
        assert sorted(map(tuple, got)) == brute_top(rows, 5, [i for i in range(0, 420, 10)])
    few = df.filter("vec_id in (1, 2, 3)")
    assert sorted(map(tuple, kdtree.top_k(few, F.col("vec_id") == 2).collect())) == brute_top([r for r in rows if r[0] in (1, 2, 3)], 5, [2])
    assert kdtree.top_k(df.limit(0), F.col("vec_id") == 2).count() == 0


def test_top_k_many_vectors_without_components(spark):
    rows = [(i, []) for i in range(100)] + [(200, [1.0]), (201, [2.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "d") for i, v in rows], "vec_id long, embedding array<float>, _id int, _shard int, dim string")
    got = kdtree.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=16)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, [0, 50, 200])
    same = [(i // 40, [1.0, -1.0]) for i in range(400)]
    got = kdtree.top_k(spark.createDataFrame(same, "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0, shard_rows=16)
    assert sorted(map(tuple, got.collect())) == brute_top(same, 5, [0, 5])


def test_top_k_repeated_rows(spark):
    # The query is id 0; identical rows, and two vectors of one id with the same score, each count as often as they come.
    rows = [(0, [1.0, 0.0]), (7, [10.0, 0.0]), (7, [10.0, 0.0]), (9, [9.0, 1.0]), (9, [9.0, 2.0]), (9, [9.0, 3.0]), (2, [8.0, 0.0]), (3, [7.0, 0.0])]
    rows += [(100 + i, [-1.0, float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (2, 5, 50):
        for shard_rows in (2, 4096):
            got = kdtree.top_k(df, F.col("vec_id") == 0, k=k, shard_rows=shard_rows).collect()
            assert sorted(map(tuple, got)) == brute_top(rows, k, [0])


# --- near duplicates -------------------------------------------------------------------------------

def near_rows():
    rng = random.Random(21)
    rows = []
    for g in range(6):
        words = sentence(rng, 80).split()
        for c in range(9):
            own = words[:]
            for _ in range(c % 5):
                own[rng.randrange(len(own))] = "changed" + str(rng.randrange(1000))
            rows.append((len(rows), " ".join(own)))
    return rows + [(r[0] + 100, r[1]) for r in texts() if r[0] is not None]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = near_rows()
    ids = [d for d, _ in rows]
    group = plain.components(rows, k)
    for tile in (512, 2):
        out = {r.doc_id: r for r in superminhash.near_duplicates(frame(spark, rows), shingle=k, tile=tile).collect()}
        for i, (d, t) in enumerate(rows):
            least = min(ids[j] for j in range(len(rows)) if group[j] == group[i])
            assert (out[d].n_shingles, out[d].component_id, out[d].kept) == (len(plain.shingles(t, k)), least, least == d), (d, t)
            equal = [ids[j] for j, (_, x) in enumerate(rows) if plain.shingles(x, k) == plain.shingles(t, k) and plain.shingles(t, k)]
            assert out[d].class_id == min(equal, default=d)


def test_near_duplicates_odd_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "x y z w"), (None, ""), (None, None), (9, " "), (9, " ")]
    out = multiset((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in superminhash.near_duplicates(frame(spark, rows), shingle=2).collect())
    assert out == multiset([(None, 2, 5, False)] * 2 + [(5, 2, 5, True)] * 2 + [(None, 3, None, False)] + [(None, 0, None, False)] * 2 + [(9, 0, 9, True)] * 2)
    one = superminhash.keep_one(frame(spark, rows), shingle=2)
    assert one.columns == frame(spark).columns
    assert multiset((r.doc_id, r.text) for r in one.collect()) == multiset(
        [(5, "a b c"), (None, "x y z w"), (None, ""), (None, None), (9, " "), (9, " ")])
    assert superminhash.keep_one(frame(spark, []), shingle=2).count() == 0


def test_signatures_are_permutations():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1500).astype(np.uint64)
    one = superminhash.signatures(base[:1], np.array([0, 1]), 60)[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(60))
    for j in (0.5, 0.8):
        n = 800
        k = int(2 * n * j / (1 + j))
        both = np.concatenate([np.sort(base[:n]), np.sort(np.concatenate([base[:k], base[n : 2 * n - k]]))])
        r = superminhash.signatures(both, np.array([0, n, 2 * n]), 600)
        assert abs((r[0] == r[1]).mean() - j) < 0.09
    assert (superminhash.signatures(base[:0], np.array([0, 0]), 5) == superminhash.FULL).all()
    # Sizes do not change what a set gets.
    parts = np.array([0, 3, 3, 700, 701])
    whole = superminhash.signatures(base[:701], parts, 40, most=64)
    assert all((whole[i] == superminhash.signatures(base[a:b], np.array([0, b - a]), 40)[0]).all() for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))


# --- quality ---------------------------------------------------------------------------------------

def test_quality(spark):
    rng = random.Random(4)
    lines = [sentence(rng, 20) for _ in range(8)]
    extra = [
        "\n".join(lines), "\n".join(lines + lines[:2]), "\n".join(lines[:2]) + "\n" + "Home | About | Contact\n" * 40,
        "a b c " * 30, "a b c a b c a", "\n".join(lines) + "\nAll Rights Reserved.\n", "x### y$$$ " * 60, " ".join(["WORD!!"] * 60),
        sentence(rng, 90)[:-1], "\r\n".join(lines), "b a b a b a b c\n\n" + sentence(rng, 70),
    ]
    rows = texts() + [(1000 + i, t) for i, t in enumerate(extra)]
    out = quality.judge_quality(frame(spark, rows)).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.cleaned) for r in out]
    assert multiset(got) == multiset((d, *plain.quality(t)) for d, t in rows)
    assert quality.judge_quality(frame(spark, [])).count() == 0


# --- mixing ----------------------------------------------------------------------------------------

def mix_rows():
    rng = random.Random(9)
    return [(i if i % 17 else None, sentence(rng, rng.randint(1, 60)) if i % 11 else (None if i % 2 else ""),
             rng.choice(["hot", "hot", "hot", "b", "c", None, "", "zé"])) for i in range(400)] + [(1, "same row", "b")] * 5 + [(2, "", "empty only")]


def test_mixing(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(d, t, s, 1, "y") for d, t, s in rows], "doc_id long, text string, source string, size int, target string")
    out = pareto.mix(df).collect()
    copies = plain.mix(rows)
    assert multiset((r.doc_id, r.text, r.source, r.copies) for r in out) == multiset((d, t, s, c) for (d, t, s), c in zip(rows, copies, strict=True))
    per = {}
    for r in out:
        assert r.taken == r.copies * r.size <= 2 * r.size
        per.setdefault(r.source, [r.target, 0])[1] += r.taken
    goal = plain.targets({s: sum(r.size for r in out if r.source == s) for s in per})
    for s, (target, taken) in per.items():
        assert abs(target - goal[s]) < 1e-6 and abs(taken - target) <= 60
    assert multiset(map(tuple, out)) == multiset(map(tuple, pareto.mix(df.repartition(3)).collect()))
    assert pareto.mix(df.limit(0)).count() == 0
    assert [r.copies for r in pareto.mix(df.filter("source = 'empty only'")).collect()] == [0]


# --- URL rules ----------------------------------------------------------------------------------------

def test_url_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "Example.org", "/en/1"), ("allow", "a.example.org", "/es/"),
             ("block", "b.a.example.org", "/"), ("allow", "com", "/"), ("block", "com", "/"), ("block", "x", ""), (None, "net", "/"), ("block", None, "/"), ("block", "de", None)]
    urls = [None, "", "no scheme", "://", "http://", "http://org", "https://ORG/", "http://a.example.org/es/1?q#f", "http://c.b.a.example.org/es/", "http://b.a.example.org/es/x",
            "http://notexample.org/es/", "http://example.org/en/12", "http://example.org/en/2", "http://x", "http://y.x?/q", "http://com/", "http://.org/", "http://a..org/z",
            "http://example.org#/es/", "ftp://net/", "http://h/ü\n/x?y", "http://" + "l." * 60 + "example.org/es/" + "p" * 2000] + ["http://hot.example.org/es/1"] * 30
    df = spark.createDataFrame([(i % 25 or None, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = urlfilter.judge_urls(df, spark.createDataFrame(rules, urlfilter.RULE_SCHEMA), default="none").collect()
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:at].translate(plain.LOWER)
        path = rest[at:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), len(h), v, h.lower(), p) for v, h, p in rules if v and h is not None and p is not None
                and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=None)
        want.append((i % 25 or None, host, path, best and best[3] + best[4], best[2] if best else "none"))
    assert multiset(map(tuple, got)) == multiset(want)
    assert urlfilter.judge_urls(df.limit(0), spark.createDataFrame(rules, urlfilter.RULE_SCHEMA)).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(df, spark.createDataFrame([], urlfilter.RULE_SCHEMA)).collect()} == {"allow"}


def test_job_folders_can_be_cleared(spark):
    import os

    from voxframe.llm import common

    df = common.written(spark.range(5), "some")
    assert df.count() == 5
    folder = common.job_folder(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.isdir(folder)
    common.clear_job_folders(spark)
    assert not os.path.exists(folder)
    assert common.filesystem("file:/tmp")[1] == common.filesystem("/tmp")[1] == "/tmp"
