import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_operators import multiset, sentence, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ("grumbly", "snotface", "wartiges")


def corpus():
    rng = random.Random(33)
    rows = []
    for i in range(160):
        body = "\n".join(sentence(rng, 20) for _ in range(4))
        if i % 5 == 0:
            body += "\n" + " ".join(rng.choices(INSULTS, k=3)).capitalize() + "."
        if i % 7 == 0:
            body += "\nHome | About | Help\nAll rights reserved."
        rows.append((i, body, "en", rng.choice(["hot", "hot", "b", "c", None]), len(body)))
    copies = [(200 + i, rows[i][1].replace("\n", "  ", 1) if i % 2 else rows[i][1], "en", "b", 0) for i in range(1, 40, 3)]
    odd = [(300 + i, t, None, "odd", None) for i, (_, t) in enumerate(texts())]
    return rows + copies + odd + [(1, *rows[1][1:])] * 2 + [(None, rows[2][1], "en", "hot", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{out}/documents.parquet")
    labels = [(d, None, int(any(w in t.lower() for w in INSULTS))) for d, t, *_ in rows[:160]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_pipeline_against_plain(spark, folder):
    rows = [r for r in corpus() if not any(w in (r[1] or "").lower() for w in INSULTS)]
    rows = [(r[0], q[7], *r[2:]) for r in rows for q in [plain.quality(r[1])] if q[6]]
    group, best = plain.components([r[:2] for r in rows], 5), {}
    for g, r in sorted(zip(group, rows, strict=True), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        best.setdefault(g, r)
    rows = list(best.values())
    rows = [r for r, c in zip(rows, plain.mix([(r[0], r[1], r[3]) for r in rows]), strict=True) for _ in range(c)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(r[0], r[2], r[3], library.encode(r[1])) for r in rows]
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(want) > 80 and all(r.round_trip for r in out)
    assert multiset((r.doc_id, r.lang, r.source, np.frombuffer(r.ids, "<u4").tolist()) for r in out) == multiset(want)


def test_stages_on_odd_and_empty_input(spark, folder):
    docs = spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", "1 as score", "'x' as size", "'y' as kept", "2 as n")
    for some in (docs.limit(0), docs.filter("doc_id >= 300 or doc_id is null")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, folder).columns == docs.columns
            stage(spark, some, folder).collect()
        corpus_pipeline.STAGES[-1][1](spark, some.coalesce(1), folder).collect()


def test_stages_call_dealt_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "mixing", "sentencepiece"]
