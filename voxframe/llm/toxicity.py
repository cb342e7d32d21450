"""Toxicity by nearest labelled examples.

Terms are words and the beginnings of words, so inflected forms meet. From a bounded sample of labelled
rows the terms that speak for the label are chosen; inverse document frequencies of them are counted over
all documents. A text is its TF-IDF vector over these terms, and its score is a vote of the k labelled
examples with the highest cosine, weighted by it. The search is exact: the examples lie in
an inverted index of aligned blocks with the highest weight of each term per block; blocks are visited in the order of their
bound, until the bound cannot reach the kth cosine. Votes are turned into probabilities by a
logistic curve fitted on the examples' own leave-one-out votes.

Bounds (parameters): ``per_class`` examples of each label, ``n_terms`` terms. The index depends on them only, so
it is small however large the corpus is; corpus statistics and scores cover all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import written

PER_CLASS = 3000
N_TERMS = 1000
NEIGHBOURS = 25
BLOCK = 64
#: Lengths of word beginnings that are terms of their own, written with a trailing "-".
STEMS = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")
GROUP_BYTES = 4_000_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from: crc32 of the id as text, modulo 5, is 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


# --- terms -----------------------------------------------------------------------------------

def terms_of(chunk: str) -> list[str]:
    """The terms in a chunk between white space."""
    out = []
    for word in LETTERS.findall(chunk.lower()):
        out.append(word)
        out += [word[:n] + "-" for n in STEMS if n < len(word)]
    return out


def _chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, their numbers in order, number of the text of each) of an array of texts."""
    spaced = pc.replace_substring_regex(texts, r"[\t-\r]+", " ")
    lists = pc.split_pattern(spaced, " ")
    coded = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy())
    return (coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(),
            np.repeat(np.arange(len(texts)), sizes))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about GROUP_BYTES of text each."""
    to = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(batch):
        base = int(to[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(to, base + GROUP_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, key, terms) per text: its distinct terms; near copies have mostly one key (lowest hash of its 3-word windows)."""
    import xxhash

    for whole in batches:
        for batch in _slices(whole, 1):
            terms, keys = [], []
            for text in batch.column(1).to_pylist():
                words = text.split()
                terms.append(sorted(set(t for w in set(words) for t in terms_of(w))))
                keys.append(min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))) >> 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(terms, pa.list_(pa.string()))], ["toxic", "key", "terms"])


def sparse_counts(texts: pa.Array, vocabulary: dict[str, int]) -> list[tuple[tuple[int, int], ...]]:
    """((term, count), ...) of each text, by term."""
    chunks, at, row = _chunks(texts)
    known = {}
    for i, c in enumerate(chunks):
        found = [vocabulary[t] for t in terms_of(c) if t in vocabulary]
        if found:
            known[i] = found
    has = np.zeros(len(chunks) + 1, bool)
    has[list(known)] = True
    hits = np.flatnonzero(has[at])
    lists: list[dict[int, int]] = [{} for _ in range(len(texts))]
    for chunk, r in zip(at[hits].tolist(), row[hits].tolist(), strict=True):
        for t in known[chunk]:
            lists[r][t] = lists[r].get(t, 0) + 1
    return [tuple(sorted(x.items())) for x in lists]


def _document_counts(vocabulary: dict[str, int]):
    """(term, texts with it), summed per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(len(vocabulary) + 1, np.int64), 0
        for whole in batches:
            for batch in _slices(whole, 0):
                rows += len(batch)
                for x in sparse_counts(batch.column(0), vocabulary):
                    for t, _ in x:
                        sums[t] += 1
            pa.default_memory_pool().release_unused()
        sums[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.int64())], ["term", "n"])
    return run


def _score_rows(vocabulary: dict[str, int], shared, k: int, at: int, remember: int = 5_000):
    """Rows with the text as column ``at`` -> the same rows with score and evidence; equal vectors are searched once."""
    def scored(whole: pa.RecordBatch, index, seen: dict) -> Iterator[pa.RecordBatch]:
        for batch in _slices(whole, at):
            rows = []
            for x in sparse_counts(pc.fill_null(batch.column(at), ""), vocabulary):
                if x not in seen:
                    if len(seen) >= remember:
                        seen.clear()
                    score, found = index.score([t for t, _ in x], [n for _, n in x], k)
                    seen[x] = score, index.ids[np.array([i for _, i in found], np.int64)], np.array([c for c, _ in found], np.float64)
                rows.append(seen[x])
            ends = np.cumsum([0, *(len(ids) for _, ids, _ in rows)])
            pairs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([ids for _, ids, _ in rows])), pa.array(np.concatenate([c for _, _, c in rows]))], ["doc_id", "cosine"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s for s, _, _ in rows], pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                [*batch.schema.names, "score", "evidence"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = shared.value, {}
        for whole in batches:
            yield from scored(whole, index, seen)
            # What the allocator keeps of a batch counts against the executor.
            del whole
            pa.default_memory_pool().release_unused()
    return run


# --- the index -------------------------------------------------------------------------------

@dataclass
class Index:
    """Inverted lists of unit vectors in aligned blocks of ``BLOCK`` examples."""

    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    idf: np.ndarray
    block: int = BLOCK
    slope: float = 1.0
    offset: float = 0.0
    postings: dict = field(default_factory=dict)
    empty: float = 0.0

    @classmethod
    def build(cls, ids, terms, counts, labels, weights, idf, block: int = BLOCK, k: int = NEIGHBOURS) -> Index:
        """Examples are ordered by their heaviest term, so a block holds like vectors and its bounds are tight."""
        unit = [_unit(t, c, idf) for t, c in zip(terms, counts, strict=True)]
        heaviest = [(int(t[v.argmax()]), -float(v.max())) if len(t) else (-1, 0.0) for t, v in unit]
        order = sorted(range(len(ids)), key=lambda i: (heaviest[i], ids[i]))
        index = cls(np.array([ids[i] for i in order], np.int64), np.array([labels[i] for i in order], np.float64),
                    np.array([weights[i] for i in order], np.float64), idf, block)
        lists: dict[int, tuple[list, list]] = {}
        for at, i in enumerate(order):
            for t, v in zip(*unit[i], strict=True):
                rows, values = lists.setdefault(int(t), ([], []))
                rows.append(at)
                values.append(v)
        n_blocks = -(-len(order) // block)
        for t, (rows, values) in lists.items():
            rows, values = np.array(rows), np.array(values)
            top = np.zeros(n_blocks)
            np.maximum.at(top, rows // block, values)
            index.postings[t] = (rows, values, np.searchsorted(rows, np.arange(n_blocks + 1) * block), top)
        index._calibrate([unit[i] for i in order], k)
        return index

    def search(self, terms: np.ndarray, values: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k highest (cosine, position), equal cosines by smaller id; only positive cosines. ``skip`` takes no part."""
        lists = [(self.postings[int(t)], v) for t, v in zip(terms, values, strict=True) if int(t) in self.postings]
        if not lists:
            return []
        bounds = sum(v * p[3] for p, v in lists)
        best: list[tuple[float, int, int]] = []
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or (len(best) == k and bounds[b] < best[-1][0] - 1e-12):
                break
            scores = np.zeros(self.block)
            for (rows, weights, starts, _), v in lists:
                own = slice(starts[b], starts[b + 1])
                scores[rows[own] - b * self.block] += v * weights[own]
            found = np.flatnonzero(scores > 0)
            if len(best) == k:
                found = found[scores[found] >= best[-1][0] - 1e-12]
            if not len(found):
                continue
            best += [(round(float(scores[i]), 12), int(self.ids[b * self.block + i]), int(b * self.block + i)) for i in found
                     if b * self.block + i != skip]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return [(s, at) for s, _, at in best]

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, weighted by cosine and by how many rows an example stands for."""
        if not found:
            return self.empty
        w = np.array([s for s, _ in found]) * self.weights[[at for _, at in found]]
        return float((w * self.labels[[at for _, at in found]]).sum() / w.sum())

    def _calibrate(self, unit: list, k: int):
        bare = np.array([not len(t) for t, _ in unit], bool)
        w = self.weights
        # Texts without any term are at the same distance from all; their vote is the share among examples like them.
        self.empty = float(((w * self.labels)[bare].sum() + 0.05) / (w[bare].sum() + 1.0)) if bare.any() else 0.05
        votes = np.array([self.vote(self.search(t, v, k, skip=i)) for i, (t, v) in enumerate(unit)])
        x, y = _logit(votes), self.labels
        a, b = 1.0, 0.0
        for _ in range(30):
            # Newton steps with a weak pull to the identity, which keeps separable samples finite.
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(w * (p - y) * x).sum() + (a - 1), (w * (p - y)).sum() + b])
            s = w * p * (1 - p)
            h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
        self.slope, self.offset = float(max(a, 0.05)), float(b)

    def score(self, terms: np.ndarray, counts: np.ndarray, k: int) -> tuple[float, list[tuple[float, int]]]:
        found = self.search(*_unit(terms, counts, self.idf), k)
        x = _logit(np.array([self.vote(found)]))[0]
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))), found


def _logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 0.01, 0.99)
    return np.log(q / (1 - q))


def _unit(terms, counts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.asarray(terms, np.int64)
    values = (1 + np.log(np.asarray(counts, np.float64))) * idf[terms] if len(terms) else np.zeros(0)
    norm = np.sqrt((values * values).sum())
    return terms, values / norm if norm > 0 else values


# --- the jobs ------------------------------------------------------------------------------------

def choose_terms(sample: DataFrame, n_terms: int = N_TERMS) -> list[str]:
    """The terms that speak most for label 1, from ``sample`` (toxic, text): by the G statistic of document counts.

    Near copies count once. A term needs 5 texts with label 1 and 0.5 % of them, and must be 25 times as
    frequent there as elsewhere. At most ``n_terms`` terms come to the driver.
    """
    bags = written(sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(
        _sample_terms, "toxic int, key bigint, terms array<string>"), "toxicity-sample").dropDuplicates(["toxic", "key"])
    n = {r.toxic: r["count"] for r in bags.groupBy("toxic").count().collect()}
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    if not n1:
        return []
    a, b = F.col("a"), F.col("b")
    share = (a + b) / (n1 + n0)
    gain = a * F.log(a / n1 / share) + F.when(b > 0, b * F.log(b / max(n0, 1.0) / share)).otherwise(0.0)
    chosen = (
        bags.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .filter((a >= max(5.0, 0.005 * n1)) & (a / n1 >= 25 * (b + 0.5) / (n0 + 1)))
        .select("term", F.round(gain, 9).alias("gain")).orderBy(F.col("gain").desc(), "term").limit(n_terms)
    )
    return [r.term for r in chosen.collect()]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, n_terms: int = N_TERMS, k: int = NEIGHBOURS
) -> DataFrame:
    """``docs`` with held_out, score, predicted and evidence (doc_id and cosine of the nearest examples).

    ``labels`` (doc_id, toxic) teaches from rows that are not held out, at most ``per_class`` of each label, those with the smallest
    digest of their id. Only the text is scored. Null and empty texts, and texts without a term, get the rate of label 1 among
    examples without a term. Without any example of label 1, every score is low. Rows with null or repeated ids are scored by their
    own text; of labels that differ for one id, 1 holds. Clashing columns of ``docs`` are replaced.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "evidence")]
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    taught = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("toxic").alias("toxic"))
    )
    totals = {r.toxic: r["count"] for r in taught.groupBy("toxic").count().collect()}
    picked = [taught.filter(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    chosen = written(picked[0].unionByName(picked[1]), "toxicity-picked")
    # At most 2 * per_class rows of an id and a label.
    sample = docs.select(F.col("doc_id").cast("long").alias("_id"), body.alias("text")).join(F.broadcast(chosen), "_id")
    words = choose_terms(sample, n_terms)
    vocabulary = {t: i for i, t in enumerate(words)}

    texts = docs.select(body.alias("text"))
    n_docs, idf = 0, np.zeros(len(words))
    # One row per term.
    for r in texts.mapInArrow(_document_counts(vocabulary), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term == len(words):
            n_docs = r.n
        else:
            idf[r.term] = r.n
    idf = np.log((n_docs + 1.0) / (idf + 0.5))
    # At most 2 * per_class sparse vectors.
    examples = sorted(_example_vectors(sample, vocabulary), key=lambda r: r._id)
    seen = {y: max(1, sum(r.toxic == y for r in examples)) for y in (0, 1)}
    index = Index.build(
        [r._id for r in examples], [r.terms for r in examples], [r.counts for r in examples], [r.toxic for r in examples],
        [totals.get(r.toxic, 0) / seen[r.toxic] for r in examples], idf, k=k)
    shared = spark.sparkContext.broadcast(index)
    # The text travels once, as the caller's own column if it is one.
    rows = docs.select(*own) if docs.schema["text"].dataType == T.StringType() else docs.select(*[c for c in own if c != "text"], body.alias("text"))
    schema = T.StructType(list(rows.schema.fields))
    schema = schema.add("score", "double").add("evidence", T.ArrayType(
        T.StructType().add("doc_id", "long").add("cosine", "double")))
    return rows.mapInArrow(_score_rows(vocabulary, shared, k, rows.columns.index("text")), schema).select(
        *own, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def _example_vectors(sample: DataFrame, vocabulary: dict[str, int]) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2):
                own = sparse_counts(batch.column(2), vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([[t for t, _ in x] for x in own], pa.list_(pa.int32())),
                     pa.array([[n for _, n in x] for x in own], pa.list_(pa.int32()))], ["_id", "toxic", "terms", "counts"])

    return sample.select("_id", "toxic", "text").mapInArrow(
        run, "_id bigint, toxic int, terms array<int>, counts array<int>").dropDuplicates(["_id"]).collect()
