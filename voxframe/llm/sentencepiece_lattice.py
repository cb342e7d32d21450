"""SentencePiece encoding as a relational lattice, and decoding.

Blocks of documents are dictionary-encoded first: texts are cut where no piece can reach across, so the corpus
becomes numbers of words, and each distinct word is encoded once. For the words the lattice is relational:

* substrings of bounded length are exploded, by start and by length,
* an equi-join with the piece table (a model's vocabulary: broadcast) keeps those that are pieces,
* the edges of a word are grouped, and a higher-order ``aggregate`` chooses among them: for BPE models by merge order
  (``merges=True``), else the best scores by position (Viterbi), and a second one walks back.

The ids of the words then go back to the blocks that have them, in packed rows of one task's words for one block. A word that most documents
have is one reference per block on the way, so no key is hot. Runs of more than LONG_WORD characters that nothing cuts (dashes,
letters of one script) are merged or searched in a task, in linear memory: an ``aggregate`` copies its array at each step. Scores are those of the model file. In a BPE model they are the order of the merges, and with ``merges=True``
ids are those of SentencePiece. Without it the best path is the one with the highest sum, ties to the longer
last piece: what SentencePiece's unigram models do. Characters without a piece become byte pieces.

``docs`` must read the same rows in the same partitions each time, as a table does: it is read once for the words and
once for the documents.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_MARK = "▁"
#: A run of letters or of other characters, with the space marks in front of it.
ATOM = regex.compile(r"▁*\p{L}+|▁*[^\p{L}▁]+|▁+")
LONG_ATOM = 64
#: Longest word of the relational lattice.
LONG_WORD = 256
#: References that a task packs at a time.
PACKED_REFS = 400_000
BLOCK_BYTES = 16_000_000
#: A reference packs partition, block in it and word in that: 24, 12 and 28 bits.
BLOCK_SHIFT, PART_SHIFT = 28, 40
#: Chunks of a block that are numbered together: temporary arrays are bounded by it.
CODE_STEP = 1 << 18
UNKNOWN_PENALTY = 10.0
#: The order of a merge packs the rank of its piece, where it starts, its length and whether it is late: 18, 37, 7 and 1 bits.
RANK_SHIFT, START_SHIFT = 45, 8
#: Tasks over words per task over documents.
WORD_TASKS = 8


# --- the model -------------------------------------------------------------------------------------

class Pieces:
    """The table of a ``.model`` file: pieces with ids and scores, byte pieces, and where texts may be cut."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.path = path
        self.unused = any(model.is_unused(i) for i in range(size))
        self.rows = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in range(size)
                     if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.unknown = model.unk_id()
        self.bytes_from = model.piece_to_id("<0x00>") if any(model.is_byte(i) for i in range(size)) else -1
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.unknown_score = min(s for _, _, s in self.rows) - UNKNOWN_PENALTY
        # Cuts between letters and others hold only if no piece crosses one.
        self.by_class = all(len(ATOM.findall(p)) == 1 for p, _, _ in self.rows)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _, _ in self.rows):
            raise ValueError("pieces with a space mark behind other characters are not supported")
        self.inner = {a + b for p, _, _ in self.rows for a, b in pairwise(p)}
        surface = [b""] * size
        for p, i, _ in self.rows:
            surface[i] = p.replace(SPACE_MARK, " ").encode()
        for b in range(256 if self.bytes_from >= 0 else 0):
            surface[self.bytes_from + b] = bytes([b])
        if self.bytes_from < 0:
            surface[self.unknown] = " ⁇ ".encode()
        self.surface = surface
        self.lengths = np.array([len(x) for x in surface], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(surface), np.uint8)

    @cached_property
    def orders(self) -> list[int]:
        """Per row: when its merge takes place in BPE, for a piece that starts at 0; see ``merged``.

        BPE merges the best pair of neighbours, then the leftmost. If the parts of each piece are there before its turn, that is one
        walk over the edges by rank and start. A piece whose parts come later (long runs of spaces) takes its turn
        right behind the merge that makes the second of them.
        """
        if self.unused or self.longest > 127 or len(self.rows) >= 1 << 18:
            raise ValueError("merges of models with unused pieces, or more or longer pieces than an order holds, are not supported")
        ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        rank = {p: ranks[s] for p, _, s in self.rows}
        turns: dict[str, tuple[int, int, int, int]] = {}
        triggers: dict[tuple[str, int], int] = {}
        for p in sorted(rank, key=len):
            turns[p] = own = (rank[p], 0, len(p), 0)
            bounds, last = list(range(len(p) + 1)), None
            while len(bounds) > 3:
                live = [(rank[p[a:b]], a, b) for a, b in zip(bounds, bounds[2:], strict=False) if p[a:b] in rank]
                if not live:
                    break
                last = min(live)
                del bounds[bounds.index(last[1]) + 1]
            if len(bounds) == 3 and last:
                r, at, size, late = turns[p[last[1] : last[2]]]
                if (r, last[1] + at, size, late) > own:
                    # Orders of one trigger's pieces differ by their starts only.
                    if late or triggers.setdefault((p[last[1] : last[2]], r), rank[p]) != rank[p]:
                        raise ValueError("pieces whose parts come late by several merges are not supported")
                    turns[p] = (r, last[1], size, 1)
        return [(r << RANK_SHIFT) + (at << START_SHIFT) + 2 * size + late for r, at, size, late in (turns[p] for p, _, _ in self.rows)]

    def atoms(self, chunk: str) -> list[str]:
        """A chunk (the characters behind one space) as words that can be encoded on their own."""
        word = SPACE_MARK + chunk
        if self.by_class and chunk.isascii() and len(word) <= LONG_ATOM:
            # Most chunks are a word, or a word and a mark.
            if chunk.isalpha():
                return [word]
            if chunk[:-1].isalpha():
                return [word[:-1], word[-1]]
        parts = ATOM.findall(word) if self.by_class else [word]
        if chunk.isascii() and len(word) <= LONG_ATOM:
            return parts
        # Letters beyond ASCII, and long runs, are also cut between characters that stand together in no piece.
        inner, out = self.inner, []
        for part in parts:
            last = 0
            for i in range(1, len(part)):
                if part[i - 1 : i + 1] not in inner:
                    out.append(part[last:i])
                    last = i
            out.append(part[last:])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8: pieces in a row, space marks as spaces, without the space put in front."""
        data = self.flat[_spread(self.starts[ids], self.lengths[ids])].tobytes()
        return data[1:] if data[:1] == b" " and len(ids) and self.surface[ids[0]][:1] == b" " else data


    @cached_property
    def table(self) -> dict[str, tuple[int, int, float]]:
        """Piece -> (id, rank by score, score)."""
        ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        return {p: (i, ranks[s], s) for p, i, s in self.rows}

    def spelled(self, character: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.bytes_from + b for b in character.encode()] if self.bytes_from >= 0 else [self.unknown]

    def merge(self, word: str) -> list[int]:
        """Ids of a long word by merge order: the best pair of neighbours first, then the leftmost."""
        table, n = self.table, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(table[word[i : i + 2]][1], i, i + 2) for i in range(n - 1) if word[i : i + 2] in table]
        heapify(heap)
        live = bytearray(b"\1") * n

        def offer(start):
            middle = after[start]
            if middle < n and after[middle] - start <= self.longest:
                found = table.get(word[start : after[middle]])
                if found:
                    heappush(heap, (found[1], start, after[middle]))

        while heap:
            _, start, end = heappop(heap)
            middle = after[start]
            if not live[start] or middle >= n or after[middle] != end:
                continue
            live[middle] = 0
            after[start] = end
            if end < n:
                before[end] = start
            offer(start)
            if before[start] >= 0:
                offer(before[start])
        out, at = [], 0
        while at < n:
            piece = word[at : after[at]]
            out += [table[piece][0]] if piece in table else self.spelled(piece)
            at = after[at]
        return out

    def search(self, word: str) -> list[int]:
        """Ids of a long word by the best sum of scores, ties to the longer last piece."""
        table, n = self.table, len(word)
        score, back = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best = None
            for start in range(max(0, end - self.longest), end):
                found = table.get(word[start:end])
                if found or end - start == 1:
                    value = score[start] + (found[2] if found else self.unknown_score)
                    if best is None or value > best:
                        best, back[end] = value, start
            score[end] = best
        out, at = [], n
        while at:
            piece = word[back[at] : at]
            out.append([table[piece][0]] if piece in table else self.spelled(piece))
            at = back[at]
        return list(chain.from_iterable(reversed(out)))


_MODELS: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


# --- the lattice -----------------------------------------------------------------------------------

def piece_table(spark: SparkSession, model: Pieces, merges: bool = False) -> DataFrame:
    """(piece, id, score, key), with ``merges`` (piece, id, order, key): as many rows as the model has pieces."""
    worth = {"order": pa.array(model.orders, pa.int64())} if merges else {"score": [s for _, _, s in model.rows]}
    return spark.createDataFrame(
        pa.table({"piece": [p for p, _, _ in model.rows], "id": pa.array([i for _, i, _ in model.rows], pa.int32()),
                  **worth})).withColumn("key", F.xxhash64("piece"))


def best_sum(edges: DataFrame, model: Pieces, word: str) -> DataFrame:
    """(word, _path): the edges (id, start) of the path with the highest sum of scores."""
    ends = (
        edges.select(word, "end", F.struct("start", F.coalesce("score", F.lit(model.unknown_score)).alias("score"), "id").alias("edge"))
        .groupBy(word, "end").agg(F.collect_list("edge").alias("edges"))
        .groupBy(word).agg(F.sort_array(F.collect_list(F.struct("end", "edges"))).alias("ends"))
    )
    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(None).cast("int").alias("id")))

    def fold(best: Column, end: Column) -> Column:
        """``best`` has the best way to each position before ``end``; of equal scores the earlier start wins."""
        ways = F.transform(end["edges"], lambda e: F.struct(
            (F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("back"), e["id"].alias("id")))
        return F.concat(best, F.array(F.array_max(ways)))

    best = ends.select(word, F.aggregate("ends", zero, fold).alias("best"))
    last = F.size("best") - 1
    path = F.aggregate(
        F.sequence(last, F.lit(1), F.lit(-1)),
        F.struct(last.alias("at"), F.array().cast("array<struct<id:int,start:int>>").alias("path")),
        lambda s, i: F.when(i == s["at"], F.struct(
            (-F.get("best", i)["back"]).alias("at"),
            F.concat(F.array(F.struct(F.get("best", i)["id"].alias("id"), (-F.get("best", i)["back"]).alias("start"))), s["path"]).alias("path"),
        )).otherwise(s),
        lambda s: s["path"])
    return best.select(word, path.alias("_path"))


def merged(edges: DataFrame, word: str) -> DataFrame:
    """(word, _path): the edges (start, id) that are left when neighbours are merged in the order of the pieces."""
    listed = edges.select(word, F.struct(
        # Single characters are there from the start.
        F.when(F.col("end") - F.col("start") > 1, F.col("order") + F.shiftleft(F.col("start").cast("long"), START_SHIFT)).otherwise(0).alias("order"),
        "start", "end", "id").alias("edge")).groupBy(word).agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    def fold(bounds: Column, edge: Column) -> Column:
        """``bounds`` has -1, so that no start is the first, and where symbols meet; an edge over two of them takes the bound between."""
        at = F.array_position(bounds, edge["start"]).cast("int")
        return F.when(F.get(bounds, at + 1) == edge["end"], F.array_remove(bounds, F.get(bounds, at))).otherwise(bounds)

    left = listed.select(word, "edges", F.aggregate("edges", F.sequence(F.lit(-1), F.length(word)), fold).alias("bounds"))
    own = F.filter("edges", lambda e: F.get("bounds", F.array_position("bounds", e["start"]).cast("int")) == e["end"])
    return left.select(word, F.sort_array(F.transform(own, lambda e: F.struct(e["start"].alias("start"), e["id"].alias("id")))).alias("_path"))


def encode_words(words: DataFrame, model: Pieces, word: str = "word", merges: bool = False) -> DataFrame:
    """(word, ids) of the distinct ``words`` of at most LONG_WORD characters: the path through the lattice of pieces of each, by merge order
    or the best one."""
    table = F.broadcast(piece_table(words.sparkSession, model, merges))
    length = F.length(word)
    spans = (
        # A filter on the length would be moved below the grouping that makes ``words``, and that would run twice.
        words.filter(F.col(word) != "").select(word, F.explode(F.when(length <= LONG_WORD, F.sequence(F.lit(0), length - 1))).alias("start"))
        .select(word, "start", F.explode(F.sequence(
            F.col("start") + 1, F.least(F.col("start") + model.longest, length))).alias("end"))
        .withColumn("part", F.substring(F.col(word), F.col("start") + 1, F.col("end") - F.col("start")))
    )
    edges = (
        # One long as the key; the comparison of the strings is written so that it does not become part of it.
        spans.join(table, (F.xxhash64("part") == F.col("key")) & (F.col("part") >= F.col("piece")) & (F.col("part") <= F.col("piece")), "left")
        # A character without a piece is an edge of its own.
        .filter(F.col("id").isNotNull() | (F.col("end") - F.col("start") == 1))
    )
    paths = merged(edges, word) if merges else best_sum(edges, model, word)
    # Bytes of a character without a piece, from its hexadecimal form; or the unknown id.
    hexes = lambda e: F.hex(F.encode(F.substring(F.col(word), e["start"] + 1, F.lit(1)), "UTF-8"))
    spelled = lambda e: (F.transform(
        F.sequence(F.lit(0), F.octet_length(F.substring(F.col(word), e["start"] + 1, F.lit(1))) - 1),
        lambda i: F.conv(F.substring(hexes(e), (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + model.bytes_from)
        if model.bytes_from >= 0 else F.array(F.lit(model.unknown)))
    return paths.select(word, F.when(
        F.exists("_path", lambda e: e["id"].isNull()),
        F.flatten(F.transform("_path", lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(spelled(e)))),
    ).otherwise(F.col("_path.id")).alias("ids"))


# --- documents -------------------------------------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number, slice) of the input of a task, by bytes of text; the number names partition and slice."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << (PART_SHIFT - BLOCK_SHIFT)
    for batch in batches:
        to = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(batch):
            base = int(to[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(to, base + BLOCK_BYTES, "right")))
            yield number, batch.slice(first, last - first)
            first, number = last, number + 1


def _coded(texts: pa.Array, model: Pieces) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words of a block, numbers of the words in order, first word of each text and the end)."""
    gc.disable()
    try:
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE_MARK))
        odd = pc.and_(odd, pc.not_equal(texts, ""))
        some = texts.filter(odd)
        if len(some):
            # Of a run of spaces the first one cuts; the others stay as marks in front of what follows.
            marked = pc.binary_join_element_wise(SPACE_MARK, pc.replace_substring(some, " ", SPACE_MARK), "")
            runs = pc.replace_substring_regex(marked, f"{SPACE_MARK}({SPACE_MARK}*)", r" \1")
            texts = pc.replace_with_mask(texts, odd, pc.utf8_slice_codeunits(runs, 1))
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        del lists
        at, chunks = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        del coded
        parts = list(map(model.atoms, chunks))
        del chunks
        sizes = np.fromiter(map(len, parts), np.int32, len(parts))
        numbers = dict.fromkeys(chain.from_iterable(parts))
        numbers.update(zip(list(numbers), range(len(numbers)), strict=True))
        of_chunk = np.fromiter(map(numbers.__getitem__, chain.from_iterable(parts)), np.int32, int(sizes.sum()))
        del parts
    finally:
        gc.enable()
    # The numbers of a block fit 32 bits, as its bytes do; what takes 64 on the way is made for CODE_STEP chunks at a time.
    firsts = np.cumsum(sizes) - sizes
    to = np.zeros(len(at) + 1, np.int32)
    np.cumsum(sizes[at], out=to[1:])
    codes = np.empty(int(to[-1]), np.int32)
    for i in range(0, len(at), CODE_STEP):
        step = at[i : i + CODE_STEP]
        codes[to[i] : to[i + len(step)]] = of_chunk[_spread(firsts[step], sizes[step])]
    ends = to[bounds - bounds[0]].astype(np.int64)
    del at, to, of_chunk
    # The empty text has no pieces, though it splits into one empty chunk.
    empty = np.flatnonzero(pc.equal(texts, "").to_numpy(zero_copy_only=False))
    if len(empty):
        keep = np.ones(len(codes), bool)
        for i in empty:
            keep[ends[i] : ends[i + 1]] = False
        ends = np.concatenate(([0], np.cumsum(np.add.reduceat(keep, ends[:-1]) * (np.diff(ends) > 0))))
        codes = codes[keep]
    # The most frequent words get the smallest numbers, which pack best.
    names = list(numbers)
    del numbers
    counts = np.zeros(len(names), np.int64)
    for i in range(0, len(codes), CODE_STEP):
        counts += np.bincount(codes[i : i + CODE_STEP], minlength=len(names))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    for i in range(0, len(codes), CODE_STEP):
        codes[i : i + CODE_STEP] = rank[codes[i : i + CODE_STEP]]
    return [names[i] for i in order.tolist()], codes, ends


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2^32 by byte planes, without the planes that are 0, compressed."""
    import zstandard

    parts = []
    for a in arrays:
        planes = a.astype("<u4").view(np.uint8).reshape(-1, 4).T
        used = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        parts += [bytes([used]), planes[:used].tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes, *sizes: int) -> list[np.ndarray]:
    import zstandard

    plain, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for n in sizes:
        used = plain[at]
        planes = np.zeros((4, n), np.uint8)
        planes[:used] = np.frombuffer(plain, np.uint8, used * n, at + 1).reshape(used, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 1 + used * n
    return out


def _words(path: str, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for number, batch in _blocks(batches, column):
            words, _, _ = _coded(batch.column(column), model)
            pa.default_memory_pool().release_unused()
            refs = (np.int64(number) << BLOCK_SHIFT) + np.arange(len(words))
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.string()), pa.array(refs[i : i + 50_000])], ["word", "ref"])
    return run


def _documents(path: str, column: int):
    """(block, number in it, other columns..., CRC-32 of the text, number of words, codes) per document; the first one of a block has the codes of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for number, batch in _blocks(batches, column):
            texts = batch.column(column)
            codes, ends = _coded(texts, model)[1:]
            pa.default_memory_pool().release_unused()
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number, np.int64)), pa.array(np.arange(n), pa.int64()), *batch.columns[:column],
                 pa.array([zlib.crc32(t.as_buffer()) for t in texts], pa.int64()), pa.array(np.diff(ends), pa.int64()),
                 pa.array([_packed(codes), *[None] * (n - 1)], pa.binary())],
                ["_block", "_row", *[f"_own{i}" for i in range(column)], "_crc", "_n", "_codes"])
    return run


def _back(path: str, merges: bool):
    """(word, refs, ids) to one packed row per block and PACKED_REFS references: numbers of words, numbers of ids, ids.

    Words that were too long for the lattice come without ids and get them here.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            refs, ids = batch.column("refs"), batch.column("ids")
            if ids.null_count:
                model = pieces_of(path)
                spell = model.merge if merges else model.search
                ids = pa.array([spell(w) if x is None else x for w, x in zip(
                    batch.column("word").to_pylist(), ids.to_pylist(), strict=True)], pa.list_(pa.int32()))
            counts, lengths = np.diff(refs.offsets.to_numpy()), np.diff(ids.offsets.to_numpy())
            word = np.repeat(np.arange(len(batch)), counts)
            starts = np.cumsum(lengths) - lengths
            held.append((refs.flatten().to_numpy(), starts[word], lengths[word].astype(np.int64), ids.flatten().to_numpy()))
            size += len(word)
            if size >= PACKED_REFS:
                yield _packed_rows(held)
                held, size = [], 0
        if size:
            yield _packed_rows(held)
    return run


def _packed_rows(held: list) -> pa.RecordBatch:
    refs = np.concatenate([r for r, _, _, _ in held])
    flat = np.concatenate([f for _, _, _, f in held])
    shifts = np.cumsum([0, *(len(f) for _, _, _, f in held[:-1])])
    starts = np.concatenate([s + shift for (_, s, _, _), shift in zip(held, shifts, strict=True)])
    lengths = np.concatenate([n for _, _, n, _ in held])
    order = np.argsort(refs, kind="stable")
    refs, starts, lengths = refs[order], starts[order], lengths[order]
    blocks = refs >> BLOCK_SHIFT
    local = refs & ((1 << BLOCK_SHIFT) - 1)
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(refs)]
    out = []
    for a, b in pairwise(cuts):
        ids = flat[_spread(starts[a:b], lengths[a:b])]
        out.append((int(blocks[a]), b - a, len(ids), _packed(np.diff(local[a:b], prepend=0), lengths[a:b], ids)))
    return pa.RecordBatch.from_arrays(
        [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
        ["_block", "words", "pieces", "packed"])


def _assemble(path: str, names: list[str]):
    def run(docs, words):
        model = pieces_of(path)
        docs = docs.combine_chunks()
        docs = docs.take(pa.array(np.argsort(docs["_row"].to_numpy(), kind="stable")))
        parts = [(n, *_unpacked(data, n, n, m)) for n, m, data in zip(
            words["words"].to_pylist(), words["pieces"].to_pylist(), words["packed"].to_pylist(), strict=True)]
        local = np.concatenate([np.cumsum(x[1].astype(np.int64)) for x in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(local, kind="stable")
        if not (local[order] == np.arange(len(order))).all():
            raise ValueError("the input was not read alike twice; write it to a table first")
        lengths = np.concatenate([x[2].astype(np.int64) for x in parts]) if parts else local
        flat = np.concatenate([x[3] for x in parts]) if parts else np.zeros(0, np.uint32)
        del parts
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        sizes = docs["_n"].to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        codes, = _unpacked(docs["_codes"][0].as_py(), int(ends[-1]))
        counts, ids, same = [], [], []
        for a, b, crc in zip(ends[:-1].tolist(), ends[1:].tolist(), docs["_crc"].to_pylist(), strict=True):
            at = codes[a:b]
            own = flat[_spread(starts[at], lengths[at])].astype("<u4")
            counts.append(len(own))
            ids.append(own.tobytes())
            same.append(zlib.crc32(model.decode(own)) == crc)
        return pa.table({**{c: docs[f"_own{i}"] for i, c in enumerate(names)}, "n_pieces": pa.array(counts, pa.int64()),
                         "ids": pa.array(ids, pa.binary()), "round_trip": pa.array(same, pa.bool_())})
    return run


def encode(docs: DataFrame, path: str, text: str = "text", merges: bool = False) -> DataFrame:
    """``docs`` without ``text``, with n_pieces, ids (little-endian unsigned 32-bit integers) and round_trip.

    ``merges`` is for BPE models: pieces by merge order, as SentencePiece encodes with them. Without it they are those of the best sum of scores.

    ``round_trip`` says whether decoding the ids gives the text back; it does for all texts but those with the space
    mark itself, which reads as a space. A null text counts as empty and has no ids. Rows do not depend on each other; repeated rows
    come as often as they do. Columns named like a result are replaced.
    """
    own = [c for c in docs.columns if c not in (text, "n_pieces", "ids", "round_trip")]
    model = pieces_of(path)
    # Both passes read the same columns, so their Arrow batches, and with them the blocks, are the same.
    # Numbered names on the way: a column of the caller may have any name.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(own)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    at = len(own)
    # One reference per block that has the word.
    # Many partitions: a task should sort the edges of its words in memory.
    many = max(rows.rdd.getNumPartitions() * WORD_TASKS, 8)
    words = rows.mapInArrow(_words(path, at), "word string, ref bigint").filter("word <> ''").repartition(many, "word").groupBy("word").agg(
        F.collect_list("ref").alias("refs")).filter(F.size("refs") > 0)  # kept in both uses below, so that they share one exchange
    coded = words.join(encode_words(words.select("word"), model, merges=merges), "word", "left")
    # A word is asked for only where it got no ids.
    asked = coded.select(F.when(F.col("ids").isNull(), F.col("word")).alias("word"), "refs", "ids")
    local = asked.mapInArrow(_back(path, merges), "_block bigint, words bigint, pieces bigint, packed binary")
    inner = ", ".join(["_block bigint, _row bigint", *[f"_own{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1])],
                       "_crc bigint, _n bigint, _codes binary"])
    blocks = rows.mapInArrow(_documents(path, at), inner)
    fields = [*[f"`{c}` {f.dataType.simpleString()}" for c, f in zip(own, rows.schema.fields[:-1], strict=True)],
              "n_pieces bigint, ids binary, round_trip boolean"]
    return blocks.groupBy("_block").cogroup(local.groupBy("_block")).applyInArrow(_assemble(path, own), ", ".join(fields))


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the texts of its ids; null for null. Bytes that are no UTF-8 become replacement characters."""
    @F.pandas_udf("string")
    def run(column):
        model = pieces_of(path)
        return column.map(lambda x: None if x is None else model.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace"))

    return coded.withColumn(text, run(F.col(ids)))
