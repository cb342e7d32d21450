"""Near-duplicate groups by SuperMinHash.

A text's set is its distinct k-word shingles, held as 64-bit digests. SuperMinHash (Ertl 2017) gives each
element a random permutation of the m registers and writes rank + uniform number into them in that order; each register keeps the
least. Ranks of one element are correlated (each register gets another one), which lowers the variance of the estimate
below that of independent hashes, and once all registers hold a value below rank j, no later
rank can change any: most texts stop after a few ranks.

1. Texts with equal sets form a class; only classes go on.
2. Bands of registers give buckets. In each bucket, all members are compared with its first one and with its hub, the
   member that shares most buckets (two pairs per member, whatever the size), confirmed on the full sets, and grouped by union-find.
3. In buckets that still hold several groups, the members outside of the largest group are compared with those of other
   groups, in tiles of bounded size: register agreement says which pairs can be similar enough at all, and those are
   confirmed on the full sets. Pairs within a group say nothing new and are never made.

So every pair that shares a bucket is either confirmed, known to be connected, or far from similar. With
50 bands of 6 registers a pair at the threshold of 0.8 misses all buckets with probability 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import WORD, written

BANDS, ROWS = 50, 6
TILE = 512
GROUP_BYTES = 8_000_000
#: Levels done by tracing swaps back; later ones (only short texts get there) by whole permutations.
TRACED = 24
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


# --- sets and signatures -----------------------------------------------------------------------

def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements of all texts, ascending within each; first element of each text, and the end)."""
    import xxhash

    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), r"[\t-\r]", " ")
    lists = pc.split_pattern(spaced, " ")
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    at = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if "" in names:
        keep = at != names.index("")
        at, row = at[keep], row[keep]
    words, n = hashes[at], np.bincount(row, minlength=len(texts))
    if len(words) == 0:
        return words, np.zeros(len(texts) + 1, np.int64)
    with np.errstate(over="ignore"):
        whole = n[row] >= k
        # Windows of k words inside a text, and the whole sequence of a shorter text at its first word.
        value, length = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        for i in range(k):
            same = np.zeros(len(words), bool)
            same[: len(words) - i] = row[i:] == row[: len(words) - i]
            step = _mix(value + GOLDEN)
            step[: len(words) - i] += words[i:]
            value = np.where(same, _mix(step), value)
            length += same
    first = np.ones(len(words), bool)
    first[1:] = row[1:] != row[:-1]
    keep = np.where(whole, length == k, first)
    value, row = value[keep], row[keep]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(texts)))))


def signatures(elements: np.ndarray, bounds: np.ndarray, m: int, most: int = 1 << 16) -> np.ndarray:
    """Registers (texts x m) of rank << 32 | uniform number; FULL for an empty set.

    Texts of like size are done together, about ``most`` elements at a time: small sets go through many ranks and
    hold a permutation per element, large ones are through after a few.
    """
    sizes = np.diff(bounds)
    order = np.argsort(sizes, kind="stable")
    registers = np.empty((len(sizes), m), np.uint64)
    to, first = np.cumsum(sizes[order]), 0
    while first < len(order):
        base = int(to[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(to, base + most, "right")))
        some = order[first:last]
        own = np.repeat(bounds[some] - (to[first:last] - sizes[some] - base), sizes[some]) + np.arange(int(to[last - 1]) - base)
        registers[some] = _registers(elements[own], np.concatenate(([0], to[first:last] - base)), m)
        first = last
    return registers


def _registers(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    rows = len(bounds) - 1
    registers = np.full((rows, m), FULL)
    flat = registers.reshape(-1)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    history: list[np.ndarray] = []
    order = None
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(elements):
                break
            random = _mix(elements + np.uint64(j + 1) * GOLDEN)
            swap = (((random & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int32) + np.int32(j)
            if j < TRACED:
                # What stands at position swap: follow the earlier swaps back.
                place = swap.copy()
                for i in range(j - 1, -1, -1):
                    place[history[i] == place] = i
                history.append(swap)
            else:
                if order is None:
                    order = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                    each = np.arange(len(elements))
                    for i, past in enumerate(history):
                        order[each, i], order[each, past] = order[each, past], order[each, i]
                    history = []
                each = np.arange(len(elements))
                place = order[each, swap].astype(np.int32)
                order[each, swap] = order[each, j]
                order[each, j] = place
            np.minimum.at(flat, row * m + place, (np.uint64(j) << np.uint64(32)) | (random >> np.uint64(32)))
            full = (registers != FULL).all(1)
            live = ~full[row]
            if not live.all():
                elements, row = elements[live], row[live]
                history = [h[live] for h in history]
                order = None if order is None else order[live]
    return registers


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = registers.reshape(len(registers), bands, rows)
        key = np.tile(np.arange(bands, dtype=np.uint64), (len(registers), 1))
        for i in range(rows):
            key = _mix(key * GOLDEN + parts[:, :, i])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on ascending sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def union_find(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the group of each) of pairs of nodes."""
    nodes, at = np.unique(pairs, return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in at.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return nodes, nodes[[find(x) for x in range(len(nodes))]] if len(nodes) else nodes


# --- the jobs ------------------------------------------------------------------------------------

def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    to = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(batch):
        base = int(to[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(to, base + GROUP_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in _slices(whole, 2):
                elements, bounds = shingle_sets(batch.column(2), k)
                registers = signatures(elements, bounds, bands * rows)
                keys = band_keys(registers, bands, rows)
                digests = [xxhash.xxh3_128_digest(elements[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                low = _mix(registers).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1))),
                    pa.array([x.tobytes() for x in low], pa.binary())], ["doc_id", "hash", "n", "digest", "keys", "registers"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                elements, bounds = shingle_sets(batch.column(1), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                    ["node", "elements"])
    return run


def _confirm(percent: int):
    """(a, b, set of a, set of b) -> the pairs that are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                    for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. Joins only, so a node with many pairs can be split."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("_y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "_x", "_y").mapInArrow(_confirm(percent), "a bigint, b bigint")


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task, batch by batch: (node, root) for all nodes but the roots."""
    kept = np.zeros((0, 2), np.int64)
    for batch in batches:
        own = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, roots = union_find(np.concatenate((kept, own)))
        kept = np.column_stack([nodes, roots])[nodes != roots]
    yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0], pa.int64()), pa.array(kept[:, 1], pa.int64())], ["a", "b"])


def groups(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, root the least node it is connected with.

    Union-find runs inside tasks first and leaves one link per node and task. Then each round gives a node the least
    root among itself and its neighbours and follows the root's own root, until nothing changes; only a count comes to
    the driver.
    """
    links = written(links.mapInArrow(_local_roots, "a bigint, b bigint").distinct(), "group-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b"))
                    .select("node", F.least("node", "_b").alias("root")), "group-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("_r")), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("_r").alias("_near"))
        lower = roots.join(near, "node").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("_new"))
        lower = written(lower, "group-lower")
        jump = lower.select(F.col("node").alias("_new"), F.col("_new").alias("_next"))
        roots = written(lower.join(jump, "_new").select(
            "node", F.least("_new", "_next").alias("root"), (F.least("_new", "_next") < F.col("_old")).alias("moved")), "group-roots")
        if not roots.filter("moved").limit(1).count():
            return roots.select("node", "root")


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets with 32 bits of each element: half the bytes for comparing; what is found is confirmed on the whole ones."""
    for batch in batches:
        low = [np.unique(np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint32)).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], ["node", "short"])


def _cross_tiles(percent: int, bands: int, m: int, spanning: bool):
    """Similar pairs of a tile's left rows with its right ones that lie in different groups.

    Register agreement says which pairs to compare; a pair with several buckets in common is looked at in the first of
    them only. With ``spanning``, a pair is given only if it connects groups that the tile's other pairs do not connect.
    """
    # Five standard deviations of the agreement of m independent registers below the threshold (SuperMinHash has less).
    share = percent / 100
    least = m * (share - 5 * (share * (1 - share) / m) ** 0.5)

    def run(table):
        table = table.combine_chunks()
        node, root, n, key = (table[c].to_numpy() for c in ("node", "root", "n", "key"))
        left, stray = (table[c].to_numpy(zero_copy_only=False) for c in ("left", "stray"))
        registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint8).reshape(len(table), m)
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(table), bands)
        sets = [np.frombuffer(x, np.uint32) for x in table["short"].to_pylist()]
        right, out = np.flatnonzero(~left), []
        parent = dict.fromkeys(root.tolist())

        def find(x):
            while parent[x] is not None:
                x = parent[x]
            return x

        for i in np.flatnonzero(left):
            # Strays meet each other from both sides.
            other = right[(root[right] != root[i]) & (~stray[right] | (node[right] > node[i]))]
            other = other[100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])]
            agree = (registers[other] == registers[i]).sum(1)
            other = other[agree >= least][np.argsort(-agree[agree >= least], kind="stable")]
            other = other[keys[i][(keys[other] == keys[i]).argmax(1)] == key[i]]
            for o in other.tolist():
                a, b = find(root[i]), find(root[o])
                if (a != b or not spanning) and similar(sets[i], sets[o], percent):
                    out.append((min(node[i], node[o]), max(node[i], node[o])))
                    if a != b:
                        parent[a] = b
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
    return run


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, tile: int = TILE
) -> DataFrame:
    """(doc_id, hash, n_shingles, class_id, component_id, kept, root) for every row of ``docs`` (doc_id, text).

    Texts are lower-cased in A-Z; words are runs of anything but ASCII white space; a text with fewer than
    ``shingle`` words is one shingle, one without words has none and is linked with nothing (component: its own doc_id).
    Sets link if 100 * intersection >= percent * union. ``class_id`` is the least doc_id with an equal set, ``component_id``
    the least doc_id that links lead to, ``kept`` says whether that is the row's own. ``hash`` is xxhash64 of the text,
    ``root`` a number of the component within this result (null without words).
    Rows with a null doc_id take part, but a null is no least id while there is another; a component of nulls only has
    a null id and kept false. Repeated rows are returned as often as they come.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("hash"), body.alias("text"))
    signed = narrow.mapInArrow(
        _sign(shingle, bands, rows), "doc_id bigint, hash bigint, n bigint, digest binary, keys array<bigint>, registers binary")
    # One pass over the texts; what it leaves is written once, with registers only for the first row of a set in each partition.
    signed = written(signed, "near-signed")
    classes = written(
        signed.filter("n > 0").groupBy("digest", "n").agg(
            F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("_rep"))
        .withColumn("node", F.monotonically_increasing_id())
        .select("node", "digest", "n", "class_id", F.col("_rep.doc_id").alias("doc_id"), F.col("_rep.hash").alias("hash")),
        "near-classes")
    sketches = written(
        classes.select("node", F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("n").alias("_n"))
        .join(signed.select("doc_id", "hash", "n", "keys", "registers"),
              F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
        .dropDuplicates(["node"]).select("node", "n", "keys", "registers"), "near-sketches")

    # A key names its band too.
    members = sketches.select("node", F.explode("keys").alias("key"))
    ends = written(
        members.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "near-buckets")
    buckets = written(members.join(ends, "key"), "near-members")
    # The member that meets the most others over all buckets: of a text and its edited copies, mostly the text itself.
    degree = buckets.groupBy("node").agg(F.sum("size").alias("_degree"))
    hubs = buckets.join(degree, "node").groupBy("key").agg(F.max(F.struct("_degree", "node")).alias("_hub"))
    pairs = written(
        buckets.join(hubs, "key").select(F.explode(F.array_distinct(F.array("first", "_hub.node"))).alias("a"), F.col("node").alias("b"))
        .filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")

    # The sets of the classes that share a bucket, from the texts of their first documents.
    needed = buckets.select("node").distinct().join(classes, "node").select("node", F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    sets = written(
        narrow.join(needed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
        .select("node", "text").mapInArrow(_sets(shingle), "node bigint, elements binary").dropDuplicates(["node"]), "near-sets")

    links = written(confirmed(pairs, sets, percent), "near-links")
    roots = groups(links)
    # Buckets with several groups: members outside of the largest one are strays, and meet all others.
    placed = written(
        buckets.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-placed")
    mixed = written(
        placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_n")).groupBy("key")
        .agg(F.max(F.struct("_n", "root")).alias("_most"), F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_roots"))
        .filter("_roots > 1").select(
            "key", F.col("_most.root").alias("_major"), F.ceil(F.col("_size") / tile).cast("int").alias("_all"),
            F.ceil((F.col("_size") - F.col("_most._n")) / tile).cast("int").alias("_strays")), "near-mixed")
    joined = placed.join(mixed, "key").withColumn("stray", F.col("root") != F.col("_major"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = joined.filter("stray").select("key", "node", "root", "stray", F.lit(True).alias("left"), place("_strays").alias("t1"), every("_all").alias("t2"))
    rights = joined.select("key", "node", "root", "stray", F.lit(False).alias("left"), place("_all").alias("t2"), every("_strays").alias("t1"))
    tiled = (
        lefts.unionByName(rights).join(sketches, "node").join(sets.mapInArrow(_short_sets, "node bigint, short binary"), "node")
        .select("key", "t1", "t2", "left", "stray", "node", "root", "n", "registers", "keys", "short").groupBy("key", "t1", "t2")
    )

    def across(spanning: bool) -> tuple[DataFrame, DataFrame]:
        found = written(tiled.applyInArrow(_cross_tiles(percent, bands, bands * rows, spanning), "a bigint, b bigint").distinct(), "near-crossed")
        return found, written(confirmed(found, sets, percent), "near-more")

    found, more = across(True)
    if found.count() != more.count():
        # 32 bits took a pair for similar that is not, and it may have stood for another one.
        _, more = across(False)
    roots = groups(written(links.unionByName(more), "near-all-links"))

    labelled = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("class_id").alias("component_id"))
    labels = written(labelled.join(least, "root").select("digest", "n", "class_id", "component_id", "root"), "near-labels")
    return (
        signed.select("doc_id", "hash", "n", "digest").join(labels, ["digest", "n"], "left")
        .withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "hash", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "root")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the least doc_id (nulls last, then by text digest).

    Rows without words are in no group and stay. Of rows equal in doc_id and text, one stays.
    """
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    row = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("hash").alias("h"))
    best = written(
        found.filter("n_shingles > 0").groupBy("root").agg(F.min(row).alias("_best"))
        .select(F.col("_best.d").alias("_d"), F.col("_best.h").alias("_h"))
        .unionByName(found.filter("n_shingles = 0").select(F.col("doc_id").alias("_d"), F.col("hash").alias("_h")).distinct()),
        "near-kept")
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    on = hashed["doc_id"].cast("long").eqNullSafe(best["_d"]) & (hashed["_hash"] == best["_h"])
    joined = hashed.join(best, on)
    empty = joined.filter(n_words_absent("text")).drop("_d", "_h", "_hash")
    return joined.filter(~n_words_absent("text")).dropDuplicates(["doc_id", "_hash"]).select(*docs.columns).unionByName(empty.select(*docs.columns))


def n_words_absent(text: str):
    return ~F.regexp_like(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD))
