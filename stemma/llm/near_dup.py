"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles, and its sketch ``T_SIZE`` minwise tokens of that set.
Documents with equal sets are one node of the search from the start.  Independent trees branch them:
a root picks coordinates of the sketch, and documents with the same minwise token there fall into the
same child.  A small child is compared exhaustively, first by one bit of every token and then on full sets; a
large one branches again, on coordinates each picked with probability 1 / (threshold * T_SIZE).
Pairs at the threshold meet in at least one root child but for a chance of (1 - threshold) ** ``ROOTS``.

Trees grow level by level.  After each level confirmed links are joined to components, and a child
whose documents are in one component already is skipped, so a large group of copies isn't compared
over and over.  A child reports links as a forest, never all of its pairs.

Defined results: a null text, and one without words, has an empty set and is linked with nothing;
with fewer words than a shingle the whole sequence is one; a row with a null id has the greatest id,
takes the component of the documents it equals or is linked to, and null where none of them has an
id, in which case it is kept; equal ids are separate rows.  Repeated rows each have their own; an empty table gives no rows; other columns are ignored, whatever
their names.  A text above 1 MB is a slice of its own, which takes about 60 bytes of memory a letter; all of its shingles count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _superkmers as sk
from . import _text
from ._components import connected_components
from ._spark import prepare, stored

SHINGLE = 5
T_SIZE = 64
ROOTS = 16  # trees; the root of each picks a coordinate of its own
SMALL_DOCS, SMALL_SHINGLES = 2048, 1_500_000  # a child within both is compared exhaustively
MAX_LEVEL = 24
GROUP_BYTES = 4 << 20
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, T_SIZE, dtype=np.uint64) | np.uint64(1)
_SALTS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, in the order of both."""
    words = _text.Words(data, offsets)
    codes = words.hashes(lower=True)
    begin, rows = words.windows(size)
    sums = _text.prefix_sums(codes)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    hashes = np.concatenate([_text.span_hash(sums, begin, begin + size), _text.span_hash(sums, words.first[short], words.first[short + 1])])
    rows = np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def sketched(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """_id, _h, n, one, two, bits, sketch of each row: the size of its set, two unrelated hashes of the whole set, its minwise tokens and their last bits."""
    names = ["_id", "_h", "n", "one", "two", "bits", "sketch"]

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in _text.slices(b.column(2), 1 << 19):
                rows, hashes = shingles(data, offsets, size)
                n = np.bincount(rows, minlength=hi - lo)
                full = np.flatnonzero(n)
                whole, sketch = np.zeros((2, hi - lo), np.uint64), np.zeros((hi - lo, T_SIZE), np.uint32)
                if len(full):
                    at = (np.cumsum(n) - n)[full]
                    for k, salt in enumerate(_SALTS):
                        whole[k, full] = _text.mix(np.add.reduceat(_text.mix(hashes ^ salt), at))
                    for i, seed in enumerate(_SEEDS):
                        x = hashes * seed
                        x ^= x >> np.uint64(32)
                        x *= seed
                        sketch[full, i] = np.minimum.reduceat(x, at) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:2]), pa.array(n.astype(np.int64)), *(pa.array(w.view(np.int64)) for w in whole), pa.array(np.packbits(sketch & 1, axis=1).view(np.int64).ravel()), _text.binary([s.tobytes() for s in sketch])], names)

    return docs.select("_id", "_h", "_text").mapInArrow(run, "_id long, _h long, n long, one long, two long, bits long, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, T_SIZE)


def child(key: np.ndarray, coordinate: int, token: np.ndarray) -> np.ndarray:
    return _text.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64((coordinate + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)) + token.astype(np.uint64))


ROWS = "key long, node long, n long, bits long"


def roots(nodes: DataFrame) -> DataFrame:
    """key, node, n, bits: every node's child under each tree's root."""

    def run(batches):
        for b in batches:
            sketch = _sketches(b.column(3))
            for i in range(ROOTS):
                yield pa.RecordBatch.from_arrays([pa.array(child(np.full(len(sketch), i, np.uint64), i, sketch[:, i]).view(np.int64)), *b.columns[:3]], ["key", "node", "n", "bits"])

    return nodes.select("node", "n", "bits", "sketch").mapInArrow(run, ROWS)


def branches(members: DataFrame, threshold: float) -> DataFrame:
    """key, node, n, bits: the children of large nodes (key, node, n, bits, sketch); a node's key picks their coordinates."""
    chance = np.uint64(int((1 << 32) / (threshold * T_SIZE)))

    def run(batches):
        for b in batches:
            key, sketch = b.column(0).to_numpy().view(np.uint64), _sketches(b.column(4))
            certain = (_text.mix(key) % np.uint64(T_SIZE)).astype(np.int64)
            for i in range(T_SIZE):
                picked = (_text.mix(key + np.uint64((i + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) >> np.uint64(32) < chance) | (certain == i)
                at = np.flatnonzero(picked)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(child(key[at], i, sketch[at, i]).view(np.int64)), *(b.column(k).take(pa.array(at)) for k in (1, 2, 3))], ["key", "node", "n", "bits"])

    return members.select("key", "node", "n", "bits", "sketch").mapInArrow(run, ROWS)


def parted(keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the children that are compared exhaustively, stored rows of the large ones or None).

    Sizes are counted first, with partial sums, so that no large child's rows meet in a task.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"))
    big = stored(sizes.where((F.col("docs") > SMALL_DOCS) | (F.col("docs") > 2) & (F.col("weight") > SMALL_SHINGLES)).select("key"), "big")
    if big.isEmpty():
        return keys, None
    return keys.join(big, "key", "left_anti"), stored(keys.join(big, "key"), "large")


def children(keys: DataFrame, threshold: float) -> DataFrame:
    """key, members: the parts of every child that may hold links; a task holds one child at a time."""

    def close(held):
        node, n, bits = (np.concatenate(x) for x in zip(*held, strict=True))
        node, first = np.unique(node, return_index=True)
        if len(node) < 2:
            return []
        label = components(alike(bits[first].view(np.uint64), n[first], threshold))
        parts = np.split(np.argsort(label, kind="stable"), np.flatnonzero(np.diff(np.sort(label))) + 1)
        return [node[p].tolist() for p in parts if len(p) > 1]

    def run(batches):
        held_key, held, count, out = None, [], 0, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], ["key", "members"])

        for b in batches:
            key, node, n, bits = (c.to_numpy() for c in b.columns)
            out = []
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            for s, e, k in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist(), key[cuts].tolist(), strict=True):
                if k != held_key:
                    if count > 1:
                        out += [(held_key, p) for p in close(held)]
                    held_key, held, count = k, [], 0
                held.append((node[s:e], n[s:e], bits[s:e]))
                count += e - s
            if out:
                yield made()
        out = [(held_key, p) for p in close(held)] if count > 1 else []
        if out:
            yield made()

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, members array<long>")


def clusters(found: DataFrame) -> DataFrame:
    """cluster, node: the parts in ``found``, each distinct set of members once."""
    return found.groupBy("members").agg(F.count("*")).select(F.xxhash64("members").alias("cluster"), F.explode("members").alias("node"))


STRIP = 256  # rows of a matrix of pairs that are worked on at once


def strips(n: int) -> list[slice]:
    return [slice(k, min(n, k + STRIP)) for k in range(0, n, STRIP)]


def components(linked: np.ndarray) -> np.ndarray:
    """The least index that each index of a symmetric matrix reaches."""
    label = np.arange(len(linked), dtype=np.int32)
    while True:
        near = np.concatenate([np.where(linked[part], label, np.int32(len(linked))).min(1) for part in strips(len(linked))])
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def alike(bits: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that may reach the threshold: sizes near enough, and bits that agree as often as half of the rest would by chance.

    The bound is six standard deviations below what a pair at the threshold is expected to share.
    """
    share = (1 + threshold) / 2
    least = int(T_SIZE * share - 6 * np.sqrt(T_SIZE * share * (1 - share)))
    out = np.empty((len(n), len(n)), bool)
    for part in strips(len(n)):
        equal = T_SIZE - np.bitwise_count(bits[part, None] ^ bits[None])
        out[part] = (equal >= least) & (np.minimum(n[part, None], n[None]) >= threshold * np.maximum(n[part, None], n[None]))
    return out


def shared_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, which single precision holds exactly."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    keep = count[column] > 1
    column, row = column[keep], row[keep]
    used, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out, width = np.zeros((n, n), np.float32), 1024
    for s in range(0, len(used), width):
        lo, hi = np.searchsorted(column, [s, s + width])
        x = np.zeros((n, min(width, len(used) - s)), np.float32)
        x[row[lo:hi], column[lo:hi] - s] = 1
        out += x @ x.T
    return out


def linked_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of full sets reach the threshold."""
    size, both = np.array([len(s) for s in sets], float), shared_sizes(sets)
    out = np.empty(both.shape, bool)
    for part in strips(len(sets)):
        union = size[part, None] + size[None] - both[part]
        out[part] = 100.0 * both[part] >= 100 * threshold * union - 1e-6
    return out


def _grouped(rows: DataFrame, size: int, run, schema: str) -> DataFrame:
    """Applies ``run`` to each cluster of ``rows`` (cluster, node, ...), many clusters to a task's group."""
    groups = max(1, -(-size // GROUP_BYTES))

    def each(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cluster", "ascending"), ("node", "ascending")])
        cluster, node = group["cluster"].to_numpy(), group["node"].to_numpy()
        keep = np.ones(len(node), bool)
        keep[1:] = (cluster[1:] != cluster[:-1]) | (node[1:] != node[:-1])
        group = group.filter(pa.array(keep))
        cluster = cluster[keep]
        at = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
        return run(group, at, np.append(at[1:], len(cluster)))

    return rows.withColumn("_group", F.pmod("cluster", F.lit(groups))).groupBy("_group").applyInArrow(each, schema)


def links(found: DataFrame, sets: DataFrame, shingle_bytes: int, threshold: float) -> DataFrame:
    """a, b: a forest of confirmed links within each cluster."""

    def run(group, starts, ends):
        node, raw = group["node"].to_numpy(), group["members"].to_pylist()
        a, b = [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            parts = [np.frombuffer(x, np.uint64) for x in raw[s:e]]
            if len(parts) < 2:
                continue
            label = components(linked_sets(parts, threshold))
            other = np.flatnonzero(label != np.arange(len(label)))
            a += node[s:e][label[other]].tolist()
            b += node[s:e][other].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _grouped(found.join(sets, "node"), shingle_bytes, run, "a long, b long").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, members: the sorted full sets of the nodes in ``wanted`` (node, _id, _h), read from whole texts again."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in _text.slices(b.column(1)):
                rows, hashes = shingles(data, offsets, size)
                cuts = np.searchsorted(rows, np.arange(1, hi - lo))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), _text.binary([x.tobytes() for x in np.split(hashes, cuts)])], ["node", "members"])

    # a broadcast would be picked for small inputs only; texts meet their ids by a shuffle at every size
    return docs.join(wanted.hint("merge"), ["_id", "_h"]).select("node", "_text").mapInArrow(run, "node long, members binary")


def node_components(docs: DataFrame, nodes: DataFrame, *, size: int, threshold: float) -> DataFrame | None:
    """node, label of every node that is linked with another one; None if none is."""
    labels = edges = sets = large = None
    for level in range(MAX_LEVEL):
        if level:
            large = large if labels is None else impure(large, "key", labels)
            keys = branches(large.join(nodes.select("node", "sketch"), "node"), threshold)
        else:
            keys = roots(nodes)
        small, large = parted(stored(keys, "keys"))
        near = clusters(stored(children(small, threshold), "children"))
        if sets is None:  # later levels only part the nodes of large children, so texts are read this once
            wanted = near.select("node") if large is None else near.select("node").unionAll(large.select("node"))
            sets = stored(full_sets(docs, wanted.distinct().join(nodes, "node").select("node", "_id", "_h"), size), "sets")
        near = stored(near if labels is None else impure(near, "cluster", labels), "near")
        edges, labels = joined(near, nodes, sets, edges, labels, threshold)
        if large is None:
            return labels
    near = stored(blocks(large if labels is None else impure(large, "key", labels)), "near")
    return joined(near, nodes, sets, edges, labels, threshold)[1]


def joined(near: DataFrame, nodes: DataFrame, sets: DataFrame, edges: DataFrame | None, labels: DataFrame | None, threshold: float) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges and components with the links that the clusters ``near`` hold."""
    if near.isEmpty():
        return edges, labels
    total = near.join(nodes.select("node", "n"), "node").agg(F.sum(8 * F.col("n"))).first()[0]
    new = stored(links(near, sets, total, threshold), "links")
    edges = new if edges is None else edges.unionAll(new)
    return edges, connected_components(edges)


def impure(rows: DataFrame, group: str, labels: DataFrame) -> DataFrame:
    """The rows of the groups whose nodes aren't all in one component."""
    known = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy(group).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(group)
    return rows.join(mixed, group)


def blocks(large: DataFrame) -> DataFrame:
    """cluster, node: every pair of blocks of the children that no further level splits, so that none of their pairs is lost."""
    sizes = large.groupBy("key").agg(F.ceil(F.greatest(F.count("*") * 2 / SMALL_DOCS, F.sum("n") * 2 / SMALL_SHINGLES)).cast("int").alias("parts"))
    part = large.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return pairs.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cluster"), "node")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = 0.85) -> DataFrame:
    """id, n_shingles, component_id and kept of every row of ``docs``; text_hash tells rows of equal ids apart."""
    prepare(docs.sparkSession)
    source = sk.rows_of(docs, id_col, text_col)
    rows = stored(sketched(source, size), "sketches")
    # equal sets are one node, by its number; a set is known by its size and 128 bits
    same = rows.where("n > 0").groupBy("n", "one", "two").agg(F.min(F.struct("_id", "_h")).alias("at"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"))
    nodes = stored(same.select(F.monotonically_increasing_id().alias("node"), "at._id", "at._h", F.col("at._id").alias("rep"), "n", "one", "two", "bits", "sketch"), "nodes")
    labels = node_components(source, nodes, size=size, threshold=threshold)
    where = nodes.select("node", "n", "one", "two", "rep")
    if labels is not None:
        least = where.join(labels, "node").groupBy("label").agg(F.min("rep").alias("least"))
        moved = labels.join(least, "label").select("node", "least")
        where = where.join(moved, "node", "left").select("n", "one", "two", F.coalesce("least", "rep").alias("rep"))
    full = rows.where("n > 0").select("_id", "_h", "n", "one", "two").join(where.select("n", "one", "two", "rep"), ["n", "one", "two"]).select("_id", "_h", "n", "rep")
    all_rows = full.unionAll(rows.where("n = 0").select("_id", "_h", "n", F.col("_id").alias("rep")))
    real = lambda c: F.when(F.col(c) != sk.NO_ID, F.col(c))
    return all_rows.select(real("_id").alias(id_col), F.col("n").alias("n_shingles"), real("rep").alias("component_id"), (F.col("_id") == F.col("rep")).alias("kept"), F.col("_h").alias("text_hash"))
