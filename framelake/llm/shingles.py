"""Near copies by the exact Jaccard similarity of word shingles.

Texts with the same set of shingles are one class. Candidates are classes whose
fingerprints the covering masks link (``simhash.print_links``); for those that differ in
more bits than the masks' radius, min-hash bands: a band is ``ROWS`` least hashes of the set, and two sets of similarity s
share one of ``BANDS`` bands with probability 1 - (1 - s^ROWS)^BANDS, 0.99998 at
0.8. Classes that either connects are a loose group; all links lie inside such groups,
so every class is sent with its whole set to the tasks of its group only.

There, links are decided by the sets alone. A group of more than ``BLOCK`` shingles
is dealt into blocks and every pair of blocks is a task, so that no task grows with
its group. No group and no band is cut short. Shingles and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .components import connected_components

BANDS, ROWS = 36, 6
#: Shingles in a block of a loose group (four megabytes of hashes).
BLOCK = 1 << 19
SEED = 42
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles, A-Z lower-cased. Fewer
    words make one shingle of all; a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*[words[i:] for i in range(width)]))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, SEED) for p in parts), dtype=np.uint64))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes(), SEED)


def bands(found: np.ndarray) -> np.ndarray:
    """One key a band; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 4096):  # bounded memory for very long texts
        mixed = (found[start : start + 4096, None] ^ _MIX[0]) * _MIX[1]
        least = np.minimum(least, mixed.min(axis=0))
    least = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(least[k].tobytes(), k) for k in range(BANDS)], np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _keys(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([set_key(s) for s in sets], np.uint64).view(np.int64))


def _prints(width: int, fingerprint: Callable[[str | None], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(t, width) for t in texts]
            n = pa.array([len(s) for s in sets], pa.int64())
            prints = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), _keys(sets), n, _lists([bands(s) for s in sets]), prints], ["doc_id", "fp", "n", "bands", "print"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([_keys(sets), _lists(sets)], ["fp", "shingles"])

    return run


def linked(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of places whose Jaccard similarity reaches ``similarity``, enough to
    connect all that such pairs connect.

    A set is compared with all others. Those of the largest group found so far wait:
    once all sets outside it have been compared, no link to it is left to find."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(token.max() + 1, np.int64)
    group, done, found = np.arange(len(sets)), np.zeros(len(sets), bool), []
    while True:
        waiting = np.flatnonzero(~done & (group != np.bincount(group).argmax()))
        if not len(waiting):
            return found
        i = waiting[0]
        done[i] = True
        own = token[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[token], starts)
        mark[own] = 0
        for j in np.flatnonzero(shared / (sizes + sizes[i] - shared) >= similarity):
            if group[j] != group[i]:
                found.append((int(i), int(j)))
                group[group == group[j]] = group[i]


def _confirmed(similarity: float):
    def run(members: pa.Table) -> pa.Table:
        fp = members.column("fp").to_pylist()
        sets = [s.values.to_numpy().view(np.uint64) for s in members.column("shingles")]
        pairs = linked(sets, similarity)
        return pa.table({"a": pa.array([fp[i] for i, _ in pairs], pa.int64()), "b": pa.array([fp[j] for _, j in pairs], pa.int64())})

    return run


def _loose(classes: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``fp, root``: the classes that share bands with others or are linked by ``near``
    (``a, b``), and their groups."""
    keyed = classes.select("fp", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("k")).where("k > 1")
    stars = keyed.join(least, "key").where("fp != b").select(F.col("fp").alias("a"), "b")
    found = connected_components(stars if near is None else stars.unionByName(near))
    return found.select(F.col("node").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root").distinct())


def links(docs: DataFrame, classes: DataFrame, width: int, similarity: float, block: int = BLOCK, near: DataFrame | None = None) -> DataFrame:
    """``a, b``: classes (``fp, rep, n, bands``) of ``docs`` (``doc_id, text``) whose sets
    reach the similarity; enough to connect all that are connected. Candidates share
    bands or are linked by ``near`` (``a, b``)."""
    members = staged(_loose(classes, near).join(classes.select("fp", "rep", "n"), "fp"), "near-groups")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")).where("blocks > 1")
    dealt = members.join(F.broadcast(blocks), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k != own) | (F.col("blocks") == 1))
    dealt = dealt.select("fp", "root", own.alias("own"), F.explode(others).alias("other"))
    dealt = dealt.select("fp", "root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    # one way to join at every size: the ids of loose groups grow with the documents
    reps = members.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = docs.join(reps, "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(width), "fp long, shingles array<long>").dropDuplicates(["fp"])
    return dealt.join(sets, "fp").groupBy("root", "p", "q").applyInArrow(_confirmed(similarity), "a long, b long")


def near_copies(
    docs: DataFrame, *, doc_id: str, text: str, width: int, similarity: float,
    fingerprint: Callable[[str | None], int], print_links: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``; see ``simhash.near_duplicates``."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = chosen.mapInArrow(_prints(width, fingerprint), "doc_id long, fp long, n long, bands array<long>, print long")
    prints = staged(prints, "shingle-prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    near = print_links(prints.where("doc_id is not null AND n > 0").select("print", "fp"))
    roots = connected_components(links(chosen, classes.where("rep is not null"), width, similarity, near=near))
    named = classes.select("fp", "rep").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = staged(named.select("fp", "rep", F.coalesce("root", "fp").alias("root")), "near-roots")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.select("doc_id", "fp").join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
