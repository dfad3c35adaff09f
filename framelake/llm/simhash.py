"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is 64 majority votes over the hashes of its features. Every
bit position gets a vector of ``radius + 1`` bits; table ``v`` compares the
positions whose vector has an odd inner product with ``v``. The positions in
which two fingerprints differ span at most ``radius`` dimensions, so some ``v``
is orthogonal to all of them: within the radius, every pair meets in a table.

Equal fingerprints become one class first. A bucket with more classes than
``BUCKET`` is dealt again by masks of another assignment of vectors, joined to
the bits already compared; the guarantee holds for these as well, and each level
about halves the bits that are left free, so buckets shrink to a bounded number
of distinct values. No bucket is cut short. Only links that connect a bucket's
members leave it, fewer than it has members.

Fingerprints are those of word shingles (the contract of the query). In the pipeline's
near-dedup at a given similarity the links of these fingerprints are candidates, beside
min-hash bands for what differs in more bits than the radius; the shingles themselves
decide, see ``shingles``. The sketches of ``word_fingerprint`` decide nothing there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted, small_batches, staged
from .components import connected_components
from .shingles import near_copies

BITS = 64
#: Classes that one task compares with each other (some hundred kilobytes).
BUCKET = 8_192
#: Levels of masks before a bucket is taken as it is; by then its classes agree in almost all bits.
LEVELS = 6
SEED = 42


def _majority(hashes: np.ndarray) -> bytes:
    """Bits set in over half of the hashes; ``hashes`` is uint8 of shape (n, bytes)."""
    votes = np.zeros(hashes.shape[1] * 8, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[start : start + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def _shingles(words: list[bytes], width: int):
    if len(words) <= width:
        return [b" ".join(words)]
    return map(b" ".join, zip(*[words[i:] for i in range(width)]))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _votes64(features, seed: int) -> int:
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(f, seed) for f in features), dtype=np.uint64).astype(">u8")
    return int.from_bytes(_majority(hashes.view(np.uint8).reshape(-1, 8)), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included.

    A-Z is lower-cased. Fewer words than ``width`` make one shingle of all; no
    word, or a null text, gives zero.
    """
    words = _words(text)
    return _votes64(_shingles(words, width), seed) if words else 0


def word_fingerprint(text: str | None, width: int = 5, seed: int = SEED) -> tuple[int, int, int]:
    """Majority bits over the distinct words, and a sketch of the word shingles in two
    64-bit halves; zeros for a text without words."""
    words = _words(text)
    if not words:
        return 0, 0, 0
    digest = xxhash.xxh3_128_digest
    sketch = _majority(np.frombuffer(b"".join([digest(s, seed) for s in _shingles(words, width)]), np.uint8).reshape(-1, 16))
    return _votes64(set(words), seed), int.from_bytes(sketch[:8], "big"), int.from_bytes(sketch[8:], "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, words: bool = False) -> DataFrame:
    """``doc_id, fp, s0, s1`` (signed longs) for every row: shingle fingerprints with
    empty sketches, or with ``words`` those of ``word_fingerprint``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            rows = [word_fingerprint(t, width) if words else (fingerprint(t, width), 0, 0) for t in texts]
            parts = [pa.array([_signed(r[k]) for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], ["doc_id", "fp", "s0", "s1"])

    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long, s0 long, s1 long")


def masks(radius: int, level: int = 0) -> list[int]:
    """The covering masks; every level assigns the vectors to positions anew."""
    vectors = (1 << (radius + 1)) - 1
    turn, shift = (1, 29, 45, 11, 51, 23, 7, 37)[level % 8], 13 * level
    code = [(i * turn + shift) % BITS % vectors + 1 for i in range(BITS)]
    return [sum(1 << p for p in range(BITS) if (code[p] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _spanning(radius: int, sketch_bits: int):
    """Links that connect what lies within the radius, fewer than a bucket has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members in batch.column(0):
                flat = members.values
                table = np.array(sorted(zip(*[flat.field(n).to_pylist() for n in ("rep", "fp", "s0", "s1")])), dtype=np.int64)
                rep, (fp, s0, s1) = table[:, 0], table[:, 1:].T.copy().view(np.uint64)
                group = np.arange(len(rep))
                groups = len(rep)
                for i in range(len(rep) - 1):
                    if groups == 1:
                        break
                    near = np.flatnonzero((np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) & (group[i + 1 :] != group[i])) + i + 1
                    if len(near) and sketch_bits < 128:
                        apart = np.bitwise_count(s0[near] ^ s0[i]).astype(int) + np.bitwise_count(s1[near] ^ s1[i])
                        near = near[apart <= sketch_bits]
                    while len(near):
                        j = near[0]
                        left.append(int(rep[i]))
                        right.append(int(rep[j]))
                        group[group == group[j]] = group[i]
                        groups -= 1
                        near = near[group[near] != group[i]]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def links(classes: DataFrame, radius: int, bucket: int = BUCKET, sketch_bits: int = 128) -> DataFrame:
    """``a, b``: links between classes (``fp, rep, s0, s1``) that differ in ``radius`` bits
    at most, and in ``sketch_bits`` of their sketches; enough to connect all that are
    connected."""
    found = None
    rows = classes.select(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("mask"), "fp", "rep", "s0", "s1")
    for level in range(LEVELS):
        choices = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks(radius, level))])
        dealt = rows.select("t", "mask", "fp", "rep", "s0", "s1", F.explode(choices).alias("c"))
        mask = F.col("mask").bitwiseOR(F.col("c.m"))
        dealt = dealt.select(
            (F.col("t") * (1 << (radius + 1)) + F.col("c.k")).alias("t"), mask.alias("mask"),
            F.col("fp").bitwiseAND(mask).alias("key"), "fp", "rep", "s0", "s1",
        )
        counts = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = staged(dealt.join(counts, ["t", "key"]), f"simhash-level{level}")
        small = shared if level == LEVELS - 1 else shared.where(F.col("n") <= bucket)
        groups = small.groupBy("t", "key").agg(F.collect_list(F.struct("fp", "rep", "s0", "s1")).alias("members"))
        some = groups.select("members").mapInArrow(_spanning(radius, sketch_bits), "a long, b long")
        found = some if found is None else found.unionByName(some)
        large = shared.where(F.col("n") > bucket)
        if level == LEVELS - 1 or large.isEmpty():
            break
        rows = large.select("t", "mask", "fp", "rep", "s0", "s1")
    return found


def print_links(prints: DataFrame, radius: int) -> DataFrame:
    """``a, b``: values of ``fp`` that ``prints`` (``print, fp``) has with fingerprints of at most
    ``radius`` differing bits; enough to connect all that are connected."""
    own = prints.distinct()
    first = staged(own.groupBy("print").agg(F.min("fp").alias("rep")), "print-classes")
    # one way to join at every size: fingerprints grow with the documents
    same = own.join(first.hint("merge"), "print").where("fp != rep").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    none = F.lit(0).cast("long")
    return links(first.select(F.col("print").alias("fp"), "rep", none.alias("s0"), none.alias("s1")), radius).unionByName(same)


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 3,
    radius: int = 2,
    similarity: float | None = None,
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Documents link when their fingerprints differ in ``radius`` bits at most;
    ``component_id`` is the smallest id reachable. With ``similarity``, documents
    link when the Jaccard similarity of their distinct ``width``-word shingles
    reaches it (``shingles.near_copies``): ``fp`` tells sets of shingles apart, and
    those whose three-word fingerprints lie within the radius are candidates, as are
    those that share min-hash bands. Null and empty texts are one fingerprint and link like
    others; repeated rows come out as often as they go in; a row without an id
    keeps the component of its fingerprint.
    """
    if similarity is not None:
        return near_copies(
            docs, doc_id=doc_id, text=text, width=width, similarity=similarity,
            fingerprint=fingerprint, print_links=lambda prints: print_links(prints, radius),
        )
    prints = staged(fingerprints(docs, doc_id=doc_id, text=text, width=width), "fingerprints")
    return component_ids(prints, radius)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group (the one with the smallest id), with its own columns.

    Of rows that share that id, those with the same text are one document and one
    stays; rows without an id stay. A null text is an empty one. Very long texts are
    compared whole. Other columns pass through, whatever their names; an empty table
    stays empty."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    roots = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_stay")).agg(F.count("*").alias("n"))
    roots = staged(roots, "near-stay")
    whole = packed(docs, _id=F.col(quoted(doc_id)).cast("long"))
    # both branches read one shuffle of the rows, at every size of the survivors' ids
    stay = whole.join(roots.hint("merge"), F.col("_id") == F.col("_stay"))
    once = stay.where("n = 1").select("_doc")
    # texts are compared only where an id is there more than once
    more = stay.where("n > 1").withColumn("_text", F.col("_doc." + quoted(text)))
    more = more.dropDuplicates(["_id", "_text"]).select("_doc")
    return once.unionByName(more).unionByName(whole.where("_id IS NULL").select("_doc")).select("_doc.*")


def component_ids(prints: DataFrame, radius: int, sketch_bits: int = 128) -> DataFrame:
    """``doc_id, fp, component_id`` from ``doc_id, fp, s0, s1``. A class has the sketch of
    its smallest id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "s0", "s1")).alias("m")
    classes = staged(prints.groupBy("fp").agg(first).select("fp", F.col("m.doc_id").alias("rep"), "m.s0", "m.s1"), "classes")
    near = links(classes.where("rep is not null"), radius, sketch_bits=sketch_bits)
    roots = connected_components(near)
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
