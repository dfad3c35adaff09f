"""Benchmark decontamination by suffix arrays of the training text.

Each worker takes documents in *shards* of a few megabytes, turns their words into
numbers, and sorts the suffixes of the shard (prefix doubling). Every benchmark suffix
is binary-searched in that array, one word deeper at a time, down to the ``window``
words that make a hit, which gives all places where it occurs. From each such place
the match is followed on to its end, again by binary search, in the sorted suffixes of
the benchmark: the longest verbatim match of any item from there, with its location.
Words that no item has cannot be part of a match, so suffixes that start at them are
left out of the array.

The benchmark is split into blocks of bounded size, each broadcast by itself. A shard
passes the blocks one after the other, so a task holds one block at a time; documents
pass once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, quoted, small_batches, unpacked

#: Item words in a window.
WINDOW = 10
#: Bytes of benchmark text in a block, and of documents in a shard.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
#: Bytes of words stay (A-Z as a-z); all others separate words.
LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
NEW = {"_decon_words": "long", "_decon_spans": "array<struct<start:long,stop:long>>", "_decon_items": "array<string>", "_decon_longest": "long",
       "_decon_matches": "array<struct<start:long,words:long,item:string,item_start:long>>"}


def words(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return (text or b"").translate(LETTERS).split()


class Block:
    """Items of a benchmark as numbers: their windows, and their suffixes in order.
    ``plain`` and ``of`` turn it into plain data and back."""

    FIELDS = ("vocabulary", "tokens", "place", "length", "items", "order", "number", "names", "begins", "window")

    @classmethod
    def build(cls, items: list[tuple[str | None, bytes | None]], window: int) -> Block:
        self = cls()
        self.window, self.vocabulary = window, {}
        tokens: list[int] = [0]
        starts: dict[tuple, list] = {}  # distinct windows: [place, words, item ids]
        self.names, begins = [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            base = len(tokens)
            begins.append(base)
            self.names.append(item)
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                entry = starts.setdefault((*ids[k : k + window], len(ids) < window), [base + k, min(window, len(ids)), set()])
                if item is not None:
                    entry[2].add(item)
            tokens += ids + [0]
        self.tokens = np.array(tokens + [0], dtype=np.int32)
        self.place = np.array([e[0] for e in starts.values()], dtype=np.int64)
        self.length = np.array([e[1] for e in starts.values()], dtype=np.int64)
        self.items = [sorted(e[2]) for e in starts.values()]
        self.begins = np.array(begins, dtype=np.int64)
        self.number = np.cumsum(np.bincount(self.begins, minlength=len(self.tokens))) - 1 if begins else np.zeros(len(self.tokens), np.int64)
        ends = np.flatnonzero(self.tokens == 0)
        self.order = _suffix_array(self.tokens, int(np.diff(ends).max(initial=1)))
        return self

    def plain(self) -> dict:
        return {f: getattr(self, f) for f in self.FIELDS}

    @classmethod
    def of(cls, plain: dict) -> Block:
        self = cls()
        self.__dict__.update(plain)
        return self

    def search(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows in ``tokens`` (0 is no word): places, window numbers, the words
        that match from there, and a place in the benchmark where those stand."""
        none = np.empty(0, dtype=np.int64)
        solid = np.concatenate([[0], tokens != 0, [0]]).astype(np.int8)
        begin, end = np.flatnonzero(np.diff(solid) == 1), np.flatnonzero(np.diff(solid) == -1)
        if not len(self.place):
            return none, none, none, none
        long_enough = end - begin >= self.length.min()
        begin, end = begin[long_enough], end[long_enough]
        if not len(begin):
            return none, none, none, none
        sizes = end - begin
        # kept runs, each followed by one 0
        out_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        source = np.repeat(begin - out_start[:-1], sizes + 1) + np.arange(out_start[-1])
        kept = np.where(np.arange(out_start[-1]) == np.repeat(out_start[1:] - 1, sizes + 1), 0, tokens[np.minimum(source, len(tokens) - 1)])
        order = _suffix_array(kept, int(self.length.max()))
        depth, lo, hi = _descend(kept, order, self.tokens, self.place, self.length)
        number = np.where(depth == self.length, hi - lo, 0)
        which = np.repeat(np.arange(len(number)), number)
        at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(lo, number)
        place = order[at]
        # how far each place matches on, and where
        some, back = np.unique(place, return_inverse=True)
        reach, lo, _ = _descend(self.tokens, self.order, kept, some, out_start[np.searchsorted(out_start, some, side="right")] - 1 - some)
        return source[place], which, reach[back], self.order[np.minimum(lo, len(self.order) - 1)][back]


def _descend(array: np.ndarray, order: np.ndarray, tokens: np.ndarray, place: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words of the patterns ``tokens[place : place + room]`` stand in ``array``, whose
    sorted suffixes are ``order``, and the range of suffixes that begin with so many."""
    deepest = int(room.max()) if len(room) else 0
    padded = np.concatenate([array, np.zeros(deepest + 1, dtype=array.dtype)])
    lo, hi = np.zeros(len(place), dtype=np.int64), np.full(len(place), len(order), dtype=np.int64)
    depth = np.zeros(len(place), dtype=np.int64)
    active = np.arange(len(place))
    for d in range(deepest):
        active = active[room[active] > d]
        if not len(active):
            break
        token = tokens[place[active] + d]
        left = _bound(padded, order, d, lo[active], hi[active], token, False)
        right = _bound(padded, order, d, left, hi[active], token, True)
        on = right > left
        active = active[on]
        lo[active], hi[active], depth[active] = left[on], right[on], d + 1
    return depth, lo, hi


def _suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes that begin with a word, sorted by their first ``depth`` words."""
    rank, reach = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        second = np.concatenate([rank[reach:], np.zeros(min(reach, len(rank)), dtype=np.int64)])[: len(rank)]
        rank = np.unique(rank * (int(rank.max()) + 2) + second, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    order = np.argsort(rank, kind="stable")
    return order[tokens[order] != 0]


def _bound(padded, order, depth, lo, hi, token, after) -> np.ndarray:
    """Binary search, for all patterns at once, by the word at ``depth`` of the suffixes."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        middle = (lo + hi) >> 1
        value = padded[order[np.minimum(middle, len(order) - 1)] + depth]
        go = open_ & ((value <= token) if after else (value < token))
        lo = np.where(go, middle + 1, lo)
        hi = np.where(open_ & ~go, middle, hi)


def _matcher(shared: list):
    def one_shard(texts: list[bytes | None]) -> list[tuple]:
        split = [words(t) for t in texts]
        counts = [len(w) for w in split]
        starts = np.cumsum([1, *(n + 1 for n in counts)])[:-1]
        out = [(n, [], [], 0, []) for n in counts]
        found: dict[int, list] = {}
        for part in shared:
            block = Block.of(part.value)
            get = block.vocabulary.get
            ids = [0]
            for w in split:
                ids += [get(x, 0) for x in w]
                ids.append(0)
            place, which, reach, where = block.search(np.array(ids, dtype=np.int32))
            owner = np.searchsorted(starts, place, side="right") - 1
            by = np.argsort(owner, kind="stable")
            for some in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1) if len(by) else ():
                doc = int(owner[some[0]])
                items = {i for w in np.unique(which[some]) for i in block.items[w]}
                number = block.number[where[some]]
                names, begins = [block.names[k] for k in number], where[some] - block.begins[number]
                found.setdefault(doc, []).append((place[some] - starts[doc], block.length[which[some]], reach[some], items, names, begins))
            if len(shared) > 1:
                del part._value  # a task holds one block at a time; the next shard loads it again
        for doc, parts in found.items():
            first, length, reach, begins = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 5))
            names = [n for p in parts for n in p[4]]
            marks = np.zeros(counts[doc] + 1, dtype=np.int64)
            np.add.at(marks, first, 1)
            np.add.at(marks, first + length, -1)
            edge = np.diff(np.concatenate([[0], np.cumsum(marks[:-1]) > 0, [0]]).astype(np.int8))
            spans = [{"start": int(a), "stop": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
            # of the places where matches end together, only the first; of matches from there, the longest
            matches, ends = [], set()
            for k in np.lexsort((begins, -reach, first)).tolist():
                if (end := int(first[k] + reach[k])) not in ends:
                    ends.add(end)
                    matches.append({"start": int(first[k]), "words": int(reach[k]), "item": names[k], "item_start": int(begins[k])})
            out[doc] = (counts[doc], spans, sorted(set().union(*(p[3] for p in parts))), int(reach.max()), matches)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = np.cumsum([len(t.as_py() or b"") for t in texts])
            start = 0
            while start < len(batch):
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + SHARD_BYTES, side="right")))
                done = one_shard([texts[i].as_py() for i in range(start, stop)])
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                match = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))
                kinds = [pa.int64(), span, pa.list_(pa.string()), pa.int64(), match]
                new = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *new], ["_doc", *NEW])
                start = stop

    return run


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with its word count, the hit word spans, the ids of the items found
    (strings, sorted), the longest verbatim match in words, and the matches with their
    places in document and item (counted in words): columns ``_decon_*``.

    Null texts have no words, on either side. An item without words is never
    found; one without an id marks words but is not listed. Repeated items and
    repeated documents are each treated alike; of matches of one length from one place
    (a tie) the one first in the benchmark's suffix order is told. Very long texts are a
    shard of their own. Empty tables give no hits or no rows. Columns of ``docs`` named
    ``_decon_*`` give way; all others pass through whatever their names.
    """
    return unpacked(_annotated(docs, benchmark, text, item_id, item_text, window), docs.columns, list(NEW))


def _annotated(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """``_doc`` with the columns ``_decon_*``."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("i"), F.col(quoted(item_text)).cast("string").alias("t")).where("t is not null")
    shared, held, size = [], [], 0
    for r in items.toLocalIterator():  # the driver holds about BLOCK_BYTES
        held.append((r["i"], r["t"].encode("utf-8", "surrogatepass")))
        size += len(held[-1][1])
        if size > BLOCK_BYTES:
            shared.append(spark.sparkContext.broadcast(Block.build(held, window).plain()))
            held, size = [], 0
    shared.append(spark.sparkContext.broadcast(Block.build(held, window).plain()))
    whole = packed(docs, _text=F.col(quoted(text)).cast("string"))
    schema = T.StructType([whole.schema["_doc"], *spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in NEW.items())).schema.fields])
    return whole.mapInArrow(_matcher(shared), schema)


def hit_words(spans: str = "_decon_spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that no window of any item occurs in, with their own columns, whatever their names."""
    marked = _annotated(docs, benchmark, text, item_id, item_text, window)
    return marked.where(F.size("_decon_spans") == 0).select("_doc.*")
