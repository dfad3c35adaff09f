"""Substring dedup with a log-structured fingerprint index.

A *window* is ``WINDOW`` consecutive words of one document. Its fingerprint is a
64-bit hash and a check of 32 bits of an independent hash: a match of the first is
verified by the second. Both hash all words of the window, so however common a line
is, the windows around it are spread evenly; among the 10^13 windows of 100 TB the
96 bits make about 0.002 false matches to be expected.

The index is a list of immutable runs of fingerprints. A run is kept in ``SHARDS``
folders; a shard's rows are *cells*, ranges of the hash with their fingerprints
sorted, in files bucketed by groups of neighbouring cells. Documents come in batches of
ascending id. A batch's windows are sent to their cells once, which makes a sorted
run of them. That run is merge-joined with each older run cell by cell: both are
bucketed alike, so neither is shuffled and the history never moves again. Then it joins the index, and two
runs of one level are compacted by merging, shard by shard, into one of the next.
A cell that outgrows its task is split (``Index.split``). The index stays where it
was built; ``Index.open`` takes it up again for later batches.

Windows repeated within a segment of a task's documents are found there, so a
passage that a third of all documents share reaches its cell once a segment.
"""

from __future__ import annotations

import gc
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_folder, setting, shared_dir, small_batches, staged, write_text

WINDOW = 20
#: Bytes of text whose windows a mapper holds before it sends them on, at least and at most.
SEGMENT_BYTES, MOST_SEGMENT = 3 << 20, 24 << 20
#: Bytes of text that are hashed into words together; longer texts are read in parts.
PIECE = 1 << 21
#: At least so many batches, and at most so many bytes of text in one.
BATCHES, BATCH_BYTES = 4, 1 << 38
#: Cells at least; windows in a cell of the whole index, about; groups of cells, to which a batch's windows are sent, at most.
CELLS, CELL_WINDOWS, GROUPS = 64, 1_000_000, 1 << 14
#: Folders of a run, which are compacted one by one; files of a folder at least, and windows in a file of the whole index, about.
SHARDS, FILES, FILE_WINDOWS = 4, 4, 1 << 24
#: Windows in a row of a run: a long cell is several rows, of some hundred kilobytes each.
CHUNK = 1 << 15
#: Rows of runs that Spark reads together.
READ_ROWS = 64
#: Bytes of text whose documents' replies are gathered in one task, about.
REPLY_BYTES = 16 << 20
LAST = (1 << 63) - 1
REPLY, RUN, WIN = 0, 1, 2

_U = np.uint64
_BASE, _WINDOW_BASE, _CHECK_BASE = _U(0xD1342543DE82EF95), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over 64 bits (published constants of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of odd bases and of their inverses modulo 2^64, kept between calls."""

    def __init__(self) -> None:
        self.known: dict[int, np.ndarray] = {}

    def of(self, base: int, n: int) -> np.ndarray:
        have = self.known.get(base)
        if have is None or len(have) < n:
            have = np.full(max(n, 1 << 16), base, dtype=_U)
            have[0] = 1
            have = self.known[base] = np.multiply.accumulate(have)
        return have[:n]


def _inverse(base) -> int:
    return pow(int(base), -1, 1 << 64)


def _rolled(values: np.ndarray, first: np.ndarray, last: np.ndarray, base, powers: _Powers) -> np.ndarray:
    """Hashes of ``values[first:last]``, whatever stands around them."""
    sums = np.empty(len(values) + 1, dtype=_U)
    sums[0] = 0
    np.cumsum(values * powers.of(int(base), len(values)), out=sums[1:])
    return _mix((sums[last] - sums[first]) * powers.of(_inverse(base), len(values) + 1)[first])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = _mix(np.arange(1, 257, dtype=_U))


def _pieces(whole: np.ndarray, at: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end after white space, so that no word is cut:
    arrays of a number a byte stay small however long a text is."""
    while at < len(whole):
        stop = min(at + PIECE, len(whole))
        while stop < len(whole) and not _SPACE[whole[stop - 1]]:
            near = np.flatnonzero(_SPACE[whole[stop : stop + PIECE]])
            stop = stop + int(near[0]) + 1 if len(near) else min(stop + PIECE, len(whole))
        yield at, stop
        at = stop


def _starts(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words of a piece, and the bytes after their last."""
    edge = np.diff(np.concatenate([[True], _SPACE[piece], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _words(piece: np.ndarray, offset: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of a piece."""
    first, last = _starts(piece)
    return first + offset, _rolled(_BYTE[piece], first, last, _BASE, powers) + (last - first).astype(_U)


def _parts(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A long text in parts that overlap by ``WINDOW - 1`` words: number of the first word, and bytes."""
    whole = np.frombuffer(text, np.uint8)
    at, base = 0, 0
    while len(whole) - at > 2 * PIECE:
        stop, found = at, 0
        while stop < len(whole) and found < 2 * WINDOW:
            stop = next(_pieces(whole, stop))[1]
            first = _starts(whole[at:stop])[0]
            found = len(first)
        yield base, text[at:stop]
        if stop == len(whole):
            return
        base += found - (WINDOW - 1)
        at += int(first[found - (WINDOW - 1)])
    yield base, text[at:]


def window_hashes(texts: list[bytes], powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check, text number and start word of every window of the texts."""
    whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    parts = [_words(whole[a:b], a, powers) for a, b in _pieces(whole)]
    first, word = (np.concatenate([p[k] for p in parts]) for k in range(2))
    none = np.empty(0, dtype=np.int64)
    if len(first) < WINDOW:
        return none.astype(_U), none.astype(_U), none, none
    text = np.searchsorted(ends, first, side="right")
    n = len(first) - WINDOW + 1
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    begins = np.searchsorted(text, np.arange(len(texts)))  # first word of each text
    hashed = _rolled(word, inside, inside + WINDOW, _WINDOW_BASE, powers)
    check = _rolled(_mix(word), inside, inside + WINDOW, _CHECK_BASE, powers) >> _U(32)
    return hashed, check, text[inside], inside - begins[text[inside]]


def _pack(*arrays: np.ndarray) -> bytes:
    """Non-negative numbers as byte planes, as many as the greatest needs: high bytes that
    are mostly zero lie together and compress away."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u8")
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head += [len(a), width]
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(head, dtype="<u4").tobytes() + b"".join(body)


def _unpack(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<u4", 1)[0])
    head = np.frombuffer(data, "<u4", 2 * count, 4)
    out, at = [], 4 + 8 * count
    for n, width in head.reshape(-1, 2).tolist():
        eight = np.zeros((n, 8), dtype=np.uint8)
        if n:
            eight[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(eight.view("<u8").reshape(-1).astype(_U, copy=False))
        at += n * width
    return out


def _pack_prints(hashed: np.ndarray, check: np.ndarray) -> bytes:
    """Fingerprints in the order of their hashes; a hash is its distance from the one before."""
    return _pack(hashed[:1], np.diff(hashed), check)


def _unpack_prints(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, steps, check = _unpack(data)
    return np.cumsum(np.concatenate([first, steps])), check


def _pack_places(order: np.ndarray, row: np.ndarray, start: np.ndarray) -> bytes:
    base = order[:1] * 0 + (order.min() if len(order) else 0)
    return _pack(base.view(_U), (order - base).view(_U) if len(order) else order.view(_U), row.view(_U), start)


def _unpack_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base, order, row, start = _unpack(data)
    return (order + base).view(np.int64) if len(order) else order.view(np.int64), row.view(np.int64), start.astype(np.int64)


def _grouped(hashed, check, order, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by (hash, check, place); of the sorted, the first of their fingerprint
    and which start later than it. What has the very place of the first (a row that is
    there twice) does not start later."""
    by = np.argsort(hashed, kind="stable")  # sorted parts are merged
    h = hashed[by]
    tied = np.concatenate([[False], h[1:] == h[:-1], [False]])
    at = np.flatnonzero(tied[:-1] | tied[1:])
    some = by[at]
    by[at] = some[np.lexsort((start[some], order[some], check[some], h[at]))]
    c = check[by]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(by) else by
    group = np.repeat(head, np.diff(np.concatenate([head, [len(by)]])))
    o, s = order[by], start[by]
    return by, group, (o != o[group]) | (s != s[group])


def _members(a: np.ndarray, a_check: np.ndarray, b: np.ndarray, b_check: np.ndarray) -> np.ndarray:
    """Which fingerprints of the sorted run a are in the sorted run b: a merge by hash, verified by the checks."""
    at = np.searchsorted(b, a)
    hit = np.zeros(len(a), dtype=bool)
    left = np.arange(len(a))
    while len(left):
        left = left[at[left] < len(b)]
        left = left[b[at[left]] == a[left]]
        same = b_check[at[left]] == a_check[left]
        hit[left[same]] = True
        left = left[~same]
        at[left] += 1
    return hit


def _merged(a: np.ndarray, a_check: np.ndarray, b: np.ndarray, b_check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs as one, each fingerprint once."""
    hashed, check = np.empty(len(a) + len(b), _U), np.empty(len(a) + len(b), _U)
    for x, y, at in ((a, a_check, np.searchsorted(b, a, "left")), (b, b_check, np.searchsorted(a, b, "right"))):
        at = at + np.arange(len(x))
        hashed[at], check[at] = x, y
    new = np.ones(len(hashed), dtype=bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (check[1:] != check[:-1])
    return hashed[new], check[new]


# ``grp`` is the group of cells that a batch's windows are sent to and that files are bucketed by;
# ``part`` is the part of the documents that a reply is for
_FIELDS = [("kind", pa.int32()), ("grp", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("places", pa.binary())]
_OUT = pa.schema(_FIELDS)
_RUN_SCHEMA = "grp int, cell int, part int, n long, data binary, places binary"
_SCHEMA = "kind int, " + _RUN_SCHEMA


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_OUT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def _edges(hashed: np.ndarray, cells: int) -> Iterator[tuple[int, int, int]]:
    """Cell, first and last place of each cell that sorted hashes fall into."""
    if not len(hashed):
        return
    cell = (hashed >> _U(64 - (cells.bit_length() - 1))).astype(np.int64) if cells > 1 else np.zeros(len(hashed), np.int64)
    cut = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(cell[lo]), lo, hi


def _chunks(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``CHUNK`` at most."""
    return ((a, min(a + CHUNK, hi)) for a in range(lo, hi, CHUNK))


def _reply_rows(group: int, order: np.ndarray, row: np.ndarray, start: np.ndarray, parts: int) -> list[tuple]:
    """Repeated windows, packed for each part of the documents."""
    part = np.mod(order ^ row, parts)
    by = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[by])) + 1
    return [
        (REPLY, group, 0, int(part[some[0]]), len(some), _pack_places(order[some], row[some], start[some]), None)
        for some in np.split(by, cut) if len(some)
    ]


def _mapper(groups: int, segment: int):
    def flush(rows: list[tuple[int, int, int, bytes]], number: int, powers: _Powers) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[:3])
        order_of, row_of, base_of = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        hashed, check, text, start = window_hashes([r[3] for r in rows], powers)
        order, row, start = order_of[text], row_of[text], start + base_of[text]
        by, first, later = _grouped(hashed, check, order, start)
        out = []
        again = by[later]
        if len(again):
            out.append((REPLY, number % groups, 0, 0, len(again), _pack_places(order[again], row[again], start[again]), None))
        # of one place, only rows that differ
        by = by[~later & ((first == np.arange(len(by))) | (row[by] != row[by][first]))]
        hashed, check, order, row, start = hashed[by], check[by], order[by], row[by], start[by]
        for cell, lo, hi in _edges(hashed, groups):
            out.append((WIN, cell, 0, 0, hi - lo, _pack_prints(hashed[lo:hi], check[lo:hi]), _pack_places(order[lo:hi], row[lo:hi], start[lo:hi])))
        yield _batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, rows, size, number = _Powers(), [], 0, 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for o, p, t in zip(batch.column(0), batch.column(1), texts):
                for base, part in _parts(t.as_py() or b""):
                    rows.append((o.as_py(), p.as_py(), base, part))
                    size += len(part)
                    if size > segment:
                        number = number or rows[0][0]  # deals the replies of segments out
                        yield from flush(rows, number, powers)
                        rows, size, number = [], 0, number + 1
        if rows:
            yield from flush(rows, number or rows[0][0], powers)

    return run


def _sorted_run(cells: int, parts: int):
    """A group of cells: the batch's windows as sorted cells, and replies for those repeated within the batch."""

    def run(table: pa.Table) -> pa.Table:
        replies, wins, group = [], [], table.column("grp")[0].as_py()
        for kind, data, places in zip(table.column("kind").to_pylist(), table.column("data"), table.column("places")):
            if kind == REPLY:
                replies.append(_unpack_places(data.as_py()))
            else:
                wins.append((*_unpack_prints(data.as_py()), *_unpack_places(places.as_py())))
        out = []
        if wins:
            hashed, check, order, row, start = (np.concatenate([w[k] for w in wins]) for k in range(5))
            wins.clear()
            by, first, later = _grouped(hashed, check, order, start)
            again = by[later]
            replies.append((order[again], row[again], start[again]))
            by = by[~later & ((first == np.arange(len(by))) | (row[by] != row[by][first]))]
            hashed, check, order, row, start = hashed[by], check[by], order[by], row[by], start[by]
            for cell, lo, hi in _edges(hashed, cells):
                for a, b in _chunks(lo, hi):
                    out.append((RUN, group, cell, 0, b - a, _pack_prints(hashed[a:b], check[a:b]), _pack_places(order[a:b], row[a:b], start[a:b])))
        if replies:
            out += _reply_rows(group, *(np.concatenate([r[k] for r in replies]) for k in range(3)), parts)
        return pa.Table.from_batches([_batch_of(out)])

    return run


def _one_run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all rows of one run, which are ranges that don't overlap."""
    found = sorted((_unpack_prints(d.as_py()) for d in table.column("data")), key=lambda f: int(f[0][0]))
    none = np.empty(0, dtype=_U)
    return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(2))


def _history(parts: int):
    """A cell of the new run against that of an older one: replies for windows that the older one has."""

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        out = []
        if old.num_rows:
            past = _one_run(old)
            for group, data, places in zip(new.column("grp").to_pylist(), new.column("data"), new.column("places")):
                hit = _members(*_unpack_prints(data.as_py()), *past)
                if hit.any():
                    out += _reply_rows(group, *(x[hit] for x in _unpack_places(places.as_py())), parts)
        return pa.Table.from_batches([_batch_of(out)])

    return run


def _compact(a: pa.Table, b: pa.Table) -> pa.Table:
    """A cell of two runs as one; the places of the new run's windows are no longer needed."""
    hashed, check = _merged(*_one_run(a), *_one_run(b))
    group, cell = ((a if a.num_rows else b).column(c)[0].as_py() for c in ("grp", "cell"))
    rows = [(RUN, group, cell, 0, y - x, _pack_prints(hashed[x:y], check[x:y]), None) for x, y in _chunks(0, len(hashed))]
    return pa.Table.from_batches([_batch_of(rows)]).drop_columns(["kind"])


def _halved(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, data in zip(batch.column("grp").to_pylist(), batch.column("data")):
                hashed, check = _unpack_prints(data.as_py())
                rows = [(RUN, group, c, 0, hi - lo, _pack_prints(hashed[lo:hi], check[lo:hi]), None) for c, lo, hi in _edges(hashed, cells)]
                yield pa.RecordBatch.from_arrays(_batch_of(rows).columns[1:], schema=pa.schema(_FIELDS[1:]))

    return run


class Index:
    """Runs by level for each shard, newest last. ``add`` compacts two runs of one level.

    ``path/manifest`` tells, in its newest line, the runs, their cells and the windows held."""

    def __init__(self, spark: SparkSession, path: str, cells: int = CELLS, files: int = FILES, groups: int | None = None, shards: list | None = None, windows: int = 0, version: int = 0):
        self.spark, self.path, self.cells, self.files, self.windows, self.version = spark, path, cells, files, windows, version
        self.groups = groups or min(cells, GROUPS)
        self.shards: list[list[tuple[int, str]]] = shards or [[] for _ in range(SHARDS)]

    @classmethod
    def create(cls, spark: SparkSession, windows: int = 0, path: str | None = None) -> Index:
        """An empty index for about so many windows."""
        cells = CELLS
        while cells < windows / CELL_WINDOWS:
            cells *= 2
        files = max(FILES, windows // SHARDS // FILE_WINDOWS)
        return cls(spark, path or f"{shared_dir(spark)}/window-index-{uuid.uuid4().hex}", cells, files)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index that was built at ``path``."""
        newest = spark.read.text(f"{path}/manifest").orderBy(F.desc("version")).first()
        known = json.loads(newest["value"])
        shards = [[(level, run) for level, run in s] for s in known["shards"]]
        return cls(spark, path, known["cells"], known["files"], known["groups"], shards, known["windows"], newest["version"])

    @property
    def keys(self) -> list[str]:
        """What two runs are merged by. Files are bucketed by group; the setting lets Spark
        merge the cells of a group without a shuffle. It is read when a query is planned, so it stays set."""
        if self.cells == self.groups:
            return ["grp"]
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return ["grp", "cell"]

    def save(self) -> None:
        self.version += 1
        line = json.dumps({"cells": self.cells, "files": self.files, "groups": self.groups, "windows": self.windows, "shards": self.shards})
        write_text(self.spark, f"{self.path}/manifest/version={self.version}/runs.json", line)

    def run(self, path: str) -> DataFrame:
        """A shard of a run, as a table bucketed by group of cells."""
        name = f"run_{uuid.uuid4().hex}"
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({_RUN_SCHEMA}) USING parquet CLUSTERED BY (grp) INTO {self.files} BUCKETS LOCATION '{place}'")
        found = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay, and the plan has them
        return found

    def write(self, df: DataFrame, *parts: str) -> str:
        path, name = f"{self.path}/run-{uuid.uuid4().hex}", f"run_{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").option("path", path)
        (writer.partitionBy(*parts) if parts else writer).bucketBy(self.files, "grp").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return path

    def add(self, new: list[str], windows: int) -> None:
        """Take the shards of a new run in; compact them one by one."""
        self.windows += windows
        for runs, path in zip(self.shards, new):
            runs.append((0, path))
        self.save()
        for runs in self.shards:
            while len(runs) > 1 and runs[-1][0] == runs[-2][0]:
                (level, a), (_, b) = runs[-2:]
                both = self.run(a).groupBy(*self.keys).cogroup(self.run(b).groupBy(*self.keys))
                runs[-2:] = [(level + 1, self.write(both.applyInArrow(_compact, _RUN_SCHEMA)))]
                self.save()
                for old in (a, b):
                    delete_folder(self.spark, old)
        if self.windows > 2 * CELL_WINDOWS * self.cells:
            self.split()

    def split(self) -> None:
        """Halve all cells. Done each time that the index doubles, so a window is rewritten a few times in all."""
        self.cells *= 2
        old = [path for runs in self.shards for _, path in runs]
        for runs in self.shards:
            runs[:] = [(level, self.write(self.run(path).mapInArrow(_halved(self.cells), _RUN_SCHEMA))) for level, path in runs]
        self.save()
        for path in old:
            delete_folder(self.spark, path)

    def drop(self) -> None:
        delete_folder(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, order, row, text``: ``row`` tells rows of one id with different texts apart (0 where an id is there once)."""
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("order"))
    twice = staged(ids.groupBy("order").count().where("count > 1").select("order", F.lit(True).alias("twice")), "repeated-ids")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("order"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    row = F.when(F.col("twice"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.join(twice, "order", "left").select("doc_id", "order", row.alias("row"), "text")


def _by_document(table: pa.Table) -> pa.Table:
    """The repeated windows of a part of the documents, as one row a document."""
    found = [_unpack_places(d.as_py()) for d in table.column("data")]
    order, row, start = (np.concatenate([f[k] for f in found]) for k in range(3))
    by = np.lexsort((start, row, order))
    o, r, s = order[by], row[by], start[by]
    cut = np.concatenate([[0], np.flatnonzero((o[1:] != o[:-1]) | (r[1:] != r[:-1])) + 1, [len(o)]])
    starts = [s[a:b].astype("<i8").tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return pa.table({"order": pa.array(o[cut[:-1]]), "row": pa.array(r[cut[:-1]]), "starts": pa.array(starts, pa.binary())})


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words that repeated windows cover."""
    for batch in rows:
        texts, starts = batch.column(1).cast(pa.binary()), batch.column(2)
        n_words, n_removed, kept = [], [], []
        for t, found in zip(texts, starts):
            t = t.as_py() or b""
            at = np.frombuffer(found.as_py() or b"", "<i8")
            total, stay = 0, []
            for a, b in _pieces(np.frombuffer(t, np.uint8)):
                words = t[a:b].split()
                if len(at):
                    place = np.arange(total, total + len(words))
                    near = np.searchsorted(at, place, side="right")
                    stays = np.flatnonzero((near == 0) | (place - at[near - 1] >= WINDOW))
                    stay += [words[i] for i in stays]
                else:
                    stay += words
                total += len(words)
            n_words.append(total)
            n_removed.append(total - len(stay))
            kept.append(b" ".join(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )


def dedup_batch(docs: DataFrame, index: Index, *, doc_id: str = "doc_id", text: str = "text", size: int | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """``doc_id, n_words, n_removed, kept_text`` of a batch against the index and itself,
    and a function that adds the batch to the index.

    Write the result first, then call the function: the history of a batch is what the
    index held before it. All that the index has counts as earlier than the batch.
    ``size`` is the batch's bytes of text, if known.
    """
    small_batches(docs.sparkSession)
    if size is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(16, size // REPLY_BYTES)
    groups = index.groups
    segment = min(max(SEGMENT_BYTES, groups * 256 * 6), MOST_SEGMENT)
    rows = _identified(docs, doc_id, text)
    windows = rows.select("order", "row", "text").mapInArrow(_mapper(groups, segment), _SCHEMA)
    # each task has the groups of one shard's bucket, so it writes one file of them and one of replies
    dealt = windows.repartition(SHARDS * index.files, "grp")
    made = dealt.groupBy("grp").applyInArrow(_sorted_run(index.cells, parts), _SCHEMA)
    shard = F.floor(F.pmod(F.hash("grp"), F.lit(SHARDS * index.files)) / index.files).cast("int")
    path = index.write(made.withColumn("shard", F.when(F.col("kind") == RUN, shard).otherwise(-1)).drop("kind"), "shard")
    whole = index.spark.read.schema(_RUN_SCHEMA + ", shard int").parquet(path)
    replies = whole.where("shard = -1").select("part", "data")
    new = [f"{path}/shard={s}" for s in range(SHARDS)]
    for run, older in zip(new, index.shards):
        for _, old in older:
            both = index.run(run).groupBy(*index.keys).cogroup(index.run(old).groupBy(*index.keys))
            replies = replies.unionByName(both.applyInArrow(_history(parts), _SCHEMA).select("part", "data"))
    found = replies.groupBy("part").applyInArrow(_by_document, "order long, row long, starts binary")
    joined = rows.join(found, ["order", "row"], "left").select("doc_id", "text", "starts")
    kind = docs.schema[doc_id].dataType.simpleString()

    def add() -> None:
        index.add(new, whole.where("shard >= 0").agg(F.sum("n")).first()[0] or 0)
        delete_folder(index.spark, f"{path}/shard=-1")

    return joined.mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string"), add


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batches: int | None = None, project=None, index: Index | None = None) -> DataFrame:
    """Remove from every text each word that a window covers whose words also start
    earlier: in a document of a smaller id, or earlier in the same document.

    ``doc_id, n_words, n_removed, kept_text`` for every row, or what ``project``
    makes of it (written batch by batch; digests take less room than texts).
    With ``index``, all that it holds counts as earlier, and the documents are added
    to it; without, one is built in the shared folder and stays there.

    Null and empty texts have no words. A null id counts as later than all
    others. Rows with one id are one place: of two equal rows neither is earlier.
    Very long texts are read in parts, so that arrays stay small. Windows with the
    same words that start at the same place (a tie) both stay. Other columns of
    ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    project = project or (lambda df: df)
    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = batches or max(BATCHES, -(-size // BATCH_BYTES))
    index = index or Index.create(spark, size // 6)
    shares = [(k + 1) / batches for k in range(batches - 1)]
    cuts = sorted(set(docs.select(F.percentile_approx(ids, shares, 10_000)).first()[0] or [])) if shares else []
    out = None
    with setting(spark, "spark.sql.parquet.columnarReaderBatchSize", READ_ROWS):
        for k in range(len(cuts) + 1):
            part = docs
            if k:
                part = part.where(ids > cuts[k - 1])
            if k < len(cuts):
                part = part.where(ids <= cuts[k])
            found, add = dedup_batch(part, index, doc_id=doc_id, text=text, size=size // batches)
            done = staged(project(found), "deduped")
            release(spark)
            add()
            release(spark)
            out = done if out is None else out.unionByName(done)
    return out
