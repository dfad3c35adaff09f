"""Minimum-cost-flow resharding.

The old layout is a set of shards with known contents; the new layout has other
capacities. Rows are grouped into *blocks* (old shard and size class). A flow
network sends each block's rows to new shards: staying costs nothing, moving a
row costs the mean bytes of its block. The cheapest flow that fills every new
shard moves the fewest bytes at the granularity of blocks. The law held is
``rows``: row counts of the new shards differ by one at most.

Only block totals reach the driver (old shards times size classes, at most
``64 * CLASSES`` an old shard); rows find their place by rank within their block.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_folder, quoted

#: Size classes to a doubling of the size.
CLASSES = 4
#: Rows that one task ranks together, about.
SLICE_ROWS = 1_000


def solve_flow(blocks: list[tuple[int, int, int, int]], capacity: list[int]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Send every row of every block to a shard at the least cost.

    ``blocks`` has (old shard, class, rows, bytes). Returns, for each block, its
    (new shard, rows) shipments, the shard that it stays in first. Successive
    shortest paths with potentials; all moves pass one hub, since a move's cost
    depends on the block and not on where it goes.
    """
    old = {(s, c): i for i, (s, c, _, _) in enumerate(blocks)}
    n, k = len(blocks), len(capacity)
    source, hub, sink = n + k, n + k + 1, n + k + 2
    graph: list[list[list]] = [[] for _ in range(n + k + 3)]  # [to, room, cost, index of the way back]

    def edge(a: int, b: int, room: int, cost: float) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, (s, _, rows, size) in enumerate(blocks):
        edge(source, i, rows, 0.0)
        if s < k:
            edge(i, n + s, rows, 0.0)
        edge(i, hub, rows, size / max(rows, 1))
    for j, room in enumerate(capacity):
        edge(hub, n + j, room, 0.0)
        edge(n + j, sink, room, 0.0)

    potential = [0.0] * len(graph)
    while True:
        dist = [float("inf")] * len(graph)
        came: list[tuple[int, int] | None] = [None] * len(graph)
        dist[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e, (v, room, cost, _) in enumerate(graph[u]):
                if room > 0 and (x := d + max(0.0, cost + potential[u] - potential[v])) < dist[v] - 1e-9:
                    dist[v], came[v] = x, (u, e)
                    heapq.heappush(heap, (x, v))
        if came[sink] is None:
            break
        potential = [p + (d if d < float("inf") else 0.0) for p, d in zip(potential, dist)]
        path, v = [], sink
        while v != source:
            u, e = came[v]
            path.append((u, e))
            v = u
        pushed = min(graph[u][e][1] for u, e in path)
        for u, e in path:
            graph[u][e][1] -= pushed
            graph[graph[u][e][0]][graph[u][e][3]][1] += pushed

    taken = [0] * k  # what the hub gives each shard
    for v, room, _, back in graph[hub]:
        if n <= v < n + k:
            taken[v - n] = graph[v][back][1]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    j = 0
    for (s, c), i in old.items():
        ships, moved = [], 0
        for v, room, _, back in graph[i]:
            if n <= v < n + k and graph[v][back][1]:
                ships.append((v - n, graph[v][back][1]))
            elif v == hub:
                moved = graph[hub][back][1]
        while moved:
            while not taken[j]:
                j += 1
            step = min(moved, taken[j])
            ships.append((j, step))
            moved -= step
            taken[j] -= step
        out[s, c] = ships
    return out


def new_capacities(total: int, shards: int, old_rows: dict[int, int]) -> list[int]:
    """Equal row counts; the shards with the most old rows take the rest of the division."""
    base, rest = divmod(total, shards)
    first = sorted(range(shards), key=lambda j: (-old_rows.get(j, 0), j))[:rest]
    return [base + (j in set(first)) for j in range(shards)]


def reshard(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = 24,
    old_shards: int = 16,
    old_shard: str | None = None,
    carry: bool = False,
) -> DataFrame:
    """One row a document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``,
    then ``old_shard`` and ``moved``, and with ``carry`` the document's row as the struct ``_doc``.

    ``size`` is the UTF-8 bytes of the text plus 8. The old layout is the column
    ``old_shard`` (non-negative integers) or else a hash of the id over
    ``old_shards`` shards. Null texts count as empty, null ids as one id,
    repeated rows are rows of their own (each takes a slot), an empty table
    gives an empty result. Very long texts are rows like others; equal sizes (ties) are
    ranked by a hash of id and text, id and CRC. Other columns never meet those here.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    key = F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit("null"))
    was = F.coalesce(F.col(quoted(old_shard)).cast("int"), F.lit(0)) if old_shard else (F.crc32(key) % old_shards).cast("int")
    size = (F.octet_length(body) + 8).cast("long")
    rows = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"),
        size.alias("size"),
        F.crc32(body).alias("text_crc32"),
        was.alias("old_shard"),
        F.xxhash64(key, body).alias("_hash"),
        *([F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("_doc")] if carry else []),
    ).withColumn("_class", F.floor(F.log2(F.col("size").cast("double")) * CLASSES).cast("int"))

    totals = [tuple(r) for r in rows.groupBy("old_shard", "_class").agg(F.count("*"), F.sum("size")).collect()]
    totals.sort()
    total = sum(t[2] for t in totals)
    held: dict[int, int] = {}
    for s, _, n, _ in totals:
        held[s] = held.get(s, 0) + n
    ships = solve_flow(totals, new_capacities(total, shards, held))
    next_slot, plan = [0] * shards, []
    for (s, c), parts in sorted(ships.items()):
        start = 0
        for shard, n in parts:
            plan.append((s, c, start, start + n, shard, next_slot[shard]))
            start += n
            next_slot[shard] += n
    table = spark.createDataFrame(plan, "old_shard int, _class int, _from long, _to long, shard int, _base long")

    # Rank within a block in two steps: offsets of hash slices, then row numbers in a slice.
    slices = max(1, -(-max((t[2] for t in totals), default=1) // SLICE_ROWS))
    rows = rows.withColumn("_slice", F.pmod(F.col("_hash"), F.lit(slices)).cast("int"))
    counts = rows.groupBy("old_shard", "_class", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("old_shard", "_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "old_shard", "_class", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("old_shard", "_class", "_slice").orderBy("_hash", "doc_id", "text_crc32")
    placed = rows.withColumn("_row", F.row_number().over(inside) - 1).join(
        offsets, ["old_shard", "_class", "_slice"]
    )
    placed = placed.withColumn("_rank", F.col("_row") + F.col("_offset"))
    # The plan has a row or two a block: bounded by the number of blocks, never by rows.
    fits = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = placed.join(F.broadcast(table), ["old_shard", "_class"]).where(fits)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_base") + F.col("_rank") - F.col("_from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
        (F.col("old_shard") != F.col("shard")).alias("moved"),
        *(["_doc"] if carry else []),
    )


def rewrite_affected(placed: DataFrame, path: str) -> list[int]:
    """Bring the shard folders ``path/shard=N`` up to ``placed``, the result of ``reshard``
    with ``carry``, and return the shards written or emptied.

    Those are the shards that gain or lose rows, and those that have no folder yet; the
    files of others stay as they are. A shard's new files replace its old ones. Rows come
    in the order of their slots, with the struct ``doc`` and the columns of the placement;
    nothing is joined, so repeated ids and null ids keep all their rows. ``placed`` must
    not be read from ``path``: write it elsewhere first (``common.staged``).
    """
    spark = placed.sparkSession
    held = placed.select("shard", "old_shard", "moved").groupBy("shard", "old_shard").agg(F.max("moved").alias("moved")).collect()  # a row a pair of shards
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {int(f.getPath().getName()[6:]) for f in fs.listStatus(folder) if f.getPath().getName().startswith("shard=")} if fs.exists(folder) else set()
    now = {r["shard"] for r in held}
    affected = {r["shard"] for r in held if r["moved"]} | {r["old_shard"] for r in held if r["moved"]} | (now - there) | (there - now)
    if affected & now:
        rows = placed.where(F.col("shard").isin(sorted(affected & now))).withColumnRenamed("_doc", "doc")
        rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        files = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        files.partitionBy("shard").parquet(path)
    for shard in sorted(affected - now):
        delete_folder(spark, f"{path}/shard={shard}")
    return sorted(affected)
