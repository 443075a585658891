"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The law is `rows`: shard capacities are floor(n / shards) or one more and add up to n, so counts are at most one
apart. Each shard owns `vnodes` points of the ring; a row hashes (by its id and text) to a point and belongs to the
next virtual node clockwise. A shard that is full takes no more, and the rows that overflow continue clockwise to
the next virtual node whose shard has room.

Only counts decide where whole runs of rows go: the number of rows of every arc and cell (a bounded table, one count
for each cell) goes to the driver, which walks the ring once and returns intervals (arc, from rank, to rank) ->
(shard, first slot). A row's rank in its arc is its cell's offset plus its row number in the cell, so the text never
moves and the one exchange carries a few numbers a row.

Rows with equal texts are no unit: the law counts rows, so a group of copies is dealt over shards like any others.

Cases: null text has size 8 and the crc32 of no bytes; repeated rows share a point and take neighbouring slots; a
null id hashes as the empty text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import packed_search, text_of

SHARDS, VNODES = 24, 128
#: Rows that a cell of an arc holds on average at most.
CELL_ROWS = 100_000


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard), sorted by point: SHA-256 places the virtual nodes."""
    return sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(vnodes))


def point(id_col: Column, text: Column) -> Column:
    """Eight unsigned bytes, big end first."""
    return F.unhex(F.lpad(F.hex(F.xxhash64(id_col, text)), 16, "0"))


def walk(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, lo, hi, shard, slot of lo): own rows first, in ring order, then the overflow of each arc, clockwise."""
    room, used, out, over = list(capacity), [0] * len(capacity), [], []

    def put(arc: int, lo: int, hi: int, shard: int) -> int:
        take = min(hi - lo, room[shard])
        if take:
            out.append((arc, lo, lo + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
        return lo + take

    for arc, n in enumerate(counts):
        if (lo := put(arc, 0, n, owners[arc])) < n:
            over.append((arc, lo, n))
    arcs = len(counts)
    following = list(range(1, arcs + 1))  # the next arc that may have room, with path halving
    for arc, lo, hi in over:
        at = arc
        while lo < hi:
            at = following[at % arcs] % arcs
            lo = put(arc, lo, hi, owners[at])
            if not room[owners[at]]:
                following[(at - 1) % arcs] = at + 1
    return out


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark, total = df.sparkSession, df.count()
    nodes = ring(shards, vnodes)
    cells = max(1, -(-total // (len(nodes) * CELL_ROWS)))
    text = text_of(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        point(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("point"),
    )
    packed = F.lit(b"".join(struct.pack(">Q", p) for p, _ in nodes))
    before = packed_search(packed, len(nodes), 8, F.col("point"))
    rows = rows.select("*", F.pmod(before, F.lit(len(nodes))).alias("arc"), F.pmod(F.xxhash64("point"), F.lit(cells)).cast("int").alias("cell"))
    found = {(a, c): n for a, c, n in rows.groupBy("arc", "cell").count().toLocalIterator()}
    counts, offsets = [0] * len(nodes), []
    for (a, c), n in sorted(found.items()):
        offsets.append((a, c, counts[a]))
        counts[a] += n
    base, more = divmod(total, shards)
    plan = walk(counts, [s for _, s in nodes], [base + (s < more) for s in range(shards)])
    by_arc: dict[int, list] = {}
    for a, lo, hi, s, slot in plan:
        by_arc.setdefault(a, []).append((lo, hi, s, slot))
    pieces = []  # each cell gets the intervals that it touches
    for a, c, at in offsets:
        n, arc = found[a, c], sorted(by_arc.get(a, []))
        i = max(0, bisect.bisect_right(arc, (at, 1 << 62)) - 1)
        while i < len(arc) and arc[i][0] < at + n:
            lo, hi, s, slot = arc[i]
            if hi > at:
                pieces.append((a, c, lo - at, hi - at, s, slot))
            i += 1
    # One row for each cell and shard it spills to: bounded by shards * vnodes * cells, a few numbers each.
    where = spark.createDataFrame(pieces, "p_arc int, p_cell int, lo long, hi long, shard int, slot_lo long")
    order = Window.partitionBy("arc", "cell").orderBy("point", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = rows.select("*", (F.row_number().over(order) - 1).cast("long").alias("rank"))
    placed = ranked.join(
        F.broadcast(where) if len(pieces) < 200_000 else where,
        (F.col("arc") == F.col("p_arc")) & (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    )
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot_lo") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
