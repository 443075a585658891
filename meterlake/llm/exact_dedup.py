"""Exact dedup by content sort, in DataFrame operations only.

Every row gets a sort key of 64 bytes: the first 32 bytes of its normalised text, zero-padded, and the text's
SHA-256. Splitters drawn from a sample of keys cut the key space into ranges of near equal size; a range is one
sort unit. Rows go to their range in one exchange, an external sort by (text, doc_id) places equal texts side by
side, and each row is compared in full with the one before it. A key that fills several ranges by itself (a hot
group of copies) has several equal splitters; its rows are dealt over as many pieces by doc_id, each piece is
sorted and compared alike, and the heads of the pieces (at most one a splitter) are merged.

Cases: null text counts as empty, and empty texts are equal. Of equal texts the smallest doc_id stays, a null
doc_id only if there is no other; of rows with the same text and doc_id one stays. An empty table gives no rows.
Other columns of the input are ignored unless `carry` names them; they come back in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import WS, packed_search, partitions, text_of

WIDTH = 64
#: Ranges for each shuffle partition, and sampled keys for each range.
RANGES, SAMPLED = 4, 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WS, " ")


def sort_key(norm: Column, digest: Column) -> Column:
    head = F.substring(F.encode(norm, "utf-8"), F.lit(1), F.lit(32))
    return F.concat(F.rpad(head, 32, F.lit(b"\x00")), F.unhex(digest))


def splitters(rows: DataFrame, text: Column, ranges: int, total: int) -> list[bytes]:
    """Quantiles of a uniform sample of keys: about SAMPLED * ranges keys of 64 bytes reach the driver, whatever the input."""
    wanted = SAMPLED * ranges
    drawn = rows.select(text.alias("t")) if total <= wanted else rows.select(text.alias("t")).sample(min(1.0, wanted / total), seed=11)
    norm = normalised(F.col("t"))
    keys = sorted(bytes(r[0]) for r in drawn.select(sort_key(norm, F.sha2(norm, 256)).alias("k")).toLocalIterator())
    return [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, and `row`, a struct of the columns in carry."""
    total = df.count()
    ranges = max(1, min(RANGES * partitions(df.sparkSession), total // 16))
    cuts = splitters(df, text_of(text_col), ranges, total)
    distinct = sorted(set(cuts))
    times = [cuts.count(c) for c in distinct] if len(distinct) < len(cuts) else [1] * len(distinct)
    hot = any(t > 1 for t in times)

    norm = normalised(text_of(text_col)).alias("norm")
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry is not None else []
    rows = df.select(F.col(id_col).alias("doc_id"), norm, *extra)
    rows = rows.select("*", F.sha2("norm", 256).alias("text_sha256"))
    if distinct:
        packed, key = F.lit(b"".join(distinct)), sort_key(F.col("norm"), F.col("text_sha256"))
        rows = rows.select("*", key.alias("key")).select("*", packed_search(packed, len(distinct), WIDTH, F.col("key")).alias("bucket"))
    else:
        rows = rows.select("*", F.lit(b"").alias("key"), F.lit(0).alias("bucket"))
    piece = F.lit(-1)
    if hot:  # the range's own splitter is the key of a hot group
        at = F.col("bucket")
        n = F.element_at(F.array(*[F.lit(t) for t in [1, *times]]), at + 1)
        same = (at > 0) & (F.substring(packed, (at - 1) * WIDTH + 1, F.lit(WIDTH)) == F.col("key"))
        piece = F.when(same & (n > 1), F.pmod(F.xxhash64("doc_id"), n)).otherwise(F.lit(-1))
    rows = rows.select("*", piece.cast("int").alias("piece")).drop("key")

    def runs(x: DataFrame) -> DataFrame:
        unit = Window.partitionBy("bucket", "piece")
        order = unit.orderBy(F.col("norm"), F.col("doc_id").asc_nulls_last())
        x = x.select("*", F.lag("norm").over(order).alias("before"))
        x = x.select("*", F.when(F.col("before") == F.col("norm"), 0).otherwise(1).alias("start")).drop("before")
        x = x.select("*", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
        run = Window.partitionBy("bucket", "piece", "run")
        return x.select("*", F.min("doc_id").over(run).alias("low"), F.count(F.lit(1)).over(run).alias("n"))

    light = ["doc_id", "text_sha256", "bucket", "piece", "start", "run", "low", "n", *(["row"] if extra else [])]
    out = runs(rows).select(light)
    first = F.col("start") == 1
    if not hot:
        keep, size = F.col("low"), F.col("n")
    else:
        # At most one head for each piece, and no more pieces than splitters: the bound that allows the broadcast.
        heads = runs(rows.filter("piece >= 0").drop("row")).filter("start = 1").groupBy("bucket", "norm").agg(F.min("low").alias("all_low"), F.sum("n").alias("all_n"), F.first("text_sha256").alias("hot_sha"))
        heads = heads.select(F.col("bucket").alias("hot_bucket"), "hot_sha", "all_low", "all_n")
        out = out.join(F.broadcast(heads), (F.col("piece") >= 0) & (F.col("bucket") == F.col("hot_bucket")) & (F.col("text_sha256") == F.col("hot_sha")), "left")
        keep, size = F.when(F.col("piece") >= 0, F.col("all_low")).otherwise(F.col("low")), F.when(F.col("piece") >= 0, F.col("all_n")).otherwise(F.col("n"))
    if hot:  # without any id, the piece of null ids keeps its first row
        first = first & F.col("doc_id").eqNullSafe(keep)
    return out.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), first.alias("kept"), "text_sha256", *(["row"] if extra else []))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
