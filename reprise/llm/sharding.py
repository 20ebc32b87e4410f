"""Balanced shards by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of the text, doc_id). A sample in which a record's chance follows its size gives
quantile boundaries on that hash; records are range-partitioned by them, each boundary value being a range of its own,
so a text that a third of all rows share has one. Ranges that the exact totals show to be overfull are subdivided by a
second hash. Exact totals of the ranges then say where every record stands in the whole order, counted in bytes, and
the shard follows from that place: sizes differ by about a record, at any skew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

PER_SHARD = 16
SAMPLE_PER_RANGE = 24
#: A range of more rows or of more than four times its bytes is subdivided, as each part is sorted in one task.
MOST_ROWS = 1_000_000


def sharded(docs: DataFrame, shards: int = 40, keep_together: float = 0.01) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text).

    size is the text's UTF-8 bytes (null: 0) plus 16. Equal texts stand next to each other, and a run of them no larger
    than keep_together of a shard isn't cut; a larger one is cut between records. slot is gapless from 0 within a shard.
    Null texts form a group like any other, with crc 0; null doc_ids come first in their group. Repeated rows get a slot each. An empty
    table gives an empty result. Other columns are ignored. The driver gets shards * 16 boundaries and about as many
    totals; the table of part totals has a row for every MOST_ROWS rows besides.
    """
    ranges = shards * PER_SHARD
    text = F.col("text").cast("string")
    keyed = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text, F.md5(text)).alias("_h"),
        )
    )
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    target = max(1.0, total / shards)
    chance = F.col("size") * F.lit(ranges * SAMPLE_PER_RANGE / max(1, total))
    unit = F.pmod(F.xxhash64("doc_id", "_h", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = keyed.where(unit < chance)
    cuts = sample.agg(F.percentile_approx("_h", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if n else None
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>") if cuts else F.expr("cast(array() as array<long>)")
    # how many boundaries lie below, by bisection over a constant array; a boundary's own value is an odd range
    steps = max(1, math.ceil(math.log2(len(cuts) + 1)))
    below = F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]),
        F.lit(0),
        lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) < F.col("_h")), at + step).otherwise(at),
    )
    ranged = keyed.withColumn("_below", below).withColumn("_range", 2 * F.col("_below") + F.when(F.get(bounds, F.col("_below")) == F.col("_h"), 1).otherwise(0)).drop("_below")
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # at most 2 * ranges + 1 rows
    parts = {r["_range"]: math.ceil(max(r["bytes"] / (target / PER_SHARD * 4), r["rows"] / MOST_ROWS)) for r in totals}
    parts = {k: v for k, v in parts.items() if v > 1}
    sub = F.lit(0)
    if parts:
        many = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        # within a boundary's own range all hashes are equal, so doc_id deals; elsewhere the hash itself, which keeps equal texts together
        deal = F.when(F.col("_range") % 2 == 1, F.xxhash64("doc_id")).otherwise(F.xxhash64("_h"))
        sub = F.pmod(deal, F.coalesce(many[F.col("_range")], F.lit(1))).cast("int")
    cut = stage(ranged.withColumn("_sub", sub))
    per = cut.groupBy("_range", "_sub").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    prior = Window.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)  # over the totals of ranges: a bounded table
    base = per.select("_range", "_sub", F.coalesce(F.sum("_bytes").over(prior), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_rows").over(prior), F.lit(0)).alias("_r0"))
    order = Window.partitionBy("_range", "_sub").orderBy("_h", "doc_id", "size")
    same = Window.partitionBy("_range", "_sub", "_h")
    placed = (
        cut.withColumn("_b", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("_r", F.row_number().over(order) - 1)
        .withColumn("_gb", F.min("_b").over(same))
        .withColumn("_gs", F.sum("size").over(same))
        .join(base, ["_range", "_sub"])  # as many rows as there are parts
    )
    middle = F.col("_b0") + F.when(F.col("_gs") <= keep_together * target, F.col("_gb") + F.col("_gs") / 2).otherwise(F.col("_b") + F.col("size") / 2)
    placed = stage(
        placed.select(
            "doc_id", "size", "text_crc32",
            F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(1, total))))).cast("int").alias("shard"),
            (F.col("_r0") + F.col("_r")).alias("_row"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
