"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import body, join_groups, staged
from ledgerline.operators.ids import allocate_ids


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 in ``order``."""
    start = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("_base"))
    return allocate_ids(rows, order, name, start)


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in rows.groupBy("shard").count().collect()}  # one row per shard
    return [found.get(s, 0) for s in range(shards)]


def _pick(values: list[int], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), by.cast("int") + 1)


def propagate(linked: DataFrame, shards: int, capacity: list[int], rounds: int) -> DataFrame:
    """Label propagation over linked rows (``row``, ``gid``, ``shard``) until no row wants to move; neighbours share ``gid``.

    A round counts each group's rows per shard. The group's target is the shard
    with most of its rows among those with room; rows in its weaker shards want
    to go there. A target takes only as many as it has room for: a hash of (row,
    round) picks that share of the movers. Groups are handled as (group, shard)
    counts, never as pairs of rows. A round fills about one shard of a large group;
    ``rounds`` only bounds their number.
    """
    for r in range(rounds):
        loads = _loads(linked, shards)
        room = [max(0, c - n) for c, n in zip(capacity, loads)]
        cells = staged(linked.groupBy("gid", "shard").agg(F.count("*").alias("n")), "shard-cells")
        force = F.struct("n", F.xxhash64("gid", "shard").alias("tie"), "shard")
        open_shards = [s for s in range(shards) if room[s] > capacity[s] // 20]  # the last twentieth is filled afterwards
        targets = cells.filter(F.col("shard").isin(open_shards)).groupBy("gid").agg(F.max(force).alias("to"))
        moving = staged(cells.join(targets, "gid").filter(force < F.col("to"))
                        .select("gid", "shard", "n", F.col("to.shard").alias("to")), "shard-moves")
        wish = {t[0]: t[1] for t in moving.groupBy("to").agg(F.sum("n")).collect()}  # one row per shard
        if not wish:
            break
        share = [min(1.0, room[s] / wish[s]) if s in wish else 0.0 for s in range(shards)]
        take = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("to") + 1)
        draw = F.pmod(F.xxhash64("row", F.lit(r)), F.lit(1 << 30)) / float(1 << 30)
        moved = (join_groups(linked, moving, ["gid", "shard"], "n")
                 .select("row", "gid", F.when(draw < take, F.col("to")).otherwise(F.col("shard")).alias("shard")))
        still = linked.join(moving.select("gid", "shard"), ["gid", "shard"], "left_anti").select("row", "gid", "shard")
        linked = staged(moved.unionByName(still), "shard-labels")
    return linked


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` in one shard: id, ``size``, ``text_crc32``, ``shard``, ``slot``; rows per shard differ by one at most.

    Documents are linked when their texts are equal (a null text counts as
    empty). Linked rows start in a shard picked by a hash and move by
    :func:`propagate`; rows without a link cost nothing wherever they lie, so
    they -- and linked rows beyond a shard's quota -- fill the shards to the exact
    quota afterwards. A group larger than a shard's quota is split over as few
    shards as room allows; propagation ends when no row wants to move, or after
    ``rounds`` (by default two a shard and six more). ``slot`` numbers a shard's rows from 0 without gaps,
    copies next to each other. ``size`` is the UTF-8 length plus 1 (null: 1).

    Edge cases: rows that repeat are linked rows of their own; fewer rows than
    shards leave shards empty; empty input gives no rows; other columns are ignored.
    """
    text = body(text_col)
    rows = staged(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("gid"))
                  .withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = staged(rows.groupBy("gid").agg(F.count("*").alias("n")).filter("n > 1"), "shard-groups")
    first = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    linked = propagate(staged(join_groups(rows.select("row", "gid"), groups, ["gid"], "n").select("row", "gid", first), "shard-labels"),
                       shards, quota, 2 * shards + 6 if rounds is None else rounds)

    loads = _loads(linked, shards)
    placed = (_ranked(linked, ["shard", "gid", "row"], "rank")
              .withColumn("slot", F.col("rank") - _pick([0, *accumulate(loads)][:shards], F.col("shard"))))
    fits = F.col("slot") < _pick(quota, F.col("shard"))
    placed = staged(placed.select("row", "gid", F.when(fits, F.col("shard")).alias("shard"), F.when(fits, F.col("slot")).alias("slot")),
                    "shard-placed")
    kept = [min(n, q) for n, q in zip(loads, quota)]
    # what is left: linked rows beyond a quota first, copies together, then rows without a link
    left = (placed.filter("shard IS NULL").select(F.lit(0).alias("late"), "gid", "row")
            .unionByName(rows.join(groups.select("gid"), "gid", "left_anti").select(F.lit(1).alias("late"), "gid", "row")))
    ends = list(accumulate(q - k for q, k in zip(quota, kept)))
    rank = F.col("rank")
    shard = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        shard = F.when(rank < ends[s], F.lit(s)).otherwise(shard)
    filled = (_ranked(left, ["late", "gid", "row"], "rank").select("row", "rank", shard.alias("shard"))
              .select("row", "shard", (rank - _pick([0, *ends][:shards], F.col("shard")) + _pick(kept, F.col("shard"))).alias("slot")))
    where = placed.filter("shard IS NOT NULL").select("row", "shard", "slot").unionByName(filled)
    return rows.join(where, "row").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
