"""Sharding by balanced label propagation.

Documents of equal text are linked.  They start in shards dealt by hash; in each
round a join tells every linked document which shard holds most of its group, and
it moves there with the probability that the shard's quota leaves room for all
that ask.  A group larger than a shard is given several whole shards at once.
At last the law ``rows`` is made exact: each shard keeps linked documents first
up to its quota, and what is over fills the shards that are short.

Only figures by shard, by partition and of groups larger than a shard (at most
as many as shards) reach the driver.

Defined cases: null text has size 16, checksum 0 and no group; repeated rows are
rows of their own and, sharing a text, linked; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, join_by_key, release, shuffle_partitions, staged, table

SHARDS = 40
ROUNDS = 3
OVERHEAD = 16


def _pick(values: list[int], at: Column) -> Column:
    return F.get(F.lit([int(v) for v in values]), at)


def _unit(*cols: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def propagate(linked: DataFrame, n_rows: int, shards: int, rounds: int) -> tuple[DataFrame, list[str]]:
    """Moves the rows ``doc_id, group, shard`` of linked documents; at most n_rows / shards of them end in a shard by design."""
    spark, cap = linked.sparkSession, max(1, n_rows // shards)
    now, path = staged(linked, "linked")
    sizes = now.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    large = sorted(((r["n"], r["group"]) for r in sizes.where(F.col("n") > cap).collect()), reverse=True)  # at most ``shards`` rows
    given: dict[str, list[int]] = {}
    free = list(range(shards))
    for n, group in large:
        take = min(-(-n // cap), len(free))
        given[group], free = (free[:take], free[take:]) if take else ([shards - 1], free)
    given_to = [0] * shards
    for n, group in large:
        for to in given[group]:
            given_to[to] += n // len(given[group])
    small = ~F.col("group").isin(list(given)) if given else F.lit(True)
    for turn in range(rounds):
        cells = now.where(small).groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
        held = list(given_to)
        for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            held[r["shard"]] += r["n"]
        # Shards with room first, then most of the group; a hash breaks ties, or low shards would be asked most.
        has_room = F.get(F.lit([int(h < cap) for h in held]), F.col("shard"))
        rank = F.struct(has_room.alias("r"), "n", F.xxhash64("group", "shard").alias("h"), "shard")
        best = cells.groupBy("group").agg(F.max(rank).alias("x"), F.sum("n").alias("_n")).select("group", F.col("x.shard").alias("target"), "_n")
        wanted = [0] * shards
        moves = cells.join(best.drop("_n"), "group").where("shard <> target").groupBy("shard", "target").agg(F.sum("n").alias("n"))
        for r in moves.collect():  # shards x shards at most
            wanted[r["target"]] += r["n"]
            held[r["shard"]] -= r["n"]
        room = [min(1.0, max(0, cap - h) / w) if w else 1.0 for h, w in zip(held, wanted)]
        best, best_path = staged(best, "targets")
        # Groups larger than a shard have their places by now and don't join.
        rows = join_by_key(now.where(small), best, "group", n_rows, "left").unionByName(now.where(~small).withColumn("target", F.lit(None).cast("int")))
        goes = _unit("group", "shard", F.lit(turn)) < F.get(F.lit([float(x) for x in room]), F.col("target"))
        shard = F.when(goes, F.col("target")).otherwise(F.col("shard"))
        for group, to in given.items():
            shard = F.when(F.col("group") == group, _pick(to, F.pmod(F.xxhash64("doc_id"), F.lit(len(to))).cast("int"))).otherwise(shard)
        nxt, nxt_path = staged(rows.select("doc_id", "group", shard.cast("int").alias("shard")), "linked")
        drop_path(spark, path)
        drop_path(spark, best_path)
        now, path = nxt, nxt_path
    return now, [path]


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` with counts of the shards at most one apart."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.col("text").cast("binary")).alias("group"),
    )
    base, base_path = staged(rows, "base")
    n_rows = base.count()
    dealt = F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int")
    shared = base.where(F.col("group").isNotNull()).groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    shared, shared_path = staged(shared, "groups")
    keys = base.join(shared, "group", "left_semi").select("doc_id", "group", dealt.alias("shard"))
    moved, paths = propagate(keys.groupBy("doc_id", "group", "shard").agg(F.count(F.lit(1)).alias("_n")).select("doc_id", "group", "shard"), n_rows, shards, rounds)
    # A row's place follows from doc_id and group alone, so repeated rows move together.
    moved = moved.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("group").alias("_group"), F.col("shard").alias("_to"))
    same = (F.coalesce(base["doc_id"], F.lit(-1)) == F.col("_id")) & (base["doc_id"].isNull() == F.col("_null")) & (base["group"] == F.col("_group"))
    placed = base.join(moved, same, "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("_to", dealt).alias("shard"), F.col("_to").isNull().alias("loose"), "group")
    ordered = placed.repartitionByRange(shuffle_partitions(spark), "shard", "loose", "group", "doc_id").sortWithinPartitions("shard", "loose", "group", "doc_id")
    ranked, _ = staged(ordered.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("place")), "ranked")
    for path in [base_path, shared_path, *paths]:
        drop_path(spark, path)
    release(spark)
    part = F.shiftright("place", 33).cast("int")
    counts = ranked.groupBy(part.alias("part"), "shard").agg(F.count(F.lit(1)).alias("n")).collect()  # partitions + shards rows at most
    return _filled(ranked, counts, n_rows, shards)


def _filled(ranked: DataFrame, counts: list, n_rows: int, shards: int) -> DataFrame:
    """Keeps each shard's first rows up to its quota and deals the rest to the shards that are short."""
    in_shard, in_part = [0] * shards, {}
    for r in counts:
        in_shard[r["shard"]] += r["n"]
        in_part[r["part"]] = in_part.get(r["part"], 0) + r["n"]
    quota = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    before = dict(zip(sorted(in_part), accumulate((in_part[p] for p in sorted(in_part)), initial=0)))
    starts = list(accumulate(in_shard, initial=0))
    over = [max(0, n - q) for n, q in zip(in_shard, quota)]
    over_start = list(accumulate(over, initial=0))
    short = [(s, quota[s] - in_shard[s]) for s in range(shards) if in_shard[s] < quota[s]]
    ends = list(accumulate(n for _, n in short))
    spark = ranked.sparkSession
    parts = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(p).alias("_part"), F.lit(b).cast("long").alias("_before")) for p, b in before.items()]))) if before else spark.range(0).select(F.col("id").cast("int").alias("_part"), F.col("id").alias("_before"))
    rows = ranked.join(F.broadcast(parts), F.shiftright("place", 33).cast("int") == F.col("_part"))
    rows = rows.withColumn("slot", F.col("_before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) - _pick(starts, F.col("shard")))
    extra = F.col("slot") - _pick(quota, F.col("shard"))
    rows = rows.withColumn("_over", F.when(extra >= 0, _pick(over_start, F.col("shard")) + extra))
    if not short:
        return rows.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
    filled = F.size(F.filter(F.lit([int(e) for e in ends]), lambda e: e <= F.col("_over")))
    to = _pick([s for s, _ in short], filled)
    slot = _pick([in_shard[s] - (e - n) for (s, n), e in zip(short, ends)], filled) + F.col("_over")
    stays = F.col("_over").isNull()
    shard, slot = F.when(stays, F.col("shard")).otherwise(to), F.when(stays, F.col("slot")).otherwise(slot)
    return rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
