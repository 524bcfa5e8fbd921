"""Balanced label propagation: linked documents gather in shards of even size.

Documents start in the shard of their hash. In each round every group of linked documents votes,
by the bytes it has in each shard, and members in shards with less of it ask to move to the
winner. Two shards exchange as many linked documents as both ways ask for, and beyond that a
shard takes as many as its quota has room for. Rounds go on until fewer than one linked document
in ten thousand may move. A group larger than a shard first fills as many whole shards as it can; only
its rest goes through the rounds, as one piece. Documents without links have no say and make
room: at the end shards that hold more than their share give up what comes last in their order,
those first, and shards that hold less take it, so counts differ by one at most. Only counts by
shard, by partition and of groups larger than a shard come to the driver.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small
from .components import connected_components

#: Share of linked documents that a round must move for another to follow.
DONE = 1e-4
#: Steps by which asking groups are let in, in order of their hash.
_BINS = 1024


def groups_of_equal_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, g1, g2): g1 and g2 are the same for equal texts; null text: empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(7), text).alias("g2"))


def linked_groups(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, to): one group for each document of links (doc_id, group); groups that share a document are one."""
    pairs = scratch.write(links.select(F.col("doc_id").cast("long"), F.col("group").cast("string").alias("to")).where("to IS NOT NULL").distinct(), "links")
    least = pairs.groupBy("doc_id").agg(F.min("to").alias("u"), F.count("*").alias("n"))
    ties = pairs.join(least.where("n > 1"), "doc_id").select("u", F.col("to").alias("v"))
    label = connected_components(ties, scratch, "linked").toDF("u", "label")
    return least.join(label, "u", "left").select("doc_id", F.coalesce("label", "u").alias("to"))


def _share(salt: int, *cols: str) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 20)) / float(1 << 20)


def ranked(rows: DataFrame, group: str, order: list, scratch: Scratch, name: str) -> tuple[DataFrame, dict[int, int]]:
    """rows with rank, the place from 0 among the rows of a group (a number) in the given order; and the groups' sizes.

    Sorted by ranges; a group's rows may lie in many. What is gathered are counts, one for each
    partition and one more for each group."""
    rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.write(rows, name)
    rows = rows.withColumn("part", F.shiftright("row", 33)).withColumn("at", F.col("row").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("part", group).agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()
    total, table = defaultdict(int), []
    for r in sorted(counts, key=lambda r: r.part):
        table.append((r.part, r[group], total[r[group]] - r.first))
        total[r[group]] += r.n
    before = small(rows.sparkSession.createDataFrame(table, f"part long, {group} int, before long"))
    return rows.join(before, ["part", group]).withColumn("rank", F.col("at") + F.col("before")).drop("row", "part", "at", "before"), dict(total)


def _fill(rows: DataFrame, giants: list, quota: int, shards: int, scratch: Scratch) -> tuple[DataFrame, int, dict[int, int]]:
    """Rows of groups larger than a shard with their shard, how many shards (from 0) they fill, and the size of what is
    left of each group; those rows have the group's number, negative and from -1 down, as their shard."""
    table, first = [], 0
    for i, g in enumerate(giants):
        whole = min(g.members // quota, shards - first)
        table.append((g.g1, g.g2, i, g.members, first, whole))
        first += whole
    known = rows.sparkSession.createDataFrame(table, "g1 long, g2 long, giant int, members long, first int, whole int")
    held = rows.join(F.broadcast(known), ["g1", "g2"])  # a row for each shard at most
    held, _ = ranked(held, "giant", [F.xxhash64("doc_id"), "doc_id"], scratch, "giants")
    block = F.floor(F.col("rank") / quota).cast("int")
    held = held.withColumn("shard", F.when(block < F.col("whole"), F.col("first") + block).otherwise(-1 - F.col("giant")))
    rest = {i: m - w * quota for _, _, i, m, _, w in table if m > w * quota}
    return held.select(*rows.columns, "members", "shard"), first, rest


def _granted(asks: DataFrame, free: DataFrame) -> DataFrame:
    """(shard, to, bin, n, share): of asks (shard, to, bin, n rows), the share that may move.

    Two shards exchange as many as both ways ask for; what is asked beyond that shares the room
    that a shard has. Bins are let in one after the other, the last one in part. Small tables all:
    a row for each two shards, times bins."""
    flows = asks.groupBy("shard", "to").agg(F.sum("n").alias("all"))
    back = flows.toDF("to", "shard", "back")
    flows = flows.join(back, ["shard", "to"], "left").withColumn("swap", F.least("all", F.coalesce("back", F.lit(0))))
    flows = flows.join(F.broadcast(free.withColumnRenamed("shard", "to")), "to").withColumn("rest", F.col("all") - F.col("swap"))
    room = F.col("free") * F.col("rest") / F.greatest(F.lit(1), F.sum("rest").over(Window.partitionBy("to")))
    flows = flows.select("shard", "to", (F.col("swap") + F.least(F.col("rest"), room)).alias("most"))
    before = F.sum("n").over(Window.partitionBy("shard", "to").orderBy("bin")) - F.col("n")
    asks = asks.withColumn("before", before).join(F.broadcast(flows), ["shard", "to"])
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("most") - F.col("before")) / F.col("n")))
    return asks.select("shard", "to", "bin", "n", share.alias("share")).where("share > 0")


def propagate(rows: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """rows (doc_id, size, g1, g2, …) with their shard after the rounds, and members: the group's rows."""
    quota = max(1, rows.count() // shards)
    sizes = scratch.write(rows.groupBy("g1", "g2").agg(F.count("*").alias("members")), "sizes")
    giants = sizes.where(F.col("members") > quota).orderBy(F.desc("members"), "g1", "g2").collect()  # fewer than two for each shard
    whole, full = None, 0
    if giants:
        held, full, rest = _fill(rows, giants, quota, shards, scratch)
        loads, home = [0] * max(1, shards - full), {}
        for i, n in sorted(rest.items(), key=lambda x: -x[1]):  # the largest first, into the emptiest shard
            to = loads.index(min(loads))
            loads[to] += n
            home[-1 - i] = min(full, shards - 1) + to
        at = F.col("shard")
        for a, b in home.items():
            at = F.when(F.col("shard") == a, b).otherwise(at)
        whole = scratch.write(held.withColumn("shard", at.cast("int")), "whole")
        gone = rows.sparkSession.createDataFrame([(g.g1, g.g2) for g in giants], "g1 long, g2 long")
        rows = rows.join(F.broadcast(gone), ["g1", "g2"], "left_anti")
    open_ = max(1, shards - full)
    rows = rows.join(sizes, ["g1", "g2"]).withColumn("shard", (F.lit(min(full, shards - 1)) + F.pmod(F.xxhash64("doc_id", "g1"), F.lit(open_))).cast("int"))
    rows = scratch.write(rows, "labels")
    fixed = None if whole is None else whole.where(F.col("shard") >= full).groupBy("shard").agg(F.count("*").alias("held"))
    every = rows.sparkSession.range(full, shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).alias("zero"))
    if fixed is not None:
        every = scratch.write(every.join(fixed, "shard", "left").select("shard", F.coalesce("held", "zero").alias("zero")), "every")
    turn, all_linked = 0, rows.where("members > 1").count()
    while all_linked:
        linked = rows.where("members > 1")
        load = linked.groupBy("shard").agg(F.count("*").alias("load"))
        free = every.join(load, "shard", "left").select("shard", F.greatest(F.lit(0), quota - F.col("zero") - F.coalesce("load", F.lit(0))).alias("free"))
        votes = scratch.write(linked.groupBy("g1", "g2", "shard").agg(F.sum("size").alias("w"), F.count("*").alias("n")), "votes")
        best = votes.groupBy("g1", "g2").agg(F.max(F.struct("w", F.xxhash64("g1", "shard").alias("h"), "shard"))["shard"].alias("to"))
        # who asks: members of a group in any shard but that with most of it
        bin_ = F.floor(_share(turn, "g1", "g2") * _BINS).cast("int")
        asks = scratch.write(votes.join(best, ["g1", "g2"]).where("shard <> to").select("g1", "g2", "shard", "to", "n", bin_.alias("bin")), "asks")
        grant = scratch.write(_granted(asks.groupBy("shard", "to", "bin").agg(F.sum("n").alias("n")), free), "grant")
        if (grant.agg(F.sum(F.col("share") * F.col("n"))).first()[0] or 0) <= DONE * all_linked:
            break
        moves = asks.drop("n").join(F.broadcast(grant.drop("n")), ["shard", "to", "bin"]).drop("bin")  # at most a row for each two shards and bin
        rows = rows.join(small(scratch.write(moves, "moves")), ["g1", "g2", "shard"], "left")
        goes = F.col("to").isNotNull() & (_share(turn + 100, "doc_id", "g2") < F.col("share"))
        rows = rows.withColumn("shard", F.when(goes, F.col("to")).otherwise(F.col("shard"))).drop("to", "share")
        rows = scratch.write(rows, "labels")
        turn += 1
    return rows if whole is None else rows.unionByName(whole)


def even_out(rows: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """rows with final shard and slot: counts at most one apart, slots from 0 without gaps."""
    order = [F.when(F.col("members") > 1, 0).otherwise(1), "g1", "g2", F.xxhash64("doc_id"), "doc_id"]
    rows, sizes = ranked(rows, "shard", order, scratch, "sorted")
    held = [sizes.get(s, 0) for s in range(shards)]
    total = sum(held)
    more = set(sorted(range(shards), key=lambda s: -held[s])[: total % shards])  # the fullest keep one more
    quota = [total // shards + (s in more) for s in range(shards)]
    over = [0, *accumulate(max(0, h - q) for h, q in zip(held, quota, strict=True))]
    need = [0, *accumulate(max(0, q - h) for h, q in zip(held, quota, strict=True))]
    table = rows.sparkSession.createDataFrame(list(zip(range(shards), quota, over, strict=False)), "shard int, quota long, over long")
    longs = lambda x: F.array(*[F.lit(v).cast("long") for v in x])
    rows = rows.join(F.broadcast(table), "shard")  # a row a shard
    rows = rows.withColumn("extra", F.when(F.col("rank") >= F.col("quota"), F.col("over") + F.col("rank") - F.col("quota")))
    to = F.size(F.filter(longs(need[1:]), lambda e: e <= F.col("extra")))
    rows = rows.withColumn("to", F.when(F.col("extra").isNotNull(), to))
    moved = F.get(longs(held), F.col("to")) + F.col("extra") - F.get(longs(need), F.col("to"))
    return rows.withColumn("shard", F.coalesce("to", "shard")).withColumn("slot", F.coalesce(moved, F.col("rank")))


def shard(docs: DataFrame, *, shards: int = 40, links: DataFrame | None = None) -> DataFrame:
    """Shards of documents by the law `rows`; documents with equal texts are linked, or those that links joins.

    links: doc_id and group, a row for each group that a document is in (a near-duplicate class, a
    source); groups that share a document are one, documents without a row stand alone.

    Returns doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law, shard, slot,
    grown_shard (null under this law), members (rows of the document's group). Null text: empty.
    A group of more rows than a shard lies in as few shards as can hold it, or one more. Repeated
    rows have slots of their own; a null doc_id is placed like any other; very long texts count
    whole; an empty table gives no rows; other columns are ignored, whatever their names."""
    scratch = Scratch(docs.sparkSession, "shards")
    rows = groups_of_equal_texts(docs)
    if links is not None:
        to = linked_groups(links, scratch)
        own = F.coalesce(F.concat(F.lit("group:"), F.col("to")), F.concat(F.lit("alone:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        rows = rows.join(to, "doc_id", "left").withColumn("g1", F.xxhash64(own)).withColumn("g2", F.xxhash64(F.lit(7), own)).drop("to")
    rows = scratch.write(rows, "documents")
    if rows.isEmpty():
        kind = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, members long"
        return rows.sparkSession.createDataFrame([], kind)
    placed = scratch.write(propagate(rows, shards, scratch), "placed")
    rows = even_out(placed, shards, scratch)
    scratch.drop(*(n for n in list(scratch.paths) if n not in ("placed", "sorted")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "members")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
