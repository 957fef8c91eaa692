"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked. Linked documents start on a shard given by their hash and then move, over a few
rounds of joins, towards the shard that holds most bytes of their group, as far as that shard's quota of free bytes
allows; single documents have no links and fill every shard up to the common size at the end. Quotas and places are
prefix sums over hash buckets, so no task ever sorts a whole shard or group, and a group with a third of all rows is
dealt over many keys in the joins and spread over shards when it exceeds the quota.

Law: `bytes`. The size of a document is its UTF-8 bytes plus 8 (8 for null text).
Defined cases: null text has size 8 and crc32 0, and null texts are not linked. Null and repeated doc_ids are rows of
their own. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved

BUCKETS = 1024
DEAL = 256  # keys that a text's rows are dealt over while their number is not known
SPLIT = 1000  # members of a group for each key that it is dealt over


def _prefix(counts: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """counts with the sum of `value` over the buckets before it; counts has at most BUCKETS rows for each `by`."""
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 4) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of nearly equal bytes, linked documents together where they fit."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))).alias("grp"),
    )
    rows = saved(
        rows.select("*", F.xxhash64("doc_id", "grp.a", F.lit(1)).alias("r")).withColumn("bucket", F.pmod("r", F.lit(BUCKETS)))
    )
    # linked documents: groups of at least two. A text that a third of all rows have is dealt over several keys from the start
    # and counted by them, so that no task gets a group whole
    own = rows.withColumn("deal", F.pmod(F.xxhash64("r", F.lit(8)), F.lit(DEAL)))
    dealt = own.where("grp is not null").groupBy("grp", "deal").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    groups = dealt.groupBy("grp").agg(F.sum("n").alias("members"), F.sum("s").alias("bytes")).where("members > 1")
    known = own.where("grp is not null").join(dealt.select("grp", "deal").join(groups, "grp"), ["grp", "deal"], "left")
    state = known.unionByName(own.where("grp is null"), allowMissingColumns=True).drop("deal").withColumn(
        "shard", F.when(F.col("members").isNotNull(), F.pmod(F.xxhash64("r", F.lit(2)), F.lit(shards)).cast("int"))
    )
    # a large group is dealt over as many keys as it has SPLIT members, so that no task gets it whole
    salts = F.coalesce(F.ceil(F.col("members") / F.lit(SPLIT)), F.lit(64))
    state = saved(state.withColumn("salt", F.pmod(F.xxhash64("r", F.lit(9)), salts).cast("int")))
    forget(rows)
    total = state.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    for step in range(rounds):
        linked = state.where("shard is not null")
        here = linked.groupBy("grp", "members", "shard").agg(F.sum("size").alias("held"))
        # the neighbours' shard: most bytes of the group, ties by a hash that differs from group to group
        want = here.groupBy("grp", "members").agg(F.max_by("shard", F.struct("held", F.xxhash64("grp", "shard").alias("tie"))).alias("goal"))
        every_salt = F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / F.lit(SPLIT)).cast("int") - 1))
        want = want.select("grp", every_salt.alias("salt"), "goal")
        load = linked.groupBy("shard").agg(F.sum("size").alias("load"))
        every = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("goal"))
        room = every.join(load.withColumnRenamed("shard", "goal"), "goal", "left").select(
            "goal", F.greatest(F.lit(target) - F.coalesce("load", F.lit(0)), F.lit(0.0)).alias("room")
        )
        # a group is moved as one where it fits: its hash gives the order in the queue for the goal
        asks = linked.join(want, ["grp", "salt"]).where("shard <> goal").select("grp", "goal", "size", "r")
        asks = asks.withColumn("bucket", F.pmod(F.xxhash64("grp", F.lit(step)), F.lit(BUCKETS)))
        queue = _prefix(asks.groupBy("goal", "bucket").agg(F.sum("size").alias("asked")), ["goal"], "asked", "ahead")
        # whole buckets that fit go; of the first that does not, the share that still fits goes by document hash
        grant = queue.join(F.broadcast(room), "goal").select(
            "goal", "bucket", F.least(F.greatest((F.col("room") - F.col("ahead")) / F.col("asked"), F.lit(0.0)), F.lit(1.0)).alias("share")
        )
        moves = state.join(want, ["grp", "salt"], "left").withColumn("ask_bucket", F.pmod(F.xxhash64("grp", F.lit(step)), F.lit(BUCKETS)))
        grant = grant.select("goal", F.col("bucket").alias("ask_bucket"), "share")
        moves = moves.join(F.broadcast(grant), ["goal", "ask_bucket"], "left")  # at most shards * BUCKETS rows
        coin = F.pmod(F.xxhash64("r", F.lit(100 + step)), F.lit(1_000_003)) / F.lit(1_000_003.0)
        goes = F.col("shard").isNotNull() & (F.col("shard") != F.col("goal")) & (coin < F.coalesce("share", F.lit(0.0)))
        before, state = state, saved(moves.withColumn("shard", F.when(goes, F.col("goal")).otherwise(F.col("shard"))).select(*state.columns))
        forget(before)
    return _slots(_even_out(state, shards, total))


def _even_out(state: DataFrame, shards: int, total: int) -> DataFrame:
    """Cuts what exceeds the common size and lays it, with all single documents, into the free bytes of the shards.

    Everything without a shard is put in one order, by bucket and place in the bucket; a document goes to the shard
    whose free interval holds the middle of its own. So each shard ends within about one document of the common size.
    """
    spark = state.sparkSession
    target = total / shards
    # 1. beyond the target, documents leave in the order of groups, so that few groups are cut
    state = state.withColumn("cut_bucket", F.pmod(F.xxhash64("grp", F.lit(5)), F.lit(BUCKETS)))
    held = state.where("shard is not null")
    stack = _prefix(held.groupBy("shard", F.col("cut_bucket").alias("bucket")).agg(F.sum("size").alias("held")), ["shard"], "held", "below")
    stay = stack.select(
        "shard", F.col("bucket").alias("cut_bucket"), F.least(F.greatest((F.lit(target) - F.col("below")) / F.col("held"), F.lit(0.0)), F.lit(1.0)).alias("stay")
    )
    coin = F.pmod(F.xxhash64("r", F.lit(6)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    state = saved(
        state.join(F.broadcast(stay), ["shard", "cut_bucket"], "left")
        .withColumn("shard", F.when(coin < F.col("stay"), F.col("shard")))
        .drop("stay", "cut_bucket")
    )
    load = state.where("shard is not null").groupBy("shard").agg(F.sum("size").alias("load"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    free = every.join(load, "shard", "left").withColumn("free", F.greatest(F.lit(target) - F.coalesce("load", F.lit(0)), F.lit(0.0)))
    w = Window.partitionBy(F.lit(0)).orderBy("shard")  # one row a shard
    free = free.withColumn("upto", F.sum("free").over(w)).withColumn("from", F.col("upto") - F.col("free"))
    pool = free.agg(F.max("upto")).first()[0] or 0.0
    loose = state.where("shard is null").drop("shard")
    ahead = _prefix(loose.groupBy("bucket").agg(F.sum("size").alias("bytes_in")).withColumn("one", F.lit(0)), ["one"], "bytes_in", "ahead")
    left = loose.agg(F.sum("size")).first()[0] or 0
    scale = pool / left if left else 1.0
    inner = Window.partitionBy("bucket").orderBy("r", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = loose.join(F.broadcast(ahead.select("bucket", "ahead")), "bucket").withColumn(
        "at", (F.col("ahead") + F.sum("size").over(inner) - F.col("size") / 2) * F.lit(scale)
    )
    # one bound a shard: the first whose upper bound lies above
    bounds = F.array(*[F.lit(float(x["upto"])) for x in free.orderBy("shard").collect()])
    shard = F.least(F.size(F.filter(bounds, lambda b: b <= F.col("at"))), F.lit(shards - 1))
    placed = placed.withColumn("shard", shard.cast("int"))
    keep = ["doc_id", "size", "text_crc32", "r", "bucket", "shard"]
    return saved(placed.select(keep).union(state.where("shard is not null").select(keep)))


def _slots(state: DataFrame) -> DataFrame:
    """Gapless places in each shard: rows in the buckets before plus the place in the bucket."""
    before = _prefix(state.groupBy("shard", "bucket").agg(F.count("*").alias("n")), ["shard"], "n", "before")
    inner = Window.partitionBy("shard", "bucket").orderBy("r", "doc_id", "size", "text_crc32")
    return state.join(F.broadcast(before.select("shard", "bucket", "before")), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.row_number().over(inner) - 1).alias("slot")
    )
