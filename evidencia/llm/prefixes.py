"""Prefix tree of conversations by owned chains.

Each conversation's prefixes get 128-bit digests that grow turn by turn. Per depth and digest the
smallest conversation owns the node; as the members of a longer prefix are among those of a
shorter one, a conversation owns all its prefixes from one depth on. That depth is found by
binary search: in each round all open conversations look their middle prefix up in the table of
owners. What a conversation owns is a chain, which hangs below the owner of the prefix just
above. Sums over subtrees are passed from chains without open chains below them to their parents,
round by round, and within a chain from its end upwards.

Rounds of the search grow with the logarithm of the longest conversation, those of the sums with the
number of chains that hang below one another, which no conversation's number of turns exceeds.
Prefixes that a 4,096th of all rows share (4,096 of them at most) are looked up in a broadcast table,
so that no task gets all conversations of a frequent beginning; the others in an equi-join.

Turns are in order of turn (null first), role and text. Null roles and texts count as empty; rows
without a conv_id belong to no conversation. Repeated rows are turns of their own. Other columns are
ignored. Long texts enter by their digest and length alone. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_ready, batch, cut, lean, stored

#: A prefix with at least one row in so many is frequent; no more than so many are.
FREQUENT = 4096
#: Conversations are numbered in runs of two to this power when ids are joined to texts.
RUN_BITS = 12


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), 120 bits of the digest of role and text in two numbers, and the text's bytes."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    return rows.select("conv_id", place.alias("place"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")).select("conv_id", "place", part(1).alias("high"), part(16).alias("low"), "bytes")


def regrown(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations whose first turns are those of the first of their family: turns as ``turns`` gives them, and a row
    with place 0 for every conversation.

    Conversation c begins with the first h turns of c - c % family, where h = crc32(decimal c) % most, and goes on with its
    own turns after its first h."""
    own = stored(turns(conversations), "turns")
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("length"))
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("head")
    firsts = lengths.select(F.col("conv_id").alias("first"), F.col("length").alias("first_length"))
    convs = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("first"), heads).join(firsts, "first", "left")
    convs = convs.select("conv_id", "first", "head", F.least("head", F.coalesce("first_length", F.lit(0))).alias("taken"))
    shared = own.where(F.col("place") < most).withColumnRenamed("conv_id", "first").join(convs, "first").where("place <= head").select("conv_id", "place", "high", "low", "bytes")
    rest = own.join(convs, "conv_id").where("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "high", "low", "bytes")
    zero = F.lit(0).cast("long")
    return shared.unionByName(rest).unionByName(convs.select("conv_id", zero.alias("place"), zero.alias("high"), zero.alias("low"), zero.alias("bytes")))


class Owners:
    """The smallest conversation of each prefix, its number of members, and a lookup by depth and digest."""

    def __init__(self, digests: DataFrame):
        members = digests.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
        self.table = stored(members, "owners")
        rows = self.table.agg(F.sum("n_convs")).first()[0] or 0
        self.frequent = F.broadcast(self.table.where(F.col("n_convs") * FREQUENT >= rows).select("depth", "a", "b", F.col("owner").alias("known")))  # FREQUENT rows at most

    def of(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (conv_id, depth, a, b, ...) with the owner of its prefix; null where there is none."""
        # those that are known already go anywhere, so that they don't meet in one task
        rows = wanted.join(self.frequent, ["depth", "a", "b"], "left").withColumn("a", F.when(F.col("known").isNull(), F.col("a")).otherwise(F.xxhash64("conv_id")))
        met = rows.join(self.table.select("depth", "a", "b", "owner"), ["depth", "a", "b"], "left")
        return met.withColumn("owner", F.coalesce("known", "owner")).drop("known", "a", "b")


def owned_chains(digests: DataFrame, owners: Owners) -> DataFrame:
    """conv_id, length, first owned depth (length + 1 if it owns none) and the owner of the prefix above that depth."""
    state = digests.groupBy("conv_id").agg(F.max("depth").alias("length")).select("conv_id", "length", F.lit(0).cast("long").alias("low"), (F.col("length") + 1).alias("high"))
    longest = state.agg(F.max("length")).first()[0]
    at = digests.select("conv_id", "depth", "a", "b")
    for _ in range(ceil(log2(longest + 2)) if longest is not None else 0):
        probes = state.withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2)).join(at, ["conv_id", "depth"], "left")
        found, open_ = owners.of(probes), F.col("low") < F.col("high")
        owned = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(False))
        state = cut(found.select("conv_id", "length", F.when(open_ & ~owned, F.col("depth") + 1).otherwise(F.col("low")).alias("low"), F.when(open_ & owned, F.col("depth")).otherwise(F.col("high")).alias("high")))
    above = state.select("conv_id", "length", F.col("low").alias("first"), (F.col("low") - 1).alias("depth")).join(at, ["conv_id", "depth"], "left")
    return cut(owners.of(above).select("conv_id", "length", "first", F.col("owner").alias("parent")))


def bottom_up(chains: DataFrame) -> DataFrame:
    """``chains`` (conv_id, parent, at, leaves, saved) with leaves and saved summed over the chains below."""
    done, rest = [], cut(chains.select("conv_id", "parent", "at", "leaves", "saved"))
    while True:
        waiting = rest.where("parent is not null").groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("waits"))
        state = cut(rest.join(waiting, "conv_id", "left"))
        ready = state.where("waits is null").drop("waits")
        done.append(ready)
        rest = state.where("waits is not null").drop("waits")
        if rest.isEmpty():
            break
        sums = ready.groupBy(F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        rest = rest.join(sums, "conv_id", "left").select("conv_id", "parent", "at", more("leaves"), more("saved"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def joined_ids_digest(members: DataFrame) -> DataFrame:
    """owner, depth and the SHA-256 of the ascending, comma-joined conv_ids of members (owner, depth, conv_id).

    Ids are joined in runs of 2 ** RUN_BITS numbers at most. Where a node has more members than a run, a task
    takes its runs in order into one running digest, so that no row holds them all."""
    runs = members.groupBy("owner", "depth", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    sizes = Window.partitionBy("owner", "depth")
    sized = cut(runs.withColumn("members", F.sum("n").over(sizes)))
    small = sized.where(F.col("members") <= 1 << RUN_BITS).groupBy("owner", "depth").agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("runs"))
    small = small.select("owner", "depth", F.sha2(F.array_join(F.transform("runs", lambda r: r["ids"]), ","), 256).alias("ends_sha256"))
    schema = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def digested(batches):
        node, digest = None, None
        for b in batches:
            out = []
            for owner, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if node != (owner, depth):
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (owner, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield batch(schema, **{n: [o[i] for o in out] for i, n in enumerate(schema.names)})
        if node:
            yield batch(schema, owner=[node[0]], depth=[node[1]], ends_sha256=[digest.hexdigest()])

    arrow_ready(members.sparkSession)
    large = sized.where(F.col("members") > 1 << RUN_BITS).repartition("owner", "depth").sortWithinPartitions("owner", "depth", "run").select("owner", "depth", "ids")
    return small.unionByName(large.mapInArrow(lean(digested), "owner long, depth long, ends_sha256 string"))


def prefix_tree(grown: DataFrame) -> DataFrame:
    """One row for each node of the tree of turns (conv_id, place, high, low, bytes): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256."""
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # the digest of a prefix is the sum, without carries, of its turns' digests, in which their places are
    of = lambda seed: F.bit_xor(F.when(F.col("place") > 0, F.xxhash64(F.lit(seed), "place", "high", "low")).otherwise(F.lit(0).cast("long"))).over(so_far)
    digests = stored(grown.select("conv_id", F.col("place").cast("long").alias("depth"), of(1).alias("a"), of(2).alias("b"), "bytes"), "digests")
    owners = Owners(digests)
    chains = owned_chains(digests, owners)
    owning = chains.where("first <= length")
    nodes = owners.table.join(owning, F.col("owner") == F.col("conv_id")).where("depth >= first").select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"), "first", "length", "parent")
    nodes = stored(nodes, "nodes")
    hanging = owning.where("first > 0").select(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).groupBy("conv_id", "depth").agg(F.count("*").alias("chains"))
    ends = nodes.where("depth = length").join(hanging, ["conv_id", "depth"], "left").select("conv_id", F.when(F.col("chains").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    sums = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.first("parent").alias("parent"), (F.first("first") - 1).alias("at"))
    totals = bottom_up(sums.join(ends, "conv_id"))
    below = totals.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("chains"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    last = F.col("depth") == F.col("length")
    leaves = F.coalesce("leaves", F.when(last, 1).cast("long"), zero)
    summed = nodes.join(below, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("chains", zero) + F.when(last, 0).otherwise(1)).alias("n_children"), F.sum(leaves).over(upwards).alias("n_leaves"), F.sum(F.col("own") + F.coalesce("saved", zero)).over(upwards).alias("saved_tokens"),
    )
    ended = chains.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("length").alias("depth"), "conv_id")
    digest = joined_ids_digest(ended).withColumnRenamed("owner", "conv_id")
    return summed.join(digest, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
