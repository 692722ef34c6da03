"""Sharding: balanced label propagation, with a levelling cut where that leaves shards uneven.

Documents of equal text are linked. Each starts in a shard by the hash of its id, and the documents of a group vote for
shards with their bytes. A group takes as few shards as it needs; documents that nothing links give way, as moving them
parts nothing. First come groups of a LARGE-th of a shard or more, of which there are LARGE for each shard at most: largest
first, each goes to the shard of most votes that has room for all of it. Where none has, it takes the most room that there
is, whole shards as long as there are any, until one shard has room for the rest. Smaller groups queue for the shard that
they voted for, in ROUNDS rounds; those left are laid along the remaining room of all shards, and the few that a shard's
end would part are placed like large ones. The unlinked documents fill what is left. Should a shard then be more than one
document from its share (documents about as large as a shard), all rows are laid out by (label, group) and cut where the
running sum of sizes passes a multiple of the share. Running sums go through sums of buckets of about 20,000 rows, so no
task gets a whole shard or a whole hot group. All of it is DataFrame functions but the placing of large groups.

Null texts have no bytes and are one group of their own. Every row gets a slot: rows without an id and repeated rows too.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, buckets_for, running, settle, unsettle

#: Bytes that each document counts beside its text's.
OVERHEAD = 16
ROUNDS = 4
#: Groups of this part of a shard or more are placed one by one, by the driver.
LARGE = 64


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    )


def place(groups: list, room: list[float]) -> list[tuple]:
    """Pieces (g, text_crc32, size, n, from, to, target) of groups (rows with n and at, the votes), largest first: rows from to
    to of a group go to target. Takes what is placed off room."""
    pieces = []
    for x in sorted(groups, key=lambda x: (-x["size"] * x.n, x.g, x.text_crc32)):
        votes, size, done = {v.label: v.c for v in x["at"]}, x["size"], 0
        while done < x.n:
            fit = [k for k, r in enumerate(room) if r >= (x.n - done) * size]
            if fit:
                k, m = max(fit, key=lambda k: (votes.get(k, 0), -room[k], -k)), x.n - done  # noqa: B023
            else:
                k = max(range(len(room)), key=lambda k: (room[k], votes.get(k, 0), -k))  # noqa: B023
                m = min(x.n - done, max(1, int(room[k] // size)))
            room[k] -= m * size
            pieces.append((x.g, x.text_crc32, size, x.n, done, done + m, k))
            done += m
    return pieces


def _passed(edges: list[float], x: Column) -> Column:
    """How many of the edges are at x or below."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x))


def propagate(rows: DataFrame, shards: int, rounds: int = ROUNDS, tables: list[DataFrame] | None = None) -> DataFrame:
    """rows (doc_id, size, text_crc32, g) with n, the size of the group, and label, the shard that it ends in. tables gets the
    tables that the result reads."""
    spark, link = rows.sparkSession, ["g", "text_crc32", "size"]  # texts are equal where all three are
    first = rows.withColumn("label", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int"))
    votes = first.groupBy(*link, "label").agg(F.count(F.lit(1)).alias("c"))
    groups = settle(votes.groupBy(*link).agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("label", "c"))).alias("at")).withColumn("bytes", F.col("n") * F.col("size")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    room = [total / shards] * shards
    linked = groups.where("n > 1")
    large = F.col("bytes") * LARGE * shards >= total
    pieces = place(linked.where(large).collect(), room)  # LARGE for each shard at most
    small = settle(linked.where(~large))
    buckets = buckets_for(small.count())
    placed = settle(small.select(*link, "bytes", F.lit(0).alias("target")).limit(0))
    start = list(room)
    for _ in range(rounds):
        left = small.join(placed, link, "left_anti")
        free = F.array(*map(F.lit, room))
        asks = F.transform("at", lambda v: F.struct((F.element_at(free, v.label + 1) >= F.col("bytes")).alias("fits"), v.c.alias("c"), (-v.label).alias("label")))
        best = left.withColumn("target", -F.array_max(asks).label)
        queue = running(best, ["target"], link, F.col("bytes"), "before", buckets)
        more = settle(queue.where(F.col("before") + F.col("bytes") <= F.element_at(free, F.col("target") + 1)).select(placed.columns))
        if not more.take(1):
            break
        placed = settle(placed.unionByName(more))
        held = {r.target: r.held for r in placed.groupBy("target").agg(F.sum("bytes").alias("held")).collect()}
        room = [r - held.get(k, 0) for k, r in enumerate(start)]
    left = settle(small.join(placed, link, "left_anti"))
    if left.take(1):
        edges = list(accumulate(max(r, 0.0) for r in room))
        laid = running(left.withColumn("one", F.lit(0)), ["one"], link, F.col("bytes"), "before", buckets)
        laid = settle(laid.withColumn("target", _passed(edges, F.col("before"))).withColumn("whole", (F.col("target") < shards) & (F.col("before") + F.col("bytes") <= F.element_at(F.array(*map(F.lit, edges)), F.least(F.col("target") + 1, F.lit(shards))))))
        whole = laid.where("whole")
        for r in whole.groupBy("target").agg(F.sum("bytes").alias("held")).collect():
            room[r.target] -= r.held
        placed = placed.unionByName(whole.select(placed.columns))
        pieces += place(laid.where("not whole").collect(), room)  # one for each end of a shard at most
    known = settle(groups.select(*link, "n").join(placed.select(*link, "target"), link, "left"))  # a plain table: a hot text's rows can be dealt out in the join
    out = first.drop("label").join(known, link)
    names = ["g", "text_crc32", "size", "n", "from", "to", "piece"]
    made = spark.createDataFrame(pa.table({c: pa.array([x[k] for x in pieces], pa.int64()) for k, c in enumerate(names)})).withColumn("piece", F.col("piece").cast("int"))
    pieced = first.drop("label").join(F.broadcast(made.select(*link, "n").distinct()), link)  # not yet dealt by group: the largest are here
    pieced = running(pieced, link, ["doc_id"], F.lit(1), "row", buckets_for(rows.count())).join(F.broadcast(made.drop("n")), link).where("row >= from and row < to").withColumn("label", F.col("piece"))
    spare = [max(r, 0.0) for r in room]
    lone = out.where("n = 1")
    mass = lone.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    edges = list(accumulate(r * mass / max(sum(spare), 1e-9) for r in spare))[:-1]
    lone = running(lone.withColumn("one", F.lit(0)), ["one"], ["doc_id", *link], F.col("size"), "before", buckets_for(rows.count()))
    lone = lone.withColumn("label", _passed(edges, F.col("before") + F.col("size") / 2))
    columns = [*rows.columns, "n", "label"]
    whole = out.where("n > 1 and target is not null").withColumn("label", F.col("target"))
    if tables is not None:
        tables += [groups, small, left, known]
    return whole.select(columns).unionByName(pieced.select(columns)).unionByName(lone.select(columns))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, shard, slot."""
    tables: list[DataFrame] = []
    rows = settle(propagate(_sized(docs), shards, tables=tables))
    unsettle(*tables)
    n, total, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    per = buckets_for(-(-n // shards))
    loads = {r.label: r.load for r in rows.groupBy("label").agg(F.sum("size").alias("load")).collect()}
    if all(abs(loads.get(k, 0) - total / shards) <= most for k in range(shards)):
        cut = rows.withColumn("shard", F.col("label").cast("int"))
    else:
        cut = settle(_level(rows, shards, total, per))
    return running(cut, ["shard"], ["doc_id", "g"], F.lit(1), "slot", per).select("doc_id", "size", "text_crc32", "shard", "slot")


def _level(rows: DataFrame, shards: int, total: int, per: int) -> DataFrame:
    """rows with the shard that they are in if sizes must differ by less than a document; a cut divides one group at most."""
    part = F.when(F.col("n") > BUCKET_ROWS, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BUCKET_ROWS))).otherwise(F.lit(0))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(per))).withColumn("p", part)
    line = ["label", "b", "p"]
    sums = rows.groupBy(*line).agg(F.sum("size").alias("w"))
    sums = sums.withColumn("o", F.coalesce(F.sum("w").over(Window.orderBy(*line).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("w")
    here = Window.partitionBy(*line).orderBy("g", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("i", F.sum("size").over(here)).join(sums, line).withColumn("mid", F.col("i") + F.col("o") - F.col("size") / 2)
    return at.select("doc_id", "size", "text_crc32", "g", F.least(F.lit(shards - 1), F.floor(F.col("mid") * shards / max(total, 1))).cast("int").alias("shard"))
