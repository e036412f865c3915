"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import documents_of

BITS = 48   # ring positions are exact as doubles


@dataclass(frozen=True)
class Ring:
    """Virtual nodes in ring order: place[i] closes arc i, which belongs to shard owner[i]; after the last arc comes the first again."""
    shards: int
    place: tuple[int, ...]
    owner: tuple[int, ...]


def ring(shards: int, virtual: int = 64) -> Ring:
    """A shard's virtual nodes depend on its own number only, so one more shard leaves all others where they are."""
    if shards < 1 or virtual < 1:
        raise ValueError("a ring needs a shard and a virtual node")
    nodes = {}
    for s in range(shards):
        for v in range(virtual):
            at = int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:6], "big")
            nodes[at] = min(s, nodes.get(at, s))
    places = sorted(nodes)
    return Ring(shards, tuple(places), tuple(nodes[p] for p in places))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """With no slack, rows / shards with the remainder on the first shards, so that every shard is filled exactly; else (1 + slack) times the mean, rounded up."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(r: Ring, counts: dict[int, int], slack: float) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot): keys of an arc go to its shard while that has room, the rest clockwise to the next with room.

    Arcs are served in ring order. At most arcs + shards segments: each one ends an arc or fills a shard. Full shards are skipped by a pointer that only moves on.
    """
    room = capacities(sum(counts.values()), r.shards, slack)
    used, segments, n = [0] * r.shards, [], len(r.owner)
    onward = list(range(2 * n + 1))   # the next arc from here whose shard may have room

    def find(i: int) -> int:
        path = []
        while True:
            while onward[i] != i:
                path.append(i)
                i = onward[i]
            if i >= 2 * n or used[r.owner[i % n]] < room[r.owner[i % n]]:
                for p in path:
                    onward[p] = i
                return i
            onward[i] = i + 1

    for arc in sorted(counts):
        done = 0
        while done < counts[arc]:
            i = find(arc)
            s = r.owner[i % n]
            take = min(counts[arc] - done, room[s] - used[s])
            segments.append((arc, done, done + take, s, used[s]))
            used[s] += take
            done += take
    return segments


def shard(docs: DataFrame, shards: int = 40, virtual: int = 64, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, arc, home, shard, slot.

    home is the shard that the ring alone would give; shard differs from it where that one was full. slot counts from 0 without gaps in each shard.
    slack is how far over the mean a shard may go; with 0 row counts differ by one at most. Less movement on growth is bought with more slack.
    size is the text's UTF-8 bytes plus 16 (null: 16), text_crc32 is unsigned (null as empty). Rows with the same id are ranked among themselves by
    size and CRC, and as they come if these are equal too. A null id has a place on the ring as well. Other columns are not read.

    Only ids, sizes and CRCs are shuffled. The driver sees one count per arc (shards x virtual numbers, whatever the input) and sends back the
    segments, at most arcs + shards rows. Ranks within an arc need one sort of an arc's ids; ids are unique, so arcs are about even.
    """
    spark = docs.sparkSession
    r = ring(shards, virtual)
    base = documents_of(docs, doc_id, text).select(
        "doc_id", (F.octet_length("text") + F.lit(16)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 64 - BITS).alias("place"))
    arcs = Bucketizer(splits=[-1.0, *(p + 0.5 for p in r.place), float(2 ** BITS)], inputCol="at", outputCol="after")
    at = arcs.transform(base.withColumn("at", F.col("place").cast("double"))).withColumn("arc", F.col("after").cast("int") % len(r.place)).drop("at", "after")
    counts = {row.arc: row["count"] for row in at.groupBy("arc").count().collect()}   # bounded by the number of arcs
    segments = fill(r, counts, slack)
    owners = {i: s for i, s in enumerate(r.owner)}
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("s_arc", "lo", "hi", "s_shard", "first", "home")])
    parts = spark.createDataFrame([(*s, owners[s[0]]) for s in segments], schema)   # at most shards x virtual + shards rows
    ranked = at.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("place", "doc_id", "size", "text_crc32")) - 1)
    found = ranked.join(F.broadcast(parts), (F.col("arc") == F.col("s_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select("doc_id", "size", "text_crc32", "arc", F.col("home").cast("int").alias("home"), F.col("s_shard").cast("int").alias("shard"),
                        (F.col("first") + F.col("rank") - F.col("lo")).cast("long").alias("slot"))


def arc_of(r: Ring, place: int) -> int:
    """The arc that a ring position lies on (for checks outside Spark)."""
    return bisect_left(r.place, place) % len(r.place)
