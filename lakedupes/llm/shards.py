"""Shards by balanced label propagation over groups of linked documents; SQL functions only.

Documents begin in shards by a hash of their id and text. In each round, counts by (group, shard) tell every linked
document which shard holds most of its group; moves from shard i to shard j are allowed as far as as many
come back, and beyond that as far as j has room for linked documents. Unlinked ones take what is left, so they
need no room here. A hash of the group chooses which documents go, so that groups move together. At last shards are cut to
their exact quotas: documents beyond a quota, unlinked ones first, fill the shards that are short. A group
of any size is only ever counted and joined by (group, shard), in pieces, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.operators.groups import join_groups
from lakedupes.operators.ranking import spread_row_number
from lakedupes.staging import stage
from lakedupes.unions import union

ROUNDS = 10
# Documents of a group in a shard go together in pieces of at most this share of a shard.
PIECE = 0.05
_MILLION = 1_000_000


def _counts(rows: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(i, 0) for i in range(shards)]


def _allowed(wanted: dict[tuple[int, int], int], counts: list[int], limit: float) -> dict[tuple[int, int], float]:
    """The share of each (from, to) stream that may move: what comes back, and what room there is."""
    share = {}
    for (i, j), n in wanted.items():
        back = wanted.get((j, i), 0)
        incoming = sum(max(0, m - wanted.get((b, a), 0)) for (a, b), m in wanted.items() if b == j)
        room = max(0.0, limit - counts[j])
        extra = max(0, n - back)
        share[i, j] = min(1.0, (min(n, back) + extra * min(1.0, room / max(1, incoming))) / n)
    return share


def propagate(linked: DataFrame, room: float, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (row, who, grp, shard) after the rounds, or when no document wants to move. ``room``: documents a shard may hold."""
    for turn in range(rounds):
        votes = linked.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
        # A group has at most one row per shard here. A hash settles ties, so that no shard is favoured.
        best = votes.groupBy("grp").agg(F.max(F.struct("n", F.xxhash64("grp", "shard").alias("lot"), "shard")).alias("best"))
        drawn, _ = stage(votes.join(best, "grp").select("grp", "shard", "n", F.col("best.shard").alias("to")))
        streams = {(r.shard, r.to): r.n for r in drawn.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        counts = [sum(n for (i, _), n in streams.items() if i == j) for j in range(shards)]
        wanted = {(i, j): n for (i, j), n in streams.items() if i != j}
        if not wanted:
            break
        share = _allowed(wanted, counts, room)
        chance = F.create_map(*[F.lit(x) for (i, j), p in share.items() for x in (i * shards + j, int(p * _MILLION))])
        moving = drawn.select(
            "grp", "shard", "n", "to", chance[F.col("shard") * shards + F.col("to")].alias("chance"),
            F.ceil(F.col("n") / F.lit(max(1.0, room * PIECE))).alias("pieces"),
        )
        pick = F.pmod(F.xxhash64("grp", F.pmod("who", "pieces"), F.lit(turn)), F.lit(_MILLION))
        linked, _ = stage(
            join_groups(linked, moving, ["grp", "shard"], spread=["row"])
            .select("row", "who", "grp", F.when(pick < F.col("chance"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        )
    return linked


def shard_rows(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: numbers of rows differ by one at most. Documents with equal texts are linked. ``slot`` counts
    from 0 in each shard. A null text counts as empty; repeated rows are rows of their own; rows without doc_id
    are sharded like others. Fewer rows than shards leave shards empty. The result follows from ids and texts, not from
    how the table is cut into files.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # ``row`` names a row within this call only; where rows are ordered it comes last, between rows that are equal.
    base, total = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text).alias("grp"),
        ).withColumn("who", F.xxhash64("doc_id", "grp")).withColumn("shard", F.pmod("who", F.lit(shards)).cast("int"))
    )
    sizes, _ = stage(base.groupBy("grp").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    linked, _ = stage(join_groups(base, sizes, ["grp"], "copies", spread=["row"]).select("row", "who", "grp", "shard"))
    linked = propagate(linked, total / shards, shards, rounds)
    placed = base.withColumnRenamed("shard", "start").join(linked.select("row", "shard", F.lit(1).alias("in_group")), "row", "left")
    placed, _ = stage(placed.select(
        "row", "who", "grp", "doc_id", "size", "text_crc32", F.coalesce("shard", "start").cast("int").alias("shard"),
        # Documents of groups first, group by group; those alone last, so that they make room.
        F.when(F.col("in_group").isNotNull(), F.col("grp")).otherwise(F.lit("~")).alias("keep"),
    ))
    counts = _counts(placed, shards)
    # The fullest shards get the rows that cannot be divided evenly.
    fullest = sorted(range(shards), key=lambda i: (-counts[i], i))
    quota = {i: total // shards + (rank < total % shards) for rank, i in enumerate(fullest)}
    order = ["keep", "who", "doc_id", "grp", "row"]
    ranked, _ = stage(spread_row_number(placed, ["shard"], order, "rank"))
    allowed = F.create_map(*[F.lit(x) for i in range(shards) for x in (i, quota[i])])
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    stay = ranked.where(F.col("rank") <= allowed[F.col("shard")]).withColumn("slot", F.col("rank") - 1)
    over = spread_row_number(ranked.where(F.col("rank") > allowed[F.col("shard")]), [], order, "nth")
    # Shard i takes the moved rows first[i] + 1 .. first[i] + lack[i], after those it has.
    lack = [max(0, quota[i] - counts[i]) for i in range(shards)]
    first = [sum(lack[:i]) for i in range(shards)]
    target = slot = F.lit(None)
    for i in range(shards):
        mine = (F.col("nth") > first[i]) & (F.col("nth") <= first[i] + lack[i])
        target = F.when(mine, F.lit(i)).otherwise(target)
        slot = F.when(mine, F.col("nth") - 1 - first[i] + counts[i]).otherwise(slot)
    moved = over.withColumn("shard", target.cast("int")).withColumn("slot", slot.cast("long"))
    return union(stay.select(*columns), moved.select(*columns)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
