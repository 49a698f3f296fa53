"""Joining group facts back to rows when some groups are huge.

A group of copies may hold a third of all rows. Facts about groups are therefore aggregated first
(Spark combines on the map side, so a hot key costs nothing there) and joined back with the hot
keys split over several partitions. Nothing is ever gathered per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one key that stay together in a join; more are split. ``spark.lakedupes.pieceRows``.
PIECE_ROWS = 500_000


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def piece_rows(spark: SparkSession) -> int:
    """Rows per piece of a hot key in this session."""
    return int(spark.conf.get("spark.lakedupes.pieceRows", str(PIECE_ROWS)))


def _pieces(weight: str, spark: SparkSession) -> str:
    return f"ceil({weight} / {piece_rows(spark)})"


def _choose(pieces: str, spread: Sequence[str]) -> str:
    """The piece of a row: a hash of its own columns, the same whenever the task runs again."""
    return f"coalesce(pmod(xxhash64({', '.join(spread)}), {pieces}), 0) AS _piece"


def _repeat(groups: DataFrame, weight: str) -> DataFrame:
    """One row per group and piece. Adds one row per ``piece_rows`` rows of data at most."""
    last = f"greatest({_pieces(weight, groups.sparkSession)}, 1) - 1"
    return groups.selectExpr("*", f"explode(sequence(cast(0 as bigint), {last})) AS _piece")


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    weight: str = "n",
    how: str = "inner",
    spread: Sequence[str] = ("bucket", "key"),
    keep: str = "true",
) -> DataFrame:
    """Join one-row-per-key ``groups`` to ``rows`` (which do not know their group's size).

    ``weight`` is the column of ``groups`` with the number of rows of the key; ``keep`` is a condition on
    ``groups``. Groups that it refuses must be in ``groups`` too: only so are hot ones among them known.
    All keys above ``piece_rows`` rows are broadcast to the rows. They are at most one per ``piece_rows`` rows of
    data, some megabytes for 10^11 rows. The rows of a hot key that is refused go before the shuffle in
    an inner join; those of other hot keys, and in a left join all, choose a piece by a hash of
    ``spread``. Group rows are repeated once per piece.
    """
    keys = list(keys)
    spark = rows.sparkSession
    hot = groups.where(f"{weight} > {piece_rows(spark)}").selectExpr(
        *keys, f"{_pieces(weight, spark)} AS _pieces", f"coalesce({keep}, false) AS _wanted"
    )
    known = rows.join(F.broadcast(hot), keys, "left")
    if how == "inner":
        known = known.where("coalesce(_wanted, true)")
    salted = known.selectExpr(*rows.columns, _choose("_pieces", spread))
    return salted.join(_repeat(groups.where(keep), weight), [*keys, "_piece"], how).drop("_piece")


def join_sized(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str = "n",
    spread: Sequence[str] = ("bucket", "key"),
) -> DataFrame:
    """Join ``groups`` to ``rows`` when both carry the group's number of rows in ``size``."""
    keys = list(keys)
    salted = rows.selectExpr("*", _choose(_pieces(size, rows.sparkSession), spread))
    return salted.join(_repeat(groups, size).drop(size), [*keys, "_piece"]).drop("_piece")


def join_counted(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join one-row-per-key ``groups`` to ``rows`` where neither knows how many rows a key has.

    The rows of each key are counted here, so ``rows`` should be staged. Keys above ``piece_rows`` rows, at most one per
    ``piece_rows`` rows of data, are broadcast to both sides: their rows choose a piece by a hash of ``spread``, and their
    group row is repeated per piece. ``how`` is ``inner`` or ``left``.
    """
    keys = list(keys)
    spark = rows.sparkSession
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {piece_rows(spark)}").selectExpr(
        *keys, f"{_pieces('_n', spark)} AS _pieces"
    )
    salted = rows.join(F.broadcast(hot), keys, "left").selectExpr(*rows.columns, _choose("_pieces", spread))
    last = "greatest(coalesce(_pieces, 1), 1) - 1"
    repeated = groups.join(F.broadcast(hot), keys, "left").selectExpr(
        *groups.columns, f"explode(sequence(cast(0 as bigint), cast({last} as bigint))) AS _piece"
    )
    return salted.join(repeated, [*keys, "_piece"], how).drop("_piece")
