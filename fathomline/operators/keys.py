"""Dense integer ids, and look-ups of ids by key."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

_DEALT = 1 << 16  # how many values rows without a key are dealt by
_SHIFT = 33  # monotonically_increasing_id() has the partition above this bit and the row's place below it


def dense_ids(rows: DataFrame, *order: str | Column, name: str = "id", first: int = 1) -> DataFrame:
    """rows with ids first, first + 1, ... in the given order, which has to tell all rows apart.

    Rows are sorted by ranges of the order and written to the checkpoint folder, so a lost task gives the same rows again; a
    count for each range makes the offset of the next. No task numbers all rows, and only the counts go to the driver: one for each
    partition. As the order is total, the ids don't depend on where the ranges lie.
    """
    held = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", _SHIFT).cast("int")
    counts = {r.part: r.n for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [counts.get(k, 0) for k in range(max(counts, default=-1) + 1)]
    offsets = F.array(*map(F.lit, accumulate([first, *sizes[:-1]]))) if sizes else F.array(F.lit(first))
    own = F.col("_m").bitwiseAND((1 << _SHIFT) - 1)
    return held.withColumn(name, (F.get(offsets, part) + own).cast("long")).drop("_m")


def looked_up(rows: DataFrame, ids: DataFrame, on: list[tuple[Column, str]], new: str, required: bool = True) -> DataFrame:
    """rows with `new`: the id of the row of ids whose columns equal the given values. Without one, a required row goes, another gets null.

    Kept rows that lack a value match nothing. They are dealt by all that they hold, as Spark would send them all to one task.
    """
    found = ids.select(F.col("id").alias(new), *(F.col(c).alias(f"_k{k}") for k, (_, c) in enumerate(on)))
    held = rows.withColumns({f"_v{k}": v for k, (v, _) in enumerate(on)})
    same = [F.col(f"_v{k}") == F.col(f"_k{k}") for k in range(len(on))]
    if not required:
        lacking = reduce(or_, (F.col(f"_v{k}").isNull() for k in range(len(on))))
        held = held.withColumn("_v", F.when(lacking, F.pmod(F.xxhash64(*rows.columns), F.lit(_DEALT)) + 2).otherwise(0))
        # Always 0, but nothing that Spark can tell to be a constant (as isNull() of an id that is never null), which it would take out of the join's keys.
        found = found.withColumn("_k", F.when(F.length(F.col(new).cast("string")) < 0, 1).otherwise(0).cast("long"))
        same.append(F.col("_v") == F.col("_k"))
    out = held.join(found, same, "inner" if required else "left")
    return out.drop("_v", "_k", *(f"_{x}{k}" for x in "kv" for k in range(len(on))))
