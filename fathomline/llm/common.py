"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are sampled by the low bits of a hash of their id, so that a sample is the same on every run.
_SLOTS = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of the column written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body uses it.

    Catalyst may copy an expression into every place that refers to it, also into the body of a
    lambda function, which then computes it anew for each element. A lambda's variable isn't copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def sample(rows: DataFrame, keys: list[str], bound: int, salt: int = 0) -> DataFrame:
    """At most `bound` rows, chosen by a hash of `keys` over all rows: the same ones on every run; all of them if they are fewer.

    Two narrow passes; what goes through the filter of the second, about a third more than `bound`, is cut off in hash order.
    """
    n = rows.count()
    slot = F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(_SLOTS))
    if n > bound:
        rows = rows.filter(slot < int(min(1.0, (bound + 4 * bound**0.5) * 4 / 3 / n) * _SLOTS))
    return rows.orderBy(slot, *keys).limit(bound)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder that the session names in spark.checkpoint.dir. Lost executors don't lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without that setting, as in tests, gets one of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered; forgets all of them when there are too many."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value
