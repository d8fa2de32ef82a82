"""A filter of bits in front of exact joins, by SQL functions alone.

The keys of a table that was just found set two bits each in one array of 64-bit words, whose
length follows from their number. A one-row table holds it; queries read it by a scalar
subquery, so it reaches the executors with the tasks, and the rows that cannot be in
the table are dropped by compiled code where they are scanned. It lets through all that is in the table and a few more. Beyond `MOST`
keys it would be too large to hand out, and then there is none: the exact join alone does the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free_name, settle

WORDS = 1 << 19  # 4 MB at most
MOST = WORDS * 16


class Bits:
    """Which rows may be in a table. `words` is None for a table with too many keys."""

    def __init__(self, words: DataFrame | None, size: int):
        self.words, self.size = words, size

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """The rows whose `column` may be among the keys; null never is.

        The test reads the value several times. It reads it from a row of its own, as a filter on the column itself would go below
        the projection that computes it, and compute it (say, from words of a text) once a reading.
        """
        if self.words is None:
            return df.where(F.col(column).isNotNull())
        value = free_name(df, "value")
        return df.withColumn(value, F.explode(F.array(column))).where(F.col(value).isNotNull() & self._test(value)).drop(value)

    def flag(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with a boolean column `name`: whether the value of `column` may be among the keys."""
        test = F.lit(True) if self.words is None else self._test(column)
        return df.withColumn(name, F.coalesce(F.col(column).isNotNull() & test, F.lit(False)))

    def _test(self, column: str) -> Column:
        word, mask = _place(column, self.size)
        return F.get(self.words.scalar(), word).bitwiseAND(mask) == mask


def _place(column: str, size: int) -> tuple[Column, Column]:
    """The word of a key and its two bits in it."""
    h = F.xxhash64(F.lit(size), F.col(column))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.shiftright(h, 16), F.lit(size)).cast("int"), bit(0).bitwiseOR(bit(6))


def table(df: DataFrame, column: str) -> Bits:
    """The bits of a settled table's column: a word for every four keys or so."""
    n = df.count()
    if n > MOST:
        return Bits(None, 0)
    size = 1024
    while size < WORDS and size * 4 < n:
        size *= 2
    word, mask = _place(column, size)
    found = df.where(F.col(column).isNotNull()).groupBy(word.alias("w")).agg(F.bit_or(mask).alias("b"))
    found = df.sparkSession.range(size).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b")).unionByName(found).groupBy("w").agg(F.bit_or("b").alias("b"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"])
    return Bits(settle(found.agg(words.alias("words")), "bits"), size)
