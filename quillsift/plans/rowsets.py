"""Sets of rows as bitmaps: a row for each 64 ids that hold a member, so that sets meet in joins of words and nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowSet:
    """words: (word, bits), one row a word, no word of zero bits."""

    words: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, condition: Column, row_id: str = "_row_id") -> RowSet:
        """The rows that match; ids are whole numbers, null ids are in no set."""
        i = F.col(f"`{row_id}`").cast("long")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)).cast("int"))
        return cls(rows.where(condition & i.isNotNull()).select(F.shiftright(i, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")))

    def _with(self, other: RowSet, how: str, bits) -> RowSet:
        a, b = self.words.withColumnRenamed("bits", "a"), other.words.withColumnRenamed("bits", "b")
        made = a.join(b, "word", how).select("word", bits(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("bits"))
        return RowSet(made.where("bits <> 0"))

    def and_(self, other: RowSet) -> RowSet:
        return self._with(other, "inner", lambda a, b: a.bitwiseAND(b))

    def or_(self, other: RowSet) -> RowSet:
        return self._with(other, "full", lambda a, b: a.bitwiseOR(b))

    def and_not(self, other: RowSet) -> RowSet:
        return self._with(other, "left", lambda a, b: a.bitwiseAND(F.bitwise_not(b)))

    def xor(self, other: RowSet) -> RowSet:
        return self._with(other, "full", lambda a, b: a.bitwiseXOR(b))

    def cardinality(self) -> DataFrame:
        """One row: cardinality."""
        return self.words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("cardinality"))

    def ids(self) -> DataFrame:
        """A row for each member: _row_id."""
        each = self.words.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place"))
        return each.where("getbit(bits, place) = 1").select((F.col("word") * 64 + F.col("place")).alias("_row_id"))
