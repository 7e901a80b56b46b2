"""A filter of bounded size that tells which rows may be in a set of ids, so that only those are shuffled.

It only saves work: beyond some ten million ids most rows may be in the set, and
the exact join that follows shuffles them, once at most for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import unused, written

#: Bits of the filter: 2 ** 20 words of 64, 16 MB, however many ids there are.
BITS = 1 << 26


def bit_table(ids: DataFrame, column: str) -> DataFrame:
    """(word, bits) with the bit of each id's hash set; BITS / 64 rows at most."""
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS))
    bits = F.expr("bit_or(shiftleft(1L, cast(_p % 64 as int)))")
    return written(ids.where(F.col(column).isNotNull()).select(place.alias("_p")).groupBy(F.expr("_p div 64").alias("_word")).agg(bits.alias("_bits")))


def split(rows: DataFrame, column: str, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be in the set (all that are, and few others while the set is below the filter's size), and all other rows.

    Rows without an id are never in the set. The broadcast is bounded by BITS.
    """
    bit, word, bits = unused(rows.columns, "_p", "_word", "_bits")
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS))
    marked = rows.withColumn(bit, F.when(F.col(column).isNotNull(), place)).withColumn(word, F.expr(f"{bit} div 64"))
    marked = marked.join(F.broadcast(table.select(F.col("_word").alias(word), F.col("_bits").alias(bits))), word, "left")
    may = F.coalesce(F.expr(f"getbit({bits}, cast({bit} % 64 as int)) = 1"), F.lit(False))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where(may).select(*own), marked.where(~may).select(*own)
