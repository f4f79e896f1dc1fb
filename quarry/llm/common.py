"""What several operators share: folds, ASCII word rules, row packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.shared import shared_table

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE = " \t\n\x0b\x0c\r"


def word_bytes(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased: bytes.lower() and bytes.split() know ASCII alone, which is the rule."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fold(column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def without(text: Column, characters: str, by: str = "") -> Column:
    """text with each of the characters replaced; byte searches, several times faster than translate()."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words(text: Column) -> Column:
    """Native array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(without(F.coalesce(text, F.lit("")), SPACE[1:], " "), " "), "")


def pack(df: DataFrame, **columns: str) -> DataFrame:
    """The whole row as struct _row, and the named columns beside it, so that no column of the input can clash."""
    return df.select(F.struct("*").alias("_row"), *[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def unpack(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def slices(batch: pa.RecordBatch, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what a worker makes of one stays small."""
    for k in range(0, batch.num_rows, most_rows):
        yield batch.slice(k, most_rows)


_kept: dict[str, Callable[[], None]] = {}


def begin(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Called where a worker begins a task: what other operators keep in this process from task to task goes.

    forget drops what the operator itself keeps.
    """
    for other in [o for o in _kept if o != operator]:
        _kept.pop(other)()
    if forget:
        _kept[operator] = forget


def hash_sample(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, those with the least hash of the key; equal rows count once.

    No task gets a hot group: rows are counted by group and leading bits of the hash, which partial aggregates bound, and what lies
    beyond the bits that hold the first ``most`` rows is left out; then once more by further bits. Only what is left is ranked, a
    millionth of a group beside ``most`` rows.
    """
    found = rows.distinct().withColumn("_h", F.xxhash64(F.col(key).cast("string")))
    for shift in (54, 44):
        bits = F.shiftright("_h", shift)
        counts = found.groupBy(group, bits.alias("_b")).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cuts = shared_table(counts.withColumn("_n", before).where(F.col("_n") < most).groupBy(group).agg(F.max("_b").alias("_cut")))
        found = found.join(cuts, group).where(bits <= F.col("_cut")).drop("_cut")
    whole = Window.partitionBy(group).orderBy("_h", *[c for c in rows.columns if c != group])
    return found.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= most).drop("_r", "_h")
