"""Column expressions and inputs that several operators share."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but the blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def lower_az(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unsigned(value: Column) -> Column:
    return F.pmod(value, F.lit(1 << 32))


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker holds no memory that is free: workers live on from stage to stage."""

    def done(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return done


#: Copies of a row that are made at once; more of them are dealt to several tasks.
TOGETHER = 4096


def copies(rows: DataFrame, n: str, number: str) -> DataFrame:
    """Each row as often as its column n says, with the copy's number from 0. What has very many copies is made in parts, dealt out."""
    few = rows.filter(F.col(n) <= TOGETHER).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    parts = rows.filter(F.col(n) > TOGETHER).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(TOGETHER).cast("long"))))
    last = F.least(F.col(n) - 1, F.col(number) + TOGETHER - 1)
    return few.unionByName(parts.repartition(F.col(number), *[F.col(c) for c in rows.columns[:2]]).withColumn(number, F.explode(F.sequence(F.col(number), last))))


def rows_of(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side list as rows, through a JSON literal (no Python workers, no RDD)."""
    import json

    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))
