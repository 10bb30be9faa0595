"""Series cut into overlapping chunks, so that work over trailing windows of rows is many bounded tasks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import KEY, by_series

#: Rows of a chunk besides those it repeats from before.
CHUNK = 4096


def over_chunks(rows: DataFrame, back: int, work: Callable[[pa.Table, int], pa.Table], added: list[T.StructField], size: int = CHUNK) -> DataFrame:
    """Calls ``work`` with every chunk of a series: up to ``back`` rows before it, then its own, in order, and how many come before.

    A row is sent to its chunk and to those that begin at most ``back`` rows later, so ``work`` sees the whole trailing window of each of its
    own rows. It gives back columns of the input for any of the own rows and the ``added`` ones. A chunk has at most ``size`` + ``back`` rows, whatever
    the series' length; null keys are a series of their own.
    """
    schema = T.StructType([*rows.schema.fields, *added])
    numbered = rows.withColumn("__row", F.row_number().over(by_series()).cast("long") - 1)
    dealt = numbered.withColumn("__chunk", F.explode(F.expr(f"sequence(__row div {size}, (__row + {back}) div {size})")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        row, first = table.column("__row").to_numpy(), key[1].as_py() * size
        before, end = int((row < first).sum()), int((row < first + size).sum())
        own = table.slice(0, end).drop_columns(["__row", "__chunk"])
        return work(own, before).select(schema.names)

    return dealt.groupBy(KEY, "__chunk").applyInArrow(run, schema)
