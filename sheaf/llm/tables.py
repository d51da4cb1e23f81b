"""Where the tables of a test or corpus folder are read, and how columns are added to texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.arrays import Slice, slices
from sheaf.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def add_by_text(docs: DataFrame, text_col: str, added: list[T.StructField], work: Callable[[Slice], list[pa.Array]]) -> DataFrame:
    """``docs`` with the columns ``added``, worked out slice by slice from the texts in ``text_col``.

    ``work`` gives an array a column. New columns replace columns of their names; all others pass through, whatever
    they are called. The text goes to the worker once, also where it stays a column.
    """
    new = {f.name for f in added}
    kept = [f for f in docs.schema.fields if f.name not in new]
    places = {f.name: i for i, f in enumerate(kept)}
    passed = [F.col(quoted(f.name)) for f in kept]
    if isinstance(docs.schema[text_col].dataType, T.StringType) and text_col in places:
        at = places[text_col]
    else:
        at = len(passed)
        passed.append(F.col(quoted(text_col)).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(at)):
                columns = [batch.column(k).slice(s.first, s.rows) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *work(s)], names=schema.names)

    plain = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kept)]
    schema = T.StructType([*plain, *(T.StructField(f"c{len(kept) + i}", f.dataType, f.nullable) for i, f in enumerate(added))])
    source = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(passed)])
    return source.mapInArrow(run, schema).toDF(*places, *(f.name for f in added))
