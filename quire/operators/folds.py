"""Order-dependent computations over the rows of one document, or one page, at a time.

Rows are gathered in one shuffle, in their order, and a plain function walks them; documents are bounded (a publication's lines), and
batches go through Arrow, so the cost of a document is its rows and not a call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.sources.scratch import shared_folder

#: Rows that a walk holds before they go on.
FLUSH = 5000
#: Groups that become Python objects at once.
GROUPS = 16


def per_document(df: DataFrame, keys: list[str], order: list[str], walk: Callable[[list[dict]], list[dict]], out: str) -> DataFrame:
    """walk(rows in order) gives rows of the columns `out`, for each value of the keys."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    gathered = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("rows"))
    key_type = StructType([df.schema[k] for k in keys])
    full = StructType([*key_type.fields, *StructType.fromDDL(out).fields])
    shape = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            for row in (row for at in range(0, batch.num_rows, GROUPS) for row in batch.slice(at, GROUPS).to_pylist()):
                held = {k: row[k] for k in keys}
                for x in walk(row["rows"]):
                    found.append(held | x)
                    if len(found) >= FLUSH:
                        yield pa.RecordBatch.from_pylist(found, schema=shape)
                        found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=shape)

    return gathered.mapInArrow(run, full)


def numbered(df: DataFrame, keys: list[str], order: list[str], walk: Callable[[list[dict]], list[dict]], out: str) -> DataFrame:
    """df with the columns `out`: walk(rows in order) gives their values for each row, in the same order."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in keys)
    return per_document(df, keys, order, lambda rows: [r | x for r, x in zip(rows, walk(rows))], f"{columns}, {out}")


def settle(df: DataFrame) -> DataFrame:
    """df computed once, in the folder that spark.checkpoint.dir names: what is read several times behind a fold or many joins would else be
    computed for each reader, and a plan of many steps would grow with each."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
