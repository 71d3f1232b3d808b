"""Sequential per-group logic over many small groups.

Spark partitions and sorts; each task walks its partition in Arrow batches and hands
complete groups to a plain function, so thousands of small groups share one batch
instead of paying one Python call with its own data frame each. Memory is one batch plus
one group; callers split off groups above a checked size first.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: StructType) -> DataFrame:
    """Apply ``fn(columns, first, last, out)`` to every group of ``keys``.

    ``columns`` maps names to lists, ``[first, last)`` is the group's slice in ``order``,
    and ``out`` maps the output names to lists that ``fn`` extends.
    """
    arrow_schema = to_arrow_schema(schema)

    def process(table: pa.Table, bounds: list[int]):
        columns = {name: table.column(name).to_pylist() for name in table.column_names}
        out = {name: [] for name in arrow_schema.names}
        for first, last in zip(bounds, bounds[1:]):
            fn(columns, first, last, out)
        return pa.RecordBatch.from_arrays(
            [pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema
        )

    def starts(table: pa.Table) -> list[int]:
        key_rows = list(zip(*[table.column(k).to_pylist() for k in keys]))
        return [i for i, key in enumerate(key_rows) if i == 0 or key != key_rows[i - 1]]

    def walk(batches):
        open_group: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if open_group is not None:
                table = pa.concat_tables([open_group, table])
            bounds = starts(table)
            open_group = table.slice(bounds[-1])
            if len(bounds) > 1:
                yield process(table.slice(0, bounds[-1]), bounds)
        if open_group is not None:
            yield process(open_group, [0, open_group.num_rows])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)
