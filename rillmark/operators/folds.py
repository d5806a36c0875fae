"""Ordered folds: one pass over the sorted rows of each key, holding the fold's state and no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], start: Callable, step: Callable, finish: Callable, schema: str, chunk: int = 1 << 16) -> DataFrame:
    """(keys, schema): for each key ``start()``, then ``step(state, rows)`` over its ``values`` in ``order``, then ``finish(state)``.

    Keys are dealt out by hash and sorted by the engine (which spills); a key's rows pass through one task as a stream.
    The hash is dealt out as it is: a shuffle on the keys themselves would be left out after a join or window on them,
    and adaptive execution is free to split the join's partitions, and with them the keys.
    """
    keys, order, values = list(keys), list(order), list(values)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*keys, *dict.fromkeys([*order, *values]))
    ordered = ordered.repartitionById(width, F.pmod(F.xxhash64(*keys), F.lit(width)).cast("int")) if keys else ordered.repartition(1)
    ordered = ordered.sortWithinPartitions(*keys, *order).select(*keys, *values)
    out_schema = StructType(([rows.schema[k] for k in keys]) + list(_parse_datatype_string(schema).fields))
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def close() -> Iterator[pa.RecordBatch]:
            found = finish(state)
            n = len(next(iter(found.values())))
            columns = [pa.array([k] * n, arrow.field(i).type) for i, k in enumerate(now)]
            columns += [pa.array(found[f.name], arrow.field(f.name).type) for f in list(arrow)[len(keys) :]]
            whole = pa.RecordBatch.from_arrays(columns, schema=arrow)
            yield from (whole.slice(i, chunk) for i in range(0, n, chunk))

        for batch in batches:
            if not batch.num_rows:
                continue
            named = [batch.column(i) for i in range(len(keys))]
            change = np.zeros(batch.num_rows, bool)
            for c in named:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                key = tuple(c[i].as_py() for c in named)
                if state is None or key != now:
                    if state is not None:
                        yield from close()
                    now, state = key, start()
                step(state, batch.slice(i, j - i).select(values))
        if state is not None:
            yield from close()

    return ordered.mapInArrow(run, out_schema)
