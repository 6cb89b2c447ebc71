"""Generic map/reduce: column expressions where possible, Python functions in Arrow batches where not."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks import write_pairs

#: Bytes, pickled, of the pairs that a combining task holds at most before it passes them on: in memory some ten times as many.
HELD = 4 << 20


def _pickled(what) -> bytes:
    try:
        return pickle.dumps(what, 2)
    except Exception:  # of a class that stands in no module, which went out with the functions
        return cloudpickle.dumps(what)


def map_aggregate(frame: DataFrame, key: Column, value: Column, reduce: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """(key, name) with a native aggregate, combined before the shuffle."""
    return frame.select(key.alias("key"), value.alias("__v")).groupBy("key").agg(reduce(F.col("__v")).alias(name))


def map_reduce(
    frame: DataFrame,
    mapper: Callable[[dict], Iterable[tuple]],
    reducer: Callable[[object, list], Iterable[tuple]],
    pair_schema: str,
    result_schema: str,
    combiner: Callable[[object, list], object] | None = None,
    reducers: int | None = None,
) -> DataFrame:
    """mapper(row) yields (key, value), reducer(key, values) yields result rows.

    pair_schema names key and value. The reducer gets a key's values at once; give a combiner wherever the
    reduction is associative. It folds values of a key into one of their kind and runs any number of times,
    over its own results too: in every map task, and again where the pairs have been dealt by key to as many
    tasks as their size asks for, each in order of the key. The reducers, however few, get about one value a key.
    """

    def combined(batches):
        """Batches of (key, value), a key's values folded into one as far as HELD reaches."""
        held, unweighed = {}, 0
        for pairs in batches:
            found: dict = {}
            for k, v in pairs:
                found.setdefault(math.nan if isinstance(k, float) and k != k else k, []).append(v)
                unweighed += 1
            for k, vs in found.items():
                held[k] = combiner(k, [held[k], *vs] if k in held else vs)
            if unweighed >= len(held):
                unweighed = 0
                if len(_pickled(held)) > HELD:
                    yield held.items()
                    held = {}
        yield held.items()

    def mapped(frames):
        return ([p for row in rows.to_dict("records") for p in mapper(row)] for rows in frames)

    def paired(frames):
        for pairs in mapped(frames):
            yield pd.DataFrame(pairs, columns=["key", "value"])

    def packed(frames):
        for pairs in combined(mapped(frames)):
            yield pd.DataFrame([(k, _pickled((k, v))) for k, v in pairs], columns=["key", "pair"])

    def folded(frames):
        for pairs in combined(map(pickle.loads, rows["pair"]) for rows in frames):
            yield pd.DataFrame(list(pairs), columns=["key", "value"])

    def reduced(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(reducer(rows["key"].iloc[0], rows["value"].tolist())), columns=names)

    from pyspark.sql.types import BinaryType, StructField, StructType

    names = [f.name for f in StructType.fromDDL(result_schema).fields]
    if combiner:
        # Pairs travel pickled: a combiner sees only what mapper and combiner made. A rebalance may split a key; the last shuffle mends that.
        by_key = StructType([StructField("key", StructType.fromDDL(pair_schema)["key"].dataType), StructField("pair", BinaryType())])
        dealt = frame.mapInPandas(packed, by_key).hint("rebalance", "key").sortWithinPartitions("key")
        pairs = dealt.select("pair").mapInPandas(folded, pair_schema)
    else:
        pairs = frame.mapInPandas(paired, pair_schema)
    if reducers:
        pairs = pairs.repartition(reducers, "key")
    return pairs.groupBy("key").applyInPandas(reduced, result_schema)


def job(frame: DataFrame, path: str, mapper, reducer, pair_schema: str, result_schema: str, kind: str = "parquet", **steps) -> DataFrame:
    """A whole job: map, sort and merge by key, reduce, output committed in any format Spark writes; read back."""
    write_pairs(map_reduce(frame, mapper, reducer, pair_schema, result_schema, **steps), kind, path)
    return frame.sparkSession.read.schema(result_schema).format(kind).load(path)
