"""Many values searched in many texts at once.

The values of a key become automata of bounded size, and its texts come past
them in Arrow batches: values and texts meet by one shuffle, sorted so that a
task sees a slice of values first, then the texts that are to be read with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: characters of values in one automaton, and of texts that one task should read with it
VALUE_CHARS, TEXT_CHARS = 1_000_000, 4_000_000


def _slices(length: Column, per_slice: int) -> Column:
    return F.greatest(F.ceil(F.sum(length) / per_slice), F.lit(1)).cast("int")


def _matcher(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    group = [*keys, "salt", "slice"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        current, automaton, built = None, ahocorasick.Automaton(), False
        for batch in batches:
            found: dict[str, list] = {c: [] for c in [*keys, "text_id", "value"]}
            columns = [batch.column(c).to_pylist() for c in [*group, "text_id", "value", "body"]]
            for *key, text_id, value, body in zip(*columns):
                if key != current:
                    current, automaton, built = key, ahocorasick.Automaton(), False
                if value is not None:  # values come before the texts of their group
                    same = automaton.get(body, None)
                    if same is None:
                        automaton.add_word(body, [value])
                    else:
                        same.append(value)
                    continue
                if not built:
                    automaton.make_automaton()
                    built = True
                if not len(automaton):
                    continue
                hits = {id(values): values for _, values in automaton.iter(body)}
                for v in (v for values in hits.values() for v in values):
                    for c, k in zip(keys, key):
                        found[c].append(k)
                    found["text_id"].append(text_id)
                    found["value"].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=batch.schema.field(c).type) for c, v in found.items()], list(found))

    return match


def contained(
    texts: DataFrame, values: DataFrame, keys: Sequence[str], value_chars: int = VALUE_CHARS, text_chars: int = TEXT_CHARS,
) -> DataFrame:
    """(keys, text_id, value) for each row of ``texts`` whose ``body`` contains the ``body`` of a value with the same keys.

    ``texts`` has the keys, ``text_id`` and ``body``; ``values`` the keys, ``value`` and ``body``.  Rows with a null key or
    body, and values with a null or empty body, match nothing.  A value occurs once per text row, however often it is in it.
    The texts of a key are spread over as many salts as their length asks for, its values over as many slices.
    """
    on = list(keys) or ["everything"]
    if not keys:
        texts, values = texts.withColumn("everything", F.lit(0)), values.withColumn("everything", F.lit(0))
    values = values.where((F.length("body") > 0) & F.col("value").isNotNull()).select(*on, "value", "body").distinct()
    texts = texts.where(F.col("body").isNotNull()).select(*on, "text_id", "body")
    plan = values.groupBy(*on).agg(_slices(F.length("body"), value_chars).alias("slices")).join(
        texts.groupBy(*on).agg(_slices(F.length("body"), text_chars).alias("salts")), on
    )
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    read = texts.join(plan, on).select(
        *on, dealt(["text_id", "body"], "salts").alias("salt"), each("slices").alias("slice"), "text_id", F.lit(None).cast("string").alias("value"), "body"
    )
    sought = values.join(plan, on).select(
        *on, each("salts").alias("salt"), dealt(["body"], "slices").alias("slice"), F.lit(None).cast(texts.schema["text_id"].dataType).alias("text_id"), "value", "body"
    )
    both = sought.unionByName(read).repartition(*on, "salt", "slice").sortWithinPartitions(*on, "salt", "slice", F.col("value").isNull())
    schema = T.StructType([*(both.schema[c] for c in on), both.schema["text_id"], both.schema["value"]])
    return both.mapInArrow(_matcher(on), schema).select(*keys, "text_id", "value")
