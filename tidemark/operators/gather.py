"""Accounts with few rows, gathered by one shuffle: a task has all rows of its accounts, in order, and looks at them in arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Rows of a task.
ROWS = 500_000
#: What all that an account gets and pays may come to; sums of floats are rounded.
MOST = (1 << 63) - (1 << 20)
Batches = Iterable[pa.RecordBatch]


def numbers(rows: pa.Table, column: str, none: int = 0) -> np.ndarray:
    """A column of whole numbers, with a value for nulls."""
    return pc.fill_null(rows[column], none).to_numpy().astype(np.int64)


def fresh(acc: pa.DictionaryArray) -> np.ndarray:
    """Where an account's rows begin."""
    code = acc.indices.to_numpy()
    return np.concatenate([[True], code[1:] != code[:-1]])


def _fitting(rows: pa.Table) -> Iterator[tuple[pa.Table, pa.DictionaryArray]]:
    """rows in parts of whole accounts whose money fits a BIGINT, with their accounts."""
    acc = rows["acc"].combine_chunks().dictionary_encode()
    money, starts = numbers(rows, "paise").sum(dtype=float), np.flatnonzero(fresh(acc))
    if money < 1 << 62 or (len(starts) == 1 and money < MOST):
        yield rows, acc
        return
    if len(starts) == 1:
        raise OverflowError(f"the money of account {acc.dictionary[0].as_py()} does not fit a BIGINT")
    half = int(starts[len(starts) // 2])
    yield from _fitting(rows.slice(0, half))
    yield from _fitting(rows.slice(half))


def _whole(batches: Batches) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole accounts: one that goes on in the next batch is held until it ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        code = b["acc"].dictionary_encode().indices.to_numpy()
        other = np.flatnonzero(code != code[-1])
        ends = int(other[-1]) + 1 if len(other) else 0
        if ends:
            held.append(b.slice(0, ends))
        if held and (ends or held[-1]["acc"][-1] != b["acc"][0]):
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(ends))
    if held:
        yield pa.Table.from_batches(held)


def gathered(rows: DataFrame, count: int, order: list[str | Column], found: Callable[[pa.Table, pa.DictionaryArray], pa.RecordBatch], schema: str) -> DataFrame:
    """What `found` makes of accounts: of their rows (acc, paise, ...) by account and order, and of their column of accounts.

    count: about how many rows there are. Rows of null accounts must be left out.
    """

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            for part, acc in _fitting(table):
                yield found(part, acc)

    return rows.repartition(max(1, -(-count // ROWS)), "acc").sortWithinPartitions("acc", *order).mapInArrow(run, schema)
