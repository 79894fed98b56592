"""Packed blocks dealt to ranges, and questions that blocks ask the owner of a key.

A table of blocks has the columns part, kind, payload: `payload` packs many rows of one kind (see kernels.pack),
`part` says which range or block of texts they belong to. What a block wants to know about a key, such as a
count or a minimum over all blocks, it asks the key's range: it sends one row for each of its distinct keys
and gets one answer for each, so a key that holds most rows costs a row for each block, never a row for each
occurrence in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .storage import partitions

BLOCKS = "part int, kind int, payload binary"
#: Bytes of payloads from which rows leave a task as a batch: a step's result is not held whole, here or in Java.
BATCH_BYTES = 1 << 20
Row = tuple[int, int, bytes]


def block_number(task: int, number: int) -> int:
    """A number for the number-th block of a task, which no other block has; an error where 32 bits do not hold it, rather than another block's number."""
    if task >> 19 or number >> 12:
        raise OverflowError(f"block {number} of task {task}: more than 524,288 tasks or 4096 blocks of one; read the input in larger or smaller splits")
    return task << 12 | number


def batch(rows: list[Row]) -> pa.RecordBatch:
    part, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["part", "kind", "payload"])


def batches_of(rows: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def dealt(*tables: DataFrame, n: int | None = None) -> DataFrame:
    """All blocks, each part's together and by kind, in n partitions."""
    union = tables[0].select("part", "kind", "payload")
    for t in tables[1:]:
        union = union.unionByName(t.select("part", "kind", "payload"))
    return union.repartition(n or partitions(union.sparkSession), "part").sortWithinPartitions("part", "kind")


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[Row]:
    for b in batches:
        yield from zip(b["part"].to_pylist(), b["kind"].to_pylist(), b["payload"].to_pylist(), strict=True)
    K.trim()


def each_part(step: Callable[[int, dict[int, Iterable[bytes]]], Iterable[Row]], last: int | None = None):
    """A function for mapInArrow over dealt blocks: step(part, its payloads by kind) gives new blocks.

    last: the greatest kind there is. Its payloads are not held: step gets them as an iterator, one at a time as they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(rows_of(batches), itemgetter(0)):
            held: dict[int, Iterable[bytes]] = {}
            for _, kind, payload in rows:
                if kind == last:
                    held[kind] = chain([payload], map(itemgetter(2), rows))
                    break
                held.setdefault(kind, []).append(payload)
            yield from batches_of(step(part, held))

    return run


def each_block(step: Callable[[int, int, bytes], Iterable[Row]]):
    """The same over single blocks, wherever they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kind, payload in rows_of(batches):
            yield from batches_of(step(part, kind, payload))

    return run


def spread(values: np.ndarray, keys: np.ndarray, kind: int, *columns: np.ndarray) -> list[Row]:
    """Packed rows by range of values, which ascend."""
    return [(part, kind, K.pack(values[s], *(c[s] for c in columns))) for part, s in K.by_part(values, keys)]


def asker(block: int) -> int:
    """The kind of a block's questions, below all other kinds."""
    return -1 - block


def asked(blocks: dict[int, list[bytes]], *kinds: type) -> list[np.ndarray]:
    """The rows of all questions, and as the last column the block that asked."""
    questions = {-1 - k: payloads for k, payloads in blocks.items() if k < 0}
    got = [K.unpack_all(payloads, *kinds) for payloads in questions.values()]
    columns = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, kind) for i, kind in enumerate(kinds)]
    return [*columns, np.repeat(np.fromiter(questions, np.int32, len(questions)), [len(g[0]) for g in got])]


def answers(to: np.ndarray, kind: int, *columns: np.ndarray) -> list[Row]:
    """Packed rows by the block that asked."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    return [(int(to[a]), kind, K.pack(*(c[a:b] for c in columns))) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are sorted by columns begin to differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted stand in ascending keys, and which are there at all."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))
