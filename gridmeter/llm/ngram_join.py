"""N-gram Jaccard join: token-combination prefixes.

Documents whose sets of word shingles have a Jaccard similarity of at least a threshold are linked.

1. Every text is read once for its set's size, a signature (documents with equal sets are one node from
   here on) and a sketch of how often each shingle occurs.
2. Ordered by class (rare before frequent, by the sketch) and hash, each set gives its first 2 d + 1
   tokens, where d = n - ceil(t n) is how many it may have alone. Two similar sets share at least d + 1
   of these, or fewer where the smaller one's are too few (_least_shared). Nodes stay that share so many
   with nodes of fitting size.
3. Over these, each token's exact frequency is counted. Ordered by frequency, two similar sets share at
   least 2 tokens of their prefixes extended by one; single tokens are indexed where rare, pairs of
   tokens where both are frequent (in long sets, where pairs would be many, frequent tokens are indexed
   singly; lengths near the limit do both). Tokens that only one node has take prefix places but no rows.
4. linking.connect verifies exact similarities bucket by bucket and links components.

A token that many nodes of a block of texts have leaves the block as a row for each size of set, and
frequencies are asked for by a row for each block: no task gets a row for each node that has a hot token.
The order affects only speed: any sketch gives the same links. Tokens are compared by 64-bit hashes.

Defined results: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; fewer words than a shingle's
are one shingle; a text without words, or null, has an empty set and links with nothing; a row
without doc_id takes no part and has a null component; rows that repeat a doc_id or a text are linked
as any equal sets are. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .linking import LABELS, POSTINGS, SETS, connect, label_rows, packed_sets, ranges, unpacked_sets
from .ranges import BLOCKS, Row, answers, asked, asker, batch, block_number, dealt, each_part, firsts, looked_up, rows_of, spread
from .storage import BROADCAST_ROWS, materialize, partitions, planned_once, small_batches

FLUSH_BYTES = 3 << 19
#: Counters of the sketch (a byte for each of them in a task, a bit in the broadcast), in chunks of so many.
SKETCH, SKETCH_CHUNK = 1 << 22, 1 << 16
#: A token with at most so many nodes is rare and indexed alone; sets larger than LONG index frequent tokens alone too.
RARE, LONG = 32, 300
#: Nodes of a block that make a token hot there; signatures a task remembers, which changes the volume only.
HOT, REMEMBERED = 64, 1 << 20
#: Kinds of blocks beside linking's: tokens of prefixes, counts of shared ones, sets of a block, frequencies of its tokens.
TOKENS, COUNTS, BLOCK, TIMES = range(30, 34)


def _sets(table: pa.Table, k: int):
    """Distinct shingle hashes by row (ascending), row offsets and an order-free signature of each row's set."""
    data, offsets = K.utf8(table["text"])
    starts, ends, words = K.word_spans(data, offsets)
    found, rows = K.shingles(K.span_hashes(data, starts, ends, K.FOLDED), words, k)
    values, at = K.distinct_by_row(found, rows, table.num_rows)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(K.mix(values ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return values, at, K.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _new(signatures: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows are the first of their signature in this task."""
    out = np.zeros(len(signatures), bool)
    if len(seen) > REMEMBERED:
        seen.clear()
    for i, s in enumerate(signatures.tolist()):
        if s not in seen:
            seen.add(s)
            out[i] = True
    return out


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(SKETCH, np.uint8), set()
        for table in K.gathered(batches, FLUSH_BYTES):
            values, at, signatures = _sets(table, k)
            n = np.diff(at)
            new = np.repeat(_new(signatures, seen), n)
            hit, times = np.unique((values[new] & np.uint64(SKETCH - 1)).astype(np.int64), return_counts=True)
            counts[hit] += np.minimum(times, 255 - counts[hit]).astype(np.uint8)
            nothing = pa.nulls(table.num_rows, pa.int32()), pa.nulls(table.num_rows, pa.binary())
            doc_ids = table["doc_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n.astype(np.int64)), pa.array(signatures), *nothing], ["doc_id", "n", "node", "part", "payload"])
        for i in range(SKETCH // SKETCH_CHUNK):
            chunk = counts[i * SKETCH_CHUNK : (i + 1) * SKETCH_CHUNK]
            if chunk.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([i], pa.int32()), pa.array([chunk.tobytes()], pa.binary())], ["doc_id", "n", "node", "part", "payload"])

    return run


def _add(level: int | None):
    """Sums of the chunks of this partition, one for each part; with a level, a bit for each sum: whether it is above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, payload in zip(batch["part"].to_pylist(), batch["payload"], strict=True):
                raw = payload.as_buffer()
                wide = np.frombuffer(raw, np.uint8 if len(raw) == SKETCH_CHUNK else np.uint64)
                if part in sums:
                    sums[part] += wide
                else:
                    sums[part] = wide.astype(np.uint64)
        for part, s in sums.items():
            out = s.tobytes() if level is None else np.packbits(s > level).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out], pa.binary())], ["part", "payload"])

    return run


def _frequent(chunks: DataFrame, tokens: int) -> np.ndarray:
    """A bit for each counter: whether it is far above the mean. SKETCH / 8 bytes on the driver, whatever the input."""
    kind, n = "part int, payload binary", partitions(chunks.sparkSession)
    spread = chunks.repartition(n, "part", F.pmod(F.xxhash64("payload"), F.lit(16))).mapInArrow(_add(None), kind)
    summed = spread.repartition(min(n, SKETCH // SKETCH_CHUNK), "part").mapInArrow(_add(2 * tokens // SKETCH + 32), kind)
    out = np.zeros(SKETCH // 8, np.uint8)
    with planned_once(chunks.sparkSession):
        found = summed.collect()
    for part, bits in found:
        out[part * SKETCH_CHUNK // 8 : (part + 1) * SKETCH_CHUNK // 8] = np.frombuffer(bits, np.uint8)
    return out


def _prefixes(k: int, percent: int, frequent: np.ndarray, keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for table in K.gathered(batches, FLUSH_BYTES):
            values, at, signatures = _sets(table, k)
            n = np.diff(at)
            use = _new(signatures, seen) & (n > 1)
            rows = np.repeat(np.arange(len(n)), n)
            here = use[rows]
            values, rows = values[here], rows[here]
            at_bit = (values & np.uint64(SKETCH - 1)).astype(np.int64)
            often = (frequent[at_bit >> 3] >> (7 - (at_bit & 7)).astype(np.uint8)) & 1
            key = (values >> np.uint64(1)) | (often.astype(np.uint64) << np.uint64(63))
            order = np.lexsort((key, rows))  # rows stay in place
            first = np.searchsorted(rows, rows)
            length = 2 * (n - -(-n * percent // 100)) + 1
            order = order[np.arange(len(rows)) - first < length[rows]]
            tokens, rows = values[order], rows[order]
            yield batch(_prefix_rows(tokens, signatures[rows].view(np.uint64), n[rows].astype(np.uint32), keys))

    return run


def _prefix_rows(tokens: np.ndarray, nodes: np.ndarray, n: np.ndarray, keys: np.ndarray) -> list[Row]:
    """Tokens with their nodes, by range. Of a hot token only the first and last node of each size go there, and all its nodes count it as shared."""
    order = np.lexsort((nodes, n, tokens))
    tokens, nodes, n = tokens[order], nodes[order], n[order]
    start = np.flatnonzero(firsts(tokens)) if len(tokens) else np.zeros(0, np.int64)
    hot = np.repeat(np.diff(np.append(start, len(tokens))) > HOT, np.diff(np.append(start, len(tokens))))
    edge = firsts(tokens, n)
    edge[:-1] |= edge[1:]
    edge[-1:] = True
    go = ~hot | edge
    out = spread(tokens[go], keys, TOKENS, nodes[go], n[go])
    if hot.any():
        node, first, times = np.unique(nodes[hot], return_index=True, return_counts=True)
        out += spread(node, keys, COUNTS, n[hot][first], times.astype(np.uint32))
    return out


def _sharing(percent: int, keys: np.ndarray):
    """How many prefix tokens each node shares with nodes of fitting size."""

    def step(part: int, blocks: dict[int, list[bytes]]) -> list[Row]:
        out = [(part, COUNTS, p) for p in blocks.get(COUNTS, [])]
        tokens, nodes, n = K.unpack_all(blocks.pop(TOKENS, []), np.uint64, np.uint64, np.uint32)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        twin = np.zeros(len(tokens), bool)
        same = tokens[1:] == tokens[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        tokens, nodes, n = tokens[twin], nodes[order[twin]], n[order[twin]].astype(np.int64)
        order = np.lexsort((nodes, n, tokens))
        tokens, nodes, n = tokens[order], nodes[order], n[order]
        new = firsts(tokens, nodes)
        tokens, nodes, n = tokens[new], nodes[new], n[new]
        fits = np.zeros(len(tokens), bool)
        close = (tokens[1:] == tokens[:-1]) & (100 * n[:-1] >= percent * n[1:])
        fits[1:] |= close
        fits[:-1] |= close
        node, first, times = np.unique(nodes[fits], return_index=True, return_counts=True)
        return out + spread(node, keys, COUNTS, n[fits][first].astype(np.uint32), times.astype(np.uint32))

    return step


@lru_cache(maxsize=1 << 16)
def _least_shared(n: int, percent: int) -> int:
    """How many prefix tokens a set of n tokens shares at least with any similar set that is not larger; larger ones share as many."""
    sizes = np.arange(-(-n * percent // 100), n + 1)
    common = -(-percent * (n + sizes) // (100 + percent))
    own = 2 * (n - -(-n * percent // 100)) + 1 - (n - common)  # the i-th common token is among a set's first i + n - common
    other = 2 * (sizes - -(-sizes * percent // 100)) + 1 - (sizes - common)
    return int(np.minimum(np.minimum(own, other), common).min())


def _enough(percent: int):
    """The nodes whose shared tokens, over all ranges, are as many as with a similar set."""

    def near(payloads: list[bytes]) -> pa.RecordBatch:
        nodes, n, times = K.unpack_all(payloads, np.uint64, np.uint32, np.uint32)
        nodes, first, inverse = np.unique(nodes, return_index=True, return_inverse=True)
        n = n[first].astype(np.int64)
        size, of = np.unique(n, return_inverse=True)
        enough = np.bincount(inverse, times, len(nodes)) >= np.array([_least_shared(x, percent) for x in size.tolist()], np.int64)[of]
        return pa.RecordBatch.from_arrays([pa.array(nodes[enough].view(np.int64))], ["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for part, _, payload in rows_of(batches):
            if part != at and held:
                yield near(held)
                held = []
            at = part
            held.append(payload)
        if held:
            yield near(held)

    return run


def _tokens(k: int, keys: np.ndarray):
    """The sets of a block of texts, which stay, and how many of them have each token, which asks for the token's frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), set()
        for number, table in enumerate(K.gathered(batches, FLUSH_BYTES)):
            block = block_number(task, number)
            values, at, signatures = _sets(table, k)
            n = np.diff(at)
            use = _new(signatures, seen) & (n > 0)
            values, n = values[use[np.repeat(np.arange(len(n)), n)]], n[use]
            if not len(values):
                continue
            sets = packed_sets(signatures[use].view(np.uint64), n, np.zeros(len(n)), 8 * n, values.tobytes())
            token, times = np.unique(values, return_counts=True)
            yield batch([(block, BLOCK, sets), *spread(token, keys, asker(block), times.astype(np.uint32))])

    return run


def _frequencies(part: int, blocks: dict[int, list[bytes]]) -> list[Row]:
    """To each block the frequencies of its tokens that several nodes have. Sets pass."""
    out = [(part, BLOCK, p) for p in blocks.get(BLOCK, [])]
    token, times, block = asked(blocks, np.uint64, np.uint32)
    if not len(token):
        return out
    order = np.argsort(token, kind="stable")
    token, times, block = token[order], times[order], block[order]
    start = np.flatnonzero(firsts(token))
    df = np.repeat(np.add.reduceat(times.astype(np.int64), start), np.diff(np.append(start, len(token))))
    many = df > 1
    return out + answers(block[many], TIMES, token[many], np.minimum(df[many], 0xFFFFFFFF).astype(np.uint32))


def _keys(tokens: np.ndarray, df: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Index keys of a set of n tokens, of which tokens (by ascending frequency df) are not its own alone."""
    own, least = n - len(tokens), -(-n * percent // 100)
    prefix = tokens[: max(0, n - least + 2 - own)]
    rare = df[: len(prefix)] <= RARE
    keys = [K.mix(prefix[rare])]
    often = prefix[~rare]
    if n <= LONG and len(often) > 1:
        i, j = np.triu_indices(len(often), 1)
        a, b = np.minimum(often[i], often[j]), np.maximum(often[i], often[j])
        keys.append(K.mix(K.mix(a) * np.uint64(3) + b))
    if 100 * n > percent * LONG:
        single = prefix[: max(0, n - least + 1 - own)]
        keys.append(K.mix(single[df[: len(single)] > RARE] ^ np.uint64(0xD1B54A32D192ED03)))
    return np.unique(np.concatenate(keys))


def _index(percent: int, keys: np.ndarray):
    """Sets, postings and labels of the nodes that have keys, at their homes."""

    def step(_: int, blocks: dict[int, list[bytes]]) -> list[Row]:
        if TIMES not in blocks or BLOCK not in blocks:
            return []
        known, times = K.unpack_all(blocks[TIMES], np.uint64, np.uint32)
        order = np.argsort(known)
        known, times = known[order], times[order]
        node, n, _, offsets, data = unpacked_sets(blocks[BLOCK])
        tokens = np.ascontiguousarray(data).view(np.uint64)
        at, shared = looked_up(known, tokens)
        df = times[at]
        found: list[tuple] = []
        for i, (a, b) in enumerate(zip((offsets[:-1] // 8).tolist(), (offsets[1:] // 8).tolist(), strict=True)):
            use = shared[a:b]
            own, often = tokens[a:b][use], df[a:b][use]
            order = np.lexsort((own, often))
            index = _keys(own[order], often[order], int(n[i]), percent)
            if len(index):
                found.append((node[i], n[i], n[i] - len(own), own, index))
        if not found:
            return []
        order = np.argsort(np.array([f[0] for f in found], np.uint64))
        found = [found[i] for i in order.tolist()]
        node, n, own = (np.array([f[i] for f in found], kind) for i, kind in ((0, np.uint64), (1, np.uint32), (2, np.uint32)))
        out = spread(node, keys, LABELS, node)
        for part, s in K.by_part(node, keys):
            some = found[s]
            out.append((part, SETS, packed_sets(node[s], n[s], own[s], np.array([8 * len(f[3]) for f in some]), b"".join(f[3].tobytes() for f in some))))
            count = [len(f[4]) for f in some]
            spreaded = (np.repeat(x[s], count) for x in (node, n, own, node))
            out.append((part, POSTINGS, K.pack(np.concatenate([f[4] for f in some]), *spreaded)))
        return out

    return step


def linked(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    keys = ranges(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter("doc_id IS NOT NULL")
    read = materialize(docs.mapInArrow(_sizes(k), "doc_id long, n long, node long, part int, payload binary"))
    sizes = read.filter("part IS NULL").select("doc_id", "n", "node")
    frequent = _frequent(read.filter("part IS NOT NULL").select("part", "payload"), sizes.agg(F.sum("n")).first()[0] or 0)
    prefixes = known.mapInArrow(_prefixes(k, percent, frequent, keys), BLOCKS)
    near = dealt(dealt(prefixes).mapInArrow(each_part(_sharing(percent, keys)), BLOCKS)).mapInArrow(_enough(percent), "node long")
    first = materialize(sizes.filter("doc_id IS NOT NULL").join(near, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    nodes = first.count()
    homes = ranges(spark, nodes)
    chosen = known.join(F.broadcast(first) if nodes <= BROADCAST_ROWS else first, "doc_id", "left_semi")
    counted = dealt(chosen.mapInArrow(_tokens(k, keys), BLOCKS)).mapInArrow(each_part(_frequencies), BLOCKS)
    state = materialize(dealt(counted).mapInArrow(each_part(_index(percent, homes)), BLOCKS), "kind", adaptive=nodes > BROADCAST_ROWS)
    labels = label_rows(connect(state, percent, homes, scattered=True)).distinct()  # rows that repeat a doc_id can give a node twice
    least = sizes.filter("doc_id IS NOT NULL AND n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    linked_ones = labels.join(least, "node")
    groups = linked_ones.groupBy("component").agg(F.min("least").alias("smallest"))
    smallest = linked_ones.join(groups, "component").select("node", "smallest")
    least = least.join(smallest, "node", "left").select("node", F.coalesce("smallest", "least").alias("least"))
    out = sizes.join(least, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
