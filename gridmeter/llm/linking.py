"""Distributed union-find, and joins of sets that lose no component while they avoid all pairs.

Nodes are 64-bit hashes, spread evenly; a node's home is the range its number falls into. All state is packed
blocks (see ranges): nothing collects nodes, edges or labels, a hub or a hot bucket costs a row for each home,
and every step's result is a table in the shared folder. A step is one job of two or three small shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .ranges import BLOCKS, Row, answers, asked, asker, batch, dealt, each_block, each_part, firsts, looked_up, rows_of, spread
from .storage import materialize, partitions, release

U64, U32 = np.uint64, np.uint32
#: Kinds of blocks: edges (u, v); labels (node, label); postings (key, node, n, own, label); sets (node, n, own, bytes; all bytes);
#: what a label becomes (from, to); pivots of keys (like postings); wanted sets (node, home); lent sets (like sets).
EDGES, LABELS, POSTINGS, SETS, TURNS, PIVOTS, WANTED, LENT = range(8)
_POSTING = (U64, U64, U32, U32, U64)
#: Sets of a home, where there are few, words of a parity sketch, pairs compared at once, a bucket's pivots in the first round, by how much they grow from round to round, and nodes of
#: a bucket that are all pivots at once.
HOME, SKETCH, PAIRS, FIRST, GROWTH, SMALL = 1000, 12, 1 << 18, 4, 8, 32
#: Bytes of blocks for each task of a step, which may hold several homes; bytes of lent sets that are compared at once.
TASK_BYTES, LENT_BYTES = 2 << 20, 4 << 20


def ranges(spark: SparkSession, rows: int | None = None) -> np.ndarray:
    """The ranges of hashes that one step deals rows to: one for each partition, or fewer, with HOME rows on average."""
    n = partitions(spark)
    return K.even_keys(n if rows is None else max(1, min(n, -(-rows // HOME))), 1)


def _bytes(blocks: DataFrame) -> dict[int, int]:
    """Bytes of blocks by kind."""
    return dict(blocks.groupBy("kind").agg(F.sum(F.octet_length("payload"))).collect())


def _tasks(size: int, keys: np.ndarray) -> int:
    """Tasks for blocks of so many bytes: what little is left in later rounds does not start one for each home."""
    return max(1, min(len(keys), -(-size // TASK_BYTES)))


# --- union-find
def _ask_turn(keys: np.ndarray):
    """For each label of a block its smallest neighbour there."""

    def step(part: int, kind: int, payload: bytes) -> list[Row]:
        if kind == EDGES:
            u, v = K.unpack(payload, U64, U64)
            label, near = np.concatenate([u, v]), np.concatenate([v, u])
            order = np.lexsort((near, label))
            label, near = label[order], near[order]
            new = firsts(label)
            label, near = label[new], near[new]
        else:
            label = near = np.unique(K.unpack(payload, *(_POSTING if kind == POSTINGS else (U64, U64)))[-1])
        return spread(label, keys, asker(part), near)

    return step


def _answer_turn(_: int, blocks: dict[int, list[bytes]]) -> list[Row]:
    label, near, home = asked(blocks, U64, U64)
    order = np.lexsort((near, label))
    label, near, home = label[order], near[order], home[order]
    new = firsts(label)
    to = near[np.flatnonzero(new)[np.cumsum(new) - 1]]
    less = to < label
    return answers(home[less], TURNS, label[less], to[less])


def _turn(part: int, blocks: dict[int, list[bytes]]) -> list[Row]:
    """Every label becomes its smallest neighbour, everywhere alike: so an edge that is left still ties what has either label."""
    before, to = K.unpack_all(blocks.get(TURNS, []), U64, U64)
    before, first = np.unique(before, return_index=True)
    to = to[first]

    def turned(x: np.ndarray) -> np.ndarray:
        at, there = looked_up(before, x)
        return np.where(there, to[at], x) if len(before) else x

    out: list[Row] = []
    u, v = (turned(x) for x in K.unpack_all(blocks.get(EDGES, []), U64, U64))
    u, v = np.maximum(u, v), np.minimum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    keep = firsts(u, v) & (u != v)
    if keep.any():
        out.append((part, EDGES, K.pack(u[keep], v[keep])))
    for kind, columns in ((LABELS, (U64, U64)), (POSTINGS, _POSTING)):
        for payload in blocks.get(kind, []):
            *own, label = K.unpack(payload, *columns)
            out.append((part, kind, K.pack(*own, turned(label))))
    return out


def _unite(state: DataFrame, keys: np.ndarray) -> DataFrame:
    """state (edges between labels, labels of nodes, postings) with all edges contracted.

    A label that has a smaller neighbour becomes the smallest of them. As labels are hashes, chains of ever
    smaller labels are short, and the rounds are about the logarithm of the largest component's size.
    """
    while (size := _bytes(state)).get(EDGES):
        n = _tasks(sum(size.values()), keys)
        turns = dealt(state.mapInArrow(each_block(_ask_turn(keys)), BLOCKS), n=n).mapInArrow(each_part(_answer_turn), BLOCKS)
        new = materialize(dealt(state, turns, n=n).mapInArrow(each_part(_turn), BLOCKS), "kind", adaptive=False)
        release(state)
        state = new
    return state


# --- comparing buckets with pivots
def packed_sets(node: np.ndarray, n: np.ndarray, own: np.ndarray, size: np.ndarray, raw: bytes) -> bytes:
    return K.pack(node, n.astype(U32), own.astype(U32), size.astype(np.int64)) + raw


def unpacked_sets(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, n, own, offsets of their bytes, and all bytes."""
    heads = [K.unpack(p, U64, U32, U32, np.int64) for p in payloads]
    node, n, own, size = (np.concatenate([h[i] for h in heads]) if heads else np.zeros(0, k) for i, k in enumerate((U64, U32, U32, np.int64)))
    data = np.concatenate([np.frombuffer(p, np.uint8)[8 + 24 * len(h[0]) :] for p, h in zip(payloads, heads, strict=True)]) if heads else np.zeros(0, np.uint8)
    return node, n, own, np.concatenate([[0], np.cumsum(size)]), data


def picked_sets(chosen: np.ndarray, node: np.ndarray, n: np.ndarray, own: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> bytes:
    raw = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in chosen.tolist())
    return packed_sets(node[chosen], n[chosen], own[chosen], np.diff(offsets)[chosen], raw)


def _propose(pivots: int, keys: np.ndarray):
    """Of each key the least and greatest label of a block and its number of nodes, and the nodes of its rarest labels there."""
    pivots = max(pivots, SMALL)

    def step(part: int, kind: int, *payloads: bytes) -> list[Row]:
        key, node, n, own, label = K.unpack_all(payloads, *_POSTING)
        order = np.lexsort((label, key))
        key, node, n, own, label = (x[order] for x in (key, node, n, own, label))
        start = np.flatnonzero(firsts(key))
        of = np.flatnonzero(firsts(key, label))
        times = np.repeat(np.diff(np.append(of, len(key))), np.diff(np.append(of, len(key)))).astype(U32)
        out = spread(key[start], keys, 2 * part, label[start], label[np.append(start[1:], len(key)) - 1], np.diff(np.append(start, len(key))).astype(U32))
        order = np.lexsort((node, own, times, key))
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        order = order[rank < pivots]
        return out + spread(key[order], keys, 2 * part + 1, node[order], n[order], own[order], label[order], times[order])

    return step


def _choose(pivots: int, keys: np.ndarray):
    """The pivots of the keys that have several labels, to all homes that asked, and the pivots' sets wanted there.

    All nodes of a small bucket are its pivots; of two pivots the greater node is compared with the lesser one, so only homes of greater ones want it.
    """
    by_key = np.argsort(keys)

    def step(_: int, blocks: dict[int, list[bytes]]) -> list[Row]:
        key, low, high, size, home = asked({asker(k // 2): v for k, v in blocks.items() if k % 2 == 0}, U64, U64, U64, U32)
        order = np.argsort(key, kind="stable")
        key, low, high, size, home = key[order], low[order], high[order], size[order], home[order]
        start = np.flatnonzero(firsts(key))
        times = np.diff(np.append(start, len(key)))
        several = np.repeat(np.minimum.reduceat(low, start) < np.maximum.reduceat(high, start), times)
        size = np.repeat(np.add.reduceat(size.astype(np.int64), start), times)
        key, home, size = key[several], home[several], size[several]
        if not len(key):
            return []
        rows = K.unpack_all([p for k, v in blocks.items() if k % 2 for p in v], U64, U64, U32, U32, U64, U32)
        rows = [x[looked_up(key, rows[0])[1]] for x in rows]
        order = np.lexsort((rows[4], rows[0]))
        rows = [x[order] for x in rows]
        of = np.flatnonzero(firsts(rows[0], rows[4]))
        times = np.repeat(np.add.reduceat(rows[5].astype(np.int64), of), np.diff(np.append(of, len(order))))
        order = np.lexsort((rows[1], rows[3], times, rows[0]))
        rows = [x[order] for x in rows[:5]]
        start = np.flatnonzero(firsts(rows[0]))
        most = np.where(size[np.searchsorted(key, rows[0])] <= SMALL, max(pivots, SMALL), pivots)
        few = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < most
        rows = [x[few] for x in rows]
        order = np.lexsort((rows[1], rows[0]))
        rows = [x[order] for x in rows]
        at = np.searchsorted(rows[0], key)  # every home gets all pivots of its keys
        count = np.searchsorted(rows[0], key, side="right") - at
        index = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        to = np.repeat(home, count)
        out = answers(to, PIVOTS, *(x[index] for x in rows))
        place = ((rows[1] >> U64(32)) * U64(len(keys)) >> U64(32)).astype(np.int64)  # among the homes, which ascend as nodes do
        whole = np.repeat(count == size, count)
        beside = np.append((rows[0][1:] == rows[0][:-1]) & (place[1:] == place[:-1]), False)
        its = by_key[np.searchsorted(keys[by_key], to)]
        wanted = ~whole | (its > place[index]) | ((its == place[index]) & beside[index])
        node, to = rows[1][index][wanted], to[wanted]
        order = np.lexsort((to, node))
        node, to = node[order], to[order]
        new = firsts(node, to)
        return out + spread(node[new], keys, WANTED, to[new])

    return step


def _lend(_: int, blocks: dict[int, list[bytes]]) -> Iterator[Row]:
    """The wanted sets, to the homes that want them, a home at a time."""
    if WANTED not in blocks:
        return
    wanted, home = K.unpack_all(blocks[WANTED], U64, np.int32)
    sets = unpacked_sets(blocks.get(SETS, []))
    node, first = np.unique(sets[0], return_index=True)
    at, there = looked_up(node, wanted)
    order = np.lexsort((wanted, home))
    wanted, home, at, there = wanted[order], home[order], at[order], there[order]
    keep = firsts(home, wanted) & there
    home, at = home[keep], first[at[keep]]
    cuts = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(home[a]), LENT, picked_sets(at[a:b], *sets)


def _moved(keys: np.ndarray):
    """Sets and postings of a block, to their nodes' homes among other ranges."""

    def step(_: int, kind: int, payload: bytes) -> Iterator[Row]:
        columns = unpacked_sets([payload]) if kind == SETS else K.unpack(payload, *_POSTING)
        node = columns[0 if kind == SETS else 1]
        order = np.argsort(node, kind="stable")
        for part, s in K.by_part(node[order], keys):
            yield part, kind, picked_sets(order[s], *columns) if kind == SETS else K.pack(*(c[order[s]] for c in columns))

    return step


Read = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def packed_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets whose bytes are their ascending tokens."""
    return np.ascontiguousarray(data).view(U64), offsets // 8


class _Sets:
    """Sets by node: tokens, sizes and parity sketches."""

    def __init__(self, payloads: list[bytes], read: Read):
        self.raw = unpacked_sets(payloads)
        node, n, own, offsets, data = self.raw
        self.node, self.first = np.unique(node, return_index=True)
        self.n, self.own = n.astype(np.int64), own.astype(np.int64)
        self.tokens, self.offsets = read(data, offsets)
        size = np.diff(self.offsets)
        self.sketch = K.parity(self.tokens, np.repeat(np.arange(len(size)), size), len(size), SKETCH).view(U64)

    def at(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = looked_up(self.node, nodes)
        return (self.first[at] if len(self.first) else at), there


def possible(a: _Sets, i: np.ndarray, b: _Sets, j: np.ndarray, percent: int) -> np.ndarray:
    """The places of the pairs (i of a, j of b) that may be similar; no other is.

    A node's own tokens, which no other node has and which its bytes may lack, bound its similarity: |A & B|
    <= n - own and |A | B| >= n + own of the other. Two parity sketches differ in at most as many bits as the
    sets in such tokens as others have, too, which rules out most pairs unread.
    """
    na, nb, ua, ub = a.n[i], b.n[j], a.own[i], b.own[j]
    maybe = (100 * (na - ua) >= percent * (na + ub)) & (100 * (nb - ub) >= percent * (nb + ua)) & (100 * na >= percent * nb) & (100 * nb >= percent * na)
    at = np.flatnonzero(maybe)
    apart = np.bitwise_count(a.sketch[i[at]] ^ b.sketch[j[at]]).sum(axis=1, dtype=np.int64)
    return at[(100 + percent) * (apart + ua[at] + ub[at]) <= (100 - percent) * (na[at] + nb[at])]


def similar(a: _Sets, i: int, b: _Sets, j: int, percent: int) -> bool:
    x, y = a.tokens[a.offsets[i] : a.offsets[i + 1]], b.tokens[b.offsets[j] : b.offsets[j + 1]]
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    where = np.searchsorted(y, x)
    where[where == len(y)] = 0
    shared = int((y[where] == x).sum())
    return 100 * shared >= percent * (int(a.n[i]) + int(b.n[j]) - shared)


class _Forest:
    """Labels that edges tie already; a pair of them need not be compared."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each tied label and the root of its tree."""
        u = sorted(x for x in self.parent if self.root(x) != x)
        return np.array(u, U64), np.array([self.root(x) for x in u], U64)


def _gathered(payloads: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Payloads, some LENT_BYTES at a time."""
    held, size = [], 0
    for payload in payloads:
        held.append(payload)
        size += len(payload)
        if size >= LENT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _among(key: np.ndarray, node: np.ndarray, p_key: np.ndarray, p_node: np.ndarray) -> np.ndarray:
    """Which of the rows (key, node) are among (p_key, p_node)."""
    keys, nodes = np.concatenate([p_key, key]), np.concatenate([p_node, node])
    order = np.lexsort((nodes, keys))  # stable, so that a pivot stands before equal rows
    start = np.flatnonzero(firsts(keys[order], nodes[order]))
    out = np.empty(len(order), bool)
    out[order] = np.repeat(order[start] < len(p_key), np.diff(np.append(start, len(order))))
    return out[len(p_key) :]


def _compare(percent: int, read: Read):
    def step(part: int, blocks: dict[int, Iterable[bytes]]) -> Iterator[Row]:
        if LABELS in blocks:
            yield part, LABELS, K.pack(*K.unpack_all(blocks[LABELS], U64, U64))
        if PIVOTS not in blocks or POSTINGS not in blocks:
            return
        key, node, n, own, label = K.unpack_all(blocks[POSTINGS], *_POSTING)
        pivots = K.unpack_all(blocks[PIVOTS], *_POSTING)
        order = np.lexsort((pivots[1], pivots[0]))
        p_key, p_node, _, _, p_label = (x[order] for x in pivots)
        pivot = _among(key, node, p_key, p_node)
        stays = looked_up(p_key, key)[1] & ~pivot  # a pivot that is compared leaves its bucket
        mine, forest = _Sets(blocks[SETS], read), _Forest()
        for payloads in _gathered(blocks.get(LENT, [])):
            lent = _Sets(payloads, read)
            here = lent.at(p_node)[1]
            _tie(forest, mine, lent, (key, node, label, pivot), (p_key[here], p_node[here], p_label[here]), percent)
        u, v = forest.edges()
        if len(u):
            yield part, EDGES, K.pack(u, v)
        if stays.any():
            yield part, POSTINGS, K.pack(key[stays], node[stays], n[stays], own[stays], label[stays])
            at, there = mine.at(np.unique(node[stays]))
            yield part, SETS, picked_sets(at[there], *mine.raw)

    return step


def _tie(forest: _Forest, mine: _Sets, lent: _Sets, postings: tuple[np.ndarray, ...], pivots: tuple[np.ndarray, ...], percent: int) -> None:
    """Compares a home's postings with the pivots of their keys whose sets are lent, and ties the labels of similar ones."""
    (key, node, label, pivot), (p_key, p_node, p_label) = postings, pivots
    first = np.searchsorted(p_key, key)
    count = np.searchsorted(p_key, key, side="right") - first
    steps = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + PAIRS, PAIRS))
    for a, b in zip(steps, [*steps[1:], len(key)], strict=False):
        some = np.repeat(np.arange(a, b), count[a:b])
        if not len(some):
            continue
        began = np.cumsum(count[a:b]) - count[a:b]
        at = np.repeat(first[a:b] - began, count[a:b]) + np.arange(len(some))
        open_ = (p_label[at] != label[some]) & (~pivot[some] | (p_node[at] < node[some]))
        some, at = some[open_], at[open_]
        i, there = mine.at(node[some])
        some, at, i = some[there], at[there], i[there]
        j, _ = lent.at(p_node[at])
        _, where = np.unique(i * len(lent.n) + j, return_index=True)
        where = where[possible(mine, i[where], lent, j[where], percent)]
        for x, y, u, v in zip(i[where].tolist(), j[where].tolist(), label[some[where]].tolist(), p_label[at[where]].tolist(), strict=True):
            u, v = forest.root(u), forest.root(v)
            if u != v and similar(mine, x, lent, y, percent):
                forest.parent[max(u, v)] = min(u, v)


def connect(state: DataFrame, percent: int, keys: np.ndarray, read: Read = packed_tokens, scattered: bool = False) -> DataFrame:
    """Blocks of labels (node, label): nodes that any chain of similar pairs links have one label.

    state: blocks at their nodes' homes (the ranges keys) of sets, postings (similar nodes share a key) and labels (each node's is itself).
    In each round the homes propose, for every bucket (the nodes of a key) that holds several labels, nodes
    of its rarest labels; of these some become pivots, and every other node of the bucket is compared with
    them, at home, by sets that the pivots' homes lend; pairs that a home's edges tie already are passed over.
    A pivot then leaves the bucket, and buckets with one label are done: a group of copies costs a comparison
    for each copy. All nodes of a small bucket are pivots at once. The pivots of other buckets grow eightfold
    from round to round, so what is not similar at all is compared within a logarithm of rounds. There is no
    last round: it ends when no bucket holds several labels.

    As the nodes that are left get fewer, so do their homes: a set is lent at most once to each home, so what is lent does not grow with
    the homes that the first round had. A home compares what it is lent as it reads it.

    scattered: a home's postings stand in many blocks, which meet before the first round; one proposal for each key of a home leaves then.
    """
    pivots = FIRST
    while True:
        only = lambda *kinds: state.filter(F.col("kind").isin(*kinds))  # noqa: B023, E731
        n = _tasks(sum(_bytes(only(SETS, POSTINGS)).values()), keys)
        if pivots > FIRST and 2 * n <= len(keys):
            keys, scattered = K.even_keys(n, 1), True
            moved = materialize(only(SETS, POSTINGS).mapInArrow(each_block(_moved(keys)), BLOCKS), "kind", adaptive=False)
            folders = [*moved.folders, *getattr(state, "folders", [])]
            state = moved.unionByName(only(LABELS))  # labels stay: there is one for each node, however few are left
            state.folders = folders
        propose = _propose(pivots, keys)
        if scattered:
            met = dealt(only(POSTINGS), n=n)
            proposed = met.mapInArrow(each_part(lambda part, blocks: propose(part, POSTINGS, *blocks[POSTINGS])), BLOCKS)  # noqa: B023
        else:
            proposed = only(POSTINGS).mapInArrow(each_block(propose), BLOCKS)
        scattered = False
        chosen = materialize(dealt(proposed, n=n).mapInArrow(each_part(_choose(pivots, keys)), BLOCKS), "kind", adaptive=False)
        if chosen.isEmpty():
            return only(LABELS)
        lent = dealt(only(SETS), chosen.filter(F.col("kind") == WANTED), n=n).mapInArrow(each_part(_lend), BLOCKS)
        compared = materialize(dealt(only(SETS, POSTINGS, LABELS), chosen.filter(F.col("kind") == PIVOTS), lent, n=n).mapInArrow(each_part(_compare(percent, read), last=LENT), BLOCKS), "kind", adaptive=False)
        release(chosen)
        release(state)
        united = _unite(compared.filter(F.col("kind") != SETS), keys)
        sets = compared.filter(F.col("kind") == SETS)
        state = united.unionByName(sets)
        state.folders = [*getattr(united, "folders", []), *getattr(compared, "folders", [])]
        pivots *= GROWTH


def _label_rows(batches):
    for _, _, payload in rows_of(batches):
        node, label = K.unpack(payload, U64, U64)
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(label.view(np.int64))], ["node", "component"])


def label_rows(labels: DataFrame) -> DataFrame:
    """node, component of blocks of labels."""
    return labels.mapInArrow(_label_rows, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """node, component of every end of edges (a, b), which are longs: the component's smallest node."""
    spark = edges.sparkSession
    keys = ranges(spark)

    def pack(batches):
        for b in batches:
            u, v = (K.mix(b[c].to_numpy().view(U64)) for c in ("a", "b"))
            ends = np.unique(np.concatenate([u, v]))
            order = np.argsort(u)
            yield batch(spread(u[order], keys, EDGES, v[order]) + spread(ends, keys, LABELS, ends))

    state = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(pack, BLOCKS), "kind")
    state = materialize(dealt(state).mapInArrow(each_part(_once), BLOCKS), "kind", adaptive=False)
    rows = label_rows(_unite(state, keys))
    found = rows.mapInArrow(_unmixed, "node long, component long")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def _once(part: int, blocks: dict[int, list[bytes]]) -> list[Row]:
    out = [(part, EDGES, p) for p in blocks.get(EDGES, [])]
    nodes = np.unique(K.unpack_all(blocks.get(LABELS, []), U64, U64)[0])
    return [*out, (part, LABELS, K.pack(nodes, nodes))]


def _unmixed(batches):
    for b in batches:
        node = K.unmix(b["node"].to_numpy().view(U64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node), b["component"]], ["node", "component"])
