"""Fuzzy line de-duplication by MinHash.

A line is what stands between line feeds, without outer blanks, ASCII folded, other white space as spaces.
Equal lines are one node. Each distinct line's character shingles (8 consecutive bytes of UTF-8; a shorter
line is one shingle) give a signature of BANDS x ROWS minima; lines that agree in a band are candidates (at
a similarity of 0.8 a pair is met with a probability of 0.995, at 0.9 of 0.99997). Candidates' exact Jaccard
similarities are verified, and of each component of similar lines the first occurrence in the corpus
(least doc_id, then line) stays; all others are removed.

Texts are read once. Their occurrences stay in blocks of some documents; what leaves a block is one row for
each distinct line (its first occurrence there), so a line that every document has costs a row for each block.
The line's home learns which of its bands other lines share, linking.connect compares buckets with pivots, not
pair by pair, and the homes tell the blocks which occurrence stays.

Defined results: blank lines are never removed; null or empty text has 0 lines; a row without doc_id
neither removes nor loses lines; rows that repeat a doc_id count as one document where their texts are equal,
and as documents of their own where they differ, in the order of the texts' hashes. Other columns are
ignored. Lines are told apart by 64-bit hashes (see kernels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .linking import LABELS, POSTINGS, SETS, U32, U64, connect, packed_sets
from .ranges import BLOCKS, Row, answers, asked, asker, batch, block_number, dealt, each_part, firsts, looked_up, rows_of, spread
from .storage import materialize, partitions, release, small_batches, with_keys

FLUSH_BYTES = 2 << 20
#: Bytes of text for each home of lines.
HOME_BYTES = 12 << 20
SHINGLE, BANDS, ROWS, PERCENT = 8, 10, 4, 80
#: Shingles whose minima are taken at once; lines a task remembers having sent, which changes the volume only.
CACHED, REMEMBERED = 1 << 16, 1 << 20
#: Bits of a band that are kept; two bands that agree in them by chance only make a candidate.
BAND_BITS = 40
CUT = U64(64 - BAND_BITS)
#: Kinds of blocks beside linking's: occurrences of a block's lines, its first ones, texts of lines, lines with all their bands, shared bands, what stays.
OCCURRENCES, FIRSTS, TEXTS, BANDED, SHARED, STAYS = range(20, 26)
_PLACE = (U64, np.int64, np.int32)
_random = np.random.default_rng(97)
MULTIPLY = _random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
NORMAL = np.arange(256, dtype=np.uint8)
NORMAL[65:91] += 32
NORMAL[[9, 11, 12, 13]] = 32


def lines(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes; start, end, row and number (within the row) of every line that isn't blank."""
    data, offsets = K.utf8(column)
    data = NORMAL[data]
    starts, ends, _ = K.word_spans(data, offsets)
    feeds = np.flatnonzero(data == 10)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return data, none, none, none, none
    first = np.unique(np.searchsorted(starts, np.concatenate([offsets[:-1], feeds])))  # the words that rows and line feeds are followed by
    first = first[first < len(starts)]
    begin, end = starts[first], ends[np.append(first[1:], len(starts)) - 1]
    row = np.searchsorted(offsets, begin, side="right") - 1
    return data, begin, end, row, np.searchsorted(feeds, begin) - np.searchsorted(feeds, offsets)[row]


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all spans, one after another, and where each span's begin. A shingle is its 8 bytes, or a hash of a shorter span."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    windows = np.empty(len(data) + 8, np.uint64)
    for i in range(8):
        part = np.frombuffer(padded.data, np.uint64, (len(padded) - i) // 8, i)
        windows[i::8] = part[: len(windows[i::8])]
    n = np.maximum(ends - starts - SHINGLE + 1, 1)
    at = np.cumsum(n) - n
    out = windows[np.repeat(starts - at, n) + np.arange(int(n.sum()))]
    short = np.flatnonzero(ends - starts < SHINGLE)
    if len(short):
        out[at[short]] = K.span_hashes(data, starts[short], ends[short]) | np.uint64(1 << 63)  # no eight bytes of UTF-8 look like a short line's hash by chance alone
    return out, at


def _bands(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """lines x BANDS keys, of which the upper BAND_BITS bits say all; some lines at a time, so that their shingles stay in the processor's cache."""
    minima = np.empty((BANDS * ROWS, len(at)), np.uint32)
    ends = np.append(at[1:], len(grams))
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, at[i] + CACHED, side="right")))
        base = ((grams[at[i] : ends[j - 1]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        begin = at[i:j] - at[i]
        scratch = np.empty_like(base)
        for r in range(BANDS * ROWS):
            np.multiply(base, MULTIPLY[r], out=scratch)
            scratch += ADD[r]
            np.minimum.reduceat(scratch, begin, out=minima[r, i:j])
        i = j
    keys = np.empty((len(at), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(at), band + 1, np.uint64)
        for r in range(band * ROWS, (band + 1) * ROWS):
            key = K.mix(key * np.uint64(0xD6E8FEB86659FD93) + minima[r])
        keys[:, band] = key >> CUT << CUT
    return keys


def line_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending shingles of normalised lines that stand end to end, and their offsets."""
    grams, at = _grams(data, offsets[:-1], offsets[1:])
    rows = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(grams))))
    return K.distinct_by_row(grams, rows, len(at))


def _read_lines(keys: np.ndarray):
    """Per block of documents: its occurrences (which stay), its first ones and the bands and texts of lines (which go to the lines' homes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), set()
        for number_of_block, table in enumerate(K.gathered(batches, FLUSH_BYTES)):
            block = block_number(task, number_of_block)
            table = table.filter(pc.is_valid(table["doc_id"]))
            data, starts, ends, row, number = lines(table["text"])
            if not len(starts):
                continue
            node, doc, number = K.span_hashes(data, starts, ends), table["doc_id"].to_numpy()[row], number.astype(np.int32)
            order = np.lexsort((number, doc, node))
            node, doc, number = node[order], doc[order], number[order]
            new = firsts(node, doc, number)  # rows that repeat a doc_id
            node, doc, number, order = node[new], doc[new], number[new], order[new]
            out: list[Row] = [(block, OCCURRENCES, K.pack(node, doc, number))]
            first = firsts(node)
            node, doc, number, order = node[first], doc[first], number[first], order[first]
            out += spread(node, keys, FIRSTS, doc, number, np.full(len(node), block, np.int32))
            if len(seen) > REMEMBERED:
                seen = set()
            fresh = np.fromiter((x not in seen for x in node.tolist()), bool, len(node))
            seen.update(node[fresh].tolist())
            node, order = node[fresh], order[fresh]
            raw, size = data.tobytes(), (ends - starts)[order]
            raw = b"".join([raw[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True)])
            edges = np.append(0, np.cumsum(size))
            bands = _bands_of(np.frombuffer(raw, np.uint8), edges)
            for part, s in K.by_part(node, keys):
                out.append((part, BANDED, _packed_bands(node[s], bands[s])))
                out.append((part, TEXTS, _packed_texts(node[s], size[s], raw[edges[s.start] : edges[s.stop]])))
            yield batch(out)

    return run


def _bands_of(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bands of normalised lines that stand end to end."""
    bands = np.empty((len(edges) - 1, BANDS), U64)
    for i in range(0, len(bands), 1024):
        some = edges[i : i + 1025]
        bands[i : i + 1024] = _bands(*_grams(data[some[0] : some[-1]], some[:-1] - some[0], some[1:] - some[0]))
    return bands


def _packed_bands(node: np.ndarray, bands: np.ndarray) -> bytes:
    return K.pack(node, *((bands[:, i] >> U64(32)).astype(U32) for i in range(BANDS)), *((bands[:, i] >> CUT).astype(np.uint8) for i in range(BANDS)))


def _banded(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lines once each, ascending, and their bands."""
    node, *columns = K.unpack_all(payloads, U64, *[U32] * BANDS, *[np.uint8] * BANDS)
    node, first = np.unique(node, return_index=True)
    bands = np.empty((len(node), BANDS), U64)
    for i in range(BANDS):
        bands[:, i] = columns[i][first].astype(U64) << U64(32) | columns[BANDS + i][first].astype(U64) << CUT
    return node, bands


def _packed_texts(node: np.ndarray, size: np.ndarray, raw: bytes) -> bytes:
    return K.pack(node, size.astype(np.int64)) + pa.compress(raw, codec="zstd", asbytes=True)


def _texts(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines once each: node, start and end, ascending, and all bytes."""
    heads = [K.unpack(p, U64, np.int64) for p in payloads]
    node, size = (np.concatenate([h[i] for h in heads]) if heads else np.zeros(0, kind) for i, kind in enumerate((U64, np.int64)))
    data = b"".join(pa.decompress(p[8 + 16 * len(n) :], int(s.sum()), codec="zstd", asbytes=True) for p, (n, s) in zip(payloads, heads, strict=True))
    ends = np.cumsum(size)
    first = np.sort(np.unique(node, return_index=True)[1])
    return node[first], (ends - size)[first], ends[first], np.frombuffer(data, np.uint8)


def _short(bands: np.ndarray) -> np.ndarray:
    """32 bits of a band, below those that make its range; enough to ask whether any other line may share it."""
    return ((bands << U64(8)) >> U64(32)).astype(U32)


def _ask_bands(keys: np.ndarray):
    """A home asks of each of its lines' bands whether other lines share it."""

    def step(part: int, blocks: dict[int, list[bytes]]) -> list[Row]:
        flat = np.sort(_banded(blocks[BANDED])[1].reshape(-1))
        new = np.flatnonzero(firsts(flat))
        times = np.minimum(np.diff(np.append(new, len(flat))), 2).astype(np.uint8)
        flat = flat[new]
        return [(place, asker(part), K.pack(_short(flat[s]), times[s])) for place, s in K.by_part(flat, keys)]

    return step


def _shared_bands(_: int, blocks: dict[int, list[bytes]]) -> list[Row]:
    """To each home those of its bands that other lines share."""
    band, times, home = asked(blocks, U32, np.uint8)
    order = np.argsort(band, kind="stable")
    band, times, home = band[order], times[order], home[order]
    start = np.flatnonzero(firsts(band))
    several = np.repeat(np.add.reduceat(times.astype(np.int64), start) > 1, np.diff(np.append(start, len(band))))
    return answers(home[several], SHARED, band[several])


def _prepare(part: int, blocks: dict[int, list[bytes]]) -> list[Row]:
    """What linking needs of the lines that share a band."""
    shared = np.unique(K.unpack_all(blocks.get(SHARED, []), U32)[0])
    if not len(shared):
        return []
    its, bands = _banded(blocks[BANDED])
    there = looked_up(shared, _short(bands).reshape(-1))[1].reshape(bands.shape)
    node, starts, ends, data = _texts(blocks[TEXTS])
    place = np.searchsorted(its, node)
    bands, there = bands[place], there[place]
    some = np.flatnonzero(there.any(axis=1))
    out: list[Row] = []
    raw = data.tobytes()
    for i in range(0, len(some), 4096):
        at = some[i : i + 4096]
        texts = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        offsets = np.concatenate([[0], np.cumsum(ends[at] - starts[at])])
        n = np.diff(line_sets(np.frombuffer(b"".join(texts), np.uint8), offsets)[1])
        row, column = np.nonzero(there[at])
        none = np.zeros(len(at), U32)
        out += [
            (part, SETS, packed_sets(node[at], n, none, np.diff(offsets), b"".join(texts))),
            (part, LABELS, K.pack(node[at], node[at])),
            (part, POSTINGS, K.pack(bands[at][row, column], node[at][row], n[row].astype(U32), none[row], node[at][row])),
        ]
    return out


def _ask_kept(keys: np.ndarray):
    """Of each label the first occurrence that a home knows."""

    def step(part: int, blocks: dict[int, list[bytes]]) -> list[Row]:
        if LABELS not in blocks:
            return []
        node, doc, number, _ = K.unpack_all(blocks.get(FIRSTS, []), *_PLACE, np.int32)
        order = np.lexsort((number, doc, node))
        node, doc, number = node[order], doc[order], number[order]
        new = firsts(node)
        node, doc, number = node[new], doc[new], number[new]
        own, label = K.unpack_all(blocks[LABELS], U64, U64)
        at, there = looked_up(node, own)
        label, doc, number = label[there], doc[at[there]], number[at[there]]
        order = np.lexsort((number, doc, label))
        label, doc, number = label[order], doc[order], number[order]
        new = firsts(label)
        return spread(label[new], keys, asker(part), doc[new], number[new])

    return step


def _answer_kept(_: int, blocks: dict[int, list[bytes]]) -> list[Row]:
    label, doc, number, home = asked(blocks, *_PLACE)
    order = np.lexsort((number, doc, label))
    label, doc, number, home = label[order], doc[order], number[order], home[order]
    new = firsts(label)
    at = np.flatnonzero(new)[np.cumsum(new) - 1]
    return answers(home, STAYS, label, doc[at], number[at])


def _tell(_: int, blocks: dict[int, list[bytes]]) -> list[Row]:
    """To each block that has a line whose kept occurrence is elsewhere: node, doc_id, line of that."""
    node, doc, number, block = K.unpack_all(blocks.get(FIRSTS, []), *_PLACE, np.int32)
    order = np.lexsort((number, doc, node))
    node, doc, number, block = node[order], doc[order], number[order], block[order]
    new = firsts(node)
    at = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    kept_doc, kept_number = doc[at], number[at]
    if LABELS in blocks and STAYS in blocks:
        own, label = K.unpack_all(blocks[LABELS], U64, U64)
        order = np.argsort(own)
        own, label = own[order], label[order]
        name, its_doc, its_number = K.unpack_all(blocks[STAYS], *_PLACE)
        order = np.argsort(name)
        name, its_doc, its_number = name[order], its_doc[order], its_number[order]
        i, linked = looked_up(own, node)
        j, there = looked_up(name, label[i])
        linked &= there
        kept_doc, kept_number = np.where(linked, its_doc[j], kept_doc), np.where(linked, its_number[j], kept_number)
    away = (kept_doc != doc) | (kept_number != number)
    return answers(block[away], STAYS, node[away], kept_doc[away], kept_number[away])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, removed of the documents of a block that lose lines."""

    def step(_: int, blocks: dict[int, list[bytes]]) -> pa.RecordBatch:
        node, doc, number = K.unpack_all(blocks.get(OCCURRENCES, []), *_PLACE)  # sorted by node, then place
        new = firsts(node)
        at = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
        kept_doc, kept_number = doc[at], number[at]
        name, its_doc, its_number = K.unpack_all(blocks.get(STAYS, []), *_PLACE)
        order = np.argsort(name)
        name, its_doc, its_number = name[order], its_doc[order], its_number[order]
        if len(name):
            i, there = looked_up(name, node)
            kept_doc, kept_number = np.where(there, its_doc[i], kept_doc), np.where(there, its_number[i], kept_number)
        gone = (doc != kept_doc) | (number != kept_number)
        doc, number = doc[gone], number[gone]
        order = np.lexsort((number, doc))
        doc, number = doc[order], number[order]
        start = np.flatnonzero(firsts(doc))
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)).astype(np.int32)), pa.array(number))
        return pa.RecordBatch.from_arrays([pa.array(doc[start]), lists], ["doc_id", "removed"])

    at, held = None, {}
    for part, kind, payload in rows_of(batches):
        if part != at and held:
            yield step(at, held)
            held = {}
        at = part
        held.setdefault(kind, []).append(payload)
    if held:
        yield step(at, held)


def homes(spark: SparkSession, size: int) -> np.ndarray:
    """The ranges of lines: one for each HOME_BYTES of text, as far as there are partitions, so that small inputs don't fill many tasks with little."""
    return K.even_keys(max(1, min(partitions(spark), -(-size // HOME_BYTES))), 1)


def duplicate_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, removed (ascending line numbers from 0) of the documents of docs (doc_id, text) that lose lines."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    keys = homes(spark, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    read = materialize(docs.mapInArrow(_read_lines(keys), BLOCKS), "kind")
    only = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))
    n = len(keys)
    asks = dealt(only(read, BANDED), n=n).mapInArrow(each_part(_ask_bands(keys)), BLOCKS)
    shared = dealt(asks, n=n).mapInArrow(each_part(_shared_bands), BLOCKS)
    prepared = materialize(dealt(only(read, BANDED, TEXTS), shared, n=n).mapInArrow(each_part(_prepare), BLOCKS), "kind")
    for kind in (BANDED, TEXTS):
        release(read, f"kind={kind}")
    labels = connect(prepared, percent, keys, line_sets)
    first = only(read, FIRSTS)
    kept = dealt(dealt(first, labels, n=n).mapInArrow(each_part(_ask_kept(keys)), BLOCKS), n=n).mapInArrow(each_part(_answer_kept), BLOCKS)
    told = dealt(first, labels, kept, n=n).mapInArrow(each_part(_tell), BLOCKS)
    lost = dealt(only(read, OCCURRENCES), told).mapInArrow(_removed, "doc_id long, removed array<int>")
    return lost.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def n_lines(text: Column) -> Column:
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(F.octet_length(text), F.lit(0)) > 0, feeds + 1).otherwise(0).cast("long")


def _lost(rows: DataFrame, percent: int) -> DataFrame:
    """key and removed of the rows (key, text) that lose lines."""
    return materialize(duplicate_lines(rows.select(F.col("key").alias("doc_id"), "text"), percent)).withColumnRenamed("doc_id", "key")


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines of every row of docs."""
    rows = with_keys(docs.select("doc_id", "text"))
    out = rows.select("key", "doc_id", n_lines(F.col("text")).alias("n_lines")).join(_lost(rows, percent), "key", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))


def without_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the removed lines cut out of text."""
    rows = with_keys(docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("others")))
    marked = rows.join(_lost(rows, percent), "key", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    return marked.select(*(text.alias(c) if c == "text" else F.col("others")[c].alias(c) for c in docs.columns))
