"""Token ids in binary files: patched frame-of-reference blocks.

Texts are encoded with a given vocabulary file, ids go to segments in ascending doc_id order, and a
segment's payload holds its ids in blocks: the block's minimum is subtracted, all values are packed
with the bit width that holds a chosen percentile of them, and what exceeds the width keeps its low
bits in place and its high bits in the block's exception list. An index of block starts lets a reader
decode any block alone; a directory of doc_id and length gives the documents.

Payload, little-endian: "PFR1", u32 block size, u64 values, u64 documents, i64 doc_id of each, u64
length of each, u64 start of each block (from the first one's), then the blocks: u32 minimum,
u8 width, u16 exceptions, packed bits, u16 exception positions, u32 exception high bits.
Container: Parquet rows (part, seq, n_ids, payload), so that any store Spark writes to can hold it.

Defined results: null text is empty and holds the end id only; rows without doc_id come first; rows
that repeat a doc_id stand in the order of their texts' hashes, so that one id may hold most rows. Other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import partitions, shared_folder, small_batches

BLOCK = 2048
PERCENTILE = 90
#: Ids after which a segment is closed; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 19
FLUSH_BYTES = 3 << 20
#: Words whose ids a worker remembers from one piece of text to the next.
REMEMBERED = 2_000_000
#: Words that go through the tokenizer at once, and characters of which the first with a single id stands between them.
JOINED = 512
MARKS = "¤¦§¶†‡€™"
_FILES = "part int, seq int, n_ids long, payload binary"


def _bits(values: np.ndarray, width: int) -> bytes:
    """values, each in width bits, lowest first."""
    bits = np.unpackbits(values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def encode_block(values: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    low = int(values.min())
    rest = values - np.uint32(low)
    rank = max(0, -(-len(rest) * percentile // 100) - 1)
    width = int(np.partition(rest, rank)[rank]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = (rest[over] >> np.uint32(width)).astype(np.uint32) if width < 32 else np.zeros(0, np.uint32)
    body = _bits(rest, width) if width else b""
    return np.uint32(low).tobytes() + bytes([width]) + np.uint16(len(over)).tobytes() + body + over.astype(np.uint16).tobytes() + high.tobytes()


def decode_block(payload: memoryview, n: int) -> np.ndarray:
    low, width, over = int(np.frombuffer(payload, np.uint32, 1)[0]), payload[4], int(np.frombuffer(payload[5:7], np.uint16)[0])
    at = 7 + -(-n * width // 8)
    out = np.zeros(n, np.uint32)
    if width:
        bits = np.zeros((n, 32), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(payload[7:at], np.uint8), count=n * width, bitorder="little").reshape(n, width)
        out = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)
    if over:
        where = np.frombuffer(payload[at : at + 2 * over], np.uint16)
        out[where] |= np.frombuffer(payload[at + 2 * over : at + 6 * over], np.uint32) << np.uint32(width)
    return out + np.uint32(low)


def write_segment(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    blocks = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)], dtype=np.uint64)[:-1] if blocks else np.zeros(0, np.uint64)
    head = b"PFR1" + np.uint32(BLOCK).tobytes() + np.uint64(len(ids)).tobytes() + np.uint64(len(doc_ids)).tobytes()
    return head + doc_ids.astype(np.int64).tobytes() + lengths.astype(np.uint64).tobytes() + starts.tobytes() + b"".join(blocks)


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, doc_id and length of each document."""
    view = memoryview(payload)
    if bytes(view[:4]) != b"PFR1":
        raise ValueError("not a segment of token ids")
    block = int(np.frombuffer(view[4:8], np.uint32)[0])
    n, docs = (int(x) for x in np.frombuffer(view[8:24], np.uint64))
    n_blocks = -(-n // block)
    at = 24 + 16 * docs
    doc_ids, lengths = np.frombuffer(view[24 : 24 + 8 * docs], np.int64), np.frombuffer(view[24 + 8 * docs : at], np.uint64)
    starts = np.frombuffer(view[at : at + 8 * n_blocks], np.uint64).astype(np.int64) + at + 8 * n_blocks
    ids = [decode_block(view[s:], min(block, n - i * block)) for i, s in enumerate(starts.tolist())]
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), doc_ids, lengths.astype(np.int64)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTER, _TAIL = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(_CAPITALS.encode() + _CAPITALS.lower().encode())] = True
_TAIL[list(b",.!?;:")] = True


def _without_tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that end in up to three of `,.!?;:` after an ASCII letter become two spans."""
    tail = ends.copy()
    for _ in range(3):
        tail -= (tail - starts > 1) & _TAIL[data[tail - 1]]
    cut = np.flatnonzero((tail < ends) & _LETTER[data[np.maximum(tail - 1, 0)]])
    if not len(cut):
        return starts, ends, rows
    before = np.concatenate([[0], np.cumsum((tail < ends) & _LETTER[data[np.maximum(tail - 1, 0)]])])
    old_ends = ends[cut]
    ends = ends.copy()
    ends[cut] = tail[cut]
    return np.insert(starts, cut + 1, tail[cut]), np.insert(ends, cut + 1, old_ends), rows + before[rows]


class WordEncoder:
    """Encodes texts word by word.

    The vocabulary's pre-tokenizer drops white space, and so neither its normalizer nor its merges
    reach across it: a text's ids are those of its words, one after another. Each distinct word of a
    piece is encoded once, and the commonest stay known for the next. Where the vocabulary's own parts
    show that it reads capitals as small letters, or cuts letters from punctuation, words that differ
    in that only are encoded once.
    """

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = _tokenizer(path), end_id
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        normal, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.folds = normal is not None and normal.normalize_str(_CAPITALS) == _CAPITALS.lower()
        self.added = [t.lower().encode() for t in added]
        self.cuts = cutter is not None and all(len(cutter.pre_tokenize_str(f"a{c}")) == 2 and not any(c in t for t in added) for c in ",.!?;:")
        marks = ((c, self.tokenizer.encode(c, add_special_tokens=False).ids) for c in MARKS)
        self.mark = next(((c, ids[0]) for c, ids in marks if len(ids) == 1), None)
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids. Words go through the tokenizer joined by a mark with one id of its own."""
        lengths, pools = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            if self.mark:
                ids = np.array(self.tokenizer.encode_batch_fast([f" {self.mark[0]} ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                is_mark = ids == self.mark[1]
                if int(is_mark.sum()) == len(some) - 1:  # no word holds the mark
                    edges = np.concatenate([[-1], np.flatnonzero(is_mark), [len(ids)]])
                    lengths.append(np.diff(edges) - 1)
                    pools.append(ids[~is_mark])
                    continue
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            pools.append(np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(lengths), np.concatenate(pools)

    def encode(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each ending with end_id, and the number of each."""
        data, offsets = K.utf8(column)
        starts, ends, rows = K.word_spans(data, offsets)
        if self.cuts:
            starts, ends, rows = _without_tails(data, starts, ends, rows)
        raw = data.tobytes()
        low = raw.lower()
        folds = self.folds and not any(t in low for t in self.added)  # added tokens are matched before letters are changed
        hashes, first, inverse = np.unique(K.span_hashes(data, starts, ends, K.FOLDED if folds else K.BYTES), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, hashes)
        slot[slot == len(self.known)] = 0
        old = self.known[slot] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~old)
        words = [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        length, ids = self._learn(words)
        at = np.cumsum(length) - length
        all_length, all_at = np.empty(len(hashes) + 1, np.int64), np.empty(len(hashes) + 1, np.int64)
        all_length[:-1][old], all_at[:-1][old] = self.length[slot[old]], self.at[slot[old]]
        all_length[new], all_at[new] = length, at + len(self.pool)
        pool = np.concatenate([self.pool, ids, np.array([self.end_id], np.uint32)])
        all_length[-1], all_at[-1] = 1, len(pool) - 1
        if len(self.known) + len(new) <= REMEMBERED:
            here = np.searchsorted(self.known, hashes[new])
            self.pool = pool[:-1]
            self.known = np.insert(self.known, here, hashes[new])
            self.length = np.insert(self.length, here, length)
            self.at = np.insert(self.at, here, all_at[new])
        word = np.insert(inverse, rows[1:], len(hashes))  # the end of each row
        n = all_length[word]
        before = np.cumsum(n) - n
        out = pool[np.repeat(all_at[word] - before, n) + np.arange(int(n.sum()))]
        edges = rows + np.arange(len(rows))  # words and ends before each row
        total = np.concatenate([before, [len(out)]])
        return out, np.diff(total[edges])


class TextEncoder:
    """Encodes whole texts, for vocabularies to which white space matters."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = _tokenizer(path), end_id

    def encode(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        lengths = np.fromiter((len(ids) + 1 for ids in found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in (*ids, self.end_id)), np.uint32, int(lengths.sum())), lengths


def drops_space(path: str) -> bool:
    """Whether a vocabulary's pre-tokenizer cuts at white space and leaves none, not even a mark for it, in what it cuts."""
    cutter = _tokenizer(path).pre_tokenizer
    if cutter is None:
        return False
    words = ["one", "Two", "x1", "drei"]
    bare = [w for word in words for w, _ in cutter.pre_tokenize_str(word)]
    return all([w for w, _ in cutter.pre_tokenize_str(text)] == bare for space in (" ", "  ", "\t", "\n", "\x0b", "\f", "\r", " \n ") for text in (space.join(words), space + space.join(words) + space))


def encoder(path: str, end_id: int) -> WordEncoder | TextEncoder:
    return (WordEncoder if drops_space(path) else TextEncoder)(path, end_id)


_encoders: dict[tuple[str, int], WordEncoder | TextEncoder] = {}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = encoder(path, end_id)
        own = _encoders[path, end_id]
        part, seq = TaskContext.get().partitionId(), 0
        for table in K.gathered(batches, FLUSH_BYTES):
            ids, lengths = own.encode(table["text"])
            doc_ids = table["doc_id"].fill_null(-(1 << 63)).to_numpy()
            ends = np.cumsum(lengths)
            a = 0
            while a < len(doc_ids):
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + SEGMENT_IDS, side="right")))
                payload = write_segment(ids[done : int(ends[b - 1])], doc_ids[a:b], lengths[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(ends[b - 1]) - done], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "n_ids", "payload"])
                a, seq = b, seq + 1

    return run


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1) -> None:
    """Files of the ids of every row of docs (doc_id, text), in ascending doc_id order, under path."""
    small_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    rows.mapInArrow(_encode(vocabulary, end_id), _FILES).write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, payload in zip(batch["start"].to_pylist(), batch["payload"], strict=True):
            ids, doc_ids, lengths = read_segment(payload.as_buffer())
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [pa.array(doc_ids, mask=doc_ids == -(1 << 63)), pa.array(ends - lengths + start), pa.array(lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under path."""
    files = spark.read.schema(_FILES).parquet(path)
    before, total = {}, 0
    for part, n in sorted(map(tuple, files.groupBy("part").agg(F.sum("n_ids")).collect())):  # a row for each file
        before[part], total = total, total + n
    known = spark.createDataFrame(list(before.items()), "part int, before long")
    ahead = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "seq", "n_ids").join(known, "part").select("part", "seq", (F.col("before") + F.coalesce(F.sum("n_ids").over(ahead), F.lit(0))).alias("start"))
    return files.join(F.broadcast(sizes) if len(before) <= 100_000 and total <= 1 << 40 else sizes, ["part", "seq"]).select("start", "payload").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    path = shared_folder(docs.sparkSession)
    write(docs, vocabulary, path, end_id)
    return read(docs.sparkSession, path)
