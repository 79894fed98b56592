"""Substring de-duplication: words of repeated fixed-length windows are removed, all but their first occurrence.

Every window of `width` words is hashed by Rabin-Karp. A task sorts its windows by hash and keeps, for
each distinct one, only its first occurrence (one very frequent passage thus costs a row per task, not
a row per copy); these go to the range of their hash as packed blocks, where the first of all is found.
All other occurrences come back as start lists per document and merge into maximal removal intervals.

Defined results: null text is empty; a document shorter than `width` loses nothing; a row without
doc_id neither removes nor loses words; rows that share doc_id *and* text are the same document and
share its fate; rows that share a doc_id but differ in text are documents of their own, in the order of their
texts' hashes. Other columns are ignored. Windows are compared by 96 bits of two independent hashes: among 1.6e13
windows (100 TB) a false match is expected once in 600 such corpora.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .ranges import BLOCKS, Row, batch, dealt, each_part, firsts, rows_of, spread
from .storage import BROADCAST_ROWS, materialize, partitions, small_batches, with_keys

#: Bytes of text whose windows are sorted at once in a task.
FLUSH_BYTES = 3 << 20
#: Kinds of blocks: first occurrences by range of hash, later ones by range of document.
EARLY, LATER = 0, 1


def _first_occurrences(width: int, keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.gathered(batches, FLUSH_BYTES):
            table = table.filter(pc.is_valid(table["doc_id"])).sort_by("doc_id")
            ids = table["doc_id"].to_numpy()
            data, offsets = K.utf8(table["text"])
            starts, ends, words = K.word_spans(data, offsets)
            word = K.span_hashes(data, starts, ends)
            hashes, row, start = K.windows(word, words, width)
            if not len(hashes):
                continue
            check = K.checks(word, words, width)
            order = np.argsort(hashes, kind="stable")  # within a hash by doc_id, then start
            hashes, check, row, start = hashes[order], check[order], row[order], start[order].astype(np.int32)
            doc = ids[row]
            new = firsts(hashes, check)
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            lost = (doc != doc[first]) | (start != start[first])
            here = ~lost
            yield batch(spread(hashes[here], keys, EARLY, check[here], doc[here], start[here]) + _by_document(doc[lost], start[lost], keys))

    return run


def _by_document(doc: np.ndarray, start: np.ndarray, keys: np.ndarray) -> list[Row]:
    """Packed starts by range of the documents' hashes."""
    hashes = K.mix(doc.view(np.uint64))
    order = np.argsort(hashes, kind="stable")
    hashes, doc, start = hashes[order], doc[order], start[order]
    return [(part, LATER, K.pack(doc[at], start[at])) for part, at in K.by_part(hashes, keys)]


def _later_ones(keys: np.ndarray):
    """The later occurrences, by document, of one range of hashes; those already known pass."""

    def step(part: int, blocks: dict[int, list[bytes]]) -> list[Row]:
        out = [(part, LATER, p) for p in blocks.get(LATER, [])]
        hashes, check, doc, start = K.unpack_all(blocks.pop(EARLY, []), np.uint64, np.uint32, np.int64, np.int32)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        twin = np.zeros(len(hashes), dtype=bool)
        same = hashes[1:] == hashes[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        order, hashes = order[twin], hashes[twin]
        if not len(order):
            return out
        check, doc, start = check[order], doc[order], start[order]
        order = np.lexsort((start, doc, check, hashes))
        hashes, check, doc, start = hashes[order], check[order], doc[order], start[order]
        new = firsts(hashes, check)
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        lost = (doc != doc[first]) | (start != start[first])
        return out + _by_document(doc[lost], start[lost], keys)

    return step


def _start_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, starts: a row for each document of a range. Rows come sorted by part."""
    blocks: list[bytes] = []
    at = None

    def lists() -> Iterator[pa.RecordBatch]:
        doc, start = K.unpack_all(blocks, np.int64, np.int32)
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order]
        cuts = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
        for i in range(0, len(cuts) - 1, 1000):
            some = cuts[i : i + 1001]
            yield pa.RecordBatch.from_arrays([pa.array(doc[some[:-1]]), pa.array([start[a:b].tobytes() for a, b in zip(some, some[1:], strict=False)], pa.binary())], ["doc_id", "starts"])

    for part, _, payload in rows_of(batches):
        if part != at and blocks:
            yield from lists()
            blocks = []
        at = part
        blocks.append(payload)
    if blocks:
        yield from lists()


def removed_starts(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, starts (packed 32-bit numbers): every window that occurs earlier elsewhere, for documents that have any."""
    n = partitions(docs.sparkSession)
    keys = K.even_keys(n, 1)
    blocks = docs.select("doc_id", "text").mapInArrow(_first_occurrences(width, keys), BLOCKS)
    later = dealt(blocks).mapInArrow(each_part(_later_ones(keys)), BLOCKS)
    return materialize(dealt(later).mapInArrow(_start_lists, "doc_id long, starts binary"))


def _keep(width: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, starts in zip(batch["text"], batch["starts"], strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n_words.append(len(words))
                if starts.is_valid and words:
                    at = np.frombuffer(starts.as_buffer(), np.int32)
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = at[at + width <= len(words)]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[i] for i in kept.tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                texts.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            out = {"doc_id": batch["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
            del words, kept, texts, out
        K.trim()

    return run


def remove_repeated(docs: DataFrame, width: int = 20, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (or kept_sha256) of every row of docs (columns doc_id, text).

    Kept words are joined by one space; digest hashes that text where it is made.
    """
    small_batches(docs.sparkSession)
    rows = with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    docs = rows.select(F.col("key").alias("doc_id"), "text", F.col("doc_id").alias("own"))
    lost = removed_starts(docs, width)
    none = F.lit(None).cast("binary").alias("starts")
    if lost.count() <= BROADCAST_ROWS:  # only the texts that lose words are shuffled
        ids = F.broadcast(lost.select("doc_id"))
        whole = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", "own", none)
        both = docs.join(ids, "doc_id", "left_semi").join(lost, "doc_id").unionByName(whole)
    else:
        both = docs.join(lost, "doc_id", "left")
    kept = both.select(F.col("own").alias("doc_id"), "text", "starts").mapInArrow(_keep(width, digest), "doc_id long, n_words long, n_removed long, kept string")
    return kept.withColumnRenamed("kept", "kept_sha256" if digest else "kept_text")
