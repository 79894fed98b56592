"""Token counts by a finite-state transducer that is compiled from a vocabulary file.

A vocabulary of the kind "BPE with word ends" (see PIECES) cuts a text into pieces and merges the bytes of each by rank.
Both are one deterministic transducer over bytes whose transitions carry the number of tokens that they add:

* A state holds where the piece pattern stands, a byte that may still turn out to be a piece's last one, and the merge
  state of the bytes before it. Merges never cross the edge between two tokens of the result, so the tokens of a prefix
  are those of a shorter prefix and one more, and two tokens stand side by side where no merge across their edge comes
  first (`_side_by_side`). What a later byte can ask of a prefix is therefore, for each place from which the bytes so far
  begin some token, the token that ends there and how many fewer tokens there are up to it: finitely many states.
* States and transitions are compiled when they are first met, and kept by the Python worker; all are dropped when
  they exceed a limit, which changes no result.

Texts are cut into chunks, which all advance together, a byte a step. A chunk's map tells for each state in which it may
be entered the state in which it is left and the tokens counted. Behind white space only the start state is possible; where
a chunk begins inside a long word, the states in which the chunk before it may be left are tried until no new one
appears. The maps compose by pointer doubling, a parallel prefix scan, so that a text without spaces is no sequential task.

Defined results: null text is empty and has no tokens; the strings of the vocabulary's special tokens inside a text count one,
as the library has it by default. Rows may repeat or lack doc_id; other columns are ignored; no row moves.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .storage import small_batches

#: The piece pattern and normalizers of the vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_END = "</w>"

FLUSH_BYTES = 3 << 20
CHUNK = 512
#: Transitions after which a worker starts anew.
KEPT = 1_200_000
_WORDS_KEPT = 300_000

LETTER, NUMBER, OTHER, BLANK = range(4)
_NO_CLASS = 4
_ADDED = 1024  # the symbol of a special token; others are class << 8 | byte
_SYMBOL_BITS = 11
_NONE, _LETTERS, _DONE, _OTHERS, _QUOTE, _QUOTE_R, _QUOTE_V, _QUOTE_L = range(8)
_SHORT, _LONG = b"stmd", {_QUOTE_R: b"re", _QUOTE_V: b"ve", _QUOTE_L: b"ll"}
_OPENS = {ord(v[:1]): k for k, v in _LONG.items()}
_EMPTY = np.uint64((1 << 64) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FOREVER = 1 << 40


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The vocabulary's tokens as bytes, inside a piece and at its end, and what its merges make of them."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]]):
        byte = _byte_of()
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.spelling: dict[int, tuple[bytes, bool]] = {}
        for token, i in tokens.items():
            ends = token.endswith(WORD_END)
            raw = bytes(byte[c] for c in (token.removesuffix(WORD_END) if ends else token))
            (self.final if ends else self.inner)[raw] = i
            self.spelling[i] = raw, ends
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        born: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = tokens[a], tokens[b], tokens[a + b]
            if any(len(self.spelling[x][0]) > 1 and x not in born for x in (left, right)):
                raise ValueError("a merge uses a token that no earlier merge makes")
            self.rank.setdefault((left, right), (r, whole))
            born.setdefault(whole, r)
        #: Bytes from which some token goes on.
        self.begun = {raw[:n] for table in (self.inner, self.final) for raw in table for n in range(1, len(raw))}
        self._edges: dict[int, tuple[list, list] | None] = {}
        self._beside: dict[tuple[int, int], bool] = {}

    def edges(self, token: int) -> tuple[list, list] | None:
        """The symbols that stand at a token's right and left edge while it is merged: (symbol, rank before which it is merged on). None if its bytes give other tokens."""
        if token not in self._edges:
            raw, ends = self.spelling[token]
            nodes = [(self.inner[raw[i : i + 1]], -1, None, None) for i in range(len(raw) - ends)]
            if ends:
                nodes.append((self.final[raw[-1:]], -1, None, None))
            while len(nodes) > 1:
                found = [(self.rank[pair][0], i) for i in range(len(nodes) - 1) if (pair := (nodes[i][0], nodes[i + 1][0])) in self.rank]
                if not found:
                    break
                r, i = min(found)
                nodes[i : i + 2] = [(self.rank[nodes[i][0], nodes[i + 1][0]][1], r, nodes[i], nodes[i + 1])]
            self._edges[token] = (self._spine(nodes[0], 3), self._spine(nodes[0], 2)) if len(nodes) == 1 and nodes[0][0] == token else None
        return self._edges[token]

    @staticmethod
    def _spine(node: tuple, child: int) -> list[tuple[int, int]]:
        out, until = [], _FOREVER
        while node is not None:
            out.append((node[0], until))
            until, node = node[1], node[child]
        return out

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether both stay whole next to each other: no merge across the edge comes before its symbols are merged on; of equal ranks the left one comes first."""
        known = self._beside.get((left, right))
        if known is None:
            known = not any((m := self.rank.get((a, b))) and m[0] < a_until and m[0] <= b_until for a, a_until in self.edges(left)[0] for b, b_until in self.edges(right)[1])
            self._beside[left, right] = known
        return known

    def step(self, state: tuple, byte: int, ends: bool) -> tuple[int, tuple]:
        """Tokens added by the next byte of a piece, and the state behind it.

        A state has the bytes from the first place on from which some token goes on, and each such place with the token
        that ends there (-1 at the piece's start) and the tokens up to it, less those of the whole prefix.
        """
        suffix, places = state
        suffix += bytes([byte])
        table = self.final if ends else self.inner
        for at, last, fewer in places:
            token = table.get(suffix[at:])
            if token is not None and self.edges(token) and (last < 0 or self._side_by_side(last, token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        added = fewer + 1
        if ends:
            return added, state
        kept = [(at, last, fewer - added) for at, last, fewer in places if suffix[at:] in self.begun]
        first = kept[0][0] if kept else len(suffix)
        return added, (suffix[first:], (*((at - first, last, fewer) for at, last, fewer in kept), (len(suffix) - first, token, 0)))


_PIECE_START = (b"", ((0, -1, 0),))


class Transducer:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], (spec["normalizer"] or {}).get("normalizers", [])
        cutters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
            and [s["type"] for s in steps] == NORMALIZERS and [c["type"] for c in cutters] == ["Split", "ByteLevel"] and cutters[0]["pattern"] == {"Regex": PIECES} and not cutters[1]["add_prefix_space"]
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        )
        if not known:
            raise ValueError(f"{path} is no vocabulary of byte pairs with word ends that can be compiled")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges)
        own = Tokenizer.from_file(path)
        self.normalizer, self.cutter = own.normalizer, own.pre_tokenizer
        added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.words: dict[bytes, bytes] = {}
        self.classes = np.full(0x110000, _NO_CLASS, np.uint8)
        ascii_class = np.full(256, OTHER, np.uint16)
        ascii_class[[*range(65, 91), *range(97, 123)]] = LETTER
        ascii_class[48:58] = NUMBER
        ascii_class[K.SPACE] = BLANK
        self.symbol = ascii_class << 8 | np.arange(256, dtype=np.uint16)
        self.symbol[255] = _ADDED
        self._forget()

    def _forget(self) -> None:
        self.merges._beside.clear()
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.bits = 21
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int64)
        self.n_keys = 0
        self.start = self._state((_NONE, _PIECE_START, -1))

    def _state(self, state: tuple) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
        return found

    # compiling

    def _closed(self, state: tuple) -> int:
        """Tokens that a state's pieces add if nothing follows."""
        mode, prefix, pending = state
        if mode == _NONE:
            return 0
        added = self.merges.step(prefix, pending, True)[0]
        return added + (self.merges.step(_PIECE_START, _LONG[mode][0], True)[0] if mode in _LONG else 0)

    def _follow(self, state: tuple, symbol: int) -> tuple[int, tuple]:
        """Tokens that a transition adds, and the state that it leads to."""
        mode, prefix, pending = state
        byte, kind = symbol & 255, symbol >> 8
        if symbol == _ADDED:
            return self._closed(state) + 1, self.states[self.start]
        if 0x80 <= byte < 0xC0:
            if mode == _NONE:
                return 0, state
            added, prefix = self.merges.step(prefix, pending, False)
            return added, (mode, prefix, byte)
        if kind == BLANK:
            return self._closed(state), self.states[self.start]
        if mode in _LONG:
            if byte == _LONG[mode][1]:
                added, prefix = self.merges.step(prefix, pending, False)
                more, prefix = self.merges.step(prefix, _LONG[mode][0], False)
                return added + more, (_DONE, prefix, byte)
            added = self.merges.step(prefix, pending, True)[0]
            more, state = self._follow((_LETTERS, _PIECE_START, _LONG[mode][0]), symbol)
            return added + more, state
        if mode == _QUOTE and byte in _OPENS:
            return 0, (_OPENS[byte], prefix, pending)
        goes_on = {_LETTERS: _LETTERS if kind == LETTER else None, _OTHERS: _OTHERS if kind == OTHER else None, _QUOTE: _DONE if byte in _SHORT else _OTHERS if kind == OTHER else None}.get(mode)
        if goes_on is not None:
            added, prefix = self.merges.step(prefix, pending, False)
            return added, (goes_on, prefix, byte)
        opened = _QUOTE if byte == 39 else (_LETTERS, _DONE, _OTHERS)[kind]
        return self._closed(state), (opened, _PIECE_START, byte)

    def _compile(self, keys: np.ndarray) -> np.ndarray:
        """The values of transitions that are not known, each once: next state << 16 | tokens + 2**15."""
        out = np.empty(len(keys), np.int64)
        if 2 * (self.n_keys + len(keys)) > len(self.keys):
            self._grow(self.n_keys + len(keys))
        mask, shift = len(self.keys) - 1, 64 - self.bits
        slots = (keys * _SPREAD) >> np.uint64(shift)
        for i, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            added, state = self._follow(self.states[key >> _SYMBOL_BITS], key & ((1 << _SYMBOL_BITS) - 1))
            out[i] = self._state(state) << 16 | added + (1 << 15)
            while self.keys[slot] != _EMPTY:
                slot = slot + 1 & mask
            self.keys[slot], self.values[slot] = key, out[i]
        self.n_keys += len(keys)
        return out

    def _grow(self, n: int) -> None:
        used = self.keys != _EMPTY
        keys, values = self.keys[used], self.values[used]
        self.bits = max(self.bits + 1, int(2 * n).bit_length())
        self.keys, self.values = np.full(1 << self.bits, _EMPTY, np.uint64), np.zeros(1 << self.bits, np.int64)
        slots, mask = (keys * _SPREAD) >> np.uint64(64 - self.bits), np.uint64(len(self.keys) - 1)
        while len(keys):
            free = self.keys[slots] == _EMPTY
            self.keys[slots[free]] = keys[free]  # of several for a slot the last one stays
            done = self.keys[slots] == keys
            self.values[slots[done]] = values[done]
            keys, values, slots = keys[~done], values[~done], (slots[~done] + np.uint64(1)) & mask

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        slots = (keys * _SPREAD) >> np.uint64(64 - self.bits)
        found, out = self.keys[slots], self.values[slots]
        at, missing, mask = np.flatnonzero(found != keys), [], np.uint64(len(self.keys) - 1)
        while len(at):
            none = self.keys[slots[at]] == _EMPTY
            missing.append(at[none])
            at = at[~none]
            slots[at] = (slots[at] + np.uint64(1)) & mask
            hit = self.keys[slots[at]] == keys[at]
            out[at[hit]] = self.values[slots[at[hit]]]
            at = at[~hit]
        if missing and len(at := np.concatenate(missing)):
            new, back = np.unique(keys[at], return_inverse=True)
            out[at] = self._compile(new)[back]
        return out

    # running

    def _advance(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states in which chunks are left and the tokens counted, when they are entered in given states. All advance together."""
        order = np.argsort(-sizes, kind="stable")
        at, states, tokens = begins[order], entries[order].astype(np.uint64), np.zeros(len(order), np.int64)
        running = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
        for j, n in enumerate(running.tolist()):
            got = self._look_up(states[:n] << np.uint64(_SYMBOL_BITS) | symbols[at[:n] + j])
            states[:n] = got >> 16
            tokens[:n] += (got & 0xFFFF) - (1 << 15)
        left, counted = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        left[order], counted[order] = states.astype(np.int64), tokens
        return left, counted

    def _composed(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """The tokens of each chunk that is surely entered in the start state and of the chunks from it to the next such one."""
        chunk, entry = np.arange(len(begins)), np.full(len(begins), self.start, np.int64)
        chunks, entries, exits, counts = [], [], [], []
        met = np.zeros(0, np.int64)
        while len(chunk):
            left, counted = self._advance(symbols, begins[chunk], sizes[chunk], entry)
            for held, new in ((chunks, chunk), (entries, entry), (exits, left), (counts, counted)):
                held.append(new)
            met = np.union1d(met, chunk << 32 | entry)
            on = (chunk + 1 < len(begins)) & ~sure[np.minimum(chunk + 1, len(begins) - 1)]
            asked = np.setdiff1d((chunk[on] + 1) << 32 | left[on], met)
            chunk, entry = asked >> 32, asked & 0xFFFFFFFF
        chunk, entry, left, total = (np.concatenate(x) for x in (chunks, entries, exits, counts))
        order = np.argsort(chunk << 32 | entry)
        ids = (chunk << 32 | entry)[order]
        left, total = left[order], total[order]
        chunk = chunk[order]
        on = (chunk + 1 < len(begins)) & ~sure[np.minimum(chunk + 1, len(begins) - 1)]
        follows = np.where(on, np.searchsorted(ids, (chunk + 1) << 32 | left), len(ids))
        total, follows = np.append(total, 0), np.append(follows, len(ids))
        while (follows < len(ids)).any():  # each round doubles the chunks that a map covers
            total, follows = total + total[follows], follows[follows]
        return total[np.searchsorted(ids, np.flatnonzero(sure) << 32 | self.start)]

    def _class_of(self, points: np.ndarray) -> np.ndarray:
        for p in np.unique(points[self.classes[points] == _NO_CLASS]).tolist():
            c = chr(p)
            if not self.cutter.pre_tokenize_str(c):
                kind = BLANK
            elif len(self.cutter.pre_tokenize_str("a" + c)) == 1:
                kind = LETTER
            else:
                kind = OTHER if len(self.cutter.pre_tokenize_str("!" + c)) == 1 else NUMBER
            self.classes[p] = kind
        return self.classes[points]

    def _symbols(self, data: np.ndarray) -> np.ndarray:
        out = self.symbol[data]
        lead = np.flatnonzero((data >= 0xC0) & (data < 0xFF))
        if len(lead):
            first = data[lead].astype(np.int64)
            more = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) & 63 for i in (1, 2, 3)]
            two, three, four = (first & 31) << 6 | more[0], (first & 15) << 12 | more[0] << 6 | more[1], (first & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]
            kind = self._class_of(np.where(first < 0xE0, two, np.where(first < 0xF0, three, four)))
            out[lead] = kind.astype(np.uint16) << 8 | data[lead]
        return out

    def _normal_word(self, found: re.Match) -> bytes:
        word = found[0]
        out = self.words.get(word)
        if out is None:
            if len(self.words) >= _WORDS_KEPT:
                self.words.clear()
            out = self.normalizer.normalize_str(word.decode()).encode()
            if len(word) < 256:
                self.words[word] = out
        return out

    def _normal(self, text: bytes) -> bytes:
        """A text as the vocabulary's normalizer has it. It works on each word alone: nothing composes with white space."""
        return (text if text.isascii() else _WIDE_WORD.sub(self._normal_word, text)).lower()  # lower() is for ASCII here

    def _prepared(self, text: bytes) -> bytes:
        if self.added and b"<" in text and self.added.search(text):
            return b"\xff".join(map(self._normal, self.added.split(text)))
        return self._normal(text)

    def count(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """The tokens of each text."""
        if self.n_keys > KEPT:
            self._forget()
        if not len(column):
            return np.zeros(0, np.int64)
        data, offsets = K.utf8(column)
        raw = data.tobytes()
        rows = [self._prepared(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows)))
        data = np.frombuffer(b"".join(r + b" " for r in rows), np.uint8)
        symbols = self._symbols(data)
        begins = ends - np.diff(ends, prepend=0)
        inside = np.maximum((ends - begins - 1) // CHUNK, 0)  # edges inside a text, one for each CHUNK bytes, moved back behind white space where there is some
        of = np.repeat(np.arange(len(rows)), inside)
        edge = begins[of] + CHUNK * (np.arange(len(of)) - np.repeat(np.cumsum(inside) - inside, inside) + 1)
        blanks = np.flatnonzero(K.SPACE[data]) + 1
        before = blanks[np.maximum(np.searchsorted(blanks, edge, side="right") - 1, 0)] if len(blanks) else edge
        moved = (before <= edge) & (before > edge - CHUNK)
        edge = np.where(moved, before, edge)
        at = np.concatenate([begins, edge])
        order = np.argsort(at, kind="stable")
        sure = np.concatenate([np.ones(len(rows), bool), moved])[order]
        row, at = np.concatenate([np.arange(len(rows)), of])[order], at[order]
        sizes = np.diff(np.append(at, len(data)))
        tokens = self._composed(symbols, at, sizes, sure)
        return np.bincount(row[sure], tokens, minlength=len(rows)).astype(np.int64)


_WIDE_WORD = re.compile(rb"[^\x20\x09-\x0d\x80-\xff]*[\x80-\xff][^\x20\x09-\x0d]*")


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for table in K.gathered(batches, FLUSH_BYTES):
            sizes = np.diff(K.utf8(table["text"])[1])
            tokens = own.count(table["text"])
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text). Rows stay in their partitions."""
    small_batches(docs.sparkSession)
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return rows.mapInArrow(_count(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
