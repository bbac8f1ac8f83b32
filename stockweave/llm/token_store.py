"""Token ids in a binary file format: an adaptive context-mixing range coder over independently reset blocks.

A block numbers its ids in order of appearance. Each id is first coded as one of four outcomes: it is the order-2
prediction (what followed the last two ids before), the order-1 prediction, another id that the block has had, or a new
one. Three adaptive models give the outcomes' probabilities, by the confidence of the order-2 slot, by that of the
order-1 slot, and by how many ids the block has; they are mixed with weights that follow how well each has done. Counts
and weights change with every id. An id that the block has had is then coded by order 0: its frequency in the block so
far. A new one is coded by the number of the file's blocks that have it, a table in the file's header. Every block starts
from the same state and has a CRC-32 of its ids, so blocks are read alone. Blocks of a file are coded side by side, one
lane of a numpy vector each; all arithmetic is on integers, or single additions, products and quotients of doubles, whose
results no machine may vary. The query's tables of files are coded and decoded by TokenCoder.java, one block after the other
with the same arithmetic: blocks are equal byte by byte, and write_file and read_file take either's files.

A file is a header, the table of ids, the block table (ids, bytes, CRC-32), the documents' token counts and the blocks.
Files are rows of a table in the shared folder, in ascending order of doc_id; a document's start is its place in the file
plus the ids of all files before it.

Nulls and empty texts: only the end id. Null doc_ids come first. Rows with equal doc_ids, null ones too, are separate
documents in the order of their texts' hashes, so reruns agree. Very long texts: a document may span blocks, and a file is
closed after the document with which it reaches FILE_IDS. An empty table gives no files. Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm import token_coder
from stockweave.llm.common import returning_memory, slices, staged

MAGIC = b"SWTOKCM3"
#: A block's ids, 4096 at most: sums of their counts are kept in three levels of 16, and 16 bits hold a count or four times
#: an id's number.
BLOCK_IDS = 2048
#: A file is closed at so many ids; it then has so many / BLOCK_IDS lanes.
FILE_IDS = 3_000_000
END_ID = 1
VOCABULARY = 1 << 16
SLOT_BITS = 11
CACHED_WORDS = 300_000
#: What an outcome adds to its count; counts of a context are halved above MOST. Share of the weights that is dealt evenly.
GAIN, MOST, EVEN = 24, 1 << 11, 0.02

_TOP, _BOTTOM, _SHIFT, _WORD = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16), np.uint64(48)
_SCALE = 1 << 16


class _Lanes:
    """Model of all blocks of a file: predictions, mixed outcome probabilities and order-0 counts of the next id of each
    lane. Ids are their numbers in order of appearance in the block."""

    def __init__(self, lanes: int):
        self.lanes, self.base = lanes, np.arange(lanes, dtype=np.int64) << SLOT_BITS
        size = lanes << SLOT_BITS
        # slots: the predicted id times 4, plus 0 to 3 for how often in a row it has been right
        self.slot1, self.slot2 = np.full(size, -4, np.int16), np.full(size, -4, np.int16)
        self.hash1, self.hash2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        # outcomes by order-2 context, by order-1 context, and by the number of ids so far, 16 of each
        self.counts = np.ones((3 * lanes * 16, 4), np.int32)
        self.row = np.arange(lanes, dtype=np.int64) << 4
        self.weight = np.full((3, lanes), 1 / 3)
        # counts of ids, of 16 ids, and of 256
        self.single, self.some, self.many = (np.zeros((n, 16), np.int16) for n in (lanes * 256, lanes * 16, lanes))

    def predict(self, n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the first n lanes: order-2 and order-1 predictions, the frequencies of the outcomes (4, n) and their sums
        from the first on. known: how many ids each block has had."""
        mask = (1 << SLOT_BITS) - 1
        self.at1 = self.base[:n] + (self.hash1[:n] >> 7 & mask)
        self.at2 = self.base[:n] + (self.hash1[:n] + self.hash2[:n] >> 9 & mask)
        self.got1, self.got2 = self.slot1.take(self.at1), self.slot2.take(self.at2)
        p1, p2 = self.got1 >> 2, self.got2 >> 2
        sure1, sure2 = self.got1 & 3, self.got2 & 3
        agree = (p1 == p2).view(np.int8).astype(np.int64) << 2
        row, step = self.row[:n], self.lanes << 4
        have2 = (p2 >= 0).view(np.int8).astype(np.int64) << 3
        self.at = np.empty((3, n), np.int64)
        self.at[0] = row + (sure2 | agree | have2)
        self.at[1] = row + (sure1 | agree | (p1 >= 0).view(np.int8).astype(np.int64) << 3) + step
        self.at[2] = row + _BITS.take(known[:n]) + 2 * step
        held = np.ascontiguousarray(self.counts.take(self.at.ravel(), axis=0).T).reshape(4, 3, n)  # the last axis is the long one
        self.whole = held[0] + held[1] + held[2] + held[3]
        self.parts = held / self.whole
        mixed = self.parts * self.weight[:, :n]
        freq = np.empty((4, n), np.int64)
        np.multiply(mixed[:, 0] + mixed[:, 1] + mixed[:, 2], _SCALE - 128, out=freq, casting="unsafe")
        freq += 32
        start = np.zeros((4, n), np.int64)
        start[1] = freq[0]
        np.add(start[1], freq[1], out=start[2])
        np.add(start[2], freq[2], out=start[3])
        np.subtract(_SCALE, start[3], out=freq[3])
        return p2, p1, freq, start

    def learn(self, n: int, ids: np.ndarray, outcome: np.ndarray) -> None:
        # how well each model has done, and its counts
        right = self.parts.ravel().take(outcome * (3 * n) + np.arange(3 * n).reshape(3, n))
        w = self.weight[:, :n] * right
        w /= w[0] + w[1] + w[2]
        self.weight[:, :n] = w * (1 - EVEN) + EVEN / 3
        flat = self.counts.reshape(-1)
        flat[(self.at << 2) + outcome] += GAIN
        full = self.at[self.whole > MOST]
        if len(full):
            self.counts[full] = (self.counts[full] + 1) >> 1
        # order 0
        lane = self.row[:n] >> 4
        self.single.reshape(-1)[(lane << 12) + ids] += 1
        self.some.reshape(-1)[(lane << 8) + (ids >> 4)] += 1
        self.many.reshape(-1)[(lane << 4) + (ids >> 8)] += 1
        four = ids.astype(np.int16) << 2
        for slot, got, where in ((self.slot1, self.got1, self.at1), (self.slot2, self.got2, self.at2)):
            run = got ^ four  # below 4 if the slot was right
            hit = run.view(np.uint16) < 4
            # a slot that has been right gives way only when it has lost its confidence
            slot[where] = np.where(hit, four | np.minimum((got & 3) + 1, 3), np.where((got & 3) > 1, got - 2, four))
        np.multiply(self.hash1[:n], 31, out=self.hash2[:n])
        np.multiply(ids + 1, 2654435761, out=self.hash1[:n])

    def place(self, lane: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, frequency) of ids by their counts in their lanes."""
        start = np.zeros(len(lane), np.int64)
        for table, row, digit in ((self.many, lane, ids >> 8), (self.some, (lane << 4) + (ids >> 8), ids >> 4 & 15), (self.single, (lane << 8) + (ids >> 4), ids & 15)):
            start += np.einsum("ij,ij->i", table.take(row, axis=0), _BELOW.take(digit, axis=0))
        return start, self.single.reshape(-1)[(lane << 12) + ids].astype(np.int64)

    def find(self, lane: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The ids whose ranges hold target."""
        ids, left = np.zeros(len(lane), np.int64), target.astype(np.int16)
        for table, shift in ((self.many, 0), (self.some, 4), (self.single, 8)):
            rows = np.ascontiguousarray(table.take((lane << shift) + ids, axis=0).T)
            np.cumsum(rows, axis=0, dtype=np.int16, out=rows)
            digit = (rows <= left).sum(0, dtype=np.int64)
            left = left - np.where(digit > 0, rows.ravel().take(np.maximum(digit - 1, 0) * len(lane) + np.arange(len(lane))), 0)
            ids = ids << 4 | digit
        return ids


#: For a digit of 16, ones at those below it.
_BELOW = np.tri(16, k=-1, dtype=np.int16)
#: Bits of a number of ids, as a context.
_BITS = np.array([int(k).bit_length() for k in range(BLOCK_IDS + 1)], np.int64)


def _narrow(low: np.ndarray, rng: np.ndarray, move) -> None:
    """Shift settled words out of ranges that are too small; move(lanes, low) takes or gives the words."""
    todo = np.flatnonzero(rng < _TOP)  # with more left, no more than the carry into the top word can settle
    while len(todo):
        x, y = low[todo], rng[todo]
        flat = (x ^ (x + y)) < _TOP
        cut = (y < _BOTTOM) & ~flat
        if cut.any():
            y = np.where(cut, (~x + np.uint64(1)) & (_BOTTOM - np.uint64(1)), y)
        go = flat | cut
        todo, x, y = todo[go], x[go], y[go]
        move(todo, x)
        low[todo], rng[todo] = x << _SHIFT, (y := y << _SHIFT)
        todo = todo[y < _TOP]


class _Encoder:
    def __init__(self, lanes: int, ids: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.out, self.n = np.zeros((lanes, 2 * ids + 16), ">u2"), np.zeros(lanes, np.int64)

    def code(self, n: int, start: np.ndarray, freq: np.ndarray, own: np.ndarray, low_: np.ndarray, many: np.ndarray, total: np.ndarray) -> None:
        """The outcomes of the first n lanes, and for the lanes own also a range of so many from low_ on, of total."""
        low, rng = self.low[:n], self.range[:n]
        rng >>= _SHIFT
        low += start.astype(np.uint64) * rng
        rng *= freq.astype(np.uint64)
        unit = rng[own] // total.astype(np.uint64)
        low[own] += low_.astype(np.uint64) * unit
        rng[own] = unit * many.astype(np.uint64)
        _narrow(low, rng, self._put)

    def _put(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.n[lanes]
        self.out[lanes, at] = low >> _WORD
        self.n[lanes] = at + 1

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self.out[np.arange(len(self.n)), self.n] = (self.low >> _WORD).astype(np.uint16)
            self.low <<= _SHIFT
            self.n += 1
        return [self.out[i, :n].tobytes() for i, n in enumerate(self.n)]


class _Decoder:
    def __init__(self, blocks: list[bytes]):
        lanes, most = len(blocks), max(map(len, blocks)) // 2
        self.words = np.zeros((lanes, most + 8), np.uint16)
        for i, b in enumerate(blocks):
            self.words[i, : len(b) // 2] = np.frombuffer(b, ">u2")
        self.low, self.range, self.code = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64), np.zeros(lanes, np.uint64)
        self.n = np.full(lanes, 4)
        for k in range(4):
            self.code = self.code << _SHIFT | self.words[:, k]

    def target(self, n: int) -> np.ndarray:
        self.range[:n] >>= _SHIFT
        return np.minimum((self.code[:n] - self.low[:n]) // self.range[:n], np.uint64(_SCALE - 1)).astype(np.int64)

    def take(self, n: int, start: np.ndarray, freq: np.ndarray, own: np.ndarray, total: np.ndarray, find) -> None:
        """Take the outcomes of the first n lanes; find gives the (start, many) of the ranges of total that values lie in."""
        low, rng = self.low[:n], self.range[:n]
        low += start.astype(np.uint64) * rng
        rng *= freq.astype(np.uint64)
        total = total.astype(np.uint64)
        unit, base = rng[own] // total, low[own]
        value = np.minimum((self.code[own] - base) // unit, total - np.uint64(1))
        begin, many = find(value.astype(np.int64))
        low[own] = base + begin.astype(np.uint64) * unit
        rng[own] = unit * many.astype(np.uint64)
        _narrow(low, rng, self._get)

    def _get(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.n[lanes]
        self.code[lanes] = self.code[lanes] << _SHIFT | self.words[lanes, at]
        self.n[lanes] = at + 1


def _live(sizes: np.ndarray, t: int) -> int:
    """Lanes that have an id at place t; all blocks but the last are full."""
    return len(sizes) if t < sizes[-1] else len(sizes) - 1


def _appearance(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: whether each id is new, and its number in order of first appearance. first is scratch, by id."""
    place = np.arange(len(ids))
    first[ids[::-1]] = place[::-1]
    at = first[ids]
    new = at == place
    return new, (np.cumsum(new) - 1)[at]


def new_ids(ids: np.ndarray, size: int = BLOCK_IDS) -> np.ndarray:
    """For every id the number of blocks that have it."""
    out = np.zeros(VOCABULARY, np.int64)
    for i in range(0, len(ids), size):
        out[np.unique(ids[i : i + size])] += 1
    return out


def encode_blocks(ids: np.ndarray, size: int = BLOCK_IDS, table: np.ndarray | None = None) -> list[bytes]:
    """The coded blocks of an array of ids below VOCABULARY; table: what new_ids gives."""
    blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
    if not blocks:
        return []
    table = new_ids(ids, size) if table is None else table
    before = np.concatenate([[0], np.cumsum(table)])
    sizes = np.array([len(b) for b in blocks])
    grid, new, rank = np.zeros((size, len(blocks)), np.int32), np.zeros((size, len(blocks)), bool), np.zeros((size, len(blocks)), np.int16)
    first = np.empty(VOCABULARY, np.int64)
    for i, b in enumerate(blocks):
        grid[: len(b), i] = b
        new[: len(b), i], rank[: len(b), i] = _appearance(b, first)
    model, coder, known = _Lanes(len(blocks)), _Encoder(len(blocks), size), np.zeros(len(blocks), np.int64)
    for t in range(sizes.max()):
        n = _live(sizes, t)
        fresh, r = new[t, :n], rank[t, :n].astype(np.int64)
        p2, p1, freq, start = model.predict(n, known)
        outcome = np.where(fresh, 3, np.where(r == p2, 0, np.where(r == p1, 1, 2)))
        own = np.flatnonzero(outcome > 1)
        seen, newly = own[outcome[own] == 2], own[outcome[own] == 3]
        own = np.concatenate([seen, newly])
        x = grid[t].take(newly)
        low0, many0 = model.place(seen, r[seen])
        lane = np.arange(n)
        coder.code(
            n, start.ravel().take(outcome * n + lane), freq.ravel().take(outcome * n + lane), own, np.concatenate([low0, before[x]]), np.concatenate([many0, table[x]]),
            np.concatenate([np.full(len(seen), t), np.full(len(newly), before[-1])]),
        )
        known[:n] += fresh
        model.learn(n, r, outcome)
    return coder.finish()


def decode_blocks(blocks: list[bytes], sizes: list[int], table: np.ndarray) -> np.ndarray:
    if not blocks:
        return np.empty(0, np.int64)
    before = np.concatenate([[0], np.cumsum(table)])
    sizes = np.array(sizes)
    most = sizes.max()
    model, coder = _Lanes(len(blocks)), _Decoder(blocks)
    grid, seen_ids, known = np.zeros((most, len(blocks)), np.int16), np.zeros((len(blocks), most), np.int32), np.zeros(len(blocks), np.int64)
    for t in range(most):
        n = _live(sizes, t)
        p2, p1, freq, start = model.predict(n, known)
        target = coder.target(n)
        outcome = (target >= start[1]).astype(np.int64) + (target >= start[2]) + (target >= start[3])
        own = np.flatnonzero(outcome > 1)
        seen, newly = own[outcome[own] == 2], own[outcome[own] == 3]
        own = np.concatenate([seen, newly])
        r = np.where(outcome == 0, p2, p1).astype(np.int64)

        def find(value: np.ndarray, seen=seen, newly=newly, r=r) -> tuple[np.ndarray, np.ndarray]:
            r[seen] = model.find(seen, value[: len(seen)])
            x = np.searchsorted(before, value[len(seen) :], "right") - 1
            r[newly] = known[newly]
            seen_ids[newly, known[newly]] = x
            low0, many0 = model.place(seen, r[seen])
            return np.concatenate([low0, before[x]]), np.concatenate([many0, table[x]])

        lane = np.arange(n)
        coder.take(n, start.ravel().take(outcome * n + lane), freq.ravel().take(outcome * n + lane), own, np.concatenate([np.full(len(seen), t), np.full(len(newly), before[-1])]), find)
        known[newly] += 1
        model.learn(n, r, outcome)
        grid[t, :n] = r
    return np.concatenate([seen_ids[i, grid[:s, i]] for i, s in enumerate(sizes)]).astype(np.int64)


def write_file(ids: np.ndarray, counts: np.ndarray, size: int = BLOCK_IDS) -> bytes:
    """A file of documents with these token counts, whose ids follow each other."""
    table = new_ids(ids, size)
    blocks = encode_blocks(ids, size, table)
    rows = [(min(size, len(ids) - i * size), len(b), zlib.crc32(ids[i * size : (i + 1) * size].astype("<u4").tobytes())) for i, b in enumerate(blocks)]
    docs, held = zlib.compress(counts.astype("<u4").tobytes()), zlib.compress(table.astype("<u2").tobytes() if len(blocks) < 1 << 16 else table.astype("<u4").tobytes(), 9)
    return b"".join([MAGIC, struct.pack("<IIIQII", len(counts), len(docs), len(held), len(ids), len(blocks), size), docs, held, np.array(rows, "<u4").tobytes(), *blocks])


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, token counts of the documents); a damaged block raises ValueError."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)
    n_docs, n_bytes, n_held, n_ids, n_blocks, _ = struct.unpack_from("<IIIQII", data, at)
    at += struct.calcsize("<IIIQII")
    counts = np.frombuffer(zlib.decompress(data[at : at + n_bytes]), "<u4").astype(np.int64)
    at += n_bytes
    table = np.frombuffer(zlib.decompress(data[at : at + n_held]), "<u2" if n_blocks < 1 << 16 else "<u4").astype(np.int64)
    at += n_held
    rows = np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(-1, 3)
    ends = at + 12 * n_blocks + np.cumsum(rows[:, 1], dtype=np.int64)
    ids = decode_blocks([data[e - s : e] for e, s in zip(ends.tolist(), rows[:, 1].tolist(), strict=True)], rows[:, 0].tolist(), table)
    lo = 0
    for size, _, crc in rows.tolist():
        if zlib.crc32(ids[lo : lo + size].astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block")
        lo += size
    if len(ids) != n_ids or counts.sum() != n_ids or len(counts) != n_docs:
        raise ValueError("counts of a token file")
    return ids, counts


def _picked(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of the runs at these places; ends: 0 and the end of each run."""
    first = ends[at]
    size = ends[at + 1] - first
    total = np.cumsum(size)
    return ids[np.repeat(first - total + size, size) + np.arange(total[-1] if len(at) else 0)], size


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _lines(strings: pa.Array) -> str:
    """Strings, a line each; far faster than a Python string each."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(strings)], strings), pa.scalar("\n", pa.large_string()))[0].as_py()


class _Store:
    """Strings that have been met, with their ids; held as Arrow and numpy arrays."""

    def __init__(self, code: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        """code: (ids of distinct strings one after the other, how many each has)."""
        self.code = code
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of any strings."""
        coded = strings.dictionary_encode()
        place = np.array(pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = coded.dictionary.take(fresh)
            ids, sizes = self.code(new)
            place[fresh] = len(self.known) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, new])
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return _picked(self.ids, self.ends, place[np.asarray(coded.indices)])


class WordEncoder:
    """Ids of whole texts from the ids of their words.

    White space separates pre-tokens of this tokenizer and no step looks across it, so each distinct word is encoded
    once, by the library's model for each of its pre-tokens, and texts are put together from a bounded store of words.
    What could differ there goes through the whole library: words that normalisation may change by more than case or
    that may hold special tokens, and texts with the separators U+001C to U+001F, which not all take for white space.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        steps = json.loads(self.library.to_str())["pre_tokenizer"]["pretokenizers"]
        self.pieces_and_ends = regex.compile(f"{steps[0]['pattern']['Regex']}|\n").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that the byte level shows as themselves
        rest = [b for b in range(256) if b not in set(plain)]
        self.shown = np.zeros(256, "<u4")
        self.shown[plain], self.shown[rest] = plain, 256 + np.arange(len(rest))
        self.shown[10] = 10  # between pieces; none has one
        self.clear()

    def clear(self) -> None:
        self.words, self.pieces = _Store(self._words), _Store(self._pieces)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        letters = np.asarray(pc.match_substring_regex(words, "^[A-Za-z]+$"))  # one pre-token
        ids, sizes = self.pieces.encode(pc.ascii_lower(words.filter(letters)))
        more, others = self._split(words.filter(~letters)) if not letters.all() else (ids[:0], sizes[:0])
        at = np.empty(len(words), np.int64)
        at[np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])] = np.arange(len(words))
        return _picked(np.concatenate([ids, more]), _ends(np.concatenate([sizes, others])), at)

    def _split(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = lambda t: "<|" in t or not t.isascii() and ("\u03a3" in t or not unicodedata.is_normalized("NFC", t))
        text, odd = _lines(words), {}
        if special(text):
            each = text.split("\n")
            odd = {i: self.library.encode(w, add_special_tokens=False).ids for i, w in enumerate(each) if special(w)}
            text = "\n".join("" if i in odd else w for i, w in enumerate(each))
        pieces = pa.array(self.pieces_and_ends(text.lower()), pa.large_string())
        end = np.asarray(pc.equal(pieces, "\n"))
        ids, sizes = self.pieces.encode(pieces.filter(~end))
        sizes = np.bincount(np.cumsum(end)[~end], sizes, len(words)).astype(np.int64)
        if odd:
            at, more = np.array(list(odd)), np.array([len(x) for x in odd.values()])
            ids = np.insert(ids, np.repeat((np.cumsum(sizes) - sizes)[at], more), np.array([x for got in odd.values() for x in got], np.int32))
            sizes[at] = more
        return ids, sizes

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        shown = self.shown[np.frombuffer(_lines(pieces).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\n")
        coded = list(map(self.model.tokenize, shown))
        return np.fromiter(map(attrgetter("id"), chain.from_iterable(coded)), np.int32), np.fromiter(map(len, coded), np.int64, len(coded))

    def encode(self, texts: list[str], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; token counts)."""
        return self.encode_column(pa.array(texts, pa.large_string()), end_id)

    def encode_column(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The same of a column of strings; nulls are empty texts."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = np.asarray(pc.match_substring_regex(texts, "[\x1c-\x1f]"))
        if len(self.words.known) > CACHED_WORDS or len(self.pieces.known) > CACHED_WORDS:
            self.clear()
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", texts) if odd.any() else texts)
        ids, sizes = self.words.encode(words.flatten())
        ends = _ends(sizes)[np.asarray(words.offsets)[1:]]
        counts = np.diff(ends, prepend=0) + 1
        ids = np.insert(ids, ends, end_id)
        if odd.any():
            ends = np.cumsum(counts)
            parts = [ids[e - c : e] for e, c in zip(ends, counts, strict=True)]
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.array([*self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, end_id])
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """A worker process keeps its encoder, with the words it has met, for its next tasks."""
    return WordEncoder(path)


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(path)
        docs: list = []
        ids, counts, held = [], [], 0

        def close() -> pa.RecordBatch:
            all_ids, all_counts = np.concatenate(ids), np.concatenate(counts)
            row = [docs[0], docs, len(all_ids), all_ids.astype("<u4").tobytes(), all_counts.astype("<u4").tobytes()]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["first_doc", "docs", "n_ids", "ids", "counts"])

        for b in slices(batches, 4096, 1 << 23):
            got, n = encoder.encode_column(b.column(1))
            ids.append(got.astype(np.int32))
            counts.append(n)
            docs += b.column(0).to_pylist()
            held += len(got)
            if held >= FILE_IDS:
                yield close()
                docs, ids, counts, held = [], [], [], 0
        if docs:
            yield close()

    return returning_memory(write)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, docs, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            counts, crc = np.frombuffer(data.as_buffer(), "<u4").astype(np.int64).reshape(2, -1)
            cols = [pa.array([file] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "doc_id", "place", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str) -> DataFrame:
    """The files of docs, as a table in the shared folder: file (in ascending order), docs, n_ids, data."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    files = rows.mapInArrow(_writer(path), "first_doc long, docs array<long>, n_ids long, ids binary, counts binary")
    return staged(files.select((F.spark_partition_id().cast("long") * 2**32 + F.monotonically_increasing_id() % 2**32).alias("file"), "first_doc", "docs", "n_ids", token_coder.written(docs.sparkSession, "ids", "counts").alias("data")), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    # a file's number has that of its task in front; sums go over the tasks first, then over the files of each
    thin = files.select("file", F.shiftright("file", 32).alias("task"), "n_ids")
    ahead = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = thin.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = thin.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(tasks, "task").select("file", (F.col("ahead") + F.col("inside")).alias("first"))
    docs = files.select("file", "docs", token_coder.sums(files.sparkSession, "data")).mapInArrow(returning_memory(_read), "file long, doc_id long, place long, n_tokens long, ids_crc32 long")
    docs = staged(docs, "token-docs")  # decoded once, whatever the join's strategy becomes
    return docs.join(starts, "file").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
