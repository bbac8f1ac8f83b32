"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

Texts are cut before each run of the space mark, where no piece of the model lies across (tested when it is loaded).
The distinct segments of a batch are concatenated and indexed by a suffix array, sorted as far as the longest piece
reaches. A binary search finds the range of suffixes that start with each piece; these occurrences are the edges of a
lattice. Edges are sorted by the place where they end and relaxed in that order, one place of all segments at a time:
an edge is taken if its piece can follow the piece that ends where it starts.

For byte-pair merges there is exactly one such edge for each place: the encoding of a prefix is unique, and a sequence
is what merging gives if and only if each pair of neighbours is. Whether two pieces can be neighbours is decided from
their last merges, taken back one by one in the order of their ranks, and kept in a table of fixed size. Pieces whose own
merges don't come in the order of their ranks (if a model has any) are tested by merging itself.

Characters without a piece become byte pieces. Nulls and empty texts have no ids. Repeated rows and ties give equal
results. Very long texts: a text is cut into segments whatever its length, and a segment of any length is indexed whole;
memory follows the longest text of a batch. An empty table gives an empty one. Extra columns are ignored, or passed on by
encode_column, which replaces one named ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.llm.common import returning_memory, slices

MARK = "▁"
#: Segments that a worker keeps from batch to batch, characters that are indexed at once, and pairs of pieces in the table.
CACHED_SEGMENTS, INDEX_CHARS, PAIRS = 200_000, 250_000, 1 << 19
#: From the place on after which no place has more edges than this, edges are relaxed one by one.
FEW = 12


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has the space mark inside")
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(self.pieces)]
        # rank: pieces by falling score; the highest score merges first
        order = sorted(self.ids.values(), key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(n + 2, n, np.int64)
        self.rank[order] = np.arange(len(order))
        self._merges(n)
        self.longest = max(map(len, self.ids))
        self.unknown, self.opening = n, n + 1  # a character without a piece, and the start of a segment
        self._spelling()
        self.known_pairs = np.full(PAIRS, -1, np.int64)
        self.clear()

    def _spelling(self) -> None:
        """The pieces as rows of numbers of the model's characters, 0 after their ends."""
        found = [(p, i) for p, i in self.ids.items() if self.usable[i]]
        letters = sorted({c for p, _ in found for c in p})
        self.letter = np.zeros(0x110000, np.uint16 if len(letters) < 65535 else np.uint32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_letters = len(letters) + 1
        self.spelled = np.zeros((len(found), self.longest), self.letter.dtype)
        for x, (p, _) in enumerate(found):
            self.spelled[x, : len(p)] = self.letter[[ord(c) for c in p]]
        self.size = np.array([len(p) for p, _ in found], np.int32)
        self.found_id = np.array([i for _, i in found], np.int32)

    def merged(self, text: str) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Ids of text by merging, and the merges (left, right, result) in order."""
        parts = [self.ids.get(c, -1) for c in text]
        words = list(text)
        done = []
        while True:
            best = None
            for k in range(len(words) - 1):
                got = self.ids.get(words[k] + words[k + 1], -1)
                if got >= 0 and parts[k] >= 0 and parts[k + 1] >= 0 and (best is None or self.rank[got] < best[0]):
                    best = self.rank[got], k, got
            if best is None:
                return parts, done
            _, k, got = best
            done.append((parts[k], parts[k + 1], got))
            words[k : k + 2], parts[k : k + 2] = [words[k] + words[k + 1]], [got]

    def _merges(self, n: int) -> None:
        self.left, self.right = np.arange(n + 2), np.arange(n + 2)
        self.usable, self.odd = np.zeros(n + 2, bool), np.zeros(n + 2, bool)
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * (n + 2) + b] = i
            parts, done = self.merged(p)
            self.usable[i] = parts == [i]
            if done and parts == [i]:
                self.left[i], self.right[i] = done[-1][:2]
                ranks = [self.rank[r] for _, _, r in done]
                self.odd[i] = ranks != sorted(ranks)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = self.rank[np.array([pairs[k] for k in sorted(pairs)], np.int64)]
        self.slow: dict[tuple[int, int], bool] = {}

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a boundary between pieces a and b."""
        n = len(self.rank)
        out = np.ones(len(a), bool)
        odd = (self.odd[a] | self.odd[b]) & (a < n - 2) & (b < n - 2)
        for k in np.flatnonzero(odd):
            x, y = int(a[k]), int(b[k])
            if (x, y) not in self.slow:
                self.slow[x, y] = self.merged(self.pieces[x] + self.pieces[y])[0] == [x, y]
            out[k] = self.slow[x, y]
        todo = np.flatnonzero((a < n - 2) & (b < n - 2) & ~odd)
        a, b = a[todo].copy(), b[todo].copy()
        limit = np.full(len(todo), np.iinfo(np.int64).max)
        while len(todo):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit)
            out[todo[joins]] = False
            # take back the later of the two last merges; of equal ones the right one came later
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            end = whole_a & whole_b
            back_a = ~whole_a & (whole_b | (self.rank[a] > self.rank[b]))
            limit = np.where(back_a, self.rank[a], self.rank[b] + 1)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
            go = ~joins & ~end
            todo, a, b, limit = todo[go], a[go], b[go], limit[go]
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """neighbours(a, b), from the table where it has them."""
        key = a.astype(np.int64) * len(self.rank) + b
        slot = (key * -7046029254386353131 >> 45) & (PAIRS - 1)  # a fixed odd factor
        held = self.known_pairs[slot]
        out = (held & 1).astype(bool)
        fresh = np.flatnonzero(held >> 1 != key)
        if len(fresh):
            out[fresh] = self.neighbours(a[fresh], b[fresh])
            self.known_pairs[slot[fresh]] = key[fresh] << 1 | out[fresh]
        return out

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every occurrence of every piece in text, by suffix array."""
        codes = self.letter[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        used = np.flatnonzero(np.bincount(codes, minlength=self.n_letters)[1:]) + 1
        bits = 8 if len(used) < 256 else 16 if len(used) < 65536 else 32
        dense = np.zeros(self.n_letters, np.uint64)
        dense[used] = np.arange(1, len(used) + 1)
        per = 64 // bits
        n, n_keys = len(codes), -(-self.longest // per)
        # the key of a place: its next characters, as many as 64 bits hold
        padded = np.concatenate([dense[codes], np.zeros(n_keys * per, np.uint64)])
        first = np.zeros(n + (n_keys - 1) * per, np.uint64)
        for k in range(per):
            first |= padded[k : k + len(first)] << np.uint64(64 - bits * (k + 1))
        low, high = self._ranges(dense, bits, per, n_keys)
        have = np.flatnonzero((dense[self.spelled] > 0).sum(1) == self.size)
        short = have[self.size[have] <= per]
        order = np.argsort(first[:n]).astype(np.int32)
        ranked = first[order]
        out = [self._spread(order, np.searchsorted(ranked, low[0, short]), np.searchsorted(ranked, high[0, short], "right"), short)]
        del ranked
        long = have[self.size[have] > per]
        if len(long):
            starts = np.unique(low[0, long])
            at = np.flatnonzero(starts[np.minimum(np.searchsorted(starts, first[:n]), len(starts) - 1)] == first[:n])
            keys = [first[at + k * per] for k in range(n_keys)]
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]
            out.append(self._spread(at[order].astype(np.int32), self._bisect(keys, low[:, long], False), self._bisect(keys, high[:, long], True), long))
        start, size, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        return start, size, piece

    def _ranges(self, dense: np.ndarray, bits: int, per: int, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest key of each piece's suffixes."""
        spelled = np.zeros((len(self.size), n_keys * per), np.uint64)
        spelled[:, : self.longest] = dense[self.spelled]
        low, high = np.zeros((n_keys, len(self.size)), np.uint64), np.zeros((n_keys, len(self.size)), np.uint64)
        ends = np.arange(n_keys * per)[None, :] >= self.size[:, None]
        full = np.where(ends, np.uint64((1 << bits) - 1), spelled)
        for k in range(n_keys):
            for c in range(per):
                shift = np.uint64(64 - bits * (c + 1))
                low[k] |= spelled[:, k * per + c] << shift
                high[k] |= full[:, k * per + c] << shift
        return low, high

    def _spread(self, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.maximum(hi - lo, 0)
        begins = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return order[begins], np.repeat(self.size[which], count), np.repeat(self.found_id[which], count)

    @staticmethod
    def _bisect(keys: list[np.ndarray], wanted: np.ndarray, after: bool) -> np.ndarray:
        """Place of each column of wanted among the sorted keys; after: behind equal ones."""
        lo, hi = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], len(keys[0]), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            at = np.minimum(mid, len(keys[0]) - 1)
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, w in zip(keys, wanted, strict=True):
                less |= same & (k[at] < w)
                same &= k[at] == w
            right = (less | same if after else less) & (lo < hi)
            hi = np.where(right | (lo >= hi), hi, mid)
            lo = np.where(right, mid + 1, lo)
        return lo

    def segments(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, their counts); none of them is empty."""
        text = "\0".join(parts) + "\0"
        sizes = np.fromiter(map(len, parts), np.int32, len(parts))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int32)
        start, size, piece = self.edges(text)
        bare = np.ones(len(text), bool)
        bare[start[size == 1]] = False
        bare[begin + sizes] = False
        bare = np.flatnonzero(bare).astype(np.int32)
        if len(bare):
            start, size = np.concatenate([start, bare]), np.concatenate([size, np.ones(len(bare), np.int32)])
            piece = np.concatenate([piece, np.full(len(bare), self.unknown, np.int32)])
        place = start - np.repeat(begin, sizes + 1)[start] + size
        longest = int(sizes.max())
        order = np.argsort(place.astype(np.uint16) if longest < 65536 else place, kind="stable")  # a radix sort of 16 bits
        waves = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=longest + 1)[1:])]).tolist()
        start, piece = start[order], piece[order]
        end = start + size[order]
        del size, place, order
        last, back = np.full(len(text) + 1, -1, np.int32), np.full(len(text) + 1, -1, np.int32)
        last[begin] = self.opening
        many = np.flatnonzero(np.diff(waves) > FEW)
        vectors = int(many[-1]) + 1 if len(many) else 0
        for lo, hi in zip(waves[:vectors], waves[1 : vectors + 1], strict=True):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            ok = self.follows(last[s], p)
            e = e[ok]
            last[e], back[e] = p[ok], s[ok]
        if waves[vectors] < len(start):
            self._relax_singly(start[waves[vectors] :], end[waves[vectors] :], piece[waves[vectors] :], last, back)
        taken = np.full(len(text), -1, np.int32)
        at = begin + sizes
        if (last[at] < 0).any():
            raise AssertionError("a place without an encoding")
        alive_begin = begin
        while len(at):
            to = back[at]
            taken[to] = last[at]
            more = to > alive_begin
            at, alive_begin = to[more], alive_begin[more]
        where = np.flatnonzero(taken >= 0)
        got = taken[where]
        counts = np.add.reduceat(taken >= 0, begin, dtype=np.int32)
        lost = np.flatnonzero(got == self.unknown)
        if len(lost):
            wide = [self.bytes[list(text[w].encode("utf-8"))] for w in where[lost].tolist()]
            many = np.ones(len(got), np.int64)
            many[lost] = [len(w) for w in wide]
            segment = np.repeat(np.arange(len(parts)), counts)
            counts = np.bincount(np.repeat(segment, many), minlength=len(parts))
            got = np.repeat(got, many)
            got[got == self.unknown] = np.concatenate(wide)
        return got, counts

    def _relax_singly(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """The rest of few long segments: a numpy call for each place would cost more than its edges."""
        memo: dict[tuple[int, int], bool] = {}
        ends: dict[int, tuple[int, int]] = {}
        for s, e, p in zip(start.tolist(), end.tolist(), piece.tolist(), strict=True):
            before = ends[s][0] if s in ends else int(last[s])
            ok = memo.get((before, p))
            if ok is None:
                ok = memo[before, p] = bool(self.follows(np.array([before]), np.array([p]))[0])
            if ok:
                ends[e] = p, s
        at = np.fromiter(ends, np.int64, len(ends))
        last[at], back[at] = np.array(list(ends.values()), np.int32).T

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.found, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        lo = 0
        while lo < len(fresh):
            hi, size = lo, 0
            while hi < len(fresh) and size < INDEX_CHARS:
                size += len(fresh[hi]) + 2
                hi += 1
            ids, counts = self.segments([MARK + s for s in fresh[lo:hi]])
            self.place.update(zip(fresh[lo:hi], range(len(self.place), len(self.place) + hi - lo), strict=True))
            self.found = np.concatenate([self.found, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
            lo = hi

    @staticmethod
    def cut(text: str) -> list[str]:
        """Segments of a text, each without its first space mark."""
        if not text:
            return []
        if "  " in text or MARK in text or "\0" in text or text[0] == " " or text[-1] == " ":
            marked = MARK + text.replace(" ", MARK)
            return [s[1:] for s in re.findall(f"{MARK}+[^{MARK}]*", marked)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cuts = [self.cut(t) for t in texts]
        flat = [s for c in cuts for s in c]
        if len(self.place) > CACHED_SEGMENTS:
            self.clear()
        self._learn(list(dict.fromkeys(s for s in flat if s not in self.place)))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        first, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.found[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        stop = total[np.cumsum([0, *map(len, cuts)])]
        return [ids[a:b] for a, b in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]

    def decode(self, ids) -> str:
        """Text of ids; the space that encoding had put in front goes."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


#: Rows and bytes of text that are encoded together.
ROWS, BYTES = 4096, 1 << 22


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for part in slices(batches, ROWS, BYTES):
            ids = own.encode([t or "" for t in part.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=[*part.schema.names, "ids"])

    return returning_memory(encode)


DIGEST = "doc_id long, n_chars long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def _digest_rows(own: Lattice, doc_ids: pa.Array, texts: list[str | None], ids: list[np.ndarray]) -> pa.RecordBatch:
    rows = []
    for text, x in zip(texts, ids, strict=True):
        back = own.decode(x.tolist())
        rows.append((len(text or ""), len(x), zlib.crc32(x.astype("<u4").tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == (text or "")))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])


def _digester(path: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for b in slices(batches, ROWS, BYTES):
            ids = [np.array(x or (), np.int32) for x in b.column(2).to_pylist()]
            yield _digest_rows(own, b.column(0), b.column(1).to_pylist(), ids)

    return returning_memory(digest)


def _coder(path: str):
    """Encoding, decoding and digests of (doc_id, text) at one go: one worker a task, and texts cross to it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for b in slices(batches, ROWS, BYTES):
            texts = b.column(1).to_pylist()
            yield _digest_rows(own, b.column(0), texts, own.encode([t or "" for t in texts]))

    return returning_memory(run)


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids (array<int>) of text; an input column of that name goes."""
    base = docs.drop("ids")
    return base.mapInArrow(_encoder(path), T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ids of every document."""
    return encode_column(docs.select(F.col("doc_id").cast("long"), "text"), path)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Of encoded documents: lengths, checksums of the ids (as little-endian 32-bit integers) and of the decoded text
    (UTF-8), and whether that is the text again. Only texts with the space mark itself don't come back."""
    return encoded.mapInArrow(_digester(path), DIGEST)


def encode_and_digest(docs: DataFrame, path: str) -> DataFrame:
    """digests(encode_documents(docs, path), path), without the ids in between."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_coder(path), DIGEST)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    path = default_model()
    return encode_and_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
