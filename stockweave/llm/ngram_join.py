"""Exact n-gram Jaccard self-join of documents, with signature trees, and the groups that its links form.

A document is the set of its distinct n-word shingles (as 64-bit hashes). The length n and the similarity from which two
sets are linked are parameters; op3 takes SHINGLE words and PART hundredths. Documents with equal sets are one class and
take part in the join once. The join has these steps:

1. Blocks. The hash space is cut into k intervals; two sets that differ in d shingles agree on at least k - d of them.
   k depends on a size class; a set also takes part in the next class if a partner could be there. A set emits a
   signature for each interval, so every linked pair meets in at least k - d blocks, whatever the data are. What shares a
   signature within a chunk of a task goes on as one row, so no block gathers all its sets in one place. A set whose
   intervals meet too few others can't have a partner and leaves.
   Signatures are dealt out in ROUNDS rounds by their values, which keeps the files of one round on disk at a time.
2. Candidate groups: connected components of the sets that meet in a block.
3. Signature trees. Nodes hold OR-combined token bitmaps, kept as the largest count of tokens at each bit, and size
   ranges. A dual traversal from the roots prunes node pairs whose maximum possible overlap is too small; pairs of
   documents that are left are counted exactly.
   a. A group is one tree. A large group is cut into chunks, a tree each, and every chunk gets the group's hubs too: the
      sets that meet most others. In a group of near copies the hubs' links make one component of nearly all of it.
   b. Large groups that still hold several components are joined across chunks, of which those of one component aren't
      paired; the traversal prunes node pairs that are one component already.
   c. Pairs of chunks are dealt out in rounds of about ROUND_PART of all shingles.
   A pair that is never counted is therefore in one component; links between components are all found.
4. Groups: connected components of the links.

Nulls and empty texts: an empty set, linked with nothing, each in a group of its own. Null doc_ids take part; a group
of only such rows has a null component_id. Repeated rows and ties: equal sets are linked. Very long texts: sets have no
size limit; a task holds one chunk of about CHUNK_SHINGLES shingles, or one set if that is larger. Empty tables give
empty ones. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.llm.common import discard, returning_memory, slices, staged

SHINGLE = 4
#: Two sets are linked when PER * intersection >= part * union; op3's part is PART.
PART, PER = 85, 100
#: Sizes of one class lie within this factor.
CLASS_FACTOR = 1.5
#: Chunks of a candidate group have about so many documents and so many shingles at most; hubs of a large group.
CHUNK_DOCS, CHUNK_SHINGLES, HUBS = 512, 1_500_000, 4
#: The hash space of signatures is dealt in so many rounds, so that the shuffle of one lies on disk at a time.
ROUNDS = 4
#: Pairs of chunks are dealt in rounds too, of about this part of all classes' shingles.
ROUND_PART = 0.25
#: Signatures that a task looks through for equal ones before it passes them on, and sets whose copies it then leaves out.
CHUNK_SIGS, KNOWN_SETS = 500_000, 200_000
BITS, LEAF, FAN = 256, 16, 8

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; words are lower-cased in A-Z only."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(one, words), _U, len(words))
    with np.errstate(over="ignore"):
        if len(words) < n:
            h = np.array([one(b" ".join(words), seed=len(words))], _U)
        else:
            out = h[: len(h) - n + 1].copy()
            for i in range(1, n):
                out = out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
            h = _mix(out)
    return np.unique(h)


@lru_cache(maxsize=512)
def _class_top(c: int) -> int:
    return max(c + 1, int(CLASS_FACTOR ** c))


def size_class(n: int) -> int:
    c = 0
    while _class_top(c) < n:
        c += 1
    return c


def _differ(a: int, b: int, part: int) -> int:
    """Most shingles in which linked sets of these sizes can differ."""
    return (a + b) * (PER - part) // (PER + part)


@lru_cache(maxsize=65536)
def _schemes(n: int, part: int) -> tuple[tuple[int, int, int], ...]:
    """(class, intervals, most differing shingles) for each class in which a set of n shingles can meet a partner."""
    most = n * PER // part
    if n == 0 or _differ(n, most, part) == 0:
        return ()
    out = []
    for c in range(size_class(n), size_class(most) + 1):
        top = _class_top(c)
        d = _differ(top, top, part)
        out.append((c, d + 1 + max(2, d // 6), _differ(n, min(top, most), part)))
    return tuple(out)


@lru_cache(maxsize=512)
def _edges(k: int) -> np.ndarray:
    return np.array([i * 2**64 // k for i in range(1, k)], _U)


def signatures(h: np.ndarray, part: int = PART) -> tuple[np.ndarray, int, int]:
    """Signatures of a sorted set, and how many of its even and odd classes' ones must meet others."""
    found, need = [], [1, 1]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(h + _U(0x632BE59BD9B4E019)))])
        for c, k, d in _schemes(len(h), part):
            at = np.concatenate([[0], np.searchsorted(h, _edges(k)), [len(h)]])
            full = at[1:] > at[:-1]
            least = k - d - int(k - full.sum())
            sig = _mix((sums[at[1:]] - sums[at[:-1]]) ^ _mix(np.arange(k, dtype=_U) + _U(c * 1_000_003 + 17)))
            if least >= 1:
                sig = sig[full]
            need[c & 1] = max(1, least)
            found.append((sig & ~_U(1)) | _U(c & 1))
    return (np.concatenate(found) if found else np.empty(0, _U)), need[0], need[1]


def _lists(values: np.ndarray, owner: np.ndarray, picked: np.ndarray, n: int) -> pa.Array:
    """The picked values as one list for each of n owners."""
    own = owner[picked]
    order = np.argsort(own, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[picked][order].view(np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int, part: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to sizes, keys and signatures. alone: signatures that no other set of the chunk has; leads: those
    that others have, at the first one; follows: the same at the others."""
    import xxhash

    known: set[bytes] = set()  # copies within a task emit their signatures once
    rows: list[tuple] = []
    held = 0

    def close() -> pa.RecordBatch:
        sigs = np.concatenate([r[3] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        order = np.argsort(sigs, kind="stable")
        ranked = sigs[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
        last = np.concatenate([first[1:], [True]])[: len(ranked)]
        sigs, owner = ranked, owner[order]
        lists = [_lists(sigs, owner, pick, len(rows)) for pick in (first & last, first & ~last, ~first)]
        plain = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()))]
        needs = [pa.array([r[k] for r in rows], pa.int32()) for k in (4, 5)]
        return pa.RecordBatch.from_arrays([*plain, *lists, *needs], names=["doc_id", "n_shingles", "key", "alone", "leads", "follows", "need0", "need1"])

    for b in slices(batches):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = shingle_set(text, shingle)
            key = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
            sigs, need0, need1 = (np.empty(0, _U), 1, 1) if key is None or key in known else signatures(h, part)
            if len(sigs) and len(known) < KNOWN_SETS:
                known.add(key)
            rows.append((doc_id, len(h), key, sigs, need0, need1))
            held += len(sigs)
        if held >= CHUNK_SIGS or len(rows) >= 8192:
            yield close()
            rows, held = [], 0
    if rows:
        yield close()


#: Edges that a task holds at most before it reduces them.
HELD_EDGES = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), reduced to a forest of stars around the least nodes; in parts of HELD_EDGES."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = _union(len(nodes), at[: len(u)], at[len(u) :])
        keep = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= HELD_EDGES:
            yield close(held)
            held, n = [], 0
    if n:
        yield close(held)


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of the component of each of n nodes."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v: long); component is the least node that can be reached.

    Labels spread along edges by minimum and jump along labels, until nothing changes; every round is written to the
    shared folder.
    """
    edges, used = edges.where("u != v").select("u", "v"), []
    for _ in range(2):
        # each node keeps one edge, to its least neighbour; its other neighbours get theirs to that one
        least = Window.partitionBy("u")
        near = _mapped(edges, _forest, "u long, v long").withColumn("_low", F.min("v").over(least))
        near = staged(near, "cc-near")
        used.append(near)
        edges = near.select("u", F.col("_low").alias("v")).unionByName(near.where("v != _low").select(F.col("v").alias("u"), F.col("_low").alias("v"))).distinct()
    edges = staged(edges, "cc-edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = staged(both, "cc-both")
    discard(*used, edges)
    held = labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "cc")
    while True:
        spread = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("_near"))
        near = labels.join(spread, "node").select("node", "component", F.least("component", "_near").alias("_next"))
        up = labels.select(F.col("node").alias("_next"), F.col("component").alias("_up"))
        after = staged(near.join(up, "_next", "left").select("node", F.least("_next", F.coalesce("_up", "_next")).alias("component"), (F.col("component") != F.least("_next", F.coalesce("_up", "_next"))).alias("_moved")), "cc")
        discard(held)
        held, labels = after, after.select("node", "component")
        if after.where("_moved").isEmpty():
            discard(both)
            return labels


class SignatureTree:
    """Documents in order of component and size; nodes hold bitmaps (largest counts at each bit), size ranges and ranges
    of the components of what is below."""

    def __init__(self, sets: list[np.ndarray], lo: int, hi: int, comps: np.ndarray):
        _, at, n = np.unique(comps[lo:hi], return_inverse=True, return_counts=True)
        apart = np.where(n[at] > 1, at, -1)  # what is a component alone goes by its size
        order = sorted(range(lo, hi), key=lambda i: (apart[i - lo], len(sets[i]), int(sets[i][0])))
        self.items = np.array(order, np.int64)
        sizes, own = np.array([len(sets[i]) for i in order], np.int64), comps[self.items]
        counts = np.array([np.bincount((sets[i] >> _U(5)).astype(np.int64) & (BITS - 1), minlength=BITS) for i in order])
        self.leaves = counts.astype(np.int32), sizes, sizes, own, own
        self.levels = [self._up(self.leaves, LEAF)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._up(self.levels[-1], FAN))

    @staticmethod
    def _up(below: tuple[np.ndarray, ...], fan: int) -> tuple[np.ndarray, ...]:
        at = np.arange(0, len(below[0]), fan)
        return tuple(f.reduceat(x, at) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), below, strict=True))


def _can_link(p, i: np.ndarray, q, j: np.ndarray, part: int) -> np.ndarray:
    """Whether sets of two components below nodes i and j can be linked: by their sizes, and by the most overlap that the
    maps allow."""
    (pm, pl, ph, pa_, pz), (qm, ql, qh, qa, qz) = p, q
    fits = (ph[i] * PER >= ql[j] * part) & (qh[j] * PER >= pl[i] * part) & ((pa_[i] != pz[i]) | (qa[j] != qz[j]) | (pa_[i] != qa[j]))
    for lo in range(0, len(i), 4096):
        s = slice(lo, lo + 4096)
        most = np.minimum(pm[i[s]], qm[j[s]]).sum(1)
        fits[s] &= most * (PER + part) >= (pl[i[s]] + ql[j[s]]) * part
    return fits


def dual_traversal(p: SignatureTree, q: SignatureTree, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Positions of items in p and q that may be linked; of a tree with itself each pair once."""
    lp, lq = len(p.levels) - 1, len(q.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        if p is q:
            i, j = i[i <= j], j[i <= j]
        fits = _can_link(p.levels[lp], i, q.levels[lq], j, part)
        i, j = i[fits], j[fits]
        if lp == 0 and lq == 0:
            break
        if lp >= lq:
            lp, (i, j) = lp - 1, _below(i, j, FAN, len(p.levels[lp - 1][0]))
            if p is q:
                lq, (j, i) = lq - 1, _below(j, i, FAN, len(q.levels[lq - 1][0]))
        else:
            lq, (j, i) = lq - 1, _below(j, i, FAN, len(q.levels[lq - 1][0]))
    i, j = _below(i, j, LEAF, len(p.items))
    j, i = _below(j, i, LEAF, len(q.items))
    if p is q:
        i, j = i[i < j], j[i < j]
    fits = _can_link(p.leaves, i, q.leaves, j, part)
    return i[fits], j[fits]


def _below(i: np.ndarray, j: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    kids = (i[:, None] * fan + np.arange(fan)).ravel()
    other = np.repeat(j, fan)
    return kids[kids < n], other[kids < n]


def join_sets(sets: list[np.ndarray], split: int = 0, part: int = PART, comps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among non-empty sets, but for those of one component; with a split, only those across it."""
    n = len(sets)
    comps = np.arange(n) if comps is None else comps
    if split:
        p, q = SignatureTree(sets, 0, split, comps), SignatureTree(sets, split, n, comps)
    else:
        p = q = SignatureTree(sets, 0, n, comps)
    i, j = dual_traversal(p, q, part)
    if not len(i):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(i, kind="stable")
    i, j = p.items[i[order]], q.items[j[order]]
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = ids.astype(np.int32)
    mark = np.zeros(len(tokens), np.int32)
    shared = np.empty(len(i), np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    for lo, hi in zip(firsts, [*firsts[1:], len(i)], strict=True):
        own = ids[ends[i[lo]] : ends[i[lo] + 1]]
        mark[own] = 1
        for a in range(lo, hi, 64):
            js = j[a : min(a + 64, hi)]
            hit = mark[np.concatenate([ids[ends[x] : ends[x + 1]] for x in js])]
            shared[a : a + len(js)] = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[js])[:-1]]))
        mark[own] = 0
    linked = shared * PER >= (sizes[i] + sizes[j] - shared) * part
    return i[linked], j[linked]


def _joined(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Rows (grp, a, b, second, small, comp, tokens) sorted by (grp, a, b), each of which is joined by itself: sets with
    each other, or if a and b differ those of a with those of b (second). Out come edges (u, v) that make the components."""

    def close(rows: dict[int, tuple], across: bool) -> pa.RecordBatch:
        held = sorted(rows.items(), key=lambda r: (r[1][0], r[0]))
        nodes, comps = np.array([n for n, _ in held], np.int64), np.array([r[1] for _, r in held], np.int64)
        sets = [np.frombuffer(r[2], _U) for _, r in held]
        split = sum(not r[0] for _, r in held) if across else 0
        if len(sets) < 2 or across and split in (0, len(sets)):
            i = j = np.empty(0, np.int64)
        else:
            i, j = join_sets(sets, split, part, comps)
        order = np.argsort(nodes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = nodes[order][_union(len(nodes), place[i], place[j])][place]
        own = root != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], names=["u", "v"])

    held: dict[int, tuple] = {}  # repeated rows and hubs in their own chunk are one
    last = None
    for b in slices(batches):
        for *key, second, node, comp, tokens in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if key != last and held:
                yield close(held, last[1] != last[2])
                held = {}
            last = key
            held[node] = second, comp, tokens
    if held:
        yield close(held, last[1] != last[2])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Text (the last column) -> its key and its set."""
    import xxhash

    for b in slices(batches):
        sets = [shingle_set(t, shingle).tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
        keys = [xxhash.xxh3_128_digest(s) if s else None for s in sets]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=[*b.schema.names[:-1], "found", "tokens"])


def _keyed(batches: Iterator[pa.RecordBatch], shingle: int, at: int) -> Iterator[pa.RecordBatch]:
    """Rows with the key of their text, the column at, as a last one."""
    import xxhash

    for b in slices(batches):
        sets = [shingle_set(t, shingle) for t in b.column(at).to_pylist()]
        keys = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "_key"])


def _mapped(df: DataFrame, f, schema, **options) -> DataFrame:
    return df.mapInArrow(returning_memory(partial(f, **options)), schema)


def _small(key: Column) -> Column:
    """The number of a class, at least 0: 63 bits of its key."""
    return F.xxhash64(key).bitwiseAND(F.lit(2**63 - 1))


def _met(sketch: DataFrame, k: int, rounds: int) -> DataFrame:
    """(small, sig) of the sets in blocks with others, of the signatures of one round."""
    passed = sketch.where("key IS NOT NULL").select(_small(F.col("key")).alias("small"), "alone", "leads", "follows")
    mine = F.pmod(F.shiftright("sig", 1), F.lit(rounds)) == k
    sent = [passed.select("small", F.explode(c).alias("sig"), F.lit(c == "leads").alias("many")).where(mine) for c in ("alone", "leads")]
    block = Window.partitionBy("sig")
    sent = sent[0].unionByName(sent[1]).repartition("sig").groupBy("sig", "small").agg(F.max("many").alias("many"))
    met = sent.withColumns({"_low": F.min("small").over(block), "_high": F.max("small").over(block), "_many": F.max("many").over(block)}).where("_many OR _low != _high").select("small", "sig")
    return met.unionByName(passed.select("small", F.explode("follows").alias("sig")).where(mine)).distinct()


def _blocks(met: DataFrame, classes: DataFrame) -> DataFrame:
    """met without sets that meet too few for any partner."""
    odd = F.col("sig").bitwiseAND(F.lit(1))
    n = met.groupBy("small").agg(F.count_if(odd == 0).alias("n0"), F.count_if(odd == 1).alias("n1"))
    enough = n.join(classes.select("small", "need0", "need1"), "small").where("n0 >= need0 OR n1 >= need1")
    return met.join(enough, "small").where(F.when(odd == 0, F.col("n0") >= F.col("need0")).otherwise(F.col("n1") >= F.col("need1"))).select("small", "sig")


def _with_tokens(found: DataFrame, thin: DataFrame, shingle: int) -> DataFrame:
    """found (with key and rep) with the tokens of its sets; repeated rows may give some twice."""
    cols = [c for c in found.columns if c != "rep"]
    schema = [f"{c} {t}" for c, t in found.dtypes if c != "rep"]
    texts = found.hint("merge").join(thin, found.rep == thin.doc_id).select(*cols, "text")
    by_id = _mapped(texts, _sets, ", ".join([*schema, "found binary", "tokens binary"]), shingle=shingle).where("key = found")
    # classes all of whose rows have no doc_id
    bare = _mapped(thin.where("doc_id IS NULL").select("text"), _sets, "found binary, tokens binary", shingle=shingle)
    by_key = found.where("rep IS NULL").hint("merge").join(bare, F.col("key") == F.col("found"))
    return by_id.select(*cols, "tokens").unionByName(by_key.select(*cols, "tokens"))


def _chunk(n: Column, by: Column) -> Column:
    return F.pmod(F.xxhash64(by), F.greatest(n, F.lit(1))).cast("int")


def _links(blocks: DataFrame, classes: DataFrame, thin: DataFrame, shingle: int, part: int) -> DataFrame:
    """Edges (u, v) between classes whose components are those of all links."""
    # 2. candidate groups: the sets of a block go with its least one; written first, so that a join can split a hot block
    low = staged(blocks.groupBy("sig").agg(F.min("small").alias("_low"), F.max("small").alias("_high")).where("_low != _high").select("sig", "_low"), "ngram-low")
    stars = blocks.join(low, "sig").where("small != _low").select(F.col("small").alias("u"), F.col("_low").alias("v")).distinct()
    stars = staged(stars, "ngram-stars")
    groups = components(stars).select(F.col("node").alias("small"), F.col("component").alias("grp"))
    n_met = blocks.groupBy("small").agg(F.count("*").alias("n_met"))
    whole = classes.agg(F.sum("n_shingles")).first()[0] or 0
    found = groups.join(n_met, "small").join(classes, "small").select("grp", "small", "key", "rep", "n_shingles", "n_met")
    found = staged(found, "ngram-groups")
    discard(blocks, low, stars)
    size = F.greatest(F.ceil(F.count("*") / F.lit(CHUNK_DOCS)), F.ceil(F.sum("n_shingles") / F.lit(CHUNK_SHINGLES))).cast("int")
    sizes = found.groupBy("grp").agg(F.count("*").alias("n"), size.alias("chunks")).where("n > 1")
    found = found.join(sizes, "grp").withColumn("a", _chunk(F.col("chunks"), F.col("small")))
    sets = staged(_with_tokens(found.select("grp", "chunks", "a", "small", "key", "rep"), thin, shingle).drop("key"), "ngram-sets")
    # 3a. every chunk by itself, with the hubs of its group
    large = found.where("chunks > 1")
    top = large.groupBy("grp", F.pmod("small", F.lit(HUBS)).alias("_h")).agg(F.max_by("small", F.struct("n_met", "small")).alias("small"))
    hubs = sets.join(top.select("small"), "small", "left_semi").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = sets.unionByName(hubs).select("grp", "a", F.col("a").alias("b"), F.lit(False).alias("second"), "small", F.col("small").alias("comp"), "tokens")
    linked = staged(_dealt(rows, part), "ngram-links")
    large = staged(large.select("grp", "small", "n_shingles"), "ngram-large")
    if large.isEmpty():
        discard(sets)
        return linked
    # 3b. groups that hold several components yet
    comps = components(linked).toDF("small", "comp")
    large = staged(large.join(comps, "small", "left").withColumn("comp", F.coalesce("comp", "small")), "ngram-large")
    apart = large.groupBy("grp").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low != _high").select("grp")
    rest = staged(large.join(staged(apart, "ngram-apart"), "grp"), "ngram-rest")
    # a component with half a chunk or more has chunks of its own
    n_comp = rest.groupBy("grp", "comp").agg(F.count("*").alias("n")).withColumn("own", F.col("n") * 2 >= CHUNK_DOCS)
    n_rest = n_comp.where("NOT own").groupBy("grp").agg(F.sum("n").alias("n_rest"))
    rest = rest.join(n_comp, ["grp", "comp"]).join(n_rest, "grp", "left")
    chunks = F.ceil(F.when(F.col("own"), F.col("n")).otherwise(F.col("n_rest")) / F.lit(CHUNK_DOCS)).cast("int")
    of = F.struct(F.when(F.col("own"), F.col("comp")).alias("of"), _chunk(chunks, F.col("small")).alias("i"))
    rest = staged(rest.select("grp", "small", "comp", "n_shingles", F.xxhash64(F.col("grp"), of["of"], of["i"]).alias("chunk"), of["of"].alias("of")), "ngram-rest")
    parts = rest.select("grp", "chunk", "of").distinct()
    other = parts.select("grp", F.col("chunk").alias("_c"), F.col("of").alias("_of"))
    pairs = parts.join(other, "grp").where("(of IS NULL AND _of IS NULL AND chunk <= _c) OR (of IS NULL AND _of IS NOT NULL) OR (of < _of)")
    meets = pairs.select(F.col("chunk").alias("a"), F.col("_c").alias("b"))
    sides = meets.select(F.col("a").alias("chunk"), "a", "b", F.lit(False).alias("second")).unionByName(meets.where("a != b").select(F.col("b").alias("chunk"), "a", "b", F.lit(True).alias("second")))
    sent = rest.join(sides.groupBy("chunk").agg(F.count("*").alias("n")), "chunk").agg(F.sum(F.col("n") * F.col("n_shingles"))).first()[0] or 0
    rounds = max(1, math.ceil(sent / max(whole * ROUND_PART, CHUNK_SHINGLES)))
    for k in range(rounds):
        mine = sides.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)
        rows = sets.select("small", "tokens").join(rest.drop("n_shingles"), "small").join(mine, "chunk").select("grp", "a", "b", "second", "small", "comp", "tokens")
        linked = linked.unionByName(staged(_dealt(rows, part), "ngram-links"))
    discard(sets)
    return linked


def _dealt(rows: DataFrame, part: int) -> DataFrame:
    return _mapped(rows.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b"), _joined, "u long, v long", part=part)


def _classed(docs: DataFrame, shingle: int, part: int) -> DataFrame:
    """doc_id, n_shingles, key, component_id, n_copies and comp (the component; null if the row is linked with nothing)."""
    thin = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_shingles long, key binary, alone array<long>, leads array<long>, follows array<long>, need0 int, need1 int"
    sketch = staged(_mapped(thin, _sketches, schema, shingle=shingle, part=part), "ngram")
    small = _small(F.col("key"))
    classes = sketch.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.first("n_shingles").alias("n_shingles"), F.max("need0").alias("need0"), F.max("need1").alias("need1"))
    classes = staged(classes.withColumn("small", small), "ngram-classes")
    # the wide table goes before texts are dealt out
    met = [staged(_met(sketch, k, ROUNDS), "ngram-met") for k in range(ROUNDS)]
    rows = staged(sketch.select("doc_id", "n_shingles", "key"), "ngram-keys")
    discard(sketch)
    blocks = staged(_blocks(reduce(DataFrame.unionByName, met), classes), "ngram-blocks")
    discard(*met)
    linked = _links(blocks, classes, thin, shingle, part)
    # 4. groups
    joined = components(linked).withColumnRenamed("node", "small")
    known = classes.join(joined, "small", "left").where("mult > 1 OR component IS NOT NULL").select("key", "rep", "mult", F.coalesce("component", "small").alias("comp"))
    known = staged(known, "ngram-known")
    least = known.groupBy("comp").agg(F.min("rep").alias("least"))
    known = known.join(least, "comp").select("key", "mult", "comp", "least")
    out = rows.join(known, "key", "left")
    alone = F.col("comp").isNull()
    return out.select(
        "doc_id", "n_shingles", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        (F.coalesce(F.col("mult"), F.lit(1)) - 1).alias("n_copies"), "comp",
    )


def link_documents(docs: DataFrame, shingle: int = SHINGLE, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id and n_copies (other documents with an equal set)."""
    return _classed(docs, shingle, part).drop("key", "comp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, part: int = PART) -> DataFrame:
    """One row of each group, that of its least doc_id (a null one comes last); the columns of docs.

    Rows without words stay, all of them. Of rows of a group with equal doc_ids one stays, that of the least set key, and
    of rows equal in both the least one by the values of all columns.
    """
    rows = staged(_classed(docs, shingle, part).select("doc_id", "key", "comp"), "ngram-rows")
    id_ = F.col("doc_id").cast("long")
    # rows that their doc_id doesn't tell apart
    repeated = staged(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "ngram-repeated")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "key")
    kept = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min(order).alias("_k")).select("_k.doc_id", "_k.key")
    kept = kept.unionByName(rows.where("comp IS NULL").select("doc_id", "key"))
    plain = docs.join(kept.select(F.col("doc_id").alias("_id")).join(repeated, "_id", "left_anti"), id_ == F.col("_id"), "left_semi")
    if repeated.isEmpty() and rows.where("doc_id IS NULL").isEmpty():
        return plain
    bare = docs.where("doc_id IS NULL").unionByName(docs.join(repeated, id_ == F.col("_id"), "left_semi"))
    keyed = _mapped(bare, _keyed, T.StructType([*bare.schema.fields, T.StructField("_key", T.BinaryType())]), shingle=shingle, at=docs.columns.index("text"))
    wanted = kept.where("key IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("key").alias("_k")).distinct()
    held = keyed.join(wanted, F.col("_key").eqNullSafe(F.col("_k")) & id_.eqNullSafe(F.col("_id")), "left_semi")
    one = held.groupBy("_key", id_.alias("_id")).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("_r")).select("_r.*")
    return plain.unionByName(one).unionByName(keyed.where("_key IS NULL").drop("_key"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
h AS (SELECT md5(string_agg(s, chr(10) ORDER BY s)) AS k, doc_id FROM g GROUP BY doc_id),
c AS (SELECT doc_id, COUNT(*) OVER (PARTITION BY k) - 1 AS copies FROM h),
r AS (WITH RECURSIVE reach(x, y) AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x) SELECT x, MIN(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, LEAST(w.doc_id, COALESCE(r.y, w.doc_id)) AS component_id, COALESCE(copies, 0)::BIGINT AS n_copies
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = w.doc_id LEFT JOIN c USING (doc_id)
"""
