"""N-gram Jaccard join by T-occurrence search (DivideSkip).

1. Each text becomes a set of word shingles (64-bit hashes); equal sets are one node.
2. A set of size s is split by hash into parts, somewhat more than the D tokens in which a
   linked set may differ. As each differing token spoils one part, two linked sets have equal
   parts among the D + 1 that each of them names, first those with the most uncommon tokens.
   Nodes that name an equal part form a family, so links stay inside families, and families
   hold near copies only: a passage that many documents share makes no equal parts.
3. Families are searched: the short inverted lists of a query's tokens are merged with a heap
   that skips, the long ones are probed for the candidates that can still reach the overlap.
4. A family beyond a task's bounds is searched in parts that share some pivots; then only the
   nodes that are not in its largest class are held against all the others, in blocks.
5. Components of the links give each document its class.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import arrow_rows, give_back, most_frequent, shuffle_partitions, stage, unstage
from tallow.llm.components import components
from tallow.llm.wordhash import mix, words

COMMON = 3
COMMON_KEPT = 1 << 19  # tokens known to every task as common, the most frequent first; they steer which parts a set names, results do not depend on them
BLOCK = 4000
BLOCK_TOKENS = 2_000_000
PIVOTS = 32
BUCKET_BYTES = 4 << 20
FLUSH = 500_000
EDGES = 1 << 14  # edges in a packed row or a batch
COUNTED = 4_000_000
BATCH_ROWS = 1000
CHUNK = 1 << 18
SALTS = 16
BROADCAST_BYTES = 64 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_KEY_BITS = np.uint64(16)  # signatures and keys of nodes are 48 bits: equal ones by chance only widen families


def shingle_sets(col: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks (lo, hi, sets, cuts): sorted distinct shingle hashes of rows lo to hi, set i being sets[cuts[i]:cuts[i+1]]."""
    for w in words(col, CHUNK):
        row = w.row - w.lo
        rows = np.bincount(row, minlength=w.hi - w.lo) if len(row) else np.zeros(w.hi - w.lo, np.int64)
        at, total = np.concatenate(([0], np.cumsum(rows))), len(w.hash)
        padded = np.concatenate((w.hash, np.zeros(n, np.uint64)))
        h = np.zeros(total, np.uint64)
        short = at[:-1][(rows > 0) & (rows < n)]
        part, length = np.zeros(len(short), np.uint64), rows[(rows > 0) & (rows < n)]
        for j in range(n):
            step = np.uint64(j + 1)
            h = mix(h * _M + padded[j : j + total] + step)
            part = np.where(j < length, mix(part * _M + padded[short + j] + step), part)
        h[short] = part
        full = np.arange(total) + n <= np.repeat(at[1:], rows)
        full[short] = True
        h, row = h[full], row[full]
        ends = np.searchsorted(row, np.arange(w.hi - w.lo + 1)).tolist()
        for lo, hi in zip(ends, ends[1:], strict=False):
            h[lo:hi].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        yield w.lo, w.hi, h, np.searchsorted(row, np.arange(w.hi - w.lo + 1))


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, num: int, den: int):
    """Smallest overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -(-(num * (a + b)) // (num + den))


class Held:
    """Columns of 64-bit numbers, gathered in memory that is used again: it is touched only as far as it is filled, and no small arrays are left between large ones."""

    def __init__(self, room: int, columns: int = 1) -> None:
        self.data, self.n = np.empty((columns, room), np.uint64), 0

    def fits(self, k: int) -> bool:
        return self.n + k <= self.data.shape[1]

    def add(self, *columns: np.ndarray | np.uint64, k: int) -> None:
        """k numbers for each column; room for them is made where need be."""
        if not self.fits(k):
            more = np.empty((len(self.data), self.n + k), np.uint64)
            more[:, : self.n] = self.data[:, : self.n]
            self.data = more
        for row, x in zip(self.data, columns, strict=True):
            row[self.n : self.n + k] = x
        self.n += k

    def take(self) -> np.ndarray:
        """What is held, valid until the next add."""
        out, self.n = self.data[:, : self.n], 0
        return out


def repeated(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that occur twice or more, ascending, and how often; sorts every in place."""
    every.sort()
    same = np.zeros(len(every) + 1, np.int8)
    np.equal(every[1:], every[:-1], out=same[1:-1].view(bool))
    step = np.diff(same)
    first = np.flatnonzero(step == 1)
    return every[first], np.flatnonzero(step == -1) - first + 1


def common_tokens(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """Sorted tokens that occur more than COMMON times, counting those seen twice or more within a run of about COUNTED tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(COUNTED)

        def count() -> pa.RecordBatch:
            token, times = repeated(held.take()[0])
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times.astype(np.int64))], names=["token", "n"])

        for b in batches:
            for _, _, sets, _ in shingle_sets(b.column(0), n):
                if held.n and not held.fits(len(sets)):
                    yield count()
                held.add(sets, k=len(sets))
        if held.n:
            yield count()
        del held
        give_back()

    counts = docs.select(text_col).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    counts = stage(counts, "jaccard-common")
    top = most_frequent(counts, "n", COMMON_KEPT).select("token").toPandas()  # COMMON_KEPT rows at most
    unstage(counts)
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def _before(x: np.ndarray) -> np.ndarray:
    """Sums (modulo 2^64) of what stands before each place, and of all."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


class Parts:
    """How sets are split. Scheme i serves the pairs whose larger set has a size in [lows[i], lows[i + 1]); the smaller is in that range or the one before."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(lows[-1] * den // num + 1)
        self.lows = np.array(lows, np.int64)
        spoiled = self.spoiled(self.lows[1:] - 1, self.lows[1:] - 1)
        self.parts = spoiled + spoiled // 5 + 2

    def spoiled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most tokens in which linked sets of sizes a and b differ."""
        return (a + b) * (self.den - self.num) // (self.num + self.den)

    def signatures(self, sets: np.ndarray, cuts: np.ndarray, late: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, signatures) of the sets of a chunk, as 48-bit hashes of named parts; late tells the common tokens.

        A set of fewer parts than needed names all of them and the tokens of its prefix as well.
        """
        size = np.diff(cuts)
        most = size * self.den // self.num
        content = _before(mix(sets + _M))
        rare = np.concatenate(([0], np.cumsum(~late)))
        own = np.searchsorted(self.lows, size, "right") - 1
        for scheme in (own, own + 1):
            largest = np.minimum(most, self.lows[scheme + 1] - 1)
            need = np.where((size > 0) & (largest >= self.lows[scheme]), self.spoiled(size, largest), 0)
            part = ((sets >> np.uint64(32)) * np.repeat(self.parts[scheme].astype(np.uint64), size)) >> np.uint64(32)
            edge = np.ones(len(sets), bool)
            edge[1:] = part[1:] != part[:-1]
            edge[cuts[:-1][size > 0]] = True
            first = np.flatnonzero(edge)
            last = np.append(first[1:], len(sets))
            bounds = np.searchsorted(first, cuts)
            salt = np.repeat(scheme.astype(np.uint64), np.diff(bounds)) * np.uint64(0xA0761D6478BD642F)
            code = mix(content[last] - content[first] + salt) if len(first) else np.zeros(0, np.uint64)
            few = np.uint64(15) - np.minimum(rare[last] - rare[first], 15).astype(np.uint64)
            code = (few << np.uint64(60)) | (code >> np.uint64(4))
            for i in np.flatnonzero(need).tolist():
                named, n = code[bounds[i] : bounds[i + 1]], int(need[i]) + 1
                if len(named) > n:
                    named = np.partition(named, n - 1)[:n]
                yield i, (named << np.uint64(4)) >> _KEY_BITS
                if len(named) < n:
                    s, common = sets[cuts[i] : cuts[i + 1]], late[cuts[i] : cuts[i + 1]]
                    prefix = len(s) - int(least_overlap(len(s), -(-self.num * len(s) // self.den), self.num, self.den)) + 1
                    yield i, mix(np.concatenate((s[~common], s[common]))[:prefix] ^ _M) >> _KEY_BITS


def _pack(x: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _stars(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures in order, the smallest key of each, and the distinct (key, smallest key) of the others as two columns."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    hub = key[new][np.cumsum(new) - 1]
    far = key != hub
    pairs = np.stack((key[far], hub[far]), axis=1)
    return sig[new], key[new], np.unique(pairs, axis=0) if len(pairs) else pairs


PACKED = "bucket long, sig binary, key binary, u array<long>, v array<long>, ids array<long>, sizes array<long>, sets array<binary>"
HEADS = "doc_id long, n_shingles long, sig binary, key long, u long, v long"


def heads_and_edges(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """One staged table of two kinds of rows: heads (doc_id, n_shingles, sig of the whole set, key of 48 bits) and edges (u, v) between keys of a family.

    Each batch of rows merges its own equal signatures first and deals the rest to buckets by their hash; the
    texts are read once. Buckets are as many as the bytes of the texts ask for.
    """
    spark, splitter = docs.sparkSession, Parts(num, den)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    shared = spark.sparkContext.broadcast(common_tokens(docs, n, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, turn = shared.value, TaskContext.get().partitionId() * 7919
        held = Held(FLUSH, 2)

        def row(bucket: int, sig=b"", key=b"", u=(), v=(), ids=(), sizes=(), sets=()) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((bucket, sig, key, u, v, ids, sizes, sets), kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])

        def flush() -> Iterator[pa.RecordBatch]:
            sig, key, pairs = _stars(*held.take())
            ends = np.searchsorted(sig, (np.arange(buckets + 1, dtype=np.float64) * (2.0**48 / buckets)).astype(np.uint64)).tolist()
            ends[-1] = len(sig)
            for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                if lo < hi:
                    yield row(i, _pack(sig[lo:hi]), _pack(key[lo:hi]))
            for i, lo in enumerate(range(0, len(pairs), EDGES)):
                u, v = pairs[lo : lo + EDGES].astype(np.int64).T
                yield row((turn + i) % buckets, u=u, v=v)

        for b in batches:
            for lo, hi, sets, cuts in shingle_sets(b.column(1), n):
                turn += 1
                size = np.diff(cuts)
                sums = _before(sets), _before(mix(sets + _M))
                one, two = (s[cuts[1:]] - s[cuts[:-1]] for s in sums)
                key = mix(one ^ mix(two + size.astype(np.uint64))) >> _KEY_BITS
                sig = [f"{k:x}.{x:016x}{y:016x}".encode() if k else None for k, x, y in zip(size.tolist(), one.tolist(), two.tolist(), strict=True)]
                yield row(turn % buckets, u=key.astype(np.int64), ids=b.column(0).slice(lo, hi - lo).cast(pa.int64()).to_pylist(), sizes=size.astype(np.int64), sets=sig)
                spot = np.searchsorted(common, sets)
                late = common[np.minimum(spot, len(common) - 1)] == sets if len(common) else np.zeros(len(sets), bool)
                for i, s in splitter.signatures(sets, cuts, late):
                    if held.n and not held.fits(len(s)):
                        yield from flush()
                    held.add(s, key[i], k=len(s))
        if held.n:
            yield from flush()
        del held
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(len(u), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=[x.split()[0] for x in HEADS.split(", ")])

        def solve() -> Iterator[pa.RecordBatch]:
            _, _, pairs = _stars(*(np.concatenate([_unpack(x[i]) for x in held]) for i in (0, 1)))
            held.clear()
            for lo in range(0, len(pairs), EDGES):
                yield edges(*pairs[lo : lo + EDGES].astype(np.int64).T)

        for batch in batches:
            for i in range(batch.num_rows):
                b, sig, key, u, v, ids, sizes, sets = (batch.column(k)[i] for k in range(8))
                if len(ids.values):
                    none = pa.nulls(len(ids.values), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.values, sizes.values, sets.values, u.values, none, none], names=[x.split()[0] for x in HEADS.split(", ")])
                elif len(u.values):
                    yield edges(u.values, v.values)
                else:
                    if b.as_py() != bucket and held:
                        yield from solve()
                    bucket = b.as_py()
                    held.append((sig.as_py(), key.as_py()))
        if held:
            yield from solve()
        give_back()

    packed = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PACKED)
    tasks = max(shuffle_partitions(spark), buckets // 8)
    return stage(packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, HEADS), "jaccard-heads")


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, number of lists that hold it) of the values in at least `least` of the ascending lists.

    A heap holds the head of each list. Where the smallest value occurs too seldom, least - 1 lists are
    taken off and set forward to the heap's next value by binary search, as nothing before it can do.
    """
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapify(heap)
    at, found = [0] * len(lists), []
    while len(heap) >= least:
        value, taken = heap[0][0], []
        if least == 1 and len(heap) == 1:
            k = heap[0][1]
            found += [(x, 1) for x in lists[k][at[k] :]]
            break
        while heap and heap[0][0] == value:
            taken.append(heappop(heap)[1])
        if len(taken) >= least:
            found.append((value, len(taken)))
            for k in taken:
                at[k] += 1
                if at[k] < len(lists[k]):
                    heappush(heap, (lists[k][at[k]], k))
            continue
        while len(taken) < least - 1 and heap:
            taken.append(heappop(heap)[1])
        if not heap:
            break
        upto = heap[0][0]
        for k in taken:
            at[k] = bisect_left(lists[k], upto, at[k])
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))
    return found


class Index:
    """Inverted lists of sets (positions in `sets`, ascending), searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], searched: range, num: int, den: int) -> None:
        self.sets, self.num, self.den = sets, num, den
        self.size = np.array([len(s) for s in sets])
        docs = np.repeat(np.array(searched, np.int32), self.size[searched.start : searched.stop])
        flat = np.concatenate([sets[i] for i in searched]) if len(docs) else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")  # docs ascend already
        flat, self.docs = flat[order], docs[order]
        del order, docs
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
        self.tokens, self.bounds = flat[first], np.append(first, len(flat))
        self.posting = np.repeat(np.arange(len(first)) * len(sets), np.diff(self.bounds))
        self.posting += self.docs

    def links(self, q: int, group: np.ndarray) -> list[int]:
        """Positions of the sets of other groups that link with set q.

        The lists of q's tokens are ordered by length. With T the least overlap, a set that links occurs
        T - L times in all but the L longest lists: those are merged, and the L are probed for the candidates alone.
        """
        num, den, size = self.num, self.den, int(self.size[q])
        spot = np.searchsorted(self.tokens, self.sets[q])
        known = spot < len(self.tokens)
        hit = spot[known]
        hit = hit[self.tokens[hit] == self.sets[q][known]]
        t = max(1, int(least_overlap(size, -(-num * size // den), num, den)))
        if len(hit) < t:
            return []
        length = self.bounds[hit + 1] - self.bounds[hit]
        hit = hit[np.argsort(length, kind="stable")]
        skipped = min(t - 1, int(t / (0.01 * np.log2(int(length.max()) + 1) + 1)))
        short, long = hit[: len(hit) - skipped], hit[len(hit) - skipped :]
        lists = [self.docs[a:b].tolist() for a, b in zip(self.bounds[short].tolist(), self.bounds[short + 1].tolist(), strict=True)]
        lists = [x for x in lists if len(x) > 1 or x[0] != q]
        found = merge_skip(lists, t - skipped)
        cand, count = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        fit = (group[cand] != group[q]) & (self.size[cand] * den >= num * size) & (num * self.size[cand] <= den * size)
        cand, count = cand[fit], count[fit]
        out = []
        for lo in range(0, len(cand), 64):
            y, c = cand[lo : lo + 64], count[lo : lo + 64]
            if len(long):
                keys = (long[:, None] * len(self.sets) + y[None, :]).ravel()
                at = np.minimum(np.searchsorted(self.posting, keys), len(self.posting) - 1)
                c = c + (self.posting[at] == keys).reshape(len(long), len(y)).sum(axis=0)
            out += y[c >= least_overlap(size, self.size[y], num, den)].tolist()
        return out


INDEX, ASKS, BOTH = 0, 1, 2


def search_block(sides: list[int], sets: list[np.ndarray], group: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (positions) that join the groups of a block as all its links would; rows of a side stand together: INDEX, BOTH, ASKS.

    Where all rows ask and are asked, a few pivots ask first. A pair inside the largest group needs no test and
    any other pair has a row outside of it, so after that only the rows outside ask.
    """
    asking, searched = range(sides.count(INDEX), len(sides)), range(len(sides) - sides.count(ASKS))
    index, links = Index(sets, searched, num, den), []

    def ask(q: int) -> None:
        for x in index.links(q, group):
            if group[x] != group[q]:
                links.append((q, x))
                group[group == group[x]] = group[q]

    asked = set()
    if len(asking) == len(searched) == len(sides):
        for q in asking[:: max(1, len(sides) // 8)][:8]:
            asked.add(q)
            ask(q)
        kinds, count = np.unique(group, return_counts=True)
        largest = int(np.flatnonzero(group == kinds[np.argmax(count)])[0])
        for q in asking:
            if q not in asked and group[q] != group[largest]:
                ask(q)
    else:
        for q in asking:
            ask(q)
    return links


def _search(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) of each task's block. placed: task, side, node, class (null: its own), tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def solve() -> pa.RecordBatch:
            order = {INDEX: 0, BOTH: 1, ASKS: 2}
            rows = sorted(held, key=lambda r: (order[r[0]], r[1]))
            held.clear()
            sides, nodes, classes, sets = (list(x) for x in zip(*rows, strict=True))
            group = np.arange(len(rows)) if classes[0] is None else np.unique(np.array(classes, np.int64), return_inverse=True)[1].ravel()
            links = search_block(sides, sets, group, num, den)
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in links], pa.int64()), pa.array([nodes[b] for _, b in links], pa.int64())], names=["u", "v"])

        for b in batches:
            tokens = b.column(4)
            values = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.concatenate(([0], np.cumsum(np.diff(tokens.offsets.to_numpy()))))
            for i, (t, side, node, cls) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)):
                if t != task:
                    if len(held) > 1:
                        yield solve()
                    task, held = t, []
                held.append((side, node, cls, values[ends[i] : ends[i + 1]].copy()))
        if len(held) > 1:
            yield solve()
        held.clear()
        give_back()

    return placed.repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def _tokens_at(docs: DataFrame, places: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """task, side, node, cls, tokens: the sets of the texts of places (node, places: array of (task, side, cls)), one row per place."""
    small = places.agg(F.sum(F.lit(40) + 24 * F.size("places"))).first()[0] or 0
    places = F.broadcast(places) if small <= BROADCAST_BYTES else places
    places = places.withColumnRenamed("node", "pnode")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(places, F.col("node") == F.col("pnode")).select("node", "text", "places")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, sets, cuts in shingle_sets(b.column(1), n):
                column = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), column], names=["node", "places", "tokens"])
        give_back()

    members = texts.mapInArrow(sets_of, "node long, places array<struct<task:long,side:int,cls:long>>, tokens array<long>").where(F.size("tokens") > 0)
    return members.select(F.explode("places").alias("at"), "node", "tokens").select("at.task", "at.side", "node", "at.cls", "tokens")


def _by_family(members: DataFrame, families: DataFrame) -> DataFrame:
    """members with the columns of families (one row per family); broadcast where few, else a family's row is dealt out by salt."""
    if families.count() * 64 <= BROADCAST_BYTES:
        return members.join(F.broadcast(families), "family")
    salted = families.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["family", "salt"]).drop("salt")


_place = lambda side, cls, *of: F.struct(F.xxhash64("family", *of).alias("task"), F.lit(side).cast("int").alias("side"), cls.cast("long").alias("cls"))
_upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(0))), lambda j: j < n)


def _first_places(members: DataFrame, families: DataFrame) -> DataFrame:
    """Places of the first search: a family is one task, or `parts` tasks that share about PIVOTS of its nodes."""
    m = _by_family(members, families)
    none = F.lit(None)
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(2)), F.col("n")) < F.least(F.lit(PIVOTS), F.floor(F.lit(BLOCK_TOKENS / 4) * F.col("n") / F.col("s"))))
    at = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    places = F.when(pivot, F.transform(_upto(F.col("parts")), lambda j: _place(BOTH, none, j))).otherwise(F.array(_place(BOTH, none, at)))
    # An id that several texts bear has the places of each.
    return m.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(places))).alias("places"))


def _rest_places(members: DataFrame, classes: DataFrame, step: float) -> DataFrame:
    """Places of the second search: in families of several tasks, the nodes outside of the largest class ask all of the same or neighbouring cells of set sizes.

    members: family, node, n_shingles of such families. A block is a part of the asking nodes of a cell and a part of the nodes of a cell.
    """
    m = members.join(classes.select(F.col("node").alias("cnode"), "component"), F.col("node") == F.col("cnode"), "left").drop("cnode")
    m = stage(m.withColumn("cls", F.coalesce("component", "node")).withColumn("cell", F.floor(F.log("n_shingles") / F.lit(step)).cast("int")), "jaccard-large")
    main = m.groupBy("family", "cls").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.max_by("cls", F.struct("c", F.col("cls"))).alias("main"))
    m = _by_family(m, main).withColumn("asks", F.col("cls") != F.col("main"))
    size = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_TOKENS)).cast("int")
    cells = m.groupBy("family", "cell").agg(size(F.count(F.lit(1)), F.sum("n_shingles")).alias("k"), size(F.count_if("asks"), F.coalesce(F.sum(F.when(F.col("asks"), F.col("n_shingles"))), F.lit(0))).alias("a"))
    tables = cells.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("k", "a")))).alias("cells")).where(F.exists(F.map_values("cells"), lambda x: x["a"] > 0))
    m = _by_family(m, stage(tables, "jaccard-cells"))
    count = lambda c, name: F.coalesce(F.try_element_at("cells", c)[name], F.lit(0))
    part = lambda k, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.greatest(k, F.lit(1))).cast("int")
    cell = F.col("cell")
    cls = F.col("cls")

    def mine(d: int) -> Column:
        """Where the node is asked by those of the cell d away."""
        return F.transform(_upto(count(cell + d, "a")), lambda j: _place(INDEX, cls, cell + d, j, cell, part(count(cell, "k"), 3)))

    def asked(d: int) -> Column:
        """Where the node asks those of the cell d away."""
        return F.when(F.col("asks"), F.transform(_upto(count(cell + d, "k")), lambda j: _place(ASKS, cls, cell, part(count(cell, "a"), 4), cell + d, j)))

    none = F.array().cast("array<struct<task:bigint,side:int,cls:bigint>>")
    places = F.concat(*map(mine, (-1, 0, 1)), *[F.coalesce(asked(d), none) for d in (-1, 0, 1)])
    return m.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(places))).alias("places")).where(F.size("places") > 0)


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: classes of documents linked by den * overlap >= num * union.

    A text of fewer than n words is one shingle; without words or text (null, empty) it has none, links with
    nothing and is its own class. Rows with equal ids and sets are one node, repeated rows give repeated
    rows, and a row without an id has the class of its set. A very long text is one set, whole. A
    table without rows gives none; only the id and the text are read, so other columns may have any name.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        both = heads_and_edges(docs, n, num, den, id_col, text_col)
    edges, heads = both.where("u is not null").select("u", "v"), both.where("u is null").drop("u", "v")
    copied = heads.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    salted = copied.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    nodes = heads.withColumn("salt", salt).join(salted, ["sig", "salt"], "left")
    nodes = nodes.withColumn("node", F.when(F.col("sig").isNotNull(), F.coalesce("first", "doc_id")))
    nodes = stage(nodes.select("doc_id", "n_shingles", "node", "key"), "jaccard-nodes")

    families = components(edges).select(F.col("node").alias("key"), F.col("component").alias("family"))
    members = nodes.where("node = doc_id").select("node", "n_shingles", "key").distinct().join(families, "key").drop("key")
    members = stage(members, "jaccard-members")
    unstage(both)
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_TOKENS)).cast("int")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")).where("n > 1").withColumn("parts", parts)
    sizes = stage(sizes, "jaccard-families")
    places = stage(_first_places(members, sizes), "jaccard-places")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        links = stage(_search(_tokens_at(docs, places, n, id_col, text_col), num, den), "jaccard-links")
    unstage(places)
    classes = components(links)
    large = sizes.where("parts > 1")
    if large.limit(1).count():
        step = float(-np.log(num / den)) * (1 + 1e-9)
        rest = stage(_rest_places(_by_family(members, large.select("family")), classes, step), "jaccard-rest")
        if rest.limit(1).count():
            with arrow_rows(docs.sparkSession, BATCH_ROWS):
                more = stage(_search(_tokens_at(docs, rest, n, id_col, text_col), num, den), "jaccard-links")
            classes = components(links.unionByName(more))
    salted = classes.select(F.col("node").alias("cnode"), "component").withColumn("csalt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    out = nodes.withColumn("salt", salt).join(salted, (F.col("node") == F.col("cnode")) & (F.col("salt") == F.col("csalt")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def row_hash(columns: list[str], half: int) -> Column:
    """Half 0 or 1 of the 128-bit name of a row."""
    return F.xxhash64(*[F.lit("second")] * half, *columns)


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each class, that with the smallest id (null is largest; of equal ids any one): columns of docs.

    Classes are of rows, not of ids: texts that share an id are judged apart, and of rows equal in every column one
    stays. A row is named by a 128-bit hash of its columns, so nothing is numbered and no copy is kept; the join works on
    the first half, and rows that share it alone are told apart by the other. Rows without
    words all stay but for such equal ones. Null ids and texts, empty tables and other columns are taken as they come.
    """
    name, more = (next(f"_row{i}{'_' * k}" for k in range(99) if f"_row{i}{'_' * k}" not in docs.columns) for i in "ab")
    rows = docs.withColumns({name: row_hash(docs.columns, 0), more: row_hash(docs.columns, 1)})
    named = stage(rows.groupBy(name, more).agg(F.first(id_col).alias("_id"), F.count(F.lit(1)).alias("copies")), "jaccard-names")
    # Of different rows that share the first half, a few in 10^20 pairs, the later ones are searched under the second.
    shared = stage(named.groupBy(name).agg(F.min(more).alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "jaccard-shared")
    if shared.limit(1).count():
        apart = lambda df: df.join(shared, name, "left").withColumn(name, F.when(F.col(more) == F.coalesce("_first", more), F.col(name)).otherwise(F.col(more))).drop("_first")
        rows, named = apart(rows), stage(apart(named), "jaccard-names")
    found = jaccard_classes(rows, id_col=name, **options).select(F.col("doc_id").alias(name), "component_id").distinct()
    classes = stage(found.join(named, name), "jaccard-classes")
    first = classes.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", name)).alias("x")).select(F.col(f"x.{name}").alias(name))
    gone = stage(classes.select(name).join(first, name, "left_anti").distinct(), "jaccard-gone")
    known = lambda x: F.broadcast(x) if x.count() * 16 <= BROADCAST_BYTES else x
    kept = rows.join(known(gone), name, "left_anti")
    twice = stage(classes.where("copies > 1").select(name).join(gone, name, "left_anti").distinct(), "jaccard-twice")
    if twice.limit(1).count():
        twice = known(twice)
        once = kept.join(twice, name, "left_semi").dropDuplicates(docs.columns)
        kept = kept.join(twice, name, "left_anti").unionByName(once)
    return kept.drop(name, more)
