"""Phrases of words that occur together more often than their parts would, mined level by level.

A pass over the texts counts two levels, phrases of j + 1 and j + 2 words. It sends every task the frequent phrases
of j words and emits a phrase only if all of its parts of j words, which overlap, are among them (Apriori). Then each
frequent phrase is scored at each place where it can be cut in two, from the tables of the levels.

What is sent is a set of hashes of at most MOST phrases, or, where there are more, a bitmap of fixed size.
Either may let some phrase through that is not frequent; counts are of the words themselves, so results don't change.

Most pairs of frequent words are rare. So a pass counts hashes of the pairs first, packed by range; the next one counts
the words of the pairs whose hash is frequent, and of the phrases of three words made of such pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import set_aside, shuffle_partitions, stage, unstage
from tallow.llm.spans import Spans, spans
from tallow.llm.wordhash import hashes, mix

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
LEAST, LONGEST, TOP, DROP = 100, 5, 2000, 100
MOST = 1 << 22  # hashes sent as they are: 32 MB
BITS, SLICE = 29, 19  # beyond that, a bitmap of 2^BITS bits (64 MB), put together by slices of 2^SLICE bits
NEAR = 24  # lowest bits of hashes that are looked up first, at most
HELD = 48_000_000  # bytes of phrases, with their langs and counts, that a task counts before it hands them on
ROWS = 100_000  # of a batch of phrases
PACKED = 1_000_000  # hashes that a task counts before it hands them on
KEY = 40  # bits of a packed hash
SLICES = 65_536  # ranges of packed hashes at most
SALTS = 64
LANGS = 65_536
_STEP = np.uint64(0xD6E8FEB86659FD93)
COUNTS = "lang string, phrase string, c long"


def _by_level(w: Spans, lang: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Hash of the phrase of 1, 2, ... k words that starts at each word (wrong where the text ends before)."""
    word = hashes(w.words)[w.id]
    h = lang[w.row]
    for j in range(k):
        h = h[: len(word) - j]
        h = mix(h * _STEP + word[j:])
        yield h


class Known:
    """A set of hashes, each without its lowest `shift` bits: sorted, or a bitmap of the lowest bits of what is left."""

    def __init__(self, hashes: np.ndarray | None = None, bitmap: np.ndarray | None = None, shift: int = 0) -> None:
        self.hashes, self.bitmap, self.shift = hashes, bitmap, np.uint64(shift)
        self.near: np.ndarray | None = None  # which lowest bits the hashes have, made where it is asked: most words are not among them

    def has(self, h: np.ndarray) -> np.ndarray:
        h = h >> self.shift
        if self.bitmap is not None:
            at = h & np.uint64(8 * len(self.bitmap) - 1)
            return (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        if self.near is None:
            self.near = np.zeros(1 << min(NEAR, max(16, len(self.hashes).bit_length() + 3)), bool)
            self.near[self._low(self.hashes)] = True
        found = self.near[self._low(h)]
        at = np.flatnonzero(found)
        found[at] = self.hashes[np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)] == h[at]
        return found

    def _low(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.near) - 1)).view(np.int64)


def _langs(col: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Number of each row's lang, the langs and their hashes."""
    coded = col.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), mix(hashes(coded.dictionary) + np.uint64(1))


def known_phrases(level: DataFrame, n: int, most: int = MOST) -> Known:
    """The n phrases of a level's table as a set for broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, _, lang_hash = _langs(b.column(0))
            for w in spans(b.column(1)):
                last = np.flatnonzero(np.append(w.row[1:] != w.row[:-1], True))
                first = np.append(0, last[:-1] + 1)
                out = np.zeros(len(last), np.uint64)
                for j, h in enumerate(_by_level(w, lang_hash[code], int((last - first).max(initial=-1)) + 1)):
                    own = last - first == j
                    out[own] = h[first[own]]
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    return known_hashes(level.select("lang", "phrase").mapInArrow(run, "h long"), n, most)


def known_hashes(rows: DataFrame, n: int, most: int, shift: int = 0) -> Known:
    """The n rows (hashes h) as a set for broadcast."""
    if n <= most:
        found = rows.toArrow().column(0).to_numpy()  # `most` at most
        return Known(np.unique(found.astype(np.int64).view(np.uint64)), shift=shift)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << SLICE, bool)
        bits[pdf["at"].to_numpy(np.int64)] = True
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    at = F.col("h").bitwiseAND((1 << BITS) - 1)
    places = rows.select(F.shiftright(at, SLICE).alias("slice"), at.bitwiseAND((1 << SLICE) - 1).alias("at")).distinct()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for s in places.groupBy("slice").applyInPandas(fill, "slice long, bits binary").toLocalIterator():  # 2^(BITS - SLICE) slices of 64 kB
        bitmap[s["slice"] << (SLICE - 3) : (s["slice"] + 1) << (SLICE - 3)] = np.frombuffer(s["bits"], np.uint8)
    return Known(bitmap=bitmap, shift=shift)


def _sum(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=counts).astype(np.int64)


def _places(w: Spans, parts: np.ndarray, j: int, ks: Iterable[int], known: Known) -> Iterator[np.ndarray]:
    """For each k of ks, the words at which a phrase of k words starts whose parts of j words are all in `known`; `parts` are the hashes of the parts."""
    m = len(w.id) - j + 1
    part = known.has(parts[:m])
    for i in range(1, j):
        part &= w.joined[i : i + m]
    for k in ks:
        m = max(len(w.id) - k + 1, 0)
        fits = part[:m].copy()
        for i in range(1, k - j + 1):
            fits &= part[i : i + m]
            if j == 1:
                fits &= w.joined[i : i + m]
        yield np.flatnonzero(fits)


def frequent_hashes(texts: DataFrame, k: int, shorter: Known, least: int, slices: int) -> DataFrame:
    """Hashes (h, KEY bits) of phrases of k words of texts whose parts are in `shorter`, that occur `least` times or more. Phrases of one hash count together."""
    shared = texts.sparkSession.sparkContext.broadcast(shorter)
    shift = np.uint64(64 - KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        pack = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            keys, counts = held.pop()
            own = (keys * np.uint64(slices)) >> np.uint64(KEY)
            name, first = np.unique(own, return_index=True)
            rows = [(np.diff(x, prepend=np.uint64(0)), y) for x, y in zip(np.split(keys, first[1:]), np.split(counts, first[1:]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(name.astype(np.int32)), *[pa.array([pack.compress(r[i].astype(t).tobytes()) for r in rows], pa.binary()) for i, t in ((0, "<u8"), (1, "<u4"))]], names=["slice", "keys", "counts"])

        for b in batches:
            code, _, lang_hash = _langs(b.column(0))
            for w in spans(b.column(1), lower=True, breaks=BREAKS):
                if len(w.id) < k:
                    continue
                *_, part, h = _by_level(w, lang_hash[code], k)
                (at,) = _places(w, part, k - 1, [k], shared.value)
                held.append(np.unique(h[at] >> shift, return_counts=True))
                size += len(held[-1][0])
                if size > PACKED:
                    held[:] = [_sum(held)]
                    size = len(held[0][0])
                    if size > PACKED // 2:
                        yield flush()
                        size = 0
        if held:
            held[:] = [_sum(held)]
            if len(held[0][0]):
                yield flush()

    def total(key: tuple, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        held, size, unpack = [], 0, zstandard.ZstdDecompressor()
        for pdf in rows if not isinstance(rows, pd.DataFrame) else [rows]:
            for x, y in zip(pdf["keys"], pdf["counts"], strict=True):
                held.append((np.cumsum(np.frombuffer(unpack.decompress(x), "<u8"), dtype=np.uint64), np.frombuffer(unpack.decompress(y), "<u4")))
                size += len(held[-1][0])
                if size > 2 * PACKED:
                    held = [_sum(held)]
                    size = len(held[0][0])
        keys, counts = _sum(held)
        return pd.DataFrame({"h": keys[counts >= least].astype(np.int64)})

    return texts.mapInArrow(run, "slice int, keys binary, counts binary").groupBy("slice").applyInPandas(total, "h long")


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First place and count of every distinct row of the columns, whose entries are below their sizes."""
    key, size = columns[0], sizes[0]
    for c, n in zip(columns[1:], sizes[1:], strict=True):
        if size * n >= 1 << 62:
            key, known = pd.factorize(key)
            size = len(known)
        key, size = key * n + c, size * n
    code, known = pd.factorize(key)
    first = np.zeros(len(known), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first, np.bincount(code, minlength=len(known))


def level_counts(texts: DataFrame, ks: Iterable[int], j: int = 0, known: Known | None = None) -> DataFrame:
    """Counts of the phrases of k words of texts (lang, text), k of ks, whose parts of j words are all in `known`, if given.

    Without it, there is also a row without a phrase for each lang, which counts its words.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.Table:
            done = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("c", "sum")])
            held.clear()
            return done.select(["lang", "phrase", "c_sum"]).rename_columns(["lang", "phrase", "c"])

        for b in batches:
            code, langs, lang_hash = _langs(b.column(0))
            langs = pa.array(langs, pa.string())
            for w in spans(b.column(1), lower=True, breaks=BREAKS):
                lang, places = code[w.row], [np.arange(len(w.id))]
                if j and len(w.id) >= j:
                    *_, part = _by_level(w, lang_hash[code], j)
                    places = _places(w, part, j, ks, shared.value)
                found = []
                for k, at in zip(ks, places, strict=False):  # fewer words than j are no place
                    if len(at):
                        first, counts = _distinct([lang[at], *[w.id[at + i] for i in range(k)]], [len(langs), *[len(w.words)] * k])
                        parts = [w.words.take(pa.array(w.id[at[first] + i])) for i in range(k)]
                        found.append((lang[at[first]], (parts[0] if k == 1 else pc.binary_join_element_wise(*parts, b" ")).cast(pa.string()), counts))
                if not j:
                    found.append((np.arange(len(langs)), pa.nulls(len(langs), pa.string()), np.bincount(lang, minlength=len(langs))))
                held += [pa.table({"lang": langs.take(pa.array(x)), "phrase": y, "c": pa.array(z, pa.int64())}) for x, y, z in found]
                size += sum(x.nbytes for x in held[len(held) - len(found) :])
                if size > HELD:
                    held[:] = [flush()]
                    size = held[0].nbytes
                    if size > HELD // 2:
                        yield from held.pop().to_batches(ROWS)
                        size = 0
        if held:
            yield from flush().to_batches(ROWS)

    return texts.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("c").alias("f"))


def mine_collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, drop: int = DROP, most: int = MOST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first `top` phrases of 2 to `longest` words, by score, a, then phrase.

    A phrase of `least` occurrences or more is a candidate; its score is the least over its cuts of floor(1000 a n / (l r)), ties to the
    first cut. Candidates inside a longer candidate with drop * f(longer) >= 100 * a go. Null langs are `und`, null texts empty; rows
    without an id or with the same one count each. A table without frequent phrases gives no rows. Other columns are not read.
    """
    d, names = set_aside(docs)
    texts = d.select(F.coalesce(F.col(names[lang_col]).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(names[text_col]), F.lit("")).alias("text"))
    words = stage(level_counts(texts, [1]).where((F.col("f") >= least) | F.col("phrase").isNull()), "phrases-1")
    totals, last = words.where("phrase IS NULL").select("lang", F.col("f").alias("n")), words.where("phrase IS NOT NULL")
    levels, k = [last], 1
    while k < longest and (n := last.count()):
        known, j, ks = known_phrases(last, n, most), k, range(k + 1, min(k + 2, longest) + 1)
        if k == 1:
            slices = int(min(SLICES, max(shuffle_partitions(docs.sparkSession), totals.agg(F.sum("n")).first()[0] // PACKED)))
            pairs = stage(frequent_hashes(texts, 2, known, least, slices), "phrases-pairs")
            known, j = known_hashes(pairs, pairs.count(), most, 64 - KEY), 2
            unstage(pairs)
        levels.append(stage(level_counts(texts, ks, j, known).where(F.col("f") >= least), f"phrases-{ks[-1]}"))
        k = ks[-1]
        last = levels[-1].where(F.size(F.split("phrase", " ")) == k)
    out = stage(_scored(levels, totals, top, drop), "phrases-scored")
    for x in (words, *levels[1:]):
        unstage(x)
    return out


def _scored(levels: list[DataFrame], totals: DataFrame, top: int, drop: int) -> DataFrame:
    table = levels[0]
    for x in levels[1:]:
        table = table.unionByName(x)
    # A longer phrase is at most as frequent as what lies between it and the candidate, so one word more is enough to look at.
    size = F.size(F.split("phrase", " "))
    sized = table.withColumn("k", size)
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)")))
    longer = sized.where("k > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    candidates = sized.where("k > 1").join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.lit(drop) * F.col("over") < 100 * F.col("f")))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest"))
    part = lambda name, f: table.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    n_langs = totals.count()
    cuts = cuts.join(F.broadcast(totals) if n_langs <= LANGS else totals, "lang")
    # Products reach 10^30 at 10^13 words: 38 digits hold them.
    cuts = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(38, 0)) * n * 1000) div (CAST(l AS DECIMAL(38, 0)) * r)"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    best = best.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
