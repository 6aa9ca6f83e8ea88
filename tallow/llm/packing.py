"""Best-fit packing of token sequences by minimum bin slack.

Texts are tokenised in Arrow batches; only texts longer than a sequence are cut.
The plan of the bins is made from the histogram of piece lengths (at most
`capacity` rows, whatever the corpus): for one bin after another, a bitset
subset-sum finds the fullest combination of the lengths still available, and the
same combination is removed as often as the counts allow. Pieces are then dealt
to the plan by their rank among pieces of their length, a distributed prefix sum.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import arrow_rows, stage

CAPACITY = 4096
END_ID = 1
MEMO_WORDS = 1_000_000  # words remembered by a process, about 140 MB
MEMO_CHARS = 64
MEMO_SIGNS = 10_000
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@[-`{-~]*)")
# The characters by which byte-level models name bytes that are no printable ones of Latin-1.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
PROBES = ("a", "I", "the", "Hello", "don", "transformation", "QUICK", "zzxqj", "x" * 40, "antidisestablishmentarianism", "É", "straße", "ÀÖØÞæñüÿ", "çà", "ÑANDÚ")
SIGNS = ("", ".", ",", ".,", "!!", "###", "$$$", "'", "\"", "|", "*.*", "(`)")
SLICE_ROWS = 256
BATCH_ROWS = 1024
RANGE_ROWS = 512


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian unsigned 32-bit ids; one encoder per process and file.

    The tokenizer drops white space and joins nothing across it, so each word is encoded once and
    remembered, up to MEMO_WORDS words; later ones are encoded anew each time. Letters of Latin-1 go to the
    tokenizer's model directly, and so do signs behind them.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ids_of = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    tokenize = tok.model.tokenize
    signs: dict[str, bytes] = {"": b""}

    of_ascii = lambda w: array("I", [t.id for t in tokenize(w)]).tobytes()

    def of_letters(w: str) -> bytes:
        w = w.lower()
        return of_ascii(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LEVEL))

    # Letters of Latin-1, with ASCII signs behind them, need no normalising where the tokenizer treats these probes so.
    direct = all(ids_of(w + x) == of_letters(w) + ids_of(x) for w in PROBES for x in SIGNS)

    class Memo(dict):
        def __missing__(self, w: str) -> bytes:
            if direct and w.isascii() and w.isalpha():
                x = of_ascii(w.lower())
            elif direct and (parts := PLAIN.fullmatch(w)):
                stem, sign = parts.groups()
                if sign not in signs and len(signs) < MEMO_SIGNS:
                    signs[sign] = ids_of(sign)
                x = (self.get(stem) if sign else None) or of_letters(stem)
                x += signs[sign] if sign in signs else ids_of(sign)
            else:
                x = ids_of(w)
            if len(self) < MEMO_WORDS and len(w) < MEMO_CHARS:
                self[w] = x
            return x

    ids = Memo().__getitem__

    def encode(texts: list[str]) -> list[bytes]:
        # split() also cuts at these four, which the tokenizer takes for symbols
        return [b"".join(map(ids, [t] if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split())) for t in texts]

    _encoders[path] = encode
    return encode


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null or empty text gives one piece, the end id. Texts are tokenised whole, however long; repeated rows and
    null ids give pieces of their own, a table without rows none. Other columns are not read.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in (b.slice(lo, SLICE_ROWS) for b in batches for lo in range(0, b.num_rows, SLICE_ROWS)):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
            cols = list(zip(*out, strict=True)) if out else [()] * (6 if with_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names[: len(cols)])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths (sorted downwards) with the largest sum up to room, by bitset subset-sum.

    Bit s of `reach` says that s can be made. Each step adds a block of copies (1, 2, 4, ...) of one
    length; the search ends as soon as the room can be filled exactly.
    """
    reach, full = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for n in lengths:
        if n > room:
            continue
        left, block = min(counts[n], room // n), 1
        while left > 0:
            block = min(block, left)
            steps.append((reach, n, block))
            reach |= (reach << (n * block)) & full
            left -= block
            block *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for before, n, block in reversed(steps):
        if not before >> total & 1:
            chosen += [n] * block
            total -= n * block
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Minimum bin slack over a histogram of lengths: one row per length of each pattern of bins.

    Each bin takes the largest length left and the fullest combination beside it; the pattern is
    repeated while counts allow. Columns: length, first and last+1 rank among pieces of that length,
    per_bin, bin (number of the pattern's first), offset (of the length's first copy in its bin).
    """
    counts = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(counts, 0)
    rows, at = [], 0
    while counts:
        lengths = sorted(counts, reverse=True)
        top = lengths[0]
        counts[top] -= 1
        rest = fullest([n for n in lengths if counts[n]], counts, capacity - top)
        counts[top] += 1
        pattern: dict[int, int] = {}
        for n in [top, *rest]:
            pattern[n] = pattern.get(n, 0) + 1
        times, offset = min(counts[n] // k for n, k in pattern.items()), 0
        for n, k in pattern.items():
            rows.append((n, used[n], used[n] + k * times, k, at, offset))
            used[n] += k * times
            counts[n] -= k * times
            offset += n * k
            if not counts[n]:
                del counts[n]
        at += times
    return pd.DataFrame(rows, columns=["length", "first", "end", "per_bin", "bin", "offset"]).sort_values(["length", "first"], ignore_index=True)


def _ranked(pieces: DataFrame) -> DataFrame:
    """pieces with _rank from 0 among those of their length. A length may hold any share of all rows: it is cut into hash ranges, counted, and ranked within."""
    rows = pieces.count()
    ranges = max(1, -(-rows // RANGE_ROWS))
    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    p = pieces.withColumns({"_hash": h, "_range": F.pmod(h, F.lit(ranges))})
    sizes = p.groupBy("length", "_range").agg(F.count(F.lit(1)).alias("_n"))
    # Ranges of a length are summed in two levels, so that no window holds more than about the root of their number.
    root = max(1, int(ranges**0.5))
    sizes = sizes.withColumn("_super", F.floor(F.col("_range") / root))
    inner = Window.partitionBy("length", "_super").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("length").orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = sizes.groupBy("length", "_super").agg(F.sum("_n").alias("_sn")).withColumn("_sbefore", F.coalesce(F.sum("_sn").over(outer), F.lit(0)))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(supers.drop("_sn"), ["length", "_super"])
    starts = starts.select("length", "_range", (F.col("_before") + F.col("_sbefore")).alias("_start"))
    within = Window.partitionBy("length", "_range").orderBy("_hash", "doc_id", "piece", "ids_crc32")
    p = p.withColumn("_in", F.row_number().over(within) - 1)
    return p.join(starts, ["length", "_range"]).withColumn("_rank", F.col("_in") + F.col("_start"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. Equal rows are pieces of their own. An empty table gives an empty result."""
    with arrow_rows(pieces.sparkSession, BATCH_ROWS):
        pieces = stage(pieces, "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_bins(histogram, capacity)
    names = pieces.columns
    keys = plan["length"].to_numpy(np.int64), plan["first"].to_numpy(np.int64)
    first_of = {int(n): i for i, n in reversed(list(enumerate(keys[0])))}
    last_of = {int(n): i + 1 for i, n in enumerate(keys[0])}
    start, per_bin, bins, offset = (plan[c].to_numpy(np.int64) for c in ("first", "per_bin", "bin", "offset"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(np.int64), pdf["_rank"].to_numpy(np.int64)
            at = np.zeros(len(pdf), np.int64)
            for v in np.unique(n):
                lo, hi, own = first_of[int(v)], last_of[int(v)], n == v
                at[own] = lo + np.searchsorted(start[lo:hi], rank[own], "right") - 1
            t = rank - start[at] if len(pdf) else rank
            out = pdf[names].copy()
            out["sequence_id"] = bins[at] + t // per_bin[at]
            out["offset"] = offset[at] + t % per_bin[at] * n
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return _ranked(pieces).select(*names, "_rank").mapInPandas(deal, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, **columns) -> DataFrame:
    """The pieces of docs (see tokenize_pieces) with sequence_id and offset (see pack)."""
    return pack(tokenize_pieces(docs, path or tokenizer_path(), capacity, **columns), capacity)
