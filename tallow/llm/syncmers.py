"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its inner s-mers
lies at its first or last place. The choice looks at the k-mer alone, so an edit
moves no anchor outside the k-mers it touches. A fingerprint is the anchors' codes
in text order; two are matched by position: by the longest chain of common anchors
that stand in the same order in both.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallow.llm.common import shuffle_partitions
from tallow.llm.wordhash import mix

K, S = 32, 8
# Short texts have few long k-mers: below so many code points they have anchors of smaller ones as well. (k, s, code points)
SHORT = ((8, 2, 192), (4, 1, 48))
CHUNK_CHARS = 1 << 18
BUCKET_ROWS = 4096
MAX_BUCKETS = 65_536
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes (uint32) and positions of each text's anchors. k and s are multiples of s, a power of two.

    A text shorter than k has one anchor, its whole; one without a syncmer has its smallest k-mer;
    an empty text has none.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= CHUNK_CHARS):
            total += len(texts[hi])
            hi += 1
        out += _anchors_of_chunk(texts[lo:hi], k, s)
        lo = hi
    return out


def _anchors_of_chunk(texts: list[str], k: int, s: int) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n, w = len(x), k - s + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if n >= k:
        h, step = mix(x.astype(np.uint64) + _M[0]), 1
        while step < s:
            h = h[: len(h) - step] * _M[step % 3] + (h[step:] ^ (h[step:] >> np.uint64(29)))
            step *= 2
        h = mix(h)
        low, span = h, 1
        while span * 2 <= w:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        m = n - k + 1
        low = np.minimum(low[:m], low[w - span : w - span + m])
        picked = np.flatnonzero((h[:m] == low) | (h[w - 1 : w - 1 + m] == low))
        doc = np.searchsorted(at, picked, "right") - 1
        inside = picked + k <= at[doc + 1]
        picked, doc = picked[inside], doc[inside]
        codes = _codes(h, picked, k, s)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, t in enumerate(texts):
        if sizes[i] < k:
            code = np.frombuffer(hashlib.blake2b(t.encode(), digest_size=4).digest(), "<u4") if t else np.zeros(0, np.uint32)
            found.append((code, np.zeros(len(code), np.int64)))
        elif cuts[i] == cuts[i + 1]:
            every = np.arange(at[i], at[i + 1] - k + 1)
            c = _codes(h, every, k, s)
            j = int(np.argmin(c))
            found.append((c[j : j + 1], np.array([j])))
        else:
            found.append((codes[cuts[i] : cuts[i + 1]], picked[cuts[i] : cuts[i + 1]] - at[i]))
    return found


def _codes(h: np.ndarray, at: np.ndarray, k: int, s: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for j in range(k // s):
        total = (total ^ h[at + j * s]) * _M[j % len(_M)]
    return (mix(total) >> np.uint64(32)).astype(np.uint32)


Fingerprint = tuple[np.ndarray, ...]  # codes in text order by level: K, then those of SHORT that the text's length asks for


def fingerprints(texts: list[str], k: int = K, s: int = S) -> list[Fingerprint]:
    out = [(codes,) for codes, _ in anchors(texts, k, s)]
    for small_k, small_s, below in SHORT:
        short = [i for i, t in enumerate(texts) if len(t) < below]
        for i, (codes, _) in zip(short, anchors([texts[i] for i in short], small_k, small_s), strict=True):
            out[i] += (codes,)
    return out


def to_string(fingerprint: Fingerprint) -> str:
    """24 bits of each code in base64 (four letters an anchor), levels apart by a full stop."""
    return ".".join(base64.urlsafe_b64encode(c.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()).decode() for c in fingerprint)


def longest_chain(at: np.ndarray) -> int:
    """Length of the longest increasing run of entries, others left out."""
    if len(at) < 2 or (at[1:] > at[:-1]).all():
        return len(at)
    tails: list[int] = []
    for x in at.tolist():
        spot = bisect_left(tails, x)
        tails[spot : spot + 1] = [x]
    return len(tails)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Anchors on the longest common chain over all anchors of either, 0 to 1, on the finest level that both have; two empty texts are alike.

    A code that stands several times counts where it stands first.
    """
    x, y = list(zip(a, b, strict=False))[-1]
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if len(x) == len(y) and (x == y).all():
        return 1.0
    (cx, ix), (cy, iy) = np.unique(x, return_index=True), np.unique(y, return_index=True)
    _, jx, jy = np.intersect1d(cx, cy, assume_unique=True, return_indices=True)
    chain = longest_chain(iy[jy][np.argsort(ix[jx])])
    return chain / (len(cx) + len(cy) - chain)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with fingerprint (string) and anchor_positions (array of code-point offsets of the K anchors).

    Null texts count as empty and have neither; long texts are taken whole. Repeated rows give repeated rows, a table without
    rows none. Other columns pass through; those named like the two new ones are replaced.
    """
    keep = [c for c in docs.columns if c not in ("fingerprint", "anchor_positions")]
    schema = StructType([*docs.select(*keep).schema.fields, StructField("fingerprint", StringType()), StructField("anchor_positions", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            cols = [*b.columns, pa.array(map(to_string, fingerprints(texts, k, s)), pa.string()), pa.array([p.astype(np.int32) for _, p in anchors(texts, k, s)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*keep).mapInArrow(run, schema)


def compare_neighbours(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next text by descending doc_id (columns of SCHEMA).

    Rows go to ranges of doc_id and are sorted there; each range ends with a copy of the first row of
    the next one, so each text is read, shuffled and fingerprinted once. Null ids come last; equal ids
    (as of repeated rows) are ordered by text, downwards. A single document is its own next one. Null texts are
    empty ones; long texts are taken whole. A table without rows gives none. Other columns are not read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, filled = d.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    wanted = min(MAX_BUCKETS, max(-(-rows // BUCKET_ROWS), 8 * shuffle_partitions(docs.sparkSession)))
    cuts = np.zeros(0, np.int64)
    if filled:
        shares = F.array(*[F.lit(i / wanted) for i in range(1, wanted)]) if wanted > 1 else F.array(F.lit(0.5))
        got = d.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 10 * wanted))).alias("c")).first()["c"]
        cuts = np.unique(np.array(got, np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(cuts) + 1, np.int32)
        out[known] = len(cuts) - np.searchsorted(cuts, ids[known].to_numpy(np.int64), "right")
        return pd.Series(out)

    heads = d.select("doc_id").withColumn("b", bucket("doc_id")).groupBy("b").agg(F.max("doc_id").alias("head")).orderBy("b").collect()
    spark = docs.sparkSession
    follows = [(heads[(i + 1) % len(heads)]["head"], heads[i]["b"]) for i in range(len(heads))]
    to = F.broadcast(spark.createDataFrame([x for x in follows if x[0] is not None], "head long, bucket int"))  # one row per range: MAX_BUCKETS at most
    tails = d.join(to, d["doc_id"] == to["head"]).select("bucket", F.lit(1).alias("tail"), "doc_id", "text")
    for head, b in follows:
        if head is None:
            tails = tails.unionByName(d.where("doc_id is null").agg(F.max("text").alias("text")).select(F.lit(b).alias("bucket"), F.lit(1).alias("tail"), F.lit(None).cast("long").alias("doc_id"), "text"))
    body = d.select(bucket("doc_id").alias("bucket"), F.lit(0).alias("tail"), "doc_id", "text")
    ordered = body.unionByName(tails).repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            texts = batch.column(3).to_pylist()
            rows = held + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, fingerprints(texts, k, s), strict=True))
            held = rows[-1:]
            yield from _compared(rows, k, s)

    return ordered.mapInArrow(run, SCHEMA)


def _compared(rows: list[tuple], k: int, s: int) -> Iterator[pa.RecordBatch]:
    pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
    for lo in range(0, len(pairs), 1000):
        part = pairs[lo : lo + 1000]
        edited = [a[3][: len(a[3]) - len(a[3]) // 3] + b[3][: len(a[3]) // 3] for a, b in part]
        codes = fingerprints(edited, k, s)
        cols = [
            pa.array([a[2] for a, _ in part], pa.int64()),
            pa.array([len(a[3]) for a, _ in part], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([to_string(a[4]) for a, _ in part], pa.string()),
            pa.array([to_string(c) for c in codes], pa.string()),
            pa.array([likeness(a[4], c) for (a, _), c in zip(part, codes, strict=True)], pa.float64()),
            pa.array([likeness(a[4], b[4]) for a, b in part], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
