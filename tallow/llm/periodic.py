"""Runs of words that repeat with a period, found by harmonic grid probing.

A run of period p and length 2p or more has a multiple of p, jp, for which the words jp and (j + 1)p
lie in it: so for every p only the grid points jp are tested, n/p of them, n log n in all. Points whose
two words are equal are extended both ways by comparing growing chunks of the text with the text p
further on. Points inside a found run whose period divides p are skipped: they would give that run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallow.llm.common import WORD, set_aside
from tallow.llm.spans import spans

LEAST = 12
SLAB = 1 << 15  # grid points tested at once
NEAR = 8  # words compared on either side for all points of a slab at once
RUN = StructType([StructField(x, LongType()) for x in ("start", "length", "period")])
NEW = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (jp, p) with 2p <= n and (j + 1)p < n, p ascending, SLAB at a time."""
    period = np.arange(1, n // 2 + 1)
    upto = np.cumsum((n - 1) // period)
    total = int(upto[-1]) if len(upto) else 0
    for lo in range(0, total, SLAB):
        hi = min(lo + SLAB, total)
        a, b = np.searchsorted(upto, lo, "right"), np.searchsorted(upto, hi - 1, "right") + 1
        before = np.concatenate(([upto[a - 1] if a else 0], upto[a : b - 1]))
        counts = np.minimum(upto[a:b], hi) - np.maximum(before, lo)
        p = np.repeat(period[a:b], counts)
        yield (np.arange(lo, hi) - np.repeat(before, counts)) * p, p


def _reach(x: np.ndarray, i: int, p: int, step: int) -> int:
    """How many words from i on (step 1) or back from i (step -1) equal the word p further on, in chunks that grow."""
    limit, done, chunk = (len(x) - p - i) if step > 0 else i + 1, 0, 16
    while done < limit:
        c = min(chunk, limit - done)
        lo = i + done if step > 0 else i - done - c + 1
        same = x[lo : lo + c] == x[lo + p : lo + p + c]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done, chunk = done + c, min(chunk * 2, 1 << 16)
    return limit


def _worth(x: np.ndarray, i: np.ndarray, p: np.ndarray, least: int) -> np.ndarray:
    """Points whose stretch of equal words may be long enough, by NEAR words on either side."""
    n, far = len(x), np.arange(1, NEAR + 1)
    total, full = np.ones(len(i), np.int64), np.zeros(len(i), bool)
    for side in (far, -far):
        at = i[:, None] + side
        same = (at >= 0) & (at + p[:, None] < n)
        at = np.clip(at, 0, n - 1)
        same &= x[at] == x[np.minimum(at + p[:, None], n - 1)]
        run = np.where(same.all(axis=1), NEAR, np.argmin(same, axis=1))
        full |= run == NEAR
        total += run
    return full | (total >= np.maximum(p, least - p))


def find_runs(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of x, by start, then period.

    A run is a maximal stretch with smallest period p and at least max(least, 2p) entries.
    """
    n = len(x)
    found: dict[tuple[int, int], int] = {}
    if n < least:
        return []
    # The first found run that covers an entry: its period (0: none) and end.
    own, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    last, reached = 0, 0
    for i, p in grid(n):
        hit = x[i] == x[i + p]
        i, p = i[hit], p[hit]
        inner = (own[i] > 0) & (i + p < end[i])
        inner[inner] = p[inner] % own[i[inner]] == 0
        i, p = i[~inner], p[~inner]
        near = _worth(x, i, p, least)
        for k, q in zip(i[near].tolist(), p[near].tolist(), strict=True):
            if (q == last and k < reached) or (own[k] and q % own[k] == 0 and k + q < end[k]):
                continue
            a, b = k - _reach(x, k, q, -1) + 1, k + _reach(x, k, q, 1)
            last, reached = q, b
            length = b - a + q
            # An interval found before has a smaller period.
            if length >= max(least, 2 * q) and (a, length) not in found:
                found[a, length] = q
                free = own[a : a + length] == 0
                own[a : a + length][free], end[a : a + length][free] = q, a + length
    return sorted((a, length, q) for (a, length), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period alone."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """docs with n_words, runs (start, length and period in words, by start, then period) and collapsed, the text with
    each run's first period alone and one space between words.

    A null text is empty: no words, no runs, collapsed is empty. Texts are searched whole, each on its own, so ties and
    repeated rows give equal results; a table without rows gives none. Other columns pass through; those named like the
    three new ones are replaced. Nothing is shuffled.
    """
    d, names = set_aside(docs)
    keep = [c for c in docs.columns if c not in {f.name for f in NEW}]
    source = d.select(*[names[c] for c in keep], d[names[text_col]].alias("text"))
    schema = StructType([*source.schema.fields[:-1], *NEW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in spans(b.column(b.num_columns - 1)):
                word = np.array([*w.words.to_pylist(), b""], object)
                cuts = np.searchsorted(w.row, np.arange(w.lo, w.hi + 1))
                runs, collapsed = [], []
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    x = w.id[lo:hi]
                    runs.append(find_runs(x, least))
                    collapsed.append(b" ".join(word[x[kept_words(len(x), runs[-1])]].tolist()).decode())
                own = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
                added = [pa.array(np.diff(cuts).astype(np.int64)), pa.array(own, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays([*[c.slice(w.lo, w.hi - w.lo) for c in b.columns[:-1]], *added], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *[f.name for f in NEW])


def with_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which about a tenth of the texts have a tail that repeats, by the crc32 of the id: h = crc32, g = h div 10.

    If h % 10 is 0, the words from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8) words that stand there; words are then
    one space apart. A null id counts as the empty text, null texts and those without words stay.
    """
    d, names = set_aside(docs)
    text = F.col(names[text_col])
    d = d.withColumn("h", F.crc32(F.coalesce(F.col(names[id_col]).cast("string"), F.lit("")).cast("binary")))
    d = d.withColumns({"g": F.expr("h div 10"), "words": F.when((F.col("h") % 10 == 0) & (F.length(text) > 0), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))})
    d = d.withColumn("n", F.when(F.size("words") > 0, F.size("words"))).withColumn("a", F.expr("g % n"))
    d = d.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    edited = F.expr("array_join(transform(words, (w, i) -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return d.withColumn(names[text_col], F.coalesce(edited, text)).select(*names.values()).toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.p")
    return out.select("doc_id", "n_runs", (-F.col("top.s")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * top.length div -top.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

