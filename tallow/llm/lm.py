"""Log-bilinear language model trained with noise-contrastive estimation.

Tokens are words and one end per text. The most frequent words, whose number grows with the
cube root of the training tokens, are classes of their own; any other word belongs to the class
of its last two bytes, and is drawn there by its smoothed count. A context of the last word and
the one before gives the next class: P = sum over d of W[d] softmax(r_d,u . q_w + b_w), u being
the class d places back. What is learnt from are the counts of class pairs at both distances over
the whole corpus, a table that grows with it. Rows of contexts are dealt to tasks; in a round each
task takes some Adam steps on its rows, and the class vectors are averaged by the tokens behind
them. Batched matrix products normalise the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import most_frequent, stage, unstage
from tallow.llm.wordhash import Words, words

SUFFIXES = 256
KNOWN = 1 << 16  # most frequent words whose counts are sent to every task; the rest are joined
WEIGHTS = (0.55, 0.45)  # of the contexts one and two places back
DIM = 32
NOISE = 64
ROUNDS, STEPS = 16, 12
ROWS = 256  # context rows of a task, about
HELD = 2_000_000
SLICE = 512  # class vectors that are summed in one group
END_HASH = np.uint64(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def own_classes(tokens: int) -> int:
    """How many words are classes of their own."""
    return 512 + int(2 * tokens ** (1 / 3))


def suffix_class(w: Words) -> np.ndarray:
    a = _LOWER[w.data[w.end - 1]].astype(np.uint32)
    b = np.where(w.end - w.start > 1, _LOWER[w.data[np.maximum(w.end - 2, 0)]], 0).astype(np.uint32)
    return (((a * np.uint32(257) + b) * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64) % SUFFIXES


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2, F.lit(False))


def token_counts(train: DataFrame, text_col: str) -> DataFrame:
    """Counts of all tokens of train: token, suffix, c. Each batch of rows counts its own tokens first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = list(words(b.column(0)))
            h = np.concatenate([w.hash for w in parts]) if parts else np.zeros(0, np.uint64)
            s = np.concatenate([suffix_class(w) for w in parts]) if parts else np.zeros(0, np.int64)
            token, at, n = np.unique(h, return_index=True, return_counts=True)
            token, suffix, n = np.append(token, END_HASH), np.append(s[at], -1), np.append(n, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(suffix.astype(np.int32)), pa.array(n.astype(np.int64))], names=["token", "suffix", "c"])

    return train.select(text_col).mapInArrow(run, "token long, suffix int, c long").groupBy("token").agg(F.min("suffix").alias("suffix"), F.sum("c").alias("c"))


class Vocabulary:
    """The KNOWN most frequent words, sorted by hash, with counts and classes (`head` of them their own), and the sizes of the suffix classes.

    Classes: own words by rank, then suffixes, then the end; as a context, `classes` is the start of a text.
    """

    def __init__(self, counts: DataFrame) -> None:
        total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.n, self.v = int(total[0] or 0), int(total[1])
        self.head = own_classes(self.n)
        self.end, self.classes = self.head + SUFFIXES, self.head + SUFFIXES + 1
        end = counts.where("suffix = -1").select("c").first()
        self.end_count = int(end[0]) if end else 0
        known = most_frequent(counts.where("suffix >= 0"), "c", max(KNOWN, self.head)).toPandas()  # KNOWN rows, or as many as there are own classes, at most
        known = known.sort_values(["c", "token"], ascending=[False, True], ignore_index=True)
        rank = np.arange(len(known))
        cls = np.where(rank < self.head, rank, self.head + known["suffix"].to_numpy(np.int64))
        token = known["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(token)
        self.token, self.count, self.cls = token[order], known["c"].to_numpy(np.int64)[order], cls[order]
        by = counts.where("suffix >= 0").groupBy("suffix").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()
        mass = np.ones(SUFFIXES)
        mass[by["suffix"].to_numpy(np.int64)] += (by["c"] + by["v"]).to_numpy(np.float64)
        own = known.head(self.head)
        np.subtract.at(mass, own["suffix"].to_numpy(np.int64), own["c"].to_numpy(np.float64) + 1)
        self.log_mass = np.log10(np.maximum(mass, 1.0))

    def look(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, count and whether it is known, of each word."""
        suffix = self.head + suffix_class(w)
        if not len(self.token):
            return suffix, np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), bool)
        at = np.minimum(np.searchsorted(self.token, w.hash), len(self.token) - 1)
        known = self.token[at] == w.hash
        return np.where(known, self.cls[at], suffix), np.where(known, self.count[at], 0), known

    def chains(self, w: Words, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context classes one and two places back, next class and text of every token of a chunk."""
        n = np.bincount(w.row - w.lo, minlength=w.hi - w.lo)
        ends = np.cumsum(n + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        nxt = np.full(len(cls) + len(n), self.end)
        inner = np.ones(len(nxt), bool)
        inner[ends] = False
        nxt[inner] = cls
        one = np.concatenate(([self.classes], nxt[:-1]))
        one[starts] = self.classes
        two = np.concatenate(([self.classes], one[:-1]))
        two[starts] = self.classes
        return one, two, nxt, np.repeat(np.arange(w.lo, w.hi), n + 1)


PAIRS = "part int, salt int, keys binary, counts binary"
SALTS = 16


def pair_counts(train: DataFrame, vocabulary: Vocabulary, text_col: str) -> DataFrame:
    """Counts of class pairs (context at either distance, next class) of all of train, staged: one row per part of the contexts.

    A pair's key is (distance * (classes + 1) + context) * classes + next. Tasks sum what they see and pack
    keys and counts by part, so a shuffled row holds many pairs; a part is contexts of all frequencies.
    """
    parts = -(-2 * (vocabulary.classes + 1) // ROWS)
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def pack(part: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        salt = TaskContext.get().partitionId() % SALTS
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([salt], pa.int32()), *[pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (keys, n)]], names=["part", "salt", "keys", "counts"])

    def add(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, weights=n).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = add(held)
            part = keys // voc.classes % parts
            for i in range(parts):
                if (own := part == i).any():
                    yield pack(i, keys[own], n[own])
            held.clear()

        for b in batches:
            for w in words(b.column(0)):
                one, two, nxt, _ = voc.chains(w, voc.look(w)[0])
                keys, n = np.unique(np.concatenate((one, two + voc.classes + 1)) * voc.classes + np.concatenate((nxt, nxt)), return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size > HELD:
                    held[:] = [add(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    def total(key: tuple, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        held = None
        for pdf in rows if not isinstance(rows, pd.DataFrame) else [rows]:
            for k, n in zip(pdf["keys"], pdf["counts"], strict=True):
                one = (np.frombuffer(k, "<i8"), np.frombuffer(n, "<i8"))
                held = one if held is None else add([held, one])
        return pd.DataFrame({"part": [key[0]], "salt": [0], "keys": [held[0].astype("<i8").tobytes()], "counts": [held[1].astype("<i8").tobytes()]})

    # What all tasks saw of a part meets in two steps, so that no task reads it all.
    sums = train.select(text_col).mapInArrow(run, PAIRS).groupBy("part", "salt").applyInPandas(total, PAIRS)
    return stage(sums.groupBy("part").applyInPandas(total, PAIRS), "lm-pairs")


class LogBilinear:
    """s(u, w) = r_u . q_w + b_w; the rows of r are contexts, those of q next classes."""

    def __init__(self, contexts: int, freq: np.ndarray, dim: int = DIM, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.freq = freq
        self.r = rng.normal(0, 0.1, (contexts, dim))
        self.q = rng.normal(0, 0.1, (len(freq), dim))
        self.b = np.log(freq)

    def fit(self, rows: np.ndarray, pairs: np.ndarray, steps: int, rate: float, noise: int = NOISE) -> list[float]:
        """Noise-contrastive estimation on the contexts `rows`, whose counts of next classes are the rows of pairs: each pair seen is told from `noise` draws by frequency.

        The sums over pairs and draws are taken in full from the counts, so that a step is a few matrix
        products. Adam; returns the loss of each step.
        """
        total = max(pairs.sum(), 1.0)
        seen = pairs / total
        told = noise * seen.sum(axis=1)[:, None] * self.freq[None, :]
        shift = np.log(noise * self.freq)
        r = self.r[rows]
        state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (r, self.q, self.b)]
        losses = []
        for t in range(1, steps + 1):
            z = r @ self.q.T + self.b - shift
            p = 1 / (1 + np.exp(-z))
            losses.append(float(-(seen * np.log(p + 1e-12)).sum() - (told * np.log(1 - p + 1e-12)).sum()))
            g = told * p - seen * (1 - p)
            for (x, m, v), d in zip(state, (g @ self.q, g.T @ r, g.sum(axis=0)), strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
        self.r[rows] = r
        return losses

    def log_sums(self) -> np.ndarray:
        """Logarithm of the sum over next classes for every context, by batched matrix products."""
        out = np.empty(len(self.r))
        for lo in range(0, len(self.r), 128):
            z = self.r[lo : lo + 128] @ self.q.T + self.b
            top = z.max(axis=1)
            out[lo : lo + 128] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        return out


def train_model(pairs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, steps: int = STEPS) -> LogBilinear:
    """The model of both distances: contexts one place back, then two places back.

    A round sends the tasks the model. Each part of the contexts is a task of its own; what the parts make of the class vectors is
    summed by slices on the executors, so a round brings back one model, however many parts there are.
    """
    spark, c = pairs.sparkSession, vocabulary.classes
    freq = np.ones(c)
    freq[vocabulary.cls[vocabulary.cls < vocabulary.head]] += vocabulary.count[vocabulary.cls < vocabulary.head]
    freq[vocabulary.head : vocabulary.end] += 10.0**vocabulary.log_mass
    freq[vocabulary.end] += vocabulary.end_count
    model = LogBilinear(2 * (c + 1), freq / freq.sum())
    parts = max(1, pairs.count())

    for t in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        rate = 0.05 * (1 - t / rounds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, keys, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    keys, n = np.frombuffer(keys, "<i8"), np.frombuffer(n, "<i8")
                    own = LogBilinear.__new__(LogBilinear)
                    own.__dict__.update({k: x.copy() for k, x in shared.value.__dict__.items()})
                    rows, at = np.unique(keys // c, return_inverse=True)
                    counts = np.zeros((len(rows), c))
                    counts[at, keys % c] = n
                    own.fit(rows, counts, steps, rate)
                    weight = float(n.sum())
                    # Keys below 0: a part's contexts; else slices of the class vectors, times the tokens behind them.
                    vectors = weight * np.column_stack((own.q, own.b))
                    told = [(-1 - part, np.column_stack((rows, own.r[rows])))] + [(i, vectors[lo : lo + SLICE]) for i, lo in enumerate(range(0, c, SLICE))]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in told]), pa.array([part] * len(told), pa.int32()), pa.array([weight] * len(told)), pa.array([x.tobytes() for _, x in told], pa.binary())], names=["key", "part", "weight", "x"])

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            x = sum(np.frombuffer(y) for y in pdf["x"])
            return pd.DataFrame({"key": [pdf["key"].iloc[0]], "weight": [pdf["weight"].sum()], "x": [x.tobytes()]})

        told = pairs.repartition(parts).mapInArrow(run, "key long, part int, weight double, x binary")
        vectors = {}
        for x in told.groupBy("key").applyInPandas(total, "key long, weight double, x binary").collect():  # of the size of the model
            if x["key"] < 0:
                rows = np.frombuffer(x["x"]).reshape(-1, 1 + DIM)
                model.r[rows[:, 0].astype(np.int64)] = rows[:, 1:]
            else:
                vectors[x["key"]] = np.frombuffer(x["x"]).reshape(-1, DIM + 1) / x["weight"]
        if vectors:
            all_rows = np.concatenate([vectors[i] for i in sorted(vectors)])
            model.q, model.b = all_rows[:, :DIM].copy(), all_rows[:, DIM].copy()
        shared.unpersist()
    return model


PARTS = "id long, held boolean, n_tokens long, n_known long, base double, own double, tail array<long>, times array<int>"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from the rows that are not held out.

    A null text is empty: its one token is the end. A null id counts as the empty text for the fold.
    Without training rows (as in an empty table) every count is 0. Repeated rows are scored each, long texts whole.
    Words of equal counts at the edge of the vocabulary go by their hash. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    train = d.where(~F.col("held"))
    counts = stage(token_counts(train, "text"), "lm-counts")
    vocabulary = Vocabulary(counts)
    pairs = pair_counts(train, vocabulary, "text")
    model = train_model(pairs, vocabulary)
    unstage(pairs)
    parts = model.r.astype(np.float32), model.q.astype(np.float32), model.b, model.log_sums(), np.log(WEIGHTS)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, parts))
    log_all = float(np.log10(vocabulary.n + vocabulary.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, (r, q, bias, log_sum, weight) = shared.value
        for b in batches:
            for w in words(b.column(1)):
                cls, count, known = voc.look(w)
                one, two, nxt, text = voc.chains(w, cls)
                two = two + voc.classes + 1
                rows, row = w.hi - w.lo, w.row - w.lo
                sums = lambda at, x: np.bincount(at, weights=x, minlength=rows)
                to = q[nxt]
                near, far = (np.einsum("ij,ij->i", r[u], to) - log_sum[u] + x for u, x in zip((one, two), weight, strict=True))
                own = sums(text - w.lo, (np.logaddexp(near, far) + bias[nxt]) / np.log(10))
                sub = cls >= voc.head
                own += sums(row[sub], np.where(known[sub], np.log10(count[sub] + 1), 0.0) - voc.log_mass[cls[sub] - voc.head])
                base = sums(row[known], np.log10(count[known] + 1) - log_all) + (np.log10(voc.end_count + 1) - log_all)
                n = np.bincount(row, minlength=rows)
                n_known = np.bincount(row[known], minlength=rows) + (voc.end_count > 0)
                rest = ~known
                tail, at = w.hash[rest], row[rest]
                order = np.lexsort((tail, at))
                tail, at = tail[order], at[order]
                new = np.ones(len(tail), bool)
                new[1:] = (tail[1:] != tail[:-1]) | (at[1:] != at[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(tail)))
                ends = pa.array(np.searchsorted(at[first], np.arange(rows + 1)).astype(np.int32))
                cols = [
                    b.column(0).slice(w.lo, rows),
                    b.column(2).slice(w.lo, rows),
                    pa.array((n + 1).astype(np.int64)),
                    pa.array(n_known.astype(np.int64)),
                    pa.array(base),
                    pa.array(own),
                    pa.ListArray.from_arrays(ends, pa.array(tail[first].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PARTS.split(", ")])

    scored = stage(d.select("id", "text", "held").mapInArrow(run, PARTS).withColumn("uid", F.monotonically_increasing_id()), "lm-parts")
    tails = scored.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("uid", F.col("x.tail").alias("token"), F.col("x.times").alias("times"))
    joined = tails.join(counts.select("token", "c"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    tail_sums = joined.groupBy("uid").agg(F.sum(F.col("times") * F.log10(c + 1)).alias("log_c"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"), F.sum("times").alias("n"))
    out = scored.drop("tail", "times").join(tail_sums, "uid", "left")
    log_c, k, n = (F.coalesce(x, F.lit(0)) for x in ("log_c", "k", "n"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + k).cast("long").alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + log_c - n * F.lit(log_all)).alias("base_score"),
        (F.col("own") + log_c).alias("score"),
    )
