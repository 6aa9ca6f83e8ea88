"""A quality classifier that compresses: Zstandard dictionaries built from good and from bad labelled text.

A text is compressed in pieces with either dictionary. The difference of the two sizes over the text's length says which
kind it is like; their mean over the length says how far it only repeats itself, where the difference is near nothing.
A logistic curve, fitted on labelled rows that no dictionary has seen, makes a score of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import set_aside
from tallow.llm.wordhash import buffers

DICTIONARY_ROWS = 2048  # labelled rows of each class that build its dictionary
CALIBRATION_ROWS = 8192  # labelled rows that fit the curve
SAMPLE_CHARS = 2048  # of a text that builds a dictionary: so much of it, from a place of its own
DICTIONARY_BYTES = 1 << 15
PIECE = 512  # bytes compressed at once, of every text the whole
LEVEL = 3
RIDGE = 1e-3
THRESHOLD = 0.3


def held_out(id_col: str):
    """The fold of an id: crc32 of its text mod 5 is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of samples too few to train on, their text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


class Sizes:
    """Compressed sizes of texts with the dictionaries of the good and the bad."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def figures(self, col: pa.Array) -> np.ndarray:
        """Difference (bad - good) and mean of both sizes over the length in bytes, of each text; 0 and 0 for an empty one."""
        offsets, data = buffers(col)
        out = np.zeros((len(col), 2))
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = data[lo:hi].tobytes()
            good, bad = (sum(len(c.compress(text[at : at + PIECE])) for at in range(0, len(text), PIECE)) for c in self.by)
            out[i] = (bad - good) / max(hi - lo, 1), (bad + good) / 2 / max(hi - lo, 1)
        return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (constant first) of a logistic curve, by Newton's method with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    ridge = RIDGE * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """Dictionaries and curve; without labelled rows of both classes, the smoothed share of good ones for every text."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray) -> None:
        self.good, self.bad, self.weights = good, bad, weights

    def score(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + figures @ self.weights[1:], -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows that a model learns from: id, quality, role (dictionary or curve), text; docs and labels have (id, text) and (id, quality).

    Rows are taken by a hash of the id, three quarters for dictionaries: DICTIONARY_ROWS of each class and CALIBRATION_ROWS of both.
    Labels other than 0 and 1, without a document or held out are no part of it; of documents with one id the least text counts.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.col("id"), F.lit("quality"))
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).select("id", F.col("quality").cast("int").alias("quality")).distinct()
    usable = usable.join(docs.select("id"), "id", "left_semi").select("id", "quality", h.alias("h"))
    role = F.least(F.pmod("h", F.lit(4)), F.lit(1))
    take = lambda rows, n: [(r["id"], r["quality"]) for r in rows.orderBy("h", "id", "quality").limit(n).collect()]
    dictionary = [x for q in (0, 1) for x in take(usable.where((role == 1) & (F.col("quality") == q)), DICTIONARY_ROWS)]
    curve = take(usable.where(role == 0), CALIBRATION_ROWS)
    chosen = spark.createDataFrame([(*x, r) for r, rows in (("dictionary", dictionary), ("curve", curve)) for x in rows], "id long, quality int, role string")
    # 2 * DICTIONARY_ROWS + CALIBRATION_ROWS ids at most
    return docs.where("id IS NOT NULL").join(F.broadcast(chosen), "id").groupBy("id", "quality", "role").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def train_model(sample: DataFrame) -> Model:
    """Dictionaries from the sample's rows of role dictionary, then the curve from those of role curve, whose texts are taken whole."""
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("id"), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    texts: list[list[bytes]] = [[], []]
    for r in sample.where("role = 'dictionary'").select("quality", "id", piece.alias("piece")).orderBy("id", "quality").collect():
        texts[r["quality"]].append(r["piece"].encode())
    even = min(sum(map(len, t)) for t in texts)  # either dictionary is built from as much text

    def cut(t: list[bytes]) -> list[bytes]:
        upto = np.cumsum([len(x) for x in t])
        return t[: int(np.searchsorted(upto, even)) + 1]

    bad, good = (build_dictionary(cut(t)) if even else b"" for t in texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for b in batches:
            x = sizes.figures(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["quality", "difference", "mean"])

    found = sample.where("role = 'curve'").select("quality", "text").mapInArrow(run, "quality int, difference double, mean double").toPandas()
    found = found.sort_values(list(found.columns), ignore_index=True)
    y = found["quality"].to_numpy(float)
    if not even or not 0 < y.sum() < len(y):
        n, ones = len(y) + sum(map(len, texts)), y.sum() + len(texts[1])
        share = (ones + 1) / (n + 2)
        return Model(b"", b"", np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    return Model(good, bad, fit_curve(found[["difference", "mean"]].to_numpy(), y))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 is likelier) and predicted (score >= THRESHOLD).

    Learns from the labels of ids that are not held out alone, a bounded sample of them (see labelled_sample); scores every row, its
    whole text. Null texts are empty. A null id is held out. Without labels of both classes every row has the smoothed share of good
    ones. Repeated rows are scored each, equal texts alike; a table without rows gives none. Other columns pass through; those named like the three new ones
    are replaced.
    """
    d, names = set_aside(docs)
    plain = d.select(F.col(names[id_col]).cast("long").alias("id"), F.col(names[text_col]).alias("text"))
    marked, marks = set_aside(labels)
    marked = marked.select(F.col(marks[id_col]).cast("long").alias("id"), F.col(marks[label_col]).alias("quality"))
    model = train_model(labelled_sample(plain, marked))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    source = d.select(*[names[c] for c in keep], held_out(names[id_col]).alias("held_out"), d[names[text_col]].alias("text"))
    fields = source.drop("text").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizes = Sizes(own.good, own.bad) if own.good else None
        for b in batches:
            text = b.column(b.num_columns - 1)
            score = own.score(sizes.figures(text) if sizes else np.zeros((len(text), 2)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=fields.names)

    return source.mapInArrow(run, fields).toDF(*keep, "held_out", "score", "predicted")
