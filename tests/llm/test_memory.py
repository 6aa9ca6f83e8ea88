"""What tasks of the n-gram Jaccard join hold, in Python and in batches."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallow.llm import jaccard
from tallow.llm.common import arrow_rows


class Task(Exception):
    pass


class Docs:
    """Gives away the function of a task."""

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):
        raise Task(f)


def test_counting_tokens_holds_a_few_times_the_texts(monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 600_000)
    try:
        jaccard.common_tokens(Docs(), 5, "text")
    except Task as t:
        run = t.args[0]
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(1000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts + texts[:10])], names=["text"])]
    next(run(iter([batches[0].slice(0, 1)])))  # tables that a process keeps
    tracemalloc.start()
    out = list(run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) >= 10 * 496
    assert peak < 20e6, peak  # the texts have 3 MB


def test_repeated_numbers():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 50, 400):
        x = [rng.randrange(90) for _ in range(n)]
        got = jaccard.repeated(np.array(x, np.uint64))
        assert list(zip(*(g.tolist() for g in got), strict=True)) == sorted((v, x.count(v)) for v in set(x) if x.count(v) > 1)


def test_held_takes_more_than_its_room():
    held = jaccard.Held(4, 2)
    for k in (3, 1, 9, 0):
        held.add(np.arange(k, dtype=np.uint64), np.uint64(k), k=k)
    assert held.take().tolist() == [[0, 1, 2, 0, *range(9)], [3] * 3 + [1] + [9] * 9]
    held.add(np.array([5], np.uint64), np.uint64(6), k=1)
    assert held.take().tolist() == [[5], [6]]


def test_batches_of_long_rows_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with arrow_rows(spark, 1000):
        got = spark.range(0, 900, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t")).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 900
    assert max(r.bytes for r in got) <= 5 << 20
    assert spark.conf.get(name) == before


def test_edges_of_a_large_group_are_dealt_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "EDGES", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"edit{rng.randrange(10**6)}"] + base[k + 1 :])) for i in range(40) for k in [rng.randrange(55, 60)]]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 0) for i in range(40)}
