import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.llm import collocations, compression, jaccard, lm, packing, periodic, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, h string, runs string, words string, n long, id string, score string, phrase string, f long"


def frame(spark, rows):
    """(doc_id, text, lang) with columns named like what the operators work with."""
    return spark.createDataFrame([(*r, "x", "y", "z", 7, "i", "s", "p", 1) for r in rows], DOCS)


# Operator 11


def plain_runs(x, least=12):
    """Every p, every stretch of words that equal the word p further on; a stretch with a smaller period is none of p."""
    out = []
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            a = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            n = i - a + p
            if i > a and n >= max(least, 2 * p) and not any(x[a : a + n - q] == x[a + q : a + n] for q in range(1, p)):
                out.append((a, n, p))
            i += i == a
    return sorted(out)


def repetitive(rng):
    n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 20])
    x = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 2)):
        a, p = rng.randint(0, n), rng.randint(1, n // 3 + 1)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        if n:
            x[rng.randrange(n)] = 99
    return x


def test_runs_are_those_of_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        x = repetitive(rng)
        assert periodic.find_runs(np.array(x, np.int64)) == plain_runs(x), x


def test_the_grid_has_every_point_once_whatever_the_slab(monkeypatch):
    for slab in (1, 7, 1000):
        monkeypatch.setattr(periodic, "SLAB", slab)
        for n in (0, 1, 2, 13, 60):
            points = [x for i, p in periodic.grid(n) for x in zip(i.tolist(), p.tolist(), strict=True)]
            assert points == [(j * p, p) for p in range(1, n // 2 + 1) for j in range(n) if (j + 1) * p < n]


def test_long_runs_are_extended_over_many_chunks():
    x = np.concatenate((np.arange(500), np.tile(np.arange(1000, 1700), 300), [5]))
    assert periodic.find_runs(x) == [(500, 210_000, 700)]
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(((-length, s, p) for s, length, p in runs), default=None)
    best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_digest_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(" ".join(f"w{y}" if y % 2 else f"É{y}" for y in repetitive(rng)) for _ in range(rng.randint(1, 2))), "en") for i in range(250)]
    rows += [(None, "a b " * 9, None), (7, None, "en"), (8, "", "en"), (9, " \t\n ", "en"), (9, " \t\n ", "en"), (None, None, None), (-5, "A a " * 20 + "a\x0ba  a", "x"), (10, "one two three " * 700, "en")]
    docs = frame(spark, rows)
    got = [tuple(r) for r in periodic.digest(periodic.periodic_runs(periodic.with_period(docs))).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted([plain_digest(i, t) for i, t, _ in rows], key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows)


def test_periodic_runs_keeps_other_columns_and_takes_empty_tables(spark):
    docs = frame(spark, [(1, "so so so so so so so so so so so so on", "en")])
    row = periodic.periodic_runs(docs).first()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (13, [(0, 12, 1)], "so on")
    assert (row["h"], row["words"], row["n"]) == ("x", "z", 7)
    assert periodic.digest(periodic.periodic_runs(periodic.with_period(docs.where("false")))).count() == 0


# Operator 12


def labelled(rng, i):
    good = rng.random() < 0.7
    words = ["".join(rng.choice(["the", "ing", "or", "an", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
    text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" if i % 2 else words[0] for w in words)
    return i, text, int(good)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    return [labelled(rng, i) for i in range(800)]


def folds(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_classifier_on_held_out_rows(spark, corpus):
    docs = frame(spark, [(i, t, "en") for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, q, "clash") for i, _, q in corpus], "doc_id long, quality int, text string")
    rows = {r["doc_id"]: r for r in compression.score_quality(docs, labels).collect()}
    assert all(rows[i]["held_out"] == folds(i) and rows[i]["predicted"] == int(rows[i]["score"] >= 0.3) for i, _, _ in corpus)
    right = [rows[i]["predicted"] == q for i, _, q in corpus if folds(i)]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert rows[0]["h"] == "x" and rows[0]["runs"] == "y"
    # What held-out rows are labelled changes nothing, nor do labels that are neither 0 nor 1, or of no document.
    other = spark.createDataFrame([(i, 1 - q if folds(i) else q) for i, _, q in corpus] + [(3, None), (None, 1), (4, 5), (10**9, 0)], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in compression.score_quality(docs, other).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}


def test_classifier_odd_rows_and_tables(spark, corpus):
    odd = frame(spark, [(None, None, None), (1, "", "en"), (2, None, "en"), (2, None, "en"), (3, "Ünïcode. " * 50_000, "en")])
    labels = spark.createDataFrame([(i, q) for i, _, q in corpus], "doc_id long, quality int")
    got = compression.score_quality(odd, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and next(r for r in got if r["doc_id"] is None)["held_out"]
    empty = [r for r in got if not r["text"]]
    assert len({r["score"] for r in empty}) == 1
    assert compression.score_quality(odd.where("false"), labels).count() == 0
    docs = frame(spark, [(i, t, "en") for i, t, _ in corpus])
    none = compression.score_quality(docs, labels.where("false")).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    ones = compression.score_quality(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(ones) == 1 and ones[0]["score"] > 0.9


def test_texts_are_scored_whole():
    good, bad = ([f"{a} {b}. ".encode() * 4 for b in range(90)] for a in ("plain words here", "BUY NOW!!"))
    sizes = compression.Sizes(compression.build_dictionary(good), compression.build_dictionary(bad))
    import pyarrow as pa

    calm = "plain words here. " * 400
    x = sizes.figures(pa.array([calm, calm + "BUY NOW!! " * 800, "", None]))
    assert x[1, 0] < x[0, 0] and (x[2:] == 0).all()


# Operator 13


def plain_collocations(rows, least, longest, top, drop):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {x: c for x, c in counts.items() if c >= least}
    out = []
    for lang in totals:
        mine = {x: c for (y, x), c in frequent.items() if y == lang}
        found = []
        for x, a in mine.items():
            inside = any(len(y) > len(x) and drop * b >= 100 * a and any(y[i : i + len(x)] == x for i in range(len(y))) for y, b in mine.items())
            if len(x) > 1 and not inside:
                score, _, left, right = min((1000 * a * totals[lang] // (mine[x[:k]] * mine[x[k:]]), k, mine[x[:k]], mine[x[k:]]) for k in range(1, len(x)))
                found.append((-score, -a, " ".join(x).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(4)
    words = ["New", "york", "Ärger", "a", "b", "ÉTÉ", "x-y", " ", "日本"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(["New York city ", "a b a b ", *[w + " " for w in words], ". ", "\t", "\n", ", "]) for _ in range(rng.randint(0, 80)))
        rows.append((i, text, rng.choice(["en", "de", None, "und", ""])))
    return [*rows, (None, None, "en"), (1, "", None), (1, "", None), (2, "!" * 40, "fr"), (3, "New York city " * 3000, "en")]


@pytest.mark.parametrize("most", [1 << 22, 2])
def test_collocations_against_plain_python(spark, phrases, most, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "BITS", 20)
    monkeypatch.setattr(collocations, "SLICE", 12)
    docs = frame(spark, phrases)
    for longest, top, drop in ((5, 2000, 100), (3, 4, 80)):
        got = sorted(tuple(r) for r in collocations.mine_collocations(docs, least=8, longest=longest, top=top, drop=drop, most=most).collect())
        assert got == plain_collocations(phrases, 8, longest, top, drop)
        assert got


@pytest.mark.parametrize("longest,passes", [(2, 2), (4, 3), (5, 3)])
def test_collocations_count_two_levels_in_a_pass(spark, phrases, longest, passes, monkeypatch):
    plain, calls = collocations.level_counts, []
    monkeypatch.setattr(collocations, "level_counts", lambda *x: calls.append(x[1:]) or plain(*x))
    got = sorted(tuple(r) for r in collocations.mine_collocations(frame(spark, phrases), least=8, longest=longest).collect())
    assert got == plain_collocations(phrases, 8, longest, 2000, 100)
    assert len(calls) == passes


def test_collocations_without_frequent_phrases(spark, phrases):
    docs = frame(spark, phrases)
    assert collocations.mine_collocations(docs.where("false")).count() == 0
    assert collocations.mine_collocations(docs.where("doc_id < 5"), least=10**6).count() == 0


def test_bitmap_holds_all_phrases(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 16)
    monkeypatch.setattr(collocations, "SLICE", 10)
    level = spark.createDataFrame([("en", f"w{i} v{i % 7}", 100) for i in range(500)] + [("de", f"w{i}", 100) for i in range(40)], "lang string, phrase string, f long")
    exact, bits = (collocations.known_phrases(level, 540, m) for m in (1000, 10))
    assert len(exact.hashes) == 540 and bits.bitmap is not None
    assert bits.has(exact.hashes).all() and exact.has(exact.hashes).all()
    other = np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64)
    assert not exact.has(other).any() and bits.has(other).mean() < 0.05


def test_scores_past_64_bits_are_exact(spark):
    n, a = 9 * 10**12, 3_000_000_000_019
    one = spark.createDataFrame([("en", "x", a + 1), ("en", "y", a + 6)], "lang string, phrase string, f long")
    two = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    row = collocations._scored([one, two], totals, 10, 100).first()
    assert row["score"] == 1000 * a * n // ((a + 1) * (a + 6))


# Operator 5: scores from the model's arrays


def test_scores_by_a_plain_loop_over_tokens(spark, monkeypatch):
    rng = random.Random(12)
    words = ["the", "of", "and", "to", "in", "Is", *[f"w{i}x" for i in range(40)], "É"]
    rows = [(i, " ".join(rng.choices(words, [40, 31, 23, 17, 11, 7, *[1] * 40, 1], k=rng.randint(0, 40))), "en") for i in range(160)] + [(900, None, "en"), (901, "never seen q", "en")]
    seen, train = {}, lm.train_model

    def caught(pairs, vocabulary, **options):
        seen["voc"], seen["model"] = vocabulary, train(pairs, vocabulary, rounds=3, steps=4)
        return seen["model"]

    monkeypatch.setattr(lm, "own_classes", lambda n: 6)
    monkeypatch.setattr(lm, "train_model", caught)
    got = {r.doc_id: r for r in lm.score_documents(frame(spark, rows)).collect()}
    model, head = seen["model"], 6
    low = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(low(w) for i, t, _ in rows if not held(i) for w in WORD.findall(t or ""))
    own = {w: k for k, (w, _) in enumerate(counts.most_common(head))}

    def suffix(w):
        b = w.encode()
        return (((b[-1] * 257 + (b[-2] if len(b) > 1 else 0)) * 2654435761) % 2**32 >> 24) % lm.SUFFIXES

    mass = Counter()
    for w, c in counts.items():
        if w not in own:
            mass[suffix(w)] += c + 1
    end, start = head + lm.SUFFIXES, head + lm.SUFFIXES + 1
    share = lambda u, v: (lambda z: np.exp(z[v] - z.max()) / np.exp(z - z.max()).sum())(model.r[u] @ model.q.T + model.b)
    for i, t, _ in rows[::9] + rows[-2:]:
        score, one, two = 0.0, start, start
        for w in [*map(low, WORD.findall(t or "")), None]:
            c = end if w is None else own[w] if w in own else head + suffix(w)
            score += np.log10(lm.WEIGHTS[0] * share(one, c) + lm.WEIGHTS[1] * share(start + 1 + two, c))
            if w is not None and w not in own:
                score += np.log10((counts[w] + 1) / (mass[suffix(w)] + 1))
            one, two = c, one
        assert got[i].score == pytest.approx(score, rel=1e-4, abs=1e-3), (i, t)


# The pipeline's join: rows that share half of their name


def test_rows_that_share_half_of_their_name_are_told_apart(spark, monkeypatch):
    whole = lambda i: " ".join(f"word{i}{j}" for j in range(30))
    rows = [(i, whole(i % 5), "en") for i in range(10)] + [(3, whole(3), "en"), (None, None, "en")]
    docs = frame(spark, rows)
    want = sorted(str(r.doc_id) for r in jaccard.first_of_each_class(docs).collect())
    assert want == ["0", "1", "2", "3", "4", "None"]
    plain = jaccard.row_hash
    monkeypatch.setattr(jaccard, "row_hash", lambda columns, half: plain(columns, 1) if half else F.lit(7).cast("long"))
    assert sorted(str(r.doc_id) for r in jaccard.first_of_each_class(docs).collect()) == want


# Operator 3: menus and boilerplate


def test_menus_and_boilerplate_in_four_languages(spark, tmp_path):
    import duckdb

    prose = "This is a whole sentence of some words that ends as one should, and goes on for a while."
    menu = "Home\nNews\nOur shop\nSign on\nHelp\nMore"
    foot = "Impressum und Datenschutzerklärung\nTous droits réservés ici\nPolítica de privacidad\nAlle Rechte vorbehalten"
    texts = [prose, menu, foot, f"{menu}\n{prose}", "Home\nNews\nShop\nHelp", "Home\nNews\n\nShop\nHelp\nMore", "One.\nTwo.\nThree.\nFour.\nFive.\nSix.", "\n".join(["Home"] * 60), "".join(f"Here is line {k}{k} of words{k} that all{k} differ{k} and end{k} well{k}.\n" for k in range(9)) + menu, "", None, "A,\nb,\nc,\nd,\ne,"]
    want = [0, 6, 4, 6, 0, 0, 0, 60, 6, 0, 0, 0]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in quality.apply_quality_rules(docs).collect()}
    assert [got[i].n_bad_lines for i in range(len(texts))] == want
    assert got[3].clean_text == prose and not got[7].kept and got[8].kept
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.sql(queries.SQL["op3_quality_rules"])
    cols = told.columns
    assert sorted(told.fetchall()) == sorted(tuple(got[i][c] for c in cols) for i in got)


# The pipeline's stages


ODD = [(1, None, "en"), (2, "", None), (None, "only words here", "en"), (4, "é" * 3000 + " end.", None), (4, "é" * 3000 + " end.", None), *[(i, "".join(f"Here is{i % 3} line {k} of plain{k} words{k} that{k} all{i % 3} end{k} as{k} they should{k}.\n" for k in range(9)), None if i == 9 else "en") for i in range(5, 14)]]


def test_every_stage_takes_odd_and_empty_tables(spark):
    import corpus_pipeline

    docs = frame(spark, ODD)
    odd = docs.select("doc_id", "text", F.col("h").alias("lang"), F.when(F.col("doc_id") > 7, F.lit("s")).alias("source"), F.length("text").cast("long").alias("n_chars"))
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out, none = f(spark, odd, ""), f(spark, odd.where("false"), "")
        rows = out.collect()
        assert none.count() == 0 and rows, name
        if k < 3:
            assert out.columns == none.columns == odd.columns, name
        if name.startswith("quality"):
            assert len(rows) == 9 and all(len(r.text) == r.n_chars for r in rows)
        elif name.startswith("n-gram"):
            assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "4", "5", "6", "7", "None"]
        elif name.startswith("mixing"):
            assert {r.doc_id for r in rows} >= {4, None} and None in {r.source for r in rows}
        else:
            assert sum(r.start == 0 for r in rows) == len(ODD)


# Operator 4


class CountingTokenizer:
    """A tokenizer that counts the characters it is given."""

    seen = 0

    def __init__(self, own):
        self.own, self.model = own, own.model

    def encode(self, text, **kw):
        CountingTokenizer.seen += len(text)
        return self.own.encode(text, **kw)


def test_accents_and_signs_go_to_the_model_directly(monkeypatch):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    monkeypatch.setattr(packing, "_encoders", {})
    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_file": staticmethod(lambda path: CountingTokenizer(own))}))
    encode = packing.word_encoder(packing.tokenizer_path())
    CountingTokenizer.seen = 0
    words = [f"{a}é{b}ß{sign}" for a in "abcdefghij" for b in "klmnopqrst" for sign in (".", ",", "###", ".,&&&", "!!")]
    assert encode([" ".join(words)])[0] == np.array(own.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()
    assert CountingTokenizer.seen < 100


@pytest.mark.parametrize("text", ["İstanbul ΣΑΣ ſo ªº µm", "éé. a̸ ≮", "it's. we'll!! '' a'' 's S'", "<|endoftext|> a<|endoftext|>, <|x|>", "x_ _x y__.. z{|}~ q[\\]^`", "ÀÉÎÕÜ, ñandú; straße: œuvre Ÿ ÿ", "a1 1a 12. a\xadb ×÷ a×", "", " \n ", "a\x1cb. c"])
def test_words_are_encoded_as_in_their_text(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    assert packing.word_encoder(packing.tokenizer_path())([text])[0] == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
