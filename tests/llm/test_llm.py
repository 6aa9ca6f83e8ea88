import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallow.llm import chat, components, extraction, jaccard, lm, mixing, packing, quality, syncmers, warc
from tallow.llm.common import most_frequent

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "en", "a", None, "x"), (2, "", "en", None, 0, "x"), (None, "only words here", "en", "a", 3, None), (4, "é" * 5000 + " end", None, "b", 1, "x"), (4, "é" * 5000 + " end", None, "b", 1, "x"), (5, "\n\t ", "en", "b", 1, "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def prose(rng, n):
    return " ".join(rng.choice(["th", "an", "er", "ing", "or", "ly"]) + rng.choice(["a", "e", "o"]) * rng.randint(1, 3) for _ in range(n))


def test_every_operator_takes_odd_and_empty_tables(odd, empty):
    for f in (syncmers.compare_neighbours, mixing.mix_sources, quality.apply_quality_rules, packing.pack_documents, lm.score_documents, jaccard.jaccard_classes):
        rows = f(odd)
        rows = rows.where("piece = 0") if "piece" in rows.columns else rows  # a long text has several pieces
        assert rows.count() == len(ODD), f.__name__
        assert f(empty).count() == 0, f.__name__


def plain_anchors(text, k, s):
    """Positions and k-mers of the anchors, by loops: an s-mer's hash is the code of its own smallest-k text."""
    mers = [text[i : i + k] for i in range(len(text) - k + 1)]
    hashes = {m: int(plain_hash(m)) for m in {text[i : i + s] for i in range(len(text) - s + 1)}}
    found = []
    for i, m in enumerate(mers):
        inner = [hashes[m[j : j + s]] for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, m))
    return found


def plain_hash(mer):
    h = [(int(syncmers.mix(np.array([(ord(c) + int(syncmers._M[0])) % 2**64], np.uint64))[0])) for c in mer]
    step = 1
    while len(h) > 1:
        h = [(h[i] * int(syncmers._M[step % 3]) + (h[i + step] ^ (h[i + step] >> 29))) % 2**64 for i in range(len(h) - step)]
        step *= 2
    return syncmers.mix(np.array(h, np.uint64))[0]


def plain_likeness(a, b):
    """Longest common subsequence of first occurrences over all, by dynamic programming."""
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1] / (len(a) + len(b) - best[-1][-1])


def test_syncmers_by_brute_force():
    rng = random.Random(1)
    for k, s in ((syncmers.K, syncmers.S), (8, 2), (4, 1)):
        texts = [prose(rng, 60), prose(rng, 30) + " é ü 漢字 " + prose(rng, 30)]
        for t, (codes, at) in zip(texts, syncmers.anchors(texts, k, s), strict=True):
            want = plain_anchors(t, k, s)
            assert at.tolist() == [i for i, _ in want]
            assert len({(c, m) for c, (_, m) in zip(codes.tolist(), want, strict=True)}) == len({m for _, m in want}) == len(set(codes.tolist()))


def test_likeness_by_brute_force(spark):
    rng = random.Random(2)
    words = [prose(rng, 12) for _ in range(9)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(14)] + ["abcdef", "uvw", "", prose(rng, 4), "x" * 300]
    rows = sorted(enumerate(texts), reverse=True)
    got = {r.doc_id: r for r in syncmers.compare_neighbours(frame(spark, [(i, t, "", "", 0, "") for i, t in enumerate(texts)])).collect()}

    def like(x, y):
        if not x or not y:
            return float(x == y)
        level = [(syncmers.K, syncmers.S), *[(k, s) for k, s, below in syncmers.SHORT if max(len(x), len(y)) < below]][-1]
        return plain_likeness(*[c.tolist() for c, _ in syncmers.anchors([x, y], *level)])

    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].near_edited == pytest.approx(like(t, edited)) and got[i].near_next == pytest.approx(like(t, after))
        assert got[i].fingerprint == syncmers.to_string(syncmers.fingerprints([t])[0])
        assert got[i].edited_fingerprint == syncmers.to_string(syncmers.fingerprints([edited])[0])
        assert 12 > len(t) or got[i].near_edited > 0


def test_syncmers_anchor_choice_and_likeness():
    rng = random.Random(1)
    t = prose(rng, 400)
    (codes, at), (same, _) = syncmers.anchors([t, t])
    assert (codes == same).all() and len(at) > 20
    inside = {t[p : p + syncmers.K] for p in at}
    (_, moved), = syncmers.anchors(["xyz " + t])
    assert {("xyz " + t)[p : p + syncmers.K] for p in moved} >= inside
    edited = t[: len(t) * 2 // 3] + prose(rng, 130)
    swapped = t[len(t) // 2 :] + t[: len(t) // 2]
    one, two, three = syncmers.fingerprints([t, edited, swapped])
    assert 0.3 < syncmers.likeness(one, two) < 0.7 and syncmers.likeness(one, three) < 0.4 and syncmers.likeness(one, one) == 1
    assert len(syncmers.to_string(one)) < 0.4 * len(t)


def test_fingerprints_keep_positions(spark, odd, empty):
    rows = syncmers.fingerprint_documents(odd).collect()
    assert len(rows) == len(ODD) and all((r.fingerprint != "") == bool(r.text) or not r.text for r in rows)
    assert syncmers.fingerprint_documents(empty).count() == 0


def test_neighbours_wrap_around(spark):
    got = {r.doc_id: r for r in syncmers.compare_neighbours(frame(spark, [(1, "abcdef", "", "", 0, ""), (7, "uvwxyz", "", "", 0, ""), (3, "q", "", "", 0, "")])).collect()}
    for doc, text in ((7, "uvwxq"), (3, "q"), (1, "abcduv")):
        assert got[doc].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, prose(rng, rng.randint(1, 60)), "en", rng.choice(["a"] * 6 + ["b", None]), 0, "") for i in range(600)])
    rows = mixing.mix_sources(docs).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.mix_taken
        assert 0 <= r.mix_taken <= 3 * r.mix_size
    slim = mixing.mix_figures(docs.withColumnRenamed("lang", "_size")).collect()
    assert sorted(map(str, slim)) == sorted(str(x) for x in mixing.mix_sources(docs).select("doc_id", "source", *mixing.ADDED).collect())
    for s, t in {r.source: r.mix_target for r in rows}.items():
        assert abs(taken[s] - t) <= 1
    total = sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(docs).collect())
    assert total == sum(taken.values())


def test_mixing_takes_odd_tables_and_clashing_names(spark, odd, empty):
    clash = odd.withColumnRenamed("lang", "_target").withColumnRenamed("n_words", "mix_size")
    assert mixing.mix_sources(clash).count() == len(ODD)
    for docs in (odd, clash, empty):
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns and all(r.text for r in mixed.collect())
    assert mixing.mixed_documents(empty).count() == 0


def test_water_filling_caps(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 10), ("c", 1000)], "_source string, _total long")
    got = {r._source: r._target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 3 and got["b"] == 30 and got["c"] == pytest.approx(978)


def test_quality_figures_by_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, 80) + ".\n" + prose(rng, 5) + ".\nHome | About | Contact | Login", "a b c a b c a b c " * 10, "X!! Y!! Z!! " * 40, "one\none\n\none two"]
    for r in quality.apply_quality_rules(frame(spark, [(i, t, "", "", 0, "") for i, t in enumerate(texts)])).collect():
        w = WORD.findall(r.text)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        often, cover = Counter(grams), set()
        for i, g in enumerate(grams):
            cover |= {i, i + 1, i + 2} if often[g] > 1 else set()
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r.kept == (r.doc_id == 0)
    assert "About" not in quality.clean_documents(frame(spark, [(0, texts[0], "", "", 0, "")])).first().text


def test_repeated_words_of_a_very_long_text(spark):
    text = F.concat(F.lit("a b c a b c "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert quality.apply_quality_rules(docs).select("n_words", "n_repeat_words").collect() == [(1_000_006, 6)]


def test_stutter_is_judged_on_every_line(spark):
    rng = random.Random(13)
    good = "\n".join(prose(rng, 12) + "." for _ in range(10))
    stutter = "so so so so so so so."
    out = quality.clean_documents(frame(spark, [(1, good + "\n" + stutter, "", "", 0, "")])).collect()
    assert [r.text for r in out] == [good]


def test_clean_documents_takes_odd_and_empty_tables(spark, odd, empty):
    assert quality.clean_documents(odd).count() == 0 and quality.clean_documents(empty).columns == empty.columns
    rng = random.Random(14)
    clash = frame(spark, [(1, ". ".join(prose(rng, 9) for _ in range(9)) + ".", "", "", 0, "")] * 2).withColumnRenamed("lang", "_t").withColumnRenamed("source", "kept")
    assert quality.clean_documents(clash).columns == clash.columns and quality.clean_documents(clash).count() == 2


def test_packing_is_gapless_and_round_trips(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.choice([3, 40, 900, 6000])), "", "", 0, "") for i in range(60)] + [(60, None, "", "", 0, "")]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(frame(spark, docs)).collect()
    for i, text, *_ in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for r in (r for r in rows if r.doc_id == i):
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in rows if r.doc_id == i) == len(ids)
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at[r.sequence_id] == r.offset
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(5)
    for _ in range(50):
        counts = Counter(rng.randint(1, 30) for _ in range(8))
        room, items = rng.randint(1, 60), list(counts.elements())
        best = {0}
        for n in items:
            best |= {b + n for b in best if b + n <= room}
        got = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(got) == max(best) and not Counter(got) - counts


def test_lm_base_score_and_normalisation(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, 30), "", "", 0, "") for i in range(120)]
    counts = Counter()
    tokens = {i: [w.lower() for w in WORD.findall(t)] + [0] for i, t, *_ in docs}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for r in lm.score_documents(frame(spark, docs)).collect():
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id]))
        assert r.n_known == sum(counts[w] > 0 for w in tokens[r.doc_id]) and r.train_tokens == n


def test_most_frequent_keeps_whole_steps(spark):
    counts = spark.createDataFrame([(i, c) for i, c in enumerate([100, 100, 40, 7, 7, 7, 1])], "token long, c long")
    for most, want in ((0, []), (1, []), (2, [100, 100]), (5, [100, 100, 40]), (6, [100, 100, 40, 7, 7, 7]), (9, [100, 100, 40, 7, 7, 7, 1])):
        assert sorted((r.c for r in most_frequent(counts, "c", most).collect()), reverse=True) == want


def test_lm_learns_pairs_and_is_normalised():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 50, (5, 4)).astype(float)
    model = lm.LogBilinear(5, pairs.sum(axis=0) / pairs.sum())
    losses = model.fit(np.arange(5), pairs, 300, 0.05)
    p = np.exp(model.r @ model.q.T + model.b - model.log_sums()[:, None])
    assert losses[-1] < losses[0] and np.allclose(p.sum(axis=1), 1)
    assert np.abs(p - pairs / pairs.sum(axis=1, keepdims=True)).max() < 0.05


def test_lm_pair_counts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 50)
    rng = random.Random(16)
    docs = frame(spark, [(i, prose(rng, rng.randint(0, 30)), "", "", 0, "") for i in range(40)]).repartition(3)
    voc = lm.Vocabulary(lm.token_counts(docs, "text"))
    got = Counter()
    for r in lm.pair_counts(docs, voc, "text").collect():
        got.update(dict(zip(np.frombuffer(r["keys"], "<i8").tolist(), np.frombuffer(r["counts"], "<i8").tolist(), strict=True)))
    want = Counter()
    for r in docs.collect():
        cls = [voc.classes, voc.classes, *[int(x) for w in lm.words(pa.array([r.text])) for x in voc.look(w)[0]], voc.end]
        for two, one, nxt in zip(cls, cls[1:], cls[2:], strict=False):
            want[one * voc.classes + nxt] += 1
            want[(voc.classes + 1 + two) * voc.classes + nxt] += 1
    assert got == want


def test_lm_score_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(17)
    follow = {w: [prose(rng, 1) + str(k) for k in range(3)] for w in range(3)}
    docs = []
    for i in range(400):
        t, kind = [], rng.randrange(3)
        for _ in range(60):
            t.append(rng.choice(follow[kind]))
            kind = (kind + 1) % 3 if rng.random() < 0.9 else rng.randrange(3)
        docs.append((i, " ".join(t), "", "", 0, ""))
    rows = lm.score_documents(frame(spark, docs)).where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    base, score = sum(r.base_score for r in rows) / tokens, sum(r.score for r in rows) / tokens
    assert rows and score > base + 0.2
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u", "x" * 200), (1, "u", "x" * 200), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "x" * 200)]
    folder, archives = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    archives = spark.createDataFrame(archives.collect(), archives.schema)
    got = {r.page_id: r for r in warc.read_warc(archives, folder).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 6: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None)}
    assert all(r.payload_digest == hashlib.sha256((dict((a, c) for a, _, c in rows)[i] or "").encode()).hexdigest() for i, r in got.items())


def test_warc_reads_what_is_stored(spark, tmp_path):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    good, cut = b"x" * 200, b"x" * 150
    rows = [warc.record(1, "u", cut, sha(good), None), warc.record(2, "u", good, sha(good), (1,)), warc.record(3, "u", good, sha(good), (9,)), warc.record(4, "u", good, sha(good), None)]
    (tmp_path / "a.warc.zst").write_bytes(warc.archive(rows))
    got = warc.read_warc(spark.createDataFrame([(str(tmp_path / "a.warc.zst"),)], "path string"), str(tmp_path)).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.digest_ok) for r in got} == {1: (150, sha(cut), False), 2: (150, sha(cut), False), 3: (None, None, False), 4: (200, sha(good), True)}


def test_warc_equal_rows_are_one_response(spark, tmp_path):
    rows = [(i % 3, "u", "x" * 200 + str(i % 3)) for i in range(24)]
    folder, archives = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), str(tmp_path / "w"))
    got = warc.read_warc(spark.createDataFrame(archives.collect(), archives.schema), folder).collect()
    assert sorted(r.page_id for r in got if r.record_type == "response") == [0, 1, 2] and len(got) == 24
    assert all(r.digest_ok and r.payload_bytes == 201 for r in got)


def test_warc_of_odd_and_empty_tables(spark, tmp_path):
    rows = [(None, None, "y" * 150, 1), (5, "u\n v", "y" * 150, 2), (None, "u", "y" * 150, 3), (7, "u", "", 4), (8, "u", "z" * 3_000_000, 5)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder, archives = warc.write_warc(docs, str(tmp_path / "w"))
    got = warc.read_warc(spark.createDataFrame(archives.collect(), archives.schema), folder).collect()
    assert len(got) == 5 and all(r.digest_ok for r in got)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 5), (0, "revisit", 5), (5, "response", None), (7, "response", None), (8, "response", None)]
    _, none = warc.write_warc(docs.limit(0), str(tmp_path / "e"))
    assert none.count() == 0


def test_warc_dictionary_sees_the_whole_archive(monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "train_dictionary", lambda samples: seen.extend(samples) or b"d" * 2000)
    warc.archive([b"%06d" % k + b"a" * 9994 for k in range(1000)])
    assert int(seen[-1][:6]) > 900 and sum(map(len, seen)) <= warc.SAMPLE_BYTES + 10_000


def linked_classes(sets, num, den):
    """Class of each key of sets (the smallest of its links' component), by comparing all pairs."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("n", "num", "den", "bounds"), [(4, 85, 100, {}), (5, 80, 100, {"COMMON_KEPT": 5, "FLUSH": 300}), (4, 85, 100, {"BLOCK": 8, "PIVOTS": 2}), (5, 80, 100, {"BLOCK_TOKENS": 200, "BUCKET_BYTES": 500})])
def test_jaccard_by_brute_force(spark, monkeypatch, n, num, den, bounds):
    for name, x in bounds.items():
        monkeypatch.setattr(jaccard, name, x)
    rng = random.Random(7)
    passage = prose(rng, 25)
    docs, base = [], [prose(rng, size).split() for size in (60,) * 9 + (10, 14, 200)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        docs.append((i, " ".join(w[: rng.choice([60, 60, 50, 3])]), "", "", 0, ""))
    docs += [(150 + i, prose(rng, 40) + " " + passage, "", "", 0, "") for i in range(20)]
    sets = {i: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or {tuple(w)} for i, t, *_ in docs for w in [t.split()]}
    label = linked_classes(sets, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame(spark, docs), n, num, den).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_equal_parts_meet_for_all_linked_pairs():
    rng = random.Random(11)
    for num, den in ((80, 100), (85, 100)):
        parts = jaccard.Parts(num, den)
        for size in [*range(1, 60), 150, 400, 1500]:
            base = {rng.getrandbits(64) for _ in range(size)}
            for _ in range(12):
                near = set(rng.sample(sorted(base), rng.randint(-(-num * size // den), size)))
                near |= {rng.getrandbits(64) for _ in range(rng.randint(0, size * den // num - size))}
                if den * len(base & near) < num * len(base | near):
                    continue
                two = [np.array(sorted(x), np.uint64) for x in (base, near)]
                named = [set(), set()]
                for k, x in parts.signatures(np.concatenate(two), np.array([0, len(base), len(base) + len(near)]), np.array([rng.random() < 0.3] * (len(base) + len(near)))):
                    named[k] |= set(x.tolist())
                assert base == near or named[0] & named[1], (size, len(near))


def test_merge_skip_counts_like_a_counter():
    rng = random.Random(12)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(rng.randint(0, 9))]
        least = rng.randint(1, 6)
        counts = Counter(x for one in lists for x in one)
        assert sorted(jaccard.merge_skip(lists, least)) == sorted((x, c) for x, c in counts.items() if c >= least)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "u long, v long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


PAGE = "<html><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><div class='post'><h1>Head &amp; more</h1><p>One <b>bold</b> text.<p>Two<br>lines<script>x</script></div><div class=comments>Nice</div><footer>(c)</footer></body></html>"


def test_extraction_leaves_noise_out(spark):
    rows = [(1, "http://a/1", PAGE), (2, "http://a/2", None), (3, None, "plain words"), (1, "http://a/1", PAGE), (4, "http://a/4", "<p>unclosed <i>tag")]
    got = sorted((r.page_id, r.text) for r in extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    main = "Head & more One bold text. Two lines"
    assert got == [(1, main), (1, main), (2, ""), (3, "plain words"), (4, "unclosed tag")]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div><p class="x" ">Hello there</p><p>two</p></div>', "Hello there two"),
        ('<div class="content share-post"><p>Body text</p><div class="share">Share it</div></div>', "Body text"),
        ('<div class="post"><p>Text</p><div id="comments">bad</div></div>', "Text"),
        ('<div class="sidebar"><p>All is here</p></div><footer>foot</footer>', "All is here"),
        ("<nav>only</nav>", ""),
        ("<title>open <p>text after", "open text after"),
        ("<p title='a > b' class=post>ok", "ok"),
        ("a < b and c > d", "a < b and c > d"),
        ("<!--> <p>x</p><!-- y", "x"),
        ("<p>" + "long " * 200_000 + "</p>", " ".join(["long"] * 200_000)),
    ],
)
def test_extraction_of_odd_pages(html, text):
    assert extraction.extract(html, []) == text


class Article(HTMLParser):
    """A second extractor for pages that mark their text with <article>, on the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skipped, self.text = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in extraction.BLOCKS:
            self.text.append(" ")
        self.depth += tag == "article"
        noise = tag in extraction.NOISE | extraction.SKIPPED or extraction.NOISE_NAME.search(dict(attrs).get("class") or "")
        if (noise or self.skipped) and tag not in extraction.VOID:
            self.skipped.append(tag)

    def handle_endtag(self, tag):
        if tag in extraction.BLOCKS:
            self.text.append(" ")
        self.depth -= tag == "article"
        if tag in self.skipped:
            del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.text.append(data)


def test_extraction_agrees_with_a_second_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extraction.extract_main_text(pages).collect()}
    rows = [r for r in pages.collect() if "<article" in (r.html or "")]
    same = 0
    for r in rows:
        second = Article()
        second.feed(r.html)
        same += " ".join("".join(second.text).split()) == got[r.page_id]
    assert len(rows) > 20 and same >= 0.95 * len(rows)


def test_extraction_votes_and_empty_table(spark):
    schema = "page_id long, url string, html string, host string, winners string"
    rows = [(i, "http://h/1", f"<div class=a><p>body {i} of it all</p></div><div class=b><p>a much longer aside than the body {i}</p></div>" if i == 0 else f"<div class=a><p>body {i} of it all and more words</p></div><div class=b><p>x</p></div>", "x", "y") for i in range(5)]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == "body 0 of it all" and len(got) == 5
    assert extraction.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_chat_fold_and_round_trip(spark):
    log = [(1, 1, "message", 1, "user", "hi [INST]"), (1, 2, "message", 2, "assistant", "a"), (1, 3, "delta", 2, "assistant", "b\\e"), (1, 4, "message", 3, "user", "bad"), (1, 5, "regenerate", 2, "assistant", "gone"), (1, 6, "delta", 2, "assistant", "</s> new"), (1, 7, "edit", 1, "user", "hello \\l")]
    folded = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string"))
    assert sorted((r.turn, r.role, r.text) for r in folded.collect()) == [(1, "user", "hello \\l"), (2, "assistant", "</s> new")]
    rows = [(1, 0, "user", "</s>[INST] ok"), (1, None, "assistant", "\\b[/INST]"), (2, 0, None, None), (2, 0, None, None)]
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: [("user", "</s>[INST] ok"), ("assistant", "\\b[/INST]")], 2: [("", ""), ("", "")]}


def test_chat_of_odd_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, seq string"
    rows = [(1, 0, "user", "x" * 500_000, "c"), (1, 0, "user", "x" * 500_000, "c"), (None, None, None, None, None), (2, 1, "assistant", "\\l\\e<s>", "c")]
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: [("user", "x" * 500_000)] * 2, None: [("", "")], 2: [("assistant", "\\l\\e<s>")]}
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0
    log = [(1, 1, "message", None, "user", "lost"), (1, 2, "message", 1, "user", "kept"), (1, 3, "regenerate", 1, "user", ""), (1, 4, "delta", 1, "user", "new")]
    folded = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string"))
    assert [(r.turn, r.text) for r in folded.collect()] == [(1, "new")]


def test_first_of_each_class_takes_odd_tables(spark, odd, empty):
    assert sorted(str(r.doc_id) for r in jaccard.first_of_each_class(odd).collect()) == ["1", "2", "4", "5", "None"]
    assert jaccard.first_of_each_class(empty).count() == 0
    clash = odd.withColumnRenamed("lang", "_row").withColumnRenamed("source", "component_id")
    assert jaccard.first_of_each_class(clash).columns == clash.columns and jaccard.first_of_each_class(clash).count() == 5


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    rng = random.Random(8)
    text = prose(rng, 90) + "."
    docs = frame(spark, [(1, text, "en", "a", 1, ""), (2, text, "en", "a", 1, ""), (3, prose(rng, 90) + ".", "en", "b", 1, ""), (4, "AAA!! BBB!! " * 50, "en", "b", 1, "")])
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == docs.columns
    one = corpus_pipeline.ngram_jaccard_join(spark, kept, "")
    assert sorted(r.doc_id for r in one.collect()) == [1, 3] and one.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, one, "")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {1, 3}
    assert corpus_pipeline.pack_sequences(spark, mixed, "").agg(F.count_distinct("sequence_id")).first()[0] == 1


def test_one_row_of_each_class_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    base = [prose(rng, 90) + "." for _ in range(5)]
    near = base[0] + " tail."
    rows = [(5, base[0]), (5, base[0]), (2, near), (None, base[0]), (None, base[1]), (None, base[1]), (7, base[2]), (8, base[3]), (8, base[2]), (9, base[4]), (9, base[4]), (4, base[3])]
    docs = frame(spark, [(i, t, "en", "a", len(t), str(k)) for k, (i, t) in enumerate(rows)]).repartition(3)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.lower().split() for _, t in rows)]
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    classes = {}
    for k, (i, _) in enumerate(rows):
        classes.setdefault(root(k), []).append((i is None, i or 0, k))
    want = sorted(str(rows[min(c)[2]]) for c in classes.values())
    assert len(want) == 5
    got = jaccard.first_of_each_class(docs, n=5, num=80, den=100)
    assert got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == want

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:2]:
        docs = f(spark, docs, "")
    assert sorted(str((r.doc_id, r.text)) for r in docs.collect()) == want
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() == packing.pack_documents(mixing.mixed_documents(docs)).count() > 0
