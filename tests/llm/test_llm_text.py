"""Exact dedup, near dedup, licenses, toxicity and words against brute force, with hard inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogrid.llm import dedup_exact, licenses, minhash, toxicity
from orogrid.llm.words import Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, rep string, row string, hash string, position string, shard string, slot string, norm string, class_id string"
HARD = [(1, "Aa bb\ncc"), (2, "aA BB\nCC"), (3, None), (4, ""), (5, "É è"), (6, "é è"), (7, "x" * 200_000), (8, "w " * 50_000), (None, "aa bb\ncc"), (9, " \t\n"), (10, "\U0001f600 \x00 end"), (2, "aA BB\nCC")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 2, None, *["clash"] * 9) for i, t in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_words_equal_the_pattern():
    texts = [t or "" for _, t in HARD] + ["", "a1-b2_c3é", "É", "z"]
    data = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    joined = b"".join(data)
    got = defaultdict(list)
    for d, a, b in zip(w.doc, w.start, w.end, strict=True):
        got[d].append(lower(joined[a:b].decode()))
    assert [got[k] for k in range(len(texts))] == [words(t) for t in texts]
    assert len({(int(h), x) for h, x in zip(w.hash, (y for k in range(len(texts)) for y in words(texts[k])), strict=True)}) == len(set(w.hash.tolist()))


@pytest.mark.parametrize("print_bits", [64, 3])
def test_exact_groups(spark, print_bits):
    """With 3-bit fingerprints nearly every text collides, so the byte verification decides."""
    rows = HARD + [(100 + k, f"Copy {k % 5}") for k in range(40)]
    got = dedup_exact.exact_groups(frame(spark, rows), print_bits=print_bits).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        ids = sha[r.text_sha256]
        keep = max((x for x in ids if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    kept = dedup_exact.deduplicated(frame(spark, rows))
    assert kept.count() == len(groups)
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("bits", [0, 3])
def test_filters_merge_without_loss(bits):
    rng = random.Random(3)
    prints = [rng.randrange(1 << 64) for _ in range(300)] * 2 + [7] * 70_000 + [(5 << 61) + 9] * 300 + [(1 << 64) - 1] * 3 + list(range(20))
    parts = [Counter(prints[k::4]) for k in range(4)]
    by_slice = defaultdict(list)
    for p in parts:
        keys = sorted(p)
        for s, data in dedup_exact.slices(np.array(keys, np.uint64), np.array([p[k] for k in keys]), bits):
            by_slice[s].append(data)
    found = {}
    for data in by_slice.values():
        got, counts = dedup_exact.merged(data)
        assert (got[1:] > got[:-1]).all()
        found |= dict(zip(got.tolist(), counts.tolist(), strict=True))
    assert found == Counter(prints)


def test_filter_has_runs_of_sorted_remainders():
    """Quotients 1, 1, 1, 2 and 7 of 8: the run of 2 is pushed on, each count above one takes a slot after its remainder."""
    part = lambda q, r: (q << 61) + r
    f = dedup_exact.QuotientFilter(np.array([part(1, 3), part(1, 5), part(1, 9), part(2, 4), part(7, 1)], np.uint64), np.array([1, 3, 1, 2, 300]))
    assert (f.quotient_bits, f.width) == (3, 8)
    assert np.flatnonzero(f.occupied).tolist() == [1, 2, 7]
    assert np.flatnonzero(f.ends).tolist() == [4, 6, 8]
    assert np.flatnonzero(f.counting).tolist() == [3, 6, 8]
    assert f.slots[:, :2].astype(int).tolist() == [[0, 0], [3, 0], [5, 0], [2, 0], [9, 0], [4, 0], [1, 0], [1, 0], [43, 1]]
    again = dedup_exact.QuotientFilter.unpack(f.pack())
    assert [x.tolist() for x in again.items()] == [x.tolist() for x in f.items()]
    assert f.items()[1].tolist() == [1, 3, 1, 2, 300]
    assert [len(x) for x in dedup_exact.QuotientFilter(np.zeros(0, np.uint64), np.zeros(0, np.int64)).items()] == [0, 0]


def test_spellings_of_one_document_stay_once(spark):
    rows = [(7, "abc"), (7, "Abc"), (7, "Abc"), (3, "ABC"), (9, None), (9, ""), (None, ""), (None, "Solo"), (None, "solo"), (1, "other")]
    clash = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, _gone string, _sha string, _rank string")
    got = dedup_exact.deduplicated(clash)
    assert got.columns == clash.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [(7, "Abc"), (9, None), (None, "Solo"), (1, "other")]))


def test_which_of_equal_rows_stays_does_not_depend_on_partitions(spark):
    """Rows of one doc_id and text that differ in another column, maps beside: the first by its columns stays."""
    rows = [(1, "a", k, f"p{k % 7}") for k in range(40, 0, -1)] + [(1, "A", None, "z"), (2, "b", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, note string").withColumn("m", F.create_map(F.lit("k"), F.col("rank")))
    for n in (1, 3, 7):
        got = dedup_exact.deduplicated(df.repartition(n, "note")).collect()
        assert sorted((r.doc_id, r.text, r["rank"], r.note) for r in got) == [(1, "A", None, "z"), (2, "b", 1, None)]
        got = dedup_exact.deduplicated(df.where("text <> 'A'").repartition(n, "note")).collect()
        assert sorted((r.doc_id, r.text, r["rank"], r.note, r.m["k"]) for r in got) == [(1, "a", 1, "p1", 1), (2, "b", 1, None, 1)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert dedup_exact.exact_groups(none).count() == 0
    assert minhash.near_classes(none).count() == 0
    assert licenses.scanned(none).count() == 0
    assert dedup_exact.deduplicated(none).count() == 0


def naive_pj(a, b):
    both = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in both) for i in a.keys() & b.keys())


def test_probability_jaccard_is_exact():
    rng = random.Random(5)
    for _ in range(50):
        a, b = (Counter(rng.choices(range(12), k=rng.randint(1, 30))) for _ in range(2))
        pack = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
        assert minhash.probability_jaccard(*pack(a), *pack(b)) == pytest.approx(naive_pj(a, b))


def test_pairs_at_exactly_the_threshold_are_similar():
    ones = lambda n: np.ones(n, np.int64)
    for k in range(1, 400):
        a, b = np.arange(4 * k, dtype=np.uint64), np.arange(5 * k, dtype=np.uint64)
        assert minhash.similar(a, ones(4 * k), b, ones(5 * k), 0.8)
        assert minhash.similar(a, 3 * ones(4 * k), b, 3 * ones(5 * k), 0.8)  # counts above one, in rationals
        assert not minhash.similar(a[:-1], ones(4 * k - 1), b, ones(5 * k), 0.8)
        assert not minhash.similar(a[:-1], 3 * ones(4 * k - 1), b, 3 * ones(5 * k), 0.8)
    rng = random.Random(6)
    for _ in range(200):
        a, b = ({k: rng.randint(1, 3) for k in range(rng.randint(8, 12))} for _ in range(2))
        want = sum(1 / sum(max(Fraction(a.get(j, 0), a[i]), Fraction(b.get(j, 0), b[i])) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        pack = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
        for t in (0.5, 0.75, 0.8, float(want)):
            assert minhash.similar(*pack(a), *pack(b), t) == (want >= Fraction(repr(t)))


@pytest.mark.parametrize("block_rows", [2048, 2])
def test_documents_at_exactly_the_threshold_share_a_class(spark, monkeypatch, block_rows):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    rows = []
    for k, n in enumerate((15, 60, 65, 75, 100)):  # n shingles of five words, and the first 4 n / 5 of them
        w = [f"w{k}x{j}" for j in range(n + 4)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: n * 4 // 5 + 4]))]
    got = {r.doc_id: r.class_id for r in minhash.near_classes(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(10)}


def test_registers_estimate_the_similarity():
    doc = np.repeat([0, 1], [200, 200])
    gram = np.concatenate((np.arange(200), np.arange(40, 240))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = minhash.signatures(doc, gram, np.ones(400, np.int64), 2, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(160 / 240, abs=0.04)


def near_rows(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, n = [(None, "a b c d e f"), (900, None), (901, ""), (902, "!!"), (903, "one two"), (904, "One, two"), (905, "one two three")], 0
    for base in range(6):
        text = rng.choices(vocab, k=120)
        for edits in (0, 0, 1, 2, 3, 5, 8):
            copy = list(text)
            for p in rng.sample(range(120), edits):
                copy[p] = rng.choice(vocab)
            rows.append((n, " ".join(copy)))
            n += 1
    common = rng.choices(vocab, k=30)
    for _ in range(40):  # a passage that many share, without being near copies
        rows.append((n, " ".join(common + rng.choices(vocab, k=30))))
        n += 1
    return [*rows, rows[8]]


def brute_classes(rows):
    grams = {}
    for i, t in rows:
        w = words(t)
        if w and i is not None:
            grams[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(grams)
    for x in ids:
        for y in ids:
            if x < y and grams[x].keys() & grams[y].keys() and naive_pj(grams[x], grams[y]) >= 0.8:
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in root}


def test_near_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)  # large buckets are then dealt out as blocks
    rows = near_rows()
    want = brute_classes(rows)
    got = minhash.near_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id) for r in got} == set(want.items())
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)
    stays = {r.doc_id for r in minhash.near_deduplicated(frame(spark, rows)).select("doc_id").collect()}
    assert stays == {i for i, c in want.items() if i == c}


def test_classes_of_the_given_documents_equal_brute_force(spark):
    """Recall and precision of the whole operator on a given table: every pair that shares a shingle is compared."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    grams, at = {}, defaultdict(list)
    for r in docs.collect():
        w = words(r.text)
        if w:
            grams[r.doc_id] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
            for g in grams[r.doc_id]:
                at[g].append(r.doc_id)
    root = {i: i for i in grams}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(x, y) for ids in at.values() for x in ids for y in ids if x < y}
    linked = 0
    for x, y in pairs:
        keys = sorted(grams[x].keys() | grams[y].keys())
        number = {g: k for k, g in enumerate(keys)}
        pack = lambda c, n=number: (np.array(sorted(n[g] for g in c), np.uint64), np.array([c[g] for g in sorted(c, key=n.get)]))
        if minhash.similar(*pack(grams[x]), *pack(grams[y]), 0.8):
            linked += 1
            a, b = top(x), top(y)
            root[max(a, b)] = min(a, b)
    assert linked > 20
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()}
    assert {i: got[i] for i in root} == {i: top(i) for i in root}


def test_rows_that_repeat_a_doc_id_stand_by_their_texts(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices([f"w{k}" for k in range(400)], k=n))
    a, b, c = text(80), text(80), text(80)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (5, c), (5, a + " again"), (4, c + " more"), (6, text(50))]
    got = [(r.doc_id, r.class_id, r.kept) for r in minhash.near_classes(frame(spark, rows)).orderBy("doc_id", "n_words").collect()]
    assert sorted(got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False), (5, 4, False), (6, 6, True)]
    rows.append((1, c + " more"))  # a third text of document 1: of its class, which holds 4 and 5, document 1 stays
    left = minhash.near_deduplicated(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, a), (1, b), (1, c + " more"), rows[7]])
    both = [(1, a), (2, a + " more"), (2, b)]  # document 2 goes by one of its texts and stays by the other
    assert sorted((r.doc_id, r.text) for r in minhash.near_deduplicated(frame(spark, both)).collect()) == [(1, a), (2, b)]


def test_licenses_equal_brute_force(spark):
    rng = random.Random(4)
    phrases = list(licenses.BASE)
    rows = HARD + [(20, "Licensed under the Apache License, Version 2.0."), (21, "licensed UNDER the extra Apache License version 2 0"), (22, "MIT-License mit license; CC BY-NC cc  by"), (23, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"), (24, "gnu general public licensee")]
    rows += [(30 + k, " ".join(rng.choices([*phrases, "gnu", "license", "cc", "by", "x", "y"], k=30))) for k in range(30)]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scanned(frame(spark, rows)).collect()}
    want = set()
    for i, t in rows:
        w = words(t)
        places = [(k, licenses.BASE[p]) for p in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.add((i, len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    assert got == want
    by = {r.doc_id: r for r in licenses.scanned(frame(spark, rows)).collect()}
    assert by[20].labels == "apache,apache-2.0"
    assert by[21].labels == "apache,apache-2.0"  # an inserted word parts the diagonals, and they merge
    assert by[23].labels == "mit"
    assert by[23].base_labels == ""
    assert by[20].score == 1.0
    assert by[4].score == 0.0


def brute_spans(w, k=licenses.GRAM):
    """(label, share) of every merged span of every template, by comparing words."""
    out = []
    for text, label in licenses.TEMPLATES:
        t = words(text)
        hits = defaultdict(list)  # diagonal -> template positions whose k words stand there
        for p in range(len(w) - k + 1):
            for q in range(len(t) - k + 1):
                if w[p : p + k] == t[q : q + k]:
                    hits[p - q].append(q)
        runs = []
        for d in sorted(hits):
            if runs and d - runs[-1][0] <= licenses.NEIGHBOUR:
                runs[-1] = (d, runs[-1][1] + hits[d])
            else:
                runs.append((d, list(hits[d])))
        for _, found in runs:
            covered = {q + j for q in found for j in range(k)}
            out.append((label, len(covered) / len(t)))
    return out


def test_license_labels_and_scores_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [*HARD]
    for k in range(60):
        w = rng.choices(["x", "y", "license", "the", "apache"], k=rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            t = words(rng.choice(licenses.TEMPLATES)[0])
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(t) + 1)
                t = t[:p] + ["z"] + t[p:] if rng.random() < 0.5 else t[:p] + t[p + 1 :]
            w += [*t, "x"]
        rows.append((100 + k, " ".join(w)))
    for r in licenses.scanned(frame(spark, rows[len(HARD) :])).collect():
        w = words(dict(rows)[r.doc_id])
        own = {licenses.BASE[p] for p in licenses.BASE if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))}
        spans = brute_spans(w)
        assert r.labels == ",".join(sorted(own | {label for label, share in spans if share >= licenses.SHARE}))
        assert r.score == pytest.approx(1.0 if own else max((share for _, share in spans), default=0.0))
        found, want = (sorted(x) for x in ([(s.label, s.share) for s in r.spans or []], [x for x in spans if x[1] >= licenses.SHARE]))
        assert [x for x, _ in found] == [x for x, _ in want]
        assert [x for _, x in found] == pytest.approx([x for _, x in want])


def test_cells_seen_once_are_counted(spark):
    rows = spark.createDataFrame([("rare common", 0), ("common", 0), ("common bad", 1)], "text string, toxic int")
    toxic, seen, _ = toxicity.count_table(rows)
    assert ((seen == 1) & (toxic == 0)).any()
    assert ((seen == 1) & (toxic == 1)).any()
    assert ((seen == 3) & (toxic == 1)).any()


def brute_segments(s):
    """Ruzzo and Tompa by definition: the best segment, then the same on what lies left and right of it."""
    out = []

    def split(lo, hi):
        best = max(((sum(s[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] > 1e-12:
            out.append((best[2], best[3]))
            split(lo, best[2])
            split(best[3], hi)

    split(0, len(s))
    return sorted(out)


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(1)
    for _ in range(60):
        s = np.round(rng.normal(-0.2, 1, rng.integers(0, 14)), 3)
        assert sorted((a, b) for a, b, _ in toxicity.maximal_segments(s)) == brute_segments(s.tolist())


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    rows = toxicity.scored(docs, model).join(labels, "doc_id").select("doc_id", "score", "toxic").toPandas()
    held = rows[[zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]]
    order = held.score.rank().values
    bad = (held.toxic == 1).values
    auc = (order[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.94
    flagged = held[held.score >= 0.7]
    assert (flagged.toxic == 1).mean() > 0.9
    assert ((held.score >= 0.7) & bad).sum() / bad.sum() > 0.65
    hard = toxicity.scored(frame(spark, HARD), model).collect()
    assert len(hard) == len(HARD)
    assert all(0 <= r.score <= 1 for r in hard)
    assert next(r for r in hard if r.doc_id == 3).score < 0.7
    assert toxicity.scored(frame(spark, []), model).count() == 0
    none = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert toxicity.scored(frame(spark, HARD), none).count() == len(HARD)
    assert toxicity.without_toxic(frame(spark, HARD), none).columns == frame(spark, HARD).columns


def test_held_out_is_crc32_of_the_id_as_text(spark):
    got = {r.id: r.h for r in spark.range(200).withColumn("h", toxicity.held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}
