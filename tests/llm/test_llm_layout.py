"""Token files, chats, shards, packing, mixing and embeddings against brute force, with hard inputs."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_text import HARD, frame
from tokenizers import Tokenizer

from orogrid.llm import chat, embedding, mixing, packing, sharding, tokencoder, tokenfile
from orogrid.llm.common import connected_components, saved
from orogrid.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "  a", "a  b", "a \n b", "x\n", "\n \n", "don't  we'll", "ΑΣ Σ ΟΔΟΣ.", "<|endoftext|> hi", "hi <|endoftext|> there", "<|ENDoftext|>", "é é", "　w", "a\tb c d", "12 345", "İI ß", "x\n\n", "\n\ny", "T̈"]
SIGNS = [" ", " ", "  ", "\n", "\t", *"aB1.,!'-_<T\x00\x1c\x1f", "'s", "'LL", *"éÉΣςößİ×÷µª٣²½中🙂  　​̸́", "|endoftext|", "<|endoftext|>", "the", "don"]


def library(path):
    return Tokenizer.from_file(path)


def encoded(encoder, texts, limit=1 << 20):
    """ids of every text; null is empty."""
    return [ids[a:b].tolist() for _, _, ids, at in encoder.encode(pa.array(texts, pa.string()), limit) for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize(("limit", "cache"), [(1 << 20, 1 << 20), (50, 100)])
def test_ids_equal_the_library(path, limit, cache):
    """The plain library call, special tokens too; small slices and a cache that overflows give the same."""
    rng = random.Random(1)
    texts = [*ODD, None, *("".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(6000)), "word " * 3000, "中文" * 400]
    want = [x.ids for x in library(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoded(Encoder(path, cache), texts, limit) == want


def test_chunks_with_one_hash_go_to_the_library(monkeypatch):
    monkeypatch.setattr(Encoder, "_hashes", lambda self, b, start, end: ((end - start).astype(np.uint64), b[start].astype(np.uint64)))
    texts = ["one two", "two three", "four"]
    assert encoded(Encoder(BYTE), texts) == [x.ids for x in library(BYTE).encode_batch(texts, add_special_tokens=False)]


def test_coder_round_trips():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n).astype(np.uint16) for n in (0, 1, 2, 77)] + [np.zeros(300, np.uint16), np.full(300, 65535, np.uint16), (np.arange(500) % 7).astype(np.uint16)]
    coded = tokencoder.compress(blocks)
    assert all((a == b).all() for a, b in zip(blocks, tokencoder.decompress(coded, list(map(len, blocks))), strict=True))
    assert len(coded[-1]) < 1000 * 0.45
    assert tokencoder.compress(blocks[::-1]) == coded[::-1]  # each block is reset: its bytes don't depend on its neighbours


def test_an_id_narrows_its_interval_once(monkeypatch):
    """Choice and escape of an id share one pass over the lanes; blocks that are hard to code, with carries and second words, come back whole."""
    calls, narrow = [], tokencoder._Coder.narrow
    monkeypatch.setattr(tokencoder._Coder, "narrow", lambda self, low, rng: (calls.append(self.encoding), narrow(self, low, rng))[1])
    rng = np.random.default_rng(1)
    blocks = [rng.permutation(65536)[:2048].astype(np.uint16) for _ in range(40)] + [(rng.random(2048) < 0.02).astype(np.uint16) * rng.integers(0, 65536, 2048).astype(np.uint16) for _ in range(40)]
    coded = tokencoder.compress(blocks)
    assert all((a == b).all() for a, b in zip(blocks, tokencoder.decompress(coded, list(map(len, blocks))), strict=True))
    assert calls == [True] * 2048 + [False] * 2048
    assert max(map(len, coded)) <= 4 * 2048 + 6


def test_carries_pass_full_words():
    coder = tokencoder._Coder(2, np.array([[9] * 6, [0, 5, 65535, 65536, 7, 9]], np.int32), True)
    coder.at = coder.first + [0, 5]
    assert coder.words(1).tolist() == [6, 0, 0, 7]


def test_words_are_the_sum_of_the_steps():
    """Against whole numbers of any size: intervals at the upper end of the one before give carries through runs of full words."""
    rng = random.Random(5)
    lanes, steps = 30, 200
    coder = tokencoder._Coder(lanes, np.zeros((lanes, 2 * steps + 4), np.int32), True)
    total, places, carries = [0] * lanes, [0] * lanes, 0
    for _ in range(steps):
        low, width = coder.low.copy(), np.empty(lanes)
        for k in range(lanes):
            had = int(coder.range[k])
            width[k] = max(8, had >> rng.choice((0, 1, 3, 9, 24)))
            room = had - int(width[k])
            step = rng.choice((0, min(1, room), room, room))
            low[k] += step
            total[k] += step
            for limit in (1 << 32, 1 << 16):
                if width[k] < limit:
                    total[k] <<= 16
                    places[k] += 1
        carries += int((low >= float(1 << 48)).sum())
        coder.narrow(low, width)
        assert coder.low.max() < float(1 << 49) and coder.range.min() >= float(1 << 32)
    coder.flush()
    assert carries > 50
    for k in range(lanes):
        words = coder.words(k).tolist()
        assert len(words) == places[k] + 3 and max(words) < 1 << 16
        assert sum(w << 16 * i for i, w in enumerate(reversed(words))) == total[k]


def test_damaged_blocks_are_refused():
    ids = np.arange(50, dtype=np.uint16)
    block = tokencoder.pack_block(ids, tokencoder.compress([ids])[0], [3], [50], False, False)
    assert (tokencoder.read_blocks([block])[0][0] == ids).all()
    with pytest.raises(ValueError, match="cut short"):
        tokencoder.read_blocks([block[:-1]])
    with pytest.raises(ValueError, match="checksum"):
        tokencoder.read_blocks([block[:-20] + bytes([block[-20] ^ 255]) + block[-19:]])


def test_token_file_round_trip(spark):
    rows = HARD + [(30 + k, t) for k, t in enumerate(ODD)] + [(100, "long text " * 6000)]
    got = tokenfile.read_tokens(spark, tokenfile.write_tokens(frame(spark, rows), WORD, 1)).collect()
    t = library(WORD)
    start, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: (r[1],)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(frame(spark, []), WORD, 1)).count() == 0


def test_reading_back_writes_no_table_and_joins_across_batches(spark):
    """One pass from blocks to documents; the parts of a document that several Arrow batches hold become one row, its checksum that of all ids."""
    text = "some words of a long text " * 3000
    path = tokenfile.write_tokens(frame(spark, [(1, "a"), (2, text), (3, None), (4, text[:50_000])]), WORD, 1)
    folder = os.path.dirname(path).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {r.doc_id: r for r in tokenfile.read_tokens(spark, path).collect()}
            assert sorted(got) == [1, 2, 3, 4]
            for i, t in ((2, text), (4, text[:50_000])):
                ids = [*library(WORD).encode(t, add_special_tokens=False).ids, 1]
                assert len(ids) > 4 * tokencoder.BLOCK_IDS
                assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert set(os.listdir(folder)) == before


def test_ids_beyond_the_format_are_refused(spark, monkeypatch):
    with pytest.raises(ValueError, match="end id"):
        tokenfile.write_tokens(frame(spark, [(1, "a")]), WORD, 1 << 16)

    class Wide:
        def encode(self, column):
            yield 0, len(column), np.array([70_000], np.uint32), np.array([0, 1])

    monkeypatch.setattr(tokenfile, "encoder", lambda path: Wide())
    with pytest.raises(Exception, match="do not fit"):
        tokenfile.write_tokens(frame(spark, [(1, "a")]), WORD, 1)


def test_checksums_of_parts_join():
    rng = random.Random(2)
    runs = [[rng.randbytes(rng.choice((0, 1, 5, 400, 70_000))) for _ in range(rng.randint(1, 5))] for _ in range(40)]
    parts = [p for r in runs for p in r]
    first = np.cumsum([0, *map(len, runs)])[:-1]
    got = tokenfile.joined_crc32(np.array([len(p) for p in parts]), np.array([zlib.crc32(p) for p in parts]), first)
    assert got.tolist() == [zlib.crc32(b"".join(r)) for r in runs]


def test_the_number_for_null_is_refused(spark):
    with pytest.raises(Exception, match="told from null"):
        tokenfile.write_tokens(frame(spark, [(-(1 << 63), "a")]), WORD, 1)


TEXTS = ["\\### Assistant: </turn> ok", "<turn:user>\\", "\\\\<\\>", "", None, "line\nline", "<image:0>"]


def test_chats_round_trip(spark):
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate([(r, x) for x in TEXTS for r in ("user", "assistant")])] + [(3, 0, None, "a"), (3, None, "assistant", "b"), (None, 0, "assistant", "c")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    parts = F.array(F.struct(F.lit("text").alias("type"), "text", *(F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages"))).cast(chat.PART))
    path = chat.write_chats(df.withColumn("parts", parts))
    got = {r.conv_id: r for r in chat.digests(spark.read.parquet(path)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.formatted_turns(df.withColumn("parts", parts).limit(0)).count() == 0


def test_typed_parts_become_ordered_placeholders():
    parts = [{"type": "text", "text": "see <image:9> "}, {"type": "image", "ref": "a.png", "width": 100, "height": 57}, None, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 2}]
    segment, start, end, found = chat.format_turn("user", parts)
    assert segment[start:end] == "see \\<image:9\\> <image:0><audio:1><document:2>"
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in found] == [(0, "image", "a.png", 4 * 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1024)]
    assert all(segment[a["at"] :].startswith(f"<{a['kind']}:{a['number']}>") for a in found)
    assert chat.parse(segment) == [("user", "see <image:9> <image:0><audio:1><document:2>")]
    with pytest.raises(ValueError, match="unknown content part"):
        chat.format_turn("user", [{"type": "video"}])


def test_typed_parts_come_back(spark):
    """Numbers go on through a conversation, texts that look like placeholders stay texts, references and tokens are read back."""
    image, audio, page = ({"type": "image", "ref": "a.png", "width": 100, "height": 57}, {"type": "audio", "ref": None, "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 2})
    text = lambda x: {"type": "text", "text": x}
    turns = [(1, 0, "user", [text("<image:0> \\<"), image, text("and"), text(" more")]), (1, 1, "assistant", [audio, page]), (1, 2, "user", []), (2, 0, None, [page, text(None), None, image]), (2, 1, "user", None), (None, 0, "user", [image])]
    rows = [(*t[:3], t[3] and [x and tuple(x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")) for x in t[3]], "clash") for t in turns]
    path = chat.write_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, segment string"))
    got = [(r.conv_id, r.turn, r.role, [(x.type, x.text or x.ref, x.number, x.tokens) for x in r.parts]) for r in chat.read_chats(spark.read.parquet(path)).collect()]
    want = [
        (1, 0, "user", [("text", "<image:0> \\<", None, None), ("image", "a.png", 0, 12), ("text", "and more", None, None)]), (1, 1, "assistant", [("audio", None, 1, 38), ("document", "c.pdf", 2, 1024)]),
        (1, 2, "user", []), (2, 0, "", [("document", "c.pdf", 0, 1024), ("image", "a.png", 1, 12)]), (2, 1, "user", []), (None, 0, "user", [("image", "a.png", 0, 12)]),
    ]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert chat.parse_parts(chat.format_turn("user", [text("<image:0>")])[0]) != chat.parse_parts(chat.format_turn("user", [image])[0])


def test_shards_hold_every_row_at_gapless_slots(spark):
    rows = HARD + [(1000 + k, f"t{k} " * (k % 50)) for k in range(500)]
    docs = frame(spark, rows)
    read = lambda **o: spark.read.parquet(sharding.write_shards(docs, 8, bucket_bytes=20_000, **o))
    out = read().select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
    place = lambda o: {(r.doc_id, r.text, r.shard, r.slot) for r in o}
    assert place(read().collect()) == place(out)
    assert place(read(seed=3).collect()) != place(out)
    assert spark.read.parquet(sharding.write_shards(frame(spark, []), 8)).count() == 0


def test_repeated_rows_spread_over_buckets(spark):
    """Rows that repeat would all meet in one bucket; a user's own columns named like ours are kept."""
    rows = [(1, "copy " * 20, "b")] * 600 + [(None, None, "c")] * 300 + [(k, f"t{k}", "d") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bucket string").withColumn("_at", F.lit(5)).withColumn("_copies", F.lit("e"))
    placed, counts = sharding.scattered(docs, 16, 8000, 3, "doc_id", "text", "_own")
    sizes = {r["_own"]: r["count"] for r in placed.groupBy("_own").count().collect()}
    assert [sizes.get(k, 0) for k in range(16)] == counts.tolist()
    assert max(sizes.values()) < 400  # 600 copies in one would be too many bytes
    out = spark.read.parquet(sharding.write_shards(docs, 8, bucket_bytes=8000))
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r["_bucket"]) for r in got) == Counter(rows)
    assert sorted((r.shard, r.slot) for r in got) == [(k, n) for k in range(8) for n in range(150)]


def test_rows_of_one_document_spread_over_buckets(spark):
    """One doc_id and text on a third of the rows, told apart by another column alone."""
    rows = [(1, "copy " * 20, f"v{k}") for k in range(1000)] + [(k, f"text {k} " * 10, "w") for k in range(2, 1002)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string")
    placed, counts = sharding.scattered(docs, 16, 1 << 30, 3, "doc_id", "text", "_own")
    assert counts.sum() == 2000 and counts.max() < 200
    assert placed.where("doc_id = 1").select("_own").distinct().count() == 16
    assert Counter(map(tuple, spark.read.parquet(sharding.write_shards(docs, 8, bucket_bytes=8000)).select("doc_id", "text", "version").collect())) == Counter(rows)


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(k)).tolist()) for k in range(3000))
    assert len(seen) == 6
    assert max(seen.values()) < 1.3 * min(seen.values())


def best_bins(items, room):
    """The least number of bins, by exhaustive search."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in sorted(set(range(len(bins))), key=lambda b: bins[b]):
            if bins[b] + items[k] <= room:
                place(k + 1, bins[:b] + [bins[b] + items[k]] + bins[b + 1 :])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_packing_is_optimal_on_small_cases():
    rng = random.Random(9)
    worse = 0
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(0, 9))), reverse=True)
        found = packing.pack_histogram(dict(Counter(items)), 20)
        assert Counter(x for n, f in found for x in f * n) == Counter(items)
        assert all(sum(f) <= 20 for _, f in found)
        worse += sum(n for n, _ in found) - best_bins(items, 20)
    assert worse == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack_histogram({21: 1}, 20)


def test_packing_goes_back_when_waste_is_used_up():
    assert sum(n for n, _ in packing.pack_histogram(dict(Counter([10, 9, 9, 8, 8, 6, 4, 4, 2])), 20)) == 3
    rng = random.Random(3)
    for _ in range(150):
        items = sorted((rng.randint(2, 11) for _ in range(rng.randint(5, 10))), reverse=True)
        found = packing.pack_histogram(dict(Counter(items)), 20)
        assert Counter(x for n, f in found for x in f * n) == Counter(items)
        assert all(sum(f) <= 20 and f == sorted(f, reverse=True) for _, f in found)
        assert sum(n for n, _ in found) == best_bins(items, 20) >= packing.lower_bound(dict(Counter(items)), 20)


def test_pieces_of_repeated_rows_spread_over_windows(spark, monkeypatch):
    """Rows repeated in id and text are numbered in many windows; their sequences have no gap."""
    seen = []
    keep = packing.checked
    monkeypatch.setattr(packing, "checked", lambda df: (seen.append(df), keep(df))[1])
    got = packing.packed(frame(spark, [(None, "same text")] * 600 + [(k, "other") for k in range(20)]), BYTE, 64, 0, salts=8).toPandas()
    assert len(got) == 620
    assert seen[0].groupBy("of").count().agg(F.max("count")).head()[0] == 8
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        assert part.length.sum() <= 64


def test_packed_pieces(spark):
    rows = HARD + [(30 + k, t) for k, t in enumerate(ODD)] + [(200 + k, "some words here " * k) for k in range(60)]
    got = packing.packed(frame(spark, rows), BYTE, 64, 0, salts=3).toPandas()
    t = library(BYTE)
    want = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 64 + 1
        for p, s in enumerate([0, *range(first, len(ids), 64)]):
            e = first if p == 0 else s + 64
            want[(-1 if i is None else i, p, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += 1
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1
    assert packing.packed(frame(spark, []), BYTE, 64).count() == 0


SKEW = [(k, "hot") for k in range(700)] + [(1000 + k, "a") for k in range(90)] + [(2000 + k, None) for k in range(33)] + [(3000 + k, "z") for k in range(3)] + [(None, "z"), (3000, "z")]


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "a": 3.0, "z": 1.0}])
def test_mixing_stays_within_a_block(spark, weights):
    docs = spark.createDataFrame([(i, s, "x", "clash") for i, s in SKEW], "doc_id long, source string, text string, position string")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    share = {r.source: r.share for r in mixing.shares(sizes, weights, 100).collect()}
    assert sum(share.values()) == 100
    got = mixing.mixed(docs, weights, block_rows=4, period=100).collect()
    assert Counter((r.doc_id, r.source) for r in got).keys() == Counter(SKEW).keys()
    assert all(n >= Counter(SKEW)[k] for k, n in Counter((r.doc_id, r.source) for r in got).items())
    assert len({r.position for r in got}) == len(got)
    order = {}
    for r in got:
        assert order.setdefault(r.slot, r.source) == r.source
    slots = [order[k] for k in range(len(order))]
    for source, w in share.items():
        run = np.cumsum([s == source for s in slots])
        assert np.abs(run - np.arange(1, len(slots) + 1) * w / 100).max() < 1
    out = mixing.mixed_documents(docs, weights, block_rows=4, period=100)
    assert out.columns == docs.columns
    assert out.count() == len(got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def lag(slots, target):
    """By source the largest distance, in blocks, from its target weight."""
    total = sum(target.values())
    return {s: max(abs(np.cumsum([x == s for x in slots]) - np.arange(1, len(slots) + 1) * (w / total))) for s, w in target.items()}


@pytest.mark.parametrize("weights", [{"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, None])
def test_mixing_follows_the_unrounded_weights(spark, weights):
    n = {"a": 2500, "b": 1700, "c": 1100, "d": 700} if weights else {"hot": 1500, **{f"s{k}": 150 + k for k in range(19)}, "one": 1}
    docs = spark.createDataFrame([(k, s) for s, m in n.items() for k in range(m)], "doc_id long, source string")
    got = mixing.mixed(docs, weights, block_rows=1).collect()
    order = {r.slot: r.source for r in got}
    assert len(order) == len(got) > 2000
    assert {(r.doc_id, r.source) for r in got} == {(k, s) for s, m in n.items() for k in range(m)}
    assert max(lag([order[k] for k in range(len(order))], weights or {s: m**0.7 for s, m in n.items()}).values()) < 1 + 1e-9


def earliest_deadline_first(weights, slots):
    """The source of every slot, by a heap of released blocks and one of blocks to come, in whole numbers."""
    total = sum(weights)
    future, ready, out = [(0, k, 0) for k in range(len(weights))], [], []
    heapq.heapify(future)
    for t in range(slots):
        while future and future[0][0] <= t:
            _, k, j = heapq.heappop(future)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[k]), k, j))
        _, k, j = heapq.heappop(ready)
        out.append(k)
        heapq.heappush(future, ((j + 1) * total // weights[k], k, j + 1))
    return out


def test_schedule_goes_on_over_segments(spark, monkeypatch):
    """Segments of 60 slots in folds of 20 give the schedule of one run; no row holds more than its segment."""
    monkeypatch.setattr(mixing, "FOLD", 20)
    monkeypatch.setattr(mixing, "SEGMENT", 60)
    for whole in ([101, 37, 11, 3, 1], [2**40 + 7, 2**39 + 1, 3]):
        rows = mixing.schedule(spark, whole, 250).collect()
        got = sorted((r.slot, r.i, r.j) for r in rows)
        assert [g[0] for g in got] == list(range(260))
        assert [g[1] for g in got] == earliest_deadline_first(whole, 260)
        done = [0] * len(whole)
        for slot, i, j in got:
            assert j == done[i]
            done[i] += 1
            assert all(abs(n * sum(whole) - (slot + 1) * w) < sum(whole) for n, w in zip(done, whole, strict=True))
        plan = mixing.schedule(spark, whole, 250)
        path = plan.inputFiles()[0].rsplit("/segment=", 1)[0]
        assert spark.read.parquet(path).selectExpr("max(aggregate(runs, 0, (n, r) -> n + size(r))) AS n").head().n == 60
    assert mixing.schedule(spark, [], 0).count() == 0


def test_schedule_equals_an_independent_one(spark):
    for whole in ([4, 3, 2, 1], [7, 1], [1], [5, 5, 5], [101, 37, 11, 3, 1]):
        got = mixing.schedule(spark, whole, 700).orderBy("slot").limit(700).collect()
        assert [r.i for r in got] == earliest_deadline_first(whole, 700)
        seen = Counter()
        for r in got:
            assert r.j == seen[r.i]
            seen[r.i] += 1


def test_mixing_of_repeated_and_null_ids(spark):
    """A hot null doc_id with different texts, one row many times, and columns named like ours."""
    rows = [(None, "a", f"t{k}", "p") for k in range(60)] + [(1, "a", "same", "p")] * 30 + [(2, None, "x", "p"), (2, None, "y", "p"), (3, "b", None, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _position string").withColumn("_id", F.lit(1)).withColumn("_hash", F.lit("h"))
    out = mixing.mixed_documents(docs, block_rows=4)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.source, r.text, r["_position"]) for r in out.collect())
    assert got.keys() == set(rows)
    assert all(got[k] >= n for k, n in Counter(rows).items())
    assert sum(got.values()) == mixing.mixed(docs, block_rows=4).count()
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixing_shuffles_texts_once(spark, monkeypatch):
    """Places beyond the broadcast limit don't send whole rows to their keys before their parts of the order; parts, epochs and ties of the hash keep every row."""
    monkeypatch.setattr(mixing, "checked", lambda df: F.broadcast(df) if df.count() <= 1500 else df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("if(id % 25 = 0, null, if(id % 5 = 0, 'b', 'a'))").alias("source"), F.concat(F.lit("text "), "id").alias("text"))
        docs = saved(docs, "docs")
        out = mixing.mixed_documents(docs)
        rows = [(r.doc_id, r.source, r.text) for r in out.collect()]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|shuffle)", plan.split("== Initial Plan ==")[0])) == 1
    assert all(t == f"text {i}" for i, _, t in rows)
    assert {i for i, _, _ in rows} == set(range(5000))
    order = {r.position: r.source for r in mixing.mixed(docs).collect()}
    assert [s for _, s, _ in rows] == [order[k] for k in sorted(order)]
    for source in ("a", "b", None):  # every epoch is whole before the next begins
        own = [i for i, s, _ in rows if s == source]
        n = len(set(own))
        assert all(sorted(own[k : k + n]) == sorted(set(own)) for k in range(0, len(own) - n + 1, n)) and len(set(own[len(own) // n * n :])) == len(own) % n


def test_mixing_of_one_row_many_times(spark):
    docs = spark.createDataFrame([(1, "a", "same")] * 3000 + [(2, "b", "x")], "doc_id long, source string, text string")
    got = Counter((r.doc_id, r.source, r.text) for r in mixing.mixed_documents(docs).collect())
    assert got[1, "a", "same"] >= 3000 and got[2, "b", "x"] >= 1 and sum(got.values()) == mixing.mixed(docs).count()


def test_mixing_takes_more_sources_than_a_period(spark):
    docs = spark.createDataFrame([(k, f"s{k % 1100}") for k in range(1300)], "doc_id long, source string")
    got = mixing.mixed(docs, block_rows=8).collect()
    assert {(r.doc_id, r.source) for r in got} == {(k, f"s{k % 1100}") for k in range(1300)}
    even = docs.groupBy("source").agg(F.count("*").alias("n")).where("n = 2").limit(4)
    names = sorted(r.source for r in even.collect())
    assert {r.source: r.share for r in mixing.shares(even, dict(zip(names, (0.4, 0.3, 0.2, 0.1), strict=True))).collect()} == dict(zip(names, (400, 300, 200, 100), strict=True))


def brute_links(rows):
    fine = {}
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and not any(x is None or not np.isfinite(x) for x in v) and any(v):
            fine[k] = np.array(v, float) / np.linalg.norm(v)
    links = {k: {m for m in fine if m != k and rows[m][2] == rows[k][2] and len(fine[m]) == len(fine[k]) and fine[m] @ fine[k] >= 0.98} for k in fine}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((i, len(links.get(k, ())), min(rows[m][0] for m in seen)))
    return sorted(out)


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(12):
            v = rng.standard_normal(20)
            for _ in range(rng.integers(1, 8)):
                rows.append((n, (v + 0.05 * rng.standard_normal(20)).astype(np.float32).tolist(), label))
                n += 1
    v = rng.standard_normal(20)
    rows += [(n + k, (v + 0.03 * rng.standard_normal(20)).astype(np.float32).tolist(), 1) for k in range(60)]
    n += 60
    rows += [(n + k, rows[0][1], 1) for k in range(5)] + [(n + 5, rows[0][1], None), (n + 6, None, 1), (n + 7, [0.0] * 20, 1), (n + 8, [float("nan")] * 20, 1), (n + 9, [None] + [1.0] * 19, 1), (n + 10, [float("inf")] * 20, 1), (n + 11, [1.0, 2.0], 1), (n + 12, [2.0, 4.0], 1), (n + 13, [], 1)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, key string, codes string")
    rows += [(2, rows[30][1], 2), (2, rows[30][1], 2), (3, rows[60][1], rows[60][2])]  # repeated vec_ids, in one label and in two
    df = df.limit(0).unionByName(spark.createDataFrame([(*r, "clash", "clash") for r in rows], df.schema))
    got = embedding.linked(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding.linked(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths_and_recall_is_high():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    assert np.allclose((embedding.hadamard(x) ** 2).sum(axis=1), 64 * (x**2).sum(axis=1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((400, 64))
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * side
    a, b = embedding.codes(x), embedding.codes(y)
    met = np.any([embedding.meets(a[:, t], b[:, t]) for t in range(a.shape[1])], axis=0)
    assert met.mean() > 0.999


def test_every_pair_that_meets_is_counted_once():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 6, (2, 500, 3, 3))
    places = [[(t, x) for t in range(3) for x in range(6) if x in p[t] and x in q[t] and x in (p[t][0], q[t][0])] for p, q in zip(a, b, strict=True)]
    for t in range(3):
        for x in range(6):
            at = [k for k, p in enumerate(places) if (t, x) in p]
            assert embedding.first_met(a[at], b[at], t, x).tolist() == [places[k][0] == (t, x) for k in at]
    assert [bool(p) for p in places] == np.any([embedding.meets(a[:, t], b[:, t]) for t in range(3)], axis=0).tolist()


def test_links_unite_components():
    rng = np.random.default_rng(5)
    for _ in range(50):
        root, n = np.arange(20), rng.integers(0, 20)
        a, b = rng.integers(0, 20, (2, n))
        for part in (slice(None, 5), slice(5, None)):
            root = embedding.united(root, a[part], b[part])
        want = list(range(20))
        for _ in range(20):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert root.tolist() == want


def test_recall_on_the_given_vectors(spark):
    """Components and links of all embeddings of the table against brute force by label."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = df.toPandas()
    got = embedding.linked(df).toPandas().set_index("vec_id")
    links = 0
    for _, part in table.groupby("label"):
        x = np.array(part.embedding.tolist(), float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        n = (x @ x.T >= 0.98).sum(axis=1) - 1
        links += n.sum()
        assert (got.n_links[part.vec_id].to_numpy() <= n).all()
    assert got.n_links.sum() >= 0.999 * links


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 104)}}
