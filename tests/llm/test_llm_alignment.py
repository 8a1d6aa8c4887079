"""Aligned tokenizers against the plain libraries and counters."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orogrid.llm import alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a ", " a", "a  b", "a \n b", "x\n", "don't  we'll", "<|endoftext|> hi <s>", "</s>", "a▁b", "▁", "<0x41>", "ﬁ ①", "é é", "　w", "\x00a", "tab\tx", "中文 🙂", "the the the the"]
SIGNS = [" ", " ", "  ", "\n", *"aB1.,'<T\x00\t", "the", "tion", " of", *"éß中🙂́ ", "▁", "<|endoftext|>", "<s>", "<0x0A>"]


def plain(texts):
    """Per text (A ids, B ids, groups, links) from the libraries, or None."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    chars = alignment._byte_chars()
    byte = {c: i for i, c in enumerate(chars)}
    name = {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bx = [bytes(byte[c] for c in name[i]) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
            out.append(None)
            continue
        ends = [np.cumsum([len(p) for p in z]).tolist() for z in (bx, by)]
        spans = [list(zip([0, *e], e, ids, strict=False)) for e, ids in zip(ends, (x, y), strict=True)]
        links = []
        for lo, hi, i in spans[0]:
            links += [(i, j) for from_, to, j in spans[1] if max(lo, from_) < min(hi, to)]
        groups, last = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for _, to, i in s if last < to <= cut) for s in spans))
            last = cut
        out.append((x, y, groups, links))
    return out


def brute(rows):
    found = plain([t for _, t in rows])
    count = Counter(p for x in found if x for p in x[3])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    for (i, _), x in zip(rows, found, strict=True):
        if x is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = x
            yield i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()


def result(df):
    return sorted(map(repr, (tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())))


def hard():
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(800)), "the end of it " * 3000, *["the same text again"] * 300]
    return [(None if k % 97 == 0 else k // 2, t) for k, t in enumerate(texts)]


def test_alignment_equals_the_libraries(spark):
    rows = hard()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "'x' AS pair", "2 AS number").repartition(3)
    assert result(alignment.alignment(df, BYTE, PIECE)) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("docs", [64, 4096])
def test_bitmaps_hold_every_link(monkeypatch, docs):
    """Stacks of bitmaps give the same links for every (text, pair) as counting does; blocks of 64 have bitsets from four documents on."""
    monkeypatch.setattr(alignment, "BLOCK_DOCS", docs)
    rows = hard()
    a, b = alignment.Lossless(BYTE), alignment.Pieces(PIECE)
    column = pa.array([" " + t if t else "" for _, t in rows])
    want = [Counter(x[3]) if x else Counter() for x in plain([t for _, t in rows])]
    for lo in range(0, len(rows), docs):
        (_, _, *x), (_, _, *y) = (next(e.encode(column.slice(lo, docs), 1 << 30)) for e in (a, b))
        pair, stacks, total, n = alignment.planes_of(*alignment.Links(x, y, (a.lengths, b.lengths)).entries(0))
        row, number, times = alignment.numbers_in(stacks)
        got = [Counter() for _ in range(docs)]
        for r, k, m in zip(row.tolist(), number.tolist(), times.tolist(), strict=True):
            got[k][int(pair[r]) >> 16, int(pair[r]) & 65535] += m
        part = want[lo : lo + docs]
        assert got[: len(part)] == part
        for p, t, m in zip(pair.tolist(), total.tolist(), n.tolist(), strict=True):
            key = p >> 16, p & 65535
            assert (t, m) == (sum(c[key] for c in part), sum(key in c for c in part))


def test_no_rows_and_no_tokens(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(empty, BYTE, PIECE).count() == 0
    assert result(alignment.alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), BYTE, PIECE)) == sorted(map(repr, brute([(1, None), (2, "")])))
