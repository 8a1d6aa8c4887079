"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from orogrid.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def steps(tree, j):
    out = []
    for x in tree[:-1]:
        low = j // 16 * 16
        out.append(("".join(x[low:j]), "".join(x[j + 1 : low + 16])))
        j //= 16
    return out


def manifest(rows):
    by = defaultdict(list)
    for row in rows:
        i, text = row[0], row[4]
        hit = i is not None and text is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by[row[1]].append(((i is not None, i or 0), leaf(row), leaf((*row[:4], text.translate(LOWER))) if hit else leaf(row), i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for j, (_, own, other, i) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            path = steps(trees[s], j) + steps(top, k)
            for left, right in path:
                other = digest(left + other + right)
            yield i, own, trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), other, other == top[-1][0]


HARD = [
    *[(i, "big", "en", i % 7, f"Text {i}") for i in range(300)],  # three levels
    *[(i, "edge", None, None, "A" * (i % 3)) for i in range(-8, 9)],  # 17 leaves: the last run is one node
    (5, None, "de", 3, "Üb€r"), (None, "nulls", None, None, None), (None, "nulls", None, None, "X"), (9, "twins", "en", 1, "Same"), (9, "twins", "en", 1, "Same"), (9, "twins", "en", 1, "Other"), (1, "", "", 0, ""), (2, "-", "-", 1, "-"), (3, "long", "en", 1, "Word " * 50_000),
]


def result(df):
    return sorted(map(repr, (tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())))


@pytest.mark.parametrize("rows", [HARD, HARD[:1], [(i, f"s{i}", "en", 1, "A") for i in range(18)]], ids=["hard", "one", "many sources"])
def test_manifest_equals_a_plain_tree(spark, rows):
    assert result(merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))) == sorted(map(repr, manifest(rows)))


def test_no_rows(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_columns_of_the_same_names_are_ignored(spark):
    df = spark.createDataFrame(HARD[290:], SCHEMA)
    more = df.selectExpr("*", "1 AS tree", "2 AS rank", "3 AS _row", "4 AS digest", "5 AS changed", "6 AS n")
    assert result(merkle.merkle_manifest(more)) == result(merkle.merkle_manifest(df)) == sorted(map(repr, manifest(HARD[290:])))


def test_one_changed_letter_breaks_the_proof(spark):
    got = merkle.merkle_manifest(spark.createDataFrame([(i, "s", "en", 1, "Aa") for i in range(40)], SCHEMA)).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
