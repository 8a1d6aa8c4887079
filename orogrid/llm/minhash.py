"""MinHash near-dedup by ProbMinHash over weighted word shingles.

A text's shingles are its runs of five words (a shorter text is one shingle), weighted by how often they occur.
Each shingle is a Poisson process whose rate is its weight: arrivals have exponential gaps and fall into random
registers; a register keeps its earliest arrival's shingle. A shingle stops as soon as its next arrival is later than
the latest register, which is early for all but few. Two texts agree in a register with the probability of
their probability Jaccard, sum over common shingles i of 1 / sum_j max(a_j/a_i, b_j/b_i), which is the Jaccard
index where weights are equal. Registers are banded (26 bands of 5: a pair at 0.8 is missed with probability 3e-5).
Candidates whose registers agree in less than 64 % (4.5 standard deviations below 0.8) fall away; the rest are
verified by the exact similarity of their whole texts.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, checked, connected_components, lean, new_names, on_runs, released, saved
from .words import U64, Words, mix, text_slices

BANDS, ROWS, SHINGLE = 26, 5, 5
#: Share of agreeing registers from which a candidate is verified.
AGREE = 0.64
#: Members of a bucket in one block, and bytes of their shingles: two blocks meet in a task, with a few matrices of BLOCK_ROWS ** 2 bytes.
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20
_STEP = U64(0xA24BAED4963EE407)


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, count) of a slice, sorted by doc and shingle; texts of 1 to k-1 words have one shingle."""
    at, gram = words.grams(k)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        doc, gram = np.concatenate((doc, short)), np.concatenate((gram, words.whole(11)[short]))
    order = np.argsort(gram, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    doc, gram = doc[order], gram[order]
    if not len(doc):
        return doc, gram, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]))))
    return doc[head], gram[head], np.diff(np.append(head, len(doc)))


def signatures(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n_docs, m) shingles that hold the registers; rows of texts without shingles are 0."""
    first = np.full(n_docs * m, np.inf)
    holder = np.zeros(n_docs * m, U64)
    alive = np.arange(len(doc))
    arrival = np.zeros(len(doc))
    latest = np.full(n_docs, np.inf)
    step = 0
    while len(alive):
        step += 1
        u = mix(gram[alive] + U64(step * int(_STEP) % (1 << 64)))
        arrival = arrival - np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / count[alive]
        early = arrival < latest[doc[alive]]
        alive, arrival, u = alive[early], arrival[early], u[early]
        if not len(alive):
            break
        register = doc[alive] * m + (mix(u ^ _STEP) % U64(m)).astype(np.int64)
        np.minimum.at(first, register, arrival)
        won = first[register] == arrival
        holder[register[won]] = gram[alive[won]]
        touched = np.unique(doc[alive])
        latest[touched] = first.reshape(n_docs, m)[touched].max(axis=1)
    return holder.reshape(n_docs, m)


def band_hashes(sign: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    total = np.zeros((len(sign), bands), U64) + np.arange(1, bands + 1, dtype=U64)
    for r in range(rows):
        total = mix(total * _STEP + sign.reshape(len(sign), bands, rows)[:, :, r])
    return total


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact, in n log n: shingles a and b ascend without repeats, w are their counts."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    lower = np.searchsorted(ratio, ratio, "left")
    sum_x, sum_y = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(y)))
    only_a, only_b = wa.sum() - sum_x[-1], wb.sum() - sum_y[-1]
    return float(np.sum(1 / ((sum_x[-1] - sum_x[lower] + only_a) / x + (sum_y[lower] + only_b) / y)))


def similar(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, threshold: float) -> bool:
    """Whether the probability Jaccard is at least the threshold, by exact numbers: the decimal that the threshold is written as.

    Where all counts are one it is a quotient of whole numbers; else the sum of reciprocals is rational, and it is added up as such only
    where the float sum is too near the threshold to tell.
    """
    t = Fraction(repr(float(threshold)))
    if int(wa.max(initial=1)) == int(wb.max(initial=1)) == 1:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common * t.denominator >= t.numerator * (len(a) + len(b) - common) if common else t <= 0
    near = probability_jaccard(a, wa, b, wb)
    if abs(near - threshold) > 1e-9:
        return near > threshold
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    pairs = Counter(zip(wa[ia].tolist(), wb[ib].tolist(), strict=True))
    only_a, only_b = int(wa.sum()) - sum(x * n for (x, _), n in pairs.items()), int(wb.sum()) - sum(y * n for (_, y), n in pairs.items())
    total = Fraction(0)
    for (x, y), n in pairs.items():  # 1 / sum over j of max(a_j / x, b_j / y)
        total += Fraction(n * x * y, only_a * y + only_b * x + sum(m * max(u * y, v * x) for (u, v), m in pairs.items()))
    return total >= t


def near_classes(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, class_id, kept, k1, k2 for every row: classes are components of links of similarity >= threshold.

    The class id is the smallest doc_id of the class, and that document is the one kept. Texts with the same words in
    the same order are one member, named by two 64-bit hashes of its words (k1, k2), whatever their doc_ids; rows that repeat a doc_id
    with another text stand in that text's class. A text without words (null, empty, punctuation) is a class of its
    own. A null doc_id gets a null class and is kept. An empty table gives no rows, other columns are ignored. In a bucket every
    member is first compared with its smallest member; then only members whose components still differ are, in block
    pairs that verify where they stand, so that no task holds a whole large bucket and pairs are never rows.
    """
    with released(docs.sparkSession):
        return saved(_classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), threshold), "near", keep=True)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``near_classes`` of (doc_id, text), read from tables that go with the caller's ``released`` block."""
    spark = docs.sparkSession
    bounded_batches(spark)

    @lean
    def sketch(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                sign = signatures(*shingles(words), hi - lo)
                bands = pa.array(band_hashes(sign).view(np.int64).ravel())
                short = pa.array([x.tobytes() for x in sign.astype("<u4")], pa.binary())
                step = pa.array(np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(words.count.astype(np.int64)), *(pa.array(words.whole(s).view(np.int64)) for s in (1, 2)), pa.ListArray.from_arrays(step, bands), short]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "k1", "k2", "bands", "sign"])

    rows = saved(docs.mapInArrow(sketch, "doc_id long, n_words long, k1 long, k2 long, bands array<long>, sign binary"), "sketches")
    fit = rows.where("n_words > 0 and doc_id is not null")
    members = fit.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_words", "bands", "sign")).alias("x")).select("k1", "k2", "x.*")
    members = saved(members.withColumn("rep", F.monotonically_increasing_id()), "members")  # a number that is read back from the table
    entries = members.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = saved(entries.groupBy("band", "hash").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1"), "buckets")
    inside = saved(entries.join(checked(buckets.select("band", "hash", "leader")), ["band", "hash"]), "inside")
    star = saved(inside.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = verified(docs, agreeing(star, members), members, threshold)
    comp = connected_components(links)
    now = inside.join(checked(comp.withColumnRenamed("id", "rep")), "rep", "left").select("band", "hash", "rep", F.coalesce("component", "rep").alias("c"))
    now = saved(now, "split")
    parts = now.groupBy("band", "hash").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("band", "hash")
    open_ = saved(now.join(checked(saved(parts, "open")), ["band", "hash"], "left_semi").join(members.select("rep", "n_words", "bands", "sign"), "rep"), "open")
    large = F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_words") * 12 / BLOCK_BYTES)
    sizes = checked(saved(open_.groupBy("band", "hash").agg(F.ceil(large).cast("int").alias("blocks")), "sizes"))
    blocks = open_.join(sizes, ["band", "hash"])
    blocks = blocks.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    rest = saved(facing(blocks), "facing")
    grams = weights(docs, saved(rest.select("rep").distinct(), "wanted"), members)
    more = saved(verified_blocks(rest.join(members.select("rep", "bands", "sign"), "rep").join(grams, "rep"), threshold), "links")
    comp = connected_components(links.unionByName(more)).withColumnRenamed("id", "rep")
    named = saved(members.select("rep", "k1", "k2", "doc_id").join(checked(comp), "rep", "left"), "named")
    first = saved(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("first")), "first")
    classes = named.join(checked(first), "component", "left").select("k1", "k2", F.coalesce("first", "doc_id").alias("class_id"))
    out = rows.select("doc_id", "n_words", "k1", "k2").join(classes, ["k1", "k2"], "left")
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    return out.select("doc_id", "n_words", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "k1", "k2")


def agreeing(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers agree in a share of at least ``AGREE``."""

    @lean
    def compare(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= AGREE if len(x) else [], pa.bool_()))

    left, right = (members.select(F.col("rep").alias(s), F.col("sign").alias(f"s{s}")) for s in "ab")
    return saved(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long"), "agreeing")


_KEYS = ["band", "hash", "lo", "hi"]


def _candidates(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of a block pair that agree, lie in different components and meet in no earlier band."""
    c, mine = run.column("c").to_numpy(), run.column("mine").to_numpy()
    sign = np.frombuffer(b"".join(run.column("sign").to_pylist()), "<u4").reshape(run.num_rows, -1)
    bands = run.column("bands").combine_chunks().flatten().to_numpy().reshape(run.num_rows, -1)
    left, right = np.flatnonzero(mine == run.column("lo")[0].as_py()), np.flatnonzero(mine == run.column("hi")[0].as_py())
    agree = np.zeros((len(left), len(right)), np.int16)
    for r in range(sign.shape[1]):
        agree += sign[left, r][:, None] == sign[right, r][None, :]
    x, y = np.nonzero((agree >= AGREE * sign.shape[1]) & (c[left][:, None] != c[right][None, :]))
    x, y = left[x], right[y]
    first = np.ones(len(x), bool)
    for band in range(run.column("band")[0].as_py()):
        first &= bands[x, band] != bands[y, band]
    return x[first], y[first]


def facing(blocks: DataFrame) -> DataFrame:
    """The rows of each block pair that have a candidate partner there."""
    columns = [*_KEYS, "rep", "c", "mine"]

    def work(run: pa.Table) -> pa.Table:
        return run.take(pa.array(np.unique(np.concatenate(_candidates(run))))).select(columns)

    return on_runs(blocks.select(*columns, "bands", "sign"), _KEYS, work, "band int, hash long, lo int, hi int, rep long, c long, mine int")


def verified_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of at least the threshold that join the candidates of every block pair, a tree of each group they form."""

    def work(run: pa.Table) -> pa.Table:
        ids, root = run.column("rep").to_numpy(), np.arange(run.num_rows)
        gram, count = ([x.values.to_numpy() for x in run.column(n).combine_chunks()] for n in ("gram", "count"))
        once = [int(x.max(initial=1)) == 1 for x in count]

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for x, y in zip(*(k.tolist() for k in _candidates(run)), strict=True):
            a, b = top(x), top(y)
            if a == b or once[x] and once[y] and min(len(gram[x]), len(gram[y])) < (threshold - 1e-9) * max(len(gram[x]), len(gram[y])):
                continue
            if similar(gram[x].view(U64), count[x], gram[y].view(U64), count[y], threshold):
                root[max(a, b)] = min(a, b)
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return on_runs(blocks.select(*_KEYS, "rep", "c", "mine", "bands", "sign", "gram", "count"), _KEYS, work, "a long, b long")


def weights(docs: DataFrame, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, gram, count): the sorted shingles of the wanted members (a saved table of reps), as a saved table."""

    @lean
    def weigh(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                doc, gram, count = shingles(words)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (gram.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(pa.array(words.whole(s).view(np.int64)) for s in (1, 2)), *lists], ["k1", "k2", "gram", "count"])

    named = saved(members.select("rep", "k1", "k2", "doc_id").join(checked(wanted), "rep", "left_semi"), "named")
    texts = docs.join(checked(named.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(weigh, "k1 long, k2 long, gram array<long>, count array<int>")
    found = texts.join(checked(named.select("rep", "k1", "k2")), ["k1", "k2"]).select("rep", "gram", "count")
    return saved(found.dropDuplicates(["rep"]), "weights")


def verified(docs: DataFrame, pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of members whose whole texts have at least the similarity; ``pairs`` is a saved table."""
    wanted = saved(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "wanted")
    texts = weights(docs, wanted, members)

    @lean
    def compare(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, wx, y, wy = (batch.column(c)[i].values.to_numpy() for c in ("gram_a", "count_a", "gram_b", "count_b"))
                keep.append(similar(x.view(U64), wx, y.view(U64), wy, threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("rep").alias(s), F.col("gram").alias(f"gram_{s}"), F.col("count").alias(f"count_{s}")) for s in "ab")
    return saved(pairs.join(left, "a").join(right, "b").select("a", "b", "gram_a", "count_a", "gram_b", "count_b").mapInArrow(compare, "a long, b long"), "links")


def near_deduplicated(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: of each class the rows of the document with the smallest doc_id.

    Null and empty texts and null doc_ids stay. Where rows repeat a doc_id with texts of different classes, each goes or stays by its own
    text. Rows repeated with one doc_id and text all stay. An empty table gives no rows.
    """
    own, k1, k2 = new_names(docs, "id", "k1", "k2")
    with released(docs.sparkSession):
        found = saved(_classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), threshold), "classes")
        gone = saved(found.where("not kept").select(F.col("doc_id").alias(own), F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "gone", keep=True)
        both = found.where("kept").join(checked(gone), F.col("doc_id") == F.col(own), "left_semi").limit(1).count()
    same_id = F.col(doc_id).cast("long") == F.col(own)
    if not both:  # no document that goes has another text that stays
        return docs.join(checked(gone.select(own).distinct()), same_id, "left_anti")
    at = docs.columns.index(text)

    @lean
    def name(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                words = Words(data, offsets)
                keys = [pa.array(words.whole(s).view(np.int64)) for s in (1, 2)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *keys], [*batch.schema.names, f"{k1}_", f"{k2}_"])

    schema = StructType([*docs.schema.fields, StructField(f"{k1}_", LongType()), StructField(f"{k2}_", LongType())])
    rows = docs.mapInArrow(name, schema)
    return rows.join(checked(gone), same_id & (F.col(f"{k1}_") == F.col(k1)) & (F.col(f"{k2}_") == F.col(k2)), "left_anti").select(*[rows[c] for c in docs.columns])
