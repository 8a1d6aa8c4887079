"""Best-fit packing by bin completion over the histogram of lengths.

Sequences hold ``capacity`` tokens, so pieces have at most ``capacity`` different lengths: whatever the number of
documents, the problem is a table of (length, count) of bounded size, and it is solved once. The incumbent is the better
of a whole best-fit-decreasing solution and a greedy bin completion. If it has more sequences than the lower bound, a
branch and bound goes over the undominated fillings of the largest length left (a filling is dominated if one or two of
its members could be exchanged for a longer piece that fits), rejects those that waste more than the incumbent still
allows, and goes back when none is left. It proves its result unless it meets its limit of ``SEARCH_NODES``; then the incumbent
stands. The result is a list of patterns with multiplicities; documents then take their places by their rank within
their length, which Spark counts in two levels so that no length, however common, meets in one task.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checked, lean, saved
from .tokens import encoder, with_end

#: Nodes that the greedy search for one filling may visit, and those of the whole branch and bound (a state counts as a quarter of its
#: number of lengths); beyond them the incumbent stands.
FILLING_NODES, SEARCH_NODES = 400, 500_000


def complete(room: int, lengths: list[int], left: dict[int, int], allowed: int, nodes: int = FILLING_NODES) -> list[int]:
    """The filling of ``room`` that wastes least: lengths with repeats, largest first. ``lengths`` ascends.

    Stops at the first filling without waste. A filling that wastes no more than ``allowed`` beats one that has fewer
    and longer members only if it wastes less, so short pieces are saved for later rooms.
    """
    best: list[int] = []  # incumbent: best fit, the longest piece that fits each time
    rest, used = room, {}
    at = bisect.bisect_right(lengths, rest) - 1
    while at >= 0:
        x = lengths[at]
        n = min(left[x], rest // x)
        best += [x] * n
        rest -= x * n
        used[x] = n
        at = min(at - 1, bisect.bisect_right(lengths, rest) - 1)
    waste, seen = rest, 0

    def search(rest: int, top: int, chosen: list[int]) -> bool:
        nonlocal best, waste, seen
        at = min(top, bisect.bisect_right(lengths, rest) - 1)
        extended = False
        while at >= 0:
            seen += 1
            if seen > nodes:
                return True
            x = lengths[at]
            n = min(left[x], rest // x)
            for k in range(n, 0, -1):
                extended = True
                if search(rest - k * x, at - 1, chosen + [x] * k):
                    return True
            # without x: x fits twice beside a filling good enough, so those with only shorter members are dominated
            if waste <= allowed and x <= rest // 2:
                break
            at -= 1
        if not extended and rest < waste:
            best, waste = chosen, rest
        return waste == 0

    if waste > 0:
        search(room, len(lengths) - 1, [])
    return best


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and by pieces over half a sequence with those that fit beside none of them."""
    lengths = sorted(x for x, n in counts.items() if n > 0)
    best = -(-sum(x * counts[x] for x in lengths) // capacity)
    large = [x for x in lengths if 2 * x > capacity]
    for k in {0, *(x for x in lengths if 2 * x <= capacity)}:
        room = sum((capacity - x) * counts[x] for x in large if x <= capacity - k)
        rest = sum(x * counts[x] for x in lengths if k <= x and 2 * x <= capacity)
        best = max(best, sum(counts[x] for x in large) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit decreasing on groups of equal sequences: each piece goes where it leaves least room."""
    groups: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def add(room: int, n: int, filling: list[int]) -> None:
        if n:
            if room not in groups:
                bisect.insort(rooms, room)
            groups.setdefault(room, []).append((n, filling))

    for x in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        n = counts[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            room, have, filling = capacity, n, []
            if at < len(rooms):
                room = rooms[at]
                have, filling = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // x
            full = min(have, n // each)
            add(room - each * x, full, filling + [x] * each)
            n, have = n - full * each, have - full
            if n and have:
                add(room - n * x, 1, filling + [x] * n)
                n, have = 0, have - 1
            if filling:
                add(room, have, filling)
    return [g for room in rooms for g in groups[room]]


def greedy(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Bin completion without going back: every filling is used as often as the counts allow."""
    left = {x: n for x, n in counts.items() if n > 0}
    lengths = sorted(left)
    total = sum(x * n for x, n in left.items())
    spare = -(-total // capacity) * capacity - total
    out: list[tuple[int, list[int]]] = []
    while lengths:
        x = lengths[-1]
        left[x] -= 1
        if not left[x]:
            lengths.pop()
        filling = [x, *complete(capacity - x, lengths, left, max(0, spare))]
        left[x] += 1
        if left[x] == 1:
            lengths.append(x)
        need: dict[int, int] = {}
        for y in filling:
            need[y] = need.get(y, 0) + 1
        repeats = min(left[y] // n for y, n in need.items())
        for y, n in need.items():
            left[y] -= n * repeats
            if not left[y]:
                lengths.pop(bisect.bisect_left(lengths, y))
        spare -= (capacity - sum(filling)) * repeats
        out.append((repeats, filling))
    return out


def fillings(x: int, left: dict[int, int], capacity: int, allowed: int) -> Iterator[tuple[int, list[int]] | None]:
    """(waste, filling) for each undominated filling around the length x that wastes at most ``allowed``; None for other nodes."""
    lengths = sorted(y for y, n in left.items() if n > (y == x))
    free = {y: left[y] - (y == x) for y in lengths}
    below = list(itertools.accumulate((y * free[y] for y in lengths), initial=0))

    def available(low: int, high: int) -> bool:
        return any(free[z] for z in lengths[bisect.bisect_left(lengths, low) : bisect.bisect_right(lengths, high)])

    def dominated(rest: int, chosen: list[int]) -> bool:
        if available(1, rest):
            return True
        if any(available(y + 1, y + rest) for y in set(chosen) if rest):
            return True
        return len(chosen) <= 12 and any(available(y + z, y + z + rest) for y, z in set(itertools.combinations(chosen, 2)))

    todo: list[tuple[int, int, tuple[int, ...]]] = [(capacity - x, len(lengths), ())]
    while todo:  # larger lengths and more of them first
        rest, top, taken = todo.pop()
        top = min(top, bisect.bisect_right(lengths, rest))
        if rest - below[top] > allowed:
            yield None
            continue
        if top == 0:
            chosen = [y for y, k in zip(taken[::2], taken[1::2], strict=True) for _ in range(k)]
            for y in chosen:
                free[y] -= 1
            bad = rest > allowed or dominated(rest, chosen)
            for y in chosen:
                free[y] += 1
            yield None if bad else (rest, [x, *chosen])
            continue
        yield None
        y = lengths[top - 1]
        todo.append((rest, top - 1, taken))
        todo += [(rest - k * y, top - 1, (*taken, y, k)) for k in range(1, min(free[y], rest // y) + 1)]


def improved(counts: dict[int, int], capacity: int, best: list[tuple[int, list[int]]], enough: int, nodes: int) -> list[tuple[int, list[int]]]:
    """A packing of fewer sequences than ``best``, down to ``enough``, by branch and bound; ``best`` if there is none or the nodes run out."""
    left = {x: n for x, n in counts.items() if n > 0}
    total = sum(x * n for x, n in left.items())
    bins = sum(n for n, _ in best)
    failed: dict[tuple, int] = {}
    seen, wasted = 0, 0
    out: list[tuple[int, list[int]]] = []

    def branches() -> Iterator[tuple[int, int, list[int]]]:
        """(waste, repeats, filling): batches of nodes, the least waste first in each."""
        nonlocal seen
        x = max(left)
        search = fillings(x, left.copy(), capacity, (bins - 1) * capacity - total - wasted)
        while batch := list(itertools.islice(search, FILLING_NODES)):
            seen += len(batch)
            for waste, filling in sorted((f for f in batch if f), key=lambda f: f[0]):
                need = {y: filling.count(y) for y in set(filling)}
                for repeats in range(min(left[y] // n for y, n in need.items()), 0, -1):
                    yield waste, repeats, filling

    def use(repeats: int, filling: list[int]) -> None:
        for y in filling:
            left[y] = left.get(y, 0) - repeats
            if not left[y]:
                del left[y]

    stack = [branches()] if left else []
    while stack and seen < nodes and bins > enough:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if out:
                repeats, filling = out.pop()
                wasted -= repeats * (capacity - sum(filling))
                use(-repeats, filling)
            continue
        waste, repeats, filling = step
        seen += 1
        if wasted + waste * repeats > (bins - 1) * capacity - total:
            continue
        use(repeats, filling)
        wasted += waste * repeats
        out.append((repeats, filling))
        state = tuple(sorted(left.items()))
        if not left:
            best, bins = list(out), sum(n for n, _ in out)
        if not left or failed.get(state, wasted + 1) <= wasted:
            out.pop()
            wasted -= waste * repeats
            use(-repeats, filling)
            continue
        failed[state] = wasted
        seen += len(left) // 4  # a state costs time by its lengths
        stack.append(branches())
    return best


def pack_histogram(counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES) -> list[tuple[int, list[int]]]:
    """(repeats, lengths of one sequence, largest first) that use every length as often as it counts.

    The fewest sequences, unless the branch and bound needs more than ``nodes``.
    """
    if any(not 0 < x <= capacity for x, n in counts.items() if n > 0):
        raise ValueError("lengths must be from 1 to the capacity")
    enough = lower_bound(counts, capacity)
    best: list[tuple[int, list[int]]] | None = None
    for solve in (greedy, best_fit):
        found = solve(counts, capacity)
        if best is None or sum(n for n, _ in found) < sum(n for n, _ in best):
            best = found
        if sum(n for n, _ in best) == enough:
            return best
    return improved(counts, capacity, best, enough, nodes)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: only longer documents are cut, their first piece may be short.

    Null texts are empty (one piece, the end id), null doc_ids stay null, repeated rows give their pieces again, an empty table gives none.
    """
    bounded_batches(docs.sparkSession)

    @lean(keep_held=True)
    def cut(batches):
        tokens = encoder(tokenizer)
        for batch in batches:
            for lo, hi, ids, offsets in tokens.encode(batch.column(1)):
                ids, offsets = with_end(ids.astype("<u4"), offsets, end_id)
                n = np.diff(offsets)
                count, first = -(-n // capacity), (n - 1) % capacity + 1
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                data, at = memoryview(ids).cast("B"), 4 * (offsets[row] + start)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), *(pa.array(c).cast(t) for c, t in zip((piece, start, length, np.array(crc, np.int64)), _PIECE_TYPES[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, _PIECE_NAMES)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, salts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and offset; offsets of a sequence leave no gap.

    Null texts are empty (a document is then its end id alone), null doc_ids and repeated rows are pieces like
    others, an empty table gives no rows, other columns are ignored. Pieces of one length are numbered by (length, salt), the salt from a row
    number that is read back from a written table. Only the counts by length (at most ``capacity``) come to the driver.
    """
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer, capacity, end_id, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "pieces")
    salts = salts or max(64, cut.count() // 50_000_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    cells = saved(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "cells")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(cells.select(F.col("length").alias("of"), F.col("salt").alias("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    #: by length: first ranks, first sequence, offset and copies of each run of equal places
    runs: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in counts}
    rank, sequence = dict.fromkeys(counts, 0), 0
    for repeats, filling in pack_histogram(counts, capacity):
        offset, i = 0, 0
        while i < len(filling):
            x = filling[i]
            n = filling.count(x)
            runs[x].append((rank[x], sequence, offset, n))
            rank[x] += n * repeats
            offset, i = offset + n * x, i + n
        sequence += repeats
    run_arrays = {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}
    shared = spark.sparkContext.broadcast(run_arrays)
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")))
    ranked = ranked.join(checked(bases), (F.col("length") == F.col("of")) & (F.col("salt") == F.col("part"))).withColumn("rank", F.col("base") + F.col("rn") - 1)

    @lean
    def place(batches):
        run_arrays = shared.value
        for batch in batches:
            length, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, sequence, offset, n = run_arrays[int(x)]
                rank = ranks[at]
                k = np.searchsorted(first, rank, "right") - 1
                inside = rank - first[k]
                seq[at], off[at] = sequence[k] + inside // n[k], offset[k] + inside % n[k] * x
            out = batch.select(_PIECE_NAMES)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(seq), pa.array(off)], [*_PIECE_NAMES, "sequence_id", "offset"])

    return ranked.select(*_PIECE_NAMES, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
