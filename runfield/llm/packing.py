"""Best-fit packing of documents into sequences by bin completion with branch and bound.

A document's ids and an end id are one piece, or pieces of ``capacity`` and a rest where they are longer. Pieces are
packed in groups of about ``group_pieces``. Within a group, a node of the search takes the largest piece left and
enumerates fillings around it: those that no other piece left could improve (undominated), least waste first, then fewest
pieces. Best-fit decreasing gives the first incumbent; if it meets the lower bound (that of Martello and Toth), it is the
answer. Otherwise descents without going back follow one filling at each node: first the one of fewest and largest pieces,
then, ``DRAWS`` times, fillings drawn so that what is left keeps its mix of lengths; then fillings that put long pieces with
each other, for several notions of long. Then branch and bound: a branch is cut
off as soon as its waste is more than an answer with one sequence fewer than the incumbent may have. A quick search looks at
a few fillings of a node only and gives up after ``STALLED`` nodes without a better answer; a second one enumerates all
undominated fillings of any number of pieces, so that an answer found before the nodes are used up is the least possible.
The search ends when the incumbent meets the bound or after ``nodes`` nodes; ``over_bound`` says by how many sequences the
answer for a row's group is above its bound (0: none can have fewer).

Scale: texts are encoded in one narrow map; only (doc_id, piece, start, length, crc) is shuffled, by a hash of the row's
place in the written table of pieces, so groups are even whatever is repeated. A group at its bound wastes less than one
sequence; with thousands of pieces in a group that is below 0.02 %.

Defined cases: a null or empty text is the end id alone; pieces of equal length (ties) are taken in the order of the written
table of pieces; a very long text is many pieces, of which all but the last fill a sequence each; repeated rows and ids are packed each for itself; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfield.llm.common import id_and_text, map_batches
from runfield.sources.shared import written
from runfield.llm.encoding import encoder

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
GROUP_PIECES = 16_384
NODES = 20_000
#: Fillings that a node of the quick search branches on at most, best first.
BRANCHES = 6
#: Shares of the pieces that a descent does not take as long, and the finest step between those tried.
SHARES, FINEST = (0.5, 0.6, 0.7, 0.8, 0.9), 0.01
#: Descents by drawn fillings, and nodes of the quick search after which it gives up unless it found a better answer.
DRAWS, STALLED = 3, 5_000
#: Steps of an enumeration that count as one node, and nodes of a path that keep theirs; others start again if gone back to.
STEPS, KEPT = 64, 64


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, ids, upto in encoder(vocabulary).encoded(batch.column(1), end_id):
            size, many = np.diff(upto), -(-np.diff(upto) // capacity)
            row = np.repeat(np.arange(j - i), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            crcs = [zlib.crc32(ids[a : a + n]) for a, n in zip((upto[row] + start).tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(id_and_text(docs, id_col, text_col), work, "doc_id long, piece int, start long, length long, ids_crc32 long", keeps=True)


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound on the bins for count[n] pieces of each length n."""
    lengths = np.arange(len(count))
    number, total = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * lengths)))
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    k = np.arange(0, half + 1)
    big = number[-1] - number[capacity - k + 1]
    middle, middle_sum = number[capacity - k + 1] - number[half + 1], total[capacity - k + 1] - total[half + 1]
    small_sum = total[half + 1] - total[k]
    extra = np.maximum(0, -(-(small_sum - (middle * capacity - middle_sum)) // capacity))
    return max(best, int((big + middle + extra).max()))


def best_fit_decreasing(count: np.ndarray, capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    rooms, by_room = [], defaultdict(list)
    for length in range(len(count) - 1, 0, -1):
        for _ in range(int(count[length])):
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, b = capacity, len(bins)
                bins.append([])
            else:
                room = rooms[k]
                b = by_room[room].pop()
                if not by_room[room]:
                    del rooms[k]
            bins[b].append(length)
            room -= length
            if room:
                if not by_room[room]:
                    insort(rooms, room)
                by_room[room].append(b)
    return bins


class _Left:
    """The pieces left, by length."""

    def __init__(self, count: np.ndarray):
        self.count = count.astype(np.int64).copy()
        self.size = len(count)

    def below(self) -> np.ndarray:
        """For each n, the greatest length left that is at most n; 0 if none."""
        return np.maximum.accumulate(np.where(self.count > 0, np.arange(self.size), 0))

    def largest(self) -> int:
        there = np.flatnonzero(self.count)
        return int(there[-1]) if len(there) else 0


def fillings(left: _Left, room: int, branches: int = BRANCHES) -> list[tuple[int, ...]]:
    """Undominated sets of lengths left whose sum is at most ``room``: least waste first, then fewest pieces.

    While more than three of the largest pieces left fit, one of them is taken as given. Of the rest, all sets of one or
    two pieces are looked at, and sets of three around each of the largest few first pieces.
    """
    taken: list[int] = []
    count, below = left.count, left.below()
    while True:
        top = int(below[room]) if room > 0 else 0
        if not top or room < 4 * top:
            break
        many = min(int(count[top]), room // top - 3)
        taken += [top] * many
        count[top] -= many
        room -= many * top
        below = left.below()
    found: dict[tuple[int, ...], int] = {(): room} if not top else {}
    if top:
        found[(top,)] = room - top

        def pairs(room: int, head: tuple[int, ...]) -> bool:
            """The best pairs for this room; true if one fills it."""
            first = np.flatnonzero(count[: room + 1])
            rest = room - first
            second = below[np.minimum(rest, first)]  # the first is the larger one
            lone = (second == first) & (count[first] < 2)
            if lone.any():
                second[lone] = below[first[lone] - 1]
            waste = rest - second
            kept = np.flatnonzero(second > 0)
            if not len(kept):
                return False
            order = kept[np.lexsort((-first[kept], waste[kept]))][:branches]
            for k in order.tolist():
                found[(*head, int(first[k]), int(second[k]))] = int(waste[k])
            return waste[order[0]] == 0

        if found[(top,)] and not pairs(room, ()):
            for x in np.flatnonzero(count[: room + 1])[::-1][:branches].tolist():
                count[x] -= 1
                if not count[x]:
                    below = left.below()
                full = pairs(room - x, (x,))
                count[x] += 1
                below = left.below()
                if full:
                    break
        ordered = sorted(found, key=lambda f: (found[f], len(f), tuple(-x for x in f)))
        picked = [f for f in ordered if not _dominated(f, found[f], below)][:branches]
    else:
        picked = [()]
    for x in taken:
        count[x] += 1
    return [(*taken, *f) for f in picked]


def _dominated(filling: tuple[int, ...], waste: int, below: np.ndarray) -> bool:
    """True if one piece left could stand in for one or two of the filling's and leave less room."""
    if not waste:
        return False
    sums = [*filling, *(filling[i] + filling[j] for i in range(len(filling)) for j in range(i))]
    return any(s + waste < len(below) and below[s + waste] > s for s in sums)


def every_filling(count: np.ndarray, room: int, allowed: Callable[[], int], step: Callable[[int], None]) -> Iterator[tuple[int, ...]]:
    """All undominated sets of lengths left, of any number of pieces, with a waste of ``allowed()`` or less: least waste first.

    reach[i] has a bit for each sum that the i smallest lengths can make, so no step of the enumeration leads nowhere.
    """
    lengths = np.flatnonzero(count[: room + 1]).tolist()
    left = {x: int(count[x]) for x in lengths}
    reach, mask = [1], (1 << (room + 1)) - 1
    for x in lengths:
        sums, many, k = reach[-1], min(left[x], room // x), 1
        while many:
            k = min(k, many)
            sums |= (sums << (k * x)) & mask
            many, k = many - k, 2 * k
        reach.append(sums)
    step(len(lengths))
    waste = 0
    while waste <= min(room, allowed()):
        target = room - waste
        stack = [(len(lengths), target, ())] if reach[-1] >> target & 1 else []
        while stack:
            step(1)
            i, rest, taken = stack.pop()
            if not rest:
                if not _improvable(taken, waste, lengths, left):
                    yield tuple(x for x, n in taken for _ in range(n))
                continue
            i = min(i, bisect_right(lengths, rest))
            x = lengths[i - 1]
            for n in range(min(left[x], rest // x) + 1):
                if reach[i - 1] >> (rest - n * x) & 1:
                    stack.append((i - 1, rest - n * x, (*taken, (x, n)) if n else taken))
        waste += 1


def _improvable(taken: tuple[tuple[int, int], ...], waste: int, lengths: list[int], left: dict[int, int]) -> bool:
    """True if a piece outside the filling could be added to it, or stand in for one or two of its pieces and leave less room."""
    if not waste:
        return False
    used = dict(taken)
    sums = {0, *used, *(x + y for x in used for y in used if x < y or (x == y and used[x] > 1))}
    return any(left[x] > used.get(x, 0) for s in sums for x in lengths[bisect_right(lengths, s) : bisect_right(lengths, s + waste)])


def filled(left: np.ndarray, room: int, rng: np.random.Generator | None) -> list[int]:
    """One filling of ``room`` from the lengths left, which are taken off ``left``.

    A single piece or pair that leaves least room ends it. Before that, without ``rng``, the largest piece that fits is taken
    while no pair leaves no room at all; with ``rng``, pieces are drawn from all that are left until about two more fit.
    """
    taken: list[int] = []
    if rng is not None:
        there = np.flatnonzero(left)
        average = float((there * left[there]).sum() / max(1, left[there].sum()))
    while room:
        fit = np.flatnonzero(left[: room + 1])
        if not len(fit):
            break
        few = room < 3 * fit[0]
        if rng is None or few or room <= 2.5 * average:
            at = np.searchsorted(fit, np.minimum(room - fit, fit), "right") - 1  # the second is the smaller one
            at -= (at >= 0) & (fit[at] == fit) & (left[fit] < 2)
            second = np.where(at >= 0, fit[at], 0)
            waste = room - fit - second
            if few or rng is not None or not waste.min():
                best = np.flatnonzero(waste == waste.min())
                k = best[-1] if rng is None else best[rng.integers(len(best))]
                one = [int(x) for x in (fit[k], second[k]) if x]
            else:
                one = [int(fit[-1])]
        else:
            upto = np.cumsum(left[fit])
            one = [int(fit[np.searchsorted(upto, rng.integers(upto[-1]), "right")])]
        for x in one:
            left[x] -= 1
            room -= x
        taken += one
    return taken


def descent(count: np.ndarray, capacity: int, rng: np.random.Generator | None = None, long: int | None = None) -> list[list[int]]:
    """Bins by one filling around the largest piece left, again and again.

    Pieces of more than ``long`` are put together first: around one of them, the greatest of the others that fits, again and
    again, and only then what fills the rest. So they leave the shorter ones, of which more go into a bin, to each other.
    """
    left, bins, largest = count.copy(), [], len(count) - 1
    while largest:
        if not left[largest]:
            largest -= 1
            continue
        left[largest] -= 1
        one, room = [largest], capacity - largest
        while long is not None and largest > long and len(fit := np.flatnonzero(left[long + 1 : room + 1])):
            one.append(int(fit[-1]) + long + 1)
            left[one[-1]] -= 1
            room -= one[-1]
        bins.append([*one, *filled(left, room, rng)])
    return bins


def steered(lengths: np.ndarray, capacity: int, bound: int, best: list[list[int]]) -> list[list[int]]:
    """``best``, or fewer bins by descents with other notions of a long piece: first five shares of all pieces, then between the best ones."""
    count, ordered, rng = np.bincount(lengths, minlength=capacity + 1).astype(np.int64), np.sort(lengths), np.random.default_rng(0)
    tried: dict[float, int] = {}
    step = SHARES[1] - SHARES[0]
    shares = SHARES
    while step > FINEST:
        for share in shares:
            if len(best) > bound and share not in tried and 0 < share < 1:
                found = descent(count, capacity, rng, int(ordered[int(share * len(ordered))]))
                tried[share] = len(found)
                best = min(best, found, key=len)
        step /= 2
        middle = min(tried, key=tried.get, default=0.5)
        shares = (middle - step, middle + step)
    return best


def pack(lengths: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Bins of lengths, as few as the search finds."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    bound, best, rng = lower_bound(count, capacity), best_fit_decreasing(count, capacity), np.random.default_rng(0)
    for how in (None, *[rng] * DRAWS):
        if len(best) > bound:
            best = min(best, descent(count, capacity, how), key=len)
    if len(best) > bound:
        best = steered(lengths, capacity, bound, best)
    if len(best) > bound:
        best, seen = _quick(lengths, capacity, nodes, best)
    if len(best) > bound and seen < nodes:
        best = _thorough(lengths, capacity, nodes - seen, best)
    return best


def _thorough(lengths: np.ndarray, capacity: int, nodes: int, best: list[list[int]]) -> list[list[int]]:
    """``best``, or fewer bins found by trying all undominated fillings at every node, until ``nodes`` are used up."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    bound, total, left = lower_bound(count, capacity), int(lengths.sum()), _Left(count)
    waste, seen = 0, 0.0

    def step(n: int) -> None:
        nonlocal seen
        seen += n / STEPS
        if seen >= nodes:
            raise _UsedUp

    def enumerated(largest: int, before: int) -> Iterator[tuple[int, ...]]:
        rest = left.count.copy()
        rest[largest] -= 1
        return every_filling(rest, capacity - largest, lambda: (len(best) - 1) * capacity - total - before, step)

    # path: [largest piece, waste before its bin, the bin, how many fillings were tried here, the others or None]
    path: list[list] = []
    try:
        while True:
            largest = left.largest()
            if largest:
                path.append([largest, waste, None, 0, enumerated(largest, waste)])
                if len(path) > KEPT:
                    path[-KEPT - 1][4] = None
            elif len(path) < len(best):
                best = [list(at[2]) for at in path]
                if len(best) <= bound:
                    return best
            while path:
                at = path[-1]
                if at[2]:
                    for x in at[2]:
                        left.count[x] += 1
                    at[2], waste = None, at[1]
                if at[4] is None:
                    at[4] = islice(enumerated(at[0], at[1]), at[3], None)
                filling = next(at[4], None)
                if filling is not None:
                    step(STEPS)
                    at[2], at[3] = (at[0], *filling), at[3] + 1
                    for x in at[2]:
                        left.count[x] -= 1
                    waste = at[1] + capacity - sum(at[2])
                    break
                path.pop()
            else:
                return best
    except _UsedUp:
        return best


class _UsedUp(Exception):
    """No nodes are left."""


def _quick(lengths: np.ndarray, capacity: int, nodes: int, best: list[list[int]]) -> tuple[list[list[int]], int]:
    """``best``, or fewer bins by the first fillings of every node, and the nodes looked at."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    bound, total = lower_bound(count, capacity), int(lengths.sum())
    left, seen, found_at = _Left(count), 0, 0
    # path: (bin, the other fillings to try here); a filling is put in place before the next node is looked at
    path: list[tuple[list[int], list[list[int]]]] = []
    waste = 0

    def put(one: list[int], sign: int) -> None:
        nonlocal waste
        for x in one:
            left.count[x] -= sign
        waste += sign * (capacity - sum(one))

    while seen < min(nodes, found_at + STALLED + len(best)):
        seen += 1
        allowed = (len(best) - 1) * capacity - total
        largest = left.largest()
        if not largest and len(path) < len(best):
            best, found_at = [one for one, _ in path], seen
            if len(best) <= bound:
                break
            allowed -= capacity
        choices: list[list[int]] = []
        if largest and waste <= allowed:
            left.count[largest] -= 1
            found = fillings(left, capacity - largest)
            left.count[largest] += 1
            choices = [c for c in ([largest, *f] for f in found) if waste + capacity - sum(c) <= allowed][::-1]
        if not choices:  # go back to the last node that has another filling which may do
            while path:
                one, others = path.pop()
                put(one, -1)
                others = [c for c in others if waste + capacity - sum(c) <= allowed]
                if others:
                    choices = others
                    break
            else:
                break
        one = choices.pop()
        put(one, 1)
        path.append((one, choices))
    return best, seen


def placed(lengths: np.ndarray, capacity: int, nodes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For the pieces of one group: the number of each one's sequence, its offset there, and the sequences above the bound."""
    waiting = defaultdict(list)
    for i in np.argsort(-lengths, kind="stable").tolist():
        waiting[int(lengths[i])].append(i)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins = pack(lengths, capacity, nodes)
    for k, one in enumerate(bins):
        at = 0
        for length in one:
            i = waiting[length].pop()
            sequence[i], offset[i] = k, at
            at += length
    return sequence, offset, len(bins) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, nodes: int = NODES, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, over_bound: where every piece of every document is."""
    found = written(pieces(docs, capacity=capacity, **options), "pieces")
    groups = max(1, round(found.count() / group_pieces))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, over_bound long"

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sequence, offset, over = placed(rows["length"].to_numpy(), capacity, nodes)
        rows = rows.drop_columns("g").append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))
        return rows.append_column("over_bound", pa.array(np.full(len(offset), over, np.int64)))

    dealt = found.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("g").applyInArrow(work, schema)
