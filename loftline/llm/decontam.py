"""Benchmark decontamination by q-gram lemma filtering (operator 7).

Items and documents are compared as their letters and digits, lower-cased, so
white space and marks don't matter.  Any passage of an item that has at least
``SHORTEST`` characters is found within ``EDIT_SHARE`` edits a character, wherever
it starts.  It suffices to look at windows of the lengths at which the budget
grows by one, until a longer passage must hold a shorter window within budget.
A region of a document within e edits of a window of m characters shares at
least (m - q + 1) - e * q of its q-grams, on diagonals no farther apart than e.
Shared q-grams are counted in overlapping diagonal bands; every window of a band
that meets the bound is verified by banded alignment.  Items that are shorter
than ``LONGEST`` are also sought as a whole.

All items are taken against all documents, in blocks of items whose q-gram index
has a bounded size; one scan of the documents serves a block.  Shared q-grams are
listed for some texts at a time.  A text that shares very many by itself, as a
repetitive one does with a repetitive item, is cut into overlapping stretches;
stretches that are alike are looked at once, and an item that was found without an
edit isn't sought further.  So memory is bounded whatever texts and items repeat.

Defined results: null or empty texts match nothing; so do items without letters
and digits.  Items of under ``EXACT_BELOW`` letters and digits must occur exactly,
those of fewer than q must be all that the document has.  Repeated documents are reported each; items that repeat an id are taken
as one item with several texts.  Items without an id can't be named and aren't
reported, but ``clean`` drops the documents that hold them.  Extra columns are
ignored, and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.kernels import mix64, text_blocks, utf8_view
from loftline.llm.store import attach, lean, written

Q = 10
#: Letters and digits of the shortest passage of a longer item that is sought.
SHORTEST = 50
#: Edits per character of a passage.
EDIT_SHARE = 0.06
#: From this length on a passage within its edits holds a window of WINDOWS within its own.
LONGEST = 2 * SHORTEST
#: Length and edits: the shortest windows that are allowed one edit more.
WINDOWS = [(n, int(EDIT_SHARE * n)) for n in range(SHORTEST, LONGEST) if n == SHORTEST or int(EDIT_SHARE * n) > int(EDIT_SHARE * (n - 1))]
EXACT_BELOW = 40
#: Bytes of item text whose q-grams are indexed at once: about 40 times that in memory.
INDEX_BYTES = 1 << 20
#: Letters of an item that are indexed as one piece; longer items are several, which overlap by the longest window.
PIECE = 2000
#: Shared q-grams that are listed at a time, and letters of a text that has more of them by itself.
LISTED = 2_000_000
STRETCH = 1024
_BITS = 22
LEAK = "item_id long, doc_id long, row_id long, segment int, edits int, start int, end int"

_KEEP = np.zeros(256, np.uint8)
_KEEP[0x30:0x3A] = np.arange(0x30, 0x3A)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)


def folded(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of UTF-8 bytes, lower-cased in Latin-1, and where each was."""
    low = _KEEP[buf]
    # Accented capitals of Latin-1: the byte after C3, but for the multiplication sign.
    accented = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    low[accented] += 0x20
    at = np.flatnonzero(low)
    return low[at], at


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(Q):
        into = first if k < 8 else second
        into |= text[k : k + n].astype(np.uint64) << np.uint64(8 * (k % 8))
    with np.errstate(over="ignore"):
        return mix64(first + second * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Item:
    """An item, or a piece of a long one that begins at ``first``; ``number`` is the item's own."""

    item_id: int | None
    text: np.ndarray
    number: int = 0
    first: int = 0
    #: Length, edits and shared q-grams of the windows to look for.
    windows: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        m = len(self.text)
        sizes = [(n, e) for n, e in WINDOWS if n <= m]
        if m < LONGEST and (m, int(EDIT_SHARE * m)) not in sizes:
            sizes.append((m, int(EDIT_SHARE * m) if m >= EXACT_BELOW else 0))
        self.windows = [(n, e, max(1, n - Q + 1 - e * Q)) for n, e in sizes]


class ItemIndex:
    """Places of each q-gram in a block of items, behind a bitmap."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        every = [(i, folded(np.frombuffer(s.encode(), np.uint8))[0]) for i, s in rows]
        self.items = [Item(i, t[a : a + PIECE], k, a) for k, (i, t) in enumerate(every) if len(t) >= Q for a in piece_starts(t)]
        #: Items of fewer than q characters, by these.
        self.tiny: dict[bytes, list[int | None]] = {}
        for i, t in every:
            if 0 < len(t) < Q:
                self.tiny.setdefault(t.tobytes(), []).append(i)
        self.least = np.array([min(need for _, _, need in x.windows) for x in self.items], np.int64)
        self.step = 1 + max((e for x in self.items for _, e, _ in x.windows), default=0)
        hashes = [gram_hashes(x.text) for x in self.items]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else np.zeros(0, np.int64)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - _BITS)] = True

    def ranges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``text`` of q-grams that some item has, and where the index lists them."""
        h = gram_hashes(text)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - _BITS)])
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        return at[hi > lo], lo[hi > lo], hi[hi > lo]

    def listed(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the text, item and place in the item of every shared q-gram."""
        count = hi - lo
        which = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(at, count), self.item[which], self.place[which]


def piece_starts(text: np.ndarray) -> list[int]:
    """Where pieces of an item begin; every window lies in one of them.  Of pieces that are alike the first stands for all."""
    n = len(text)
    if n <= PIECE:
        return [0]
    every = [*range(0, n - PIECE, PIECE - LONGEST), n - PIECE]
    return sorted({text[a : a + PIECE].tobytes(): a for a in reversed(every)}.values())


def banded_edits(segment: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int]:
    """Fewest edits of ``segment`` against any part of ``region``; that part's bounds.

    Cells outside the band of diagonals that ``region`` allows are never needed:
    ``region`` is no longer than the segment, its band and the budget.
    """
    n = len(region)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, c in enumerate(segment.tolist(), 1):
        swap = np.concatenate([[k], cost[:-1] + (region != c)])
        drop = cost + 1
        best = np.minimum(swap, drop)
        start = np.where(swap <= drop, np.concatenate([[0], origin[:-1]]), origin)
        # Characters of the region left out: the running least of cost minus place.
        level = best - steps
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, steps, 0))
        cost, origin = least + steps, start[source]
        if cost.min() > budget:
            return budget + 1, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def window_edits(windows: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Fewest edits of each window against any part of its region."""
    steps = np.arange(regions.shape[1] + 1, dtype=np.int16)
    cost = np.zeros((len(windows), len(steps)), np.int16)
    for k in range(windows.shape[1]):
        best = cost + np.int16(1)
        np.minimum(best[:, 1:], cost[:, :-1] + (regions != windows[:, k : k + 1]), out=best[:, 1:])
        cost = np.minimum.accumulate(best - steps, axis=1) + steps
    return cost.min(1)


def _best_window(text: np.ndarray, item: np.ndarray, places: np.ndarray, first: int, last: int, n: int, edits: int, need: int) -> tuple[int, int, int, int] | None:
    """(window start, edits, start, end) of the best window of ``n`` on the diagonals ``first`` to ``last``, where the item's ascending ``places`` are shared."""
    reach = n - Q
    at = np.arange(len(places) - need + 1)
    at = at[places[at + need - 1] - places[at] <= reach]
    if not len(at):
        return None
    # The windows that hold as many shared places as the bound asks for.
    edge = np.zeros(len(item) - n + 2, np.int64)
    np.add.at(edge, np.maximum(places[at + need - 1] - reach, 0), 1)
    np.add.at(edge, np.minimum(places[at], len(item) - n) + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    # A window takes at least an edit for each q places that aren't shared, so most needn't be aligned.
    shared = np.searchsorted(places, starts + reach, "right") - np.searchsorted(places, starts, "left")
    floor = -(-(reach + 1 - shared) // Q)
    order = np.argsort(floor, kind="stable")
    starts, floor = starts[order], floor[order]
    best, cost, lo = None, edits + 1, 0
    while lo < len(starts) and floor[lo] < cost:
        some = starts[lo : lo + (4 if lo == 0 else 64)]
        where = (some + first - edits)[:, None] + np.arange(n + last - first + 2 * edits)
        regions = np.where((where >= 0) & (where < len(text)), text[np.clip(where, 0, len(text) - 1)], 0)
        costs = window_edits(item[some[:, None] + np.arange(n)], regions)
        if costs.min() < cost:
            best, cost = int(some[costs.argmin()]), int(costs.min())
        lo += len(some)
    if best is None:
        return None
    begin = max(0, first + best - edits)
    _, x, y = banded_edits(item[best : best + n], text[begin : min(len(text), last + best + n + edits)], edits)
    return best, cost, begin + x, begin + y


def find_in(text: np.ndarray, item: Item, at: np.ndarray, place: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """(place among the window lengths, edits, window start, start, end) of the best window of the shortest length found."""
    diagonal = at - place
    low = int(diagonal.min())
    for size, (n, edits, need) in enumerate(item.windows):
        best = None
        # Bands of width 2e + 2 that overlap by half: any e + 1 diagonals lie in one of them.
        step = edits + 1
        band = (diagonal - low) // step
        for b in np.unique(band).tolist():
            # A q-gram place of the item counts once, however often the region repeats it.
            places = np.unique(place[(band == b) | (band == b + 1)])
            if len(places) < need:
                continue
            found = _best_window(text, item.text, places, low + b * step, low + (b + 2) * step - 1, n, edits, need)
            if found and (best is None or found[1] < best[1]):
                best = found
                if not best[1]:
                    break
        if best:
            s, cost, x, y = best
            return size, cost, item.first + s, x, y
    return None


def _judged(text: np.ndarray, edges: np.ndarray, index: ItemIndex, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, tuple]]:
    """Row, item and best window of every pair of a text and an item that some of these shared q-grams tie."""
    row = np.searchsorted(edges, at, "right") - 1
    whole = at + Q <= edges[row + 1]
    at, item, place, row = at[whole], item[whole], place[whole], row[whole]
    if not len(at):
        return
    # Rows and items with too few shared q-grams on neighbouring bands of diagonals can be left out at once.
    pair = row * len(index.items) + item
    band = (at - place - (at - place).min()) // index.step
    wide = int(band.max()) + 2
    keys, which, count = np.unique(pair * wide + band, return_inverse=True, return_counts=True)
    after = np.zeros(len(keys), np.int64)
    follows = np.flatnonzero(np.diff(keys) == 1)
    after[follows] = count[follows + 1]
    good = count + after >= index.least[keys // wide % len(index.items)]
    good[follows + 1] |= good[follows]
    use = good[which]
    at, item, place, row, pair = at[use], item[use], place[use], row[use], pair[use]
    order = np.argsort(pair, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1) if len(order) else []:
        r, i = int(row[group[0]]), int(item[group[0]])
        found = find_in(text[edges[r] : edges[r + 1]], index.items[i], at[group] - edges[r], place[group])
        if found:
            yield r, i, found


def _in_stretches(text: np.ndarray, index: ItemIndex, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """Item and best window of every item found in one text, of which few shared q-grams are listed at a time."""
    # Two windows that follow one another in overlapping stretches are never both cut.
    over = LONGEST + 4 * index.step + Q
    alive, seen, best = np.ones(len(index.items), bool), set(), {}
    numbers = np.array([x.number for x in index.items])
    for first in range(0, max(1, len(text) - over), STRETCH):
        part = text[first : first + STRETCH + over]
        content = part.tobytes()
        if content in seen:
            continue
        seen.add(content)
        some = slice(np.searchsorted(at, first), np.searchsorted(at, first + len(part) - Q, "right"))
        grams, where, times = np.unique(lo[some], return_inverse=True, return_counts=True)
        ends = dict(zip(lo[some].tolist(), hi[some].tolist()))
        held = [np.arange(a, ends[a]) for a in grams.tolist()]
        held = [h[alive[index.item[h]]] for h in held]
        # How many q-grams each item shares with the stretch; items are dealt to groups that share few enough.
        shares = np.zeros(len(index.items), np.int64)
        for h, n in zip(held, times.tolist()):
            shares += n * np.bincount(index.item[h], minlength=len(shares))
        group = np.cumsum(shares) // LISTED
        for g in np.unique(group[shares > 0]).tolist():
            wanted = (group == g) & (shares > 0) & alive
            if not wanted.any():
                continue
            mine = [h[wanted[index.item[h]]] for h in held]
            count = np.array([len(h) for h in mine], np.int64)
            starts, entries = np.cumsum(count) - count, np.concatenate(mine)
            n = count[where]
            which = entries[np.repeat(starts[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            near = np.repeat(at[some] - first, n)
            for _, i, (size, cost, s, x, y) in _judged(part, np.array([0, len(part)]), index, near, index.item[which], index.place[which]):
                if i not in best or (size, cost) < best[i][:2]:
                    best[i] = size, cost, s, first + x, first + y
                if (size, cost) == (0, 0):
                    alive[numbers == numbers[i]] = False
    yield from best.items()


def _batched(counts: np.ndarray) -> Iterator[slice]:
    """Runs of rows that share up to ``LISTED`` q-grams together; a row of more is alone."""
    lo = total = 0
    for k, n in enumerate(counts.tolist()):
        if k > lo and total + n > LISTED:
            yield slice(lo, k)
            lo, total = k, 0
        total += n
    if lo < len(counts):
        yield slice(lo, len(counts))


def find_leaks(buf: np.ndarray, offs: np.ndarray, index: ItemIndex) -> list[tuple[int, int, int, int, int, int]]:
    """(item id, row, window start, edits, start and end byte in the row) of each item found in each text."""
    text, where = folded(buf)
    edges = np.searchsorted(where, offs)
    out = []
    for r in np.flatnonzero((np.diff(edges) > 0) & (np.diff(edges) < Q)).tolist() if index.tiny else []:
        a, b = int(edges[r]), int(edges[r + 1])
        out += [(i, r, 0, 0, int(where[a] - offs[r]), int(where[b - 1] + 1 - offs[r])) for i in index.tiny.get(text[a:b].tobytes(), [])]
    at, lo, hi = index.ranges(text)
    row = np.searchsorted(edges, at, "right") - 1
    counts = np.bincount(row, hi - lo, minlength=len(offs) - 1).astype(np.int64)
    best: dict[tuple[int, int], tuple] = {}
    for rows in _batched(counts):
        a, b = np.searchsorted(row, [rows.start, rows.stop])
        if a == b:
            continue
        if counts[rows].sum() > LISTED:
            e, r = int(edges[rows.start]), rows.start
            found = ((r, i, f) for i, f in _in_stretches(text[e : edges[r + 1]], index, at[a:b] - e, lo[a:b], hi[a:b]))
        else:
            found = _judged(text, edges, index, *index.listed(at[a:b], lo[a:b], hi[a:b]))
        for r, i, f in found:
            # Of a long item's pieces the best counts.
            k = r, index.items[i].number
            if k not in best or f[:2] < best[k][1][:2]:
                best[k] = i, f
    for (r, _), (i, (_, cost, s, x, y)) in best.items():
        out.append((index.items[i].item_id, r, s, cost, int(where[edges[r] + x] - offs[r]), int(where[edges[r] + max(x, y - 1)] + 1 - offs[r])))
    return out


def leaks(docs: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """A row for each document and item found in it: the best window, its edits and byte span.

    ``docs`` has doc_id and text, ``items`` has item_id and text; each row of ``docs`` is searched by itself.
    """
    return _found(docs, items.where("item_id IS NOT NULL"), index_bytes)


def _found(docs: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES, key: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    attach(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // index_bytes))
    row_id = F.col(key) if key else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id.cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))

    def search(shared: object):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value)
            for block in text_blocks(batches, "text", 4 << 20):
                buf, offs = utf8_view(block["text"])
                out = find_leaks(buf, offs, index)
                if out:
                    ids, owner, *rest = zip(*out)
                    take = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), block["doc_id"].combine_chunks().take(take), block["row_id"].combine_chunks().take(take), *[pa.array(c, pa.int32()) for c in rest]],
                        ["item_id", "doc_id", "row_id", "segment", "edits", "start", "end"],
                    )

        return run

    found = []
    for b in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in some.collect()])
        found.append(rows.mapInArrow(lean(search(index)), LEAK))
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    names = docs.columns
    rows = written(docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).withColumn("row_id", F.monotonically_increasing_id()), "decontam")
    at = {c: f"c{k}" for k, c in enumerate(names)}
    found = _found(rows.select(F.col(at["doc_id"]).alias("doc_id"), "row_id", F.col(at["text"]).alias("text")), items, key="row_id")
    kept = rows.join(found.select("row_id").distinct(), "row_id", "left_anti")
    return kept.select(*[F.col(at[c]).alias(c) for c in names])
