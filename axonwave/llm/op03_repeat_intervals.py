"""Suffix-array dedup: all maximal repeats of at least min_bytes, from common-prefix intervals.

1. Anchors. Every window of min_bytes has one anchor, the least of its k-byte hashes (leftmost on
   ties), so equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a run of text
   shorter than twice min_bytes. Every window has half of its other bytes before its anchor or behind it; a bitmap of the hashes of anchors with such
   a half that occur again (fixed size, no false negatives) keeps back what is unique: in a large corpus anchors alone repeat by chance.
2. Runs that may repeat are dealt by anchor and sorted by it: whatever repeats a run is next to it. A run that a task has met at an earlier
   place is not sent; its place is a span that goes.
3. A task reads its runs anchor by anchor and sorts the suffixes that may start a repeat (buckets of equal first bytes, which are compared, then the bytes
   that follow), computes the common prefixes of neighbours, and scans
   them with a stack: each closed interval is a set of suffixes with a common prefix. An interval whose
   occurrences are preceded by different bytes (or by the start of a run) cannot be extended to the left: it is a
   maximal repeat, and is output with all of its occurrences, not just neighbours. A task holds the different runs of one anchor at most, or a few MB.
4. Occurrences after the first of their group are joined to spans for each document; the rest of the bytes stays.

Repeats longer than a run are output as overlapping groups, one for each run; their spans join up to the whole.

Edge cases: null is empty; texts shorter than min_bytes lose nothing; offsets are in UTF-8 bytes and a cut may
fall inside a character; a null doc_id ranks before all others; documents are known by doc_id and text, those of one doc_id (or none) rank by a hash of their text;
rows alike in both are one document and no repeat of each other; very long texts are read in overlapping blocks. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import table, written
from axonwave.llm.repeats import owners_for, packed_by_owner, repeated_bitmap, tested
from axonwave.llm.vectors import gathered

NO_DOC = -(1 << 63)


@dataclass(frozen=True)
class RepeatPlan:
    min_bytes: int = 100
    k: int = 32
    bits: int = 27  #: of the bitmap of what occurs again: 16 MB
    windows: int = 60_000  #: sorted at once within a task
    held_bytes: int = 1 << 22  #: of runs that a task reads before it sorts them
    seen: int = 1 << 20  #: different runs whose earliest places a task remembers

    @property
    def half(self) -> int:
        return (self.min_bytes - self.k + 1) // 2


_MASK = np.uint64((1 << 23) - 1)
_BLOCK = 1 << 19


def anchor_runs(data: np.ndarray, offsets: np.ndarray, plan: RepeatPlan):
    """(row, start, last window, place of the anchor, its hash, left, right, prefix sums, shift of the block) arrays for each block.

    left, right: hashes of the anchor with half of a window's other bytes before or behind it, 0 where no window of the run has so many there.
    Every window has one of the two, so if neither occurs again, no window does.
    """
    from axonwave.llm.vectors import prefix_sums, span_hashes

    size, k = plan.min_bytes, plan.k
    blocks = [(0, len(data))] if len(data) <= _BLOCK + size else [(b, min(len(data), b + _BLOCK + size - 1)) for b in range(0, len(data) - size + 1, _BLOCK)]
    for lo, hi in blocks:
        part, n = data[lo:hi], hi - lo
        if n < size:
            continue
        bounds = np.clip(offsets, lo, hi) - lo
        sums = prefix_sums(part)
        at = np.arange(n - k + 1)
        h = span_hashes(sums, at, at + k)
        m = (h & ~_MASK) | at.astype(np.uint64)
        width, span = size - k + 1, 1
        while span * 2 <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < width:
            m = np.minimum(m[: -(width - span)], m[width - span :])
        anchor = (m & _MASK).astype(np.int64)
        windows = len(anchor)
        delta = np.zeros(windows + 1, np.int32)
        first, last = bounds[:-1], bounds[1:] - size + 1
        ok = last > first
        np.add.at(delta, first[ok], 1)
        np.add.at(delta, last[ok], -1)
        valid = np.cumsum(delta[:-1]) > 0
        new = np.ones(windows, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        edge = first[ok]
        new[edge] = True
        start = np.flatnonzero(new & valid)
        if not len(start):
            continue
        stop = np.ones(windows, bool)
        stop[:-1] = new[1:] | ~valid[1:]
        end = np.flatnonzero(stop & valid)
        row = np.searchsorted(bounds, start, "right") - 1
        at, half = anchor[start], plan.half
        left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        i, j = np.flatnonzero(at - start >= half), np.flatnonzero(end + size >= at + k + half)
        left[i] = span_hashes(sums, at[i] - half, at[i] + k)
        right[j] = ~span_hashes(sums, at[j], at[j] + k + half)
        yield row, start, end, at, h[at], left, right, sums, lo


def suspects(block, test, plan: RepeatPlan):
    """(row, start, windows, anchor hash, hash of the run, shift of the block, place of the anchor in the run) of the runs that may repeat, without the windows that cannot."""
    from axonwave.llm.vectors import span_hashes

    row, start, end, at, h, left, right, sums, lo = block
    before, behind = (left != 0) & test(left), (right != 0) & test(right)
    start = np.where(before, start, np.maximum(start, at - (plan.min_bytes - plan.k - plan.half)))
    end = np.where(behind, end, np.minimum(end, at - plan.half))
    hit = np.flatnonzero((before | behind) & (start <= end))
    row, start, end, at, h = (x[hit] for x in (row, start, end, at, h))
    return row, start, end - start + 1, h, span_hashes(sums, start, end + plan.min_bytes), lo, at - start


def _texts(batches):
    """(doc ids, hashes of the texts, bytes, offsets) of each slice."""
    import pyarrow.compute as pc

    from axonwave.llm.vectors import slices

    for b in batches:
        ids = pc.fill_null(b.column(0), NO_DOC).to_numpy(zero_copy_only=False)
        hashes = b.column(2).to_numpy(zero_copy_only=False)
        for first, data, offsets in slices(b.column(1)):
            to = first + len(offsets) - 1
            yield ids[first:to], hashes[first:to], data, offsets


class _Seen:
    """The earliest place of each run met so far, by two hashes of the run; forgets all when full."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.place = np.zeros((3, 0), np.int64)

    def later(self, key: np.ndarray, check: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of the runs (key ascending, each once) have been met at an earlier place; the others are noted."""
        at = np.searchsorted(self.key, key)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == key[known]
        same = known.copy()
        same[known] = self.check[at[known]] == check[known]
        after = np.zeros(len(key), bool)
        i, j = at[same], np.flatnonzero(same)
        was, now = self.place[:, i], place[:, j]
        after[j] = (now[0] > was[0]) | (now[0] == was[0]) & ((now[1] > was[1]) | (now[1] == was[1]) & (now[2] > was[2]))
        better = j[~after[j]]
        self.place[:, at[better]] = place[:, better]
        new = ~known
        if len(self.key) + new.sum() > self.most:
            self.clear()
            at = np.zeros(len(key), np.int64)
        self.key = np.insert(self.key, at[new], key[new])
        self.check = np.insert(self.check, at[new], check[new])
        self.place = np.insert(self.place, at[new], place[:, new], axis=1)
        return after


_RUNS = "anchor long, doc long, th long, start long, size int, mark int, run binary"


def runs(texts: DataFrame, bitmap, plan: RepeatPlan, whole: bool = False) -> DataFrame:
    """Runs that may repeat: anchor, doc, th, start, size, mark (place of the anchor), run (bytes).

    Runs that a task has met at an earlier place are sent as spans (run null), joined where they touch; unless whole.
    """

    def rows(batches):
        import pyarrow as pa

        from axonwave.llm.vectors import mix, prefix_sums, span_hashes

        test, size, seen = tested(bitmap.value, plan.bits), plan.min_bytes, _Seen(plan.seen)
        names = [x.split()[0] for x in _RUNS.split(", ")]

        def sent(anchor, doc, th, start, n, mark, run):
            return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), *map(pa.array, (doc, th, start, n.astype(np.int32), mark.astype(np.int32))), run], names)

        for ids, hashes, data, offsets in _texts(batches):
            for block in anchor_runs(data, offsets, plan):
                row, start, n, anchor, key, lo, mark = suspects(block, test, plan)
                if not len(row):
                    continue
                at, n = start + lo, n + size - 1
                doc, th, start = ids[row], hashes[row], at - offsets[row]
                if not whole:
                    order = np.lexsort((start, th, doc, key))
                    first = np.ones(len(order), bool)
                    first[1:] = key[order][1:] != key[order][:-1]
                    heads = order[first]
                    part = data[lo : int(at.max() + n.max())]
                    check = span_hashes(prefix_sums(part[::-1]), len(part) - (at[heads] - lo) - n[heads], len(part) - (at[heads] - lo))
                    after = seen.later(key[heads], check, np.stack([doc[heads], th[heads], start[heads]]))
                    copies = np.concatenate([order[~first], heads[after]])
                    # a place more than once is a repeated row, and its head is no copy of itself
                    of = heads[np.cumsum(first) - 1][~first]
                    again = (doc[order[~first]] == doc[of]) & (th[order[~first]] == th[of]) & (start[order[~first]] == start[of])
                    copies = copies[np.append(~again, np.ones(int(after.sum()), bool))]
                    d, t, b, e = _merged(doc[copies], th[copies], start[copies], start[copies] + n[copies])
                    yield sent(mix((d ^ t).view(np.uint64)), d, t, b, e - b, np.zeros(len(d), np.int32), pa.nulls(len(d), pa.binary()))
                    kept = heads[~after]
                    row, at, n, anchor, mark, doc, th, start = (x[kept] for x in (row, at, n, anchor, mark, doc, th, start))
                for i in range(0, len(at), 4096):
                    j = slice(i, i + 4096)
                    blob, cuts = gathered(data, at[j], n[j])
                    run = pa.Array.from_buffers(pa.binary(), len(n[j]), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(blob.tobytes())])
                    yield sent(anchor[j], doc[j], th[j], start[j], n[j], mark[j], run)

    return texts.mapInArrow(rows, _RUNS)


def intervals(lcp: np.ndarray, least: int):
    """Stack scan of an LCP array (lcp[i]: of suffixes i-1 and i) -> (length, first, last) of all intervals with lcp >= least."""
    stack: list[tuple[int, int]] = []
    n = len(lcp)
    for i in range(1, n + 1):
        now = int(lcp[i]) if i < n else 0
        left = i - 1
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            yield length, left, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def _window_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of data[at:at+size]; by prefix sums, or window by window where those would be large."""
    from axonwave.llm.vectors import poly_hashes, prefix_sums, span_hashes

    if len(data) <= 1 << 19:
        return span_hashes(prefix_sums(data), at, at + size)
    wide = np.arange(size)
    return np.concatenate([poly_hashes(data[at[i : i + 8192, None] + wide]) for i in range(0, len(at), 8192)])


def _equal_bytes(data: np.ndarray, at: np.ndarray, h: np.ndarray, size: int) -> bool:
    """Whether neighbours with equal hashes have equal bytes."""
    same = np.flatnonzero(h[1:] == h[:-1])
    wide = np.arange(size)
    return all((data[at[i][:, None] + wide] == data[at[i + 1][:, None] + wide]).all() for i in (same[k : k + 8192] for k in range(0, len(same), 8192)))


def maximal_repeats(data: np.ndarray, offsets: np.ndarray, least: int, most: int, first: np.ndarray | None = None, count: np.ndarray | None = None):
    """Groups of the runs data[offsets[i]:offsets[i+1]]: (length, run of each occurrence, place in its run), one after another.

    Suffixes are bucketed by their first `least` bytes; buckets that left-extend in one way only cannot start a
    maximal repeat and are not sorted further. first, count: the places of each run at which repeats may start (all, if not given).
    """
    size = np.diff(offsets) - least + 1 if count is None else count
    run = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    if not len(run):
        return
    if first is not None:
        place += first[run]
    at = offsets[run] + place
    h = _window_hashes(data, at, least)
    order = np.argsort(h, kind="stable")
    if not _equal_bytes(data, at[order], h[order], least):  # two strings with one hash: by their bytes instead
        h = np.unique(np.stack([data[at + i] for i in range(least)], 1), axis=0, return_inverse=True)[1].astype(np.uint64)
        order = np.argsort(h, kind="stable")
    hs = h[order]
    begin = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
    count = np.diff(np.append(begin, len(hs)))
    before = np.where(place[order] > 0, data[np.maximum(at[order] - 1, 0)].astype(np.int16), np.int16(256))  # 256: the start of a run
    low, high = np.minimum.reduceat(before, begin), np.maximum.reduceat(before, begin)
    chosen = np.repeat((count > 1) & ((low != high) | (high == 256)), count)
    order, before, bucket = order[chosen], before[chosen], np.repeat(np.arange(len(begin)), count)[chosen]
    if not len(order):
        return
    # the suffix array: by bucket, then by the bytes after the first `least`, shorter first
    p, stop = at[order], offsets[run[order] + 1]
    tail = most - least
    words = -(-tail // 8)
    where = p.astype(np.int32)[:, None] + (least + np.arange(words * 8, dtype=np.int32))[None, :]
    rest = np.where(where < stop[:, None], data[np.minimum(where, len(data) - 1)], 0).astype(np.uint8)
    key = rest.view(">u8").astype(np.uint64)
    sa = np.lexsort([stop - p, *[key[:, i] for i in range(words - 1, -1, -1)], bucket])
    rest, length, bucket, before, order = rest[sa], (stop - p)[sa], bucket[sa], before[sa], order[sa]
    differs = rest[1:] != rest[:-1]
    common = np.where(differs.any(1), differs.argmax(1), words * 8)
    lcp = np.zeros(len(sa), np.int64)
    lcp[1:] = np.where(bucket[1:] == bucket[:-1], np.minimum(least + common, np.minimum(length[1:], length[:-1])), 0)
    turns = np.zeros(len(sa), np.int64)  # neighbours with different left extensions
    turns[1:] = (before[1:] != before[:-1]) | (before[1:] == 256)
    turns = np.cumsum(turns)
    first = np.flatnonzero(lcp < least)
    last = np.append(first[1:], len(sa)) - 1
    lows = np.minimum.reduceat(np.where(lcp < least, 1 << 30, lcp), first)
    highs = np.maximum.reduceat(lcp, first)
    for lo, hi, a, b in zip(first.tolist(), last.tolist(), lows.tolist(), highs.tolist(), strict=True):
        if hi == lo:
            continue
        found = [(a, lo, hi)] if a == b else [(n, lo + i, lo + j) for n, i, j in intervals(np.concatenate([[0], lcp[lo + 1 : hi + 1]]), least)]
        for n, i, j in found:
            if turns[j] > turns[i]:  # left extensions differ
                o = order[i : j + 1]
                yield n, run[o], place[o]


def _groups(anchor, mark, data, offsets, plan: RepeatPlan):
    """(length, run of each occurrence, place in its run) arrays for each maximal repeat of runs sorted by anchor."""
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(begin, len(anchor)))
    order = np.flatnonzero(np.repeat(count > 1, count))
    if not len(order):
        return
    a, sizes = anchor[order], offsets[order + 1] - offsets[order]
    windows = np.cumsum(sizes - plan.min_bytes + 1)
    change = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a))
    at = 0
    while at < len(order):  # whole anchors, as many as fit
        limit = (windows[at - 1] if at else 0) + plan.windows
        fit = change[(change > at) & (windows[change - 1] <= limit)]
        to = int(fit[-1]) if len(fit) else int(change[change > at][0])
        own = order[at:to]
        blob, cuts = gathered(data, offsets[own], sizes[at:to])
        n_windows, before = sizes[at:to] - plan.min_bytes + 1, mark[own].astype(np.int64)
        # equal windows have their anchor at the same place: a hot anchor is sorted place by place
        most = plan.min_bytes - plan.k + 1
        step = most if n_windows.sum() <= 2 * plan.windows else max(1, plan.windows // len(own))
        for o in range(0, most, step):
            first = np.clip(before - (o + step - 1), 0, n_windows)
            count = np.clip(before - o + 1, 0, n_windows) - first
            for n, run, place in maximal_repeats(blob, cuts, plan.min_bytes, 2 * plan.min_bytes - plan.k, first, count):
                yield n, own[run], place
        at = to


def _merged(doc, th, start, end):
    """Spans of documents joined where they touch."""
    if not len(doc):
        return doc, th, start, end
    order = np.lexsort((start, th, doc))
    doc, th, start, end = doc[order], th[order], start[order], end[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    index = np.cumsum(other)
    far = np.maximum.accumulate(index * (1 << 40) + end) - index * (1 << 40)
    new = other.copy()
    new[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(new)
    return doc[at], th[at], start[at], far[np.append(at[1:], len(doc)) - 1]


class _Held:
    """Runs of a sorted stream: arrays anchor, doc, th, start, mark and their bytes."""

    def __init__(self):
        self.parts, self.bytes = [], 0

    def add(self, b):
        column = b.column(6)
        cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
        numbers = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 3, 5)])
        self.parts.append((numbers, np.diff(cuts), data.copy()))
        self.bytes += len(data) + 64 * len(cuts)

    def taken(self):
        numbers = np.concatenate([x[0] for x in self.parts], 1)
        sizes, data = (np.concatenate([x[i] for x in self.parts]) for i in (1, 2))
        self.parts, self.bytes = [], 0
        return numbers, np.concatenate([[0], np.cumsum(sizes)]), data

    def back(self, numbers, offsets, data, chosen):
        """Holds the chosen runs again."""
        sizes = offsets[chosen + 1] - offsets[chosen]
        self.parts = [(numbers[:, chosen], sizes, gathered(data, offsets[chosen], sizes)[0])]
        self.bytes = int(sizes.sum()) + 64 * len(chosen)


def _distinct(numbers, offsets, data):
    """(the earliest of equal runs, in order of anchors; the others but for repeated rows). Runs are compared by their bytes."""
    anchor, doc, th, start, _ = numbers
    sizes = np.diff(offsets)
    text = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(sizes))]
    order = np.lexsort((start, th, doc, anchor))
    kept, copies, first, now = [], [], {}, None
    for i in order.tolist():
        if anchor[i] != now:
            first, now = {}, anchor[i]
        j = first.setdefault(text[i], i)
        if j == i:
            kept.append(i)
        elif doc[i] != doc[j] or th[i] != th[j] or start[i] != start[j]:
            copies.append(i)
    return np.array(kept, np.int64), np.array(copies, np.int64)


def _sorted_runs(found: DataFrame) -> DataFrame:
    return found.repartition("anchor").sortWithinPartitions("anchor")


def _bitmap(texts: DataFrame, plan: RepeatPlan):
    owners = owners_for(texts)

    def anchors(batches):
        blocks = (x for _, _, data, offsets in _texts(batches) for x in anchor_runs(data, offsets, plan))
        yield from packed_by_owner((h[h != 0] for x in blocks for h in x[5:7]), owners)

    return texts.sparkSession.sparkContext.broadcast(repeated_bitmap(texts.mapInArrow(anchors, "owner int, hashes binary"), owners, plan.bits))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def _in_order(batches, plan: RepeatPlan, done):
    """Calls done(numbers, offsets, data, last) for runs of whole anchors, a few MB at a time; it may leave one anchor's runs held. Yields what it yields."""
    held, most = _Held(), plan.held_bytes
    for b in batches:
        if len(b):
            held.add(b)
        if held.bytes >= most:
            yield from done(held, False)
            most = max(plan.held_bytes, 2 * held.bytes)  # of a hot anchor
    if held.parts:
        yield from done(held, True)


def repeat_groups(docs: DataFrame, plan: RepeatPlan = RepeatPlan()) -> DataFrame:
    """Maximal repeats with all occurrences: length, first_doc, first_text_hash, first_start, doc, text_hash, start."""
    texts = _keyed(docs)
    names = ["length", "first_doc", "first_text_hash", "first_start", "doc", "text_hash", "start"]

    def groups(batches):
        import pyarrow as pa

        def done(held, last):
            numbers, offsets, data = held.taken()
            anchor = numbers[0]
            end = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
            if not end:
                end = len(anchor) if last else 0
            if end < len(anchor):
                held.back(numbers, offsets, data, np.arange(end, len(anchor)))
            place = np.unique(numbers[:4, :end], axis=1, return_index=True)[1]  # repeated rows once
            place = place[np.argsort(anchor[place], kind="stable")]
            sizes = offsets[place + 1] - offsets[place]
            blob, cuts = gathered(data, offsets[place], sizes)
            for n, run, at in _groups(anchor[place], numbers[4][place], blob, cuts, plan) if len(place) else ():
                d, t, s = numbers[1][place[run]], numbers[2][place[run]], numbers[3][place[run]] + at
                o = int(np.lexsort((s, t, d))[0])
                same = lambda v: np.full(len(d), v, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (same(n), same(d[o]), same(t[o]), same(s[o]), d, t, s)], names)

        yield from _in_order(batches, plan, done)

    return _sorted_runs(runs(texts, _bitmap(texts, plan), plan, whole=True)).mapInArrow(groups, ", ".join(f"{x} long" for x in names))


def removal_spans(docs: DataFrame, plan: RepeatPlan = RepeatPlan()) -> DataFrame:
    """doc, th, start, end: every occurrence of a group but its first, joined within a task."""
    texts = _keyed(docs)

    def spans(batches):
        import pyarrow as pa

        def out(*cols):
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["doc", "th", "start", "end"])

        def done(held, last):
            numbers, offsets, data = held.taken()
            kept, copies = _distinct(numbers, offsets, data)
            doc, th, start = numbers[1:4]
            yield out(*_merged(doc[copies], th[copies], start[copies], start[copies] + np.diff(offsets)[copies]))
            anchor = numbers[0][kept]
            end = len(kept) if last else int(np.searchsorted(anchor, anchor[-1]))
            if end < len(kept):
                held.back(numbers, offsets, data, kept[end:])
            own = kept[:end]
            blob, cuts = gathered(data, offsets[own], offsets[own + 1] - offsets[own])
            doc, th, start, found, size = doc[own], th[own], start[own], [], 0
            for n, run, at in _groups(anchor[:end], numbers[4][own], blob, cuts, plan) if end else ():
                d, t, s = doc[run], th[run], start[run] + at
                o = np.lexsort((s, t, d))[1:]
                found.append((d[o], t[o], s[o], s[o] + n))
                size += len(o)
                if size > 300_000:  # groups of a hot anchor cover the same bytes again and again
                    found, size = [_merged(*(np.concatenate(x) for x in zip(*found, strict=True)))], 0
            if found:
                yield out(*_merged(*(np.concatenate(x) for x in zip(*found, strict=True))))

        def with_bytes():
            for b in batches:
                null = b.column(6).is_null()
                copies = b.filter(null)
                if len(copies):
                    at = copies.column(3).to_numpy()
                    ready.append(out(copies.column(1).to_numpy(), copies.column(2).to_numpy(), at, at + copies.column(4).to_numpy()))
                    b = b.filter(pa.array(~np.asarray(null)))
                yield b

        ready: list = []
        for x in _in_order(with_bytes(), plan, done):
            yield from ready
            ready.clear()
            yield x
        yield from ready

    return _sorted_runs(runs(texts, _bitmap(texts, plan), plan)).mapInArrow(spans, "doc long, th long, start long, end long")


def without_repeats(docs: DataFrame, plan: RepeatPlan = RepeatPlan(), keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with keep_bytes also kept and spans) for every row."""
    spans = written(removal_spans(docs, plan), "spans")
    per = spans.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s")).select("doc", "th", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    joined = keyed.join(per, ["doc", "th"], "left").select("doc_id", "text", "starts", "ends")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary, spans array<struct<start: long, end: long>>" if keep_bytes else ""

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, starts, ends in zip(b.column(1), b.column(2), b.column(3), strict=True):
                raw = (t.as_py() or "").encode()
                cuts: list[list[int]] = []
                if starts.is_valid:
                    for s, e in zip(starts.values.to_pylist(), ends.values.to_pylist(), strict=True):
                        if cuts and s <= cuts[-1][1]:
                            cuts[-1][1] = max(cuts[-1][1], e)
                        else:
                            cuts.append([s, e])
                sha, at, kept = hashlib.sha256(), 0, []
                for s, e in [*cuts, [len(raw), len(raw)]]:
                    sha.update(raw[at:s])
                    if keep_bytes:
                        kept.append(raw[at:s])
                    at = e
                row = [len(raw), sum(e - s for s, e in cuts), len(cuts), sha.hexdigest()]
                out.append([*row, b"".join(kept), [{"start": s, "end": e} for s, e in cuts]] if keep_bytes else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + ([pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] if keep_bytes else [])
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept", "spans"] if keep_bytes else [])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names)

    return joined.mapInArrow(rows, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
