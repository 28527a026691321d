"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

A line is normalised to its words: A-Z lower-cased, white space and ASCII punctuation as separators, digits as they are. In scripts
without blanks each character is a word, and counts as half a one. Lines with fewer than min_words words are compared for equality only.
Equal normalised lines are one node. Two nodes link when
their edit similarity (1 - distance / longer length, on normalised text) is at least min_similarity. Candidates agree in a block, by the
pigeonhole idea that an edit spoils a few blocks only. Blocks of sign bits would do for nearly equal lines alone: one word of ten changed
turns every seventh bit of a SimHash (README: measured recall). So a block holds `rows` word pairs, each the least
of the line's under a hash function of its own, and lines of up to short_words words have three blocks more, of their first and last words, one of which outlives any
edit of one word. The 1,024 sign bits of the SimHash over the different words are the second test: lines of a block that differ in more than sign_bits (short_bits in short lines) are no pair.
Blocks that occur once are left out by a bitmap, lengths that rule the similarity out by the join, and linkage.py keeps the tests of a bucket linear.
Of each connected group the first occurrence (smallest doc_id, then place) stays, all others go.

One pass over the texts makes a table of lines, with numbers for all that follows and the text of a long line's first occurrence in a slice;
a row holds the lines of a slice of the texts as arrays, which later passes read whole. Lines that occur
once and have no partner are sorted out by bitmaps before anything is joined; a line that occurs in every document is one node, counted by a
combined aggregate. Equality of lines is that of 64 and further 32 bits of hash.

Edge cases: null text is empty and stays as it is; a document that loses lines and with them at least the share most_lost of its words is dropped by
deduped() and reported as dropped (1: all of its words; the pipeline drops near copies, with 0.8); rows that repeat a doc_id with the same text are one document; a null doc_id ranks before
all others, and documents with null ids are told apart by text. Very long lines are one line. deduped() returns the columns of docs,
all as they were but text and n_chars; with_lines_removed() adds n_lines, n_removed and dropped and replaces columns of these names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import batches_of, forget, fresh, small_side, table, tidy, written
from axonwave.llm.linkage import linked_groups
from axonwave.llm.repeats import bitmap_of, owners_for, packed_by_owner, tested

NO_DOC = -(1 << 63)
SIGN = tuple(f"s{i}" for i in range(16))  #: columns of the SimHash


@dataclass(frozen=True)
class LinePlan:
    min_words: int = 5
    min_similarity: float = 0.8
    rows: int = 3  #: word pairs in a block
    blocks: int = 10
    short_words: int = 10  #: lines of up to so many words have blocks of their first and last words as well
    sign_bits: int = 208  #: of 1024 that may differ: the angle whose cosine is 0.8
    short_chars: int = 100  #: in lines of fewer characters a word is many bits:
    short_bits: int = 448
    bits: int = 27  #: of the bitmaps of repeated blocks and of candidate lines
    most_lost: float = 1.0  #: a document goes if it loses this share of its words


#: What stands between words.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32


def line_words(data: np.ndarray, offsets: np.ndarray):
    """(start, end, line of each word; row of each line; place of each line in its row)."""
    n = len(data)
    breaks = data == 10
    first = np.zeros(n + 1, bool)  # a line begins
    first[1:] = breaks
    first[offsets[:-1]] = True
    first = first[:n]
    line_start = np.flatnonzero(first)
    row = np.searchsorted(offsets, line_start, "right") - 1
    place = np.arange(len(line_start)) - np.searchsorted(line_start, offsets[row])
    inside = ~_SEPARATOR[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    lead = unspaced(data)
    begins = inside & (~before | first) | lead
    at = np.flatnonzero(lead)
    behind = at + np.where(data[at] >= 0xF0, 4, 3)
    behind = behind[behind < n]
    begins[behind] |= inside[behind]
    start = np.flatnonzero(begins)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & ~first[1:] & ~begins[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(line_start, start, "right") - 1, row, place


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where characters of scripts without blanks begin (Chinese, Japanese, Thai, Lao, Burmese, Khmer): each is a word."""
    out, at = np.zeros(len(data), bool), np.flatnonzero(data >= 0xE0)  # few bytes in most texts
    if len(at):
        lead, second = data[at], np.where(at + 1 < len(data), data[np.minimum(at + 1, len(data) - 1)], np.uint8(0))
        thai = (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
        khmer = (lead == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second >= 0x9E) & (second <= 0x9F))
        out[at] = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xF0) & (second >= 0xA0) & (second <= 0xB3) | thai | khmer
    return out


def signs(words: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of 64 bits of each line: the majority of its words' bits, ties as 0."""
    most = 255  #: words that a counter of eight bits can take
    parts, at, heads = -(-count // most), begin, None
    if len(count) and int(parts.max()) > 1:
        line = np.repeat(np.arange(len(begin)), parts)
        heads = np.cumsum(parts) - parts
        at = begin[line] + most * (np.arange(len(line)) - np.repeat(heads, parts))
    bits = np.empty((len(begin), 8, 8), bool)
    half = (count // 2).astype(np.uint8 if heads is None else np.int32)[:, None]
    for k in range(8):  # the bits k, k + 8, ... of a word are counted at once, each in a byte of its own
        n = np.add.reduceat((words >> np.uint64(k)) & np.uint64(0x0101010101010101), at).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        bits[:, :, k] = (n if heads is None else np.add.reduceat(n.astype(np.int32), heads)) > half
    return np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def block_keys(words: np.ndarray, begin: np.ndarray, count: np.ndarray, plan: LinePlan) -> tuple[np.ndarray, np.ndarray]:
    """(line of each key, key) of lines whose word hashes begin at begin and follow one another without gaps."""
    from axonwave.llm.vectors import mix

    last = begin + count - 1
    follows = np.append(words[1:], np.uint64(0))
    follows[last] = np.uint64(0x1D8E4E27C47D124F)
    odd = mix(np.arange(1, plan.rows * plan.blocks + 1, dtype=np.uint64)) | np.uint64(1)
    every, keys = np.arange(len(begin)), []

    def key(number: int, of, at):
        out = np.full(len(at), number, np.uint64)
        for x in of:
            out = mix(out + x)
        return at, out

    with np.errstate(over="ignore"):
        pair = mix(words * np.uint64(0x9E3779B97F4A7C15) + mix(follows))
        for b in range(plan.blocks):
            keys.append(key(b + 1, [np.minimum.reduceat(pair * odd[b * plan.rows + r], begin) for r in range(plan.rows)], every))
        few = np.flatnonzero((count <= plan.short_words) & (count >= 4))
        i, j = begin[few], last[few]
        keys.append(key(101, (words[i], words[i + 1], words[i + 2]), few))
        keys.append(key(102, (words[j], words[j - 1], words[j - 2]), few))
        keys.append(key(103, (words[i], words[i + 1], words[j - 1], words[j]), few))
    return np.concatenate([k[0] for k in keys]), np.concatenate([k[1] for k in keys])


def _lines(batches, plan: LinePlan):
    """For each slice: batch, first row, plain bytes, (word start, end, hash) and per line with a word: row, place, node, check, first word, words, long."""
    from axonwave.llm.vectors import mix, powers, prefix_sums, slices, span_hashes

    for b in batches:
        for first, data, offsets in slices(b.column(2)):
            if not len(data):
                continue
            data = _PLAIN[data]
            start, end, line, row, place = line_words(data, offsets)
            if not len(start):
                continue
            begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            count = np.diff(np.append(begin, len(line)))
            alone = unspaced(data)[start]
            long = 2 * count - np.add.reduceat(alone.astype(np.int64), begin) >= 2 * plan.min_words
            h = span_hashes(prefix_sums(data), start, end)
            with np.errstate(over="ignore"):
                order = np.arange(len(h)) - np.repeat(begin, count)
                most = int(count.max()) + 1
                node = mix(np.add.reduceat(h * powers(0xD1342543DE82EF95, most)[order], begin) + count.astype(np.uint64))
                check = mix(np.add.reduceat(mix(h) * powers(0xA0761D6478BD642F, most)[order], begin)) >> np.uint64(32)
            line = line[begin]
            yield b, first, data, start, end, h, row[line], place[line], node, check.astype(np.uint32).view(np.int32), begin, count, long


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


#: A slice of the texts, a row with arrays: of its lines, and of its long lines (own: which; of several equal ones, one).
LINES = {"doc": np.int64, "th": np.int64, "pos": np.int32, "node": np.int64, "check": np.int32, "words": np.int32, "doc_words": np.int64}
LONG = {"own": np.int32, "n": np.int32, "n_keys": np.int32, "keys": np.uint64, "sizes": np.int32, "line": np.uint8}
SLICES = ", ".join(f"{c} binary" for c in (*LINES, *LONG))
#: For a table of slices: row groups by bytes, looked at after few rows, as a row is large.
FEW_LARGE_ROWS = {"parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4"}
#: Arrow batches of texts and slices: a worker holds one and what is made of it, and its task another.
HELD = "4m"
PACKED = 1 << 18  #: hashes that a task sorts at once


def _packed(arrays: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(arrays[c], kind).tobytes()], pa.binary()) for c, kind in (LINES | LONG).items()], [*LINES, *LONG])


def _slices(batches):
    """The arrays of each slice, by name, of the columns there are."""
    for b in batches:
        for k in range(len(b)):
            yield {c: np.frombuffer(b.column(c)[k].as_buffer(), (LINES | LONG)[c]) for c in b.schema.names}


def _few(lines: DataFrame, *columns: str, parts: int) -> DataFrame:
    """Columns that are a small share of the bytes, so that a task reads those of several parts; no fewer tasks than cores."""
    n = lines.rdd.getNumPartitions()
    return lines.select(*columns).coalesce(max(-(-n // parts), min(n, lines.sparkSession.sparkContext.defaultParallelism)))


def line_slices(docs: DataFrame, plan: LinePlan) -> DataFrame:
    """Rows of SLICES: doc, th (hash of the text), pos, node, check, words, doc_words (of all its lines) of every line with a word; of long ones n (characters), keys, line.

    Of the long lines that a slice of the texts has several times, one is in LONG; line: its normalised text, words and single blanks, sizes its bytes.
    """

    def rows(batches):
        from axonwave.llm.vectors import gathered

        for b, first, data, start, end, h, row, place, node, check, begin, count, long in _lines(batches, plan):
            doc, th = (b.column(c).to_numpy()[first + row] for c in (0, 1))
            out = {"doc": doc, "th": th, "pos": place, "node": node.view(np.int64), "check": check, "words": count, "doc_words": np.bincount(row, count)[row]}
            own = np.flatnonzero(long)
            own = np.sort(own[np.unique(node[own], return_index=True)[1]])
            out |= {c: np.zeros(0, kind) for c, kind in LONG.items()} | {"own": own}
            if len(own):
                sub = np.zeros(len(node), bool)
                sub[own] = True
                w, c = h[np.repeat(sub, count)], count[own]
                line, k = block_keys(w, np.cumsum(c) - c, c, plan)
                out |= {"n_keys": np.bincount(line, minlength=len(own)), "keys": k[np.argsort(line, kind="stable")]}
                gap = _SEPARATOR[data]
                stays = ~gap
                stays[1:] |= gap[1:] & ~gap[:-1]  # of the separators behind a word one blank
                at_byte = np.zeros(len(data) + 1, np.int64)
                np.cumsum(stays, out=at_byte[1:])
                i, j = start[begin[own]], end[begin[own] + c - 1]
                size = at_byte[j] - at_byte[i]
                out |= {"n": size, "sizes": size, "line": gathered(np.where(gap, np.uint8(32), data)[stays], at_byte[i], size)[0]}
                if int(data.max()) >= 0x80:
                    np.cumsum((data & 0xC0) == 0x80, out=at_byte[1:])
                    out["n"] = size - (at_byte[j] - at_byte[i])
            yield _packed(out)

    return _keyed(docs).mapInArrow(tidy(rows), SLICES)


def line_table(docs: DataFrame, plan: LinePlan) -> DataFrame:
    """The same with a row for each line; n, keys and line are null but where the slices have them."""

    def rows(batches):
        import pyarrow as pa

        for x in _slices(batches):
            m, at = len(x["node"]), x["own"]
            n = np.zeros(m, np.int32)
            n[at] = x["n"]
            cells = [[None] * m, [None] * m]
            for cell, cuts, blob in zip(cells, (8 * x["n_keys"], x["sizes"]), (x["keys"].tobytes(), x["line"].tobytes()), strict=True):
                ends = np.cumsum(cuts)
                for k, i, j in zip(at.tolist(), (ends - cuts).tolist(), ends.tolist(), strict=True):
                    cell[k] = blob[i:j]
            cols = [pa.array(x[c]) for c in LINES] + [pa.array(n), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*LINES, "n", "keys", "line"])

    return line_slices(docs, plan).mapInArrow(tidy(rows), "doc long, th long, pos int, node long, check int, words int, doc_words long, n int, keys binary, line string")


def sliced(lines: DataFrame) -> DataFrame:
    """Slices of rows of line_table()."""

    def rows(batches):
        for b in batches:
            if len(b):
                some = b.filter(b.column("line").is_valid())
                line, keys = some.column("line").to_pylist(), some.column("keys").to_pylist()
                line = [x.encode() for x in line]
                out = {c: b.column(c).to_numpy() for c in LINES} | {"own": np.flatnonzero(b.column("line").is_valid().to_numpy(zero_copy_only=False)), "n": some.column("n").to_numpy()}
                out |= {"n_keys": np.array([len(x) // 8 for x in keys]), "keys": np.frombuffer(b"".join(keys), np.uint64), "sizes": np.array([len(x) for x in line]), "line": np.frombuffer(b"".join(line), np.uint8)}
                yield _packed(out)

    return lines.select(*LINES, "n", "keys", "line").mapInArrow(tidy(rows), SLICES)


def _values(column) -> np.ndarray:
    """The keys of all rows (none null), from the column's own buffer."""
    cuts = np.frombuffer(column.buffers()[1], np.int32)
    first, last = cuts[column.offset], cuts[column.offset + len(column)]
    return np.frombuffer(column.buffers()[2], np.uint8)[first:last].copy().view(np.uint64) if last > first else np.zeros(0, np.uint64)


def _rows_of(x: dict, keep: np.ndarray):
    """node, n, keys, line of the long lines of a slice that are to be kept."""
    import pyarrow as pa

    from axonwave.llm.vectors import gathered

    at, cols = np.flatnonzero(keep), []
    for kind, cuts, blob in ((pa.binary(), 8 * x["n_keys"].astype(np.int64), x["keys"].view(np.uint8)), (pa.string(), x["sizes"].astype(np.int64), x["line"])):
        data, offsets = gathered(blob, (np.cumsum(cuts) - cuts)[at], cuts[at])
        cols.append(pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]))
    return pa.RecordBatch.from_arrays([pa.array(x["node"][x["own"]][at]), pa.array(x["n"][at]), *cols], ["node", "n", "keys", "line"])


def bucketed(lines: DataFrame, again, plan: LinePlan) -> DataFrame:
    """node, n, line, buckets (those of its blocks that seem to occur in more than one node) of the long lines that have any, each once; a written table.

    lines: slices; again: bitmap of the nodes that occur more than once.
    """
    spark, owners = lines.sparkSession, owners_for(lines)
    long = lines.select("node", "own", "n", "n_keys", "keys", "sizes", "line")

    def seen(x, test):
        return test(x["node"][x["own"]].view(np.uint64))

    def several(batches):
        test = tested(again.value, plan.bits)
        for x in _slices(batches):
            yield _rows_of(x, seen(x, test))

    rows = "node long, n int, keys binary, line string"
    once = written(long.mapInArrow(tidy(several), rows).repartition("node").dropDuplicates(["node"]), "once", HELD)

    def keys(batches):
        test = tested(again.value, plan.bits)
        yield from packed_by_owner((x["keys"][np.repeat(~seen(x, test), x["n_keys"])] for x in _slices(batches)), owners, PACKED)

    def keys_once(batches):
        yield from packed_by_owner((_values(b.column(0)) for b in batches if len(b)), owners, PACKED)

    blobs = "owner int, hashes binary"
    with batches_of(spark, HELD):
        found = _few(lines, "node", "own", "n_keys", "keys", parts=2).mapInArrow(tidy(keys), blobs).unionByName(once.select("keys").mapInArrow(tidy(keys_once), blobs))
        repeated = spark.sparkContext.broadcast(bitmap_of(found, owners, plan.bits))

    def hits(b, test):
        """Rows with a list of their keys that the bitmap holds."""
        import pyarrow as pa
        import pyarrow.compute as pc

        k, size = _values(b.column(2)), pc.binary_length(b.column(2)).to_numpy() // 8
        hit = test(k)
        of = np.bincount(np.repeat(np.arange(len(b)), size)[hit], minlength=len(b))
        some = of > 0
        offsets = np.concatenate([[0], np.cumsum(of[some])]).astype(np.int32)
        b = b.filter(pa.array(some))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.ListArray.from_arrays(pa.array(offsets), pa.array(k[hit].view(np.int64)))], ["node", "n", "line", "buckets"])

    def rest(batches):
        test, other = tested(repeated.value, plan.bits), tested(again.value, plan.bits)
        for x in _slices(batches):
            own = ~seen(x, other)
            at = np.repeat(np.arange(len(own)), x["n_keys"])
            keep = np.bincount(at[test(x["keys"]) & own[at]], minlength=len(own)) > 0
            if keep.any():
                yield hits(_rows_of(x, keep), test)

    def rest_once(batches):
        test = tested(repeated.value, plan.bits)
        for b in batches:
            if len(b):
                yield hits(b, test)

    rows = "node long, n int, line string, buckets array<long>"
    out = written(long.mapInArrow(tidy(rest), rows).unionByName(once.select("node", "n", "keys", "line").mapInArrow(tidy(rest_once), rows)), "texts", HELD)
    forget(once), repeated.destroy()
    return out


def _nodes_of(df: DataFrame, owners: int, bits: int, least: int):
    """Bitmap of the nodes of rows or of slices that occur least times."""
    packed = df.schema["node"].dataType.typeName() == "binary"

    def hashes(batches):
        some = (x["node"] for x in _slices(batches)) if packed else (b.column(0).to_numpy() for b in batches if len(b))
        yield from packed_by_owner((x.view(np.uint64) for x in some), owners, PACKED)

    with batches_of(df.sparkSession, HELD):
        return df.sparkSession.sparkContext.broadcast(bitmap_of((_few(df, "node", parts=6) if packed else df.select("node")).mapInArrow(tidy(hashes), "owner int, hashes binary"), owners, bits, least))


def signs_of(batches):
    """node, n, the words of the SimHash of each line, from batches of node, n, line."""
    import pyarrow as pa

    from axonwave.llm.vectors import mix, prefix_sums, slices, span_hashes

    for b in batches:
        for first, data, offsets in slices(b.column(2)):
            rows = len(offsets) - 1
            start, end, line, row, _ = line_words(data, offsets)
            w, row = span_hashes(prefix_sums(data), start, end), row[line]
            # each word of a line once, so that the frequent ones do not rule
            order = np.argsort(row.astype(np.uint64) << np.uint64(48) | w >> np.uint64(16)) if rows < 1 << 16 else np.lexsort((w, row))
            w, row = w[order], row[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
            w, row = w[new], row[new]
            begin = np.searchsorted(row, np.arange(rows))
            count, cols = np.bincount(row, minlength=rows), []
            for _ in SIGN:
                cols.append(pa.array(signs(w, begin, count).view(np.int64)))
                w = mix(w)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), b.column(1).slice(first, rows), *cols], ["node", "n", *SIGN])


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel on integers of any length."""
    if not a or not b:
        return max(len(a), len(b))
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    up, down, distance, top = full, 0, len(a), 1 << (len(a) - 1)
    for c in b:
        match = places.get(c, 0)
        x = match | down
        d0 = (((x & up) + up) ^ up) | x
        plus, minus = down | ~(d0 | up) & full, up & d0
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(d0 | plus)) & full, plus & d0 & full
    return distance


def _judged(a: str, b: str, most: float) -> tuple[bool | None, str, str]:
    """(whether the distance is at most that, None if it takes the exact one; what differs). The cost of some way to edit words, if it is low enough, saves the exact distance."""
    if abs(len(a) - len(b)) > most:
        return False, a, b
    i = _common(a, b)
    a, b = a[i:], b[i:]
    i = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - i], b[: len(b) - i]
    if max(len(a), len(b)) <= most:
        return True, a, b
    if not a or not b:
        return False, a, b
    x, y, i, j, cost = a.split(" "), b.split(" "), 0, 0, 0
    size = lambda words: sum(map(len, words)) + len(words)
    while i < len(x) and j < len(y) and cost <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        # where the two go on alike: words changed, left out or put in
        ahead = ((k, skip - k) for skip in range(1, 7) for k in (skip // 2, *range(skip, -1, -1)) if i + k < len(x) and j + skip - k < len(y) and x[i + k] == y[j + skip - k])
        gone, new = next(ahead, (len(x) - i, len(y) - j))
        cost += max(size(x[i : i + gone]), size(y[j : j + new]))
        i, j = i + gone, j + new
    return cost + max(size(x[i:]), size(y[j:])) <= most or None, a, b


def _most(a: str, b: str, similarity: float) -> float:
    return (1 - similarity) * max(len(a), len(b)) + 1e-9


def close(a: str, b: str, similarity: float) -> bool:
    """Whether the edit similarity is at least that."""
    most = _most(a, b, similarity)
    found, a, b = _judged(a, b, most)
    return edit_distance(a, b) <= most if found is None else found


def close_pairs(a: list[str], b: list[str], similarity: float) -> np.ndarray:
    """close() of many pairs."""
    out, left = judged_pairs(a, b, similarity)
    out[left[0]] = within(*left[1:])
    return out


def judged_pairs(a: list[str], b: list[str], similarity: float) -> tuple[np.ndarray, tuple[np.ndarray, list[str], list[str], np.ndarray]]:
    """(close() of the pairs that need no exact distance; which of them do, what differs in these, the most that their distance may be)."""
    most = np.array([_most(x, y, similarity) for x, y in zip(a, b, strict=True)])
    judged = [_judged(x, y, m) for x, y, m in zip(a, b, most.tolist(), strict=True)]
    left = np.array([k for k, (found, _, _) in enumerate(judged) if found is None], np.int64)
    a, b = [judged[k][1] for k in left], [judged[k][2] for k in left]
    near = np.flatnonzero(_at_least(a, b) <= most[left])
    left, a, b = left[near], [a[k] for k in near], [b[k] for k in near]
    return np.array([bool(found) for found, _, _ in judged], bool), (left, a, b, most[left])


def _at_least(a: list[str], b: list[str]) -> np.ndarray:
    """No distance is below this: an edit takes away one character at most and brings one at most. Characters are counted by their last six bits."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 4096):
        counts = []
        for texts in (a[at : at + 4096], b[at : at + 4096]):
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(63)
            counts.append(np.bincount(np.repeat(64 * np.arange(len(texts)), size) + code, minlength=64 * len(texts)).reshape(-1, 64))
        more = counts[0] - counts[1]
        out[at : at + 4096] = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
    return out


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each distance is at most that: bit-parallel through all pairs at once, where enough have patterns of as many words of 64 bits."""
    out = np.zeros(len(a), bool)
    la, lb = (np.fromiter(map(len, texts), np.int64, len(texts)) for texts in (a, b))
    width = -(-la // 64)
    order = np.lexsort((lb, width))
    for own in np.split(order, np.flatnonzero(np.diff(width[order])) + 1) if len(order) else ():
        w = int(width[own[0]])
        step = min(4096, max(1, (1 << 22) // (64 * w)))
        for at in range(0, len(own), step):
            i = own[at : at + step]
            x, y = [a[k] for k in i], [b[k] for k in i]
            if len(i) < 16 * w:  # a step of Python for each is less than one of numpy
                distance = [edit_distance(*pair) for pair in zip(x, y, strict=True)]
            else:
                distance = _distances(x, y, la[i], lb[i], w)
            out[i] = distance <= most[i]
    return out


def _matrix(texts: list[str], size: np.ndarray, columns: int, fill: int) -> np.ndarray:
    """Code points, a row for each text."""
    out = np.full((len(texts), columns), fill, np.uint32)
    out[np.arange(columns) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _distances(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray, w: int) -> np.ndarray:
    """Levenshtein distances of pairs in the order of lb; each a has 1 to 64 w characters."""
    rows, text = _matrix(a, la, 64 * w, 1 << 21), _matrix(b, lb, int(lb.max()), 1 << 22).T.copy()
    one, high = np.uint64(1), np.uint64(63)
    up, down = np.full((w, len(a)), ~np.uint64(0)), np.zeros((w, len(a)), np.uint64)
    ended = np.searchsorted(lb, np.arange(len(text)), "right")
    for c, k in zip(text, ended.tolist(), strict=True):  # the first k texts have ended
        match = np.packbits(rows[k:] == c[k:, None], axis=1, bitorder="little").view("<u8")
        carry, plus_in, minus_in = np.uint64(0), one, np.uint64(0)
        for v in range(w):
            u, d = up[v, k:], down[v, k:]
            x = match[:, v] | d
            low = x & u
            total = low + u
            more = total < low
            total += carry
            carry = (more | (total < carry)).astype(np.uint64)
            d0 = (total ^ u) | x
            plus, minus = d | ~(d0 | u), u & d0
            plus_out, minus_out = plus >> high, minus >> high
            plus, minus = plus << one | plus_in, minus << one | minus_in
            plus_in, minus_in = plus_out, minus_out
            up[v, k:], down[v, k:] = minus | ~(d0 | plus), plus & d0
    out = lb.copy()
    for v in range(w):  # the last column, summed from its top down to the end of a
        bits = np.clip(la - 64 * v, 0, 64).astype(np.uint64)
        mask = np.where(bits == 64, ~np.uint64(0), (one << (bits & high)) - one)
        out += np.bitwise_count(up[v] & mask).astype(np.int64) - np.bitwise_count(down[v] & mask).astype(np.int64)
    return out


def line_links(lines: DataFrame, again, plan: LinePlan = LinePlan()) -> DataFrame:
    """node, component of the lines that are linked with others."""
    def sizes(x, y):
        return F.least(x("n"), y("n")) >= plan.min_similarity * F.greatest(x("n"), y("n")) - 1e-6

    def alike(x, y):
        differ = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in SIGN), F.lit(0))
        return differ <= F.when(F.least(x("n"), y("n")) < plan.short_chars, plan.short_bits).otherwise(plan.sign_bits)

    def similar(batches):
        """Pairs that need an exact distance are gathered over the batches, up to a bound: many at once take less."""
        import pyarrow as pa

        held, characters = [], 0

        def rows(x, y):
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        def settled():
            x, y, a, b, most = zip(*held, strict=True)
            found = within([*chain(*a)], [*chain(*b)], np.concatenate(most))
            return rows(np.concatenate(x)[found], np.concatenate(y)[found])

        for b in batches:
            found, (left, *texts, most) = judged_pairs(b.column(2).to_pylist(), b.column(3).to_pylist(), plan.min_similarity)
            x, y = (b.column(k).to_numpy() for k in (0, 1))
            yield rows(x[found], y[found])
            held.append((x[left], y[left], *texts, most))
            characters += sum(map(len, texts[0])) + sum(map(len, texts[1]))
            if characters > 4 << 20:
                yield settled()
                held, characters = [], 0
        if held:
            yield settled()

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("node").alias(c), F.col("line").alias(f"line_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "line_a", "line_b").mapInArrow(tidy(similar), "a long, b long")

    texts = bucketed(lines, again, plan)
    described = texts.select("node", "n", "line").mapInArrow(tidy(signs_of), "node long, n int, " + ", ".join(f"{c} long" for c in SIGN))
    out = linked_groups(texts.select(F.explode("buckets").alias("bucket"), "node", "n"), verify, carry=("n",), near=sizes, attributes=described, alike=alike, large=1 << 62, plain=True, batch=HELD)
    forget(texts)
    return out


def grouped_lines(lines: DataFrame, plan: LinePlan) -> tuple[DataFrame, list[DataFrame]]:
    """doc, th, pos, words, doc_words, node and first (struct doc, th, pos of the occurrence that stays) of all lines that occur more than once or are linked.

    lines: line_slices() or line_table(), as a written table. With the tables that it reads, to be dropped after use.
    """
    owners, rows = owners_for(lines), None
    if "own" not in lines.columns:
        lines = rows = written(sliced(lines), "lines", HELD, **FEW_LARGE_ROWS)
    again = _nodes_of(lines, owners, plan.bits, 2)
    linked = line_links(lines, again, plan)
    joined = _nodes_of(linked, owners, plan.bits, 1)

    def several(batches):
        import pyarrow as pa

        twice, other = tested(again.value, plan.bits), tested(joined.value, plan.bits)
        for x in _slices(batches):
            node = x["node"].view(np.uint64)
            keep = twice(node) | other(node)
            yield pa.RecordBatch.from_arrays([pa.array(x[c][keep]) for c in LINES], [*LINES])

    some = _few(lines, *LINES, parts=4).mapInArrow(tidy(several), "doc long, th long, pos int, node long, check int, words int, doc_words long").join(linked, "node", "left")
    some = some.withColumns({"group": F.coalesce("component", "node"), "own": F.when(F.col("component").isNull(), F.col("check"))})
    some = written(some.select("doc", "th", "pos", "node", "words", "doc_words", "group", "own"), "several", HELD)
    again.destroy(), joined.destroy(), forget(rows)
    first = some.groupBy("group", "own").agg(F.count("*").alias("of"), F.min(F.struct("doc", "th", "pos")).alias("first")).where("of > 1")
    first = written(first.select("group", F.col("own").alias("_own"), "first"), "first")
    forget(linked)
    return some.join(small_side(first), "group").where("own <=> _own").select("doc", "th", "pos", "words", "doc_words", "node", "first"), [some, first]


def line_groups(lines: DataFrame, plan: LinePlan = LinePlan()) -> DataFrame:
    """grouped_lines() as a written table."""
    groups, tables = grouped_lines(lines, plan)
    out = written(groups, "groups")
    for t in tables:
        forget(t)
    return out


def removed_lines(docs: DataFrame, plan: LinePlan = LinePlan()) -> DataFrame:
    """doc, th, lost (places of the lines that go), dropped, of the documents that lose any; a written table."""
    lines = written(line_slices(docs, plan), "lines", HELD, **FEW_LARGE_ROWS)
    groups, tables = grouped_lines(lines, plan)
    stays = (F.col("doc") == F.col("first.doc")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))
    gone = groups.where(~stays)
    # places and their words: rows that repeat a document add nothing
    lost = gone.groupBy("doc", "th").agg(F.collect_set(F.struct("pos", "words")).alias("lines"), F.max("doc_words").alias("all"))
    words = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    out = written(lost.select("doc", "th", F.col("lines.pos").alias("lost"), (words >= plan.most_lost * F.col("all")).alias("dropped")), "lost")
    for t in (lines, *tables):
        forget(t)
    return out


def _marked(docs: DataFrame, plan: LinePlan, name: str) -> DataFrame:
    """docs and a struct column: text, n_lines, n_removed, dropped of what is left."""
    lost = removed_lines(docs, plan).select(F.struct("doc", "th").alias(f"{name}_key"), F.col("lost").alias(f"{name}_lost"), F.col("dropped").alias(f"{name}_gone"))
    key = F.struct(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_DOC)), F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    out = docs.join(lost.hint("shuffle_hash"), key == F.col(f"{name}_key"), "left")  # texts are dealt, not sorted
    parts, gone = F.split("text", "\n", -1), F.col(f"{name}_lost")
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1  # most texts need not be split
    found = F.struct(
        text.alias("text"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.col(f"{name}_gone"), F.lit(False)).alias("dropped"),
    )
    return out.withColumn(name, found).drop(f"{name}_key", f"{name}_lost", f"{name}_gone")


def with_lines_removed(docs: DataFrame, plan: LinePlan = LinePlan()) -> DataFrame:
    """docs with text and n_chars of what is left, and n_lines, n_removed, dropped."""
    name = fresh(docs, "_found")
    out = _marked(docs, plan, name)
    new = {c: F.col(f"{name}.{c}") for c in ("text", "n_lines", "n_removed", "dropped")}
    return out.withColumns(new | {"n_chars": F.length(F.col(f"{name}.text")).cast("long")}).drop(name)


def deduped(docs: DataFrame, plan: LinePlan = LinePlan()) -> DataFrame:
    """The documents that keep something, with the columns of docs."""
    name = fresh(docs, "_found")
    new = {"text": F.col(f"{name}.text")} | ({"n_chars": F.length(F.col(f"{name}.text")).cast("long")} if "n_chars" in docs.columns else {})
    return _marked(docs, plan, name).where(f"NOT {name}.dropped").withColumns(new).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_lines_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "dropped", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
