"""Bounded-space online best-fit packing of token pieces into sequences.

Each task packs its pieces as they come and keeps a fixed number of bins open. A bitset has bit s set
where an open bin has s tokens of free space; the best fit for a piece is its lowest bit at or above the
piece's length, found by one shift. A piece that fits nowhere opens a bin, and when all are in use the fullest closes first.
A piece as long as a sequence is one by itself. A closed bin is final; so tasks hold the pieces of their open bins and
nothing else, however many documents they read, and the first pass needs no shuffle.

What tasks have open at their end goes up a tree: the pieces of `fan_in` tasks are dealt to one task
of the next level, which packs them the same way, until one task is left and its bins are final. A level has at
most open_bins sequences a task of the level before, so it shrinks by the fan-in whatever the corpus. Every level
is a table in the shared folder; sequence numbers name level, task and bin.

Tokens: white space ends every token of the word vocabulary, so texts are cut there and each word is
encoded by the library once for a memory of words (bounded; it only saves time). The ids are those of the whole text.

Edge cases: a null or empty text is the end id alone; null ids and repeated rows are packed row by row; very long
texts are encoded word by word and leave piece by piece; an empty table gives an empty table; other columns are not read by
`tokenised`, and `packed` carries whatever columns a piece has.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import fresh, table, written


@dataclass(frozen=True)
class Packing:
    size: int = 4096  #: tokens of a sequence
    open_bins: int = 128  #: that a task keeps open
    fan_in: int = 16  #: tasks that one task of the next level takes over
    end_id: int = 1  #: closes every document


#: An ending that is a token run of its own, after a letter or digit of ASCII.
_ENDING = r"([a-z0-9])([.,!?;:]+)$"
_WORDS, _LONG = 1 << 19, 64


def _joined(flat, first, n, codes):
    """The runs flat[first[c] : first[c] + n[c]] of all codes, one after the other, and where each starts (and the last ends)."""
    import numpy as np

    each = n[codes]
    starts = np.concatenate(([0], np.cumsum(each)))
    return flat[np.repeat(first[codes] - starts[:-1], each) + np.arange(starts[-1])], starts


def _split(lists):
    """Offsets from 0, codes and different values of an Arrow array of lists."""
    import numpy as np

    ends = np.asarray(lists.offsets).astype(np.int64)
    values = lists.flatten().dictionary_encode()
    return ends - ends[0], np.asarray(values.indices), values.dictionary


class WordCoder:
    """Ids of texts from the ids of their different words."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library, self.known = Tokenizer.from_file(path), {}
        size = self.library.get_vocab_size()
        self.is_end = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _in_one(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, as one text: each ends with the one token that has the word-end mark."""
        import numpy as np

        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
        if len(ends) != len(words):  # what Python calls a letter is none for the library: some word is more than one run
            return self._each(words)
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers; long words are not remembered."""
        if len(self.known) > _WORDS:
            self.known.clear()
        ids = [self.known.get(w) for w in words]
        new = [k for k, i in enumerate(ids) if i is None]
        solid = [k for k in new if words[k].isalpha()]
        for how, which, step in ((self._in_one, solid, 1000), (self._each, [k for k in new if not words[k].isalpha()], 10_000)):
            for at in range(0, len(which), step):
                some = which[at : at + step]
                for k, i in zip(some, how([words[k] for k in some]), strict=True):
                    ids[k] = i
                    if len(words[k]) <= _LONG:
                        self.known[words[k]] = i
        return ids

    def encode_all(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow array; null is empty.

        Different words, then their different stems (in lower case, as the vocabulary) and endings; ids go back the same way.
        """
        import numpy as np
        import pyarrow.compute as pc

        ends, codes, words = _split(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
        plain = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        of_word, parts, stems = _split(pc.split_pattern(pc.replace_substring_regex(plain, _ENDING, r"\1 \2"), " "))
        ids = self._ids_of([w.as_buffer().to_pybytes().decode("utf-8", "replace") for w in stems])
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = _joined(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n, n, parts)
        upto = starts[of_word]
        out, starts = _joined(flat, upto[:-1], np.diff(upto), codes)
        cut = starts[ends].tolist()
        return [out[a:b].tobytes() for a, b in zip(cut, cut[1:])]


_coders: dict[str, WordCoder] = {}


def coder_of(path: str) -> WordCoder:
    """One coder for each vocabulary and Python worker."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = WordCoder(path)
    return _coders[path]


def tokenised(docs: DataFrame, path: str, cfg: Packing = Packing(), doc: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc, piece, start, length, ids_crc32, and with keep_ids also ids (binary, 4 bytes each): the pieces of each document with its end id."""
    schema = f"{doc} {docs.schema[doc].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    end, width = cfg.end_id.to_bytes(4, "little"), 4 * cfg.size

    def rows(batches):
        import pyarrow as pa

        coder = coder_of(path)
        for whole in batches:
            at = 0
            while at < len(whole):  # a slice of texts of a few MB, or one longer text
                upto, n = at, 0
                while upto < len(whole) and (upto == at or n < 8 << 20):
                    t = whole.column(1)[upto]
                    n, upto = n + (t.as_buffer().size if t.is_valid else 0), upto + 1
                b, at = whole.slice(at, upto - at), upto
                cols = [[], [], [], [], [], []]
                for row, ids in enumerate(coder.encode_all(b.column(1))):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), width)):
                        part = ids[start : start + width]
                        for c, v in zip(cols, (row, piece, start // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            c.append(v)
                out = [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]]]
                names = [doc, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out, names = [*out, pa.array(cols[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(doc, text).mapInArrow(rows, schema)


class OpenBins:
    """A fixed number of open bins; a bit for each amount of free space that one of them has."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.bits, self.count = size, most, 0, 0
        self.by_free: dict[int, list[list]] = {}  # bins [items...] by free space
        self.used = 0

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return out

    def put(self, item, length: int) -> list | None:
        """Places an item; a bin [number, (offset, item)...] if one closes by it."""
        closed, fits = None, self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            into = self._take(free)
        else:
            if self.count == self.most:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
            free, into, self.used = self.size, [self.used], self.used + 1
        into.append((self.size - free, item))
        if free == length:
            return into  # full; no bin was closed for it unless size == length, which callers do not put
        self.by_free.setdefault(free - length, []).append(into)
        self.bits |= 1 << (free - length)
        self.count += 1
        return closed

    def rest(self) -> Iterator[list]:
        for free in sorted(self.by_free):
            yield from self.by_free[free]


def _pack(keys, schema_in: list[str], length: str, level: int, cfg: Packing, schema):
    """Task function: batches of pieces -> the same columns with sequence, offset, task and whether the bin is still open."""

    def rows(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = bins = None
        out: list[tuple] = []

        def send(packed, open_):
            number = level << 58 | task << 32 | packed[0]
            out.extend((*item, number, offset, task, open_) for offset, item in packed[1:])

        def batch():
            cols = list(zip(*out, strict=True)) if out else [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in schema_in]
            lengths, tasks = b.column(length).to_pylist(), b.column(keys).to_pylist() if keys else None
            for r, item in enumerate(zip(*cols, strict=True)):
                mine = tasks[r] if keys else TaskContext.get().partitionId()
                if mine != task:
                    for left in bins.rest() if bins else ():
                        send(left, True)
                    task, bins = mine, OpenBins(cfg.size, cfg.open_bins)
                n = lengths[r]
                if n is None or not 0 < n <= cfg.size:
                    raise ValueError(f"a piece of {n} tokens")
                if n == cfg.size:
                    send([bins.used, (0, item)], False)
                    bins.used += 1
                elif closed := bins.put(item, n):
                    send(closed, False)
            if len(out) >= 10_000:
                yield batch()
        for left in bins.rest() if bins else ():
            send(left, True)
        yield batch()

    return rows


def packed(pieces: DataFrame, cfg: Packing = Packing(), length: str = "length") -> DataFrame:
    """pieces, each with sequence_id and offset: every sequence is gapless from 0 and has at most cfg.size tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, LongType, StructType

    names = pieces.columns
    if clash := {"sequence_id", "offset"} & {c.lower() for c in names}:
        raise ValueError(f"columns of pieces that the result needs: {sorted(clash)}")
    task, open_ = fresh(pieces, "task"), fresh(pieces, "open")
    schema = StructType(list(pieces.schema)).add("sequence_id", LongType()).add("offset", LongType()).add(task, LongType()).add(open_, BooleanType())
    arrow, level, done = to_arrow_schema(schema), 0, []
    placed = written(pieces.mapInArrow(_pack(None, names, length, level, cfg, arrow), schema), "packed")
    while True:
        rest = placed.where(F.col(open_))
        tasks = (rest.agg(F.max(task)).first()[0] or 0) + 1
        done.append(placed if tasks == 1 else placed.where(~F.col(open_)))
        if tasks == 1:
            break
        level, tasks = level + 1, -(-tasks // cfg.fan_in)
        dealt = rest.withColumn(task, F.floor(F.col(task) / cfg.fan_in)).repartition(tasks, task)
        dealt = dealt.sortWithinPartitions(task, F.xxhash64("sequence_id", "offset"), "sequence_id", "offset").drop("sequence_id", "offset", open_)
        placed = written(dealt.mapInArrow(_pack(task, names, length, level, cfg, arrow), schema), "packed")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop(task, open_)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (array<int>), length, documents: the packed sequences, from packed pieces with ids. A group is one sequence."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    word = lambda h: F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int")  # noqa: E731  little-endian
    ids = F.transform(F.sequence(F.lit(0), (F.col("length") - 1).cast("int")), lambda i: word(F.col("hex").substr(i * 8 + 1, F.lit(8))))
    per = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count("*").alias("documents"), F.concat_ws("", parts).alias("hex"))
    return per.select("sequence_id", ids.alias("ids"), "length", "documents")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(tokenised(table(spark, sf_dir, "documents"), vocabulary()))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
