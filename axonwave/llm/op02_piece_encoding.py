"""SentencePiece BPE encoding and decoding, exact, by backtracking.

Merge-type encoding has one result, and a sequence of pieces is that result if and only if
every two neighbours, taken alone, merge back to themselves (merges inside neighbours do not
depend on what is further away, so the first merge across a border would also happen in the
pair). The encoder therefore walks the text: an Aho-Corasick automaton gives the longest piece that
matches at a place, a table the next shorter ones; a piece is taken if its border with the one before holds,
which is tested once for each pair by merging the two again; where no piece fits, the place is
marked in a bitfield of failed positions and the walk steps back. No place fails twice, so the
time is linear in the text however long a word is. Most words need no step back: the automaton's run of leftmost longest
matches is followed as far as its borders hold.

Where no piece of the vocabulary holds two neighbouring characters together, no merge can span
them; texts are cut there, and the parts are encoded one by one and kept in a bounded memory. A
border from a word to a blank is such a place in a vocabulary with white space prefixes; the
model's pieces are checked for that, and a model that breaks it is cut at other places only.

Supported: BPE models with identity normalisation. Edge cases: null is the empty text, which
has begin and end ids only; U+2581 in a text is a blank to the model, as in the library; strings that
look like control symbols are ordinary text; other columns are not read by the query, and
repeated rows are encoded as often as they occur. Whole texts, no length limit.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import table, tidy

BLANK = "▁"


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a model: a table of the size of the vocabulary, sent with the task."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: bytes  #: n ordinary, s special (no piece of a text), u unknown, b byte; one letter an id
    dummy_prefix: bool
    begin: int
    end: int

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = bytes({1: ord("n"), 5: ord("n"), 2: ord("u"), 3: ord("s"), 6: ord("b")}[p.type] for p in proto.pieces)
        return cls(tuple(p.piece for p in proto.pieces), tuple(p.score for p in proto.pieces), kinds, norm.add_dummy_prefix, sp.bos_id(), sp.eos_id())


def merged(text: str, score: dict[str, float]) -> list[str]:
    """The merge-type encoding by its definition: join the best neighbours (leftmost on ties) until none can be."""
    parts, none, get = list(text), float("-inf"), score.get
    gain = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while gain and (best := max(gain)) > none:
        i = gain.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del gain[i]
        if i < len(gain):
            gain[i] = get(parts[i] + parts[i + 1], none)
        if i:
            gain[i - 1] = get(parts[i - 1] + parts[i], none)
    return parts


class PieceCodec:
    """Encoder and decoder of one model; words and pairs are remembered up to a number of entries."""

    def __init__(self, model: PieceModel, remember: int = 400_000):
        import ahocorasick

        self.model, self.remember = model, remember
        self.score = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k == ord("n")}
        self.id = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == ord("n")}
        self.unknown = model.kinds.find(b"u")
        bytes_ = [i for i, k in enumerate(model.kinds) if k == ord("b")]
        self.byte = bytes_ if len(bytes_) == 256 else None
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.id)
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, (len(p), self.id[p]))
        self.automaton.make_automaton()
        self.together = {pair for p in self.id for pair in zip(p, p[1:])}
        self.length = [len(p) for p in model.pieces]
        self.most = max(map(len, self.id), default=1)
        #: of each piece the longest shorter one that it starts with, or -1
        self.shorter = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1) for p in model.pieces]
        self.start = len(model.pieces) + 0x110000
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        special = (ord("s"), ord("u"))
        self.text = [b"" if k in special else bytes([int(p[3:5], 16)]) if k == ord("b") else p.replace(BLANK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.text[self.unknown] = " ⁇ ".encode() if self.unknown >= 0 else b""

    def _named(self, code: int) -> str:
        """The text of a code: a piece's id, or behind them a character without a piece, or behind those the start of a word."""
        size = len(self.model.pieces)
        return self.model.pieces[code] if code < size else chr(code - size) if code < self.start else ""

    def fits(self, key: int) -> bool:
        """Whether two neighbours (codes, in one integer) merge back to themselves."""
        both = [p for p in (self._named(key >> 32), self._named(key & 0xFFFFFFFF)) if p]
        if len(self.pairs) >= self.remember:
            self.pairs.clear()
        out = self.pairs[key] = merged("".join(both), self.score) == both
        return out

    def longest(self, word: str, pos: int) -> int:
        """The code of the longest match from pos; a character without a match stands alone."""
        for last, (length, i) in self.automaton.iter_long(word[pos : pos + self.most]):
            if last + 1 == length:
                return i
            break
        return len(self.model.pieces) + ord(word[pos])

    def next_shorter(self, word: str, pos: int, code: int) -> int:
        """The code of the next shorter match from pos, or -1."""
        if code >= len(self.model.pieces):
            return -1
        shorter = self.shorter[code]
        if shorter < 0 and self.length[code] > 1:
            return len(self.model.pieces) + ord(word[pos])
        return shorter

    def pieces(self, word: str) -> list[int]:
        """Codes: the run of longest matches as far as its borders hold, from there by backtracking."""
        n, size, length = len(word), len(self.model.pieces), self.length
        known, fits = self.pairs.get, self.fits
        out: list[int] = []
        pos, before, code = 0, self.start, -1
        for last, (span, i) in self.automaton.iter_long(word):
            if last - span + 1 != pos:
                break
            key = before << 32 | i
            ok = known(key)
            if not ok and (ok is not None or not fits(key)):
                code = self.next_shorter(word, pos, i)
                break
            out.append(i)
            pos, before = last + 1, i
        else:
            if pos == n:
                return out
        if code < 0:
            code = self.longest(word, pos)
        failed = None  # a bit for each position from which no encoding goes on
        while True:
            while code >= 0:
                end = pos + (length[code] if code < size else 1)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    key = before << 32 | code
                    ok = known(key)
                    if ok or ok is None and fits(key):
                        break
                code = self.next_shorter(word, pos, code)
            if code >= 0:
                out.append(code)
                if end == n:
                    return out
                pos, before = end, code
                code = self.longest(word, pos)
                continue
            if failed is None:
                failed = bytearray(n // 8 + 1)
            failed[pos >> 3] |= 1 << (pos & 7)
            if not out:
                raise AssertionError("no encoding; every text has one")
            last = out.pop()
            pos -= length[last] if last < size else 1
            before = out[-1] if out else self.start
            code = self.next_shorter(word, pos, last)

    def ids(self, word: str) -> list[int]:
        if len(word) == 1 and word in self.id:
            return [self.id[word]]
        codes, size = self.pieces(word), len(self.model.pieces)
        if max(codes) < size:
            return codes
        out = []
        for i in codes:
            if i < size:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in chr(i - size).encode())
            else:
                out.append(self.unknown)
        return out

    def parts(self, word: str) -> list[str]:
        """word, cut where no piece holds both neighbours."""
        together, out, start = self.together, [], 0
        for i, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in together:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _word(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            known = self.words.get
            packed = b"".join([known(p) or self._part(p) for p in self.parts(word)])
        if len(word) <= 64:
            if len(self.words) >= self.remember // 2:  # the older half goes, what is used again comes back
                self.older, self.words = self.words, {}
            self.words[word] = packed
        return packed

    def _part(self, part: str) -> bytes:
        packed = array("I", self.ids(part))
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def forget(self) -> None:
        """Drops the words and pairs; the model stays."""
        self.words, self.older, self.pairs = {}, {}, {}

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        edge = lambda on, i: i.to_bytes(4, "little") if on and i >= 0 else b""
        head, tail = edge(begin, self.model.begin), edge(end, self.model.end)
        if not text:
            return head + tail
        text = text.replace(" ", BLANK)
        if self.model.dummy_prefix:
            text = BLANK + text
        if not self.by_word:
            return head + self._word(text) + tail
        out, known, blanks = [head], self.words.get, ""
        parts = text.split(BLANK)
        if parts[0]:
            out.append(known(parts[0]) or self._word(parts[0]))
        for part in parts[1:]:
            if part:
                word = blanks + BLANK + part
                blanks = ""
                out.append(known(word) or self._word(word))
            else:
                blanks += BLANK
        if blanks:
            out.append(known(blanks) or self._word(blanks))
        out.append(tail)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD one by one."""
        import numpy as np

        text, kinds = self.text, self.model.kinds
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        raw = b"".join([text[i] for i in ids])
        first = next((i for i in ids if kinds[i] != ord("s")), None)
        cut = self.model.dummy_prefix and first is not None and kinds[first] == ord("n") and raw.startswith(b" ")
        try:
            out = raw.decode()
        except UnicodeDecodeError:
            out = "".join(self._loose(raw))
        return out[1:] if cut else out

    @staticmethod
    def _loose(raw: bytes):
        at = 0
        while at < len(raw):
            try:
                yield raw[at:].decode()
                return
            except UnicodeDecodeError as e:
                yield raw[at : at + e.start].decode() + "�"
                at += e.start + 1


_codecs: dict[int, PieceCodec] = {}


def codec_of(model: PieceModel) -> PieceCodec:
    """One codec for each model and Python worker."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def encoded(docs: DataFrame, model: PieceModel, doc: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (array<int>) and decoded.

    One pass without a shuffle. Texts come in batches of at most a few MB, cut by size, not by rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of a vocabulary
    schema = f"{doc} {docs.schema[doc].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if keep_ids else ""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        codec = codec_of(shared.value)
        for whole in batches:
            for at in range(0, len(whole), 256):  # results are handed on before more are made
                b = whole.slice(at, 256)
                n, ids, texts, id_lists, decoded = [], [], [], [], []
                for t in b.column(1):
                    packed = codec.encode(t.as_py() or "")
                    back = codec.decode(packed)
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    texts.append(hashlib.sha256(back.encode()).hexdigest())
                    if keep_ids:
                        id_lists.append(np.frombuffer(packed, dtype="<u4").astype("int32"))
                        decoded.append(back)
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
                names = [doc, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array(id_lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
        codec.forget()  # an idle worker stays for a while

    return docs.select(doc, text).mapInArrow(tidy(rows), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), PieceModel.load(model_path()))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
