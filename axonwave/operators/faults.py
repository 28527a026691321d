"""Which single fault of the coder explains a packet, and decoding of damaged packets.

A fault is looked for where two traces meet: the states from the packet's start are right up to the fault, those undone from its end
are right back to it, so before and after the faulty symbol both are known and every hypothesis is one step of arithmetic, done by Spark's
expressions over the few symbols where the traces overlap. Nothing is coded again for a single upset. Faults that stay (a stuck bit)
act on many symbols; they are coded from their first use on and given up at the first wrong byte.

Snapshots are the boundaries of every n-th symbol of a coded packet. They cut its sequential code into segments that are decoded, and checked, each on its own:
damage is confined to the segment that has it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonwave.functions import tracing
from axonwave.functions.tracing import Coded, Coder

#: kind, bits that one upset can change: a state as it is read, a frequency or start as it is looked up, a state as it is written back
UPSETS = (("state", 22), ("frequency", 13), ("start", 12), ("write_back", 22))


def coded_of(pdf: pd.DataFrame) -> Coded:
    pdf = pdf.sort_values("pos")
    return Coded(pdf.ch.tolist(), pdf.f.tolist(), pdf.c.tolist(), [bytes(r) if r is not None else b"" for r in pdf.raw])


def coded_symbols(sym: DataFrame, tables, esc: int = 63, esc_bytes: int = 2) -> DataFrame:
    """Symbols with what the coder looks up: f, c of fixed tables [context][symbol] and the raw bytes of escapes. sym needs ctx, sym, v."""
    f, c = (F.array(*[F.array(*[F.lit(v).cast("long") for v in of(t)]) for t in tables]) for of in (lambda t: [b - a for a, b in zip(t, t[1:])], lambda t: t[:-1]))
    look = lambda a: F.get(F.get(a, F.col("ctx")), F.col("sym"))
    m = F.when(F.col("v") >= 0, 2 * F.col("v")).otherwise(-2 * F.col("v") - 1)
    byte = lambda k: F.lpad(F.hex(F.pmod(F.shiftright(m, 8 * k), F.lit(256))), 2, "0")
    raw = F.when(F.col("sym") == esc, F.unhex(F.concat(*[byte(k) for k in range(esc_bytes)])))
    return sym.withColumns({"f": look(f), "c": look(c), "raw": raw})


def _keys_of(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def traced(coded: DataFrame, payloads: DataFrame, keys: list[str], coder: Coder, stuck: bool = False) -> DataFrame:
    """keys, n, prefix, suffix, clean, meets: one row for each packet.

    coded: keys, pos, ch, f, c, raw of the expected symbols. payloads: keys, payload (as it came). prefix, suffix: how many symbols the packet's bytes
    confirm from its start and, undone, from its end. meets: array of (k, ch, f, c, x, y, n, bytes), the symbols with the state before and after. With stuck also
    faults: array of (kind, ctx, sym, bit, value) of permanent faults that give exactly this payload (coded then needs ctx and sym).
    """
    meet, fault = "array<struct<k:int,ch:int,f:long,c:long,x:long,y:long,n:int,bytes:long>>", "array<struct<kind:string,ctx:int,sym:int,bit:int,value:int>>"

    def one(pdf, given):
        if pdf.empty or given.empty:
            return pd.DataFrame()
        s, n = coded_of(pdf), len(pdf)
        body, states = coder.parted(bytes(given.payload.iloc[0]))
        ahead, _ = tracing.forward(s, coder, body)
        back = tracing.backward(s, coder, body, states)
        clean = ahead.get(n) == (len(body), tuple(states))
        rows = [] if clean else [(k, s.ch[k], s.f[k], s.c[k], x, y, m, v) for k, x, y, m, v in tracing.meetings(s, coder, ahead, back, body)]
        out = {k: [pdf[k].iloc[0]] for k in keys} | {"n": [n], "prefix": [max(ahead)], "suffix": [n - min(back)], "clean": [clean], "meets": [rows]}
        if stuck:
            entries = pdf.sort_values("pos")
            out["faults"] = [[] if clean else list(_stuck(s, coder, ahead, body, states, entries.ctx.tolist(), entries.sym.tolist()))]
        return pd.DataFrame(out)

    schema = f"{_keys_of(coded, keys)}, n int, prefix int, suffix int, clean boolean, meets {meet}" + (f", faults {fault}" if stuck else "")
    columns = [*keys, "pos", "ch", "f", "c", "raw", *(["ctx", "sym"] if stuck else [])]
    # a payload comes once to its packet's symbols: joined, every symbol would carry it through the sort
    return coded.select(*columns).groupBy(*keys).cogroup(payloads.select(*keys, "payload").groupBy(*keys)).applyInPandas(one, schema)


def _stuck(s: Coded, coder: Coder, ahead, body: bytes, states, ctx: list[int], sym: list[int]):
    """Table bits and write-back bits that are always the wrong value: from the first use on, up to the first wrong byte."""
    n = len(s.ch)
    ends = (len(body), tuple(states))
    first = {}
    for k in range(min(n, max(ahead) + 1)):
        first.setdefault((ctx[k], sym[k]), k)
    for (t, y), k in first.items():
        for field, bits in (("frequency", 13), ("start", 12)):
            for b in range(bits):

                def alter(i, x, f, c, flip=1 << b, field=field, of=(t, y)):
                    if (ctx[i], sym[i]) == of:
                        f, c = (f ^ flip, c) if field == "frequency" else (f, c ^ flip)
                    return x, f, c, None

                if tracing.forward(s, coder, body, alter, (k, *ahead[k]))[0].get(n) == ends:
                    yield f"{field}_stuck", t, y, b, ((s.f[k] if field == "frequency" else s.c[k]) >> b & 1) ^ 1
    for b in range(22):
        for value in (0, 1):
            write = lambda x, b=b, value=value: x & ~(1 << b) | value << b
            if tracing.forward(s, coder, body, lambda i, x, f, c, write=write: (x, f, c, write))[0].get(n) == ends:
                yield "write_back_stuck", None, None, b, value


def upsets(rows: DataFrame, keys: list[str], coder: Coder, kinds=UPSETS) -> DataFrame:
    """keys, k, ch, kind, bit: every single upset that explains the packet, from the rows of `traced`."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(b).alias("bit")) for kind, bits in kinds for b in range(bits)])
    m = rows.select(*keys, F.explode("meets").alias("m")).select(*keys, "m.*", F.explode(each).alias("h"))
    flip = lambda kind: F.when(F.col("h.kind") == kind, F.expr("shiftleft(1L, h.bit)")).otherwise(F.lit(0).cast("long"))
    m = m.withColumns({"x": F.col("x").bitwiseXOR(flip("state")), "f": F.col("f").bitwiseXOR(flip("frequency")), "c": F.col("c").bitwiseXOR(flip("start"))}).where("f > 0")
    over = [(F.shiftright("x", 8 * k) >= F.shiftleft("f", coder.lsh + 8)).cast("int") for k in range(3)]
    m = m.withColumn("out", sum(over[1:], over[0])).where("out = n AND x % shiftleft(1L, 8 * out) = bytes").withColumn("x", F.expr("shiftright(x, 8 * out)"))
    wrote = (F.floor(F.col("x") / F.col("f")) * coder.total + F.col("x") % F.col("f") + F.col("c")).bitwiseAND(F.lit(coder.mask))
    return m.where(wrote.bitwiseXOR(flip("write_back")) == F.col("y")).select(*keys, "k", "ch", "h.kind", "h.bit")


def symbols_crc(sym: list[int]) -> int:
    """CRC-32 of symbols, four bytes each: a change of one symbol is never missed."""
    return zlib.crc32(np.array(sym, "<i4").tobytes())


def snapshots(coded: DataFrame, keys: list[str], coder: Coder, every: int) -> DataFrame:
    """keys, k, at, states, crc: every n-th boundary of each packet as it is coded, and the last. coded needs sym too; crc is that of the symbols since the boundary before."""

    def one(pdf):
        bounds, _ = tracing.forward(coded_of(pdf), coder)
        sym = pdf.sort_values("pos").sym.tolist()
        rows = [(k, at, list(x), symbols_crc(sym[(k - 1) // every * every if k else 0 : k])) for k, (at, x) in bounds.items() if k % every == 0 or k == len(pdf)]
        k, at, states, crc = zip(*rows, strict=True)
        return pd.DataFrame({c: pdf[c].iloc[0] for c in keys} | {"k": k, "at": at, "states": states, "crc": crc})

    return coded.select(*keys, "pos", "ch", "f", "c", "raw", "sym").groupBy(*keys).applyInPandas(one, f"{_keys_of(coded, keys)}, k int, at long, states array<long>, crc long")


def decode_tolerant(payloads: DataFrame, keys: list[str], order: list[tuple[int, int]], tables, coder: Coder, snaps: DataFrame | None = None, esc: int | None = 63, esc_bytes: int = 2) -> DataFrame:
    """keys, k (first symbol), syms, raws, clean: decoding that never fails, of segments between snapshots, or of whole packets without any.

    A segment is read from the states of its last snapshot, and is clean if that leads to the states of its first with no byte left and to the symbols' checksum:
    a coder that has read a wrong byte may fall back into step, so states alone do not tell. Where bytes were lost or came twice, segments behind the place are found by their distance from the end. Segments are rows, so a packet's are read in parallel.
    """
    flush, indexed = coder.n_ch * coder.state_bytes, snaps is not None
    if not indexed:
        end = len(order)
        seg = payloads.select(*keys, F.lit(0).alias("k"), F.lit(end).alias("k1"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("at1"), F.lit(None).cast("array<long>").alias("states"), F.lit(None).cast("array<long>").alias("states1"), "payload", F.lit(0).cast("long").alias("shift"))
    else:
        w = Window.partitionBy(*keys).orderBy("k")
        whole = F.max("at").over(Window.partitionBy(*keys))
        seg = snaps.withColumns({"k1": F.lead("k").over(w), "at1": F.lead("at").over(w), "states1": F.lead("states").over(w), "crc": F.lead("crc").over(w), "_end": whole}).where("k1 IS NOT NULL")
        seg = seg.join(payloads, keys).withColumn("shift", F.length("payload") - flush - F.col("_end"))
        cut = lambda by: F.substring("payload", (F.col("at") + by + 1).cast("int"), (F.col("at1") - F.col("at")).cast("int"))
        seg = seg.withColumns({"there": cut(F.lit(0)), "here": F.when((F.col("shift") != 0) & (F.col("at") + F.col("shift") >= 0), cut(F.col("shift")))})
        seg = seg.select(*keys, "k", "k1", "at", "at1", "states", "states1", "crc", "there", "here")

    def read(body, states, first, k, k1, crc=None):
        syms, raws, got, left, short = tracing.undone(body, states, order[k:k1], tables, coder, esc, esc_bytes)
        return syms, raws, not short and left == 0 and got == list(first) and crc in (None, symbols_crc(syms))

    def many(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if not indexed:
                    body, states = coder.parted(bytes(r.payload))
                    best = read(body, states, [coder.low] * coder.n_ch, r.k, r.k1)
                else:
                    best = read(bytes(r.there), r.states1, r.states, r.k, r.k1, r.crc)
                    if not best[2] and r.here is not None:
                        other = read(bytes(r.here), r.states1, r.states, r.k, r.k1, r.crc)
                        best = other if other[2] else best
                out.append((*[getattr(r, c) for c in keys], r.k, *best))
            yield pd.DataFrame(out, columns=[*keys, "k", "syms", "raws", "clean"])

    return seg.mapInPandas(many, f"{_keys_of(payloads, keys)}, k int, syms array<int>, raws array<binary>, clean boolean")
