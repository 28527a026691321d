"""Coding a packet with books kept: states and byte offsets at symbol boundaries, from its start and from its end.

Boundary k of a packet lies before symbol k; boundary n after the last. `Coded` holds a packet's symbols as the coder sees them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from axonwave.functions.coding import rans_step


@dataclass(frozen=True)
class Coder:
    n_ch: int  #: channels whose states close a packet
    total: int = 4096
    lsh: int = 2
    state_bytes: int = 3

    @property
    def low(self) -> int:
        return self.total << self.lsh

    @property
    def mask(self) -> int:
        """Bits of a state register."""
        return (self.low << 8) - 1

    def parted(self, payload: bytes) -> tuple[bytes, list[int]]:
        """Body and final states of a payload (packet without its header); zeros stand for what is missing."""
        n = self.n_ch * self.state_bytes
        tail = payload[-n:].rjust(n, b"\0")
        return payload[: max(0, len(payload) - n)], [int.from_bytes(tail[k : k + self.state_bytes], "little") for k in range(0, n, self.state_bytes)]

    def tail(self, states) -> bytes:
        return b"".join((x & self.mask).to_bytes(self.state_bytes, "little") for x in states)


@dataclass(frozen=True)
class Coded:
    ch: list[int]
    f: list[int]
    c: list[int]
    raw: list[bytes]  #: bytes that precede a symbol's own, empty for most


Bounds = dict[int, tuple[int, tuple[int, ...]]]  # boundary -> (byte offset, states)


def forward(s: Coded, coder: Coder, body: bytes | None = None, alter=None, start: tuple[int, int, tuple[int, ...]] | None = None) -> tuple[Bounds, bytes]:
    """Boundaries from the start as far as the coded bytes are those of body (all without one), and the bytes.

    alter(k, x, f, c) -> (x, f, c, write) puts a fault into symbol k: what it reads, and a function of what it writes back. start: a
    boundary, its offset and states, to begin from instead.
    """
    k0, at, states = start or (0, 0, (coder.low,) * coder.n_ch)
    states, out, bounds = list(states), bytearray(), {k0: (at, tuple(states))}
    for k in range(k0, len(s.ch)):
        x, f, c, write = states[s.ch[k]], s.f[k], s.c[k], None
        if alter:
            x, f, c, write = alter(k, x, f, c)
            if f <= 0:
                break
        x, units = rans_step(x, f, c, coder.total, coder.lsh)
        x &= coder.mask
        put = s.raw[k] + bytes(units)
        if body is not None and body[at : at + len(put)] != put:
            break
        out += put
        at += len(put)
        states[s.ch[k]] = write(x) if write else x
        bounds[k + 1] = (at, tuple(states))
    return bounds, bytes(out)


def backward(s: Coded, coder: Coder, body: bytes, states) -> Bounds:
    """Boundaries from the end, as long as undoing the final states gives the expected symbols."""
    states, at, n = list(states), len(body), len(s.ch)
    bounds = {n: (at, tuple(states))}
    for k in reversed(range(n)):
        whole, slot = divmod(states[s.ch[k]], coder.total)
        if not s.c[k] <= slot < s.c[k] + s.f[k]:
            break
        x = whole * s.f[k] + slot - s.c[k]
        while x < coder.low and at:
            at -= 1
            x = x << 8 | body[at]
        put = s.raw[k]
        if x < coder.low or body[at - len(put) : at] != put or at < len(put):
            break
        at -= len(put)
        states[s.ch[k]] = x
        bounds[k] = (at, tuple(states))
    return bounds


def meetings(s: Coded, coder: Coder, ahead: Bounds, back: Bounds, body: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(symbol, state before it from the start, state after it from the end, bytes between, as a number) where all that is not that symbol's channel agrees."""
    for k in sorted(ahead):
        if k + 1 not in back or k == len(s.ch):
            continue
        (a, before), (b, after) = ahead[k], back[k + 1]
        own, put = s.ch[k], s.raw[k]
        between = body[a + len(put) : b]
        if not a + len(put) <= b <= a + len(put) + 3 or body[a : a + len(put)] != put:
            continue
        if before[:own] + before[own + 1 :] == after[:own] + after[own + 1 :]:
            yield k, before[own], after[own], len(between), int.from_bytes(between, "little")


def undone(body: bytes, states, order, tables, coder: Coder, esc: int | None, esc_bytes: int = 2):
    """(symbols, raw bytes, states, bytes left, whether bytes were missing) of order [(channel, context)] from its end; never raises.

    Missing bytes are zeros, and a state that stays too small is left so: what comes out is then marked, not right.
    """
    starts = [t[:-1] for t in tables]
    from bisect import bisect_right

    states, at, short, syms, raws = list(states), len(body), False, [], []
    for channel, context in reversed(order):
        t = tables[context]
        whole, slot = divmod(states[channel], coder.total)
        sym = bisect_right(starts[context], slot) - 1
        x = whole * (t[sym + 1] - t[sym]) + slot - t[sym]
        for _ in range(coder.state_bytes + 1):
            if x >= coder.low:
                break
            at, short = at - 1, short or at == 0
            x = x << 8 | (body[at] if at >= 0 else 0)
        raw = b""
        if sym == esc:
            at, short = at - esc_bytes, short or at < esc_bytes
            raw = body[max(at, 0) : max(at + esc_bytes, 0)].rjust(esc_bytes, b"\0")
        at, short = max(at, 0), short or x < coder.low
        states[channel] = x
        syms.append(sym)
        raws.append(raw)
    return syms[::-1], raws[::-1], states, at, short
