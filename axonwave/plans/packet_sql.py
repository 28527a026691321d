"""SQL that yields the bytes of packets, for the checks."""

from __future__ import annotations

from axonwave.operators import wavelet
from axonwave.plans.samples import BLOCKS_SQL, SQL


def rice_hex(source: str, keys: str) -> str:
    """CTEs up to rice_hex(keys, pkt, packet): mode 0 packets of source(keys, pkt, ch, i, code), i from 0 in each packet, as hexadecimal digits.

    Codewords of the adaptive Rice coder as strings of bits, joined in the order of i and channel, and read four by four.
    """
    k = f"{keys}, pkt" if keys else "pkt"
    on = " AND ".join(f"z.{c.strip()} = r.{c.strip()}" for c in k.split(","))
    z = ", ".join(f"z.{c.strip()}" for c in k.split(","))
    return f"""z AS (SELECT {k}, ch, i, code, coalesce((code - lag(code) OVER (PARTITION BY {k}, ch ORDER BY i) + 1536) % 1024 - 512, 0) AS e FROM {source}),
r({k}, ch, i, a, n, word) AS (SELECT {k}, ch, 0::BIGINT, 16::BIGINT, 1::BIGINT, lpad(bin(code), 10, '0') FROM z WHERE i = 0
  UNION ALL SELECT {k}, ch, i, CASE WHEN n = 63 THEN (a + abs(e)) >> 1 ELSE a + abs(e) END, CASE WHEN n = 63 THEN 32 ELSE n + 1 END,
    CASE WHEN (m >> kk) < 16 THEN repeat('1', (m >> kk)::INT) || '0' || CASE WHEN kk > 0 THEN lpad(bin(m & ((1::BIGINT << kk) - 1)), kk::INT, '0') ELSE '' END ELSE repeat('1', 16) || lpad(bin(m), 10, '0') END
  FROM (SELECT {z}, z.ch, z.i, z.e, r.a, r.n, CASE WHEN z.e >= 0 THEN 2 * z.e ELSE -2 * z.e - 1 END AS m,
    ({' + '.join(f'CASE WHEN (r.n << {j}) < r.a THEN 1 ELSE 0 END' for j in range(9))})::BIGINT AS kk FROM r JOIN z ON {on} AND z.ch = r.ch AND z.i = r.i + 1)),
rice_bits AS (SELECT {k}, lpad(bin(pkt % 64), 8, '0') || string_agg(word, '' ORDER BY i, ch) AS bits FROM r GROUP BY {k}),
{bits_hex("rice_bits", k, "rice_hex")}"""


def bits_hex(source: str, keys: str, name: str) -> str:
    """CTEs up to name(keys, packet): strings of bits of source(keys, bits), padded to whole bytes, as hexadecimal digits."""
    return f"""{name}_padded AS (SELECT {keys}, bits || repeat('0', ((8 - length(bits) % 8) % 8)::INT) AS bits FROM {source}),
{name} AS (SELECT {keys}, string_agg(substr('0123456789ABCDEF', 1 + 8 * substr(bits, i::INT, 1)::INT + 4 * substr(bits, i::INT + 1, 1)::INT + 2 * substr(bits, i::INT + 2, 1)::INT + substr(bits, i::INT + 3, 1)::INT, 1), '' ORDER BY i) AS packet
    FROM (SELECT {keys}, bits, unnest(range(1, length(bits) + 1, 4)) AS i FROM {name}_padded) GROUP BY {keys})"""


def rans_hex(symbols: str, lsh: int, n_ch: int, state_bytes: int) -> str:
    """CTEs up to rans_hex(pkt, packet): packets of symbols(pkt, ch, pos, f, c, m, raw), raw hexadecimal digits that go first, without a header.

    Each channel's state is followed by a recursion over its symbols; at most three bytes leave a state at once. rput has what every position puts out.
    """
    byte = lambda k: f"printf('%02X', ((x >> {8 * k}) & 255)::INT)"
    over = [f"((x >> {8 * k}) >= (f << {lsh + 8}))::INT" for k in range(3)]
    last = " || ".join(byte(k) for k in range(state_bytes))
    return f"""rs AS (SELECT *, row_number() OVER (PARTITION BY pkt, ch ORDER BY pos) AS i FROM {symbols}),
rput(pkt, ch, pos, i, x, put) AS (SELECT DISTINCT pkt, ch, -1::BIGINT, 0::BIGINT, (m << {lsh})::BIGINT, '' FROM rs
  UNION ALL SELECT pkt, ch, pos, i, ((x >> 8 * n) // f) * m + (x >> 8 * n) % f + c, raw || CASE n WHEN 0 THEN '' WHEN 1 THEN {byte(0)} WHEN 2 THEN {byte(0)} || {byte(1)} ELSE {byte(0)} || {byte(1)} || {byte(2)} END
  FROM (SELECT *, {' + '.join(over)} AS n FROM (SELECT rs.pkt, rs.ch, rs.pos, rs.i, rput.x, rs.f, rs.c, rs.m, rs.raw FROM rput JOIN rs ON rs.pkt = rput.pkt AND rs.ch = rput.ch AND rs.i = rput.i + 1))),
rend AS (SELECT pkt, ch, x FROM rput QUALIFY row_number() OVER (PARTITION BY pkt, ch ORDER BY i DESC) = 1),
rans_hex AS (SELECT b.pkt, b.body || e.tail AS packet FROM (SELECT pkt, string_agg(put, '' ORDER BY pos) AS body FROM rput GROUP BY pkt) b
  JOIN (SELECT pkt, string_agg({last}, '' ORDER BY ch) AS tail FROM rend WHERE ch < {n_ch} GROUP BY pkt) e ON b.pkt = e.pkt)"""


SYM = wavelet.SYMBOLS_SQL
#: Tables by context, trained on `sm`: cdf(ctx, sym, f, c).
RAW_CDF = f"""WITH RECURSIVE {SQL}, {BLOCKS_SQL}, {wavelet.forward_sql()}, {SYM}, g AS (SELECT k::INT AS ctx, s::INT AS sym FROM range(4) a(k), range(64) b(s)), n AS (SELECT ctx, sym, count(*) AS n FROM sm GROUP BY ALL),
    w AS (SELECT ctx, sym, coalesce(n, 0) + 0.5::DOUBLE AS c FROM g LEFT JOIN n USING (ctx, sym)), v AS (SELECT ctx, sym, greatest(1, floor(c / sum(c) OVER (PARTITION BY ctx) * 4096)::BIGINT) AS f FROM w),
    fr(ctx, f, gap) AS (SELECT ctx, list(f ORDER BY sym), 4096 - sum(f)::BIGINT FROM v GROUP BY ctx UNION ALL SELECT ctx, list_transform(f, lambda x, i: CASE WHEN i = list_position(f, list_max(f)) THEN x + sign(gap) ELSE x END), gap - sign(gap) FROM fr WHERE gap != 0),
    fl AS (SELECT ctx, unnest(range(64))::INT AS sym, unnest(f) AS f FROM fr WHERE gap = 0), cdf AS (SELECT ctx, sym, f, (sum(f) OVER (PARTITION BY ctx ORDER BY sym) - f)::BIGINT AS c FROM fl)"""
#: Mode 1 payloads of whole packets, tables trained on them: ly(pkt, ch, pos, f, c, m, raw), rput, rans_hex.
LOSSY_CODED = f"""{RAW_CDF.replace(f"{SYM}, g AS", f"{SYM}, wsm AS (SELECT *, row_number() OVER (PARTITION BY pkt ORDER BY blk, at_, ch, turn) - 1 AS pos FROM sm QUALIFY count(*) OVER (PARTITION BY pkt) = 2048), g AS").replace("FROM sm GROUP BY ALL", "FROM wsm GROUP BY ALL")},
    ly AS (SELECT pkt, ch, pos, cdf.f, cdf.c, 4096 AS m, CASE WHEN sym = 63 THEN printf('%02X', (z & 255)::INT) || printf('%02X', (z >> 8)::INT) ELSE '' END AS raw
        FROM (SELECT pkt, ch, pos, ctx, sym, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z FROM wsm) JOIN cdf USING (ctx, sym)), {rans_hex("ly", 2, 8, 3)}"""
