"""Integer 5/3 lifting on block rows, in place, and the symbols of the lossy packet format.

A level works on every 2**(level-1)-th row of a block, so neighbours are lag and lead by that many
rows of one window: all levels, forward or back, share one shuffle and one sort. Row p ends with
the detail of level 1 (p odd), 2 (p % 4 = 2), ... or the approximation (p % 2**levels = 0).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LossyConfig:
    block: int = 64
    levels: int = 3
    approx_shift: int = 1
    detail_shifts: tuple[int, ...] = (3, 2, 2)  #: finest first
    s_max: int = 31
    blocks_per_packet: int = 4
    adc_bits: int = 10
    prob_bits: int = 12
    lsh: int = 2
    n_flush: int | None = None
    esc_bytes: int = 2

    def __post_init__(self):
        if self.block % (1 << self.levels):
            raise ValueError("block must be a multiple of 2**levels")
        if len(self.detail_shifts) != self.levels:
            raise ValueError("one detail shift for each level")
        if 8 * self.esc_bytes < self.adc_bits + self.levels + 2:
            raise ValueError("escape is too short")

    @property
    def n_sym(self) -> int:
        return 2 * self.s_max + 2

    @property
    def frames(self) -> int:
        return self.block * self.blocks_per_packet

    def shift(self, ctx: int) -> int:
        return self.approx_shift if ctx == 0 else self.detail_shifts[ctx - 1]


_KEYS = ("stream", "ch", "blk")


def _order():
    return Window.partitionBy(*_KEYS).orderBy("p")


def _on(level: int) -> tuple[int, Column, Column]:
    """(stride, row is even at this level, row is odd)."""
    stride = 1 << (level - 1)
    on = F.pmod("p", F.lit(stride)) == 0
    odd = on & (F.pmod(F.floor(F.col("p") / stride), F.lit(2)) == 1)
    return stride, on & ~odd, odd


def forward(b: DataFrame, levels: int = 3, value: str = "code", centre: int = 512) -> DataFrame:
    """b(stream, ch, blk, p, value) with c, the coefficient of the row."""
    w = _order()
    out = b.withColumn("c", F.col(value) - centre)
    for level in range(1, levels + 1):
        n, even, odd = _on(level)
        mean = F.shiftright(F.lag("c", n).over(w) + F.coalesce(F.lead("c", n).over(w), F.lag("c", n).over(w)), 1)
        out = out.withColumn("c", F.when(odd, F.col("c") - mean).otherwise(F.col("c")))
        update = F.shiftright(F.coalesce(F.lag("c", n).over(w), F.lead("c", n).over(w)) + F.lead("c", n).over(w) + 2, 2)
        out = out.withColumn("c", F.when(even, F.col("c") + update).otherwise(F.col("c")))
    return out


def inverse(b: DataFrame, levels: int = 3, value: str = "c", centre: int = 512) -> DataFrame:
    """Coefficient rows with x, the sample of the row (not clipped)."""
    w = _order()
    out = b.withColumn("x", F.col(value))
    for level in range(levels, 0, -1):
        n, even, odd = _on(level)
        update = F.shiftright(F.coalesce(F.lag("x", n).over(w), F.lead("x", n).over(w)) + F.lead("x", n).over(w) + 2, 2)
        out = out.withColumn("x", F.when(even, F.col("x") - update).otherwise(F.col("x")))
        mean = F.shiftright(F.lag("x", n).over(w) + F.coalesce(F.lead("x", n).over(w), F.lag("x", n).over(w)), 1)
        out = out.withColumn("x", F.when(odd, F.col("x") + mean).otherwise(F.col("x")))
    return out.withColumn("x", F.col("x") + centre)


def band(levels: int = 3) -> tuple[Column, Column]:
    """(ctx, index in its band) of row p: ctx 0 is the approximation, 1.. the details, finest first."""
    ctx, index = F.lit(0), F.floor(F.col("p") / (1 << levels))
    for level in range(levels, 0, -1):
        here = F.pmod("p", F.lit(1 << level)) == (1 << (level - 1))
        ctx, index = F.when(here, level).otherwise(ctx), F.when(here, F.floor(F.col("p") / (1 << level))).otherwise(index)
    return ctx.cast("int"), index.cast("int")


def by_ctx(make, levels: int) -> Column:
    out = make(0)
    for ctx in range(1, levels + 1):
        out = F.when(F.col("ctx") == ctx, make(ctx)).otherwise(out)
    return out


def quantise(c: Column, shift: int) -> Column:
    """Dead zone: towards zero."""
    return (F.signum(c) * F.shiftright(F.abs(c), shift)).cast("long")


def dequantise(q: Column, shift: int) -> Column:
    """Middle of the cell; 0 stays 0."""
    if shift == 0:
        return q
    return F.when(q == 0, F.lit(0)).otherwise(F.signum(q) * (F.shiftleft(F.abs(q), shift) + (1 << (shift - 1)))).cast("long")


def coefficients(b: DataFrame, cfg: LossyConfig = LossyConfig()) -> DataFrame:
    """stream, ch, blk, p, ctx, i, c, q."""
    ctx, i = band(cfg.levels)
    out = forward(b, cfg.levels).withColumns({"ctx": ctx, "i": i})
    return out.withColumn("q", by_ctx(lambda k: quantise(F.col("c"), cfg.shift(k)), cfg.levels))


def zigzag(v: Column) -> Column:
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unzigzag(m: Column) -> Column:
    return F.when(F.pmod(m, F.lit(2)) == 0, F.shiftright(m, 1)).otherwise(-F.shiftright(m + 1, 1))


def symbols(b: DataFrame, cfg: LossyConfig = LossyConfig()) -> DataFrame:
    """stream, pkt, ch, blk, ctx, i, v, sym, pos: the packet's symbols and their places in coding order.

    The approximation is coded as differences in its block. A coefficient is produced as soon as its
    last sample has come; coding order is by block, that frame, channel, and detail before approximation.
    """
    n, w = 1 << cfg.levels, _order()
    before = F.when(F.col("ctx") == 0, F.coalesce(F.lag("q", n).over(w), F.lit(0))).otherwise(0)
    out = coefficients(b, cfg).withColumn("v", F.col("q") - before)
    fits = F.abs(F.col("v")) <= cfg.s_max
    level = F.when(F.col("ctx") == 0, cfg.levels).otherwise(F.col("ctx"))
    frame = F.least(F.lit(cfg.block - 1), F.pow(F.lit(2), level).cast("long") * (F.col("i") + 2) - 2)
    out = out.withColumns({
        "sym": F.when(fits, F.col("v") + cfg.s_max).otherwise(cfg.n_sym - 1).cast("int"),
        "at": frame, "turn": F.when(F.col("ctx") == 0, cfg.levels + 1).otherwise(F.col("ctx")),
        "pkt": F.floor(F.col("blk") / cfg.blocks_per_packet),
    })
    order = Window.partitionBy("stream", "pkt").orderBy("blk", "at", "ch", "turn")
    return out.select("stream", "pkt", "ch", "blk", "ctx", "i", "v", "sym", "at", (F.row_number().over(order) - 1).cast("long").alias("pos"))


def reconstruction(b: DataFrame, cfg: LossyConfig = LossyConfig()) -> DataFrame:
    """stream, ch, blk, p, code, y: what a decoder makes of quantised coefficients, clipped to the code range."""
    dq = coefficients(b, cfg).withColumn("dq", by_ctx(lambda k: dequantise(F.col("q"), cfg.shift(k)), cfg.levels))
    top = (1 << cfg.adc_bits) - 1
    return inverse(dq, cfg.levels, "dq").withColumn("y", F.greatest(F.lit(0), F.least(F.lit(top), F.col("x")))).select(*_KEYS, "p", "code", "y")


# SQL forms of the above, as chains of common table expressions

_W = "(PARTITION BY stream, ch, blk ORDER BY p)"


def forward_sql(src: str = "b", levels: int = 3) -> str:
    steps, at = [f"f0 AS (SELECT stream, ch, blk, p, code, code - 512 AS c FROM {src})"], "f0"
    for level in range(1, levels + 1):
        n = 1 << (level - 1)
        odd, even = f"p % {2 * n} = {n}", f"p % {2 * n} = 0"
        steps.append(f"o{level} AS (SELECT * REPLACE (CASE WHEN {odd} THEN c - ((lag(c, {n}) OVER {_W} + coalesce(lead(c, {n}) OVER {_W}, lag(c, {n}) OVER {_W})) >> 1) ELSE c END AS c) FROM {at})")
        steps.append(f"f{level} AS (SELECT * REPLACE (CASE WHEN {even} THEN c + ((coalesce(lag(c, {n}) OVER {_W}, lead(c, {n}) OVER {_W}) + lead(c, {n}) OVER {_W} + 2) >> 2) ELSE c END AS c) FROM o{level})")
        at = f"f{level}"
    ctx = "CASE WHEN p % 2 = 1 THEN 1 WHEN p % 4 = 2 THEN 2 WHEN p % 8 = 4 THEN 3 ELSE 0 END"
    steps.append(f"co AS (SELECT *, ({ctx})::INT AS ctx, (CASE WHEN p % 2 = 1 THEN p // 2 WHEN p % 4 = 2 THEN p // 4 ELSE p // 8 END)::INT AS i FROM {at})")
    steps.append("cq AS (SELECT *, (sign(c) * (abs(c) >> CASE ctx WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END))::BIGINT AS q FROM co)")
    return ", ".join(steps)


SYMBOLS_SQL = """sy AS (SELECT *, q - CASE WHEN ctx = 0 THEN coalesce(lag(q, 8) OVER (PARTITION BY stream, ch, blk ORDER BY p), 0) ELSE 0 END AS v FROM cq),
sm AS (SELECT *, (CASE WHEN abs(v) <= 31 THEN v + 31 ELSE 63 END)::INT AS sym, blk // 4 AS pkt,
    least(63, (1 << CASE WHEN ctx = 0 THEN 3 ELSE ctx END) * (i + 2) - 2) AS at_, CASE WHEN ctx = 0 THEN 4 ELSE ctx END AS turn FROM sy)"""


def inverse_sql(src: str, column: str, levels: int = 3) -> str:
    steps, at = [f"i0 AS (SELECT *, {column} AS x FROM {src})"], "i0"
    for level in range(levels, 0, -1):
        n = 1 << (level - 1)
        odd, even = f"p % {2 * n} = {n}", f"p % {2 * n} = 0"
        steps.append(f"e{level} AS (SELECT * REPLACE (CASE WHEN {even} THEN x - ((coalesce(lag(x, {n}) OVER {_W}, lead(x, {n}) OVER {_W}) + lead(x, {n}) OVER {_W} + 2) >> 2) ELSE x END AS x) FROM {at})")
        steps.append(f"i{level} AS (SELECT * REPLACE (CASE WHEN {odd} THEN x + ((lag(x, {n}) OVER {_W} + coalesce(lead(x, {n}) OVER {_W}, lag(x, {n}) OVER {_W})) >> 1) ELSE x END AS x) FROM e{level})")
        at = f"i{level}"
    steps.append(f"rx AS (SELECT * REPLACE (x + 512 AS x) FROM {at})")
    return ", ".join(steps)


RECON_SQL = """dq AS (SELECT *, CASE WHEN q = 0 THEN 0 ELSE (sign(q) * ((abs(q) << sh) + (1 << (sh - 1))))::BIGINT END AS d FROM (SELECT *, CASE ctx WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS sh FROM cq))"""
