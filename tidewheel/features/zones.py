"""Price zones: order blocks until they are broken, swing zones with what was traded in them, support and resistance channels, trend lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.exprs import INDEX, KEY, TIME, R, U, W, lag
from tidewheel.operators.bars import as_of
from tidewheel.operators.crossings import CHUNK, first_below

c = F.col


def peak(x: str, n: int, top: bool = True):
    """Whether the value ``n`` bars ago is the extreme of the ``n`` bars on either side (ties count), once all are there."""
    f = F.max if top else F.min
    return F.coalesce((F.count(c(x)).over(R(2 * n + 1)) == 2 * n + 1) & (lag(x, n) == f(c(x)).over(R(2 * n + 1))), F.lit(False))


def order_blocks(bars: DataFrame, n: int = 5, chunk: int = CHUNK) -> DataFrame:
    """(symbol, id, kind, ts, bar, from_bar, top, bottom, broken_bar): blocks from the bar of a peak of volume on.

    While price last left its range downwards a peak of volume makes a bullish block, the lower half of its bar; else a bearish one, the upper half.
    A block is known ``n`` bars after its bar (``bar``); it is broken by the first bar from there on whose extreme of the last ``n`` bars lies beyond it.
    """
    far = F.when(lag("high", n) > F.max("high").over(R(n)), 0).when(lag("low", n) < F.min("low").over(R(n)), 1)
    rows = bars.withColumns({"_far": far, "_peak": peak("volume", n), "_lo": F.min("low").over(R(n)), "_hi": F.max("high").over(R(n)), "_h": lag("high", n), "_l": lag("low", n)})
    rows = rows.withColumn("_side", F.coalesce(F.last("_far", ignorenulls=True).over(U()), F.lit(0)))
    middle = (c("_h") + c("_l")) / 2
    made = rows.where("_peak").select(
        KEY, c(INDEX).cast("long").alias("id"), F.when(c("_side") == 1, "bull").otherwise("bear").alias("kind"), TIME, INDEX, (c(INDEX) - n).alias("from_bar"),
        F.when(c("_side") == 1, middle).otherwise(c("_h")).alias("top"), F.when(c("_side") == 1, c("_l")).otherwise(middle).alias("bottom"),
    )
    bull = first_below(rows.select(KEY, INDEX, c("_lo").alias("x")), made.where("kind = 'bull'").select(KEY, "id", INDEX, c("bottom").alias("level")), chunk)
    bear = first_below(rows.select(KEY, INDEX, (-c("_hi")).alias("x")), made.where("kind = 'bear'").select(KEY, "id", INDEX, (-c("top")).alias("level")), chunk)
    broken = bull.unionByName(bear).select(c(KEY).alias("_s"), c("id").alias("_i"), c("met").alias("broken_bar"))
    return made.join(broken, (c(KEY) == c("_s")) & (c("id") == c("_i")), "left").drop("_s", "_i")


def with_blocks(bars: DataFrame, blocks: DataFrame) -> DataFrame:
    """``bars`` with how many bullish and bearish blocks are open after each."""
    at = lambda bar, sign: blocks.where(c(bar).isNotNull()).select(c(KEY).alias("_s"), c(bar).alias("_b"), "kind", F.lit(sign).alias("_n"))
    steps = at(INDEX, 1).unionByName(at("broken_bar", -1)).groupBy("_s", "_b").agg(*[F.sum(F.when(c("kind") == k, c("_n")).otherwise(0)).alias(f"_{k}") for k in ("bull", "bear")])
    rows = bars.join(steps, (c(KEY) == c("_s")) & (c(INDEX) == c("_b")), "left")
    return rows.withColumns({f"open_{k}_blocks": F.sum(F.coalesce(f"_{k}", F.lit(0))).over(U()) for k in ("bull", "bear")}).drop("_s", "_b", "_bull", "_bear")


def swing_zones(bars: DataFrame, finer: DataFrame, unit_seconds: int, n: int = 5) -> DataFrame:
    """(symbol, kind, ts, top, bottom, count, volume): a zone from each swing point to the next of its kind, with the bars that overlap it and the volume of the finer bars that do.

    A swing high's zone lies between its high and the bar's body, a low's below the body; the bars of the two swing points belong to neither.  Zones of a kind follow each other in time,
    so a bar can only overlap the last one before it: bars meet zones by as-of join, and then by price alone.
    """
    rows = bars.withColumns({f"_{x}": lag(x, n) for x in ("open", "high", "low", "close", TIME)})
    found = None
    for kind in ("high", "low"):
        top, bottom = (c("_high"), F.greatest("_open", "_close")) if kind == "high" else (F.least("_open", "_close"), c("_low"))
        zones = rows.withColumn("_peak", peak(kind, n, kind == "high")).where("_peak").select(KEY, F.lit(kind).alias("kind"), c(f"_{TIME}").alias(TIME), top.alias("top"), bottom.alias("bottom"))
        # What is known from a swing point on: nothing during its bar, then its zone.
        opened = zones.select(KEY, (c(TIME).cast("timestamp") + F.make_dt_interval(secs=F.lit(float(unit_seconds)))).cast("timestamp_ntz").alias(TIME), c(TIME).alias("_start"), "top", "bottom")
        known = opened.unionByName(zones.select(KEY, TIME, c(TIME).alias("_start")), allowMissingColumns=True)
        parts = [bars.select(KEY, TIME, "high", "low", F.lit(1).alias("n"), F.lit(0.0).alias("v")), finer.select(KEY, TIME, "high", "low", F.lit(0).alias("n"), c("volume").alias("v"))]
        met = as_of(parts[0].unionByName(parts[1]), known, ["_start", "top", "bottom"]).where((c("low") < c("top")) & (c("high") > c("bottom")))
        summed = met.groupBy(c(KEY).alias("_s"), "_start").agg(F.sum("n").alias("count"), F.sum("v").alias("volume"))
        out = zones.join(summed, (c(KEY) == c("_s")) & (c(TIME) == c("_start")), "left").drop("_s", "_start").withColumns({"count": F.coalesce("count", F.lit(0)), "volume": F.coalesce("volume", F.lit(0.0))})
        found = out if found is None else found.unionByName(out)
    return found


def channels_of(values: np.ndarray, width: float, touches: np.ndarray, most: int) -> list[tuple[float, float, float]]:
    """Up to ``most`` (strength, top, bottom) channels around pivots, the strongest first, without overlap.

    From each pivot (the newest first) a channel grows over those that it can take in and stay at most ``width`` wide.  A pivot in it counts 20, a touch 1.
    Of what is left the strongest is taken (of equals that of the newest pivot), and those with an edge inside it go.
    """
    made = []
    for start in values:
        low = high = start
        n = 0
        for v in values:
            if (high - v if v <= high else v - low) <= width:
                low, high, n = min(low, v), max(high, v), n + 1
        hit = ((touches[:, 0] <= high) & (touches[:, 0] >= low)) | ((touches[:, 1] <= high) & (touches[:, 1] >= low))
        made.append((20.0 * n + hit.sum(), high, low))
    out = []
    while made and len(out) < most:
        best = max(made, key=lambda x: x[0])
        out.append(best)
        inside = lambda x, b=best: b[2] <= x <= b[1]
        made = [x for x in made if not (inside(x[1]) or inside(x[2]))]
    return out


def channels(bars: DataFrame, n: int = 10, back: int = 290, share: float = 0.05, span: int = 300, most: int = 6) -> DataFrame:
    """(symbol, ts, rank, strength, top, bottom): support and resistance channels as they stand at each new pivot.

    Pivots are extremes of ``n`` bars on either side, known ``n`` bars later, of the last ``back`` bars; a channel is at most ``share`` of the range
    of ``span`` bars wide.  A pivot's frame holds a bounded past, so pivots are spread over tasks whatever the symbol.
    """
    rows = bars.withColumns({"_hp": F.when(peak("high", n), lag("high", n)), "_lp": F.when(peak("low", n, False), lag("low", n)), "_w": (F.max("high").over(R(span)) - F.min("low").over(R(span))) * share, "_c": F.count("high").over(R(span))})
    # A bar with both kinds of pivot counts by its high.
    rows = rows.withColumn("_p", F.coalesce("_hp", "_lp"))
    past = W().rowsBetween(-back, 0)
    newest = F.reverse(F.collect_list("_p").over(past))
    frames = rows.withColumns({"_values": newest, "_touches": F.collect_list(F.array("high", "low")).over(past)}).where("_p is not null")
    frames = frames.where(c("_c") == span).select(KEY, TIME, c("_w").alias("w"), c("_values").alias("values"), c("_touches").alias("touches"))

    def run(batches):
        for b in batches:
            out = [(s, t, k + 1, *x) for s, t, w, v, h in zip(b[KEY], b[TIME], b["w"], b["values"], b["touches"], strict=True) for k, x in enumerate(channels_of(np.asarray(v, float), w, np.array([list(x) for x in h], float), most))]
            yield pd.DataFrame(out, columns=[KEY, TIME, "rank", "strength", "top", "bottom"])

    return frames.mapInPandas(run, f"{KEY} string, {TIME} timestamp_ntz, rank int, strength double, top double, bottom double")


class Hull:
    """The lower convex hull of points that come in the order of x, so that the lowest point under any slope is found by bisection."""

    def __init__(self):
        self.points: list[tuple[float, float]] = []
        self.slopes: list[float] = []  # of the edges, growing

    def add(self, x: float, y: float) -> None:
        while self.points:
            px, py = self.points[-1]
            slope = (y - py) / (x - px)
            if not self.slopes or slope > self.slopes[-1]:
                self.slopes.append(slope)
                break
            self.points.pop()
            self.slopes.pop()
        self.points.append((x, y))

    def least(self, slope: float) -> float:
        """The least of y - slope * x."""
        x, y = self.points[bisect_left(self.slopes, slope)]
        return y - slope * x


def lines(pivots: np.ndarray, close: np.ndarray, n: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, slope) of the rising line below the closes at each place, NaN where none holds.

    ``pivots`` has a low's value where it stands (else NaN); it is known ``n`` places later.  A line goes through two of the ``last`` known ones, and no close
    since the older may lie below it; the newest later pivot counts first, and with it the oldest earlier one.
    """
    value, slope = np.full(len(close), np.nan), np.full(len(close), np.nan)
    known: deque[tuple[int, float, Hull]] = deque(maxlen=last)
    for i, price in enumerate(close.tolist()):
        for _, _, hull in known:
            hull.add(i, price)
        at = i - n
        if at >= 0 and not np.isnan(pivots[at]):
            hull = Hull()
            for k in range(at, i + 1):
                hull.add(k, close[k])
            known.append((at, float(pivots[at]), hull))
        for p1, p2 in ((a, b) for a in range(len(known) - 1, 0, -1) for b in range(a)):
            (x1, y1, _), (x2, y2, hull) = known[p1], known[p2]
            m = (y1 - y2) / (x1 - x2)
            if m > 0 and hull.least(m) >= y2 - m * x2 - 1e-9:
                value[i], slope[i] = y2 + m * (i - x2), m
                break
    return value, slope


def trend_lines(bars: DataFrame, n: int = 20, last: int = 3) -> DataFrame:
    """``bars`` with support_line, support_slope (rising, below every close since its first pivot), and resistance_line and resistance_slope, mirrored.

    Pivots are extremes of ``n`` bars on either side (ties count).  Closes since a pivot are a convex hull, so a line is checked by one bisection instead of against each of them.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(INDEX, kind="stable").reset_index(drop=True)
        out = {}
        for name, sign, edge in (("support", 1.0, "low"), ("resistance", -1.0, "high")):
            x = sign * b[edge]
            pivot = x.where(x == x.rolling(2 * n + 1, center=True, min_periods=2 * n + 1).min())
            value, slope = lines(pivot.to_numpy(), sign * b["close"].to_numpy(), n, last)
            out |= {f"{name}_line": sign * value, f"{name}_slope": sign * slope}
        return b.assign(**out)

    names = [f"{k}_{x}" for k in ("support", "resistance") for x in ("line", "slope")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"{x} double" for x in names])
    made = bars.groupBy(KEY).applyInPandas(run, schema)
    return made.withColumns({x: F.when(~F.isnan(x), c(x)) for x in names})
