"""The region of interest that follows an object from frame to frame.

The next region is the last frame's box, grown by a margin; a failed frame resets it to the
whole picture. In batch the frame before is one row away; in a stream the region is the
run's state, and so are frames that came before their turn. A fixed region never moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

OUT = "run_id long, frame long, roi_x0 int, roi_y0 int, roi_x1 int, roi_y1 int, is_reset boolean"
BOX = ["x0", "y0", "x1", "y1"]


def followed(box: tuple | None, width: int, height: int, margin: float) -> tuple[int, int, int, int]:
    """The region after a frame with this box, None for a failed one."""
    if box is None:
        return 0, 0, width, height
    x0, y0, x1, y1 = box
    dx, dy = (x1 - x0) * margin, (y1 - y0) * margin
    return max(0, int(x0 - dx)), max(0, int(y0 - dy)), min(width, -int(-(x1 + dx) // 1)), min(height, -int(-(y1 + dy) // 1))


def tracked(boxes: DataFrame, width: int, height: int, margin: float = 0.25) -> DataFrame:
    """The region that each frame of (run_id, frame, x0, y0, x1, y1) is read in; NULL boxes are failed frames.

    A region depends on the frame before alone, so it is that row's box one row later.
    """
    at = {c: F.col(c).cast("long") for c in BOX}  # whole pixels
    found = reduce(lambda x, y: x & y, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in BOX))
    dx, dy = (at["x1"] - at["x0"]) * F.lit(margin), (at["y1"] - at["y0"]) * F.lit(margin)
    grown = {"roi_x0": F.greatest(F.lit(0), (at["x0"] - dx).cast("long")), "roi_y0": F.greatest(F.lit(0), (at["y0"] - dy).cast("long")), "roi_x1": F.least(F.lit(width), F.ceil(at["x1"] + dx)), "roi_y1": F.least(F.lit(height), F.ceil(at["y1"] + dy))}
    whole = dict(zip(grown, (0, 0, width, height), strict=True))
    w = Window.partitionBy("run_id").orderBy("frame")
    rows = boxes.withColumn("next", F.when(found, F.struct(*(x.cast("int").alias(c) for c, x in grown.items()))))
    rows = rows.withColumn("roi", F.coalesce(F.lag("next").over(w), F.struct(*(F.lit(x).cast("int").alias(c) for c, x in whole.items()))))
    rows = rows.select(F.col("run_id").cast("long").alias("run_id"), F.col("frame").cast("long").alias("frame"), "roi.*")
    return rows.withColumn("is_reset", reduce(lambda x, y: x & y, (F.col(c) == x for c, x in whole.items())))


#: Values of a run's state: the frame released last, with its time and the region that follows it.
_LAST = "frame long, time long, x0 int, y0 int, x1 int, y1 int"
#: What waits: rows by time and frame, NULL boxes as not found.
_EARLY_KEY, _EARLY = "time long, frame long", "found boolean, x0 int, y0 int, x1 int, y1 int"


class Following(StatefulProcessor):
    """Holds early frames of a run until the watermark has passed them, releases them in order, and forgets a run that is idle."""

    def __init__(self, width: int, height: int, margin: float, idle_ms: int):
        self.width, self.height, self.margin, self.idle_ms = width, height, margin, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", _EARLY_KEY, _EARLY)
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get() if self.last.exists() else None
        for part in rows:
            times = part["at"].astype("datetime64[ms]").astype("int64")
            for time, frame, *box in zip(times, part["frame"], *(part[c] for c in BOX), strict=True):
                if last is not None and (time, frame) <= (last[1], last[0]):
                    continue  # its place is gone
                found = not any(pd.isna(x) for x in box)
                self.early.updateValue((int(time), int(frame)), (found, *(int(x) if found else 0 for x in box)))
                self.handle.registerTimer(int(time))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        whole = (0, 0, self.width, self.height)
        last = self.last.get() if self.last.exists() else None
        frame, time, roi = (last[0], last[1], tuple(last[2:])) if last is not None else (-1, 0, whole)
        out = []
        for at, value in sorted((tuple(k), tuple(v)) for k, v in self.early.iterator()):
            if at[0] > now:
                break
            out.append((key[0], at[1], *roi, roi == whole))
            roi = followed(value[1:] if value[0] else None, self.width, self.height, self.margin)
            frame, time = at[1], at[0]
            self.early.removeKey(at)
        if out:
            self.last.update((frame, time, *roi))
            self.handle.registerTimer(time + self.idle_ms)
        elif last is not None and time + self.idle_ms <= now and next(iter(self.early.keys()), None) is None:
            self.last.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def tracked_stream(boxes: DataFrame, width: int, height: int, margin: float = 0.25, late: str = "10 seconds", idle_sec: float = 600.0) -> DataFrame:
    """The same over a stream of (run_id, frame, at, x0, y0, x1, y1), whose frames may come out of order.

    A frame waits until the watermark, `late` behind the latest time `at`, has passed it; then the frames that wait
    are released by time and frame. A frame that comes later still is left out, as its place is gone. A
    run without frames for `idle_sec` is forgotten. Needs the RocksDB state store.
    """
    rows = boxes.select("run_id", "frame", F.col("at").cast("timestamp").alias("at"), *BOX).withWatermark("at", late)
    return rows.groupBy("run_id").transformWithStateInPandas(Following(width, height, margin, int(idle_sec * 1000)), OUT, "append", "eventTime")
