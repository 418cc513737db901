"""Track summaries over a stream of detections."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def closed_tracks(detections: DataFrame, buffer: str = "30 seconds", late: str = "30 seconds") -> DataFrame:
    """One row for each closed track: a track ends when it hasn't been seen for ``buffer``.

    ``detections`` (batch or stream) needs ``ts, camera, track_key, conf, area``. Rows later than
    ``late`` behind the newest are dropped, which bounds the state to open tracks."""
    sessions = detections.withWatermark("ts", late).groupBy(F.session_window("ts", buffer), "camera", "track_key")
    closed = sessions.agg(F.count(F.lit(1)).alias("num_rows"), F.avg("conf").alias("avg_conf"), F.avg("area").alias("avg_area"))
    return closed.select("camera", "track_key", F.col("session_window.start").alias("first_seen"), F.col("session_window.end").alias("closes"), "num_rows", "avg_conf", "avg_area")


#: Frames that a video has at most; a frame is a millisecond of event time, counted over all videos.
VIDEO_FRAMES = 100_000_000
SUMMARY = "camera string, video long, track_id int, track_key string, num_frames long, num_crops long, avg_conf double, avg_area double, first_frame int, last_frame int, representative_crop string"


def _start(video):
    """A video's event time of frame 0; watermarks begin at 0, and what isn't above one is late."""
    return (video + 1) * VIDEO_FRAMES


class _Piece:
    """What a stretch of one track's detections adds up to; pieces add up in any order to the same.

    Means are sums of millionths, frames are kept as runs, and the best crop has the largest area, then
    confidence, then the least ``det_id``."""

    def __init__(self, runs: list, rows: int, crops: int, conf: int, area: int, best: list):
        self.runs, self.rows, self.crops, self.conf, self.area, self.best = runs, rows, crops, conf, area, best

    @property
    def span(self) -> tuple[int, int]:
        return self.runs[0][0], self.runs[-1][1]

    @classmethod
    def of(cls, row) -> _Piece:
        millionths = lambda x: round(float(x) * 1e6)
        return cls([[int(row.frame)] * 2], 1, int(bool(row.crop_path)), millionths(row.conf), millionths(row.area), [float(row.area), float(row.conf), -int(row.det_id), row.crop_path])

    def add(self, other: _Piece) -> _Piece:
        runs: list = []
        for a, b in sorted(self.runs + other.runs):
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        best = max(self.best, other.best, key=lambda x: x[:3])
        return _Piece(runs, self.rows + other.rows, self.crops + other.crops, self.conf + other.conf, self.area + other.area, best)


def _joined(pieces: list[_Piece], buffer: int) -> list[_Piece]:
    """Pieces in order, those no more than ``buffer`` frames apart made one."""
    out: list[_Piece] = []
    for piece in sorted(pieces, key=lambda p: p.span):
        if out and piece.span[0] - out[-1].span[1] <= buffer:
            out[-1] = out[-1].add(piece)
        else:
            out.append(piece)
    return out


class _Closing(StatefulProcessor):
    """Open pieces of one track of one video; a piece is emitted when the watermark has left it ``buffer`` frames behind."""

    def __init__(self, buffer: int):
        self.buffer = buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "said string")

    def _read(self) -> list[_Piece]:
        return [_Piece(*p) for p in json.loads(self.open.get()[0])] if self.open.exists() else []

    def _keep(self, pieces: list[_Piece], video: int) -> None:
        if not pieces:
            self.open.clear()
            return
        self.open.update((json.dumps([[p.runs, p.rows, p.crops, p.conf, p.area, p.best] for p in pieces]),))
        self.handle.registerTimer(_start(video) + min(p.span[1] for p in pieces) + self.buffer + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = self._read()
        for batch in rows:
            pieces = _joined(pieces + [_Piece.of(r) for r in batch.itertuples()], self.buffer)
        self._keep(pieces, int(key[1]))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        camera, video, track = key[0], int(key[1]), int(key[2])
        passed = timerValues.getCurrentWatermarkInMs() - _start(video)
        pieces = self._read()
        done = [p for p in pieces if p.span[1] + self.buffer + 1 <= passed]
        self._keep([p for p in pieces if p not in done], video)
        rows = [(camera, video, track, f"{camera}_T{track}", sum(b - a + 1 for a, b in p.runs), p.crops, p.conf / 1e6 / p.rows, p.area / 1e6 / p.rows, *p.span, p.best[3]) for p in done]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])

    def close(self) -> None:
        pass


def closed_tracks_by_frame(detections: DataFrame, buffer: int = 30, late: int = 30) -> DataFrame:
    """The summary (as ``summarize`` gives it) of each track that hasn't been seen for more than ``buffer`` frames.

    ``detections`` (stream or batch) has ``det_id, video, camera, track_id, frame, conf, area, crop_path``; videos
    are numbered in the order in which they come and frames begin anew with each, so an id that
    comes again in the next video is another track. Rows more than ``late`` frames behind the newest are dropped and
    counted (``late_rows``), which bounds the state to open tracks. The result doesn't depend on how
    rows fall into batches. Needs the RocksDB state store."""
    at = F.timestamp_millis(_start(F.col("video").cast("long")) + F.col("frame"))
    rows = detections.select("det_id", "video", "camera", "track_id", "frame", "conf", "area", F.coalesce("crop_path", F.lit("")).alias("crop_path"), at.alias("at"))
    tracks = rows.withWatermark("at", f"{late} milliseconds").groupBy("camera", "video", "track_id")
    return tracks.transformWithStateInPandas(_Closing(buffer), SUMMARY, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late, over the progress that the query remembers."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
