"""Landmarks of signals whose samples arrive in chunks.

State per signal: the samples of an unfinished window, the spectra of the two frames before, the peaks that still
wait for partners, and how many landmarks each family has had; none grows with the signal.  The state store must be
RocksDB's (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.spectrum import BANDS, MOST_STEPS, STEP_MS, Sound, spectra
from tidemark.session import ship_package


def loudest(bands: np.ndarray, before: np.ndarray, behind: np.ndarray, sound: Sound) -> list[tuple[int, float]]:
    """(band, magnitude) of the frame's peaks, the loudest first."""
    inner = slice(1, BANDS - 1)
    x = bands[inner]
    # Added from the first band on, as an aggregate over an array does.
    mean = float(np.add.accumulate(bands)[-1]) / BANDS
    peak = (x > bands[:-2]) & (x >= bands[2:]) & (x >= before[inner]) & (x > behind[inner]) & (x >= mean * sound.above_mean)
    found = [(int(b) + 1, float(bands[b + 1])) for b in np.flatnonzero(peak)]
    return sorted(found, key=lambda p: (-p[1], p[0]))[: sound.peaks]


class Landmarks(StatefulProcessor):
    """Finds a signal's landmarks as its frames come in; with the chunk that is the last the signal's state ends."""

    def __init__(self, media: str, sound: Sound):
        self.media, self.sound = media, sound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "frame bigint, tail array<int>, before array<double>, open array<double>, open_loud double")
        self.waiting = handle.getListState("waiting", "time_ms bigint, band int, magnitude double, partners int")
        self.seen = handle.getMapState("seen", "family bigint", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self.sound
        frame, tail, before, open_, loud = self.at.get() if self.at.exists() else (0, [], None, None, 0.0)
        before, open_ = (None if x is None else np.array(x, float) for x in (before, open_))
        anchors = [list(x) for x in self.waiting.get()]
        counts: dict[int, int] = {}
        found: list[tuple] = []
        silent = np.zeros(BANDS)

        def close(behind: np.ndarray) -> None:
            """The open frame has its neighbours: its peaks are partners of those that wait, and wait themselves."""
            time = int(s.time_ms(frame - 1))
            peaks = loudest(open_, silent if before is None else before, behind, s) if loud >= s.silence else []
            for a in anchors:
                delta = time - a[0]
                if not s.least_ms <= delta <= s.most_ms:
                    continue
                for band, magnitude in peaks[: s.partners - a[3]]:
                    step = min(MOST_STEPS, (delta + STEP_MS // 2) // STEP_MS)
                    family = a[1] << 8 | band
                    if family not in counts:
                        counts[family] = self.seen.getValue((family,))[0] if self.seen.containsKey((family,)) else 0
                    strength = int(np.floor(np.log(min(a[2], magnitude) + 1) * 1000 + 0.5))
                    found.append((key[0], a[0], family << 8 | step, strength, family, counts[family]))
                    counts[family] += 1
                    a[3] += 1
            anchors[:] = [a for a in anchors if a[3] < s.partners and time - a[0] <= s.most_ms]
            anchors.extend([time, band, magnitude, 0] for band, magnitude in peaks)

        table = pd.concat(list(rows)).sort_values("seq", kind="stable")
        signal = np.concatenate([np.array(tail, np.int64), *(np.asarray(x, np.int64) for x in table["samples"])])
        n = max(0, (len(signal) - s.window) // s.hop + 1)
        if n:
            starts = np.arange(n) * s.hop
            bands, loudness = spectra(signal[starts[:, None] + np.arange(s.window)], s)
            for k in range(n):
                if open_ is not None:
                    close(bands[k])
                before, open_, loud = open_, bands[k], float(loudness[k])
                frame += 1
            signal = signal[n * s.hop :]
        if table["last"].any():
            if open_ is not None:
                close(silent)
            for state in (self.at, self.waiting, self.seen):
                state.clear()
        else:
            listed = lambda x: None if x is None else x.tolist()
            self.at.update((frame, signal.tolist(), listed(before), listed(open_), loud))
            self.waiting.put([tuple(a) for a in anchors]) if anchors else self.waiting.clear()
            for family, count in counts.items():
                self.seen.updateValue((family,), (count,))
        yield pd.DataFrame(found, columns=[self.media, "time_ms", "hash", "strength", "family", "ordinal"])

    def close(self) -> None:
        pass


def landmark_stream(chunks: DataFrame, media: str, sound: Sound) -> DataFrame:
    """(media, time_ms, hash, strength, family, ordinal) of a stream of (media, seq, samples, last).

    Chunks of a signal must come in the order of ``seq``; inside a batch of the stream any order will do.
    """
    ship_package(chunks.sparkSession)
    kind = chunks.schema[media].dataType.simpleString()
    out = StructType.fromDDL(f"`{media}` {kind}, time_ms bigint, hash bigint, strength bigint, family bigint, ordinal bigint")
    return chunks.select(media, "seq", "samples", "last").groupBy(media).transformWithStateInPandas(Landmarks(media, sound), out, "append", "None")
