"""The keyframe filter on a stream: the last kept frame and their number are a flight's state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import EARTH_RADIUS_M

OUT = "flight_id long, k long, seq long"
STATE = "kept long, latitude double, longitude double, altitude_m double"


def metres(a: tuple, b: tuple) -> float:
    lat1, lat2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return math.hypot(2 * EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h)), b[2] - a[2])


def keyframes(frames: DataFrame, least_m: float = 2.0, least_sharp: float = 40.0) -> DataFrame:
    """As sync.keyframes; frames of a flight must arrive in order between batches, in any order within one."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, *last = state.get if state.exists else (0, None, None, None)
        out = []
        for r in pd.concat(list(parts)).sort_values(["timestamp_ms", "seq"]).itertuples():
            here = (r.latitude, r.longitude, r.altitude_m)
            if kept and (metres(tuple(last), here) < least_m or r.sharpness < least_sharp):
                continue
            out.append((key[0], kept, r.seq))
            kept, last = kept + 1, here
        state.update((kept, *last))
        yield pd.DataFrame(out, columns=["flight_id", "k", "seq"])

    return frames.groupBy("flight_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
