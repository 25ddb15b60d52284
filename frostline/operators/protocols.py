"""Parts of the session analysis that may be exchanged: how events are found, and how their mass is told."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.scalars import linear_mass, stable_id
from frostline.operators import events, frames

Keep = Callable[[str, DataFrame], DataFrame]


class Extractor(ABC):
    """Finds events in frames."""

    @abstractmethod
    def extract(self, frame_rows: DataFrame, state: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
        """(events, masks) of frame_rows (session_id, frame_idx, pixels) and their state as pixel_state gives it.

        events: the columns of event_catalog and event_id, unique in a session; masks: (session_id, event_id, frame_idx, pos), as write_masks takes them.
        keep(name, df) writes a table between steps and gives it back.
        """


@dataclass(frozen=True)
class ThresholdExtractor(Extractor):
    """Cooled pixels, connected and linked over frames."""

    height: int
    width: int
    k_sigma: float = 5.0
    reach: float = 5.0
    least: int = 1
    dt_seconds: float | None = None
    saturation: float = 60_000.0

    def extract(self, frame_rows: DataFrame, state: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
        comps = keep("components", events.components(frames.cold_frames(frame_rows, state, self.k_sigma), self.width, self.least))
        tracked = keep("tracked", events.link_tracks(comps, self.reach, keep))
        catalog = events.event_catalog(tracked, self.height, self.width, self.dt_seconds, self.saturation)
        ident = stable_id("event", centroid_x=F.round("start_x", 2), centroid_y=F.round("start_y", 2), frame_start=F.col("frame_start"), session=F.col("session_id"))
        catalog = keep("catalog", catalog.withColumn("event_id", ident))
        masks = tracked.join(catalog.select("session_id", "track", "event_id"), ["session_id", "track"])
        return catalog, masks.select("session_id", "event_id", "frame_idx", "pos")


class Calibrator(ABC):
    """Tells the mass of events from their features."""

    version: str = "unknown"

    @abstractmethod
    def predict(self, catalog: DataFrame) -> DataFrame:
        """catalog with mass_mg and mass_uncertainty_mg."""


@dataclass(frozen=True)
class LinearCalibrator(Calibrator):
    """Mass in proportion to the energy proxy, a quarter of it uncertain."""

    slope: float = 3e-4
    intercept: float = 0.0
    version: str = "linear_v1"

    def predict(self, catalog: DataFrame) -> DataFrame:
        mass = linear_mass(F.col("energy"), self.slope, self.intercept)
        return catalog.withColumn("mass_mg", mass["mass"]).withColumn("mass_uncertainty_mg", mass["uncertainty"])
