"""What a band join is: the key band, the event-time window and the physical strategy."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

#: Copies, band and window of the published workloads (fixed values): (copies of R, copies of S, half band).
WORKLOADS = {"synthetic": (4, 4, 10.0), "tpc": (4, 4, 1.0), "nexmark": (8, 2, 0.0)}
WINDOW_MS = 600_000
SUB_WINDOWS = 5
WATERMARK_MS = 500
STRATEGIES = ("auto", "range", "equi", "band_bucket", "time_bucket", "grid", "matrix")


@dataclass(frozen=True)
class BandJoinSpec:
    """R joins S where S.key - behind <= R.key <= S.key + surpass and S.ts - r_window <= R.ts <= S.ts + s_window.

    Times are epoch milliseconds. bounds: 'closed', or 'half_open' for a band without its upper end.
    r_window bounds how far R may be behind S, s_window how far ahead."""

    surpass: float = 0.0
    behind: float = 0.0
    r_window: int = WINDOW_MS
    s_window: int = WINDOW_MS
    bounds: str = "closed"
    r_key: str = "key"
    s_key: str = "key"
    r_ts: str = "ts_ms"
    s_ts: str = "ts_ms"

    def __post_init__(self) -> None:
        if not self.surpass + self.behind >= 0:
            raise ValueError("surpass + behind must not be negative")
        if self.r_window < 0 or self.s_window < 0:
            raise ValueError("windows must not be negative")
        if self.bounds not in ("closed", "half_open"):
            raise ValueError("bounds: 'closed' or 'half_open'")

    @property
    def width(self) -> float:
        return self.surpass + self.behind

    @property
    def span(self) -> int:
        return self.r_window + self.s_window

    def strategy(self, wanted: str = "auto") -> str:
        """The strategy to run: equality of keys where the band is a point, else a grid of band and time buckets."""
        if wanted not in STRATEGIES:
            raise ValueError(f"strategies: {', '.join(STRATEGIES)}")
        if wanted == "equi" and self.width:
            raise ValueError("an equi-join needs a band of width 0")
        if wanted != "auto":
            return wanted
        return "grid" if self.width else "equi"


def parse_arguments(argv: Sequence[str]) -> tuple[BandJoinSpec, int, int]:
    """--rCopyNum --sCopyNum --R_surpass_S --R_behind_S: the spec and the copies of R and S."""
    parser = argparse.ArgumentParser(allow_abbrev=False)
    parser.add_argument("--rCopyNum", type=int, required=True)
    parser.add_argument("--sCopyNum", type=int, required=True)
    parser.add_argument("--R_surpass_S", type=float, required=True)
    parser.add_argument("--R_behind_S", type=float, required=True)
    got, _ = parser.parse_known_args(argv)
    return BandJoinSpec(surpass=got.R_surpass_S, behind=got.R_behind_S), got.rCopyNum, got.sCopyNum
