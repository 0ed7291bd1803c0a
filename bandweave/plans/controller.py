"""The control loop: figures of a running join in, the scheme for its next run out.

The boundary between micro-batches (or runs) is the barrier at which a new scheme takes effect, so the loop needs no
messages between workers: collect, plan, damp, and restart the query with the scheme's cells if it has changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from bandweave.operators.routing import MatrixScheme
from bandweave.plans.copies import LIMIT_BYTES, PERIOD_MS, Hysteresis, Widening, plan_copies
from bandweave.plans.spec import SUB_WINDOWS, WINDOW_MS


@dataclass(frozen=True)
class Figures:
    """Of one period: input rates of both streams, and bytes of the largest active, and active or archived, sub-index of each."""

    r_rate: float
    s_rate: float
    r_active: int = 0
    r_any: int = 0
    s_active: int = 0
    s_any: int = 0


def from_progress(progress: dict, r_source: int = 0, s_source: int = 1) -> Figures:
    """Figures of a StreamingQueryProgress (as a dict): the rates of its two sources, and its join state's memory for
    each partition in the place of sub-indexes."""
    rates = [s.get("inputRowsPerSecond") or 0.0 for s in progress.get("sources", [])]
    state = max((o.get("memoryUsedBytes", 0) // max(1, o.get("numShufflePartitions", 1)) for o in progress.get("stateOperators", [])), default=0)
    rate = lambda i: rates[i] if i < len(rates) else 0.0
    return Figures(rate(r_source), rate(s_source), state, state, state, state)


@dataclass
class Controller:
    """multiple: whether schemes may change while an earlier change is still young; if not, a change is followed by a
    pause of a window and a sub-window."""

    scheme: MatrixScheme = field(default_factory=MatrixScheme)
    limit: int = LIMIT_BYTES
    multiple: bool = True
    period_ms: int = PERIOD_MS
    now_ms: int = 0
    widenings: list[tuple[str, Widening]] = field(default_factory=list)

    def __post_init__(self) -> None:
        pause = 0 if self.multiple else (WINDOW_MS + WINDOW_MS // SUB_WINDOWS) // self.period_ms
        self.damped = Hysteresis(self.scheme.r_copies, self.scheme.s_copies, cool_down=pause)

    def step(self, f: Figures) -> MatrixScheme:
        """One period: the scheme from now on."""
        self.now_ms += self.period_ms
        s = self.scheme
        r_plan = plan_copies(f.r_active, f.r_any, s.r_copies, f.r_rate, f.s_rate, s.r_nodes, self.limit)
        s_plan = plan_copies(f.s_active, f.s_any, s.s_copies, f.s_rate, f.r_rate, s.s_nodes, self.limit)
        r, q = self.damped.step(r_plan, s_plan)
        for side, old, new in (("R", s.r_copies, r), ("S", s.s_copies, q)):
            if old != new:
                self.widenings.append((side, Widening(old, new, self.now_ms)))
        self.scheme = MatrixScheme(s.r_nodes, r, s.s_nodes, q)
        return self.scheme

    def probe_copies(self, side: str) -> int:
        """The copies by which the other stream probes `side` now: after an increase those of before it, until all that was
        stored under them has expired."""
        mine = [w for x, w in self.widenings if x == side]
        now = self.scheme.r_copies if side == "R" else self.scheme.s_copies
        return min([now, *(w.probe_copies(self.now_ms) for w in mine if w.new > w.old)])

    def cells(self) -> tuple[int, int]:
        """Rows and columns of the present scheme for band_join(cells=...)."""
        return self.scheme.cells()
