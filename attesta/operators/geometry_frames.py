"""Boxes of plain numbers, for code that handles a page at a time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Frame:
    x0: float
    y0: float
    x1: float
    y1: float

    @classmethod
    def around(cls, rows: list[dict]) -> Frame:
        return cls(min(r["x0"] for r in rows), min(r["y0"] for r in rows), max(r["x1"] for r in rows), max(r["y1"] for r in rows))

    def overlaps(self, other: Frame) -> bool:
        return max(self.x0, other.x0) < min(self.x1, other.x1) and max(self.y0, other.y0) < min(self.y1, other.y1)

    def gaps(self, other: Frame) -> tuple[float, float]:
        """How far apart the two are across and down; 0 where they meet."""
        return max(0.0, max(self.x0, other.x0) - min(self.x1, other.x1)), max(0.0, max(self.y0, other.y0) - min(self.y1, other.y1))

    def holds_center(self, other: Frame) -> bool:
        return self.x0 <= (other.x0 + other.x1) / 2 <= self.x1 and self.y0 <= (other.y0 + other.y1) / 2 <= self.y1
