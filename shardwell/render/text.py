"""Tables, panels and charts as plain text, in Unicode or ASCII."""

from __future__ import annotations

import math
import shutil
import sys
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from ..functions.histogram import time_label


@dataclass(frozen=True)
class Style:
    """The characters to draw with: bars by eighths, points, outliers, the stroke of a line, and the frame."""

    blocks: str
    point: str
    outlier: str
    stroke: str
    rail: str
    notch: str
    floor: str
    tooth: str


UNICODE = Style("▏▎▍▌▋▊▉█", "•", "×", "┃", "▕", "╼", "▔", "╿")
ASCII = Style("=", "*", "x", ":", "|", "+", "-", "'")


def style(stream=None) -> Style:
    """Unicode if the stream can encode it."""
    try:
        "".join(vars(UNICODE).values()).encode(getattr(stream or sys.stdout, "encoding", None) or "ascii")
    except (UnicodeEncodeError, LookupError):
        return ASCII
    return UNICODE


def put(text: str, stream=None) -> None:
    """Print, with characters that the stream cannot encode replaced."""
    stream = stream or sys.stdout
    encoding = getattr(stream, "encoding", None) or "utf-8"
    print(text.encode(encoding, "replace").decode(encoding), file=stream)


def chart_width(columns: int | None = None) -> int:
    """Room for a chart: all of a narrow console, and four fifths of what a wide one has beyond 100, to 480."""
    columns = max(2, columns or shutil.get_terminal_size((100, 24)).columns)
    return columns if columns <= 100 else min(480, 100 + (columns - 100) * 4 // 5)


def grid(title: str, head: Sequence[str], rows: Iterable[Sequence], right: Sequence[int] = ()) -> str:
    """A table with a rule under its head; cells of columns in `right` stand at the right."""
    cells = [[("" if c is None else str(c)).replace("\n", " ") for c in r] for r in rows]
    wide = [max(len(x) for x in col) for col in zip(head, *cells, strict=True)]
    line = lambda r: "  ".join(c.rjust(w) if i in right else c.ljust(w) for i, (c, w) in enumerate(zip(r, wide, strict=True))).rstrip()
    return "\n".join([title, line(head), "  ".join("-" * w for w in wide), *map(line, cells)])


def number_tick(value: float) -> str:
    """A whole number without a point, any other with six digits."""
    if math.isfinite(value) and math.isclose(value, round(value), rel_tol=1e-9, abs_tol=1e-9):
        return f"{round(value)}"
    return f"{value:.6g}"


def time_tick(value: float) -> str:
    """UTC text of an epoch. One of more than eleven digits counts in thousandths of a second, of more than fourteen in
    millionths, of more than seventeen in billionths; what no calendar has stays a number."""
    if not math.isfinite(value):
        return str(value)
    digits = len(f"{abs(value):.0f}")
    return time_label(value / 1000 ** sum(digits > n for n in (11, 14, 17)))


def steps(low: float, high: float, most: int) -> list[float]:
    """Round values within a range, `most` at most: multiples of 1, 2 or 5 times a power of ten."""
    if not high > low or most < 1:
        return [low]
    size = 10.0 ** math.floor(math.log10((high - low) / most))
    size = next((size * f for f in (1, 2, 5, 10) if (high - low) / (size * f) <= most), size * 10)
    return [k * size for k in range(math.ceil(low / size - 1e-9), math.floor(high / size + 1e-9) + 1)][:most] or [low]


def bars(items: Sequence[tuple[str, int]], width: int = 32, room: int | None = None, s: Style = UNICODE) -> str:
    """A bar per item with its count behind it, drawn to an eighth of a character. Labels are cut at 35; where `room`
    is short, bars give way before labels do."""
    if not items:
        return ""
    most = max([n for _, n in items]) or 1
    names = [t if len(t) <= 35 else f"{t[:34]}~" for t, _ in items]
    wide, tail = max(map(len, names)), 1 + len(str(most))
    if room is not None:
        width = min(width, max(0, room - wide - tail - 1))
        wide = min(wide, max(0, room - tail - 1 - width))
    out = []
    for name, (_, n) in zip(names, items, strict=True):
        eighths = max(1, round(8 * width * n / most)) if n and width else 0
        full, rest = divmod(eighths, 8)
        if len(s.blocks) == 1:
            bar = s.blocks * max(full + (rest >= 4), min(1, eighths))
        else:
            bar = s.blocks[-1] * full + (s.blocks[rest - 1] if rest else "")
        shown = name if len(name) <= wide else name[: max(0, wide - 1)] + "~" * (wide > 0)
        row = f"{shown:>{wide}}{s.rail}{bar} {n}"
        out.append(row if room is None else row[:room])
    return "\n".join(out)


class Canvas:
    """Cells over a range of x and y, with round values on a rail at the left and under the floor."""

    def __init__(self, xs: Sequence[float], ys: Sequence[float], room: int, height: int, x_tick: Callable[[float], str], s: Style):
        widen = lambda v: (min(v) - 0.5, max(v) + 0.5) if math.isclose(min(v), max(v), rel_tol=1e-9, abs_tol=1e-9) else (min(v), max(v))
        (self.x0, self.x1), (self.y0, self.y1) = widen(xs), widen(ys)
        self.height, self.s, self.x_tick = max(2, height), s, x_tick
        self.marks = {self.row(v): number_tick(v) for v in (steps(self.y0, self.y1, max(2, self.height // 3)) if min(ys) < max(ys) else [min(ys)])}
        self.margin = max(map(len, self.marks.values())) + 1
        self.width = max(2, room - self.margin - 1)
        self.ends = min(xs), max(xs)
        self.cells = [[" "] * self.width for _ in range(self.height)]

    def column(self, x: float) -> int:
        return min(self.width - 1, int((x - self.x0) / (self.x1 - self.x0) * self.width))

    def row(self, y: float) -> int:
        return self.height - 1 - min(self.height - 1, int((y - self.y0) / (self.y1 - self.y0) * self.height))

    def put(self, x: float, y: float, mark: str) -> None:
        self.cells[self.row(y)][self.column(x)] = mark

    def __str__(self) -> str:
        body = [f"{self.marks.get(i, ''):>{self.margin}}{self.s.notch if i in self.marks else self.s.rail}{''.join(row).rstrip()}" for i, row in enumerate(self.cells)]
        low, high = (self.x_tick(x) for x in self.ends)
        teeth = [self.s.floor] * self.width
        under = [" "] * (self.width + len(high))
        for x, text, right in ((self.ends[0], low, False), (self.ends[1], high, True)):
            at = self.column(x)
            teeth[at] = self.s.tooth
            start = max(0, at - len(text) + 1) if right and low != high else at
            if right and low == high:
                continue
            if right and start <= len(low):  # no room for both in one row
                under += ["\n", *" " * (self.margin + 1 + max(0, start)), *text]
            else:
                under[start : start + len(text)] = text
        return "\n".join([*body, " " * (self.margin + 1) + "".join(teeth), (" " * (self.margin + 1) + "".join(under)).rstrip()])


def _drawable(points: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    return [(x, y) for x, y in points if math.isfinite(x) and math.isfinite(y)]


def scatter(points: Sequence[tuple[float, float]], outliers: Sequence[tuple[float, float]] = (), room: int = 80, height: int = 16, x_tick: Callable[[float], str] = number_tick, s: Style = UNICODE) -> str:
    """Points, and outliers over them."""
    plain, odd = _drawable(points), _drawable(outliers)
    if not plain and not odd:
        return ""
    canvas = Canvas(*zip(*plain, *odd, strict=True), room, height, x_tick, s)
    for some, mark in ((plain, s.point), (odd, s.outlier)):
        for x, y in some:
            canvas.put(x, y, mark)
    return str(canvas)


def resampled(points: Sequence[tuple[float, float]], width: int, method: str = "linear") -> list[float]:
    """The heights of a line at evenly spaced places; nearest takes the left of two equally near points. Points
    of one x stay as they are."""
    import numpy as np

    x, y = (np.array(c, float) for c in zip(*sorted(points, key=lambda p: p[0]), strict=True))
    if x[0] == x[-1]:
        return y.tolist()
    places = np.linspace(x[0], x[-1], max(2, width))
    if method == "linear":
        return np.interp(places, x, y).tolist()
    right = np.clip(np.searchsorted(x, places, side="left"), 1, len(x) - 1)
    left = right - 1
    out = np.where(places - x[left] <= x[right] - places, y[left], y[right])
    return np.where(places >= x[-1], y[-1], np.where(places <= x[0], y[0], out)).tolist()


def line(points: Sequence[tuple[float, float]], room: int = 80, height: int = 16, method: str = "linear", x_tick: Callable[[float], str] = number_tick, s: Style = UNICODE) -> str:
    """A line: in each column a point, and a stroke half way to the points beside it."""
    points = _drawable(points)
    if not points:
        return ""
    xs, ys = zip(*points, strict=True)
    canvas = Canvas(xs, ys, room, height, x_tick, s)
    heights = resampled(points, canvas.width, method)[: canvas.width]
    for i, y in enumerate(heights):
        beside = [(y + heights[j]) / 2 for j in (i - 1, i + 1) if 0 <= j < len(heights)]
        rows = [canvas.row(v) for v in (y, *beside)]
        for r in range(min(rows), max(rows) + 1):
            canvas.cells[r][i] = s.stroke
        canvas.cells[rows[0]][i] = s.point
    return str(canvas)
