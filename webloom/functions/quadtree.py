"""Integer rectangles, and a quad tree that maps every point of its area to a value."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple


class Region(NamedTuple):
    """Left, top, width, height; empty if either extent isn't positive."""

    x: int
    y: int
    w: int
    h: int

    @property
    def empty(self) -> bool:
        return self.w <= 0 or self.h <= 0

    @property
    def size(self) -> int:
        return self.w * self.h

    def hull(self, other: Region) -> Region:
        """The smallest region around both; an empty one adds nothing."""
        if self.empty or other.empty:
            return other if self.empty else self
        x, y = min(self.x, other.x), min(self.y, other.y)
        return Region(x, y, max(self.x + self.w, other.x + other.w) - x, max(self.y + self.h, other.y + other.h) - y)

    def meet(self, other: Region) -> Region | None:
        x, y = max(self.x, other.x), max(self.y, other.y)
        w, h = min(self.x + self.w, other.x + other.w) - x, min(self.y + self.h, other.y + other.h) - y
        return Region(x, y, w, h) if w > 0 and h > 0 else None

    def contains(self, other: Region) -> bool:
        return self == other or (self.x <= other.x and self.y <= other.y and other.x + other.w <= self.x + self.w and other.y + other.h <= self.y + self.h)

    def holds(self, x: int, y: int) -> bool:
        return not self.empty and self.x <= x < self.x + self.w and self.y <= y < self.y + self.h

    def points(self) -> Iterator[tuple[int, int]]:
        return ((x, y) for y in range(self.y, self.y + self.h) for x in range(self.x, self.x + self.w))

    def quarters(self) -> tuple[Region, Region, Region, Region]:
        """Disjoint parts that make up the region; of a single point, four empty ones."""
        if self.w == 1 and self.h == 1:
            return (Region(self.x, self.y, 0, 0),) * 4
        a, b = self.w // 2, self.h // 2
        parts = [Region(self.x, self.y, a, b), Region(self.x + a, self.y, self.w - a, b), Region(self.x, self.y + b, a, self.h - b), Region(self.x + a, self.y + b, self.w - a, self.h - b)]
        return tuple(Region(p.x, p.y, 0, 0) if p.empty else p for p in parts)  # type: ignore[return-value]


class QuadTree:
    """Values combine by ``join`` where regions are filled over one another; ``nothing`` is its neutral value.

    A node is ``[value, None]`` or ``[None, four nodes]``; walks carry plain numbers, as a fill touches a node for about every point of its rim.
    """

    def __init__(self, bounds: Region, nothing: Any = None, join: Callable[[Any, Any], Any] | None = None) -> None:
        self.bounds, self.nothing = bounds, nothing
        self.join = join or (lambda new, old: new if new is not None else old)
        self.root: list[Any] = [nothing, None]

    def fill(self, value: Any, region: Region) -> QuadTree:
        if region.empty or self.bounds.empty:
            return self
        left, top, right, bottom = region.x, region.y, region.x + region.w, region.y + region.h
        todo = [(self.root, *self.bounds)]
        while todo:
            node, x, y, w, h = todo.pop()
            if x >= right or y >= bottom or x + w <= left or y + h <= top:
                continue
            if node[1] is None:
                if left <= x and top <= y and x + w <= right and y + h <= bottom:
                    node[0] = self.join(value, node[0])
                    continue
                old = node[0]
                node[0], node[1] = None, [[old, None], [old, None], [old, None], [old, None]]
            a, b = w // 2, h // 2
            parts = node[1]
            if a and b:
                todo.append((parts[0], x, y, a, b))
            if b:
                todo.append((parts[1], x + a, y, w - a, b))
            if a:
                todo.append((parts[2], x, y + b, a, h - b))
            todo.append((parts[3], x + a, y + b, w - a, h - b))
        return self

    def insert(self, value: Any, x: int, y: int) -> QuadTree:
        return self.fill(value, Region(x, y, 1, 1))

    def tiles(self, within: Region | None = None) -> Iterator[tuple[Region, Any]]:
        """Leaves that meet a region (all if none is given), from the top left; whole subtrees outside are passed over."""
        area = self.bounds if within is None else within
        if area.empty or self.bounds.empty:
            return
        left, top, right, bottom = area.x, area.y, area.x + area.w, area.y + area.h
        todo = [(self.root, *self.bounds)]
        while todo:
            node, x, y, w, h = todo.pop()
            if x >= right or y >= bottom or x + w <= left or y + h <= top:
                continue
            if node[1] is None:
                yield Region(x, y, w, h), node[0]
                continue
            a, b = w // 2, h // 2
            parts = node[1]
            todo.append((parts[3], x + a, y + b, w - a, h - b))
            if a:
                todo.append((parts[2], x, y + b, a, h - b))
            if b:
                todo.append((parts[1], x + a, y, w - a, b))
            if a and b:
                todo.append((parts[0], x, y, a, b))

    def hits(self, region: Region) -> list[Any]:
        """Values other than nothing under a region."""
        return [v for _, v in self.tiles(region) if v != self.nothing]

    def at(self, x: int, y: int) -> Any:
        return next((v for _, v in self.tiles(Region(x, y, 1, 1))), self.nothing)

    def tight(self, test: Callable[[Any], bool]) -> Region:
        """The hull of the tiles whose value passes."""
        hull = Region(0, 0, 0, 0)
        for r, v in self.tiles():
            if test(v):
                hull = hull.hull(r)
        return hull

    def points(self) -> dict[tuple[int, int], Any]:
        """Every point's value."""
        return {p: v for r, v in self.tiles() for p in r.points()}

    def weighted(self) -> list[Any]:
        """Every tile's value as often as the tile has points."""
        return [v for r, v in self.tiles() for _ in range(r.size)]

    def moved(self, change: Callable[[Region], Region]) -> QuadTree:
        """The same tree over other bounds."""
        out = QuadTree(change(self.bounds), self.nothing, self.join)
        out.root = self.root
        return out

    def tightened(self, test: Callable[[Any], bool]) -> QuadTree:
        """Cut to the hull of the tiles whose value passes."""
        return self.cut(self.tight(test))

    def show(self, letter: Callable[[Any], str]) -> str:
        """A letter for each point, a line for each row."""
        at = self.points()
        b = self.bounds
        return "\n".join("".join(letter(at[x, y]) for x in range(b.x, b.x + b.w)) for y in range(b.y, b.y + b.h))

    def cut(self, region: Region) -> QuadTree:
        """What lies within a region, as a tree of that size."""
        out = QuadTree(region, self.nothing, self.join)
        for r, v in list(self.tiles(region)):
            if (part := r.meet(region)) is not None:
                out.fill(v, part)
        return out
