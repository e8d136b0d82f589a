"""Sizes, coordinates, rectangles and strides: plain values of the driver."""

from __future__ import annotations

from dataclasses import dataclass

LIMIT = (1 << 64) - 1


@dataclass(frozen=True, order=True)
class Size:
    width: int
    height: int

    def __post_init__(self) -> None:
        if self.width < 0 or self.height < 0:
            raise ValueError("a size has no negative side")

    @property
    def area(self) -> int:
        return self.width * self.height

    def checked_area(self) -> int | None:
        """The area, or None where it exceeds 64 bits."""
        return self.area if self.area <= LIMIT else None


@dataclass(frozen=True, order=True)
class Coordinate:
    x: int
    y: int


@dataclass(frozen=True)
class Rectangle:
    """Half-open: right and bottom are the first column and row outside."""

    origin: Coordinate
    size: Size

    @classmethod
    def of(cls, x: int, y: int, width: int, height: int) -> Rectangle:
        return cls(Coordinate(x, y), Size(width, height))

    @property
    def left(self) -> int:
        return self.origin.x

    @property
    def top(self) -> int:
        return self.origin.y

    @property
    def right(self) -> int:
        return self.origin.x + self.size.width

    @property
    def bottom(self) -> int:
        return self.origin.y + self.size.height

    def checked_right(self) -> int | None:
        return self.right if self.right <= LIMIT else None

    def checked_bottom(self) -> int | None:
        return self.bottom if self.bottom <= LIMIT else None

    def inside(self, size: Size) -> bool:
        return self.left >= 0 and self.top >= 0 and self.right <= size.width and self.bottom <= size.height


@dataclass(frozen=True)
class Stride:
    x: int = 1
    y: int = 1

    def __post_init__(self) -> None:
        if self.x < 1 or self.y < 1:
            raise ValueError("a stride is at least 1")
