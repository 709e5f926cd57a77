"""A small linear congruential generator, for runs that have to be alike on any system.

For use on the driver only: its draws depend on their order."""

from __future__ import annotations

#: Multiplier, increment and range of the classic C library example.  Fixed values.
MULTIPLIER, INCREMENT, RANGE = 1103515245, 12345, 32768


class Lcg:
    def __init__(self, seed: int = 42) -> None:
        self.state = seed & 0xFFFFFFFF

    def draw(self) -> int:
        """The next number below RANGE."""
        self.state = (self.state * MULTIPLIER + INCREMENT) & 0xFFFFFFFF
        return self.state // 65536 % RANGE

    def share(self) -> float:
        """The next number from 0 to 1."""
        return self.draw() / RANGE
