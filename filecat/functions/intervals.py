"""Sets of whole numbers as sorted ranges, for folds in which the first to come keeps its range."""

from __future__ import annotations

from bisect import bisect_left


class Ranges:
    """Disjoint ranges in order, both ends included; ranges that touch are one."""

    def __init__(self, starts: list[int] = (), ends: list[int] = ()):
        self.starts, self.ends = list(starts), list(ends)

    def add(self, start: int, end: int) -> bool:
        """Takes the range in unless the set has one of its numbers already. A binary search, and one move in the list."""
        k = bisect_left(self.ends, start)  # the first range that does not end before this one
        if k < len(self.starts) and self.starts[k] <= end:
            return False
        after = k < len(self.starts) and self.starts[k] == end + 1
        before = k > 0 and self.ends[k - 1] == start - 1
        if before and after:
            self.ends[k - 1] = self.ends[k]
            del self.starts[k], self.ends[k]
        elif before:
            self.ends[k - 1] = end
        elif after:
            self.starts[k] = start
        else:
            self.starts.insert(k, start)
            self.ends.insert(k, end)
        return True
