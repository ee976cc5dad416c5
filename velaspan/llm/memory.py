"""A bounded memory of computed values, for keys that come again and again in a worker process."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

#: Texts that are looked up together, in characters or bytes.
GROUP = 1_000_000


class Memory:
    """Two generations of at most ``size`` keys each; what is used lives on when the older one is dropped.

    ``compute`` takes a list of keys and returns their values in turn. One
    group of keys may be larger than ``size``; it is dropped with its generation.
    """

    def __init__(self, compute: Callable[[list], Iterable], size: int):
        self.compute, self.size = compute, size
        self.now: dict = {}
        self.old: dict = {}

    def having(self, keys: set) -> dict:
        """A dict that holds at least these keys."""
        if len(self.now) > self.size:
            self.old, self.now = self.now, {}
        new = []
        for key in keys.difference(self.now):
            if (value := self.old.get(key)) is not None:
                self.now[key] = value
            else:
                new.append(key)
        if new:
            self.now.update(zip(new, self.compute(new), strict=True))
        return self.now

    def forget(self) -> None:
        """Hold nothing any more: what follows in this process, maybe another operator, needs the room."""
        self.now, self.old = {}, {}


def groups(texts: Iterable, limit: int = GROUP) -> Iterator[list]:
    """Consecutive texts in lists of about ``limit`` characters; None counts as nothing."""
    out, size = [], 0
    for text in texts:
        out.append(text)
        size += len(text or "") + 1
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out
