"""A small lexer for languages with braces: comments and strings out of the way, depth of braces by line."""

from __future__ import annotations

import bisect
import re

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def blanked(source: str, strings: bool = False) -> str:
    """Comments become blanks, as do the insides of strings if asked for; every line keeps its length."""

    def blank(m: re.Match) -> str:
        text = m[0]
        if text[0] == "/":
            return re.sub(r"[^\n]", " ", text)
        return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[-1] if strings else text

    return _TOKEN.sub(blank, source)


def block_end(code: str, start: int) -> int:
    """Where the block that opens next from ``start`` closes; the end of the text if it doesn't."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif depth == 0:
            return m.start()
    return len(code)


class Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)


class Scopes:
    """Named blocks, innermost last.  Blocks nest; the blocks around a place are found from the last that starts before it."""

    def __init__(self):
        self.blocks: list[tuple[int, int, str, str]] = []
        self.order: list[tuple[int, int, str, str]] | None = None

    def add(self, start: int, end: int, kind: str, name: str) -> None:
        self.blocks.append((start, end, kind, name))
        self.order = None

    def _index(self) -> None:
        self.order = sorted(self.blocks)
        self.starts = [b[0] for b in self.order]
        # the nearest earlier block that has not ended where a block starts
        self.outer, open_ = [], []
        for k, block in enumerate(self.order):
            while open_ and self.order[open_[-1]][1] < block[0]:
                open_.pop()
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(k)

    def owner(self, at: int, *kinds: str) -> str | None:
        if self.order is None:
            self._index()
        names, k = [], bisect.bisect_left(self.starts, at) - 1
        while k >= 0:
            _, end, kind, name = self.order[k]
            if at <= end and kind in kinds:
                names.append(name)
            k = self.outer[k]
        return ".".join(reversed(names)) or None
