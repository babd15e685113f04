"""What extractors share: rows of nodes and raw edges, masked source, brackets."""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_left, bisect_right
from math import isqrt

import numpy as np


def _bytes_before(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.append(0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)))


class Rows:
    """Nodes and raw edges of one file, as dictionaries."""

    def __init__(self, path: str, content: str, language: str, is_test_file: bool):
        self.path, self.content, self.language, self.is_test_file = path, content, language, is_test_file
        self.rows: list[dict] = []
        #: Bytes before each character, where they differ.
        self.before = None if content.isascii() else _bytes_before(content)
        self.lines = [m.start() for m in re.finditer("\n", content)]

    def byte(self, at: int) -> int:
        return at if self.before is None else int(self.before[at])

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def node(self, label: str, name: str, start: int, end: int, **more) -> str:
        a, b = self.byte(start), self.byte(end)
        ident = hashlib.sha256(f"{self.path}:{label}:{name}:{a}:{b}".encode("utf-8", "surrogatepass")).hexdigest()[:16]
        row = {"tag": "node", "id": ident, "label": label, "name": name, "file_path": self.path, "start_byte": a, "end_byte": b, "line_number": self.line(start), "language": self.language, "is_test": False, "is_test_file": self.is_test_file, "is_exported": False}
        row |= {k: v for k, v in more.items() if k != "props"}
        row["props"] = {k: str(v) for k, v in (more.get("props") or {}).items() if v not in (None, False)}
        self.rows.append(row)
        return ident

    def edge(self, kind: str, src: str, ref: str, at: int = 0, **more) -> None:
        a = self.byte(at)
        ident = hashlib.sha256(f"{self.path}:{kind}:{src}:{ref}:{a}".encode("utf-8", "surrogatepass")).hexdigest()[:16]
        row = {"tag": "edge", "id": ident, "type": kind, "src_id": src, "dst_ref": ref, "file_path": self.path, "start_byte": a, "end_byte": a}
        self.rows.append(row | {k: v for k, v in more.items() if k != "props"} | {"props": {k: str(v) for k, v in (more.get("props") or {}).items()}})

    def file(self, package: str | None = None) -> None:
        base = self.path.rsplit("/", 1)[-1]
        self.rows.insert(0, {"tag": "node", "id": self.path, "label": "File", "name": base, "file_path": self.path, "start_byte": 0, "end_byte": self.byte(len(self.content)), "line_number": 1, "language": self.language, "is_test": False, "is_test_file": self.is_test_file, "is_exported": False, "props": {"package": package} if package else {}})


_TOKENS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)


def mask(source: str) -> str:
    """The source with the insides of comments and strings as spaces; every place keeps its offset."""

    def blank(m):
        t = m.group()
        inner = re.sub(r"[^\n]", " ", t[1:-1])
        return re.sub(r"[^\n]", " ", t) if t[:2] in ("//", "/*") else t[0] + inner + t[-1]

    return _TOKENS.sub(blank, source)


_CLOSE = {"{": "}", "(": ")", "[": "]"}


def closing(masked: str, at: int) -> int:
    """Place of the bracket that closes the one at at, or the end."""
    opened, close, depth = masked[at], _CLOSE[masked[at]], 0
    for m in re.compile(f"[{re.escape(opened)}{re.escape(close)}]").finditer(masked, at):
        depth += 1 if m.group() == opened else -1
        if depth == 0:
            return m.start()
    return len(masked) - 1


def doc_comment(content: str, start: int) -> str:
    """Line comments right above a declaration."""
    out = []
    for line in reversed(content[:start].rstrip(" \t").split("\n")[:-1]):
        if not line.strip().startswith("//"):
            break
        out.append(line.strip()[2:].strip())
    return "\n".join(reversed(out))


class Spans:
    """Places (start, end, id) that lie apart or inside each other; the innermost around a place is found by a sorted search
    and a look at the latest few, which are sorted in when they are more than about the root of all."""

    def __init__(self):
        self.rows: list[tuple[int, int, str]] = []
        self.made, self.cuts, self.owner = 0, [], []

    def add(self, start: int, end: int, ident: str) -> None:
        self.rows.append((start, end, ident))

    def _settle(self):
        """Boundaries, and the innermost span from each on. Of two that cross, the shorter counts where both are."""
        self.made, self.cuts, self.owner = len(self.rows), [], []
        events = sorted([(a, 1, k) for k, (a, z, _) in enumerate(self.rows) if z > a] + [(z, 0, k) for k, (a, z, _) in enumerate(self.rows) if z > a])
        heap: list = []
        gone = set()
        for at, opens, k in events:
            if opens:
                heapq.heappush(heap, (self.rows[k][1] - self.rows[k][0], k))
            else:
                gone.add(k)
            while heap and heap[0][1] in gone:
                heapq.heappop(heap)
            if self.cuts and self.cuts[-1] == at:
                self.owner[-1] = heap[0][1] if heap else None
            else:
                self.cuts.append(at)
                self.owner.append(heap[0][1] if heap else None)

    def innermost(self, at: int) -> str | None:
        """Id of the smallest span around a place."""
        if len(self.rows) - self.made > 64 + 4 * isqrt(len(self.rows)):
            self._settle()
        k = bisect_right(self.cuts, at) - 1
        best = self.rows[self.owner[k]] if k >= 0 and self.owner[k] is not None else None
        for x in self.rows[self.made :]:
            if x[0] <= at < x[1] and (best is None or x[1] - x[0] < best[1] - best[0]):
                best = x
        return best and best[2]
