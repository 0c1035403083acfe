"""Problem 6: splitting oversized chunks at natural boundaries.

Cuts are chosen by dynamic programming over boundary positions: the sum of the cuts' penalties and of the pieces'
squared distance from the even size is least, subject to the longest piece and the exact overlap.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Characters (code points) of a piece at most, and shared by consecutive pieces.
LIMIT, OVERLAP = 2_000, 200
#: What a cut costs after a blank line, before a line without indentation, at another line's end, after a sentence or statement, at a blank, elsewhere.
PENALTY = {"blank": 0.0, "block": 0.15, "line": 0.4, "sentence": 0.7, "space": 1.2, "hard": 4.0}
#: Weight of a piece's squared relative distance from the even size.
BALANCE = 2.0
#: Where no natural boundary lies within this many characters, the text may be cut at every such multiple of them.
GRID = 100

_LINE_END = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?;。！？]+[\"')\]]*\s|[,{}]\s")
_SPACE = re.compile(r"\s(?=\S)")


def boundaries(text: str) -> list[tuple[int, float]]:
    """(position, penalty) of all places to cut, in order; the last is the end of the text.

    Of the kinds of boundary that meet at a place the cheapest counts.  Only a stretch of more than ``GRID`` characters
    without any gets places on a grid.
    """
    n = len(text)
    places: dict[int, float] = {}
    for level, rx in (("space", _SPACE), ("sentence", _SENTENCE)):
        places.update((m.end(), PENALTY[level]) for m in rx.finditer(text))
    for m in _LINE_END.finditer(text):
        p = m.end()
        rest = text[p : p + 1]
        before = text[max(0, p - 3) : p - 1]
        # of several blank lines the last is the boundary
        blank = before.endswith(("\n", "\n\r")) and rest not in "\r\n"
        places[p] = PENALTY["blank" if blank else "block" if rest and not rest.isspace() and rest not in ")]}" else "line"]
    places.pop(n, None)
    last, extra = 0, []
    for p in [*sorted(places), n]:
        if p - last > GRID:
            # a mark that combines with the character before it stays with it
            extra += [q for q in range(last + GRID, p, GRID) if not ("̀" <= text[q] <= "ͯ" or text[q] in "‍️")]
        last = p
    places.update((q, PENALTY["hard"]) for q in extra)
    return [*sorted(places.items()), (n, 0.0)]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces: each at most ``limit`` long, each but the first starting ``overlap`` before the end of the last.

    A text within the limit is one piece; an empty text has none.
    """
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    step = limit - overlap
    pieces = -(-(n - overlap) // step)
    even = (n + overlap * (pieces - 1)) / pieces
    spots = [s for s in boundaries(text) if s[0] > overlap]
    # with a limit so small that boundaries lie too far apart, every place may be cut
    if any(b[0] - a[0] > step for a, b in zip([(overlap, 0.0), *spots], spots)):
        have = dict(spots)
        spots = [(p, have.get(p, PENALTY["hard"])) for p in range(overlap + 1, n + 1)]
    at = np.array([p for p, _ in spots], dtype=np.float64)
    penalty = np.array([c for _, c in spots])
    # the first piece begins the text; the others begin ``overlap`` before an earlier place, of which the best is taken
    best = np.where(at <= limit, penalty + BALANCE * ((at - even) / even) ** 2, np.inf)
    back = np.full(len(at), -1)
    lows = np.searchsorted(at, at - step)
    starts = at - overlap + even
    for j in range(len(at)):
        low = lows[j]
        if low == j:
            continue
        off = starts[low:j] - at[j]
        off *= off
        off *= BALANCE / even**2
        off += best[low:j]
        i = int(off.argmin())
        cost = off[i] + penalty[j]
        if cost < best[j]:
            best[j], back[j] = cost, low + i
    out, j = [], len(at) - 1
    while j >= 0:
        i = int(back[j])
        out.append((spots[i][0] - overlap if i >= 0 else 0, spots[j][0]))
        j = i
    return out[::-1]


PIECES = "chunk_id string, piece int, pieces int, start_char int, end_char int, start_line int, end_line int, content string"


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, once: bool = True) -> DataFrame:
    """The pieces of every chunk longer than ``limit`` characters; chunks within it give no row.

    Chunks with equal ids are equal texts (re-sent rows, equal sections of a file): the one with the lowest start line
    is cut, or with ``once=False`` each, in the task that reads it, without moving a text.  A null content gives no row;
    a null start line counts as 1; further columns are ignored.
    """
    long = chunks.where(F.length("content") > limit)
    if once:
        long = long.groupBy("chunk_id").agg(F.min("content").alias("content"), F.min("start_line").alias("start_line"))

    def make():
        def row(chunk_id, text, first):
            spans = cut(text, limit, overlap)
            line, at = first or 1, 0
            for k, (a, b) in enumerate(spans):
                line += text.count("\n", at, a)
                at = a
                yield chunk_id, k, len(spans), a, b, line, line + text.count("\n", a, b - 1), text[a:b]

        return row

    return map_rows(long, ["chunk_id", "content", "start_line"], PIECES, make)


def split_found(chunks: DataFrame) -> DataFrame:
    """Ids of the chunks that came out as more than one piece."""
    return pieces(chunks, once=False).where("pieces > 1 and piece = 0").select("chunk_id").distinct()
