"""Many texts in one flat array of UTF-8 bytes: pre-tokens and merges over all of them at once."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Bits of an id that say that a word or a text begins there; the bits under them hold the id.
WORD, TEXT, ID = 0x8000, 0x4000, 0x3FFF


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each begins (and the last ends); null is an empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if data.max(initial=0) > 0x7F:
        data.tobytes().decode()  # broken UTF-8 is an error, as it is in a string
        if (data[ends[:-1][np.diff(ends) > 0]] & 0xC0 == 0x80).any():
            raise ValueError("a text begins inside a character")
    return data, ends


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point, by the pattern's own engine."""
    import regex

    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0
    text, kinds = points.tobytes().decode("utf-32-le"), np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            kinds[m.start() : m.end()] = kind
    return kinds


def word_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pre-tokens (functions.text.PRETOKEN) begin in texts that begin at the given places, of which none is the end."""
    n, kind = len(data), _kinds()[:256][data]
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    first = np.zeros(n + 4, bool)
    first[texts] = first[n] = True
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        lead = data[wide]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        point = (lead & (0x7F >> size)).astype(np.int64)
        for k in (1, 2, 3):
            point = np.where(size > k, point << 6 | padded[wide + k] & 0x3F, point)
        kinds = _kinds()[point]
        kind[wide] = kinds
        for k in (1, 2, 3):
            kind[wide[size > k] + k] = kinds[size > k]
    after = np.concatenate([kind[1:], np.full(min(n, 1), SPACE, np.uint8)])
    after[first[1 : n + 1]] = SPACE  # nothing follows
    spaces = wide[kinds == SPACE] if len(wide) else wide
    if len(spaces):
        sizes = size[kinds == SPACE]
        after[spaces] = after[spaces + sizes - 1]
    # A word begins where the kind changes, but not behind a blank, and with the last white space of a run before a word.
    start = first[:n].copy()
    start[1:] |= (kind[1:] != kind[:-1]) & (data[:-1] != 32) | (kind[1:] == SPACE) & (after[1:] != SPACE)
    for k in (1, 2, 3) if len(spaces) else ():
        start[spaces[sizes > k] + k] = False
    marks = np.flatnonzero((data == 39) & start)
    if len(marks):
        a, b = padded[marks + 1], padded[marks + 2]
        short = np.isin(a, np.frombuffer(b"sdmt", np.uint8))
        long = ((a == ord("l")) & (b == ord("l")) | ((a == ord("v")) | (a == ord("r"))) & (b == ord("e"))) & ~first[marks + 2]
        whole = ~first[marks + 1] & (short | long)
        start[marks[whole] + 1] = False
        ends = marks[whole] + np.where(short, 2, 3)[whole]
        start[ends[ends < n]] = True
    return start


def merged(ids: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """ids (with bits) after (left, right) has become new inside words, from left to right without overlaps."""
    hits = np.flatnonzero(ids[1:] == right)  # a token that begins a word has a bit more
    hits = hits[ids[hits] & ID == left]
    if left == right and len(hits):  # of a run, every other
        runs = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
        hits = hits[(hits - np.repeat(hits[runs], np.diff(runs, append=len(hits)))) % 2 == 0]
    if not len(hits):
        return ids
    ids[hits] = ids[hits] & (WORD | TEXT) | new
    keep = np.ones(len(ids), bool)
    keep[hits + 1] = False
    return ids[keep]


class Merger:
    """Ids of whole texts by merges that act one after the other, each once over all texts."""

    #: Merges up to which passes over all bytes are quicker than words one by one.
    MOST = 64

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]):
        names = {f"{b:02X}": b for b in range(256)}
        self.steps = []
        for k, (left, right) in enumerate(merges):
            self.steps.append((names[left], names[right], 256 + k))
            names[left + right] = 256 + k
        self.ids = np.array([ids[t] for t in names], "<i4")

    @classmethod
    def of(cls, ids: dict[str, int], merges: list[tuple[str, str]]) -> Merger | None:
        """None where there are many merges, or where they don't act in their order: a token made twice, or joined before it is made."""
        made = {f"{b:02X}" for b in range(256)}
        if len(merges) > cls.MOST:
            return None
        for left, right in merges:
            if left not in made or right not in made or left + right in made:
                return None
            made.add(left + right)
        return cls(ids, merges) if made <= ids.keys() else None

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where those of each begin (and the last end)."""
        filled = np.diff(ends) > 0
        texts = ends[:-1][filled]
        ids = data.astype(np.uint16)
        ids |= word_starts(data, texts).astype(np.uint16) << 15
        ids[texts] |= TEXT
        for step in self.steps:
            ids = merged(ids, *step)
        counts = np.zeros(len(filled), np.int64)
        counts[filled] = np.diff(np.flatnonzero(ids & TEXT), append=len(ids))
        return self.ids[ids & ID], np.concatenate([[0], np.cumsum(counts)])
