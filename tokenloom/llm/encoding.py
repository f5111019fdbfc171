"""Ids of whole texts with the tokenizers library, one merge run per distinct chunk.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so the ids of the chunks in a row
are the ids of the text (tests compare the two, special tokens included). Chunks repeat, so a worker keeps
the ids of those it has seen. Cutting and looking up are array work on the UTF-8 bytes of many texts at once: a chunk of
at most 16 bytes is its own key of two 64-bit numbers in an open-addressing table, so a hit is exact and
costs no Python object. The table is bounded; when it is full, chunks that were met once
since the last sweep go. Longer chunks are kept by their bytes, up to ``LONG_BYTES`` in all, and those of more than ``LONG_CHUNK``
bytes (a text without white space is one) not at all. It is a cache only: what it holds never changes a result.

Runs of white space that reach beyond ASCII are encoded by themselves, the text between them as any other. Texts that hold a NUL or the
string of a special token, which are rare, are cut by a regular expression instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa

#: The code points of Unicode's White_Space property, as a character class and, beyond ASCII, as UTF-8.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
WIDE_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")
NARROW = b"\t\n\v\f\r "
SPACES = re.compile(b"(?:[\t-\r ]|" + WIDE_SPACE.pattern + b")+")
#: A run of anything but white space with the space before it, or white space as the pre-tokenizers cut it.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

HELD = 1_000_000  # chunks that the cache holds
STRETCH = 1 << 19  # bytes of text that are worked on at once
LONG_CHUNK, LONG_BYTES = 256, 16 << 20  # of a chunk that is kept, and of all kept chunks beyond 16 bytes
RUNS = 10_000  # runs of wide white space whose ids are kept

# Classes of bytes. Letters are those of ASCII and Latin-1, whose classes no Unicode version changes; the apostrophe is
# no mark, as contractions span it.
_END, _SPACE, _WHITE, _LETTER, _SIGN, _DIGIT, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0], _CLASS[32] = _END, _SPACE
_CLASS[9:14] = _WHITE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _SIGN
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Row n: what is kept of the first and the second eight bytes of a chunk of n bytes.
_KEEP = np.array([[(1 << 8 * min(n, 8)) - 1, (1 << 8 * max(n - 8, 0)) - 1] for n in range(17)], dtype=np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)


class _Table:
    """Chunks of at most 16 bytes to entries; an entry is a place and a number of ids in a pool."""

    def __init__(self, held: int):
        self.bits = max(18, (2 * held - 1).bit_length())
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.first, self.second, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.at, self.count = np.zeros(size // 2, np.int64), np.zeros(size // 2, np.int32)
        self.used = np.zeros(size // 2, dtype=bool)
        self.pool, self.filled, self.entries = np.zeros(1 << 20, dtype="<u2"), 0, 0
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def keep(self, chunks: list[bytes], entries: np.ndarray) -> None:
        self.long.update(zip(chunks, entries.tolist()))
        self.long_bytes += sum(map(len, chunks))

    def drop(self, entries: int, filled: int) -> None:
        """Entries beyond the first few, that no key leads to, go; so does a pool that they have blown up."""
        self.entries, self.filled = entries, filled
        if len(self.pool) > 4 * filled + (1 << 22):
            self.pool = self.pool[: max(filled, 1 << 20)].copy()

    def room(self) -> int:
        return len(self.at) - self.entries

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (a ^ (a >> np.uint64(29)) ^ (b * _MIX[1])) * _MIX[0]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out, todo, slot, mask = np.full(len(a), -1, np.int32), None, self._slots(a, b), (1 << self.bits) - 1
        while len(slot):
            there = self.first[slot]
            hit = (there == a) & (self.second[slot] == b)
            if todo is None:
                np.copyto(out, self.entry[slot], where=hit)
            else:
                out[todo[hit]] = self.entry[slot[hit]]
            on = np.flatnonzero(~hit & (there != 0))
            todo = on if todo is None else todo[on]
            slot, a, b = (slot[on] + 1) & mask, a[on], b[on]
        return out

    def add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries of ids that follow one another."""
        if self.filled + len(ids) > len(self.pool):
            grown = np.zeros(2 * (self.filled + len(ids)), dtype="<u2")
            grown[: self.filled] = self.pool[: self.filled]
            self.pool = grown
        self.pool[self.filled : self.filled + len(ids)] = ids
        new = slice(self.entries, self.entries + len(counts))
        self.at[new] = self.filled + np.cumsum(counts) - counts
        self.count[new] = counts
        self.used[new] = False
        self.filled, self.entries = self.filled + len(ids), new.stop
        return np.arange(new.start, new.stop, dtype=np.int32)

    def put(self, a: np.ndarray, b: np.ndarray, entries: np.ndarray) -> None:
        """Different keys that are not in the table."""
        slot, mask = self._slots(a, b), (1 << self.bits) - 1
        while len(slot):
            free = np.flatnonzero(self.first[slot] == 0)
            self.entry[slot[free]] = entries[free]  # of those that want one slot the last stays
            won = free[self.entry[slot[free]] == entries[free]]
            self.first[slot[won]], self.second[slot[won]] = a[won], b[won]
            rest = np.ones(len(slot), dtype=bool)
            rest[won] = False
            slot, a, b, entries = (slot[rest] + 1) & mask, a[rest], b[rest], entries[rest]

    def sweep(self) -> None:
        """Keeps the short chunks that were met again since the last sweep, if they are not too many."""
        full = np.flatnonzero(self.first)
        a, b, e = self.first[full], self.second[full], self.entry[full]
        kept = self.used[e]
        a, b, e = a[kept], b[kept], e[kept]
        count, pool = self.count[e], self.pool[spread(self.at[e], self.count[e])]
        self._clear()
        if 2 * len(e) <= len(self.at):
            self.put(a, b, self.add(pool, count))


def spread(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places at, at + 1 ... of each of some stretches, one after another."""
    before = np.cumsum(count, dtype=np.int64) - count
    return np.repeat(at - before, count) + np.arange(int(count.sum()), dtype=np.int64)


class ChunkEncoder:
    """Texts to unsigned 16-bit ids (the vocabularies hold fewer than 65,536)."""

    def __init__(self, path: str, held: int = HELD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; idle threads would spin
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        if self._tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self._tok.get_added_tokens_decoder().values()):
            raise ValueError("special tokens that take in what stands beside them")
        self._special, self._special_bytes = re.compile("|".join(map(re.escape, special))) if special else None, [s.encode() for s in special]
        self._table = _Table(held)
        feed = self._tok.encode("\n", add_special_tokens=False).ids
        self._drops_space, self._feed = not feed, feed[0] if feed else -1
        self._folds = self._tok.normalizer is not None and self._tok.normalizer.normalize_str("AZÀÖØÞ") == "azàöøþ"
        self._runs: dict[tuple[bytes, bool], np.ndarray] = {}
        self._bytes = np.zeros(1 << 16, dtype=np.int64)  # of the text, that an id stands for
        for piece, i in self._tok.get_vocab(with_added_tokens=False).items():
            self._bytes[i] = len(piece.removesuffix("</w>") if self._drops_space else piece)

    def encode(self, texts: Sequence[str | bytes | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each closed by end_id, and how many each has; a text of None has none of its own."""
        out: list[np.ndarray] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        parts: list[bytes] = []
        of: list[int] = []
        between: list[tuple[int, np.ndarray]] = []  # ids that stand after a part
        size = 0

        def work() -> None:
            nonlocal size
            if parts:
                last = np.append(np.diff(of) != 0, True)  # the next text may begin in a later stretch, but a text's own never does
                ids, n = self._flat(parts, None if end_id is None else np.where(last, end_id, -1))
                at, upto = 0, np.cumsum(n)
                for part, run in between:
                    out.extend((ids[at : upto[part]], run))
                    at = upto[part]
                    counts[of[part]] += len(run)
                out.append(ids[at:])
                np.add.at(counts, of, n)
            parts.clear()
            of.clear()
            between.clear()
            size = 0

        for i, text in enumerate(texts):
            data = text.encode() if isinstance(text, str) else text or b""
            if self._rare(data):
                work()
                ids = np.fromiter(self._slow(data.decode(), end_id), dtype="<u2")
                counts[i] = len(ids)
                out.append(ids)
                continue
            for piece, run in self._pieces(data):
                some = list(stretches(piece))
                parts += some
                of += [i] * len(some)
                if run is not None:
                    between.append((len(parts) - 1, run))
            size += len(data)
            if size >= STRETCH:
                work()
        work()
        return np.concatenate(out) if out else np.zeros(0, "<u2"), counts

    def _rare(self, data: bytes) -> bool:
        return b"\0" in data or any(s in data for s in self._special_bytes)

    def _pieces(self, data: bytes) -> Iterator[tuple[bytes, np.ndarray | None]]:
        """What lies between runs of white space that reach beyond ASCII, and the ids of the run after each (None: none).

        A run before a word is a chunk without its last character, which is a chunk too unless it is a space: that goes with the word.
        """
        at = 0
        if not data.isascii() and any(x in data for x in WIDE_LEADS):
            while (m := WIDE_SPACE.search(data, at)) is not None:
                first = m.start()
                while first > at and data[first - 1] in NARROW:
                    first -= 1
                end = SPACES.match(data, first).end()
                space = end < len(data) and data[end - 1 : end] == b" "
                yield data[at:first], self._run(data[first : end - space], end < len(data) and not space)
                at = end - space
        yield data[at:], None

    def _run(self, run: bytes, apart: bool) -> np.ndarray:
        """The ids of a run; apart: its last character is a chunk of its own."""
        ids = self._runs.get((run, apart))
        if ids is None:
            text = run.decode()
            chunks = [c for c in ((text[:-1], text[-1:]) if apart else (text,)) if c]
            ids = np.array([i for e in self._tok.encode_batch_fast(chunks, add_special_tokens=False) for i in e.ids], dtype="<u2")
            if len(self._runs) < RUNS and len(run) <= LONG_CHUNK:
                self._runs[run, apart] = ids
        return ids

    def _slow(self, text: str, end_id: int | None) -> Iterator[int]:
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield from self._cut(text[at : m.start()])
            yield self._tok.token_to_id(m.group())
            at = m.end()
        yield from self._cut(text[at:])
        if end_id is not None:
            yield end_id

    def _cut(self, text: str) -> Iterator[int]:
        chunks = (m.group() for m in CHUNK.finditer(text))
        while some := list(islice(chunks, 1 << 16)):
            once = list(dict.fromkeys(some))
            ids = dict(zip(once, (e.ids for e in self._tok.encode_batch_fast(once, add_special_tokens=False))))
            for c in some:
                yield from ids[c]

    def _flat(self, parts: list[bytes], ends: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts without rare content, each followed by its end (-1: none), and their numbers."""
        raw = np.frombuffer(b"\0".join(parts) + bytes(17), dtype=np.uint8)
        n = len(raw) - 16
        start, words, odd = self._chunks(raw, n)
        end = np.append(start[1:], n)
        last = np.flatnonzero(raw[start] == 0)  # the chunk that closes each text
        if self._drops_space:
            start = start + ((raw[start] == 32) & (end - start > 1))
        long = end - start
        eight = np.ndarray((n + 9,), dtype="<u8", buffer=words, strides=(1,))
        keep = _KEEP[np.minimum(long, 16)]
        a, b = eight[start], eight[np.minimum(start + 8, n)]
        if words is not raw and len(odd):
            eight = np.ndarray((n + 9,), dtype="<u8", buffer=raw, strides=(1,))
            a[odd], b[odd] = eight[start[odd]], eight[np.minimum(start[odd] + 8, n)]
        a, b = a & keep[:, 0], b & keep[:, 1]
        over = np.flatnonzero(long > 16)
        a[over] = 0
        plain = a != 0
        found = np.zeros(len(start), np.int32)
        found[plain] = self._known(a[plain], b[plain])
        table = self._table
        if len(over):  # few: by their bytes
            text = [raw[s:e].tobytes() for s, e in zip(start[over].tolist(), end[over].tolist())]
            new = [c for c in dict.fromkeys(text) if c not in table.long]
            if len(new) > table.room() or table.long_bytes + sum(len(c) for c in new if len(c) <= LONG_CHUNK) > LONG_BYTES:
                table.sweep()
                found[plain], new = self._known(a[plain], b[plain]), list(dict.fromkeys(text))
            short, once = [c for c in new if len(c) <= LONG_CHUNK], [c for c in new if len(c) > LONG_CHUNK]
            if short:
                table.keep(short, table.add(*self._ids([c.decode() for c in short])))
            kept = table.entries, table.filled
            passing = dict(zip(once, table.add(*self._ids([c.decode() for c in once])).tolist())) if once else {}
            found[over] = [passing[c] if len(c) > LONG_CHUNK else table.long[c] for c in text]
        at, count = table.at[found], table.count[found].astype(np.int64)
        count[last] = 0
        if ends is not None:
            count[last] = ends >= 0
            at[last] = 0
        flat = table.pool[spread(at, count)]
        if len(over):
            table.drop(*kept)
        upto = np.cumsum(count)
        if ends is not None:
            flat[upto[last[ends >= 0]] - 1] = ends[ends >= 0]
        return flat, np.diff(upto[last], prepend=0)

    def _chunks(self, raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where chunks start, the bytes to look up (in lower case if the tokenizer ignores case), and the chunks to look up as they stand."""
        kind = _CLASS[raw[:n]]
        lead = np.flatnonzero(raw[:n] == 0xC3)
        second = raw[lead + 1]
        latin = lead[(second != 0x97) & (second != 0xB7)]
        kind[latin] = kind[latin + 1] = _LETTER
        words = raw
        if self._folds:
            words = _LOWER[raw]
            words[lead[(second < 0x9F) & (second != 0x97)] + 1] += 32
        begin = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
        k = kind[begin]
        before = np.concatenate([[_END], k[:-1]])
        white, white_before = (k == _SPACE) | (k == _WHITE), (before == _SPACE) | (before == _WHITE)
        inside = ~white & (k != _END)
        first = inside & (white_before | (before == _END))  # a run of no white space
        flag = np.zeros(n, dtype=bool)
        flag[begin[white & ~white_before]] = True
        flag[begin[first] - white_before[first]] = True  # with the last white space, which is a chunk of its own unless a space
        flag[begin[first & (before != _SPACE)]] = True
        field = np.cumsum(first) - 1
        other = k == _OTHER
        whole = np.zeros(int(first.sum()) + 1, dtype=bool)  # fields with characters of other classes are chunks as they are
        whole[field[other]] = True
        flag[begin[inside & ~first & ~whole[field]]] = True
        flag[raw[:n] == 0] = True
        start = np.flatnonzero(flag)
        odd = np.unique(np.searchsorted(start, begin[other], side="right") - 1) if self._folds else np.zeros(0, np.int64)
        return start, words, odd

    def _known(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entries of short chunks, learned where they are new."""
        table = self._table
        found = table.find(a, b)
        missing = np.flatnonzero(found < 0)
        table.used[found[found >= 0]] = True
        if len(missing):
            order = missing[np.lexsort((b[missing], a[missing]))]
            x, y = a[order], b[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            if int(new.sum()) > table.room():
                table.sweep()
                return self._known(a, b)
            text = np.stack([x[new], y[new]], axis=1).tobytes()
            chunks = [text[i : i + 16].rstrip(b"\0").decode() for i in range(0, len(text), 16)]
            entries = table.add(*self._ids(chunks))
            table.put(x[new], y[new], entries)
            found[order] = entries[np.cumsum(new) - 1]
        return found

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of different chunks in a row, and how many each has.

        Words that follow a space go many in one string: the bytes that the ids stand for show where each word ends.
        """
        joined = [i for i, c in enumerate(chunks) if c[:1] == " " and c[1:].isalpha() and WORD.fullmatch(c)] if not self._drops_space else [i for i, c in enumerate(chunks) if WORD.fullmatch(c)]
        rest = sorted(set(range(len(chunks))).difference(joined))
        glue = " " if self._drops_space else ""
        parts = [glue.join([chunks[i] for i in joined[at : at + 64]]) for at in range(0, len(joined), 64)]
        got = [e.ids for e in self._tok.encode_batch_fast(parts + [chunks[i] for i in rest], add_special_tokens=False)]
        counts = np.zeros(len(chunks), dtype=np.int64)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((i for x in got for i in x), dtype="<u2", count=int(lengths.sum()))
        cut = int(lengths[: len(parts)].sum())
        if joined:
            sizes = [len(chunks[i].encode()) for i in joined]
            stop = np.searchsorted(self._bytes[ids[:cut]].cumsum(), np.cumsum(sizes, dtype=np.int64)) + 1
            counts[joined] = np.diff(stop, prepend=0)
        counts[rest] = lengths[len(parts) :]
        place = np.zeros(len(chunks), dtype=np.int64)
        order = np.array(joined + rest, dtype=np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        return ids[spread(place, counts)], counts


#: A chunk of letters alone, after a space or not.
WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def stretches(data: bytes) -> Iterator[bytes]:
    """A text in parts of about STRETCH bytes, cut before a single space between other characters; whole if there is none."""
    at = 0
    while len(data) - at > 2 * STRETCH:
        cut = data.find(b" ", at + STRETCH)
        while cut > 0 and (data[cut - 1] in b"\t\n\v\f\r " or data[cut + 1 : cut + 2] in (b"", b"\t", b"\n", b"\v", b"\f", b"\r", b" ")):
            cut = data.find(b" ", cut + 1)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def binary(data, ends: np.ndarray) -> pa.Array:
    """Values that follow one another in data; ends: where each begins and the last one ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def split(ids: np.ndarray, counts: Iterable[int]) -> list[bytes]:
    """The ids of each text as bytes."""
    raw, at, out = ids.tobytes(), 0, []
    for n in counts:
        out.append(raw[at : at + 2 * n])
        at += 2 * n
    return out


_MADE: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, held: int = HELD) -> ChunkEncoder:
    """One encoder a worker process."""
    if (path, held) not in _MADE:
        _MADE.clear()
        _MADE[path, held] = ChunkEncoder(path, held)
    return _MADE[path, held]


def drop_encoders() -> None:
    """Called where a task of a later step begins: its worker needs the memory."""
    _MADE.clear()
