"""Conversation structure repair (operator 13): error-correcting Earley parsing of role sequences.

The grammar of roles, s?(ua)+ or nothing, is left-linear, so every item of a chart begins at its first row, and a column has a fixed
number of items. Error productions make it total: a row is deleted (cost 3), read as user or assistant (2), or a message is
inserted without a row (2); a truncated row that stays costs 1, a blank or repeated one must go. An item keeps
the least (cost, audit), audit being the initials of the edits; of equal costs no audit begins with another, as they read
as many rows, so the least of a whole is made of least parts.

That also lets a long conversation be parsed in blocks: rows are sorted over the cluster by conversation and turn, and a task
cuts them into blocks of up to ``BLOCK`` rows or ``BLOCK_CHARS``, each with a chart from every symbol that may stand before it. Charts of a
conversation are chained in one small step (some 16 bytes a row, no texts), which gives each block the symbol before it and its edits;
blocks then rewrite their own rows. Only the digest of a repaired conversation reads it in order, block by block, as a stream.

Edge cases: null role or text is one space; rows of one turn are ordered by role and a hash of the text, so equal ones are
neighbours; turns may be null (they come first) and null conv_id is one conversation; a role of another initial than s, u, a, or an empty
one, can only be replaced or deleted; gaps beyond a long are null; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, fan_out, session, small_batches, written

BLOCK, BLOCK_CHARS = 512, 1 << 20
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_NAMES = {"u": "user", "a": "assistant"}


class Production(NamedTuple):
    """left -> before, then a row (or none) read as symbol by an edit."""

    left: str
    before: str
    symbol: str
    edit: str
    cost: int


SYMBOLS = ["Open", "System", "Asked", "Done"]
#: A dialogue ends here.
ENDS = ["Open", "Done"]
_RULES = [("System", "Open", "s"), ("Asked", "Open", "u"), ("Asked", "System", "u"), ("Asked", "Done", "u"), ("Done", "Asked", "a")]
GRAMMAR = [
    *(Production(*r, "K", 0) for r in _RULES),
    *(Production(*r, edit, 2) for r in _RULES if r[2] in _NAMES for edit in "RI"),
    *(Production(s, s, "", "D", 3) for s in SYMBOLS),
]
_INSERTS = {s: [p for p in GRAMMAR if p.before == s and p.edit == "I"] for s in SYMBOLS}
_READS = {s: [p for p in GRAMMAR if p.before == s and p.edit != "I"] for s in SYMBOLS}

Best = tuple[int, str]


def _closed(column: dict[str, Best]) -> dict[str, Best]:
    """Completes a column: insertions need no row. Least items first, so each symbol is settled once."""
    agenda, settled = [(*v, s) for s, v in column.items()], {}
    heapq.heapify(agenda)
    while agenda:
        cost, audit, symbol = heapq.heappop(agenda)
        if symbol not in settled:
            settled[symbol] = (cost, audit)
            for p in _INSERTS[symbol]:
                if p.left not in settled:
                    heapq.heappush(agenda, (cost + p.cost, audit + p.edit, p.left))
    return settled


def parse(rows: list[tuple[str, bool, bool]], start: str = "Open") -> dict[str, Best]:
    """Least (cost, audit) of every symbol over rows (initial, must go, truncated), from a symbol."""
    column = _closed({start: (0, "")})
    for initial, must_go, truncated in rows:
        scanned: dict[str, Best] = {}
        for symbol, (cost, audit) in column.items():
            for p in _READS[symbol]:
                if p.edit == "D":
                    found = (cost + p.cost, audit + "D")
                elif must_go or p.edit == "K" and p.symbol != initial:
                    continue
                else:
                    found = (cost + p.cost + truncated, audit + p.edit)
                if p.left not in scanned or found < scanned[p.left]:
                    scanned[p.left] = found
        column = _closed(scanned)
    return column


def applied(symbol: str, audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(role, text) that stay of rows (role, text) under the edits, from the symbol before them."""
    out, at = [], 0
    after = {(p.before, p.symbol): p.left for p in GRAMMAR if p.symbol}
    turn = {p.before: p.symbol for p in GRAMMAR if p.edit == "R"}
    for edit in audit:
        role, text = rows[at] if edit != "I" else ("", "")
        at += edit != "I"
        if edit == "D":
            continue
        new = role[:1] if edit == "K" else turn[symbol]
        out.append((role if edit == "K" else _NAMES[new], text))
        symbol = after[symbol, new]
    return out


def damaged(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with faults by the checksum of conv_id:turn; a dropped row stays as a mark of its conversation."""
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(string("conv_id"), F.lit(":"), string("turn"))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = messages.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias(f"{OWN}copy"),
    )
    return rows.drop(f"{OWN}copy")


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows sorted by conversation and turn. Of a conversation that begins in this task the first block needs one chart only."""
    from pyspark import TaskContext

    part, seq, out, size = TaskContext.get().partitionId(), 0, [], 0
    names, kind = None, None
    now, first_here, last = None, True, None
    held: list[tuple] = []

    def block(conv, begins: bool) -> dict:
        rows = [(role[:1], b or d, t) for _, role, _, b, d, t in held]
        known = ["Open"] if begins else SYMBOLS
        charts = {s: parse(rows, s) if s in known else {} for s in SYMBOLS}
        initials, turns = [r[0] for r in rows], [h[0] for h in held if h[0] is not None]
        flat = [charts[s].get(e) for s in SYMBOLS for e in SYMBOLS]
        return {
            "conv_id": conv, "part": part, "seq": seq, "n": len(held), "n_blank": sum(h[3] for h in held), "n_duplicate": sum(h[4] for h in held), "n_truncated": sum(h[5] for h in held),
            "n_illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "initials": [initials[0], initials[-1]] if initials else None,
            "turns": [turns[0], turns[-1], len(set(turns))] if turns else None, "costs": [c[0] if c else None for c in flat], "audits": [c[1] if c else None for c in flat],
            "roles": [h[1] for h in held], "texts": [h[2] for h in held],
        }

    def flush() -> pa.RecordBatch:
        nonlocal out, size
        shape = pa.schema([("conv_id", kind), ("part", pa.int32()), ("seq", pa.int64()), *((c, pa.int64()) for c in ("n", "n_blank", "n_duplicate", "n_truncated", "n_illegal")), ("initials", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
        got, out, size = pa.RecordBatch.from_pylist(out, schema=shape), [], 0
        return got

    chars, begins = 0, False
    for b in batches:
        names, kind = b.schema.names, b.schema.field("conv_id").type
        for conv, turn, role, text, gone, later, t1, t2 in zip(*(b.column(c).to_pylist() for c in names)):
            new = first_here or conv != now
            if not first_here and (new or len(held) >= most or chars >= BLOCK_CHARS):
                out.append(block(now, begins))
                size += chars + 64
                seq, held, chars = seq + 1, [], 0
                if size >= 4 << 20:
                    yield flush()
                begins = False
            if new:
                begins, now, first_here, last = not first_here, conv, False, None
            if gone:
                continue
            plain = text.rstrip(_SPACE)
            key = (turn, role, t1, t2)
            blank, repeat = not plain, later or key == last
            held.append((turn, role, text, blank, repeat and not blank, not blank and not repeat and plain[-1] not in ".!?"))
            chars, last = chars + len(text), key
    if not first_here:
        out.append(block(now, begins))
    if out:
        yield flush()


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one conversation after another, of sorted batches."""
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if rows and rows[0]["conv_id"] != r["conv_id"]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def chained(blocks: list[dict]) -> tuple[int, list[tuple[str, str]]]:
    """Least cost of a conversation, and of each block the symbol before it and its edits."""
    charts = [{(s, e): (c, a) for (s, e), c, a in zip(((s, e) for s in SYMBOLS for e in SYMBOLS), b["costs"], b["audits"]) if c is not None} for b in blocks]
    back: list[dict[str, str]] = []

    def edits(i: int, symbol: str, end: int) -> str:
        """Audit of blocks end..i that leads to symbol after block i."""
        out = []
        while i >= end:
            before = back[i][symbol]
            out.append(charts[i][before, symbol][1])
            symbol, i = before, i - 1
        return "".join(reversed(out))

    def less(i: int, p: str, q: str, symbol: str) -> bool:
        """Of two ways to symbol after block i with equal costs, over p or q before it: is the first one's audit less?"""
        a, b, at = p, q, i - 1
        while at >= 0 and a != b:
            a, b, at = back[at][a], back[at][b], at - 1
        return edits(i - 1, p, at + 1) + charts[i][p, symbol][1] < edits(i - 1, q, at + 1) + charts[i][q, symbol][1]

    best = {"Open": 0}
    for i, chart in enumerate(charts):
        new, come = {}, {}
        for (before, symbol), (cost, _) in chart.items():
            if before in best:
                total = best[before] + cost
                if symbol not in new or total < new[symbol] or total == new[symbol] and less(i, before, come[symbol], symbol):
                    new[symbol], come[symbol] = total, before
        best = new
        back.append(come)
    last = len(charts) - 1
    least = min(best[e] for e in ENDS)
    symbol = min((e for e in ENDS if best[e] == least), key=lambda e: edits(last, e, 0))
    out = []
    for i in range(last, -1, -1):
        before = back[i][symbol]
        out.append((before, charts[i][before, symbol][1]))
        symbol = before
    return least, out[::-1]


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _totals(blocks: list[dict], cost: int) -> dict:
    full = [b for b in blocks if b["n"]]
    turns = [b["turns"] for b in full if b["turns"]]
    gaps = turns[-1][1] - turns[0][0] + 1 - sum(t[2] for t in turns) + sum(a[1] == b[0] for a, b in zip(turns, turns[1:])) if turns else 0
    illegal = sum(b["n_illegal"] for b in full) + sum(a["initials"][1] + b["initials"][0] not in _LEGAL for a, b in zip(full, full[1:]))
    return {"gaps": gaps if gaps < 1 << 63 else None, "blank": sum(b["n_blank"] for b in full), "duplicate": sum(b["n_duplicate"] for b in full), "truncated": sum(b["n_truncated"] for b in full), "illegal": illegal, "cost": cost}


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its symbol and edits; the counts and the audit of the conversation stand at its last block."""
    out, kind, size = [], None, 0

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in batches:
            kind = b.schema.field("conv_id").type
            yield b

    def flush() -> pa.RecordBatch:
        shape = pa.schema([("conv_id", kind), ("part", pa.int32()), ("seq", pa.int64()), ("symbol", pa.string()), ("edits", pa.string()), ("audit", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
        return pa.RecordBatch.from_pylist(out, schema=shape)

    for blocks in _by_conversation(typed()):
        cost, found = chained(blocks)
        for b, (symbol, edits) in zip(blocks, found):
            out.append({"conv_id": b["conv_id"], "part": b["part"], "seq": b["seq"], "symbol": symbol, "edits": edits})
        out[-1] |= {"audit": "".join(e for _, e in found), **_totals(blocks, cost)}
        size += len(out[-1]["audit"]) + 100
        if size > 4 << 20:
            yield flush()
            out, size = [], 0
    if out:
        yield flush()


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the roles and texts that stay."""
    for b in batches:
        kept = [applied(s, e, list(zip(r, t))) for s, e, r, t in zip(*(b.column(c).to_pylist() for c in ("symbol", "edits", "roles", "texts")))]
        cells = {"roles": pa.array([[r for r, _ in k] for k in kept], pa.list_(pa.string())), "texts": pa.array([[t for _, t in k] for k in kept], pa.list_(pa.string()))}
        names = [c for c in b.schema.names if c not in ("symbol", "edits")]
        yield pa.record_batch([cells[c] if c in cells else b.column(c) for c in names], names=names)


def repaired(messages: DataFrame, gone: str | None = None, block: int = BLOCK) -> DataFrame:
    """Blocks of repaired conversations: conv_id, part, seq (their order), roles, texts; audit and counts at the last block of each.

    gone: a boolean column of rows that are not messages but only name their conversation. block: rows of a block.
    """
    spark = session(messages)
    small_batches(spark)
    t1, t2 = f"{OWN}t1", f"{OWN}t2"
    rows = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"))
    rows = rows.select("*", F.xxhash64("text").alias(t1), F.xxhash64(F.lit("text"), "text").alias(t2))
    # messages that come again at a later turn; copies within one turn are neighbours in the order below
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = rows.where("NOT gone").groupBy("conv_id", "role", t1, t2).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    again = again.select(F.col("conv_id").alias(f"{OWN}conv"), F.col("role").alias(f"{OWN}role"), F.col(t1).alias(f"{OWN}a1"), F.col(t2).alias(f"{OWN}a2"), "first")
    same = F.col("conv_id").eqNullSafe(F.col(f"{OWN}conv")) & (F.col("role") == F.col(f"{OWN}role")) & (F.col(t1) == F.col(f"{OWN}a1")) & (F.col(t2) == F.col(f"{OWN}a2"))
    rows = rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "gone", F.coalesce(place > F.col("first"), F.lit(False)).alias("later"), t1, t2)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", t1, t2]
    kind = dict(rows.dtypes)["conv_id"]
    counts = "n bigint, n_blank bigint, n_duplicate bigint, n_truncated bigint, n_illegal bigint"
    shape = f"conv_id {kind}, part int, seq bigint, {counts}, initials array<string>, turns array<bigint>, costs array<bigint>, audits array<string>, roles array<string>, texts array<string>"
    sorted_rows = rows.repartitionByRange(fan_out(spark), *order).sortWithinPartitions(*order)
    blocks = written(sorted_rows.mapInArrow(lambda batches: _blocks(batches, block), shape), "repair-blocks")
    found = blocks.drop("roles", "texts").repartition(fan_out(spark), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    found = found.mapInArrow(_chain, f"conv_id {kind}, part int, seq bigint, symbol string, edits string, audit string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    both = blocks.select("part", "seq", "roles", "texts").join(found, ["part", "seq"])
    names = ["conv_id", "part", "seq", "roles", "texts", "audit", *_COUNTS]
    return both.select(*names, "symbol", "edits").mapInArrow(_rewrite, f"conv_id {kind}, part int, seq bigint, roles array<string>, texts array<string>, audit string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def turns(blocks: DataFrame) -> DataFrame:
    """conv_id, part, seq, at, role, text: the messages of repaired conversations, in order of (part, seq, at)."""
    return blocks.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "m")).select("conv_id", "part", "seq", "at", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation: the digest of its lines, block by block."""
    digest, empty, now = hashlib.sha256(), True, object()
    for b in batches:
        sums, last = [], []
        for i, (conv, lines, end) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "lines", "cost")))):
            if conv != now:
                digest, empty, now = hashlib.sha256(), True, conv
            if lines is not None:
                digest.update(lines.encode() if empty else b"\n" + lines.encode())
                empty = False
            if end is not None:  # the last block
                sums.append(digest.hexdigest())
                last.append(i)
        kept = b.take(pa.array(last, pa.int64())).drop_columns(["lines"])
        yield pa.record_batch([*kept.columns, pa.array(sums, pa.string())], names=[*kept.schema.names, "repaired_sha256"])


def digests(messages: DataFrame, gone: str | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    blocks = repaired(messages, gone, block)
    lines = F.when(F.size("roles") > 0, F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")).alias("lines")
    rows = blocks.select("conv_id", "part", "seq", *_COUNTS, "audit", lines)
    kind = dict(rows.dtypes)["conv_id"]
    rows = rows.repartition(fan_out(session(messages)), "conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", *_COUNTS, "audit", "lines")
    return rows.mapInArrow(_hashed, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string")
