"""Repair against a plain search over all edit scripts, cheapest first."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import repair
from tokenloom.llm.queries import op13_repair

SHAPE = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out, convs = defaultdict(list), set()
    show = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        convs.add(conv)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return convs, out


def search(rows):
    """Cheapest, then least, edits of rows (initial, must go, truncated): a script is grown letter by letter, state by (rows read, roles' end)."""
    n, heap, done = len(rows), [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, said = heapq.heappop(heap)
        if at == n and said in ("", "a"):
            return cost, audit
        if (at, said) in done:
            continue
        done.add((at, said))
        can = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
        for c in can.replace("s", ""):
            heapq.heappush(heap, (cost + 2, audit + "I", at, c))
        if at < n:
            initial, must_go, cut = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, said))
            if not must_go:
                if initial and initial in can:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, initial))
                for c in can.replace("s", ""):
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, c))


def brute(rows):
    convs, by = damage(rows)
    out = {}
    for conv in convs:
        seen, flags, marks = set(), [], []
        mine = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        for _, role, text in mine:
            blank, again = not text.strip(SPACE), (role, text) in seen
            seen.add((role, text))
            cut = not blank and not again and text.rstrip(SPACE)[-1] not in ".!?"
            flags.append((blank, again and not blank, cut))
            marks.append((role[:1], blank or again, cut))
        cost, audit = search(marks)
        lines, at, said = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else mine[at][1:]
            at += e != "I"
            if e != "D":
                role = role if e == "K" else {"u": "assistant"}.get(said, "user")
                said = role[:1]
                lines.append(f"{role}:{text}")
        turns = {t for t, _, _ in mine if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f[k] for f in flags) for k in range(3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df, block=512):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.digests(repair.damaged(df), "gone", block).collect()}


def test_query_by_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    mine = op13_repair(spark, sf_dir).collect()
    assert len(mine) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in mine} == brute(rows)


def random_rows(seed, n, convs, width=6):
    r = random.Random(seed)
    rows, turn = [], defaultdict(int)
    for _ in range(n):
        c = r.randrange(convs)
        turn[c] += r.choice([1, 1, 2])
        role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
        rows.append((c, turn[c], role, r.choice([None, "", " \n", *(f"text {k}{e}" for k in range(width) for e in (".", "?", "", " !\n"))])))
    return rows


@pytest.mark.parametrize("block", [2, 512])
def test_random_conversations(spark, block):
    rows = random_rows(block, 500, 60) + [(900, t, *x[2:]) for t, x in enumerate(random_rows(7, 150, 1, 60))]
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert repair.repaired(repair.damaged(df), "gone", block).where("conv_id = 900").count() > 150 / block - 1
    assert got(df, block) == brute(rows)


def test_blocks_chain_to_the_whole():
    for seed in range(200):
        r = random.Random(seed)
        rows = [(r.choice("suaux"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(1, 14))]
        cuts = sorted(r.sample(range(len(rows) + 1), min(3, len(rows))))
        blocks = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            charts = {s: repair.parse(rows[a:b], s) for s in repair.SYMBOLS}
            flat = [charts[s].get(e) for s in repair.SYMBOLS for e in repair.SYMBOLS]
            blocks.append({"costs": [c and c[0] for c in flat], "audits": [c and c[1] for c in flat]})
        cost, parts = repair.chained(blocks)
        assert (cost, "".join(e for _, e in parts)) == search(rows)


def test_edges(spark):
    rows = [(None, 1, "user", "a."), (None, None, "assistant", "b."), (1, None, None, None), (1, None, "user", "x"), (2, -(1 << 62), "system", "s."), (2, 1 << 62, "user", "u."), (3, 5, "user", "long " * 300_000 + "end."), (3, 6, "assistant", "ok."), (3, 7, "user", "u."), (3, 8, "assistant", "ok.")]
    df = spark.createDataFrame(rows, SHAPE).withColumn("part", F.lit("clash")).withColumn("seq", F.lit("clash")).withColumn("gone", F.lit("clash"))
    assert got(df) == brute(rows)
    assert got(spark.createDataFrame([], SHAPE)) == {}
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert got(spark.createDataFrame([(dropped, 0, "user", "a.")], SHAPE)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repeated_rows_and_turns_of_messages(spark):
    df = spark.createDataFrame([(1, 1, "user", "hi."), (1, 1, "user", "hi."), (1, 2, "assistant", "yes."), (1, 9, "user", "hi."), (1, 10, "assistant", "so?")], SHAPE)
    blocks = repair.repaired(df)
    assert [(r["role"], r["text"]) for r in repair.turns(blocks).orderBy("part", "seq", "at").collect()] == [("user", "hi."), ("assistant", "yes."), ("user", ""), ("assistant", "so?")]
    assert [(r["audit"], r["duplicate"]) for r in blocks.where("audit IS NOT NULL").collect()] == [("KDKDIK", 2)]
