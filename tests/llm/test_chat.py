import random
import re
from collections import Counter

import pytest

from tokenloom.llm import chat
from tokenloom.llm.queries import table

ROWS = [
    (1, 0, "user", "Hello there\nHow do I sort?"), (1, 1, "assistant", "Use sorted().\nOr list.sort()."), (1, 2, "user", "On Monday A wrote:\n> How do I sort?\nI meant fast sort."),
    (1, 3, "assistant", "> use  SORTED().\n>> hello there\nok thanks"), (1, 4, "user", "fine"), (2, 0, "user", None), (2, 1, "x", "> nothing known\nbody"), (None, 0, "u", "a"), (3, 5, None, "> > a\n> b\nc"), (4, None, "u", "q"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(line):
    return re.sub(r"\s+", " ", line).strip(" ").lower()


def brute(rows):
    """doc key to (parent, position, n_quoted, n_linked) for unique turns."""
    out = {}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, {})[t] = text or ""
    for c, turns in convs.items():
        order, own, parent, branch = sorted(turns), {}, {}, {}
        counts = {}
        for i, t in enumerate(order):
            lines = turns[t].split("\n")
            level = [len(re.match(r"^(?:[ \t]*>)*", x).group().replace(" ", "").replace("\t", "")) for x in lines]
            keep = [(lv, re.sub(r"^(?:[ \t]*>)+ ?", "", x)) for k, (lv, x) in enumerate(zip(level, lines)) if not (lv == 0 and re.search(r"(?i)\bwrote:\s*$", x) and k + 1 < len(lines) and level[k + 1] > 0)]
            quoted = [(lv, plain(b)) for lv, b in keep if lv and plain(b)]
            find = lambda b: max((u for u in order[:i] if b in own[u]), default=None)  # noqa: B023, E731
            hits = [(lv, find(b)) for lv, b in quoted]
            votes = Counter(u for lv, u in hits if u is not None and lv == min(x for x, _ in quoted)) if quoted else Counter()
            target = max(votes, key=lambda u: (votes[u], u)) if votes else None
            prev = order[i - 1] if i else None
            parent[t] = target if target is not None else prev
            branch[t] = i == 0 or (target is not None and target != prev)
            own[t] = {plain(b) for lv, b in keep if not lv and plain(b)}
            counts[t] = (len(quoted), sum(u is not None for _, u in hits))
        kids = {t: [] for t in order}
        for t in order[1:]:
            kids[parent[t]].append(t)
        seq = []

        def walk(t):
            seq.append(t)
            for k in sorted(kids[t]):  # noqa: B023
                walk(k)

        walk(order[0])
        for t in order:
            out[c, t] = (parent[t], seq.index(t), *counts[t])
    return out


def result(df):
    return {(r["conv_id"], r["turn"]): (r["parent_turn"], r["position"], r["n_quoted"], r["n_linked"]) for r in chat.threaded(df).collect()}


def test_messages_and_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["conv_id"], r["turn"]): r for r in chat.formatted(df).collect()}
    assert got[1, 3]["message"] == "<|assistant|>\nok thanks\n<|end|>\n" and got[1, 2]["message"] == "<|user|>\nI meant fast sort.\n<|end|>\n"
    assert got[2, 0]["message"] == "<|user|>\n\n<|end|>\n" and got[3, 5]["message"].startswith("<|unknown|>")
    assert got[None, 0]["position"] is None and got[4, None]["position"] is None and len(got) == len(ROWS)
    want = brute([r for r in ROWS if r[0] is not None and r[1] is not None])
    assert {k: v for k, v in result(df).items() if k in want} == want
    assert chat.formatted(df.limit(0)).count() == 0
    assert chat.formatted(spark.createDataFrame([*ROWS, ROWS[0]], SCHEMA)).count() == len(ROWS) + 1
    extra = df.selectExpr("*", "'c' AS lines", "'c' AS run", "'c' AS previous", "'c' AS path", "'c' AS level", "'c' AS message", "'c' AS starts", "'c' AS rank", "'c' AS n_quoted")
    assert {tuple(r) for r in chat.formatted(extra).collect()} == {tuple(r) for r in chat.formatted(df).collect()}


@pytest.mark.parametrize("block", [3, 4096])
def test_random_threads_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng, rows = random.Random(5), []
    for c in range(12):
        said = []
        for t in range(rng.randint(1, 14)):
            turn, lines = 2 * t + 1, []
            for _ in range(rng.randint(0, 2)):
                if said:
                    lines.append(rng.choice(["> ", ">", ">> ", "> > "]) + rng.choice(said).upper())
            mine = [f"line {rng.randint(0, 30)} of text" for _ in range(rng.randint(1, 2))]
            rows.append((c, turn, "user", "\n".join(lines + mine)))
            said += mine
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == brute(rows)


def test_wrapped_quotes_find_their_sentences(spark):
    said = "I tried the first way. It was slow, so\nthe second one (shown below) may be better!\nWhat do you think?"
    rows = [
        (1, 0, "user", said), (1, 1, "assistant", "Yes."), (1, 2, "user", "Thank you."),
        (1, 3, "assistant", "A wrote:\n> It was slow, so the second\n> one (shown below)\n> may be better!\nI agree."),
        (1, 4, "user", "> Yes. But nobody\n> said this here\nwell"), (1, 5, "user", "> what do you\n> think? I TRIED the\n> first way.\n> Thank you.\nno"),
    ]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got[1, 3] == (0, 4, 3, 3)
    assert got[1, 4] == (1, 3, 2, 1)  # its first line holds a sentence of turn 1
    assert got[1, 5] == (0, 5, 4, 4)
    lines = [(0, "a b. c"), (0, "d"), (0, ""), (1, "x."), (1, "y z")]
    assert list(chat.passages(lines)) == [(0, 0, "a b. c", True), (1, 0, "d", True), (0, 0, "a b.", False), (0, 0, "c d", False), (3, 1, "x.", True), (4, 1, "y z", True)]


@pytest.mark.parametrize("block", [3, 4096])
def test_deep_and_wide_branches(spark, block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = [(1, 0, "user", "root"), (1, 1, "user", "next")]
    for t in range(2, 40):  # each turn but those after odd ones quotes the turn two before: a deep chain
        rows.append((1, t, "user", (f"> {rows[t - 2][3].splitlines()[-1]}\n" if t % 3 else "") + f"said {t}"))
    for t in range(40):  # all quote the first message, or the second
        rows.append((2, t, "user", (f"> word {t % 2}\n" if t > 2 else "") + f"word {t}"))
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_whole_table(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    assert result(df) == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])
