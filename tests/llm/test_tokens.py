import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm import encoding, packing, token_counts, token_files
from tokenloom.llm.common import scratch_path
from tokenloom.llm.encoding import ChunkEncoder
from tokenloom.llm.queries import tokenizer

BYTE, WORD, PIECE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_chunks_give_the_ids_of_whole_texts(name, rows, monkeypatch):
    own = ["", " ", "\n", "  a  b\n\n c", "Hello, I'm <|endoftext|> you'll   x   ok", "ΑΣΣΟΣ Σ.", "ñandú's 3rd 12,5%", "😀🙃 zażółć \t\tgęślą  ", "a\r\nb \x1cc \x85 d", "é ́x", "it's 's ''s dont'll", "x" * 3000, "(a)b[c]'d e'f"]
    own += ["<|startoftext|>a<|endoftext|>", "<|endoftext|>" * 3, " <|endoftext|> \n<|ENDOFTEXT|>", "a\0b \0", "ÀÉÖØÞß×÷Ã ÀB x÷y", "\u3000a b\u00a0c", "J\u030c K\u212a"]
    rng = random.Random(1)
    for letters in ("ab 'é\n.,1\t ß!“s×ÀZ -_<|", "abZ éÀ\n.,1\t !sÞ-$"):
        own += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts = own + [r["text"] for r in rows.values()]
    want = [[*e.ids, 7] for e in library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for held, stretch in ((50, 1 << 19), (500_000, 1 << 19), (50, 200)):  # a small cache forgets, small stretches cut texts
        monkeypatch.setattr(encoding, "STRETCH", stretch)
        ids, counts = ChunkEncoder(tokenizer(name), held).encode(texts, 7)
        assert [np.frombuffer(g, "<u2").tolist() for g in encoding.split(ids, counts.tolist())] == want
    assert [x.tolist() for x in ChunkEncoder(tokenizer(name)).encode([None, b"a"], 5)] == [[5, want_of(name, "a"), 5], [1, 2]]
    assert [x.tolist() for x in ChunkEncoder(tokenizer(name)).encode([None, "a"])] == [[want_of(name, "a")], [0, 1]]


def want_of(name, text):
    return library(name).encode(text, add_special_tokens=False).ids[0]


def test_the_cache_sweeps_what_was_met_once():
    enc = ChunkEncoder(tokenizer(BYTE), 1)
    often = [f"often{i} and{i}" for i in range(1000)]
    want = enc.encode(often)[0].tolist()
    for i in range(40):
        once = [" ".join(f"w{i}x{j}y{k}" for k in range(8)) for j in range(1000)]
        enc.encode(once)
        assert enc.encode(often)[0].tolist() == want
    assert enc._table.entries <= len(enc._table.at) and enc._table.entries > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=60))
def test_values_round_trip(values):
    v = np.array(values, dtype="<u4")
    control, data = token_files.encode_values(v)
    assert len(control) == -(-len(v) // 4) and len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in values)
    assert token_files.decode_values(control, data, len(v)).tolist() == values


def expected(rows, name, end):
    out, start = {}, 0
    for d in sorted(rows, key=lambda d: (d is not None, d)):
        ids = np.array(library_ids(name, rows[d]) + [end], dtype="<u4")
        out[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


_cache = {}


def library_ids(name, text):
    if name not in _cache:
        _cache[name] = library(name)
    return _cache[name].encode(text or "", add_special_tokens=False).ids


def test_files_hold_every_id_in_order(spark, docs, rows):
    path = scratch_path(spark, "files")
    token_files.write_token_files(docs, path, tokenizer(BYTE), block_ids=5000)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, path).collect()}
    assert got == expected({d: r["text"] for d, r in rows.items()}, BYTE, 0)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("part", "seq").collect()
    flat = [d for b in blocks for d in b["doc_ids"]]
    assert flat == sorted(rows) and len(blocks) > 20
    starts = [b["start"] for b in blocks]
    assert starts == sorted(starts)
    folders = spark.read.parquet(f"{path}/blocks").select("_metadata.file_path", "start").collect()
    by_folder = sorted((r["file_path"].rpartition("/")[0], r["start"]) for r in folders)
    assert [s for _, s in by_folder] == starts  # folders in order of their names hold ascending documents
    ranks = [r["n"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert ranks == sorted(ranks, reverse=True) and sum(ranks) == sum(x[1] for x in got.values())


def test_file_edges(unique, edges, empty, clashing):
    rt = lambda df: {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(df, tokenizer(BYTE)).collect()}
    want = expected({r["doc_id"]: r["text"] for r in unique.collect()}, BYTE, 0)
    assert rt(unique) == want == rt(clashing)
    assert token_files.round_trip(edges, tokenizer(BYTE)).count() == edges.count()
    assert rt(empty) == {}


def test_null_id_comes_first(spark):
    df = spark.createDataFrame([(2, "b b"), (None, "n"), (1, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(df, tokenizer(BYTE)).collect()}
    assert got == expected({None: "n", 1: None, 2: "b b"}, BYTE, 0)


def test_an_id_that_fills_many_ranges_is_spread(spark):
    rows = [(None, f"no id {i}") for i in range(200)] + [(5, f"five {i}") for i in range(300)] + [(i, f"own {i}") for i in range(100) if i != 5]
    path = scratch_path(spark, "files")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, tokenizer(BYTE))
    assert spark.read.parquet(f"{path}/blocks").where("array_contains(doc_ids, 5L)").select("part").distinct().count() == 2
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_token_files(spark, path).collect())
    ids = [d for _, d, _ in got]
    assert ids == [None] * 200 + list(range(5)) + [5] * 300 + list(range(6, 100))
    assert [s for s, _, _ in got] == [sum(n for _, _, n in got[:i]) for i in range(len(got))]


def brute_pieces(vocabulary, word, mark=token_counts.MARK):
    s, i, n, most = mark + word, 0, 0, max(map(len, vocabulary))
    while i < len(s):
        j = next((j for j in range(min(len(s), i + most), i, -1) if s[i:j] in vocabulary), None)
        if j is None:
            return 0
        n, i = n + 1, j
    return n


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("ab▁", min_size=1, max_size=5), min_size=1, max_size=10), st.lists(st.text("ab", max_size=12), max_size=6))
def test_automaton_equals_greedy_matching(vocabulary, words):
    counter = token_counts.PieceCounter(sorted(vocabulary))
    assert [counter.count(w) for w in words] == [brute_pieces(vocabulary, w) for w in words]


def test_counts_of_documents(docs, rows, edges, empty, clashing):
    pieces = token_counts.vocabulary(tokenizer(PIECE))
    known, seen = set(pieces), {}
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, tokenizer(PIECE)).collect()}
    for d in sorted(rows)[:60]:
        counts = [seen.setdefault(w, brute_pieces(known, w)) for w in rows[d]["text"].split()]
        assert (got[d]["n_words"], got[d]["n_tokens"], got[d]["n_unknown"]) == (len(counts), sum(counts) + counts.count(0), counts.count(0))
    assert len(got) == len(rows)
    blank = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(edges, tokenizer(PIECE)).collect()}
    assert blank[3] == blank[4] == blank[5] == 0 and len(blank) == 13
    assert token_counts.token_counts(empty, tokenizer(PIECE)).count() == 0
    assert token_counts.token_counts(clashing, tokenizer(PIECE)).count() == clashing.count()


def check_packing(pieces, texts, length=4096):
    """texts: doc_id to texts of its rows."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(texts)
    for d, (text, copies) in texts.items():
        ids = np.array(library_ids(WORD, text) + [2], dtype="<u4")
        cover = np.zeros(len(ids), dtype=int)
        for p in by_doc[d]:
            cover[p["start"] : p["start"] + p["length"]] += 1
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        assert (cover == copies).all()
    last = max(by_sequence)
    assert set(by_sequence) == set(range(last + 1))
    for s, spans in by_sequence.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at == length if s < last else at <= length


def round_robin(queues, quanta, stretch):
    """Deficit round-robin as it is told: queues of (document, tokens), quanta in 1 / UNIT tokens; the (document, start, tokens) given in a row."""
    left = {q: [(d, s, min(stretch, n - s)) for d, n in docs for s in range(0, n, stretch)] for q, docs in queues.items()}
    deficit, out = dict.fromkeys(queues, 0), []
    while any(left.values()):
        for q in sorted(left, key=str.encode):
            if left[q]:
                deficit[q] += quanta[q]
                while left[q] and left[q][0][2] * packing.UNIT <= deficit[q]:
                    deficit[q] -= left[q][0][2] * packing.UNIT
                    out.append(left[q].pop(0))
    return out


def windows(stream, length):
    """doc, start, length, sequence_id, offset of the pieces of a stream."""
    out, at = [], 0
    for d, s, n in stream:
        while n:
            k = min(n, length - at % length)
            if out and out[-1][0] == d and out[-1][1] + out[-1][2] == s and out[-1][3] == at // length:
                out[-1][2] += k
            else:
                out.append([d, s, k, at // length, at % length])
            d, s, n, at = d, s + k, n - k, at + k
    return out


def own_shares(sizes, alpha, length):
    w = {q: float(n) ** alpha for q, n in sizes.items()}
    return {q: max(1, round(w[q] / sum(w.values()) * length * packing.UNIT)) for q in w}


@pytest.mark.parametrize("alpha, length, stretch", [(1.0, 512, 64), (0.5, 128, 32), (0.7, 4096, 512)])
def test_packing_is_deficit_round_robin(spark, docs, rows, alpha, length, stretch):
    one = docs.orderBy("doc_id").coalesce(1)  # one task: queues in order of doc_id
    got = [[p["doc_id"], p["start"], p["length"], p["sequence_id"], p["offset"]] for p in packing.packed(one, tokenizer(WORD), length, alpha=alpha, stretch=stretch).collect()]
    queues, sizes = defaultdict(list), defaultdict(int)
    for d in sorted(rows):
        n = len(library_ids(WORD, rows[d]["text"])) + 1
        queues[f"={rows[d]['source']}"].append((d, n))
        sizes[f"={rows[d]['source']}"] += n
    want = windows(round_robin(queues, own_shares(sizes, alpha, length), stretch), length)
    assert sorted(got, key=lambda p: (p[3], p[4])) == want


def test_targets_hold_in_every_window_while_sources_last(docs, rows):
    pieces = packing.packed(docs, tokenizer(WORD), targets={"src0": 3.0, "src3": 1.0, "absent": 2.0, "src5": 0.0}, length=512, stretch=64).collect()
    check_packing(pieces, {d: (r["text"], 1) for d, r in rows.items()}, 512)
    size = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        size[p["sequence_id"]][rows[p["doc_id"]]["source"]] += p["length"]
    total = defaultdict(int)
    for s in sorted(size):
        if set(size[s]) != {"src0", "src3"}:
            break
        for q in size[s]:
            total[q] += size[s][q]
        assert abs(total["src0"] - 3 * total["src3"]) < 4 * (64 + 512)
    assert s > 3
    after = [s for s in size if not {"src0", "src3"} & set(size[s])]
    assert after and all(size[s] for s in after)


def test_rare_sources_come_in_whole_stretches(spark):
    """Three rare sources beside a large one: their documents are not cut to single tokens."""
    rows = [(i, "rare words of a small text in few tokens", f"rare{i % 3}") for i in range(300)] + [(1000 + i, f"large text {i} " * 400, "large") for i in range(300)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string"), tokenizer(WORD)).collect()
    check_packing(pieces, {d: (t, 1) for d, t, _ in rows})
    small = [p["doc_id"] for p in pieces if p["doc_id"] < 1000]
    assert len(small) < 310  # but for those that a window's end cuts


def test_packing_of_documents(docs, rows):
    pieces = packing.packed(docs, tokenizer(WORD)).collect()
    check_packing(pieces, {d: (r["text"], 1) for d, r in rows.items()})
    total, upto, share = sum(p["length"] for p in pieces), defaultdict(int), defaultdict(int)
    for p in pieces:
        share[rows[p["doc_id"]]["source"]] += p["length"]
    done = 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):  # at every place of the stream
        upto[rows[p["doc_id"]]["source"]] += p["length"]
        done += p["length"]
        assert all(abs(upto[q] - done * share[q] / total) < 4096 + 512 * len(share) for q in share)


def test_packing_edges(edges, unique, empty, clashing, spark):
    texts = {r["doc_id"]: (r["text"], 1) for r in unique.collect()}
    check_packing(packing.packed(unique, tokenizer(WORD)).collect(), texts)
    check_packing(packing.packed(clashing, tokenizer(WORD)).collect(), texts)
    check_packing(packing.packed(edges, tokenizer(WORD)).collect(), {d: (t, 2 if d == 1 else 1) for d, (t, _) in texts.items()})
    assert packing.packed(empty, tokenizer(WORD)).count() == 0
    nameless = spark.createDataFrame([(None, "no id", "a"), (None, None, None), (3, "an id", "a")], "doc_id long, text string, source string")
    pieces = packing.packed(nameless, tokenizer(WORD)).collect()
    assert sorted((p["doc_id"] or 0, p["length"]) for p in pieces) == [(0, 1), (0, 3), (3, 3)]


def test_packing_of_many_sources(spark):
    """Sources are rows of tables: any number of them, with a shuffle where the table is not broadcast."""
    rows = [(i, f"text {i} " * (1 + i * 7 % 23), None if i % 41 == 0 else f"s{i % 41}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3, "doc_id")
    run = lambda targets: sorted(tuple(p) for p in packing.packed(df, tokenizer(WORD), length=128, targets=targets).collect())
    for targets in (None, {"s7": 3.0, None: 1.0, "absent": 2.0, "s9": 0.0}):
        want = run(targets)
        check_packing([dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), p)) for p in want], {i: (t, 1) for i, t, _ in rows}, 128)
        most, packing.BROADCAST_ROWS = packing.BROADCAST_ROWS, 1
        try:
            assert run(targets) == want
        finally:
            packing.BROADCAST_ROWS = most


WIDE = ["\u00a0", "\u3000", "\u2009", "\u0085", "\u2028"]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_wide_spaces_and_long_chunks_equal_the_library(name, monkeypatch):
    tok, mine, r = library(name), ChunkEncoder(tokenizer(name), held=2000), random.Random(5)
    monkeypatch.setattr(encoding, "LONG_BYTES", 2000)
    parts = [*WIDE, " ", "  ", "\n", "\t", "word", "Été", "it's", "12", "漢字" * 90, "ж" * 20, "x" * 40, "...", "é" * 200]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(600)]
    texts += ["", None, *WIDE, "\u00a0 ", " \u00a0", "a\u00a0", "\u00a0a", "a \u00a0 b", "a\u00a0 \u3000b", "字" * 5000]
    for at in range(0, len(texts), 20):
        some = texts[at : at + 20]
        ids, counts = mine.encode(some, 7)
        want = [[*tok.encode(t or "", add_special_tokens=False).ids, 7] for t in some]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert mine._table.long_bytes <= 2000 + sum(len((t or "").encode()) for t in some) and all(len(c) <= encoding.LONG_CHUNK for c in mine._table.long)


def test_texts_without_white_space_leave_no_keys():
    mine = ChunkEncoder(tokenizer(BYTE), held=2000)
    for k in range(12):
        mine.encode(["".join(chr(0x4E00 + (i * 7919 + k * 31) % 20_000) for i in range(40_000))])
    assert mine._table.long_bytes == 0 and mine._table.filled < 1000 and len(mine._table.pool) <= 1 << 23


@pytest.mark.parametrize("shares", [[1] * 20, [10, 6, 3, 1]], ids=["twenty", "steep"])
def test_every_window_holds_the_targets(spark, shares):
    """As long as no source has run dry: a quantum and two stretches at most from the target, whatever the documents' lengths."""
    r = random.Random(len(shares))
    rows = []
    for s, w in enumerate(shares):
        left = 60_000 * w // max(shares)
        while left > 0:
            n = r.choice([3, 30, 200, 700, 5000])
            rows.append((len(rows), "word " * n, f"s{s:02}"))
            left -= n
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    source, tokens = {i: s for i, _, s in rows}, defaultdict(int)
    windows = defaultdict(lambda: defaultdict(int))
    for p in packing.packed(docs, tokenizer(WORD), targets={f"s{s:02}": float(w) for s, w in enumerate(shares)}).collect():
        windows[p["sequence_id"]][source[p["doc_id"]]] += p["length"]
        tokens[source[p["doc_id"]]] += p["length"]
    rest, seen = dict(tokens), 0
    for w in sorted(windows):
        if any(rest[f"s{s:02}"] < 4 * 4096 * share / sum(shares) for s, share in enumerate(shares)):
            break
        for s, share in enumerate(shares):
            target = 4096 * share / sum(shares)
            quantum = target / packing.ROUNDS
            stretch = min(packing.STRETCH, max(packing.LEAST_STRETCH, quantum))
            assert abs(windows[w][f"s{s:02}"] - target) <= quantum + 2 * stretch
            rest[f"s{s:02}"] -= windows[w][f"s{s:02}"]
        seen += 1
    assert seen > 8
