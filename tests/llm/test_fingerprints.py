import hashlib
import re
from collections import Counter

import xxhash

from tokenloom.llm.fingerprints import as_text, fingerprints, sketch


def mixed(*parts):
    """Spark's xxhash64 of strings, (long,) and int."""
    h = 42
    for x in parts:
        raw = x.encode() if isinstance(x, str) else (x[0] % 2**64).to_bytes(8, "little") if isinstance(x, tuple) else x.to_bytes(4, "little")
        h = xxhash.xxh64_intdigest(raw, h)
    return h


def order_min_hash(text, k=5, ell=2, step=1):
    """Order MinHash told plainly: each slot takes the ell first k-mers of its own order and hashes them in text order."""
    words = [(mixed(w),) for w in re.findall(r"[^ \t\n\x0b\f\r]+", text or "")]
    grams = [mixed(*words[i : i + k]) >> 24 for i in range(len(words) - k + 1)] if len(words) >= k else [mixed(*words) >> 24] if words else []
    seen, numbered = Counter(), []
    for i, g in enumerate(grams):
        numbered.append((mixed((g,), seen[g]) >> 24, i // step))
        seen[g] += 1
    out = []
    for slot in range(64):
        order = sorted((0, h, i, h) if h >> 34 == slot else (1, mixed((h,), (slot,)) >> 24, i, h) for h, i in numbered)
        chosen = sorted((i, (h if kind == 0 else r) & (1 << 34) - 1) for kind, r, i, h in order[:ell])
        out.append(f"{mixed(*((v,) for _, v in chosen)) >> 48:04x}" if chosen else "----")
    return "".join(out)


def test_fingerprints_by_brute_force(docs, rows, unique):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs).collect()}
    short = sorted(rows, key=lambda d: len(rows[d]["text"] or ""))[:60]
    assert all(got[d] == order_min_hash(rows[d]["text"]) for d in short)
    edge = {r["doc_id"]: r["fingerprint"] for r in fingerprints(unique).collect()}
    assert all(edge[r["doc_id"]] == order_min_hash(r["text"]) for r in unique.collect() if r["doc_id"] not in (6, 7))


def test_positions_of_long_texts_are_kept_in_steps(spark):
    words = " ".join(f"w{i} again" for i in range(100))
    df = sketch(spark.createDataFrame([(1, words)], "doc_id long, text string"), "text", "slots", pos_bits=6)
    assert df.select(as_text("slots").alias("f")).head()["f"] == order_min_hash(words, step=4)


def test_edited_texts_and_order(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    assert set(got) == set(rows)
    ids = sorted(rows, reverse=True)
    text = {d: rows[d]["text"] or "" for d in ids}
    by_text = {}
    for d, nxt in zip(ids, ids[1:] + ids[:1]):
        half = len(text[d]) // 2
        edited = text[d][: len(text[d]) - half] + text[nxt][:half]
        assert got[d]["n_chars"] == len(text[d])
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text[d], got[d]["fingerprint"]) == got[d]["fingerprint"]
        slots = lambda f: [f[i : i + 4] for i in range(0, len(f), 4)]
        for a, b, near in ((got[d]["fingerprint"], got[d]["edited_fingerprint"], "near_edited"), (got[d]["fingerprint"], got[nxt]["fingerprint"], "near_next")):
            pairs = list(zip(slots(a), slots(b)))
            some = [p for p in pairs if p != ("----", "----")]
            assert got[d][near] == (sum(x == y for x, y in some) / len(some) if some else 1.0)
    edited = sum(r["near_edited"] for r in got.values()) / len(got)
    other = sum(r["near_next"] for r in got.values()) / len(got)
    assert edited > 0.08 > 0.02 > other


def test_sensitive_to_order_and_repetition(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[200:] + words[:200]), " ".join(words[:100] * 4), " ".join(words[:100]), " ".join(words)]
    got = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["fingerprint"] == got[4]["fingerprint"]
    assert 0.3 < got[1]["near_next"] < 1.0  # a moved half keeps most k-mers but not their order
    assert got[3]["near_next"] < 0.9  # repeated k-mers count


def test_moved_half_of_short_texts(spark):
    """Mean likeness of texts and their swapped halves is that of independent permutations, by simulation."""
    import numpy as np

    rng, rounds = np.random.default_rng(5), 60
    for n in (20, 30, 60, 100):
        grams = lambda w: [tuple(w[i : i + 5]) for i in range(n - 4)]
        a, b = grams(list(range(n))), grams([*range(n // 2, n), *range(n // 2)])
        number = {g: i for i, g in enumerate({*a, *b})}
        a, b, same = np.array([number[g] for g in a]), np.array([number[g] for g in b]), 0
        for _ in range(4000):
            h = rng.random(len(number))
            x, y = (t[np.sort(np.argsort(h[t])[:2])] for t in (a, b))
            same += (x == y).all()
        want = same / 4000
        texts = []
        for r in range(rounds):
            words = [f"r{r}w{i}" for i in range(n)]
            texts += [(2 * r + 1, " ".join(words)), (2 * r, " ".join(words[n // 2 :] + words[: n // 2]))]
        got = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        assert abs(sum(got[2 * r + 1]["near_next"] for r in range(rounds)) / rounds - want) < 0.04
        assert not any("----" in r["fingerprint"] for r in got.values())


def test_edges(edges, empty, clashing):
    got = fingerprints(edges).collect()
    assert len(got) == edges.count()
    assert {len(r["fingerprint"]) for r in got} == {256}
    blank = [r for r in got if r["doc_id"] in (3, 4, 5)]
    assert {r["fingerprint"] for r in blank} == {"----" * 64} and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprints(empty).count() == 0
    assert fingerprints(clashing).count() == clashing.count()
    one = fingerprints(edges.where("doc_id = 6")).head()
    assert one["near_next"] == 1.0


def test_null_ids_come_last(spark):
    df = spark.createDataFrame([(None, "a b c"), (2, "d e"), (1, "f g h i")], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {2: sha("d " + "f"), 1: sha("f g " + "a b"), None: sha("a b" + "d ")}
