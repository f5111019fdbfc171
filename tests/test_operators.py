"""Properties and edge cases of the library's own operators."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import dense
from tokenloom.functions import text as text_functions
from tokenloom.functions import tensor as T
from tokenloom.functions.text import PRETOKEN, merge_pair, pretokens, special_split
from tokenloom.operators import attention, bpe, optim, sampling, training, verify, windows
from tokenloom.operators.bpe import Tokenizer, _incremental
from tokenloom.sources import files, state, vocab
from tokenloom.sources.scratch import scratch_path

SAMPLES = ["", "s", "🙃", "Hello, how are you?", "Héllò hôw are ü? 🙃", "a\n\n\nb  c\t d", "it's we'll 12 x3", "  lead", "tail \n"]


def naive_train(words, counts, merges):
    words, out = [list(w) for w in words], []
    for _ in range(merges):
        pairs = {}
        for w, n in zip(words, counts):
            for p in zip(w, w[1:]):
                pairs[p] = pairs.get(p, 0) + n
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        out.append((*best, pairs[best]))
        for k, w in enumerate(words):
            new = []
            for t in w:
                if new and (new[-1], t) == best:
                    new[-1] += t
                else:
                    new.append(t)
            words[k] = new
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=8), st.integers(1, 5)), min_size=1, max_size=8), st.integers(0, 8))
def test_indexed_training_equals_recounting(pairs, merges):
    words = [[f"{ord(c):02X}" for c in w] for w, _ in pairs]
    counts = [n for _, n in pairs]
    assert _incremental([list(w) for w in words], counts, merges) == naive_train(words, counts, merges)


def test_rounds_equal_indexed(spark):
    docs = spark.createDataFrame([(1, "low lower lowest low"), (2, None), (3, ""), (4, "new newer <|x|> wide")], "doc_id long, text string")
    words = bpe.word_tokens(bpe.pretoken_counts(docs, ["<|x|>"]))
    assert [tuple(r)[1:] for r in bpe.train(docs, 6, ["<|x|>"]).orderBy("rank").collect()] == bpe.train_rounds(words, 6)
    assert bpe.train(docs, 6, ["<|x|>"], one_task_words=0).count() == 6
    assert bpe.pretoken_counts(docs, ["<|x|>"]).where("word LIKE '%|%'").count() == 0


def test_training_stops_without_pairs(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    assert bpe.train(docs, 50).count() == len(bpe.train_rounds(bpe.word_tokens(bpe.pretoken_counts(docs)), 50)) == 1
    assert bpe.train(docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        bpe.vocabulary(bpe.train(docs, 1), ["<|x|>"], 200)


def test_overlapping_merge(spark):
    df = spark.sql("SELECT array('61','61','61') AS t")
    assert df.select(merge_pair(F.col("t"), F.lit("61"), F.lit("61")).alias("m")).head()["m"] == ["6161", "61"]


def test_pretokens_are_lossless_and_equal_python(spark):
    import regex

    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    for r in df.select("s", pretokens(F.col("s")).alias("p")).collect():
        assert "".join(r["p"]) == r["s"] and [x for x in r["p"] if x] == regex.findall(PRETOKEN, r["s"])


def test_special_split(spark):
    df = spark.createDataFrame([("ab<|e|><|e|>c<|e|>",), ("",), ("<|e|>",)], "s string")
    got = [[tuple(x) for x in r["p"]] for r in df.select(special_split(F.col("s"), ["<|e|>", "<|e|><|e|>"]).alias("p")).collect()]
    assert got == [[("ab", False), ("<|e|><|e|>", True), ("c", False), ("<|e|>", True)], [], [("<|e|>", True)]]
    assert df.select(special_split(F.col("s"), []).alias("p")).collect()[1]["p"][0]["piece"] == ""


@pytest.fixture(scope="module")
def tok(spark):
    docs = spark.createDataFrame([(1, "hello hello how are you hello you 🙃🙃")], "doc_id long, text string")
    merges = bpe.train(docs, 12)
    return Tokenizer.of(bpe.vocabulary(merges, ["<|e|>"]), merges, ["<|e|>"])


def test_round_trip(spark, tok):
    texts = SAMPLES + ["x<|e|><|e|>y 🙃<|e|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = bpe.encode(df, tok).select("doc_id", bpe.decode(F.col("ids"), tok.vocab).alias("t")).orderBy("doc_id").collect()
    assert [r["t"] for r in out] == texts


def test_decode_of_broken_and_unknown(spark, tok):
    df = spark.createDataFrame([([1 + 0xE2, 1 + 0x82],)], "ids array<int>")
    assert df.select(bpe.decode(F.col("ids"), tok.vocab).alias("t")).head()["t"] == bytes([0xE2, 0x82]).decode("utf-8", "replace")
    with pytest.raises(Exception, match="unknown token id"):
        spark.createDataFrame([([99999],)], "ids array<int>").select(bpe.decode(F.col("ids"), tok.vocab)).collect()


def test_encoding_keeps_columns_and_holds_few_rows(spark, tok, monkeypatch):
    """Ids pass through workers as flat integers, a few rows at a time; once a batch's lists of ids were held as a whole."""
    texts = [*SAMPLES, "", "hello<|e|>you" * 40]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = bpe.encode(df, tok, keep=["text"]).select("doc_id", "text", bpe.decode(F.col("ids"), tok.vocab).alias("t"), "ids").collect()
    assert len(out) == len(texts) and all(r["t"] == r["text"] for r in out)
    n = Counter(i for r in out for i in r["ids"])
    assert {r["token_id"]: r["n"] for r in bpe.token_parts(df, tok).groupBy("token_id").agg(F.sum("n").alias("n")).collect()} == n
    monkeypatch.setattr(bpe, "HELD_BYTES", 8)
    parts = list(bpe.coded(df.toArrow().to_batches(), tok))
    assert len(parts) > 3 and sum(b.num_rows for b, _ in parts) == len(texts) == sum(len(r) for _, r in parts)


def test_null_text_encodes_to_nothing(spark, tok):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["ids"] for r in bpe.encode(df, tok).collect()] == [[], []]


def test_windows(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, [1, 2]), (3, [])], "doc_id long, ids array<int>")
    w = windows.windows(df, 4).collect()
    assert len(w) == 6 and all(r["y"] == [x + 1 for x in r["x"]] for r in w)
    assert windows.batch(df, 4, 5).count() == 5


def test_softmax_does_not_move_with_a_shift(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 1000.0, -1000.0],)], "x array<double>")
    a = df.select(T.softmax(F.col("x")).alias("p")).collect()
    b = df.select(T.softmax(F.transform("x", lambda v: v + 50.0)).alias("p")).collect()
    np.testing.assert_allclose([r["p"] for r in a], [r["p"] for r in b], atol=1e-12)


def test_both_rope_layouts_give_equal_products(spark):
    df = spark.createDataFrame([([0.1 * i for i in range(8)], [0.3 - 0.05 * i for i in range(8)])], "x array<double>, y array<double>")
    for halves in (False, True):
        got = df.select(T.dot(T.rope(F.col("x"), F.lit(5), halves=halves), T.rope(F.col("y"), F.lit(2), halves=halves)).alias("d")).head()["d"]
        x, y = (np.array(df.head()[c])[None] for c in ("x", "y"))
        want = float((dense.rope(x, np.array([5])) * dense.rope(y, np.array([2]))).sum())
        assert got == pytest.approx(want, abs=1e-12)


def test_tiled_attention_equals_plain(spark):
    rng = np.random.default_rng(0)
    q, k, v = (spark.createDataFrame([(0, 0, p, rng.normal(size=4).tolist()) for p in range(6)], "b long, h int, p long, x array<double>") for _ in range(3))
    keys = ["b", "h", "p", "k"]
    for causal in (False, True):
        plain = attention.attend(attention.scores(q, k, causal), v)
        for tile in (1, 2, 6, 9):
            assert verify.not_close(attention.tiled(q, k, v, tile, causal)[0], plain, keys).count() == 0


def test_ffn_width():
    assert T.ffn_width(64) == 192 and T.ffn_width(64, ablation=True) == 256


def test_block_options():
    x = np.ones((2, 4))
    w = {n: np.eye(4) for n in ("q", "k", "v", "o", "w1", "w2", "w3")} | {"ln1": np.ones(4), "ln2": np.ones(4)}
    for bad in ({"norm": "middle"}, {"ffn": "relu"}):
        with pytest.raises(ValueError):
            dense.block(x, w, 2, **bad)
    # a position never sees later ones
    y = dense.block(np.array([[1.0, 2, 3, 4], [4, 3, 2, 1]]), w, 2)
    np.testing.assert_allclose(y[0], dense.block(np.array([[1.0, 2, 3, 4]]), w, 2)[0])


def test_schedule_values(spark):
    got = [r["lr"] for r in spark.range(25).select(optim.cosine_lr(F.col("id"), 1.0, 0.1, 7, 21).alias("lr")).collect()]
    assert got[0] == 0 and got[7] == 1 and got[21] == pytest.approx(0.1) and got[24] == 0.1 and got[14] == pytest.approx(0.55)
    assert spark.range(1).select(optim.cosine_lr(F.lit(7), 1.0, 0.1, 7, 7).alias("lr")).head()["lr"] == 1.0


def test_adamw_arguments():
    for bad in ({"lr": -1}, {"eps": -1}, {"decay": -1}, {"betas": (1.0, 0.9)}):
        with pytest.raises(ValueError):
            optim.check_adamw(**{"lr": 0.1, "betas": (0.9, 0.9), "eps": 0.1, "decay": 0.1} | bad)


def test_clip_without_gradients(spark):
    empty = spark.createDataFrame([], "name string, i int, j int, v double")
    assert optim.clip(empty, 1.0).count() == 0


def test_gather_rejects_differing_replicas(spark):
    rows = spark.createDataFrame([("g", 0, 0, 1.0, 0), ("g", 0, 0, 2.0, 1)], "name string, i int, j int, v double, shard int")
    with pytest.raises(Exception, match="replicas differ"):
        optim.gathered(rows).collect()


def test_top_p_keeps_the_first_and_drops_the_crossing_token(spark):
    rows = spark.createDataFrame([(0, t, p) for t, p in enumerate([0.5, 0.3, 0.2])] + [(1, 0, 0.9), (1, 1, 0.1)], "b int, token int, p double")
    got = {(r["b"], r["token"]): r["p"] for r in sampling.top_p(rows, 0.7).collect()}
    assert got == {(0, 0): 1.0, (1, 0): 1.0}


def test_top_k_keeps_ties(spark):
    rows = spark.createDataFrame([(0, t, v) for t, v in enumerate([1.0, 3.0, 2.0, 2.0])], "b int, token int, logit double")
    assert {r["token"] for r in sampling.top_k(rows, 2).collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        sampling.temperature(rows, 0)


def test_generation_with_a_model():
    from tokenloom.plans.tensor_queries import HEADS, VOCAB, lm_weights

    w = lm_weights()
    out = sampling.generate_lm(w, HEADS, [1, 2, 3], 5, context=4, uniforms=lambda s: 0.0, k=1)
    assert len(out) == 8 and out[3] == int(dense.language_model(np.array([1, 2, 3]), w, HEADS)[-1].argmax()) and max(out) < VOCAB
    end = out[3]
    assert sampling.generate_lm(w, HEADS, [1, 2, 3], 5, 4, lambda s: 0.0, k=1, end=end) == [1, 2, 3, end]
    assert sampling.generate_lm(w, HEADS, [1, 2, 3], 5, 4, lambda s: 0.0, k=1, end=end, keep_end=False, return_prompt=False) == []


def test_generation_queries_equal_a_plain_loop(spark, sf_dir):
    from tokenloom.plans import registry
    from tokenloom.plans.tensor_queries import HEADS, VOCAB, lm_weights

    w = lm_weights()
    for name, t, p, k, keep, whole in (("lm_generate_topp", 0.8, 0.9, None, True, True), ("lm_generate_topk", 0.8, None, 5, False, False)):
        rows = {r["b"]: r["ids"] for r in registry.QUERIES[name](spark, sf_dir).collect()}
        assert len(rows) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
        for b in list(rows)[:40]:
            ids = [(b * 7 + i * 11) % VOCAB for i in range(4)]
            for step in range(4):
                z = dense.language_model(np.array(ids[-6:]), w, HEADS)[-1] / t
                prob = np.exp(z - z.max())
                prob /= prob.sum()
                order = sorted(range(VOCAB), key=lambda i: (-prob[i], i))
                if k is not None:
                    chosen = {i for i in order if z[i] >= z[order[k - 1]]}
                else:
                    cum, chosen = 0.0, {order[0]}
                    for i in order:
                        cum += prob[i]
                        if cum <= p:
                            chosen.add(i)
                total, cum, u = sum(prob[i] for i in chosen), 0.0, ((b * 7919 + step * 104729 + 13) % 1000) / 1000.0
                for i in sorted(chosen):
                    cum += prob[i] / total
                    if cum > u:
                        break
                if i != 7 or keep:
                    ids.append(i)
                if i == 7:
                    break
            assert rows[b] == ",".join(map(str, ids if whole else ids[4:]))


def test_half_precision_equals_the_hardware_type(spark):
    rng = np.random.default_rng(0)
    values = [*(rng.normal(size=300) * 10.0 ** rng.integers(-9, 5, size=300)), 0.0, -0.0, 1.0, 2048.5, 2049.0, 65504.0, 65519.0, 65520.0, -7e4, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 6.1e-5]
    got = [r["h"] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(T.half(F.col("v")).alias("h")).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(v) for v in np.array(values).astype(np.float16)]


def test_a_decoder_reads_each_id_once():
    from tokenloom.plans.tensor_queries import HEADS, lm_weights

    w, ids = lm_weights(), [3, 1, 4, 1, 5, 9, 2, 6]
    model = dense.Decoder(w, HEADS)
    for parts in ([1] * 8, [4, 1, 3], [8]):
        model.forget()
        at = 0
        for n in parts:
            got = model.read(np.array(ids[at : at + n]))
            at += n
            np.testing.assert_allclose(got, dense.language_model(np.array(ids[:at]), w, HEADS)[-1], atol=1e-12)
            assert all(k.shape[1] == v.shape[1] == at for k, v in model.kept)


def test_independent_pairs_stop_where_merges_meet():
    top = [("61", "62", 9), ("63", "64", 8), ("62", "65", 7), ("66", "67", 6), ("66", "68", 5)]
    assert bpe.independent(top, set(), True) == top[:2]  # (62, 65) begins with the end of (61, 62)
    assert bpe.independent([*top[:2], *top[3:]], set(), False) == [*top[:2], top[3]]  # ties of the last count may go on
    assert bpe.independent(top[:2], {"6162"}, True) == top[:1]  # another merge makes that token too
    assert bpe.independent([("61", "61", 3), ("62", "61", 2)], set(), True) == [("61", "61", 3)]
    assert bpe.independent([("61", "62", 3), ("63", "64", 3), ("65", "61", 3)], set(), True) == [("61", "62", 3)]


def test_batched_rounds_equal_the_index(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(40)) for _ in range(20)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = bpe.word_tokens(bpe.pretoken_counts(docs))
    want = [tuple(r)[1:] for r in bpe.train(docs, 25).orderBy("rank").collect()]
    assert bpe.train_rounds(words, 25) == want
    assert bpe.train_rounds(words, 8, most=3) == want[:8]


def test_windows_reach_the_last_id(spark):
    rows = spark.createDataFrame([(1, list(range(10))), (2, list(range(9))), (3, [1, 2, 3, 4])], "doc_id long, ids array<int>")
    got = sorted((r["doc_id"], r["start"], r["y"][-1]) for r in windows.windows(rows, 4, 4, last=True).collect())
    assert got == [(1, 0, 4), (1, 4, 8), (1, 5, 9), (2, 0, 4), (2, 4, 8)]


def test_file_boundaries(spark, tmp_path):
    rng = random.Random(1)
    for n in range(4):
        (tmp_path / f"f{n}").write_bytes(b"".join(rng.choice([b"ab", "é".encode(), b"<|e|>"]) for _ in range(n * 30)))
    for chunks in (1, 3, 7):
        got = {r["path"].rpartition("/")[2]: r["boundaries"] for r in files.file_boundaries(spark, str(tmp_path), chunks, "<|e|>").collect()}
        assert got == {f"f{n}": files.chunk_boundaries(str(tmp_path / f"f{n}"), chunks, b"<|e|>") for n in range(1, 4)}


def test_chunk_boundaries(tmp_path):
    data = b"aaaa<|e|>bbbbbbbb<|e|>cc<|e|>" * 5
    p = tmp_path / "t.txt"
    p.write_bytes(data)
    for chunks in (1, 2, 3, 7, 50):
        for window in (3, 5, 4096):
            cut = files.chunk_boundaries(str(p), chunks, b"<|e|>", window)
            assert cut[0] == 0 and cut[-1] == len(data) and cut == sorted(set(cut)) and len(cut) <= chunks + 1
            assert all(data[c : c + 5] == b"<|e|>" for c in cut[1:-1])


def test_records_cut_at_delimiters(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ntwo<|endoftext|>three<|endoftext|>")
    assert [r["value"] for r in files.records(spark, str(tmp_path / "t.txt")).collect()] == ["one\ntwo", "three"]


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz\n")
    assert [r["value"] for r in files.whole_files(spark, str(tmp_path / "a.txt")).collect()] == ["x\ny\nz\n"]
    (tmp_path / "b.txt").write_bytes(b"a\xffb")
    assert files.whole_files(spark, str(tmp_path / "b.txt"), strict=False).head()["value"] == "a\ufffdb"
    with pytest.raises(Exception, match="UTF"):
        files.whole_files(spark, str(tmp_path / "b.txt")).collect()
    (tmp_path / "c.txt").write_bytes(b"one\ntwo\n")
    assert [r["value"] for r in files.lines(spark, str(tmp_path / "c.txt")).collect()] == ["one\n", "two\n"]


def test_byte_letters_are_a_bijection():
    t = vocab.byte_letters()
    assert len(set(t.values())) == 256 and t[ord("A")] == "A" and t[32] == "Ġ" and t[10] == "Ċ"


def test_import_of_letter_vocabulary(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"a": 0, "Ġ": 1, "Ġa": 2}')
    (tmp_path / "m.txt").write_text("#version\nĠ a\n\n")
    v, m = vocab.import_letters(spark, str(tmp_path / "v.json"), str(tmp_path / "m.txt"), ["<|x|>"])
    assert {tuple(r) for r in v.collect()} == {(0, "61"), (1, "20"), (2, "2061"), (3, "<|x|>".encode().hex().upper())}
    assert [tuple(r) for r in m.collect()] == [(0, "20", "61")]


def test_config_leaves_unknown_fields_out(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"d_model": 64,\n "other": null}')
    assert vocab.config(spark, str(tmp_path / "c.json"), "d_model int, num_heads int").head().asDict() == {"d_model": 64, "num_heads": None}


def test_token_sink_checks_the_range(spark):
    with pytest.raises(Exception, match="out of range"):
        state.save_tokens(spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>"), scratch_path(spark, "t"))


def test_token_sink_keeps_a_row_a_document(spark):
    path = scratch_path(spark, "t")
    state.save_tokens(spark.createDataFrame([(1, [7, 65535]), (2, []), (None, [3])], "doc_id long, ids array<int>"), path)
    assert spark.read.parquet(path).count() == 3  # once a row a token
    assert {tuple(r) for r in state.load_tokens(spark, path).collect()} == {(1, 0, 7), (1, 1, 65535), (None, 0, 3)}
    with pytest.raises(Exception, match="out of range: -1"):
        state.save_tokens(spark.createDataFrame([(1, [-1, 2])], "doc_id long, ids array<int>"), scratch_path(spark, "t"))


def test_special_parts_are_those_of_the_split(spark):
    texts = ["", "a", "<|e|>", "a<|e|><|e|>b<|e|>c", "<|e|><|e|><|e|>", "x\n|<|e|> "]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for specials in (["<|e|>", "<|e|><|e|>"], ["<|e|>"]):
        parts = text_functions.special_parts(F.col("s"), specials)
        for r in df.select(special_split(F.col("s"), specials).alias("p"), parts[0].alias("plain"), parts[1].alias("special")).collect():
            assert r["plain"] == [x["piece"] for x in r["p"] if not x["is_special"]] and r["special"] == [x["piece"] for x in r["p"] if x["is_special"]]


def test_backward_meets_pairs_once(spark):
    """Few shuffles, none of them after the pairs: the plan once joined scores, features and gradients of pairs again."""
    rows = spark.createDataFrame([(0, 0, p, [float(p), 1.0]) for p in range(5)], "b long, h long, p long, x array<double>").hint("merge")
    out = attention.backward(rows, rows, rows, rows, causal=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 6
    assert out.count() == 3 * 5 * 2


def test_log_append(spark):
    path = scratch_path(spark, "log")
    state.append_log(spark, [{"iter": 1, "train_loss": 2.0, "lr": 0.1}], path)
    state.append_log(spark, [{"iter": 2, "train_loss": 1.0, "valid_loss": 1.5, "lr": 0.1}], path)
    assert [(r["iter"], r["valid_loss"]) for r in state.read_log(spark, path).orderBy("iter").collect()] == [(1, None), (2, 1.5)]


def test_uniform_starts(spark):
    counts = spark.createDataFrame([(i, 100) for i in range(92)] + [(92, 300)], "start long, n long")
    assert [r["start"] for r in verify.outside_deviations(counts, 9500, 93).collect()] == [92]


def test_classifier_logs_validation_loss(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 4, 40)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, label int")
    state, log = training.train_classifier(rows, 4, 3, 2, (0.1, 0.01, 1, 4), 0.5, valid=rows, eval_every=2)
    w = np.zeros((4, 3))
    for r in state.collect():
        w[r["i"], r["j"]] = r["v"]
    p = dense.softmax(x @ w.T)
    assert log[0]["valid_loss"] is None
    np.testing.assert_allclose(log[1]["valid_loss"], -np.log(p[np.arange(40), y]).mean())
    assert training.mean_loss(rows.where("false"), w) is None
