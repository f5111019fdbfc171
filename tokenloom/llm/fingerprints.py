"""Document fingerprints by Order MinHash (operator 1), in DataFrame functions only.

A text is its words (runs without ASCII white space); its k-mers are k words in a row, numbered by
occurrence, so that a repeated k-mer counts as often as it stands. Each of ``2**BIN_BITS`` slots has an order
of its own over all k-mers, selects the ``ell`` first, puts them back into text order and hashes the
tuple (Marcais et al. 2019). Moving or editing text changes tuples even where the set of k-mers stays.

The order of a slot: one hash of (k-mer, occurrence) deals each k-mer to one slot, where it comes before all
that are dealt to others, by that hash; those follow by a further hash of (k-mer, occurrence, slot). In every
slot, k-mers draw their places independently and alike, so each slot is a random permutation, as of plain Order
MinHash, at any length of text; but only a slot that was dealt fewer than ``ell`` looks at the k-mers of others,
so long texts cost one hash a k-mer. All work on a text is array functions on
its own row: no k-mer is ever shuffled, and memory is bounded by one text.

Edge cases: null counts as the empty text; a text with no word has only empty slots; one of fewer
than ``k`` words has one k-mer, all its words. Equal texts have equal fingerprints. Likeness is
equal slots over slots that are not empty in both; of two texts without words, 1.0. Positions in a text of more than
2**23 words are kept in steps of 2, 4, 8 ... words, as few as its length needs. Repeated rows stay rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, fan_out, longs, range_bounds, range_of, session

K, ELL, BIN_BITS = 5, 2, 6
POS_BITS = 23
_POS, _RANK = (1 << POS_BITS) - 1, 40 - BIN_BITS
_REST = (1 << (_RANK + POS_BITS)) - 1


def sketch(df: DataFrame, text: str, out: str, k: int = K, ell: int = ELL, pos_bits: int = POS_BITS) -> DataFrame:
    """df with column out: array<int> of 2**BIN_BITS slots, all -1 for a text without words. k words a k-mer, ell k-mers a slot.

    pos_bits: what a position is kept in, of POS_BITS that there are.
    """
    w, s, t, every, step = f"{OWN}w", f"{OWN}s", f"{OWN}t", f"{OWN}every", f"{OWN}step"
    keep = [c for c in df.columns if c != out]
    bin_of, rank = f"shiftrightunsigned({{}}, {_RANK + POS_BITS})", f"shiftleft(shiftrightunsigned(xxhash64({{}}, {{}}), 24), {POS_BITS})"
    grams = ", ".join(f"{w}[i + {j}]" for j in range(k))
    ends = [((b << _RANK) | ((1 << _RANK) - 1)) << POS_BITS | _POS for b in range(1 << BIN_BITS)]
    df = df.withColumn(t, F.expr(f"btrim(coalesce(`{text}`, ''), ' \\t\\n\\x0B\\f\\r')".replace("\\x0B", "\\u000B").replace("\\f", "\\u000C")))
    df = df.withColumn(w, F.expr(f"transform(if({t} = '', array(), split({t}, '[\\\\x20\\\\x09-\\\\x0D]+')), x -> xxhash64(x))")).drop(t)
    df = df.withColumn(
        w,
        F.expr(
            f"CASE WHEN size({w}) = 0 THEN array() WHEN size({w}) < {k} THEN array(shiftrightunsigned(xxhash64({w}), 24)) "
            f"ELSE transform(sequence(0, size({w}) - {k}), i -> shiftrightunsigned(xxhash64({grams}), 24)) END"
        ),
    )
    df = df.withColumn(step, F.expr(f"greatest(0, length(bin(greatest(size({w}) - 1, 0))) - {pos_bits})"))
    # Repeated k-mers: sorted by (k-mer, position), a run's members are its occurrences 0, 1, 2...
    df = df.withColumn(s, F.expr(f"if(size(array_distinct({w})) = size({w}), cast(null as array<bigint>), sort_array(transform({w}, (x, i) -> shiftleft(x, {POS_BITS}) | shiftright(i, {step}))))"))
    df = df.withColumn(t, F.expr(f"if({s} IS NULL, null, filter(sequence(0, size({s}) - 1), i -> i = 0 OR shiftrightunsigned({s}[i], {POS_BITS}) != shiftrightunsigned({s}[i - 1], {POS_BITS})))"))
    once = f"transform({w}, (x, i) -> {rank.format('x', '0')} | shiftright(i, {step}))"
    runs = f"flatten(transform({t}, (a, r) -> transform(sequence(a, if(r + 1 < size({t}), {t}[r + 1], size({s})) - 1), j -> {rank.format(f'shiftrightunsigned({s}[j], {POS_BITS})', 'j - a')} | ({s}[j] & {_POS}))))"
    df = df.withColumn(every, F.expr(f"if({s} IS NULL, {once}, {runs})")).drop(s, t, step)
    df = df.withColumn(w, F.concat(every, F.array(*[F.lit(e).cast("bigint") for e in ends])))
    df = df.withColumn(w, F.expr(f"sort_array({w})"))
    df = df.withColumn(w, F.expr(f"filter({w}, (x, i) -> i < {ell} OR {bin_of.format(f'{w}[i - {ell}]')} != {bin_of.format('x')})"))
    df = df.withColumn(t, F.expr(f"filter(sequence(0, size({w}) - 1), i -> i = 0 OR {bin_of.format(f'{w}[i - 1]')} != {bin_of.format(f'{w}[i]')})"))
    chosen = f"filter(slice({w}, i + 1, {ell}), y -> {bin_of.format('y')} = {bin_of.format(f'{w}[i]')} AND (y & {_REST}) != {_REST})"
    # A slot with fewer than ell takes the rest from the k-mers of others, by a hash of its own.
    others = f"if(size(g.own) = 0, {every}, filter({every}, y -> {bin_of.format('y')} != g.bin))"
    mixed = f"transform({others}, y -> shiftleft(shiftrightunsigned(xxhash64(shiftrightunsigned(y, {POS_BITS}), g.bin), 24), {POS_BITS}) | (y & {_POS}))"
    full = f"if(size(g.own) = {ell}, g.own, concat(g.own, slice(sort_array({mixed}), 1, {ell} - size(g.own))))"
    in_order = f"sort_array(transform({full}, y -> shiftleft(y & {_POS}, {_RANK}) | (shiftrightunsigned(y, {POS_BITS}) & {(1 << _RANK) - 1})))"
    slot = f"transform({in_order}, z -> z & {(1 << _RANK) - 1})"
    dealt = f"transform({t}, i -> named_struct('bin', {bin_of.format(f'{w}[i]')}, 'own', {chosen}))"
    tuples = f"transform(transform({dealt}, g -> {slot}), g -> if(size(g) = 0, -1, cast(shiftrightunsigned(xxhash64(g), 48) as int)))"
    return df.select(*[F.col(f"`{c}`") for c in keep], F.expr(tuples).alias(out))


def as_text(slots: str):
    """Four hexadecimal digits a slot, ---- where it is empty."""
    return F.expr(f"array_join(transform({slots}, v -> if(v < 0, '----', lpad(lower(hex(v)), 4, '0'))), '')")


def likeness(a: str, b: str):
    """Share of equal slots among those that are not empty in both; 1.0 where all are."""
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x >= 0 AND x = y), z -> z))"
    some = f"size(filter(zip_with({a}, {b}, (x, y) -> x >= 0 OR y >= 0), z -> z))"
    return F.expr(f"if({some} = 0, 1.0D, {same} / cast({some} as double))")


def with_next(docs: DataFrame) -> tuple[DataFrame, object]:
    """doc_id, text of each row and of the next one in descending doc_id (after the last, the first).

    One shuffle of the texts, into contiguous doc_id ranges; of each range its first row goes to the
    range before it too, which its last row looks ahead to. Rows of one doc_id are ordered by a hash of the text;
    rows without one come last.
    """
    spark = session(docs)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(docs, "doc_id", fan_out(spark))
    part = f"{OWN}part"
    docs = docs.withColumn(part, range_of(F.col("doc_id"), bounds))
    top = {r[part]: r["top"] for r in docs.groupBy(part).agg(F.max("doc_id").alias("top")).collect()}  # at most as many rows as ranges
    order = sorted(top, reverse=True)
    goes_to = {p: order[i - 1] for i, p in enumerate(order)}  # the first range's top row closes the last range
    every = range(-1, len(bounds) + 1)
    at = F.col(part) + 1
    first = F.col("doc_id").eqNullSafe(F.get(longs([top.get(p) for p in every]), at))
    target = F.get(longs([goes_to.get(p) for p in every]), at).cast("int")
    own = F.array(F.struct(F.col(part).alias("p"), F.lit(False).alias("c")))
    both = F.concat(own, F.array(F.struct(target.alias("p"), F.lit(True).alias("c"))))
    dealt = docs.select("doc_id", "text", F.explode(F.when(first, both).otherwise(own)).alias("x")).select("doc_id", "text", F.col("x.p").alias(part), F.col("x.c").alias(f"{OWN}copy"))
    w = Window.partitionBy(part).orderBy(F.col(f"{OWN}copy"), F.col("doc_id").desc_nulls_last(), F.col(f"{OWN}tie"))
    return dealt.withColumn(f"{OWN}tie", F.xxhash64("text")).withColumn("next_text", F.lead("text").over(w)), w


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    dealt, w = with_next(docs)
    half = "cast(floor(length(text) / 2) as int)"
    dealt = dealt.withColumn("n_chars", F.length("text").cast("bigint"))
    dealt = dealt.withColumn("edited", F.expr(f"concat(left(text, cast(n_chars as int) - {half}), left(coalesce(next_text, ''), {half}))")).drop("next_text")
    dealt = sketch(dealt, "text", "slots").drop("text")
    dealt = sketch(dealt, "edited", "edited_slots").withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("edited")
    dealt = dealt.withColumn("next_slots", F.lead("slots").over(w)).where(~F.col(f"{OWN}copy"))
    return dealt.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("slots").alias("fingerprint"),
        as_text("edited_slots").alias("edited_fingerprint"),
        likeness("slots", "edited_slots").alias("near_edited"),
        likeness("slots", "next_slots").alias("near_next"),
    )
