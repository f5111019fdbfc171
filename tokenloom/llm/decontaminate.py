"""Benchmark decontamination (operator 11), in DataFrame functions only.

Words are runs of letters, digits and whatever lies beyond ASCII, with A-Z in lower case. A window of an item is ``WIDTH``
words in a row, or all words of a shorter item. The windows' hashes fill a bit set that travels as one literal of bounded
size; every window of a document is tried against it inside the document's own row, first by its end words, then as a whole, and only
those that pass go on, with their words. These are joined to the windows of the items by hash and by the words themselves, so neither
a false bit nor a shared hash marks anything. Hashes fold the case of all letters, words only that of A-Z. The items' windows are broadcast only up to ``BROADCAST_WINDOWS``; a larger set
is joined by a shuffle. What is shuffled of a document is its id, a hash of its text and its marked positions, never text.

Edge cases: null text has no words, and an item without words no window; a document or an item shorter than a window is compared
as far as it has words; equal rows give equal results, each its own row; rows of one item_id count as one
item; the windows of an item without an id mark words, but no item is named or counted for them; empty tables
give no rows, or rows without marks. Further columns are ignored here, and kept by ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, longs, session

WIDTH = 10
#: Windows of items up to which they are broadcast: some 100 bytes each.
BROADCAST_WINDOWS = 500_000
#: The bit set has 64 bits a window or more, up to MOST_CELLS cells of 64 bits (2 MB).
LEAST_CELLS, MOST_CELLS = 1 << 6, 1 << 18

_APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_WORD = f"[^{_APART}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, as it spells them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{_APART}]+"), lambda x: x != "")


def _hashes(of: str) -> Column:
    """Of each word a hash that is blind to case. lower() also folds letters beyond ASCII, so it finds more windows than are equal, and none less."""
    return F.expr(f"transform({of}, x -> xxhash64(lower(x)))")


def _plain(joined: str) -> str:
    """SQL: A-Z in lower case, and nothing else."""
    return f"translate({joined}, '{_UPPER}', '{_LOWER}')"


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """width, ends, key (hashes), win (its words), items (sorted ids): each distinct window once."""
    w, h, m = f"{OWN}w", f"{OWN}h", f"{OWN}m"
    rows = items.select("item_id", words(F.col("text")).alias(w)).where(F.size(w) > 0).withColumn(h, _hashes(w)).withColumn(m, F.least(F.size(w), F.lit(width)))
    each = rows.select("item_id", m, F.expr(f"explode(transform(sequence(0, size({w}) - {m}), i -> struct({_ends(f"{h}[i]", f"{h}[i + {m} - 1]")} AS ends, xxhash64(slice({h}, i + 1, {m})) AS key, slice({w}, i + 1, {m}) AS win)))").alias("x"))
    each = each.select("item_id", F.col(m).alias("width"), "x.ends", "x.key", F.expr(_plain("array_join(x.win, ' ')")).alias("win"))
    return each.groupBy("width", "ends", "key", "win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _ends(first: str, last: str) -> str:
    """SQL: a cheap key of a window, from the hashes of its first and its last word."""
    return f"({first} ^ shiftleft({last}, 1))"


def _probe(key: str, cells: int) -> tuple[str, str]:
    """SQL: cell and bit of a key."""
    return f"cast(shiftrightunsigned({key}, 6) & {cells - 1} as int)", f"cast({key} & 63 as int)"


def bit_set(windows: DataFrame, n: int) -> list[int]:
    """The cells of the bit set of n windows' ends and keys; no more than MOST_CELLS numbers reach the driver."""
    cells = LEAST_CELLS
    while cells < MOST_CELLS and cells < n:
        cells *= 2
    rows = windows.select(F.explode(F.array("ends", "key")).alias("k")).select(*[F.expr(x).alias(c) for c, x in zip(("cell", "bit"), _probe("k", cells))])
    out = [0] * cells
    for r in rows.groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).collect():
        out[r["cell"]] = r["bits"]
    return out


def _text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text beside its doc_id."""
    return [F.xxhash64(text).alias(f"{OWN}t1"), F.xxhash64(F.lit("text"), text).alias(f"{OWN}t2")]


def marked(docs: DataFrame, items: DataFrame, width: int = WIDTH, all_rows: bool = True) -> DataFrame:
    """Each distinct (doc_id, text): doc_id, two hashes of the text, copies, n_words, spans (start, length; in words, merged, ascending) and items.

    all_rows: those without spans too. A filter on spans would compute them again inside the test; this one is on the hits.
    """
    spark = session(docs)
    found = item_windows(items, width).persist()
    try:
        counted = found.groupBy("width").agg(F.count("*").alias("n")).collect()  # no more rows than widths
        n, widths = sum(r["n"] for r in counted), sorted(r["width"] for r in counted)
        cells = bit_set(found, n)
    finally:
        found.unpersist()
    w, h, passed = f"{OWN}w", f"{OWN}h", f"{OWN}passed"
    rows = docs.select("doc_id", *_text_key(F.col("text")), words(F.col("text")).alias(w)).withColumn(h, _hashes(w))
    table = f"{OWN}cells"
    parts = []
    tested = lambda k: "getbit(get({}, {}), {}) = 1".format(table, *_probe(k, len(cells)))
    for m in widths:
        ends = f"zip_with({h}, slice({h}, {m}, greatest(0, size({h}) - {m} + 1)), (a, b) -> {_ends('a', 'b')})"  # null past the last window
        at = f"array_compact(transform({ends}, (x, i) -> if({tested('x')}, i, null)))"
        keyed = f"filter(transform({at}, i -> struct(i AS at, xxhash64(slice({h}, i + 1, {m})) AS key)), x -> {tested('x.key')})"
        parts.append(f"""transform({keyed}, x -> struct(x.at AS at, {m} AS width, x.key AS key, {_plain(f"array_join(slice({w}, x.at + 1, {m}), ' ')")} AS win))""")
    none = "array(cast(null as struct<at: int, width: int, key: bigint, win: string>))"
    every = f"concat({', '.join([none, *parts])})" if parts else none
    rows = rows.select("*", longs(cells).alias(table)).select("doc_id", f"{OWN}t1", f"{OWN}t2", F.size(w).cast("bigint").alias("n_words"), F.expr(every).alias(passed))
    flat = rows.select("doc_id", f"{OWN}t1", f"{OWN}t2", "n_words", F.explode_outer(passed).alias("x"))  # explode() would test the arrays' sizes first and compute them again for it
    flat = flat.select("doc_id", f"{OWN}t1", f"{OWN}t2", "n_words", "x.at", "x.width", "x.key", "x.win")
    # the first row of a document has no key: it joins nothing and counts the copies
    found = found.drop("ends")
    small = F.broadcast(found) if n <= BROADCAST_WINDOWS else found.hint("merge")
    joined = flat.join(small, ["width", "key", "win"], "left")
    hit = F.col("items").isNotNull()
    out = joined.groupBy("doc_id", f"{OWN}t1", f"{OWN}t2", "n_words").agg(
        F.count_if(F.col("at").isNull()).alias("copies"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("at", "width")))).alias("hits"),
        F.collect_set("items").alias("items"),
    )
    out = out if all_rows else out.where(F.size("hits") > 0)
    named = F.sort_array(F.array_distinct(F.flatten("items"))).alias("items")
    return _merged(out, width).select("doc_id", f"{OWN}t1", f"{OWN}t2", "copies", "n_words", "spans", named)


def _merged(rows: DataFrame, width: int) -> DataFrame:
    """Adds spans: hits (at, width), sorted, as (start, length) without overlaps, ascending.

    Of each place the longest hit counts; one begins a span if none of the width places before reaches it. Linear in the hits.
    """
    rows = rows.withColumn("hits", F.expr("filter(hits, (x, i) -> i + 1 = size(hits) OR hits[i + 1].at != x.at)"))
    reached = f"exists(slice(hits, greatest(1, i - {width} + 1), least(i, {width})), y -> y.at + y.width >= hits[i].at)"
    rows = rows.withColumn("begins", F.expr(f"if(size(hits) = 0, array(), filter(sequence(0, size(hits) - 1), i -> NOT {reached}))"))
    run = "slice(hits, s + 1, if(j + 1 < size(begins), begins[j + 1], size(hits)) - s)"
    length = f"array_max(transform({run}, y -> y.at + y.width)) - hits[s].at"
    return rows.withColumn("spans", F.expr(f"transform(begins, (s, j) -> struct(hits[s].at AS start, {length} AS length))"))


def digests(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = marked(docs, items, width)
    rows = rows.select("*", F.expr("aggregate(spans, 0L, (n, s) -> n + s.length)").alias("n_hit"), F.explode(F.expr("sequence(1L, copies)")))
    names = F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",")
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def cleaned(docs: DataFrame, items: DataFrame, most_share: float = 0.5, width: int = WIDTH) -> DataFrame:
    """docs without the marked words and what stands before each; a document whose marked share is over most_share goes (0: any mark)."""
    marks = marked(docs, items, width, all_rows=False).select("doc_id", f"{OWN}t1", f"{OWN}t2", "n_words", F.col("spans").alias(f"{OWN}spans"))
    marks = marks.withColumnsRenamed({"doc_id": f"{OWN}id", "n_words": f"{OWN}n"})
    keyed = docs.select("*", *_text_key(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & (keyed[f"{OWN}t1"] == marks[f"{OWN}t1"]) & (keyed[f"{OWN}t2"] == marks[f"{OWN}t2"])
    both = keyed.join(marks, same, "left").drop(f"{OWN}t1", f"{OWN}t2")
    spans, pieces = f"{OWN}spans", f"{OWN}pieces"
    both = both.where(F.expr(f"{spans} IS NULL OR aggregate({spans}, 0, (n, s) -> n + s.length) <= {most_share} * {OWN}n"))
    both = both.withColumn(pieces, F.regexp_extract_all("text", F.lit(f"[{_APART}]*{_WORD}"), F.lit(0)))
    ends = f"concat(array(0), transform({spans}, s -> s.start + s.length))"
    starts = f"concat(transform({spans}, s -> s.start), array(size({pieces})))"
    kept = f"flatten(zip_with({ends}, {starts}, (a, b) -> slice({pieces}, a + 1, b - a)))"
    tail = F.regexp_extract("text", f"([{_APART}]*)\\z", 1)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.expr(kept), ""), tail))
    return both.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """The same in SQL: all windows of all documents, joined to those of the items by their words."""
    split = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"
    return f"""
    WITH d AS (SELECT doc_id, {split("text")} AS w FROM documents),
    i AS (SELECT item_id, {split("text")} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS m, array_to_string(w[s + 1:s + least(len(w), {WIDTH})], ' ') AS g
           FROM (SELECT *, unnest(range(len(w) - least(len(w), {WIDTH}) + 1)) AS s FROM i WHERE len(w) > 0)),
    dw AS (SELECT doc_id, m, s, array_to_string(w[s + 1:s + m], ' ') AS g
           FROM (SELECT d.*, m, unnest(range(len(w) - m + 1)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
    hit AS (SELECT doc_id, item_id, s, m FROM dw JOIN iw USING (m, g)),
    n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS k FROM hit) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN named USING (doc_id)"""
