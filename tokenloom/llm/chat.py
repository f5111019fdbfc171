"""Chat formatting by quotation linking (operator 10).

Lines that begin with quote marks (``>``, nested by repetition) are quoted, at their level; all others are a message's
own. Passages are lines, and sentences over consecutive lines of a level, so that a quote wrapped in another way
is still found. They are normalised (lower case, one space for white space), hashed and joined to
the own passages of earlier messages in the conversation: to the latest earlier one that holds it, found by ordered passes
over each hash in blocks of turns, so no passage meets its copies in pairs. A quoted line belongs to the message that has
it as a line, else to that of the longest of its sentences that is found.
The lines of a message's outermost level vote for the message it replies to (most lines,
then the latest); without a match it replies to the message before it.

Reply order: a run is a message and all that follow it turn by turn; a reply to anything but the message
before starts a run, a branch of the message it quotes. Runs stand in preorder: a run, then its
branches from the latest branching message to the earliest. Each message is put out in that order without
its quotes and without the line that introduces them, in a role-tagged form.

Places of runs come from pointer doubling: the sizes of whole branches, then the distances down from the first run, each in
as many written rounds as the logarithm of the deepest branch. Passes over a conversation, over a passage and over
the branches of one message are done in blocks of ``BLOCK`` turns and one row a block, so a very long one spreads over many tasks.

Edge cases: null text is an empty message; a message of quotes only is empty after them; rows of null
conv_id or turn are returned with null position and parent; rows of one (conv_id, turn) reply to the same message
and are ordered by a hash of the text, and the quotes of equal ones count once. Further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, forget, session, small_batches, written

BLOCK = 4096
_BLANK = " \t\n\r\f\v"
_SPACE = re.compile(r"\s+", re.ASCII)
_SENTENCE = re.compile(r"[.!?][\"')\]]*(?=\s)", re.ASCII)
_QUOTE = r"^(?:[ \t]*>)+"
_INTRODUCES = r"(?i)\bwrote:\s*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), r"[^>]", ""))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds lines: array of (level, body), body without quote marks and lines that introduce quotes."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n")
    each = F.transform(lines, lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _QUOTE + " ?", "").alias("body")))
    out = messages.withColumn("lines", each)
    introduces = lambda x, i: (x["level"] == 0) & F.rlike(x["body"], F.lit(_INTRODUCES)) & (F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)) > 0)
    return out.withColumn("lines", F.filter("lines", lambda x, i: ~introduces(x, i)))


def _normal(body: str) -> str:
    return _SPACE.sub(" ", body).strip(" ").lower()


def passages(lines: list[tuple[int, str]]) -> Iterator[tuple[int, int, str, bool]]:
    """line, level, normalised passage, whether it is a line: each line, and each sentence, a quoted one at every line that it touches.

    A sentence runs over consecutive lines of one level, to an end mark before white space or to an empty line.
    """
    at = 0
    while at < len(lines):
        level, end = lines[at][0], at
        while end < len(lines) and lines[end][0] == level and (plain := _normal(lines[end][1])):
            yield end, level, plain, True
            end += 1
        text = "\n".join(body for _, body in lines[at:end])
        starts, here = [], 0
        for _, body in lines[at:end]:
            starts.append(here)
            here += len(body) + 1
        here = 0
        for stop in [*(m.end() for m in _SENTENCE.finditer(text)), len(text)]:
            sentence = text[here:stop]
            plain = _normal(sentence)
            if plain:
                first = bisect_right(starts, stop - len(sentence.lstrip(_BLANK))) - 1
                last = bisect_right(starts, here + len(sentence.rstrip(_BLANK)) - 1) - 1
                if first < last or plain != _normal(lines[at + first][1]):
                    yield from ((at + k, level, plain, False) for k in range(first, (last if level else first) + 1))
            here = stop
        at = max(end, at + 1)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each message: copy (a hash of its text), line, level, passage (a hash), length, whole."""
    for b in batches:
        rows, out = [], []
        for i, (tie, lines) in enumerate(zip(b.column("tie").to_pylist(), b.column("lines").to_pylist())):
            for line, level, plain, whole in passages([(x["level"], x["body"]) for x in lines]):
                rows.append(i)
                out.append((tie, line, level, xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63), len(plain), whole))
        columns = list(zip(*out)) if out else [()] * 6
        keys = [b.column(c).take(pa.array(rows, pa.int64())) for c in ("conv_id", "turn")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
        yield pa.record_batch([*keys, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["conv_id", "turn", "copy", "line", "level", "passage", "length", "whole"])


def _before(df: DataFrame, keys: list[str], order: str, value: str, out: str, of: Callable[[str], Column] = F.max) -> DataFrame:
    """Adds out: of (max, or sum) over the values of rows with the same keys and a smaller order (a long); null where there are none."""
    block, before = f"{OWN}block", f"{OWN}before"
    df = df.withColumn(block, F.floor(F.col(order) / BLOCK))
    inside = Window.partitionBy(*keys, block).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = df.groupBy(*keys, block).agg(of(value).alias("m")).select(*keys, block, of("m").over(over).alias(before))
    both = F.greatest(out, before) if of is F.max else F.coalesce(F.col(out) + F.col(before), out, before)
    return df.withColumn(out, of(value).over(inside)).join(blocks, [*keys, block]).withColumn(out, both).drop(before, block)


def quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, copy, line, level, original: each quoted line and the turn of the earlier message whose own words it is (null: none)."""
    small_batches(session(messages))
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    shape = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, copy bigint, line int, level int, passage bigint, length int, whole boolean"
    # Conversations without a quote have no link: their texts are not taken apart.
    quoting = messages.where(F.rlike("text", F.lit(r"(?m)^[ \t]*>"))).select("conv_id").distinct()
    messages = messages.select("conv_id", "turn", "text").join(quoting, "conv_id", "left_semi")
    flat = parsed(messages).select("conv_id", "turn", F.xxhash64("text").alias("tie"), "lines").mapInArrow(_passages, shape)
    flat = written(flat, "chat-passages")
    # Passages that nobody quotes are not sorted: only hashes with a quote go on.
    wanted = flat.where("level > 0").select("conv_id", "passage").distinct()
    some = flat.join(wanted, ["conv_id", "passage"], "left_semi").withColumn("own", F.when(F.col("level") == 0, F.col("turn")))
    found = _before(some, ["conv_id", "passage"], "turn", "own", "original").where("level > 0")
    best = F.max(F.when(F.col("original").isNotNull(), F.struct("whole", "length", "original"))).alias("best")
    return found.groupBy("conv_id", "turn", "copy", "line", "level").agg(best).select("conv_id", "turn", "copy", "line", "level", F.col("best.original").alias("original"))


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn, quoted_turn: the message that each quoting message replies to; n_quoted and n_linked lines."""
    q = quotes(messages)
    outer = q.join(q.groupBy("conv_id", "turn").agg(F.min("level").alias("outer")), ["conv_id", "turn"]).withColumn("votes", F.col("level") == F.col("outer"))
    tally = outer.groupBy("conv_id", "turn", "original").agg(F.count("*").alias("n"), F.sum(F.col("votes").cast("int")).alias("v"))
    best = F.max(F.when(F.col("original").isNotNull() & (F.col("v") > 0), F.struct("v", "original"))).alias("best")
    linked = F.sum(F.when(F.col("original").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked")
    return tally.groupBy("conv_id", "turn").agg(best, F.sum("n").alias("n_quoted"), linked).select("conv_id", "turn", F.col("best.original").alias("quoted_turn"), "n_quoted", "n_linked")


def threaded(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with parent_turn, position (from 0 in the conversation), depth (branches above) and quote counts."""
    whole = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    block = F.floor(F.col("turn") / BLOCK)
    rows = whole.select("conv_id", "turn", "role", "text", F.xxhash64("text", "role").alias(f"{OWN}tie"))
    rows = rows.join(parents(whole), ["conv_id", "turn"], "left")
    rows = _before(rows, ["conv_id"], "turn", "turn", "previous")
    branch = F.col("quoted_turn").isNotNull() & (F.col("quoted_turn") != F.col("previous"))
    rows = rows.withColumn("parent_turn", F.coalesce("quoted_turn", "previous")).withColumn("starts", F.when(branch | F.col("previous").isNull(), F.col("turn")))
    rows = written(_before(rows, ["conv_id"], "turn", "starts", "run").withColumn("run", F.coalesce("starts", "run")).withColumn(f"{OWN}block", block), "chat-rows")
    # rank in the conversation, block by block
    inside = Window.partitionBy("conv_id", f"{OWN}block").orderBy("turn", f"{OWN}tie")
    over = Window.partitionBy("conv_id").orderBy(f"{OWN}block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", f"{OWN}block").agg(F.count("*").alias("n")).select("conv_id", f"{OWN}block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias(f"{OWN}base"))
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1).join(sizes, ["conv_id", f"{OWN}block"]).withColumn("rank", F.col("rank") + F.col(f"{OWN}base"))
    runs = rows.groupBy("conv_id", "run").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.max(F.when(F.col("turn") == F.col("run"), F.col("parent_turn"))).alias("at"))
    at_run = rows.select("conv_id", F.col("turn").alias("at"), F.col("run").alias("above")).distinct()
    runs = written(runs.join(at_run, ["conv_id", "at"], "left"), "chat-runs")
    bases = _places(runs)
    out = rows.join(bases, ["conv_id", "run"]).select(
        "conv_id", "turn", "role", "text", "parent_turn", (F.col("start") + F.col("rank") - F.col("first")).cast("bigint").alias("position"), "depth",
        F.coalesce("n_quoted", F.lit(0)).cast("bigint").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )
    nobody = messages.where("conv_id IS NULL OR turn IS NULL").select("conv_id", "turn", "role", "text", F.lit(None).cast("bigint").alias("parent_turn"), F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("int").alias("depth"), F.lit(0).cast("bigint").alias("n_quoted"), F.lit(0).cast("bigint").alias("n_linked"))
    return out.unionByName(nobody)


def _places(runs: DataFrame) -> DataFrame:
    """conv_id, run, first, depth (runs above it) and start (messages before it in preorder) of runs (conv_id, run, first, n, at, above)."""
    spark, key = session(runs), ["conv_id", "run"]
    kids = runs.where("above IS NOT NULL")
    if not kids.head(1):
        return runs.select(*key, "first", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("start"))
    # total: messages of a run and of those less than 2**round levels below it; up: the run 2**round levels above
    now = runs.select(*key, F.col("above").alias("up"), F.col("n").alias("total"))
    written_now = None
    while (live := now.where("up IS NOT NULL")).head(1):
        more = live.groupBy("conv_id", F.col("up").alias("run")).agg(F.sum("total").alias("more"))
        pointers = live.join(now.select("conv_id", F.col("run").alias("up"), F.col("up").alias("next")), ["conv_id", "up"]).select(*key, F.col("next").alias("up"), "total")
        every = pointers.unionByName(now.where("up IS NULL")).join(more, key, "left")
        now = written(every.select(*key, "up", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "chat-totals")
        if written_now is not None:
            forget(spark, written_now)
        written_now = now
    # the branches of a run stand by falling turn of the message that they branch from, then by their own first turn
    kids = kids.join(now.select(*key, "total"), key).withColumn("down", F.bitwise_not("at"))
    side = ["conv_id", "above", "down"]
    above = _before(kids.groupBy(*side).agg(F.sum("total").alias("total")), side[:2], "down", "total", "earlier", F.sum).select(*side, "earlier")
    kids = _before(kids, side, "run", "total", "beside", F.sum).join(above, side)
    kids = kids.join(runs.select("conv_id", F.col("run").alias("above"), F.col("n").alias("own")), ["conv_id", "above"])
    step = F.col("own") + F.coalesce("earlier", F.lit(0)) + F.coalesce("beside", F.lit(0))
    # start and depth below the run that up names (null: the first)
    steps = kids.select(*key, F.col("above").alias("up"), step.alias("start"), F.lit(1).alias("depth"))
    at = written(steps.unionByName(runs.where("above IS NULL").select(*key, F.col("above").alias("up"), F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("depth"))), "chat-places")
    while (live := at.where("up IS NOT NULL")).head(1):
        there = at.select("conv_id", F.col("run").alias("up"), F.col("up").alias("next"), F.col("start").alias("s"), F.col("depth").alias("d"))
        up = live.join(there, ["conv_id", "up"]).select(*key, F.col("next").alias("up"), (F.col("start") + F.col("s")).alias("start"), (F.col("depth") + F.col("d")).alias("depth"))
        after = written(up.unionByName(at.where("up IS NULL")), "chat-places")
        forget(spark, at)
        at = after
    return at.join(runs.select(*key, "first"), key).select(*key, "first", "depth", "start")


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, turn, position, parent_turn, depth, n_quoted, n_linked and message: the role tag, the text without quotes, the end mark."""
    rows = parsed(threaded(messages.select("conv_id", "turn", "role", "text")))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    body = F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    message = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), body, F.lit("\n<|end|>\n"))
    return rows.select("conv_id", "turn", "position", "parent_turn", "depth", "n_quoted", "n_linked", message.alias("message"))
