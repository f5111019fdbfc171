"""Column functions over text: pre-tokens, bytes, byte pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the public GPT-2 pre-tokenization pattern.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretokens(text: Column) -> Column:
    """Array of pre-tokens; joined they give the text back. (?U) makes \\s and classes follow Unicode."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0))


def pretokens_sql(text: str) -> str:
    """The same in a dialect without lookahead: the last white space of a run before a word is cut off first."""
    cut = rf"regexp_replace({text}, '(\s+)(\s)(\S)', concat('\1', chr(1), '\2\3'), 'g')"
    # Fixed value: the same public pattern without its lookahead.
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+".replace("'", "''")
    return f"flatten(list_transform(string_split({cut}, chr(1)), lambda p: regexp_extract_all(p, '{pattern}')))"


def special_pattern(specials: list[str]) -> str:
    """Alternation of literal specials, longest first."""
    quote = lambda s: "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in s)
    return "|".join(quote(s) for s in sorted(set(specials), key=lambda s: (-len(s), s)))


def special_split(text: Column, specials: list[str]) -> Column:
    """Array of (piece, is_special) in order. Empty ordinary pieces are dropped; without specials, one piece."""
    if not specials:
        return F.array(F.struct(text.alias("piece"), F.lit(False).alias("is_special")))
    pattern = special_pattern(specials)
    plain, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    struct = lambda p, s: F.struct(p.alias("piece"), F.lit(s).alias("is_special"))
    both = F.transform(plain, lambda p, i: F.array(struct(p, False), struct(F.get(hits, i), True)))
    return F.filter(F.flatten(both), lambda x: x["piece"].isNotNull() & (x["is_special"] | (x["piece"] != "")))


def special_parts(text: Column, specials: list[str]) -> tuple[Column, Column]:
    """The ordinary pieces of special_split and the special ones, each in order: two arrays, without a structure a piece."""
    if not specials:
        return F.array(text), F.when(text.isNotNull(), F.array().cast("array<string>"))
    pattern = special_pattern(specials)
    return F.array_remove(F.split(text, pattern, -1), ""), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def byte_tokens(word: Column) -> Column:
    """One upper-case hexadecimal token for each UTF-8 byte; their order is the order of bytes."""
    code = F.hex(F.encode(word, "UTF-8"))
    return F.when(F.length(code) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.substring(code, i, F.lit(2))))


def adjacent_pairs(tokens: Column) -> Column:
    """Array of (l, r) for each two neighbours, overlapping ones included."""
    return F.when(
        F.size(tokens) > 1,
        F.transform(F.slice(tokens, F.lit(1), F.size(tokens) - 1), lambda t, i: F.struct(t.alias("l"), F.get(tokens, i + 1).alias("r"))),
    ).otherwise(F.array().cast("array<struct<l:string,r:string>>"))


def merge_pair(tokens: Column, left: Column, right: Column) -> Column:
    """Merges (left, right) from left to right without overlaps.

    The last token put out equals left only if it has not been merged: a merged one is longer.
    """
    joined = F.concat(left, right)

    def step(acc: Column, x: Column) -> Column:
        hit = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) == left) & (x == right)
        return F.when(hit, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def without_broken_bytes(text: Column) -> Column:
    """text without the bytes that are not UTF-8; a replacement character that stands in the text stays."""
    kept = F.replace(F.replace(text, F.lit("\u0001"), F.lit("\u0001a")), F.lit("\ufffd"), F.lit("\u0001b"))
    clean = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.replace(clean, F.lit("\u0001b"), F.lit("\ufffd")), F.lit("\u0001a"), F.lit("\u0001")))
