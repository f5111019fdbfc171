"""Pieces of DuckDB SQL that the oracles share, written independently of the DataFrame code."""

from __future__ import annotations

from ..functions.text import pretokens_sql


def weight(i: str, j: str, seed: int = 0) -> str:
    """The deterministic test weight of row i, column j."""
    return f"((({i}) * 31 + ({j}) * 17 + {seed}) % 101 - 50) / CAST(500 AS DOUBLE)"


WORDS = f"SELECT word, count(*) AS cnt FROM (SELECT unnest({pretokens_sql('text')}) AS word FROM documents) WHERE word <> '' GROUP BY word"
HEX_TOKENS = "list_transform(range(1, strlen(word) * 2, 2), lambda i: substr(hex(encode(word)), i, 2))"


def merge_list(tokens: str, left: str, right: str) -> str:
    """Greedy left-to-right merge of one pair in a list of tokens."""
    return (
        f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({tokens}, lambda x: [x])), "
        f"lambda a, x: CASE WHEN len(a) > 0 AND a[-1] = {left} AND x[1] = {right} THEN list_append(a[1:-2], {left} || {right}) ELSE list_concat(a, x) END)"
    )


def bpe_states(merges: int) -> str:
    """CTEs s0..sN (word, cnt, t) and m0..m(N-1) (l, r, n)."""
    out = [f"w AS MATERIALIZED ({WORDS})", f"s0 AS MATERIALIZED (SELECT word, cnt, {HEX_TOKENS} AS t FROM w)"]
    for i in range(merges):
        pairs = f"SELECT t[p] AS l, t[p + 1] AS r, cnt FROM (SELECT t, cnt, unnest(range(1, len(t))) AS p FROM s{i})"
        out.append(f"m{i} AS MATERIALIZED (SELECT l, r, CAST(sum(cnt) AS BIGINT) AS n FROM ({pairs}) GROUP BY l, r ORDER BY n DESC, l DESC, r DESC LIMIT 1)")
        new = merge_list("t", "l", "r")
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT word, cnt, CASE WHEN list_contains(t, l) AND list_contains(t, r) THEN {new} ELSE t END AS t FROM s{i}, m{i})")
    return "WITH " + ",\n".join(out)


def bpe_rounds(merges: int, table: str) -> str:
    """rank, l, r, n of many merges: a recursion whose rows are the words with their tokens, each with the pair merged last."""
    return f"""WITH RECURSIVE w AS MATERIALIZED ({WORDS.replace("FROM documents", f"FROM {table}")}),
    s(step, cnt, t, l, r, n) AS (
      SELECT 0, cnt, {HEX_TOKENS}, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM w
      UNION ALL
      (WITH best AS (SELECT t[p] AS l, t[p + 1] AS r, CAST(sum(cnt) AS BIGINT) AS n FROM (SELECT t, cnt, unnest(range(1, len(t))) AS p FROM s) GROUP BY 1, 2 ORDER BY n DESC, l DESC, r DESC LIMIT 1)
       SELECT step + 1, cnt, CASE WHEN list_contains(t, best.l) AND list_contains(t, best.r) THEN {merge_list("t", "best.l", "best.r")} ELSE t END, best.l, best.r, best.n
       FROM s, best WHERE step < {merges} AND len(t) > 1))
    SELECT DISTINCT CAST(step - 1 AS INT) AS rank, l, r, n FROM s WHERE step > 0"""


def _text_pairs(source: str) -> str:
    """k, n: summed counts of neighbours in x, lists of tokens counted n times; an empty token parts words."""
    return f"SELECT '(' || x[i] || ')(' || x[i + 1] || ')' AS k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, x, unnest(range(1, len(x))) AS i FROM ({source})) WHERE x[i] <> '' AND x[i + 1] <> '' GROUP BY 1"


def bpe_vocabulary(merges: int) -> str:
    """CTEs w (word, cnt) and m (rank, pair, n) of thousands of merges: a recursion of one merge a step over keyed rows.

    Tokens are text, (61)(6263), so that replace() merges a pair from left to right, and pairs order as (l, r) does since a bracket comes before
    digits. Rows: 0, words of one count, 16 in a row with () between them; 1, pairs with their counts, which change by the words a merge hits; 2, merges.
    """
    split = "string_split({}[2:-2], ')(')"
    return f"""WITH RECURSIVE w AS MATERIALIZED ({WORDS}),
lumps AS MATERIALIZED (SELECT n, string_agg(t, '()') AS t FROM (SELECT cnt AS n, '(' || array_to_string({HEX_TOKENS}, ')(') || ')' AS t, row_number() OVER (PARTITION BY cnt) // 16 AS part FROM w WHERE strlen(word) > 1) GROUP BY n, part),
s(kind, k, n, t) USING KEY (kind, k) AS (
  (SELECT 0, CAST(row_number() OVER () AS VARCHAR), n, t FROM lumps
  UNION ALL SELECT 1, k, n, '' FROM ({_text_pairs(f"SELECT n, {split.format('t')} AS x FROM lumps")})
  UNION ALL SELECT 2, '-1', 0, '')
  UNION
  (WITH best AS (SELECT k AS old, replace(k, ')(', '') AS new, n FROM recurring.s WHERE kind = 1 AND n > 0 ORDER BY n DESC, k DESC LIMIT 1),
  turn AS (SELECT CAST(k AS INT) + 1 AS rank FROM s WHERE kind = 2 AND CAST(k AS INT) + 1 < {merges}),
  hit AS MATERIALIZED (SELECT a.k, a.n, a.t, replace(a.t, old, new) AS u FROM recurring.s AS a, best, turn WHERE a.kind = 0 AND contains(a.t, old)),
  d AS MATERIALIZED ({_text_pairs(f"SELECT -n AS n, {split.format('t')} AS x FROM hit UNION ALL SELECT n, {split.format('u')} FROM hit")})
  SELECT 0, k, n, u FROM hit
  UNION ALL SELECT 1, d.k, d.n + coalesce(o.n, 0), '' FROM d LEFT JOIN (SELECT k, n FROM recurring.s WHERE kind = 1) o ON d.k = o.k WHERE d.n <> 0
  UNION ALL SELECT 2, CAST(rank AS VARCHAR), n, old FROM best, turn)),
m AS MATERIALIZED (SELECT CAST(k AS INT) AS rank, t AS pair, n FROM s WHERE kind = 2 AND t <> '')"""


#: CTE coded (word, cnt, t) after w and m: in each word the known pair of least rank is merged, again and again.
ENCODED_WORDS = f"""c(step, word, cnt, t) AS (
  SELECT 0, word, cnt, '(' || array_to_string({HEX_TOKENS}, ')(') || ')' FROM w
  UNION ALL
  SELECT step + 1, word, cnt, replace(t, pair, replace(pair, ')(', '')) FROM (
    SELECT step, word, cnt, t, arg_min(pair, rank) AS pair
    FROM (SELECT step, word, cnt, t, '(' || x[i] || ')(' || x[i + 1] || ')' AS pair FROM (SELECT step, word, cnt, t, x, unnest(range(1, len(x))) AS i FROM (SELECT step, word, cnt, t, string_split(t[2:-2], ')(') AS x FROM c))) JOIN m USING (pair)
    GROUP BY step, word, cnt, t)),
coded AS (SELECT word, any_value(cnt) AS cnt, arg_max(t, step) AS t FROM c GROUP BY word)"""
