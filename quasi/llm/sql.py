"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from quasi.llm.licence_texts import EQUIVALENTS, LICENCES
from quasi.llm.licences import COPYRIGHT_LINE, OTHER
from quasi.llm.mixing import BLOCK_IDS, HALVINGS, NULL_BLOCKS
from quasi.llm.resample import POLYNOMIAL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_rules(rules: Sequence[tuple[str, str, str]]) -> str:
    values = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in rules)
    return f"""
WITH rules(verdict, host, path) AS (VALUES {values}),
split AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS r
  FROM pages
), parts AS (
  SELECT page_id, r, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), met AS (
  SELECT p.*, u.verdict, u.host || u.path AS rule
  FROM parts p LEFT JOIN rules u
    ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM met QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC NULLS LAST) = 1"""


def mixing(factor: float, repeat: float) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         coalesce(floor(doc_id / {float(BLOCK_IDS)})::BIGINT, -4611686018427387904 - n_tokens % {NULL_BLOCKS}) AS block
  FROM documents
), p AS (
  SELECT *, md5(coalesce(source, '') || ':' || (source IS NULL)::VARCHAR || ':' || block::VARCHAR) AS place FROM d
), s AS (
  SELECT source, sum(n_tokens)::BIGINT AS t FROM p GROUP BY source HAVING sum(n_tokens) > 0
), all_t AS (SELECT sum(t)::DOUBLE AS total FROM s
), logs AS (SELECT list(ln(t / total) ORDER BY source) AS l, min(ln(t / total)) AS low FROM s, all_t
), halve(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
         CASE WHEN ok THEN lo ELSE mid END,
         CASE WHEN ok THEN mid ELSE hi END
  FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
           {factor} * exp(((lo + hi) / 2 - 1) * low) / list_sum(list_transform(l, lambda x: exp(x * (lo + hi) / 2))) <= {repeat} AS ok
    FROM halve, logs WHERE i < {HALVINGS}
  )
), a AS (SELECT hi AS a FROM halve WHERE i = {HALVINGS}
), w AS (
  SELECT source, t, a, exp(ln(t / total) * a) / sum(exp(ln(t / total) * a)) OVER () AS weight, total FROM s, all_t, a
), b AS (
  SELECT *, floor(weight * floor(total * {factor}))::BIGINT AS budget FROM w
), r AS (
  SELECT *, budget // t AS passes, budget - (budget // t) * t AS rest FROM b
), run AS (
  SELECT p.*, sum(n_tokens) OVER (PARTITION BY source ORDER BY place, block, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p
)
SELECT run.doc_id, run.source, run.n_tokens::BIGINT AS n_tokens, round((SELECT a FROM a), 6) AS exponent, round(coalesce(weight, 0), 6) AS weight,
       coalesce(budget, 0)::BIGINT AS budget, coalesce(passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END, 0)::BIGINT AS copies
FROM run LEFT JOIN r ON run.source IS NOT DISTINCT FROM r.source"""


def canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {quoted('(?m)' + COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"' ' || regexp_replace({out}, {quoted(OTHER)}, '  ', 'g') || ' '"
    for a, b in EQUIVALENTS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim(replace({out}, '  ', ' '))"


def licences() -> str:
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in LICENCES)
    return f"""
WITH known AS (
  SELECT form, min(licence) AS licence FROM (SELECT licence, {canonical('text')} AS form FROM (VALUES {values}) v(licence, text)) GROUP BY form
), whole AS (SELECT doc_id, text, {canonical('text')} AS form FROM documents
), lines AS (SELECT doc_id, {canonical('line')} AS form FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
), found AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n FROM lines JOIN known USING (form) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, licence, notices, coalesce(n, 0) AS n_notices
FROM whole LEFT JOIN known USING (form) LEFT JOIN found USING (doc_id)"""


def resample(buckets: int, percent: int, min_words: int, seed: str) -> str:
    """For features of single words; each distinct word's CRC is taken byte by byte."""
    return f"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END)) AS t),
words AS (
  SELECT doc_id AS id, 0 AS kind, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT item_id, 1, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
), vocabulary AS (SELECT DISTINCT word FROM words
), crcs AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM vocabulary, bits
), counts AS (SELECT bucket, sum((kind = 0)::INT)::DOUBLE AS s, sum((kind = 1)::INT)::DOUBLE AS t FROM words JOIN crcs USING (word) GROUP BY 1
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + {buckets}) / ((s + 1) * ((SELECT sum(t) FROM counts) + {buckets}))))::BIGINT AS gain FROM counts
), weights AS (
  SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN crcs USING (word) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY 1
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= {percent} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
