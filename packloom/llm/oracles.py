"""DuckDB SQL of the operators whose arithmetic is longer than a query's own module should hold.

Each text is made from the operator's own parameters, so that a changed weight, word list or pattern changes both sides.
"""

from __future__ import annotations

from packloom.llm import jaccard_join, secrets, sharding


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def mixing_sql(repetition: float, block_tokens: int) -> str:
    """Exponents under a repetition limit have a closed form, which the bisection must meet."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, md5(coalesce(text, '')) AS content, row_number() OVER () AS row FROM documents
), s AS (SELECT source, sum(n)::BIGINT AS total FROM d GROUP BY 1),
h AS (SELECT source, total, total / sum(total) OVER () AS share FROM s WHERE total > 0),
e AS (SELECT *, CASE WHEN max(share) OVER () / min(share) OVER () <= {repetition} THEN 0.0 ELSE 1 - ln({repetition}) / ln(max(share) OVER () / min(share) OVER ()) END AS exponent FROM h),
w AS (SELECT *, pow(share, exponent) / sum(pow(share, exponent)) OVER () AS weight FROM e),
q AS (SELECT *, greatest(round(weight * max(total / weight) OVER ()), total)::BIGINT AS quota FROM w),
p AS (SELECT s.source, s.total, coalesce(quota, 0) AS quota, coalesce(weight * {block_tokens}, 1.0) AS per_block, exponent, weight,
        CASE WHEN s.total > 0 THEN ceil(quota / s.total)::INTEGER ELSE 1 END AS epochs FROM s LEFT JOIN q ON s.source IS NOT DISTINCT FROM q.source),
c AS (SELECT d.*, total, quota, per_block, exponent, weight, unnest(range(epochs))::INTEGER AS epoch FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, epoch * total + coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY md5(concat_ws('|', doc_id, content, epoch)), row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_ FROM c)
SELECT doc_id, source, n AS n_tokens, epoch, floor(at_ / per_block)::BIGINT AS mix_block, at_ AS token_offset, round(exponent, 9) AS exponent, round(weight, 9) AS weight
FROM o WHERE (epoch = 0 AND quota >= total) OR (at_ < quota AND (n > 0 OR epoch = 0))
"""


def jaccard_sql() -> str:
    """All pairs of texts that share a shingle, exactly, and the components of those similar enough."""
    w, t = jaccard_join.SHINGLE, round(1000 * jaccard_join.THRESHOLD)
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {w} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {w - 2}), lambda i: array_to_string(w[i : i + {w - 1}], ' ')) END)) AS g FROM d
), n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY 1),
h AS MATERIALIZED (SELECT r, hash(g) AS g FROM s),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 1000 * c >= {t} * (p.n + q.n - c)),
e AS MATERIALIZED (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.t),
least AS (SELECT reach.r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.t GROUP BY 1),
links AS (SELECT a AS r, count(*) AS n FROM e GROUP BY 1)
SELECT doc_id, class_id, coalesce(links.n, 0)::BIGINT AS n_links FROM d JOIN least USING (r) LEFT JOIN links USING (r)
"""


def _draws(tree: sharding.Tree, key: str, tag: str) -> str:
    """Common table expressions that walk a tree level by level; the last one is ``{tag}3`` (row, at_)."""
    out, before = [], f"SELECT row, {key} AS key, '' AS at_ FROM d"
    for i, level in enumerate(sharding.levels(tree), 1):
        kids = ", ".join(f"({_quoted(p)}, {_quoted(c)}, {w!r}::DOUBLE)" for p, found in level.items() for c, w in found)
        u = "(('0x' || substr(md5(key || c), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0"
        out.append(
            f"{tag}{i} AS (SELECT row, key, c AS at_ FROM ({before}) b JOIN (VALUES {kids}) v(p, c, w) ON p = at_ "
            f"QUALIFY row_number() OVER (PARTITION BY row ORDER BY -ln({u}) / w, c) = 1)"
        )
        before = f"SELECT row, key, at_ FROM {tag}{i}"
    return ", ".join(out)


def _crc_table() -> list[int]:
    """The remainders of all bytes under the reflected CRC-32 polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def sharding_sql(shards: int) -> str:
    now, then = sharding.default_tree(shards), sharding.default_tree(shards + 1)
    key = "coalesce(doc_id::VARCHAR, '')"
    # the list starts with the initial register, which list_reduce takes as its first value
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, raw), lambda a, b: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
b AS (SELECT row, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS raw FROM d),
{_draws(now, key, "n")}, {_draws(then, key, "g")}
SELECT doc_id, strlen(text)::BIGINT + 1 AS size, {crc}::BIGINT AS text_crc32, 'key' AS law, split_part(n3.at_, '/', -1)::INTEGER AS shard,
  row_number() OVER (PARTITION BY n3.at_ ORDER BY d.row) - 1 AS slot, split_part(g3.at_, '/', -1)::INTEGER AS grown_shard
FROM d JOIN b USING (row) JOIN n3 USING (row) JOIN g3 USING (row)
"""


def secrets_sql() -> str:
    """Trains the same two models from the same samples; RE2 has no lookahead, so a token's digit is asked for after the match."""
    n = len(secrets.ALPHABET) + 1
    words = "[" + ", ".join(map(_quoted, secrets.ORDINARY)) + "]"
    pick = lambda m, a: f"({words})[(id * {m} + {a}) % {len(secrets.ORDINARY)} + 1]"
    patterns = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, "[A-Za-z0-9+/_=-]{20,}"]
    found = " UNION ALL ".join(
        f"SELECT row, {k} AS k, unnest(f) AS f, unnest(g[1:len(f)]) AS g, generate_subscripts(f, 1) AS i FROM (SELECT row, regexp_extract_all(text, {_quoted(p)}) AS f, string_split_regex(text, {_quoted(p)}) AS g FROM d WHERE regexp_matches(text, {_quoted(p)}))"
        for k, p in enumerate(patterns)
    )
    at = lambda t, i: f"strpos({_quoted(secrets.ALPHABET)}, {t}[{i}])"
    kinds = "[" + ", ".join(map(_quoted, secrets.KINDS)) + "]"
    return f"""
WITH ids AS (SELECT range AS id, sha256(range::VARCHAR) AS digest FROM range({secrets.SAMPLES})),
codes AS (SELECT *, regexp_replace(base64(unhex(digest)), '=+$', '') AS code, (id % 20 + 20)::INTEGER AS size FROM ids),
parts AS (SELECT id, {pick(7, 3)} AS x, {pick(31, 11)} AS y, {pick(57, 29)} AS z FROM ids),
samples AS (
  SELECT TRUE AS random, CASE id % 3 WHEN 0 THEN substr(digest, 1, size) WHEN 1 THEN substr(code, 1, size) ELSE upper(substr(code, 1, size)) END AS token FROM codes
  UNION ALL
  SELECT FALSE, CASE id % 5 WHEN 0 THEN concat_ws('_', x, y, z) WHEN 1 THEN x || upper(y[1]) || y[2:] || upper(z[1]) || z[2:] WHEN 2 THEN concat_ws('-', x, y, z)
    WHEN 3 THEN concat_ws('/', x, y, z) ELSE upper(concat_ws('_', x, y, z)) END || CASE WHEN id % 4 = 0 THEN '_' || (id % 100) ELSE '' END FROM parts
), steps AS (SELECT random, token, unnest(range(1, length(token))) AS i FROM samples),
counts AS (SELECT random, {at("token", "i")} * {n} + {at("token", "i + 1")} AS pair, count(*) AS c FROM steps GROUP BY 1, 2),
grid AS (SELECT p.range AS pair, r.random, coalesce(c, 0) AS c FROM range({n * n}) p CROSS JOIN (VALUES (TRUE), (FALSE)) r(random) LEFT JOIN counts ON counts.pair = p.range AND counts.random = r.random),
smooth AS (SELECT pair, random, (c + 0.5::DOUBLE) / (sum(c) OVER (PARTITION BY random, pair // {n}) + 0.5::DOUBLE * {n}) AS p FROM grid),
model AS (SELECT pair, ln(max(p) FILTER (WHERE random) / max(p) FILTER (WHERE NOT random)) AS ratio FROM smooth GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
found AS ({found}),
placed AS (SELECT row, k, f, i, (sum(length(g) + length(f)) OVER (PARTITION BY row, k ORDER BY i))::BIGINT AS stop FROM found),
spans AS (SELECT row, k, i, f, stop - length(f) AS start, stop FROM placed WHERE k <> 0 OR length(regexp_extract(f, {_quoted(secrets.ASSIGN)}, 1)) >= {secrets.LEAST_ASSIGN}),
tokens AS (SELECT row, i, f, unnest(range(1, length(f))) AS j FROM spans WHERE k = 3 AND regexp_matches(f, '[0-9]')),
rated AS (SELECT row, i, sum(ratio) AS ratio FROM tokens JOIN model ON pair = {at("f", "j")} * {n} + {at("f", "j + 1")} GROUP BY 1, 2),
kept AS (
  SELECT row, k, start, stop FROM spans WHERE k < 3
  UNION ALL
  SELECT m.row, 3, m.start, m.stop FROM spans m JOIN rated r ON m.k = 3 AND m.row = r.row AND m.i = r.i AND r.ratio >= {secrets.MIN_RATIO}
  WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.row = m.row AND b.k < 3 AND b.start < m.stop AND m.start < b.stop)
), named AS (SELECT *, ({kinds})[k + 1] || ':' || start || ':' || stop AS shown FROM kept),
sums AS (
  SELECT row, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg(shown, ',' ORDER BY start, k, stop) FILTER (WHERE k < 3) AS base, string_agg(shown, ',' ORDER BY start, k, stop) AS spans FROM named GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(sums.spans, '') AS spans FROM d LEFT JOIN sums USING (row)
"""
