"""SQL that DuckDB runs beside the queries whose results SQL can express."""

from __future__ import annotations

# The base patterns of personal data and of secrets.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"


def spans(kinds: list[tuple[str, str, str]], extra: tuple[tuple[str, str, str], ...] = (), listed: bool = False) -> str:
    """Counts and digest of the spans of some kinds (name, pattern, condition on the match s) of every document.

    If ``listed``, all spans, too, with those of the kinds ``extra``.

    A match starts behind the pieces and matches before it.
    """
    def text(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    found = " UNION ALL ".join(f"SELECT rid, {k} AS k, {text(n)} AS kind, regexp_extract_all(x, {text(p)}) AS m, string_split_regex(x, {text(p)}) AS b FROM t" for k, (n, p, _) in enumerate([*kinds, *extra]))
    kept = " OR ".join(f"k = {k} AND ({c})" for k, (*_, c) in enumerate([*kinds, *extra]))
    counts = ", ".join(f"count(*) FILTER (kind = {text(n)}) AS n_{n}" for n, *_ in kinds)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
found AS ({found}),
matches AS (SELECT rid, k, kind, m[i] AS s, list_sum(list_transform(b[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda p: length(p))), 0) AS pos
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
digits AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS d FROM matches),
kept AS (SELECT * FROM digits WHERE {kept}),
named AS (SELECT *, concat(kind, ':', CAST(pos AS BIGINT), ':', CAST(pos + length(s) AS BIGINT)) AS span FROM kept),
per AS (SELECT rid, {counts}, string_agg(span, ',' ORDER BY pos, k) FILTER (k < {len(kinds)}) AS base, string_agg(span, ',' ORDER BY pos, k) AS listed FROM named GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n, *_ in kinds)}, sha256(coalesce(base, '')) AS base_sha256{", coalesce(listed, '') AS spans" if listed else ""} FROM t LEFT JOIN per USING (rid)"""


LUHN = """length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INT) ELSE 2 * CAST(substr(reverse(d), i, 1) AS INT) - CASE WHEN substr(reverse(d), i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"""
SMALL = "len(list_filter(string_split(s, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || left(ltrim(p, '0'), 3) AS INT) > 255)) = 0"

PERSONAL_DATA = spans([("email", EMAIL, "true"), ("ip", IP, SMALL), ("card", CARD, LUHN), ("phone", PHONE, "length(d) BETWEEN 10 AND 15")])
SECRET_KINDS = [("assign", ASSIGN, f"length(regexp_extract(s, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8"), ("access", ACCESS, "length(s) >= 16"), ("hex", HEX, "length(s) >= 32")]
SECRETS = spans(SECRET_KINDS, (("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"), ("service_token", "(ghp_|xoxb-|sk_live_|glpat-)[A-Za-z0-9_-]+", "length(s) >= 20")), True)

#: The share that a source gets is found by filling sources in order of their room for a unit of weight.
TARGETS = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s),
l AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM w),
r AS (SELECT *, most / weight AS room, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM l),
v AS (SELECT *, (budget - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT room, place, level FROM v WHERE level <= room ORDER BY room, place LIMIT 1),
a AS (SELECT v.source, v.source_size, CASE WHEN o.place IS NULL OR (v.room, v.place) < (o.room, o.place) THEN v.most ELSE least(v.most, v.weight * o.level) END AS target FROM v LEFT JOIN o ON true)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target FROM sized JOIN a ON sized.source IS NOT DISTINCT FROM a.source"""

TOP = """
WITH v AS (SELECT vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, c.vec_id, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score FROM v a JOIN v c ON a.dim = c.dim AND a.vec_id <> c.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""

#: Windows of 400 bytes (as hexadecimal digits) and of 51 words; a window counts if it starts elsewhere, a passage if it
#: stands in another document. Spans are runs of positions covered by windows.
REPEATS = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS w FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM t)),
often AS (SELECT w FROM starts GROUP BY w HAVING count(*) > 1),
hit AS (SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 400, true) AS new FROM starts SEMI JOIN often USING (w)),
span AS (SELECT rid, n, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY rid ORDER BY i) AS n FROM hit) GROUP BY rid, n),
gap AS (SELECT rid, b AS a, lead(a) OVER (PARTITION BY rid ORDER BY a) AS b FROM (SELECT rid, a, b FROM span UNION ALL SELECT rid, -1, 0 FROM t)),
kept AS (SELECT rid, count(*) - 1 AS n_spans, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS k FROM gap JOIN t USING (rid) GROUP BY rid),
runs AS (SELECT rid, i, md5(array_to_string(words[i : i + 50], ' ')) AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 49)) AS i FROM t)),
shared AS (SELECT w FROM runs GROUP BY w HAVING count(DISTINCT rid) > 1),
met AS (SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 51, true) AS new FROM runs SEMI JOIN shared USING (w)),
passage AS (SELECT rid, n, max(i) + 51 - min(i) AS size FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY rid ORDER BY i) AS n FROM met) GROUP BY rid, n),
passages AS (SELECT rid, count(*) AS n_passages, CAST(sum(size) AS BIGINT) AS n_passage_words FROM passage GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, (length(h) - length(k)) // 2 AS n_removed, n_spans, sha256(unhex(k)) AS kept_sha256,
  coalesce(n_passages, 0) AS n_passages, coalesce(n_passage_words, 0) AS n_passage_words
FROM t JOIN kept USING (rid) LEFT JOIN passages USING (rid)"""
