"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from slotvalue.llm.divergence import MIN_DOCS, TOP, UNIT
from slotvalue.llm.mixing import DOMAINS, EPOCHS, PERCENT, SEED, WEIGHTS
from slotvalue.llm.sharding import LIMIT
from slotvalue.llm.urlfilter import DEFAULT, HOST_RULES, SPAM_PATTERNS
from slotvalue.llm.veccode import ENTRIES, PARTS, ROUNDS, SCALE

_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"

SHARDING = f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  {_HASH.format("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
     pre AS (SELECT h, n_bytes, d, h >> (60 - d) AS p FROM r, (SELECT unnest(range(0, 61))::INTEGER AS d)),
     node AS (SELECT d, p FROM pre GROUP BY d, p HAVING sum(n_bytes) <= {LIMIT} OR min(h) = max(h)),
     leaf AS (SELECT h, min(d) AS d FROM (SELECT DISTINCT h, d, p FROM pre) JOIN node USING (d, p) GROUP BY h)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> (60 - d)), d, '0') END AS shard
FROM r JOIN leaf USING (h)
"""


def _level(k: int) -> str:
    keys = ["domain", "language", "origin"][:k]
    path, above = ", ".join(keys), ", ".join(keys[:-1])
    given = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(keys, p)) + f" THEN {w}"
                     for p, w in WEIGHTS.items() if len(p) == k)
    weight = f"CASE {given} ELSE 1 END" if given else "1"
    parent = f"JOIN b{k - 1} USING ({above})" if above else ", budget"
    part = f"PARTITION BY {above}" if above else ""
    return f"""
     n{k} AS (SELECT {path}, (CASE WHEN {weight} > 0 THEN sum(cap) ELSE 0 END)::HUGEINT AS cap,
                     ({weight})::HUGEINT AS w FROM leaf GROUP BY {path}),
     o{k} AS (SELECT *, coalesce(sum(cap) OVER before, 0)::HUGEINT AS cap_before,
                     (sum(w) OVER ({part}) - coalesce(sum(w) OVER before, 0))::HUGEINT AS w_left
              FROM n{k} {parent}
              WINDOW before AS ({part} ORDER BY CASE WHEN w > 0 THEN cap::DOUBLE / w::DOUBLE ELSE 0 END, {keys[-1]}
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     f{k} AS (SELECT *, cap * w_left <= (b - cap_before) * w AS is_full FROM o{k}),
     b{k} AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE ((b - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0))
                     * w)::HUGEINT // (sum(w) FILTER (NOT is_full) OVER ({part}))::HUGEINT END::HUGEINT AS b FROM f{k})"""


_DOMAIN = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in v)}) THEN '{k}'"
                             for k, v in DOMAINS.items()) + " ELSE 'other' END"

MIXING = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, {_DOMAIN} AS domain,
                  coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS origin,
                  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
     leaf AS (SELECT domain, language, origin, sum(n_tokens)::HUGEINT AS tokens, (sum(n_tokens) * {EPOCHS})::HUGEINT AS cap
              FROM d GROUP BY ALL),
     budget AS (SELECT least((sum(tokens) * {PERCENT})::HUGEINT // 100, sum(cap))::HUGEINT AS b FROM leaf),{_level(1)},{_level(2)},{_level(3)},
     plan AS (SELECT domain, language, origin, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS full_epochs,
                     CASE WHEN tokens > 0 THEN b % tokens ELSE 0 END AS rest
              FROM leaf JOIN b3 USING (domain, language, origin)),
     k AS (SELECT *, {_HASH.format(f"'{SEED}:' || full_epochs || ':' || id")} AS last_key
           FROM d JOIN plan USING (domain, language, origin)),
     c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY last_key
                                         RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, language, origin, n_tokens, e.epoch,
       {_HASH.format(f"'{SEED}:' || e.epoch || ':' || id")} AS order_key
FROM c JOIN (SELECT unnest(range(0, {EPOCHS}))::INTEGER AS epoch) e
  ON e.epoch < full_epochs OR (e.epoch = full_epochs AND upto <= rest)
"""

#: URLs of the tables hold no white space, so they are written as they are.
WARC = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
       coalesce(url, 'urn:page:' || page_id) AS target_uri
FROM p LEFT JOIN f USING (payload_digest)
"""

_HOST_RULES = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in HOST_RULES)
_SPAM = " OR ".join(f"contains(host || path, '{p.strip('*')}')" for p in SPAM_PATTERNS)

URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
     s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     r(rule_host, rule_path, action) AS (VALUES {_HOST_RULES}),
     fits AS (SELECT DISTINCT host, path, rule_host || rule_path AS rule, action
              FROM (SELECT DISTINCT host, path FROM s) d, r
              WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
     best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
              FROM fits GROUP BY host, path)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN {_SPAM} THEN 'block' ELSE '{DEFAULT}' END) AS verdict
FROM s LEFT JOIN best USING (host, path)
"""

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     w AS MATERIALIZED (SELECT no, lang, source,
                               unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
     kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT no) >= {MIN_DOCS}),
     v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
     g AS (SELECT DISTINCT lang, source FROM d),
     gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
     p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n,
                               (1 + {UNIT}::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v))::HUGEINT AS p
                        FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
     q AS (SELECT lang, term, (1 + {UNIT}::HUGEINT * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)))::HUGEINT AS q
           FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
     pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
               LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
               GROUP BY ALL),
     named AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
               FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
                      (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM named)
WHERE rank <= {TOP}
"""


def _assigned(k: int) -> str:
    return f"""
     a{k} AS (SELECT part, vec_id, label, any_value(p.x) AS x, min({{'d': list_sum(list_transform(list_zip(p.x, c.x),
                     lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS near
              FROM p JOIN c{k} c USING (part) GROUP BY part, vec_id, label)"""


def _round(k: int) -> str:
    return f"""{_assigned(k)},
     s{k} AS (SELECT part, near.e AS e, pos, sum(x[pos])::BIGINT AS s, count(*) AS n
              FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS pos) GROUP BY ALL),
     m{k} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS moved FROM s{k} GROUP BY part, e),
     c{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(moved, x) AS x FROM c{k} LEFT JOIN m{k} USING (part, e))"""


VECCODES = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
     p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x
                        FROM v, (SELECT unnest(range({PARTS})) AS part)),
     c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x
            FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),{",".join(map(_round, range(ROUNDS)))},{_assigned(ROUNDS)},
     coded AS (SELECT vec_id, label, string_agg(printf('%02x', near.e), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error
               FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded
"""

SQL = {"op1_sharding": SHARDING, "op4_warc": WARC, "op8_mixing": MIXING, "op11_divergence": DIVERGENCE, "op12_urls": URLS,
       "op13_veccodes": VECCODES}
