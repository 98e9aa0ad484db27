"""DuckDB SQL equivalent to each registered query, over the driver tables
(registered as views by the checker).  Column names and types match the
Spark results."""

from __future__ import annotations

from slotvalue.plans.params import (AS_OF, FIRST_ROUND, FLOAT_DIGITS, FOCUS_SLOT, LOTTERY, MATURITY_YEARS,
                                    PLACEHOLDER, LISTING_PAGE, LISTING_DEEP, LISTING_SIZE, CATEGORY, COMPARE_FIRST,
                                    DISPLAY_SLOTS, PAGE_ORDERS)

D = FLOAT_DIGITS

# The oracle's own reading of the driver's text and pages.  Names: DuckDB's
# strip_accents, and the letters it leaves.  Pages: lists of linked items, a
# title, one heading, one article and paragraphs, with four character
# references.
CLASS_IN_URL = "/([0-9]+)([?#].*)?$"
TITLE, H1 = "<title>(.*?)</title>", "<h1>(.*?)</h1>"
ARTICLE, PARA = "(?s)<article>(.*?)</article>", "(?s)<p>(.*?)</p>"


def _ascii(expr: str) -> str:
    return f"replace(strip_accents({expr}), 'ß', 'ss')"

ENTRANTS = """
entrants AS (
  SELECT CAST(year(o.o_orderdate) AS BIGINT) AS class_year,
         CAST(c.c_nationkey + 1 AS BIGINT) AS slot,
         CAST(o.o_orderkey AS BIGINT) AS id,
         c.c_name AS name,
         CAST(coalesce(l.n, 0) AS DOUBLE) AS exposure,
         CAST(CASE WHEN l.n IS NULL THEN 0 ELSE o.o_totalprice / 1000 END AS DOUBLE) AS value
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l
    ON l.l_orderkey = o.o_orderkey
)"""

CLASS_RANK = """
class_ranked AS (
  SELECT class_year, slot, id, name, exposure, value,
         CAST(CASE WHEN value IS NULL THEN NULL
                   ELSE dense_rank() OVER (PARTITION BY class_year ORDER BY value DESC NULLS LAST)
              END AS BIGINT) AS class_rank
  FROM entrants WHERE exposure > 0
)"""


def _flag(col: str) -> str:
    return f"CASE WHEN {col} IS NULL THEN NULL WHEN {col} = {FOCUS_SLOT} THEN 'yes' ELSE 'no' END"


SQL: dict[str, str] = {}

SQL["slot_value"] = f"""
WITH {ENTRANTS},
s AS (
  SELECT slot,
         CASE WHEN count(*) = count(value) THEN sum(value) END AS total,
         CASE WHEN count(*) = count(value) THEN avg(value) END AS avg,
         CASE WHEN count(*) = count(value) THEN CAST(median(value) AS DOUBLE) END AS med
  FROM entrants WHERE slot <= {FIRST_ROUND} GROUP BY slot
)
SELECT slot, round(total, {D}) AS total, round(avg, {D}) AS avg, round(med, {D}) AS med,
       round_even(avg, 1) AS label_avg, round_even(med, 1) AS label_med,
       {_flag('slot')} AS highlight
FROM s
"""

SQL["class_rank"] = f"""
WITH {ENTRANTS}, {CLASS_RANK}
SELECT * FROM class_ranked
"""

SQL["slot_rank"] = f"""
WITH {ENTRANTS}, {CLASS_RANK},
s AS (
  SELECT slot,
         CASE WHEN count(*) = count(class_rank) THEN avg(class_rank) END AS avg_rank,
         CASE WHEN count(*) = count(class_rank) THEN CAST(median(class_rank) AS DOUBLE) END AS med_rank
  FROM class_ranked WHERE slot <= {FIRST_ROUND} GROUP BY slot
)
SELECT slot, round(avg_rank, {D}) AS avg_rank, round(med_rank, {D}) AS med_rank,
       round_even(avg_rank, 1) AS label_avg, round_even(med_rank, 1) AS label_med,
       {_flag('slot')} AS highlight
FROM s
"""


BAND_ORD = ("CAST(CASE band WHEN 'mega_boom' THEN 1 WHEN 'boom' THEN 2 WHEN 'role_player' THEN 3 "
            "WHEN 'bust' THEN 4 WHEN 'mega_bust' THEN 5 END AS BIGINT)")
MATURE = f"class_year <= year(DATE '{AS_OF}') - {MATURITY_YEARS}"

ASSIGNED = f"""
rated AS (
  SELECT *, value / nullif(exposure, 0) AS rate
  FROM entrants WHERE slot <= {LOTTERY} AND {MATURE}
),
stats AS (SELECT avg(rate) AS m, stddev_samp(rate) AS s FROM rated),
assigned AS (
  SELECT rated.*, stats.m AS mean_rate, stats.s AS sd_rate,
         CASE WHEN exposure = 0 THEN 'mega_bust'
              WHEN rate < m - s THEN 'mega_bust'
              WHEN rate < m - 0.5 * s THEN 'bust'
              WHEN rate < m + 0.5 * s THEN 'role_player'
              WHEN rate < m + s THEN 'boom'
              ELSE 'mega_boom' END AS band
  FROM rated, stats
)"""

SHARES = f"""
counts AS (SELECT slot, band, count(*) AS count FROM assigned GROUP BY slot, band),
shares AS (
  SELECT slot, band, {BAND_ORD} AS band_ord, count,
         count / sum(count) OVER (PARTITION BY slot) AS prop
  FROM counts
)"""

SQL["band_assign"] = f"""
WITH {ENTRANTS}, {ASSIGNED}
SELECT class_year, slot, id, name, exposure, value, rate,
       round(mean_rate, {D}) AS mean_rate, round(sd_rate, {D}) AS sd_rate, band, {BAND_ORD} AS band_ord
FROM assigned
"""

SQL["band_share"] = f"""
WITH {ENTRANTS}, {ASSIGNED}, {SHARES}
SELECT slot, band, band_ord, count, round(prop, {D}) AS prop,
       printf('%.1f%%', round_even(prop * 100, 1)) AS label
FROM shares
"""

SQL["band_stack"] = f"""
WITH {ENTRANTS}, {ASSIGNED}, {SHARES},
stacked AS (
  SELECT *, sum(prop) OVER (PARTITION BY slot ORDER BY band_ord DESC
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ymax
  FROM shares
)
SELECT slot, band, band_ord, round(prop, {D}) AS prop, printf('%.1f%%', round_even(prop * 100, 1)) AS label,
       round(ymax - prop, {D}) AS ymin, round(ymax, {D}) AS ymax, round(ymax - prop / 2, {D}) AS ymid
FROM stacked
"""

SQL["band_zero_fill"] = f"""
WITH {ENTRANTS}, {ASSIGNED}, {SHARES},
grid AS (
  SELECT s.slot, b.band FROM (SELECT DISTINCT slot FROM shares) s,
  (VALUES ('mega_boom'), ('boom'), ('role_player'), ('bust'), ('mega_bust')) b(band)
)
SELECT g.slot, g.band,
       CAST(CASE g.band WHEN 'mega_boom' THEN 1 WHEN 'boom' THEN 2 WHEN 'role_player' THEN 3
            WHEN 'bust' THEN 4 WHEN 'mega_bust' THEN 5 END AS BIGINT) AS band_ord,
       CAST(coalesce(sh.count, 0) AS BIGINT) AS count, round(coalesce(sh.prop, 0.0), {D}) AS prop,
       CASE g.band WHEN 'mega_boom' THEN 'Mega Boom' WHEN 'boom' THEN 'Boom'
            WHEN 'role_player' THEN 'Role Player' WHEN 'bust' THEN 'Bust'
            WHEN 'mega_bust' THEN 'Mega Bust' END AS band_label
FROM grid g LEFT JOIN shares sh ON sh.slot = g.slot AND sh.band = g.band
"""

EXEMPLARS = f"""
ex_base AS (
  SELECT *, value / exposure AS rate FROM entrants
  WHERE {MATURE} AND slot <= {LOTTERY} AND exposure > 0
),
ex_pos AS (
  SELECT *, row_number() OVER (PARTITION BY slot ORDER BY rate ASC NULLS LAST, class_year, id) AS rn,
         count(*) OVER (PARTITION BY slot) AS n
  FROM ex_base
),
ex_dist AS (SELECT *, abs(rn - (n + 1) / 2.0) AS middle_dist FROM ex_pos),
ex_all AS (
  SELECT *, 'Bottom 3' AS category FROM ex_dist WHERE rn <= 3
  UNION ALL
  SELECT * EXCLUDE (t), 'Top 3' AS category FROM (
    SELECT *, row_number() OVER (PARTITION BY slot ORDER BY rate DESC NULLS LAST, rn) AS t FROM ex_dist
  ) WHERE t <= 3
  UNION ALL
  SELECT * EXCLUDE (t), 'Middle 3' AS category FROM (
    SELECT *, row_number() OVER (PARTITION BY slot ORDER BY middle_dist, rn) AS t FROM ex_dist
  ) WHERE t <= 3
),
exemplars AS (
  SELECT *, CAST(CASE category WHEN 'Top 3' THEN 1 WHEN 'Middle 3' THEN 2 WHEN 'Bottom 3' THEN 3 END
                 AS BIGINT) AS category_ord
  FROM ex_all
)"""

SQL["exemplars"] = f"""
WITH {ENTRANTS}, {EXEMPLARS}
SELECT class_year, slot, id, name, exposure, value, rate,
       CAST(rn AS BIGINT) AS rn, CAST(n AS BIGINT) AS n, middle_dist, category, category_ord
FROM exemplars
"""


def _name_parts(src: str, col: str) -> str:
    """CTE body: name_clean, first_name, last_name, base_id of ``col``."""
    return f"""
  SELECT *, parts[1] AS first_name, parts[-1] AS last_name,
         coalesce(substring(lower(parts[-1]), 1, 5), 'NA')
           || coalesce(substring(lower(parts[1]), 1, 2), 'NA') AS base_id
  FROM (SELECT *, string_split(name_clean, ' ') AS parts
        FROM (SELECT *, regexp_replace({_ascii(col)}, '[^A-Za-z ]', '', 'g') AS name_clean
              FROM {src}))"""


SQL["name_clean"] = f"""
SELECT doc_id, name_clean, first_name, last_name, base_id
FROM ({_name_parts('documents', 'text')})
"""

SQL["entity_key"] = f"""
WITH {ENTRANTS},
named AS ({_name_parts('entrants', 'name')}),
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY class_year, id) AS occ,
         count(*) OVER (PARTITION BY base_id) AS nk
  FROM named
)
SELECT class_year, slot, id, name, base_id,
       CASE WHEN nk = 1 THEN base_id ELSE base_id || CAST(occ AS VARCHAR) END AS player_id
FROM keyed
"""

SQL["clean_entrants"] = """
SELECT CAST(year(o.o_orderdate) AS BIGINT) AS class_year,
       CAST(c.c_nationkey + 1 AS DOUBLE) AS slot,
       c.c_name AS name,
       CAST(coalesce(l.n, 0) AS DOUBLE) AS exposure,
       CAST(CASE WHEN l.n IS NULL THEN 0 ELSE o.o_totalprice / 1000 END AS DOUBLE) AS value,
       CAST(o.o_totalprice AS DOUBLE) AS value2,
       CAST(o.o_orderkey AS BIGINT) AS row_pos
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus <> 'P' AND c.c_name <> ''
"""

SQL["load_pages"] = f"""
WITH raw AS ({SQL["clean_entrants"]}),
named AS ({_name_parts('raw', 'name')}),
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY class_year, row_pos) AS occ,
         count(*) OVER (PARTITION BY base_id) AS nk
  FROM named
)
SELECT class_year, slot, name, exposure, value, value2, base_id,
       CASE WHEN nk = 1 THEN base_id ELSE base_id || CAST(occ AS VARCHAR) END AS player_id
FROM keyed
"""

# The rendered orders as they are, before any HTML: which cells are missing and
# what the others are follows from the order itself.
RENDERED = f"""
rendered AS (
  SELECT CAST(floor(o.o_orderkey / {PAGE_ORDERS}) * 10000 + year(o.o_orderdate) AS BIGINT) AS page_id,
         CAST(year(o.o_orderdate) AS BIGINT) AS class_year, o.o_orderkey, o.o_orderstatus = 'P' AS header,
         CAST(c.c_nationkey + 1 AS BIGINT) AS slot, c.c_name AS name, CAST(l.n AS BIGINT) AS n, o.o_totalprice AS price,
         CAST(row_number() OVER (PARTITION BY floor(o.o_orderkey / {PAGE_ORDERS}), year(o.o_orderdate)
                                 ORDER BY o.o_orderkey) AS BIGINT) AS row_pos
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
)"""

SQL["page_types"] = f"""
WITH {RENDERED},
p AS (
  SELECT page_id, count(*) AS cells, count(n) AS played, count_if(header) AS headers FROM rendered GROUP BY page_id
)
SELECT page_id, CAST(0 AS BIGINT) AS table_idx, CAST(t.i AS BIGINT) AS col_idx, t.name AS col_name, cells AS n_cells,
       CAST(CASE WHEN t.name IN ('Yrs', 'WS') THEN cells - played WHEN t.name = 'Lot' THEN headers ELSE 0 END AS BIGINT) AS n_missing,
       CASE t.name WHEN 'Pk' THEN CASE WHEN headers > 0 THEN 'text' ELSE 'integer' END
                   WHEN 'Player' THEN 'text'
                   WHEN 'Yrs' THEN CASE WHEN played > 0 THEN 'integer' ELSE 'logical' END
                   WHEN 'WS' THEN CASE WHEN played > 0 THEN 'double' ELSE 'logical' END
                   WHEN 'VORP' THEN 'double' ELSE 'logical' END AS type
FROM p, (VALUES (0, 'Pk'), (1, 'Player'), (2, 'Yrs'), (3, 'WS'), (4, 'VORP'), (5, 'Lot')) t(i, name)
"""

SQL["typed_table"] = f"""
WITH {RENDERED}
SELECT page_id, class_year, row_pos, CASE WHEN header THEN 'Pk' ELSE CAST(slot AS VARCHAR) END AS "Pk", name AS "Player",
       n AS "Yrs", CASE WHEN n IS NOT NULL THEN price / 1000 END AS "WS", price AS "VORP",
       CASE WHEN NOT header THEN slot <= {LOTTERY} END AS "Lot"
FROM rendered
"""

SQL["page_scan"] = f"""
SELECT page_id, url, TRY_CAST(regexp_extract(url, '{CLASS_IN_URL}', 1) AS BIGINT) AS class_year,
       CAST(length(html) AS BIGINT) AS n_chars
FROM pages
"""


def _cell_text(expr: str) -> str:
    t = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    for ref, ch in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{ref}', '{ch}')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


CELLS = f"""
lists AS (
  SELECT page_id, unnest(string_split(html, '<ul>')[2:]) AS rest,
         unnest(range(len(string_split(html, '<ul>')) - 1)) AS table_idx
  FROM pages
),
items AS (
  SELECT page_id, table_idx, unnest(string_split(split_part(rest, '</ul>', 1), '<li>')[2:]) AS item,
         unnest(range(len(string_split(split_part(rest, '</ul>', 1), '<li>')) - 1)) AS row_idx
  FROM lists
),
cells AS (
  SELECT page_id, CAST(table_idx AS BIGINT) AS table_idx, CAST(row_idx AS BIGINT) AS row_idx,
         CAST(0 AS BIGINT) AS col_idx, {_cell_text('item')} AS cell,
         replace(nullif(regexp_extract(item, 'href="([^"]*)"', 1), ''), '&amp;', '&') AS href
  FROM items
)"""

SQL["page_cells"] = f"WITH {CELLS} SELECT * FROM cells"

SQL["page_first_table"] = f"WITH {CELLS} SELECT * FROM cells WHERE table_idx = 0"

SQL["header_promote"] = f"""
WITH {CELLS},
hdr AS (
  SELECT page_id, table_idx, col_idx, coalesce(cell, '') AS name,
         row_number() OVER (PARTITION BY page_id, table_idx, coalesce(cell, '') ORDER BY col_idx) - 1 AS k
  FROM cells WHERE row_idx = 0
),
names AS (
  SELECT page_id, table_idx, col_idx,
         CASE WHEN k = 0 THEN name ELSE name || '.' || CAST(k AS VARCHAR) END AS col_name
  FROM hdr
)
SELECT b.page_id, b.table_idx, b.row_idx, b.col_idx, n.col_name, b.cell, b.href
FROM cells b LEFT JOIN names n
  ON n.page_id = b.page_id AND n.table_idx = b.table_idx AND n.col_idx = b.col_idx
WHERE b.row_idx > 0
"""

SQL["class_union"] = f"""
WITH {CELLS}
SELECT c.page_id, TRY_CAST(regexp_extract(p.url, '{CLASS_IN_URL}', 1) AS BIGINT) AS class_year,
       c.table_idx, c.row_idx, c.col_idx, c.cell, c.href
FROM cells c JOIN pages p ON p.page_id = c.page_id
WHERE c.table_idx = 0
"""

SQL["page_entrants"] = f"""
WITH {CELLS},
raw AS (
  SELECT TRY_CAST(regexp_extract(p.url, '{CLASS_IN_URL}', 1) AS BIGINT) AS class_year,
         CAST(c.row_idx AS DOUBLE) AS slot, c.cell AS name, CAST(length(c.cell) AS DOUBLE) AS exposure,
         CAST(0 AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS value2, c.page_id, c.row_idx AS row_pos
  FROM cells c JOIN pages p ON p.page_id = c.page_id WHERE c.table_idx = 0 AND c.cell <> ''
),
named AS ({_name_parts('raw', 'name')}),
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY class_year NULLS LAST, page_id, row_pos) AS occ,
         count(*) OVER (PARTITION BY base_id) AS nk
  FROM named
)
SELECT class_year, slot, name, exposure, value, value2, page_id, row_pos, base_id,
       CASE WHEN nk = 1 THEN base_id ELSE base_id || CAST(occ AS VARCHAR) END AS player_id
FROM keyed
"""

SQL["slot_report"] = f"""
WITH {ENTRANTS}, {EXEMPLARS},
img AS (SELECT 'images/' || CAST(doc_id AS VARCHAR) || '.jpg' AS path,
               CAST(doc_id AS VARCHAR) AS player_id FROM labels)
SELECT e.slot, e.category, e.category_ord, coalesce(i.path, '{PLACEHOLDER}') AS path, e.name,
       e.class_year, e.exposure, e.value, e.rate,
       format('{{:,.1f}}', e.value) AS value_label, format('{{:,.1f}}', e.rate) AS rate_label
FROM exemplars e LEFT JOIN img i ON i.player_id = CAST(e.id AS VARCHAR)
"""

SQL["slot_report_display"] = f"""
WITH r AS ({SQL["slot_report"].replace("WITH ", "WITH ", 1)})
SELECT slot, CAST(row_number() OVER (PARTITION BY slot ORDER BY category_ord, rate DESC NULLS LAST, class_year, name, path)
                  AS BIGINT) AS place, category, path AS _path, name AS _name, class_year AS "Class",
       exposure AS "Exposure", value AS "Total Value", rate AS "Value per Year"
FROM r WHERE slot IN ({', '.join(map(str, DISPLAY_SLOTS))})
"""

SQL["slot_report_files"] = f"""
SELECT category, category_ord, path, name, class_year, exposure, value, rate, slot FROM ({SQL["slot_report"]})
"""

SQL["index_files"] = """
SELECT CAST(doc_id AS VARCHAR) AS entry_id, 'doc/' || CAST(doc_id AS VARCHAR) AS href, '' AS title, '' AS section,
       md5(coalesce(text, '')) AS text_md5
FROM documents
"""

SQL["index_arrays"] = SQL["index_files"]

SLOT_SUMMARY = f"""
summary AS (
  SELECT slot,
         CASE WHEN count(*) = count(value) THEN avg(value) END AS avg,
         CASE WHEN count(*) = count(value) THEN CAST(median(value) AS DOUBLE) END AS med
  FROM entrants WHERE slot <= {FIRST_ROUND} GROUP BY slot
),
focus AS (SELECT max(avg) AS fa, max(med) AS fm FROM summary WHERE slot = {FOCUS_SLOT})"""

SQL["cmp_lowest"] = f"""
WITH {ENTRANTS}, {SLOT_SUMMARY}
SELECT slot, round(avg, {D}) AS avg FROM summary WHERE slot <= {COMPARE_FIRST}
ORDER BY summary.avg ASC NULLS LAST, slot LIMIT 1
"""

SQL["cmp_nearest"] = f"""
WITH {ENTRANTS}, {SLOT_SUMMARY}
SELECT slot, round(avg, {D}) AS avg, round(fa, {D}) AS focus_avg, round(abs(avg - fa), {D}) AS diff
FROM summary, focus WHERE slot <> {FOCUS_SLOT}
ORDER BY abs(summary.avg - focus.fa) ASC NULLS LAST, slot LIMIT 1
"""

SQL["cmp_ratio"] = f"""
WITH {ENTRANTS}, {SLOT_SUMMARY}
SELECT slot, round(med, {D}) AS med, round(fm, {D}) AS focus_med, round(fm / nullif(med, 0), {D}) AS ratio
FROM summary, focus WHERE slot <> {FOCUS_SLOT}
"""

SQL["cmp_worst_rank"] = f"""
WITH {ENTRANTS}, {CLASS_RANK},
s AS (
  SELECT slot,
         CASE WHEN count(*) = count(class_rank) THEN avg(class_rank) END AS avg_rank,
         CASE WHEN count(*) = count(class_rank) THEN CAST(median(class_rank) AS DOUBLE) END AS med_rank
  FROM class_ranked WHERE slot <= {COMPARE_FIRST} GROUP BY slot
)
SELECT slot, round(avg_rank, {D}) AS avg_rank, round(med_rank, {D}) AS med_rank,
       CAST(rank() OVER (ORDER BY avg_rank DESC NULLS LAST) AS BIGINT) AS avg_pos,
       CAST(rank() OVER (ORDER BY med_rank DESC NULLS LAST) AS BIGINT) AS med_pos
FROM s
"""

SQL["cmp_bust_rank"] = f"""
WITH {ENTRANTS}, {ASSIGNED}, {SHARES},
b AS (
  SELECT slot, coalesce(sum(CASE WHEN band IN ('bust', 'mega_bust') THEN prop END), 0.0) AS bust_share
  FROM shares GROUP BY slot
)
SELECT slot, round(bust_share, {D}) AS bust_share,
       CAST(rank() OVER (ORDER BY bust_share DESC) AS BIGINT) AS bust_pos
FROM b
"""


def _search(queries: str, index: str) -> str:
    """CTE body: every (query, entry) pair with a positive weighted score,
    ranked per query, at most 50 per query."""
    score = " + ".join(f"CASE WHEN strpos(lower(e.{f}), lower(q.query)) > 0 THEN {w} ELSE 0 END"
                       for f, w in (("title", 20), ("section", 20), ("text", 10)))
    return f"""
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS BIGINT) AS rank
    FROM (SELECT q.query_id, q.query, e.entry_id, e.href, CAST({score} AS BIGINT) AS score
          FROM {queries} q, {index} e WHERE length(q.query) >= 2)
    WHERE score > 0)
  WHERE rank <= 50"""


DOC_HITS = f"""
bq AS (SELECT CAST(item_id AS BIGINT) AS query_id, text AS query FROM benchmark),
di AS (SELECT CAST(doc_id AS BIGINT) AS entry_id, 'doc/' || CAST(doc_id AS VARCHAR) AS href,
              '' AS title, '' AS section, coalesce(text, '') AS text FROM documents),
hits AS ({_search('bq', 'di')})"""

SQL["doc_search"] = f"WITH {DOC_HITS} SELECT query_id, query, entry_id, href, score, rank FROM hits"

SQL["doc_snippet"] = f"""
WITH {DOC_HITS},
m AS (
  SELECT h.query_id, h.entry_id, d.text AS t, strpos(lower(d.text), lower(h.query)) - 1 AS s
  FROM hits h JOIN documents d ON d.doc_id = h.entry_id
),
st AS (
  SELECT *, CASE WHEN s < 50 THEN 0
                 WHEN regexp_matches(substring(t, 1, s + 1), '[ ,:]')
                   THEN length(regexp_extract(substring(t, 1, s + 1), '(?s)^(.*)[ ,:]', 1)) + 1
                 ELSE 0 END AS st
  FROM m
),
en AS (
  SELECT *, st + 200 AS e0, substring(t, st + 200 + 1, length(t)) AS tail FROM st
),
en2 AS (SELECT *, regexp_extract(tail, '^([^ ,:]*)', 1) AS run FROM en)
SELECT query_id, entry_id,
       CASE WHEN s < 0 THEN t
            WHEN e0 <= length(t) AND length(run) < length(tail)
              THEN substring(t, st + 1, e0 + length(run) - st) || '…'
            ELSE substring(t, st + 1, length(t)) END AS snippet
FROM en2
"""

PAGE_INDEX = f"""
pi_base AS (
  SELECT page_id, split_part(url, '#', 1) AS base,
         {_cell_text(f"regexp_extract(html, '{TITLE}', 1)")} AS title,
         {_cell_text(f"regexp_extract(html, '{H1}', 1)")} AS section, html
  FROM pages
),
pi AS (
  SELECT {{'page_id': page_id, 'pos': CAST(0 AS BIGINT)}} AS entry_id, base AS href, title, section,
         {_cell_text(f"regexp_extract(html, '{ARTICLE}', 1)")} AS text
  FROM pi_base
  UNION ALL
  SELECT {{'page_id': page_id, 'pos': CAST(pos + 1 AS BIGINT)}} AS entry_id, base || '#p' || CAST(pos AS VARCHAR) AS href, title, section,
         {_cell_text('ps[pos + 1]')} AS text
  FROM (SELECT *, unnest(range(len(ps))) AS pos
        FROM (SELECT *, regexp_extract_all(html, '{PARA}', 1) AS ps FROM pi_base))
),
tq AS (
  SELECT CAST(min(page_id) AS BIGINT) AS query_id, query
  FROM (SELECT page_id, {_cell_text(f"regexp_extract(html, '{TITLE}', 1)")} AS query FROM pages)
  GROUP BY query
)"""

SQL["doc_collapse"] = f"""
WITH {PAGE_INDEX},
hits AS ({_search('tq', 'pi')}),
hb AS (SELECT *, split_part(href, '#', 1) AS base_href, strpos(href, '#') = 0 AS is_doc FROM hits),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, base_href ORDER BY is_doc DESC, rank) AS item_pos,
         count(*) OVER (PARTITION BY query_id, base_href) AS group_size,
         min(rank) OVER (PARTITION BY query_id, base_href) AS group_rank
  FROM hb
)
SELECT query_id, base_href, group_rank, CAST(item_pos AS BIGINT) AS item_pos, href,
       entry_id.page_id AS page_id, entry_id.pos AS pos, score, CAST(group_size AS BIGINT) AS group_size, CAST(greatest(group_size - 3, 0) AS BIGINT) AS more
FROM pos WHERE item_pos <= 3
"""

SQL["doc_stats"] = r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words,
       CAST(ceil(len(regexp_extract_all(text, '\S+')) / 200) AS BIGINT) AS reading_minutes,
       CAST(length(text) AS BIGINT) AS chars
FROM documents
"""

def _listing(page: int) -> str:
    return f"""
SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
       CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS BIGINT) AS position
FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey LIMIT {LISTING_SIZE} OFFSET {(page - 1) * LISTING_SIZE}
"""


SQL["doc_listing"] = _listing(LISTING_PAGE)
SQL["doc_listing_deep"] = _listing(LISTING_DEEP)

SQL["doc_category"] = f"""
SELECT doc_id, lang, source FROM documents
WHERE coalesce(list_contains(string_split(concat_ws(',', lang, source), ','), '{CATEGORY}'), false)
"""
