"""DuckDB statements that recompute the registered queries from the base tables."""

from __future__ import annotations

from themeloom.corpora import VOCABULARY
from themeloom.functions.text import WHITESPACE
from verification.inputs import PART_VOCABULARY

_SPACES = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_SPACE_RE = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def _key(x: str) -> str:
    return f"lower(regexp_replace({_trim(x)}, '{_SPACE_RE}+', ' ', 'g'))"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# -- shared relations ---------------------------------------------------------

R = """r AS (SELECT doc_id AS row_pos, 'd' || doc_id AS review_id, source AS product_id,
  'Product ' || source AS product_name, lang, source,
  CAST(1 + (doc_id * 7) % 5 AS INTEGER) AS rating,
  DATE '2026-01-01' + CAST(doc_id % 180 AS INTEGER) AS review_date, text,
  CASE WHEN doc_id % 4 = 0 THEN 'Author ' || (doc_id % 10) END AS author,
  doc_id % 3 = 0 AS verified, CASE WHEN doc_id % 2 = 0 THEN upper(lang) END AS country,
  CASE WHEN doc_id % 6 = 0 THEN 'deal ' || (doc_id % 4) END AS promotion,
  CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 3 AS DOUBLE) END AS discount_percent
  FROM documents)"""
P = """p AS (SELECT product_id, arg_min(product_name, row_pos) AS name, arg_min(lang, row_pos) AS top_category
  FROM r GROUP BY product_id)"""
S = """s AS (SELECT 'product' AS scope_kind, product_id AS scope_key, r.* FROM r
  UNION ALL SELECT 'category', top_category, r.* FROM r JOIN p USING (product_id))"""
RW = R.replace("FROM documents)", "FROM documents WHERE doc_id % 180 BETWEEN 31 AND 119)")
ALL_R = R.replace("r AS (", "all_r AS (", 1)
# The products of the whole corpus, for windowed selections.
PW = P.replace("FROM r ", "FROM all_r ")
_VALUES = ", ".join(
    f"({i}, {_q(t.key)}, {_q(t.label)}, {_q(k)}, {_q(t.recommendation)})"
    for i, t in enumerate(VOCABULARY) for k in t.keywords)
K = f"k(theme, theme_key, label, kw, advice) AS (VALUES {_VALUES})"
_HIT = "regexp_matches({x}, '(^|[^a-z0-9])' || kw || '([^a-z0-9]|$)', 'i')"
H = f"""h AS (SELECT row_pos, theme, theme_key, label, advice, count(*) AS hits FROM r CROSS JOIN k
  WHERE {_HIT.format(x='text')} GROUP BY ALL)"""
CREDIT = """coalesce(nullif(author, ''), CASE WHEN verified THEN 'Verified buyer' ELSE 'Buyer' END ||
  CASE WHEN coalesce(country, '') <> '' THEN ' · ' || country ELSE '' END)"""
M = """m AS (SELECT s.scope_kind, s.scope_key, CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END AS polarity,
  h.theme, h.theme_key, h.label, h.advice, h.hits, s.rating, s.review_date, s.row_pos
  FROM s JOIN h USING (row_pos) WHERE rating <> 3)"""
T = """t AS (SELECT scope_kind, scope_key, count(*) AS selected, avg(rating) AS mean FROM s GROUP BY ALL)"""
F0 = """f0 AS (SELECT scope_kind, scope_key, polarity, theme, theme_key, label, advice, count(*) AS mentions,
  arg_min(row_pos, (-hits, CASE WHEN rating >= 4 THEN -rating ELSE rating END, review_date, row_pos)) AS row_pos
  FROM m GROUP BY ALL HAVING count(*) >= 2)"""
F1 = """f AS (SELECT f0.*, selected, CAST(floor(mentions / selected * 100 + 0.5) AS INTEGER) AS percent,
  CAST(row_number() OVER (PARTITION BY scope_kind, scope_key, polarity ORDER BY mentions DESC, label) AS INTEGER) AS rank
  FROM f0 JOIN t USING (scope_kind, scope_key))"""
RULES = [R, P, S, K, H, M, T, F0, F1]
RULES_W = [ALL_R, RW, PW, S, K, H, M, T, F0, F1]
PIECES = f"string_split(regexp_replace(text, '([.!?]){_SPACE_RE}+', '\\1' || chr(1), 'g'), chr(1))"
QUOTES = f"""w AS (SELECT DISTINCT f.row_pos, f.theme, r.text, {PIECES} AS pieces FROM f JOIN r USING (row_pos)),
wp AS (SELECT row_pos, theme, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS piece FROM w),
wq AS (SELECT row_pos, theme, arg_min(piece, i) AS piece FROM wp JOIN k USING (theme)
  WHERE {_HIT.format(x='piece')} GROUP BY ALL),
q AS (SELECT w.row_pos, w.theme, {_trim('coalesce(piece, text)')} AS quote FROM w LEFT JOIN wq USING (row_pos, theme)),
fq AS (SELECT f.*, quote, r.review_id, {CREDIT} AS quote_author FROM f JOIN q USING (row_pos, theme) JOIN r USING (row_pos))"""

ORACLE: dict[str, str] = {}

# -- ingest -------------------------------------------------------------------

_STARS = "CAST(1 + (doc_id * 7) % 5 AS INTEGER)"
RAW = f"""raw AS (SELECT doc_id AS row_pos,
  CASE WHEN doc_id % 23 = 0 THEN '' ELSE 'r' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) END AS review_id,
  CASE WHEN doc_id % 29 = 0 THEN '' ELSE source END AS product_id,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE source || ' ' || lang END AS product_name,
  CASE WHEN doc_id % 13 = 0 THEN 'Uncategorized' ELSE lang || ' |  ' || source || ' |' END AS category,
  CASE WHEN doc_id % 13 = 0 THEN 'Uncategorized' ELSE lang END AS top, CASE WHEN doc_id % 13 = 0 THEN 'Uncategorized' ELSE source END AS leaf,
  CASE doc_id % 11 WHEN 0 THEN 4 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 5 WHEN 5 THEN NULL ELSE {_STARS} END AS rating,
  CASE WHEN doc_id % 17 IN (0, 1) THEN NULL ELSE DATE '2026-01-01' + CAST(doc_id % 180 AS INTEGER) END AS review_date,
  CASE WHEN doc_id % 31 = 0 THEN '' ELSE {_trim('text')} END AS text,
  CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id END AS title, doc_id % 3 = 0 AS verified,
  CASE WHEN doc_id % 2 = 0 THEN upper(lang) END AS country,
  CASE doc_id % 5 WHEN 0 THEN 'deal a' WHEN 2 THEN 'deal b' END AS promotion,
  CASE doc_id % 6 WHEN 0 THEN 10.0::DOUBLE WHEN 4 THEN 5.5::DOUBLE END AS discount_percent FROM documents)"""
OWN = """own AS (SELECT *, CASE WHEN review_id = '' THEN 'missing_review_id' WHEN product_id = '' THEN 'missing_product_id'
  WHEN review_date IS NULL THEN 'invalid_date' WHEN rating IS NULL THEN 'invalid_rating'
  WHEN text = '' THEN 'missing_review_text' END AS own_reason FROM raw)"""
CLS = """cls AS (SELECT *, CASE WHEN review_id = '' THEN own_reason WHEN row_pos > taken THEN 'duplicate_review_id' ELSE own_reason END AS reject_reason
  FROM (SELECT *, min(CASE WHEN own_reason IS NULL THEN row_pos END) OVER (PARTITION BY review_id) AS taken FROM own))"""
_INGEST = _with(RAW, OWN, CLS)
ORACLE["ingest_rows"] = _INGEST + """SELECT row_pos, review_id, product_id, product_name, category, rating, review_date, title, verified,
  country, promotion, discount_percent, reject_reason, length(text) AS text_length FROM cls"""
ORACLE["sources_csv_rows"] = _INGEST + "SELECT row_pos, review_id, product_id, rating, review_date, reject_reason, md5(text) AS text_md5 FROM cls"
# The raw cell keeps its inner spacing but loses its outer whitespace.
ORACLE["ingest_skip_reasons"] = _INGEST + """SELECT reject_reason, count(*) AS rows FROM cls
  WHERE reject_reason IS NOT NULL GROUP BY 1"""
ORACLE["ingest_load_stats"] = _INGEST + """SELECT count(*) AS parsed, count(*) FILTER (reject_reason IS NULL) AS accepted,
  count(reject_reason) AS skipped FROM cls"""
ORACLE["ingest_products"] = _INGEST + """SELECT product_id, coalesce(nullif(arg_min(product_name, row_pos), ''), product_id) AS name,
  arg_min(leaf, row_pos) AS category, arg_min(top, row_pos) AS top_category FROM cls
  WHERE reject_reason IS NULL GROUP BY product_id"""
ORACLE["ingest_category_summary"] = _with(R, P) + """SELECT top_category AS category, count(DISTINCT p.product_id) AS product_count,
  count(*) AS row_count FROM p JOIN r USING (product_id) GROUP BY 1"""
ORACLE["ingest_product_stats"] = _with(R) + """SELECT product_id, count(*) AS review_count, min(review_date) AS first_date,
  max(review_date) AS last_date FROM r GROUP BY 1"""
ORACLE["ingest_dataset_span"] = _with(R) + """SELECT min(review_date) AS first_date, max(review_date) AS last_date,
  count(*) > 0 AND bool_and(review_date IS NOT NULL) AS has_dates FROM r"""
ORACLE["ingest_rating_polarity"] = _with(R) + """SELECT 'uploaded' AS source, count(*) AS rows,
  count(*) FILTER (rating >= 4) AS high_rows, count(*) FILTER (rating <= 2) AS low_rows FROM r"""
EXP = """e AS (SELECT p_partkey + 1 AS row_pos, 'amz-' || CASE WHEN p_partkey + 1 < 10000 THEN lpad(CAST(p_partkey + 1 AS VARCHAR), 4, '0') ELSE CAST(p_partkey + 1 AS VARCHAR) END AS review_id,
  CASE WHEN p_partkey % 37 = 0 THEN '' ELSE 'P' || (p_partkey // 2) END AS product_id, p_name AS product_name,
  p_type, p_brand, 'Size ' || p_size AS leaf, p_type || '| ' || p_brand || ' |Size  ' || p_size AS category_cell,
  CAST(trunc(p_retailprice) AS BIGINT) AS price, p_partkey AS k,
  CASE p_partkey % 9 WHEN 0 THEN '4.2' WHEN 1 THEN '3.5' WHEN 2 THEN '2.4' WHEN 3 THEN '|' WHEN 4 THEN '' WHEN 5 THEN '5.6' ELSE '4' END AS raw_rating,
  CASE WHEN p_partkey % 41 = 0 THEN '' ELSE p_name || ' ' || p_brand END AS review_text FROM part),
x AS (SELECT *, CASE WHEN raw_rating = '' THEN 0 ELSE try_cast(raw_rating AS DOUBLE) END AS source_rating FROM e),
y AS (SELECT *, CASE WHEN floor(source_rating + 0.5) BETWEEN 1 AND 5 THEN CAST(floor(source_rating + 0.5) AS INTEGER) END AS rating FROM x),
z AS (SELECT *, CASE WHEN product_id = '' THEN 'missing_product_id' WHEN review_text = '' THEN 'missing_review_text'
  WHEN rating IS NULL THEN 'invalid_rating' END AS source_reason FROM y)"""
ORACLE["ingest_product_records"] = _with(EXP) + """SELECT row_pos, review_id, product_id, product_name,
  p_type || '>' || p_brand || '>' || leaf AS category_path, leaf AS category, rating, source_rating,
  CASE WHEN k % 3 <> 0 THEN CAST(price AS DOUBLE) END AS discounted_price, CAST(price AS DOUBLE) AS actual_price,
  CASE k % 4 WHEN 0 THEN 64.0::DOUBLE WHEN 3 THEN 7.5::DOUBLE END AS discount_percent, CAST(k * 13 AS DOUBLE) AS rating_count,
  source_reason, raw_rating FROM z"""
ORACLE["ingest_export_reviews"] = _with(EXP) + """SELECT row_pos, review_id, product_id, category_cell AS category, rating, source_rating,
  CAST(NULL AS DATE) AS review_date, CAST(NULL AS VARCHAR) AS promotion, CAST(NULL AS DOUBLE) AS discount_percent,
  source_reason AS reject_reason FROM z"""
ORACLE["ingest_pruned_export"] = _with(EXP) + """SELECT product_id, product_name, category_cell AS category,
  CASE WHEN k % 3 = 0 THEN '' ELSE '₹' || format('{:,}', price) END AS discounted_price, '₹' || format('{:,}', price) AS actual_price,
  CASE k % 4 WHEN 0 THEN '64%' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE '7.5 %' END AS discount_percentage,
  raw_rating AS rating, format('{:,}', k * 13) AS rating_count,
  CASE WHEN k % 41 = 0 THEN ' ' ELSE product_name || ' ' || p_brand END AS review_content FROM z"""
ORACLE["ingest_text_sample"] = _with(R) + f"""SELECT row_pos, review_id, text_bytes, CAST(total AS BIGINT) AS total_bytes FROM (
  SELECT row_pos, review_id, text_bytes, sum(text_bytes) OVER (ORDER BY row_pos) AS total,
    sum(body + 1) OVER (ORDER BY row_pos) + 13 AS request FROM (
    SELECT min(row_pos) AS row_pos, product_id AS review_id, strlen(arg_min({_trim('text')}, row_pos)) AS text_bytes,
      strlen(CAST(json_object('id', product_id, 'text', arg_min({_trim('text')}, row_pos)) AS VARCHAR)) AS body
    FROM r GROUP BY product_id ORDER BY 1 LIMIT 12))
  WHERE total <= 204800 AND request <= 256000"""

SCOPES = """sc AS (SELECT 'product' AS scope_kind, product_id AS scope_key, name AS subject FROM p
  UNION ALL SELECT DISTINCT 'category', top_category, top_category FROM p)"""
# -- scopes -------------------------------------------------------------------

_IN = "review_date BETWEEN DATE '2026-02-01' AND DATE '2026-04-30'"
ORACLE["scopes_one_product"] = _with(R) + f"SELECT review_id, review_date, rating FROM r WHERE product_id = 'src1' AND {_IN}"
ORACLE["scopes_one_category"] = _with(R, P) + f"""SELECT review_id, product_id, review_date, rating FROM r
  WHERE {_IN} AND product_id IN (SELECT product_id FROM p WHERE top_category = 'en')"""
ORACLE["scopes_all"] = _with(R, P, S) + "SELECT scope_kind, scope_key, review_id FROM s"
ORACLE["scopes_selection_order"] = _with(R, P, S) + """SELECT scope_kind, scope_key, review_id,
  row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY review_date, row_pos) - 1 AS sel_pos FROM s"""
ORACLE["scopes_unknown"] = _with(R, P, SCOPES) + """SELECT scope_kind, scope_key FROM (SELECT DISTINCT unnest([lang, source]) AS scope_key FROM documents),
  (VALUES ('product'), ('category')) kinds(scope_kind) WHERE (scope_kind, scope_key) NOT IN (SELECT (scope_kind, scope_key) FROM sc)"""
ORACLE["scopes_partition_check"] = _with(R) + f"SELECT review_id, CAST(0 AS BIGINT) AS times FROM r WHERE NOT ({_IN})"

# -- rule engine --------------------------------------------------------------

ORACLE["themes_hits"] = _with(R, K, H) + "SELECT row_pos, theme, CAST(hits AS INTEGER) AS hits FROM h"
_FIND = "SELECT scope_kind, scope_key, polarity, theme_key, label, mentions, percent, selected, row_pos, rank FROM f"
ORACLE["themes_findings"] = _with(*RULES) + _FIND
ORACLE["themes_findings_in_window"] = _with(*RULES_W) + _FIND
ORACLE["themes_quotes"] = _with(*RULES, QUOTES) + """SELECT scope_kind, scope_key, polarity, rank, label, review_id, quote, quote_author FROM fq"""
ORACLE["themes_combined"] = _with(*RULES) + """SELECT scope_kind, scope_key, CAST(row_number() OVER (PARTITION BY scope_kind, scope_key
  ORDER BY mentions DESC, label, polarity DESC) AS INTEGER) AS overall_rank, label, polarity, mentions FROM f"""
ORACLE["themes_recommendations"] = _with(*RULES) + "SELECT scope_kind, scope_key, rank, advice FROM f WHERE polarity = 'negative'"
ORACLE["themes_scope_summary"] = _with(R, P, S, T) + """SELECT scope_kind, scope_key, selected AS review_count,
  floor(mean * 10 + 0.5) / 10 AS average_rating FROM t"""

_PART_VALUES = ", ".join(
    f"({i}, {_q(t.key)}, {_q(t.label)}, {_q(k)}, {_q(t.recommendation)})"
    for i, t in enumerate(PART_VOCABULARY) for k in t.keywords)
RECORDS = """r AS (SELECT row_pos, product_id, p_type AS top, rating, NULL::DATE AS review_date, review_text AS text FROM z WHERE source_reason IS NULL),
p AS (SELECT product_id, arg_min(top, row_pos) AS top_category FROM r GROUP BY 1)"""
ORACLE["themes_record_findings"] = _with(EXP, RECORDS, S, f"k(theme, theme_key, label, kw, advice) AS (VALUES {_PART_VALUES})", H, M, T,
  F0.replace("HAVING count(*) >= 2", "").replace("review_date, row_pos", "row_pos"), F1) + _FIND
SALES = """r AS (SELECT l_orderkey * 10 + l_linenumber AS row_pos, CAST(l_partkey AS VARCHAR) AS product_id, p_type AS top,
  CAST(1 + (l_linenumber + CAST(l_quantity AS INTEGER)) % 5 AS INTEGER) AS rating, l_discount * 100 AS discount_percent,
  CASE WHEN l_discount > 0 THEN 'code ' || l_returnflag END AS promotion FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT product_id, arg_min(top, row_pos) AS top_category FROM r GROUP BY 1)"""
PROMO = """b AS (SELECT *, promotion IS NOT NULL OR coalesce(discount_percent > 0, false) AS promo FROM s),
g AS (SELECT scope_kind, scope_key, count(*) FILTER (promo) AS promo_count, count(*) FILTER (NOT promo) AS full_price_count,
  floor(avg(rating) FILTER (promo) * 10 + 0.5) / 10 AS promo_average,
  coalesce(floor(avg(rating) FILTER (NOT promo) * 10 + 0.5) / 10, 0) AS full_price_average,
  coalesce(array_to_string(list_sort(list(DISTINCT promotion) FILTER (promotion IS NOT NULL)), ', '), '') AS promotions, count(DISTINCT promotion) AS label_count
  FROM b GROUP BY ALL HAVING count(*) FILTER (promo) > 0),
gd AS (SELECT *, full_price_count > 0 AS comparable,
  CASE WHEN full_price_count > 0 THEN floor((promo_average - full_price_average) * 10 + 0.5) / 10 ELSE 0 END AS rating_delta FROM g),
gn AS (SELECT *, CASE WHEN NOT comparable THEN 'Every purchase here was promoted (' || promo_count || ' ' || CASE WHEN promo_count = 1 THEN 'review' ELSE 'reviews' END
    || ', mean ' || format('{:.1f}', promo_average) || '★); nothing at full price to compare.'
  WHEN abs(rating_delta) >= 0.1 THEN 'Bought on promotion: ' || format('{:.1f}', promo_average) || '★, which is ' || format('{:.1f}', abs(rating_delta))
    || '★ ' || CASE WHEN rating_delta > 0 THEN 'higher' ELSE 'lower' END || ' than at full price (' || format('{:.1f}', full_price_average) || '★).'
  ELSE 'Promotion makes no visible difference: ' || format('{:.1f}', promo_average) || '★ against ' || format('{:.1f}', full_price_average) || '★ at full price.' END AS note FROM gd)"""
ORACLE["promotions_by_scope"] = _with(SALES, S, PROMO) + """SELECT scope_kind, scope_key, promo_count, full_price_count, promo_average,
  full_price_average, comparable, rating_delta, note, promotions, label_count FROM gn"""
ORACLE["promotions_labels"] = _with(R, P, S) + "SELECT DISTINCT scope_kind, scope_key, promotion FROM s WHERE promotion IS NOT NULL"

# Labels here are one lower-case word or phrase, so they need no change inside a sentence.
LISTS = """l AS (SELECT scope_kind, scope_key,
  string_agg(rank || ':' || label || ':' || mentions || ':' || percent || ':' || quote_author, '|' ORDER BY rank) FILTER (polarity = 'positive') AS praise,
  string_agg(rank || ':' || label || ':' || mentions || ':' || percent || ':' || quote_author, '|' ORDER BY rank) FILTER (polarity = 'negative') AS faults,
  arg_min(label, rank) FILTER (polarity = 'positive') AS tl, arg_min(mentions, rank) FILTER (polarity = 'positive') AS tm,
  arg_min(label, rank) FILTER (polarity = 'negative') AS bl, arg_min(mentions, rank) FILTER (polarity = 'negative') AS bm,
  string_agg({advice}, '|' ORDER BY rank) FILTER (polarity = 'negative') AS recommendations FROM {found} GROUP BY ALL),
br AS (SELECT sc.*, coalesce(selected, 0) AS n, coalesce(floor(mean * 10 + 0.5) / 10, 0) AS stars, l.* EXCLUDE (scope_kind, scope_key)
  FROM sc LEFT JOIN t USING (scope_kind, scope_key) LEFT JOIN l USING (scope_kind, scope_key)),
bs AS (SELECT *, CASE WHEN n = 1 THEN 'One review of ' || subject || ', rated ' || format('{{:.1f}}', stars) || '★: '
    ELSE n || ' reviews of ' || subject || ', ' || format('{{:.1f}}', stars) || '★ on average: ' END AS intro,
  CASE WHEN n = 1 THEN '' ELSE ' (' || tm || ' of ' || n || ')' END AS ts, CASE WHEN n = 1 THEN '' ELSE ' (' || bm || ' of ' || n || ')' END AS bsup FROM br),
bz AS (SELECT *, CASE WHEN n = 0 THEN 'No reviews of ' || subject || ' were selected.'
  WHEN tl = bl THEN intro || 'opinions differ most on ' || {low_t} || ' (' || tm || ' for, ' || bm || ' against).'
  WHEN tl IS NOT NULL AND bl IS NOT NULL THEN intro || {low_t} || ' is praised most' || ts || '; ' || {low_b} || ' is faulted most' || bsup || '.'
  WHEN tl IS NOT NULL THEN intro || {low_t} || ' is praised most' || ts || '. No recurring complaints have enough support between these dates.'
  WHEN bl IS NOT NULL THEN intro || {low_b} || ' is faulted most' || bsup || '. Too little praise has support between these dates.'
  ELSE intro || 'no theme has enough support; the reviews differ.' END AS summary FROM bs)"""
RULE_LISTS = LISTS.format(found="fq", advice="advice", low_t="tl", low_b="bl")
_BRIEF = """bz.scope_kind, bz.scope_key, subject, n AS review_count, stars AS average_rating, summary,
  coalesce(praise, '') AS praise, coalesce(faults, '') AS faults, coalesce(recommendations, '') AS recommendations"""
ORACLE["briefs_rules"] = _with(*RULES, QUOTES, SCOPES, RULE_LISTS, PROMO) + f"""SELECT {_BRIEF}, note AS promotion_note
  FROM bz LEFT JOIN gn USING (scope_kind, scope_key)"""
SHOWN = """fs AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_key, trim(quote)
    ORDER BY CASE polarity WHEN 'positive' THEN 0 ELSE 1 END, rank) = 1 AND trim(quote) <> '' AS shown FROM fq),
fb AS (SELECT scope_kind, scope_key, polarity, rank, '### ' || label || chr(10) || chr(10) || '- Support: ' || mentions || ' of ' || selected || ' reviews (' || percent || '%)'
  || CASE WHEN shown THEN chr(10) || '- Quote: "' || quote || '" (' || coalesce(nullif(trim(quote_author), ''), 'Anonymous') || ')' ELSE '' END AS block, advice FROM fs),
fl AS (SELECT scope_kind, scope_key, string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (polarity = 'positive') AS pb,
  string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (polarity = 'negative') AS nb,
  string_agg(rank || '. ' || advice, chr(10) ORDER BY rank) FILTER (polarity = 'negative') AS steps FROM fb GROUP BY ALL)"""
_NL = "chr(10) || chr(10)"
ORACLE["briefs_reports"] = _with(*RULES_W, QUOTES, SCOPES, RULE_LISTS, PROMO, SHOWN) + f"""SELECT bz.scope_kind, bz.scope_key,
  '# Feedback brief: ' || subject || {_NL} || 'Scope: ' || bz.scope_kind || chr(10) || 'Window: Feb 1, 2026 to Apr 30, 2026' || chr(10)
  || 'Analysed reviews: ' || n || chr(10) || 'Mean rating: ' || format('{{:.1f}}', stars) || ' of 5'
  || CASE WHEN bz.scope_kind = 'category' THEN {_NL} || '> Counts and shares are of the whole category.' ELSE '' END
  || {_NL} || '## Summary' || {_NL} || summary
  || {_NL} || '## Strengths' || {_NL} || coalesce(pb, 'No strength had enough support.')
  || {_NL} || '## Issues' || {_NL} || coalesce(nb, 'No issue had enough support.')
  || CASE WHEN note IS NULL THEN '' ELSE {_NL} || '## Promotions' || {_NL} || note || chr(10)
    || chr(10) || '- Promoted: ' || promo_count || CASE WHEN promo_count = 1 THEN ' review, ' ELSE ' reviews, ' END || format('{{:.1f}}', promo_average) || ' of 5'
    || chr(10) || '- Full price: ' || full_price_count || CASE WHEN full_price_count = 1 THEN ' review, ' ELSE ' reviews, ' END || format('{{:.1f}}', full_price_average) || ' of 5'
    || CASE WHEN promotions <> '' THEN chr(10) || '- Seen: ' || promotions ELSE '' END END
  || {_NL} || '## Recommended checks' || {_NL} || coalesce(steps, 'No actions, since no recurring issues had enough support.')
  || {_NL} || '---' || {_NL} || 'Made on Aug 2, 2026.' || chr(10) AS report
  FROM bz LEFT JOIN fl USING (scope_kind, scope_key) LEFT JOIN gn USING (scope_kind, scope_key)"""

# -- tag engine ---------------------------------------------------------------

_BASE = "CASE {i} WHEN 0 THEN 'battery' WHEN 1 THEN 'price' WHEN 2 THEN 'pack' ELSE 'speed' END"
E0 = f"""e0 AS (SELECT *, CASE (doc_id // 4) % 3 WHEN 0 THEN own WHEN 1 THEN '  ' || upper(own[1]) || own[2:] || '  Issue ' ELSE upper(own) || ' POINT' END AS theme_0
  FROM (SELECT doc_id, text, doc_id // 10 AS batch_id, {_BASE.format(i='doc_id % 4')} AS own,
  {_BASE.format(i='(doc_id // 5) % 4')} || CASE WHEN (doc_id // 3) % 2 = 0 THEN '' ELSE ' issue' END AS theme_1,
  CASE WHEN (doc_id * 7) % 5 >= 3 THEN 'praise' WHEN (doc_id * 7) % 5 <= 1 THEN 'fault' ELSE 'neutral' END AS mood_0,
  CASE WHEN (doc_id * 7) % 5 <= 1 THEN 'praise' ELSE 'fault' END AS mood_1,
  substr(text, 1, 12) || CASE WHEN doc_id % 7 = 0 OR (doc_id // 10) % 29 = 7 THEN '#~' ELSE '' END AS proof_0,
  CASE WHEN (doc_id // 10) % 29 = 7 THEN '#~' WHEN doc_id % 2 = 0 THEN right(text, 10) ELSE substr(text, length(text) // 3 + 1, 20) END AS proof_1
  FROM documents)),
e1 AS (SELECT doc_id, batch_id, 0 AS e, 'd' || doc_id AS review_id, theme_0 AS theme, mood_0 AS sentiment, proof_0 AS evidence FROM e0
  UNION ALL SELECT doc_id, batch_id, 1, 'd' || doc_id, theme_1, mood_1, proof_1 FROM e0
  UNION ALL SELECT doc_id, batch_id, 2, 'd' || doc_id, upper(theme_0), mood_0, substr(text, 3, 5) FROM e0 WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, batch_id, 3,
    CASE doc_id % 9 WHEN 1 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN 'x' || doc_id ELSE 'd' || doc_id END,
    CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN '  ' ELSE own END,
    CASE doc_id % 9 WHEN 1 THEN NULL WHEN 4 THEN NULL WHEN 3 THEN 'angry' ELSE mood_0 END,
    CASE doc_id % 9 WHEN 1 THEN NULL WHEN 4 THEN NULL ELSE proof_0 END FROM e0 WHERE doc_id % 9 <= 5),
en AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id, e) - 1 AS entry_pos FROM e1),
rs AS (SELECT DISTINCT batch_id, NOT (batch_id % 17 = 5 OR batch_id % 19 = 3) AS usable FROM e1),
ee AS (SELECT batch_id, CAST(entry_pos AS INTEGER) AS entry_pos, review_id, theme, sentiment, evidence,
  coalesce(review_id <> '' AND {_trim('theme')} <> '' AND sentiment IN ('praise', 'fault', 'neutral') AND evidence <> '', false) AS well_formed
  FROM en JOIN rs USING (batch_id) WHERE usable AND batch_id % 23 <> 4)"""
V = f"""gr AS (SELECT ee.*, {_key('theme')} AS theme_key FROM ee JOIN documents d ON ee.review_id = 'd' || d.doc_id
  WHERE well_formed AND contains(d.text, evidence) AND batch_id = doc_id // 10 + CASE WHEN doc_id % 13 = 5 THEN 1 ELSE 0 END),
v AS (SELECT batch_id, min(entry_pos) AS entry_pos, review_id, arg_min({_trim('theme')}, entry_pos) AS theme, theme_key, sentiment,
  arg_min(evidence, entry_pos) AS evidence, count(*) AS copies FROM gr GROUP BY batch_id, review_id, theme_key, sentiment)"""
O = """oc AS (SELECT batch_id, usable, coalesce(n, 0) AS entries, coalesce(ok, 0) AS valid, CAST(coalesce(dup, 0) AS BIGINT) AS deduped
  FROM rs LEFT JOIN (SELECT batch_id, count(*) AS n FROM ee GROUP BY 1) USING (batch_id)
  LEFT JOIN (SELECT batch_id, count(*) AS ok, sum(copies - 1) AS dup FROM v GROUP BY 1) USING (batch_id)),
o AS (SELECT *, entries - valid - deduped AS rejected FROM oc)"""
ORACLE["tags_entries"] = _with(E0) + "SELECT * FROM ee"
ORACLE["tags_valid"] = _with(E0, V) + "SELECT * FROM v"
ORACLE["tags_outcomes"] = _with(E0, V, O) + """SELECT *, CASE WHEN NOT usable THEN 'unusable' WHEN valid = 0 AND rejected > 0 THEN 'all_rejected'
  WHEN rejected + deduped > 0 THEN 'not_strict' ELSE 'clean' END AS verdict FROM o"""
ORACLE["tags_input_problems"] = """WITH raw AS (SELECT CASE WHEN doc_id % 23 = 0 THEN ' ' ELSE 'r' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) END AS review_id,
  CASE WHEN doc_id % 31 = 0 THEN ' ' ELSE text END AS text FROM documents)
SELECT CASE WHEN trim(review_id) = '' THEN 'blank_id' ELSE 'blank_text' END AS problem, review_id, CAST(1 AS BIGINT) AS rows FROM raw
  WHERE trim(review_id) = '' OR trim(text) = ''
UNION ALL SELECT 'repeated_id', review_id, count(*) FROM raw WHERE trim(review_id) <> '' GROUP BY review_id HAVING count(*) > 1"""
_ANY = lambda words: "'(^|[^a-z0-9])(" + "|".join(words) + ")([^a-z0-9]|$)'"
_MARKED = " UNION ALL ".join(
    f"SELECT review_id, piece, {_q(t.label)} AS theme FROM pieces WHERE regexp_matches(piece, {_ANY(t.keywords)}, 'i')"
    for t in VOCABULARY)
ORACLE["tags_by_keyword"] = _with(R) + f""", pieces AS (SELECT review_id, unnest({PIECES}) AS piece FROM r), marked AS ({_MARKED})
SELECT review_id, theme, CASE WHEN regexp_matches(piece, {_ANY(['the', 'le', 'el', 'der'])}, 'i') THEN 'praise'
    WHEN regexp_matches(piece, {_ANY(['of', 'les', 'los', 'das'])}, 'i') THEN 'fault' ELSE 'neutral' END AS sentiment,
  count(*) AS tags, CAST(sum(length(piece)) AS BIGINT) AS evidence_chars FROM marked GROUP BY ALL"""
_PLACED = "pl AS (SELECT review_id, row_number() OVER (ORDER BY review_date, row_pos) - 1 AS sel_pos FROM r)"
ORACLE["tags_coverage"] = _with(R, _PLACED) + """, held AS (SELECT review_id, row_number() OVER (ORDER BY sel_pos) - 1 AS place FROM
    (SELECT *, unnest(range(CASE WHEN sel_pos % 97 = 5 THEN 0 WHEN sel_pos % 89 = 3 THEN 2 ELSE 1 END)) FROM pl))
SELECT CASE WHEN sel_pos % 97 = 5 THEN 'missing' ELSE 'duplicated' END AS problem, review_id FROM pl WHERE sel_pos % 97 = 5 OR sel_pos % 89 = 3
UNION ALL SELECT DISTINCT 'out_of_order', held.review_id FROM held JOIN pl ON place = sel_pos WHERE held.review_id <> pl.review_id
  AND (SELECT count(*) FROM held) = (SELECT count(*) FROM pl)"""
ORACLE["tags_coverage_order"] = _with(R, _PLACED) + "SELECT 'out_of_order' AS problem, review_id FROM pl WHERE sel_pos % 10 IN (0, 1)"

G = """gt AS (SELECT s.scope_kind, s.scope_key, s.review_date, s.row_pos, v.* FROM v JOIN s USING (review_id))"""
L = """lf AS (SELECT scope_kind, scope_key, theme_key, arg_min(theme, (review_date, row_pos, entry_pos)) AS label,
  min((review_date, row_pos, entry_pos)) AS first_at FROM gt GROUP BY ALL),
ls AS (SELECT scope_kind, scope_key, theme_key, label, row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY first_at, theme_key) - 1 AS label_pos FROM lf)"""
LC = """ln AS (SELECT *, count(*) OVER (PARTITION BY scope_kind, scope_key) AS n FROM ls),
lp AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY CASE WHEN n > 8 THEN label ELSE '' END, label_pos) - 1 AS spot FROM ln),
lc AS (SELECT *, split_part(lower(label), ' ', 1) AS word, CAST(spot // 8 AS INTEGER) AS chunk, CAST(spot % 8 AS INTEGER) AS idx FROM lp)"""
LM = """m0 AS (SELECT *, arg_min(label, idx) OVER (PARTITION BY scope_kind, scope_key, chunk, word) AS rep,
  min(idx) OVER (PARTITION BY scope_kind, scope_key, chunk, word) AS rep_idx,
  max(chunk) OVER (PARTITION BY scope_kind, scope_key) AS last FROM lc),
m1 AS (SELECT scope_kind, scope_key, label, arg_min(label, (chunk, rep_idx)) OVER (PARTITION BY scope_kind, scope_key, word) AS rep
  FROM m0 WHERE last > 0 AND label = rep),
lm AS (SELECT scope_kind, scope_key, 0 AS level, label, rep AS representative FROM m0 UNION ALL SELECT scope_kind, scope_key, 1, label, rep FROM m1)"""
CT = """cm AS (SELECT ls.*, arg_min(label, label_pos) OVER (PARTITION BY scope_kind, scope_key, split_part(lower(label), ' ', 1)) AS canonical FROM ls),
ct AS (SELECT gt.*, canonical AS canonical_theme, """ + _key("canonical") + """ AS canonical_key FROM gt JOIN cm USING (scope_kind, scope_key, theme_key))"""
TAGS = [R, P, S, E0, V, G, L]
ORACLE["labels_distinct"] = _with(*TAGS) + "SELECT * FROM ls"
ORACLE["labels_chunks"] = _with(*TAGS, LC) + "SELECT scope_kind, scope_key, label, chunk, idx FROM lc"
ORACLE["labels_problems"] = """WITH c AS (SELECT 'category' AS scope_kind, role AS scope_key, CAST(conv_id // 50 AS INTEGER) AS chunk, text AS label FROM conversations)
SELECT scope_kind, scope_key, chunk, md5(label) AS label, CASE WHEN trim(label) = '' THEN 'blank' ELSE 'too_long' END AS problem FROM c
  WHERE trim(label) = '' OR length(label) + length(regexp_replace(label, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 120
UNION ALL SELECT scope_kind, scope_key, chunk, md5(label), 'repeated' FROM c GROUP BY scope_kind, scope_key, chunk, label HAVING count(*) > 1
UNION ALL SELECT scope_kind, scope_key, chunk, md5(''), CASE WHEN count(*) > 100 THEN 'too_many' ELSE 'too_large' END FROM c
  GROUP BY scope_kind, scope_key, chunk HAVING count(*) > 100 OR sum(strlen(CAST(to_json(label) AS VARCHAR)) + 1) + 12 > 30000"""
ORACLE["labels_grouping_problems"] = _with(*TAGS, LC) + """SELECT scope_kind, scope_key, chunk, CASE kind
    WHEN 0 THEN CASE WHEN words = 1 THEN 'no_groups' ELSE 'not_covered' END
    WHEN 1 THEN CASE WHEN words + 1 > labels THEN 'more_groups_than_labels' ELSE 'repeated' END
    WHEN 2 THEN 'out_of_range' ELSE CASE WHEN words + 1 > labels THEN 'more_groups_than_labels' ELSE 'empty_group' END END AS problem
  FROM (SELECT scope_kind, scope_key, chunk, ascii(right(scope_key, 1)) % 5 AS kind, count(DISTINCT word) AS words, count(*) AS labels
    FROM lc GROUP BY ALL) WHERE kind < 4"""
ORACLE["labels_map"] = _with(*TAGS, LC, LM) + "SELECT * FROM lm"
ORACLE["labels_failed_scopes"] = _with(*TAGS) + """, sz AS (SELECT scope_kind, scope_key, count(*) AS offered,
  count(DISTINCT split_part(lower(label), ' ', 1)) AS words,
  CASE WHEN scope_kind = 'product' THEN ascii(right(scope_key, 1)) % 5 ELSE 4 END AS kind FROM ls GROUP BY scope_kind, scope_key)
SELECT scope_kind, scope_key, offered, CASE WHEN offered > 1 AND kind IN (0, 1) THEN 0 ELSE offered END AS mapped,
  CASE WHEN offered > 1 AND kind = 0 THEN 'level 0 labels: too_long'
    WHEN offered > 1 AND kind = 1 THEN 'level 0 grouping: ' || CASE WHEN words + 1 > offered THEN 'more_groups_than_labels' ELSE 'out_of_range' END END AS problem
FROM sz"""
ORACLE["labels_composed"] = _with(*TAGS, LC, LM) + """SELECT m0.scope_kind, m0.scope_key, m0.label, coalesce(m1.rep, m0.rep) AS canonical
  FROM m0 LEFT JOIN m1 ON m0.scope_kind = m1.scope_kind AND m0.scope_key = m1.scope_key AND m0.rep = m1.label"""
ORACLE["labels_level_problems"] = _with(*TAGS) + """SELECT *, CASE WHEN representatives >= labels THEN 'merged_nothing' ELSE 'too_many_levels' END AS problem FROM (
  SELECT scope_kind, scope_key, 0 AS level, count(*) AS labels, count(DISTINCT lower(label)) AS representatives FROM ls GROUP BY scope_kind, scope_key
  UNION ALL SELECT scope_kind, scope_key, 2, count(*), count(DISTINCT split_part(lower(label), ' ', 1)) FROM ls GROUP BY scope_kind, scope_key) WHERE labels > 6"""
ORACLE["labels_canonical"] = _with(*TAGS, CT) + """SELECT scope_kind, scope_key, canonical,
  row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY min(label_pos)) - 1 AS position FROM cm GROUP BY scope_kind, scope_key, canonical"""
ORACLE["labels_canonical_tags"] = _with(*TAGS, CT) + """SELECT scope_kind, scope_key, review_id, entry_pos, sentiment, canonical_theme, canonical_key,
  theme AS raw_theme, theme_key AS raw_key FROM ct"""
SUP = """su AS (SELECT scope_kind, scope_key, CASE sentiment WHEN 'praise' THEN 'positive' ELSE 'negative' END AS polarity,
  canonical_key AS theme_key, arg_min(canonical_theme, (review_date, row_pos, entry_pos)) AS label, count(DISTINCT review_id) AS mentions,
  arg_min(evidence, (review_date, row_pos, evidence)) AS quote, arg_min(review_id, (review_date, row_pos)) AS review_id,
  arg_min(row_pos, (review_date, row_pos)) AS row_pos FROM ct WHERE sentiment <> 'neutral' GROUP BY ALL)"""
TF = """tf AS (SELECT su.*, selected, CAST(floor(mentions / selected * 100 + 0.5) AS INTEGER) AS percent,
  CAST(row_number() OVER (PARTITION BY scope_kind, scope_key, polarity ORDER BY mentions DESC, lower(label), label) AS INTEGER) AS rank
  FROM su JOIN t USING (scope_kind, scope_key) WHERE mentions >= 2)"""
FOUND = [*TAGS, CT, SUP, T, TF]
ORACLE["tag_findings_by_scope"] = _with(*FOUND) + "SELECT * FROM tf"
ORACLE["tag_findings_below_threshold"] = _with(*TAGS, CT, SUP) + """SELECT
  scope_kind, scope_key, polarity, theme_key, label, mentions FROM su WHERE mentions < 8"""
ORACLE["tag_findings_mapping_problems"] = _with(*TAGS, CT) + """, sp AS (SELECT *, canonical_key || CASE WHEN sentiment = 'neutral' THEN '!' ELSE '' END AS ck FROM ct)
SELECT DISTINCT scope_kind, scope_key, theme_key AS raw_key, 'wrong_key' AS problem FROM sp WHERE sentiment = 'neutral'
UNION ALL SELECT DISTINCT scope_kind, scope_key, theme_key, 'never_offered' FROM sp WHERE sentiment = 'neutral'
UNION ALL SELECT scope_kind, scope_key, theme_key, 'maps_two_ways' FROM sp GROUP BY ALL HAVING count(DISTINCT ck) > 1""".replace(
    "FROM sp GROUP BY ALL", "FROM sp GROUP BY scope_kind, scope_key, theme_key")
ORACLE["tag_findings_comparison"] = _with(*FOUND, K, H, M, F0, F1) + """SELECT coalesce(a.scope_kind, b.scope_kind) AS scope_kind, coalesce(a.scope_key, b.scope_key) AS scope_key,
  coalesce(a.polarity, b.polarity) AS polarity, coalesce(a.rank, b.rank) AS rank, a.label AS tag_label, a.mentions AS tag_mentions,
  b.label AS rule_label, b.mentions AS rule_mentions FROM tf a FULL JOIN f b ON a.scope_kind = b.scope_kind AND a.scope_key = b.scope_key
  AND a.polarity = b.polarity AND a.rank = b.rank"""
TFA = f"""fq AS (SELECT tf.*, {CREDIT} AS quote_author, 'Look into ' || lower(label[1]) || label[2:] || ': named in ' || mentions || ' of ' || selected || ' reviews.' AS advice
  FROM tf JOIN r USING (row_pos))"""
_LOWER = "CASE WHEN regexp_matches(split_part({x}, ' ', 1)[2:], '[A-Z]') THEN {x} ELSE lower({x}[1]) || {x}[2:] END"
TFA = TFA.replace("lower(label[1]) || label[2:]", _LOWER.format(x="label"))
ORACLE["briefs_tags"] = _with(*FOUND, TFA, SCOPES, LISTS.format(
    found="fq", advice="advice", low_t=_LOWER.format(x="tl"), low_b=_LOWER.format(x="bl"))) + f"SELECT {_BRIEF} FROM bz"

# -- sizing -------------------------------------------------------------------

Z = """z AS (SELECT scope_kind, scope_key, count(*) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes FROM s GROUP BY ALL),
zo AS (SELECT *, CAST(floor(rows * 100.0::DOUBLE + text_bytes * 0.31::DOUBLE + 0.5) AS BIGINT) AS output_tokens FROM z)"""
ORACLE["sizing_density"] = _with(R, P, S, Z) + "SELECT *, output_tokens / rows AS tokens_per_row FROM zo"
B = """n AS (SELECT scope_kind, scope_key, review_id, strlen(text) AS text_bytes,
  row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY review_date, row_pos) - 1 AS sel_pos FROM s),
bt AS (SELECT *, 0::BIGINT AS batch_no, 1 AS held, text_bytes AS used FROM n WHERE sel_pos = 0
  UNION ALL SELECT n.*, CASE WHEN full_up THEN bt.batch_no + 1 ELSE bt.batch_no END, CASE WHEN full_up THEN 1 ELSE bt.held + 1 END,
    CASE WHEN full_up THEN n.text_bytes ELSE bt.used + n.text_bytes END
  FROM bt JOIN n ON n.scope_kind = bt.scope_kind AND n.scope_key = bt.scope_key AND n.sel_pos = bt.sel_pos + 1,
    LATERAL (SELECT bt.held = 12 OR bt.used + n.text_bytes > 16384 AS full_up))"""
_BWITH = "WITH RECURSIVE " + ",\n".join([R, P, S, B])
ORACLE["sizing_batches"] = _BWITH + """ SELECT scope_kind, scope_key, batch_no, sel_pos, review_id, text_bytes,
  text_bytes > 16384 AS oversized FROM bt"""
ORACLE["sizing_estimates"] = _BWITH + ",\n" + Z + """,
fb AS (SELECT scope_kind, scope_key, max(batch_no) + 1 AS filled FROM bt GROUP BY ALL),
c1 AS (SELECT *, greatest(CAST(ceil(rows / 3) AS BIGINT), filled) AS batches, CAST(ceil(output_tokens / 61 * 0.5::DOUBLE) AS BIGINT) AS l0 FROM zo JOIN fb USING (scope_kind, scope_key)),
c2 AS (SELECT *, CAST(ceil(l0 / 300) AS BIGINT) AS q0, CASE WHEN ceil(l0 / 300) > 1 AND ceil(l0 * 0.6::DOUBLE) < l0 THEN CAST(ceil(l0 * 0.6::DOUBLE) AS BIGINT) ELSE 0 END AS l1 FROM c1),
c3 AS (SELECT *, CAST(ceil(l1 / 300) AS BIGINT) AS q1, CASE WHEN ceil(l1 / 300) > 1 AND ceil(l1 * 0.6::DOUBLE) < l1 THEN CAST(ceil(l1 * 0.6::DOUBLE) AS BIGINT) ELSE 0 END AS l2 FROM c2),
c4 AS (SELECT *, CAST(ceil(l2 / 300) AS BIGINT) AS q2, text_bytes * 0.44::DOUBLE + batches * 760 AS ti FROM c3),
c5 AS (SELECT *, q0 + q1 + q2 AS label_requests, q0 = 1 OR q1 = 1 OR q2 = 1 OR l0 = 0 AS labels_fit,
  ti / 1e6::DOUBLE * 5 + output_tokens / 1e6::DOUBLE * 25 AS tagging_usd,
  ((l0 + l1 + l2) * 6 + (q0 + q1 + q2) * 760) / 1e6::DOUBLE * 5 + (l0 + l1 + l2) * 3 / 1e6::DOUBLE * 25 AS label_usd FROM c4),
c6 AS (SELECT *, tagging_usd * 0.1::DOUBLE AS retry_usd, tagging_usd + label_usd + tagging_usd * 0.1::DOUBLE AS total_usd FROM c5)
SELECT scope_kind, scope_key, rows, text_bytes, output_tokens, round(output_tokens / rows, 8) AS tokens_per_row, batches, l0 AS labels,
  CAST(label_requests AS BIGINT) AS label_requests, labels_fit, round(tagging_usd, 8) AS tagging_usd, round(label_usd, 8) AS label_usd,
  round(retry_usd, 8) AS retry_usd, round(total_usd, 8) AS total_usd,
  CASE WHEN rows > 600 THEN 'refuse_rows' WHEN NOT labels_fit THEN 'refuse_labels' WHEN total_usd > 0.5 THEN 'confirm' ELSE 'go' END AS decision FROM c6"""

# -- evaluation ---------------------------------------------------------------

ORACLE["evaluate_validity"] = _with(E0, V, O) + """SELECT 'run1' AS run_id, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(rejected) AS BIGINT) AS rejected,
  sum(valid) / (sum(valid) + sum(rejected)) AS evidence_validity FROM o"""
ORACLE["evaluate_mixed"] = _with(E0, V) + """, lb AS (SELECT 'd' || doc_id AS review_id, CASE doc_id % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'praise-only' ELSE 'fault-only' END AS kind,
  substr(text, 1, length(text) // 2) AS pc, substr(text, length(text) // 2 + 1) AS fc FROM documents),
x AS (SELECT * FROM lb JOIN v USING (review_id)),
hit AS (SELECT count(DISTINCT a.review_id) AS n FROM x a JOIN x b USING (review_id) WHERE a.kind = 'mixed' AND a.sentiment = 'praise'
  AND contains(a.pc, a.evidence) AND b.sentiment = 'fault' AND contains(b.fc, b.evidence) AND a.theme_key <> b.theme_key)
SELECT (SELECT count(*) FROM lb WHERE kind = 'mixed') AS mixed_reviews, (SELECT n FROM hit) AS mixed_hits,
  (SELECT count(*) FROM x WHERE kind = 'mixed' AND (sentiment = 'praise' AND contains(fc, evidence) OR sentiment = 'fault' AND contains(pc, evidence))) AS misattributed,
  (SELECT count(*) FROM x WHERE kind = 'praise-only' AND sentiment = 'fault' OR kind = 'fault-only' AND sentiment = 'praise') AS control_violations,
  (SELECT n FROM hit) / (SELECT count(*) FROM lb WHERE kind = 'mixed') AS mixed_recall"""
ORACLE["evaluate_merging"] = _with(E0, V) + """, c AS (SELECT 'd' || doc_id AS review_id, doc_id, lang FROM documents),
pr AS (SELECT a.lang = b.lang AS same, list_has_any(coalesce(ka, []), coalesce(kb, [])) AS merged FROM
  (SELECT c.*, ks AS ka FROM c LEFT JOIN (SELECT review_id, list(DISTINCT theme_key) AS ks FROM v GROUP BY 1) USING (review_id)) a
  JOIN (SELECT c.*, ks AS kb FROM c LEFT JOIN (SELECT review_id, list(DISTINCT theme_key) AS ks FROM v GROUP BY 1) USING (review_id)) b ON a.doc_id < b.doc_id)
SELECT count(*) FILTER (same) AS same_pairs, count(*) FILTER (same AND merged) AS same_merged, count(*) FILTER (NOT same) AS cross_pairs,
  count(*) FILTER (NOT same AND merged) AS cross_merged, count(*) FILTER (same AND merged) / count(*) FILTER (same) AS true_merge_rate,
  count(*) FILTER (NOT same AND merged) / count(*) FILTER (NOT same) AS false_merge_rate FROM pr"""
ORACLE["evaluate_stability"] = _with(E0, V) + """, ks AS (SELECT source AS model, lang AS fixture, doc_id % 3 AS run, list(DISTINCT theme_key) AS k
  FROM v JOIN documents ON v.review_id = 'd' || doc_id GROUP BY ALL),
j AS (SELECT a.model, a.fixture, avg(len(list_intersect(a.k, b.k)) / len(list_distinct(a.k || b.k))) AS stability
  FROM ks a JOIN ks b ON a.model = b.model AND a.fixture = b.fixture AND a.run < b.run GROUP BY ALL)
SELECT model, fixture, runs, round(stability, 9) AS stability FROM (SELECT model, fixture, count(*) AS runs FROM ks GROUP BY ALL) LEFT JOIN j USING (model, fixture)"""
ORACLE["evaluate_runs"] = """WITH x AS (SELECT event_type AS model, 'f' || (user_id % 3) AS fixture, event_id % 1000 AS i, user_id AS o,
  CAST(floor(value * 10) AS BIGINT) AS ms, value > 50 AS late, event_id % 50 = 0 AS bad, event_id % 7 = 0 AS cut, event_id % 31 = 0 AS pe FROM events)
SELECT model, fixture, count(*) AS runs, avg(i) AS avg_input_tokens, avg(o) AS avg_output_tokens,
  round(avg(i / 1e6::DOUBLE * length(model) + o / 1e6::DOUBLE * (length(model) * 2)), 9) AS avg_cost_usd, max(ms) AS max_latency_ms,
  count(*) FILTER (late) AS timeouts, count(*) FILTER (bad) AS errors, count(*) FILTER (cut) AS truncated, count(*) FILTER (pe) AS parse_errors,
  list_sort(list(ms))[count(*) // 2 + 1] AS middle_latency_ms FROM x GROUP BY ALL"""
ORACLE["evaluate_stability_of_sound_runs"] = ORACLE["evaluate_stability"].replace("FROM v JOIN documents ON v.review_id = 'd' || doc_id GROUP BY ALL)", """FROM v
  JOIN documents ON v.review_id = 'd' || doc_id
  WHERE (source, lang, doc_id % 3) NOT IN (SELECT (source, lang, doc_id % 3) FROM documents WHERE doc_id % 500 = 7 OR doc_id % 700 = 9) GROUP BY ALL)""")
ORACLE["evaluate_run_quality"] = """WITH x AS (SELECT event_type AS model, 'f' || (user_id % 3) AS fixture, event_id % 1000 AS i,
  CASE WHEN event_id % 7 = 0 THEN 'max_tokens' ELSE 'end' END AS stop FROM events)
SELECT model, fixture, string_agg(DISTINCT stop, ',' ORDER BY stop) AS stop_reasons, round(avg(CASE WHEN i % 3 > 0 THEN (i % 11) / 10 END), 9) AS avg_evidence_validity,
  round(avg(i % 17), 9) AS avg_distinct_themes, round(avg(CASE WHEN i % 4 = 0 THEN (i % 2) / 2 END), 9) AS avg_mixed_recall,
  round(avg(CASE WHEN i % 5 = 0 THEN i % 3 END), 9) AS avg_misattributed FROM x GROUP BY ALL"""
# -- files, gates and empty scopes ---------------------------------------------

ORACLE["ingest_text_sample_of_reviews"] = _with(R) + f"""SELECT row_pos, review_id, text_bytes, CAST(total AS BIGINT) AS total_bytes FROM (
  SELECT row_pos, review_id, text_bytes, sum(text_bytes) OVER (ORDER BY row_pos) AS total,
    sum(body + 1) OVER (ORDER BY row_pos) + 13 AS request FROM (
    SELECT row_pos, review_id, strlen({_trim('text')}) AS text_bytes, strlen(CAST(json_object('id', review_id, 'text', {_trim('text')}) AS VARCHAR)) AS body
    FROM r WHERE {_trim('text')} <> '' ORDER BY 1 LIMIT 12))
  WHERE total <= 204800 AND request <= 256000"""
ORACLE["ingest_gate"] = _INGEST + """SELECT 'all' AS selection, true AS usable, count(*) AS parsed, count(*) FILTER (reject_reason IS NULL) AS accepted FROM cls
  UNION ALL SELECT 'without_id', false, count(*), 0 FROM cls WHERE review_id = ''"""
ORACLE["sources_export_files"] = ORACLE["ingest_export_reviews"]
ORACLE["sources_preferred"] = _with(EXP) + """SELECT 'Parts' AS dataset_label, false AS is_synthetic, count(*) AS rows, count(DISTINCT product_id) AS products FROM z
  UNION ALL SELECT 'Synthetic product records', true, count(*), count(DISTINCT product_id) FROM z"""
ORACLE["sources_samples"] = _with(R) + """SELECT 'sample' AS source, count(*) AS rows, CAST(sum(stars) AS BIGINT) AS stars FROM (VALUES (5), (4), (1), (2), (3), (5), (4), (2)) x(stars)
  UNION ALL SELECT 'uploaded', count(*), CAST(sum(rating) AS BIGINT) FROM r"""
ORACLE["sources_labelled_sets"] = """SELECT 'd' || doc_id AS review_id, CASE doc_id % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'praise-only' ELSE 'fault-only' END AS kind,
  lang AS cluster, md5(substr(text, 1, length(text) // 2)) AS praise_md5, doc_id % 11 = 0 AS wrong FROM documents"""
ORACLE["sources_results"] = ORACLE["themes_findings"]
ORACLE["scopes_windows"] = _with(R) + """, e AS (SELECT min(review_date) AS a, max(review_date) AS b, (max(review_date) - min(review_date)) // 4 AS q FROM r)
SELECT 'upright' AS "window", count(*) AS rows FROM r, e WHERE review_date BETWEEN a + CAST(q AS INTEGER) AND b - CAST(q AS INTEGER)
UNION ALL SELECT 'inverted', NULL"""
ORACLE["briefs_record_actions"] = _with(EXP, RECORDS, S, f"k(theme, theme_key, label, kw, advice) AS (VALUES {_PART_VALUES})", H, M, T,
  F0.replace("HAVING count(*) >= 2", "").replace("review_date, row_pos", "row_pos"), F1) + """, a AS (SELECT scope_kind, scope_key,
  string_agg(rank || '. ' || advice, chr(10) ORDER BY rank) AS steps FROM f WHERE polarity = 'negative' GROUP BY ALL)
SELECT DISTINCT s.scope_kind, s.scope_key, coalesce(steps, 'No actions can be derived: each rating is an average, and an average hides single complaints.') AS actions
  FROM s LEFT JOIN a USING (scope_kind, scope_key)"""
ORACLE["tags_from_files"] = ORACLE["tags_entries"]
ORACLE["tags_valid_from_buckets"] = ORACLE["tags_valid"]
ORACLE["tag_findings_scarce"] = ORACLE["tag_findings_below_threshold"].replace("mentions < 8", "mentions < 60")
ORACLE["briefs_tags_of_few"] = ORACLE["briefs_tags"].replace("WHERE well_formed AND contains", "WHERE well_formed AND d.lang = 'de' AND contains")

# -- columns ------------------------------------------------------------------

ORACLE["columns_phrases"] = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'sound  quality' WHEN 1 THEN 'USB port' WHEN 2 THEN 'GaN charger' WHEN 3 THEN ' fit ' ELSE 'x' END AS inside_sentence,
  CASE doc_id % 5 WHEN 0 THEN 'sound quality' WHEN 1 THEN 'usb port' WHEN 2 THEN 'gan charger' WHEN 3 THEN 'fit' ELSE 'x' END AS label_key,
  strftime(DATE '2026-01-01' + CAST(doc_id AS INTEGER), '%b %-d, %Y') AS short_date, lang || '>a b>' || source AS path, lang AS top, source AS leaf,
  coalesce(CASE WHEN doc_id % 4 = 0 THEN 'Ann' END, CASE WHEN doc_id % 3 = 0 THEN 'Verified buyer' ELSE 'Buyer' END || CASE WHEN doc_id % 2 = 0 THEN ' · ' || upper(lang) ELSE '' END) AS credit,
  format('{:,}', doc_id) || CASE WHEN doc_id = 1 THEN ' product record' ELSE ' product records' END AS counted FROM documents"""

ORACLE["columns_short_labels"] = """WITH full_title AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations),
chars AS (SELECT conv_id, turn, i, t[i] AS c, CASE t[i] WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END AS d FROM full_title, unnest(range(1, length(t) + 1)) AS x(i)),
sums AS (SELECT *, sum(d) OVER w AS s FROM chars WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
low AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY conv_id, turn ORDER BY i)) AS depth FROM sums),
seen AS (SELECT conv_id, turn, string_agg(CASE WHEN depth - CASE c WHEN '(' THEN 1 ELSE 0 END > 0 THEN '_' ELSE c END, '' ORDER BY i) AS m FROM low GROUP BY ALL),
cut AS (SELECT f.*, length(regexp_extract(coalesce(m, ''), '(?i)^(.{27,}?[^ ,–—|-])[ ,–—|-]*?(?:,| ?\\|| ?\\(| [-–—] | with | for )', 1)) AS k,
  substr(t, 1, 63) AS front FROM full_title f LEFT JOIN seen USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN length(t) <= 64 THEN t WHEN k BETWEEN 1 AND 64 THEN t[:k]
  ELSE regexp_replace(coalesce(nullif(regexp_extract(front, '^(.{29,}) [^ ]*$', 1), ''), front), '[ ,–—|-]+$', '') || '…' END AS short_label FROM cut"""
