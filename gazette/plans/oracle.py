"""The listing queries in DuckDB's SQL, written apart from the Spark code.

Shared with it are only the input: the SQL that cuts the feeds from the test tables, the static
pages and the list of routes.
"""

from __future__ import annotations

from gazette.plans.queries import PAGES, ROUTES
from gazette.sources.adapters import SQL


# The white space of feeds; the patterns of _strict(), _lenient() and _number(); the URL kinds of KIND below.
WHITE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def _initials(x: str) -> str:
    return _or(f"upper(array_to_string(list_transform(string_split_regex({_trim(x)}, '{WHITE}+')[1:2], lambda w: w[1:1]), ''))", "'??'")


def _date(x: str) -> str:
    y, m, d = (f"try_cast(split_part({x}, '-', {i}) AS INT)" for i in (1, 2, 3))
    return f"CASE WHEN {y} BETWEEN 1 AND 275760 AND {m} BETWEEN 1 AND 3309120 AND {d} BETWEEN 1 AND 200000000 THEN CAST(make_date(CASE WHEN {y} < 100 THEN {y} + 1900 ELSE {y} END, 1, 1) + to_months({m} - 1) + to_days({d} - 1) AS TIMESTAMP) END"


def _minutes(x: str, pattern: str) -> str:
    g = [f"regexp_extract({x}, '{pattern}', {i}, 'i')" for i in (1, 2, 3)]
    h = f"try_cast(nullif({g[0]}, '') AS INT)"
    hour = f"CASE WHEN lower({g[2]}) = 'pm' AND {h} < 12 THEN {h} + 12 WHEN lower({g[2]}) = 'am' AND {h} = 12 THEN 0 ELSE {h} END"
    return f"(({hour}) * 60 + coalesce(try_cast(nullif({g[1]}, '') AS INT), 0))"


def _strict(x: str) -> str:
    kept = f"trim(regexp_replace({x}, '[^0-9:apm ]', '', 'gi'))"
    return "coalesce(" + _minutes(kept, r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$") + ", 0)"


def _lenient(x: str) -> str:
    return "coalesce(" + _minutes(x, rf"(\d{{1,2}}):?(\d{{2}})?{WHITE}*(am|pm)?") + ", 9999)"


def _or(x: str, otherwise: str) -> str:
    return f"coalesce(nullif({x}, ''), {otherwise})"


def _number(x: str) -> str:
    return rf"try_cast(nullif(regexp_extract({x}, '^{WHITE}*([+-]?\d+)', 1), '') AS INT)"


EVENTS = f"""raw_events AS ({SQL["events"]}), e AS (
  SELECT row_id, {_or("id", r"concat(start_date, '-', regexp_replace(lower(title), '\s+', '-', 'g'))")} AS id, {_or("title", "'(Untitled event)'")} AS title,
    lower({_or("category", "'other'")}) AS category, {_date("start_date")} + to_minutes({_strict("start_time")}) AS start,
    {_date(_or("end_date", "start_date"))} + to_minutes({_strict(_or("end_time", "start_time"))}) AS "end",
    start_date, location, address, district, description, contact, lower(featured) IN ('y', 'yes', 'true', '1') AS featured
  FROM raw_events WHERE {_date("start_date")} IS NOT NULL)"""
LABEL = "CASE category WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' WHEN 'purchase' THEN 'Purchase' ELSE 'Other' END"
CLOCK = "strftime({0}, '%-I:%M %p')"
TIMES = f"""CASE WHEN "end" IS NULL OR "end" = start THEN {CLOCK.format("start")} ELSE {CLOCK.format("start")} || ' – ' || {CLOCK.format('"end"')} END"""
ORDER_EVENTS = """e AS (SELECT o_orderkey AS row_id, concat('o ', o_orderkey) AS id, o_orderpriority AS title, o_orderdate AS start,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT) AS TIMESTAMP) AS "end", lower(substr(o_orderpriority, 3)) AS category FROM orders)"""


def _listing(where: str) -> str:
    return f"""WITH {EVENTS}, f AS (SELECT * FROM e WHERE {where}), both_sections AS (
  SELECT 'upcoming' AS section, CAST(NULL AS BIGINT) AS pos, * FROM f WHERE start >= TIMESTAMP '2024-01-15'
  UNION ALL SELECT * FROM (SELECT 'past' AS section, row_number() OVER (ORDER BY start DESC, row_id DESC) AS pos, * FROM f WHERE start < TIMESTAMP '2024-01-15') WHERE pos <= 6)
SELECT section, pos, row_id, id, title, category, {LABEL} AS label, start, location, district <> '' AS has_district, featured,
  CASE WHEN length(description) > 160 THEN substr(description, 1, 159) || '…' ELSE description END AS teaser, {TIMES} AS times,
  upper(strftime(start, '%b')) AS tile_month, day(start) AS tile_day, year(start) AS tile_year FROM both_sections"""


INDEX = rf"""{EVENTS}, m AS ({SQL["meetings"]}), o AS ({SQL["officers"]}), k AS ({SQL["committees"]}), d AS ({SQL["districts"]}), r AS ({SQL["resources"]}), idx AS (
  SELECT 'page' AS type, title, '' AS sub, url, false AS external, lower(title || ' ' || keywords) AS search_text, 0::BIGINT AS type_pos, n::BIGINT AS item_pos
    FROM (VALUES {", ".join(str(p) for p in PAGES)}) p(n, title, url, keywords)
  UNION ALL SELECT 'event', title, start_date || CASE WHEN location <> '' THEN ' · ' || location ELSE '' END, '#/events/' || url_encode(id), false, lower(concat_ws(' ', title, description, location, district)), 1, row_id FROM e
  UNION ALL SELECT 'person', name, position || CASE WHEN district <> '' THEN ' · District ' || district ELSE '' END, CASE WHEN email <> '' THEN 'mailto:' || email ELSE '#/officers' END, false, lower(concat_ws(' ', name, position, district)), 2, row_id FROM o WHERE name <> ''
  UNION ALL SELECT 'committee', name, purpose, '#/service', false, lower(concat_ws(' ', name, purpose, chair)), 3, row_id FROM k
  UNION ALL SELECT 'district', 'District ' || number || CASE WHEN name <> '' THEN ' — ' || name ELSE '' END, area, '#/districts', false, lower(concat_ws(' ', 'district', number, name, area, dcm)), 4, row_id FROM d
  UNION ALL SELECT 'resource', title, {_or("category", "'General'")}, {_or("url", "'#'")}, regexp_matches({_or("url", "'#'")}, '^https?://'), lower(concat_ws(' ', title, description, {_or("category", "'General'")})), 5, row_id FROM r
  UNION ALL SELECT 'meeting', name, day || ' ' || time || ' · ' || {_or("city", "address")}, '#/meetings', false,
    lower(concat_ws(' ', name, day, time, city, address, array_to_string(list_filter(list_transform(string_split_regex(types, '[|,]'), lambda x: trim(x)), lambda x: x <> ''), ' '))), 6, row_id FROM m)"""
SEARCH = rf"""asked AS (SELECT query_id, list_filter(string_split_regex(lower(q), '{WHITE}+'), lambda t: t <> '') AS toks FROM q0), hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY type_pos, item_pos) AS pos, type, title, url, type_pos, item_pos
  FROM idx JOIN asked ON len(toks) > 0 AND len(list_filter(toks, lambda t: contains(search_text, t))) = len(toks))
SELECT * FROM hits WHERE pos <= 30"""
KIND = r"""CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(url), '\.(docx?|odt)$') THEN 'word' WHEN regexp_matches(lower(url), '\.(xlsx?|csv|ods)$') THEN 'sheet'
  WHEN regexp_matches(lower(url), '\.(jpg|jpeg|png|gif|webp)$') THEN 'image' WHEN contains(lower(url), 'youtu') THEN 'video' WHEN contains(lower(url), 'docs.google.com') THEN 'doc' ELSE 'link' END"""
ANNOUNCEMENTS = f"""WITH raw_a AS ({SQL["announcements"]}), a AS (SELECT row_id, {_or("id", "title")} AS id, title, body, url, {_date("starts")} AS starts, {_date("ends")} AS ends, {_number(_or("priority", "'5'"))} AS priority FROM raw_a),
  live AS (SELECT * FROM a WHERE (starts IS NULL OR starts <= TIMESTAMP '1998-01-01') AND (ends IS NULL OR ends >= TIMESTAMP '1998-01-01'))"""
DAY_POS = "list_position(['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'], day)"
TYPES = "list_filter(list_transform(string_split_regex(types, '[|,]'), lambda x: trim(x)), lambda x: x <> '')"
MEETINGS = f"""WITH m AS ({SQL["meetings"]}) SELECT CAST({DAY_POS} AS BIGINT) AS section_pos, day, CAST({_lenient("time")} AS BIGINT) AS minutes, row_id, name, time, city, address,
  array_to_string({TYPES}, '|') AS types FROM m WHERE {DAY_POS} > 0"""
MAIL = "CASE WHEN contains(email, '@') THEN 'mailto:' || email ELSE email END"
STAMP = "strftime({0}, '%Y%m%dT%H%M%SZ')"


VEVENT = rf"""concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || id || '@example.org', 'DTSTAMP:20240101T000000Z', 'DTSTART:' || {STAMP.format("start")},
  'DTEND:' || {STAMP.format('coalesce("end", start + INTERVAL 1 hour)')}, 'SUMMARY:' || regexp_replace(title, '[\n,;]', ' ', 'g'),
  CASE WHEN location <> '' THEN 'LOCATION:' || regexp_replace(location || CASE WHEN address <> '' THEN ', ' || address ELSE '' END, '[\n,;]', ' ', 'g') END,
  CASE WHEN description <> '' THEN 'DESCRIPTION:' || regexp_replace(description, '[\n,;]', ' ', 'g') END, 'END:VEVENT')"""


def _routes() -> str:
    cases = {"/": "^/?$", "/p/:id": "^/p/([^/]+)/?$", "/item/:id": "^/item/([^/]+)/?$", "/wiki/*": "^/wiki/.*/?$", "/:section/:id": "^/([^/]+)/([^/]+)/?$", "/:section": "^/([^/]+)/?$"}
    assert list(cases) == ROUTES
    route = " ".join(f"WHEN regexp_matches(path, '{r}') THEN '{p}'" for p, r in cases.items())
    return rf"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^[a-z]+://[^/]+') || '/p/x+y%20' || page_id || '?a%20b=1+2&x=%C3%A9&x=2&=z&flag&+=' ELSE url END AS url FROM pages),
  a AS (SELECT page_id, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '') AS rest FROM u),
  b AS (SELECT page_id, {_or("regexp_extract(rest, '^([^?#]*)', 1)", "'/'")} AS path, list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '') AS pieces FROM a),
  c AS (SELECT *, CASE {route} ELSE 'not-found' END AS route, list_transform(pieces, lambda x: url_decode(replace(split_part(x, '=', 1), '+', ' '))) AS ks,
    list_transform(pieces, lambda x: url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE '' END, '+', ' '))) AS vs FROM b),
  d AS (SELECT *, list_filter(generate_series(1, len(ks)), lambda i: list_position(ks, ks[i]) = i) AS firsts FROM c)
SELECT page_id, path, route, CASE WHEN route IN ('/p/:id', '/item/:id', '/:section/:id') THEN url_decode(replace(regexp_extract(path, '([^/]+)/?$', 1), '+', '%2B')) ELSE '' END AS param_id,
  CAST(len(firsts) AS BIGINT) AS n_query, array_to_string(list_sort(list_transform(firsts, lambda i: ks[i] || '=' || vs[i])), '&') AS asked FROM d"""


ORACLE_SQL = {
    "event_listing": _listing("category IN ('click', 'view', 'purchase')"),
    "event_listing_search": _listing("category IN ('click', 'view', 'purchase', 'other') AND contains(lower(concat_ws(' ', title, location, description)), 'hall 1')"),
    "home_summary": f"""WITH {EVENTS}, u AS (SELECT * FROM e WHERE start >= TIMESTAMP '2024-01-15')
SELECT 'districts' AS kind, count(*) AS pos, '' AS name FROM nation UNION ALL SELECT 'upcoming', count(*), '' FROM u
UNION ALL SELECT * FROM (SELECT 'event', row_number() OVER (ORDER BY start, row_id) AS pos, title FROM u) WHERE pos <= 4
UNION ALL SELECT * FROM (SELECT 'committee', row_number() OVER (ORDER BY r_regionkey) AS pos, r_name FROM region) WHERE pos <= 4""",
    "calendar_items": f"""WITH {ORDER_EVENTS} SELECT row_id, id, title, start, "end", 'cat-' || category AS class, '#/events/' || url_encode(id) AS url FROM e WHERE category IN ('urgent', 'high')""",
    "calendar_days": f"""WITH {ORDER_EVENTS}, s AS (SELECT CAST(start AS DATE) AS low, CAST(CASE WHEN "end" > start THEN "end" - INTERVAL 1 microsecond ELSE start END AS DATE) AS high FROM e WHERE category IN ('urgent', 'high')),
  days AS (SELECT CAST(unnest(generate_series(low, high, INTERVAL 1 day)) AS DATE) AS day FROM s) SELECT day, count(*) AS n_items FROM days WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY day""",
    "event_detail": rf"""WITH {EVENTS} SELECT row_id, id, title, {LABEL} AS label, strftime(start, '%A, %B %-d, %Y') AS date_text, {TIMES} AS times, CASE WHEN address <> '' THEN 'https://maps.example.org/?q=' || url_encode(address) ELSE '' END AS map_url,
  contact AS contact_url, lower(substr(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), 1, 60)) AS file_stem FROM e WHERE id = 'ev-100' ORDER BY start, row_id LIMIT 1""",
    "export_calendar": rf"""WITH {EVENTS} SELECT row_id, start, {VEVENT} AS vevent FROM e WHERE start >= TIMESTAMP '2024-01-15'""",
    "event_documents": rf"""WITH {EVENTS} SELECT row_id, id, concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//gazette//EN', {VEVENT}, 'END:VCALENDAR') AS document FROM e""",
    "meeting_finder": MEETINGS,
    "meeting_finder_city": MEETINGS + " AND city = 'Brand#13'",
    "csv_feed": f"WITH m AS ({SQL['meetings']}) SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, name, day, time, address, city, district, array_to_string({TYPES}, '|') AS types, notes FROM m",
    "csv_feed_messy": r"""WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part)
SELECT row_id, p_name AS part_name, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE 'a "quoted" ' || p_name || ',' || chr(10) || '"' || p_brand || '"' || chr(10) || chr(10) || '; end' END AS description, p_partkey AS part_key,
  CASE WHEN p_partkey % 3 = 0 THEN '""' ELSE 'x,y' END AS description_1 FROM r WHERE p_partkey % 17 <> 0""",
    "feed_states": "SELECT 'events' AS feed, 0::BIGINT AS n_rows, 16::BIGINT AS n_columns UNION ALL SELECT 'resources', 0, 6 UNION ALL SELECT 'meetings', count(*), 7 FROM part",
    "no_match_states": "SELECT unnest(['events', 'meetings', 'resources', 'events_none', 'events_no_category', 'meetings_none', 'resources_none']) AS listing, unnest([false, false, false, true, true, true, true]) AS empty",
    "announcement_dismissals": ANNOUNCEMENTS + """, top AS (SELECT id FROM live ORDER BY live.priority NULLS LAST, row_id LIMIT 1)
SELECT 'nothing' AS dismissed, 1::BIGINT AS n, id FROM top UNION ALL SELECT 'others', 1, id FROM top UNION ALL SELECT 'top', 0, NULL""",
    "export_calendar_zone": rf"""WITH {ORDER_EVENTS}, z AS (SELECT *, timezone('America/New_York', start) AT TIME ZONE 'UTC' AS s, timezone('America/New_York', "end") AT TIME ZONE 'UTC' AS t FROM e WHERE start >= TIMESTAMP '1997-09-01')
SELECT row_id, start, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || id || '@example.org', 'DTSTAMP:20240101T000000Z', 'DTSTART:' || {STAMP.format("s")}, 'DTEND:' || {STAMP.format("t")}, 'SUMMARY:' || title, 'END:VEVENT') AS vevent FROM z""",
    "facet_options": f"""WITH r0 AS ({SQL["resources"]}) SELECT 0::BIGINT AS pos, 'All' AS value UNION ALL SELECT DISTINCT 1, {_or("category", "'General'")} FROM r0""",
    "meeting_finder_filtered": MEETINGS + f" AND day = 'Tuesday' AND contains(lower(concat_ws(' ', name, array_to_string({TYPES}, ' '), notes, address)), 'oak ave')",
    "facet_values": f"WITH m AS ({SQL['meetings']}) SELECT DISTINCT city AS value FROM m WHERE city <> ''",
    "resource_browser": f"""WITH r0 AS ({SQL["resources"]}), r AS (SELECT row_id, {_or("category", "'General'")} AS category, {_or("url", "'#'")} AS url, title, updated FROM r0)
SELECT min(row_id) OVER (PARTITION BY category) AS section_order, category, row_id, title, url, {KIND} AS kind, updated FROM r""",
    "resource_browser_filtered": f"""WITH r0 AS ({SQL["resources"]}), r AS (SELECT row_id, {_or("category", "'General'")} AS category, {_or("url", "'#'")} AS url, title, description, updated FROM r0)
SELECT min(row_id) OVER (PARTITION BY category) AS section_order, category, row_id, title, url, {KIND} AS kind, updated FROM r WHERE category = 'Cat 3' AND contains(lower(title || ' ' || description), 'ex')""",
    "roster": rf"""WITH o0 AS ({SQL["officers"]}), o AS (SELECT *, CASE WHEN lower(type) IN ('chair', 'dcm') THEN lower(type) ELSE 'officer' END AS section FROM o0)
SELECT CAST(list_position(['officer', 'chair', 'dcm'], section) AS BIGINT) AS section_pos, section, CAST({_number(_or("sort", "'99'"))} AS BIGINT) AS sort, row_id, {_or("name", "'Open position'")} AS name,
  {_initials("name")} AS initials, position, {MAIL} AS contact_url FROM o""",
    "district_directory": f"WITH d AS ({SQL['districts']}) SELECT CAST({_number('number')} AS BIGINT) AS order_number, row_id, number, name, area, {MAIL} AS contact_url FROM d",
    "committee_directory": f"WITH k AS ({SQL['committees']}) SELECT row_id, name, purpose, chair, meeting_schedule, {_or('icon', chr(39) + 'people' + chr(39))} AS icon, {MAIL} AS contact_url FROM k",
    "active_announcements": ANNOUNCEMENTS + " SELECT row_id, id, starts, ends, CAST(priority AS BIGINT) AS priority FROM live",
    "active_announcement_top": ANNOUNCEMENTS + " SELECT row_id, id, title, body, CASE WHEN url = '' THEN '' WHEN starts_with(url, 'http') THEN url ELSE '#' || url END AS link, CAST(priority AS BIGINT) AS priority FROM live ORDER BY live.priority NULLS LAST, row_id LIMIT 1",
    "announcement_dismissed": ANNOUNCEMENTS + """, top AS (SELECT * FROM live ORDER BY priority NULLS LAST, row_id LIMIT 1)
SELECT row_id, id, title, body, CASE WHEN url = '' THEN '' WHEN starts_with(url, 'http') THEN url ELSE '#' || url END AS link, CAST(priority AS BIGINT) AS priority
  FROM top WHERE id NOT IN (SELECT concat('an-', o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""",
    "search_index": f"WITH {INDEX} SELECT * FROM idx",
    "search_batch": f"WITH {INDEX}, q0 AS (SELECT p_partkey AS query_id, CASE WHEN (p_partkey // 20) % 5 = 0 THEN substr('k ' || p_partkey, 1, 4) ELSE substr(lower(p_name), 3, 40) || '  ' || upper(p_brand) END AS q FROM part WHERE p_partkey % 20 = 0), {SEARCH}",
    "search_appended": f"WITH {INDEX}, q0 AS (SELECT p_partkey AS query_id, CASE WHEN (p_partkey // 20) % 5 = 0 THEN substr('k ' || p_partkey, 1, 4) ELSE substr(lower(p_name), 3, 40) || '  ' || upper(p_brand) END AS q FROM part WHERE p_partkey % 20 = 0), {SEARCH}",
    "search_parts": f"WITH {INDEX}, q0 AS (SELECT p_partkey AS query_id, CASE WHEN (p_partkey // 20) % 5 = 0 THEN substr('k ' || p_partkey, 1, 4) ELSE substr(lower(p_name), 3, 40) || '  ' || upper(p_brand) END AS q FROM part), {SEARCH}",
    "search_documents": f"WITH idx AS (SELECT 'document' AS type, '' AS title, '' AS url, lower(text) AS search_text, 0::BIGINT AS type_pos, doc_id AS item_pos FROM documents), q0 AS (SELECT item_id AS query_id, substr(text, 12, 7) || CASE WHEN item_id % 2 = 0 THEN chr(160) ELSE ' ' END || substr(text, 31, 6) AS q FROM benchmark), {SEARCH}",
    "parse_datetime": f"""WITH r AS (SELECT o_orderkey AS row_id, CASE o_orderkey % 7 WHEN 0 THEN concat(year(o_orderdate), '-13-31') WHEN 1 THEN concat('98-02-', o_orderkey % 40) WHEN 2 THEN 'TBA' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d,
  CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey % 14, ':30 p.m.') WHEN 1 THEN concat(o_orderkey % 30, ':75') WHEN 2 THEN 'noon' WHEN 3 THEN concat(o_orderkey % 13, 'AM') ELSE lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') END AS t0,
  CASE WHEN o_orderkey % 11 = 0 THEN concat(o_orderkey % 13, ':05', CASE WHEN o_orderkey % 2 = 0 THEN chr(160) ELSE chr(8239) END, 'pm') ELSE t0 END AS t FROM orders)
SELECT row_id, {_date("d")} + to_minutes({_strict("t")}) AS at, CAST({_lenient("t")} AS BIGINT) AS lenient FROM r""",
    "text_scalars": rf"""SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 159) || '…' ELSE text END AS teaser,
  {_initials("named")} AS initials,
  lower(substr(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), 1, 60)) AS stem, CAST(len(list_filter(string_split_regex(text, '[|,]'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS BIGINT) AS n_tags,
  md5(regexp_replace(text, '[\n,;]', ' ', 'g')) AS plain_md5, CAST({_number("concat(CASE WHEN doc_id % 2 = 0 THEN chr(8239) || ' ' || chr(160) ELSE '' END, doc_id % 90, text)")} AS BIGINT) AS number
  FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN chr(9) || chr(12288) || replace(replace(text, chr(10), ' '), ' ', chr(160)) ELSE replace(text, chr(10), ' ') END AS named FROM documents)""",
    "date_formats": f"""WITH {ORDER_EVENTS} SELECT row_id, strftime(start, '%A, %B %-d, %Y') AS long_date, strftime(start, '%b %-d, %Y') AS short_date, {TIMES} AS times, upper(strftime(start, '%b')) AS tile_month, {STAMP.format("start")} AS stamp FROM e""",
    "route_urls": _routes(),
}
