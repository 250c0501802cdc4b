"""What the catalog's queries must return, written for DuckDB.

Each statement goes from the tables' columns straight to the expected rows; the
ones over derived corpora never look at HTML.
"""

from __future__ import annotations

from pageloom.operators.assets import FILE_TYPES
from pageloom.operators.social import PLATFORMS
from pageloom.schema import ITEM_TYPES

ORACLE: dict[str, str] = {}

_LEGAL = r"[A-Za-z0-9\-_.~$&+,/:;=?@!''()*\[\]%]*"


def _pct(s: str, plain: str = r"[A-Za-z0-9\-_.~$&+,/:;=@]") -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({s}, '(?s).'), lambda c: "
        f"CASE WHEN regexp_full_match(c, '{plain}') THEN c "
        "ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), '')"
    )


def _escaped(s: str) -> str:
    return f"CASE WHEN regexp_full_match({s}, '{_LEGAL}') THEN {s} ELSE {_pct(s)} END"


def _text(s: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        s = f"replace({s}, '&{name};', '{char}')"
    return s


def _cut(s: str, n: int, tail: str = "'...'") -> str:
    tries = ", ".join(f"try(decode(encode({s})[1:{n - k}]))" for k in range(4))
    return f"CASE WHEN strlen({s}) <= {n} THEN {s} ELSE coalesce({tries}) || {tail} END"


def _strip(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, '(<[^>]*)?>', ' ', 'g'), '<[^>]*$', '')"


_ANCHORS = r"""anchors AS (
  SELECT page_id, url, regexp_extract(url, '^(https?://[^/]*)', 1) AS origin,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS txt,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS pos
  FROM pages)"""

_LINKS = f"""{_ANCHORS}, found AS (
  SELECT page_id, url, pos, txt, origin || {_escaped("href")} AS value FROM anchors WHERE href NOT LIKE '%\\%%' ESCAPE '\\'
), page_links AS (
  SELECT page_id, value, min(pos) AS pos, any_value(url) AS url, arg_min(txt, pos) AS txt
  FROM found GROUP BY page_id, value)"""

ORACLE["links"] = f"""WITH {_LINKS}
SELECT page_id, value, url AS source_url, 'internal' AS link_type,
  nullif(trim({_text("txt")}), '') AS anchor_text, CAST(NULL AS VARCHAR) AS rel FROM page_links"""

_CANON_PAGE = """CASE WHEN url LIKE '%?%' THEN rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') || '?' ||
  split_part(split_part(url, '#', 1), '?', 2) ELSE rtrim(split_part(url, '#', 1), '/') END"""

ORACLE["link_edges"] = f"""WITH {_LINKS}
SELECT page_id, {_CANON_PAGE} AS src_url, rtrim(value, '/') AS dst_url, 'internal' AS link_type,
  row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos FROM page_links"""

ORACLE["canonical_urls"] = f"SELECT page_id, url, {_CANON_PAGE} AS canonical FROM pages"

ORACLE["unique_paths"] = """SELECT path_url, arg_min(url, page_id) AS url FROM (
  SELECT page_id, url, rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') AS path_url FROM pages)
GROUP BY path_url"""

ORACLE["allowed_domain"] = r"""SELECT page_id, url FROM pages
WHERE regexp_matches(url, '^https?://(www\.)?ththhe\.example\.com(:\d+)?(/|$)')"""

ORACLE["host_names"] = """SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages GROUP BY 1"""

ORACLE["seed_urls"] = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://' WHEN 1 THEN 'http://'
  WHEN 2 THEN 'https://' ELSE 'https://HTTP://' END || 'shop.test/c/' || c_custkey AS url FROM customer"""

ORACLE["url_extensions"] = r"""SELECT page_id, lower(nullif(regexp_extract(
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '\.[^./]*$', 0), '')) AS extension FROM pages"""

_RESOLVED = {
    "/a/b": "o || '/a/b'",
    "//cdn.test/x": "split_part(url, ':', 1) || '://cdn.test/x'",
    "https://h.test/y?q#f": "'https://h.test/y?q#f'",
    "/a/./b/../c": "o || '/a/c'",
    "/../up": "o || '/up'",
    "/sp ace!": "o || '/sp%20ace%21'",
    "mailto:a@b.co": "'mailto:a@b.co'",
    "/x?q=a b#fr": "o || '/x?q=a b#fr'",
    "a:b:c": "'a:b:c'",
    "1x:y": "NULL",
    "/%zz": "NULL",
}
ORACLE["resolved_urls"] = " UNION ALL ".join(
    f"SELECT page_id, '{ref}' AS ref, CAST({sql} AS VARCHAR) AS resolved FROM "
    "(SELECT *, regexp_extract(url, '^(https?://[^/]*)', 1) AS o FROM pages)"
    for ref, sql in _RESOLVED.items()
)

# ---- HTML and text

ORACLE["element_counts"] = r"""SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '<script>', 'g'),
    '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2"""

ORACLE["inner_text"] = rf"""WITH {_ANCHORS}, n AS (
  SELECT page_id, html, len(regexp_extract_all(html, '<a href=')) AS links FROM pages)
SELECT page_id, 0 AS pos, 'title' AS tag, trim({_text("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS text FROM n
UNION ALL SELECT page_id, 1, 'script', regexp_extract(html, '(?s)<script>(.*?)</script>', 1) FROM n
UNION ALL SELECT page_id, pos + 1, 'a', trim({_text("txt")}) FROM anchors
UNION ALL SELECT page_id, links + 2, 'h1', trim({_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) FROM n"""

ORACLE["stripped_text"] = f"SELECT page_id, {_strip('html')} AS text FROM pages"
ORACLE["decoded_entities"] = f"SELECT page_id, {_text('html')} AS decoded FROM pages"
ORACLE["clip_body"] = f"""SELECT page_id, raw_html, strlen(raw_html) AS response_size FROM (
  SELECT page_id, {_cut("html", 1000, "''")} AS raw_html FROM pages)"""
ORACLE["truncated_text"] = f"SELECT doc_id, {_cut('text', 200)} AS text FROM documents"
ORACLE["trimmed_text"] = r"""SELECT doc_id, regexp_replace(text,
  '^[\s\x0b\x{85}\x{a0}\x{3000}]+|[\s\x0b\x{85}\x{a0}\x{3000}]+$', '', 'g') AS text FROM documents"""

# ---- customer pages

_C = "CAST(c_custkey AS BIGINT) * 8 + 3"
_S = "https://shop.test"
_CUST = f"(SELECT *, {_C} AS page_id, '{_S}/c/' || c_custkey || '?ref=n' AS url FROM customer) c"
# the pages that could be fetched: only these give items
_LIVE = _CUST.replace("FROM customer)", "FROM customer WHERE c_custkey % 97 != 13)")

ORACLE["base_urls"] = f"""SELECT page_id, CASE WHEN c_custkey % 4 = 1 THEN url || '#x' ELSE url END AS base FROM {_CUST}"""
ORACLE["provenance"] = f"""SELECT page_id, url AS final_url, 'http' AS fetcher_used, 0 AS depth, true AS timed
FROM {_CUST}"""
ORACLE["effective_html"] = f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'R' || page_id ELSE 'W' || page_id END
  AS html FROM {_CUST} WHERE page_id % 3 = 0 OR page_id % 5 != 0"""
ORACLE["element_attributes"] = f"""SELECT page_id, 'img' AS tag, unnest(['src', 'alt', 'width', 'srcset']) AS name,
  unnest(['/i/' || c_custkey || '.PNG', c_name, '10', '/i/' || c_custkey || '.PNG 1x, /i/' || c_custkey || '@2x.png 2x'])
  AS value FROM {_CUST}"""
ORACLE["descendants"] = f"""SELECT page_id, 0 AS parent, 'source' AS tag, '/p/' || c_custkey || '.webp 1x' AS srcset
FROM {_CUST}"""
ORACLE["selected_prefix"] = f"""SELECT page_id, 'mailto:Cust' || c_custkey || '@shop.test?subject=hi' AS href
FROM {_CUST}"""

_SITE_LINKS = f"""(
  SELECT page_id, i AS pos, '{_S}/c/' || (25 + 20 * c_custkey + i) || '?ref=n' AS value, 'internal' AS link_type,
    'c' AS anchor_text, NULL AS rel FROM {_LIVE}, range(20) r(i)
  UNION ALL SELECT page_id, 20, '{_S}/o/' || c_custkey || '#lines', 'internal', 'order', 'nofollow' FROM {_LIVE}
  UNION ALL SELECT page_id, 21, 'https://github.com/cust' || c_custkey, 'external', 'gh', NULL FROM {_LIVE}
  UNION ALL SELECT page_id, 22, '{_S}/d/' || c_custkey || '.pdf', 'internal', 'invoice', NULL FROM {_LIVE})"""
ORACLE["links_site"] = f"SELECT page_id, value, link_type, anchor_text, rel FROM {_SITE_LINKS}"
ORACLE["links_by_type"] = f"SELECT link_type, count(*) AS n FROM {_SITE_LINKS} GROUP BY 1"
ORACLE["social"] = f"""SELECT page_id, 'https://github.com/cust' || c_custkey AS value, 'github' AS platform,
  'gh' AS anchor_text FROM {_LIVE}"""
ORACLE["social_table"] = f"""SELECT page_id, 'https://github.com/cust' || c_custkey AS value, lower(r_name) AS platform
FROM {_LIVE} JOIN region ON substr(CAST(c_custkey AS VARCHAR), 1, 1) = CAST(r_regionkey AS VARCHAR)"""
ORACLE["social_many"] = f"""WITH t AS (SELECT 'p' || (c_custkey % 97) AS platform, 'github.com/cust' || c_custkey AS pattern, -c_custkey AS rank
  FROM customer), f AS (SELECT platform, min(rank) AS first FROM t GROUP BY 1),
l AS (SELECT page_id, 'https://github.com/cust' || c_custkey AS value, CAST(c_custkey AS VARCHAR) AS k FROM {_LIVE}),
-- a pattern occurs in a value if its number begins with the value's digits so far
m AS (SELECT page_id, value, 'github.com/cust' || k[:n] AS pattern FROM l, (SELECT unnest(range(1, 20)) AS n) WHERE n <= len(k))
SELECT page_id, value, arg_min(platform, (first, platform)) AS platform, 'gh' AS anchor_text
FROM m JOIN t USING (pattern) JOIN f USING (platform) GROUP BY page_id, value"""
ORACLE["http_urls"] = f"SELECT page_id, 'https://github.com/cust' || c_custkey AS value FROM {_LIVE}"

_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def _emails(table: str, key: str, html: str, denied: bool = False) -> str:
    deny = (
        r"""WHERE NOT regexp_matches(value, '(\.png|\.jpg|\.gif|\.css|\.js)$|example\.com|sentry\.io|webpack')"""
        if denied
        else ""
    )
    return f"""SELECT DISTINCT page_id, value, 'page_text' AS source FROM (SELECT {key} AS page_id,
  lower(unnest(regexp_extract_all({_strip(html)}, '{_EMAIL}'))) AS value FROM {table}) {deny}"""


_DOC = "'<p>' || text || '</p>'"
_SITE_EMAILS = f"SELECT page_id, 'cust' || c_custkey || '@shop.test' AS value, 'mailto_link' AS source FROM {_LIVE}"
ORACLE["emails"] = _emails("documents", "doc_id", _DOC)
ORACLE["emails_pages"] = _emails("pages", "page_id", "html")
ORACLE["emails_default_deny"] = _emails("documents", "doc_id", _DOC, True) + " UNION ALL " + _SITE_EMAILS


def _phones(table: str, key: str, html: str) -> str:
    p1 = r"\+?1?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
    p2 = r"\+\d{1,3}[\s.-]?\d{4,14}"
    both = f"list_concat(regexp_extract_all(t, '{p1}'), regexp_extract_all(t, '{p2}'))"
    return rf"""SELECT page_id, arg_min(value, pos) AS value, normalized, 'page_text' AS source FROM (
  SELECT page_id, pos, trim(raw, E' \t\n\f\r') AS value, regexp_replace(raw, '[^+0-9]', '', 'g') AS normalized FROM (
    SELECT page_id, unnest(ms) AS raw, generate_subscripts(ms, 1) AS pos FROM (
      SELECT page_id, {both} AS ms FROM (SELECT {key} AS page_id, {_strip(html)} AS t FROM {table}))))
WHERE length(normalized) >= 7 GROUP BY page_id, normalized"""


_TEL = "'+1-555-010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"
_SITE_PHONES = f"""SELECT page_id, {_TEL} AS value, replace({_TEL}, '-', '') AS normalized,
  'tel_link' AS source FROM {_LIVE}"""
ORACLE["phones"] = _phones("documents", "doc_id", _DOC)
ORACLE["phones_site"] = _SITE_PHONES
ORACLE["normalized_phones"] = "SELECT doc_id, regexp_replace(text, '[^+0-9]', '', 'g') AS digits FROM documents"

_INPUTS = "'input[name=q,type=text,placeholder=Qty] | select[name=size,type=] | textarea[name=,type=]'"
ORACLE["forms"] = f"""SELECT page_id, 'FORM#1 POST /buy (3 inputs)' AS value, 'POST' AS method, '/buy' AS action,
  'f' || c_custkey AS id, '3' AS input_count, {_INPUTS} AS inputs, CAST(NULL AS VARCHAR) AS enctype,
  CAST(NULL AS VARCHAR) AS name FROM {_LIVE}
UNION ALL SELECT page_id, 'FORM#2 GET  (0 inputs)', 'GET', NULL, NULL, '0', NULL, NULL, NULL FROM {_LIVE}"""
ORACLE["form_fields"] = f"""SELECT page_id, unnest([0, 0, 0, 1]) AS parent, unnest([0, 1, 2, 0]) AS pos,
  unnest(['input', 'select', 'textarea', 'input']) AS tag, unnest(['q', 'size', NULL, NULL]) AS name FROM {_CUST}"""

_TITLE_TAG = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_H1_TAG = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
_TITLE = f"trim({_text(_TITLE_TAG)})"
_H1 = f"trim({_text(_H1_TAG)})"
_LANG = """regexp_extract(html, '<html lang="([^"]*)"', 1)"""
_PAGE_META = f"""(SELECT page_id, url, {_TITLE} AS value, 0 AS phase, 'title' AS field FROM pages
  UNION ALL SELECT page_id, url, {_cut("h", 300)}, 2, 'h1' FROM (SELECT page_id, url, {_H1} AS h FROM pages) WHERE h != ''
  UNION ALL SELECT page_id, url, {_LANG}, 4, 'language' FROM pages)"""
_NO_INDEX = 'CAST(NULL AS VARCHAR) AS "index"'
ORACLE["metadata_all"] = f"SELECT page_id, value, phase, field, {_NO_INDEX} FROM {_PAGE_META}"
for _name, _f in (("titles", "title"), ("headings", "h1"), ("language", "language")):
    ORACLE[_name] = f"SELECT page_id, value, field, {_NO_INDEX} FROM {_PAGE_META} WHERE field = '{_f}'"

_SITE_META = {
    "title": "c_name",
    "description": "c_mktsegment",
    "og:type": "'profile'",
    "h1": "c_name",
    "canonical": "'/c/' || c_custkey",
    "language": "'en'",
    "json-ld": """'{"id": ' || c_custkey || '}'""",
}


def _site_meta(*fields: str) -> str:
    return " UNION ALL ".join(
        f"SELECT page_id, {_SITE_META[f]} AS value, '{f}' AS field, "
        f"""CAST({"'0'" if f == "json-ld" else "NULL"} AS VARCHAR) AS "index" FROM {_LIVE}"""
        for f in fields
    )


ORACLE["meta_tags"] = _site_meta("description", "og:type")
ORACLE["canonical_links"] = _site_meta("canonical")
ORACLE["json_ld"] = _site_meta("json-ld")

# asset type, path, tag, extension and the further values of a customer page's assets
_ASSETS = [
    ("image", "'/i/' || c_custkey || '.PNG'", "img", ".png", {"alt": "c_name", "width": "'10'"}),
    ("image", "'/p/' || c_custkey || '.jpg'", "img", ".jpg", {}),
    ("image", "'/i/' || c_custkey || '@2x.png'", "img-srcset", ".png", {}),
    ("image", "'/p/' || c_custkey || '.webp'", "picture-source", ".webp", {"media_type": "'image/webp'"}),
    ("script", "'/j/app.js'", "script", ".js", {"async": "'true'"}),
    ("stylesheet", "'/s/main.css'", "link", ".css", {"media": "'print'"}),
    ("font", "'/f/a.woff2'", "link-preload", ".woff2", {}),
    ("icon", "'/favicon.ico'", "link", ".ico", {"rel": "'icon'"}),
    ("document", "'/d/' || c_custkey || '.pdf'", "a", ".pdf", {}),
    ("video", "'/v/' || c_custkey || '.mp4'", "video", ".mp4", {}),
    ("audio", "'/a/' || c_custkey || '.mp3'", "audio", ".mp3", {}),
]
_EXTRA = ("alt", "width", "height", "media_type", "script_type", "async", "defer", "media", "rel")
_SITE_ASSETS = "(" + " UNION ALL ".join(
    f"SELECT page_id, '{_S}' || {path} AS value, '{kind}' AS asset_type, '{tag}' AS tag, '{ext}' AS extension, "
    + ", ".join(f'CAST({extra.get(k, "NULL")} AS VARCHAR) AS "{k}"' for k in _EXTRA)
    + f" FROM {_LIVE}"
    for kind, path, tag, ext, extra in _ASSETS
) + ")"
ORACLE["assets_all"] = f"SELECT * FROM {_SITE_ASSETS}"
ORACLE["assets_images"] = f"""SELECT page_id, value, tag, extension, alt, width, media_type FROM {_SITE_ASSETS}
WHERE asset_type = 'image'"""
ORACLE["assets_scripts"] = f"""SELECT page_id, value, script_type, "async", "defer" FROM {_SITE_ASSETS}
WHERE asset_type = 'script'"""
ORACLE["assets_styles"] = f"""SELECT page_id, value, asset_type, tag, media, rel FROM {_SITE_ASSETS}
WHERE asset_type IN ('stylesheet', 'font', 'icon')"""
ORACLE["assets_files"] = f"""SELECT page_id, value, asset_type, extension FROM {_SITE_ASSETS}
WHERE asset_type = 'document'"""
ORACLE["assets_media"] = f"""SELECT page_id, value, asset_type, tag FROM {_SITE_ASSETS}
WHERE asset_type IN ('video', 'audio')"""
ORACLE["first_items"] = f"""SELECT page_id, asset_type AS kind, value FROM {_SITE_ASSETS}
WHERE value NOT LIKE '%.jpg' AND tag NOT IN ('img-srcset', 'picture-source')"""

# ---- calls of visits

_VISITS = """(SELECT (event_id // 1000) * 1000000000 + user_id AS page_id, event_id, user_id, event_id // 1000 AS visit,
  'https://api.shop.test/v1/' || event_type || CASE WHEN event_id % 7 = 0 THEN '.png' ELSE '' END AS url,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'application/json' END AS content_type,
  ['xhr', 'fetch', 'image', 'other', 'websocket', 'Stylesheet'][event_id % 6 + 1] AS resource_type FROM events)"""
ORACLE["captured_requests"] = f"""SELECT page_id, count(*) FILTER (resource_type NOT IN ('image', 'Stylesheet')) AS n
FROM {_VISITS} GROUP BY 1"""
ORACLE["api_endpoints"] = f"""SELECT page_id, url AS value, method, any_value(content_type) AS content_type,
  arg_min(resource_type, event_id) AS resource_type FROM {_VISITS}
WHERE resource_type NOT IN ('image', 'Stylesheet') AND url NOT LIKE '%.png' GROUP BY page_id, url, method"""
ORACLE["static_resources"] = f"""SELECT resource_type IN ('image', 'Stylesheet') OR url LIKE '%.png' AS is_static,
  count(*) AS n FROM {_VISITS} GROUP BY 1"""
ORACLE["header_maps"] = """SELECT event_id, 'Content-Type' AS name, event_type AS joined FROM events
UNION ALL SELECT event_id, 'Set-Cookie', 'u=' || user_id || '|e=' || event_id FROM events"""
ORACLE["result_json"] = f"""SELECT '{_S}/c/' || user_id || '?visit=' || visit AS url, count(*) AS calls
FROM {_VISITS} GROUP BY user_id, visit"""

# ---- all extractors

_PAGE_ITEMS = f"""SELECT page_id, 'link' AS type, value, url AS source_url FROM page_links
UNION ALL SELECT p.page_id, 'phone', p.value, pages.url FROM ({_phones("pages", "page_id", "html")}) p JOIN pages USING (page_id)
UNION ALL SELECT e.page_id, 'email', e.value, pages.url FROM ({_emails("pages", "page_id", "html", True)}) e JOIN pages USING (page_id)
UNION ALL SELECT page_id, 'metadata', value, url FROM {_PAGE_META}"""
ORACLE["extract_all_pages"] = f"WITH {_LINKS} {_PAGE_ITEMS}"

_SITE_TYPES = {
    "link": 23, "form": 2, "email": 1, "phone": 1, "social": 1, "metadata": 7, "asset": 11, "api_endpoint": 0,
}
_SITE_ITEMS = f"""(SELECT page_id, 'link' AS type, value FROM {_SITE_LINKS}
UNION ALL SELECT page_id, 'form', value FROM ({ORACLE["forms"]})
UNION ALL SELECT page_id, 'email', value FROM ({_SITE_EMAILS})
UNION ALL SELECT page_id, 'phone', value FROM ({_SITE_PHONES})
UNION ALL SELECT page_id, 'social', value FROM ({ORACLE["social"]})
UNION ALL SELECT page_id, 'metadata', value FROM ({_site_meta(*_SITE_META)})
UNION ALL SELECT page_id, 'asset', value FROM {_SITE_ASSETS})"""
ORACLE["extract_all_site"] = f"""SELECT page_id, type, value, '{_S}/c/' || ((page_id - 3) // 8) || '?ref=n' AS source_url
FROM {_SITE_ITEMS}"""
ORACLE["items_by_type"] = f"SELECT type, count(*) AS n FROM {_SITE_ITEMS} GROUP BY 1"
ORACLE["written_items"] = ORACLE["items_by_type"]
ORACLE["page_item_counts"] = (
    f"SELECT page_id, {', '.join(f'{n} AS {t}' for t, n in _SITE_TYPES.items())} FROM {_LIVE}"
)
_LABEL = "[link:23 form:2 email:1 phone:1 social:1 meta:7 asset:11]"
ORACLE["count_labels"] = f"""SELECT page_id, CASE WHEN c_custkey % 97 = 13 THEN '' ELSE '{_LABEL}' END AS label
FROM {_CUST}"""
ORACLE["items_with_pages"] = f"""SELECT page_id, CASE WHEN c_custkey % 97 = 13 THEN 404 ELSE 200 END AS status_code,
  CASE WHEN c_custkey % 97 = 13 THEN 0 ELSE 23 END AS n FROM {_CUST}"""
ORACLE["page_result_sizes"] = f"""
SELECT 0 AS page_id, count(*) + 2 AS n_items, '{_S}/r/' || min(r_regionkey) AS first_value, '{_S}/' AS source_url FROM region
UNION ALL SELECT r_regionkey * 8 + 1, count(*) + 2, '{_S}/n/' || min(n_nationkey) || '/', '{_S}/r/' || r_regionkey
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
UNION ALL SELECT n_nationkey * 8 + 2, 2, '{_S}/c/' || n_nationkey || '?ref=n', '{_S}/n/' || n_nationkey FROM nation
UNION ALL SELECT page_id, {sum(_SITE_TYPES.values())}, '{_S}/c/' || (25 + 20 * c_custkey) || '?ref=n', url FROM {_LIVE}
UNION ALL SELECT page_id, 0, NULL, NULL FROM {_CUST} WHERE c_custkey % 97 = 13
UNION ALL SELECT o_orderkey * 8 + 4, 2, '{_S}/c/' || o_custkey || '?ref=n', '{_S}/o/' || o_orderkey FROM orders"""
ORACLE["custom_extractors"] = f"""SELECT page_id, 'shout' AS type, upper(url) AS value, CAST(length(url) AS VARCHAR) AS n
FROM {_LIVE} WHERE page_id % 16 != 11
UNION ALL SELECT page_id, 'status', '200', NULL FROM {_LIVE}"""
ORACLE["custom_errors"] = f"""SELECT page_id, url, 'shout' AS extractor, 'ValueError: cannot read this page' AS error
FROM {_LIVE} WHERE page_id % 16 = 11"""
ORACLE["custom_checked"] = f"""SELECT page_id, 1 AS nth, upper(url) AS value FROM {_LIVE} WHERE page_id % 16 != 11
UNION ALL SELECT page_id, 2, '200' FROM {_LIVE}
UNION ALL SELECT page_id, -1, 'ValueError: cannot read this page' FROM {_LIVE} WHERE page_id % 16 = 11"""
ORACLE["custom_results"] = f"""SELECT page_id, CASE WHEN c_custkey % 97 = 13 THEN ''
  WHEN page_id % 16 = 11 THEN 'metadata,status' ELSE 'metadata,shout,status' END AS kinds FROM {_CUST}"""
ORACLE["custom_report"] = f"""SELECT page_id, '      +-- ' || type || ': ' || value AS line FROM ({ORACLE["custom_extractors"]})"""
_CUSTOM_TYPES = f"""(SELECT unnest(['metadata', 'shout', 'status']) AS type,
  unnest([7 * count(*), count(*) FILTER (page_id % 16 != 11), count(*)]) AS n FROM {_LIVE})"""
ORACLE["custom_stats"] = f"SELECT sum(n) OVER () AS total_items, type, n FROM {_CUSTOM_TYPES}"
ORACLE["custom_frame_errors"] = f"SELECT type, n FROM {_CUSTOM_TYPES} UNION ALL SELECT 'broken', -1"
ORACLE["written_results"] = f"""SELECT url, CASE WHEN c_custkey % 97 = 13 THEN '404' ELSE '200' END AS status_code,
  CAST(NULL AS VARCHAR) AS raw_html, CAST(NULL AS VARCHAR) AS error,
  '{_S}/c/' || (25 + 20 * c_custkey) || '?ref=n' AS first_value FROM {_LIVE}"""

# ---- pages that differ by key

_PLATFORM_NAMES, _PLATFORM_HOSTS = list(PLATFORMS), [p[0] for p in PLATFORMS.values()]
_FILES, _KINDS = list(FILE_TYPES), list(FILE_TYPES.values())
_VARIED = f"""(SELECT c_custkey AS k, CAST(c_custkey AS BIGINT) * 8 + 5 AS page_id, '{_S}/v/' AS base,
  {_PLATFORM_NAMES}[c_custkey % {len(PLATFORMS)} + 1] AS platform,
  'https://' || {_PLATFORM_HOSTS}[c_custkey % {len(PLATFORMS)} + 1] || 'u' || c_custkey AS profile,
  {_FILES}[c_custkey % {len(FILE_TYPES)} + 1] AS extension, {_KINDS}[c_custkey % {len(FILE_TYPES)} + 1] AS kind
  FROM customer)"""
ORACLE["varied_social"] = f"SELECT page_id, profile AS value, platform, 'me & you' AS anchor_text FROM {_VARIED}"
ORACLE["varied_files"] = f"""SELECT page_id, base || k || '/files/' || k || upper(extension) || '?v=1' AS value,
  kind AS asset_type, 'a' AS tag, extension FROM {_VARIED}"""
ORACLE["varied_metadata"] = f"""SELECT page_id, 'A < B ' || k AS value, 'h' || (k % 6 + 1) AS field,
  CAST(NULL AS VARCHAR) AS "index" FROM {_VARIED}
UNION ALL SELECT page_id, 'de', 'language', NULL FROM {_VARIED}
UNION ALL SELECT page_id, '{{"n": ' || k || '}}', 'json-ld', CAST(i AS VARCHAR) FROM {_VARIED}, range(2) t(i) WHERE i < k % 3"""
ORACLE["varied_links"] = f"""SELECT page_id, profile AS value, 'external' AS link_type, 'me & you' AS anchor_text FROM {_VARIED}
UNION ALL SELECT page_id, base || k || '/files/' || k || upper(extension) || '?v=1', 'internal', 'f' FROM {_VARIED}
UNION ALL SELECT page_id, base || 'up/' || k, 'internal', 'up' FROM {_VARIED}
UNION ALL SELECT page_id, base || k || '/same/' || k, 'internal', 'same' FROM {_VARIED}"""

# ---- crawling


def _crawl(depth: int, external: bool = False, query: str = "?ref=n") -> str:
    ext = "" if external else "WHERE internal"
    return f"""WITH RECURSIVE nodes AS (
  SELECT '{_S}/' AS url, true AS ok
  UNION ALL SELECT '{_S}/r/' || r_regionkey, true FROM region
  UNION ALL SELECT '{_S}/n/' || n_nationkey, true FROM nation
  UNION ALL SELECT '{_S}/c/' || c_custkey || '{query}', c_custkey % 97 != 13 FROM customer
  UNION ALL SELECT '{_S}/o/' || o_orderkey, true FROM orders
), edges AS (SELECT * FROM (
  SELECT '{_S}/' AS src, '{_S}/r/' || r_regionkey AS dst, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos,
    true AS internal FROM region
  UNION ALL SELECT '{_S}/', 'https://partner.test/', count(*), false FROM region
  UNION ALL SELECT '{_S}/r/' || n_regionkey, '{_S}/n/' || n_nationkey,
    row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1, true FROM nation
  UNION ALL SELECT '{_S}/r/' || r_regionkey, '{_S}/', (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey), true FROM region
  UNION ALL SELECT '{_S}/n/' || n_nationkey, '{_S}/c/' || n_nationkey || '{query}', 0, true FROM nation
  UNION ALL SELECT '{_S}/c/' || c_custkey || '{query}', '{_S}/c/' || (25 + 20 * c_custkey + i) || '{query}', i, true
    FROM customer, range(20) t(i) WHERE c_custkey % 97 != 13
  UNION ALL SELECT '{_S}/c/' || c_custkey || '{query}', '{_S}/o/' || c_custkey, 20, true
    FROM customer WHERE c_custkey % 97 != 13
  UNION ALL SELECT '{_S}/c/' || c_custkey || '{query}', 'https://github.com/cust' || c_custkey, 21, false
    FROM customer WHERE c_custkey % 97 != 13
  UNION ALL SELECT '{_S}/c/' || c_custkey || '{query}', '{_S}/d/' || c_custkey || '.pdf', 22, true
    FROM customer WHERE c_custkey % 97 != 13
  UNION ALL SELECT '{_S}/o/' || o_orderkey, '{_S}/c/' || o_custkey || '{query}', 0, true FROM orders) {ext}
), walk AS (
  SELECT '{_S}/' AS url, 0 AS depth, [0] AS path
  UNION SELECT e.dst, w.depth + 1, list_append(w.path, e.pos) FROM walk w JOIN edges e ON e.src = w.url
  WHERE w.depth < {depth}
), first AS (
  SELECT url, depth, path FROM walk QUALIFY row_number() OVER (PARTITION BY url ORDER BY depth, path) = 1
), reached AS (
  SELECT first.url, depth, row_number() OVER (ORDER BY depth, path) - 1 AS rank,
    CASE WHEN nodes.url IS NULL THEN 'not_captured' WHEN ok THEN 'done' ELSE 'error' END AS status
  FROM first LEFT JOIN nodes USING (url))"""


ORACLE["crawl_depth3"] = _crawl(3) + " SELECT * FROM reached WHERE rank < 500"
ORACLE["crawl_capped"] = _crawl(4) + " SELECT * FROM reached WHERE rank < 500"
ORACLE["crawl_external"] = _crawl(4, external=True) + " SELECT * FROM reached"
ORACLE["crawl_deep"] = _crawl(7) + " SELECT * FROM reached"
ORACLE["crawl_no_query"] = _crawl(4, query="") + " SELECT * FROM reached"
ORACLE["crawl_growing"] = _crawl(3) + " SELECT * FROM reached"
ORACLE["crawl_recaptured"] = ORACLE["json_pages"] = _crawl(4) + " SELECT * FROM reached"
_MOVED = "CASE WHEN n_nationkey % 2 = 1 THEN 'https://moved.test' ELSE 'https://shop.test' END"
# pages of the other host are queued, never fetched, and lead nowhere
ORACLE["crawl_redirected"] = (
    (_crawl(5) + " SELECT * FROM reached")
    .replace(f"'{_S}/c/' || n_nationkey", f"{_MOVED} || '/c/' || n_nationkey")
    .replace("CASE WHEN nodes.url IS NULL", "CASE WHEN first.url LIKE 'https://moved.test/%' THEN 'error' WHEN nodes.url IS NULL")
)
ORACLE["csv_pages"] = ORACLE["links"]
_PER_KIND = (
    [("c", t, n) for t, n in _SITE_TYPES.items() if n]
    + [("", "link", 6), ("", "metadata", 1), ("r", "link", 6), ("r", "metadata", 1)]
    + [("n", "link", 1), ("n", "metadata", 1), ("o", "link", 1), ("o", "metadata", 1)]
)
ORACLE["crawl_items"] = (
    _crawl(4)
    + ", per_kind(kind, type, each) AS (VALUES "
    + ", ".join(f"('{k}', '{t}', {n})" for k, t, n in _PER_KIND)
    + """) SELECT type, CAST(sum(each) AS BIGINT) AS n FROM reached
JOIN per_kind ON kind = split_part(url, '/', 4) WHERE status = 'done' GROUP BY type"""
)

# ---- crawl logs and reports

_LOG = """(SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'page_error'
  WHEN event_type IN ('view', 'click') THEN 'page_done' ELSE 'page_queued' END AS event_type,
  CAST(value * 1000000 AS BIGINT) AS duration_ns,
  CASE WHEN event_type = 'error' THEN 404 WHEN event_id % 10 = 0 THEN 301 ELSE 200 END AS status_code FROM events)"""
_TOTALS = f"""(SELECT count(*) FILTER (event_type = 'page_queued') AS pages_queued,
  count(*) FILTER (event_type = 'page_done') AS pages_crawled,
  count(*) FILTER (event_type = 'page_error') AS pages_errored, min(ts) AS started_at, max(ts) AS finished_at,
  (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000 AS elapsed_ns FROM {_LOG})"""
_ALL_ITEMS = f"WITH {_LINKS}, items AS ({_PAGE_ITEMS})"
_COUNTS = ", ".join(f"nullif(count(*) FILTER (type = '{t}'), 0) AS n_{t}" for t in ITEM_TYPES)
_SUMMARY = f"""{_ALL_ITEMS}, summary AS (
  SELECT 'https://shop.test/' AS target_url, started_at, finished_at, elapsed_ns AS duration_ns,
    pages_crawled AS total_pages, pages_errored AS total_errors, i.* FROM {_TOTALS},
    (SELECT count(*) AS total_items, {_COUNTS} FROM items) i)"""
ORACLE["crawl_summary"] = _SUMMARY + " SELECT * FROM summary"
ORACLE["crawl_stats"] = f"""{_ALL_ITEMS} SELECT pages_queued, pages_crawled, pages_errored, items_extracted,
  i.* EXCLUDE (items_extracted), elapsed_ns, round(pages_crawled / (elapsed_ns / 1e9), 6) AS pages_per_sec
FROM {_TOTALS}, (SELECT count(*) AS items_extracted, {_COUNTS} FROM items) i"""
ORACLE["custom_writer"] = f"""{_SUMMARY} SELECT url AS name, {sum(_SITE_TYPES.values())} AS n FROM {_LIVE}
UNION ALL SELECT target_url, total_items FROM summary"""
ORACLE["status_classes"] = f"""SELECT CASE WHEN status_code BETWEEN 200 AND 299 THEN '2xx'
  WHEN status_code BETWEEN 300 AND 399 THEN '3xx' WHEN status_code >= 400 THEN 'error' ELSE 'other' END
  AS status_class, count(*) AS n FROM {_LOG} GROUP BY 1"""
ORACLE["event_counts"] = f"SELECT event_type, count(*) AS n FROM {_LOG} GROUP BY 1"
ORACLE["ok_failed"] = f"""SELECT CASE WHEN status_code = 200 THEN 'ok' ELSE 'failed' END AS outcome, count(*) AS n
FROM {_LOG} GROUP BY 1"""


def _duration(ns: str) -> str:
    return f"""CASE WHEN {ns} < 1000000000 THEN ({ns} // 1000000) || 'ms'
  WHEN {ns} < 60000000000 THEN format('{{:.1f}}', {ns} / 1e9) || 's'
  ELSE ({ns} // 60000000000) || 'm' || (({ns} // 1000000000) % 60) || 's' END"""


ORACLE["durations"] = f"""SELECT event_id, {_duration("ns")} AS duration FROM (
  SELECT event_id, duration_ns * (1 + event_id % 3 * 700) AS ns FROM {_LOG})"""

_REPORT_ITEMS = [
    "'form: FORM#1 POST /buy (3 inputs)'",
    "'form: FORM#2 GET  (0 inputs)'",
    "'email: cust' || c_custkey || '@shop.test'",
    f"'phone: ' || {_TEL}",
    "'social: https://github.com/cust' || c_custkey",
    *[f"'metadata: ' || {v}" for v in _SITE_META.values()],
    *[f"'asset: {_S}' || {path}" for _, path, *_ in _ASSETS],
]
ORACLE["report_lines"] = f"""SELECT page_id, 0 AS line_no, '  [' || CASE WHEN c_custkey % 97 = 13 THEN 404 ELSE 200 END ||
  '] ' || url || ' (' || {_duration("((c_custkey * 37000000) % 90000000000)")} || ') {_LABEL}' AS line FROM {_LIVE}
""" + " ".join(
    f"UNION ALL SELECT page_id, {i}, '      +-- ' || {item} FROM {_LIVE}"
    for i, item in enumerate(_REPORT_ITEMS, _SITE_TYPES["link"] + 1)
) + f" UNION ALL SELECT page_id, pos + 1, '      +-- link: ' || value FROM {_SITE_LINKS}"
_REPORT_TYPES = ", ".join(f"'{t}:' || {n} * n" for t, n in _SITE_TYPES.items() if n)
ORACLE["report_lines"] += f""" UNION ALL SELECT * FROM (SELECT NULL, unnest([0, 1, 2, 3]), unnest(['  Crawl complete',
  '    Pages:  ' || pages_crawled || ' crawled, ' || pages_errored || ' errors',
  '    Items:  ' || {sum(_SITE_TYPES.values())} * n || ' extracted in ' || {_duration("elapsed_ns")},
  CASE WHEN n > 0 THEN '    Types:  ' || concat_ws(', ', {_REPORT_TYPES}) END]) AS closing
  FROM {_TOTALS}, (SELECT count(*) AS n FROM {_LIVE})) WHERE closing IS NOT NULL"""
ORACLE["written_report"] = f"""SELECT '+-- ' || type AS kind, n FROM ({ORACLE["items_by_type"]})
UNION ALL SELECT '[200]', count(*) FROM {_LIVE}
UNION ALL SELECT unnest(['Crawl', 'Pages', 'Items', 'Types']), 1"""
_TYPE_LIST = ", ".join(f"'{t}:' || n_{t}" for t in ITEM_TYPES)
ORACLE["summary_lines"] = f"""{_SUMMARY} SELECT unnest([0, 1, 2, 3]) AS line_no, unnest(['  Crawl complete',
  '    Pages:  ' || total_pages || ' crawled, ' || total_errors || ' errors',
  '    Items:  ' || total_items || ' extracted in ' || {_duration("duration_ns")},
  '    Types:  ' || concat_ws(', ', {_TYPE_LIST})]) AS line FROM summary"""
ORACLE["report_header"] = """SELECT unnest([0, 1]) AS line_no, unnest(['  Target: https://shop.test/',
  '  Started: ' || strftime(min(ts), '%a, %d %b %Y %H:%M:%S UTC')]) AS line FROM events"""

# ---- streams

ORACLE["stream_extract"] = ORACLE["extract_all_pages"]
ORACLE["stream_new_urls"] = f"WITH {_LINKS} SELECT DISTINCT rtrim(value, '/') AS url FROM page_links"
_EACH = ", ".join(f"count(*) FILTER (type = '{t}') AS {t}" for t in ITEM_TYPES)
ORACLE["stream_stats"] = f"""{_ALL_ITEMS} SELECT p.*, i.* FROM
  (SELECT count(*) AS pages_crawled, 0 AS pages_errored,
    round(count(*) / (2.0 * (max(page_id) - min(page_id))), 6) AS pages_per_sec FROM pages) p,
  (SELECT count(*) AS items_extracted, {_EACH} FROM items) i"""
ORACLE["stream_event_counts"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"
ORACLE["stream_open_stats"] = f"""WITH {_LINKS}, t AS (SELECT 'link' AS type, count(*) AS n FROM page_links
  UNION ALL SELECT 'ends-' || right(url, 1), count(*) FROM pages GROUP BY 1)
SELECT (SELECT count(*) FROM pages) AS pages_crawled, sum(n) OVER () AS items_extracted, type, n FROM t"""
_SITE_TOTAL = sum(_SITE_TYPES.values())
ORACLE["stream_writer"] = f"""SELECT url AS name, 'items' AS what, {_SITE_TOTAL} AS n FROM {_LIVE}
UNION ALL SELECT '{_S}/', unnest(['pages', 'errors', 'items']), unnest([count(*), (SELECT count(*) FROM {_CUST}) - count(*),
  {_SITE_TOTAL} * count(*)]) FROM {_LIVE}"""
