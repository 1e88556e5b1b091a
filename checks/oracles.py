"""DuckDB SQL that gives the same rows as the registered queries, written independently of them."""

from __future__ import annotations

from cardmill.fixed import DATE_WORDS, DEPARTMENT_WORDS, LOCATION_WORDS

LABEL = (
    r"^(location|locations|department|team|category|posted( on)?|date posted|job id|req(uisition)? id)\s*[:\-–]?\s+"
)


def lines(c: str) -> str:
    return (
        rf"list_filter(list_transform(string_split_regex({c}, '[\n\r\x0b\x0c]'), "
        r"lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
    )


def cleaned(array: str, single_line: bool = False) -> str:
    """SQL for the cleaned text of an array column of lines."""
    text = f"{array}[1]" if single_line else f"array_to_string(list_filter({array}, lambda x, i: list_position({array}, x) = i), ' | ')"
    return f"nullif(trim(regexp_replace({text}, '{LABEL}', '', 'i')), '')"


EVENT_PAGES = """
    SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS page_no, event_id AS pos,
           'id:' || event_type || '|' || CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR) AS job_key
    FROM events
"""
EVENT_RUNS = """
    SELECT user_id AS slug, CAST(ts AS DATE) AS run_at, CAST(count(*) AS INTEGER) AS n_jobs,
           CASE WHEN bool_or(event_type = 'error') THEN 'error' ELSE 'ok' END AS status,
           CAST(count(DISTINCT event_type) AS INTEGER) AS pages, CAST(user_id % 9 AS INTEGER) AS onboarded
    FROM events GROUP BY ALL
"""
HEALTH = f"""
    SELECT *, coalesce(nullif(prev, 0), onboarded) AS baseline,
           CASE WHEN status = 'ok' AND n_jobs < 0.5 * coalesce(nullif(prev, 0), onboarded) THEN 'degraded' ELSE status END AS health,
           CASE WHEN status = 'ok' THEN n_jobs ELSE coalesce(prev, 0) END AS kept
    FROM (SELECT *, last_value(CASE WHEN status = 'ok' THEN n_jobs END IGNORE NULLS) OVER
                 (PARTITION BY slug ORDER BY run_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
          FROM ({EVENT_RUNS}))
"""
LATEST = f"SELECT * FROM ({HEALTH}) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY run_at DESC) = 1"

RUN_STATUS = """
    SELECT run_id, slug, name,
           CASE WHEN blocked IS NOT NULL THEN 'blocked' WHEN failure IS NOT NULL THEN 'error' WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status,
           CAST(CASE WHEN blocked IS NOT NULL THEN 0 ELSE n END AS INTEGER) AS n_jobs,
           CAST(CASE WHEN blocked IS NOT NULL THEN 0 ELSE last_page END AS INTEGER) AS pages,
           coalesce(blocked, failure) AS error
    FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, user_id AS slug, 'user ' || user_id AS name,
                 count(*) FILTER (event_type IN ('click', 'purchase')) AS n, count(*) AS last_page,
                 CASE WHEN arg_min(event_type, event_id) = 'signup' THEN 'HTTP 403' END AS blocked,
                 'failed ' || min(event_id) FILTER (event_type = 'error') AS failure
          FROM events GROUP BY CAST(ts AS DATE), user_id)
"""

SUPPLIER_SITES = """
    SELECT s_suppkey, 'supplier-' || substr(s_name, 10) AS slug, s_suppkey AS k,
           'https://s' || s_suppkey || '.example.com/' AS root, s_nationkey,
           ['none', 'next', 'page_number', 'load_more', 'scroll'][s_suppkey % 5 + 1] AS kind,
           CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 + 1 ELSE 5 END AS max_pages
    FROM supplier
"""

CUSTOMER_QUOTE = "replace(replace(url_encode(s_name || ' & co*~'), '%20', '+'), '%7E', '~')"

# 'Team' is a label, so the department 'Team | xx' loses it.
DOCUMENT_JOBS = rf"""
    SELECT doc_id AS ord, lang || ' Inc' AS company, {lines('text')} AS title_lines, source AS location,
           '| ' || lang AS team, lang, CAST(doc_id AS VARCHAR) AS key, n_chars, text
    FROM documents
"""
JOB_COLUMNS = f"""
    ord, company, {cleaned('title_lines', True)} AS title, location, lang AS department,
    CASE WHEN ord % 2 = 0 THEN 'day ' || key END AS posted,
    CASE WHEN ord % 3 = 0 THEN key END AS job_id,
    CASE WHEN ord % 4 < 2 THEN 'https://x.example.com/' || key || '?k=1' END AS apply_url
"""

HREFS = """
    SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) AS href,
           unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)) AS title,
           generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">', 1), 1) AS card_no
    FROM pages
"""
CARDS = f"""
    SELECT page_id, card_no, title,
           regexp_extract(url, '^[a-z]+://[^/]*') || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS apply_url
    FROM ({HREFS})
"""
PAGE_ROOT = "regexp_extract(url, '^[a-z]+://[^/]*')"
PAGE_PATH = "regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)"
PAGE_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"

TAGS = """
    SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages
"""
SIGNATURE = "CASE WHEN tag = 'div' THEN 'div.ad' ELSE tag END"
PLACE = "['Pune, India', 'Remote', 'Berlin, Germany'][c_nationkey % 3 + 1]"

ORACLES = {
    "canonical_url": rf"""
        SELECT page_id, {PAGE_ROOT} || coalesce(nullif(regexp_replace({PAGE_PATH}, '/+$', ''), ''), '/') ||
               CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url
        FROM (SELECT page_id, url, list_filter(string_split({PAGE_QUERY}, '&'), lambda p: p <> '' AND
                     NOT regexp_matches(p, '^(utm_[^=]*|gh_src|source|src|ref|lever-source[^=]*|trk[^=]*)(=|$)', 'i')) AS kept
              FROM pages)""",
    "absolute_url": rf"""
        SELECT page_id, {PAGE_ROOT} || '/a%20b/%C3%BC?x=1#f' AS rooted, {PAGE_ROOT} ||
               CASE WHEN ends_with({PAGE_PATH}, '/') THEN regexp_extract({PAGE_PATH}, '^/[^/]*/') ELSE '/' END || 'up/x' AS up,
               {PAGE_ROOT} || {PAGE_PATH} || '?p=3' AS query_only,
               CASE WHEN starts_with(url, 'https') THEN 'https://cdn.example.com/q' ELSE 'http://cdn.example.com:443/q' END AS host_only
        FROM pages""",
    "clean_text": f"""
        SELECT conv_id, turn, {cleaned('l')} AS all_lines, {cleaned('l', True)} AS first_line
        FROM (SELECT conv_id, turn, {lines("CASE WHEN turn % 2 = 1 THEN 'Location: ' || text ELSE text END")} AS l FROM conversations)""",
    "slugify": """
        SELECT c_custkey, trim(regexp_replace(lower('-- & ' || c_name || ' & ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug
        FROM customer""",
    "is_plausible_query": r"""
        SELECT conv_id, turn, CAST(trim(text) <> '' AND length(text) <= 120 AND NOT contains(text, chr(10)) AS INTEGER) AS plausible
        FROM conversations""",
    "block_reason": """
        SELECT page_id, CASE WHEN contains(lower(html), 'cheap-pills') THEN 'challenge page (cheap-pills)'
                             WHEN contains(lower(html), 'spam-farm') THEN 'challenge page (spam-farm)'
                             WHEN page_id % 7 = 0 THEN 'HTTP 403' END AS reason
        FROM pages""",
    "fill_template": """
        SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN 'https://x.example.com/' || c_mktsegment || '/' || c_custkey || '?n=' || c_name END AS link
        FROM customer""",
    "search_url": f"""
        SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN 'https://x.example.com/jobs?q=' || {CUSTOMER_QUOTE} || '&l=IN' END AS url
        FROM supplier""",
    "query_url_template": """
        SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://x.example.com/jobs?l=IN&q={query}'
                                             WHEN 1 THEN 'https://x.example.com/jobs/{query}/all' END AS template
        FROM customer""",
    "page_url_template": rf"""
        SELECT page_id, CASE WHEN contains(url, '?page=2') THEN replace(url, 'page=2', 'page={{page}}') END AS from_query,
               CASE WHEN contains(url, '?page=2') THEN replace(url, 'page=2', 'page={{page}}')
                    WHEN regexp_matches({PAGE_PATH}, '/[0-9]+/?$')
                    THEN regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/(\?|$)', '\1'), '/[0-9]+(\?|$)', '/{{page}}\1') END AS from_root
        FROM pages""",
    "id_url_template": """
        SELECT c_custkey AS page_id,
               CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 5 THEN 'https://x.example.com/c/{job_id}?n=' || lower(c_mktsegment)
                    ELSE 'https://x.example.com/c/' || c_custkey || '?n={job_id}' || lower(substr(c_mktsegment, 6)) END AS template,
               CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 5 THEN 'data-id' ELSE 'data-n' END AS attr
        FROM customer""",
    "read_site_configs": f"""
        SELECT slug, 2 AS schema_version, CAST(max_pages AS INTEGER) AS max_pages,
               CASE WHEN k % 3 = 0 THEN 'enter' END AS submit, 0 AS onboarded_job_count
        FROM ({SUPPLIER_SITES}) WHERE k % 11 <> 0""",
    "rejected_site_configs": f"""
        SELECT slug, 'pagination.type is not one of none, next, page_number, load_more, scroll' AS reject_reason
        FROM ({SUPPLIER_SITES}) WHERE k % 11 = 0""",
    "filter_sites": f"SELECT slug AS stem, s_suppkey FROM ({SUPPLIER_SITES}) WHERE k IN (7, 42)",
    "upsert_site_configs": """
        WITH old AS (SELECT n_nationkey AS slug, n_name AS start_url FROM nation WHERE n_regionkey < 3),
             new AS (SELECT s_nationkey AS slug, max(CAST(s_suppkey AS VARCHAR)) AS start_url FROM supplier GROUP BY 1)
        SELECT coalesce(o.slug, n.slug) AS slug, coalesce(o.start_url, n.start_url) AS start_url, 'merged' AS part
        FROM old o FULL JOIN new n ON o.slug = n.slug
        UNION ALL SELECT n.slug, n.start_url, 'refused' FROM new n JOIN old o ON o.slug = n.slug
        UNION ALL SELECT coalesce(n.slug, o.slug), coalesce(n.start_url, o.start_url), 'replaced'
        FROM old o FULL JOIN new n ON o.slug = n.slug""",
    "page_frontier": f"""
        SELECT slug, CAST(p AS INTEGER) AS page_no,
               CASE WHEN p > 1 THEN root || 'jobs?page=' || p WHEN k % 3 = 0 THEN root || 's?q=team+' || s_nationkey ELSE root || 'jobs' END AS url
        FROM (SELECT *, unnest(range(1, CASE WHEN kind IN ('next', 'page_number') AND k % 2 = 0 THEN max_pages ELSE 1 END + 1)) AS p
              FROM ({SUPPLIER_SITES}) WHERE k % 11 <> 0)""",
    "site_listing": f"""
        SELECT k AS slug, CASE WHEN k % 11 = 0 THEN 'sideways' ELSE kind END AS pagination, CAST(k % 3 AS INTEGER) AS popups,
               coalesce(health, '-') AS last_status, coalesce(CAST(n_jobs AS VARCHAR), '-') AS last_jobs
        FROM ({SUPPLIER_SITES}) s LEFT JOIN ({LATEST}) h ON s.k = h.slug""",
    "normalize_jobs": f"""
        SELECT {JOB_COLUMNS.replace("lang AS department", "team AS department")}, 'chars' AS extras FROM ({DOCUMENT_JOBS})""",
    "deduplicate": """
        SELECT doc_id AS ord, lang AS company, source FROM documents
        QUALIFY row_number() OVER (PARTITION BY lower(lang), lower(text) ORDER BY doc_id) = 1""",
    "keyword_score": r"""
        SELECT doc_id, 5 * CAST(regexp_matches(text, '\b(?:copyright|license(d)?)\b', 'i') AS INTEGER)
                       + CAST(regexp_matches(text, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])', 'i') AS INTEGER)
                       + 2 * CAST(regexp_matches(text, '(^|[^\p{L}\p{N}_])(nicht|und)($|[^\p{L}\p{N}_])', 'i') AS INTEGER)
                       - 3 * CAST(regexp_matches(text, '(^|[^\p{L}\p{N}_])(email|e-mail)($|[^\p{L}\p{N}_])', 'i') AS INTEGER) AS score
        FROM documents""",
    "rank_jobs": """
        SELECT * FROM (
            SELECT c_custkey AS ord,
                   ['Software Engineer', 'Senior Back-end Developer', 'SRE', 'Sales Head', 'Intern, SWE'][c_custkey % 5 + 1] || ' ' || c_mktsegment AS title,
                   ['Pune, India', 'Remote', 'Berlin', 'Remote - India'][c_nationkey % 4 + 1] AS location,
                   CAST([10, -3, 0, -8, 6][c_custkey % 5 + 1] + [3, 2, 0, 5][c_nationkey % 4 + 1] AS INTEGER) AS score
            FROM customer) WHERE score >= 5""",
    "keyword_table": r"""
        SELECT doc_id, 5 * CAST(regexp_matches(text, '\b(?:copyright|license(d)?)\b', 'i') AS INTEGER)
                       + CAST(regexp_matches(text, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])', 'i') AS INTEGER)
                       + 2 * CAST(regexp_matches(text, '(^|[^\p{L}\p{N}_])(nicht|und)($|[^\p{L}\p{N}_])', 'i') AS INTEGER)
                       - 3 * CAST(regexp_matches(text, '(^|[^\p{L}\p{N}_])(email|e-mail)($|[^\p{L}\p{N}_])', 'i') AS INTEGER) AS score
        FROM documents""",
    "rank_jobs": """
        SELECT * FROM (
            SELECT c_custkey AS ord,
                   ['Software Engineer', 'Senior Back-end Developer', 'SRE', 'Sales Head', 'Intern, SWE'][c_custkey % 5 + 1] || ' ' || c_mktsegment AS title,
                   ['Pune, India', 'Remote', 'Berlin', 'Remote - India'][c_nationkey % 4 + 1] AS location,
                   CAST([10, -3, 0, -8, 6][c_custkey % 5 + 1] + [3, 2, 0, 5][c_nationkey % 4 + 1] AS INTEGER) AS score
            FROM customer) WHERE score >= 5""",
    "ranked_positions": """
        SELECT ord, score, row_number() OVER (ORDER BY score DESC, ord) - 1 AS place FROM (
        SELECT * FROM (
            SELECT c_custkey AS ord,
                   ['Software Engineer', 'Senior Back-end Developer', 'SRE', 'Sales Head', 'Intern, SWE'][c_custkey % 5 + 1] || ' ' || c_mktsegment AS title,
                   ['Pune, India', 'Remote', 'Berlin', 'Remote - India'][c_nationkey % 4 + 1] AS location,
                   CAST([10, -3, 0, -8, 6][c_custkey % 5 + 1] + [3, 2, 0, 5][c_nationkey % 4 + 1] AS INTEGER) AS score
            FROM customer) WHERE score >= 5)""",
    "ranked_documents": rf"""
        WITH jobs AS (SELECT {JOB_COLUMNS} FROM ({DOCUMENT_JOBS})),
             keyed AS (SELECT *, CASE WHEN job_id IS NOT NULL THEN lower(company) || '|id|' || job_id
                                      WHEN apply_url IS NOT NULL THEN 'url|' || lower(apply_url)
                                      ELSE lower(company) || '|' || lower(title) || '|' || lower(location) END AS key FROM jobs),
             kept AS (SELECT * FROM keyed WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1)
        SELECT ord, company, job_id, apply_url,
               CAST({" + ".join(f"{p} * CAST(regexp_matches(coalesce(title, ''), '(?i)(^|[^[:word:]])(?:{w})($|[^[:word:]])') AS INTEGER)" for w, p in [
                   ("software", 5), ("engineer(ing)?", 5), ("developer", 4), ("sde|swe", 4), ("back[- ]?end", 3), ("front[- ]?end", 3),
                   ("full[- ]?stack", 3), ("intern(ship)?", 2), ("senior|sr", -10), ("staff|principal|director|manager|head", -8)])} AS INTEGER) AS score
        FROM kept""",
    "preview": f"""
        SELECT company, ord, location, job_id FROM (SELECT {JOB_COLUMNS} FROM ({DOCUMENT_JOBS}))
        QUALIFY row_number() OVER (PARTITION BY company ORDER BY ord) <= 8""",
    "union_results": """
        SELECT o_orderkey AS id, o_orderpriority AS title, CAST(NULL AS VARCHAR) AS location FROM orders
        UNION ALL SELECT l_orderkey, NULL, l_returnflag FROM lineitem""",
    "harvest_first_seen": """
        SELECT l_suppkey AS slug, 'id:' || l_partkey AS job_key, l_linenumber AS page_no, l_orderkey AS pos FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_linenumber, l_orderkey) = 1""",
    "pagination_cutoff": f"""
        WITH rows AS ({EVENT_PAGES}),
             seen AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY user_id, job_key ORDER BY page_no, pos) = 1),
             grid AS (SELECT p.user_id, p.page_no, count(s.pos) AS news
                      FROM (SELECT DISTINCT user_id, page_no FROM rows) p
                      LEFT JOIN seen s ON s.user_id = p.user_id AND s.page_no = p.page_no GROUP BY 1, 2),
             ends AS (SELECT user_id, coalesce(min(page_no) FILTER ((page_no > 1 AND news = 0) OR page_no >= 12), max(page_no)) AS pages
                      FROM grid GROUP BY 1)
        SELECT user_id, pages, CAST(sum(news) AS BIGINT) AS n_jobs FROM grid JOIN ends USING (user_id) WHERE page_no <= pages GROUP BY 1, 2""",
    "new_listing_keys": """
        SELECT CAST(o_custkey AS VARCHAR) AS title, o_orderpriority AS apply_url FROM orders WHERE o_orderkey % 2 = 1
        EXCEPT SELECT CAST(o_custkey AS VARCHAR), o_orderpriority FROM orders WHERE o_orderkey % 2 = 0""",
    "health_history": f"""
        SELECT slug, CAST(run_at AS VARCHAR) AS run_at, n_jobs, baseline, health, kept AS count FROM ({HEALTH})""",
    "health_snapshot": f"""
        SELECT slug, 'user ' || slug AS name, CAST(run_at AS VARCHAR) AS last_run, health AS status, kept AS count,
               n_jobs AS last_count, pages, CASE WHEN status = 'error' THEN 'failed' END AS error
        FROM ({LATEST})""",
    "site_run_status": RUN_STATUS,
    "run_summary": f"SELECT name AS company, status, pages, n_jobs AS jobs, error FROM ({RUN_STATUS})",
    "parse_verdict": r"""
        SELECT event_id, CASE event_type WHEN 'click' THEN 'Yes' WHEN 'view' THEN 'Maybe' WHEN 'purchase' THEN 'No' END AS fit,
               CAST(CASE WHEN event_type IN ('click', 'view') THEN least(CAST(json_extract_string(props, '$.k') AS INTEGER), 10)
                         WHEN event_type = 'purchase' THEN 0 END AS INTEGER) AS score,
               CASE event_type WHEN 'click' THEN 'fits' WHEN 'view' THEN 'may"be' WHEN 'purchase' THEN 'x' END AS reason
        FROM events""",
    "build_prompt": """
        SELECT c_custkey, 'You are evaluating how relevant a job posting is for this candidate.' || chr(10) || chr(10) || 'Candidate:' || chr(10) ||
               '- Software engineer looking for Software Engineering roles (Backend / Fullstack / AI)' || chr(10) ||
               '- Prefers locations in India or remote' || chr(10) ||
               '- GOOD roles: Software Engineer, SDE, Backend, Fullstack, AI/ML Engineer' || chr(10) ||
               '- BAD roles: Manager, Sales, HR, Operations, non-technical roles' || chr(10) || chr(10) || 'Job:' || chr(10) ||
               'Title: ' || c_name || chr(10) || 'Company: ' || c_mktsegment || chr(10) || 'Location: ' ||
               CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS VARCHAR) ELSE 'None' END || chr(10) || 'Department: None' || chr(10) || chr(10) ||
               'Reply with JSON only: {"fit": "Yes" | "Maybe" | "No", "score": 0-10, "reason": "one short sentence"}' AS prompt
        FROM customer""",
    "evaluate_jobs": """
        SELECT ord, company, score, CASE WHEN n <= 4000 THEN CASE WHEN company = 'error' THEN 'Unknown' ELSE 'Maybe' END END AS ai_fit,
               CAST(CASE WHEN n <= 4000 THEN CASE WHEN company = 'error' THEN 0 ELSE length(company) END END AS INTEGER) AS ai_score,
               CASE WHEN n <= 4000 THEN CASE WHEN company = 'error' THEN 'evaluation failed: no JSON object in reply' ELSE company END END AS ai_reason
        FROM (SELECT event_id AS ord, event_type AS company, CAST(user_id % 10 AS INTEGER) AS score,
                     row_number() OVER (ORDER BY event_id) AS n FROM events)""",
    "rated_positions": """
        SELECT ord, row_number() OVER (ORDER BY coalesce(ai_score, 0) DESC, score DESC, ord) - 1 AS place FROM (
        SELECT event_id AS ord, CAST(CASE WHEN event_type IN ('click', 'view') THEN least(CAST(json_extract_string(props, '$.k') AS INTEGER), 10)
               WHEN event_type = 'purchase' THEN 0 END AS INTEGER) AS ai_score, CAST(user_id % 10 AS INTEGER) AS score
        FROM events)""",
    "ai_rank": """
        SELECT event_id AS ord, CAST(CASE WHEN event_type IN ('click', 'view') THEN least(CAST(json_extract_string(props, '$.k') AS INTEGER), 10)
               WHEN event_type = 'purchase' THEN 0 END AS INTEGER) AS ai_score, CAST(user_id % 10 AS INTEGER) AS score
        FROM events""",
    "capture_body_plan": """
        SELECT id, mode, ext, CAST(wants AS INTEGER) AS wants_body,
               CASE WHEN wants AND bytes <= 15728640 THEN 'bodies/' || CASE WHEN id < 100000 THEN lpad(CAST(id AS VARCHAR), 5, '0') ELSE CAST(id AS VARCHAR) END || ext END AS body_file,
               CASE WHEN wants AND bytes > 15728640 THEN 'too large' END AS body_skipped
        FROM (SELECT event_id AS id, mode, CAST(floor(value) AS BIGINT) * 100000 AS bytes,
                     CASE event_type WHEN 'click' THEN '.json' WHEN 'view' THEN '.html' WHEN 'purchase' THEN '.js' WHEN 'signup' THEN '.bin' ELSE '.txt' END AS ext,
                     event_type <> 'signup' AND user_id % 6 <> 0 AND (mode = 'all' OR event_type IN ('click', 'view', 'error')) AS wants
              FROM (SELECT *, unnest(['all', 'data']) AS mode FROM events))""",
    "read_capture_index": """
        SELECT event_id AS id, 'https://h.example.com/' || event_type || '?u=' || user_id AS url,
               CAST(CASE WHEN user_id % 6 = 0 THEN 302 ELSE 200 END AS INTEGER) AS status,
               strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, CAST(user_id AS VARCHAR) AS user
        FROM events""",
    "visited_url_templates": """
        SELECT user_id AS visit_id, event_id AS ts,
               CASE WHEN p <> lag(p) OVER w THEN 'https://h.example.com/jobs?t=' || event_type || '&page=' || CASE p WHEN 2 THEN '{page}' ELSE '{offset}' END END AS url_template
        FROM (SELECT *, CAST(floor(value) AS INTEGER) % 4 AS p FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "listing_frame": """
        SELECT 'https://h.example.com/' || user_id AS view_id, event_id AS frame_no, 'https://h.example.com/' || event_type || '?u=' || user_id AS frame_url
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id) = 1""",
    "export_projection": r"""
        SELECT regexp_replace('A' || text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS "Title",
               lang || ', ' || source AS "Department", n_chars AS "Score", CAST(doc_id AS VARCHAR) AS "Job ID"
        FROM documents""",
    "job_sheet_round_trip": """
        SELECT p_name || chr(10) || '"' || p_type || '",' AS title, CASE WHEN p_size > 10 THEN p_brand END AS location,
               CAST(p_partkey AS VARCHAR) AS job_id
        FROM part""",
    "write_run": r"""
        WITH jobs AS (SELECT doc_id AS ord, lang || ' Inc' AS company, CASE WHEN doc_id % 3 = 0 THEN 'Job ID: ' || doc_id END AS job_id,
                             CASE WHEN doc_id % 4 < 2 THEN 'https://x.example.com/' || doc_id || '/?utm_source=a&k=1#f' END AS apply_url,
                             CASE WHEN doc_id % 3 = 0 OR doc_id % 4 < 2 THEN 'u' || doc_id
                                  ELSE lower(lang) || '|' || lower(text) || '|' || lower(source) END AS key FROM documents)
        SELECT 'r1' AS run_id, 'jobs_raw' AS stage, ord, company, job_id, apply_url FROM jobs
        UNION ALL (SELECT 'r1', 'jobs_ranked', ord, company, job_id, apply_url FROM jobs
                   QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1)""",
    "rate_sheet": """
        SELECT CAST(c_custkey AS VARCHAR) AS job_id, title, CAST(c_nationkey % 10 AS VARCHAR) AS score, 'Maybe' AS ai_fit,
               CAST(length(title) % 10 AS VARCHAR) AS ai_score, title AS ai_reason
        FROM (SELECT *, c_mktsegment || ' ' || c_custkey AS title FROM customer)""",
    "ordered_union": """
        SELECT company, id, title, row_number() OVER (ORDER BY k, title DESC, id) - 1 AS ord FROM (
            SELECT 1 AS k, 'supplier' AS company, CAST(s_suppkey AS BIGINT) AS id, s_name AS title FROM supplier
            UNION ALL SELECT 2, 'customer', c_custkey, c_mktsegment FROM customer UNION ALL SELECT 3, 'nation', n_nationkey, n_name FROM nation)""",
    "flatten_dom": """
        SELECT page_id, tag, count(*) AS n
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY 1, 2""",
    "visible_text": r"""
        SELECT page_id, tag, trim(regexp_replace(replace(replace(replace(replace(replace(body, '&copy;', '©'), '&middot;', '·'),
                                  '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
        FROM (SELECT page_id, 'h1' AS tag, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS body FROM pages
              UNION ALL SELECT page_id, 'footer', regexp_extract(html, '<footer>([^<]*)</footer>', 1) FROM pages)""",
    "match_selectors": rf"""
        SELECT page_id, CAST(rank AS INTEGER) AS rank, n FROM (
            SELECT page_id, 0 AS rank, count(*) AS n FROM ({HREFS}) GROUP BY 1
            UNION ALL SELECT page_id, 1, 1 FROM ({HREFS}) WHERE card_no = 2
            UNION ALL SELECT page_id, 2, len(regexp_extract_all(html, '<div class="ad">')) FROM pages
            UNION ALL SELECT page_id, 3, len(regexp_extract_all(html, '<b>')) FROM pages
            UNION ALL SELECT page_id, 4, count(*) FROM ({HREFS}) GROUP BY 1
            UNION ALL SELECT page_id, 6, count(*) FROM ({HREFS}) WHERE href = '/The' GROUP BY 1
            UNION ALL SELECT page_id, 7, count(*) FROM ({HREFS}) WHERE title = 'The' GROUP BY 1)
        WHERE n > 0""",
    "extract_cards": f"SELECT page_id, CAST(card_no AS INTEGER) AS card_no, title, apply_url, CAST(NULL AS VARCHAR) AS job_id FROM ({CARDS})",
    "count_cards": """
        SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href=')) AS BIGINT) AS n_cards FROM pages""",
    "next_control": f"SELECT page_id FROM ({HREFS}) WHERE card_no = 6",
    "selector_report": """
        SELECT page_id, 'a.pager-next → 0 matches; nav > ul > li:nth-of-type(6) > a → ' ||
               CASE WHEN len(regexp_extract_all(html, '<li><a href=')) >= 6 THEN '1 match, visible' ELSE '0 matches' END AS report
        FROM pages""",
    "classify_pagination": f"SELECT page_id, 'next' AS kind, count(*) AS n FROM ({HREFS}) GROUP BY 1",
    "text_category": f"""
        SELECT doc_id, CAST(regexp_matches(text, '{LOCATION_WORDS}') AS INTEGER) AS location,
               CAST(regexp_matches(text, '{DATE_WORDS}') AS INTEGER) AS posted,
               CAST(regexp_matches(text, '{DEPARTMENT_WORDS}') AS INTEGER) AS department
        FROM documents""",
    "site_run_states": f"""
        WITH shut AS (SELECT slug FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS slug, min(page_id) AS first FROM pages GROUP BY 1) WHERE first % 3 = 0),
             run AS (
        WITH fetched AS (SELECT page_id, html, regexp_extract(url, '://([^/]*)', 1) AS slug,
                                row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]*)', 1) ORDER BY page_id) AS page_no FROM pages),
             seen AS (SELECT slug, page_no FROM ({CARDS}) JOIN fetched USING (page_id)
                      QUALIFY row_number() OVER (PARTITION BY slug, apply_url ORDER BY page_no, card_no) = 1),
             grid AS (SELECT f.slug, f.page_no, any_value(len(regexp_extract_all(f.html, '<li><a href='))) >= 6 AS more, count(s.slug) AS news
                      FROM fetched f LEFT JOIN seen s ON s.slug = f.slug AND s.page_no = f.page_no GROUP BY 1, 2),
             ends AS (SELECT slug, coalesce(min(page_no) FILTER ((page_no > 1 AND news = 0) OR page_no >= 5 OR NOT more), max(page_no)) AS pages
                      FROM grid GROUP BY 1)
        SELECT 'r1' AS run_id, slug, slug AS name, CASE WHEN sum(news) > 0 THEN 'ok' ELSE 'empty' END AS status,
               CAST(sum(news) AS INTEGER) AS n_jobs, CAST(pages AS INTEGER) AS pages, CAST(NULL AS VARCHAR) AS error
        FROM grid JOIN ends USING (slug) WHERE page_no <= pages GROUP BY slug, pages)
        SELECT run_id, slug, name, CASE WHEN s.slug IS NULL THEN status ELSE 'blocked' END AS status, CASE WHEN s.slug IS NULL THEN n_jobs ELSE 0 END AS n_jobs,
               CASE WHEN s.slug IS NULL THEN pages ELSE 0 END AS pages, CASE WHEN s.slug IS NOT NULL THEN 'HTTP 403' END AS error
        FROM run LEFT JOIN shut s USING (slug)""",
    "site_run": f"""
        WITH fetched AS (SELECT page_id, html, regexp_extract(url, '://([^/]*)', 1) AS slug,
                                row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]*)', 1) ORDER BY page_id) AS page_no FROM pages),
             seen AS (SELECT slug, page_no FROM ({CARDS}) JOIN fetched USING (page_id)
                      QUALIFY row_number() OVER (PARTITION BY slug, apply_url ORDER BY page_no, card_no) = 1),
             grid AS (SELECT f.slug, f.page_no, any_value(len(regexp_extract_all(f.html, '<li><a href='))) >= 6 AS more, count(s.slug) AS news
                      FROM fetched f LEFT JOIN seen s ON s.slug = f.slug AND s.page_no = f.page_no GROUP BY 1, 2),
             ends AS (SELECT slug, coalesce(min(page_no) FILTER ((page_no > 1 AND news = 0) OR page_no >= 5 OR NOT more), max(page_no)) AS pages
                      FROM grid GROUP BY 1)
        SELECT 'r1' AS run_id, slug, slug AS name, CASE WHEN sum(news) > 0 THEN 'ok' ELSE 'empty' END AS status,
               CAST(sum(news) AS INTEGER) AS n_jobs, CAST(pages AS INTEGER) AS pages, CAST(NULL AS VARCHAR) AS error
        FROM grid JOIN ends USING (slug) WHERE page_no <= pages GROUP BY slug, pages""",
    "scrape_pages": f"""
        SELECT page_id, title, apply_url, 0 AS score FROM ({CARDS})
        QUALIFY row_number() OVER (PARTITION BY lower(apply_url) ORDER BY page_id, card_no) = 1""",
    "element_signature": f"SELECT page_id, {SIGNATURE} AS sig, count(*) AS n FROM ({TAGS}) GROUP BY 1, 2",
    "shared_signatures": f"SELECT page_id, {SIGNATURE} AS shared_sig, count(*) AS n FROM ({TAGS}) GROUP BY 1, 2",
    "path_selectors": f"""
        SELECT page_id, ':scope > ul > li' || CASE WHEN count(*) OVER (PARTITION BY page_id) > 1 THEN ':nth-of-type(' || card_no || ')' ELSE '' END || ' > a' AS path_key
        FROM ({HREFS})""",
    "infer_configs": f"""
        SELECT page_id, CAST(count(*) AS INTEGER) AS count, 'ul > li | li | nav ul > li' AS candidates,
               'a | :scope > a' AS title, 'a | :scope > a' AS apply_url
        FROM ({HREFS}) GROUP BY 1 HAVING count(*) > 1""",
    "learn_sites": f"""
        SELECT 's' || (c_custkey // 10) AS slug, c_name AS title, {PLACE} AS location, c_mktsegment AS department,
               (c_nationkey % 9 + 1) || ' days ago' AS posted, 'c-' || c_custkey AS job_id,
               'https://s' || (c_custkey // 10) || '.example.com/c/' || c_custkey AS apply_url
        FROM customer""",
    "learn_link_templates": """
        SELECT 's' || (c_custkey // 10) AS slug, c_name AS title, 'c-' || c_custkey AS job_id,
               'https://x.example.com/job?id=c-' || c_custkey || '&v=1' AS apply_url
        FROM customer""",
    "verify_sites": """
        SELECT 's' || (c_custkey // 10) AS slug, CAST(count(*) AS INTEGER) AS onboarded_job_count FROM customer GROUP BY 1""",
    "stream_pages": f"SELECT DISTINCT 'feed' AS slug, apply_url AS job_key FROM ({CARDS})",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "learn_and_run": """
        WITH p AS (SELECT c_custkey // 10 AS page, count(*) AS n FROM customer GROUP BY 1)
        SELECT 's' || (page // 2) AS slug, 'ok' AS status, sum(n)::INT AS n_jobs, count(*)::INT AS pages FROM p
        GROUP BY page // 2 HAVING count(*) FILTER (page % 2 = 0 AND n > 1) = 1
    """,
    "control_kinds": """
        SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'page_number' WHEN s_suppkey % 3 = 1 THEN 'load_more' ELSE 'next' END AS kind FROM supplier
    """,
    "shared_names": """
        WITH l AS (SELECT c_custkey // 50 AS page_id, c_custkey % 10 < 8 AS plain, c_custkey % 5 = 0 AS chief,
                          count(*) OVER (PARTITION BY c_custkey // 50) - 1 AS others FROM customer),
             s AS (SELECT *, count(*) FILTER (plain) OVER (PARTITION BY page_id) - 1 >= others * 0.6 AS most,
                          count(*) FILTER (chief) OVER (PARTITION BY page_id) - 1 >= others * 0.6 AS all_chief FROM l)
        SELECT page_id, 'li.item' || CASE WHEN chief AND (all_chief OR others < 2) THEN '.chief' ELSE '' END
                        || CASE WHEN plain AND (most OR others < 2) THEN '.plain' ELSE '' END AS shared_sig, count(*) AS n
        FROM s GROUP BY ALL
    """,
    "control_disabled": """
        SELECT s_suppkey, CASE WHEN s_suppkey % 8 IN (0, 1, 3, 4, 6) THEN 1 ELSE 0 END AS disabled FROM supplier
    """,
    "hidden_cards": """
        SELECT c_custkey // 20 AS page_id, c_name AS title FROM customer WHERE c_custkey % 7 > 2
    """,
    "infer_field": """
        SELECT DISTINCT c_custkey // 10 AS page_id, 'department' AS field, ':scope > div > span:nth-of-type(2)' AS selectors FROM customer
        QUALIFY count(*) OVER (PARTITION BY c_custkey // 10) > 1
    """,
}
ORACLES["stream_harvest"] = ORACLES["harvest_first_seen"]
ORACLES["stream_health"] = ORACLES["health_history"]
