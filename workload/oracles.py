"""The registered queries in plain SQL, written directly from the semantics.

Requests are compared with every listing of their city here; nothing is shared
with the Spark jobs but the fixed values and the derivation of the inputs.
"""

from mealgrid.operators.prompts import SYSTEM_PROMPT
from workload.views import BASE_URL, PER_PAGE, SNAPSHOT_RUN


def _title(x: str) -> str:
    runs = r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '{runs}'), "
        f"lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _slug(x: str) -> str:
    return f"replace(lower({x}), ' ', '-')"


RAW = r"""
raw AS (
  SELECT l_orderkey AS ord, l_linenumber AS line_no, l_partkey AS part_no, l_suppkey AS supp_no,
    CAST(l_quantity AS BIGINT) AS pieces,
    CASE WHEN l_linenumber = 7 AND l_quantity = 50 THEN NULL
         WHEN l_linenumber = 7 AND l_quantity = 49 THEN ' ' || chr(9) || ' '
         WHEN l_linenumber = 4 THEN '  ' || p_name || ' #' || (l_partkey % 50) || chr(9)
         ELSE p_name || ' #' || (l_partkey % 50) END AS name,
    n_name AS city,
    CASE WHEN l_quantity = 1 THEN NULL
         WHEN l_suppkey % 3 = 0 THEN lower(p_brand) || ' o''hare 1st-floor'
         ELSE ' ' || lower(p_brand) END AS location,
    l_suppkey || ' Market Road' AS address,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE replace(upper(p_name), ' ', ', ') END AS cuisines,
    CASE WHEN n_name = 'NATION_7' THEN '0'
         WHEN l_quantity = 13 THEN 'n/a'
         WHEN l_linenumber = 2 THEN 'Rs ' || format('{:,}', CAST(floor(l_extendedprice / 40) AS BIGINT))
         ELSE '₹' || CAST(floor(l_extendedprice / 40) AS BIGINT) END AS cost_text,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'NEW'
         WHEN l_linenumber = 3 AND l_quantity > 45 THEN CAST(l_quantity AS BIGINT) || '/10'
         WHEN l_linenumber = 5 AND l_quantity < 3 THEN '-1.5'
         WHEN l_linenumber = 5 AND l_quantity = 20 THEN '4.1d'
         WHEN l_linenumber % 2 = 0 THEN (l_quantity / 10) || ' /5'
         ELSE CAST(l_quantity / 10 AS VARCHAR) END AS rating_text,
    CASE WHEN l_quantity = 4 THEN '1,' || (l_orderkey % 1000)
         WHEN l_linenumber = 5 THEN (l_orderkey % 1000) || '.7'
         ELSE CAST(l_orderkey % 1000 AS VARCHAR) END AS votes_text,
    CASE WHEN l_linenumber = 3 THEN NULL
         ELSE 'http://img.example/' || l_partkey || '.jpg' END AS image_url,
    '/' || lower(n_name) || '/' || replace(p_name, ' ', '-') || '-'
      || replace(lower(p_brand), '#', '-') || '/info' AS listing_url
  FROM lineitem
  JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey
)"""

COST = r"coalesce(try_cast(nullif(regexp_replace(cost_text, '[^0-9.]', '', 'g'), '') AS DOUBLE), 0)"
RATING = r"""CASE WHEN lower(trim(rating_text)) IN ('new', '-', '--', '', 'nan', 'none') THEN NULL
       WHEN regexp_matches(trim(split_part(rating_text, '/', 1)), '^-?[0-9]+(\.[0-9]+)?$')
       THEN greatest(0.0::DOUBLE, least(5.0::DOUBLE, CAST(trim(split_part(rating_text, '/', 1)) AS DOUBLE))) END"""
VOTES = r"""CASE WHEN regexp_matches(votes_text, '^[0-9]+(\.[0-9]+)?$')
       THEN CAST(trunc(CAST(votes_text AS DOUBLE)) AS BIGINT) ELSE 0 END"""
TIER = """CASE WHEN cost <= 0 THEN 'medium' WHEN cost < 500 THEN 'low'
       WHEN cost < 1500 THEN 'medium' ELSE 'high' END"""

TYPED = f"""
typed AS (
  SELECT ord, line_no, part_no, supp_no, pieces, {_trim("name")} AS name,
    {_title(_trim("coalesce(city, '')"))} AS city,
    {_title(_trim("coalesce(location, 'Unknown')"))} AS location,
    address, lower({_trim("coalesce(cuisines, 'unknown')")}) AS cuisines,
    {COST} AS cost, {RATING} AS rating, {VOTES} AS votes, image_url, listing_url
  FROM raw
)"""

CLEAN = f"""{RAW},
{TYPED},
clean AS (
  SELECT *, {_slug("city")} AS city_slug, {TIER} AS tier FROM typed
  WHERE name <> '' AND rating IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_slug("city")}, name, city ORDER BY ord, line_no, part_no, supp_no, pieces) = 1
)"""

REQUESTS = """
requests AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_custkey % 103 = 7 THEN NULL WHEN c_custkey % 41 = 5 THEN 'Atlantis'
         WHEN c_custkey % 7 = 0 THEN lower(n_name) ELSE n_name END AS city,
    CASE WHEN c_custkey % 11 = 0 THEN 'O''HARE' WHEN c_custkey % 5 = 1 THEN 'BRAND#1'
         WHEN c_custkey % 5 = 2 THEN 'nowhere' WHEN c_custkey % 5 = 3 THEN 'Brand#2'
         WHEN c_custkey % 5 = 4 THEN '' END AS location,
    CASE WHEN c_custkey % 97 = 3 THEN 'ultra' WHEN c_custkey % 101 = 9 THEN NULL
         WHEN c_custkey % 3 = 0 THEN 'low' WHEN c_custkey % 3 = 1 THEN 'medium' ELSE 'high' END AS budget,
    CASE c_custkey % 8 WHEN 1 THEN 'ANVIL' WHEN 2 THEN 'thai' WHEN 3 THEN 'bolt' WHEN 4 THEN ''
         WHEN 5 THEN 'SMALL, R' WHEN 6 THEN 'g' END AS cuisine,
    CASE WHEN c_custkey % 89 = 4 THEN 6.0 WHEN c_custkey % 83 = 6 THEN -1.0
         WHEN c_custkey % 9 = 1 THEN 0.0 WHEN c_custkey % 9 = 2 THEN 5.0 WHEN c_custkey % 9 = 3 THEN 4.2
         WHEN c_custkey % 9 = 4 THEN 3.0 WHEN c_custkey % 9 = 5 THEN 2.5 END::DOUBLE AS min_rating,
    CASE c_custkey % 6 WHEN 1 THEN 'quiet' WHEN 2 THEN '' WHEN 3 THEN 'with a view' END AS additional_preferences
  FROM customer JOIN nation ON n_nationkey = c_nationkey
)"""

VALID = f"""
valid AS (
  SELECT request_id, city, nullif(location, '') AS location, budget, nullif(cuisine, '') AS cuisine,
    coalesce(min_rating, 3.5::DOUBLE) AS min_rating, nullif(additional_preferences, '') AS additional_preferences,
    {_slug("city")} AS city_slug
  FROM requests
  WHERE city IS NOT NULL AND budget IN ('low', 'medium', 'high')
    AND coalesce(min_rating, 3.5) BETWEEN 0 AND 5
)"""


def _cascade(place="contains(lower(c.location), lower(v.location))",
             dish="contains(c.cuisines, lower(v.cuisine))") -> str:
    return f"""
joined AS (
  SELECT v.request_id, v.min_rating, c.* EXCLUDE (city_slug), c.city_slug,
    c.tier = v.budget AS bm, coalesce({dish}, false) AS cm
  FROM valid v JOIN clean c ON c.city_slug = v.city_slug AND (v.location IS NULL OR {place})
),
priced AS (
  SELECT request_id, bool_or(cost > 0) AND bool_or(bm) AS ub FROM joined GROUP BY request_id
),
flags AS (
  SELECT request_id, ub, bool_or(cm AND (bm OR NOT ub)) AS uc
  FROM joined JOIN priced USING (request_id) GROUP BY request_id, ub
),
ranked AS (
  SELECT j.*, row_number() OVER (PARTITION BY request_id ORDER BY rating DESC, votes DESC, ord, line_no, part_no, supp_no, pieces) AS rank
  FROM joined j JOIN flags f USING (request_id)
  WHERE (NOT ub OR bm) AND (NOT uc OR cm) AND rating >= min_rating
  QUALIFY rank <= 15
),
totals AS (SELECT request_id, count(*) AS total_matches FROM ranked GROUP BY request_id),
picked AS (SELECT * FROM ranked JOIN totals USING (request_id))"""


BATCH = f"WITH {CLEAN},{REQUESTS},{VALID},{_cascade()}"

LINE = """rank || '. ' || name || ' | Cuisine: ' || cuisines || ' | Rating: ' || rating || '/5 | Cost: '
  || CASE WHEN cost > 0 THEN '₹' || CAST(trunc(cost) AS BIGINT) || ' for two' ELSE 'Price N/A' END
  || ' | Votes: ' || votes || ' | Location: ' || location || ' | Image: ' || coalesce(image_url, '')
  || ' | URL: ' || listing_url"""

SOURCES = f"""
sources AS (
  SELECT replace(lower(n_name), '_', '-') AS city_slug, n_nationkey,
    CAST(position // {PER_PAGE} + 1 AS INTEGER) AS page_no, position % {PER_PAGE} AS slot,
    p_partkey, p_name, p_size, s_suppkey,
    CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || ' ' || (p_partkey % 5) AS name,
    CASE WHEN p_partkey % 29 = 6 THEN '' WHEN p_partkey % 31 = 7 THEN '/solo'
         ELSE '/x/' || replace(p_name, ' ', '-') || '-' || replace(lower(p_brand), '#', '-') || '/info' END AS url
  FROM (
    SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY p_partkey, s_suppkey) - 1 AS position
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  )
)"""


def _locality(path: str) -> str:
    words = f"string_split(string_split(trim({path}, '/'), '/')[2], '-')"
    return f"""CASE WHEN coalesce({path}, '') = '' OR len(string_split(trim({path}, '/'), '/')) < 2 THEN 'Unknown'
      WHEN len({words}) > 2 THEN {_title(f"array_to_string({words}[-2:], ' ')")}
      ELSE {_title(f"{words}[-1]")} END"""


EXTRACTED = f"""{SOURCES},
items AS (
  SELECT *, slot % 2 AS block_no FROM sources
  WHERE p_partkey % 17 <> 3 AND p_partkey % 19 <> 4 AND p_partkey % 23 <> 5
    AND NOT (page_no = 5 AND n_nationkey % 3 = 0)
),
nth AS (
  SELECT city_slug, page_no, row_number() OVER (PARTITION BY city_slug ORDER BY page_no) AS n
  FROM (SELECT DISTINCT city_slug, page_no FROM items)
),
ends AS (SELECT city_slug, max(page_no) AS last_page FROM nth WHERE n = page_no GROUP BY city_slug),
listings AS (
  SELECT i.* FROM items i JOIN ends e ON e.city_slug = i.city_slug AND i.page_no <= e.last_page
  QUALIFY row_number() OVER (PARTITION BY i.city_slug, lower(name) ORDER BY page_no, block_no, slot) = 1
)"""

# What each form of reply (custkey % 10) amounts to.
REPLIES = """
replies AS (
  SELECT c_custkey AS request_id, c_custkey % 10 AS form, c_name, lower(c_mktsegment) AS cuisine,
    'For ' || c_name AS said,
    CASE c_custkey % 10 WHEN 2 THEN 'no JSON object' WHEN 3 THEN 'no JSON object'
      WHEN 6 THEN 'bad recommendation' WHEN 7 THEN 'bad recommendation'
      WHEN 9 THEN 'recommendations is no list' ELSE 'ok' END AS result
  FROM customer
),
said AS (
  SELECT request_id, p.position, p.position + 1 AS rank,
    c_name || CASE WHEN p.position = 0 THEN '' ELSE ' & Sons!' END AS restaurant_name, cuisine,
    (request_id % 50) / 10 AS rating, '₹' || (request_id * 10) || ' for two' AS estimated_cost,
    'Says "good" {really}' AS explanation,
    CASE WHEN p.position = 0 AND request_id % 4 <> 0 THEN 'http://img.example/1.jpg' END AS image_url,
    CASE WHEN request_id % 3 = 0 THEN 'https://listings.example/' || request_id END AS listing_url
  FROM replies, (VALUES (0), (1)) p(position)
  WHERE result = 'ok' AND form <> 4 AND (p.position = 0 OR request_id % 2 = 0)
)"""

SNAPSHOTS = """
snapshots AS (
  SELECT 'nation-' || (user_id % 25) AS city_slug, event_type || ' ' || event_id AS name, ts FROM events
)"""


DATED = f"""
dated AS (
  SELECT 'nation-' || (user_id % 25) AS city_slug, user_id % 25 AS number, event_id, event_type || ' ' || event_id AS name,
    (event_id % 50) / 10 AS rating, event_id % 100 AS votes, epoch_us(ts) AS moment FROM events
)"""
AGED = f"""{DATED}, lasts AS (SELECT city_slug, max(moment) AS z FROM dated GROUP BY city_slug),
ages AS (SELECT city_slug, 2 * z >= (SELECT min(z) + max(z) FROM lasts) AS city_newer FROM lasts),
aged AS (SELECT *, 2 * moment >= (SELECT min(moment) + max(moment) FROM dated) AS row_newer FROM dated JOIN ages USING (city_slug))"""


def _loaded(kept: str, kept_cities: str) -> str:
    """Kept snapshot rows, and extracted rows of the other cities, as a catalogue."""
    return f"""
SELECT city_slug, name, rating AS aggregate_rating, votes FROM aged WHERE {kept}
UNION ALL
SELECT city_slug, trim(name), greatest(0, least(5, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 10 ELSE 0 END)), p_partkey * 3
FROM listings WHERE city_slug NOT IN (SELECT city_slug FROM aged WHERE {kept_cities})"""


def _fresh(hours: int) -> str:
    return f"SELECT city_slug, name FROM snapshots WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {hours} HOUR"


STATS = """
stats AS (
  SELECT city_slug, count(*) AS total_restaurants, count(DISTINCT location) AS total_locations,
    round_even(CAST(sum(CAST(rating AS DECIMAL(13,12))) AS DOUBLE) / count(*), 2) AS average_rating
  FROM clean GROUP BY city_slug
),
tastes AS (
  SELECT DISTINCT city_slug, trim(t.c) AS cuisine FROM clean, unnest(string_split(cuisines, ',')) t(c)
  WHERE trim(t.c) <> ''
)"""

DISH_TERMS = """exists (SELECT 1 FROM unnest(string_split(lower(v.cuisine), ',')) t(w)
      WHERE trim(t.w) <> '' AND contains(c.cuisines, trim(t.w)))"""

ORACLES = {
    "clean_catalog": f"""WITH {CLEAN}
SELECT city_slug, name, city, location, address, cuisines, cost AS average_cost_for_two,
  tier AS budget_category, rating AS aggregate_rating, votes, image_url, listing_url, ord, line_no, part_no, supp_no, pieces FROM clean""",
    "clean_report": f"""WITH {RAW}, {TYPED},
m AS (SELECT {_slug("city")} AS city_slug, city, name, coalesce(name <> '', false) AS named,
        coalesce(name <> '', false) AND rating IS NOT NULL AS rated FROM typed)
SELECT city_slug, count(*) AS received, count(*) FILTER (named) AS named, count(*) FILTER (rated) AS rated,
  count(DISTINCT name) FILTER (rated) AS kept,
  count(*) FILTER (rated) - count(DISTINCT name) FILTER (rated) AS duplicates
FROM m GROUP BY city_slug""",
    "row_index": f"""WITH {CLEAN}
SELECT city_slug, name, row_number() OVER (PARTITION BY city_slug ORDER BY ord, line_no, part_no, supp_no, pieces) - 1 AS row_index FROM clean""",
    "cost_bucket_counts": f"""WITH {RAW}, c AS (SELECT {COST} AS cost FROM raw)
SELECT {TIER} AS budget_category, count(*) AS restaurants, max(cost) AS max_cost FROM c GROUP BY 1""",
    "rating_parse": f"""WITH {RAW}
SELECT rating_text, {RATING} AS rating, count(*) AS restaurants FROM raw GROUP BY 1, 2""",
    "dedup_first_ci": f"""WITH {SOURCES}
SELECT city_slug AS city, name, page_no, slot FROM sources
QUALIFY row_number() OVER (PARTITION BY city_slug, lower(name) ORDER BY page_no, slot) = 1""",
    "dedup_first_exact": f"""WITH {RAW}
SELECT city, name, ord, line_no, part_no, supp_no, pieces FROM raw WHERE name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY city, name ORDER BY ord, line_no, part_no, supp_no, pieces) = 1""",
    "budget_ranges": f"""WITH {REQUESTS},
tiers(tier, lo, hi) AS (VALUES ('low', 0::DOUBLE, 500::DOUBLE), ('medium', 500, 1500), ('high', 1500, 'inf'::DOUBLE))
SELECT request_id, budget, lo AS min_cost, hi AS max_cost, tier IS NOT NULL AS known_tier
FROM requests LEFT JOIN tiers ON tier = budget""",
    "facet_locations": f"""WITH {CLEAN}
SELECT DISTINCT city_slug, location FROM clean WHERE location <> 'Unknown'""",
    "facet_cuisines": f"WITH {CLEAN}, {STATS} SELECT city_slug, cuisine FROM tastes",
    "tier_counts": f"""WITH {CLEAN}
SELECT city_slug, tier AS budget_category, count(*) AS restaurants FROM clean GROUP BY 1, 2""",
    "city_stats": f"""WITH {CLEAN}, {STATS}
SELECT city_slug, total_restaurants, total_locations,
  (SELECT count(*) FROM tastes t WHERE t.city_slug = s.city_slug) AS total_cuisines, average_rating FROM stats s""",
    "city_status": f"""WITH {CLEAN}, {STATS}, {REQUESTS},
cities AS (SELECT DISTINCT {_slug("city")} AS city_slug FROM requests WHERE city IS NOT NULL)
SELECT city_slug, {_title("replace(city_slug, '-', ' ')")} AS city,
  coalesce(total_restaurants, 0) AS total_restaurants, average_rating,
  CASE WHEN total_restaurants > 0 THEN 'ok' ELSE 'not_found' END AS status
FROM cities LEFT JOIN stats USING (city_slug)""",
    "recommend_batch": f"""{BATCH}
SELECT request_id, rank, name, city, location, cuisines, tier AS budget_category,
  cost AS average_cost_for_two, rating AS aggregate_rating, votes, total_matches FROM picked""",
    "recommend_status": f"""{BATCH}
SELECT request_id, CASE WHEN total_matches > 0 THEN 'ok'
    WHEN city_slug IN (SELECT city_slug FROM clean) THEN 'no_match' ELSE 'no_data' END AS status,
  coalesce(total_matches, 0) AS total_matches FROM valid LEFT JOIN totals USING (request_id)""",
    "recommend_rejected": f"""WITH {REQUESTS}
SELECT request_id, budget, reason FROM (
  SELECT request_id, budget, CASE WHEN city IS NULL THEN 'city is required' WHEN budget IS NULL THEN 'budget is required'
    WHEN budget NOT IN ('low', 'medium', 'high') THEN 'unknown budget'
    WHEN min_rating < 0 OR min_rating > 5 THEN 'min_rating out of range' END AS reason FROM requests)
WHERE reason IS NOT NULL""",
    "recommend_patterns": f"""WITH {CLEAN},{REQUESTS},{VALID.replace("WHERE city", "WHERE request_id % 13 <> 6 AND city").replace("nullif(location, '')", "CASE WHEN location LIKE 'B%' THEN location || '[0-9]?$' ELSE nullif(location, '') END").replace("nullif(cuisine, '')", "'^' || lower(nullif(cuisine, ''))")},
{_cascade("regexp_matches(lower(c.location), lower(v.location))", "regexp_matches(c.cuisines, v.cuisine)")}
SELECT request_id, rank, name, total_matches FROM picked""",
    "example_query": f"""WITH {CLEAN},
valid AS (SELECT CAST(n_nationkey AS BIGINT) AS request_id, 'Brand#12' AS location, 'medium' AS budget,
  CAST(NULL AS VARCHAR) AS cuisine, 4.2::DOUBLE AS min_rating, {_slug("n_name")} AS city_slug FROM nation),
{_cascade()}
SELECT request_id, rank, name, rating AS aggregate_rating, votes FROM picked""",
    "extract_listings": f"""WITH {EXTRACTED}
SELECT city_slug, page_no, name, {_title("replace(city_slug, '-', ' ')")} AS city, {_locality("url")} AS location,
  s_suppkey || ' Market Road' AS address, replace(p_name, ' ', ', ') AS cuisines,
  CASE WHEN p_partkey % 5 <> 0 THEN p_size / 10 ELSE 0 END::DOUBLE AS aggregate_rating, p_partkey * 3 AS votes,
  CASE WHEN p_partkey % 4 <> 0 THEN 'http://img.example/' || p_partkey ELSE '' END AS image_url,
  '{BASE_URL}' || url AS listing_url, '0' AS average_cost_for_two FROM listings""",
    "page_prefix": f"WITH {EXTRACTED} SELECT city_slug, last_page FROM ends",
    "locality_from_url": f"""WITH {RAW},
urls AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages
  UNION ALL SELECT DISTINCT -1, listing_url FROM raw)
SELECT page_id, path, {_locality("path")} AS location FROM urls""",
    "fresh_snapshots": f"WITH {SNAPSHOTS} {_fresh(6)}",
    "cache_first_resolve": f"""WITH {SNAPSHOTS}, {EXTRACTED}, fresh AS ({_fresh(1)})
SELECT city_slug, name, true AS from_snapshot FROM fresh
WHERE city_slug IN (SELECT replace(lower(n_name), '_', '-') FROM nation)
UNION ALL
SELECT city_slug, name, false FROM listings WHERE city_slug NOT IN (SELECT city_slug FROM fresh)""",
    "snapshot_refresh": f"WITH {AGED} SELECT city_slug, name, city_newer AS is_new FROM aged WHERE NOT city_newer OR row_newer",
    "snapshot_clear": f"WITH {DATED} SELECT city_slug, name FROM dated",
    "snapshot_clear_city": f"WITH {DATED} SELECT city_slug, name, CAST(rating AS VARCHAR) AS aggregate_rating FROM dated WHERE number <> 3",
    "snapshot_json": f"""WITH {DATED}
SELECT city_slug, CAST(row_number() OVER (PARTITION BY city_slug, event_id // {SNAPSHOT_RUN} ORDER BY event_id) - 1 AS INTEGER) AS item_no, name,
  CAST(votes AS VARCHAR) AS votes FROM dated WHERE number <> 7""",
    "load_catalogue_saved": f"WITH {AGED}, {EXTRACTED}" + _loaded("city_newer", "city_newer"),
    "load_catalogue_json": f"WITH {AGED}, {EXTRACTED}"
    + _loaded("CASE WHEN city_newer THEN row_newer ELSE number <> 7 END", "city_newer OR number <> 7"),
    "clean_bare": f"""WITH {RAW},{TYPED}
SELECT {_slug("city")} AS city_slug, name, location, 'medium' AS budget_category, 0::DOUBLE AS average_cost_for_two,
  0::DOUBLE AS aggregate_rating, 0::BIGINT AS votes, '' AS image_url, '' AS address FROM typed WHERE name <> ''
QUALIFY row_number() OVER (PARTITION BY {_slug("city")}, name, city ORDER BY ord, line_no, part_no, supp_no, pieces) = 1""",
    "prompt_lines": f"{BATCH} SELECT request_id, rank, {LINE} AS line FROM picked",
    "prompt_batch": f"""{BATCH},
texts AS (SELECT request_id, string_agg({LINE}, chr(10) ORDER BY rank) AS lines FROM picked GROUP BY request_id)
SELECT request_id, 'Wishes:' || chr(10) || '- City: ' || city || chr(10) || '- Location: ' || coalesce(location, 'Any')
  || chr(10) || '- Budget: ' || budget || chr(10) || '- Cuisine: ' || coalesce(cuisine, 'Any')
  || chr(10) || '- Minimum rating: ' || min_rating || chr(10) || '- Also: ' || coalesce(additional_preferences, 'None')
  || chr(10) || chr(10) || 'Candidates:' || chr(10) || lines || chr(10) || chr(10)
  || 'Recommend the five best and explain each choice.' AS user_prompt,
  CAST({len(SYSTEM_PROMPT)} AS BIGINT) AS system_length
FROM valid JOIN texts USING (request_id)""",
    "parse_responses": f"""WITH {REPLIES}
SELECT request_id, CAST(position AS INTEGER) AS position, CAST(rank AS BIGINT) AS rank, restaurant_name, cuisine,
  rating, estimated_cost, explanation, image_url, listing_url FROM said""",
    "response_status": f"""WITH {REPLIES}
SELECT request_id, result,
  CASE WHEN result = 'ok' THEN (SELECT count(*) FROM said s WHERE s.request_id = r.request_id) END AS recommended,
  CASE WHEN result = 'ok' THEN CASE WHEN form = 5 THEN '' ELSE said END END AS summary FROM replies r""",
    "respond": f"""{BATCH},{REPLIES}
SELECT request_id, v.city, v.budget,
  (SELECT count(*) FROM said s WHERE s.request_id = v.request_id) AS recommended, total_matches,
  CASE WHEN form = 5 THEN '' ELSE r.said END AS ai_summary
FROM valid v JOIN totals USING (request_id) JOIN replies r USING (request_id) WHERE r.result = 'ok'""",
    "result_cards": f"""WITH {REPLIES}
SELECT request_id, CAST(position AS INTEGER) AS position, CAST(floor(rating) AS BIGINT) AS full_stars,
  CAST(rating - floor(rating) >= 0.5 AS BIGINT) AS half_stars,
  5 - CAST(floor(rating) AS BIGINT) - CAST(rating - floor(rating) >= 0.5 AS BIGINT) AS empty_stars,
  'card-' || regexp_replace(regexp_replace(lower(restaurant_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS card_id,
  coalesce(starts_with(image_url, 'http'), false) AS has_image,
  coalesce(starts_with(listing_url, 'http'), false) AS has_link FROM said""",
    "slug_ids": f"""WITH {RAW}
SELECT DISTINCT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug
FROM raw WHERE name IS NOT NULL""",
    "ext_suggest_places": f"""WITH {CLEAN},{REQUESTS.replace("requests AS", "plain AS")},
requests AS (SELECT * REPLACE ('bx' || substr(lower(location), 2) AS location) FROM plain),{VALID},
known AS (SELECT DISTINCT city_slug, lower(location) AS place_key FROM clean),
asked AS (SELECT DISTINCT city_slug, lower(location) AS place FROM valid v WHERE location IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.city_slug = v.city_slug AND contains(place_key, lower(v.location))))
SELECT city_slug, place, place_key, levenshtein(place, place_key) AS distance
FROM asked JOIN known USING (city_slug) WHERE levenshtein(place, place_key) <= 2""",
    "ext_suggest_cuisines": f"""WITH {CLEAN},{REQUESTS.replace("requests AS", "plain AS")},
requests AS (SELECT * REPLACE (substr(cuisine, 1, 2) || 'q' || substr(cuisine, 4) AS cuisine) FROM plain),{VALID},{STATS},
asked AS (SELECT DISTINCT city_slug, lower(cuisine) AS dish FROM valid v WHERE cuisine IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM clean c WHERE c.city_slug = v.city_slug AND contains(c.cuisines, lower(v.cuisine))))
SELECT city_slug, dish, cuisine, levenshtein(dish, cuisine) AS distance
FROM asked JOIN tastes USING (city_slug) WHERE levenshtein(dish, cuisine) <= 2""",
    "ext_popular_places": f"""WITH {CLEAN},{REQUESTS},{VALID},
sizes AS (SELECT city_slug, location, count(*) AS restaurants FROM clean GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY city_slug ORDER BY restaurants DESC, location) AS position
  FROM sizes QUALIFY position <= 10),
asked AS (SELECT DISTINCT city_slug, lower(location) AS place FROM valid v WHERE location IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM sizes k WHERE k.city_slug = v.city_slug
    AND contains(lower(k.location), lower(v.location))))
SELECT city_slug, place, position, location, restaurants FROM asked JOIN best USING (city_slug)""",
    "ext_any_cuisine": f"""WITH {CLEAN},{REQUESTS.replace("requests AS", "plain AS")},
requests AS (SELECT * REPLACE (concat_ws(', ', cuisine, CASE WHEN request_id % 2 = 0 THEN 'Ring, small' END) AS cuisine)
  FROM plain),{VALID},{_cascade(dish=DISH_TERMS)}
SELECT request_id, rank, name, cuisines, total_matches FROM picked""",
    "ext_relaxed": f"""WITH {CLEAN},{REQUESTS},{VALID},
near(tier, budget) AS (VALUES ('low', 'medium'), ('medium', 'low'), ('medium', 'high'), ('high', 'medium')),
joined AS (
  SELECT v.request_id, v.min_rating, c.*, c.tier = v.budget AS same, v.cuisine IS NULL OR contains(c.cuisines, lower(v.cuisine)) AS cm,
    c.tier = v.budget OR EXISTS (SELECT 1 FROM near n WHERE n.tier = c.tier AND n.budget = v.budget) AS close
  FROM valid v JOIN clean c ON c.city_slug = v.city_slug
    AND (v.location IS NULL OR contains(lower(c.location), lower(v.location)))
),
levels AS (
  SELECT *, CASE WHEN same AND cm AND rating >= min_rating THEN 0 WHEN same AND rating >= min_rating THEN 1
    WHEN same AND rating >= min_rating - 0.5 THEN 2 WHEN close AND rating >= min_rating - 0.5 THEN 3 END AS own
  FROM joined
),
reached AS (SELECT request_id, min(own) AS level FROM levels GROUP BY request_id),
picks AS (
  SELECT request_id, name, row_number() OVER (PARTITION BY request_id ORDER BY rating DESC, votes DESC, ord, line_no, part_no, supp_no, pieces) AS rank
  FROM levels JOIN reached USING (request_id) WHERE own <= level QUALIFY rank <= 15
),
sizes AS (SELECT request_id, count(*) AS n FROM picks GROUP BY request_id)
SELECT request_id, CAST(coalesce(level, 4) AS BIGINT) AS level,
  CASE coalesce(level, 4) WHEN 0 THEN '' WHEN 1 THEN 'cuisine dropped' WHEN 2 THEN 'rating lowered'
    WHEN 3 THEN 'budget widened' ELSE 'no restaurants in this location' END AS note,
  coalesce(n, 0) AS total_matches, rank, name
FROM valid LEFT JOIN reached USING (request_id) LEFT JOIN sizes USING (request_id) LEFT JOIN picks USING (request_id)""",
    "ext_guarded_replies": f"""{BATCH},
kept AS (
  SELECT request_id, name, rating, cost,
    row_number() OVER (PARTITION BY request_id ORDER BY CASE rank WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE rank END) - 1 AS place
  FROM picked WHERE rank <= 7 QUALIFY place < 5
)
SELECT request_id, CAST(place AS INTEGER) AS position, name AS restaurant_name, rating,
  CASE WHEN cost > 0 THEN '₹' || CAST(trunc(cost) AS BIGINT) || ' for two' ELSE 'Price N/A' END AS estimated_cost FROM kept""",
    "ext_voted_only": f"WITH {CLEAN} SELECT city_slug, count(*) AS restaurants FROM clean WHERE votes > 0 GROUP BY 1",
    "ext_located_only": f"WITH {RAW} SELECT city, count(*) AS restaurants FROM raw WHERE trim(location) <> '' GROUP BY 1",
    "ext_most_voted": f"""WITH {RAW},{TYPED}
SELECT {_slug("city")} AS city_slug, name, location, votes, ord, line_no, part_no, supp_no, pieces FROM typed WHERE name <> '' AND rating IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY city, name, location ORDER BY votes DESC, ord, line_no, part_no, supp_no, pieces) = 1""",
    "ext_checked_listings": f"WITH {RAW} SELECT city, count(*) AS received FROM raw GROUP BY city",
    "ext_tidy_requests": f"""WITH {REQUESTS}
SELECT request_id, {_trim("regexp_replace(location, '[^A-Za-z0-9 -]', '', 'g')")} AS location, lower(budget) AS budget,
  round_even(greatest(0, least(5, min_rating)), 1) * CASE WHEN min_rating IS NULL THEN NULL ELSE 1 END AS min_rating,
  substr(additional_preferences, 1, 500) AS additional_preferences,
  NOT coalesce(regexp_matches(regexp_replace(location, '[^A-Za-z0-9 -]', '', 'g'), '^[0-9]+$'), false) AS usable
FROM requests""",
    "ext_details": f"""WITH {CLEAN},
details AS (SELECT listing_url AS url, CAST(max(pieces * 50) AS DOUBLE) AS detail_cost, max(address) AS features
  FROM raw GROUP BY listing_url),
c AS (SELECT city_slug, name, CASE WHEN cost > 0 THEN cost ELSE coalesce(detail_cost, 0) END AS cost, features
  FROM clean LEFT JOIN details ON url = listing_url)
SELECT city_slug, name, cost AS average_cost_for_two, {TIER} AS budget_category, features FROM c""",
}
ORACLES |= {
    "kept_catalogue": ORACLES["clean_catalog"],
    "facet_deltas": ORACLES["city_stats"],
    "region_statistics": f"""WITH {CLEAN},
placed AS (
  SELECT r_name AS region, n_name AS nation, clean.* FROM clean JOIN nation ON city_slug = {_slug("n_name")} JOIN region ON n_regionkey = r_regionkey
), tastes AS (
  SELECT region, nation, trim(unnest(string_split(cuisines, ','))) AS taste FROM placed
), tasted AS (
  SELECT region, nation, count(DISTINCT taste) AS n, 2 - grouping(region) - grouping(nation) AS depth FROM tastes WHERE taste <> ''
  GROUP BY GROUPING SETS ((region, nation), (region), ())
), based AS (
  SELECT region, nation, 2 - grouping(region) - grouping(nation) AS depth, count(*) AS total_restaurants, count(DISTINCT location) AS total_locations,
    round_even(cast(sum(cast(rating AS decimal(18, 12))) AS double) / count(*), 2) AS average_rating
  FROM placed GROUP BY GROUPING SETS ((region, nation), (region), ())
)
SELECT b.region, b.nation, cast(b.depth AS integer) AS depth, total_restaurants, total_locations, coalesce(t.n, 0) AS total_cuisines, average_rating
FROM based AS b LEFT JOIN tasted AS t ON b.depth = t.depth AND b.region IS NOT DISTINCT FROM t.region AND b.nation IS NOT DISTINCT FROM t.nation""",
    "rolling_cells": f"""WITH {CLEAN}
SELECT city_slug, lower(location) AS place_key, tier AS budget_category, cost > 0 AS cost_known, cuisines, name, rating AS aggregate_rating, votes,
  ord, line_no, part_no, supp_no, pieces FROM clean
QUALIFY row_number() OVER (PARTITION BY city_slug, lower(location), tier, cost > 0, cuisines ORDER BY rating DESC, votes DESC, ord, line_no, part_no, supp_no, pieces) <= 15""",
}
