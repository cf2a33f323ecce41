"""ANSI SQL twins of the registered queries, for an independent engine.

Shared subqueries are named here once; :func:`twin` puts those a statement needs
in front of it.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}

PARTS["delivered"] = """
SELECT *, CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT) AS k
FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0)
"""

PARTS["clicks"] = """
SELECT ts AS event_time,
       CASE WHEN event_type = 'click' THEN 'cart' ELSE event_type END AS event_type,
       k AS product_id, k % 10 AS category_id,
       CASE WHEN k % 10 <= 1 THEN NULL WHEN k % 10 <= 3 THEN 'electronics.smartphone'
            WHEN k % 10 <= 5 THEN 'electronics.audio.headphone'
            WHEN k % 10 <= 7 THEN 'computers.notebook' ELSE 'furniture' END AS category_code,
       CASE WHEN k % 7 <> 0 THEN 'brand_' || CAST(k % 25 AS VARCHAR) END AS brand,
       value AS price, user_id,
       CASE WHEN event_id % 97 <> 0
            THEN CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') END AS user_session
FROM delivered
"""

PARTS["silver"] = """
SELECT DISTINCT * FROM clicks
WHERE event_time IS NOT NULL AND event_type IN ('view', 'cart', 'purchase')
  AND product_id IS NOT NULL AND user_id IS NOT NULL AND price >= 0
"""

PARTS["first_cart"] = """
SELECT user_session, user_id, min(event_time) AS first_cart_time
FROM silver WHERE event_type = 'cart' GROUP BY user_session, user_id
"""

PARTS["timed"] = """
SELECT s.*, f.first_cart_time
FROM silver s LEFT JOIN first_cart f
  ON s.user_session = f.user_session AND s.user_id = f.user_id
"""

PARTS["session_totals"] = """
SELECT user_session AS session_id, user_id,
       sum(CASE WHEN event_type = 'cart' THEN price ELSE 0 END) AS total_cart_value,
       count(*) FILTER (WHERE event_type = 'cart') AS num_cart_items,
       count(*) FILTER (WHERE event_type = 'view' AND event_time < first_cart_time)
         AS num_views_before_cart,
       count(*) FILTER (WHERE event_type = 'purchase') AS num_purchases,
       min(event_time) AS session_start, max(event_time) AS session_end,
       min(first_cart_time) AS first_cart_time
FROM timed GROUP BY user_session, user_id
"""

PARTS["session_features"] = """
SELECT *, CAST(floor(epoch(session_end)) AS BIGINT) - CAST(floor(epoch(session_start)) AS BIGINT)
         AS session_duration_sec,
       CAST(hour(first_cart_time) AS DOUBLE) AS hour_of_day,
       CASE WHEN hour(first_cart_time) >= 22 OR hour(first_cart_time) < 6 THEN 1 ELSE 0 END
         AS is_night,
       num_views_before_cart / num_cart_items AS view_to_cart_ratio,
       CASE WHEN num_purchases = 0 THEN 1 ELSE 0 END AS is_abandoned,
       CASE WHEN num_purchases = 0 THEN 0 ELSE 1 END AS converted
FROM session_totals WHERE num_cart_items > 0
"""

PARTS["pre_cart"] = """
SELECT *, (event_type = 'view' AND event_time < first_cart_time) AS viewed,
       (event_type = 'cart' AND event_time = first_cart_time) AS at_cart
FROM timed WHERE first_cart_time IS NOT NULL AND event_time <= first_cart_time
"""

PARTS["pre_cart_totals"] = """
SELECT user_session AS session_id, user_id, min(event_time) AS first_event_time,
       min(first_cart_time) AS first_cart_time,
       count(*) FILTER (WHERE viewed) AS num_views_before_cart,
       count(DISTINCT product_id) FILTER (WHERE viewed) AS unique_products_viewed,
       count(DISTINCT category_id) FILTER (WHERE viewed) AS unique_categories_viewed,
       count(DISTINCT brand) FILTER (WHERE viewed) AS unique_brands_viewed,
       coalesce(avg(price) FILTER (WHERE viewed), 0.0) AS avg_viewed_price,
       coalesce(min(price) FILTER (WHERE viewed), 0.0) AS min_viewed_price,
       coalesce(max(price) FILTER (WHERE viewed), 0.0) AS max_viewed_price,
       sum(price) FILTER (WHERE at_cart) AS cart_value_at_first_cart,
       count(*) FILTER (WHERE at_cart) AS num_cart_items_at_first_cart,
       avg(price) FILTER (WHERE at_cart) AS avg_cart_item_price,
       max(price) FILTER (WHERE at_cart) AS max_cart_item_price
FROM pre_cart GROUP BY user_session, user_id
"""

PARTS["ml_features"] = """
SELECT p.*,
       CAST(floor(epoch(p.first_cart_time)) AS BIGINT)
         - CAST(floor(epoch(p.first_event_time)) AS BIGINT) AS time_to_first_cart_sec,
       CAST(hour(p.first_cart_time) AS DOUBLE) AS hour_of_day,
       CASE WHEN hour(p.first_cart_time) >= 22 OR hour(p.first_cart_time) < 6 THEN 1 ELSE 0 END
         AS is_night,
       p.num_views_before_cart / p.num_cart_items_at_first_cart AS view_to_cart_ratio,
       p.max_viewed_price - p.min_viewed_price AS viewed_price_range,
       s.is_abandoned, s.converted
FROM pre_cart_totals p JOIN session_features s
  ON p.session_id = s.session_id AND p.user_id = s.user_id
"""

PARTS["history"] = """
SELECT *, count(session_id) OVER w AS user_prior_sessions,
       CAST(coalesce(sum(converted) OVER w, 0) AS BIGINT) AS user_prior_conversions,
       CAST(coalesce(sum(is_abandoned) OVER w, 0) AS BIGINT) AS user_prior_abandonments,
       min(first_cart_time) OVER w AS user_first_prior_cart_time
FROM ml_features
WINDOW w AS (PARTITION BY user_id ORDER BY first_cart_time, session_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""

PARTS["history_features"] = """
SELECT *,
       CASE WHEN user_prior_sessions > 0 THEN user_prior_conversions / user_prior_sessions
            ELSE 0.0 END AS user_prior_conversion_rate,
       CASE WHEN user_prior_sessions > 0 THEN user_prior_abandonments / user_prior_sessions
            ELSE 0.0 END AS user_prior_abandon_rate,
       CASE WHEN user_first_prior_cart_time IS NULL THEN 0.0 ELSE
         (CAST(floor(epoch(first_cart_time)) AS BIGINT)
          - CAST(floor(epoch(user_first_prior_cart_time)) AS BIGINT)) / 3600.0 END
         AS user_lifetime_hours
FROM history
"""

_DERIVED = """
       CASE WHEN time_to_first_cart_sec > 0
            THEN num_views_before_cart / (time_to_first_cart_sec / 60.0) ELSE 0.0 END
         AS views_per_minute,
       CASE WHEN num_cart_items_at_first_cart > 0
            THEN cart_value_at_first_cart / num_cart_items_at_first_cart ELSE 0.0 END
         AS cart_value_per_item,
       CASE WHEN avg_viewed_price > 0 THEN viewed_price_range / avg_viewed_price ELSE 0.0 END
         AS price_spread_ratio,
       CASE WHEN unique_products_viewed > 0
            THEN num_views_before_cart / unique_products_viewed ELSE 0.0 END
         AS product_revisit_rate,
       CASE WHEN unique_products_viewed > 0
            THEN unique_categories_viewed / unique_products_viewed ELSE 0.0 END
         AS category_diversity_ratio,
       CASE WHEN unique_products_viewed > 0
            THEN unique_brands_viewed / unique_products_viewed ELSE 0.0 END
         AS brand_diversity_ratio,
       CASE WHEN num_views_before_cart > 0
            THEN num_cart_items_at_first_cart / num_views_before_cart ELSE 0.0 END
         AS cart_to_view_ratio,
       CASE WHEN avg_viewed_price > 0 THEN cart_value_at_first_cart / avg_viewed_price
            ELSE 0.0 END AS cart_value_vs_avg_viewed_price,
       CASE WHEN num_views_before_cart > 0
            THEN time_to_first_cart_sec / num_views_before_cart ELSE 0.0 END
         AS seconds_per_view,
       CASE WHEN time_to_first_cart_sec <= 120 AND num_views_before_cart <= 5
            THEN 1.0 ELSE 0.0 END AS fast_cart_flag,
       CASE WHEN num_views_before_cart >= 10 AND unique_products_viewed >= 5
            THEN 1.0 ELSE 0.0 END AS high_exploration_flag,
       CAST(is_night * num_views_before_cart AS DOUBLE) AS night_views_interaction,
       ln(1 + greatest(CAST(time_to_first_cart_sec AS DOUBLE), 0.0)) AS log_time_to_first_cart,
       ln(1 + greatest(cart_value_at_first_cart, 0.0)) AS log_cart_value
"""

PARTS["derived"] = f"SELECT *, {_DERIVED} FROM ml_features"
PARTS["dataset"] = f"SELECT *, {_DERIVED} FROM history_features"

PARTS["keyed"] = """
SELECT session_id, user_id, converted, is_abandoned,
       md5(session_id || '|' || CAST(user_id AS VARCHAR) || '|42') AS digest
FROM ml_features
"""

PARTS["cart_totals"] = """
SELECT user_session, arg_min(user_id, (event_time, user_id)) AS user_id,
       count(*) FILTER (WHERE event_type = 'cart') AS num_cart_items,
       sum(price) FILTER (WHERE event_type = 'cart') AS total_cart_value,
       max(price) FILTER (WHERE event_type = 'cart') AS max_item_price,
       min(price) FILTER (WHERE event_type = 'cart') AS min_item_price,
       avg(price) FILTER (WHERE event_type = 'cart') AS avg_item_price,
       count(DISTINCT brand) FILTER (WHERE event_type = 'cart') AS num_distinct_brands,
       count(DISTINCT category_code) FILTER (WHERE event_type = 'cart')
         AS num_distinct_categories,
       count(*) FILTER (WHERE event_type = 'view') AS num_views_before_cart,
       min(event_time) AS first_event_time,
       max(event_time) FILTER (WHERE event_type = 'cart') AS last_cart_time,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchases
FROM silver WHERE user_session IS NOT NULL GROUP BY user_session
"""

PARTS["top_category"] = """
SELECT user_session, category_code FROM (
  SELECT user_session, category_code,
         row_number() OVER (PARTITION BY user_session ORDER BY n DESC, category_code) AS place
  FROM (SELECT user_session, category_code, count(*) AS n FROM silver
        WHERE event_type = 'cart' AND category_code IS NOT NULL AND user_session IS NOT NULL
        GROUP BY user_session, category_code)) WHERE place = 1
"""

PARTS["cart_features"] = """
SELECT t.user_session, t.user_id, num_cart_items, total_cart_value, max_item_price,
       min_item_price, avg_item_price, num_distinct_brands, num_distinct_categories,
       coalesce(split_part(c.category_code, '.', 1), 'other') AS main_category,
       num_views_before_cart,
       num_views_before_cart / greatest(num_cart_items, 1) AS view_to_cart_ratio,
       greatest((epoch_us(last_cart_time) - epoch_us(first_event_time)) / 1e6, 0.0)
         AS session_duration_sec,
       CAST(hour(last_cart_time) AS DOUBLE) AS hour_of_day,
       CAST(isodow(last_cart_time) - 1 AS INTEGER) AS day_of_week,
       CASE WHEN isodow(last_cart_time) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN hour(last_cart_time) >= 22 OR hour(last_cart_time) < 6 THEN 1 ELSE 0 END
         AS is_night,
       CASE WHEN purchases = 0 THEN 1 ELSE 0 END AS is_abandoned
FROM cart_totals t LEFT JOIN top_category c ON t.user_session = c.user_session
WHERE num_cart_items > 0
"""

PARTS["labelled"] = """
SELECT session_id, user_id, total_cart_value, num_cart_items, num_views_before_cart,
       session_duration_sec, hour_of_day, is_night,
       CASE WHEN num_views_before_cart <= 3 AND session_duration_sec < 90 THEN 'high_intent'
            WHEN num_views_before_cart >= 6 OR (is_night = 1 AND total_cart_value >= 400)
            THEN 'bargain_hunter' ELSE 'browser' END AS user_profile,
       is_abandoned
FROM session_features
"""

# A score that plain SQL can reproduce stands in for a model's probability.
PARTS["scored"] = """
SELECT session_id, user_id, converted, is_abandoned, num_views_before_cart, is_night,
       cart_value_at_first_cart AS total_cart_value,
       cart_value_at_first_cart / (cart_value_at_first_cart + 100.0) AS probability_1,
       CASE WHEN cart_value_at_first_cart / (cart_value_at_first_cart + 100.0) >= 0.5
            THEN 1 ELSE 0 END AS prediction,
       CAST(hour_of_day % 3 AS INTEGER) AS cluster
FROM ml_features
"""

PARTS["raw_prices"] = """
SELECT l_returnflag AS ticker, l_extendedprice / 1000.0 - 5.0 AS price,
       CAST(l_quantity AS INTEGER) AS volume,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS event_time
FROM lineitem
"""

PARTS["raw_orders"] = """
SELECT CAST(o_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS order_id,
       CAST(o_custkey AS VARCHAR) AS client_id, l_returnflag AS ticker,
       o_orderstatus AS order_type, CAST(l_quantity AS INTEGER) - 5 AS quantity,
       l_extendedprice AS price, o_totalprice AS total_value,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS event_time
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
"""

PARTS["bought_since"] = """
SELECT user_session, user_id, min(first_cart_time) AS first_cart_time,
       min(event_time) FILTER (WHERE event_type = 'purchase' AND event_time >= first_cart_time)
         AS bought
FROM timed WHERE first_cart_time IS NOT NULL GROUP BY user_session, user_id
"""

PARTS["clock"] = """
SELECT date_trunc('milliseconds', max(event_time)) - INTERVAL 10 MINUTE AS as_of FROM silver
"""

PARTS["offer_sessions"] = """
SELECT user_session, user_id, min(first_cart_time) AS first_cart_time,
       min(first_cart_time) + INTERVAL 1 HOUR AS deadline,
       sum(CASE WHEN event_type = 'cart' THEN price ELSE 0 END) AS total_cart_value,
       count(*) FILTER (WHERE event_type = 'cart') AS num_cart_items,
       count(*) FILTER (WHERE event_type = 'view' AND event_time < first_cart_time)
         AS num_views_before_cart,
       CAST(floor(epoch(max(event_time))) AS BIGINT)
         - CAST(floor(epoch(min(event_time))) AS BIGINT) AS session_duration_sec,
       CAST(hour(min(first_cart_time)) AS DOUBLE) AS hour_of_day
FROM timed
WHERE first_cart_time IS NOT NULL AND event_time <= first_cart_time + INTERVAL 1 HOUR
GROUP BY user_session, user_id
HAVING count(*) FILTER (WHERE event_type = 'purchase' AND event_time >= first_cart_time) = 0
   AND min(first_cart_time) + INTERVAL 1 HOUR <= (SELECT as_of FROM clock)
"""


def _needed(text: str, found: list[str]) -> None:
    for name in re.findall(r"[a-z_0-9]+", text):
        if name in PARTS and name not in found and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
            _needed(PARTS[name], found)
            if name not in found:
                found.append(name)


def twin(statement: str) -> str:
    """``statement`` with the named subqueries it draws on."""
    found: list[str] = []
    _needed(statement, found)
    if not found:
        return statement.strip()
    heads = ",\n".join(f"{name} AS ({PARTS[name].strip()})" for name in found)
    return f"WITH {heads}\n{statement.strip()}"
