"""The same rows in SQL over the given tables, written independently of the Spark side."""

from __future__ import annotations

BATCH = "2024-05-01 08:00:00"
OLD_BATCH = "2024-04-30 08:00:00"
EMAIL_OK = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

# A user record in columns, one row per customer.
USERS = r"""
users AS (
  SELECT c_custkey AS k, c_acctbal, c_name, c_mktsegment, c_nationkey, n_name, n_regionkey, r_name,
         CASE WHEN c_custkey % 97 <> 0 THEN c_custkey END AS id,
         CASE WHEN c_custkey % 13 = 0 THEN 'bad-mail' ELSE 'User' || c_custkey || '@Example.COM ' END AS email,
         CASE WHEN c_custkey % 2 = 0 THEN '+' || c_custkey || ' (11) ' || substring(c_name, 10, 20)
              ELSE ' 0-' || c_name END AS phone
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

# Cart lines, the first per order and part: lowest price, quantity and net amount win.
LINES = r"""
lines AS (
  SELECT o_orderkey AS cart_id, o_custkey AS client_id, l_partkey AS product_id, o_orderstatus AS status,
         CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS price,
         l_extendedprice * (1 - l_discount) AS net, o_totalprice AS cart_total
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
),
sales AS (
  SELECT * FROM lines
  QUALIFY row_number() OVER (PARTITION BY cart_id, product_id ORDER BY price, quantity, net) = 1
)"""

EXACT_SUM = "CAST(sum(CAST(price AS DECIMAL(24,6))) AS DOUBLE)"

# Customers as people with a key that is NULL at times and an address that may be bad or missing.
PEOPLE = r"""
people AS (
  SELECT CASE WHEN c_custkey % 97 <> 0 THEN c_custkey END AS client_id,
         CASE WHEN c_custkey % 13 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'bad-mail' ELSE 'a b@c.d' END
              WHEN c_custkey % 7 <> 0 THEN 'user' || c_custkey || '@example.com' END AS client_email
  FROM customer
)"""

# Stored clients (o) and batch (n) of the upsert queries, matched on the key.
UPSERT_SIDES = r"""
o AS (
  SELECT c_custkey AS client_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance,
         'old' AS first_seen
  FROM customer WHERE c_acctbal < 6000
),
n AS (
  SELECT c_custkey AS client_id, upper(c_name) AS name,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment,
         c_acctbal + 1 AS balance, 'new' AS first_seen
  FROM customer WHERE c_acctbal >= 2000
)"""

UPSERT_ROWS = f"""
WITH {UPSERT_SIDES}
SELECT n.client_id AS client_id, n.name AS name, n.segment AS segment, n.balance AS balance,
       coalesce(o.first_seen, n.first_seen) AS first_seen,
       CASE WHEN o.client_id IS NULL THEN 'inserted' ELSE 'updated' END AS merge_action,
       o.client_id IS NOT NULL AS was_updated
FROM n LEFT JOIN o ON o.client_id = n.client_id
UNION ALL
SELECT client_id, name, segment, balance, first_seen, 'kept', false
FROM o WHERE client_id NOT IN (SELECT client_id FROM n)
"""

# Order records page by page; broken pages lie in the last fifth of the key range.
PAGES = r"""
paged AS (
  SELECT o_orderkey, o_custkey, o_orderkey // 100 * 100 AS page_offset,
         (o_orderkey // 100 * 100) * 5 >= (SELECT max(o_orderkey) FROM orders) * 4 AS broken
  FROM orders
)"""

# Pages that landed: those named 50 too early overlap their predecessor, the others follow each other.
LANDED = r"""
landed AS (
  SELECT page, start, start + n AS stop
  FROM (
    SELECT page, CASE WHEN page % 1100 = 200 THEN page - 50 ELSE page END AS start, n
    FROM (SELECT o_orderkey // 100 * 100 AS page, count(*) AS n FROM orders GROUP BY ALL)
    WHERE page % 1000 <> 300
  )
)"""

ORACLES: dict[str, str] = {
    "sales_by_client": f"""
        WITH {USERS}, {LINES}
        SELECT u.id AS client_id, upper(c_mktsegment) AS client_first_name, upper(c_name) AS client_last_name,
               {EXACT_SUM} AS total_carrinho
        FROM sales s JOIN users u ON u.id = s.client_id JOIN part ON p_partkey = s.product_id
        GROUP BY ALL
    """,
    "dim_client": f"""
        WITH {USERS}
        SELECT sha256('client-' || id) AS sk_client, id AS client_id,
               upper(c_mktsegment) AS client_first_name, upper(c_name) AS client_last_name,
               CASE WHEN k % 5 <> 0 THEN 'OF ' || upper(n_name) END AS client_maiden_name,
               CASE WHEN k % 11 <> 0 THEN CAST(k % 90 AS INTEGER) END AS client_age,
               CASE WHEN k % 11 <> 0 THEN k % 90 >= 18 END AS is_adult,
               CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'O' END AS client_gender,
               CASE WHEN k % 17 <> 0 THEN make_date(1950 + k % 50, 1 + k % 12, 1 + k % 28) END AS client_birthdate,
               lower(trim(email)) AS client_email, 'user' || k || copy AS client_username,
               trim(phone) AS client_phone,
               CASE WHEN starts_with(phone, '+') THEN '+' ELSE '' END || regexp_replace(phone, '[^0-9]', '', 'g') AS client_phone_clean,
               k || ' MAIN STREET' AS client_address, upper(n_name) AS client_city, upper(r_name) AS client_state,
               'COUNTRY ' || n_regionkey AS client_country, substring(r_name, 1, 2) AS client_state_code,
               '0' || k AS client_postal_code, CAST(k % 180 - 90 AS DOUBLE) AS client_latitude,
               CAST(k % 360 - 180 AS DOUBLE) AS client_longitude, 'UNIVERSITY OF ' || upper(n_name) AS university,
               upper(c_mktsegment) AS company_department, 'ACME ' || c_nationkey AS company_name,
               'CLERK' AS company_title, k || ' OFFICE PARK' AS company_address, upper(n_name) AS company_city,
               upper(r_name) AS company_state, substring(r_name, 1, 2) AS company_state_code,
               '9' || k AS company_postal_code, upper(r_name) AS company_country,
               CAST(k % 90 AS DOUBLE) AS company_latitude, (k % 45) * 0.5::DOUBLE AS company_longitude,
               CASE WHEN k % 3 = 0 THEN 'admin' ELSE 'user' END AS role,
               CAST('{BATCH}' AS DATE) AS ingestion_timestamp,
               sha256(raw_json || '|{BATCH}') AS row_id
        FROM (
          SELECT *, '{{' || CASE WHEN id IS NULL THEN '' ELSE '"id":' || id || ',' END
              || '"firstName":"  ' || lower(c_mktsegment) || ' ","lastName":"' || c_name || '",'
              || CASE WHEN k % 5 <> 0 THEN '"maidenName":"of ' || n_name || '",' ELSE '' END
              || CASE WHEN k % 11 <> 0 THEN '"age":' || k % 90 || ',' ELSE '' END
              || '"gender":"' || CASE k % 4 WHEN 0 THEN 'male' WHEN 1 THEN ' Female ' WHEN 2 THEN 'other' ELSE 'unknown' END
              || '","email":"' || email || '","username":" user' || k || copy || ' ","phone":"' || phone
              || '","birthDate":"' || CASE WHEN k % 17 = 0 THEN 'not a date'
                   ELSE (1950 + k % 50) || '-' || (1 + k % 12) || '-' || (1 + k % 28) END
              || '","password":"secret","address":{{"address":"' || k || ' main street ","city":"' || n_name
              || '","state":"' || r_name || '","stateCode":" ' || substring(r_name, 1, 2) || ' ","postalCode":" 0' || k
              || ' ","coordinates":{{"lat":' || CAST(k % 180 - 90 AS DOUBLE) || ',"lng":' || CAST(k % 360 - 180 AS DOUBLE)
              || '}},"country":" country ' || n_regionkey || '"}},"university":" University of ' || n_name
              || '","company":{{"department":"' || lower(c_mktsegment) || '","name":" acme ' || c_nationkey
              || '","title":"clerk","address":{{"address":"' || k || ' office park","city":"' || lower(n_name)
              || ' ","state":"' || lower(r_name) || '","stateCode":" ' || substring(r_name, 1, 2) || ' ","postalCode":"9' || k
              || '","coordinates":{{"lat":' || CAST(k % 90 AS DOUBLE) || ',"lng":' || (k % 45) * 0.5::DOUBLE
              || '}},"country":"' || lower(r_name) || '"}}}},"role":"' || CASE WHEN k % 3 = 0 THEN ' Admin ' ELSE 'User' END
              || '"}}' AS raw_json
          FROM users, unnest(CASE WHEN k % 10 = 0 THEN ['', ' again'] ELSE [''] END) AS c(copy)
        )
        WHERE id IS NOT NULL AND c_acctbal >= 0
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY sha256(raw_json || '|{BATCH}')) = 1
    """,
    "dim_product": f"""
        SELECT sha256('product-' || p_partkey) AS sk_product, p_partkey AS product_id,
               upper(p_name || copy) AS product_name, CAST(NULL AS VARCHAR) AS product_description,
               upper(p_type) AS product_category, upper(p_brand) AS product_brand,
               p_retailprice AS product_price, p_size AS product_stock,
               CAST('{BATCH}' AS DATE) AS ingestion_timestamp, row_id
        FROM (
          SELECT *, sha256('{{"id":' || p_partkey || ',"title":" ' || p_name || copy || '","category":"' || p_type || '","brand":"'
                      || lower(p_brand) || '","price":' || p_retailprice || ',"stock":' || p_size || '}}|{BATCH}') AS row_id
          FROM part, unnest(CASE WHEN p_partkey % 10 = 0 THEN ['', ' again'] ELSE [''] END) AS c(copy)
        )
        WHERE p_brand <> 'Brand#1'
        QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY row_id) = 1
    """,
    "ft_sale": f"""
        WITH {LINES}
        SELECT cart_id, quantity, price AS unit_price, price AS gross_amount, net AS net_amount,
               cart_total, cart_total * 0.5::DOUBLE AS cart_discounted_total,
               CAST('{BATCH}' AS DATE) AS ingestion_timestamp,
               sha256('{{"id":' || cart_id || ',"userId":' || client_id || ',"total":' || cart_total
                      || ',"discountedTotal":' || cart_total * 0.5::DOUBLE || ',"products":[{{"id":' || product_id
                      || ',"price":' || price || ',"quantity":' || quantity || ',"total":' || price
                      || ',"discountedTotal":' || net || '}}]}}|{BATCH}') AS row_id,
               sha256(cart_id || '-' || product_id) AS hash_id,
               sha256('product-' || product_id) AS sk_product, sha256('client-' || client_id) AS sk_client
        FROM sales
        JOIN part ON p_partkey = product_id AND p_brand <> 'Brand#1'
        JOIN customer ON c_custkey = client_id AND c_custkey % 97 <> 0 AND c_acctbal >= 0
        WHERE status <> 'F'
    """,
    "sale_audit": f"""
        WITH {LINES}
        SELECT count(*) AS lines_read, count(DISTINCT (cart_id, product_id)) AS lines_distinct,
               count(*) - count(DISTINCT (cart_id, product_id)) AS repeated_lines,
               count(*) FILTER (product_id NOT IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1')) AS lines_without_product,
               count(*) FILTER (client_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 <> 0 AND c_acctbal >= 0))
                   AS lines_without_client
        FROM lines
    """,
    "totals_quality": f"""
        WITH {USERS}, {LINES}, totals AS (
          SELECT CASE WHEN u.id % 50 <> 0 THEN u.id END AS client_id, u.id
          FROM sales s JOIN users u ON u.id = s.client_id JOIN part ON p_partkey = s.product_id GROUP BY ALL
        )
        SELECT count(*) AS total_rows, count(*) FILTER (client_id IS NULL) AS null_keys,
               count(*) FILTER (client_id IS NULL) * 100.0::DOUBLE / count(*) AS null_key_pct, count(client_id) AS valid_rows
        FROM totals
    """,
    "full_run": f"""
        WITH {USERS}, {LINES}
        SELECT u.id AS client_id, upper(c_mktsegment) AS client_first_name, upper(c_name) AS client_last_name,
               {EXACT_SUM} AS total_carrinho
        FROM sales s JOIN users u ON u.id = s.client_id
        WHERE u.c_acctbal >= 0 OR s.status <> 'F'
        GROUP BY ALL
    """,
    "run_report": f"""
        WITH {USERS},
        rounds AS (SELECT unnest([true, false]) AS early, unnest(['{OLD_BATCH}', '{BATCH}']) AS stamp),
        held AS (
          SELECT early, stamp, count(*) AS all_rows, count(id) AS keyed, count(id) FILTER (c_acctbal >= 0) AS before
          FROM rounds JOIN users ON NOT early OR c_acctbal >= 0 GROUP BY ALL
        )
        SELECT 'ingest' AS step, 'bronze.users' AS "table", all_rows AS rows_written, all_rows AS source_rows,
               CAST(NULL AS BIGINT) AS rows_inserted, CAST(NULL AS BIGINT) AS rows_updated, true AS complete, stamp AS detail
        FROM held
        UNION ALL
        SELECT 'merge', 'silver.dim_client', keyed, keyed, CASE WHEN early THEN keyed ELSE keyed - before END,
               CASE WHEN early THEN 0 ELSE before END, true, NULL
        FROM held
    """,
    "page_coverage": f"""
        WITH {LANDED}, swept AS (
          SELECT *, greatest(0, coalesce(max(stop) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reached
          FROM landed
        )
        SELECT 'gap' AS kind, reached AS from_offset, start AS to_offset, 1 AS pages FROM swept WHERE start > reached
        UNION ALL SELECT 'overlap', start, least(reached, stop), 1 FROM swept WHERE start < reached AND stop > start
        UNION ALL SELECT 'repeat', start, stop, 2 FROM swept WHERE page % 700 = 0
        UNION ALL SELECT 'gap', max(stop), (SELECT max(o_orderkey) + 1 FROM orders), 1 FROM swept
                  HAVING max(stop) < (SELECT max(o_orderkey) + 1 FROM orders)
    """,
    "landing_records": f"""
        WITH {LANDED}
        SELECT '{{"id":' || o_orderkey || ',"userId":' || o_custkey || '}}' AS raw_json, 'landing/carts/skip=' || start AS source
        FROM orders JOIN landed ON page = o_orderkey // 100 * 100
    """,
    "page_guard": f"""
        WITH {PAGES}
        SELECT '{{"id":' || o_orderkey || ',"userId":' || o_custkey || '}}' AS raw_json,
               'landing/carts/skip=' || page_offset AS page_source, page_offset
        FROM paged
        WHERE page_offset < coalesce((SELECT min(page_offset) FROM paged WHERE broken), 9223372036854775807)
    """,
    "page_completeness": f"""
        WITH {PAGES}
        SELECT min(page_offset) FILTER (broken) AS first_broken_offset,
               count(*) FILTER (NOT broken) AS records_held,
               (SELECT max(o_orderkey) + 1 FROM orders) AS records_announced
        FROM paged
    """,
    "bronze_append": f"""
        SELECT raw_json, sha256(raw_json || '|' || stamp) AS row_id, 'events' AS source, stamp AS ingestion_timestamp
        FROM (
          SELECT '{{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}}' AS raw_json,
                 CASE WHEN event_type = 'purchase' THEN '{OLD_BATCH}' ELSE '{BATCH}' END AS stamp
          FROM events
        )
    """,
    "bronze_rows": f"""
        SELECT raw_json, sha256(raw_json || '|{BATCH}') AS row_id, 'products' AS source, '{BATCH}' AS ingestion_timestamp
        FROM (SELECT '{{"id":' || p_partkey || ',"title":"' || p_name || '"}}' AS raw_json FROM part)
    """,
    "batch_high_water_mark": "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest_batch FROM events",
    "latest_batch_rows": """
        SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
        FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)
    """,
    "parse_json_typed": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "parse_json_dirty": """
        SELECT event_id,
               CASE WHEN event_type = 'purchase' THEN CAST(event_id AS INTEGER) END AS id,
               CASE WHEN event_type IN ('purchase', 'view', 'click') THEN CAST(user_id AS INTEGER) END AS "user"
        FROM events
    """,
    "nested_fields": f"""
        WITH {USERS}
        SELECT id AS client_id, n_name AS city, CAST(k % 180 - 90 AS DOUBLE) AS latitude,
               upper(n_name) AS office_city, (k % 45) * 0.5::DOUBLE AS office_longitude
        FROM users
    """,
    "explode_cart_lines": """
        SELECT l_orderkey AS cart_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
               l_extendedprice AS unit_price, l_extendedprice * (1 - l_discount) AS net_amount
        FROM lineitem
    """,
    "line_hash_key": """
        SELECT l_orderkey, l_partkey, sha256(concat_ws('-', l_orderkey, l_partkey)) AS hash_id,
               sha256(concat_ws('-', CASE WHEN l_returnflag <> 'R' THEN l_orderkey END, l_partkey)) AS hash_with_null
        FROM lineitem
    """,
    "surrogate_keys": "SELECT s_suppkey, sha256('client-' || s_suppkey) AS sk_client FROM supplier",
    "clean_upper": """
        SELECT p_partkey, trim(upper('  ' || p_name || ' ')) AS name_clean, trim(upper(lower(p_type))) AS type_clean
        FROM part
    """,
    "clean_lower_trim": """
        SELECT p_partkey, trim(lower(' ' || p_brand || '  ')) AS brand_lower,
               chr(9) || trim(p_type || ' ') AS type_trimmed
        FROM part
    """,
    "phone_normalize": """
        SELECT c_custkey,
               CASE WHEN starts_with(phone, '+') THEN '+' || regexp_replace(substring(phone, 2), '[^0-9]', '', 'g')
                    ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS phone_clean
        FROM (
          SELECT c_custkey,
                 CASE c_mktsegment WHEN 'BUILDING' THEN '+' || c_custkey || ' (11) +' || substring(c_name, 10, 20)
                                   WHEN 'MACHINERY' THEN ' +' || c_custkey || '-1'
                                   WHEN 'HOUSEHOLD' THEN '+' || repeat('1 ', 60) || c_custkey
                                   WHEN 'FURNITURE' THEN repeat('2-', 60) || c_custkey END AS phone
          FROM customer
        )
    """,
    "adult_flag": """
        SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 90 >= 18 THEN true ELSE false END AS is_adult
        FROM customer
    """,
    "code_map": """
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' WHEN 'HOUSEHOLD' THEN 'H' END
                   AS segment_code
        FROM customer
    """,
    "safe_date_cast": """
        SELECT o_orderkey,
               CASE WHEN NOT starts_with(o_orderpriority, '1') THEN CAST(o_orderdate AS DATE) END AS day,
               CASE WHEN NOT starts_with(o_orderpriority, '1') THEN strftime(o_orderdate, '%Y-%m-%d 12:30:00') END AS moment,
               CASE WHEN NOT starts_with(o_orderpriority, '1') THEN CAST(floor(o_totalprice) AS INTEGER) END AS whole_price
        FROM orders
    """,
    "email_check": f"""
        WITH {PEOPLE}
        SELECT client_id, client_email,
               client_email IS NOT NULL AND NOT coalesce(regexp_matches(client_email, '{EMAIL_OK}'), false) AS is_invalid
        FROM people
    """,
    "quality_counts": f"""
        WITH {PEOPLE}
        SELECT count(*) AS total_rows, count(*) FILTER (client_id IS NULL) AS null_keys,
               count(*) FILTER (client_id IS NULL) * 100.0::DOUBLE / count(*) AS null_key_pct,
               count(client_id) AS valid_rows,
               count(*) FILTER (client_id IS NOT NULL AND NOT regexp_matches(client_email, '{EMAIL_OK}')) AS invalid_emails
        FROM people
    """,
    "null_key_filter": f"WITH {PEOPLE} SELECT * FROM people WHERE client_id IS NOT NULL",
    "dedup_keep_latest": """
        SELECT l_orderkey, l_partkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_extendedprice, l_quantity, l_suppkey
        FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey
                                   ORDER BY l_shipdate DESC, l_extendedprice, l_quantity, l_suppkey) = 1
    """,
    "latest_by_aggregate": """
        SELECT l_partkey, l_extendedprice, l_returnflag, l_suppkey, l_orderkey FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_returnflag, l_suppkey, l_orderkey) = 1
    """,
    "repeated_keys": """
        SELECT l_orderkey, l_partkey, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1
    """,
    "fact_dimension_lookup": """
        SELECT l_orderkey AS cart_id, l_partkey AS product_id, l_suppkey AS client_id, l_extendedprice AS unit_price,
               sha256('product-' || l_partkey) AS sk_product, sha256('client-' || l_suppkey) AS sk_client
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE p_size <= 40 AND s_acctbal >= 0
    """,
    "reduced_lookup": """
        SELECT l_orderkey AS cart_id, l_partkey AS product_id, l_extendedprice AS unit_price, sha256('product-' || l_partkey) AS sk_product
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 10
    """,
    "rejected_records": f"""
        WITH whole AS (
          SELECT c_custkey AS k, '{{' || CASE WHEN k % 97 <> 0 THEN '"id":' || k || ',' ELSE '' END || '"firstName":"' || c_name || '"}}' AS t
          FROM customer
        ),
        raw AS (
          SELECT k, CASE WHEN k % 31 = 0 THEN t[1:9] WHEN k % 29 = 0 THEN '{{"id":"x' || k || '","firstName":"y"}}'
                         WHEN k % 23 <> 0 THEN t END AS t,
                 CASE WHEN k % 31 = 0 OR k % 29 = 0 THEN 'unreadable' WHEN k % 23 = 0 THEN 'no text' WHEN k % 97 = 0 THEN 'no key' END AS reason
          FROM whole
        )
        SELECT CASE WHEN reason IS NULL THEN k END AS client_id, sha256(k || '|{BATCH}') AS row_id, reason AS reject_reason,
               CASE WHEN reason IS NOT NULL THEN t END AS rejected_text
        FROM raw
    """,
    "member_totals": """
        SELECT p_name, p_brand, l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) AS total
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 40
        GROUP BY ALL
    """,
    "upsert_rows": UPSERT_ROWS,
    "upsert_small_batch_rows": UPSERT_ROWS,
    "upsert_metrics": f"""
        WITH {UPSERT_SIDES}
        SELECT (SELECT count(*) FROM n WHERE client_id NOT IN (SELECT client_id FROM o)) AS rows_inserted,
               (SELECT count(*) FROM n WHERE client_id IN (SELECT client_id FROM o)) AS rows_updated,
               (SELECT count(*) FROM o WHERE client_id NOT IN (SELECT client_id FROM n)) AS rows_kept,
               (SELECT count(*) FROM n) AS source_rows,
               CAST((SELECT count(*) FROM n WHERE client_id NOT IN (SELECT client_id FROM o)) AS VARCHAR) AS inserted_text,
               'n/a' AS deleted_text
    """,
    "upsert_dealt_rows": f"SELECT client_id, name, segment, balance, first_seen, was_updated FROM ({UPSERT_ROWS})",
    "touched_totals": """
        WITH prices AS (
          SELECT l_orderkey AS k, l_partkey, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL
        ),
        facts AS (
          SELECT CASE WHEN k % 15 = 0 THEN o_custkey + 1 ELSE o_custkey END AS client_id,
                 CASE WHEN k % 15 = 0 THEN price + 1 ELSE price END AS price
          FROM prices JOIN orders ON o_orderkey = k
        ),
        early AS (
          SELECT o_custkey AS client_id, price, k FROM prices JOIN orders ON o_orderkey = k
        ),
        now AS (SELECT client_id, CAST(sum(CAST(price AS DECIMAL(24,6))) AS DOUBLE) AS total FROM facts GROUP BY ALL),
        -- a client whose last line went to another one keeps the total it had: an upsert deletes nothing
        was AS (SELECT client_id, CAST(sum(CAST(price AS DECIMAL(24,6))) AS DOUBLE) AS total FROM early WHERE k % 3 < 2 GROUP BY ALL)
        SELECT c_custkey AS client_id, c_mktsegment AS client_first_name, c_name AS client_last_name,
               coalesce(now.total, was.total) AS total_carrinho
        FROM customer LEFT JOIN now ON now.client_id = c_custkey LEFT JOIN was ON was.client_id = c_custkey
        WHERE now.total IS NOT NULL OR was.total IS NOT NULL
    """,
}
