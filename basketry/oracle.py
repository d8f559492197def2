"""Independent SQL oracle (DuckDB dialect) for every entry.

Each statement starts from the driver's raw tables (``customer nation part
supplier orders lineitem events``), rebuilds the fixture mapping and the
cleaning rules as CTEs, and then states the query directly in DuckDB SQL:
plain window NTILE and quantile_cont, FILTER-ed distinct counts, list
aggregates, EXISTS / INTERSECT, scalar subqueries. It shares no code path
with the distributed rewrites on the Spark side (histograms, range-sorted
ranks, stage flags, candidate top-n), so it checks them. The numeric
policy matches ``basketry.functions.scalar``.
"""

from __future__ import annotations

from basketry.plans.tables import FIXTURE_AS_OF


def R(x: str, n: int = 2) -> str:
    """Round half away from zero on the decimal value, report as double."""
    return f"CAST(ROUND(CAST(({x}) AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def AVG(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / NULLIF(CAST(COUNT({x}) AS DOUBLE), 0))"


def DIV(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def PCT_RAW(a: str, b: str) -> str:
    return f"(100.0 * CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def PCT(a: str, b: str, n: int = 2) -> str:
    return R(PCT_RAW(a, b), n)


PREFIX = """
customers_raw AS (
  SELECT c.c_custkey AS customer_id,
         CAST(DATE '1995-01-01' + CAST(c.c_custkey * 37 % 2000 AS INTEGER) AS DATE) AS signup_date,
         n.n_name AS country,
         CAST(18 + c.c_custkey * 13 % 60 AS INTEGER) AS age,
         CASE c.c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'Other' END AS gender,
         c.c_mktsegment AS loyalty_tier
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
),
products_raw AS (
  SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand,
         CAST(p_retailprice AS DECIMAL(18,2)) AS base_price,
         CAST(DATE '1994-01-01' + CAST(p_partkey * 11 % 2500 AS INTEGER) AS DATE) AS launch_date,
         CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS is_premium
  FROM part
),
campaigns_raw AS (
  SELECT s_suppkey AS campaign_id,
         CASE s_suppkey % 5 WHEN 0 THEN 'Paid Search' WHEN 1 THEN 'Email' WHEN 2 THEN 'Display'
                            WHEN 3 THEN 'Social' ELSE 'Affiliate' END AS channel,
         CASE s_suppkey % 4 WHEN 0 THEN 'Cross-sell' WHEN 1 THEN 'Retention'
                            WHEN 2 THEN 'Reactivation' ELSE 'Acquisition' END AS objective,
         CAST(DATE '1995-01-01' + CAST(s_suppkey * 53 % 2000 AS INTEGER) AS DATE) AS start_date,
         CAST(DATE '1995-01-01' + CAST(s_suppkey * 53 % 2000 AS INTEGER)
              + CAST(10 + s_suppkey * 7 % 80 AS INTEGER) AS DATE) AS end_date,
         CASE s_suppkey % 3 WHEN 0 THEN 'All' WHEN 1 THEN 'Churn Risk' ELSE 'High Value' END
           AS target_segment,
         CAST((22 + s_suppkey * 29 % 123) / 1000.0 AS DECIMAL(6,3)) AS expected_uplift
  FROM supplier
),
events_raw AS (
  SELECT event_id, ts AS "timestamp",
         user_id * 10 + event_id % 10 AS customer_id,
         user_id * 100 + CAST(day(ts) AS BIGINT) AS session_id,
         CASE event_type WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'bounce'
                         ELSE event_type END AS event_type,
         CASE WHEN event_id % 17 = 0 THEN NULL
              ELSE TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS product_id,
         CASE WHEN event_id % 13 < 5 THEN 'mobile' WHEN event_id % 13 < 9 THEN 'desktop'
              WHEN event_id % 13 < 11 THEN 'tablet' END AS device_type,
         CASE WHEN event_id % 11 < 2 THEN 'Organic' WHEN event_id % 11 < 4 THEN 'Paid Search'
              WHEN event_id % 11 < 6 THEN 'Email' WHEN event_id % 11 < 8 THEN 'Direct'
              ELSE 'Social' END AS traffic_source,
         CASE WHEN event_id % 3 = 0 THEN user_id END AS campaign_id,
         CASE event_id % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'category' WHEN 2 THEN 'product'
                           ELSE 'cart' END AS page_category
  FROM events
),
line_agg AS (
  SELECT l_orderkey, MIN(l_partkey) AS mp, MIN(l_quantity) AS mq, MIN(l_discount) AS md,
         MIN(l_suppkey) AS ms
  FROM lineitem GROUP BY l_orderkey
),
transactions_raw AS (
  SELECT o.o_orderkey AS transaction_id, o.o_orderdate AS "timestamp", o.o_custkey AS customer_id,
         la.mp AS product_id, CAST(la.mq AS INTEGER) AS quantity,
         CAST(la.md * 3 AS DECIMAL(6,2)) AS discount_applied,
         CAST(CASE WHEN o.o_orderstatus = 'P' THEN -o.o_totalprice ELSE o.o_totalprice END
              AS DECIMAL(18,2)) AS gross_revenue,
         CASE WHEN o.o_orderkey % 2 = 0 THEN la.ms END AS campaign_id,
         CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END AS refund_flag
  FROM orders o LEFT JOIN line_agg la ON o.o_orderkey = la.l_orderkey
),
customers_clean AS (
  SELECT customer_id, signup_date, country, age, gender, loyalty_tier FROM customers_raw
),
products_clean AS (
  SELECT product_id, category, brand, base_price, launch_date, is_premium FROM products_raw
),
campaigns_clean AS (
  SELECT campaign_id, channel, objective, start_date, end_date, target_segment, expected_uplift
  FROM campaigns_raw
),
events_clean AS (
  SELECT event_id, "timestamp", customer_id, session_id, event_type, product_id,
         COALESCE(device_type, 'Unknown') AS device_type, traffic_source, campaign_id,
         page_category
  FROM events_raw
  WHERE NOT (event_type IN ('purchase', 'add_to_cart') AND product_id IS NULL)
),
transactions_clean AS (
  SELECT transaction_id, "timestamp", customer_id, product_id, quantity, discount_applied,
         gross_revenue AS gross_revenue_raw,
         CASE WHEN refund_flag = 0 THEN gross_revenue ELSE ABS(gross_revenue) END
           AS gross_revenue_clean,
         campaign_id, CAST(refund_flag AS INTEGER) AS refund_flag
  FROM transactions_raw
  WHERE product_id IS NOT NULL
),
sales AS (
  SELECT * FROM transactions_clean WHERE refund_flag = 0
)"""


def q(select: str, *ctes: str) -> str:
    """Statement = shared prefix CTEs + extra CTEs + final SELECT."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {PREFIX}{extra}\n{select}"


REV = "gross_revenue_clean"
MONTH = "strftime(\"timestamp\", '%Y-%m')"
PTYPE = "CASE WHEN p.is_premium = 1 THEN 'Premium' ELSE 'Standard' END"
SALE0 = f"CASE WHEN t.refund_flag = 0 THEN t.{REV} ELSE 0 END"


def band_sql(x: str) -> str:
    return (f"CASE WHEN {x} = 1 THEN '1 purchase' WHEN {x} BETWEEN 2 AND 3 THEN '2-3 purchases' "
            f"WHEN {x} BETWEEN 4 AND 5 THEN '4-5 purchases' ELSE '6+ purchases' END")


def age_sql(x: str) -> str:
    return (f"CASE WHEN {x} BETWEEN 18 AND 24 THEN '18-24' WHEN {x} BETWEEN 25 AND 34 THEN '25-34' "
            f"WHEN {x} BETWEEN 35 AND 44 THEN '35-44' WHEN {x} BETWEEN 45 AND 54 THEN '45-54' "
            f"ELSE '55+' END")


def segment_sql(total: str) -> str:
    return (f"CASE WHEN {total} >= 10 THEN 'Champions' WHEN {total} >= 7 THEN 'Loyal' "
            f"WHEN {total} >= 5 THEN 'Potential' ELSE 'At Risk' END")


def distinct_if(cond: str, col: str = "customer_id") -> str:
    return f"COUNT(DISTINCT {col}) FILTER (WHERE {cond})"


# per-customer first and second sale from the sorted list of sale times
SECOND_SALE = """second_sale AS (
  SELECT customer_id,
         date_diff('day', CAST(list_sort(list("timestamp"))[1] AS DATE),
                          CAST(list_sort(list("timestamp"))[2] AS DATE)) AS gap
  FROM sales
  WHERE customer_id IS NOT NULL
  GROUP BY customer_id
  HAVING COUNT(*) >= 2
)"""

STAGES = f"""stage_counts AS (
  SELECT {distinct_if("event_type = 'view'")} AS v,
         {distinct_if("event_type = 'click'")} AS c,
         {distinct_if("event_type = 'add_to_cart'")} AS a,
         {distinct_if("event_type = 'purchase'")} AS p
  FROM events_clean
)"""

PER_CAMPAIGN = f"""per_campaign AS (
  SELECT campaign_id,
         COUNT(DISTINCT customer_id) AS exposed_customers,
         {distinct_if("event_type = 'purchase'")} AS converted_customers
  FROM events_clean
  WHERE campaign_id IS NOT NULL
  GROUP BY campaign_id
)"""

MONTHLY = f"""by_month AS (
  SELECT {MONTH} AS month, CAST(year("timestamp") AS BIGINT) AS year,
         CAST(month("timestamp") AS BIGINT) AS month_of_year, SUM({REV}) AS revenue
  FROM sales
  GROUP BY ALL
)"""


def rfm_sql(invert: bool) -> str:
    r, f, m = (("recency_days ASC NULLS FIRST", "frequency DESC NULLS LAST",
                "monetary DESC NULLS LAST") if invert else
               ("recency_days DESC NULLS LAST", "frequency ASC NULLS FIRST",
                "monetary ASC NULLS FIRST"))
    tie = "customer_id ASC NULLS FIRST"
    return f"""scored AS (
  SELECT *, {segment_sql('r_score + f_score + m_score')} AS rfm_segment
  FROM (SELECT *,
               NTILE(4) OVER (ORDER BY {r}, {tie}) AS r_score,
               NTILE(4) OVER (ORDER BY {f}, {tie}) AS f_score,
               NTILE(4) OVER (ORDER BY {m}, {tie}) AS m_score
        FROM (SELECT customer_id,
                     date_diff('day', CAST(MAX("timestamp") AS DATE), DATE '{FIXTURE_AS_OF}')
                       AS recency_days,
                     COUNT(*) AS frequency,
                     ROUND(SUM({REV}), 2) AS monetary
              FROM sales
              GROUP BY customer_id))
)"""


def conversion_sql(dim: str) -> str:
    conv = distinct_if("event_type = 'purchase'")
    return q(f"""SELECT {dim}, COUNT(DISTINCT customer_id) AS total_customers,
       {conv} AS converted_customers,
       {PCT(conv, 'COUNT(DISTINCT customer_id)')} AS conversion_rate_pct
FROM events_clean
GROUP BY ALL""")


def product_sql(keys: str, label: str, where: str, count: str, refund_pct: bool) -> str:
    refund = (f",\n       {PCT('SUM(CAST(t.refund_flag AS INTEGER))', 'COUNT(*)')} AS refund_rate_pct"
              if refund_pct else "")
    return q(f"""SELECT {label},
       {count} AS total_transactions,
       {R(f'SUM({SALE0})')} AS net_revenue,
       {R(AVG(SALE0))} AS avg_order_value{refund}
FROM transactions_clean t JOIN products_clean p USING (product_id)
{where}
GROUP BY {keys}""")


PER_CUSTOMER = f"""per_customer AS (
  SELECT customer_id, COUNT(*) AS n, SUM({REV}) AS revenue,
         MIN("timestamp") AS first_ts, MAX("timestamp") AS last_ts,
         COUNT({REV}) AS n_rev
  FROM sales
  GROUP BY customer_id
)"""

ORACLE: dict[str, str] = {
    # ---- cleaning: the cleaned views themselves ----
    "clean_customers": q("SELECT * FROM customers_clean"),
    "clean_products": q("""SELECT * REPLACE (CAST(base_price AS DOUBLE) AS base_price)
FROM products_clean"""),
    "clean_campaigns": q("""SELECT * REPLACE (CAST(expected_uplift AS DOUBLE) AS expected_uplift)
FROM campaigns_clean"""),
    "clean_events": q("SELECT * FROM events_clean"),
    "clean_transactions": q(f"""SELECT * REPLACE (CAST(discount_applied AS DOUBLE) AS discount_applied,
                   CAST(gross_revenue_raw AS DOUBLE) AS gross_revenue_raw,
                   CAST({REV} AS DOUBLE) AS {REV})
FROM transactions_clean"""),

    # ---- exploratory ----
    "revenue_distribution": q(f"""SELECT COUNT(*) AS total_transactions,
       {R(f'MIN({REV})')} AS min_revenue,
       {R(f'MAX({REV})')} AS max_revenue,
       {R(AVG(REV))} AS avg_revenue,
       {R(f'STDDEV_SAMP({REV})')} AS stddev_revenue,
       {R(f'quantile_cont(CAST({REV} AS DOUBLE), 0.25)')} AS p25,
       {R(f'quantile_cont(CAST({REV} AS DOUBLE), 0.5)')} AS p50_median,
       {R(f'quantile_cont(CAST({REV} AS DOUBLE), 0.75)')} AS p75,
       {R(f'quantile_cont(CAST({REV} AS DOUBLE), 0.95)')} AS p95
FROM sales"""),
    "quantity_distribution": q(f"""SELECT quantity, COUNT(*) AS total_transactions,
       {PCT('COUNT(*)', '(SELECT COUNT(*) FROM sales)')} AS pct
FROM sales
GROUP BY ALL"""),
    "price_by_category": q(f"""SELECT category,
       {R('MIN(base_price)')} AS min_price, {R('MAX(base_price)')} AS max_price,
       {R(AVG('base_price'))} AS avg_price, {R('STDDEV_SAMP(base_price)')} AS stddev_price,
       COUNT(*) AS total_products
FROM products_clean
GROUP BY ALL"""),
    "monthly_revenue": q(f"""SELECT {MONTH} AS month, COUNT(*) AS total_transactions,
       COUNT(DISTINCT customer_id) AS unique_customers,
       {R(f'SUM({REV})')} AS total_revenue, {R(AVG(REV))} AS avg_order_value
FROM sales
GROUP BY ALL"""),
    "weekday_revenue": q(f"""SELECT dayname("timestamp") AS weekday_name,
       CAST(isodow("timestamp") % 7 + 1 AS BIGINT) AS weekday_order,
       COUNT(*) AS total_transactions,
       {R(f'SUM({REV})')} AS total_revenue, {R(AVG(REV))} AS avg_order_value
FROM sales
GROUP BY ALL"""),
    "hourly_events": q("""SELECT CAST(extract('hour' FROM "timestamp") AS BIGINT) AS hour_of_day,
       COUNT(*) AS total_events, COUNT(DISTINCT session_id) AS total_sessions
FROM events_clean
GROUP BY ALL"""),
    "daily_revenue_stats": q(f"""SELECT {R('MIN(d)')} AS min_daily_revenue, {R('MAX(d)')} AS max_daily_revenue,
       {R(AVG('d'))} AS avg_daily_revenue, {R('STDDEV_SAMP(d)')} AS stddev_daily_revenue
FROM (SELECT SUM({REV}) AS d FROM sales GROUP BY CAST("timestamp" AS DATE))"""),
    "session_length_stats": q(f"""SELECT {R(AVG('n'))} AS avg_events, MIN(n) AS min_events, MAX(n) AS max_events,
       {R('STDDEV_SAMP(CAST(n AS DOUBLE))')} AS stddev_events
FROM (SELECT COUNT(*) AS n FROM events_clean GROUP BY session_id)"""),
    "events_per_session": q(f"""SELECT n AS events_per_session, COUNT(*) AS total_sessions,
       {PCT('COUNT(*)', '(SELECT COUNT(*) FROM (SELECT DISTINCT session_id FROM events_clean))')} AS pct
FROM (SELECT session_id, COUNT(*) AS n FROM events_clean GROUP BY session_id)
GROUP BY n"""),
    "purchase_recurrence": q(f"""SELECT {band_sql('n')} AS purchase_segment, COUNT(*) AS total_customers,
       {PCT('COUNT(*)', '(SELECT COUNT(*) FROM (SELECT DISTINCT customer_id FROM sales))')} AS pct
FROM (SELECT customer_id, COUNT(*) AS n FROM sales GROUP BY customer_id)
GROUP BY ALL"""),
    "session_identity_check": q("""SELECT (SELECT COUNT(DISTINCT session_id) FROM events_clean) AS unique_sessions,
       (SELECT COUNT(DISTINCT customer_id) FROM events_clean) AS unique_customers,
       (SELECT COUNT(*) FROM (SELECT DISTINCT
            coalesce(CAST(session_id AS VARCHAR), '') || coalesce(CAST(customer_id AS VARCHAR), '')
        FROM events_clean)) AS unique_combinations"""),
    "discount_bands": q(f"""SELECT CAST(ROUND(discount_applied, 1) AS DOUBLE) AS discount_band,
       COUNT(*) AS total_transactions, {R(AVG(REV))} AS avg_order_value,
       {R(f'SUM({REV})')} AS total_revenue
FROM sales
GROUP BY ROUND(discount_applied, 1)"""),
    "loyalty_behavior": q(f"""SELECT c.loyalty_tier, COUNT(DISTINCT s.customer_id) AS total_customers,
       COUNT(s.transaction_id) AS total_transactions, {R(AVG('s.' + REV))} AS avg_order_value,
       {R(DIV('COUNT(s.transaction_id)', 'COUNT(DISTINCT s.customer_id)'))}
         AS transactions_per_customer
FROM sales s JOIN customers_clean c USING (customer_id)
GROUP BY ALL"""),
    "age_group_revenue": q(f"""SELECT {age_sql('c.age')} AS age_group,
       COUNT(DISTINCT s.customer_id) AS total_customers,
       {R(AVG('s.' + REV))} AS avg_order_value, {R(f'SUM(s.{REV})')} AS total_revenue
FROM sales s JOIN customers_clean c USING (customer_id)
GROUP BY ALL"""),
    "premium_refund_profile": q(f"""SELECT {PTYPE} AS product_type, COUNT(*) AS total_transactions,
       CAST(SUM(t.refund_flag) AS BIGINT) AS total_refunds,
       {PCT('SUM(t.refund_flag)', 'COUNT(*)')} AS refund_rate_pct,
       {R(AVG('t.' + REV))} AS avg_order_value
FROM transactions_clean t JOIN products_clean p USING (product_id)
GROUP BY p.is_premium"""),
    "monthly_signups": q("""SELECT strftime(signup_date, '%Y-%m') AS month, COUNT(*) AS new_customers
FROM customers_clean
GROUP BY ALL"""),
    "traffic_distribution": q(f"""SELECT traffic_source, COUNT(DISTINCT customer_id) AS total_customers,
       {PCT('COUNT(DISTINCT customer_id)',
            '(SELECT SUM(k) FROM (SELECT COUNT(DISTINCT customer_id) AS k FROM events_clean '
            'GROUP BY traffic_source))')} AS pct
FROM events_clean
GROUP BY ALL"""),
    "gender_within_tier": q(f"""SELECT c.loyalty_tier, c.gender, COUNT(*) AS total_customers,
       {PCT('COUNT(*)', 'tier.n')} AS pct_within_tier
FROM customers_clean c
JOIN (SELECT loyalty_tier, COUNT(*) AS n FROM customers_clean GROUP BY loyalty_tier) tier
  ON c.loyalty_tier IS NOT DISTINCT FROM tier.loyalty_tier
GROUP BY c.loyalty_tier, c.gender, tier.n"""),

    # ---- business ----
    "north_star": q(f"""SELECT {R(f'SUM({REV})')} AS net_revenue,
       COUNT(DISTINCT customer_id) AS active_customers,
       {R(DIV(f'SUM({REV})', 'COUNT(DISTINCT customer_id)'))} AS revenue_per_active_customer
FROM sales"""),
    "gross_vs_refunds": q(f"""SELECT CAST(SUM({REV}) AS DOUBLE) AS gross_revenue,
       CAST(COALESCE(SUM({REV}) FILTER (WHERE refund_flag = 1), 0) AS DOUBLE) AS total_refunded,
       COUNT(*) FILTER (WHERE refund_flag = 1) AS total_refund_transactions,
       {PCT(f'COALESCE(SUM({REV}) FILTER (WHERE refund_flag = 1), 0)',
            f'COALESCE(SUM({REV}) FILTER (WHERE refund_flag = 0), 0)')} AS refund_revenue_pct
FROM transactions_clean"""),
    "revenue_concentration": q(f"""SELECT CASE WHEN top THEN 'Top 5%' ELSE 'Bottom 95%' END AS segment,
       COUNT(*) AS total_transactions, {R(f'SUM({REV})')} AS total_revenue,
       {PCT(f'SUM({REV})', f'(SELECT SUM({REV}) FROM sales)')} AS pct_of_revenue
FROM (SELECT {REV},
             NTILE(20) OVER (ORDER BY {REV} ASC NULLS FIRST, transaction_id ASC NULLS FIRST) = 20
               AS top
      FROM sales)
GROUP BY top"""),
    "mom_growth": q(
        f"""SELECT month, {R('revenue')} AS {REV}, {R('prev')} AS prev_month_revenue,
       {PCT('(revenue - prev)', 'prev')} AS mom_growth_pct
FROM (SELECT m.month, m.revenue,
             (SELECT m2.revenue FROM by_month m2 WHERE m2.month < m.month
              ORDER BY m2.month DESC LIMIT 1) AS prev
      FROM by_month m)""", MONTHLY),
    "discount_impact": q(f"""SELECT CASE WHEN discount_applied > 0 THEN 'Discounted' ELSE 'Full Price' END AS price_type,
       COUNT(*) AS total_transactions, {R(AVG(REV))} AS avg_order_value,
       {R(AVG('discount_applied'))} AS avg_discount, {R(f'SUM({REV})')} AS total_revenue,
       {PCT('COUNT(*)', '(SELECT COUNT(*) FROM sales)')} AS pct_of_transactions
FROM sales
GROUP BY ALL"""),
    "retention_rate": q(f"""SELECT COUNT(*) AS total_customers,
       COUNT(*) FILTER (WHERE n = 1) AS one_time_buyers,
       COUNT(*) FILTER (WHERE n > 1) AS returning_buyers,
       {PCT('COUNT(*) FILTER (WHERE n > 1)', 'COUNT(*)')} AS retention_rate_pct
FROM (SELECT customer_id, COUNT(*) AS n FROM sales WHERE customer_id IS NOT NULL
      GROUP BY customer_id)"""),
    "days_to_second_stats": q(f"""SELECT {R(AVG('gap'), 1)} AS avg_days, MIN(gap) AS min_days, MAX(gap) AS max_days,
       {R('quantile_cont(CAST(gap AS DOUBLE), 0.5)', 1)} AS median_days
FROM second_sale""", SECOND_SALE),
    "revenue_by_frequency": q(f"""SELECT {band_sql('n')} AS purchase_segment, COUNT(*) AS total_customers,
       {R('SUM(revenue)')} AS total_revenue, {R(AVG('revenue'))} AS avg_revenue_per_customer,
       {PCT('SUM(revenue)', f'(SELECT SUM({REV}) FROM sales)')} AS pct_of_total_revenue
FROM per_customer
GROUP BY ALL""", PER_CUSTOMER),
    "loyalty_retention": q(f"""SELECT c.loyalty_tier, COUNT(*) AS total_customers,
       COUNT(*) FILTER (WHERE pc.n > 1) AS returning_customers,
       {PCT('COUNT(*) FILTER (WHERE pc.n > 1)', 'COUNT(*)')} AS retention_rate_pct,
       {R(AVG('pc.n'))} AS avg_purchases
FROM customers_clean c JOIN per_customer pc USING (customer_id)
GROUP BY ALL""", PER_CUSTOMER),
    "channel_performance": q(f"""SELECT c.channel, COUNT(DISTINCT t.transaction_id) AS total_transactions,
       {R(f'SUM({SALE0})')} AS net_revenue, {R(AVG('t.' + REV))} AS avg_order_value,
       {PCT('SUM(t.refund_flag)', 'COUNT(*)')} AS refund_rate_pct
FROM transactions_clean t JOIN campaigns_clean c USING (campaign_id)
GROUP BY ALL"""),
    "uplift_vs_conversion": q(f"""SELECT campaign_id, c.channel, c.objective,
       CAST(c.expected_uplift AS DOUBLE) AS expected_uplift,
       {PCT('pc.converted_customers', 'pc.exposed_customers')} AS actual_conversion_pct,
       {R(PCT_RAW('pc.converted_customers', 'pc.exposed_customers')
          + ' - CAST(c.expected_uplift AS DOUBLE) * 100')} AS uplift_gap
FROM campaigns_clean c JOIN per_campaign pc USING (campaign_id)""", PER_CAMPAIGN),
    "uplift_vs_conversion_points": q(f"""SELECT campaign_id, c.channel, c.objective,
       CAST(c.expected_uplift AS DOUBLE) AS expected_uplift_pct,
       {PCT('pc.converted_customers', 'pc.exposed_customers')} AS actual_conversion_pct,
       {R(PCT('pc.converted_customers', 'pc.exposed_customers')
          + ' - CAST(c.expected_uplift AS DOUBLE)')} AS uplift_gap,
       pc.exposed_customers, pc.converted_customers
FROM campaigns_clean c JOIN per_campaign pc USING (campaign_id)""", PER_CAMPAIGN),
    "objective_performance": q(f"""SELECT c.objective, COUNT(DISTINCT s.transaction_id) AS total_transactions,
       {R(f'SUM(s.{REV})')} AS {REV}, {R(AVG('s.' + REV))} AS avg_order_value,
       COUNT(DISTINCT s.customer_id) AS unique_customers
FROM sales s JOIN campaigns_clean c USING (campaign_id)
GROUP BY ALL"""),
    "exposure_effect": q(f"""SELECT CASE WHEN EXISTS (SELECT 1 FROM events_clean e
                      WHERE e.customer_id = pc.customer_id AND e.campaign_id IS NOT NULL)
            THEN 'Exposed' ELSE 'Not Exposed' END AS campaign_exposure,
       COUNT(*) AS total_customers, {R(AVG('pc.revenue'))} AS avg_revenue_per_customer,
       {R(AVG('pc.n'))} AS avg_purchases_per_customer
FROM per_customer pc
GROUP BY ALL""", PER_CUSTOMER),
    "category_performance": product_sql("p.category", "p.category", "",
                                        "COUNT(t.transaction_id)", True),
    "top_products": q(f"""SELECT product_id, p.category, p.brand, {PTYPE} AS product_type,
       COUNT(t.transaction_id) AS total_transactions, {R(f'SUM({SALE0})')} AS net_revenue,
       {R(AVG(SALE0))} AS avg_order_value
FROM transactions_clean t JOIN products_clean p USING (product_id)
WHERE t.refund_flag = 0
GROUP BY product_id, p.category, p.brand, p.is_premium
ORDER BY net_revenue DESC NULLS LAST, product_id
LIMIT 10"""),
    "premium_performance": product_sql("p.is_premium", f"{PTYPE} AS product_type", "",
                                       "COUNT(*)", True),
    "category_by_premium": product_sql("p.category, p.is_premium",
                                       f"p.category, {PTYPE} AS product_type",
                                       "WHERE t.refund_flag = 0", "COUNT(*)", False),
    "rfm_summary": q(f"""SELECT rfm_segment, COUNT(*) AS total_customers,
       {R('SUM(monetary)')} AS total_revenue, {R(AVG('monetary'))} AS avg_revenue_per_customer,
       {R(AVG('recency_days'), 0)} AS avg_recency_days, {R(AVG('frequency'))} AS avg_frequency,
       {PCT('SUM(monetary)', '(SELECT SUM(monetary) FROM scored)')} AS pct_of_revenue
FROM scored
GROUP BY ALL""", rfm_sql(False)),
    "rfm_summary_inverted": q(f"""SELECT rfm_segment, COUNT(*) AS total_customers,
       {R('SUM(monetary)')} AS total_revenue, {R(AVG('monetary'))} AS avg_revenue_per_customer,
       {PCT('SUM(monetary)', '(SELECT SUM(monetary) FROM scored)')} AS pct_of_revenue
FROM scored
GROUP BY ALL""", rfm_sql(True)),
    "top_customers": q(f"""SELECT customer_id, c.country, c.age, c.loyalty_tier, pc.n AS total_purchases,
       {R('pc.revenue')} AS total_revenue,
       date_diff('day', CAST(pc.first_ts AS DATE), CAST(pc.last_ts AS DATE))
         AS customer_lifespan_days
FROM per_customer pc JOIN customers_clean c USING (customer_id)
ORDER BY total_revenue DESC NULLS LAST, customer_id
LIMIT 10""", PER_CUSTOMER),
    "funnel": q(f"""SELECT v AS view_stage, c AS click_stage, a AS cart_stage, p AS purchase_stage,
       {PCT('c', 'v')} AS view_to_click_pct, {PCT('a', 'c')} AS click_to_cart_pct,
       {PCT('p', 'a')} AS cart_to_purchase_pct, {PCT('p', 'v')} AS overall_conversion_pct
FROM stage_counts""", STAGES),
    "device_conversion": conversion_sql("device_type"),
    "traffic_conversion": conversion_sql("traffic_source"),
    "funnel_dropoff": q(f"""SELECT funnel_step, customers_in, customers_out,
       customers_in - customers_out AS dropped,
       {PCT('(customers_in - customers_out)', 'customers_in')} AS drop_off_pct
FROM (SELECT unnest(['view → click', 'click → add_to_cart', 'add_to_cart → purchase'])
               AS funnel_step,
             unnest([v, c, a]) AS customers_in,
             unnest([c, a, p]) AS customers_out
      FROM stage_counts)""", STAGES),
    "bounce_rate": q(f"""SELECT {distinct_if("event_type = 'bounce'")} AS bounced_customers,
       COUNT(DISTINCT customer_id) AS total_customers,
       {PCT(distinct_if("event_type = 'bounce'"), 'COUNT(DISTINCT customer_id)')} AS bounce_rate_pct
FROM events_clean"""),
    "bounce_recovery": q(f"""SELECT b AS total_bounced, bp AS bounced_and_purchased,
       {PCT('bp', 'b')} AS bounce_recovery_rate_pct
FROM (SELECT (SELECT {distinct_if("event_type = 'bounce'")} FROM events_clean) AS b,
             (SELECT COUNT(*) FROM (
                 SELECT customer_id FROM events_clean
                 WHERE event_type = 'bounce' AND customer_id IS NOT NULL
                 INTERSECT
                 SELECT customer_id FROM events_clean WHERE event_type = 'purchase')) AS bp)"""),
    "event_type_counts": q("""SELECT event_type, COUNT(*) AS total_events
FROM events_clean
GROUP BY ALL"""),
    "cohort_ltv": q(f"""SELECT strftime(c.signup_date, '%Y-%m') AS signup_cohort,
       COUNT(DISTINCT s.customer_id) AS customers,
       {R(DIV(f'SUM(s.{REV})', 'COUNT(DISTINCT s.customer_id)'))} AS avg_ltv,
       {R(AVG('s.' + REV))} AS avg_order_value,
       {R(DIV('COUNT(s.transaction_id)', 'COUNT(DISTINCT s.customer_id)'))}
         AS avg_purchases_per_customer
FROM sales s JOIN customers_clean c USING (customer_id)
GROUP BY ALL"""),

    # ---- marts ----
    "rfm_segments": q("""SELECT customer_id, recency_days, frequency,
       CAST(monetary AS DOUBLE) AS monetary, r_score, f_score, m_score,
       r_score + f_score + m_score AS rfm_total, rfm_segment
FROM scored""", rfm_sql(False)),
    "cohort_analysis": q(f"""SELECT customer_id, strftime(c.signup_date, '%Y-%m') AS signup_cohort,
       COUNT(s.transaction_id) AS total_purchases, {R(f'SUM(s.{REV})')} AS total_revenue,
       {R(AVG('s.' + REV))} AS avg_order_value,
       MIN(s."timestamp") AS first_purchase_date, MAX(s."timestamp") AS last_purchase_date
FROM customers_clean c LEFT JOIN sales s USING (customer_id)
GROUP BY customer_id, strftime(c.signup_date, '%Y-%m')"""),
    "funnel_customers": q("""SELECT customer_id,
       COALESCE(CAST(bool_or(event_type = 'view') AS INTEGER), 0) AS reached_view,
       COALESCE(CAST(bool_or(event_type = 'click') AS INTEGER), 0) AS reached_click,
       COALESCE(CAST(bool_or(event_type = 'add_to_cart') AS INTEGER), 0) AS reached_cart,
       COALESCE(CAST(bool_or(event_type = 'purchase') AS INTEGER), 0) AS reached_purchase,
       COALESCE(CAST(bool_or(event_type = 'bounce') AS INTEGER), 0) AS has_bounce
FROM events_clean
GROUP BY customer_id"""),
    "customer_summary": q(f"""SELECT customer_id, c.signup_date, c.country, c.age, c.gender, c.loyalty_tier,
       {age_sql('c.age')} AS age_group,
       COALESCE(pc.n, 0) AS total_purchases,
       COALESCE({R('pc.revenue')}, 0) AS total_revenue,
       COALESCE({R(DIV('pc.revenue', 'pc.n_rev'))}, 0) AS avg_order_value,
       pc.first_ts AS first_purchase_date, pc.last_ts AS last_purchase_date,
       COALESCE(date_diff('day', CAST(pc.first_ts AS DATE), CAST(pc.last_ts AS DATE)), 0)
         AS lifespan_days,
       CASE WHEN pc.n > 1 THEN 1 ELSE 0 END AS is_returning,
       CASE WHEN pc.n IS NULL THEN 1 ELSE 0 END AS never_purchased
FROM customers_clean c LEFT JOIN per_customer pc USING (customer_id)""", PER_CUSTOMER),
    "days_to_second_purchase": q("""SELECT gap AS days_to_second_purchase, COUNT(*) AS total_customers
FROM second_sale
GROUP BY gap""", SECOND_SALE),

    # ---- narrative metrics ----
    "seasonality_index": q(
        f"""SELECT month_of_year, COUNT(*) AS months,
       {R(DIV('SUM(revenue)', 'COUNT(*)'))} AS avg_monthly_revenue,
       {R(DIV('SUM(revenue)', 'COUNT(*)') + ' / '
          + DIV('(SELECT SUM(revenue) FROM by_month)', '(SELECT COUNT(*) FROM by_month)'), 4)}
         AS seasonality_index
FROM by_month
GROUP BY month_of_year""", MONTHLY),
    "same_month_yoy": q(
        f"""SELECT month, {R('revenue')} AS revenue, {R('prev')} AS prev_year_revenue,
       {PCT('(revenue - prev)', 'prev')} AS yoy_growth_pct
FROM (SELECT m.month, m.revenue,
             (SELECT m2.revenue FROM by_month m2
              WHERE m2.month_of_year = m.month_of_year AND m2.year < m.year
              ORDER BY m2.year DESC LIMIT 1) AS prev
      FROM by_month m)""", MONTHLY),
    "campaign_target_attainment": q(
        f"""SELECT COUNT(*) AS campaigns_evaluated,
       COUNT(*) FILTER (WHERE hit) AS campaigns_met_target,
       {PCT('COUNT(*) FILTER (WHERE hit)', 'COUNT(*)')} AS attainment_pct
FROM (SELECT pc.converted_customers * 1000
               >= CAST(c.expected_uplift * 1000 AS BIGINT) * pc.exposed_customers AS hit
      FROM campaigns_clean c JOIN per_campaign pc USING (campaign_id))""", PER_CAMPAIGN),
    "bounced_never_purchased": q(
        f"""SELECT b AS total_bounced, bn AS bounced_never_purchased,
       {PCT('bn', 'b')} AS never_purchased_pct
FROM (SELECT (SELECT {distinct_if("event_type = 'bounce'")} FROM events_clean) AS b,
             (SELECT COUNT(*) FROM (
                 SELECT customer_id FROM events_clean
                 WHERE event_type = 'bounce' AND customer_id IS NOT NULL
                 EXCEPT
                 SELECT customer_id FROM events_clean WHERE event_type = 'purchase')) AS bn)"""),
}
