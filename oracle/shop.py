"""Oracle texts of the shop rule jobs."""

from __future__ import annotations

from oracle.base import query

SHOP = {
    "as_of": "SELECT CAST(max(o_orderdate) AS DATE) + 10 AS d FROM orders",
    "products": "SELECT p_partkey AS product_id, p_name AS product, p_retailprice AS price, p_size / 10 AS weight_kg, (p_partkey % 3 + 1) * 30 AS return_window_days FROM part",
    "places": "SELECT n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "shoppers": """SELECT c_custkey AS customer_id, c_name AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'vip' WHEN 'FURNITURE' THEN 'gold' ELSE 'standard' END AS loyalty_tier,
  CASE WHEN c_custkey % 4 <> 0 THEN '+1-' || c_custkey END AS phone, c_acctbal < 0 AS opted_out, c_acctbal AS balance, region,
  CASE c_mktsegment WHEN 'BUILDING' THEN 10.0::DOUBLE WHEN 'FURNITURE' THEN 5.0 ELSE 0.0 END AS tier_pct,
  CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 1 ELSE 0 END AS tier_rank
FROM customer JOIN places ON c_nationkey = n_nationkey""",
    "flags": "SELECT c_custkey AS customer_id FROM customer WHERE c_acctbal < -500",
    "depots": "SELECT s_suppkey AS warehouse_id, region FROM supplier JOIN places ON s_nationkey = n_nationkey",
    "stock": """SELECT l_suppkey AS warehouse_id, l_partkey AS product_id,
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) AS BIGINT) AS quantity_available FROM lineitem GROUP BY ALL""",
    "rates": """SELECT a.r_name AS from_region, b.r_name AS to_region, 0.5 + 0.25 * abs(a.r_regionkey - b.r_regionkey) AS rate_per_kg,
  2.5 + a.r_regionkey AS base_fee, 2 + abs(a.r_regionkey - b.r_regionkey) AS delivery_days FROM region a, region b""",
    "buys": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderkey % (SELECT count(*) FROM part) AS product_id, o_orderkey % 7 + 1 AS quantity,
  o_orderkey % (SELECT count(*) FROM supplier) AS warehouse_id,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'fulfilled' ELSE 'backordered' END AS status,
  CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'delivered' ELSE 'shipped' END AS delivery_status,
  o_totalprice AS total, CAST(o_orderdate AS DATE) AS order_date, date_diff('day', CAST(o_orderdate AS DATE), (SELECT d FROM as_of)) AS days_since FROM orders""",
    "promos": """SELECT p_partkey AS promotion_id, CASE WHEN p_size % 2 = 0 THEN 'percentage' ELSE 'fixed' END AS promo_type, p_size / 2 AS discount_value,
  p_partkey % 3 + 1 AS min_quantity, p_partkey % 3 AS needed_rank, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 2 + 1 END AS max_uses, p_size > 5 AS active
FROM part WHERE p_type = 'PROMO'""",
    "uses": "SELECT product_id AS promotion_id, customer_id, count(*) AS n FROM buys WHERE status = 'fulfilled' AND product_id IN (SELECT promotion_id FROM promos) GROUP BY ALL",
    "quotes": """SELECT b.*, s.loyalty_tier, s.tier_pct, p.price, r.delivery_days, round(r.base_fee + r.rate_per_kg * (p.weight_kg * b.quantity) + 1e-9, 2) AS shipping_cost
FROM buys b JOIN shoppers s USING (customer_id) JOIN depots d USING (warehouse_id) JOIN products p USING (product_id)
LEFT JOIN rates r ON r.from_region = d.region AND r.to_region = s.region""",
    "submitted": """SELECT order_id, status, tier_pct, price * quantity AS subtotal, CASE WHEN order_id % 11 = 0 THEN 7.0 ELSE tier_pct END AS discount_pct,
  CAST(order_id % 3 * 5 AS DOUBLE) AS promotion_discount, shipping_cost FROM quotes""",
    "expected": "SELECT *, round(subtotal * (1 - discount_pct / 100) - promotion_discount + shipping_cost + 1e-9, 2) AS expected FROM submitted",
    "asked": "SELECT l_orderkey AS order_id, CASE WHEN max(l_linenumber) > 2 THEN CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) END AS amount FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "refunded": "SELECT DISTINCT l_orderkey AS order_id FROM lineitem WHERE l_returnflag = 'A'",
    "tracked": "SELECT l_orderkey AS order_id, CAST(max(l_shipdate) AS DATE) AS estimated_delivery, max(l_suppkey) AS carrier FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1",
    "valued": "SELECT b.order_id, b.customer_id, p.price * b.quantity > 200 AS high, b.customer_id IN (SELECT customer_id FROM flags) AS flagged FROM buys b JOIN products p USING (product_id)",
    "risk": """SELECT order_id, CAST(CASE WHEN high THEN 0.4 ELSE 0 END + CASE WHEN flagged THEN 0.3 ELSE 0 END AS DOUBLE) AS risk_score,
  CASE WHEN high AND flagged THEN 'high_value>flagged_customer' WHEN high THEN 'high_value' WHEN flagged THEN 'flagged_customer' ELSE '' END AS flags,
  CASE WHEN high AND flagged THEN 'block' WHEN high THEN 'review' ELSE 'approve' END AS decision FROM valued""",
    "asks": """SELECT o_orderkey * 2 + s AS request_id, o_orderkey // 2 AS order_id, (o_orderkey * 3 + s * 5) % 60 AS discount_percent FROM orders, (SELECT unnest([0, 1]) AS s)""",
    "granted": "SELECT order_id, min(request_id) AS request_id FROM asks WHERE discount_percent BETWEEN 1 AND 50 GROUP BY 1",
    "wishes": """SELECT order_id, CASE WHEN order_id % 2 = 0 THEN 'fulfilled' ELSE 'pending' END AS want,
  CASE WHEN order_id % 5 = 0 THEN order_id + 1 END AS swap, CASE WHEN order_id % 5 = 0 THEN 'fulfilled' END AS want_swap FROM buys""",
    "charges": "SELECT o_custkey AS payment_id, o_orderkey AS transaction_id, CAST(o_orderdate AS DATE) AS created, CAST(round(round(o_totalprice / 100 + 1e-9, 2) * 100) AS BIGINT) AS cents FROM orders",
    "entries": """SELECT c.*, CAST(round(c_acctbal * 100) AS BIGINT) AS opening, row_number() OVER (PARTITION BY payment_id ORDER BY created, transaction_id) AS rn
FROM charges c JOIN customer ON c_custkey = payment_id""",
    "ledger": """SELECT payment_id, transaction_id, rn, opening >= cents AS paid, CASE WHEN opening >= cents THEN opening - cents ELSE opening END AS balance FROM entries WHERE rn = 1
UNION ALL
SELECT e.payment_id, e.transaction_id, e.rn, l.balance >= e.cents, CASE WHEN l.balance >= e.cents THEN l.balance - e.cents ELSE l.balance END
FROM ledger l JOIN entries e ON e.payment_id = l.payment_id AND e.rn = l.rn + 1""",
    "words": """SELECT q, unnest(string_split(q, ' ')) AS w FROM (SELECT unnest(['the tion fr', 'und der src3', 'les des src1']) AS q)""",
    "scores": """SELECT q AS query, doc_id AS article_id, title, CAST(sum(2 * CAST(contains(lower(title), w) AS INTEGER) + CAST(contains(lower(text), w) AS INTEGER)
  + CAST(contains(lang, w) AS INTEGER) + CAST(contains(source, w) AS INTEGER)) AS BIGINT) AS score
FROM (SELECT *, source || ' ' || lang AS title FROM documents), words GROUP BY ALL""",
}


def shop(body: str) -> str:
    return query(body, **SHOP)


ORACLES: dict[str, str] = {
    "stock_locations": shop("SELECT product_id, warehouse_id, region, quantity_available FROM stock JOIN depots USING (warehouse_id)"),
    "stock_checks": shop("""SELECT order_id, quantity_available, CASE WHEN quantity_available IS NULL THEN 'no inventory record'
  WHEN quantity_available > 0 THEN 'available' ELSE 'out of stock' END AS stock FROM buys LEFT JOIN stock USING (warehouse_id, product_id)"""),
    "shipping_quotes": shop("SELECT order_id, round(shipping_cost, 4) AS shipping_cost, CAST(delivery_days AS BIGINT) AS delivery_days FROM quotes"),
    "reconcile_totals": shop("""SELECT order_id, round(expected, 4) AS expected, round(expected + CASE WHEN order_id % 10 = 0 THEN 0.5 ELSE 0 END, 4) AS total,
  CASE WHEN status <> 'pending' THEN 'not pending' WHEN abs(discount_pct - tier_pct) > 0.01 THEN 'bad discount' WHEN order_id % 10 = 0 THEN 'bad total' ELSE 'ok' END AS outcome FROM expected"""),
    "loyalty_discounts": shop("SELECT customer_id, loyalty_tier, tier_pct AS discount_pct FROM shoppers"),
    "apply_discounts": shop("""SELECT a.request_id, a.order_id, CASE WHEN o.total IS NULL THEN 'order not found' WHEN a.discount_percent NOT BETWEEN 1 AND 50 THEN 'discount out of range'
  WHEN g.request_id <> a.request_id THEN 'already applied' ELSE 'applied' END AS outcome,
  CASE WHEN g.request_id = a.request_id THEN round(o.total * (1 - a.discount_percent / 100) + 1e-9, 2) END AS new_amount
FROM asks a LEFT JOIN buys o USING (order_id) LEFT JOIN granted g USING (order_id)"""),
    "promotion_checks": shop("""SELECT promotion_id, order_id, outcome, CASE WHEN outcome = 'valid' THEN round(CASE WHEN promo_type = 'percentage' THEN round(price * quantity * discount_value / 100 + 1e-9, 2) ELSE discount_value END, 4) END AS discount_amount
FROM (SELECT p.*, b.order_id, b.quantity, x.price, CASE WHEN NOT p.active THEN 'inactive' WHEN p.needed_rank > 0 AND s.tier_rank < p.needed_rank THEN 'tier too low'
    WHEN b.quantity < p.min_quantity THEN 'quantity too low' WHEN coalesce(u.n, 0) >= p.max_uses THEN 'limit reached' ELSE 'valid' END AS outcome
  FROM buys b JOIN promos p ON p.promotion_id = b.product_id JOIN products x USING (product_id) JOIN shoppers s USING (customer_id)
  LEFT JOIN uses u ON u.promotion_id = p.promotion_id AND u.customer_id = b.customer_id)"""),
    "return_eligibility": shop("""SELECT order_id, status = 'backordered' OR (status = 'fulfilled' AND days_since <= return_window_days) AS eligible,
  CASE WHEN status = 'backordered' THEN 'cancellable at any time' WHEN status <> 'fulfilled' THEN 'status is ' || status
    WHEN days_since > return_window_days THEN 'window expired: ' || days_since || ' days, ' || return_window_days || ' allowed'
    ELSE 'within ' || return_window_days || ' days (' || days_since || ' since purchase)' END AS reason,
  CASE WHEN status = 'backordered' THEN 0.0 WHEN status = 'fulfilled' AND days_since <= return_window_days THEN round(total, 4) END AS refund_amount
FROM buys JOIN products USING (product_id)"""),
    "refund_eligibility": shop("""SELECT order_id, outcome, CASE WHEN outcome = 'eligible' THEN round(total, 4) END AS max_refund FROM (
  SELECT *, CASE WHEN order_id IN (SELECT order_id FROM refunded) THEN 'already refunded' WHEN delivery_status <> 'delivered' THEN 'not delivered'
    WHEN days_since > 30 THEN 'outside window' ELSE 'eligible' END AS outcome FROM buys)"""),
    "refund_batch": shop("""SELECT order_id, outcome, CASE WHEN outcome = 'processed' THEN round(coalesce(amount, total), 4) END AS refunded FROM (
  SELECT a.order_id, a.amount, b.total, CASE WHEN b.total IS NULL THEN 'order not found' WHEN a.order_id IN (SELECT order_id FROM refunded) THEN 'already refunded'
    WHEN a.amount > b.total THEN 'exceeds order total' ELSE 'processed' END AS outcome FROM asked a LEFT JOIN buys b USING (order_id))"""),
    "warranty": shop("""SELECT order_id, CASE WHEN delivery_status <> 'delivered' THEN 'not_applicable' WHEN days_since >= 365 THEN 'expired' ELSE 'active' END AS warranty_status,
  CASE WHEN delivery_status = 'delivered' AND days_since < 365 THEN 365 - days_since END AS days_remaining FROM buys"""),
    "order_risk": shop("SELECT * FROM risk"),
    "compliance_requirements": shop("""SELECT order_id, CASE WHEN high AND flagged THEN 'high_value_review>flagged_customer_review' WHEN high THEN 'high_value_review' WHEN flagged THEN 'flagged_customer_review' ELSE '' END AS requirements,
  CAST(high AS BIGINT) + CAST(flagged AS BIGINT) AS total_checks FROM valued"""),
    "latest_assessments": shop("SELECT order_id, order_id * 2 + 1 AS assessment_id, 'approve' AS decision FROM risk WHERE decision = 'review' UNION ALL SELECT order_id, order_id * 2, decision FROM risk WHERE decision <> 'review'"),
    "customer_history": shop("""SELECT *, row_number() OVER (PARTITION BY customer_id, kind ORDER BY order_date DESC, item_id) AS position FROM (
SELECT customer_id, 'order' AS kind, order_id AS item_id, product AS subject, round(total, 4) AS amount, CAST(order_date AS VARCHAR) AS order_date FROM buys JOIN products USING (product_id)
UNION ALL SELECT conv_id, 'ticket', turn, text, NULL, NULL FROM conversations)"""),
    "customer_totals": shop("""SELECT s.customer_id, s.name, s.loyalty_tier, count(b.order_id) AS n_orders, round(coalesce(CAST(sum(CAST(b.total AS DECIMAL(18,2))) AS DOUBLE), 0), 4) AS total_spent
FROM shoppers s LEFT JOIN buys b USING (customer_id) GROUP BY ALL"""),
    "active_promotions": shop("SELECT promotion_id AS product_id, promotion_id, promo_type, round(discount_value, 4) AS discount_value FROM promos WHERE active"),
    "promotion_usage": shop("SELECT promotion_id, customer_id, n AS uses FROM uses"),
    "payment_methods": shop("""SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY is_default DESC, method) AS position, method, is_default FROM (
  SELECT customer_id, 'wallet' AS method, balance > 0 AS is_default FROM shoppers UNION ALL SELECT customer_id, 'credit_card', balance <= 0 FROM shoppers WHERE phone IS NOT NULL)"""),
    "keyword_search": shop("""SELECT article_id, title, query, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) AS position FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) <= 3"""),
    "restock": shop("""SELECT warehouse_id, product_id, r.d IS NOT NULL AS restock_scheduled, CAST(r.d AS VARCHAR) AS expected_date, r.q AS expected_quantity FROM stock
LEFT JOIN (SELECT l_suppkey AS warehouse_id, l_partkey AS product_id, CAST(max(l_shipdate) AS DATE) + 14 AS d, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) r USING (warehouse_id, product_id)"""),
    "net_stock": shop("""SELECT warehouse_id, product_id, coalesce(r.q, 0) AS reserved, quantity_available - coalesce(r.q, 0) AS net_quantity FROM stock
LEFT JOIN (SELECT l_suppkey AS warehouse_id, l_partkey AS product_id, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) r USING (warehouse_id, product_id)"""),
    "wallet_ledger": shop("SELECT payment_id, transaction_id, CASE WHEN paid THEN 'completed' ELSE 'failed' END AS status, round(balance / 100, 4) AS balance FROM ledger"),
    "verify_outcomes": shop("""SELECT w.order_id, w.want = b.status AND (w.swap IS NULL OR coalesce(s.status = w.want_swap, false)) AS passed,
  array_to_string(list_filter([CASE WHEN w.want <> b.status THEN w.order_id || ' status: expected ' || w.want || ', got ' || b.status END,
    CASE WHEN w.swap IS NOT NULL AND s.status IS NULL THEN 'cannot read ' || w.swap WHEN s.status <> w.want_swap THEN w.swap || ' status: expected ' || w.want_swap || ', got ' || s.status END],
    lambda x: x IS NOT NULL), '>') AS errors
FROM wishes w JOIN buys b USING (order_id) LEFT JOIN buys s ON s.order_id = w.swap"""),
    "reachability": shop("""SELECT order_id, CASE WHEN order_id % 2 = 0 THEN 'sms' ELSE 'email' END AS channel, CASE WHEN opted_out THEN 'opted out'
  WHEN order_id % 2 = 0 AND phone IS NULL THEN 'unreachable' ELSE 'sent' END AS outcome FROM buys JOIN shoppers USING (customer_id)"""),
    "shipping_status": shop("""SELECT order_id, CASE WHEN delivery_status = 'processing' THEN 'not_shipped' WHEN delivery_status = 'delivered' THEN 'delivered' WHEN carrier IS NOT NULL THEN 'in_transit' ELSE 'shipped' END AS shipping_status,
  CASE WHEN delivery_status = 'delivered' THEN 'delivered ' || days_since || ' days ago' WHEN delivery_status = 'shipped' AND carrier IS NULL THEN 'tracking unavailable' END AS message,
  CASE WHEN delivery_status = 'shipped' THEN carrier END AS carrier, CASE WHEN delivery_status = 'shipped' THEN CAST(estimated_delivery AS VARCHAR) END AS estimated_delivery
FROM buys LEFT JOIN tracked USING (order_id)"""),
}

#: A third of all charges in one wallet that can pay them all, the others as they are.
ORACLES["wallet_ledger_one_wallet"] = query("""
SELECT payment_id, transaction_id, CASE WHEN paid THEN 'completed' ELSE 'failed' END AS status, round(balance / 100, 4) AS balance FROM ledger
UNION ALL SELECT -1, transaction_id, 'completed',
  round(CAST(100000000000 - sum(cents) OVER (ORDER BY created, transaction_id) AS DOUBLE) / 100, 4) FROM charges WHERE transaction_id % 3 = 0""",
    **{**SHOP, "entries": SHOP["entries"] + " WHERE transaction_id % 3 <> 0"})
