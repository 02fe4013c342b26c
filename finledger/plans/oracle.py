"""Independent DuckDB SQL for every registered query.

The oracle computes straight from the base tables (``orders``, ``lineitem``,
``supplier``, ``part``): it never goes through the text extracts, so it checks
the Spark parsers as well as the operators.  Parameters are the defaults of
``Params`` and the variants in ``registry``.
"""

from __future__ import annotations

from ..operators import books as B
from ..operators import statements as S
from ..params import DEFAULT, FAILURE_STATUSES, GATEWAYS, SUCCESSFUL_STATUSES
from ..sources.bindings import ACCOUNTS
from . import registry as RG

P = DEFAULT


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _d(d) -> str:
    return f"DATE '{d.isoformat()}'"


FISCAL = f"BETWEEN {_d(P.fiscal_from)} AND {_d(P.fiscal_to)}"
USER = f"BETWEEN {_d(P.date_from)} AND {_d(P.date_to)}"
ACC_LIST = "[" + ", ".join(_q(a) for a in ACCOUNTS) + "]"
LINE_CASE = "CASE label " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in S.LINE_NO.items()) + " END"

BASE = f"""
o AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_orderpriority AS pr, CAST(o_orderdate AS DATE) AS d,
    CASE o_custkey % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'wallet_a' WHEN 2 THEN 'wallet_b' ELSE 'checkout' END AS gateway,
    CASE o_custkey % 4 WHEN 0 THEN o_orderkey % 23 = 0 WHEN 1 THEN o_orderkey % 47 = 0
         WHEN 2 THEN o_orderkey % 101 = 0 ELSE o_orderkey % 31 = 0 END AS rf,
    CASE WHEN o_orderstatus = 'F' THEN CASE o_custkey % 4 WHEN 0 THEN 'settled' WHEN 3 THEN 'paid' ELSE 'completed' END
         WHEN o_orderstatus = 'O' THEN 'pending'
         ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'gateway_rejected' WHEN '2-HIGH' THEN 'processor_declined'
              WHEN '3-MEDIUM' THEN 'failed' WHEN '4-NOT SPECIFIED' THEN 'voided' WHEN '5-LOW' THEN 'settlement_declined' END
    END AS status,
    CASE o_orderkey % 10 WHEN 7 THEN 'EUR' WHEN 8 THEN '' WHEN 9 THEN NULL ELSE 'usd' END AS currency,
    CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * 0.01, 2) AS DECIMAL(18,2)) AS amt
  FROM orders),
o2 AS (SELECT *, CAST(ROUND(amt * 0.029 + 0.30, 2) AS DECIMAL(18,2)) AS fee FROM o),
card_l AS (
  SELECT 'c-' || k AS transaction_id, d AS date, amt AS amount, CAST(NULL AS DECIMAL(18,2)) AS fee,
    amt AS net_amount, status, CASE WHEN rf THEN 'credit' ELSE 'sale' END AS type, 'card' AS source,
    'o-' || k AS description, currency,
    CASE WHEN k % 19 = 0 THEN 'No' || ck ELSE 'Cust No' || ck END AS customer_name,
    'cust' || ck || '@example.com' AS customer_email, rf AS is_refund,
    CASE WHEN rf THEN 'debit' ELSE 'credit' END AS balance_impact
  FROM o2 WHERE gateway = 'card' AND k % 17 <> 0 AND status = 'settled'),
wal_l AS (
  SELECT CASE WHEN gateway = 'wallet_a' THEN 'wa-' ELSE 'wb-' END || k AS transaction_id, d AS date,
    CASE WHEN rf OR pr = '3-MEDIUM' THEN -amt ELSE amt END AS amount, fee,
    CAST((CASE WHEN rf OR pr = '3-MEDIUM' THEN -amt ELSE amt END) - fee AS DECIMAL(18,2)) AS net_amount,
    status,
    CASE WHEN rf THEN 'Payment Refund' WHEN pr = '4-NOT SPECIFIED' THEN 'General Currency Conversion'
         WHEN k % 13 = 0 THEN NULL ELSE 'Website Payment' END AS type,
    gateway AS source, 'Item ' || (k % 50) AS description,
    CASE WHEN k % 10 IN (8, 9) THEN NULL ELSE currency END AS currency,
    'Cust No' || ck AS customer_name, 'cust' || ck || '@example.com' AS customer_email, rf AS is_refund,
    CASE WHEN k % 11 = 0 THEN NULL WHEN pr = '3-MEDIUM' THEN 'debit' ELSE 'credit' END AS balance_impact
  FROM o2 WHERE gateway IN ('wallet_a', 'wallet_b')),
chk_l AS (
  SELECT 'k-' || k AS transaction_id, d AS date, amt AS amount,
    CASE WHEN k % 29 = 0 THEN NULL ELSE fee END AS fee,
    CAST(amt - (CASE WHEN rf THEN amt ELSE 0 END) - (CASE WHEN k % 29 = 0 THEN NULL ELSE fee END) AS DECIMAL(18,2)) AS net_amount,
    status, CASE WHEN rf THEN 'refund' ELSE 'payment' END AS type, 'checkout' AS source,
    'Order o-' || k AS description, upper(currency) AS currency, 'Cust No' || ck AS customer_name,
    'cust' || ck || '@example.com' AS customer_email, rf AS is_refund, 'credit' AS balance_impact
  FROM o2 WHERE gateway = 'checkout'),
uni AS (SELECT * FROM card_l UNION ALL SELECT * FROM wal_l UNION ALL SELECT * FROM chk_l),
led AS (
  SELECT *, CAST(date_trunc('month', date) AS DATE) AS month, strftime(date, '%Y-%m') AS yearmon,
    CAST(year(date) AS INTEGER) AS yr
  FROM uni WHERE date {FISCAL}),
v AS (
  SELECT * FROM led
  WHERE coalesce(upper(currency) IN ('USD', ''), false)
    AND coalesce(status IN {_in(SUCCESSFUL_STATUSES)}, false)
    AND NOT coalesce(regexp_matches(type, '(?i)conversion|currency conversion'), false)
    AND (balance_impact = 'credit' OR balance_impact IS NULL)),
lf AS (SELECT * FROM led WHERE date {USER} AND source IN {_in(P.sources)}),
vf AS (SELECT * FROM v WHERE date {USER} AND source IN {_in(P.sources)}),
card_raw AS (SELECT * FROM o2 WHERE gateway = 'card'),
fails AS (
  SELECT CAST(date_trunc('month', d) AS DATE) AS month, status, count(*) AS n
  FROM card_raw WHERE status IN {_in(FAILURE_STATUSES)} GROUP BY 1, 2),
bk AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
    CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'Sales Receipt' WHEN 'NF' THEN 'Deposit'
      WHEN 'AF' THEN 'Expense' WHEN 'AO' THEN 'Bill' WHEN 'RF' THEN 'Purchase Order'
      WHEN 'RO' THEN 'Journal Entry' END AS trans_type,
    CAST(l_orderkey AS VARCHAR) AS num, 'Yes' AS posting,
    CASE s_suppkey % 5 WHEN 0 THEN 'Northern Freight ' WHEN 1 THEN 'Metro Express ' ELSE '' END || s_name AS name,
    p_type AS memo,
    CASE WHEN l_returnflag = 'N' THEN '10100 Checking' ELSE '20000 Accounts Payable' END AS account,
    ({ACC_LIST})[p_size % 18 + 1] AS split,
    CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2))
         ELSE -CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
    CAST(s_nationkey AS INTEGER) AS entity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
bkw AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month FROM bk WHERE amount IS NOT NULL AND date {FISCAL}),
cogs AS (SELECT *, regexp_replace(split, '^[0-9]+ ', '') AS account_clean FROM bkw WHERE starts_with(split, '50')),
cogs_f AS (SELECT * FROM cogs WHERE date {USER}),
bm AS (
  SELECT month,
    coalesce(sum(CASE WHEN trans_type IN {_in(B.REVENUE_TYPES)} AND amount > 0 THEN amount END), 0) AS qb_revenue,
    abs(coalesce(sum(CASE WHEN trans_type IN {_in(B.EXPENSE_TYPES)} AND amount < 0 THEN amount END), 0)) AS qb_expenses
  FROM bkw GROUP BY month),
ppm AS (
  SELECT month,
    coalesce(sum(CASE WHEN NOT is_refund AND amount > 0 THEN amount END), 0) AS pp_gross,
    coalesce(sum(CASE WHEN NOT is_refund AND amount > 0 THEN coalesce(fee, 0) END), 0) AS pp_fees,
    count(CASE WHEN NOT is_refund AND amount > 0 THEN 1 END) AS n_sale
  FROM v GROUP BY month HAVING n_sale > 0),
ppr AS (SELECT month, sum(abs(amount)) AS pp_refunds FROM v WHERE is_refund GROUP BY month),
mpl AS (
  SELECT month,
    coalesce(pp_gross, 0) - coalesce(pp_refunds, 0) AS gross_revenue,
    coalesce(pp_refunds, 0) AS pp_refunds,
    coalesce(pp_gross, 0) - coalesce(pp_refunds, 0) - coalesce(pp_fees, 0) AS net_revenue,
    coalesce(qb_expenses, 0) AS total_expenses,
    coalesce(pp_gross, 0) - coalesce(pp_refunds, 0) - coalesce(qb_expenses, 0) AS net_income
  FROM ppm FULL OUTER JOIN bm USING (month) FULL OUTER JOIN ppr USING (month)),
mpl_f AS (SELECT * FROM mpl WHERE month {USER}),
acc AS (
  SELECT entity, split,
    CAST(sum(CASE WHEN amount < 0 THEN -amount END) AS DECIMAL(38,2)) AS spent,
    CAST(sum(CASE WHEN trans_type IN {_in(B.REVENUE_TYPES)} AND amount > 0 THEN amount END) AS DECIMAL(38,2)) AS income
  FROM bkw GROUP BY entity, split),
tot AS (
  SELECT entity, coalesce(sum(income), 0) AS inc,
    coalesce(sum(CASE WHEN split IN {_in(S.COGS_ACCOUNTS)} THEN spent END), 0) AS cogs,
    coalesce(sum(CASE WHEN split IN {_in(S.EXPENSE_ACCOUNTS)} THEN spent END), 0) AS exp
  FROM acc GROUP BY entity),
lines AS (
  SELECT entity AS statement_id, split AS label, spent AS value FROM acc
    WHERE spent IS NOT NULL AND split IN {_in(S.COGS_ACCOUNTS + S.EXPENSE_ACCOUNTS)}
  UNION ALL SELECT entity, 'Total for ' || split, spent FROM acc
    WHERE spent IS NOT NULL AND split IN {_in(sorted(S.SUB_TOTALLED))}
  UNION ALL SELECT entity, 'Income', NULL FROM tot
  UNION ALL SELECT entity, 'Total for Income', inc FROM tot
  UNION ALL SELECT entity, 'Cost of Goods Sold', NULL FROM tot
  UNION ALL SELECT entity, 'Total for Cost of Goods Sold', cogs FROM tot
  UNION ALL SELECT entity, 'Gross Profit', inc - cogs FROM tot
  UNION ALL SELECT entity, 'Expenses', NULL FROM tot
  UNION ALL SELECT entity, 'Total for Expenses', exp FROM tot
  UNION ALL SELECT entity, 'Net Operating Income', inc - cogs - exp FROM tot
  UNION ALL SELECT entity, 'Net Income', inc - cogs - exp FROM tot),
stm AS (SELECT CAST(statement_id AS INTEGER) AS statement_id, CAST({LINE_CASE} AS INTEGER) AS line_no, label,
               CAST(value AS DECIMAL(38,2)) AS value FROM lines),
vsum AS (SELECT name, coalesce(sum(CASE WHEN amount < 0 THEN -amount END), 0) AS spent FROM bkw GROUP BY name),
vend AS (SELECT name AS vendor, CAST(spent AS DECIMAL(38,2)) AS amount FROM vsum WHERE name IS NOT NULL AND spent > 0)
"""


def _first(name: str, pattern: str, non_null: bool = False) -> str:
    cond = f"regexp_matches(label, {_q(pattern)})" + (" AND value IS NOT NULL" if non_null else "")
    return (
        f"{name} AS (SELECT statement_id, value FROM (SELECT statement_id, value, "
        f"row_number() OVER (PARTITION BY statement_id ORDER BY line_no) AS rn FROM stm WHERE {cond}) WHERE rn = 1)"
    )


METRIC_CTES = ",\n".join(_first("m_" + k, "(?i)" + p) for k, p in S.METRIC_PATTERNS.items())
WF_CTES = ",\n".join(_first("w_" + k, p, non_null=True) for k, p in S.WATERFALL_PATTERNS.items())
SM = (
    "sm AS (SELECT ids.statement_id, "
    + ", ".join(f"m_{k}.value AS {k}" for k in S.METRIC_PATTERNS)
    + " FROM (SELECT DISTINCT statement_id FROM stm) ids "
    + " ".join(f"LEFT JOIN m_{k} USING (statement_id)" for k in S.METRIC_PATTERNS)
    + ")"
)


def _sum_labels(labels) -> str:
    return f"sum(CASE WHEN label IN {_in(labels)} THEN value END)"


COST = (
    "cost AS (SELECT s.statement_id, "
    + ", ".join(f"{_sum_labels(S.COST_LABELS[k])} AS {k}" for k in ("product_cogs", "shipping_cost", "processing_fees_total"))
    + ", any_value(sm.cogs) AS total_cogs, "
    + ", ".join(f"{_sum_labels(S.COST_LABELS[k])} AS {k}" for k in ("packaging", "commissions", "warranty"))
    + " FROM stm s JOIN sm USING (statement_id) GROUP BY s.statement_id)"
)

WF = (
    "wfw AS (SELECT sm.statement_id, coalesce(sm.gross_revenue, 0) AS rev, coalesce(sm.cogs, 0) AS cogs0, "
    "coalesce(sm.total_expenses, 0) AS texp, coalesce(sm.net_income, 0) AS net, "
    + ", ".join(f"coalesce(w_{k}.value, 0) AS {k}" for k in S.WATERFALL_PATTERNS)
    + " FROM sm "
    + " ".join(f"LEFT JOIN w_{k} USING (statement_id)" for k in S.WATERFALL_PATTERNS)
    + "),\n"
    "wf AS (\n"
    + "\n  UNION ALL ".join(
        f"SELECT statement_id, {i + 1} AS step, {_q(lbl)} AS label, CAST({expr} AS DECIMAL(38,2)) AS value, {_q(meas)} AS measure FROM wfw"
        for i, ((lbl, meas), expr) in enumerate(
            zip(
                S.WATERFALL_STEPS,
                [
                    "rev", "-pcogs", "-(cogs0 - pcogs)", "rev - pcogs - (cogs0 - pcogs)", "-legal", "-mkt", "-staff",
                    "-office", "-web", "-amort", "-(travel + tax_a + tax_b)",
                    "-(texp - (legal + mkt + staff + office + web + amort + travel + tax_a + tax_b))", "net",
                ],
            )
        )
    )
    + ")"
)

STMT_CTES = ",\n".join([METRIC_CTES, SM, COST, WF_CTES, WF])


def _with(*extra: str) -> str:
    return "WITH " + BASE.strip() + (",\n" + ",\n".join(extra) if extra else "") + "\n"


def _w(sql: str, stmt: bool = False) -> str:
    return _with(STMT_CTES) + sql if stmt else _with() + sql


def _dbl(expr: str, name: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name}"


SALE = "(NOT is_refund AND amount > 0)"
GROSS = f"coalesce(sum(CASE WHEN {SALE} THEN amount END), 0)"
REFUNDS = "coalesce(sum(CASE WHEN is_refund THEN abs(amount) END), 0)"
LEDGER_COLS = (
    "transaction_id, date, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee, "
    "CAST(net_amount AS DOUBLE) AS net_amount, status, type, source, description, currency, "
    "customer_name, customer_email, is_refund, balance_impact"
)
LEDGER_ALL = LEDGER_COLS + ", month, yearmon, yr"
BOOK_COLS = "date, trans_type, num, posting, name, memo, account, split, CAST(amount AS DOUBLE) AS amount, entity, month"
EXPLORE_COLS = (
    "date, source, status, type, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee, "
    "CAST(net_amount AS DOUBLE) AS net, is_refund AS refund, currency, description, customer_name AS customer, "
    "customer_email AS email, transaction_id AS txn_id"
)


def _money_text(x: str) -> str:
    return (
        f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE k % 3 WHEN 0 THEN '$' WHEN 1 THEN '$ ' ELSE '' END "
        f"|| format('{{:,.2f}}', abs({x})))"
    )


def _fmt_money2(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' WHEN {x} < 0 THEN '-$' || format('{{:,.2f}}', abs({x})) ELSE '$' || format('{{:,.2f}}', {x}) END"


def _fmt_currency(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN {x} < 0 THEN '-$' || format('{{:,.0f}}', abs({x})) ELSE '$' || format('{{:,.0f}}', abs({x})) END"


def _pct(num: str, den: str) -> str:
    return f"round(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100.0, 1)"


RATES = f"""
rbase AS (SELECT * FROM led WHERE date {USER} AND source IN {_in(P.sources)}
  AND coalesce(upper(currency) IN ('USD', ''), false)
  AND NOT coalesce(regexp_matches(type, '(?i)conversion|currency conversion'), false)),
ragg AS (SELECT source,
  sum(CASE WHEN {SALE} AND status IN {_in(SUCCESSFUL_STATUSES)} THEN amount END) AS rev,
  sum(CASE WHEN is_refund THEN abs(amount) END) AS refunds FROM rbase GROUP BY source),
rates AS (SELECT d.source, CAST(coalesce(rev, 0) AS DOUBLE) AS rev, CAST(coalesce(refunds, 0) AS DOUBLE) AS refunds,
  CASE WHEN coalesce(rev, 0) > 0 THEN {_pct('coalesce(refunds, 0)', 'rev')} ELSE 0.0 END AS rate
  FROM (SELECT unnest({'[' + ', '.join(_q(g) for g in GATEWAYS) + ']'}) AS source) d LEFT JOIN ragg USING (source)),
q1 AS (SELECT yr, sum(amount) AS q1 FROM v WHERE {SALE} AND month(date) <= 3 GROUP BY yr),
q1y AS (SELECT yr AS year, CAST(q1 AS DOUBLE) AS q1_revenue,
  CASE WHEN lag(yr) OVER (ORDER BY yr) = yr - 1 THEN CAST(lag(q1) OVER (ORDER BY yr) AS DOUBLE) END AS prev_q1_revenue,
  CASE WHEN lag(yr) OVER (ORDER BY yr) = yr - 1 AND lag(q1) OVER (ORDER BY yr) > 0
       THEN {_pct('q1 - lag(q1) OVER (ORDER BY yr)', 'lag(q1) OVER (ORDER BY yr)')} END AS q1_yoy_pct FROM q1)
"""

KPI_VOL = f"""
kv AS (SELECT count(CASE WHEN NOT is_refund THEN 1 END) AS total_txn,
  count(CASE WHEN source = {_q(P.failure_gateway)} THEN 1 END) AS gw_rev_n,
  sum(CASE WHEN {SALE} THEN amount END) AS sale_sum, count(CASE WHEN {SALE} THEN 1 END) AS sale_n FROM vf),
kf AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS failed_txn FROM fails WHERE month IS NOT NULL AND month {USER}),
kvol AS (SELECT total_txn, failed_txn,
  CASE WHEN failed_txn + gw_rev_n > 0 THEN {_pct('failed_txn', 'failed_txn + gw_rev_n')} ELSE 0.0 END AS failure_rate,
  CASE WHEN sale_n > 0 THEN CAST(sale_sum AS DOUBLE) / sale_n END AS avg_value FROM kv, kf),
kov AS (SELECT {_dbl(GROSS, 'gross')}, {_dbl(REFUNDS, 'refunds')}, {_dbl(GROSS + ' - ' + REFUNDS, 'net')} FROM vf)
"""

PL_KPI = f"""
pla AS (SELECT count(*) AS n_months, coalesce(sum(gross_revenue), 0) AS rev_sum, coalesce(sum(net_income), 0) AS net_sum FROM mpl_f),
plc AS (SELECT count(*) AS n_cogs, abs(coalesce(sum(amount), 0)) AS cogs_sum,
  abs(coalesce(sum(CASE WHEN regexp_matches(split, '^50000') THEN amount END), 0)) AS prod,
  abs(coalesce(sum(CASE WHEN regexp_matches(split, '^5070[01]') THEN amount END), 0)) AS ship FROM cogs_f),
plm AS (SELECT max(gross_revenue) AS st_rev, max(cogs) AS st_cogs, max(net_income) AS st_net FROM sm WHERE statement_id = {P.statement_id}),
plk AS (SELECT max(product_cogs) AS st_prod, max(shipping_cost) AS st_ship, max(processing_fees_total) AS st_fees,
  max(total_cogs) AS st_tot FROM cost WHERE statement_id = {P.statement_id})
"""

EXPLORE_PAGE_ORDER = "amount DESC NULLS LAST, txn_id ASC"


def oracle_sql() -> dict[str, str]:
    src_sel = _in(RG.SUBSET)
    ex = RG.EXPLORE
    Q: dict[str, str] = {}

    # 2.1 sources / sinks
    Q["scan_card"] = _w(
        """SELECT 'c-' || k AS "Transaction ID", CASE WHEN rf THEN 'credit' ELSE 'sale' END AS "Transaction Type",
  status AS "Transaction Status", strftime(CAST(d AS TIMESTAMP), '%m/%d/%Y %H:%M:%S') AS "Created Datetime",
  CASE WHEN k % 17 = 0 THEN '' ELSE CAST(amt AS VARCHAR) END AS "Amount Submitted For Settlement",
  'cust' || ck || '@example.com' AS "Customer Email", CASE WHEN k % 19 = 0 THEN '' ELSE 'Cust' END AS "Customer First Name",
  'No' || ck AS "Customer Last Name", 'o-' || k AS "Order ID", currency AS "Currency ISO Code"
FROM o2 WHERE gateway = 'card'"""
    )
    Q["scan_wallet"] = _w(
        f"""SELECT CASE gateway WHEN 'wallet_a' THEN strftime(d, '%m/%d/%Y') ELSE strftime(d, '%-m/%-d/%Y') END AS "Date", '00:00:00' AS "Time", 'Cust No' || ck AS "Name",
  CASE WHEN rf THEN 'Payment Refund' WHEN pr = '4-NOT SPECIFIED' THEN 'General Currency Conversion'
       WHEN k % 13 = 0 THEN NULL ELSE 'Website Payment' END AS "Type",
  upper(substr(status, 1, 1)) || substr(status, 2) AS "Status",
  CASE WHEN currency = '' THEN NULL ELSE currency END AS "Currency",
  {_money_text("(CASE WHEN rf OR pr = '3-MEDIUM' THEN -amt ELSE amt END)")} AS "Gross",
  {_money_text("fee")} AS "Fee",
  {_money_text("((CASE WHEN rf OR pr = '3-MEDIUM' THEN -amt ELSE amt END) - fee)")} AS "Net",
  'cust' || ck || '@example.com' AS "From Email Address",
  CASE gateway WHEN 'wallet_a' THEN 'wa-' ELSE 'wb-' END || k AS "Transaction ID",
  'Item ' || (k % 50) AS "Item Title",
  CASE WHEN k % 11 = 0 THEN NULL WHEN pr = '3-MEDIUM' THEN 'Debit' ELSE 'Credit' END AS "Balance Impact"
FROM o2 WHERE gateway IN ('wallet_a', 'wallet_b')"""
    )
    Q["scan_checkout"] = _w(
        """SELECT 'k-' || k AS "id", strftime(CAST(d AS TIMESTAMP), '%Y-%m-%d %H:%M') AS "Created date (UTC)",
  CAST(amt AS VARCHAR) AS "Amount",
  CASE WHEN rf THEN CAST(amt AS VARCHAR) WHEN k % 2 = 0 THEN '0' ELSE '' END AS "Amount Refunded",
  CASE WHEN k % 29 = 0 THEN '' ELSE CAST(fee AS VARCHAR) END AS "Fee", status AS "Status",
  'Order o-' || k AS "Description", currency AS "Currency", 'Cust No' || ck AS "Customer Description",
  'cust' || ck || '@example.com' AS "Customer Email"
FROM o2 WHERE gateway = 'checkout'"""
    )
    Q["scan_statement"] = _w(
        "SELECT statement_id, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY line_no) AS INTEGER) AS line_no, "
        "label, CAST(value AS DOUBLE) AS value FROM stm"
    )
    Q["scan_books"] = _w(f"SELECT {BOOK_COLS} FROM bkw")
    Q["cache_roundtrip"] = _w(f"SELECT {LEDGER_ALL} FROM led")
    Q["stream_ingest"] = _w(f"SELECT {LEDGER_ALL} FROM led")
    Q["load_extracts"] = _w(f"SELECT {LEDGER_ALL} FROM led WHERE source <> 'wallet_b'")
    Q["load_report"] = _w(
        f"""SELECT d.source, CASE WHEN coalesce(c.n, 0) > 0 THEN 'loaded' ELSE 'missing' END AS status,
  coalesce(c.n, 0) AS rows
FROM (SELECT unnest({'[' + ', '.join(_q(g) for g in list(GATEWAYS) + ['books']) + ']'}) AS source) d
LEFT JOIN (SELECT source, count(*) AS n FROM uni GROUP BY source UNION ALL SELECT 'books', count(*) FROM bkw) c USING (source)"""
    )
    Q["load_extracts_report"] = _w(
        """SELECT source, file, status, rows FROM (
  SELECT 'card' AS source, 'card_odd' AS file, 'loaded' AS status, count(*) AS rows FROM uni
  WHERE source = 'card' AND CAST(substr(transaction_id, 3) AS BIGINT) % 2 = 1
  UNION ALL SELECT 'card', 'card_even', 'loaded', count(*) FROM uni
  WHERE source = 'card' AND CAST(substr(transaction_id, 3) AS BIGINT) % 2 = 0
  UNION ALL SELECT 'wallet_a', 'wallet_a', 'loaded', count(*) FROM uni WHERE source = 'wallet_a'
  UNION ALL SELECT 'wallet_b', 'wallet_b', 'missing', 0
  UNION ALL SELECT 'checkout', 'checkout', 'loaded', count(*) FROM uni WHERE source = 'checkout')"""
    )
    Q["load_rejects"] = _w(
        """SELECT r.source, CAST(r.read + coalesce(t.n, 0) AS BIGINT) AS read, b.reason, coalesce(b.n, 0) AS n, b.order_sum
FROM (SELECT 'wallet_b' AS source, 0 AS read UNION ALL
      SELECT gateway, count(*) FROM o2 WHERE gateway <> 'wallet_b' GROUP BY gateway) r
LEFT JOIN (SELECT gateway AS source, CASE k % 97 WHEN 5 THEN 'short' WHEN 6 THEN 'long' ELSE 'quote' END AS reason,
             count(*) AS n, CAST(sum(CASE WHEN k % 97 <> 5 THEN k END) AS BIGINT) AS order_sum
           FROM o2 WHERE gateway <> 'wallet_b' AND k % 97 IN (5, 6, 7) GROUP BY 1, 2) b ON b.source = r.source
LEFT JOIN (SELECT gateway AS source, count(*) AS n FROM o2 WHERE gateway <> 'wallet_b' AND k % 97 IN (5, 6, 7) GROUP BY 1) t
  ON t.source = r.source"""
    )
    Q["export_csv"] = _w(f"SELECT {EXPLORE_COLS} FROM lf")

    # 2.2 projections
    Q["norm_card"] = _w(f"SELECT {LEDGER_COLS} FROM card_l")
    Q["norm_wallet"] = _w(f"SELECT {LEDGER_COLS} FROM wal_l")
    Q["norm_checkout"] = _w(f"SELECT {LEDGER_COLS} FROM chk_l")
    Q["default_columns"] = _w(
        """SELECT transaction_id, date, CAST(amount AS DOUBLE) AS amount, CAST(0 AS DOUBLE) AS fee,
  CAST(0 AS DOUBLE) AS net_amount,
  'unknown' AS status, type, source, description, 'USD' AS currency, customer_name, customer_email, is_refund,
  'credit' AS balance_impact
FROM wal_l"""
    )
    Q["calendar_cols"] = _w("SELECT transaction_id, date, month, yearmon, yr FROM led")
    Q["account_clean"] = _w("SELECT split, regexp_replace(split, '^[0-9]+ ', '') AS account_clean, count(*) AS n FROM bkw GROUP BY split")
    Q["vendor_totals"] = _w("SELECT vendor, CAST(amount AS DOUBLE) AS amount FROM vend")
    Q["statement_display"] = _w(
        f"""SELECT statement_id, line_no, label AS account, {_fmt_money2('value')} AS amount,
  label IN {_in(S.KEY_ROWS)} AS is_key
FROM stm WHERE value IS NOT NULL OR label IN {_in(S.KEY_ROWS)}"""
    )
    Q["clean_amount"] = _w(
        """SELECT CASE gateway WHEN 'wallet_a' THEN 'wa-' ELSE 'wb-' END || k AS transaction_id,
  (CASE WHEN (CASE WHEN rf OR pr = '3-MEDIUM' THEN -amt ELSE amt END) < 0 THEN '-' ELSE '' END
   || CASE k % 3 WHEN 0 THEN '$' WHEN 1 THEN '$ ' ELSE '' END || format('{:,.2f}', amt)) AS gross_text,
  CAST(CASE WHEN rf OR pr = '3-MEDIUM' THEN -amt ELSE amt END AS DOUBLE) AS gross, CAST(fee AS DOUBLE) AS fee,
  CAST((CASE WHEN rf OR pr = '3-MEDIUM' THEN -amt ELSE amt END) - fee AS DOUBLE) AS net
FROM o2 WHERE gateway IN ('wallet_a', 'wallet_b')"""
    )
    Q["parse_dates"] = _w(
        "SELECT CASE gateway WHEN 'card' THEN 'c-' WHEN 'wallet_a' THEN 'wa-' WHEN 'wallet_b' THEN 'wb-' ELSE 'k-' END || k "
        "AS transaction_id, d AS date FROM o2"
    )

    # 2.3 filters
    Q["ledger_window"] = _w(f"SELECT {LEDGER_ALL} FROM led")
    Q["ledger_filtered"] = _w(f"SELECT {LEDGER_ALL} FROM led WHERE date {USER} AND source IN {src_sel}")
    Q["revenue"] = _w(f"SELECT {LEDGER_ALL} FROM v")
    Q["books_window"] = _w(f"SELECT {BOOK_COLS} FROM bkw")
    Q["cogs_entries"] = _w(f"SELECT {BOOK_COLS}, account_clean FROM cogs")
    Q["logistics_vendors"] = _w(
        f"SELECT vendor, CAST(amount AS DOUBLE) AS amount FROM vend "
        f"WHERE regexp_matches(vendor, {_q(B.LOGISTICS_PATTERN)}) AND amount > 0"
    )
    Q["logistics_table"] = _w(
        "SELECT vendor, '$' || format('{:,.2f}', amount) AS total_spent FROM vend "
        "WHERE regexp_matches(vendor, '(?i)ship|freight|ups|usps|fedex|dhl|auctane|dimerco|express|postal|carrier')"
    )
    Q["large_refunds"] = _w(
        f"""SELECT strftime(date, '%Y-%m-%d') AS date, source, CAST(abs(amount) AS DOUBLE) AS amount,
  customer_name AS customer, status, description
FROM led WHERE is_refund AND abs(amount) >= {P.large_refund_threshold}
  AND coalesce(upper(currency) IN ('USD', ''), false) AND date {USER} AND source IN {_in(P.sources)}"""
    )
    Q["outgoing"] = _w(
        f"""SELECT strftime(date, '%Y-%m-%d') AS date, source, status, type, CAST(amount AS DOUBLE) AS amount,
  CAST(fee AS DOUBLE) AS fee, CAST(net_amount AS DOUBLE) AS net, balance_impact, is_refund AS refund, description,
  customer_name AS customer, transaction_id AS txn_id
FROM led WHERE date {USER} AND (balance_impact = 'debit' OR is_refund OR amount < 0)"""
    )
    Q["export_outgoing"] = Q["outgoing"]
    Q["explore_filtered"] = _w(
        f"SELECT {EXPLORE_COLS} FROM lf WHERE amount >= {ex['amount_min']} AND amount <= {ex['amount_max']} "
        f"AND status IN {_in(ex['statuses'])}"
    )
    Q["month_window"] = _w(
        "SELECT month, CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(pp_refunds AS DOUBLE) AS pp_refunds, "
        "CAST(net_revenue AS DOUBLE) AS net_revenue, CAST(total_expenses AS DOUBLE) AS total_expenses, "
        "CAST(net_income AS DOUBLE) AS net_income FROM mpl_f"
    )
    Q["explore_page"] = _w(
        f"SELECT * FROM (SELECT {EXPLORE_COLS} FROM lf) t WHERE coalesce(contains(lower(status), 'comp'), false) "
        f"AND amount <= 3000 ORDER BY {EXPLORE_PAGE_ORDER} LIMIT 25 OFFSET 25"
    )

    # 2.4 joins
    Q["monthly_pl"] = Q["month_window"].replace("FROM mpl_f", "FROM mpl")
    Q["monthly_pl_no_books"] = _w(
        """SELECT month, CAST(pp_gross - coalesce(pp_refunds, 0) AS DOUBLE) AS gross_revenue,
  CAST(coalesce(pp_refunds, 0) AS DOUBLE) AS pp_refunds,
  CAST(pp_gross - coalesce(pp_refunds, 0) - pp_fees AS DOUBLE) AS net_revenue,
  CAST(NULL AS DOUBLE) AS total_expenses, CAST(NULL AS DOUBLE) AS net_income
FROM ppm LEFT JOIN ppr USING (month)"""
    )
    Q["source_semi"] = _w(f"SELECT {LEDGER_ALL} FROM led WHERE source IN ('wallet_a', 'wallet_b')")

    # 2.5 aggregations
    Q["failure_histogram"] = _w("SELECT month, status, n FROM fails")
    Q["monthly_revenue"] = _w(
        f"""SELECT month, source, {_dbl(GROSS, 'gross')}, {_dbl(REFUNDS, 'refunds')},
  {_dbl("coalesce(sum(CASE WHEN is_refund THEN -abs(amount) ELSE greatest(amount, 0) END), 0)", 'net')},
  count(*) AS tx_count
FROM v GROUP BY month, source"""
    )
    Q["monthly_sales_fees"] = _w(
        f"SELECT month, {_dbl('sum(amount)', 'pp_gross')}, {_dbl('sum(coalesce(fee, 0))', 'pp_fees')} FROM v WHERE {SALE} GROUP BY month"
    )
    Q["monthly_refunds"] = _w(f"SELECT month, {_dbl('sum(abs(amount))', 'pp_refunds')} FROM v WHERE is_refund GROUP BY month")
    Q["books_monthly"] = _w(
        "SELECT month, CAST(qb_revenue AS DOUBLE) AS qb_revenue, CAST(qb_expenses AS DOUBLE) AS qb_expenses, "
        "CAST(qb_revenue - qb_expenses AS DOUBLE) AS qb_net FROM bm"
    )
    Q["books_monthly_window"] = _w(
        "SELECT month, CAST(qb_revenue AS DOUBLE) AS qb_revenue, CAST(qb_expenses AS DOUBLE) AS qb_expenses, "
        f"CAST(qb_revenue - qb_expenses AS DOUBLE) AS qb_net FROM bm WHERE month {USER}"
    )
    Q["cogs_by_supplier_account"] = _w(
        f"SELECT name, split, {_dbl('sum(amount)', 'total')}, count(*) AS n_orders FROM cogs GROUP BY name, split "
        "HAVING name IS NOT NULL AND name <> ''"
    )
    Q["cogs_by_supplier"] = _w(
        f"SELECT name, {_dbl('sum(amount)', 'total')}, count(*) AS n_orders FROM cogs_f GROUP BY name "
        "HAVING name IS NOT NULL AND name <> ''"
    )
    Q["cogs_monthly"] = _w(f"SELECT month, account_clean, {_dbl('sum(amount)', 'total')} FROM cogs_f GROUP BY month, account_clean")
    Q["cogs_detail"] = _w(
        "SELECT strftime(date, '%Y-%m-%d') AS date, trans_type AS type, num AS po_num, name AS vendor, memo, "
        "account_clean AS account, CAST(amount AS DOUBLE) AS amount FROM cogs_f"
    )
    Q["yoy_monthly"] = _w(
        f"""SELECT month_num, CAST(prev AS DOUBLE) AS revenue_prev, CAST(cur AS DOUBLE) AS revenue_cur,
  CASE WHEN prev > 0 THEN {_pct('cur - prev', 'prev')} END AS yoy_pct
FROM (SELECT CAST(month(date) AS INTEGER) AS month_num,
  sum(CASE WHEN yr = {P.yoy_prev_year} THEN amount END) AS prev,
  sum(CASE WHEN yr = {P.yoy_year} THEN amount END) AS cur
  FROM vf WHERE {SALE} GROUP BY 1)"""
    )
    Q["q1_yoy"] = _with(RATES.strip()) + "SELECT year, q1_revenue, prev_q1_revenue, q1_yoy_pct FROM q1y"
    Q["kpi_overview"] = _with(KPI_VOL.strip()) + "SELECT * FROM kov"
    Q["monthly_trend"] = _w(
        f"SELECT month, {_dbl(GROSS, 'gross')}, {_dbl(REFUNDS, 'refunds')}, {_dbl(GROSS + ' - ' + REFUNDS, 'net')} FROM vf GROUP BY month"
    )
    Q["source_share"] = _w(
        "SELECT source, CAST(t AS DOUBLE) AS total, CAST(t AS DOUBLE) / CAST(sum(t) OVER () AS DOUBLE) AS share "
        f"FROM (SELECT source, sum(amount) AS t FROM vf WHERE {SALE} GROUP BY source)"
    )
    Q["net_month_source"] = _w(f"SELECT month, source, {_dbl(GROSS + ' - ' + REFUNDS, 'net')} FROM vf GROUP BY month, source")
    Q["refunds_month_source"] = _w(
        f"SELECT month, source, {_dbl('sum(abs(amount))', 'total')} FROM vf WHERE is_refund GROUP BY month, source"
    )
    Q["refunds_by_source"] = _w(
        f"""SELECT source, {_dbl('sum(abs(amount))', 'total')}, count(*) AS n,
  CAST(count(*) AS VARCHAR) || ' refund' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS label
FROM vf WHERE is_refund GROUP BY source"""
    )
    Q["net_reconciliation"] = _w(
        f"""SELECT source, {_dbl(GROSS, 'sales')}, {_dbl(REFUNDS, 'refunds')}, {_dbl('coalesce(sum(coalesce(fee, 0)), 0)', 'fees')},
  {_dbl(GROSS + ' - ' + REFUNDS + ' - coalesce(sum(coalesce(fee, 0)), 0)', 'net')}
FROM vf GROUP BY source"""
    )
    Q["kpi_volume"] = _with(KPI_VOL.strip()) + "SELECT * FROM kvol"
    Q["count_month_source"] = _w("SELECT month, source, count(*) AS n FROM vf WHERE NOT is_refund GROUP BY month, source")
    Q["avg_by_source"] = _w(
        f"SELECT source, CAST(sum(amount) AS DOUBLE) / count(*) AS avg_value, count(*) AS n FROM vf WHERE {SALE} GROUP BY source"
    )
    Q["failures_window"] = _w(
        f"SELECT month, status, n FROM fails WHERE month IS NOT NULL AND month {USER}"
        + ("" if P.failure_gateway in P.sources else " AND false")
    )
    Q["kpi_pl"] = _with(STMT_CTES, PL_KPI.strip()) + (
        """SELECT CAST(CASE WHEN n_months > 0 THEN rev_sum ELSE st_rev END AS DOUBLE) AS revenue,
  CAST(CASE WHEN n_cogs > 0 THEN cogs_sum ELSE abs(coalesce(st_cogs, 0)) END AS DOUBLE) AS cogs,
  CAST(rev_sum - cogs_sum AS DOUBLE) AS profit,
  CAST(CASE WHEN n_months > 0 THEN net_sum ELSE st_net END AS DOUBLE) AS net_income
FROM pla, plc, plm"""
    )
    Q["kpi_cogs"] = _with(STMT_CTES, PL_KPI.strip()) + (
        """SELECT CAST(CASE WHEN n_cogs > 0 THEN prod ELSE st_prod END AS DOUBLE) AS product_cogs,
  CAST(CASE WHEN n_cogs > 0 THEN ship ELSE st_ship END AS DOUBLE) AS shipping_cost,
  CAST(st_fees AS DOUBLE) AS processing_fees,
  CAST(CASE WHEN n_cogs > 0 THEN cogs_sum ELSE st_tot END AS DOUBLE) AS total_cogs
FROM plc, plk"""
    )
    Q["refund_rates"] = _with(RATES.strip()) + (
        "SELECT source, rev, refunds, rate, CASE WHEN rate > 8 THEN 'danger' WHEN rate > 5 THEN 'warning' ELSE 'ok' END AS grade FROM rates"
    )
    Q["refund_rate_chart"] = _with(RATES.strip()) + (
        "SELECT source, rev, refunds, rate, CASE WHEN rate > 8 THEN 'danger' WHEN rate > 5 THEN 'warning' ELSE 'ok' END AS grade "
        "FROM rates WHERE rev > 0"
    )
    Q["kpi_alerts"] = _with(STMT_CTES, PL_KPI.strip(), RATES.strip()) + (
        f"""SELECT CAST(CASE WHEN n_months > 0 THEN net_sum ELSE st_net END AS DOUBLE) AS net_income,
  CASE WHEN (CASE WHEN n_months > 0 THEN rev_sum ELSE st_rev END) > 0
       THEN {_pct('CASE WHEN n_cogs > 0 THEN cogs_sum ELSE abs(st_cogs) END', 'CASE WHEN n_months > 0 THEN rev_sum ELSE st_rev END')}
  END AS cogs_pct,
  coalesce((SELECT rate FROM rates WHERE source = {_q(P.alert_gateway)}), 0.0) AS alert_refund_rate,
  (SELECT q1_yoy_pct FROM q1y WHERE year = {P.yoy_year}) AS q1_yoy_pct
FROM pla, plc, plm"""
    )
    Q["gateway_growth"] = _w(
        f"SELECT month, {_dbl('sum(amount)', 'revenue')}, count(*) AS n FROM vf "
        f"WHERE source = {_q(P.growth_gateway)} AND {SALE} GROUP BY month"
    )
    Q["distinct_status"] = _w("SELECT DISTINCT status FROM led WHERE status IS NOT NULL")

    # 2.6 statements
    Q["statement_metrics"] = _w(
        "SELECT statement_id, " + ", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in S.METRIC_PATTERNS)
        + ", CAST(abs(coalesce(total_expenses, 0)) AS DOUBLE) AS expenses_kpi FROM sm",
        stmt=True,
    )
    Q["cost_metrics"] = _w(
        "SELECT statement_id, "
        + ", ".join(
            f"CAST({k} AS DOUBLE) AS {k}"
            for k in ("product_cogs", "shipping_cost", "processing_fees_total", "total_cogs", "packaging", "commissions", "warranty")
        )
        + " FROM cost",
        stmt=True,
    )
    Q["cogs_breakdown"] = _w(
        f"""SELECT statement_id, line_no, label, CAST(value AS DOUBLE) AS value,
  regexp_replace(label, '^[0-9]+ ', '') AS label_clean
FROM stm WHERE regexp_matches(label, {_q(S.COGS_LINE_PATTERN)}) AND value IS NOT NULL
  AND NOT regexp_matches(label, '^Total for')"""
    )
    Q["processing_fees"] = _w(
        f"""SELECT statement_id, line_no, label, regexp_replace(label, '^[0-9]+ ', '') AS label_clean,
  CAST(value AS DOUBLE) AS value,
  CAST(value AS DOUBLE) / CAST(sum(value) OVER (PARTITION BY statement_id) AS DOUBLE) AS share
FROM stm WHERE label IN {_in(S.FEE_LABELS)} AND value IS NOT NULL"""
    )
    Q["waterfall"] = _w("SELECT statement_id, step, label, CAST(value AS DOUBLE) AS value, measure FROM wf", stmt=True)
    Q["waterfall_levels"] = _w(
        """SELECT statement_id, step, label, measure, CAST(value AS DOUBLE) AS value, CAST(lvl AS DOUBLE) AS level,
  CAST(CASE WHEN measure = 'total' THEN value - lvl END AS DOUBLE) AS residual
FROM (SELECT *, sum(CASE WHEN measure <> 'total' THEN value ELSE 0 END)
  OVER (PARTITION BY statement_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lvl FROM wf)""",
        stmt=True,
    )

    # 2.7 windows
    mom = f"""ms AS (SELECT {{keys}}month, sum(amount) AS revenue FROM vf WHERE {SALE} GROUP BY {{keys}}month),
mw AS (SELECT {{keys}}month, revenue, lag(revenue) OVER (w) AS prev,
  CASE WHEN count(revenue) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
       THEN CAST(sum(revenue) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) / 3.0 END AS roll3
  FROM ms WINDOW w AS ({{part}}ORDER BY month))"""
    sel = "SELECT {keys}month, CAST(revenue AS DOUBLE) AS revenue, CAST(prev AS DOUBLE) AS prev_revenue, " + (
        _pct("revenue - prev", "prev") + " AS mom_pct, roll3 FROM mw WHERE prev IS NOT NULL AND prev <> 0"
    )
    Q["mom_change"] = _with(mom.format(keys="", part="")) + sel.format(keys="")
    Q["mom_change_by_source"] = _with(mom.format(keys="source, ", part="PARTITION BY source ")) + sel.format(keys="source, ")
    Q["rolling3"] = _with(mom.format(keys="", part="")) + "SELECT month, CAST(revenue AS DOUBLE) AS revenue, roll3 FROM mw"

    # 2.8 top-k
    Q["top_vendors"] = _w(
        f"SELECT vendor, CAST(amount AS DOUBLE) AS amount FROM vend ORDER BY amount DESC, vendor LIMIT {P.top_vendors}"
    )
    Q["top_vendors_table"] = _w(
        "SELECT vendor, '$' || format('{:,.2f}', amount) AS total_spent FROM vend "
        f"ORDER BY amount DESC, vendor LIMIT {P.top_vendors_table}"
    )

    # 2.9 set operations
    Q["ledger_union"] = _w(f"SELECT {LEDGER_COLS} FROM uni")
    Q["sources_available"] = _w(
        f"SELECT source FROM (SELECT unnest({'[' + ', '.join(_q(g) for g in GATEWAYS) + ']'}) AS source) "
        "INTERSECT SELECT source FROM led"
    )

    # 2.10 text forms
    Q["fmt_kpis"] = _with(KPI_VOL.strip()) + (
        f"""SELECT {_fmt_currency('gross')} AS gross_text, {_fmt_currency('refunds')} AS refunds_text,
  {_fmt_currency('net')} AS net_text, format('{{:,}}', total_txn) AS total_txn_text,
  format('{{:,}}', failed_txn) AS failed_txn_text, regexp_replace(CAST(failure_rate AS VARCHAR), '\\.0$', '') || '%' AS failure_rate_text,
  {_fmt_currency('avg_value')} AS avg_value_text
FROM kov, kvol"""
    )
    Q["cache_failures"] = Q["failure_histogram"]
    return Q
