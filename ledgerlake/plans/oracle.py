"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on DuckDB over the driver's parquet views and must return the
same columns and values as the Spark query of the same name. They restate the
derived ledgers as CTEs and use the same numeric conventions: decimal sums cast
to double, averages as sum/count, rounding through ``DECIMAL(28,8)``.
"""

from __future__ import annotations


def R(x: str, scale: int = 2) -> str:
    """Round a double the way ``functions.exprs.round_dec`` does: integer part split off, fraction rounded."""
    return f"(trunc(({x})) + CAST(ROUND(CAST((({x}) - trunc(({x}))) AS DECIMAL(28,8)), {scale}) AS DOUBLE))"


ORDERS_INCOME_SQL = "('1-URGENT', '2-HIGH', '3-MEDIUM')"
BRAND_INCOME_SQL = "(" + ", ".join(f"'Brand#{i}'" for i in range(1, 16)) + ")"

L1 = f"""l1 AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
         CAST(o_orderdate AS DATE) AS transaction_date,
         o_orderdate AS transaction_datetime,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         strftime(o_orderdate, '%Y-%m') AS year_month,
         o_orderpriority AS category,
         CASE WHEN o_orderpriority IN {ORDERS_INCOME_SQL} THEN 'Income' ELSE 'Expense' END AS type,
         o_orderstatus AS account,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         'USD' AS currency,
         CAST(NULL AS VARCHAR) AS tags,
         'orders' AS source,
         o_custkey AS entity_id
  FROM orders)"""

L2 = f"""l2 AS (
  SELECT CAST(l_shipdate AS DATE) AS transaction_date,
         l_shipdate AS transaction_datetime,
         strftime(l_shipdate, '%Y-%m') AS year_month,
         p_brand AS category,
         CASE WHEN p_brand IN {BRAND_INCOME_SQL} THEN 'Income' ELSE 'Expense' END AS type,
         l_returnflag AS account,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         l_linestatus AS tags,
         l_suppkey AS entity_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

L3 = """l3 AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
         CAST(ts AS DATE) AS transaction_date,
         ts AS transaction_datetime,
         strftime(ts, '%Y-%m') AS year_month,
         event_type AS category,
         CASE WHEN event_type IN ('purchase') THEN 'Income' ELSE 'Expense' END AS type,
         CAST(user_id AS VARCHAR) AS account,
         CAST(value AS DECIMAL(18,2)) AS amount,
         user_id AS entity_id
  FROM events)"""

INC = "CASE WHEN type = 'Income' THEN amount ELSE 0 END"
EXP = "CASE WHEN type = 'Expense' THEN amount ELSE 0 END"
SGN = "CASE WHEN type = 'Income' THEN amount ELSE -amount END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def monthly_sql(src: str, where: str = "", by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""SELECT {b}year_month,
       CAST(SUM({INC}) AS DOUBLE) AS total_income,
       CAST(SUM({EXP}) AS DOUBLE) AS total_expense,
       CAST(SUM({SGN}) AS DOUBLE) AS net,
       COUNT(*) AS transaction_count
FROM {src} {where}
GROUP BY {b}year_month"""


def monthly_with_rate(src: str, where: str = "", by: str = "") -> str:
    return f"""SELECT *, CASE WHEN total_income > 0 THEN {R('net / total_income * 100.0')} END AS savings_rate_pct
FROM ({monthly_sql(src, where, by)}) m"""


FILTER_A = "WHERE year_month >= '1996-01' AND year_month <= '1998-12' AND account IN ('F', 'O')"
FILTER_B = "WHERE year_month >= '1997-01' AND year_month <= '1999-06' AND account IN ('A', 'R')"


def category_sql(src: str, where: str = "", by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""SELECT {b}category, type,
       CAST(SUM(amount) AS DOUBLE) AS total_amount,
       COUNT(*) AS transaction_count,
       CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg_amount
FROM {src} {where}
GROUP BY {b}category, type"""


def top_sql(src: str, n: int, type_: str, where: str = "", by: str = "") -> str:
    cond = f"type = '{type_}'" + (f" AND {where[len('WHERE '):]}" if where else "")
    if by:
        return f"""SELECT {by}, category, CAST(SUM(amount) AS DOUBLE) AS total_amount, COUNT(*) AS transaction_count
FROM {src} WHERE {cond}
GROUP BY {by}, category
QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY total_amount DESC, category ASC) <= {n}"""
    return f"""SELECT category, CAST(SUM(amount) AS DOUBLE) AS total_amount, COUNT(*) AS transaction_count
FROM {src} WHERE {cond}
GROUP BY category ORDER BY total_amount DESC, category ASC LIMIT {n}"""


def account_sql(src: str, where: str = "", by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""SELECT {b}account,
       CAST(SUM({EXP}) AS DOUBLE) AS total_expense,
       CAST(SUM({INC}) AS DOUBLE) AS total_income,
       COUNT(*) AS transaction_count
FROM {src} {where}
GROUP BY {b}account"""


def kpi_sql(src: str, where: str = "", by: str = "") -> str:
    g = f"GROUP BY {by}" if by else ""
    b = f"{by}, " if by else ""
    return f"""SELECT {b}total_income, total_expense, net,
       CASE WHEN total_income > 0 THEN {R('net / total_income * 100.0')} END AS savings_rate_pct,
       transaction_count, months_covered
FROM (SELECT {b}CAST(SUM({INC}) AS DOUBLE) AS total_income,
             CAST(SUM({EXP}) AS DOUBLE) AS total_expense,
             CAST(SUM({SGN}) AS DOUBLE) AS net,
             COUNT(*) AS transaction_count,
             COUNT(DISTINCT year_month) AS months_covered
      FROM {src} {where} {g}) k"""


SQL: dict[str, str] = {}

SQL["monthly_summary"] = with_(L1) + monthly_with_rate("l1")
SQL["monthly_summary_filtered"] = with_(L1) + monthly_with_rate("l1", FILTER_A)
SQL["monthly_summary_by_entity"] = with_(L1) + monthly_with_rate("l1", by="entity_id")
SQL["savings_rate"] = with_(L2) + f"""SELECT year_month, savings_rate_pct FROM ({monthly_with_rate('l2')}) s"""
SQL["category_breakdown"] = with_(L1) + category_sql("l1")
SQL["category_breakdown_month"] = with_(L2) + category_sql("l2", "WHERE year_month = '1997-06' AND type = 'Expense'")
SQL["category_breakdown_filtered"] = with_(L2) + category_sql("l2", FILTER_B)
SQL["top_categories"] = with_(L2) + top_sql("l2", 5, "Expense")
SQL["top_categories_filtered"] = with_(L2) + top_sql("l2", 3, "Income", FILTER_B)
SQL["top_categories_by_entity"] = with_(L2) + top_sql("l2", 3, "Expense", by="entity_id")
SQL["account_breakdown"] = with_(L1) + account_sql("l1")
SQL["account_breakdown_filtered"] = with_(L2) + account_sql("l2", FILTER_B)
SQL["date_range"] = with_(L1) + "SELECT MIN(transaction_date) AS min_date, MAX(transaction_date) AS max_date, COUNT(*) AS row_count FROM l1"
SQL["type_totals"] = with_(L2) + "SELECT type, CAST(SUM(amount) AS DOUBLE) AS total_amount, COUNT(*) AS n FROM l2 GROUP BY type"
SQL["filter_values"] = with_(L1) + """SELECT DISTINCT 'year_month' AS field, year_month AS value FROM l1
UNION SELECT DISTINCT 'account', account FROM l1
UNION SELECT DISTINCT 'category', category FROM l1"""
SQL["filtered_transactions"] = with_(L1) + f"""SELECT transaction_id, transaction_date, year, month, year_month, category, type,
       account, CAST(amount AS DOUBLE) AS amount, currency, source
FROM l1 {FILTER_A}
ORDER BY transaction_date DESC, transaction_id ASC LIMIT 500"""
SQL["kpi_totals"] = with_(L1) + kpi_sql("l1")
SQL["kpi_totals_by_entity"] = with_(L2) + kpi_sql("l2", by="entity_id")
SQL["recent_12_months"] = with_(L1) + f"""SELECT * FROM ({monthly_with_rate('l1')}) m ORDER BY year_month DESC LIMIT 12"""


def monthly_dec(src: str, where: str = "", by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""SELECT {b}year_month, SUM({INC}) AS inc, SUM({EXP}) AS exp
FROM {src} {where} GROUP BY {b}year_month"""


def pct_sql(cur: str, prev: str) -> str:
    return R(f"100.0 * ({cur} - {prev}) / NULLIF({prev}, 0)")


def trends_sql(src: str, where: str = "", by: str = "", rolling=(3,), running: bool = False) -> str:
    part = f"PARTITION BY {by} " if by else ""
    b = f"{by}, " if by else ""
    w = f"({part}ORDER BY year_month)"
    cols = [
        f"{b}year_month",
        "CAST(inc AS DOUBLE) AS total_income",
        "CAST(exp AS DOUBLE) AS total_expense",
        "CAST(inc - exp AS DOUBLE) AS net",
        pct_sql("CAST(exp AS DOUBLE)", f"LAG(CAST(exp AS DOUBLE)) OVER {w}") + " AS expense_mom_change_pct",
        pct_sql("CAST(inc AS DOUBLE)", f"LAG(CAST(inc AS DOUBLE)) OVER {w}") + " AS income_mom_change_pct",
    ]
    for k in rolling:
        f = f"({part}ORDER BY year_month ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        cols.append(R(f"CAST(SUM(exp) OVER {f} AS DOUBLE) / COUNT(*) OVER {f}") + f" AS expense_{k}mo_avg")
    if running:
        f = f"({part}ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        cols += [f"CAST(SUM(inc) OVER {f} AS DOUBLE) AS running_income",
                 f"CAST(SUM(exp) OVER {f} AS DOUBLE) AS running_expense",
                 f"CAST(SUM(inc - exp) OVER {f} AS DOUBLE) AS running_net"]
    return f"SELECT {', '.join(cols)} FROM ({monthly_dec(src, where, by)}) m"


def std_samp_sql(n: str, s1: str, s2: str) -> str:
    return f"sqrt(CAST({n} * {s2} - {s1} * {s1} AS DOUBLE) / NULLIF({n} * ({n} - 1), 0))"


def std_pop_sql(n: str, s1: str, s2: str) -> str:
    return f"sqrt(CAST({n} * {s2} - {s1} * {s1} AS DOUBLE) / NULLIF({n} * {n}, 0))"


def anomalies_sql(src: str, thr: float = 2.0, by: str = "", more: str = "") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {b}category"
    return f"""SELECT {b}category, year_month, {R('CAST(t AS DOUBLE)')} AS month_total, {R('mean')} AS category_mean,
       {R('std')} AS category_std, {R('(CAST(t AS DOUBLE) - mean) / std')} AS z_score{more}
FROM (SELECT *, CAST(SUM(t) OVER w AS DOUBLE) / COUNT(*) OVER w AS mean,
             {std_samp_sql('COUNT(*) OVER w', 'SUM(t) OVER w', 'SUM(CAST(t AS DECIMAL(19,2)) * CAST(t AS DECIMAL(19,2))) OVER w')} AS std
      FROM (SELECT {b}category, year_month, SUM(amount) AS t FROM {src} WHERE type = 'Expense'
            GROUP BY {b}category, year_month) cm
      WINDOW w AS ({part})) s
WHERE std IS NOT NULL AND std > 0 AND abs((CAST(t AS DOUBLE) - mean) / std) >= {thr}"""


SQL["monthly_trends"] = with_(L1) + trends_sql("l1")
SQL["monthly_trends_filtered"] = with_(L1) + trends_sql("l1", FILTER_A)
SQL["monthly_trends_by_entity"] = with_(L2) + trends_sql("l2", by="entity_id")
SQL["rolling_avg_n"] = with_(L2) + trends_sql("l2", rolling=(3, 6, 12))
SQL["running_totals"] = with_(L1) + trends_sql("l1", FILTER_A, rolling=(), running=True)
SQL["anomalies"] = with_(L1) + anomalies_sql("l1")
SQL["anomalies_by_entity"] = with_(L2) + anomalies_sql("l2", 2.0, by="entity_id")
SQL["category_share"] = with_(L2) + f"""SELECT category, CAST(t AS DOUBLE) AS total_amount,
       {R('CAST(t AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(t) OVER () AS DOUBLE), 0)')} AS share_pct
FROM (SELECT category, SUM(amount) AS t FROM l2 WHERE type = 'Expense' GROUP BY category) g"""
SQL["yearly_trends"] = with_(L1) + f"""SELECT year, CAST(inc AS DOUBLE) AS total_income, CAST(exp AS DOUBLE) AS total_expense,
       CAST(inc - exp AS DOUBLE) AS net, transaction_count,
       {pct_sql('CAST(exp AS DOUBLE)', 'LAG(CAST(exp AS DOUBLE)) OVER (ORDER BY year)')} AS expense_yoy_change_pct
FROM (SELECT year, SUM({INC}) AS inc, SUM({EXP}) AS exp, COUNT(*) AS transaction_count FROM l1 GROUP BY year) y"""


def health_sql(src: str, by: str = "", snapshot: bool = False) -> str:
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    jk = f"USING ({by})" if by else "ON TRUE"

    def stab(s1, s2):
        mean = f"(CAST({s1} AS DOUBLE) / NULLIF(n_months, 0))"
        std = f"(CASE WHEN n_months > 1 THEN {std_pop_sql('n_months', s1, s2)} ELSE 0.0 END)"
        cv = f"COALESCE(CASE WHEN {mean} <> 0 THEN {std} / {mean} END, 0.0)"
        return f"LEAST(GREATEST(100.0 - {cv} * 100.0, 0.0), 100.0)"

    has = "(n_exp_cats > 0 AND CAST(t1 AS DOUBLE) > 0)"
    hhi = f"(CASE WHEN {has} THEN CAST(t2 AS DOUBLE) / (CAST(t1 AS DOUBLE) * CAST(t1 AS DOUBLE)) END)"
    rate = "(CASE WHEN CAST(s_inc AS DOUBLE) > 0 THEN CAST(s_net AS DOUBLE) / CAST(s_inc AS DOUBLE) * 100.0 ELSE 0.0 END)"
    subs = {
        "savings_score": f"LEAST(GREATEST({rate} / 50.0 * 100.0, 0.0), 100.0)",
        "expense_stability_score": stab("s_exp", "s2_exp"),
        "income_stability_score": stab("s_inc", "s2_inc"),
        "diversification_score": f"(CASE WHEN {has} THEN LEAST(GREATEST((1.0 - {hhi}) * 100.0, 0.0), 100.0) ELSE 0.0 END)",
    }
    if snapshot:
        subs = {k: R(v, 1) for k, v in subs.items()}
    comp = "0.4 * savings_score + 0.25 * expense_stability_score + 0.15 * income_stability_score + 0.2 * diversification_score"
    return f"""SELECT {b}total_income, total_expense, net, overall_savings_rate_pct,
       savings_score, expense_stability_score, income_stability_score, diversification_score,
       {R('comp', 1) if snapshot else 'comp'} AS composite_score,
       CASE WHEN comp >= 75 THEN 'Healthy' WHEN comp >= 50 THEN 'Fair' ELSE 'At Risk' END AS band,
       {R('hhi', 3)} AS category_hhi
FROM (SELECT *, {comp} AS comp FROM (
  SELECT {b}CAST(s_inc AS DOUBLE) AS total_income, CAST(s_exp AS DOUBLE) AS total_expense,
         CAST(s_net AS DOUBLE) AS net, {R(rate)} AS overall_savings_rate_pct, {hhi} AS hhi,
         {', '.join(f'{v} AS {k}' for k, v in subs.items())}
  FROM (SELECT {b}SUM(inc) AS s_inc, SUM(exp) AS s_exp, SUM(net) AS s_net, COUNT(*) AS n_months,
               SUM(CAST(inc AS DECIMAL(19,2)) * CAST(inc AS DECIMAL(19,2))) AS s2_inc,
               SUM(CAST(exp AS DECIMAL(19,2)) * CAST(exp AS DECIMAL(19,2))) AS s2_exp
        FROM (SELECT {b}year_month, SUM({INC}) AS inc, SUM({EXP}) AS exp, SUM({SGN}) AS net
              FROM {src} GROUP BY {b}year_month) m {g}) mm
  LEFT JOIN (SELECT {b}SUM(t) AS t1, SUM(CAST(t AS DECIMAL(19,2)) * CAST(t AS DECIMAL(19,2))) AS t2, COUNT(*) AS n_exp_cats
             FROM (SELECT {b}category, SUM(amount) AS t FROM {src} WHERE type = 'Expense' GROUP BY {b}category) c {g}) cc
  {jk}) x) y"""


PLANS = """plans AS (
  SELECT entity_id, category, CAST(ROUND(CAST(lim AS DECIMAL(28,8)), 2) AS DOUBLE) AS monthly_limit
  FROM (SELECT c_custkey AS entity_id, '4-NOT SPECIFIED' AS category, abs(c_acctbal) AS lim FROM customer
        UNION ALL SELECT c_custkey, '4-NOT SPECIFIED', abs(c_acctbal) / 2 FROM customer
        UNION ALL SELECT c_custkey, '5-LOW', abs(c_acctbal) * 3 FROM customer
        UNION ALL SELECT c_custkey, '0-SAVINGS', 100.0 FROM customer) p)"""


def budget_cmp_sql(src: str, by: str = "", where: str = "") -> str:
    b = f"{by}, " if by else ""
    j = f"USING ({by}, category)" if by else "USING (category)"
    cond = "type = 'Expense'" + (f" AND {where[len('WHERE '):]}" if where else "")
    return f"""SELECT {b}category, monthly_limit, COALESCE(a, 0) AS act,
       COALESCE(a, 0) - CAST(monthly_limit AS DECIMAL(28,8)) AS over
FROM (SELECT {b}category, MAX(monthly_limit) AS monthly_limit FROM plans GROUP BY {b}category) l
LEFT JOIN (SELECT {b}category, SUM(amount) AS a FROM {src} WHERE {cond} GROUP BY {b}category) x {j}"""


def budget_status_sql(src: str, by: str = "", where: str = "") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {b}category, {R('monthly_limit')} AS monthly_limit, {R('CAST(act AS DOUBLE)')} AS actual,
       {R('CAST(over AS DOUBLE)')} AS over_under, over > 0 AS is_over,
       CASE WHEN over > 0 THEN CAST(row_number() OVER ({part}ORDER BY over DESC, category ASC) AS INTEGER) END AS over_rank
FROM ({budget_cmp_sql(src, by, where)}) c"""


def over_total_sql(src: str, by: str = "", where: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""SELECT {b}{R('COALESCE(CAST(SUM(CASE WHEN over > 0 THEN over END) AS DOUBLE), 0.0)')} AS total_over_budget_amount,
       COUNT(CASE WHEN over > 0 THEN over END) AS n_over_budget, COUNT(*) AS n_planned
FROM ({budget_cmp_sql(src, by, where)}) c {g}"""


SQL["health_score"] = with_(L1) + health_sql("l1")
SQL["health_score_snapshot"] = with_(L1) + health_sql("l1", snapshot=True)
SQL["health_score_by_entity"] = with_(L1) + health_sql("l1", by="entity_id", snapshot=True)
SQL["health_score_display_by_entity"] = with_(L2) + health_sql("l2", by="entity_id")
SQL["budget_status"] = with_(L1, PLANS) + budget_status_sql("l1", where=FILTER_A)
SQL["budget_status_by_entity"] = with_(L1, PLANS) + budget_status_sql("l1", by="entity_id")
SQL["over_budget_total"] = with_(L1, PLANS) + over_total_sql("l1", by="entity_id")


POW_BITS = 11


def with_powers_sql(inner: str, base: str, prefix: str = "g") -> str:
    """Wrap ``inner`` adding prefix0..prefix10 = base^(2^i), one nesting level per step."""
    q = f"SELECT *, {base} AS {prefix}0 FROM ({inner}) p0"
    for i in range(1, POW_BITS):
        q = f"SELECT *, {prefix}{i - 1} * {prefix}{i - 1} AS {prefix}{i} FROM ({q}) p{i}"
    return q


def int_pow_sql(m: str, prefix: str = "g") -> str:
    acc = "1.0"
    for i in range(POW_BITS):
        acc = f"({acc} * CASE WHEN ((CAST({m} AS BIGINT) >> {i}) & 1) = 1 THEN {prefix}{i} ELSE 1.0 END)"
    return acc


def _dbl(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def scenario_values(scenarios) -> str:
    rows = []
    for i, s in enumerate(scenarios):
        rows.append(f"({i}, '{s.name}', '{s.kind}', {_dbl(s.pct)}, {_dbl(s.amount)}, {_dbl(s.annual_return_pct)}, {int(s.months_forward)})")
    return "sc(scenario_id, scenario, kind, pct, amount, annual_return_pct, months_forward) AS (VALUES " + ", ".join(rows) + ")"


def keyword_match(scenarios) -> str:
    arms = []
    for i, s in enumerate(scenarios):
        if s.kind == "reduce_category" and s.keywords:
            cond = " OR ".join(f"contains(lower(category), '{k.lower()}')" for k in s.keywords)
            arms.append(f"(k.scenario_id = {i} AND ({cond}))")
    return " OR ".join(arms) if arms else "FALSE"


def whatif_sql(src: str, scenarios, by: str = "entity_id") -> str:
    r = "(pow(1.0 + annual_return_pct / 100.0, CAST(1.0 AS DOUBLE) / CAST(12.0 AS DOUBLE)) - 1.0)"
    inc = "(CAST(s_inc AS DOUBLE) / GREATEST(n_months, 1))"
    exp = "(CAST(s_exp AS DOUBLE) / GREATEST(n_months, 1))"
    net = f"({inc} - {exp})"
    adj_inc = f"(CASE WHEN kind = 'increase_income' THEN {inc} * (1.0 + pct / 100.0) ELSE {inc} END)"
    adj_exp = (f"(CASE WHEN kind = 'reduce_category' AND pick_t IS NOT NULL THEN {exp} - CAST(pick_t AS DOUBLE) / GREATEST(n_months, 1) * (pct / 100.0)"
               f" WHEN kind = 'increase_savings' AND {exp} > 0 THEN {exp} * GREATEST(0.0, ({exp} - amount) / {exp}) ELSE {exp} END)")
    adj_net = f"(CASE WHEN kind = 'increase_investment' THEN {net} - amount ELSE {adj_inc} - {adj_exp} END)"
    fv = f"(CASE WHEN {r} = 0 THEN amount * months_forward ELSE amount * ({int_pow_sql('months_forward')} - 1.0) / {r} END)"
    inv = "kind = 'increase_investment'"
    return f"""{with_(L1 if src == 'l1' else L2, scenario_values(scenarios))}
, base AS (SELECT {by}, SUM({INC}) AS s_inc, SUM({EXP}) AS s_exp, COUNT(CASE WHEN type = 'Expense' THEN 1 END) AS n_exp_rows,
                  COUNT(DISTINCT year_month) AS n_months FROM {src} GROUP BY {by})
, cats AS (SELECT {by}, category, SUM(amount) AS t FROM {src} WHERE type = 'Expense' GROUP BY {by}, category)
, picks AS (SELECT {by}, k.scenario_id, category AS target_category, t AS pick_t FROM cats CROSS JOIN sc k
            WHERE {keyword_match(scenarios)}
            QUALIFY row_number() OVER (PARTITION BY {by}, k.scenario_id ORDER BY t DESC, category ASC) = 1)
SELECT {by}, scenario_id, scenario, months_forward,
       CASE WHEN kind = 'reduce_category' THEN target_category END AS target_category,
       {R(inc)} AS baseline_monthly_income, {R(exp)} AS baseline_monthly_expense,
       {R(adj_inc)} AS adjusted_monthly_income, {R(adj_exp)} AS adjusted_monthly_expense,
       {R(net)} AS baseline_net_monthly, {R(adj_net)} AS adjusted_net_monthly,
       {R(f'{adj_net} - {net}')} AS net_monthly_change,
       {R(f'{net} * months_forward')} AS baseline_cumulative_net,
       {R(f"{adj_net} * months_forward - (CASE WHEN kind = 'one_time_expense' AND months_forward >= 1 THEN amount ELSE 0.0 END)")} AS adjusted_cumulative_net,
       CASE WHEN {inv} THEN {R(fv)} END AS future_value_after_months,
       CASE WHEN {inv} THEN {R('amount * months_forward')} END AS total_contributed,
       CASE WHEN {inv} THEN {R(f'{fv} - amount * months_forward')} END AS investment_growth
FROM ({with_powers_sql(f"SELECT * FROM base CROSS JOIN sc LEFT JOIN picks USING ({by}, scenario_id) WHERE n_exp_rows > 0", f"1.0 + {r}")}) q"""


FIRE_INPUTS = """inputs AS (
  SELECT entity_id,
         CAST(ROUND(CAST(CAST(s_inc AS DOUBLE) / GREATEST(n, 1) AS DECIMAL(28,8)), 2) AS DOUBLE) AS monthly_income,
         CAST(ROUND(CAST(CAST(s_exp AS DOUBLE) / GREATEST(n, 1) AS DECIMAL(28,8)), 2) AS DOUBLE) AS monthly_expense,
         CAST(0.0 AS DOUBLE) AS current_savings, CAST(7.0 AS DOUBLE) AS annual_return_pct,
         CAST(4.0 AS DOUBLE) AS withdrawal_rate_pct, 30 AS current_age, 50 AS target_age
  FROM (SELECT entity_id, SUM(CASE WHEN type = 'Income' THEN amount ELSE 0 END) AS s_inc,
               SUM(CASE WHEN type = 'Expense' THEN amount ELSE 0 END) AS s_exp, COUNT(DISTINCT year_month) AS n
        FROM l1 GROUP BY entity_id) a)"""


def fire_month_sql(rate: str, number: str) -> str:
    """Brute force: scan every month 0..M (the Spark side jumps to a closed-form candidate)."""
    r = f"(pow(1.0 + ({rate}) / 100.0, CAST(1.0 AS DOUBLE) / CAST(12.0 AS DOUBLE)) - 1.0)"
    c = "GREATEST(monthly_income - monthly_expense, 0.0)"
    gm = int_pow_sql("m")
    bal = f"(CASE WHEN {r} = 0 THEN current_savings + {c} * m ELSE current_savings * {gm} + {c} * ({gm} - 1.0) / {r} END)"
    return f"""(SELECT MIN(m) FROM (SELECT unnest(generate_series(0, (target_age - current_age) * 12)) AS m) mm
   WHERE ({number}) > 0 AND {bal} >= ({number}))"""


def age_cols_sql(month: str) -> str:
    return (f"{month} AS fire_month, {R(f'current_age + {month} / 12.0', 1)} AS fire_age, "
            f"{R(f'current_age + {month} / 12.0 - current_age', 1)} AS years_to_fire")


_RA = "(pow(1.0 + annual_return_pct / 100.0, CAST(1.0 AS DOUBLE) / CAST(12.0 AS DOUBLE)) - 1.0)"
_RR = "(pow(1.0 + rr / 100.0, CAST(1.0 AS DOUBLE) / CAST(12.0 AS DOUBLE)) - 1.0)"
SQL["fire_age"] = with_(L1, FIRE_INPUTS) + f"""SELECT entity_id, {R('monthly_expense * 12.0 * 25.0')} AS fire_number,
       {R('GREATEST(monthly_income - monthly_expense, 0.0)')} AS monthly_contribution, {age_cols_sql('fm')}
FROM (SELECT *, CAST({fire_month_sql('annual_return_pct', 'monthly_expense * 12.0 * 25.0')} AS INTEGER) AS fm
      FROM ({with_powers_sql('SELECT * FROM inputs', '1.0 + ' + _RA)}) i) x"""
# Month by month, as the loop of the planner.
SQL["fire_age_real"] = with_(L1, FIRE_INPUTS).replace("WITH ", "WITH RECURSIVE ", 1) + f""", plan AS (
  SELECT *, monthly_expense * 12.0 * 25.0 AS number, GREATEST(monthly_income - monthly_expense, 0.0) AS c,
         ((1.0 + annual_return_pct / 100.0) / (1.0 + CAST(2.5 AS DOUBLE) / 100.0) - 1.0) * 100.0 / 1200.0 AS r FROM inputs),
path(entity_id, m, bal) AS (
  SELECT entity_id, 0, current_savings FROM plan
  UNION ALL SELECT p.entity_id, p.m + 1, p.bal * (1.0 + q.r) + q.c FROM path p JOIN plan q USING (entity_id) WHERE p.m < (q.target_age - q.current_age) * 12),
hit AS (SELECT entity_id, CAST(MIN(m) AS INTEGER) AS fm FROM path JOIN plan USING (entity_id) WHERE number > 0 AND bal >= number GROUP BY entity_id)
SELECT entity_id, {R('number')} AS fire_number, {R('c')} AS monthly_contribution, {age_cols_sql('fm')}
FROM plan LEFT JOIN hit USING (entity_id)"""
SQL["fire_return_scenarios"] = with_(L1, FIRE_INPUTS) + f"""SELECT entity_id, scenario, {R('rr')} AS annual_return_pct, {age_cols_sql('fm')}
FROM (SELECT *, CAST({fire_month_sql('rr', 'monthly_expense * 12.0 * 25.0')} AS INTEGER) AS fm
      FROM ({with_powers_sql("""SELECT *, GREATEST(0.0, annual_return_pct + delta) AS rr FROM inputs
            CROSS JOIN (VALUES ('Conservative (-2pp)', CAST(-2.0 AS DOUBLE)), ('Base case', CAST(0.0 AS DOUBLE)),
                               ('Aggressive (+2pp)', CAST(2.0 AS DOUBLE))) d(scenario, delta)""", '1.0 + ' + _RR)}) y) x"""
SQL["fire_withdrawal_scenarios"] = with_(L1, FIRE_INPUTS) + f"""SELECT entity_id, wr AS withdrawal_rate_pct, {R('fn')} AS fire_number,
       {age_cols_sql('fm')}, wr = 4.0 AS is_default_25x
FROM (SELECT *, CAST({fire_month_sql('annual_return_pct', 'fn')} AS INTEGER) AS fm
      FROM ({with_powers_sql("""SELECT *, monthly_expense * 12.0 / (wr / 100.0) AS fn FROM inputs
            CROSS JOIN (VALUES (CAST(3.0 AS DOUBLE)), (CAST(4.0 AS DOUBLE)), (CAST(5.0 AS DOUBLE))) w(wr)""", '1.0 + ' + _RA)}) y) x"""


from ..operators.scenario import DEFAULT_SCENARIOS as _DEF, Scenario as _Sc  # noqa: E402

_WHATIF = _DEF + (_Sc("Reduce Low-Priority Spending", "reduce_category", pct=20, months_forward=24, keywords=("low", "specified")),
                  _Sc("One-time Purchase", "one_time_expense", amount=5000.0, months_forward=36))
_INV = (_Sc("Invest 10%", "increase_investment", amount=100.0, annual_return_pct=7.0, months_forward=36),
        _Sc("Invest at 0%", "increase_investment", amount=100.0, annual_return_pct=0.0, months_forward=12))
SQL["whatif_scenarios"] = whatif_sql("l1", _WHATIF)
SQL["whatif_baseline"] = ("SELECT entity_id, baseline_monthly_income, baseline_monthly_expense, baseline_net_monthly FROM ("
                          + whatif_sql("l2", _DEF) + ") w WHERE scenario_id = 0")
SQL["investment_growth"] = ("SELECT entity_id, scenario, future_value_after_months, total_contributed, investment_growth, "
                            "adjusted_net_monthly FROM (" + whatif_sql("l2", _INV) + ") w")



def _path_sql(seven: str) -> str:
    """The loop of the simulator: what is there grows, then the month's amount is added."""
    return with_(L2).replace("WITH ", "WITH RECURSIVE ", 1) + f""", sc(scenario_id, scenario, a, r, h) AS (
  VALUES (0, 'Invest', CAST(100.0 AS DOUBLE), {seven}, 36), (1, 'Invest at 0%', CAST(50.0 AS DOUBLE), {seven.replace('7.0', '0.0')}, 12)),
path(scenario_id, month, v) AS (
  SELECT scenario_id, 1, CAST(0 AS DOUBLE) * (1.0 + r) + a FROM sc
  UNION ALL SELECT scenario_id, month + 1, v * (1.0 + r) + a FROM path JOIN sc USING (scenario_id) WHERE month < h)
SELECT entity_id, scenario_id, scenario, month, {R('v')} AS investment_value, {R('a * month')} AS contributed
FROM path JOIN sc USING (scenario_id), (SELECT entity_id FROM l2 WHERE type = 'Expense' GROUP BY entity_id) e"""


SQL["investment_path"] = _path_sql("pow(1.0 + CAST(7.0 AS DOUBLE) / 100.0, CAST(1.0 AS DOUBLE) / 12.0) - 1.0")
SQL["investment_path_real"] = _path_sql("((1.0 + CAST(7.0 AS DOUBLE) / 100.0) / (1.0 + CAST(2.5 AS DOUBLE) / 100.0) - 1.0) * 100.0 / 1200.0")
_NET = "(CAST(s_inc AS DOUBLE) / GREATEST(n_months, 1) - CAST(s_exp AS DOUBLE) / GREATEST(n_months, 1))"


def _proj_sql() -> str:
    inner = whatif_sql("l1", _WHATIF).replace(
        "SELECT entity_id, scenario_id, scenario, months_forward,",
        "SELECT entity_id, scenario_id, scenario, months_forward, " + _NET + " AS _net, "
        "CASE WHEN kind = 'one_time_expense' THEN amount ELSE 0.0 END AS _once, "
        "CASE WHEN kind = 'increase_investment' THEN " + _NET + " - amount ELSE "
        "(CASE WHEN kind = 'increase_income' THEN CAST(s_inc AS DOUBLE) / GREATEST(n_months, 1) * (1.0 + pct / 100.0) "
        "ELSE CAST(s_inc AS DOUBLE) / GREATEST(n_months, 1) END) - "
        "(CASE WHEN kind = 'reduce_category' AND pick_t IS NOT NULL THEN CAST(s_exp AS DOUBLE) / GREATEST(n_months, 1) "
        "- CAST(pick_t AS DOUBLE) / GREATEST(n_months, 1) * (pct / 100.0) "
        "WHEN kind = 'increase_savings' AND CAST(s_exp AS DOUBLE) / GREATEST(n_months, 1) > 0 THEN "
        "CAST(s_exp AS DOUBLE) / GREATEST(n_months, 1) * GREATEST(0.0, (CAST(s_exp AS DOUBLE) / GREATEST(n_months, 1) - amount) "
        "/ (CAST(s_exp AS DOUBLE) / GREATEST(n_months, 1))) ELSE CAST(s_exp AS DOUBLE) / GREATEST(n_months, 1) END) END AS _adj,",
        1)
    return (f"SELECT entity_id, scenario_id, scenario, CAST(month AS INTEGER) AS month, {R('_net * month')} AS baseline_cumulative_net, "
            f"{R(chr(40) + '_adj * month - (CASE WHEN month >= 1 THEN _once ELSE 0.0 END)' + chr(41))} AS adjusted_cumulative_net FROM ({inner}) w "
            "CROSS JOIN LATERAL (SELECT unnest(generate_series(0, w.months_forward)) AS month) g")


SQL["whatif_projection"] = _proj_sql()

_C = "GREATEST(monthly_income - monthly_expense, 0.0)"
_r = "(pow(1.0 + annual_return_pct / 100.0, CAST(1.0 AS DOUBLE) / CAST(12.0 AS DOUBLE)) - 1.0)"
_GM = int_pow_sql("m")
SQL["fire_projection"] = with_(L1, FIRE_INPUTS) + f"""SELECT entity_id, CAST(m AS INTEGER) AS month, {R('current_age + m / 12.0', 4)} AS age,
       {R(f"CASE WHEN {_r} = 0 THEN current_savings + {_C} * m ELSE current_savings * {_GM} + {_C} * ({_GM} - 1.0) / {_r} END")} AS portfolio_value
FROM ({with_powers_sql('SELECT * FROM inputs', '1.0 + ' + _r)}) i CROSS JOIN LATERAL (SELECT unnest(generate_series(0, (target_age - current_age) * 12)) AS m) g"""


RAW_L2 = """raw AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date_time, p_brand AS category, l_returnflag AS account,
         CAST(l_extendedprice AS VARCHAR) AS amount, 'USD' AS currency, l_linestatus AS tags
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
           "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _clean_text_sql(c: str) -> str:
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in _TOKENS)
    return f"CASE WHEN {c} IS NULL OR {c} IN ({toks}) THEN 'nan' ELSE trim({c}) END"


def _clean_sql(raw: str) -> str:
    return with_(raw) + f""", p AS (
  SELECT date_time, CAST(try_strptime(trim(date_time), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts,
         abs(TRY_CAST(trim(amount) AS DOUBLE)) AS amt,
         {_clean_text_sql('category')} AS category, {_clean_text_sql('account')} AS account,
         {_clean_text_sql('currency')} AS currency, {_clean_text_sql('tags')} AS tags
  FROM raw),
k AS (SELECT *, CAST(amt AS VARCHAR) AS amount_text FROM p WHERE ts IS NOT NULL AND amt IS NOT NULL AND NOT isnan(amt)
        AND CAST(TRY_CAST(amt AS DECIMAL(18,2)) AS DOUBLE) = amt),
n AS (SELECT *, concat_ws('|', date_time, category, account, amount_text, tags) AS content FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY date_time, category, account, amount_text, tags, currency, ts, amt) - 1 AS occ FROM n)
SELECT substr(sha256(content || '|' || CAST(occ AS VARCHAR)), 1, 24) AS transaction_id,
       CAST(ts AS DATE) AS transaction_date, ts AS transaction_datetime,
       CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, strftime(ts, '%Y-%m') AS year_month,
       category, CASE WHEN category IN {BRAND_INCOME_SQL} THEN 'Income' ELSE 'Expense' END AS type,
       account, CAST(CAST(amt AS DECIMAL(18,2)) AS DOUBLE) AS amount, currency, tags, 'lineitem' AS source
FROM o"""


SQL["clean_ledger"] = _clean_sql(RAW_L2)
DIRTY_L2 = """raw AS (
  SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'not-a-date' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS date_time,
         CASE WHEN l_orderkey % 31 = 0 THEN '  ' || p_brand || ' ' ELSE p_brand END AS category, l_returnflag AS account,
         CASE WHEN l_orderkey % 7 = 0 THEN 'x' WHEN l_orderkey % 13 = 0 THEN '' WHEN l_orderkey % 17 = 0 THEN CAST(l_extendedprice AS VARCHAR) || '5'
              WHEN l_orderkey % 19 = 0 THEN 'inf' WHEN l_orderkey % 23 = 0 THEN '1e20' WHEN l_orderkey % 29 = 0 THEN '-' || CAST(l_extendedprice AS VARCHAR)
              WHEN l_orderkey % 37 = 0 THEN ' ' || CAST(l_extendedprice AS VARCHAR) WHEN l_orderkey % 41 = 0 THEN 'nan'
              ELSE CAST(l_extendedprice AS VARCHAR) END AS amount,
         'USD' AS currency, CASE WHEN l_orderkey % 43 = 0 THEN '' WHEN l_orderkey % 47 = 0 THEN NULL ELSE l_linestatus END AS tags
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SQL["clean_dirty_ledger"] = _clean_sql(DIRTY_L2)
SQL["rejected_rows"] = with_(DIRTY_L2) + """, v AS (SELECT *, try_strptime(trim(date_time), '%Y-%m-%d %H:%M:%S') AS ts, TRY_CAST(trim(amount) AS DOUBLE) AS amt FROM raw),
w AS (SELECT date_time, category, account, amount, currency, tags,
             CASE WHEN ts IS NULL THEN 'bad_date' WHEN amt IS NULL OR isnan(amt) THEN 'bad_amount'
                  WHEN CAST(TRY_CAST(amt AS DECIMAL(18,2)) AS DOUBLE) IS DISTINCT FROM amt THEN 'unfit_amount' END AS reason FROM v)
SELECT * FROM w WHERE reason IS NOT NULL"""
SQL["extract_log"] = with_(RAW_L2) + r""", t AS (
  SELECT date_time, CASE WHEN substr(date_time, 10, 1) IN ('1', '4', '7') THEN category || chr(10) || 'says "well, yes",' || chr(10) || tags ELSE category END AS category,
         account, amount, currency, tags FROM raw)
SELECT category, account, currency, tags, note, COUNT(*) AS n, MIN(date_time) AS first, MAX(date_time) AS last,
       CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM t, (VALUES (NULL), ('x')) v(note) GROUP BY ALL"""
SQL["etl_summary"] = f"""WITH clean AS ({SQL['clean_dirty_ledger']}),
led AS (SELECT * REPLACE (CAST(amount AS DECIMAL(18,2)) AS amount) FROM clean),
monthly AS ({monthly_with_rate('led')})
SELECT *, (SELECT COUNT(*) FROM clean) AS rows_out, (SELECT COUNT(*) FROM ({SQL['rejected_rows']}) r) AS rejected FROM monthly"""
SQL["stable_ids"] = with_(RAW_L2) + """SELECT substr(sha256(content || '|' || CAST(occ AS VARCHAR)), 1, 24) AS transaction_id,
       date_time, account, tags
FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY date_time, account, tags) - 1 AS occ
      FROM (SELECT date_time, account, tags, concat_ws('|', date_time, account, tags) AS content FROM raw) c) o"""
SQL["type_classification"] = with_(RAW_L2) + f"""SELECT category,
       CASE WHEN category IN {BRAND_INCOME_SQL} THEN 'Income' ELSE 'Expense' END AS type, COUNT(*) AS n
FROM raw GROUP BY 1, 2"""


_ORDERS_COLS = [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_orderstatus", "string", False),
                ("o_totalprice", "double", True), ("o_orderdate", "timestamp_ntz", False),
                ("o_orderpriority", "string", False)]


def _profile_arm(c: str, dtype: str, num: bool) -> str:
    if num:
        nums = (f"CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, {R(f'AVG(CAST({c} AS DOUBLE))', 6)} AS mean, "
                f"CAST(COUNT_IF({c} < 0) AS BIGINT) AS negative_count, CAST(COUNT_IF({c} = 0) AS BIGINT) AS zero_count")
    else:
        nums = ("CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, "
                "CAST(NULL AS BIGINT) AS negative_count, CAST(NULL AS BIGINT) AS zero_count")
    return (f"SELECT '{c}' AS column_name, '{dtype}' AS dtype, CAST(COUNT_IF({c} IS NULL) AS BIGINT) AS null_count, "
            f"{R(f'COUNT_IF({c} IS NULL) * 100.0 / COUNT(*)')} AS null_pct, COUNT(DISTINCT {c}) AS unique_count, {nums} FROM orders")


SQL["column_profile"] = "\nUNION ALL\n".join(_profile_arm(*x) for x in _ORDERS_COLS)
SQL["top_values"] = "\nUNION ALL\n".join(
    f"""SELECT column_name, value, count, rank FROM (
  SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count,
         CAST(row_number() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) ASC) AS INTEGER) AS rank
  FROM orders WHERE {c} IS NOT NULL GROUP BY 2) t WHERE rank <= 10"""
    for c, _, num in _ORDERS_COLS if not num)
SQL["top_values_log"] = with_(RAW_L2) + "\nUNION ALL\n".join(
    f"""SELECT column_name, value, count, rank FROM (
  SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count,
         CAST(row_number() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) ASC) AS INTEGER) AS rank
  FROM raw WHERE {c} IS NOT NULL GROUP BY 2) t WHERE rank <= 10"""
    for c in ("date_time", "category", "account", "amount", "currency", "tags"))
SQL["duplicate_rows"] = with_(RAW_L2) + """SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT COUNT(*) * CASE WHEN account = 'R' THEN 2 ELSE 1 END AS c
      FROM raw GROUP BY date_time, category, account, amount, currency, tags) g"""


def amount_stats_sql(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""SELECT {b}CAST(MIN(amount) AS DOUBLE) AS min_amount, CAST(MAX(amount) AS DOUBLE) AS max_amount,
       CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount,
       {std_samp_sql('COUNT(amount)', 'SUM(amount)', 'SUM(CAST(amount AS DECIMAL(19,2)) * CAST(amount AS DECIMAL(19,2)))')} AS std_amount,
       CAST(MEDIAN(CAST(amount AS DECIMAL(18,3))) AS DOUBLE) AS median
FROM {src} {g}"""


SQL["amount_stats"] = with_(L2) + amount_stats_sql("l2")
SQL["amount_stats_four_decimals"] = """WITH l AS (
  SELECT l_suppkey AS entity_id, CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_discount AS DECIMAL(4,2)) AS amount FROM lineitem),
s AS (SELECT entity_id, CAST(MIN(amount) AS DOUBLE) AS min_amount, CAST(MAX(amount) AS DOUBLE) AS max_amount,
             CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount, CAST(COUNT(*) AS HUGEINT) AS n,
             CAST(SUM(CAST(amount * 10000 AS BIGINT)) AS HUGEINT) AS s1,
             SUM(CAST(CAST(amount * 10000 AS BIGINT) AS HUGEINT) * CAST(amount * 10000 AS BIGINT)) AS s2
      FROM l GROUP BY 1),
r AS (SELECT entity_id, amount, row_number() OVER (PARTITION BY entity_id ORDER BY amount) - 1 AS k, COUNT(*) OVER (PARTITION BY entity_id) AS n FROM l),
m AS (SELECT entity_id, CAST(SUM(CASE WHEN k = (n - 1) // 2 THEN amount END) + SUM(CASE WHEN k = n // 2 THEN amount END) AS DOUBLE) / 2 AS median
      FROM r GROUP BY 1)
SELECT entity_id, min_amount, max_amount, avg_amount,
       CASE WHEN n > 1 THEN sqrt(CAST(CAST(n * s2 - s1 * s1 AS VARCHAR) || 'E-8' AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) END AS std_amount, median
FROM s JOIN m USING (entity_id)"""
SQL["amount_stats_by_entity"] = with_(L1) + amount_stats_sql("l1", "entity_id")


SQL["macro_yoy"] = """WITH obs AS (
  SELECT o_orderpriority AS series_id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS value
  FROM orders GROUP BY 1, 2),
newest AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 13),
usable AS (SELECT *, TRY_CAST(value AS DOUBLE) AS v FROM newest
           WHERE value IS NOT NULL AND value <> '.' AND TRY_CAST(value AS DOUBLE) IS NOT NULL),
pos AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS p FROM usable),
g AS (SELECT series_id, MAX(CASE WHEN p = 1 THEN v END) AS latest_value, MAX(CASE WHEN p = 1 THEN date END) AS latest_date,
             MAX(CASE WHEN p = 13 THEN v END) AS ago, COUNT(*) AS n_usable FROM pos GROUP BY series_id)
SELECT series_id, CAST(NULL AS VARCHAR) AS label, latest_value, latest_date, n_usable,
       CASE WHEN n_usable >= 13 THEN """ + R("(latest_value - ago) * 100.0 / NULLIF(ago, 0)") + """ END AS yoy_change_pct
FROM g"""


SQL["macro_saved_series"] = SQL["macro_yoy"]
SQL["append_new_rows"] = with_(L1) + """, led AS (SELECT transaction_id, year_month, CAST(amount AS DOUBLE) AS amount FROM l1),
existing AS (SELECT * FROM led WHERE year_month < '1998-01'),
incoming AS (SELECT * FROM led WHERE year_month >= '1997-07'
             UNION ALL SELECT transaction_id, '1999-01', amount FROM led WHERE year_month < '1993-01')
SELECT * FROM existing
UNION ALL
SELECT * FROM incoming WHERE transaction_id NOT IN (SELECT transaction_id FROM existing)"""
SQL["append_batches"] = with_(L1) + """, led AS (SELECT transaction_id, year_month, CAST(amount AS DOUBLE) AS amount FROM l1)
SELECT * FROM led
UNION ALL
SELECT transaction_id || '-b', year_month, amount
FROM (SELECT * FROM led ORDER BY year_month DESC, transaction_id DESC LIMIT 300) newest"""
SQL["upsert_by_key"] = with_(L1) + f""", cur AS ({monthly_with_rate('l1', "WHERE year_month < '1999-01'")}),
upd AS ({monthly_with_rate('l1', "WHERE year_month >= '1998-07' AND account = 'F'")})
SELECT *, 'kept' AS op FROM cur WHERE year_month NOT IN (SELECT year_month FROM upd)
UNION ALL
SELECT upd.*, CASE WHEN upd.year_month IN (SELECT year_month FROM cur) THEN 'updated' ELSE 'inserted' END AS op FROM upd"""
SQL["latest_per_key"] = """SELECT user_id, event_id, event_type, value, ts FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
SQL["newest_n"] = "SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"
SQL["find_transactions"] = with_(L1) + """SELECT transaction_id, year_month, type, CAST(amount AS DOUBLE) AS amount
FROM l1 WHERE account = 'F' AND category = '1-URGENT'"""
SQL["variant_payload"] = "SELECT event_id, event_type, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"
SQL["budget_plan_changes"] = """WITH base AS (
  SELECT CAST(c_custkey AS VARCHAR) || '-' || k AS budget_id, category,
         CAST(ROUND(CAST(lim AS DECIMAL(28,8)), 2) AS DOUBLE) AS monthly_limit
  FROM (SELECT c_custkey, 'a' AS k, '4-NOT SPECIFIED' AS category, abs(c_acctbal) AS lim FROM customer
        UNION ALL SELECT c_custkey, 'b', '4-NOT SPECIFIED', abs(c_acctbal) / 2 FROM customer
        UNION ALL SELECT c_custkey, 'c', '5-LOW', abs(c_acctbal) * 3 FROM customer
        UNION ALL SELECT c_custkey, 'd', '0-SAVINGS', 100.0 FROM customer) p),
deleted AS (SELECT CAST(c_custkey AS VARCHAR) || '-d' AS budget_id FROM customer WHERE c_acctbal < 0),
upd AS (SELECT CAST(c_custkey AS VARCHAR) || '-c' AS budget_id, ROUND(abs(c_acctbal), 2) AS lim FROM customer WHERE c_mktsegment = 'BUILDING'),
cre AS (SELECT CAST(c_custkey AS VARCHAR) || '-e' AS budget_id FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT b.budget_id, b.category, COALESCE(u.lim, b.monthly_limit) AS monthly_limit,
       CASE WHEN u.budget_id IS NOT NULL THEN '2025-03' END AS applies_from,
       CASE WHEN u.budget_id IS NOT NULL THEN 'raised' END AS notes,
       '2025-01-01' AS created_day, CASE WHEN u.budget_id IS NOT NULL THEN '2025-03-01' END AS updated_day
FROM base b LEFT JOIN upd u USING (budget_id)
WHERE b.budget_id NOT IN (SELECT budget_id FROM deleted)
UNION ALL
SELECT budget_id, '2-HIGH', 250.0, NULL, NULL, '2025-02-01', NULL FROM cre"""


# The log replayed change by change: every row is the state after one more change of its user.
SQL["budget_plan_change_log"] = """WITH RECURSIVE log AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, ts,
         CASE WHEN event_type = 'purchase' THEN 'create' WHEN event_type IN ('signup', 'error') THEN 'delete' ELSE 'update' END AS op,
         CASE WHEN event_id % 2 = 0 THEN event_type END AS category, CASE WHEN event_id % 3 = 0 THEN value END AS lim,
         CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m') END AS frm, CASE WHEN event_id % 7 = 0 THEN CAST(event_id AS VARCHAR) END AS notes
  FROM events),
state(user_id, k, there, category, lim, frm, notes, created, updated) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), user_id % 3 = 0, CASE WHEN user_id % 3 = 0 THEN 'old' END,
         CASE WHEN user_id % 3 = 0 THEN CAST(1.0 AS DOUBLE) END, CAST(NULL AS VARCHAR), CASE WHEN user_id % 3 = 0 THEN 'kept' END,
         CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2020-01-01' END, CAST(NULL AS TIMESTAMP) FROM events
  UNION ALL
  SELECT s.user_id, l.k, CASE op WHEN 'create' THEN true WHEN 'delete' THEN false ELSE there END,
         CASE WHEN op = 'delete' OR (op = 'update' AND NOT there) THEN NULL ELSE coalesce(l.category, s.category) END,
         CASE WHEN op = 'delete' OR (op = 'update' AND NOT there) THEN NULL ELSE coalesce(l.lim, s.lim) END,
         CASE WHEN op = 'delete' OR (op = 'update' AND NOT there) THEN NULL ELSE coalesce(l.frm, s.frm) END,
         CASE WHEN op = 'delete' OR (op = 'update' AND NOT there) THEN NULL ELSE coalesce(l.notes, s.notes) END,
         CASE WHEN op = 'delete' THEN NULL WHEN op = 'create' AND NOT there THEN l.ts ELSE s.created END,
         CASE WHEN op = 'delete' OR NOT there THEN NULL ELSE l.ts END
  FROM state s JOIN log l ON l.user_id = s.user_id AND l.k = s.k + 1)
SELECT CAST(user_id AS VARCHAR) AS budget_id, category, lim AS monthly_limit, frm AS applies_from, notes,
       strftime(created, '%Y-%m-%d %H:%M:%S') AS created, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated
FROM state WHERE there QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1
  AND k = (SELECT coalesce(max(l.k), 0) FROM log l WHERE l.user_id = state.user_id)"""
SQL["stream_append_dedup"] = with_(L3) + """SELECT transaction_id, transaction_date, year_month, category, type, account, entity_id,
       CAST(amount AS DOUBLE) AS amount FROM l3"""
SQL["stream_monthly_summary"] = with_(L3) + monthly_with_rate("l3", by="entity_id")


SQL["sql_passthrough"] = with_(L2) + """SELECT category, type, CAST(SUM(amount) AS DOUBLE) AS total_amount, COUNT(*) AS transaction_count
FROM l2 WHERE year_month = '1998-03' AND type = 'Expense' GROUP BY category, type"""


def _raw_profile_arm(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, 'string' AS dtype, "
            f"{R(f'COUNT_IF({c} IS NULL) * 100.0 / COUNT(*)')} AS null_pct, COUNT(DISTINCT {c}) AS unique_count FROM raw")


SQL["profile_report"] = with_(RAW_L2) + """, cols AS (""" + "\nUNION ALL\n".join(
    _raw_profile_arm(c) for c in ["date_time", "category", "account", "amount", "currency", "tags"]) + """),
dup AS (SELECT COALESCE(SUM(c - 1), 0) AS duplicate_rows
        FROM (SELECT COUNT(*) AS c FROM raw GROUP BY date_time, category, account, amount, currency, tags) g)
SELECT (SELECT COUNT(*) FROM raw) AS source_rows, (SELECT COUNT(*) FROM raw) AS clean_rows,
       CAST(0 AS BIGINT) AS rows_dropped_in_transform, CAST((SELECT duplicate_rows FROM dup) AS BIGINT) AS duplicate_rows,
       (SELECT CAST(to_json(list(struct_pack(column_name := column_name, dtype := dtype, null_pct := null_pct,
                                             unique_count := unique_count) ORDER BY column_name)) AS VARCHAR) FROM cols) AS columns_json"""


SQL["top_anomalies"] = with_(L2) + f"""SELECT * EXCLUDE (z), CAST(row_number() OVER o AS INTEGER) AS rank
FROM ({anomalies_sql('l2', more=", (CAST(t AS DOUBLE) - mean) / std AS z")}) a
WINDOW o AS (ORDER BY abs(z) DESC, category, year_month) QUALIFY row_number() OVER o <= 15"""
SQL["category_breakdown_by_entity"] = with_(L1) + category_sql("l1", by="entity_id")
SQL["account_breakdown_by_entity"] = with_(L2) + account_sql("l2", by="entity_id")
SQL["date_range_by_entity"] = with_(L3) + """SELECT entity_id, MIN(transaction_date) AS min_date, MAX(transaction_date) AS max_date,
       COUNT(*) AS row_count FROM l3 GROUP BY entity_id"""


SQL["context_package_fields"] = with_(L1, PLANS) + f"""
, k AS (SELECT entity_id, COUNT(DISTINCT year_month) AS months_covered,
               {R('CAST(SUM(' + INC + ') AS DOUBLE)')} AS total_income, {R('CAST(SUM(' + SGN + ') AS DOUBLE)')} AS net
        FROM l1 GROUP BY entity_id)
, t AS ({top_sql('l1', 1, 'Expense', by='entity_id')})
, h AS ({health_sql('l1', by='entity_id', snapshot=True)})
, o AS ({over_total_sql('l1', by='entity_id')})
SELECT k.entity_id, k.months_covered, k.total_income, k.net, CAST(k.months_covered AS INTEGER) AS n_months_listed,
       t.category AS top_expense_category, h.composite_score, h.band, o.total_over_budget_amount
FROM k LEFT JOIN t USING (entity_id) LEFT JOIN h USING (entity_id) LEFT JOIN o USING (entity_id)"""


SQL["dim_category"] = with_(L2) + "SELECT DISTINCT category, type FROM l2"
SQL["category_month_mart"] = with_(L1) + """SELECT year_month, type, CAST(SUM(amount) AS DOUBLE) AS total_amount, COUNT(*) AS transaction_count
FROM l1 GROUP BY year_month, type"""


SQL["source_fallback"] = SQL["monthly_summary"]


SQL["stream_ingest_summary"] = with_(L3) + monthly_with_rate("l3", by="entity_id")


SQL["context_package_whole_fields"] = with_(L1, PLANS) + f"""
, k AS ({kpi_sql('l1', FILTER_A)})
, t AS ({trends_sql('l1', FILTER_A)})
, ti AS ({top_sql('l1', 1, 'Income', FILTER_A)})
, h AS ({health_sql('(SELECT * FROM l1 ' + FILTER_A + ')', snapshot=True)})
, o AS ({over_total_sql('l1', where=FILTER_A)})
SELECT '1996-01' AS period_start, k.months_covered, {R('k.total_expense')} AS total_expense, k.savings_rate_pct,
       CAST((SELECT COUNT(*) FROM t) AS INTEGER) AS n_trend_months,
       (SELECT expense_3mo_avg FROM t ORDER BY year_month DESC LIMIT 1) AS last_expense_3mo_avg,
       (SELECT category FROM ti) AS top_income_category,
       (SELECT MIN(account) FROM l1 {FILTER_A}) AS first_account,
       h.category_hhi, o.n_over_budget
FROM k, h, o"""


SQL["category_breakdown_ordered"] = f"""SELECT *, row_number() OVER (ORDER BY total_amount DESC, category, type) - 1 AS place
FROM ({SQL['category_breakdown']}) c"""
SQL["whatif_context_fields"] = f"""SELECT w.entity_id, w.scenario_id, w.scenario, w.adjusted_net_monthly, w.adjusted_cumulative_net,
       c.months_covered, c.net, c.top_expense_category, c.composite_score
FROM ({SQL['whatif_scenarios']}) w JOIN ({SQL['context_package_fields']}) c USING (entity_id)"""
SQL["fire_context_fields"] = f"""SELECT i.entity_id, i.monthly_income, a.fire_number, a.fire_age, r.fire_age AS base_fire_age, n.fire_number AS number_at_4_pct
FROM ({with_(L1, FIRE_INPUTS)} SELECT entity_id, monthly_income FROM inputs) i
JOIN ({SQL['fire_age']}) a USING (entity_id)
JOIN (SELECT * FROM ({SQL['fire_return_scenarios']}) q WHERE scenario = 'Base case') r USING (entity_id)
JOIN (SELECT * FROM ({SQL['fire_withdrawal_scenarios']}) q WHERE withdrawal_rate_pct = 4.0) n USING (entity_id)"""
