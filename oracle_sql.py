"""Independent SQL formulations of the catalog queries (DuckDB dialect).

The tables region ... conversations are views over the same parquet files.
The SQL is written from the definitions, not from the Spark plans: quantile
edges come from ``quantile_cont`` (linear interpolation), the rank-first cut
from ``row_number()``, segments from regex matches, day counts from
microsecond differences.
"""

from __future__ import annotations

SIG_DIGITS = 10


def sig(x: str, digits: int = SIG_DIGITS) -> str:
    """Round to significant digits for presentation, exact decimal ties away from zero (see custval.functions.numeric)."""
    x = f"(({x}) * {1.0 + 2.0**-41!r}::DOUBLE)"
    k = f"({digits - 1} - floor(log10(abs({x}))))"
    return (
        f"(CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = 0 OR isinf({x}) THEN {x} "
        f"WHEN {k} >= 0 THEN round({x} * pow(10.0, {k})) / pow(10.0, {k}) "
        f"ELSE round({x} / pow(10.0, -{k})) * pow(10.0, -{k}) END)"
    )

# Invoice lines over the TPC-H style tables (the same view as
# custval.sources.tables.invoice_lines).
INVOICE_LINES = """
invoice_lines AS (
  SELECT CASE WHEN l.l_returnflag = 'R' THEN 'C' || CAST(l.l_orderkey AS VARCHAR)
              ELSE CAST(l.l_orderkey AS VARCHAR) END AS "Invoice",
         CAST(l.l_partkey AS VARCHAR) AS "StockCode",
         p.p_name AS "Description",
         l.l_quantity AS "Quantity",
         o.o_orderdate AS "InvoiceDate",
         l.l_extendedprice / l.l_quantity AS "Price",
         o.o_custkey AS "Customer ID",
         n.n_name AS "Country"
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

NOT_NULL_LINES = """
  "Invoice" IS NOT NULL AND "StockCode" IS NOT NULL AND "Description" IS NOT NULL
  AND "Quantity" IS NOT NULL AND NOT isnan("Quantity") AND "InvoiceDate" IS NOT NULL
  AND "Price" IS NOT NULL AND NOT isnan("Price") AND "Customer ID" IS NOT NULL
  AND "Country" IS NOT NULL AND NOT isnan("Quantity" * "Price")"""

# RFM metrics: cleaned lines -> per customer -> analysis date = max + 2 days.
RFM_METRICS = (
    "WITH "
    + INVOICE_LINES
    + """,
clean AS (
  SELECT *, "Quantity" * "Price" AS "TotalPrice" FROM invoice_lines
  WHERE """
    + NOT_NULL_LINES
    + """
    AND NOT coalesce(contains("Invoice", 'C'), false)
),
activity AS (
  SELECT "Customer ID" AS customer_id, max("InvoiceDate") AS last_date,
         count(DISTINCT "Invoice") AS frequency, round(sum("TotalPrice"), 2) AS monetary
  FROM clean GROUP BY 1
),
params AS (SELECT date_trunc('day', max(last_date)) + INTERVAL 2 DAY AS analysis_date FROM activity),
metrics_all AS (
  SELECT customer_id,
         CAST(floor(date_diff('microsecond', last_date, analysis_date) / 86400000000.0) AS BIGINT) AS recency,
         frequency, monetary
  FROM activity, params
),
metrics AS (SELECT * FROM metrics_all WHERE monetary > 0)"""
)

SEGMENT_CASE = """CASE
    WHEN regexp_matches({s}, '[1-2][1-2]') THEN 'hibernating'
    WHEN regexp_matches({s}, '[1-2][3-4]') THEN 'at_Risk'
    WHEN regexp_matches({s}, '[1-2]5') THEN 'cant_loose'
    WHEN regexp_matches({s}, '3[1-2]') THEN 'about_to_sleep'
    WHEN regexp_matches({s}, '33') THEN 'need_attention'
    WHEN regexp_matches({s}, '[3-4][4-5]') THEN 'loyal_customers'
    WHEN regexp_matches({s}, '41') THEN 'promising'
    WHEN regexp_matches({s}, '51') THEN 'new_customers'
    WHEN regexp_matches({s}, '[4-5][2-3]') THEN 'potential_loyalists'
    WHEN regexp_matches({s}, '5[4-5]') THEN 'champions'
    ELSE {s} END"""


def _qcut_case(x: str, edges: str, labels: list) -> str:
    """CASE over quantile edges e[1..q-1] (a DuckDB list, 1-based)."""
    parts = [f"WHEN {x} <= {edges}[{i + 1}] THEN {lab!r}" for i, lab in enumerate(labels[:-1])]
    return "CASE " + " ".join(parts) + f" ELSE {labels[-1]!r} END"


QUINTILES = "[0.2, 0.4, 0.6, 0.8]"


def rfm_scored(metrics: str = "metrics", key: str = "customer_id") -> str:
    """CTEs ranked/edges/scored over a metrics CTE with recency/frequency/monetary."""
    return f""",
ranked AS (SELECT *, row_number() OVER (ORDER BY frequency, {key}) AS frank FROM {metrics}),
edges AS (
  SELECT quantile_cont(recency, {QUINTILES}) AS er,
         quantile_cont(frank, {QUINTILES}) AS ef,
         quantile_cont(monetary, {QUINTILES}) AS em
  FROM ranked
),
scored0 AS (
  SELECT ranked.*,
         {_qcut_case("recency", "er", [5, 4, 3, 2, 1])} AS recency_score,
         {_qcut_case("frank", "ef", [1, 2, 3, 4, 5])} AS frequency_score,
         {_qcut_case("monetary", "em", [1, 2, 3, 4, 5])} AS monetary_score
  FROM ranked, edges
),
scored AS (
  SELECT *, CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR) AS "RF_SCORE",
         CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR)
           || CAST(monetary_score AS VARCHAR) AS "RFM_SCORE",
         {SEGMENT_CASE.format(s="CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR)")} AS segment
  FROM scored0
)"""


RFM_SCORED = RFM_METRICS + rfm_scored()


INTEGRAL_MEASURES = {"recency", "frequency", "total_transaction"}


def _report(source: str, group: str, measures: list[str]) -> str:
    cols = ", ".join(
        f"{sig(f'avg({m})')} AS {m}_mean, count({m}) AS {m}_count"
        for m in measures
    )
    return f"SELECT {group}, {cols} FROM {source} GROUP BY {group}"


LINE_COLUMNS = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price",
                "Customer ID", "Country"]
DOUBLE_LINE_COLUMNS = {"Quantity", "Price"}

NULL_PROFILE = "WITH " + INVOICE_LINES + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count_if(\"{c}\" IS NULL"
    + (f" OR isnan(\"{c}\")" if c in DOUBLE_LINE_COLUMNS else "")
    + ") AS BIGINT) AS null_count FROM invoice_lines"
    for c in LINE_COLUMNS
)

DISTINCT_COUNTS = "WITH " + INVOICE_LINES + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT \"{c}\") AS distinct_count FROM invoice_lines"
    for c in ["Invoice", "StockCode", "Description", "Customer ID"]
)


def _describe(source: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS count, {sig(f'avg({x})')} AS mean, "
            f"{sig(f'stddev_samp({x})')} AS std, {sig(f'min({x})')} AS min, "
            f"{sig(f'quantile_cont({x}, 0.25)')} AS p25, "
            f"{sig(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{sig(f'quantile_cont({x}, 0.75)')} AS p75, "
            f"{sig(f'max({x})')} AS max FROM {source}"
        )
    return " UNION ALL ".join(parts)


INVOICE_TOTALS = (
    "WITH " + INVOICE_LINES + f""" SELECT "Invoice", {sig('sum("Quantity" * "Price")')} AS total_price
    FROM invoice_lines WHERE "Invoice" IS NOT NULL GROUP BY "Invoice" """
)

CLV_BASE = (
    "WITH "
    + INVOICE_LINES
    + """,
clean AS (
  SELECT *, "Quantity" * "Price" AS "TotalPrice" FROM invoice_lines
  WHERE NOT coalesce(contains("Invoice", 'C'), false) AND "Quantity" > 0 AND """
    + NOT_NULL_LINES
    + """
),
base AS (
  SELECT "Customer ID" AS customer_id, count(DISTINCT "Invoice") AS total_transaction,
         CAST(sum("Quantity") AS DOUBLE) AS total_unit, round(sum("TotalPrice"), 2) AS total_price
  FROM clean GROUP BY 1
),
rates AS (
  SELECT count(*) AS n_customers, count_if(total_transaction > 1) / count(*) AS repeat_rate,
         1.0 - count_if(total_transaction > 1) / count(*) AS churn_rate
  FROM base
),
clv0 AS (
  SELECT customer_id, total_transaction, total_unit, total_price,
         total_price / total_transaction AS average_order_value,
         total_transaction / CAST(n_customers AS DOUBLE) AS purchase_frequency,
         total_price * CAST(0.1 AS DOUBLE) AS profit_margin, churn_rate
  FROM base, rates
),
clv1 AS (
  SELECT *, average_order_value * purchase_frequency AS customer_value FROM clv0
),
clv2 AS (
  SELECT customer_id, total_transaction, total_unit, total_price, average_order_value,
         purchase_frequency, profit_margin, customer_value,
         customer_value / churn_rate * profit_margin AS clv
  FROM clv1
),
clv_edges AS (SELECT quantile_cont(clv, [0.25, 0.5, 0.75]) AS e FROM clv2),
clv AS (
  SELECT clv2.*, """
    + _qcut_case("clv", "e", ["D", "C", "B", "A"])
    + """ AS segment FROM clv2, clv_edges
)"""
)

CLV_COLUMNS = ("customer_id, total_transaction, total_unit, total_price, average_order_value, "
               "purchase_frequency, profit_margin, customer_value, clv, segment")


def _group_report_sql(source: str, group: str, measures: list[str], digits: int = 8) -> str:
    cols = []
    for m in measures:
        total = f"CAST(sum({m}) AS BIGINT)" if m in INTEGRAL_MEASURES else sig(f"sum({m})", digits)
        cols += [f"count({m}) AS {m}_count", f"{sig(f'avg({m})', digits)} AS {m}_mean", f"{total} AS {m}_sum"]
    return f"SELECT {group}, {', '.join(cols)} FROM {source} GROUP BY {group}"


CLV_MEASURES = ["total_transaction", "total_unit", "total_price", "average_order_value",
                "purchase_frequency", "profit_margin", "customer_value", "clv"]

ORACLE: dict[str, str] = {
    "rfm_metrics": RFM_METRICS + " SELECT customer_id, recency, frequency, monetary FROM metrics",
    "rfm_scores": RFM_SCORED
    + ' SELECT customer_id, recency_score, frequency_score, monetary_score, "RF_SCORE", "RFM_SCORE" FROM scored',
    "rfm_segments": RFM_SCORED
    + " SELECT customer_id, recency, frequency, monetary, segment FROM scored",
    "rfm_segment_report": RFM_SCORED
    + " "
    + _report("scored", "segment", ["recency", "frequency", "monetary"]),
    "new_customer_ids": RFM_SCORED
    + " SELECT CAST(customer_id AS BIGINT) AS new_customer_id FROM scored WHERE segment = 'new_customers'",
    "invoice_totals": INVOICE_TOTALS,
    "null_profile": NULL_PROFILE,
    "numeric_summary": RFM_METRICS + " " + _describe("metrics_all", ["recency", "frequency", "monetary"]),
    "distinct_counts": DISTINCT_COUNTS,
    "segment_counts": RFM_SCORED + " SELECT segment, count(*) AS count FROM scored GROUP BY segment",
    "clv_base": CLV_BASE + " SELECT customer_id, total_transaction, total_unit, total_price FROM base",
    "clv_rates": CLV_BASE
    + f" SELECT n_customers, {sig('repeat_rate')} AS repeat_rate, {sig('churn_rate')} AS churn_rate FROM rates",
    "clv_formula": CLV_BASE + f" SELECT {CLV_COLUMNS} FROM clv",
    "clv_segments": CLV_BASE + " SELECT customer_id, clv, segment FROM clv",
    "clv_segment_report": CLV_BASE + " " + _group_report_sql("clv", "segment", CLV_MEASURES),
    "clv_top": CLV_BASE
    + f" SELECT {CLV_COLUMNS} FROM clv ORDER BY clv DESC, customer_id LIMIT 10",
    "clv_bottom": CLV_BASE
    + f" SELECT {CLV_COLUMNS} FROM clv ORDER BY clv ASC, customer_id LIMIT 5",
}


# --- customer summary (omnichannel) ------------------------------------------

CUSTOMER_SUMMARY = """
summary_params AS (SELECT date_trunc('day', max(o_orderdate)) + INTERVAL 2 DAY AS analysis_date FROM orders),
ord AS (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH') AS online FROM orders),
last_channel AS (
  SELECT o_custkey, o_orderpriority AS last_order_channel FROM (
    SELECT o_custkey, o_orderpriority,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1
),
per_customer AS (
  SELECT o_custkey, min(o_orderdate) AS first_order_date, max(o_orderdate) AS last_order_date,
         max(CASE WHEN online THEN o_orderdate END) AS last_order_date_online,
         max(CASE WHEN NOT online THEN o_orderdate END) AS last_order_date_offline,
         CAST(count_if(online) AS DOUBLE) AS order_num_total_ever_online,
         CAST(count_if(NOT online) AS DOUBLE) AS order_num_total_ever_offline,
         round(coalesce(sum(CASE WHEN NOT online THEN o_totalprice END), 0.0), 2) AS customer_value_total_ever_offline,
         round(coalesce(sum(CASE WHEN online THEN o_totalprice END), 0.0), 2) AS customer_value_total_ever_online
  FROM ord GROUP BY o_custkey
),
types AS (
  SELECT o.o_custkey, '[' || string_agg(DISTINCT p.p_type, ', ' ORDER BY p.p_type) || ']' AS interested_in_categories_12
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey, summary_params
  WHERE o.o_orderdate >= summary_params.analysis_date - INTERVAL 12 MONTH
  GROUP BY o.o_custkey
),
summary AS (
  SELECT CAST(pc.o_custkey AS VARCHAR) AS master_id, c.c_mktsegment AS order_channel,
         lc.last_order_channel, pc.first_order_date, pc.last_order_date,
         pc.last_order_date_online, pc.last_order_date_offline,
         pc.order_num_total_ever_online, pc.order_num_total_ever_offline,
         pc.customer_value_total_ever_offline, pc.customer_value_total_ever_online,
         t.interested_in_categories_12
  FROM per_customer pc
  LEFT JOIN customer c ON pc.o_custkey = c.c_custkey
  LEFT JOIN last_channel lc ON pc.o_custkey = lc.o_custkey
  LEFT JOIN types t ON pc.o_custkey = t.o_custkey
),
prep AS (
  SELECT *, order_num_total_ever_online + order_num_total_ever_offline AS order_num_total,
         customer_value_total_ever_offline + customer_value_total_ever_online AS customer_value_total
  FROM summary
)"""

OMNI_METRICS = (
    "WITH "
    + CUSTOMER_SUMMARY
    + """,
omni_params AS (SELECT date_trunc('day', max(last_order_date)) + INTERVAL 2 DAY AS analysis_date FROM prep),
metrics AS (
  SELECT master_id AS customer_id,
         CAST(floor(date_diff('microsecond', last_order_date, analysis_date) / 86400000000.0) AS BIGINT) AS recency,
         order_num_total AS frequency, customer_value_total AS monetary, interested_in_categories_12
  FROM prep, omni_params
)"""
)

OMNI_SCORED = OMNI_METRICS + rfm_scored()

OMNI_PREP_COLUMNS = (
    "master_id, order_channel, last_order_channel, "
    "CAST(first_order_date AS VARCHAR) AS first_order_date, "
    "CAST(last_order_date AS VARCHAR) AS last_order_date, "
    "CAST(last_order_date_online AS VARCHAR) AS last_order_date_online, "
    "CAST(last_order_date_offline AS VARCHAR) AS last_order_date_offline, "
    "order_num_total_ever_online, order_num_total_ever_offline, "
    "customer_value_total_ever_offline, customer_value_total_ever_online, "
    "interested_in_categories_12, order_num_total, customer_value_total"
)

OMNI_CAP_COLUMNS = ["order_num_total_ever_online", "order_num_total_ever_offline",
                    "customer_value_total_ever_offline", "customer_value_total_ever_online"]


def _limits_sql(source: str, cols: list[str], rounded_caps: bool) -> str:
    parts = []
    for c in cols:
        q1, q3 = f"quantile_cont({c}, 0.01)", f"quantile_cont({c}, 0.99)"
        low = f"({q1} - 1.5 * ({q3} - {q1}))"
        up = f"({q3} + 1.5 * ({q3} - {q1}))"
        sel = f"SELECT '{c}' AS column_name, {sig(low)} AS low_limit, {sig(up)} AS up_limit"
        if rounded_caps:
            sel += f", round_even({low}, 0) AS low_cap, round_even({up}, 0) AS up_cap"
        parts.append(sel + f" FROM {source}")
    return " UNION ALL ".join(parts)


def _cap_expr(c: str) -> str:
    q1, q3 = f"quantile_cont({c}, 0.01)", f"quantile_cont({c}, 0.99)"
    return (
        f"({q1} - 1.5 * ({q3} - {q1})) AS {c}_low, ({q3} + 1.5 * ({q3} - {q1})) AS {c}_up"
    )


OMNI_CAPPED = (
    "WITH "
    + CUSTOMER_SUMMARY
    + ", limits AS (SELECT "
    + ", ".join(_cap_expr(c) for c in OMNI_CAP_COLUMNS)
    + " FROM summary), capped AS (SELECT master_id, "
    + ", ".join(
        f"""CASE WHEN (CASE WHEN {c} < {c}_low THEN round_even({c}_low, 0) ELSE {c} END) > {c}_up
             THEN round_even({c}_up, 0)
             ELSE (CASE WHEN {c} < {c}_low THEN round_even({c}_low, 0) ELSE {c} END) END AS {c}"""
        for c in OMNI_CAP_COLUMNS
    )
    + " FROM summary, limits)"
)

MODEL_LINES = (
    "WITH "
    + INVOICE_LINES
    + """,
model_lines AS (
  SELECT * FROM invoice_lines
  WHERE """
    + NOT_NULL_LINES.replace(' AND NOT isnan("Quantity" * "Price")', "")
    + """
    AND NOT coalesce(contains("Invoice", 'C'), false) AND "Quantity" > 0 AND "Price" > 0
)"""
)

ORACLE.update(
    {
        "omni_prep": "WITH " + CUSTOMER_SUMMARY + f" SELECT {OMNI_PREP_COLUMNS} FROM prep",
        "omni_rfm": OMNI_SCORED
        + " SELECT customer_id, recency, frequency, monetary, recency_score, frequency_score,"
        ' monetary_score, "RF_SCORE", "RFM_SCORE", segment FROM scored',
        "omni_segment_report": OMNI_SCORED
        + " "
        + _report("scored", "segment", ["recency", "frequency", "monetary"]).replace(
            "_mean, count(frequency)", "_mean, count(frequency)"
        ),
        "omni_channel_report": "WITH "
        + CUSTOMER_SUMMARY
        + f""" SELECT order_channel, count(master_id) AS customers,
               {sig("sum(order_num_total)")} AS order_num_total,
               {sig("sum(customer_value_total)")} AS customer_value_total
             FROM prep GROUP BY order_channel""",
        "omni_top_customers": "WITH "
        + CUSTOMER_SUMMARY
        + """ SELECT master_id, customer_value_total, order_num_total FROM prep
             ORDER BY customer_value_total DESC, master_id LIMIT 10""",
        "campaign_brand": OMNI_SCORED
        + """ SELECT customer_id AS master_id FROM scored
             WHERE segment IN ('champions', 'loyal_customers')
               AND coalesce(contains(interested_in_categories_12, 'PROMO'), false)""",
        "campaign_discount": OMNI_SCORED
        + """ SELECT customer_id AS master_id FROM scored
             WHERE segment IN ('cant_loose', 'hibernating', 'new_customers')
               AND (coalesce(contains(interested_in_categories_12, 'SMALL'), false)
                    OR coalesce(contains(interested_in_categories_12, 'ECONOMY'), false))""",
        "zero_value_filter": "WITH "
        + CUSTOMER_SUMMARY
        + """ SELECT master_id, order_num_total, customer_value_total FROM prep
             WHERE customer_value_total <> 0 OR order_num_total = 0""",
        "caps_upper": MODEL_LINES + " " + _limits_sql("model_lines", ['"Quantity"', '"Price"'], False)
        .replace("SELECT '\"Quantity\"'", "SELECT 'Quantity'")
        .replace("SELECT '\"Price\"'", "SELECT 'Price'"),
        "caps_both_rounded": "WITH "
        + CUSTOMER_SUMMARY
        + " "
        + _limits_sql("summary", OMNI_CAP_COLUMNS, True),
        "omni_capped": OMNI_CAPPED + " SELECT * FROM capped",
    }
)


# --- probabilistic models ----------------------------------------------------
# Published example parameters (CDNOW), the same fixed values as the catalog.
BG = {"r": 0.243, "alpha": 4.414, "a": 0.793, "b": 2.426}
BG_STEEP = {"r": 1.7, "alpha": 9.0, "a": 6.2, "b": 8.1}
GG = {"p": 6.25, "q": 3.74, "v": 15.44}
MODEL_DIGITS = 8
CALIBRATION_MAX = 7


def d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


SERIES_TERMS = 600


def expected_sql(t: float, x: str, tx: str, age: str, bg: dict | None = None) -> str:
    """E[X(t) | x, tx, T] by the series of 2F1(r+x, b+x; a+b+x-1; z), summed term by term.

    All terms are positive; they fall like z**n, and z = t / (alpha + T + t) is below 0.8
    for the horizons and parameters used here, so SERIES_TERMS leave nothing.
    """
    bg = bg or BG
    r, alpha, a, b = bg["r"], bg["alpha"], bg["a"], bg["b"]
    z = f"({d(t)} / ({d(alpha)} + {age} + {d(t)}))"
    up1, up2, low = f"({d(r)} + {x})", f"({d(b)} + {x})", f"({d(a + b - 1.0)} + {x})"
    term = (
        f"exp(lgamma({up1} + n) - lgamma({up1}) + lgamma({up2} + n) - lgamma({up2})"
        f" - lgamma({low} + n) + lgamma({low}) - lgamma(n + 1) + n * ln({z}))"
    )
    series = f"list_sum(list_transform(range(0, {SERIES_TERMS}), lambda n: {term}))"
    first = f"({low} / {d(a - 1.0)})"
    second = f"(1.0::DOUBLE - pow(1.0::DOUBLE - {z}, {up1}) * {series})"
    ratio = f"pow(({d(alpha)} + {age}) / ({d(alpha)} + {tx}), {up1})"
    denom = f"(1.0::DOUBLE + CASE WHEN {x} > 0 THEN {d(a)} / ({d(b - 1.0)} + {x}) * {ratio} ELSE 0.0::DOUBLE END)"
    return f"({first} * {second} / {denom})"


def profit_sql(x: str, m: str) -> str:
    p, q, v = GG["p"], GG["q"], GG["v"]
    weight = f"({d(p)} * {x} / ({d(p)} * {x} + {d(q - 1.0)}))"
    return f"((1.0::DOUBLE - {weight}) * {d(v * p / (q - 1.0))} + {weight} * {m})"


def clv_sql(months: int, x: str, tx: str, age: str, m: str, rate: float = 0.01) -> str:
    factor = 4.345
    import numpy as np

    parts, previous = [], "0.0::DOUBLE"
    for i in (np.arange(1, months + 1) * factor).tolist():
        current = expected_sql(i, x, tx, age)
        parts.append(f"{profit_sql(x, m)} * ({current} - {previous}) / {d((1 + rate) ** (i / factor))}")
        previous = current
    return "(" + " + ".join(parts) + ")"


def pmf_sql(n: int, t: str) -> str:
    r, alpha, a, b = BG["r"], BG["alpha"], BG["a"], BG["b"]

    def lbeta(p, q):
        return f"(lgamma({d(p)}) + lgamma({d(q)}) - lgamma({d(p + q)}))"

    p_alpha = f"({d(alpha)} / ({d(alpha)} + {t}))"
    p_t = f"({t} / ({d(alpha)} + {t}))"
    first = (
        f"exp({lbeta(a, b + n)} - {lbeta(a, b)} + lgamma({d(r + n)}) - lgamma({d(r)})"
        f" - lgamma({d(n + 1.0)}))"
    )
    term = f"({first} * pow({p_alpha}, {d(r)}) * pow({p_t}, {d(n)}))"
    if n == 0:
        return term
    second = f"exp({lbeta(a + 1, b + n - 1)} - {lbeta(a, b)})"
    partial = (
        f"list_sum(list_transform(range(0, {n}), lambda j: exp(lgamma({d(r)} + j) - lgamma({d(r)})"
        f" - lgamma(j + 1)) * pow({p_t}, j)))"
    )
    return f"({term} + {second} * (1.0::DOUBLE - pow({p_alpha}, {d(r)}) * {partial}))"


RETAIL_INPUTS = (
    MODEL_LINES
    + """,
limits AS (
  SELECT quantile_cont("Quantity", 0.99) + 1.5 * (quantile_cont("Quantity", 0.99) - quantile_cont("Quantity", 0.01)) AS q_up,
         quantile_cont("Price", 0.99) + 1.5 * (quantile_cont("Price", 0.99) - quantile_cont("Price", 0.01)) AS p_up
  FROM model_lines
),
capped AS (
  SELECT "Customer ID", "Invoice", "InvoiceDate",
         CASE WHEN "Quantity" > q_up THEN q_up ELSE "Quantity" END
           * CASE WHEN "Price" > p_up THEN p_up ELSE "Price" END AS "TotalPrice"
  FROM model_lines, limits
),
model_customers AS (
  SELECT "Customer ID" AS customer_id, min("InvoiceDate") AS first_date, max("InvoiceDate") AS last_date,
         count(DISTINCT "Invoice") AS frequency, round(sum("TotalPrice"), 2) AS total
  FROM capped GROUP BY 1
),
model_params AS (SELECT date_trunc('day', max(last_date)) + INTERVAL 2 DAY AS analysis_date FROM model_customers),
inputs AS (
  SELECT customer_id,
         floor(date_diff('microsecond', first_date, last_date) / 86400000000.0) / 7.0::DOUBLE AS recency,
         floor(date_diff('microsecond', first_date, analysis_date) / 86400000000.0) / 7.0::DOUBLE AS "T",
         frequency, total / frequency AS monetary
  FROM model_customers, model_params WHERE frequency > 1
)"""
)

OMNI_CAPPED_FULL = (
    "WITH "
    + CUSTOMER_SUMMARY
    + ", limits AS (SELECT "
    + ", ".join(_cap_expr(c) for c in OMNI_CAP_COLUMNS)
    + """ FROM summary), capped_summary AS (SELECT master_id, order_channel, last_order_channel,
    first_order_date, last_order_date, last_order_date_online, last_order_date_offline, """
    + ", ".join(
        f"""CASE WHEN (CASE WHEN {c} < {c}_low THEN round_even({c}_low, 0) ELSE {c} END) > {c}_up
             THEN round_even({c}_up, 0)
             ELSE (CASE WHEN {c} < {c}_low THEN round_even({c}_low, 0) ELSE {c} END) END AS {c}"""
        for c in OMNI_CAP_COLUMNS
    )
    + """, interested_in_categories_12 FROM summary, limits),
capped_prep AS (
  SELECT *, order_num_total_ever_online + order_num_total_ever_offline AS order_num_total,
         customer_value_total_ever_offline + customer_value_total_ever_online AS customer_value_total
  FROM capped_summary
),
kept AS (SELECT * FROM capped_prep WHERE customer_value_total <> 0 OR order_num_total = 0),
kept_params AS (SELECT date_trunc('day', max(last_order_date)) + INTERVAL 2 DAY AS analysis_date FROM kept),
omni_inputs AS (
  SELECT master_id AS customer_id,
         floor(date_diff('microsecond', first_order_date, last_order_date) / 86400000000.0) / 7.0::DOUBLE AS recency_clv_weekly,
         floor(date_diff('microsecond', first_order_date, analysis_date) / 86400000000.0) / 7.0::DOUBLE AS "T_weekly",
         order_num_total AS frequency, customer_value_total / order_num_total AS monetary_clv_avg
  FROM kept, kept_params WHERE order_num_total > 1
)"""
)

RETAIL_TIMES = {"expected_purc_1_week": 1.0, "expected_purc_1_month": 4.0, "expected_purc_3_month": 12.0}
RETAIL_E = {name: expected_sql(t, "frequency", "recency", '"T"') for name, t in RETAIL_TIMES.items()}

OMNI_SEGMENTED = (
    OMNI_CAPPED_FULL
    + f""",
omni_clv AS (
  SELECT customer_id, {clv_sql(6, "frequency", "recency_clv_weekly", '"T_weekly"', "monetary_clv_avg")} AS clv
  FROM omni_inputs
),
clv_edges AS (SELECT quantile_cont(clv, [0.25, 0.5, 0.75]) AS e FROM omni_clv),
seg AS (SELECT omni_clv.*, {_qcut_case("clv", "e", ["D", "C", "B", "A"])} AS clv_segment FROM omni_clv, clv_edges),
a_edges AS (SELECT quantile_cont(clv, [0.5]) AS e FROM seg WHERE clv_segment = 'A'),
segmented AS (
  SELECT customer_id, clv,
         CASE WHEN clv_segment = 'A' THEN {_qcut_case("clv", "e", ["A2", "A1"])} ELSE clv_segment END AS clv_segment
  FROM seg, a_edges
)"""
)

CALIBRATION = (
    RETAIL_INPUTS
    + ", probs AS (SELECT frequency, "
    + ", ".join(f"{pmf_sql(n, '\"T\"')} AS p{n}" for n in range(CALIBRATION_MAX))
    + " FROM inputs), probs2 AS (SELECT *, 1.0::DOUBLE - ("
    + " + ".join(f"p{n}" for n in range(CALIBRATION_MAX))
    + f") AS p{CALIBRATION_MAX} FROM probs), expected AS ("
    + " UNION ALL ".join(
        f"SELECT {n} AS frequency, sum(p{n}) AS expected FROM probs2"
        for n in range(CALIBRATION_MAX + 1)
    )
    + f"""), actual AS (
  SELECT CAST(least(frequency, {CALIBRATION_MAX}) AS INTEGER) AS frequency, count(*) AS actual
  FROM inputs GROUP BY 1)
SELECT CAST(e.frequency AS INTEGER) AS frequency, coalesce(a.actual, 0) AS actual,
       {sig("e.expected", MODEL_DIGITS)} AS expected
FROM expected e LEFT JOIN actual a ON CAST(e.frequency AS INTEGER) = a.frequency"""
)

ORACLE.update(
    {
        "clv_model_inputs": RETAIL_INPUTS
        + f""" SELECT customer_id, {sig('recency')} AS recency, {sig('"T"')} AS "T", frequency,
               {sig('monetary')} AS monetary FROM inputs""",
        "omni_model_inputs": OMNI_CAPPED_FULL
        + f""" SELECT customer_id, {sig('recency_clv_weekly')} AS recency_clv_weekly,
               {sig('"T_weekly"')} AS "T_weekly", {sig('frequency')} AS frequency,
               {sig('monetary_clv_avg')} AS monetary_clv_avg FROM omni_inputs""",
        "bgnbd_score": RETAIL_INPUTS
        + " SELECT customer_id, "
        + ", ".join(f"{sig(e, MODEL_DIGITS)} AS {name}" for name, e in RETAIL_E.items())
        + " FROM inputs",
        "bgnbd_score_steep": RETAIL_INPUTS
        + " SELECT customer_id, "
        + ", ".join(
            f"{sig(expected_sql(t, 'frequency', 'recency', '\"T\"', BG_STEEP), MODEL_DIGITS)} AS {name}"
            for name, t in RETAIL_TIMES.items()
        )
        + " FROM inputs",
        "gg_profit": RETAIL_INPUTS
        + f" SELECT customer_id, {sig(profit_sql('frequency', 'monetary'), MODEL_DIGITS)} AS expected_average_profit FROM inputs",
        "clv_discounted": RETAIL_INPUTS
        + f""" SELECT customer_id, {sig(clv_sql(3, "frequency", "recency", '"T"', "monetary"), MODEL_DIGITS)} AS clv
             FROM inputs""",
        "clv_merged": RETAIL_INPUTS
        + f""" SELECT customer_id, i.frequency, kept.clv FROM inputs AS i LEFT JOIN (
               SELECT customer_id, {sig(clv_sql(3, "frequency", "recency", '"T"', "monetary"), MODEL_DIGITS)} AS clv
               FROM inputs WHERE frequency >= 3) AS kept USING (customer_id)""",
        "preview_size": "WITH " + INVOICE_LINES + " SELECT count(*) AS rows FROM (SELECT * FROM invoice_lines LIMIT 5)",
        "expected_total": RETAIL_INPUTS
        + f""" SELECT count(*) AS customers,
               {sig(f'sum({RETAIL_E["expected_purc_1_month"]})', MODEL_DIGITS)} AS expected_purc_1_month_total,
               {sig(f'sum({RETAIL_E["expected_purc_3_month"]})', MODEL_DIGITS)} AS expected_purc_3_month_total
             FROM inputs""",
        "sub_segments": OMNI_SEGMENTED
        + f" SELECT customer_id, {sig('clv', MODEL_DIGITS)} AS clv, clv_segment FROM segmented",
        "calibration": CALIBRATION,
    }
)


# --- events and KPIs ------------------------------------------------------------

EVENT_RECENCY = """
WITH p AS (
  SELECT user_id, max(ts) AS last_ts, count(*) AS purchases, round(sum(value), 2) AS value
  FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL GROUP BY 1
),
ad AS (SELECT date_trunc('day', max(last_ts)) + INTERVAL 2 DAY AS analysis_date FROM p)
SELECT user_id,
       CAST(floor(date_diff('microsecond', last_ts, analysis_date) / 86400000000.0) AS BIGINT) AS recency,
       purchases, value
FROM p, ad"""

MONTHS = """
  SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
                                INTERVAL 1 MONTH)) AS month
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL"""

KPI_ACQUISITION = f"""
WITH firsts AS (
  SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS month FROM orders
  WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1
),
calendar AS ({MONTHS}),
per_month AS (
  SELECT calendar.month, count(o_custkey) AS new_customers
  FROM calendar LEFT JOIN firsts ON firsts.month = calendar.month GROUP BY calendar.month
),
running AS (
  SELECT month, new_customers,
         sum(new_customers) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS customers_to_date
  FROM per_month
)
SELECT strftime(month, '%Y-%m') AS period, new_customers, CAST(customers_to_date AS BIGINT) AS customers_to_date,
       {sig("new_customers / customers_to_date")} AS acquisition_rate
FROM running"""

KPI_RETENTION_BASE = f"""
WITH active AS (
  SELECT DISTINCT o_custkey AS customer_id, date_trunc('month', o_orderdate) AS month
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
),
flagged AS (
  SELECT *, lag(month) OVER (PARTITION BY customer_id ORDER BY month) = month - INTERVAL 1 MONTH AS retained
  FROM active
),
calendar AS ({MONTHS}),
per_month AS (
  SELECT calendar.month, count(customer_id) AS active_customers,
         CAST(count_if(coalesce(retained, false)) AS BIGINT) AS retained_customers
  FROM calendar LEFT JOIN flagged ON flagged.month = calendar.month GROUP BY calendar.month
),
rates AS (
  SELECT p.month, p.active_customers, p.retained_customers,
         CASE WHEN q.active_customers > 0 THEN p.retained_customers / CAST(q.active_customers AS DOUBLE) END AS retention_rate
  FROM per_month p LEFT JOIN per_month q ON q.month + INTERVAL 1 MONTH = p.month
)"""

KPI_CONVERSION = f"""
WITH per_user AS (
  SELECT user_id, date_trunc('month', ts) AS month, max(event_type = 'purchase') AS converted
  FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2
)
SELECT strftime(month, '%Y-%m') AS period, count(*) AS visitors, CAST(count_if(converted) AS BIGINT) AS converted,
       {sig("count_if(converted) / count(*)")} AS conversion_rate
FROM per_user GROUP BY month"""

ORACLE.update(
    {
        "event_recency_days": EVENT_RECENCY,
        "kpi_acquisition": KPI_ACQUISITION,
        "kpi_retention": KPI_RETENTION_BASE
        + f""" SELECT strftime(month, '%Y-%m') AS period, active_customers, retained_customers,
               {sig("retention_rate")} AS retention_rate, {sig("1.0::DOUBLE - retention_rate")} AS churn_rate
             FROM rates""",
        "kpi_churn": KPI_RETENTION_BASE
        + f""" SELECT strftime(month, '%Y-%m') AS period, {sig("1.0::DOUBLE - retention_rate")} AS churn_rate
             FROM rates""",
        "kpi_conversion": KPI_CONVERSION,
    }
)


# --- further profiles, ranks, reports and top-k lists -----------------------------

ORACLE.update(
    {
        "frequency_ranks": RFM_METRICS
        + """ SELECT customer_id, frequency,
               row_number() OVER (ORDER BY frequency, customer_id) AS frequency_rank FROM metrics""",
        "category_values": "WITH " + CUSTOMER_SUMMARY
        + " SELECT DISTINCT interested_in_categories_12 FROM summary",
        "omni_clv_segment_report": OMNI_SEGMENTED
        + " SELECT clv_segment, count(clv) AS clv_count, "
        + sig("avg(clv)", MODEL_DIGITS)
        + " AS clv_mean FROM segmented GROUP BY clv_segment",
    }
)


ORACLE.update(
    {
        "latest_dates": "WITH "
        + INVOICE_LINES
        + ", "
        + CUSTOMER_SUMMARY
        + """ SELECT CAST((SELECT max("InvoiceDate") FROM invoice_lines) AS VARCHAR) AS latest_invoice_date,
                 CAST((SELECT max(last_order_date) FROM summary) AS VARCHAR) AS latest_order_date""",
        "table_shape": "WITH "
        + INVOICE_LINES
        + " SELECT count(*) AS rows, 8 AS columns FROM invoice_lines",
    }
)


ORACLE.update(
    {
        "omni_top_orders": "WITH "
        + CUSTOMER_SUMMARY
        + """ SELECT master_id, order_num_total, customer_value_total FROM prep
             ORDER BY order_num_total DESC, master_id LIMIT 10""",
        "top_expected_sales": OMNI_CAPPED_FULL
        + f""" SELECT customer_id, {sig("value", MODEL_DIGITS)} AS exp_sales_3_month FROM (
               SELECT customer_id, {expected_sql(12.0, "frequency", "recency_clv_weekly", '"T_weekly"')} AS value
               FROM omni_inputs)
             ORDER BY value DESC, customer_id LIMIT 10""",
        "top_expected_profit": RETAIL_INPUTS
        + f""" SELECT customer_id, {sig("value", MODEL_DIGITS)} AS expected_average_profit FROM (
               SELECT customer_id, {profit_sql('frequency', 'monetary')} AS value FROM inputs)
             ORDER BY value DESC, customer_id LIMIT 10""",
    }
)


def _predicted_report() -> str:
    measures = list(RETAIL_E) + ["expected_average_profit", "clv"]
    exprs = dict(RETAIL_E)
    exprs["expected_average_profit"] = profit_sql("frequency", "monetary")
    exprs["clv"] = clv_sql(3, "frequency", "recency", '"T"', "monetary")
    cols = []
    for m in measures:
        cols += [
            f"count({m}) AS {m}_count",
            f"{sig(f'avg({m})', MODEL_DIGITS)} AS {m}_mean",
            f"{sig(f'sum({m})', MODEL_DIGITS)} AS {m}_sum",
        ]
    scored = ", ".join(f"{exprs[m]} AS {m}" for m in measures)
    return (
        RETAIL_INPUTS
        + f""",
pred AS (SELECT customer_id, {scored} FROM inputs),
pred_edges AS (SELECT quantile_cont(clv, [0.25, 0.5, 0.75]) AS e FROM pred),
pred_seg AS (SELECT pred.*, {_qcut_case("clv", "e", ["D", "C", "B", "A"])} AS segment FROM pred, pred_edges)
SELECT segment, {", ".join(cols)} FROM pred_seg GROUP BY segment"""
    )


ORACLE["predicted_clv_segment_report"] = _predicted_report()


ORACLE["invoice_bill"] = (
    "WITH "
    + INVOICE_LINES
    + """ SELECT "Invoice", round_even(sum("Quantity" * "Price"), 2) AS bill
    FROM invoice_lines WHERE "Invoice" IS NOT NULL GROUP BY "Invoice" """
)


# --- fit objectives and pipelines at fixed parameters -------------------------------

BGNBD_POINTS = [BG, BG_STEEP, {"r": 0.05, "alpha": 0.4, "a": 0.02, "b": 0.3}, {"r": 3.0, "alpha": 30.0, "a": 1.0, "b": 20.0}]
GG_POINTS = [GG, {"p": 1.0, "q": 1.5, "v": 100.0}, {"p": 0.3, "q": 0.2, "v": 2.0}]


def _bgnbd_point(i: int, bg: dict) -> str:
    """Penalised mean negative log-likelihood: the two ways to the last purchase, added as they stand."""
    r, alpha, a, b = (d(bg[k]) for k in ("r", "alpha", "a", "b"))
    common = f"lgamma({r} + x) - lgamma({r}) + {r} * ln({alpha}) - (lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
    alive = f"lgamma({a}) + lgamma({b} + x) - lgamma({a} + {b} + x) - ({r} + x) * ln({alpha} + age)"
    gone = f"lgamma({a} + 1) + lgamma({b} + x - 1) - lgamma({a} + {b} + x) - ({r} + x) * ln({alpha} + tx)"
    both = f"greatest({alive}, {gone}) + ln(1.0::DOUBLE + exp(-abs({alive} - ({gone}))))"
    ll = f"{common} + CASE WHEN x > 0 THEN {both} ELSE {alive} END"
    penalty = 0.001 * sum(v * v for v in bg.values())
    return f"SELECT {i} AS point, {sig(f'-avg({ll}) + {d(penalty)}', MODEL_DIGITS)} AS objective FROM rows"


def _gg_point(i: int, gg: dict) -> str:
    p, q, v = (d(gg[k]) for k in ("p", "q", "v"))
    ll = (
        f"lgamma({p} * x + {q}) - lgamma({p} * x) - lgamma({q}) + {q} * ln({v})"
        f" + ({p} * x - 1) * ln(m) + {p} * x * ln(x) - ({p} * x + {q}) * ln(x * m + {v})"
    )
    penalty = 0.01 * sum(w * w for w in gg.values())
    return f"SELECT {i} AS point, {sig(f'-avg({ll}) + {d(penalty)}', MODEL_DIGITS)} AS objective FROM rows"


def _pipeline_sql(inputs: str, source: str, measures: dict[str, str], segment: str) -> str:
    exprs = ", ".join(f"{e} AS {name}" for name, e in measures.items())
    out = ", ".join(f"{sig(name, MODEL_DIGITS)} AS {name}" for name in measures)
    return (
        inputs
        + f""",
pred AS (SELECT customer_id, {exprs} FROM {source}),
pred_edges AS (SELECT quantile_cont(clv, [0.25, 0.5, 0.75]) AS e FROM pred)
SELECT customer_id, {out}, {_qcut_case("clv", "e", ["D", "C", "B", "A"])} AS {segment} FROM pred, pred_edges"""
    )


ORACLE.update(
    {
        "bgnbd_objective": RETAIL_INPUTS
        + ', rows AS (SELECT CAST(frequency AS DOUBLE) AS x, recency AS tx, "T" AS age FROM inputs) '
        + " UNION ALL ".join(_bgnbd_point(i, bg) for i, bg in enumerate(BGNBD_POINTS)),
        "gg_objective": RETAIL_INPUTS
        + ", rows AS (SELECT CAST(frequency AS DOUBLE) AS x, monetary AS m FROM inputs) "
        + " UNION ALL ".join(_gg_point(i, gg) for i, gg in enumerate(GG_POINTS)),
        "clv_pipeline_retail": _pipeline_sql(
            RETAIL_INPUTS,
            "inputs",
            {
                **RETAIL_E,
                "expected_average_profit": profit_sql("frequency", "monetary"),
                "clv": clv_sql(3, "frequency", "recency", '"T"', "monetary"),
            },
            "segment",
        ),
        "clv_pipeline_omni": _pipeline_sql(
            OMNI_CAPPED_FULL,
            "omni_inputs",
            {
                "exp_sales_3_month": expected_sql(12.0, "frequency", "recency_clv_weekly", '"T_weekly"'),
                "exp_sales_6_month": expected_sql(24.0, "frequency", "recency_clv_weekly", '"T_weekly"'),
                "exp_average_value": profit_sql("frequency", "monetary_clv_avg"),
                "clv": clv_sql(6, "frequency", "recency_clv_weekly", '"T_weekly"', "monetary_clv_avg"),
            },
            "clv_segment",
        ),
    }
)


ORACLE.update(
    {
        "targets_by_ids": OMNI_SCORED
        + """ SELECT master_id, order_channel, last_order_channel FROM summary
             WHERE master_id IN (SELECT customer_id FROM scored
               WHERE segment IN ('champions', 'loyal_customers')
                 AND coalesce(contains(interested_in_categories_12, 'PROMO'), false))""",
        "text_dates": """SELECT o_custkey,
               CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS BIGINT) AS days
             FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey""",
    }
)
