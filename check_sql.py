"""SQL over the given tables that states what each query must return."""

from __future__ import annotations

from fixture_views import CSV_EXTRA, FOREST_CLASSES, FOREST_FEATURES, LINES, QUOTED, RAW, duck_text, forest_nodes

# Texts read as missing.
NA = ("('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', "
      "'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')")

HARM = "(price <= 0 OR quantity <= 0 OR price < CAST(0.1 AS DOUBLE) OR quantity > 10000)"


def text(c: str) -> str:
    stripped = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN {stripped} NOT IN {NA} THEN {stripped} END"


def number(c: str) -> str:
    return rf"try_cast(regexp_replace({c}, '^\s+|\s+$', '', 'g') AS DOUBLE)"


def double_text(c: str) -> str:
    """A double as its multiple of 2^-20 and the rest in 2^-80."""
    units = f"round_even({c} * 1048576.0::DOUBLE, 0)"
    rest = f"round_even(({c} - {units} / 1048576.0::DOUBLE) * pow(2.0::DOUBLE, 80), 0)"
    return f"concat(CAST({units} AS HUGEINT), ':', CAST({rest} AS BIGINT))"


def query(select: str, **ctes: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ctes.items()) + "\n" + select


# ---- shared parts -------------------------------------------------------------------------------------------------
L = {
    "lines": duck_text(LINES),
    "l": f"SELECT *, {HARM} AS harmful FROM lines",
    "li": "SELECT * FROM l WHERE invoice_id IS NOT NULL AND date IS NOT NULL AND customer_id IS NOT NULL AND customer_type IS NOT NULL",
}
FENCES = {
    **L,
    "f": """SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS qlo, q3 + 1.5::DOUBLE * (q3 - q1) AS qhi, t1 - 1.5::DOUBLE * (t3 - t1) AS tlo, t3 + 1.5::DOUBLE * (t3 - t1) AS thi
 FROM (SELECT quantile_cont(quantity, 0.25) q1, quantile_cont(quantity, 0.75) q3,
  quantile_cont(CAST(line_total AS DOUBLE), 0.25) t1, quantile_cont(CAST(line_total AS DOUBLE), 0.75) t3 FROM lines)""",
    "fl": """SELECT l.*, CAST(line_total AS DOUBLE) < tlo OR CAST(line_total AS DOUBLE) > thi AS is_outlier,
  (lower(coalesce(customer_type, '')) = 'wholesaler' AND quantity > qhi) OR (CAST(line_total AS DOUBLE) > thi AND NOT harmful) AS is_strategic FROM l, f""",
    "fi": "SELECT * FROM fl WHERE customer_type IS NOT NULL",
}
INV = {
    **L,
    "inv": """SELECT invoice_id, date, customer_id, customer_type, CAST(sum(line_total) AS DOUBLE) AS invoice_revenue, sum(quantity) AS total_qty,
 fsum(price) / count(price) AS avg_price, count(DISTINCT product_id) AS n_items
 FROM li GROUP BY invoice_id, date, customer_id, customer_type""",
}
DOMINANT = {
    "cat_rev": "SELECT invoice_id, category, sum(line_total) AS rev FROM lines WHERE category IS NOT NULL GROUP BY invoice_id, category",
    "dom": """SELECT invoice_id, category AS dominant_category FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY rev DESC, category) AS rn FROM cat_rev)
 WHERE rn = 1""",
}
LABELS = {
    **INV,
    "q": """SELECT quantile_cont(invoice_revenue, 0.01) AS p01, quantile_cont(invoice_revenue, 0.99) AS p99,
 quantile_cont(invoice_revenue, 0.75) + 1.5::DOUBLE * (quantile_cont(invoice_revenue, 0.75) - quantile_cont(invoice_revenue, 0.25)) AS rhi,
 quantile_cont(total_qty, 0.75) + 1.5::DOUBLE * (quantile_cont(total_qty, 0.75) - quantile_cont(total_qty, 0.25)) AS qhi FROM inv""",
    "lab1": """SELECT inv.*, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, isodow(date) IN (6, 7) AS is_weekend,
 month(date) IN (9, 10, 11) AS is_peak_season, month(date) IN (1, 2) AS is_off_season,
 invoice_revenue >= p99 OR invoice_revenue <= p01 AS is_statistical_outlier,
 total_qty <= 0 OR avg_price <= 0 OR avg_price < CAST(0.1 AS DOUBLE) OR total_qty > 10000 AS is_harmful, rhi, qhi FROM inv, q""",
    "lab2": """SELECT *, (lower(customer_type) = 'wholesaler' AND total_qty > qhi) OR (invoice_revenue > rhi AND NOT is_harmful) AS is_strategic FROM lab1""",
    "lab3": """SELECT * EXCLUDE (rhi, qhi), is_statistical_outlier AND lower(customer_type) = 'private' AND NOT is_harmful AND NOT is_strategic AND total_qty <= qhi AS is_benign FROM lab2""",
    "lab": """SELECT *, CASE WHEN is_harmful THEN 'Harmful' WHEN is_strategic THEN 'Strategic' WHEN is_benign THEN 'Benign' ELSE 'Normal' END AS outlier_class FROM lab3""",
}
MODEL = {
    **LABELS,
    **DOMINANT,
    "model": "SELECT lab.*, dominant_category FROM lab LEFT JOIN dom USING (invoice_id) WHERE is_statistical_outlier",
    "m3": "SELECT * FROM model WHERE outlier_class IN ('Harmful', 'Benign', 'Strategic')",
}
TURN = "CASE outlier_class WHEN 'Harmful' THEN 'Benign' WHEN 'Benign' THEN 'Strategic' ELSE 'Harmful' END"
PREDICTED = {
    **MODEL,
    "p": f"SELECT *, outlier_class AS true_class, CASE WHEN invoice_id % 7 = 0 THEN {TURN} ELSE outlier_class END AS pred_class FROM m3",
}
RULED = {
    **PREDICTED,
    "pf": """SELECT quantile_cont(invoice_revenue, 0.75) + 1.5::DOUBLE * (quantile_cont(invoice_revenue, 0.75) - quantile_cont(invoice_revenue, 0.25)) AS prhi,
 quantile_cont(total_qty, 0.75) + 1.5::DOUBLE * (quantile_cont(total_qty, 0.75) - quantile_cont(total_qty, 0.25)) AS pqhi FROM p""",
    "ruled": """SELECT p.*, CASE WHEN avg_price <= 0 OR avg_price < CAST(0.1 AS DOUBLE) OR total_qty > 10000 OR total_qty <= 0 THEN 'Harmful'
 WHEN (lower(customer_type) = 'wholesaler' AND total_qty > pqhi) OR (is_peak_season AND invoice_revenue > prhi) THEN 'Strategic' END AS rule_class FROM p, pf""",
}


def split_ctes(share: str) -> dict[str, str]:
    return {
        **MODEL,
        "n_class": "SELECT outlier_class, count(*) AS n FROM m3 GROUP BY outlier_class",
        "quota0": f"SELECT outlier_class, n, n * ceil({share}::DOUBLE * sum(n) OVER ()) / sum(n) OVER () AS exact, ceil({share}::DOUBLE * sum(n) OVER ()) AS total FROM n_class",
        "quota1": """SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, outlier_class) AS place,
 total - sum(floor(exact)) OVER () AS spare FROM quota0""",
        "quota": "SELECT outlier_class, base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS take FROM quota1",
        "placed": """SELECT *, row_number() OVER (PARTITION BY outlier_class ORDER BY md5(concat(CAST(invoice_id AS VARCHAR), '-42'))) AS rn FROM m3""",
        "split": "SELECT placed.*, rn <= take AS is_test FROM placed JOIN quota USING (outlier_class)",
    }


# ---- KPI reports --------------------------------------------------------------------------------------------------
def _kpis(source: str, scope: str | None = None) -> str:
    key = f"{scope}, " if scope else ""
    group = f" GROUP BY {scope}" if scope else ""
    return (f"SELECT {key}CAST(sum(line_total) AS DOUBLE) AS r, count(DISTINCT invoice_id) AS i, count(DISTINCT customer_id) AS c "
            f"FROM {source}{group}")


_ROWS = """SELECT {key}1 AS o, 'Total_Revenue' AS "KPI", coalesce(a.r, 0.0) AS w, coalesce(b.r, 0.0) AS wo {src}
UNION ALL SELECT {key}2, 'AOV', coalesce(a.r / nullif(a.i, 0), 0.0), coalesce(b.r / nullif(b.i, 0), 0.0) {src}
UNION ALL SELECT {key}3, 'Revenue_per_Customer', coalesce(a.r / nullif(a.c, 0), 0.0), coalesce(b.r / nullif(b.c, 0), 0.0) {src}"""
_DIST = """"KPI", w AS "With_Harmful", wo AS "Without_Harmful", abs(coalesce((w - wo) / nullif(wo, 0) * 100.0::DOUBLE, 0.0)) AS "Distortion_Magnitude_%",
 coalesce((w - wo) / nullif(wo, 0) * 100.0::DOUBLE, 0.0) AS "Distortion_Direction_%" """


# Means are compared to six decimals: the engines divide sums that may differ in the last bit.
_SHOWN = "* REPLACE (round(avg_price, 6) AS avg_price)"


def _series(unit: str) -> dict[str, str]:
    return {
        **L,
        "a": f"SELECT CAST(date_trunc('{unit}', date) AS TIMESTAMP) AS date, CAST(sum(line_total) AS DOUBLE) AS with_harmful FROM li GROUP BY 1",
        "b": f"SELECT CAST(date_trunc('{unit}', date) AS TIMESTAMP) AS date, CAST(sum(line_total) AS DOUBLE) AS without_harmful FROM li WHERE NOT harmful GROUP BY 1",
    }


SQL: dict[str, str] = {
    "distortion_summary": query(
        f"""SELECT {_DIST}, CASE WHEN w > wo AND wo <> 0 THEN 'Overestimation' WHEN w < wo AND wo <> 0 THEN 'Underestimation' ELSE 'No change' END AS "Direction_Label" FROM x""",
        **L, a=_kpis("li"), b=_kpis("li WHERE NOT harmful"), x=_ROWS.format(key="", src="FROM a, b")),
    "distortion_by_segment": query(
        f"SELECT customer_type, {_DIST} FROM x", **L, a=_kpis("li", "customer_type"),
        b=_kpis("(SELECT * FROM li WHERE NOT harmful)", "customer_type"),
        x=_ROWS.format(key="customer_type, ", src="FROM a LEFT JOIN b USING (customer_type)")),
    "kpi_set": query(
        """SELECT coalesce(r, 0.0) AS "Total_Revenue", coalesce(r / nullif(i, 0), 0.0) AS "AOV", coalesce(r / nullif(c, 0), 0.0) AS "Revenue_per_Customer", i AS "Invoices", c AS "Customers" FROM a""",
        **L, a=_kpis("li")),
    "kpi_set_double": query(
        """SELECT round(coalesce(r, 0.0), 3) AS "Total_Revenue", round(coalesce(r / nullif(i, 0), 0.0), 6) AS "AOV", round(coalesce(r / nullif(c, 0), 0.0), 6) AS "Revenue_per_Customer", i AS "Invoices", c AS "Customers" FROM (
 SELECT fsum(CAST(line_total AS DOUBLE) / 7000003.0::DOUBLE) AS r, count(DISTINCT invoice_id) AS i, count(DISTINCT customer_id) AS c FROM li)""", **L),
    "rq2_meta": query(
        """SELECT n AS "Rows_total", h AS "Harmful_rows", CAST(h AS DOUBLE) / CAST(n AS DOUBLE) * 100.0::DOUBLE AS "Harmful_rate_%", i AS "Invoices_total", c AS "Customers_total" FROM a, b""",
        **L, a=_kpis("li"), b="SELECT count(*) AS n, count(*) FILTER (WHERE harmful) AS h FROM l"),
    "rq2_invoice_level": query(
        """SELECT invoice_id, date, dayname(date) AS day_name, customer_id, customer_type, CAST(sum(line_total) AS DOUBLE) AS revenue,
 count(DISTINCT product_id) AS items, sum(quantity) AS qty FROM li GROUP BY invoice_id, date, customer_id, customer_type""", **L),
    "rq3_invoice_level": query(
        """SELECT invoice_id, date, customer_id, customer_type, CAST(sum(line_total) AS DOUBLE) AS revenue FROM li
 GROUP BY invoice_id, date, customer_id, customer_type""", **L),
    "top_harmful": query(
        """SELECT invoice_id, date, customer_id, customer_type, product_id, category, quantity, price, line_total FROM l WHERE harmful
 ORDER BY line_total DESC, invoice_id, date, customer_id, customer_type NULLS LAST, product_id, category NULLS LAST, quantity, price LIMIT 20""", **L),
    "dow_profile": query(
        "SELECT dayname(date) AS day_name, count(DISTINCT invoice_id) AS invoices, CAST(sum(line_total) AS DOUBLE) AS revenue FROM li GROUP BY 1", **L),
    "daily_revenue": query("SELECT date, with_harmful, without_harmful FROM a JOIN b USING (date)", **_series("day")),
    "weekly_distortion": query(
        """SELECT date AS week, with_harmful, without_harmful, abs(coalesce((with_harmful - without_harmful) / nullif(without_harmful, 0) * 100.0::DOUBLE, 0.0)) AS "Distortion_Magnitude_%",
 coalesce((with_harmful - without_harmful) / nullif(without_harmful, 0) * 100.0::DOUBLE, 0.0) AS "Distortion_Direction_%" FROM a JOIN b USING (date)""", **_series("week")),
    "line_total_histogram": query(
        """SELECT e.series, e.bin, e.lo AS bin_start, e.hi AS bin_end, count(x.x) AS count FROM edges e
 LEFT JOIN x ON x.series = e.series AND (x.x >= e.lo OR e.bin = 0) AND (x.x < e.hi OR e.bin = 49) GROUP BY ALL""",
        **L, x="SELECT CASE WHEN harmful THEN 'Harmful' ELSE 'Non-harmful' END AS series, CAST(line_total AS DOUBLE) AS x FROM l",
        r="SELECT series, min(x) AS a, max(x) AS b FROM x GROUP BY series",
        edges="""SELECT series, CAST(i AS INTEGER) AS bin, i * ((b - a) / 50) + a AS lo, CASE WHEN i = 49 THEN b ELSE (i + 1) * ((b - a) / 50) + a END AS hi
 FROM r, range(50) t(i)"""),
    # ---- blanket against context-aware removal
    "flag_harmful_lines": query("SELECT invoice_id, product_id, quantity, price, line_total, harmful AS is_harmful FROM l", **L),
    "flag_stat_outlier_lines": query("SELECT invoice_id, product_id, quantity, price, line_total, is_outlier FROM fl", **FENCES),
    "flag_strategic_lines": query("SELECT invoice_id, product_id, customer_type, quantity, price, line_total, is_strategic FROM fl", **FENCES),
    "quantiles": query(
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, {p}::DOUBLE AS p, quantile_cont(CAST({c} AS DOUBLE), {p}) AS value FROM lines"
                           for c in ("quantity", "line_total") for p in (0.01, 0.25, 0.5, 0.75, 0.99)), lines=L["lines"]),
    "iqr_bounds": query(
        "SELECT 'quantity' AS column_name, qlo AS low, qhi AS high FROM f UNION ALL SELECT 'line_total', tlo, thi FROM f",
        **{k: FENCES[k] for k in ("lines", "f")}),
    "trimmed_mean": query(
        """SELECT CAST(sum(revenue) AS DOUBLE) / count(*) AS trimmed_mean FROM s WHERE rn > k AND rn <= n - k""",
        **L, i="SELECT sum(line_total) AS revenue FROM li GROUP BY invoice_id, date, customer_id, customer_type",
        s="SELECT revenue, row_number() OVER (ORDER BY revenue) AS rn, count(*) OVER () AS n, floor(count(*) OVER () * 0.05::DOUBLE) AS k FROM i"),
    "aov_comparison": query(
        """SELECT *, coalesce(("Baseline_Error_Magnitude" - "Context_Error_Magnitude") / nullif("Baseline_Error_Magnitude", 0), 0.0) * 100.0::DOUBLE AS "Improvement_Rate_%",
 coalesce(("AOV_Blanket" - "AOV_GroundTruth_Trimmed") / nullif("AOV_GroundTruth_Trimmed", 0), 0.0) * 100.0::DOUBLE AS "Baseline_Bias_%",
 coalesce(("AOV_ContextAware" - "AOV_GroundTruth_Trimmed") / nullif("AOV_GroundTruth_Trimmed", 0), 0.0) * 100.0::DOUBLE AS "Context_Bias_%" FROM (
 SELECT *, coalesce(abs("AOV_Blanket" - "AOV_GroundTruth_Trimmed") / nullif("AOV_GroundTruth_Trimmed", 0), 0.0) AS "Baseline_Error_Magnitude",
 coalesce(abs("AOV_ContextAware" - "AOV_GroundTruth_Trimmed") / nullif("AOV_GroundTruth_Trimmed", 0), 0.0) AS "Context_Error_Magnitude" FROM (
 SELECT a.v AS "AOV_Blanket", b.v AS "AOV_ContextAware", g.v AS "AOV_GroundTruth_Trimmed" FROM a, b, g))""",
        **FENCES,
        a="SELECT coalesce(CAST(sum(line_total) AS DOUBLE) / nullif(count(DISTINCT invoice_id), 0), 0.0) AS v FROM fi WHERE NOT is_outlier",
        b="SELECT coalesce(CAST(sum(line_total) AS DOUBLE) / nullif(count(DISTINCT invoice_id), 0), 0.0) AS v FROM fi WHERE NOT harmful",
        i="SELECT sum(line_total) AS revenue FROM fi WHERE NOT harmful GROUP BY invoice_id, date, customer_id, customer_type",
        s="SELECT revenue, row_number() OVER (ORDER BY revenue) AS rn, count(*) OVER () AS n, floor(count(*) OVER () * 0.05::DOUBLE) AS k FROM i",
        g="SELECT coalesce(CAST(sum(revenue) AS DOUBLE) / nullif(count(*), 0), 0.0) AS v FROM s WHERE rn > k AND rn <= n - k"),
    "revenue_bias": query(
        """SELECT b AS "Revenue_Blanket", c AS "Revenue_ContextAware", b - c AS "Revenue_Difference", coalesce((b - c) / nullif(c, 0), 0.0) * 100.0::DOUBLE AS "Revenue_Bias_%" FROM (
 SELECT coalesce(CAST(sum(line_total) FILTER (WHERE NOT is_outlier) AS DOUBLE), 0.0) AS b, coalesce(CAST(sum(line_total) FILTER (WHERE NOT harmful) AS DOUBLE), 0.0) AS c FROM fi)""",
        **FENCES),
    "retention_overall": query(
        """SELECT o AS "Total_Outlier_Revenue", s AS "Retained_Strategic_Revenue", coalesce(s / nullif(o, 0), 0.0) * 100.0::DOUBLE AS "Strategic_Revenue_Retention_Rate_%" FROM (
 SELECT coalesce(CAST(sum(line_total) FILTER (WHERE is_outlier) AS DOUBLE), 0.0) AS o, coalesce(CAST(sum(line_total) FILTER (WHERE is_outlier AND is_strategic) AS DOUBLE), 0.0) AS s FROM fl)""",
        **FENCES),
    "retention_by_month": query(
        """SELECT month, o AS "Total_Outlier_Revenue", s AS "Retained_Strategic_Revenue", coalesce(s / nullif(o, 0), 0.0) * 100.0::DOUBLE AS "Strategic_Revenue_Retention_Rate_%" FROM (
 SELECT CAST(date_trunc('month', date) AS TIMESTAMP) AS month, coalesce(CAST(sum(line_total) AS DOUBLE), 0.0) AS o,
 coalesce(CAST(sum(line_total) FILTER (WHERE is_strategic) AS DOUBLE), 0.0) AS s FROM fl WHERE is_outlier GROUP BY 1)""", **FENCES),
    "retention_by_segment": query(
        """SELECT customer_type, retained_strategic_revenue, retained_strategic_revenue / nullif((SELECT CAST(sum(line_total) AS DOUBLE) FROM kept), 0) * 100.0::DOUBLE AS "share_%" FROM (
 SELECT customer_type, CAST(sum(line_total) AS DOUBLE) AS retained_strategic_revenue FROM kept GROUP BY customer_type)""",
        **FENCES, kept="SELECT * FROM fi WHERE is_outlier AND is_strategic"),
    "retention_by_category": query(
        """SELECT category, CAST(sum(line_total) AS DOUBLE) AS retained_strategic_revenue FROM fl WHERE is_outlier AND is_strategic AND category IS NOT NULL
 GROUP BY category ORDER BY 2 DESC, 1 LIMIT 15""", **FENCES),
    "top_strategic": query(
        """SELECT invoice_id, date, customer_id, customer_type, product_id, category, quantity, price, product_price, line_total FROM fl WHERE is_outlier AND is_strategic
 ORDER BY line_total DESC, invoice_id, date, customer_id, customer_type NULLS LAST, product_id, category NULLS LAST, quantity, price, product_price LIMIT 30""", **FENCES),
    "monthly_comparison": query(
        """SELECT coalesce(a.month, b.month) AS month, coalesce(blanket_revenue, 0.0) AS blanket_revenue, coalesce(context_revenue, 0.0) AS context_revenue
 FROM a FULL JOIN b ON a.month = b.month""", **FENCES,
        a="SELECT CAST(date_trunc('month', date) AS TIMESTAMP) AS month, CAST(sum(line_total) AS DOUBLE) AS blanket_revenue FROM fi WHERE NOT is_outlier GROUP BY 1",
        b="SELECT CAST(date_trunc('month', date) AS TIMESTAMP) AS month, CAST(sum(line_total) AS DOUBLE) AS context_revenue FROM fi WHERE NOT harmful GROUP BY 1"),
    "scatter_series": query(
        """SELECT 'Normal' AS series, quantity, price FROM sf WHERE NOT o
 UNION ALL SELECT 'Outlier (benign)', quantity, price FROM sf WHERE o AND NOT h AND NOT s
 UNION ALL SELECT 'Outlier (strategic)', quantity, price FROM sf WHERE o AND s
 UNION ALL SELECT 'Outlier (harmful)', quantity, price FROM sf WHERE h""",
        **L,
        smp=rf"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id, customer_type, product_id, quantity, price, line_total) AS copy FROM l)
 ORDER BY md5(concat(concat_ws('|', CAST(invoice_id AS VARCHAR), coalesce(customer_type, '\N'), CAST(product_id AS VARCHAR), {double_text('quantity')},
 {double_text('price')}, CAST(line_total AS VARCHAR)), '#', copy, '-42')) LIMIT 20000""",
        f="""SELECT q3 + 1.5::DOUBLE * (q3 - q1) AS qhi, t1 - 1.5::DOUBLE * (t3 - t1) AS tlo, t3 + 1.5::DOUBLE * (t3 - t1) AS thi
 FROM (SELECT quantile_cont(quantity, 0.25) q1, quantile_cont(quantity, 0.75) q3,
  quantile_cont(CAST(line_total AS DOUBLE), 0.25) t1, quantile_cont(CAST(line_total AS DOUBLE), 0.75) t3 FROM smp)""",
        sf="""SELECT quantity, price, harmful AS h, CAST(line_total AS DOUBLE) < tlo OR CAST(line_total AS DOUBLE) > thi AS o,
 (lower(coalesce(customer_type, '')) = 'wholesaler' AND quantity > qhi) OR (CAST(line_total AS DOUBLE) > thi AND NOT harmful) AS s FROM smp, f"""),
    # ---- classifier data
    "rq1_invoice_features": query(f"SELECT {_SHOWN} FROM inv", **INV),
    "dominant_category": query("SELECT * FROM dom", lines=L["lines"], **DOMINANT),
    "rq1_labels": query(f"SELECT {_SHOWN} FROM lab", **LABELS),
    "rq1_model_dataset": query(f"SELECT {_SHOWN} FROM model", **MODEL),
    "class_filter": query("SELECT invoice_id, outlier_class FROM m3", **MODEL),
    "class_distribution": query("SELECT outlier_class, count(*) AS count FROM model GROUP BY outlier_class", **MODEL),
    "temporal_features": query(
        """SELECT invoice_id, product_id, date, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month,
 CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, dayname(date) AS day_name, isodow(date) IN (6, 7) AS is_weekend, month(date) IN (9, 10, 11) AS is_peak_season,
 month(date) IN (1, 2) AS is_off_season FROM lines""", lines=L["lines"]),
    "pricing_features": query(
        """SELECT invoice_id, product_id, quantity, price, price - product_price AS price_vs_product_price,
 (product_price - price) / nullif(product_price, 0) * 100.0::DOUBLE AS price_discount_pct, quantity * price AS calculated_line_total,
 CAST(line_total AS DOUBLE) - quantity * price AS line_total_error FROM lines""", lines=L["lines"]),
    "stratified_split": query("SELECT invoice_id, outlier_class, is_test FROM split", **split_ctes("0.2")),
    "model_features": query(
        """SELECT invoice_id, is_test, concat('customer_type_', customer_type) AS feature, 1.0::DOUBLE AS value FROM split WHERE customer_type IN (SELECT customer_type FROM split WHERE NOT is_test)
 UNION ALL SELECT invoice_id, is_test, concat('dominant_category_', coalesce(dominant_category, 'nan')), 1.0::DOUBLE FROM split
  WHERE coalesce(dominant_category, 'nan') IN (SELECT coalesce(dominant_category, 'nan') FROM split WHERE NOT is_test)
 UNION ALL SELECT invoice_id, is_test, u.k, u.v FROM (SELECT invoice_id, is_test, unnest([
  {'k': 'month', 'v': CAST(month AS DOUBLE)}, {'k': 'day_of_week', 'v': CAST(day_of_week AS DOUBLE)}, {'k': 'is_weekend', 'v': CAST(is_weekend AS DOUBLE)},
  {'k': 'is_peak_season', 'v': CAST(is_peak_season AS DOUBLE)}, {'k': 'is_off_season', 'v': CAST(is_off_season AS DOUBLE)},
  {'k': 'invoice_revenue', 'v': invoice_revenue}, {'k': 'total_qty', 'v': total_qty}, {'k': 'avg_price', 'v': round(avg_price, 6)}, {'k': 'n_items', 'v': CAST(n_items AS DOUBLE)}]) AS u FROM split)
 WHERE u.v <> 0""", **split_ctes("0.2")),
    # ---- reports on fixed predictions
    "classification_report": query(
        """SELECT label, precision, recall, f AS "f1-score", CAST(support AS DOUBLE) AS support FROM s
 UNION ALL SELECT 'accuracy', a, a, a, a FROM (SELECT CAST(sum(hits) AS DOUBLE) / sum(support) AS a FROM s)
 UNION ALL SELECT 'macro avg', list_sum(list(precision ORDER BY label)) / count(*), list_sum(list(recall ORDER BY label)) / count(*), list_sum(list(f ORDER BY label)) / count(*), CAST(sum(support) AS DOUBLE) FROM s
 UNION ALL SELECT 'weighted avg', list_sum(list(precision * support ORDER BY label)) / sum(support), list_sum(list(recall * support ORDER BY label)) / sum(support), list_sum(list(f * support ORDER BY label)) / sum(support),
  CAST(sum(support) AS DOUBLE) FROM s""",
        **PREDICTED,
        lbl="SELECT true_class AS label FROM p UNION SELECT pred_class FROM p",
        c="""SELECT label, (SELECT count(*) FROM p WHERE true_class = label AND pred_class = label) AS hits, (SELECT count(*) FROM p WHERE true_class = label) AS support,
 (SELECT count(*) FROM p WHERE pred_class = label) AS predicted FROM lbl""",
        s0="SELECT label, hits, support, coalesce(CAST(hits AS DOUBLE) / nullif(predicted, 0), 0.0) AS precision, coalesce(CAST(hits AS DOUBLE) / nullif(support, 0), 0.0) AS recall FROM c",
        s="SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f FROM s0"),
    "confusion_matrix": query(
        """SELECT concat('true_', t) AS index, count(*) FILTER (WHERE pred_class = 'Harmful') AS "pred_Harmful", count(*) FILTER (WHERE pred_class = 'Benign') AS "pred_Benign",
 count(*) FILTER (WHERE pred_class = 'Strategic') AS "pred_Strategic" FROM (SELECT unnest(['Harmful', 'Benign', 'Strategic']) AS t) LEFT JOIN p ON true_class = t GROUP BY t""",
        **PREDICTED),
    "business_rules": query("SELECT invoice_id, rule_class FROM ruled", **RULED),
    "rule_alignment": query(
        """SELECT n AS "Total_Rule_Applicable", a AS "Aligned_Cases", coalesce(CAST(a AS DOUBLE) / nullif(n, 0), 0.0) * 100.0::DOUBLE AS "Alignment_Rate_%"
 FROM (SELECT count(rule_class) AS n, count(*) FILTER (WHERE rule_class = pred_class) AS a FROM ruled)""", **RULED),
    "rule_alignment_breakdown": query(
        "SELECT rule_class, pred_class AS model_pred, count(*) AS count FROM ruled WHERE rule_class IS NOT NULL GROUP BY 1, 2", **RULED),
    "prediction_stability": query(
        """SELECT count(*) AS "Test_instances", count(*) FILTER (WHERE same) AS "Stable_predictions_count",
 CAST(count(*) FILTER (WHERE same) AS DOUBLE) / count(*) * 100.0::DOUBLE AS "Prediction_Stability_%" FROM (
 SELECT invoice_id, count(DISTINCT pred) = 1 AS same FROM (
  SELECT invoice_id, CASE WHEN (invoice_id + run) % 11 = 0 THEN """ + TURN + """ ELSE outlier_class END AS pred FROM m3, range(1, 6) t(run)) GROUP BY invoice_id)""", **MODEL),
}

# ---- rankings of a few runs, here the years of the data
_RANKED = {
    **L,
    "scores": "SELECT CAST(year(date) AS INTEGER) AS run, category AS feature, CAST(sum(line_total) AS DOUBLE) AS importance FROM lines WHERE category IS NOT NULL GROUP BY 1, 2",
    "ranked": "SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature FROM scores",
}
SQL["top_features_per_run"] = query("SELECT * FROM ranked WHERE rank <= 10", **_RANKED)
SQL["topk_jaccard"] = query(
    """SELECT round(coalesce(sum(j) / count(*), 0.0), 9) AS "Top3_Feature_Consistency_Jaccard", 'Higher = more stable explanations across retrains' AS "Interpretation" FROM (
 SELECT CAST(len(list_intersect(a.f, b.f)) AS DOUBLE) / len(list_distinct(list_concat(a.f, b.f))) AS j FROM sets a JOIN sets b ON a.run < b.run)""",
    **_RANKED, sets="SELECT run, list(feature) AS f FROM ranked WHERE rank <= 3 GROUP BY run")

# ---- feature scores under encoded names
_SCORED = {
    "lines": L["lines"],
    "scores": """SELECT concat('customer_type_', customer_type) AS feature, sum(line_total) AS importance FROM lines WHERE customer_type IS NOT NULL GROUP BY 1
 UNION ALL SELECT concat('dominant_category_', category), sum(line_total) FROM lines WHERE category IS NOT NULL GROUP BY 1
 UNION ALL SELECT 'invoice_revenue', sum(line_total) FROM lines UNION ALL SELECT 'n_items', CAST(count(*) AS DECIMAL(38,6)) FROM lines""",
    "buckets": """SELECT CASE WHEN starts_with(feature, 'customer_type_') OR starts_with(feature, 'dominant_category_') THEN 'Contextual' ELSE 'Numeric/Temporal' END AS bucket,
 CAST(sum(importance) AS DOUBLE) AS importance FROM scores GROUP BY 1""",
}
SQL["bucket_breakdown"] = query("SELECT * FROM buckets", **_SCORED)
SQL["contextual_contribution"] = query(
    """SELECT c AS "Contextual_Importance_Sum", t AS "Total_Importance_Sum", coalesce(c / nullif(t, 0), 0.0) * 100.0::DOUBLE AS "Contextual_Contribution_%" FROM (
 SELECT coalesce((SELECT importance FROM buckets WHERE bucket = 'Contextual'), 0.0) AS c, (SELECT CAST(sum(importance) AS DOUBLE) FROM scores) AS t)""", **_SCORED)

# ---- cleaning and constraints
_RAW = {f"raw_{n}": duck_text(t) for n, t in RAW.items()}
_CLEAN = {
    "customers": f"""SELECT DISTINCT {text('"CustomerID"')} AS customer_id, {text('customer_type')} AS customer_type FROM raw_customers WHERE {text('"CustomerID"')} IS NOT NULL""",
    "products": f"""SELECT DISTINCT {text('product_id')} AS product_id, CASE WHEN item NOT IN {NA} THEN item END AS item, CASE WHEN category NOT IN {NA} THEN category END AS category,
 {number('price')} AS price FROM raw_products WHERE {text('product_id')} IS NOT NULL AND {number('price')} >= 0""",
    "headers": f"""SELECT src_row, {text('"InvoiceID"')} AS invoice_id, try_strptime({text('date')}, '%Y-%m-%d') AS purchase_date, {text('"CustomerID"')} AS customer_id FROM raw_purchases""",
    "purchases": """SELECT invoice_id, purchase_date, customer_id FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY src_row, purchase_date, customer_id) AS rn
 FROM headers WHERE invoice_id IS NOT NULL AND customer_id IS NOT NULL AND purchase_date IS NOT NULL) WHERE rn = 1""",
    "invoice_items": f"""SELECT DISTINCT {text('"InvoiceID"')} AS invoice_id, {text('product_id')} AS product_id, {number('quantity')} AS quantity, {number('price')} AS unit_price,
 {number('line_total')} AS line_total FROM raw_invoice_items
 WHERE {text('"InvoiceID"')} IS NOT NULL AND {text('product_id')} IS NOT NULL AND {number('quantity')} > 0 AND {number('price')} >= 0""",
}
CLEAN = {**_RAW, **_CLEAN}
_KEYED = {
    **_RAW,
    "kc": f"""SELECT {text('"CustomerID"')} AS k FROM raw_customers""",
    "kp": f"SELECT {text('product_id')} AS k FROM raw_products",
    "kh": f"""SELECT {text('"InvoiceID"')} AS k, {text('"CustomerID"')} AS c FROM raw_purchases""",
    "ki": f"""SELECT {text('"InvoiceID"')} AS k, {text('product_id')} AS p FROM raw_invoice_items""",
}
_COUNTS = """SELECT 'customers' AS table_name, count(*) AS n_rows FROM customers UNION ALL SELECT 'products', count(*) FROM products
 UNION ALL SELECT 'purchases', count(*) FROM purchases UNION ALL SELECT 'invoice_items', count(*) FROM invoice_items"""
SQL.update({
    "clean_customers": query("SELECT * FROM customers", raw_customers=_RAW["raw_customers"], customers=_CLEAN["customers"]),
    "clean_products": query("SELECT * FROM products", raw_products=_RAW["raw_products"], products=_CLEAN["products"]),
    "clean_purchases": query("SELECT * FROM purchases", raw_purchases=_RAW["raw_purchases"], headers=_CLEAN["headers"], purchases=_CLEAN["purchases"]),
    "clean_invoice_items": query("SELECT * FROM invoice_items", raw_invoice_items=_RAW["raw_invoice_items"], invoice_items=_CLEAN["invoice_items"]),
    "csv_roundtrip": query("SELECT * FROM products", raw_plain=_RAW["raw_products"], raw_products=duck_text(QUOTED.replace("{products}", "raw_plain")), products=_CLEAN["products"]),
    "clean_purchases_formats": query("SELECT * FROM purchases", raw_purchases=_RAW["raw_purchases"], headers=_CLEAN["headers"], purchases=_CLEAN["purchases"]),
    "purchases_inferred_format": query("SELECT purchases.*, notation FROM purchases, (SELECT unnest(['day first', 'month first']) AS notation)",
                                       raw_purchases=_RAW["raw_purchases"], headers=_CLEAN["headers"], purchases=_CLEAN["purchases"]),
    "csv_extra_fields": query(f"""SELECT nullif(product_id, '') AS product_id, item, nullif(category, '') AS category, nullif(price, '') AS price,
 (SELECT count(*) FROM raw_products WHERE {CSV_EXTRA}) AS n_extra FROM raw_products WHERE NOT {CSV_EXTRA}""", raw_products=_RAW["raw_products"]),
    "trim_text": query(f"""SELECT "CustomerID" AS raw_id, {text('"CustomerID"')} AS customer_id, customer_type AS raw_type, {text('customer_type')} AS customer_type FROM raw_customers""",
                       raw_customers=_RAW["raw_customers"]),
    "drop_null_keys": query("""SELECT "InvoiceID" AS invoice_id, product_id FROM raw_invoice_items WHERE "InvoiceID" IS NOT NULL AND product_id IS NOT NULL""",
                            raw_invoice_items=_RAW["raw_invoice_items"]),
    "coerce_numeric": query(f"""SELECT "InvoiceID" AS invoice_id, {number('quantity')} AS quantity, {number('price')} AS price, {number('line_total')} AS line_total FROM raw_invoice_items""",
                            raw_invoice_items=_RAW["raw_invoice_items"]),
    "coerce_timestamp": query(f"""SELECT "InvoiceID" AS invoice_id, date AS raw_date, try_strptime({text('date')}, '%Y-%m-%d') AS purchase_date FROM raw_purchases""",
                              raw_purchases=_RAW["raw_purchases"]),
    "range_filter": query(f"""SELECT "InvoiceID" AS invoice_id, {number('quantity')} AS quantity, {number('price')} AS price FROM raw_invoice_items WHERE {number('quantity')} > 0 AND {number('price')} >= 0""",
                          raw_invoice_items=_RAW["raw_invoice_items"]),
    "distinct_rows": query("SELECT DISTINCT * FROM raw_customers", raw_customers=_RAW["raw_customers"]),
    "dedupe_first": query("""SELECT invoice_id, date, customer_id FROM (SELECT "InvoiceID" AS invoice_id, date, "CustomerID" AS customer_id,
 row_number() OVER (PARTITION BY "InvoiceID" ORDER BY src_row) AS rn FROM raw_purchases WHERE "InvoiceID" IS NOT NULL) WHERE rn = 1""", raw_purchases=_RAW["raw_purchases"]),
    "check_duplicate_keys": query(
        """SELECT 'customers' AS table_name, k AS key, count(*) AS n_rows FROM kc GROUP BY k HAVING count(*) > 1
 UNION ALL SELECT 'products', k, count(*) FROM kp GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'purchases', k, count(*) FROM kh GROUP BY k HAVING count(*) > 1""", **_KEYED),
    "check_not_null": query(
        """SELECT 'customers' AS table_name, 'customer_id' AS column_name, count(*) - count(k) AS null_rows FROM kc UNION ALL SELECT 'products', 'product_id', count(*) - count(k) FROM kp
 UNION ALL SELECT 'purchases', 'invoice_id', count(*) - count(k) FROM kh UNION ALL SELECT 'purchases', 'customer_id', count(*) - count(c) FROM kh
 UNION ALL SELECT 'invoice_items', 'invoice_id', count(*) - count(k) FROM ki UNION ALL SELECT 'invoice_items', 'product_id', count(*) - count(p) FROM ki""", **_KEYED),
    "check_orphans": query(
        """SELECT 'purchases' AS child_table, 'customers' AS parent_table, customer_id AS key, count(*) AS n_rows FROM purchases WHERE customer_id NOT IN (SELECT customer_id FROM customers) GROUP BY customer_id
 UNION ALL SELECT 'invoice_items', 'purchases', invoice_id, count(*) FROM invoice_items WHERE invoice_id NOT IN (SELECT invoice_id FROM purchases) GROUP BY invoice_id
 UNION ALL SELECT 'invoice_items', 'products', product_id, count(*) FROM invoice_items WHERE product_id NOT IN (SELECT product_id FROM products) GROUP BY product_id""", **CLEAN),
    "integrated_lines": query(
        """SELECT p.invoice_id, p.purchase_date AS date, p.customer_id, c.customer_type, i.product_id, pr.item, pr.category, pr.price AS product_price, i.quantity, i.unit_price AS price,
 coalesce(i.line_total, i.quantity * i.unit_price) AS line_total, CAST(isodow(p.purchase_date) - 1 AS INTEGER) AS day_of_week, dayname(p.purchase_date) AS day_name
 FROM purchases p JOIN customers c ON c.customer_id = p.customer_id JOIN invoice_items i ON i.invoice_id = p.invoice_id JOIN products pr ON pr.product_id = i.product_id""", **CLEAN),
    "refresh_load": query(
        """SELECT 'customers' AS table_name, count(*) AS loaded, CAST(0 AS BIGINT) AS rejected FROM customers UNION ALL SELECT 'products', count(*), 0 FROM products
 UNION ALL SELECT 'purchases', count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok) FROM hp
 UNION ALL SELECT 'invoice_items', count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok) FROM ip""", **CLEAN,
        hp="SELECT invoice_id, customer_id IN (SELECT customer_id FROM customers) AS ok FROM purchases",
        ip="SELECT invoice_id IN (SELECT invoice_id FROM hp WHERE ok) AND product_id IN (SELECT product_id FROM products) AS ok FROM invoice_items"),
})

# ---- the trained model: which rows and features its outputs are about
SQL["rf_prediction_rows"] = query("SELECT invoice_id, outlier_class AS true_class FROM split WHERE is_test", **split_ctes("0.2"))
SQL["retrain_prediction_rows"] = query(
    "SELECT invoice_id, CAST(run AS INTEGER) AS run, outlier_class AS true_class FROM split, range(1, 6) t(run) WHERE is_test", **split_ctes("0.25"))
_FEATURES = """SELECT concat('customer_type_', customer_type) AS feature FROM split WHERE NOT is_test GROUP BY customer_type
 UNION ALL SELECT concat('dominant_category_', coalesce(dominant_category, 'nan')) FROM split WHERE NOT is_test GROUP BY coalesce(dominant_category, 'nan')
 UNION ALL SELECT unnest(['month', 'day_of_week', 'is_weekend', 'is_peak_season', 'is_off_season', 'invoice_revenue', 'total_qty', 'avg_price', 'n_items'])"""
SQL["feature_importance_names"] = query(
    "SELECT feature, round(1.0::DOUBLE, 6) AS total_importance FROM features", **split_ctes("0.2"), features=_FEATURES)
SQL["permutation_importance_names"] = query(
    "SELECT CAST(run AS INTEGER) AS run, feature FROM features, range(1, 6) t(run)", **split_ctes("0.25"), features=_FEATURES)

# ---- the fixture's forest -----------------------------------------------------------------------------------------
_NODE_ROWS = ", ".join(
    f"({t}, {n}, {'NULL' if f is None else repr(f)}, {'NULL' if x is None else f'{x}::DOUBLE'}, {'NULL' if a is None else a}, "
    f"{'NULL' if b is None else b}, {c}::DOUBLE[])" for t, n, f, x, a, b, c in forest_nodes())
_KNOWN = "EXISTS (SELECT 1 FROM split WHERE NOT is_test AND customer_type = 'Wholesaler')"
_VALUE = " ".join(
    f"WHEN '{f}' THEN " + (f"(customer_type = 'Wholesaler' AND {_KNOWN})::INTEGER::DOUBLE" if f.startswith("customer_type") else f"{f}::DOUBLE")
    for f in FOREST_FEATURES)


def _forest(share: str) -> dict[str, str]:
    return {
        **split_ctes(share),
        "nodes": f"SELECT * FROM (VALUES {_NODE_ROWS}) AS n(tree, node, feature, threshold, lft, rgt, counts)",
        "vals": f"SELECT invoice_id, outlier_class, is_test, feature, CASE feature {_VALUE} END AS v FROM split, (SELECT unnest({list(FOREST_FEATURES)}) AS feature)",
    }


_WALK = """SELECT {key}, tree, 0 AS node FROM {rows}, (SELECT DISTINCT tree FROM nodes)
 UNION ALL SELECT {walk_key}, w.tree, CASE WHEN {value} <= n.threshold THEN n.lft ELSE n.rgt END
 FROM walk w JOIN nodes n USING (tree, node) {join} WHERE n.feature IS NOT NULL"""
_VOTES = "SELECT {key}, " + ", ".join(f'sum(counts[{i}] / list_sum(counts)) AS "{c}"' for i, c in enumerate(FOREST_CLASSES, 1)) + """
 FROM walk JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY {key}"""
_WINNER = """CASE WHEN "Benign" >= "Harmful" AND "Benign" >= "Strategic" THEN 'Benign' WHEN "Harmful" >= "Strategic" THEN 'Harmful' ELSE 'Strategic' END"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


SQL["forest_predictions"] = recursive(query(
    f"""SELECT invoice_id, outlier_class AS true_class, {_WINNER} AS pred_class, "Benign", "Harmful", "Strategic" FROM votes JOIN split USING (invoice_id)""",
    **_forest("0.2"),
    walk=_WALK.format(key="invoice_id", walk_key="w.invoice_id", rows="split", value="x.v",
                      join="JOIN vals x ON x.invoice_id = w.invoice_id AND x.feature = n.feature"),
    votes=_VOTES.format(key="invoice_id")))
SQL["forest_importance"] = query(
    "SELECT feature, round(coalesce(s / sum(s) OVER (), 0.0), 9) AS importance FROM features LEFT JOIN shared USING (feature)",
    **_forest("0.2"), features=_FEATURES,
    impure="SELECT *, list_sum(counts) * (1 - list_sum(list_transform(counts, lambda c: power(c / list_sum(counts), 2)))) AS i FROM nodes",
    gain="""SELECT p.tree, p.feature, sum(p.i - l.i - r.i) AS g FROM impure p JOIN impure l ON l.tree = p.tree AND l.node = p.lft
 JOIN impure r ON r.tree = p.tree AND r.node = p.rgt GROUP BY p.tree, p.feature""",
    shared="SELECT feature, sum(g) AS s FROM (SELECT tree, feature, g / sum(g) OVER (PARTITION BY tree) AS g FROM gain) GROUP BY feature")

# A row's features are the six of the forest; the others leave every prediction as it is.
SQL["permutation_importance_fixed"] = recursive(query(
    """SELECT feature, round(coalesce(m, 0.0), 9) AS importance_mean, round(coalesce(s, 0.0), 9) AS importance_std FROM features LEFT JOIN (
 SELECT changed AS feature, avg(lost) AS m, stddev_pop(lost) AS s FROM (
  SELECT p.changed, p.rep, sum((b.pred = b.outlier_class)::INTEGER - (p.pred = b.outlier_class)::INTEGER) / count(*) AS lost
  FROM predicted p JOIN predicted b ON b.i = p.i AND b.rep = 0 AND b.changed = '' WHERE p.changed <> '' GROUP BY p.changed, p.rep) GROUP BY changed) USING (feature)""",
    **_forest("0.25"), features=_FEATURES,
    numbered="""SELECT *, row_number() OVER (ORDER BY md5(concat(CAST(invoice_id AS VARCHAR), '-42')), invoice_id) - 1 AS i, count(*) OVER () AS n
 FROM split WHERE is_test""",
    x="SELECT i, n, v.feature, v.v, v.outlier_class FROM numbered JOIN vals v USING (invoice_id)",
    drawn="""SELECT rep, n, ('0x' || substr(md5(concat('101-', rep - 1, '-a')), 1, 13))::BIGINT % greatest(n - 1, 1) + 1 AS a0,
 ('0x' || substr(md5(concat('101-', rep - 1, '-b')), 1, 13))::BIGINT % n AS b FROM range(1, 6) t(rep), (SELECT max(n) AS n FROM numbered)""",
    # The first number from a0 on, 1 following the last, that has no factor in common with n.
    pairing="""SELECT rep, n, b, min_by(a, step) AS a FROM (SELECT rep, n, b, step, (a0 - 1 + step) % greatest(n - 1, 1) + 1 AS a
 FROM (SELECT *, unnest(range(0, n)) AS step FROM drawn)) WHERE gcd(a, n) = 1 GROUP BY rep, n, b""",
    tried="""SELECT 0 AS rep, '' AS changed, i FROM numbered UNION ALL
 SELECT rep, f.feature, i FROM numbered, pairing, (SELECT DISTINCT feature FROM vals) f""",
    seen="""SELECT t.rep, t.changed, t.i, x.feature, CASE WHEN x.feature = t.changed THEN d.v ELSE x.v END AS v, x.outlier_class FROM tried t JOIN x USING (i)
 LEFT JOIN pairing p ON p.rep = t.rep LEFT JOIN x d ON d.i = (p.a * t.i + p.b) % p.n AND d.feature = x.feature""",
    walk=_WALK.format(key="rep, changed, i", walk_key="w.rep, w.changed, w.i", rows="tried", value="x.v",
                      join="JOIN seen x ON x.rep = w.rep AND x.changed = w.changed AND x.i = w.i AND x.feature = n.feature"),
    votes=_VOTES.format(key="rep, changed, i"),
    predicted=f"SELECT rep, changed, i, outlier_class, {_WINNER} AS pred FROM votes JOIN (SELECT DISTINCT i, outlier_class FROM x) USING (i)"))

# Shapley values by their definition: for every subset of the six features the mean prediction where the others are unknown.
_SHAP = {
    **_forest("0.2"),
    "sets": f"SELECT s, bit_count(s) AS size FROM range(0, {1 << len(FOREST_FEATURES)}) t(s)",
    "place": f"SELECT unnest({list(FOREST_FEATURES)}) AS feature, unnest(range(0, {len(FOREST_FEATURES)})) AS bit",
    "tested": "SELECT v.*, bit FROM vals v JOIN place USING (feature) WHERE is_test",
    "walk": """SELECT invoice_id, s, tree, 0 AS node, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT invoice_id FROM tested), sets, (SELECT DISTINCT tree FROM nodes)
 UNION ALL SELECT w.invoice_id, w.s, w.tree, c.node, w.weight * CASE WHEN (w.s >> x.bit) & 1 = 1 THEN 1 ELSE list_sum(c.counts) / list_sum(n.counts) END
 FROM walk w JOIN nodes n USING (tree, node) JOIN tested x ON x.invoice_id = w.invoice_id AND x.feature = n.feature
 JOIN nodes c ON c.tree = n.tree AND c.node IN (n.lft, n.rgt)
 WHERE (w.s >> x.bit) & 1 = 0 OR c.node = CASE WHEN x.v <= n.threshold THEN n.lft ELSE n.rgt END""",
    "worth": f"""SELECT invoice_id, s, unnest({list(FOREST_CLASSES)}) AS class, unnest([sum(weight * counts[1] / list_sum(counts)), sum(weight * counts[2] / list_sum(counts)),
 sum(weight * counts[3] / list_sum(counts))]) / {len({t for t, *_ in forest_nodes()})} AS v FROM walk JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY invoice_id, s""",
    "shap": f"""SELECT o.invoice_id, p.feature, o.class, sum(factorial(k.size) * factorial({len(FOREST_FEATURES) - 1} - k.size) / factorial({len(FOREST_FEATURES)}) * (w.v - o.v)) AS value
 FROM worth o JOIN sets k USING (s) JOIN place p ON (o.s >> p.bit) & 1 = 0 JOIN worth w ON w.invoice_id = o.invoice_id AND w.class = o.class AND w.s = o.s + (1 << p.bit)
 GROUP BY o.invoice_id, p.feature, o.class""",
}
SQL["shap_values"] = recursive(query('SELECT invoice_id, feature, class, round(value, 9) AS "value" FROM shap', **_SHAP))
SQL["shap_importance"] = recursive(query(
    """SELECT CAST(row_number() OVER (ORDER BY round("Benign" + "Harmful" + "Strategic", 12) DESC, feature) AS INTEGER) AS rank, feature, round("Benign", 9) AS "Benign",
 round("Harmful", 9) AS "Harmful", round("Strategic", 9) AS "Strategic", round("Benign" + "Harmful" + "Strategic", 9) AS importance FROM means""",
    **_SHAP, features=_FEATURES,
    means="SELECT feature, " + ", ".join(f"""coalesce(sum(abs(value)) FILTER (class = '{c}') / (SELECT count(*) FROM split WHERE is_test), 0.0) AS "{c}" """ for c in FOREST_CLASSES)
    + " FROM features LEFT JOIN shap USING (feature) GROUP BY feature"))
