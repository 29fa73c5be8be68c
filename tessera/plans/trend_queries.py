"""Queries over dated publications, daily events and keywords over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.papers import year_in
from tessera.functions.text import clean_text
from tessera.operators import tfidf as T
from tessera.operators import trends as Z
from tessera.plans.corpus import DATED_SQL, dated, raw, table

W = f"WITH d AS ({DATED_SQL}) "
SHARE = "s AS (SELECT year, category, is_partial_year, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY year) AS share FROM d GROUP BY year, category, is_partial_year)"
MONTHLY = """m AS (SELECT month, is_partial_year, count(*) AS count, sum(w) AS norm_share FROM (SELECT *, 1 / count(*) OVER (PARTITION BY year) AS w FROM d) WHERE month IS NOT NULL GROUP BY ALL HAVING count(*) >= 30)"""
BY_CATEGORY = """m AS (SELECT month, category, is_partial_year, count(*) AS count, sum(w) AS norm_share FROM (SELECT *, 1 / count(*) OVER (PARTITION BY year) AS w FROM d) WHERE month IS NOT NULL GROUP BY ALL HAVING count(*) >= 7)"""
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WORDS = ["the", "er", "tion", "and the", "que"]
YEARS = list(range(2015, 2027))
SPEC = T.TfidfSpec(most=2, min_df=5, max_df=0.85, features=3000)
CATEGORY_SPEC = T.TfidfSpec(most=1, min_df=3, max_df=1.0, features=500)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def annual_volume(spark, d):
    return Z.annual_volume(dated(spark, d))


def annual_share(spark, d):
    return rounded(Z.annual_share(dated(spark, d)), "share")


def monthly_share(spark, d):
    return rounded(Z.monthly_share(dated(spark, d)), "norm_share")


def monthly_share_by_category(spark, d):
    return rounded(Z.monthly_share(dated(spark, d), 7, ["category"]), "norm_share")


def yoy_growth(spark, d):
    return rounded(Z.yoy_growth(Z.annual_share(dated(spark, d))), "share", "yoy_pct").drop("count")


def cagr(spark, d):
    return rounded(Z.cagr(Z.annual_share(dated(spark, d))), "cagr")


def dominant_category(spark, d):
    return rounded(Z.dominant_category(Z.annual_share(dated(spark, d))), "share")


def share_pivot(spark, d):
    wide = Z.pivoted(Z.annual_share(dated(spark, d)), "year", "category", "share", PRIORITIES)
    return wide.select("year", *[F.round(F.col(f"`{p}`"), 6).alias(p[2:].lower().replace(" ", "_")) for p in PRIORITIES])


def iqr_anomalies(spark, d):
    return rounded(Z.iqr_anomalies(Z.monthly_share(dated(spark, d))), "norm_share")


def event_anomalies(spark, d):
    """Daily event counts: anomalies over a daily series."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.lit(False).alias("is_partial_year"))
    return Z.iqr_anomalies(days, "n").select("day", "n", "anomaly", "anomaly_type")


def sparse_monthly(spark, d):
    rows = Z.monthly_share(dated(spark, d), 7, ["category"])
    return rows.where(F.month("month") % 5 != 0)


def month_grid_fill(spark, d):
    return rounded(Z.month_grid(sparse_monthly(spark, d), ["category"], "norm_share"), "norm_share", "filled")


def texts_by_year(spark, d):
    return raw(spark, d).select(F.col("doc_id").alias("doc"), F.expr("CAST(2015 + (doc_id * 7) % 12 AS INT)").alias("year"), "lang", clean_text(F.col("abstract")).alias("text"))


def keywords_per_year(spark, d):
    docs = texts_by_year(spark, d)
    sizes = docs.groupBy("year").count().where("count >= 10").select("year")
    docs = docs.join(F.broadcast(sizes), "year")  # a row for each year
    best = T.top_terms(T.mean_weights(T.tfidf(docs, SPEC, ["year"]), docs, ["year"]), 10, ["year"])
    return rounded(best, "weight")


def keywords_per_category(spark, d):
    docs = texts_by_year(spark, d).withColumnRenamed("lang", "category")
    best = T.top_terms(T.mean_weights(T.tfidf(docs, CATEGORY_SPEC, ["category"]), docs, ["category"]), 6, ["category"])
    return rounded(best, "weight")


def trending_keywords(spark, d):
    best = keywords_per_year(spark, d).groupBy("term").agg(F.round(F.sum("weight"), 5).alias("score"), F.count("*").alias("years"))
    return best.orderBy(F.desc("score"), "term").limit(8)


def keyword_heatmap(spark, d):
    """Terms by year, the 20 of the largest sum."""
    rows = keywords_per_year(spark, d)
    wide = rows.groupBy("term").pivot("year", YEARS).agg(F.first("weight")).na.fill(0.0)
    total = sum((F.col(f"`{y}`") for y in YEARS), F.lit(0.0))
    return wide.orderBy(F.desc(F.round(total, 5)), "term").limit(20).select("term", *[F.col(f"`{y}`").alias(f"y{y}") for y in YEARS])


def keyword_rank_pivot(spark, d):
    """Rank of each listed term by year, the smallest is the best; null where it is not listed."""
    wide = keywords_per_year(spark, d).groupBy("term").pivot("year", YEARS).agg(F.min("rank"))
    return wide.select("term", *[F.col(f"`{y}`").cast("long").alias(f"y{y}") for y in YEARS])


def version_years(spark, d):
    """Records by the year that their first version's RFC-2822 date names."""
    created = F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    return table(spark, d, "orders").select(year_in(created).alias("year")).groupBy("year").agg(F.count("*").alias("count"))


def keyword_track(spark, d):
    return rounded(T.keyword_rate(texts_by_year(spark, d), WORDS, ["year"], F.col("text")), "rate")


def keyword_drift(spark, d):
    docs = texts_by_year(spark, d).withColumnRenamed("lang", "category")
    return rounded(T.word_rate(docs, WORDS, ["category", "year"], F.col("text")), "rate")


def cluster_share_yoy(spark, d):
    rows = texts_by_year(spark, d).select("year", (F.col("doc") % 5).cast("string").alias("category"), F.lit(False).alias("is_partial_year"))
    return rounded(Z.yoy_growth(Z.annual_share(rows)), "share", "yoy_pct").select("year", "category", "share", "yoy_pct")


QUERIES = {
    f.__name__: f
    for f in (
        annual_volume, annual_share, monthly_share, monthly_share_by_category, yoy_growth, cagr, dominant_category, share_pivot, iqr_anomalies, event_anomalies,
        month_grid_fill, keywords_per_year, keywords_per_category, trending_keywords, keyword_heatmap, keyword_rank_pivot, version_years, keyword_track, keyword_drift, cluster_share_yoy,
    )
}


def tfidf_sql(spec: T.TfidfSpec, by: str, source: str) -> str:
    """CTEs up to ``w`` (by, doc, term, tf, weight) from ``source`` (by, doc, text)."""
    stop = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in spec.stop) + "]"
    grams = "t"
    for n in range(2, spec.most + 1):
        grams += f" || list_transform(range(1, greatest(len(t) - {n - 2}, 1)), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"
    return f"""docs AS ({source}),
      tok AS (SELECT {by}, doc, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_]+'), lambda x: NOT list_contains({stop}, x)) AS t FROM docs),
      tf AS (SELECT {by}, doc, term, count(*) AS tf FROM (SELECT {by}, doc, unnest({grams}) AS term FROM tok) GROUP BY ALL),
      sizes AS (SELECT {by}, count(*) AS n FROM docs GROUP BY ALL),
      vocab AS (SELECT {by}, term, df, n FROM (SELECT {by}, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL) JOIN sizes USING ({by})
                WHERE df >= {spec.min_df} AND df <= n * {spec.max_df}::DOUBLE QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY total DESC, term) <= {spec.features}),
      u AS (SELECT {by}, doc, term, tf, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN vocab USING ({by}, term)),
      w AS (SELECT {by}, doc, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {by}, doc)) AS weight FROM u)"""


def clean_sql(column: str) -> str:
    from tessera.plans.ingest_queries import CLEAN

    return CLEAN.replace("abstract", column)


def oracle() -> dict[str, str]:
    text = f"SELECT doc_id AS doc, CAST(2015 + (doc_id * 7) % 12 AS INT) AS year, lang AS category, {clean_sql('text')} AS text FROM documents"
    per_year = f"""WITH {tfidf_sql(SPEC, 'year', f"SELECT * FROM ({text}) QUALIFY count(*) OVER (PARTITION BY year) >= 10")},
        mean AS (SELECT year, term, sum(weight) / any_value(n) AS weight FROM w JOIN sizes USING (year) GROUP BY ALL),
        best AS (SELECT year, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY year ORDER BY weight DESC, term) AS rank FROM mean QUALIFY rank <= 10)"""
    grid = f"""{W}, {BY_CATEGORY}, m2 AS (SELECT category, month, norm_share FROM m WHERE month(month) % 5 <> 0),
        g AS (SELECT category, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m2 GROUP BY category),
        j AS (SELECT g.category, g.month, norm_share FROM g LEFT JOIN m2 USING (category, month))
        SELECT category, month, round(norm_share, 6) AS norm_share, round(coalesce(norm_share, a.v + (b.v - a.v) * date_diff('day', a.month, month) / date_diff('day', a.month, b.month)), 6) AS filled
        FROM (SELECT *, last_value(CASE WHEN norm_share IS NOT NULL THEN struct_pack(month := month, v := norm_share) END IGNORE NULLS) OVER (PARTITION BY category ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
                     first_value(CASE WHEN norm_share IS NOT NULL THEN struct_pack(month := month, v := norm_share) END IGNORE NULLS) OVER (PARTITION BY category ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM j)"""
    yoy = """SELECT year, category, is_partial_year, round(share, 6) AS share, round((share - b) / nullif(b, 0) * 100, 6) AS yoy_pct
        FROM (SELECT *, lag(share) OVER (PARTITION BY category ORDER BY year) AS b FROM s) WHERE b IS NOT NULL"""
    counts = " UNION ALL ".join(f"SELECT year, '{w}' AS keyword, sum((length(text) - length(replace(text, '{w}', ''))) // {len(w)})::BIGINT AS count, count(*) AS n FROM t GROUP BY year" for w in WORDS)
    drift = " UNION ALL ".join(f"SELECT category, year, '{w}' AS keyword, sum(len(regexp_extract_all(text, '\\b{w}\\b')))::BIGINT AS count, count(*) AS n FROM t GROUP BY category, year" for w in WORDS)
    wide = ", ".join(f"coalesce(max(weight) FILTER (year = {y}), 0.0)::DOUBLE AS y{y}" for y in YEARS)
    return {
        "annual_volume": f"{W} SELECT year, is_partial_year, count(*) AS count FROM d GROUP BY ALL",
        "annual_share": f"{W}, {SHARE} SELECT year, category, is_partial_year, count, round(share, 6) AS share FROM s",
        "monthly_share": f"{W}, {MONTHLY} SELECT month, is_partial_year, count, round(norm_share, 6) AS norm_share FROM m",
        "monthly_share_by_category": f"{W}, {BY_CATEGORY} SELECT month, category, is_partial_year, count, round(norm_share, 6) AS norm_share FROM m",
        "yoy_growth": f"{W}, {SHARE} {yoy}",
        "cagr": f"""{W}, {SHARE}, c AS (SELECT category, arg_min(share, year) AS a, arg_max(share, year) AS b, max(year) - min(year) AS y FROM s WHERE NOT is_partial_year GROUP BY category)
            SELECT category, round((pow(b / greatest(a, 1e-9), 1.0 / y) - 1) * 100, 6) AS cagr FROM c WHERE y > 0""",
        "dominant_category": f"{W}, {SHARE} SELECT year, category, round(share, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY year ORDER BY share DESC, category) = 1",
        "share_pivot": f"{W}, {SHARE} SELECT year, " + ", ".join(f"coalesce(round(sum(share) FILTER (category = '{p}'), 6), 0) AS {p[2:].lower().replace(' ', '_')}" for p in PRIORITIES) + " FROM s GROUP BY year",
        "iqr_anomalies": f"""{W}, {MONTHLY}, q AS (SELECT quantile_cont(norm_share, 0.25) AS a, quantile_cont(norm_share, 0.75) AS b FROM m WHERE NOT is_partial_year),
            k AS (SELECT m.*, CASE WHEN is_partial_year THEN 'normal' WHEN norm_share > b + 1.5 * (b - a) THEN 'spike' WHEN norm_share < a - 1.5 * (b - a) THEN 'dip' ELSE 'normal' END AS anomaly_type FROM m, q)
            SELECT month, is_partial_year, count, round(norm_share, 6) AS norm_share, anomaly_type, anomaly_type <> 'normal' AS anomaly FROM k""",
        "event_anomalies": """WITH e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b FROM e),
            k AS (SELECT day, n, CASE WHEN n > b + 1.5 * (b - a) THEN 'spike' WHEN n < a - 1.5 * (b - a) THEN 'dip' ELSE 'normal' END AS anomaly_type FROM e, q) SELECT day, n, anomaly_type <> 'normal' AS anomaly, anomaly_type FROM k""",
        "month_grid_fill": grid,
        "keywords_per_year": f"{per_year} SELECT * FROM best",
        "keywords_per_category": f"""WITH {tfidf_sql(CATEGORY_SPEC, 'category', text)},
            mean AS (SELECT category, term, sum(weight) / any_value(n) AS weight FROM w JOIN sizes USING (category) GROUP BY ALL)
            SELECT category, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY category ORDER BY weight DESC, term) AS rank FROM mean QUALIFY rank <= 6""",
        "trending_keywords": f"{per_year} SELECT term, round(sum(weight), 5) AS score, count(*) AS years FROM best GROUP BY term ORDER BY score DESC, term LIMIT 8",
        "keyword_heatmap": f"{per_year}, p AS (SELECT term, {wide}, round(sum(weight), 5) AS total FROM best GROUP BY term) SELECT * EXCLUDE (total) FROM p ORDER BY total DESC, term LIMIT 20",
        "keyword_rank_pivot": f"{per_year} SELECT term, " + ", ".join(f"min(rank) FILTER (year = {y}) AS y{y}" for y in YEARS) + " FROM best GROUP BY term",
        "version_years": "SELECT regexp_extract(strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S GMT'), '\\d{4}')::INT AS year, count(*) AS count FROM orders GROUP BY 1",
        "keyword_track": f"WITH t AS ({text}), c AS ({counts}) SELECT year, keyword, count, round(count / n, 6) AS rate FROM c",
        "keyword_drift": f"WITH t AS ({text}), c AS ({drift}) SELECT category, year, keyword, count, round(count / n, 6) AS rate FROM c",
        "cluster_share_yoy": f"""WITH d AS (SELECT year, CAST(doc % 5 AS VARCHAR) AS category, false AS is_partial_year FROM ({text})), {SHARE}
            SELECT year, category, share, yoy_pct FROM ({yoy})""",
    }


