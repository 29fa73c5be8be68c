"""Queries over raw records: cleaning, parsing, filtering, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import papers as P
from tessera.functions import text as X
from tessera.operators import ingest as I
from tessera.operators import profile as R
from tessera.plans.corpus import RAW_COLUMNS, RAW_SQL, raw, table

W = f"WITH r AS ({RAW_SQL}) "
LENGTH_BINS = [(0, 50, "0-50"), (50, 100, "50-100"), (100, 150, "100-150"), (150, 200, "150-200"), (200, 300, "200-300"), (300, 400, "300-400"), (400, 500, "400-500"), (500, 700, "500-700"), (700, 1000, "700-1000"), (1000, 1500, "1000-1500"), (1500, 99999, "1500+")]
AUTHOR_BINS = [(1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 5, "4-5"), (6, 10, "6-10"), (11, 20, "11-20"), (21, 50, "21-50"), (51, 10000, "51+")]
THRESHOLDS = [50, 100, 150, 200, 250, 300, 400, 500]

CLEAN = "coalesce(abstract, '')"
for _pattern, _to in X.CLEANING:
    _flags = "gs" if _pattern.startswith("(?s)") else "gi" if _pattern.startswith("(?i)") else "g"
    _plain = _pattern.removeprefix("(?s)").removeprefix("(?i)")
    CLEAN = f"regexp_replace({CLEAN}, '{_plain}', '{_to.replace('$1', chr(92) + '1')}', '{_flags}')"
CLEAN = f"trim(regexp_replace(lower({CLEAN}), '\\s+', ' ', 'g'))"
PRIMARY = "nullif(split_part(trim(coalesce(categories, '')), ' ', 1), '')"


def prefix_case(prefixes) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({PRIMARY}, '{p}') THEN '{p}'" for p in prefixes) + " END"


def author_list_sql() -> str:
    return """CASE WHEN lower(trim(coalesce(authors, ''))) IN ('', 'nan', 'none', 'null', '[]') THEN []::VARCHAR[]
        ELSE list_filter(list_transform(string_split_regex(regexp_replace(trim(authors), '^\\[|\\]$|[''"]', '', 'g'), '[;,]'), lambda a: trim(a)), lambda a: a <> '') END"""


LEN = "length(trim(coalesce(abstract, '')))"
YEAR = "CASE WHEN regexp_matches(substring(update_date, 1, 4), '^\\d{4}$') THEN try_cast(substring(update_date, 1, 4) AS INT) END"


def bins_sql(value: str, bins, closed: bool) -> str:
    rows = ", ".join(f"({i}, {lo}, {hi}, '{label}')" for i, (lo, hi, label) in enumerate(bins))
    return f"""{W}, v AS (SELECT {value} AS v FROM r), b(bin, lo, hi, label) AS (VALUES {rows}),
        c AS (SELECT bin, label, count(v) FILTER (v >= lo AND v {'<=' if closed else '<'} hi) AS count FROM b, v GROUP BY bin, label)
        SELECT bin, label, count, round(100 * count / (SELECT count(v) FROM v), 6) AS pct, round(100 * sum(count) OVER (ORDER BY bin) / (SELECT count(v) FROM v), 6) AS cumulative_pct FROM c"""


def abstract_length():
    return F.length(F.trim(F.coalesce("abstract", F.lit(""))))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


def primary_group(spark, d):
    return raw(spark, d).select("doc_id", P.primary_group(F.col("categories")).alias("category_group"), P.group_name(P.primary_group(F.col("categories"))).alias("group_name"), P.profile_group(F.col("categories")).alias("profile_group"))


def extract_month(spark, d):
    return raw(spark, d).select("doc_id", P.month_of_id(F.col("id")).alias("pub_month"), P.year_of(F.col("update_date")).alias("year"), F.make_date(P.year_of(F.col("update_date")), P.month_of_id(F.col("id")), F.lit(1)).alias("year_month"))


def parsed_authors(spark, d):
    names = P.split_authors(F.col("authors"))
    nested = F.transform(names, lambda n: F.reverse(F.split(n, " ")))
    return raw(spark, d).select("doc_id", F.array_join(names, " ; ").alias("authors_text"), F.size(names).cast("long").alias("n_authors"), F.array_join(P.parsed_authors(nested), "|").alias("first_last"))


def search_text(spark, d):
    names = F.array_join(P.split_authors(F.col("authors")), " ; ")
    whole = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), names))
    doubled = F.concat(F.coalesce("title", F.lit("")), F.lit(" . "), F.coalesce("title", F.lit("")), F.lit(" . "), F.coalesce("abstract", F.lit("")))
    return raw(spark, d).select("doc_id", F.md5(whole).alias("search_text_md5"), F.md5(doubled).alias("embedding_text_md5"))


def keyword_slug(spark, d):
    return raw(spark, d).select("doc_id", X.clean_keyword(F.col("title"), X.stop_words()).alias("keyword"), X.safe_slug(F.coalesce("title", F.lit(""))).alias("slug"), X.truncated(F.col("title"), 40).alias("short"))


def author_scores(spark, d):
    names = P.split_authors(F.col("authors"))
    return raw(spark, d).select("doc_id", P.author_score(names, "Bo Chen").alias("bo"), P.author_score(names, "chen").alias("chen"), P.author_score(names, "").alias("nobody"), P.overlap(names, F.array(F.lit("bo chen"), F.lit("Ada Byron"))).cast("long").alias("shared"))


def field_presence(spark, d):
    return rounded(R.field_presence(raw(spark, d), RAW_COLUMNS), "rate")


def abstract_length_stats(spark, d):
    r = raw(spark, d)
    ranks = R.order_statistics(r, abstract_length(), {"p10": (1, 10), "p25": (1, 4), "p75": (3, 4), "p90": (9, 10)})
    more = r.agg(F.count_if(abstract_length() == 0).alias("empty"), F.count_if(X.has_latex(F.col("abstract"))).alias("latex"), F.round(F.avg(X.word_count(F.col("abstract"))), 6).alias("mean_words"), F.max(X.word_count(F.col("abstract"))).cast("long").alias("max_words"))
    return rounded(R.summary(r, abstract_length()), "mean", "median", "stdev").crossJoin(ranks).crossJoin(more)


def title_stats(spark, d):
    return rounded(R.summary(raw(spark, d), F.length(F.trim(F.coalesce("title", F.lit(""))))), "mean", "median", "stdev")


def length_histogram(spark, d):
    return rounded(R.histogram(raw(spark, d), abstract_length(), LENGTH_BINS), "pct", "cumulative_pct")


def author_count_histogram(spark, d):
    return rounded(R.histogram(raw(spark, d), F.size(P.split_authors(F.col("authors"))), AUTHOR_BINS, closed=True), "pct", "cumulative_pct")


def retention_thresholds(spark, d):
    return rounded(R.retention(raw(spark, d), abstract_length(), THRESHOLDS), "retention_pct")


def year_histogram_cumulative(spark, d):
    return rounded(R.cumulative_counts(raw(spark, d), P.year_of(F.col("update_date")), "year"), "pct", "cumulative_pct")


def version_histogram(spark, d):
    return rounded(R.cumulative_counts(raw(spark, d), F.least("n_versions", F.lit(8)), "versions"), "pct", "cumulative_pct")


def category_label_topk(spark, d):
    labels = raw(spark, d).select(F.explode(F.filter(F.split(F.trim("categories"), r"\s+"), lambda c: c != "")).alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(30)


def category_multiplicity(spark, d):
    n = F.size(F.filter(F.split(F.trim("categories"), r"\s+"), lambda c: c != ""))
    return raw(spark, d).agg(F.count_if(n > 1).alias("multi"), F.count_if(n == 1).alias("single"))


def id_uniqueness(spark, d):
    return raw(spark, d).where("id <> ''").agg(F.count("id").alias("total"), F.countDistinct("id").alias("unique_ids"), F.count_if(F.col("id").contains("/")).alias("old_format"))


def null_kind_counts(spark, d):
    return raw(spark, d).groupBy(P.null_kind(F.col("journal_ref")).alias("kind")).agg(F.count("*").alias("count"))


def json_fields(spark, d):
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select(F.explode(props).alias("key", "value")).groupBy("key").agg(F.count("*").alias("total"), F.count_if(P.is_present(F.col("value"))).alias("present"), F.sum(F.col("value").try_cast("double")).cast("long").alias("value_sum"))


def capped_sample(spark, d):
    kept = I.capped(I.eligible(raw(spark, d)), F.col("doc_id"), cap=40)
    return kept.select("doc_id", "category_group", "year")


def ingest_counters(spark, d):
    return I.counters(raw(spark, d))


def clean_corpus(spark, d):
    return I.clean_corpus(I.eligible(raw(spark, d))).select("paper_id", "year", F.length("abstract_clean").cast("long").alias("n_clean"), F.size("authors_list").cast("long").alias("n_authors"), F.md5("text_for_embedding").alias("text_md5"))


def label_corpus(spark, d):
    return I.labels(I.long_enough(I.eligible(raw(spark, d))))


def timeseries_corpus(spark, d):
    return I.timeseries_corpus(raw(spark, d)).groupBy("year", "category_group", "is_partial_year").agg(F.count("*").alias("count"))


ELIGIBLE = f"""e AS (SELECT *, {prefix_case(P.GROUPS)} AS category_group, {YEAR} AS year FROM r
    WHERE {prefix_case(P.GROUPS)} IS NOT NULL AND {LEN} >= 400 AND {YEAR} >= 2015)"""
NAMES = "CASE category_group " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.GROUPS.items()) + " ELSE 'Unknown' END"
CLEAN_TITLE = CLEAN.replace("coalesce(abstract, '')", "coalesce(title, '')")



def stop_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.stop_words()) + "]"


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, primary_group, extract_month, parsed_authors, search_text, keyword_slug, author_scores, field_presence, abstract_length_stats, title_stats,
        length_histogram, author_count_histogram, retention_thresholds, year_histogram_cumulative, version_histogram, category_label_topk, category_multiplicity,
        id_uniqueness, null_kind_counts, json_fields, capped_sample, ingest_counters, clean_corpus, label_corpus, timeseries_corpus,
    )
}


def order_stat_sql(name: str, a: int, b: int) -> str:
    return f"(SELECT v FROM s WHERE k = (SELECT count(*) FROM s) * {a} // {b} + 1) AS {name}"


def oracle() -> dict[str, str]:
    labels = "list_filter(string_split_regex(trim(categories), '\\s+'), lambda c: c <> '')"
    present = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (CAST({c} AS VARCHAR) NOT IN ('', '[]', '{{}}', 'None')) AS present, count(*) AS total FROM r" for c in RAW_COLUMNS)
    summary = "count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS stdev"
    names = author_list_sql()

    def cumulative(value: str, name: str) -> str:
        return f"""{W}, c AS (SELECT {value} AS {name}, count(*) AS count FROM r GROUP BY 1 HAVING {name} IS NOT NULL)
            SELECT {name}, count, round(100 * count / (SELECT sum(count) FROM c), 6) AS pct, round(100 * sum(count) OVER (ORDER BY {name}) / (SELECT sum(count) FROM c), 6) AS cumulative_pct FROM c"""

    def score(q: str) -> str:
        one = f"CASE WHEN lower(trim(a)) = '{q}' THEN 1.0 WHEN contains(lower(trim(a)), '{q}') OR contains('{q}', lower(trim(a))) THEN 0.8 ELSE 0.0 END"
        return f"coalesce(list_filter(list_transform(l, lambda a: {one}), lambda s: s > 0)[1], 0.0)::DOUBLE"

    slug = "substring(regexp_replace(regexp_replace(coalesce(title, ''), '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50)"
    words = "list_filter(string_split_regex(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\\s_-]+', ' ', 'g')), '\\s+'), lambda w: length(w) >= 3)"
    return {
        "clean_text": f"SELECT doc_id, {CLEAN.replace('abstract', 'text')} AS clean FROM documents",
        "primary_group": f"{W}, g AS (SELECT *, {prefix_case(P.GROUPS)} AS category_group FROM r) SELECT doc_id, category_group, {NAMES} AS group_name, coalesce({prefix_case(P.PROFILE_PREFIXES)}, {PRIMARY}) AS profile_group FROM g",
        "extract_month": f"""{W}, m AS (SELECT doc_id, try_cast(coalesce(nullif(regexp_extract(id, '^(\\d{{2}})(\\d{{2}})\\.\\d+', 2), ''), nullif(regexp_extract(id, '/(\\d{{2}})(\\d{{2}})\\d{{3}}$', 2), '')) AS INT) AS m, {YEAR} AS year FROM r)
            SELECT doc_id, CASE WHEN m BETWEEN 1 AND 12 THEN m END AS pub_month, year, CASE WHEN m BETWEEN 1 AND 12 THEN make_date(year, m, 1) END AS year_month FROM m""",
        "parsed_authors": f"{W}, a AS (SELECT doc_id, {names} AS l FROM r) SELECT doc_id, array_to_string(l, ' ; ') AS authors_text, len(l) AS n_authors, array_to_string(l, '|') AS first_last FROM a",
        "search_text": f"""{W}, a AS (SELECT *, {names} AS l FROM r) SELECT doc_id, md5(lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || array_to_string(l, ' ; '))) AS search_text_md5,
            md5(coalesce(title, '') || ' . ' || coalesce(title, '') || ' . ' || coalesce(abstract, '')) AS embedding_text_md5 FROM a""",
        "keyword_slug": f"""{W}, k AS (SELECT *, {words} AS w FROM r) SELECT doc_id, CASE WHEN len(w) > 0 AND NOT (len(w) = 1 AND list_contains({stop_sql()}, w[1])) THEN array_to_string(w, '_') END AS keyword,
            {slug} AS slug, CASE WHEN length(title) > 40 THEN rtrim(substring(title, 1, 40)) || '...' ELSE title END AS short FROM k""",
        "author_scores": f"{W}, a AS (SELECT doc_id, {names} AS l FROM r) SELECT doc_id, {score('bo chen')} AS bo, {score('chen')} AS chen, 0.0::DOUBLE AS nobody, len(list_intersect(list_transform(l, lambda x: lower(trim(x))), ['bo chen', 'ada byron'])) AS shared FROM a",
        "field_presence": f"{W}, p AS ({present}) SELECT field, present, total, round(100 * present / total, 6) AS rate, CASE WHEN 100 * present / total < 30 THEN 'sparse' WHEN 100 * present / total < 70 THEN 'moderate' ELSE '' END AS note FROM p",
        "abstract_length_stats": f"""{W}, v AS (SELECT {LEN} AS v, len(regexp_extract_all(coalesce(abstract, ''), '\\S+')) AS w, regexp_matches(coalesce(abstract, ''), '\\$|\\\\\\w+|\\\\\\[') AS x FROM r),
            s AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM v)
            SELECT {summary}, {order_stat_sql('p10', 1, 10)}, {order_stat_sql('p25', 1, 4)}, {order_stat_sql('p75', 3, 4)}, {order_stat_sql('p90', 9, 10)},
                   count(*) FILTER (v = 0) AS empty, count(*) FILTER (x) AS latex, round(avg(w), 6) AS mean_words, max(w) AS max_words FROM v""",
        "title_stats": f"{W}, v AS (SELECT length(trim(coalesce(title, ''))) AS v FROM r) SELECT {summary} FROM v",
        "length_histogram": bins_sql(LEN, LENGTH_BINS, False),
        "author_count_histogram": bins_sql(f"len({names})", AUTHOR_BINS, True),
        "retention_thresholds": f"""{W}, v AS (SELECT {LEN} AS v FROM r), t AS (SELECT unnest({THRESHOLDS}) AS threshold)
            SELECT threshold, count(*) FILTER (v >= threshold) AS kept, count(*) FILTER (v < threshold) AS dropped, round(100 * count(*) FILTER (v >= threshold) / count(*), 6) AS retention_pct FROM t, v GROUP BY threshold""",
        "year_histogram_cumulative": cumulative(YEAR, "year"),
        "version_histogram": cumulative("least(n_versions, 8)", "versions"),
        "category_label_topk": f"{W} SELECT label, count(*) AS count FROM (SELECT unnest({labels}) AS label FROM r) GROUP BY label ORDER BY count DESC, label LIMIT 30",
        "category_multiplicity": f"{W} SELECT count(*) FILTER (len({labels}) > 1) AS multi, count(*) FILTER (len({labels}) = 1) AS single FROM r",
        "id_uniqueness": f"{W} SELECT count(id) AS total, count(DISTINCT id) AS unique_ids, count(*) FILTER (contains(id, '/')) AS old_format FROM r WHERE id <> ''",
        "null_kind_counts": f"{W} SELECT CASE WHEN journal_ref IS NULL THEN 'null' WHEN journal_ref = '' THEN 'empty' WHEN journal_ref = 'None' THEN 'none_text' ELSE 'value' END AS kind, count(*) AS count FROM r GROUP BY 1",
        "json_fields": "WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events) SELECT key, count(*) AS total, count(*) FILTER (json_extract_string(props, '$.' || key) NOT IN ('', '[]', '{}', 'None')) AS present, sum(try_cast(json_extract_string(props, '$.' || key) AS DOUBLE))::BIGINT AS value_sum FROM k GROUP BY key",
        "capped_sample": f"{W}, {ELIGIBLE} SELECT doc_id, category_group, year FROM e QUALIFY row_number() OVER (PARTITION BY category_group ORDER BY doc_id) <= 40",
        "ingest_counters": f"""{W}, c AS (SELECT {prefix_case(P.GROUPS)} AS g, {LEN} AS n, {YEAR} AS y FROM r)
            SELECT count(*) AS total, count(*) FILTER (g IS NULL) AS no_group, count(*) FILTER (g IS NOT NULL AND n < 400) AS short_abstract, count(*) FILTER (g IS NOT NULL AND n >= 400 AND coalesce(y < 2015, true)) AS too_old, count(*) FILTER (g IS NOT NULL AND n >= 400 AND y >= 2015) AS kept FROM c""",
        "clean_corpus": f"""{W}, {ELIGIBLE}, c AS (SELECT id AS paper_id, year, {CLEAN} AS a, {CLEAN_TITLE} AS t, len({names}) AS n_authors FROM e)
            SELECT paper_id, year, length(a) AS n_clean, n_authors, md5(t || ' . ' || t || ' . ' || a) AS text_md5 FROM c WHERE length(a) > 100""",
        "label_corpus": f"{W}, {ELIGIBLE} SELECT id AS paper_id, categories, category_group, {NAMES} AS category_group_name FROM e WHERE length({CLEAN}) > 100",
        "timeseries_corpus": f"""{W}, t AS (SELECT *, {prefix_case(P.GROUPS)} AS category_group, {YEAR} AS year FROM r)
            SELECT year, category_group, year = 2026 AS is_partial_year, count(*) AS count FROM t WHERE category_group IS NOT NULL AND year BETWEEN 2015 AND 2026 AND {LEN} >= 400 AND length({CLEAN}) > 100 GROUP BY ALL""",
    }


