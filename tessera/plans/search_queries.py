"""Queries for search, keywords, rules, recommendation and the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions.text import clean_text, stop_words
from tessera.operators import rules as R
from tessera.operators import search as S
from tessera.operators import tfidf as T
from tessera.plans.corpus import PAPERS_SQL, papers, table
from tessera.plans.staging import staged
from tessera.plans.trend_queries import clean_sql, tfidf_sql

KEYWORD_SPEC = T.TfidfSpec(most=1, min_df=2, max_df=0.6, features=8000)
SEARCH_SPEC = T.TfidfSpec(most=2, min_df=2, max_df=1.0, features=80_000)
POOL_SPEC = T.TfidfSpec(most=1, min_df=1, max_df=1.0, features=40_000)
QUERY = "there and onth with tion"
SEEDS = ["3", "8", "13"]
REQUEST = S.Request(QUERY, "Bo Chen", 3, 5)
SUPPORT, CONFIDENCE = 0.001, 0.05
PAPER_SUPPORT, PAPER_CONFIDENCE = 0.005, 0.05
CONTEXT = ["cluster:A", "keyword:Brand#11", "keyword:Brand#23", "author:Supplier#000000003"]


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def texts(spark, d, most=None):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), clean_text(F.col("text")).alias("text"))


def search_index(spark, d):
    docs = texts(spark, d)
    rows = T.term_rows(docs, SEARCH_SPEC, [])
    vocab = staged(T.vocabulary(rows, docs, SEARCH_SPEC, []))
    return vocab, T.raw_weights(rows, vocab, [])


def search_rank(spark, d):
    vocab, index = search_index(spark, d)
    found = S.rank(papers(spark, d), T.text_scores(index, T.query_weights(QUERY, vocab, SEARCH_SPEC)), REQUEST)
    return rounded(found, "page_rank_score", "search_text_score").select("paper_id", "title", "cluster_id", "search_text_score", "author_match_score", "cluster_match_score", "page_rank_score")


CASES = {
    "topic": S.Request(QUERY), "author": S.Request(author="Bo Chen"), "cluster": S.Request(cluster=3), "topic_author": S.Request(QUERY, "Bo Chen"),
    "topic_cluster": S.Request(QUERY, cluster=3), "author_cluster": S.Request(author="chen", cluster=2), "all": S.Request(QUERY, "Bo Chen", 3),
}


def search_cases(spark, d):
    """Seven requests, of every mix of text, author and cluster, over one index."""
    vocab, index = search_index(spark, d)
    scores, everything = staged(T.text_scores(index, T.query_weights(QUERY, vocab, SEARCH_SPEC))), papers(spark, d)
    parts = [S.rank(everything, scores if r.text else scores.limit(0), r).select(F.lit(case).alias("request"), "paper_id", F.round("page_rank_score", 6).alias("page_rank_score")) for case, r in CASES.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def tfidf_weights(spark, d):
    index = T.tfidf(texts(spark, d), KEYWORD_SPEC)
    return rounded(index.groupBy("doc").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("weight").alias("best"), F.sum(F.col("weight") * F.col("weight")).alias("length")), "best", "length")


def doc_keywords(spark, d):
    return paper_keywords(spark, d).select("doc", F.array_join("keywords", ",").alias("keywords"))


def query_keywords(spark, d):
    vocab, _ = search_index(spark, d)
    return rounded(T.query_weights(QUERY, vocab, SEARCH_SPEC).orderBy(F.desc("weight"), "term").limit(6), "weight")


def baskets(spark, d):
    """Orders as papers: a cluster, brands as keywords, suppliers as authors."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    grouped = lines.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("c"), F.array_sort(F.collect_set("p_brand")).alias("k"), F.collect_set("l_suppkey").alias("s"))
    names = F.array_sort(F.transform("s", lambda x: F.concat(F.lit("Supplier#"), F.lpad(x.cast("string"), 9, "0"))))  # of the group, not of each line
    return grouped.select(F.col("l_orderkey").alias("txn"), R.transaction(F.col("c"), F.col("k"), names).alias("items"))


def all_rules(spark, d):
    return R.association_rules(R.frequent_pairs(baskets(spark, d), SUPPORT), CONFIDENCE)


def paper_keywords(spark, d):
    """(doc, keywords): the four best terms of each document's text."""
    return T.keywords(T.tfidf(texts(spark, d), KEYWORD_SPEC), 4, stop_words())


def paper_baskets(spark, d):
    """Papers with their cluster, the keywords of their text and their authors."""
    rows = papers(spark, d).join(paper_keywords(spark, d), F.col("doc") == F.col("paper_id"), "left")
    return rows.select(F.col("paper_id").alias("txn"), R.transaction(F.col("cluster_id"), F.col("keywords"), F.col("authors_list")).alias("items"))


def rules_of_papers(spark, d):
    return R.association_rules(R.frequent_pairs(paper_baskets(spark, d), PAPER_SUPPORT), PAPER_CONFIDENCE)


def paper_transactions(spark, d):
    return paper_baskets(spark, d).where(F.size("items") >= 2).select("txn", F.array_join(F.array_sort("items"), ",").alias("items"))


def paper_rules(spark, d):
    return flat(rules_of_papers(spark, d))


def rule_suggestions(spark, d):
    return flat(R.suggest(all_rules(spark, d), "brand#11 of cluster:r", "supplier#000000002"))


def rule_suggestion_papers(spark, d):
    """Papers that hold what suggested rules lead to, the rules being mined from the papers' own keywords."""
    plain = rules_of_papers(spark, d).withColumn("consequents", F.transform("consequents", lambda x: F.regexp_replace(x, "^[a-z]+:", "")))
    return R.suggested_papers(papers(spark, d), R.suggest(plain, "cluster:1 author:bo", "chen"), 20).select("paper_id", "year")


def flat(rules):
    return rounded(rules, "support", "confidence", "lift").withColumns({"antecedents": F.array_join("antecedents", ","), "consequents": F.array_join("consequents", ",")})


def transactions(spark, d):
    return baskets(spark, d).where(F.size("items") >= 2).select("txn", F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n"))


def frequent_pairs(spark, d):
    return R.frequent_pairs(baskets(spark, d), SUPPORT)


def association_rules(spark, d):
    return flat(all_rules(spark, d))


def rule_types(spark, d):
    return all_rules(spark, d).groupBy("rule_type").agg(F.count("*").alias("count"), F.round(F.max("lift"), 6).alias("best_lift"))


def rule_match(spark, d):
    return rounded(flat(R.match_rules(all_rules(spark, d), CONTEXT)), "context_score").withColumn("overlap", F.col("overlap").cast("long"))


def rule_browser(spark, d):
    found = R.browse(all_rules(spark, d), confidence=0.06, lift=1.0, words=["brand#11", "supplier#000000002"])
    return flat(found)


def vector_normalise(spark, d):
    from tessera.functions.vectors import cleaned, norm, unit

    v = unit(cleaned(F.col("embedding")))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(v), 6).alias("length"), F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"))


def vector_standardise(spark, d):
    from tessera.operators.vectors import standardised

    z = standardised(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v")
    return z.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def seed_centroid_neighbours(spark, d):
    return rounded(S.nearest(papers(spark, d), SEEDS), "embedding_similarity_score").select("paper_id", "embedding_similarity_score")


def same_cluster_neighbours(spark, d):
    return rounded(S.same_cluster(papers(spark, d), SEEDS), "same_cluster_similarity").select("paper_id", "cluster_id", "same_cluster_similarity")


def same_author(spark, d):
    return S.same_author(papers(spark, d), SEEDS, "Uma Vance").select("paper_id", "year", "same_author_score")


def association_recommend(spark, d):
    found = S.by_association(papers(spark, d), SEEDS, ["bo chen"], ["2"], ["topic5", "topic11"])
    return rounded(found, "association_embedding_similarity", "association_recommendation_score").select("paper_id", "association_author_score", "association_cluster_score", "association_keyword_score", "association_embedding_similarity", "association_recommendation_score")


def recommendation_document(spark, d):
    """The nested answer to a request, as JSON: one row for each entry of a section.

    Papers have the cluster that K-Means gives to their vector, where they have one, and the
    keywords of their text; the rules are mined from just these.
    """
    from tessera.operators.cluster import kmeans_labels
    from tessera.plans.ml_queries import vectors
    from tessera.plans.recommend import answer

    clusters = kmeans_labels(vectors(spark, d), "vec_id", "v").select(F.col("vec_id").cast("string").alias("paper_id"), F.col("cluster_id").alias("own_cluster"))
    rows = papers(spark, d).drop("paper_keywords").join(clusters, "paper_id", "left").join(paper_keywords(spark, d).withColumnRenamed("doc", "paper_id"), "paper_id", "left")
    rows = staged(rows.withColumns({"cluster_id": F.coalesce("own_cluster", "cluster_id"), "paper_keywords": F.coalesce("keywords", F.array().cast("array<string>"))}).drop("own_cluster", "keywords"))
    items = rows.select(F.col("paper_id").alias("txn"), R.transaction(F.col("cluster_id"), F.col("paper_keywords"), F.col("authors_list")).alias("items"))
    rules = R.association_rules(R.frequent_pairs(items, PAPER_SUPPORT), PAPER_CONFIDENCE)
    vocab, index = search_index(spark, d)
    return answer(rows, vocab, index, SEARCH_SPEC, rules, REQUEST)


def pool(spark, d):
    return S.with_filters(papers(spark, d), [1, 3, 4], (2016, 2024))


def app_search_blend(spark, d):
    chosen = pool(spark, d)
    docs = chosen.select(F.col("paper_id").alias("doc"), clean_text(F.col("abstract")).alias("text"))
    rows = T.term_rows(docs, POOL_SPEC, [])
    vocab = staged(T.vocabulary(rows, docs, POOL_SPEC, []))
    scores = T.text_scores(T.raw_weights(rows, vocab, []), T.query_weights(QUERY, vocab, POOL_SPEC))
    return rounded(S.blended_search(chosen, scores, "bo chen"), "search_score", "page_rank_score").select("paper_id", "search_score", "page_rank_score")


def app_similar_recency(spark, d):
    return rounded(S.similar_recent(papers(spark, d), pool(spark, d), "3"), "similarity_score", "page_rank_score").select("paper_id", "similarity_score", "page_rank_score")


def app_weighted_sample(spark, d):
    return S.weighted_sample(pool(spark, d), 10).select("paper_id", "year", "cluster_id")


def cluster_summary(spark, d):
    return papers(spark, d).groupBy("cluster_id").agg(F.count("*").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def map_join_filter(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("paper_id"), F.col("label").alias("cluster_p"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    rows = vectors.join(papers(spark, d).select("paper_id", "year", "cluster_id"), "paper_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "cluster_p"))
    return rounded(S.with_filters(rows, [0, 1, 2], (2015, 2022)), "x", "y").select("paper_id", "year", "cluster_id", "x", "y")


def keyword_papers(spark, d):
    """Papers whose title or abstract holds a keyword of more than three letters."""
    words = [w for w in ("tion", "the", "schaft", "ciónado") if len(w) > 3]
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.concat_ws(" ", "title", "abstract")), w))
    return papers(spark, d).where(hit).orderBy("paper_id").limit(20).select("paper_id", "year")


QUERIES = {
    f.__name__: f
    for f in (
        search_rank, search_cases, tfidf_weights, doc_keywords, query_keywords, transactions, frequent_pairs, association_rules, rule_types, rule_match, rule_browser, vector_normalise,
        vector_standardise, seed_centroid_neighbours, same_cluster_neighbours, same_author, association_recommend, recommendation_document, app_search_blend,
        app_similar_recency, app_weighted_sample, cluster_summary, map_join_filter, keyword_papers, paper_transactions, paper_rules, rule_suggestions, rule_suggestion_papers,
    )
}

BASKETS = """l AS (SELECT l_orderkey, l_returnflag, p_brand, 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS s FROM lineitem JOIN part ON l_partkey = p_partkey),
  g AS (SELECT l_orderkey AS txn, min(l_returnflag) AS c, list_sort(list(DISTINCT p_brand)) AS k, list_sort(list(DISTINCT s)) AS a FROM l GROUP BY 1),
  b AS (SELECT txn, ['cluster:' || c] || list_transform(k, lambda x: 'keyword:' || x) || list_transform(a[1:5], lambda x: 'author:' || x) AS items FROM g)"""


def pairs_sql(baskets: str, support: float) -> str:
    """CTEs up to ``pairs`` over CTEs that end in ``b`` (txn, items)."""
    return f"""WITH {baskets}, big AS (SELECT * FROM b WHERE len(items) >= 2), i AS (SELECT txn, unnest(items) AS item FROM big), t AS (SELECT count(*) AS n FROM big),
  c AS (SELECT item, count(*) AS c FROM i GROUP BY item HAVING count(*) >= (SELECT n FROM t) * {support}),
  p AS (SELECT x.item AS a, y.item AS b, count(*) AS n_ab FROM i x JOIN i y ON x.txn = y.txn AND x.item < y.item GROUP BY ALL),
  pairs AS (SELECT p.a, p.b, n_ab, ca.c AS n_a, cb.c AS n_b, n FROM p JOIN c ca ON ca.item = p.a JOIN c cb ON cb.item = p.b, t WHERE n_ab >= n * {support})"""


PAIRS = pairs_sql(BASKETS, SUPPORT)
KINDS = """CASE WHEN a LIKE 'keyword:%' AND b LIKE 'cluster:%' THEN 'keyword_to_topic' WHEN a LIKE 'cluster:%' AND b LIKE 'keyword:%' THEN 'topic_to_keyword' WHEN a LIKE 'keyword:%' AND b LIKE 'author:%' THEN 'keyword_to_author'
  WHEN a LIKE 'author:%' AND b LIKE 'keyword:%' THEN 'author_to_keyword' WHEN a LIKE 'author:%' AND b LIKE 'cluster:%' THEN 'author_to_topic' WHEN a LIKE 'cluster:%' AND b LIKE 'author:%' THEN 'topic_to_author'
  WHEN a LIKE 'author:%' AND b LIKE 'author:%' THEN 'author_to_author' WHEN a LIKE 'keyword:%' AND b LIKE 'keyword:%' THEN 'keyword_to_keyword' WHEN a LIKE 'cluster:%' AND b LIKE 'cluster:%' THEN 'topic_to_topic' ELSE 'mixed_rule' END"""


def rules_sql(pairs: str, confidence: float) -> str:
    return f"""{pairs}, sides AS (SELECT a, b, n_ab, n_a, n_b, n FROM pairs UNION ALL SELECT b, a, n_ab, n_b, n_a, n FROM pairs),
  rules AS (SELECT a AS antecedents, b AS consequents, n_ab / n AS support, n_ab / n_a AS confidence, (n_ab / n_a) / (n_b / n) AS lift, {KINDS} AS rule_type FROM sides WHERE n_ab / n_a >= {confidence})"""


RULES = rules_sql(PAIRS, CONFIDENCE)
FLAT = "antecedents, consequents, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, rule_type"


def oracle() -> dict[str, str]:
    text = f"SELECT 0 AS one, doc_id::VARCHAR AS doc, {clean_sql('text')} AS text FROM documents"
    stop = "[" + ", ".join(f"'{w}'" for w in stop_words()) + "]"

    def query(spec: T.TfidfSpec) -> str:
        grams = "t" + (" || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])" if spec.most > 1 else "")
        return f"""qt AS (SELECT list_filter(regexp_extract_all('{QUERY}', '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_]+'), lambda x: NOT list_contains({stop}, x)) AS t),
          qf AS (SELECT term, count(*) AS tf FROM (SELECT unnest({grams}) AS term FROM qt) GROUP BY term), qu AS (SELECT term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM qf JOIN vocab USING (term)),
          q AS (SELECT term, raw / sqrt((SELECT sum(raw * raw) FROM qu)) AS q FROM qu), scores AS (SELECT doc, sum(weight * q) AS score FROM w JOIN q USING (term) GROUP BY doc)"""

    def author(q: str) -> str:
        return f"coalesce(list_filter(list_transform(authors_list, lambda a: CASE WHEN lower(trim(a)) = '{q}' THEN 1.0 WHEN contains(lower(trim(a)), '{q}') OR contains('{q}', lower(trim(a))) THEN 0.8 ELSE 0.0 END), lambda s: s > 0)[1], 0)::DOUBLE"

    seeds = ", ".join(f"'{s}'" for s in SEEDS)
    p = f"p AS ({PAPERS_SQL})"
    centre = f"""{p}, e AS (SELECT unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM p WHERE paper_id IN ({seeds}) AND embedding IS NOT NULL), ce AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM e GROUP BY i)),
      sim AS (SELECT p.*, coalesce(list_cosine_similarity(embedding, c), 0) AS sim FROM p, ce)"""
    pool_sql = f"{p}, pool AS (SELECT * FROM p WHERE cluster_id IN (1, 3, 4) AND year BETWEEN 2016 AND 2024), y AS (SELECT min(year) AS a, max(year) AS b FROM pool)"
    shared = "len(list_intersect(list_transform(authors_list, lambda x: lower(trim(x))), {}))"
    assoc = f"""SELECT paper_id, {shared.format("['bo chen']")}::DOUBLE AS aa, (cluster_id = 2)::INT::DOUBLE AS ac, len(list_intersect(list_distinct(paper_keywords), ['topic5', 'topic11']))::DOUBLE AS ak, sim FROM sim WHERE paper_id NOT IN ({seeds})"""
    names = f"SELECT list(DISTINCT lower(trim(a))) AS l FROM (SELECT unnest(authors_list) AS a FROM p WHERE paper_id IN ({seeds}) UNION ALL SELECT 'Uma Vance')"
    context = "[" + ", ".join(f"'{c}'" for c in CONTEXT) + "]"
    words = "list_filter(list_transform(list(term ORDER BY k), lambda t: {}), lambda x: x IS NOT NULL)"
    one = f"CASE WHEN length(t) >= 3 AND NOT list_contains({stop}, t) THEN t END"
    from_papers = f"""{tfidf_sql(KEYWORD_SPEC, 'one', text)}, k AS (SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term) AS k FROM w QUALIFY k <= 4),
      kw AS (SELECT doc, list_distinct({words.format(one)}) AS keywords FROM k GROUP BY doc), pp AS ({PAPERS_SQL}),
      b AS (SELECT paper_id AS txn, list_distinct(['cluster:' || cluster_id] || list_transform(coalesce(keywords, []), lambda x: 'keyword:' || x) || list_transform(authors_list[1:5], lambda x: 'author:' || x)) AS items
            FROM pp LEFT JOIN kw ON doc = paper_id)"""
    paper_rules = rules_sql(pairs_sql(from_papers, PAPER_SUPPORT), PAPER_CONFIDENCE)

    def case(name: str, r: S.Request) -> str:
        st = "coalesce(score, 0)" if r.text else "0"
        sa = author(r.author.lower()) if r.author else "0"
        sc = f"(cluster_id = {r.cluster})::INT" if r.cluster is not None else "0"
        return f"""(SELECT '{name}' AS request, paper_id, round(sp, 6) AS page_rank_score FROM (SELECT *, 0.6 * st + 0.25 * sa + 0.15 * sc AS sp
            FROM (SELECT paper_id, {st}::DOUBLE AS st, {sa}::DOUBLE AS sa, {sc}::DOUBLE AS sc FROM p LEFT JOIN scores ON doc = paper_id)) ORDER BY sp DESC, sa DESC, st DESC, paper_id LIMIT 5)"""

    return {
        "search_cases": f"WITH {tfidf_sql(SEARCH_SPEC, 'one', text)}, {query(SEARCH_SPEC)}, {p} " + " UNION ALL ".join(case(n, r) for n, r in CASES.items()),
        "search_rank": f"""WITH {tfidf_sql(SEARCH_SPEC, 'one', text)}, {query(SEARCH_SPEC)}, {p},
            s AS (SELECT paper_id, title, cluster_id, coalesce(score, 0) AS st, {author('bo chen')} AS sa, (cluster_id = 3)::INT::DOUBLE AS sc FROM p LEFT JOIN scores ON doc = paper_id), f AS (SELECT *, 0.6 * st + 0.25 * sa + 0.15 * sc AS sp FROM s)
            SELECT paper_id, title, cluster_id, round(st, 6) AS search_text_score, sa AS author_match_score, sc AS cluster_match_score, round(sp, 6) AS page_rank_score FROM f ORDER BY sp DESC, sa DESC, st DESC, paper_id LIMIT 5""",
        "tfidf_weights": f"WITH {tfidf_sql(KEYWORD_SPEC, 'one', text)} SELECT doc, count(*) AS terms, sum(tf)::BIGINT AS tokens, round(max(weight), 6) AS best, round(sum(weight * weight), 6) AS length FROM w GROUP BY doc",
        "doc_keywords": f"""WITH {tfidf_sql(KEYWORD_SPEC, 'one', text)}, k AS (SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term) AS k FROM w QUALIFY k <= 4)
            SELECT doc, array_to_string({words.format(one)}, ',') AS keywords FROM k GROUP BY doc HAVING len({words.format(one)}) > 0""",
        "query_keywords": f"WITH {tfidf_sql(SEARCH_SPEC, 'one', text)}, {query(SEARCH_SPEC)} SELECT term, round(q, 6) AS weight FROM q ORDER BY q DESC, term LIMIT 6",
        "transactions": f"WITH {BASKETS} SELECT txn, array_to_string(items, ',') AS items, len(items) AS n FROM b WHERE len(items) >= 2",
        "frequent_pairs": f"{PAIRS} SELECT * FROM pairs",
        "association_rules": f"{RULES} SELECT {FLAT} FROM rules",
        "rule_types": f"{RULES} SELECT rule_type, count(*) AS count, round(max(lift), 6) AS best_lift FROM rules GROUP BY rule_type",
        "rule_match": f"""{RULES}, m AS (SELECT *, lift * confidence * (1 + support) AS score FROM rules WHERE list_contains({context}, antecedents))
            SELECT {FLAT}, 1::BIGINT AS overlap, round(score, 6) AS context_score FROM m ORDER BY score DESC, m.lift DESC, m.confidence DESC, antecedents, consequents LIMIT 10""",
        "rule_browser": f"{RULES} SELECT {FLAT} FROM rules r WHERE r.confidence >= 0.06 AND r.lift >= 1 AND (contains(lower(antecedents || ' ' || consequents), 'brand#11') OR contains(lower(antecedents || ' ' || consequents), 'supplier#000000002'))",
        "vector_normalise": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS length, round(e[1] / n, 6) AS first, round(e[64] / n, 6) AS last FROM v",
        "vector_standardise": """WITH e AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM e GROUP BY i),
            z AS (SELECT vec_id, i, (x - m) / CASE WHEN d = 0 THEN 1 ELSE d END AS z FROM e JOIN s USING (i)) SELECT vec_id, round(max(z) FILTER (i = 1), 6) AS first, round(max(z) FILTER (i = 64), 6) AS last, round(sum(z), 5) AS total FROM z GROUP BY vec_id""",
        "seed_centroid_neighbours": f"WITH {centre} SELECT paper_id, round(sim, 6) AS embedding_similarity_score FROM sim WHERE paper_id NOT IN ({seeds}) ORDER BY sim DESC, paper_id LIMIT 10",
        "same_cluster_neighbours": f"WITH {centre} SELECT paper_id, cluster_id, round(sim, 6) AS same_cluster_similarity FROM sim WHERE paper_id NOT IN ({seeds}) AND cluster_id IN (SELECT cluster_id FROM p WHERE paper_id IN ({seeds})) ORDER BY sim DESC, paper_id LIMIT 10",
        "same_author": f"WITH {p}, n AS ({names}), s AS (SELECT paper_id, year, {shared.format('l')}::DOUBLE AS same_author_score FROM p, n) SELECT * FROM s WHERE same_author_score > 0 AND paper_id NOT IN ({seeds}) ORDER BY same_author_score DESC, year DESC, paper_id LIMIT 10",
        "association_recommend": f"""WITH {centre}, a AS ({assoc}), s AS (SELECT *, 0.25 * aa + 0.2 * ac + 0.3 * ak + 0.25 * sim AS score FROM a)
            SELECT paper_id, aa AS association_author_score, ac AS association_cluster_score, ak AS association_keyword_score, round(sim, 6) AS association_embedding_similarity, round(score, 6) AS association_recommendation_score
            FROM s WHERE (aa > 0 OR ak > 0 OR sim >= 0.35) AND score > 0 ORDER BY score DESC, paper_id LIMIT 10""",
        "app_search_blend": f"""WITH {pool_sql}, {tfidf_sql(POOL_SPEC, 'one', f"SELECT 0 AS one, paper_id AS doc, {clean_sql('abstract')} AS text FROM pool")}, {query(POOL_SPEC)},
            c AS (SELECT cluster_id, count(*) / (SELECT count(*) FROM pool) AS pop FROM pool GROUP BY cluster_id),
            r AS (SELECT paper_id, coalesce(score, 0) + CASE WHEN contains(lower(array_to_string(authors_list, ' ; ')), 'bo') AND contains(lower(array_to_string(authors_list, ' ; ')), 'chen') THEN 0.5 ELSE 0 END AS raw, pop, (year - a) / greatest(b - a, 1) AS rec
                  FROM pool LEFT JOIN scores ON doc = paper_id JOIN c USING (cluster_id), y), f AS (SELECT *, 0.65 * raw + 0.2 * pop / ((SELECT max(pop) FROM c) + 1e-9) + 0.15 * rec AS s FROM r)
            SELECT paper_id, round(raw, 6) AS search_score, round(s, 6) AS page_rank_score FROM f ORDER BY s DESC, paper_id LIMIT 10""",
        "app_similar_recency": f"""WITH {pool_sql}, o AS (SELECT embedding AS c FROM p WHERE paper_id = '3'), n AS (SELECT paper_id, coalesce(list_cosine_similarity(embedding, c), 0) AS s FROM p, o WHERE paper_id <> '3' ORDER BY s DESC, paper_id LIMIT 50),
            k AS (SELECT paper_id, s, year FROM pool JOIN n USING (paper_id) ORDER BY s DESC, paper_id LIMIT 10) SELECT paper_id, round(s, 6) AS similarity_score, round(0.75 * s + 0.25 * (year - a) / greatest(b - a, 1), 6) AS page_rank_score FROM k, y""",
        "cluster_summary": f"WITH {p} SELECT cluster_id, count(*) AS papers, min(year) AS first_year, max(year) AS last_year FROM p GROUP BY cluster_id",
        "map_join_filter": f"""WITH {p}, m AS (SELECT vec_id::VARCHAR AS paper_id, p.year, coalesce(p.cluster_id, label) AS cluster_id, e.embedding[1]::DOUBLE AS x, e.embedding[2]::DOUBLE AS y FROM embeddings e LEFT JOIN p ON p.paper_id = vec_id::VARCHAR)
            SELECT paper_id, year, cluster_id, round(x, 6) AS x, round(y, 6) AS y FROM m WHERE cluster_id IN (0, 1, 2) AND coalesce(year, -1) BETWEEN 2015 AND 2022""",
        "paper_transactions": f"WITH {from_papers} SELECT txn, array_to_string(list_sort(items), ',') AS items FROM b WHERE len(items) >= 2",
        "paper_rules": f"{paper_rules} SELECT {FLAT} FROM rules",
        "rule_suggestions": f"{RULES} SELECT {FLAT} FROM rules r WHERE contains(lower(antecedents), 'brand#11') OR contains(lower(antecedents), 'cluster:r') OR contains(lower(antecedents), 'supplier#000000002') ORDER BY r.confidence DESC, r.lift DESC, antecedents, consequents LIMIT 8",
        "rule_suggestion_papers": f"""{paper_rules}, s AS (SELECT * FROM rules WHERE contains(lower(antecedents), 'cluster:1') OR contains(lower(antecedents), 'author:bo') OR contains(lower(antecedents), 'chen')
            ORDER BY confidence DESC, lift DESC, antecedents, regexp_replace(consequents, '^[a-z]+:', '') LIMIT 8),
            v AS (SELECT DISTINCT x FROM (SELECT unnest(string_split(lower(regexp_replace(consequents, '^[a-z]+:', '')), ' ')) AS x FROM s) WHERE length(x) > 3)
            SELECT paper_id, year FROM pp WHERE EXISTS (SELECT 1 FROM v WHERE contains(lower(coalesce(title, '')), x) OR contains(lower(coalesce(abstract, '')), x)) ORDER BY paper_id LIMIT 20""",
        "keyword_papers": f"WITH {p} SELECT paper_id, year FROM p WHERE len(list_filter(['tion', 'schaft', 'ciónado'], lambda w: contains(lower(concat_ws(' ', title, abstract)), w))) > 0 ORDER BY paper_id LIMIT 20",
    }
