"""Ranked search and recommendation over papers.

A papers table has paper_id, authors_list, cluster_id, year, paper_keywords and
embedding (array<double>), as far as an operator names them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.papers import author_score, overlap
from tessera.functions.vectors import cosine, literal

# Weights of the blends.
TEXT, AUTHOR, CLUSTER = 0.60, 0.25, 0.15
ASSOC_AUTHOR, ASSOC_CLUSTER, ASSOC_KEYWORD, ASSOC_VECTOR, ASSOC_LEAST = 0.25, 0.20, 0.30, 0.25, 0.35
RAW, POPULAR, RECENT, AUTHOR_BOOST = 0.65, 0.20, 0.15, 0.5
SIMILAR, SIMILAR_RECENT, OVERSAMPLE = 0.75, 0.25, 5


@dataclass(frozen=True)
class Request:
    """A search: any of text, author and cluster."""

    text: str | None = None
    author: str | None = None
    cluster: int | None = None
    top_k: int = 5


def rank(papers: DataFrame, scores: DataFrame, request: Request) -> DataFrame:
    """The top_k papers by 0.60 text + 0.25 author + 0.15 cluster; papers without a text score have 0."""
    joined = papers.join(scores.select(F.col("doc").alias("paper_id"), "score"), "paper_id", "left")
    text = F.coalesce("score", F.lit(0.0))
    author = author_score(F.col("authors_list"), request.author or "")
    cluster = F.lit(0.0) if request.cluster is None else (F.col("cluster_id") == request.cluster).cast("double")
    out = joined.withColumns({"search_text_score": text, "author_match_score": author, "cluster_match_score": F.coalesce(cluster, F.lit(0.0))}).drop("score")
    out = out.withColumn("page_rank_score", TEXT * F.col("search_text_score") + AUTHOR * F.col("author_match_score") + CLUSTER * F.col("cluster_match_score"))
    return out.orderBy(F.desc("page_rank_score"), F.desc("author_match_score"), F.desc("search_text_score"), "paper_id").limit(request.top_k)


def centroid(papers: DataFrame, seeds: list[str]) -> list[float] | None:
    """Mean vector of the seeds, a row for each component; None if there is no seed with a vector."""
    parts = papers.where(F.col("paper_id").isin(seeds)).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()
    return [r.x for r in parts] or None


def similarity(papers: DataFrame, seed: list[float] | None) -> Column:
    """Cosine to the seed vector, which is a literal of the plan: no join."""
    return F.coalesce(cosine(F.col("embedding"), literal(seed)), F.lit(0.0)) if seed else F.lit(0.0)


def nearest(papers: DataFrame, seeds: list[str], k: int = 10) -> DataFrame:
    """The k papers most similar to the seeds' centroid."""
    scored = papers.withColumn("embedding_similarity_score", similarity(papers, centroid(papers, seeds)))
    return scored.where(~F.col("paper_id").isin(seeds)).orderBy(F.desc("embedding_similarity_score"), "paper_id").limit(k)


def same_cluster(papers: DataFrame, seeds: list[str], k: int = 10) -> DataFrame:
    """The k papers of the seeds' clusters most similar to their centroid."""
    clusters = [r.cluster_id for r in papers.where(F.col("paper_id").isin(seeds)).select("cluster_id").distinct().collect()]
    scored = papers.withColumn("same_cluster_similarity", similarity(papers, centroid(papers, seeds)))
    return scored.where(F.col("cluster_id").isin(clusters) & ~F.col("paper_id").isin(seeds)).orderBy(F.desc("same_cluster_similarity"), "paper_id").limit(k)


def same_author(papers: DataFrame, seeds: list[str], author: str | None = None, k: int = 10) -> DataFrame:
    """The k papers that share most authors with the seeds; newer first."""
    found = papers.where(F.col("paper_id").isin(seeds)).select(F.explode("authors_list").alias("a")).distinct().collect()
    names = sorted({r.a.strip().lower() for r in found} | ({author.strip().lower()} if author else set()))
    scored = papers.withColumn("same_author_score", overlap(F.col("authors_list"), F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).cast("double"))
    return scored.where((F.col("same_author_score") > 0) & ~F.col("paper_id").isin(seeds)).orderBy(F.desc("same_author_score"), F.desc_nulls_last("year"), "paper_id").limit(k)


def by_association(papers: DataFrame, seeds: list[str], authors: list[str], clusters: list[str], words: list[str], k: int = 10) -> DataFrame:
    """The k papers that what matched rules lead to speaks for; a shared cluster alone is not enough."""
    lists = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    out = papers.withColumns({
        "association_embedding_similarity": similarity(papers, centroid(papers, seeds)),
        "association_author_score": overlap(F.col("authors_list"), lists(authors)).cast("double"),
        "association_cluster_score": F.coalesce(F.col("cluster_id").cast("string").isin(clusters).cast("double"), F.lit(0.0)),
        "association_keyword_score": overlap(F.col("paper_keywords"), lists(words)).cast("double"),
    })
    score = ASSOC_AUTHOR * F.col("association_author_score") + ASSOC_CLUSTER * F.col("association_cluster_score") + ASSOC_KEYWORD * F.col("association_keyword_score") + ASSOC_VECTOR * F.col("association_embedding_similarity")
    good = (F.col("association_author_score") > 0) | (F.col("association_keyword_score") > 0) | (F.col("association_embedding_similarity") >= ASSOC_LEAST)
    out = out.withColumn("association_recommendation_score", score)
    return out.where(good & (F.col("association_recommendation_score") > 0) & ~F.col("paper_id").isin(seeds)).orderBy(F.desc("association_recommendation_score"), "paper_id").limit(k)


def bounds(papers: DataFrame) -> DataFrame:
    """One row (first_year, last_year) over the pool."""
    return papers.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def recency() -> Column:
    """Year on a scale from 0 to 1 between first_year and last_year; a null year counts as the first."""
    year = F.coalesce("year", "first_year")
    return (year - F.col("first_year")) / F.greatest(F.col("last_year") - F.col("first_year"), F.lit(1))


def blended_search(pool: DataFrame, scores: DataFrame, author: str = "", k: int = 10) -> DataFrame:
    """Search of a filtered pool: 0.65 text and author, 0.20 popularity of the cluster, 0.15 recency.

    All words of the author query must stand in the names.  Without any query the
    first k papers come with scores of 0.
    """
    names = F.lower(F.array_join("authors_list", " ; "))
    words = author.strip().lower().split()
    boost = F.when(F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(names, w)), F.lit(AUTHOR_BOOST)).otherwise(0.0) if words else F.lit(0.0)
    share = pool.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("in_cluster"))
    most = share.agg(F.max("in_cluster").alias("most"), F.sum("in_cluster").alias("all"))
    joined = pool.join(scores.select(F.col("doc").alias("paper_id"), "score"), "paper_id", "left").join(F.broadcast(share), "cluster_id", "left")  # a row for each cluster
    joined = joined.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(bounds(pool)))  # one row each
    popular = F.coalesce(F.col("in_cluster") / F.col("all"), F.lit(0.0)) / (F.col("most") / F.col("all") + 1e-9)
    out = joined.withColumn("search_score", F.coalesce("score", F.lit(0.0)) + boost)
    out = out.withColumn("page_rank_score", RAW * F.col("search_score") + POPULAR * F.coalesce(popular, F.lit(0.0)) + RECENT * recency())
    return out.orderBy(F.desc("page_rank_score"), "paper_id").limit(k)


def similar_recent(papers: DataFrame, pool: DataFrame, paper_id: str, k: int = 10) -> DataFrame:
    """The k papers of a pool most similar to one paper, out of the 5 k most similar of all, by 0.75 similarity + 0.25 recency."""
    own = papers.where(F.col("paper_id") == paper_id).select("embedding").first()
    scored = papers.where(F.col("paper_id") != paper_id).select("paper_id", similarity(papers, list(own.embedding) if own and own.embedding else None).alias("similarity_score"))
    near = scored.orderBy(F.desc("similarity_score"), "paper_id").limit(OVERSAMPLE * k)
    found = pool.join(F.broadcast(near), "paper_id").orderBy(F.desc("similarity_score"), "paper_id").limit(k)  # at most 5 k rows
    out = found.crossJoin(F.broadcast(bounds(pool))).withColumn("page_rank_score", SIMILAR * F.col("similarity_score") + SIMILAR_RECENT * recency())
    return out.orderBy(F.desc("page_rank_score"), "paper_id")


def weighted_sample(pool: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k papers without replacement, newer ones likelier: the largest ln(u) / w, with u from a hash of the id (Efraimidis and Spirakis, 2006)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "paper_id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    weight = (F.coalesce("year", "first_year") - F.col("first_year") + 1) / (F.col("last_year") - F.col("first_year") + 1)
    keyed = pool.crossJoin(F.broadcast(bounds(pool))).withColumn("_key", F.log(u) / weight)
    return keyed.orderBy(F.desc("_key"), "paper_id").limit(k).drop("_key", "first_year", "last_year")


def hash_sample(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """k rows without replacement, the same for the same ids."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(k)


def with_filters(df: DataFrame, clusters: list[int] | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Rows of the clusters (all if none are named) and years; a null year lies before all."""
    out = df.where(F.col("cluster_id").isin(clusters)) if clusters else df
    return out.where(F.coalesce("year", F.lit(-1)).between(*years)) if years else out
