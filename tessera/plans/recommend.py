"""The full answer to a search request: ranking, plain recommendations, recommendations by rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import rules as R
from tessera.operators import search as S
from tessera.operators import tfidf as T
from tessera.plans.staging import staged

PAPER = ["paper_id", "title", "authors_list", "paper_keywords", "year", "cluster_id"]


def context_items(top: list, words: list[str], request: S.Request) -> list[str]:
    """Items of the request and of its top results: keywords, author, cluster."""
    items = [f"keyword:{w}" for w in words] + ([f"author:{request.author}"] if request.author else []) + ([f"cluster:{request.cluster}"] if request.cluster is not None else [])
    for row in top:
        items += [f"cluster:{row.cluster_id}", *[f"keyword:{k}" for k in row.paper_keywords], *[f"author:{a}" for a in row.authors_list]]
    return list(dict.fromkeys(items))


def answer(papers: DataFrame, vocab: DataFrame, index: DataFrame, spec: T.TfidfSpec, rules: DataFrame, request: S.Request) -> DataFrame:
    """(section, score, paper_id, paper): every section of the answer, each entry as JSON; at most some tens of rows.

    Papers, rules and context share their items: clusters, keywords and authors as the rules were mined from.
    """
    query = T.query_weights(request.text or "", vocab, spec)
    top = staged(S.rank(papers, T.text_scores(index, query), request))
    seeds = [r.paper_id for r in top.select("paper_id").collect()]
    words = [r.term for r in query.orderBy(F.desc("weight"), "term").limit(6).collect()]
    matched = staged(R.match_rules(rules, context_items(top.select("cluster_id", "paper_keywords", "authors_list").collect(), words, request)))
    to = R.targets(matched)
    sections = {
        "page_ranking": (top, "page_rank_score"),
        "paper_to_paper_embedding_similarity": (S.nearest(papers, seeds), "embedding_similarity_score"),
        "same_cluster_topic_papers": (S.same_cluster(papers, seeds), "same_cluster_similarity"),
        "same_author_papers": (S.same_author(papers, seeds, request.author), "same_author_score"),
        "recommended_papers": (S.by_association(papers, seeds, to["author"], to["cluster"], to["keyword"]), "association_recommendation_score"),
    }
    parts = None
    for section, (found, score) in sections.items():
        record = F.to_json(F.struct(*PAPER, F.when(~F.isnan(score), F.round(score, 6)).alias(score)))
        part = found.select(F.lit(section).alias("section"), F.round(score, 6).alias("score"), "paper_id", record.alias("paper"))
        parts = part if parts is None else parts.unionByName(part)
    spark, schema = papers.sparkSession, "section string, score double, paper_id string, paper string"
    context = {"query_text": request.text, "author_query": request.author, "cluster_query": request.cluster, "top_k": request.top_k, "query_keywords_used_for_rules": words}
    lists = [("search_context", None, None, json.dumps(context, ensure_ascii=False))]
    for kind in ("author", "cluster", "keyword"):
        lists += [(f"recommended_{kind}s", None, None, json.dumps(x, ensure_ascii=False)) for x in to[kind]]
    rule = F.to_json(F.struct("antecedents", "consequents", *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")], "rule_type", "overlap"))
    found = matched.select(F.lit("matched_rules").alias("section"), F.round("context_score", 6).alias("score"), F.lit(None).cast("string").alias("paper_id"), rule.alias("paper"))
    return parts.unionByName(spark.createDataFrame(lists, schema)).unionByName(found)
