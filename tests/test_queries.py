import json

import pytest
from conftest import SF
from oracle import same

from tessera.plans import registry

NO_SQL = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))
SLOW = {"keyword_heatmap", "trending_keywords", "keyword_rank_pivot"}  # as keywords_per_year


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - SLOW))
def test_query_equals_its_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", NO_SQL)
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_recommendation_document_is_connected(spark):
    """Every matched rule starts from an item of the context, and what it leads to is among the recommendations."""
    rows = registry.QUERIES["recommendation_document"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.section, []).append(json.loads(r.paper))
    context = by["search_context"][0]
    items = {f"keyword:{w}" for w in context["query_keywords_used_for_rules"]} | {f"author:{context['author_query']}", f"cluster:{context['cluster_query']}"}
    for paper in by["page_ranking"]:
        items |= {f"cluster:{paper['cluster_id']}", *[f"keyword:{k}" for k in paper["paper_keywords"]], *[f"author:{a}" for a in paper["authors_list"]]}
    found = {x for kind in ("author", "cluster", "keyword") for x in [f"{kind}:{v}" for v in by.get(f"recommended_{kind}s", [])]}
    assert len(by["matched_rules"]) > 0
    for rule in by["matched_rules"]:
        assert set(rule["antecedents"]) & items and set(rule["consequents"]) <= found
    assert {"paper_to_paper_embedding_similarity", "same_cluster_topic_papers", "same_author_papers", "recommended_papers"} <= set(by)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
