import os

import pytest
from conftest import SF
from oracle import TABLES, same

from tessera.plans import registry

NAMES = ["transactions", "frequent_pairs", "association_rules", "rule_types", "rule_match", "rule_browser"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Twelve orders of three lines, by suppliers 9 to 14."""
    d = str(tmp_path_factory.mktemp("baskets"))
    lines = [(o, 1 + (o + i) % 4, 9 + (o + 2 * i) % 6, "ANR"[o % 3]) for o in range(1, 13) for i in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#11"), (2, "Brand#11"), (3, "Brand#23"), (4, "Brand#44")], "p_partkey long, p_brand string").write.parquet(f"{d}/part.parquet")
    for t in set(TABLES) - {"lineitem", "part"}:
        os.symlink(f"{SF}/{t}.parquet", f"{d}/{t}.parquet")
    return d


def test_every_order_is_a_basket(spark, small):
    rows = registry.QUERIES["transactions"](spark, small).collect()
    assert {r.txn for r in rows} == set(range(1, 13))
    assert {x for r in rows for x in r["items"].split(",") if x.startswith("author:")} == {f"author:Supplier#{i:09d}" for i in range(9, 15)}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_on_small_orders(spark, small, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], small)


def test_pairs_are_numbers_of_frequent_items():
    import pyarrow as pa

    from tessera.operators.rules import pair_keys, pairs_of

    items = pa.array([["z"], ["c", "x", "a"], [], ["b", "a", "c"], ["a"]], pa.list_(pa.string())).slice(1)
    names = pa.array(["a", "b", "c"])
    keys = pair_keys(items, names)
    assert sorted(keys.tolist()) == [1, 2, 2, 5]
    assert pairs_of({2: 2}, names).to_pylist() == [{"a": "a", "b": "c", "n": 2}] and len(pair_keys(items, names.slice(0, 0))) == 0
