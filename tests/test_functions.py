import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import papers as P
from tessera.functions import text as X
from tessera.operators import evaluate, rules, search, tfidf, trends
from tessera.plans import registry
from tessera.operators.cluster import dbscan_labels, merge_tree
from tessera.operators.forecast import forecast
from tessera.operators.reduce import components, layout


def one(spark, expr, *values):
    return spark.range(1).select(expr).first()[0]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        (None, ""), ("", ""), ("a $$x\ny$$ b", "a b"), (r"a \[x\] b", "a b"), ("cost $x+y$ here", "cost here"), (r"\emph{Word} \alpha", "word"), ("see https://a.b/c now", "see now"),
        ("arXiv:1234.5678 is", "is"), ("mail me@x.org ok", "mail ok"), ("a {b} c", "a c"), ("a [12] b", "a b"), ("a (b) c (longer one)", "a c longer one"), ("in 1999 or 3.5 x2", "in or x2"),
        ("Naïve — test", "na ve test"),
    ],
)
def test_clean_text(spark, text, clean):
    assert one(spark, X.clean_text(F.lit(text).cast("string"))) == clean


def test_clean_text_runs_the_steps_of_the_contract(spark):
    """The steps as they run give what CLEANING gives one after the other, on texts of characters that it names and on odd ones."""
    pick = np.random.default_rng(3)
    letters = ["a", "B", "7", ".", "@", "@", "$", "\\", "{", "}", "[", "]", "(", ")", " ", " ", "\n", "\x0b", "\x85", "\u2028", "\u00a0", "-", "/", ":", "`", "_", "\u00e9", "\u0130", "\u212a", "\U0001f600", "http://", "arXiv:"]
    df = spark.createDataFrame([("".join(pick.choice(letters, pick.integers(1, 40))),) for _ in range(3000)], "t string").coalesce(1)
    old = F.col("t")
    for pattern, to in X.CLEANING:
        old = F.regexp_replace(old, pattern, to)
    rows = df.select("t", X.clean_text(F.col("t")).alias("new"), F.trim(F.regexp_replace(F.lower(old), r"\s+", " ")).alias("old")).collect()
    assert [r for r in rows if r.new != r.old] == []


def test_labels_judge_each_record_by_its_own_text(spark, tmp_path):
    """Two records with one id, of which one is too short once it is clean: the other's length does not keep it."""
    long, short = "word " * 100, "[" + "x" * 450 + "] word"
    spark.createDataFrame([(7, long, "en"), (14_007, short, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["label_corpus"](spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize(("categories", "group", "profile"), [("cs.LG", "cs", "cs"), ("math-ph x", "math", "math-ph"), ("hep-th", "hep", "hep-th"), ("q-bio.NC", None, "q-bio"), ("", None, None), (None, None, None)])
def test_groups(spark, categories, group, profile):
    c = F.lit(categories).cast("string")
    assert (one(spark, P.primary_group(c)), one(spark, P.profile_group(c))) == (group, profile)


@pytest.mark.parametrize(("paper", "month"), [("1510.01234", 10), ("hep-th/9901001", 1), ("1513.00001", None), ("abc", None), (None, None)])
def test_month_of_id(spark, paper, month):
    assert one(spark, P.month_of_id(F.lit(paper).cast("string"))) == month


@pytest.mark.parametrize(("names", "query", "score"), [(["Ada Byron"], "ada byron", 1.0), (["Ada Byron"], "byron", 0.8), (["Li"], "Li Wei", 0.8), (["X", "Ada"], "ada", 1.0), ([], "ada", 0.0), (["Ada"], "", 0.0), (["Ada"], "zed", 0.0)])
def test_author_score(spark, names, query, score):
    authors = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    assert one(spark, P.author_score(authors, query)) == score


@pytest.mark.parametrize(("left", "right", "kind"), [("keyword:a", "cluster:1", "keyword_to_topic"), ("author:a", "author:b", "author_to_author"), ("cluster:1", "author:a", "topic_to_author"), ("x", "y", "mixed_rule")])
def test_rule_kind(spark, left, right, kind):
    assert one(spark, P.rule_kind(F.array(F.lit(left)), F.array(F.lit(right)))) == kind


def test_minmax(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), ("b", 2.0), ("c", None)], "g string, x double")
    got = df.select("g", "x", evaluate.minmax(F.col("x"), ["g"]).alias("up"), evaluate.minmax(F.col("x"), ["g"], True).alias("down")).collect()
    assert {(r.g, r.x): (r.up, r.down) for r in got} == {("a", 1.0): (0.0, 1.0), ("a", 3.0): (1.0, 0.0), ("a", None): (0.0, 0.0), ("b", 2.0): (0.5, 0.5), ("c", None): (0.0, 0.0)}


def test_golden_scores(spark):
    rule = spark.createDataFrame([(["keyword:a"], ["cluster:1"], 0.00225, 0.77586, 2.85642)], "antecedents array<string>, consequents array<string>, support double, confidence double, lift double")
    assert math.isclose(rules.match_rules(rule, ["keyword:a"]).first().context_score, 2.2212, rel_tol=1e-4)
    assert rules.match_rules(rule, ["keyword:b"]).count() == rules.match_rules(rule, []).count() == 0
    papers = spark.createDataFrame([("1", ["Ada Byron"], 1), ("2", ["Bo Chen"], 2), ("3", None, None)], "paper_id string, authors_list array<string>, cluster_id int")
    scores = spark.createDataFrame([("1", 1.0), ("2", 0.0275)], "doc string, score double")
    got = {r.paper_id: r.page_rank_score for r in search.rank(papers, scores, search.Request("x", "bo chen", 1)).collect()}
    assert math.isclose(got["1"], 0.60 + 0.15) and math.isclose(got["2"], 0.60 * 0.0275 + 0.25) and got["3"] == 0


def test_rule_suggestions(spark):
    rows = [(["keyword:deep learning"], ["author:ada"], 0.1, 0.5, 1.0), (["author:bo chen"], ["keyword:graphs"], 0.1, 0.9, 1.0), (["cluster:1"], ["cluster:2"], 0.1, 0.9, 2.0)]
    df = spark.createDataFrame(rows, "antecedents array<string>, consequents array<string>, support double, confidence double, lift double")
    assert [r.antecedents[0] for r in rules.suggest(df, "of Deep", "chen").collect()] == ["author:bo chen", "keyword:deep learning"]
    assert rules.suggest(df, "of", "").count() == 0 and rules.suggest(df, "", "bo").count() == 3  # no word of over two letters restricts nothing
    papers = spark.createDataFrame([("1", "On keyword:graphs", None), ("2", None, "nothing")], "paper_id string, title string, abstract string")
    assert [r.paper_id for r in rules.suggested_papers(papers, rules.suggest(df, "", "chen")).collect()] == ["1"]


def test_year_in_text(spark):
    df = spark.createDataFrame([("Mon, 2 Apr 2007 19:18:42 GMT",), ("none",), (None,), ("12345",)], "t string")
    assert [r.y for r in df.select(P.year_in(F.col("t")).alias("y")).collect()] == [2007, None, None, 1234]


def test_rules_mirror_each_other(spark):
    baskets = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["a", "c"]), (4, ["b"]), (5, ["b", "c"])], "txn int, items array<string>")
    found = {(r.antecedents[0], r.consequents[0]): r for r in rules.association_rules(rules.frequent_pairs(baskets, 0.1), 0.0).collect()}
    assert set(found) == {(x, y) for x in "abc" for y in "abc" if x != y}
    for (x, y), r in found.items():
        assert math.isclose(r.support, found[y, x].support) and math.isclose(r.lift, found[y, x].lift)
    assert math.isclose(found["a", "b"].support, 2 / 4) and math.isclose(found["a", "b"].confidence, 2 / 3)


def test_tfidf_rows_have_unit_length(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "one fish two fish"), (3, ""), (4, None)], "doc int, text string")
    spec = tfidf.TfidfSpec(most=2, stop=["one"])
    found = tfidf.tfidf(docs, spec)
    assert all(math.isclose(r[1], 1.0) for r in found.groupBy("doc").agg(F.sum(F.col("weight") ** 2)).collect())
    assert {r.term for r in found.where("doc = 2").collect()} == {"fish", "two", "fish two", "two fish"}


def test_terms_are_counted_as_by_hand():
    import pyarrow as pa
    from collections import Counter

    words = [["a", "b", "a", "b"], [], ["b"], ["a", "a", "a"], ["x y", "x"]]
    lists = pa.array([["no"], *words, ["no", "no"]], pa.list_(pa.string())).slice(1, len(words))
    for most in (1, 2, 3):
        want = [Counter(" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)) for w in words]
        assert [{t["term"]: t["tf"] for t in row} for row in tfidf.counted(lists, most).to_pylist()] == want
    assert tfidf.counted(lists.slice(0, 0), 2).to_pylist() == [] and tfidf.counted(lists.slice(1, 1), 2).to_pylist() == [[]]


def test_shares_sum_to_one_and_grid_fills(spark):
    d = datetime.date
    rows = [(2020, "a", d(2020, 1, 1), False), (2020, "b", d(2020, 1, 1), False), (2020, "a", d(2020, 4, 1), False), (2020, "a", None, False)]
    dated = spark.createDataFrame(rows, "year int, category string, month date, is_partial_year boolean")
    assert math.isclose(sum(r.share for r in trends.annual_share(dated).collect()), 1.0)
    monthly = trends.monthly_share(dated, 1, ["category"])
    grid = trends.month_grid(monthly, ["category"], "norm_share").where("category = 'a'").orderBy("month").collect()
    assert [r.month.month for r in grid] == [1, 2, 3, 4] and all(math.isclose(r.filled, 0.25) for r in grid)


def test_components_find_the_main_axis(spark):
    rows = [([float(t), 2.0 * t, 0.0],) for t in range(-5, 6)]
    mean, axes, share = components(spark.createDataFrame(rows, "v array<double>"), "v", 2)
    assert np.allclose(np.abs(axes[0]), np.array([1, 2, 0]) / 5**0.5) and math.isclose(share[0], 1.0)


def test_forecast_follows_a_trend():
    y = np.arange(48) * 2.0 + np.sin(np.arange(48))
    order, fitted, ahead, error = forecast(y)
    assert len(ahead) == 12 and abs(ahead[-1] - (59 * 2.0)) < 12 and (np.diff(error) >= -1e-9).all()


def test_merge_tree_and_layout_keep_clusters_apart():
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.1, (20, 3)) for c in (0, 5, 10)])
    for linkage in ("ward", "average", "complete"):
        label = merge_tree(x, 3, linkage)
        assert len(set(label)) == 3 and all(len(set(label[i : i + 20])) == 1 for i in (0, 20, 40))
    assert np.isfinite(layout(x, 10)).all()


def test_silhouette_takes_every_row_in_any_number_of_parts(spark, tmp_path, monkeypatch):
    """More rows than the bound of the sampled form, in several parts and tasks, as one comparison of all gives."""
    from tessera.operators import pairs

    pick = np.random.default_rng(5)
    x, label = pick.normal(size=(5_200, 3)), pick.integers(4, size=5_200)
    spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x, size = x.astype("float32").astype(float), np.bincount(label)
    sums = np.concatenate([np.stack([np.sqrt(((x[i : i + 100, None] - x[label == k][None]) ** 2).sum(2)).sum(1) for k in range(4)], 1) for i in range(0, 5_200, 100)])
    want = evaluate.silhouettes(sums, label, size).mean()
    monkeypatch.setattr(pairs, "PART", 2_000)
    row = registry.QUERIES["silhouette_sample"](spark, str(tmp_path)).first()
    assert row.n == 5_200 and abs(row.silhouette - want) < 1.1e-5


def test_clusterings_return_every_row(spark, tmp_path):
    pick = np.random.default_rng(3)
    rows = [(i, [float(x) for x in pick.normal(3 * (i % 3), 1.0, 8)], i % 3) for i in range(3_100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("dbscan_labels", "agglomerative_labels", "umap_layout"):
        assert {r.vec_id for r in registry.QUERIES[name](spark, str(tmp_path)).select("vec_id").collect()} == set(range(3_100))


def test_dbscan_numbers_clusters_and_borders(spark):
    rows = [(i, [float(x)]) for i, x in enumerate([0, 0.1, 0.2, 1.1, 5, 5.1, 5.2, 9])]
    found = {r.id: (r.cluster_id, r.is_core) for r in dbscan_labels(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.95, 3).collect()}
    assert found[0][0] == found[1][0] == found[2][0] == found[3][0] != found[4][0] == found[5][0] == found[6][0]
    assert found[7] == (-1, False) and found[3] == (0 if found[0][0] == 0 else 1, False) and {found[0][0], found[4][0]} == {0, 1}


def test_dbscan_in_parts_is_dbscan_of_all(spark, monkeypatch):
    """Several parts and tasks, a dense group, a chain, noise and border rows: cores and classes as brute force finds them."""
    from tessera.operators import pairs

    pick = np.random.default_rng(2)
    x = np.concatenate([pick.normal(0, 0.05, (60, 2)), np.stack([np.arange(40) * 0.3 + 3, np.zeros(40)], 1), pick.uniform(-20, 20, (80, 2)), np.full((20, 2), 9.0)])
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.35**2
    core = near.sum(1) >= 3
    root = np.arange(len(x))
    for i in np.nonzero(core)[0]:
        for j in np.nonzero(near[i] & core)[0]:
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    monkeypatch.setattr(pairs, "PART", 64)
    monkeypatch.setattr(pairs, "OWN", 50)
    found = {r.id: r for r in dbscan_labels(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 0.35, 3).collect()}
    assert [found[i].is_core for i in range(len(x))] == core.tolist()
    cores = np.nonzero(core)[0]
    assert len({(root[i], found[i].cluster_id) for i in cores}) == len({root[i] for i in cores}) == len({found[i].cluster_id for i in cores})
    for i in np.nonzero(~core)[0]:
        assert found[i].cluster_id == min((found[j].cluster_id for j in np.nonzero(near[i] & core)[0]), default=-1)


def test_kmeans_moves_all_starts_in_one_pass(spark):
    """The centres are those of one of the starts moved by hand, at the least cost of them."""
    from tessera.operators import cluster

    pick = np.random.default_rng(4)
    x = np.concatenate([pick.normal(c, 0.6, (150, 3)) for c in (0, 2, 4, 6)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    best = min((cluster.lloyd(x, c) for c in cluster.seeds(df.select("v"), [4], 3)[4]), key=lambda f: f[0])
    assert np.allclose(cluster.kmeans(df, "v", 4, 3), best[1])


def test_grid_shares_trees_and_distances_and_finds_what_single_fits_find(spark):
    from tessera.operators import cluster, gridsearch

    pick = np.random.default_rng(6)
    x = np.concatenate([pick.normal(c, 0.3, (40, 3)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    grids = {"kmeans": [{"k": 3, "starts": 2}], "dbscan": gridsearch.grid(eps=[0.001, 0.5], min_samples=[3, 5]), "agglomerative": gridsearch.grid(k=[3, 7], linkage=["ward", "average"]) + [{"k": 3, "linkage": "none", "metric": "none"}], "other": [{"k": 1}]}
    rows = {(r.method, r.parameters): r for r in gridsearch.fits(df, "id", "v", grids).collect()}
    assert len(rows) == 11 and rows["other", "k=1"].status == "failed: KeyError"
    for eps, least in ((0.001, 3), (0.5, 3), (0.5, 5)):
        label = [r.cluster_id for r in dbscan_labels(df, "id", "v", eps, least).collect()]
        row = rows["dbscan", f"eps={eps}, min_samples={least}"]
        assert (row.n_clusters_found, row.noise_ratio) == (len(set(label) - {-1}), label.count(-1) / len(label))
    assert rows["dbscan", "eps=0.001, min_samples=3"].status == "too_few_clusters"
    for k in (3, 7):
        assert rows["agglomerative", f"k={k}, linkage=average"].n_clusters_found == k
        label = merge_tree(x, k, "average")
        own = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, c int")
        want = evaluate.silhouette(own, "id", "v", "c").agg(F.avg("silhouette")).first()[0]
        assert math.isclose(rows["agglomerative", f"k={k}, linkage=average"].silhouette_score, want, rel_tol=1e-9)
    assert rows["kmeans", "k=3, starts=2"].status == "valid"


def test_layout_finds_its_neighbours_in_parts(spark, monkeypatch):
    from tessera.operators import pairs, reduce

    pick = np.random.default_rng(8)
    x = pick.normal(size=(150, 4))
    monkeypatch.setattr(pairs, "PART", 40)
    monkeypatch.setattr(pairs, "OWN", 30)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows = reduce.neighbours_of(df, "id", "v", 7).collect()
    own = {r.m: r.id for r in rows}
    gap = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(150, np.inf))
    assert {r.id: [own[m] for m in r.near] for r in rows} == {i: g.argsort()[:7].tolist() for i, g in enumerate(gap)}
    assert all(math.isclose(d, math.sqrt(gap[r.id, own[m]])) for r in rows for m, d in zip(r.near, r.gap, strict=True))
