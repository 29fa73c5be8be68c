"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and extra columns."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF
from oracle import same
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, htmltext, mixing, neighbours, quality, registry, sharding, simhash, tokens, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns with the names that operators use inside
EXTRA = ", size string, shard string, fp string, score string, `k` string, block string, h string, skey string"


def texts(n=60, seed=3):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [" ".join(pick.choice(words) for _ in range(pick.randint(1, 50))) for _ in range(n)]


def docs(spark, extra=True):
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)) for i, t in enumerate(texts())]
    rows += [(60, None, None, None, None), (61, "", "en", "s1", 0), (62, rows[5][1], "en", "s2", 1), (62, rows[5][1], "en", "s2", 1), (None, "word without id", "en", "s1", 3), (63, "long " * 40_000, "en", "s0", 9), (64, " \t\n", "en", "s3", 3)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("x").alias(c.strip().split(" ")[0].strip("`")) for c in EXTRA.split(",") if c.strip()]) if extra else df


def none_of(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)


# mixing


def test_mix_meets_targets_and_reruns_agree(spark):
    df = docs(spark)
    rows = mixing.mix_plan(df).collect()
    assert len(rows) == df.count()
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source_key].append(r)
        assert 0 <= len(r.draws) <= 2
    assert math.isclose(sum(v[0].target for v in by.values()), 1.5 * total, rel_tol=1e-9)
    for group in by.values():
        taken = sum(r["size"] * len(r.draws) for r in group)
        assert abs(taken - group[0].target) <= max(r["size"] for r in group)
        assert group[0].source_size == sum(r["size"] for r in group) and group[0].target <= 2 * group[0].source_size + 1e-9
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix_plan(none_of(spark)).count() == 0


def test_splitting_tree_is_exact_and_disjoint(spark):
    drawn = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("skey"), F.col("id").alias("block"), F.lit(0).alias("pass"), F.lit(False).alias("partial"))
    rows = mixing.split_tree(drawn, mixing.MixSpec()).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 1000 and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 4
    for source in ("s0", "s1", "s2"):  # each shard's share of a source is near the hypergeometric mean of 20.8
        counts = Counter(r.shard for r in rows if r.skey == source)
        assert all(8 <= counts[s] <= 36 for s in range(16))


def test_mixed_rows_are_the_plan(spark):
    df = docs(spark)
    plan = Counter({r.id: len(r.draws) for r in mixing.mix_plan(df).where("id is not null and id <> 62").collect()})
    rows = mixing.mixed_rows(df)
    assert set(rows.columns) == set(df.columns) | {"mix_shard", "mix_order"}
    assert Counter(r.doc_id for r in rows.where("doc_id is not null and doc_id <> 62").collect()) == +plan


# SimHash


def brute_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes_of(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(spark):
    df = docs(spark)
    source = df.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in source]
    root = classes_of([(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], len(prints))
    least = {}
    for r, c in zip(source, root, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, 1 << 60), r.doc_id)
    want = Counter((r.doc_id, p, least.get(c)) for r, p, c in zip(source, prints, root, strict=True))
    assert Counter((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(none_of(spark)).count() == 0


def test_golay_keys_meet_within_one_bit():
    index = simhash.golay_index()
    assert len(np.unique(index)) == 4096 and (np.bincount(index) == 2048).all()
    pick = np.random.default_rng(0)
    a = pick.integers(0, 1 << 22, 300)
    b = a ^ (1 << pick.integers(0, 22, 300))
    keys = [defaultdict(set), defaultdict(set)]
    for side, x in zip(keys, (a, b), strict=True):
        for row, key in zip(*simhash.golay_keys(x, 22), strict=True):
            side[int(row)].add(int(key))
    assert all(keys[0][i] & keys[1][i] for i in range(300))


def test_fuzzy_keys_lose_no_link():
    pick = np.random.default_rng(1)
    a = pick.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in pick.choice(64, size=i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [defaultdict(set), defaultdict(set)]
    for side, x in zip(keys, (a, b), strict=True):
        for row, key in zip(*simhash.fuzzy_keys(x.view(np.int64)), strict=True):
            side[int(row)].add(int(key))
    assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    pick = np.random.default_rng(2)
    base = np.uint64(0x0123456789ABCDEF)
    prints = {int(base)}
    while len(prints) < 120:
        x = int(pick.choice(sorted(prints)))
        prints.add(x ^ sum(1 << int(b) for b in pick.choice(64, size=2, replace=False)))
    prints = sorted(prints)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    root = classes_of([(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], len(prints))
    for bucket in (4096, 5):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found = {r.node: r.root for r in simhash.components(simhash.link_edges(spark.createDataFrame(signed, "fp long"))).collect()}
        groups = defaultdict(set)
        for i, c in enumerate(root):
            groups[c].add(found.get(signed[i][0], signed[i][0]))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_components_of_paths_stars_and_loops(spark):
    pick = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (202, 202)] + [(pick.randint(300, 340), pick.randint(300, 340)) for _ in range(25)]
    root = classes_of([e for e in edges], 400)
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == root[x] for e in edges for x in e)


def test_keep_one(spark):
    kept = [r.doc_id for r in simhash.keep_one(docs(spark)).collect()]
    marked = simhash.near_duplicates(docs(spark)).collect()
    assert sorted(x for x in kept if x is not None) == sorted({r.component_id for r in marked if r.component_id is not None})
    assert kept.count(None) == len({r.fp for r in marked if r.component_id is None})


# neighbours


def test_neighbours_against_brute_force(spark):
    pick = np.random.default_rng(4)
    rows = [(i, [float(x) for x in pick.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] + [1.0] * 7), (504, [1.0, 2.0]), (None, [1.0] * 8), (505, [])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    found = neighbours.search(df, F.col("id") % 20 == 0).collect()
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and i < 500}
    got = defaultdict(dict)
    for r in found:
        got[r.query_id][r["rank"]] = (r.id, r.score)
    hit = total = 0
    for q in [i for i in x if i % 20 == 0]:
        want = sorted((math.dist(x[q], x[i]), i) for i in x if i != q)[:10]
        assert len(got[q]) == 10
        for i, s in got[q].values():
            assert math.isclose(s, math.dist(x[q], x[i]), rel_tol=1e-12, abs_tol=1e-12)
        hit += len({i for _, i in want} & {i for i, _ in got[q].values()})
        total += 10
    assert hit / total >= 0.95 and set(got) == {i for i in x if i % 20 == 0}
    assert neighbours.search(df.where("vec_id < 0"), F.col("id") % 20 == 0).count() == 0
    assert neighbours.search(df.where("vec_id < 4"), F.col("id") == 0).count() == 3


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_against_brute_force(spark, monkeypatch, clustered):
    """Uniform and clustered vectors, with buckets and query shares so small that both are dealt."""
    monkeypatch.setattr(neighbours, "BUCKET", 64)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    pick = np.random.default_rng(6)
    x = pick.normal(size=(3000, 16)) * 0.1 + (pick.normal(size=(40, 16))[pick.integers(40, size=3000)] if clustered else pick.normal(size=(3000, 16)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in sorted(neighbours.search(df, F.col("id") % 50 == 0).collect(), key=lambda r: r["rank"]):
        found[r.query_id].append(r.id)
        assert math.isclose(r.score, math.dist(x[r.query_id], x[r.id]), rel_tol=1e-12)
    hits = 0
    for q in range(0, 3000, 50):
        gaps = ((x - x[q]) ** 2).sum(axis=1)
        gaps[q] = np.inf
        assert len(found[q]) == 10
        hits += len(set(found[q]) & set(np.argsort(gaps, kind="stable")[:10].tolist()))
    assert hits / 600 >= 0.95


# URL filters


def test_url_filter_as_of(spark):
    entries = [("bad.com", "2024-01-10", "block"), ("bad.com", "2024-02-10", "remove"), ("bad.com/ok", "2024-01-20", "allow"), ("com", "2024-06-01", "block"), ("bad.com", "2024-01-10", "allow"), (None, "2024-01-01", "block"), ("x.org", None, "block")]
    entries = spark.createDataFrame(entries, "pattern string, listed_at string, action string").withColumn("listed_at", F.to_date("listed_at"))
    asked = [
        (1, "https://www.BAD.com:8080/a?b", "2024-01-15", True), (2, "http://bad.com/ok/page", "2024-01-25", False), (3, "http://bad.com/okay", "2024-01-25", True), (4, "http://bad.com/", "2024-02-10", False),
        (5, "http://notbad.com/", "2024-01-15", False), (6, None, "2024-01-15", False), (7, "http://bad.com/", None, False), (8, "http://other.com", "2024-06-02", True), (8, "http://other.com", "2024-06-02", True), (9, "mailto:x", "2024-06-02", False),
    ]
    pages = spark.createDataFrame([(i, u, t, "x") for i, u, t, _ in asked], "page_id long, url string, fetched_at string, action string").withColumn("fetched_at", F.to_date("fetched_at"))
    found = urlfilter.judge(pages, entries)
    assert Counter((r.id, r.blocked) for r in found.collect()) == Counter((i, b) for i, _, _, b in asked)
    assert urlfilter.judge(pages, entries.limit(0)).where("blocked").count() == 0


def test_url_filter_equals_brute_force(spark):
    """Deep and upper-case entries, users with @, addresses, long URLs, extra columns with clashing names."""
    listed = ["Z.com", "x.com/a/b/c/d", "http://Y.com:80/p//q/", "2.3.4", "[::1]", "com/a", "deep.org/" + "/".join(map(str, range(30))), "u.net.", "/only", ""]
    entries = spark.createDataFrame([(e, 5 + i, "block" if i % 3 else "allow") for i, e in enumerate(listed)], "pattern string, listed_at int, action string")
    urls = ["http://z.com/", "http://www.Z.COM./x", "http://x.com/a/b/c/d/e", "http://x.com/a/b/c", "https://y.com/p/q", "http://1.2.3.4/", "http://[::1]:80/x", "ftp://a@b@u.net/", "http://ss@y.com@deep.org/" + "/".join(map(str, range(40))), "http://deep.org/0/1", "http://[", "http://y.com/p/q/" + "r/" * 3000, "http://x.com//a//b/c/d", None, "http://"]
    rows = [(i, u, t, "x", "y") for i, u in enumerate(urls) for t in (1, 9, 99)]
    df = spark.createDataFrame(rows, "page_id int, url string, fetched_at int, pattern string, blocked string")

    def parts(url):
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        place = rest[:cut].rsplit("@", 1)[-1]
        host = place[: place.index("]") + 1] if place.startswith("[") and "]" in place else place.split(":")[0]
        return host.lower().rstrip("."), [x for x in rest[cut:].split("?")[0].split("#")[0].split("/") if x]

    marks = [(*parts(e if "://" in e else "http://" + e), 5 + i, "block" if i % 3 else "allow") for i, e in enumerate(listed)]

    def verdict(url, t):
        if url is None or not parts(url)[0]:
            return None
        host, path = parts(url)
        fit = [(len(h), len(p), a) for h, p, at, a in marks if h and at <= t and path[: len(p)] == p and (host == h or host[0] != "[" and not set(host) <= set("0123456789.") and host.endswith("." + h))]
        return max(fit)[2] if fit else None

    got = {(r.id, r.fetched_at): (r.action, r.blocked) for r in urlfilter.judge(df, entries).collect()}
    assert got == {(i, t): (verdict(u, t), verdict(u, t) == "block") for i, u, t, _, _ in rows}


# sharding


def test_sharding_laws(spark):
    df = docs(spark)
    rows = sharding.assign_shards(df, bin_rows=7).collect()
    assert len(rows) == df.count() and sharding.assign_shards(none_of(spark)).count() == 0
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    text = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))


@pytest.mark.parametrize("key", [7, None])
def test_one_key_for_all_rows(spark, key):
    df = spark.createDataFrame([(key, f"text {i % 90}") for i in range(200)], "doc_id long, text string")
    rows = sharding.assign_shards(df, bin_rows=20).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(200))


def test_jump_hash_equals_its_loop_and_moves_little():
    def loop(key, n):
        key, b, j = key % 2**64, -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = np.array([0, 1, -1, 2**62, *range(1000, 3000)], dtype=np.int64)
    for n in (1, 2, 16, 17):
        assert sharding.jump_hash(keys, n).tolist() == [loop(int(k), n) for k in keys]
    moved = sharding.jump_hash(keys, 16) != sharding.jump_hash(keys, 17)
    assert 0.03 < moved.mean() < 0.09


# token counts


@pytest.fixture(scope="module")
def library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path), tokens.PrefixCounter(json.load(open(path)))


def test_every_prefix_has_the_librarys_count(library):
    _, tokenizer, counter = library
    pick = random.Random(1)
    odd = ["a  b's  c'll 12 3\n\n x", "  'sx 're<|endoftext|> y<|endoftext", "été  ñandú\t\t 'ves ’ 漢字  🙂🙂 ½ a\x1c b", "don't  you'll   ", "aaaaaaaaaaaaaaaaaaaaaaaa" * 3]
    odd += ["".join(pick.choice("ab 's\n\tré1.!<|") for _ in range(40)) for _ in range(60)]
    for text in odd:
        table = counter.prefix_table(text)
        want = [len(tokenizer.encode(text[:i], add_special_tokens=False)) for i in range(len(text) + 1)]
        assert [table.at(i) for i in range(len(text) + 1)] == want
        assert counter.count(text) == want[-1]
        for budget in (0, 1, 3, 10):
            assert table.cut(budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_token_counts(spark, library):
    path, tokenizer, _ = library
    df = docs(spark)
    text = {r.doc_id: r.text or "" for r in df.collect()}
    for r in tokens.token_counts(df, path, budget=20).collect():
        assert r.n_tokens == len(tokenizer.encode(text[r.id], add_special_tokens=False)) and r.n_bytes == len(text[r.id].encode())
        assert r.over_limit == (r.n_tokens > 20) and len(tokenizer.encode(text[r.id][: r.cut], add_special_tokens=False)) <= 20
    stored = tokens.prefix_counts(df.where("doc_id < 20 or doc_id in (60, 61)"), path)
    cuts = {r.id: r.cut for r in tokens.token_counts(df, path, budget=20).collect()}
    assert all(r.cut == cuts[r.id] for r in stored.select("id", tokens.cut_of(F.col("counts"), 20).alias("cut")).collect())
    few = stored.where("id in (1, 60, 61)").collect()
    assert {r.id: len(r.counts) for r in few} == {1: len(text[1]) + 1, 60: 1, 61: 1}


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a <b>b</b>&amp;c\n d</p><p></p><p>e</p>", "a b&c d\ne"),
        ("<nav><a>Home</a></nav><article><header><h1>T</h1></header><p>One.<p>Two.<div class='ad-box'>Buy</div><p>Three.</article><footer>(c)</footer>", "T\nOne.\nTwo.\nThree."),
        ("<script>var a='</p>';</script><style>p{}</style><main><p>Kept</p><aside>no</aside><form><p>no</p></form></main><div>no</div>", "Kept"),
        ("<article><p>Text</p><section id='comments'><article class='comment'><p>First!</p></article></section></article>", "Text"),
        ("<div class=menu><a>A</a> <a>B</a></div><div class='content'><p>" + "word " * 40 + "</p><p>End.</p></div><div class='cookie-notice'>We use cookies</div>", ("word " * 40).strip() + "\nEnd."),
        ("<article><p>a<!-- x > y -->b</p><p title='>'>c</p><nav>unclosed", "ab\nc\nunclosed"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_surge_and_dive_with_a_landmark():
    story, away = "<h1>T</h1><p>Hm.</p><p>" + "word " * 60 + "</p><p>End.</p>", "<div>no</div>" * 4
    want = "T\nHm.\n" + ("word " * 60).strip() + "\nEnd."
    assert htmltext.main_text(f"<article>{story}</article>{away}<article><p>Teaser</p></article>") == want
    assert htmltext.main_text(f"<article><p>Tell a friend</p>{'<nav>x</nav>' * 3}{story}</article>") == want
    assert htmltext.main_text(f"<article>{story}</article>{away}<article>{story}</article>") == f"{want}\n{want}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a</p><svg/><p>b</p></article>", "a\nb"), ("<article><p>a</p><video-player><p>b</p></video-player><button-bar>c</button-bar></article>", "a\nb\nc"),
        ("<article><p>a</p><button>x<p>b</p></article>", "a\nx\nb"), ("<article><p>a</p><canvas><p>b</p>", "a\nb"), ("<p>a</p><title>t<p>b</p>", "a\nt\nb"),
        ("<article><p>a</p><svg><text>x</text></svg><select><option>o</select><p>b</p></article>", "a\nb"), ("<p>a</p><script>x = '<p>';", "a"), ("<p>a</p><script src='x'/><p>b</p>", "a\nb"),
        ("<article><p>Teaser</p></article><div><p>" + "real words " * 30 + "</p></div>", "Teaser\n" + ("real words " * 30).strip()),
        ("<p>" + "word " * 30 + "</p><p><a>See this long link here</a>.</p><p>" + "word " * 30 + "</p>", "\n".join([("word " * 30).strip(), "See this long link here.", ("word " * 30).strip()])),
        ("<title>" * 3000 + "<p>a</p>", "a"),
    ],
)
def test_what_hides_text(page, text):
    assert htmltext.main_text(page) == text


def brute_lines(page):
    """Blocks and blanks by the standard library's parser; for pages whose hidden elements are well nested."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.events = []

        def handle_starttag(self, tag, attrs):
            self.events.append(("open", tag, self.get_starttag_text()))

        def handle_startendtag(self, tag, attrs):
            self.events.append(("void", tag, ""))

        def handle_endtag(self, tag):
            self.events.append(("close", tag, ""))

        def handle_data(self, data):
            self.events.append(("text", data, ""))

    parser = Parser()
    parser.feed(page)
    parser.close()
    lines, words, away, inside, i = [], "", 0, 0, 0
    events = [e for j, e in enumerate(parser.events)]

    def end_of(i):
        depth = 0
        for j in range(i, len(events)):
            if events[j][1] == events[i][1] and events[j][0] in ("open", "close"):
                depth += 1 if events[j][0] == "open" else -1
                if depth == 0:
                    return j
        return None

    def flush():
        nonlocal words, away
        if words.split():
            lines.append((" ".join(words.split()), inside > 0, away))
            away = 0
        words = ""

    breaks = 0
    while i < len(events):
        kind, tag, raw = events[i]
        if kind == "text":
            words += tag
            breaks = breaks if tag.isspace() or not tag else 0
        elif tag == "br":
            breaks += 1
            words += " "
            if breaks > 1:
                flush()
        elif tag in htmltext.RAW and kind == "open":
            i = end_of(i) if end_of(i) is not None else len(events)
            i += 1
            continue
        else:
            if tag in htmltext.BLOCKS:
                flush()
            elif tag in ("td", "th", "option"):
                words += " "
            if kind == "open" and htmltext.is_away(tag, raw[len(tag) + 1 : -1], inside > 0) and end_of(i) is not None:
                flush()
                away += 1
                i = end_of(i) + 1
                continue
            if tag in ("article", "main"):
                inside = max(0, inside + (1 if kind == "open" else -1))
        i += 1
    flush()
    return lines


def brute_main_text(page):
    lines = brute_lines(page or "")
    if not lines:
        return ""
    assert 4 * sum(len(t) for t, inside, _ in lines if inside) >= sum(len(t) for t, *_ in lines)
    spaced = []
    for text, inside, away in lines:
        spaced += [""] * away + [text if inside else ""]
    sums = [sum(len(x) for x in spaced[i : i + 3]) for i in range(len(spaced))]
    surge = min(80, 0.2 * max(sums))
    kept = set()
    for start in range(len(spaced)):
        if sums[start] > surge and spaced[start]:
            left = max([j + 1 for j in range(start) if sums[j] == 0], default=0)
            right = min([j for j in range(start, len(spaced)) if sums[j] == 0], default=len(spaced))
            kept |= set(range(left, right))
    return "\n".join(x for i, x in enumerate(spaced) if x and i in kept)


def test_pages_equal_brute_force(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    wrong = [i for i, page in enumerate(pages) if htmltext.main_text(page) != brute_main_text(page)]
    assert not wrong


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", "x"), (2, None, None, "x"), (2, None, "<p>" * 50_000, "x")], "page_id long, url string, html string, text string")
    assert sorted((r.id, r.text, r.n_chars) for r in htmltext.extract(df).collect()) == [(1, "é", 1), (2, "", 0), (2, "", 0)]


# quality and toxicity


def held_out_accuracy(rows, labels, column):
    found = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in found) / len(found)


def test_quality_and_toxicity_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    good = quality_rows = registry.QUERIES["op8_quality"](spark, where).collect()
    toxic = registry.QUERIES["op10_toxicity"](spark, where).collect()
    assert held_out_accuracy(good, labels, "quality") >= 0.97 and held_out_accuracy(toxic, labels, "toxic") >= 0.9
    assert all(0 <= r.score <= 1 for r in quality_rows + toxic)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in toxic)


@pytest.mark.parametrize("learn", [quality.quality, toxicity.toxicity])
def test_learning_from_odd_labels(spark, learn):
    df = docs(spark)
    column = "quality" if learn is quality.quality else "toxic"
    schema = f"doc_id long, {column} int, text string"
    for rows in ([], [(1, None, "x"), (None, 1, "x")], [(1, 1, "x"), (1, 0, "x"), (999, 0, "x")], [(i, i % 2, "x") for i in range(40)]):
        found = learn(df, spark.createDataFrame(rows, schema)).collect()
        assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)
    assert learn(none_of(spark), spark.createDataFrame([], schema)).count() == 0


def brute_features(text):
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * (2 * quality.N_KINDS + 13) + [1.0]
    kinds = [0.0] * quality.N_KINDS
    for c in data:
        kind = [i for i, chars in enumerate(quality.KINDS.values()) if c in chars]
        kinds[kind[-1] if kind else quality.N_KINDS - 1] += 1 / len(data)
    n, counts = len(words), Counter(words)
    again = sum(words[i] == words[i + 1] for i in range(n - 1)) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = sum(w.isupper() for w in words) / n
    marked = sum(chr(w[-1]) in "!#$%&*|" for w in words) / n
    letters = kinds[0] + kinds[1] + kinds[14]
    shape = [math.log1p(n), len(data) / n / 10, len(counts) / n, math.log1p(len(counts)) / math.log1p(n), max(counts.values()) / n, again, math.log1p(100 * again), 1 - len(set(lines)) / len(lines)]
    shape += [math.log1p(n / len(lines)), kinds[0] / (letters + 1e-9), upper, math.log1p(100 * upper), math.log1p(100 * marked)]
    return kinds + [math.log1p(200 * k) for k in kinds] + shape + [0.0]


def test_quality_features_and_ranking_equal_brute_force():
    pick = random.Random(3)
    letters = "ab AB\n\t 1.,!|#é漢'(:"
    some = ["", None, " \n", "word", *["".join(pick.choice(letters) for _ in range(pick.randint(1, 300))) for _ in range(80)]]
    for text in some:
        assert np.allclose(quality.features(text), brute_features(text), atol=1e-12)
    x = np.array([quality.features(t) for t in some])
    label = np.array([int((t or "").count("!") > 3) for t in some])
    model = quality.rank(x, label)
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    draw = np.random.default_rng(7)
    good, bad = z[label == 1], z[label == 0]
    m = quality.PAIRS * max(min(len(good), len(bad)), 200)
    gap = good[draw.integers(len(good), size=m)] - bad[draw.integers(len(bad), size=m)]

    def loss(w):
        return np.log1p(np.exp(-gap @ w)).mean() + quality.PENALTY / 2 * w @ w

    for i in range(len(model.weights)):  # no step in any direction makes the penalised logistic loss smaller
        for step in (-1e-3, 1e-3):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved) >= loss(model.weights) - 1e-12
    below = (model.strength(x) < model.threshold - 1e-12).sum()
    assert abs(below - (label == 0).sum()) <= 1
    assert np.allclose(model.score(x), 1 / (1 + np.exp(model.threshold - model.strength(x))))


def index_of(vectors, size):
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int64)
    return toxicity.Index(starts, np.array([t for v in vectors for t in sorted(v)], dtype=np.int32), np.array([v[t] for v in vectors for t in sorted(v)]), size)


@pytest.mark.parametrize("common", [1 / 64, 0.0, 2.0])
def test_search_is_exact(monkeypatch, common):
    monkeypatch.setattr(toxicity, "COMMON", common)
    pick = random.Random(8)
    vectors = [{}]
    for _ in range(700):
        v = {t: pick.random() for t in pick.sample(range(40), pick.randint(1, 5))}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    queries = [(np.array(sorted(q), dtype=np.int64), np.array([q[t] for t in sorted(q)])) for q in vectors[:60]]
    for q, got in zip(vectors, index_of(vectors, 40).search(queries, 15), strict=False):
        want = sorted(((-round(sum(q[t] * v[t] for t in q if t in v), 12), i) for i, v in enumerate(vectors) if set(q) & set(v)))[:15]
        assert [round(s, 9) for s, _ in got] == [round(-s, 9) for s, _ in want]
    assert len(index_of(vectors[:9], 40).search(queries[:3], 15)[1]) <= 9 and index_of([], 40).search(queries[:1], 3) == [[]]


def test_toxicity_equals_brute_force(spark):
    """Vocabulary, document frequencies, vectors, neighbours, votes and the curve, by plain loops."""
    pick = random.Random(12)
    words = [f"w{chr(97 + i)}rd{j}x" for i in range(26) for j in range(20)]
    rows = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(0, 30))) + (" Nasty-thing nastily" if i % 20 == 0 else ""), "en", "s", 1) for i in range(300)] + [(300, None, "en", "s", 1)]
    labels = [(i, int(i % 20 == 0), "x") for i in range(220)]
    got = {r.id: r for r in toxicity.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()}

    def terms(text):
        found = Counter()
        for w in toxicity.WORD.findall((text or "").lower()):
            found.update([w] + ["^" + w[:n] for n in (4, 5) if n < len(w)])
        return found

    counts = {r[0]: terms(r[1]) for r in rows}
    learn = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    df = Counter(t for c in counts.values() for t in c)
    vocabulary = {t for i in learn for t in counts[i] if 2 <= df[t] <= max(len(rows) / 16, 16)}

    def vector(i):
        v = {t: n * math.log((len(rows) + 2) / (df[t] + 1)) for t, n in counts[i].items() if t in vocabulary}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    vectors = {i: vector(i) for i in counts}

    def near(i, without=None):
        c = [(-round(sum(x * vectors[e].get(t, 0) for t, x in vectors[i].items()), 12), e) for e in learn if e != without]
        return [(-c, e) for c, e in sorted(c) if c < 0][:30]

    def share(found):
        return sum(c * (e % 20 == 0) for c, e in found) / sum(c for c, _ in found)

    known = [(share(f), float(i % 20 == 0)) for i in learn if (f := near(i, i))]
    a, b = toxicity.fit_curve(*map(np.array, zip(*known, strict=True)))
    for i in counts:
        found = near(i)
        if not found:
            assert got[i].evidence == [] and math.isclose(got[i].score, got[300].score)
            continue
        assert got[i].evidence == [e for _, e in found]
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-a - b * math.log((share(found) + 0.02) / (1.02 - share(found))))), rel_tol=1e-6)


def test_counting_terms():
    count = toxicity.Counting(["idiot", "^idio", "a", "^long", "é", "b1"])
    text = "An IDIOT's a-b1 idiot, longer... É \u2003idiotic _a_ " + "a" * 9
    want = Counter()
    for w in toxicity.WORD.findall(text.lower()):
        want.update(t for t in toxicity.terms_of(w) if t in count.number)
    for _ in range(2):
        ids, n = count(text)
        assert {t: want[t] for t in want} == {k: int(x) for k, i in count.number.items() for j, x in zip(ids, n, strict=True) if i == j}
        assert count.distinct(text).tolist() == ids.tolist()
    assert len(count(None)[0]) == len(count("")[0]) == len(count.distinct(None)) == 0


def test_words_without_terms_take_no_room():
    count = toxicity.Counting(["idiot", "^long"])
    ids, n = count("nothing here is known, but idiot and longer ones and idiots")
    assert (ids.tolist(), n.tolist()) == ([0, 1], [1, 1]) and count.used == 3
    found = np.zeros(2)
    found[count.present("longer longest idiot idiot")] += 1
    assert found.tolist() == [1, 1]


@pytest.mark.parametrize("part", [7, 64, 1 << 16])
def test_counting_by_hashes_equals_brute_force(monkeypatch, part):
    """Words at the borders of the pieces that are hashed together, longer than these, and outside ASCII."""
    monkeypatch.setattr(toxicity, "PART", part)
    pick = random.Random(3)
    terms = ["idiot", "^idio", "^idiot", "a", "^long", "é", "b1", "z" * 70, "^zzzzz", "ß", "^straß", "i", "\U0001d7d8"]
    texts = ["z" * 70 + " b1", "x" * 1000, "idiots " * 300 + "z" * 500 + " a", "İstanbul STRASSE straße idioṫ", "longer" * 40, "é" * 9 + "-a_b1"]
    texts += ["".join(pick.choice("aidotlongerstréß _-1zİ\U0001d7d8\n") for _ in range(pick.randrange(400))) for _ in range(60)]
    count = toxicity.Counting(terms)
    for text in texts:
        want = Counter(t for w in toxicity.WORD.findall(text.lower()) for t in toxicity.terms_of(w) if t in terms)
        ids, n = count(text)
        assert {terms[i]: int(x) for i, x in zip(ids, n, strict=True)} == want


def test_long_vocabularies_are_told_apart():
    terms = sorted({t for i in range(50_000) for t in toxicity.terms_of(f"w{i * 7919}")})
    count = toxicity.Counting(terms)
    assert count(" ".join(t for t in terms if t[0] != "^"))[0].tolist() == list(range(len(terms)))


# decontamination


def test_decontamination_equals_brute_force(spark):
    pick = random.Random(9)
    words = ["alpha", "Beta", "gamma", "dÉlta", "x1", "zeta"]
    items = [(i, " ".join(pick.choice(words) for _ in range(n))) for i, n in enumerate([30, 13, 12, 3, 1, 20])] + [(6, None), (7, "..."), (None, "only unnamed words here")]
    rows = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(0, 90)))) for i in range(40)]
    rows += [(40, "Intro, " + items[0][1].upper() + "! end"), (41, None), (42, ""), (43, "So ONLY unnamed-words; here."), (44, "pad " * 500 + items[1][1]), (44, "pad " * 500 + items[1][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = decontaminate.words_of(t)
        n = min(13, len(w))
        for at in range(len(w) - n + 1) if n else []:
            windows.setdefault(tuple(w[at : at + n]), set()).add(str(i) if i is not None else "null")
    want = Counter()
    for i, t in rows:
        w = decontaminate.words_of(t)
        hit, found = set(), set()
        for at in range(len(w)):
            for n in {len(x) for x in windows}:
                if at + n <= len(w) and (names := windows.get(tuple(w[at : at + n]))):
                    hit |= set(range(at, at + n))
                    found |= names
        want[i, len(w), len(hit), ",".join(sorted(found))] += 1
    got = decontaminate.scan(df, bench).collect()
    assert Counter((r.id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got) == want
    assert decontaminate.digest(["9", "10"]) == hashlib.sha256(b"10,9").hexdigest()
    assert decontaminate.scan(df.limit(0), bench).count() == 0 and decontaminate.scan(df, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("pairs", [1, 7])
def test_many_sets_equal_one(spark, monkeypatch, pairs):
    """A long item and a window of several items are dealt over sets; spans and items are merged from scan to scan."""
    pick = random.Random(4)
    words = [f"w{i}" for i in range(5)]
    bench = spark.createDataFrame([(i, " ".join(pick.choice(words) for _ in range(15 + 3 * (i == 2)))) for i in range(4)] + [(9, "w0 w1"), (10, "w0 w1")], "item_id long, text string")
    rows = [(i, " ".join(pick.choice(words) for _ in range(60))) for i in range(12)] + [(50, r.text + " tail " + "pad " * 900) for r in bench.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hit_spans", F.lit("x"))
    key = lambda r: (r.id, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans)))
    one, cut = sorted(map(key, decontaminate.scan(df, bench).collect())), sorted(decontaminate.decontaminated(df, bench).collect())
    monkeypatch.setattr(decontaminate, "SET_PAIRS", 20 // pairs)
    assert sorted(map(key, decontaminate.scan(df, bench).collect())) == one and any(len(r[3]) > 1 for r in one)
    assert sorted(decontaminate.decontaminated(df, bench).collect()) == cut


def test_sets_of_windows_are_merged(spark, monkeypatch):
    items = [(i, f"a{i} b{i} c{i} d{i}") for i in range(6)]
    df = spark.createDataFrame([(i, f"x A{i} b{i}, c{i} d{i} y") for i in range(6)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "SET_PAIRS", 2)
    assert all(r.n_hit == 4 and r["items"] == [str(r.id)] for r in decontaminate.scan(df, spark.createDataFrame(items, "item_id long, text string")).collect())


def test_decontaminated_cuts_spans_and_drops_documents(spark):
    bench = spark.createDataFrame([(1, "the secret answer is forty two")], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [(1, f"{filler} The Secret answer is Forty-Two! {filler}", 5), (2, "The secret answer is forty two", 5), (3, "Clean", 5), (4, None, None)]
    out = {r.doc_id: r for r in decontaminate.decontaminated(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), bench).collect()}
    assert set(out) == {1, 3, 4} and out[1].text == f"{filler} ! {filler}" and out[1].n_chars == len(out[1].text) and out[4].text is None


# pipeline


def test_pipeline_against_its_stages(spark):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.staged(stage(spark, kept, where))
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, where).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in kept.collect())
    # by brute force: toxic documents go, one of each class stays, contaminated ones go, the mix draws from these
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{where}/labels.parquet")).withColumnRenamed("id", "doc_id").collect()}
    text = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < 0.3}
    prints = {i: brute_print(t) for i, t in text.items()}
    ids = sorted(text)
    root = classes_of([(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 3], len(ids))
    stay = {ids[c] for c in root}
    dirty = {r.id for r in decontaminate.scan(docs, spark.read.parquet(f"{where}/benchmark.parquet")).where(decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).collect()}
    assert {r.doc_id for r in out} <= stay - dirty and max(Counter(r.doc_id for r in out).values()) <= 2


def test_stages_take_odd_and_empty_tables(spark):
    df = docs(spark, extra=False).withColumns({c: F.lit("x") for c in ("size", "keep_id", "mix_h", "mix_shard", "shard", "fp")})
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, df, SF), stage(spark, df.limit(0), SF)
        assert empty.count() == 0 and 0 < out.count() <= 2 * df.count(), name
        assert name == "sharding" or out.columns == df.columns
