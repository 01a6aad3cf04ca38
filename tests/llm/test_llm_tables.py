"""Operators 1, 4, 9 and 10, the pipeline, and the registered queries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import rows_of
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from sweepledger.llm.catalog import QUERIES, SQL, URL_RULES
from sweepledger.llm.exact_shuffle import communication_matrix, hypergeometric, shard_digest, shuffle_to_shards
from sweepledger.llm.kmeans_tree import distances, nearest
from sweepledger.llm.rule_ensemble import judge_quality, keep_accepted, learn, text_numbers
from sweepledger.llm.url_filter import blocked_bloom, judge_urls, may_hold

RULES = "host string, path string, verdict string"


def test_registered_names():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, testdata, name):
    assert compare(spark, connect(testdata), testdata, QUERIES[name], SQL[name]) is None


def brute_verdict(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [
        (len(h + p), len(h), h + p, v == "allow")
        for h, p, v in rules
        if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, key=lambda f: (f[0], f[1], not f[3]), default=None)
    return host, path, best and best[2], "allow" if best is None or best[3] else "block"


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "x://example.org", "x://example.org/en/13#t", "x://org/", "a://b://c/fr/"]
    urls += ["x://" + "a." * 300 + "com/fr/" + "p" * 3000, "x://ÉX.COM/fr/", "x://com/de/", "x://www.com/fr/", "x://acom/fr/", "x://example.org?/es/", "x://e\n.com/fr/\nq"]
    urls = [(i, u, i, i) for i, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(urls, "page_id long, url string, host int, given int")
    rules = URL_RULES + [("org", "/", "block"), (None, "/", "block"), ("e.com", None, "block"), ("b:", "//c/", "block"), ("com", "/", "allow")]
    got = judge_urls(pages, spark.createDataFrame(rules, RULES))
    assert got.columns == ["page_id", "url", "given", "host", "path", "rule", "verdict"]
    want = [(i, u, g, *brute_verdict(u, rules)) for i, u, _, g in urls]
    assert rows_of(got) == sorted(want, key=str)
    unlisted = judge_urls(pages, spark.createDataFrame([], RULES), default="block")
    assert {r["verdict"] for r in unlisted.collect()} == {"block"} and unlisted.count() == len(urls)
    assert judge_urls(pages.limit(0), spark.createDataFrame(rules, RULES)).count() == 0


@pytest.mark.parametrize("blocks", [1, 4, 64])
def test_bloom_filter_has_no_false_negative(spark, blocks):
    """However small the filter, and the smaller, the more false positives."""
    listed = spark.range(200).selectExpr("concat('h', id) AS host", "'/p' AS path")
    probes = spark.range(20_000).selectExpr("concat('h', id) AS host", "'/p' AS path")
    passed = may_hold(probes, ["host", "path"], blocked_bloom(listed, ["host", "path"], blocks), blocks)
    assert passed.join(listed, ["host", "path"]).count() == 200
    if blocks == 64:
        assert passed.count() < 300


def test_quality_on_held_out_rows(spark, testdata):
    root = testdata.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    judged = judge_quality(docs, labels)
    assert judged.count() == docs.count()
    rows = judged.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in judged.collect())


def test_held_out_labels_do_not_matter(spark, testdata):
    docs, labels = (spark.read.parquet(f"{testdata}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    numbers = text_numbers(docs)
    assert learn(numbers, labels) == learn(numbers, other)


def test_quality_of_odd_texts(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (3, None), (9, 0)], "doc_id long, quality int")
    judged = judge_quality(odd_docs, labels)
    assert judged.count() == odd_docs.count()
    assert judged.where("score IS NULL OR isnan(score) OR NOT score BETWEEN 0 AND 1").count() == 0
    kept = keep_accepted(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == judged.where("predicted = 1").count()
    none = judge_quality(odd_docs, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert judge_quality(odd_docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_whole_and_even(spark, documents, odd_docs, shards):
    for docs in (documents, odd_docs):
        out = shuffle_to_shards(docs, shards, buckets_per_shard=4)
        kept = [c for c in docs.columns if c not in ("shard", "slot")]
        assert out.columns == [*kept, "shard", "slot"]
        assert rows_of(out.select(kept)) == rows_of(docs.select(kept))
        places = {}
        for r in out.select("shard", "slot").collect():
            places.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        sizes = [len(places.get(s, ())) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    assert shuffle_to_shards(documents.limit(0), shards).count() == 0


def test_shard_digest_and_seed(documents, odd_docs):
    for r in shard_digest(shuffle_to_shards(odd_docs)).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    first = rows_of(shuffle_to_shards(documents).select("doc_id", "shard", "slot"))
    assert first == rows_of(shuffle_to_shards(documents).select("doc_id", "shard", "slot"))
    assert first != rows_of(shuffle_to_shards(documents, seed=21).select("doc_id", "shard", "slot"))


def test_main_path_of_the_shuffle_is_native(documents):
    plan = shard_digest(shuffle_to_shards(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shuffle_when_splits_change(recut):
    read, collect = recut
    docs = read([(i, f"t{i}") for i in range(12)], "doc_id long, text string")
    out = collect(shuffle_to_shards(docs, 4, buckets_per_shard=4))
    assert sorted(r[:2] for r in out) == [(i, f"t{i}") for i in range(12)]
    assert sorted(r[2:] for r in out) == [(shard, slot) for shard in range(4) for slot in range(3)]


def test_communication_matrix():
    counts = [0, 1, 7, 100, 3]
    drawn = np.array([communication_matrix(counts, 4, seed) for seed in range(300)])
    assert (drawn.sum(axis=2) == counts).all() and set(drawn.sum(axis=1).ravel()) == {27, 28}
    # A shard's share of 100 of 111 rows: mean 25.2 and a small spread, as without replacement.
    assert abs(drawn[:, 3, 0].mean() - 28 * 100 / 111) < 0.4 and drawn[:, 3, 0].std() < 2.2


def test_hypergeometric_of_large_populations():
    rng = np.random.default_rng(1)
    good, bad, draws = 3 * 10**9, 10**9, 1000
    got = [hypergeometric(rng, good, bad, draws) for _ in range(400)]
    assert abs(np.mean(got) - 750) < 4 and abs(np.std(got) - math.sqrt(1000 * 0.75 * 0.25)) < 2


def brute_nearest(rows, k=10):
    usable = [
        (i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)
    ]
    ids, points = np.array([i for i, _ in usable]), np.stack([v for _, v in usable])
    out = {}
    for i, v in usable:
        if i % 100 == 0:
            far = distances(v, points)
            out[i] = [(int(ids[j]), float(far[j])) for j in np.lexsort((ids, far)) if ids[j] != i][:k]
    return out


def found_by_query(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sample_rows", [20_000, 150])
def test_neighbours_of_the_tables(spark, testdata, sample_rows):
    root = testdata.replace("sf0.001", "sf0.01")
    vectors = spark.read.parquet(f"{root}/embeddings.parquet")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    got = found_by_query(nearest(vectors, F.col("vec_id") % 100 == 0, sample_rows=sample_rows, leaf_size=30))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    scores = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    assert all(abs(d - np.sqrt(((scores[q] - scores[i]) ** 2).sum())) < 1e-12 for q, v in got.items() for i, d in v)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, None), (400, [1.0, None]), (500, [nan, 1.0]), (600, [3.0, 4.0])]
    rows += [(None, [1.0, 1.0]), (700, [inf, 0.0]), *((i, [1.0, 0.0]) for i in range(1, 60)), *((i, [float(i), 2.0]) for i in range(101, 140))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1)).withColumn("v", F.lit(2))
    got = found_by_query(nearest(vectors, F.col("vec_id") % 100 == 0, leaf_size=1000))
    assert got == brute_nearest(rows)
    few = spark.createDataFrame(rows[:3] + rows[6:7], "vec_id long, embedding array<float>")
    assert found_by_query(nearest(few, F.col("vec_id") % 100 == 0)) == brute_nearest(rows[:3] + rows[6:7])
    assert nearest(vectors.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rows = [(0, [1.0, 0.0])] * 12 + [(1, [1.0, 0.0])] * 12 + [(2, [1.0, 0.0])] * 2 + [(0, [1.0, 5.0])]
    rows += [(i, [1.0, i / 10]) for i in range(3, 20) for _ in range(1 + i % 3)] + [(i, [1.0, i / 10 + 0.01]) for i in range(3, 20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {}
    for v in ([1.0, 0.0], [1.0, 5.0]):
        far = {}
        for i, w in rows:
            far[i] = min(far.get(i, math.inf), float(distances(np.float32(v).astype(float), np.float32([w]).astype(float))[0]))
        want[tuple(v)] = sorted((d, i) for i, d in far.items() if i)[:10]
    asks = F.col("vec_id") == 0
    for leaf_size in (4, 1000):
        got = nearest(vectors, asks, leaf_size=leaf_size, recall=1.0).distinct().collect()
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == sorted((n + 1, i, d) for near in want.values() for n, (d, i) in enumerate(near))


def broadcast_columns(node):
    """The columns of each table that a physical plan broadcasts."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        return broadcast_columns(node.executedPlan())
    children = [node.children().apply(i) for i in range(node.children().size())]
    own = [{node.output().apply(i).name() for i in range(node.output().size())}] if node.nodeName() == "BroadcastExchange" else []
    return own + [found for child in children for found in broadcast_columns(child)]


def test_vectors_are_not_broadcast(spark):
    """Each query comes once per leaf it visits, so files that are small enough are no measure of what a broadcast would hold."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 6)).round(3).astype(np.float32))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(vectors, F.col("vec_id") % 100 == 0, leaf_size=8, recall=1.0)
    sent = broadcast_columns(got._jdf.queryExecution().executedPlan())
    assert sent and all(columns == {"leaf", "chunks", "groups"} for columns in sent)
    assert {q: len(v) for q, v in found_by_query(got).items()} == dict.fromkeys((0, 100, 200, 300), 10)


def test_pipeline_stages(spark, testdata, tmp_path):
    """Every stage against its operator over its own input; the last equals ``run``."""
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, testdata).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
            before, kept = Counter(map(tuple, docs.collect())), Counter(map(tuple, after.collect()))
            assert not kept - before
        docs = after
        counts.append(after.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1]
    assert counts[-1] == counts[-2]
    digests = docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(digests) == rows_of(corpus_pipeline.run(spark, testdata).select(digests.columns))
