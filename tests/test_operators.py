import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import answers, compression, entity_store, evaluation, extraction, graph, hierarchy, retrieval
from palimpsest.operators.packing import Candidate, pack, pack_groups
from palimpsest.sources import corpora, paging, rpc, store
from palimpsest.streaming.ingest import Ingest


def pages_of(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_seq long, text string")


def triple_rows(spark, *texts):
    return sorted((r.page_seq, r.subject, r.predicate, r.object) for r in extraction.triples(pages_of(spark, *texts)).collect())


# --- pages ---


def test_pages_cut_across_documents(spark):
    docs = spark.createDataFrame([(5, "a b c"), (1, "d e"), (9000, " "), (9001, "f"), (2, "")], "doc_id long, text string")
    got = [(r.page_id, r.text, r.token_count) for r in paging.pages(docs, 2).orderBy("page_seq").collect()]
    assert got == [("page_0000000", "d e", 2), ("page_0000001", "a b", 2), ("page_0000002", "c f", 2)]
    assert paging.pages(docs.limit(0)).count() == 0


def test_pages_of_repeated_null_and_sparse_identifiers(spark):
    rng = np.random.default_rng(3)
    rows = [(1, "a b c"), (1, "d e f"), (None, "x y z"), (2, "g h"), (2, "g h"), (2, "g h"), (None, None), (7, None)]
    rows += [(int(rng.integers(0, 10**15)), " ".join(f"t{k}_{j}" for j in range(int(rng.integers(0, 9))))) for k in range(40)]
    rows += [(10**16, " ".join(f"long{j}" for j in range(500)))]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, start string").repartition(5)
    order = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    tokens = [t for _, text in order for t in text.split()]
    for size in (4, 7, 1000):
        got = {r.page_seq: (r.text, r.token_count) for r in paging.pages(docs, size).collect()}
        assert got == {i: (" ".join(tokens[i * size : (i + 1) * size]), len(tokens[i * size : (i + 1) * size])) for i in range(-(-len(tokens) // size))}


def test_five_thousand_tokens_are_five_pages(spark):
    docs = spark.createDataFrame([(0, " ".join(f"token_{i}" for i in range(5000)))], "doc_id long, text string")
    assert [r.token_count for r in paging.pages(docs).collect()] == [1000] * 5


# --- triples and graph ---


def test_triples_by_example(spark):
    got = triple_rows(spark, "The speed of light is a constant value.")
    assert got == [(0, "light is a", "has", "the speed"), (0, "speed of light", "is", "a constant value")]


def test_triples_are_dropped(spark):
    assert triple_rows(spark, "It is here.", "x is y.", "no verb at all.", "", "word " * 31 + "is this.") == []


def test_each_triple_counts_once_a_page(spark):
    rows = triple_rows(spark, "Cats are animals. Cats are animals.", "Cats are animals.")
    assert rows == [(0, "cats", "are", "animals"), (1, "cats", "are", "animals")]


def triples(spark, *rows):
    return spark.createDataFrame([(p, i, s, v, o) for i, (p, s, v, o) in enumerate(rows)], "page_seq long, ord long, subject string, predicate string, object string")


def test_graph_of_one_triple(spark):
    t = triples(spark, (0, "a", "r", "b"))
    assert {(r.src, r.dst): r.w for r in graph.edges(t).collect()} == {("a", "b"): 1.0, ("a", "r"): 0.5, ("r", "b"): 0.5}
    assert {r.concept: r.rho for r in graph.strengths(t).collect()} == {"a": 0.1, "r": 0.05, "b": 0.1}
    assert {r.concept: r.degree for r in graph.degrees(graph.symmetric(graph.edges(t))).collect()} == {"a": 1.5, "r": 1.0, "b": 1.5}
    with pytest.raises(ValueError):
        graph.edges(t, 0)


def test_concepts_are_numbered_as_seen(spark):
    t = triples(spark, (0, "b", "is", "a"), (0, "a", "is", "c"), (7, "d", "was", "b"))
    assert [r.concept for r in graph.concepts(t).orderBy("idx").collect()] == ["b", "is", "a", "c", "d", "was"]


def path(spark, n):
    return spark.createDataFrame([(str(i), str(i + 1), 1.0) for i in range(n - 1)], "src string, dst string, w double")


def test_laplacian_agrees_with_numpy(spark):
    lap = {(int(r.src), int(r.dst)): r.v for r in graph.laplacian(graph.symmetric(path(spark, 6))).collect()}
    a = np.diag(np.ones(5), 1) + np.diag(np.ones(5), -1)
    d = np.diag(a.sum(1) ** -0.5)
    want = np.eye(6) - d @ a @ d
    assert np.allclose([[lap.get((i, j), 0) for j in range(6)] for i in range(6)], want)
    assert np.linalg.eigvalsh(want)[1] > 1e-6


@pytest.mark.parametrize("steps", [1, 3])
def test_diffusion_agrees_with_numpy(spark, steps):
    edges = path(spark, 5)
    lap = graph.laplacian(graph.symmetric(edges))
    a = np.diag(np.ones(4), 1) + np.diag(np.ones(4), -1)
    d = np.diag(a.sum(1) ** -0.5)
    matrix, rho, q = np.eye(5) - d @ a @ d, np.array([0.5, 0.2, 0.1, 0.1, 0.1]), np.eye(5)[0]
    start = spark.createDataFrame([("k", str(i), float(v)) for i, v in enumerate(rho)], "key string, concept string, rho double")
    active = spark.createDataFrame([("k", "0", 1.0)], "key string, concept string, q double")
    got = {r.concept: r.rho for r in graph.diffuse(lap, start, active, steps).collect()}
    for _ in range(steps):
        rho = np.maximum(0, rho + 0.1 * matrix @ rho + 0.5 * q * rho - 0.01 * rho)
        rho /= rho.sum()
    assert np.allclose([got[str(i)] for i in range(5)], rho)


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_blocks_agree_with_single_keys(spark, sign):
    n, keys = 12, graph.BLOCK + 3
    rng = np.random.default_rng(5)
    lap = graph.laplacian(graph.symmetric(spark.createDataFrame([(f"c{i}", f"c{j}", float(rng.integers(1, 9))) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4], "src string, dst string, w double")))
    pairs = [(k, f"c{i}") for k in range(keys) for i in rng.choice(n, 3, replace=False)] + [(0, "c1"), (0, "c1"), (1, "unknown")]
    active = spark.createDataFrame(pairs, "key int, concept string")
    start = lap.select(F.col("src").alias("concept")).distinct().crossJoin(active.select("key").distinct()).select("key", "concept", F.lit(1 / n).alias("rho"))
    plain = graph.diffuse(lap, start, active.withColumn("q", F.lit(1.0)), sign=sign)
    want = {(r.key, r.concept): r.rho for r in plain.collect()}
    placed = active.select((F.col("key") / graph.BLOCK).cast("int").alias("block"), (F.col("key") % graph.BLOCK).alias("place"), "concept")
    got = {(r.block * graph.BLOCK + k, r.concept): x for r in graph.diffuse_blocks(lap, placed, -(-keys // graph.BLOCK), 1 / n, sign=sign).collect() for k, x in enumerate(r.r)}
    assert want and {k: got[k] for k in want} == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_numbered_triples_diffuse_as_their_laplacian(spark, sign):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(4)), k, *(f"c{x}" for x in rng.integers(9, size=3))) for k in range(30)] + [(0, 40, "c1", "c1", "c1"), (1, 41, "c2", "c3", "c2")]
    found = spark.createDataFrame(rows, "page_seq long, ord long, subject string, predicate string, object string")
    concepts = graph.concepts(found).cache()
    numbers = graph.numbered(found, concepts)
    n, name = concepts.count(), {r.idx: r.concept for r in concepts.collect()}
    lap = graph.laplacian(graph.symmetric(graph.edges(found)))
    start = concepts.select(F.lit("q").alias("key"), "concept", F.lit(1 / n).alias("rho"))
    active = spark.createDataFrame([("q", name[2], 1.0)], "key string, concept string, q double")
    want = {r.concept: r.rho for r in graph.diffuse(lap, start, active, sign=sign).collect()}
    rho = graph.diffuse_numbered(numbers, n, [2], sign=sign)
    assert len(want) == n and {name[r.idx]: r.rho for r in rho.collect()} == pytest.approx(want)
    assert {(name[r.idx], r.b1_no) for r in graph.numbered_postings(numbers).collect()} == {(r.concept, r.b1_no) for r in graph.postings(found).collect()}


def test_hubs_are_held_by_no_single_task(spark, monkeypatch):
    """Links out of a predicate that all triples share are dealt out by where they lead, and nothing is sorted to be joined."""
    rng = np.random.default_rng(9)
    rows = [(k // 10, k, f"s{rng.integers(300)}", "has" if k % 9 else "is", f"o{k}") for k in range(3000)] + [(400, 9000, "has", "is", "has"), (400, 9001, "has", "has", "o1")]
    found = spark.createDataFrame(rows, "page_seq long, ord long, subject string, predicate string, object string")
    concepts = graph.concepts(found).cache()
    n, name = concepts.count(), {r.idx: r.concept for r in concepts.collect()}
    start = concepts.select(F.lit("q").alias("key"), "concept", F.lit(1 / n).alias("rho"))
    lap = graph.laplacian(graph.symmetric(graph.edges(found)))
    want = {r.concept: r.rho for r in graph.diffuse(lap, start, spark.createDataFrame([("q", "s1", 1.0)], "key string, concept string, q double")).collect()}
    seen, plans, sizes = graph.kept, [], []
    monkeypatch.setattr(graph, "kept", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or seen(df, label))
    persist = type(found).persist
    monkeypatch.setattr(type(found), "persist", lambda df, *level: sizes.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]) or persist(df, *level))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rho = graph.diffuse_numbered(graph.numbered(found, concepts), n, [next(i for i, c in name.items() if c == "s1")])
        got = {name[r.idx]: r.rho for r in rho.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == pytest.approx(want) and len(got) == n
    assert plans and "SortMergeJoin" not in plans[-1]
    assert max(sizes[0]) < 1.5 * sum(sizes[0]) / 4  # of the links, on four partitions


def test_masses_of_blocks_are_those_of_rows(spark, index):
    active = index[0].concepts.where("idx < 4").select((F.col("idx") % 2).cast("string").alias("query_id"), "concept")
    strengths = retrieval.spread(index[0], active)
    want = {(r.query_id, r.region): r.mass for r in retrieval.region_mass(index[0], strengths.long()).collect()}
    assert want and {(r.query_id, r.region): r.mass for r in retrieval.block_mass(index[0], strengths).collect()} == pytest.approx(want)


def test_activation_falls_back_to_words(spark):
    concepts = spark.createDataFrame([("red fox",), ("blue fox",), ("dog",)], "concept string")
    wanted = spark.createDataFrame([("a", "dog"), ("a", "fox"), ("b", "fox cub")], "key string, name string")
    got = sorted(map(tuple, graph.activation(concepts, wanted).collect()))
    assert got == [("a", "dog", 1.0), ("b", "blue fox", 0.5), ("b", "red fox", 0.5)]


# --- hierarchy ---


def test_hundred_and_one_pages(spark):
    pages = spark.range(101).select(F.col("id").alias("page_seq"), F.col("id").cast("string").alias("page_id"))
    loose = hierarchy.hierarchy(pages)
    assert loose.select("b2_no").distinct().count() == 11 and loose.where("b3_no IS NULL").count() == 0
    strict = hierarchy.hierarchy(pages, strict=True)
    assert strict.where("b2_no IS NOT NULL").select("b2_no").distinct().count() == 10
    assert strict.where("b3_no IS NOT NULL").select("b3_no").distinct().count() == 1 and strict.where("b2_no IS NULL").count() == 1


def test_patches_and_signatures_agree_with_numpy(spark):
    x = np.random.RandomState(2).randn(30, 4)
    table = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "b1_no long, embedding array<double>")
    rows = hierarchy.patches(table).orderBy("b2_no").collect()
    assert np.allclose([r.mu for r in rows], x.reshape(3, 10, 4).mean(1)) and np.allclose([r.variance for r in rows], x.reshape(3, 10, 4).var(1, ddof=1))
    full = hierarchy.pinv_precision(table, diagonal=False).orderBy("b2_no").first()
    assert np.allclose(np.array(full.precision).reshape(4, 4) @ np.cov(x[:10], rowvar=False), np.eye(4))
    mu = x.reshape(3, 10, 4).mean(1)
    s = np.maximum(0, mu @ mu.T)
    np.fill_diagonal(s, 0)
    values = np.linalg.eigvalsh(s / s.max())
    got = hierarchy.signatures(hierarchy.patches(table)).first().eigenvalues
    assert np.allclose(sorted(got, key=abs), sorted(values, key=abs)[:2])


# --- packing ---


def coverage(chosen, rows):
    best = {}
    for c in rows:
        if c.id in chosen:
            for k, v in c.coverage.items():
                best[k] = max(best.get(k, 0), v * c.strength)
    return sum(best.values())


def plain_pack(rows, budget):
    """Tries every candidate at each step."""
    if all(c.tokens > budget for c in rows):
        return [max(rows, key=Candidate.density).id] if rows else []
    best, chosen = {}, []
    while True:
        options = [(sum(max(0, v * c.strength - best.get(k, 0)) for k, v in c.coverage.items()) / max(c.tokens, 1), -i) for i, c in enumerate(rows) if c.id not in chosen and c.tokens <= budget]
        if not options or budget <= 0:
            return chosen
        c = rows[-max(options)[1]]
        chosen.append(c.id)
        budget -= c.tokens
        for k, v in c.coverage.items():
            best[k] = max(best.get(k, 0), v * c.strength)


candidate = st.builds(lambda t, c: (t, c), st.integers(1, 9), st.dictionaries(st.sampled_from("abcde"), st.integers(0, 8).map(lambda v: v / 8), max_size=4))


@settings(max_examples=300, deadline=None)
@given(st.lists(candidate, min_size=1, max_size=7), st.integers(1, 20))
def test_lazy_packing_is_greedy_packing(rows, budget):
    rows = [Candidate(str(i), t, c, 1.0) for i, (t, c) in enumerate(rows)]
    assert pack(rows, budget) == plain_pack(rows, budget)


def test_packing_by_example(spark):
    rows = [("p1", 50, {"c1": 0.9, "c2": 0.1}), ("p2", 60, {"c2": 0.8, "c3": 0.2}), ("p3", 40, {"c3": 0.7, "c4": 0.3})]
    assert pack([Candidate(i, t, c, 1.0) for i, t, c in rows], 100) == ["p3", "p1"]
    df = spark.createDataFrame([("k", n, i, t, c, 1.0, 100) for n, (i, t, c) in enumerate(rows)], "key string, ord int, id string, tokens int, coverage map<string,double>, strength double, budget int")
    assert [r.id for r in pack_groups(df).orderBy("rank").collect()] == ["p3", "p1"]
    with pytest.raises(ValueError):
        pack([], 0)
    assert pack([], 5) == [] and pack([Candidate("big", 9, {"a": 1.0}, 1.0)], 5) == ["big"]


def test_packing_is_near_the_optimum():
    rng = np.random.RandomState(1)
    for _ in range(20):
        rows = [Candidate(str(i), 30, {c: float(rng.rand()) for c in "abcd" if rng.rand() < 0.6}, 1.0) for i in range(5)]
        best = max(coverage(s, rows) for s in itertools.combinations("01234", 2))
        assert coverage(pack(rows, 60), rows) >= (1 - 1 / np.e) * best - 0.05


# --- retrieval ---


@pytest.fixture(scope="module")
def index(spark):
    docs, made = corpora.needles(spark, 6, 3000)
    pages = store.kept(paging.pages(docs, 100), "pages")
    found = store.kept(extraction.triples(pages), "triples")
    lap = graph.laplacian(graph.symmetric(graph.edges(found)))
    return retrieval.Index(pages, *(store.kept(t, "index") for t in (hierarchy.hierarchy(pages), graph.concepts(found), lap, graph.postings(found)))), made


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, query string, max_tokens int, required array<string>")


def test_collapse_finds_needles(spark, index):
    table, made = index
    asked = ask(spark, *[(str(n["id"]), f"Who is {n['subject']}?", 300, []) for n in made], ("empty", "  ", 300, []))
    got = {r.query_id: r for r in retrieval.collapse(table, asked).collect()}
    texts = {r.page_id: r.text.lower() for r in table.pages.collect()}
    assert got["empty"].error == "Empty query" and not got["empty"].page_ids
    for n in made:
        r = got[str(n["id"])]
        assert r.error is None and any(n["answer"] in texts[p] for p in r.page_ids)
        assert 0 <= r.confidence <= 1 and r.tokens_total >= r.tokens_used > 0 and r.n_concepts >= 3
    again = {r.query_id: r for r in retrieval.collapse(table, asked).collect()}
    assert got == again


def test_required_concepts_bring_their_pages(spark, index):
    table, _ = index
    concept = table.concepts.where("concept LIKE 'warden%'").first().concept
    r = retrieval.collapse(table, ask(spark, ("q", "gate", 50, [concept]))).first()
    page = table.postings.where(F.col("concept") == concept).first().b1_no - 1
    assert r.tokens_total > 0 and table.pages.where(f"page_seq = {page}").first().page_id is not None


def test_queries_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 1)
    with pytest.raises(ValueError):
        retrieval.small(ask(spark, ("a", "x", 1, []), ("b", "y", 1, [])))


def test_keyword_answers(spark):
    pages = spark.createDataFrame([(0, "p0", "red fox"), (1, "p1", "red dog and more"), (2, "p2", "nothing")], "page_seq long, page_id string, text string")
    r = retrieval.keyword_collapse(pages, ask(spark, ("q", "red fox", 4, []))).first()
    assert r.page_ids == ["p0", "p1"] and r.tokens_used == 6 and r.tokens_total == 6


def plain_keywords(pages, query, max_tokens):
    """All pages with any word, by share of the words, taken while they fit."""
    words = set(query.lower().split())
    found = [(-sum(w in t.lower() for w in words) / len(words), seq, name, max(1, int(len(t.split()) * 1.1))) for seq, name, t in pages if any(w in t.lower() for w in words)]
    left, out = int(max_tokens * 1.5), []
    for _, _, name, n in sorted(found):
        if n <= left:
            out.append(name)
            left -= n
    return out, sum(f[3] for f in found)


def test_keyword_answers_against_all_pages(spark):
    rng = np.random.default_rng(9)
    pages = [(i, f"p{i}", " ".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 12))))) for i in range(300)]
    asked = [(str(k), " ".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 4)))), int(rng.integers(8, 40)), []) for k in range(12)]
    got = {r.query_id: (r.page_ids, r.tokens_total) for r in retrieval.keyword_collapse(spark.createDataFrame(pages, "page_seq long, page_id string, text string"), ask(spark, *asked)).collect()}
    assert got == {q: plain_keywords(pages, text, n) for q, text, n, _ in asked}


def test_hits_and_telemetry(spark):
    results = spark.createDataFrame([("a", ["p0", "p1"], 10, 40, 0.5, None), ("b", [], 0, 0, 0.0, "Empty query")], "query_id string, page_ids array<string>, tokens_used long, tokens_total long, confidence double, error string")
    scores = {r.page_id: r.score for r in hierarchy.access_scores(retrieval.hits(results).unionByName(store.reads(spark.createDataFrame([("p1",)], "page_id string")))).collect()}
    assert scores == {"p0": 0.5, "p1": 1.5}
    row = evaluation.telemetry(results, 4.0).first()
    assert (row.queries, row.failed, row.queries_per_second, row.tokens_used, row.compression_ratio) == (2, 1, 0.5, 10, 4.0)


def test_serving(spark):
    import json

    server = rpc.serving(lambda asked: asked.select("query_id", "query", F.lit(None).cast("string").alias("error")), spark)
    line = json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "collapse", "arguments": {"query": "hi"}}})
    assert json.loads(json.loads(server.answer(line))["result"]["content"][0]["text"]) == {"query_id": "default", "query": "hi", "error": None}


def test_connectors(spark, tmp_path):
    import json

    rows = [{"_id": f"q{i}", "question": "Who?", "answer": "Ada", "type": "bridge", "level": "easy", "context": [["A", ["One. ", "Two."]], [f"B{i}", ["Three"]]], "supporting_facts": [["A", 1], [f"B{i}", 0], ["A", 9]]} for i in range(2)]
    (tmp_path / "whole.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)) + "\n")
    for name in ("whole.json", "lines.json"):
        made = corpora.multi_hop(spark, str(tmp_path / name))
        assert sorted((r.title, r.text) for r in made["documents"].collect()) == [("A", "One. Two."), ("B0", "Three"), ("B1", "Three")]
        assert sorted((r.id, r.title, r.sentence) for r in made["facts"].collect()) == [("q0", "A", "Two."), ("q0", "B0", "Three"), ("q1", "A", "Two."), ("q1", "B1", "Three")]
        assert made["questions"].count() == 2 and made["paragraphs"].count() == 4
    (tmp_path / "articles.json").write_text("\n".join(json.dumps({"id": i, "title": f"T{i}", "text": "w " * n}) for i, n in (("7", 3), ("x", 5), ("8", 1))))
    got = sorted((r.title, r.tokens) for r in corpora.articles(spark, str(tmp_path / "articles.json"), 2).collect())
    assert got == [("T7", 3), ("Tx", 5)]


# --- compression ---


def test_near_pairs_and_projection(spark, monkeypatch):
    x = np.random.RandomState(3).randn(30, 16)
    x[7] = x[3] * 1.0001
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    assert [(r.a, r.b) for r in compression.near_pairs(table, 16).collect()] == [(3, 7)]
    monkeypatch.setattr(compression, "BLOCK_ROWS", 4)  # a bucket in several blocks
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i in range(30) for j in range(i) if (unit @ unit.T)[i, j] >= 0.2}
    got = {(r.b, r.a) for r in compression.near_pairs(table, 16, 0.2, w=1e6).collect()}  # one bucket: every pair
    assert got == want and compression.near_pairs(table.limit(0), 16).count() == 0
    small = compression.projected(table, 16, 4)
    assert len(small.first().vector) == 4
    back = compression.unprojected(compression.projected(table, 16, 20), 16, 20).orderBy("id").collect()
    assert np.allclose([r.vector for r in back], x)


def test_svd_small_and_large(spark, monkeypatch):
    m = np.random.RandomState(4).randn(12, 3) @ np.random.RandomState(5).randn(3, 9)
    entries = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(9)], "i long, j long, v double")
    done = compression.svd(entries, explained=0.999999)
    assert len(done.values) == 3 and np.allclose(done.values, np.linalg.svd(m)[1][:3]) and done.ratio == 108 / (36 + 3 + 27) and done.share == pytest.approx(1)
    monkeypatch.setattr(compression, "DENSE", 2)
    large = compression.svd(entries, rank=3)
    assert np.allclose(large.values, done.values)
    a, b = ({(r.k, r.j): r.v for r in t.right.collect()} for t in (done, large))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)
    back = {(r.i, r.j): r.v for r in compression.reconstructed(compression.left_vectors(entries, done), done).collect()}
    assert all(abs(back[i, j] - m[i, j]) < 1e-6 for i in range(12) for j in range(9))
    turned = compression.svd(entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), rank=3)  # wider than long
    assert np.allclose(turned.values, done.values)
    again = {(r.i, r.j): r.v for r in compression.reconstructed(compression.left_vectors(entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), turned), turned).collect()}
    assert all(abs(again[j, i] - m[i, j]) < 1e-6 for i in range(12) for j in range(9))
    monkeypatch.setattr(compression, "LEADING", 2)  # 95 % of the energy of the two largest, and what that is of all
    few = compression.svd(entries, explained=0.95)
    s = np.linalg.svd(m)[1]
    want = 1 if s[0] ** 2 >= 0.95 * (s[:2] ** 2).sum() else 2
    assert len(few.values) == want and few.share == pytest.approx((s[:want] ** 2).sum() / (s**2).sum())
    for bad in ({"rank": 0}, {"ratio": 0.5}, {"rank": 1, "ratio": 2.0}, {"rank": 10}):
        with pytest.raises(ValueError):
            compression.svd(entries, **bad)
    monkeypatch.setattr(compression, "MOST_NUMBERS", 5)
    with pytest.raises(ValueError):
        compression.svd(entries, rank=3)
    with pytest.raises(ValueError):
        compression.svd(entries.limit(0))


def test_spectrum_without_vectors(spark, monkeypatch):
    rng = np.random.RandomState(11)
    m = np.where(rng.rand(60, 40) < 0.3, rng.randint(1, 9, (60, 40)), 0).astype(float)
    m[:, 3] *= 20
    m[7] *= 9
    m[:, 20:] = np.roll(m[:, :20], 30, 0)  # values that are near one another
    for name, value in (("DENSE", 2), ("LEADING", 6), ("MOST_NUMBERS", 5), ("SPARE", 6), ("WIDTH", 5), ("CHUNK", 16)):
        monkeypatch.setattr(compression, name, value)
    s = np.linalg.svd(m)[1]
    want = int(np.searchsorted(np.cumsum(s[:6] ** 2) / (s[:6] ** 2).sum(), 0.95) + 1)
    for turned in (False, True):
        x = m.T if turned else m
        entries = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x) if v], "i long, j long, v double")
        got = compression.spectrum(entries)
        assert np.allclose(got.values, s[:want], rtol=1e-7) and got.share == pytest.approx((s[:want] ** 2).sum() / (s**2).sum()) and got.ratio == 2400 / (60 * want + want + want * 40)
    few = spark.createDataFrame([(i, j, float((i + 1) * (j + 2))) for i in range(9) for j in range(8)], "i long, j long, v double")  # of rank one
    assert compression.spectrum(few).values == pytest.approx(np.linalg.svd(np.outer(np.arange(1, 10), np.arange(2, 10)))[1][:1])


def test_spectrum_by_equal_rows_and_pairs(spark, monkeypatch):
    # Two hubs; 30 pairs that differ in nothing but their numbers, 4 of a larger value; equal columns; a part that stays.
    rng = np.random.RandomState(21)
    m = np.zeros((60, 60))
    for t in range(2, 36):
        m[t, t] = 3.0 if t < 6 else 1.0
        m[t, 0], m[0, t] = 0.5, 0.5
    m[36:40, 40:46] = rng.randint(1, 5, (4, 1))  # equal columns
    m[44:50, 50] = 2  # equal rows
    m[50:, 51:] = np.where(rng.rand(10, 9) < 0.5, rng.randint(1, 4, (10, 9)), 0)
    m[1, 30:], m[30:, 1] = 0.5, 0.5
    for name, value in (("DENSE", 2), ("LEADING", 20), ("MOST_NUMBERS", 5), ("SPARE", 10), ("LIST", 12), ("ROOM", 90)):
        monkeypatch.setattr(compression, name, value)
    s = np.linalg.svd(m)[1]
    want = int(np.searchsorted(np.cumsum(s[:20] ** 2) / (s[:20] ** 2).sum(), 0.95) + 1)
    sides = []
    leading = compression._leading
    monkeypatch.setattr(compression, "_leading", lambda entries, height, width, *rest: sides.append((height, width)) or leading(entries, height, width, *rest))
    for turned in (False, True):
        entries = spark.createDataFrame([(1000 * i, j, float(v)) if not turned else (j, 1000 * i, float(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, v double")
        got = compression.spectrum(entries)
        assert np.allclose(got.values, s[:want], rtol=1e-6) and got.share == pytest.approx((s[:want] ** 2).sum() / (s**2).sum())
        core, known = compression._reduced(entries, 60)
        dense = np.zeros((60, 60))
        for r in core.collect():
            dense[r.i, r.j] += r.v
        every = np.sort(np.concatenate([np.linalg.svd(dense)[1], known]))[::-1]
        assert np.allclose(every[:50], s[:50], atol=1e-6) and len(known) >= 20
    assert max(max(side) for side in sides) < 40  # a task's vectors are as long as what is left


def test_near_pairs_go_on_by_strips(spark, monkeypatch):
    monkeypatch.setattr(compression, "STRIP", 10)
    sent = []
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", lambda self, f, kind: sent.append(f))
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "id long, vector array<double>")
    compression.near_pairs(table, 2)
    rows = [pd.DataFrame({"p": 0, "q": 0, "s": 0, "id": np.arange(a, a + 25), "x": [np.array([0.6, 0.8])] * 25}) for a in (0, 25)]
    found = list(sent[0](iter(rows)))
    assert max(map(len, found)) <= 10 * 50 and sum(map(len, found)) == 50 * 49 // 2


def test_products_of_rows_in_strips(spark, monkeypatch):
    m = np.random.RandomState(12).randn(50, 6)
    m[:, 4] = 0  # a column without entries
    entries = spark.createDataFrame([(i * 3, j, float(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, v double")
    done = compression.svd(entries, rank=5)
    monkeypatch.setattr(compression, "HELD", 31)
    left = compression.left_vectors(entries, done)
    assert "Join" not in left._jdf.queryExecution().toString()
    got = {(r.i, r.j): r.v for r in compression.reconstructed(left, done).collect()}
    assert got.keys() == {(i * 3, j) for i in range(50) for j in range(6) if j != 4} and all(abs(got[i * 3, j] - m[i, j]) < 1e-9 for i in range(50) for j in range(6) if j != 4)


def test_spectra(spark):
    n = 20
    a = np.array([[1 / (1 + abs(i - j)) if 0 < abs(i - j) <= 2 else 0 for j in range(n)] for i in range(n)])
    d = np.diag(a.sum(1) ** -0.5)
    lap = np.eye(n) - d @ a @ d
    entries = spark.createDataFrame([(1, i, j, float(lap[i, j])) for i in range(n) for j in range(n)], "key long, i int, j int, v double")
    got = compression.group_eigen(entries, 10).first()
    assert np.allclose(got.eigenvalues, np.sort(np.linalg.eigvalsh(lap))[:10], atol=1e-9)
    rebuilt = compression.from_spectrum(np.array(got.eigenvalues), np.array(got.eigenvectors))
    assert rebuilt.shape == (n, n) and np.allclose(rebuilt, rebuilt.T) and not rebuilt.diagonal().any()


# --- entity store ---


def test_entity_store(spark):
    docs = spark.createDataFrame([(1, "The Red Fox has fur. Red Fox is animal. Bob uses tools.")], "doc_id long, text string")
    names = {r.name: r.frequency for r in entity_store.entities(extraction.entities(docs)).collect()}
    assert names == {"the red fox": 1, "red fox": 1, "bob": 1}
    facts = {(r.entity, r.value) for r in extraction.facts(docs).collect()}
    assert facts == {("the red fox", "fur"), ("red fox", "animal")}
    assert ("red fox", "nimal") in {(r.entity, r.value) for r in extraction.facts(docs, strict=True).collect()}
    rels = entity_store.relations(extraction.relations(docs).withColumn("weight", F.lit(1.0))).collect()
    assert {r.predicate for r in rels} == {"has", "is", "uses"} and all(r.relation_id.startswith("r_") and len(r.relation_id) == 14 for r in rels)
    counts = extraction.extraction_counts(docs).first()
    assert (counts.n_entities, counts.n_relations, counts.n_facts) == (3, 3, 2)


def test_last_property_and_first_confidence(spark):
    m = spark.createDataFrame([(1, "a", "k", "old"), (2, "a", "k", "new"), (1, "a", "j", "x")], "ord int, name string, key string, value string")
    assert entity_store.with_properties(m).first().properties == {"k": "new", "j": "x"}
    f = spark.createDataFrame([(2, "A", "attribute", "v", 0.5), (1, " a", "attribute", "v ", 0.9)], "ord int, entity string, attribute string, value string, confidence double")
    rows = entity_store.facts(f).collect()
    assert len(rows) == 1 and rows[0].confidence == 0.9


def test_similar_entities(spark):
    table = entity_store.with_vectors(spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "name string"), 8, w=1e6)  # one bucket
    got = entity_store.similar(table, "beta", 2, 8, w=1e6).collect()
    want = entity_store.np_similarity(["alpha", "beta", "gamma"], "beta", 8)
    assert got[0].name == "beta" and got[0].score == pytest.approx(1.0) and got[1].score == pytest.approx(sorted(want)[-2])
    assert entity_store.similar(table, " ").count() == 0
    narrow = entity_store.with_vectors(table.select("name"), 8, w=0.01)  # a bucket for each
    assert [r.name for r in entity_store.similar(narrow, "beta", 2, 8, w=0.01).collect()] == ["beta"]
    assert len(entity_store.similar(narrow, "delta", 2, 8, w=0.01).collect()) == 2  # an empty bucket: all entities


def test_extractors(spark):
    pages = pages_of(spark, "Cats are animals.", None, "x" * (extraction.MAX_CHARS + 1))
    extraction.register("first words", extraction.of_function(lambda t: [(t.split()[0], "begins", t.split()[-1])] * 2 if t else []))
    got = [(r.page_seq, r.subject, r.predicate) for r in extraction.extract(pages, "first words").orderBy("page_seq").collect()]
    assert [g[0] for g in got] == [0, 2] and got[0] == (0, "Cats", "begins")
    assert extraction.extract(pages).count() == 1
    with pytest.raises(ValueError):
        extraction.extract(pages, "none")
    with pytest.raises(Exception, match="text too long"):
        extraction.triples(pages, strict=True).count()


# --- evaluation, answers ---


def test_f1_and_recall(spark):
    pairs = spark.createDataFrame([(1, "the cat sat", "a cat sat down"), (2, "x", "y"), (3, "", "y"), (4, "Same!", "same")], "id int, prediction string, gold string")
    got = {r.id: (round(r.f1, 4), r.em) for r in evaluation.token_f1(pairs).collect()}
    assert got == {1: (0.8, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (1.0, 1.0)}
    r = evaluation.clean_rates(spark.createDataFrame([(1, ["Paris here"], "paris", "lyon"), (2, ["paris lyon"], "paris", "lyon")], "query_id int, pages array<string>, answer string, distractor string")).first()
    assert (r["clean"], r["any"], r["distracted"]) == (0.5, 1.0, 0.5)


TRUTH = [
    ("Who made the book?", ["The book was by Ada Lovelace Byron once."], "Ada Lovelace Byron"),
    ("When did the tower open?", ["The tower did open in 1889 for all."], "1889"),
    ("How many people live there?", ["There live 12,000 people now."], "12,000"),
    ("What is glass?", ["Glass is a hard solid."], "hard solid"),
    ("", [""], ""),
    (None, None, ""),
    ("Who wrote about Ada Lovelace?", ["Rain fell. Ada Lovelace was met by Charles Babbage."], "Charles Babbage"),
    ("Who won the race?", ["In the race the winner was Zoé, they say."], "Zoé"),
    ("Where was the treaty signed?", ["Nothing here.", "The treaty was signed in Den Haag, Holland in May."], "Den Haag, Holland"),
    ("What year did 1990 models sell?", ["The 1990 models did sell until 1994."], "1994"),
    ("How much snow fell?", ["Of snow fell 3.5 million tons, not 4."], "3.5 million"),
    ("Is the gate open?", ["The gate is not open."], "no"),
    ("Is the gate open?", ["The gate is open."], "yes"),
    ("Is the gate open?", ["Nobody knows the gate."], "Nobody knows"),
    ("What are voles?", ["Mice eat. Voles are small, furry animals."], "small"),
    ("Who sang?", ["no one here knows it"], ""),
    ("What of copper?", ["Copper ore comes from mines far away in old hills there"], "ore comes from mines far away in old"),
]


def test_answers(spark):
    rows = spark.createDataFrame([(i, p, q) for i, (q, p, _) in enumerate(TRUTH)], "i int, pages array<string>, question string")
    got = {r.i: r.a for r in rows.select("i", answers.answers(F.col("pages"), F.col("question")).alias("a")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(TRUTH)}
    made = rows.where("i = 0").select(answers.prompt(F.array(*[F.lit(f"p{k}") for k in range(7)]), F.col("question"))).first()[0]
    assert "[Page 5] p4" in made and "p5" not in made and made.endswith("Question: Who made the book?\nAnswer:")


# --- storage, streaming, serving ---


def test_store_round_trip(spark, tmp_path):
    tables = {"concepts": spark.createDataFrame([("a",), ("b",)], "concept string"), "edges": spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, w double")}
    store.save(tables, str(tmp_path))
    back = store.load(spark, str(tmp_path), ["concepts", "edges"], {"edges": ["src", "dst", "w"]})
    store.check_graph(back)
    assert back["edges"].first().w == 1.0
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path), ["none"])
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path), ["edges"], {"edges": ["x"]})
    with pytest.raises(ValueError):
        store.check_graph(back | {"concepts": tables["concepts"].limit(1)})


def test_stream_agrees_with_batch(spark, tmp_path):
    docs = [(i, f"The thing{i} is a part of unit{i % 3}. " * (i % 5)) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(docs[10 * k : 10 * k + 10], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
    (tmp_path / "in").mkdir()
    taker = Ingest(spark, str(tmp_path / "out"), 16)
    for k in range(3):
        next((tmp_path / f"made{k}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        taker.start(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))).awaitTermination()
    batch = paging.pages(spark.createDataFrame(docs, "doc_id long, text string"), 16)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(taker.pages()) == rows(batch)
    taker.add(spark.createDataFrame(docs[20:], "doc_id long, text string"), 2)  # a batch run again changes nothing
    assert rows(taker.pages()) == rows(batch)
    assert rows(taker.graph()["edges"]) == rows(graph.edges(extraction.triples(batch)))


def test_rpc():
    import json

    server = rpc.Server()
    server.register("collapse", lambda **a: {"pages": [a["query"]], "max_tokens": a["max_tokens"]} if a["query"] else {"error": "Empty query"})
    server.register("broken", lambda **a: 1 / 0)
    call = lambda method, **p: json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})))
    assert call("initialize")["result"]["protocolVersion"] == rpc.PROTOCOL
    assert [t["name"] for t in call("tools/list")["result"]["tools"]] == ["collapse", "broken"]
    good = call("tools/call", name="collapse", arguments={"query": "hi"})["result"]
    assert not good["isError"] and json.loads(good["content"][0]["text"]) == {"pages": ["hi"], "max_tokens": 4096}
    assert call("tools/call", name="collapse", arguments={"query": ""})["result"]["isError"]
    code = lambda r: r["error"]["code"]
    assert code(call("tools/call", name="collapse", arguments={})) == rpc.INVALID_PARAMS
    assert code(call("tools/call", name="collapse", arguments={"query": "x", "max_tokens": 0})) == rpc.INVALID_PARAMS
    assert code(call("tools/call", name="none")) == rpc.METHOD_NOT_FOUND and code(call("none")) == rpc.METHOD_NOT_FOUND
    assert code(call("tools/call", name="broken", arguments={"query": "x"})) == rpc.INTERNAL
    assert code(json.loads(server.answer("not json"))) == rpc.INVALID_REQUEST
    assert list(server.serve(['{"jsonrpc": "2.0", "method": "notifications/initialized"}', " "])) == []


def test_rpc_tables(spark):
    lines = spark.createDataFrame([('{"jsonrpc":"2.0","id":"1","method":"tools/call","params":{"name":"c","arguments":{"query":"q","required_concepts":["a"]}}}',), ("bad",), ('{"jsonrpc":"2.0","id":"2","method":"other"}',), ('{"jsonrpc":"2.0","id":"3","method":"tools/call","params":{"name":"c","arguments":{"max_tokens":5}}}',)], "value string")
    got = [(r.id, r.query, r.error) for r in rpc.requests(lines).collect()]
    assert got == [("1", "q", None), (None, None, rpc.INVALID_REQUEST), ("2", None, rpc.METHOD_NOT_FOUND), ("3", None, rpc.INVALID_PARAMS)]
    out = rpc.responses(spark.createDataFrame([("1", 5, None)], "id string, n int, error string")).first().value
    assert '"id":"1"' in out and '"isError":false' in out


def test_corpora(spark):
    docs, chains = corpora.hops(spark, 2, 3, 600)
    whole = " ".join(r.text for r in docs.collect())
    assert all(h["sentence"] in whole for c in chains for h in c["hops"])
    docs, facts = corpora.adversarial(spark, 3, 600)
    assert docs.count() == 12 and len(facts) == 3
    assert corpora.repeated_concepts(spark, 5000).count() == 50
