"""Operators on small inputs with results worked out by hand, and properties that must hold."""

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide import catalog
from vectide.functions import records as R
from vectide.functions import vectors as V
from vectide.operators import ann, graph, segments, sinks, text
from vectide.operators import search as S
from vectide.operators import vectorize as Z
from vectide.plans import align, registry
from vectide.plans.workflow import Runner, Workflow
from vectide.sources import files
from vectide.streaming import ingest


def vec(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id bigint, vector array<double>" + extra)


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.l2(a, b), V.lp(a, b, 1.0), V.cosine_distance(a, b), V.dot(a, b), V.squared_l2(V.sq_norm(a), V.sq_norm(b), V.dot(a, b))).collect()
    assert tuple(got[0]) == (5.0, 7.0, None, 0.0, 25.0)
    assert tuple(got[1]) == (pytest.approx(5**0.5), 3.0, 1.0, 0.0, 5.0)


def test_normalize(spark):
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(V.normalize(F.col("v")).alias("v")).collect()
    assert got[0].v == pytest.approx([0.6, 0.8]) and got[1].v == [None, None]


def test_jaccard_and_hardmax(spark):
    df = spark.createDataFrame([([True, True, False], [True, False, False], [1.0, 5.0, 5.0])], "a array<boolean>, b array<boolean>, v array<double>")
    r = df.select(V.jaccard_distance(F.col("a"), F.col("b")), V.packed_jaccard_distance(V.packed(F.col("a"), 3), V.packed(F.col("b"), 3)), V.hardmax(F.col("v"))).first()
    assert (r[0], r[1], r[2]) == (0.5, 0.5, [0, 1, 0])


def test_search_ties_nulls_and_filter(spark):
    df = vec(spark, [(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [1.0, 0.0], "a"), (4, None, "a")], ", tag string")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id bigint, vector array<double>")
    got = S.search(df, q, 2).orderBy("rank").collect()
    assert [(r.id, r.distance, r["rank"]) for r in got] == [(2, 0.0, 1), (3, 0.0, 2)]
    got = S.search(df, q, 5, where="tag = 'a'", output_fields=("tag",)).orderBy("rank").collect()
    assert [(r.id, r.tag) for r in got] == [(3, "a"), (1, "a")]
    assert S.search(df.where("id > 99"), q).count() == 0 and S.search(df, q.where("query_id > 99")).count() == 0


def test_search_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = vec(spark, [(i, rng.normal(size=4).tolist()) for i in range(60)])
    q = df.withColumnRenamed("id", "query_id")
    whole = {tuple(r) for r in S.search(df, q, 3).collect()}
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    assert {tuple(r) for r in S.search(df, q, 3).collect()} == whole


def test_search_cosine_of_zero(spark):
    df = vec(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])])
    got = S.search(df, df.withColumnRenamed("id", "query_id"), 5, "cosine").collect()
    assert [(r.query_id, r.id) for r in got] == [(2, 2)]


def test_unknown_metric(spark):
    df = vec(spark, [(1, [0.0])])
    with pytest.raises(ValueError):
        S.search(df, df, metric="no")


def test_records(spark):
    df = spark.createDataFrame([(1, {"a": "x"})], "id int, metadata map<string,string>")
    r = R.pop(R.put(R.put(df, "b", F.lit(2)), "a", F.lit("y")), "a", "out").first()
    assert r.metadata == {"b": "2"} and r.out == "y"
    assert spark.range(1).select(R.url_file_name(F.lit("http://h/a/b.png?x=1/2"))).first()[0] is not None
    with pytest.raises(ModuleNotFoundError):
        R.require("no_such_module_here")


def test_frames_and_clips(spark):
    df = spark.createDataFrame([(1, 5, 1.0, [1.0, 2.0, 3.0]), (2, 0, 1.0, [])], "id int, n int, fps double, s array<double>")
    got = segments.frames(df, "id", F.col("n"), F.col("fps"), 2.0).orderBy("seq").collect()
    assert [(r.position, r.name) for r in got] == [(0, "frame_0000.png"), (2, "frame_0001.png"), (4, "frame_0002.png")]
    assert [r.samples for r in segments.clips(df, "id", F.col("s"), 2).orderBy("seq").collect()] == [[1.0, 2.0], [3.0]]
    rates = spark.createDataFrame([("30000/1001",), ("25",), ("1/0",), ("x",)], "r string").select(F.try_to_number(F.lit("1"), F.lit("9")), "r")
    assert rates.where("r in ('25', '30000/1001', '1/0')").select(segments.frame_rate(F.col("r"))).collect()[1][0] == 25.0


def test_resample(spark):
    r = spark.createDataFrame([([0.0, 2.0, 4.0, 6.0],), ([],)], "s array<double>").select(V.resample(F.col("s"), 2, 4)).collect()
    assert r[0][0] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 6.0] and r[1][0] == []


def test_text_segments_cover(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "id int, text string")
    assert [r.segment for r in segments.text_segments(df, "id", "text", 3).orderBy("seq").collect()] == ["abc", "def", "g"]


def test_counts_and_tfidf(spark):
    df = spark.createDataFrame([(1, "Red red blue"), (2, "blue"), (3, None)], "id int, text string")
    assert {(r.id, r.term, r.n) for r in text.count_vectorize(df).collect()} == {(1, "red", 2), (1, "blue", 1), (2, "blue", 1)}
    w = {(r.id, r.term): r.weight for r in text.tfidf_vectorize(df).collect()}
    assert w[1, "red"] == pytest.approx(2 * (np.log(4 / 2) + 1), abs=1e-4)


def test_fastrp_matches_matrices(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 2, 1.0)], "src bigint, dst bigint, weight double")
    a = graph.adjacency(edges)
    got = {(r.node, r.d): r.value for r in graph.fastrp(a, 8).collect()}
    m = np.zeros((3, 3))
    for r in a.collect():
        m[r.src, r.dst] = r.weight
    p = spark.range(3).crossJoin(spark.range(8).withColumnRenamed("id", "d")).select("id", "d", graph.projection(F.col("id"), F.col("d").cast("int")).alias("x")).collect()
    x = np.zeros((3, 8))
    for r in p:
        x[r.id, r.d] = r.x * 0.5 / 3
    want = np.zeros((3, 8))
    for w in (0.1, 0.2, 1.0, 3.0):
        x = m @ x
        want += w * x
    assert all(abs(got.get((i, j), 0.0) - want[i, j]) < 1e-9 for i in range(3) for j in range(8))


def test_zip_cycle(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "b string, o int")
    got = align.zip_cycle([(a, ["a"]), (b, ["o"])]).collect()
    assert {(r.a, r.b) for r in got} == {(1, "x"), (2, "y"), (3, "x")}
    assert align.zip_cycle([(a, ["a"]), (b.where("o > 9"), ["o"])]).count() == 0


def test_workflow(spark):
    df = spark.createDataFrame([(1, 2)], "k int, x int")
    flow = Workflow().add(lambda d, **_: d, "seed").add(lambda d, **_: d.withColumn("x", F.lit(5)), "a", ["seed"]).add(lambda d, **_: d.withColumn("y", F.lit(7)), "b", ["seed"])
    flow.add(lambda d, **kw: align.override(d, **kw), "merge", ["b", "a"])
    assert flow(df, {"merge": {"z": 1}}, key="k").first().asDict() == {"k": 1, "y": 7, "x": 5, "z": 1}
    with pytest.raises(ValueError):
        Workflow().add(lambda d: d, "a").add(lambda d: d, "b", ["nowhere"]).compile()
    from graphlib import CycleError

    with pytest.raises(CycleError):
        Workflow().add(lambda d: d, "a", ["b"]).add(lambda d: d, "b", ["a"]).compile()


def test_runner_is_lazy():
    made = []
    r = Runner(lambda: made.append(1) or (lambda: 3), lazy=True)
    assert not made and r() == 3 and made == [1] and r.evaluated


def test_registry(spark):
    assert registry.canonical("SBERT") == "sentence-transformers"
    for kind, name in (("source", "no"), ("thing", "local")):
        with pytest.raises(ValueError):
            registry.make_operator(kind, name)
    with pytest.raises(ValueError):
        registry.make_operator("sink", "local", spark=spark, path="/tmp/x", operation="drop")
    with pytest.raises(ValueError):
        registry.make_operator("vectorizer", "image")
    for name in ("cohere", "voyage", "sbert", "imagebind", "text"):
        with pytest.raises(ValueError, match="provider"):
            registry.make_operator("vectorizer", name)
    assert not registry.make_operator("vectorizer", "hashed", runner="lazy", task_params={"dimension": 8}).evaluated
    assert registry.make_operator("vectorizer", "hashed", runner=lambda make, **kw: kw, task_params={"dimension": 8}) == {"dimension": 8}
    with pytest.raises(ValueError, match="runner"):
        registry.make_operator("vectorizer", "hashed", runner="elsewhere")


def test_vectorize_protocol(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, data string")
    got = {r.id: r.vector for r in Z.vectorize(df, Z.hashed_embedding(4), modality="text").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 or got[1] == [None] * 4
    assert got[2] is None and got[3] == [None] * 4
    both = Z.vectorize(df.where("id != 2"), Z.hashed_embedding(8), normalize=False).withColumn("e", Z.hashed_embedding_column(F.col("data"), 8)).collect()
    assert all(r.vector == r.e for r in both)


def test_boolean_vectors_stay(spark):
    df = spark.createDataFrame([(1, "x")], "id int, data string")
    got = Z.vectorize(df, lambda: lambda x: np.array([[True, False]] * len(x))).first()
    assert got.vector == [1.0, 0.0]


def test_onnx(spark):
    from vectide.operators.onnx_model import linear

    call = Z.onnx(linear([[1.0, 2.0], [3.0, 4.0]], [0.5, -0.5]))()
    x = np.array([[1, 1], [0, 2]], np.float32)
    assert np.allclose(call(x), x @ [[1, 2], [3, 4]] + [0.5, -0.5])
    assert np.allclose(call({"x": x}), call([x][0]))


def test_route_and_transcribe(spark):
    df = spark.createDataFrame([(1, "a", "text"), (2, "b", "image"), (3, "c", "other")], "id int, data string, type string")
    got = Z.route(df, {"text": lambda d: d.withColumn("v", F.lit(1)), "image": lambda d: d.withColumn("v", F.lit(2))})
    assert {(r.id, r.v) for r in got.collect()} == {(1, 1), (2, 2)}
    assert [tuple(r) for r in Z.transcribe(df.where("id = 1"), lambda: lambda x: [t.upper() for t in x]).collect()] == [("A", "text")]


def test_collection(spark, tmp_path):
    c = sinks.Collection(spark, str(tmp_path / "c"))
    df = spark.createDataFrame([(1, [0.0, 1.0], "image"), (2, [1.0, 0.0], "text")], "id bigint, vector array<double>, type string")
    done = c.insert(df).collect()
    assert {(r.type, r.insert_count) for r in done} == {("image", 1), ("text", 1)} and len({r.insert for r in done}) == 1
    assert sorted(r.id for r in c.ids(done[0].insert).collect()) == sorted(r.id for r in df.collect()) and c.read().columns == df.columns
    q = spark.createDataFrame([(7, [0.0, 1.0])], "query_id bigint, vector array<double>")
    assert [r.id for r in c.search(q, 1, filter="type like 'te%'").collect()] == [2]
    with pytest.raises(ValueError):
        c.transact(df, "drop")
    with pytest.raises(Exception, match="length"):
        c.insert(spark.createDataFrame([(3, [1.0], "text")], df.schema))


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.bin").write_bytes(b"12")
    (tmp_path / "in" / "deep" / "b.bin").write_bytes(b"345")
    assert {r.length for r in files.walk(spark, str(tmp_path / "in")).collect()} == {2, 3}
    assert {(r.name, r.bytes) for r in files.ingest(spark, str(tmp_path / "in"), str(tmp_path / "landing")).collect()} == {("a.bin", 2), ("b.bin", 3)}
    np.save(buf := io.BytesIO(), np.arange(6, dtype=np.float32).reshape(3, 2))
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.npy").write_bytes(buf.getvalue())
    assert [r.vector for r in files.npy(files.walk(spark, str(tmp_path / "n"))).orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    (tmp_path / "m.csv").write_text("ibuprofen,CC(C)C\nwater,O\n")
    assert files.molecules(spark, str(tmp_path / "m.csv")).count() == 2
    (tmp_path / "l.json").write_text('{"3": [1, 2],\n "4": [5]}')
    assert {tuple(r) for r in files.leaves(spark, str(tmp_path / "l.json")).collect()} == {(3, 1), (3, 2), (4, 5)}
    u = spark.createDataFrame([("http://x/a.pdf?q",), ("http://x/b",)], "url string")
    assert [bytes(r.data) for r in files.fetched(u, lambda x: b"ok" if "a.pdf" in x else None).collect()] == [b"ok"]
    assert [r[0] for r in u.select(files.media_kind(F.col("url"))).collect()] == ["document", "text"]
    assert bytes(spark.createDataFrame([("data:image/png;base64,aGk=",)], "d string").select(files.image_bytes(F.col("d"))).first()[0]) == b"hi"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.PDF").write_bytes(b"ab")
    (tmp_path / "d" / "x.txt").write_bytes(b"ab")
    pages = files.document_pages(files.walk(spark, str(tmp_path / "d")), lambda b: [bytes([x]) for x in b])
    assert [(r.page, bytes(r.image)) for r in pages.orderBy("page").collect()] == [(0, b"a"), (1, b"b")]


def test_stream_is_restartable(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    spark.range(10).write.parquet(src)
    ingest.insert(ingest.read(spark, src, "id bigint"), out, at).awaitTermination()
    spark.range(10, 15).write.mode("append").parquet(src)
    ingest.insert(ingest.read(spark, src, "id bigint"), out, at).awaitTermination()
    assert sorted(r.id for r in ingest.inserted(spark, out).collect()) == list(range(15))


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 60), st.integers(1, 5), st.integers(0, 9))
def test_two_means_balances(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim)).round(1)
    c, side = ann.balanced_two_means(x, seed)
    sizes = np.bincount(side, minlength=2)
    assert abs(sizes[0] - sizes[1]) <= 1
    assert ann.balance_loss(x, c, side) <= ann.balance_loss(x, x.mean(0)[None].repeat(2, 0), side) + 1e-9


def test_tree_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    df = vec(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    index = ann.build(df, n_trees=6, leaf=60, spill=0.1).save(str(tmp_path / "index"))
    sizes = index.leaves.groupBy("tree", "node").count().collect()
    assert index.n_trees == 6 and max(r["count"] for r in sizes) <= 130
    assert index.leaves.select("tree", "id").distinct().count() == 6 * 400
    q = df.withColumnRenamed("id", "query_id")
    near = index.search(q, 10).collect()
    exact = {(r.query_id, r.id) for r in S.search(df, q, 10).collect()}
    recall = len({(r.query_id, r.id) for r in near} & exact) / len(exact)
    assert recall > 0.6
    d = {(r.query_id, r.id): r.distance for r in near}
    assert all(abs(v - ((x[a] - x[b]) ** 2).sum()) < 1e-5 for (a, b), v in list(d.items())[:200])


def test_tree_without_rows_and_of_equal_rows(spark):
    assert ann.build(vec(spark, []), n_trees=1).leaves.count() == 0
    same = ann.build(vec(spark, [(i, [1.0, 1.0]) for i in range(300)]), n_trees=1)
    assert same.leaves.select("id").distinct().count() == 300
    with pytest.raises(ValueError):
        ann.build(vec(spark, []), spill=0.5)


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "w")
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'a'").write.parquet(src)
    s = ingest.windowed_counts(ingest.read(spark, src, "ts timestamp, k string"), "ts", "k")
    q = s.writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT n FROM wc").collect()[0].n == 2


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(50).selectExpr("id", "array(cast(id as double)) AS vector", "cast(id % 10 as int) AS label", "'x' AS other").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    plan = S.search(df, df.withColumnRenamed("id", "query_id"), 3, where="label < 5")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(label,5)" in plan and "other" not in plan
    assert "WindowGroupLimit" in plan  # only k rows a query and partition are shuffled


def test_all_parts_are_searched(spark, small):
    """Every part is a query and a row, with the operator's 2048 bits, against brute force."""
    parts = spark.read.parquet(f"{small}/part.parquet").select("p_partkey", "p_type").collect()
    prints = {t: {zlib.crc32(t[i : i + 3].encode()) % 2048 for i in range(len(t) - 2)} for t in {r.p_type for r in parts}}
    want = set()
    for q in parts:
        a = prints[q.p_type]
        d = sorted((round(1 - len(a & prints[r.p_type]) / len(a | prints[r.p_type]), 6), r.p_partkey) for r in parts)
        want |= {(q.p_partkey, i, x, n) for n, (x, i) in enumerate(d[:10], 1)}
    got = catalog.queries()["molecule_fingerprint_search"](spark, small).collect()
    assert len(got) == 10 * len(parts) and {(r.query_id, r.id, round(r.distance, 6), r["rank"]) for r in got} == want


def test_gkmeans_counts_every_row_of_a_group(spark):
    """A group of more rows than its centres are fitted on, a smaller one, and one of a single row."""
    rng = np.random.default_rng(3)
    sizes = {"1": 4999, "2": 301, "3": 1}
    rows = [(int(k) * 10_000 + i, v.tolist(), k) for k, n in sizes.items() for i, v in enumerate(rng.normal(size=(n, 3)))]
    got = {(r.label, r.cluster): r.rows for r in ann.gkmeans(vec(spark, rows, ", label string"), "label").collect()}
    assert got == {(k, c): (n + 1 - c) // 2 for k, n in sizes.items() for c in (0, 1)}
    assert ann.min_samples(64) == 7141


@pytest.mark.parametrize("n, dim", [(2000, 64)])
def test_tree_index_recall(spark, n, dim):
    """With the query's own parameters, over vectors of unit length."""
    x = np.random.default_rng(n).normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = vec(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    index = ann.build(df, n_trees=8, spill=0.15)
    got = index.search(df.withColumnRenamed("id", "query_id")).collect()
    exact = np.argsort(2 - 2 * x @ x.T, 1, kind="stable")[:, :10]
    recall = len({(r.query_id, r.id) for r in got} & {(i, j) for i, row in enumerate(exact.tolist()) for j in row}) / (10 * n)
    assert len(got) == 10 * n and recall >= 0.9


def test_more_leaves_find_more(spark):
    x = np.random.default_rng(2).normal(size=(240, 8))
    df = vec(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    index = ann.build(df, n_trees=1, leaf=65)
    q = df.limit(40).withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in index._exact(q, 10, 6).collect()}
    found = [len({(r.query_id, r.id) for r in index._walked(q, 10, 6, n).collect()} & exact) / len(exact) for n in (1, 2, 4)]
    assert found[0] < found[1] < found[2] == 1


def test_inserted_rows_are_found(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index = ann.build(vec(spark, rows[:500]), n_trees=4, leaf=50).insert(vec(spark, rows[500:])).save(str(tmp_path / "grown"))
    assert index.leaves.groupBy("tree").count().where("count != 600").count() == 0
    near = index.search(vec(spark, rows[500:]).withColumnRenamed("id", "query_id"), 1).collect()
    assert [(r.query_id, r.id) for r in sorted(near)] == [(i, i) for i in range(500, 600)]


def test_planes_at_tasks_and_in_joins_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = vec(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 6)))])
    q = df.withColumnRenamed("id", "query_id").limit(50)
    a = ann.build(df, n_trees=2, leaf=20, spill=0.1)
    walk = lambda x, leaves: {tuple(r) for r in x.traverse(q, leaves).select("query_id", "tree", "node").collect()}
    rows = lambda x: {tuple(r) for r in x.leaves.select("tree", "node", "id").collect()}
    want, leaves = (walk(a, 1), walk(a, 3)), rows(a)
    assert len(want[0]) == 100 and len(want[1]) == 300
    monkeypatch.setattr(ann, "NODE_BYTES", 0)
    assert (walk(a, 1), walk(a, 3)) == want
    other = rows(ann.build(df, n_trees=2, leaf=20, spill=0.1))
    assert other == leaves and len({(t, i) for t, _, i in other}) == 1400


def test_no_partition_takes_all_rows(spark):
    """Neither planes nor predictions are made by sorting everything in one task."""
    df = vec(spark, [(i, [float(i), 1.0]) for i in range(300)]).withColumnsRenamed({"vector": "v"})
    at = df.withColumns({"tree": F.lit(0), "node": F.lit(0).cast("bigint")})
    plan = ann._subtrees(at, 3, 100, 0.0, True, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_predict_with_few_and_many_centres(spark, monkeypatch):
    df = vec(spark, [(1, [0.0, 0.1]), (2, [5.0, 5.0]), (3, [1.0, 1.0]), (None, [1.0, 1.0])])
    centres = spark.createDataFrame([(7, [0.0, 0.0]), (8, [2.0, 2.0]), (9, [2.0, 2.0])], "cluster int, centre array<double>")
    want = {(1, 7, 0.1), (2, 8, 4.242641), (3, 7, 1.414214)}
    assert {tuple(r) for r in ann.predict(df, centres).collect()} == want
    monkeypatch.setattr(S, "BLOCK_BYTES", 8)
    assert {tuple(r) for r in ann.predict(df, centres).collect()} == want
    assert ann.predict(df, centres.where("false")).count() == 0


def test_vector_expressions_are_linear(spark):
    """Four thousand dimensions take at most ten times what five hundred do: nothing is computed anew for every element."""
    import time

    def took(dim, what):
        df = spark.range(100).select(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            df.select(what(F.col("v")).alias("x")).select(F.sum(F.size("x"))).collect()
            best = min(best, time.perf_counter() - start)
        return best

    for what in (V.normalize, V.hardmax, lambda v: V.masked_softmax(v, F.transform(v, lambda x: F.lit(1.0)))):
        assert took(4000, what) < 10 * max(took(500, what), 0.1)


def table_of(ids, x):
    import pyarrow as pa

    return pa.table({"id": pa.array(ids), "v": pa.array(list(x), pa.list_(pa.float64()))})


def nearest(x, ids, d, k=10):
    """What ``k`` nearest are by distances worked out one by one."""
    return {(q, int(ids[j]), float(d[q, j])) for q in range(len(d)) for j in np.lexsort((ids, d[q]))[:k]}


@pytest.mark.parametrize("metric", ["l2", "lp", "ip", "cosine", "squared_l2", "jaccard"])
def test_search_kernel(metric):
    """Blocks of rows give what all rows give, with equal rows, in little memory: a task holds no matrix of all distances."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(6000, 16)) * rng.integers(1, 8, (6000, 1)), 2, 0)
    if metric == "jaccard":
        x = (x > 0).astype(float)
    q, ids = x[:700], rng.permutation(len(x))
    d = np.round(S.distances(q, x, metric, 1.0), 6) + 0.0
    if metric == "l2":
        d[d < 1e-5] = 0  # of the expanded form
    tracemalloc.start()
    near = S._Nearest(table_of(np.arange(700), q), 10, metric, 1.0, 6, None)
    for lo in range(0, len(x), 1000):
        near.add(table_of(ids[lo : lo + 1000], x[lo : lo + 1000]))
    got = {(r["a"], r["b"], r["d"]) for batch in near.result(["a", "b", "d"]) for r in batch.to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = nearest(q, ids, d)
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}
    assert np.allclose(sorted(c for *_, c in got), sorted(c for *_, c in want), atol=2e-6)
    assert peak < 30 << 20


def test_search_sends_little(spark):
    """A block of queries is done with all rows of a part before anything is sent on: ``k`` rows a query, however small the batches are."""
    rng = np.random.default_rng(0)
    df = vec(spark, [(i, rng.normal(size=4).tolist()) for i in range(300)]).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        base, wanted = S._sides(df, df.withColumnRenamed("id", "query_id"), "id", "vector", "query_id", "vector")
        sent = S._compared(S._meeting(base, wanted), S._schema(base, wanted, "distance double"), 3, "l2", 2.0, 6)
        assert sent.count() == 900
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mean_distances(spark):
    df = spark.createDataFrame([("a", [1, 0, 0]), ("a", [1, 1, 0]), ("b", [0, 0, 0]), (None, [0, 1, 1]), ("b", None)], "g string, bits array<int>")
    plan = S.mean_distances(df, "g", "bits")
    got = {(r.query_group, r.group): (r.pairs, r.distance) for r in plan.collect()}
    assert got["a", "a"] == (4, 0.25) and got["a", "b"] == (2, 1.0) and got["b", "b"] == (1, 0.0) and got["a", None] == got[None, "a"] == (2, round((1 + 2 / 3) / 2, 6)) and len(got) == 9
    assert "zip_with" not in plan._jdf.queryExecution().executedPlan().toString()  # a pair is no row


def test_search_within_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3))
    df = spark.createDataFrame([(i, None if i % 11 == 0 else i % 4, x[i].tolist()) for i in range(90)], "id int, g int, vector array<double>")
    found = S.search_within(df, df.withColumnRenamed("id", "query_id"), [("g", "g"), ("id % 9", "query_id % 9")], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.id, r.distance) for r in found.collect()}
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    i = np.arange(90)
    met = (i[:, None] % 9 == i % 9) | (i[:, None] % 4 == i % 4) & (i[:, None] % 11 > 0) & (i % 11 > 0)
    want = {(int(q), int(b), float(d[q, b])) for q in i for b in [j for j in np.argsort(d[q], kind="stable") if met[q, j]][:5]}
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want} and len(got) == 450
    # the candidates of a query are never listed: what is deduped are k rows a grouping and task
    assert plan.index("MapInArrow") > plan.index("HashAggregate")


def test_demux_of_odd_documents(spark, tmp_path):
    """Texts that are empty, null or of one id: each document has a row a modality, as in SQL."""
    import duckdb
    from compare import assert_same

    rows = [(1, ""), (2, None), (3, "a b  c"), (3, "x" * 70), (None, " "), (4, "é " * 50)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(catalog.queries()["demux_branches"](spark, str(tmp_path)), con, catalog.oracle_sql()["demux_branches"])


def test_search_all_spreads_a_value(spark, monkeypatch):
    """Rows of one value aren't brought together, however many they are; with many values they are spread."""
    df = spark.createDataFrame([(i, f"v{i % 3}" if i % 7 else None) for i in range(200)], "id bigint, name string")
    make = lambda d: d.withColumn("vector", F.array(F.substring("name", 2, 1).cast("double")))
    found = S.search_all(df, "name", make, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan
    whole = sorted(tuple(r) for r in found.collect())
    assert len(whole) == 4 * df.where("name IS NOT NULL").count() and whole[:4] == [(1, 1, 0.0, 1, "v1"), (1, 4, 0.0, 2, "v1"), (1, 10, 0.0, 3, "v1"), (1, 13, 0.0, 4, "v1")]
    monkeypatch.setattr(S, "FEW", 1)
    assert sorted(tuple(r) for r in S.search_all(df, "name", make, 4).collect()) == whole


def test_lp_is_bounded():
    """Two products tell of more than half of the pairs that they are too far, and of none that is near."""
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(50, 64)), rng.normal(size=(20000, 64))
    d = np.abs(q[:, None] - v[None]).sum(2)
    border = np.partition(d, 9, 1)[:, 9]
    x, y = S._Bound(q, "lp", 1.0).pairs(v, border, d.size)
    assert {*zip(*np.nonzero(d <= border[:, None]))} <= {*zip(x.tolist(), y.tolist())} and len(x) < 0.5 * d.size


def test_two_stage_measures_in_place(spark, monkeypatch):
    """Candidates are measured where they are found: no vector is joined to a candidate. Several parts of the rows give what one gives."""
    rng = np.random.default_rng(1)
    df = vec(spark, [(i, rng.normal(size=6).tolist()) for i in range(120)])
    found = S.two_stage(df, df.withColumnRenamed("id", "query_id"), 3, 10, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    whole = sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(S, "BLOCK_BYTES", 1000)
    assert sorted(tuple(r) for r in S.two_stage(df, df.withColumnRenamed("id", "query_id"), 3, 10, 2).collect()) == whole and len(whole) == 360


@pytest.mark.parametrize("repeated", [False, True])
def test_tfidf_shuffles_once(spark, monkeypatch, repeated):
    """Terms with long and short lists in several tasks, rows of one id, nulls; what is shuffled is a list a term and task, once."""
    monkeypatch.setattr(text, "LONG", 3)
    rows = [(i, f"all word{i % 5} pair{i // 2} own{i} " + "all " * (i % 3) if i % 9 else None) for i in range(60)] + [(60, "")] + [(None, "lost all")]
    rows += [(7, "all again"), (8, "word1 word1")] if repeated else []
    df = spark.createDataFrame(rows, "id int, text string").repartition(5)
    found = text.tfidf_vectorize(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    tf = {}
    for i, t in rows:
        for w in (t or "").split():
            tf[i, w] = tf.get((i, w), 0) + 1
    n = {w: len([1 for _, x in tf if x == w]) for _, w in tf}
    want = {k: c * (np.log((1 + len(rows)) / (1 + n[k[1]])) + 1) for k, c in tf.items()}
    got = found.collect()
    assert len(got) == len(want) and all(abs(r.weight - want[r.id, r.term]) < 6e-5 for r in got)
    assert "Join" not in plan and (repeated or plan.count("Exchange hashpartitioning") == 1)
    if not repeated:
        assert "Exchange" not in text.count_vectorize(df.coalesce(2))._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")


def test_copies_of_a_row_are_bounded(spark):
    """A row's copies in a tree don't grow with the depth, so that an index grows as its rows."""
    df = vec(spark, [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(8).normal(size=(1500, 4)))])
    index = ann.build(df, n_trees=2, leaf=6, spill=0.15)
    assert index.leaves.select("tree", "id").distinct().count() == 3000
    assert index.leaves.count() < 3000 * 1.3**ann.OVERLAP * 1.2
    assert index.leaves.groupBy("tree", "node").count().agg(F.avg("count")).first()[0] < 12


def test_leaves_meet_queries_in_one_place(spark, monkeypatch):
    """Few queries at the tasks, many by leaf, and candidates one by one give the same rows; by leaf no candidate is listed. Trees in one pass or several, too."""
    df = vec(spark, [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(size=(500, 5)))])
    index = ann.build(df, n_trees=3, leaf=40, spill=0.1)
    q = df.where("id < 60").withColumnRenamed("id", "query_id")
    listed = index.traverse(q, 2).join(index.leaves, ["tree", "node"]).select("query_id", "id")
    want = {(r.query_id, r.id, r.distance) for r in S.rerank(listed, df, q, 7, metric="squared_l2").collect()}
    walked = index._walked(q, 7, 6, 2)
    assert {(r.query_id, r.id, r.distance) for r in walked.collect()} == want == {(r.query_id, r.id, r.distance) for r in index._probed(q, 7, 6, 2).collect()} and len(want) == 420
    assert len(ann._together(index.nodes, [0, 1, 2])) == 1
    monkeypatch.setattr(ann, "NODE_BYTES", 3000)
    assert len(ann._together(index.nodes, [0, 1, 2])) == 3
    assert {(r.query_id, r.id, r.distance) for r in index._walked(q, 7, 6, 2).collect()} == want
