"""All queries of the engine by name, and for each the SQL that gives the same rows, where there is one.

Every query runs over its whole tables; in searches every row is a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import records as R
from vectide.functions import vectors as V
from vectide.operators import ann, graph, segments, text
from vectide.operators import search as S
from vectide.operators import vectorize as Z
from vectide.operators.sinks import Collection, insert_summary
from vectide.plans import align
from vectide.plans.registry import make_operator, registered
from vectide.plans.workflow import Runner, Workflow
from vectide.sources import files
from vectide.storage import new_path, table, written
from vectide.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def own(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _ORACLES[fn.__name__] = sql
        return fn

    return own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# -- search ------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str, scaled: bool = False) -> DataFrame:
    v = V.doubles("embedding")
    if scaled:  # unit vectors rank alike by all metrics
        v = F.transform(v, lambda x: x * (1 + F.col("vec_id") % 7))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("vector"), "label")


_V = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"
_SCALED = "SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS v, label FROM embeddings"


def _topk(distance: str, source: str = _V, k: int = 10, out: str = "distance", where: str = "true", fields: str = "") -> str:
    return f"""
WITH e AS ({source}), d AS (
  SELECT q.id AS query_id, b.id, round({distance}, 6) + 0.0 AS distance{fields} FROM e q CROSS JOIN e b WHERE {where}
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM d)
SELECT query_id, id, {out} AS distance, rank{fields.replace('b.', '')} FROM r WHERE rank <= {k}"""


def _all_pairs(df: DataFrame, **kw) -> DataFrame:
    return S.search(df, df.withColumnRenamed("id", "query_id"), **kw)


@_query(_topk("list_distance(q.v, b.v)"))
def search_l2_topk(spark, d):
    return _all_pairs(_vectors(spark, d))


@_query(_topk("1 - list_cosine_similarity(q.v, b.v)", _SCALED))
def search_cosine_topk(spark, d):
    return _all_pairs(_vectors(spark, d, True), metric="cosine")


@_query(_topk("-list_inner_product(q.v, b.v)", _SCALED, out="-distance"))
def search_ip_topk(spark, d):
    return _all_pairs(_vectors(spark, d, True), metric="ip")


@_query(_topk("list_sum(list_transform(list_zip(q.v, b.v), lambda z: abs(z[1] - z[2])))", _SCALED))
def search_lp_topk(spark, d):
    return _all_pairs(_vectors(spark, d, True), metric="lp", p=1.0)


@_query(_topk("greatest(0, list_inner_product(q.v, q.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(q.v, b.v))", _SCALED))
def search_sql2_expanded(spark, d):
    return _all_pairs(_vectors(spark, d, True), metric="squared_l2")


_BITS = "SELECT vec_id AS id, list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END))::UBIGINT AS v, label FROM embeddings"


@_query(_topk("1 - bit_count(q.v & b.v)::DOUBLE / bit_count(q.v | b.v)", _BITS))
def search_jaccard_topk(spark, d):
    return _all_pairs(_vectors(spark, d).withColumn("vector", F.transform("vector", lambda x: (x > 0).cast("int"))), metric="jaccard")


@_query(_topk("list_distance(q.v, b.v)", where="b.label < 5", fields=", b.label"))
def search_filtered_topk(spark, d):
    df = _vectors(spark, d)
    return S.search(df, df.withColumnRenamed("id", "query_id"), where="label < 5", output_fields=("label",))


@_query(f"""
WITH e AS ({_V}), c AS (
  SELECT q.id AS query_id, b.id, round(list_distance(q.v[1:16], b.v[1:16]), 6) AS distance FROM e q CROSS JOIN e b
), n AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM c) WHERE r <= 150),
x AS (SELECT query_id, n.id, round(list_distance(q.v, b.v), 6) AS distance FROM n JOIN e q ON q.id = query_id JOIN e b ON b.id = n.id)
SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM x) WHERE rank <= 10""")
def search_two_stage(spark, d):
    df = _vectors(spark, d)
    return S.two_stage(df, df.withColumnRenamed("id", "query_id"))


@_query(f"""
WITH e AS ({_V}), n AS (SELECT q.id AS query_id, b.id FROM e q JOIN e b ON q.label = b.label UNION SELECT q.id, b.id FROM e q JOIN e b ON b.id % 50 = q.id % 50),
x AS (SELECT query_id, n.id, round(greatest(0, list_inner_product(q.v, q.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(q.v, b.v)), 6) + 0.0 AS distance FROM n JOIN e q ON q.id = query_id JOIN e b ON b.id = n.id)
SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM x) WHERE rank <= 10""")
def candidate_dedup_rerank(spark, d):
    """Candidates of two partitionings, each pair taken once."""
    df = _vectors(spark, d)
    q = df.withColumnRenamed("id", "query_id")
    return S.search_within(df, q, [("label", "label"), ("id % 50", "query_id % 50")], metric="squared_l2")


@_query(f"""
WITH e AS ({_BITS}), b AS (SELECT * FROM e)
SELECT q.label AS query_label, b.label, count(*) AS pairs, round(avg(1 - bit_count(q.v & b.v)::DOUBLE / bit_count(q.v | b.v)), 6) AS distance FROM e q CROSS JOIN b GROUP BY 1, 2""")
def packed_jaccard(spark, d):
    """Mean distances between labels over all pairs of fingerprints."""
    df = _vectors(spark, d).select("label", F.transform("vector", lambda x: (x > 0).cast("int")).alias("bits"))
    return S.mean_distances(df, "label", "bits").select(F.col("query_group").alias("query_label"), F.col("group").alias("label"), "pairs", "distance")


# -- vectors and records ------------------------------------------------------------------------------------------


@_query("""
WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7)) AS v FROM embeddings)
SELECT vec_id, (pos - 1)::INT AS pos, round(v[pos] / nullif(sqrt(list_inner_product(v, v)), 0), 6) + 0.0 AS value FROM e, generate_series(1, 64) t(pos)""")
def normalize_vectors(spark, d):
    """Some of the vectors are zero: their elements are null."""
    v = F.transform(V.doubles("embedding"), lambda x: x * (F.col("vec_id") % 7))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(V.normalize(v)).alias("pos", "x")).select("vec_id", "pos", (F.round("x", 6) + 0.0).alias("value"))


@_query("""
SELECT vec_id AS id, 'vec_' || vec_id AS data, CASE WHEN label % 2 = 0 THEN 'image' ELSE 'text' END AS type, label::VARCHAR AS label, 2::INT AS n_metadata, 64::INT AS dim FROM embeddings""")
def vector_records(spark, d):
    """Metadata put, replaced and popped, and a record made."""
    df = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label", F.create_map(F.lit("type"), F.lit("none")).alias("metadata"))
    df = R.put(R.put(df, "data", F.concat(F.lit("vec_"), "vec_id")), "type", F.when(F.col("label") % 2 == 0, "image").otherwise("text"))
    df = R.pop(R.put(df, "label", F.col("label")), "label", "label")
    df = R.to_record(df, "v", "vector")
    return df.select(F.col("vec_id").alias("id"), F.col("metadata")["data"].alias("data"), F.col("metadata")["type"].alias("type"), "label", F.size("metadata").alias("n_metadata"), F.size("vector").alias("dim"))


@_query("""
SELECT vec_id, '{"id":' || vec_id || ',"label":' || label || ',"signs":[' || array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), ',') || ']}' AS json FROM embeddings""")
def vector_json(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("signs"))
    return df.select("vec_id", R.as_json("id", "label", "signs").alias("json"))


@_query("SELECT 'bigint' AS vec_id, 'array<float>' AS embedding, 'int' AS label, count(*) AS n FROM embeddings")
def type_names(spark, d):
    df = table(spark, d, "embeddings")
    return df.groupBy(R.type_name("vec_id").alias("vec_id"), R.type_name("embedding").alias("embedding"), R.type_name("label").alias("label")).agg(F.count("*").alias("n"))


@_query("SELECT label, (pos - 1)::INT AS pos, round(avg(embedding[pos]::DOUBLE), 6) + 0.0 AS value FROM embeddings, generate_series(1, 64) t(pos) GROUP BY 1, 2")
def centroid_pool(spark, d):
    return segments.pool(table(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.col("value") + 0.0)


@_query("""
SELECT vec_id, (pos - 1)::INT AS pos, (embedding[pos] = list_max(embedding))::INT AS value FROM embeddings, generate_series(1, 64) t(pos)""")
def hardmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(V.hardmax(F.col("embedding"))).alias("pos", "value"))


@_query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT *, list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN exp(x) ELSE 0 END)) AS t FROM e)
SELECT vec_id, (pos - 1)::INT AS pos, round(CASE WHEN v[pos] > 0 THEN exp(v[pos]) ELSE 0 END / t, 6) AS value FROM s, generate_series(1, 64) g(pos)""")
def masked_softmax(spark, d):
    v = V.doubles("embedding")
    p = V.masked_softmax(v, F.transform(v, lambda x: (x > 0).cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(p).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("value"))


@_query("SELECT dim::INT AS dim, ceil(greatest(4 / (0.01 * ln(2 / 0.05)), 8 * dim / (0.01 * ln(13 / 0.01))))::BIGINT AS samples FROM (SELECT DISTINCT len(embedding) AS dim FROM embeddings)")
def min_samples(spark, d):
    dims = table(spark, d, "embeddings").select(F.size("embedding").alias("dim")).distinct()
    return dims.select("dim", V.min_samples(F.col("dim")).alias("samples"))


_PLANE = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
c AS (SELECT label < 5 AS low, pos, avg(v[pos]) AS m FROM e, generate_series(1, 64) t(pos) GROUP BY 1, 2),
w AS (SELECT list(b.m - a.m ORDER BY a.pos) AS w, -sum((b.m + a.m) * (b.m - a.m)) / 2 AS b FROM c a JOIN c b ON a.pos = b.pos AND a.low AND NOT b.low),
d AS (SELECT vec_id, round(list_inner_product(v, w) + b, 6) + 0.0 AS distance FROM e, w),
r AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS r, count(*) OVER () AS n FROM d)
SELECT vec_id, distance, CASE WHEN r <= n // 2 THEN 'left' ELSE 'right' END AS side FROM r"""


@_query(_PLANE)
def hyperplane_split(spark, d):
    """The plane between the means of two halves of the labels, and each row's side by rank."""
    df = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("v"), "label")
    mean = segments.pool(df.withColumn("low", F.col("label") < 5), "low", "v", 15)
    both = mean.groupBy("pos").agg(F.max(F.when(F.col("low"), F.col("value"))).alias("a"), F.max(F.when(~F.col("low"), F.col("value"))).alias("b"))
    plane = both.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("b") - F.col("a")).alias("w")))), lambda x: x["w"]).alias("w"), (-F.sum((F.col("a") + F.col("b")) * (F.col("b") - F.col("a"))) / 2).alias("b"))
    dist = df.crossJoin(F.broadcast(plane)).select("vec_id", (F.round(V.hyperplane_distance(F.col("v"), F.col("w"), F.col("b")), 6) + 0.0).alias("distance"))
    ranked = align.numbered(dist, ["distance", "vec_id"])
    n = dist.agg(F.floor(F.count("*") / 2).alias("half"))
    return ranked.crossJoin(F.broadcast(n)).select("vec_id", "distance", F.when(F.col("_row") < F.col("half"), "left").otherwise("right").alias("side"))


_CENTRES = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
c AS (SELECT label AS cluster, list(m ORDER BY pos) AS c FROM (SELECT label, pos, round(avg(v[pos]), 6) AS m FROM e, generate_series(1, 64) t(pos) GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT vec_id, label, arg_min(cluster, (round(list_distance(v, c), 6), cluster)) AS cluster, min(round(list_distance(v, c), 6)) AS distance FROM e CROSS JOIN c GROUP BY 1, 2)
"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    centres = segments.pooled_vectors(segments.pool(df, "label", "vector"), "label").select(F.col("label").alias("cluster"), F.col("vector").alias("centre"))
    return ann.predict(df, centres).withColumnRenamed("id", "vec_id")


@_query(_CENTRES + "SELECT vec_id, cluster, distance FROM p")
def nearest_center(spark, d):
    return _predicted(spark, d)


@_query(_CENTRES + """, g AS (SELECT DISTINCT label AS grp FROM e), k AS (SELECT cluster FROM c)
SELECT grp AS label, k.cluster, count(p.vec_id) AS n FROM g CROSS JOIN k LEFT JOIN p ON p.label = grp AND p.cluster = k.cluster GROUP BY 1, 2""")
def cluster_bincount(spark, d):
    """Counts of each label and cluster, zeros included."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    n = _predicted(spark, d).join(labels, "vec_id").groupBy("label", "cluster").agg(F.count("*").alias("n"))
    every = labels.select("label").distinct()
    grid = every.crossJoin(every.select(F.col("label").alias("cluster")))
    return grid.join(n, ["label", "cluster"], "left").select("label", "cluster", F.coalesce("n", F.lit(0)).alias("n"))


@_query(_CENTRES + ", n AS (SELECT cluster, count(*) AS n FROM p GROUP BY 1) SELECT max(n) AS most, min(n) AS least, sum(n)::BIGINT AS total, round((max(n) - min(n)) / sum(n)::DOUBLE, 6) AS imbalance FROM n")
def cluster_imbalance(spark, d):
    n = _predicted(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("total"), F.round((F.max("n") - F.min("n")) / F.sum("n"), 6).alias("imbalance"))


# -- text ---------------------------------------------------------------------------------------------------------

_TERMS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]{2,})', 1)) AS term FROM documents"


@_query(f"WITH t AS ({_TERMS}) SELECT doc_id, term, count(*) AS n FROM t GROUP BY 1, 2")
def count_vectorize(spark, d):
    return text.count_vectorize(table(spark, d, "documents"), "doc_id")


@_query(f"""
WITH t AS ({_TERMS}), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), r AS (SELECT count(*) AS rows FROM documents)
SELECT doc_id, term, round(n * (ln((1.0::DOUBLE + rows) / (1.0::DOUBLE + df)) + 1), 4) AS weight FROM c JOIN f USING (term), r""")
def tfidf_vectorize(spark, d):
    return text.tfidf_vectorize(table(spark, d, "documents"), "doc_id")


@_query(f"WITH t AS ({_TERMS}) SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 1024 AS bucket, count(*) AS n FROM t GROUP BY 1, 2")
def hashing_vectorize(spark, d):
    return text.hashing_vectorize(table(spark, d, "documents"), "doc_id")


@_query("""
WITH s AS (SELECT doc_id, text, unnest(generate_series(0, (length(text) + 499) // 500 - 1)) AS seq FROM documents)
SELECT doc_id, seq::INT AS seq, (seq * 500)::INT AS start, substr(text, (seq * 500 + 1)::BIGINT, 500) AS segment FROM s""")
def segment_text(spark, d):
    return segments.text_segments(table(spark, d, "documents"), "doc_id", "text")


def _media(spark: SparkSession, d: str) -> DataFrame:
    """A film a document: a frame a character, and a sample a byte of its first line's words."""
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("frame_count"), F.lit("30000/1001").alias("fps"), F.lit(8).alias("rate"), F.transform(F.split("text", " "), lambda w: F.length(w).cast("double")).alias("samples"))


@_query("""
WITH f AS (SELECT doc_id, length(text) AS n, 30000::DOUBLE / 1001 AS fps FROM documents), s AS (SELECT *, unnest(generate_series(0, ceil(n / (fps * 2.0))::BIGINT - 1)) AS seq FROM f)
SELECT doc_id, seq::INT AS seq, trunc(seq * (fps * 2.0))::BIGINT AS position, round(trunc(seq * (fps * 2.0)) / fps, 6) AS start, format('frame_{:04d}.png', seq) AS name FROM s""")
def segment_names(spark, d):
    return segments.frames(_media(spark, d), "doc_id", F.col("frame_count"), segments.frame_rate(F.col("fps"))).withColumn("start", F.round("start", 6))


@_query("""
WITH a AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS s FROM documents), c AS (SELECT doc_id, s, unnest(generate_series(0, (len(s) + 15) // 16 - 1)) AS seq FROM a)
SELECT doc_id, seq::INT AS seq, format('audio_{:04d}.wav', seq) AS name, len(s[seq * 16 + 1:seq * 16 + 16])::INT AS samples, list_sum(s[seq * 16 + 1:seq * 16 + 16])::DOUBLE AS total FROM c""")
def segment_clips(spark, d):
    """Clips of two seconds at eight samples a second; the last may be short."""
    c = segments.clips(_media(spark, d), "doc_id", F.col("samples"), 16)
    return c.select("doc_id", "seq", "name", F.size("samples").alias("samples"), V.total(F.col("samples")).alias("total"))


@_query("""
WITH f AS (SELECT doc_id, ceil(length(text) / (30000::DOUBLE / 1001 * 2.0))::INT AS i, ((len(string_split(text, ' ')) + 15) // 16)::INT AS a FROM documents)
SELECT doc_id, 'image' AS type, i AS n FROM f UNION ALL SELECT doc_id, 'audio', a FROM f""")
def demux_branches(spark, d):
    return make_operator("transform", "video-demux", id_col="doc_id")(_media(spark, d)).select("doc_id", "type", F.when(F.col("data").isNotNull(), F.size("data")).alias("n"))


@_query("""
WITH a AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)::DOUBLE) AS s FROM documents), p AS (SELECT doc_id, s, unnest(generate_series(0, len(s) * 5 // 8 - 1)) AS i FROM a),
t AS (SELECT doc_id, count(*) AS n, round(sum(s[least(floor(i * 1.6)::BIGINT + 1, len(s))] + (s[least(floor(i * 1.6)::BIGINT + 2, len(s))] - s[least(floor(i * 1.6)::BIGINT + 1, len(s))]) * (i * 1.6::DOUBLE - floor(i * 1.6::DOUBLE))), 4) AS total FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM documents LEFT JOIN t USING (doc_id)""")
def resample_audio(spark, d):
    """From eight samples a second to five, by linear interpolation."""
    r = _media(spark, d).select("doc_id", V.resample(F.col("samples"), 8, 5).alias("r"))
    return r.select("doc_id", F.size("r").cast("bigint").alias("n"), F.round(V.total(F.col("r")), 4).alias("total"))


# -- graph --------------------------------------------------------------------------------------------------------


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """Nations that buy from nations, weighted by order lines."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("src"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("dst"))
    return l.join(o, "o_orderkey").join(c, "c_custkey").join(s, "s_suppkey").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


_TRADE = """
WITH t AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
a AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM t UNION ALL SELECT dst, src, weight FROM t) GROUP BY 1, 2)
"""


@_query(_TRADE + "SELECT * FROM a")
def graph_adjacency(spark, d):
    return graph.adjacency(_trade(spark, d))


@_query(_TRADE + """, m AS (SELECT src, dst, weight / (SELECT max(weight) FROM a) AS w FROM a),
n AS (SELECT DISTINCT src AS node FROM m),
z AS (SELECT node, d::INT AS d, ('0x' || substr(md5(node || ':' || d), 1, 8))::BIGINT % 6 AS r FROM n, generate_series(0, 15) g(d)),
p0 AS (SELECT node, d, 0.5 / (SELECT count(*) FROM n) * CASE r WHEN 0 THEN sqrt(3) WHEN 1 THEN -sqrt(3) ELSE 0 END AS x FROM z),
p1 AS (SELECT src AS node, d, sum(w * x) AS x FROM m JOIN p0 ON node = dst GROUP BY 1, 2),
p2 AS (SELECT src AS node, d, sum(w * x) AS x FROM m JOIN p1 ON node = dst GROUP BY 1, 2),
p3 AS (SELECT src AS node, d, sum(w * x) AS x FROM m JOIN p2 ON node = dst GROUP BY 1, 2),
p4 AS (SELECT src AS node, d, sum(w * x) AS x FROM m JOIN p3 ON node = dst GROUP BY 1, 2)
SELECT node, d, round(0.1 * p1.x + 0.2 * p2.x + p3.x + 3 * p4.x, 5) + 0.0 AS value FROM p1 JOIN p2 USING (node, d) JOIN p3 USING (node, d) JOIN p4 USING (node, d) WHERE p1.d IN (SELECT d FROM z WHERE r < 2)""")
def fastrp_embed(spark, d):
    e = written(graph.adjacency(_trade(spark, d)), "edges")
    top = e.agg(F.max("weight").alias("top"))
    e = e.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("weight") / F.col("top")).alias("weight"))
    return graph.fastrp(e, 16, digits=5).select("node", "d", (F.col("value") + 0.0).alias("value"))


# -- dataflow -----------------------------------------------------------------------------------------------------


@_query("""
WITH s AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier), n AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS r, count(*) OVER () AS c FROM nation),
m AS (SELECT max(r) + 1 AS sc FROM s), l AS (SELECT unnest(generate_series(0, greatest((SELECT sc FROM m), (SELECT max(c) FROM n)) - 1)) AS r)
SELECT s_suppkey, s_name, n_nationkey, n_name FROM l JOIN m ON true JOIN s ON s.r = l.r % sc JOIN n ON n.r = l.r % n.c""")
def zip_cycle_join(spark, d):
    s, n = table(spark, d, "supplier").select("s_suppkey", "s_name"), table(spark, d, "nation").select("n_nationkey", "n_name")
    return align.zip_cycle([(s, ["s_suppkey"]), (n, ["n_nationkey"])])


@_query("SELECT event_id, event_type, user_id, round(value * 2, 6) AS value, 'second' AS node FROM events")
def merge_last_wins(spark, d):
    e = table(spark, d, "events")
    first = e.select("event_id", "event_type", "value", F.lit("first").alias("node"))
    second = e.select("event_id", "user_id", F.round(F.col("value") * 2, 6).alias("value"), F.lit("second").alias("node"))
    return align.merge_last([first, second], "event_id").select("event_id", "event_type", "user_id", "value", "node")


@_query("SELECT n_nationkey, n_name, 99::INT AS n_regionkey FROM nation")
def override_params(spark, d):
    """A value given for one step only."""
    flow = Workflow().add(lambda df, **kw: align.override(df, **kw), "set").add(lambda df, **_: df, "out")
    return flow(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), {"set": {"n_regionkey": 99}})


@_query("SELECT event_id, value FROM events WHERE event_type <> 'click' AND value IS NOT NULL")
def null_propagation(spark, d):
    """What a step gives nothing for goes no further."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("value")).alias("value"))
    return align.present(e, "value")


@_query("SELECT n_nationkey, unnest(string_split(n_name, '')) AS letter FROM nation UNION ALL SELECT n_nationkey, unnest(string_split(n_name, '')) FROM nation")
def explode_lists(spark, d):
    letters = F.filter(F.split("n_name", ""), lambda c: c != "")
    return align.exploded(table(spark, d, "nation").select("n_nationkey", F.array(letters, letters).alias("letter")), "letter")


def _modalities(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("data"), F.lit("text").alias("type"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("data"), F.lit("html").alias("type"))
    talk = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("data"), F.lit("audio").alias("type"))
    return docs.unionByName(pages).unionByName(talk)


@_query("SELECT 'text' AS type, (SELECT count(*) FROM documents) AS insert_count UNION ALL SELECT 'html', (SELECT count(*) FROM pages) UNION ALL SELECT 'audio', (SELECT count(*) FROM conversations)")
def workflow_insert_summary(spark, d):
    """A workflow whose last step inserts into a collection, and tells how many of each modality."""
    path = new_path(spark, "collection")
    flow = Workflow().add(Runner(lambda: lambda df, **_: df), "read")
    flow.add(Runner(lambda: lambda df, **_: df.withColumn("vector", F.array(F.length("data").cast("double"), F.ascii("data").cast("double"))), lazy=True), "vectorize")
    flow.add(make_operator("sink", "local", spark=spark, path=path, vector_field="vector"), "insert")
    return flow(_modalities(spark, d)).drop("insert")


@_query("""
SELECT 'text' AS type, doc_id AS id, length(text)::DOUBLE AS v FROM documents UNION ALL SELECT 'html', page_id, -length(html)::DOUBLE FROM pages""")
def multimodal_route(spark, d):
    """Each modality by its own vectorizer; one that has none is left out."""
    ways = {"text": lambda df: df.select("type", "id", F.length("data").cast("double").alias("v")), "html": lambda df: df.select("type", "id", (-F.length("data")).cast("double").alias("v"))}
    return make_operator("vectorizer", "multimodal", ways=ways)(_modalities(spark, d))


@_query("SELECT page_id, url, split_part(list_last(string_split(url, '/')), '?', 1) AS file_name FROM pages")
def url_cache_name(spark, d):
    return table(spark, d, "pages").select("page_id", "url", R.url_file_name(F.col("url")).alias("file_name"))


_REGISTERED = {
    "sink": "local milvus mongodb parquet",
    "source": "ingest local youtube",
    "transform": "document-screenshot speech-to-text text-segments video-demux",
    "vectorizer": "audio cohere graph hashed image imagebind molecule multimodal pytorch-image-models scikit-learn sentence-transformers text torchaudio voyageai",
}


@_query("SELECT kind, name FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, names in _REGISTERED.items() for n in names.split()) + ") t(kind, name)")
def operator_registry(spark, d):
    return spark.createDataFrame(registered(), "kind string, name string")


# -- sources and sinks ----------------------------------------------------------------------------------------------


@_query("SELECT n_name || '.txt' AS name, length(n_name)::BIGINT AS bytes FROM nation")
def source_walk(spark, d):
    """Files below a folder: each nation's name is written to one, then the folder is walked."""
    path = new_path(spark, "files")
    n = table(spark, d, "nation")
    n.select(F.col("n_name").alias("value"), F.concat("n_name", F.lit(".txt")).alias("file")).repartition("file").write.partitionBy("file").option("lineSep", "\u0000").text(path)
    w = files.walk(spark, path, "*.txt").where(F.col("length") > 0)
    return w.select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("name"), (F.col("length") - 1).alias("bytes"))


@_query("SELECT n_nationkey AS name, length(n_name)::BIGINT AS bytes FROM nation")
def source_ingest(spark, d):
    """Files copied into a landing folder."""
    path, landing = new_path(spark, "files"), new_path(spark, "landing")
    table(spark, d, "nation").select(F.col("n_name").alias("value"), "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").option("lineSep", "\u0000").text(path)
    w = files.ingest(spark, path, landing, "*.txt")
    return w.select(F.regexp_extract("path", "n_nationkey=([0-9]+)/", 1).cast("int").alias("name"), (F.col("bytes") - 1).alias("bytes"))


@_query("SELECT p_name AS name, p_type AS smiles FROM part")
def source_csv(spark, d):
    path = new_path(spark, "csv")
    table(spark, d, "part").select("p_name", "p_type").write.csv(path)
    return files.molecules(spark, path)


@_query("SELECT n_regionkey AS node, n_nationkey::BIGINT AS id FROM nation")
def source_json_leaves(spark, d):
    path = new_path(spark, "json")
    members = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.col("n_nationkey").cast("bigint")).alias("ids"))
    members.select(F.to_json(F.create_map(F.col("n_regionkey").cast("string"), "ids")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.leaves(spark, path)


@_query("SELECT label, count(*) AS n FROM embeddings WHERE label >= 5 GROUP BY 1")
def sink_search_fields(spark, d):
    """Inserted in two goes, then searched with a filter: each row that passes it is its own nearest."""
    c = Collection(spark, new_path(spark, "collection"))
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    c.insert(df.where("label < 7"))
    c.insert(df.where("label >= 7"))
    near = c.transact(df.where("label >= 5").withColumnRenamed("id", "query_id"), "search", limit=1, output_fields=("label",), filter="label >= 5")
    return near.where("query_id = id AND distance = 0").groupBy("label").agg(F.count("*").alias("n"))


@_query("SELECT 'embedding' AS field, 'dense' AS kind UNION ALL SELECT 'bits', 'binary' UNION ALL SELECT 'terms', 'sparse'")
def sink_introspection(spark, d):
    c = Collection(spark, new_path(spark, "collection"))
    df = table(spark, d, "embeddings")
    c.insert(df.select("vec_id", "embedding", F.transform("embedding", lambda x: x > 0).alias("bits"), F.create_map("label", F.lit(1.0)).alias("terms")))
    return spark.createDataFrame(sorted(c.fields().items()), "field string, kind string")


@_query("SELECT event_type AS type, count(*) AS insert_count FROM events GROUP BY 1")
def stream_ingest(spark, d):
    """A file stream of events, each batch inserted once."""
    path, at = new_path(spark, "stream"), new_path(spark, "checkpoint")
    source = new_path(spark, "events")
    e = table(spark, d, "events")
    e.repartition(4).write.parquet(source)
    ingest.insert(ingest.read(spark, source, e.schema, 2), path, at, lambda df: df.select("event_id", F.col("event_type").alias("type"))).awaitTermination()
    return insert_summary(ingest.inserted(spark, path))


@_query("SELECT doc_id, 'text' AS type, length(text)::DOUBLE AS v FROM documents")
def pandas_provider(spark, d):
    """A provider over Arrow batches agrees with the expression."""
    import numpy as np

    df = Z.vectorize(table(spark, d, "documents").select("doc_id", "text"), lambda: lambda x: np.array([[len(t)] for t in x], float), "text", "text", False)
    return df.select("doc_id", "type", F.col("vector")[0].alias("v"))


@_query("SELECT doc_id, 0.0::DOUBLE AS difference FROM documents")
def provider_equivalence(spark, d):
    """The hashed embedding by Arrow batches and as an expression: their greatest difference a document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    both = Z.vectorize(docs, Z.hashed_embedding(16), "text", "text", False).withColumn("e", Z.hashed_embedding_column(F.col("text"), 16))
    return both.select("doc_id", F.array_max(F.zip_with("vector", "e", lambda x, y: F.abs(x - y))).alias("difference"))


@_query(r"""
WITH g AS (SELECT p_partkey, unnest(list_transform(generate_series(1, length(p_type) - 2), lambda i: substr(p_type, i, 3))) AS g FROM part)
SELECT p_partkey, count(DISTINCT g) AS shingles FROM g GROUP BY 1""")
def molecule_shingles(spark, d):
    """What a fingerprint's bits stand for: the distinct shingles of a string."""
    return table(spark, d, "part").select("p_partkey", F.size(Z.shingles(F.col("p_type"))).cast("bigint").alias("shingles"))


@_query("""
WITH s AS (SELECT p_type, list_distinct(list_transform(generate_series(1, length(p_type) - 2), lambda i: ('0x' || substr(md5(substr(p_type, i, 3)), 1, 8))::BIGINT % 2048)) AS f FROM (SELECT DISTINCT p_type FROM part)),
d AS (SELECT a.p_type AS qt, b.p_type AS bt, len(list_intersect(a.f, b.f)) AS shared, len(a.f) + len(b.f) AS sum FROM s a CROSS JOIN s b),
r AS (SELECT q.p_partkey AS query_id, b.p_partkey AS id, round(1 - shared::DOUBLE / (sum - shared), 6) + 0.0 AS distance, b.p_type FROM part q JOIN d ON qt = q.p_type JOIN part b ON b.p_type = bt),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM r)
SELECT query_id, id, distance, rank, p_type FROM n WHERE rank <= 10""")
def molecule_fingerprint_search(spark, d):
    """Fingerprints of all parts, and for each part the nearest parts by Jaccard distance."""
    make = make_operator("vectorizer", "molecule", column="p_type")
    return S.search_all(table(spark, d, "part"), "p_type", lambda df: make(df).withColumn("vector", F.transform("vector", lambda b: b.cast("int"))), 10, "jaccard", "p_partkey")


# -- approximate search --------------------------------------------------------------------------------------------


@_query("SELECT t::INT AS tree, count(*) AS rows, count(DISTINCT vec_id) AS ids, true AS split FROM embeddings, generate_series(0, 3) g(t) GROUP BY t")
def ann_build(spark, d):
    """Rows that each tree's leaves hold, and whether there are several of fewer than 200 rows on the mean."""
    index = ann.build(_vectors(spark, d), n_trees=4)
    split = (F.countDistinct("node") > 1) & (F.count("*") / F.countDistinct("node") < 200)
    return index.leaves.groupBy("tree").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), split.alias("split"))


@_query("SELECT count(*) AS queries, 10 * count(*) AS neighbours, true AS enough FROM embeddings")
def ann_recall(spark, d):
    """Of all exact neighbours of all rows the index finds 90 % at least."""
    df = _vectors(spark, d)
    q = df.withColumnRenamed("id", "query_id")
    found = ann.build(df, n_trees=8, spill=0.15).search(q).select("query_id", "id", F.lit(1).alias("hit"))
    exact = S.search(df, q, 10, "squared_l2").select("query_id", "id")
    return exact.join(found, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@_query()
def ann_search(spark, d):
    """Saved, loaded and searched with every row as a query; overlapping leaves."""
    df = _vectors(spark, d)
    index = ann.build(df, n_trees=8, spill=0.15).save(new_path(spark, "index"))
    return index.search(df.withColumnRenamed("id", "query_id"))


@_query("SELECT label::VARCHAR AS label, k::INT AS cluster, CASE k WHEN 0 THEN n - n // 2 ELSE n // 2 END AS rows FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), generate_series(0, 1) t(k)")
def gkmeans_fit(spark, d):
    """Halves of each label's rows; SQL knows their sizes."""
    return ann.gkmeans(_vectors(spark, d), "label").select("label", "cluster", "rows")


@_query(r"""
WITH f AS (SELECT doc_id, length(text) AS a, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS b, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS c, length(regexp_replace(text, '[^0-9]', '', 'g')) AS e FROM documents)
SELECT doc_id, [0.5 * a + b + 0.25 * e + 1, -1.0 * a + c + 2 * e - 1]::DOUBLE[] AS vector FROM f""")
def onnx_provider(spark, d):
    """An ONNX model made here (a linear layer) over features of each text."""
    from vectide.operators.onnx_model import linear

    make = Z.onnx(linear([[0.5, -1.0], [1.0, 0.0], [0.0, 1.0], [0.25, 2.0]], [1.0, -1.0]))

    def provider():
        session = make()
        return lambda texts: session(Z.text_features(texts))

    return Z.vectorize(table(spark, d, "documents").select("doc_id", "text"), provider, "text", "text", False).select("doc_id", "vector")
