"""Queries on manifests, requests and catalogues. Documents are built from the given tables, valid and broken ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import catalog as K
from . import fixtures as X
from .fixtures import sql
from .pyramids import _PLACED, placed_pyramid
from .registry import query

# One manifest for each supplier; s_suppkey % 9 says what is wrong with it (0, 7, 8: nothing). Written in SQL that both engines read.
_PARTS = """concat('{"schema":"', CASE WHEN k = 1 THEN 'other-v2' ELSE 'hpxmap-v1' END, '","name":"d', s_suppkey, '","ordering":"', CASE WHEN k = 2 THEN 'ring' ELSE 'nested' END,
 '","minOrder":3,"maxOrder":', 5 + s_suppkey % 3, ',"nside":', CASE WHEN k = 3 THEN 48 ELSE CASE s_suppkey % 3 WHEN 0 THEN 32 WHEN 1 THEN 64 ELSE 128 END END, ',"tileShift":3,"tileSize":', CASE WHEN k = 4 THEN 9 ELSE 8 END,
 CASE WHEN k = 5 THEN ',"body":{"radiusKm":0}' WHEN k = 0 THEN ',"body":{"radiusKm":6371.5}' ELSE '' END,
 ',"layers":[{"id":"a', s_suppkey, '","title":"A","dtype":"', CASE WHEN k = 6 THEN 'uint16' ELSE 'float32' END, '","unit":"m","source":{"type":"directory","template":"t/{x}.bin"}},{"id":"b","dtype":"int16","quantization":{"scale":1},"source":{"type":"directory","template":"u"}}]}')"""
_MANIFESTS = f"SELECT s_suppkey, s_suppkey % 9 AS k, {_PARTS} AS manifest FROM (SELECT *, s_suppkey % 9 AS k FROM supplier)"


def manifests(spark, d):
    t = X.table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") % 9)
    return t.select("s_suppkey", "k", F.expr(_PARTS).alias("manifest"))


@query(
    "manifest_layers",
    """SELECT concat('d', s_suppkey) AS dataset, CAST(5 + s_suppkey % 3 AS INTEGER) AS max_order, CASE WHEN s_suppkey % 9 = 4 THEN 9 ELSE 8 END AS tile_size, CASE WHEN l = 0 THEN concat('a', s_suppkey) ELSE 'b' END AS layer,
 CASE WHEN l = 0 THEN 'A' ELSE 'b' END AS title, CASE WHEN l = 1 THEN 'int16' WHEN s_suppkey % 9 = 6 THEN 'uint16' ELSE 'float32' END AS dtype, CASE WHEN l = 0 THEN 'm' END AS unit FROM supplier, (VALUES (0), (1)) q(l)""",
)
def _(spark, d):
    return K.manifest_layers(manifests(spark, d))


@query(
    "manifest_check",
    """SELECT s_suppkey, CASE s_suppkey % 9 WHEN 1 THEN 'schema' WHEN 2 THEN 'ordering' WHEN 3 THEN 'nside is 2^maxOrder' WHEN 4 THEN 'tileSize is 2^tileShift' WHEN 5 THEN 'radius' WHEN 6 THEN 'layer quantization' END AS rule FROM supplier WHERE s_suppkey % 9 BETWEEN 1 AND 6""",
)
def _(spark, d):
    return K.manifest_check(manifests(spark, d)).select("s_suppkey", "rule")


_REQUEST = "concat('value', CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('?time=', event_id % 4, '&run%20name=', user_id % 3, '%2Fa') END)"


@query("parse_layer_request", """SELECT event_id, 'value' AS layer, CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(event_id % 4 AS VARCHAR) END AS "time", CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat(user_id % 3, '/a') END AS run FROM events""")
def _(spark, d):
    t = X.table(spark, d, "events").select("event_id", F.expr(_REQUEST).alias("request"))
    got = K.parse_layer_request(t)
    return got.select("event_id", "layer", F.try_element_at("selectors", F.lit("time")).alias("time"), F.try_element_at("selectors", F.lit("run name")).alias("run"))


_ODD = "concat('value', CASE event_id % 6 WHEN 0 THEN concat('?time=1&time=', user_id) WHEN 1 THEN '?time=b=c' WHEN 2 THEN '?time=x?y' WHEN 3 THEN '?time=%zz+1' WHEN 4 THEN '?time&run=1' ELSE '?=&&time=a%20b+c' END)"


@query("parse_layer_request_odd", """SELECT event_id, 'value' AS layer, CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'b=c' WHEN 2 THEN 'x?y' WHEN 3 THEN '%zz 1' WHEN 4 THEN '' ELSE 'a b c' END AS "time" FROM events""")
def _(spark, d):
    """Repeated names, marks within values, values that cannot be decoded, names without a value."""
    t = X.table(spark, d, "events").select("event_id", F.expr(_ODD).alias("request"))
    return K.parse_layer_request(t).select("event_id", "layer", F.try_element_at("selectors", F.lit("time")).alias("time"))


@query("build_layer_request", "SELECT event_id, concat('value?time=', CASE WHEN user_id % 5 = 0 THEN '0' ELSE CAST(event_id % 4 AS VARCHAR) END, '&level=1') AS request FROM events")
def _(spark, d):
    t = X.table(spark, d, "events").select("event_id", F.expr(_REQUEST).alias("request"))
    return K.build_layer_request(K.parse_layer_request(t), ["time", "level"], {"time": "0", "level": "1"}).select("event_id", "request")


# One layer source for each part: the selector time is a list or an object, its default comes from select, itself or the first value
_SOURCE = """concat('{"type":"zarr-tile","zarr":"z","selectors":{"time":', CASE WHEN p_partkey % 2 = 0 THEN concat('[', p_size, ',"b"]') ELSE concat('{"label":"When","default":"b","values":[{"value":', p_size, ',"label":"first"},{"id":"b"}]}') END, '}', CASE WHEN p_partkey % 3 = 0 THEN ',"select":{"time":"b"}' WHEN p_partkey % 3 = 1 THEN ',"select":{"time":"none"}' ELSE '' END, '}')"""


def options(spark, d):
    return K.selector_options(X.table(spark, d, "part").select("p_partkey", F.expr(_SOURCE).alias("source")))


_OPTIONS = """SELECT p_partkey, 'time' AS selector, CASE WHEN p_partkey % 2 = 0 THEN 'Time' ELSE 'When' END AS label, i AS position, CASE WHEN i = 0 THEN CAST(p_size AS VARCHAR) ELSE 'b' END AS value, CASE WHEN i = 1 THEN 'b' WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'first' END AS option_label,
 (i = 1) = (p_partkey % 3 = 0 OR (p_partkey % 3 = 2 AND p_partkey % 2 = 1)) AS is_default FROM part, (VALUES (0), (1)) q(i)"""


@query("selector_options", _OPTIONS)
def _(spark, d):
    return options(spark, d)


@query(
    "selector_filter",
    """SELECT event_id, selector, value, CASE WHEN value IN ('view', 'click') THEN value ELSE 'click' END AS chosen FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'kind' ELSE 'other' END AS selector, event_type AS value FROM events)""",
)
def _(spark, d):
    """Event types as selector values; view and click are allowed, click is the default."""
    t = X.table(spark, d, "events")
    requests = t.select("event_id", F.when(F.col("user_id") % 2 == 0, "kind").otherwise("other").alias("selector"), F.col("event_type").alias("value"))
    kinds = t.where("event_type IN ('view', 'click')").select("event_type").distinct()
    base = kinds.select(F.explode(F.array(F.lit("kind"), F.lit("other"))).alias("selector"), F.col("event_type").alias("value"))
    also = kinds.limit(1).select(F.explode(F.array(F.lit("kind"), F.lit("other"))).alias("selector"), F.lit("click").alias("value"))
    allowed = base.unionByName(also).distinct().withColumn("is_default", F.col("value") == "click")
    return K.selector_filter(requests, allowed).select("event_id", "selector", "value", "chosen")


@query("slice_fingerprint", """SELECT event_id, substring(sha256(concat('{"dataset":"d","layer":"', event_type, '","maxOrder":6,"time":', CASE WHEN user_id % 5 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) END, '}')), 1, 16) AS fingerprint FROM events""")
def _(spark, d):
    t = X.table(spark, d, "events").select("event_id", F.lit("d").alias("dataset"), F.col("event_type").alias("layer"), F.lit(6).alias("maxOrder"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("time"))
    return K.slice_fingerprint(t, ["dataset", "layer", "time", "maxOrder"]).select("event_id", "fingerprint")


@query("write_manifest", sql("particles", """SELECT 'hpxmap-v1' AS "schema", 6 AS max_order, 64 AS nside, 'price' AS layer, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high FROM placed WHERE NOT isnan(value)""", placed=_PLACED))
def _(spark, d):
    stats = A.layer_stats(placed_pyramid(spark, d)).withColumn("layer", F.lit("price"))
    text = K.write_manifest(stats.select("layer", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "p1", "p99"), "prices", 5, 6, 3, radius_km=6371.0)
    get = lambda p: F.get_json_object("manifest", p)
    return text.select(get("$.schema").alias("schema"), get("$.maxOrder").cast("int").alias("max_order"), get("$.nside").cast("int").alias("nside"), get("$.layers[0].id").alias("layer"), get("$.layers[0].stats.min").cast("double").alias("low"), get("$.layers[0].stats.max").cast("double").alias("high"))


@query(
    "register_dataset",
    """WITH new AS (SELECT c_name AS id, min(concat('t', c_nationkey)) AS title, min(concat('m', c_custkey, '.json')) AS manifest FROM customer WHERE c_custkey % 4 <> 3 GROUP BY 1),
 old AS (SELECT c_name AS id, 'old' AS title, 'old.json' AS manifest, c_custkey = 3 AS is_default FROM customer WHERE c_custkey % 2 = 1)
 SELECT *, coalesce(id = (SELECT coalesce(min(id) FILTER (is_default), (SELECT min(id) FROM new)) FROM old), false) AS is_default FROM (SELECT id, title, manifest FROM old ANTI JOIN new USING (id) UNION ALL SELECT * FROM new)""",
)
def _(spark, d):
    t = X.table(spark, d, "customer")
    odd = t.where("c_custkey % 2 = 1").select(F.col("c_name").alias("id"), F.lit("old").alias("title"), F.lit("old.json").alias("manifest"), (F.col("c_custkey") == 3).alias("is_default"))
    new = t.select(F.col("c_name").alias("id"), F.concat(F.lit("t"), "c_nationkey").alias("title"), F.when(F.col("c_custkey") % 4 != 3, F.concat(F.lit("m"), "c_custkey", F.lit(".json"))).alias("manifest"))
    return K.register_dataset(odd, new)


@query(
    "register_dataset_position",
    """WITH new AS (SELECT c_name AS id FROM customer WHERE c_custkey % 4 = 1), old AS (SELECT c_name AS id, c_custkey AS position FROM customer WHERE c_custkey % 2 = 1)
 SELECT id, position FROM old ANTI JOIN new USING (id) UNION ALL SELECT id, row_number() OVER (ORDER BY id) + (SELECT max(position) FROM old) FROM new""",
)
def _(spark, d):
    """Entries put in again come after all others."""
    t = X.table(spark, d, "customer")
    old = t.where("c_custkey % 2 = 1").select(F.col("c_name").alias("id"), F.lit("t").alias("title"), F.lit("m.json").alias("manifest"), F.lit(False).alias("is_default"), F.col("c_custkey").alias("position"))
    new = t.where("c_custkey % 4 = 1").select(F.col("c_name").alias("id"), F.lit("t").alias("title"), F.lit("n.json").alias("manifest"))
    return K.register_dataset(old, new).select("id", "position")


@query("write_manifest_integer", sql("particles", """SELECT 'uint16' AS dtype, 'm' AS unit, round((max(value)::DOUBLE - min(value)::DOUBLE) / 65534, 9) AS scale, 65535 AS nodata, 'Price' AS title, 'price' AS shown, CAST(0 AS BIGINT) AS broken FROM placed WHERE NOT isnan(value)""", placed=_PLACED))
def _(spark, d):
    """An integer layer with its quantization; the manifest breaks no rule."""
    from ..operators.codec import quantize_layer

    cells = placed_pyramid(spark, d)
    _, q = quantize_layer(cells)
    stats = A.layer_stats(cells).withColumn("layer", F.lit("price")).select("layer", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "p1", "p99")
    text = K.write_manifest(stats, "prices", 5, 6, 3, "uint16", quantization=q, unit="m", titles={"price": "Price"}, view={"colormap": "magma"})
    get = lambda p: F.get_json_object("manifest", p)
    broken = F.size(F.filter(F.array(*[~ok for _, ok in K.manifest_rules()]), lambda x: x)).cast("long")
    first = "$.layers[0]"
    return text.select(get(f"{first}.dtype").alias("dtype"), get(f"{first}.unit").alias("unit"), F.round(get(f"{first}.quantization.scale").cast("double"), 9).alias("scale"), get(f"{first}.quantization.nodata").cast("int").alias("nodata"), get(f"{first}.title").alias("title"), get("$.defaultView.layer").alias("shown"), broken.alias("broken"))
