"""Jobs on manifests, requests and catalogues: JSON columns in, rows out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYER = "struct<id: string, title: string, dtype: string, unit: string, quantization: string, source: string>"
MANIFEST = f"schema string, name string, ordering string, minOrder double, maxOrder double, nside double, tileShift double, tileSize double, body string, layers array<{LAYER}>"
DTYPES = ("float32", "uint16", "int16")
VIEW = {"mode": "sphere", "scale": "linear", "colormap": "viridis"}


def parse_layer_request(df: DataFrame, request: str = "request") -> DataFrame:
    """Adds layer and selectors (map) of `layer?name=value&name=value`; names and values are URL-decoded.

    The first `?` and the first `=` part; of a repeated name the last value counts; a name without `=` has an empty value;
    what cannot be decoded stays as it is.
    """
    after = lambda c, mark: F.when(F.contains(c, F.lit(mark)), F.substring(c, F.length(F.substring_index(c, mark, 1)) + 2, F.length(c))).otherwise("")
    plain = lambda c: F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))
    pairs = F.filter(F.split(after(F.col(request), "?"), "&"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(after(p, "=")).alias("v")))
    df = df.withColumns({"layer": F.substring_index(request, "?", 1), "__e": entries})
    later = lambda e, i: F.exists(F.slice("__e", i + 2, F.size("__e")), lambda o: o["k"] == e["k"])
    return df.withColumn("selectors", F.map_from_entries(F.filter("__e", lambda e, i: ~later(e, i)))).drop("__e")


def build_layer_request(df: DataFrame, names: list[str], defaults: dict[str, str]) -> DataFrame:
    """Adds request: layer?name=value in the order of names, defaults where a selector is absent."""
    parts = [F.concat(F.lit(f"{n}="), F.url_encode(F.coalesce(F.try_element_at("selectors", F.lit(n)), F.lit(defaults[n])))) for n in names]
    return df.withColumn("request", F.concat(F.col("layer"), F.lit("?"), F.concat_ws("&", *parts)) if parts else F.col("layer"))


def manifest_layers(df: DataFrame, text: str = "manifest") -> DataFrame:
    """One row per layer: dataset, max_order, tile_size, layer, title (id where missing), dtype, unit."""
    m = F.from_json(text, MANIFEST)
    rows = df.select(m["name"].alias("dataset"), m["maxOrder"].cast("int").alias("max_order"), m["tileSize"].cast("int").alias("tile_size"), F.explode(m["layers"]).alias("l"))
    return rows.select("dataset", "max_order", "tile_size", F.col("l.id").alias("layer"), F.coalesce("l.title", "l.id").alias("title"), F.col("l.dtype").alias("dtype"), F.col("l.unit").alias("unit"))


def manifest_rules(text: str = "manifest") -> list[tuple[str, Column]]:
    """(rule, holds) over a JSON column."""
    m = F.from_json(text, MANIFEST)
    whole = lambda c: m[c].isNotNull() & (m[c] > 0) & (m[c] == F.floor(m[c]))
    every = lambda test: F.coalesce(F.forall(m["layers"], test), F.lit(True))
    get = lambda x, path: F.get_json_object(x, path)
    radius = get(m["body"], "$.radiusKm")
    live = lambda l: get(l["source"], "$.type") == "zarr-tile"
    yes = lambda c: F.coalesce(c, F.lit(False))
    return [
        ("json", yes(m["schema"].isNotNull() | m["layers"].isNotNull() | m["name"].isNotNull())),
        ("schema", yes(m["schema"] == "hpxmap-v1")),
        ("ordering", yes(m["ordering"] == "nested")),
        *[(c, yes(whole(c))) for c in ("maxOrder", "nside", "tileShift", "tileSize")],
        ("nside is 2^maxOrder", yes(m["nside"] == F.pow(F.lit(2.0), m["maxOrder"]))),
        ("tileSize is 2^tileShift", yes(m["tileSize"] == F.pow(F.lit(2.0), m["tileShift"]))),
        ("layers", yes(F.size(m["layers"]) > 0)),
        ("radius", radius.isNull() | yes(F.try_to_number(radius, F.lit("9999999999.999999")) > 0)),
        ("layer id", every(lambda l: l["id"].isNotNull() & (l["id"] != ""))),
        ("layer source", every(lambda l: yes(F.when(live(l), F.length(get(l["source"], "$.zarr")) > 0).otherwise(F.length(get(l["source"], "$.template")) > 0)))),
        ("layer dtype", every(lambda l: yes(l["dtype"].isin(*DTYPES)))),
        ("layer quantization", every(lambda l: (~yes(l["dtype"].isin("uint16", "int16"))) | l["quantization"].isNotNull())),
        ("layer selectors", every(lambda l: ~yes(live(l)) | get(l["source"], "$.selectors").isNull() | F.startswith(get(l["source"], "$.selectors"), F.lit("{")))),
    ]


def manifest_check(df: DataFrame, text: str = "manifest") -> DataFrame:
    """One row per broken rule; all other columns are kept."""
    broken = F.filter(F.array(*[F.when(~ok, F.lit(rule)) for rule, ok in manifest_rules(text)]), lambda r: r.isNotNull())
    return df.withColumn("rule", F.explode(broken)).drop(text)


def selector_options(df: DataFrame, text: str = "source") -> DataFrame:
    """One row per option of each selector of a layer source: selector, label, position, value, option_label, is_default.

    Selectors are lists, or objects with values, label and default; options are plain or objects with value (or id) and
    label (or title). The default is source.select's, else the selector's, else the first, where it is among the values.
    """
    raw = F.from_json(F.get_json_object(text, "$.selectors"), "map<string, string>")
    chosen = F.from_json(F.get_json_object(text, "$.select"), "map<string, string>")
    rows = df.select(*[c for c in df.columns if c != text], F.explode(raw).alias("selector", "spec"), chosen.alias("chosen"))
    listed = F.startswith(F.col("spec"), F.lit("["))
    values = F.from_json(F.when(listed, F.col("spec")).otherwise(F.get_json_object("spec", "$.values")), "array<string>")
    label = F.when(listed, None).otherwise(F.get_json_object("spec", "$.label"))
    first = F.concat(F.upper(F.substring("selector", 1, 1)), F.substring("selector", 2, 10_000))
    wanted = F.coalesce(F.try_element_at("chosen", F.col("selector")), F.when(listed, None).otherwise(F.get_json_object("spec", "$.default")))
    rows = rows.withColumns({"label": F.coalesce(label, first), "wanted": wanted, "v": values})
    thing = lambda o: F.startswith(o, F.lit("{"))
    value = lambda o, i: F.when(thing(o), F.coalesce(F.get_json_object(o, "$.value"), F.get_json_object(o, "$.id"), i.cast("string"))).otherwise(o)
    named = lambda o, i: F.when(thing(o), F.coalesce(F.get_json_object(o, "$.label"), F.get_json_object(o, "$.title"), value(o, i))).otherwise(o)
    rows = rows.withColumn("o", F.transform("v", lambda o, i: F.struct(value(o, i).alias("value"), named(o, i).alias("option_label"))))
    default = F.when(F.exists("o", lambda o: o["value"] == F.col("wanted")), F.col("wanted")).otherwise(F.element_at("o", 1)["value"])
    rows = rows.withColumn("default", default)
    keep = [c for c in df.columns if c != text]
    out = rows.select(*keep, "selector", "label", "default", F.posexplode("o").alias("position", "opt"))
    return out.select(*keep, "selector", "label", "position", F.col("opt.value").alias("value"), F.col("opt.option_label").alias("option_label"), (F.col("opt.value") == F.col("default")).alias("is_default"))


def selector_filter(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """requests (request_id, selector, value) with `chosen`: the value if allowed, else the selector's default.

    allowed: (selector, value, is_default); one default each.
    """
    known = allowed.select("selector", F.col("value"), F.lit(True).alias("__ok"))
    defaults = allowed.where("is_default").groupBy("selector").agg(F.min("value").alias("__default"))
    out = requests.join(known, ["selector", "value"], "left").join(defaults, "selector")
    return out.withColumn("chosen", F.when(F.col("__ok"), F.col("value")).otherwise(F.col("__default"))).drop("__ok", "__default")


def slice_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds fingerprint: 16 hex digits of the SHA-256 of one canonical JSON (keys sorted, no spaces, absent values null)."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return df.withColumn("fingerprint", F.substring(F.sha2(body, 256), 1, 16))


def write_manifest(
    stats: DataFrame, name: str, coarsest: int, finest: int, tile_shift: int, dtype: str = "float32", radius_km: float | None = None,
    quantization: dict | None = None, unit: str = "", titles: dict[str, str] | None = None, view: dict[str, str] | None = None,
) -> DataFrame:
    """(manifest): JSON with orders, layers, statistics, sources and the default view from rows (layer, min, max, p1, p99).

    quantization: scale, offset and nodata as quantize_layer gives them, which integer layers need. titles: by layer, else
    its id. view: mode, scale and colormap of the default view, which shows the first layer at the finest order.
    """
    if dtype not in DTYPES:
        raise ValueError(f"dtype must be one of {DTYPES}")
    if (dtype != "float32") != (quantization is not None):
        raise ValueError("integer layers need a quantization, others have none")
    titled = reduce(lambda c, t: c.when(F.col("layer") == t[0], F.lit(t[1])), (titles or {}).items(), F.when(F.lit(False), F.col("layer"))).otherwise(F.col("layer"))
    coded = [F.struct(F.lit(float(quantization["scale"])).alias("scale"), F.lit(float(quantization["offset"])).alias("offset"), F.lit(int(quantization["nodata"])).alias("nodata")).alias("quantization")] if quantization else []
    source = F.struct(F.lit("directory").alias("type"), F.concat(F.lit("layers/"), F.col("layer"), F.lit("/{order}/{face}/{x}/{y}.bin")).alias("template"))
    layer = F.struct(F.col("layer").alias("id"), titled.alias("title"), F.lit("scalar").alias("kind"), F.lit(dtype).alias("dtype"), F.lit(unit).alias("unit"), *coded, F.struct("min", "max", "p1", "p99").alias("stats"), source.alias("source"))
    one = stats.agg(F.sort_array(F.collect_list(layer)).alias("layers"))
    fields = [
        F.lit("hpxmap-v1").alias("schema"), F.lit(name).alias("name"), F.lit("nested").alias("ordering"), F.lit(coarsest).alias("minOrder"), F.lit(finest).alias("maxOrder"),
        F.lit(1 << finest).alias("nside"), F.lit(tile_shift).alias("tileShift"), F.lit(1 << tile_shift).alias("tileSize"), F.lit("face-local-row-major").alias("tileLayout"), F.col("layers"),
        F.struct(*[F.lit((view or {}).get(k, v)).alias(k) for k, v in VIEW.items()], F.element_at("layers", 1)["id"].alias("layer"), F.lit(finest).alias("order")).alias("defaultView"),
    ]
    if radius_km is not None:
        if radius_km <= 0:
            raise ValueError("the radius must be positive")
        fields.append(F.struct(F.lit(radius_km).alias("radiusKm")).alias("body"))
    return one.select(F.to_json(F.struct(*fields)).alias("manifest"))


def register_dataset(catalogue: DataFrame, entries: DataFrame, default: bool = False) -> DataFrame:
    """catalogue (id, title, manifest, is_default) with entries (id, title, manifest) put in by id.

    Entries without id or manifest are rejected; of repeated ids the smallest row counts. The first entry by id becomes
    the default if asked, or if the catalogue has none. Where the catalogue has a column position, the entries put in
    come after all others, in the order of their ids (a catalogue is small: they are numbered in one task).
    """
    good = entries.where("id is not null and id <> '' and manifest is not null and manifest <> ''").groupBy("id").agg(F.min(F.struct("title", "manifest")).alias("m")).select("id", "m.*")
    ordered = "position" in catalogue.columns
    kept = catalogue.join(good, "id", "left_anti").select("id", "title", "manifest", *["position"] * ordered)
    if ordered:
        last = catalogue.agg(F.coalesce(F.max("position"), F.lit(0)).alias("last"))
        good = good.withColumn("position", F.row_number().over(Window.orderBy("id"))).crossJoin(F.broadcast(last)).withColumn("position", (F.col("position") + F.col("last")).cast("long")).drop("last")  # one row
    old = catalogue.where("is_default").agg(F.min("id").alias("old"))
    new = good.agg(F.min("id").alias("new"))
    wanted = old.crossJoin(new).select((F.coalesce("new", "old") if default else F.coalesce("old", "new")).alias("__d"))  # one row each
    return kept.unionByName(good).crossJoin(F.broadcast(wanted)).withColumn("is_default", F.coalesce(F.col("id") == F.col("__d"), F.lit(False))).drop("__d")
