"""The registered queries: every operator applied to the driver's tables, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays, columns, images, pyramid
from tessera.operators import bags, files, graph, moments, samplers, stats, tiles
from tessera.plans.facade import create_batch_sampler
from tessera.session import table
from tessera.sources.fake import fake_dataset
from tessera.sources.pyramid import per_resolution, planned, read_regions, thumbnails, tissue_masks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


# ---- inputs: annotations, slides, images and bags made from the driver's tables ----

RECTANGLES = """rects as (select p_partkey as id, p_type as file_key, p_brand as label, (p_partkey*37)%1000 as x1, (p_partkey*53)%1000 as y1,
 (p_partkey*37)%1000 + p_size*20 as x2, (p_partkey*53)%1000 + p_size*15 as y2 from part)"""


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations: one rectangle a part, its type as file and its brand as label."""
    key, size = F.col("p_partkey"), F.col("p_size")
    x1, y1 = key * 37 % 1000, key * 53 % 1000
    return table(spark, sf_dir, "part").select(key.alias("id"), F.col("p_type").alias("file_key"), F.col("p_brand").alias("label"), x1.alias("x1"), y1.alias("y1"), (x1 + size * 20).alias("x2"), (y1 + size * 15).alias("y2"))


AREA = "(x2 - x1) * (y2 - y1)"


def area() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def labels_of(rects: DataFrame) -> DataFrame:
    """The label dimension: the labels there are, and one that no annotation has."""
    none = rects.sparkSession.createDataFrame([("Brand#none",)], "label string")
    return rects.select("label").distinct().unionByName(none)


LABELS = "labs as (select distinct label from rects union all select 'Brand#none')"
PIXELS = "list_transform(embedding, lambda v: (floor(abs(v::double) * 1000))::int % 256)"


def byte_pixels(column: str = "embedding") -> Column:
    """64 byte values from an embedding, an image of 8 x 8."""
    return F.transform(column, lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("int") % 256)


def byte_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", byte_pixels().alias("px"))


ROWS8 = "list_transform(range(0, 8), lambda i: px[i*8+1 : i*8+8])"
TEXT = "array_to_string(list_transform({}, lambda r: array_to_string(r, ',')), ';')"
IMAGES = f"im as (select vec_id as id, label, {PIXELS} as px from embeddings)"


def as_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r.cast("array<string>"), ",")), ";")


# ---- tiling ----

GRID = """grid as (select r.*, u.x, v.y from rects r, unnest(range(x1, x2, {step})) as u(x), unnest(range(y1, y2, {step})) as v(y)),
tiles as (select *, greatest(0, least(x + {size}, x2) - greatest(x, x1)) * greatest(0, least(y + {size}, y2) - greatest(y, y1)) as inter from grid)"""
TILES = f"with {RECTANGLES}, {GRID.format(step=96, size=128)}"


@query("t1_tile_rect", f"{TILES} select id, file_key, label, x, y, inter from tiles where inter >= 0.25*128*128")
def t1_tile_rect(spark, sf_dir):
    return tiles.tile_rectangles(rectangles(spark, sf_dir), 128, 32, 0.25, full_coverage=True).select("id", "file_key", "label", "x", "y", "inter")


@query("t1_tile_bbox", f"{TILES} select id, x, y from tiles")
def t1_tile_bbox(spark, sf_dir):
    return tiles.tile_rectangles(rectangles(spark, sf_dir), 128, 32).select("id", "x", "y")


@query("t1_tile_intersection", f"{TILES} select id, x, y, greatest(x, x1) as ix1, greatest(y, y1) as iy1, least(x + 128, x2) as ix2, least(y + 128, y2) as iy2 from tiles where inter > 0")
def t1_tile_intersection(spark, sf_dir):
    out = tiles.tile_rectangles(rectangles(spark, sf_dir), 128, 32, only_intersection=True)
    return out.select("id", "x", "y", "ix1", "iy1", "ix2", "iy2")


@query(
    "f5_unknown_labels",
    f"with {RECTANGLES}, {GRID.format(step=256, size=256)} select id, label, x, y from tiles where label in ('Brand#11', 'Brand#12', 'Brand#13') and inter >= 0.2*256*256 union all select id, label, null, null from rects where label not in ('Brand#11', 'Brand#12', 'Brand#13')",
)
def f5_unknown_labels(spark, sf_dir):
    out = tiles.tile_rectangles(rectangles(spark, sf_dir), 256, 0, 0.2, full_coverage=True, labels=["Brand#11", "Brand#12", "Brand#13"])
    return out.select("id", "label", "x", "y")


@query("w12_tile_centres", f"{TILES} select id, x, y, x + 64.0::double as cx, y + 64.0::double as cy from tiles where inter >= 0.2*128*128")
def w12_tile_centres(spark, sf_dir):
    out = tiles.with_centres(tiles.tile_rectangles(rectangles(spark, sf_dir), 128, 32, 0.2, full_coverage=True))
    return out.select("id", "x", "y", "cx", "cy")


def polygons_of(spark, sf_dir) -> DataFrame:
    """Right triangles in the rectangles' lower left."""
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(point("x1", "y1"), point("x2", "y1"), point("x1", "y2"))
    return rectangles(spark, sf_dir).select("id", "label", F.array(ring).alias("rings"))


@query("t1_tile_polygon")
def t1_tile_polygon(spark, sf_dir):
    return tiles.tile_polygons(polygons_of(spark, sf_dir), 128, 0, 0.2, full_coverage=True).select("id", "label", "x", "y", F.round("covered", 6).alias("covered"))


@query("t2_mask_rings")
def t2_mask_rings(spark, sf_dir):
    out = tiles.tile_polygons(polygons_of(spark, sf_dir), 128, 0, 0.2, full_coverage=True)
    return out.select("id", "x", "y", F.size("mask_rings").alias("n_rings"), F.transform("mask_rings", F.size).alias("n_points"))


# ---- counts and areas ----


@query("a1_annotation_count", f"with {RECTANGLES} select count(*)::bigint as n from rects")
def a1_annotation_count(spark, sf_dir):
    return stats.total(rectangles(spark, sf_dir), F.lit(1), "n")


@query("a2_per_label", f"with {RECTANGLES}, {LABELS} select l.label, count(r.id)::bigint as n from labs l left join rects r using (label) group by 1")
def a2_per_label(spark, sf_dir):
    rects = rectangles(spark, sf_dir)
    return stats.per(rects, ["label"], labels_of(rects), F.lit(1), "n")


@query("a3_per_key", f"with {RECTANGLES} select file_key, count(*)::bigint as n from rects group by 1 union all select 'NO FILE', 0")
def a3_per_key(spark, sf_dir):
    rects = rectangles(spark, sf_dir)
    all_files = rects.select("file_key").distinct().unionByName(spark.createDataFrame([("NO FILE",)], "file_key string"))
    return stats.per(rects, ["file_key"], all_files, F.lit(1), "n")


def _per_label_and_key(spark, sf_dir, value, name):
    rects = rectangles(spark, sf_dir)
    return stats.per(rects, ["file_key", "label"], stats.grid(labels_of(rects), rects.select("file_key")), value, name)


CELLS = f"with {RECTANGLES}, {LABELS}, keys as (select distinct file_key from rects) select k.file_key, l.label, {{}} from keys k cross join labs l left join rects r on r.file_key = k.file_key and r.label = l.label group by 1, 2"


@query("a4_per_label_per_key", CELLS.format("count(r.id)::bigint as n"))
def a4_per_label_per_key(spark, sf_dir):
    return _per_label_and_key(spark, sf_dir, F.lit(1), "n")


@query("a5_pixels", f"with {RECTANGLES} select sum({AREA})::bigint as pixels from rects")
def a5_pixels(spark, sf_dir):
    return stats.total(rectangles(spark, sf_dir), area(), "pixels")


@query("a6_pixels_per_label", f"with {RECTANGLES}, {LABELS} select l.label, coalesce(sum({AREA}), 0)::bigint as pixels from labs l left join rects r using (label) group by 1")
def a6_pixels_per_label(spark, sf_dir):
    rects = rectangles(spark, sf_dir)
    return stats.per(rects, ["label"], labels_of(rects), area(), "pixels")


@query("a7_pixels_per_key", f"with {RECTANGLES} select file_key, sum({AREA})::bigint as pixels from rects group by 1")
def a7_pixels_per_key(spark, sf_dir):
    rects = rectangles(spark, sf_dir)
    return stats.per(rects, ["file_key"], rects.select("file_key"), area(), "pixels")


@query("a8_pixels_per_label_per_key", CELLS.format(f"coalesce(sum({AREA}), 0)::bigint as pixels"))
def a8_pixels_per_label_per_key(spark, sf_dir):
    return _per_label_and_key(spark, sf_dir, area(), "pixels")


@query("j8_zero_grid", f"with {RECTANGLES}, {LABELS} select k.file_key, l.label from (select distinct file_key from rects) k cross join labs l")
def j8_zero_grid(spark, sf_dir):
    rects = rectangles(spark, sf_dir)
    return stats.grid(labels_of(rects), rects.select("file_key")).select("file_key", "label")


@query("a9_labels", f"with {RECTANGLES} select distinct label from rects")
def a9_labels(spark, sf_dir):
    return rectangles(spark, sf_dir).select("label").distinct()


@query("a10_references", f"with {RECTANGLES} select label, file_key, id, (row_number() over (partition by label order by file_key, id) - 1)::bigint as rank from rects")
def a10_references(spark, sf_dir):
    from tessera.operators.ranking import rank_within

    return rank_within(rectangles(spark, sf_dir).select("label", "file_key", "id"), ["label"], ["file_key", "id"])


@query("j2_reference_lookup", f"with {RECTANGLES}, ranked as (select *, row_number() over (partition by label order by file_key, id) - 1 as rank from rects) select label, rank::bigint as rank, file_key, id, x1, y1 from ranked where rank < 5")
def j2_reference_lookup(spark, sf_dir):
    wanted = rectangles(spark, sf_dir).select("label").distinct().withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    found = a10_references(spark, sf_dir).join(F.broadcast(wanted), ["label", "rank"])
    return found.join(rectangles(spark, sf_dir).select("id", "x1", "y1"), "id").select("label", "rank", "file_key", "id", "x1", "y1")


# ---- bags and labels ----


def slides(spark, sf_dir) -> DataFrame:
    """documents as slides; labels cover some of them."""
    names = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("slide_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("slide_name"), "source", "n_chars")
    return names.join(table(spark, sf_dir, "labels"), "doc_id", "left")


SLIDES = "slides as (select d.doc_id, 'slide_' || lpad(d.doc_id::varchar, 12, '0') as slide_name, d.source, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id))"


@query("e1_label_default", f"with {SLIDES} select slide_name, coalesce(quality - 1, -100)::int as labels, coalesce(toxic, -100)::int as labels_group from slides")
def e1_label_default(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_name", columns.rebased_label("quality", 1).alias("labels"), columns.group_label("toxic").alias("labels_group"))


@query("s3_slide_index", f"with {SLIDES} select slide_name, (row_number() over (order by slide_name) - 1)::bigint as \"index\" from slides")
def s3_slide_index(spark, sf_dir):
    return bags.slide_index(slides(spark, sf_dir).select("slide_name"))


def instances(spark, sf_dir) -> DataFrame:
    """Embeddings as instances of the bags of their labels, at two resolutions; every third instance has no coordinates."""
    own = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("bag_"), F.col("label").cast("string")).alias("slide_name"), F.col("vec_id").alias("instance"), F.slice("embedding", 1, 4).alias("target"), F.slice("embedding", 5, 4).alias("context"))
    x = F.when(F.col("instance") % 3 != 0, F.col("instance") % 100).cast("float")
    long = own.select("slide_name", "instance", F.explode(F.array(F.struct(F.lit("features_target").alias("resolution"), F.col("target").alias("vec")), F.struct(F.lit("context").alias("resolution"), F.col("context").alias("vec")))).alias("p"), x.alias("coords_x"), (x * 2).alias("coords_y"))
    return long.select("slide_name", "instance", "p.resolution", "p.vec", "coords_x", "coords_y")


def bag_slides(spark, sf_dir) -> DataFrame:
    """A label, a survival time and an event for the bags; bag 7 has none."""
    own = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("bag_"), F.col("label").cast("string")).alias("slide_name"), F.col("label").alias("n")).distinct()
    return own.select("slide_name", F.when(F.col("n") < 7, F.col("n")).alias("labels"), (F.col("n") * 10.5).alias("survtime"), (F.col("n") % 2).alias("event"))


@query(
    "s4_read_bags",
    """select 'bag_' || label as slide_name, r.res as resolution, vec_id as instance, round(list_sum(list_transform(case when r.res = 'features' then embedding[1:4] else embedding[5:8] end, lambda v: v::double)), 6) as vec_sum,
 case when label < 7 then label - 1 else -100 end::int as labels, -100 as labels_group, (case when vec_id % 3 <> 0 then vec_id % 100 else -1 end)::double as x, (case when vec_id % 3 <> 0 then (vec_id % 100) * 2 else -1 end)::double as y,
 (label * 10.5)::double as survtime, (label % 2)::int as event from embeddings, (values ('features'), ('context')) as r(res)""",
)
def s4_read_bags(spark, sf_dir):
    out = bags.read_bags(bag_slides(spark, sf_dir), instances(spark, sf_dir), ["features_target", "context"], base_label=1, survival=True)
    total = F.round(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double")), 6)
    return out.select("slide_name", "resolution", "instance", total.alias("vec_sum"), "labels", "labels_group", F.col("coords.x").cast("double").alias("x"), F.col("coords.y").cast("double").alias("y"), "survtime", F.col("event").cast("int").alias("event"))


@query("e4_default_point", "select 'bag_' || label as slide_name, (vec_id % 100)::double as x, ((vec_id % 100) * 2)::double as y from embeddings where vec_id % 3 <> 0 and label <> 0 union all select 'bag_0', -1.0::double, -1.0::double")
def e4_default_point(spark, sf_dir):
    own = instances(spark, sf_dir).where("resolution = 'context'")
    own = own.withColumns({c: F.when(F.col("slide_name") != "bag_0", F.col(c)) for c in ("coords_x", "coords_y")})
    return bags.with_default_point(own).select("slide_name", F.col("coords.x").cast("double").alias("x"), F.col("coords.y").cast("double").alias("y"))


@query("s5_by_name", "select 'bag_3' as slide_name, vec_id as instance from embeddings where label = 3")
def s5_by_name(spark, sf_dir):
    return bags.by_name(instances(spark, sf_dir).where("resolution = 'context'"), "bag_3").select("slide_name", "instance")


@query("s6_by_index", f"with {SLIDES}, i as (select slide_name, row_number() over (order by slide_name) - 1 as \"index\" from slides) select slide_name, \"index\"::bigint as \"index\" from i where \"index\" = 17")
def s6_by_index(spark, sf_dir):
    return bags.by_index(s3_slide_index(spark, sf_dir), 17)


@query("s7_regex_columns", "select p_partkey, p_size, p_retailprice from part")
def s7_regex_columns(spark, sf_dir):
    return bags.select_by_regex(table(spark, sf_dir, "part"), "^p_(size|retail)", keep=["p_partkey"])


@query("s8_item", "select p_partkey, p_size from part where p_partkey = 42")
def s8_item(spark, sf_dir):
    return bags.select_by_regex(table(spark, sf_dir, "part"), "^p_size", keep=["p_partkey"]).where("p_partkey = 42")


@query("s10_long_form", f"with {IMAGES} select id, r.res as resolution, list_sum(case when r.res = 'target' then px[1:32] else px[33:64] end)::bigint as total from im, (values ('target'), ('context')) as r(res)")
def s10_long_form(spark, sf_dir):
    wide = byte_images(spark, sf_dir).select("id", F.slice("px", 1, 32).alias("a"), F.slice("px", 33, 32).alias("b"))
    out = bags.long_form(wide, "id", {"target": "a", "context": "b"})
    return out.select("id", "resolution", F.aggregate("images", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("j3_label_fallback", f"with {IMAGES}, labs as (select vec_id, label from embeddings where vec_id % 2 = 0 or vec_id = 0) select id as \"index\", coalesce(l.label, (select label from labs where vec_id = 0))::int as label from im left join labs l on l.vec_id = im.id")
def j3_label_fallback(spark, sf_dir):
    some = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("index"), "label")
    return bags.labelled_images(byte_images(spark, sf_dir).select(F.col("id").alias("index"), F.col("px").alias("images")), some).select("index", F.col("label").cast("int").alias("label"))


@query("s11_items", f"with {IMAGES} select id, label::int as label, {TEXT.format(ROWS8)} as image, round(list_sum(list_transform(px, lambda v: v::double / 255.0)), 6) as scaled from im")
def s11_items(spark, sf_dir):
    own = byte_images(spark, sf_dir)
    scaled = F.round(F.aggregate(arrays.scaled(F.col("px")), F.lit(0.0), lambda a, v: a + v), 6)
    return own.select("id", F.col("label").cast("int").alias("label"), as_text(arrays.rows_of(F.col("px"), 8)).alias("image"), scaled.alias("scaled"))


@query("s12_image_only", f"with {IMAGES} select id, {TEXT.format(ROWS8)} as image from im")
def s12_image_only(spark, sf_dir):
    return s11_items(spark, sf_dir).select("id", "image")


@query("s12_classification", "select vec_id as id, label::int as label from embeddings")
def s12_classification(spark, sf_dir):
    return s11_items(spark, sf_dir).select("id", "label")


@query("s12_segmentation", f"with {IMAGES} select id, len(list_filter(px, lambda v: v > 127))::int as positive from im")
def s12_segmentation(spark, sf_dir):
    mask = F.transform(arrays.with_channel(arrays.rows_of(F.col("px"), 8)), lambda r: F.transform(r, lambda v: (v[0] > 127).cast("int")))
    return byte_images(spark, sf_dir).select("id", F.aggregate(F.flatten(mask), F.lit(0), lambda a, v: a + v).alias("positive"))


@query("a11_first_labels", f"with {SLIDES} select slide_name, quality::int as label from slides where quality is not null")
def a11_first_labels(spark, sf_dir):
    return slides(spark, sf_dir).where("quality is not null").select("slide_name", F.col("quality").cast("int").alias("label"))


@query("a12_label_distribution", "select label, count(*)::bigint as n from embeddings group by 1 order by 1")
def a12_label_distribution(spark, sf_dir):
    return stats.label_distribution(table(spark, sf_dir, "embeddings"), "label").orderBy("label")


@query("a13_joint_distribution", "select quality, toxic, count(*)::bigint as n from labels group by 1, 2 order by 1, 2")
def a13_joint_distribution(spark, sf_dir):
    return stats.label_distribution(table(spark, sf_dir, "labels"), "quality", "toxic").orderBy("quality", "toxic")


@query("a14_recoded_distribution", "select case quality when 0 then 'poor' when 1 then 'good' end as label, count(*)::bigint as n from labels group by 1")
def a14_recoded_distribution(spark, sf_dir):
    return stats.label_distribution(table(spark, sf_dir, "labels").select(columns.recoded("quality", {0: "poor", 1: "good"}).alias("label")), "label")


@query("a15_classification_distribution", "select label::int as label, count(*)::bigint as n from embeddings group by 1")
def a15_classification_distribution(spark, sf_dir):
    return stats.label_distribution(s12_classification(spark, sf_dir), "label")


@query("a16_n_groups", "select count(distinct toxic)::bigint as n_groups from labels")
def a16_n_groups(spark, sf_dir):
    return bags.number_of_groups(table(spark, sf_dir, "labels"), "toxic")


@query("a17_shape", "select count(distinct label)::bigint as n_slides, (2 * count(*))::bigint as n_instances, 4 as min_width, 4 as max_width from embeddings")
def a17_shape(spark, sf_dir):
    return bags.bag_shape(instances(spark, sf_dir))


@query("a20_class_weights", "select vec_id, label, (1.0 / count(*) over (partition by label))::double as weight from embeddings")
def a20_class_weights(spark, sf_dir):
    return stats.class_weights(table(spark, sf_dir, "embeddings"), "label").select("vec_id", "label", "weight")


@query("j6_weight_lookup", "select label, round(sum(w), 9) as total from (select label, 1.0 / count(*) over (partition by label) as w from embeddings) group by 1")
def j6_weight_lookup(spark, sf_dir):
    return a20_class_weights(spark, sf_dir).groupBy("label").agg(F.round(F.sum("weight"), 9).alias("total"))


# ---- moments ----

MOMENTS = f"""with {IMAGES}, p as (select id, unnest(px) as v, (generate_subscripts(px, 1) - 1) % 4 as channel from im),
per_image as (select id, channel, avg(v / 255.0::double) as m, avg((v / 255.0::double) * (v / 255.0::double)) as q from p group by 1, 2),
sums as (select channel::int as channel, sum(m) as s, sum(q) as q, count(*)::bigint as n from per_image group by 1)"""


def _channel_sums(spark, sf_dir) -> DataFrame:
    px = byte_images(spark, sf_dir).select(F.col("id").alias("image"), F.posexplode("px").alias("at", "value"))
    return moments.channel_sums(px.withColumn("channel", F.col("at") % 4))


@query("a18_channel_sums", f"{MOMENTS} select channel, round(s, 6) as s, round(q, 6) as q, n from sums")
def a18_channel_sums(spark, sf_dir):
    return _channel_sums(spark, sf_dir).select("channel", F.round("s", 6).alias("s"), F.round("q", 6).alias("q"), "n")


@query("a19_mean_and_std", f"{MOMENTS} select channel, round(s / n, 8) as mean, round(sqrt(q / n - (s / n) * (s / n)), 8) as std from sums")
def a19_mean_and_std(spark, sf_dir):
    out = moments.mean_and_std(_channel_sums(spark, sf_dir))
    return out.select("channel", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


# ---- samplers ----


def indices(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("index"))


def weak_sql(block: int, seed: int) -> str:
    return f"""idx as (select vec_id as "index", vec_id // {block} as blk from embeddings), n as (select count(*) as n from idx),
shuffled as (select "index", row_number() over (order by (blk >= n // {block}), case when blk >= n // {block} then '' else md5('{seed}-' || blk) end, blk, "index") - 1 as pos from idx, n)"""


@query("w1_weak_shuffle", f'with {weak_sql(32, 42)} select "index", pos::bigint as pos from shuffled')
def w1_weak_shuffle(spark, sf_dir):
    return samplers.weak_shuffle(indices(spark, sf_dir), 32)


@query("w2_weak_shuffle_epoch", f'with {weak_sql(32, 45)} select "index", pos::bigint as pos from shuffled')
def w2_weak_shuffle_epoch(spark, sf_dir):
    return samplers.weak_shuffle(indices(spark, sf_dir), 32, epoch=3)


@query("w3_batches", f'with {weak_sql(32, 42)} select "index", pos::bigint as pos, (pos // 130)::bigint as batch_id from shuffled')
def w3_batches(spark, sf_dir):
    return samplers.batches(w1_weak_shuffle(spark, sf_dir), 130)


@query("w3_batches_drop_last", f'with {weak_sql(32, 42)} select "index", pos::bigint as pos, (pos // 130)::bigint as batch_id from shuffled, n where pos // 130 < n // 130')
def w3_batches_drop_last(spark, sf_dir):
    return samplers.batches(w1_weak_shuffle(spark, sf_dir), 130, drop_last=True)


def slices_sql(block: int, size: int, ranks: int, drop: bool) -> str:
    share = f"case when n % {ranks} <> 0 then greatest(ceil((n - {ranks}) / {ranks}.0), 0) else n / {ranks} end" if drop else f"ceil(n / {ranks}.0)"
    keep = f"where pos // {size} < (select n from n) // {size}" if drop else ""
    return f"""with {weak_sql(block, 42)}, b as (select "index", pos, pos // {size} as batch_id from shuffled {keep}), bn as (select batch_id, count(*) as n, min(pos) as first from b group by 1),
sh as (select batch_id, n, first, ({share})::bigint as share from bn), q as (select sh.*, u.q from sh, unnest(range(0, share * {ranks})) as u(q))
select q.batch_id::bigint as batch_id, (q.q // share)::bigint as rank, (q.q % share)::bigint as slot, b."index" from q join b on b.batch_id = q.batch_id and b.pos = q.first + q.q % q.n"""


@query("w4_rank_slices", slices_sql(32, 130, 4, False))
def w4_rank_slices(spark, sf_dir):
    return samplers.rank_slices(w3_batches(spark, sf_dir), 4)


@query("w5_rank_slices_drop_last", slices_sql(32, 130, 4, True))
def w5_rank_slices_drop_last(spark, sf_dir):
    return samplers.rank_slices(w3_batches_drop_last(spark, sf_dir), 4, drop_last=True)


@query("w6_fast_loader", slices_sql(24, 72, 3, False))
def w6_fast_loader(spark, sf_dir):
    return samplers.fast_loader(indices(spark, sf_dir), 24, 3)


UNIFORM = "((('0x' || substr(md5('{seed}-' || {key}), 1, 8))::bigint)::double + 0.5) / 4294967296.0"


@query(
    "w7_weighted_draws",
    f"""with c as (select label, count(*) as n, row_number() over (order by label) - 1 as class from embeddings group by 1), k as (select count(*) as k from c),
r as (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as rank from embeddings),
d as (select range as draw, floor({UNIFORM.format(seed=42, key='range')} * k)::bigint as class, {UNIFORM.format(seed=43, key='range')} as u from range((select count(*) from embeddings)), k)
select d.draw::bigint as draw, r.vec_id, r.label from d join c using (class) join r on r.label = c.label and r.rank = floor(d.u * c.n)::bigint""",
)
def w7_weighted_draws(spark, sf_dir):
    return samplers.weighted_with_replacement(table(spark, sf_dir, "embeddings"), "vec_id", "label")


@query("w7_weighted_order", f"with c as (select label, count(*) as n from embeddings group by 1) select (row_number() over (order by -ln({UNIFORM.format(seed=42, key='vec_id')}) * n, vec_id) - 1)::bigint as draw, vec_id, e.label from embeddings e join c using (label)")
def w7_weighted_order(spark, sf_dir):
    return samplers.weighted_without_replacement(table(spark, sf_dir, "embeddings"), "vec_id", "label")


DRAWN = "d as (select vec_id, label, row_number() over (partition by label order by md5('123-' || vec_id), vec_id) - 1 as rank from embeddings)"


@query("w8_one_time_random", f"with {DRAWN} select vec_id, label, rank::bigint as rank from d")
def w8_one_time_random(spark, sf_dir):
    return samplers.one_time_random(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("w9_ordered_labels", "select (row_number() over (order by label, vec_id) - 1)::bigint as pos, label, (row_number() over (partition by label order by vec_id) - 1)::bigint as rank from embeddings")
def w9_ordered_labels(spark, sf_dir):
    return samplers.ordered_labels(table(spark, sf_dir, "embeddings"), "label")


@query("w10_ordered_annotations", "select vec_id, label, (row_number() over (partition by label order by vec_id) - 1)::bigint as rank from embeddings")
def w10_ordered_annotations(spark, sf_dir):
    return samplers.one_time_ordered(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")


BATCHES = f"with {DRAWN}, p as (select *, row_number() over (order by label, rank) - 1 as pos from d)"


@query("w11_batches", f"{BATCHES} select (pos // 32)::bigint as batch_id, pos::bigint as pos, label, vec_id from p")
def w11_batches(spark, sf_dir):
    return samplers.one_time_batches(table(spark, sf_dir, "embeddings"), "vec_id", "label", 32)


@query("w15_collate", f"{BATCHES} select (pos // 32)::bigint as batch_id, string_agg(vec_id, ',' order by pos) as ids, string_agg(label, ',' order by pos) as labels from p group by 1")
def w15_collate(spark, sf_dir):
    out = samplers.collated(w11_batches(spark, sf_dir), ["vec_id", "label"])
    return out.select("batch_id", F.array_join(F.col("vec_id").cast("array<string>"), ",").alias("ids"), F.array_join(F.col("label").cast("array<string>"), ",").alias("labels"))


@query("w13_natural_order", "select page_id, regexp_extract(url, '[0-9]+')::bigint as number from pages where regexp_extract(url, '[0-9]+') <> '' order by number, page_id")
def w13_natural_order(spark, sf_dir):
    number = F.regexp_extract("url", "[0-9]+", 0)
    return table(spark, sf_dir, "pages").withColumn("n", number).where("n <> ''").withColumn("key", columns.natural_key("n")).orderBy("key", "page_id").select("page_id", F.col("n").cast("long").alias("number"))


@query(
    "w14_batch_sampler",
    f"""with {RECTANGLES}, {GRID.format(step=192, size=256)}, t as (select *, lpad(id::varchar, 12, '0') || '/' || lpad(x::varchar, 9, '0') || '/' || lpad(y::varchar, 9, '0') as tile from tiles where label in ('Brand#11', 'Brand#21') and inter >= 0.2*256*256),
d as (select *, row_number() over (partition by label order by md5('123-' || tile), tile) - 1 as rank from t), p as (select *, row_number() over (order by label, rank) - 1 as pos from d)
select (pos // 16)::bigint as batch_id, pos::bigint as pos, label, file_key, tile, x + 128.0::double as cx, y + 128.0::double as cy from p""",
)
def w14_batch_sampler(spark, sf_dir):
    plan = create_batch_sampler(rectangles(spark, sf_dir), ["Brand#11", "Brand#21"], {"target": 0.5, "context": 2.0}, tile=256, stride_overlap=0.25, batch=16)
    return plan.samples.select("batch_id", "pos", "label", "file_key", "tile", "cx", "cy")


# ---- files and columns ----


@query("s2_path_filter", "select distinct url as path from pages where url is not null and not contains(url, 'spam') and (contains(url, '/en/') or contains(url, '.html'))")
def s2_path_filter(spark, sf_dir):
    return files.select_paths(table(spark, sf_dir, "pages"), "url", ["/en/", ".html"], ["spam"]).select("path")


@query("j1_associate", "select d.source, count(*)::bigint as n from documents d join labels l using (doc_id) group by 1")
def j1_associate(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_key"), "source")
    return files.associate(a, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_key"), "quality")).groupBy("source").agg(F.count("*").alias("n"))


def spacing_maps(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    pair = lambda k, v: [F.lit(k), v.cast("double")]
    return rows.withColumn("spacing", F.create_map(*pair("target", F.lit(0.5)), *pair("context", F.when(F.col("id") % 2 == 0, F.lit(2.0))), *pair("10x", F.when(F.col("id") % 3 == 0, F.lit(1.0)))))


@query("f6_present_spacings", "select s_suppkey as id, 1 + (s_suppkey % 2 = 0)::int + (s_suppkey % 3 = 0)::int as n from supplier")
def f6_present_spacings(spark, sf_dir):
    return spacing_maps(spark, sf_dir).select("id", F.size(columns.present_only("spacing")).alias("n"))


@query("f7_requested_keys", "select s_suppkey as id, 'target' as key, 0.5::double as value from supplier")
def f7_requested_keys(spark, sf_dir):
    kept = columns.requested_only("spacing", ["target", "graph"])
    return spacing_maps(spark, sf_dir).select("id", F.explode(kept).alias("key", "value"))


@query("f9_repeat_scalar", "select s_suppkey as id, (s_suppkey || ',' || s_suppkey || ',' || s_suppkey) as three, '7,8' as two from supplier")
def f9_repeat_scalar(spark, sf_dir):
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text(columns.repeated(F.col("s_suppkey"))).alias("three"), text(columns.repeated([7, 8])).alias("two"))


@query("f10_set_all", "select s_suppkey as id, 230 as a, 230 as b from supplier")
def f10_set_all(spark, sf_dir):
    return columns.set_all(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), ["a", "b"], 230)


# ---- resolution ----

LEVELS = "levels as (select * from (values (0, 0.25::double), (1, 1.0::double), (2, 4.0::double)) as t(level, spacing))"
REQUESTS = "req as (select s_suppkey as id, (0.05 + (s_suppkey % 200) * 0.05)::double as wanted from supplier)"
CHOSEN = f"""with {LEVELS}, {REQUESTS}, near as (select id, wanted, level, spacing, row_number() over (partition by id order by abs(spacing - wanted), level) as k from req, levels),
c as (select id, wanted, greatest(case when abs(spacing - wanted) > wanted * 0.3 and spacing > wanted then level - 1 else level end, 0) as level, abs(spacing - wanted) > wanted * 0.3 as rescale from near where k = 1),
r as (select c.*, l.spacing as real from c join levels l using (level))"""


def _requests(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("cast(0.05 + (s_suppkey % 200) * 0.05 as double)").alias("wanted"))
    return rows.withColumn("spacings", F.array(F.lit(0.25), F.lit(1.0), F.lit(4.0))).withColumn("c", pyramid.chosen_level(F.col("spacings"), F.col("wanted")))


@query("t3_level", f"{CHOSEN} select id, level::int as level, rescale from r")
def t3_level(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", F.col("c.level").alias("level"), F.col("c.rescale").alias("rescale"))


@query("t4_real_spacing", f"{CHOSEN} select id, real from r")
def t4_real_spacing(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", F.get("spacings", F.col("c.level")).alias("real"))


@query("t5_read_size", f"{CHOSEN} select id, case when not rescale then 512 when wanted / real > 1 then floor(512 * (wanted / real))::bigint end as size from r")
def t5_read_size(spark, sf_dir):
    real = F.get("spacings", F.col("c.level"))
    return _requests(spark, sf_dir).select("id", pyramid.read_size(F.lit(512), F.col("wanted"), real, F.col("c.rescale")).alias("size"))


@query("t9_mask_ratio", f"{CHOSEN} select id, (real / 0.25)::double as ratio from r")
def t9_mask_ratio(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", pyramid.mask_ratio(F.get("spacings", F.col("c.level")), F.get("spacings", F.lit(0))).alias("ratio"))


@query(
    "t8_details",
    """with d as (select s_suppkey as id, 512 as w, (1 << (s_suppkey % 5)::int) as target, 1 as fine from supplier), e as (select *, floor(w / (target / fine))::int as dw from d)
select id, case when dw > 0 and w % dw = 0 then (w // dw) * (w // dw) end::int as n, case when dw > 0 and w % dw = 0 then w // dw end::int as total_i from e""",
)
def t8_details(spark, sf_dir):
    target = F.expr("cast(power(2, s_suppkey % 5) as int)")
    d = pyramid.details(F.lit(512), F.lit(512), target, F.lit(1))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), d.alias("d")).select("id", "d.n", "d.total_i")


def _cells(spark, sf_dir) -> DataFrame:
    """A pyramid of one slide a supplier's nation: 4, 2 and 1 cells of 64 pixels across, grey by place."""
    keys = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file_key"), F.col("n_nationkey").alias("k"))
    places = spark.createDataFrame([(lv, r, c) for lv, n in ((0, 4), (1, 2), (2, 1)) for r in range(n) for c in range(n)], "level int, row long, col long")
    rows = keys.crossJoin(F.broadcast(places))
    value = (F.col("k") * 7 + F.col("level") * 50 + F.col("row") * 10 + F.col("col")) % 256
    data = F.unhex(F.repeat(F.lpad(F.hex(value), 2, "0"), 64 * 64))
    image = F.struct(F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    return rows.select("file_key", "level", "row", "col", image.alias("image"))


def _region_plan(spark, sf_dir) -> DataFrame:
    wanted = F.create_map(F.lit("target"), F.lit(0.25), F.lit("context"), F.lit(1.0), F.lit("wide"), F.lit(2.0))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("file_key"), (F.col("s_suppkey") * 13 % 256).alias("x"), (F.col("s_suppkey") * 29 % 256).alias("y"), F.lit(32).alias("width"), F.lit(32).alias("height"), wanted.alias("spacing"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file_key"), F.array(F.lit(0.25), F.lit(1.0), F.lit(4.0)).alias("spacings"))
    return planned(per_resolution(rows), known)


@query(
    "t10_region_plan",
    """with w as (select * from (values ('target', 0.25::double, 0, 0.25::double, false), ('context', 1.0::double, 1, 1.0::double, false), ('wide', 2.0::double, 1, 1.0::double, true)) as t(resolution, wanted, level, real, rescale))
select s_suppkey as request, resolution, level::int as level, (case when rescale then floor(32 * (wanted / real)) else 32 end)::bigint as read_width, (real / 0.25)::double as ratio, floor((s_suppkey * 13 % 256) / (real / 0.25) - floor((case when rescale then floor(32 * (wanted / real)) else 32 end) / 2))::bigint as "left" from supplier, w""",
)
def t10_region_plan(spark, sf_dir):
    return _region_plan(spark, sf_dir).select("request", "resolution", "level", "read_width", "ratio", F.col("left").cast("long").alias("left"))


@query("t6_read_regions")
def t6_read_regions(spark, sf_dir):
    out = read_regions(_region_plan(spark, sf_dir), _cells(spark, sf_dir), 64)
    return out.select("request", "resolution", "patch.height", "patch.width", F.sha2("patch.data", 256).alias("sha256"))


@query("t7_read_target")
def t7_read_target(spark, sf_dir):
    out = read_regions(_region_plan(spark, sf_dir).where("resolution = 'target'"), _cells(spark, sf_dir), 64)
    return out.select("request", "patch.height", "patch.width", F.sha2("patch.data", 256).alias("sha256"))


# ---- images ----


@query("t14_crop", f"with {IMAGES} select id, {TEXT.format('list_transform(range(2, 6), lambda i: px[i*8+2 : i*8+7])')} as image from im")
def t14_crop(spark, sf_dir):
    return byte_images(spark, sf_dir).select("id", as_text(arrays.cropped(arrays.rows_of(F.col("px"), 8), 4, 6)).alias("image"))


@query("t16_pad", f"with {IMAGES} select id, {TEXT.format('list_transform(range(0, 10), lambda i: case when i < 8 then list_concat(px[i*8+1 : i*8+8], [230, 230]) else list_transform(range(0, 10), lambda j: 230) end)')} as image from im")
def t16_pad(spark, sf_dir):
    return byte_images(spark, sf_dir).select("id", as_text(arrays.padded(arrays.rows_of(F.col("px"), 8), 10, 230)).alias("image"))


@query("g1_horizontal_flip", f"with {IMAGES} select id, {TEXT.format('list_transform(range(0, 8), lambda i: list_reverse(px[i*8+1 : i*8+8]))')} as image from im")
def g1_horizontal_flip(spark, sf_dir):
    return byte_images(spark, sf_dir).select("id", as_text(arrays.flipped(arrays.rows_of(F.col("px"), 8), True)).alias("image"))


@query("g2_vertical_flip", f"with {IMAGES} select id, {TEXT.format('list_reverse(list_transform(range(0, 8), lambda i: px[i*8+1 : i*8+8]))')} as image from im")
def g2_vertical_flip(spark, sf_dir):
    return byte_images(spark, sf_dir).select("id", as_text(arrays.flipped(arrays.rows_of(F.col("px"), 8), False)).alias("image"))


@query("g3_rotate_90", f"with {IMAGES} select id, {TEXT.format('list_transform(range(0, 8), lambda j: list_transform(range(0, 8), lambda i: px[i*8 + 8 - j]))')} as image from im")
def g3_rotate_90(spark, sf_dir):
    return byte_images(spark, sf_dir).select("id", as_text(arrays.rotated(arrays.rows_of(F.col("px"), 8), 1)).alias("image"))


@query("g4_transpose", f"with {IMAGES} select id, {TEXT.format('list_transform(range(0, 8), lambda j: list_transform(range(0, 8), lambda i: px[i*8 + j + 1]))')} as image from im")
def g4_transpose(spark, sf_dir):
    return byte_images(spark, sf_dir).select("id", as_text(arrays.transposed(arrays.rows_of(F.col("px"), 8))).alias("image"))


PAIRS = "list_transform(range(0, 32), lambda i: case when px[2*i+1] // 64 = 0 and px[2*i+2] // 64 = 0 then [230, 230] else [px[2*i+1] // 64, px[2*i+2] // 64] end)"


@query("g11_replace_background", f"with {IMAGES} select id, {TEXT.format(PAIRS)} as pixels from im")
def g11_replace_background(spark, sf_dir):
    pixels = arrays.rows_of(F.transform("px", lambda v: F.floor(v / F.lit(64)).cast("int")), 2)
    return byte_images(spark, sf_dir).select("id", as_text(arrays.replaced(pixels, [0, 0], [230, 230])).alias("pixels"))


@query("e9_scale", f"with {IMAGES} select id, round(list_sum(list_transform(px, lambda v: v::double / 255.0)), 8) as total from im")
def e9_scale(spark, sf_dir):
    return byte_images(spark, sf_dir).select("id", F.round(F.aggregate(arrays.scaled(F.col("px")), F.lit(0.0), lambda a, v: a + v), 8).alias("total"))


@query("e10_mask_channel", f"with {IMAGES} select id, 8 as height, 8 as width, 1 as channels, px[1]::int as first from im")
def e10_mask_channel(spark, sf_dir):
    mask = arrays.with_channel(arrays.rows_of(F.col("px"), 8))
    return byte_images(spark, sf_dir).select("id", mask.alias("m")).select("id", F.size("m").alias("height"), F.size(F.col("m")[0]).alias("width"), F.size(F.col("m")[0][0]).alias("channels"), F.col("m")[0][0][0].alias("first"))


@query("e11_channels_last", f"with {IMAGES} select id, {TEXT.format('list_transform(range(0, 16), lambda i: list_transform(range(0, 4), lambda c: px[c*16 + i + 1]))')} as pixels from im")
def e11_channels_last(spark, sf_dir):
    planes = F.transform(arrays.rows_of(F.col("px"), 16), lambda p: arrays.rows_of(p, 4))
    return byte_images(spark, sf_dir).select("id", as_text(F.flatten(arrays.channels_last(planes))).alias("pixels"))


@query("e13_records", f"with {IMAGES} select id, 'target' as resolution, 0.5::double as spacing, (id % 100)::bigint as x, list_sum(px)::bigint as total from im union all select id, 'context', 2.0::double, (id % 100)::bigint, list_sum(px[1:32])::bigint from im")
def e13_records(spark, sf_dir):
    record = lambda px, s: F.struct(px.alias("img_array"), (F.col("id") % 100).alias("x"), F.lit(s).alias("spacing"))
    own = byte_images(spark, sf_dir).select("id", F.create_map(F.lit("target"), record(F.col("px"), 0.5), F.lit("context"), record(F.slice("px", 1, 32), 2.0)).alias("data"))
    out = own.select("id", F.explode("data").alias("resolution", "r"))
    return out.select("id", "resolution", "r.spacing", "r.x", F.aggregate("r.img_array", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("f1_tissue", f"with {IMAGES} select id, round(len(list_filter(px, lambda v: v < 220)) / 64.0::double, 6) as tissue from im where len(list_filter(px, lambda v: v < 220)) / 64.0 >= 0.9")
def f1_tissue(spark, sf_dir):
    share = F.round(F.size(F.filter("px", lambda v: v < 220)) / F.lit(64.0), 6)
    return byte_images(spark, sf_dir).select("id", share.alias("tissue")).where("tissue >= 0.9")


def as_image(px: Column, height: int = 8, width: int = 8) -> Column:
    data = F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("channels"), data.alias("data"))


INNER = "list_transform(range(1, 7), lambda i: list_transform(range(1, 7), lambda j: px[(i-1)*8+j+1] + px[(i+1)*8+j+1] + px[i*8+j] + px[i*8+j+2] - 4 * px[i*8+j+1]))"
LAPLACIAN = f"lap as (select id, px, flatten({INNER}) as l from im), sharp as (select id, px, list_sum(list_transform(l, lambda v: (v * v)::double)) / 64 - (list_sum(list_transform(l, lambda v: v::double)) / 64) * (list_sum(list_transform(l, lambda v: v::double)) / 64) as s from lap)"


@query("f2_blur", f"with {IMAGES}, {LAPLACIAN} select id, round(s, 4) as sharpness from sharp")
def f2_blur(spark, sf_dir):
    at = lambda i, j: F.col("px")[(i * 8 + j).cast("int")]
    inner = F.sequence(F.lit(1), F.lit(6))
    lap = F.flatten(F.transform(inner, lambda i: F.transform(inner, lambda j: at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * at(i, j))))
    total = lambda f: F.aggregate("l", F.lit(0.0), lambda a, v: a + f(v.cast("double"))) / 64
    return byte_images(spark, sf_dir).select("id", lap.alias("l")).select("id", F.round(total(lambda v: v * v) - total(lambda v: v) * total(lambda v: v), 4).alias("sharpness"))


@query("f3_filter_chain", f"with {IMAGES}, {LAPLACIAN} select id, s >= 30000 and len(list_filter(px, lambda v: v < 220)) / 64.0 >= 0.9 as kept from sharp")
def f3_filter_chain(spark, sf_dir):
    own = byte_images(spark, sf_dir).select("id", as_image(F.col("px")).alias("image"))
    out = images.map_images(own, lambda im, _: images.preprocessed(im, 8, tissue=0.9, blur=30000))
    return out.select("id", F.col("image").isNotNull().alias("kept"))


@query("f4_drop_null_targets", f"with {IMAGES}, {LAPLACIAN} select id from sharp where s >= 30000 and len(list_filter(px, lambda v: v < 220)) / 64.0 >= 0.9")
def f4_drop_null_targets(spark, sf_dir):
    return f3_filter_chain(spark, sf_dir).where("kept").select("id")


@query("t13_rasterise")
def t13_rasterise(spark, sf_dir):
    import numpy as np

    from tessera.functions import polygons

    def count(it):
        for frame in it:
            frame["pixels"] = [int(polygons.rasterised([np.array([(0, 0), (w, 0), (0, h)], float)], int(w), int(h)).sum()) for w, h in zip(frame["w"], frame["h"])]
            yield frame[["id", "pixels"]]

    return rectangles(spark, sf_dir).select("id", ((F.col("x2") - F.col("x1")) / 10).cast("int").alias("w"), ((F.col("y2") - F.col("y1")) / 10).cast("int").alias("h")).mapInPandas(count, "id long, pixels long")


@query("t15_tile_corners", f"{TILES} select id, x, y, trunc((x + 64) * 0.5 * 0.25)::int - 16 as px, trunc((y + 64) * 0.5 * 0.25)::int - 16 as py from tiles")
def t15_tile_corners(spark, sf_dir):
    own = tiles.with_centres(tiles.tile_rectangles(rectangles(spark, sf_dir), 128, 32))
    corner = lambda c: (F.col(c) * 0.5 * 0.25).cast("int") - 32 // 2
    return own.select("id", "x", "y", corner("cx").alias("px"), corner("cy").alias("py"))


def _augmented(spark, sf_dir, split):
    own = byte_images(spark, sf_dir).select("id", as_image(F.concat("px", "px", "px"), 8, 24).alias("image"))
    out = images.map_images(own, lambda im, key: images.augmented(im, images.generator(7, 0, key), 16, split))
    return out.select("id", "image.height", "image.width", F.sha2("image.data", 256).alias("sha256"))


@query("g5_augment_train")
def g5_augment_train(spark, sf_dir):
    return _augmented(spark, sf_dir, "train")


@query("g10_resize_test")
def g10_resize_test(spark, sf_dir):
    return _augmented(spark, sf_dir, "test")


@query("s13_fake_dataset")
def s13_fake_dataset(spark, sf_dir):
    """All 10^6 items, with small images: their counts and means by tenth."""
    own = fake_dataset(spark, input_shape=(3, 2, 2), output_shape=(1, 1, 2), classes=(1, 5))
    mean = F.aggregate("image", F.lit(0.0), lambda a, v: a + v) / 12
    return own.groupBy((F.col("index") % 10).alias("tenth")).agg(F.count("*").alias("n"), F.round(F.avg(mean), 2).alias("mean"), F.min(F.array_min("label")).alias("low"), F.max(F.array_max("label")).alias("high"))


@query("s16_slide_tiles", f"{TILES}, s as (select distinct file_key, length(file_key) as name_length from rects) select t.id, t.x, t.y, s.name_length::int as name_length from tiles t join s using (file_key) where inter >= 0.25*128*128")
def s16_slide_tiles(spark, sf_dir):
    rects = rectangles(spark, sf_dir)
    known = rects.select("file_key").distinct().withColumn("name_length", F.length("file_key"))
    return tiles.tile_rectangles(rects, 128, 32, 0.25, full_coverage=True).join(known, "file_key").select("id", "x", "y", "name_length")


def _mapped(spark, sf_dir, step):
    """A pixel step applied to colour images of 8 x 8, seeded by row: size and digest of the result."""
    own = byte_images(spark, sf_dir).select("id", F.expr("flatten(transform(px, (v, i) -> array(v, (v + i) % 256, (v * 3) % 256)))").alias("px"))
    rows = own.select("id", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("data")).alias("image"))
    out = images.map_images(rows, lambda im, key: step(im, images.generator(7, 0, key)))
    return out.select("id", "image.height", "image.width", F.sha2("image.data", 256).alias("sha256"))


@query("g6_sharpen")
def g6_sharpen(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda im, rng: images.sharpened(im, rng.uniform(0, 0.5)))


@query("g7_noise")
def g7_noise(spark, sf_dir):
    return _mapped(spark, sf_dir, images.noisy)


@query("g8_stain")
def g8_stain(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda im, rng: images.stain_shifted(im, rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1)) if rng.random() < 0.5 else images.hue_saturation(im, rng.uniform(-10, 10), rng.uniform(-10, 10)))


@query("g9_geometry")
def g9_geometry(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda im, rng: images.elastic(im, rng) if rng.random() < 0.5 else images.affine(im, rng.uniform(0.9, 1.1), 0.05, -0.05, rng.uniform(-30, 30), rng.uniform(-9, 9)))


@query("g12_stain_densities")
def g12_stain_densities(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda im, rng: images.stain_shifted(im, 0.1, -0.1))


@query("e8_transform", f"with {IMAGES} select id, sha256(unhex(array_to_string(list_transform(px, lambda v: lpad(to_hex(255 - v), 2, '0')), ''))) as sha256 from im")
def e8_transform(spark, sf_dir):
    """A caller's transform of pixels: the negative."""
    rows = byte_images(spark, sf_dir).select("id", as_image(F.col("px")).alias("image"))
    return images.map_images(rows, lambda im, _: 255 - im).select("id", F.sha2("image.data", 256).alias("sha256"))


@query("e12_filters", f"with {IMAGES} select id, sha256(unhex(array_to_string(list_transform(px, lambda v: lpad(to_hex(case when v > 200 then 200 else v end), 2, '0')), ''))) as sha256 from im")
def e12_filters(spark, sf_dir):
    """A caller's patch filter inside the tile chain."""
    rows = byte_images(spark, sf_dir).select("id", as_image(F.col("px")).alias("image"))
    return images.map_images(rows, lambda im, _: images.preprocessed(im, 8, filters=(lambda x: x.clip(max=200),))).select("id", F.sha2("image.data", 256).alias("sha256"))


@query("t11_samples")
def t11_samples(spark, sf_dir):
    """Patches of all resolutions with the target's shape, and their ratio to the finest level."""
    plan = _region_plan(spark, sf_dir)
    patches = read_regions(plan, _cells(spark, sf_dir), 64)
    return patches.join(plan.select("request", "resolution", "ratio"), ["request", "resolution"]).select("request", "resolution", "ratio", "patch.height", "patch.width")


def _pyramids(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file_key"), F.array(F.lit(0.25), F.lit(1.0), F.lit(4.0)).alias("spacings"))


@query("t12_thumbnails", "select 'n' || n_nationkey as file_key, 2 as level, 4.0::double as real, 64 as height, 64 as width from nation")
def t12_thumbnails(spark, sf_dir):
    return thumbnails(_pyramids(spark, sf_dir), _cells(spark, sf_dir), 8.0).select("file_key", "level", "real", "image.height", "image.width")


@query("t12_tissue_masks", "select 'n' || n_nationkey as file_key, (n_nationkey * 7 + 100) % 256 < 220 as tissue from nation")
def t12_tissue_masks(spark, sf_dir):
    out = tissue_masks(thumbnails(_pyramids(spark, sf_dir), _cells(spark, sf_dir), 8.0))
    return out.select("file_key", F.hex(F.substring("image.data", 1, 1)).alias("first")).select("file_key", (F.col("first") == "FF").alias("tissue"))


@query("s14_open_slides", "select 'n' || n_nationkey as file_key, 3 as n_levels, 21::bigint as n_cells from nation")
def s14_open_slides(spark, sf_dir):
    """What opening a slide tells: its levels and cells, without reading a pixel."""
    cells = _cells(spark, sf_dir).groupBy("file_key").agg(F.count("*").alias("n_cells"))
    return _pyramids(spark, sf_dir).select("file_key", F.size("spacings").alias("n_levels")).join(cells, "file_key")


# ---- graphs ----

CENTROIDS = "nodes as (select label as image, vec_id as node, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


def nodes(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    return own.select(F.col("label").cast("long").alias("image"), F.col("vec_id").alias("node"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("position"))


KNN = f"with {CENTROIDS}, d as (select a.image, a.node as src, b.node as dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist from nodes a join nodes b on a.image = b.image and a.node <> b.node), r as (select *, row_number() over (partition by src order by dist, dst) as k from d)"


@query("j5_knn", f"{KNN} select image::bigint as image, src, dst, round(dist, 6) as dist from r where k <= 5")
def j5_knn(spark, sf_dir):
    return graph.knn_edges(nodes(spark, sf_dir)).select("image", "src", "dst", F.round("dist", 6).alias("dist"))


@query("k1_knn_limited", f"{KNN} select image::bigint as image, src, dst from r where k <= 5 and dist <= 0.05")
def k1_knn_limited(spark, sf_dir):
    return graph.knn_edges(nodes(spark, sf_dir), 5, 0.05).select("image", "src", "dst")


@query("k2_variants", "select a.angle::int as angle, f.flip from (values (0), (90), (180)) as a(angle), (values ('n'), ('h'), ('v')) as f(flip)")
def k2_variants(spark, sf_dir):
    return graph.variants(spark, [0, 90, 180], ["n", "h", "v"])


@query("k4_location_features", "select vec_id as node, round(embedding[1]::double / 100, 8) as fx, round(embedding[2]::double / 50, 8) as fy, 4 as width from embeddings")
def k4_location_features(spark, sf_dir):
    own = nodes(spark, sf_dir).select("node", F.col("position").alias("features"), F.col("position")[0].alias("cx"), F.col("position")[1].alias("cy"), F.lit(100.0).alias("w"), F.lit(50.0).alias("h"))
    out = graph.with_location(own, "w", "h")
    return out.select("node", F.round(F.col("features")[2], 8).alias("fx"), F.round(F.col("features")[3], 8).alias("fy"), F.size("features").alias("width"))


@query("k5_graph_variants", "select label::bigint as image, a.angle::int as angle, count(*)::bigint as n_nodes from embeddings, (values (0), (90)) as a(angle) group by 1, 2")
def k5_graph_variants(spark, sf_dir):
    own = graph.graphs(nodes(spark, sf_dir), graph.variants(spark, [0, 90]))
    return own["nodes"].groupBy("image", "angle").agg(F.count("*").alias("n_nodes"))
