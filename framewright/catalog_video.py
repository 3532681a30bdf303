"""Named queries over pictures and Y4M files, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import fixtures as fx
from framewright.catalog import _doc_id, c, query
from framewright.functions import video
from framewright.operators import packets as pk

#: Pictures of the queries: texts cut into 4:2:0 pictures of this size.
WIDTH, HEIGHT = 16, 12
SIZE = video.picture_size("YUV420", WIDTH, HEIGHT)
RATES = ((25, 1), (30000, 1001), (24, 1), (50, 1))
_RATE = "([" + ", ".join(f"{{'num': {a}::bigint, 'den': {b}::bigint}}" for a, b in RATES) + "])[doc_id % 4 + 1]"
_PICTURES = f"""pictures as (select doc_id, k, content[k * {SIZE} + 1 : (k + 1) * {SIZE}] as data, rate.num as rate_num, rate.den as rate_den from
 (select doc_id, content, {_RATE} as rate, unnest(range(octet_length(content) // {SIZE})) as k from (select doc_id, encode(text) as content from documents)))"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, k, data, width, height, rate_num, rate_den, format: texts as films of whole pictures."""
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    frames = pk.packetize(rows, "content", F.lit(8), F.lit(1), SIZE, ("doc_id",)).filter(c("size") == SIZE)
    rate = lambda i: fx._pick([r[i] for r in RATES], c("doc_id") % 4).cast("long")
    return frames.select("doc_id", F.concat(F.lit("doc-"), c("doc_id").cast("string"), F.lit(".y4m")).alias("path"), "k", "data", F.lit(WIDTH).cast("long").alias("width"), F.lit(HEIGHT).cast("long").alias("height"), rate(0).alias("rate_num"), rate(1).alias("rate_den"), F.lit("YUV420").alias("format"))


_BYTE = "list_transform(range({n}), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::integer)"
_LUMA, _CHROMA = WIDTH * HEIGHT, WIDTH * HEIGHT // 4


def _colour(sql: str) -> str:
    return f"printf('%02X', greatest(0, least(255, ({sql} + 128) // 256)))"


@query(f"with {_PICTURES} select doc_id, k, md5(hex(data[1:{_LUMA}])) as y_md5, md5(hex(data[{_LUMA + 1}:{_LUMA + _CHROMA}])) as u_md5, md5(hex(data[{_LUMA + _CHROMA + 1}:{SIZE}])) as v_md5 from pictures")
def video_planes(spark, sf_dir):
    rows = pictures(spark, sf_dir).withColumn("p", video.planes(c("data"), c("format"), c("width"), c("height")))
    return rows.select("doc_id", "k", *(F.md5(F.hex(f"p.{x}")).alias(f"{x}_md5") for x in "yuv"))


@query(f"""with {_PICTURES}, b as (select doc_id, k, {_BYTE.format(n=SIZE)} as b from (select doc_id, k, hex(data) as h from pictures)),
 p as (select doc_id, k, list_transform(range({_LUMA}), lambda i: [b[i + 1] - 16, b[{_LUMA} + i // {2 * WIDTH} * {WIDTH // 2} + i % {WIDTH} // 2 + 1] - 128, b[{_LUMA + _CHROMA} + i // {2 * WIDTH} * {WIDTH // 2} + i % {WIDTH} // 2 + 1] - 128]) as px from b)
 select doc_id, k, md5(array_to_string(list_transform(px, lambda x: {_colour("298 * x[1] + 409 * x[3]")} || {_colour("298 * x[1] - 100 * x[2] - 208 * x[3]")} || {_colour("298 * x[1] + 516 * x[2]")}), '')) as rgb_md5 from p""")
def yuv_to_rgb(spark, sf_dir):
    return pictures(spark, sf_dir).select("doc_id", "k", F.md5(F.hex(video.yuv_to_rgb("data", "format", "width", "height"))).alias("rgb_md5"))


#: Half as wide, two thirds as high: a new value covers two by one and a half.
@query(f"""with {_PICTURES}, b as (select doc_id, k, {_BYTE.format(n=_LUMA)} as b from (select doc_id, k, hex(data) as h from pictures))
 select doc_id, k, md5(array_to_string(list_transform(range({_LUMA // 3}), lambda i: printf('%02X', (2 * list_sum(list_transform([0, 1], lambda d: case when i // {WIDTH // 2} % 2 = 0
  then 2 * b[i // {WIDTH} * 3 * {WIDTH} + i % {WIDTH // 2} * 2 + d + 1] + b[(i // {WIDTH} * 3 + 1) * {WIDTH} + i % {WIDTH // 2} * 2 + d + 1]
  else b[(i // {WIDTH} * 3 + 1) * {WIDTH} + i % {WIDTH // 2} * 2 + d + 1] + 2 * b[(i // {WIDTH} * 3 + 2) * {WIDTH} + i % {WIDTH // 2} * 2 + d + 1] end)) + 6)::bigint // 12)), '')) as luma_md5 from b""")
def scale_pictures(spark, sf_dir):
    """The luma of pictures in half the width and two thirds of the height."""
    wide, high = WIDTH // 2, HEIGHT * 2 // 3
    small = video.scaled("data", "format", "width", "height", F.lit(wide), F.lit(high))
    return pictures(spark, sf_dir).select("doc_id", "k", F.md5(F.hex(F.substr(small, F.lit(1), F.lit(wide * high)))).alias("luma_md5"))


@query(f"""with {_PICTURES} select doc_id, k as source_k, unnest(range((k * 30 * rate_den + rate_num - 1) // rate_num, ((k + 1) * 30 * rate_den + rate_num - 1) // rate_num)) as k from pictures""")
def convert_fps(spark, sf_dir):
    """Films at 30 frames a second."""
    return video.convert_fps(pictures(spark, sf_dir), (c("rate_num"), c("rate_den")), (30, 1)).select("doc_id", "source_k", "k")


def _y4m(spark: SparkSession, sf_dir: str) -> str:
    from framewright.sources import files, y4m

    folder = files.new_folder(spark, "y4m")
    y4m.write_files(pictures(spark, sf_dir), folder)
    return folder


@query(f"with {_PICTURES} select doc_id, k, k as pts, {WIDTH}::bigint as width, {HEIGHT}::bigint as height, rate_num, rate_den, 'YUV420' as format, md5(data) as data_md5 from pictures")
def y4m_scan(spark, sf_dir):
    rows = spark.read.format("y4m").options(path=_y4m(spark, sf_dir), range=1 << 16).load()
    return rows.select(_doc_id(c("path")), "k", "pts", "width", "height", "rate_num", "rate_den", "format", F.md5("data").alias("data_md5"))


@query(f"with {_PICTURES} select doc_id, (length('YUV4MPEG2 W{WIDTH} H{HEIGHT} F' || any_value(rate_num) || ':' || any_value(rate_den) || ' Ip A1:1 C420') + 1 + count(*) * {SIZE + 6})::bigint as size from pictures group by doc_id")
def y4m_sink(spark, sf_dir):
    from framewright.sources import files

    return files.sizes(spark, _y4m(spark, sf_dir)).select(_doc_id(c("path")), "size")
