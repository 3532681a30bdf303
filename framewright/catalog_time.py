"""Named queries over times: joins, sessions, cues, files' digests, and the table function; with DuckDB's SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import fixtures as fx
from framewright.catalog import LIMIT, _EVENTS, _PACKETS, _packets, c, query
from framewright.functions import formats, subtitles, table
from framewright.operators import packets as pk
from framewright.operators import timejoins as tj

# --- Joins by time -------------------------------------------------------------------------------------

HOUR = 3_600_000_000
#: Cues of an hour a turn or less; those of every fifth conversation are twenty times as long.
_CUES = f"""cues as (select conv_id, turn, conv_id % 7 as stream_id, (conv_id % 100 * 25900000000 + turn * {HOUR})::bigint as cue_start,
 (conv_id % 100 * 25900000000 + turn * {HOUR} + (length(text) % 97 + 1) * 37000000 * case when conv_id % 5 = 0 then 20 else 1 end)::bigint as cue_end from conversations)"""


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = c("conv_id") % 100 * F.lit(25900000000) + c("turn") * F.lit(HOUR)
    length = (F.length("text") % 97 + 1) * F.lit(37000000).cast("long") * F.when(c("conv_id") % 5 == 0, 20).otherwise(1)
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", (c("conv_id") % 7).alias("stream_id"), start.alias("cue_start"), (start + length).alias("cue_end"))


@query(f"""with {_EVENTS}, one as (select stream_id, pts, max(event_id) as event_id from event_packets where event_type = 'view' group by all),
 asked as (select event_id, stream_id, pts from event_packets where event_type = 'purchase')
 select a.event_id, a.stream_id, a.pts, o.event_id as seen_id, o.pts as seen_pts from asked a asof left join one o on a.stream_id = o.stream_id and a.pts >= o.pts""")
def asof_join(spark, sf_dir):
    """The last view of the same stream at or before each purchase."""
    events = fx.event_packets(spark, sf_dir)
    seen = events.filter("event_type = 'view'").select("stream_id", "pts", "event_id")
    rows = tj.asof_join(events.filter("event_type = 'purchase'").select("event_id", "stream_id", "pts"), seen, ["stream_id"], "pts", ["event_id"], 6 * HOUR)
    return rows.select("event_id", "stream_id", "pts", c("found.event_id").alias("seen_id"), c("found.pts").alias("seen_pts"))


@query(f"""with {_EVENTS}, one as (select stream_id, pts, max(event_id) as event_id from event_packets where event_type = 'error' group by all),
 asked as (select event_id, stream_id, pts from event_packets where event_type = 'click')
 select a.event_id, case when o.pts - a.pts <= {HOUR} then o.event_id end as error_id, case when o.pts - a.pts <= {HOUR} then o.pts - a.pts end as after from asked a asof left join one o on a.stream_id = o.stream_id and a.pts <= o.pts""")
def asof_join_forward(spark, sf_dir):
    """The first error of the same stream within an hour after each click."""
    events = fx.event_packets(spark, sf_dir)
    wrong = events.filter("event_type = 'error'").select("stream_id", "pts", "event_id")
    rows = tj.asof_join(events.filter("event_type = 'click'"), wrong, ["stream_id"], "pts", ["event_id"], 6 * HOUR, "forward", HOUR)
    return rows.select("event_id", c("found.event_id").alias("error_id"), (c("found.pts") - c("pts")).alias("after"))


@query(f"with {_EVENTS}, {_CUES} select event_id, e.stream_id, pts, conv_id, turn, cue_start, cue_end from event_packets e join cues on e.stream_id = cues.stream_id and cue_start <= pts and pts < cue_end")
def interval_join(spark, sf_dir):
    """Packets with the cues that are shown at their time."""
    events = fx.event_packets(spark, sf_dir).select("event_id", "stream_id", "pts")
    return tj.interval_join(events, _cues(spark, sf_dir), ["stream_id"], "pts", "cue_start", "cue_end", ["conv_id", "turn"], HOUR // 4)


# --- Sessions ------------------------------------------------------------------------------------------


@query("""with e as (select user_id, ts, value, case user_id % 3 when 0 then interval 1 hour when 1 then interval 6 hours else interval 24 hours end as gap from events where ts is not null),
 m as (select *, case when ts <= lag(ts) over w + gap then 0 else 1 end as is_new from e window w as (partition by user_id order by ts)),
 s as (select *, sum(is_new) over (partition by user_id order by ts rows unbounded preceding) as nr from m)
 select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + any_value(gap)) as end_us, count(*) as n, sum(floor(value)::bigint)::bigint as n_bytes from s group by user_id, nr""")
def event_sessions(spark, sf_dir):
    """Sessions of users whose gaps are an hour, six or a day."""
    gap = F.when(c("user_id") % 3 == 0, "1 hour").when(c("user_id") % 3 == 1, "6 hours").otherwise("24 hours")
    rows = tj.sessions(fx.table(spark, sf_dir, "events"), ["user_id"], "ts", gap, F.sum(F.floor("value").cast("long")).alias("n_bytes"))
    micros = lambda x: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {x})")
    return rows.select("user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n", "n_bytes")


# --- Files as tables and as aggregates -----------------------------------------------------------------------


@query(f"with {_PACKETS} select doc_id, k, size, pts, md5(data) as data_md5 from packets")
def udtf_packets(spark, sf_dir):
    """Packets from SQL by the table function."""
    table.register(spark)
    sql = f"select f.doc_id, p.k, p.size, p.pts, md5(p.data) as data_md5 from {{files}} f, lateral demux(f.content, 'raw', f.depth, cast(f.channels as int), {LIMIT}) p"
    return spark.sql(sql, files=fx.raw_files(spark, sf_dir))


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = formats.bytes_per_frame(c("depth"), c("channels"))
    packets = _packets(spark, sf_dir)
    return pk.digests(packets, "doc_id", c("k") * (F.lit(LIMIT) - F.lit(LIMIT) % block), F.floor(c("size") / block))


@query(f"""with {_PACKETS} select doc_id, count(*)::bigint as n_packets, sum(size)::bigint as size, min(pts) as first_pts, max(pts + size // block) as end_pts, 0::bigint as gap_frames, 0::bigint as gap_bytes from packets group by doc_id""")
def file_sums(spark, sf_dir):
    """What SQL can say of file_digests."""
    return _digests(spark, sf_dir).drop("crc32")


@query()
def file_digests(spark, sf_dir):
    """Checksums of whole files from their packets."""
    return _digests(spark, sf_dir)


# --- Subtitles -------------------------------------------------------------------------------------------

#: A conversation as a file of cues, a turn each: times in milliseconds, bodies without empty lines.
_SUBS = r"""subs as (select conv_id, turn, conv_id % 3 * 3600000 + turn * 5321 as start_ms, conv_id % 3 * 3600000 + turn * 5321 + length(text) % 13000 + 1 as end_ms,
 regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[.] ', chr(10), 'g') as body from conversations where text is not null and trim(text) <> '')"""


def _subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = c("conv_id") % 3 * 3600000 + c("turn") * 5321
    rows = fx.table(spark, sf_dir, "conversations").filter("text is not null and trim(text) <> ''")
    body = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), "[.] ", "\n")
    return rows.select("conv_id", "turn", start.alias("start_ms"), (start + F.length("text") % 13000 + 1).alias("end_ms"), body.alias("body"))


def _sub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, content: SubRip texts; every second file is WebVTT with a head and line ends of two bytes."""
    rows = _subs(spark, sf_dir)
    vtt = c("conv_id") % 2 == 1
    text = F.when(vtt, subtitles.block(c("turn"), c("start_ms"), c("end_ms"), c("body"), "vtt")).otherwise(subtitles.block(c("turn"), c("start_ms"), c("end_ms"), c("body")))
    files = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))), lambda x: x["t"]), "").alias("content"))
    return files.withColumn("content", F.when(vtt, F.regexp_replace(F.concat(F.lit("WEBVTT - a film\n\nNOTE 00:01 is no time\n\n"), "content"), "\n", "\r\n")).otherwise(c("content")))


@query(f"with {_SUBS} select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::bigint as cue, turn::varchar as name, start_ms, end_ms, rtrim(body, ' ' || chr(10)) as body from subs")
def subtitle_cues(spark, sf_dir):
    """Cues parsed from texts of both formats."""
    rows = subtitles.cues(_sub_files(spark, sf_dir), "content", ("conv_id",))
    # A file's cues count from 0, heads and notes aside.
    return rows.withColumn("name", F.trim("name"))


@query(f"with {_SUBS} select conv_id, turn::varchar as name, greatest(start_ms - 9000, 0) as start_ms, end_ms - 9000 as end_ms from subs where end_ms > 9000")
def subtitle_shift(spark, sf_dir):
    rows = subtitles.shift(subtitles.cues(_sub_files(spark, sf_dir), "content", ("conv_id",)), F.lit(-9000))
    return rows.select("conv_id", "name", "start_ms", "end_ms")


@query(f"""with {_SUBS}, e as (select conv_id % 5 as film, start_ms as place, 1 as d from subs union all select conv_id % 5, end_ms, -1 from subs),
 s as (select film, place, sum(d) as d from e group by all having sum(d) <> 0),
 r as (select film, place, sum(d) over w as n, lead(place) over w as until from s window w as (partition by film order by place))
 select film, place as from_ms, until as to_ms, n::bigint as n from r where n >= 2""")
def cue_overlaps(spark, sf_dir):
    """How many cues are shown at once, where all files of a film run together."""
    rows = subtitles.cues(_sub_files(spark, sf_dir), "content", ("conv_id",)).withColumn("film", c("conv_id") % 5)
    return subtitles.overlaps(rows, ("film",), 10_000)
