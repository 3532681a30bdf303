"""Named queries over samples: ADPCM, sample rates, filter chains, mixing; with DuckDB's SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import fixtures as fx
from framewright.catalog import LIMIT, _RAW, _le, _list, c, query
from framewright.functions import adpcm, pcm
from framewright.operators import chain, mix
from framewright.operators import packets as pk
from framewright.operators import resample as rs

# --- ADPCM --------------------------------------------------------------------------------------------

#: Bytes of a block and channel in the queries: a head of 4, and 64 samples. Texts have one channel or two.
ADPCM_BLOCK = 36
_CODED = f"""coded as (select doc_id, encode(text) as content, octet_length(encode(text))::bigint as n, (doc_id % 2 + 1)::bigint as ch, {ADPCM_BLOCK} * (doc_id % 2 + 1) as block from documents)"""
_NIBBLES = "list_transform(range(case when ch = 1 then (size - 4) * 2 else (size - 8) // 8 * 8 end), lambda j: instr('0123456789ABCDEF', h[2 * (4 * ch + case when ch = 1 then j // 2 else j // 8 * 8 + chan * 4 + j % 8 // 2 end) + 2 - j % 2]) - 1)"
_STEPS, _MOVES = _list(adpcm.STEPS), _list(adpcm.INDEX_STEPS)
#: The value and index after a code.
_NEXT = f"""value as old, greatest(0, least(88, idx + ({_MOVES})[code % 8 + 1])) as idx,
 greatest(-32768, least(32767, value + case when code >= 8 then -1 else 1 end * (step // 8 + case when code & 4 > 0 then step else 0 end + case when code & 2 > 0 then step // 2 else 0 end + case when code & 1 > 0 then step // 4 else 0 end))) as value"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), (c("doc_id") % 2 + 1).alias("ch"))
    return rows.withColumn("block", c("ch") * ADPCM_BLOCK)


@query(f"""with recursive {_CODED},
cut as (select doc_id, k, ch, least(block, n - k * block) as size, hex(content[k * block + 1 : least(n, (k + 1) * block)]) as h from (select *, unnest(range(0, (n + block - 1) // block)) as k from coded where n > 0)),
heads as (select *, unnest(range(ch)) as chan from cut where size >= 4 * ch),
starts as (select doc_id, k, ch, chan, {_NIBBLES} as codes, ('0x' || h[8 * chan + 3:8 * chan + 4] || h[8 * chan + 1:8 * chan + 2])::bigint as raw, least(88, ('0x' || h[8 * chan + 5:8 * chan + 6])::bigint) as idx from heads),
steps as (select doc_id, k, ch, chan, codes, 0::bigint as i, (case when raw >= 32768 then raw - 65536 else raw end)::bigint as value, idx::bigint as idx from starts
 union all select doc_id, k, ch, chan, codes, i + 1, value::bigint, idx::bigint from (select doc_id, k, ch, chan, codes, i, {_NEXT} from (select *, ({_STEPS})[idx + 1] as step, codes[i + 1] as code from steps where i < len(codes)))),
done as (select doc_id, k, count(*) as values, md5(string_agg({_le('value + 65536', 2)}, '' order by i, chan)) as pcm_md5 from steps group by doc_id, k)
select doc_id, k, case when size < 4 * ch then null else values // ch end::bigint as n, pcm_md5 from cut left join done using (doc_id, k)""")
def adpcm_decode(spark, sf_dir):
    """Texts as ADPCM: a packet a block."""
    # Packets are cut at whole blocks; bytes are no samples here, so a frame is a byte.
    packets = pk.packetize(_coded(spark, sf_dir), "content", F.lit(8), F.lit(1), c("block"), ("doc_id", "ch", "block"))
    found = pk.decode_adpcm(packets, c("ch"), c("block"))
    return found.select("doc_id", "k", F.floor(F.octet_length("data") / (2 * c("ch"))).alias("n"), F.md5(F.hex("data")).alias("pcm_md5"))


@query(f"""with recursive {_CODED},
cut as (select doc_id, k, ch, least(most, n - k * most) // (2 * ch) as size, hex(content[k * most + 1 : least(n, (k + 1) * most)]) as h from (select *, unnest(range(0, (n + most - 1) // most)) as k from (select *, 65 * 2 * ch as most from coded where n > 0 and n % (2 * ch) = 0))),
chans as (select *, unnest(range(ch)) as chan from cut),
samples as (select doc_id, k, ch, chan, list_transform(list_transform(range(size), lambda i: ('0x' || h[4 * (i * ch + chan) + 3:4 * (i * ch + chan) + 4] || h[4 * (i * ch + chan) + 1:4 * (i * ch + chan) + 2])::bigint), lambda x: case when x >= 32768 then x - 65536 else x end) as s from chans),
starts as (select *, greatest(0, len(list_filter({_STEPS}, lambda x: len(s) > 1 and x <= abs(s[2] - s[1]))) - 1)::bigint as first from samples),
steps as (select doc_id, k, ch, chan, s, first, 0::bigint as i, s[1]::bigint as value, first as idx, 0::bigint as made from starts
 union all select doc_id, k, ch, chan, s, first, i + 1, value::bigint, idx::bigint, code from (select doc_id, k, ch, chan, s, first, i, code, {_NEXT} from
  (select *, (c4 + c2 + case when gap - (c4 // 4) * step - (c2 // 2) * (step // 2) >= step // 4 then 1 else 0 end + sign)::bigint as code from
   (select *, case when gap - (c4 // 4) * step >= step // 2 then 2 else 0 end as c2 from (select *, case when gap >= step then 4 else 0 end as c4, case when wanted < 0 then 8 else 0 end as sign from
    (select *, abs(wanted) as gap from (select *, ({_STEPS})[idx + 1] as step, s[i + 2] - value as wanted from steps where i + 1 < len(s)))))))),
tracks as (select doc_id, k, ch, chan, {_le('any_value(s[1]) + 65536', 2)} || {_le('any_value(first)', 1)} || '00' as head, list(made order by i) filter (i > 0) as codes from steps group by doc_id, k, ch, chan),
padded as (select *, coalesce(codes, []) || list_transform(range((case when ch = 1 then 2 else 8 end - coalesce(len(codes), 0) % (case when ch = 1 then 2 else 8 end)) % (case when ch = 1 then 2 else 8 end)), lambda x: 0::bigint) as codes8 from tracks),
parts as (select doc_id, k, chan, unnest(range(len(codes8) // (case when ch = 1 then 2 else 8 end))) as g, ch, codes8 from padded),
bodies as (select doc_id, k, string_agg(array_to_string(list_transform(range(case when ch = 1 then 1 else 4 end), lambda b: substr('0123456789ABCDEF', codes8[g * (case when ch = 1 then 2 else 8 end) + 2 * b + 2] + 1, 1) || substr('0123456789ABCDEF', codes8[g * (case when ch = 1 then 2 else 8 end) + 2 * b + 1] + 1, 1)), ''), '' order by g, chan) as body from parts group by doc_id, k),
tops as (select doc_id, k, string_agg(head, '' order by chan) as top from tracks group by doc_id, k)
select doc_id, k, (length(top || coalesce(body, '')) // 2)::bigint as size, md5(top || coalesce(body, '')) as data_md5 from tops left join bodies using (doc_id, k)""")
def adpcm_encode(spark, sf_dir):
    """Texts whose length fits as 16-bit samples, a packet a block."""
    rows = _coded(spark, sf_dir).filter(F.octet_length("content") % (2 * c("ch")) == 0)
    packets = pk.packetize(rows, "content", F.lit(16), c("ch"), pk.adpcm_packet_bytes(c("ch"), c("block")), ("doc_id", "ch", "block"))
    found = pk.encode_adpcm(packets, c("ch"), c("block"))
    return found.select("doc_id", "k", F.octet_length("data").cast("long").alias("size"), F.md5(F.hex("data")).alias("data_md5"))


# --- Sample rates --------------------------------------------------------------------------------------

RATE = 16000


@query()
def resample(spark, sf_dir):
    """16-bit texts at one rate, as 16-bit samples again."""
    raw = fx.raw_files(spark, sf_dir).filter("depth = 16")
    packets = pk.packetize(raw, "content", c("depth"), c("channels"), LIMIT, ("doc_id", "path", "channels", "sample_rate"))
    whole = packets.withColumn("data", F.substr("data", F.lit(1), (F.octet_length("data") - F.octet_length("data") % 2).cast("int")))
    found = rs.resample(whole.withColumn("samples", pcm.to_floats(c("data"), F.lit(16))), RATE)
    return found.select("path", "k", "pts", "channels", F.md5(F.hex(pcm.from_floats(c("samples"), F.lit(16)))).alias("pcm_md5"), F.size("samples").cast("long").alias("values"))


# --- Filter chains and channels --------------------------------------------------------------------------------------

#: Seconds: texts are some hundredths long.
TRIM, FADE = ("0.0051", "0.0213"), "0.0107"
_FRAMES = f"""{_RAW}, cut as (select *, {LIMIT} // (2 * channels) * (2 * channels) as most, octet_length(content)::bigint as n from raw_files where depth = 16 and octet_length(content) % (2 * channels) = 0),
 packets as (select doc_id, channels as ch, sample_rate, n // (2 * channels) as total, k * most // (2 * channels) as pts, least(most, n - k * most) // (2 * channels) as frames, hex(content[k * most + 1 : least(n, (k + 1) * most)]) as h
  from (select *, unnest(range(0, (n + most - 1) // most)) as k from cut where n > 0)),
 frames as (select * exclude h, list_transform(list_transform(range(frames * ch), lambda i: ('0x' || h[4 * i + 3:4 * i + 4] || h[4 * i + 1:4 * i + 2])::bigint), lambda x: case when x >= 32768 then x - 65536 else x end) as s from packets)"""


def _md5(values: str) -> str:
    digits = _le("x + 65536", 2)
    return f"md5(array_to_string(list_transform({values}, lambda x: {digits}), ''))"


def _frames16(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.raw_files(spark, sf_dir).filter((c("depth") == 16) & (F.octet_length("content") % (2 * c("channels")) == 0))
    packets = pk.packetize(raw, "content", c("depth"), c("channels"), LIMIT, ("doc_id", "path", "depth", "channels", "sample_rate"))
    return pk.decode(packets, c("depth"), c("channels")).select("doc_id", "path", "pts", "nb_samples", "samples", "channels", "sample_rate")


def _sounding(frames: DataFrame) -> DataFrame:
    values = pcm.from_floats(F.transform("samples", lambda x: x.cast("double")), F.lit(16))
    return frames.select("doc_id", "pts", c("nb_samples").cast("long").alias("n"), F.md5(F.hex(values)).alias("pcm_md5"))


@query(f"""with {_FRAMES}, b as (select *, ceil({TRIM[0]}::decimal(18,6) * sample_rate)::bigint as first, ceil({TRIM[1]}::decimal(18,6) * sample_rate)::bigint as last from frames),
 t as (select *, greatest(0, first - pts) as skip, least(frames, last - pts) as stop from b)
 select doc_id, pts + skip - first as pts, stop - skip as n, {_md5("s[skip * ch + 1 : stop * ch]")} as pcm_md5 from t where stop > skip""")
def trim(spark, sf_dir):
    """Packets outside are passed over before they are decoded."""
    return _sounding(chain.apply(_frames16(spark, sf_dir), chain.parse([f"trim={TRIM[0]}-{TRIM[1]}"])))


@query(f"""with {_FRAMES}, t as (select *, greatest(1, ceil({FADE}::decimal(18,6) * sample_rate))::double as over from frames)
 select doc_id, pts, frames as n, {_md5("list_transform(range(frames * ch), lambda i: trunc(s[i + 1] * least(1.0::double, (total - 1 - (pts + i // ch))::double / over) * least(1.0::double, (pts + i // ch)::double / over))::bigint)")} as pcm_md5 from t""")
def fade(spark, sf_dir):
    """In and out."""
    return _sounding(chain.apply(_frames16(spark, sf_dir), chain.parse([f"fade=out:{FADE}", f"fade=in:{FADE}"])))


@query(f"with {_FRAMES} select doc_id, total - pts - frames as pts, frames as n, {_md5('flatten(list_transform(range(frames), lambda i: s[(frames - 1 - i) * ch + 1 : (frames - i) * ch]))')} as pcm_md5 from frames")
def reverse(spark, sf_dir):
    return _sounding(chain.apply(_frames16(spark, sf_dir), chain.parse(["reverse"])))


@query(f"""with {_FRAMES}, b as (select *, total - pts - frames as back, flatten(list_transform(range(frames), lambda i: s[(frames - 1 - i) * ch + 1 : (frames - i) * ch])) as r, ceil({TRIM[0]}::decimal(18,6) * sample_rate)::bigint as first from frames),
 t as (select *, greatest(0, first - back) as skip from b where back + frames > first)
 select doc_id, back + skip - first as pts, frames - skip as n, {_md5("list_transform(r[skip * ch + 1 :], lambda x: trunc(x * 0.5::double)::bigint)")} as pcm_md5 from t""")
def filter_chain(spark, sf_dir):
    """A chain as a job's option names it."""
    return _sounding(chain.apply(_frames16(spark, sf_dir), chain.parse(["track=0", f"filter_chain=reverse,trim:{TRIM[0]}-,volume:0.5"])))


@query(f"""with {_FRAMES} select doc_id, pts, frames as n, {_md5("list_transform(range(frames), lambda i: trunc(list_sum(s[i * ch + 1 : (i + 1) * ch])::double / ch)::bigint)")} as pcm_md5 from frames""")
def remix_mono(spark, sf_dir):
    """All channels as one, their mean."""
    return _sounding(_frames16(spark, sf_dir).withColumn("samples", rs.remix(c("samples"), c("channels"), 1)))


@query(f"""with {_FRAMES} select doc_id, pts, frames as n, {_md5("flatten(list_transform(range(frames), lambda i: case when ch = 1 then [s[i + 1], s[i + 1]] else s[i * ch + 1 : i * ch + 2] end))")} as pcm_md5 from frames""")
def remix_stereo(spark, sf_dir):
    return _sounding(_frames16(spark, sf_dir).withColumn("samples", rs.remix(c("samples"), c("channels"), 2)))


@query()
def speed(spark, sf_dir):
    """Half as fast again."""
    frames = chain.apply(_frames16(spark, sf_dir), chain.parse(["speed=1.5"]))
    return frames.select("path", "pts", c("nb_samples").cast("long").alias("n"), "channels", "sample_rate", F.md5(F.hex(pcm.from_floats(c("samples"), F.lit(16)))).alias("pcm_md5"))


# --- Mixing ---------------------------------------------------------------------------------------------

_MIX = """frames as (select vec_id, label::bigint as mix, vec_id % 4 + 1 as g, vec_id * 37 % 5000 as start, embedding as samples from embeddings)"""


@query(f"""with {_MIX}, x as (select mix, start + i as place, round_even(samples[i + 1]::double * (g / 4.0::double) * {mix.UNIT}, 0)::bigint as v from (select *, unnest(range(64)) as i from frames)),
 s as (select mix, place, sum(v)::bigint as v from x group by all)
 select mix, place, v as amplitude from s where v <> 0""")
def mix_tracks(spark, sf_dir):
    """Vectors as tracks of one channel, those of a label in one mix; parts of 2^-30 at each place."""
    rows = fx.frames_f32(spark, sf_dir).withColumn("channels", F.lit(1))
    found = mix.mix(rows, c("vec_id") * 37 % 5000, c("g") / F.lit(4.0), "stream_id")
    each = found.select("mix", "pts", F.posexplode("samples").alias("i", "v"))
    return each.select("mix", (c("pts") + c("i")).alias("place"), F.round(c("v") * mix.UNIT).cast("long").alias("amplitude")).filter("amplitude <> 0")


@query()
def mix_limited(spark, sf_dir):
    """The same mixes under a ceiling."""
    rows = fx.frames_f32(spark, sf_dir).withColumn("channels", F.lit(1))
    found = mix.mix(rows, c("vec_id") * 37 % 5000, c("g"), "stream_id", ceiling=1.0)
    return found.select("mix", "k", "pts", "n_tracks", F.size("samples").cast("long").alias("n"), F.array_max(F.transform("samples", lambda x: F.abs(x))).alias("peak"))
