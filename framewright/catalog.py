"""Named queries over the provided tables and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import fixtures as fx
from framewright.functions import binary, formats, media, pcm, timebase
from framewright.operators import frames as fr
from framewright.operators import packets as pk
from framewright.operators import streams as st
from framewright.plans import compat, config

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


c = F.col
#: Packet bytes of the queries over short texts, so that most have several packets.
LIMIT = 1024

# --- DuckDB's side of the fixtures -------------------------------------------------------------------

_RAW = """raw_files as (select doc_id, 'doc-' || doc_id || '.pcm' as path, encode(text) as content, (doc_id % 3 + 2) * 8 as depth,
 (case lang when 'en' then 1 when 'de' then 2 when 'fr' then 4 else 6 end)::bigint as channels, 8000 * (1 + doc_id % 6) as sample_rate from documents)"""
_PACKETS = _RAW + f""",
 cut as (select *, depth // 8 * channels as block, {LIMIT} // (depth // 8 * channels) * (depth // 8 * channels) as most, octet_length(content) as n from raw_files),
 packets as (select *, content[k * most + 1 : least(n, (k + 1) * most)] as data, least(most, n - k * most) as size, k * most // block as pts
  from (select *, unnest(range(0, (n + most - 1) // most)) as k from cut where n > 0))"""
_EVENTS = """event_packets as (select event_id, user_id % 7 as stream_id, epoch_us(ts) - 1704067200000000 as pts, floor(value)::bigint as size, event_type from events)"""
_STREAMS = "streams as (select * from (values " + ", ".join(f"({i}::bigint, {d}::bigint, '{k}', '{x}')" for i, d, k, x in fx.STREAMS) + ") t(index, id, kind, codec))"


def _list(values, kind: str = "") -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}{kind}" for v in values) + "]"


_JOBS = f"""jobs as (select o_orderkey as job_id, 'dir.d/in_' || o_orderkey || '.' || ({_list(fx.EXTENSIONS)})[o_orderkey % 21 + 1] as input,
 'out/' || o_orderkey || '.' || ({_list(fx.EXTENSIONS)})[o_custkey % 21 + 1] as output,
 {", ".join(f"({_list(fx.TOKENS)})[(o_orderkey * {a} + o_custkey * {b}) % {len(fx.TOKENS)} + 1] as {name}" for name, a, b in fx.TOKEN_OF)} from orders)"""
_FORMATS = f"""formats as (select p_partkey, (p_size % 10)::bigint as channels, ({_list(fx.RATES, '::bigint')})[p_partkey % 10 + 1] as sample_rate,
 ({_list(fx.DEPTHS, '::bigint')})[p_partkey % 7 + 1] as bit_depth, ({_list(fx.CODES, '::bigint')})[p_partkey // 10 % 4 + 1] as format_code from part)"""
_FRAMES = "frames as (select vec_id, label::bigint as stream_id, vec_id % 4 + 1 as g, embedding as samples from embeddings)"


def _le(value: str, n: int) -> str:
    """Hex digits of a number's low bytes, least significant first."""
    h = f"lpad(to_hex(({value})::ubigint), 16, '0')"
    return "(" + " || ".join(f"substr({h}, {17 - 2 * i}, 2)" for i in range(1, n + 1)) + ")"


def _u(digits: str, at: int, n: int) -> str:
    """A number of n bytes at 0-based ``at`` of hex digits, least significant first."""
    return "('0x' || " + " || ".join(f"substr({digits}, {2 * (at + i) + 1}, 2)" for i in reversed(range(n))) + ")::ubigint::bigint"


def _codec(depth: str) -> str:
    return f"case {depth} when 24 then 'pcm_s24le' when 32 then 'pcm_f32le' else 'pcm_s16le' end"


_BYTE_RATE = "least(sample_rate::hugeint * (bit_depth // 8) * channels, 4294967295)::bigint"

# --- Packets ------------------------------------------------------------------------------------------


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ("doc_id", "path", "depth", "channels", "sample_rate")
    return pk.packetize(fx.raw_files(spark, sf_dir), "content", c("depth"), c("channels"), LIMIT, keep)


@query(f"with {_PACKETS} select doc_id, k, size, pts, md5(data) as data_md5, 0::bigint as dts, sample_rate as time_den, false as keyframe from packets")
def packetize(spark, sf_dir):
    rows = pk.packet_rows(_packets(spark, sf_dir), c("sample_rate"))
    return rows.select("doc_id", "k", "size", "pts", F.md5("data").alias("data_md5"), "dts", c("time.den").alias("time_den"), "keyframe")


@query(f"with {_RAW} select doc_id, octet_length(content)::bigint as size, octet_length(content) = 0 as is_empty from raw_files")
def packet_size(spark, sf_dir):
    n = F.octet_length("content").cast("long")
    return fx.raw_files(spark, sf_dir).select("doc_id", n.alias("size"), (n == 0).alias("is_empty"))


@query(f"""with {_PACKETS} select doc_id, k, pts, size // block as samples, channels, sample_rate as rate,
 'Frame ' || k || ': pts=' || pts || ', samples=' || (size // block) || ', channels=' || channels || ', rate=' || sample_rate as line from packets""")
def inspect_frames(spark, sf_dir):
    return pk.inspect(_packets(spark, sf_dir), c("depth"), c("channels"), c("sample_rate"), ("doc_id",))


@query(f"with {_PACKETS.replace(str(LIMIT), str(pk.PACKET_BYTES))} select doc_id, k, size, pts, md5(data) as data_md5 from packets")
def packetize_64k(spark, sf_dir):
    """Packets of the size that files are read in."""
    rows = pk.packetize(fx.raw_files(spark, sf_dir), "content", c("depth"), c("channels"), pk.PACKET_BYTES, ("doc_id",))
    return rows.select("doc_id", "k", "size", "pts", F.md5("data").alias("data_md5"))


@query(f"with {_RAW} select path, md5(content) as data_md5, octet_length(content)::bigint as data_size from raw_files where octet_length(content) > 0")
def mux_concat(spark, sf_dir):
    return pk.mux(_packets(spark, sf_dir), "path").select("path", F.md5("data").alias("data_md5"), F.octet_length("data").cast("long").alias("data_size"))


@query(f"with {_PACKETS} select path, count(*) as n_packets, sum(size)::bigint as data_size, sum(size)::bigint + 36 as riff_size from packets group by path")
def wav_sizes(spark, sf_dir):
    return pk.sizes(_packets(spark, sf_dir), "path", c("size"))


@query("""select doc_id, (8 + case when source is null then 0 else 8 + octet_length(encode(source)) + 1 + (octet_length(encode(source)) + 1) % 2 end
 + 8 + octet_length(encode(text)) + 1 + (octet_length(encode(text)) + 1) % 2
 + 8 + octet_length(encode(lang)) + 1 + (octet_length(encode(lang)) + 1) % 2)::bigint as list_size from documents""")
def list_size(spark, sf_dir):
    m = F.create_map(F.lit("artist"), c("source"), F.lit("title"), c("text"), F.lit("genre"), c("lang"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", formats.list_size(m).alias("list_size"))


@query("""select doc_id, source as artist, md5(rtrim(text, chr(0))) as title_md5, 3::bigint as n_fields from documents""")
def metadata_map(spark, sf_dir):
    m = F.map_from_arrays(F.array(F.lit("artist"), F.lit("title"), F.lit("genre")), F.array(c("source"), F.rtrim(c("text"), F.lit("\0")), c("lang")))
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", m.alias("m"))
    return rows.select("doc_id", c("m")["artist"].alias("artist"), F.md5(c("m")["title"]).alias("title_md5"), F.size("m").cast("long").alias("n_fields"))


# --- Header bytes -------------------------------------------------------------------------------------

_HEADER = (
    "'52494646' || '00000000' || '57415645666D7420' || " + _le("case format_code when 3 then 18 when 17 then 20 else 16 end", 4) + " || " + _le("format_code", 2) + " || " + _le("channels", 2)
    + " || " + _le("sample_rate", 4) + " || " + _le(_BYTE_RATE, 4) + " || " + _le("bit_depth // 8 * channels", 2) + " || " + _le("bit_depth", 2)
    + " || case format_code when 3 then '0000' when 17 then '0400' || " + _le("(512 - 4 * channels) * 2 + 1", 2) + " else '' end || '64617461' || '00000000'"
)


@query(f"with {_FORMATS} select p_partkey, {_HEADER} as header_hex from formats")
def wav_header_bytes(spark, sf_dir):
    data = formats.header_bytes(c("channels"), c("sample_rate"), c("bit_depth"), c("format_code"))
    return fx.formats(spark, sf_dir).select("p_partkey", F.hex(data).alias("header_hex"))


@query(f"""with {_FORMATS} select p_partkey, case format_code when 3 then 18 when 17 then 20 else 16 end::bigint as fmt_size, format_code, channels, sample_rate,
 {_BYTE_RATE} as byte_rate, bit_depth // 8 * channels as block_align, bit_depth as bits_per_sample, 0::bigint as data_size from formats""")
def wav_header(spark, sf_dir):
    rows = fx.formats(spark, sf_dir).select("p_partkey", formats.header_bytes(c("channels"), c("sample_rate"), c("bit_depth"), c("format_code")).alias("head"))
    return rows.select("p_partkey", *(v.alias(k) for k, v in formats.parse_header(c("head")).items()))


@query(f"""with {_FORMATS} select p_partkey, case when channels = 0 then 'channels must be non-zero' when sample_rate = 0 then 'sample rate must be non-zero'
 when format_code in (1, 3) then case when bit_depth = 0 then 'bits per sample must be non-zero' when bit_depth % 8 <> 0 then 'bits per sample must be multiple of 8' end
 when format_code = 17 then case when bit_depth <> 4 then 'IMA ADPCM must have 4 bits per sample' end
 else 'audio format code ' || format_code || ' is not supported' end as error from formats""")
def validate_header(spark, sf_dir):
    return fx.formats(spark, sf_dir).select("p_partkey", formats.header_error(c("channels"), c("sample_rate"), c("format_code"), c("bit_depth")).alias("error"))


# --- Decoding and encoding ----------------------------------------------------------------------------

#: A packet's float samples times 2^23, as whole numbers: exact in every depth but for floats, which are summed by class.
_PCM = """words as (select doc_id, generate_subscripts(w, 1) as i, unnest(w) as q from (select doc_id, regexp_extract_all(hex(content), '{dots}') as w from {source} where {where}))"""


def _int_words(depth: int) -> str:
    n = depth // 8
    bits = "('0x' || " + " || ".join(f"substr(q, {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::bigint"
    return f"(case when {bits} >= {1 << (depth - 1)} then {bits} - {1 << depth} else {bits} end)"


def _decoded(depth: int) -> str:
    return f"with {_RAW}, " + _PCM.format(dots="." * (depth // 4), source="raw_files", where=f"octet_length(content) % {depth // 8} = 0")


def _every_file(depth: int, sums: str, select: str) -> str:
    """Each file with its sums, or with the error of its length."""
    return f""", sums as ({sums}) select r.doc_id, case when octet_length(content) % {depth // 8} <> 0 then 'invalid pcm{depth} length' end as error, {select} from raw_files r left join sums s using (doc_id)"""


def _none_as_zero(name: str, depth: int) -> str:
    return f"case when octet_length(content) % {depth // 8} = 0 then coalesce({name}, 0)::bigint end as {name}"


def _sums(values: Column) -> list[Column]:
    zero = F.lit(0).cast("long")
    return [F.size(values).cast("long").alias("n"), F.aggregate(values, zero, lambda a, v: a + v).alias("total"), F.array_min(values).cast("long").alias("lowest"), F.array_max(values).cast("long").alias("highest")]


def _decode_ints(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    scale = pcm.SCALE[depth]
    rows = fx.raw_files(spark, sf_dir).select("doc_id", pcm.length_error(c("content"), F.lit(depth)).alias("error"), pcm.to_floats(c("content"), F.lit(depth)).alias("f"))
    whole = F.transform("f", lambda v: (v.cast("double") * scale).cast("long"))
    return rows.select("doc_id", "error", whole.alias("v")).select("doc_id", "error", *(F.when(c("error").isNull(), x).alias(name) for name, x in zip(("n", "total", "lowest", "highest"), _sums(c("v")), strict=True)))


_SUMS = "count(*) as n, sum(v)::bigint as total, min(v)::bigint as lowest, max(v)::bigint as highest"


@query(_decoded(16) + _every_file(16, f"select doc_id, {_SUMS} from (select doc_id, {_int_words(16)} as v from words) group by doc_id", f"{_none_as_zero('n', 16)}, {_none_as_zero('total', 16)}, lowest, highest"))
def pcm16_decode(spark, sf_dir):
    return _decode_ints(spark, sf_dir, 16)


@query(_decoded(24) + _every_file(24, f"select doc_id, {_SUMS} from (select doc_id, {_int_words(24)} as v from words) group by doc_id", f"{_none_as_zero('n', 24)}, {_none_as_zero('total', 24)}, lowest, highest"))
def pcm24_decode(spark, sf_dir):
    return _decode_ints(spark, sf_dir, 24)


_F32_BITS = "('0x' || substr(q, 7, 2) || substr(q, 5, 2) || substr(q, 3, 2) || substr(q, 1, 2))::bigint"
_F32_CLASSES = """count(*) as n, count(*) filter (e = 255) as special, count(*) filter (e < 127 and e > 0) as below_one, count(*) filter (e = 0) as tiny,
 sum(case when e between 118 and 133 then (case when b >= 2147483648 then -1 else 1 end * trunc((1 + (b % 8388608) / 8388608.0) * pow(2.0, e - 127) * 65536))::bigint else 0 end)::bigint as middle"""


@query(_decoded(32) + _every_file(32, f"select doc_id, {_F32_CLASSES} from (select doc_id, b, b // 8388608 % 256 as e from (select doc_id, {_F32_BITS} as b from words)) group by doc_id", ", ".join(_none_as_zero(x, 32) for x in ("n", "special", "below_one", "tiny", "middle"))))
def pcm32_decode(spark, sf_dir):
    rows = fx.raw_files(spark, sf_dir).select("doc_id", pcm.length_error(c("content"), F.lit(32)).alias("error"), pcm.to_floats(c("content"), F.lit(32)).alias("v"))
    known = lambda x: F.when(c("error").isNull(), x)
    count = lambda test: known(F.size(F.filter("v", test))).cast("long")
    size = lambda v: F.abs(v.cast("double"))
    middle = F.transform(F.filter("v", lambda v: (size(v) >= 2.0**-9) & (size(v) < 128)), lambda v: (v.cast("double") * 65536).cast("long"))
    return rows.select(
        "doc_id", "error", known(F.size("v")).cast("long").alias("n"), count(lambda v: F.isnan(v) | (size(v) == float("inf"))).alias("special"), count(lambda v: (size(v) < 1) & (size(v) >= 2.0**-126)).alias("below_one"),
        count(lambda v: size(v) < 2.0**-126).alias("tiny"), F.aggregate(middle, F.lit(0).cast("long"), lambda a, v: a + v).alias("middle"),
    )


@query(f"""with {_PACKETS} select doc_id, k, pts, case depth when 24 then 'PCM24' when 32 then 'PCM32' else 'PCM16' end as format, size // block as nb_samples,
 case when size % (depth // 8) = 0 then size // (depth // 8) end as n_values, case when size % (depth // 8) <> 0 then 'invalid pcm' || depth || ' length' end as error from packets""")
def pcm_decode(spark, sf_dir):
    rows = pk.decode(_packets(spark, sf_dir), c("depth"), c("channels"))
    return rows.select("doc_id", "k", "pts", "format", "nb_samples", F.when(c("samples").isNotNull(), F.size("samples")).cast("long").alias("n_values"), "error")


@query(f"""with {_FRAMES} select vec_id, len(samples)::bigint * 2 as n_bytes, md5(string_agg(h, '' order by i)) as hex_md5 from (select vec_id, samples, i,
 {_le("(v + 65536) % 65536", 2)} as h from (select vec_id, samples, i, (case when isnan(samples[i]) then 0 else trunc(greatest(least((samples[i]::double * g)::float::double * 32768, 32767), -32768)) end)::bigint as v
 from (select *, unnest(range(1, len(samples) + 1)) as i from frames))) group by vec_id, samples""")
def pcm_encode(spark, sf_dir):
    loud = fr.apply(fx.frames_f32(spark, sf_dir), lambda s: F.transform(s, lambda x: (x.cast("double") * c("g")).cast("float")))
    rows = pk.encode(loud, F.lit(16))
    return rows.select("vec_id", F.octet_length("data").cast("long").alias("n_bytes"), F.md5(F.hex("data")).alias("hex_md5"))


def _pack_floats(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    loud = fx.frames_f32(spark, sf_dir).select("vec_id", F.transform("samples", lambda x: (x.cast("double") * c("g")).cast("float")).alias("s"))
    return loud.select("vec_id", F.md5(F.hex(pcm.from_floats(c("s"), F.lit(depth)))).alias("hex_md5"))


def _packed_sql(value: str, n: int) -> str:
    return f"""with {_FRAMES} select vec_id, md5(string_agg(h, '' order by i)) as hex_md5 from (select vec_id, i, {_le("v", n)} as h from (select vec_id, i, {value} as v
 from (select vec_id, i, (samples[i]::double * g)::float as x from (select *, unnest(range(1, len(samples) + 1)) as i from frames)))) group by vec_id"""


def _clamped(scale: int) -> str:
    return f"((case when isnan(x) then 0 else trunc(greatest(least(x::double * {scale}, {scale - 1}), -{scale})) end)::bigint + {2 * scale}) % {2 * scale}"


@query(_packed_sql(_clamped(32768), 2))
def f32_to_pcm16(spark, sf_dir):
    return _pack_floats(spark, sf_dir, 16)


@query(_packed_sql(_clamped(8388608), 3))
def f32_to_pcm24(spark, sf_dir):
    return _pack_floats(spark, sf_dir, 24)


#: Bits of a clamped float: exponent and fraction by arithmetic. No sample of the table is below 2^-126.
_FLOAT_BITS = """(case when y = 0 then 0 else case when y < 0 then 2147483648 else 0 end + (floor(log2(abs(y)))::bigint + 127) * 8388608
 + ((abs(y) / pow(2.0, floor(log2(abs(y)))) - 1) * 8388608)::bigint end)"""


@query(f"""with {_FRAMES} select vec_id, md5(string_agg(h, '' order by i)) as hex_md5 from (select vec_id, i, {_le("v", 4)} as h from (select vec_id, i, {_FLOAT_BITS} as v
 from (select vec_id, i, greatest(least((samples[i]::double * g)::float, 1), -1)::double as y from (select *, unnest(range(1, len(samples) + 1)) as i from frames)))) group by vec_id""")
def f32_to_pcm32(spark, sf_dir):
    return _pack_floats(spark, sf_dir, 32)


@query(f"""with {_RAW} select doc_id, depth, case when octet_length(content) % (depth // 8) <> 0 then 'invalid pcm' || depth || ' length' end as error,
 case when octet_length(content) % (depth // 8) = 0 then octet_length(content)::bigint // (depth // 8) end as n_values from raw_files""")
def pcm_to_f32(spark, sf_dir):
    rows = fx.raw_files(spark, sf_dir).withColumn("f", pcm.to_floats(c("content"), c("depth").cast("int")))
    return rows.select("doc_id", "depth", pcm.length_error(c("content"), c("depth")).alias("error"), F.when(c("f").isNotNull(), F.size("f")).cast("long").alias("n_values"))


@query(_decoded(16) + _every_file(16, "select doc_id, md5(string_agg('00' || q, '' order by i)) as hex_md5, count(*) * 3 as n_bytes from words group by doc_id", "hex_md5, n_bytes") + " where octet_length(content) > 0")
def pcm_transcode(spark, sf_dir):
    files = fx.raw_files(spark, sf_dir).select("doc_id", c("content").alias("data"), pcm.length_error(c("content"), F.lit(16)).alias("error"))
    rows = pk.transcode(files, F.lit(16), F.lit(24))
    return rows.select("doc_id", "error", F.md5(F.hex("data")).alias("hex_md5"), F.octet_length("data").cast("long").alias("n_bytes"))


# --- Sample scalars -----------------------------------------------------------------------------------

_INT16 = "(l_orderkey * 7919 + l_linenumber * 104729) % 65536 - 32768"


def _bulk_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((c("l_orderkey") * 7919 + c("l_linenumber") * 104729) % 65536 - 32768).cast("int").alias("s"))


@query(f"select l_orderkey, l_linenumber, (({_INT16})::double / 32768 * 1073741824)::bigint as scaled from lineitem")
def normalize_pcm16(spark, sf_dir):
    return _bulk_ints(spark, sf_dir).select("l_orderkey", "l_linenumber", (pcm.normalize_16(c("s")).cast("double") * 1073741824).cast("long").alias("scaled"))


@query(f"select l_orderkey, l_linenumber, (({_INT16})::double / 8388608 * 1073741824)::bigint as scaled from lineitem")
def normalize_pcm24(spark, sf_dir):
    return _bulk_ints(spark, sf_dir).select("l_orderkey", "l_linenumber", (pcm.normalize_24(c("s") * 256).cast("double") * 1073741824).cast("long").alias("scaled"))


_BULK = "bulk as (select l_orderkey as stream_id, l_linenumber as pts, ((l_discount * 20 - 1)::float * 1.5)::float as v from lineitem)"


def _loud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.bulk_samples(spark, sf_dir).withColumn("v", (c("v") * F.lit(1.5)).cast("float"))


@query(f"with {_BULK} select stream_id, pts, trunc(greatest(least(v::double * 32768, 32767), -32768))::integer as sample from bulk")
def denormalize_pcm16(spark, sf_dir):
    return _loud(spark, sf_dir).select("stream_id", "pts", pcm.denormalize_16(c("v")).alias("sample"))


@query(f"with {_BULK} select stream_id, pts, (trunc(greatest(least(v::double * 8388608, 8388607), -8388608))::bigint * 256)::integer as sample from bulk")
def denormalize_pcm24(spark, sf_dir):
    return _loud(spark, sf_dir).select("stream_id", "pts", pcm.denormalize_24(c("v")).alias("sample"))


@query(f"with {_BULK} select stream_id, pts, trunc(greatest(least(v, 1::float), -1::float)::double * 16777216)::bigint as scaled from bulk")
def clamp_f32(spark, sf_dir):
    return _loud(spark, sf_dir).select("stream_id", "pts", (pcm.clamp(c("v")).cast("double") * 16777216).cast("long").alias("scaled"))


# --- Formats, channels, frames ------------------------------------------------------------------------


@query(f"""with {_JOBS} select job_id, codec, case codec when 'pcm_s16le' then 16 when 'pcm_s24le' then 24 when 'pcm_f32le' then 32 end as depth,
 case when codec not in ('pcm_s16le', 'pcm_s24le', 'pcm_f32le') then 'wav codec ''' || codec || ''' is not supported' end as error,
 case when codec not in ('pcm_s16le', 'pcm_s24le', 'pcm_f32le') then 'raw codec ''' || codec || ''' is not supported' end as raw_error
 from (select job_id, substr(tok1, 7) as codec from jobs where tok1 like 'codec=%')""")
def codec_format(spark, sf_dir):
    rows = fx.jobs(spark, sf_dir).filter(c("tok1").startswith("codec=")).select("job_id", F.expr("substr(tok1, 7)").alias("codec"))
    return rows.select("job_id", "codec", formats.codec_depth(c("codec")).alias("depth"), formats.codec_error("wav", c("codec")).alias("error"), formats.codec_error("raw", c("codec")).alias("raw_error"))


@query(f"""with {_FORMATS} select p_partkey, bit_depth // 8 as bytes_per_sample, bit_depth // 8 * channels as bytes_per_frame, bit_depth // 8 * channels as block_align,
 case bit_depth when 24 then 'PCM24' when 32 then 'PCM32' else 'PCM16' end as audio_format, {_codec("bit_depth")} as codec from formats""")
def format_math(spark, sf_dir):
    d, ch = c("bit_depth"), c("channels")
    return fx.formats(spark, sf_dir).select("p_partkey", formats.bytes_per_sample(d).alias("bytes_per_sample"), formats.bytes_per_frame(d, ch).alias("bytes_per_frame"), formats.bytes_per_frame(d, ch).alias("block_align"), formats.audio_format(d).alias("audio_format"), formats.codec_string(d).alias("codec"))


@query(f"with {_FORMATS} select p_partkey, {_BYTE_RATE} as byte_rate from formats")
def byte_rate(spark, sf_dir):
    return fx.formats(spark, sf_dir).select("p_partkey", formats.byte_rate(c("sample_rate"), c("bit_depth"), c("channels")).alias("byte_rate"))


@query(f"""with {_FORMATS}, asked as (select *, (['pcm_s16le', 'pcm_s24le', 'pcm_f32le', 'aac'])[p_partkey % 4 + 1] as codec from formats)
 select p_partkey, codec, case codec when 'pcm_s16le' then 16 when 'pcm_s24le' then 24 when 'pcm_f32le' then 32 else bit_depth end::bigint as bit_depth,
 case codec when 'pcm_f32le' then 3 else format_code end::bigint as format_code from asked""")
def apply_codec(spark, sf_dir):
    asked = fx.formats(spark, sf_dir).withColumn("codec", fx._pick(["pcm_s16le", "pcm_s24le", "pcm_f32le", "aac"], c("p_partkey") % 4))
    return asked.select("p_partkey", "codec", formats.applied_depth(c("codec"), c("bit_depth")).cast("long").alias("bit_depth"), formats.applied_code(c("codec"), c("format_code")).cast("long").alias("format_code"))


@query(f"""with {_FORMATS} select p_partkey, channels as count, case channels when 1 then 'mono' when 2 then 'stereo' when 4 then 'quad' when 6 then '5.1' when 8 then '7.1' else channels || ' channels' end as name,
 case channels when 1 then 'Mono' when 2 then 'Stereo' when 4 then 'Quad' when 6 then 'Surround' when 8 then 'SevenPointOne' else 'Custom' end as variant from formats""")
def channel_layout(spark, sf_dir):
    return fx.formats(spark, sf_dir).select("p_partkey", c("channels").alias("count"), media.layout_name(c("channels")).alias("name"), media.layout_variant(c("channels")).alias("variant"))


_AUDIO_FORMATS = ["PCM16", "PCM24", "PCM32", "FLAC", "AAC", "OPUS", "ADPCM"]


@query(f"""with {_RAW}, typed as (select *, octet_length(content) as n, ({_list(_AUDIO_FORMATS)})[doc_id % 7 + 1] as format from raw_files),
 sized as (select *, case format when 'PCM16' then 2 when 'PCM24' then 3 when 'PCM32' then 4 end::bigint as sample_bytes from typed)
 select doc_id, format, sample_bytes, coalesce(n // (sample_bytes * channels), 0)::bigint as nb_samples, sample_bytes * channels * (n // (sample_bytes * channels)) as frame_size, sample_bytes is null as is_compressed from sized""")
def audio_frame_info(spark, sf_dir):
    rows = fx.raw_files(spark, sf_dir).withColumn("format", fx._pick(_AUDIO_FORMATS, c("doc_id") % 7))
    per, n = media.sample_bytes(c("format")), media.nb_samples(F.octet_length("content"), c("format"), c("channels"))
    return rows.select("doc_id", "format", per.alias("sample_bytes"), n.alias("nb_samples"), (per * c("channels") * n).alias("frame_size"), per.isNull().alias("is_compressed"))


@query(f"""with {_RAW} select doc_id, octet_length(content)::bigint // (depth // 8 * channels) as frames, round(octet_length(content)::bigint // (depth // 8 * channels) / sample_rate::double, 9) as duration,
 sample_rate * channels * depth // 1000 as kbps from raw_files""")
def wav_info(spark, sf_dir):
    n = F.floor(F.octet_length("content") / formats.bytes_per_frame(c("depth"), c("channels")))
    return fx.raw_files(spark, sf_dir).select("doc_id", n.alias("frames"), F.round(n / c("sample_rate"), 9).alias("duration"), F.floor(c("sample_rate") * c("channels") * c("depth") / 1000).alias("kbps"))


_VIDEO_FORMATS = ["RGB24", "RGBA32", "YUV420", "YUV422", "YUV444", "GRAY8"]
_VIDEO_SIZE = "case {f} when 'RGB24' then 3 * w * h when 'RGBA32' then 4 * w * h when 'YUV444' then 3 * w * h when 'GRAY8' then w * h when 'YUV420' then w * h * 3 // 2 else w * h * 2 end"


@query(f"""select p_partkey, format, case format when 'RGB24' then 3 when 'RGBA32' then 4 when 'YUV444' then 3 when 'GRAY8' then 1 end::bigint as pixel_bytes, ({_VIDEO_SIZE.format(f="format")})::bigint as expected
 from (select p_partkey, ({_list(_VIDEO_FORMATS)})[p_partkey % 6 + 1] as format, p_size::bigint * 37 as w, (p_partkey % 1081 + 1) as h from part)""")
def video_frame_size(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", fx._pick(_VIDEO_FORMATS, c("p_partkey") % 6).alias("format"), (c("p_size").cast("long") * 37).alias("w"), (c("p_partkey") % 1081 + 1).alias("h"))
    return rows.select("p_partkey", "format", media.pixel_bytes(c("format")).alias("pixel_bytes"), media.video_size(c("format"), c("w"), c("h")).alias("expected"))


@query(f"""select doc_id, w, h, n = ({_VIDEO_SIZE.format(f="format")}) as valid from (select doc_id, octet_length(encode(text)) as n, ({_list(_VIDEO_FORMATS)})[doc_id % 6 + 1] as format,
 case when doc_id % 6 = 5 then octet_length(encode(text)) else 8 + doc_id % 50 end::bigint as w, case when doc_id % 6 = 5 then 1 else 8 end::bigint as h from documents)""")
def video_frame_valid(spark, sf_dir):
    grey, n = c("doc_id") % 6 == 5, F.octet_length("text").cast("long")
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), fx._pick(_VIDEO_FORMATS, c("doc_id") % 6).alias("format"), F.when(grey, n).otherwise(8 + c("doc_id") % 50).alias("w"), F.when(grey, 1).otherwise(8).cast("long").alias("h"))
    return rows.select("doc_id", "w", "h", (c("n") == media.video_size(c("format"), c("w"), c("h"))).alias("valid"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as frames of the three kinds in turn."""
    kind = fx._pick(list(st.KINDS), c("doc_id") % 3)
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.encode("text", "UTF-8").alias("data"))
    return rows.withColumns(fr.union_columns(c("kind"), c("data"), F.lit("PCM16"), F.lit("GRAY8"), F.lit("SRT"))).drop("data")


_KINDS = "kinds as (select doc_id, (['audio', 'video', 'subtitle'])[doc_id % 3 + 1] as kind, octet_length(encode(text))::bigint as n from documents)"


@query(f"with {_KINDS} select doc_id, kind, case kind when 'audio' then 'PCM16' end as audio_format, case kind when 'video' then n end as video_bytes, case kind when 'subtitle' then n end as subtitle_bytes from kinds")
def frame_union(spark, sf_dir):
    n = lambda k: F.octet_length(c(f"{k}.data")).cast("long").alias(f"{k}_bytes")
    return _frames(spark, sf_dir).select("doc_id", "kind", c("audio.format").alias("audio_format"), n("video"), n("subtitle"))


@query(f"with {_KINDS} select doc_id, n as size from kinds where kind = 'video'")
def frame_kind_filter(spark, sf_dir):
    return _frames(spark, sf_dir).filter("kind = 'video'").select("doc_id", F.octet_length("video.data").cast("long").alias("size"))


@query(f"with {_KINDS} select doc_id, n as size, n = 0 as is_empty from kinds")
def frame_size(spark, sf_dir):
    return _frames(spark, sf_dir).select("doc_id", fr.frame_size().alias("size"), (fr.frame_size() == 0).alias("is_empty"))


# --- Streams and their packets ------------------------------------------------------------------------


@query(f"with {_EVENTS}, {_STREAMS} select s.index, s.id, s.kind, s.codec, count(e.event_id) as n_packets, coalesce(sum(e.size), 0)::bigint as n_bytes from streams s left join event_packets e on e.stream_id = s.index group by all")
def streams(spark, sf_dir):
    per = fx.event_packets(spark, sf_dir).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    rows = fx.streams(spark).join(per, c("index") == c("stream_id"), "left")
    return rows.select("index", "id", "kind", "codec", F.coalesce("n", F.lit(0)).cast("long").alias("n_packets"), F.coalesce("b", F.lit(0)).cast("long").alias("n_bytes"))


@query(f"with {_EVENTS}, {_STREAMS} select s.kind, s.index, row_number() over (partition by s.kind order by s.index) as nth, count(*) as n_packets from streams s join event_packets e on e.stream_id = s.index group by s.kind, s.index")
def streams_by_kind(spark, sf_dir):
    from pyspark.sql import Window

    per = st.with_stream(fx.event_packets(spark, sf_dir), fx.streams(spark)).groupBy(c("stream_kind").alias("kind"), c("stream_id").alias("index")).agg(F.count(F.lit(1)).alias("n_packets"))
    return per.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("index")).cast("long")).select("kind", "index", "nth", "n_packets")


@query(f"with {_EVENTS}, {_STREAMS} select event_type, count(distinct s.index) filter (s.kind = 'audio') as n_audio, count(*) filter (s.kind = 'audio') as n_packets from event_packets e join streams s on e.stream_id = s.index group by event_type")
def count_audio(spark, sf_dir):
    rows = st.with_stream(fx.event_packets(spark, sf_dir), fx.streams(spark))
    audio = c("stream_kind") == "audio"
    return rows.groupBy("event_type").agg(F.countDistinct(F.when(audio, c("stream_id"))).alias("n_audio"), F.count_if(audio).alias("n_packets"))


@query(f"""with {_EVENTS}, {_STREAMS}, l as (select event_type, s.index, 'stream ' || s.index || ' (' || upper(s.kind[1]) || s.kind[2:] || ') [' || codec || ']' as line from event_packets e join streams s on e.stream_id = s.index group by all)
 select event_type, string_agg(line, chr(10) order by index) || chr(10) as listing from l group by event_type""")
def stream_display(spark, sf_dir):
    rows = st.with_stream(fx.event_packets(spark, sf_dir), fx.streams(spark)).select("event_type", "stream_id", "stream_kind", "codec").distinct()
    line = F.struct("stream_id", st.stream_line(c("stream_id"), c("stream_kind"), c("codec")).alias("line"))
    lines = rows.groupBy("event_type").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return lines.select("event_type", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("listing"))


@query(f"with {_EVENTS}, {_STREAMS} select event_id, pts, size, s.id as track_id, s.kind as stream_kind, s.codec from event_packets e join streams s on e.stream_id = s.index")
def packet_stream_join(spark, sf_dir):
    return st.with_stream(fx.event_packets(spark, sf_dir), fx.streams(spark)).select("event_id", "pts", "size", "track_id", "stream_kind", "codec")


def _of_kind(kind: str) -> Query:
    def run(spark, sf_dir):
        return st.packets_of_kind(fx.event_packets(spark, sf_dir), fx.streams(spark), kind).select("event_id", "stream_id", "pts", "size")

    run.__name__ = f"{kind}_packets"
    sql = f"with {_EVENTS}, {_STREAMS} select event_id, stream_id, pts, size from event_packets where stream_id in (select index from streams where kind = '{kind}')"
    return query(sql)(run)


audio_packets, video_packets, subtitle_packets = map(_of_kind, st.KINDS)

# --- Time ---------------------------------------------------------------------------------------------

_RATE = "([8000, 44100, 48000, 90000, 1000000])[event_id % 5 + 1]::bigint"


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = fx._pick([8000, 44100, 48000, 90000, 1000000], c("event_id") % 5).cast("long")
    return fx.event_packets(spark, sf_dir).select("event_id", "pts", (c("event_id") % 3 + 1).alias("num"), rate.alias("den"))


#: Small, negative and very large ticks in turn.
_WIDE = "(case event_id % 4 when 1 then -pts when 2 then pts * 100000 when 3 then -pts * 99991 else pts end)"
_LOW_64 = "(case when low >= 9223372036854775808::hugeint then low - 18446744073709551616::hugeint else low end)::bigint"


def _wide_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticks(spark, sf_dir).withColumn("pts", F.expr(_WIDE))


_TICKS = f"ticks as (select event_id, epoch_us(ts) - 1704067200000000 as pts, event_id % 3 + 1 as num, {_RATE} as den from events)"


@query(f"with {_TICKS} select event_id, trunc(pts::double * num / den * 64)::bigint as seconds_64 from ticks")
def pts_to_seconds(spark, sf_dir):
    return _ticks(spark, sf_dir).select("event_id", (timebase.to_seconds(c("pts"), c("num"), c("den")) * 64).cast("long").alias("seconds_64"))


@query(f"with {_TICKS} select event_id, trunc((pts / 1000000) * den / num)::bigint as ticks from ticks")
def seconds_to_pts(spark, sf_dir):
    return _ticks(spark, sf_dir).select("event_id", timebase.from_seconds(c("pts") / F.lit(1000000), c("num"), c("den")).alias("ticks"))


#: Every seventh row has the largest numbers there are, of either sign.
_EDGE = "(event_id % 7 = 6)"
_EDGES = f"edges as (select event_id, case when {_EDGE} then (case when event_id % 2 = 0 then 9223372036854775807 else -9223372036854775807 - 1 end) else {_WIDE} end as pts, num, case when {_EDGE} then 4294967295 else den end as den, case when {_EDGE} then 4294967295 else 3 end as to_num, case when {_EDGE} then event_id % 4 + 1 else 1000 end as to_den from ticks)"


@query(f"""with {_TICKS}, {_EDGES} select event_id, {_LOW_64} as scaled from (select event_id, (x % 18446744073709551616::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint as low
 from (select event_id, pts::hugeint * to_num // to_den * den // num as x from edges))""")
def scale_pts(spark, sf_dir):
    edge = F.expr(_EDGE)
    rows = _wide_ticks(spark, sf_dir).withColumns({
        "pts": F.when(edge, F.when(c("event_id") % 2 == 0, F.lit(timebase.LONG_MAX)).otherwise(F.lit(timebase.LONG_MIN))).otherwise(c("pts")), "den": F.when(edge, 4294967295).otherwise(c("den")),
        "to_num": F.when(edge, 4294967295).otherwise(3), "to_den": F.when(edge, c("event_id") % 4 + 1).otherwise(1000),
    })
    return rows.select("event_id", timebase.scale(c("pts"), c("num"), c("den"), c("to_num"), c("to_den")).alias("scaled"))


_LARGE = "case when {edge} then 4294967295 - event_id % {n} else {rest} end"
_FAR = {"num": _LARGE.format(edge=_EDGE, n=5, rest="num"), "to_den": _LARGE.format(edge=_EDGE, n=3, rest="1000"), "den": _LARGE.format(edge=f"({_EDGE} and event_id % 3 > 0)", n=11, rest="den"), "to_num": _LARGE.format(edge=f"({_EDGE} and event_id % 5 > 0)", n=4, rest="3")}
_END = f"case when {_EDGE} then (case when event_id % 2 = 0 then 9223372036854775807 else -9223372036854775807 - 1 end) // (event_id % 4 * 100 + 1) else {_WIDE} end"


@query(f"""with {_TICKS}, far as (select event_id, {_END} as pts, {", ".join(f"{v} as {k}" for k, v in _FAR.items())} from ticks)
 select event_id, try_cast(pts::hugeint * (num::hugeint * to_den) // (den::hugeint * to_num) as bigint) as rescaled from far""")
def rescale_pts(spark, sf_dir):
    rows = _wide_ticks(spark, sf_dir)
    end = F.expr("case when event_id % 2 = 0 then 9223372036854775807 else -9223372036854775807 - 1 end div (event_id % 4 * 100 + 1)")
    rows = rows.withColumns({"pts": F.when(F.expr(_EDGE), end).otherwise(c("pts"))} | {k: F.expr(v) for k, v in _FAR.items()})
    return rows.select("event_id", timebase.rescale(c("pts"), c("num"), c("den"), c("to_num"), c("to_den")).alias("rescaled"))


@query("select o_orderkey, gcd(o_orderkey * 12, o_custkey * 18) as divisor from orders")
def timebase_gcd(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", timebase.gcd(c("o_orderkey") * 12, c("o_custkey") * 18).alias("divisor"))


@query("select o_orderkey, o_orderkey * 12 // gcd(o_orderkey * 12, o_custkey * 18) as num, o_custkey * 18 // gcd(o_orderkey * 12, o_custkey * 18) as den from orders")
def timebase_simplify(spark, sf_dir):
    a, b = c("o_orderkey") * 12, c("o_custkey") * 18
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"), timebase.gcd(a, b).alias("g"))
    return rows.select("o_orderkey", F.floor(c("a") / c("g")).alias("num"), F.floor(c("b") / c("g")).alias("den"))


@query("select o_orderkey, o_orderkey % 4 > 0 and o_custkey % 3 > 0 as valid from orders")
def timebase_valid(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", timebase.valid(c("o_orderkey") % 4, c("o_custkey") % 3).alias("valid"))


# --- Containers and codecs ----------------------------------------------------------------------------

_EDGES = "edges as (select distinct * from (values " + ", ".join(f"('{a}', '{k}', '{x}')" for a, k, x in compat.edge_list()) + ") t(container, kind, codec))"
_ASKED = f"""{_JOBS}, asked as (select job_id, lower(regexp_extract(input, '\\.([^.]*)$', 1)) as container, (['audio', 'video', 'subtitle'])[job_id % 3 + 1] as kind,
 ({_list("pcm_s16le aac h264 srt vp9 mp3 mov_text opus".split())})[job_id % 8 + 1] as codec from jobs)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("job_id")
    return fx.jobs(spark, sf_dir).select(k, config.extension(c("input")).alias("container"), fx._pick(list(st.KINDS), k % 3).alias("kind"), fx._pick("pcm_s16le aac h264 srt vp9 mp3 mov_text opus".split(), k % 8).alias("codec"))


@query(f"with {_ASKED}, {_EDGES} select e.container, e.kind, e.codec, count(a.job_id) as n_asked from edges e left join asked a using (container, kind, codec) group by all")
def compat_edges(spark, sf_dir):
    asked = _asked(spark, sf_dir).groupBy("container", "kind", "codec").agg(F.count(F.lit(1)).alias("n"))
    return compat.edges(spark).join(asked, ["container", "kind", "codec"], "left").select("container", "kind", "codec", F.coalesce("n", F.lit(0)).cast("long").alias("n_asked"))


@query(f"with {_ASKED}, {_EDGES} select a.job_id, e.codec from asked a join edges e on a.container = e.container and a.kind = e.kind")
def compat_lookup(spark, sf_dir):
    known = F.broadcast(compat.edges(spark).withColumnRenamed("codec", "held"))
    return _asked(spark, sf_dir).join(known, ["container", "kind"]).select("job_id", c("held").alias("codec"))


@query(f"with {_ASKED} select job_id, container from asked where container in {tuple(compat.CONTAINERS)}")
def container_supported(spark, sf_dir):
    return _asked(spark, sf_dir).join(F.broadcast(compat.containers(spark)), "container", "left_semi").select("job_id", "container")


@query(f"with {_ASKED}, {_EDGES} select job_id, codec from asked a where exists (from edges e where e.container = a.container and e.kind = a.kind and e.codec = a.codec)")
def codec_supported(spark, sf_dir):
    return compat.supported(_asked(spark, sf_dir), spark).select("job_id", "codec")


@query(f"with {_ASKED}, {_EDGES} select job_id, codec from asked a where not exists (from edges e where e.container = a.container and e.kind = a.kind and e.codec = a.codec)")
def codec_unsupported(spark, sf_dir):
    return compat.unsupported(_asked(spark, sf_dir), spark).select("job_id", "codec")


@query(f"""with {_ASKED}, {_EDGES} select job_id, case when container not in {tuple(compat.CONTAINERS)} then '''' || container || ''' is not supported'
 when not exists (from edges e where e.container = a.container and e.kind = a.kind and e.codec = a.codec) then case kind when 'subtitle' then 'format' else 'codec' end || ' ''' || codec || ''' not supported in ''' || container || '''' end as error from asked a""")
def codec_check(spark, sf_dir):
    error = F.coalesce(*(F.when(c("kind") == k, compat.codec_error(c("container"), k, c("codec"))) for k in st.KINDS))
    return _asked(spark, sf_dir).select("job_id", error.alias("error"))


@query(f"""with {_JOBS}, {_EDGES}, asked as (select lower(regexp_extract(input, '\\.([^.]*)$', 1)) as source, lower(regexp_extract(output, '\\.([^.]*)$', 1)) as target, count(*) as n_jobs from jobs group by all),
 shared as (select a.container as source, b.container as target, count(*) as n_shared from edges a join edges b on a.kind = b.kind and a.codec = b.codec group by all)
 select source, target, n_jobs, coalesce(n_shared, 0) as n_shared from asked left join shared using (source, target)""")
def shared_codecs(spark, sf_dir):
    """Codecs that the containers of a job's input and output have in common, by pairs of containers."""
    a, b = compat.edges(spark).withColumnRenamed("container", "source"), compat.edges(spark).withColumnRenamed("container", "target")
    shared = a.join(b, ["kind", "codec"]).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_shared"))
    asked = fx.jobs(spark, sf_dir).groupBy(config.extension(c("input")).alias("source"), config.extension(c("output")).alias("target")).agg(F.count(F.lit(1)).alias("n_jobs"))
    return asked.join(F.broadcast(shared), ["source", "target"], "left").select("source", "target", "n_jobs", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))


# --- Options and plans --------------------------------------------------------------------------------

_TOKENS = "[tok1, tok2]"


def _option(key: str, tokens: str = _TOKENS, bare: bool = False) -> str:
    """The last value of a key, by DuckDB's list functions."""
    value = f"case when contains(t, '=') then substr(t, instr(t, '=') + 1) {'else ' + repr('true') if bare else ''} end"
    name = "case when contains(t, '=') then substr(t, 1, instr(t, '=') - 1) else t end"
    return f"list_filter(list_transform(list_filter({tokens}, lambda t: {name} = '{key}'), lambda t: {value}), lambda x: x is not null)[-1]"


def _track(tokens: str = _TOKENS, bare: bool = False) -> tuple[str, str]:
    v = _option("track", tokens, bare)
    number = f"case when regexp_full_match({v}, '\\+?[0-9]+') and {v}::varchar not in ('all', '*') then try_cast(replace({v}, '+', '') as ubigint)::decimal(20,0) end"
    return number, f"case when {v} not in ('all', '*') and ({number}) is null then 'invalid track: ' || {v} end"


def _config_sql(keys: tuple[str, ...], bare: bool = False, error: str | None = None) -> str:
    track, wrong = _track(bare=bare)
    return f"with {_JOBS} select job_id, {track} as track, {error or wrong} as error, " + ", ".join(f"{_option(k, bare=bare)} as {k}" for k in keys) + " from jobs"


def _tokens() -> Column:
    return F.array("tok1", "tok2")


@query(f"""with {_JOBS}, p as (select job_id, i, ([tok1, tok2])[i] as t from jobs, (values (1), (2)) x(i)), kv as (select job_id, i, case when contains(t, '=') then substr(t, 1, instr(t, '=') - 1) else t end as key,
 case when contains(t, '=') then substr(t, instr(t, '=') + 1) else 'true' end as value from p)
 select job_id, key, arg_max(value, i) as value from kv group by job_id, key""")
def parse_flags(spark, sf_dir):
    return fx.jobs(spark, sf_dir).select("job_id", F.explode(config.flags(config.pairs(_tokens(), bare=True))).alias("key", "value"))


@query(f"with {_JOBS} select job_id, {_track()[0]} as track, {_track()[1]} as error from jobs")
def parse_track(spark, sf_dir):
    track, error = config.track(config.pairs(_tokens()))
    return fx.jobs(spark, sf_dir).select("job_id", track.alias("track"), error.alias("error"))


def _config(spark: SparkSession, sf_dir: str, columns: dict[str, Column]) -> DataFrame:
    return fx.jobs(spark, sf_dir).select("job_id", *(v.alias(k) for k, v in columns.items()))


@query(_config_sql(config.AUDIO))
def parse_audio(spark, sf_dir):
    return _config(spark, sf_dir, config.config(_tokens(), config.AUDIO))


@query(_config_sql(config.VIDEO))
def parse_video(spark, sf_dir):
    return _config(spark, sf_dir, config.config(_tokens(), config.VIDEO))


_SUBTITLE_ERROR = f"coalesce({_track()[1]}, case when ({_track()[0]}) is null and {_option('language')} is null and coalesce({', '.join(_option(k) for k in config.SUBTITLE if k != 'language')}) is not null then 'subtitle needs track or language' end)"


@query(_config_sql(config.SUBTITLE, error=_SUBTITLE_ERROR))
def parse_subtitle(spark, sf_dir):
    return _config(spark, sf_dir, config.subtitle(_tokens()))


@query(_config_sql(config.TRANSFORM, bare=True))
def parse_transform(spark, sf_dir):
    return _config(spark, sf_dir, config.config(_tokens(), config.TRANSFORM, bare=True))


@query("""select o_orderkey, t.value as track, error from (select o_orderkey, case when error is null then case when track is null then range(0, n) else [track] end end as tracks, error
 from (select *, case when n = 0 then 'no streams' when track >= n then 'track ' || track || ' out of bounds (max ' || (n - 1) || ')' end as error
 from (select o_orderkey, o_custkey % 6 as n, case when o_orderkey % 3 > 0 then o_orderkey % 7 end as track from orders))) left join lateral (select unnest(tracks) as value) t on true""")
def track_resolve(spark, sf_dir):
    k = c("o_orderkey")
    rows = fx.table(spark, sf_dir, "orders").select(k, (c("o_custkey") % 6).alias("n"), F.when(k % 3 > 0, k % 7).alias("t"))
    tracks, error = st.resolved(c("t"), c("n"))
    return rows.select(k, F.explode_outer(tracks).alias("track"), error.alias("error"))


@query("select o_orderkey, case when o_orderkey % 3 > 0 then o_orderkey % 7 else 0 end as position from orders")
def track_unchecked(spark, sf_dir):
    k = c("o_orderkey")
    return fx.table(spark, sf_dir, "orders").select(k, st.unchecked(F.when(k % 3 > 0, k % 7)).alias("position"))


_EXT = """case when regexp_matches(regexp_replace({p}, '(/[.]?)+$', ''), '(^|/)[.][.]$') then null when regexp_matches(regexp_replace({p}, '(/[.]?)+$', ''), '[^/][.]([^./]*)$')
 then lower(regexp_extract(regexp_replace({p}, '(/[.]?)+$', ''), '[^/][.]([^./]*)$', 1)) end"""


@query(f"select page_id, {_EXT.format(p='url')} as extension from pages")
def get_extension(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", config.extension(c("url")).alias("extension"))


def _codec_sql(kind: str, codec: str) -> str:
    word = "format" if kind == "subtitle" else "codec"
    return f"case when {codec} is not null and not exists (from edges e where e.container = i and e.kind = '{kind}' and e.codec = {codec}) then '{word} ''' || {codec} || ''' not supported in ''' || i || '''' end"


_A, _V, _S, _T = "[tok1]", "[tok2]", "[tok3]", "[tok4]"
_LONELY = f"case when ({_track(_S)[0]}) is null and {_option('language', _S)} is null and coalesce({', '.join(_option(k, _S) for k in config.SUBTITLE if k != 'language')}) is not null then 'subtitle needs track or language' end"
_PLAN = f"""with {_JOBS}, {_EDGES}, x as (select *, {_EXT.format(p="input")} as i, {_EXT.format(p="output")} as o, {_option("codec", _A)} as ac, {_option("codec", _V)} as vc, {_option("codec", _S)} as sc,
 {_track(_A)[1]} as ae, {_track(_V)[1]} as ve, {_track(_S)[1]} as se, {_LONELY} as le, {_track(_T, True)[1]} as te from jobs),
 r as (select *, case when o = 'wav' then 'wav' when o in ('raw', 'pcm') then 'raw' when i = 'wav' then 'wav' when i in ('raw', 'pcm') then 'raw' when i = 'mov' then 'webm' end as way from x),
 e as (select *, coalesce(ae, ve, se, le, te, case when i is null then 'no file extension' end, case when o is null then 'no file extension' end,
  case when i not in {tuple(compat.CONTAINERS)} then '''' || i || ''' is not supported' end, case when o not in {tuple(compat.CONTAINERS)} then '''' || o || ''' is not supported' end,
  {_codec_sql("audio", "ac")}, {_codec_sql("video", "vc")}, {_codec_sql("subtitle", "sc")}, case when way = 'webm' then 'webm pipeline not implemented' end, case when way is null then 'unsupported ''' || i || ''' format' end) as error from r)
 select job_id, i as input_ext, o as output_ext, error, case when error is null then way end as route,
  case when error is null and way = 'wav' and o <> 'wav' then 'WAV bytes go to .' || o when error is null and i not in ('wav', 'raw', 'pcm') then '.' || i || ' is read as raw 16-bit stereo at 44100 Hz' end as warning from e"""


@query(_PLAN)
def plan_jobs(spark, sf_dir):
    rows = config.plan(fx.jobs(spark, sf_dir), *(F.array(name) for name, _, _ in fx.TOKEN_OF))
    return rows.select("job_id", "input_ext", "output_ext", "error", "route", "warning")


@query("select event_id, case event_type when 'error' then 'error' when 'view' then 'info' else 'warning' end as kind, case event_type when 'error' then 'error' when 'view' then 'info' else 'warning' end || ': ' || event_type as line from events")
def message_kind(spark, sf_dir):
    kind = F.when(c("event_type") == "error", "error").when(c("event_type") == "view", "info").otherwise("warning")
    return fx.table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.concat(kind, F.lit(": "), c("event_type")).alias("line"))


# --- Numbers in bytes ---------------------------------------------------------------------------------

_HEX = "h as (select doc_id, hex(encode(text)) as d, octet_length(encode(text)) as n from documents)"
#: Readers: name, kind, bytes, offset in the text. Each number has its own place, so that a text too short for it gives null.
_READS = [("u8", "u", 1, 0), ("i8", "i", 1, 1), ("u16", "u", 2, 1), ("i16", "i", 2, 3), ("u32", "u", 4, 3), ("i32", "i", 4, 5), ("u64", "u", 8, 4), ("i64", "i", 8, 6), ("f32", "f", 4, 2), ("f64", "f", 8, 7)]


def _reads() -> list[tuple[str, str, int, int, bool]]:
    """(column, kind, bytes, offset, little-endian): single bytes have no order."""
    return [(name + (f"_{order}" if width > 1 else ""), kind, width, at, order == "le") for name, kind, width, at in _READS for order in (("le", "be") if width > 1 else ("le",))]


def _bits(at: int, n: int, little: bool) -> str:
    """An unsigned number of n bytes at 0-based ``at`` of hex digits ``d``."""
    order = reversed(range(n)) if little else range(n)
    return "('0x' || " + " || ".join(f"substr(d, {2 * (at + i) + 1}, 2)" for i in order) + ")::ubigint::hugeint"


def _float_sql(bits: str, width: int) -> str:
    """An IEEE number from its bits, as a double; no text has the bits of NaN, infinities or the smallest numbers."""
    exponent, fraction, bias = (8, 23, 127) if width == 4 else (11, 52, 1023)
    part = f"({bits} % {2**fraction})::double / {2**fraction}::double"
    return f"(case when {bits} >= {2 ** (8 * width - 1)}::hugeint then -1 else 1 end) * (1.0::double + {part}) * pow(2.0::double, (({bits} // {2**fraction}) % {2**exponent})::double - {bias})"


def _read_sql(kind: str, width: int, at: int, little: bool) -> str:
    bits = _bits(at, width, little)
    if kind == "f":
        value = _float_sql(bits, width)
    elif kind == "u":
        value = f"({bits})::decimal(20,0)" if width == 8 else f"({bits})::bigint"
    else:
        value = f"(case when {bits} >= {2 ** (8 * width - 1)}::hugeint then {bits} - {2 ** (8 * width)}::hugeint else {bits} end)::bigint"
    return f"case when n >= {at + width} then {value} end"


@query(f"with {_HEX} select doc_id, {', '.join(f'{_read_sql(k, w, at, little)} as {name}' for name, k, w, at, little in _reads())} from h")
def read_primitives(spark, sf_dir):
    def value(kind: str, width: int, digits: Column) -> Column:
        if kind == "f":
            return (binary.float_32 if width == 4 else binary.float_64)(digits).cast("double")
        if kind == "u":
            return binary.unsigned_64(digits) if width == 8 else binary.unsigned(digits)
        return binary.signed(digits, width)

    return fx.raw_files(spark, sf_dir).select("doc_id", *(value(k, w, binary.hex_at(c("content"), at, w, little)).alias(name) for name, k, w, at, little in _reads()))


#: Writers: name, bytes, value. Signed ones take numbers below zero.
_WRITES = [("u8", 1, "o_orderkey % 256"), ("i8", 1, "o_orderkey % 256 - 128"), ("u16", 2, "o_orderkey % 65536"), ("i16", 2, "o_orderkey % 65536 - 32768"), ("u32", 4, "o_orderkey * 65537 % 4294967296"), ("i32", 4, "o_orderkey - 2147483648"), ("u64", 8, "o_orderkey * 4294967311"), ("i64", 8, "-o_orderkey * 4294967311")]


def _write_sql(value: str, n: int, little: bool) -> str:
    digits = f"lpad(to_hex(case when {value} < 0 then ({value})::hugeint + 18446744073709551616::hugeint else ({value})::hugeint end), 16, '0')"
    return f"({' || '.join(f'substr({digits}, {17 - 2 * i}, 2)' for i in range(1, n + 1))})" if little else f"right({digits}, {2 * n})"


def _float_bits_sql(x: str, width: int) -> str:
    """The bits of a positive number by arithmetic."""
    fraction, bias = (23, 127) if width == 4 else (52, 1023)
    power = f"floor(log2({x}))"
    return f"(({power}::bigint + {bias})::hugeint * {2**fraction} + (({x} / pow(2.0, {power}) - 1) * {2**fraction}::double)::bigint)"


_FLOATS = [("f32", 4, "(o_totalprice::float)::double"), ("f64", 8, "o_totalprice::double")]
_ORDERS = lambda n: (("le", True), ("be", False)) if n > 1 else (("", True),)
_name = lambda name, order: f"{name}_{order}" if order else name


@query("select o_orderkey, " + ", ".join([f"{_write_sql(v, n, little)} as {_name(name, order)}" for name, n, v in _WRITES for order, little in _ORDERS(n)] + [f"{_write_sql(_float_bits_sql(x, n), n, little)} as {_name(name, order)}" for name, n, x in _FLOATS for order, little in _ORDERS(n)]) + " from orders")
def write_primitives(spark, sf_dir):
    whole = lambda v, n, little: (binary.little_endian if little else binary.big_endian)(F.expr(v), n)
    columns = [F.hex(whole(v, n, little)).alias(_name(name, order)) for name, n, v in _WRITES for order, little in _ORDERS(n)]
    columns += [F.hex(binary.float_bytes(c("o_totalprice"), n, little)).alias(_name(name, order)) for name, n, _ in _FLOATS for order, little in _ORDERS(n)]
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", *columns)


# --- Transforms -------------------------------------------------------------------------------------------

_SAMPLES = f"{_FRAMES}, s as (select vec_id, g, samples, unnest(range(1, len(samples) + 1)) as i from frames)"


def _whole(samples: str = "samples") -> list[Column]:
    """Amplitudes in 24-bit steps, so that both engines sum whole numbers."""
    v = F.transform(samples, lambda x: pcm.denormalize_24(x.cast("double")).cast("long") / 256)
    v = F.transform(v, lambda x: x.cast("long"))
    return _sums(v)


def _whole_sql(value: str) -> str:
    return f"with {_SAMPLES} select vec_id, {_SUMS} from (select vec_id, trunc(greatest(least(({value}) * 8388608, 8388607), -8388608))::bigint as v from s) group by vec_id"


@query(_whole_sql("samples[i]::double * g"))
def gain(spark, sf_dir):
    return fr.apply(fx.frames_f32(spark, sf_dir), fr.gain(c("g"))).select("vec_id", *_whole())


@query(_whole_sql("samples[i]::double * 0.95 / greatest(list_max(list_transform(samples, lambda x: x::double)), -list_min(list_transform(samples, lambda x: x::double)))"))
def normalize_peak(spark, sf_dir):
    return fr.apply(fx.frames_f32(spark, sf_dir), fr.normalize_peak(0.95)).select("vec_id", *_whole())


@query(_whole_sql("-samples[i]::double"))
def invert(spark, sf_dir):
    return fr.apply(fx.frames_f32(spark, sf_dir), fr.invert()).select("vec_id", *_whole())


@query(_whole_sql("case when abs(samples[i]::double) < 0.0625 then 0 else samples[i]::double end"))
def custom_transform(spark, sf_dir):
    gate = lambda samples: F.transform(samples, lambda x: F.when(F.abs(x.cast("double")) < 0.0625, F.lit(0.0)).otherwise(x.cast("double")))
    return fr.apply(fx.frames_f32(spark, sf_dir), gate).select("vec_id", *_whole())


@query(f"with {_SAMPLES} select vec_id, (i - 1) // 2 as frame_idx, (i - 1) % 2 as channel, trunc(samples[i]::double * 16777216)::bigint as scaled from s")
def samples(spark, sf_dir):
    rows = pk.explode_samples(fx.frames_f32(spark, sf_dir).withColumn("pts", F.lit(0)), F.lit(2), ("vec_id",))
    return rows.select("vec_id", "frame_idx", "channel", (c("value").cast("double") * 16777216).cast("long").alias("scaled"))


# --- Files: written from the tables into the shared folder and read by the sources --------------------------

_FILES = _RAW + ", files as (select *, octet_length(content)::bigint as n, depth // 8 * channels as block from raw_files where octet_length(content) > 0)"


def _file_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as the one packet of a file."""
    rows = fx.raw_files(spark, sf_dir).filter("octet_length(content) > 0")
    about = F.create_map(F.lit("title"), c("path"), F.lit("track"), c("doc_id").cast("string"))
    return rows.select("doc_id", F.concat(F.lit("doc-"), c("doc_id").cast("string"), F.lit(".wav")).alias("path"), F.lit(0).alias("k"), c("content").alias("data"), "channels", "sample_rate", c("depth").alias("bit_depth"), about.alias("metadata"))


def _written(spark: SparkSession, packets: DataFrame, container: str) -> tuple[str, DataFrame]:
    from framewright.sources import files, wav

    folder = files.new_folder(spark, container)
    return folder, wav.write_files(packets, folder, container)


def _doc_id(path: Column) -> Column:
    return F.regexp_extract(path, r"doc-(\d+)[.]", 1).cast("long").alias("doc_id")


@query(f"""with {_FILES} select doc_id, channels::integer as channels, sample_rate, depth::integer as bit_depth, case depth when 32 then 3 else 1 end as format_code, n as data_size, n // block as frames,
 {_codec("depth")} as codec, true as supported, null::varchar as error from files""")
def wav_scan(spark, sf_dir):
    folder, _ = _written(spark, _file_packets(spark, sf_dir), "wav")
    heads = spark.read.format("wav").options(path=folder, include="header").load()
    return heads.select(_doc_id(c("path")), "channels", "sample_rate", "bit_depth", "format_code", "data_size", "frames", "codec", "supported", "error")


@query(f"with {_FILES} select doc_id, path as title, doc_id::varchar as track, 2::bigint as n_fields from files")
def wav_metadata(spark, sf_dir):
    folder, _ = _written(spark, _file_packets(spark, sf_dir), "wav")
    heads = spark.read.format("wav").options(path=folder, include="header").load()
    return heads.select(_doc_id(c("path")), c("metadata")["title"].alias("title"), c("metadata")["track"].alias("track"), F.size("metadata").cast("long").alias("n_fields"))


@query(f"""with {_RAW} select doc_id, k, md5(content[k * 1020 + 1 : least(n, (k + 1) * 1020)]) as data_md5, least(1020, n - k * 1020) as size, k * 1020 // 6 as pts
 from (select *, unnest(range(0, (n + 1019) // 1020)) as k from (select doc_id, content, octet_length(content)::bigint as n from raw_files) where n > 0)""")
def raw_scan(spark, sf_dir):
    folder, _ = _written(spark, _file_packets(spark, sf_dir).withColumn("path", F.regexp_replace("path", "wav$", "pcm")), "pcm")
    rows = spark.read.format("rawpcm").options(path=folder, depth=24, channels=2, limit=LIMIT).load()
    return rows.select(_doc_id(c("path")), "k", F.md5("data").alias("data_md5"), "size", "pts")


@query(f"""with {_FILES} select doc_id, case depth when 32 then 46 else 44 end + n + n % 2 + 12 + 8 + (length(path) + 1) + (length(path) + 1) % 2 + 8 + (length(doc_id::varchar) + 1) + (length(doc_id::varchar) + 1) % 2 as size from files""")
def wav_sink(spark, sf_dir):
    _, sizes = _written(spark, _file_packets(spark, sf_dir), "wav")
    return sizes.select(_doc_id(c("path")), "size")


_F32_VALUE = f"(case when b >= 2147483648 then -1 else 1 end * (1 + (b % 8388608) / 8388608.0::double) * pow(2.0::double, b // 8388608 % 256 - 127))"
#: Hex digits of a sample as 24 bits: 16-bit ones get a low byte, floats are clamped and cut; no text holds NaN.
_TO_24 = f"case depth when 16 then '00' || q when 24 then q else {_le(f'trunc(greatest(least({_F32_VALUE} * 8388608, 8388607), -8388608))::bigint + 16777216', 3)} end"


@query(f"""with {_FILES}, cut as (select doc_id, depth, regexp_extract_all(hex(content), case depth when 16 then '....' when 24 then '......' else '........' end) as w from files where n % (depth // 8) = 0),
 words as (select doc_id, depth, generate_subscripts(w, 1) as i, unnest(w) as q from cut),
 bits as (select *, case when depth = 32 then {_F32_BITS} end as b from words),
 done as (select doc_id, md5(string_agg({_TO_24}, '' order by i)) as hex_md5 from bits group by doc_id)
 select doc_id, depth as bit_depth, case when n % (depth // 8) <> 0 then 'invalid pcm' || depth || ' length' end as error, hex_md5 from files left join done using (doc_id)""")
def wav_to_wav(spark, sf_dir):
    """Files of every depth to 24 bits; those whose data doesn't fit their depth have an error instead."""
    source, _ = _written(spark, _file_packets(spark, sf_dir), "wav")
    packets = spark.read.format("wav").options(path=source, limit=LIMIT).load()
    errors = packets.groupBy("name").agg(F.max(pcm.length_error(c("data"), c("bit_depth"))).alias("error"), F.max("bit_depth").cast("long").alias("bit_depth")).withColumnRenamed("name", "of")
    # Packets are whole samples but for a file's last, so its head tells of all of them whether they fit, and the size of the result.
    good = packets.filter("data_size % (bit_depth div 8) = 0").withColumns({"path": c("name"), "file_size": F.expr("data_size div (bit_depth div 8) * 3")})
    folder, _ = _written(spark, pk.transcode(good, c("bit_depth"), F.lit(24)).withColumn("bit_depth", F.lit(24)), "wav")
    out = pk.mux(spark.read.format("wav").options(path=folder).load(), "name").select(c("name").alias("made"), F.md5(F.hex("data")).alias("hex_md5"))
    return errors.join(out, c("of") == c("made"), "left").select(_doc_id(c("of")), "bit_depth", "error", "hex_md5")


@query(f"with {_FILES} select doc_id, md5(content) as data_md5, n as size from files")
def wav_to_raw(spark, sf_dir):
    from framewright.sources.wav import renamed

    source, _ = _written(spark, _file_packets(spark, sf_dir), "wav")
    packets = spark.read.format("wav").options(path=source, limit=LIMIT).load().withColumns({"path": renamed("name", "raw"), "file_size": c("data_size")})
    folder, _ = _written(spark, packets, "raw")
    # A file in one packet: its bytes as they are.
    files = spark.read.format("rawpcm").options(path=folder, channels=1, depth=8, limit=pk.MUX_BYTES).load()
    return files.select(_doc_id(c("path")), F.md5("data").alias("data_md5"), "size")
