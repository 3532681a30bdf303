import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from framewright.functions import binary, formats, media, pcm, timebase


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_edge_samples_in_every_depth():
    assert pcm.decode_array(struct.pack("<5h", -32768, -1, 0, 1, 32767), 16).tolist() == [-1.0, -1 / 32768, 0.0, 1 / 32768, 32767 / 32768]
    b24 = bytes.fromhex("000080 ffffff 000000 010000 ffff7f".replace(" ", ""))
    assert pcm.decode_array(b24, 24).tolist() == [-1.0, -1 / 8388608, 0.0, 1 / 8388608, 8388607 / 8388608]
    floats = np.array([1.5, -1.5, np.inf, -np.inf, np.nan, -0.0, 1e-40], np.float32)
    out = pcm.decode_array(pcm.encode_array(floats, 32), 32)
    assert out[:4].tolist() == [1.0, -1.0, 1.0, -1.0] and math.isnan(out[4]) and math.copysign(1, out[5]) == -1 and out[6] == np.float32(1e-40)
    assert np.frombuffer(pcm.encode_array(floats, 16), "<i2").tolist() == [32767, -32768, 32767, -32768, 0, 0, 0]


def test_24_to_16_bits_cuts_toward_zero():
    assert pcm.encode_array(pcm.decode_array(bytes.fromhex("ffffff"), 24), 16) == b"\0\0"


@settings(max_examples=60, deadline=None)
@given(hs.binary(max_size=60))
def test_lossless_round_trips(data):
    d16, d24 = data[: len(data) // 2 * 2], data[: len(data) // 3 * 3]
    for wide in (24, 32):
        assert pcm.encode_array(pcm.decode_array(pcm.encode_array(pcm.decode_array(d16, 16), wide), wide), 16) == d16
    assert pcm.encode_array(pcm.decode_array(pcm.encode_array(pcm.decode_array(d24, 24), 32), 32), 24) == d24


def test_lengths_and_depths_that_do_not_fit():
    for depth, size in ((16, 3), (24, 4), (32, 6)):
        with pytest.raises(ValueError, match=f"invalid pcm{depth} length"):
            pcm.decode_array(bytes(size), depth)
    with pytest.raises(ValueError, match="unsupported bit depth"):
        pcm.decode_array(b"", 8)


def test_expressions_agree_with_arrays(spark):
    data = bytes(range(240))
    for depth in (16, 24):
        got = one(spark, s=pcm.samples_sql(F.lit(data), depth))["s"]
        assert got == (pcm.decode_array(data, depth).astype(float) * pcm.SCALE[depth]).astype(int).tolist()
        again = one(spark, b=pcm._packed(pcm.samples_sql(F.lit(data), depth), depth))["b"]
        assert bytes(again) == data
    special = struct.pack("<6f", 0.5, -1.5, float("inf"), float("nan"), -0.0, 1e-40)
    got = one(spark, s=pcm.samples_sql(F.lit(special), 32))["s"]
    assert got[:3] == [0.5, -1.5, float("inf")] and math.isnan(got[3]) and got[5] == float(np.float32(1e-40))


def test_scalars(spark):
    nan = F.lit(float("nan")).cast("float")
    r = one(spark, a=pcm.denormalize_16(nan), b=pcm.denormalize_16(F.lit(2.0)), c=pcm.denormalize_24(F.lit(-1.0)), d=pcm.clamp(nan), e=pcm.normalize_24(F.lit(-256)), f=pcm.denormalize_16(F.lit(-0.99999)))
    assert (r["a"], r["b"], r["c"], r["e"], r["f"]) == (0, 32767, -8388608 * 256, -1 / 8388608, -32767) and math.isnan(r["d"])


def test_timebases(spark):
    L = lambda v: F.lit(v).cast("long")
    r = one(
        spark, scaled=timebase.scale(L(1500), L(1), L(44100), L(1), L(1000)), exact=timebase.rescale(L(44100), L(1), L(44100), L(1), L(1000)), negative=timebase.scale(L(-7), L(1), L(10), L(1), L(3)),
        nan=timebase.from_seconds(F.lit(float("nan")), L(1), L(8000)), big=timebase.from_seconds(F.lit(1e300), L(1), L(8000)), low=timebase.from_seconds(F.lit(-1e300), L(1), L(8000)), gcd=timebase.gcd(L(4294967295), L(2863311530)), bad=timebase.valid(L(0), L(1)),
    )
    assert (r["scaled"], r["exact"], r["negative"], r["nan"], r["gcd"], r["bad"]) == (44100, 1000, -20, 0, math.gcd(4294967295, 2863311530), False)
    assert (r["big"], r["low"]) == (2**63 - 1, -(2**63))


def test_byte_numbers(spark):
    data = F.lit(bytes.fromhex("ff00018000000000000080"))
    r = one(spark, a=binary.signed(binary.hex_at(data, 0, 1), 1), b=binary.unsigned(binary.hex_at(data, 2, 2)), c=binary.signed(binary.hex_at(data, 3, 8), 8), d=binary.hex_at(data, 9, 4), e=binary.joined(F.array(F.lit(b"ab"), F.lit(b""), F.lit(b"c"))))
    assert (r["a"], r["b"], r["c"], r["d"], bytes(r["e"])) == (-1, 0x8001, -(2**63) + 0x80, None, b"abc")


@pytest.mark.parametrize("value", [0.0, -0.0, 1.0, -1.5, 0.1, 1.7976931348623157e308, 5e-324, 2.2250738585072014e-308, float("inf"), float("-inf"), float("nan")])
def test_floats_in_bytes(spark, value):
    single = struct.unpack("<f", struct.pack("<f", value))[0] if abs(value) < 1e38 or value != value or math.isinf(value) else 0.5
    data = F.lit(struct.pack("<d", value) + struct.pack(">d", value) + struct.pack("<f", single))
    r = one(spark, a=binary.float_64(binary.hex_at(data, 0, 8)), b=binary.float_64(binary.hex_at(data, 8, 8, False)), c=binary.float_32(binary.hex_at(data, 16, 4)))
    for got, want in ((r["a"], value), (r["b"], value), (r["c"], single)):
        assert struct.pack("<d", got) == struct.pack("<d", want) or got != got and want != want


@pytest.mark.parametrize(
    ("channels", "rate", "code", "bits", "error"),
    [
        (0, 0, 9, 0, "channels must be non-zero"), (1, 0, 9, 0, "sample rate must be non-zero"), (1, 1, 9, 0, "audio format code 9 is not supported"),
        (1, 1, 1, 0, "bits per sample must be non-zero"), (1, 1, 3, 12, "bits per sample must be multiple of 8"), (1, 1, 17, 8, "IMA ADPCM must have 4 bits per sample"), (1, 1, 17, 4, None), (2, 1, 1, 24, None),
    ],
)
def test_header_errors_in_order(spark, channels, rate, code, bits, error):
    assert one(spark, e=formats.header_error(*map(F.lit, (channels, rate, code, bits))))["e"] == error


def test_list_chunk_has_the_size_of_its_parts(spark):
    m = F.create_map(F.lit("title"), F.lit("ab"), F.lit("artist"), F.lit("xyz"), F.lit("other"), F.lit("q"))
    r = one(spark, chunk=formats.list_chunk(m), size=formats.list_size(m), none=formats.list_chunk(F.create_map(F.lit("other"), F.lit("q"))))
    assert bytes(r["chunk"]) == b"LIST" + struct.pack("<I", 28) + b"INFO" + b"IART" + struct.pack("<I", 4) + b"xyz\0" + b"INAM" + struct.pack("<I", 3) + b"ab\0\0"
    assert r["size"] == 8 + 12 + 12 + 10 and bytes(r["none"]) == b""


def test_layouts(spark):
    names = [one(spark, n=media.layout_name(F.lit(i)))["n"] for i in (0, 1, 2, 3, 4, 6, 8)]
    assert names == ["0 channels", "mono", "stereo", "3 channels", "quad", "5.1", "7.1"]


def test_large_and_negative_ticks(spark):
    """128-bit products, as whole numbers; beyond 64 bits the low ones are left."""
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    cut = lambda a, b: abs(a) // b * (1 if a >= 0 else -1)
    rows = [(2**62, 3, 1, 3, 1), (-(2**62), 3, 1, 3, 1), (2**63 - 1, 1, 90000, 1, 1000), (-(2**63), 1, 1, 1, 1), (-7, 1, 1, 1, 2), (10**18, 1001, 30000, 1, 48000), (5, 4294967295, 4294967295, 4294967295, 1)]
    frame = spark.createDataFrame(rows, "pts long, num long, den long, tn long, td long")
    got = frame.select(timebase.scale(*map(F.col, frame.columns)).alias("x"), timebase.rescale(*map(F.col, frame.columns)).alias("y")).collect()
    for (pts, num, den, tn, td), r in zip(rows, got, strict=True):
        assert r["x"] == wrap(cut(cut(pts * tn, td) * den, num))
        exact = cut(pts * num * td, den * tn)
        assert r["y"] == (exact if -(2**63) <= exact < 2**63 else None)


def test_gcd_says_where_it_gives_up(spark):
    near = spark.createDataFrame([(2971215073, 1836311903)], "a long, b long").select(timebase.gcd(F.col("a"), F.col("b")).alias("g"))
    assert near.first()["g"] == 1
    far = spark.createDataFrame([(7540113804746346429, 4660046610375530309)], "a long, b long").select(timebase.gcd(F.col("a"), F.col("b")).alias("g"))
    with pytest.raises(Exception, match="too large for gcd"):
        far.collect()


@pytest.mark.parametrize("value", [0.0, -0.0, 1.5, -1e300, float("inf"), float("nan"), 5e-324])
def test_float_writers(spark, value):
    import struct

    row = spark.createDataFrame([(value,), (None,)], "v double").select(*(binary.float_bytes(F.col("v"), n, little).alias(f"x{n}{little}") for n in (4, 8) for little in (True, False))).collect()
    assert [bytes(row[0][f"x8{little}"]) for little in (True, False)] == [struct.pack(f"{o}d", value) for o in "<>"] and row[1]["x8True"] is None
    if abs(value) < 1e38 or value != value or value == float("inf"):
        assert [bytes(row[0][f"x4{little}"]) for little in (True, False)] == [struct.pack(f"{o}f", value) for o in "<>"]
    signed = spark.range(1).select(F.hex(binary.little_endian(F.lit(-2), 2)).alias("a"), F.hex(binary.big_endian(F.lit(-(2**63)), 8)).alias("b")).first()
    assert (signed["a"], signed["b"]) == ("FEFF", "8000000000000000")


def test_ticks_at_the_ends_of_their_range(spark):
    """Every extreme of 64-bit ticks and 32-bit timebases, against whole numbers of any size: wrapped at 64 bits, or null beyond them."""
    import itertools

    edges = (1, 2, 3, 2**31, 2**32 - 2, 2**32 - 1)
    rows = [(p, *b) for p in (0, 1, -1, 2**63 - 1, -(2**63), 2**62 + 12345, -(10**18) - 7) for b in itertools.product(edges, repeat=4)]
    frame = spark.createDataFrame(rows, "pts long, num long, den long, to_num long, to_den long")
    cut = lambda a, b: abs(a) // b * (1 if a >= 0 else -1)
    got = frame.select("*", timebase.scale(*map(F.col, frame.columns)).alias("x"), timebase.rescale(*map(F.col, frame.columns)).alias("y")).collect()
    for p, num, den, to_num, to_den, x, y in got:
        scaled = cut(cut(p * to_num, to_den) * den, num)
        assert x == (scaled + 2**63) % 2**64 - 2**63
        exact = cut(p * num * to_den, den * to_num)
        assert y == (exact if -(2**63) <= exact < 2**63 else None)
