"""Mixing, media, licenses, line dedup and quality: small cases against plain versions."""

import hashlib
import io
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import licenses, linededup, media, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, page string, size long, rank double, target string"


def docs(spark, rows):
    """Rows (doc_id, text, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 7, "page", 9, 0.5, "t") for i, t, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Mixing -----------------------------------------------------------------------------------------------


def plain_targets(sizes: dict) -> dict:
    """The rule as it is worded: share, cut what is above, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, fixed, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        for s in over:
            fixed.add(s)
            target[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(target[s] for s in fixed)


def test_mixture(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for s, n in (("a", 3), ("b", 200), ("c", 40), (None, 100), ("é", 300), ("Z", 60)):
        for _ in range(n):
            rows.append((k, " ".join(["w"] * int(rng.integers(0, 60))), s))
            k += 1
    rows += [(k, None, "a"), (None, "x y", "b"), (k + 1, "", "empty"), (k + 1, "", "empty"), (k + 2, "one\x0btwo\tthree four\x1ffive six", "c")]
    frame = docs(spark, rows)
    got = mixing.mixture(frame).collect()
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + sum(bool(x) for x in __import__("re").split(r"[\x20\x09-\x0D]+", r[1] or ""))
    want = plain_targets(sizes)
    source = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-12, abs_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[s] += r["taken"]
    assert len(got) == len(rows) and sum(x["size"] == 5 for x in got if x["doc_id"] == k + 2) == 0
    assert next(x["size"] for x in got if x["doc_id"] == k + 2) == 4
    for s, w in want.items():
        assert abs(taken[s] - w) <= 60
    assert sorted(map(tuple, mixing.mixture(frame.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns
    n = {r["doc_id"]: r["count"] for r in mixed.filter("doc_id is not null").groupBy("doc_id").count().collect()}
    assert n == {r["doc_id"]: r["copies"] for r in got if r["copies"] and r["doc_id"] is not None}


def test_mixture_of_nothing(spark):
    assert mixing.mixture(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    assert mixing.mixture(docs(spark, [(1, None, None), (2, "", "a")])).filter("taken = 0 and target = 0").count() == 2


# --- Media ------------------------------------------------------------------------------------------------


def bmp(image, bits=24, top=False):
    h, w = image.shape[:2]
    rows = image if top else image[::-1]
    body, palette = b"", b""
    if bits == 8:
        palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
    for r in rows:
        line = r.tobytes() if bits == 8 else r[:, ::-1].tobytes() if bits == 24 else np.dstack([r[None, :, ::-1], np.full((1, w, 1), 255, np.uint8)])[0].tobytes()
        body += line + bytes(-len(line) % 4)
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, -h if top else h, 1, bits, 0, len(body), 0, 0, 0, 0) + palette + body


def test_image_formats():
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (7, 5), dtype=np.uint8), rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_pgm(grey)) == grey).all()
    assert (media.decode_image(b"P6 # c\n5 7\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode_image(b"P2\n5 7 # x\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode_image(b"P3 5 7 255\n" + " ".join(map(str, colour.ravel())).encode()) == colour).all()
    assert media.decode_image(b"P1\n3 1\n101").tolist() == [[0, 255, 0]] and media.decode_image(b"P4\n9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    assert media.decode_image(b"P5 2 1 1023\n" + struct.pack(">2H", 0, 1023)).tolist() == [[0, 255]]
    for bits, image in ((24, colour), (32, colour), (8, grey)):
        for top in (False, True):
            out = media.decode_image(bmp(image, bits, top))
            assert (out == (image if bits > 8 else np.dstack([grey] * 3))).all()
    for bad in (None, b"", b"P5", b"P5 2 2 255\nabc", b"P5 0 2 255\n", b"P9 1 1 1\n1", b"BM123", bmp(colour)[:-1], b"P2 1 1 9\n10"):
        assert media.decode_image(bad) is None


def test_area_resize_against_sums_of_areas():
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (24, 24), (7, 31), (100, 9)):
        image = rng.integers(0, 256, (h, w)).astype(np.uint8)
        up = np.kron(image.astype(float), np.ones((8, 9)))
        want = up.reshape(8, h, 9, w).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(image, 9, 8), want)


def test_npy():
    for shape in ((1, 24), (3, 4, 3)):
        a = np.random.default_rng(4).integers(0, 256, shape, dtype=np.uint8)
        data = media.npy_bytes(a)
        assert (np.load(io.BytesIO(data)) == a).all() and (media.npy_array(data) == a).all()
    with pytest.raises(ValueError, match="NPY"):
        media.npy_array(b"nothing")


def test_text_media(spark):
    texts = {1: "abc", 2: None, 3: "", 4: "é" * 288, 5: "x" * 577, None: "abc"}
    rows = {r["doc_id"]: r for r in media.media_column(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.npy_bytes(np.frombuffer(payload, np.uint8).reshape(-1, 24))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(r["feature"]) == 16
    assert rows[1]["feature"] == rows[None]["feature"]
    assert media.media_column(empty(spark)).count() == 0


def test_tiles(spark):
    image = np.random.default_rng(5).integers(0, 256, (40, 30, 3), dtype=np.uint8)
    rows = spark.createDataFrame([(1, bytearray(bmp(image)), "old"), (2, None, "old"), (3, bytearray(b"no"), "old")], "id long, content binary, tile string")
    got = {r["id"]: r for r in media.tiles(rows, "content", (6, 8)).collect()}
    assert (got[1]["media_width"], got[1]["media_height"], got[1]["media_channels"]) == (30, 40, 3)
    assert np.load(io.BytesIO(bytes(got[1]["tile"]))).shape == (8, 6, 3) and got[2]["tile"] is got[3]["dhash"] is None


def plain_hash(image):
    """The hash by means over the source areas, pixel by pixel."""
    h, w = image.shape
    up = np.kron(image.astype(float), np.ones((8, 9))).reshape(8, h, 9, w).mean(axis=(1, 3))
    bits = "".join("1" if round(a, 6) > round(b, 6) else "0" for row in up for a, b in zip(row, row[1:], strict=False))
    return f"{int(bits, 2):016x}"


def test_features_against_areas(spark):
    texts = ["abc " * 200, "é" * 700, "Zebra zoo " * 97, "x"]
    rows = media.media_column(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["feature"] == plain_hash(np.frombuffer(raw + b"\xff" * (-len(raw) % 576), np.uint8).reshape(-1, 24))


def test_long_image_heads():
    image = np.arange(6, dtype=np.uint8).reshape(2, 3)
    for n in (0, 5000, 100_000):
        assert (media.decode_image(b"P5 #" + b"c" * n + b"\n3 2\n255\n" + image.tobytes()) == image).all()


# --- Licenses ---------------------------------------------------------------------------------------------


def test_automata():
    a = licenses.compile_template("x", "one <<optional>>two <<optional>>three <</optional>><</optional>>four <<var 2>> five")
    ends = lambda t: a.run(t.encode().split(), 0)[0]
    assert ends("one four five") == 3 and ends("one two four x five") == 5 and ends("one two three four x y five z") == 7
    assert ends("one three four five") is ends("one four x y z five") is ends("one two five") is ends("") is None
    for bad in ("<<var 2>> a", "<<optional>>a", "a <</optional>>", "<<optional>>a<</optional>>", ""):
        with pytest.raises(ValueError, match="x:"):
            licenses.compile_template("x", bad)


def test_license_scan(spark):
    texts = {
        1: "Released UNDER the MIT-License. under the mit license", 2: "Licensed under the Apache License, Version 2.0.", 3: "Licensed under CC BY-NC 4.0.", 4: None, 5: "",
        6: "This work is licensed under the GNU General Public License, version 3.", 7: "under the very mit license", 8: "licensed under CC BY 4.0", 9: "under the é mit license",
    }
    rows = {r["doc_id"]: r for r in licenses.scan(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    pick = lambda i: tuple(rows[i][k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert pick(1) == (9, 2, 1, 5, "mit", "mit") and pick(2) == (8, 1, 3, 3, "apache-2", "apache-2") and pick(3) == (7, 1, 2, 2, "cc-by-nc", "cc-by-nc")
    assert pick(4) == pick(5) == (0, 0, None, None, "", "") and pick(6)[1:] == (0, None, None, "", "gpl-3") and pick(8)[4:] == ("", "cc-by")
    assert pick(7)[4:] == pick(9)[4:] == ("", "") and rows[6]["score"] == 1.0 and rows[4]["score"] == 0.0 and rows[9]["n_words"] == 5
    assert licenses.scan(empty(spark)).count() == 0


def as_pattern(template):
    """A template as a regular expression over words with a blank after each, written without the automata."""
    import re

    out = ""
    for mark, word in re.findall(r"<<([^>]*)>>|([^\s<]+)", template):
        if word:
            out += re.escape(word) + " "
        elif mark == "optional":
            out += "(?:"
        elif mark == "/optional":
            out += ")?"
        else:
            out += r"(?:\S+ ){0,%s}" % mark.split()[1]
    return re.compile(out)


def longest(pattern, words, start):
    """The end of the longest match from a word."""
    ends = [e for e in range(start + 1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[start:e]))]
    return max(ends, default=None)


def test_automata_against_patterns():
    rng = np.random.default_rng(8)
    small = ["a <<optional>>b <<optional>>c <</optional>>d <</optional>>e", "a <<var 2>> b <<optional>>c<</optional>>", "<<optional>>a <</optional>>b <<var 1>> <<optional>>d <</optional>>a b"]
    for template in small:
        automaton, pattern = licenses.compile_template("x", template), as_pattern(template)
        for _ in range(400):
            words = [str(w) for w in rng.choice(list("abcde"), rng.integers(1, 9))]
            assert automaton.run([w.encode() for w in words], 0)[0] == longest(pattern, words, 0), (template, words)
    for label, template in licenses.TEMPLATES:
        automaton, pattern = licenses.compile_template(label, template), as_pattern(template)
        bare = [w for w in __import__("re").sub(r"<<[^>]*>>", " ", template).split()]
        for _ in range(12):
            words = [w for w in bare if rng.random() > 0.01] + ["tail"]
            found = pattern.match("".join(w + " " for w in words))
            assert (automaton.run([w.encode() for w in words], 0)[0] is not None) == (found is not None)


#: Notices as they stand in files, and the one label of each.
NOTICES = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "agpl-3",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl-2.1",
    "modify it under the terms of the GNU Lesser General Public License, version 3": "lgpl-3",
    "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License": "lgpl-2",
    "under the GNU Lesser General Public License": "lgpl",
    "under the terms of version 2 of the GNU General Public License": "gpl-2",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright": "gpl-3",
    "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "agpl-3",
    "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999": "lgpl-2.1",
    "Apache License\nVersion 2.0, January 2004": "apache-2",
    "Mozilla Public License Version 2.0\n======\n1. Definitions": "mpl-2",
    "Text is licensed under CC BY-SA 4.0": "cc-by-sa",
    "available under the Creative Commons Attribution-ShareAlike 3.0 Unported License": "cc-by-sa",
    "under a Creative Commons Attribution-NonCommercial-NoDerivs 2.0 license": "cc-by-nc-nd",
    "licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "licensed under CC BY-ND 3.0": "cc-by-nd",
}


def test_labels_of_notices(spark):
    rows = licenses.scan(docs(spark, [(i, t, "s") for i, t in enumerate(NOTICES)])).collect()
    assert [r["labels"] for r in sorted(rows)] == list(NOTICES.values())
    both = licenses.scan(docs(spark, [(1, "Licensed under CC BY-NC-SA 4.0", "s")])).first()
    assert (both["base_labels"], both["labels"]) == ("cc-by-nc", "cc-by-nc,cc-by-nc-sa")


def test_templates_do_not_match_each_other():
    """Each template's wording, without and with all its optional regions, has its own label only."""
    import re

    begins = licenses.by_first_word(licenses.compile_all())
    for label, template in licenses.TEMPLATES:
        least = template
        while "<<optional>>" in least:
            least = re.sub(r"<<optional>>(?:(?!<<optional>>).)*?<</optional>>", " ", least)
        for text in (least, re.sub(r"<</?optional>>", " ", template)):
            words = re.sub(r"<<var \d+>>", "q", text).split() if text is not least else re.sub(r"<<var \d+>>", " ", text).split()
            found, best = licenses.spans([w.encode() for w in words], begins)
            labels = {x[0] for x in found}
            # All optional versions and words at once are no license's name.
            assert labels <= {label} and (labels or text is not least), (label, text)


def test_places_of_words():
    words = [b"a", b"b", b"a", b"c", b"a"]
    assert licenses.places_of(words, frozenset({b"a", b"c", b"z"})) == [0, 2, 3, 4] and licenses.places_of([], frozenset({b"a"})) == []
    assert licenses.longest([("x", 0, 3), ("y", 0, 5), ("z", 2, 5), ("w", 4, 7), ("v", 4, 7)]) == [("y", 0, 5), ("v", 4, 7), ("w", 4, 7)]


def test_share_of_a_broken_license(spark):
    template = dict((k, t) for k, t in licenses.TEMPLATES if "optional" not in t and "var" not in t)["bsd"]
    words = template.split()
    rows = licenses.scan(docs(spark, [(1, " ".join(words[:-1]), "s"), (2, "Redistribution " + " ".join(words[:4]), "s"), (3, "nothing of it", "s")]), templates=(("bsd", template),)).collect()
    assert [(r["labels"], round(r["score"] * len(words))) for r in sorted(rows)] == [("", len(words) - 1), ("", 4), ("", 0)]


# --- Line dedup -------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  footer \n\nrare", "s") if i < 4 else (i, f"own {i}\nrare\nrare", "s") for i in range(9)]
    rows += [(20, "footer\nx", "t"), (21, None, "s"), (22, "footer", None), (23, "", "s"), (24, "footer", "s")]
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(docs(spark, rows), F.col("source"), ratio=0.4, counts=True).collect()}
    assert got[0]["text"] == "own 0\n" and got[5]["text"] == "own 5" and (got[0]["n_lines"], got[0]["n_dropped"]) == (4, 2) and got[5]["n_dropped"] == 2
    assert got[20]["text"] == "footer\nx" and got[21]["text"] is None and got[22]["text"] == "footer" and got[23]["text"] == "" and got[24]["text"] == ""
    assert got[0]["page"] == "page" and len(got) == len(rows)
    assert linededup.drop_boilerplate(empty(spark), F.col("source")).count() == 0
    assert spark.range(1).select(linededup.host_of(F.lit("https://A.Example.org:80/x"))).first()[0] == "a.example.org"


def test_long_lines_have_their_own_ratio(spark, sf):
    import corpus_pipeline

    long, short, twice = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 51), ("b", 50), ("c", 60)))
    rows = [(i, f"own {i}" + (f"\n{long}\n{short}" if i % 20 == 0 else f"\n{twice}" if i % 50 == 1 else ""), "s") for i in range(100)]
    for frame in (docs(spark, rows), docs(spark, rows).repartition(7)):
        got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, frame, sf).collect()}
        assert got == {i: t.replace(f"\n{long}", "") for i, t, _ in rows}


def test_ratio_itself_is_no_boilerplate(spark):
    rows = [(i, "twin\nmore" if i < 4 else "more" if i == 4 else f"own {i}", "s") for i in range(10)]
    got = [r["text"] for r in linededup.drop_boilerplate(docs(spark, rows), F.col("source"), ratio=0.4).collect()]
    assert sum(t.startswith("twin") for t in got) == 4 and sum("more" in t for t in got) == 0


def test_any_names_and_long_texts(spark):
    long = "word " * 1_000_000 + "\nend"
    frame = spark.createDataFrame([(1, long, "s", 1), (2, long, "s", 2), (3, "short", None, 3), (None, None, "s", 4)], "`a.id` long, `the text` string, `so.urce` string, `row.page` int")
    for out in (linededup.drop_boilerplate(frame, F.col("`so.urce`"), "the text", ratio=0.5, min_pages=2), mixing.mixed(frame, "a.id", "the text", "so.urce"), quality.accepted(frame, quality.train(empty(spark), spark.createDataFrame([], "doc_id long, quality int")), "the text")):
        assert out.columns == frame.columns
        out.write.format("noop").mode("overwrite").save()
    assert mixing.mixture(frame, "a.id", "the text", "so.urce").agg(F.max("size")).first()[0] == 1_000_001
    assert {len(r["text"]) for r in quality.scored(frame, quality.fit(np.zeros((0, 27)), np.zeros((0, 27))), "a.id", "the text").withColumn("text", F.lit("")).collect()} == {0}
    assert licenses.scan(frame, "a.id", "the text").agg(F.max("n_words")).first()[0] == 1_000_001
    assert media.media_column(frame, "a.id", "the text").agg(F.max("n_bytes")).first()[0] == len(long)


def test_names_that_are_taken(spark):
    frame = spark.createDataFrame([(1, "a", "s", 5)], "id long, text string, source string, n_lines int")
    with pytest.raises(ValueError, match="n_lines"):
        linededup.drop_boilerplate(frame, F.col("source"), counts=True)
    assert linededup.drop_boilerplate(frame, F.col("source")).columns == frame.columns
    image = np.zeros((4, 4), np.uint8)
    made = media.tiles(spark.createDataFrame([(bytearray(media.encode_pgm(image)), "mine")], "content binary, __media string"), "content").first()
    assert made["__media"] == "mine" and made["media_width"] == 4


def test_few_pages_have_no_boilerplate(spark):
    rows = [(1, "a", "s"), (2, "a", "s")]
    assert [r["text"] for r in linededup.drop_boilerplate(docs(spark, rows), F.col("source")).collect()] == ["a", "a"]


def test_draw_against_a_plain_draw(spark):
    """The whole draw anew in plain Python, from the hashes that Spark gives."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 40))), "abc"[k % 3]) for k in range(400)] + [(7, " ".join(["w"] * 9), "a")] * 3
    frame = docs(spark, rows)
    draws = {(r["doc_id"], r["text"]): r["h"] for r in frame.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    got = {}
    for r in mixing.mixture(frame).collect():
        got[(r["doc_id"], r["size"])] = r["copies"]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for s, target in plain_targets(sizes).items():
        own = [(i, t, len(t.split())) for i, t, x in rows if x == s]
        short = lambda n: math.ceil(1000 * mixing.TYPICAL_WORDS / (mixing.TYPICAL_WORDS + n))
        mean, ratio = sum(short(n) * n for _, _, n in own) / sizes[s], target / sizes[s]
        ranked, left, copies = {}, target, {}
        for i, t, n in own:
            expected = min(3.0, max(0.0, ratio + min(ratio, 3 - ratio) * 0.5 * (short(n) - mean) / 1000))
            copies[i, n] = math.floor(expected)
            left -= n * math.floor(expected)
            u, p = ((draws[i, t] % 2**53) + 0.5) / 2**53, expected - math.floor(expected)
            if p > 0:
                ranked.setdefault((u / (1 - u)) * ((1 - p) / p), []).append((i, n))
        rest = []
        order = sorted(ranked)
        for k, rank in enumerate(order):
            words = sum(n for _, n in ranked[rank])
            if words > left:
                rest = order[k:]
                break
            left -= words
            for i, n in set(ranked[rank]):
                copies[i, n] += 1
        gap = left
        for rank in rest:
            fits = [(i, n) for i, n in ranked[rank] if n <= gap]
            words = sum(n for _, n in fits)
            if words / 2 > left:
                break
            left -= words
            for i, n in set(fits):
                copies[i, n] += 1
        assert {k: (got[k], v) for k, v in copies.items() if got[k] != v} == {}, (s, len(rest), gap, left)


# --- Quality ----------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    frame, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(frame, labels)
    rows = quality.scored(frame, model).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert len(rows) > 80 and right >= 0.95 * len(rows) and 0.6 < model.prior < 0.95
    assert quality.accepted(frame, model).columns == frame.columns
    assert quality.accepted(frame, model).count() == quality.scored(frame, model).filter("predicted = 1").count()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [(i, "good text, here. " * 9 if i % 2 else "X!! " * 40, "s") for i in range(40)] + [(None, "a", "s"), (50, None, "s"), (51, "", None), (1, "again", "s")])
    model = quality.train(frame, labels)
    rows = quality.scored(frame, model).collect()
    assert len(rows) == 44 and all(0 <= r["score"] <= 1 for r in rows) and not [r for r in rows if r["doc_id"] is None][0]["held_out"]
    nothing = quality.train(empty(spark), labels.limit(0))
    assert quality.scored(frame, nothing).filter("score = 0.5 and predicted = 0").count() == 44
    assert quality.scored(empty(spark), model).count() == quality.accepted(empty(spark), model).count() == 0


def test_risk_against_sums_and_differences():
    rng = np.random.default_rng(9)
    pos, unl = rng.normal(0.5, 1, (30, 27)), rng.normal(0, 1, (50, 27))
    layers = quality._start(27)
    logit = lambda x, ls: sum(math.tanh(sum(x[i] * ls[0][i, j] for i in range(27)) + ls[1][j]) * ls[2][j] for j in range(quality.HIDDEN)) + ls[3][0]
    loss = lambda z: math.log1p(math.exp(-z))

    def plain(ls, prior):
        p, u = [logit(x, ls) for x in pos], [logit(x, ls) for x in unl]
        negative = sum(map(loss, (-z for z in u))) / len(u) - prior * sum(map(loss, (-z for z in p))) / len(p)
        return prior * sum(map(loss, p)) / len(p) + max(0.0, negative), negative

    for prior in (0.3, 0.99):
        if prior > 0.9:
            layers = [a.copy() for a in layers]
            layers[3][0] += 3.0
        risk, negative, gradient = quality.risk_of(layers, pos, unl if prior < 0.9 else np.vstack([unl - 2]), prior)
        if prior < 0.9:
            assert np.allclose((risk, negative), plain(layers, prior)) and negative > 0
            for k, i in ((0, (3, 2)), (1, (4,)), (2, (5,)), (3, (0,))):
                moved = [a.copy() for a in layers]
                moved[k][i] += 1e-5
                assert abs((quality.risk_of(moved, pos, unl, prior)[0] - risk) / 1e-5 - gradient[k][i]) < 1e-4
    # Where the negatives' part is below 0, the step goes up its slope.
    layers[3][0] = 0.0
    layers[2][:] = 0.0
    layers[2][0] = 4.0
    apart = np.full((20, 27), -3.0) * np.sign(layers[0][:, 0]), np.full((20, 27), 3.0) * np.sign(layers[0][:, 0])
    risk, negative, gradient = quality.risk_of(layers, apart[1], apart[0], 0.9)
    assert negative < 0 and risk < 0.1
    moved = [a - 1e-3 * g for a, g in zip(layers, gradient, strict=True)]
    assert quality.risk_of(moved, apart[1], apart[0], 0.9)[1] > negative


def plain_features(text: bytes) -> dict[str, float]:
    """Every feature by its meaning, byte by byte and word by word."""
    import re

    if not text:
        return dict.fromkeys(quality.FEATURES, 0.0)
    kinds = {
        "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\n\x0b\x0c\r", "wide": bytes(range(128, 256)), "stop": b".,",
        "loud": b"!?", "pipe": b"|", "symbol": b"#$%&*+=@^~<>\\_`", "brace": b"()[]{}", "mark": b"-/:;'\"",
    }
    out = {k: sum(b in v for b in text) / len(text) for k, v in kinds.items()}
    shares = [text.count(bytes([b])) / len(text) for b in set(text)]
    words = re.findall(rb"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split(b"\n") if re.search(rb"[^\x20\x09-\x0d]", x)]
    m, k = max(1, len(words)), max(1, len(lines))
    distances, last = {}, {}
    for i in range(len(words) - quality.RUN + 1):
        run = tuple(words[i : i + quality.RUN])
        if run in last:
            distances[i - last[run]] = distances.get(i - last[run], 0) + 1
        last[run] = i
    period = min((d for d in distances if distances[d] == max(distances.values())), default=0)
    return out | {
        "entropy": -sum(p * math.log2(p) for p in shares), "log_words": math.log(1 + m), "word_bytes": sum(map(len, words)) / m, "distinct": len(set(words)) / m**0.8,
        "repeat": sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, "top": max((words.count(w) for w in set(words)), default=0) / m,
        "loud_ends": sum(w[-1:] in (b"!", b"?") for w in words) / m, "stop_ends": sum(w[-1:] in (b".", b",") for w in words) / m, "short": sum(len(w) <= 2 for w in words) / m if words else 1.0,
        "long": sum(len(w) >= 16 for w in words) / m, "lines": math.log(1 + k), "line_words": math.log(1 + m / k), "twin_lines": 1 - len(set(lines)) / k,
        "pairs": len(set(zip(words, words[1:], strict=False))) / m, "cycle": sum(a == b for a, b in zip(words, words[period:], strict=False)) / len(words) if period else 0.0,
        "upper_words": sum(bool(re.search(rb"[A-Z]", w)) and not re.search(rb"[a-z]", w) for w in words) / m,
    }


def test_all_features_against_plain_ones(spark, sf):
    texts = [r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += [b"", b" \n\t", b"a", b"A! B? c.", b"x" * 40, "é È 5 | #".encode(), b"one two three four " * 9, b"same line\nsame line\n\n same line\n", b"AB Ab 12 1A\x0b(x)[y]{z} - / : ; ' \" \\ _ `"]
    for text in texts:
        want = plain_features(text)
        assert list(want) == quality.FEATURES and len(want) == 27
        for name, a, b in zip(want, quality.features_of(text), want.values(), strict=True):
            assert abs(a - b) < 1e-9, (name, a, b, text[:80])


def test_scores_against_a_plain_network(spark, sf):
    """A table's scores from its texts, one multiplication at a time."""
    frame = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    rng = np.random.default_rng(3)
    n = len(quality.FEATURES)
    model = quality.Model(rng.normal(size=n), rng.uniform(0.5, 2, n), [rng.normal(size=(n, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)], 0.5)
    w, b, v, c = model.layers
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in quality.scored(frame, model).collect():
        x = [max(-8.0, min(8.0, (f - m) / s)) for f, m, s in zip(plain_features(text[r["doc_id"]].encode()).values(), model.mean, model.scale, strict=True)]
        z = c[0] + sum(math.tanh(b[j] + sum(x[i] * w[i, j] for i in range(n))) * v[j] for j in range(4))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9
        assert r["predicted"] == int(r["score"] >= quality.THRESHOLD) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_cycles_are_found_anywhere():
    clean = [f"w{i}".encode() for i in range(500)]
    loop = [f"l{i}".encode() for i in range(300)]
    assert quality._cycle(clean) == 0.0 and quality._cycle([]) == quality._cycle([b"a"]) == 0.0
    assert quality._cycle(clean + loop * 5) == 1200 / 2000 and quality._cycle([b"a", b"b"] * 50) == 0.98


def test_repeated_ids_are_collected_once(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    rows = [(i, f"text {i}", "s") for i in range(12)]
    once, often = quality.train(docs(spark, rows), labels), quality.train(docs(spark, rows * 20), labels)
    assert all((a == b).all() for a, b in zip(once.layers, often.layers, strict=True))
