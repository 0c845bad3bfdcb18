"""Motion-JPEG in AVI, WARC in ZIP, license scans."""

import base64
import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from conftest_llm import rows_by_text

from mergewright.llm import licenses, mjpeg, queries, warczip


def test_every_byte_value_survives():
    payload = bytes(np.random.default_rng(0).integers(0, 256, 192 * 40, np.uint8)) + bytes([255, 0] * 96) + bytes(192)
    frames, rate = mjpeg.read_avi(mjpeg.write_avi(payload))
    assert rate == 25 and b"".join(i.tobytes() for i in mjpeg.frame_means(frames)) == payload
    for f in frames[-3:]:
        slow = mjpeg.means(f)
        pixels = mjpeg.plane(f)
        assert (slow == mjpeg.frame_means([f])[0]).all() and pixels.shape == (96, 128)
        assert all((pixels[y::8, x::8] == slow).all() for y, x in ((0, 0), (3, 5), (7, 7)))


def test_index_may_be_missing_or_count_from_the_start():
    data = mjpeg.write_avi(bytes(range(192)) * 3)
    frames = mjpeg.read_avi(data)[0]
    at = data.rindex(b"idx1")
    assert mjpeg.read_avi(data[:at])[0] == frames
    movi = data.index(b"movi")
    table = bytearray(data)
    for i in range(3):
        p = at + 8 + 16 * i + 8
        struct.pack_into("<I", table, p, struct.unpack_from("<I", table, p)[0] + movi)
    assert mjpeg.read_avi(bytes(table))[0] == frames
    with pytest.raises(ValueError, match="no AVI"):
        mjpeg.read_avi(b"RIFF1234WAVE")


def test_colour_frame_with_standard_like_tables():
    """A two-component frame with other tables takes the general decoder."""
    head = b"\xff\xd8" + mjpeg._segment(0xDB, bytes([0] + [8] + [1] * 63)) + mjpeg._segment(0xC0, struct.pack(">BHHB", 8, 8, 16, 2) + bytes([1, 0x21, 0, 2, 0x11, 0]))
    head += mjpeg._segment(0xC4, bytes([0x00, 0, 2] + [0] * 14 + [0, 5])) + mjpeg._segment(0xC4, bytes([0x10, 0, 1] + [0] * 14 + [0]))
    head += mjpeg._segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    bits = "01" + "10100" + "00" + "00" + "00" + "01" + "11111" + "00"  # Y +20, Y +0, C +31
    bits += "1" * (-len(bits) % 8)
    frame = head + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)) + b"\xff\xd9"
    assert mjpeg.means(frame).tolist() == [[148, 148]]


def test_shots():
    still = lambda v, n: [np.full((12, 16), v, np.uint8)] * n
    assert mjpeg.cuts(still(30, 20) + still(200, 20) + still(90, 5)) == [20, 40]
    assert mjpeg.cuts(still(30, 9)) == [] and mjpeg.cuts([]) == []


def test_media_on_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    media = mjpeg.store(docs, ["doc_id", "size"])
    back = mjpeg.read(media, ["doc_id", "n_bytes"])
    got = sorted((r.n_bytes, bytes(r.payload)) for r in back.collect())
    assert got == sorted((len((t or "").encode()), mjpeg.padded(t or "")) for _, t, _ in odd_rows)
    assert all(len(p) % 192 == 0 and len(p) >= 192 for _, p in got)
    clips = mjpeg.clips(back, ["doc_id"]).collect()
    assert {r.start_ms for r in clips if r.clip == 1} == {0} and all(r.end_ms > r.start_ms for r in clips)
    assert mjpeg.read(mjpeg.store(docs_of([]), ["doc_id"]), ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="clash"):
        mjpeg.store(docs.withColumnRenamed("size", "media"), ["media"])


def test_media_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op5_avi_mjpeg(spark, sf).collect()}
    for d, t in rows_by_text(spark, sf):
        raw = t.encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r, file = got[d], mjpeg.write_avi(full)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


PAGES = "page_id long, url string, html string, refers_to string, size int"


def pages_of(spark, rows):
    return spark.createDataFrame([(p, u, h, "clash", 1) for p, u, h in rows], PAGES)


def plain_records(rows):
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, g in rows if q is not None and (g or "") == (h or "")]
        to = max(same) if p is not None and same and max(same) > p else None
        out.append((p is None, p or 0, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to or 0))
    return sorted(out)


def test_archives_on_odd_rows(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/\r\nEvil: 1", None), (4, "u", ""), (5, "u", "é" * 100_000), (5, "u", "é" * 100_000), (6, "u", "x"), (6, "u", "y"), (7, "u", "y"), (None, "u", "x"), (8, "u", "WARC/1.1\r\n\r\n")]
    packages = warczip.write_packages(pages_of(spark, rows).repartition(3), tmp_path.as_uri())
    back = warczip.read_packages(packages)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in back.collect())
    assert got == plain_records(rows)
    assert {bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    for r in packages.collect():
        with zipfile.ZipFile(io.BytesIO(open(r.file.removeprefix("file://"), "rb").read())) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_least_size_and_empty(spark, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    back = warczip.read_packages(warczip.write_packages(pages_of(spark, rows), (tmp_path / "a").as_uri(), least=5))
    assert {r.page_id: r.refers_to for r in back.collect()} == {1: None, 2: None, 3: 4, 4: None}
    assert warczip.read_packages(warczip.write_packages(pages_of(spark, []), (tmp_path / "b").as_uri())).count() == 0


def test_zip64_directories(tmp_path):
    """A package whose directory gives sizes and places only in ZIP64 fields."""
    body, name = b"some record bytes", b"archive/data.warc.gz"
    wide = struct.pack("<HHQQ", 1, 16, len(body), len(body))
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide)) + name + wide
    start = 1000
    central_extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), start)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(central_extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + central_extra
    at = start + len(local) + len(body)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path = tmp_path / "w.zip"
    path.write_bytes(bytes(start) + local + body + central + end64 + locator + end)
    package = warczip.Package(path.as_uri())
    assert package.range("archive/data.warc.gz", 5, 6) == body[5:11]
    with pytest.raises(ValueError, match="outside"):
        package.range("archive/data.warc.gz", 10, 100)


def test_license_templates_are_found_whole_changed_and_placed():
    index = licenses.index_of(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    changed = " ".join(words[:20] + ["INSERTED"] + words[20:40] + words[42:])
    for text, least in ((mit, 1.0), (changed.upper(), 0.9)):
        doc = "intro words here. " + text + " and more words follow"
        found = [m for m in licenses.find(doc, index) if m[0] == "MIT"]
        assert len(found) == 1 and found[0][3] >= least
        assert doc[found[0][5] : found[0][6]].lower().startswith("permission is hereby") and doc[found[0][5] : found[0][6]].lower().endswith("in the software")
    assert licenses.find("nothing of the sort is licensed here " * 50, index) == []
    twice = licenses.find("Released under the MIT License. " + "filler " * 40 + "Released under the MIT License.", index)
    assert [m[0] for m in twice] == ["MIT-notice"] * 2 and twice[0][6] <= twice[1][5]


def test_license_candidates_lose_nothing_against_aligning_everywhere():
    index = licenses.index_of(licenses.TEMPLATES)
    rng = np.random.default_rng(3)
    for name, words, _ in index[0]:
        text = licenses.TEMPLATES[name]
        doc = " ".join(f"w{rng.integers(1000)}" for _ in range(60)) + " " + text + " " + " ".join(f"w{rng.integers(1000)}" for _ in range(60))
        h = np.array([licenses._hash(w) for w in licenses.WORD.findall(doc.lower())], np.uint64)
        best = max(licenses.align(h, words, d - 8, d + 8)[0] for d in range(0, len(h), 5))
        assert best == len(words) and any(m[0] == name and m[1] == best for m in licenses.find(doc, index))


@pytest.mark.parametrize(("text", "name"), [
    ("Licensed under CC BY 4.0.", "CC-BY-4.0-notice"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0-notice"), ("licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0-notice"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-notice"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-notice"),
    ("Licensed under the Apache License, Version 1.1.", "Apache-1.1-notice"), ("Licensed under the Apache License, Version 3.0.", None), ("Licensed under CC BY-NC 3.0.", None),
    ("This work is licensed under the GNU Public License, version 3.", "GPL-3.0-notice"),
])
def test_licenses_are_told_from_their_siblings(text, name):
    index = licenses.index_of(licenses.TEMPLATES)
    assert [m[0] for m in licenses.find("some words before it: " + text + " And some behind it.", index)] == ([name] if name else [])


def test_full_texts_are_told_apart_and_insertions_bridged():
    index = licenses.index_of(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert [m[0] for m in licenses.find("before " + text + " after", index)] == [name]
    words = licenses.TEMPLATES["BSD-3-Clause"].split()
    got = licenses.find("start " + " ".join([*words[:45], *(f"footer{i}" for i in range(40)), *words[45:]]) + " end", index)
    assert [(m[0], m[3], m[4]) for m in got] == [("BSD-3-Clause", 1.0, 40)]


@pytest.mark.parametrize("name", sorted(n for n, t in licenses.TEMPLATES.items() if len(t.split()) >= 30))
def test_forty_words_at_any_place_lose_no_license(name):
    index, words = licenses.index_of(licenses.TEMPLATES), licenses.TEMPLATES[name].split()
    footer = [f"footer{i}" for i in range(40)]
    for at in range(0, len(words) + 1, 1 if len(words) < 80 else 5):
        got = [m[0] for m in licenses.find(" ".join(["words", "before", *words[:at], *footer, *words[at:], "after"]), index)]
        assert got == [name], (at, got)


def plain_alignment(doc, template, must):
    """Best score and most matched words of laying the whole template against any part of doc, cell by cell."""
    none = (-(10**9), 0)
    row = [(0, 0)] * (len(doc) + 1)
    for i, w in enumerate(template):
        new = [none if must[i] else (row[0][0] - 1, row[0][1])]
        for j, d in enumerate(doc):
            best = (row[j][0] + 2, row[j][1] + 1) if d == w else none if must[i] else (row[j][0] - 1, row[j][1])
            if not must[i]:
                best = max(best, (row[j + 1][0] - 1, row[j + 1][1]))
            jump = max((n[0] - licenses.SHORT, n[1]) for n in new)
            new.append(max(best, (new[j][0] - 1, new[j][1]), jump))
        row = new
    best = max(row)
    return best[1] if best[0] > -(10**8) else 0


def test_alignment_equals_a_full_table():
    rng = np.random.default_rng(8)
    for _ in range(150):
        doc, template = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, rng.integers(1, 9))
        must = rng.random(len(template)) < 0.2
        got = licenses.align(doc.astype(np.uint64), template.astype(np.uint64), -len(template) - 1, len(doc) + 1, must)
        assert got[0] == plain_alignment(doc.tolist(), template.tolist(), must.tolist())


def test_license_operator(spark, docs_of, odd_rows):
    assert licenses.scan(docs_of(odd_rows), ["doc_id"]).count() == 0
    assert licenses.scan(docs_of([]), ["doc_id"]).count() == 0
    rows = [(1, "Released under the MIT License.", "a"), (1, "Released under the MIT License.", "a"), (2, None, "b")]
    got = licenses.scan(docs_of(rows), ["doc_id", "score"]).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(1, "MIT-notice", 1.0)] * 2


def test_license_query_finds_every_line(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id for r in queries.op8_license_scan(spark, sf).select("doc_id").distinct().collect()}
    want = {d for d, t in rows_by_text(spark, sf) if any(n in t for n in ("Licensed under the Apache License, Version 2.0", "Released under the MIT License", "This work is licensed under the GNU General Public License, version 3", "Licensed under CC BY-"))}
    assert want and want <= found
