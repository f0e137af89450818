import gzip
import random
import zlib
from pathlib import Path

import pytest

from panelweave.llm import archives
from panelweave.llm.storage import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, head string"
PAGES = [
    (1, "http://a.org/x y", "<p>same</p>"),
    (2, "http://b.org/", "<p>same</p>"),
    (3, None, None),
    (4, "http://c.org/", ""),
    (5, "http://d.org/\n", "line\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nfake"),
    (6, "http://é.org/", "äöü 中文 😀 \x00 " * 50),
    (7, "http://e.org/", "http://f.org/ 0.0.0.0 20200101000000 text/html 5\nhello\n"),
    (8, "http://g.org/", "x" * 3_000_000),
    (9, "http://g.org/", "<p>same</p>"),
    (9, "http://g.org/", "<p>same</p>"),
    (None, "http://h.org/", "alone"),
    (None, "http://h.org/", "<p>same</p>"),
]


def frame(spark, pages=PAGES):
    return spark.createDataFrame([(*p, "d", "h") for p in pages], SCHEMA)


def brute(pages, least=0):
    data = [(i, (html or "").encode()) for i, _, html in pages]
    heads, out, done = {}, [], set()
    for i, body in data:
        if len(body) >= least:
            heads[body] = i if heads.get(body) is None else max(heads[body], -1 if i is None else i)
    for i, body in data:
        lone = len(body) < least or (i == heads[body] and body not in done)
        if len(body) >= least and i == heads[body]:
            done.add(body)
        out.append((i, len(body), archives.payload_digest(body), "response" if lone else "revisit", None if lone else heads[body]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip_matches_brute_force(spark, least):
    found = archives.archived_pages(frame(spark), least)
    assert sorted(map(tuple, found.collect()), key=str) == brute(PAGES, least)


def test_empty_table(spark):
    assert archives.archived_pages(frame(spark, [])).count() == 0


def test_both_versions_and_file_descriptions():
    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    v1 = b"filedesc://a.arc 0.0.0.0 20010101000000 text/plain 5\n1 0 x\nhttp://a.org/b c 1.2.3.4 20010203040506 text/html %d\n%s\n" % (len(body), body)
    v2 = b"http://a.org/ 1.2.3.4 20010203040506 text/html 200 - - 77 f.arc.gz %d\n%s\n" % (len(body), body)
    expected = ("1.2.3.4", "20010203040506", "text/html", body)
    assert list(archives.parse_arc(v1)) == [("http://a.org/b c", *expected)]
    assert list(archives.parse_arc(v2 + v1)) == [("http://a.org/", *expected), ("http://a.org/b c", *expected)]


@pytest.mark.parametrize("data", [b"no header\n", b"http://a.org/ 1.2.3.4 20010203040506 text/html 99\nshort\n"])
def test_broken_records_are_refused(data):
    with pytest.raises(ValueError, match="ARC record"):
        list(archives.parse_arc(data))


def test_archives_of_others_with_members_and_bytes(spark, tmp_path):
    """Gzip members per record, payloads that aren't text, several files."""
    payload = bytes(range(256)) * 3
    for name, ident in (("a.arc.gz", b"1"), ("b.arc", b"2")):
        body = b"HTTP/1.1 200 OK\r\nX-Page-Id: " + ident + b"\r\nContent-Length: 768\r\n\r\n" + payload
        records = [b"filedesc://x 0.0.0.0 20010101000000 text/plain 2\nv1\n", b"http://a.org/ 1.2.3.4 20010203040506 image/png %d\n%s\n" % (len(body), body)]
        pack = gzip.compress if name.endswith("gz") else bytes
        (tmp_path / name).write_bytes(b"".join(map(pack, records)))
    target = scratch_path(spark, "test-warc")
    archives.convert(spark, str(tmp_path), target)
    rows = sorted(archives.read_warc(spark, target).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.record_type, r.payload_bytes, r.date) for r in rows] == [(1, "revisit", 768, "2001-02-03T04:05:06Z"), (2, "response", 768, "2001-02-03T04:05:06Z")]
    assert rows[0].refers_to_id == rows[1].record_id and rows[0].payload_digest == archives.payload_digest(payload)


def test_record_ids_are_stable_and_distinct(spark):
    ids = []
    for _ in range(2):
        arc, warc = scratch_path(spark, "a"), scratch_path(spark, "w")
        archives.write_arc(frame(spark).coalesce(1), arc, archives.F.lit(2))
        archives.convert(spark, arc, warc)
        ids.append({r.record_id for r in archives.read_warc(spark, warc).collect()})
    assert len(ids[0]) == len(ids[1]) == len(PAGES)


def test_page_with_the_url_of_a_file_description_stays(spark):
    pages = [(1, "filedesc://a.arc", "one"), (2, "filedesc://b.arc", "two"), (3, "http://a.org/", "two")]
    assert sorted(map(tuple, archives.archived_pages(frame(spark, pages)).collect()), key=str) == brute(pages)


def test_files_are_compressed_at_the_fastest_level(spark, tmp_path):
    """The usual level costs about four times the CPU time; sizes tell the level."""
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(2000)]
    pages = [(i, f"http://a.org/{i}", " ".join(draw.choices(words, k=2000))) for i in range(40)]
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    archives.write_arc(frame(spark, pages).coalesce(1), arc, archives.F.lit(1))
    archives.convert(spark, arc, warc)
    for folder in (arc, warc):
        data = max((f.read_bytes() for f in Path(folder).glob("*.gz")), key=len)
        fast, usual = (len(zlib.compress(gzip.decompress(data), level)) for level in (1, 6))
        assert fast > 1.05 * usual and abs(len(data) - fast) < abs(len(data) - usual)


def test_records_pass_through_python_once(spark):
    """`read_described` is `describe` of `read_arc`, `read_brief` its columns without payloads; either tells the same copies."""
    arc, warcs = scratch_path(spark, "arc"), [scratch_path(spark, "warc") for _ in range(2)]
    archives.write_arc(frame(spark), arc, archives.F.col("page_id") % 2 + 1)
    slow, once, brief = archives.describe(archives.read_arc(spark, arc)), archives.read_described(spark, arc), archives.read_brief(spark, arc)
    rows = sorted(map(tuple, slow.collect()), key=str)
    assert len(rows) == len(PAGES) and sorted(map(tuple, once.collect()), key=str) == rows
    assert sorted(map(tuple, brief.collect()), key=str) == sorted(map(tuple, slow.select(*brief.columns).collect()), key=str)
    assert not {"payload", "head"} & set(brief.columns)
    assert [f._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for f in (slow, once, brief)] == [2, 1, 1]
    archives.write_warc(slow, warcs[0])
    archives.convert(spark, arc, warcs[1])
    first, second = (sorted(map(tuple, archives.read_warc(spark, w).collect()), key=str) for w in warcs)
    assert first == second and len(first) == len(PAGES)
