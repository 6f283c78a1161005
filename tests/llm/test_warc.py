import gzip
import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from pixeltide.llm import warc
from pixeltide.sources.shared_folder import stored

LEAF = "file long, offset long, length long, record_id string, digest string"


def test_written_files_are_read_back_record_by_record(spark, tmp_path):
    bodies = ["<p>a</p>", "", None, "WARC/1.0\r\nContent-Length: 3\r\n\r\nx\r\n\r\n", "é🙂\r\n\r\nmore", "z" * 100_000]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1", b) for i, b in enumerate(bodies)], "id long, url string, html string")
    record = warc.record(F.concat(F.lit("urn:page:"), F.col("id")), F.col("url"), F.col("html"), "2024-01-01T00:00:00Z")
    made = pages.select((F.col("id") % 2).alias("file"), F.col("id").alias("place"), record.alias("record"))
    path = str(tmp_path / "a")
    warc.write_warc(made, path)
    records = {r.place: r.record.encode() for r in made.collect()}
    for r in warc.read_leaves(spark, path).collect():
        page = int(r.record_id.rpartition(":")[2])
        assert (r.file, r.length, r.digest) == (page % 2, len(records[page]), hashlib.sha256(records[page]).hexdigest())
        (part,) = Path(path).glob(f"file={r.file}/*.gz")
        data = gzip.decompress(part.read_bytes())
        assert data[r.offset : r.offset + r.length] == records[page]
        assert b"\r\nEvil" not in records[page]
    assert warc.read_leaves(spark, path).count() == len(bodies)


def test_broken_records_do_not_hide_the_next_one():
    good = b"WARC/1.0\r\nWARC-Record-ID: <b>\r\nContent-Length: 2\r\n\r\nhi"
    data = b"WARC/1.0\r\nWARC-Record-ID: <a>\r\nContent-Length: 999\r\n\r\nhello\r\n\r\n" + good + b"\r\n\r\n"
    assert [(i, r) for _, i, r in warc.records_of(data)][1] == (b"b", good)
    assert list(warc.records_of(b"")) == [] and list(warc.records_of(b"junk")) == [(0, b"", b"junk")]
    assert len(list(warc.records_of(b"WARC/1.0\r\ntruncated"))) == 1


def record(name, body):
    return f"WARC/1.0\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(body)}\r\n\r\n{body}".encode()


def archive(folder, records, junk=b"", members=True, cut=0):
    """A real file with one gzip member for each record."""
    parts = [r + b"\r\n\r\n" for r in records] + ([junk] if junk else [])
    packed = b"".join(map(gzip.compress, parts)) if members else gzip.compress(b"".join(parts))
    (folder / "file=0").mkdir(parents=True)
    (folder / "file=0" / "a.warc.gz").write_bytes(packed[: len(packed) - cut])
    return str(folder)


def test_all_gzip_members_and_all_bytes_are_read(spark, tmp_path):
    records = [record(f"r{k}", "x" * k) for k in range(7)]
    wanted = [hashlib.sha256(r).hexdigest() for r in records]
    for name, members in (("one", False), ("many", True)):
        found = warc.read_leaves(spark, archive(tmp_path / name, records, members=members)).orderBy("offset").collect()
        assert [r.digest for r in found] == wanted
    junk = warc.read_leaves(spark, archive(tmp_path / "junk", records, b"?" * 800)).orderBy("offset").collect()
    assert [r.digest for r in junk[:-1]] == wanted and (junk[-1].record_id, junk[-1].length) == ("", 800)
    short = warc.read_leaves(spark, archive(tmp_path / "short", records, cut=30)).collect()
    assert set(wanted[:6]) <= {r.digest for r in short} and wanted[6] not in {r.digest for r in short}
    behind = tmp_path / "behind"
    archive(behind, records)
    with open(behind / "file=0" / "a.warc.gz", "ab") as file:
        file.write(b"\x1f\x8bno member")
    assert warc.read_leaves(spark, str(behind)).where("record_id = ''").first().length == 11
    every = warc.unpacked((behind / "file=0" / "a.warc.gz").read_bytes())
    assert b"".join(r for _, _, r in warc.records_of(every)) == every.replace(b"\r\n\r\nWARC", b"WARC").replace(b"\r\n\r\n\x1f", b"\x1f")


def test_a_lost_grown_or_cut_record_is_all_that_is_reported(spark, tmp_path):
    records = [record(f"r{k}", f"{k} " * 9000) for k in range(40)]
    read = lambda name, rs, junk=b"": stored(warc.read_leaves(spark, archive(tmp_path / name, rs, junk)), "leaves")
    one = read("one", records)
    grown = record("r5", "5 " * 9000 + "more")
    cut = records[20][:-100]
    for name, copy, ids in (
        ("lost", records[:7] + records[8:], {"r7"}),
        ("grown", records[:5] + [grown] + records[6:], {"r5"}),
        ("cut", records[:20] + [cut] + records[21:], {"r20"}),
        ("extra", records + [record("r99", "new")], {"r99"}),
        ("all", records[:5] + [grown] + records[6:7] + records[8:20] + [cut] + records[21:], {"r5", "r7", "r20"}),
    ):
        found = warc.audit(one, read(name, copy)).collect()
        assert {r.record_id for r in found} == ids and len(found) == len(ids), name
    (junk,) = warc.audit(one, read("junk", records, b"?" * 800)).collect()
    assert junk.record_id == "" and junk.length == 800 and junk.found is None


def leaves(spark, rows, damage=()):
    rows = [(f, o, 10, f"r{f}-{o}", "bad" if (f, o) in damage else f"d{f}-{o}") for f, o in rows]
    return stored(spark.createDataFrame(rows, LEAF), "leaves")


def test_only_damage_is_reported(spark):
    places = [(f, o * 5000) for f in range(4) for o in range(60)] + [(9, 3 * 10**9)]
    damage = {(0, 5000), (0, 295_000), (3, 0), (9, 3 * 10**9)}
    lost = [p for p in places if p != (2, 70_000)] + [(8, 0)]
    got = warc.audit(leaves(spark, places), leaves(spark, lost, damage)).collect()
    assert {(r.file, r.offset) for r in got} == damage | {(2, 70_000), (8, 0)}
    by = {(r.file, r.offset): r for r in got}
    assert by[2, 70_000].found is None and by[2, 70_000].digest == "d2-70000"
    assert by[8, 0].digest == "d8-0" and by[8, 0].found is None
    assert by[3, 0].found == "bad"


def test_equal_and_empty_replicas(spark):
    one = leaves(spark, [(0, 0), (0, 10)])
    none = leaves(spark, [])
    assert warc.audit(one, one).collect() == []
    assert warc.audit(none, none).collect() == []
    assert warc.audit(one, none).count() == 2
