import glob
import gzip
import hashlib

from pyspark.sql import functions as F

from ledgerlens.llm import warc
from ledgerlens.llm.queries import LLM_QUERIES

SCHEMA = "page_id long, url string, html string"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(rows):
    """Rows of the query by a plain loop over the pages."""
    first, out = {}, []
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        if len(data) >= 100 and digest in first:
            out.append((i, len(data), digest, "revisit", first[digest]))
        else:
            first.setdefault(digest, i)
            out.append((i, len(data), digest, "response", None))
    return sorted(out, key=repr)


def query(spark, df, folder):
    df.write.parquet(f"{folder}/pages.parquet")
    found = LLM_QUERIES["op13_warc_archives"](spark, str(folder))
    return sorted((tuple(r) for r in found.select(COLUMNS).collect()), key=repr)


FORGED = "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "\x1f\x8b\0" * 30
ROWS = (
    [(i, f"http://a/{i}", "<p>" + "copy " * 40) for i in range(30, 5, -1)]
    + [(40, "http://b", "y" * 100), (39, "http://b", "y" * 100), (41, "c", "z" * 99), (42, "c", "z" * 99)]
    + [(43, None, FORGED), (44, "http://x\r\nWARC-Type: revisit\r\n é", FORGED)]
    + [(50, "n", None), (51, "n", None), (52, "n", ""), (None, "n", None), (None, "n", "y" * 100)]
    + [(60, "same", "w" * 300)] * 5 + [(None, None, "v" * 200)] * 3
    + [(70, "long", "ä€\n" * 700_000), (71, "long", "ä€\n" * 700_000)]
)


def test_the_query_with_nulls_copies_forged_marks_and_clashing_names(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    df = df.withColumn("payload", F.lit(1)).withColumn("key", F.lit("k")).withColumn("refers_to", F.lit(None).cast("int"))
    assert query(spark, df, tmp_path) == brute(ROWS)


def test_the_query_on_the_small_tables(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    found = LLM_QUERIES["op13_warc_archives"](spark, "/root/testdata/sf0.001").select(COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_archives_are_standard_files_with_all_payloads(spark, tmp_path):
    path = f"{tmp_path}/archives"
    warc.write(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path, "page_id", "url", "html", archive_bytes=500)
    files = glob.glob(f"{path}/part-*")
    assert len(files) > 3
    payloads, kinds = [], []
    for name in files:
        data = gzip.open(name).read()  # fails unless every byte belongs to a member
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            block, data = rest[:size], rest[size + 4 :]
            kinds.append(fields[b"WARC-Type"])
            if kinds[-1] == b"response":
                payloads.append(block.split(b"\r\n\r\n", 1)[1])
            else:
                assert b"WARC-Refers-To" in fields and block.endswith(b"\r\n\r\n")
    want = brute(ROWS)
    assert len(kinds) == len(ROWS) and kinds.count(b"revisit") == sum(r[3] == "revisit" for r in want)
    assert sorted(hashlib.sha256(p).hexdigest() for p in payloads) == sorted(r[2] for r in want if r[3] == "response")
    read = warc.read(spark, path)
    assert read.select("record_id").distinct().count() == len(ROWS)
    forged = [r for r in read.collect() if r["source_id"] == "44"]
    assert [r["url"] for r in forged] == ["http://x%0D%0AWARC-Type:%20revisit%0D%0A%20é"]
    whole = {r["payload"].decode() for r in read.where("record_type = 'response'").collect()}
    assert whole == {r[2] or "" for r in ROWS}


def test_empty_table(spark, tmp_path):
    assert query(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []


def test_a_cut_archive_is_refused():
    whole = warc.member(b"one") + warc.member(b"two")
    assert list(warc.members(whole)) == [b"one", b"two"]
    try:
        list(warc.members(whole[:-3]))
    except ValueError:
        return
    raise AssertionError("a cut archive was read")
