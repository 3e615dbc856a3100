import datetime

import duckdb
from pyspark.sql import functions as F

from tidewell.functions.isotime import iso_micros, iso_micros_sql

GOOD = {
    "2016-01-04T06:08:26.677Z": "2016-01-04T06:08:26.677+00:00", "2016-01-04T06:32:30Z": "2016-01-04T06:32:30+00:00", "20160104T063609Z": "2016-01-04T06:36:09+00:00", "20160104T063609.5": "2016-01-04T06:36:09.5+00:00",
    "2016-01-04 11:31:02,887": "2016-01-04T11:31:02.887+00:00", "2016-01-03T22:22:19.230-08:00": "2016-01-04T06:22:19.23+00:00", "2016-01-04T06:22:19+0530": "2016-01-04T00:52:19+00:00", "20160104 063609+05": "2016-01-04T01:36:09+00:00",
    "2016-02-29T23:59:59.999999999Z": "2016-02-29T23:59:59.999999+00:00", "1969-12-31T23:59:59Z": "1969-12-31T23:59:59+00:00", "2016-01-04T06:22:19-00:00": "2016-01-04T06:22:19+00:00",
}
BAD = ["", None, "yesterday", "2016-01-1", "2016-01-19T", "T10:15:00Z", "1451929050", "17.01.2016 10:15", "2016-02-30T00:00:00Z", "2016-13-01T00:00:00Z", "2016-01-01T25:00:00Z", "2016-01-01T24:00:00Z", "2016-01-01T10:60:00Z", "2016-01-01T10:00:60Z",
    "2016-01-01T10:00Z", "2016-01-01", " 2016-01-01T10:00:00Z", "2016-01-01T10:00:00Z ", "2016-01-01  10:00:00", "2016-01-01t10:00:00z", "2016-01-01T10:00:00.Z", "2016-01-01T10:00:00+5:30", "2016-01-01T100000Z", "0000-00-00T00:00:00Z", "2016-01-01T10:00:00Z\n", "2016-01-01T10:00:00+05:70"]


def test_readable_and_unreadable(spark):
    texts = [*GOOD, *BAD]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(iso_micros(F.col("t"))).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        epoch = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
        expected = [(datetime.datetime.fromisoformat(v) - epoch) // datetime.timedelta(microseconds=1) for v in GOOD.values()] + [None] * len(BAD)
        assert dict(zip(texts, got, strict=True)) == dict(zip(texts, expected, strict=True))


def test_sql_form_agrees():
    db = duckdb.connect()
    for text, expected in [*GOOD.items(), *((b, None) for b in BAD if b is not None and "\n" not in b)]:
        got = db.execute(f"SELECT {iso_micros_sql('t')} FROM (SELECT ? AS t)", [text]).fetchall()[0][0]
        assert (got is None) == (expected is None), text


def test_a_long_fraction_keeps_its_zone(spark):
    digits = "123456" + "7" * 200
    texts = [f"2016-01-04T06:22:19.{digits}+05:30", f"20160104T062219,{digits}+0530", f"20160104 062219.{digits}-08", f"2016-01-04 06:22:19.{digits}Z", f"2016-01-04T06:22:19.{digits}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(iso_micros(F.col("t"))).collect()]
    begin = 1_451_888_539_123_456  # 2016-01-04T06:22:19.123456Z
    assert got == [begin - 19_800_000_000, begin - 19_800_000_000, begin + 28_800_000_000, begin, begin]
