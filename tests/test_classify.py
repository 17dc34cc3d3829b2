"""Class boundaries, labels and date formats (golden cases)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stormgrid.functions import classify as C
from stormgrid.functions import dates as D

WINDS = [None, 0, -1, 33, 34, 63, 64, 82, 83, 95, 96, 112, 113, 136, 137, 250, 251]


def test_wind_classes(spark):
    df = spark.createDataFrame([(w,) for w in WINDS], "w int")
    rows = df.select("w", C.saffir_simpson("w").alias("c"), C.wind_row_class("w").alias("r"),
                     C.wind_bucket("w").alias("b"), C.saffir_simpson_short("w").alias("s")).collect()
    got = {r.w: (r.c, r.r, r.b, r.s) for r in rows}
    assert got[None][:3] == ("N/A", "", "N/A")
    assert got[0][:3] == ("N/A", "", "N/A")
    assert got[-1][0] == "N/A" and got[-1][2] == "Weak"   # bucket only treats 0/null as no data
    assert got[33] == ("Tropical Depression", "low", "Weak", "TD")
    assert got[34] == ("Tropical Storm", "medium", "Moderate", "TS")
    assert got[63][0] == "Tropical Storm" and got[64][0] == "Hurricane Cat 1"
    assert got[64][1:3] == ("high", "Strong")
    assert got[82][0] == "Hurricane Cat 1" and got[83][0] == "Hurricane Cat 2"
    assert got[95][0] == "Hurricane Cat 2" and got[96][0] == "Hurricane Cat 3"
    assert got[96][2] == "Very strong"
    assert got[112][0] == "Hurricane Cat 3" and got[113][0] == "Hurricane Cat 4"
    assert got[136][0] == "Hurricane Cat 4" and got[137][0] == "Hurricane Cat 5"
    assert got[251][3] == "Cat 5"


def test_height_classes(spark):
    hs = [None, 0.0, 1.99, 2.0, 4.99, 5.0, 9.99, 10.0, 29.99, 30.0]
    df = spark.createDataFrame([(h,) for h in hs], "h double")
    got = {r.h: (r.a, r.b) for r in df.select(
        "h", C.water_height_class("h").alias("a"), C.water_height_class_detailed("h").alias("b")).collect()}
    assert got[None] == ("minor", "unknown") and got[0.0] == ("minor", "unknown")
    assert got[1.99] == ("minor", "minor") and got[2.0] == ("moderate", "moderate")
    assert got[5.0] == ("major", "major") and got[10.0] == ("catastrophic", "severe")
    assert got[29.99][1] == "severe" and got[30.0][1] == "catastrophic"


def test_labels(spark):
    df = spark.createDataFrame([(1, 1, "TS"), (11, 4, "XX"), (12, None, None)], "c int, v int, n string")
    rows = df.select(C.cause_label("c").alias("c"), C.validity_label("v").alias("v"),
                     C.nature_label("n").alias("n")).collect()
    assert rows[0] == ("Earthquake", "Very Doubtful", "Tropical Storm")
    assert rows[1] == ("Astronomical Tide", "Definite", "XX")   # unknown nature passes through
    assert rows[2] == ("Unknown", None, "N/A")


def test_dates(spark):
    df = spark.createDataFrame([(2004, 12, 26), (-500, 3, None), (0, 1, 1), (None, 5, 5),
                                (1755, 13, 1), (1960, 0, 0)], "y int, m int, d int")
    rows = df.select(D.partial_date("y", "m", "d").alias("p"), D.tsunami_date("y", "m", "d").alias("t")).collect()
    assert rows[0] == ("2004-12-26", "26 Dec 2004")
    assert rows[1] == ("-500-03", "Mar -500")
    assert rows[2] == ("Unknown", "Unknown") and rows[3] == ("Unknown", "Unknown")
    assert rows[4][1] == "1 1755"                 # month 13 has no name
    assert rows[5] == ("1960", "1960")


@pytest.mark.parametrize("parts,expected", [
    ((2004, 12, 26, 0, 58, 53.0), "2004-12-26 00:58:53"),
    ((2020, 2, 31, 0, 0, 0.0), None),              # impossible date -> null
    ((-100, 1, 1, 0, 0, 0.0), None),               # BC -> null
    ((1900, 0, 0, None, None, None), "1900-01-01 00:00:00"),
    ((1900, 13, 40, 30, 75, 75.5), "1900-12-31 23:59:59"),   # clamped, seconds truncated
])
def test_event_datetime(spark, parts, expected):
    df = spark.createDataFrame([parts], "y int, mo int, d int, h int, mi int, s double")
    v = df.select(D.event_datetime("y", "mo", "d", "h", "mi", "s").alias("t")).first().t
    assert (v.strftime("%Y-%m-%d %H:%M:%S") if v else None) == expected


def test_iso_text(spark):
    """As Python's isoformat, with microseconds only where there are any."""
    times = [dt.datetime(2004, 12, 26, 0, 58, 53), dt.datetime(1842, 10, 25, 6), dt.datetime(2001, 2, 3, 4, 5, 6, 70), None]
    frame = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select("t", D.iso_text("t").alias("s"))
    assert all(r.s == (r.t.isoformat() if r.t else "") for r in frame.collect())
