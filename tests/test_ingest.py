"""Ingest text cases: best-track CSV and tsunami TSV read from real files."""

import os

import pytest
from pyspark.sql import functions as F

from stormgrid.sources import best_track as BT
from stormgrid.sources import tsunami_tsv as TSV

CSV_TEXT = """SID,SEASON,NUMBER,BASIN,SUBBASIN,NAME,ISO_TIME,NATURE,LAT,LON,WMO_WIND,WMO_PRES,DIST2LAND,LANDFALL,USA_WIND
 ,Year, , , , , ,degrees_north,degrees_north,degrees_east,kts,mb,km,km,kts
2000001N10100,2000,1,NA,MM,ALPHA,2000-01-01 00:00:00,TS,10.5,100.0,35,1000,200,200,35
2000001N10100,2000,1,NA,MM,,2000-01-01 06:00:00,TS,10.7,100.5, ,999,150,150,
2000001N10100,2000,1,NA,MM,ALPHA,2000-01-01 12:00:00,TS,abc,101.0,40,998,100,100,40
2000001N10100,2000,1,NA,MM,ALPHA,2000-01-01 18:00:00,TS,11.0,181.0,45,997,50,50,45
2000001N10100,2000,1,NA,MM,ALPHA,,TS,11.2,101.5,45,997,50,50,45
2000002S10100,2000,2,SI,MM,BETA,2000-02-01 00:00:00,TS,-10.0,100.0,50.0,990,-3,0,
"""
BIG_ROW = "2000003S10100,99999999999,2,SI,MM,GAMMA,2000-02-01 00:00:00,TS,-10.0,100.0,5000000000,990,-3,0,\n"


def test_best_track_csv(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "bt.csv")
    with open(path, "w") as f:
        f.write(CSV_TEXT)
    kept, rejected = BT.read_best_track_csv(spark, path)
    k = sorted(kept.collect(), key=lambda r: (r.sid, r.iso_time))
    assert len(k) == 3
    assert k[0].basin is None                        # 'NA' reads as missing (Q1)
    assert k[1].name == "UNNAMED" and k[1].wmo_wind is None
    assert k[2].wmo_wind == 50 and k[2].dist2land == -3   # '50.0' -> 50 (numeric, truncated)
    reasons = sorted(r.reject_reason for r in rejected.collect())
    assert reasons == ["bad time", "no position", "no position", "position out of range"]
    rep = BT.ingest_report(BT.classify_best_track(
        spark.read.option("header", True).csv(path).select(*BT.BEST_TRACK_COLUMNS))).first()
    assert (rep.rows_read, rep.rows_kept, rep.rows_removed, rep.unique_storms) == (7, 3, 4, 2)
    assert kept.select(F.countDistinct("obs_id")).first()[0] == 3


def test_best_track_values_that_do_not_fit(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "big.csv")
    with open(path, "w") as f:
        f.write(CSV_TEXT + BIG_ROW)
    kept, rejected = BT.read_best_track_csv(spark, path)
    assert kept.count() == 3
    assert rejected.filter("sid = '2000003S10100'").first().reject_reason == "value does not fit its column"


def test_tsunami_missing_tokens_and_big_integers(spark):
    lines = [_tsv_line(Year="NA"), _tsv_line(Country="NA", **{"Location Name": "None"}), _tsv_line(Deaths="99999999999"), _tsv_line(Deaths="2147483649"),
             _tsv_line(Deaths="9e9", Country='"NA"'), _tsv_line(Year='"NA"')]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    ev, rej, rep = TSV.parse_tsunami_lines(frame)
    assert [(r.country, r.location_name, r.deaths, r.overflow) for r in ev.orderBy("deaths").collect()] == [(None, "SUMATRA", None, None), (None, None, 227899, None)]
    reasons = {r.line: r.reject_reason for r in rej.collect()}
    too_big = "value does not fit its column: deaths"
    assert reasons == {lines[0]: "no year", lines[2]: too_big, lines[3]: too_big, lines[5]: "no year"}
    assert (rep.first().overflow_rows, rep.first().records_built) == (2, 2)
    ev, rej, rep = TSV.parse_tsunami_lines(frame, reject_overflow=False)  # on request: null, and named
    assert sorted((r.deaths, r.overflow) for r in ev.collect() if r.overflow) == [(None, "deaths")] * 2


def _written(folder, **files):
    for name, lines in files.items():
        with open(os.path.join(folder, f"{name}.tsv"), "w") as f:
            f.write("\n".join(lines) + "\n")
    return folder


def test_tsunami_quoted_cells(spark, tmpdir_path):
    """Tabs, quotes and line breaks in quoted cells, quoted headers, short and empty lines."""
    header = "\t".join(f'"{h}"' if k % 3 == 0 else h for k, (h, _, _) in enumerate(TSV.FIELDS))
    good = [_tsv_line(Deaths="1", **{"Location Name": '"KII\tOWASE"'}), _tsv_line(Deaths="2", **{"Location Name": '"SO ""CALLED"" BAY"'}),
            _tsv_line(Deaths="3", **{"Location Name": '"NORTH\nSOUTH"', "Year": '"1999"'}), _tsv_line(Deaths="4", Country='MID"DLE'),
            "\t".join(_tsv_line(Deaths="5").split("\t")[:20])]
    bad = [_tsv_line() + "\tmore", _tsv_line(**{"Location Name": '"A\tB"'}) + "\t", _tsv_line(Year='"[""Year >= 1970""]"'), _tsv_line(Latitude="91", Country='"X\tY"')]
    path = _written(tmpdir_path, one=[header, *good, "", *bad])
    ev, rej, rep = TSV.read_tsunami_tsv(spark, path)
    got = {r.deaths: r for r in ev.collect()}
    assert [got[k].location_name for k in (1, 2, 3)] == ["KII\tOWASE", 'SO "CALLED" BAY', "NORTH\nSOUTH"]
    assert got[3].year == 1999 and got[4].country == 'MID"DLE' and got[5].total_deaths is None and len(got) == 5
    assert sorted(r.reject_reason for r in rej.collect()) == ["no coordinates", "no year", "too many cells", "too many cells"]
    assert {r.line for r in rej.filter("reject_reason = 'too many cells'").collect()} == set(bad[:2])
    r = rep.first()
    assert (r.rows_loaded, r.rows_after_cleaning, r.records_built) == (7, 6, 5)
    lines = spark.createDataFrame([(x,) for x in good + bad], "line string")
    ev2, rej2, _ = TSV.parse_tsunami_lines(lines)
    assert sorted(map(str, ev2.drop("id").collect())) == sorted(map(str, ev.drop("id").collect())) and rej2.count() == 4


def test_tsunami_header_of_each_file(spark, tmpdir_path):
    """Files of other column orders are read by their own headers, or fail the read."""
    turned = lambda line: "\t".join(reversed(line.split("\t")))
    path = _written(tmpdir_path, a=[TSV.HEADER, _tsv_line(Deaths="1")], b=[turned(TSV.HEADER), turned(_tsv_line(Deaths="2"))], c=[TSV.HEADER, _tsv_line(Deaths="3")])
    ev, rej, _ = TSV.read_tsunami_tsv(spark, path, header_per_file=True)
    assert sorted((r.deaths, r.country, r.year) for r in ev.collect()) == [(k, "INDONESIA", 2004) for k in (1, 2, 3)] and rej.count() == 0
    with pytest.raises(Exception, match="(?i)header"):
        TSV.read_tsunami_tsv(spark, path)[0].collect()


def test_tsunami_rows_that_do_not_fit_are_rejected_whole(spark):
    lines = [_tsv_line(), _tsv_line(Deaths="99999999999"), _tsv_line(Country="X" * 101, Sec="123456.7"), _tsv_line(Latitude="91", Deaths="99999999999")]
    ev, rej, rep = TSV.parse_tsunami_lines(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [(r.deaths, r.overflow) for r in ev.collect()] == [(227899, None)]
    reason = "value does not fit its column: "
    assert {(r.line, r.reject_reason) for r in rej.collect()} == {(lines[1], reason + "deaths"), (lines[2], reason + "second,country"), (lines[3], "no coordinates")}
    r = rep.first()
    assert (r.records_built, r.overflow_rows, r.skipped_no_coords) == (1, 2, 1)


def _tsv_line(**over):
    vals = {h: "" for h, _, _ in TSV.FIELDS}
    vals.update({"Year": "2004", "Mo": "12", "Dy": "26", "Hr": "0", "Mn": "58", "Sec": "53.4",
                 "Tsunami Event Validity": "4", "Tsunami Cause Code": "1",
                 "Earthquake Magnitude": "9.1", "Country": "INDONESIA",
                 "Location Name": '"SUMATRA"', "Latitude": "3.316", "Longitude": "95.854",
                 "Maximum Water Height (m)": "50.9", "Deaths": "227899"})
    vals.update(over)
    return "\t".join(vals[h] for h, _, _ in TSV.FIELDS)


def test_tsunami_tsv(spark, tmpdir_path):
    lines = [
        TSV.HEADER,
        _tsv_line(Year='["Year >= 1970"]'),                  # search-parameter row
        _tsv_line(),                                          # good
        _tsv_line(Year=""),                                   # blank year: dropped
        _tsv_line(Mo="2", Dy="31", Country='" JAPAN "'),      # impossible date, quoted cell
        _tsv_line(Year="-1250", Mo="", Dy=""),                # BC year: kept, no datetime
        _tsv_line(Mo="0", Dy="0", Hr="", Sec="75"),           # month/day 0 -> 1, seconds clamp
        _tsv_line(Mo="13", Country='  "PERU"  '),              # month clamps; quotes then spaces
        _tsv_line(Deaths="5.0"),                              # not an integer -> null
        _tsv_line() + "\textra",                              # too many cells: skipped
        _tsv_line(Latitude="91"),                             # out of range: no coordinates
        _tsv_line(**{"Earthquake Magnitude": "12345.6"}),     # overflow: rejected whole
        _tsv_line(Country="X" * 101),                         # too long: rejected whole
    ]
    path = os.path.join(tmpdir_path, "ts.tsv")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    ev, rej, rep = TSV.read_tsunami_tsv(spark, path)
    rows = ev.orderBy("year", "month", "deaths").collect()
    assert len(rows) == 6
    bc = [r for r in rows if r.year == -1250][0]
    assert bc.event_datetime is None and bc.month is None
    feb = [r for r in rows if r.month == 2][0]
    assert feb.event_datetime is None and feb.country == "JAPAN"
    zero = [r for r in rows if r.month == 0][0]
    assert str(zero.event_datetime) == "2004-01-01 00:58:59" and float(zero.second) == 75.0
    m13 = [r for r in rows if r.month == 13][0]
    assert m13.event_datetime.month == 12
    assert m13.country == '"PERU"'   # quotes are stripped before spaces, as the importer does
    assert any(r.deaths is None for r in rows)
    assert all(r.overflow is None for r in rows)
    assert all(r.location_name == "SUMATRA" for r in rows)
    assert float(rows[-1].latitude) == 3.316 and rows[-1].lat_d == 3.316
    r = rep.first()
    assert (r.rows_loaded, r.rows_after_cleaning, r.records_built, r.skipped_no_coords, r.bc_events, r.overflow_rows) \
        == (11, 9, 6, 1, 1, 2)
    assert sorted(x.reject_reason for x in rej.collect()) == \
        ["no coordinates", "no year", "no year", "too many cells",
         "value does not fit its column: country", "value does not fit its column: earthquake_magnitude"]


def test_tsunami_cells_are_cleaned_once(spark):
    """Cleaning is one expression for all cells, so that the generated code stays small; every kind of cell keeps its value."""
    lines = [_tsv_line(Deaths=" 7 ", Country='" JAPAN "', **{"Location Name": " ", "Earthquake Magnitude": "7.25", "Damage ($Mil)": "NA"}),
             _tsv_line(Country="X" * 100, Sec="NaN", Deaths="5.0"), _tsv_line(Country="Y" * 101), _tsv_line(**{"Maximum Water Height (m)": "1234567.8"})]
    ev, rej, rep = TSV.parse_tsunami_lines(spark.createDataFrame([(x,) for x in lines], "line string"), reject_overflow=False)
    plan = ev._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 8  # one or two for each of 40 cells before
    rows = ev.collect()
    by = {(r.country, r.overflow): r for r in rows}
    one = by[("JAPAN", None)]
    assert (one.deaths, str(one.earthquake_magnitude), one.damage_mil, one.location_name) == (7, "7.3", None, None)
    assert by[("X" * 100, None)].deaths is None and by[("X" * 100, None)].second is None
    assert {r.overflow for r in rows} == {None, "country", "max_water_height"} and rej.count() == 0 and rep.first().overflow_rows == 2
