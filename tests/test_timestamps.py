import datetime as dt
import zoneinfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import timestamps as T

CASES = [
    ("2017", "en-US", None, "2017"), (" (2001) ", None, None, "2001"), ("２００６", None, None, "2006"), ("Jan 2022", "en-US", None, "2022-01"), ("Jun '13", None, None, "2013-06"),
    ("4th December 2004", None, None, "2004-12-04"), ("12. Dezember 2020", "de-DE", None, "2020-12-12"), ("27 mayo 2009", None, None, "2009-05-27"), ("13 août 2020", None, None, "2020-08-13"),
    ("octu. 2007", None, None, "2007-10"), ("2002年3月", "ja-JP", None, "2002-03"), ("1998年4月15日", None, None, "1998-04-15"), ("02-13-2002", "de-DE", None, "2002-02-13"),
    ("03/02/2009", "en-US", None, "2009-03-02"), ("03/02/2009", None, None, "2009-02-03"), ("03.02.2009", "en-US", None, "2009-02-03"), ("14-Mar-01", None, None, "2001-03-14"), ("12-Jun-31", None, None, "1931-06-12"),
    ("31.02.2019", None, None, None), ("13/2021", None, None, None), ("0000-00-00", None, None, None), ("2017-14-09", None, None, None), ("soon", None, None, None), ("", None, None, None), (None, None, None, None),
    ("1494308493", None, "Asia/Tokyo", "2017-05-09T05:41:33Z"), ("1439337423808", None, None, "2015-08-11T23:57:03Z"), ("2010-12-14 21:48:22 America/Chicago", None, "Asia/Tokyo", "2010-12-15T03:48:22Z"),
    ("2011-05-16 04:28:00+0545", None, None, "2011-05-15T22:43:00Z"), ("Thu, 06 Jun 2013 00:50:00 +0000", None, "Asia/Tokyo", "2013-06-06T00:50:00Z"), ("7 Jun 2011 00:48:00 EDT", None, None, "2011-06-07T04:48:00Z"),
    ("01/01/2013 12:38:00 AM", "en-GB", None, "2013-01-01T00:38:00Z"), ("20120618T234500", None, "America/New_York", "2012-06-19T03:45:00Z"),
    ("2017-11-05 01:30:00", None, "America/Chicago", "2017-11-05T06:30:00Z"), ("2017-03-12 02:59:00", None, "America/New_York", "2017-03-12T07:59:00Z"), ("2017-03-12 02:59:00", None, "No/Where", "2017-03-12T02:59:00Z"),
]


@pytest.mark.parametrize(("value", "locale", "zone", "want"), CASES)
def test_normal_form(value, locale, zone, want):
    assert T.normal_forms(pd.Series([value]), pd.Series([locale]), pd.Series([zone]))[0] == want


def test_transitions_agree_with_fold_zero():
    for zone in ("America/New_York", "Australia/Sydney", "Europe/Berlin"):
        local, offsets = T.transition_table(zone)
        z = zoneinfo.ZoneInfo(zone)
        for year in (1975, 1999, 2014, 2026):
            for hour in range(0, 24 * 366, 7):
                t = dt.datetime(year, 1, 1) + dt.timedelta(hours=hour, minutes=29)
                seconds = int((t - dt.datetime(1970, 1, 1)).total_seconds())
                assert offsets[local.searchsorted(seconds, side="right")] == t.replace(tzinfo=z).utcoffset().total_seconds()


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 7, "2017", "x"), (2, 7, None, "x"), (3, 8, "05:00", "x"), (4, 9, "2017-01-01 00:00:00", "x"), (4, 9, "2017-01-01 00:00:00", "x")], "row_id long, doc_id long, start_date string, locale string")
    contact = spark.createDataFrame([(9, "en-US", "Asia/Tokyo", None), (9, "en-US", "Asia/Tokyo", dt.datetime(2020, 1, 1))], "doc_id long, locale string, time_zone string, received_at timestamp")
    got = sorted(tuple(r) for r in T.normalise_dates(rows, contact, "experience", "row_id", ["start_date"]).collect())
    assert got == [("experience", 1, "start_date", "2017"), *[("experience", 4, "start_date", "2016-12-31T15:00:00Z")] * 2]
    assert T.normalise_dates(rows.where(F.lit(False)), contact, "experience", "row_id", ["start_date"]).count() == 0


def test_very_long_values():
    values = ["1" * 100_000, "x" * 100_000, "May " * 40_000 + "2017", "2017" + " " * 100_000, "\t" * 300 + "4th  December" + " " * 500 + "2004"]
    none = pd.Series([None] * len(values))
    assert T.normal_forms(pd.Series(values), none, none).tolist() == [None, None, None, "2017", "2004-12-04"]


def test_order_of_values_does_not_matter():
    values = [v for v, *_ in CASES if v] + ["Started 12 May 2020", "Monday 12 May 2020", "Tue 12 Mai 2020", "été 12 May 2020", "2017-01-01 10:00 utc+2", "2017-01-01 10:00 est+2", "2017-01-01 10:00 señor"]
    none = pd.Series([None] * len(values))
    forms = None
    for k in range(len(values)):
        T._BOUND.clear()
        turned = values[k:] + values[:k]
        got = dict(zip(turned, T.normal_forms(pd.Series(turned), none, none), strict=True))
        forms = forms or got
        assert got == forms
    assert forms["Monday 12 May 2020"] == "2020-05-12" and forms["Started 12 May 2020"] is None
