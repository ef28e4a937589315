"""Boundary cases of text and date functions."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from plantlists.functions import dates, text


def value(spark, column, cell, kind: str = "string"):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(cell,)], f"s {kind}").select(column(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(("cell", "number", "rest"), [("12,5 kg", 12.5, None), ("7 MM", 7.0, None), ("-3.456", -3.46, None), ("3 pcs", None, "3 pcs"), ("", None, None), (None, None, None)])
def test_parse_unit_number(spark, cell, number, rest) -> None:
    assert tuple(value(spark, text.parse_unit_number, cell)) == (number, rest)


@pytest.mark.parametrize(("cell", "mode", "expected"), [("1.234,50 EUR", "last_sep", 1234.5), ("1,234.5", "comma_thousands", 1234.5), ("12,5", "comma_thousands", 12.5), ("1 200,5", "comma_decimal", 1200.5), ("N/A", "comma_decimal", None), ("a12,5b", "strip_nondigits", 12.5), ("3,456 kg", "strip_unit", 3.46)])
def test_parse_number(spark, cell, mode, expected) -> None:
    assert value(spark, lambda c: text.parse_number(c, mode), cell) == expected


@pytest.mark.parametrize(
    ("cell", "expected"),
    [("(12.50)", -12.5), ("12-", -12.0), ("50%", 0.5), ("1,234", None), ("1,234,567", 1234567.0), ("1.234,5", 1234.5), ("€ 1'000", 1000.0), ("1e3", 1000.0), ("12345678901234567", None), ("٣", 3.0), ("x", None), (None, None), ("", None)],
)
def test_parse_number_strict(spark, cell, expected) -> None:
    assert value(spark, text.parse_number_strict, cell)["value"] == expected


@pytest.mark.parametrize(
    ("subject", "expected"),
    [("Project, AB/CD/00071: Re: Valve", "valve"), ("FW: [EXT] P, A/B/00001: Q, C/D/00002: fw: x", "x"), ("Plain", "plain"), (None, None)],
)
def test_clean_subject(spark, subject, expected) -> None:
    assert value(spark, text.clean_subject, subject) == expected


def test_uuid_is_version_five(spark) -> None:
    assert value(spark, text.uuid5, "1HTX14BR100") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "1HTX14BR100"))


@pytest.mark.parametrize(("m2", "cans"), [(0.0, 0), (1.0, 1), (74.9, 1), (75.0, 2), (100.0, 1), (175.0, 3)])
def test_paint_cans(spark, m2, cans) -> None:
    assert value(spark, text.paint_cans, m2, "double") == cans


@pytest.mark.parametrize(("cell", "expected"), [("01.02.24*", dt.date(2024, 2, 1)), ("31/12/1999 A", dt.date(1999, 12, 31)), ("30.02.2024", None), ("1.1.51", dt.date(1951, 1, 1)), (None, None)])
def test_parse_date_swiss(spark, cell, expected) -> None:
    assert value(spark, dates.parse_date_swiss, cell) == expected


@pytest.mark.parametrize(("row", "col", "expected"), [(1, 1, "A1"), (3, 26, "Z3"), (2, 27, "AA2"), (9, 702, "ZZ9"), (1, 703, "AAA1")])
def test_coordinate(spark, row, col, expected) -> None:
    assert spark.createDataFrame([(row, col)], "r long, c long").select(text.coordinate(F.col("r"), F.col("c"))).first()[0] == expected
