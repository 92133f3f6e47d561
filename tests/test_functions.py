from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from glasspool.functions import arrays, classify, labels, money


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("{a,b}", ["a", "b"]),
        ("[a, b]", ["a", "b"]),
        ("Set(a, b)", ["a", "b"]),
        ("{a}", ["a"]),
        ("{}", []),
        ("[]", []),
        ("Set()", []),
        ("", []),
    ],
)
def test_array_text(spark, text, expected):
    assert one(spark, arrays.parse_array_text(F.lit(text))) == expected


def texts(*values):
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def test_first_and_flat_addresses(spark):
    null = F.lit(None).cast("array<string>")
    assert one(spark, arrays.first_address(texts("b", "a"))) == "b"
    assert one(spark, arrays.first_address(texts())) is None
    assert one(spark, arrays.first_address_or_blank(texts())) == ""
    assert one(spark, arrays.first_address_or_blank(null)) is None
    assert one(spark, arrays.singleton_or_blank(texts("a"))) == "a"
    assert one(spark, arrays.singleton_or_blank(texts("a", "b"))) == ""
    assert one(spark, arrays.singleton_or_blank(texts())) == ""
    assert one(spark, arrays.singleton_or_blank(null)) is None
    assert one(spark, arrays.address_key(texts("b", "a"))) == "a,b"
    assert one(spark, arrays.address_key(texts())) == ""
    assert one(spark, arrays.address_key(null)) is None


@pytest.mark.parametrize(
    ("vin", "vout", "joinsplits", "coinbases", "expected"),
    [
        (1, 2, 0, 1, "minerReward"),
        (2, 2, 0, 1, "public"),
        (1, 1, 0, 0, "public"),
        (1, 0, 1, 0, "shielded"),
        (1, 1, 1, 0, "mixed"),
        (0, 1, 1, 0, "deshielded"),
        (0, 0, 2, 0, "private"),
        (0, 0, 0, 0, "UNKNOWN"),
        (0, 3, 0, 0, "UNKNOWN"),
        (1, 0, 0, 0, "UNKNOWN"),
    ],
)
def test_transaction_types(spark, vin, vout, joinsplits, coinbases, expected):
    column = classify.transaction_type(*(F.lit(n) for n in (vin, vout, joinsplits, coinbases)))
    assert one(spark, column) == expected


def test_output_flags_and_raw_destinations(spark):
    assert one(spark, classify.from_joinsplit(F.lit(0), F.lit(1))) is True
    assert one(spark, classify.from_joinsplit(F.lit(1), F.lit(1))) is False
    known = texts("a")

    def destination(vin, vout, new):
        return one(spark, classify.raw_destination(F.lit(vin), F.lit(vout), F.lit(new), known))

    assert destination(0, 1, 5) == ["a"]
    assert destination(1, 1, 5) == []
    assert destination(0, 0, 5) == []
    assert destination(0, 1, 0) == []


def test_row_labels(spark):
    a, b, null = texts("a"), texts("b"), F.lit(None).cast("array<string>")
    assert one(spark, labels.row_label(F.lit("o"), F.lit("i"))) == "o"
    assert one(spark, labels.row_label(F.lit(""), F.lit("i"))) == "i"
    assert one(spark, labels.row_label(F.lit(None).cast("string"), F.lit("i"))) == "i"
    assert one(spark, labels.stitched_address(a, a)) == "a"
    assert one(spark, labels.stitched_address(a, b)) is None
    assert one(spark, labels.stitched_address(a, null)) == "a"
    assert one(spark, labels.stitched_address(null, b)) == "b"
    assert one(spark, labels.stitched_address(null, texts())) == ""


def test_money_is_exact(spark):
    assert one(spark, money.to_money(F.lit("0.123456785"))) == Decimal("0.12345679")
    assert one(spark, money.to_money(F.lit(0.1) + F.lit(0.2))) == Decimal("0.30000000")
    tiny = F.lit("0.00000001").cast("decimal(38,8)")
    big = F.lit("123456789012345.00000001").cast("decimal(38,8)")
    assert one(spark, money.difference(big, tiny)) == Decimal("123456789012345.00000000")
    assert one(spark, money.count_percent(F.lit(1), F.lit(8))) == Decimal("12.50")
    assert one(spark, money.count_percent(F.lit(1), F.lit(0))) is None
    assert one(spark, money.percent(F.lit(-1), F.lit(3))) == Decimal("-33.33")
