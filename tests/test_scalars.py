"""Parsing, labels and tail probabilities."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.functions import scalars as S
from gaugework.functions import tails


def evaluate(spark, texts, expression):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("s"))).collect()]


def test_text_to_number(spark):
    cases = {
        "5": 5.0, " 5 ": 5.0, "-1.5E-3": -0.0015, ".5": 0.5, "5.": 5.0, "1e5": 1e5, "+7": 7.0,
        "inf": math.inf, "-Infinity": -math.inf,
        "1d": None, "1f": None, "1_000": None, "1,000": None, "nan": None, "": None, "abc": None, "1e400": None,
    }
    assert evaluate(spark, list(cases), S.text_to_number) == list(cases.values())


def test_text_to_timestamp(spark):
    cases = {
        "2020-01-02": datetime(2020, 1, 2),
        "2020-1-2 10:30": datetime(2020, 1, 2, 10, 30),
        "2020/3/4": datetime(2020, 3, 4),
        "2020-01-02T10:00:00+02:00": datetime(2020, 1, 2, 8),
        "2020-01-02T10:00:00Z": datetime(2020, 1, 2, 10),
        "12/31/2020": datetime(2020, 12, 31),
        "31/12/2020": datetime(2020, 12, 31),
        "02/03/2020 14:05:06": datetime(2020, 2, 3, 14, 5, 6),
        "15-Jan-2020": datetime(2020, 1, 15),
        "Jan 15 2020": datetime(2020, 1, 15),
        "January 15, 2020": datetime(2020, 1, 15),
        "15 March 2020": datetime(2020, 3, 15),
        "3.4.2020": datetime(2020, 3, 4),
        "2020": None, "12:30": None, "T10": None, "2020-13-01": None, "32/13/2020": None, "15-Foo-2020": None,
        "hello 2020 world": None, "item 2020-01-01": None, "": None,
    }
    assert evaluate(spark, list(cases), S.text_to_timestamp) == list(cases.values())


def test_zone_and_iso_text(spark):
    texts = ["2020-01-15", "2020-01-15T10:00:00Z", "2020-01-15 10:00+02:00", "2020-1-15", "01/02/2020"]
    assert evaluate(spark, texts, S.has_zone) == [False, True, True, False, False]
    assert evaluate(spark, texts, S.is_iso_text) == [True, True, True, False, False]


def test_text_to_boolean(spark):
    texts = ["yes", " Y ", "TRUE", "1", "No", "n", "false", "0", "maybe", None]
    assert evaluate(spark, texts, S.text_to_boolean) == [True] * 4 + [False] * 4 + [None, None]


@pytest.mark.parametrize(
    ("value", "label"),
    [(0.1, "symmetric"), (-0.3, "symmetric"), (0.7, "moderately right-skewed"), (-0.5, "moderately left-skewed"),
     (1.0, "highly right-skewed"), (1.5, "highly right-skewed"), (-1.2, "highly left-skewed"), (None, None)],
)
def test_skew_label(spark, value, label):
    assert spark.range(1).select(S.skew_label(F.lit(value).cast("double"))).first()[0] == label


@pytest.mark.parametrize(
    ("value", "label"), [(2.0, "leptokurtic"), (-2.0, "platykurtic"), (0.5, "mesokurtic"), (None, None)]
)
def test_kurtosis_label(spark, value, label):
    assert spark.range(1).select(S.kurtosis_label(F.lit(value).cast("double"))).first()[0] == label


def test_omnibus_matches_its_definition(spark):
    """The moment test against a direct evaluation in Python."""
    rng = np.random.default_rng(3)
    x = rng.gamma(4.0, size=6000)
    m = x - x.mean()
    g1, g2 = (m**3).mean() / (m**2).mean() ** 1.5, (m**4).mean() / (m**2).mean() ** 2 - 3
    args = [F.lit(6000), F.lit(float(g1)), F.lit(float(g2))]
    assert spark.range(1).select(S.omnibus_p(*args)).first()[0] < 1e-6
    normal = spark.range(1).select(S.omnibus_p(F.lit(6000), F.lit(0.01), F.lit(0.02))).first()[0]
    assert 0.5 < normal < 1.0


def test_tail_probabilities():
    assert tails.beta_tail(5, 0.5, 10 / 14) == pytest.approx(0.073388, abs=1e-6)
    assert tails.gamma_tail(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.gamma_tail(2.5, 11.0705 / 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.correlation_p(1.0, 50) == 0.0
    assert tails.correlation_p(0.0, 50) == pytest.approx(1.0)
    # the normal limit joins the exact tail smoothly
    assert tails.correlation_p(1e-3, 9e6) == pytest.approx(tails.correlation_p(1e-3, 1.2e7), abs=3e-3)
