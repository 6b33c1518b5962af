"""Identifier rules N1-N6 evaluated as Spark column expressions; the vectors are
made from the rules: allowed characters, length limits, doubled quotes, dots
inside quotes."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import identifiers as ident

LONG = "k" * 255
UNQUOTED_TRUE = ["z", "_", "q9", "Net_Sales$2024", LONG]
UNQUOTED_FALSE = ["", "7days", "$net", "net-sales", "net sales", "naïve", 'ne"t', LONG + "k"]
QUOTED_TRUE = ['"7 days"', '"net-sales"', '"x.y.z"', '"größe"', '"say ""hi"" twice"', '"' + "k" * 253 + '"',
               '"' + "k" * 251 + '""' + '"']
QUOTED_FALSE = ['""', '"open', 'open"', '"one " inside"', '"' + "k" * 254 + '"', "bare"]
SPLIT_OK = [("Sales.Orders_1", ("Sales", "Orders_1")),
            ('"a ""b"" c"."7"', ('"a ""b"" c"', '"7"')),
            ('"eu.west"."raw.in"', ('"eu.west"', '"raw.in"')),
            ('"eu.west".stage', ('"eu.west"', "STAGE")),
            ('stage."raw.in"', ("STAGE", '"raw.in"'))]
SPLIT_BAD = ["Orders", "a.b.c", "7a.b", '"a.b', "a.", "sales.net-2"]


def _eval(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "name string")
    return [r[0] for r in df.select(fn(F.col("name"))).collect()]


def test_unquoted(spark):
    assert _eval(spark, UNQUOTED_TRUE, ident.is_unquoted_name) == [True] * len(UNQUOTED_TRUE)
    assert _eval(spark, UNQUOTED_FALSE, ident.is_unquoted_name) == [False] * len(UNQUOTED_FALSE)


def test_quoted(spark):
    assert _eval(spark, QUOTED_TRUE, ident.is_quoted_name) == [True] * len(QUOTED_TRUE)
    assert _eval(spark, QUOTED_FALSE, ident.is_quoted_name) == [False] * len(QUOTED_FALSE)


def test_split_db_sc(spark):
    got = _eval(spark, [v for v, _ in SPLIT_OK], ident.split_db_sc)
    assert [(r["db"], r["sc"]) for r in got] == [e for _, e in SPLIT_OK]
    assert _eval(spark, SPLIT_BAD, ident.split_db_sc) == [None] * len(SPLIT_BAD)


def test_split_three_parts(spark):
    got = _eval(spark, ["Eu.Raw.Clicks", "Eu.Raw", 'Eu."7".clicks', "p.q.r.s", "9p.q.r"], ident.split_db_sc_obj)
    assert got[0]["obj"] == "Clicks" and got[2]["sc"] == '"7"'
    assert got[1] is None and got[3] is None and got[4] is None


@pytest.mark.parametrize("text,name,err", [("42_net", "_net", None), ("Net$9", "Net$9", None),
                                            ("k 12", "k", None), ("net sales", None, "match length incorrect"),
                                            ("12-34", None, "no match")])
def test_parse_name_unanchored(spark, text, name, err):
    r = _eval(spark, [text], ident.parse_name)[0]
    assert (r["name"], r["error"]) == (name, err)


def test_trailing_newline_is_not_a_name(spark):
    assert _eval(spark, ["clicks\n"], ident.is_unquoted_name) == [False]
