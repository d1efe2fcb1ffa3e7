"""Scalar functions on the rows that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from attestary.functions import paths as P, text as X, values as V


@pytest.fixture
def column(spark):
    def run(values, fn, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("r")).collect()]
    return run


def test_norm(column):
    got = column(["756.1234", "É—à", "oﬃce ½", "Ωμέγα", "ＡＢ  c", " … ", "", None, "a_b", "n°\xa05"], X.norm)
    assert got == ["756 1234", "e a", "office 1 2", "ωμεγα", "ab c", "", "", None, "a b", "n 5"]


def test_norm_offsets_point_at_their_characters(spark):
    texts = ["  Crème brûlée, n° 5 ½ ﬁn", "œuf–Straße\nÀ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", X.norm_map("t").alias("m"), X.norm(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.m.norm == r.n and len(r.m.norm) == len(r.m.origin)
        for char, at in zip(r.m.norm, r.m.origin):
            assert char == " " or char in X.fold(r.t[at])


def test_date_variants(column):
    got = column(["15.03.2025", "2025-03-15", " 5/3/2025 ", "32.01.2025", "01.13.2025", "mars 2025", None],
                 V.date_variants)
    full = ["15.03.2025", "15.3.2025", "15 mars 2025", "15 mars 2025"]
    assert got == [full, full, ["05.03.2025", "5.3.2025", "5 mars 2025", "05 mars 2025"], [], [], [], []]


def test_conv_date_keeps_year_first_order(column):
    got = column(["5.3.2025", "05/3/2025", "2025-03-15", "5.3/2025", "", None], V.conv_date)
    assert got == ["05.03.2025", "05.03.2025", "2025.03.15", "5.3/2025", "", ""]


def test_numbers(column):
    assert column(["1.0", "1,5", "CHF 12.50", "", "abc", "1.2.3", "1e3"], V.conv_number) == \
        ["1", "1.5", "12.5", "", "abc", "1.2.3", "1000"]
    assert column(["50 %", "12,5%", "2.5", "3.5", "x%"], V.conv_percent) == ["50", "12", "2", "4", "x"]
    assert column(["50 %", "env. 12,5%", "x"], V.norm_percent) == ["50", "12.5", "x"]


def test_sex(column):
    assert column(["M (masculin)", "Féminin", "h", "femme", "x"], V.norm_sex) == ["M", "F", "M", "F", "x"]


def test_oui_in_every_vocabulary(column):
    assert column(["Oui", "On", " X "], V.to_oui_non) == ["oui", "oui", "oui"]
    assert column(["Oui", "vrai", "y"], V.to_on_off) == ["On", "On", "Off"]
    assert column(["Oui", "vrai", "y"], V.to_on_off_xfa) == ["Off", "Off", "On"]
    assert column(["Oui", "vrai", None], lambda c: V.to_widget_state(c, F.lit("1"))) == ["1", "Off", "Off"]


def test_resolve_option(spark):
    rows = spark.createDataFrame(
        [(" oui ", ["Oui", "Non"], ["0", "1"]), ("oui", ["Oui"], ["0", "1"]), ("peut-être", ["Oui"], ["0"]),
         ("STRASSE", ["Straße"], ["7"]), ("oui", None, None)], "v string, o array<string>, e array<string>")
    got = [r[0] for r in rows.select(V.resolve_option(F.col("v"), F.col("o"), F.col("e"))).collect()]
    assert got == ["0", "oui", "peut-être", "7", "oui"]


def test_xfa_text(spark):
    rows = spark.createDataFrame([("On", "bool"), ("true", "bool"), ("007", "int"), ("x", "int"), (None, "str")],
                                 "v string, k string")
    got = [r[0] for r in rows.select(V.xfa_text(F.col("v"), F.col("k"))).collect()]
    assert got == ["0", "1", "7", "x", ""]


def test_file_names(column):
    got = column(["a/../b.pdf", "a/..", "x/.", "", "/", "n\x00.pdf", "C:\\a"],
                 lambda c: P.safe_filename(c, F.lit(3)))
    assert got == ["b.pdf", "..", "x", "upload_3.pdf", "upload_3.pdf", "n.pdf", "C:\\a"]


def test_paths(column):
    assert column([r"a[0].#area[0].b\.c[1]", "#area[2].x"], P.canonical_som) == ["a[0].b.c[1]", ".x"]
    assert column(["phone[1]", "phone", "a[x]"], lambda c: P.split_segment(c)["index"]) == [1, 0, 0]
    assert column(["/a/b/c", "c", "//"], P.path_key) == ["b/c", "c", None]
    assert column([r"C:\medforms\20.providers\10.phy\x", "a/b"], P.taxonomy_code) == ["medforms.20.10", ""]


def test_display(column):
    assert column([None, 59.5, 3600.0, -3.0], V.format_duration, "double") == ["—", "01:00", "1:00:00", "00:00"]
    assert column(["## Page 1\n\n a \xa0 b"], X.flatten_text) == ["Page 1 a b"]
    text = "x" * 200 + " mot " + "y" * 200
    (got,) = column([text], lambda c: X.excerpt(c, F.lit(201), F.lit(204)))
    assert got == "… " + "x" * 139 + " mot " + "y" * 139 + " …"
    (cut,) = column(["avant mot après"], lambda c: X.highlight(c, F.lit("mot")))
    assert (cut.before, cut.match, cut.after) == ("avant ", "mot", " après")
