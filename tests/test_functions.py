from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import stats
from tidemark.functions import taxa as X
from tidemark.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("typed, key", [("K-0999917 ", "k999917"), ("KELDA|MiniAuk4|D01", "keldaminiauk4d1"), ("NORVIK:ID:44", "norvikid44"), ("HR_S46_R3", "hrs46r3"), ("1 02", "1_2"), ("", None), (None, None)])
def test_place_key(spark, typed, key):
    assert one(spark, T.place_key(F.lit(typed).cast("string"))) == key


@pytest.mark.parametrize("typed, name", [(" YOLO_bruv", "yolo-bruv"), ("FathomNet", "fathomnet"), ("oz-fish", "ozfish"), ("", None), (None, None)])
def test_source_name(spark, typed, name):
    assert one(spark, T.source_name(F.lit(typed).cast("string"))) == name


@pytest.mark.parametrize("url, name", [(" HTTPS://Cdn.Example/a/Mini%20Auk%204/x%5f1.png ", "cdn.example/a/Mini Auk 4/x_1.png"), ("http://h/a+b", "h/a+b"), ("http://h/50%zz", "h/50%zz"), ("h", "h")])
def test_url_name(spark, url, name):
    assert one(spark, T.url_name(F.lit(url))) == name


def test_norm_and_crop_name(spark):
    assert [one(spark, T.norm(F.lit(x).cast("string"))) for x in (None, " nan ", "NULL", " x ")] == ["", "", "", "x"]
    assert one(spark, T.crop_name(F.lit(" FW_12-a3.JPG"))) == "fw-12-a3"


def test_target_size(spark):
    def size(w, h):
        return tuple(one(spark, c) for c in G.target_size(F.lit(w), F.lit(h), 1024, 64))

    assert size(2048, 1024) == (1024, 512)
    assert size(1000, 500) == (None, None)
    assert size(4000, 100) == (2560, 64)
    assert size(4000, 64) == (None, None)


def test_square_tiers(spark):
    def square(x, y, w, h, m=0.1):
        return one(spark, G.square_for(*(F.lit(v) for v in (x, y, w, h, 1920, 1080)), m))

    assert square(100, 100, 100, 50)["tier"] == "fits" and square(100, 100, 100, 50)["side"] == 110
    assert square(0, 0, 1050, 900)["tier"] == "margin_reduced" and square(0, 0, 1050, 900)["side"] == 1080
    padded = square(0, 0, 1500, 900)
    assert padded["tier"] == "padded" and padded["pad_fraction"] == pytest.approx(1 - 1500 * 1080 / 1500**2, abs=0.03)
    assert square(0, 0, 50, 50)["shifted"]


def test_boxes(spark):
    box = lambda *v: [F.lit(x) for x in v]
    assert one(spark, G.iou(box(0, 0, 10, 10), box(5, 0, 10, 10))) == pytest.approx(1 / 3)
    assert one(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert not one(spark, G.touches(box(0, 0, 10, 10), box(10, 0, 5, 5))) and one(spark, G.touches(box(0, 0, 10, 10), box(10, 0, 5, 5), 1))
    assert one(spark, G.clip_box(*box(-5, -5, 6, 20), F.lit(100), F.lit(100))) is None
    assert one(spark, G.clamp_box(*box(-5.9, 2.0, 10.9, 4.0), F.lit(100), F.lit(100))).asDict() == {"x": 0, "y": 2, "w": 5, "h": 4, "clamped": True}


def test_haversine(spark):
    a, b, c, d = 10.0, 20.0, -33.5, 151.2
    h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
    assert one(spark, G.haversine_km(*(F.lit(x) for x in (a, b, c, d)))) == pytest.approx(2 * 6371 * asin(sqrt(h)))
    assert not one(spark, G.valid_position(F.lit(0.0), F.lit(0.0))) and not one(spark, G.valid_position(F.lit(None).cast("double"), F.lit(1.0)))


def test_patch_grid_stays_in_budget(spark):
    for w, h in ((640, 480), (33, 1000), (1, 1)):
        p = one(spark, G.patch_grid(F.lit(w), F.lit(h), 16, 256))
        assert p["w"] % 16 == p["h"] % 16 == 0 and p["w"] * p["h"] <= 256 * 256


def test_taxa(spark):
    lin = F.create_map(F.lit("Genus"), F.lit("Gadus"), F.lit("FAMILY"), F.lit("Gadidae"), F.lit("order"), F.lit(""))
    assert one(spark, X.taxa_of(F.lit("Gadus morhua"), F.lit("Species"), lin)) == {"species": "Gadus morhua", "genus": "Gadus", "family": "Gadidae"}
    assert one(spark, X.taxa_of(F.lit("Gadidae"), F.lit("Family"), lin)) == {"family": "Gadidae"}
    assert one(spark, X.rank_intent(F.lit("F"), F.lit("G"), F.lit("sp"))) == "Genus"
    assert one(spark, X.hemisphere(F.lit("S12.91"))) == -12.91 and one(spark, X.hemisphere(F.lit("x"))) is None
    assert one(spark, X.taxon_bucket(F.lit("Animalia"), F.lit("Chordata"), F.lit(None).cast("string"))) == "unknown"


def test_percentile_definitions(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 12)] + [("b", 5.0)] * 3 + [("b", None)], "k string, v double")
    got = {r["k"]: r for r in stats.percentile_table(df, ["k"], "v", 0.9).collect()}
    a = got["a"]
    assert (a["n"], a["linear"], a["nearest"], a["scaled"], a["lower"], a["tenth"]) == (11, 10, 10, 10, 10, 10)
    assert got["b"]["n"] == 3 and got["b"]["linear"] == 5
    assert stats.percentile_table(df.filter("false"), ["k"], "v", 0.9).count() == 0


def test_auc_ties_and_t_quantile(spark):
    df = spark.createDataFrame([(1.0, False), (2.0, False), (2.0, True), (3.0, True)], "v double, p boolean")
    assert stats.auc(df, "v", "p").head()["auc"] == 0.875
    assert stats.auc(df.filter("p"), "v", "p").head()["auc"] is None
    assert stats.t_quantile(spark, 0.975, 9) == pytest.approx(2.262157162798239)
