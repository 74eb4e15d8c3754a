import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing as P
from tidemark.operators import groups as R
from tidemark.sources import settings as S


def one(spark, column):
    got = spark.range(1).select(column.alias("x")).head()["x"]
    return got.asDict() if hasattr(got, "asDict") else got


def test_crop_files(spark):
    name = lambda n, label=None: one(spark, P.crop_file(F.lit(n), None if label is None else F.lit(label)))
    assert name("GX_01_120_Gadus_morhua_30x40+-5+6.jpg", "Gadus morhua") == {"video": "GX_01", "frame": 120, "w": 30, "h": 40, "x": -5, "y": 6}
    assert name("V_7_30x40+5+6.JPEG")["frame"] == 7
    assert name("V_7_30x40+5+6.png") is None and name("V_7.jpg") is None and name("._x.jpg") is None
    assert one(spark, P.variant(F.lit("Chaetodon_trifascialis_juv"), ["x", "juv"])) == {"name": "Chaetodon trifascialis", "variant": "juv"}
    assert one(spark, P.variant(F.lit("Chaetodon_trifascialis"), ["juv"])) == {"name": "Chaetodon trifascialis", "variant": None}


def test_frame_crops(spark):
    got = one(spark, P.frame_crop(F.lit("A000123_l.AVI.55.10.-20.30.40.png-7-7.png")))
    assert got == {"video": "A000123", "camera": "L", "ext": "avi", "frame": 55, "x0": 10, "y0": -20, "w": 20, "h": 60, "survey": "A"}
    assert one(spark, P.frame_crop(F.lit("A1_X.avi.1.1.1.1.1.png"))) is None


def test_lists_and_sizes(spark):
    assert one(spark, P.index_list(F.lit("# 5 notes\n3,17, 25-22\n101 3"))) == [3, 17, 22, 23, 24, 25, 101]
    assert one(spark, P.index_list(F.lit(None).cast("string"))) == [] and one(spark, P.index_list(F.lit("3,x"))) is None
    assert one(spark, P.tile_size(F.lit("30x40"))) == {"w": 30, "h": 40} and one(spark, P.tile_size(F.lit("1,-2,30,40")))["h"] == 40 and one(spark, P.tile_size(F.lit("30x"))) is None
    assert one(spark, P.counts_spec(F.lit("a=3, b = 4"))) == {"a": 3, "b": 4}
    assert one(spark, P.array_names(F.lit("cls+patch_mean"), F.lit(3))) == ["cls@3", "patch_mean@3"]
    assert one(spark, P.opcode_groups(F.lit("MET01_03_BRUV_3"))) == {"site": "MET01", "deployment": "MET01_03"} and one(spark, P.opcode_groups(F.lit("MET01"))) is None


@pytest.mark.parametrize(
    "institution, path, token, rule",
    [
        ("NOAA NMFS SEFSC", "/a/761901008_cam1_4/f.jpg", "SEFSC:ID:761901008", "sefsc_id"),
        ("NOAA NMFS SEFSC", "/a/BSC2-camera3_05-07-19_x/f.jpg", "SEFSC:RIG:BSC2:20190507", "sefsc_rig_day"),
        ("NOAA NMFS SEFSC", "/a/2021_NCO-002b/f.jpg", "SEFSC:NC:2021_NCO-002", "sefsc_nc"),
        ("MBARI", "/static/m3/framegrabs/Doc Ricketts/images/0339/f.png", "MBARI:DocRicketts:D339", "mbari_dive"),
        ("MBARI", "/static/m3/framegrabs/i2MAP/images/20190507/f.png", "MBARI:i2MAP:DATE:20190507", "mbari_dated_folder"),
        ("MBARI", "/static/m3/framegrabs/Ventana/images/46/f.png", "MBARI:Ventana:F46", "mbari_unpadded"),
        ("MBARI", "/static/m3/framegrabs/MiniROV/images/Mini ROV 152/f.png", "MBARI:MiniROV:D152", "mbari_dive"),
        ("MBARI", "/x/MBARI_D1032_a/f.png", "MBARI:DocRicketts:D1032", "mbari_dive_rehosted"),
        ("MBARI", "/x/MBARI_V0032/f.png", "MBARI:Ventana:D32", "mbari_dive_rehosted"),
        ("MBARI", "/x/a_BIL_Kona_20240501_b/f.png", "MBARI:BIL:20240501", "mbari_bil_day"),
        ("MBARI", "/x/BIL_Kona2024_b/f.png", "MBARI:BIL:Y2024", "mbari_bil_year"),
        ("OET", "/x/OET_NA138/f.jpg", "OET:NA138", "oet_cruise"),
        ("SOI", "/x/dive_S0451_a/f.jpg", "SOI:S451", "soi_dive"),
        ("ONC", "/x/IMG_H1234/f.jpg", "ONC:H1234", "onc_dive"),
    ],
)
def test_address_groups(spark, institution, path, token, rule):
    got = one(spark, P.address_group(F.lit(institution), F.lit(path)))
    assert (got["token"], got["rule"]) == (token, rule)


def test_no_address_and_dives(spark):
    assert one(spark, P.address_group(F.lit("SOI"), F.lit("/x/S45/f.jpg"))) is None and one(spark, P.address_group(F.lit("other"), F.lit("/x/OET_NA138"))) is None
    assert one(spark, P.dive_tokens(F.lit("/EX1404L2_DIVE04_05/D2-EX1404-07.jpg"))) == ["NOAA:EX1404:D7", "NOAA:EX1404L2:D4", "NOAA:EX1404L2:D5"]
    assert one(spark, P.stills_day(F.lit("/static/m3/framegrabs/Doc Ricketts/stills/2019/032/f.png"))) == "MBARI:DocRicketts:DATE:20190201" and one(spark, P.stills_day(F.lit("/x"))) is None
    assert one(spark, P.suspect_concept(F.lit("crab"), F.lit("Genus"))) and not one(spark, P.suspect_concept(F.lit("Crab"), F.lit("Genus")))


def test_backgrounds_are_clear_and_rerun_alike(spark):
    frames = spark.createDataFrame([(i, 400, 300) for i in range(30)] + [(99, 10, 10)], "frame long, width int, height int")
    boxes = spark.createDataFrame([(i, 100, 50, 120, 120) for i in range(20)], "frame long, x int, y int, w int, h int")
    got = R.place_backgrounds(frames, boxes, "frame", [(60, 60), (100, 80)], 5, 60, "s").collect()
    assert {r["frame"] for r in got} == set(range(30))
    for r in got:
        assert 0 <= r["x"] <= 400 - r["w"] and 0 <= r["y"] <= 300 - r["h"]
        if r["frame"] < 20:
            assert r["x"] >= 225 or r["x"] + r["w"] <= 95 or r["y"] >= 175 or r["y"] + r["h"] <= 45
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.place_backgrounds(frames.repartition(5), boxes, "frame", [(60, 60), (100, 80)], 5, 60, "s").collect()))


def test_settings_and_manifests(tmp_path):
    file = tmp_path / "a.json"
    file.write_text('{"a": 1, "b": {"c": 1}}')
    assert S.strict_settings(str(file), ["a"])["b"] == {"c": 1}
    with pytest.raises(ValueError, match="lack"):
        S.strict_settings(str(file), ["z"])
    file.write_text('{"a": 1, "b": {"c": 1, "c": 2}}')
    with pytest.raises(ValueError, match="twice"):
        S.strict_settings(str(file), [])
    S.same_run(str(tmp_path / "run.json"), {"seed": 1})
    S.same_run(str(tmp_path / "run.json"), {"seed": 1})
    with pytest.raises(ValueError, match="seed"):
        S.same_run(str(tmp_path / "run.json"), {"seed": 2})


def test_html_and_vectors(spark, tmp_path):
    (tmp_path / "t.html").write_text("<table><tr><th>a<th>b</th></tr><tr><td> 1 <b>x</b></td><td></td></tr></table>".replace("a<th>", "a</th><th>"))
    assert [tuple(r) for r in S.read_html_table(spark, str(tmp_path / "t.html"), ["a"]).collect()] == [("1 x", "")]
    with pytest.raises(ValueError):
        S.read_html_table(spark, str(tmp_path / "t.html"), ["z"])
    folder = tmp_path / "store" / "t1"
    folder.mkdir(parents=True)
    np.save(folder / "cls@3.npy", np.arange(6).reshape(3, 2).astype(np.float16))
    (folder / "keys.txt").write_text("k1\nk2\nk3\n")
    with pytest.raises(Exception, match="not finished"):
        S.read_vectors(spark, str(tmp_path / "store")).collect()
    (folder / "done.json").write_text(json.dumps({}))
    got = {r["key"]: (r["token"], r["layer"], list(r["vec"])) for r in S.read_vectors(spark, str(tmp_path / "store")).collect()}
    assert got["k2"] == ("cls", "3", [2.0, 3.0]) and len(got) == 3


@pytest.mark.parametrize(
    "institution, path, tokens, rule, link, dive",
    [
        ("MBARI", "/static/m3/framegrabs/Doc Ricketts/images/0339/20130502T171717.png", ["MBARI:DocRicketts:D339"], "mbari_dive", None, ("MBARI:DocRicketts", "20130502")),
        ("MBARI", "/static/m3/framegrabs/Doc Ricketts/images/0339/f.png", ["MBARI:DocRicketts:D339"], "mbari_dive", None, None),
        ("MBARI", "/static/m3/framegrabs/i2MAP/images/20190304/f.png", ["MBARI:i2MAP:DATE:20190304"], "mbari_dated_folder", ("MBARI:i2MAP", "20190304"), None),
        ("MBARI", "/static/m3/framegrabs/Ventana/images/46/x_20190101T0102.png", ["MBARI:Ventana:F46"], "mbari_unpadded", ("MBARI:Ventana", "20190101"), None),
        ("MBARI", "/static/m3/framegrabs/Ventana/stills/2019/032/f.png", ["MBARI:Ventana:DATE:20190201"], "mbari_stills_day", ("MBARI:Ventana", "20190201"), None),
        ("NOAA Ocean Exploration", "/v/EX1404_DIVE04_05/EX1404_VID_20140920_1.png", ["NOAA:EX1404:D4", "NOAA:EX1404:D5"], "noaa_dive_multi", None, ("NOAA:EX1404", "20140920")),
        ("NOAA Ocean Exploration", "/v/EX1404_DIVE04/EX1405_DIVE1/EX1404_VID_20140920_1.png", ["NOAA:EX1404:D4", "NOAA:EX1405:D1"], "noaa_dive_multi", None, None),
        ("NOAA Ocean Exploration", "/v/EX1404L2_VID_20140920T1.png", ["NOAA:EX1404L2:DATE:20140920"], "noaa_cruise_day", ("NOAA:EX1404L2", "20140920"), None),
        ("Ocean Networks Canada", "/a/b_H1234/f.png", ["ONC:H1234"], "onc_dive", None, None),
        ("Schmidt Ocean Institute", "/S0123_x/f.png", ["SOI:S123"], "soi_dive", None, None),
        ("CENCOOS", "/whatever.png", ["INST:CENCOOS"], "institution_only", None, None),
    ],
)
def test_address_parts(spark, institution, path, tokens, rule, link, dive):
    got = one(spark, P.address_parts(F.lit(institution), F.lit(path)))
    pair = lambda x: None if x is None else (x["space"], x["day"])
    assert (got["tokens"], got["rule"], pair(got["link"]), pair(got["dive"])) == (tokens, rule, link, dive)


def test_addresses_without_a_group(spark):
    assert one(spark, P.address_parts(F.lit("NOAA Ocean Exploration"), F.lit("/x/f.png"))) is None and one(spark, P.address_parts(F.lit(None).cast("string"), F.lit("/x"))) is None and one(spark, P.address_parts(F.lit("OET"), F.lit(None).cast("string"))) is None
