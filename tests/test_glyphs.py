import numpy as np
from pyspark.sql import functions as F

from plyframe.operators import images as im
from plyframe.operators import glyphs


def _image(a):
    return (a.shape[0], a.shape[1], bytearray(np.ascontiguousarray(a, dtype=np.uint8).tobytes()))


def _pool(spark, sources=("ardis", "emnist")):
    bar = np.zeros((30, 12), np.uint8)
    bar[:, 4:8] = 255
    rows = [(f"/{s}/{c}/{i}.png", s, c, _image(bar)) for s in sources for c in "0123456789" for i in range(3)]
    return spark.createDataFrame(rows + [("/skip", "ardis", "5", None)], f"path string, source string, char string, mask {im.IMAGE}")


def test_shares_of_sources(spark):
    many = spark.range(4000).select("id", F.lit("move").alias("kind"), F.lit("1x").alias("class")).withColumnRenamed("id", "cell_id")
    got = {(r["char"], r["source"]): r["count"] for r in glyphs.chosen_glyphs(many, _pool(spark)).groupBy("char", "source").count().collect()}
    assert abs(got["1", "ardis"] / 4000 - 0.55) < 0.04 and got["1", "ardis"] + got["1", "emnist"] == 4000
    assert got["x", None] == 4000


def test_pool_from_photos(spark):
    page = np.full((30, 20), 220, np.uint8)
    page[5:25, 8:12] = 30
    rows = [("/raw/7/a_b.png", _image(page)), ("/raw/7/blank.png", _image(np.full((30, 20), 220))), ("/raw/q/z.png", _image(page)), ("/raw/x_3.png", None)]
    pool = glyphs.glyph_pool(spark.createDataFrame(rows, f"path string, image {im.IMAGE}"), "ardis").cache()
    got = pool.filter("path = '/raw/7/a_b.png'").first()
    assert got["char"] == "7" and (got["mask"]["height"], got["mask"]["width"]) == (20, 4) and set(got["mask"]["pixels"]) == {255}
    assert {r["char"]: r["glyphs"] for r in glyphs.pool_counts(pool).collect()} == {"7": 1, None: 3}


def test_fitted(spark):
    cell = np.full((40, 60), 250, np.uint8)
    cell[3:13, 2:12] = 0
    got = spark.createDataFrame([(_image(cell),)], f"image {im.IMAGE}").select(glyphs.fitted(F.col("image"), 50, 100).alias("i")).first()["i"]
    out = np.frombuffer(bytes(got["pixels"]), np.uint8).reshape(50, 100)
    ys, xs = np.nonzero(out < 128)
    assert (ys.min(), ys.max(), xs.min(), xs.max()) == (5, 44, 30, 69)
