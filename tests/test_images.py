import numpy as np
from pyspark.sql import functions as F

from plyframe.operators import images as im


def _df(spark, arrays):
    rows = [(i, None if a is None else (a.shape[0], a.shape[1], bytearray(a.astype(np.uint8).tobytes()))) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, f"id int, image {im.IMAGE}")


def _array(row):
    return np.frombuffer(bytes(row["pixels"]), np.uint8).reshape(row["height"], row["width"])


def _page():
    page = np.full((80, 120), 200, np.uint8)
    page[40, 5:115] = 20
    page[20:24, 50:54] = 10
    return page


def test_crop_clamps_and_cuts(spark):
    a = np.arange(20, dtype=np.uint8).reshape(4, 5)
    box = [F.lit(v) for v in (-1.5, 1.9, 3.7, 99.0)]
    rows = _df(spark, [a, None]).select("id", im.crop(F.col("image"), *box).alias("c")).orderBy("id").collect()
    assert (_array(rows[0]["c"]) == a[1:4, 0:3]).all()
    assert rows[1]["c"]["pixels"] is None


def test_views(spark):
    a = np.arange(60, dtype=np.uint8).reshape(6, 10)
    rows = im.with_views(_df(spark, [a])).orderBy("view").collect()
    want = [a[max(0, dy) : 6 + min(0, dy), max(0, dx) : 10 + min(0, dx)] for dx, dy in im.SHIFTS]
    assert len(rows) == 7 and all(np.array_equal(_array(r["image"]), w) for r, w in zip(rows, want))


def test_model_input_of_plain_and_padded_images():
    flat = im.model_input(np.full((10, 10), 255, np.uint8))
    assert flat.shape == (64, 128) and np.allclose(flat, 1)
    exact = np.random.default_rng(1).integers(0, 256, (64, 128)).astype(np.uint8)
    assert np.allclose(im.model_input(exact), (exact / 255 - 0.5) / 0.5, atol=1e-6)
    assert im.model_input(np.zeros((3, 200), np.uint8)).shape == (64, 128)
    assert im.model_input(np.zeros((200, 1), np.uint8)).shape == (64, 128)


def test_logits_in_batches(spark):
    def runner():
        return lambda batch: np.stack([batch.mean(axis=(1, 2, 3)), np.full(len(batch), len(batch))], axis=1)

    arrays = [np.full((8, 16), v, np.uint8) for v in (0, 255)] + [None, np.zeros((8, 16), np.uint8)]
    rows = _df(spark, arrays).coalesce(1).select("id", im.logits(F.col("image"), runner, batch=2).alias("s")).orderBy("id").collect()
    assert [None if r["s"] is None else r["s"][0] for r in rows] == [-1.0, 1.0, None, -1.0]


def test_grid_mask_and_clean(spark):
    row = _df(spark, [_page()]).select(im.grid_mask(F.col("image")).alias("m"), im.clean_cell(F.col("image")).alias("c")).first()
    mask, cleaned = _array(row["m"]), _array(row["c"])
    assert mask[40, 60] == 255 and mask[39, 60] == 255 and mask[42, 60] == 0
    assert (cleaned[38:43] == 200).all() and cleaned[21, 51] == 10
    assert row["c"]["ink_ratio"] == 16 / (80 * 120)


def test_small_and_null_cells(spark):
    rows = _df(spark, [np.zeros((2, 9)), None]).select("id", im.clean_cell(F.col("image")).alias("c")).orderBy("id").collect()
    assert rows[0]["c"]["ink_ratio"] == 0.0 and _array(rows[0]["c"]).shape == (2, 9)
    assert rows[1]["c"]["ink_ratio"] is None


def test_gray(spark):
    data = bytearray(bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255]))
    df = spark.createDataFrame([((2, 2, 3, data),)], "image struct<height:int,width:int,nChannels:int,data:binary>")
    assert _array(df.select(im.gray(F.col("image")).alias("g")).first()["g"]).tolist() == [[29, 150], [76, 255]]
