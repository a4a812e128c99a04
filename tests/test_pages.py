import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe.operators import images as im
from plyframe.operators import pages
from plyframe.sources import files

HEIGHT, WIDTH, CELL = 1500, 1300, 30


def _sheet(tables=8):
    """A white page with tables of 11 lines of cells and three columns."""
    page = np.full((HEIGHT, WIDTH), 230, np.uint8)
    for t in range(tables):
        x0, y0 = 80 + 300 * (t % 4), 60 + 700 * (t // 4)
        x1, y1 = x0 + 240, y0 + 11 * CELL
        for r in range(12):
            page[y0 + r * CELL : y0 + r * CELL + 2, x0 : x1 + 2] = 20
        for x in (x0, x0 + 48, x0 + 144, x1):
            page[y0 : y1 + 2, x : x + 2] = 20
    return page


def _df(spark, arrays):
    rows = [(i, None if a is None else (a.shape[0], a.shape[1], bytearray(a.tobytes()))) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, f"id int, image {im.IMAGE}")


@pytest.fixture(scope="module")
def laid_out(spark):
    skewed = pages._rotated(_sheet(), -2.0)
    frame = pages.with_layout(_df(spark, [_sheet(), skewed, _sheet(5), None])).cache()
    yield frame
    frame.unpersist()


def test_errors_are_rows_and_the_batch_goes_on(laid_out):
    rows = laid_out.orderBy("id").select("id", "error", F.size("boxes").alias("n"), "coarse").collect()
    assert [r["error"] for r in rows] == [None, None, "found 5 tables, need 8", "unreadable image"]
    assert [r["n"] for r in rows[:2]] == [320, 320] and rows[0]["coarse"]


def test_cells_lie_in_the_printed_grid(laid_out):
    found = pages.cells(laid_out).filter("id < 2").select("id", "kind", "move_no", "side", "pit_index", "bbox").collect()
    assert len(found) == 640
    for r in found:
        if r["kind"] != "move":
            continue
        table, row = (r["move_no"] - 1) // 10, (r["move_no"] - 1) % 10
        x = 80 + 300 * (table % 4) + (48 if r["side"] == "W" else 144)
        y = 60 + 700 * (table // 4) + (row + 1) * CELL
        off = 3 if r["id"] == 0 else 6
        assert abs(r["bbox"]["x"] - x) <= off and abs(r["bbox"]["y"] - y) <= off and abs(r["bbox"]["h"] - CELL) <= 2
    keys = {(r["kind"], r["move_no"], r["side"], r["pit_index"]) for r in found if r["id"] == 0}
    assert len(keys) == 320 and ("pit", 80, "W", 9) in keys and ("kazan", 10, "B", 0) in keys


def test_diagram_boxes_follow_the_form(laid_out):
    boxes = {(b["kind"], b["side"], b["pit_index"]): b for b in laid_out.filter("id = 0").first()["boxes"] if b["kind"] != "move" and b["move_no"] == 10}
    pit = 1.05 * 242 / 9
    assert abs(boxes["pit", "B", 9]["x"] - (80 - 0.1 * 242)) <= 3
    assert abs(boxes["pit", "W", 1]["x"] - boxes["pit", "B", 9]["x"]) <= 1
    assert abs(boxes["kazan", "B", 0]["x"] - (80 - 0.1 * 242 + 4 * pit)) <= 4 and abs(boxes["kazan", "B", 0]["w"] - 2 * pit) <= 2
    assert boxes["kazan", "B", 0]["y"] < boxes["pit", "B", 5]["y"] < boxes["pit", "W", 5]["y"] < boxes["kazan", "W", 0]["y"]


def test_quad_falls_back_to_a_rectangle():
    turn = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    quad = pages._quad(np.rint(np.stack([200 + 90 * np.cos(turn), 100 + 40 * np.sin(turn)], 1)).astype(int))
    assert 4 * 90 * 40 * 0.9 < quad["area"] < 4 * 90 * 40 * 1.1
    square = pages._quad(np.array([[0, 0], [10, 0], [10, 20], [0, 20], [5, 0], [10, 7]]))
    assert square["area"] == 200 and [(c["x"], c["y"]) for c in square["corners"]] == [(0, 0), (10, 0), (10, 20), (0, 20)]


def test_components_equal_flood_fill():
    mask = np.random.default_rng(3).random((40, 50)) < 0.35
    seen, sizes = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        todo, members = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            members.append((b, a))
            for c in range(max(0, a - 1), min(40, a + 2)):
                for d in range(max(0, b - 1), min(50, b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        sizes.append((min(members), max(members)))
    got = [tuple((min(map(tuple, p.tolist())), max(map(tuple, p.tolist())))) for p in pages._components(mask)]
    assert sorted(got) == sorted(sizes)


def test_names_preview_and_files(spark, laid_out, tmp_path):
    named = pages.cells(laid_out).filter("id = 0 AND (move_no = 10 AND kind <> 'move' OR move_no = 7)")
    named = named.select(pages.cell_name(*[F.col(c) for c in ("kind", "move_no", "side", "pit_index")]).alias("name"), files.png(F.col("image")).alias("content"))
    files.write_images(named, str(tmp_path / "crops"))
    names = {p.name for p in (tmp_path / "crops").iterdir()}
    assert {"07_W.png", "kazan_10_B.png", "pit_10_W_3.png"} <= names and len(names) == 22
    decoded = spark.read.format("image").load(str(tmp_path / "crops" / "07_W.png")).select("image.height", "image.nChannels").first()
    assert abs(decoded["height"] - CELL) <= 2 and decoded["nChannels"] == 1
    preview = {r["id"]: r for r in pages.split_preview(laid_out).collect()}
    assert (preview[0]["moves"], preview[0]["kazans"], preview[0]["pits"]) == (160, 16, 144)
    assert bytes(preview[0]["overlay"][:4]) == b"\x89PNG" and preview[2]["overlay"] is None and preview[2]["error"]


def test_sources_of_images(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / "set" / name).mkdir(parents=True)
        (tmp_path / "set" / name / "1.png").write_bytes(files.png_bytes(np.arange(12, dtype=np.uint8).reshape(3, 4)))
    rows = files.image_folder(spark, str(tmp_path / "set")).orderBy("idx").collect()
    assert [(r["class"], r["idx"]) for r in rows] == [("a", 0), ("b", 1)]
    assert files.expand(spark, [f"{tmp_path}/set/*", "/no/such*"]) == [f"{tmp_path}/set/a", f"{tmp_path}/set/b", "/no/such*"]
    page = files.sheet_images(spark, str(tmp_path / "set" / "a"), "*.png").first()["image"]
    assert bytes(page["pixels"]) == bytes(range(12)) and page["height"] == 3
    with pytest.raises(FileNotFoundError):
        files.glyph_files(spark, str(tmp_path / "set"))


def test_orientation():
    tiff = b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    body = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda"
    assert files.exif_orientation(jpeg) == 6 and files.exif_orientation(b"\xff\xd8\xff\xda") == 1 and files.exif_orientation(b"") == 1
    a = np.arange(6).reshape(2, 3)
    assert np.array_equal(files.upright(a, 6), np.rot90(a, -1)) and np.array_equal(files.upright(a, 8), np.rot90(a))
    assert np.array_equal(files.upright(a, 3), a[::-1, ::-1]) and np.array_equal(files.upright(a, 5), a.T)
