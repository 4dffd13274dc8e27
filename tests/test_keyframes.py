"""Pictures: cursor tracking, blurred secrets, files of an index, warnings."""

from __future__ import annotations

import json
import math
import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from uistrata import __main__ as cli
from uistrata import tools
from uistrata.functions import pictures, pixels
from uistrata.operators import document, recording, sequence
from uistrata.plans import adapters
from uistrata.sources import documents, seams, sinks

SIDE = 24


def screen(x, y, ground=10, size=2):
    g = np.full((SIDE, SIDE), ground)
    g[y : y + size, x : x + size] = 255
    return g.reshape(-1).tolist()


def cursor_rows(n, rec="a", seed=1):
    rng = random.Random(seed)
    return [(rec, i, i * 0.5, screen(rng.randrange(22), rng.randrange(22))) for i in range(n)]


FRAMES = "rec string, pos bigint, t double, gray array<int>"


@pytest.mark.parametrize("size", [1, 3, 50, 5000])
def test_cursor_across_runs(spark, size):
    """A recording cut into runs gives the positions of one pass; frames without a picture are passed over."""
    rows = cursor_rows(60) + cursor_rows(7, "b", 2)
    rows = [(r, p, t, None if p % 13 == 5 or r == "a" and 20 <= p < 30 else g) for r, p, t, g in rows]
    want = []
    for rec in ("a", "b"):
        prev = None
        for _, _, t, g in (r for r in rows if r[0] == rec and r[3]):
            cur = np.array(g, np.int16).reshape(-1, SIDE)
            if prev is not None and (at := pixels.cursor_between(prev, cur)):
                want.append((rec, t, *at))
            prev = cur
    got = sequence.tracked_cursor(spark.createDataFrame(rows, FRAMES).repartition(3), SIDE, size).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_cursor_of_other_sizes_and_of_nothing(spark):
    rows = [("a", 0, 0.0, screen(1, 1)), ("a", 1, 1.0, screen(9, 9)[: SIDE * 20]), ("a", 2, 2.0, screen(1, 9))]
    assert sequence.tracked_cursor(spark.createDataFrame(rows, FRAMES), SIDE).collect() == []
    assert sequence.tracked_cursor(spark.createDataFrame([], FRAMES), SIDE).collect() == []


def test_index_of_pictures_has_clicks(spark):
    found = adapters.screen_states(spark, "/root/testdata/sf0.001").agg(F.count("interaction").alias("n"), F.count_if(F.col("event.type") == "click").alias("clicks")).first()
    assert found["n"] > 50 and found["clicks"] > 0


def test_interactions_need_something_to_find_them_in(spark):
    frames = spark.createDataFrame([("a", 0, 0.0, 1.0, [])], "rec string, pos bigint, t double, moved double, boxes array<struct<text:string,box:array<int>>>")
    with pytest.raises(ValueError, match="interactions need"):
        recording.build(frames, recording.Options(interactions=True))


def plain_blur(frame, box):
    """One box by loops over all pairs of weights."""
    height, width = frame.shape
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(width, box[0] + box[2]), min(height, box[1] + box[3])
    out = frame.copy()
    if x1 <= x0 or y1 <= y0:
        return out
    size = max(3, min(x1 - x0, y1 - y0) // 2 * 2 + 1)
    kernel, reach = pixels.gaussian_kernel(size), size // 2

    def fold(at, n):
        while n > 1 and not 0 <= at < n:
            at = -at if at < 0 else 2 * n - 2 - at
        return at if n > 1 else 0

    for y in range(y0, y1):
        for x in range(x0, x1):
            v = sum(kernel[i] * kernel[j] * frame[y0 + fold(y - y0 + i - reach, y1 - y0), x0 + fold(x - x0 + j - reach, x1 - x0)] for i in range(size) for j in range(size))
            out[y, x] = math.floor(v + 0.5)
    return out


def test_blur_against_loops(spark):
    rng = np.random.default_rng(3)
    for _ in range(40):
        frame = rng.integers(0, 256, (rng.integers(1, 30), rng.integers(1, 30))).astype(np.int32)
        boxes = [[int(v) for v in rng.integers(-8, 25, 4)] for _ in range(rng.integers(0, 4))]
        want = frame
        for b in boxes:
            want = plain_blur(want, b)
        got = pixels.blur_boxes(frame, boxes)
        assert np.abs(got - want).max(initial=0) <= (1 if boxes else 0)  # sums in another order round another way at a half
        covered = np.zeros(frame.shape, bool)
        for x, y, w, h in boxes:
            covered[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = True
        assert (got == frame)[~covered].all()
    big = rng.integers(0, 256, (200, 300)).astype(np.int32)
    blurry = pixels.blur_boxes(big, [[10, 10, 200, 120]])
    assert blurry[10:130, 10:210].std() < big[10:130, 10:210].std() / 10
    df = spark.createDataFrame([([1, 2, 3, 4], [[0, 0, 2, 2]]), ([1, 2, 3, 4], [])], "g array<int>, b array<array<int>>")
    assert [r[0] for r in df.select(pixels.blurred(F.col("g"), F.lit(2), F.col("b"))).collect()] == [[3, 3, 3, 3], [1, 2, 3, 4]]
    assert pixels.gaussian_kernel(9).sum() == pytest.approx(1)


def test_pictures_in_files_read_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, y = np.meshgrid(np.arange(83), np.arange(45))
    smooth = ((x * 2 + y) % 200).astype(np.uint8)
    smooth[10:20, 30:50] = 255
    noise = rng.integers(0, 256, (17, 9)).astype(np.uint8)
    flat = np.full((1, 1), 77, np.uint8)
    rows = [(f"{name}{q}.{end}", p.reshape(-1).astype(int).tolist(), p.shape[1], end, q) for name, p in (("s", smooth), ("n", noise), ("f", flat)) for end, q in (("png", 1), ("jpg", 100), ("jpg", 50), ("jpg", 5))]
    df = spark.createDataFrame(rows, "name string, gray array<int>, w int, ending string, q int")
    for end, q in {(r[3], r[4]) for r in rows}:
        some = df.where((F.col("ending") == end) & (F.col("q") == q)).withColumn("content", pictures.encoded(F.col("gray"), F.col("w"), end, q))
        sinks.write_files(some, f"file://{tmp_path}/p")
    back = {r["path"].rsplit("/", 1)[1]: r for r in seams.read_pictures(spark, f"file://{tmp_path}/p").collect()}
    assert len(back) == len(rows)
    for name, gray, w, end, q in rows:
        got, want = np.array(back[name]["gray"]), np.array(gray)
        assert back[name]["width"] == w and len(got) == len(want)
        if end == "png":
            assert (got == want).all()
        elif q == 100:
            assert np.abs(got - want).max() <= 2
        elif name.startswith("s"):
            assert np.abs(got - want).mean() < (6 if q == 50 else 25)
    sizes = [len(pictures.jpeg(smooth, q)) for q in (5, 50, 100)]
    assert sizes == sorted(sizes)


def test_compared_is_motion_and_histogram(spark):
    rng = np.random.default_rng(6)
    rows = [(rng.integers(0, 256, 60).tolist(), rng.integers(0, 256, 60).tolist()) for _ in range(20)] + [([7] * 9, [7] * 9), ([7] * 9, [99] * 9), (None, [1]), ([4, 5, 6], [5, 4, 6])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    out = df.select(pixels.compared(a, b).alias("c"), pixels.motion_score(a, b).alias("m"), pixels.histogram_similarity(pixels.histogram(a), pixels.histogram(b)).alias("h")).collect()
    for r, (x, _) in zip(out, rows):
        if x is None:
            assert r["c"]["score"] is None and r["c"]["similarity"] is None
        else:
            assert r["c"]["score"] == pytest.approx(r["m"]) and r["c"]["similarity"] == pytest.approx(r["h"])


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    files = lambda *names: spark.createDataFrame([(n, f"of {n}".encode()) for n in names], "name string, content binary").repartition(3)
    out = tmp_path / "out"
    sinks.write_files(files("a/index.json", "a/frames/00000.png", "b.txt"), f"file://{out}")
    found = sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file())
    assert found == ["a/frames/00000.png", "a/index.json", "b.txt"] and (out / "b.txt").read_text() == "of b.txt"
    for bad in ("../x", "/x", "a//b", "", "_staging-1/x"):
        with pytest.raises(Exception, match="no name for a file"):
            sinks.write_files(files("fine", bad), f"file://{out}")
    with pytest.raises(Exception, match="two files of one name"):
        sinks.write_files(files("c", "c"), f"file://{out}")
    broken = files("d", "e").withColumn("content", F.when(F.col("name") == "e", F.raise_error(F.lit("lost"))).otherwise(F.col("content")).cast("binary"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_files(broken, f"file://{out}")
    # What tasks that outlived their job may leave lies in a hidden folder, which no reader looks into.
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and not str(p.relative_to(out)).startswith("_staging-")) == found
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{out}").count() == len(found)
    names = spark.createDataFrame([("b.txt",), ("gone.png",)], "name string")
    assert [r["name"] for r in sinks.missing_files(spark, f"file://{out}", names).collect()] == ["gone.png"]


def clip(spark, path):
    """Two recordings with text, pictures, a moving cursor, a note and a frame that could not be decoded."""
    rows = []
    for rec in ("one", "two/b"):
        for i in range(6):
            said = ["Menu", ["Home", "Mail jo@ex.com", "Error: denied"][i // 2]]
            boxes = [(t, [2, 4 + 8 * j, 18, 6]) for j, t in enumerate(said)]
            rows.append((rec, i, float(i), 1.0, boxes, screen(2 + 3 * i, 20 - 3 * i, 40 * (i // 2)), SIDE, SIDE, "blurry" if i in (1, 2) else None, rec == "two/b" and i >= 4))
    schema = "rec string, pos bigint, t double, moved double, boxes array<struct<text:string,box:array<int>>>, gray array<int>, width int, height int, note string, failed boolean"
    spark.createDataFrame(rows, schema).write.parquet(path)


def test_every_file_that_an_index_names_is_there(spark, tmp_path, capsys):
    clip(spark, f"file://{tmp_path}/frames")
    at, out = f"file://{tmp_path}/frames", f"file://{tmp_path}/out"
    said = spark.createDataFrame([("one", 0, 0.5, 3.5, "write to jo@ex.com now")], "rec string, n bigint, start double, end double, text string")
    said.write.parquet(f"{tmp_path}/speech")
    cli.main(["index", at, out, "--events", "--redact", "--boxes", "--interactions", "--keyframe-format", "jpg", "--thumb-width", "12", "--narration", f"{tmp_path}/speech"], spark)
    told = capsys.readouterr()
    assert told.out == f"index: {out}\n" and "one: 1 warning(s)" in told.err and "two/b: 2 warning(s)" in told.err
    docs = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").rglob("index.json")}
    assert set(docs) == {"one", "two_b"} and len(docs["one"]["states"]) == 3 and len(docs["two_b"]["states"]) == 2
    assert docs["one"]["warnings"] == ["blurry (2 frames, the first 1)"] and docs["two_b"]["warnings"][1] == "decoding stopped early at frame 4"
    assert docs["one"]["narration"] == [{"start": 0.5, "end": 3.5, "text": "write to [REDACTED:email] now"}]
    assert any(s["interactions"] for s in docs["one"]["states"])
    for name, doc in docs.items():
        for s in doc["states"]:
            for f in (s["keyframe"], s["thumbnail"]):
                assert (tmp_path / "out" / name / f).read_bytes()[:2] == b"\xff\xd8"
    back = {r["path"].rsplit("/", 1)[1]: r for r in seams.read_pictures(spark, f"file://{tmp_path}/out/one/frames").collect()}
    shown = np.array(back["00001.jpg"]["gray"]).reshape(SIDE, SIDE)
    assert shown.shape == (24, 24) and back["00001_thumb.jpg"]["width"] == 12
    assert shown[12:18, 2:20].max() < 245  # the cursor stood in the box of the address: blurred
    summary = {s["video"]: s for s in tools.info(spark, out)}
    assert summary["one"]["warnings"] == 1 and summary["two/b"]["warnings"] == 2


def test_manifest_files(spark, tmp_path):
    clip(spark, f"file://{tmp_path}/frames")
    done = tools.analyze(spark, f"file://{tmp_path}/frames", f"file://{tmp_path}/man", cols=12, edge=True)
    assert [r["frames"] for r in done["recordings"]] == [6, 6]
    manifest = json.loads((tmp_path / "man" / "one" / "manifest.json").read_text())
    for f in manifest["frames"]:
        assert (tmp_path / "man" / "one" / f["png"]).read_bytes()[:4] == b"\x89PNG"
        assert [len(x) for x in (tmp_path / "man" / "one" / f["ascii"]).read_text().split("\n")] == [12] * 6


def grab(n):
    return np.full((3, 4), n % 256)


def test_capture_writes_frames(spark, tmp_path, capsys):
    out = f"file://{tmp_path}/cap"
    assert seams.recorded(spark, grab, 2.0, 50.0, out, at_once=30) == 100
    rows = spark.read.parquet(out).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(100)) and rows[99]["t"] == pytest.approx(1.98) and rows[77]["gray"] == [77] * 12
    for device in ("nomodule", "no_such_module:f", "math:nothing"):
        with pytest.raises(SystemExit):
            cli.main(["capture", f"{out}2", "--device", device], spark)


def test_warnings_and_failures(spark):
    notes = spark.createDataFrame([("a", 5, "bad"), ("a", 2, "bad"), ("a", 3, "odd"), ("b", 1, None)], "rec string, pos bigint, note string")
    assert [tuple(r) for r in recording.warnings(notes).collect()] == [("a", ["bad (2 frames, the first 2)", "odd"])]
    frames = spark.createDataFrame([("a", i, i in (3, 5)) for i in range(7)] + [("b", 0, False)], "rec string, pos bigint, failed boolean")
    kept, said = recording.until_failure(frames)
    assert sorted((r["rec"], r["pos"]) for r in kept.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert [r["note"] for r in said.collect()] == ["decoding stopped early at frame 3"]
    states = spark.createDataFrame([("a", 0, 0, 0.0, 1.0)], "rec string, pos bigint, idx int, t_start double, t_end double").selectExpr("*", "'' thumbnail", "'' keyframe", "array('x') lines", "array('x') added", "array('') removed", "cast(array() as array<struct<text:string,box:array<int>>>) boxes", "cast(null as struct<t:double,x:int,y:int,label:string>) interaction", f"cast(null as {document._EVENT}) event", "0.0D salience")
    recs = spark.createDataFrame([("a", "a.mp4", 1.0)], "rec string, video string, duration double")
    assert document.documents(states, recs, warned=recording.warnings(notes)).first()["warnings"] == ["bad (2 frames, the first 2)", "odd"]
    assert document.documents(states, recs).first()["warnings"] == []


def test_cursors_of_many_pictures_are_found_in_one_pass(monkeypatch):
    rng, passes = np.random.default_rng(3), []
    prev = np.zeros((64, 20, 30), np.int16)
    cur = np.where(rng.random(prev.shape) < 0.12, 200, 0).astype(np.int16)
    cur[0] = 0
    whole = pixels._labels_of
    monkeypatch.setattr(pixels, "_labels_of", lambda m: passes.append(1) or whole(m))
    got = pixels.cursors_between(prev, cur)
    assert len(passes) == 1
    for a, b, spot in zip(prev, cur, got):
        left, parts = {(int(y), int(x)) for y, x in zip(*np.nonzero(np.abs(b - a) > 25))}, []
        for cell in sorted(left):
            if cell not in left:
                continue
            part, todo = [], [cell]
            left.discard(cell)
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for z in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if z in left:
                        left.discard(z)
                        todo.append(z)
            parts.append(part)
        small = [p for p in parts if 4 <= len(p) <= 6]
        best = max(small, key=len) if small else None
        assert spot == (best and (int(np.mean([x for _, x in best])), int(np.mean([y for y, _ in best]))))


def test_pictures_of_a_batch_are_worked_on_together(monkeypatch):
    """Equal boxes of a batch are one blur, pictures of one size one sharpness; each as if it were alone."""
    rng, calls = np.random.default_rng(4), []
    grays = [rng.integers(0, 256, w * h).astype(np.int32) for w, h in [(8, 8)] * 500 + [(5, 9), (1, 4), (6, 1)]]
    widths = [8] * 500 + [5, 1, 6]
    boxes = [[[1, 2, 4, 3], [0, 0, 3, 5]]] * 500 + [[[-2, -2, 9, 9], [1, 1, 2, 2]], [[0, 0, 1, 4]], []]
    want = [pixels.blur_boxes(g.reshape(-1, w), b).reshape(-1).tolist() for g, w, b in zip(grays, widths, boxes)]
    lists, wide = pa.array([g.tolist() for g in grays], pa.list_(pa.int32())), pa.array(widths, pa.int32())
    kernel = pixels.gaussian_kernel
    monkeypatch.setattr(pixels, "gaussian_kernel", lambda size: calls.append(size) or kernel(size))
    assert pixels._blurred(lists, wide, pa.array(boxes, pa.list_(pa.list_(pa.int32())))).to_pylist() == want
    assert len(calls) < 10

    def alone(g: np.ndarray, w: int) -> float:
        f = g.reshape(-1, w).astype(float)
        p = np.pad(f, 1, mode="reflect" if min(f.shape) > 1 else "edge")
        return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * f).var())

    assert pixels._sharpness(lists, wide).to_pylist() == [alone(g, w) for g, w in zip(grays, widths)]


def test_many_files_of_a_folder_are_one_name_for_the_driver(tmp_path, monkeypatch):
    """Messages of tasks and moves go by folders; shared ones are merged, and no file of one name is written twice."""
    real, moves = sinks.filesystem, []

    class Store:
        def __init__(self, store):
            self.store = store

        def move(self, a, b):
            moves.append(b)
            self.store.move(a, b)

        def __getattr__(self, name):
            return getattr(self.store, name)

    monkeypatch.setattr(sinks, "filesystem", lambda path: (Store(real(path)[0]), real(path)[1]))

    def job(*tasks):
        writer = sinks.FilesWriter(str(tmp_path / "out"))
        return writer, [writer.write(iter([pa.RecordBatch.from_pydict({"name": names, "content": [n.encode() for n in names]}, pa.schema([("name", pa.string()), ("content", pa.binary())]))])) for names in tasks]

    shown = lambda: sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    first, second = [f"r/frames/{i}.png" for i in range(5000)], [f"s/frames/{i}.png" for i in range(5000)]
    writer, messages = job(first, second)
    assert sum(len(pickle.dumps(m)) for m in messages) < 2000
    writer.commit(messages)
    assert len(moves) == 2 and shown() == sorted(first + second)
    writer, messages = job(["r/a", "r/deep/x", "t"], ["r/b", "r/frames/0.png"])
    writer.commit(messages)
    assert shown() == sorted([*first, *second, "r/a", "r/deep/x", "t", "r/b"])
    writer, messages = job(["u/deep/x"], ["fine", "u/deep/x"])
    with pytest.raises(ValueError, match="two files of one name: u/deep/x"):
        writer.commit(messages)
    assert "fine" not in shown() and not [p for p in shown() if p.startswith(("u", "_"))]


def test_pictures_below_a_path_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    for rec in ("1", "2/deep", "_hidden", ".dot"):
        for i in range(3):
            (tmp_path / rec / "frames").mkdir(parents=True, exist_ok=True)
            (tmp_path / rec / "frames" / f"{i}.png").write_bytes(pictures.png(gray + i))
    (tmp_path / "1" / "bad.png").write_bytes(b"no picture")
    (tmp_path / "1" / "other.txt").write_bytes(b"text")
    (tmp_path / "top.png").write_bytes(pictures.png(gray))
    monkeypatch.setattr(type(spark), "read", property(lambda _: pytest.fail("the driver lists the files")))
    rows = seams.read_pictures(spark, f"file://{tmp_path}", "*.png").collect()
    got = {r["path"].removeprefix(f"file://{tmp_path}/"): (r["gray"], r["width"], r["height"]) for r in rows}
    assert got == {f"{rec}/frames/{i}.png": ((gray + i).reshape(-1).tolist(), 4, 3) for rec in ("1", "2/deep") for i in range(3)} | {"top.png": (gray.reshape(-1).tolist(), 4, 3)}


def plain_png(values, depth, color, laced=False, filters=(0, 1, 2, 3, 4), palette=b""):
    """A PNG file of samples (height x width x samples), each row under the next filter, by loops."""
    import struct
    import zlib

    height, width, n = values.shape
    step, body, at = max(1, n * depth // 8), b"", 0
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if laced else ((0, 0, 1, 1),)
    for x, y, dx, dy in passes:
        part, above = values[y::dy, x::dx], None
        for row in part if part.shape[1] else []:
            bits = "".join(f"{int(v):0{depth}b}" for v in row.reshape(-1))
            line = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
            above, kind, coded = above or bytes(len(line)), filters[at % len(filters)], []
            for i, v in enumerate(line):
                a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                near = min((abs(a + b - c - q), k, q) for k, q in enumerate((a, b, c)))[2]
                coded.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
            body, above, at = body + bytes([kind, *coded]), line, at + 1
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, int(laced))) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


def test_png_files_of_any_kind(spark, tmp_path):
    """Each kind against its samples; those of 8 bits and palettes against Spark's own reader as well."""
    rng, own = np.random.default_rng(8), {}
    weighed = lambda rgb: np.rint(rgb @ [0.299, 0.587, 0.114])
    for color, n, depths in ((0, 1, (1, 2, 4, 8, 16)), (2, 3, (8, 16)), (3, 1, (1, 2, 4, 8)), (4, 2, (8, 16)), (6, 4, (8, 16))):
        for depth in depths:
            for laced in (False, True):
                v = rng.integers(0, 2**depth, (11, 13, n))
                palette = rng.integers(0, 256, (2**depth, 3)) if color == 3 else None
                data = plain_png(v, depth, color, laced, palette=b"" if palette is None else palette.astype(np.uint8).tobytes())
                scaled = np.rint(v * (255 / (2**depth - 1)))
                want = weighed(palette[v[:, :, 0]]) if color == 3 else scaled[:, :, 0] if n < 3 else weighed(scaled[:, :, :3])
                assert (pictures.unpng(data) == want).all(), (color, depth, laced)
                if depth == 8:
                    name = f"{color}-{depth}-{laced}.png"
                    (tmp_path / name).write_bytes(data)
                    own[name] = want.reshape(-1).tolist()
    back = {r["path"].rsplit("/", 1)[1]: r["gray"] for r in seams.read_pictures(spark, f"file://{tmp_path}").collect()}
    assert back == own
    good = pictures.png(np.ones((4, 4)))
    for bad in (b"", good[:8], good[:40], good.replace(b"IDAT", b"IDOT")):
        with pytest.raises(ValueError):
            pictures.unpng(bad)


def test_texts_are_written_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """A file for each row, whatever its name, without a partitioned write or a pattern that the driver matches."""
    names = ["rec1.mp4", "a/b", "é ü", "50%", "x+y", "a=b:c*[1]{2}", "same", "same", "..", 'q"\\']
    texts = spark.createDataFrame([(n, f"of {n}\nand more\n") for n in names], "video string, doc string").repartition(3)
    out = f"file://{tmp_path}/out"
    monkeypatch.setattr(type(spark), "read", property(lambda _: pytest.fail("the driver lists the files")))
    documents.write_transcripts(texts, out)
    back = documents.read_texts(spark, out).select(documents.name_of(F.col("path")), "value").collect()
    assert sorted(map(tuple, back)) == sorted((n, f"of {n}\nand more\n\n") for n in names)
    assert (tmp_path / "out" / "video=a%2Fb").is_dir()
    with pytest.raises(Exception, match="already exists"):
        documents.write_transcripts(texts, out)
