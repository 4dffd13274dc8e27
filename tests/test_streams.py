"""Streams that emit states, narration by a sweep, the index data source, the table function, long lines."""

from __future__ import annotations

import datetime
import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from uistrata.functions import redact, text
from uistrata.operators import index, sequence
from uistrata.plans import evalqa
from uistrata.sources import datasource, documents
from uistrata.streaming import incremental, segments, windows

T0 = datetime.datetime(2024, 1, 1)
FRAMES = "rec string, pos bigint, t double, ts timestamp, lines array<string>, moved double"


def frame_rows(rec, n, seed, gap=30):
    rng, out, t = random.Random(seed), [], 0.0
    lines = ["a", "b", "c"]
    for i in range(n):
        if rng.random() < 0.4:
            lines = [rng.choice("abcdefgh  ") for _ in range(rng.randint(0, 4))]
        out.append((rec, i, t, T0 + datetime.timedelta(seconds=t), list(lines), None if i == 0 else rng.choice([0.0, 0.05, 0.2, 0.5])))
        t += rng.randint(0, gap)
    return out


def by_batch(frames, merge):
    segs = sequence.segment_by_text(frames, 0.8, 0.1)
    if merge is None:
        return segs.select("rec", F.col("seg").cast("bigint").alias("pos"), F.col("seg").cast("bigint").alias("idx"), "t_start", "t_end", "lines", "keyframe")
    return sequence.merge_near(segs, merge).select("rec", "pos", F.col("idx").cast("bigint").alias("idx"), "t_start", "t_end", "lines", "keyframe")


@pytest.mark.parametrize("merge", [None, 0.5])
def test_stream_of_frames_gives_the_states_of_the_batch(spark, merge):
    """Frames out of order, over queries that are ended and started again."""
    rows = frame_rows("x", 120, 1) + frame_rows("y", 50, 2) + frame_rows("z", 1, 3)
    frames = spark.createDataFrame(rows, FRAMES)
    got = segments.run_states(frames, 3, 120, threshold=0.8, motion=0.1, merge=merge, slot_seconds=20.0, idle_seconds=1e6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_batch(frames, merge).collect()))


def streamed(spark, tmp_path, batches, **options):
    """(rows, late rows) of batches that come one after the other into one query, which is started anew for each."""
    late = 0
    spark.createDataFrame([], FRAMES).write.parquet(f"{tmp_path}/in/none")
    stream = spark.readStream.schema(FRAMES).parquet(f"{tmp_path}/in/*")
    states = segments.states_of_stream(stream, 0.8, 0.1, **options)
    spark.createDataFrame([], states.schema).write.parquet(f"{tmp_path}/out/b=-1")
    with segments.rocksdb(spark):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, FRAMES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            q = states.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}")).start()
            q.awaitTermination()
            late += sum(p["late_rows"] for p in windows.progress(q))
    return sorted(tuple(r)[:7] for r in spark.read.schema(states.schema).parquet(f"{tmp_path}/out").select(*states.columns).collect()), late


def at(rec, pos, seconds, *lines):
    return (rec, pos, float(seconds), T0 + datetime.timedelta(seconds=seconds), list(lines), 1.0)


def test_late_frames_and_idle_recordings(spark, tmp_path):
    end = [(None, None, None, T0 + datetime.timedelta(days=9), [], None)]
    batches = [[at("a", 0, 0, "x"), at("a", 2, 100, "y")], [at("a", 3, 5000, "z")], [at("a", 1, 50, "w"), at("a", 4, 5001, "z")], end]
    got, late = streamed(spark, tmp_path, batches, merge=None, late="10 seconds", slot_seconds=10.0, idle_seconds=3600.0)
    # Place 1 comes when the watermark has passed it; the gap of 4,900 seconds ends the recording and begins one anew.
    assert late == 1
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in got] == [("a", 0, 0.0, 0.0, ["x"]), ("a", 0, 5000.0, 5001.0, ["z"]), ("a", 1, 100.0, 100.0, ["y"])]


def test_narration_against_all_pairs(spark):
    rng = random.Random(3)
    states, told = [], []
    for rec in "ab":
        t = 0
        for i in range(60):
            end = t + rng.choice([0, 0, 1, 3])
            states.append((rec, i * 2, float(t), float(end)))
            t = end + rng.choice([0, 1, 2])
        told += [(rec, n, float(s := rng.randint(-5, t)), float(s + rng.choice([-2, 0, 1, 4, 30])), f"t{n}") for n in range(80)]
    told += [("c", 0, 0.0, 9.0, "nowhere"), ("a", 5, 2.0, 8.0, "same number")]
    s = spark.createDataFrame(states, "rec string, idx int, t_start double, t_end double")
    n = spark.createDataFrame(told, "rec string, n int, start double, end double, text string")
    want = sorted((r, i, k, x) for r, i, a, b in states for q, k, c, d, x in told if q == r and c < b and d > a)
    assert sorted(map(tuple, index.overlapping(s, n).collect())) == want
    said = {(r["rec"], r["idx"]): r["said"] for r in index.narration_of(s, n).collect()}
    assert said == {(r, i): " ".join(x for _, x in sorted((k, x) for q, j, k, x in want if (q, j) == (r, i))) for r, i in {(w[0], w[1]) for w in want}}


def test_narration_of_a_long_recording_is_a_sweep(spark):
    """100,000 states and as many narrations of one recording: pairs that do not meet are never made."""
    n = 100_000
    s = spark.range(n).selectExpr("'a' rec", "cast(id as int) idx", "id * 2.0D t_start", "id * 2.0D + 1 t_end")
    told = spark.range(n).selectExpr("'a' rec", "id n", "id * 2.0D + 0.5 start", "id * 2.0D + 2.5 end", "'t' text")
    began = time.time()
    assert index.overlapping(s, told).count() == 2 * n - 1
    assert time.time() - began < 90


DOC = {"video": "v.mp4", "duration": 2.0, "sampled_fps": 1.0, "states": [{"idx": 0, "t_start": 0.0, "t_end": 1.0, "thumbnail": "t", "keyframe": "k"}]}


def test_index_source_round_trip(spark, tmp_path):
    datasource.register(spark)
    event = {"type": "type", "t": 1.0, "region": [1, 2, 3, 4], "confidence": 0.6, "label": None, "field": "Näme", "value": "x"}
    state = {"idx": 3, "t_start": 0.0, "t_end": 1.0, "thumbnail": "t", "keyframe": "k", "ocr_text": ["ü", "b"], "text_added": ["b"], "text_removed": [], "boxes": [{"text": "b", "box": [1, 2, 3, 4]}], "interactions": [{"t": 1.0, "x": 1, "y": 2, "label": None}], "event": event, "salience": 0.5}
    docs = [(2, f"rec {i}.mp4", 2.0, 1.0, [state, {**state, "event": None}][: i % 3], [{"start": 0.0, "end": 1.0, "text": "hi"}], ["odd"]) for i in range(7)]
    df = spark.createDataFrame(docs, documents.INDEX).repartition(3)
    df.write.format("uiindex").mode("append").save(f"file://{tmp_path}/out")
    back = spark.read.format("uiindex").load(f"file://{tmp_path}/out")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert sorted(map(str, documents.read_index(spark, f"file://{tmp_path}/out/*/index.json").select("video", "states.ocr_text").collect())) == sorted(map(str, df.select("video", "states.ocr_text").collect()))
    assert b"N\\u00e4me" in (tmp_path / "out" / "rec 1.mp4" / "index.json").read_bytes()
    one = spark.read.format("uiindex").load(f"file://{tmp_path}/out/rec 1.mp4/index.json")
    assert [r["video"] for r in one.collect()] == ["rec 1.mp4"]


def test_index_source_checks_documents(spark, tmp_path):
    datasource.register(spark)
    read = lambda name: spark.read.format("uiindex").load(f"file://{tmp_path}/{name}.json").collect()
    (tmp_path / "old.json").write_text(json.dumps(DOC | {"more": 1}))
    (row,) = read("old")
    assert (row["schema_version"], row["narration"], row["states"][0]["ocr_text"], row["states"][0]["salience"], row["states"][0]["event"]) == (1, [], [], 0.0, None)
    bad = {
        "newer": (DOC | {"schema_version": 999}, "unsupported schema version 999"),
        "short": ({k: v for k, v in DOC.items() if k != "states"}, "lacks states"),
        "state": (DOC | {"states": [{"idx": 1}]}, "state 0 lacks t_start"),
        "told": (DOC | {"narration": [{"start": 0, "end": 1, "text": "x", "who": "me"}]}, "unknown keys who"),
        "list": ([1], "no JSON document"),
    }
    for name, (doc, said) in bad.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        with pytest.raises(Exception, match=said):
            read(name)
    with pytest.raises(Exception, match="none"):
        spark.read.format("uiindex").load(f"file://{tmp_path}/none").collect()
    assert spark.read.format("uiindex").load(f"file://{tmp_path}").count() == 0  # no index.json below


def test_a_task_that_fails_leaves_no_document(spark, tmp_path):
    datasource.register(spark)
    rows = [(2, f"r{i}", 1.0, 1.0, [], [], []) for i in range(9)]
    df = spark.createDataFrame(rows, documents.INDEX).repartition(3)
    broken = df.withColumn("video", F.when(F.col("video") == "r8", F.raise_error(F.lit("lost task")).cast("string")).otherwise(F.col("video")))
    with pytest.raises(Exception, match="lost task"):
        broken.write.format("uiindex").mode("append").save(f"file://{tmp_path}/out")
    assert not list((tmp_path).rglob("out/r*"))
    df.write.format("uiindex").mode("append").save(f"file://{tmp_path}/out")
    assert spark.read.format("uiindex").load(f"file://{tmp_path}/out").count() == 9


def test_slices_hold_files_by_size(tmp_path, monkeypatch):
    for i in range(6):
        (tmp_path / f"v{i}").mkdir()
        (tmp_path / f"v{i}" / "index.json").write_text(json.dumps(DOC))
    monkeypatch.setattr(datasource, "SLICE", 2 * len(json.dumps(DOC)))
    parts = datasource.IndexReader(str(tmp_path), None).partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 2]


def test_questions_by_table_function(spark):
    evalqa.register_questions(spark)
    rows = ['{"Question": "q", "Options": ["x", "y"], "Correct Answer": "A"}', '[{"Question": "r"}, 5, {"Options": "text"}]', "[]", "no json", None, ""]
    spark.createDataFrame(list(enumerate(rows)), "i int, mcqa string").createOrReplaceTempView("asked")
    got = spark.sql("SELECT i, q.* FROM asked, LATERAL questions_of(mcqa) q").collect()
    assert sorted(map(tuple, got), key=repr) == [(0, "q", '["x", "y"]', "A"), (1, "r", None, None), (1, None, "text", None)]


def plain_surplus(lines, other):
    norm = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())
    left, out = Counter(norm(x) for x in other), []
    for x in lines:
        if (n := norm(x)) and left[n] <= 0:
            out.append(x)
        left[n] -= 1
    return out


def test_surplus_against_counters(spark):
    rng = random.Random(7)
    rows = [([rng.choice(["a", "A!", "b", "b c", "B  C", "", "--", "é"]) for _ in range(rng.randint(0, 12))], [rng.choice(["a", "b", "b c", "", "d"]) for _ in range(rng.randint(0, 9))]) for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, ["a"]), (["a"], None)], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(text.surplus(F.col("a"), F.col("b"))).collect()]
    assert got == [*[plain_surplus(a, b) for a, b in rows], None, None]


def test_long_arrays_and_lines_take_time_in_proportion(spark):
    lines = [f"line {i % 9000}" for i in range(20_000)]
    df = spark.createDataFrame([(lines, lines[5000:])], "a array<string>, b array<string>").cache()
    df.count()
    began = time.time()
    assert df.select(F.size(text.surplus(F.col("a"), F.col("b")))).first()[0] == len(plain_surplus(lines, lines[5000:]))
    assert time.time() - began < 20
    words = spark.createDataFrame([(" ".join(["word"] * 8000) + " jo@ex.com",)], "line string").cache()
    words.count()
    words.select(F.size(redact.find_secrets(F.col("line")))).first()
    began = time.time()
    assert words.select(F.size(redact.find_secrets(F.col("line")))).first()[0] == 1
    assert time.time() - began < 3


@pytest.mark.parametrize("merge", [None, 0.5])
def test_two_halves_give_the_whole(spark, tmp_path, merge):
    rows = frame_rows("x", 90, 11) + frame_rows("y", 20, 12) + frame_rows("z", 1, 13)
    grown = incremental.GrowingStates(spark, f"file://{tmp_path}/g", 0.8, 0.1, merge)
    with pytest.raises(ValueError, match="no frames"):
        grown.states()
    frame = lambda some: spark.createDataFrame(some, FRAMES).repartition(3)
    for n, (lo, hi) in enumerate(((0, 15), (15, 16), (16, 60), (60, 99))):
        grown.append(n, frame([r for r in rows if lo <= r[1] < hi]))
        so_far = frame([r for r in rows if r[1] < hi])
        assert sorted(map(tuple, grown.states().collect())) == sorted(map(tuple, by_batch(so_far, merge).collect()))
        if n == 2:
            grown.append(n, frame([r for r in rows if lo <= r[1] < hi]))  # a batch that is run again
    with pytest.raises(ValueError, match="batch 1 comes after batch 3"):
        grown.append(1, frame(rows[:1]))


def plain_merge(rows, threshold):
    norm = lambda lines: {" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split()) for s in lines} - {""}
    out, last = [], {}
    for rec, seg, t_start, t_end, lines in sorted(rows):
        now = norm(lines)
        if rec in last and (1.0 if not now and not last[rec][0] else len(now & last[rec][0]) / len(now | last[rec][0])) >= threshold:
            last[rec][1][3] = t_end
        else:
            last[rec] = (now, [rec, seg, t_start, t_end, lines, last[rec][1][5] + 1 if rec in last else 0])
            out.append(last[rec][1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_merge_over_batches_of_any_size(spark, size):
    rng = random.Random(size)
    rows = [(rec, i, float(i), i + 0.5, [rng.choice("abc ") for _ in range(rng.randint(0, 3))]) for rec in ("u", "v", "w") for i in range(rng.choice([1, 40, 90]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        df = spark.createDataFrame(rows, "rec string, seg int, t_start double, t_end double, lines array<string>").repartition(4)
        got = [(r["rec"], r["idx"], r["t_start"], r["t_end"], r["lines"], r["pos"]) for r in sequence.merge_near(df, 0.6).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == plain_merge(rows, 0.6)


class Touched:
    """Stands in for the state of one recording: counts how often it is read or written."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):
        return _Value(self, name)

    def getMapState(self, name, key, value):
        return _Map(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class _Value:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        self.store.calls += 1
        return self.store.values.get(self.name)

    def exists(self):
        return self.get() is not None

    def update(self, value):
        self.store.calls += 1
        self.store.values[self.name] = tuple(value)

    def clear(self):
        self.store.calls += 1
        self.store.values.pop(self.name, None)


class _Map:
    def __init__(self, store, name):
        self.store, self.held = store, store.values.setdefault(name, {})

    def keys(self):
        self.store.calls += 1
        return list(self.held)

    def exists(self):
        self.store.calls += 1
        return bool(self.held)

    def containsKey(self, key):
        self.store.calls += 1
        return tuple(key) in self.held

    def getValue(self, key):
        self.store.calls += 1
        return self.held[tuple(key)]

    def updateValue(self, key, value):
        self.store.calls += 1
        self.held[tuple(key)] = value

    def removeKey(self, key):
        self.store.calls += 1
        del self.held[tuple(key)]


@pytest.mark.parametrize("run", [4096, 7])
def test_state_of_a_recording_is_touched_by_batches_not_by_slots(monkeypatch, run):
    import pandas as pd

    monkeypatch.setattr(segments, "RUN", run, raising=False)
    rng, rules = random.Random(5), segments.Segmenter(0.8, 0.0, 0.95)
    frames = [(i, float(i), i * 90_000, rng.sample(["a", "b", "c"], 2), 1.0) for i in range(200)]
    processor, store = segments.StatesOfStream(rules, 60_000, 3_600_000), Touched()
    processor.init(store)
    shown, out = sorted(frames, key=lambda f: f[2] + rng.randrange(900_000)), []

    class Mark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    def passed(mark):
        while due := sorted(t for t in store.timers if t <= mark):
            for t in due:
                out.extend(r for df in processor.handleExpiredTimer((1,), Mark(mark), None) for r in df.itertuples(index=False))
                store.timers.discard(t)

    for i in range(0, 200, 50):
        part = pd.DataFrame([f for f in shown[i : i + 50]], columns=["pos", "t", "at", "lines", "moved"])
        list(processor.handleInputRows((1,), iter([part]), None))
        passed(max(f[2] for f in shown[: i + 50]) - 900_000)
    passed(10**12)

    now, kept, want = None, None, []
    for pos, t, _, lines, moved in frames:
        now, segment = rules.frame(now, pos, t, lines, moved)
        if segment:
            kept, state = rules.ended(kept, segment)
            want += [state] if state else []
    kept, state = rules.ended(kept, now[:5])
    want += [s for s in (state, kept) if s]
    assert [(r[1], r[2], r[3], r[4], list(r[5]), r[6]) for r in out] == [(*s[:4], list(s[4]), s[5]) for s in want]
    assert not store.values.get("waiting") and store.calls < (100 if run > 1000 else 400)


def test_documents_of_a_batch_are_made_one_at_a_time(tmp_path):
    import pyarrow as pa

    class Rows:
        def __init__(self, rows):
            self.rows, self.num_rows = rows, rows.num_rows

        def slice(self, start, n):
            return Rows(self.rows.slice(start, n))

        def to_pylist(self):
            assert self.num_rows == 1
            return self.rows.to_pylist()

    writer = datasource.IndexWriter(str(tmp_path))
    writer.commit([writer.write(iter([Rows(pa.RecordBatch.from_pylist([{"video": f"v{i}", "states": [{"idx": 0}]} for i in range(5)]))]))])
    assert [json.loads((tmp_path / f"v{i}" / "index.json").read_text())["video"] for i in range(5)] == [f"v{i}" for i in range(5)]


def test_a_folder_of_files_is_made_once(tmp_path, monkeypatch):
    import pyarrow as pa

    from uistrata.sources import sinks

    real, made = sinks.filesystem, []

    class Store:
        def __init__(self, store):
            self.store = store

        def create_dir(self, path, recursive=True):
            made.append(path)
            self.store.create_dir(path, recursive=recursive)

        def __getattr__(self, name):
            return getattr(self.store, name)

    def counted(path):
        store, root = real(path)
        return Store(store), root

    monkeypatch.setattr(sinks, "filesystem", counted)
    writer = sinks.FilesWriter(str(tmp_path))
    rows = pa.RecordBatch.from_pylist([{"name": f"r/frames/{i}.png", "content": b"%d" % i} for i in range(20)])
    writer.commit([writer.write(iter([rows]))])
    assert sorted(p.name for p in (tmp_path / "r" / "frames").iterdir()) == sorted(f"{i}.png" for i in range(20))
    assert [p.name for p in tmp_path.iterdir()] == ["r"] and len(made) == 2


def test_an_append_is_one_pass_over_sorted_batches(spark, tmp_path):
    """Thousands of short recordings cost their frames, not a group each; those without new frames are carried on."""
    grown = incremental.GrowingStates(spark, f"file://{tmp_path}/g", 0.8, 0.1, 0.95)
    frames = spark.range(40_000).select((F.col("id") % 20_000).alias("rec"), F.floor(F.col("id") / 20_000).alias("pos"), F.col("id").cast("double").alias("t"), F.array(F.concat(F.lit("l"), F.col("id"))).alias("lines"), F.lit(1.0).alias("moved"))
    grown.append(0, frames.where("pos = 0 and rec < 10"))
    start = time.time()
    grown.append(1, frames.where("pos = 1 or rec >= 10"))
    took = time.time() - start
    assert grown.states().count() == 40_000 and took < 15
    grown.append(2, frames.limit(0))
    assert grown.states().count() == 40_000


def test_short_recordings_share_the_calls_of_state():
    """A group of recordings costs state some calls a batch, whatever their number; each has the states that it has alone."""
    import pandas as pd

    rng, rules = random.Random(9), segments.Segmenter(0.8, 0.0, 0.95)
    frames = [(f"r{r}", i, float(i), i * 90_000 + r, rng.sample(["a", "b", "c"], 2), 1.0) for r in range(300) for i in range(20 if r % 3 else 60)]

    class Mark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    def run(frames):
        processor, store, out = segments.StatesOfStream(rules, 60_000, 3_600_000), Touched(), []
        processor.init(store)
        shown = sorted(frames, key=lambda f: f[3])
        for i in range(4):
            part = shown[i * len(shown) // 4 : (i + 1) * len(shown) // 4]
            list(processor.handleInputRows((7,), iter([pd.DataFrame(part, columns=["rec", "pos", "t", "at", "lines", "moved"])]), None))
            mark = 10**12 if i == 3 else max(f[3] for f in part) - 900_000
            while due := sorted(t for t in store.timers if t <= mark):
                for t in due:
                    out += [tuple(r)[:5] + (tuple(r[5]), r[6]) for df in processor.handleExpiredTimer((7,), Mark(mark), None) for r in df.itertuples(index=False)]
                    store.timers.discard(t)
        assert not store.values["waiting"] and not store.timers and not store.values.get("going")
        return sorted(out), store.calls

    rng.shuffle(frames)
    got, calls = run(frames)
    assert got == sorted(s for r in range(300) for s in run([f for f in frames if f[0] == f"r{r}"])[0]) and calls < 100


def test_recordings_of_a_stream_keep_their_names(spark, tmp_path):
    """Names beyond a double's whole numbers, NULL beside others, and more recordings than groups."""
    schema = FRAMES.replace("rec string", "rec bigint")
    names = [2**53 + i for i in range(5)] + [-1, None]
    rows = [(n, *r[1:]) for n in names for r in frame_rows("", 12, abs(n or 3) % 97)]
    frames = spark.createDataFrame(rows, schema)
    got = segments.run_states(frames, 2, 120, threshold=0.8, motion=0.1, merge=None, slot_seconds=20.0, idle_seconds=1e6, groups=3)
    assert got.schema["rec"].dataType.simpleString() == "bigint"
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in by_batch(frames, None).select(*got.columns).collect())
