"""Evaluation: costs, a mock answerer, accuracy by bucket with a total row, conversion of question sets."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text

TOKENS_PER_IMAGE = 1500
BUCKETS = ("action", "state", "count", "visual")


def cost_estimate(docs: DataFrame, fps: float = 1.0, escalate: int = 3, per_image: int = TOKENS_PER_IMAGE) -> DataFrame:
    """Tokens of reading an index document (text and a few images) against all sampled frames, a row per recording."""
    chars = F.aggregate("states", F.lit(0), lambda n, s: n + F.length(F.array_join(s["ocr_text"], "\n")))
    d = docs.select("video", "duration", F.size("states").alias("n_states"), chars.alias("text_chars"))
    d = d.withColumn("text_tokens", F.bround(F.col("text_chars") / 4.0).cast("bigint"))
    d = d.withColumn("sampled_frames", F.greatest(F.col("n_states").cast("bigint"), F.bround(F.col("duration") * fps).cast("bigint")))
    images = F.least(F.lit(escalate), F.col("n_states"))
    index, base = F.col("text_tokens") + images * per_image, F.col("sampled_frames") * per_image
    return d.select(
        "video",
        F.round("duration", 2).alias("duration_s"),
        F.col("n_states").alias("states"),
        "sampled_frames",
        "text_chars",
        "text_tokens",
        images.alias("escalated_images"),
        index.alias("index_tokens"),
        base.alias("baseline_tokens"),
        F.round(F.when(base > 0, index / base).otherwise(0.0), 4).alias("cost_ratio"),
    )


def mock_answer(question: Column, choices: Column, view: Column) -> Column:
    """Number of the choice that shares most tokens with the view; the first of equals, and the first one where there is no text."""
    return F.when(F.coalesce(F.trim(view), F.lit("")) == "", 0).otherwise(_most_shared(choices, text.token_set(view)))


def _most_shared(choices: Column, tokens: Column) -> Column:
    """Number of the choice that shares most tokens; they are held in an array of one, so they are made once, not for every choice."""
    return F.get(F.transform(F.array(tokens), lambda seen: _best(choices, seen)), 0)


def _best(choices: Column, seen: Column) -> Column:
    scored = F.transform(choices, lambda c, i: F.struct(F.size(F.array_intersect(text.token_set(text.strip_choice_label(c)), seen)).alias("n"), (-i).alias("back")))
    return F.coalesce(-F.array_max(scored)["back"], F.lit(0))


class Answerer:
    """Picks a choice from a view.  ``needs_images``: reads pictures in the frames arm; others have nothing to read there."""

    name, needs_images = "mock", False

    def answer(self, question: Column, choices: Column, view: Column) -> Column:
        return mock_answer(question, choices, view)

    def read(self, view: Column) -> Column:
        """What ``answer_read`` needs of a clip's view: made once a clip, not for each of its questions."""
        return view

    def answer_read(self, question: Column, choices: Column, read: Column) -> Column:
        return self.answer(question, choices, read)

    def answer_frames(self, question: Column, choices: Column, frames: Column) -> Column:
        return mock_answer(question, choices, F.lit(None).cast("string"))


class MockAnswerer(Answerer):
    """The mock answerer, which needs the tokens of a view alone."""

    def read(self, view: Column) -> Column:
        return text.token_set(view)

    def answer_read(self, question: Column, choices: Column, read: Column) -> Column:
        return _most_shared(choices, read)


#: Answerers by name; those that need a model or a key are registered by who has them.
ANSWERERS: dict[str, type[Answerer]] = {"mock": MockAnswerer}


def get_answerer(name: str) -> Answerer:
    """The answerer of that name, the mock one if there is none or it cannot be made."""
    try:
        return ANSWERERS[name]()
    except Exception:  # a missing package or key must not end an evaluation
        return MockAnswerer()


def frame_choice(total: Column, n: Column) -> Column:
    """Places of n frames spread evenly over ``total``: every (total div n)-th from the first on."""
    step = F.greatest(F.lit(1), F.floor(total / n).cast("int"))
    some = F.transform(F.sequence(F.lit(0), F.least(n, F.ceil(total / step).cast("int")) - 1), lambda i: (i * step).cast("int"))
    return F.when((total > 0) & (n > 0), some).otherwise(F.array().cast("array<int>"))


def answered(qa: DataFrame, docs: DataFrame, views: DataFrame, answerer: Answerer, fps: float = 1.0, frames: int = 8, per_image: int = TOKENS_PER_IMAGE) -> DataFrame:
    """``qa`` (clip, question, choices, answer, type) with both arms: idx_ok, idx_tok, fr_ok, fr_tok; questions whose clip has no index are left out.

    ``docs``: index documents, ``views``: (video, doc), what is read of them.  A clip's view is as large as its
    recording, and the join may be skewed to a clip of many questions: the planner picks its form, nothing is forced.
    """
    total = F.greatest(F.size("states").cast("bigint"), F.bround(F.col("duration") * fps).cast("bigint"))
    # What is read of a clip goes with its row through the join, and the view itself stays behind it.
    read = views.select("video", answerer.read(F.col("doc")).alias("read"), text.token_estimate(F.col("doc"), False).alias("idx_tok"))
    known = docs.select("video", total.alias("total")).join(read, "video")
    rows = qa.join(known, qa["clip"] == known["video"])
    n = F.least(F.lit(frames).cast("bigint"), F.col("total")).cast("int")
    rows = rows.withColumn("pick", answerer.answer_read(F.col("question"), F.col("choices"), F.col("read")))
    other = answerer.answer_frames(F.col("question"), F.col("choices"), frame_choice(F.col("total").cast("int"), n))
    ok = lambda p: text.is_correct(p, F.col("choices"), F.col("answer"))
    return rows.select("clip", "question", F.coalesce("type", F.lit("other")).alias("type"), ok(F.col("pick")).alias("idx_ok"), "idx_tok", ok(other).alias("fr_ok"), (n * per_image).cast("bigint").alias("fr_tok"))


def skipped(qa: DataFrame, docs: DataFrame) -> DataFrame:
    """(clip, reason) of clips without an index."""
    return qa.select("clip").distinct().join(docs.select(F.col("video").alias("clip")), "clip", "left_anti").withColumn("reason", F.lit("no index of this clip"))


def two_arms(rows: DataFrame) -> DataFrame:
    """Per bucket and in total: n, index_acc, frames_acc, index_tokens, frames_tokens, in the order of ``place``."""
    sums = [F.sum(F.col(c).cast("bigint")).alias(c) for c in ("idx_ok", "fr_ok", "idx_tok", "fr_tok")]
    out = rows.rollup("type").agg(F.count(F.lit(1)).alias("n"), *sums, F.grouping("type").alias("total")).where("n > 0")
    percent = lambda c: F.format_string("%d%%", F.bround(100.0 * F.col(c) / F.col("n")).cast("int"))
    label, order = _bucket()
    return out.select(label.alias("bucket"), "n", percent("idx_ok").alias("index_acc"), percent("fr_ok").alias("frames_acc"), F.col("idx_tok").alias("index_tokens"), F.col("fr_tok").alias("frames_tokens"), order.alias("place"))


def _bucket() -> tuple[Column, Column]:
    """Name and order of a rolled-up bucket: the known ones first, then others by name, the total last."""
    label = F.when(F.col("total") == 1, "**TOTAL**").otherwise(F.coalesce("type", F.lit("other")))
    order = F.when(F.col("total") == 1, 99).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("type")), F.lit(0)), F.lit(50)))
    return label, order.cast("int")


def accuracy(rows: DataFrame) -> DataFrame:
    """Per bucket and in total (rollup): n, hits and tokens of one arm.  ``rows``: type, ok, tokens."""
    out = rows.rollup("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("hits"), F.sum("tokens").alias("tokens"), F.grouping("type").alias("total"))
    label, order = _bucket()
    percent = F.format_string("%d%%", F.bround(100.0 * F.col("hits") / F.col("n")).cast("int"))
    return out.select(label.alias("bucket"), "n", "hits", percent.alias("accuracy"), "tokens", order.alias("place"))


def table_lines(two: DataFrame) -> list[str]:
    """The report of ``two_arms`` as Markdown; a row per bucket comes to the driver."""
    rows = two.orderBy("place", "bucket").collect()
    head = ["| bucket | n | index_acc | frames_acc | index_tokens | frames_tokens |", "|--------|---|-----------|------------|--------------|---------------|"]
    return head + [f"| {r['bucket']} | {r['n']} | {r['index_acc']} | {r['frames_acc']} | {r['index_tokens']} | {r['frames_tokens']} |" for r in rows]


def convert(rows: DataFrame, domain: str = "desktop") -> DataFrame:
    """Question rows (video_path, system, question, options as JSON text, answer) to (clip, question, choices, answer, type, skipped)."""
    out = rows if domain == "all" else rows.where(text.domain_of(F.col("system")) == domain)
    choices = text.normalize_options(F.col("options"))
    full = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("video_path", "question", "answer")]
    skipped = ~(full[0] & full[1] & full[2] & choices.isNotNull())
    place = ["place"] if "place" in out.columns else []
    return out.select(*place, F.col("video_path").alias("clip"), F.trim("question").alias("question"), choices.alias("choices"), F.trim("answer").alias("answer"), text.classify_bucket(F.col("question")).alias("type"), skipped.alias("skipped"))


def converted(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of ``convert`` that are not skipped; with ``limit``, the first so many by ``place``, a column that orders the rows."""
    out = rows.where(~F.col("skipped"))
    if limit is not None:
        out = out.orderBy("place").limit(limit)
    return out.select("clip", "question", "choices", "answer", "type")


def convert_stats(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(emitted, skipped) counts; with ``limit``, up to the row of ``place`` that reaches it."""
    if limit is not None:
        last = rows.where(~F.col("skipped")).orderBy("place").limit(limit).agg(F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
        rows = rows.join(F.broadcast(last), (F.col("n") < limit) | (F.col("place") <= F.col("last")))  # one row
    return rows.agg(F.count_if(~F.col("skipped")).alias("emitted"), F.count_if("skipped").alias("skipped"))


class Questions:
    """A row of a question set to its questions: one object, a list of them, or none at all."""

    def eval(self, mcqa: str) -> Iterator[tuple[str | None, str | None, str | None]]:
        try:
            found = json.loads(mcqa) if mcqa else None
        except ValueError:
            return
        for q in found if isinstance(found, list) else [found]:
            if isinstance(q, dict):
                options = q.get("Options")
                yield q.get("Question"), options if options is None or isinstance(options, str) else json.dumps(options, ensure_ascii=False), q.get("Correct Answer")


def register_questions(spark: SparkSession, name: str = "questions_of") -> None:
    """A table function for SQL: ``SELECT ... FROM rows, LATERAL questions_of(rows.mcqa)``."""
    spark.udtf.register(name, udtf(Questions, returnType="question string, options string, answer string", useArrow=False))
