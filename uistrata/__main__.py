"""Command line: ``python -m uistrata index FRAMES OUT``, and so on."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from . import tools
from .operators import recording

#: What the options of a build are for, on the command line.
ABOUT = {
    "fps": "frames a second that were sampled",
    "change_threshold": "motion that ends a state, with --fast",
    "text_threshold": "likeness of text under which a state ends",
    "motion_epsilon": "motion under which text is not read again",
    "dedupe_threshold": "likeness at which a state joins the one before",
    "fast": "segment by motion, not by text",
    "boxes": "keep the place of each line",
    "redact": "mask secrets in text and narration, blur them in keyframes",
    "interactions": "where the cursor rested: from --cursor, else from the pictures",
    "events": "type the transitions",
    "keyframe_budget": "states to curate",
    "max_frames": "frames of a recording at most",
    "keyframe_format": "png, jpg or jpeg",
    "keyframe_quality": "of jpg, 1 to 100",
    "thumb_width": "pixels of a thumbnail's side",
}
#: Subcommand: what it is for, then its arguments as (name, settings).
COMMANDS: dict[str, tuple[str, list[tuple[str, dict]]]] = {
    "analyze": (
        "score frames, write manifests, pictures and characters",
        [("frames", {}), ("out", {}), ("--fps", {"type": float, "default": 5.0}), ("--cols", {"type": int, "default": 120}), ("--sensitivity", {"type": float, "default": 0.06}), ("--cut-threshold", {"type": float, "default": 0.5}), ("--max-frames", {"type": int}), ("--edge", {"action": "store_true"})],
    ),
    "index": ("build an index from a table of frames", [("frames", {}), ("out", {}), ("--cursor", {"help": "table of rec, t, x, y"}), ("--narration", {"help": "table of rec, n, start, end, text"})]),
    "capture": ("record a device into a table of frames", [("out", {}), ("--device", {"required": True, "help": "module:function of the frame's number"}), ("--seconds", {"type": float, "default": 5.0}), ("--fps", {"type": float, "default": 10.0})]),
    "info": ("summaries", [("index", {}), ("--json", {"action": "store_true"})]),
    "search": ("find states", [("index", {}), ("pattern", {"nargs": "?"}), ("--since", {"type": float}), ("--until", {"type": float}), ("--event", {}), ("--json", {"action": "store_true"})]),
    "transcript": ("render an index", [("index", {}), ("-o", {"dest": "out"}), ("--format", {"choices": sorted(tools.views.FORMATTERS), "default": "md"})]),
    "eval": (
        "cost of an index, or accuracy on questions with --qa",
        [("index", {}), ("--qa", {}), ("--view", {"choices": ["compact", "transcript"], "default": "compact"}), ("--answerer", {"default": "mock"}), ("--fps", {"type": float, "default": 2.0}), ("--frames", {"type": int, "default": 8}), ("--escalate", {"type": int, "default": 3}), ("--tokens-per-image", {"type": int, "default": 1500})],
    ),
    "convert": ("question rows to items", [("rows", {}), ("out", {}), ("--domain", {"choices": ["desktop", "mobile", "all"], "default": "desktop"}), ("--limit", {"type": int})]),
    "guide": ("install or check the guide for agents", [("folder", {}), ("--check", {"action": "store_true"})]),
    "serve": ("tool server over standard input and output", []),
}


def log(quiet: bool, message: str) -> None:
    """Progress goes to standard error, so that results can be piped."""
    if not quiet:
        print(message, file=sys.stderr, flush=True)


def say(text: str) -> None:
    """A result, whatever letters the terminal was set up for."""
    try:
        print(text)
    except UnicodeEncodeError:
        sys.stdout.buffer.write(f"{text}\n".encode())


def table(rows: list[list[str]]) -> str:
    """A line a row, of the cells that have something."""
    return "\n".join(" ".join(c for c in cells if c) for cells in rows)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="uistrata")
    p.add_argument("-q", "--quiet", action="store_true", help="no progress")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name, (about, arguments) in COMMANDS.items():
        c = sub.add_parser(name, help=about)
        for argument, settings in arguments:
            c.add_argument(argument, **settings)
        for f in fields(recording.Options) if name == "index" else ():
            if f.name in ABOUT:
                flag = f"--{f.name.replace('_', '-')}"
                if f.default is False:
                    c.add_argument(flag, action="store_true", help=ABOUT[f.name])
                else:
                    c.add_argument(flag, type=int if f.default is None else type(f.default), help=ABOUT[f.name])
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.cmd == "guide":
        say(tools.guide_status(args.folder) if args.check else tools.install_guide(args.folder))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("uistrata").getOrCreate()
    try:
        for line in RUN[args.cmd](args, spark):
            say(line)
    except (ValueError, FileNotFoundError, RuntimeError) as e:
        p.error(str(e))
    return 0


def _analyze(args, spark):
    done = tools.analyze(spark, args.frames, args.out, args.fps, args.cols, args.sensitivity, args.cut_threshold, args.max_frames, args.edge)
    log(args.quiet, f"analyze: {len(done['recordings'])} recordings")
    yield f"manifests: {done['manifest_path']}"


def _index(args, spark):
    given = {f.name: getattr(args, f.name) for f in fields(recording.Options) if hasattr(args, f.name)}
    tables = [spark.read.parquet(path) if path else None for path in (args.cursor, args.narration)]
    done = tools.build_index(spark, args.frames, args.out, tools.with_defaults(recording.Options(), **given), *tables)
    for hint in done["hints"]:
        log(args.quiet, f"index: {hint}")
    yield f"index: {done['index_path']}"


def _capture(args, spark):
    done = tools.capture(spark, args.out, args.device, args.seconds, args.fps)
    yield f"frames: {done['frames_path']} ({done['frames']})"


def _info(args, spark):
    found = tools.info(spark, args.index)
    yield tools.shown(found) if args.json else "\n\n".join(table([[f"{k}:", str(v)] for k, v in s.items()]) for s in found)


def _search(args, spark):
    hits = tools.search(spark, args.index, args.pattern, args.since, args.until, args.event)
    if args.json:
        yield tools.shown(hits)
        return
    rows = [[h["video"], "state", f"{h['idx']} ", f"{h['t_start']:.1f}-{h['t_end']:.1f}s", f"[{h['event']}]" if h["event"] else "", "; ".join(h["matches"])] for h in hits]
    if rows:
        yield table(rows)
    log(args.quiet, f"# {len(hits)} state(s)")


def _transcript(args, spark):
    if args.out:
        tools.documents.write_transcripts(tools.views.render(tools.load(spark, args.index), args.format), args.out)
        yield f"transcripts: {args.out}"
    else:
        found = tools.transcript(spark, args.index, args.format)
        yield from (found[v] for v in sorted(found))


def _eval(args, spark):
    if not args.qa:
        yield tools.shown(tools.cost(spark, args.index, args.fps, args.escalate, args.tokens_per_image))
        return
    done = tools.evaluate(spark, args.qa, args.index, args.view, args.answerer, args.fps, args.frames, args.tokens_per_image)
    yield from [*done["table"], "", f"answerer: {done['answerer']}"]
    if done["skipped"]:
        log(args.quiet, table([["skipped", s["clip"] + ":", s["reason"]] for s in done["skipped"]]))


def _convert(args, spark):
    done = tools.convert(spark, args.rows, args.out, args.domain, args.limit)
    log(args.quiet, f"wrote {done['emitted']} items to {args.out}, skipped {done['skipped']}")
    yield from ()


def _serve(args, spark):
    tools.server(spark).run()
    yield from ()


RUN = {"analyze": _analyze, "index": _index, "capture": _capture, "info": _info, "search": _search, "transcript": _transcript, "eval": _eval, "convert": _convert, "serve": _serve}


if __name__ == "__main__":
    sys.exit(main())
