"""python -m sightline <command>: the engine from the command line, or through spark-submit on a cluster."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from sightline.config import TASKS, load_config
from sightline.plans.encoders import hash_encoder, load_encoder
from sightline.plans.engine import Engine
from sightline.session import session

COMMANDS = {
    "inventory": "files of each family in a corpus", "extract": "unpack a corpus's archives and count what was written", "validate": "whether keyframes, vectors and media info fit together",
    "build-index": "write the index of a corpus", "parse": "what the rules read out of a text", "query": "answers to one text", "run": "submission files for a folder of queries",
    "review": "frames to look at for a folder of queries", "devset": "draw segments to label", "evaluate": "scores of a labelled set", "evaluate-review": "what reviewers would see of a labelled set's truths",
    "check-submission": "rules that submission files break", "submit-selftest": "write, pack and read back a made-up submission",
}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sightline")
    parser.add_argument("--config", help="JSON file of settings")
    sub = parser.add_subparsers(dest="command", required=True)
    p = {name: sub.add_parser(name, help=what) for name, what in COMMANDS.items()}
    for name in ("inventory", "validate", "extract", "build-index", "devset"):
        p[name].add_argument("root")
    for name in ("extract", "build-index", "devset", "submit-selftest"):
        p[name].add_argument("out")
    p["build-index"].add_argument("--only", choices=["all", "dense", "shots", "text"], default="all")
    p["parse"].add_argument("text")
    for name in ("query", "review", "run", "evaluate", "evaluate-review"):
        p[name].add_argument("index")
        p[name].add_argument("--encoder", help="model of the image space's text tower")
        p[name].add_argument("--multilingual", help="model of a second tower that reads the query's own language")
        p[name].add_argument("--stub-encoder", type=int, metavar="DIM", help="meaningless hash vectors of this length instead")
    p["query"].add_argument("text")
    p["query"].add_argument("--top", type=int, default=20)
    for name in ("review", "run", "evaluate", "evaluate-review"):
        p[name].add_argument("queries", help="folder of query-<id>-<task>.txt, or for evaluate a labelled set")
        p[name].add_argument("--out", default="out")
    for task, n in zip(TASKS, (10, 5, 5), strict=True):
        p["devset"].add_argument(f"--{task}", type=int, default=n)
    p["devset"].add_argument("--seed", type=int, default=2026)
    for name in ("validate", "inventory"):
        p[name].add_argument("--report", help="JSON file to write")
    p["check-submission"].add_argument("folder")
    return parser


def _report(path: str | None, **parts) -> None:
    """Small results as one JSON file."""
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps({k: [r.asDict() for r in df.collect()] for k, df in parts.items()}, ensure_ascii=False, indent=1, default=str), encoding="utf-8")


def validate(spark, root: str, report: str | None) -> int:
    """Frame convention, grid, gaps, counts, shapes and lengths of vectors, missing files; 1 if something blocks an index."""
    from sightline.operators import shots
    from sightline.sources import corpus

    k, v, m = corpus.read_keyframes(spark, root).cache(), corpus.read_vectors(spark, root).cache(), corpus.read_media(spark, root)
    videos = k.select("video_id").distinct()
    parts = {
        "convention": shots.check_convention(k).where("floor <> keyframes or rates > 1 or backward > 0"), "vectors": corpus.check_vectors(v, k), "malformed": videos.where("not video_id rlike '^L[0-9]+_V[0-9]+$'"),
        "grid": shots.grid_alignment(k), "gaps": shots.gap_stats(k), "window": shots.window_hit_rate(k), "shapes": shots.vector_shapes(v),
        "without_media": videos.join(m.select("video_id"), "video_id", "left_anti"), "without_vectors": videos.join(v.select("video_id"), "video_id", "left_anti"),
    }
    for name, df in parts.items():
        print(name)
        df.show(truncate=False)
    _report(report, **parts)
    passed = all(parts[name].isEmpty() for name in ("convention", "vectors", "malformed", "without_vectors")) and parts["shapes"].count() <= 1
    print("PASS" if passed else "FAIL")
    return int(not passed)


def selftest(spark, out: str) -> int:
    """A made-up list of every task written, packed and read back without change."""
    from sightline.sources import submissions

    kinds = "query_id string, task string, rank int, video_id string, frame int, frames array<int>, answer string, n_moments int"
    rows = [("a-1", "kis", k, "L21_V001", 10 * k, None, None, None) for k in range(1, 101)]
    rows += [("b", "qa", k, "L21_V002", k, None, f'năm, "{k}"', None) for k in range(1, 4)] + [("c", "trake", k, "L22_V001", None, [k, k + 5, k + 9], None, 3) for k in range(1, 3)]
    files = submissions.write(spark.createDataFrame(rows, kinds), out)
    archive = submissions.package(files, str(Path(out) / "submission.zip"))
    back, problems = submissions.read_back(spark, out)
    same = sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    print(f"{len(files)} files, {archive}: {'the same when read back' if same and problems.isEmpty() else 'CHANGED'}")
    return int(not (same and problems.isEmpty()))


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(message)s")
    if a.command == "parse":
        from sightline.plans.parse import parse

        print(json.dumps(parse(a.text), ensure_ascii=False, indent=1))
        return 0
    spark = session()
    from sightline.operators import devset, scoring
    from sightline.sources import corpus, submissions

    if a.command == "inventory":
        found = corpus.inventory(spark, a.root)
        found.show(truncate=False)
        _report(a.report, inventory=found)
    elif a.command == "extract":
        done = corpus.extract(spark, a.root, a.out).cache()
        done.show(truncate=False)
        return int(not done.where("not complete").isEmpty())
    elif a.command == "validate":
        return validate(spark, a.root, a.report)
    elif a.command == "build-index":
        Engine.build(spark, a.root, a.out, a.only)
    elif a.command == "devset":
        drawn = devset.sample_targets(corpus.read_keyframes(spark, a.root), {t: getattr(a, t) for t in TASKS}, a.seed)
        queries, truths, told = corpus.devset_template(drawn)
        corpus.write_devset(f"{a.out}/devset.json", queries, truths, {"about": "watch first, then write the query"})
        (Path(a.out) / "instructions.txt").write_text("\n".join(told), encoding="utf-8")
        devset.coverage_report(truths).show()
    elif a.command == "check-submission":
        answers, problems = submissions.read_back(spark, a.folder)
        found = scoring.issues(answers)
        problems.show(truncate=False)
        found.show(100, truncate=False)
        return int(not (problems.isEmpty() and found.where("severity = 'error'").isEmpty()))
    elif a.command == "submit-selftest":
        return selftest(spark, a.out)
    else:
        return _ask(spark, a)
    return 0


def _ask(spark, a) -> int:
    """The commands that need a loaded engine."""
    from sightline.sources import corpus

    towers = {"encoder": hash_encoder(a.stub_encoder)} if a.stub_encoder else {k: load_encoder(m) for k in ("encoder", "multilingual") if (m := getattr(a, k))}
    engine = Engine.load(spark, a.index, load_config(a.config), **towers)
    if a.command == "query":
        engine.solve(spark.createDataFrame([("q", a.text)], "query_id string, raw string")).orderBy("rank").show(a.top, truncate=False)
    elif a.command in ("evaluate", "evaluate-review"):
        each, summary = (engine.evaluate if a.command == "evaluate" else engine.evaluate_review)(*corpus.read_devset(spark, a.queries))
        _report(f"{a.out}/{a.command.replace('-', '_')}.json", queries=each, summary=summary)
        summary.show(truncate=False)
    else:
        queries = corpus.read_query_files(spark, a.queries).select("query_id", "raw")
        if a.command == "review":
            engine.review(queries).orderBy("query_id", "scan").show(1000, truncate=False)
        elif a.stub_encoder:
            print("a stand-in encoder must not write submissions", file=sys.stderr)
            return 2
        else:
            print(*engine.write(engine.solve(queries), a.out), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
