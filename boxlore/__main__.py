"""``python -m boxlore evaluate|fuse|submit|split|infer|package|approve|check``: the operators over files.

Predictions are one JSON object in a file that ends in ``.json``, else a folder that holds a table; every command reads both.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="boxlore")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate", help="accuracy and mean overlap of predictions")
    e.add_argument("items")
    e.add_argument("predictions")
    f = sub.add_parser("fuse", help="weighted fusion of prediction files")
    f.add_argument("predictions", nargs="+")
    f.add_argument("--weights", type=float, nargs="+")
    f.add_argument("--threshold", type=float, default=0.55)
    f.add_argument("--out", required=True)
    s = sub.add_parser("submit", help="an archive for a template")
    s.add_argument("template")
    s.add_argument("predictions")
    s.add_argument("--allow-fallback", action="store_true")
    s.add_argument("--out", required=True)
    b = sub.add_parser("split", help="train and val indexes from folders")
    b.add_argument("root")
    b.add_argument("--test-hashes", required=True)
    b.add_argument("--ratio", type=float, default=0.8)
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--out", required=True)
    i = sub.add_parser("infer", help="predictions of an adapter, saved in steps, by shards if asked; a stopped run goes on")
    i.add_argument("items")
    i.add_argument("--adapter", default="stand-in")
    i.add_argument("--module", help="a module that registers the adapter; executors must be able to import it")
    i.add_argument("--folder", required=True, help="where the run's steps are saved")
    i.add_argument("--shards", type=int, default=1)
    i.add_argument("--step", type=int, default=100)
    i.add_argument("--limit", type=int, default=0)
    i.add_argument("--out", required=True)
    k = sub.add_parser("package", help="an approved artifact from generated queries and a split's index")
    k.add_argument("generation")
    k.add_argument("index", help="a split's index as one JSON object, as a table, or the folder of tables that split writes")
    k.add_argument("--split", required=True, choices=("train", "val"))
    k.add_argument("--run-id", required=True)
    k.add_argument("--prompt-hash", required=True)
    k.add_argument("--key-format", default="auto", choices=("auto", "item_id", "sample_id"))
    k.add_argument("--lenient", action="store_true", help="queries of a broken style are no error")
    k.add_argument("--out", required=True)
    v = sub.add_parser("approve", help="both splits' artifacts, checked against each other and published together, or neither")
    v.add_argument("train", help="the generation of the train split")
    v.add_argument("val", help="the generation of the val split")
    v.add_argument("index", help="the folder of tables that split writes")
    v.add_argument("--run-id", required=True)
    v.add_argument("--prompt-hash", required=True)
    v.add_argument("--manifest", help="the split's manifest, whose hash the artifacts carry")
    v.add_argument("--key-format", default="auto", choices=("auto", "item_id", "sample_id"))
    v.add_argument("--lenient", action="store_true", help="queries of a broken style are reported and are no error")
    v.add_argument("--export", action="append", default=[], help="another folder that gets a copy")
    v.add_argument("--force", action="store_true", help="publish again where something is published")
    v.add_argument("--dry-run", action="store_true", help="check all and write nothing")
    v.add_argument("--out", required=True)
    c = sub.add_parser("check", help="whether what approve published last in a folder is fit to train and validate on")
    c.add_argument("root")
    c.add_argument("--run-id")
    c.add_argument("--lenient", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .functions.hashing import fingerprints, stable_hash
    from .operators import build, contract, evaluate, fusion, inference, package, submission
    from .sinks import commit, writers
    from .sources import readers, settings, state

    spark = SparkSession.builder.appName("boxlore").getOrCreate()
    if a.command == "evaluate":
        row = evaluate.evaluate(readers.inference_items(spark, a.items), readers.predictions(spark, a.predictions)).first()
        print(json.dumps(row.asDict()))
    elif a.command == "fuse":
        weights = a.weights or [1.0] * len(a.predictions)
        if len(weights) != len(a.predictions):
            raise SystemExit("one weight for each file")
        for path in a.predictions:
            settings.distinct_paths(path, a.out)
        writers.save_predictions(fusion.fuse([(readers.predictions(spark, p), w) for p, w in zip(a.predictions, weights)], a.threshold), a.out)
    elif a.command == "infer":
        settings.distinct_paths(a.items, a.out)
        if a.module:
            importlib.import_module(a.module)
        items = readers.inference_items(spark, a.items, a.limit)
        if a.shards > 1:
            found = inference.run_in_shards(items, a.adapter, a.folder, a.shards, a.step)
        else:
            found = inference.run_in_steps(items, a.adapter, a.folder, a.step)
        writers.save_predictions(found, a.out)
        print(json.dumps(inference.summary(found).first().asDict()))
    elif a.command == "package":
        side = f"{a.index.rstrip('/')}/split={a.split}"
        index = readers.inference_items(spark, side if readers.is_folder(spark, side) else a.index).withColumnRenamed("key", "id").drop("pos", "query")
        items = package.refuse(package.from_generation(readers.generation(spark, a.generation), index, a.key_format), a.lenient)
        data = package.with_raw(items).persist()
        prints = fingerprints(data)
        metadata = package.metadata(items, a.split, a.run_id, a.prompt_hash, prints)
        fault = contract.artifact_fault(metadata, data, a.split, a.run_id, strict=not a.lenient, prints=prints)
        if fault:
            raise SystemExit(fault)
        writers.write_artifact(items.drop("pos"), metadata, a.out)
    elif a.command == "approve":
        preparation = None
        if a.manifest:
            with open(a.manifest, encoding="utf-8") as f:
                manifest = json.load(f)
            if state.manifest_fault(manifest):
                raise SystemExit(f"manifest: {state.manifest_fault(manifest)}")
            preparation = stable_hash(manifest)
        both = []
        for split, path in (("train", a.train), ("val", a.val)):
            index = readers.inference_items(spark, f"{a.index.rstrip('/')}/split={split}").withColumnRenamed("key", "id").drop("pos", "query")
            both.append(package.approve(readers.generation(spark, path), index, split, a.run_id, a.prompt_hash, a.key_format, a.lenient, preparation))
        if a.dry_run:
            fault = contract.shared_fault(*((x.metadata, x.data) for x in both))
            if fault:
                raise SystemExit(fault)
        else:
            package.publish(both, a.out, tuple(a.export), a.force)
        print(json.dumps({x.metadata["split"]: x.metadata["qc"] for x in both}))
    elif a.command == "check":
        place = commit.published(spark, a.root)
        fault = contract.training_fault(*(readers.approved(spark, f"{place}/{s}/approved") for s in ("train", "val")), a.run_id, strict=not a.lenient)
        print(json.dumps({"published": place, "fault": fault}))
        return 1 if fault else 0
    elif a.command == "submit":
        items = readers.inference_items(spark, a.template).drop("pos", "bbox", "width", "height")
        print(writers.write_archive(submission.build_submission(items, readers.predictions(spark, a.predictions), allow_fallback=a.allow_fallback), a.out))
    else:
        index, stats = build.build_index(build.candidates(spark, a.root), readers.hash_table(spark, a.test_hashes), a.ratio, a.seed)
        index.write.mode("overwrite").partitionBy("split").parquet(f"{a.out}/index")
        writers.write_json(f"{a.out}/split_manifest.json", build.manifest(index, stats), 1)
    return 0


if __name__ == "__main__":
    sys.exit(main())
