"""States of training and inference runs: which rule a record breaks first, or None. Small records that the driver holds."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable
from pathlib import Path

from ..functions.hashing import key_hash, run_id, stable_hash

# ---- fixed values: fields of the records, in order, and protocol numbers ----
TRAINING_FIELDS = (
    "protocol_version", "training_run_id", "annotation_run_id", "train_dataset_fingerprint", "val_dataset_fingerprint", "train_image_fingerprint", "val_image_fingerprint",
    "annotation_prompt_hash", "model_name", "model_revision", "grounding_prompt_hash", "hyperparameters", "seed", "run_tag", "train_samples", "val_samples",
)
RUN_FIELDS = (
    "version", "python_version", "run_id", "mode", "split", "annotation_run_id", "model", "model_revision", "lora_path", "adapter_fingerprint", "prompt_hash", "generation_config",
    "compute_dtype", "min_pixels", "max_pixels", "run_tag", "limit", "selected_key_hash", "input_fingerprint", "image_fingerprint", "num_shards", "base_run_id", "base_prediction_fingerprint",
)
TRAINING_PROTOCOL, CHECKPOINT_VERSION, ANNOTATION_PROTOCOL = 2, 5, 13
WEIGHT_FILES = ("adapter_model.safetensors", "adapter_model.bin")
COMPLETED = ("metadata", "status", "global_step", "best_val_loss", "best_path", "last_path", "best_metric", "best_metric_value")
EPOCH_STATE = ("metadata", "completed_epoch", "global_step", "best_val_loss", "best_path", "train_loss", "val_loss", "best_metric", "best_metric_value", "epoch_metrics")
BINARY = ("optimizer", "scheduler", "torch_rng_state", "cuda_rng_state", "completed_epoch", "global_step", "training_run_id")

Rules = Iterable[tuple[str, bool]]


def first_broken(rules: Rules) -> str | None:
    return next((name for name, kept in rules if not kept), None)


def whole(v: object, least: int | None = None, most: int | None = None) -> bool:
    """An integer that is no bool, within bounds."""
    return isinstance(v, int) and not isinstance(v, bool) and (least is None or v >= least) and (most is None or v <= most)


def finite(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


def named(v: object) -> bool:
    return isinstance(v, str) and bool(v)


def _matches(pattern: str, v: object) -> bool:
    return bool(re.fullmatch(pattern, v if isinstance(v, str) else ""))


def is_run_id(v: object) -> bool:
    return _matches(r"[A-Za-z0-9_.-]+", v)


def annotation_hash() -> str:
    return stable_hash({"protocol_version": ANNOTATION_PROTOCOL})


def common_run_id(tags: list[str]) -> str:
    """One name for the runs of both splits: their tag without the split's token if it is the same, else the first tag."""
    cut = {re.sub(r"[-_](train|val)([-_]|$)", r"\2", t) for t in tags}
    return f"annot_{cut.pop() if len(cut) == 1 and '' not in cut else tags[0]}"


def runtime_packages(pinned: list[str]) -> list[str]:
    """The pinned ``name==version`` list with the versions that are installed."""
    from importlib import metadata

    out = []
    for p in pinned:
        name, equal, _ = p.partition("==")
        try:
            out.append(f"{name}=={metadata.version(name)}" if equal else p)
        except metadata.PackageNotFoundError:
            out.append(p)
    return out


def run_metadata(identity: dict, mode: str, split: str, annotation_run: str | None, python_version: str) -> dict:
    """An inference run's record. A run over train or val names its annotation run, one over the test set must not."""
    if split in ("train", "val") and not is_run_id(annotation_run):
        raise ValueError("train and val need an annotation run id")
    if split == "test" and annotation_run:
        raise ValueError("the test set has no annotation run")
    identity = {"mode": mode, "split": split, "annotation_run_id": annotation_run, **identity}
    out = {"version": CHECKPOINT_VERSION, "python_version": python_version, "run_id": run_id(identity, retry=mode == "retry"), **identity}
    if set(out) != set(RUN_FIELDS):
        raise ValueError(f"fields differ: {sorted(set(out) ^ set(RUN_FIELDS))}")
    return {f: out[f] for f in RUN_FIELDS}


def shard_metadata(run: dict, shard: int, keys: list[str]) -> dict:
    return {**run, "shard_id": shard, "assigned_key_hash": key_hash(keys)}


def training_metadata(identity: dict) -> dict:
    """A training run's record, named by what identifies it."""
    rest = {"protocol_version": TRAINING_PROTOCOL, **identity}
    hashed = {**rest, "hyperparameters": {k: v for k, v in rest["hyperparameters"].items() if k != "runtime_packages"}}
    return {f: stable(hashed) if f == "training_run_id" else rest[f] for f in TRAINING_FIELDS}


def stable(identity: dict) -> str:
    return run_id(identity, "train")


def same_identity(actual: dict, expected: dict, left_out: tuple[str, ...] = ("lora_path",)) -> str | None:
    """missing, extra or mismatched field of two records, or None."""
    a, e = ({k: v for k, v in m.items() if k not in left_out} for m in (actual, expected))
    for name in e:
        if name not in a:
            return f"missing {name}"
        if a[name] != e[name]:
            return f"mismatched {name}"
    return next((f"extra {name}" for name in a if name not in e), None)


def metrics_fault(m: object) -> str | None:
    if not isinstance(m, dict) or set(m) != {"hits", "total", "acc_at_0_5", "mean_iou", "failures"}:
        return "schema"
    return first_broken(
        [("counts", whole(m["hits"], 0) and whole(m["total"], 1) and whole(m["failures"], 0) and m["failures"] <= m["total"])]
        + [(f, finite(m[f]) and 0 <= m[f] <= 1) for f in ("acc_at_0_5", "mean_iou")]
    )


def manifest_fault(m: object) -> str | None:
    """Of an adapter's manifest: of an epoch (epoch and val_loss) or of the last one (completed_epochs)."""
    if not isinstance(m, dict):
        return "schema"
    if set(m) == {"metadata", "epoch", "val_loss"}:
        own = [("epoch", whole(m["epoch"], 1)), ("val_loss", finite(m["val_loss"]))]
    elif set(m) == {"metadata", "completed_epochs"}:
        own = [("completed_epochs", whole(m["completed_epochs"], 1))]
    else:
        return "schema"
    d = m["metadata"]
    if not isinstance(d, dict) or set(d) != set(TRAINING_FIELDS):
        return first_broken(own) or "metadata schema"
    texts = ("train_dataset_fingerprint", "val_dataset_fingerprint", "train_image_fingerprint", "val_image_fingerprint", "annotation_prompt_hash", "model_name", "model_revision", "grounding_prompt_hash")
    return first_broken(
        own
        + [("protocol", d["protocol_version"] == TRAINING_PROTOCOL), ("training_run_id", _matches(r"train_[0-9a-f]{16}", d["training_run_id"])), ("annotation_run_id", is_run_id(d["annotation_run_id"]))]
        + [(f, named(d[f])) for f in texts]
        + [("hyperparameters", isinstance(d["hyperparameters"], dict) and bool(d["hyperparameters"])), ("seed", whole(d["seed"])), ("run_tag", isinstance(d["run_tag"], str))]
        + [(f, whole(d[f], 1)) for f in ("train_samples", "val_samples")]
    )


def weight_file(folder: str | Path) -> Path | None:
    """The first of the weight files that is there and not empty."""
    places = (Path(folder) / name for name in WEIGHT_FILES)
    return next((p for p in places if p.is_file() and p.stat().st_size), None)


def expected_steps(metadata: dict, epochs: int, batch: int, accumulate: int) -> int:
    if not whole(metadata.get("train_samples"), 1):
        raise ValueError("train_samples must be positive")
    return epochs * math.ceil(math.ceil(metadata["train_samples"] / batch) / accumulate)


def _full(path: Path) -> bool:
    return path.is_file() and path.stat().st_size > 0


def _load(path: Path) -> dict:
    value = json.loads(path.read_text(encoding="utf-8")) if path.is_file() else None
    return value if isinstance(value, dict) else {}


def adapter_fault(folder: str | Path, run: str | Path, metadata: dict, kind: str, epochs: int) -> str | None:
    """Of an adapter's folder: ``last``, ``best`` (below best/) or ``checkpoint`` (below checkpoints/)."""
    place, root = Path(folder).resolve(), Path(run).resolve()
    if not str(folder) or not place.is_relative_to(root):
        return "outside the run"
    parts = place.relative_to(root).parts
    parent = {"best": "best", "checkpoint": "checkpoints"}.get(kind)
    named_right = parts == ("last",) if kind == "last" else len(parts) == 2 and parts[0] == parent and _matches(r"epoch_\d+", parts[-1])
    m = _load(place / "adapter_manifest.json")
    rules = [("path", named_right), ("folder", place.is_dir()), ("config", _full(place / "adapter_config.json")), ("weights", weight_file(place) is not None), ("manifest", bool(m)), ("metadata", m.get("metadata") == metadata)]
    if kind == "last":
        rules += [("schema", set(m) == {"metadata", "completed_epochs"}), ("completed_epochs", m.get("completed_epochs") == epochs)]
    else:
        epoch = m.get("epoch")
        rules += [("schema", set(m) == {"metadata", "epoch", "val_loss"}), ("epoch", whole(epoch, 1, epochs)), ("epoch of the path", whole(epoch) and parts[-1:] == (f"epoch_{epoch:02d}",)), ("val_loss", finite(m.get("val_loss")))]
    return first_broken(rules)


def completed_fault(state: object, metadata: dict, run: str | Path, batch: int, accumulate: int, epochs: int) -> str | None:
    """Of the state of a run that says it is done."""
    if not isinstance(state, dict) or set(state) != set(COMPLETED):
        return "schema"
    early = first_broken(
        [("metadata or status", state["metadata"] == metadata and state["status"] == "completed"), ("global_step", state["global_step"] == expected_steps(metadata, epochs, batch, accumulate)), ("best_val_loss", finite(state["best_val_loss"]))]
    )
    if early:
        return early
    for kind in ("best", "last"):
        fault = adapter_fault(state[f"{kind}_path"], run, metadata, kind, epochs)
        if fault:
            return f"{kind}: {fault}"
    best = _load(Path(state["best_path"]) / "adapter_manifest.json")
    return first_broken([("best val_loss", best["val_loss"] == state["best_val_loss"]), ("best_metric", named(state["best_metric"])), ("best_metric_value", finite(state["best_metric_value"]))])


def checkpoint_fault(folder: str | Path, run: str | Path, metadata: dict, batch: int, accumulate: int, epochs: int) -> str | None:
    """Of a checkpoint to resume from: ``epoch_N`` or ``step_N`` below the run's checkpoints."""
    place, root = Path(folder).resolve(), (Path(run) / "checkpoints").resolve()
    if not place.is_relative_to(root):
        return "outside the run"
    match = re.fullmatch(r"(epoch|step)_(\d+)", place.relative_to(root).as_posix())
    if not match:
        return "path"
    state = _load(place / "state.json")
    early = first_broken([("adapter", (place / "adapter_config.json").is_file() and weight_file(place) is not None), ("binary state", _full(place / "training_state.pt")), ("metadata", state.get("metadata") == metadata)])
    if early:
        return early
    number = int(match[2])
    if match[1] == "step":
        epoch, per = state.get("completed_epoch"), expected_steps(metadata, 1, batch, accumulate)
        return first_broken([("global_step", state.get("global_step") == number), ("completed_epoch", whole(epoch)), ("batch_index", whole(state.get("batch_index", 0), 0)), ("step of the epoch", whole(epoch) and epoch * per < number <= (epoch + 1) * per)])
    if not 1 <= number <= epochs:
        return "epoch"
    fault = adapter_fault(place, run, metadata, "checkpoint", epochs)
    if fault:
        return f"checkpoint: {fault}"
    if set(state) != set(EPOCH_STATE):
        return "schema"
    early = first_broken(
        [("completed_epoch", state["completed_epoch"] == number), ("global_step", state["global_step"] == expected_steps(metadata, number, batch, accumulate))]
        + [(f, finite(state[f])) for f in ("best_val_loss", "train_loss", "val_loss")]
        + [("epoch_metrics", metrics_fault(state["epoch_metrics"]) is None), ("best_metric", named(state["best_metric"])), ("best_metric_value", finite(state["best_metric_value"]))]
        + [("val_loss of the adapter", _load(place / "adapter_manifest.json")["val_loss"] == state["val_loss"])]
    )
    fault = early or adapter_fault(state["best_path"], run, metadata, "best", epochs)
    if fault:
        return early or f"best: {fault}"
    best = _load(Path(state["best_path"]) / "adapter_manifest.json")
    return None if best["epoch"] <= number and best["val_loss"] == state["best_val_loss"] else "best adapter"


def binary_fault(binary: object, state: dict, metadata: dict) -> str | None:
    """Of the optimizer's state once it is loaded: whether it is this checkpoint's."""
    if not isinstance(binary, dict) or set(binary) != set(BINARY):
        return "schema"
    return first_broken(
        [(f, binary[f] == state[f]) for f in ("completed_epoch", "global_step")]
        + [("training_run_id", binary["training_run_id"] == metadata["training_run_id"]), ("optimizer", isinstance(binary["optimizer"], dict) and isinstance(binary["scheduler"], dict))]
    )


def is_offloaded(device_map: dict) -> bool:
    """Whether a part of a model lies on the processor or a disk, which training refuses."""
    return any(str(d) in ("cpu", "disk") for d in device_map.values())
