"""Run settings: YAML files, prompt files, precedence of options, paths. Small things that the driver reads itself."""

from __future__ import annotations

import re
from pathlib import Path

SECTIONS = ("run", "hyperparameters")
SYSTEM, USER = "[system]", "[user]"


def _scalar(text: str):
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~"):
        return None
    if re.fullmatch(r"[-+]?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+][0-9]+)?", text):  # as YAML has it, 1e-4 is no number
        return float(text)
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _plain(path: str) -> dict:
    """A file of flat sections of scalars: what is read without a YAML parser. Anything else is an error, not a guess."""
    out: dict = {}
    section = None
    for number, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        quoted = re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: "q" * len(m[0]), line)  # a # in quotes is no comment
        at = re.search(r"(?:^|\s)#", quoted)
        body = line[: at.start()].rstrip() if at else line.rstrip()
        if not body.strip():
            continue
        name, colon, value = body.strip().partition(":")
        value = value.strip()
        if not colon or value[:1] in ("[", "{", "|", ">", "&", "*", "!") or body.strip().startswith("- "):
            raise ValueError(f"{path}:{number}: only flat sections of scalars are read without a YAML parser")
        if body[0] not in " \t":
            section = out[name] = _scalar(value) if value else {}
        elif not isinstance(section, dict):
            raise ValueError(f"{path}:{number}: outside a section")
        else:
            section[name.strip()] = _scalar(value)
    return out


def load_config(path: str) -> dict[str, dict]:
    """The two sections of a settings file, each a mapping; any other section or shape is an error.

    The whole of YAML is read where its parser is installed, flat sections of scalars otherwise.
    """
    try:
        import yaml
    except ImportError:
        held = _plain(path)
    else:
        held = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(held, dict) or not set(held) <= set(SECTIONS):
        raise ValueError(f"{path}: a mapping of the sections {SECTIONS} is wanted")
    out = {name: held.get(name) or {} for name in SECTIONS}
    if not all(isinstance(v, dict) for v in out.values()):
        raise ValueError(f"{path}: a section is a mapping")
    return out


def merge_options(defaults: dict, config: dict, given: dict) -> dict:
    """Defaults, then the file's, then the command line's; an option that has no default is an error."""
    unknown = sorted((set(config) | set(given)) - set(defaults))
    if unknown:
        raise ValueError(f"unknown options: {unknown}")
    return {**defaults, **config, **{k: v for k, v in given.items() if v is not None}}


def check_options(options: dict, rules: dict) -> None:
    """rules: option to (type, least, greatest, choices); a bool is no number."""
    for name, (kind, low, high, choices) in rules.items():
        v = options.get(name)
        if v is None:
            continue
        if isinstance(v, bool) is not (kind is bool) or not isinstance(v, (int, float) if kind is float else kind):
            raise ValueError(f"{name} must be a {kind.__name__}")
        if low is not None and v < low or high is not None and v > high:
            raise ValueError(f"{name} is out of range")
        if choices and v not in choices:
            raise ValueError(f"{name} must be one of {choices}")
    if options.get("min_pixels") and options.get("max_pixels") and options["max_pixels"] <= options["min_pixels"]:
        raise ValueError("max_pixels must exceed min_pixels")


def load_prompt(path: str) -> tuple[str, str]:
    """The system and user part of a prompt file, both not empty."""
    text = Path(path).read_text(encoding="utf-8").strip()
    if not text.startswith(SYSTEM) or USER not in text:
        raise ValueError(f"{path}: a prompt has {SYSTEM}, then {USER}")
    system, _, user = text[len(SYSTEM) :].partition(USER)
    if not system.strip() or not user.strip():
        raise ValueError(f"{path}: an empty part")
    return system.strip(), user.strip()


def active_dataset(root: str, split: str, given: str | None = None) -> str:
    """The dataset given, else the annotated one of the split, else the plain one; none is an error."""
    places = [given] if given else [f"{root}/outputs/annotations/{split}.json", f"{root}/outputs/{split}.json"]
    for place in places:
        if Path(place).is_file():
            return place
    raise FileNotFoundError(f"no dataset for {split}: {places}")


def from_root(root: str, path: str) -> str:
    return path if Path(path).is_absolute() else str(Path(root) / path)


def distinct_paths(source: str, target: str) -> None:
    """Refuses to overwrite a source in place."""
    if Path(source).resolve() == Path(target).resolve():
        raise ValueError(f"would overwrite {source}")


def adapter_targets(*parts: str) -> str:
    """A pattern of the language model's projection layers that an adapter is put on."""
    return rf"^(?!.*visual).*\.(?:{'|'.join(parts)})$"
