"""Pipeline configuration: inheritance, placeholders and the choice of stages."""

from __future__ import annotations

import json
import re
from collections.abc import Callable


def merge(base: dict, over: dict) -> dict:
    """Deep: dictionaries are united, anything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def resolve(name: str, load: Callable[[str], dict], seen: tuple[str, ...] = ()) -> dict:
    """The configuration of ``name`` over those it names under ``inherits``."""
    if name in seen:
        raise ValueError(f"{' -> '.join((*seen, name))}: inherits itself")
    own = dict(load(name) or {})
    parents = own.pop("inherits", [])
    out: dict = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        out = merge(out, resolve(parent, load, (*seen, name)))
    return merge(out, own)


def render(value, context: dict):
    """``${a.b}`` replaced by what the context has at that path; a text that is one placeholder keeps the value's type."""

    def look(path: str):
        at = context
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                raise KeyError(path)
            at = at[part]
        return render(at, context)

    if isinstance(value, dict):
        return {k: render(v, context) for k, v in value.items()}
    if isinstance(value, list):
        return [render(v, context) for v in value]
    if not isinstance(value, str):
        return value
    if m := re.fullmatch(r"\$\{([^}]+)\}", value):
        return look(m[1])
    return re.sub(r"\$\{([^}]+)\}", lambda m: str(look(m[1])), value)


def choose(stages: list[dict], only: list[str] | None = None, first: str | None = None, last: str | None = None) -> list[dict]:
    """Enabled stages: those of ``only``, or from ``first`` to ``last``."""
    names = [s["name"] for s in stages]
    for name in [*(only or []), *(x for x in (first, last) if x)]:
        if name not in names:
            raise ValueError(f"no stage {name!r}")
    lo, hi = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    return [s for i, s in enumerate(stages) if lo <= i <= hi and s.get("enabled", True) and (not only or s["name"] in only)]


def arguments(options: dict) -> list[str]:
    """Options as a command's arguments: true is a flag, a list is repeated, none and false are left out."""
    out = []
    for key, value in options.items():
        flag = "--" + key.replace("_", "-")
        if value is True:
            out.append(flag)
        elif isinstance(value, list):
            out += [x for v in value for x in (flag, str(v))]
        elif value is not None and value is not False:
            out += [flag, str(value)]
    return out


def run(config: dict, actions: dict[str, Callable[..., object]], dry: bool = False, **choice) -> list[str]:
    """Runs (or with ``dry`` only lists) the chosen stages in order, in one application; a stage's ``action`` names what it calls, with its ``options``."""
    told = []
    for stage in choose(config.get("stages", []), **choice):
        options = render(stage.get("options", {}), config)
        told.append(f"{stage['name']}: {stage['action']} {json.dumps(options, sort_keys=True, default=str)}")
        if not dry:
            actions[stage["action"]](**options)
    return told


def loader(folder: str) -> Callable[[str], dict]:
    """Loads ``name``, ``name.json`` or, if a YAML library is installed, ``name.yaml`` or ``name.yml`` of a folder."""
    from pathlib import Path

    def load(name: str) -> dict:
        base = Path(folder)
        found = next((p for p in (base / name, *(base / f"{name}{end}" for end in (".json", ".yaml", ".yml"))) if p.is_file()), None)
        if found is None:
            raise FileNotFoundError(f"{name} in {folder}")
        text = found.read_text(encoding="utf-8")
        if found.suffix == ".json":
            return json.loads(text)
        import yaml

        return yaml.safe_load(text)

    return load
