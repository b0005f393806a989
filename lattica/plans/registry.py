"""Named, versioned steps, and DataFrames built from JSON-like specs of them.

A spec is {"@type": name, "@version": v, argument: value, ...}; values may be
specs themselves, which are built first.  There is no expression language: only
registered functions are called.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_STEPS: dict[str, dict[str, Callable]] = {}


def register(name: str, version: str = "1"):
    def keep(f: Callable) -> Callable:
        versions = _STEPS.setdefault(name, {})
        if version in versions:
            raise ValueError(f"{name} {version} is registered already")
        versions[version] = f
        return f

    return keep


def lookup(name: str, version: str | None = None) -> Callable:
    versions = _STEPS.get(name)
    if not versions or (version is not None and version not in versions):
        raise KeyError(f"no step {name}" + (f" {version}" if version else ""))
    return versions[version or max(versions, key=lambda v: tuple(map(int, v.split("."))))]


def build(spec: Any, **context: Any) -> Any:
    """The value of a spec; ``context`` (such as spark) is passed to steps that take it."""
    if isinstance(spec, list):
        return [build(s, **context) for s in spec]
    if not isinstance(spec, dict):
        return spec
    values = {k: build(v, **context) for k, v in spec.items() if not k.startswith("@")}
    if "@type" not in spec:
        return values
    step = lookup(spec["@type"], spec.get("@version"))
    wanted = step.__code__.co_varnames[: step.__code__.co_argcount]
    call = lambda **more: step(**{k: v for k, v in context.items() if k in wanted and k not in values}, **values, **more)
    return call if spec.get("@mode") == "partial" else call()
