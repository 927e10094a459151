"""Configurations: inheritance, deep merge and overrides."""

from __future__ import annotations

from collections.abc import Callable, Mapping


def merged(base: Mapping, over: Mapping) -> dict:
    """Dictionaries are merged key by key, everything else (lists too) is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def resolved(name: str, load: Callable[[str], Mapping], seen: tuple[str, ...] = ()) -> dict:
    """A configuration on top of those that its `extends` names."""
    if name in seen:
        raise ValueError(f"{name} extends itself")
    own = dict(load(name))
    parents = own.pop("extends", [])
    out: dict = {}
    for p in [parents] if isinstance(parents, str) else parents:
        out = merged(out, resolved(p, load, (*seen, name)))
    return merged(out, own)


def scalar(text: str):
    """A value as written: true, false, null, whole number, number or text."""
    fixed = {"true": True, "false": False, "null": None, "none": None}
    if text.lower() in fixed:
        return fixed[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def overridden(config: Mapping, *changes: str) -> dict:
    """Changes like `a.b=v`."""
    out = merged({}, config)
    for change in changes:
        path, _, value = change.partition("=")
        at = out
        *inner, last = path.split(".")
        for k in inner:
            at[k] = dict(at.get(k) or {})
            at = at[k]
        at[last] = scalar(value)
    return out
