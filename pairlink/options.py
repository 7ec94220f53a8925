"""Process-wide options: get, set, reset, describe, and a context manager."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any


@dataclass
class _Option:
    default: Any
    doc: str
    valid: Callable[[Any], bool]
    value: Any = None

    def __post_init__(self) -> None:
        self.value = self.default


_KEYS: dict[str, _Option] = {
    "indexing.pairs": _Option("multiindex", "Form of candidate pairs; 'multiindex' is the pair table.", lambda v: v in ("multiindex", "multiindexobject")),
    "indexing.pairs_suffixes": _Option(("_1", "_2"), "Suffixes of the pair columns when both ids have one name.", lambda v: isinstance(v, tuple) and len(v) == 2 and v[0] != v[1]),
    "classification.return_type": _Option("index", "What classifiers return: 'index' (links), 'series' (labelled pairs) or 'array' (local 0/1 values).", lambda v: v in ("index", "series", "array")),
}


def _find(key: str) -> str:
    hits = [k for k in _KEYS if k == key] or [k for k in _KEYS if key in k]
    if len(hits) != 1:
        raise KeyError(f"no such option, or not only one: {key!r}")
    return hits[0]


def get_option(key: str) -> Any:
    return _KEYS[_find(key)].value


def set_option(*args: Any) -> None:
    """``set_option(key, value, key, value, ...)``."""
    if not args or len(args) % 2:
        raise ValueError("set_option takes pairs of a key and a value")
    for key, value in zip(args[::2], args[1::2]):
        option = _KEYS[_find(key)]
        if not option.valid(value):
            raise ValueError(f"{value!r} is no value of {_find(key)}")
        option.value = value


def reset_option(key: str) -> None:
    for k in list(_KEYS) if key == "all" else [_find(key)]:
        _KEYS[k].value = _KEYS[k].default


def describe_option(key: str = "") -> str:
    return "\n".join(f"{k} : {o.doc} [default: {o.default}] [currently: {o.value}]" for k, o in _KEYS.items() if key in k)


@contextmanager
def option_context(*args: Any) -> Iterator[None]:
    old = [(k, get_option(k)) for k in args[::2]]
    set_option(*args)
    try:
        yield
    finally:
        for k, v in old:
            set_option(k, v)


class _Namespace:
    """Attribute access: ``options.classification.return_type``."""

    def __init__(self, prefix: str = ""):
        object.__setattr__(self, "_prefix", prefix)

    def __getattr__(self, name: str) -> Any:
        key = f"{self._prefix}{name}"
        if key in _KEYS:
            return get_option(key)
        if any(k.startswith(key + ".") for k in _KEYS):
            return _Namespace(key + ".")
        raise AttributeError(key)

    def __setattr__(self, name: str, value: Any) -> None:
        set_option(f"{self._prefix}{name}", value)


options = _Namespace()
