"""Operators by kind and type, and methods with their aliases."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

KINDS = ("source", "transform", "vectorizer", "sink")
_made: dict[tuple[str, str], Callable] = {}
_aliases = {"sbert": "sentence-transformers", "sklearn": "scikit-learn", "voyage": "voyageai", "timm": "pytorch-image-models"}


def canonical(name: str) -> str:
    name = name.lower().replace("_", "-")
    return _aliases.get(name, name)


def register(kind: str, name: str) -> Callable:
    """Decorator: ``name`` of ``kind`` is made by this function."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(KINDS)}")

    def own(fn: Callable) -> Callable:
        _made[kind, canonical(name)] = fn
        return fn

    return own


def make_operator(kind: str, name: str, lazy: bool = False, runner: str | Callable | None = None, task_params: dict | None = None, **params: object):
    """The operator, made at once or when it is first called; an unknown one is an error right here.

    ``runner`` is "local" (at once), "lazy", or a class of the caller's that is given the maker and its parameters; ``task_params`` are parameters, too.
    """
    import vectide.operators.builtin  # noqa: F401  registers what the engine brings along
    from vectide.plans.workflow import Runner

    if kind.rstrip("s") not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(KINDS)}")
    fn = _made.get((kind.rstrip("s"), canonical(name)))
    if fn is None:
        raise ValueError(f"no {kind} is named {name!r}; there are {', '.join(sorted(n for k, n in _made if k == kind.rstrip('s')))}")
    params = {**(task_params or {}), **params}
    if callable(runner):
        return runner(partial(fn), **params)
    if runner not in (None, "local", "lazy"):
        raise ValueError(f"unknown runner {runner!r}; there are local, lazy")
    return Runner(partial(fn), lazy=lazy or runner == "lazy", **params)


def registered() -> list[tuple[str, str]]:
    import vectide.operators.builtin  # noqa: F401

    return sorted(_made)
