"""A workflow is a graph of named steps over DataFrames; it is one lazy plan until a sink runs it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

from vectide.plans import align


class Runner:
    """Holds how a step is made; eager ones make it at once, lazy ones when it is first called."""

    def __init__(self, make: Callable[..., Callable[..., DataFrame]], lazy: bool = False, **params: object):
        self._make, self._params, self._step = make, params, None
        if not lazy:
            self._evaluate()

    def _evaluate(self) -> Callable[..., DataFrame]:
        if self._step is None:
            self._step = self._make(**self._params)
        return self._step

    @property
    def evaluated(self) -> bool:
        return self._step is not None

    def __call__(self, *frames: DataFrame, **overrides: object) -> DataFrame:
        return self._evaluate()(*frames, **overrides)


class Workflow:
    """``add`` steps, then call. Without ``dependencies`` a step follows the one added before; the first is given the seed."""

    def __init__(self) -> None:
        self._steps: dict[str, Callable[..., DataFrame]] = {}
        self._needs: dict[str, tuple[str, ...]] = {}
        self.order: list[str] = []
        self.outputs: dict[str, DataFrame] = {}

    def add(self, step: Callable[..., DataFrame], name: str, dependencies: Sequence[str] | None = None) -> Workflow:
        if name in self._steps:
            raise ValueError(f"there is a step {name!r} already")
        self._needs[name] = tuple(dependencies or ([] if not self._steps else [list(self._steps)[-1]]))
        self._steps[name] = step
        return self

    def compile(self) -> Workflow:
        """Order the steps; a cycle or an unknown dependency is an error."""
        missing = {d for needs in self._needs.values() for d in needs} - self._steps.keys()
        if missing:
            raise ValueError(f"no step is named {', '.join(sorted(missing))}")
        self.order = list(TopologicalSorter(self._needs).static_order())
        self.outputs = {}
        return self

    def __call__(self, seed: DataFrame | None = None, extra_vars: dict[str, dict] | None = None, key: str | None = None) -> DataFrame:
        """The last step's DataFrame. Several dependencies are merged by ``key``, the last one's columns winning, or else given one by one."""
        self.compile()
        for name in self.order:
            frames = [self.outputs[d] for d in self._needs[name]] or ([seed] if seed is not None else [])
            if key is not None and len(frames) > 1:
                frames = [align.merge_last(frames, key)]
            self.outputs[name] = self._steps[name](*frames, **(extra_vars or {}).get(name, {}))
        return self.outputs[self.order[-1]]
