"""A pipeline: named frames and steps in the order they are written; nothing runs until an output is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Pipeline:
    """Receives, processes and emits by name. Each step sees the frames before it; names are assigned once."""

    def __init__(self, name: str):
        self.name = name
        self.frames: dict[str, DataFrame] = {}
        self.edges: list[tuple[tuple[str, ...], str, str]] = []
        self.outputs: dict[str, str] = {}

    def receive(self, name: str, df: DataFrame) -> Pipeline:
        return self._put(name, df, (), "receive")

    def apply(self, inputs: str | tuple[str, ...], step: Callable[..., DataFrame | tuple[DataFrame, ...] | dict[str, DataFrame]], into: str | tuple[str, ...]) -> Pipeline:
        """A step over one or more frames; a step with several outputs names them all."""
        inputs = (inputs,) if isinstance(inputs, str) else inputs
        missing = [i for i in inputs if i not in self.frames]
        if missing:
            raise ValueError(f"{self.name}: no frame named {', '.join(missing)}")
        got = step(*(self.frames[i] for i in inputs))
        label = getattr(step, "__name__", type(step).__name__)
        if isinstance(into, str):
            return self._put(into, got, inputs, label)
        parts = list(got.values()) if isinstance(got, dict) else list(got)
        if len(parts) != len(into):
            raise ValueError(f"{self.name}: {label} has {len(parts)} outputs, {len(into)} names are given")
        for n, df in zip(into, parts):
            self._put(n, df, inputs, label)
        return self

    def emit(self, frame: str, target: str) -> Pipeline:
        if frame not in self.frames:
            raise ValueError(f"{self.name}: no frame named {frame}")
        self.outputs[target] = frame
        self.edges.append(((frame,), "emit", target))
        return self

    def _put(self, name: str, df: DataFrame, inputs: tuple[str, ...], label: str) -> Pipeline:
        if name in self.frames:
            raise ValueError(f"{self.name}: {name} is there already")
        self.frames[name] = df
        self.edges.append((inputs, label, name))
        return self

    def output(self, target: str) -> DataFrame:
        return self.frames[self.outputs[target]]

    def graph(self) -> dict[str, list]:
        """Nodes and edges, for drawing."""
        return {"nodes": [*self.frames, *self.outputs], "edges": [{"from": list(i), "step": s, "to": o} for i, s, o in self.edges]}
