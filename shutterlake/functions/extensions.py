"""Extensions: registered processors and an event bus."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass
class Processor:
    """An image operator with default parameters; process takes a flat array, width, height and parameters."""

    name: str
    process: Callable[[np.ndarray, dict], np.ndarray]
    defaults: dict = field(default_factory=dict)
    supports_batch: bool = True

    def checked(self, params: dict) -> dict:
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        return self.defaults | params

    def apply(self, images: DataFrame, **params) -> DataFrame:
        """images: (pixels binary, width, height), 3 bytes a pixel; pixels are processed by Arrow batches."""
        wanted, process = self.checked(params), self.process

        @F.pandas_udf("binary")
        def run(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
            return pd.Series([process(np.frombuffer(p, np.uint8).reshape(h, w, 3), wanted).tobytes() for p, w, h in zip(pixels, width, height)])

        return images.withColumn("pixels", run("pixels", "width", "height"))


class Extensions:
    def __init__(self):
        self.processors: dict[str, Processor] = {}
        self.active: set[str] = set()

    def register(self, processor: Processor) -> None:
        self.processors[processor.name] = processor

    def activate(self, name: str) -> None:
        if name not in self.processors:
            raise KeyError(name)
        self.active.add(name)

    def deactivate(self, name: str) -> None:
        self.active.discard(name)

    @staticmethod
    def discover(*roots: str) -> list[dict]:
        """Manifests plugin.json one level below the roots; broken ones are left out."""
        found = []
        for root in roots:
            for path in sorted(Path(root).glob("*/plugin.json")):
                try:
                    found.append(json.loads(path.read_text()) | {"path": str(path.parent)})
                except (ValueError, TypeError):
                    continue
        return found


class EventBus:
    """Handlers by event; an error of one handler does not stop the others."""

    def __init__(self):
        self.handlers: dict[str, list[tuple[Callable, bool]]] = defaultdict(list)
        self.errors: list[Exception] = []

    def on(self, event: str, handler: Callable, once: bool = False) -> None:
        self.handlers[event].append((handler, once))

    def off(self, event: str, handler: Callable) -> None:
        self.handlers[event] = [h for h in self.handlers[event] if h[0] is not handler]

    def emit(self, event: str, *args) -> None:
        for handler, once in list(self.handlers[event]):
            if once:
                self.off(event, handler)
            try:
                handler(*args)
            except Exception as error:
                self.errors.append(error)
