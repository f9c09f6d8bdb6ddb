"""Registries of frame operators: plans that add columns, and plugins that see a frame at a time."""

from __future__ import annotations

import contextlib
import copy
import importlib
import pkgutil
import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How often an operator is tried again, and the wait before, in seconds, times the number of the try.
RETRIES, WAIT = 2, 0.5


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[[DataFrame], DataFrame]
    after: tuple[str, ...] = ()


REGISTRY: dict[str, Operator] = {}


def register(name: str, after: tuple[str, ...] = ()) -> Callable:
    """Adds a function DataFrame -> DataFrame; a later one of the same name replaces the earlier, with a warning."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in REGISTRY:
            warnings.warn(f"operator {name} is registered again", stacklevel=2)
        REGISTRY[name] = Operator(name, f, after)
        return f

    return add


def run(frames: DataFrame, names: list[str]) -> DataFrame:
    """frames with what the named operators add, those first that others come after; an unknown name adds an error column."""
    done: list[str] = []

    def visit(n: str) -> None:
        nonlocal frames
        if n in done:
            return
        done.append(n)
        if n not in REGISTRY:
            frames = frames.withColumn(f"error_{n}", F.lit(f"unknown operator: {n}"))
            return
        for a in REGISTRY[n].after:
            if a in names:
                visit(a)
        frames = REGISTRY[n].run(frames)

    for n in names:
        visit(n)
    return frames


@dataclass(frozen=True)
class Result:
    """What an operator found of a frame: numbers by name, or an error."""

    metrics: dict[str, float]
    error: str | None = None


class FrameOperator:
    """An operator that sees one frame at a time. Its life in a task: initialise once, execute for each frame, clean up."""

    name: str = ""
    #: Columns of the frame that execute() gets, and whether a frame without a mask is left out.
    columns: tuple[str, ...] = ()
    needs_mask: bool = False
    #: Runs after all others, and sees what they found.
    last: bool = False
    filters: tuple[dict, ...] = ()

    def initialise(self, config: dict) -> None: ...

    def execute(self, frame: dict, found: dict[str, float]) -> Result:
        raise NotImplementedError

    def cleanup(self) -> None: ...


OPERATORS: dict[str, FrameOperator] = {}


def add(operator: FrameOperator) -> FrameOperator:
    """Registers an operator by its name; a later one of the same name replaces the earlier, with a warning."""
    if operator.name in OPERATORS:
        warnings.warn(f"operator {operator.name} is registered again", stacklevel=2)
    OPERATORS[operator.name] = operator
    return operator


def discover(package: str) -> list[str]:
    """Imports every module of a package, which registers what it holds; names that are new. A module that fails is left out with a warning."""
    before = set(OPERATORS)
    root = importlib.import_module(package)
    for m in pkgutil.iter_modules(root.__path__, f"{package}."):
        try:
            importlib.import_module(m.name)
        except Exception as e:  # noqa: BLE001  whatever a foreign module raises
            warnings.warn(f"{m.name} is left out: {e}", stacklevel=2)
    return sorted(set(OPERATORS) - before)


def filter_definitions() -> list[dict]:
    return [f for o in OPERATORS.values() for f in o.filters]


def execute(frames: DataFrame, names: list[str], key: str, config: dict | None = None, retries: int = RETRIES, wait: float = WAIT) -> DataFrame:
    """key, metrics (a map), errors (a map by operator): what the named operators find of each frame.

    An operator that raises is tried again; after so many retries its error is the result, and the others go on. An unknown
    name is an error of every frame. Each task initialises its operators once and cleans up at its end, however it ends."""
    chosen = [OPERATORS[n] for n in names if n in OPERATORS]
    chosen.sort(key=lambda o: o.last)
    unknown = {n: f"unknown operator: {n}" for n in names if n not in OPERATORS}
    columns = list(dict.fromkeys(c for o in chosen for c in (*o.columns, *(("mask",) if o.needs_mask else ()))))

    def attempt(o: FrameOperator, frame: dict, found: dict[str, float]) -> Result:
        for k in range(retries + 1):
            try:
                return o.execute(frame, dict(found))
            except Exception as e:  # noqa: BLE001  whatever a plugin raises
                if k == retries:
                    return Result({}, f"failed after {retries} retries: {e}")
                time.sleep(wait * (k + 1))
        raise AssertionError

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [copy.deepcopy(o) for o in chosen]
        broken: dict[str, str] = {}
        for o in own:
            try:
                o.initialise(config or {})
            except Exception as e:  # noqa: BLE001
                broken[o.name] = f"failed to initialise: {e}"
        try:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    found, errors = {}, unknown | broken
                    for o in own:
                        if o.name in broken:
                            continue
                        if o.needs_mask and row.get("mask") is None:
                            errors[o.name] = "no mask"
                            continue
                        r = attempt(o, {c: row[c] for c in (*o.columns, *(("mask",) if o.needs_mask else ()))}, found)
                        found |= {k: float(v) for k, v in r.metrics.items()}
                        if r.error is not None:
                            errors[o.name] = r.error
                    out.append((row[key], found, errors))
                yield pd.DataFrame(out, columns=[key, "metrics", "errors"])
        finally:
            for o in own:
                with contextlib.suppress(Exception):
                    o.cleanup()

    kind = dict(frames.dtypes)[key]
    return frames.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"{key} {kind}, metrics map<string,double>, errors map<string,string>")
