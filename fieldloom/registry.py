"""The registry of operations: plain functions from DataFrames to DataFrames, found by name."""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable

log = logging.getLogger("fieldloom")


class Registry:
    """Operations by name, as attributes. Observers see each call as (name, args, kwargs)."""

    def __init__(self) -> None:
        self._found: dict[str, tuple[Callable, int]] = {}
        self._others: dict[str, list[tuple[Callable, Callable]]] = {}
        self.observers: list[Callable[[str, tuple, dict], None]] = []

    def operation(self, operands: int | Callable = 1) -> Callable:
        """Register a function; ``operands`` is how many of its first arguments are data."""
        if callable(operands):
            return self.operation(1)(operands)

        def add(fn: Callable) -> Callable:
            self._found[fn.__name__] = (fn, operands)
            return fn

        return add

    def implementation(self, name: str, when: Callable[..., bool]) -> Callable:
        """Register another function for an operation, taken for operands that ``when`` accepts; of several the last one counts."""

        def add(fn: Callable) -> Callable:
            self._get(name)
            self._others.setdefault(name, []).append((when, fn))
            return fn

        return add

    def names(self) -> list[str]:
        self._load()
        return sorted(self._found)

    def operands(self, name: str) -> int:
        return self._get(name)[1]

    def signature(self, name: str) -> str:
        return f"{name}{inspect.signature(self._get(name)[0])}"

    def call(self, name: str, *args, **kwargs):
        for see in self.observers:
            see(name, args, kwargs)
        found, operands = self._get(name)
        for when, fn in reversed(self._others.get(name, ())):
            if when(*args[: operands or 1]):
                return fn(*args, **kwargs)
        return found(*args, **kwargs)

    def _load(self) -> None:
        from . import operators  # noqa: F401

    def _get(self, name: str) -> tuple[Callable, int]:
        self._load()
        try:
            return self._found[name]
        except KeyError:
            raise AttributeError(f"no operation {name!r}") from None

    def __getattr__(self, name: str) -> Callable:
        if name.startswith("_"):
            raise AttributeError(name)
        self._get(name)
        return lambda *args, **kwargs: self.call(name, *args, **kwargs)


def log_calls(name: str, args: tuple, kwargs: dict) -> None:
    """An observer that logs."""
    log.info("%s%s", name, tuple(a for a in args if isinstance(a, str | int | float | list | tuple | dict)))


class CollectCalls:
    """An observer that keeps (name, args, kwargs)."""

    def __init__(self) -> None:
        self.calls: list[tuple[str, tuple, dict]] = []

    def __call__(self, name: str, args: tuple, kwargs: dict) -> None:
        self.calls.append((name, args, kwargs))


ops = Registry()
operation = ops.operation
