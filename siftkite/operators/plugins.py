"""Extension points: rules, scanners, sinks and vector backends by name, as plain registries of DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from siftkite.operators.patterns import Pattern, scan_lines


class Registry:
    """Names to functions; a name is taken once."""

    def __init__(self):
        self._by_name: dict[str, tuple[Callable, Callable[[str], bool], bool]] = {}

    def register(self, name: str, function: Callable, *, supports: Callable[[str], bool] = lambda target: True, enabled: bool = True) -> None:
        if name in self._by_name:
            raise ValueError(f"{name} is registered already")
        self._by_name[name] = function, supports, enabled

    def get(self, name: str) -> Callable:
        return self._by_name[name][0]

    def names(self, target: str | None = None) -> list[str]:
        """Enabled ones that support the target, in order of registration."""
        return [n for n, (_, ok, on) in self._by_name.items() if on and (target is None or ok(target))]


def matches_language(language: str, file_language: str) -> bool:
    return language == "*" or language.lower() == file_language.lower()


def rule(pattern: Pattern, language: str = "*", language_col: str = "language") -> Callable[[DataFrame], DataFrame]:
    """A rule as a function of files; a wildcard language takes all."""
    return lambda files: scan_lines(files if language == "*" else files.filter(files[language_col] == language), [pattern])


def fan_out(registry: Registry, files: DataFrame, target: str | None = None) -> DataFrame | None:
    """All enabled scanners' findings in one table; None if there is no scanner."""
    parts = [registry.get(n)(files) for n in registry.names(target)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
