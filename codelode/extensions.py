"""Hooks by which other modules add languages, validation passes and adapters.

A module adds to the engine in its function ``register(hooks)``, which ``discover`` calls once for each module however
often it is asked. Parsers and passes travel to the executors with the plan that uses them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field


@dataclass
class Hooks:
    """What has been added: parsers by extension, passes by language, adapters by name."""

    parsers: dict[str, tuple[str, Callable]] = field(default_factory=dict)
    passes: dict[str, list[Callable]] = field(default_factory=dict)
    adapters: dict[str, Callable] = field(default_factory=dict)
    known: set[str] = field(default_factory=set)

    def language(self, name: str, exts: Iterable[str], parse: Callable) -> None:
        """parse(source, name) gives the symbols and edges of a file (see parse.Found) for files of these extensions."""
        self.parsers |= {e.lower(): (name, parse) for e in exts}

    def validation(self, lang: str, check: Callable) -> None:
        """check(source) gives issues as (code, severity, line, message); a check that is there already is not added again."""
        have = self.passes.setdefault(lang, [])
        if check not in have:
            have.append(check)

    def adapter(self, name: str, make: Callable) -> None:
        """make(store) gives an adapter for scans."""
        self.adapters[name] = make


HOOKS = Hooks()


def discover(modules: Iterable[str], hooks: Hooks = HOOKS) -> list[str]:
    """Let modules add to the engine; the names of those that had not done so. A module that cannot be imported raises."""
    new = [m for m in dict.fromkeys(modules) if m not in hooks.known]
    for name in new:
        importlib.import_module(name).register(hooks)
        hooks.known.add(name)
    return new


def reset(hooks: Hooks = HOOKS) -> None:
    """Forget all that was added."""
    for part in (hooks.parsers, hooks.passes, hooks.adapters, hooks.known):
        part.clear()
