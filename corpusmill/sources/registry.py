"""Names for corpora: what they read, how they are indexed, when. One JSON document in the shared store."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from corpusmill.operators.surfaces import Strategy, strategy_from_spec
from corpusmill.sources.corpus import resolve
from corpusmill.sources.store import CorpusStore


class Registry(Mapping):
    def __init__(self, store: CorpusStore):
        self.store = store

    def _all(self) -> dict:
        return self.store.get_document("registry") or {}

    def register(self, name: str, *, kind: str, reader: str | None = None, strategy: Strategy | None = None, policy: Mapping | None = None, replace: bool = False) -> dict:
        """Remembers a corpus. ``reader``: ``"module:function"`` that gives its rows from a session."""
        entries = self._all()
        if not name or "/" in name:
            raise ValueError(f"no name for a corpus: {name!r}")
        if name in entries and not replace:
            raise ValueError(f"{name!r} is registered already")
        entries[name] = {"kind": kind, "reader": reader, "strategy": strategy.spec() if strategy else None, "policy": dict(policy or {})}
        self.store.put_document("registry", entries)
        return entries[name]

    def unregister(self, name: str) -> bool:
        entries = self._all()
        known = entries.pop(name, None) is not None
        if known:
            self.store.put_document("registry", entries)
        return known

    def __getitem__(self, name: str) -> dict:
        return self._all()[name]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._all()))

    def __len__(self) -> int:
        return len(self._all())

    def strategy_of(self, name: str) -> Strategy | None:
        spec = self[name]["strategy"]
        return strategy_from_spec(spec) if spec else None

    def reader_of(self, name: str) -> Callable | None:
        reader = self[name]["reader"]
        return resolve(reader) if reader else None
