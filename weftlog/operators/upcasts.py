"""Read-time schema evolution: chains of functions from one schema version of a type to the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Upcaster:
    """``upcast`` gives a type's data of ``to_version`` from that of ``from_version``: a Column from a Column in plans, a
    value from a value in reads of single streams."""

    event_type: str
    from_version: int
    to_version: int
    upcast: Callable[[Any], Any]


class Upcasters:
    """Upcasters by type, in order of from_version (those that tie in order of registration)."""

    def __init__(self) -> None:
        self._chains: dict[str, list[Upcaster]] = {}

    def register(self, *upcasters: Upcaster) -> None:
        for u in upcasters:
            chain = [*self._chains.get(u.event_type, []), u]
            self._chains[u.event_type] = sorted(chain, key=lambda x: x.from_version)

    def latest(self, event_type: str, version: int) -> int:
        """The version that one pass of the chain arrives at."""
        for u in self._chains.get(event_type, ()):
            if u.from_version == version:
                version = u.to_version
        return version

    def value(self, event_type: str, version: int, data: Any) -> Any:
        """One pass over the chain: a gap ends it, later ones that fit again go on."""
        for u in self._chains.get(event_type, ()):
            if u.from_version == version:
                data, version = u.upcast(data), u.to_version
        return data

    def column(self, data: Column, event_type: Column | None = None, version: Column | None = None, only: tuple[str, int] | None = None) -> Column:
        """The same as one expression over columns event_type and schema_version; null data (tombstones) stays null.

        For each stored version of a type the chain is known before the plan runs: one CASE, no join. Its branches must be
        of one type; where rows are all of one type and version, ``only`` names them, and the result may have another type.
        """
        if only is not None:
            kind, at = only
            for u in self._chains.get(kind, ()):
                if u.from_version == at:
                    data, at = u.upcast(data), u.to_version
            return data
        event_type = F.col("event_type") if event_type is None else event_type
        version = F.col("schema_version") if version is None else version
        out = None
        for kind, chain in self._chains.items():
            for start in sorted({u.from_version for u in chain}):
                new, at = data, start
                for u in chain:
                    if u.from_version == at:
                        new, at = u.upcast(new), u.to_version
                hit = (event_type == kind) & (version == start) & data.isNotNull()
                out = F.when(hit, new) if out is None else out.when(hit, new)
        return data if out is None else out.otherwise(data)
