"""The impact surface of changed symbols."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import bfs, call_edges, reverse

MAX_DEPTH = 15
#: A cap on visited symbols that a caller may ask for; without one, a search is whole.
MAX_VISITED = 50_000


def upstream(calls: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, cap: int | None = None) -> DataFrame:
    """(id, depth) of the seeds and their direct and indirect callers."""
    return bfs(reverse(call_edges(calls)), seeds, max_depth, cap)


def downstream(calls: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, cap: int | None = None) -> DataFrame:
    return bfs(call_edges(calls), seeds, max_depth, cap)


@dataclass
class ImpactSurface:
    """Symbols in both directions; endpoints of callers; database relations and events of callees.

    Each search runs when a field that needs it is first asked for.  Without a call graph (a language whose calls are
    not known), the seeds alone count.
    """

    calls: DataFrame
    endpoint_facts: DataFrame
    db_facts: DataFrame
    event_facts: DataFrame
    seeds: DataFrame
    has_calls: bool = True
    cap: int | None = None

    @cached_property
    def up(self) -> DataFrame:
        return upstream(self.calls, self.seeds, cap=self.cap).select("id") if self.has_calls else self.seeds.select("id").distinct()

    @cached_property
    def down(self) -> DataFrame:
        return downstream(self.calls, self.seeds, cap=self.cap).select("id") if self.has_calls else self.seeds.select("id").distinct()

    @property
    def symbols(self) -> DataFrame:
        return self.up.union(self.down).distinct()

    @property
    def endpoints(self) -> DataFrame:
        return self._of(self.endpoint_facts, self.up)

    @property
    def db_rels(self) -> DataFrame:
        return self._of(self.db_facts, self.down)

    @property
    def event_pubs(self) -> DataFrame:
        return self._of(self.event_facts, self.down)

    @staticmethod
    def _of(facts: DataFrame, ids: DataFrame) -> DataFrame:
        return facts.join(ids.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select(facts.columns)


def impact(calls: DataFrame, endpoints: DataFrame, db_rels: DataFrame, event_pubs: DataFrame, seeds: DataFrame, has_calls: bool = True, cap: int | None = None) -> ImpactSurface:
    return ImpactSurface(calls, endpoints, db_rels, event_pubs, seeds, has_calls, cap)
