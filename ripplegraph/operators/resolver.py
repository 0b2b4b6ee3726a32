"""The demand-driven loop: plan what a query needs, index what the budget allows, and fall back to the whole tree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Tables
from .planner import Budget, candidates, within_budget


@dataclass
class Outcome:
    rounds: int = 0
    files: int = 0
    bytes: int = 0
    exceeded: str | None = None
    complete: bool = False
    fallback: bool = False
    path_log: list[int] = field(default_factory=list)


def resolve(tree: DataFrame, status: DataFrame, requirements: list[tuple[str, str]], index: Callable[[DataFrame], list[tuple[str, str]]], budget: Budget = Budget(), fall_back: bool = True) -> tuple[DataFrame, Outcome]:
    """The paths indexed, and how it went.

    tree: path, type, size, text; status: path, indexed_status.  ``index`` takes a table of paths and returns the
    requirements that came up while indexing them.  Each round is one plan over all requirements; requirements that
    were worked off don't come back.  When a limit breaks, the whole remaining tree is indexed, if that is allowed.
    """
    tables, out, seen = Tables(tree.sparkSession, "resolve"), Outcome(), set()
    done = tables.put(status.filter("indexed_status = 'indexed'").select("path").distinct(), "round-0")
    todo = [r for r in dict.fromkeys(requirements)]
    while todo and out.rounds < budget.depth:
        out.rounds += 1
        seen.update(todo)
        known = done.withColumn("indexed_status", F.lit("indexed"))
        plan = tables.put(candidates(todo[: budget.requests], tree, known).join(tree.select("path", "size"), "path").select("path", "size").distinct(), f"plan-{out.rounds}")
        n, size = plan.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if len(todo) > budget.requests:
            out.exceeded = "requests"
        elif out.files + n > budget.files:
            out.exceeded = "files"
        elif out.bytes + size > budget.bytes:
            out.exceeded = "bytes"
        if out.exceeded:
            plan = within_budget(plan, Budget(files=max(0, budget.files - out.files), bytes=max(0, budget.bytes - out.bytes)))
            n, size = plan.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        found = index(plan.select("path")) if n else []
        out.files, out.bytes = out.files + n, out.bytes + size
        out.path_log.append(n)
        done = tables.put(done.union(plan.select("path")).distinct(), f"round-{out.rounds}")
        if out.exceeded:
            break
        todo = [r for r in dict.fromkeys(found) if r not in seen]
    if todo and not out.exceeded and out.rounds >= budget.depth:
        out.exceeded = "depth"
    out.complete = out.exceeded is None
    if out.exceeded and fall_back:
        rest = tree.filter("type = 'blob'").select("path").join(done, "path", "left_anti")
        rest = tables.put(rest, "rest")
        index(rest)
        done, out.fallback, out.complete = done.union(rest), True, True
    return done, out


class Demand:
    """Lookups that ask for what they lack: each requirement is resolved once, then the lookup runs again."""

    def __init__(self, resolve_all: Callable[[list[tuple[str, str]]], None]):
        self.resolve_all, self.resolved = resolve_all, set()

    def answer(self, lookup: Callable[[], tuple], requirements: list[tuple[str, str]]) -> tuple:
        """(rows, complete) of a lookup; complete too where all it needs was resolved, whatever that found."""
        rows, complete = lookup()
        if complete:
            return rows, True
        if todo := [r for r in dict.fromkeys(requirements) if r not in self.resolved]:
            self.resolved.update(todo)
            self.resolve_all(todo)
            rows, complete = lookup()
        return rows, complete or all(r in self.resolved for r in requirements)
