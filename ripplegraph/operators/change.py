"""Change sets between two versions of the fact tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PROPERTIES = ("body_hash", "signature", "decorators")


def changed_symbols(base: DataFrame, head: DataFrame, strict: bool = False) -> DataFrame:
    """id, change (ADDED, REMOVED, MODIFIED) and both rows of every symbol that differs.

    A symbol is modified if its lines, visibility or properties (body hash, signature, decorators) differ; ``strict`` leaves
    the properties out, as does a table that lacks them.
    """
    side = lambda df, name: df.select("id", F.struct(*df.columns).alias(name))
    both = side(base, "old").join(side(head, "new"), "id", "full_outer")
    compared = ["start_line", "end_line", "visibility"] + ([] if strict else [c for c in PROPERTIES if c in base.columns])
    differs = reduce(lambda a, c: a | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), compared, F.lit(False))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(differs, "MODIFIED")
    return both.withColumn("change", change).filter("change is not null")


def contract_changes(changes: DataFrame) -> DataFrame:
    """id, contract: what of a modified symbol's contract differs (body, visibility, decorators, signature)."""
    columns = changes.schema["old"].dataType.names
    differs = lambda c: ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) if c in columns else F.lit(False)
    rules = {"body": differs("start_line") | differs("end_line"), "visibility": differs("visibility"), "decorators": differs("decorators"), "signature": differs("signature")}
    kinds = F.array(*[F.when(when, F.lit(name)) for name, when in rules.items()])
    return changes.filter("change = 'MODIFIED'").select("id", F.explode(F.array_compact(kinds)).alias("contract"))


@dataclass
class Side:
    """The facts of one version, as far as a change looks at them."""

    symbols: DataFrame
    calls: DataFrame  # src, dst
    references: DataFrame  # src, dst
    imports: DataFrame  # file_id, module
    endpoints: DataFrame  # symbol_id, method, path
    db_rels: DataFrame  # symbol_id, resource_id
    event_pubs: DataFrame  # symbol_id, event_id
    commit: str = ""


@dataclass
class ChangeFacts:
    """All that differs between two versions; with ``files`` (id), only what lies in the files of a diff."""

    base: Side
    head: Side
    files: DataFrame | None = None
    strict: bool = False

    def _inside(self, rows: DataFrame, key: str = "file_id") -> DataFrame:
        return rows if self.files is None else rows.join(self.files.select(F.col("id").alias(key)), key, "left_semi").select(rows.columns)

    @property
    def same_commit(self) -> bool:
        return bool(self.base.commit) and self.base.commit == self.head.commit

    @property
    def symbols(self) -> DataFrame:
        return changed_symbols(self._inside(self.base.symbols), self._inside(self.head.symbols), self.strict)

    def of_kind(self, change: str) -> DataFrame:
        """id, kind and file_id of the symbols that were ADDED, REMOVED or MODIFIED."""
        own = F.coalesce("new", "old")
        return self.symbols.filter(F.col("change") == change).select("id", own["kind"].alias("kind"), own["file_id"].alias("file_id"))

    def _edges(self, base: DataFrame, head: DataFrame) -> DataFrame:
        own = self.symbols.select(F.col("id").alias("src"))
        of = lambda rows: rows.join(own, "src", "left_semi").select("src", "dst")
        return set_difference(of(base), of(head), ["src", "dst"])

    @property
    def calls(self) -> DataFrame:
        """src, dst, change: calls out of changed symbols that came or went."""
        return self._edges(self.base.calls, self.head.calls)

    @property
    def references(self) -> DataFrame:
        return self._edges(self.base.references, self.head.references)

    @property
    def imports(self) -> DataFrame:
        return set_difference(self._inside(self.base.imports), self._inside(self.head.imports), ["file_id", "module"])

    @property
    def contracts(self) -> DataFrame:
        """id, contract, change_kind, detail: contracts of modified symbols; endpoints, data and events of added and removed ones."""
        changes = self.symbols
        columns = changes.schema["old"].dataType.names
        value = lambda side, c: F.col(f"{side}.{c}").cast("string") if c in columns else F.lit(None).cast("string")
        of = {"body": "body_hash", "visibility": "visibility", "decorators": "decorators", "signature": "signature"}
        change = lambda c: F.concat_ws(" -> ", F.coalesce(value("old", c), F.lit("")), F.coalesce(value("new", c), F.lit("")))
        detail = reduce(lambda a, k: a.when(F.col("contract") == k, change(of[k])), list(of)[1:], F.when(F.col("contract") == "body", change("body_hash")))
        modified = contract_changes(changes).join(changes.select("id", "old", "new"), "id").select("id", "contract", F.lit("modified").alias("change_kind"), detail.alias("detail"))
        parts = [modified]
        for side, kind, label in ((self.head, "ADDED", "added"), (self.base, "REMOVED", "removed")):
            ids = changes.filter(F.col("change") == kind).select(F.col("id").alias("symbol_id"))
            for contract, rows, text in (
                ("api", side.endpoints, F.concat("method", F.lit(" "), "path")),
                ("database", side.db_rels, F.col("resource_id").cast("string")),
                ("event_publish", side.event_pubs, F.col("event_id").cast("string")),
            ):
                parts.append(rows.join(ids, "symbol_id", "left_semi").select(F.col("symbol_id").alias("id"), F.lit(contract).alias("contract"), F.lit(label).alias("change_kind"), text.alias("detail")))
        return reduce(DataFrame.unionByName, parts)

    @property
    def modified_contracts(self) -> DataFrame:
        """id, contract of every modified symbol; one whose contract is as it was has an empty body change."""
        changes = self.symbols
        own = contract_changes(changes)
        rest = changes.filter("change = 'MODIFIED'").select("id").join(own, "id", "left_anti").select("id", F.lit("body").alias("contract"))
        return own.withColumn("empty", F.lit(False)).unionByName(rest.withColumn("empty", F.lit(True)))

    def counts(self) -> DataFrame:
        """section, n: how many of everything, the compatibility views (added, removed, modified symbols) included."""
        tables = {"symbols": self.symbols, "calls": self.calls, "references": self.references, "imports": self.imports, "contracts": self.contracts}
        rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n") for name, df in tables.items()]
        kinds = self.symbols.groupBy(F.concat(F.lower("change"), F.lit("_symbols")).alias("section")).agg(F.count("*").alias("n"))
        return reduce(DataFrame.unionByName, [*rows, kinds])


def set_difference(base: DataFrame, head: DataFrame, key: list[str]) -> DataFrame:
    """The distinct keys of one side only, with change added or removed."""
    old, new = base.select(*key).distinct(), head.select(*key).distinct()
    added = new.join(old, key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, key, "left_anti").withColumn("change", F.lit("removed")))


def row_difference(base: DataFrame, head: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, change (added, removed, modified) of rows with one key on either side."""
    side = lambda df, name: df.select(key, F.struct(*values).alias(name), F.lit(True).alias(f"in_{name}"))
    both = side(base, "old").join(side(head, "new"), key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select(key, change.alias("change")).filter("change is not null")


def renames(changes: DataFrame) -> DataFrame:
    """old_id, new_id: of a kind and file with exactly one removed and one added symbol."""
    own = F.when(F.col("change") == "ADDED", F.col("new")).otherwise(F.col("old"))
    rows = changes.filter("change in ('ADDED', 'REMOVED')").select("id", "change", own["kind"].alias("kind"), own["file_id"].alias("file_id"))
    pick = lambda c: F.min(F.when(F.col("change") == c, F.col("id")))
    n = lambda c: F.count_if(F.col("change") == c)
    grouped = rows.groupBy("kind", "file_id").agg(pick("REMOVED").alias("old_id"), pick("ADDED").alias("new_id"), n("REMOVED").alias("r"), n("ADDED").alias("a"))
    return grouped.filter("r = 1 and a = 1").select("old_id", "new_id")


def change_files(changes: DataFrame) -> DataFrame:
    """file_id, change_type (mixed if several), symbols."""
    own = F.coalesce("new.file_id", "old.file_id")
    out = changes.groupBy(own.alias("file_id")).agg(F.count_distinct("change").alias("kinds"), F.min("change").alias("one"), F.count("*").alias("symbols"))
    return out.select("file_id", F.when(F.col("kinds") > 1, "mixed").otherwise(F.lower("one")).alias("change_type"), "symbols")


def change_summary(files: DataFrame, behaviors: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: files, symbols, behaviors, scope (local: one file; multi_file: up to five; wide) and classification.

    Added and removed symbols make a change mixed; added ones alone an addition, removed ones without added a removal.
    """
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"))
    scope = F.when(F.col("files") > 5, "wide").when(F.col("files") > 1, "multi_file").otherwise("local")
    n = lambda c: F.count_if(F.col("change") == c) > 0
    kind = F.when(n("ADDED") & n("REMOVED"), "mixed").when(n("ADDED") & ~n("MODIFIED"), "addition").when(n("REMOVED") & ~n("ADDED"), "removal").otherwise("modification")
    kinds = changes.agg(kind.alias("classification"))
    return total.crossJoin(behaviors.agg(F.count("*").alias("behaviors"))).crossJoin(kinds).withColumn("scope", scope)  # three single rows


class Inconsistent(ValueError):
    """Facts that refer to what is not there."""


def require_consistent(errors: DataFrame, most: int = 20) -> None:
    """Raise ``Inconsistent`` with the first messages, if there are any."""
    if found := [r["message"] for r in errors.orderBy("message").limit(most).collect()]:
        raise Inconsistent("; ".join(found))


def referential_errors(rows: DataFrame, key: str, known: DataFrame, message: str) -> DataFrame:
    """A message for each distinct key that the known ids lack."""
    lost = rows.select(F.col(key).alias("id")).filter("id is not null").distinct().join(known.select("id"), "id", "left_anti")
    return lost.select(F.format_string(message, "id").alias("message"))
