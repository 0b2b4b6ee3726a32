"""Secret scans over an incremental blob ledger (native: DataFrame functions only).

Every historical version of every path is content-addressed by the SHA-256 of its text.  The ledger holds a row for
each pair of blob and rule version that was scanned, with the spans found.  A scan reads only texts of pairs that the
ledger lacks, appends them, and joins the findings back to all versions with that content.

Spans are code points, end exclusive.  Defined results: a null text is empty; copies share one scan and all get its
findings; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hadoop_fs


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping; those whose ``group`` has under ``least`` characters fail."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules. A run of hex digits or of an access key is maximal, so its least length can stand
# in the pattern itself; a failing assignment takes up its text, so that rule drops its failures afterwards.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_GAPS = "array<struct<start:int,end:int>>"


def _lengths(text: Column, rule: Rule) -> Column:
    """For each match of one rule the lengths of the gap before it, of the match and of its value; null without matches."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    lengths = F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), F.length(p["value"]).alias("value")))
    return F.when(text.rlike(rule.pattern), lengths)


class BlobLedger:
    """The scanned pairs of blob and rule version, as Parquet at ``path`` (by default a new one in the shared folder)."""

    def __init__(self, spark, path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES):
        self.spark, self.rules = spark, rules
        self.path = path or Scratch(spark, "ledger").path("pairs")

    def rows(self) -> DataFrame | None:
        """blob, rule, spans; None before the first scan."""
        fs, path = hadoop_fs(self.spark, self.path)
        if not fs.exists(path):
            return None
        try:
            return self.spark.read.schema(f"blob binary, rule string, spans {_SPANS}").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
                return None
            raise

    def scan(self, versions: DataFrame, text_col: str = "text") -> None:
        """Scan the unseen pairs of these versions and append them."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = versions.select(text.alias("text"), _address(text).alias("blob")).groupBy("blob").agg(F.first("text").alias("text"))
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        before = self.rows()
        if before is None:
            todo = blobs.withColumn("unseen", keys)
        else:
            seen = before.filter(F.col("rule").isin([r.key for r in self.rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            todo = blobs.join(seen, "blob", "left").withColumn("unseen", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
            todo = todo.filter(F.size("unseen") > 0)
        scans = [
            F.when(F.array_contains("unseen", r.key), F.struct(F.lit(r.key).alias("rule"), F.lit(k).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), _lengths(F.col("text"), r).alias("lengths")))
            for k, r in enumerate(self.rules)
        ]
        pairs = todo.select("blob", F.explode(F.array_compact(F.array(*scans))).alias("pair")).select("blob", "pair.*")
        # a row for each match; running sums of the lengths give the offsets, in time in proportion to the matches
        each = pairs.select("blob", "rule", "rank", "kind", "least", F.posexplode_outer("lengths").alias("place", "n"))
        order = Window.partitionBy("blob", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.col("n.gap") + F.col("n.hit")).over(order).cast("int")
        each = each.withColumn("end", end)
        span = F.struct((F.col("end") - F.col("n.hit")).alias("start"), "rank", "end", "kind")
        spans = F.sort_array(F.collect_list(F.when(F.col("n.value") >= F.col("least"), span)))
        each.groupBy("blob", "rule").agg(spans.cast(_SPANS).alias("spans")).write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """Blobs with spans under this ledger's rules: blob, spans sorted by start, then rule; and the gaps between them.

        A pair that scans at one time have added twice counts once.
        """
        pairs = self.rows().filter(F.col("rule").isin([r.key for r in self.rules]) & (F.size("spans") > 0))
        each = pairs.groupBy("blob", "rule").agg(F.first("spans").alias("spans")).select("blob", F.inline("spans"))
        order = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("before", F.coalesce(F.max("end").over(order), F.lit(0)))
        gap = F.when(F.col("start") >= F.col("before"), F.struct(F.col("before").alias("start"), F.col("start").alias("end")))
        found = each.groupBy("blob").agg(
            F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).cast(_SPANS).alias("spans"),
            F.sort_array(F.collect_list(gap)).cast(_GAPS).alias("gaps"), F.max("end").alias("last"),
        )
        rest = F.array(F.struct(F.col("last").alias("start"), F.lit(2**29 - 1).alias("end")))
        return found.select("blob", "spans", F.concat("gaps", rest).cast(_GAPS).alias("gaps"))

    def join_back(self, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """The versions' own columns, ``secret_spans`` (never null) and ``secret_gaps`` (the text around them; null without spans).

        Columns of the versions that have these two names give way.
        """
        keyed = versions.select(F.struct(*[versions[c] for c in versions.columns]).alias("row"), _address(F.coalesce(versions[text_col], F.lit(""))).alias("blob"))
        found = Scratch(self.spark, "findings").write(self.findings(), "spans")
        joined = keyed.join(found, "blob", "left")
        own = [F.col("row")[c].alias(c) for c in versions.columns if c not in ("secret_spans", "secret_gaps")]
        return joined.select(*own, F.coalesce("spans", F.array().cast(_SPANS)).alias("secret_spans"), F.col("gaps").alias("secret_gaps"))


def _address(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan_versions(versions: DataFrame, text_col: str = "text", path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, then give all versions with their ``secret_spans``."""
    ledger = BlobLedger(versions.sparkSession, path, rules)
    ledger.scan(versions, text_col)
    return ledger.join_back(versions, text_col)


def redact(text: Column, gaps: Column, mark: str = "[secret]") -> Column:
    """The text with each union of overlapping spans replaced by ``mark``; ``gaps`` as in ``join_back``.

    Four bytes for each code point, so that a gap is cut out without a walk from the start of the text.
    """
    wide = F.encode(text, "UTF-32")
    piece = lambda w: F.array_join(F.transform(gaps, lambda g: F.decode(F.substring(w, 4 * g["start"] + 1, 4 * (g["end"] - g["start"])), "UTF-32")), mark)
    return F.when(gaps.isNull(), text).otherwise(F.element_at(F.transform(F.array(wide), piece), 1))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
