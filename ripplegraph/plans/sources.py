"""Queries over source text, diffs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources import diff, extract
from ..sources.testdata import Facts
from ..streaming import runs, webhooks
from .core import query

# Source files made of the symbols: in each, a function for each symbol, by id; odd ones call the symbol before.
_FILES = {
    "python": ("def {n}(a):", "    return {c}(a)", "", "return_"),
    "java": ("    public int {n}(int a) {{", "        return {c}(a);", "    }}", ""),
    "typescript": ("export function {n}(a: number): number {{", "  return {c}(a);", "}}", ""),
}
_HEAD = {"python": "import os", "java": "public class Holder {", "typescript": "import { a } from './a';"}
_TAIL = {"python": "", "java": "}", "typescript": ""}


def source_files(f: Facts, language: str) -> DataFrame:
    """path, content of one language's files."""
    first, second, third, _ = _FILES[language]
    own = f.symbols.join(f.files.filter(F.col("language") == language).select(F.col("id").alias("file_id"), "path"), "file_id")
    body = F.concat_ws("\n", F.concat(*_pieces(first)), F.concat(*_pieces(second)), F.lit(third.replace("}}", "}")))
    grouped = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", body.alias("body")))).alias("b"))
    return grouped.select("path", F.concat_ws("\n", F.lit(_HEAD[language]), F.array_join(F.transform("b", lambda x: x["body"]), "\n"), F.lit(_TAIL[language])).alias("content"))


def _pieces(template: str) -> list:
    before, _, after = template.replace("{c}", "{n}").partition("{n}")
    return [F.lit(before), F.col("name"), F.lit(after.replace("{{", "{").replace("}}", "}"))]


def _register(language: str, kind: str, owner: str) -> None:
    lines = "SELECT f.path, s.name, 2 + 3 * (row_number() OVER (PARTITION BY f.path ORDER BY s.id) - 1) AS line FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.language = '" + language + "'"
    last = {"python": 1, "java": 2, "typescript": 2}[language]

    @query(f"{language}_symbols_extract", "symbols files", f"SELECT path, name, CAST(line AS INTEGER) AS line, CAST(line + {last} AS INTEGER) AS end_line FROM ({lines})")
    def _(f: Facts) -> DataFrame:
        facts = extract.extract(source_files(f, language))
        return facts.filter((F.col("fact") == "symbol") & (F.col("detail") == kind)).select("path", "name", "line", "end_line")

    @query(f"{language}_calls_extract", "symbols files", f"SELECT path, '{owner}' || name AS owner, name AS callee, CAST(line + 1 AS INTEGER) AS line FROM ({lines})")
    def _(f: Facts) -> DataFrame:
        return extract.extract(source_files(f, language)).filter("fact = 'call'").select("path", "owner", F.col("name").alias("callee"), "line")


_register("python", "function", "")
_register("java", "method", "Holder.")
_register("typescript", "function", "")


# Sources with facts of every kind: a piece for each symbol by its id, of as many templates as a language has.
_PIECES = {
    "python": (
        '@router.post("/r/{n}")\ndef {n}(a):\n    return helper(a)',
        'class {n}(Model):\n    __tablename__ = "t_{n}"\n    total = 1\n    owner = ForeignKey("User")',
        'def test_{n}(client):\n    assert client\n    self.assertEqual(1, 1)',
        'def {n}():\n    bus.publish("e_{n}")\n    return os.getenv("K_{n}")',
    ),
    "java": (
        '  @PostMapping("/r/{n}")\n  public String {n}(int a) { return helper(a); }',
        '  @Test\n  void {n}() { assertTrue(true); }',
        '  void {n}() { bus.publish("e_{n}"); System.getenv("K_{n}"); }',
    ),
    "typescript": (
        'export class {n} extends Base implements Shape {\n  area(): number { return compute(this.w); }\n}',
        "app.get('/r/{n}', {n}Handler);",
        'enum {n} { Red }',
    ),
}
_WRAP = {
    "python": ("import os\nfrom lib.models import Model", ""),
    "java": ("import lib.models.Base;\npublic class Holder extends Base {", "}"),
    "typescript": ("import { A } from './a';", ""),
}

# (template, fact, name, owner, target, detail); None as the template: once a file.
_FOUND = {
    "python": (
        (None, "import", "'os'", None, "'os'", "'standard'"), (None, "import", "'Model'", None, "'lib.models'", "'from'"),
        (0, "symbol", "n", None, None, "'function'"), (0, "endpoint", "'/r/' || n", "n", "n", "'POST'"), (0, "call", "'post'", "n", "'router'", None), (0, "call", "'helper'", "n", None, None),
        (1, "symbol", "n", None, None, "'class'"), (1, "type", "n", None, "'Model'", "'inherits'"), (1, "relationship", "'owner'", "n", "'User'", "'ForeignKey'"), (1, "model", "n", None, "'t_' || n", "'total,owner'"), (1, "call", "'ForeignKey'", "n", None, None),
        (2, "symbol", "'test_' || n", None, None, "'function'"), (2, "test", "'test_' || n", None, "'client'", "'2'"), (2, "call", "'assertEqual'", "'test_' || n", "'self'", None),
        (3, "symbol", "n", None, None, "'function'"), (3, "call", "'publish'", "n", "'bus'", None), (3, "event", "'e_' || n", "n", None, "'publish'"), (3, "call", "'getenv'", "n", "'os'", None), (3, "config", "'K_' || n", "n", None, "'environment'"),
    ),
    "java": (
        (None, "import", "'Base'", None, "'lib.models.Base'", "'standard'"), (None, "symbol", "'Holder'", None, None, "'class'"), (None, "type", "'Holder'", None, "'Base'", "'extends'"),
        (0, "symbol", "n", "'Holder'", None, "'method'"), (0, "endpoint", "'/r/' || n", "'Holder.' || n", "n", "'POST'"), (0, "call", "'helper'", "'Holder.' || n", None, None),
        (1, "symbol", "n", "'Holder'", None, "'method'"), (1, "test", "n", "'Holder'", None, "'1'"), (1, "call", "'assertTrue'", "'Holder.' || n", None, None),
        (2, "symbol", "n", "'Holder'", None, "'method'"), (2, "call", "'publish'", "'Holder.' || n", "'bus'", None), (2, "event", "'e_' || n", "'Holder.' || n", None, "'publish'"), (2, "call", "'getenv'", "'Holder.' || n", "'System'", None), (2, "config", "'K_' || n", "'Holder.' || n", None, "'property'"),
    ),
    "typescript": (
        (None, "import", "'A'", None, "'./a'", "'from'"),
        (0, "symbol", "n", None, None, "'class'"), (0, "type", "n", None, "'Base'", "'extends'"), (0, "type", "n", None, "'Shape'", "'implements'"), (0, "symbol", "'area'", "n", None, "'method'"), (0, "call", "'compute'", "n || '.area'", None, None),
        (1, "endpoint", "'/r/' || n", "n || 'Handler'", "n || 'Handler'", "'GET'"),
        (2, "symbol", "n", None, None, "'enum'"),
    ),
}


def _register_facts(language: str) -> None:
    pieces, (head, tail) = _PIECES[language], _WRAP[language]
    value = lambda x: "CAST(NULL AS VARCHAR)" if x is None else x
    parts = []
    for template, fact, name, owner, target, detail in _FOUND[language]:
        where = f"t = {template}" if template is not None else "first"
        parts.append(f"SELECT path, '{fact}' AS fact, {name} AS name, {value(owner)} AS owner, {value(target)} AS target, {value(detail)} AS detail FROM s WHERE {where}")
    own = f"@ s AS (SELECT f.path, s.name AS n, s.id % {len(pieces)} AS t, s.id = min(s.id) OVER (PARTITION BY f.path) AS first FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.language = '{language}') "

    @query(f"{language}_facts_extract", "symbols files", own + " UNION ALL ".join(parts))
    def _(f: Facts) -> DataFrame:
        own = f.symbols.join(f.files.filter(F.col("language") == language).select(F.col("id").alias("file_id"), "path"), "file_id")
        template = F.element_at(F.array(*[F.lit(p) for p in pieces]), (F.col("id") % len(pieces) + 1).cast("int"))
        grouped = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", F.replace(template, F.lit("{n}"), F.col("name")).alias("body")))).alias("b"))
        content = F.concat_ws("\n", F.lit(head), F.array_join(F.transform("b", lambda x: x["body"]), "\n"), F.lit(tail))
        return extract.extract(grouped.select("path", content.alias("content"))).select("path", "fact", "name", "owner", "target", "detail")


for _language in _PIECES:
    _register_facts(_language)


# A diff for each order: a file with a hunk, a line removed and as many added as the order has lines.
_DIFF = "SELECT CAST(l_orderkey AS BIGINT) AS diff_id, count(*) AS n FROM lineitem GROUP BY 1"


@query("diff_lines", "", f"WITH d AS ({_DIFF}) SELECT diff_id, 'src/f' || diff_id || '.py' AS file, '-' AS sign, CAST(11 AS INTEGER) AS line FROM d UNION ALL SELECT diff_id, 'src/f' || diff_id || '.py', '+', CAST(20 + i AS INTEGER) FROM d, unnest(range(1, n + 1)) AS u(i)")
def _(f: Facts) -> DataFrame:
    orders = f.lineitem.groupBy(F.col("l_orderkey").cast("long").alias("diff_id")).agg(F.count("*").cast("int").alias("n"))
    path = F.concat(F.lit("src/f"), "diff_id", F.lit(".py"))
    text = F.concat_ws("\n", F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path), F.lit("@@ -10,3 +20,4 @@ def f():"), F.lit(" context"), F.lit("-gone"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("+new "), i)), "\n"), F.lit(" end"))
    return diff.diff_lines(orders.select("diff_id", text.alias("diff"))).select("diff_id", "file", "sign", "line")


@query("adler32_ids", "files", "SELECT path, CAST((sum_b % 65521) * 65536 + (sum_a + 1) % 65521 AS BIGINT) AS checksum FROM (SELECT path, (SELECT sum(ascii(path[i])) FROM unnest(range(1, length(path) + 1)) AS u(i)) AS sum_a, length(path) + (SELECT sum((length(path) + 1 - i) * ascii(path[i])) FROM unnest(range(1, length(path) + 1)) AS u(i)) AS sum_b FROM files)")
def _(f: Facts) -> DataFrame:
    return f.files.select("path", N.adler32(F.col("path")).alias("checksum"))


@query("content_hashes", "files", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def _(f: Facts) -> DataFrame:
    return f.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@query("display_names", "symbols", "SELECT id, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(name, '_')], ' ') AS shown FROM symbols WHERE regexp_matches(name, '^[a-zA-Z_]+_[0-9]+$')")
def _(f: Facts) -> DataFrame:
    own = f.symbols.filter(F.col("name").rlike("^[a-zA-Z_]+_[0-9]+$"))
    return own.select("id", N.display_name(F.concat(F.lit("python://a/b.py::"), "name")).alias("shown"))


_STREAMED = ("view", "signup", "purchase", "click")


def _event_stream(f: Facts) -> DataFrame:
    spark = f.spark
    return spark.readStream.schema(f.events.schema).option("pathGlobFilter", "events.parquet").parquet(f.folder)


@query("webhook_filter_stream", "", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def _(f: Facts) -> DataFrame:
    rows = runs.drained(webhooks.allowed_actions(_event_stream(f), _STREAMED), "webhooks")
    flat = rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "_batch")
    return runs.latest(flat, ["day", "event_type"])


@query("webhook_requests_stream", "", "SELECT event_id AS number, 'repo' || (user_id % 5) AS repository FROM events WHERE event_id % 4 <> 3 AND event_id % 5 <> 2")
def _(f: Facts) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(a) for a in ("opened", "synchronize", "reopened", "closed")]), (F.col("event_id") % 4 + 1).cast("int"))
    sha = lambda s: F.struct(F.lit(s).alias("sha"))
    body = F.to_json(F.struct(action.alias("action"), F.col("event_id").alias("number"), F.struct(F.concat(F.lit("repo"), F.col("user_id") % 5).alias("full_name")).alias("repository"), F.struct(sha("b").alias("base"), sha("h").alias("head")).alias("pull_request")))
    signed = _event_stream(f).select(F.col("event_id").cast("string").alias("delivery_id"), body.alias("body"), "event_id")
    key = F.when(F.col("event_id") % 5 == 2, webhooks.hmac_sha256("wrong", F.col("body"))).otherwise(webhooks.hmac_sha256("right", F.col("body")))
    stream = webhooks.analysis_requests(webhooks.verified(signed.withColumn("signature", F.concat(F.lit("sha256="), key)), "right"))
    return runs.drained(stream, "requests").select("number", "repository")
