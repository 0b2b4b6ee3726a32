"""Keyword predicates and classifiers over symbol names and paths; every keyword is looked for as a substring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keyword families that the classifiers share.
READ = ("get", "fetch", "load", "find", "query", "select", "retrieve", "list", "search", "read", "lookup", "resolve")
WRITE = ("save", "create", "update", "delete", "insert", "remove", "store", "persist", "write", "put", "patch", "destroy")
TRANSACTION = ("transaction", "transactional", "atomic", "db_transaction")
CACHE = ("cache", "cached", "cache_result", "cache_key", "redis_cache", "memcached", "ttl")
MODEL_SUFFIX = ("model", "models", "entity", "entities", "schema", "dto", "dao", "repository")
STORAGE = {
    "s3": ("s3", "aws_s3", "s3_storage", "object_store"),
    "redis": ("redis", "redis_cache", "redis_store"),
    "blob": ("blob", "blob_storage", "azure_blob"),
    "gcs": ("gcs", "google_cloud_storage", "gcs_storage"),
    "elasticsearch": ("elasticsearch", "es", "elastic"),
    "mongodb": ("mongodb", "mongo", "mongo_db"),
}
PUBLISH = ("publish", "emit", "dispatch", "send", "produce", "fire", "notify", "broadcast", "raise_event", "trigger")
CONSUME = ("subscribe", "consume", "handle", "on_event", "listen", "process_event", "receive", "on_message")
QUEUE = ("queue", "message_queue", "task_queue", "job_queue", "rabbitmq", "sqs", "pubsub", "kafka_topic", "nats")
WORKER = ("worker", "job", "task", "background_job", "scheduled_task", "cron_job", "periodic_task", "async_task")
BENCHMARK = ("benchmark", "bench", "perf_test", "performance")
E2E = ("e2e", "end_to_end", "endtoend", "smoke", "acceptance")
INTEGRATION = ("integration", "integrate", "e2e", "functional")
UNIT = ("test_", "_test", "spec_", "_spec")
REPLAY = ("replay", "record_replay", "production_replay")
COVERAGE = ("coverage", "coveragerc", "codecov", "coveralls", "lcov", "nyc_output", "jacoco")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Any of the words occurs in the lower-cased text."""
    return reduce(Column.__or__, [F.contains(F.lower(text), F.lit(w)) for w in words])


def is_data_model(name: Column, kind: Column) -> Column:
    return kind.isin("class", "interface") & reduce(Column.__or__, [F.lower(name).endswith(s) for s in MODEL_SUFFIX])


def storage_types(name: Column) -> Column:
    """The storage kinds that a name hints at, as an array."""
    return F.array_compact(F.array(*[F.when(holds(name, words), F.lit(kind)) for kind, words in STORAGE.items()]))


def events_in(name: Column, words: tuple[str, ...]) -> Column:
    """An event for each keyword in the name: what follows its first occurrence, or the name itself if nothing does."""
    low = F.lower(name)

    def event(word: str) -> Column:
        rest = F.trim(F.element_at(F.split(low, word, 2), 2), F.lit("_"))
        return F.when(F.contains(low, F.lit(word)), F.when(F.length(rest) > 0, rest).otherwise(name))

    return F.array_compact(F.array(*[event(w) for w in words]))


def test_category(name: Column, path: Column) -> Column:
    """benchmark, e2e, integration or unit; null for other symbols."""
    either = lambda words: holds(name, words) | holds(path, words)
    return F.when(either(BENCHMARK), "benchmark").when(either(E2E), "e2e").when(either(INTEGRATION), "integration").when(either(UNIT), "unit")


# The words of the symbol categories; the first category that holds wins.
PRIMITIVES = ("str", "int", "float", "bool", "dict", "list", "set", "tuple", "bytes", "Any", "Literal", "Optional", "Union", "TypeVar", "Generic", "Protocol", "UUID", "None", "object", "type", "frozenset", "bytearray", "complex")
FRAMEWORK_MODULES = ("fastapi", "starlette", "uvicorn", "gunicorn", "pydantic_settings", "pydantic", "django", "flask", "flask_restful", "jinja2", "amplitude", "sentry_sdk")
FRAMEWORK_NAMES = ("FastAPI", "APIRouter", "Depends", "Request", "Response", "RedirectResponse", "HTTPException", "BackgroundTasks", "CORSMiddleware", "cors", "middleware", "router", "route", "lifecycle", "handler")
ORM_MODULES = ("sqlalchemy", "tortoise", "asyncpg", "databases")
ORM_NAMES = ("select", "insert", "update", "delete", "func", "op", "ForeignKey", "Sequence", "relationship", "joinedload", "selectinload", "AsyncSession", "Session", "Column", "Integer", "String", "Base", "metadata", "declarative_base", "sessionmaker")
BUILD_PATHS = (".github/", ".gitlab-ci", "docker", "makefile", "setup.py", "setup.cfg", "pyproject.toml", "tox.ini", ".gitignore", "requirements", "uv.lock")
TOOL_PATHS = ("dev/", "scripts/", "cli.py", "install", "bootstrap", ".venv")
TEST_PATHS = ("/tests/", "/test/", "test_", "_test.py")
TEST_NAMES = ("test_", "mock", "monkeypatch", "fixture", "assert")
INFRASTRUCTURE = ("db", "database", "sql", "query", "cache", "redis", "logger", "logging", "connection", "pool")
EVENT = ("event", "publish", "subscribe", "queue", "consumer", "producer")
API = ("api", "endpoint", "controller")
VALIDATION = ("validate", "validator", "check", "schema")
EXTERNAL = ("integration", "client", "external", "webhook")
SCHEMA = ("model", "table", "entity")


def standard_library() -> tuple[str, ...]:
    import sys

    return tuple(sorted(sys.stdlib_module_names))


def symbol_category(name: Column, path: Column, kind: Column) -> Column:
    """One of 14 categories."""
    first, low, k = F.substring_index(name, ".", 1), F.lower(name), F.lower(kind)
    p = F.lower(F.coalesce(path, F.lit("")))
    top = reduce(Column.__or__, [p.startswith(s) for s in ("tests/", "test/", "tests\\", "test\\")])
    return (
        F.when(holds(p, BUILD_PATHS), "Build")
        .when(holds(p, TOOL_PATHS), "Tooling")
        .when(holds(p, TEST_PATHS) | top | holds(name, TEST_NAMES) | (k == "test"), "Test")
        .when(name.isin(*PRIMITIVES), "Runtime")
        .when(first.isin(*standard_library()), "Standard Library")
        .when(first.isin(*FRAMEWORK_MODULES) | name.isin(*FRAMEWORK_NAMES) | holds(name, ("middleware", "router", "route")) | ((low == "app") & k.isin("module", "package", "application")), "Framework")
        .when(first.isin(*ORM_MODULES) | name.isin(*ORM_NAMES) | holds(name, INFRASTRUCTURE), "Infrastructure")
        .when(k.isin("worker", "task", "event") | holds(name, EVENT), "Event")
        .when(k.isin("endpoint", "route") | holds(name, API), "API")
        .when(holds(name, VALIDATION), "Validation")
        .when(holds(name, EXTERNAL), "Integration")
        .when(holds(name, SCHEMA), "Database Schema")
        .when(k.isin("class", "interface", "enum"), "Domain Model")
        .otherwise("Business Logic")
    )


def is_compiler_metadata(text: Column) -> Column:
    """Ids of the compiler's own graph, or hashes."""
    return F.lower(text).rlike("^(unit|ref|node|edge)://|graph") | text.rlike("^[0-9a-fA-F]{32,}$")
