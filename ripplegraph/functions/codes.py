"""Integer codes of enumerated strings, and common names of frameworks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The place in each tuple is the code, from 1; unknown and empty strings have the code 0.
CODES = {
    "kind": ("class", "function", "method", "import", "variable", "endpoint", "worker", "task", "route", "property", "attribute", "parameter", "module", "package", "interface", "enum", "constant", "type_alias", "decorator", "exception"),
    "lang": ("python", "java", "typescript", "javascript", "go", "rust", "kotlin", "ruby", "csharp", "cpp", "sql", "yaml", "json", "xml", "dockerfile", "shell", "terraform", "graphql"),
    "ct": ("modified", "added", "removed", "mixed", "renamed", "copied"),
    "bh_kind": ("deep_execution", "shared_execution", "boundary_crossing", "event_publication", "hidden_relationship", "public_interface_change", "shared_dependency", "state_mutation", "validation_gap", "entry_point", "terminal_point", "reachable_unit", "execution_chain"),
    "cls": ("modification", "addition", "removal", "refactor", "fix", "feature", "mixed"),
    "scope": ("local", "multi_file", "cross_package", "cross_service", "global"),
    "method": ("POST", "GET", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "worker", "event", "cron", "webhook"),
}

# Frameworks and what they stand for.
ENTRY_KINDS = {
    "fastapi": "rest_endpoint", "flask": "rest_endpoint", "django": "rest_endpoint", "django-rest-framework": "rest_endpoint", "spring": "rest_endpoint", "spring-boot": "rest_endpoint", "jax-rs": "rest_endpoint",
    "click": "cli_command", "typer": "cli_command", "argparse": "cli_command", "celery-beat": "scheduled_job", "spring-scheduled": "scheduled_job", "apscheduler": "scheduled_job",
    "celery": "worker_entry", "dramatiq": "worker_entry", "rq": "worker_entry", "spring-jms": "worker_entry",
}
TEST_FRAMEWORKS = {"pytest": "pytest", "unittest": "unittest", "junit": "junit", "junit5": "junit", "testng": "testng", "mockito": "mockito", "cucumber": "cucumber"}
PERSISTENCE = {"sqlalchemy": "sqlalchemy", "django": "django_orm", "tortoise": "tortoise_orm", "jpa": "jpa", "hibernate": "hibernate", "spring_data": "spring_data", "mongoose": "mongoose", "prisma": "prisma"}


def looked_up(value: Column, table: dict, default) -> Column:
    """The table's entry, or the default."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), default if isinstance(default, Column) else F.lit(default))


def code_of(table: str, value: Column) -> Column:
    return looked_up(value, {v: k + 1 for k, v in enumerate(CODES[table])}, 0)


def text_of(table: str, code: Column) -> Column:
    return looked_up(code, {k + 1: v for k, v in enumerate(CODES[table])}, "")


# The values that a fact's column may have, the first of which stands for any other.
FALLBACKS = {
    "kind": ("function", "class", "method", "import", "variable", "interface", "enum", "constant", "type_alias", "module"),
    "visibility": ("public", "private", "protected", "internal"),
    "import_type": ("standard", "relative", "wildcard", "dynamic"),
    "call_type": ("direct", "indirect", "dynamic", "async"),
    "relation": ("extends", "implements", "mixin", "composes"),
    "method": ("ANY", "GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"),
    "access": ("read", "write", "read_write"),
    "publication": ("publish", "emit", "dispatch"),
    "subscription": ("subscribe", "consume", "handle"),
}


def fallen_back(table: str, value: Column) -> Column:
    """The value where the table knows it, else the table's first."""
    known = FALLBACKS[table]
    low = F.upper(value) if table == "method" else F.lower(value)
    return F.when(low.isin(*known), low).otherwise(known[0])
