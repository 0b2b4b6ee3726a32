"""Names, paths, routes and ids of symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_fqn(language: Column, path: Column, name: Column, kind: Column, parent: Column) -> Column:
    """language://path#Parent.name for members, #name for classes, the path alone for modules, else ::name."""
    base = F.concat(language, F.lit("://"), path)
    return (
        F.when(parent.isNotNull() & (parent != ""), F.concat(base, F.lit("#"), parent, F.lit("."), name))
        .when(kind == "class", F.concat(base, F.lit("#"), name))
        .when(kind == "module", base)
        .otherwise(F.concat(base, F.lit("::"), name))
    )


def name_of(fqn: Column) -> Column:
    """The last member, class or function name; of a module, the id itself."""
    member = F.substring_index(F.substring_index(fqn, "#", -1), ".", -1)
    return F.when(F.contains(fqn, F.lit("#")), member).when(F.contains(fqn, F.lit("::")), F.substring_index(fqn, "::", -1)).otherwise(fqn)


def parent_of(fqn: Column) -> Column:
    """The class of a member, null for others."""
    inner = F.substring_index(fqn, "#", -1)
    return F.when(F.contains(fqn, F.lit("#")) & F.contains(inner, F.lit(".")), F.substring_index(inner, ".", 1))


def file_of(fqn: Column) -> Column:
    """The path: what lies between :// and # or ::."""
    return F.substring_index(F.substring_index(F.regexp_extract(fqn, "^[^:]*://(.*)$", 1), "#", 1), "::", 1)


def service_of(fqn: Column) -> Column:
    """The first segment of the path."""
    return F.substring_index(F.coalesce(F.when(F.contains(fqn, F.lit("://")), file_of(fqn)), F.substring_index(F.substring_index(fqn, "#", 1), "::", 1)), "/", 1)


def normal_path(path: Column, lower: bool = False) -> Column:
    """Slashes forward, none in front."""
    out = F.ltrim(F.translate(path, "\\", "/"), F.lit("/"))
    return F.lower(out) if lower else out


def module_of(path: Column) -> Column:
    """The path without extension, dotted."""
    return F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")


def table_name(name: Column) -> Column:
    """CamelCase to snake_case, with an s in the end."""
    snake = F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_"))
    return F.when(snake.endswith("s"), snake).otherwise(F.concat(snake, F.lit("s")))


def display_name(symbol_id: Column) -> Column:
    """Scheme, class and module dropped; underscores to spaces; every letter after a non-letter upper, others lower."""
    own = F.translate(F.substring_index(F.substring_index(symbol_id, "#", -1), "::", -1), "_", " ")
    words = F.regexp_extract_all(F.lower(own), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def visibility_of(name: Column) -> Column:
    """Dunder names are public, other names with an underscore in front private."""
    dunder = name.startswith("__") & name.endswith("__")
    return F.when(dunder, "public").when(name.startswith("_"), "private").otherwise("public")


def route_method(route: Column) -> Column:
    """The method before the path, ANY if unknown, GET if there is none."""
    first = F.upper(F.substring_index(route, " ", 1))
    known = first.isin("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "ANY")
    return F.when(~F.contains(route, F.lit(" ")), "GET").when(known, first).otherwise("ANY")


def route_path(route: Column) -> Column:
    """What follows the method."""
    return F.when(F.contains(route, F.lit(" ")), F.element_at(F.split(route, " ", 2), 2)).otherwise(route)


def adler32(text: Column) -> Column:
    """Adler-32 of the UTF-8 bytes."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(s: Column, c: Column) -> Column:
        a = (s["a"] + c) % 65521
        return F.struct(a.alias("a"), ((s["b"] + a) % 65521).alias("b"))

    return F.aggregate(codes, start, step, lambda s: s["b"] * 65536 + s["a"])


def location(text: Column) -> tuple[Column, Column, Column]:
    """file, first and last line of file[:a[-b]]."""
    pattern = r"^(.*?)(?::(\d+)(?:-(\d+))?)?$"
    a = F.regexp_extract(text, pattern, 2)
    b = F.regexp_extract(text, pattern, 3)
    first = F.when(a != "", a.cast("int")).otherwise(0)
    return F.regexp_extract(text, pattern, 1), first, F.when(b != "", b.cast("int")).otherwise(first)


def hundredths(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to two places, half up, in integers; both are integers and the denominator is positive."""
    return F.floor((numerator * 200 + denominator) / (denominator * 2)) / 100


def legacy_id(language: Column, path: Column, name: Column, kind: Column, parent: Column) -> Column:
    """As symbol_fqn, but a module's id has its name."""
    return symbol_fqn(language, path, name, F.when(kind == "module", F.lit("")).otherwise(kind), parent)


def import_id(language: Column, path: Column, imported: Column) -> Column:
    """language://path::import::first part of the imported name."""
    return F.concat(language, F.lit("://"), path, F.lit("::import::"), F.substring_index(imported, ".", 1))


def blob_text(encoded: Column) -> Column:
    """The text of a base64 blob with line breaks; null if it is no UTF-8."""
    return F.try_validate_utf8(F.unbase64(F.regexp_replace(encoded, r"\s", "")).cast("string"))


def instant(time: Column) -> Column:
    """ISO 8601 in UTC, to the second; run ids and records carry it."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def first_length(*arrays: Column) -> Column:
    """The length of the first array that is there, 0 if none is."""
    return F.coalesce(*[F.when(a.isNotNull(), F.size(a)) for a in arrays], F.lit(0))
