"""Column expressions on paths and change records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the file policy.
MAX_FILE_BYTES = 1024 * 1024
KINDS = {
    "code": (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"),
    "document": (".md", ".mdx", ".txt"),
    "config": (".json", ".yaml", ".yml"),
}
GENERATED_DIRECTORIES = ("node_modules", "dist", "build", "out", "coverage", ".next", ".turbo")
GENERATED_FILES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml")
TEST_DIRECTORIES = ("test", "tests", "__tests__")
#: What is tried, in this order, after the joined path of an import.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")
SOURCE_SUFFIXES = (".ts", ".tsx")


def _in(value: Column, names) -> Column:
    return value.isin(*names)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The directory, empty for a file in the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def extension(path: Column) -> Column:
    """Lower-case extension; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    return F.when(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1) == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1))


def kind(path: Column) -> Column:
    e, out = extension(path), None
    for name, ends in KINDS.items():
        out = F.when(_in(e, ends), name) if out is None else out.when(_in(e, ends), name)
    return out


def is_generated(path: Column) -> Column:
    folder = F.arrays_overlap(directories(path), F.array(*[F.lit(d) for d in GENERATED_DIRECTORIES]))
    name = F.lower(basename(path))
    return folder | _in(name, GENERATED_FILES) | name.rlike(r"\.min\.(js|mjs|cjs)$")


def exclusion(mode: Column, path: Column, size: Column) -> Column:
    """Why an entry is left out, null if it is not."""
    return (
        F.when(mode == "120000", "symlink").when(mode == "160000", "submodule").when(is_generated(path), "generated").when(kind(path).isNull(), "unsupported_type")
        .when(size.isNull() | (size > MAX_FILE_BYTES), "oversized")
    )


def is_test(path: Column) -> Column:
    return path.contains(".test.") | path.contains(".spec.")


def path_class(path: Column, kind_: Column) -> Column:
    """source, test, doc or ignored, as the evaluation sees a path."""
    in_tests = F.arrays_overlap(directories(path), F.array(*[F.lit(d) for d in TEST_DIRECTORIES]))
    log = basename(path).rlike("(?i)^(changelog|changes|history)") | path.startswith(".changeset/")
    return (
        F.when(kind_ == "code", F.when(is_test(path) | in_tests, "test").otherwise("source")).when(kind_ == "document", F.when(log, "ignored").otherwise("doc")).otherwise("ignored")
    )


def dialect(path: Column) -> Column:
    return F.when(path.endswith(".ts"), "typescript").when(path.rlike(r"\.(tsx|js|jsx)$"), "typescript-jsx")


def normalise(path: Column) -> Column:
    """Resolves . and .. of a relative path; leading .. that lead out of the root are kept."""
    return F.array_join(
        F.aggregate(
            F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")),
            F.array().cast("array<string>"),
            lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
                F.concat(done, F.array(p))
            ),
        ),
        "/",
    )


def join_relative(source: Column, specifier: Column) -> Column:
    return normalise(F.concat(dirname(source), F.lit("/"), specifier))


def candidates(joined: Column, specifier: Column) -> Column:
    """Paths an import may mean, with their priority."""
    plain = [F.struct(F.concat(joined, F.lit(s)).alias("path"), F.lit(i).alias("priority")) for i, s in enumerate(SUFFIXES)]
    cut = F.regexp_replace(joined, r"\.js$", "")
    typed = [F.struct(F.concat(cut, F.lit(s)).alias("path"), F.lit(len(SUFFIXES) + i).alias("priority")) for i, s in enumerate(SOURCE_SUFFIXES)]
    fallback = specifier.endswith(".js") & (cut != "") & ~cut.endswith("/")
    return F.concat(F.array(*plain), F.when(fallback, F.array(*typed)).otherwise(F.slice(F.array(*typed), 1, 0)))


def stem(path: Column) -> Column:
    """The path without whatever :func:`candidates` may put at its end: what an import is joined to and every path it may mean have the same."""
    return F.regexp_replace(path, r"(?:\.[jt]sx?|/index)+\z", "")


def is_portable(path: Column) -> Column:
    """A relative path without drive, backslash, NUL, and empty or dot segments."""
    bad = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return (F.length(path) > 0) & ~path.rlike(r"^([A-Za-z]:|/)|[\\\x00]") & ~bad


def is_commit_id(text: Column) -> Column:
    return F.lower(text).rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")


def change_paths(changes: Column) -> Column:
    """Distinct paths of change records in order, the old one of a rename before the new one."""
    each = F.transform(changes, lambda c: F.when(c["previous_path"].isNotNull(), F.array(c["previous_path"], c["path"])).otherwise(F.array(c["path"])))
    return F.array_distinct(F.flatten(each))


def describe_change(status: Column, previous: Column, similarity: Column) -> Column:
    return (
        F.when(status == "renamed", F.concat(F.lit("renamed from "), previous, F.lit(" ("), similarity.cast("string"), F.lit("% similar)")))
        .when(status == "type_changed", F.lit("type changed")).otherwise(status)
    )
