"""Column expressions on text: tokens, query terms, categories."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and path terms that a query does not look up.
STOP_WORDS = (
    "and or the a an in on at to for of with from by as is are was were it this that these those "
    "ts js md src index backend frontend docs test spec file across full stack some"
).split()
MIN_TERM = 3
#: Categories from the strongest to the weakest.
LEXICAL = ("path-and-multi-content", "high-content-density", "path-only", "multiple-terms", "single-term")
CATEGORIES = ("critical-structural", "path-and-multi-content", "high-content-density", "weak-structural", "path-only", "multiple-terms", "single-term")


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


#: A part of an identifier: it goes on until an underscore or a change from a lower-case to an upper-case letter.
_PART = r"[^_](?:(?!(?<=\p{Ll})\p{Lu})[^_])*"


def identifier_parts(identifier: Column) -> Column:
    """Lower-case parts between underscores and at changes from a lower-case to an upper-case letter."""
    return F.transform(F.regexp_extract_all(identifier, F.lit(_PART), F.lit(0)), F.lower)


def _with_joined(parts: Column) -> Column:
    return F.when(F.size(parts) > 1, F.concat(parts, F.array(F.array_join(parts, "")))).otherwise(parts)


def tokenize(text: Column) -> Column:
    """Distinct tokens in order of appearance: parts of identifiers, and joined identifiers of several parts. Null has none.

    Identifiers are made distinct first and only compound ones are taken apart, which is most of the cost.
    """
    each = F.array_distinct(identifiers(F.coalesce(text, F.lit(""))))
    found = F.transform(each, lambda i: F.when(i.rlike(r"_|\p{Ll}\p{Lu}"), _with_joined(identifier_parts(i))).otherwise(F.array(F.lower(i))))
    return F.array_distinct(F.flatten(found))


def searchable(tokens: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens, lambda t: (F.length(t) >= MIN_TERM) & ~F.array_contains(stop, t))


def query_terms(text: Column, symbols: Column | None = None) -> Column:
    """Terms to look up: searchable tokens of the text, and of each symbol its joined form and searchable parts."""
    terms = searchable(tokenize(text))
    if symbols is None:
        return terms
    each = F.flatten(F.transform(symbols, identifiers))
    joined = F.filter(F.transform(each, lambda i: F.array_join(identifier_parts(i), "")), lambda t: F.length(t) > 0)
    parts = searchable(F.flatten(F.transform(each, identifier_parts)))
    return F.array_distinct(F.concat(terms, joined, parts))


def lexical_query_text(description: Column, changed_paths: Column) -> Column:
    return F.concat_ws(" ", description, F.array_join(F.transform(changed_paths, lambda p: F.element_at(F.split(p, "/"), -1)), " "))


def semantic_query_text(description: Column, changed_paths: Column) -> Column:
    listed = F.array_join(F.transform(changed_paths, lambda p: F.concat(F.lit("- "), p)), "\n")
    return F.concat(F.lit("search_query: Change Description: "), description, F.lit("\nFiles Modified:\n"), listed)


def lexical_category(terms: Column, path_terms: Column) -> Column:
    return (
        F.when((path_terms > 0) & (terms >= 3), LEXICAL[0]).when(terms >= 5, LEXICAL[1]).when(path_terms > 0, LEXICAL[2]).when(terms >= 2, LEXICAL[3]).when(terms >= 1, LEXICAL[4])
    )


def deterministic_category(lexical: Column, incoming: Column, outgoing: Column) -> Column:
    """``incoming``: the file imports a changed one or is a test of it; ``outgoing``: a changed one imports it. Neither, nor terms: an error."""
    return (
        F.when(incoming, CATEGORIES[0]).when(lexical.isin(*LEXICAL[:2]), lexical).when(outgoing, CATEGORIES[3])
        .when(lexical.isNotNull(), lexical).otherwise(F.raise_error(F.lit("a candidate needs a lexical match or a structural signal")))
    )


def precedence(category: Column, order: Iterable[str] = CATEGORIES) -> Column:
    """Place in the order from 1; unknown and null come last."""
    names = list(order)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.coalesce(category, F.lit("")))
    return F.when(place == 0, len(names) + 1).otherwise(place).cast("int")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_order(text: Column) -> Column:
    """Sort key in UTF-16 code units; plain byte order unless a character lies beyond U+D7FF."""
    return F.hex(F.encode(text, "UTF-16BE"))


def excerpt(text: Column, most: int) -> Column:
    """``text, truncated, total_chars`` of the first ``most`` UTF-16 code units; a character of two units is never cut."""
    units = F.encode(F.substring(text, 1, most), "UTF-16BE")
    # So many units end in half a character if the last one is a leading surrogate.
    half = F.substring(F.hex(F.substring(units, 2 * most - 1, 2)), 1, 2).between("D8", "DB")
    kept = F.decode(F.substr(units, F.lit(1), F.when(half, 2 * most - 2).otherwise(2 * most)), "UTF-16BE")
    return F.struct(kept.alias("text"), (utf16_length(text) > most).alias("truncated"), utf16_length(text).alias("total_chars"))


def digest_key(sha256: Column) -> Column:
    """A digest in hexadecimal letters as bytes, half as long, to join by; other texts are longer than any of these."""
    return F.when(sha256.rlike("^[0-9a-f]{64}$"), F.unhex(sha256)).otherwise(F.encode(F.concat(F.lit(" " * 33), sha256), "UTF-8"))


def input_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def source_of_input(text: Column, path: Column, chunk_index: Column, whole: Column) -> Column:
    """The source text inside an embedding input, null where its framing is missing."""
    frame = F.when(whole, F.concat(F.lit("search_document: File: "), path, F.lit("\n\n"))).otherwise(
        F.concat(F.lit("search_document: File: "), path, F.lit(" (Chunk "), chunk_index.cast("string"), F.lit(")\n\n"))
    )
    return F.when(F.startswith(text, frame), F.substr(text, F.length(frame) + 1))


def issue_references(message: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(r"#(\d+)"), F.lit(1)))


def legacy_terms(text: Column) -> Column:
    """Terms of the older baseline: words split at case changes and non-letters, longer than two, without stop words."""
    parts = F.split(F.lower(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    return F.array_distinct(searchable(parts))
