"""Column functions over file paths and languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import any_of

#: Endings share their dot, so that a place in the path is held against few alternatives.
IGNORED = rf"\.(?:{any_of([s[1:] for s in rules.IGNORED_SUFFIXES])})$|(?:{any_of(rules.IGNORED_FILES)})$|{any_of(rules.IGNORED_FOLDERS)}"


def is_ignored_path(path: Column) -> Column:
    """Documents, data, lock files, assets and third-party folders; null stays null."""
    return F.lower(path).rlike(IGNORED)


def language_from_path(path: Column) -> Column:
    """The language of a file by its name; null if it has none or is ignored. The extension table is a
    literal of the plan, so no join is needed."""
    file = F.substring_index(path, "/", -1)
    extension = F.substring_index(file, ".", -1)

    def lookup(table: dict[str, str], key: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)

    named = F.when(extension == file, lookup(rules.FILE_NAMES, file)).otherwise(lookup(rules.EXTENSIONS, extension))
    return F.when(~is_ignored_path(path), named)


def is_application_language(language: Column) -> Column:
    return ~F.lower(language).isin(*rules.NOISE_LANGUAGES)


def sanitize_language(language: Column) -> Column:
    """The language, or null if it is the target or no application's."""
    return F.when((F.lower(language) != rules.TARGET.lower()) & is_application_language(language), language)
