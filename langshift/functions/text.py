"""Column functions over names, phrases and titles.

All of them stay inside the JVM. Phrase matches are plain substrings of lower-case text. Null in, null
or false out, as stated; no function raises on any text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

#: White space, and what is no letter or digit, in the sense of Unicode.
SPACE = r"(?U)\s"
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"


def literal(text: str) -> str:
    """A regular expression for exactly this text (Java's and RE2's syntax)."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def any_of(phrases: list[str]) -> str:
    return "|".join(map(literal, phrases))


def has_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase is in the text; false for null."""
    return F.coalesce(text.rlike(any_of(phrases)), F.lit(False))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^\s+|\s+$", "")


def normalize_slug(slug: Column) -> Column:
    """Owner and name in lower case, from either of them or a URL."""
    bare = F.regexp_replace(F.regexp_replace(trim_space(slug), "^(https://github\\.com/)+", ""), "^(http://github\\.com/)+", "")
    return F.lower(F.regexp_replace(bare, "/+$", ""))


def normalize_repo_url(repo: Column) -> Column:
    """A repository's URL, from a URL or from owner and name."""
    named = F.concat(F.lit("https://github.com/"), F.regexp_replace(repo, "^/+|/+$", ""))
    return F.when(repo.rlike("^https?://"), F.regexp_replace(repo, "/+$", "")).otherwise(named)


def repo_name(full_name: Column) -> Column:
    return F.substring_index(full_name, "/", -1)


def truncate_title(title: Column, most: int = 120) -> Column:
    return F.when(F.char_length(title) > most, F.concat(F.substring(title, 1, most), F.lit("…"))).otherwise(title)


def combined_text(description: Column, signals: Column) -> Column:
    """Description and signal details in lower case, in order, with blanks between."""
    details = F.transform(signals, lambda s: F.concat(F.lit(" "), F.coalesce(s["detail"], F.lit(""))))
    return F.lower(F.concat(F.coalesce(description, F.lit("")), F.coalesce(F.array_join(details, ""), F.lit(""))))


def named_migration_verb(text: Column) -> Column:
    """Whether a migration verb and its end enclose a name; only the first verb of each kind and the
    first end after it count."""
    found = F.lit(False)
    for verb, end in rules.NAMED_VERBS:
        # One group: empty without a match, and a blank gap names nothing either.
        gap = F.regexp_extract(text, rf"(?s){verb}(.*?){end}", 1)
        # The plain searches come first, because most texts have no such phrase.
        found = found | (F.contains(text, F.lit(verb)) & F.contains(text, F.lit(end)) & ~trim_space(gap).isin("", "in", "to"))
    return F.coalesce(found, F.lit(False))


def in_place(text: Column) -> Column:
    return has_any(text, rules.IN_PLACE) | named_migration_verb(text)


def external_port(text: Column) -> Column:
    return has_any(text, rules.EXTERNAL_PORT)


def competitor(text: Column) -> Column:
    return has_any(text, rules.COMPETITOR)


def targeted(text: Column) -> Column:
    return has_any(text, rules.TARGETED) | named_migration_verb(text)


def about_api(text: Column) -> Column:
    return has_any(text, rules.API_MARKERS)


def clean_origin(after: Column) -> Column:
    """The name at the start of a text: up to the earliest stop, without quotes and articles, at most
    five words; empty if nothing is left."""
    name = F.regexp_replace(after, rf"(?U)^[\s`\"':-]+", "")
    name = F.regexp_extract(name, rf"(?s)^(.*?)(?:{any_of(rules.ORIGIN_STOPS)}|\z)", 1)
    name = F.regexp_replace(trim_space(name), "^[`\"']+|[`\"']+$", "")
    for article in rules.ARTICLES:
        name = F.regexp_replace(name, f"^{article}", "")
    words = F.filter(F.split(name, rf"{SPACE}+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, 5), " ")


def after_first(text: Column, marker: str | Column) -> Column:
    """What follows the first occurrence of the marker; null without one."""
    marker = F.lit(marker) if isinstance(marker, str) else marker
    at = F.position(marker, text)
    return F.when(at > 0, F.substr(text, at + F.char_length(marker)))


def first_name(candidates: Column) -> Column:
    """The first entry of an array that is neither null nor empty; else null."""
    return F.try_element_at(F.filter(candidates, lambda n: F.coalesce(n != "", F.lit(False))), F.lit(1))


def extract_named_origin(text: Column) -> Column:
    """What a lower-case text says it is a port, rewrite, replacement and so on of; else null."""
    markers = F.array(*map(F.lit, rules.ORIGIN_MARKERS))
    return first_name(F.transform(markers, lambda m: clean_origin(after_first(text, m))))


def extract_rewritten_subject(text: Column) -> Column:
    """What a lower-case text says was rewritten; else null."""

    def subject(marker: Column) -> Column:
        at = F.position(marker, text)
        before = F.regexp_replace(F.when(at > 0, F.substr(text, F.lit(1), at - 1)), rf"(?U)\s+$", "")
        clause = trim_space(F.regexp_replace(before, r"(?s)^.*[:—.;|]", ""))
        return clean_origin(trim_space(F.regexp_replace(clause, "(?s)^.*,", "")))

    return first_name(F.transform(F.array(*map(F.lit, rules.SUBJECT_MARKERS)), subject))


def generic_signal(detail: Column) -> Column:
    """Whether a signal's text is a rule's own wording, which names no origin."""
    starts = "|".join(f"^{literal(s)}" for s in rules.GENERIC_STARTS)
    return F.lower(detail).rlike(f"{any_of(rules.GENERIC_CONTAINED)}|{starts}")


def named_origin(description: Column, signals: Column, curated: Column) -> Column:
    """The curated label, or what the description or else the first signal that does so names."""

    def of(text: Column) -> Column:
        return F.coalesce(extract_named_origin(text), extract_rewritten_subject(text))

    told = F.filter(signals, lambda s: ~generic_signal(s["detail"]))
    from_signals = F.try_element_at(F.filter(F.transform(told, lambda s: of(F.lower(s["detail"]))), lambda n: n.isNotNull()), F.lit(1))
    return F.coalesce(curated, of(F.lower(description)), from_signals)


def strong_rewrite_signal(description: Column, signals: Column) -> Column:
    """Whether the description, or a repository or pull-request signal, speaks of replacing or migrating something."""

    def speaks(text: Column) -> Column:
        return competitor(text) | targeted(text) | in_place(text)

    heard = F.exists(signals, lambda s: s["kind"].isin("repo-search", "pull-request") & speaks(F.lower(s["detail"])))
    return speaks(F.lower(F.coalesce(description, F.lit("")))) | F.coalesce(heard, F.lit(False))


def significant_tokens(text: Column) -> Column:
    """Words of three bytes and more that can identify a product."""
    words = F.split(F.lower(text), NOT_ALNUM)
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*rules.STOPWORDS))


def product_slug(full_name: Column) -> Column:
    """The repository's name in lower case, without the first ending of the list that leaves three characters."""
    name = F.lower(repo_name(full_name))
    slug = F.lit(None).cast("string")
    for suffix in rules.SLUG_SUFFIXES:
        slug = F.coalesce(slug, F.when(name.endswith(suffix) & (F.octet_length(name) >= 3 + len(suffix)), F.substr(name, F.lit(1), F.char_length(name) - len(suffix))))
    return F.coalesce(slug, name)


def tokens_overlap(a: Column, b: Column) -> Column:
    """Whether two lists share a token, or have two of six bytes and more of which one begins with the other."""

    def alike(t: Column, u: Column) -> Column:
        return (t == u) | ((F.octet_length(t) >= 6) & (F.octet_length(u) >= 6) & (u.startswith(t) | t.startswith(u)))

    return F.coalesce(F.exists(a, lambda t: F.exists(b, lambda u: alike(t, u))), F.lit(False))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, NOT_ALNUM, "")


def compact_identity(a: Column, b: Column, least: int) -> Column:
    """Whether two names, reduced to letters and digits, are equal or one begins with the other."""
    a, b = compact(a), compact(b)
    return F.coalesce((F.octet_length(a) >= least) & (F.octet_length(b) >= least) & (a.startswith(b) | b.startswith(a)), F.lit(False))


def product_before_phrase(text: Column) -> Column:
    """The product named in the four words before a rewrite phrase; else null."""

    def product(marker: Column) -> Column:
        at = F.position(marker, text)
        words = F.filter(F.split(F.when(at > 0, F.substr(text, F.lit(1), at - 1)), rf"{SPACE}+"), lambda w: w != "")
        last = F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), F.lit(4))
        bare = F.transform(last, lambda w: F.regexp_replace(w, rf"^{NOT_ALNUM}+|{NOT_ALNUM}+$", ""))
        telling = F.transform(bare, lambda w: ~w.isin(*rules.STOPWORDS, *rules.FLUFF))
        start = F.array_position(telling, True)
        outer = r"[^\p{IsAlphabetic}\p{N}-]"
        named = F.transform(F.slice(last, F.greatest(start, F.lit(1)).cast("int"), F.lit(4)), lambda w: F.regexp_replace(w, f"^{outer}+|{outer}+$", ""))
        return F.when(start > 0, F.array_join(F.filter(named, lambda w: w != ""), " "))

    return first_name(F.transform(F.array(*map(F.lit, rules.PRODUCT_MARKERS)), product))


def signal_title(detail: Column) -> Column:
    """What follows the first colon and blank, if anything does; else all."""
    title = after_first(detail, ": ")
    return F.when(F.coalesce(title != "", F.lit(False)), title).otherwise(detail)


def migration_discussion(detail: Column) -> Column:
    title = F.lower(signal_title(detail))
    return F.coalesce(title.contains("rust"), F.lit(False)) & has_any(title, rules.DISCUSSION_STEMS)


def wishful(detail: Column) -> Column:
    return has_any(F.lower(signal_title(detail)), rules.WISHES)


def product_migration_signal(detail: Column, slug: Column, slug_tokens: Column, owner_tokens: Column) -> Column:
    """Whether an issue or pull request discusses the migration of this very product."""
    title = F.lower(signal_title(detail))
    tokens = significant_tokens(title)
    small = compact(slug)
    inside = (F.octet_length(small) >= 4) & F.contains(compact(title), small)
    own = ~has_any(title, rules.WISHES) & has_any(title, rules.OWN_CODE)
    return migration_discussion(detail) & (tokens_overlap(tokens, slug_tokens) | tokens_overlap(tokens, owner_tokens) | F.coalesce(inside, F.lit(False)) | own)


def pr_relevance(title: Column) -> Column:
    text = F.lower(title)
    return sum((F.when(has_any(text, phrases), points).otherwise(0) for points, phrases in rules.RELEVANCE), F.lit(0))


def pr_number(url: Column) -> Column:
    """The last part of a URL as a number, else null."""
    last = F.substring_index(url, "/", -1)
    return F.when(last.rlike(r"^\+?[0-9]+$"), last.try_cast("bigint"))


def match_agent(coauthor: Column) -> Column:
    """The first agent of the list that a trailer names; else null."""
    text = F.lower(coauthor)
    cases = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, needles in rules.AGENTS:
        cases = cases.when(has_any(text, needles), name)
    return cases
