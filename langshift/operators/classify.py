"""Rewrite, replacement or neither: the provenance of a project.

Input: candidates with description, signals (kind, detail, url), full_name, the language mix, and from
the history from_language and strong. Regular expressions over free text are costly, so this runs on
candidates, not on listings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import paths, text


def owner(full_name: Column) -> Column:
    return F.lower(F.substring_index(full_name, "/", 1))


def with_origin(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows with named_origin. ``origins``: slug, label, a small curated table of fixed size (broadcast)."""
    curated = F.broadcast(origins.select(F.col("slug").alias("_slug"), F.col("label").alias("_label")))
    joined = rows.withColumn("_key", text.normalize_slug(F.col("full_name"))).join(curated, F.col("_key") == F.col("_slug"), "left")
    origin = text.named_origin(F.col("description"), F.col("signals"), F.col("_label"))
    return joined.withColumn("named_origin", origin).drop("_key", "_slug", "_label")


def identity_continuity(rows: DataFrame) -> Column:
    """Whether a candidate is itself the product that migrates, by its names and its signals.

    Needs the columns of ``with_evidence``."""
    slug, own, owners = F.col("_slug"), F.col("_tokens"), F.col("_owners")

    def overlaps(name: Column) -> Column:
        tokens = text.significant_tokens(name)
        return text.tokens_overlap(tokens, own) | text.tokens_overlap(tokens, owners)

    product = text.product_before_phrase(F.col("_text"))
    dashed = F.replace(product, F.lit(" "), F.lit("-"))
    by_product = overlaps(product) | F.contains(dashed, slug) | F.contains(slug, dashed) | text.compact_identity(product, slug, 5)
    origin = F.col("named_origin")
    by_origin = overlaps(origin) | text.compact_identity(origin, slug, 6)
    by_rewrite = F.lit(False)
    for marker in text.rules.REWRITE_OF_MARKERS:
        name = text.clean_origin(text.after_first(F.col("_text"), marker))
        by_rewrite = by_rewrite | text.tokens_overlap(text.significant_tokens(name), own)
    discussed = F.exists("signals", lambda s: s["kind"].isin("pull-request", "issue") & text.product_migration_signal(s["detail"], slug, own, owners))
    return F.coalesce(by_product, F.lit(False)) | F.coalesce(by_origin, F.lit(False)) | by_rewrite | F.coalesce(discussed, F.lit(False))


def with_evidence(rows: DataFrame) -> DataFrame:
    """Rows with what the cascade of ``classify_kind`` asks for.

    Text, names and origin are written down first: the optimizer would else put their long expressions
    in each of the dozens of places that use them."""
    slug = text.product_slug(F.col("full_name"))
    rows = rows.withColumns({"_text": text.combined_text(F.col("description"), F.col("signals")), "_slug": slug, "_tokens": text.significant_tokens(slug), "_owners": text.significant_tokens(owner(F.col("full_name")))})
    rows = shared.cut_lineage(rows)
    talk = F.exists("signals", lambda s: s["kind"].isin("pull-request", "issue") & text.migration_discussion(s["detail"]) & ~text.wishful(s["detail"]))
    return rows.withColumns(
        {
            "identity": identity_continuity(rows),
            "in_place": text.in_place(F.col("_text")),
            "external": text.external_port(F.col("_text")),
            "competitor": text.competitor(F.col("_text")),
            "targeted": text.targeted(F.col("_text")),
            "api": text.about_api(F.col("_text")) | F.coalesce(text.about_api(F.col("named_origin")), F.lit(False)),
            "migration_pr": F.coalesce(talk, F.lit(False)),
            "real": F.coalesce(paths.is_application_language(F.col("original_language")), F.lit(False)),
            "hist": F.coalesce(F.col("strong") & paths.is_application_language(F.col("from_language")), F.lit(False)),
        }
    )


EVIDENCE = ["identity", "in_place", "external", "competitor", "targeted", "api", "migration_pr", "real", "hist"]
PRIVATE = ["_text", "_slug", "_tokens", "_owners"]


def kind_of() -> Column:
    """The cascade over the evidence columns: the first case that holds decides."""
    c = {name: F.col(name) for name in EVIDENCE}
    origin = F.col("named_origin").isNotNull()
    ported = c["external"] | c["competitor"]
    migration = c["in_place"] | ported
    displaced = origin | c["real"] | c["competitor"]
    return (
        F.when(c["api"], "neither")
        .when(c["identity"] & (c["hist"] | c["migration_pr"]), "rewrite")
        .when(ported & ~c["identity"] & displaced, "replacement")
        .when(c["hist"] & migration & ~c["identity"], "replacement")
        .when(c["identity"] & ~c["hist"] & ~c["migration_pr"] & (c["in_place"] | c["external"]), "replacement")
        .when(ported & displaced, "replacement")
        .when(c["in_place"] & (c["real"] | c["targeted"]) & ~c["identity"], "replacement")
        .otherwise("neither")
    )


def classify_kind(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Candidates with named_origin and project_kind."""
    judged = shared.cut_lineage(with_evidence(with_origin(rows, origins)))
    return judged.withColumn("project_kind", kind_of()).drop(*EVIDENCE, *PRIVATE)
