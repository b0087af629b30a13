"""From alias-tolerant catalogue rows to the fixed canonical record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.base import bound
from epochlens.functions.dates import DateRules, normalize_dates, parse_bool, trimmed
from epochlens.operators.quality import dense_offsets

# Institutions by id prefix, and the addresses of their records.
INSTITUTIONS = {"MET": "met", "AIC": "aic", "RIJKS": "rijksmuseum"}
RECORD_URLS = {"met": "https://www.metmuseum.org/art/collection/search/", "aic": "https://www.artic.edu/artworks/"}
CC0 = "https://creativecommons.org/publicdomain/zero/1.0/"
NULL_WORDS = ("null", "none", "nan")
# The canonical columns in their order.
CANONICAL_FIELDS = (
    "artwork_id", "physical_object_id", "visual_cluster_id", "institution", "source_id", "source_record_url", "source_dataset_version", "title", "artist", "object_type", "medium", "culture", "department", "classification",
    "period", "dynasty", "geography", "tags", "object_wikidata_url", "date_display", "date_start", "date_end", "date_qualifier", "date_parse_method", "metadata_license", "image_rights_uri", "credit_line", "public_domain",
    "image_available", "image_url", "image_sha256", "image_width", "image_height", "embedding_offset",
)
# Canonical columns that are the first non-empty of some source columns.
PLAIN = {
    "title": ("title",), "artist": ("artist", "artist_name"), "object_type": ("object_type", "object_name"), "culture": ("culture",), "department": ("department",), "classification": ("classification",),
    "period": ("period",), "dynasty": ("dynasty",), "geography": ("geography",), "tags": ("tags",), "object_wikidata_url": ("object_wikidata_url",), "image_rights_uri": ("image_rights_uri", "rights_uri"),
    "credit_line": ("credit_line",), "image_url": ("image_url",), "image_width": ("image_width",), "image_height": ("image_height",),
}
# Columns of the museum export, and where they go.
MUSEUM_REQUIRED = ("Object ID", "Is Public Domain", "Object Date", "Object Begin Date", "Object End Date")
MUSEUM_FIELDS = {"title": "Title", "artist": "Artist Display Name", "object_type": "Object Name", "medium": "Medium", "culture": "Culture", "department": "Department", "classification": "Classification", "period": "Period", "dynasty": "Dynasty", "tags": "Tags", "object_wikidata_url": "Object Wikidata URL", "date_display": "Object Date", "credit_line": "Credit Line"}
GEOGRAPHY = ("City", "State", "Country", "Region", "Subregion", "Locale", "Locus")


def clean(c: Column) -> Column:
    """Trimmed text; words for null become the empty text."""
    return bound(trimmed(c), lambda t: F.when(F.lower(t).isin(*NULL_WORDS), "").otherwise(t))


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of the existing columns that isn't empty after clean()."""
    return F.coalesce(*[F.nullif(clean(df[n]), F.lit("")) for n in names if n in df.columns], F.lit(""))


def json_list_text(c: Column) -> Column:
    """Items of a JSON array, trimmed, joined by "; "; anything else as it is."""
    def of(t: Column) -> Column:
        items = F.filter(F.transform(F.from_json(t, "array<string>"), trimmed), lambda x: x != "")
        return F.when(t.rlike(r"^\[[\s\S]*\]$") & F.from_json(t, "array<string>").isNotNull(), F.array_join(items, "; ")).otherwise(t)

    return bound(clean(c), of)


def joined(*parts: Column) -> Column:
    return F.concat_ws("; ", *[F.nullif(p, F.lit("")) for p in parts])


def medium(df: DataFrame) -> Column:
    parts = [json_list_text(df[c]) for c in ("materials", "techniques") if c in df.columns]
    own = first_of(df, "medium")
    return F.when(own != "", own).otherwise(joined(*parts) if parts else F.lit(""))


def institution_of(object_id: Column, supplied: Column) -> Column:
    at = F.instr(object_id, "_")
    prefix = F.substring(object_id, F.lit(1), at - 1)
    known = F.create_map(*[F.lit(x) for kv in INSTITUTIONS.items() for x in kv])
    whole = F.when(at > 0, prefix).otherwise(object_id)
    return F.when(supplied != "", supplied).otherwise(F.coalesce(F.try_element_at(known, F.upper(whole)), F.when(at > 0, F.lower(prefix)), F.lit("unknown")))


def source_id_of(object_id: Column) -> Column:
    at = F.instr(object_id, "_")
    return F.when(at > 0, F.substring(object_id, at + 1, F.length(object_id))).otherwise(object_id)


def record_url(institution: Column, source_id: Column) -> Column:
    url = F.lit("")
    for name, start in RECORD_URLS.items():
        url = F.when((institution == name) & (source_id != ""), F.concat(F.lit(start), source_id)).otherwise(url)
    return url


def permission_status(public_domain: Column, permitted: Column) -> Column:
    return F.when(F.coalesce(public_domain, F.lit(False)), "public-domain").when(permitted, "explicitly-permitted").otherwise("unreviewed")


def canonical_records(df: DataFrame, rules: DateRules = DateRules(), revision: str = "", metadata_license: str = CC0, on_error: str = "reject") -> DataFrame:
    """The canonical columns of each row, and reject_reason: "no id" or the reason of an invalid year, else null."""
    d = normalize_dates(df, rules, on_error)
    one = lambda *names: first_of(d, *names)
    oid = one("artwork_id", "object_ID", "object_id", "id")
    inst, src = institution_of(oid, one("institution")), source_id_of(oid)
    public, available = one("public_domain", "is_public_domain"), one("image_available", "has_image")
    digest = F.lower(one("image_sha256"))
    plain = [one(*names).alias(name) for name, names in PLAIN.items()]
    return d.select(
        oid.alias("artwork_id"),
        F.coalesce(F.nullif(one("physical_object_id"), F.lit("")), oid).alias("physical_object_id"),
        F.coalesce(F.nullif(one("visual_cluster_id"), F.lit("")), F.when(digest != "", F.concat(F.lit("sha256:"), digest)), F.concat(F.lit("object:"), oid)).alias("visual_cluster_id"),
        inst.alias("institution"),
        F.coalesce(F.nullif(one("source_id"), F.lit("")), src).alias("source_id"),
        F.coalesce(F.nullif(one("source_record_url", "object_url"), F.lit("")), record_url(inst, src)).alias("source_record_url"),
        F.coalesce(F.nullif(one("source_dataset_version"), F.lit("")), F.lit(revision)).alias("source_dataset_version"),
        medium(d).alias("medium"),
        *plain,
        F.col("norm_display").alias("date_display"), F.col("norm_start").alias("date_start"), F.col("norm_end").alias("date_end"),
        F.col("norm_qualifier").alias("date_qualifier"), F.col("norm_method").alias("date_parse_method"),
        F.coalesce(F.nullif(one("metadata_license"), F.lit("")), F.lit(metadata_license)).alias("metadata_license"),
        F.when(public != "", parse_bool(public)).alias("public_domain"),
        F.when(available != "", parse_bool(available)).otherwise(one("image_url", "image_path") != "").alias("image_available"),
        digest.alias("image_sha256"),
        permission_status(F.when(public != "", parse_bool(public)), parse_bool(one("image_use_permitted"))).alias("permission_status"),
        F.when(oid == "", "no id").otherwise(F.col("norm_error")).alias("reject_reason"),
    )


def canonical_corpus(records: DataFrame) -> DataFrame:
    """CANONICAL_FIELDS of the records that weren't rejected, with the offset of each in the order of ids."""
    return dense_offsets(records.where("reject_reason is null")).select(*CANONICAL_FIELDS)


def zero_year_blank(c: Column) -> Column:
    """Year texts with 0 blanked; text that is no integer passes."""
    return bound(trimmed(c), lambda t: F.when(t.rlike(r"^[+-]?[0-9]+$"), F.when(t.try_cast("bigint") == 0, "").otherwise(t.try_cast("bigint").cast("string"))).otherwise(t))


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def museum_rows(df: DataFrame, image_ids: DataFrame | None = None) -> DataFrame:
    """Museum export rows as canonical source rows, with object_number (null for a bad id) and image_available by membership."""
    if missing := missing_columns(df, MUSEUM_REQUIRED):
        raise ValueError("museum CSV lacks columns: " + ", ".join(missing))
    text = lambda c: trimmed(df[c]) if c in df.columns else F.lit("")
    number = F.when(text("Object ID").rlike("^[0-9]+$"), text("Object ID").try_cast("bigint"))
    d = df.withColumn("object_number", number)
    if image_ids is None:
        d = d.withColumn("image_available", F.lit(False))
    else:
        ids = image_ids.select(F.col(image_ids.columns[0]).cast("bigint").alias("__image_id")).distinct()
        d = d.join(ids, F.col("object_number") == F.col("__image_id"), "left").withColumn("image_available", F.col("__image_id").isNotNull())
    oid, public = F.concat(F.lit("MET_"), F.col("object_number").cast("string")), parse_bool(text("Is Public Domain"))
    url = F.when(text("Link Resource") != "", text("Link Resource")).otherwise(F.concat(F.lit(RECORD_URLS["met"]), F.col("object_number").cast("string")))
    return d.select(
        "object_number", oid.alias("artwork_id"), oid.alias("physical_object_id"), F.concat(F.lit("object:"), oid).alias("visual_cluster_id"), F.lit("met").alias("institution"),
        F.col("object_number").cast("string").alias("source_id"), url.alias("source_record_url"), *[text(c).alias(name) for name, c in MUSEUM_FIELDS.items()],
        joined(*[text(c) for c in GEOGRAPHY]).alias("geography"), zero_year_blank(text("Object Begin Date")).alias("date_start"), zero_year_blank(text("Object End Date")).alias("date_end"),
        F.lit(CC0).alias("metadata_license"), F.when(public & F.col("image_available"), CC0).otherwise("").alias("image_rights_uri"), public.alias("public_domain"), "image_available",
    )


def museum_corpus(rows: DataFrame, rules: DateRules, renormalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): museum_rows() with dates normalized and clipped, and how many rows each reason rejects.

    Reasons in order: bad id, no usable date, out of bounds. Rows with an id that are
    not public, or without an image, are counted even if a later reason rejects them. renormalize treats the clipped years as plain source years.
    """
    d = normalize_dates(rows, rules, "reject")
    outside = rules.outside(F.col("norm_start"), F.col("norm_end"))
    reason = F.when(F.col("object_number").isNull(), "bad_id").when(F.col("norm_start").isNull(), "no_date").when(outside, "out_of_bounds")
    d = d.withColumn("reject_reason", reason)
    counts = d.agg(F.count("*").alias("input"), F.count_if(F.col("reject_reason").isNull()).alias("kept"), *[F.count_if(F.col("reject_reason") == r).alias(r) for r in ("bad_id", "no_date", "out_of_bounds")], F.count_if(F.col("object_number").isNotNull() & ~F.col("public_domain")).alias("not_public_domain"), F.count_if(F.col("object_number").isNotNull() & ~F.col("image_available")).alias("no_image"))
    kept = d.where("reject_reason is null")
    low, high = rules.cut(F.col("norm_start"), F.col("norm_end"))
    shown = F.when(F.col("date_display") != "", F.col("date_display")).otherwise(F.col("norm_display"))
    kept = kept.withColumns({"date_start": low, "date_end": high, "date_display": shown})
    if renormalize:
        kept = kept.withColumns({"date_qualifier": F.when(F.col("date_start") == F.col("date_end"), "exact").otherwise("range"), "date_parse_method": F.when(F.col("date_start") == F.col("date_end"), "source_exact").otherwise("source_range")})
    else:
        kept = kept.withColumns({"date_qualifier": F.col("norm_qualifier"), "date_parse_method": F.col("norm_method")})
    return kept.drop("norm_start", "norm_end", "norm_qualifier", "norm_method", "norm_display", "norm_error", "reject_reason"), counts


def image_url_downscale(c: Column, host: str = "images.metmuseum.org") -> Column:
    """Web-sized address of an original image on the host; other http(s) addresses as they are, else empty."""
    u = trimmed(c)
    smaller = F.regexp_replace(u, "^(.*?)/original/", "$1/web-large/")
    return F.when(~u.rlike("^(?i)https?://"), "").when(F.try_parse_url(u, F.lit("HOST")) == host, smaller).otherwise(u)


def safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_.:-]+$"), F.lit(False))


def artist_first_line(c: Column) -> Column:
    return bound(trimmed(F.split(F.coalesce(c, F.lit("")), "\n")[0]), lambda t: F.when(t == "", "Unknown artist").otherwise(t))


def image_path(root: Column, path: Column) -> Column:
    return F.when(path.startswith("/"), path).when(path != "", F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path))


def two_source_intersection(corpus: DataFrame, urls: DataFrame, prefix: str = "MET", order: tuple[str, ...] = ("image_url",)) -> DataFrame:
    """Public-domain corpus rows whose source id has an image address in urls (object_ID, image_url), once an object id.

    An object id is the prefix, in any case, an underscore and the source id; blanks around ids and addresses don't count,
    and rows without an address don't. Of several rows of one object id the first in the order of the columns of order
    counts, ties by address. artwork_id is the object id.
    """
    u = urls.select(trimmed(F.col("object_ID")).alias("artwork_id"), trimmed(F.col("image_url")).alias("image_url"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)])
    source = F.substring(F.col("artwork_id"), F.lit(len(prefix) + 2), F.length("artwork_id"))
    u = u.where((F.upper(F.substring("artwork_id", 1, len(prefix) + 1)) == prefix.upper() + "_") & (F.col("image_url") != "")).withColumn("source_id", source)
    first = F.min_by("image_url", F.struct(*[f"__{i}" for i in range(len(order))], "image_url"))
    u = u.groupBy("artwork_id", "source_id").agg(first.alias("image_url"))
    c = corpus.where(F.coalesce("public_domain", F.lit(False))).drop("image_url", "artwork_id")
    return c.join(u, "source_id")
