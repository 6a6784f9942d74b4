"""Names of folders and files, and the taxonomy in them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meadow.params import BEE_FAMILIES

RANKS = ("tax_id", "kingdom", "phylum", "class", "order", "family", "genus", "species")
#: Coarse types by order, and the five classes of a detector.
TYPE_BY_ORDER = {"Lepidoptera": "butterfly", "Diptera": "fly", "Coleoptera": "beetle", "Hemiptera": "bug"}
CLASS_BY_ORDER = {"Hymenoptera": "bee", "Lepidoptera": "butterfly", "Diptera": "fly", "Coleoptera": "beetle", "Hemiptera": "bug"}
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp")


def parse_taxon(name: Column) -> Column:
    """Struct of the eight ranks; parts beyond the eighth belong to the species. Names with fewer parts: all blank, tax_id is the name."""
    parts = F.split(name, "_")
    full = F.size(parts) >= 8
    rank = lambda i: F.when(full, F.try_element_at(parts, F.lit(i + 1))).otherwise(name if i == 0 else F.lit(""))
    species = F.when(full, F.array_join(F.slice(parts, F.lit(8), F.greatest(F.size(parts) - 7, F.lit(0))), "_")).otherwise("")
    return F.struct(*[rank(i).alias(r) for i, r in enumerate(RANKS[:-1])], species.alias("species"))


def parse_short_taxonomy(name: Column) -> Column:
    """Older rule: five parts at least, the first a number; else null."""
    parts = F.split(name, "_")
    ok = (F.size(parts) >= 5) & F.element_at(parts, 1).rlike(r"^\d+$")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return F.when(ok, F.struct(at(1).alias("tax_id"), at(4).alias("class"), at(5).alias("order"), at(6).alias("family"), at(7).alias("genus")))


def is_insecta(cls: Column) -> Column:
    return cls == "Insecta"


def is_bee(order: Column, family: Column) -> Column:
    return (order == "Hymenoptera") & family.isin(*BEE_FAMILIES)


def coarse_type(order: Column, family: Column) -> Column:
    """A bee family is a bee, whatever the order says. Then Lepidoptera, ants by their family, the other orders; wasps are the Hymenoptera
    that are left. Anything else is its order in lower case, an insect if that is blank."""
    out = F.when(family.isin(*BEE_FAMILIES), "bee").when(order == "Lepidoptera", TYPE_BY_ORDER["Lepidoptera"]).when(family == "Formicidae", "ant")
    for o, t in {**TYPE_BY_ORDER, "Hymenoptera": "wasp"}.items():
        out = out.when(order == o, t)
    return out.otherwise(F.coalesce(F.nullif(F.lower(order), F.lit("")), F.lit("insect")))


def detector_class(order: Column) -> Column:
    """One of five classes, null for other orders."""
    return F.try_element_at(F.create_map(*[F.lit(v) for k in CLASS_BY_ORDER.items() for v in k]), order)


def is_honeybee_genus(genus: Column) -> Column:
    return F.lower(F.trim(genus)) == "apis"


def is_true(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "t")


def source_of(path: Column) -> Column:
    """Struct of version, split, class and new name from the parts of a path; null for what isn't an image."""
    parts = F.split(path, "/")
    find = lambda names: F.try_element_at(F.filter(parts, lambda p: F.lower(p).isin(*names)), F.lit(1))
    version = F.try_element_at(F.filter(parts, lambda p: p.rlike("^v[0-9]+$")), F.lit(1))
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    cls = F.try_element_at(parts, F.lit(-2))
    name = F.concat_ws("_", version, cls, F.element_at(parts, -1))
    return F.when(ext.isin(*IMAGE_EXTENSIONS), F.struct(version.alias("version"), find(("train", "val", "valid", "test")).alias("split"), cls.alias("cls"), name.alias("name")))


def label_name(path: Column, prefix: str) -> Column:
    """The path without the prefix that label files don't have."""
    return F.regexp_replace(path, f"^{prefix}", "")
