"""Names, ranks and classifications as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col

# fixed values: ranks from fine to coarse that a lineage is read at
RANKS = ("species", "genus", "family", "order")
# fixed values: classes that count as vertebrates
VERTEBRATES = ("actinopterygii", "elasmobranchii", "holocephali", "mammalia", "reptilia", "aves", "amphibia", "myxini", "petromyzonti", "teleostei")
EPITHET = "^[a-z][a-z\\-]+$"


def rank_intent(family: Column | str, genus: Column | str, species: Column | str) -> Column:
    """Species, Genus or Family: the finest rank that the typed parts name; null for none."""
    f, g, s = (F.trim(F.coalesce(col(c), F.lit(""))) for c in (family, genus, species))
    real = s.rlike(EPITHET) & ~s.isin("sp", "spp")
    return F.when((g != "") & real, "Species").when(g != "", "Genus").when(f != "", "Family")


def propose_name(family: Column | str, genus: Column | str, species: Column | str) -> Column:
    """The name those parts propose, at their rank."""
    f, g, s = (F.trim(F.coalesce(col(c), F.lit(""))) for c in (family, genus, species))
    rank = rank_intent(f, g, s)
    return F.when(rank == "Species", F.concat_ws(" ", g, s)).when(rank == "Genus", g).when(rank == "Family", f)


def taxa_of(name: Column, rank: Column, lineage: Column) -> Column:
    """map of level to name at the category's own rank and above; keys of the lineage in any case."""
    lower = F.transform_keys(lineage, lambda k, _: F.lower(k))
    own = F.lower(rank)
    place = F.array_position(F.array(*[F.lit(r) for r in RANKS]), own)
    named = F.when(own == "species", F.map_concat(F.map_filter(lower, lambda k, _: k != "species"), F.create_map(F.lit("species"), name))).otherwise(lower)
    return F.map_filter(named, lambda k, v: (F.array_position(F.array(*[F.lit(r) for r in RANKS]), k) >= place) & (place > 0) & (F.coalesce(v, F.lit("")) != ""))


def taxon_bucket(kingdom: Column, phylum: Column, class_: Column) -> Column:
    """vertebrate, invertebrate, other (no animal) or unknown."""
    k, p, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (kingdom, phylum, class_))
    return F.when(k == "", "unknown").when(k != "animalia", "other").when(c.isin(*VERTEBRATES), "vertebrate").when((p == "chordata") & (c == ""), "unknown").otherwise("invertebrate")


def concept_action(action: Column) -> Column:
    """class, unlabelled or drop; a concept without an entry is dropped."""
    return F.coalesce(action, F.lit("drop"))


def hemisphere(c: Column | str) -> Column:
    """``S12.91`` as -12.91; null where it is no such number."""
    t = F.upper(F.trim(col(c)))
    sign = F.when(F.substring(t, 1, 1).isin("S", "W"), -1.0).when(F.substring(t, 1, 1).isin("N", "E"), 1.0)
    return sign * F.substring(t, 2, 40).try_cast("double")


def iso_date(c: Column | str) -> Column:
    """YYYYMMDD of eight digits as YYYY-MM-DD, else null."""
    t = col(c).cast("string")
    return F.when(F.length(t) == 8, F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))


def day_of_year(year: Column, day: Column) -> Column:
    """Date of a year and its day number."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day.cast("int") - 1)


def url_template(c: Column | str) -> Column:
    """A path with UUIDs as ``U`` and digit runs as ``#``."""
    t = F.regexp_replace(col(c), "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "U")
    return F.regexp_replace(t, "[0-9]+", "#")


def split_label(split: Column, in_dev: Column) -> Column:
    """ungrouped, dev or main for a group and its membership in the dev selection."""
    return F.when(split == "", "ungrouped").when(in_dev, "dev").otherwise("main")


def lock_label(before: Column, in_lock: Column, in_heldout: Column) -> Column:
    """Precedence of the locked cut: dev and ungrouped stay, then lock, heldout, train."""
    return F.when(before.isin("dev", "ungrouped"), before).when(in_lock, "lock").when(in_heldout, "heldout").otherwise("train")


CORE = ("kingdom", "phylum", "class", "order", "family", "genus", "species")  # fixed values: ranks that a lineage must not skip, from coarse to fine


def lineage_gaps(lineage: Column, rank: Column) -> Column:
    """array of the core ranks that a lineage (map of rank to name) misses, coarse to fine.

    A rank is missed where a finer one is there, or where it is the category's
    own.  Names that are null or blank are not there.
    """
    there = F.filter(F.array(*[F.lit(r) for r in CORE]), lambda r: F.trim(F.coalesce(F.try_element_at(lineage, r), F.lit(""))) != "")
    core = F.array(*[F.lit(r) for r in CORE])
    finest = F.coalesce(F.array_max(F.transform(there, lambda r: F.array_position(core, r))), F.lit(0))
    own = F.lower(F.trim(F.coalesce(rank, F.lit(""))))
    return F.filter(core, lambda r: ~F.array_contains(there, r) & ((F.array_position(core, r) < finest) | (r == own)))
