"""Parsers of file names, addresses and review notes as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col

# fixed values: formats of stored names
BARE_CROP_FILE = r"^(.+)_(\d+)_(\d+)x(\d+)\+(-?\d+)\+(-?\d+)$"
FRAME_CROP = r"(?i)^([A-Za-z]+\d+)_([LR])\.(avi|mp4|mpeg)\.(\d+)\.(-?\d+)\.(-?\d+)\.(-?\d+)\.(-?\d+)\.png$"
PORTAL_SUFFIX = r"(?i)^(.+?\.png)-\d+-\d+\.png$"
VIDEO_SECOND = r"(?i)/([^/]+)/[^/]+\.(?:mp4|avi)\.(\d\d)\.(\d\d)\.(\d\d)\.\d+\.jpg$"
# fixed value: words that tell equipment from animals
GEAR = "(?i)equipment|sampler|manipulator|rov|vehicle|cable|rope|marker|lander|trap|net|frame|light|laser|thruster|arm|tool|sled|platform|mooring|sensor|camera|elevator|benchmark|transect"


def whole(text: Column, pattern: str, group: int) -> Column:
    """A group of the pattern, null where it does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def crop_file(name: Column | str, label: Column | str | None = None) -> Column:
    """struct(video, frame, w, h, x, y) of ``video_frame[_label]_WxH+X+Y.jpg``; null for anything else.

    The label, with underscores for spaces, is taken off where it stands.
    """
    t = col(name)
    stem = F.regexp_replace(t, r"(?i)\.jpe?g$", "")
    if label is not None:
        tail = F.concat(F.lit("_"), F.regexp_replace(col(label), " ", "_"))
        geometry = F.regexp_extract(stem, r"(_\d+x\d+\+-?\d+\+-?\d+)$", 1)
        rest = F.substring(stem, F.lit(1), F.length(stem) - F.length(geometry))
        rest = F.when(rest.endswith(tail), F.substring(rest, F.lit(1), F.length(rest) - F.length(tail))).otherwise(rest)
        stem = F.concat(rest, geometry)
    ok = t.rlike(r"(?i)\.jpe?g$") & stem.rlike(BARE_CROP_FILE)
    part = [F.regexp_extract(stem, BARE_CROP_FILE, i) for i in range(1, 7)]
    number = [p.try_cast("long") for p in part]
    return F.when(ok, F.struct(part[0].alias("video"), number[1].alias("frame"), number[2].alias("w"), number[3].alias("h"), number[4].alias("x"), number[5].alias("y")))


def variant(label: Column | str, suffixes: list[str]) -> Column:
    """struct(name, variant): the label without the first of the suffixes it ends with."""
    t = col(label)
    out = F.struct(F.regexp_replace(t, "_", " ").alias("name"), F.lit(None).cast("string").alias("variant"))
    for s in reversed(suffixes):
        cut = F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - len(s) - 1), "_", " ")
        out = F.when(t.endswith("_" + s), F.struct(cut.alias("name"), F.lit(s).alias("variant"))).otherwise(out)
    return out


def frame_crop(name: Column | str) -> Column:
    """struct(video, camera, ext, frame, x0, y0, w, h, survey) of a crop named after its frame and corners; null otherwise."""
    t = F.coalesce(whole(col(name), PORTAL_SUFFIX, 1), col(name))
    g = [F.regexp_extract(t, FRAME_CROP, i) for i in range(1, 9)]
    n = [x.try_cast("long") for x in g]
    return F.when(t.rlike(FRAME_CROP), F.struct(g[0].alias("video"), F.upper(g[1]).alias("camera"), F.lower(g[2]).alias("ext"), n[3].alias("frame"), n[4].alias("x0"), n[5].alias("y0"), (n[6] - n[4]).alias("w"), (n[7] - n[5]).alias("h"), F.regexp_extract(g[0], "^([A-Za-z]+)", 1).alias("survey")))


def opcode_groups(code: Column | str) -> Column:
    """struct(site, deployment) of ``SITE_NN_...``; null without a second part."""
    p = F.split(col(code), "_")
    return F.when(F.size(p) >= 2, F.struct(F.element_at(p, 1).alias("site"), F.concat_ws("_", F.element_at(p, 1), F.try_element_at(p, F.lit(2))).alias("deployment")))


def folder_name(code: Column | str) -> Column:
    """Letters and digits of any script stay, every other character is an underscore."""
    return F.regexp_replace(col(code), r"[^\p{L}\p{N}]", "_")


def safe_name(text: Column | str) -> Column:
    """A file name: runs of anything but letters, digits, dot, minus and underscore as one underscore."""
    return F.regexp_replace(col(text), "[^A-Za-z0-9_.-]+", "_")


def video_second(url: Column | str, otherwise: Column) -> Column:
    """``folder|hh|mm|ss`` of a frame cut from a video, else the given unit."""
    t = col(url)
    return F.when(t.rlike(VIDEO_SECOND), F.concat_ws("|", *[F.regexp_extract(t, VIDEO_SECOND, i) for i in range(1, 5)])).otherwise(otherwise)


def index_list(text: Column | str) -> Column:
    """array<long>: the numbers of ``3,17,22-25``, ascending; lines that begin with # are notes; an unreadable part gives null."""
    clean = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?m)^\s*#.*$", "")
    parts = F.filter(F.split(clean, r"[,\s]+"), lambda p: p != "")
    bad = F.exists(parts, lambda p: ~p.rlike(r"^\d+(-\d+)?$"))

    def span(p: Column) -> Column:
        a, b = F.split(p, "-")[0].try_cast("long"), F.element_at(F.split(p, "-"), -1).try_cast("long")
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.when(~bad, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span)))))


def tile_size(detail: Column | str) -> Column:
    """struct(w, h) of ``WxH`` or ``x,y,w,h``; null for anything else."""
    t = col(detail)
    size, box = r"^(\d+)x(\d+)$", r"^-?\d+,-?\d+,(\d+),(\d+)$"

    def of(pattern: str) -> Column:
        return F.struct(F.regexp_extract(t, pattern, 1).try_cast("long").alias("w"), F.regexp_extract(t, pattern, 2).try_cast("long").alias("h"))

    return F.when(t.rlike(size), of(size)).when(t.rlike(box), of(box))


def counts_spec(text: Column | str) -> Column:
    """map<string,long> of ``source=n,source=n``."""
    return F.transform_values(F.str_to_map(F.regexp_replace(col(text), r"\s", ""), F.lit(","), F.lit("=")), lambda _, v: v.try_cast("long"))


def array_names(readout: Column | str, layer: Column | str) -> Column:
    """array<string> ``token@layer`` of a readout; ``a+b`` names two."""
    return F.array_distinct(F.transform(F.split(col(readout), r"\+"), lambda t: F.concat(t, F.lit("@"), col(layer).cast("string"))))


@dataclass(frozen=True)
class AddressRule:
    """How one kind of frame address names its group.

    pattern is searched in the decoded path; token is its replacement text
    ($1, $2 ...); numbers in ``plain`` groups lose their leading zeros before.
    """

    institution: str
    pattern: str
    token: str
    rule: str
    level: str
    reliable: bool


# fixed values: institutions' address formats and the group tokens they stand for
ADDRESS_RULES = (
    AddressRule("NOAA NMFS SEFSC", r"^.*/(\d{9})_[^/]*/[^/]*$", "SEFSC:ID:$1", "sefsc_id", "deployment", True),
    AddressRule("NOAA NMFS SEFSC", r"^.*/(B?SC\d+)-camera\d+_(\d\d)-(\d\d)-(\d\d)_[^/]*/[^/]*$", "SEFSC:RIG:$1:20$4$2$3", "sefsc_rig_day", "rig_day", True),
    AddressRule("NOAA NMFS SEFSC", r"^.*/(\d{4}_NC[A-Z]+[-_]\d+)(?:[a-z]\d*)?/[^/]*$", "SEFSC:NC:$1", "sefsc_nc", "deployment", True),
    AddressRule("MBARI", r"^/static/[^/]+/framegrabs/([^/]+)/images/(?:Mini ROV )?(\d{8})/.*$", "MBARI:$1:DATE:$2", "mbari_dated_folder", "date", False),
    AddressRule("MBARI", r"^/static/[^/]+/framegrabs/([^/]+)/images/(?:Mini ROV )?0*(\d{1,4})(?<=/\d{4}|ROV \d{4}|ROV \d{1,3})/.*$", "MBARI:$1:D$2", "mbari_dive", "dive", True),
    AddressRule("MBARI", r"^/static/[^/]+/framegrabs/([^/]+)/images/(\d{1,5})/.*$", "MBARI:$1:F$2", "mbari_unpadded", "unverified", False),
    AddressRule("MBARI", r"^.*/MBARI_D0*(\d{1,4})(?<=D\d{3,4})(?:_[^/]*)?/[^/]*$", "MBARI:DocRicketts:D$1", "mbari_dive_rehosted", "dive", True),
    AddressRule("MBARI", r"^.*/MBARI_V0*(\d{1,4})(?<=V\d{3,4})(?:_[^/]*)?/[^/]*$", "MBARI:Ventana:D$1", "mbari_dive_rehosted", "dive", True),
    AddressRule("MBARI", r"^.*/MBARI_T0*(\d{1,4})(?<=T\d{3,4})(?:_[^/]*)?/[^/]*$", "MBARI:Tiburon:D$1", "mbari_dive_rehosted", "dive", True),
    AddressRule("MBARI", r"^.*/[^/]*BIL_Kona_(\d{8})[^/]*/[^/]*$", "MBARI:BIL:$1", "mbari_bil_day", "date", True),
    AddressRule("MBARI", r"^.*/[^/]*BIL_Kona(\d{4})_[^/]*/[^/]*$", "MBARI:BIL:Y$1", "mbari_bil_year", "cruise", True),
    AddressRule("OET", r"^.*OET_NA(\d+).*$", "OET:NA$1", "oet_cruise", "cruise", True),
    AddressRule("SOI", r"^(?:.*[_/])?S0*(\d{1,4})(?<=S\d{4})(?=[_/.]|$).*$", "SOI:S$1", "soi_dive", "dive", True),
    AddressRule("ONC", r"^.*_H0*(\d{1,4})(?<=H\d{4})(?=[_/]|$).*$", "ONC:H$1", "onc_dive", "dive", True),
    AddressRule("ONC", r"^/[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}/([^/]+)/([^/]+)(?:/.*)?$", "ONC:$1:$2", "onc_project", "project", True),
)


def address_group(institution: Column, path: Column, rules: tuple[AddressRule, ...] = ADDRESS_RULES) -> Column:
    """struct(token, rule, level, reliable) of the first rule that fits; null for none."""
    out = F.lit(None)
    for r in reversed(rules):
        token = F.regexp_replace(F.regexp_replace(path, r.pattern, r.token), " ", "")
        found = F.struct(token.alias("token"), F.lit(r.rule).alias("rule"), F.lit(r.level).alias("level"), F.lit(r.reliable).alias("reliable"))
        out = F.when((institution == r.institution) & path.rlike(r.pattern), found).otherwise(out)
    return out


# fixed value: frames stored by year and day of year
STILLS = r"^/static/[^/]+/framegrabs/([^/]+)/stills/(\d{4})/(\d{1,3})/.*$"


def stills_day(path: Column) -> Column:
    """Token of ``framegrabs/<vehicle>/stills/<year>/<day of year>/...``: the vehicle and the date; null otherwise."""
    pattern = STILLS
    day = F.date_add(F.make_date(F.regexp_extract(path, pattern, 2).try_cast("int"), F.lit(1), F.lit(1)), F.regexp_extract(path, pattern, 3).try_cast("int") - 1)
    return F.when(path.rlike(pattern), F.concat(F.lit("MBARI:"), F.regexp_replace(F.regexp_extract(path, pattern, 1), " ", ""), F.lit(":DATE:"), F.date_format(day, "yyyyMMdd")))


# fixed values: how cruises and dives are written in paths and file names, and dates in file names
DIVES, OTHER_DIVES = r"(EX\d{4}(?:L\d)?_DIVE\d+(?:_\d+)*)", r"D\d-(EX\d{4}(?:L\d)?-\d+)"
CRUISE_DAY = r"EX(\d{4}(?:L\d)?)_VID_(\d{8})"
FILE_DAY = r"(?<!\d)((?:19|20)\d{6})T\d{4,6}"
# fixed values: institutions' names and the short form that the rules use; institutions whose frames are one group
INSTITUTIONS = {"Schmidt Ocean Institute": "SOI", "Universidad de Costa Rica and Schmidt Ocean Institute": "SOI", "Ocean Networks Canada": "ONC", "ONCS": "ONC"}
ONE_GROUP = ("Joost Daniels", "CENCOOS", "POSCO", "UW NSF-OOI CSSF", "UW NSF-OOI WHOI", "UniOfPlym")


def dive_tokens(path: Column) -> Column:
    """array<string>: cruise and dive tokens of ``EX1404_DIVE04_05`` (dives 4 and 5) and ``D2-EX1404-07``, ascending."""
    listed = F.regexp_extract_all(path, F.lit(DIVES), F.lit(1))

    def tokens(t: Column) -> Column:
        cruise = F.regexp_extract(t, r"^(EX\d{4}(?:L\d)?)_", 1)
        numbers = F.split(F.regexp_extract(t, r"_DIVE(.+)$", 1), "_")
        return F.transform(numbers, lambda n: F.concat(F.lit("NOAA:"), cruise, F.lit(":D"), n.cast("int").cast("string")))

    other = F.regexp_extract_all(path, F.lit(OTHER_DIVES), F.lit(1))
    short = F.transform(other, lambda t: F.concat(F.lit("NOAA:"), F.split(t, "-")[0], F.lit(":D"), F.split(t, "-")[1].cast("int").cast("string")))
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(listed, tokens)), short)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def address_parts(institution: Column, path: Column) -> Column:
    """struct(tokens, rule, level, reliable, link, dive): the groups that a decoded address path names; null for none.

    link is struct(space, day) for frames that only their day can attach to a
    dive; dive the same for a reliable dive, so that others can be attached to
    it.  A day stands in the file name, or is the folder itself.
    """
    short = F.lit(None).cast("string")
    for name, code in INSTITUTIONS.items():
        short = F.when(institution == name, F.lit(code)).otherwise(short)
    inst = F.coalesce(short, institution)
    file = F.element_at(F.split(path, "/"), -1)
    day = F.nullif(F.regexp_extract(file, FILE_DAY, 1), F.lit(""))
    cruise, cruise_day = F.regexp_extract(file, CRUISE_DAY, 1), F.nullif(F.regexp_extract(file, CRUISE_DAY, 2), F.lit(""))
    pair = lambda space, d: F.when(d.isNotNull(), F.struct(space.alias("space"), d.alias("day")))
    none = F.lit(None).cast("struct<space:string,day:string>")

    def part(tokens: Column, rule: Column, level: Column, reliable: Column, link: Column, dive: Column) -> Column:
        return F.struct(tokens.alias("tokens"), rule.alias("rule"), level.alias("level"), reliable.alias("reliable"), link.alias("link"), dive.alias("dive"))

    noaa_space = F.concat(F.lit("NOAA:EX"), cruise)
    space = lambda token: F.concat_ws(":", F.slice(F.split(token, ":"), 1, 2))
    last = lambda token: F.element_at(F.split(token, ":"), -1)

    def of_noaa(dives: Column) -> Column:
        cruises = F.array_distinct(F.transform(dives, lambda t: F.split(t, ":")[1]))
        known = part(dives, F.when(F.size(dives) > 1, "noaa_dive_multi").otherwise("noaa_dive"), F.lit("dive"), F.lit(True), none, F.when(F.size(cruises) == 1, pair(F.concat(F.lit("NOAA:"), F.try_element_at(cruises, F.lit(1))), cruise_day)))
        day_only = part(F.array(F.concat(noaa_space, F.lit(":DATE:"), cruise_day)), F.lit("noaa_cruise_day"), F.lit("date"), F.lit(False), pair(noaa_space, cruise_day), none)
        return F.when(F.size(dives) > 0, known).when(cruise_day.isNotNull(), day_only)

    def of_stills(token: Column) -> Column:
        return F.when(token.isNotNull(), part(F.array(token), F.lit("mbari_stills_day"), F.lit("date"), F.lit(False), pair(space(token), last(token)), none))

    def of_rule(g: Column) -> Column:
        token, rule = g["token"], g["rule"]
        link = F.when(rule == "mbari_dated_folder", pair(space(token), last(token))).when(rule == "mbari_unpadded", pair(space(token), day))
        dive = F.when(rule.isin("mbari_dive", "mbari_dive_rehosted"), pair(space(token), day))
        return F.when(g.isNotNull(), part(F.array(token), rule, g["level"], g["reliable"], link, dive))

    alone = part(F.array(F.concat(F.lit("INST:"), institution)), F.lit("institution_only"), F.lit("institution"), F.lit(True), none, none)
    ruled = F.coalesce(F.when(inst == "MBARI", let(stills_day(path), of_stills)), let(address_group(inst, path), of_rule))
    return F.when(institution.isin(*ONE_GROUP), alone).when(inst == "NOAA Ocean Exploration", let(dive_tokens(path), of_noaa)).otherwise(ruled)


def suspect_concept(concept: Column, rank: Column) -> Column:
    """A concept in small letters that resolved to a genus or species: probably a common word."""
    return F.substring(concept, 1, 1).rlike("[a-z]") & rank.isin("Genus", "Species", "Subspecies")


def is_gear(concept: Column) -> Column:
    return concept.rlike(GEAR)
