"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its lower-cased words (digits, letters a to z, anything outside ASCII). Rules are regular expressions over words; each names
a keyword, a word that every match holds. A row meets the rules of its keywords only: the words of a text are intersected with the
keywords, and the exploded result is joined with the broadcast rule table (a constant, some hundreds of rows). Only rows
with a keyword are ever matched, and only places of matches are exchanged, never texts.

Rules are ordered by tier: identifiers, grants ("licensed under ..."), names, general phrases. A detection that lies within another
one of the same or a lower tier number is suppressed; of equal detections the rule that stands first stays. Tiers
are nested running maxima over the detections of a text by start, so this is linear in their number.

Defined cases: a null text counts as empty and has no words; a null id is a value like any other; equal rows get equal results; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases and their labels, fixed by the definition: phrase, keyword, label.
BASE = (
    ("gnu general public license", "gnu", "gpl"),
    ("apache license", "apache", "apache"),
    ("cc by", "cc", "cc-by"),
    ("mit license", "mit", "mit"),
)

LICENCE = "licen[cs]e"


def _v(number: str) -> str:
    return f"(?: version| v)? v?{number}"


# Signatures: label, words of the identifier (None: it has none), then pairs of keyword and name.
SIGNATURES = (
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", ("gpl", f"(?:gnu )?gpl{_v('1')}(?: 0)?"), ("gnu", f"gnu general public {LICENCE}{_v('1')}(?: 0)?")),
    ("gpl-2.0", "gpl 2 0(?: only)?", ("gpl", f"(?:gnu )?gpl{_v('2')}(?: 0)?(?: only)?"), ("gplv2", "(?:gnu )?gplv2(?: 0)?"), ("gnu", f"gnu general public {LICENCE}(?: as published by the free software foundation)?{_v('2')}(?: 0)?")),
    ("gpl-2.0-or-later", "gpl 2 0 or later", ("gpl", f"(?:gnu )?gpl{_v('2')}(?: 0)? or(?: any)? later"), ("gnu", f"gnu general public {LICENCE}{_v('2')}(?: 0)? or(?: at your option)?(?: any)? later(?: version)?"),
     ("gnu", f"gnu general public {LICENCE} as published by the free software foundation either version 2(?: 0)? of the {LICENCE} or(?: at your option)? any later version")),
    ("gpl-3.0", "gpl 3 0(?: only)?", ("gpl", f"(?:gnu )?gpl{_v('3')}(?: 0)?(?: only)?"), ("gplv3", "(?:gnu )?gplv3(?: 0)?"), ("gnu", f"gnu general public {LICENCE}(?: as published by the free software foundation)?{_v('3')}(?: 0)?")),
    ("gpl-3.0-or-later", "gpl 3 0 or later", ("gpl", f"(?:gnu )?gpl{_v('3')}(?: 0)? or(?: any)? later"), ("gnu", f"gnu general public {LICENCE}{_v('3')}(?: 0)? or(?: at your option)?(?: any)? later(?: version)?"),
     ("gnu", f"gnu general public {LICENCE} as published by the free software foundation either version 3(?: 0)? of the {LICENCE} or(?: at your option)? any later version")),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", ("lgpl", f"(?:gnu )?lgpl{_v('2')}(?: 0)?"), ("library", f"gnu library general public {LICENCE}(?:{_v('2')}(?: 0)?)?")),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", ("lgpl", f"(?:gnu )?lgpl{_v('2')} 1(?: or later)?"), ("lesser", f"gnu lesser general public {LICENCE}{_v('2')} 1(?: or(?: any)? later)?"), ("lgplv2", "(?:gnu )?lgplv2 1")),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", ("lgpl", f"(?:gnu )?lgpl{_v('3')}(?: 0)?"), ("lesser", f"gnu lesser general public {LICENCE}{_v('3')}(?: 0)?(?: or(?: any)? later)?"), ("lgplv3", "(?:gnu )?lgplv3")),
    ("lgpl", None, ("lesser", f"gnu lesser general public {LICENCE}"), ("lgpl", "gnu lgpl"), ("lgpl", f"lgpl {LICENCE}")),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", ("agpl", f"(?:gnu )?agpl{_v('3')}(?: 0)?"), ("affero", f"(?:gnu )?affero general public {LICENCE}(?:{_v('3')}(?: 0)?)?(?: or(?: any)? later)?"), ("agplv3", "(?:gnu )?agplv3")),
    ("gfdl-1.2", "gfdl 1 2(?: only| or later)?", ("documentation", f"gnu free documentation {LICENCE}{_v('1')} 2"), ("gfdl", f"(?:gnu )?gfdl{_v('1')} 2")),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", ("documentation", f"gnu free documentation {LICENCE}{_v('1')} 3"), ("gfdl", f"(?:gnu )?gfdl{_v('1')} 3")),
    ("gfdl", None, ("documentation", f"gnu free documentation {LICENCE}"), ("gfdl", "gnu gfdl")),
    ("gpl-any", None, ("gpl", f"gpl {LICENCE}"), ("gpl", "gnu gpl"), ("gpl", "gpl compatible"), ("gnu", f"gnu public {LICENCE}")),
    ("apache-1.0", "apache 1 0", ("apache", f"apache(?: software)?(?: {LICENCE})?{_v('1')} 0")),
    ("apache-1.1", "apache 1 1", ("apache", f"apache(?: software)?(?: {LICENCE})?{_v('1')} 1")),
    ("apache-2.0", "apache 2 0", ("apache", f"apache(?: software)?(?: {LICENCE})?{_v('2')}(?: 0)?"), ("asl", f"asl{_v('2')} 0"), ("apache", f"apache {LICENCE} 2 0 the {LICENCE}")),
    ("mit", "mit", ("mit", f"mit {LICENCE}"), ("mit", f"mit x11 {LICENCE}"), ("mit", f"mit style {LICENCE}"), ("expat", f"expat {LICENCE}"),
     ("sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"), ("granted", "permission is hereby granted free of charge to any person obtaining a copy of this software")),
    ("mit-0", "mit 0", ("attribution", f"mit no attribution(?: {LICENCE})?")),
    ("x11", "x11", ("x11", f"x11 {LICENCE}"), ("consortium", f"x consortium {LICENCE}")),
    ("isc", "isc", ("isc", f"isc {LICENCE}"), ("granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted")),
    ("bsd-1-clause", "bsd 1 clause", ("bsd", f"(?:1|one) clause bsd(?: {LICENCE})?")),
    ("bsd-2-clause", "bsd 2 clause", ("bsd", f"(?:2|two) clause bsd(?: {LICENCE})?"), ("simplified", f"simplified bsd(?: {LICENCE})?"), ("freebsd", f"freebsd {LICENCE}"), ("bsd", f"bsd (?:2|two) clause(?: {LICENCE})?")),
    ("bsd-3-clause", "bsd 3 clause", ("bsd", f"(?:3|three) clause bsd(?: {LICENCE})?"), ("revised", f"revised bsd(?: {LICENCE})?"), ("modified", f"modified bsd(?: {LICENCE})?"), ("bsd", f"bsd (?:3|three) clause(?: {LICENCE})?"),
     ("endorse", "may be used to endorse or promote products derived from this software without specific prior written permission")),
    ("bsd-4-clause", "bsd 4 clause", ("bsd", f"(?:4|four) clause bsd(?: {LICENCE})?"), ("bsd", f"bsd (?:4|four) clause(?: {LICENCE})?"), ("advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement")),
    ("0bsd", "0bsd", ("bsd", f"(?:0|zero) clause bsd(?: {LICENCE})?"), ("0bsd", f"0bsd {LICENCE}")),
    ("bsd", None, ("bsd", f"bsd(?: style| type| like)? {LICENCE}"), ("redistribution", "redistribution and use in source and binary forms with or without modification are permitted")),
    ("mpl-1.0", "mpl 1 0", ("mozilla", f"mozilla public {LICENCE}{_v('1')} 0"), ("mpl", f"mpl{_v('1')} 0")),
    ("mpl-1.1", "mpl 1 1", ("mozilla", f"mozilla public {LICENCE}{_v('1')} 1"), ("mpl", f"mpl{_v('1')} 1")),
    ("mpl-2.0", "mpl 2 0", ("mozilla", f"mozilla public {LICENCE}{_v('2')}(?: 0)?"), ("mpl", f"mpl{_v('2')} 0")),
    ("mpl", None, ("mozilla", f"mozilla public {LICENCE}"), ("npl", f"netscape public {LICENCE} npl")),
    ("epl-1.0", "epl 1 0", ("eclipse", f"eclipse public {LICENCE}{_v('1')} 0"), ("epl", f"epl{_v('1')} 0")),
    ("epl-2.0", "epl 2 0", ("eclipse", f"eclipse public {LICENCE}{_v('2')}(?: 0)?"), ("epl", f"epl{_v('2')} 0")),
    ("edl-1.0", None, ("eclipse", f"eclipse distribution {LICENCE}(?:{_v('1')} 0)?")),
    ("cpl-1.0", "cpl 1 0", ("common", f"common public {LICENCE}(?:{_v('1')} 0)?")),
    ("cddl-1.0", "cddl 1 0", ("cddl", f"cddl(?:{_v('1')} 0)?"), ("distribution", f"common development and distribution {LICENCE}(?:{_v('1')} 0)?")),
    ("cddl-1.1", "cddl 1 1", ("cddl", f"cddl{_v('1')} 1"), ("distribution", f"common development and distribution {LICENCE}{_v('1')} 1")),
    ("eupl-1.1", "eupl 1 1", ("european", f"european union public {LICENCE}{_v('1')} 1"), ("eupl", f"eupl{_v('1')} 1")),
    ("eupl-1.2", "eupl 1 2", ("european", f"european union public {LICENCE}{_v('1')} 2"), ("eupl", f"eupl{_v('1')} 2")),
    ("cecill-2.1", "cecill 2 1", ("cecill", f"cecill(?: {LICENCE})?{_v('2')} 1")),
    ("cecill-b", "cecill b", ("cecill", f"cecill b(?: {LICENCE})?")),
    ("cecill-c", "cecill c", ("cecill", f"cecill c(?: {LICENCE})?")),
    ("artistic-1.0", "artistic 1 0", ("artistic", f"artistic {LICENCE}{_v('1')} 0")),
    ("artistic-2.0", "artistic 2 0", ("artistic", f"artistic {LICENCE}{_v('2')}(?: 0)?")),
    ("artistic", None, ("artistic", f"perl artistic {LICENCE}"), ("artistic", f"artistic {LICENCE}"), ("perl", "same terms as perl(?: itself)?")),
    ("bsl-1.0", "bsl 1 0", ("boost", f"boost software {LICENCE}(?:{_v('1')} 0)?")),
    ("busl-1.1", "busl 1 1", ("business", f"business source {LICENCE}(?:{_v('1')} 1)?")),
    ("sspl-1.0", "sspl 1 0", ("sspl", f"sspl(?:{_v('1')}(?: 0)?)?"), ("server", f"server side public {LICENCE}(?:{_v('1')}(?: 0)?)?")),
    ("elastic-2.0", "elastic 2 0", ("elastic", f"elastic {LICENCE}(?:{_v('2')}(?: 0)?)?")),
    ("zlib", "zlib", ("zlib", f"zlib(?: libpng)? {LICENCE}"), ("misrepresented", "the origin of this software must not be misrepresented")),
    ("libpng", "libpng", ("libpng", f"libpng {LICENCE}")),
    ("openssl", "openssl", ("openssl", f"openssl(?: ssleay)? {LICENCE}")),
    ("curl", "curl", ("curl", f"curl {LICENCE}")),
    ("python-2.0", "(?:python|psf) 2 0", ("python", f"python software foundation {LICENCE}(?:{_v('2')}(?: 0)?)?"), ("psf", f"psf {LICENCE}")),
    ("php-3.01", "php 3 0?1", ("php", f"php {LICENCE}{_v('3')} 0?1")),
    ("php-3.0", "php 3 0", ("php", f"php {LICENCE}(?:{_v('3')} 0)?")),
    ("ruby", "ruby", ("ruby", f"ruby {LICENCE}"), ("ruby", "same terms as ruby(?: itself)?")),
    ("postgresql", "postgresql", ("postgresql", f"postgresql {LICENCE}")),
    ("ncsa", "ncsa", ("ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LICENCE}")),
    ("w3c", "w3c", ("w3c", f"w3c(?: software)?(?: notice and)? {LICENCE}")),
    ("wtfpl", "wtfpl", ("wtfpl", f"wtfpl(?:{_v('2')})?"), ("fuck", f"do what the fuck you want to public {LICENCE}")),
    ("unlicense", "unlicense", ("unlicense", "the unlicense"), ("unencumbered", "free and unencumbered software released into the public domain")),
    ("beerware", "beerware", ("beer", f"beer ware {LICENCE}"), ("beerware", f"beerware {LICENCE}")),
    ("ijg", "ijg", ("ijg", f"ijg {LICENCE}"), ("independent", "the independent jpeg group s software")),
    ("ofl-1.1", "ofl 1 1", ("sil", f"sil open font {LICENCE}(?:{_v('1')} 1)?"), ("ofl", f"ofl{_v('1')} 1")),
    ("ms-pl", "ms pl", ("microsoft", f"microsoft public {LICENCE}"), ("ms", f"ms pl {LICENCE}")),
    ("ms-rl", "ms rl", ("microsoft", f"microsoft reciprocal {LICENCE}")),
    ("upl-1.0", "upl 1 0", ("universal", f"universal permissive {LICENCE}(?:{_v('1')} 0)?")),
    ("afl-3.0", "afl 3 0", ("academic", f"academic free {LICENCE}(?:{_v('3')}(?: 0)?)?")),
    ("osl-3.0", "osl 3 0", ("open", f"open software {LICENCE}(?:{_v('3')}(?: 0)?)?")),
    ("qpl-1.0", "qpl 1 0", ("q", f"q public {LICENCE}(?:{_v('1')} 0)?")),
    ("sleepycat", "sleepycat", ("sleepycat", f"sleepycat {LICENCE}")),
    ("odbl-1.0", "odbl 1 0", ("database", f"open(?: data commons)?(?: open)? database {LICENCE}(?:{_v('1')} 0)?"), ("odbl", f"odbl(?:{_v('1')} 0)?")),
    ("odc-by-1.0", "odc by 1 0", ("odc", "odc by(?: 1 0)?"), ("commons", f"open data commons attribution {LICENCE}")),
    ("pddl-1.0", "pddl 1 0", ("pddl", f"pddl(?:{_v('1')} 0)?"), ("commons", f"open data commons public domain dedication and {LICENCE}")),
    ("ogl-uk-3.0", "ogl uk 3 0", ("government", f"open government {LICENCE}(?:{_v('3')} 0)?")),
    ("cc0-1.0", "cc0 1 0", ("cc0", f"cc0(?:{_v('1')} 0)?(?: universal)?"), ("zero", "creative commons zero(?: 1 0)?"), ("commons", "creative commons public domain dedication")),
    ("openrail", None, ("openrail", f"(?:bigscience |creativeml )?openrail(?: m)?(?: {LICENCE})?"), ("rail", f"bigscience rail {LICENCE}")),
)

#: Creative Commons: forms of the identifier and of the title, and the versions that exist of each.
_CC_FORMS = (
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:atives|s)"), ("by-nc", "attribution non ?commercial"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:atives|s)"),
)
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: General phrases: label, keyword, pattern.
GENERAL = (
    ("public-domain", "domain", "(?:released |placed |dedicated )?(?:in|into|to) the public domain"), ("public-domain", "domain", "is public domain"),
    ("all-rights-reserved", "reserved", "all rights reserved"), ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "proprietary", f"proprietary {LICENCE}"), ("proprietary", "confidential", "confidential and proprietary"), ("creative-commons", "commons", f"creative commons(?: {LICENCE})?"),
    ("copyleft", "copyleft", "copyleft"), ("freeware", "freeware", "(?:is|as) freeware"), ("shareware", "shareware", "(?:is|as) shareware"),
    ("see-license", "license", f"see(?: the)? license(?: file)? for(?: the)?(?: full)? (?:details|terms|text)"), ("see-license", "copying", "see(?: the file)? copying(?: for details)?"),
    ("dual-license", "dual", "dual licen[cs]ed"), ("commercial", "commercial", f"commercial {LICENCE}(?: agreement)?"), ("eula", "eula", "eula"), ("eula", "user", f"end user {LICENCE} agreement"),
    ("no-commercial-use", "noncommercial", "for noncommercial(?: use| purposes)(?: only)?"), ("no-commercial-use", "commercial", "for non commercial(?: use| purposes)(?: only)?"),
    ("research-only", "research", "for research(?: use| purposes) only"), ("open-source", "open", f"(?:an )?open source {LICENCE}"),
    ("as-is", "warranty", "provided as is without(?: any)? warranty(?: of any kind)?"), ("as-is", "warranties", "without warranties or conditions of any kind"),
)

TIERS = ("identifier", "grant", "name", "general")
_GRANT = "(?:licensed|released|distributed|published|available|provided|covered|governed|used|redistributed) (?:under|by)(?: the)?(?: terms(?: and conditions)? of(?: the)?| same)? "


@dataclass(frozen=True)
class Confidence:
    identifier: float = 0.99
    grant: float = 0.95
    name: float = 0.8
    general: float = 0.5


def rules() -> list[tuple[int, int, str, str, str, bool]]:
    """All rules in order: place, tier, label, keyword, pattern over spaced words, whether it is a base phrase."""
    listed: list[tuple[int, str, str, str, bool]] = []

    def add(tier: str, label: str, keyword: str, pattern: str, base: bool = False) -> None:
        listed.append((TIERS.index(tier), label, keyword, pattern, base))

    for label, identifier, *names in SIGNATURES:
        if identifier:
            add("identifier", label, "spdx", f"spdx license identifier {identifier}")
        for keyword, name in names:
            # A sentence of a license text is not something to be licensed under.
            if name.count(" ") < 9:
                add("grant", label, keyword, _GRANT + name)
            add("name", label, keyword, name)
    for form, title in _CC_FORMS:
        words = form.replace("-", " ")
        for version in _CC_VERSIONS:
            number = version.replace(".", " ")
            label = f"cc-{form}-{version}"
            add("identifier", label, "spdx", f"spdx license identifier cc {words} {number}")
            for keyword, name in (("cc", f"cc {words}{_v(number)}"), ("commons", f"creative commons {title}{_v(number)}"), ("commons", f"creative commons {title} {number} (?:international|unported|generic) {LICENCE}")):
                add("grant", label, keyword, _GRANT + "(?:a )?" + name)
                add("name", label, keyword, name)
        add("name", f"cc-{form}-any", "cc", f"cc {words}")
        add("name", f"cc-{form}-any", "commons", f"creative commons {title}(?: {LICENCE})?")
    for label, keyword, pattern in GENERAL:
        add("general", label, keyword, pattern)
    for pattern, keyword, label in BASE:
        add("name", label, keyword, pattern, True)
    listed.sort(key=lambda r: r[0])
    return [(i, *r[:3], _spaced(r[3]), r[4]) for i, r in enumerate(listed)]


def _spaced(pattern: str) -> str:
    """Words of a text are written with a space on either side each, so a match never cuts a word and holds two spaces a word."""
    return " (?:" + pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + ") "


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, confidence: Confidence) -> DataFrame:
    weights = [confidence.identifier, confidence.grant, confidence.name, confidence.general]
    return spark.createDataFrame([(*r, weights[r[1]]) for r in rules()], "rule int, tier int, label string, keyword string, pattern string, base boolean, confidence double")


def detections(docs: DataFrame, confidence: Confidence = Confidence(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every rule: _id, _hash (of the text), rule, tier, label, base, confidence, start and end in words, suppressed."""
    table = _table(docs.sparkSession, confidence)
    keywords = F.array(*(F.lit(k) for k in sorted({r[3] for r in rules()})))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.split(F.trim(F.regexp_replace(F.translate("_text", _UPPER, _LOWER), _GAP, " ")), " ")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select("_id", F.xxhash64("_text").alias("_hash"), words.alias("_words"))
    rows = rows.select("_id", "_hash", "_words", F.array_intersect("_words", keywords).alias("_found")).where(F.size("_found") > 0)
    rows = rows.select("_id", "_hash", F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" ")).alias("_spaced"), F.explode("_found").alias("keyword"))
    rows = rows.join(F.broadcast(table), "keyword").where(F.expr("_spaced rlike pattern"))
    spaces = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" ")))) / 2).cast("long")
    rows = rows.select(
        "_id", "_hash", "rule", "tier", "label", "base", "confidence",
        F.transform(F.split("_spaced", F.col("pattern"), -1), spaces).alias("before"), F.transform(F.expr("regexp_extract_all(_spaced, pattern, 0)"), spaces).alias("own"))
    rows = rows.select("_id", "_hash", "rule", "tier", "label", "base", "confidence", F.posexplode(F.arrays_zip(F.expr("slice(before, 1, size(own))").alias("before"), F.col("own"))).alias("at", "m"))
    rows = rows.select("_id", "_hash", "rule", "tier", "label", "base", "confidence", "at", "m.before", "m.own").repartition("_id", "_hash").dropDuplicates(["_id", "_hash", "rule", "at"])
    along = Window.partitionBy("_id", "_hash", "rule").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("own")).over(along)).withColumn("start", F.col("end") - F.col("own"))
    order = Window.partitionBy("_id", "_hash").orderBy("start", F.desc("end"), "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None)
    for tier in range(len(TIERS)):
        reach = F.when(F.col("tier") == tier, F.max(F.when(F.col("tier") <= tier, F.col("end"))).over(order)).otherwise(reach)
    rows = rows.withColumn("suppressed", F.coalesce(reach >= F.col("end"), F.lit(False)))
    return rows.select("_id", "_hash", "rule", "tier", "label", "base", "confidence", "start", "end", "suppressed")


def license_scan(docs: DataFrame, confidence: Confidence = Confidence(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, base places, labels of the base phrases and of all detections that stand, and the best confidence."""
    found = detections(docs, confidence, id_col, text_col)
    stands = F.col("base") | ~F.col("suppressed")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = found.groupBy("_id", "_hash").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        listed(F.col("base")).alias("base_labels"), listed(stands).alias("labels"), F.max(F.when(stands, F.col("confidence"))).alias("score"), F.count(F.when(stands, 1)).alias("n_detections"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), F.xxhash64(text).alias("_key"))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["_key"] == found["_hash"]), "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_detections", zero).alias("n_detections"))


def oracle() -> str:
    """DuckDB SQL for :func:`license_scan` with the default confidences."""
    c = Confidence()
    weights = [c.identifier, c.grant, c.name, c.general]
    values = ", ".join(f"({i}, {tier}, '{label}', '{keyword}', '{pattern}', {str(base).lower()}, {weights[tier]}::DOUBLE)" for i, tier, label, keyword, pattern, base in rules())
    spaces = "(length(x) - length(replace(x, ' ', ''))) // 2"
    words = f"string_split(trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_GAP}', ' ', 'g')), ' ')"
    stands = "(base OR NOT suppressed)"
    return f"""
    WITH rules(rule, tier, label, keyword, pattern, base, confidence) AS (VALUES {values}),
    d AS (SELECT doc_id, [w FOR w IN {words} IF w <> ''] AS words FROM documents),
    t AS (SELECT doc_id, ' ' || array_to_string(words, '  ') || ' ' AS spaced, unnest(list_intersect(list_distinct(words), (SELECT list(DISTINCT keyword) FROM rules))) AS keyword FROM d),
    m AS (SELECT doc_id, rules.*, regexp_extract_all(spaced, pattern, 0) AS f, string_split_regex(spaced, pattern) AS p FROM t JOIN rules USING (keyword)),
    e AS (SELECT doc_id, rule, tier, label, base, confidence, unnest(range(1, len(f) + 1)) AS i, [{spaces} FOR x IN f] AS own, [{spaces} FOR x IN p] AS before FROM m WHERE len(f) > 0),
    s AS (SELECT doc_id, rule, tier, label, base, confidence, CAST(list_sum(before[1:i]) + coalesce(list_sum(own[1:i - 1]), 0) AS BIGINT) AS s, CAST(own[i] AS BIGINT) AS n FROM e),
    k AS (SELECT *, EXISTS (SELECT 1 FROM s AS o WHERE o.doc_id = s.doc_id AND o.tier <= s.tier AND o.s <= s.s AND o.s + o.n >= s.s + s.n
            AND (o.s < s.s OR o.n > s.n OR (o.tier, o.rule) < (s.tier, s.rule))) AS suppressed FROM s),
    a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER {stands} AS labels,
            max(confidence) FILTER {stands} AS score, count(*) FILTER {stands} AS n_detections FROM k GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      coalesce(score, 0.0) AS score, coalesce(n_detections, 0) AS n_detections FROM d LEFT JOIN a USING (doc_id)"""
