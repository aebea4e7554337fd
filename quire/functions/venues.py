"""Venue strings: cleaning, what is not a venue, and the rank of those that are."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Publishers, preprint hosts, satellite events and words for "no venue".
PUBLISHER_END = (
    r"(?i)\b(?:bv|b\.v\.|llc|l\.l\.c\.|ltd|ltd\.|inc|inc\.|gmbh|ag|a\.g\.|sa|s\.a\.|kg|plc|co|corp|corporation|company|press|publishing|publishers|"
    r"publications|media|group|portfolio|holdings)$"
)
PUBLISHER = (
    r"(?i)\b(?:elsevier|springer|wiley|taylor\s*&?\s*francis|informa|sage|de\s*gruyter|emerald|hindawi|frontiers\s+media|mdpi|oxford\s+university\s+press|"
    r"cambridge\s+university\s+press|association\s+for\s+computing\s+machinery|institute\s+of\s+electrical\s+and\s+electronics\s+engineers|"
    r"nature\s+(?:portfolio|publishing\s+group)|american\s+(?:chemical|physical|medical)\s+society)\b"
)
PREPRINT_HOST = (
    r"(?i)^(?:arxiv|biorxiv|medrxiv|chemrxiv|techrxiv|engrxiv|psyarxiv|socarxiv|ssrn|osf(?:\s+preprints)?|preprints(?:\.org)?|research\s*square|"
    r"authorea|hal|zenodo)\b"
)
WORKSHOP = r"(?i)\b(?:work-?shops?|companion(?:\s+volume)?|late[-\s]?breaking|doctoral\s+(?:consortium|symposium)|student\s+research\s+workshop|adjunct\s+proceedings)\b"
NO_VENUE = ("", "n/a", "na", "none", "null", "unknown", "unpublished", "no venue", "not available", "-", "--", "—")

# Fixed values: (level, name, pattern) of ranked venues; the first that matches counts.
VENUES = (
    ("A*", "NeurIPS", r"\bneurips\b|\bnips\b|neural information processing systems"),
    ("A*", "ICML", r"\bicml\b|international conference on machine learning"),
    ("A*", "ICLR", r"\biclr\b|international conference on learning representations"),
    ("A*", "AAAI", r"\baaai\b(?!.*workshop)"),
    ("A*", "IJCAI", r"\bijcai\b"),
    ("A*", "JMLR", r"journal of machine learning research|\bjmlr\b"),
    ("A*", "TPAMI", r"transactions on pattern analysis and machine intelligence|\btpami\b"),
    ("A", "AISTATS", r"\baistats\b|artificial intelligence and statistics"),
    ("A", "UAI", r"\buai\b|uncertainty in artificial intelligence"),
    ("A", "COLT", r"\bcolt\b|conference on learning theory"),
    ("A", "TMLR", r"transactions on machine learning research|\btmlr\b"),
    ("A", "AAMAS", r"\baamas\b|autonomous agents and multiagent"),
    ("A", "JAIR", r"journal of artificial intelligence research|\bjair\b"),
    ("A*", "ACL", r"\bacl\b|annual meeting of the association for computational linguistics"),
    ("A*", "EMNLP", r"\bemnlp\b|empirical methods in natural language processing"),
    ("A*", "NAACL", r"\bnaacl\b"),
    ("A", "COLING", r"\bcoling\b"),
    ("A", "EACL", r"\beacl\b"),
    ("A", "TACL", r"transactions of the association for computational linguistics|\btacl\b"),
    ("A", "CL", r"\bcomputational linguistics\b"),
    ("A*", "CVPR", r"\bcvpr\b|computer vision and pattern recognition"),
    ("A*", "ICCV", r"\biccv\b|international conference on computer vision"),
    ("A*", "ECCV", r"\beccv\b|european conference on computer vision"),
    ("A", "BMVC", r"\bbmvc\b"),
    ("A", "WACV", r"\bwacv\b"),
    ("A", "IJCV", r"\bijcv\b"),
    ("A*", "OSDI", r"\bosdi\b"),
    ("A*", "SOSP", r"\bsosp\b"),
    ("A*", "NSDI", r"\bnsdi\b"),
    ("A*", "SIGCOMM", r"\bsigcomm\b"),
    ("A*", "ISCA", r"\bisca\b|international symposium on computer architecture"),
    ("A*", "ASPLOS", r"\basplos\b"),
    ("A*", "MICRO", r"\bmicro\b.*symposium|\bmicro-\d+"),
    ("A*", "SC", r"\bsupercomputing\b|\bsc'?\d{2}\b|international conference for high performance"),
    ("A", "EuroSys", r"\beurosys\b"),
    ("A", "USENIX ATC", r"usenix annual technical"),
    ("A", "PPoPP", r"\bppopp\b"),
    ("A", "IPDPS", r"\bipdps\b"),
    ("A", "HPCA", r"\bhpca\b"),
    ("A", "TPDS", r"transactions on parallel and distributed systems|\btpds\b"),
    ("A*", "IEEE S&P", r"\boakland\b|ieee symposium on security and privacy|\bs&p\b"),
    ("A*", "USENIX Security", r"usenix security"),
    ("A*", "CCS", r"\bccs\b|conference on computer and communications security"),
    ("A*", "NDSS", r"\bndss\b"),
    ("A*", "SIGMOD", r"\bsigmod\b"),
    ("A*", "VLDB", r"\bvldb\b"),
    ("A*", "ICDE", r"\bicde\b"),
    ("A*", "KDD", r"sigkdd|\bkdd\b|knowledge discovery and data mining"),
    ("A*", "SIGIR", r"\bsigir\b"),
    ("A*", "WWW", r"\bwww\b.*conference|the web conference"),
    ("A", "WSDM", r"\bwsdm\b"),
    ("A", "CIKM", r"\bcikm\b"),
    ("A", "ICDM", r"\bicdm\b"),
    ("A", "RecSys", r"\brecsys\b"),
    ("A", "TKDE", r"\btkde\b"),
    ("A*", "STOC", r"\bstoc\b"),
    ("A*", "FOCS", r"\bfocs\b"),
    ("A*", "SODA", r"\bsoda\b"),
    ("A*", "POPL", r"\bpopl\b"),
    ("A*", "PLDI", r"\bpldi\b"),
    ("A*", "OOPSLA", r"\boopsla\b"),
    ("A*", "ICSE", r"\bicse\b"),
    ("A*", "FSE", r"\bfse\b|foundations of software engineering"),
    ("A", "ASE", r"\base\b.*automated software engineering"),
    ("A", "ISSTA", r"\bissta\b"),
    ("A", "ICFP", r"\bicfp\b"),
    ("A", "CAV", r"\bcav\b"),
    ("A", "TSE", r"\btse\b"),
    ("A*", "CHI", r"\bchi\b.*conference on human factors|\bchi\b conference"),
    ("A*", "SIGGRAPH", r"\bsiggraph\b"),
    ("A*", "UIST", r"\buist\b"),
    ("A*", "ICRA", r"\bicra\b"),
    ("A*", "IROS", r"\biros\b"),
    ("A*", "RSS", r"robotics: science and systems"),
    ("A", "CSCW", r"\bcscw\b"),
    ("A", "CoRL", r"\bcorl\b|conference on robot learning"),
    ("A", "IJRR", r"international journal of robotics research"),
    ("A*", "Nature", r"^nature$|^nature\s"),
    ("A*", "Science", r"^science$"),
    ("A*", "PNAS", r"\bpnas\b|proceedings of the national academy"),
    ("A*", "Cell", r"^cell$"),
    ("A*", "NEJM", r"new england journal of medicine"),
    ("A*", "Lancet", r"^the lancet|^lancet"),
    ("A*", "JAMA", r"^jama\b"),
    ("A", "Nature Communications", r"nature communications"),
    ("B", "PLOS ONE", r"plos one"),
    ("B", "Scientific Reports", r"scientific reports"),
)

def let(value: Column, function) -> Column:
    """``function(value)`` with the value computed once, however often the function uses it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


#: All named character references of HTML that end in a semicolon, as one constant that the optimizer folds to a map.
_NAMED = json.dumps({name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")})
#: Numbers 128 to 159 stand for what Windows' code page has there.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
EDGE = " ,;:."


def _character(code: Column) -> Column:
    """The character of a number as HTML reads it: none for controls, the replacement character outside Unicode."""
    utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    windows = F.try_element_at(F.create_map(*[F.lit(x) for pair in _WINDOWS.items() for x in pair]), code.cast("int"))
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code.between(128, 159), windows)
        .when((code < 32) & ~code.isin(9, 10, 12, 13) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE), "")
        .otherwise(utf32)
    )


def unescaped(text: Column) -> Column:
    """Decodes every named and numbered character reference that ends in a semicolon, once."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def decoded(piece: Column, i: Column) -> Column:
        return F.when(i == 0, piece).otherwise(let(F.substring_index(piece, ";", 1), lambda name: replaced(piece, name)))

    def replaced(piece: Column, name: Column) -> Column:
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        digits = F.when(name.rlike(r"^#\d+$"), F.regexp_replace(name, "^#0*(?=.)", "")).when(name.rlike("^#[xX][0-9a-fA-F]+$"), F.regexp_replace(name, "^#[xX]0*(?=.)", ""))
        # Longer numbers are beyond Unicode in any case.
        digits = F.when(F.length(digits) > 8, "99999999").otherwise(digits)
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        value = F.when(F.startswith(name, F.lit("#")), let(code, _character)).otherwise(F.try_element_at(named, name))
        return F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), piece))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, r"&(?=#?\w{1,32};)"), decoded), "")).otherwise(t))


def without_tags(text: Column) -> Column:
    """References decoded, tags to spaces, white space collapsed, references decoded again."""
    return unescaped(F.trim(F.regexp_replace(F.regexp_replace(unescaped(text), "<[^>]+>", " "), r"(?U)\s+", " ")))


def clean_venue(raw: Column) -> Column:
    """A venue without markup and edge punctuation; null for words that mean there is none."""
    s = F.regexp_replace(unescaped(raw), "<[^>]+>", " ")
    s = F.btrim(F.trim(F.regexp_replace(unescaped(s), r"(?U)\s+", " ")), F.lit(EDGE))
    return let(s, lambda x: F.when(~F.lower(x).isin(*NO_VENUE) & (F.length(x) >= 2), x))


def is_workshop(venue: Column) -> Column:
    return F.coalesce(venue, F.lit("")).rlike(WORKSHOP)


def is_publisher(venue: Column) -> Column:
    v = F.btrim(F.coalesce(venue, F.lit("")), F.lit(EDGE))
    return (v != "") & (v.rlike(PUBLISHER) | v.rlike(PUBLISHER_END))


def is_preprint_host(venue: Column) -> Column:
    return F.trim(F.coalesce(venue, F.lit(""))).rlike(PREPRINT_HOST)


def is_placeholder(venue: Column) -> Column:
    """A venue string that names something other than a venue."""
    return let(clean_venue(venue), lambda v: F.when(v.isNull(), F.coalesce(venue, F.lit("")) != "").otherwise(is_publisher(v) | is_preprint_host(v)))


def venue_level(venue: Column) -> Column:
    """struct(level, name) of the first ranked venue that matches; null for workshops, placeholders and others."""

    def ranked(v: Column) -> Column:
        found = F.coalesce(*[F.when(v.rlike("(?i)" + pattern), F.struct(F.lit(level).alias("level"), F.lit(name).alias("name"))) for level, name, pattern in VENUES])
        return F.when(v.isNotNull() & ~is_workshop(v) & ~is_publisher(v) & ~is_preprint_host(v), found)

    return let(clean_venue(venue), ranked)


def venue_levels(rows, venue: str = "venue"):
    """``rows`` with venue_level; each distinct venue is matched once, so the patterns run on few rows."""
    known = rows.select(F.col(venue).alias("_v")).distinct().withColumn("venue_level", venue_level(F.col("_v")))
    return rows.join(known, rows[venue].eqNullSafe(known["_v"]), "left").drop("_v")
