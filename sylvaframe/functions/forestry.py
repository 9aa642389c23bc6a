"""Stand descriptions: repair and classes of composition strings, shares of species groups, stand types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvaframe.functions.strings import pairs

# Species codes that records hold in place of others.
CORRECTIONS = {"OMO": "MO", "MP": "MO", "NO": "MO", "GA": "GI"}
#: The least percentage of a group that makes a stand pure.
DOMINANCE = 70.0


def tidy(value: Column) -> Column:
    """Upper case, shares joined to their codes, one dash between pairs and none at the ends."""
    out = F.regexp_replace(F.trim(F.upper(value)), r"\s+", " ")
    out = F.regexp_replace(out, r"(\d) ([A-Z])", "$1$2")
    out = F.regexp_replace(out, "[–—−]", "-")
    return F.btrim(F.regexp_replace(out, r"[-\s]+", "-"), F.lit("-"))


def corrected(value: Column) -> Column:
    """Known slips mended: a zero for the letter O, and codes of CORRECTIONS at the end of a word. `NONE` and `NAN` are empty."""
    out = F.upper(F.trim(value))
    fixed = F.when(out == "10M0", F.lit("10MO")).otherwise(out)
    for wrong, right in CORRECTIONS.items():
        fixed = F.regexp_replace(fixed, rf"(\d{{1,2}}){wrong}\b", "$1" + right)
    return F.when(out.isin("NONE", "NAN", ""), F.lit("")).otherwise(fixed)


def pattern(value: Column) -> Column:
    """The first class of structure that fits a corrected string."""
    one = r"\d{1,2}[A-Z]{2,4}"
    rules = [("EMPTY", r"^\s*$"), ("NUMERIC_ONLY", r"^\d{1,3}$"), ("CLEARCUT", r"^CLEARCUT$|TAIE|RASE"), ("SINGLE_PAIR", f"^{one}$"), ("CONCATENATED_PAIRS", f"^({one}){{2,}}$"), ("DELIMITED_PAIRS", rf"^({one}[\s\-]*){{2,}}$"), ("PARTIAL_PAIRING", r"\d+[A-Z]{2,4}")]
    out = F
    for name, rule in rules:
        out = out.when(value.rlike(rule), F.lit(name))
    return out.otherwise(F.lit("UNKNOWN"))


def canonical(value: Column, codes: list[str]) -> Column:
    """`<share><CODE>` words, larger shares first; CLEARCUT; or null if a code isn't among `codes` or there are no pairs."""
    clean = corrected(tidy(value))
    kind, found = pattern(clean), pairs(clean)
    known = (F.size(found) > 0) & F.forall(found, lambda x: x["code"].isin(codes))
    text = F.array_join(F.transform(found, lambda x: F.concat(x["share"].cast("string"), x["code"])), " ")
    return F.when(kind == "CLEARCUT", F.lit("CLEARCUT")).when(kind.isin("SINGLE_PAIR", "CONCATENATED_PAIRS", "DELIMITED_PAIRS") & known, text)


def group_share(value: Column, codes: list[str]) -> Column:
    """Percentage of the shares that the given codes hold, to two digits; null without pairs."""
    found = pairs(value)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["share"])
    return F.when(total(found) > 0, F.round(100 * total(F.filter(found, lambda x: x["code"].isin(codes))) / total(found), 2))


def dominant_code(value: Column) -> Column:
    """The code with the greatest summed share, the first in the string among equals; null without pairs."""
    found = F.regexp_extract_all(value, F.lit(r"(\d{1,2})([A-Z]{2,4})"), F.lit(2))
    shares = F.regexp_extract_all(value, F.lit(r"(\d{1,2})([A-Z]{2,4})"), F.lit(1))
    both = F.arrays_zip(shares.alias("s"), found.alias("c"))
    sums = F.transform(F.array_distinct(found), lambda c: F.struct(F.aggregate(F.filter(both, lambda x: x["c"] == c), F.lit(0), lambda a, x: a + x["s"].cast("int")).alias("s"), (-F.array_position(found, c)).alias("at"), c.alias("c")))
    return F.when(F.size(found) > 0, F.array_max(sums)["c"])


def stand_type(broadleaf: Column, coniferous: Column, least: float = DOMINANCE) -> Column:
    """`broadleaf` or `coniferous` if its percentage reaches `least`, else `mixed`; null where a percentage is missing."""
    missing = broadleaf.isNull() | coniferous.isNull() | F.isnan(broadleaf) | F.isnan(coniferous)
    return F.when(~missing, F.when(broadleaf >= least, "broadleaf").when(coniferous >= least, "coniferous").otherwise("mixed"))


def prefixed(value: Column, prefixes: dict[str, str], default: str) -> Column:
    """The name of the first prefix that value starts with."""
    out = F
    for prefix, name in prefixes.items():
        out = out.when(value.startswith(prefix), F.lit(name))
    return out.otherwise(F.lit(default))
