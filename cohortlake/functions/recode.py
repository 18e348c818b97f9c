"""Rule-table recoders for registry text.

Each categorical recoder is an ordered rule table (first match wins)
compiled into one chained CASE WHEN over the cleaned, lower-cased text.
``legacy=True`` reproduces the original rule order, including the
overlaps documented in the README; the default order fixes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, strip_text


@dataclass(frozen=True)
class Rule:
    out: str
    any_of: tuple[str, ...] = ()   # at least one substring present
    all_of: tuple[str, ...] = ()   # every substring present
    none_of: tuple[str, ...] = ()  # no substring present
    regex: str | None = None       # Java/RE2-compatible pattern on the lower text
    prefix: str | None = None


def _text(c: Column, cleaned: bool) -> Column:
    """B3 unless the caller already projected cleaned text (keeps generated code small)."""
    return c if cleaned else clean_text(c)


def _condition(rule: Rule, low: Column) -> Column:
    cond = F.lit(True)
    if rule.any_of:
        alt = None
        for s in rule.any_of:
            alt = low.contains(s) if alt is None else (alt | low.contains(s))
        cond = cond & alt
    for s in rule.all_of:
        cond = cond & low.contains(s)
    for s in rule.none_of:
        cond = cond & ~low.contains(s)
    if rule.regex:
        cond = cond & low.rlike(rule.regex)
    if rule.prefix:
        cond = cond & low.startswith(rule.prefix)
    return cond


def apply_rules(text: Column, rules: list[Rule], otherwise: Column | None) -> Column:
    """Compile a rule table; NULL text stays NULL, no match gives ``otherwise``."""
    low = F.lower(text)
    expr = None
    for r in rules:
        cond = _condition(r, low)
        expr = F.when(cond, F.lit(r.out)) if expr is None else expr.when(cond, F.lit(r.out))
    expr = expr.otherwise(otherwise if otherwise is not None else F.lit(None).cast("string"))
    return F.when(text.isNotNull(), expr)


# --- fixed values: recode rule tables (first match wins) ----------------------
SEX_RULES_LEGACY = [Rule("Male", any_of=("male",)), Rule("Female", any_of=("female",))]
SEX_RULES = [Rule("Female", any_of=("female",)), Rule("Male", any_of=("male",))]

HISTOLOGY_RULES_LEGACY = [
    Rule("Adenocarcinoma", any_of=("adeno",)),
    Rule("Squamous", any_of=("squamous",)),
    Rule("Small_cell", all_of=("small", "cell")),
    Rule("Large_cell", all_of=("large", "cell")),
]
HISTOLOGY_RULES = [
    Rule("Adenocarcinoma", any_of=("adeno",)),
    Rule("Squamous", any_of=("squamous",)),
    Rule("Small_cell", all_of=("small", "cell"), none_of=("non-small", "non small")),
    Rule("Large_cell", all_of=("large", "cell")),
]

RACE_RULES_LEGACY = [
    Rule("White", any_of=("white",)),
    Rule("Black", any_of=("black",)),
    Rule("Asian_or_Pacific_Islander", any_of=("asian", "pacific")),
    Rule("American_Indian_Alaska_Native", any_of=("indian", "alaska")),
    Rule("Unknown", any_of=("unknown",)),
]
RACE_RULES = [
    Rule("White", any_of=("white",)),
    Rule("Black", any_of=("black",)),
    Rule("Asian_or_Pacific_Islander", regex=r"\basian\b|pacific"),
    Rule("American_Indian_Alaska_Native", any_of=("indian", "alaska")),
    Rule("Unknown", any_of=("unknown",)),
]
RACE_OTHER = "Other"

MARITAL_RULES_LEGACY = [
    Rule("Married", any_of=("married",)),
    Rule("Single", all_of=("single", "never")),
    Rule("Divorced", any_of=("divorc",)),
    Rule("Widowed", any_of=("widow",)),
    Rule("Separated", any_of=("separat",)),
    Rule("Unmarried_partner", any_of=("domestic", "unmarried")),
    Rule("Unknown", any_of=("unknown",)),
]
MARITAL_RULES = [
    Rule("Single", all_of=("single", "never")),
    Rule("Unmarried_partner", any_of=("domestic", "unmarried")),
    Rule("Married", any_of=("married",)),
    Rule("Divorced", any_of=("divorc",)),
    Rule("Widowed", any_of=("widow",)),
    Rule("Separated", any_of=("separat",)),
    Rule("Unknown", any_of=("unknown",)),
]
MARITAL_OTHER = "Unknown"

RADIATION_RULES_LEGACY = [
    Rule("None_or_Unknown", any_of=("none/unknown",)),
    Rule("Beam_radiation", any_of=("beam",)),
    Rule("Radioactive_implants", any_of=("implants", "brachytherapy")),
    Rule("Radioisotopes", any_of=("radioisotopes",)),
    Rule("Combination_radiation", any_of=("combination",)),
    Rule("Refused", any_of=("refused",)),
    Rule("Recommended_unknown", all_of=("recommended", "unknown")),
]
RADIATION_RULES = [
    Rule("None_or_Unknown", any_of=("none/unknown",)),
    Rule("Combination_radiation", any_of=("combination",)),
    Rule("Beam_radiation", any_of=("beam",)),
    Rule("Radioactive_implants", any_of=("implants", "brachytherapy")),
    Rule("Radioisotopes", any_of=("radioisotopes",)),
    Rule("Refused", any_of=("refused",)),
    Rule("Recommended_unknown", all_of=("recommended", "unknown")),
]
RADIATION_OTHER = "Other"

# Upper-cased T/N/M texts that mean "not recorded".
TNM_BLANKS = ("BLANK(S)", "BLANK", "UNKNOWN", "N/A", "NA")
# Lower-cased texts that mean "no measurement" for 1-3 digit fields.
NUMERIC_BLANKS = ("blank(s)", "unable to calculate", "unknown")
NUMERIC_CEILING = 990.0  # values at or above are special codes
GENE_PATTERN = r"hugoGeneSymbol=([A-Za-z0-9_\-]+)"
GENE_TOKEN_PATTERN = r"^\p{L}{1,12}$"
# --- end of fixed values --------------------------------------------------------


def age_recode(c: Column, cleaned: bool = False) -> Column:
    """C1: 'lo-hi' -> midpoint, 'n+' -> n+2, else first integer, else NULL."""
    t = _text(c, cleaned)
    lo = F.regexp_extract(t, r"([0-9]+)\s*-\s*([0-9]+)", 1)
    hi = F.regexp_extract(t, r"([0-9]+)\s*-\s*([0-9]+)", 2)
    plus = F.regexp_extract(t, r"([0-9]+)\+", 1)
    first = F.regexp_extract(t, r"([0-9]+)", 1)
    return (F.when(lo != "", (lo.try_cast("double") + hi.try_cast("double")) / 2.0)
            .when(plus != "", plus.try_cast("double") + 2.0)
            .when(first != "", first.try_cast("double")))


def sex_recode(c: Column, legacy: bool = False, cleaned: bool = False) -> Column:
    """Male / Female, other text passes through."""
    t = _text(c, cleaned)
    return apply_rules(t, SEX_RULES_LEGACY if legacy else SEX_RULES, t)


def stage_recode(c: Column, legacy: bool = False, cleaned: bool = False) -> Column:
    """Drop the word 'stage' and all spaces; empty gives NULL."""
    t = _text(c, cleaned)
    if legacy:
        s = F.replace(F.replace(t, F.lit("stage"), F.lit("")), F.lit("Stage"), F.lit(""))
    else:
        s = F.regexp_replace(t, "(?i)stage", "")
    s = F.replace(strip_text(s), F.lit(" "), F.lit(""))
    return F.when(s != "", s)


def histology_recode(c: Column, legacy: bool = False, cleaned: bool = False) -> Column:
    """C4: histology group, other text passes through."""
    t = _text(c, cleaned)
    return apply_rules(t, HISTOLOGY_RULES_LEGACY if legacy else HISTOLOGY_RULES, t)


def race_recode(c: Column, legacy: bool = False, cleaned: bool = False) -> Column:
    """Race group, unmatched text gives 'Other'."""
    t = _text(c, cleaned)
    return apply_rules(t, RACE_RULES_LEGACY if legacy else RACE_RULES, F.lit(RACE_OTHER))


def marital_recode(c: Column, legacy: bool = False, cleaned: bool = False) -> Column:
    """Marital status, unmatched text gives 'Unknown'."""
    t = _text(c, cleaned)
    return apply_rules(t, MARITAL_RULES_LEGACY if legacy else MARITAL_RULES, F.lit(MARITAL_OTHER))


def tnm_recode(c: Column, cleaned: bool = False) -> Column:
    """Upper-case, spaces removed, blank markers become 'Unknown'."""
    t = _text(c, cleaned)
    u = F.replace(F.upper(t), F.lit(" "), F.lit(""))
    return F.when(u.isin(*TNM_BLANKS), F.lit("Unknown")).otherwise(u)


def three_digit_number(c: Column, cleaned: bool = False) -> Column:
    """First run of up to three digits; blank markers and codes >= 990 give NULL."""
    t = _text(c, cleaned)
    d = F.regexp_extract(t, r"([0-9]{1,3})", 1)
    v = d.try_cast("double")
    return F.when(~F.lower(t).isin(*NUMERIC_BLANKS) & (d != "") & (v < NUMERIC_CEILING), v)


def yes_no(c: Column, cleaned: bool = False) -> Column:
    """Prefix 'yes' -> 1.0, prefix 'no' -> 0.0, else NULL."""
    low = F.lower(_text(c, cleaned))
    return F.when(low.startswith("yes"), F.lit(1.0)).when(low.startswith("no"), F.lit(0.0))


def radiation_recode(c: Column, legacy: bool = False, cleaned: bool = False) -> Column:
    """Radiation category, unmatched text gives 'Other'."""
    t = _text(c, cleaned)
    return apply_rules(t, RADIATION_RULES_LEGACY if legacy else RADIATION_RULES, F.lit(RADIATION_OTHER))


def gene_symbol(c: Column, cleaned: bool = False) -> Column:
    """C11: 'hugoGeneSymbol=<sym>' inside text, else a bare alphabetic token of <= 12 letters; upper-cased."""
    t = _text(c, cleaned)
    tagged = F.regexp_extract(t, GENE_PATTERN, 1)
    return (F.when(tagged != "", F.upper(tagged))
            .when(t.rlike(GENE_TOKEN_PATTERN), F.upper(t)))
