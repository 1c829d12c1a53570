"""Column functions: keys, distances, year and number parsing. All are built-in expressions.

Blank strings count as missing. Nothing here raises on bad values under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# They must equal the reference's for the same keys to come out.
LEGAL_SUFFIXES = [
    "inc", "incorporated", "llc", "llp", "ltd", "limited", "corp", "corporation", "co", "company", "pllc", "pc", "pa", "plc", "gmbh", "sa", "dds",
    "dmd", "dvm", "md", "cpa",
]
NOISE_WORDS = [
    "the", "and", "of", "a", "an",
]
COMPOUND_SUFFIXES = [
    "co.uk", "com.au", "co.nz", "org.uk", "ac.uk", "com.br",
]


def blank(c: Column) -> Column:
    """Trimmed, with the empty string as null."""
    return F.nullif(F.trim(c), F.lit(""))


def domain(value: Column) -> Column:
    """Bare host of a URL or domain: lower case, no scheme, user, port, leading www. or edge dots."""
    raw = F.lower(F.trim(value))
    net = F.regexp_extract(F.regexp_replace(raw, "^[^/?#]*?://", ""), "^([^/?#]*)", 1)
    host = F.substring_index(F.substring_index(net, "@", -1), ":", 1)
    host = F.regexp_replace(host, r"^[./]+|[./]+$", "")
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def registrable(value: Column) -> Column:
    """The last two labels of a host, or three under a two-label public suffix."""
    host = domain(value)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(COMPOUND_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def name_core(name: Column) -> Column:
    """Comparable core of a name: & and + are "and", no punctuation, legal forms or noise words; never empty for want of others."""
    spelled = F.regexp_replace(F.lower(name), "[&+]", " and ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(spelled, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    kept = F.array_join(F.filter(F.split(plain, " "), lambda t: ~t.isin(LEGAL_SUFFIXES + NOISE_WORDS)), " ")
    return F.when(kept == "", plain).otherwise(kept)


def block_name(name: Column) -> Column:
    return F.substring(F.split(name_core(name), " ")[0], 1, 4)


def postcode5(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.char_length(digits) >= 5, F.substring(digits, 1, 5))


def email_domain(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), domain(F.substring_index(email, "@", -1)))


def phone10(phone: Column) -> Column:
    """The last ten digits, if there are ten."""
    digits = F.regexp_replace(phone, r"\D", "")
    return F.when(F.char_length(digits) >= 10, F.right(digits, F.lit(10)))


def phone_e164(phone: Column) -> tuple[Column, Column]:
    """(+1XXXXXXXXXX or null, valid) by the North American plan: area and exchange start with 2-9."""
    digits = F.regexp_replace(phone, r"\D", "")
    ten = F.when(digits.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$"), F.right(digits, F.lit(10)))
    return F.concat(F.lit("+1"), ten), ten.isNotNull()


def display_name(name: Column) -> Column:
    """Display casing of a shouted or lower-case name: suffixes fixed, initials and short acronyms kept, O'Brien and hyphen parts capitalised."""

    def capital(part: Column) -> Column:
        return F.concat(F.upper(F.substring(part, 1, 1)), F.lower(part.substr(F.lit(2), F.char_length(part))))

    def word(w: Column) -> Column:
        low, bare = F.lower(w), F.regexp_replace(F.lower(w), r"[^a-z]", "")
        fixed = F.when(bare.isin("llc", "llp", "pllc", "pc", "dba", "hvac", "usa", "ac"), F.upper(w)).when(bare.isin("inc", "corp", "ltd", "co"), capital(w))
        small = F.when(low.isin("of", "and", "the", "for"), low)
        initial = F.when(w.rlike(r"^([A-Za-z]\.)+$") | (F.char_length(bare) == 1), F.upper(w))
        parts = F.array_join(F.transform(F.split(w, "-"), lambda p: F.array_join(F.transform(F.split(p, "'"), capital), "'")), "-")
        return F.coalesce(fixed, initial, small, parts)

    words = F.transform(F.split(F.trim(name), r"\s+"), word)
    cased = F.array_join(words, " ")
    mixed = name.rlike("[a-z]") & name.rlike("[A-Z]")
    return F.when(mixed, F.trim(name)).otherwise(F.concat(F.upper(F.substring(cased, 1, 1)), cased.substr(F.lit(2), F.char_length(cased))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def _number(clean: Column) -> Column:
    """A decimal number written out in full or with an exponent; null for anything else."""
    return F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean).try_cast("double")


def whole_number(text: Column) -> Column:
    """An integer from text such as 1,250, 12.9 (cut off) or the size band 11-50, which gives its upper end; so a minus sign is a band's, too."""
    clean = F.translate(F.trim(text), "$,€£ ", "")
    return _number(F.substring_index(clean, "-", -1)).try_cast("int")


def money(text: Column) -> Column:
    """A sum from text such as $5.2M, 900K, 2B or 1,250,000."""
    clean = F.lower(F.translate(F.trim(text), "$,€£ ", ""))
    scale = F.when(clean.endswith("b"), 1e9).when(clean.endswith("m"), 1e6).when(clean.endswith("k"), 1e3).otherwise(1.0)
    value = _number(F.regexp_replace(clean, "[kmb]$", "")) * scale
    return F.when(F.abs(value) < 1e300, value)


def founding_year(text: Column, low: int, high: Column) -> Column:
    """The first four of all digits in the text, if they are a year from low to high."""
    digits = F.left(F.regexp_replace(text, r"\D", ""), F.lit(4))
    y = F.when(F.char_length(digits) == 4, digits).try_cast("int")
    return F.when((y >= low) & (y <= high), y)


def year_between(text: Column, low: int, high: Column) -> Column:
    """The first run of four digits, if it is a year from low to high."""
    y = F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")
    return F.when((y >= low) & (y <= high), y)


def parse_date(text: Column) -> Column:
    """MM/dd/yyyy, then ISO, then MM/dd/yy with years from 69 on in the last century."""
    t = F.trim(text)
    short = F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 1)
    yy = F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 2)
    full = F.when(short != "", F.concat(short, F.when(yy >= "69", F.lit("19")).otherwise("20"), yy))
    as_date = lambda c, f: F.try_to_timestamp(c, F.lit(f)).cast("date")
    return F.coalesce(
        as_date(F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), t), "M/d/yyyy"), as_date(F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t), "yyyy-M-d"), as_date(full, "M/d/yyyy")
    )
