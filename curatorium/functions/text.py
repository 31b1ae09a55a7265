"""Text expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values: they decide which names compare as equal ----
ACCENTS = "àáâãäåèéêëìíîïòóôõöøùúûüñçýÿšž''’`´"
PLAIN = "aaaaaaeeeeiiiioooooouuuuncyysz    "
LIGATURES = {"œ": "oe", "æ": "ae"}
STOPWORDS = (
    "chateau chateaux ch domaine domaines dom weingut tenuta bodega bodegas castello cantina maison "
    "the le la les l de du des d di del della von van der y et and winery estate wines"
).split()
DEFAULT_REGION = "overig"
DEFAULT_NAME = "Wijnvriend"
# ---- end of fixed values ----

_YEAR = r"(?<![\p{L}\p{N}_])(?:18|19|20)[0-9]{2}(?![\p{L}\p{N}_])"


def fold_accents(c: Column) -> Column:
    out = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTS, PLAIN)
    for glyph, letters in LIGATURES.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out


def norm_name(c: Column) -> Column:
    """Comparable form of a name: no accents, years, punctuation or filler words."""
    words = F.split(F.regexp_replace(F.regexp_replace(fold_accents(c), _YEAR, " "), "[^a-z0-9]+", " "), " ")
    # a hash lookup per word; one alternation of all fillers costs twice as much on long texts
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS)), " ")


def squash(c: Column) -> Column:
    """Accent-free letters and digits only, for fragment search."""
    return F.regexp_replace(fold_accents(c), "[^a-z0-9]+", "")


def contains_any(c: Column, fragments: list[str]) -> Column:
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | c.contains(fragment)
    return hit


def natural_key(maker: Column, name: Column) -> Column:
    return F.concat(F.lower(F.trim(F.coalesce(maker, F.lit("")))), F.lit("|"), F.lower(F.trim(name)))


def blank_to_null(c: Column, limit: int | None = None) -> Column:
    out = F.nullif(F.trim(c), F.lit(""))
    return out if limit is None else F.substring(out, 1, limit)


def slug(c: Column) -> Column:
    text = F.coalesce(F.nullif(c, F.lit("")), F.lit(DEFAULT_REGION))
    return F.regexp_replace(F.lower(text), r"\s+", "-")


def display_name(name: Column, mail: Column) -> Column:
    local = F.split_part(F.split_part(mail, F.lit("@"), F.lit(1)), F.lit("."), F.lit(1))
    return F.coalesce(blank_to_null(name), F.initcap(local), F.lit(DEFAULT_NAME))


def year_exact(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{4}$"), c.try_cast("int"))


def year_in_text(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?:18|19|20)[0-9][0-9]", 0), F.lit("")).cast("int")


def year_in_range(c: Column, as_of_year: Column | int) -> Column:
    upper = F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    return F.when(c.between(F.lit(1800), upper + 1), c)


def host_of(url: Column) -> Column:
    """Host without a leading www., null when the text is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def blend_hex(a: Column, b: Column, t: Column | float) -> Column:
    """Linear mix of two #rrggbb colours."""
    share = F.lit(t) if isinstance(t, float) else t
    parts = []
    for start in (2, 4, 6):
        x = F.conv(F.substring(a, start, 2), 16, 10).cast("double")
        y = F.conv(F.substring(b, start, 2), 16, 10).cast("double")
        level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x + (y - x) * share)) + 0.5)
        parts.append(F.lpad(F.lower(F.hex(level.cast("long"))), 2, "0"))
    return F.concat(F.lit("#"), *parts)


_PRICE = r"€\s*([0-9.]+)(?:\s*[–-]\s*([0-9.]+))?"


def price_range(c: Column) -> Column:
    """'€15–40 (37,5 cl)' -> struct(low, high, open_end); a dot groups thousands."""

    def amount(group: int) -> Column:
        digits = F.replace(F.regexp_extract(c, _PRICE, group), F.lit("."), F.lit(""))
        return F.nullif(digits, F.lit("")).cast("long")

    return F.struct(
        amount(1).alias("low"), amount(2).alias("high"), c.rlike(r"^€\s*[0-9.]+\+").alias("open_end")
    )
