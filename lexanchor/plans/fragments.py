"""DuckDB text fragments that say the same as the Column functions."""

from __future__ import annotations

import unicodedata

from lexanchor.functions import text as T

SPACES = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]+"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F)))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normalize(x: str) -> str:
    x = f"nfc_normalize(lower({x}))"
    x = rf"regexp_replace({x}, '\\[nrtf]', ' ', 'g')"
    x = f"""translate({x}, '{T.CURLY_SINGLE}{T.CURLY_DOUBLE}', '''''""')"""
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def _compat() -> dict[str, str]:
    """Compatibility characters whose decomposition DuckDB's strip_accents leaves alone."""
    codes = [*range(0xA0, 0x180), *range(0x2010, 0x2040), 0x2122, *range(0x2160, 0x2180), *range(0xFB00, 0xFB07)]
    out = {}
    for c in map(chr, codes):
        plain = "".join(d for d in unicodedata.normalize("NFKD", c) if unicodedata.category(d) != "Mn")
        if unicodedata.decomposition(c).startswith("<"):
            out[c] = plain
    return out


def remove_accents(x: str) -> str:
    single = {c: p for c, p in _compat().items() if len(p) == 1}
    x = f"translate({x}, {quote(_WIDE + ''.join(single))}, {quote(_ASCII + ''.join(single.values()))})"
    for c, p in _compat().items():
        if len(p) != 1:
            x = f"replace({x}, {quote(c)}, {quote(p)})"
    return f"strip_accents({x})"


def transliterate_greek(x: str) -> str:
    for letter, name in T.GREEK.items():
        x = f"replace({x}, '{letter}', '{name}')"
    return x


def strip_prefix(x: str) -> str:
    return f"trim(regexp_replace({x}, {quote(f'^(?:{T.PREFIX}' + chr(92) + 's*)+')}, '', 'i'))"


def strip_bare_admin(x: str) -> str:
    head = f"^{T.BARE}" + r"\s+"
    return (
        f"CASE WHEN regexp_matches({x}, {quote(head)}, 'i') AND NOT regexp_matches({x}, {quote(head + chr(100) + '[eu' + chr(39) + ']')}, 'i') "
        f"THEN regexp_replace({x}, {quote(head)}, '', 'i') ELSE {x} END"
    )


def tails(x: str) -> str:
    words = f"string_split({x}, ' ')"
    return (
        f"CASE WHEN len({words}) >= 3 THEN list_transform(range(1, len({words})), "
        f"lambda k: array_to_string({words}[len({words}) - k + 1:], ' ')) ELSE [] END"
    )


def wants_admin(x: str) -> str:
    return f"regexp_matches({remove_accents(normalize(x))}, {quote('|'.join(T.ADMIN_WORDS))})"


def first_int(x: str) -> str:
    return rf"TRY_CAST(regexp_extract({x}, '(\d+)', 1) AS INT)"


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    h = f"least(1.0, greatest(0.0, {h}))"
    return (
        f"CASE WHEN isfinite({a}) AND isfinite({b}) AND isfinite({c}) AND isfinite({d}) "
        f"THEN 12742.0 * atan2(sqrt({h}), sqrt(1 - {h})) ELSE 'infinity'::DOUBLE END"
    )


def isin(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(map(quote, values))})"


PLACES = """places AS (
  SELECT geonameid, p.name, p.country_code, p.feature_class, p.feature_code, p.population, p.latitude, p.longitude FROM (
    SELECT geonameid, (list(p ORDER BY p.name NULLS FIRST, p.country_code NULLS FIRST, p.feature_class NULLS FIRST,
        p.feature_code NULLS FIRST, p.population NULLS FIRST, p.latitude NULLS FIRST, p.longitude NULLS FIRST))[1] AS p
    FROM (SELECT geonameid, {'name': name, 'country_code': country_code, 'feature_class': feature_class,
        'feature_code': feature_code, 'population': population, 'latitude': latitude, 'longitude': longitude} AS p
      FROM locations WHERE geonameid IS NOT NULL) GROUP BY geonameid))"""

NAMES = """names AS (
  SELECT DISTINCT geonameid, lower(trim(k)) AS key FROM (
    SELECT geonameid, name AS k FROM locations UNION ALL SELECT geonameid, asciiname FROM locations
    UNION ALL SELECT geonameid, name_lower FROM place_names)
  WHERE geonameid IS NOT NULL AND k IS NOT NULL AND lower(trim(k)) <> '')"""

MENTIONS = "mentions AS (SELECT DISTINCT text AS mention FROM entities WHERE label = 'LOCATION' AND text IS NOT NULL)"
