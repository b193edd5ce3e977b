"""Text scalars as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# What the reference's normaliser folds and strips.
CURLY_SINGLE, CURLY_DOUBLE = "‘’", "“”"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
ESCAPES = r"\\[nrtf]"

# Greek letters and their Latin names; µ is the micro sign, ς final sigma, ϕ the phi symbol.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "µ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi",
    "ρ": "rho", "σ": "sigma", "ς": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "ϕ": "phi", "χ": "chi", "ψ": "psi",
    "ω": "omega",
}

# Articles, heads that take "de", "du" or "d'", and heads of streets and buildings.
ARTICLES = ("la ", "le ", "les ", "l'")
HEADS = (
    "[eé]tat", "province", "province chinoise", "r[eé]gion", "ville", "[iî]les?", "d[eé]partement", "r[eé]publique",
    "district", "comt[eé]", "canton", "territoire", "pays", "golfe", "mer",
)
STREETS = ("palais ", "rue ", "boulevard ", "avenue ", "place ")
# Administrative nouns that may stand before a name without "de".
BARE_HEADS = (
    "r[ée]gion", "province", "d[ée]partement", "[ée]tat", "district", "arrondissement", "commune", "sous-pr[ée]fecture",
    "pr[ée]fecture", "comt[ée]", "canton",
)
PREFIX = "(?:" + "|".join((*ARTICLES, *(f"{h} d(?:e |u |')" for h in HEADS), *STREETS)) + ")"
BARE = "(?:" + "|".join(BARE_HEADS) + ")"
# Substrings that ask for an administrative unit.
ADMIN_WORDS = (
    "region ", "province ", "departement ", "etat ", "region d", "province d", "comte ", "comte d", "commune ",
    "sous-prefecture", "prefecture", "district ", "arrondissement ", "municipalite",
)


def _icu(method: str, text: ColumnOrName, compatible: bool) -> Column:
    """A call of the ICU library that Spark ships, which doesn't take nulls."""
    text = _col(text)
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), F.coalesce(text, F.lit("")), F.lit(compatible))
    return F.when(text.isNotNull(), done)


def nfc(text: ColumnOrName) -> Column:
    """Canonical composition; pure ASCII is passed through."""
    text = _col(text)
    return F.when(text.rlike("[^\\x00-\\x7f]"), _icu("compose", text, False)).otherwise(text)


def nfkd(text: ColumnOrName) -> Column:
    """Compatibility decomposition."""
    return _icu("decompose", text, True)


def normalize(text: ColumnOrName) -> Column:
    """Lower, compose, literal escapes to a space, straight quotes, one space, trimmed."""
    out = nfc(F.lower(_col(text)))
    out = F.regexp_replace(out, ESCAPES, " ")
    out = F.translate(out, CURLY_SINGLE + CURLY_DOUBLE, "''\"\"")
    return F.trim(F.regexp_replace(out, WHITESPACE, " "))


def remove_accents(text: ColumnOrName) -> Column:
    """Compatibility decomposition without combining marks; pure ASCII is passed through."""
    text = _col(text)
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.regexp_replace(nfkd(text), r"\p{Mn}+", "")).otherwise(text)


def transliterate_greek(text: ColumnOrName) -> Column:
    """Greek letters by their Latin names; a text without any is passed through."""
    text = _col(text)
    out = text
    for letter, name in GREEK.items():
        out = F.replace(out, F.lit(letter), F.lit(name))
    return F.when(text.rlike("[" + "".join(GREEK) + "]"), out).otherwise(text)


def strip_prefix(text: ColumnOrName) -> Column:
    """T4: leading articles and place nouns removed as long as any is left."""
    return F.trim(F.regexp_replace(_col(text), rf"(?iu)^(?:{PREFIX}\s*)+", ""))


def strip_bare_admin(text: ColumnOrName) -> Column:
    """T5: a leading administrative noun removed where no "de", "du" or "d'" follows."""
    return F.regexp_replace(_col(text), rf"(?iu)^{BARE}\s+(?!d[eu'])", "")


def hyphen_to_space(text: ColumnOrName) -> Column:
    return F.translate(_col(text), "-", " ")


def tails(text: ColumnOrName) -> Column:
    """Of at least three words the endings, shortest first, without the whole."""
    words = F.split(_col(text), " ")
    n = F.size(words)
    ends = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(words, n - k + 1, k), " "))
    return F.when(n >= 3, ends).otherwise(F.array().cast("array<string>"))


def context(text: ColumnOrName, start: ColumnOrName, end: ColumnOrName, width: int = 200) -> Column:
    """The text from ``width`` characters before the span to as many after it."""
    begin = F.greatest(_col(start) - width, F.lit(0))
    return F.substring(_col(text), begin + 1, F.greatest(_col(end) + width - begin, F.lit(0)))


def wants_admin(mention: ColumnOrName) -> Column:
    """Whether the unaccented normal form holds one of the administrative words."""
    plain = remove_accents(normalize(mention))
    return F.coalesce(plain.rlike("|".join(ADMIN_WORDS)), F.lit(False))


def head_token(name: ColumnOrName) -> Column:
    """The part before the first comma, trimmed, lower."""
    return F.lower(F.trim(F.split_part(_col(name), F.lit(","), F.lit(1))))


def leading_int(text: ColumnOrName) -> Column:
    """T12."""
    return F.regexp_extract(_col(text), r"^(\d+)", 1).try_cast("int")


def last_int(text: ColumnOrName) -> Column:
    """The last integer outside think-blocks."""
    bare = F.regexp_replace(_col(text), r"(?is)<think>.*?</think>", "")
    found = F.regexp_extract_all(bare, F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).try_cast("int")


def abstain_int(text: ColumnOrName) -> Column:
    """The integer after "answer:", else the last signed one."""
    said = F.regexp_extract(_col(text), r"(?i)answer:\s*(-?\d+)", 1)
    found = F.regexp_extract_all(_col(text), F.lit(r"-?\d+"), F.lit(0))
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    return F.coalesce(F.nullif(said, F.lit("")), last).try_cast("int")


def first_span(span: ColumnOrName) -> Column:
    """First number of a span written as a number or a list of numbers."""
    return F.regexp_extract(_col(span), r"(\d+)", 1).try_cast("int")


# The grammar of knowledge-base ids.
MESH_ID = r"^[DC]\d{6,9}(?:\s*&\s*[DC]\d{6,9})*(?:\s*:\s*C\d{6,9}(?:\s*\|\s*C\d{6,9})*)?\z"
GEO_ID = r"^\d{1,12}\z"


def descriptor_ids(id_kb: ColumnOrName) -> Column:
    """Ids left of the colon."""
    return F.filter(F.split(F.split_part(_col(id_kb), F.lit(":"), F.lit(1)), r"\s*&\s*"), lambda x: F.trim(x) != "")


def supplemental_ids(id_kb: ColumnOrName) -> Column:
    """Ids right of the colon."""
    return F.filter(F.split(F.split_part(_col(id_kb), F.lit(":"), F.lit(2)), r"\s*\|\s*"), lambda x: F.trim(x) != "")


# Words of mentions that the knowledge bases don't cover.
GEO_NIL = r"(?iuU)^(?:quartier|zone|bassins?|ceinture)\b"
TOXIN_NIL = r"(?iuU)\b(?:venom|venin)\b"
ACRONYM = "^[A-ZÉÈÀ0-9]{2,6}$"
STRAIN = r"(?iuU)\b(?:souche|s[eé]rotype|strain|ehec|epec|stec|ehe|o1\d{2,3}|o\d{1,2}[:\-]?h\d+|h\d+n\d+)\b"
MEDICAL_LABELS = ("INF_DISEASE", "NON_INF_DISEASE", "BIO_TOXIN", "PATHOGEN", "PATH_REF_TO_DIS", "DIS_REF_TO_PATH")


def likely_nil(text: ColumnOrName, label: ColumnOrName) -> Column:
    """P1, P2."""
    text, label = _col(text), _col(label)
    return F.coalesce(((label == "LOCATION") & text.rlike(GEO_NIL)) | ((label == "BIO_TOXIN") & text.rlike(TOXIN_NIL)), F.lit(False))


def is_acronym(text: ColumnOrName) -> Column:
    """P3."""
    return F.coalesce(F.trim(_col(text)).rlike(ACRONYM), F.lit(False))


# P8, fixed values: checks for artifacts of a mention.
ARTIFACTS = {
    "literal_escape": lambda t: t.rlike(ESCAPES),
    "html_entity": lambda t: t.rlike(r"&(?:[a-zA-Z]+|#\d+);"),
    "control_char": lambda t: t.rlike(r"[\x00-\x1f]"),
    "nbsp_or_zerowidth": lambda t: t.rlike(r"[\u00a0\u202f\u200b\ufeff\u200e\u200f]"),
    "double_space": lambda t: F.contains(t, F.lit("  ")),
    "long_dash": lambda t: t.rlike(r"[\u2010\u2012\u2013\u2014\u2015]"),
    "edge_punct": lambda t: t.rlike(r"^[^\p{L}\p{N}]|[^\p{L}\p{N}]\z"),
    "case_glue": lambda t: t.rlike(r"\p{Ll}\p{Lu}"),
}

# The checks that a report is made of.
HIGH_SIGNAL = ("literal_escape", "html_entity", "control_char", "nbsp_or_zerowidth")
# P11, fixed values: what UTF-8 read as a single-byte encoding leaves of common signs.
MOJIBAKE = ("Ã©", "Ã¨", "Ãª", "Ã ", "Ã§", "Â°", "Â«", "Â»", "â\x80\x99")


def looks_garbled(text: ColumnOrName) -> Column:
    """P11."""
    return F.coalesce(_col(text).rlike("|".join(MOJIBAKE)), F.lit(False))


def span_list(span: ColumnOrName) -> Column:
    """A span written as a number or a list of numbers, as a list of numbers."""
    return F.transform(F.regexp_extract_all(_col(span), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))


def spans(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Starts with their ends, cut to the shorter list."""
    s, e = span_list(start), span_list(end)
    n = F.least(F.size(s), F.size(e))
    return F.zip_with(F.slice(s, F.lit(1), n), F.slice(e, F.lit(1), n), lambda a, b: F.struct(a.alias("s"), b.alias("e")))


def cut_points(text: ColumnOrName, found: ColumnOrName) -> Column:
    """Where a text is cut: its ends and all distinct ends of spans ``(s, e)``, sorted."""
    text, found = _col(text), _col(found)
    ends = F.array(F.lit(0), F.length(text))
    return F.array_sort(F.array_distinct(F.flatten(F.array(ends, F.transform(found, lambda x: x["s"]), F.transform(found, lambda x: x["e"])))))


def escape_html(text: ColumnOrName) -> Column:
    out = _col(text)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def highlight(text: ColumnOrName, found: ColumnOrName) -> Column:
    """The text as HTML, cut at the ends of spans, with every piece inside one marked."""
    text, found = _col(text), _col(found)
    cuts = cut_points(text, found)
    pieces = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def piece(x: Column) -> Column:
        a, b = x["a"], x["b"]
        chunk = escape_html(F.substring(text, a + 1, F.greatest(b - a, F.lit(0))))
        return F.when(F.exists(found, lambda y: (y["s"] <= a) & (b <= y["e"])), F.concat(F.lit("<mark>"), chunk, F.lit("</mark>"))).otherwise(chunk)

    return F.array_join(F.transform(pieces, piece), "")
