"""Text that looks the same but differs in its characters, brought to one consistent form.

Every token with a foreign, compatibility, combining or invisible character is run through a
trie of the ordinary tokens of the data by a weighted edit automaton, in which look-alikes and
ignorable characters cost nothing, an accent costs little and a case difference less. The
cheapest ordinary token gives the canonical spelling and decides: the token is a case if it was
read with a look-alike or an ignorable character. A token that matches none is normalised by
table, and is a case if the table changes it. Tries are built per bucket of folded tokens, their
number by that of the tokens, so that no task or driver holds the whole vocabulary.

What looks alike is told by Unicode's public table of confusable characters, as the ICU library
that Spark ships has it, and by a short list of letters beyond it. One character may look like
several ordinary ones (a palochka like l, I or 1), of which the trie chooses.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexanchor.llm.garble import mask_garbled
from lexanchor.llm.words import INVISIBLE, strip_marks
from lexanchor.session import cut_lineage, spread

# Letters of other scripts and the Latin letters that they look like; they go before the public table.
LOOKS = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ғ": "F",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "к": "k", "ё": "ë", "ѐ": "è", "ї": "ï",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    # Greek small letters
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "γ": "y", "η": "n", "τ": "t",
    "ό": "ó", "ά": "á", "ί": "í",
    # Armenian small letters
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "զ": "q", "ց": "g",
    # Latin letters of phonetic and other alphabets
    "ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j", "ɩ": "i", "ʋ": "v", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    "ǀ": "l", "ɪ": "i", "ƿ": "p", "ʏ": "y", "ɢ": "g", "ɴ": "n", "ʀ": "r", "ʟ": "l", "ʜ": "h", "ʙ": "b",
}
# Spaces other than the ordinary one, and signs of ordinary typography that are left alone.
ODD_SPACES = "".join(map(chr, (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
TYPOGRAPHIC = "…‘’‚‛“”„‟‐‑‒–—―ªº°²³¹¼½¾´¨¸¯µ™№℃"
# Greek letters that stand in medical names.
MEDICAL_GREEK = "αβγδεζηθικλμξπρστυφχψωΑΒΓΔΩ"

_INVISIBLE = re.compile(f"[{re.escape(INVISIBLE)}]")
_ODD_SPACE = re.compile(f"[{ODD_SPACES}]")
_TOKEN = re.compile(r"[^\s\-'’–—.,;:()/«»\"*?]+")
_BEYOND = re.compile("[\u00ad\u017f-\U0010ffff]")
DROP = dict.fromkeys(map(ord, INVISIBLE))
SPACES = dict.fromkeys(map(ord, ODD_SPACES), " ")

#: Anything beyond ordinary Latin text; the cheap test that runs in the JVM. Combining marks are beyond it.
SUSPECT = "[^\\x09\\x0a\\x0d\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u0179\\u017b-\\u017e‘-”–—…€]|[\\u00a0\\u00ad]"

ACCENT_COST, CASE_COST, BUDGET = 1.0, 0.25, 3.0


def _wide(c: str) -> str | None:
    """The ordinary form of a compatibility letter, digit or sign, or None if it isn't one."""
    if ord(c) < 0x250 or c in TYPOGRAPHIC or c in SPACES:
        return None
    kind = unicodedata.decomposition(c).partition(" ")[0]
    if kind in ("<wide>", "<narrow>", "<font>", "<compat>", "<circle>", "<initial>", "<final>", "<isolated>"):
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and plain.isascii():
            return plain
    return None


_WIDE: dict[str, str | None] = {}


def wide(c: str) -> str | None:
    if c not in _WIDE:
        _WIDE[c] = _wide(c)
    return _WIDE[c]


def _script(c: str) -> str:
    code = ord(c)
    if code < 0x250:
        return "latin" if c.isalpha() else ""
    if c in "ɑɡıȷɩʋᴏᴄᴠᴡᴢꜱɪʏɢɴʀʟʜʙ":
        return "odd"
    if 0x370 <= code < 0x400:
        return "greek"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    return "other" if c.isalpha() else ""


#: Ordinary characters of one look.
ALIKE = ({"l", "I", "1", "|"}, {"O", "0"}, {"o", "0"})


class Looks(dict):
    """Letters and the ordinary letters that they look like; ``readings`` has all of those that share the look."""

    def readings(self, c: str) -> set[str]:
        plain = self.get(c)
        return set() if plain is None else {plain}.union(*(group for group in ALIKE if plain in group))


def public_looks(spark: SparkSession) -> Looks:
    """The letters of Unicode's confusables that look like ASCII letters, with those of LOOKS before them."""
    kinds = ("Ll", "Lu", "Lt", "Lo", "Lm", "Nl")
    letters = [c for c in map(chr, range(0x180, 0x20000)) if unicodedata.category(c) in kinds and not 0xD800 <= ord(c) < 0xE000]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    plain = checker.getSkeleton("\n".join(letters)).split("\n")
    found = {}
    for c, form in zip(letters, plain, strict=True):
        if form.isascii() and form.isalpha() and not unicodedata.name(c, "").startswith("LATIN CAPITAL") and wide(c) is None:
            found[c] = "I" if form == "l" and c.isupper() else "m" if form == "rn" else form
    return Looks({**found, **LOOKS})


def normalise_token(token: str, looks: dict[str, str] = LOOKS) -> str:
    """A token by table: wide forms and look-alikes to Latin where it isn't a word of its own script; composed; visible."""
    token = "".join(wide(c) or c for c in token.translate(DROP))
    token = unicodedata.normalize("NFC", token)
    if imposed(token, looks):
        token = unicodedata.normalize("NFC", "".join(looks.get(c, c) for c in token))
    return token


def _foreign(letters: list[str], looks: dict[str, str]) -> list[int]:
    return [k for k, c in enumerate(letters) if c in looks and _script(c) not in ("latin", "")]


def medical_name(token: str, looks: dict[str, str] = LOOKS) -> bool:
    """Whether the one foreign letter of the token is a Greek one at the edge of a Latin name."""
    letters = [c for c in token if c.isalpha()]
    foreign = _foreign(letters, looks)
    if len(letters) < 2 or len(foreign) != 1 or foreign[0] not in (0, len(letters) - 1) or letters[foreign[0]] not in MEDICAL_GREEK:
        return False
    rest = letters[1:] if foreign[0] == 0 else letters[:-1]
    return not (letters[foreign[0]].isupper() and any(c.islower() for c in rest))


def imposed(token: str, looks: dict[str, str] = LOOKS) -> bool:
    """Whether look-alikes stand among Latin letters in the token; a Greek letter at the edge of a name is none."""
    letters = [c for c in token if c.isalpha()]
    scripts = [_script(c) for c in letters]
    if "latin" not in scripts and "odd" not in scripts or len(letters) < 2 or medical_name(token, looks):
        return False
    return bool(_foreign(letters, looks))


def wholly_lookalike(token: str, looks: dict[str, str] = LOOKS) -> bool:
    """Whether every letter of the token is of another script, and looks like a Latin one."""
    letters = [c for c in token if c.isalpha()]
    return len(letters) > 1 and all(c in looks and _script(c) in ("greek", "cyrillic") for c in letters)


def canonical(text: str, looks: dict[str, str] = LOOKS) -> str:
    """The text by table alone."""
    if text.isascii() or not (_BEYOND.search(text) or _ODD_SPACE.search(text)):
        return text
    return _TOKEN.sub(lambda m: normalise_token(m.group(), looks), text.translate(SPACES).translate(DROP))


# Characters of one look have one form in the key, so that the trie, and not the key, tells them apart.
_ONE_LOOK = str.maketrans({"l": "i", "1": "i", "|": "i", "0": "o"})


def fold_token(token: str, looks: dict[str, str] = LOOKS) -> str:
    """The key that a token shares with every token that looks like it, whatever its case and accents."""
    if token.isascii():
        return token.casefold().translate(_ONE_LOOK)
    plain = "".join(looks.get(c, c) for c in unicodedata.normalize("NFC", "".join(wide(c) or c for c in token.translate(DROP))))
    return strip_marks(plain).casefold().translate(_ONE_LOOK)


class Match(NamedTuple):
    spelling: str
    cost: float
    looked: int  # characters that were read as others of the same look, or weren't seen


class Trie:
    """Trie of ordinary tokens, matched by a weighted edit automaton."""

    def __init__(self, looks: dict[str, str] = LOOKS) -> None:
        self.looks = looks if isinstance(looks, Looks) else Looks(looks)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, int] | None] = [None]
        self.prices: dict[str, dict[str, tuple[float, int] | None]] = {}

    def add(self, token: str, count: int) -> None:
        at = 0
        for c in token:
            following = self.children[at].get(c)
            if following is None:
                following = len(self.children)
                self.children[at][c] = following
                self.children.append({})
                self.ends.append(None)
            at = following
        if self.ends[at] is None or self.ends[at][1] < count:
            self.ends[at] = (token, count)

    def _cost(self, read: str, held: str) -> tuple[float, int] | None:
        """Cost of reading a character for another, and whether it's by look; None if they don't look alike at all."""
        if held == read:
            return 0.0, 0
        plain = self.looks.get(read) or wide(read) or read
        looked = int(plain != read)
        if held == plain or held in self.looks.readings(read):
            return 0.0, 1
        if held.casefold() == plain.casefold():
            return CASE_COST, looked
        bare, other = strip_marks(plain), strip_marks(held)
        if other == bare:
            return ACCENT_COST, looked
        return (ACCENT_COST + CASE_COST, looked) if other.casefold() == bare.casefold() else None

    def best(self, token: str, budget: float = BUDGET) -> Match | None:
        """The cheapest ordinary token within the budget; of equal ones that with the fewest look-alikes, then the commonest, then the least."""
        seen = unicodedata.normalize("NFC", token.translate(DROP))  # ignorable characters cost nothing
        states = {0: (0.0, int(seen != token))}
        none = (budget + 1, 0)
        for c in seen:
            following: dict[int, tuple[float, int]] = {}
            spelt = wide(c) or self.looks.get(c)
            spelt = spelt if spelt and len(spelt) > 1 else None  # a ligature stands for several letters
            prices = self.prices.setdefault(c, {})
            for node, (cost, looked) in states.items():
                if spelt:
                    at: int | None = node
                    for piece in spelt:
                        at = self.children[at].get(piece) if at is not None else None
                    if at is not None and (cost, looked + 1) < following.get(at, none):
                        following[at] = (cost, looked + 1)
                for held, child in self.children[node].items():
                    if held in prices:
                        step = prices[held]
                    else:
                        step = prices[held] = self._cost(c, held)
                    if step is not None and cost + step[0] <= budget:
                        reached = (cost + step[0], looked + step[1])
                        if reached < following.get(child, none):
                            following[child] = reached
            states = following
            if not states:
                return None
        ends = [(*state, -self.ends[node][1], self.ends[node][0]) for node, state in states.items() if self.ends[node]]
        if not ends:
            return None
        cost, looked, _, spelling = min(ends)
        return Match(spelling, cost, looked)


def suspects(text: str, looks: dict[str, str] = LOOKS) -> list[str]:
    """Tokens of a text that hold a character of question."""
    found = [t for t in _TOKEN.findall(text.translate(SPACES)) if _BEYOND.search(t)]
    # a letter by itself is a sign, and names with a Greek letter are ordinary
    return [t for t in found if (len(t) > 1 or _script(t) not in ("greek", "cyrillic")) and not _plain_name(t, looks)]


def _plain_name(token: str, looks: dict[str, str]) -> bool:
    return medical_name(token, looks) and not altered(token)


def altered(token: str) -> bool:
    """Whether a token has a compatibility form, a combining mark or an invisible character, whatever its letters look like."""
    if _INVISIBLE.search(token) or any(wide(c) for c in token):
        return True
    return any(0x300 <= ord(c) < 0x370 for c in token) or len(unicodedata.normalize("NFC", token)) < len(token)


def by_table(token: str, looks: dict[str, str] = LOOKS) -> bool:
    """Whether an unmatched token is a case."""
    return altered(token) or imposed(token, looks)


def by_match(token: str, found: Match, looks: dict[str, str] = LOOKS) -> bool:
    """Whether a token that an ordinary one was found for is a case: look-alikes were read.

    A token wholly of another script may be a word of it, so its look must be the very same.
    """
    if not found.looked:
        return False
    scripts = {_script(c) for c in token if c.isalpha()}
    return bool(scripts & {"latin", "odd"}) or altered(token) or (wholly_lookalike(token, looks) and not found.cost)


def _match(looks: Looks):
    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        """Suspect tokens of one bucket against the trie of its ordinary tokens."""
        trie = Trie(looks)
        for token, count in bucket.loc[~bucket["odd"], ["token", "n"]].itertuples(index=False):
            trie.add(token, int(count))
        rows = []
        for token in bucket.loc[bucket["odd"], "token"]:
            found = trie.best(token)
            if found:
                rows.append((token, found.spelling, True, by_match(token, found, looks)))
            else:
                rows.append((token, normalise_token(token, looks), False, by_table(token, looks)))
        return pd.DataFrame(rows, columns=["token", "canonical", "matched", "odd_one"])

    return run


#: Tokens of a bucket, on average; the trie of a bucket has a few times as many nodes.
BUCKET_TOKENS = 20_000


def canonical_tokens(values: DataFrame, looks: Looks) -> DataFrame:
    """``(token, canonical, matched, odd_one)`` of every suspect token among ``values(value, n)``."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[tuple[str, bool], int] = {}
            for value, n in zip(pdf["value"], pdf["n"], strict=True):
                odd: set[str] = set()
                if not value.isascii():
                    masked = mask_garbled(value)
                    odd = set(suspects(value, looks))
                    if masked != value:
                        odd.update(suspects(masked, looks))
                        for token in odd:
                            rows.setdefault((token, True), 0)
                for token in _TOKEN.findall(value if value.isascii() else value.translate(SPACES)):
                    if not token.isascii() or len(token) > 1:
                        key = (token, token in odd)
                        rows[key] = rows.get(key, 0) + int(n)
            yield pd.DataFrame(
                [(t, fold_token(t, looks), odd, n) for (t, odd), n in rows.items()], columns=["token", "key", "odd", "n"]
            )

    counted = (
        spread(values).mapInPandas(tokens, "token string, key string, odd boolean, n long")
        .groupBy("token", "key", "odd")
        .agg(F.sum("n").alias("n"))
    )
    # only keys that some suspect token folds to are of use
    wanted = counted.where("odd").select("key").distinct()
    kept = cut_lineage(counted.join(wanted, "key", "left_semi"))
    buckets = max(-(-kept.count() // BUCKET_TOKENS), int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        kept.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        .applyInPandas(_match(looks), "token string, canonical string, matched boolean, odd_one boolean")
    )


def is_case(text: str, odd_ones: set[str] | frozenset[str], looks: dict[str, str] = LOOKS) -> bool:
    """Whether the text holds characters that stand for ordinary ones or can't be seen: one of its tokens, or a space between them.

    Sequences left by a wrong decoding are masked first.
    """
    text = mask_garbled(text)
    return bool(_INVISIBLE.search(text) or _ODD_SPACE.search(text)) or any(wide(c) for c in text) or any(t in odd_ones for t in suspects(text, looks))


def _decide(looks: Looks):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, forms = [], []
            for value, found in zip(pdf["value"], pdf["found"], strict=True):
                found = [] if found is None else found
                if is_case(value, frozenset(f["token"] for f in found if f["odd_one"]), looks):
                    text = unicodedata.normalize("NFC", value.translate(SPACES))
                    spelt = {unicodedata.normalize("NFC", f["token"]): f["canonical"] for f in found if f["matched"]}
                    values.append(value)
                    forms.append(_TOKEN.sub(lambda m, s=spelt: s.get(m.group()) or normalise_token(m.group(), looks), text).translate(DROP))
            if values:
                yield pd.DataFrame({"value": values, "canonical": forms})

    return run


def lookalike_rows(tables: DataFrame) -> DataFrame:
    """``(tbl, row_id, value, canonical)`` of every row of ``tables(tbl, row_id, value)`` that only looks ordinary.

    Null and empty values are no cases; repeated rows come out once; values of any length are
    read whole; a hot value is decided once and joined back. Precomposed accents, words of
    another script, Greek letters of names, typographic signs and wrongly decoded text stay.
    """
    rows = tables.select("tbl", "row_id", "value").where(F.length("value") > 0)
    values = rows.groupBy("value").agg(F.count("*").alias("n"))
    looks = public_looks(tables.sparkSession)
    spelling = canonical_tokens(values, looks)
    suspect = values.where(F.col("value").rlike(SUSPECT)).select("value")

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, t) for v in pdf["value"] for t in dict.fromkeys([*suspects(v, looks), *suspects(mask_garbled(v), looks)]) or [""]]
            yield pd.DataFrame(rows, columns=["value", "token"])

    found = (
        suspect.mapInPandas(explode, "value string, token string")
        .join(spelling, "token", "left")
        .groupBy("value")
        .agg(F.collect_list(F.when(F.col("canonical").isNotNull(), F.struct("token", "canonical", "matched", "odd_one"))).alias("found"))
    )
    cases = spread(found).mapInPandas(_decide(looks), "value string, canonical string")
    return rows.where(F.col("value").rlike(SUSPECT)).join(cases, "value").select("tbl", "row_id", "value", "canonical").distinct()
