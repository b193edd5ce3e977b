"""Text garbled by a wrong decoding: found and restored with a character n-gram model.

A smoothed character trigram model is counted over all clean records. Each word with
characters beyond ASCII gets a candidate for every chain "encode as B, decode as A" that is
possible on it; the likeliest candidate is accepted if it beats the word as it stands by more
than a margin. The margin is validated on all words of held-out records, unharmed and garbled on
purpose, by a model that was counted without those records. The model is a table of fixed size
(hashed trigrams), so what is broadcast doesn't grow with the data.

Only texts that some chain could change at all, which a pattern made of the model's characters
tells in the JVM, are scored in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexanchor.session import spread

# The encodings that UTF-8 is wrongly read as, and the single-byte pairs (read as, written in).
READ_AS = ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1251", "cp1250", "iso8859-15")
SINGLE_BYTE = (
    ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("latin-1", "cp850"), ("latin-1", "mac_roman"),
    ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"),
)

TRI_BITS, BI_BITS = 20, 16
CLASSES = 3072
#: One record of so many is held out for the validation of the margin.
HELD_OUT = 16
MARGINS = (1.0, 2.0, 3.0, 4.0)
#: How much commoner the rarest character of a restored word must be than that of the garbled one, by kind of chain.
COMMONER = {"utf8": 1.0, "single": 3.0}
#: Log prior of a chain's kind: a valid UTF-8 sequence hardly ever comes about by chance.
PRIOR = {"utf8": 2.0, "single": 0.0}
#: N-grams of at most this count, and share of all characters, are taken for noise.
NOISE_COUNT, NOISE_SHARE = 2.0, 3e-7

# Zero-width characters, which may stand within a garbled sequence.
ZERO_WIDTH = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_RUN = re.compile(r"[^\x00-\x7f]+")
#: The sign of a lost character; and characters that no candidate and no clean record has.
_LOST = re.compile("�")
_UNCLEAN = re.compile("[�\x80-\x9f─-▟]")


def _to_byte(encoding: str) -> dict[str, int]:
    table = {}
    for byte in range(128, 256):
        try:
            table[bytes([byte]).decode(encoding)] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte  # an undefined byte is read as the control character of its number
    return table


TO_BYTE = {name: _to_byte(name) for name in READ_AS}
TO_CHAR = {name: {b: c for c, b in table.items()} for name, table in TO_BYTE.items()}


def _sequences(table: dict[str, int]) -> str:
    """A pattern of two characters whose bytes may begin a UTF-8 sequence."""
    leads = "".join(c for c, b in table.items() if 0xC2 <= b <= 0xF4)
    following = "".join(c for c, b in table.items() if 0x80 <= b <= 0xBF)
    return f"[{re.escape(leads)}][{re.escape(following)}]"


#: For each encoding the encodings' quick test, and one for all: most texts have no such sequence.
HAS_SEQUENCE = {name: re.compile(_sequences(table)) for name, table in TO_BYTE.items()}
HAS_ANY = re.compile("|".join(_sequences(table) for table in TO_BYTE.values()))


def _either() -> str:
    """Whatever HAS_ANY finds this finds too, with one class of characters each for all encodings."""
    pairs = [(c, b) for table in TO_BYTE.values() for c, b in table.items()]
    leads, following = ({c for c, b in pairs if low <= b <= high} for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))
    return f"[{re.escape(''.join(sorted(leads)))}][{re.escape(''.join(sorted(following)))}]"


_MAY_HAVE = re.compile(_either())


def has_sequence(text: str) -> bool:
    """Whether two characters stand together whose bytes may begin a UTF-8 sequence."""
    return _MAY_HAVE.search(text) is not None and HAS_ANY.search(text) is not None


def _utf8_run(run: str, table: dict[str, int]) -> str:
    """The run with every valid UTF-8 sequence of the characters' bytes decoded."""
    codes = [table.get(c, 0) for c in run]
    out, i, n = [], 0, len(run)
    while i < n:
        lead = codes[i]
        width = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if width and i + width <= n and all(0x80 <= codes[i + k] <= 0xBF for k in range(1, width)):
            try:
                out.append(bytes(codes[i : i + width]).decode("utf-8"))
                i += width
                continue
            except UnicodeDecodeError:
                pass
        out.append(run[i])
        i += 1
    return "".join(out)


def undo_utf8(text: str) -> str:
    """UTF-8 read as a single-byte encoding, undone by the first encoding that explains the text; no model."""
    if text.isascii() or not has_sequence(text):
        return text
    for encoding in READ_AS:
        if not HAS_SEQUENCE[encoding].search(text):
            continue
        table = TO_BYTE[encoding]
        fixed = _RUN.sub(lambda m, t=table: _utf8_run(m.group(), t), text)
        if fixed != text:
            twice = _RUN.sub(lambda m, t=table: _utf8_run(m.group(), t), fixed)
            return twice
    return text


# Signs besides letters that decoded text of the domain may hold.
_SIGNS = "«»°±§µ·\xa0‘’“”–—…€"


def mask_garbled(text: str, mask: str = "e") -> str:
    """The text with every sequence that UTF-8 read as a single-byte encoding leaves put as a plain letter."""
    if text.isascii():
        return text
    text = re.sub("[Ãã]\xa0", mask, text)
    if not has_sequence(text):
        return text
    for encoding in READ_AS:
        if not HAS_SEQUENCE[encoding].search(text):
            continue
        table = TO_BYTE[encoding]

        def put(match: re.Match, table: dict = table) -> str:
            run, out, i = match.group(), [], 0
            while i < len(run):
                for width in (3, 2):
                    part = run[i : i + width]
                    fixed = _utf8_run(part, table)
                    if len(part) == width and len(fixed) == 1 and (fixed in _SIGNS or (fixed.isalpha() and ord(fixed) < 0x400)):
                        out.append(mask)
                        i += width
                        break
                else:
                    out.append(run[i])
                    i += 1
            return "".join(out)

        text = _RUN.sub(put, text)
    return text


def _same_kind(before: str, after: str) -> bool:
    """Whether letters stay letters, no capital comes to follow a small letter, and no small one a capital it hadn't."""
    for k, (old, new) in enumerate(zip(before, after, strict=True)):
        if old == new:
            continue
        if old.isalpha() and not new.isalpha():
            return False
        if k and new.isupper() and before[k - 1].islower() and after[k - 1].islower():
            return False
        if k and new.islower() and old.isupper() and before[k - 1].isupper():
            return False
    return True


_IN_WORD = re.compile("[A-Za-z][‚ŠŒ“”ˆ‰™Žš…†‡×–\x80-\x9f][a-z]")
# Letters that restored text should hold.
_LETTERS = frozenset("éèêàâîôùûçïëÉÈÊÀÂÎÔÇ")


def undo_any(text: str) -> str:
    """Wrong decodings undone without a model: UTF-8 sequences, else one single-byte chain for the whole text."""
    text = undo_utf8(text)
    if text.isascii() or not _IN_WORD.search(text):
        return text

    def gain(form: str) -> int:
        return sum(1 if c in _LETTERS else -1 for c in form if c > "\x7f" and not c.isspace())

    best, most = text, gain(text) + 2
    for read, written in SINGLE_BYTE:
        table, back = TO_BYTE[read], TO_CHAR[written]
        form = "".join(c if c <= "\x7f" else back.get(table.get(c, -1), c) for c in text)
        if gain(form) > most:
            best, most = form, gain(form)
    return best


def may_be_utf8(plain: str) -> bool:
    """Whether any chain of UTF-8 can apply to the word, as it is or lower-cased after the wrong decoding."""
    return bool(has_sequence(plain) or has_sequence(plain.upper()) or plain.endswith(("Ã", "ã")))


def candidates(word: str, utf8: bool = True, single: bool = True) -> dict[str, str]:
    """What the word may have been, by every chain that is possible on it, with the kind of chain."""
    found: dict[str, str] = {}
    plain = word.translate(ZERO_WIDTH)
    raised = _RUN.sub(lambda m: m.group().upper(), plain)
    for encoding in READ_AS if utf8 else ():
        table = TO_BYTE[encoding]
        for form, lower in ((plain, False), (raised, True)):
            if form == plain and lower:
                continue
            fixed = _RUN.sub(lambda m, t=table: _utf8_run(m.group(), t), form)
            if fixed == form and form[-1:] == "Ã" and not form[-2:-1].isalpha():  # the no-break space of a final sequence was trimmed
                fixed = form[:-1] + _utf8_run(form[-1] + "\xa0", table)
            if fixed == form:
                continue
            found[fixed.lower() if lower else fixed] = "utf8"
            again = _RUN.sub(lambda m, t=table: _utf8_run(m.group(), t), fixed)
            if again != fixed:
                found[again.lower() if lower else again] = "utf8"
    for read, written in SINGLE_BYTE if single else ():
        table, back = TO_BYTE[read], TO_CHAR[written]
        fixed = _RUN.sub(lambda m, t=table, b=back: "".join(b.get(t.get(c, -1), c) for c in m.group()), plain)
        if fixed != plain and _same_kind(plain, fixed):
            found.setdefault(fixed, "single")
    found.pop(word, None)
    found.pop(plain, None)
    return found


def _class_table() -> np.ndarray:
    """Latin, Greek, Cyrillic, punctuation, symbols and box drawings each by itself, all others by their block of 128."""
    code = np.arange(0x110000)
    out = np.where(code < 1328, code, 2352 + (code >> 7) % (CLASSES - 2352))
    out = np.where((code >= 0x2000) & (code < 0x2300), code - 0x2000 + 1328, out)
    return np.where((code >= 0x2500) & (code < 0x2600), code - 0x2500 + 2096, out).astype(np.int64)


_CLASS = _class_table()


def _classes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _bucket(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tri = (((a * CLASSES + b) * CLASSES + c) * 0x9E3779B1) & 0x7FFFFFFFFFFF
    bi = ((a * CLASSES + b) * 0x85EBCA6B) & 0x7FFFFFFFFFFF
    return (tri >> 13) & ((1 << TRI_BITS) - 1), (bi >> 13) & ((1 << BI_BITS) - 1)


@dataclass
class Model:
    tri: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    single: np.ndarray
    margin: float = 4.0
    kept: dict = field(default_factory=dict)
    commoner: dict = field(default_factory=dict)

    def log_likelihood(self, word: str) -> float:
        """Interpolated trigram log-probability of the word between two spaces."""
        code = _classes(f"  {word} ")
        a, b, c = code[:-2], code[1:-1], code[2:]
        tri, bi = _bucket(a, b, c)
        _, second = _bucket(b, c, c)
        p1 = (self.single[c] + 0.05) / (self.single.sum() + 0.05 * CLASSES)
        p2 = (self.pair[second] + 20.0 * p1) / (self.single[b] + 20.0)
        p3 = (self.tri[tri] + 4.0 * p2) / (self.context[bi] + 4.0)
        return float(np.log(np.minimum(p3, 1.0)).sum())

    def rarest(self, word: str) -> float:
        """Count of the rarest character beyond ASCII, or infinity for an ASCII word."""
        beyond = _RUN.findall(word)
        return float(self.single[_classes("".join(beyond))].min()) + 0.05 if beyond else float("inf")

    def replaceable(self, word: str) -> bool:
        """Whether a single-byte chain puts a much commoner character for the rarest one; none can succeed otherwise."""
        counts = {c: self.single[_classes(c)[0]] + 0.05 for c in word if c > "\x7f"}
        rarest = min(counts, key=counts.get)
        known = self.commoner.get(rarest)
        if known is None:
            others = [TO_CHAR[written].get(TO_BYTE[read].get(rarest, -1)) for read, written in SINGLE_BYTE]
            # a letter stays a letter
            fit = [c for c in others if c and c != rarest and (c.isalpha() or not rarest.isalpha())]
            most = max((self.single[_classes(c)[0]] + 0.05 for c in fit), default=0.0)
            known = self.commoner[rarest] = bool(most >= COMMONER["single"] * counts[rarest])
        return known

    def pattern(self) -> str:
        """A Java pattern of every text with a word that some chain could change, or with a lost character."""
        raised: dict[str, list[str]] = {}
        for c in map(chr, range(0x80, 0x2100)):
            if len(c.upper()) == 1 and c.upper() != c:
                raised.setdefault(c.upper(), []).append(c)

        def listed(chars, lower: bool = True) -> str:
            every = {x for c in chars for x in (c, *(raised.get(c, ()) if lower else ()))}
            return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(every)) + "]"

        unseen = listed(map(chr, ZERO_WIDTH)) + "*"
        parts = [listed("�"), f"{listed('Ã')}{unseen}(?=[ \\t\\r\\n]|\\z)"]
        for table in TO_BYTE.values():
            leads, following = (c for c, b in table.items() if 0xC2 <= b <= 0xF4), (c for c, b in table.items() if 0x80 <= b <= 0xBF)
            parts.append(listed(leads) + unseen + listed(following))
        single = [c for c in {c for table in TO_BYTE.values() for c in table} if self.replaceable(c)]
        # every alternative begins beyond ASCII, which is tested first
        return f"(?=[^\\x00-\\x7f])(?:{'|'.join([*parts, listed(single, False)] if single else parts)})"

    def best(self, word: str) -> tuple[str, float]:
        """The likeliest candidate of commoner characters and its gain over the word as it stands."""
        plain = word.translate(ZERO_WIDTH)
        floor = self.rarest(plain)
        if floor > self.single[128:].max():
            return word, 0.0
        utf8, single = may_be_utf8(plain), self.replaceable(plain)
        if not utf8 and not single:
            return word, 0.0
        chosen, gain, stands = word, 0.0, self.log_likelihood(plain)
        for candidate, kind in candidates(word, utf8, single).items():
            if self.rarest(candidate) >= floor * COMMONER[kind] and not _UNCLEAN.search(candidate):
                more = self.log_likelihood(candidate) - stands + PRIOR[kind]
                if more > gain:
                    chosen, gain = candidate, more
        return chosen, gain

    def restore(self, word: str) -> str:
        """The word restored, or as it is."""
        if word.isascii():
            return word
        known = self.kept.get(word)
        if known is None:
            chosen, gain = self.best(word)
            known = chosen if gain > self.margin else word
            if len(self.kept) > 300_000:
                self.kept.clear()
            self.kept[word] = known
        return known

    def __getstate__(self):
        return {**self.__dict__, "kept": {}}


_BEYOND = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")


def restore_text(model: Model, text: str) -> tuple[str, bool]:
    """The text with garbled words restored, and whether it is a case: any word changed or lost."""
    if text.isascii():
        return text, False
    kept, changed = model.kept, False
    for word in _BEYOND.findall(text):
        known = kept.get(word)
        if known is None:
            known = model.restore(word)
        if known is not word and known != word:
            changed = True
            break
    if changed:
        text = _BEYOND.sub(lambda m: model.restore(m.group()), text)
    return text, changed or _LOST.search(text) is not None


def _looks_clean(text: str) -> bool:
    if _UNCLEAN.search(text) is not None:
        return False
    return not has_sequence(text) or all(
        _RUN.sub(lambda m, t=TO_BYTE[e]: _utf8_run(m.group(), t), text) == text for e in ("cp1252", "mac_roman", "cp437")
    )


SIZES = {"tri": 1 << TRI_BITS, "context": 1 << BI_BITS, "pair": 1 << BI_BITS, "single": CLASSES}
#: Characters that are counted at once.
SLICE = 500_000
_SPACES = re.compile(r"[ \t\r\n]+")


def _add(texts: list[str], total: dict[str, np.ndarray]) -> None:
    code = _classes(_SPACES.sub("  ", "\n".join(["", *texts, ""])))  # as words are scored
    a, b, c = code[:-2], code[1:-1], code[2:]
    keep = ~((b == 32) & (c == 32))
    a, b, c = a[keep], b[keep], c[keep]
    tri, bi = _bucket(a, b, c)
    _, second = _bucket(b, c, c)
    for kind, at in (("tri", tri), ("context", bi), ("pair", second), ("single", c)):
        total[kind] += np.bincount(at, minlength=SIZES[kind])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the hashed n-grams of a partition's clean texts, those of held-out records by themselves."""
    totals = {held: {k: np.zeros(n, np.int64) for k, n in SIZES.items()} for held in (False, True)}
    waiting: dict[bool, list[str]] = {False: [], True: []}
    sizes = {False: 0, True: 0}
    for pdf in batches:
        for text, held in zip(pdf["text"], pdf["held"], strict=True):
            if text.isascii() or _looks_clean(text):
                waiting[held].append(text)
                sizes[held] += len(text)
                if sizes[held] > SLICE:
                    _add(waiting[held], totals[held])
                    waiting[held], sizes[held] = [], 0
    for held, total in totals.items():
        if waiting[held]:
            _add(waiting[held], total)
        for kind, counts in total.items():
            at = np.flatnonzero(counts)
            if len(at):
                yield pd.DataFrame({"held": held, "kind": kind, "bucket": at, "n": counts[at]})


def _garble(word: str, read: str, written: str) -> str | None:
    try:
        code = word.encode(written)
    except UnicodeEncodeError:
        return None
    return "".join(chr(b) if b < 128 else TO_CHAR[read][b] for b in code)


# Chains that words are garbled by for validation (read as, written in).
TRIALS = (("cp1252", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("cp1252", "cp850"), ("latin-1", "mac_roman"))


def margin_errors(model: Model, words: list[str]) -> tuple[np.ndarray, int]:
    """Errors of each margin on words unharmed and garbled on purpose, and the number of trials."""
    gains, spoilt = [], []
    for word in words:
        if not _looks_clean(word):
            continue
        bad = _garble(word, *TRIALS[crc32(word.encode("utf-8", "replace")) % len(TRIALS)])
        for form, harmed in ((word, False), (bad, True)):
            if form is not None and (form != word or not harmed):
                gains.append(model.best(form)[1])
                spoilt.append(harmed)
    gains, spoilt = np.array(gains), np.array(spoilt, bool)
    return np.array([int(((gains > margin) != spoilt).sum()) for margin in MARGINS]), len(gains)


def choose_margin(errors: np.ndarray, trials: int) -> float:
    """The greatest margin of hardly more errors than the best has."""
    good = [m for m, e in zip(MARGINS, errors, strict=True) if e <= errors.min() + trials // 1000]
    return good[-1]


def _model(counts: dict[str, np.ndarray]) -> Model:
    arrays = {kind: n.astype(np.float32) for kind, n in counts.items()}
    noise = NOISE_COUNT + NOISE_SHARE * float(arrays["single"].sum())
    for kind in ("tri", "pair"):
        arrays[kind] = np.maximum(arrays[kind] - noise, 0)
    return Model(**arrays)


def fit(texts: DataFrame, text_col: str = "text", held_out: int = HELD_OUT) -> Model:
    """The model of all clean texts; only tables of fixed size and the margins' errors reach the driver.

    One record of ``held_out`` is left out of the counts at first; the margin with the fewest
    errors on its words is taken, and its counts are added then.
    """
    held = F.pmod(F.xxhash64("text"), F.lit(held_out)) == 0
    source = texts.select(F.col(text_col).alias("text")).where(F.length("text") > 0).withColumn("held", held)
    rows = source.mapInPandas(_count, "held boolean, kind string, bucket long, n long").groupBy("held", "kind", "bucket").agg(F.sum("n").alias("n"))
    counts = rows.toPandas()
    parts = []
    for own in (False, True):
        part = {}
        for kind, size in SIZES.items():
            found = counts[(counts["kind"] == kind) & (counts["held"] == own)]
            part[kind] = np.zeros(size, np.int64)
            part[kind][found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        parts.append(part)
    model = _model({kind: parts[0][kind] + parts[1][kind] for kind in SIZES})
    tested = texts.sparkSession.sparkContext.broadcast(_model(parts[0]))

    def validate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        errors, trials = np.zeros(len(MARGINS), np.int64), 0
        for pdf in batches:
            more, n = margin_errors(tested.value, pdf["word"].to_list())
            errors, trials = errors + more, trials + n
        yield pd.DataFrame({"margin": range(len(MARGINS)), "errors": errors, "trials": trials})

    words = (
        source.where("held").select(F.explode(F.split("text", "[ \\t\\r\\n]+")).alias("word"))
        .where(F.col("word").rlike("[^\\x00-\\x7f]") & (F.length("word") > 3) & (F.length("word") < 40))
        .distinct()
    )
    found = spread(words).mapInPandas(validate, "margin int, errors long, trials long").groupBy("margin").agg(F.sum("errors"), F.sum("trials")).orderBy("margin").collect()
    if found and found[0][2]:
        model.margin = choose_margin(np.array([r[1] for r in found]), found[0][2])
    return model


def restore_rows(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """``(row_id, restored)`` of every row with a garbled or lost character, each distinct row once.

    Nulls, empty and pure ASCII texts are no cases; a lost character (U+FFFD) is a case and
    stays as it is; texts are read whole; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            keys, out = [], []
            for key, text in zip(pdf["row_id"], pdf["text"], strict=True):
                fixed, case = restore_text(model, text)
                if case:
                    keys.append(key)
                    out.append(fixed)
            if keys:
                yield pd.DataFrame({"row_id": keys, "restored": out})

    source = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(model.pattern()))
    return source.mapInPandas(run, f"row_id {id_type}, restored string").distinct()
