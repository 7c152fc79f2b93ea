r"""Personal information in free text: found with its exact source characters, or replaced by typed placeholders.

Method: offset-preserving deobfuscation. Two transducers write a normalised text and remember, for each character, the span
of source it came from: the first folds look-alikes, full-width forms and invisible characters, the second
turns spelled digits and disguised ``@`` and ``.`` into themselves. Detectors run over the normalised text;
their spans are mapped back to the source.

Kinds: email, phone, id_number, address, name. Numbers of identity are checked for a birth date; of overlapping finds the
earlier kind in ``KINDS`` wins. Names of people have no form of their own, so their words are learned from the corpus: words in
the places where names stand (after forms of address, "nama saya", "penerima", ... and whole display names) are
counted over all rows, and so are all occurrences of these words in any case; one that stands there in a fair share of them becomes a
given or a family name, however large the corpus is, and one that does not is a common word. Full names after a form of address or
an announcer are found where they stand, without the lexicon, unless one of their words is common. Where all words of a text are
capitalised, capitals tell no name: such texts teach nothing, and their names are found through the lexicon alone.

A lexicon of at most ``MOST_WORDS`` words is broadcast. A larger one stays a table: the words of each text are joined with it, and each
text is searched with its own part of the lexicon, which gives the same items.

Null and empty texts have no items; texts of any length are read whole; repeated items of a field are given once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemaruang.llm.canonical import CANDIDATE, fold_char, fold_segment
from gemaruang.session import cut, spread

KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Any capital or small letter, whatever its alphabet, as parts of a character class.
_UPPER = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Lu", "Lt"))
_LOWER = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Ll", "Lo", "Lm"))

#: Spelled digits, forms of address, words that announce a name, roles that follow a form of address (fixed values).
DIGITS = {
    "nol": "0", "kosong": "0", "satu": "1", "dua": "2", "tiga": "3", "empat": "4", "lima": "5", "enam": "6", "tujuh": "7", "delapan": "8", "sembilan": "9",
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "siji": "1", "loro": "2", "telu": "3", "papat": "4", "enem": "6", "pitu": "7", "wolu": "8", "sanga": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "nul": "0", "een": "1", "twee": "2", "drie": "3", "vier": "4", "vijf": "5", "zes": "6", "zeven": "7", "acht": "8", "negen": "9",
}
ADDRESS_FORMS = (
    "pak", "bapak", "bu", "ibu", "mbak", "mas", "kak", "kang", "bang", "sdr", "sdri", "saudara", "saudari", "tuan", "nyonya", "haji", "hajah", "ustadz", "dr", "drs", "ir", "prof",
    "mr", "mrs", "ms", "miss", "sr", "sra", "señor", "señora", "don", "doña", "meneer", "mevrouw", "dhr", "mevr",
)
ANNOUNCERS = (
    "nama saya", "nama", "a.n.", "atas nama", "penerima", "saksinya", "hubungi", "lapor ke", "cp:", "my name is", "signed by", "please call", "attention", "contact",
    "me llamo", "mi nombre es", "mijn naam is", "jenengku",
)
ROLES = frozenset(
    "guru rt rw lurah camat kades ketua bupati walikota gubernur presiden menteri kepala dosen dokter sekretaris bendahara panitia camat hakim polisi satpam chairman chair mayor minister president teacher doctor director officer secretary".split()
)

_AT = re.compile(
    r"(?<=[a-z0-9])(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s+@\s+|\s*@\s+|\s+@(?=[a-z0-9-]+(?:\.|\s*[\[({<]?\s*dot\b)))(?=[a-z0-9-]+(?:\.[a-z]|\s*[\[({<]\s*(?:dot|titik|\.)\s*[\])}>]|\s+(?:dot|titik)\s+[a-z]))", re.I
)
_DOT = re.compile(r"(?<=[a-z0-9])(?:\s*[\[({<]\s*(?:dot|titik|\.)\s*[\])}>]\s*|\s+(?:dot|titik)\s+)(?=[a-z0-9])", re.I)
_DIGIT_WORD = r"(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")"
#: Spelled digits among figures: six or more digits of which at least LEAST_SPELLED are spelled.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_DIGIT_WORD}(?![^\W\d_])|[0-9]+(?![^\W_]))[ \-.,]{{0,2}}){{2,}}", re.I)
_SPELLED_ONE = re.compile(_DIGIT_WORD, re.I)
LEAST_SPELLED = 3

_EMAIL = re.compile(r"(?<![\w.+%@-])[a-z0-9][a-z0-9._+%-]*@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,24}(?![\w@])", re.I)
_NIK = re.compile(r"(?<![0-9A-Za-z])(?<![0-9][.\- ])(?:[0-9]{16}|[0-9]{6}([ .\-])[0-9]{6}\1[0-9]{4}|[0-9]{4}([ .\-])[0-9]{4}\2[0-9]{4}\2[0-9]{4})(?![0-9A-Za-z])(?![.\-][0-9])")
_NPWP = re.compile(r"(?<![0-9A-Za-z.\-])[0-9]{2}\.[0-9]{3}\.[0-9]{3}\.[0-9]-[0-9]{3}\.[0-9]{3}(?![0-9A-Za-z])(?![.\-][0-9])")
_PHONE = re.compile(r"(?<![0-9A-Za-z+_@])(?<![0-9][.\-/,])(?:\(\+[0-9]{1,3}\)|\(0[0-9]{1,3}\)|\+[0-9]|62(?=[ .\-]?8)|0)(?:[ .\-]?[0-9]){6,13}(?![0-9A-Za-z_])(?![.\-/,][0-9])")
_STREET = r"(?:jalan|jln|jl|gang|gg|perumahan|perum|kompleks|komplek|kompl|lorong|dusun|kampung|kp|calle|avenida)\b\.?"
_RTRW = r"(?:,?\s*RT[\s.]*[0-9]{1,3}\s*[/,]?\s*RW[\s.]*[0-9]{1,3})?"
_BLOCK = r"(?:\s+blok\s+[A-Z]{0,2}[\s\-]?[0-9]{0,3}[A-Z]?)?"
_HOUSE_NO = re.compile(rf"(?<![\w@#]){_STREET}(?:\s+[^\W\d_]+){{1,5}}?{_BLOCK},?\s+(?:no\.?|nomor)\s*[0-9]{{1,4}}[A-Z]?(?![\w]){_RTRW}", re.I)
_HOUSE = re.compile(rf"(?<![\w@#])(?i:{_STREET})(?:\s+[A-Z][^\W\d_]*){{1,5}}?(?i:{_BLOCK})\s+[0-9]{{1,4}}[A-Za-z]?(?![\w.,@-]*[0-9@])(?![\w]){_RTRW}")
_ENGLISH = re.compile(r"(?<![\w@#.,-])[0-9]{1,4}[A-Z]?(?:\s+[^\W\d_]+){1,4}?\s+(?:street|st\.|road|rd\.|lane|ln\.|avenue|ave\.|drive|boulevard)(?!\w)", re.I)
_DUTCH = re.compile(r"(?<![\w@#])(?:[A-Z][^\W\d_]+\s+){0,2}?[A-Z][^\W\d_]*(?:straat|laan|weg|plein|gracht|kade|steeg|singel|dijk)\s+(?:nr\.?\s*)?[0-9]{1,4}[A-Za-z]?(?![\w])")
_PLAIN_WORDS = frozenset("the a an of on in at to near our my your people from and is was for by with this that behind down across each every other next same side more than new old".split())
_WORD = re.compile(r"(?<![\w@#.+-])[^\W\d_]{2,}(?:-[^\W\d_]{2,})?(?![\w@])")
_LOCAL = re.compile(r"https?://\S+|(?<!\w)[@#]\w[\w.]*")

_CAPITAL = rf"[{_UPPER}][{_LOWER}]+"
_FORM = r"(?:" + "|".join(sorted(map(re.escape, ADDRESS_FORMS), key=len, reverse=True)) + r")"
_NAMED = re.compile(
    r"(?<!\w)(?:(?i:" + "|".join(sorted(map(re.escape, ANNOUNCERS), key=len, reverse=True)) + r")\s+(?:(?i:" + _FORM + r")\b\.?\s+)?|(?i:" + _FORM + r")\b\.?\s+)"
    rf"({_CAPITAL})(?:\s+[{_UPPER}]\.)?\s+({_CAPITAL})(?:-({_CAPITAL}))?(?!\w)"
)
_DISPLAY = re.compile(r"^\W*(?:(?i:" + _FORM + rf")\b\.?\s+)?({_CAPITAL})(?:\s+[{_UPPER}]\.)?\s+({_CAPITAL})(?:-({_CAPITAL}))?(?:\s*\([^)]*\))?\W*$")
_BEFORE_FORM = re.compile(r"(?:^|[^\w])" + _FORM + r"\.?\s+$", re.I)
_CLUSTER = re.compile("[^̀-ͯ]?[̀-ͯ]*", re.S)

# what must be in a text before a detector can find anything; each test lets through all that its detector needs
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT_WORDS = frozenset(DIGITS)
_DIGIT = re.compile("[0-9]")
_DIGIT_RUN = re.compile(r"[0-9][0-9 .\-()]{7,}")
_DISGUISE_WORDS = frozenset(("at", "dot", "titik"))
_DISGUISED_AT = re.compile(r"@\s|\s@|[\[({<]\s*@")
_DISGUISED_DOT = re.compile(r"[\[({<]\s*\.")
_NAMING = frozenset(ADDRESS_FORMS) | {re.match(r"[^\W\d_]+", a).group() for a in ANNOUNCERS}
_NAMING_WORDS = frozenset(ADDRESS_FORMS) | {w for a in ANNOUNCERS for w in re.findall(r"[^\W\d_]+", a)}
_STREETS = frozenset("jalan jln jl gang gg perumahan perum kompleks komplek kompl lorong dusun kampung kp calle avenida".split())
_DUTCH_ENDS = ("straat", "laan", "weg", "plein", "gracht", "kade", "steeg", "singel", "dijk")
_ROADS = frozenset("street st road rd lane ln avenue ave drive boulevard".split())


def _segment_spans(seg: str) -> list[tuple[str, int, int]]:
    """(character, from, to) of the folded segment; a base and its marks are one source span."""
    out = []
    for m in _CLUSTER.finditer(seg):
        piece = m.group()
        if piece:
            folded = piece if piece < "\x7f" else unicodedata.normalize("NFC", "".join(map(fold_char, unicodedata.normalize("NFD", piece))))
            out += [(ch, m.start(), m.end()) for ch in folded]
    return out


def fold_with_spans(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The first transducer: (folded, start, end) with the source span of each character; no spans where nothing changes.

    Only segments that fail the quick check are looked at, as in the one form of texts.
    """
    edits = []
    for m in CANDIDATE.finditer(text):
        if fold_segment(m.group()) != m.group():
            edits.append((m.start(), m.end(), [(ch, m.start() + i, m.start() + j) for ch, i, j in _segment_spans(m.group())]))
    if not edits:
        return text, None, None
    return _rewrite(text, list(range(len(text))), list(range(1, len(text) + 1)), edits)


def _rewrite(text: str, start: list[int], end: list[int], edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> tuple[str, list[int], list[int]]:
    """Replace spans of ``text`` by characters that stand for parts of them, given as (character, from, to)."""
    out, s, e, at = [], [], [], 0
    for a, b, chars in edits:
        if a < at:
            continue
        out.append(text[at:a])
        s += start[at:a]
        e += end[at:a]
        for ch, i, j in chars:
            out.append(ch)
            s.append(start[i])
            e.append(end[j - 1])
        at = b
    out.append(text[at:])
    return "".join(out), s + start[at:], e + end[at:]


def _spelled_run(text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """The digits of a run of spelled digits and figures with what they stand for; nothing where it is too short to be a number."""
    run, spelled = [], 0
    at = a
    for d in _SPELLED_ONE.finditer(text, a, b):
        run += [(text[i], i, i + 1) for i in range(at, d.start()) if text[i].isdigit()]
        run.append((DIGITS[d.group().lower()], d.start(), d.end()))
        spelled, at = spelled + 1, d.end()
    run += [(text[i], i, i + 1) for i in range(at, b) if text[i].isdigit()]
    return run if spelled >= LEAST_SPELLED and len(run) >= 6 else []


def _deobfuscated(text: str) -> tuple[str, list[int] | None, list[int] | None, set[str]]:
    """(normalised, start, end, its runs of letters in lower case)."""
    start = end = None
    if not text.isascii():
        text, start, end = fold_with_spans(text)
    letters = _LETTERS.findall(text.lower())
    words = set(letters)
    changed = False

    def apply(edits: list) -> None:
        nonlocal text, start, end, changed
        if edits:
            if start is None:
                start, end = list(range(len(text))), list(range(1, len(text) + 1))
            text, start, end = _rewrite(text, start, end, edits)
            changed = True

    if not words.isdisjoint(_DISGUISE_WORDS) or "@" in text and _DISGUISED_AT.search(text) or any(c in text for c in "[({<") and _DISGUISED_DOT.search(text):
        for pattern, sign in ((_AT, "@"), (_DOT, ".")):
            apply([(m.start(), m.end(), [(sign, m.start(), m.end())]) for m in pattern.finditer(text)])
    if not words.isdisjoint(_DIGIT_WORDS) and sum(w in DIGITS for w in letters) >= LEAST_SPELLED:
        runs = [(m.start(), m.start() + len(m.group().rstrip(" -.,"))) for m in _SPELLED.finditer(text)]
        apply([(a, b, run) for a, b in runs if (run := _spelled_run(text, a, b))])
    return text, start, end, set(_LETTERS.findall(text.lower())) if changed else words


def deobfuscate(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """(normalised, start, end); the spans are None where nothing was changed."""
    return _deobfuscated(text)[:3]


def is_identity(digits: str) -> bool:
    """16 digits of which the 7th to 12th are a birth date, 40 added to the day for women."""
    day, month = int(digits[6:8]), int(digits[8:10])
    day -= 40 if day > 40 else 0
    return 1 <= month <= 12 and 1 <= day <= (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


_INITIALS = re.compile(r"(?<![\w@#/.:])[^\W\d_]{2,}")


def _title(text: str) -> bool:
    """Whether as good as all words of a text of some length are capitalised."""
    words = _INITIALS.findall(text)
    return len(words) >= 6 and sum(w[0].islower() for w in words) <= 0.1 * len(words)


def find(text: str | None, given: frozenset[str] | set[str], family: frozenset[str] | set[str], common: frozenset[str] | set[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) in source offsets, in reading order, without overlaps."""
    if not text:
        return []
    norm, start, end, words = _deobfuscated(text)
    found: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    direct: list[tuple[int, int]] = []

    def offer(kind: str, a: int, b: int) -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            found.append((kind, a, b))

    if "@" in norm:
        for m in _EMAIL.finditer(norm):
            offer("email", m.start(), m.end())
    if _DIGIT_RUN.search(norm):
        for m in _NPWP.finditer(norm):
            offer("id_number", m.start(), m.end())
        for m in _NIK.finditer(norm):
            if is_identity(_digits(m.group())):
                offer("id_number", m.start(), m.end())
        for m in _PHONE.finditer(norm):
            n = len(_digits(m.group()))
            if 9 <= n <= (14 if m.group().startswith(("+", "(+")) else 13):
                offer("phone", m.start(), m.end())
    if _DIGIT.search(norm):
        if not words.isdisjoint(_STREETS):
            for pattern in (_HOUSE_NO, _HOUSE):
                for m in pattern.finditer(norm):
                    offer("address", m.start(), m.end())
        if any(w.endswith(_DUTCH_ENDS) for w in words):
            for m in _DUTCH.finditer(norm):
                offer("address", m.start(), m.end())
        if not words.isdisjoint(_ROADS):
            for m in _ENGLISH.finditer(norm):
                if not _PLAIN_WORDS & {w.lower() for w in m.group().split()[1:-1]}:
                    offer("address", m.start(), m.end())
    if not words.isdisjoint(_NAMING):
        for m in _NAMED.finditer(norm):
            parts = {g.lower() for g in m.groups() if g}
            if parts.isdisjoint(ROLES) and parts.isdisjoint(_NAMING_WORDS) and parts.isdisjoint(common) and not _title(norm):
                direct.append((m.start(1), m.end(3) if m.group(3) else m.end(2)))
    tokens = []
    if not words.isdisjoint(given):
        taken += [m.span() for m in _LOCAL.finditer(norm)]
        tokens = list(_WORD.finditer(norm))
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.group().lower() not in given:
            i += 1
            continue
        j, last, named = i + 1, t.end(), False
        while j < len(tokens):
            gap, word = norm[last : tokens[j].start()], tokens[j].group().lower()
            if not re.fullmatch(r"[  \t]+(?:[^\W\d_]\.[ \t]*)?", gap):
                break
            if all(p in family for p in word.split("-")):
                last, named, j = tokens[j].end(), True, j + 1
                break
            if word in given and gap.isspace() and j == i + 1:
                last, j = tokens[j].end(), j + 1
                continue
            break
        if not named:
            last = t.end()
            named = t.group().lower() not in ROLES and _BEFORE_FORM.search(norm[max(0, t.start() - 14) : t.start()]) is not None
            j = i + 1
        if named:
            direct.append((t.start(), last))
        i = j
    # the longer of two that overlap: the lexicon may know a double name, the place a family name that the lexicon does not
    for a, b in sorted(direct, key=lambda s: (s[0] - s[1], s[0])):
        offer("name", a, b)
    found.sort(key=lambda f: f[1])
    if start is not None:
        found = [(k, start[a], end[b - 1]) for k, a, b in found]
    return found


def redact(text: str | None, given: set[str], family: set[str], common: frozenset[str] | set[str] = frozenset()) -> str | None:
    """The text with each item replaced by the placeholder of its kind."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in find(text, given, family, common):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


MOST_WORDS = 1_000_000
Lexicon = tuple[frozenset[str], ...]


def name_words(df: DataFrame, text: str = "text", name: str = "name", least: int = 2, least_ratio: float = 0.1) -> DataFrame:
    """(word, given, family, common) of all words that stand where names stand, over all rows.

    A given or family name needs ``least`` such places and ``least_ratio`` of all its occurrences, whatever their case; a word with more
    than ``least`` other occurrences for each ``least_ratio`` of a place is common.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        places: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def hit(groups: tuple[str | None, ...]) -> None:
            places[0][groups[0].lower()] += 1
            places[1].update(g.lower() for g in groups[1:] if g)

        def frame() -> pd.DataFrame:
            words = list(seen.keys() | places[0].keys() | places[1].keys())
            return pd.DataFrame({"word": pd.Series(words, dtype=object), "given": pd.Series([places[0][w] for w in words], dtype="int64"), "family": pd.Series([places[1][w] for w in words], dtype="int64"), "seen": pd.Series([seen[w] for w in words], dtype="int64")})

        for b in batches:
            for t in b["t"]:
                if t:
                    words = _LETTERS.findall(t.lower())
                    seen.update(words)
                    if not _NAMING.isdisjoint(words) and not _title(t):
                        for m in _NAMED.finditer(t):
                            if m.group(1).lower() not in ROLES:
                                hit(m.groups())
            for t in b["n"]:
                if t and (m := _DISPLAY.match(t)) and not any(map(str.isdigit, t)):
                    seen.update(g.lower() for g in m.groups() if g)
                    hit(m.groups())
            if len(seen) > 200_000:
                yield frame()
                seen.clear()
                places[0].clear()
                places[1].clear()
        yield frame()

    rows = df.select(F.col(text).alias("t"), (F.col(name) if name in df.columns else F.lit(None)).cast("string").alias("n"))
    counted = spread(rows).mapInPandas(run, "word string, given long, family long, seen long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("given", "family", "seen")])
    own, total = F.greatest("given", "family"), F.greatest(F.lit(1), F.col("seen"))
    enough = [(F.col(k) >= least) & (F.col(k) >= least_ratio * total) for k in ("given", "family")]
    marked = counted.filter(own > 0).select("word", enough[0].alias("given"), enough[1].alias("family"), ((own < least_ratio * total) & (total - own >= least / least_ratio)).alias("common"))
    return marked.filter("given or family or common")


def _sets(rows: Iterable) -> Lexicon:
    rows = list(rows)
    return tuple(frozenset(r["word"] for r in rows if r[k]) for k in ("given", "family", "common"))


def learn_names(df: DataFrame, text: str = "text", name: str = "name", least: int = 2, least_ratio: float = 0.1, most_words: int = MOST_WORDS) -> Lexicon | None:
    """(given, family, common) as sets; None where they are more than ``most_words``, so that they stay a table."""
    rows = name_words(df, text, name, least, least_ratio).limit(most_words + 1).collect()
    return _sets(rows) if len(rows) <= most_words else None


def _search(df: DataFrame, key: str, fields: tuple[str, ...], lexicon: Lexicon | None, most_words: int, give: Callable[[pd.DataFrame, list[Lexicon]], pd.DataFrame], schema: str) -> DataFrame:
    """``give`` over batches of (__k, fields) with the lexicon of each row: the broadcast one, or the row's own part of the table."""
    rows = df.select(F.col(key).cast("long").alias("__k"), *fields)
    lexicon = lexicon or learn_names(df, most_words=most_words)
    if lexicon is not None:
        shared = df.sparkSession.sparkContext.broadcast(lexicon)

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield give(b, [shared.value] * len(b))

        return spread(rows).mapInPandas(whole, schema)

    numbered = cut(spread(rows).withColumn("__r", F.monotonically_increasing_id()))

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, *texts in zip(b["__r"], *[b[f] for f in fields]):
                # a double name is looked up by its parts and as a whole
                out += [(r, w) for w in {w for t in texts if t for n in [deobfuscate(t)[0].lower()] for w in [*_LETTERS.findall(n), *(m.group() for m in _WORD.finditer(n))]}]
            yield pd.DataFrame(out, columns=["__r", "word"]).astype({"__r": "int64"})

    # one row for each word on one side: a word that stands in many texts is split by adaptive execution
    met = numbered.mapInPandas(spelled, "__r long, word string").join(cut(name_words(df)), "word")
    own = met.groupBy("__r").agg(F.collect_list(F.struct("word", "given", "family", "common")).alias("__own"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield give(b, [_sets(o if o is not None else ()) for o in b["__own"]])

    return numbered.join(own, "__r", "left").mapInPandas(each, schema)


def personal_items(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = ("text", "name"), lexicon: Lexicon | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """(key, field, kind, value): each distinct item of each field with its exact source characters."""

    def give(b: pd.DataFrame, lexicons: list[Lexicon]) -> pd.DataFrame:
        out = []
        for field in fields:
            for k, t, own in zip(b["__k"], b[field], lexicons):
                if t:
                    out += dict.fromkeys((k, field, kind, t[x:y]) for kind, x, y in find(t, *own))
        return pd.DataFrame(out, columns=["k", "field", "kind", "value"]).astype({"k": "int64"})

    return _search(df, key, fields, lexicon, most_words, give, "k long, field string, kind string, value string").withColumnRenamed("k", key)


def redacted(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = ("text", "name"), lexicon: Lexicon | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """(key, fields): every row with its items replaced by placeholders; null stays null."""

    def give(b: pd.DataFrame, lexicons: list[Lexicon]) -> pd.DataFrame:
        return pd.DataFrame({"__k": b["__k"], **{field: [redact(t, *own) for t, own in zip(b[field], lexicons)] for field in fields}})

    return _search(df, key, fields, lexicon, most_words, give, "__k long, " + ", ".join(f"`{f}` string" for f in fields)).withColumnRenamed("__k", key)
