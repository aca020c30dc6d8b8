"""Personal information inside free text (problem 10)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")

# Letters of other scripts that look like a Latin one, and signs with an ASCII meaning.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".",
}
# Digits as words, in the languages of the collection.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
# Titles, and words that make a capitalised name one of a firm or a street.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Sr|Sra|Srta|Don|Doña|M"
FIRM = (
    "Ltd|Limited|plc|Inc|Co|Corp|Corporation|Company|AG|SA|GmbH|SE|NV|Lines|Mills|Bank|Holdings|Industries|Partners|Brothers|Bros|"
    "Sons|Group|Partnership|Associates|Works|Trust|Fund|Shipping|Line|Motors|Steel|Foundry|Exchange"
)
STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Way|Court|Ct|Square|Sq|Place|Terrace|Crescent|Close|Parkway|Pkwy|Highway|Hwy"
# Capitalised words that begin sentences and are no family names.
SENTENCE = (
    "The|A|An|In|It|If|However|There|No|On|At|As|By|Of|For|From|To|And|But|Analysts|Traders|Dealers|Officials|Buyers|Brokers|Economists|"
    "Executives|Producers|Sources|Shares|Wheat|Lot|Ref|See|Write|Copies|Corrections|Contact|Callers|Samples|Applicant|Clearance|Tel|"
    "Der|Die|Das|Wegen|Amtliche|Anfragen|Proben|Im|Le|La|Les|Une|Un|Des|Selon|Écrire|À|El|Los|Las|En|Hubo|Fuentes|Escriba|Which|What|Under|"
    "January|February|March|April|May|June|July|August|September|October|November|December"
)

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_unusual = re.compile("[\u00a0\u00ad\u0370-\u03ff\u0400-\u04ff\u0500-\u052f\u2000-\u2015\u2024\u2060\u2212\ufeff\uff00-\uff5e]")
_bracketed = re.compile(r"\s*[(\[{<]\s*(at|arobase|arroba|dot|point|punkt|punto)\s*[)\]}>]\s*", re.I)
_spoken = re.compile(r"(?<=\w)\s+(at|arobase|arroba)\s+(?=[\w-]+(?:\s+(?:dot|punkt|punto)\s+[\w-]+)+)|(?<=\w)\s+(dot|punkt|punto)\s+(?=\w)", re.I)
_word_digit = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_has_bracketed = re.compile(r"[(\[{<]\s*(?:at|arobase|arroba|dot|point|punkt|punto)\s*[)\]}>]", re.I)
_has_spoken = re.compile(r"\s(?:dot|punkt|punto)\s", re.I)
_spelled = re.compile(rf"\b(?:{_word_digit}|\d)(?:[\s,-]+(?:{_word_digit}|\d)\b){{5,}}", re.I)
_has_spelled = re.compile(rf"(?:{_word_digit})[\s,-]+(?:{_word_digit})[\s,-]+(?:{_word_digit})[\s,-]")
_one_digit = re.compile(rf"\b(?:{_word_digit}|\d)\b", re.I)


class Undisguised:
    """A text without its disguises and, for every character of it, the span of the source it came from.

    Each transducer maps spans of its input to strings and composes its offsets with those before it: look-alike and
    full-width letters, invisible characters, at and dot in brackets or as words, digits as words.
    """

    def __init__(self, source: str):
        self.text, self.spans = source, None
        if _unusual.search(source):
            self._apply(_unusual, lambda m: "" if _INVISIBLE.match(m[0]) else LOOKALIKES.get(m[0]) or self._plain(m[0]), self._mixed)
        if _has_bracketed.search(self.text):
            self._apply(_bracketed, lambda m: "@" if m[1].lower() in ("at", "arobase", "arroba") else ".")
        if _has_spoken.search(self.text):
            self._apply(_spoken, lambda m: "@" if m[1] else ".")
        if _has_spelled.search(self.text.lower()):
            self._apply(_spelled, lambda m: "".join(DIGIT_WORDS.get(d.lower(), d) for d in _one_digit.findall(m[0])))

    @staticmethod
    def _plain(char: str) -> str:
        plain = unicodedata.normalize("NFKC", char)
        return plain if len(plain) == 1 else char

    @staticmethod
    def _mixed(text: str, m: re.Match) -> bool:
        """A foreign letter is a disguise only next to a Latin one; words of other scripts stay."""
        if not m[0].isalpha():
            return True
        return any(c.isascii() and c.isalnum() for c in text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1])

    def _apply(self, pattern: re.Pattern, replace, wanted=None) -> None:
        parts, spans, at = [], [], 0
        for m in pattern.finditer(self.text):
            new = replace(m) if wanted is None or wanted(self.text, m) else m[0]
            if new == m[0]:
                continue
            source = self.spans or range(0)
            parts += [self.text[at : m.start()], new]
            spans += [source[k] if self.spans else (k, k + 1) for k in range(at, m.start())]
            whole = (self.span(m.start(), m.end())) if m.end() > m.start() else (m.start(), m.start())
            spans += [whole] * len(new)
            at = m.end()
        if parts:
            spans += [self.spans[k] if self.spans else (k, k + 1) for k in range(at, len(self.text))]
            self.text, self.spans = "".join(parts) + self.text[at:], spans

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source's span for a span of the text."""
        return (start, end) if self.spans is None else (self.spans[start][0], self.spans[end - 1][1])


_cap = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}[ \t]?\n?@\s?(?=[A-Za-z])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b")
ID_NUMBER = re.compile(
    r"\b(?:SSN|social security(?: number| no\.?)?)[\s:#]*\d{3}[- ]?\d{2}[- ]?\d{4}\b"
    r"|(?<![\w./-])\d{3}([- \n])\d{2}\1\d{4}(?![\w/-]|[.,]\d)|(?<![\w./-])\d{3}[-\s]\d{2}[-\s]\d{4}(?![\w/-]|[.,]\d)"
    r"|\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b"
    r"|(?i:\b(?:passport|passeport|reisepass|pasaporte)(?:[\s-]*(?:no|nr|number|n°|nº)\b)?)[.:\s-]*[A-Z]{1,2}\s?\d{6,9}\b|\b[A-Z]{2}\s?\d{7}\b"
    r"|(?i:\b(?:personal)?ausweis(?:[\s-]*(?:nr|nummer))?)[.:\s-]*[A-Z0-9]{8,10}\b"
    r"|\b(?:DNI|NIE|NIF)[\s:.-]*[XYZ]?\d{7,8}\s?-?\s?[A-Z]\b|\b\d{8}-[A-Z]\b"
    r"|(?:\bINSEE[\s:]*)?(?<![\w.,/-])[1-4]\s?\d{2}\s?\d{2}\s?\d[\dAB]\s?\d{3}\s?\d{3}(?:\s?\d{2})?(?![\w/-]|[.,]\d)"
    r"|\b(?i:identity card|id card|carte d'identité)(?:\s(?:no\.?|number|n°))?[:\s]*[A-Z0-9]{6,12}\b"
)
PHONE = re.compile(
    r"(?<![\w.,/@+-])(?:"
    r"\+\d{1,4}(?:[ \n.-]?\(?\d{1,5}\)?){2,6}"
    r"|(?:1[-. ])?\(\d{3}\)\s?\d{3}[-. ]\d{4}|(?:1[-. \n])?\d{3}([-.])\d{3}\1\d{4}|\d{3}\s\d{3}\s\d{4}|[2-9]\d{2}[2-9]\d{6}"
    r"|0\d(?:([ \n.-])\d{2}\2?){3}[ \n.-]\d{2}|0\d(?:[ \n.-]\d{2}){4}|0\d{2,4}[ \n]\d{3,4}[ \n]\d{4}|0\d{2,4}/\d{4,8}(?:-\d{1,4})?|0\d{9,10}|[6-9]\d{2}(?:\s\d{2}){3}|[6-9]\d{2}\s\d{3}\s\d{3}"
    r")(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![\w/@-]|[.,:]\d)"
)
ADDRESS = re.compile(
    rf"(?<![\w.,/])(?:(?:Flat|Apt|Unit|Suite)\.?\s\w+,\s+)?\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}})?,?\s+(?:[NSEW]\.?\s+)?(?:(?:[A-ZÀ-Þ][\w'-]+)\s+){{1,3}}(?i:{STREET})\b"
    r"|(?<![\w.,/])\d{1,5}\s*(?:bis|ter|quater)?,?\s+(?i:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route)\s+(?:(?:de|du|des|la|le|les)\s+|d'|l'|de\s+l')*[A-ZÀ-Þ]\w+"
    r"|\b[A-ZÄÖÜ]\w+(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer)\s+\d{1,5}\s?[a-z]?\b|\b[A-ZÄÖÜ]\w+er\s+(?:Straße|Str\.|Weg|Platz|Allee)\s+\d{1,5}\b"
    r"|\b(?i:calle|c/|avda\.?|avenida|plaza|paseo|camino|ronda|carrera)\s+(?:(?:de|del|la|las|los|el)\s+)*[A-ZÀ-Þ]\w+(?:\s+[A-ZÀ-Þ]\w+)?,?\s+(?:n[.º°]*\s*)?\d{1,5}\b"
)
_no_case = re.compile(r"(?i)\b(?:lot|ref|reference|order|invoice|serial|batch|contract|item|docket|patent|licence|license)\b[\s.]*(?:(?:no|nr|n°|nº|number)\b)?[\s.:#]*$")
NAME = re.compile(
    rf"\b(?P<title>{TITLES})\.?\s+(?=[A-ZÀ-Þ])(?:(?P<tg>{_cap}(?:-{_cap})?)\s+)?(?:[A-Z]\.\s+)?(?P<tf>{_cap}(?:-{_cap})?)\b"
    rf"|(?P<caps>\b[A-ZÀ-Þ]{{3,}}(?:-[A-ZÀ-Þ]+)?),\s+(?P<cg>{_cap}(?:-{_cap})?)\b"
    rf"|\b(?P<g>{_cap}(?:-{_cap})?)\s+(?:(?P<mid>[A-Z])\.\s+)?(?P<f>{_cap}(?:-{_cap})?)\b"
    rf"|(?<![\w.])(?P<i>[A-Z])\.(?:\s?[A-Z]\.)?\s+(?P<if>{_cap}(?:-{_cap})?)\b"
)
_capital = re.compile(r"(?<![^\W_])[A-ZÀ-Þ][\w-]*")
_not_person = re.compile(rf"\s+(?:(?i:and|&|y|et|und)\s+)?(?:{FIRM}|{STREET})\b|\s*&|\s+(?i:street|road|lane|avenue|terminal)\b")
_ship = re.compile(r"(?i)(?:\bM/?V|\bSS|\bMS|\bMT|vessel|ship|tanker|ferry|tug|steamer|freighter|barge)\s+$")
_house = re.compile(r"\d\s+$")
_sentence = frozenset(SENTENCE.split("|"))
_title_words = frozenset(TITLES.split("|"))
_firm_words = frozenset((FIRM + "|" + STREET).split("|"))


class Names:
    """Given and family names, listed and learned."""

    def __init__(self, given: frozenset[str], family: frozenset[str]):
        self.given, self.family = given, family

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Only a title, a known given name, an initial or capitals before a comma can begin a person's name."""
        end = 0
        for token in _capital.finditer(text):
            start, word = token.start(), token[0]
            if start < end or not (
                word in _title_words or word[1:2] in ("", "'") or text[token.end() : token.end() + 1] == "," and word.isupper() or self._given(word)
            ):
                continue
            m = NAME.match(text, start)
            if m and self._person(text, m):
                end = m.end()
                yield m.span()

    def _given(self, word: str) -> bool:
        return word in self.given or "-" in word and any(x in self.given for x in word.split("-"))

    def _person(self, text: str, m: re.Match) -> bool:
        after, before = text[m.end() : m.end() + 24], text[max(0, m.start() - 12) : m.start()]
        if _not_person.match(after) or _ship.search(before):
            return False
        if m["title"]:
            # ``M`` without a full stop and words such as Don are titles only before a known name
            sure = text[m.end("title") : m.end("title") + 1] == "." or m["title"] in ("Herr", "Frau", "Mme", "Mlle", "Miss")
            known = m["tf"] in self.family or (m["tg"] and m["tg"].split("-")[0] in self.given)
            return (sure or bool(known)) and m["tf"] not in _sentence and m["tf"] not in _firm_words
        if m["caps"]:
            return m["cg"].split("-")[0] in self.given
        if m["g"]:
            first = m["g"].split("-")
            if m["f"] in _sentence or m["f"] in _firm_words or m["g"] in _sentence or m["g"] in _title_words:
                return False
            return any(x in self.given for x in first)
        if _house.search(before) or m["if"] in _sentence or m["if"] in _firm_words:
            return False
        return True


_digits = re.compile(r"\d[\d\s().Xx/-]{4,}\d")
_number = re.compile(r"\d+")
_street_after = re.compile(
    r"[A-Za-z]?(?:-\d+)?,?\s+(?:(?:bis|ter|quater),?\s+)?(?:[A-ZÀ-Þ]|rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route)"
)
_street_before = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "damm", "ufer", "Straße", "Str.", "Weg", "Platz", "Allee")
_street_words = tuple(
    x for w in ("Calle", "Avda", "Avenida", "Plaza", "Paseo", "Camino", "Ronda", "Carrera") for x in (w, w.lower(), w.upper())
) + ("C/", "c/")


def _street_places(text: str) -> Iterator[tuple[int, int]]:
    """Places around which an address may stand: a number with a street's name after or before it."""
    for m in _number.finditer(text):
        start, end = m.span()
        if end - start <= 5 and (_street_after.match(text, end) or text[max(0, start - 10) : start].rstrip().endswith(_street_before)):
            yield start, end
    for word in _street_words:
        at = text.find(word)
        while at >= 0:
            yield at, at + len(word)
            at = text.find(word, at + 1)


#: Words before and after digits or a street's name that a number or address can take up.
NEAR = 8
_quantity = re.compile(r"(?i)\b(?:about|around|some|nearly|almost|over|roughly|than|environ|etwa|unos)\s+$")


_token = re.compile(r"\S+")


def _near(text: str, places: Iterable[tuple[int, int]], words: int) -> Iterator[tuple[int, int]]:
    """Stretches of so many words around the places, those that touch joined, so that a dear pattern sees little of the text.
    Words and what stands between them may have any length: no match of so many words is cut off."""
    places = sorted(places)
    if not places:
        return
    tokens = [m.span() for m in _token.finditer(text)]
    starts = [a for a, _ in tokens]
    first = last = -1
    for a, b in places:
        k, j = max(bisect_right(starts, a) - 1, 0), max(bisect_right(starts, b - 1) - 1, 0)
        if first >= 0 and k - words <= last:
            last = max(last, j + words)
            continue
        if first >= 0:
            yield starts[first], tokens[min(last, len(tokens) - 1)][1]
        first, last = max(k - words, 0), j + words
    yield starts[first], tokens[min(last, len(tokens) - 1)][1]


def find(text: str, names: Names) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the personal information in a text, without overlaps, by place. Where two kinds claim
    the same characters the earlier of ``KINDS`` holds, identity numbers before phones."""
    plain = Undisguised(text)
    t = plain.text
    found: list[tuple[int, int, str]] = []

    def claim(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b, _ in found):
            found.append((start, end, kind))

    if "@" in t:
        for m in EMAIL.finditer(t):
            claim(*m.span(), "email")
    windows = list(_near(t, (m.span() for m in _digits.finditer(t)), NEAR))
    for pattern, kind in ((ID_NUMBER, "id_number"), (PHONE, "phone")):
        for start, end in windows:
            for m in pattern.finditer(t, start, end):
                if not _no_case.search(t, max(0, m.start() - 24), m.start()):
                    claim(*m.span(), kind)
    for start, end in _near(t, _street_places(t), NEAR):
        for m in ADDRESS.finditer(t, start, end):
            if not _quantity.search(t, max(0, m.start() - 12), m.start()):
                claim(*m.span(), "address")
    for span in names.spans(t):
        claim(*span, "name")
    return sorted((*plain.span(a, b), kind) for a, b, kind in found)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in found:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


# Signs of a given name besides the list: after a title, before a middle initial, after a family name in capitals,
# in a hyphenated pair.
_java_cap = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_signs = (
    rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\s+({_java_cap})(?:-{_java_cap})?\s+(?:[A-Z]\.\s+)?{_java_cap}",
    rf"\b({_java_cap})(?:-{_java_cap})?\s+[A-Z]\.\s+{_java_cap}",
    rf"\b[A-ZÀ-Þ]{{3,}},\s+({_java_cap})\b",
    rf"\b({_java_cap})-{_java_cap}\s+(?:[A-Z]\.\s+)?{_java_cap}",
    rf"\b{_java_cap}-({_java_cap})\s+(?:[A-Z]\.\s+)?{_java_cap}",
)
#: Names up to which they are sent to the executors (some 30 MB); more are joined with the texts' words.
MOST_NAMES = 500_000


def learned_given(documents: DataFrame, least_signs: int = 2, least_documents: int = 2) -> DataFrame:
    """``(name_text)``: words that stand where given names do, by so many kinds of signs, in so many documents of the
    whole collection."""
    rows = documents.select("doc_id", "text").where("text is not null")
    signs = F.array(*(F.struct(F.lit(k).alias("sign"), F.regexp_extract_all("text", F.lit(p), 1).alias("words")) for k, p in enumerate(_signs)))
    seen = rows.select("doc_id", F.explode(F.filter(signs, lambda x: F.size(x["words"]) > 0)).alias("s")).select(
        "doc_id", "s.sign", F.explode("s.words").alias("name_text")
    )
    per_document = seen.groupBy("name_text", "doc_id").agg(F.collect_set("sign").alias("signs"))
    return (
        per_document.groupBy("name_text")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("signs")))).alias("n"), F.count("*").alias("documents"))
        .where((F.col("n") >= least_signs) & (F.col("documents") >= least_documents) & ~F.col("name_text").isin(*_sentence, *_firm_words))
        .select("name_text")
    )


def personal_information(documents: DataFrame, name_list: DataFrame, learn: bool = True) -> DataFrame:
    """``(doc_id, kinds, text)`` of each document that holds personal information: its kinds and its text with typed
    placeholders such as ``[EMAIL]`` in their place; the rest is unchanged, character for character.

    Each text is undisguised by transducers that keep offsets, identifiers are detected in what they give, and the
    spans are mapped back. Null texts and null ids give nothing, a repeated row repeated results, an empty list of
    names and empty tables work; other columns are ignored. The list of names is incomplete, so given names are also learned from
    their place in the whole collection (``learn``). Up to ``MOST_NAMES`` they are broadcast and the detection does not
    shuffle; more are joined with the words of the texts.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    listed = name_list.select("name_text", "kind").where("name_text is not null and kind in ('given', 'family')").distinct()
    given = listed.where("kind = 'given'").select("name_text")
    if learn:
        given = given.unionByName(learned_given(documents))
    names = given.distinct().withColumn("kind", F.lit("given")).unionByName(listed.where("kind = 'family'"))
    few = names.limit(MOST_NAMES + 1).collect()
    if len(few) > MOST_NAMES:  # each text brings those of its own words that are names
        rows = _with_names(rows, names)
        few = []
    else:
        rows = rows.withColumns({kind: F.lit(None).cast("array<string>") for kind in ("given", "family")})
    sent = spark.sparkContext.broadcast(tuple(frozenset(r.name_text for r in few if r.kind == kind) for kind in ("given", "family")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = Names(*sent.value)
        for batch in batches:
            keys, kinds, texts = [], [], []
            for key, value, *own in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                text = value.as_py()
                found = find(text, everywhere if own[0] is None and own[1] is None else Names(*(frozenset(x or ()) for x in own)))
                if found:
                    keys.append(key)
                    kinds.append(sorted({k for *_, k in found}))
                    texts.append(redact(text, found))
            arrays = [pa.array(keys, pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "kinds", "text"])

    return rows.select("doc_id", "text", "given", "family").mapInArrow(run, "doc_id long, kinds array<string>, text string")


def _with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with the names among the capitalised words, and their hyphenated parts, of each text without disguises."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {x for w in _capital.findall(Undisguised(text).text) for x in (w, *w.split("-"))}
                keys += [key] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["doc_id", "name_text"])

    met = rows.mapInArrow(words, "doc_id long, name_text string").distinct().join(names, "name_text")
    per_text = met.groupBy("doc_id").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("name_text"))).alias(k) for k in ("given", "family")))
    none = F.array().cast("array<string>")
    return rows.join(per_text, "doc_id", "left").select("doc_id", "text", F.coalesce("given", none).alias("given"), F.coalesce("family", none).alias("family"))
