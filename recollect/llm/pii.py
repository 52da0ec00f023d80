"""Personal information in free text: detection and keyed, format-preserving surrogates.

Detection runs in Arrow batches. One pass of a keyword automaton over a text decides which of the exact patterns have
to run on it, so that most texts cost one pass. Names need no list of the corpus' names: they are found by where they stand and how they
look, and what is found so is counted over the whole corpus, which gives a lexicon of its given names and surnames (``learn``); with
it a second pass finds the names that stand nowhere special. Surrogates are bijections under a key: two different values of the same
format never share a surrogate (the collision check is part of the permutation), the same value always gets the same one.
"""

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import shared_checkpoint

# Common given names by gender and common surnames of several languages; they are known before anything is learned and
# replace each other.
FEMALE = """Alice Amina Ana Angela Anna Barbara Beatriz Birgit Carla Carmen Catherine Charlotte Claire Claudia Cristina Diana Elena Elisabeth Elizabeth
Emily Emma Eva Fatima Gabriela Giulia Hannah Helen Helga Ingrid Irene Isabel Jana Jane Jennifer Jessica Johanna Julia Karen Katharina Laura Linda
Lucia Maria Marie Marta Mary Mei Monika Natalia Nicole Olga Patricia Paula Priya Sabine Sandra Sara Sarah Silvia Sofia Susan Susanne Teresa Ursula
Yuki""".split()
MALE = """Adam Ahmed Alberto Alexander Andreas Andrew Antonio Arjun Bernd Carlos Charles Christian Daniel David Diego Dieter Edward Fernando Francisco
Friedrich George Giovanni Hans Henry Hiroshi Hugo Ivan Jack James Jan Javier Joachim Johannes John Jorge José Joseph Juan Jürgen Karl Kevin Klaus
Lars Luis Luke Manuel Marco Mario Markus Martin Matthew Michael Miguel Mohammed Omar Pablo Paul Pedro Peter Philip Rafael Richard Robert Stefan Thomas
Tom Wei William Wolfgang""".split()
SURNAMES = """Ali Allen Andersson Becker Brown Chen Costa Davis Evans Fernández Fischer García González Hoffmann Ivanov Jensen Johnson Jones Kim Kumar
Lee López Martínez Meyer Miller Müller Nguyen Novak Petrov Rossi Sánchez Schmidt Schneider Schulz Silva Singh Smith Taylor Wagner Wang Weber Wilson
Wright Yamamoto Zhang""".split()
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
TLDS = "com org net edu gov info io co example test invalid de es at ch fr uk us eu".split()
#: Words in capitals of which no name consists: of organisations, places, dates, and those that begin a sentence.
NOT_NAMES = set("""
works group press institute council collective archive foundry ledger yard line trust harbour bank university college school museum hotel
inc ltd llc gmbh ag corp corporation company limited association society club team department office ministry hospital church airport station
street st road rd avenue ave lane ln court ct crescent boulevard blvd drive terrace square close park bridge river lake bay island mountain valley north
south east west new united city town county state kingdom straße strasse platz weg gasse allee calle plaza avenida
january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday
januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
the a an and or but if when while between after before on in at to of for from with by without about over under as since until then there here this that these
those i you he she it we they my your his her its our their me him us them who what which where why how all any each every no not yes so is are was
were be been do does did has have had can could will would shall should may might must let please thanks thank hello hi dear regards someone nobody everyone
der die das den dem des ein eine einen einem einer und oder aber wenn als zwischen nach vor in im am an auf zu zur zum von mit ohne bei aus über unter
ich du er sie es wir ihr mein meine dein unser ist sind war nicht kein keine laut gestern heute morgen
el la los las un una unos unas y o pero si cuando entre en de del con sin por para según sobre yo tú él ella nosotros mi tu su es son era no ayer hoy
yesterday today tomorrow invoice order ticket user assistant customer note subject re passport
""".split())
ORG_WORDS = "Works Group Press Institute Council Collective Archive Foundry Ledger Yard Line Trust Harbour".split()

_B, _E = r"(?<![^\W_])", r"(?![^\W_])"


def _class(wanted) -> str:
    """A character class of the characters of the basic plane that satisfy a condition."""
    runs: list[list[int]] = []
    for c in range(0x10000):
        if wanted(chr(c)):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "]"


#: Capital letters, and letters of scripts without case, of which names consist as well.
_UP = _class(str.isupper)
_UNCASED = _class(lambda c: unicodedata.category(c) == "Lo")
_I = r"[^\W\d_]\."
_W = r"[^\W\d_][\w'’\-]*"
_CAP = rf"(?-i:{_UP}[\w'’]+(?:-[\w'’]+)*)"

TITLED = re.compile(
    rf"{_B}(?:my name is|mein name ist|me llamo|mrs?\.|ms\.|miss|dr\.|prof\.|herr|frau|señora?)[ \t ]+"
    rf"((?:{_CAP}|{_UNCASED}+|(?-i:{_UP}\.))(?:[ \t\u00a0]+(?:{_CAP}|{_UNCASED}+|(?-i:{_UP}\.))){{0,2}})",
    re.I,
)
# Other names have the shape of one and stand where a person does.
_TOKEN = rf"(?:{_CAP}|(?-i:{_UP}\.))"
_PARTICLES = "van von de der den del della di da dos du la le ter bin al".split()
_LAST = rf"(?:(?:{'|'.join(_PARTICLES)})[ \t \-]){{0,2}}{_CAP}"
_SHAPE = rf"(?:{_LAST},[ \t ]{_CAP}(?:[ \t ]{_TOKEN})?{_E}|{_TOKEN}(?:[ \t ]{_TOKEN}){{0,2}}[ \t ]{_LAST}{_E})"
_KIN = (
    "sister|brother|mother|father|mum|mom|dad|son|daughter|wife|husband|partner|aunt|uncle|cousin|friend|colleague|boss|manager|landlord|landlady|neighbou?r|"
    "tenant|customer|client|patient|employee|teacher|doctor|nurse|plumber|lawyer|schwester|bruder|kundin|kunde|nachbarin|nachbar|vermieterin|vermieter|"
    "hermana|hermano|cliente|vecin[oa]|casero"
)
INTRODUCED = re.compile(
    rf"{_B}(?:(?:name|from|to|cc|by|contact|author|sender|recipient|attendee|signed|nombre|von|an|de|para|{_KIN})[ ]?[:=][ \t]*"
    r"|(?:regards|wishes|sincerely|cheers|yours|yours truly|grüße|grüßen|gruß|saludos|atentamente)[,.]?\s+"
    rf"|(?:{_KIN}),?[ ]|(?:ask(?:ed)? for|emergency contact|contact|met|told|reach|named|dear|hi|hello|hallo|hola|querid[oa]|liebe[rs]?|geht an|signed by)[ ]"
    r"|(?:booking|reservation|parcel|package|letter|message|invoice|appointment) for[ ]"
    r"|(?:lunch|dinner|coffee|breakfast|spoke|talked|speak|talk|meeting|met|chatted)(?: up)? (?:with|to)[ ])"
    rf"({_SHAPE})",
    re.I,
)
DESCRIBED = re.compile(
    rf"{_B}({_SHAPE})(?=,? (?:lives|lived|texted|phoned|emailed|was born|born|married|told|replied|is (?:my|our)|wohnt|vive)\b|, (?:our|my|his|her|their|aged|unsere?|meine?|mi|nuestr[oa]) "
    rf"| ?[<(](?:[\w.+\-]+[@＠]|\+?\d))",
    re.I,
)
INITIALS = re.compile(rf"{_B}(?:{_CAP}(?: {_UP}\.){{1,2}}|{_UP}\.(?: ?{_UP}\.)?) {_CAP}{_E}")
SAID = re.compile(rf"{_B}(?:my name is|mein name ist|me llamo)[ ]+({_W}(?:[ ]{_W}){{1,2}})", re.I)
CAPITALISED = re.compile(rf"(?<![\w'’\-]){_UP}[\w'’\-]*")
# What may stand before a surname (the given names and initials) and after one or a given name.
_LEFT = re.compile(rf"(?:(?<![\w'’\-])(?:{_W}|{_I})[ \t ]?){{1,4}}$")
_WORD = re.compile(rf"{_I}|{_W}")
_AFTER = re.compile(rf"([ \t ])(?:({_I})|({_W}))")
_COMMA = re.compile(rf",[ \t ]({_W})(?:[ \t ](?:{_I}|{_W}))?")
IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\w-])")
EMAIL = re.compile(
    r"(?<![\w.+\-])[\w+][\w.+\-]*+(?:(?: ?[@＠] ?|[ ]?[(\[]at[)\]] ?)[^\W_](?:[\w\-]|\.(?=\w))*(?: ?(?:\[dot\]|\(dot\)) ?[\w\-]+)*"
    rf"| at [^\W_][\w\-]*(?:(?: dot |\.)[\w\-]+)*(?: dot |\.)(?:{'|'.join(TLDS)}){_E})",
    re.I,
)
_TLD = re.compile(r"(?:\.|\bdot[\])]? ?)([^\W\d_]{2,})$", re.I)
_ID_WORDS = (
    r"social security (?:number|no\.?)|my social|ssn|passport|reisepass(?:nummer)?|pasaporte|national insurance(?: number| no\.?)?|nino|ni number|"
    r"driver['’]?s? licen[cs]e|driving licen[cs]e|führerschein(?:nummer)?|national id(?:entity)?(?: card)?|id card|identity card|identity number|"
    r"personalausweis|ausweisnummer|dni|nie|tax (?:id|number|no\.?)|steuer-?(?:id|nummer)|vat (?:id|number)|tin|nif|sin|aadhaar|bsn"
)
IDENTITY = re.compile(
    rf"{_B}(?:{_ID_WORDS})(?:[ ]+(?:number|no\.?|nr\.?|card))?(?:[ ]+(?:is|ist|es))?[ ]*[:=#]?[ ]*"
    r"([a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d](?![a-z])|\d{3}[ \-]\d\d[ \-]\d{4}(?!\d)|\d\d[/\-]\d{3,4}[/\-]\d{4,5}(?:-[a-z](?![a-z]))?|\d{3} \d{4} \d{4}(?!\d)"
    r"|[a-z]\d{3}-\d{4}-\d{4}|[a-z]?\d{3}\.\d{3}\.\d{3}(?:-\d\d)?|[a-z]{1,5}[ \-]?\d{5,10}(?:[a-z]{1,3})?(?![a-z0-9])|\d{5,14}(?:-?[a-z](?![a-z]))?)",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w./\-+])(?:\+\d{1,3}(?:[ .\- ]?\(\d\))?(?:[ .\-/ ]?\d{2,5}){2,5}|00\d{2}(?:[ .\-/ ]\d{2,6}){2,4}"
    r"|\(\d{3}\)[  ]?\d{3}[ .\- ]\d{4}|\d{3}(?:[ .\- ]| [–\-] )\d{3}(?:[ .\- ]| [–\-] )\d{4}"
    r"|0\d{2,4}[ /]\d{3,4} \d{3,4}|0\d{2,4}/\d{6,8}|1\d{10})(?![\w/]|[.\-]\d)(?: ?(?:ext\.?|x) ?\d{1,5})?",
    re.I,
)
_D = f"(?:{'|'.join(DIGIT_WORDS)}|oh)"
SPOKEN = re.compile(rf"{_B}{_D}(?:(?:, |[ \-]){_D}){{6,}}{_E}", re.I)
_STREET = "street|st|road|rd|avenue|ave|lane|ln|court|ct|crescent|boulevard|blvd|drive|terrace|square|close"
_PLACE = rf"(?:(?:,[ \n]?|\n)(?:\d{{5}} )?{_CAP}(?: \d{{5}})?{_E}|(?:, |\n)(?-i:[a-zà-ÿ]{{4,}}){_E}(?: \d{{5}})?)"
ADDRESS = re.compile(
    rf"{_B}(?:(?:(?:flat|unit|apt|apartment|suite)\.? \d+[a-z]?(?:, ?|/| ))?\d{{1,5}}[a-z]?,? (?:{_W} ){{1,2}}?(?:{_STREET}){_E}\.?(?:, (?:apt|flat|unit)\.? \d+[a-z]?)?{_PLACE}?"
    rf"|[^\W\d_]{{3,}}(?:straße|strasse|str\.|weg|gasse|allee|platz) \d{{1,4}}[a-z]?{_E}{_PLACE}?"
    rf"|(?:calle|c/|avenida|avda\.?|plaza|paseo) {_W} \d{{1,4}}{_E}(?:, \d+[ºª] [a-z]{_E})?{_PLACE}?"
    rf"|(?:p\.? ?o\.? ?box|postfach|apartado) \d+{_E}{_PLACE}?)",
    re.I,
)

_TRIGGERS = {
    "t": ["my name is", "mein name ist", "me llamo", "mr.", "mrs.", "ms.", "miss ", "dr.", "prof.", "herr ", "frau ", "señor"],
    "e": ["@", "＠", "(at)", "[at]", " at "],
    "i": ["social security", "my social", "ssn", "passport", "reisepass", "pasaporte", "national insurance", "nino", "ni number", "driver", "driving licen", "führerschein", "national id", "id card", "identity", "personalausweis", "ausweis", "dni", "nie", "tax ", "steuer", "vat ", "tin", "nif", "sin", "aadhaar", "bsn"],
    "a": [" street", " st", " road", " rd", " ave", " lane", " ln", " court", " ct", " crescent", " boulevard", " blvd", " drive", " terrace", " square", " close", "straße ", "strasse ", "str. ", "weg ", "gasse ", "allee ", "platz ", "calle ", "c/ ", "avenida ", "avda", "plaza ", "paseo ", "box ", "postfach ", "apartado "],
    "p": [
        *(w + x for w in ("name", "from", "to", "cc", "by", "author", "sender", "recipient", "attendee", "signed", "nombre", "von", "an", "de", "para") for x in (":", "=", " :", " =")),
        "sister", "brother", "mother", "father", "mum", "mom", "dad", "son", "daughter", "wife", "husband", "partner", "aunt", "uncle", "cousin", "friend", "colleague", "boss", "manager", "landl",
        "neighbo", "tenant", "customer", "client", "patient", "employee", "teacher", "doctor", "nurse", "plumber", "lawyer", "schwester", "bruder", "kund", "nachbar", "vermieter", "herman", "cliente", "vecin", "casero",
        "regards", "wishes", "sincerely", "cheers", "yours", "gruß", "grüße", "saludos", "atentamente", "ask for", "asked for", "emergency contact", "contact", "met ", "told ", "reach ", "named ", "dear ", "hi ", "hello ",
        "hallo ", "hola ", "querid", "liebe", "geht an ", "signed by ", *(f"{w} for " for w in ("booking", "reservation", "parcel", "package", "letter", "message", "invoice", "appointment")),
        "lunch ", "dinner ", "coffee ", "breakfast ", "spoke ", "talked ", "speak ", "talk ", "meeting ", "chatted ",
    ],
    "d": [" lives", " lived", " texted", " phoned", " emailed", " was born", " born", " married", " told", " replied", " is my", " is our", " wohnt", " vive", ", our ", ", my ", ", his ", ", her ", ", their ", ", aged ", ", unser", ", mein", ", mi ", ", nuestr", "<", "("],
    "y": ["my name is", "mein name ist", "me llamo"],
    "s": [f"{w}{s}" for w in (*DIGIT_WORDS, "oh") for s in (" ", "-", ", ")],
}
_GROUPS = {c: 1 << i for i, c in enumerate(_TRIGGERS)}
#: Groups whose patterns begin with the trigger, so that they are tried there only.
_AT = _GROUPS["i"] | _GROUPS["t"] | _GROUPS["p"] | _GROUPS["y"]
_NO_NAME_AFTER = set(ORG_WORDS) | {w.capitalize() for w in _STREET.split("|")}
_DIGITS = re.compile(r"\d\d")
_LONG_NUMBER = re.compile(r"(?:\d[ .\-/()– ]{0,3}){7}")


GIVEN, LAST = 1, 2  # the roles of a word in names


def _plain(word: str) -> str:
    return word.lower().replace("’", "'")


class Lexicon:
    """Words known to be given names or surnames, and one automaton for them and the triggers of the patterns."""

    def __init__(self, learned: dict[str, int] | None = None):
        self.roles = {_plain(w): GIVEN for w in FEMALE + MALE}
        for w in SURNAMES:
            self.roles[_plain(w)] = self.roles.get(_plain(w), 0) | LAST
        for w, role in (learned or {}).items():
            self.roles[w] = self.roles.get(w, 0) | role
        words: dict[str, list[int]] = {}
        for c, ws in _TRIGGERS.items():
            for w in ws:
                words.setdefault(w, [0, 0])[0] |= _GROUPS[c]
        for w, role in self.roles.items():
            words.setdefault(w, [0, 0])[1] = role
        self.automaton = ahocorasick.Automaton()
        for w, (bits, role) in words.items():
            self.automaton.add_word(w, (bits, role, len(w)))
        self.automaton.make_automaton()

    def is_given(self, word: str) -> bool:
        return bool(self.roles.get(_plain(word), 0) & GIVEN)

    def read(self, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """The groups of patterns to run on a text, where the triggers of some begin, and its words that are in the lexicon: (start, end,
        role)."""
        low = text.lower().replace("’", "'")
        if len(low) != len(text):  # some capitals have longer small forms
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text).replace("’", "'")
        seen, starts, words = 0, [], []
        for last, (bits, role, size) in self.automaton.iter(low):
            seen |= bits
            if bits & _AT:
                starts.append((last + 1 - size, bits))
            if role:
                a, b = last + 1 - size, last + 1
                if (a == 0 or not (low[a - 1].isalnum() or low[a - 1] in "_'-")) and (b == len(low) or not (low[b].isalnum() or low[b] == "_" or low[b] in "'-" and low[b + 1 : b + 2].isalpha() and low[b : b + 3].rstrip() != "'s")):
                    words.append((a, b, role))
        return seen, starts, words


@lru_cache(1)
def _common() -> Lexicon:
    return Lexicon()


def _known_names(text: str, words: list[tuple[int, int, int]], lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """Names with a word of the lexicon: given names or initials before a surname, a given name after one and a comma, any
    capitalised word after a given name."""
    for a, b, role in words:
        if role & LAST:
            start = a
            left = _LEFT.search(text, max(0, a - 60), a)
            for m in reversed(list(_WORD.finditer(left[0])) if left else []):
                w = m[0]
                if w.endswith(".") and len(w) == 2 or lexicon.is_given(w):
                    start = left.start() + m.start()
                elif w.lower() not in _PARTICLES or start != a:
                    break
            if start < a:
                yield start, b
                continue
            after = _COMMA.match(text, b)
            if after and lexicon.is_given(after[1]):
                more = after[0][after.end(1) - b :].strip()
                yield a, after.end() if more.endswith(".") or lexicon.is_given(more) else after.end(1)
                continue
        if role & GIVEN and text[a].isupper():
            end, m = b, _AFTER.match(text, b)
            while m and (m[2] or lexicon.is_given(m[3])):
                end, m = m.end(), _AFTER.match(text, m.end())
            if m and m[3] and m[3][0].isupper() and len(m[3]) > 1:
                last = re.match(_CAP, m[3])
                yield _person(text, a, m.start(3) + last.end()) if last else (a, a)
            elif end > b and not text[:end].endswith("."):
                yield _person(text, a, end)


def _valid_iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def find_pii(text: str | None, lexicon: Lexicon | None = None) -> list[tuple[int, int, str]]:
    """The personal items of a text as (start, end, type), in order and without overlap; offsets count characters.

    Types: name, email, phone, id_number, address. None and the empty text have none. Where candidates overlap,
    e-mail addresses come first, then identity numbers, addresses, phone numbers and names.
    """
    if not text:
        return []
    lexicon = lexicon or _common()
    seen, starts, words = lexicon.read(text)
    tried = lambda group, pattern: [m for a, bits in starts if bits & _GROUPS[group] and (m := pattern.match(text, a))]
    taken: list[tuple[int, int, str]] = []

    def take(start: int, end: int, kind: str) -> None:
        i = bisect.bisect_left(taken, (start,))
        if start < end and (not i or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
            taken.insert(i, (start, end, kind))

    if seen & _GROUPS["e"]:
        for m in EMAIL.finditer(text):
            end = len(m[0].rstrip(".-_"))
            tld = _TLD.search(m[0][:end])
            if tld and (tld[1].lower() in TLDS or "at" not in m[0].lower()[: m[0].lower().find(tld[0].lower())] or "@" in m[0]):
                take(m.start(), m.start() + end, "email")
    digits = _DIGITS.search(text)
    if digits and _LONG_CODE.search(text):
        for m in IBAN.finditer(text):
            if _valid_iban(m[0]):
                take(m.start(), m.end(), "id_number")
    if seen & _GROUPS["i"]:
        for m in tried("i", IDENTITY):
            take(m.start(1), m.end(1), "id_number")
    if digits or seen & _GROUPS["a"]:
        if seen & _GROUPS["a"]:
            for m in ADDRESS.finditer(text):
                if _plausible(m[0]):
                    take(m.start(), m.end(), "address")
        if _LONG_NUMBER.search(text):
            for m in PHONE.finditer(text):
                take(m.start(), m.end(), "phone")
    if seen & _GROUPS["s"]:
        for m in SPOKEN.finditer(text):
            take(m.start(), m.end(), "phone")
    for start, end in _known_names(text, words, lexicon) if words else ():
        take(start, end, "name")
    if seen & _GROUPS["y"]:
        for m in tried("y", SAID):  # in small letters only with a word that is known
            parts = m[1].split(" ")
            while len(parts) > 2 and parts[-1].lower() in NOT_NAMES:
                parts.pop()
            if any(_plain(w) in lexicon.roles for w in parts) and not any(w.lower() in NOT_NAMES for w in parts):
                take(m.start(1), m.start(1) + len(" ".join(parts)), "name")
    if seen & _GROUPS["t"]:
        for m in tried("t", TITLED):
            after = re.match(rf"[ ](?:{'|'.join(ORG_WORDS)})\b", text[m.end() : m.end() + 14])
            if not after and m[1].split()[-1] not in ORG_WORDS:
                take(m.start(1), m.end(1), "name")
    if seen & _GROUPS["p"]:
        for m in sorted(tried("p", INTRODUCED), key=lambda m: m.start()):
            take(*_person(text, *m.span(1)), "name")
    if seen & _GROUPS["d"]:
        for m in DESCRIBED.finditer(text):
            take(*_person(text, *m.span(1)), "name")
    if _INITIAL.search(text):
        for m in INITIALS.finditer(text):
            take(*_person(text, *m.span()), "name")
    return taken


_LONG_CODE = re.compile(r"[A-Z]{2}\d\d ?[A-Z0-9]{4}")
_INITIAL = re.compile(rf"(?<![^\W_]){_UP}\. ?{_UP}")
_NEXT = re.compile(r"[ \t ]([^\W\d_]+)")


def _person(text: str, start: int, end: int) -> tuple[int, int]:
    """The name in a capitalised stretch, without words before it that begin a sentence; empty if it is none, as where one of
    its words or the capitalised one after it belongs to an organisation, a place or a date."""
    words = list(re.finditer(r"[^\s,]+", text[start:end]))
    while len(words) > 2 and words[0][0].lower() in NOT_NAMES:
        del words[0]
    after = _NEXT.match(text, end)
    if len(words) < 2 or any(w[0].lower() in NOT_NAMES and w[0] not in _PARTICLES for w in words) or after and after[1][0].isupper() and after[1] in _NO_NAME_AFTER:
        return start, start
    return start + words[0].start(), end


_LOWER = re.compile(rf"\d[a-z]?,? ((?-i:[a-zß-ÿ][\w'’\-]*(?: \w+)?)|\w+ (?-i:[a-zß-ÿ])[\w'’\-]*) ({_STREET})\b(.*)", re.I | re.S)


def _plausible(address: str) -> bool:
    """A street name in small letters counts only as a single longer word, and before a word of everyday use such as
    court only if a place follows."""
    m = _LOWER.search(address)
    if not m:
        return True
    return " " not in m[1] and len(m[1]) > 4 and (m[2].lower() in ("st", "rd", "ave", "ln", "ct", "blvd", "street", "avenue") or len(m[3]) > 3)


class Surrogates:
    """Replacements under a key. ``of(kind, value)`` keeps case, punctuation, length of digit groups, script class and,
    for known names, gender; it is a bijection on values of the same format, so distinct values stay distinct."""

    def __init__(self, key: bytes):
        self.key = key
        self.names: dict[str, str] = {}
        for group in (FEMALE, MALE, SURNAMES):
            order = sorted(group, key=lambda w: hmac.new(key, w.encode(), hashlib.sha256).digest())
            for i, w in enumerate(order):
                to = order[(i + 1) % len(order)]
                self.names[w.lower()] = to
                self.names.setdefault(_fold(w), _fold(to))
        self.known = {_fold(w) for w in FEMALE + MALE + SURNAMES}
        self.of = lru_cache(65_536)(self._surrogate)

    def _surrogate(self, kind: str, value: str) -> str:
        out = self._of(kind, value)
        # where nothing can take another value, a keyed token stands for it
        return out if out != value else hmac.new(self.key, value.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()[:16]

    def _of(self, kind: str, value: str) -> str:
        if kind == "phone" and not any(c.isdigit() for c in value):
            return self._spoken(value)
        if kind in ("phone", "id_number"):
            return self._format(value, letters=kind == "id_number")
        if kind == "email":
            cut = max([value.rfind("."), value.lower().rfind("dot")])
            return self._words(value[:cut], plain=True) + value[cut:]
        return self._words(value, plain=False)

    def _words(self, value: str, plain: bool) -> str:
        """Word by word; a known name becomes a known name, in addresses and e-mail addresses alike."""
        fixed = {"at", "dot", "mail", "street", "st", "road", "rd", "avenue", "ave", "lane", "court", "crescent", "boulevard", "flat", "unit", "apt", "box", "calle", "p", "o"}

        def one(m: re.Match) -> str:
            w = m[0]
            if w.lower() in fixed:
                return w
            to = self.names.get(_plain(w))
            if to is None:
                return self._format(w, letters=True)
            to = _fold(to) if plain else to
            return to.upper() if w.isupper() and len(w) > 1 else to.lower() if w.islower() else to[:1].upper() + to[1:]

        return re.sub(r"[^\W\d_]+|\d+" if plain else r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+", one, value)

    def _spoken(self, value: str) -> str:
        words = re.findall(r"[a-z]+", value.lower().replace("oh", "zero"))
        digits = iter(self._format("".join(str(DIGIT_WORDS.index(w)) for w in words), letters=False))
        return re.sub(r"[A-Za-z]+", lambda m: DIGIT_WORDS[int(next(digits))], value)

    def _format(self, value: str, letters: bool) -> str:
        """Letter by letter and digit by digit of the same class. Accents stay where they are, so that a name and its plain form in an
        e-mail address agree; so does a vowel at the end of a word, which often tells the gender."""
        apart = [_base(c) if letters else c for c in value]
        chars = [c[0] for c in apart]
        alphabets = [a if (a := _marked(c[0], c[1:])) and (letters or c[0].isdigit()) else c[0] for c in apart]
        if letters and len(chars) > 2 and alphabets[-1] in (_VOWELS, _VOWELS.upper()):
            alphabets[-1] = chars[-1]
        size = 1
        for a in alphabets:
            size *= len(a)
        if size < 2:
            return value
        n = 0
        for c, a in zip(chars, alphabets):
            n = n * len(a) + a.index(c)
        form = "".join(a[0] for a in alphabets).lower().encode("utf-8", "surrogatepass")
        while True:
            n = out = self._permute((self._permute(n, size, form) + 1) % size, size, form, back=True)  # a single cycle: no value stays
            made = []
            for a in reversed(alphabets):
                out, k = divmod(out, len(a))
                made.append(a[k])
            text = "".join(unicodedata.normalize("NFC", c + a[1:]) if a[1:] else c for c, a in zip(reversed(made), apart))
            if text == value or _fold(text) not in self.known:  # walks on within the cycle
                return text

    def _permute(self, n: int, size: int, form: bytes, back: bool = False) -> int:
        half = ((size - 1).bit_length() + 1) // 2
        mask = (1 << half) - 1
        while True:
            left, right = n >> half, n & mask
            if back:
                left, right = right, left
            for i in reversed(range(6)) if back else range(6):
                digest = hashlib.blake2b(b"%d|%d|%s|%d" % (i, half, form, right), key=self.key[:64], digest_size=32).digest()
                left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
            if back:
                left, right = right, left
            n = left << half | right
            if n < size:
                return n


_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"


def _alphabet(c: str) -> str:
    if c in "0123456789":
        return "0123456789"
    for a in (_VOWELS, _CONSONANTS):
        if c in a:
            return a
        if c.lower() in a and c.isupper():
            return a.upper()
    return "" if c.isascii() else _other_alphabet(c)


@lru_cache(65_536)
def _marked(c: str, marks: str) -> str:
    """The alphabet of a letter, without those that the accents don't combine with."""
    a = _alphabet(c)
    return "".join(x for x in a if len(unicodedata.normalize("NFC", x + marks)) == len(unicodedata.normalize("NFC", c + marks))) if marks else a


@lru_cache(65_536)
def _base(c: str) -> str:
    """A Latin letter apart from its accents; any other character as it is."""
    apart = unicodedata.normalize("NFD", c)
    return apart if apart[0].isascii() and unicodedata.normalize("NFC", apart) == c else c


@lru_cache(65_536)
def _other_alphabet(c: str) -> str:
    """The ten digits of the same script; the letters of the same script, class and case among the 256 characters around, but for Latin
    letters with accents, which are taken apart before."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return ""
    script, kind, start = unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), ord(c) & ~0xFF
    near = (chr(i) for i in range(max(start, 128), start + 256))
    return "".join(x for x in near if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script and _base(x) == x)


def _fold(w: str) -> str:
    w = "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]", "", w)


def surrogate_items(text: str | None, surrogates: Surrogates, lexicon: Lexicon | None = None) -> list[tuple[int, int, str, str]]:
    """The personal items of a text as (start, end, type, surrogate)."""
    return [(s, e, kind, surrogates.of(kind, text[s:e])) for s, e, kind in find_pii(text, lexicon)]


def redact(text: str | None, surrogates: Surrogates, lexicon: Lexicon | None = None) -> str | None:
    """The text with each item as ``<TYPE:surrogate>``; all other text unchanged; None stays None."""
    found = surrogate_items(text, surrogates, lexicon)
    if not found:
        return text
    out, at = [], 0
    for s, e, kind, other in found:
        out += [text[at:s], f"<{kind.upper()}:{other}>"]
        at = e
    return "".join([*out, text[at:]])


def name_words(texts: list[str | None]) -> dict[str, list[int]]:
    """Of each capitalised word that occurs in a name of two words or more: how often as a given name, as a surname and at all."""
    given, last, raw, seen = Counter(), Counter(), Counter(), Counter()
    for t in texts:
        if not t:
            continue
        raw.update(CAPITALISED.findall(t))
        for s, e, kind in find_pii(t):
            if kind != "name":
                continue
            name = t[s:e]
            parts = [_plain(w) for w in re.split(r"[ \t ,]+", name) if len(w) > 1 and not w.endswith(".") and w.lower() not in _PARTICLES]
            if "," in name:
                parts = parts[1:] + parts[:1]
            if parts and len(re.split(r"[ \t ]+", name)) > 1:
                last[parts[-1].removesuffix("'s")] += 1
                given.update(parts[:-1])
    for w, n in raw.items():
        seen[_plain(w)] += n
    return {w: [given[w], last[w], seen[w]] for w in given.keys() | last.keys()} | {w: [0, 0, n] for w, n in seen.items() if w not in given and w not in last}


def _spread(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as there are cores, where a small table is read in fewer; a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def learn(df: DataFrame, text_col: str, least: int = 3, share: float = 0.25, rare: float = 1e-6) -> dict[str, int]:
    """The lexicon of a corpus: words with their roles in names, from the names that stand where names do.

    A word has a role if it was found in it ``least`` times, in the part ``share`` of all places where it stands with a capital and in the
    part ``rare`` of all words of names, which bounds the lexicon to 1 / ``rare`` words whatever the corpus. Counts cover all texts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = name_words(b.column(0).to_pylist())
            counts = list(zip(*found.values())) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["word", "given", "last", "seen"])

    texts = _spread(df.select(F.col(text_col).alias("text")).where("text <> ''"))
    words = texts.mapInArrow(run, "word string, given bigint, last bigint, seen bigint").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("given", "last", "seen")])
    named = shared_checkpoint(words.where(F.greatest("given", "last") >= least))
    least = max(least, rare * (named.agg(F.sum(F.col("given") + F.col("last"))).first()[0] or 0))
    enough = lambda c: ((F.col(c) >= least) & (F.col(c) >= share * F.col("seen"))).cast("int")
    rows = named.select("word", (enough("given") * GIVEN + enough("last") * LAST).alias("role")).where("role > 0").collect()
    return {r["word"]: r["role"] for r in rows if r["word"] not in NOT_NAMES}


def pii_items(df: DataFrame, id_col: str, text_col: str, key: str, learned: dict[str, int] | None = None) -> DataFrame:
    """The personal items in ``text_col`` and their surrogates: (rec_id, pii_type, start_pos, end_pos, surrogate), one row each, as
    ``redacted`` replaces them.

    A record delivered again gives no second row; null and empty texts and texts without items give none; a null id
    stays null; other columns are ignored.
    """
    schema = pa.schema([("rec_id", pa.string()), ("pii_type", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("surrogate", pa.string())])
    shared = df.sparkSession.sparkContext.broadcast(learned or {})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = Lexicon(shared.value), Surrogates(key.encode())
        for b in batches:
            rows = [(i, k, s, e, x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, e, k, x in surrogate_items(t, made, known)]
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    src = _spread(df.select(df[id_col].cast("string").alias("rec_id"), df[text_col].alias("text")).where("text <> ''"))
    return src.mapInArrow(run, "rec_id string, pii_type string, start_pos bigint, end_pos bigint, surrogate string").distinct()


def redacted(df: DataFrame, text_col: str, key: str, learned: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``text_col`` redacted; all rows and other columns stay as they are."""
    shared = df.sparkSession.sparkContext.broadcast(learned or {})

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, made = Lexicon(shared.value), Surrogates(key.encode())
        for texts in parts:
            yield texts.map(lambda t: redact(t, made, known), na_action="ignore")

    return df.withColumn(text_col, clean(df[text_col]))
