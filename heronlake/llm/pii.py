"""Personal information inside free text.

E-mail addresses, phone numbers, identity numbers, street addresses and names are found by patterns
and the words around them, and replaced by typed placeholders. Phone and identity numbers keep their
format: their digits are permuted by a keyed Feistel network inside the placeholder, so that equal
numbers, however they are written, stay linked across documents without being readable.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The list of given names is a small table; a larger one is refused, as it is sent to every task.
MAX_GIVEN_NAMES = 100_000
TYPES = ("email", "phone", "id_number", "address", "name")

# ---- numbers -------------------------------------------------------------------------------

_EMAIL = re.compile(
    r"(?<![\w.+-])\w[\w.+-]*\s{0,2}(?:[@＠]|[(\[]\s?at\s?[)\]])\s{0,2}[a-z0-9][\w-]*"
    r"(?:[.．][a-z0-9][\w-]*|\s+dot\s+[a-z][\w-]*|\s?[(\[]dot[)\]]\s?[a-z][\w-]*)+",
    re.I,
)
_VALUE = r"(?:[a-z]{1,3}[-/]?)?\d(?:[ \-/.  ]?\d){3,17}(?:[- ]?[a-z](?![\w]))?"
_ID = re.compile(
    r"(?<!\w)(?:ssn|social(?:\s+security)?(?:\s+(?:number|no\.?))?|nhs|mrn|(?:medical\s+)?record|patient(?:en)?(?:\s*-?\s*id|\s*-?nr|\s*-?nummer|\s+no|\s+number)|passport|reisepass\w*|passeport|pasaporte"
    r"|policy|insurance(?:\s+member)?|member\s+id|versicherten\w*|versicherungs\w*|kranken\w*nummer|dni|nie|nif|n[°ºo]\.?\s+de\s+s[ée]cu\w*(?:\s+sociale)?|num[ée]ro\s+de\s+s[ée]cu\w*(?:\s+sociale)?|dossier(?:\s+patient)?|n[úu]mero\s+de\s+(?:historia|p[óo]liza|afiliaci[óo]n)|historia\s+cl[íi]nica|p[óo]liza|снилс|полис\w*|паспорт\w*|steuer-?id)"
    r"(?:[.,:#\s  °º№-]|\b(?:is|no|nr|nummer|number|num[ée]ro|id|n|lautet|ist|es|est|clínica|member)\b){0,8}?"
    rf"(?P<v>{_VALUE})",
    re.I,
)
_SSN = re.compile(r"(?<![\w.-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")
_PHONE = re.compile(
    r"(?<![\w.,/-])(?<!\w[-/])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .\-/]?)?\d(?:[ .\-/ ]{0,2}\d){5,14}(?:\s?(?:ext\.?|x|durchwahl|poste)\s?\d{1,5})?(?![\w%])(?!\s?(?:mg|µg|μg|g|kg|ml|mmol|units?|mmhg|tablets?)\b)",
    re.I,
)
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_SPOKEN = re.compile(rf"\b{_DIGIT_WORD}(?:[\s,-]+{_DIGIT_WORD}){{6,}}\b", re.I)
_PHONE_CUE = re.compile(r"(?:call|phone|tel|tél|text|mobile|ring|number is|rückruf|numéro est|teléfono|llámeme|telefon|handy|fax|тел)\W*(?:\w+\W+){0,3}$", re.I)
_NOT_PHONE = re.compile(r"(?:batch|lot|trial|ref|version|icd|code|isbn|doi|protocol|charge|lote|room)\W*(?:\w+\W+){0,1}$", re.I)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}")

# ---- addresses -----------------------------------------------------------------------------

_TAIL = r"(?:,\s*(?:flat|apt|apartment|unit|suite)\.?\s*\w+)?(?:,?\s*[^\W\d_]\w+(?:\s[A-Za-z]{1,2}\s?\d[\w ]{2,6}\w)(?!\w))?(?:,?\s*\d{5}\s[^\W\d_][\w-]+)?"
_NO_UNIT = r"(?!\s*(?:mg|µg|μg|ml|x|of|to|and|am|pm|hours?|days?|weeks?|months?|years?|units?|mmol)\b)"
_STREET = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|close|crescent|blvd\.?|boulevard|drive|court|terrace|square|parkway|gardens)(?![\w])"
_ADDRESS = re.compile(
    "|".join(
        (
            rf"(?<![\w.])\d{{1,5}}[a-z]?{_NO_UNIT}(?:\s+[^\W\d_][\w'’-]+){{1,3}}?\s+{_STREET}{_TAIL}",
            r"(?<!\w)(?:p\.?\s?o\.?\s?box|postfach|apartado(?:\s+de\s+correos)?|b\.p\.)\s*\d+(?:,\s*[^\W\d_]\w+)?",
            r"(?<![\w.])\d{1,4}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|av\.|boulevard|bd|chemin|place|allée|impasse|quai|route|square)\s+(?:de\s+la\s+|de\s+l['’]|des\s+|du\s+|de\s+|d['’])?[^\W\d_][\w'’-]+(?:,?\s*\d{5}\s[^\W\d_][\w-]+)?",
            r"(?<!\w)(?:calle|c/|avda\.?|avenida|plaza|paseo|camino|carretera|ronda|travesía)\s+(?:(?:de|del|la|las|los|el)\s+){0,2}[^\W\d_][\w'’-]+(?:\s[^\W\d_][\w'’-]+)?,?\s*(?:n\.?\s?º\s*|núm\.?\s*)?\d{1,4}(?:,\s*\d{1,2}\s?º\s?\w?)?",
            r"(?<!\w)[^\W\d_]{2,}(?:str\.|straße|strasse|weg|gasse|allee|platz|damm|ufer|graben|chaussee)\s*\d{1,4}(?:[^\S\n]?[a-z])?(?!\w)(?:,?\s*\d{5}\s[^\W\d_][\w-]+)?",
        )
    ),
    re.I,
)
_ADDRESS_DE = re.compile(r"(?<!\w)(?:Am|An der|Im|Auf dem|Zum|Zur)\s[A-ZÄÖÜ][\wäöüß-]+\s\d{1,4}[a-z]?(?!\w)(?!\.)(?:,?\s*\d{5}\s[^\W\d_][\w-]+)?")
#: Kinds of street that are ordinary words as well: they count only where they are written as names are.
_MINOR = r"(?:Alley|Approach|Bank|Bend|Bridge|Circle|Corner|Croft|Cross|Dale|Drove|End|Esplanade|Estate|Fields?|Gate|Glade|Glen|Green|Grove|Heath|Heights|Highway|Hill|Loop|Mall|Meadows?|Mews|Mount|Parade|Park|Pass|Path|Place|Pl|Promenade|Quay|Ridge|Rise|Row|Trail|Vale|View|Villas|Walk|Way|Wharf|Wood|Yard)"
_ADDRESS_MINOR = re.compile(rf"(?<![\w.])\d{{1,5}}[A-Za-z]?,?(?:[ \t]+[A-ZÀ-ÞА-Я][\w'’-]+){{1,3}}?[ \t]+{_MINOR}(?![\w]){_TAIL}")
_ADDRESS_CUED = re.compile(
    r"(?:\b(?:address(?: is|:)|(?:live|lives|living|staying|reside|resides) (?:at|in)|moved? to|(?:pick ?-?up|collect(?:ed)?|picked up) from|(?:send|sent|post|posted|mail|deliver|delivered|bring|ship|forward)\b[\w ]{0,30}?\bto|visit (?:me|us) at|come to|home is(?: at)?)|\bwohn(?:e|en|t) (?:in der|in|am|an der)|anschrift(?: ist)?:?|adresse(?: ist| est)?\s?:?|habit(?:e|ons)(?: au)?|envoyez[\w-]* (?:au|à)|viv(?:o|imos) en|direcci[óo]n(?::| es))\s+"
    r"(?P<v>[^\n;!?()@]{0,40}?\d{1,5}(?:[^\S\n]?[a-z])?(?!\w)(?:,\s*\d{5}\s[^\W\d_]\w+)?)",
    re.I,
)

# ---- names ---------------------------------------------------------------------------------

_CAP = r"(?:[A-ZÀ-ÖØ-ÞĀŁŚŠŽА-Я][\w'’-]+)"
_INI = r"(?:[A-ZÀ-ÖØ-Þ]\.\s?)"
_ANY = r"(?:[^\W\d_][^\W\d_'’]*(?:['’-][^\W\d_]+)*)"
_TWO = rf"(?:{_INI}{{1,2}}{_CAP}|{_CAP}[ \t]+(?:{_INI})?{_CAP})"
_PAIR = rf"(?:{_INI}{{1,2}}{_CAP}|{_CAP}(?:[ \t]+{_INI})?(?:[ \t]+{_CAP})?)"
# Words that stand beside names, from which the patterns and the gate are built.
#: After these a name follows in whatever case it is written.
_SURE = r"my name is|my name's|name[ \t]*:|je m['’]appelle|mon nom est|me llamo|mi nombre es|mein name ist|ich heiße|ich heisse|mi chiamo|mijn naam is|меня зовут|моё имя|signed,?|signé,?|firmado:?|regards,?|gruß,?|grüße,?|unterzeichnet,?|cordialement,?|saludos,?"
_TITLE = r"dr|prof|mr|mrs|ms|miss|frau|herrn?|mme|mlle|sra|srta|sr|dra|schwester"
_KIN = r"(?:daughter|son|wife|husband|mother|father|mum|mom|dad|sister|brother|partner|aunt|uncle|niece|nephew|cousin|grandmother|grandfather|grandson|granddaughter|colleague|neighbour|neighbor|friend|boss|tochter|sohn|frau|mann|mutter|vater|schwester|bruder|fille|femme|mère|fils|mari|père|sœur|frère|hija|hijo|esposa|marido|madre|padre|hermana|hermano)"
_STAFF = r"(?:nurse|midwife|matron|doctor|physician|surgeon|therapist|physiotherapist|dietitian|pharmacist|carer|caregiver|receptionist|secretary|counsellor|consultant|patient|client|resident|patientin|infirmière|enfermera)"
_OWN = r"(?:my|our|his|her|their|your|the|an?|meine?|unsere?|ma|mon|notre|mi|su)"
_SPEECH = r"(?:phoned|called|rang|asked|asks|told|said|says|wrote|writes|e-?mailed|texted|messaged|wanted|wants|would like|needs|needed|explained|complained|reported|mentioned|visited|came|attended|replied|answered|spoke|confirmed|sent|here|hier|ici|aquí|fragte|sagte|rief|schrieb|möchte|a dit|a appelé|a demandé|dijo|llamó|preguntó|escribió|сказала?|спросила?|позвонила?)"
_CLOSING = r"(?:thanks|thank you|best wishes|best|cheers|yours(?: sincerely)?|sincerely|merci|gracias|un saludo|danke|с уважением)"
_NAME_SURE = re.compile(rf"(?<!\w)(?i:{_SURE})\s+(?P<v>(?:(?i:[a-zà-þ]\.\s?)?{_ANY}(?:[ \t]+{_ANY})?))")
_TITLED = re.compile(rf"(?<!\w)(?i:{_TITLE})\.?[ \t]+(?P<v>{_PAIR})")
_TITLED_LOW = re.compile(rf"(?<!\w)(?i:dr|prof|mrs|mr|ms|frau|herr|mme|mlle|sra|srta)\.?[ \t]+(?P<v>{_ANY})(?=\s+(?i:told|next|hat|hatte|m['’]a|me|said|says|saw|advised|wrote|asked|phoned|called|a dit)\b)")
_NAME_CAP = re.compile(
    rf"(?<!\w)(?:(?i:i['’]m|i am|this is|nurse|midwife|{_OWN}[ \t]+(?:late |young |elder |little |new )?{_KIN}|(?:patient|man|woman|boy|girl|nurse|person|someone) (?:named|called))[ \t]+(?P<v>{_PAIR})"
    rf"|(?i:{_OWN}[ \t]+(?:{_KIN}|{_STAFF}))(?:,[ \t]*|[ \t]+)(?P<w>{_TWO})"
    rf"|(?i:{_OWN}[ \t]+{_KIN}),[ \t]+(?P<x>{_CAP})(?=,)"
    rf"|(?i:ask(?:ed|ing)? for|speak (?:to|with)|talk to|contact)[ \t]+(?P<y>{_TWO}|{_CAP}(?=[ \t]+(?:at|in|on|from)\b)))"
)
#: In small letters a word after a relative is a name where a verb or the end of the clause follows.
_KIN_LOW = re.compile(rf"(?<!\w)(?:(?:my|our|his|her)[ \t]+{_KIN}|(?:nurse|midwife)(?=[ \t]+\w+[ \t]+(?:from|at|on|in)[ \t]+the))[ \t]+(?P<v>{_ANY})(?=[ \t]+(?:had|has|is|was|said|told|asked|got|will|would|can|could|needs|takes|took|from|at|on|in)\b|[ \t]*[,;.!?)\n-]|[ \t]*$)", re.I)
_ACTS = re.compile(rf"(?<![\w.'’-])(?:(?P<v>{_TWO}),?|(?P<w>{_CAP},[ \t]+{_CAP}),?)(?=[ \t]+(?i:{_SPEECH})(?!\w))")
_CLOSED = re.compile(rf"(?<!\w)(?i:{_CLOSING})[,.!]?[ \t]*[-–—]?\s*(?P<v>{_TWO})\s*[.!]?\s*$")
_NOT_NAME = frozenset(
    "a an the i my me we you it he she they is was were has had have be been in on at of to for from with and or not no yes so very too much just still also patient doctor nurse taking sure sorry worried afraid new old il elle le la les un une der die das ein eine el los las una por para que wrong right fine good bad safe true false clear answer what "
    "this that these those there here how why when where which who prof dr mr mrs ms hospital clinic surgery infirmary "
    "our his her their your today yesterday tomorrow again now then home once twice before after later back abroad alone well ill sick died however finally maybe perhaps unfortunately patients people doctors nurses please thanks thank dear hello hi".split()
)
#: What follows a relative in small letters and is no name.
_FOLLOWS = frozenset("will would can could should may might must and but because since until without about over by gets got took takes does did goes went said says told asked all both each some any".split())
#: A capital pair with one of these is an institution, an illness, a test or a medicine.
_THING = frozenset("hospital clinic surgery infirmary centre center university institute pharmacy department ward school college foundation trust society council care medical health practice group company association academy laboratory lab unit service services syndrome disease disorder test score scale trial study leaflet guideline journal xr sr er mr plus forte klinik krankenhaus apotheke hôpital clinique centro clínica".split())
_OF_THING = re.compile(rf"[ \t]+(?:[A-Z]\w+[ \t]+)?(?i:{'|'.join(sorted(_THING))})\b")
_TOKEN = re.compile(r"[^\W\d_]+")
_WORDS_OF = lambda fragment: frozenset(_TOKEN.findall(fragment.replace("(?:", " ").replace("?", "")))
_TITLES = _WORDS_OF(_TITLE) | {"herr"}
_NOUNS = _WORDS_OF(_KIN) | _WORDS_OF(_STAFF) | {"ask", "asked", "asking", "speak", "talk", "contact", "named", "called"}
_SURE_HINTS = ("name", "appelle", "nom est", "llamo", "nombre", "hei", "chiamo", "naam", "зовут", "имя", "sign", "firmado", "unterz", "regards", "gruß", "grüße", "cordial", "saludos")
_NO_LOW_NAME = re.compile(r"(?:ed|ing|ly|s)$")


def _feistel(digits: str, key: bytes, tweak: str = "", rounds: int = 10) -> str:
    """Keyed permutation of the decimal strings of one length (two halves, ten rounds)."""
    n = len(digits)
    if n < 2:
        return digits
    u = n // 2
    a, b = digits[:u], digits[u:]
    for i in range(rounds):
        m = len(a)
        h = hashlib.blake2b(f"{tweak}|{n}|{i}|{b}".encode(), key=key, digest_size=16).digest()
        c = (int(a or "0") + int.from_bytes(h, "big")) % 10**m
        a, b = b, str(c).zfill(m)
    return a + b


def _unfeistel(digits: str, key: bytes, tweak: str = "", rounds: int = 10) -> str:
    n = len(digits)
    if n < 2:
        return digits
    u = n // 2
    a, b = digits[:u], digits[u:]
    for i in reversed(range(rounds)):
        m = len(b)
        h = hashlib.blake2b(f"{tweak}|{n}|{i}|{a}".encode(), key=key, digest_size=16).digest()
        c = (int(b or "0") - int.from_bytes(h, "big")) % 10**m
        a, b = str(c).zfill(m), a
    return a + b


def _mod11(nine: str) -> int:
    return (11 - sum(int(d) * w for d, w in zip(nine, range(10, 1, -1))) % 11) % 11


def _luhn(digits: str) -> int:
    """Check digit behind ``digits``."""
    return -sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits))) % 10


#: Fixed value: check letters by the remainder of 23.
_LETTERS23 = "TRWAGMYFPDXBNJZSQVHLCKE"
# Country codes of one and two digits; all others have three.
_CODE1 = ("1", "7")
_CODE2 = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _code(digits: str) -> int:
    """Length of the country code with which an international number begins."""
    return 1 if digits.startswith(_CODE1) else 2 if digits.startswith(_CODE2) else 3


def _identity(value: str, digits: str, key: bytes) -> tuple[str, str]:
    """New digits of an identity number and the letter behind them, of a valid number a valid one."""
    letter = value[-1].upper() if value[-1:].isalpha() else ""
    if len(digits) == 8 and letter and letter == _LETTERS23[int(digits) % 23]:
        new = _feistel(digits, key, "id23")
        return new, _LETTERS23[int(new) % 23]
    if len(digits) == 15 and int(digits[13:]) == 97 - int(digits[:13]) % 97:
        new = _feistel(digits[:13], key, "id97")
        return new + f"{97 - int(new) % 97:02d}", letter
    if len(digits) == 10 and _mod11(digits[:9]) == int(digits[9]):
        new = _feistel(digits[:9], key, "id11")
        while _mod11(new) == 10:
            new = _feistel(new, key, "id11")
        return new + str(_mod11(new)), letter
    if len(digits) >= 11 and _luhn(digits[:-1]) == int(digits[-1]):
        new = _feistel(digits[:-1], key, "luhn")
        return new + str(_luhn(new)), letter
    return _feistel(digits, key, "id_number"), letter


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """``value`` with its digits permuted and all else kept; digits of any script become ASCII ones.

    An identity number with a valid check digit or letter (modulo 11, 23, 97 or Luhn) gets a valid one
    again; of a phone number the international prefix and an extension stay, so that ways of
    writing one number stay linked.
    """
    value = "".join(str(unicodedata.digit(c)) if c.isdecimal() else c for c in value)
    core = re.sub(r"(?i)\s?(?:ext\.?|x|durchwahl|poste)\s?\d+$", "", value) if kind == "phone" else value
    digits = "".join(c for c in core if c.isdecimal())
    end = ""
    if kind == "id_number":
        new, end = _identity(core, digits, key)
    else:
        keep = 0
        if core.lstrip("(").startswith("+"):
            keep = _code(digits)
        elif digits.startswith("00") and not digits.startswith("000") and len(digits) > 10:
            keep = 2 + _code(digits[2:])
        elif len(digits) == 11 and digits[0] == "1" or digits[:1] == "0" and not digits.startswith("00"):
            keep = 1
        new = digits[:keep] + _feistel(digits[keep:], key, kind)
    it = iter(new)
    out = "".join(next(it) if c.isdecimal() else c for c in core)
    if end and out[-1:].isalpha():
        out = out[:-1] + (end if out[-1].isupper() else end.lower())
    return out + value[len(core) :]


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049


def date_pseudonym(value: str, key: bytes) -> str:
    """A date of 1900 to 2099 as another one in the same format (2026-03-09, 9.3.2026, 09/03/26), by a
    keyed permutation of the days; other values stay. Dates are no personal details in the tables
    of this project, so ``redact`` uses it only where it is asked to."""
    parts = re.split(r"([-./])", value)
    if len(parts) != 5 or not all(p.isdecimal() for p in parts[::2]):
        return value
    a, b, c = parts[::2]
    year_first = len(a) == 4
    y, m, d = (a, b, c) if year_first else (c, b, a)
    try:
        day = datetime.date(int(y) + (0 if len(y) == 4 else 2000 if int(y) < 50 else 1900), int(m), int(d)).toordinal() - _FIRST_DAY
    except ValueError:
        return value
    low, high = (0, _DAYS) if len(y) == 4 else (datetime.date(1950, 1, 1).toordinal() - _FIRST_DAY, datetime.date(2050, 1, 1).toordinal() - _FIRST_DAY)
    if not low <= day < high:
        return value
    new = _feistel(f"{day:05d}", key, "date")
    while not low <= int(new) < high:
        new = _feistel(new, key, "date")
    got = datetime.date.fromordinal(_FIRST_DAY + int(new))
    year = f"{got.year:04d}"[-len(y) :]
    month, dom = f"{got.month:02d}" if len(m) == 2 else str(got.month), f"{got.day:02d}" if len(d) == 2 else str(got.day)
    first, last = (year, dom) if year_first else (dom, year)
    return f"{first}{parts[1]}{month}{parts[3]}{last}"


class Finder:
    """Finds spans of personal information in one text."""

    def __init__(self, given: Iterable[str] = ()):
        listed = {g.strip() for g in given if g and g.strip()}
        self.given = {g.lower() for g in listed}
        self.first = {t[0] for g in self.given if (t := _TOKEN.findall(g))}
        words = "|".join(sorted(map(re.escape, {g[0].upper() + g[1:] for g in listed}), key=lambda g: (-len(g), g)))
        self.full = re.compile(rf"(?<!\w)(?P<v>(?:{words})[ \t]+{_CAP})") if words else None
        self.known = re.compile(rf"(?<!\w)(?:i['’]m|i am|this is|ask for|nurse|(?:my|our|his|her) {_KIN})[ \t]+(?P<v>(?:{words})(?:[ \t]+{_ANY})?)(?!\w)", re.I) if words else None
        self.known_here = re.compile(rf"(?<!\w)(?P<v>(?:{words})[ \t]+{_ANY}|{_ANY},[ \t]+(?:{words}))(?=[ \t]+{_SPEECH}(?!\w))", re.I) if words else None

    def _names(self, text: str) -> Iterable[tuple[int, int]]:
        low = text.lower()
        tokens = set(_TOKEN.findall(low))
        patterns = [_ACTS, _CLOSED]
        if any(h in low for h in _SURE_HINTS):
            patterns.append(_NAME_SURE)
        if not _TITLES.isdisjoint(tokens):
            patterns += [_TITLED, _TITLED_LOW]
        kin = not _NOUNS.isdisjoint(tokens)
        if kin or "i'm" in low or "i’m" in low or "i am" in low or "this is" in low:
            patterns.append(_NAME_CAP)
        if self.full and not self.first.isdisjoint(tokens):
            patterns += [self.full, self.known, self.known_here]
        for pattern in patterns:
            for m in pattern.finditer(text):
                yield m.span(m.lastgroup)
        for m in _KIN_LOW.finditer(text) if kin else ():
            word = m["v"].lower()
            if word in self.given or word not in _FOLLOWS and len(word) > 2 and not _NO_LOW_NAME.search(word):
                yield m.span("v")

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Spans (start, end, type) in order, without overlaps; earlier types win."""
        taken: list[tuple[int, int, str]] = []

        def add(a: int, b: int, kind: str) -> None:
            if b > a and all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))

        digits = any(c.isdecimal() for c in text)
        if "@" in text or "＠" in text or "(at" in text.lower() or "[at" in text.lower() or "( at" in text.lower():
            for m in _EMAIL.finditer(text):
                add(*m.span(), "email")
        if digits:
            for m in _ID.finditer(text):
                if sum(c.isdigit() for c in m["v"]) >= 4:
                    add(*m.span("v"), "id_number")
            for m in _ADDRESS_DE.finditer(text):
                add(*m.span(), "address")
            for m in _ADDRESS.finditer(text):
                add(*m.span(), "address")
            for m in _ADDRESS_MINOR.finditer(text):
                add(*m.span(), "address")
            for m in _ADDRESS_CUED.finditer(text):
                add(*m.span("v"), "address")
            for m in _PHONE.finditer(text):
                v, n = m.group(), sum(c.isdigit() for c in m.group())
                before = text[max(0, m.start() - 40) : m.start()]
                if _DATE.fullmatch(v.strip()) or _NOT_PHONE.search(before):
                    continue
                if n >= 9 or _PHONE_CUE.search(before):
                    add(m.start(), m.start() + len(v.rstrip(" .-/(")), "phone")
            for m in _SSN.finditer(text):
                add(*m.span(), "id_number")
        if "f" in text or "F" in text or "h" in text:
            for m in _SPOKEN.finditer(text):
                add(*m.span(), "phone")
        for a, b in self._names(text):
            words = re.findall(r"[^\W\d_]{2,}", text[a:b])
            while words and (words[-1].lower() in _NOT_NAME or words[-1].islower() and words[0][0].isupper()):
                b = a + text[a:b].rindex(words.pop())
            if words and words[0].lower() not in _NOT_NAME and not any(w.lower() in _THING for w in words) and not _OF_THING.match(text, b):
                add(a, a + len(text[a:b].rstrip(" .,'-")), "name")
        return sorted(taken)


def redact(text: str, spans: list[tuple[int, int, str]], key: bytes, dates: bool = False) -> str:
    """``text`` with each span replaced by ``[TYPE]``, or ``[TYPE number]`` with a pseudonym; ``dates``
    also moves dates outside the spans."""
    shift = (lambda t: _DATE.sub(lambda m: date_pseudonym(m.group(), key), t)) if dates else (lambda t: t)
    out, at = [], 0
    for a, b, kind in spans:
        v = text[a:b]
        out += [shift(text[at:a]), f"[{kind.upper()} {pseudonym(v, kind, key)}]" if kind in ("phone", "id_number") and any(c.isdecimal() for c in v) else f"[{kind.upper()}]"]
        at = b
    return "".join([*out, shift(text[at:])])


def _java(pattern: str) -> str:
    """A fragment of the finder as the JVM reads it: word characters, digits and spaces of all scripts."""
    return pattern.replace(r"[^\W\d_]", r"\p{L}").replace(r"\w", r"[\p{L}\p{M}\p{N}_]").replace(r"[\w ]", r"[\p{L}\p{N}_ ]").replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\s\p{Z}]")


_JCAP = r"\p{Lu}[\p{L}\p{M}\p{N}_'’-]+"
_NO_LETTER = r"(?![\p{L}\p{M}])"
_STREETS = r"street|st|road|rd|avenue|ave|lane|ln|close|crescent|blvd|boulevard|drive|court|terrace|square|parkway|gardens|rue|av|bd|chemin|place|allée|impasse|quai|route|calle|c/|avda|avenida|plaza|paseo|camino|carretera|ronda|travesía|box|postfach|apartado|b\.p|am|an der|im|auf dem|zum|zur"
#: Cheap tests in the JVM, built from the words of the finder: what passes none of them holds nothing that it finds.
GATE = (
    r"[@＠]|\p{Nd}(?:[ .\-/() ]{0,3}\p{Nd}){3}"
    rf"|(?iu:[(\[][\s\p{{Z}}]?at[\s\p{{Z}}]?[)\]]|{_DIGIT_WORD}[\s,-]+{_DIGIT_WORD}[\s,-]+{_DIGIT_WORD}"
    rf"|{_java(_SURE)}|(?<![\p{{L}}\p{{N}}_])(?:i['’]m|i am|this is|(?:{_TITLE})\.?[ \t]+\p{{L}}|nurse|midwife|ask(?:ed|ing)? for|speak (?:to|with)|talk to|contact|{_KIN}|{_STAFF}|(?:man|woman|boy|girl|person|someone) (?:named|called)|(?:{_CLOSING}){_NO_LETTER}))"
    rf"|{_JCAP},?[ \t]+(?:\p{{Lu}}\.[\s\p{{Z}}]?)?{_JCAP}|\p{{Lu}}\.[\s\p{{Z}}]?{_JCAP},?[ \t]+(?iu:{_SPEECH})"
)
#: What an address needs besides a digit.
GATE_ADDRESS = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{_STREETS}){_NO_LETTER}|(?:str\.|straße|strasse|weg|gasse|allee|platz|damm|ufer|graben|chaussee)[\s\p{{Z}}]*\p{{Nd}}|address|adresse|anschrift|direcci[óo]n|live|living|staying|reside|move|pick|collect|send|sent|post|mail|deliver|bring|ship|forward|visit|come to|home is|wohn|habit|envoyez|viv(?:o|imos)|\p{{Nd}}[^\n]{{0,60}}{_MINOR}"


def gate(text: Column, listed: list[str] = ()) -> Column:
    """Whether a text can hold anything that the finder finds; of listed names those in other letter case
    or beside no cue need one of the words above, so the list is not looked at."""
    return text.rlike(GATE) | (text.rlike(r"\p{Nd}") & text.rlike(GATE_ADDRESS)) | (text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){_SPEECH}{_NO_LETTER}") & _any_name(text, listed))


def _any_name(text: Column, listed: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(g.lower()) for g in listed]), lambda g: F.contains(low, g)) if 0 < len(listed) <= 200 else F.lit(bool(listed))


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("types", T.ArrayType(T.StringType()))])


def given_names(names: DataFrame) -> list[str]:
    """The names of the table, refused above ``MAX_GIVEN_NAMES``."""
    got = [r.name for r in names.select("name").where(F.col("name").isNotNull()).limit(MAX_GIVEN_NAMES + 1).collect()]
    if len(got) > MAX_GIVEN_NAMES:
        raise ValueError(f"more than {MAX_GIVEN_NAMES} given names")
    return sorted(set(got))


def pii_column(text: Column, given: list[str], key: str, dates: bool = False) -> Column:
    """Struct of the redacted text and the array of types found; null where nothing is found.

    Texts that fail the gate never reach Python. The function is marked non-deterministic so that
    the optimiser does not run it a second time for a filter on its result.
    """
    if not key or not key.strip():
        raise ValueError("pseudonyms need a secret key")
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    state: dict = {}

    @F.pandas_udf(RESULT)
    def find(texts: pd.Series) -> pd.DataFrame:
        finder = state.get("finder") or state.setdefault("finder", Finder(given))
        out, types = [], []
        for t in texts:
            spans = finder.spans(t) if t else []
            out.append(redact(t, spans, secret, dates) if spans or (dates and t) else None)
            types.append(sorted({k for _, _, k in spans}))
        return pd.DataFrame({"text": out, "types": types})

    passes = gate(text, given) | text.rlike(r"\p{Nd}") if dates else gate(text, given)
    return find.asNondeterministic()(F.when((F.length(text) > 0) & passes, text))


def with_pii(df: DataFrame, text: str, names: DataFrame, key: str, dates: bool = False) -> DataFrame:
    """``df`` with ``redacted`` and ``pii_types`` for the text column ``text``.

    Every row stays; null and blank texts come back as they are with no types; columns of those
    two names that were there before are replaced. ``key`` is the secret of the pseudonyms, which the
    caller keeps: with the same key equal values stay linked from run to run. ``dates`` also
    moves dates by a keyed permutation of the days.
    """
    got = df.drop("redacted", "pii_types").withColumn("_pii", pii_column(F.col(text), given_names(names), key, dates))
    return got.select("*", F.coalesce("_pii.text", text).alias("redacted"), F.coalesce("_pii.types", F.array().cast("array<string>")).alias("pii_types")).drop("_pii")
