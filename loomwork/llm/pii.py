"""Personal information in free text: email addresses, phone numbers, identity numbers, street addresses and names, found
and replaced with typed placeholders (problem 1).

Method. Regular expressions propose spans. Checksums confirm or weaken them, each for its own kind of number: mod-97 of
French social security numbers and of bank accounts, the letter of Spanish and the last letter of Italian ones, the
elevens tests of Dutch, Portuguese and Brazilian ones, ISO 7064 of German tax numbers, Luhn of Canadian ones; a number
that Luhn or mod-97 shows to be a card or an account is no phone number. A failed checksum lowers the score also behind
a label, a passed one raises it. Words in front of and behind a span adjust its score (labels of such numbers for it;
orders, serials, grants, versions and units against it), and spans from a score of ACCEPT on are taken, the highest
first where spans overlap.

Names have no form of their own, so their words need evidence from the corpus: local parts of email addresses and words
after titles are counted, and a span of capitalized words (given names or initials with a family name, in either order)
is a name if all of its words have such evidence from at least `least_evidence` places.

Scale. The evidence is one aggregation with map-side sums. It is sent to the workers only up to BROADCAST_PARTS words;
beyond that the spans are joined to it word by word. Texts are never shuffled to find spans; only the replacement of
names in that second case joins spans back by key.

Defined cases: null, empty and blank texts have no spans and come out as they are; equal spans of a record are listed
once; repeated rows come out equal; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.6
BROADCAST_PARTS = 500_000
LEAST_EVIDENCE = 2
PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "idno": "<ID>", "address": "<ADDRESS>", "name": "<NAME>"}

_LOCAL = r"[^\W_](?:[\w.+%'-]*[^\W_])?"
_HOST = r"[^\W_](?:[\w-]*[^\W_])?"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
EMAILS = [
    re.compile(rf"(?<![\w.+%-]){_LOCAL}(?:\s?[\[({{]\s?dot\s?[\])}}]\s?{_LOCAL})*(?:\s?@\s?|\s?[\[({{]\s?at\s?[\])}}]\s?){_HOST}(?:{_DOT}{_HOST})*{_DOT}[a-zA-Z]{{2,}}(?![\w-])", re.I),
    re.compile(rf"(?<![\w.+%-])[^\W_][\w%+-]*(?:(?:\.|\sdot\s)[\w%+-]+)*\sat\s{_HOST}(?:\sdot\s{_HOST})*\sdot\s[a-z]{{2,}}(?![\w-])", re.I),
    re.compile(rf"(?<![\w.+%-])[a-z0-9][a-z0-9_%+-]*(?:\.[a-z0-9_%+-]+)* AT [a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{{2,}}(?![\w-])"),
]
_PHONE = re.compile(r"(?<![\w+/.,\-–])(?:\+|\(?(?=\d))[\d](?:[\d]|(?:\s?\(0?\)\s?)|[ ]?[(]\d{1,4}[)][ ]?|\)[ ]?|[ .\-–/ ](?=[\d(])){6,24}\d(?![\w]|[\-–/.,]\d|\)\d)")
_PHONE_FORM = re.compile(
    r"\+\d{1,3}[\s.\-–/(].*|\+\d{9,14}|00\d{2}[\s.\-–/(]?.*|\(0?\d{2,4}\)\s?\d.*|\d{3}[.\-–]\d{3}[.\-–]\d{4}|1[.\-–\s]\d{3}[.\-–\s]\d{3}[.\-–\s]\d{4}|0\d(?:[ .\-–]\d{2}){4}|0\d{2,4}[/\-–]\s?\d[\d \-–]{4,}|0\d{2,4} \d{3,4} \d{3,4}|0\d{2,3} \d{7,8}|0\d{2,3} \d{5,8}[ -]\d{1,4}"
)
_PHONE_CUE = re.compile(r"(?:tel|phone|call|fon|fax|mobile|cell|reachable at|telefon\w*|téléphone|móvil|cellulare|telemóvel|bellen|répond au|atiende en el|pelo|unter|al|via|or|oder|o|ou|of|:)[\s.:]*$", re.I)
#: Words for other numbers, close in front of a span.
_OTHER = re.compile(r"(?:order|serial|sn|invoice|no\. of|isbn|booklet|grant|notice|coordinates|values? of|build|version|release|project|ticket|part|model|art\.?|reference|ref|bestellung|bestelling|pedido|commande|encomenda|pedido interno|rechnung|seriennummer|ausgabe|catalogue|number|patent|lot|room)\s*(?:no\.?|nr\.?|#|:|n\.º)?\s*(?:\w{0,3})?$", re.I)
_UNITS = re.compile(r"^\s*(?:units|euros?|eur|usd|dollars|percent|%|kg|km|tons|pieces|einheiten|unités|unidades|unità|eenheden)\b", re.I)

#: Labels of numbers that public bodies give persons.
_ID_LABEL = re.compile(
    r"(?<![\w@])(?:social security (?:number|no\.?)|ssn|social insurance number|national id(?:entity)?(?: number| card| no\.?)?|identity card(?: number| no\.?)?|id card(?: number| no\.?)?|tax(?:payer)? id(?:entification)?(?: number| no\.?)?|tin|ni number|nino|national insurance (?:number|no\.?)|passport(?: number| no\.?)?|driver'?s? licen[cs]e(?: number| no\.?)?"
    r"|steuer-?id(?:entifikationsnummer)?|steuernummer|idnr\.?|sozialversicherungsnummer|versicherungsnummer|rentenversicherungsnummer|ausweisnummer|personalausweis(?:nummer)?|reisepass(?:nummer)?|passnummer|ahv-nummer"
    r"|numéro de sécurité sociale|n° de sécurité sociale|nir|numéro fiscal|passeport|carte d'identité|cni"
    r"|dni|nie|nif|número de la seguridad social|pasaporte|documento nacional|codice fiscale|carta d'identità|passaporto|partita|numero di previdenza"
    r"|cartão de cidadão|bilhete de identidade|passaporte|niss|número de contribuinte|cpf|bsn|burgerservicenummer|paspoort(?:nummer)?|rijbewijs(?:nummer)?|identiteitskaart|sofinummer)"
    r"\s*(?:no\.?|nr\.?|n\.º|nº|n°|number|numéro|número|numero|nummer|is|lautet|:|=|#)?\s*[:#]?\s*$",
    re.I,
)
_ID_VALUE = re.compile(r"(?:[A-Z]{2}[ ]?(?:\d{2}[ ]?){3}[A-D](?!\w)|(?:[A-Z]{1,3}[ .\-–]?)?\d(?:[ .\-–/]?\d)*(?:[ ]?[A-Z][ ]?\d{3}(?!\w)|[ ]?[A-Z]{2}\d(?!\w)|[ ][A-Z](?![\w])(?! ?[a-z])|-?[A-Z](?!\w))?)")
_SSN = re.compile(r"\d(?<![\w\-–./#]\d)\d{2}([-– ])\d{2}\1\d{4}(?![\w]|[-–/.]\w)")
_NINO = re.compile(r"(?<!\w)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?: ?\d{2}){3} ?[A-D](?!\w)|(?<!\w)QQ(?: ?\d{2}){3} ?[A-D](?!\w)")
_NIR = re.compile(r"(?<![\w.\-])[12] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?(?![\w])")
_DNI = re.compile(r"(?<![\w.\-])(?:[XYZ][- ]?\d{7}|\d{8})[- ]?[A-Z](?![\w])")
_FISCAL = re.compile(r"(?<!\w)[A-Z]{6} ?\d{2}[A-EHLMPRST]\d{2} ?[A-Z]\d{3}[A-Z](?!\w)")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_PART = r"(?:(?:de|del|della|dello|dei|degli|delle|di|da|do|dos|das|du|des|la|las|los|le|les|el|l'|d')\s)*(?:(?:l'|d'|dell'|de l')?)"
_TAIL = rf"{_PART}{_CAP}(?:\s{_PART}{_CAP}){{0,3}}"
_NO = r"\d{1,4}(?:\s?[a-zA-Z](?![\w])|[-/]\d{1,3}|-[IVX]{1,4})?"
_EN_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Way|Close|Cl|Terrace|Ter|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Crescent|Cres|Boulevard|Blvd|Row|Walk|Gardens|Gdns|Mews|Parade|Quay|Grove|Hill|Rise|Yard)"
ADDRESSES = [
    re.compile(rf"\d(?<![\w.,/-]\d)\d{{0,3}}(?:\s?[a-zA-Z](?=\s))?\s(?:[A-Z][\w'’]+\s){{1,3}}?{_EN_STREET}(?![\w])(?!\s{_EN_STREET}\b)"),
    re.compile(rf"(?<![\w-])(?:(?:Alte[rns]?|Neue[rns]?|Am|Zum|Zur|Große[rn]?|Kleine[rn]?|Obere[rn]?|Untere[rn]?|Lange[rn]?|Hohe[rn]?|[A-ZÄÖÜ][\wäöüß]+(?=\s[A-ZÄÖÜ]))\s)?[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|allee|platz|weg|gasse|ring|damm|ufer|chaussee|steig|straat|laan|plein|kade|gracht|dijk|singel|steeg|dreef|hof|pad|plantsoen)\s{_NO}(?!\s?(?:Uhr|Euro|Prozent|Monate|%))"),
    re.compile(rf"(?<![\w-])(?:[A-ZÄÖÜ][\w-]+er|[A-ZÄÖÜ][\w-]+)\s(?:Straße|Strasse|Str\.|Allee|Platz|Weg|Gasse|Ring|Damm|Ufer|Straat|Laan|Plein|Kade|Gracht|Dijk)\s{_NO}"),
    re.compile(rf"\d(?<![\w-]\d)\d{{0,3}}(?:\s?(?:bis|ter|quater)(?!\w)|\s?[a-zA-Z](?=[\s,]))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|passage|square|ruelle|faubourg)\s{_TAIL}", re.U),
    re.compile(rf"(?<![\w.-])(?:C/\s?|(?:Calle|Avda\.|Avenida|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carretera|Glorieta|Via|V\.le|Viale|Piazza|P\.za|Piazzale|Corso|Largo|Vicolo|Strada|Lungomare|Rua|R\.|Praça|Travessa|Tv\.|Estrada|Alameda|Calçada|Beco)\s){_TAIL},?\s(?:n\.?\s?[º°o]?\.?\s?|nº\s?|núm\.\s?)?{_NO}"),
]
#: What stands in front of the number of the second and third address patterns.
_ENDINGS = tuple("straße strasse str. allee platz weg gasse ring damm ufer chaussee steig straat laan plein kade gracht dijk singel steeg dreef hof pad plantsoen".split())
#: Words with which the last address pattern begins.
_BEGINNINGS = re.compile(r"(?:C/|Calle|Avda|Aven|Av\.|Pla|Pza|Pas|P\.º|Cam|Ron|Tra|Carr|Glo|V[ia]|V\.le|Pia|P\.za|Cor|Lar|Vic|Str|Lun|Rua|R\.|Pra|Tv|Est|Ala|Cal|Bec)")
#: Digits that do not follow a digit.
_NUMBER = re.compile(r"\d(?<!\d\d)")
#: Five digits or more with at most three signs between two of them: all phone and identity numbers have them.
_MANY = re.compile(r"\d(?:[ .\-–/()]{0,3}[AB]?\d){4,}")
#: Digits and capitals in turn, as in Italian codes.
_MIXED = re.compile(r"\d\d[A-EHLMPRST]\d\d")
_LONG = re.compile(r"\d(?:[ .\-–/]?\d){4,}")
_PREFIX = re.compile(r"(?<![\w])[A-Z]{1,3}[ .\-–]?$")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)")

_DIGIT = re.compile(r"\d")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:['’][A-ZÀ-ÖØ-Þa-zà-ÿ][^\W\d_]+)?")
_BETWEEN = re.compile(r"-|\s|\s(?:van|von|de|der|den|di|da|del|della|dos|du|le|la|ter|zu|VAN|VON|DE|DER|DEN|DI|DA|DEL|DELLA|DOS|DU|LE|LA|TER|ZU)(?:\s(?:der|den|la|DER|DEN|LA))?\s|\s(?:[A-ZÀ-Þ]\.\s?){1,2}")
_INITIALS = re.compile(r"(?<![\w.])(?:[A-ZÀ-Þ]\.[ -]?){1,3}(?:(?:van|von|de|der|di|da|del)\s)?$")
_AFTER_INITIALS = re.compile(r",\s(?:[A-ZÀ-Þ]\.[ -]?){1,3}")
#: Local parts that name an office, not a person.
OFFICES = ("info", "contact", "office", "sales", "support", "admin", "news", "bids", "mail", "hello", "team", "help", "service", "kontakt", "post", "jobs", "press")


#: Spaces and hyphens of typesetters.
_TYPOGRAPHIC = str.maketrans({"\u00a0": " ", "\u202f": " ", "\u2007": " ", "\u2009": " ", "\u2010": "-", "\u2011": "-"})


def folded(word: str) -> str:
    """Without case and accents."""
    word = word.lower()
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o")


# ---- validators


def luhn(digits: str) -> bool:
    if not digits.isdigit():
        return False
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(number: str) -> bool:
    """French social security number of 15 digits: its last two are 97 minus the rest modulo 97."""
    return len(number) == 15 and number.isdigit() and 97 - int(number[:13]) % 97 == int(number[13:])


def dni(number: str) -> bool:
    number = number[:1].translate(str.maketrans("XYZ", "012")) + number[1:]
    return number[:8].isdigit() and len(number) == 9 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number[:8]) % 23] == number[8]


def eleven(number: str) -> bool:
    """The elevens test of Dutch numbers."""
    return len(number) == 9 and number.isdigit() and sum(int(a) * b for a, b in zip(number, (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0


def contribuinte(number: str) -> bool:
    """Portuguese tax number and Brazilian one: weighted sums modulo 11."""
    d = [int(c) for c in number if c.isdigit()]
    if len(d) == 9:
        return (11 - sum(a * b for a, b in zip(d, range(9, 1, -1))) % 11) % 11 % 10 == d[8]
    if len(d) == 11:
        return all(sum(a * b for a, b in zip(d, range(n + 1, 1, -1))) * 10 % 11 % 10 == d[n] for n in (9, 10))
    return False


def steuer(number: str) -> bool:
    """German tax number of 11 digits: ISO 7064, modulo 11 and 10."""
    if len(number) != 11 or not number.isdigit():
        return False
    rest = 10
    for c in number[:10]:
        rest = ((rest + int(c)) % 10 or 10) * 2 % 11
    return (11 - rest) % 10 == int(number[10])


#: Values of characters at odd places of Italian codes, 0 to 9 and A to Z (fixed values).
_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21), (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def fiscale(number: str) -> bool:
    """Italian code of 16 characters: the last letter is the sum of the others' values modulo 26."""
    if len(number) != 16 or not number[15].isalpha():
        return False
    total = 0
    for i, c in enumerate(number[:15]):
        at = int(c) if c.isdigit() else ord(c) - 65
        total += (_ODD[c.isalpha()][at] if i % 2 == 0 else at) if 0 <= at < 26 else 0
    return total % 26 == ord(number[15]) - 65


def account(number: str) -> bool:
    """Bank account number: modulo 97."""
    turned = number[4:] + number[:4]
    return 15 <= len(number) <= 34 and turned.isalnum() and turned.isascii() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def bare(number: str) -> str:
    return re.sub(r"[^A-Z0-9]", "", number.upper())


def insee(number: str) -> bool:
    """mod97 with the two departments that have a letter."""
    return mod97(number.replace("2A", "19").replace("2B", "18"))


#: Checks of labelled numbers, by words of the label.
_CHECKS = (
    (re.compile(r"bsn|burgerservice|sofi", re.I), eleven),
    (re.compile(r"dni|nie(?!\w)|documento nacional", re.I), dni),
    (re.compile(r"nir(?!\w)|sécurité sociale", re.I), insee),
    (re.compile(r"nif|contribuinte|cpf", re.I), lambda n: contribuinte(n) or dni(n)),
    (re.compile(r"steuer-?id|idnr", re.I), steuer),
    (re.compile(r"codice fiscale", re.I), fiscale),
    (re.compile(r"social insurance", re.I), luhn),
)


def checked(label: str, number: str) -> bool | None:
    """Whether a number passes the checksum of its label's kind; None for kinds without one."""
    check = next((c for p, c in _CHECKS if p.search(label)), None)
    return None if check is None else bool(number) and check(number)


# ---- spans


def _digits(s: str) -> int:
    return sum(map(str.isdigit, s))


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches around numbers of five digits or more."""
    out: list[tuple[int, int]] = []
    for m in _MANY.finditer(text):
        lo, hi = max(0, m.start() - 24), min(len(text), m.end() + 24)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _phones(text: str, lo: int, hi: int) -> Iterator[tuple]:
    for m in _PHONE.finditer(text, lo, hi):
        s, start = m.group(), m.start()
        n = _digits(s)
        if not 8 <= n <= 15 or not _PHONE_FORM.fullmatch(s):
            continue
        before, after = text[max(0, start - 24) : start], text[m.end() : m.end() + 12]
        score = 0.65 + 0.2 * bool(_PHONE_CUE.search(before)) + 0.1 * (s[0] == "+") - 0.5 * bool(_OTHER.search(before)) - 0.5 * bool(_UNITS.match(after))
        # a card number in groups looks like a phone number
        if n >= 13 and s[0] != "+" and s[:2] != "00" and luhn(bare(s)):
            score -= 0.5
        yield "phone", start, m.end(), score


def _idnos(text: str, lo: int, hi: int) -> Iterator[tuple]:
    for m in _LONG.finditer(text, lo, hi):
        starts = [m.start()]
        if prefix := _PREFIX.search(text, max(0, m.start() - 4), m.start()):
            starts.append(prefix.start())
        # a label may itself end in capitals, so the number without them is tried first
        for start in starts:
            if start and text[start - 1] in " \n\t:#=(" and (label := _ID_LABEL.search(text, max(0, start - 50), start)):
                v = _ID_VALUE.match(text, start)
                if v and _digits(v.group()) >= 5 and not text[v.end() : v.end() + 1].isalnum():
                    passed = checked(label.group(), bare(v.group()))
                    yield "idno", start, v.end(), 0.98 if passed is None else 0.99 if passed else 0.83
                break
    for pattern, base, check in ((_SSN, 0.5, None), (_NINO, 0.8, None), (_NIR, 0.35, insee), (_DNI, 0.35, dni)):
        for m in pattern.finditer(text, lo, hi):
            before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 12]
            score = base - 0.5 * bool(_OTHER.search(before)) - 0.5 * bool(_UNITS.match(after))
            if check is not None:
                score += 0.4 if check(bare(m.group())) else -0.1
            if pattern is _SSN:
                score += 0.2 * (m.group(1) != " ") + 0.3 * bool(re.search(r"(?:sign|applicant|name|person|holder|employee|born|resident|phone|[^\W\d_]+ [A-ZÀ-Þ][^\W\d_]+, $)", before, re.I))
                score += 0.2 * (before.endswith("(") and after.startswith(")"))
                # groups of zeros are never given out
                score -= 0.3 * (m.group()[4:6] == "00" or m.group()[-4:] == "0000")
            yield "idno", m.start(), m.end(), score


def _numbers(text: str) -> Iterator[tuple]:
    """Spans that are made of digits, found from where digits stand."""
    windows = _windows(text)
    accounts = [m.span() for lo, hi in windows for m in _ACCOUNT.finditer(text, lo, min(len(text), hi + 20)) if account(bare(m.group()))]
    for lo, hi in windows:
        for kind, start, end, score in (*_phones(text, lo, hi), *_idnos(text, lo, hi)):
            inside = any(a <= start and end <= b for a, b in accounts)
            yield kind, start, end, score - 0.5 * inside
    if _MIXED.search(text):
        for m in _FISCAL.finditer(text):
            yield "idno", m.start(), m.end(), 0.85 if fiscale(bare(m.group())) else 0.7
    for n in _NUMBER.finditer(text):
        at = n.start()
        for pattern in (ADDRESSES[0], ADDRESSES[3]):
            if m := pattern.match(text, at):
                yield "address", m.start(), m.end(), 0.8
        if at > 5 and text[at - 1].isspace() and text[at - 12 if at > 12 else 0 : at - 1].lower().endswith(_ENDINGS):
            for pattern in ADDRESSES[1:3]:
                for m in pattern.finditer(text, max(0, at - 60), min(len(text), at + 12)):
                    yield "address", m.start(), m.end(), 0.8
        # from the first possible beginning of a street on
        if b := _BEGINNINGS.search(text, max(0, at - 80), at):
            for m in ADDRESSES[4].finditer(text, b.start(), min(len(text), at + 12)):
                yield "address", m.start(), m.end(), 0.8


def _names(text: str, known) -> Iterator[tuple]:
    """Spans of capitalized words with evidence (known(word) is true)."""
    if not any(map(known, _CAPITAL.findall(text))):
        return
    hits = [(m.start(), m.end()) for m in _CAPITAL.finditer(text) if known(m.group())]
    i = 0
    while i < len(hits):
        j, parts = i, 1
        while j + 1 < len(hits) and hits[j + 1][0] - hits[j][1] <= 12 and (sep := _BETWEEN.fullmatch(text, hits[j][1], hits[j + 1][0])):
            parts += sep.group() != "-"
            j += 1
        start, end = hits[i][0], hits[j][1]
        initials = _INITIALS.search(text, max(0, start - 14), start)
        if initials:
            yield "name", initials.start(), end, 0.85
        elif parts >= 2:
            yield "name", start, end, 0.85
        elif (m := _AFTER_INITIALS.match(text, end)) and not text[m.end() : m.end() + 1].islower():
            yield "name", start, m.end(), 0.7
        elif j + 1 < len(hits) and re.fullmatch(r",\s", text[end : hits[j + 1][0]]):
            k = j + 1
            while k + 1 < len(hits) and text[hits[k][1] : hits[k + 1][0]] in ("-", " "):
                k += 1
            if text[hits[j + 1][0] - 1].isspace() and " " not in text[hits[j + 1][0] : hits[k][1]]:
                yield "name", start, hits[k][1], 0.75
                j = k
        i = j + 1


class Known(dict):
    """Whether words have evidence, kept by word."""

    def __init__(self, folded_names: set[str]):
        self.names = folded_names

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = folded(word) in self.names
        return found


def spans(text: str, known) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, without overlaps."""
    found: list[tuple] = []
    if not text.isascii():
        text = text.translate(_TYPOGRAPHIC)  # of the same length
    lower = text.lower() if "at" in text or "AT" in text else ""
    if "@" in text or "at" in lower:
        for k, pattern in enumerate(EMAILS):
            if k == 0 and "@" not in text and not re.search(r"[\[({]\s?at", lower):
                continue
            if k == 1 and " dot " not in lower and "\ndot" not in lower:
                continue
            if k == 2 and " AT " not in text:
                continue
            for m in pattern.finditer(text):
                start = m.start() + (7 if m.group()[:7].lower() == "mailto:" else 0)
                found.append(("email", start, m.end(), 0.95))
    if _DIGIT.search(text):
        found += dict.fromkeys(_numbers(text))
    found += _names(text, known)
    taken: list[tuple[int, int, str]] = []
    for kind, start, end, _ in sorted((f for f in found if f[3] >= ACCEPT), key=lambda f: (-f[3], f[1] - f[2], f[1])):
        if not any(start < b and a < end for a, b, _ in taken):
            taken.append((start, end, kind))
    return sorted(taken)


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for start, end, kind in found:
        out += [text[last:start], PLACEHOLDERS[kind]]
        last = end
    return "".join([*out, text[last:]])


# ---- over a corpus


def evidence(docs: DataFrame, text: str = "text") -> DataFrame:
    """(part, n): words from local parts of email addresses and after titles, with the places where they stand."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    local = F.when(F.contains(t, F.lit("@")) | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)")), F.regexp_extract_all(t, F.lit(r"([\p{L}0-9][\p{L}0-9._+\-]*+)\s?(?:@|[\[(]at[\])])\s?[\p{L}0-9]"), 1)).otherwise(none)
    titled = F.regexp_extract_all(t, F.lit(r"\b(?:Dr|Herrn?|Frau|Mr|Mrs|Ms|Prof)\.? ((?:\p{Lu}[\p{L}'’]+[\- ]?){2,3})"), 1)
    words = docs.select(F.explode(F.array_distinct(F.flatten(F.transform(F.concat(local, titled), lambda x: F.split(F.lower(x), r"[^\p{L}'’]+"))))).alias("part"))
    return words.where((F.length("part") > 2) & ~F.col("part").isin(*OFFICES)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _known_parts(docs: DataFrame, text: str, least: int) -> tuple[DataFrame, set[str] | None]:
    parts = evidence(docs, text).where(F.col("n") >= least).select("part")
    few = parts.limit(BROADCAST_PARTS + 1).collect()
    return parts, {folded(r.part) for r in few} if len(few) <= BROADCAST_PARTS else None


def found_spans(docs: DataFrame, key: str = "id", text: str = "text", least_evidence: int = LEAST_EVIDENCE) -> DataFrame:
    """(key, kind, start, end, pii_text, masked) of every span. `masked` is the whole text with placeholders, on the
    first span of each text."""
    spark = docs.sparkSession
    parts, few = _known_parts(docs, text, least_evidence)
    if few is None:
        return _joined_spans(docs, parts, key, text).drop("of")
    shared = spark.sparkContext.broadcast(few)
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(shared.value).__getitem__
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"]):
                got = spans(t, known)
                for n, (start, end, what) in enumerate(got):
                    rows.append((k, what, start, end, t[start:end], mask(t, got) if n == 0 else None))
            yield pd.DataFrame(rows, columns=[key, "kind", "start", "end", "pii_text", "masked"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0).mapInPandas(scan, f"{key} {kind}, kind string, start int, end int, pii_text string, masked string")


def _joined_spans(docs: DataFrame, parts: DataFrame, key: str, text: str) -> DataFrame:
    """As found_spans, for more evidence than is sent to workers: each text's capitalized words are joined to it."""

    @F.pandas_udf("array<struct<raw:string,part:string>>")
    def capitals(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(w, folded(w)) for w in sorted(set(_CAPITAL.findall(t)))] if t else [])

    @F.pandas_udf("string")
    def fold(words: pd.Series) -> pd.Series:
        return words.map(folded)

    # a text's words with evidence come back as one small list for each text
    words = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.explode(capitals(F.col(text))).alias("w")).select("k", "h", "w.*")
    mine = words.join(parts.select(fold(F.col("part")).alias("part")).distinct(), "part", "left_semi").groupBy("k", "h").agg(F.collect_set("raw").alias("words"))
    both = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).where(F.length("t") > 0).join(mine, ["k", "h"], "left")
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, h, t, ws in zip(batch["k"], batch["h"], batch["t"], batch["words"]):
                names = set() if ws is None else set(ws)
                got = spans(t, names.__contains__)
                for n, (start, end, what) in enumerate(got):
                    rows.append((k, h, what, start, end, t[start:end], mask(t, got) if n == 0 else None))
            yield pd.DataFrame(rows, columns=[key, "of", "kind", "start", "end", "pii_text", "masked"])

    return both.select("k", "h", "t", "words").mapInPandas(scan, f"{key} {kind}, of long, kind string, start int, end int, pii_text string, masked string")


def masked(docs: DataFrame, key: str = "id", text: str = "text", least_evidence: int = LEAST_EVIDENCE) -> DataFrame:
    """`docs` with placeholders in its text and the number of each kind in `pii` (a map); null where the text is null."""
    parts, few = _known_parts(docs, text, least_evidence)
    if few is None:
        found = _joined_spans(docs, parts, key, text)
        counts = found.groupBy(F.col(key).alias("__k"), F.col("of").alias("__of"), "kind").agg(F.count(F.lit(1)).cast("int").alias("n"))
        each = counts.groupBy("__k", "__of").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("pii"))
        texts = found.where(F.col("masked").isNotNull()).select(F.col(key).alias("__k"), F.col("of").alias("__of"), F.col("masked").alias("__masked")).distinct()
        joined = docs.withColumn("__k", F.col(key)).withColumn("__of", F.xxhash64(text)).join(texts, ["__k", "__of"], "left").join(each, ["__k", "__of"], "left")
        return joined.withColumn(text, F.coalesce("__masked", text)).withColumn("pii", F.coalesce("pii", F.create_map().cast("map<string,int>"))).drop("__k", "__of", "__masked")
    shared = docs.sparkSession.sparkContext.broadcast(few)

    @F.pandas_udf("struct<text:string,pii:map<string,int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known(shared.value).__getitem__
        for texts in batches:
            rows = []
            for t in texts:
                got = spans(t, known) if t else []
                counts: dict[str, int] = {}
                for *_, kind in got:
                    counts[kind] = counts.get(kind, 0) + 1
                rows.append((mask(t, got) if got else t, counts))
            yield pd.DataFrame(rows, columns=["text", "pii"])

    return docs.withColumn("__m", scan(F.col(text))).withColumn(text, F.col("__m.text")).withColumn("pii", F.col("__m.pii")).drop("__m")
