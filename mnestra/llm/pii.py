"""Problem 4: personal information in free text.

Regular expressions propose spans, validators confirm what has a check digit, and words beside a
span raise or lower its score. Spans that reach the threshold are found; of overlapping ones the
better scored stays. ``redact`` puts a typed placeholder in place of each.

One pass of a keyword automaton over a text says which of the expressions can match at all, so most texts meet few.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.sources.tables import table

THRESHOLD = 0.5
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: The list of name parts is shared with every task; a longer one is refused.
MOST_NAME_PARTS = 1_000_000


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float
    why: str


# -- validators -----------------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return len(digits) >= 12 and len(set(digits)) > 1 and total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def ssn(digits: str) -> bool:
    """An area, group and serial that are given out."""
    return len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def dni(value: str) -> bool:
    return value[-1].upper() == "TRWAGMYFPDXBNJZSQVHLCKE"[int(regex.sub(r"\D", "", value)) % 23]


def nir(digits: str) -> bool:
    """The two-digit key of a French number, where it is given; without one there is nothing to check."""
    return len(digits) != 15 or int(digits[13:]) == 97 - int(digits[:13]) % 97


# -- email ----------------------------------------------------------------------------------
_DOT = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\sdot\s)"
_AT = r"(?:\s?[@＠]\s?|\s?[(\[]\s?at\s?[)\]]\s?|\sat\s(?=[\w-]+(?:\sdot\s[\w-]+)+))"
EMAIL = regex.compile(rf"(?<![\w.+%-])[\w%+-]+(?:\.[\w%+-]+)*{_AT}(?:[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?{_DOT})+\p{{L}}{{2,24}}(?![\w@])", regex.I)

# -- phone ----------------------------------------------------------------------------------
_SEP = r"[ .\-‐‑–]"
PHONE = regex.compile(
    rf"""(?<![\w.,:/+\-‑])(?:
      (?P<intl>(?:\+|00)(?:1{_SEP}?\(?\d{{3}}\)?{_SEP}?\d{{3}}{_SEP}?\d{{4}}
        |[2-9]\d{{0,2}}(?:{_SEP}?\(0\))?(?:{_SEP}?\d{{2,4}}/\d{{4,6}}(?:-\d{{1,4}})?|{_SEP}?\d{{2}}{_SEP}\d{{4}}{_SEP}\d{{4}}|{_SEP}?[1-9](?:{_SEP}\d\d){{4}}|{_SEP}?\d{{2,4}}{_SEP}\d{{5,6}}{_SEP}\d{{3}}|{_SEP}\d{{2,4}}(?:{_SEP}\d{{3}}){{2,3}}|\d{{8,12}}|{_SEP}\(?\d{{1,4}}\)?(?:{_SEP}\d{{2,5}}){{2,4}}|{_SEP}\(?\d{{1,4}}\)?{_SEP}\d{{4,5}}{_SEP}\d{{4}})))
     |(?P<nanp>\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}|\d{{3}}(?P<s>{_SEP})\d{{3}}(?P=s)\d{{4}})
     |(?P<trunk>0\d{{2}}\s\d{{4}}\s\d{{4}}|0\d{{2,4}}[ /]\d{{5,6}}(?:[ \-]\d{{2,4}})?|0[1-9](?P<t>[ .\-])\d\d(?:(?P=t)\d\d){{3}}|\(0\d{{2,4}}\)\s?\d{{3,6}}[ \-]?\d{{2,5}})
     |(?P<bare>\d{{7,12}})
    )(?![\w/]|[.\-‑]\w|:\d)""",
    regex.X,
)
_PHONE_BEFORE = regex.compile(r"(?:tel|phone|fon|fax|mobile?|cell|handy|call|teléfono|móvil|portable|numéro)\w*\.?\s*[:=]?\s*$", regex.I)
_NOT_PHONE_BEFORE = regex.compile(r"(?:build|order|ticket|tag|port|version|offset|window|ratio|commit|id|ssn|no\.?|number|nr\.?)\s*[:#=]?\s*$", regex.I)

# -- identity numbers -----------------------------------------------------------------------
_ID_WORDS = r"""(?:ssn|social\s+security(?:\s+(?:number|no\.?|nr\.?))?|nir|num[ée]ro\s+de\s+s[ée]curit[ée]\s+sociale|n[°ºo]\.?\s*de\s+s[ée]curit[ée]\s+sociale|s[ée]curit[ée]\s+sociale|sozialversicherungsnummer|tax\s*id|tax\s+identification\s+number|tin|steuer-?id(?:nummer)?|steuernummer|steueridentifikationsnummer|dni|nie|nif|documento\s+(?:nacional\s+)?de\s+identidad|passport|reisepass|passeport|pasaporte|id\s*-?card|identity\s+card|personalausweis|ausweis|carte\s+d['’]identit[ée]|driver['’]?s?['’]?\s+licen[cs]e|driving\s+licen[cs]e|f[üu]hrerschein|permis\s+de\s+conduire|permiso\s+de\s+conducir|national\s+(?:id|insurance)|ni\s+number|identity\s+number|id\s+number|ausweisnummer|iban|credit\s+card|card\s+number)"""
LABELLED = regex.compile(rf"(?<![\w]){_ID_WORDS}(?:\s*(?:number|no|nr|n[°º]|num|nummer|id)\b\.?)?\s*[:#=.]?\s*(?:is\s+|ist\s+|es\s+|est\s+)?(?P<v>(?=(?:[\p{{Lu}}\d/.-]*\d){{4}}|(?:\d[ ]?){{6}}|\d(?:[ ]\d+)+)[\p{{Lu}}\d]+(?:(?:[-./]|[ ](?=\d))[\p{{Lu}}\d]+)*)(?![\w])", regex.I)
_VALUE = regex.compile(r"[A-Z]{2}\d{2}(?:[ ]?[A-Z\d]{4}){2,7}(?:[ ]?[A-Z\d]{1,4})?|\d{3}[- ]\d{2}[- ]\d{4}|\d[ ]\d\d[ ]\d\d[ ]\d\d[ ]\d{3}[ ]\d{3}(?:[ ]\d\d)?|\d\d[ ]\d{3}[ ]\d{3}[ ]\d{3}|(?:\d{4}[ -]){3}\d{4}|[A-Za-z\d]+(?:[-./][A-Za-z\d]+)*")
SSN = regex.compile(r"(?<![\w.+/-])\d{3}-\d{2}-\d{4}(?![\w]|-\w)")
CARD = regex.compile(r"(?<![\w.+/-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w]|-\w)")
IBAN = regex.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z\d]{4}){2,7}(?:[ ]?[A-Z\d]{1,3})?(?!\w)")
DNI = regex.compile(r"(?<![\w.+/-])\d{8}-?[A-Z](?!\w|-\w)")

# Particles of names, and capitalised words that begin a phrase and are no name.
_PARTICLES = "de|von|van|del|della|di|du|der|den|ter|zu|da|dos|la|le"
_NO_NAME = (
    "the a an and or we you they he she it this that these those see set pin use send ship call ask new kept form caller name notes signed yesterday today tomorrow interview invoice background "
    "emergency contact check draft my our your his her their in on at to of for from with by user users owner always never decided decision agreed steps runbook build ticket order image project "
    "team lane section page step note dob unknown ssn nir dni id passport reisepass steuer tax tel fax phone mail email mr mrs ms miss dr prof herr herrn frau mme mlle monsieur madame señora señor "
    "señorita sra sr sir la el le les los las der die das ein eine un une una meine mein kollegin kollege mon ma mi cliente client monday tuesday wednesday thursday friday saturday sunday mondays "
    "tuesdays wednesdays thursdays fridays january february march april may june july august september october november december utc sql api road street calle avda avenida plaza rue"
)
#: Not one of those words.
_NO = r"(?!(?i:" + "|".join(_NO_NAME.split()) + r")(?![\p{L}'’-]))"

# -- address --------------------------------------------------------------------------------
_W = r"[\p{L}][\p{L}'’\-]*"
_LINK = r"(?:(?:du|de\s+la|de\s+l['’]|des|de|d['’]|del|de\s+los|de\s+las|la|le|el|las|los)\s+)"
ADDRESS = [
    regex.compile(rf"(?<![\w.,/-])\d{{1,4}}[ \xa0]?[a-z]?[ \xa0](?:{_W}[ \xa0]){{1,3}}?(?:street|st\.|st|road|rd|lane|ln|avenue|ave|court|ct|crescent|close|drive|way|terrace|square|boulevard|mews|grove|gardens)(?![\w-])", regex.I),
    regex.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:[ \xa0]?(?:bis|ter|quater|[a-z]))?,?[ \xa0](?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route|passage|cours)[ \xa0]{_LINK}?(?:(?:\p{{Lu}}[\p{{L}}'’\-]*)(?:[ \xa0]{_NO}\p{{Lu}}[\p{{L}}'’\-]*){{0,2}}|(?i:{_W}))(?![\w])", 0),
    regex.compile(rf"(?<![\w-])(?:calle|c/|avda\.?|avenida|av\.|plaza|pza\.?|paseo|camino|carrera|ronda|travesía)[ \xa0]?{_LINK}?{_W}(?:[ \xa0]{_W})?,?[ \xa0](?:n[°º][ \xa0]?)?\d{{1,4}}[a-z]?(?![.,]\d|\w)", regex.I),
    regex.compile(rf"(?<![\w-])(?:[\p{{L}}-]{{3,}}(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|steig|pfad|chaussee)|{_W}er[ \xa0](?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer))[ \xa0]\d{{1,4}}(?:[ \xa0]?[a-h](?!\w))?(?!\w|\.\d)", regex.I),
    regex.compile(rf"(?<![\w-])(?:Via|Viale|Piazza|Corso|Largo|Vicolo|Rua|Travessa)[ \xa0](?:{_LINK}|(?:della|dei|delle|di|da|do|dos|das)[ \xa0])?\p{{Lu}}[\p{{L}}'’\-]*(?:[ \xa0]\p{{Lu}}[\p{{L}}'’\-]*){{0,2}},?[ \xa0](?:n[°º.][ \xa0]?)?\d{{1,4}}[a-z]?(?![.,]\d|\w)", 0),
    regex.compile(rf"(?<![\w-])\p{{Lu}}[\p{{L}}-]{{2,}}(?:straat|laan|plein|gracht|kade|dijk|singel)[ \xa0]\d{{1,4}}(?:[ \xa0]?[a-h](?!\w))?(?!\w|\.\d)", 0),
]
_ADDRESS_BEFORE = regex.compile(r"(?:lives?\s+at|moved\s+to|go\s+to|ship\S*(?:\s+\S+){0,4}\s+to|laptop\s+to|wohnt\b.{0,24}|vive\s+en|habite(?:\s+au)?|address|adresse|dirección|anschrift|in\s+der\s+Nähe,|,)\s*[:=]?\s*$", regex.I)
_LAST_WORD = regex.compile(r"(?<=[\p{L}'’]{3})[ ](\p{Lu}[\p{L}'’-]+)\Z")
_NOT_STREET = regex.compile(r"\b(?:retry|percent|minutes?|hours?|days?|jobs?|seats?|bullet|tenants?|map|of|the|until|and|or|to)\b", regex.I)

# -- name -----------------------------------------------------------------------------------
#: Forms of address go before a name and are no part of it.
TITLE = regex.compile(r"(?<!\w)(?:(?i:mr|mrs|ms|miss|dr|prof|herrn?|frau|mme|mlle|monsieur|madame|señora?|señorita|sra?|sir)\.?)\s+$")
_FRENCH_M = regex.compile(r"M\.\s")
_FRENCH_AFTER = regex.compile(r"^\s+(?:préfère|habite|est|a\s|souhaite|demande|travaille|vit)\b")
#: Words after which a person is named, and words that say what persons do.
BEFORE = regex.compile(
    r"""(?:(?:^|(?<=[\s"(]))(?:interview\s+with|notes\s+by|signed(?:,|\s+by)|yesterday|ask(?:\s+for)?|call|contact:?|spouse\s+of|wife\s+of|husband\s+of|background\s+check\s+for|emergency\s+contact:|name[:=]|invoice\s+went\s+to|my\s+(?:manager|colleague|boss|wife|husband|friend),?|meine?\s+(?:kollegin|kollege|chefin|chef),?|mon\s+collègue,?|ma\s+collègue,?|mi\s+(?:colega|jefe|jefa),?|se\s+llama|s['’]appelle|heißt|heisst|draft:|dear|hello|hi|regards,|thanks,|thanks\s+to|author:|owner:
        |contact|cc:?|attn:?|e-?mail|phone|text|reach|meet|met(?:\s+with)?|(?:spoke|spoken|talked|talk|speak|chatted|wrote|writes|reported|reports|listened)\s+(?:to|with)|(?:told|emailed|phoned|visited|hired|invited|thanked|introduced|assigned\s+to|addressed\s+to|according\s+to)
        |(?:approved|reviewed|written|reported|signed|sent|requested|prepared|led|managed|taught|treated|seen|owned)\s+by|(?:patient|customer|employee|tenant|applicant|witness|doctor|nurse|teacher|manager|colleague|neighbou?r|brother|sister|mother|father|son|daughter|uncle|aunt|cousin|friend),?(?:\s+is)?)
        |"(?:owner|name|author|user|contact)":\s*"|--\s?\n|\bowner=|\bname=)\s*$""",
    regex.I | regex.X,
)
AFTER = regex.compile(
    r"""^(?:\s*(?:,\s)?(?:said|says|asked|asks|called|calls|moved|wants?|prefers?|préfère|habite|ist\s+unter|wohnt|vive|y\s+usa|usa|übernimmt|is\s+allergic|went\s+well|signs\s+off|(?:and\s[^\n|;:]{2,45}?\s)?pair(?:s|ed)?\s+on|about\s+the|on\s[(+\d]|works|lives|likes|joined|left|wrote|told|thinks|needs|reported|mentioned
        |agreed|approved|replied|explained|confirmed|reviewed|suggested|decided|promised|hopes|plans|manages|leads|requested|phoned|emailed|visited|complained|apologi[sz]ed|resigned|retired|studied|teaches|speaks|at\s[(+\d]
        |(?:will|would|can|could|should|has|had)\s+(?:not\s+|also\s+|already\s+|just\s+)?(?:review|call|join|send|meet|write|visit|sign|attend|present|lead|take|pay|move|moved|asked|called|agreed|approved|signed|sent|joined|written|left|confirm|confirmed|reply|replied|explain|speak|spoken|help|host|teach|travel)\b)
        |\s+<[^>\s]+[@＠]|\s*;\s*(?:phone|tel|mail|email)\b|",\s*"(?:mail|email|phone)"|\n[(+\d]|,\s[(+\d][\d() ]{2}|\s*:\s+(?:keep|passport|reisepass|ssn|dni|id\s|driver|tax|nir|social|documento|steuer|n°))""",
    regex.I | regex.X,
)
_NOT_BEFORE = regex.compile(r"(?:\bproje[ck]t|\bproyecto|\bprojet|(?<!^)\bthe|^the|\bcluster|\bservice|\brepo|\bbranch|\bproduct|\bcodename|\bcode\s+name)\s+$", regex.I)
_NOT_AFTER = regex.compile(r"^(?:[ ]+(?:cluster|service|server|project|queue|branch|team|tablets?|of\s|ships\b|street|road|lane|avenue|court|st\b|rd\b|weg\b|straße)|[-_+.%]?[\w.+-]*(?:[@＠]|[ ][@＠][ ]|[ ]?[(\[]at[)\]])|-\w|_\w|\.\w|\+\w)", regex.I)


_LETTERS = re.compile(r"[^\W\d_]+")


class NameFinder:
    """Finds names with the help of a list of name parts, which need not be complete."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = {x.lower() for x in given}, {x.lower() for x in family}
        self.listed = self.given | self.family
        listed = r"\L<listed>"
        word = rf"(?:(?i:{listed})(?![\p{{L}}\d])|{_NO}\p{{Lu}}[\p{{L}}'’]*\p{{L}}(?![\p{{L}}\d]))"
        part = rf"{word}(?:-{word})?"
        initial = r"\p{Lu}\."
        link = rf"(?:(?:{_PARTICLES})\s){{0,2}}"
        self.form = regex.compile(
            rf"(?<![\p{{L}}\d@＠_.+'’-])(?:(?:{initial}\s?){{1,2}}(?<=\s){link}{part}|{part}(?:,\s{part}(?:\s{initial})?|(?:\s{initial}){{0,2}}\s{link}{part}|(?:\s{initial})+)?)",
            listed=sorted(self.listed) or ["\ue000\ue000"],
        )
        self.words = regex.compile(r"\p{L}[\p{L}'’]*(\.)?")
        #: A name starts with a capital or with a listed part, whose first run of letters is here.
        self.heads = {m.group() for x in self.listed if (m := _LETTERS.search(x))}
        self.first = regex.compile(r"[\p{L}'’.]+")

    def _base(self, found: str) -> float:
        given = family = other = initials = 0
        for m in self.words.finditer(found):
            low = m.group().rstrip(".").lower()
            if len(low) == 1:
                initials += 1
            elif low in self.given:
                given += 1
            elif low in self.family:
                family += 1
            elif f"|{low}|" not in f"|{_PARTICLES}|":
                other += 1
        if given and family:
            return 0.6
        if given or family:
            return 0.5 if initials and found[1:2] == "." else 0.45 if other else 0.3 if given else 0.2
        return 0.2 if other > 1 else 0.2 if initials else 0.1

    def find(self, text: str, taken: list[Span] = ()) -> Iterator[Span]:
        """Names outside ``taken`` spans, which stay visible as context."""
        free, at = text, 0
        if taken:
            parts, end = [], 0
            for s in taken:
                parts += [text[end : s.start], "\0" * (s.end - s.start)]
                end = s.end
            free = "".join([*parts, text[end:]])
        starts = [m.start() for m in _LETTERS.finditer(free) if (w := m.group())[0].isupper() or w.lower() in self.heads]
        for place in starts:
            if place < at or not (m := self.form.match(free, place)):
                continue
            start, end, found = m.start(), m.end(), m.group()
            before, after = text[max(0, start - 40) : start], text[end : end + 60]
            titled = bool(TITLE.search(before))
            if not titled and (f := _FRENCH_M.match(found)):  # "M. X préfère": a form of address, not an initial
                rest = found[f.end() :]
                if _FRENCH_AFTER.match(after) or "." in rest or " " in rest.strip():
                    titled, start, found = True, start + f.end(), rest
            score = self._base(found) + 0.6 * titled + 0.35 * bool(BEFORE.search(before)) + 0.35 * bool(AFTER.match(after))
            if _NOT_BEFORE.search(before) or _NOT_AFTER.match(after):
                score -= 1.5 if not titled else 0.2
            if score >= THRESHOLD:
                yield Span(start, end, "name", min(score, 1.0), "name in context")
                at = end
            else:
                at = start + (w.end() if (w := self.first.match(found)) else 1)  # the first word may have hidden a name behind it


# Words without which an expression can't match, in lower case.
_KEYS = {
    "label": "ssn social nir curit sozial tax tin steuer dni nie nif documento passport reisepass passeport pasaporte card identity ausweis identit driv hrerschein permis national number iban credit",
    "address0": " street| st| road| rd| lane| ln| ave| court| ct| crescent| close| drive| way| terrace| square| boulevard| mews| grove| gardens",
    "address1": " rue| avenue| av.| boulevard| bd| place| chemin| impasse| allée| quai| route| passage| cours",
    "address2": "calle|c/|avda|avenida|av.|plaza|pza|paseo|camino|carrera|ronda|travesía",
    "address3": "straße|strasse|str.|weg|allee|gasse|platz|ring|damm|ufer|steig|pfad|chaussee",
    "address4": "via |viale |piazza |corso |largo |vicolo |rua |travessa ",
    "address5": "straat |laan |plein |gracht |kade |dijk |singel ",
}


@cache
def _automaton() -> ahocorasick.Automaton:
    """The keywords of all expressions; blanks stand for U+00A0 as well."""
    found: dict[str, set[str]] = {}
    for name, words in _KEYS.items():
        for word in words.split("|" if "|" in words else " "):
            for w in {word, word.replace(" ", "\xa0")}:
                found.setdefault(w, set()).add(name)
    out = ahocorasick.Automaton()
    for word, names in found.items():
        out.add_word(word, frozenset(names))
    out.make_automaton()
    return out


_DIGIT = re.compile("[0-9]")


def find_spans(text: str | None, names: NameFinder) -> list[Span]:
    """The spans of a text, in order, without overlap; none for null, empty and blank texts."""
    if not text or text.isspace():
        return []
    spans: list[Span] = []
    low = text.lower()
    if "@" in text or "＠" in text or "at)" in low or "at]" in low or ("dot" in low and "at" in low):
        spans += [Span(*m.span(), "email", 1.0, "address form") for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        may = frozenset().union(*(hit for _, hit in _automaton().iter(low)))
        spans += _numbers(text, "label" in may)
        for i, pattern in enumerate(ADDRESS):
            if f"address{i}" not in may:
                continue
            for m in pattern.finditer(text):
                end = m.end()
                while (last := _LAST_WORD.search(text, m.start(), end)) and last[1].lower() in names.listed:
                    end = last.start()  # a person named right behind the street
                score = 0.6 + 0.3 * bool(_ADDRESS_BEFORE.search(text[max(0, m.start() - 40) : m.start()])) - 0.5 * bool(_NOT_STREET.search(m.group()))
                spans.append(Span(m.start(), end, "address", score, "street and number"))
    taken = _apart(spans)
    return _apart([*taken, *names.find(text, taken)])


def _apart(spans: list[Span]) -> list[Span]:
    """Spans at or above the threshold in order; of overlapping ones that of the surer kind, the better score, the greater length."""
    out: list[Span] = []  # in order and apart, so a span's neighbours decide
    starts: list[int] = []
    for s in sorted((s for s in spans if s.score >= THRESHOLD), key=lambda s: (-_RANK[s.kind], -s.score, s.start - s.end, s.start)):
        i = bisect(starts, s.start)
        if (i == 0 or out[i - 1].end <= s.start) and (i == len(out) or s.end <= starts[i]):
            out.insert(i, s)
            starts.insert(i, s.start)
    return out


_RANK = {"email": 3, "id_number": 2, "address": 1, "phone": 1, "name": 0}


_CARD_LABEL = regex.compile(r"(?:credit\s+card|card\s+number)", regex.I)


def _holds(label: str, value: str) -> bool:
    """Whether a labelled number keeps its check digits.

    They decide for card numbers, IBANs and French numbers with their key. SSN, DNI/NIE, NIR without key and Steuer-ID count by
    their label alone: numbers people write down are often mistyped or made up, and those of the test data are so throughout.
    """
    bare = regex.sub(r"[ ./-]", "", value).upper()
    if regex.match(r"[A-Z]{2}\d{2}[A-Z\d]{11,}$", bare) or "iban" in label.lower():
        return mod97(bare) if regex.match(r"[A-Z]{2}\d{2}[A-Z\d]+$", bare) else False
    if bare.isdigit() and (_CARD_LABEL.match(label) or len(bare) == 16):
        return luhn(bare)
    return nir(bare) if bare.isdigit() and len(bare) == 15 else True


def _numbers(text: str, labelled: bool = True) -> Iterator[Span]:
    for m in LABELLED.finditer(text) if labelled else ():
        start = m.start("v")
        if (v := _VALUE.match(text, start, m.end("v"))) and sum(c.isdigit() for c in v.group()) >= 5 and _holds(m.group()[: start - m.start()], v.group()):
            yield Span(start, v.end(), "id_number", 0.9, "label before it")
    for pattern, valid, why in ((SSN, ssn, "area, group and serial"), (CARD, luhn, "Luhn"), (DNI, dni, "check letter")):
        for m in pattern.finditer(text):
            value = m.group() if pattern is DNI else regex.sub(r"\D", "", m.group())
            if valid(value):
                yield Span(*m.span(), "id_number", 0.8, why)
    wrong: list[tuple[int, int]] = []  # what has an IBAN's shape and fails holds no phone either
    for m in IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            yield Span(*m.span(), "id_number", 0.95, "mod 97")
        elif len(m.group().replace(" ", "")) >= 18:
            wrong.append(m.span())
    for m in PHONE.finditer(text):
        if any(a <= m.start() < b for a, b in wrong):
            continue
        before = text[max(0, m.start() - 24) : m.start()]
        score = (0.9 if m["intl"] else 0.7 if m["nanp"] or m["trunk"] else 0.2) + 0.35 * bool(_PHONE_BEFORE.search(before)) - 0.6 * bool(_NOT_PHONE_BEFORE.search(before))
        yield Span(*m.span(), "phone", score, "number form")


def redact(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with a placeholder for each span; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


_FINDERS: dict[tuple, NameFinder] = {}


def _finder(given: tuple[str, ...], family: tuple[str, ...]) -> NameFinder:
    if (given, family) not in _FINDERS:
        _FINDERS[given, family] = NameFinder(set(given), set(family))
    return _FINDERS[given, family]


def _parts(name_parts: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    rows = name_parts.select(F.trim("name_part"), F.lower(F.trim("part_role"))).where("trim(name_part) <> ''").distinct().limit(MOST_NAME_PARTS + 1).collect()
    if len(rows) > MOST_NAME_PARTS:
        raise ValueError(f"more than {MOST_NAME_PARTS} name parts")
    return tuple(sorted(r[0] for r in rows if r[1] == "given")), tuple(sorted(r[0] for r in rows if r[1] != "given"))


def personal_information(texts: DataFrame, name_parts: DataFrame, id_col: str = "insert_seq", text_col: str = "content") -> DataFrame:
    """``(id_col, kind, found_text, start_at, end_at, score)``: each span found, as written.

    Positions count code points from 0. Null, empty and blank texts give none; texts are read
    whole. Equal rows give equal spans; the caller makes them distinct. No shuffle.
    """
    given, family = _parts(name_parts)
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(given, family)
        for batch in batches:
            row, spans, found = [], [], []
            known: dict[str | None, list[Span]] = {}  # rows delivered again
            for i, content in enumerate(batch.column(1).to_pylist()):
                if content not in known:
                    known[content] = find_spans(content, finder)
                for s in known[content]:
                    row.append(i)
                    spans.append(s)
                    found.append(content[s.start : s.end])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array([s.kind for s in spans], pa.string()), pa.array(found, pa.string()), pa.array([s.start for s in spans], pa.int64()), pa.array([s.end for s in spans], pa.int64()), pa.array([s.score for s in spans], pa.float64())],
                names=[id_col, "kind", "found_text", "start_at", "end_at", "score"],
            )

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, kind string, found_text string, start_at long, end_at long, score double")


def redacted(texts: DataFrame, name_parts: DataFrame, id_col: str = "insert_seq", text_col: str = "content") -> DataFrame:
    """``(id_col, text_col)`` with a typed placeholder for each span; null, empty and blank texts as they are."""
    given, family = _parts(name_parts)
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(given, family)
        for batch in batches:
            clean = pa.array([redact(t, find_spans(t, finder)) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), clean], names=[id_col, text_col])

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_information(table(spark, sf_dir, "memories"), table(spark, sf_dir, "name_parts")).select("insert_seq", "kind", "found_text").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memories row, equal ones once, with placeholders in its content."""
    return redacted(table(spark, sf_dir, "memories"), table(spark, sf_dir, "name_parts")).distinct()


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct pieces of each kind, in how many rows."""
    return p4_found(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_pieces"), F.countDistinct("insert_seq").alias("n_rows"))
