"""Surrogates for personal data: keyed, consistent with type, gender, script and format, and distinct.

Detected entities (mail addresses, phone numbers with a country code or in usual national layouts, IP addresses of both kinds,
card and account numbers, passport numbers after that word, secrets: known forms, keys of 40 mixed characters, and what is assigned to a
password or key, of any length behind an equals sign or in quotes, behind a bare colon with a digit or at least six characters; names
after a title or a phrase such as "my name is", full ones after a salutation, in any script with capitals) are brought to one spelling (secrets keep theirs, as their letter case counts); a keyed hash of type, spelling and
gender gives the surrogate, written in the format of each place where the entity stands: separators, letter case, number of
digits, script; a country's calling code, valid check digits of cards and accounts and particles of names stay; domains end in .example.

The same entity gets the same surrogate in every document (coreference). Within a document, a shorter name is taken for the
longer one that it ends ("Mr Smith" after "Mr John Smith") if their genders agree, a title without a gender takes the gender that the
same name has elsewhere, and words of a name that stand without a title, spelled alike or in capitals, are replaced by their
part of the surrogate. Across documents a name is told apart by its spelling and gender, so Mr and Mrs Smith are two people.

Two entities never share a surrogate, and none is an entity of the corpus itself (distinctness): all entities are gathered
once each, surrogates that collide are found by grouping and joining them, and those entities move to a further draw until none
collides. Invented names are long enough that few collide. Where a format is too narrow for its entities (short passwords, say),
draws beyond the ``IN_FORMAT``-th are a sign longer each, so distinctness goes before length and the draws end. Mail domains are entities of their own, so addresses of two domains never meet. The moved ones are joined to the
texts that hold them by the hash of the text, so doc_id isn't read and may be of any type, null or repeated. A mention without a title in
a document that has no title for that name stays, and so does a name that a street bears. Texts
are searched twice, for entities and for replacement: their places aren't kept, since that would mean either to shuffle every text or
to write a second copy of the personal data.

Null texts stay null, empty ones empty; texts are searched whole; repeated rows are rewritten alike; an empty table gives no
rows. Other columns stay as they are, but for one called n_entities, whose place the count takes.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

#: Entries about moved entities that may be broadcast to the texts that hold them; more are joined as Spark sees fit.
MOST_BROADCAST = 200_000
#: Draws that keep an entity's length, and draws at most.
IN_FORMAT, MOST_DRAWS = 6, 40
#: Titles by gender (fixed values).
MALE = ["Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Don", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Doña", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof", "Professor"]
#: Consonants and vowels that invented names are made of, by script (fixed values).
SCRIPTS = {"latin": ("bdfglmnprstv", "aeiou"), "cyrillic": ("бвгдлмнпрст", "аеиоу"), "greek": ("βγδλμνπρστ", "αεηιου"), "armenian": ("բգդզլմնպրստ", "աեիո")}
#: Lower-case words inside names, which stay as they are (fixed values).
PARTICLES = ["von", "van", "der", "den", "de", "la", "le", "di", "da", "del", "dos", "bin", "ibn", "al", "el", "zu"]
#: What a name follows where it has no title (fixed values).
CUES = ["my name is", "full name:", "signed by", "contact person:", "attn:", "mein Name ist", "ich heiße", "je m'appelle", "je m’appelle", "me llamo", "mi nombre es"]
#: What a full name follows in letters, and what follows a name that a street bears (fixed values).
SALUTATIONS = ["dear", "his name is", "her name is", "their name is", "kind regards,", "best regards,", "sincerely,", "yours,"]
STREETS = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Square", "Boulevard", "Blvd", "Drive", "Court", "Bridge", "Station", "Straße", "Strasse", "Platz"]
#: Calling codes of two digits; those of 1 and 7 have one, all others three (fixed values).
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_TITLES = "|".join(sorted(map(re.escape, MALE + FEMALE + NEUTRAL), key=len, reverse=True))


def _characters(*categories: str) -> str:
    """The characters of these Unicode categories, as ranges for a regular expression's class."""
    points = [c for c in range(0x20000) if unicodedata.category(chr(c)) in categories]
    starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
    ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


_UPPER, _INSIDE = _characters("Lu", "Lt"), _characters("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc")
_NAME = f"[{_UPPER}](?:[{_INSIDE}]+|(?=['’][{_UPPER}][{_INSIDE}]))(?:[-'’][{_UPPER}][{_INSIDE}]+)?(?![{_INSIDE}])"
PATTERNS = {
    "mail": r"(?<![\w.%+-])[\w.%+-]*\w@[\w-]+(?:\.[\w-]+)*\.\w{2,}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<!\w)(?<!\d\.)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)",
    "ip": r"(?<!\w)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+(?=(?:[ .()-]{0,2}\d){7,15}(?![ .-]?\d))\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,7}(?!\w)"
    r"|(?<![\w+])(?<!\d[.,-])(?:0\d{2,4}[ ./-]\d{3,4}[ -]?\d{3,4}|\(0\d{1,4}\)[ -]?\d{3,4}[ -]?\d{3,4}|0\d[ -]\d{4}[ -]\d{4}|0\d(?P<gap>[ .-])\d\d(?:(?P=gap)\d\d){3}|0\d{9,10}|[2-9]\d\d[2-9]\d{6})(?![\w]|[.,]\d)",
    "secret": r"(?<!\w)(?:eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|(?=[A-Za-z0-9/+]{40}(?![\w/+=]))(?<![/+=])(?=[A-Za-z0-9/+]{0,39}\d)(?=[A-Za-z0-9/+]{0,39}[a-z])(?=[A-Za-z0-9/+]{0,39}[A-Z])[A-Za-z0-9/+]{40}|AKIA[0-9A-Z]{16}|(?:sk-|ghp_|xox[bp]-)(?=[A-Za-z-]*\d)[A-Za-z0-9-]{20,}|(?=[a-fA-F]*\d)[0-9a-fA-F]{32,})(?!\w)",
}
FINDER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
_WORD = rf"(?:{_NAME}|[{_UPPER}]\.(?= [{_UPPER}]))"
_FULL = rf"{_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}(?!(?:{_TITLES})\b){_WORD})*"
TITLED = re.compile(rf"(?P<title>{_TITLES})\.?(?:[ \t\u00a0]{{1,3}}|\n)(?P<who>{_FULL})")
CUED = re.compile(rf"(?<!\w)(?i:{"|".join(map(re.escape, CUES))})[ \t\u00a0]{{1,3}}(?!(?:{_TITLES})\b)(?P<who>{_FULL})")
GREETED = re.compile(rf"(?<!\w)(?i:{'|'.join(map(re.escape, SALUTATIONS))})\s{{1,3}}(?!(?:{_TITLES})\b)(?P<who>{_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}(?!(?:{_TITLES})\b){_WORD})+)")
_LOW_CUES = [c.lower() for c in CUES]
LONE = re.compile(rf"(?<![{_INSIDE}]){_NAME}(?! (?:{'|'.join(map(re.escape, STREETS))})\b)")
PASSPORTS = ["passport", "passeport", "pasaporte", "reisepass"]
PASSPORT = re.compile(rf"(?i:{'|'.join(PASSPORTS)})\W{{1,3}}(?:(?i:number|num|no|nr)\W{{1,3}})?(?P<who>[A-Z]{{1,2}}\d{{6,8}})(?!\w)")
#: Whatever may be an IPv6 address; ``ipaddress`` decides.
IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*(?:(?:\.\d{1,3}){3})?(?<!(?<!:):)(?!\w)")
#: What stands before and after the sign of an assignment, whatever the blanks; a line end may follow the sign.
SECRET_NAME = re.compile(r"(?i:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key)[\"']?$")
ASSIGNMENT = re.compile("[=:]")
ASSIGNED = re.compile(r"""[=:]=?(?:[^\S\r\n]*|\s{0,3})(?:"(?P<double>[^"\r\n]+)"|'(?P<single>[^'\r\n]+)'|(?P<bare>[^\s"',;]*[^\W_]))""")
_BARE = re.compile(r"(?=.*\d)|.{6}", re.DOTALL)
#: All but names and assigned secrets hold a digit or an at sign, so only what lies around these is searched.
SIGN, REACH = re.compile(r"[\d@]+"), 140


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and at signs, from white space to white space."""
    start = end = -1
    for m in SIGN.finditer(text):
        if m.end() + REACH <= end:
            continue
        if start >= 0 and m.start() - REACH > end:
            yield start, end
            start = -1
        if start < 0:
            start = max(0, m.start() - REACH)
            while start and not text[start - 1].isspace():
                start -= 1
        end = min(len(text), m.end() + REACH)
        while end < len(text) and not text[end].isspace():
            end += 1
    if start >= 0:
        yield start, end


def _ip6(text: str) -> str | None:
    """The one spelling of an IPv6 address; None if it isn't one, or too short to be told from other text (``a::b``)."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    groups = [g for g in text.split(":") if g]
    return str(address) if len(groups) > 3 or (groups and any(c.isdigit() for c in text)) else None


def _spelling(kind: str, x: str) -> str:
    if kind in ("ip", "secret"):
        return x
    return x.casefold() if kind == "mail" else ("+" if kind == "phone" and x[0] == "+" else "") + re.sub(r"[\W_]", "", x).casefold()


def _folded(word: str) -> str:
    return unicodedata.normalize("NFC", word.casefold())


def _people(text: str, low: str) -> list[tuple[int, int, str, str, str]]:
    """Names after a title or cue, and the places where their words stand alone."""
    titled = []
    for m in TITLED.finditer(text):
        if not (m.start() and text[m.start() - 1].isalnum()):
            titled.append((*m.span("who"), _folded(m["who"]), "m" if m["title"] in MALE else "f" if m["title"] in FEMALE else ""))
    if any(c in low for c in _LOW_CUES):
        places = {t[0] for t in titled}
        titled = sorted(titled + [(*m.span("who"), _folded(m["who"]), "") for m in CUED.finditer(text) if m.start("who") not in places])
    if any(c in low for c in SALUTATIONS):
        places = {t[0] for t in titled}
        titled = sorted(titled + [(*m.span("who"), _folded(m["who"]), "") for m in GREETED.finditer(text) if m.start("who") not in places])
    if not titled:
        return []
    # The first longer name that ends in a word, by gender; the first gender of a spelling.
    longer: dict[tuple[str, str], str] = {}
    gendered: dict[str, str] = {}
    for _, _, name, gender in titled:
        if " " in name:
            longer.setdefault((name.rpartition(" ")[2], gender), name)
        if gender:
            gendered.setdefault(name, gender)

    def person(name: str, gender: str) -> tuple[str, str]:
        for g in (gender, "") if gender else ("", "m", "f"):
            full = longer.get((name, g))
            if full is not None:
                name, gender = full, gender or g
                break
        return name, gender or gendered.get(name, "")

    out, words = [], {}
    for start, end, name, gender in titled:
        full, gender = person(name, gender)
        out.append((start, end, "name", full, gender))
        for form in text[start:end].split(" "):
            if form not in PARTICLES and form[-1] != ".":
                words.setdefault(form, (full, gender))
                words.setdefault(form.upper(), (full, gender))
    taken, i = sorted(out), 0
    for m in LONE.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if m.group() in words and (i == len(taken) or m.end() <= taken[i][0]):
            out.append((*m.span(), "name", *words[m.group()]))
    return out


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(from, to, kind, spelling, gender) of what is detected, left to right, without overlaps."""
    found = []
    for start, end in _windows(text):
        for m in FINDER.finditer(text, start, end):
            found.append((*m.span(), m.lastgroup, _spelling(m.lastgroup, m.group()), ""))
    low = text.lower()
    named, end = _people(text, low), 0
    for a in ASSIGNMENT.finditer(text):
        at = a.start()
        while at > end and text[at - 1].isspace():
            at -= 1
        if at > end and (name := SECRET_NAME.search(text, max(0, at - 24), at)) and (m := ASSIGNED.match(text, a.start())):
            which = m.lastgroup
            # One character is what a parser calls a token; a password may be so short.
            secret = any(c.isalnum() for c in m[which]) and (len(m[which]) > 1 or name[0][:5].lower() != "token")
            if secret and (which != "bare" or a[0] == "=" or _BARE.match(m[which])):
                named.append((*m.span(which), "secret", m[which], ""))
                end = m.end()
    for m in PASSPORT.finditer(text) if any(w in low for w in PASSPORTS) else ():
        named.append((*m.span("who"), "secret", m["who"], ""))
    for m in IP6.finditer(text) if "::" in text or text.count(":") > 6 else ():
        if (address := _ip6(m.group())) is not None:
            named.append((*m.span(), "ip6", address, ""))
    if not named:
        return found
    out, end = [], 0
    for e in sorted(named + found, key=lambda e: (e[0], -e[1])):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def held(text: str | None) -> set[tuple[str, str, str]]:
    """(kind, spelling, gender) of a text's entities, the domains of its addresses among them."""
    own = {e[2:] for e in entities(text or "")}
    return own | {("domain", s.rpartition("@")[2], "") for k, s, _ in own if k == "mail"}


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    """Endless keyed bytes."""
    seed, n = "\0".join(parts).encode("utf-8", "surrogatepass"), 0
    while True:
        yield from hashlib.blake2b(seed + n.to_bytes(4, "big"), key=key, digest_size=64).digest()
        n += 1


def _letters(stream: Iterator[int], alphabet: str, n: int) -> str:
    """n characters without favouring any (bytes beyond the last full round are passed over)."""
    most, out = 256 - 256 % len(alphabet), []
    while len(out) < n:
        if (b := next(stream)) < most:
            out.append(alphabet[b % len(alphabet)])
    return "".join(out)


def _shaped(stream: Iterator[int], like: str) -> str:
    kinds = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return "".join(_letters(stream, kinds[0 if c.isdigit() else 1 if c.isupper() else 2], 1) if c.isalnum() else c for c in like)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _script(word: str) -> str:
    first = word[0]
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" or "ἀ" <= first <= "῿" else "armenian" if "Ա" <= first <= "և" else "latin"


def _iban_digits(country: str, account: str) -> str:
    """The check digits that make an account number valid."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _calling_code(digits: str) -> str:
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3]


def draw(key: bytes, kind: str, spelling: str, gender: str, attempt: int) -> str:
    """The surrogate's spelling: the attempt-th draw for this entity. A mail address is drawn in the first draw of its domain."""
    bits = _stream(key, kind, spelling, gender, str(attempt))
    if kind == "mail":
        local, _, domain = spelling.rpartition("@")
        return f"{_padded(bits, local)}@{draw(key, 'domain', domain, '', 0)}"
    if kind == "domain":
        *labels, _ = spelling.split(".")
        return f"{_padded(bits, '.'.join(labels))}.example"
    if kind == "ip":
        return ".".join(str(1 + next(bits) % 254) for _ in range(4))
    if kind == "ip6":
        return "2001:db8:" + ":".join(_letters(bits, "123456789abcdef", 1) + _letters(bits, "0123456789abcdef", 3) for _ in range(6))
    if kind == "name":
        words = spelling.split(" ")
        more = attempt + (len(words) == 1)
        return " ".join(w if w in PARTICLES and len(words) > 1 else _name_word(bits, w, gender if i == 0 and len(words) > 1 else "", more) for i, w in enumerate(words))
    if kind in ("secret", "phone", "ssn", "card", "iban") and attempt > IN_FORMAT:
        return draw(key, kind, spelling, gender, attempt % IN_FORMAT) + _letters(bits, "0123456789", attempt - IN_FORMAT)
    if kind == "secret":
        prefix = next((p for p in ("AKIA", "sk-", "ghp_", "xoxb-", "xoxp-") if spelling.startswith(p)), "")
        if prefix:
            return prefix + _shaped(bits, spelling[len(prefix) :])
        if re.fullmatch("[0-9a-fA-F]+", spelling):
            out = _letters(bits, "0123456789", 1) + _letters(bits, "0123456789abcdef", len(spelling) - 1)
            return out.upper() if spelling.isupper() else out
        return _shaped(bits, spelling)
    if kind == "iban":
        country, account = spelling[:2], _shaped(bits, spelling[4:])
        valid = spelling[2:4] == _iban_digits(country, spelling[4:])
        return country + (_iban_digits(country, account) if valid else _shaped(bits, spelling[2:4])) + account
    if kind == "phone" and spelling[0] in "+0":  # a country keeps its code and a national number its zero
        kept = "0" if spelling[0] == "0" else "+" + _calling_code(spelling[1:])
        return kept + _letters(bits, "0123456789", len(spelling) - len(kept))
    digits = _letters(bits, "0123456789", len(spelling))
    if kind == "card":
        other = next(d for d in "0123456789" if (_luhn(digits[:-1] + d) == 0) == (_luhn(spelling) == 0))
        return digits[:-1] + other
    return spelling[: max(0, len(spelling) - 10)] + digits[-10:] if kind == "phone" else digits


def _padded(bits: Iterator[int], like: str) -> str:
    """In the shape of like, and at least eight letters or digits long."""
    out = _shaped(bits, like)
    return out + _letters(bits, "abcdefghijklmnopqrstuvwxyz", max(0, 8 - len(out)))


def _name_word(bits: Iterator[int], word: str, gender: str, attempt: int) -> str:
    """An invented word for one of a name, hyphens, apostrophes and full stops kept; a woman's given name ends in a vowel."""
    parts = re.split(r"([-'’.])", word)
    last = max(i for i, x in enumerate(parts) if x not in ("", "-", "'", "’", "."))
    out = []
    for i, part in enumerate(parts):
        if part in ("", "-", "'", "’", "."):
            out.append(part)
            continue
        consonants, vowels = SCRIPTS[_script(part)]
        if len(part) == 1:
            out.append(_letters(bits, consonants, 1))
            continue
        body = "".join(_letters(bits, consonants, 1) + _letters(bits, vowels, 1) for _ in range(3 + next(bits) % 2 + attempt))
        out.append(body[:-1] + vowels[0] if gender == "f" and i == last else body + _letters(bits, consonants, 1))
    return "".join(out)


def _cased(word: str, like: str) -> str:
    """word with capitals where like has them: all of it, or the first letter of each part."""
    if like.isupper() and len(like) > 1:
        return word.upper()
    return re.sub(r"[^-'’]+", lambda m: m.group().capitalize(), word) if like[0].isupper() else word


def written(kind: str, surrogate: str, like: str, spelling: str | None = None) -> str:
    """The surrogate in the format of the place it takes. Of a name, only the words that stand there (spelling says which)."""
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter([c for c in surrogate if c.isalnum()])
        out = "".join([*(next(signs) if c.isalnum() else c for c in like), *signs])
        return out.upper() if kind == "iban" else out
    if kind == "name":
        words, forms = surrogate.split(" "), like.split(" ")
        if len(words) != len(forms) and spelling is not None:
            known = dict(zip(reversed(spelling.split(" ")), reversed(words), strict=True))
            words = [known[_folded(x)] for x in forms]
        return " ".join(_cased(w, x) for w, x in zip(words, forms, strict=True))
    if kind == "secret":  # in its own letter case already
        return surrogate
    return surrogate.upper() if like.isupper() else surrogate


def rewritten(text: str, surrogate: Callable[[str, str, str], str]) -> tuple[str, int]:
    """The text with surrogates, given each entity's (kind, spelling, gender), and how many were put in."""
    parts, at, n = [], 0, 0
    for start, end, kind, spelling, gender in entities(text):
        new = surrogate(kind, spelling, gender)
        if kind == "mail":
            new = new.rpartition("@")[0] + "@" + surrogate("domain", spelling.rpartition("@")[2], "")
        parts += [text[at:start], written(kind, new, text[start:end], spelling)]
        at, n = end, n + 1
    return ("".join([*parts, text[at:]]) if n else text), n


ENTITY = ["kind", "spelling", "gender"]


def mentions(docs: DataFrame) -> DataFrame:
    """(key, kind, spelling, gender): the entities of each text, once each, by the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(k.as_py(), *e) for k, x in zip(batch.column("key"), batch.column("text"), strict=True) if x.is_valid for e in held(x.as_py())}
            columns = list(zip(*seen, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["key", *ENTITY])

    return docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(run, "key long, kind string, spelling string, gender string").distinct()


def collisions(entity: DataFrame, key: bytes, rounds: int = MOST_DRAWS) -> DataFrame:
    """(kind, spelling, gender, attempt > 0) of entities whose earlier draws collide with an entity or another's surrogate."""

    def proposed(rows: DataFrame, attempt: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                drawn = [draw(key, *e, attempt) for e in zip(*(batch.column(c).to_pylist() for c in ENTITY), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ENTITY), pa.array(drawn, pa.string())], [*ENTITY, "surrogate"])

        return rows.select(*ENTITY).mapInArrow(run, "kind string, spelling string, gender string, surrogate string")

    taken = entity.select("kind", F.col("spelling").alias("surrogate")).distinct()
    waiting, moved = entity, None
    for attempt in range(rounds):
        drawn = materialize(proposed(waiting, attempt), "surrogates")
        # The first by spelling may have a surrogate that several drew, unless it is taken.
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("spelling", "gender")).alias("e")).select("kind", "surrogate", "e.*").join(taken, ["kind", "surrogate"], "left_anti")
        settled = materialize(drawn.join(first, ["kind", "surrogate", "spelling", "gender"], "left_semi"), "surrogates")
        if attempt:
            more = settled.select(*ENTITY, F.lit(attempt).alias("attempt"))
            moved = more if moved is None else moved.unionByName(more)
        waiting = materialize(drawn.join(settled, ENTITY, "left_anti").select(*ENTITY), "surrogates")
        if waiting.isEmpty():
            break
        taken = taken.unionByName(settled.select("kind", "surrogate"))
    else:
        raise RuntimeError("surrogates keep colliding")
    return moved if moved is not None else entity.limit(0).select(*ENTITY, F.lit(0).alias("attempt"))


def replace(docs: DataFrame, key: bytes, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with surrogates in text, and n_entities (long).

    The join that hands the moved entities to their texts is the same at any size; ``most_broadcast`` only says up to how many
    of them its short side is marked for a broadcast.
    """
    if "n_entities" in docs.columns:
        docs = docs.drop("n_entities")
    mentioned = materialize(mentions(docs), "entities")
    moved = materialize(collisions(mentioned.select(*ENTITY).distinct(), key), "moved")
    special = free_name("moved", docs.columns)
    by_text = mentioned.join(moved, ENTITY).groupBy("key").agg(F.collect_list(F.struct(*ENTITY, "attempt")).alias(special)).withColumnRenamed("key", f"{special}_key")
    by_text = materialize(by_text, "moved")
    if (by_text.agg(F.sum(F.size(special))).first()[0] or 0) <= most_broadcast:
        by_text = F.broadcast(by_text)
    rows = docs.join(by_text, F.xxhash64(docs["text"]) == by_text[f"{special}_key"], "left").drop(f"{special}_key")
    schema = docs.withColumn("n_entities", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = functools.lru_cache(maxsize=100_000)(functools.partial(draw, key))
        for batch in batches:
            texts, counts = [], []
            for x, mine in zip(batch.column("text").to_pylist(), batch.column(special).to_pylist(), strict=True):
                attempts = {(e["kind"], e["spelling"], e["gender"]): e["attempt"] for e in mine or ()}
                new, n = (x, 0) if x is None else rewritten(x, lambda *e: drawn(*e, attempts.get(e, 0)))  # noqa: B023
                texts.append(new)
                counts.append(n)
            made = {"text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in schema.names], schema.names)

    return rows.mapInArrow(run, schema)
