"""Personal data replaced by keyed, type-consistent surrogates.

Values with a format (e-mail, phone, IPv4, IPv6, IBAN, social security, card and
account numbers, birth dates, house numbers, secrets) are moved along a keyed
cycle through all values of their format: a Feistel network puts the characters'
mixed-radix numbers in a secret order, and a value goes to the next one of the
same shape (Luhn, IBAN check, address class, leading zeros). A cycle can't make
two values one, has one surrogate for one value everywhere, and leaves none as it was
where there are two. First names move so inside the list of their gender and
script. Surnames and streets aren't a closed list: theirs are drawn from
syllables of their script, so two may meet, or meet a name that stands in the
corpus; a check over the distinct names of all documents finds these, and all but
the first draw again until none is shared.

A person is found by a title, a listed given name, or a phrase like "my name is"
or "Name:", with the capitalised names and initials that follow; their
words are then replaced wherever they stand capitalised in the same document.
Names without any of these aren't found, as they look like other proper names.

Defined cases: null text stays null, empty text empty; texts without entities
come back unchanged; repeated rows get the same surrogates; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import Scratch

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): (
        "Mary Anna Julia Laura Sophie Emma Clara Alice Helen Irene Lucia Maria Elena Carmen Marie Camille Ingrid Petra Sabine Judith "
        "Susan Patricia Jennifer Linda Elizabeth Barbara Jessica Sarah Karen Nancy Margaret Lisa Sandra Emily Michelle Amanda Rebecca Deborah Catherine Ruth "
        "Monika Ursula Birgit Heike Nathalie Isabelle Chloé Pilar Rosa Teresa"
    ).split(),
    ("latin", "m"): (
        "John James Robert Peter Thomas Daniel Martin Lucas Oliver Henry Carlos Miguel Pablo Diego Pierre Antoine Stefan Klaus Jürgen Matthias "
        "William George Michael David Richard Joseph Charles Christopher Matthew Anthony Steven Andrew Kenneth Kevin Brian Edward Ronald Timothy Jason Jeffrey "
        "Wolfgang Günter Heinz Dieter Jacques François Philippe Javier José Luis"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παύλος".split(),
}
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme".split()
#: Phrases before a name.
CUES = ("[Mm]y name is", "[Nn]ame:", "[Ss]igned by", "[Cc]ontact:", "[Mm]ein Name ist", "[Jj]e m'appelle", "[Mm]e llamo", "[Мм]еня зовут", "[Μμ]ε λένε")
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то".split(),
    "greek": "βα γα γο δα δε θα κα κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το".split(),
}
ENDINGS = {"latin": "berg dorf field ford lin man ner son ton well".split(), "cyrillic": "ев ин ов".split(), "greek": "άκης ίδης όπουλος".split()}
_SCRIPT = {n.casefold(): key for key, names in GIVEN.items() for n in names}

_FORMS = [
    ("email", r"(?<![\w.+%-])[\w.+%-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}"),
    ("secret", r"(?:(?<=token)|(?<=secret)|(?<=passwd)|(?<=password)|(?<=api_key)|(?<=apikey)|(?<=api-key))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{12,}"),
    ("secret", r"\b(?:AKIA|ghp_|gho_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,}"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv4", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\w.,+/-])0\d{2,4}[ /-]\d{5,8}(?![\w/-])"),
    ("card", r"(?<![\d.])(?:\d[ -]?){12,18}\d(?![\d])"),
]
#: Rarer forms, each looked for only where a text holds one of some words.
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:])")
_BIRTH_WORDS = ("orn ", "DOB", "irth", "geboren am ", "n\u00e9e le ", "n\u00e9 le ", "nacid")
_BIRTH = re.compile(r"(?:[Bb]orn (?:on )?|DOB:? |[Bb]irth:? |geboren am |n\u00e9e? le |nacid[oa] el )((?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d))")
_HOUSE = re.compile(r"(?<![\w.,])\d{1,5}(?= [A-Z][a-z]+ (?:Street|Road|Avenue|Lane|Drive|Boulevard|Court|Square)\b)|(?<=stra\u00dfe )\d{1,4}\b|(?<=gasse )\d{1,4}\b|(?<=weg )\d{1,4}\b")
_FORM = re.compile("|".join(f"(?P<g{i}>{p})" for i, (_, p) in enumerate(_FORMS)))
_GIVEN = "|".join(sorted((x for names in GIVEN.values() for n in names for x in (n, n.upper())), key=len, reverse=True))
_HEAD = re.compile(rf"\b(?:(?P<title>{'|'.join(TITLES)})\b\.?|(?P<given>{_GIVEN})\b)")
_HEAD_OR_CUE = re.compile(rf"\b(?:(?P<title>{'|'.join(TITLES)})\b\.?|(?P<cue>{'|'.join(CUES)})|(?P<given>{_GIVEN})\b)")
#: What every phrase before a name holds.
_CUE_WORDS = ("name is", "ame:", "igned by", "ontact:", "ein Name ist", "e m'appelle", "e llamo", "еня зовут", "ε λένε")
#: A street's name is found by the word after it or by its ending.
_STREET = re.compile(r"(?<=\d )(?P<first>[A-Z][a-z]+)(?= (?:Street|Road|Avenue|Lane|Drive|Boulevard|Court|Square)\b)|\b(?P<last>[A-ZÄÖÜ][a-zäöü]+?)(?=(?:stra\u00dfe|gasse|weg) \d)")
#: What follows a title or a given name: an initial or one more name.
_PART = re.compile(r" (?:(?P<initial>[^\W\d_])\.?(?![\w'’-])|(?P<name>[^\W\d_]{2,}(?:-[^\W\d_]+)*|[^\W\d_](?:['’][^\W\d_]{2,})))")
_MENTION = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]+)*|[^\W\d_]['’][^\W\d_]{2,}")
#: The most names and initials after a title or a given name.
PARTS = 6
_HINT = re.compile(r"[@\d]")
_MAY_NAME = re.compile("|".join([*TITLES, _GIVEN]))
_STREET_WORDS = ("Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "Court", "Square", "stra\u00dfe", "gasse", "weg")
#: Special IPv4 networks (RFC 6890): hosts stay in them.
_NETWORKS = [ipaddress.IPv4Network(n) for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 240.0.0.0/4".split()]
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Permutation:
    """A keyed cycle through 0 .. n - 1: a Feistel network gives the numbers a secret order, and each goes to the next."""

    def __init__(self, key: bytes, purpose: str, n: int):
        self.n, half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.half, self.mask = half, (1 << half) - 1
        self.key = hashlib.blake2b(f"{purpose}|{n}".encode(), key=key, digest_size=32).digest()

    def _round(self, r: int, b: int) -> int:
        size = self.half // 8 + 1
        return int.from_bytes(hashlib.shake_256(self.key + bytes([r]) + b.to_bytes(size, "big")).digest(size), "big") & self.mask

    def place(self, x: int) -> int:
        """Where x stands in the order."""
        a, b = x >> self.half, x & self.mask
        for r in range(8):
            a, b = b, a ^ self._round(r, b)
        return a << self.half | b

    def at(self, y: int) -> int:
        """What stands there."""
        a, b = y >> self.half, y & self.mask
        for r in reversed(range(8)):
            a, b = b ^ self._round(r, a), a
        return a << self.half | b

    def __call__(self, x: int, fits=lambda y: True) -> int:
        """The next after x of the values for which ``fits``; x itself if there is no other."""
        place, every = self.place(x), (1 << 2 * self.half) - 1
        while True:
            place = place + 1 & every
            y = self.at(place)
            if y < self.n and fits(y):
                return y


def _alphabet(c: str, lower_hex: bool) -> str | None:
    if lower_hex and c in "0123456789abcdef":
        return "0123456789abcdef"
    for a in (_DIGITS, _LOWER, _UPPER, "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"):
        if c in a:
            return a
    return None


def luhn(digits: str) -> bool:
    odd = digits[::-1]
    return (sum(map(int, odd[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in odd[1::2])) % 10 == 0


def iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Surrogates:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple, str] = {}

    def _moved(self, kind: str, text: str, free, fits=lambda s: True, lower_hex: bool = False) -> str:
        """``text`` with the characters at ``free`` places permuted inside their alphabets."""
        places = [(i, a) for i in free if (a := _alphabet(text[i], lower_hex))]
        n = x = 0
        form = list(text)
        for k, (i, a) in enumerate(places):
            n = len(a) if k == 0 else n * len(a)
            x = x * len(a) + a.index(text[i])
            form[i] = a[0]
        if n < 2:
            return text

        def spelled(y: int) -> str:
            out = form[:]
            for i, a in reversed(places):
                y, c = divmod(y, len(a))
                out[i] = a[c]
            return "".join(out)

        if not fits(text):
            return text
        p = Permutation(self.key, f"{kind}|{''.join(form)}|{[i for i, _ in places]}", n)
        return spelled(p(x, lambda y: fits(spelled(y))))

    def form(self, kind: str, text: str) -> str:
        at = (kind, text)
        if at not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[at] = getattr(self, f"_{kind}")(text)
        return self.known[at]

    def _email(self, s: str) -> str:
        local, _, domain = s.rpartition("@")
        local, top = local.lower(), domain.lower().rsplit(".", 1)
        host = self._moved("host", top[0], range(len(top[0])))
        return f"{self._moved('local', local, range(len(local)))}@{host}.{top[1]}"

    def _secret(self, s: str) -> str:
        value = re.search(r"[A-Za-z0-9_+/-]{12,}$", s)
        at = value.start()
        fixed = re.match(r"(?:AKIA|ghp_|gho_|sk-|xox[bp]-)?", s[at:]).end()
        is_hex = re.fullmatch(r"[0-9a-f]+", s[at:]) is not None
        return s[:at] + self._moved("secret", s[at:], range(fixed, len(s) - at), lower_hex=is_hex)

    def _iban(self, s: str) -> str:
        compact = s.replace(" ", "")
        ok = iban_ok(compact)
        if ok:
            body = self._moved("iban", compact, range(4, len(compact)))
            check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:2] + "00")) % 97
            moved = f"{body[:2]}{check:02d}{body[4:]}"
        else:
            moved = self._moved("iban-", compact, range(2, len(compact)), lambda x: not iban_ok(x))
        out = iter(moved)
        return "".join(c if c == " " else next(out) for c in s)

    def _ipv4(self, s: str) -> str:
        octets = [int(x) for x in s.split(".")]
        if max(octets) > 255:
            return self._moved("dotted", s, range(len(s)), lambda x: max(map(int, x.split("."))) > 255)
        x = int.from_bytes(bytes(octets), "big")
        for network in _NETWORKS:  # a host moves inside its special network
            if ipaddress.IPv4Address(x) in network:
                low, size = int(network.network_address), network.num_addresses
                return str(ipaddress.IPv4Address(low + Permutation(self.key, f"ipv4 {network}", size)(x - low)))
        public = lambda y: not any(ipaddress.IPv4Address(y) in n for n in _NETWORKS)
        return str(ipaddress.IPv4Address(Permutation(self.key, "ipv4", 1 << 32)(x, public)))

    def _ipv6(self, s: str) -> str:
        """The hexadecimal digits after the first group, which tells the network's kind."""
        first = s.index(":")
        free = [i for i in range(first, len(s)) if s[i] in "0123456789abcdefABCDEF"] or [i for i in range(first) if s[i] in "0123456789abcdefABCDEF"]
        upper = s != s.lower()
        out = self._moved("ipv6", s.lower(), free, lower_hex=True)
        return out.upper() if upper else out

    def _birth(self, s: str) -> str:
        """Another day of the same decades, in the same form; what is no date is moved digit by digit."""
        parts = re.split(r"[-./]", s)
        y, m, d = (parts[0], parts[1], parts[2]) if len(parts[0]) == 4 else (parts[2], parts[1], parts[0])
        low, high = date(1900, 1, 1).toordinal(), date(2030, 1, 1).toordinal()
        try:
            day = date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            day = 0
        if not low <= day < high:
            return self._moved("birth-", s, range(len(s)))

        def spelled(n: int) -> str:
            x = date.fromordinal(low + n)
            if len(parts[0]) == 4:
                return f"{x.year:04d}-{x.month:02d}-{x.day:02d}"
            wide = len(parts[0]) == 2 and len(parts[1]) == 2
            sign = s[len(parts[0])]
            return f"{x.day:02d}{sign}{x.month:02d}{sign}{x.year:04d}" if wide else f"{x.day}{sign}{x.month}{sign}{x.year:04d}"

        p = Permutation(self.key, "birth", high - low)
        # one day has two spellings with single digits at most, and each stays in its own
        return spelled(p(day - low, lambda n: len(spelled(n)) == len(s)))

    def _house(self, s: str) -> str:
        return self._moved("house", s, range(len(s)), lambda x: (x[0] == "0") == (s[0] == "0"))

    def _digits(self, kind: str, s: str, first: int, fits) -> str:
        """One surrogate for one number, however it is spaced."""
        bare = "".join(c for c in s if c in _DIGITS)
        out = iter(self._moved(kind, bare, range(first, len(bare)), fits))
        return "".join(next(out) if c in _DIGITS else c for c in s)

    def _ssn(self, s: str) -> str:
        return self._digits("ssn", s, 0, lambda x: True)

    def _phone(self, s: str) -> str:
        code = len(re.match(r"\+(\d{1,3})(?!\d)|", s)[1] or "")
        zero = "".join(c for c in s if c in _DIGITS)[code:][:1] == "0"
        return self._digits(f"phone{code}", s, code, lambda x: (x[code : code + 1] == "0") == zero)

    def _card(self, s: str) -> str:
        good = luhn("".join(c for c in s if c in _DIGITS))
        return self._digits("card", s, 0, lambda x: luhn(x) == good)

    def given(self, name: str) -> str:
        script = _SCRIPT[name.casefold()]
        names = GIVEN[script]
        k = [n.casefold() for n in names].index(name.casefold())
        return _cased(names[Permutation(self.key, f"given{script}", len(names))(k)], name)

    def surname(self, name: str, draw: int = 0) -> str:
        script = script_of(name)
        h = hashlib.blake2b(f"{name.casefold()}|{draw}".encode(), key=self.key, digest_size=16).digest()
        x, parts = int.from_bytes(h, "big"), []
        for _ in range(2 + draw):  # every draw has a larger space
            x, c = divmod(x, len(SYLLABLES[script]))
            parts.append(SYLLABLES[script][c])
        end = ENDINGS[script][x % len(ENDINGS[script])]
        if script == "cyrillic" and name.casefold().endswith("а"):
            end += "а"
        return _cased("".join([*parts, end]).capitalize(), name)


def _cased(new: str, old: str) -> str:
    return new.upper() if old.isupper() else new.lower() if old.islower() else new


def script_of(name: str) -> str:
    for c in name:
        said = unicodedata.name(c, "")
        if said.startswith("CYRILLIC"):
            return "cyrillic"
        if said.startswith("GREEK"):
            return "greek"
    return "latin"


def _full_names(text: str):
    """(kind, start, end) of the names that a title or a listed given name begins."""
    end = 0
    for m in (_HEAD_OR_CUE if _has(text, _CUE_WORDS) else _HEAD).finditer(text):
        if m.start() < end:
            continue
        run = [("name", *m.span("given"))] if m["given"] else []
        at = m.end()
        while len(run) < PARTS + bool(m["given"]) and (part := _PART.match(text, at)):
            kind = part.lastgroup
            if not part[kind][0].isupper():
                break
            run.append((kind, *part.span(kind)))
            at = part.end()
        while run and run[-1][0] == "initial":
            run.pop()
        if not run or (m["given"] and len(run) == 1):
            continue  # a given name alone is too common a word
        last = len(run) - 1
        for i, (kind, a, b) in enumerate(run):
            listed = text[a:b].casefold() in _SCRIPT and (i < last or (last == 0 and m["title"]))
            yield "initial" if kind == "initial" else "given" if listed else "surname", a, b
        end = run[-1][2]


def _has(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def _forms(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "::" in text or text.count(":") >= 7:
        found += [("ipv6", *m.span()) for m in _IPV6.finditer(text)]
    if _has(text, _BIRTH_WORDS):
        found += [("birth", *m.span(1)) for m in _BIRTH.finditer(text)]
    if _has(text, _STREET_WORDS):
        found += [("house", *m.span()) for m in _HOUSE.finditer(text)]
    rare = found[:]
    if _HINT.search(text) or "_" in text or "-" in text:
        for m in _FORM.finditer(text):
            if not any(a < m.end() and m.start() < b for _, a, b in rare):
                found.append((_FORMS[int(m.lastgroup[1:])][0], m.start(), m.end()))
    return found


def _may_name(text: str) -> bool:
    return _MAY_NAME.search(text) is not None or _has(text, _CUE_WORDS)


def entities(text: str):
    """(kind, start, end) of the entities of a text, in order, none overlapping.

    Names that were found whole are found again wherever one of their words
    stands capitalised in the same text.
    """
    found = _forms(text)
    if _has(text, _STREET_WORDS):
        taken = [(a, b) for _, a, b in found]
        for m in _STREET.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                found.append(("street", *m.span()))
    if _may_name(text):
        inside = bytearray(len(text))
        for _, a, b in found:
            inside[a:b] = b"\1" * (b - a)
        names = [x for x in _full_names(text) if not any(inside[x[1] : x[2]])]
        for _, a, b in names:
            inside[a:b] = b"\1" * (b - a)
        found += names
        known: dict[str, str] = {}
        for kind, a, b in names:
            if kind != "initial":
                known.setdefault(text[a:b].casefold(), kind)
        if known:
            for m in _MENTION.finditer(text):
                kind = known.get(m[0].casefold())
                if kind and m[0][0].isupper() and not any(inside[m.start() : m.end()]):
                    found.append((kind, *m.span()))
    return sorted(found, key=lambda x: x[1])


def surnames(text: str) -> set[str]:
    """The surnames and streets of a text, whose surrogates are drawn."""
    if not _may_name(text) and not _has(text, _STREET_WORDS):
        return set()
    return {text[a:b].casefold() for kind, a, b in entities(text) if kind in ("surname", "street")}


def replaced(text: str, s: Surrogates, draws: dict[str, int]) -> tuple[str, list[str]]:
    out, kinds, at = [], [], 0
    for kind, a, b in entities(text):
        if a < at:
            continue
        old = text[a:b]
        if kind == "given":
            new = s.given(old)
        elif kind in ("surname", "street"):
            new = s.surname(old, draws.get(old.casefold(), 0))
        elif kind == "initial":
            new = s._moved("initial", old, range(1))
        else:
            new = s.form(kind, old)
        out += [text[at:a], new]
        kinds.append(kind)
        at = b
    return "".join([*out, text[at:]]), kinds


def surname_draws(rows: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """name and draw (from 1) of the surnames whose first surrogates are shared or stand in the corpus.

    Rounds over the distinct surnames: the least of those that share a surrogate
    keeps it, and the others draw again, until all are distinct and none is a
    surname of any document.
    """

    def names(batches):
        for batch in batches:
            seen = set()
            for x in batch.column(0):
                seen |= surnames(x.as_py() or "")
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["name"])

    def drawn(batches):
        s = Surrogates(key)
        for batch in batches:
            made = [s.surname(n, d).casefold() for n, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["name", "draw", "made"])

    real = scratch.save(rows.select("text").mapInArrow(names, "name string").distinct(), "surnames")
    state = real.withColumn("draw", F.lit(0).cast("long"))
    while True:
        state = scratch.save(state.mapInArrow(drawn, "name string, draw bigint, made string"), "names")
        # the latest draws give way: what has been settled stays
        owner = state.groupBy("made").agg(F.min(F.struct("draw", "name")).alias("own"), F.count("*").alias("n"))
        owner = owner.join(real.select(F.col("name").alias("made"), F.lit(True).alias("real")), "made", "left").where("n > 1 or real")
        # nobody owns a surname of the corpus
        owner = scratch.save(owner.select("made", F.when(F.col("real"), F.lit("")).otherwise(F.col("own.name")).alias("owner")), "owners")
        if not owner.head(1):
            return state.where("draw > 0").select("name", "draw")
        again = state.join(owner, "made", "left")
        state = again.select("name", F.when(F.col("owner") != F.col("name"), F.col("draw") + 1).otherwise(F.col("draw")).alias("draw"))


def replace_entities(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    key: bytes,
) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds, one row a document.

    ``key`` is the secret that decides all surrogates; who has it can undo them.
    """
    if not key:
        raise ValueError("surrogates need a key")
    scratch = Scratch(docs.sparkSession, "surrogates")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    draws = scratch.save(surname_draws(rows, key, scratch), "draws")
    if draws.head(1):
        # surnames that drew again reach the documents that have them by a join

        def with_names(batches):
            for batch in batches:
                keys = batch.column(0).to_pylist()
                pairs = [(k, n) for k, x in zip(keys, batch.column(1), strict=True) for n in sorted(surnames(x.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["row", "name"])

        marked = rows.withColumn("row", F.xxhash64("text"))
        held = marked.where("text is not null").select("row", "text").mapInArrow(with_names, "row bigint, name string").distinct()
        own = held.join(draws, "name").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("name", "draw"))).alias("draws"))
        rows = marked.join(scratch.save(own, "held"), "row", "left").select("doc_id", "text", "draws")
    else:
        rows = rows.withColumn("draws", F.lit(None).cast("map<string,bigint>"))

    def run(batches):
        s = Surrogates(key)
        for batch in batches:
            texts, counts, kinds = [], [], []
            for x, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new, found = (None, []) if x is None else replaced(x, s, dict(d or ()))
                texts.append(new)
                counts.append(len(found))
                kinds.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_entities", "kinds"],
            )

    return rows.mapInArrow(run, "doc_id bigint, text string, n_entities bigint, kinds array<string>")
