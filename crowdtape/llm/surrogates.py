"""Personal data replaced by surrogates.

Detected entities (e-mail, phone, card number, bank account, address of a machine, named person) get a
keyed replacement of their own type: digits stay digits in the same grouping, letters keep script and
case, names keep gender and script, check digits stay valid. Numbers that fail their check (Luhn for
cards, mod 97 for accounts) are no personal data. An entity is its type and normal form; it gets the same
surrogate wherever and however it is written (coreference), and different entities get different ones.

A person is found by a title. First and last names are entities of their own, drawn from their own keys, so
"Mr. John Smith", "Dr. Smith" and "J. Smith" agree on Smith; names that a title introduced are replaced
wherever they stand in the same text, title or not. Particles (von, de) stay. A last name is the same for
both sexes; in Cyrillic its ending follows the sex.

Digit strings go through a keyed permutation of all strings of their length (check digits follow from
it), so two of them can't meet. The rest draw from keyed hashes. A surrogate must not equal another entity's surrogate, nor any real
entity of the corpus: surrogates and entities are counted together, and the entity with the greater keyed
hash draws again until no count exceeds one. Only these rare re-draws are kept as a table; everything else
is recomputed from the key wherever an entity stands.

Null texts stay null, texts without entities stay as they are. Rows and columns are kept; ``entities``
(how many were replaced) replaces a column of that name. Overlapping findings: the leftmost, then the
first kind in order, wins.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, query, read, renamed, stored

KEY = b"surrogate key: a parameter, kept apart from the data in real use"

# --- fixed values: what entities look like, and what names may be drawn ---
ACCOUNT_LENGTH = {c: int(n) for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}
KINDS = ("email", "iban", "ip6", "ip", "phone", "number", "person")
_TITLES = "Mr Mrs Miss Mx Dr Prof Professor Doctor Lord Lady Herr Frau Fräulein Doktor Monsieur Madame Mme Mlle Mademoiselle Señor Señora Señorita Sr Sra Srta Don Doña Docteur Doctora Profesor Profesora Господин Госпожа Доктор Профессор Г-жа Г-н".split()
TITLE = "|".join([*sorted({x for t in _TITLES for x in (t, t.upper())}, key=lambda t: (-len(t), t)), "г-н", "г-жа", "Д-р", "д-р", "Sir", "Ms", r"(?:SIR|MS)(?=\.?\x20[^\W\d_a-zß-ÿ]{2})"])
PARTICLE = r"(?:(?:von|van|vom|zu|zum|zur|de|der|den|del|della|da|di|du|dos|das|la|le|el|al|bin|ibn|ter|ten)\x20)*"
WORD = r"[^\W\d_]\w*(?:['’-](?!s\b)[^\W\d_]\w*)*"
CAPITAL = r"(?=[^\W\d_a-zß-ÿа-яё])"
# these titles may stand before a name in lower case; "Professor of", "Lord of" and "Mr and" introduce none
PLAIN = "(?:" + "|".join(rf"(?<=\b{t}{dot}\x20)" for t in "Mr Mrs Ms Miss Sir Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Господин Госпожа Г-жа Г-н".split() for dot in ("", r"\.")) + r")(?!(?:and|und|et|y|e|и|or|oder|ou|o|или)\b)"
INITIAL = rf"{CAPITAL}[^\W\d_]\.(?:-?{CAPITAL}[^\W\d_]\.)*\x20?"
PATTERNS = {
    "email": r"(?P<email>[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,})",
    "iban": r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b)",
    "ip": r"(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9]))",
    "phone": r"(?P<phone>\+1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[\x20-]?\([0-9]{1,4}\))?(?:[\x20-]?[0-9]{2,4}){2,4}(?![.0-9])"
    r"|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![\w.-])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?!\w|[.-]\w)|(?<![\w-])[0-9]{3}\x20[0-9]{3}\x20[0-9]{4}(?![\w-])|(?<![\w-])[0-9]{3}-[0-9]{2,3}-[0-9]{4}(?![\w-]))",
    "number": r"(?P<number>(?<!\w)[0-9]{4}(?:[\x20-]?[0-9]{4}){2}|(?<!\w)[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5}(?!\w))",
    "ip6": r"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?<![.:]):?:?)(?![\w:]))",
    "person": rf"(?P<person>(?<!\w)(?:(?:{TITLE})(?:\.?[\x20\xa0\n]|\.(?=[^\W\d_a-z])))+{PARTICLE}(?:{INITIAL})*{PARTICLE}(?:{CAPITAL}|{PLAIN}){WORD}"
    rf"(?:\x20(?:{INITIAL})*{PARTICLE}(?!(?:{TITLE})\b){CAPITAL}{WORD})?)",
}
TITLES = {"m": "mr sir lord herr monsieur señor sr don profesor господин г-н".split(), "f": "mrs ms miss lady frau fräulein madame mme mlle mademoiselle señora señorita sra srta doña doctora profesora госпожа г-жа".split()}
FIRST = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Klara Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей".split(),
    ("cyrillic", "f"): "Анна Варвара Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha hol ka kel la lem ma mor na nor pa per ra ros sa sel ta tor va ver wa win".split(),
             "cyrillic": "ба бе бо ва ве го да де до за ка ко ла ле ма мо на но па по ра ро са со та то фа хо ча ша".split()}
ENDING = {("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("latin", "m"): "", ("latin", "f"): ""}


def _draw(key: bytes, *what) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest(), "big")


def permuted(digits: str, key: bytes, kind: str, turn: int = 0) -> str:
    """A keyed permutation of the digit strings of this length (an unbalanced Feistel network)."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + _draw(key, kind, n, turn)) % 10) if digits else ""
    a, b = n // 2, n - n // 2
    left, right = int(digits[:a]), int(digits[a:])
    for step in range(0, 8, 2):
        left = (left + _draw(key, kind, turn, n, step, right)) % 10**a
        right = (right + _draw(key, kind, turn, n, step + 1, left)) % 10**b
    return f"{left:0{a}d}{right:0{b}d}"


def check_digit(digits: str) -> int:
    """The Luhn digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def account_remainder(account: str) -> int:
    """Mod 97 of an account number, country and check digits moved behind, letters as numbers."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def is_valid(kind: str, norm: str) -> bool:
    if kind == "number":
        return check_digit(norm[:-1]) == int(norm[-1])
    return kind != "iban" or account_remainder(norm) == 1


def is_address(text: str) -> bool:
    """A version 6 address, but not a time or a name in program text such as a::b."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return text.count(":") == 7 or bool(re.search("[0-9]", text) and re.search("[0-9A-Fa-f]{3}", text))


def normal(kind: str, text: str) -> str:
    """The form that all writings of an entity share."""
    if kind in ("phone", "number"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip6":
        return str(ipaddress.IPv6Address(text))
    if kind == "last":
        return re.sub("(?<=ов|ев|ёв|ин|ын)а$", "", text.lower())
    return text.lower()


def _word(key: bytes, script: str, least: int, *what) -> str:
    x, parts = _draw(key, *what), ""
    pool = SYLLABLES[script]
    while len(parts) < max(least, 4):
        x, r = divmod(x, len(pool))
        parts += pool[r]
    return parts


def surrogate(kind: str, norm: str, key: bytes = KEY, turn: int = 0) -> str:
    """The normal form of an entity's replacement."""
    if kind == "phone":
        return permuted(norm, key, kind, turn)
    if kind == "number":
        body = permuted(norm[:-1], key, kind, turn)
        return f"{body}{check_digit(body)}"
    if kind == "iban":
        digits = iter(permuted(re.sub(r"\D", "", norm[4:]), key, kind, turn))
        body = "".join(next(digits) if c.isdigit() else chr(65 + (ord(c) - 65 + _draw(key, kind, turn, i)) % 26) for i, c in enumerate(norm[4:]))
        return f"{norm[:2]}{98 - account_remainder(norm[:2] + '00' + body):02d}{body}"
    if kind == "ip":
        x = _draw(key, kind, norm, turn)
        return ".".join(str(1 + (x >> 16 * i) % 254) for i in range(4))
    if kind == "email":
        name, domain = norm.rsplit("@", 1)
        x = _draw(key, kind, norm, turn)
        local = "".join(_word(key, "latin", len(p), kind, norm, turn, i)[:max(len(p), 4)] if p[:1].isalpha() else permuted(p, key, kind, turn) if p.isdigit() else p
                        for i, p in enumerate(re.split(r"([^a-z0-9]+|\d+)", name)) if p)
        return f"{local}{x % 10**6:06d}@{_word(key, 'latin', 6, kind, domain)}.example"
    if kind == "ip6":  # in the block for documentation
        return str(ipaddress.IPv6Address((0x20010DB8 << 96) + _draw(key, kind, norm, turn) % 2**96))
    script = "cyrillic" if re.search("[а-яё]", norm) else "latin"
    if kind == "initial":
        return chr(ord(norm[0]) + _draw(key, kind, norm) % 8) if norm in "abcdefghijklmnopqr" else "абвгдезиклмнопрст"[_draw(key, kind, norm) % 17] if script == "cyrillic" else "klmnoprs"[_draw(key, kind, norm) % 8]
    if kind == "last":
        return _word(key, script, 6, kind, norm, turn) + ("ов" if script == "cyrillic" else "")
    sex = norm[0]
    first = FIRST[script, sex][_draw(key, kind, norm, turn) % len(FIRST[script, sex])].lower()
    return f"{sex} {first}" + (f"-{_word(key, script, 4, kind, norm, turn)}" if turn else "")


def written(kind: str, original: str, norm: str, sex: str = "m") -> str:
    """A surrogate's normal form in the format of the original's writing."""
    if kind in ("phone", "number", "iban"):
        it = iter(norm)
        return "".join(next(it) if c.isalnum() else c for c in original)
    if kind in ("first", "last", "initial"):
        new = norm[2:] if kind == "first" else norm + "а" * (kind == "last" and sex == "f" and norm.endswith("ов"))
        return new.upper() if original.isupper() and (len(original) > 1 or kind == "initial") else new if original.islower() else "-".join(p.capitalize() for p in new.split("-"))
    return norm.upper() if kind in ("email", "ip6") and original.isupper() else norm


_DIGITS = re.compile(r"[0-9][0-9]").search
_DOTTED = re.compile(r"[0-9]\.[0-9]").search
_HINT = re.compile(rf"(?:{TITLE})[.\x20\xa0\n]").search
_NAME = re.compile(rf"{PARTICLE}(?:(?P<initial>{CAPITAL}[^\W\d_])\.-?|(?P<word>{WORD}))\x20?")
_TITLED = re.compile(rf"(?:(?:{TITLE})(?:\.?[\x20\xa0\n]|\.(?=[^\W\d_a-z])))+")


@cache
def _pattern(mail: bool, digits: bool, dotted: bool, colons: bool, title: bool) -> re.Pattern:
    kinds = [k for k in KINDS if {"email": mail, "ip": dotted, "ip6": colons, "person": title}.get(k, digits)]
    return re.compile("|".join(PATTERNS[k] for k in kinds))


def candidates(text: str) -> re.Pattern | None:
    """The pattern of all kinds; kinds whose sign (an at, two digits, a dot between digits, two colons, a title) the text
    lacks can't match and are not tried."""
    signs = ("@" in text, bool(_DIGITS(text)), bool(_DOTTED(text)), text.count(":") > 1, bool(_HINT(text)))
    return _pattern(*signs) if any(signs) else None


_CHAIN = re.compile(r"[0-9]+(?:[\x20-][0-9]+){0,5}(?!\w)")  # more groups are never one number
_GROUP = re.compile(r"[0-9]+")
_ISSUED = re.compile(r"4(?:.{12}|.{15}|.{18})|(?:5[1-5]|2[2-7]|35).{14}|3[47].{13}|3[068].{12}|6.{15,18}")


def _cards(text: str, at: int) -> list[tuple[bool, int]]:
    """(whether issuers give such numbers, end) of the valid numbers that begin at ``at``: runs of whole
    groups, all of a multiple of four digits but the last, or 4-6-4 and 4-6-5."""
    out, chain = [], _CHAIN.match(text, at)
    if not chain:
        return out
    norm, sizes = "", []
    for g in _GROUP.finditer(text, at, chain.end()):
        norm += g[0]
        sizes.append(len(g[0]))
        if len(norm) > 19:
            break
        fits = len(norm) > 12 or len(norm) == 12 and g.end() == chain.end()  # twelve digits: not a part of more
        if fits and (not any(n % 4 for n in sizes[:-1]) or sizes in ([4, 6, 4], [4, 6, 5])) and is_valid("number", norm):
            out.append((bool(_ISSUED.fullmatch(norm)), g.end()))
        if sizes[-1] % 4 and sizes != [4, 6]:
            break
    return out


def _card(text: str, at: int) -> int:
    """The end of the card number that begins at ``at``, or 0. Of several, one that issuers give comes
    first, even if it begins within this one; then the longest."""
    best = max(_cards(text, at), default=(True, 0))
    if not best[0]:
        for g in _GROUP.finditer(text, at, best[1]):
            if g.start() > at and any(issued for issued, _ in _cards(text, g.start())):
                return 0
    return best[1]


def _account(text: str, at: int, end: int) -> int:
    """The end of the account number that begins at ``at`` and ends at ``end`` or a group before it, or 0."""
    ends = [end, *(k for k in range(end - 1, at, -1) if text[k] == " ")]
    if known := ACCOUNT_LENGTH.get(text[at:at + 2]):
        # by the length of its country, else all of it
        ends = [k for k in ends if len(normal("iban", text[at:k])) == known] + ends[:1]
    return next((k for k in ends if k - at > 11 and is_valid("iban", normal("iban", text[at:k]))), 0)


def _titled(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind); persons with a title only. After a candidate that fails its check the search goes on one character after
    its start."""
    out, at, pattern = [], 0, candidates(text)
    while pattern and (m := pattern.search(text, at)):
        a, b, kind = m.start(), m.end(), m.lastgroup
        if kind == "number":
            b = _card(text, a)
        elif kind == "iban":
            b = _account(text, a, b)
        elif kind == "ip6":
            b = next((k for k in (b, b - 1) if is_address(text[a:k])), 0)
        if b:
            out.append((a, b, kind))
        at = b or a + 1
    return out


def _names(text: str, a: int, b: int) -> tuple[str, list[tuple[int, int, str]]]:
    """The sex that the titles of a person tell (or none), and (start, end, kind) of the names; of several
    the last one is the last name."""
    end = _TITLED.match(text, a, b).end()
    told = {t.lower() for t in re.findall(r"[\w-]+", text[a:end])}
    sex = "f" if told & set(TITLES["f"]) else "m" if told & set(TITLES["m"]) else ""
    names = [(*m.span(m.lastgroup), m.lastgroup) for m in _NAME.finditer(text, end, b)]
    words = [x for x in names if x[2] == "word"]
    return sex, [(i, j, k if k == "initial" else "last" if (i, j, k) == words[-1] else "first") for i, j, k in names]


def _sex_of(first: str) -> str:
    return "f" if first[-1:] in "aая" else "m"


def mentions(text: str) -> list[tuple[int, int, str, list[tuple[int, int, str, str, str]]]]:
    """(start, end, kind, pieces) of what is replaced, from left to right; pieces are (start, end, kind,
    normal form, sex). A person's pieces are the names."""
    spans = _titled(text)
    persons = {(a, b): _names(text, a, b) for a, b, k in spans if k == "person"}
    if not persons:
        return [(a, b, k, [(a, b, k, normal(k, text[a:b]), "")]) for a, b, k in spans]
    first, last = {}, {}  # name: its sex, as the text tells it
    for sex, names in persons.values():
        for i, j, kind in names:
            for known in [first] if kind == "first" else [last] if kind == "last" and len([x for x in names if x[2] != "initial"]) > 1 else []:
                known[text[i:j].lower()] = known.get(text[i:j].lower()) or sex
    for sex, names in persons.values():  # one name after a title: a first name if the text has it as such only
        for i, j, kind in names:
            if kind == "last" and len([x for x in names if x[2] != "initial"]) == 1:
                name = text[i:j].lower()
                known = last if name in last or name not in first else first
                known[name] = known.get(name) or sex
    pieces_of = lambda names, sex: [
        (i, j, *(("initial", n, "") if kind == "initial" else ("first", f"{first[n] or sex or _sex_of(n)} {n}", "") if n in first and (kind == "first" or n not in last)
                 else ("last", normal("last", n), sex or last[n] or _sex_of(n) * bool(re.search("(?:ова|ева|ёва|ина|ына|ая)$", n)))))
        for i, j, kind in names for n in [text[i:j].lower()]]
    out = [(a, b, k, pieces_of(persons[a, b][1], persons[a, b][0]) if k == "person" else [(a, b, k, normal(k, text[a:b]), "")]) for a, b, k in spans]
    # names without a title: as they were introduced, capitalised or in capitals; lower-case ones are words
    known = {w for _, names in persons.values() for i, j, k in names if k != "initial" and not text[i].islower() and j - i > 1 for w in (text[i:j], text[i:j].upper(), text[i:j].capitalize(), text[i:j].title())}
    if known:
        taken = iter([*spans, (len(text) + 1, len(text) + 1, "")])
        a, b, _ = next(taken)
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=lambda w: (-len(w), w))))})(?!\w)", text):
            while b <= m.start():
                a, b, _ = next(taken)
            if m.end() <= a:
                out.append((*m.span(), "person", pieces_of([(*m.span(), "first" if m[0].lower() in first and m[0].lower() not in last else "last")], "")))
    return sorted(out)


def found(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind)."""
    return [m[:3] for m in mentions(text)]


def _entities(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, norm), distinct per text."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, k, n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t
                    for k, n in dict.fromkeys((k, n) for *_, pieces in mentions(t) for _, _, k, n, _ in pieces if k != "initial")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "kind", "norm"])

    return docs.select("doc_id", "text").mapInArrow(detect, "doc_id long, kind string, norm string")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, turn) with the surrogate of that turn and the entity's place in line."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, norm, turn = (batch.column(i).to_pylist() for i in range(3))
            new = [surrogate(k, n, key, t) for k, n, t in zip(kind, norm, turn)]
            line = [hmac.new(key, f"line {k} {n}".encode(), hashlib.sha256).hexdigest() for k, n in zip(kind, norm)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string()), pa.array(line, pa.string())], names=["kind", "norm", "turn", "new", "line"])

    return entities.select("kind", "norm", "turn").mapInArrow(draw, "kind string, norm string, turn int, new string, line string")


def redraws(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, norm, turn) of the entities whose first surrogate was taken. ``entities`` is distinct
    (kind, norm). Each round only the losers of the last draw again, until there are none."""
    drawn = stored(_drawn(entities.withColumn("turn", F.lit(0)), key), "surrogate-draws")
    real = entities.select("kind", F.col("norm").alias("new"), F.lit("").alias("line"))
    while True:
        # of equal strings the first in line keeps it; real entities stand before all
        first = drawn.select("kind", "new", "line").unionByName(real).groupBy("kind", "new").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        lost = stored(drawn.join(first, ["kind", "new"]).filter(F.col("line") > F.col("first")).select("kind", "norm", F.col("turn") + 1), "surrogate-lost")
        lost = lost.toDF("kind", "norm", "turn")
        if lost.isEmpty():
            return drawn.filter("turn > 0").select("kind", "norm", "turn")
        drawn = stored(drawn.join(lost.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(_drawn(lost, key)), "surrogate-draws")


def replaced(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` (doc_id, text and others) with surrogates in the text, and ``entities``."""
    arrow_rows(docs.sparkSession)
    df, to = renamed(docs.drop("entities"))
    where = stored(_entities(docs), "surrogate-entities")
    again = redraws(where.select("kind", "norm").distinct(), key)
    per_doc = stored(where.join(again, ["kind", "norm"]).groupBy("doc_id").agg(
        F.collect_set(F.struct("kind", "norm", "turn")).alias("_turns")).withColumnRenamed("doc_id", "_turn_id"), "surrogate-turns")
    body = to.pop("text")
    df = df.join(per_doc, df[to["doc_id"]].eqNullSafe(per_doc["_turn_id"]), "left").select(F.col(body).alias("text"), "_turns", *to.values())

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turn = {(t["kind"], t["norm"]): t["turn"] for t in turns or []}
                spans = mentions(text) if text else []
                out, at = [], 0
                for a, b, kind, norm, sex in (p for *_, pieces in spans for p in pieces):
                    out += [text[at:a], written(kind, text[a:b], surrogate(kind, norm, key, turn.get((kind, norm), 0)), sex)]
                    at = b
                texts.append("".join([*out, text[at:]]) if spans else text)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:], pa.array(counts, pa.int64())],
                                             names=["text", *batch.schema.names[2:], "entities"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[2:])
    out = df.mapInArrow(replace, f"text string, {fields}, entities long")
    names = [c for c in docs.columns if c != "entities"]
    return out.select(*[F.col(to.get(c, c)).alias(c) for c in names], "entities")


@query("op7_surrogates")
def op7_surrogates(spark, sf_dir):
    """Every document with surrogates for its personal data."""
    return replaced(read(spark, sf_dir, "documents").select("doc_id", "text"))
