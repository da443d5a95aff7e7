"""PII surrogates: detected entities get keyed, type-consistent replacements.

Numbers, addresses and secrets: a surrogate is a keyed permutation of the strings with the entity's shape (a Feistel
network over its digits and letters, each staying in its class), so that equal entities get equal surrogates and
different ones of a shape can't meet. Separators, case, script, an e-mail's top-level domain, a phone number's country
code, the range of a private IP address, a card's first digit and the check digits of cards and IBANs stay consistent.

Names: every word of a name is an entity of its own, a given name (of a gender, by its title or else its last letter) or
a surname. So "Mrs. Maria Lopez", "Mrs. Lopez", "Maria" and "Lopez" fit together, in all documents. The surrogate is
picked by key from given names of that gender, or built from syllables of surnames, in the same script; in scripts
without such lists letters are permuted within the script, and the last one, which carries gender in many, stays.

What the permutation can't rule out, a surrogate that some other text holds as its original, or that two entities share,
is looked for over all entities; the losers are drawn again until there are none. A shape that is mostly in use has no
room for that: from the WIDEN-th draw on, the surrogate has a letter or digit more, and another one every few draws;
names get a further part with every draw.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Entities drawn again that are broadcast at most (about 60 bytes each); beyond, they are joined to their documents.
BROADCAST_AGAIN = 1 << 17
#: Draws before a surrogate gets longer, and draws until it does so again.
WIDEN, WIDEN_AGAIN = 8, 4


def _runs(codes: list[int]) -> list[tuple[int, int]]:
    """(first, last) of each unbroken run in sorted numbers."""
    ends = [k for k, (a, b) in enumerate(zip(codes, [*codes[1:], -1], strict=True)) if b != a + 1]
    return [(codes[a], codes[b]) for a, b in zip([0, *(k + 1 for k in ends)], ends, strict=False)]


#: The zeros of all scripts; their digits follow in order, as \\d finds them.
_ZEROS = [k for k in range(sys.maxunicode + 1) if unicodedata.decimal(chr(k), -1) == 0]
_UPTO = lambda a, b: "[" + "".join(f"{chr(z + a)}-{chr(z + b)}" for z in _ZEROS) + "]"
_OCTET = rf"(?:{_UPTO(2, 2)}{_UPTO(5, 5)}{_UPTO(0, 5)}|{_UPTO(2, 2)}{_UPTO(0, 4)}\d|{_UPTO(1, 1)}?\d?\d)"
_MALE = r"Mr|Herr|Monsieur|M(?=\.)|Señor|Sr|श्री"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|श्रीमती|सुश्री"
_TITLES = rf"{_MALE}|{_FEMALE}|Dr|Prof"
#: Combining marks (vowel signs, among others) and joiners, which names hold besides letters.
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in _runs([k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k))[0] == "M"])) + "\u200c\u200d"
#: A name's word, with hyphens and apostrophes inside.
_NAME = rf"{{}}(?:[^\W\d_]|[{_MARKS}]|['’-](?=[^\W\d_]))+"
_PATTERN = re.compile(
    rf"""(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{{2,}})
    |(?<![\w.])(?=\d)(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?![\w]|\.\d)
    |(?<![\w+])(?P<phone>\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|\(\d{{3}}\)[ ]?\d{{3}}[ .-]\d{{4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}})(?!\w)
    |(?<![\w-])(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})(?![\w-])
    |(?<![\w-])(?P<iban>[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{3,7}}(?:[ ]?[A-Z0-9]{{1,3}})?)(?!\w)
    |(?<![\w-])(?P<card>\d(?:[ -]?\d){{12,18}})(?![\w-])
    |(?i:\b(?:token|secret|password|passwd|api_?key|access_?key)\b\s*[=:]\s*["']?)(?P<secret>[^\s"']{{8,}})
    |(?<!\w)(?P<hex>[0-9a-f]{{32,}}|[0-9A-F]{{32,}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_\w{{36,}})(?!\w)
    |(?<!\w)(?:(?P<male>{_MALE})|(?P<female>{_FEMALE})|Dr|Prof)\.?[ ](?P<person>(?!(?:{_TITLES})\b)(?:{_NAME.format("[^\\W\\d_a-zß-ÿ]")}(?:[ ](?!(?:{_TITLES})\b){_NAME.format("[A-ZÀ-Þ]")}){{0,2}}|[\u0900-\u097f]{{2,}}))""",
    re.VERBOSE,
)
#: What any match of the pattern holds.
_WORTH = re.compile(rf"[\d@]|(?:{_TITLES})[. ]|(?i:token|secret|passw|key)|AKIA|gh[pousr]_|[a-f]{{32}}|[A-F]{{32}}")
_HEX = re.compile("[0-9a-f]+")
#: Letters change within their class: lower-case vowels and consonants of Latin, marked Latin, Cyrillic, Greek, Devanagari consonants.
#: All other letters change within their script and category.
_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåéèêëíìîïóòôöõúùûü", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x915, 0x93A)))]
_CLASS = {c: k for k, cs in enumerate(_CLASSES) for c in cs}
_FREE = "abcdefghijklmnopqrstuvwxyz"
#: Signs of a secret that has nothing else to change.
_SIGNS = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_POOLS: dict[tuple, str] = {}


# Given names that stand for others, by script and gender, and the syllables of surnames.
_GIVEN = {
    "LATIN": {
        "f": "alma berta clara dora edith flora greta hilda irma julia karla lydia marta nora olga paula rosa sofia thea ursula vera wilma",
        "m": "albert bruno conrad david emil felix gustav hugo ivan julius karl leon martin norbert oskar paul robert simon theo viktor walter",
    },
    "DEVANAGARI": {"f": "आशा उषा कमला गीता तारा नीता पूजा माया रमा राधा रेखा लता सीता सुधा", "m": "अजय अनिल अमर करण गोपाल दीपक मोहन रमण राकेश राजन विजय विनोद सुनील हरीश"},
    "CYRILLIC": {"f": "анна вера дарья елена ирина клара лидия мария нина ольга раиса тамара", "m": "антон борис виктор глеб денис егор иван лев максим олег павел роман"},
}
_SURNAMES = {
    "LATIN": ("al ber cor dal el fal gar hal jor kel lor mar nel or pol ral sel tar ver wal", "a ba de di fa go ka la le mo na ra ri so ta va", "ber din lin man mer nik rand sen ser son ter wald"),
    "DEVANAGARI": ("अर कम गोप चंद देव नार पर बल मह रत सह हर", "ण न म ल व स", "कर पाल राज वाल"),
    "CYRILLIC": ("ал бор вор гор дан зар кар лаз мор ник пол рад сав тар", "а е и о", "нин рин кин лев сов тов"),
}


def _gender(word: str, title: str | None) -> str:
    """Of a given name: what the title says, or else its last letter."""
    return title or ("f" if word[-1].lower() in "aeáéàèiyаяαηाी" else "m")


def _person(text: str, m: re.Match) -> list[tuple[str, int, int]]:
    """The words of a name: the last one is the surname."""
    start, words, out = m.start("person"), m["person"].split(" "), []
    title = "m" if m["male"] else "f" if m["female"] else None
    for k, word in enumerate(words):
        out.append(("surname" if k == len(words) - 1 else f"given_{_gender(word, title)}", start, start + len(word)))
        start += len(word) + 1
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities, from left to right. Names that come with a title are also found without it, as the same words elsewhere in the text."""
    if not text or not _WORTH.search(text):
        return []
    out, names = [], {}
    for m in _PATTERN.finditer(text):
        if m["person"]:
            out += (own := _person(text, m))
            names |= {w: kind for kind, a, b in own if len(w := text[a:b]) > 2}
        elif not (m["card"] and not _is_card(m["card"])):
            out.append((m.lastgroup, *m.span(m.lastgroup)))
    if names:
        taken, more = {a for _, a, _ in out}, re.compile(rf"(?<![\w{_MARKS}])(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?![\w{_MARKS}])")
        inside = lambda a: any(x <= a < y for _, x, y in out)
        out += [(names[m[0]], *m.span()) for m in more.finditer(text) if m.start() not in taken and not inside(m.start())]
    return sorted(out, key=lambda x: x[1])


def _is_card(mention: str) -> bool:
    digits = canonical("card", mention)
    return _luhn(digits[:-1]) == digits[-1]


def _ascii(text: str) -> str:
    """Digits of any script as 0 to 9."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def _script(digit: str, like: str) -> str:
    """The digit 0 to 9 in the script of ``like``, if that is a digit."""
    return chr(ord(like) - unicodedata.decimal(like) + int(digit)) if like.isdecimal() and digit.isdecimal() else digit


def _family(c: str) -> tuple:
    """A letter's script and category, within its row of the code table (Chinese and Korean: all of the block)."""
    block = next((b for b in ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3)) if b[0] <= ord(c) <= b[1]), (ord(c) & ~127, ord(c) | 127))
    # Letters that case folding would merge with others have a family of their own.
    return unicodedata.name(c, "").split(" ")[0].split("-")[0], unicodedata.category(c), c.upper().lower() == c or c.lower().upper() == c, block


def _pool(c: str) -> str:
    """The letters that a letter outside of _CLASSES can change into, itself among them."""
    family = _family(c)
    if family not in _POOLS:
        first, last = family[-1]
        own = [x for x in map(chr, range(first, last + 1)) if x.isalpha() and x not in _CLASS and x.lower() not in _CLASS and _family(x) == family]
        _POOLS[family] = "".join(own)
    # A letter with no other of its kind changes into a Latin one; the check over all entities keeps that distinct.
    return _POOLS[family] if len(_POOLS[family]) > 1 else c + _FREE


def canonical(kind: str, mention: str) -> str:
    """What two mentions of one entity share: digits of numbers (in any script), lower case of names and addresses."""
    if kind in ("phone", "card", "ssn"):
        return "+" * (kind == "phone" and mention[0] == "+") + "".join(c for c in _ascii(mention) if c.isdecimal())
    if kind == "iban":
        return _ascii(mention.replace(" ", ""))
    if kind == "ip":
        return ".".join(str(int(x)) for x in mention.split("."))
    return mention if kind in ("secret", "hex") or len(mention.lower()) != len(mention) else mention.lower()


def _feistel(value: int, left: int, right: int, tweak: bytes, key: bytes) -> int:
    """A permutation of [0, left * right)."""
    a, b = divmod(value, right)
    for turn in range(6):
        mix = lambda x: int.from_bytes(hashlib.blake2b(b"%d|%d|" % (turn, x) + tweak, key=key, digest_size=64).digest())  # noqa: B023, E731
        if turn % 2:
            a = (a + mix(b)) % left
        else:
            b = (b + mix(a)) % right
    return a * right + b


def _luhn(digits: str) -> str:
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


# The country codes of one and of two digits; all others have three.
_ONE_DIGIT = "1 7"
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
# Ranges of private, local and link-local addresses.
_PRIVATE = ((0x0A000000, 8), (0xAC100000, 12), (0xC0A80000, 16), (0x7F000000, 8), (0xA9FE0000, 16))


def _country(phone: str) -> int:
    """How many characters of a phone number stay: plus sign and country code, or else the first digit."""
    if phone[0] != "+":
        return 1
    return 2 if phone[1:2] in _ONE_DIGIT.split() else 3 if phone[1:3] in _TWO_DIGITS.split() else 4


def _range(ip: int) -> tuple[int, int]:
    return next(((base, bits) for base, bits in _PRIVATE if ip >> (32 - bits) == base >> (32 - bits)), (0, 0))


def _ip(entity: str, tweak: bytes, key: bytes) -> str:
    """An address of the same range: a permutation that is walked until it is back in it."""
    value = 0
    for part in entity.split("."):
        value = value << 8 | int(part)
    base, bits = own = _range(value)
    half = (32 - bits) // 2
    low, rest = 1 << half, 1 << (32 - bits - half)
    while True:
        value = base | _feistel(value & ((1 << (32 - bits)) - 1), low, rest, tweak, key)
        if _range(value) == own:
            return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _iban_check(entity: str) -> str:
    """The check digits of an IBAN, from its other characters."""
    number = "".join(str(int(c, 36)) for c in entity[4:] + entity[:2] + "00")
    return f"{98 - int(number) % 97:02d}"


def _name(kind: str, word: str, attempt: int, key: bytes) -> str | None:
    """A name's surrogate from the lists of its script, with a part more for each attempt; None if there are no lists."""
    script = unicodedata.name(word[0], "").split(" ")[0]
    if script not in _GIVEN:
        return None
    draw = int.from_bytes(hashlib.blake2b(f"{kind}|{attempt}|{word}".encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest())
    parts = []
    for _ in range(attempt + 1):
        part = ""
        for table in _SURNAMES[script] if kind == "surname" else (_GIVEN[script][kind[-1]],):
            draw, k = divmod(draw, len(table.split()))
            part += table.split()[k]
        parts.append(part)
        if not draw:
            draw = int.from_bytes(hashlib.blake2b("-".join([word, *parts]).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest())
    return "-".join(parts)


def _room(kind: str, text: str, checked: bool = False) -> int:
    """Where a longer surrogate has its further letters: before what stays at the end."""
    return text.rindex("@") if kind == "email" else len(text) - (kind in _NAMES or checked)


_NAMES = ("given_f", "given_m", "surname")


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """Of a canonical entity: another of the same type and shape, or from the WIDEN-th attempt on of a longer one (but for IPs)."""
    tweak, entity_given = f"{kind}|{attempt}|".encode(), entity
    if kind == "ip":
        return _ip(entity, tweak, key)
    if kind in _NAMES and (name := _name(kind, entity, attempt, key)):
        return name
    keep = set(range(_country(entity))) if kind == "phone" else {0, 1, 2, 3} if kind == "iban" else {len(entity) - 1} if kind in _NAMES and entity[-1] < "\u3040" else set()
    if kind == "email":
        keep = set(range(entity.rindex("."), len(entity)))
    checked = kind == "card" and _luhn(entity[:-1]) == entity[-1]
    if checked:
        keep = {0, len(entity) - 1}
    hexadecimal = kind in ("hex", "secret") and _HEX.fullmatch(entity)
    alphabets: list[tuple[int, str]] = []
    for k, c in enumerate(entity):
        if k in keep:
            continue
        if hexadecimal:
            alphabets.append((k, "0123456789abcdef"))
        elif kind in ("secret", "iban", "hex") and c.isascii() and c.isalpha():
            alphabets.append((k, _FREE if c.islower() else _FREE.upper()))
        elif c.isdecimal():
            alphabets.append((k, "".join(_script(d, c) for d in "0123456789")))
        elif c in _CLASS:
            alphabets.append((k, _CLASSES[_CLASS[c]]))
        elif c.lower() in _CLASS and len(c.lower()) == 1:
            alphabets.append((k, _CLASSES[_CLASS[c.lower()]].upper()))
        elif c.isalpha():
            alphabets.append((k, _pool(c)))
    alphabets = [(k, a) for k, a in alphabets if entity[k] in a]
    if kind == "secret" and not alphabets:
        alphabets = [(k, _SIGNS) for k, c in enumerate(entity) if c in _SIGNS]
    # The shape goes into the key: strings of one shape permute among themselves.
    shape = "".join("\0" if k in dict(alphabets) else c for k, c in enumerate(entity))
    if attempt >= WIDEN:
        more, at = 1 + (attempt - WIDEN) // WIDEN_AGAIN, _room(kind, entity, checked)
        wide = "0123456789" if kind in ("phone", "card", "ssn", "iban") else max((a for _, a in alphabets), key=len, default=_FREE)
        entity = entity[:at] + wide[0] * more + entity[at:]
        alphabets = sorted([(k + more * (k >= at), a) for k, a in alphabets] + [(at + k, wide) for k in range(more)])
    half, sizes = len(alphabets) // 2, [1, 1]
    value = 0
    for i, (k, a) in enumerate(alphabets):
        value = value * len(a) + a.index(entity[k])
        sizes[i >= half] *= len(a)
    value = _feistel(value, *sizes, tweak + shape.encode("utf-8", "surrogatepass"), key)
    out = list(entity)
    for k, a in reversed(alphabets):
        value, r = divmod(value, len(a))
        out[k] = a[r]
    text = "".join(out)
    if kind == "iban" and _iban_check(entity_given) == entity_given[2:4]:
        return text[:2] + _iban_check(text) + text[4:]
    return text[:-1] + _luhn(text[:-1]) if checked else text


def render(kind: str, mention: str, new: str) -> str:
    """The surrogate in the mention's format: its separators, its case and its digits' script."""
    if kind in ("secret", "hex"):
        return new
    if kind == "ip":
        return ".".join("".join(_script(d, old[0]) for d in octet) for old, octet in zip(mention.split("."), new.split("."), strict=True))
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(new.lstrip("+"))
        same = "".join(_script(next(rest), c) if c.isalnum() else c for c in mention)
        return same + "".join(_script(c, mention[-1]) for c in rest)
    if kind in _NAMES and (unicodedata.name(mention[0], "").split(" ")[0] in _GIVEN):
        return new.upper() if mention.isupper() and len(mention) > 1 else "-".join(p[0].upper() + p[1:] for p in new.split("-"))
    at = _room(kind, mention)
    mention = mention[:at] + mention[at] * (len(new) - len(mention)) + mention[at:]
    return "".join(n.upper() if c != c.lower() and len(n.upper()) == 1 else n for c, n in zip(mention, new, strict=True))


def rewrite(text: str | None, again: dict[tuple[str, str], int], key: bytes) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and where they are in it. ``again``: the attempt of entities that were drawn again."""
    out, at, size, spans = [], 0, 0, []
    for kind, start, end in find(text):
        mention = text[start:end]
        entity = canonical(kind, mention)
        new = render(kind, mention, surrogate(kind, entity, again.get((kind, entity), 0), key))
        out += [text[at:start], new]
        size += start - at
        spans.append({"kind": kind, "start": size, "end": size + len(new), "surrogate": new})
        size, at = size + len(new), end
    return ("".join([*out, text[at:]]) if spans else text), spans


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "_text"):
        got = sorted({(kind, canonical(kind, t[a:b])) for t in batch.column(0).to_pylist() for kind, a, b in find(t)})
        yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in (0, 1)], ["kind", "entity"])


def attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) of the entities that need another draw: distinctness over all distinct (kind, entity).

    It ends when there are no losers: longer surrogates leave ever more room (an IP has 2**32 values and stays as long).
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(*r, key) for r in rows], pa.string())], [*batch.schema.names, "new"])

    state = entities.select("kind", "entity", F.lit(0).alias("attempt"))
    while True:
        drawn = materialize(state.mapInArrow(draw, "kind string, entity string, attempt int, new string"), "surrogates")
        shared = drawn.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("entity").alias("first")).where("n > 1")
        twice = drawn.join(shared, ["kind", "new"]).where("entity <> first").select("kind", "entity")
        real = drawn.join(entities.select("kind", F.col("entity").alias("new")), ["kind", "new"], "left_semi").select("kind", "entity")
        losers = materialize(twice.union(real).distinct(), "losers")
        if losers.isEmpty():
            return drawn.where("attempt > 0").select("kind", "entity", "attempt")
        state = drawn.join(losers.withColumn("lost", F.lit(1)), ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt"))


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, entities (kind, start, end, surrogate) for every row of ``docs``. ``key``, at most 64 bytes, must be kept secret.

    Card numbers are only those whose check digit is right. Null texts stay null, texts without entities as they are, both with an empty list; equal entities get equal
    surrogates in all rows, repeated rows equal texts. Vowel signs and other marks stay.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    entities = materialize(docs.select(F.col(text_col).alias("_text")).mapInArrow(_entities, "kind string, entity string").distinct(), "entities")
    again = materialize(attempts(entities, key), "again")
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
    schema = f"_id {kind}, text string, entities array<struct<kind:string,start:int,end:int,surrogate:string>>"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fits = again.limit(BROADCAST_AGAIN + 1).count() <= BROADCAST_AGAIN
    common = docs.sparkSession.sparkContext.broadcast({(r.kind, r.entity): r.attempt for r in again.collect()} if fits else {})
    if fits:
        rows = rows.withColumn("_again", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "_text"):
                got = [(r, *e) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in sorted({(k, canonical(k, t[a:b])) for k, a, b in find(t)})]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[i] for g in got], pa.string()) for i in (1, 2))], ["_row", "kind", "entity"])

        held = rows.select("_row", "_text").mapInArrow(mentions, "_row long, kind string, entity string").join(again, ["kind", "entity"])
        rows = rows.join(held.groupBy("_row").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("_again")), "_row", "left").drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            own = [common.value if x is None else {(e["kind"], e["entity"]): e["attempt"] for e in x} for x in batch.column(2).to_pylist()]
            got = [rewrite(t, x, key) for t, x in zip(batch.column(1).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], spans)], ["_id", "text", "entities"])

    return rows.select("_id", "_text", "_again").mapInArrow(run, schema).withColumnRenamed("_id", id_col)
