"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern.  A surrogate is a keyed bijection of the
entity's own symbols, so it has the same type, script and format; the same
entity gets the same surrogate everywhere (coreference) and different entities
of a format get different ones (distinctness) without any table.

The bijection is a Feistel network of ROUNDS rounds over the symbols: one half
is shifted, each symbol within its own alphabet, by a keystream that the other
half fixes; then all symbols take one step, and the rounds go back, so that nothing
stays as it was.  Letters of any script below U+10000 move among those of their script and
case; of others (and marks) an entity keeps what it has.  Cards keep the distance of their last digit from the check digit,
addresses run over all 32-bit numbers, known first names are permuted within
their gender and script; a made-up name that happens to be a known one is
shifted again.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.quality import bind

#: Rounds there and rounds back; those of addresses.
ROUNDS, IP_ROUNDS = 2, 4
#: Most applications of the bijection to one entity until it leaves a forbidden set; each is needed with
#: probability below 1/4, so a walk of this length never ends early in practice (below 1e-38).
WALK = 64
#: Keys that are tried until no two entities have one surrogate.
TRIES = 8
ONLY_HEX = "^[0-9a-fA-F]+$"
DIGITS = "0123456789"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
ALPHABETS = [DIGITS, LOWER, UPPER, CYRILLIC, CYRILLIC.upper(), GREEK, GREEK.upper()]
HEX = [DIGITS, "abcdef", "ABCDEF"]
#: In made-up names vowels stay vowels and consonants consonants.
SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
#: Characters that no alphabet holds: all but digits and the letters below U+10000.
OTHER = r"(?:[^0-9\p{L}]|[\x{10000}-\x{10FFFF}])"
#: Letters of a script and case in a row from which they are an alphabet of code points, not a string.
MANY = 20


def _other_letters() -> tuple[list[str], list[tuple[int, int]]]:
    """All other letters below U+10000 by script and case (the first word of their names, and their category), and runs of many in a row."""
    groups: dict[tuple, list[int]] = {}
    for c in range(0x80, 0x10000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L" and chr(c) not in "".join(ALPHABETS):
            ch, script = chr(c), unicodedata.name(chr(c), "?").split()[0].split("-")[0]
            there = ch.upper() if kind == "Ll" else ch.lower()
            back = len(there) == 1 and (there.lower() if kind == "Ll" else there.upper()) == ch  # its case can be turned and turned back
            groups.setdefault((script, kind, back, c < 0x180, c >= 0xF900), []).append(c)
    small, runs = [], []
    for letters in groups.values():
        cuts = [0, *(i for i in range(1, len(letters)) if letters[i] != letters[i - 1] + 1), len(letters)]
        rest = []
        for a, z in zip(cuts, cuts[1:]):
            if z - a >= MANY:
                runs.append((letters[a], letters[z - 1]))
            else:
                rest += letters[a:z]
        if rest:
            small.append("".join(map(chr, rest)))
    return small, runs


LETTERS, RUNS = _other_letters()

#: First names by gender and script; a known name stays within its list.
FIRST_NAMES = {
    ("m", "latin"): "James John Robert Michael William David Thomas Peter Paul Hans Karl Otto Pierre Jean Luis Carlos Jorge Juan".split(),
    ("f", "latin"): "Mary Anna Linda Susan Sarah Karen Nancy Emma Julia Laura Greta Heike Marie Claire Sofia Carmen Elena Maria".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Николай Павел Олег".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Вера".split(),
}
TITLES = r"Dr\.?|Prof\.?|Doctor|Professor"
TITLES_M = r"Mr\.?|Herr|Monsieur|Señor|Sr\.|господин"
TITLES_F = r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Sra\.|госпожа"

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"[\p{L}0-9._%+'-]*[\p{L}0-9_%+-]@(?:[\p{L}0-9-]+\.)+\p{L}{2,}"
KNOWN = "|".join(n for names in FIRST_NAMES.values() for n in dict.fromkeys(names))
SURNAME = r"\p{Lu}[\p{L}'-]+"
NAMED = rf"(?:{TITLES_M}|{TITLES_F}|{TITLES}) {SURNAME}(?: {SURNAME})?"
SECRET_LEAD = r"(?i:pass(?:word|wd)?|pwd|secret|token|(?:api|access|secret|auth)[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
PATTERNS = {
    "secret": rf"{SECRET_LEAD}[A-Za-z0-9+/_.~-]{{6,}}",
    "email": EMAIL,
    "cloud_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "prefixed_key": r"(?:gh[pousr]_|sk-|pk-|xox[abp]-)[A-Za-z0-9_-]{16,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![:0-9A-Za-z])",
    "mac": r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![:0-9A-Za-z])",
    "hex_key": r"(?=[a-f]*\d)[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "ip": rf"{OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)",
    "card": r"(?:3[47]\d{2}[ -]\d{6}[ -]\d{5}|[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{9,15}|\+\d{1,3}(?:[ .-]\d{2,8}){2,5}|\+\d{1,3}[ .-]\d(?:[ .-]\d{2,4}){3,5}|0\d(?:[ .-]\d{2}){4}|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|[2-9]\d{9}|[2-9]\d{2}-\d{4})(?![\w-])",
    "name": rf"(?:{NAMED}|(?:{KNOWN}) {SURNAME}(?![\p{{L}}\p{{N}}_]))",
}
#: An entity starts where no word, dot-joined number or address goes on.
START = r"(?<![\p{L}\p{N}_@+]|\d\.)"
ANY = START + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: The same without names that have no title: for texts that hold no known first name.
TITLED = START + "(?:" + "|".join(f"(?:{p if k != 'name' else NAMED})" for k, p in PATTERNS.items()) + ")"
#: Strings without which there is no entity, as a cheap first look.
HINT_KEYS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "pk-", "xoxa-", "xoxb-", "xoxp-"]
HINT_TITLES = ["Mr", "Ms", "Miss ", "Herr ", "Frau ", "Monsieur ", "Mad", "Señor", "Sr", "господин ", "госпожа ", "Dr", "Prof", "Doctor"]


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _tables(alphabets: list[str], hexed: Column | None) -> Column:
    """The alphabets (and, but for hex digits, all other letters by script and case), one after another in one string; at the
    same places of two others stand, as code points, where an alphabet begins and its size.  Those of hex digits where hexed."""

    def of(groups: list[str], more: bool) -> Column:
        begins = [sum(map(len, groups[:k])) + 1 for k in range(len(groups))]
        parts = {"every": groups, "first": [chr(a) * len(g) for a, g in zip(begins, groups)], "size": [chr(len(g)) * len(g) for g in groups]}
        return F.struct(*[F.lit("".join(x)).alias(k) for k, x in parts.items()], F.lit(more).alias("more"))

    plain = of(alphabets + LETTERS, True)
    return plain if hexed is None else F.when(hexed, of(HEX, False)).otherwise(plain)


def _shift_char(ch: Column, by: Column, tables: Column) -> Column:
    """ch moved on in its alphabet."""
    number = lambda k, i: F.ascii(F.substr(tables[k], i, F.lit(1)))
    moved = lambda i: bind(number("first", i), lambda a: F.substr(tables["every"], a + F.pmod(i - a + by, number("size", i)), F.lit(1)))
    other = F.when(tables["more"] & ch.rlike(r"\p{L}"), bind(F.ascii(ch), lambda c: _shift_code(ch, c, by))).otherwise(ch)
    return bind(F.instr(tables["every"], ch), lambda i: F.when(ch == "", ch).when(i > 0, moved(i)).otherwise(other))


def _shift_code(ch: Column, code: Column, by: Column) -> Column:
    """A letter of one of the RUNS, moved on within it."""
    lows, highs = (F.split(F.lit(",".join(str(r[k]) for r in sorted(RUNS))), ",").cast("array<int>") for k in (0, 1))

    def of(x: Column) -> Column:
        low, high = F.get(x["lows"], x["k"] - 1), F.get(x["highs"], x["k"] - 1)
        new = F.decode(F.unhex(F.lpad(F.hex((low + F.pmod(code - low + by, high - low + 1)).cast("long")), 4, "0")), "UTF-16BE")
        return F.when(code <= high, new).otherwise(ch)

    at = bind(lows, lambda x: F.struct(x.alias("lows"), highs.alias("highs"), F.size(F.filter(x, lambda e: e <= code)).alias("k")))
    return bind(at, of)


def feistel(s: Column, key: str, salt: Column | str, hexed: Column | None = None, alphabets: list[str] = ALPHABETS) -> Column:
    """A keyed bijection of strings that keeps each character's alphabet, and no string that has a symbol; other characters stay.

    The rounds, a step of all symbols in their alphabets (by 1 to 4, as the key says), and the rounds back: as the step
    keeps nothing, the whole keeps nothing.  All turns are one expression within a fold: written out, they made plans of
    which the driver needs several hundred MB.
    hexed: a-f and A-F are alphabets of their own."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    half = F.floor(F.length(s) / 2).cast("int")
    step = 1 + hashlib.sha256(f"{key}|step".encode()).digest()[0] % 4
    parted = lambda v: F.struct(F.substr(v, F.lit(1), half).alias("a"), F.substr(v, half + 1).alias("b"))

    def turn(x: Column, t: Column, tables: Column) -> Column:
        """Turn t: rounds 0, 1, ..., the step (t = ROUNDS), rounds ..., 1, 0 back.  Even rounds move a by what b fixes, odd ones b."""
        r, all_ = F.least(t, 2 * ROUNDS - t), t == ROUNDS
        even = F.pmod(r, F.lit(2)) == 0
        seed = F.concat(F.lit(f"{key}|"), r.cast("string"), F.lit("|"), salt, F.lit("|"), F.when(even, x["b"]).otherwise(x["a"]), F.lit("|"))
        stream = bind(seed, lambda k: F.concat(F.sha2(F.concat(k, F.lit("a")), 256), F.sha2(F.concat(k, F.lit("b")), 256)))
        what = F.when(all_, F.concat(x["a"], x["b"])).when(even, x["a"]).otherwise(x["b"])
        sign = F.when(t < ROUNDS, 1).otherwise(-1)
        by = lambda k, i: F.when(all_, F.lit(step)).otherwise(F.conv(F.substr(k, F.pmod(3 * i, F.lit(120)) + 1, F.lit(3)), 16, 10).cast("int") * sign)
        moved = bind(stream, lambda k: F.array_join(F.transform(_chars(what), lambda ch, i: bind(by(k, i), lambda n: _shift_char(ch, n, tables))), ""))
        part = lambda m: F.when(all_, parted(m)).when(even, F.struct(m.alias("a"), x["b"].alias("b"))).otherwise(F.struct(x["a"].alias("a"), m.alias("b")))
        return bind(moved, part)

    turns = F.sequence(F.lit(0), F.lit(2 * ROUNDS))
    return bind(_tables(alphabets, hexed), lambda tables: F.aggregate(turns, parted(s), lambda x, t: turn(x, t, tables), lambda x: F.concat(x["a"], x["b"])))


def walk(s: Column, bad: Callable, turn: Callable) -> Column:
    """turn(s), and again while it is bad, at most WALK times: a bijection of what isn't bad."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), s, lambda acc, i: F.when((i == 1) | bad(acc), turn(acc)).otherwise(acc))


def _reinsert(shape: Column, symbols: Column) -> Column:
    """The shape with its symbols replaced one by one: the same symbols in another format stay the same."""
    seen = lambda i: F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), OTHER, ""))
    return F.array_join(F.transform(_chars(shape), lambda ch, i: F.when(ch.rlike(OTHER) | (ch == ""), ch).otherwise(F.substr(symbols, seen(i), F.lit(1)))), "")


def _check_digit(d: Column) -> Column:
    """The Luhn check digit for a string of digits."""
    at = lambda ch, i: F.pmod(F.length(d) - i, F.lit(2)) == 1  # noqa: E731  doubled: every second one from the last
    value = lambda ch, i: F.when(at(ch, i), F.floor(ch.cast("int") * 2 / 10) + F.pmod(ch.cast("int") * 2, F.lit(10))).otherwise(ch.cast("int"))
    total = F.aggregate(F.transform(_chars(d), value), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _card(e: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body, last = F.substr(d, F.lit(1), F.length(d) - 1), F.substr(d, F.length(d)).cast("int")
        off = last - _check_digit(body)
        # the first digit tells the kind of card and stays
        new = F.concat(F.substr(body, F.lit(1), F.lit(1)), feistel(F.substr(body, F.lit(2)), key, "card"))
        return bind(new, lambda n: F.concat(n, F.pmod(_check_digit(n) + off, F.lit(10)).cast("string")))

    return bind(bind(F.regexp_replace(e, "[^0-9]", ""), of), lambda d: _reinsert(e, d))


def _ip(e: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(e, r"\."), i).cast("int")
    out = F.struct((part(1) * 256 + part(2)).alias("a"), (part(3) * 256 + part(4)).alias("b"))
    f = lambda r, x: F.conv(F.substr(F.sha2(F.concat(F.lit(f"{key}|ip{r}|"), x.cast("string")), 256), F.lit(1), F.lit(4)), 16, 10).cast("int")

    def turn(r: int) -> Callable:  # of one parameter: transform gives an index to a second, and r would be that
        if r % 2 == 0:
            return lambda x: F.struct(F.pmod(x["a"] + f(r, x["b"]), F.lit(65536)).alias("a"), x["b"].alias("b"))
        return lambda x: F.struct(x["a"].alias("a"), F.pmod(x["b"] + f(r, x["a"]), F.lit(65536)).alias("b"))

    for r in range(IP_ROUNDS):
        out = bind(out, turn(r))
    low = lambda v: F.concat(F.floor(v / 256).cast("string"), F.lit("."), F.pmod(v, F.lit(256)).cast("string"))
    return bind(out, lambda x: F.concat(low(x["a"]), F.lit("."), low(x["b"])))


def _known(key: str) -> Column:
    """A map from known first names to their surrogates: each list in the order of keyed hashes."""
    pairs = []
    for (gender, script), names in FIRST_NAMES.items():
        by = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{gender}{script}|{n}".encode()).hexdigest())
        pairs += [(a, by[i - 1]) for i, a in enumerate(by)]  # a cycle: no name stays itself
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def _name(e: Column, key: str) -> Column:
    """The title stays; known first names go round in their list, others keep their last vowel, which tells gender."""
    title = F.regexp_extract(e, rf"^(?:{TITLES_M}|{TITLES_F}|{TITLES}) ", 0)

    def one(w: Column, known: Column) -> Column:
        def made(x: Column) -> Column:
            bad = lambda v: known[F.concat(v, x["end"])].isNotNull()
            return F.concat(walk(x["body"], bad, lambda v: feistel(v, key, "name", alphabets=SOUNDS)), x["end"])

        end = F.regexp_extract(w, "(?<=.)[aeiouаеиояαεηιο]$", 0)
        return F.coalesce(known[w], bind(F.struct(F.substr(w, F.lit(1), F.length(w) - F.length(end)).alias("body"), end.alias("end")), made))

    words = lambda t, known: F.transform(F.split(F.substr(e, F.length(t) + 1), " "), lambda w: one(w, known))
    return bind(_known(key), lambda known: bind(title, lambda t: F.concat(t, F.array_join(words(t, known), " "))))


def _capitals(e: Column, new: Column) -> Column:
    """new with capitals where e has them."""
    capital = lambda i: F.substr(e, i + 1, F.lit(1)).rlike(r"\p{Lu}")
    return F.array_join(F.transform(_chars(new), lambda ch, i: F.when(capital(i) & (F.length(F.upper(ch)) == 1), F.upper(ch)).otherwise(ch)), "")


#: What stays at the head of an entity: field names, key prefixes, countries.
LEADS = {"secret": SECRET_LEAD, "cloud_key": "AKIA|ASIA", "prefixed_key": r"gh[pousr]_|sk-|pk-|xox[abp]-", "iban": "[A-Z]{2}", "phone": r"\+\d{1,3}(?=[ .(-])|"}


def _general(e: Column, kind: Column, key: str) -> Column:
    """A head that stays, a body whose symbols go through the bijection, an email's top-level domain."""
    lead = F.lit("")
    for k, pattern in LEADS.items():
        lead = F.when(kind == k, F.regexp_extract(e, f"^(?:{pattern})", 0)).otherwise(lead)
    tail = F.when(kind == "email", F.regexp_extract(e, r"\.\p{L}+$", 0)).otherwise("")

    def of(x: Column) -> Column:
        body = F.substr(e, F.length(x["lead"]) + 1, F.length(e) - F.length(x["lead"]) - F.length(x["tail"]))
        body = F.when(kind == "email", F.lower(body)).otherwise(body)
        return F.struct(x["lead"].alias("lead"), body.alias("body"), x["tail"].alias("tail"))

    def made(x: Column) -> Column:
        symbols = F.regexp_replace(x["body"], OTHER, "")
        salt = F.when(kind.isin("secret", "hex_key"), "secret").otherwise(kind)  # a secret is one with or without its field

        def walked(s: Column) -> Column:
            """Hex digits stay hex digits; other symbols walk on while they look like hex digits."""
            hexed = kind.isin("secret", "mac", "ipv6", "hex_key") & s.rlike(ONLY_HEX)
            bad = lambda v: ~hexed & v.rlike(ONLY_HEX) & kind.isin("secret", "mac", "ipv6", "hex_key")
            return walk(s, bad, lambda v: feistel(v, key, salt, hexed))

        return F.concat(x["lead"], _reinsert(x["body"], bind(symbols, walked)), x["tail"])

    new = bind(bind(F.struct(lead.alias("lead"), tail.alias("tail")), of), made)
    return F.when((kind == "email") & e.rlike(r"\p{Lu}"), _capitals(e, new)).otherwise(new)


def surrogate(e: Column, key: str) -> Column:
    """The replacement of one entity."""
    kind = F.lit("name")
    for k in reversed(PATTERNS):
        kind = F.when(e.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(kind)
    return bind(kind, lambda k: F.when(k == "ip", _ip(e, key)).when(k == "card", _card(e, key)).when(k == "name", _name(e, key)).otherwise(_general(e, k, key)))


def entities(text: Column) -> Column:
    """All entities of a text, in order; none for null."""
    some = text.rlike("[0-9@=:]")
    for h in HINT_KEYS + HINT_TITLES:
        some = some | F.contains(text, F.lit(h))
    first = F.lit(False)
    for names in FIRST_NAMES.values():
        for n in names:
            first = first | F.contains(text, F.lit(n + " "))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(first, found(ANY)).when(some, found(TITLED)).otherwise(F.array().cast("array<string>"))


def named(ents: Column) -> Column:
    """The pattern of a text's entities: ANY, and any of the names that stand behind a title or a known first name, by themselves."""
    titled = F.filter(ents, lambda e: e.rlike(f"^(?:{PATTERNS['name']})$"))
    words = F.flatten(F.transform(titled, lambda e: F.split(F.regexp_replace(e, rf"^(?:{TITLES_M}|{TITLES_F}|{TITLES}) ", ""), " ")))
    one = F.concat(F.lit("(?:"), F.array_join(F.array_distinct(words), "|"), F.lit(")"))
    bare = lambda w: F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}_@+])"), w, F.lit("(?: "), w, F.lit(r")*(?![\p{L}\p{N}_])"))
    return F.when(F.size(words) > 0, bind(one, bare)).otherwise(F.lit(ANY))


def replace_pii(docs: DataFrame, key: str, check: bool = True) -> DataFrame:
    """docs with every entity in `text` replaced by its surrogate, and n_pii (how many; replaced if docs has it).

    key: a secret; who has it can turn surrogates back.  check: the entities of all docs are looked at first, and
    if two of them have one surrogate, the next key is derived and looked at (at most TRIES, then an error).
    A null text stays null with 0 entities; other columns are untouched.  The result of a
    row depends on its text and the key only, so repeated rows stay alike.
    """
    if check:
        for _ in range(TRIES):
            if collisions(docs, key).isEmpty():
                break
            key = hashlib.sha256(f"{key}|next".encode()).hexdigest()
        else:
            raise ValueError("entities with one surrogate under every key tried")
    other = docs.drop("n_pii")
    cols = [other[c] for c in other.columns]
    first = F.coalesce(entities(F.col("text")), F.array().cast("array<string>"))

    def rewritten(ents: Column) -> Column:
        """Text and number of entities, with the names found behind titles wherever else they stand."""
        return bind(named(ents), lambda p: bind(F.regexp_extract_all(F.col("text"), p, F.lit(0)), lambda all_: F.struct(joined(p, all_).alias("text"), F.size(all_).cast("long").alias("n"))))

    def joined(pattern: Column, ents: Column) -> Column:
        pieces = F.split(F.col("text"), pattern, -1)
        return F.array_join(F.zip_with(pieces, F.transform(ents, lambda e: surrogate(e, key)), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")

    found = other.select(*cols, first.alias("_ents"))
    plain = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("n"))
    found = found.withColumn("_new", F.when(F.size("_ents") > 0, rewritten(F.col("_ents"))).otherwise(plain))
    return found.select(*[F.col("_new.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in other.columns], F.col("_new.n").alias("n_pii"))


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """surrogate, entities of surrogates that more than one entity of docs has.

    Case doesn't tell entities apart, nor do leading zeros of an address's numbers."""
    found = docs.select(F.explode(entities(F.col("text"))).alias("entity")).distinct()
    found = found.repartition(C.buckets_of(docs.sparkSession), F.xxhash64("entity"))  # few bytes but much work, so not for one task; a plain key would be merged into the shuffle of distinct()
    same = F.when(F.col("entity").rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$"), F.regexp_replace("entity", r"(?<![0-9])0+(?=[0-9])", "")).otherwise(F.lower("entity"))
    made = found.select(same.alias("entity"), F.lower(surrogate(F.col("entity"), key)).alias("surrogate")).distinct()
    return made.groupBy("surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


def meeting(docs: DataFrame, key: str) -> DataFrame:
    """surrogate of those that are entities of docs themselves: a report, since a format may have no others left."""
    found = docs.select(F.explode(entities(F.col("text"))).alias("entity")).distinct()
    return found.select(F.lower(surrogate(F.col("entity"), key)).alias("surrogate")).distinct().join(found.select(F.lower("entity").alias("surrogate")), "surrogate", "left_semi")
