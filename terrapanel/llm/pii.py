"""Replacing personal data by keyed surrogates, with built-in functions only.

Entities are found by pattern: e-mail and IP addresses, IBANs, card, social-security and telephone numbers, and names
after a title or a known given name. An entity's normal form (lower case; digits alone) and a secret key give its
surrogate, so that all mentions agree, in every document and whatever their case or separators. A surrogate keeps the format: digits
stay digits, letters keep their case and script (vowels stay vowels), separators and top-level domains stay, card numbers keep their first
digit and whether their check digit is right, given names go to given names of the same gender, one to one.

Distinct entities stay distinct: over the whole table, surrogates that meet another surrogate or a real entity are drawn
again until none does.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import checked, let
from terrapanel.session import materialise

#: Common given names, by gender; surrogates come from the same list.
FEMALE = ("Anna", "Maria", "Emma", "Laura", "Julia", "Sofia", "Claire", "Marie", "Alice", "Sarah", "Elena", "Lucia", "Carmen", "Ingrid", "Heidi", "Camille")
MALE = ("John", "Peter", "Paul", "Thomas", "Michael", "David", "Daniel", "Martin", "Pierre", "Jean", "Carlos", "Miguel", "Hans", "Klaus", "Antonio", "Robert")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra")

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,4}|(?<![\d(-])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4})(?!\d)"
CAPITAL = r"\p{Lu}[\p{Ll}'-]{1,30}"
NAME = rf"(?<![\p{{L}}])(?:(?:{'|'.join(TITLES)})\.? {CAPITAL}(?: {CAPITAL})?|(?:{'|'.join(FEMALE + MALE)}) {CAPITAL})(?!\p{{L}})"
#: In order: where two could start at one place, the first is taken.
KINDS = {"email": EMAIL, "iban": IBAN, "ip": IP, "card": CARD, "ssn": SSN, "phone": PHONE, "name": NAME}
PATTERN = "|".join(KINDS.values())

#: Alphabets whose letters stand for one another.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
#: Ranges of letters of other scripts (by code point, ends included), and letters of each that stand for them.
RANGES = tuple((chr(a), chr(b), "".join(map(chr, range(c, d)))) for a, b, c, d in (
    (0x0531, 0x0587, 0x0561, 0x0587), (0x05D0, 0x05EA, 0x05D0, 0x05EB), (0x0620, 0x064A, 0x0628, 0x063B), (0x0904, 0x0939, 0x0915, 0x0929), (0x0E01, 0x0E30, 0x0E01, 0x0E2F),
    (0x10D0, 0x10FF, 0x10D0, 0x10F1), (0x3041, 0x3096, 0x304B, 0x3083), (0x30A1, 0x30FA, 0x30AB, 0x30E3), (0x3400, 0x9FFF, 0x4E00, 0x4F00), (0xAC00, 0xD7A3, 0xAC00, 0xAD00)))
LATIN = "abcdefghijklmnopqrstuvwxyz"
#: From the first of these draws on an e-mail address or name may get any letter at any place; from the second on it also grows.
WIDER, LONGER = 8, 16


def _kind(match: Column) -> Column:
    out = F.lit("name")
    for kind in reversed(list(KINDS)[:-1]):
        out = F.when(match.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _normal(kind: Column, match: Column) -> Column:
    return F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(match, r"[^\d+]", "")).when(kind == "iban", F.replace(match, F.lit(" "), F.lit(""))).otherwise(F.lower(match))


def _given(secret: str) -> dict[str, str]:
    """Each given name's replacement: the next one of its gender in an order drawn with the key."""
    out = {}
    for names in (FEMALE, MALE):
        drawn = sorted(names, key=lambda n: hashlib.sha256(f"{secret}|given|{n}".encode()).digest())
        out |= {n: drawn[(i + 1) % len(drawn)] for i, n in enumerate(drawn)}
    return out


def _entities(match: Column, secret: str) -> Column:
    """Array of (kind, normal form) that a match stands for: itself, or the words of a name but titles and known given names."""
    kept = [*TITLES, *(f"{t}." for t in TITLES), *_given(secret)]
    words = F.transform(F.filter(F.split(match, " "), lambda w: ~w.isin(kept)), lambda w: F.struct(F.lit("name").alias("kind"), F.lower(w).alias("normal")))
    return let(_kind(match), lambda kind: F.when(kind == "name", words).otherwise(F.array(F.struct(kind.alias("kind"), _normal(kind, match).alias("normal")))))


def _luhn(digits: Column) -> Column:
    """Digit sum of the Luhn rule."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(iban: Column) -> Column:
    """Remainder of the number that an IBAN stands for, its first four characters moved to the end."""
    chars = F.filter(F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4))), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda n, c: F.when(c.rlike("[0-9]"), (n * 10 + c.try_cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97))


def surrogate(kind: Column, normal: Column, attempt: Column, secret: str) -> Column:
    """The surrogate of a normal form, a text of the same length (other for IP addresses).

    Letters of a script that is not listed become Latin ones. What clashes again and again, as its form has few or no other surrogates, is drawn from all letters (e-mail
    addresses and names) and then gets more of them in front, or more digits at its end (numbers).
    """
    return let(attempt, lambda n: _drawn(kind, normal, n, secret))


def _drawn(kind: Column, normal: Column, attempt: Column, secret: str) -> Column:
    seed = F.concat_ws("|", F.lit(secret), kind, attempt.cast("string"), normal)
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(4)])

    def drawn(bytes_: Column, i: Column) -> Column:
        return F.conv(F.substring(bytes_, (i * 2) % 256 + 1, F.lit(2)), 16, 10).cast("int")

    def letter(c: Column, i: Column, bytes_: Column) -> Column:
        latin = F.substring(F.lit(LATIN), drawn(bytes_, i) % len(LATIN) + 1, F.lit(1))
        out = (F.when(c.rlike(r"\p{N}"), (drawn(bytes_, i) % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(latin)).when(c.rlike(r"\p{L}"), latin).otherwise(c))
        for low, high, letters in RANGES:
            out = F.when(c.rlike(f"[{low}-{high}]"), F.substring(F.lit(letters), drawn(bytes_, i) % len(letters) + 1, F.lit(1))).otherwise(out)
        # Only characters of no listed alphabet are held against the ranges.
        for alphabet in ALPHABETS:
            at = drawn(bytes_, i) % len(alphabet)
            out = (F.when(F.contains(F.lit(alphabet), c), F.substring(F.lit(alphabet), at + 1, F.lit(1)))
                   .when(F.contains(F.lit(alphabet.upper()), c), F.substring(F.lit(alphabet.upper()), at + 1, F.lit(1))).otherwise(out))
        return F.when((attempt >= WIDER) & kind.isin("email", "name") & ~c.isin("@", "."), latin).otherwise(out)

    def spelled(bytes_: Column) -> Column:
        kept = F.when(kind == "email", F.length(normal) - F.length(F.substring_index(normal, ".", -1))).when(
            (kind == "name") & (F.length(normal) > 2) & (attempt < WIDER), F.length(normal) - 1).otherwise(F.length(normal))
        first = F.when(kind == "iban", 2).when(kind == "card", 1).otherwise(0)
        chars = F.filter(F.split(normal, ""), lambda c: c != "")
        text = F.array_join(F.transform(chars, lambda c, i: F.when((i < first) | (i >= kept), c).otherwise(letter(c, i, bytes_))), "")
        more = F.when(kind.isin("email", "name") & (attempt >= LONGER), F.least(attempt - (LONGER - 1), F.lit(40))).otherwise(0)
        text = F.concat(F.translate(F.substring(bytes_, F.lit(200), more), "0123456789", "ghijklmnop"), text)
        grown = F.when(kind.isin("card", "ssn", "phone", "iban") & (attempt >= LONGER), F.least(attempt - (LONGER - 1), F.lit(40))).otherwise(0)
        text = F.concat(text, F.translate(F.substring(bytes_, F.lit(200), grown), "abcdef", "012345"))
        checked_iban = let(text, lambda t: let(F.concat(F.substring(t, F.lit(1), F.lit(2)), F.lit("00"), F.substring(t, F.lit(5), F.length(t))), lambda z: F.concat(
            F.substring(t, F.lit(1), F.lit(2)), F.lpad((F.lit(98) - _mod97(z)).cast("string"), 2, "0"), F.substring(t, F.lit(5), F.length(t)))))
        octets = F.concat_ws(".", (drawn(bytes_, F.lit(0)) % 223 + 1), *[drawn(bytes_, F.lit(i)) for i in (1, 2, 3)])
        checked_card = let(text, lambda t: let(F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("0")), lambda z: F.concat(
            F.substring(t, F.lit(1), F.length(t) - 1), ((F.lit(10) - _luhn(z) % 10) % 10).cast("string"))))
        return F.when(kind == "ip", octets).when((kind == "card") & (_luhn(normal) % 10 == 0), checked_card).when((kind == "iban") & (_mod97(normal) == 1), checked_iban).otherwise(text)

    return let(stream, spelled)


def _rendered(kind: Column, match: Column, core: Column) -> Column:
    """A surrogate in the case and with the separators of a mention."""
    return let(core, lambda c: _cased(kind, match, c))


def _cased(kind: Column, match: Column, core: Column) -> Column:
    chars = F.filter(F.split(match, ""), lambda c: c != "")
    skipped = F.when(kind == "iban", " ").otherwise(r"[^\d+]")
    spaced = F.transform(chars, lambda c, i: F.when(c.rlike(r"[\p{L}\d+]"), F.substring(core, F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), skipped, "")), F.lit(1))).otherwise(c))
    more = F.greatest(F.length(core) - F.length(match), F.lit(0))
    cased = F.transform(chars, lambda c, i: let(F.substring(core, i + 1 + more, F.lit(1)), lambda s: F.when(c != F.lower(c), F.upper(s)).otherwise(s)))
    beyond = F.substring(core, F.length(F.regexp_replace(match, skipped, "")) + 1, F.length(core))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), F.concat(F.array_join(spaced, ""), beyond)).when(kind == "ip", core).otherwise(F.concat(F.substring(core, F.lit(1), more), F.array_join(cased, "")))


def _one(kind: Column, mention: Column, attempts: Column, secret: str) -> Column:
    """What stands for a single entity."""
    return let(_normal(kind, mention), lambda normal: _rendered(kind, mention, surrogate(
        kind, normal, F.coalesce(F.element_at(attempts, F.concat_ws("|", kind, normal)), F.lit(0)), secret)))


def _replaced(match: Column, attempts: Column, secret: str) -> Column:
    given = F.create_map(*[F.lit(x) for pair in _given(secret).items() for x in pair])
    kept = [*TITLES, *(f"{t}." for t in TITLES)]
    words = F.transform(F.split(match, " "), lambda w: F.when(w.isin(kept), w).otherwise(F.coalesce(F.element_at(given, w), _one(F.lit("name"), w, attempts, secret))))
    return let(_kind(match), lambda kind: F.when(kind == "name", F.array_join(words, " ")).otherwise(_one(kind, match, attempts, secret)))


def _names(hits: Column, secret: str) -> Column:
    """Array of the distinct words of the names among the hits that are no title and no known given name."""
    kept = [*TITLES, *(f"{t}." for t in TITLES), *_given(secret)]
    words = F.flatten(F.transform(F.filter(hits, lambda m: _kind(m) == "name"), lambda m: F.split(m, " ")))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(kept)))


def _filled(text: Column, hits: Column, attempts: Column, secret: str) -> Column:
    """The text with every hit replaced, and between the hits the names that stand there again."""
    def again(gap: Column, swaps: Column) -> Column:
        return F.aggregate(swaps, gap, lambda t, s: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}])"), s["name"], F.lit(r"(?![\p{L}])")), s["stands"]))

    def fill(swaps: Column) -> Column:
        return F.array_join(F.zip_with(F.split(text, PATTERN, -1), hits, lambda g, m: F.concat(again(g, swaps), F.when(m.isNull(), "").otherwise(_replaced(m, attempts, secret)))), "")

    return let(F.transform(_names(hits, secret), lambda w: F.struct(w.alias("name"), _one(F.lit("name"), w, attempts, secret).alias("stands"))), fill)


def _clashes(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, normal, attempt) of the entities whose first surrogate would meet another's or a real entity."""
    def drawn(rows: DataFrame) -> DataFrame:
        return rows.withColumn("core", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), secret))

    def clashing(rows: DataFrame) -> DataFrame:
        """All but the smallest of those with one surrogate, and those whose surrogate is somebody's normal form."""
        least = rows.groupBy("kind", "core").agg(F.min("normal").alias("keeps"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        twice = rows.join(least, ["kind", "core"]).where("normal <> keeps").select("kind", "normal")
        real = rows.join(entities.select("kind", F.col("normal").alias("core")), ["kind", "core"], "left_semi").select("kind", "normal")
        return twice.unionByName(real).distinct()

    rows = materialise(drawn(entities.withColumn("attempt", F.lit(0))))
    while True:
        again = materialise(clashing(rows))
        if again.isEmpty():
            return rows.where("attempt > 0").select("kind", "normal", "attempt")
        moved = rows.join(checked(again.withColumn("moves", F.lit(1))), ["kind", "normal"], "left")
        rows = materialise(drawn(moved.select("kind", "normal", (F.col("attempt") + F.coalesce("moves", F.lit(0))).alias("attempt"))))


def _free(name: str, df: DataFrame) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the personal data of ``text`` replaced, and ``pii_found``, the array of the kinds found in
    order (a column of that name is replaced).

    Texts are searched once for the table of entities and once to be rewritten, which only those with finds are. A name that was found is replaced
    elsewhere in its text too, as a word of the same case; those places are not listed. All other columns stay. A null text stays null and
    an empty one empty, with no finds. Equal texts become equal texts; repeated rows and rows with equal or null keys are each
    replaced, and no two different entities of the table share a surrogate.
    """
    found, doc, tries = _free("_pii_hits", docs), _free("_pii_doc", docs), _free("_pii_attempts", docs)
    hits = F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    kept = [c for c in docs.columns if c != "pii_found"]
    searched = docs.select(*[F.col(f"`{c}`") for c in kept], hits.alias(found))
    # an inner explode would search every text a second time, for a filter that Spark infers
    listed = searched.select(F.col(key).alias(doc), F.explode_outer(F.flatten(F.transform(found, lambda m: _entities(m, secret)))).alias("e"))
    mentions = listed.select(doc, "e.kind", "e.normal").where(F.col("kind").isNotNull()).distinct()
    mentions = materialise(mentions)
    again = materialise(_clashes(mentions.select("kind", "normal").distinct(), secret))
    attempts = F.create_map().cast("map<string,int>")
    if not again.isEmpty():
        of_doc = (mentions.join(checked(again), ["kind", "normal"]).groupBy(doc)
                  .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "normal"), "attempt"))).alias(tries)))
        searched = searched.join(checked(materialise(of_doc)), F.col(key).eqNullSafe(F.col(doc)), "left").drop(doc)
        attempts = F.coalesce(F.col(tries), attempts)
    new = F.when(F.size(found) > 0, _filled(F.col(text), F.col(found), attempts, secret)).otherwise(F.col(text))
    return searched.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in kept], F.transform(found, _kind).alias("pii_found"))
