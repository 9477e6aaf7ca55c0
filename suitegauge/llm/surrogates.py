"""PII: detected entities are replaced by keyed surrogates of the same kind, format, script and gender.

All of it is column expressions. An entity is reduced to atoms (an address, a number's digits, a given
name, a surname), so that its mentions in any format share one surrogate. The surrogate is drawn from keyed
digests, character class by character class; given names are permuted within their list; collisions with other surrogates or with originals are looked for over
all documents, and those that lose are drawn again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitegauge.llm.common import staged

#: Given names by script and gender, none of them in two lists; surrogates are drawn from the same list.
GIVEN = {
    "female": "Alice Anna Barbara Claire Elena Emma Helga Ingrid Julia Laura Lucia Maria Monika Petra Sophie Teresa".split(),
    "male": "Andreas Carlos David Georg Hans James John Jorge Klaus Martin Michael Paul Peter Pierre Robert Thomas".split(),
    "female_cyrillic": "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    "male_cyrillic": "Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
#: Forms of address that a surname, or given name and surname, follows.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()

_NAME = "\\p{Lu}\\p{L}+"
#: Fixed values, in order of precedence: how each kind of entity looks. Runs are possessive, so none is tried twice.
PATTERNS = {
    "email": "(?<![\\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)*\\.[A-Za-z]{2,}+",
    "secret": "(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "ip": "(?<![\\d.])\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}(?!\\.?\\d)",
    "iban": "(?<![0-9A-Za-z])[A-Z]{2}\\d{2}[A-Z0-9]{11,30}+(?![0-9A-Za-z])",
    "card": "(?<![\\d+])(?:\\d{13,19}+|\\d{4}[ -]\\d{4}[ -]\\d{4}[ -]\\d{1,7})(?!\\d)",
    "phone": "(?<![\\d])(?:\\+\\d{1,3}[ -]?)?(?:\\(\\d{3}\\)[ -]?|\\d{3}[ .-])\\d{3}[ .-]\\d{4}(?!\\d)|\\+\\d{1,3}(?:[ -]?\\d{2,4}){3,4}(?!\\d)",
    "ssn": "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])",
    "name": f"(?<![\\p{{L}}])(?:(?:{'|'.join(TITLES)})\\.? {_NAME}(?: {_NAME})?|(?:{'|'.join(n for names in GIVEN.values() for n in names)}) {_NAME})",
}
ENTITY = "|".join(PATTERNS.values())

#: Classes of characters: a character is replaced by one of its class.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ",
           "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
#: Letters outside the classes, as a regex of their script or of any, are replaced by one of these.
SCRIPTS = {
    "\\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", "\\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшщыэюя",
    "\\p{IsArmenian}": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "\\p{IsGeorgian}": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    "\\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
#: Draws in a row after which surrogates of mail addresses and surnames grow, and after which there is no free one.
DRAWS, MOST_DRAWS = 3, 60
_HEX = "0123456789abcdef"
#: The classes, with ``SCRIPTS`` for letters outside them.
LETTERED = [*CLASSES]

_ATOM = "struct<kind:string,value:string>"


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern the whole entity fits."""
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)) for kind, pattern in PATTERNS.items()])


def _atom(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _words(entity: Column) -> Column:
    """A name's words after its form of address."""
    return F.split(F.regexp_replace(entity, f"^(?:{'|'.join(TITLES)})\\.? ", ""), " ")


def _gender(name: Column) -> Column:
    """The list that a given name is in, else null."""
    return F.coalesce(*[F.when(F.lower(name).isin([n.lower() for n in names]), F.lit(list_name)) for list_name, names in GIVEN.items()])


def atoms(kind: Column, entity: Column) -> Column:
    """What an entity's surrogate depends on, without its format."""
    digits = F.regexp_replace(entity, "\\D", "")
    words = _words(entity)
    return (F.when(kind == "email", F.array(_atom("email", F.lower(entity))))
            .when(kind == "secret", F.array(_atom("secret", F.lower(entity))))
            .when(kind == "ip", F.array(_atom("ip", entity)))
            .when(kind == "iban", F.array(_atom("iban", entity)))
            .when(kind == "card", F.array(_atom("card", digits)))
            .when(kind == "ssn", F.array(_atom("ssn", digits)))
            .when(kind == "phone", F.array(_atom("phone", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits))))
            .otherwise(F.transform(words, lambda w: F.struct(
                F.coalesce(_gender(w), F.lit("surname")).alias("kind"), F.lower(w).alias("value")))))


def _stream(key: str, atom: Column, attempt: Column) -> Column:
    """128 keyed bytes as hex digits."""
    seed = F.concat(F.lit(key + "|"), atom["kind"], F.lit("|"), atom["value"], F.lit("|"), attempt.cast("string"), F.lit("|"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(str(i))).cast("binary"), 256) for i in range(4)])


def _byte(stream: Column, i: Column) -> Column:
    at = (i - 1) % 128
    return F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _drawn(character: Column, byte: Column, classes: list[str]) -> Column:
    rest = character
    if classes is LETTERED:
        for script, letters in reversed(SCRIPTS.items()):
            rest = F.when(character.rlike(script), F.substring(F.lit(letters), byte % len(letters) + 1, F.lit(1))).otherwise(rest)
    return reduce(lambda rest, letters: F.when(F.lit(letters).contains(character), F.substring(
        F.lit(letters), byte % len(letters) + 1, F.lit(1))).otherwise(rest), reversed(classes), rest)


def _like(value: Column, stream: Column, classes: list[str]) -> Column:
    def one(i: Column) -> Column:
        return _once(F.substring(value, i, F.lit(1)), lambda character: _drawn(character, _byte(stream, i), classes))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def luhn(digits: Column) -> Column:
    """The sum that card numbers keep divisible by ten."""
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.transform(F.array(
        F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)), lambda d: F.when(d > 9, d - 9).otherwise(d))[0])
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def mod97(account: Column) -> Column:
    """An account number's remainder, 1 if it is valid: its first four characters go last, and letters count from 10 on."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1)))), F.lit(0), lambda a, c: F.when(
        c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def surrogate(key: str, atom: Column, attempt: Column) -> Column:
    """The surrogate of an atom, in the atom's own plain format: same length except for addresses of machines and given names.

    From attempt ``DRAWS`` on, mail addresses and surnames grow, so that short ones do not run out of surrogates.
    """
    return _once(_stream(key, atom, attempt), lambda stream: _from_stream(key, atom["kind"], atom["value"], stream, attempt))


def permuted(key: str, names: list[str]) -> dict[str, str]:
    """Each name's surrogate: the next of the list in a keyed order, so no two share one and none is its own."""
    order = sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).digest())
    return dict(zip(order, [*order[1:], order[0]]))


def _from_stream(key: str, kind: Column, value: Column, stream: Column, attempt: Column) -> Column:
    longer = F.greatest(attempt - (DRAWS - 1), F.lit(0)).cast("int")
    plain = _like(value, stream, CLASSES)
    surname = _like(F.concat(value, F.substring(F.repeat(value, longer), F.lit(1), longer)), stream, LETTERED)
    # The first digit stays other than 0 where it was; the last makes cards valid that were.
    number = F.concat(F.when(value.startswith("0"), F.lit("0")).otherwise((_byte(stream, F.lit(128)) % 9 + 1).cast("string")),
                      F.substring(_like(value, stream, CLASSES[:1]), F.lit(2), F.length(value)))
    card = _once(number, lambda n: F.when(luhn(value) % 10 == 0, F.concat(
        F.substring(n, F.lit(1), F.length(n) - 1),
        ((10 - luhn(F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.lit("0"))) % 10) % 10).cast("string"))).otherwise(n))
    mail = F.concat(_like(F.concat(F.regexp_extract(value, "^(.*)\\.[^.]*$", 1), F.substring(F.repeat(F.lit("na"), longer), F.lit(1), longer)), stream, CLASSES),
                    F.regexp_extract(value, "\\.[^.]*$", 0))
    octets = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_byte(stream, i) % 254 + 1).cast("string"))
    # Private and loopback addresses stay in their range; others begin with 11 to 126, which is neither.
    range_of = _once(F.regexp_extract(value, "^(?:10|127|192\\.168|172\\.(?:1[6-9]|2\\d|3[01]))(?=\\.)", 0), lambda own: F.when(
        own == "", (_byte(stream, F.lit(1)) % 116 + 11).cast("string")).otherwise(own))
    machine = _once(range_of, lambda own: F.concat_ws(".", own, F.slice(octets, F.lit(1), 4 - F.size(F.split(own, "\\.")))))
    # The check digits of a valid account number are those of the new one.
    account = F.substring(plain, F.lit(5), F.length(value))
    country = F.substring(value, 1, 2)
    bank = F.when(mod97(value) == 1, F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
                  ).otherwise(F.concat(country, F.substring(plain, F.lit(3), F.length(value))))
    given = F.element_at(F.create_map(*[F.lit(n) for names in GIVEN.values() for pair in permuted(key, names).items() for n in pair]), value)
    return (F.when(kind == "email", mail).when(kind == "secret", _like(value, stream, [_HEX]))
            .when(kind == "ip", machine).when(kind == "iban", bank).when(kind == "card", card)
            .when(kind.isin("phone", "ssn"), number).when(kind == "surname", surname).otherwise(given))


def _cased(entity: Column, value: Column) -> Column:
    """``value`` with capitals where the entity has them; a longer value goes on as the entity ends."""
    def one(i: Column) -> Column:
        old = F.substring(entity, F.least(i, F.length(entity)), F.lit(1))
        new = F.substring(value, i, F.lit(1))
        return F.when((old == F.upper(old)) & (old != F.lower(old)), F.upper(new)).otherwise(new)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _digits_into(entity: Column, number: Column) -> Column:
    """The entity with its last digits replaced by those of ``number``; what is before them, as a country code, stays."""
    ordinal = F.length(F.regexp_replace(entity, "\\D", ""))

    def one(i: Column) -> Column:
        left = ordinal - F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "\\D", ""))
        return _once(F.struct(F.substring(entity, i, F.lit(1)).alias("own"), (F.length(number) - left).alias("at")), lambda c: F.when(
            c["own"].rlike("[0-9]") & (c["at"] >= 1), F.substring(number, c["at"], F.lit(1))).otherwise(c["own"]))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), one), "")


def written(kind: Column, entity: Column, values: Column) -> Column:
    """The surrogates of an entity's atoms in the entity's format."""
    title = F.regexp_extract(entity, f"^(?:(?:{'|'.join(TITLES)})\\.? )?", 0)
    name = F.concat(title, F.array_join(F.zip_with(_words(entity), values, _cased), " "))
    return (F.when(kind.isin("card", "phone", "ssn"), _digits_into(entity, values[0]))
            .when(kind == "name", name).when(kind == "ip", values[0]).otherwise(_cased(entity, values[0])))


#: What marks entities while a text is taken apart; texts that hold it are taken apart by the pattern twice.
MARK = "\ue0f7"


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pii_parts: what is between entities and, at every second place, the entities; null where there is none.

    The pattern runs over a text once: it marks the entities, and the text is split at the marks.
    """
    marked = F.split(F.regexp_replace(text, F.lit(f"(?:{ENTITY})"), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    between = F.split(text, ENTITY, -1)
    twice = F.slice(F.flatten(F.zip_with(between, found, lambda piece, entity: F.array(piece, entity))), F.lit(1), 2 * F.size(found) + 1)
    parts = _once(F.when(F.contains(F.col(text), F.lit(MARK)), twice).otherwise(marked), lambda p: F.when(F.size(p) > 1, p))
    return docs.withColumn("pii_parts", parts)


def _entities(parts: Column) -> Column:
    """The entities of parts with their kinds and atoms."""
    kinds = F.transform(F.filter(parts, lambda _, i: i % 2 == 1), lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    return F.transform(kinds, lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), atoms(e["kind"], e["entity"]).alias("atoms")))


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt): of entities ``pii_entities``, the atoms whose first surrogates collided, with the attempt that does not.

    Two atoms of a kind must not share a surrogate, nor may a surrogate be an atom that occurs, nor a surname's a
    listed given name. Given names are permuted within their lists and never collide. If the space of a format is used up,
    as may be for short phone numbers, a ValueError tells.
    """
    atom = F.struct("kind", "value")
    known = staged(found.select(F.explode("pii_entities").alias("e")).select(F.explode("e.atoms").alias("a"))
                   .select("a.kind", "a.value").where(~F.col("kind").isin(*GIVEN)).distinct(), "pii-atoms")
    drawn = staged(known.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(key, atom, F.col("attempt"))), "pii-drawn")
    listed = [n.lower() for names in GIVEN.values() for n in names]
    for _ in range(MOST_DRAWS):
        shared = drawn.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("value").alias("winner")).where("n > 1").drop("n").hint("merge")
        occurring = known.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("occurs")).hint("merge")
        lost = staged(drawn.join(shared, ["kind", "surrogate"], "left").join(occurring, ["kind", "surrogate"], "left")
                      .where(F.expr("value <> winner or occurs") | (F.col("kind") == "surname") & F.col("surrogate").isin(listed))
                      .select("kind", "value", "attempt"), "pii-lost")
        if lost.isEmpty():
            break
        again = lost.withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", surrogate(key, atom, F.col("attempt")))
        drawn = staged(drawn.join(lost.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "attempt", "surrogate")
                       .union(again.select("kind", "value", "attempt", "surrogate")), "pii-drawn")
    else:
        raise ValueError(f"no free surrogates after {MOST_DRAWS} draws for kinds {[r.kind for r in lost.select('kind').distinct().collect()]}")
    return staged(drawn.where("attempt > 0").select("kind", "value", "attempt"), "pii-redrawn")


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with texts in which every entity is replaced, and pii_count, the entities replaced.

    Nulls stay null and texts without entities stay as they are. The same atom gets the same surrogate everywhere, whatever its
    format; different atoms of a kind never share one. Repeated rows are replaced alike. ``pii_count`` of ``docs`` itself,
    if any, is replaced; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != "pii_count"]
    # The pattern runs once; a text with entities is kept as its parts.
    parted = detected(docs.select(*[F.col(f"`{c}`") for c in kept])).withColumn("text", F.when(F.col("pii_parts").isNull(), F.col("text")))
    found = staged(parted, "pii-parts").withColumn("pii_entities", _entities(F.col("pii_parts")))
    named = staged(found.where("pii_parts is not null").select(F.xxhash64("pii_parts").alias("pii_content"), "pii_entities"), "pii-entities")
    exceptions = redrawn(named, key)
    attempts = "map<struct<kind:string,value:string>,int>"
    if exceptions.isEmpty():
        joined = found.withColumn("pii_attempts", F.lit(None).cast(attempts))
    else:
        # Which texts hold an atom that was drawn again; by content, as ids may be missing or repeat.
        holders = (named.select("pii_content", F.explode("pii_entities").alias("e"))
                   .select("pii_content", F.explode("e.atoms").alias("a")).select("pii_content", "a.kind", "a.value").distinct()
                   .join(exceptions, ["kind", "value"])
                   .groupBy("pii_content").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "value"), "attempt"))).alias("pii_attempts")))
        joined = found.withColumn("pii_content", F.xxhash64("pii_parts")).join(staged(holders, "pii-holders"), "pii_content", "left")

    def value(atom: Column) -> Column:
        attempt = F.coalesce(F.element_at("pii_attempts", F.struct(atom["kind"].alias("kind"), atom["value"].alias("value"))), F.lit(0))
        return surrogate(key, atom, attempt)

    new = F.transform("pii_entities", lambda e: _once(F.transform(e["atoms"], value), lambda values: written(e["kind"], e["entity"], values)))
    woven = _once(new, lambda n: F.array_join(F.transform(F.col("pii_parts"), lambda part, i: F.when(
        i % 2 == 1, F.coalesce(F.get(n, ((i - 1) / 2).cast("int")), F.lit(""))).otherwise(part)), ""))
    out = joined.withColumn("pii_text", F.when(F.col("pii_parts").isNotNull(), woven).otherwise(F.col("text")))
    return out.select(*[F.col("pii_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in kept],
                      F.when(F.col("pii_parts").isNull(), 0).otherwise(F.size("pii_entities")).alias("pii_count"))
