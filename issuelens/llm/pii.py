"""Surrogates for personal data: keyed, type-consistent replacements, distinct and coreferent.

Detected entities (e-mail addresses, telephone numbers, IPv4 addresses, 16-digit card numbers, secret tokens and
names after a title) are replaced by surrogates of the same type, script and format: separators, digit
counts, letter case, mail and token lengths stay, card numbers keep their check-digit status, telephone
numbers keep a leading country code, IPv4 octets stay in range, names keep title, gender and script.  A
surrogate depends on the key, the type and the normalised entity only, so every mention of an entity gets the same
one.  Parts that entities share stay shared: a last name has one surrogate, with or without a first name before it, and so has a
mail domain.  A person's gender is that of the titles with a gender that the table holds for the whole name (of both:
neutral), so ``Dr. Kim Lee`` and ``Ms. Kim Lee`` are one.  Distinctness is checked over the whole table: entities whose
surrogates collide with another entity's or with an entity that occurs in the text are derived again with the next
attempt number, until none collides; the space of forms grows with the attempt.

Only DataFrame operations are used: one regular expression finds all types; texts are split around the
matches and joined again with the surrogates.  Only entities that needed a second attempt, or whose titles differ in
gender, are joined back to their documents; all others are derived in place.  The most frequent entity meets as one row per task.

Edge cases: null texts stay null; empty texts and texts without an entity stay as they are; a null id is a document like
any other (its second attempts are found by the text's hash); repeated rows get equal results; an empty table
gives no rows; other columns pass through by the caller's choice (``keep``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import stage

KEY = "surrogate-key"
ROUNDS = 64  # each round leaves a small share of the collisions of the last one, in a larger space

#: Patterns of the types, most specific first; \p{..} classes cover every script.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]{0,39}[0-9])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z])"
CARD = r"(?<![0-9.])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
#: Marks may stand between the parts of a telephone number; without an area code only the dashed form counts.
_GAP = r"[^0-9A-Za-z\n()]{0,6}"
#: After a country code, one to five groups of digits, eight to fifteen digits in all.
_ABROAD = r"\+(?=[0-9]{1,3}[ .-])(?=(?:[ .()-]{0,3}[0-9]){8,15}(?![0-9]))[0-9]{1,3}(?:[ .-]\(?[0-9]{1,10}\)?){1,5}"
PHONE = (
    rf"(?<![0-9A-Za-z])(?:{_ABROAD}|(?:\+[0-9]{{1,3}}{_GAP})?(?:\([0-9]{{3}}\){_GAP}|[0-9]{{3}}[ -])[0-9]{{3}}[ -][0-9]{{4}}|[0-9]{{3}}-[0-9]{{4}})"
    r"(?![0-9])"
)
#: Titles by gender (fixed values), and pools of the names that replace those after them, by gender and script.
TITLES = {
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Госпожа", "г-жа"],
    "m": ["Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Господин", "г-н"],
    "x": ["Dr.", "Dr", "Prof.", "Mx."],
}
FIRST = {
    ("f", "latin"): ["Ada", "Bea", "Clara", "Dora", "Elsa", "Flora", "Greta", "Hanna", "Ines", "Julia", "Karla", "Lena", "Mara", "Nora", "Olga", "Paula"],
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Max", "Noel", "Oskar", "Paul"],
    ("x", "latin"): ["Alex", "Billie", "Chris", "Dana", "Eli", "Finn", "Gail", "Harper", "Jamie", "Kim", "Lou", "Morgan", "Nico", "Robin", "Sam", "Toni"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария"],
    ("m", "cyrillic"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Павел"],
    ("x", "cyrillic"): ["Саша", "Женя", "Валя", "Слава", "Шура", "Юля", "Паша", "Тоня"],
}
#: Syllables of invented last names (fixed values); length varies with the attempt.
SYLLABLES = {
    "latin": ["bar", "bel", "cor", "dan", "del", "fen", "gar", "hol", "kel", "lin", "mar", "nor", "pel", "ron", "sal", "tor"],
    "cyrillic": ["бар", "вел", "гор", "дан", "жил", "зор", "кел", "лин", "мар", "нор", "пел", "рон", "сал", "тор", "фен", "хол"],
}
_TITLE = "|".join(sorted((t.replace(".", r"\.") for own in TITLES.values() for t in own), key=lambda t: (-len(t), t)))
_NAME = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}[\p{Ll}]+)?"
NAME = rf"(?<![\p{{L}}])(?:{_TITLE}) {_NAME}(?: {_NAME})?(?![\p{{L}}])"
TYPES = [("email", EMAIL), ("secret", SECRET), ("card", CARD), ("ip", IP), ("phone", PHONE), ("name", NAME)]
ANY = "|".join(f"(?:{p})" for _, p in TYPES)


def kind_of(entity: Column) -> Column:
    """Type of a matched entity: the first pattern that matches it whole."""
    out = F.lit("name")
    for name, pattern in reversed(TYPES[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def normal(kind: Column, entity: Column) -> Column:
    """What makes two mentions the same entity: digits of numbers (of telephone numbers the
    last ten), lower case of mail, the name without its title."""
    return (
        F.when(kind.isin("card"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "phone", F.right(F.regexp_replace(entity, "[^0-9]", ""), F.lit(10)))
        .when(kind.isin("email", "secret"), F.lower(entity))
        .when(kind == "name", F.regexp_replace(entity, rf"^(?:{_TITLE}) ", ""))
        .otherwise(entity)
    )


def _stream(key: str, kind: Column, value: Column, attempt: Column, n: int) -> Column:
    """At least 64 * n hexadecimal digits that depend on key, type, entity and attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), value)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}\x1f{key}\x1f"), F.sha2(seed.cast("binary"), 256)).cast("binary"), 256) for i in range(n)])


def _number(stream: Column, at: Column | int, width: int = 8) -> Column:
    """The number in ``width`` hexadecimal digits of the stream."""
    start = F.lit(at) if isinstance(at, int) else at
    return F.conv(stream.substr(start + 1, F.lit(width)), 16, 10).cast("long")


def _decimal(stream: Column, count: int) -> Column:
    return F.concat(*[(_number(stream, 4 * i, 4) % 10).cast("string") for i in range(count)])


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, from the right, by those of ``digits``."""
    marks = F.split(shape, "")
    n = F.size(F.filter(marks, lambda c: c.rlike("^[0-9]$")))
    start = F.struct(F.lit("").alias("out"), (F.length(digits) - n).alias("at"))
    return F.aggregate(
        marks,
        start,
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c.rlike("^[0-9]$"), digits.substr(acc["at"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("at"),
        ),
        lambda acc: acc["out"],
    )


def _luhn(digits: Column, from_right: int) -> Column:
    """Luhn sum modulo 10; the last digit stands ``from_right`` places from the right end."""
    total = F.lit(0)
    for i in range(16 - from_right):
        d = digits.substr(16 - from_right - i, 1).cast("int")
        twice = (i + from_right) % 2 == 1
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if twice else d)
    return total % 10


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _card(entity: Column, value: Column, s: Column) -> Column:
    """Fifteen invented digits; the last one makes the number pass Luhn's test exactly if the entity does."""
    off = F.when(_luhn(value, 0) == 0, 0).otherwise(1 + _number(s, 100, 4) % 9)

    def checked(body: Column) -> Column:
        return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")), 1) + off) % 10).cast("string"))

    return let(let(_decimal(s, 15), checked), lambda digits: _fill(entity, digits))


#: Genders of a person: as the mention's title says, or fixed for the whole table.
BY_TITLE, FEMALE, MALE, NEUTRAL = range(4)


def gender_of(entity: Column) -> Column:
    """FEMALE, MALE or NEUTRAL by the title of a mention."""
    title = F.regexp_extract(entity, rf"^(?:{_TITLE}) ", 0)
    female, male = ([t + " " for t in TITLES[g]] for g in "fm")
    return F.when(title.isin(female), FEMALE).when(title.isin(male), MALE).otherwise(NEUTRAL)


def last_name(value: Column) -> Column:
    return F.regexp_extract(value, r"([^ ]+)$", 1)


def _syllables(script: str, s: Column, at: int, count: Column, most: int) -> Column:
    """The first ``count`` of ``most`` syllables, as a name."""
    pool = F.array(*[F.lit(x) for x in SYLLABLES[script]])
    made = [F.element_at(pool, (_number(s, at + 2 * i, 2) % len(SYLLABLES[script]) + 1).cast("int")) for i in range(most)]
    return F.initcap(F.array_join(F.slice(F.array(*made), F.lit(1), F.least(count, F.lit(most)).cast("int")), ""))


def _by_script(value: Column, made: Callable[[str], Column]) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def _surname(name: Column, attempt: Column, key: str) -> Column:
    """An invented last name; one syllable more an attempt."""
    stream = _stream(key, F.lit("surname"), name, attempt, 1)
    return let(stream, lambda s: _by_script(name, lambda script: _syllables(script, s, 8, attempt + 5, 12)))


def _first(value: Column, gender: Column, attempt: Column, s: Column) -> Column:
    """A first name of the gender's and script's pool; from the second attempt on a double name with an invented part."""

    def of(script: str) -> Column:
        def pick(g: str) -> Column:
            pool = FIRST[g, script]
            return F.element_at(F.array(*[F.lit(p) for p in pool]), (_number(s, 0, 4) % len(pool) + 1).cast("int"))

        name = F.when(gender == FEMALE, pick("f")).when(gender == MALE, pick("m")).otherwise(pick("x"))
        return F.when(attempt > 0, F.concat(name, F.lit("-"), _syllables(script, s, 40, attempt + 1, 8))).otherwise(name)

    return _by_script(value, of)


def _name(entity: Column, value: Column, s: Column, attempt: Column, gender: Column, surname_attempt: Column, key: str) -> Column:
    """The title stays; first names come from the pool of gender and script, last names are invented."""
    title = F.regexp_extract(entity, rf"^(?:{_TITLE}) ", 0)
    last = let(last_name(value), lambda name: _surname(name, surname_attempt, key))
    known = F.when(gender == BY_TITLE, gender_of(entity)).otherwise(gender)
    whole = F.when(value.contains(" "), F.concat_ws(" ", let(known, lambda g: _first(value, g, attempt, s)), last)).otherwise(last)
    return F.concat(title, whole)


def surrogate(
    kind: Column, entity: Column, attempt: Column, key: str = KEY, gender: Column | None = None, surname_attempt: Column | None = None
) -> Column:
    """Replacement of an entity: same type and format, depending on key, type, normalised entity and attempt.

    Names: ``gender`` of the person and the attempt of the last name (default: by title, the first).
    """
    gender = F.lit(BY_TITLE) if gender is None else gender
    surname_attempt = F.lit(0) if surname_attempt is None else surname_attempt

    def from_stream(value: Column, s: Column) -> Column:
        # Mail: an invented local part of the same length (eight letters at least) at an invented, reserved domain of like length.
        letters = F.translate(s, "0123456789", "ghijklmnop")
        size = F.greatest(F.length(F.substring_index(entity, "@", 1)), F.lit(8)) + attempt
        firm = F.lower(F.substring_index(entity, "@", -1))
        domain = F.translate(_stream(key, F.lit("domain"), firm, F.lit(0), 1), "0123456789", "ghijklmnop")
        label = domain.substr(F.lit(1), F.least(F.greatest(F.length(firm) - len(".example.org"), F.lit(6)), F.lit(60)))
        email = F.concat(letters.substr(F.lit(1), F.least(size, F.lit(64))), F.lit("@"), label, F.lit(".example.org"))
        # Addresses: of the private network first, of the reserved ones from the fourth attempt, then any.
        octet = F.when(attempt < 3, 10).when(attempt < 6, 240 + _number(s, 32, 4) % 15).otherwise(1 + _number(s, 32, 4) % 254)
        ip = F.concat_ws(".", octet.cast("string"), *[(_number(s, 4 * i, 4) % 254 + 1).cast("string") for i in range(3)])
        token = s.substr(F.lit(1), F.length(entity))
        # Telephone: the country code stays, the subscriber's ten digits change (fewer abroad, if fewer follow the code).
        digits_of = F.regexp_replace(entity, "[^0-9]", "")
        code = F.regexp_extract(entity, r"^\+([0-9]{1,3})", 1)
        rest = F.least(F.length(digits_of) - F.length(code), F.lit(10))
        country = F.when(F.length(digits_of) > 10, digits_of.substr(F.lit(1), F.length(digits_of) - rest)).otherwise(
            F.when(F.length(code) > 0, code).otherwise(F.lit("")))
        phone = let(F.concat(country, F.right(_decimal(s, 10), F.when(F.length(code) > 0, rest).otherwise(F.lit(10)))), lambda digits: _fill(entity, digits))
        return (
            F.when(kind == "email", email)
            .when(kind == "card", _card(entity, value, s))
            .when(kind == "ip", ip)
            .when(kind == "phone", phone)
            .when(kind == "secret", F.when(entity == value, token).otherwise(F.upper(token)))
            .when(kind == "surname", _surname(value, attempt, key))
            .otherwise(_name(entity, value, s, attempt, gender, surname_attempt, key))
        )

    return let(normal(kind, entity), lambda value: let(_stream(key, kind, value, attempt, 2), lambda s: from_stream(value, s)))


def _found(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("_text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    return rows.withColumn("_entities", F.regexp_extract_all("_text", F.lit(ANY), F.lit(0)))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, mark, kind, value, entity): distinct entities of each document; mark: hash of the text."""
    found = _found(docs, id_col, text_col, []).where(F.size("_entities") > 0)
    each = found.select(
        "id", F.xxhash64("_text").alias("mark"), F.explode(F.array_distinct("_entities")).alias("entity")
    ).withColumn("kind", kind_of(F.col("entity")))
    return each.withColumn("value", normal(F.col("kind"), F.col("entity")))


def _settled(every: DataFrame, real: DataFrame, key: str, rounds: int, name: str) -> DataFrame:
    """Rows (kind, value, attempt) of the entities whose first surrogate was taken.

    ``every``: (kind, value, entity, gender, surname_attempt).  An entity keeps a surrogate unless a smaller entity of its type
    has the same one in this round, or one that an earlier round settled has it, or it occurs as an entity itself (``real``).
    """
    open_ = every.withColumn("attempt", F.lit(0))
    settled = None
    moved = None
    columns = ["kind", "value", "entity", "gender", "surname_attempt"]
    for turn in range(rounds):
        made = open_.withColumn(
            "made",
            let(surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key, F.col("gender"), F.col("surname_attempt")),
                lambda m: normal(F.col("kind"), m)),
        )
        made = stage(made, f"{name}-round{turn}")
        first = made.groupBy("kind", "made").agg(F.min("value").alias("first"))
        taken = real if settled is None else real.unionByName(settled)
        first = first.join(taken.distinct(), ["kind", "made"], "left_anti")
        won = made.join(first, ["kind", "made"]).where(F.col("value") == F.col("first")).drop("first")
        lost = made.join(first.select("kind", F.col("first").alias("value"), "made"), ["kind", "value", "made"], "left_anti")
        lost = stage(lost.select(*columns, (F.col("attempt") + 1).alias("attempt")), f"{name}-lost{turn}")
        now = won.select("kind", "made")
        settled = now if settled is None else stage(settled.unionByName(now), f"{name}-settled{turn}")
        again = won.where(F.col("attempt") > 0).select("kind", "value", "attempt")
        moved = again if moved is None else moved.unionByName(again)
        if lost.isEmpty():
            return moved
        open_ = lost
    raise RuntimeError(f"surrogates of {name} still collide after {rounds} attempts")


def attempts(found: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """Rows (kind, value, attempt) of what differs from the default: entities whose first surrogate was taken (all others
    use attempt 0), last names under the kind ``surname``, and persons whose titles differ in gender under the kind
    ``gender``, with the gender as the attempt.

    Last names are settled first; whole names then differ by their first names.
    """
    # Title and separators belong to a mention, not to the entity: the smallest mention shows the form.
    own = gender_of(F.col("entity"))
    every = found.groupBy("kind", "value").agg(
        F.min("entity").alias("entity"), F.bool_or(own == FEMALE).alias("f"), F.bool_or(own == MALE).alias("m"), F.bool_or(own == NEUTRAL).alias("x"))
    person = F.when(F.col("f") & ~F.col("m"), FEMALE).when(F.col("m") & ~F.col("f"), MALE).otherwise(NEUTRAL)
    every = stage(every.withColumn("gender", person), "pii-entities")
    mixed = (F.col("f").cast("int") + F.col("m").cast("int") + F.col("x").cast("int")) > 1
    genders = every.where((F.col("kind") == "name") & F.col("value").contains(" ") & mixed).select(
        F.lit("gender").alias("kind"), "value", F.col("gender").alias("attempt"))
    names = every.where("kind = 'name'").withColumn("last", last_name(F.col("value")))
    last = names.groupBy("last").agg(F.lit("surname").alias("kind")).select("kind", F.col("last").alias("value"), F.col("last").alias("entity"))
    plain = every.where("kind <> 'name'").select("kind", "value", "entity").unionByName(last)
    plain = stage(plain.withColumns({"gender": F.lit(NEUTRAL), "surname_attempt": F.lit(0)}), "pii-plain")
    moved = stage(_settled(plain, plain.select("kind", F.col("value").alias("made")), key, rounds, "pii-plain"), "pii-moved")
    turned = moved.where("kind = 'surname'").select(F.col("value").alias("last"), F.col("attempt").alias("surname_attempt"))
    whole = names.where(F.col("value").contains(" ")).join(turned, "last", "left").select(
        "kind", "value", "entity", "gender", F.coalesce("surname_attempt", F.lit(0)).alias("surname_attempt"))
    whole = stage(whole, "pii-names")
    return moved.unionByName(_settled(whole, whole.select("kind", F.col("value").alias("made")), key, rounds, "pii-names")).unionByName(genders)


def pseudonymise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, key: str = KEY
) -> DataFrame:
    """Every row as (id, text, n_entities, kinds) and the columns ``keep``; entities are replaced in the text."""
    keep = keep or []
    found = stage(entities(docs, id_col, text_col), "pii-found")
    moved = stage(attempts(found, key), "pii-attempts")
    named = found.where("kind = 'name'")
    parts = named.select("mark", F.lit("surname").alias("kind"), last_name(F.col("value")).alias("value"))
    parts = parts.unionByName(named.select("mark", F.lit("gender").alias("kind"), "value"))
    again = (
        found.select("mark", "kind", "value").unionByName(parts).join(moved, ["kind", "value"])
        .groupBy("mark")
        .agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "value").alias("k"), F.col("attempt").alias("v")))).alias("again"))
    )
    rows = _found(docs, id_col, text_col, keep)
    rows = rows.withColumn("_mark", F.xxhash64("_text")).join(again, F.col("_mark") == F.col("mark"), "left")

    def replaced(entity: Column) -> Column:
        def looked_up(kind: Column, value: Column) -> Column:
            return F.coalesce(F.try_element_at(F.col("again"), F.concat_ws("\x1f", kind, value)), F.lit(0))

        def typed(kind: Column) -> Column:
            value = normal(kind, entity)
            gender, last = looked_up(F.lit("gender"), value), looked_up(F.lit("surname"), last_name(value))
            return let(looked_up(kind, value), lambda n: surrogate(kind, entity, n, key, gender, last))

        return let(kind_of(entity), typed)

    def weave(parts: Column) -> Column:
        pairs = F.zip_with(F.slice(parts, 1, F.size("_made")), "_made", lambda p, m: F.concat(p, m))
        return F.concat(F.array_join(pairs, ""), F.element_at(parts, -1))

    rows = rows.withColumn("_made", F.when(F.size("_entities") > 0, F.transform("_entities", replaced)))
    woven = let(F.split("_text", ANY, -1), weave)
    kinds = F.array_sort(F.array_distinct(F.transform("_entities", kind_of)))
    return rows.select(
        "id",
        F.when(F.col("_made").isNull(), F.col("_text")).otherwise(woven).alias("text"),
        F.coalesce(F.size("_entities"), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
    )
