"""Surrogates for personal data: keyed replacements of the same type, gender, script and format, the same for every mention.

Native only: entities are found, replaced and checked with SQL functions and joins.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinetide.llm.common import staged

KEY = "change this key"  # parameter: whoever knows it can compute the replacement of a value they guess

# Titles of each gender, and letters that names of each script are made of.
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mademoiselle|Госпожа|Κυρία"
MALE = "Mr|Herr|Señor|Sr|Monsieur|Господин|Κύριος"
LETTERS = {  # consonants, vowels, last letter of a female and of a male name
    "latin": ("bdfgklmnprstv", "aeiou", "a", "n"), "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "н"), "greek": ("βγδζκλμνπρστφ", "αειου", "α", "ς"),
}
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7})(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{2,3}[-.][0-9]{4}(?![0-9-])"
NAME = rf"(?<![\p{{L}}])(?:{FEMALE}|{MALE})\.?+ \p{{Lu}}[\p{{L}}'-]++(?: (?!(?:{FEMALE}|{MALE})\b)\p{{Lu}}[\p{{L}}'-]++)?"
ANY = "|".join((EMAIL, IP, CARD, IBAN, PHONE, NAME))
ATTEMPTS = 16  # keyed attempts for a free replacement before one is made longer


def _kind(found: Column) -> Column:
    return (
        F.when(found.contains("@"), "email").when(found.rlike(rf"^(?:{IP})$"), "ip").when(found.rlike(rf"^(?:{CARD})$"), "card").when(found.rlike(rf"^(?:{IBAN})$"), "iban")
        .when(found.rlike(rf"^(?:{FEMALE})\b"), "female").when(found.rlike(rf"^(?:{MALE})\b"), "male").otherwise("phone")
    )


def _core(kind: Column, found: Column) -> Column:
    """What two mentions of one entity share: digits of numbers, small letters of the rest, names without their title."""
    name = F.regexp_replace(found, rf"^(?:{FEMALE}|{MALE})\.? ", "")
    return F.when(kind.isin("phone", "card"), F.regexp_replace(found, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(found, " ", "")).when(
        kind.isin("female", "male"), F.lower(name)).when(kind == "email", F.lower(found)).otherwise(found)


def _pick(letters: str, byte: Column) -> Column:
    return F.substring(F.lit(letters), (byte % len(letters)).cast("int") + 1, F.lit(1))


def _replacement(key: str, kind: Column, core: Column, attempt: Column) -> Column:
    """A value of the same length and kinds of characters, from the keyed hash of entity and attempt."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(core) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, core, attempt.cast("string"), b.cast("string")), 256))
    stream = F.concat_ws("", blocks)
    byte = lambda i: F.conv(F.substring(stream, (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    at = lambda i: F.substring(core, i, F.lit(1))
    places = F.sequence(F.lit(1), F.greatest(F.length(core), F.lit(1)))
    dot = F.length(core) - F.length(F.substring_index(core, ".", -1))  # the ending of a domain stays
    number = lambda i: F.when(at(i).rlike("[0-9]"), _pick("0123456789", byte(i)))
    plain = F.transform(places, lambda i: number(i).when(at(i).rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", byte(i))).otherwise(at(i)))
    email = F.transform(places, lambda i: F.when(i > dot, at(i)).otherwise(number(i).when(at(i).rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", byte(i))).otherwise(at(i))))
    phone = F.transform(places, lambda i: F.when(i == 1, at(i)).otherwise(number(i)))

    def name(script: str, ending: int) -> Column:
        consonants, vowels, last = LETTERS[script][0], LETTERS[script][1], LETTERS[script][ending]
        return F.transform(places, lambda i: F.when(~at(i).rlike(r"\p{L}"), at(i)).when((i == F.length(core)) | (at(i + 1) == " "), F.lit(last)).when(i % 2 == 1, _pick(consonants, byte(i))).otherwise(_pick(vowels, byte(i))))

    by_script = lambda e: F.when(core.rlike(r"\p{IsCyrillic}"), name("cyrillic", e)).when(core.rlike(r"\p{IsGreek}"), name("greek", e)).otherwise(name("latin", e))
    octets = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i == 1, byte(i) % 223 + 1).otherwise(byte(i)).cast("string"))
    # a card keeps its first digit and gets the check digit that its type asks for
    digits = F.transform(places, lambda i: F.when(i == 1, at(i)).otherwise(_pick("0123456789", byte(i))))
    body = F.slice(digits, 1, F.length(core) - 1)
    doubled = F.transform(F.reverse(body), lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    check = (10 - F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10) % 10
    return (
        F.when(kind == "card", F.concat(F.concat_ws("", body), check.cast("string"))).when(kind == "ip", F.concat_ws(".", octets)).when(kind == "email", F.concat_ws("", email))
        .when(kind == "female", F.concat_ws("", by_script(2))).when(kind == "male", F.concat_ws("", by_script(3))).when(kind == "phone", F.concat_ws("", phone)).otherwise(F.concat_ws("", plain))
    )


def _write_as(kind: Column, found: Column, core: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one mention: its separators, capital letters and title."""
    shown = F.when(kind.isin("female", "male"), F.substring(found, (F.length(found) - F.length(core) + 1).cast("int"), F.length(core))).otherwise(found)
    kept = F.when(kind.isin("phone", "card"), "[0-9]").when(kind == "iban", "[^ ]").otherwise("(?s).")
    before = lambda i: F.length(F.when(kind.isin("phone", "card"), F.regexp_replace(F.substring(shown, F.lit(1), i), "[^0-9]", "")).when(
        kind == "iban", F.regexp_replace(F.substring(shown, F.lit(1), i), " ", "")).otherwise(F.substring(shown, F.lit(1), i)))

    def letter(i: Column) -> Column:
        old, new = F.substring(shown, i, F.lit(1)), F.substring(surrogate, before(i), F.lit(1))
        return F.when(~F.regexp_like(old, kept), old).when(old != F.lower(old), F.upper(new)).otherwise(new)

    written = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.greatest(F.length(shown), F.lit(1))), letter))
    rest = F.when(F.length(surrogate) > F.length(core), F.substring(surrogate, F.length(core) + 1, F.lit(64))).otherwise(F.lit(""))  # of a longer replacement
    title = F.when(kind.isin("female", "male"), F.substring(found, F.lit(1), (F.length(found) - F.length(core)).cast("int"))).otherwise(F.lit(""))
    return F.when(kind == "ip", surrogate).otherwise(F.concat(title, written, rest))


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, core, surrogate): distinct entities of a kind get distinct surrogates, none of which is an entity of the kind.

    Each attempt takes the next keyed replacement; it is given to the smallest of the entities that got it, if it is not
    given yet and stands nowhere in the texts. The others try again, few of them each time. After ATTEMPTS (a kind with
    more entities than values) the rest get a longer value that holds a hash of the entity.
    """
    entities = staged(entities.select("kind", "core").distinct(), "entities")
    # names are compared whatever their gender: readers see the name
    group = lambda kind: F.when(kind.isin("female", "male"), "name").otherwise(kind)
    taken = entities.select(group(F.col("kind")).alias("g"), F.col("core").alias("surrogate"))
    waiting, given = entities, []
    for attempt in range(ATTEMPTS + 1):
        new = _replacement(key, F.col("kind"), F.col("core"), F.lit(attempt))
        if attempt == ATTEMPTS:
            new = F.concat(new, F.lit("-"), F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "core"), 256))
        tried = waiting.withColumn("surrogate", new).withColumn("g", group(F.col("kind")))
        first = tried.groupBy("g", "surrogate").agg(F.min(F.struct("core", "kind")).alias("m")).join(taken, ["g", "surrogate"], "left_anti")
        now = staged(first.select("m.kind", "m.core", "surrogate", "g"), "given")
        given.append(now.drop("g"))
        waiting = staged(waiting.join(now.select("kind", "core"), ["kind", "core"], "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        taken = taken.unionByName(now.select("g", "surrogate"))
    out = given[0]
    for more in given[1:]:
        out = out.unionByName(more)
    return out


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, n_distinct) of each row of docs (doc_id, text), text with all its entities replaced.

    Found: mail and IP addresses, card and account numbers, phone numbers, names after a title. The same entity has the same
    surrogate in all texts, however it is written. Texts without entities come back as they are, null texts as null with 0
    entities; repeated rows are replaced alike, a null doc_id stays null, other columns are not read, an empty table gives an
    empty one. Only texts with entities are written and shuffled; a hot entity is a hot key of a plain join, which the
    adaptive planner splits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # most texts have no digit, @ or title: the one long pattern is for the others
    some = F.coalesce(F.col("text").rlike("[0-9@]") | F.col("text").rlike(NAME), F.lit(False)) & F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    clean = docs.where(~some).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_distinct"))
    some = docs.where(some).select("doc_id", F.split("text", ANY, -1).alias("between"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"), F.monotonically_increasing_id().alias("row"))
    some = staged(some, "with_entities")
    mentions = some.select("row", F.posexplode("found").alias("place", "found")).withColumn("kind", _kind(F.col("found")))
    mentions = mentions.withColumn("core", _core(F.col("kind"), F.col("found")))
    table = surrogate_table(mentions, key)
    written = mentions.join(table, ["kind", "core"]).select("row", "place", "kind", "core", _write_as(*map(F.col, ("kind", "found", "core", "surrogate"))).alias("new"))
    lists = written.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "new"))).alias("new"), F.count_distinct("kind", "core").alias("n_distinct"))
    pieces = F.concat(F.zip_with("between", "new.new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))
    return some.join(lists, "row").select("doc_id", F.concat_ws("", pieces).alias("text"), F.size("found").cast("long").alias("n_entities"), F.col("n_distinct").cast("long").alias("n_distinct")).unionByName(clean)
