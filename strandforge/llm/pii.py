"""Personal data replaced by surrogates, with DataFrame functions only.

One pattern finds the entities; each gets one surrogate for the whole corpus, whatever form its mentions have, so they still refer to
one thing (coreference): letter case of addresses, blanks and punctuation of numbers, titles, and a family name alone after a full name
in one text; each mention keeps its own form. A surrogate follows from a secret key that the caller gives, the kind, the entity and an attempt number. It keeps
kind, punctuation, letter case and script, and but for names and network addresses the length; an IBAN keeps its country and the validity of its check digits, a
phone number its calling code, a card number the validity of its check digit, a name the gender and script of its title. Rounds of
collision checks keep entities distinct: a surrogate that another entity has, or that is itself an entity of the corpus, is drawn again.
After SHAPED draws of an entity's own length each draw is a character longer than the one before, so a full shape is left behind.

Every pattern takes time in proportion to the text: what can repeat without a bound is possessive and begins only where its run begins.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, read
from .spans import spans

SHAPED = 8
#: The session's setting that names the key of the registered query, which without it uses a key that isn't secret.
KEY_SETTING, OPEN_KEY = "spark.strandforge.pii.key", "not secret"

# What is looked for, in order of precedence, and the names that stand in.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![A-Za-z0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "name": r"(?<!\p{L})(?:Mrs?\.?|Ms\.?|Miss|Herrn?|Frau|Monsieur|Madame|Señora?|господин|госпожа|Κύριος|Κυρία)[ ]\p{Lu}[\p{L}'’-]++(?:[ ]\p{Lu}[\p{L}'’-]++)?+",
}
FEMALE_TITLES = ["Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Frau", "Madame", "Señora", "госпожа", "Κυρία"]
NAMES = {
    ("Latin", "f"): ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Sofia"],
    ("Latin", "m"): ["Adam", "Bruno", "David", "Jonas", "Martin", "Oscar", "Paul", "Victor"],
    ("Latin", "s"): ["Adler", "Berger", "Costa", "Duval", "Garner", "Linden", "Moreau", "Novak"],
    ("Cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("Cyrillic", "m"): ["Антон", "Борис", "Иван", "Михаил", "Павел", "Роман", "Сергей", "Юрий"],
    ("Cyrillic", "s"): ["Бондарь", "Витязь", "Гончар", "Журба", "Коваль", "Мороз", "Соловей", "Шевчук"],
    ("Greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία", "Χρύσα"],
    ("Greek", "m"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Μιχάλης", "Νίκος", "Πέτρος", "Σπύρος"],
    ("Greek", "s"): ["Βλάχος", "Γαλάνης", "Δούκας", "Καρράς", "Λάμπρου", "Μαυράκης", "Νικολάου", "Ράπτης"],
}
# Calling codes of one, two or three digits.
CALLING = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _draw(seed: Column, i: Column, n: int) -> Column:
    """A number from 0 to n-1."""
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _letters(entity: Column, seed: Column) -> Column:
    """Each digit and letter replaced by one of its class; é and the like by a small or large letter; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda of: F.substring(F.lit(of), _draw(seed, i, len(of)) + 1, F.lit(1))
        return (
            F.when(c.rlike("^[0-9]$"), pick(DIGITS))
            .when(c.rlike(r"^\p{Ll}$"), pick(SMALL))
            .when(c.rlike(r"^\p{Lu}$"), pick(LARGE))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _more(seed: Column, n: int, of: str) -> Column:
    """n drawn characters."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(F.lit(of), _draw(F.concat(seed, F.lit("more")), i, len(of)) + 1, F.lit(1))), "") if n else F.lit("")


def _odd_sum(entity: Column) -> Column:
    """The sum that a valid card number has divisible by ten."""
    ds = F.split(F.reverse(F.regexp_replace(entity, "[^0-9]", "")), "")

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.filter(ds, lambda c: c != ""), part), F.lit(0), lambda s, x: s + x)


def _check_digits(country: Column, account: Column) -> Column:
    """The number, 2 to 98, that makes an IBAN of this country and account valid."""

    def step(left: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.pmod(F.when(digit, left * 10 + F.when(digit, c).cast("int")).otherwise(left * 100 + F.ascii(c) - 55), F.lit(97))

    return 98 - F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)


def surrogate(kind: Column, entity: Column, attempt: int, key: str) -> Column:
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, F.lit(str(attempt))).cast("binary"), 256)
    longer = max(0, attempt + 1 - SHAPED)
    plain = F.concat(_letters(entity, seed), _more(seed, longer, DIGITS))
    at = F.instr(entity, "@")
    host = F.substring_index(entity, "@", -1)
    email = F.concat(_more(seed, longer, SMALL), _letters(F.substring(entity, F.lit(1), at - 1), seed), F.lit("@"), F.concat(_letters(F.substring_index(host, ".", 1), F.concat(seed, F.lit("host"))), F.substring(host, F.length(F.substring_index(host, ".", 1)) + 1, F.length(host))))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    ip = F.concat(ip, _more(seed, longer, DIGITS))
    # the last digit of a card moves by what makes the drawn number as valid as the entity
    off = F.pmod(_odd_sum(entity) - _odd_sum(plain), F.lit(10))
    last = F.pmod(F.substring(plain, -1, 1).cast("int") + off, F.lit(10)).cast("string")
    card = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), last)
    # check digits move by as much from the valid ones as the entity's do
    country, account, new = F.substring(entity, 1, 2), F.substring(entity, F.lit(5), F.length(entity)), F.substring(plain, F.lit(5), F.length(plain))
    wrong = F.substring(entity, 3, 2).try_cast("int") - _check_digits(country, account)
    iban = F.concat(country, F.format_string("%02d", F.pmod(_check_digits(country, new) + wrong - 2, F.lit(97)) + 2), new)
    code = F.regexp_extract(entity, CALLING, 0)
    phone = F.concat(code, F.substring(plain, F.length(code) + 1, F.length(plain)))
    words = F.split(entity, " ")
    title, parts = F.element_at(words, 1), F.size(words)
    script = _script(entity)
    woman = title.isin(FEMALE_TITLES)
    name = None
    for (of, sort), names in NAMES.items():
        if sort == "s":
            continue
        last_names = NAMES[(of, "s")]
        first = F.element_at(F.array(*map(F.lit, names)), _draw(seed, F.lit(0), len(names)) + 1)
        # a few hundred pairs of names don't keep many people apart, so a drawn ending of letters follows the family name
        ending = F.lower(_letters(F.lit("aaa"), seed)) if of == "Latin" else F.translate(F.substring(seed, 1, 3), "0123456789abcdef", "абвгдежзиклмнопр" if of == "Cyrillic" else "αβγδεζηθικλμνοπρ")
        ending = F.concat(ending, _more(seed, longer, SMALL if of == "Latin" else "абвгдежзиклмнопр" if of == "Cyrillic" else "αβγδεζηθικλμνοπρ"))
        family = F.concat(F.element_at(F.array(*map(F.lit, last_names)), _draw(seed, F.lit(1), len(last_names)) + 1), ending)
        told = F.when(parts > 2, F.concat_ws(" ", title, first, family)).otherwise(F.concat_ws(" ", title, family))
        here = (script == of) & (woman if sort == "f" else ~woman)
        name = F.when(here, told) if name is None else name.when(here, told)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "name", name).otherwise(plain)


def surrogates(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """kind, entity, surrogate: one row for each of the distinct (kind, entity), no two surrogates of a kind alike, none an entity.

    Rounds go on until all have one. They end: once draws are longer than all entities and earlier surrogates, each round settles one
    entity at least, and nearly all as soon as there are more strings of the drawn length than entities."""
    entities = scratch.save(entities.select("kind", "entity").distinct())
    done, waiting = None, entities
    for attempt in count():
        drawn = waiting.select("kind", "entity", surrogate(F.col("kind"), F.col("entity"), attempt, key).alias("surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        free = first.join(entities.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        got = scratch.save(free.select("kind", "entity", "surrogate"))
        done = got if done is None else done.union(got)
        waiting = scratch.save(waiting.join(got.select("kind", "entity"), ["kind", "entity"], "left_anti"))
        if waiting.isEmpty():
            return done


def _script(entity: Column) -> Column:
    return F.when(entity.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(entity.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")


def canonical(kind: Column, entity: Column) -> Column:
    """What all forms of an entity have in common, itself an entity of its kind: an address in small letters, an IBAN, a card or phone
    number without blanks and punctuation (but a leading +), a name with one title for each gender and script."""
    woman = F.substring_index(entity, " ", 1).isin(FEMALE_TITLES)
    title = F.when(_script(entity) == "Cyrillic", F.when(woman, "госпожа").otherwise("господин")).when(_script(entity) == "Greek", F.when(woman, "Κυρία").otherwise("Κύριος")).otherwise(F.when(woman, "Mrs").otherwise("Mr"))
    digits = F.concat(F.regexp_extract(entity, r"^\+?", 0), F.regexp_replace(entity, "[^0-9]", ""))
    return (
        F.when(kind == "email", F.lower(entity)).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind.isin("card", "phone"), digits)
        .when(kind == "name", F.concat_ws(" ", title, F.substring(entity, F.instr(entity, " ") + 1, F.length(entity)))).otherwise(entity)
    )


def rendered(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate of canonical(entity) in the entity's own format."""
    over = F.length(surrogate) - F.length(entity)
    email = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substring(entity, i - over + 1, F.lit(1)).rlike("^[A-Z]$") & (i >= over), F.upper(c)).otherwise(c)), "")
    # digits (and an IBAN's letters) go into the entity's places one after another, what a longer draw has besides to the end
    signs = F.regexp_replace(surrogate, "[^0-9A-Z]", "")
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[^0-9A-Z]", ""))
    put = F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("^[0-9A-Z]$"), F.substring(signs, before(i) + 1, F.lit(1))).otherwise(c))
    placed = F.concat(F.array_join(put, ""), F.substring(signs, before(F.length(entity)) + 1, F.length(signs)))
    words = F.split(surrogate, " ")
    given = F.when(F.size(F.split(entity, " ")) > 2, F.slice(words, 2, 2)).otherwise(F.slice(words, -1, 1))
    name = F.concat_ws(" ", F.substring_index(entity, " ", 1), F.array_join(given, " "))
    return F.when(kind == "email", email).when(kind.isin("iban", "card", "phone"), placed).when(kind == "name", name).otherwise(surrogate)


def corefer(mentions: DataFrame) -> DataFrame:
    """row, i, kind, entity and what it is: one value for all mentions of a thing. A title and family name is the full name of that
    title's gender and script that its row has, if it has just one."""
    told = mentions.withColumn("is", canonical(F.col("kind"), F.col("entity")))
    words = F.split("is", " ")
    short = F.when((F.col("kind") == "name") & (F.size(words) > 2), F.concat_ws(" ", words[0], F.element_at(words, -1)))
    full = told.withColumn("short", short).filter("short IS NOT NULL").groupBy("row", "short").agg(F.min("is").alias("full"), F.max("is").alias("other")).filter(F.col("full") == F.col("other"))
    family = told.join(full.select("row", F.col("short").alias("is"), "full", F.lit("name").alias("kind")), ["row", "kind", "is"], "left")
    return family.select("row", "i", "kind", "entity", F.coalesce("full", "is").alias("is"))


def pseudonymised(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text with surrogates, entities: (kind, start, end, value) in the old text's code points.

    key is the secret from which surrogates follow: with another key they are others. Null text stays null and has no entities; rows that repeat
    a doc_id, or have none, are rows of their own, the same entity has the same
    surrogate, in the mention's format, in all; other columns aren't read. An entity at several places, in however many rows, is one entity."""
    if not key:
        raise ValueError("surrogates need a secret key")
    scratch = Scratch(docs.sparkSession)
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    marked = lambda found: F.transform(found, lambda s: F.struct(kind_of(s["value"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    # texts are searched once; the rows that this saves are all that is read from here on
    scanned = scratch.save(raw.select("row", "doc_id", "text", marked(spans(F.coalesce("text", F.lit("")), ANY, "")).alias("entities")))
    some = scanned.filter(F.size("entities") > 0)
    mentions = some.select("row", F.posexplode("entities").alias("i", "s")).select("row", "i", "s.kind", F.col("s.value").alias("entity"))
    mentions = scratch.save(corefer(mentions))
    chosen = surrogates(mentions.select("kind", F.col("is").alias("entity")), key, scratch).select("kind", F.col("entity").alias("is"), "surrogate")
    put = mentions.join(chosen, ["kind", "is"]).select("row", "i", rendered(F.col("kind"), F.col("entity"), F.col("surrogate")).alias("surrogate"))
    new = put.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "surrogate"))).alias("new"))

    gaps = F.split("text", ANY, -1)  # by places, every piece would cost the whole text before it
    pieces = F.transform(F.arrays_zip(gaps.alias("gap"), F.transform("new", lambda x: x["surrogate"]).alias("put")), lambda x: F.concat(x["gap"], F.coalesce(x["put"], F.lit(""))))
    written = some.join(new, "row").select("doc_id", F.array_join(pieces, "").alias("text"), "entities")
    return written.union(scanned.filter(F.size("entities") == 0).select("doc_id", "text", "entities"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(read(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, OPEN_KEY))
    said = F.array_join(F.transform("entities", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), said.alias("spans"), "text")
