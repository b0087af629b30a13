"""Surrogates for personal data: keyed, type-consistent replacements, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.base import bound
from epochlens.llm.common import cut

#: Given names by gender, as the detector knows them; more can be passed in.
GIVEN = {
    "f": ["Anna", "Maria", "Laura", "Sarah", "Emma", "Julia", "Claire", "Sophie", "Carmen", "Elena", "Mary", "Alice", "Анна", "Мария", "Ольга", "Елена"],
    "m": ["John", "Peter", "Paul", "Thomas", "David", "Michael", "Hans", "Pierre", "Juan", "Carlos", "James", "Robert", "Иван", "Пётр", "Сергей", "Павел"],
}
#: Titles that a name follows, by gender; those of neither say nothing about it.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"], "m": ["Mr", "Herr", "Monsieur", "Señor", "г-н"], "n": ["Dr", "Prof"]}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# groups are repeated possessively or a bounded number of times: others recurse in Java, once a character
_NAME = r"\p{Lu}(?:\p{L}|['’-](?=\p{L}))++"
#: What is found of each type; earlier ones win where two begin at the same place.
EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,24}"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<=(?i:token|secret|password|passwd|api.?key|access.?key)[ ]?[=:][ ]?[\"']?)[A-Za-z0-9+/_-]{16,}|(?<![A-Za-z0-9])[0-9a-fA-F]{32,128}(?![A-Za-z0-9])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"


def _names(given: dict[str, list[str]]) -> str:
    return "|".join(y for g in given.values() for x in g for y in (x, x.upper()))


def _titles() -> str:
    return "|".join(x for t in TITLES.values() for x in t)


#: What every text with an entity other than a name has; quicker to look for than the entities.
HINT = r"@|\+[0-9]|[0-9][0-9 ().-]{6}|[A-Z][0-9]{2}|[=:] ?[\"']?[A-Za-z0-9+/_-]{16}|[0-9a-fA-F]{32}"


def may_hold_entity(text: Column, given: dict[str, list[str]]) -> Column:
    """False only for texts that entity_pattern can't match, and cheap where it is False."""
    called = rf"(?=[\p{{Lu}}г])(?<![\p{{L}}\p{{N}}])(?:{_titles()}|{_names(given)})[.]?[ ]\p{{Lu}}"
    return text.rlike(HINT) | text.rlike(called)


def patterns(given: dict[str, list[str]]) -> dict[str, str]:
    """Patterns by type. Each word of a name is an entity of its own, so that a surname alone keeps its surrogate."""
    names, titles = _names(given), _titles()
    first = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:{names})(?=[ ]\p{{Lu}})|(?=\p{{Lu}})(?<=(?<![\p{{L}}\p{{N}}])(?:{titles})[.]?[ ])(?:{names})(?![\p{{L}}\p{{N}}])"
    last = rf"(?=\p{{Lu}})(?<=(?<![\p{{L}}\p{{N}}])(?:{names})[ ]){_NAME}|(?=\p{{Lu}})(?<=(?<![\p{{L}}\p{{N}}])(?:{titles})[.]?[ ]){_NAME}"
    return {"email": EMAIL, "ip": IP, "iban": IBAN, "secret": SECRET, "card": CARD, "ssn": SSN, "phone": PHONE, "given": first, "surname": last}


def entity_pattern(given: dict[str, list[str]]) -> str:
    return "|".join(f"(?:{p})" for p in patterns(given).values())


def entity_type(surface: Column, given: dict[str, list[str]]) -> Column:
    """The type of a match, told by the match alone. Given names carry their gender, as given_f and given_m."""
    lower = F.lower(surface)
    digits = F.length(F.regexp_replace(surface, "[^0-9]", ""))
    letters = F.regexp_count(surface, F.lit(r"[\p{L}]"))
    return (
        F.when(surface.contains("@"), "email")
        .when(surface.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip")
        .when(surface.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{9,39}$") & (digits >= 6), "iban")
        .when(surface.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when((letters == 0) & surface.rlike(r"^[0-9][0-9 -]+$") & (digits >= 13) & (digits <= 19), "card")
        .when((letters == 0) & (digits <= 19) & (F.length(surface) <= 64), "phone")
        .when(surface.rlike(r"^[\p{L}'’-]+$") & lower.isin([x.lower() for x in given["f"]]), "given_f")
        .when(surface.rlike(r"^[\p{L}'’-]+$") & lower.isin([x.lower() for x in given["m"]]), "given_m")
        .when(surface.rlike(rf"^{_NAME}$") & ~surface.rlike("^[0-9A-F]{32,}$"), "surname")
        .otherwise("secret")
    )


def hexadecimal(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{1,128}$")


def canonical(surface: Column, kind: Column) -> Column:
    """What mentions of one entity share: lower case, and for numbers no separators. Of secrets only short hexadecimal
    keys may be written in either case; others are themselves, to the letter."""
    whole = kind.isin("email", "given_f", "given_m", "surname", "ip") | hexadecimal(surface)
    return F.when(whole, F.lower(surface)).when(kind == "secret", surface).otherwise(F.lower(F.regexp_replace(surface, "[^A-Za-z0-9]", "")))


def stream(key: str, kind: Column, name: Column, attempt: Column, n: Column | int) -> Column:
    """Hex digits keyed by the entity, at least two for each of n characters."""
    blocks = lambda mark: F.transform(F.sequence(F.lit(0), F.floor(F.lit(n) / 32).cast("int")), lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, mark, attempt.cast("string"), i.cast("string")), 256))
    return F.array_join(bound(F.sha2(name, 256), blocks), "")


def byte(s: Column, i: Column) -> Column:
    return F.conv(F.substring(s, i * 2 - 1, F.lit(2)), 16, 10).cast("int")


def shaped(text: Column, s: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """text with each digit replaced by a digit and each ASCII letter by one of letters, in its case.

    Each 32 characters are one piece with bytes of their own, the digest of the stream and the piece's number, so a run of
    a million characters takes time in proportion.
    """
    pick = lambda v, of: F.substring(F.lit(of), v % len(of) + 1, F.lit(1))
    one = lambda c, v: F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike("[a-z]"), pick(v, letters)).when(c.rlike("[A-Z]"), pick(v, letters.upper())).otherwise(c)

    def piece(chars: Column, k: Column) -> Column:
        return bound(F.sha2(F.concat_ws("\x1f", s, k.cast("string")), 256), lambda b: F.array_join(F.transform(F.split(chars, ""), lambda c, i: one(c, byte(b, i + 1))), ""))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s).{1,32}"), F.lit(0)), piece), "")


def luhn(number: Column) -> Column:
    """The Luhn sum of a number modulo 10; 0 for a valid one."""
    def total(digits: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return acc + d - F.when(d > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), one) % 10

    return bound(number, total)


def iban_rest(text: Column) -> Column:
    """The number that an IBAN's account, country and check digits stand for, modulo 97."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def one(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 87) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), one)


#: Parts that invented names are made of, by script, and their endings by gender.
STEMS = {"latin": ["ar", "bel", "cor", "dan", "el", "fal", "gar", "hol", "ir", "jas", "kel", "lor", "mar", "nev", "or", "pel", "quin", "ros", "sol", "tar", "ul", "ven", "wil", "yor", "zan", "bran", "cal", "dor", "fen", "gal", "hel", "kor"], "cyrillic": ["бор", "вел", "гор", "дан", "жел", "зор", "кар", "лав", "мир", "нев", "рад", "сол", "тар", "ул", "фед", "яр"]}
ENDINGS = {"latin": {"f": ["a", "ina", "ela", "ia"], "m": ["o", "us", "en", "or"], "n": ["man", "sen", "well", "ford"]}, "cyrillic": {"f": ["а", "ина", "ия", "ела"], "m": ["ан", "ей", "ор", "ислав"], "n": ["енко", "ук", "ич", "ян"]}}


def invented_name(kind: Column, name: Column, s: Column, attempt: Column) -> Column:
    """A name of the same script and gender, of two parts and an ending, and one part more each four attempts."""
    def made(script: str, gender: str) -> Column:
        pick = lambda xs, i: F.array(*map(F.lit, xs))[byte(s, F.lit(i) if isinstance(i, int) else i) % len(xs)]
        parts = F.transform(F.sequence(F.lit(1), F.lit(2) + F.floor(attempt / 4).cast("int")), lambda i: pick(STEMS[script], i))
        return F.concat(F.array_join(parts, ""), pick(ENDINGS[script][gender], 32))

    gender = lambda script: F.when(kind == "given_f", made(script, "f")).when(kind == "given_m", made(script, "m")).otherwise(made(script, "n"))
    return F.when(name.rlike(r"\p{IsCyrillic}"), gender("cyrillic")).otherwise(gender("latin"))


def surrogate(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """A replacement in canonical form: it has the type's alphabet, length, check digits and structure."""
    def of(s: Column) -> Column:
        user, host = F.substring_index(name, "@", 1), F.substring_index(name, "@", -1)
        tld = F.substring_index(host, ".", -1)
        zone = F.substring(host, F.lit(1), F.length(host) - F.length(tld) - 1)
        # where a short form's replacements are used up, later attempts are longer
        more = F.floor(attempt / 8).cast("int")
        digits, letters = (F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.substring(F.translate(s, "abcdef", "012345") if x else F.translate(s, "0123456789", "ghijklmnop"), i + 8, F.lit(1))), "") for x in (True, False))
        grown = lambda text, tail: F.when(more > 0, F.concat(text, tail)).otherwise(text)
        mail = F.concat(grown(shaped(user, s), letters), F.lit("@"), bound(stream(key, F.lit("zone"), zone, F.lit(0), 32), lambda z: shaped(zone, z)), F.lit("."), tld)
        ip = F.concat_ws(".", byte(s, F.lit(1)) % 223 + 1, byte(s, F.lit(2)), byte(s, F.lit(3)), byte(s, F.lit(4)))
        number = bound(shaped(name, s), lambda x: F.concat((byte(s, F.lit(32)) % 9 + 1).cast("string"), F.substring(x, F.lit(2), F.length(x))))
        open_card = lambda x: F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("0"))
        card = bound(number, lambda x: F.concat(F.substring(x, F.lit(1), F.length(x) - 1), ((F.lit(20) - luhn(open_card(x)) + luhn(name)) % 10).cast("string")))
        zero = bound(shaped(F.substring(name, F.lit(5), F.length(name)), s), lambda x: F.concat(F.substring(name, 1, 2), F.lit("00"), x))
        iban = bound(zero, lambda x: F.concat(F.substring(name, 1, 2), F.lpad((98 - iban_rest(x)).cast("string"), 2, "0"), F.substring(x, F.lit(5), F.length(x))))
        secret = F.when(name.rlike("^[0-9a-f]+$"), shaped(name, s, "abcdef")).otherwise(shaped(name, s))
        return F.when(kind == "email", mail).when(kind == "ip", ip).when(kind == "card", card).when(kind.isin("phone", "ssn"), grown(number, digits)).when(kind == "iban", iban).when(kind == "secret", grown(secret, digits)).otherwise(invented_name(kind, name, s, attempt))

    return bound(stream(key, kind, name, attempt, 32), of)


def laid_out(surface: Column, kind: Column, made: Column) -> Column:
    """The canonical replacement in the form of a mention: its separators, and its case letter by letter."""
    def one(acc: Column, c: Column) -> Column:
        x = F.substring(made, acc["i"], F.lit(1))
        x = F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)
        filled = c.rlike("[A-Za-z0-9]") | kind.isin("email")
        return F.struct(F.concat(acc["o"], F.when(filled, x).otherwise(c)).alias("o"), (acc["i"] + F.when(filled, 1).otherwise(0)).alias("i"))

    # what a longer replacement has beyond the mention follows it
    by_character = bound(F.aggregate(F.split(surface, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("i")), one), lambda x: F.concat(x["o"], F.substring(made, x["i"], F.length(made))))
    name = F.when((F.upper(surface) == surface) & (F.length(surface) > 1), F.upper(made)).when(F.lower(surface) == surface, made).otherwise(F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, F.lit(2), F.length(made))))
    as_made = (kind == "ip") | ((kind == "secret") & ~hexadecimal(surface))
    return F.when(kind.isin("given_f", "given_m", "surname"), name).when(as_made, made).otherwise(by_character)


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, name, made) for distinct (kind, name), with made unlike every other made and every real name of its kind.

    Where several entities get the same replacement, the first by name keeps it and the others draw again; one that
    equals a real entity draws again too. Each round is written, and they end when nothing clashes.
    """
    real = entities.select("kind", F.col("name").alias("made"), F.lit(True).alias("taken"))
    now = entities.withColumn("attempt", F.lit(0))
    while True:
        now = cut(now.select("kind", "name", "attempt", surrogate(key, F.col("kind"), F.col("name"), F.col("attempt")).alias("made")), "surrogates")
        first = now.groupBy("kind", "made").agg(F.min("name").alias("owner"))
        judged = now.join(first, ["kind", "made"]).join(real, ["kind", "made"], "left")
        judged = judged.withColumn("again", (F.col("owner") != F.col("name")) | F.coalesce("taken", F.lit(False)))
        if not judged.where("again").limit(1).count():
            return now
        now = judged.select("kind", "name", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def replace_entities(docs: DataFrame, key: str, given: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every detected entity in text replaced, and with pii_entities, their number.

    Emails, IPv4 addresses, IBANs, secrets, card, social security and phone numbers and names (after a title,
    or a known given name with what follows) are found by one pattern. An entity has the same replacement in every
    mention and document, as the key says; another key gives others. A replacement keeps the type, length,
    separators, case, script, the gender of given names, the country of an IBAN and valid check digits; mail
    addresses of one domain keep one domain. Distinct entities stay distinct. A number in the form of a card that
    fails the card's check digit is no entity.

    Only rows with a match are shuffled, by id and text; the others pass through. Null texts stay null and empty
    ones empty, with no entity; rows that repeat an id or a text get a row each; a column pii_entities is replaced. Very long
    texts and runs are matched whole, in time and stack that don't grow with the square of the run.
    """
    given = given or GIVEN
    pattern = entity_pattern(given)
    docs = docs.drop("pii_entities")
    cols = docs.columns
    found = may_hold_entity(docs[text_col], given) & docs[text_col].rlike(pattern)
    clean = docs.where(F.coalesce(~found, F.lit(True))).withColumn("pii_entities", F.lit(0))
    hit = docs.where(found).select(F.struct(*[docs[c] for c in cols]).alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("mark"), docs[text_col].alias("t"))
    hit = cut(hit.select("row", "id", "mark", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("found"), F.split("t", pattern, -1).alias("gaps")), "pii-rows")
    named = lambda s: bound(entity_type(s, given), lambda kind: F.struct(kind.alias("kind"), canonical(s, kind).alias("name")))
    mentions = hit.select("id", "mark", F.posexplode("found").alias("pos", "surface")).select("id", "mark", "pos", "surface", bound(F.col("surface"), named).alias("x"))
    mentions = mentions.select("id", "mark", "pos", "surface", F.col("x.kind").alias("kind"), F.col("x.name").alias("name"))
    entity = F.when(F.col("kind") == "card", luhn(F.col("name")) == 0).otherwise(True)
    made = distinct_surrogates(mentions.where(entity).select("kind", "name").distinct(), key)
    # one place for each match, null where it is no entity, so that places are looked up by their number
    filled = mentions.join(made, ["kind", "name"], "left").select("id", "mark", F.struct("pos", laid_out(F.col("surface"), F.col("kind"), F.col("made")).alias("new")).alias("x")).distinct()
    filled = filled.groupBy("id", "mark").agg(F.array_sort(F.collect_list("x"))["new"].alias("new")).select(F.col("id").alias("f_id"), F.col("mark").alias("f_mark"), "new")
    whole = hit.join(filled, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("mark") == F.col("f_mark")), "left")
    text = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("new", i), F.get("found", i), F.lit("")))), "")
    whole = whole.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in cols], F.coalesce(F.size(F.array_compact("new")), F.lit(0)).alias("pii_entities"))
    return clean.unionByName(whole)
