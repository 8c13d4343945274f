"""Personal data replaced by keyed, type-consistent surrogates, in DataFrame functions only.

A detected entity has a kind and a canonical form, so that different spellings of one entity share it. Its
surrogate is drawn from a keyed hash of both and has the same shape: digits for digits, letters of the same
script for letters, valid check digits, names of the same gender. All distinct entities are checked against
each other: two that would share a surrogate, or one whose surrogate is another real entity, are drawn
again, so distinct entities stay distinct and one entity is replaced alike everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import fold, written

#: Titles before a person's name, by gender (n: none told); a name is up to five capitalised words or initials.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа"],
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин"],
    "n": ["Dr", "Prof", "Professor", "Κύριος", "Κυρία"],
}
#: Words that introduce a secret.
SECRET_WORDS = ["token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "access_key"]
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP4 = rf"{OCTET}(?:\.{OCTET}){{3}}(?!\.\d)"
#: Eight groups, or fewer around `::` after two groups or a first one that only addresses begin with.
IP6 = (
    r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"
    r"|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}|(?i:fe80|f[cd][0-9a-f]{2}|2[0-9a-f]{3}))::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?"
)
CARD = r"\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{13,19}"
SOCIAL = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
CLOUD = r"(?:AKIA|ASIA)[0-9A-Z]{16}"
SECRET = rf"(?i:{'|'.join(SECRET_WORDS)})\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9_+/-]{{8,}}"
#: A word of a name, with capitals after hyphens and apostrophes, or an initial.
WORD = r"\p{Lu}(?:\p{L}+(?:[-'’]\p{Lu}\p{L}+)*|['’]\p{Lu}\p{L}+)"
NAME = rf"(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.? (?:(?:\p{{Lu}}\.|{WORD}) ){{0,4}}{WORD}"
#: Everything that is looked for; what begins inside a word or number isn't an entity.
ENTITY = rf"{EMAIL}|(?<![\p{{L}}\p{{N}}])(?:{SECRET}|{NAME}|{CLOUD}|{IBAN}|{IP4}|{IP6}|{SOCIAL}|{PHONE}|{CARD})(?![\p{{L}}\p{{N}}])"
#: A text without any of these holds no entity.
HINT = rf"[@\d]|AKIA|ASIA|(?i:{'|'.join(SECRET_WORDS)})|{'|'.join(t for ts in TITLES.values() for t in ts)}"
SIGN = r"[^\p{L}\p{N}]"
#: The words between title and family name.
GIVEN = rf"^\S+ (.+) {WORD}$"

LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
#: Onsets and vowels of drawn names, and the endings of first names of women and men and of family names.
SYLLABLES = {"Latin": ("bdfgklmnprstvz", "aeiou"), "Cyrillic": ("бвгджзклмнпрст", "аеиоу"), "Greek": ("βγδζθκλμνπρστφ", "αειου")}
ENDINGS = {"Latin": ("na", "ton", "len", "ster"), "Cyrillic": ("на", "тон", "лен", "ский"), "Greek": ("να", "τον", "λεν", "ιδης")}


def digits(o: Column) -> Column:
    return F.regexp_replace(o, r"[^0-9]", "")


def kind_of(o: Column) -> Column:
    """The kind of a match; null if its check digits show that it is none."""
    iban = F.upper(F.regexp_replace(o, " ", ""))
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    female, male, untold = (o.rlike(rf"^(?:{'|'.join(TITLES[g])})\.? ") for g in "fmn")
    return (
        F.when(o.contains("@"), F.lit("email"))
        .when(o.rlike(rf"^(?i:{'|'.join(SECRET_WORDS)})\s*[=:]"), F.lit("secret"))
        .when(female, F.lit("name_f"))
        .when(male, F.lit("name_m"))
        .when(untold, F.lit("name_n"))
        .when(o.rlike(f"^{CLOUD}$"), F.lit("cloud_key"))
        .when(o.rlike(f"^(?:{IP4})$"), F.lit("ipv4"))
        .when(o.rlike(f"^(?:{IP6})$"), F.lit("ipv6"))
        .when(o.rlike(r"^[A-Z]{2}\d{2}"), F.when(remainder(moved) == 1, F.lit("iban")))
        .when(o.rlike(f"^{SOCIAL}$"), F.lit("social"))
        .when(o.rlike(f"^(?:{PHONE})$"), F.lit("phone"))
        .when(F.call_function("luhn_check", digits(o)), F.lit("card"))
    )


def remainder(text: Column) -> Column:
    """Modulo 97 of digits and letters (A is 10)."""
    chars = F.split(text, "")
    value = F.aggregate(
        chars,
        F.lit(0).cast("long"),
        lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + F.ascii(c) - 48) % 97).when(c.rlike("^[A-Z]$"), (s * 100 + F.ascii(c) - 55) % 97).otherwise(s),
    )
    return value


def canonical(o: Column, kind: Column) -> Column:
    """What two spellings of one entity share. A phone number's is its last ten digits, a name's its last word."""
    number = digits(o)
    return (
        F.when(kind == "email", F.lower(o))
        .when(kind == "secret", F.regexp_extract(o, r"([A-Za-z0-9_+/-]{8,})$", 1))
        .when(kind.startswith("name"), F.lower(F.regexp_extract(o, rf"({WORD})$", 1)))
        .when(kind == "phone", F.when(F.length(number) > 10, F.substr(number, F.length(number) - 9)).otherwise(number))
        .when(kind.isin("card", "social"), number)
        .when(kind == "iban", F.upper(F.regexp_replace(o, " ", "")))
        .when(kind == "ipv6", F.lower(o))
        .otherwise(o)
    )


def given(o: Column) -> Column:
    """The words and initials between title and family name in lower case, empty if there are none."""
    return F.lower(F.regexp_extract(o, GIVEN, 1))


def draw(key: str, *parts: Column) -> Column:
    """128 hex digits from the key and the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)


def number_at(h: Column, i: Column) -> Column:
    """A number from 0 to 255 at a place of a draw, which is read round and round."""
    return F.conv(F.substr(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def shaped(text: Column, h: Column, hexadecimal: bool = False) -> Column:
    """Each character drawn anew within its class: digit, upper or lower Latin, Cyrillic or Greek letter."""

    def one(c: Column, i: Column) -> Column:
        n = number_at(h, i)
        if hexadecimal:
            return F.when(c.rlike("^[0-9a-f]$"), F.lower(F.hex(n % 16))).when(c.rlike("^[A-F]$"), F.hex(n % 16)).otherwise(c)
        small = F.when(c.rlike(r"^\p{IsCyrillic}$"), pick(CYRILLIC, n)).when(c.rlike(r"^\p{IsGreek}$"), pick(GREEK, n)).otherwise(pick(LATIN, n))
        return F.when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(small)).when(c.rlike(r"^\p{L}$"), small).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_digit(body: Column) -> Column:
    """The check digit after a string of digits."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) * 2 - 96 - F.when(F.ascii(c) >= 53, F.lit(9)).otherwise(0)).otherwise(F.ascii(c) - 48)),
        F.lit(0),
        lambda s, d: s + d,
    )
    return ((F.lit(10) - total % 10) % 10).cast("string")


def spoken(word: Column, kind: Column, h: Column, attempt: Column) -> Column:
    """A name of three drawn syllables in the word's script, with the ending of its kind; one syllable more
    from the fourth draw on."""

    def built(script: str) -> Column:
        onsets, vowels = SYLLABLES[script]
        female, male, untold, family = ENDINGS[script]
        places = F.sequence(F.lit(0), F.when(attempt >= 4, F.lit(3)).otherwise(F.lit(2)))
        stem = F.array_join(F.transform(places, lambda i: F.concat(pick(onsets, number_at(h, 2 * i)), pick(vowels, number_at(h, 2 * i + 1)))), "")
        return F.concat(stem, F.when(kind == "given_f", F.lit(female)).when(kind == "given_m", F.lit(male)).when(kind == "given_n", F.lit(untold)).otherwise(F.lit(family)))

    first = F.when(word.rlike(r"\p{IsCyrillic}"), built("Cyrillic")).when(word.rlike(r"\p{IsGreek}"), built("Greek")).otherwise(built("Latin"))
    # An initial stays one, and so do further words and initials; the parts of a double name become one name.
    further = F.regexp_extract(word, r"^\S+( .*)$", 1)
    first = F.when(word.rlike(r"^\p{L}\."), F.concat(F.substr(shaped(word, h), F.lit(1), F.lit(1)), F.lit("."))).otherwise(first)
    return F.concat(first, F.when(further == "", F.lit("")).otherwise(shaped(further, F.reverse(h))))


def surrogates(key: str, units: Column) -> Column:
    """For an array of (kind, canon, attempt) the surrogates, in canonical form. Every step is a pass over the
    array, so that no expression is stated twice."""
    domain = F.substring_index

    def with_draws(u: Column) -> Column:
        draws = draw(key, u["kind"], u["canon"], u["attempt"].cast("string"))
        return F.struct(*[u[c].alias(c) for c in ("kind", "canon", "attempt")], draws.alias("h"), draw(key, F.lit("domain"), domain(u["canon"], "@", -1)).alias("g"))

    def with_shape(u: Column) -> Column:
        hexadecimal = (u["kind"] == "ipv6") | ((u["kind"] == "secret") & u["canon"].rlike("^[0-9a-fA-F]+$"))
        plain = F.when(u["kind"] == "email", domain(u["canon"], "@", 1)).otherwise(u["canon"])
        drawn = F.when(hexadecimal, shaped(u["canon"], u["h"], hexadecimal=True)).otherwise(shaped(plain, u["h"]))
        return F.struct(*[u[c].alias(c) for c in ("kind", "canon", "attempt", "h", "g")], drawn.alias("drawn"))

    def whole(u: Column) -> Column:
        kind, canon, h, drawn = u["kind"], u["canon"], u["h"], u["drawn"]
        longer = F.when(u["attempt"] >= 4, F.substr(F.translate(h, "0123456789", "ghijklmnop"), F.lit(1), u["attempt"] - 3)).otherwise("")
        place, top = F.regexp_extract(canon, r"@(.*)\.[^.]+$", 1), domain(canon, ".", -1)
        body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2), F.length(canon) - 2))
        land, account = F.substr(canon, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(5))
        check = F.lpad((F.lit(98) - remainder(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0")
        octets = F.concat_ws(".", domain(canon, ".", 1), *[(number_at(h, F.lit(i)) % 254 + 1).cast("string") for i in range(3)])
        return (
            F.when(kind == "email", F.concat(drawn, longer, F.lit("@"), shaped(place, u["g"]), F.lit("."), top))
            .when(kind == "phone", F.concat((number_at(h, F.lit(63)) % 8 + 2).cast("string"), F.substr(drawn, F.lit(2))))
            .when(kind == "card", F.concat(body, luhn_digit(body)))
            .when(kind == "iban", F.concat(land, check, account))
            .when(kind == "ipv4", octets)
            .when(kind == "cloud_key", F.concat(F.substr(canon, F.lit(1), F.lit(4)), account))
            .when(kind.isin("given_f", "given_m", "given_n", "family"), spoken(canon, kind, h, u["attempt"]))
            .otherwise(drawn)
        )

    return F.transform(F.transform(F.transform(units, with_draws), with_shape), whole)


def poured(o: Column, s: Column) -> Column:
    """The surrogate's letters and digits in the places of the match's last ones; signs and earlier ones stay."""
    extra = F.length(F.regexp_replace(o, SIGN, "")) - F.length(s)

    def one(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substr(o, F.lit(1), i + 1), SIGN, "")) - extra
        return F.when(c.rlike(f"^{SIGN}$") | (place < 1), c).otherwise(F.substr(s, place, F.lit(1)))

    return F.array_join(F.transform(F.split(o, ""), one), "")


def cased(word: Column, s: Column) -> Column:
    """The surrogate in capitals, with one capital, or plain, like the word."""
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(s)).when(word.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.substr(s, F.lit(2)))).otherwise(s)


def words_cased(words: Column, s: Column) -> Column:
    """`cased` word by word; both have as many."""
    return F.array_join(F.transform(F.arrays_zip(F.split(words, " ").alias("w"), F.split(s, " ").alias("s")), lambda z: cased(z["w"], z["s"])), " ")


def family(kind: Column) -> Column:
    """The kind that an entity is known by: a family name is one, whoever bears it."""
    return F.when(kind.startswith("name"), F.lit("family")).otherwise(kind)


def first_kind(kind: Column) -> Column:
    return F.when(kind == "name_f", F.lit("given_f")).when(kind == "name_n", F.lit("given_n")).otherwise(F.lit("given_m"))


def in_place(o: Column, kind: Column, s: Column, first: Column) -> Column:
    """The match with its surrogate: signs, spaces, title and prefix as they were."""
    name = F.concat(
        F.regexp_extract(o, r"^(\S+ )", 1),
        F.when(given(o) != "", F.concat(words_cased(F.regexp_extract(o, GIVEN, 1), first), F.lit(" "))).otherwise(""),
        cased(F.regexp_extract(o, rf"({WORD})$", 1), s),
    )
    return (
        F.when(kind.isNull(), o)
        .when(kind.startswith("name"), name)
        .when(kind == "email", cased(o, s))
        .when(kind == "secret", F.concat(F.regexp_extract(o, r"^(.*?)[A-Za-z0-9_+/-]{8,}$", 1), s))
        .when(kind.isin("ipv4", "cloud_key"), s)
        .when(kind == "ipv6", F.when(o == F.upper(o), F.upper(s)).otherwise(s))
        .otherwise(poured(o, s))
    )


def found(text: Column) -> Column:
    """Matches in order, each with its kind and canonical forms."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1)), lambda o: F.struct(o.alias("o"), kind_of(o).alias("kind")))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, canon): the distinct entities of all texts."""
    held = docs.select(fold(text).alias("text")).where(F.col("text").rlike(HINT))
    each = held.select(F.explode(found(F.col("text"))).alias("e")).where("e.kind is not null").select("e.o", "e.kind").distinct()
    o, kind = F.col("o"), F.col("kind")
    pair = F.array(F.struct(family(kind).alias("kind"), canonical(o, kind).alias("canon")), F.struct(first_kind(kind).alias("kind"), F.when(kind.startswith("name"), given(o)).alias("canon")))
    return each.select(F.explode(pair).alias("p")).select("p.kind", "p.canon").where("canon != ''").distinct()


def settled(known: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of distinct entities whose surrogates all differ from each other and from every
    entity of their kind. Only those that clash are drawn again; of those that share a surrogate the least
    one keeps it."""
    new = surrogates(key, F.array(F.struct("kind", "canon", "attempt")))[0]
    known = written(known.withColumn("attempt", F.lit(0)).withColumn("s", new), "surrogates")
    real = known.select("kind", F.col("canon").alias("s"))
    while True:
        shared = known.groupBy("kind", "s").agg(F.min(F.struct(-F.col("attempt"), "canon"))["canon"].alias("keeps"), F.count("*").alias("n")).where("n > 1").select("kind", "s", "keeps")
        taken = known.join(real, ["kind", "s"], "left_semi").select("kind", "s", F.lit(None).cast("string").alias("keeps"))
        clash = known.join(shared.union(taken), ["kind", "s"]).where("keeps is null or keeps != canon").select("kind", "canon").distinct()
        clash = written(clash, "clashes")
        if clash.isEmpty():
            return known.select("kind", "canon", "attempt")
        again = known.join(clash, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn("s", new)
        known = written(known.join(clash, ["kind", "canon"], "left_anti").unionByName(again), "surrogates")


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with new texts, and n_entities and kinds (of each replaced entity, in order).

    key: the secret that the surrogates depend on. Null texts stay null and empty ones empty; a text without
    entities stays as it is, and so does everything around entities; repeated rows stay and get the same
    text; other columns pass, but n_entities and kinds are new and take the place of any of that name. An
    empty table gives no rows. Texts are not shuffled: only entities that had to be drawn again, if there are
    any, are brought to the texts that hold them."""
    docs = docs.drop("n_entities", "kinds")
    again = written(settled(entities(docs, text), key).where("attempt > 0"), "again")
    value = F.col(text).cast("string")
    hit = F.coalesce(value.rlike(HINT), F.lit(False))
    rows = docs.withColumn("_found", F.when(hit, found(value)).otherwise(found(F.lit(""))))
    if again.isEmpty():
        rows = rows.withColumn("_again", F.lit(None).cast("map<string,int>"))
    else:
        marks = [F.xxhash64(F.lit(i), value).alias(f"_h{i}") for i in (1, 2)]
        o, kind = F.col("e.o"), F.col("e.kind")
        held = rows.select(*marks, F.explode("_found").alias("e")).where("e.kind is not null")
        units = held.select("_h1", "_h2", F.explode(F.array(F.struct(family(kind).alias("kind"), canonical(o, kind).alias("canon")), F.struct(first_kind(kind).alias("kind"), given(o).alias("canon")))).alias("u"))
        units = units.select("_h1", "_h2", "u.kind", "u.canon").distinct().join(again, ["kind", "canon"])
        maps = units.groupBy("_h1", "_h2").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "canon"), "attempt"))).alias("_again"))
        rows = rows.withColumns({f"_h{i}": m for i, m in zip((1, 2), marks)}).join(written(maps, "maps"), ["_h1", "_h2"], "left").drop("_h1", "_h2")

    def unit(kind: Column, canon: Column) -> Column:
        drawn = F.coalesce(F.element_at(F.col("_again"), F.concat_ws("\x1f", kind, canon)), F.lit(0))
        return F.struct(kind.alias("kind"), canon.alias("canon"), drawn.alias("attempt"))

    main = F.transform("_found", lambda e: unit(family(e["kind"]), canonical(e["o"], e["kind"])))
    first = F.transform("_found", lambda e: unit(first_kind(e["kind"]), F.when(e["kind"].startswith("name"), given(e["o"])).otherwise("")))
    rows = rows.withColumn("_main", surrogates(key, main)).withColumn("_first", surrogates(key, first))
    new = F.transform(F.arrays_zip("_found", "_main", "_first"), lambda z: in_place(z["_found"]["o"], z["_found"]["kind"], z["_main"], z["_first"]))
    between = F.split(value, ENTITY, -1)
    body = F.array_join(F.transform(new, lambda s, i: F.concat(s, F.element_at(between, i + 2))), "")
    kinds = F.transform(F.filter("_found", lambda e: e["kind"].isNotNull()), lambda e: F.when(e["kind"].startswith("name"), F.lit("name")).otherwise(e["kind"]))
    rows = rows.withColumn(text, F.when(F.size("_found") > 0, F.concat(F.element_at(between, 1), body)).otherwise(value))
    return rows.withColumn("kinds", kinds).withColumn("n_entities", F.size("kinds").cast("long")).drop("_found", "_again", "_main", "_first")
