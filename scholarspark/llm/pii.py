"""Personal data replaced by surrogates of the same kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, written

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Catherine Charlotte Claire Elena Elizabeth Emily Emma Hannah Helen Ingrid Isabella Jennifer Julia Karen Laura Linda Maria Mary Nancy Olivia Patricia Rebecca Sarah Sofia Susan Teresa Ursula".split(),
    ("latin", "m"): "Andreas Anthony Antonio Carlos Charles Daniel David Edward Felipe Francisco George Hans Henri James John Joseph Klaus Louis Luis Matthew Michael Miguel Nicolas Paul Peter Pierre Robert Stefan Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Екатерина Елена Ирина Людмила Мария Наталья Ольга Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Αικατερίνη Αναστασία Βασιλική Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
# Syllables from which names are made, and endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bo da del den do fa fen ga gor ha hol ka ker la len lo ma mer mon na nor pa per ra ren ro sa sen sto ta ter to va ver vi wan wel zo".split(),
    "cyrillic": "ба бел бо ва вер го да ден до ка кор ла лен ло ма мир но па пет ра ро са сен та тер то".split(),
    "greek": "βα γε δη θα κα κο λα λο μα μη να νι πα πε ρα ρο σα στα τα το".split(),
}
ENDINGS = {
    ("latin", "f"): "elle ia ina ine issa ette".split(),
    ("latin", "m"): "an as er ian old us".split(),
    ("cyrillic", "f"): "ина ия ла на".split(),
    ("cyrillic", "m"): "ан ий ор слав".split(),
    ("greek", "f"): "ία ένη ούλα ώ".split(),
    ("greek", "m"): "ής άς ιος ων".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
# What says that the next one or two capitalised words are a name, in any case of letters.
CUES = ["my name is", "name:", "contact:", "attn:", "attention:", "signed by", "written by", "author:", "patient:", "customer:", "employee:", "dear", "sincerely,", "regards,"]
# First octets of public networks that stand for themselves.
FIRST_OCTETS = [x for x in range(1, 224) if x not in (10, 100, 127, 169, 172, 192, 198, 203)]

_NAMES = "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True))
_WORD = r"\p{Lu}[\p{L}’'-]*\p{L}"
_LETTER_BEFORE = r"(?<![\p{L}\p{N}])"
_CUE = rf"{_LETTER_BEFORE}(?i:{'|'.join(CUES)})[ \n]"
# Each begins where nothing of its own kind goes before, and takes its first part without going back, so long words cost no more than their length.
# Groups that repeat have a bound, for they are matched by recursion; a host has at most 127 labels.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}(?<=\.[A-Za-z]{2,24})",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "card": r"(?<![\d+])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\d+.,])\d{13,19}(?![\d.,]\d|\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w+(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "given": rf"{_LETTER_BEFORE}(?:{_NAMES})(?= {_WORD})",
    "surname": rf"(?<=[\p{{L}}.:,][ \n])(?:(?<={_LETTER_BEFORE}(?:{_NAMES}) )|(?<={_LETTER_BEFORE}(?:{'|'.join(TITLES)})\.? )|(?<={_CUE})|(?<={_CUE}\p{{Lu}}[\p{{L}}’'-]{{1,30}} )){_WORD}",
}
_GUARDS = {"email": "", "ip": r"(?=\d)", "card": r"(?=\d)", "phone": r"(?=[+(\d])", "ssn": r"(?=\d)", "iban": r"(?=[A-Z]{2}\d)", "given": r"(?=\p{Lu})", "surname": r"(?=\p{Lu})"}
ANY = "|".join(f"{_GUARDS[k]}(?:{p})" for k, p in PATTERNS.items())
#: What a text with any of these has: a cheap look before ANY.
MAY = rf"[@\d]|(?=\p{{Lu}}){_LETTER_BEFORE}(?:{_NAMES}|{'|'.join(TITLES)})(?![\p{{L}}\p{{N}}])|{_CUE}\p{{Lu}}"
#: What is looked up when surrogates are put in: every value, and every capitalised word, which may be a name found elsewhere in the document.
PLACES = rf"{ANY}|{_LETTER_BEFORE}\p{{Lu}}[\p{{L}}’'-]*+(?![\p{{L}}\p{{N}}])"
KINDS = list(PATTERNS)
PLAIN_ROUNDS = 12  # after so many attempts a surrogate stops looking like its kind and is unique by length


def kind_of(value: Column) -> Column:
    """The kind of a value that ANY has found."""
    out = F.when(value.contains("@"), "email").when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip").when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(value.rlike(r"^(?:\d{4}[ -]){3}\d{4}$|^\d{13,19}$"), "card")
    out = out.when(value.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(value.rlike(r"^[+(\d]"), "phone")
    return out.when(value.isin([n for names in GIVEN.values() for n in names]), "given").otherwise("surname")


def norm_of(kind: Column, value: Column) -> Column:
    """What all spellings of one entity share: case of addresses and names, and separators of numbers, don't count."""
    return F.when(kind.isin("email", "surname"), F.lower(value)).when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(value, "[^A-Za-z0-9]", "")).otherwise(value)


def _byte(hashed: Column, i: Column) -> Column:
    return F.conv(F.substring(hashed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _picked(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values)) + 1)


def _chars(value: Column, hashed: Column) -> Column:
    """value with every ASCII letter and digit changed for another of its kind, by its place."""

    def change(c: Column, i: Column) -> Column:
        b = _byte(hashed, i % 64)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.char(b % 26 + 97)).when(c.rlike("[A-Z]"), F.char(b % 26 + 65)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), change), "")


def _luhn_digit(digits: Column) -> Column:
    """The digit that makes `digits` and it a valid card number."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when((n - i) % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return ((10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    """Remainder by 97 of digits and capital letters, letters standing for 10 to 35."""

    def add(a: Column, c: Column) -> Column:
        x = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def surrogate(kind: Column, norm: Column, key: str, attempt: int) -> Column:
    """The surrogate, in normal form, that key and attempt give to an entity."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), kind, F.lit(str(attempt)), norm), 512)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    at_domain = F.concat(F.lit("@d"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), 1, 10), F.lit(".example"))
    email = F.concat(_chars(local, hashed), F.lit("" if attempt < 4 else f".{attempt}"), at_domain)
    octets = F.split(norm, r"\.")
    octet = lambda i: (_byte(hashed, F.lit(i)) % 254 + 1).cast("string")
    private = norm.rlike(r"^(?:10|127)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.")
    ip = F.concat_ws(".", F.when(private, octets[0]).otherwise(_picked(FIRST_OCTETS, _byte(hashed, F.lit(0))).cast("string")), F.when(private & ~norm.rlike(r"^(?:10|127)\."), octets[1]).otherwise(octet(1)), octet(2), octet(3))
    body = F.concat(F.substring(norm, 1, 1), F.substring(_chars(norm, hashed), F.lit(2), F.length(norm) - 2))
    valid = _luhn_digit(F.substring(norm, F.lit(1), F.length(norm) - 1)) == F.substring(norm, F.length(norm), F.lit(1))
    right = _luhn_digit(body)
    card = F.concat(body, F.when(valid, right).otherwise(F.pmod(right.cast("int") + 1 + _byte(hashed, F.lit(63)) % 9, F.lit(10)).cast("string")))
    country = F.greatest(F.length(norm) - 10, F.lit(0))
    rest = F.substring(_chars(norm, hashed), country + 2, F.length(norm))
    phone = F.concat(F.substring(norm, F.lit(1), country), (_byte(hashed, F.lit(62)) % 8 + 2).cast("string"), rest)
    ssn = F.concat(F.lit("9"), F.substring(_chars(norm, hashed), 2, 9))
    bban = F.substring(_chars(norm, hashed), F.lit(5), F.length(norm))
    iban = F.concat(F.substring(norm, 1, 2), F.lpad((98 - _mod97(F.concat(bban, F.substring(norm, 1, 2), F.lit("00")))).cast("string"), 2, "0"), bban)
    made = lambda script, n=3: F.concat(*[_picked(SYLLABLES[script], _byte(hashed, F.lit(i))) for i in range(n + attempt)])
    given = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        given = F.when(norm.isin(names), F.initcap(F.concat(made(script, 1), _picked(ENDINGS[script, gender], _byte(hashed, F.lit(60)))))).otherwise(given)
    surname = F.when(norm.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))
    plain = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "given", given).otherwise(surname)
    return plain if attempt < PLAIN_ROUNDS else F.concat(F.lit("x"), F.substring(hashed, 1, 32 + attempt))


def assign(entities: DataFrame, key: str, attempts=surrogate) -> DataFrame:
    """(kind, norm, sub) for the distinct entities(kind, norm): no two of a kind share a sub, and no sub is an entity of the corpus itself.

    In rounds: who still lacks a surrogate gets the next attempt's; it holds unless it is taken, is somebody's own
    value, or another asks for it in this round and comes first by norm. Only counts reach the driver.
    """
    entities = cut(entities.distinct())
    left, done, attempt = entities, entities.select("kind", "norm", F.lit("").alias("sub")).limit(0), 0
    while True:
        asked = left.withColumn("sub", attempts(F.col("kind"), F.col("norm"), key, attempt))
        free = asked.join(entities.select("kind", F.col("norm").alias("sub")), ["kind", "sub"], "left_anti").join(done.select("kind", "sub"), ["kind", "sub"], "left_anti")
        won = free.groupBy("kind", "sub").agg(F.min("norm").alias("norm")).select("kind", "norm", "sub")
        done = cut(done.unionAll(won))
        left = cut(left.join(done.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if left.isEmpty():
            return done
        attempt += 1


def rendered(kind: Column, value: Column, sub: Column) -> Column:
    """The surrogate written as the value is: its separators between the digits, its case of names."""
    put = lambda s, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(s["out"], F.substring(sub, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    spaced = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: s["out"])
    numbers = F.when(F.length(F.regexp_replace(value, "[^A-Za-z0-9]", "")) == F.length(sub), spaced).otherwise(sub)
    cased = F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(sub)).otherwise(F.initcap(sub))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), numbers).when(kind == "surname", cased).otherwise(sub)


def replace_pii(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """docs(text, ...) with surrogates for personal data in text, and as last column n_replaced, map of kind to how many.

    Kinds: email, ip, card (13 to 19 digits), phone, ssn, iban, and names: given names of a list before a capitalised word, the
    word after them or after a title, and one or two capitalised words after what announces a name (CUES); further
    places of such a name in its document are found too. The same entity gets the same surrogate wherever it
    stands, and different ones get different ones, none of which occurs in the corpus as a value of that kind.
    A surrogate keeps the kind's form: separators, length, country and network class, valid check digits, case,
    script and gender. Surrogates depend on `key` and, where two collide, on the other values of the corpus.
    null texts stay null; repeated rows are alike; other columns stay as they are, whatever their names.

    One pass finds the values and writes the rows; distinct values are gathered with partial sums and get their
    surrogates in rounds; only documents with values are joined with them.
    """
    n_replaced, uid, values, subs = (fresh(docs, x) for x in ("n_replaced", "__uid", "__values", "__subs"))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    found = docs.withColumn(values, F.when(text.rlike(MAY), F.array_distinct(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))).otherwise(none))
    found = written(found.withColumn(uid, F.monotonically_increasing_id()))
    hits = found.where(F.size(values) > 0)

    each = hits.select(F.col(uid).alias("uid"), F.explode(values).alias("value"))
    each = each.withColumn("kind", kind_of(F.col("value"))).withColumn("norm", norm_of(F.col("kind"), F.col("value")))
    given = assign(each.select("kind", "norm"), key)
    mapped = each.join(given, ["kind", "norm"]).withColumn("put", rendered(F.col("kind"), F.col("value"), F.col("sub")))
    per_doc = mapped.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("put", "kind")))).alias(subs)).withColumnRenamed("uid", uid)

    # As many partitions as asked for, not merged by their bytes: the work is in the patterns.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = hits.repartition(n, uid).join(per_doc, uid)
    parts = F.split(F.col("text"), PLACES, -1)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(PLACES), F.lit(0))
    new = F.array_join(F.flatten(F.zip_with(parts, pieces, lambda a, b: F.array(a, F.coalesce(F.element_at(F.col(subs), b)["put"], b, F.lit(""))))), "")
    kinds = F.transform(pieces, lambda b: F.element_at(F.col(subs), b)["kind"])
    times = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    counts = F.map_filter(F.create_map(*[x for k in KINDS for x in (F.lit(k), times(k))]), lambda _, n: n > 0)
    out = lambda df, new, n: df.select(*[new.alias("text") if c == "text" else F.col(c) for c in docs.columns], n.cast("map<string,int>").alias(n_replaced))
    return out(found.where(F.size(values) == 0), F.col("text"), F.create_map()).unionAll(out(held, new, counts))
