"""Secret scanning: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

# Words that announce a secret, parts of paths of code that only shows or tests something.
ANNOUNCE = "password passwd pwd secret token api_key apikey access_key auth_token credential".split()
SHOWING = r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|docs?|fixtures?|mocks?|demo)(?:[/_.-]|$)"

_CLASS = "A-Za-z0-9+/_~-"
ASSIGNED = rf"(?i:(?:{'|'.join(ANNOUNCE)})['\"]?\s?[:=]\s?['\"]?)"
#: A value after a name that ends in an announcing word and = or :, or a lone run of 16 characters or more that isn't such a name.
_NAME = rf"(?<=(?i:{'|'.join(ANNOUNCE)}))(?=['\"]?\s?[:=]\s?['\"]?[^\s'\"]{{8}})"
CANDIDATE = rf"(?:{ASSIGNED})[^\s'\"]{{8,}}|(?<![\p{{L}}\p{{N}}+/_~-])[{_CLASS}]{{16,}}+(?!{_NAME})={{0,2}}(?![\p{{L}}\p{{N}}])"
NEAR = 48  # characters kept of each side
#: A word is in the dictionary if it is more than this share of all words; so it has at most 1 / share words.
WORD_SHARE = 1e-5
#: The bound of the training sample: so many labelled findings of each class.
TRAIN_FINDINGS = 10_000
#: Candidates in whose surroundings findings are planted, and words from which planted false positives are made.
CONTEXTS, COMMON = 400, 300
# What stands before digests that are no secrets.
DIGESTS = "commit revision checksum sha1 sha256 md5 etag build".split()


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(id, doc_id, path, ordinal, value, before, after): every candidate of text with up to NEAR characters of each side."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = docs.select("doc_id", F.col(path).alias("path"), text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    parts, found = F.split("text", CANDIDATE, -1), F.regexp_extract_all(F.col("text"), F.lit(CANDIDATE), F.lit(0))
    each = hit.select("doc_id", "path", parts.alias("parts"), found.alias("found")).select("doc_id", "path", "parts", F.posexplode("found").alias("ordinal", "whole"))
    lead = F.regexp_extract("whole", f"^{ASSIGNED}", 0)
    side = F.concat(F.get("parts", F.col("ordinal")), lead)
    return written(
        each.select(
            F.monotonically_increasing_id().alias("id"), "doc_id", "path", "ordinal", F.substring("whole", F.length(lead) + 1, F.length("whole")).alias("value"),
            F.substring(side, F.greatest(F.length(side) - NEAR + 1, F.lit(1)), F.lit(NEAR)).alias("before"), F.substring(F.get("parts", F.col("ordinal") + 1), 1, NEAR).alias("after"),
        )
    )


def dictionary(docs: DataFrame, share: float = WORD_SHARE) -> DataFrame:
    """(word, n): the frequent words of all texts, in lower case, of 2 to 30 letters; at most 1 / share of them."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(2, 30))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return cut(counts.where(F.col("n") > max(1, total * share)))


def _grams(value: Column, k: int) -> Column:
    """The runs of k characters, in one pass: the characters beside themselves, moved by one each time."""
    chars = F.split(value, "")
    found = chars
    for i in range(1, k):
        found = F.zip_with(found, F.slice(chars, F.lit(i + 1), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.filter(found, lambda g: g.isNotNull())


def features(found: DataFrame, words: DataFrame) -> tuple[DataFrame, list[str]]:
    """found with a column for each feature, and their names."""
    pairs = words.where(F.length("word") > 1).select(F.explode(_grams(F.col("word"), 2)).alias("gram"), "n")
    pairs = pairs.groupBy("gram").agg(F.sum("n").alias("n"))
    heads = pairs.groupBy(F.substring("gram", 1, 1).alias("head")).agg(F.sum("n").alias("all"))
    steps = pairs.join(F.broadcast(heads), F.substring("gram", 1, 1) == F.col("head")).select("gram", F.log2((F.col("n") + 0.5) / (F.col("all") + 40.0)).alias("bits"))
    threes = words.where(F.length("word") > 2).select(F.explode(_grams(F.col("word"), 3)).alias("gram")).distinct().withColumn("known", F.lit(1.0))
    low = F.lower("value")
    of = found.select("id", F.explode(_grams(low, 2)).alias("gram")).join(F.broadcast(steps), "gram", "left").groupBy("id").agg(F.avg(F.coalesce("bits", F.lit(-12.0))).alias("transitions"))
    covered = found.where(F.length("value") > 2).select("id", F.explode(_grams(low, 3)).alias("gram")).join(F.broadcast(threes), "gram", "left").groupBy("id").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("dictionary"))
    left, right = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    n = F.length("value")
    share = lambda c: (F.length(F.regexp_replace("value", f"[^{c}]", "")) / n).cast("double")
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "."))
    natural = lambda side: F.size(F.filter(F.split(side, r"\s+"), lambda w: w.rlike(r"^\p{L}+[.,]?$"))).cast("double")
    made = {
        "length": n.cast("double"), "digits": share("0-9"), "uppers": share("A-Z"), "lowers": share("a-z"), "marks": share("+/_~=-"),
        "hex": F.col("value").rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"), "changes": (runs / n).cast("double"), "distinct": (F.size(F.array_distinct(F.split("value", ""))) / n).cast("double"),
        "announced": left.rlike(rf"(?i)(?:{'|'.join(ANNOUNCE)})\W{{0,4}}$").cast("double"), "assigned": left.rlike(r"[:=]\s?['\"]?$").cast("double"), "quoted": left.rlike("['\"]$").cast("double"),
        "words_before": natural(left), "words_after": natural(right), "path_parts": F.size(F.split(F.coalesce("path", F.lit("")), "/")).cast("double"), "showing": F.coalesce("path", F.lit("")).rlike(SHOWING).cast("double"),
    }
    out = found.join(of, "id", "left").join(covered, "id", "left").withColumns(made).fillna(0.0, ["transitions", "dictionary"])
    return out, ["transitions", "dictionary", *made]


def planted_findings(found: DataFrame, words: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """Labelled findings (id, path, value, before, after, what, label) in the surroundings of real candidates: each of a
    bounded sample of them has its value replaced by made-up ones of every kind `what`. What is put in decides the label,
    and not how it looks: keys, tokens and passwords are secrets; words, numbers, placeholders, digests of public things,
    paths and long words are none, also where an announcing word is set to them. Values are hashed from the candidates, so reruns agree.
    """
    some = cut(found.orderBy(F.xxhash64("value", "before"), "id").limit(contexts))
    times = contexts // max(some.count(), 1)  # so that few candidates give as many findings
    some = some.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, times)))))
    common = [r.word for r in words.where(F.length("word").between(3, 12)).orderBy(F.desc("n"), "word").limit(COMMON).collect()] or ["word"]
    each = some.withColumn("what", F.explode(F.array(*[F.lit(k) for k in ("hex key", "mixed key", "issued key", "issued token", "password", "words", "name", "number", "filler", "placeholder", "digest", "path", "long word")])))
    salted = lambda salt: F.sha2(F.concat_ws("|", "value", "before", "what", "copy", F.lit(salt)), 256)
    draw = lambda salt, n: F.pmod(F.conv(F.substring(salted(salt), 1, 12), 16, 10).cast("long"), F.lit(n)).cast("int")
    of = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), draw(salt, len(values)) + 1)
    mixed = F.translate(F.concat(*[F.base64(F.unhex(salted(f"mixed {i}"))) for i in range(2)]), "+/=", "aZ3")
    digits = F.translate(F.concat(salted("d0"), salted("d1")), "abcdef", "135790")
    each = cut(each.withColumns({**{f"w{i}": of(common, f"w{i}") for i in range(5)}, "mixed": mixed, "digits": digits, "hexes": F.concat(salted("a"), salted("b"))}))
    mixed, digits, hexes = F.col("mixed"), F.col("digits"), F.col("hexes")
    word = F.col
    what = F.col("what")
    value = (
        F.when(what == "hex key", F.substring(hexes, F.lit(1), 8 + draw("n", 57)))
        .when(what == "mixed key", F.substring(mixed, F.lit(1), 8 + draw("n", 37)))
        .when(what == "issued key", F.concat(F.lit("AKIA"), F.substring(F.upper(mixed), 1, 16)))
        .when(what == "issued token", F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)))
        .when(what == "password", F.concat(F.initcap(word("w0")), F.substring(digits, F.lit(1), 2 + draw("n", 5)), of(["!", "$", "#", "", "x", "Qz"], "m"), F.substring(mixed, F.lit(1), 1 + draw("k", 6))))
        .when(what == "words", F.concat(word("w0"), of(["-", "_", "/"], "s"), word("w1"), of(["-", "_", "/"], "s"), word("w2"), of(["-", "_", "/"], "s"), word("w3")))
        .when(what == "name", F.concat(word("w0"), F.initcap(word("w1")), F.initcap(word("w2")), F.initcap(word("w3"))))
        .when(what == "number", F.substring(digits, F.lit(1), 12 + draw("n", 12)))
        .when(what == "filler", F.repeat(of(["x", "*", "0", "-", "ab", "."], "f"), 10 + draw("n", 14)))
        .when(what == "placeholder", F.concat(of(["your_", "<", "${", "my-", "example_"], "p"), word("w0"), of(["_here", ">", "}", "-value", "_example"], "q")))
        .when(what == "digest", F.substring(hexes, F.lit(1), of([32, 40, 64], "n")))
        .when(what == "path", F.concat_ws("/", word("w0"), word("w1"), word("w2"), F.concat(word("w3"), of([".html", ".py", "/index", "?page=2"], "e"))))
        .otherwise(F.concat(*[word(f"w{i}") for i in range(5)]))
    )
    style = draw("style", 4)
    natural = what.isin("words", "path", "long word")
    value = F.when(natural & (style == 0), F.upper(value)).when(natural & (style == 1), F.initcap(value)).otherwise(value)
    plain = F.regexp_replace("before", ASSIGNED + "$", "")
    lead = F.concat(of(ANNOUNCE, "lead"), of(["=", ": ", " = '", '="', ":"], "sign"))
    announced = what.isin("hex key", "mixed key", "password") | (what.isin("issued key", "issued token", "words", "name", "number", "filler", "placeholder") & (draw("lone", 2) == 0))
    before = F.when(announced, F.concat(plain, F.lit(" "), lead)).when(what == "digest", F.concat(plain, F.lit(" "), of(DIGESTS, "lead"), of([" ", ": ", " ="], "sign"))).otherwise(plain)
    label = what.isin("hex key", "mixed key", "issued key", "issued token", "password").cast("int")
    made = each.select("path", value.alias("value"), F.substring(before, -NEAR, NEAR).alias("before"), "after", "what", label.alias("label"))
    return cut(made).withColumn("id", F.xxhash64("value", "before", "what"))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", trees: int = 20, depth: int = 6) -> DataFrame:
    """One row for each candidate in docs(doc_id, text, `path`): doc_id, ordinal (from 0 within its document), value, score, kept.

    Labelled findings train the forest: findings(value, label 0 or 1), or where none are given those that
    planted_findings puts into the surroundings of the candidates; of each class at most TRAIN_FINDINGS, in an order
    hashed from their values. score is the forest's probability that the candidate is a secret and kept says whether it
    is over a half. If the findings given are not of both classes, nothing can be learned: score is a half, and none is
    kept. Words and transitions are counted over all texts. null and empty texts have no candidates; a null path is an
    empty one; repeated rows and rows without doc_id are each scanned. Other columns are ignored.
    """
    found = candidates(docs.select("doc_id", "text", *([path] if path not in ("doc_id", "text") else [])), path)
    words = dictionary(docs.select("text"))
    table = cut(with_features(found, words).select("id", "doc_id", "ordinal", "value", "before", "features"))
    if findings is None:
        labelled = with_features(planted_findings(found, words), words)
    else:
        labelled = table.join(findings.groupBy("value").agg(F.max("label").cast("int").alias("label")), "value")
    model = trained(labelled, trees, depth)
    if model is None:
        return table.select("doc_id", "ordinal", "value", F.lit(0.5).alias("score"), F.lit(False).alias("kept"))
    score = F.round(vector_to_array("probability")[1], 6)
    return model.transform(table).select("doc_id", "ordinal", "value", score.alias("score"), (score > 0.5).alias("kept"))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the vector `features`."""
    table, names = features(found, words)
    return VectorAssembler(inputCols=names, outputCol="features").transform(table)


def trained(labelled: DataFrame, trees: int = 20, depth: int = 6):
    """A forest over labelled(value, before, features, label), or None if it has not both classes."""
    at = F.xxhash64("value", "before")
    labelled = cut(labelled.select("features", "label", at.alias("at"), F.crc32(F.concat("value", "before").cast("binary")).alias("then")))
    sample = cut(labelled.where("label = 1").orderBy("at", "then").limit(TRAIN_FINDINGS).unionAll(labelled.where("label = 0").orderBy("at", "then").limit(TRAIN_FINDINGS)).coalesce(1).sortWithinPartitions("at", "then"))
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featuresCol="features", labelCol="label", subsamplingRate=0.8).fit(sample)


def held_out_scores(docs: DataFrame, path: str = "source", trees: int = 20, depth: int = 6) -> DataFrame:
    """(what, label, n, kept): how many planted findings of each kind a forest keeps that has learned from the four fifths of them
    whose surroundings hash otherwise; planted in the surroundings that docs has."""
    found = candidates(docs, path)
    words = dictionary(docs.select("text"))
    table = cut(with_features(planted_findings(found, words), words).withColumn("held", F.pmod(F.xxhash64("after", "path"), F.lit(5)) == 0))
    model = trained(table.where("not held"), trees, depth)
    kept = (vector_to_array("probability")[1] > 0.5).cast("int")
    return model.transform(table.where("held")).groupBy("what", "label").agg(F.count("*").alias("n"), F.sum(kept).alias("kept"))
