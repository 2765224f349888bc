"""Citations, cross-references, quotes on pages, linked titles and assembled pages of papers."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.tex import CITE, REFER
from ..functions.text import delatex, let, normalize, plain_runs, text_or_empty
from ..shared import shuffled
from .inorder import folded

# How a citation names a work, and where a bibliography entry's parts end (not after initials).
CITED_NAME = r"(?U)^([A-Z][\w\-' ]*?)(?: et al\.?)?,?\s*\(?((?:19|20)\d\d)?[a-z]?\)?$"
ENTRY_PART = r"(?<![\s.\-][A-Z])\.\s+"
SHORT_TITLE = 24


def _listed(order: str, value: str) -> Column:
    """Aggregate: values in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(value).alias("v")))), lambda s: s["v"])


def resolve_citations(names: DataFrame, references: DataFrame) -> DataFrame:
    """names(paper_id, name) such as "Black et al., 2024" with (short, title) of the first references(paper_id, ref_no, text) whose authors have the surname as a word and whose text has the year; without a year only if a single reference has the surname. short is the title before its colon if up to 24 characters, else empty. Names that resolve to nothing are left out."""
    group = lambda g: F.regexp_extract(F.trim("name"), CITED_NAME, g)
    asked = names.select("paper_id", "name").distinct().withColumns({"word": F.element_at(F.split(group(1), " "), -1), "year": group(2)})
    asked = asked.where((F.col("word") != "") & ((F.col("year") != "") | F.col("name").contains("et al")))
    parts = F.filter(F.transform(F.split(text_or_empty(F.col("text")), ENTRY_PART, -1), lambda p: F.trim(p)), lambda p: p != "")
    entries = references.withColumn("parts", parts).select("paper_id", "ref_no", "text", F.when(F.size("parts") > 1, delatex(F.get("parts", F.lit(1)))).alias("title"), F.explode(F.array_distinct(F.regexp_extract_all(text_or_empty(F.get("parts", F.lit(0))), F.lit(r"(?U)[\w\-']+"), F.lit(0)))).alias("word"))
    hit = asked.join(entries, ["paper_id", "word"])
    usable = F.col("title").isNotNull() & F.col("text").contains(F.col("year"))
    best = hit.groupBy("paper_id", "name", "year").agg(F.count("*").alias("n"), F.min_by("title", F.when(usable, F.col("ref_no"))).alias("title")).where("title is not null and (year <> '' or n = 1)")
    head = F.trim(F.substring_index("title", ":", 1))
    return best.select("paper_id", "name", F.when(F.col("title").contains(":") & F.length(head).between(1, SHORT_TITLE), head).otherwise("").alias("short"), "title")


def _resolved(texts: DataFrame, form: str, known: DataFrame, shown: Callable[[Column, Column], Column]) -> DataFrame:
    """texts(paper_id, text_id, text), ids unique in a paper, with every command of `form` replaced by shown(its name, array of (key and known's columns)); keys that known(paper_id, key, ...) lacks have nulls."""
    commands = texts.select("paper_id", "text_id", F.posexplode(F.regexp_extract_all("text", F.lit(form), F.lit(0))).alias("at", "command"))
    keys = commands.select("paper_id", "text_id", "at", F.regexp_extract("command", r"^\\([A-Za-z]+)", 1).alias("kind"), F.posexplode(F.split(F.regexp_extract("command", r"\{([^}]*)\}$", 1), ",")).alias("key_no", "key")).withColumn("key", F.trim("key"))
    found = keys.join(known, ["paper_id", "key"], "left").withColumn("one", F.struct("key", *[c for c in known.columns if c not in ("paper_id", "key")]))
    labels = found.groupBy("paper_id", "text_id", "at", "kind").agg(_listed("key_no", "one").alias("ones")).withColumn("label", shown(F.col("kind"), F.col("ones")))
    by_text = labels.groupBy("paper_id", "text_id").agg(_listed("at", "label").alias("__labels"))
    pieces = F.zip_with(F.split("text", form, -1), "__labels", lambda gap, label: F.concat(gap, F.coalesce(label, F.lit(""))))
    return texts.join(by_text, ["paper_id", "text_id"], "left").withColumn("text", F.when(F.col("__labels").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))).drop("__labels")


def resolve_cites(texts: DataFrame, bibliography: DataFrame) -> DataFrame:
    """texts(paper_id, text_id, text) with citation commands as labels from bibliography(paper_id, key, short): [A, 2020; B, 2021], or A (2020) and B (2021), or authors, or years; unknown keys show as they are."""
    dated = r"^(.*), (\d{4}[a-z]?)$"

    def shown(kind: Column, ones: Column) -> Column:
        names = F.transform(F.filter(ones, lambda o: o["key"] != ""), lambda o: F.coalesce(o["short"], o["key"]))
        each = lambda f: F.transform(names, f)
        textual = F.array_join(each(lambda n: F.regexp_replace(n, dated, "$1 ($2)")), " and ")
        authors = F.array_join(each(lambda n: F.regexp_replace(n, r", \d{4}[a-z]?$", "")), ", ")
        years = F.array_join(each(lambda n: F.coalesce(F.nullif(F.regexp_extract(n, r"\d{4}[a-z]?$", 0), F.lit("")), n)), ", ")
        bracket = F.when(F.size(names) > 0, F.concat(F.lit("["), F.array_join(names, "; "), F.lit("]"))).otherwise("")
        return F.when(kind.isin("citet", "textcite"), textual).when(kind == "citeauthor", authors).when(kind == "citeyear", years).otherwise(bracket)

    return _resolved(texts, CITE, bibliography.select("paper_id", "key", "short").dropDuplicates(["paper_id", "key"]), shown)


def resolve_refs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """texts(paper_id, text_id, text) with cross-references as numbers from labels(paper_id, key, number, kind): "Figure 2" where the command names the kind, (2) for equations; ? for unknown keys."""

    def shown(kind: Column, ones: Column) -> Column:
        number = lambda o: F.coalesce(o["number"], F.lit("?"))
        full = lambda o: F.trim(F.concat_ws(" ", o["kind"], number(o)))
        text = lambda o: F.when(kind == "eqref", F.concat(F.lit("("), number(o), F.lit(")"))).when(kind == "ref", number(o)).otherwise(full(o))
        return F.array_join(F.transform(ones, text), ", ")

    known = labels.select("paper_id", "key", F.col("number").cast("string").alias("number"), F.col("kind").alias("kind_")).dropDuplicates(["paper_id", "key"])
    return _resolved(texts, REFER, known, lambda kind, ones: shown(kind, F.transform(ones, lambda o: F.struct(o["number"].alias("number"), o["kind_"].alias("kind")))))


def locate_quotes(quotes: DataFrame, pages: DataFrame, key_words: int = 4) -> DataFrame:
    """quotes(paper_id, quote_id, quote, hints array of pages, first_page) with page: the first of the hinted pages in their order, then of all by number, that has one of the quote's snippets; first_page if none has.

    Snippets are the first nine words of each of the three longest plain runs, and the last seven of runs over 14
    words. They meet pages(paper_id, page, text) on equality of their first four words; then whole snippets are compared.
    """
    words = lambda c: F.filter(F.split(F.lower(normalize(c)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    snippet = lambda r: let(words(r), lambda w: F.array(F.slice(w, 1, 9), F.when(F.size(w) > 14, F.slice(w, -7, 7))))
    some = F.filter(F.flatten(F.transform(F.slice(plain_runs(F.col("quote")), 1, 3), snippet)), lambda w: F.size(w) >= key_words)
    wanted = quotes.select("paper_id", "quote_id", F.explode(F.array_distinct(some)).alias("w")).select("paper_id", "quote_id", F.array_join(F.slice("w", 1, key_words), " ").alias("key"), F.array_join("w", " ").alias("snippet"))
    grams = lambda a: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - key_words + 1, F.lit(1))), lambda i: F.array_join(F.slice(a, i, F.lit(key_words)), " ")))
    plain = pages.select("paper_id", "page", words(F.col("text")).alias("w"))
    near = wanted.join(plain.select("paper_id", "page", F.explode(grams(F.col("w"))).alias("key")), ["paper_id", "key"]).select("paper_id", "page", "quote_id", "snippet").distinct()
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    seen = near.join(plain.select("paper_id", "page", F.array_join("w", " ").alias("plain")), ["paper_id", "page"]).where(pad(F.col("plain")).contains(pad(F.col("snippet")))).select("paper_id", "quote_id", "page").distinct()
    place = F.array_position(F.coalesce("hints", F.array().cast("array<bigint>")).cast("array<bigint>"), F.col("page").cast("bigint"))
    ranked = seen.join(quotes.select("paper_id", "quote_id", "hints"), ["paper_id", "quote_id"]).withColumn("rank", F.struct((place == 0).alias("free"), place.alias("place"), F.col("page").alias("by")))
    best = ranked.groupBy("paper_id", "quote_id").agg(F.min_by("page", "rank").alias("__page"))
    return quotes.join(best, ["paper_id", "quote_id"], "left").withColumn("page", F.coalesce("__page", "first_page")).drop("__page")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def link_titles(papers: DataFrame, catalog: DataFrame, threshold: float = 0.92) -> DataFrame:
    """papers(paper_id, title, first_page) with the catalog(catalog_id, title) that names the same work: of those whose title has the paper's first 12 long words, the ones equal, as alike as `threshold`, or found on the first page; the most alike, then the smallest id. Titles with under three long words are left out.

    Only different titles are compared, and only those that share the paper's rarest long word.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " "))
    long = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 2)
    a = papers.withColumn("a", plain(F.col("title")))
    b = catalog.groupBy(plain(F.col("title")).alias("b")).agg(F.min("catalog_id").alias("catalog_id")).where("b <> ''")
    asked = a.select("a").distinct().withColumn("words", F.slice(long(F.col("a")), 1, 12)).where(F.size("words") >= 3)
    words = b.select("b", F.explode(F.array_distinct(long(F.col("b")))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    rare = asked.select("a", F.explode("words").alias("word")).join(shuffled(counts), "word", "left").groupBy("a").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word").alias("w"))).alias("word"))
    pairs = rare.join(shuffled(words), "word").join(shuffled(asked), "a").where(F.size(F.array_except("words", F.split("b", " "))) == 0).select("a", "b")
    scored = pairs.withColumn("ratio", F.when(F.col("a") == F.col("b"), 1.0).otherwise(_ratio("b", "a"))).join(shuffled(b), "b")
    kept = a.join(shuffled(scored), "a").where((F.col("ratio") >= threshold) | F.expr("contains(regexp_replace(lower(coalesce(first_page, '')), '[^a-z0-9]+', ' '), b)"))
    return kept.groupBy("paper_id").agg(F.min_by(F.struct("catalog_id", "ratio"), F.struct((-F.col("ratio")).alias("r"), F.col("catalog_id").alias("c"))).alias("x")).select("paper_id", "x.*")


def limit_quotes(beats: DataFrame, most: int = 2) -> DataFrame:
    """beats(paper_id, section_id, beat_no, quote) with at most `most` quotes in a section, distinct and never on consecutive beats; a quote that is refused counts for nothing. Empty quotes are null."""
    section = Window.partitionBy("paper_id", "section_id")
    out = beats.withColumn("quote", F.nullif("quote", F.lit(""))).withColumns({"__n": F.row_number().over(section.orderBy("beat_no")), "__last": F.lit(-1), "__used": F.array().cast("array<string>"), "__at": F.array().cast("array<int>")})
    for _ in range(most):
        free = F.col("quote").isNotNull() & (F.col("__n") > F.col("__last") + 1) & ~F.array_contains("__used", F.col("quote"))
        out = out.withColumn("__next", F.min(F.when(free, F.struct(F.col("__n").alias("n"), F.col("quote").alias("q")))).over(section))
        taken = F.col("__next").isNotNull()
        out = out.withColumns({"__last": F.when(taken, F.col("__next.n")).otherwise(F.col("__last")), "__used": F.when(taken, F.array_append("__used", F.col("__next.q"))).otherwise(F.col("__used")), "__at": F.when(taken, F.array_append("__at", F.col("__next.n"))).otherwise(F.col("__at"))})
    return out.withColumn("quote", F.when(F.array_contains("__at", F.col("__n")), F.col("quote"))).drop("__n", "__last", "__used", "__at", "__next")


def section_pages(sections: DataFrame, hits: DataFrame, papers: DataFrame) -> DataFrame:
    """sections(paper_id, section_no) with page_start and page_end. A section begins on the first of its hits(paper_id, section_no, page) that isn't before the start of the one before it, or where that one begins; it ends where the next begins, the last with papers(paper_id, n_pages). A fold over the sections of one paper."""
    found = sections.join(hits, ["paper_id", "section_no"], "left").groupBy("paper_id", "section_no").agg(F.collect_set(F.col("page").cast("int")).alias("pages"))

    def step(state: tuple, values: tuple) -> tuple[tuple, int]:
        now = min((p for p in values[0] if p >= state[0]), default=state[0])
        return (now,), max(now, 1)

    begun = folded(found, ["paper_id"], [F.col("section_no")], ["pages"], (0,), step, "page_start", "int")
    after = F.lead("page_start").over(Window.partitionBy("paper_id").orderBy("section_no"))
    each = begun.withColumn("after", after).join(papers.select("paper_id", "n_pages"), "paper_id", "left")
    return each.select("paper_id", "section_no", "page_start", F.greatest("page_start", F.coalesce("after", F.col("n_pages").cast("int"))).alias("page_end"))


def assemble(beats: DataFrame, diagrams: DataFrame, focus: DataFrame, clips: DataFrame) -> DataFrame:
    """(paper_id, views): one nested row for each paper from beats(paper_id, view, section_id, section_no, beat_no, beat_id, narration), with diagrams(paper_id, view, section_id, diagram) on sections, focus(paper_id, beat_id, focus) and clips(paper_id, beat_id, clip) on beats; focus is empty where a section has no diagram."""
    full = beats.join(diagrams, ["paper_id", "view", "section_id"], "left").join(focus, ["paper_id", "beat_id"], "left").join(clips, ["paper_id", "beat_id"], "left")
    none = F.array().cast("array<string>")
    full = full.withColumn("focus", F.when(F.col("diagram").isNotNull(), F.coalesce("focus", none)).otherwise(none))
    sections = full.groupBy("paper_id", "view", "section_no", "section_id").agg(F.first("diagram").alias("diagram"), F.array_sort(F.collect_list(F.struct("beat_no", "beat_id", "narration", "focus", "clip"))).alias("beats"))
    views = sections.groupBy("paper_id", "view").agg(F.array_sort(F.collect_list(F.struct("section_no", "section_id", "diagram", "beats"))).alias("sections"))
    return views.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("view", "sections"))).alias("views"))
