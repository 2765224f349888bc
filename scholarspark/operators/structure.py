"""The structure of a document: running heads, headings, sections, pages, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import canon, let, normalize
from ..shared import settle_in_order
from .inorder import folded, ranked

#: Blocks of earlier summaries have up to 2^LEVELS of them.
LEVELS = 10
# Headings that are known without a number.
KNOWN_HEADINGS = [
    "abstract", "introduction", "related work", "related works", "background", "preliminaries",
    "method", "methods", "methodology", "approach", "our approach", "model", "model architecture",
    "proposed method", "experiments", "experiment", "experimental setup", "experimental results",
    "evaluation", "results", "discussion", "analysis", "conclusion", "conclusions",
    "conclusion and future work", "limitations", "future work", "references", "bibliography",
    "acknowledgments", "acknowledgements", "acknowledgment", "acknowledgement", "appendix",
    "broader impact", "broader impacts", "ethics statement", "supplementary material",
]
# Headings that may stand without a number in a numbered document, that are dropped, that begin a bibliography.
UNNUMBERED = ["abstract", "references", "bibliography", "acknowledgments", "acknowledgements", "acknowledgment", "acknowledgement", "appendix", "supplementary material", "broader impact", "broader impacts", "ethics statement", "limitations"]
DROPPED = ["acknowledgments", "acknowledgements", "acknowledgment", "acknowledgement"]
REFERENCES = ["references", "bibliography", "reference"]
# Forms of a numbered heading, of a number alone, of a caption.
NUMBERED = r"^(\d{1,2}(?:\.\d{1,2}){0,3}|[IVX]{1,5}|[A-H](?:\.\d{1,2}){0,2})(?:\.|\s)\s*([A-Za-z].{0,110})$"
NUMBER_ONLY = r"^(\d{1,2}(?:\.\d{1,2}){0,3}|[IVX]{1,5}|[A-H])\.?\z"
CAPTION = r"(?i)^(fig(?:ure)?|table|algorithm|listing)\.?\s*(\d+|[ivx]+)\b"


def strip_repeated_lines(lines: DataFrame, share: float = 0.3) -> DataFrame:
    """lines(paper_id, page, line_no, text, in_margin) without running heads: margin lines whose text, digits masked, a paper has on `share` of its pages (twice at least), or that are page numbers only."""
    key = F.when(F.col("in_margin"), F.regexp_replace(F.lower("text"), r"\d+", "#"))
    keyed = lines.withColumn("__key", key)
    pages = lines.groupBy("paper_id").agg(F.count_distinct("page").alias("__pages"))
    often = keyed.where("__key is not null").groupBy("paper_id", "__key").agg(F.count("*").alias("__times")).join(pages, "paper_id").where(F.col("__times") >= F.greatest(F.lit(2), F.floor(F.col("__pages") * share)))
    bare = F.col("__key").isNull() | ~F.col("__key").rlike(r"^[#\s\-–/of]*$")
    return keyed.where(bare).join(often.select("paper_id", "__key"), ["paper_id", "__key"], "left_anti").drop("__key")


def body_size(lines: DataFrame) -> DataFrame:
    """(paper_id, body): the font size, to halves, that most characters of a paper have; of equals the smaller."""
    sizes = lines.groupBy("paper_id", (F.rint(F.col("size") * 2) / 2).alias("body")).agg(F.sum(F.length("text")).alias("chars"))
    return sizes.groupBy("paper_id").agg(F.max_by("body", F.struct("chars", (-F.col("body")).alias("small"))).alias("body"))


def clean_heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s:.]+$", ""))


def heading_candidates(lines: DataFrame) -> DataFrame:
    """lines(..., text, size, bold, body, alone) that are headings, with heading and level: of 2 to 120 characters and 14 words, no caption, no comma at the end; set larger or bold and numbered, known or large, or a known name alone or in capitals."""
    t = F.trim("text")
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    fits = F.length(t).between(2, 120) & (words(t) <= 14) & ~t.rlike(CAPTION) & t.rlike("[A-Za-z]{2}") & ~t.rlike("[,;]$")
    larger = F.col("size") >= F.col("body") + 0.9
    styled = larger | (F.col("bold") & (F.col("size") >= F.col("body") - 0.6))
    number, title = F.regexp_extract(t, NUMBERED, 1), clean_heading(F.regexp_extract(t, NUMBERED, 2))
    numbered = number != ""
    right = (words(title) <= 12) & ~(number.rlike("^[A-H]$") & ~(F.col("bold") | larger)) & ~title.rlike(r"^\p{Ll}")
    known = F.lower(clean_heading(t)).isin(KNOWN_HEADINGS)
    large = (F.col("size") >= F.col("body") + 1.8) & (words(t) <= 10) & t.rlike(r"^\p{Lu}") & ~t.endswith(".")
    capitals = (F.upper(t) == t) & t.rlike(r"\p{L}")
    heading = F.when(styled & numbered & right, F.concat(number, F.lit(" "), title)).when(styled & ~numbered & (known | large), clean_heading(t)).when(~styled & known & (capitals | F.col("alone")), clean_heading(t))
    level = F.when(styled & numbered & number.rlike(r"^\d"), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(1)
    return lines.withColumn("heading", F.when(fits, heading)).withColumn("level", level).where("heading is not null")


def figure_captions(lines: DataFrame) -> DataFrame:
    """(paper_id, number, caption, page): the block of each first "Fig. N:" or "Figure N." line of a paper, cut to 600 characters."""
    cap = lines.where(F.col("text").rlike(CAPTION) & F.lower("text").startswith("fig") & (F.substring("text", 1, 14).contains(":") | F.substring("text", 1, 12).contains(".")))
    first = cap.groupBy("paper_id", F.lower(F.regexp_extract("text", CAPTION, 2)).alias("number")).agg(F.min_by(F.struct("page", "block"), "line_no").alias("at"))
    blocks = lines.groupBy("paper_id", "page", "block").agg(_joined("line_no", "text", " ").alias("caption"))
    return first.select("paper_id", "number", "at.page", "at.block").join(blocks, ["paper_id", "page", "block"]).select("paper_id", "number", F.substring("caption", 1, 600).alias("caption"), (F.col("page") + 1).alias("page"))


def _joined(order: str, text: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(text).alias("t")))), lambda s: s["t"]), by)


def page_spans(lines: DataFrame) -> DataFrame:
    """(paper_id, section_no, page_start, page_end, pages) of each section."""
    return lines.groupBy("paper_id", "section_no").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_sort(F.collect_set("page")).alias("pages"))


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): lines of a (page, block) joined by blanks, blocks by blank lines, words mended across "x- y"."""
    blocks = lines.groupBy(*keys, "page", "block").agg(F.min("line_no").alias("line_no"), F.trim(_joined("line_no", "text", " ")).alias("text")).where("text <> ''")
    text = F.regexp_replace(_joined("line_no", "text", "\n\n"), r"([\p{L}\p{N}_])- (\p{Ll})", "$1$2")
    return blocks.groupBy(*keys).agg(text.alias("text"))


def sectionize(lines: DataFrame) -> DataFrame:
    """lines(paper_id, line_no, text, heading null or text) with section_no (0 before the first heading) and section, the heading above; heading lines themselves, and acknowledgements, are left out."""
    so_far = Window.partitionBy("paper_id").orderBy("line_no")
    out = lines.withColumn("section_no", F.count("heading").over(so_far)).withColumn("section", F.last("heading", ignorenulls=True).over(so_far))
    key = F.lower(F.trim(F.regexp_replace(F.coalesce("section", F.lit("")), r"^[\dIVXA-H.]+\s+", "")))
    return out.where(F.col("heading").isNull() & ~key.isin(DROPPED)).withColumn("is_reference", key.isin(REFERENCES))


def merge_split_headings(lines: DataFrame) -> DataFrame:
    """lines where a bare number and the line right below it, on one page and within three line heights, are one, in the larger size; the second goes, and as it is used up takes no third, though it be a bare number itself."""
    by = Window.partitionBy("paper_id").orderBy("line_no")
    following = F.lead(F.struct("page", "y0", "text", "size")).over(by)
    able = F.coalesce(F.col("text").rlike(NUMBER_ONLY) & (following["page"] == F.col("page")) & (F.abs(following["y0"] - F.col("y0")) < 3 * F.greatest("size", F.lit(1.0))), F.lit(False))
    # Of lines in a row that could take the next, the first, third and so on do.
    numbered = lines.withColumns({"__a": able, "__n": F.row_number().over(by), "__t": following["text"], "__s": following["size"]})
    joins = F.col("__a") & ((F.col("__n") - F.coalesce(F.last(F.when(~F.col("__a"), F.col("__n")), ignorenulls=True).over(by), F.lit(0))) % 2 == 1)
    marked = numbered.withColumn("__j", joins).withColumn("__e", F.coalesce(F.lag("__j").over(by), F.lit(False))).where(~F.col("__e"))
    taken = lambda c, both: F.when(F.col("__j"), both).otherwise(F.col(c))
    return marked.withColumns({"text": taken("text", F.concat("text", F.lit(" "), "__t")), "size": taken("size", F.greatest("size", "__s"))}).drop("__a", "__n", "__t", "__s", "__j", "__e")


def sane_numbering(headings: DataFrame) -> DataFrame:
    """headings(paper_id, line_no, heading, level) whose numbers follow on: n is the last top number or one more (at first 1 or 2), a subsection's is the last; letters count after the references only. Rejected ones change nothing."""
    h = F.col("heading")
    number, name = F.regexp_extract(h, r"^(\d{1,2})((?:\.\d{1,2})*+)\s", 1), F.lower(F.trim(F.regexp_replace(h, r"^[\dIVXA-H.]+\s+", "")))
    said = headings.withColumns({
        "__n": number.try_cast("int"), "__sub": F.regexp_extract(h, r"^(\d{1,2})((?:\.\d{1,2})*+)\s", 2) != "",
        "__letter": (number == "") & h.rlike(r"^[A-H](\.\d{1,2})*+\s") & ~name.isin(KNOWN_HEADINGS), "__refs": name.isin(REFERENCES) | F.lower(h).isin(REFERENCES),
    })

    def step(state: tuple, values: tuple) -> tuple[tuple, bool]:
        (top, after), (n, sub, letter, refs) = state, values
        if n is None:
            keep = after or not letter
        else:
            keep = n > 0 and (n == top or not sub and (n == top + 1 or top == 0 and n == 2))
            top = n if keep else top
        return (top, after or keep and bool(refs)), keep

    return folded(said, ["paper_id"], [F.col("line_no")], ["__n", "__sub", "__letter", "__refs"], (0, False), step, "__keep", "boolean").where("__keep").select(headings.columns)


def neighbors(sections: DataFrame) -> DataFrame:
    """sections(paper_id, section_no, title) with previous and next title, position and count."""
    by = Window.partitionBy("paper_id")
    order = by.orderBy("section_no")
    return sections.select("*", F.lag("title").over(order).alias("previous"), F.lead("title").over(order).alias("next"), F.row_number().over(order).alias("position"), F.count("*").over(by).alias("n_sections"))


def context_blocks(sections: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(blocks(paper_id, level, block, text), refs(paper_id, section_no, refs)) of sections(paper_id, section_no, summary): what comes before each section, in blocks that sections share.

    A block of level k is the summaries of 2^k sections that follow each other, a line each; so each summary is written once a level, and not
    once for every later section. refs lists the blocks that make up all earlier sections, in order: those of the highest level, and at most one of each below.
    """
    # A section without a summary has a place, and adds nothing.
    placed = settle_in_order(ranked(sections.select("paper_id", "section_no", "summary"), ["paper_id"], [F.col("section_no")], "n").withColumn("n", F.col("n") - 1))
    each = placed.where("summary is not null").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("block", F.expr("shiftright(n, level)"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "summary"))), lambda s: s["summary"]), "\n")
    blocks = each.groupBy("paper_id", "level", "block").agg(text.alias("text"))
    n = F.col("n")
    whole = F.transform(F.when(n >= 1 << levels, F.sequence(F.lit(0).cast("long"), F.shiftright(n, levels).cast("long") - 1)).otherwise(F.array().cast("array<bigint>")), lambda b: F.struct(F.lit(levels).alias("level"), b.alias("block")))
    rest = F.transform(F.lit([*range(levels - 1, -1, -1)]).cast("array<int>"), lambda k: F.when(F.floor(n / F.pow(F.lit(2), k)) % 2 == 1, F.struct(k.alias("level"), (F.floor(n / F.pow(F.lit(2), k)) - 1).cast("long").alias("block"))))
    refs = placed.select("paper_id", "section_no", F.concat(whole, F.array_compact(rest)).alias("refs"))
    return blocks, refs


def expand_context(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, section_no, earlier) for some of the refs of context_blocks: their blocks' texts, a line each; empty for a first section."""
    each = refs.select("paper_id", "section_no", F.posexplode("refs").alias("at", "ref")).select("paper_id", "section_no", "at", "ref.*").join(blocks, ["paper_id", "level", "block"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), "\n")
    told = each.groupBy("paper_id", "section_no").agg(text.alias("earlier"))
    return refs.select("paper_id", "section_no").join(told, ["paper_id", "section_no"], "left").withColumn("earlier", F.coalesce("earlier", F.lit("")))


def earlier_context(sections: DataFrame) -> DataFrame:
    """sections(paper_id, section_no, summary) with the summaries of all earlier ones, a line each, from the blocks that sections share."""
    blocks, refs = context_blocks(sections)
    return sections.join(expand_context(refs, blocks), ["paper_id", "section_no"])


def choose_structure(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, start, heading): with three numbered headings and more, unnumbered ones stay only if they are of the list; papers with under three headings left are cut every two pages.

    headings(paper_id, line_no, heading), pages(paper_id, n_pages)."""
    by = Window.partitionBy("paper_id")
    many = F.count_if(F.col("heading").rlike(r"^(\d|[IVX]+\s)")).over(by) >= 3
    fits = F.col("heading").rlike(r"^(\d{1,2}(?:\.\d{1,2})*+|[IVX]{1,5}|[A-H](?:\.\d{1,2})*+)\s") | F.lower(clean_heading(F.col("heading"))).isin(UNNUMBERED)
    kept = headings.withColumn("__m", many).where(~F.col("__m") | fits).withColumn("__n", F.count("*").over(by)).where("__n >= 3").select("paper_id", F.col("line_no").cast("long").alias("start"), "heading")
    rest = pages.join(kept.select("paper_id").distinct(), "paper_id", "left_anti").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pages").cast("long") - 1, F.lit(2).cast("long"))))
    return kept.unionAll(rest.select("paper_id", "start", F.concat(F.lit("Pages "), F.col("start") + 1, F.lit("-"), F.least(F.col("n_pages"), F.col("start") + 2)).alias("heading")))


def section_of_page(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """pages(paper_id, page) with the last section, abstracts aside, whose span has it; spans are laid out page by page and joined on equality."""
    each = sections.where(F.lower("title") != "abstract").select("paper_id", "section_no", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return pages.join(each, ["paper_id", "page"]).groupBy("paper_id", "page").agg(F.max("section_no").alias("section_no"))


def find_page(phrases: DataFrame, pages: DataFrame, words: int = 5) -> DataFrame:
    """phrases(paper_id, phrase_id, phrase, start) with the first page(paper_id, page, text), from `start` on and round, that has the first words of the phrase.

    All runs of that many words of a page are joined with the phrase's on equality, so no text is searched twice."""
    w = lambda c: F.filter(F.split(canon(normalize(c)), " "), lambda x: x != "")
    grams = lambda a: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - words + 1, F.lit(1))), lambda i: F.array_join(F.slice(a, i, F.lit(words)), " ")))
    have = pages.select("paper_id", "page", F.explode(let(w(F.col("text")), grams)).alias("key"))
    n = pages.groupBy("paper_id").agg(F.count_distinct("page").alias("n_pages"))
    want = phrases.withColumn("key", F.array_join(F.slice(w(F.col("phrase")), 1, words), " ")).where(F.length("key") >= 6).join(n, "paper_id")
    hit = want.join(have, ["paper_id", "key"])
    return hit.groupBy("paper_id", "phrase_id").agg(F.min_by("page", F.pmod(F.col("page") - F.col("start"), F.col("n_pages"))).alias("page"))


def title_lines(lines: DataFrame) -> DataFrame:
    """(paper_id, title): on the upper half of the first page, the first run of lines of nearly the largest size, hyphens at line ends joined. lines(paper_id, line_no, page, text, size, y0, page_height)."""
    first = lines.where((F.col("page") == 0) & (F.col("y0") < 0.5 * F.col("page_height")) & (F.length("text") > 3))
    top = F.max("size").over(Window.partitionBy("paper_id"))
    near = ((F.col("size") >= F.col("top") - 1.5) & (F.col("size") > 11)) | (F.abs(F.col("size") - F.col("top")) < 0.6)
    order = Window.partitionBy("paper_id").orderBy("line_no")
    # Lines of the run have as many breaks before them as its first line: a break is a line that isn't near.
    marked = first.withColumn("top", top).withColumn("near", near).withColumn("breaks", F.sum((~F.col("near")).cast("int")).over(order))
    begin = marked.where("near").groupBy("paper_id").agg(F.min("breaks").alias("breaks"))
    run = marked.where("near").join(begin, ["paper_id", "breaks"]).groupBy("paper_id").agg(_joined("line_no", "text", "\n").alias("title"))
    return run.select("paper_id", F.trim(F.regexp_replace(F.regexp_replace("title", "-\n", ""), r"\s+", " ")).alias("title"))
