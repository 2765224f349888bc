"""Column functions over sources, tables and TeX of papers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text_or_empty

# The two forms of a preprint's identifier.
PREPRINT = r"(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)"


def normalize_source(source: Column) -> Column:
    """The URL of a paper's PDF from arxiv:ID, an ID alone, an abstract's URL or any URL; null for what is none of these."""
    s = F.trim(source)
    url = F.when(F.lower(s).startswith("arxiv:"), F.concat(F.lit("https://arxiv.org/abs/"), F.substring(s, F.lit(7), F.length(s)))).when(s.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"), F.concat(F.lit("https://arxiv.org/abs/"), s)).otherwise(s)
    rest = F.regexp_extract(url, r"arxiv\.org/(.*)$", 1)
    preprint = F.regexp_extract(rest, PREPRINT, 1)
    known = (url.contains("arxiv.org/abs/") | url.contains("arxiv.org/pdf/")) & (preprint != "")
    return F.when(url.rlike("^https?://"), F.when(known, F.concat(F.lit("https://arxiv.org/pdf/"), preprint)).otherwise(url))


def source_key(url: Column) -> Column:
    """24 hexadecimal digits that name a download."""
    return F.substring(F.sha2(url, 256), 1, 24)


def extract_paper_id(source: Column, first_page: Column) -> Column:
    """The preprint identifier of a paper: from its link, from an identifier alone, or from the stamp on its first page, in this order; without version."""
    link = F.regexp_extract(text_or_empty(source), rf"arxiv\.org/(?:abs|pdf)/{PREPRINT}", 1)
    alone = F.regexp_extract(F.trim(text_or_empty(source)), rf"^(?i:arxiv:)?{PREPRINT}$", 1)
    stamp = F.regexp_extract(text_or_empty(first_page), rf"arXiv:{PREPRINT}", 1)
    return F.regexp_replace(F.coalesce(*[F.nullif(x, F.lit("")) for x in (link, alone, stamp)]), r"v\d+$", "")


def content_key(*columns: Column) -> Column:
    """A hash that equal contents share."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def label_numbers(text: Column, most: int = 6) -> Column:
    """array of (label, value): one or two words within 12 characters before a decimal number; the first of each label, `most` at most."""
    # The form of a label and its number. A shorter label or gap never fits where the longest doesn't, so nothing is given back and a run of letters is read from its start only.
    form = r"(?<![A-Za-z\-])-*+([A-Za-z][A-Za-z\-]++(?: [A-Za-z][A-Za-z\-]++)?+)[^\d\n]{0,12}+(\d{1,3}\.\d{1,2})"
    found = F.regexp_extract_all(text_or_empty(text), F.lit(form), F.lit(0))
    part = lambda m, i: F.regexp_extract(m, form, i)
    pair = lambda m: let(F.trim(part(m, 1)), lambda a: F.struct(F.lower(a).alias("key"), F.substring(a, 1, 24).alias("label"), part(m, 2).cast("double").alias("value")))
    added = lambda s, m: let(pair(m), lambda p: F.when(F.exists(s, lambda q: q["key"] == p["key"]), s).otherwise(F.array_append(s, p)))
    first = F.aggregate(found, F.array().cast("array<struct<key:string,label:string,value:double>>"), lambda s, m: F.when(F.size(s) >= most, s).otherwise(added(s, m)))
    return F.transform(first, lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value")))


def join_paragraphs(text: Column) -> Column:
    """Line breaks within a paragraph become blanks, unless one of its lines begins a list, table, formula or float."""
    kept = r"(?m)^\s*(?:\\(?:begin|end|item|\[|\])|[|&-]|\$\$)"
    parts = F.split(text_or_empty(text), r"\n\s*\n", -1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(kept), p).otherwise(F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))), "\n\n")
