"""Column functions over TeX sources: tables, bibliographies, sections, citations and cross-references.

Titles and labels in braces may hold other groups, DEPTH levels of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import delatex, let, strip_comments, text_or_empty

DEPTH = 5


def _inside(depth: int = DEPTH) -> str:
    """A pattern for what stands between two braces that belong together."""
    return r"[^{}]*+" + (rf"(?:\{{{_inside(depth - 1)}\}}[^{{}}]*+)*+" if depth else "")


# Commands that draw a table, commands that cite or refer, and how each shows what it names.
TABLE_RULES = r"\\(?:toprule|midrule|bottomrule|hline|endhead|endfoot|endfirsthead)\b(?:\[[^\]]*\])?|\\(?:cmidrule|cline)(?:\([^)]*\))?\{[^}]*\}|\\(?:rowcolor|cellcolor)(?:\[[^\]]*\])?\{[^}]*\}"
CITE = r"\\(?:citep|citealp|parencite|cite|autocite|citet|textcite|citeauthor|citeyear)\*?(?:\[[^\]]*\]){0,2}\{[^}]*\}"
REFER = r"\\(?:autoref|cref|Cref|nameref|eqref|ref)\{[^}]*\}"
HEADING = rf"\\(section|subsection|subsubsection)(\*?)\s*(?:\[[^\]]*\])?\s*\{{({_inside()})\}}"
LEVELS = {"section": 1, "subsection": 2, "subsubsection": 3}
LEAST_PREAMBLE = 200


def tex_text(tex: Column) -> Column:
    """A short piece of TeX (a cell, label or title) as plain text on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(delatex(tex), r"\\([%&#_])", "$1"), r"[\s~]+", " "))


def tabular_cells(body: Column) -> Column:
    """array of rows of cells (array<array<string>>) of a tabular's body: rules removed, spans over columns padded, spans over rows unwrapped, citations removed, rows without text left out, all rows padded to the widest."""
    drawn = F.regexp_replace(text_or_empty(body), TABLE_RULES, "")
    wide, tall = r"(?s)^\s*\\multicolumn\{(\d+)\}\{[^}]*\}\{(.*)\}\s*$", r"(?s)^\s*\\multirow\{[^}]*\}\{[^}]*\}\{(.*)\}\s*$"

    def cells(cell: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(cell, wide, "$2"), tall, "$1")
        span = F.when(cell.rlike(wide), F.regexp_extract(cell, wide, 1).try_cast("int")).otherwise(1)
        bare = F.regexp_replace(inner, r"\\cite[a-z]*\*?(\[[^\]]*\])?\{[^}]*\}", "")
        return F.concat(F.array(tex_text(bare)), F.array_repeat(F.lit(""), F.greatest(F.coalesce(span, F.lit(1)) - 1, F.lit(0))))

    rows = F.transform(F.split(drawn, r"\\\\(?:\[[^\]]*\])?", -1), lambda r: F.flatten(F.transform(F.split(r, r"(?<!\\)&", -1), cells)))
    full = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
    return let(full, lambda some: F.transform(some, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.array_max(F.transform(some, F.size)) - F.size(r)))))


def parse_bibitems(bbl: Column) -> Column:
    """array of (no, key, short, text): the entries of a bibliography; short is "Authors, Year" from the label, else the label up to ), else the running number."""
    items = F.slice(F.split(text_or_empty(bbl), r"\\bibitem", -1), 2, 1_000_000_000)
    form = rf"(?s)^\s*(?:\[((?:[^\[\]{{}}]++|\{{{_inside()}\}})*+)\])?\s*(?:\{{([^{{}}]*)\}})?(.*)$"

    def entry(item: Column, i: Column) -> Column:
        label = tex_text(F.regexp_replace(F.regexp_extract(item, form, 1), r"[{}]", ""))
        dated = r"^\s*(.*?)\s*\((\d{4}[a-z]?)\)"
        short = F.when(label == "", (i + 1).cast("string")).when(label.rlike(dated), F.concat_ws(", ", F.regexp_extract(label, dated, 1), F.regexp_extract(label, dated, 2))).otherwise(F.substring_index(label, ")", 1))
        body = F.substring_index(F.regexp_extract(item, form, 3), r"\end{thebibliography}", 1)
        return F.struct((i + 1).alias("no"), F.trim(F.regexp_extract(item, form, 2)).alias("key"), short.alias("short"), tex_text(F.replace(body, F.lit(r"\newblock"), F.lit(" "))).alias("text"))

    return F.transform(items, entry)


def split_tex_sections(tex: Column) -> Column:
    """array of (no, level, starred, title, body), in order: the parts under section commands, without comments, abstract and bibliography; what stands before the first is "Preamble" (no 0) if over 200 characters."""
    t = strip_comments(text_or_empty(tex))
    t = F.regexp_replace(t, r"(?s)^.*?\\begin\{document\}", "")
    t = F.regexp_replace(t, r"(?s)\\begin\{(abstract|thebibliography)\}.*?\\end\{\1\}|\\maketitle|\\end\{document\}", "")
    whole = HEADING.replace("(section|subsection|subsubsection)(\\*?)", "(?:section|subsection|subsubsection)\\*?").replace(f"({_inside()})", _inside())
    kind, star, title = (F.regexp_extract_all(t, F.lit(HEADING), F.lit(g)) for g in (1, 2, 3))
    level = lambda k: F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[k]
    heads = F.transform(F.arrays_zip(kind.alias("k"), star.alias("s"), title.alias("t")), lambda h: F.struct(level(h["k"]).alias("level"), (h["s"] == "*").alias("starred"), tex_text(h["t"]).alias("title")))
    first = F.array(F.struct(F.lit(1).alias("level"), F.lit(False).alias("starred"), F.lit("Preamble").alias("title")))
    bodies = F.transform(F.split(t, whole, -1), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    parts = F.zip_with(F.concat(first, heads), bodies, lambda h, b: F.struct(h["level"].alias("level"), h["starred"].alias("starred"), h["title"].alias("title"), b.alias("body")))
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("no"), p["level"].alias("level"), p["starred"].alias("starred"), p["title"].alias("title"), p["body"].alias("body")))
    return F.filter(numbered, lambda p: (p["no"] > 0) | (F.length(p["body"]) > LEAST_PREAMBLE))


def schema_problems(reply: Column, schema: str, most: int = 8) -> Column:
    """array of problems of a JSON reply (an object's text, or a bare list for a schema of one field) against a DDL schema of required fields; empty if it fits."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    text = F.trim(reply)
    if len(fields) == 1:
        text = F.when(text.startswith("["), F.concat(F.lit(f'{{"{fields[0].name}":'), text, F.lit("}"))).otherwise(text)
    raw = F.from_json(text, "map<string,string>")
    typed = F.from_json(text, StructType.fromDDL(schema))
    missing = [F.when(raw[f.name].isNull(), F.lit(f"{f.name}: field required")).when(typed[f.name].isNull(), F.lit(f"{f.name}: not of type {f.dataType.simpleString()}")) for f in fields]
    listed = F.slice(F.array_compact(F.array(*missing)), 1, most)
    return F.when(raw.isNull() | ~F.coalesce(text.startswith("{"), F.lit(False)), F.array(F.lit("output was not valid JSON"))).otherwise(listed)
