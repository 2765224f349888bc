"""Tables, figures and numbered floats of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .inorder import folded


def table_markdown(cells: DataFrame) -> DataFrame:
    """(paper_id, number, markdown): cells(paper_id, number, row_no, col_no, text) as rows of |, a rule under the first."""
    listed = lambda order, c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(c).alias("t")))), lambda s: s["t"])
    rows = cells.groupBy("paper_id", "number", "row_no").agg(F.count("*").alias("width"), F.concat(F.lit("| "), F.array_join(listed("col_no", "text"), " | "), F.lit(" |")).alias("row"))
    ruled = rows.withColumn("row", F.when(F.col("row_no") == 0, F.concat("row", F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("width").cast("int")))).otherwise(F.col("row")))
    return ruled.groupBy("paper_id", "number").agg(F.array_join(listed("row_no", "row"), "\n").alias("markdown"))


def number_floats(floats: DataFrame) -> DataFrame:
    """floats(paper_id, ordinal, kind, weight) with number: figures, tables and equations counted apart, in order; those of weight 0 get none."""
    so_far = F.sum("weight").over(Window.partitionBy("paper_id", "kind").orderBy("ordinal"))
    return floats.withColumn("number", F.when(F.col("weight") > 0, so_far))


def number_sections(heads: DataFrame) -> DataFrame:
    """heads(paper_id, ordinal, level 1 to 3, starred, appendix) with number: counters of three levels, deeper ones begin anew, appendices count in letters; starred heads have none."""

    def step(state: tuple, values: tuple) -> tuple[tuple, tuple]:
        level, starred = values
        if not starred:
            state = (*state[: level - 1], state[level - 1] + 1, *(0,) * (3 - level))
        return state, state

    counted = folded(heads, ["paper_id", "appendix"], [F.col("ordinal")], ["level", "starred"], (0, 0, 0), step, "__n", "array<int>")
    n = [F.col("__n")[i] for i in range(3)]
    top = F.when(F.col("appendix"), F.char(n[0] + 64)).otherwise(n[0].cast("string"))
    number = F.when(F.col("level") == 1, top).when(F.col("level") == 2, F.concat_ws(".", top, n[1])).otherwise(F.concat_ws(".", top, n[1], n[2]))
    return counted.withColumn("number", F.when(F.col("starred"), "").otherwise(number)).drop("__n")


def attach_figures(sections: DataFrame, figures: DataFrame, most: int = 4) -> DataFrame:
    """(paper_id, section_id, number): figures(paper_id, number, raw_id, files) with files that sections(paper_id, section_id, raw_ids, text) mention or hold, `most` of each by number."""
    usable = figures.where(F.size("files") > 0)
    said = sections.select("paper_id", "section_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"\bFig(?:ure|\.)\s*(\d+)"), F.lit(1)), lambda n: n.cast("int"))).alias("number")).join(usable, ["paper_id", "number"]).select("paper_id", "section_id", "number")
    held = sections.select("paper_id", "section_id", F.explode("raw_ids").alias("raw_id")).join(usable, ["paper_id", "raw_id"]).select("paper_id", "section_id", "number")
    both = said.unionAll(held).distinct()
    return both.withColumn("__r", F.row_number().over(Window.partitionBy("paper_id", "section_id").orderBy("number"))).where(F.col("__r") <= most).drop("__r")


def attach_tables(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """(paper_id, section_id, number): tables(paper_id, number, raw_id) that sections hold or cite."""
    said = sections.select("paper_id", "section_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"\bTables?\s+(\d+)"), F.lit(1)), lambda n: n.cast("int"))).alias("number")).join(tables, ["paper_id", "number"]).select("paper_id", "section_id", "number")
    held = sections.select("paper_id", "section_id", F.explode("raw_ids").alias("raw_id")).join(tables, ["paper_id", "raw_id"]).select("paper_id", "section_id", "number")
    return said.unionAll(held).distinct()


def keep_tables(cells: DataFrame, captions: DataFrame) -> DataFrame:
    """cells(paper_id, found_no, page, row_no, col_no, text) of detected tables that are ones: two rows with text, two columns and two cells with digits; with the number of the first captions(paper_id, page, number) of their page; the first of each number."""
    full = F.coalesce(F.trim("text"), F.lit("")) != ""
    row = F.when(full, F.col("row_no"))  # two different ones are there if the least isn't the largest
    good = cells.groupBy("paper_id", "found_no", "page").agg((F.min(row) < F.max(row)).alias("rows"), F.max("col_no").alias("last"), F.count_if(F.col("text").rlike(r"\d")).alias("digits")).where("rows and last >= 1 and digits >= 2")
    named = good.join(captions.groupBy("paper_id", "page").agg(F.min("number").alias("number")), ["paper_id", "page"])
    first = named.groupBy("paper_id", "number").agg(F.min("found_no").alias("found_no"))
    return cells.join(first, ["paper_id", "found_no"])


def cap_lists(understood: DataFrame) -> DataFrame:
    """understood with its lists cut: 6 key points, 3 distinct quotes, 3 equations, 6 results, 8 prior works; lists that it lacks are passed over."""
    most = {"key_points": 6, "equations": 3, "results": 6, "prior_work": 8}
    out = understood.withColumns({c: F.slice(c, 1, n) for c, n in most.items() if c in understood.columns})
    return out.withColumn("key_quotes", F.slice(F.array_distinct("key_quotes"), 1, 3)) if "key_quotes" in understood.columns else out


def clean_focus(beats: DataFrame, elements: DataFrame, most: int = 3) -> DataFrame:
    """beats(paper_id, section_id, beat_id, focus) with the focus ids that elements(paper_id, section_id, id) have, `most` at most; none where nothing is left."""
    known = elements.groupBy("paper_id", "section_id").agg(F.collect_set("id").alias("__ids"))
    left = F.slice(F.array_intersect("focus", F.coalesce("__ids", F.array().cast("array<string>"))), 1, most)
    return beats.join(known, ["paper_id", "section_id"], "left").withColumn("focus", left).drop("__ids")
