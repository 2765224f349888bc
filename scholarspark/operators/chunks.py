"""Text cut and packed under a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .inorder import folded, ranked


def _pieces(par: Column, most: int) -> Column:
    """An over-long paragraph cut, while it is too long, after the last ". " past half the budget, else hard."""
    state = F.struct(F.array().cast("array<string>").alias("out"), par.alias("rest"))

    def cut(s: Column, _: Column) -> Column:
        window = F.substring(s["rest"], F.lit(1), F.lit(most))
        at = F.length(window) - F.instr(F.reverse(window), " .")
        found = F.instr(F.reverse(window), " .") > 0
        end = F.when(found & (at > most // 2 + 1), at).otherwise(F.lit(most))
        more = F.length(s["rest"]) > most
        return F.struct(F.when(more, F.array_append(s["out"], F.trim(F.substring(s["rest"], F.lit(1), end)))).otherwise(s["out"]).alias("out"), F.when(more, F.trim(F.substring(s["rest"], end + 1, F.length(s["rest"])))).otherwise(s["rest"]).alias("rest"))

    rounds = F.sequence(F.lit(1), F.ceil(F.length(par) / (most // 2)) + 1)
    return F.aggregate(rounds, state, cut, lambda s: F.array_append(s["out"], s["rest"]))


def split_text(text: Column, most: int, separator: str = "\n\n") -> Column:
    """array of parts of up to `most` characters: paragraphs packed in order while they fit with their separators, over-long ones cut. Nothing is lost but blanks at cuts."""
    state = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"))
    gap = len(separator)

    def pack(s: Column, par: Column) -> Column:
        long = F.length(par) > most
        cut = _pieces(par, most)
        head, tail = F.slice(cut, F.lit(1), F.size(cut) - 1), F.element_at(cut, -1)
        flushed = F.when(s["cur"] != "", F.array_append(s["parts"], s["cur"])).otherwise(s["parts"])
        full = (s["cur"] != "") & (F.length(s["cur"]) + F.length(par) + gap > most)
        parts = F.when(long, F.concat(flushed, head)).when(full, flushed).otherwise(s["parts"])
        cur = F.when(long, tail).when(full | (s["cur"] == ""), par).otherwise(F.concat(s["cur"], F.lit(separator), par))
        return F.struct(parts.alias("parts"), cur.alias("cur"))

    packed = F.aggregate(F.split(text, separator, -1), state, pack, lambda s: F.when(s["cur"] != "", F.array_append(s["parts"], s["cur"])).otherwise(s["parts"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


def build_chunks(sections: DataFrame, most: int = 1100, separator: str = "\n\n") -> DataFrame:
    """(paper_id, chunk_no, section_no, part, text): parts of sections(paper_id, section_no, text), blank ones skipped, numbered through the paper."""
    parts = sections.select("paper_id", "section_no", F.posexplode(split_text(F.col("text"), most, separator)).alias("part", "text")).where(F.trim("text") != "")
    return ranked(parts, ["paper_id"], [F.col("section_no"), F.col("part")], "chunk_no")


def pack_units(units: DataFrame, most: int) -> DataFrame:
    """units(paper_id, unit_no, size) with pack: in order, a unit opens a new pack if it doesn't fit into the last. A fold over each paper's sizes, of which only the open pack is held."""

    def step(state: tuple, values: tuple) -> tuple[tuple, int]:
        (pack, used), (size,) = state, values
        pack, used = (pack + 1, size) if used > 0 and used + size > most else (pack, used + size)
        return (pack, used), pack

    rows = units.select("paper_id", F.col("unit_no").cast("long").alias("unit_no"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    return folded(rows, ["paper_id"], [F.col("unit_no"), F.col("size")], ["size"], (1, 0), step, "pack", "int").drop("size")


def label_parts(parts: DataFrame) -> DataFrame:
    """parts(paper_id, section_no, part, title) with n_parts, and " (k/n)" after the title where a section has several."""
    n = F.count("*").over(Window.partitionBy("paper_id", "section_no"))
    return parts.withColumn("n_parts", n).withColumn("title", F.when(F.col("n_parts") > 1, F.concat("title", F.lit(" ("), F.col("part") + 1, F.lit("/"), "n_parts", F.lit(")"))).otherwise(F.col("title")))


def grounding_text(understood: DataFrame, sections: DataFrame, most: int = 10**9) -> DataFrame:
    """(paper_id, section_id, text): for understood(paper_id, section_id, raw_ids) the texts of sections(paper_id, raw_id, heading, text), or of their parts ("r7#2"), in the listed order under their headings."""
    ids = understood.select("paper_id", "section_id", F.posexplode("raw_ids").alias("n", "id"))
    ids = ids.withColumn("raw_id", F.element_at(F.split("id", "#"), 1)).withColumn("part", F.get(F.split("id", "#"), F.lit(1)).try_cast("int"))
    both = ids.join(sections, ["paper_id", "raw_id"])
    body = F.when(F.col("part").isNull(), F.col("text")).otherwise(F.coalesce(F.get(split_text(F.col("text"), most), F.col("part") - 1), F.lit("")))
    label = F.concat("heading", F.when(F.col("part").isNull(), "").otherwise(F.concat(F.lit(" (part "), "part", F.lit(")"))))
    piece = F.struct("n", F.concat(F.lit("## "), label, F.lit("\n"), body).alias("t"))
    return both.groupBy("paper_id", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["t"]), "\n\n").alias("text"))


def clean_plan(plan: DataFrame, sections: DataFrame) -> DataFrame:
    """plan(paper_id, section_id, ordinal, raw_id): unknown raw ids and later uses of one dropped, the rest in reading order of sections(paper_id, raw_id, section_no)."""
    known = plan.join(sections, ["paper_id", "raw_id"])
    first = known.withColumn("__r", F.row_number().over(Window.partitionBy("paper_id", "raw_id").orderBy("ordinal"))).where("__r = 1")
    ids = first.groupBy("paper_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "raw_id"))).alias("ids"))
    return ids.select("paper_id", "section_id", F.transform("ids", lambda x: x["raw_id"]).alias("raw_ids"), F.col("ids")[0]["section_no"].alias("first"))


def check_plan(plan: DataFrame, sections: DataFrame, least: int, most: int) -> DataFrame:
    """(paper_id, problem, what): raw ids that aren't sections, ids used twice, papers with under least - 1 or over most + 2 planned sections."""
    unknown = plan.join(sections, ["paper_id", "raw_id"], "left_anti").select("paper_id", F.lit("unknown").alias("problem"), F.col("raw_id").cast("string").alias("what")).distinct()
    twice = plan.groupBy("paper_id", "raw_id").agg(F.count("*").alias("n")).where("n > 1").select("paper_id", F.lit("twice").alias("problem"), F.col("raw_id").cast("string").alias("what"))
    count = plan.groupBy("paper_id").agg(F.count_distinct("section_id").alias("n")).where((F.col("n") < least - 1) | (F.col("n") > most + 2)).select("paper_id", F.lit("count").alias("problem"), F.col("n").cast("string").alias("what"))
    return unknown.unionAll(twice).unionAll(count)


def fallback_plan(sections: DataFrame) -> DataFrame:
    """(paper_id, plan_no, raw_ids): each level-1 section(paper_id, section_no, raw_id, title, level), abstracts aside, with those that follow it."""
    body = sections.where(F.lower("title") != "abstract")
    top = F.sum((F.col("level") == 1).cast("int")).over(Window.partitionBy("paper_id").orderBy("section_no"))
    listed = body.withColumn("plan_no", F.greatest(top, F.lit(1))).groupBy("paper_id", "plan_no").agg(F.array_sort(F.collect_list(F.struct("section_no", "raw_id"))).alias("ids"))
    return listed.select("paper_id", "plan_no", F.transform("ids", lambda x: x["raw_id"]).alias("raw_ids"))
