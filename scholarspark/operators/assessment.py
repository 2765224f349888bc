"""Question sets: quotas, validity, keys, near-duplicates, balanced picks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jaccard, option_index, word_set
from ..shared import settle
from .inorder import ranked

MAX_PER_SECTION = 4
#: Open questions of a key that are compared with each other in the first wave.
GROUP = 256


def question_problems(questions: DataFrame) -> DataFrame:
    """questions(question, correct, explanation, distractors array, ...) with problems: what is wrong with each; numbers are checked by grounding."""
    options = F.concat(F.array("correct"), F.col("distractors"))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    few = (F.size("distractors") < 3) | F.exists(options, lambda o: empty(o))
    same = F.size(F.array_distinct(F.transform(options, F.lower))) != 4
    checks = [
        (empty(F.col("question")) | empty(F.col("correct")) | empty(F.col("explanation")), "question, correct answer and explanation are required"),
        (few, "needs 3 non-empty distractors"),
        (~few & same, "the four options must be different"),
        (F.array_join(options, " ").rlike(r"(?i)\b(all|none) of the above\b"), 'no "all/none of the above"'),
    ]
    return questions.withColumn("problems", F.array_compact(F.array(*[F.when(bad, F.lit(says)) for bad, says in checks])))


def plan_quota(sizes: DataFrame, target: int) -> DataFrame:
    """sizes(paper, section, section_no, size) with quota: questions to ask for in each section.

    As many as target and half again, at least one a section: first in proportion to size, rounded, 1 to 4; what is
    missing goes one by one to the section with the largest size for each question it would have, which is the
    same as ranking all possible further questions by that number, for it falls with each one given.
    """
    by = Window.partitionBy("paper")
    want = F.greatest(F.lit(target + target // 2), F.count("*").over(by))
    base = F.greatest(F.lit(1), F.least(F.lit(MAX_PER_SECTION), F.rint(want * F.col("size") / F.greatest(F.sum("size").over(by), F.lit(1)))))
    planned = sizes.withColumn("want", want).withColumn("base", base.cast("int"))
    planned = planned.withColumn("left", F.greatest(F.col("want") - F.sum("base").over(by), F.lit(0)))
    more = planned.where(F.col("base") < MAX_PER_SECTION).withColumn("k", F.explode(F.sequence(F.col("base") + 1, F.lit(MAX_PER_SECTION))))
    rank = F.row_number().over(by.orderBy(F.desc(F.col("size") / F.col("k")), "section_no"))
    given = more.withColumn("rank", rank).where(F.col("rank") <= F.col("left")).groupBy("paper", "section").agg(F.count("*").alias("more"))
    return planned.join(given, ["paper", "section"], "left").select("paper", "section", (F.col("base") + F.coalesce("more", F.lit(0))).cast("int").alias("quota"))


def round_robin(questions: DataFrame, target: int) -> DataFrame:
    """questions(paper, section, section_no, ordinal): the first of every section in reading order, then the second of every, until `target`."""
    depth = F.row_number().over(Window.partitionBy("paper", "section").orderBy("ordinal"))
    at = F.row_number().over(Window.partitionBy("paper").orderBy("depth", "section_no"))
    return questions.withColumn("depth", depth).where(F.col("depth") <= target).withColumn("pick", at).where(F.col("pick") <= target)


def top_up(sizes: DataFrame, pool: DataFrame, target: int) -> DataFrame:
    """(paper, section, ask): further questions if pool(paper, n) has fewer than target: need and half again (two at least), dealt round the sections from the longest, four each at most."""
    need = target - F.coalesce("n", F.lit(0))
    asks = need + F.greatest(F.lit(2), F.floor(need / 2))
    by = Window.partitionBy("paper")
    ranked = sizes.join(pool, "paper", "left").where(need > 0).withColumn("at", F.row_number().over(by.orderBy(F.desc("size"), "section_no"))).withColumn("sections", F.count("*").over(by))
    dealt = F.floor((asks - F.col("at")) / F.col("sections")) + 1
    return ranked.select("paper", "section", F.least(F.lit(MAX_PER_SECTION), dealt).cast("int").alias("ask")).where("ask > 0")


def balance_answers(questions: DataFrame) -> DataFrame:
    """questions(paper, question, options array, answer) with the right option at slots that are spread evenly over A to D, by a hash of the question; others keep their order."""
    dealt = ranked(questions.withColumn("__h", F.sha2("question", 256)), ["paper"], [F.col("__h"), F.col("question"), F.col("answer")], "__at")
    slot = (F.col("__at") - 1) % 4
    others = F.filter("options", lambda o, i: i != F.col("answer"))
    moved = F.concat(F.slice("others", F.lit(1), F.col("slot")), F.array(F.get("options", F.col("answer"))), F.slice("others", F.col("slot") + 1, F.lit(4)))
    return dealt.withColumn("slot", slot.cast("int")).drop("__h", "__at").withColumn("others", others).withColumn("options", moved).withColumn("answer", F.col("slot")).drop("slot", "others")


def shuffle_options(questions: DataFrame) -> DataFrame:
    """questions(question, options array, right one first) with options in an order hashed from question and option, and answer, where the right one went."""
    keyed = F.array_sort(F.transform("options", lambda o, i: F.struct(F.sha2(F.concat("question", F.lit("|"), o), 256).alias("h"), i.alias("i"), o.alias("o"))))
    return questions.withColumn("__k", keyed).withColumn("options", F.transform("__k", lambda s: s["o"])).withColumn("answer", (F.array_position(F.transform("__k", lambda s: s["i"]), 0) - 1).cast("int")).drop("__k")


def agree_keys(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions(question_id, answer) with agreed: whether an independent reply in answers(question_id, reply) names the same option."""
    return questions.join(answers, "question_id", "left").withColumn("agreed", option_index(F.col("reply")) == F.col("answer"))


def quiz_stats(questions: DataFrame) -> DataFrame:
    """One row from questions(section, malformed, agreed): asked, malformed, disputed, kept, sections covered."""
    kept = ~F.col("malformed") & F.col("agreed")
    return questions.agg(F.count("*").alias("asked"), F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed") & ~F.col("agreed")).alias("disputed"), F.count_if(kept).alias("kept"), F.count_distinct(F.when(kept, F.col("section"))).alias("sections"))


def best_beat(questions: DataFrame, beats: DataFrame) -> DataFrame:
    """(question_id, beat_id, score): the beat of a question's section that shares most words with it; of equals the deep view's, then the first. None if nothing is shared."""
    q = questions.select("paper_id", "section_id", "question_id", word_set(F.col("text")).alias("want"))
    b = beats.select("paper_id", "section_id", "beat_id", "beat_no", (F.col("view") != "deep").alias("later"), word_set(F.col("text")).alias("have"))
    scored = q.join(b, ["paper_id", "section_id"]).withColumn("score", F.round(jaccard(F.col("want"), F.col("have")), 6)).where("score > 0")
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "later", "beat_no")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("question_id", "beat_id", "score")


def _together(words: Column, n: int) -> Column:
    """All choices of n of the words, in their order, as strings."""
    if n == 1:
        return words
    shorter = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.transform(_together(F.slice(words, i + 1, F.size(words)), n - 1), lambda rest: F.concat_ws(" ", F.element_at(words, i), rest)))
    return F.flatten(shorter)


def _by_rarity(sets: DataFrame, column: str) -> DataFrame:
    """(id, ws, n): the words of each set from the rarest to the most frequent, and how many they are."""
    words = sets.select("id", F.explode(column).alias("word"))
    df = settle(words.groupBy("word").agg(F.count("*").alias("df")))
    ordered = words.join(df, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ws"))
    return ordered.select("id", F.col("ws.word").alias("ws"), F.size("ws").alias("n"))


def _first(share: float, k: int) -> Column:
    """Two sets that overlap by `share` have at least ceil(n * share) words in common, and so k of these (if there are as many) among the first words of either, which this gives."""
    return F.slice("ws", F.lit(1), F.least(F.col("n"), (F.col("n") - F.ceil(F.col("n") * share) + k).cast("int")))


def _keys(sets: DataFrame, share: float, also: DataFrame | None = None) -> DataFrame:
    """(id, n, key): what sets(id, ws, n) that overlap by `share` have in common, and some others do; with also(id, word), each key only with each word.

    Sets meet under three common words among their first; those that may have fewer in common, which have three words
    or less, also under two and one.
    """
    keys = []
    for k in (3, 2, 1):
        able = sets.where(F.col("n") >= k) if k == 3 else sets.where((F.col("n") >= k) & (F.ceil(F.col("n") * share) <= k))
        keys.append(able.select("id", "n", F.explode(_together(_first(share, k), k)).alias("key")))
    keyed = keys[0].unionAll(keys[1]).unionAll(keys[2])
    if also is not None:
        keyed = keyed.join(also, "id").select("id", "n", F.concat_ws("|", F.lit("answer"), "key", "word").alias("key"))
    return keyed.select("id", "n", F.xxhash64("key").alias("key"))


def _pairs(x: DataFrame, y: DataFrame, share: float) -> DataFrame:
    """(a_id, b_id), b_id from y and a_id an earlier one from x that has a key of it and a size that may do."""
    x, y = x.alias("x"), y.alias("y")
    sizes = F.least("x.n", "y.n") >= share * F.greatest("x.n", "y.n")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & sizes).select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id")).distinct()


def drop_similar(questions: DataFrame, share: float = 0.6, group: int = GROUP) -> DataFrame:
    """questions(id, question, correct) without those that repeat an earlier one that stays: word sets that overlap by `share`, or by half of it with answers that do.

    Questions with the same words and the same answer words are one, whose first stays or goes for all. The others meet on
    choices of their rarest words (_keys): of the questions, or of the answers with one of the question. In waves: of
    each key the first `group` open questions are compared with each other; who is among them under all of its keys, and has
    no earlier neighbour left, stays, and is a leader; then all open questions are compared with the new leaders
    under their keys, and their neighbours go. So a family of n alike questions makes about n links, and one
    of questions that only share words is settled group by group, each wave with groups twice as large. Every wave settles the earliest open question at least.
    """
    least = share / 2
    words = questions.select("id", F.array_sort(word_set(F.col("question"))).alias("w"), F.array_sort(word_set(F.coalesce(F.col("correct"), F.lit("")))).alias("a"))
    # A question without words overlaps with nothing, not even with another one.
    q = settle(words.where(F.size("w") > 0).groupBy("w", "a").agg(F.min("id").alias("id")))
    copies = words.join(q.withColumnRenamed("id", "first"), ["w", "a"]).where("id <> first").select("id")
    asked, answered = settle(_by_rarity(q, "w")), _by_rarity(q, "a")
    keyed = settle(_keys(asked, share).unionAll(_keys(answered, share, asked.select("id", F.explode(_first(least, 1)).alias("word")))).distinct())
    often = settle(keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"))
    keyed = settle(keyed.join(often, "key"))  # kept, so that a join can split a key that many have

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(q.select(F.col("id").alias("a_id"), F.col("w").alias("aw"), F.col("a").alias("aa")), "a_id").join(q.select(F.col("id").alias("b_id"), F.col("w").alias("bw"), F.col("a").alias("ba")), "b_id")
        over = jaccard(F.col("aw"), F.col("bw"))
        return settle(both.where((over >= share) | ((over >= least) & (jaccard(F.col("aa"), F.col("ba")) >= share))).select("a_id", "b_id"))

    gone = copies
    while not keyed.isEmpty():
        first = settle(keyed.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= group).drop("r"))
        n_keys = keyed.groupBy("id").agg(F.count("*").alias("all"))
        able = settle(first.groupBy("id").agg(F.count("*").alias("n")).join(n_keys, "id").where(F.col("n") == F.col("all")).select("id"))
        edges = alike(_pairs(first, first.join(able, "id", "left_semi"), share))
        leaders, settled = [], able
        while True:
            # Who has no earlier neighbour left stays; so their later neighbours go, with all their edges.
            stay = settle(settled.join(edges.select(F.col("b_id").alias("id")), "id", "left_anti"))
            if stay.isEmpty():
                break
            leaders.append(stay)
            drop = settle(edges.join(stay.withColumnRenamed("id", "a_id"), "a_id", "left_semi").select(F.col("b_id").alias("id")).distinct())
            gone = gone.unionAll(drop)
            edges = settle(edges.join(drop.withColumnRenamed("id", "a_id"), "a_id", "left_anti").join(drop.withColumnRenamed("id", "b_id"), "b_id", "left_anti"))
            settled = settle(settled.join(stay.unionAll(drop), "id", "left_anti"))
            keyed = keyed.join(drop, "id", "left_anti")
            if edges.isEmpty() and settled.isEmpty():
                break
        new = settle(functools.reduce(DataFrame.unionAll, leaders))
        led = settle(keyed.join(new, "id", "left_semi"))
        keyed = settle(keyed.join(new, "id", "left_anti"))
        if keyed.isEmpty():
            break
        drop = settle(alike(_pairs(led, keyed, share)).select(F.col("b_id").alias("id")).distinct())
        gone = gone.unionAll(drop)
        keyed = settle(keyed.join(drop, "id", "left_anti"))
        group *= 2
    return questions.join(gone, "id", "left_anti")


def distinct_in_order(items: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The first place of each distinct key."""
    return items.groupBy(*keys).agg(F.min(ordinal).alias(ordinal))
