"""Which accounts are one person: names of the same words, scores of spellings, refutation
by simultaneous work, shared cars and phones, components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions import text
from caravel.operators.joins import connected, overlaps


def name_classes(people: DataFrame) -> DataFrame:
    """id and key of `people` (id, name): the name's distinct words in order, equal for names
    of the same words. Names of fewer than two words are left out.
    """
    words = F.array_sort(F.array_distinct(text.words_of(F.col("name"))))
    return people.select("id", F.when(F.size(words) >= 2, F.concat_ws(" ", words)).alias("key")).filter("key is not null")


def spelling_classes(words: DataFrame) -> DataFrame:
    """word and class of `words` (word; distinct): words of four letters or more that lead to
    each other over spellings one edit apart are a class, named by its smallest.

    Words meet by a letter left out, so only alike ones do; the links are walked as
    components, so a chain of spellings is one class however long it is.
    """
    keyed = words.filter(F.length("word") >= 4).select("word", F.explode(spelling_keys(F.col("word"))).alias("left"))
    other = keyed.select(F.col("word").alias("other"), "left")
    alike = keyed.join(other, "left").filter(F.col("word") < F.col("other")).select("word", "other").distinct()
    alike = alike.filter(text.spelled_alike(F.col("word"), F.col("other")))
    classes = connected(alike, "word", "other").withColumnsRenamed({"node": "word", "component": "class"})
    return words.join(classes, "word", "left").select("word", F.coalesce("class", "word").alias("class"))


def spelled_classes(people: DataFrame) -> DataFrame:
    """As name_classes, each word taken as its class of spellings: id and key."""
    spread = people.select("id", F.explode(F.array_distinct(text.words_of(F.col("name")))).alias("word"))
    classes = spelling_classes(spread.select("word").distinct())
    # a name has a few words: its list is bounded
    folded = spread.join(classes, "word").groupBy("id").agg(F.array_sort(F.collect_set("class")).alias("words"))
    return folded.filter(F.size("words") >= 2).select("id", F.concat_ws(" ", "words").alias("key"))


def contained_names(keys: DataFrame) -> DataFrame:
    """Pairs (short, long) of distinct `keys` of which short's words are all in long, and more.

    A key is looked up by its rarest word only, among the keys that have it: a word that
    very many have is looked up only for keys of nothing but such words.
    """
    split = keys.select("key", F.split("key", " ").alias("words"))
    spread = split.select("key", "words", F.explode("words").alias("word"))
    counts = spread.groupBy("word").agg(F.count("*").alias("n"))
    rarest = spread.join(counts, "word").groupBy("key").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    short = rarest.select(F.col("key").alias("short"), "word")
    met = short.join(spread.select(F.col("key").alias("long"), "words", "word"), "word")
    own = F.split("short", " ")
    return met.filter((F.size(own) < F.size("words")) & (F.size(F.array_except(own, "words")) == 0)).select("short", "long")


def spelling_keys(word: Column) -> Column:
    """A word and what is left of it without any one of its letters: words at one edit from
    each other have one of these in common.
    """
    dropped = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), word.substr(i + 1, F.length(word))))
    return F.when(F.length(word) >= 4, F.array_union(F.array(word), dropped)).otherwise(F.array(word))


def matched(wanted: DataFrame, people: DataFrame) -> DataFrame:
    """For each of `wanted` (wanted; distinct names that are looked for) the best of `people`
    (name): best, score, next (the second best score) and verdict: exact, likely, ambiguous
    (the next is too close), weak, or none (nothing at the floor).

    Wanted names meet the distinct names of people that have a word of four letters or more
    spelled alike, or a shorter word in common; the two best are kept on the map side.
    """
    keyed = lambda df, c: df.select(c).distinct().select(c, F.explode(F.array_distinct(F.flatten(F.transform(text.words_of(F.col(c)), spelling_keys)))).alias("word"))
    pairs = keyed(wanted, "wanted").join(keyed(people, "name"), "word").select("wanted", "name").distinct()
    scored = pairs.withColumn("score", text.name_score(F.col("wanted"), F.col("name"))).filter(F.col("score") >= text.FLOOR)
    top = scored.groupBy("wanted").agg(F.max_by("name", F.struct("score", "name")).alias("best"), F.max(F.struct("score", "name"))["score"].alias("score"))
    second = scored.join(top.select("wanted", "best"), "wanted").filter("name <> best").groupBy("wanted").agg(F.max("score").alias("next"))
    verdict = (
        F.when(F.col("best").isNull(), "none")
        .when(text.fold_name(F.col("wanted")) == text.fold_name(F.col("best")), "exact")
        .when(F.coalesce(F.col("score") - F.col("next") < text.CLOSE, F.lit(False)), "ambiguous")
        .when(F.col("score") >= text.STRONG, "likely")
        .otherwise("weak")
    )
    return wanted.select("wanted").distinct().join(top, "wanted", "left").join(second, "wanted", "left").withColumn("verdict", verdict)


def refuted(pairs: DataFrame, trips: DataFrame) -> DataFrame:
    """Pairs (a, b) whose two accounts drove different cars at the same time. `trips`: id,
    plate, start, end.
    """
    mine = pairs.join(trips.select(F.col("id").alias("a"), F.col("plate").alias("a_plate"), F.col("start").alias("a_start"), F.col("end").alias("a_end")), "a")
    other = pairs.select("a", "b").join(trips.select(F.col("id").alias("b"), F.col("plate").alias("b_plate"), F.col("start").alias("b_start"), F.col("end").alias("b_end")), "b")
    met = overlaps(mine, other, ["a", "b"], ("a_start", "a_end"), ("b_start", "b_end"), 240)
    return met.filter("a_plate <> b_plate and a_start < b_end and b_start < a_end").select("a", "b").distinct()


def phone_links(records: DataFrame) -> DataFrame:
    """A phone key that exactly two records on different platforms share links them."""
    return links_by(records.withColumn("key", text.phone_key(F.col("phone"))), "phone")


def email_links(records: DataFrame) -> DataFrame:
    """An address, whatever its case, that exactly two named records on different platforms
    share links them.
    """
    address = F.lower(F.trim("email"))
    named = records.filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    return links_by(named.withColumn("key", F.when(F.contains(address, F.lit("@")), address)), "email")


def links_by(records: DataFrame, reason: str) -> DataFrame:
    """a, b, reason for each `key` that exactly two of `records` (id, platform, key) have, on
    different platforms: on three it names a handset or an office, not a person.
    """
    keyed = records.filter("key is not null")
    pairs = keyed.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("platform").alias("platforms"), F.min("id").alias("a"), F.max("id").alias("b"))
    return pairs.filter("n = 2 and platforms = 2 and a <> b").select("a", "b", F.lit(reason).alias("reason"))


def shared_car(pairs: DataFrame, trips: DataFrame) -> DataFrame:
    """The pairs (a, b) whose two accounts have driven one car."""
    driven = trips.select("id", "plate").filter("plate is not null").distinct()
    both = pairs.join(driven.withColumnRenamed("id", "a"), "a").join(driven.withColumnRenamed("id", "b"), ["b", "plate"])
    return both.select("a", "b").distinct()


def name_pairs(people: DataFrame, spelled: bool = False) -> DataFrame:
    """Pairs a < b of accounts whose names are of the same words (`spelled`: of words spelled
    alike), each account with the first of its class, and of the firsts of classes of which
    one has all words of the other.
    """
    classes = spelled_classes(people) if spelled else name_classes(people)
    firsts = classes.groupBy("key").agg(F.min("id").alias("first"))
    same = classes.join(firsts, "key").select(F.col("first").alias("x"), F.col("id").alias("y"))
    first = lambda c: firsts.select(F.col("key").alias(c), F.col("first").alias(f"{c}_id"))
    more = contained_names(firsts.select("key")).join(first("short"), "short").join(first("long"), "long").select(F.col("short_id").alias("x"), F.col("long_id").alias("y"))
    return same.unionByName(more).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def persons(pairs: DataFrame, trips: DataFrame, links: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """id, person: components over name pairs that share a car and that simultaneous work
    does not refute, and over other links. What people have decided (`register`: a, b,
    decision) goes before: a rejected pair is no link on any grounds, a confirmed one always.
    """
    kept = shared_car(pairs, trips).join(refuted(pairs, trips), ["a", "b"], "left_anti").select("a", "b").unionByName(links.select("a", "b"))
    if register is not None:
        decided = register.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "decision")
        ordered = kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        kept = ordered.join(decided.filter("decision = 'rejected'"), ["a", "b"], "left_anti").unionByName(decided.filter("decision = 'confirmed'").select("a", "b"))
    found = connected(kept)
    return found.withColumnsRenamed({"node": "id", "component": "person"})


def canonical(records: DataFrame, key: str, rank: Column, columns: list[str]) -> DataFrame:
    """One row for each `key`: of every column the first value that is not blank, in the
    order of `rank` (unique within the key); who has records, and how many there are.
    """
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = lambda c: F.min_by(known(c), F.when(known(c).isNotNull(), rank)).alias(c)
    named = records.filter(known(key).isNotNull())
    return named.groupBy(key).agg(F.min_by("platform", rank).alias("platform"), F.array_sort(F.collect_set("platform")).alias("platforms"), F.count("*").alias("records"), *map(first, columns))
