"""Personal data by gradient-boosted candidates, in DataFrame functions only.

Generators propose spans generously and may overlap: the four base kinds as they are
fixed by the contract, and looser shapes of each. Boosted trees judge each candidate by
its format and its context; a threshold for each generator, calibrated for precision on
documents the trees have not seen, selects the redactions. Valid base spans always stay.

There are no labels of personal data, so the trees learn from planted ones: shapes of
personal data and of what is mistaken for it (order numbers, versions, times, sums,
misspelt or malformed ones) are set into pieces of a bounded sample of the corpus, with
telling and misleading words beside either, and found there by the same generators. A
candidate's label is what was planted, not a function of its features. The trees are
then one SQL expression. Positions come from the gaps between matches, summed in order
within each document.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.llm.shared import shared_table, whole_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: generator: (kind, whether the contract's base, what a text must have, pattern). Base
#: patterns give the contract's matches; possessive runs and starts only at the head of
#: a run keep them linear in the text.
GENERATORS = {
    "email": ("email", True, "@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", True, ".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("card", True, None, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"),
    "phone": ("phone", True, "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "email_spelled": ("email", False, "at", r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+(?:\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]{2,64}+(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?|\.)[A-Za-z]{2,24}+|\x20at\x20[A-Za-z0-9-]{2,64}+\x20dot\x20[A-Za-z]{2,24}+)"),
    "ip_long": ("ip", False, ":", r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    "phone_local": ("phone", False, None, r"(?<![0-9+.(/-])(?<![0-9][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-][0-9])(?![0-9])|(?<![0-9+.(/-])(?<![0-9][\x20.-])\(?0[0-9]{2,4}\)?[\x20/-][0-9]{5,8}(?![0-9])"),
}
CUES = {"email": "mail|contact|write|kontakt|correo|courriel|reach", "ip": "host|server|addr|ip|client|login", "card": "card|visa|pay|karte|tarjeta|carte", "phone": "call|phone|tel|fax|mobile|cell|dial|anruf|llam|appel"}
MISLEADING = "order|item|ref|isbn|version|section|invoice|model|serial|part|page|room|score"
LEFT, RIGHT = 24, 8
#: Planted shapes, and pieces of documents (at most so many, of so many code points) they are set into.
TRAIN_ROWS = 8000
PIECES, PIECE = 800, 96
#: How many shapes planted() chooses from.
SHAPES = 27
PRECISION = 0.95


def candidates(docs: DataFrame) -> DataFrame:
    """A written table of row, doc_id, generator, kind, at (its number in the row), gap
    (code points before it), match, left and right (context) for each match; a row
    without any has one line of nulls.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().alias("text"))
    for name, (_, _, needs, pattern) in GENERATORS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if needs:
            found = F.when(F.contains("text", F.lit(needs)), found)
        texts = texts.withColumn(f"m_{name}", F.coalesce(found, F.array().cast("array<string>")))
    rows = []
    for name, (kind, _, _, pattern) in GENERATORS.items():
        gaps = F.split("text", pattern, -1)
        texts = texts.withColumn(f"g_{name}", F.when(F.size(f"m_{name}") > 0, gaps).otherwise(F.array().cast("array<string>")))
        rows.append(_lines(name, kind))
    lines = F.explode_outer(F.concat(*rows)).alias("c")
    return shared_table(texts.select("row", "doc_id", lines).select("row", "doc_id", "c.*"), "candidates")


def _lines(name: str, kind: str) -> Column:
    gaps = F.col(f"g_{name}")
    return F.transform(
        f"m_{name}",
        lambda m, i: F.struct(
            F.lit(name).alias("generator"),
            F.lit(kind).alias("kind"),
            i.alias("at"),
            F.length(F.get(gaps, i)).alias("gap"),
            m.alias("match"),
            F.right(F.get(gaps, i), F.lit(LEFT)).alias("left"),
            F.left(F.get(gaps, i + 1), F.lit(RIGHT)).alias("right"),
        ),
    )


def located(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("row", "generator").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.length("match")).cast("bigint")).over(order)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass; every second from the right is doubled."""
    turned = F.transform(F.split(F.reverse(digits(match)), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(generator: Column, match: Column) -> Column:
    """What the contract asks of a base match beyond its pattern."""
    n = F.length(digits(match))
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(generator == "email", True)
        .when(generator == "ip", match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(generator == "card", n.between(13, 19) & F.when(n.between(13, 19), luhn(match)))
        .when(generator == "phone", n.between(9, 15))
        .otherwise(False)
    )


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context features of candidates (generator, kind, match, left, right)."""
    m, left, right = F.col("match"), F.lower("left"), F.col("right")
    cue = reduce(lambda c, k: c.when(F.col("kind") == k, left.rlike(CUES[k])), CUES, F.when(F.lit(False), False)).otherwise(False)
    made = {
        **{f"is_{g}": F.col("generator") == g for g in GENERATORS},
        "digits": F.least(F.length(digits(m)), F.lit(40)),
        "chars": F.least(F.length(m), F.lit(120)),
        "separators": F.least(F.length(F.regexp_replace(m, "[0-9A-Za-z]+", "")), F.lit(40)),
        "brackets": m.contains("("),
        "first": F.coalesce(F.substring(digits(m), 1, 1).try_cast("int"), F.lit(-1)),
        "groups": F.size(F.split(m, "[^0-9A-Za-z]+")),
        "ending": m.rlike(r"(?i)(?:\.|dot\x20|dot[)\]]\x20?)(?:com|org|net|edu|gov|info|io|co|eu|de|fr|es|it|uk)$"),
        "hex_letters": F.length(F.regexp_replace(m, "[^A-Fa-f]+", "")),
        "distinct": F.size(F.array_distinct(F.split(digits(m), ""))),
        "valid": F.coalesce(valid(F.col("generator"), m), F.lit(False)),
        "luhn": F.length(digits(m)).between(8, 19) & luhn(F.substring(digits(m), 1, 19)),
        "cue": cue,
        "misleading": left.rlike(MISLEADING),
        "glued_left": left.rlike(r"[\p{L}0-9_=/-]$"),
        "glued_right": right.rlike(r"^[\p{L}0-9_=/-]"),
    }
    columns = [c.cast("double").alias(f"f_{k}") for k, c in made.items()]
    return rows.select("*", *columns), [f"f_{k}" for k in made]


def pieces(docs: DataFrame, n: int = PIECES) -> DataFrame:
    """At most `n` pieces of documents, chosen by a hash of their rows: number, before and
    after (the halves of the piece).
    """
    share = 2 * n / max(1, docs.count())
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") > 2 * PIECE).withColumn("key", key)
    some = some.filter(F.pmod(F.col("key"), F.lit(1_000_000)) / 1e6 < share).orderBy("key", "text").limit(n)
    at = (F.pmod(F.xxhash64("text", F.lit("at")), F.length("text") - PIECE) + 1).cast("int")
    numbered = some.withColumn("piece", F.col("text").substr(at, F.lit(PIECE))).select(F.row_number().over(Window.orderBy("key", "piece")).alias("number"), "piece")
    return numbered.select("number", F.left("piece", F.lit(PIECE // 2)).alias("before"), F.substring("piece", PIECE // 2 + 1, PIECE).alias("after"))


def planted(docs: DataFrame, n: int = TRAIN_ROWS) -> DataFrame:
    """doc_id (0 to n - 1), text, kind, personal (1 or 0), from and to (the planted span),
    number (of the piece around it). Shapes, words beside them and faults are drawn by
    hashes, each apart from the others.
    """
    spark = docs.sparkSession
    pick = lambda salt, m: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(m))
    number = lambda salt, width: F.lpad(pick(salt, 10**width).cast("string"), width, "0")
    of = lambda names, salt: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in names])[pick(salt, len(names)).cast("int")]
    word = lambda salt: of(["alder", "brook", "cinder", "dune", "ember", "fern", "grove", "heath", "iris", "jade"], salt)
    top = of(["com", "org", "net", "de", "fr", "es", "io", "edu"], "top")
    fifteen = F.concat(of(["4", "5", "3", "6"], "issuer"), number("card", 14))
    check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(fifteen, d.cast("string"))))[0].cast("string")
    card = F.concat(fifteen, F.when(pick("typo", 12) == 0, number("last", 1)).otherwise(check))
    grouped = lambda c, by: F.concat_ws(by, *[F.substring(c, i, 4) for i in (1, 5, 9, 13)])
    octets = lambda most: F.concat_ws(".", *[pick(s, most).cast("string") for s in "abcd"])
    group = lambda s: F.lower(F.hex(pick(s, 65536)))
    area = F.concat((2 + pick("area", 8)).cast("string"), number("exchange", 2))
    people = F.concat(word("who"), of([".", "_", "", "-"], "joint"), word("name"), of(["", "7", "42"], "end"))
    shapes = [  # kind, whether personal, shape
        ("email", 1, F.concat(people, F.lit("@"), word("host"), F.lit("."), top)),
        ("email", 1, F.concat(people, of([" (at) ", "(at)", " [at] "], "at"), word("host"), of([" (dot) ", " [dot] ", "."], "dot"), top)),
        ("email", 1, F.concat(people, F.lit(" at "), word("host"), F.lit(" dot "), top)),
        ("ip", 1, octets(256)),
        ("ip", 1, F.concat_ws(":", *[group(f"x{i}") for i in range(8)])),
        ("ip", 1, F.concat(of(["fe80", "2001:db8", "2a02:8108", "fd00"], "net"), F.lit("::"), group("y1"), F.when(pick("more", 2) == 0, F.concat(F.lit(":"), group("y2"))).otherwise(""))),
        ("card", 1, card),
        ("card", 1, grouped(card, " ")),
        ("card", 1, grouped(card, "-")),
        ("phone", 1, F.concat(F.lit("+"), of(["1", "44", "49", "33", "34"], "cc"), F.lit(" "), number("p", 3), of([" ", "-"], "sep"), number("q", 3), number("r", 4))),
        ("phone", 1, F.concat(of([F.concat(F.lit("("), area, F.lit(") ")), F.concat(area, F.lit("-")), F.concat(area, F.lit(" "))], "form"), number("q", 3), F.lit("-"), number("r", 4))),
        ("phone", 1, F.concat_ws(".", area, number("q", 3), number("r", 4))),
        ("phone", 1, F.concat(F.lit("0"), number("city", 3), of([" ", "/", "-"], "sep"), number("line", 7))),
        ("email", 0, F.concat(word("who"), of(["@2x.png", "@3x.jpg", "@1.4.2", "@latest.tgz"], "asset"))),
        ("email", 0, F.concat(word("who"), of([" at point dot matrix", " at page dot product", " (at) noon.then", " at line dot line"], "phrase"))),
        ("ip", 0, F.concat_ws(".", pick("a", 20).cast("string"), pick("b", 20).cast("string"), (256 + pick("c", 700)).cast("string"), pick("d", 99).cast("string"))),
        ("ip", 0, F.concat_ws(":", *[number(f"t{i}", 2) for i in range(8)])),
        ("ip", 0, F.concat(of(["add", "fade", "bed", "face", "cafe"], "scope"), F.lit("::"), of(["dead", "beef", "bad", "decade", "ace"], "member"))),
        ("card", 0, F.concat((1 + pick("lead", 9)).cast("string"), number("order", 15))),
        ("card", 0, F.concat(of(["15", "16", "17"], "epoch"), number("ms", 11))),
        ("card", 0, F.concat(of(["978", "979"], "isbn"), number("book", 10))),
        ("card", 0, F.concat(number("long1", 12), number("long2", 12))),
        ("card", 0, grouped(F.concat(number("long1", 8), number("long2", 8)), " ")),
        ("phone", 0, F.concat(F.lit("+"), number("sum", 2), F.lit("."), number("cents", 2))),
        ("phone", 0, F.concat(F.lit("+"), number("long1", 9), F.lit("-"), number("long2", 9))),
        ("phone", 0, F.concat_ws(" ", F.concat(pick("low", 2).cast("string"), number("s", 2)), number("q", 3), number("r", 4))),
        ("phone", 0, F.concat_ws(".", F.concat(pick("low", 2).cast("string"), number("s", 2)), number("q", 3), number("r", 4))),
    ]
    chosen = pick("shape", SHAPES)
    column = lambda i: F.element_at(F.array(*[s[i] if isinstance(s[i], Column) else F.lit(s[i]) for s in shapes]), (chosen + 1).cast("int"))
    rows = spark.range(n).select("id", column(0).alias("kind"), column(1).alias("personal"), column(2).alias("shape"), (pick("piece", PIECES) + 1).cast("int").alias("number"))
    telling = reduce(lambda c, k: c.when(F.col("kind") == k, of(CUES[k].split("|"), "cue")), CUES, F.when(F.lit(False), ""))
    chance = pick("beside", 100)
    mine = F.when(F.col("personal") == 1, chance < 50).otherwise(chance < 8)
    other = F.when(F.col("personal") == 1, chance >= 96).otherwise(chance >= 50)
    beside = F.when(mine, F.concat(telling, of([" ", ": ", " is "], "link"))).when(other, F.concat(of(MISLEADING.split("|"), "lead"), of([" ", ": ", " no. "], "link"))).otherwise("")
    # pieces are bounded by PIECES rows
    set_in = rows.join(F.broadcast(pieces(docs)), "number", "left")
    left = F.concat(F.coalesce("before", F.lit("")), F.when(pick("glued", 10) == 0, of(["=", "/", "x"], "glue")).otherwise(" "), beside)
    right = F.concat(of(["", ".", ",", " "], "stop"), F.lit(" "), F.coalesce("after", F.lit("")))
    start = F.length(left)
    return set_in.select(F.col("id").alias("doc_id"), F.concat(left, "shape", right).alias("text"), "kind", "personal", start.alias("from"), (start + F.length("shape")).alias("to"), "number")


def training_rows(docs: DataFrame, n: int = TRAIN_ROWS) -> DataFrame:
    """Candidates that the generators find at the planted spans, with their label: 1 if what
    was planted there is personal data of the candidate's kind.
    """
    texts = shared_table(planted(docs, n), "planted")
    found = located(candidates(texts).filter("generator is not null"))
    truth = texts.select("doc_id", F.col("kind").alias("planted"), "personal", "from", "to", "number")
    met = found.join(truth, "doc_id").filter("start < to and end > from")
    return met.withColumn("label", ((F.col("personal") == 1) & (F.col("kind") == F.col("planted"))).cast("double"))


def _tree(node: str, names: list[str]) -> Column:
    """A decision tree's debug string as an expression."""
    lines = [line.strip() for line in node.splitlines() if re.match(r"\s*(If|Else|Predict)", line)]

    def grow() -> Column:
        line = lines.pop(0)
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        feature, bound = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line).groups()
        low = grow()
        lines.pop(0)
        return F.when(F.col(names[int(feature)]) <= float(bound), low).otherwise(grow())

    return grow()


def held() -> Column:
    """Rows set into pieces of documents that the trees do not learn from."""
    return F.col("number") % 10 >= 7


def grown(rows: DataFrame, names: list[str]) -> Column:
    """The probability of boosted trees fitted on `rows` (label, features), as an expression."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    model = GBTClassifier(featuresCol="x", maxIter=16, maxDepth=5, stepSize=0.3, seed=7).fit(vectors)
    margin = reduce(lambda a, b: a + b, [_tree(t.toDebugString, names) * F.lit(w) for t, w in zip(model.trees, model.treeWeights)])
    return 1 / (1 + F.exp(-2 * margin))


def thresholds_for(judged: DataFrame, precision: float) -> DataFrame:
    """For each generator of `judged` (generator, label, p) the threshold (the lowest of 0.50,
    0.55, ... 0.95 that keeps `precision`), the precision and the recall there.
    """
    tried = judged.withColumn("threshold", F.explode(F.array(*[F.lit(x / 100) for x in range(50, 100, 5)])))
    taken = F.when(F.col("p") >= F.col("threshold"), F.col("label"))
    figures = tried.groupBy("generator", "threshold").agg(F.avg(taken).alias("precision"), (F.sum(taken) / F.sum("label")).alias("recall"))
    good = F.coalesce(F.col("precision"), F.lit(0)) >= precision
    best = Window.partitionBy("generator").orderBy(F.desc(good), F.when(good, F.col("threshold")).otherwise(-F.col("threshold")))
    return figures.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def fitted(docs: DataFrame, precision: float = PRECISION) -> tuple[Column, DataFrame]:
    """The trees' probability as an expression of the features; and for each generator the
    threshold, and the precision and recall that it was chosen by, on pieces held out.
    """
    rows, names = features(shared_table(training_rows(docs), "training"))
    rows = shared_table(rows.select("number", "generator", "label", *names), "features")
    chance = grown(rows.filter(~held()), names)
    judged = shared_table(rows.filter(held()).select("generator", "label", chance.alias("p")), "held-out")
    return chance, thresholds_for(judged, precision)


def judged_unseen(docs: DataFrame, folds: int = 3, precision: float = PRECISION, n: int = TRAIN_ROWS) -> DataFrame:
    """generator, found and personal (spans of personal data), and false and taken (spans
    selected), over shapes that the trees have not seen, as a check of the method.

    The shapes are dealt into folds; for each, trees and thresholds come from the other
    shapes alone (trees from pieces they learn from, thresholds from one part of those held
    out) and are judged on the fold's shapes in the other part.
    """
    rows, names = features(shared_table(training_rows(docs, n), "training"))
    shape = F.pmod(F.xxhash64("doc_id", F.lit("shape")), F.lit(SHAPES))  # as planted() chooses it
    rows = shared_table(rows.select("number", "generator", "label", shape.alias("shape"), *names), "features")
    found = None
    for fold in range(folds):
        seen = F.col("shape") % folds != fold
        chance = grown(rows.filter(~held() & seen), names)
        judged = rows.filter(held()).select("number", "generator", "label", seen.alias("seen"), chance.alias("p"))
        judged = shared_table(judged, "unseen")
        chosen = thresholds_for(judged.filter("seen and number % 10 < 9"), precision).select("generator", "threshold")
        mine = judged.filter("not seen and number % 10 = 9").join(F.broadcast(chosen), "generator", "left").withColumn("taken", F.coalesce(F.col("p") >= F.col("threshold"), F.lit(False)))
        found = mine if found is None else found.unionByName(mine)
    count = lambda p: F.count(F.when(p, 1))
    personal = F.col("label") == 1
    return found.groupBy("generator").agg(count(personal & F.col("taken")).alias("found"), count(personal).alias("personal"), count(~personal & F.col("taken")).alias("false"), count(F.col("taken")).alias("taken"))


def personal_data(docs: DataFrame) -> DataFrame:
    """row, doc_id and spans (array of kind, start, end, base, p; code points, end
    exclusive; by kind as listed, then start) of each row of `docs` (doc_id, text).

    Null and empty texts have no spans; repeated rows and null doc_ids are rows of their
    own, further columns are left alone, no rows give none. Matches of a base pattern that
    fail its check are candidates like the looser ones. A candidate beyond the base is
    dropped if it overlaps a base span of its kind.
    """
    chance, figures = fitted(docs)
    thresholds = {r.generator: r.threshold for r in figures.collect()}  # a row a generator
    found = candidates(docs)
    lines = located(found.filter("generator is not null"))
    is_base = F.col("generator").isin([g for g, v in GENERATORS.items() if v[1]])
    judged = features(lines)[0].withColumn("p", chance).withColumn("base", is_base & (F.col("f_valid") == 1))
    # written, so that no filter on the trees' result is taken below them as a copy of all trees and features
    judged = shared_table(judged.select("row", "generator", "kind", "start", "end", "base", "p"), "judged")
    bound = reduce(lambda c, g: c.when(F.col("generator") == g, thresholds.get(g, 1.0)), GENERATORS, F.when(F.lit(False), 1.0))
    judged = judged.filter(F.col("base") | (F.col("p") >= bound)).select("row", "kind", "start", "end", "base", "p")
    by = Window.partitionBy("row", "kind")
    running = (Window.unboundedPreceding, Window.currentRow)
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(by.orderBy("start", "end").rangeBetween(*running))
    starts = F.min(F.when(F.col("base"), F.col("start"))).over(by.orderBy(F.desc("start"), F.desc("end")).rangeBetween(*running))
    clear = judged.withColumn("__ends", ends).withColumn("__starts", starts)
    clear = clear.filter(F.expr("base or (coalesce(__ends, 0) <= start and coalesce(__starts, end) >= end)"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(order.alias("order"), "start", "end", "kind", "base", F.round("p", 6).alias("p"))
    spans = clear.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    fields = "array<struct<order:bigint,start:bigint,end:bigint,kind:string,base:boolean,p:double>>"
    return rows.join(spans, "row", "left").select("row", "doc_id", F.coalesce("spans", F.array().cast(fields)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans."""
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(text(base), "UTF-8"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
