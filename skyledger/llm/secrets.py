"""Secret scans with a random forest that removes false findings. DataFrame functions and Spark ML only.

Scan: every run of `MIN_LENGTH` or more key characters in a word is a candidate, with its place in the word and the
neighbouring words; after an assignment to a hinting name `SHORT_LENGTH` characters are enough. Features: length, shares of character classes, changes of class between neighbouring
characters, coverage by a dictionary of letter pairs counted over all candidates of the corpus, hints in the
neighbouring words and in the path. A random forest trained from labelled findings scores every candidate.

Training reads a bounded number of labelled findings per class (`max_findings`, chosen by hash); scanning and
the dictionary cover all rows. Without labelled findings of both classes a candidate keeps its label, or counts
as no secret where it has none. Null texts have no candidates; repeated rows give repeated findings; a null id
or path stays null. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.line_rules import words_of
from skyledger.session import materialize

MIN_LENGTH = 16
SHORT_LENGTH = 8
KEY = r"[A-Za-z0-9+/_\-]"
RUN, SHORT_RUN = KEY + "{%d,}" % MIN_LENGTH, KEY + "{%d,}" % SHORT_LENGTH
HINT = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|auth|bearer|credential|private)"
#: An assignment to a hinting name, up to where the value begins.
NAMED = HINT + r"[A-Za-z0-9_\-]*[\"'`]*\s*[=:]+\s*[\"'`]*"
TAME_PATH = r"(?i)(test|example|sample|fixture|doc)"
#: Published formats of access keys, and assignments of long hexadecimal values to a hinting name.
FORMATS = (r"^AKIA[0-9A-Z]{16}$", r"^ASIA[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}$", r"^xox[abprs]-[A-Za-z0-9\-]{10,}$", r"^AIza[0-9A-Za-z_\-]{35}$", r"^sk_live_[0-9A-Za-z]{24,}$")
DICTIONARY_SHARE = 0.0005
MASK = "[SECRET]"
WORD = r"[^\x20\x09-\x0D]+"
FEATURES = ("length", "digit_share", "upper_share", "lower_share", "sign_share", "changes", "hex_share", "covered", "hint_before", "hint_inside", "assigned", "quoted", "word_rest", "tame_path")


def may_hold(text_col: str) -> Column:
    """Could the text hold a candidate at all? Null counts as no."""
    return F.coalesce(F.col(text_col).rlike(RUN) | F.col(text_col).rlike(NAMED + SHORT_RUN), F.lit(False))


def candidates(docs: DataFrame, id_col: str = "doc_id", path_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, path, text_hash, place, word, before, before2, after, offset, left, candidate), a row per run.

    `place` numbers the words of a text and `offset` the characters of a word from 0. `left` is what stands before
    the candidate in its own field of the word: after the last of , ; & ? and brackets.
    """
    rows = docs.filter(may_hold(text_col)).select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    found = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda x: (F.length(x.word) >= SHORT_LENGTH) & (
        x.word.rlike(RUN) | (x.word.rlike(SHORT_RUN) & F.concat_ws(" ", F.get("words", x.place - 2), F.get("words", x.place - 1), x.word).rlike(NAMED + SHORT_RUN))))
    around = F.transform(found, lambda x: F.struct(x.place.alias("place"), x.word.alias("word"), F.get("words", x.place - 1).alias("before"), F.get("words", x.place - 2).alias("before2"), F.get("words", x.place + 1).alias("after")))
    rows = rows.select("doc_id", "path", "text_hash", F.explode(around).alias("x")).select("doc_id", "path", "text_hash", "x.*")
    rows = rows.withColumn("runs", F.regexp_extract_all("word", F.lit(SHORT_RUN), F.lit(0))).withColumn("gaps", F.split("word", SHORT_RUN))
    # the runs and the gaps before them, in turn, make up the word
    offset = F.length(F.array_join(F.slice("gaps", 1, F.col("k") + 1), "")) + F.length(F.array_join(F.slice("runs", 1, F.col("k")), ""))
    rows = rows.select("*", F.posexplode("runs").alias("k", "candidate")).withColumn("offset", offset)
    prefix = F.substring("word", F.lit(1), F.col("offset"))
    rows = rows.withColumn("left", F.substring_index(F.translate(prefix, ";&?{}()[]", "," * 9), ",", -1))
    named = F.concat_ws(" ", "before2", "before", "left").rlike(NAMED + "$")
    return rows.filter((F.length("candidate") >= MIN_LENGTH) | named).drop("runs", "gaps", "k")


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def pair_dictionary(found: DataFrame, share: float = DICTIONARY_SHARE) -> list[bool]:
    """For each of the 676 letter pairs aa, ab … zz: does it make up at least `share` of all pairs?

    Counted over all candidates without digits, which are mostly words of a language. At most 676 counts, a
    constant, reach the driver.
    """
    plain = found.filter(~F.col("candidate").rlike("[0-9]")).select(F.lower("candidate").alias("w"))
    pairs = plain.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("pair"))
    counts = {r.pair: r.n for r in pairs.filter(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [counts.get(a + b, 0) > 0 and counts[a + b] >= share * total for a in letters for b in letters]


def featured(found: DataFrame, dictionary: list[bool]) -> DataFrame:
    """Add FEATURES and `rule_label` to candidates."""
    c, n = F.col("candidate"), F.length("candidate")
    low = F.lower(c)
    listed = F.array(*map(F.lit, dictionary))

    def in_dictionary(i: Column) -> Column:
        a, b = F.ascii(F.substring(low, i, F.lit(1))) - 97, F.ascii(F.substring(low, i + 1, F.lit(1))) - 97
        return (a >= 0) & (b >= 0) & F.get(listed, a * 26 + b)

    covered = F.size(F.filter(F.sequence(F.lit(1), n - 1), in_dictionary)) / (n - 1)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    near = F.concat_ws(" ", F.coalesce("before2", F.lit("")), F.coalesce("before", F.lit("")))
    rows = found.select(
        "*", n.cast("double").alias("length"), (_count(c, "[0-9]") / n).alias("digit_share"), (_count(c, "[A-Z]") / n).alias("upper_share"),
        (_count(c, "[a-z]") / n).alias("lower_share"), (_count(c, r"[+/_\-]") / n).alias("sign_share"), ((runs - 1) / n).alias("changes"),
        (_count(c, "[0-9a-f]") / n).alias("hex_share"), covered.cast("double").alias("covered"),
        near.rlike(HINT).cast("double").alias("hint_before"), F.col("left").rlike(HINT).cast("double").alias("hint_inside"),
        (F.coalesce("before", F.lit("")).rlike("[=:]$") | F.col("left").rlike("[=:]")).cast("double").alias("assigned"),
        F.col("word").rlike("[\"'`]").cast("double").alias("quoted"), ((F.length("word") - n) / F.length("word")).alias("word_rest"),
        F.coalesce(F.col("path"), F.lit("")).rlike(TAME_PATH).cast("double").alias("tame_path"))
    return rows.withColumn("rule_label", rule_label())


def rule_label() -> Column:
    """The labelling rules of a scanner: 1 for a published format or an assigned hexadecimal value, 0 for letters that read as words, else null."""
    known = F.lit(False)
    for pattern in FORMATS:
        known = known | F.col("candidate").rlike(pattern)
    hexed = (F.col("hex_share") == 1) & (F.col("digit_share") > 0.1) & ((F.col("hint_before") + F.col("hint_inside")) > 0) & (F.col("assigned") > 0)
    return F.when(known | hexed, 1.0).when((F.col("digit_share") == 0) & (F.col("covered") >= 0.8), 0.0)


def train(rows: DataFrame, label_col: str = "rule_label", max_findings: int = 10_000, trees: int = 20, depth: int = 6, seed: int = 7):
    """A forest from at most `max_findings` labelled findings per class, or None where a class is missing."""
    labelled = rows.filter(F.col(label_col).isNotNull()).select(*FEATURES, F.col(label_col).cast("double").alias("label"), "candidate", "doc_id", "place")
    order = (F.xxhash64("candidate"), F.col("candidate"), F.col("doc_id"), F.col("place"), *map(F.col, FEATURES))
    sample = labelled.filter("label = 1").orderBy(*order).limit(max_findings).unionByName(labelled.filter("label = 0").orderBy(*order).limit(max_findings))
    sample = materialize(sample.select(*FEATURES, "label"), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(assembled)


def score(rows: DataFrame, forest) -> DataFrame:
    """Add score and is_secret."""
    if forest is None:
        scored = rows.withColumn("score", F.coalesce("rule_label", F.lit(0.0)))
    else:
        kept = rows.columns
        scored = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)).select(*kept, F.round(vector_to_array("probability")[1], 6).alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", path_col: str = "source", text_col: str = "text") -> DataFrame:
    """All candidates of all documents with score and verdict.

    labelled: findings with FEATURES, candidate, doc_id, place and `rule_label` by a reviewer; by default the
    corpus's own candidates labelled by `rule_label`.
    """
    found = materialize(candidates(docs, id_col, path_col, text_col), "candidates")
    rows = featured(found, pair_dictionary(found))
    forest = train(rows if labelled is None else labelled)
    return score(rows, forest).select("doc_id", "path", "text_hash", "place", "offset", "word", "candidate", "before", "after", "covered", "rule_label", "score", "is_secret")


def mask(docs: DataFrame, secrets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every found secret replaced by MASK at its own place; all other text stays as it is.

    Findings meet the text they were found in by id and text hash, so rows with a null or repeated id keep apart.
    Only texts that may hold a candidate are moved for that. Repeated rows are masked alike.
    """
    key = ["doc_id", "text_hash"]
    hits = secrets.select(*key, "place", "word", "offset", F.length("candidate").alias("n")).distinct()
    at = F.array_sort(F.collect_list(F.struct((-F.col("offset")).alias("back"), "n")))  # the last one in the word first
    cut = F.aggregate("at", F.col("word"), lambda w, x: F.concat(F.substring(w, F.lit(1), -x["back"]), F.lit(MASK), F.substring(w, x["n"] - x["back"] + 1, F.length(w))))
    words = hits.groupBy(*key, "place", "word").agg(at.alias("at")).select(*key, "place", cut.alias("masked"))
    listed = words.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "masked"))).alias("__found")).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("__found.place").alias("__places"), F.col("__found.masked").alias("__masked"))
    able = docs.filter(may_hold(text_col))
    rows = able.join(listed, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left")
    own, gaps = words_of(F.col(text_col)), F.split(text_col, WORD)
    # text = gap, word, gap … word, gap
    parts = F.zip_with(gaps, F.transform(own, lambda w, i: F.coalesce(F.get("__masked", F.array_position("__places", i).cast("int") - 1), w)),
                       lambda gap, w: F.concat(gap, F.coalesce(w, F.lit(""))))
    text = F.when(F.col("__places").isNull(), F.col(text_col)).otherwise(F.array_join(parts, ""))
    return rows.withColumn(text_col, text).select(docs.columns).unionByName(docs.filter(~may_hold(text_col)))
