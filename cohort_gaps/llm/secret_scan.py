"""Secret scan: candidates by pattern, false positives removed by a random forest, in DataFrame expressions only.

A candidate is a run of 16 or more letters, digits and ``+/_-``, or six or more characters other than blanks and quotes that
are assigned to a credential's name, such as a short password with signs in it. What tells a key from a long word, a number or a path is
its length, its character transitions, how much of it a dictionary covers, signs of a path around it, and the words next
to it. The forest is trained from labelled findings; without given ones, candidates of known shape serve as such.
"""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

RUN = r"[A-Za-z0-9+/_-]{16,}"
# Names of credentials, and a value assigned to one; the first look behind spares most places the long one.
CREDENTIAL = r"(?i:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private)"
ASSIGNED = (r"""(?<=[=: "'])(?<=[=:][ \t]{0,3}["']?)(?<=""" + CREDENTIAL + r"""["']?[ \t]{0,3}[=:][ \t]{0,3}["']?)"""
            r"""[^\s"'`<>,;]{5,}[^\s"'`<>,;.:)]""")
CANDIDATE = f"{ASSIGNED}|{RUN}"
# Characters of context read on the left and on the right of a candidate.
LEFT, RIGHT = 40, 16
MARK = "[secret]"
# Labelled findings of either label to train on, at most; drawn by a hash of the candidate.
MOST_FINDINGS = 10_000
TREES, DEPTH, SEED = 20, 6, 42

# Words and parts of words that ordinary long words are made of; a parameter of ``candidates``.
DICTIONARY = ("the", "and", "ing", "tion", "ment", "able", "ness", "that", "with", "from", "this", "have", "ous", "ion",
              "der", "die", "und", "sch", "ung", "keit", "heit", "lich", "ein", "ver", "les", "des", "que", "eau", "elle",
              "aux", "est", "pour", "dans", "los", "las", "con", "para", "mente", "ado", "ido", "ante", "path", "file",
              "name", "test", "data", "user", "http", "www", "com", "org", "index", "html", "image", "static")
NEAR_SECRET = r"(?i)(password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private)"
NEAR_OTHER = r"(?i)(sha\d*|commit|uuid|checksum|md5|digest|isbn|card|phone|order|invoice)"

FEATURES = ["n_chars", "digits", "capitals", "hexadecimal", "different", "changes", "vowel_changes", "covered", "in_path",
            "secret_word", "other_word", "assigned", "quoted"]


def _without(text: str, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def candidates(docs: DataFrame, dictionary: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """``(doc_id, place, candidate, before, after)`` with the FEATURES of every candidate of the whole texts.

    ``place`` numbers the candidates of a text. Contexts stop at the neighbouring candidate. A null or empty text has
    none; very long texts are read whole; rows without a ``doc_id`` are scanned like others.
    """
    found = pieces_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "found", "pieces")
    return _with_features(found.select("doc_id", "pieces"), dictionary)


def pieces_of(docs: DataFrame, found: str, pieces: str) -> DataFrame:
    """``docs`` with the candidates of each text as ``found`` and, with their contexts, as ``pieces``; null without any."""
    own = docs.withColumn(found, F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1)))
    # An array of one binds the gaps, so that a text is split once.
    listed = F.transform(F.array(F.split("text", CANDIDATE, -1)), lambda gaps: F.transform(found, lambda c, i: F.struct(
        c.alias("candidate"), F.right(F.get(gaps, i), F.lit(LEFT)).alias("before"),
        F.left(F.get(gaps, i + 1), F.lit(RIGHT)).alias("after"))))
    return own.withColumn(pieces, F.when(F.size(found) > 0, F.get(listed, F.lit(0))))


def _with_features(found: DataFrame, dictionary: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """One row per candidate of ``(doc_id, pieces)``, with its FEATURES."""
    listed = found.select("doc_id", F.posexplode("pieces").alias("place", "c")).select("doc_id", "place", "c.*")

    n = F.length("candidate").cast("double")
    lower = F.lower("candidate")
    kinds = F.translate(F.translate("candidate", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                                    "a" * 26 + "A" * 26 + "0" * 10), "+/_-", "----")
    vowels = F.translate(lower, "aeiouybcdfghjklmnpqrstvwxz", "v" * 6 + "c" * 20)
    changes = (lambda c: (F.length(F.regexp_replace(c, r"(.)\1+", "$1")) - 1) / n)
    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    return listed.select(
        "*", n.alias("n_chars"),
        (1 - _without("candidate", "0123456789") / n).alias("digits"),
        (1 - _without("candidate", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n).alias("capitals"),
        (1 - _without("candidate", "0123456789abcdef") / n).alias("hexadecimal"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / F.least(n, F.lit(40.0))).alias("different"),
        changes(kinds).alias("changes"), changes(vowels).alias("vowel_changes"),
        (1 - F.length(F.regexp_replace(lower, words, "")) / n).alias("covered"),
        (F.col("candidate").contains("/").cast("double")
         + F.col("before").rlike(r"(://|[./\\])[^\s]*$").cast("double")
         + F.col("after").rlike(r"^(\.[a-z]|/)").cast("double")).alias("in_path"),
        F.col("before").rlike(NEAR_SECRET).cast("double").alias("secret_word"),
        F.col("before").rlike(NEAR_OTHER).cast("double").alias("other_word"),
        F.col("before").rlike(r"""[=:]\s*["']?$""").cast("double").alias("assigned"),
        F.col("before").rlike(r"""["'`]$""").cast("double").alias("quoted"))


def label_known(found: DataFrame) -> DataFrame:
    """Findings with ``label`` 1 for keys of a published shape or assigned to a credential's name, 0 for plain words,
    plain numbers and paths; candidates that are none of these have no label and are left out."""
    c = F.col("candidate")
    secret = (c.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$") | c.rlike("^(ghp|gho|ghs)_[A-Za-z0-9]{36}$")
              | (F.col("before").rlike(NEAR_SECRET.replace("(?i)", "(?i).*") + r"""\W{1,5}$""") & (F.col("assigned") == 1)
                 & c.rlike("[0-9]") & c.rlike("[A-Za-z]")))
    plain = c.rlike("^[A-Za-z][a-z]+$") | c.rlike("^[A-Z]+$") | c.rlike("^[0-9]+$") | (F.col("in_path") > 1)
    return found.withColumn("label", F.when(secret, 1.0).when(plain, 0.0)).filter(F.col("label").isNotNull())


def train(findings: DataFrame, most: int = MOST_FINDINGS) -> PipelineModel | None:
    """A forest from findings with FEATURES and ``label`` 0 or 1; None if either label is missing.

    About ``most`` findings of each label at most are used, drawn by a hash of the candidate; they are read in a fixed
    order, so the same findings give the same forest.
    """
    sizes = {r["label"]: r["n"] for r in findings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (sizes.get(0.0) and sizes.get(1.0)):
        return None
    draw = F.pmod(F.xxhash64("candidate", "doc_id", "place"), F.lit(1 << 30))
    rows = [findings.filter((F.col("label") == y) & (draw < int((1 << 30) * min(1.0, most / sizes[y])))) for y in (0.0, 1.0)]
    drawn = rows[0].unionByName(rows[1]).select("label", *FEATURES)
    drawn = cut_lineage(drawn.repartition(1).sortWithinPartitions("label", *FEATURES))  # bounded by 2 * most rows
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(drawn)


def findings(docs: DataFrame, labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``(doc_id, place, secret, before, score)``: the candidates that the forest takes for secrets.

    ``labelled`` holds findings with FEATURES and ``label``; without it the candidates of known shape are used. If it
    lacks one of the labels there is nothing to learn from, and the candidates of known shape are the result.
    """
    return _judged(candidates(docs), labelled, least)


def _judged(listed: DataFrame, labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    found = cut_lineage(listed)
    known = label_known(found)
    model = train(known if labelled is None else labelled)
    if model is None:
        scored = known.select("doc_id", "place", "candidate", "before", F.col("label").alias("score"))
    else:
        scored = model.transform(found).select("doc_id", "place", "candidate", "before",
                                               F.get(vector_to_array("probability"), 1).alias("score"))
    return scored.filter(F.col("score") >= least).select("doc_id", "place", F.col("candidate").alias("secret"), "before",
                                                         "score")


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret replaced by MARK, the longest first; no row goes. Rows without an id are known by a hash
    of their text instead. Texts are written once beside their candidates: those without any pass as they are, and only the
    others are sent about."""
    # Names that no column of the caller has.
    secrets, key, found, pieces = (f"{name}_{len(''.join(docs.columns))}" for name in ("_secrets", "_row", "_found", "_pieces"))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    keyed = cut_lineage(pieces_of(keyed, found, pieces).drop(found))
    asked, free = keyed.filter(F.col(pieces).isNotNull()), keyed.filter(F.col(pieces).isNull())
    listed = _with_features(asked.select(F.col(key).alias("doc_id"), F.col(pieces).alias("pieces")))
    per_row = _judged(listed, labelled).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("secret").alias(secrets))
    longest_first = F.array_sort(secrets, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(
        F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    clean = F.aggregate(longest_first, F.col("text"), lambda t, s: F.replace(t, s, F.lit(MARK)))
    joined = asked.join(per_row, key, "left")
    redacted = joined.withColumn("text", F.when(F.col(secrets).isNull(), F.col("text")).otherwise(clean))
    return redacted.select(*docs.columns).unionByName(free.select(*docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """The result of ``op2_secret_scan``."""
    return findings(docs)
