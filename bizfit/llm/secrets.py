"""Secret scanning: a random forest drops false positives among candidates.

Candidates are runs of MIN_LENGTH or more characters of keys and tokens
([A-Za-z0-9_+/=-]) that hold a digit or change case, and values of any length and
characters assigned to a credential's name (up to the closing quote, or to a blank,
quote, comma or semicolon), and private key blocks of any number of lines, found in whole texts by regular expressions. The words
before a candidate are those of the text, other candidates included. Features: length; letters, digits and others; changes between
character classes per character; distinct characters; the share of hex digits;
dictionary coverage, the share of characters within pieces that are words of the
corpus's own dictionary; whether the row's path names tests, samples or lock files;
and whether the words before it speak of keys and passwords, or of hashes, versions
and the like.

The forest is trained on labelled findings. A table of them can be given; else
findings are labelled by rules with high precision (known key formats and direct
assignments to a credential's name are real; plain words, numbers, paths and
digests after hash words are not), in a bounded sample: at most SAMPLE findings
of each label, those with the smallest hashes. The sample's bound is there for the
training only; all findings are scored.

Only DataFrame operations and the ML library's forest are used. The dictionary is
the DICTIONARY most frequent lower-case words; its bound makes it fit a broadcast.

Nulls: a null text has no candidates; a null source is an empty path; null ids are
carried along. Repeated rows are scanned each. An empty table, or one without both
labels, gives the rules' verdicts. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizfit.llm.common import join_groups
from bizfit.operators.shared import cut

MIN_LENGTH = 16
SAMPLE = 5_000
DICTIONARY = 20_000
TREES = 30
DEPTH = 6
CUTOFF = 0.5

BEFORE = 24
#: A whole run of key characters, with a digit or a change to upper case in it.
RUN = r"(?=[A-Za-z0-9_+/=-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9_+/=-]{16,}"
#: Group 1 is the text before, group 2 the run; the lookbehind matches at one length only.
CANDIDATE = rf"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/=-]{{16}})(?<=(^[\s\S]{{0,{BEFORE - 1}}}|[\s\S]{{{BEFORE}}}))({RUN})"
#: Names that introduce a credential, and words that introduce something harmless.
NAME = r"(?:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential)s?(?:[_-]?(?:value|key))?"
CREDENTIAL = rf"(?i){NAME}[\"']?\s*[=:]?>?\s*[\"']?$"
#: Group 1 is a credential's name with the sign of assignment, group 2 the value, which isn't consumed.
ASSIGNED = rf"((?i:{NAME})[\"']?\s*+[=:]>?\s*+[\"']?)(?=((?<=\")[^\"\n]++(?=\")|(?<=')[^'\n]++(?=')|[^\s\"',;]++))"
HARMLESS = r"(?i)(sha(1|256|512)?|md5|commit|checksum|digest|hash|version|uuid|guid|etag|revision|integrity)[\"']?\s*[=:]?\s*[\"']?$"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+-----END [A-Z ]*PRIVATE KEY-----"
FORMATS = r"^(-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{10,})$"
PATHS = r"(?i)(^|[/_.\-])(test|tests|spec|sample|samples|example|examples|mock|fixture|fixtures|lock|min)([/_.\-]|$)"
FEATURES = ["length", "upper", "lower", "digit", "other", "changes", "distinct", "hex", "dictionary", "path_test", "near_credential", "near_harmless", "assigned"]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, path, before (up to BEFORE characters of text), candidate, for each candidate of each row, repeats included.

    What stands before is looked up only in texts that have a candidate.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    all_of = lambda pattern, k: F.regexp_extract_all("body", F.lit(pattern), F.lit(k))

    def each(pattern: str) -> DataFrame:
        found = rows.withColumn("hits", all_of(pattern, 2)).filter(F.size("hits") > 0)
        return found.select("doc_id", "path", F.explode(F.arrays_zip(all_of(pattern, 1).alias("before"), F.col("hits").alias("hit"))).alias("x"))

    # a name and its value may be one run, as in password=abc
    name = F.regexp_extract("x.hit", "^([A-Za-z_-]+=)(?=[^=])", 1)
    before = F.concat(F.col("x.before"), name).alias("before")
    runs = each(CANDIDATE).select("doc_id", "path", before, F.col("x.hit").substr(F.char_length(name) + 1, F.char_length("x.hit")).alias("candidate"))
    runs = runs.filter(F.char_length("candidate") >= MIN_LENGTH)
    # values that are such runs are found above
    values = each(ASSIGNED).select("doc_id", "path", F.col("x.before").alias("before"), F.col("x.hit").alias("candidate")).filter(~F.col("candidate").rlike(f"^{RUN}$"))
    blocks = rows.filter(F.contains("body", F.lit("PRIVATE KEY-----"))).select("doc_id", "path", F.lit("").alias("before"), F.explode(all_of(PRIVATE_KEY, 0)).alias("candidate"))
    return runs.unionByName(values).unionByName(blocks)


def dictionary(docs: DataFrame, text: str = "text", words: int = DICTIONARY) -> DataFrame:
    """The most frequent words of 3 to 12 lower-case letters, one row each."""
    split = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), " "))
    counted = docs.select(split.alias("word")).filter(F.col("word").rlike("^[a-z]{3,12}$")).groupBy("word").count()
    return counted.orderBy(F.desc("count"), "word").limit(words).select("word")


def _share(pattern: str) -> Column:
    return F.char_length(F.regexp_replace("candidate", pattern, "")) / F.col("length")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds FEATURES to candidates. ``words`` must be of bounded size; it is broadcast."""
    out = found.withColumn("length", F.char_length("candidate"))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "0"), "[^Ul0]", "-")
    squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(kinds, "U+", "U"), "l+", "l"), "0+", "0"), "-+", "-")
    out = out.select(
        "*", _share("[^A-Z]").alias("upper"), _share("[^a-z]").alias("lower"), _share("[^0-9]").alias("digit"), _share("[A-Za-z0-9]").alias("other"),
        ((F.char_length(squeezed) - 1) / F.col("length")).alias("changes"), (F.size(F.array_distinct(F.split("candidate", ""))) / F.col("length")).alias("distinct"),
        _share("[^0-9a-fA-F]").alias("hex"), F.col("path").rlike(PATHS).cast("double").alias("path_test"),
        F.col("before").rlike(CREDENTIAL).cast("double").alias("near_credential"), F.col("before").rlike(HARMLESS).cast("double").alias("near_harmless"),
        F.col("before").rlike("[=:]>?\\s*[\"']?$").cast("double").alias("assigned"),
    )
    runs = F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("candidate"), F.lit("([a-z]{3,12})"), F.lit(1))))
    distinct = out.groupBy("candidate", "length").agg(F.count("*").alias("times"))
    covered = distinct.select("candidate", "length", "times", runs.alias("word")).join(F.broadcast(words.withColumn("is_word", F.lit(1))), "word", "left")
    share = covered.groupBy("candidate").agg(
        (F.sum(F.when(F.col("is_word") == 1, F.char_length("word")).otherwise(0)) / F.max("length")).alias("dictionary"), F.max("times").alias("times")
    )
    return join_groups(out, cut(share, "secret-shares"), ["candidate"], "times", found.count()).drop("times")


def rules(found: DataFrame) -> DataFrame:
    """Adds rule: 1.0 for a real secret, 0.0 for a harmless string, null where the rules can't tell."""
    real = F.col("candidate").rlike(FORMATS) | (F.col("near_credential") > 0) & (F.col("digit") > 0)
    harmless = (F.col("near_harmless") > 0) | (F.col("digit") == 0) | (F.col("dictionary") >= 0.5) | (F.col("digit") == 1) | (F.col("distinct") <= 0.2)
    return found.withColumn("rule", F.when(harmless & ~F.col("candidate").rlike(FORMATS), 0.0).when(real, 1.0))


def scan(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, candidate, n (times in the row), probability, is_secret for each distinct candidate of each row.

    ``labelled``, if given, has FEATURES and rule (1.0 real, 0.0 not); it is sampled like the findings here.
    """
    written = cut(candidates(docs, doc_id, text, path), "secret-candidates")  # texts are read once for them
    found = cut(features(written, dictionary(docs, text)), "secret-findings")
    found = rules(found)
    ranked = (found if labelled is None else labelled).filter("rule IS NOT NULL").withColumn("mark", F.xxhash64(*FEATURES, "rule"))
    sample = [ranked.filter(F.col("rule") == y).orderBy("mark").limit(SAMPLE).select(*FEATURES, "rule") for y in (0.0, 1.0)]
    sample = cut(sample[0].unionByName(sample[1]), "secret-sample")
    if sample.select("rule").distinct().count() == 2:
        gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(labelCol="rule", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=11).fit(gather.transform(sample).select("features", "rule"))
        scored = forest.transform(gather.transform(found)).withColumn("probability", vector_to_array("probability")[1])
    else:
        scored = found.withColumn("probability", F.coalesce("rule", F.lit(0.0)))
    out = scored.groupBy("doc_id", "candidate").agg(F.count("*").alias("n"), F.max("probability").alias("probability"))
    return out.withColumn("is_secret", F.col("probability") >= CUTOFF)
