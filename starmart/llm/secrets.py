"""Secret scan: candidate strings, judged by a random forest that removes false positives.

Only DataFrame expressions and Spark's own forest are used; no Python runs on the executors.

Candidates are found by pattern and by context. By pattern: runs of at least ``LEAST`` characters of
``[A-Za-z0-9_+/-]``, with up to nine such runs joined by dots and up to two ``=`` at the end, that hold a digit or
change from lower to upper case twice. By context: whatever is assigned to a name with a secret's word in it, up to the
closing quote or the next blank, of any length and any characters. Each is found together with up to
``NEAR`` characters before and after.

The forest judges them by length, kinds of characters and their transitions, entropy,
the share that words of a dictionary cover, signs of a path or address inside and beside, and
neighbouring words. It learns from labelled findings ``(before, candidate, after, label)``: those of the
caller, at most ``MAX_LABELLED`` distinct ones of each label (those with the lowest hash), or the
``examples`` made from templates. Should only one label occur, every candidate is judged by it; without
labelled findings none is a secret. A probability of one half counts as a secret.

Each candidate of a text is one row, equal ones included, at its place in the text.
Null and empty texts have none. A text of any length is scanned as a whole. Rows that repeat are scanned each; a null id
is kept. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm.sample import lowest
from starmart.llm.secret_examples import examples
from starmart.llm.store import keep, prepare

LEAST = 16
NEAR = 40
MAX_LABELLED = 4_000
TREES, DEPTH = 40, 8
MARK = "[SECRET]"

_SECRET_WORDS = (
    "token|secret|passwd|password|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?![a-z])|authorization|credential|bearer"
)
_HARMLESS_WORDS = "sha1|sha256|md5|checksum|digest|commit|revision|uuid|guid|example|sample|placeholder|dummy|test"
_PLACEHOLDERS = r"(?i)example|sample|your|changeme|placeholder|dummy|todo|xxxx|\*\*\*|^[<$\[{]|^(true|false|none|null|nil|no|yes)$"
_ISSUERS = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|sk_live_|sk-|AIza|eyJ)"

# No group of these patterns repeats without bound, as each turn would take stack.
_NAME = r"A-Za-z0-9_.\-"
_ASSIGNED = (
    rf"(?<![{_NAME}])[{_NAME}]{{0,40}}(?i:{_SECRET_WORDS})[A-Za-z0-9_]{{0,20}}[\"'`]?[ \t]{{0,3}}(?:=>|:=|[=:]{{1,2}})[ \t]{{0,3}}"
    r"(?:(?i:bearer|basic)[ \t]{1,3})?"
)
_VALUE = r"(?:\"[^\"\n]+(?=\")|'[^'\n]+(?=')|`[^`\n]+(?=`)|[^\s\"'`,;]+)"
_RUN = (
    rf"(?<![A-Za-z0-9_+/=\-])[A-Za-z0-9_+/\-]{{{LEAST},}}(?:\.[A-Za-z0-9_\-]{{{LEAST},}}){{0,8}}={{0,2}}"
)
_MATCH = rf"{_ASSIGNED}{_VALUE}|{_RUN}"
#: What belongs to the context at the beginning of a match.
_LEAD = rf"^{_ASSIGNED}[\"'`]?"

FEATURES = [
    "length", "digits", "upper", "lower", "symbols", "hexadecimal", "entropy", "to_upper", "to_lower", "to_digit", "from_digit",
    "vowel_turns", "hard_runs", "distinct", "dictionary", "only_digits", "uuid", "placeholder", "call", "path_before", "path_inside",
    "dots_beside", "assigned", "quoted", "secret_word", "harmless_word", "issuer",
]


def dictionary_of(path: str, least: int = 4) -> list[str]:
    """Words of a public tokenizer's vocabulary file, at most as many as it has entries."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ends = (key.removesuffix("</w>") for key in vocabulary if key.endswith("</w>"))
    return sorted({word for word in ends if re.fullmatch(rf"[a-z]{{{least},}}", word)})


def _cut(text: Column) -> tuple[Column, Column]:
    """Matches of a text, and the pieces around them: one more, and they alternate."""
    return F.split(text, _MATCH, -1), F.regexp_extract_all(text, F.lit(_MATCH), F.lit(0))


def find_candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, nth, start, before, candidate, after)``: place in characters, from 1.

    ``nth`` counts the matches of a text, from 0, those that are no candidates included.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).filter(
        F.col("text").rlike(_MATCH)
    )
    pieces, found = _cut(F.col("text"))
    laid = texts.select("doc_id", pieces.alias("pieces"), found.alias("found"))
    rows = laid.select(
        "doc_id",
        F.posexplode(
            F.arrays_zip(
                F.slice("pieces", 1, F.size("found")).alias("p"), F.col("found").alias("m"),
                F.slice("pieces", 2, F.size("found")).alias("n"), _starts().alias("s"),
            )
        ).alias("nth", "x"),
    )
    lead = F.regexp_extract("x.m", _LEAD, 0)
    candidate = F.expr("substring(x.m, length(lead) + 1)")
    held = rows.withColumn("lead", lead).withColumn("candidate", candidate).filter(
        "candidate <> '' AND (lead <> '' OR candidate RLIKE '[0-9]|[a-z][A-Z].*[a-z][A-Z]')"
    )
    return held.select(
        "doc_id", "nth", (F.col("x.s") + F.length("lead")).alias("start"),
        F.right(F.concat("x.p", "lead"), F.lit(NEAR)).alias("before"), "candidate", F.left("x.n", F.lit(NEAR)).alias("after"),
    )


def _starts() -> Column:
    """Where each match starts: running sums of the lengths before it.

    The array grows by one entry a match and is copied each time, in runs of a thousand, which are
    then put together.
    """
    lengths = F.zip_with(
        F.slice("pieces", 1, F.size("found")), "found", lambda p, c: F.struct(F.length(p).alias("p"), F.length(c).alias("c"))
    )
    none = F.array().cast("array<int>")
    state = F.struct(F.lit(1).alias("at"), none.alias("some"), F.array().cast("array<array<int>>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        full = F.size(s["some"]) >= 1000
        here = F.array(s["at"] + x["p"])
        return F.struct(
            (s["at"] + x["p"] + x["c"]).alias("at"),
            F.when(full, here).otherwise(F.concat(s["some"], here)).alias("some"),
            F.when(full, F.concat(s["all"], F.array(s["some"]))).otherwise(s["all"]).alias("all"),
        )

    return F.aggregate(lengths, state, step, lambda s: F.concat(F.flatten(s["all"]), s["some"]))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character of its first 4,096 distinct letters' shares."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c)))
    )


def _covered(found: DataFrame, dictionary: Collection[str]) -> DataFrame:
    """``found(finding, candidate)`` with the share of each candidate that words of the dictionary cover."""
    words = found.sparkSession.createDataFrame(pa.table({"word": pa.array(list(dictionary), pa.string())}))
    parts = found.select("finding", F.explode(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0))).alias("part"))
    # The dictionary is that of the caller and bounded by what the driver was given.
    known = parts.withColumn("word", F.lower("part")).join(F.broadcast(words), "word", "left_semi")
    covered = known.groupBy("finding").agg(F.sum(F.length("word")).alias("letters"))
    return found.join(covered, "finding", "left").withColumn(
        "dictionary", F.coalesce("letters", F.lit(0)) / F.length("candidate")
    ).drop("letters")


def with_features(found: DataFrame, dictionary: Collection[str] = ()) -> DataFrame:
    """Findings ``(finding, before, candidate, after)`` with ``FEATURES``."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(c).cast("double")
    near = F.lower(before)
    flag = lambda test: test.cast("double")
    return _covered(found, dictionary).withColumns(
        {
            "length": F.log1p(n),
            "digits": _count(c, "[0-9]") / n,
            "upper": _count(c, "[A-Z]") / n,
            "lower": _count(c, "[a-z]") / n,
            "symbols": _count(c, r"[^A-Za-z0-9]") / n,
            "hexadecimal": _count(c, "[0-9a-fA-F]") / n,
            "entropy": _entropy(c),
            "to_upper": _count(c, "[a-z](?=[A-Z])") / n,
            "to_lower": _count(c, "[A-Z](?=[a-z])") / n,
            "to_digit": _count(c, "[A-Za-z](?=[0-9])") / n,
            "from_digit": _count(c, "[0-9](?=[A-Za-z])") / n,
            "vowel_turns": _count(F.lower(c), "[b-df-hj-np-tv-z](?=[aeiou])") / n,
            "hard_runs": _count(F.lower(c), "[b-df-hj-np-tv-xz]{4}") / n,
            "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double"),
            "only_digits": flag(c.rlike("^[0-9]+$")),
            "uuid": flag(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
            "placeholder": flag(c.rlike(_PLACEHOLDERS)),
            "call": flag(c.rlike(r"[(\[]")),
            "path_before": flag(before.rlike(r"(://|www\.|[/\\.])[^\s]*$")),
            "path_inside": flag(c.rlike("^/|/.*/")),
            "dots_beside": flag(after.rlike(r"^[.@:]\w") | before.rlike(r"\w[.@]$")),
            "assigned": flag(before.rlike(r"[=:>]\s*[\"'`]?$")),
            "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
            "secret_word": flag(near.rlike(_SECRET_WORDS)),
            "harmless_word": flag(near.rlike(_HARMLESS_WORDS)),
            "issuer": flag(c.rlike(_ISSUERS)),
        }
    )


def _sample(docs: DataFrame, labelled: DataFrame | None, most: int) -> DataFrame:
    """Distinct labelled findings, at most ``most`` of either label."""
    columns = ("before", "candidate", "after", "label")
    if labelled is None:
        rows = examples(min(most, 2_000))
        labelled = docs.sparkSession.createDataFrame(pa.table(dict(zip(columns, map(list, zip(*rows))))))
    known = keep(
        labelled.filter("label IN (0, 1)").select(
            F.coalesce("before", F.lit("")).alias("before"), "candidate", F.coalesce("after", F.lit("")).alias("after"),
            F.col("label").cast("double").alias("label"),
        ).filter("candidate <> ''").distinct(),
        "labelled",
    )
    parts = [lowest(known.filter(F.col("label") == label), most, *columns[:3]) for label in (0.0, 1.0)]
    return parts[0].union(parts[1])


def scan_secrets(
    docs: DataFrame, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED,
    id_column: str = "doc_id", text_column: str = "text", dictionary: Collection[str] = (),
) -> DataFrame:
    """``(doc_id, nth, start, candidate, probability, secret)`` for each candidate."""
    prepare(docs.sparkSession)
    number = F.monotonically_increasing_id().alias("finding")
    bare = keep(find_candidates(docs, id_column, text_column).select("*", number), "candidates")
    found = with_features(bare, dictionary)
    sample = keep(with_features(keep(_sample(docs, labelled, max_labelled).select("*", number), "sample"), dictionary), "labelled")
    labels = sorted(r["label"] for r in sample.select("label").distinct().collect())
    if len(labels) == 2:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector")
        # One partition of bounded size in a fixed order, so that the same forest comes out each time.
        rows = vectors.transform(sample.coalesce(1).sortWithinPartitions("candidate", "before", "after", "label"))
        forest = RandomForestClassifier(
            featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, probabilityCol="both"
        ).fit(rows)
        judged = forest.transform(vectors.transform(found)).withColumn("probability", vector_to_array("both")[1])
    else:
        judged = found.withColumn("probability", F.lit(labels[0] if labels else 0.0))
    return judged.select(
        "doc_id", "nth", "start", "candidate", "probability", (F.col("probability") >= 0.5).alias("secret")
    )


def redact(docs: DataFrame, findings: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by ``MARK`` at its place, and no other text touched.

    ``findings`` come from a scan of the same texts. Rows of one id share the places, so ids should be those of rows. Columns of any name pass
    through unchanged.
    """
    own = (
        findings.filter("secret AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("nth").alias("nths"))
    )
    row = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_column].cast("long").alias("id"), docs[text_column].alias("text")
    )
    pieces, found = _cut(F.col("text"))
    marked = F.transform(
        found,
        lambda m, i: F.when(F.array_contains("nths", i), F.concat(F.regexp_extract(m, _LEAD, 0), F.lit(MARK))).otherwise(m),
    )
    # One piece more than matches, so the last is followed by nothing.
    clean = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), marked.alias("m")), lambda x: F.concat(x["p"], F.coalesce(x["m"], F.lit("")))), "")
    joined = row.join(own, "id", "left")
    columns = [
        F.when(F.col("nths").isNull(), F.col("text")).otherwise(clean).alias(c) if c == text_column else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return joined.select(*columns)
