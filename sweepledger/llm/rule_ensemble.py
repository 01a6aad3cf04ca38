"""Quality classifier: a sparse ensemble of rules over statistics of the text.

A forest of shallow trees is grown on the labelled texts' statistics; every path from a root
is a conjunctive rule. A logistic model with lasso weights over the rules keeps a few of
them; these become one Spark column expression. All fitting runs on Spark over all
labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .shared import fresh, row_places, without_places

A_Z, DIGITS, SYMBOLS, STOPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "%$#&*@^~=+<>{}[]\\_", ".,;:"


def statistics(text: Column) -> Column:
    """A struct of numbers about a whole text, all finite; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    words, lines = F.split(t, "[ \n]+"), F.split(t, "\n")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    share = lambda part, of: part / F.greatest(of, F.lit(1.0))
    of_kind = lambda kind: share(n - F.length(F.translate(t, kind, "")), n)
    of_text = lambda piece: share((n - F.length(F.replace(t, F.lit(piece), F.lit("")))) / len(piece), n_words)
    return F.struct(
        F.log1p(n).alias("log_chars"),
        F.log1p(n_words).alias("log_words"),
        share(n, n_words).alias("word_length"),
        share(n_words, n_lines).alias("line_words"),
        share(F.size(F.array_distinct(words)).cast("double"), n_words).alias("distinct_words"),
        share(F.size(F.array_distinct(lines)).cast("double"), n_lines).alias("distinct_lines"),
        of_kind(A_Z).alias("capitals"),
        of_kind(DIGITS).alias("digits"),
        of_kind(SYMBOLS).alias("symbols"),
        of_kind(STOPS).alias("stops"),
        of_text("!!").alias("double_bangs"),
        of_text(" | ").alias("bars"),
        share(F.octet_length(t).cast("double"), n).alias("bytes_a_char"),
    )


@dataclass(frozen=True)
class Rule:
    """All of ``low < statistic <= high``, by the statistics' names."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self, numbers: Column) -> Column:
        met = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                met = met & (numbers[name] > low)
            if high < math.inf:
                met = met & (numbers[name] <= high)
        return met


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self, numbers: Column) -> Column:
        """Probability of label 1 from a struct of statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.weighted:
            total = total + F.when(rule.holds(numbers), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def tree_rules(trees: list, names: list[str]) -> list[Rule]:
    """The paths from the root to every other node of the trees, each once."""
    rules: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            rules[Rule(tuple(sorted((k, *v) for k, v in bounds.items())))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            name, cut = names[node.split().featureIndex()], node.split().threshold()
            low, high = bounds.get(name, (-math.inf, math.inf))
            walk(node.leftChild(), bounds | {name: (low, min(high, cut))})
            walk(node.rightChild(), bounds | {name: (max(low, cut), high)})

    for tree in trees:
        walk(tree._java_obj.rootNode(), {})
    return list(rules)


def fit(labelled: DataFrame, trees: int = 20, depth: int = 3, lasso: float = 5e-4, seed: int = 4) -> RuleModel:
    """A model from ``(numbers, label)``: statistics and 0 or 1. Rows without a label are left out.

    With one class only, or no row, the score is the share of label 1 with one more row of each class.
    """
    labelled = labelled.where("label IS NOT NULL").select("numbers", F.col("label").cast("double").alias("label"))
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleModel(math.log((ones + 1) / (n - ones + 1)), ())
    names = labelled.schema["numbers"].dataType.fieldNames()
    vectors = labelled.select("label", "numbers", array_to_vector(F.array(*[F.col(f"numbers.{x}") for x in names])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(vectors)
    rules = tree_rules(forest.trees, names)
    marks = F.array(*[rule.holds(F.col("numbers")).cast("double") for rule in rules])
    lasso_fit = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=True)
    model = lasso_fit.fit(vectors.select("label", array_to_vector(marks).alias("features")))
    weights = [(rule, float(w)) for rule, w in zip(rules, model.coefficients.toArray()) if w]
    return RuleModel(float(model.intercept), tuple(weights))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: the checksum of the id as text leaves no rest by 5. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def text_numbers(docs: DataFrame) -> DataFrame:
    """``(doc_id, numbers)`` of every row, written once to the shared checkpoint folder."""
    return stage(docs.select("doc_id", statistics(F.col("text")).alias("numbers")), "statistics")


def learn(numbers: DataFrame, labels: DataFrame, column: str = "quality") -> RuleModel:
    """A model from the rows that have a label and are not held out.

    Of several labels for one id the majority counts, and 1 in a tie; ids and labels that are null are left out.
    Every row with a labelled id counts.
    """
    known = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(column).alias("mean"))
    label = F.when(F.col("mean") >= 0.5, 1.0).when(F.col("mean") < 0.5, 0.0)
    return fit(numbers.join(known, "doc_id").select("numbers", label.alias("label")))


def judge_quality(docs: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Scores come from the text alone. Null and empty texts are scored like any other; repeated rows stay; other
    columns are not read; an empty table gives no rows.
    """
    numbers = text_numbers(docs)
    score = learn(numbers, labels).score(F.col("numbers"))
    return numbers.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= accept).cast("int")
    )


def keep_accepted(docs: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``accept``.

    Statistics are worked out once, for learning and for judging; rows are told apart by their places (see ``row_places``).
    """
    (place,) = fresh(docs, "place")
    placed = row_places(docs, place)
    numbers = stage(placed.select("doc_id", place, statistics(F.col("text")).alias("numbers")), "statistics")
    score = learn(numbers, labels).score(F.col("numbers"))
    return without_places(placed, numbers.where(score < accept), place)
