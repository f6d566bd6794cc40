"""Quality classifier: a sparse ensemble of rules (tree paths over text statistics under a lasso logistic model).

1. Statistics of a text are Spark column expressions (shares of character classes, word and line lengths, repetition).
2. On a bounded sample of labelled rows a small forest is grown; each path from the root to a node is a rule, a
   conjunction of comparisons.
3. A logistic model with an L1 penalty over the rules keeps few of them.
4. The rules that are left become one Spark column expression, so scoring is a single pass with no Python and no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.labelled import held_out, training_rows

SAMPLE_ROWS = 8000  # labelled rows that the rules are fitted on, at most
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.0015, 11

_SHARES = {  # fixed: classes of characters whose share of the text counts
    "upper": r"[^\p{Lu}]+",
    "symbol": r"[^#$%&*+<=>@^_|~{}\[\]\\]+",
    "bang": r"[^!?]+",
    "digit": r"[^0-9]+",
    "stop": r"[^.,;:]+",
}


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; all are numbers, also of an empty text (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    out = {name: F.length(F.regexp_replace(text, other, "")) / n for name, other in _SHARES.items()}
    out["log_chars"] = F.log(n)
    out["word_length"] = n / count
    out["distinct_words"] = F.size(F.array_distinct(words)) / count
    out["distinct_lines"] = F.size(F.array_distinct(lines)) / F.size(lines).cast("double")
    out["line_length"] = F.log(n / F.size(lines))
    return out


@dataclass(frozen=True)
class Rules:
    """The fitted model: an intercept and, for each rule, its comparisons (statistic, at most or above, value) and weight."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self, stat: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = None
            for name, below, value in conditions:
                one = stat[name] <= value if below else stat[name] > value
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(tree: str, names: list[str]) -> set[tuple[tuple[str, bool, float], ...]]:
    """The conditions on the way to each node, read from a tree's printed form; a tighter bound replaces a looser one."""
    out, way = set(), []
    for line in tree.splitlines():
        found = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        way = [x for x in way if x[0] < depth] + [(depth, names[int(found[2])], found[3] == "<=", float(found[4]))]
        best: dict[tuple[str, bool], float] = {}
        for _, name, below, value in way:
            kept = best.get((name, below))
            best[name, below] = value if kept is None else min(kept, value) if below else max(kept, value)
        out.add(tuple(sorted((n, b, v) for (n, b), v in best.items())))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Rules:
    """Rules fitted on at most `rows` labelled rows that are not held out; without both labels, only an intercept."""
    sample = training_rows(docs, labels, label, rows)
    stats = statistics(F.col("text"))
    names = list(stats)
    data = sample.select("id", F.col("label").cast("double").alias("label"), *[c.cast("double").alias(k) for k, c in stats.items()])
    data = data.repartition(8, "id").sortWithinPartitions("id").cache()
    try:
        seen = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
        if len(seen) < 2:
            only = next(iter(seen), 1.0)
            return Rules(4.0 if only else -4.0, ())
        table = VectorAssembler(inputCols=names, outputCol="features").transform(data)
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", subsamplingRate=0.7, minInstancesPerNode=5, seed=SEED).fit(table)
        rules = sorted(set().union(*(_paths(t.toDebugString, names) for t in forest.trees)))
        if not rules:
            return Rules(0.0, ())
        held = [F.when(_all(r), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)]
        table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(data.select("label", *held))
        model = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(table.select("label", "features"))
        weights = model.coefficients.toArray()
        return Rules(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))
    finally:
        data.unpersist()


def _all(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    out = F.lit(True)
    for name, below, value in rule:
        out = out & (F.col(name) <= value if below else F.col(name) > value)
    return out


def classify(docs: DataFrame, model: Rules, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.7) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row: score is the model's probability of label 1.

    Null text counts as empty and gets a score; ids may repeat or be null; other columns are ignored.
    """
    stats = statistics(F.col("_text"))
    flat = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select("_id", *[c.cast("double").alias(k) for k, c in stats.items()])
    scored = flat.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), model.score({k: F.col(k) for k in stats}).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, model: Rules, text_col: str = "text", accept: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `accept`."""
    at = "__statistics"
    stats = statistics(F.col(text_col))
    scored = docs.withColumn(at, F.struct(*[c.cast("double").alias(k) for k, c in stats.items()]))
    return scored.where(model.score({k: F.col(f"{at}.{k}") for k in stats}) >= accept).drop(at)
