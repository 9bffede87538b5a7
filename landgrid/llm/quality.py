"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.common import NON_SPACES

#: Most labelled rows that a fit takes (those of the smallest MD5 of their id), rules that it may keep, trees and their depth.
MAX_TRAIN, MAX_RULES, TREES, DEPTH = 20_000, 60, 40, 3


def _kept(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text; all are 0 for an empty one."""
    words, lines = F.regexp_extract_all(text, F.lit(f"({NON_SPACES})"), F.lit(1)), F.split(text, "\n")
    chars = F.length(text).cast("double")
    return {"chars": chars, "words": words, "lines": lines, "letters": _kept(text, r"[^\p{L}]+"), "upper": _kept(text, r"[^\p{Lu}]+"), "marks": _kept(text, r"[\p{L}\s]+"), "digits": _kept(text, r"[^0-9]+"), "ends": F.regexp_count(text, F.lit(r"[.?!](?=\s|$)")).cast("double")}


def features(df: DataFrame, text_col: str) -> DataFrame:
    """df and one double column __x_<name> for each statistic that rules may test."""
    raw = statistics(F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({f"__q_{k}": v for k, v in raw.items()})
    q = {k: F.col(f"__q_{k}") for k in raw}
    n = F.size(q["words"]).cast("double")
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    same = F.size(F.filter(F.zip_with(q["words"], F.slice(q["words"], F.lit(2), F.greatest(F.size(q["words"]), F.lit(1))), lambda a, b: a == b), lambda x: x)).cast("double")
    made = {
        "__x_length": F.log1p(q["chars"]), "__x_word_length": per(q["letters"], n), "__x_upper": per(q["upper"], q["letters"]), "__x_marks": per(q["marks"], q["chars"]), "__x_marks_word": per(q["marks"], n),
        "__x_digits": per(q["digits"], q["chars"]), "__x_distinct": per(F.size(F.array_distinct(q["words"])).cast("double"), n), "__x_same": per(same, n),
        "__x_lines": per(F.size(F.array_distinct(q["lines"])).cast("double"), F.size(q["lines"]).cast("double")), "__x_line_words": per(n, F.size(q["lines"]).cast("double")), "__x_ends": per(q["ends"], n),
    }
    return df.withColumns(made).drop(*[f"__q_{k}" for k in raw])


NAMES = ["__x_length", "__x_word_length", "__x_upper", "__x_marks", "__x_marks_word", "__x_digits", "__x_distinct", "__x_same", "__x_lines", "__x_line_words", "__x_ends"]

Rule = tuple[tuple[int, bool, float], ...]  # (feature, whether above, threshold), all of which must hold


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> set[Rule]:
    """Paths of one tree that is grown on a bootstrap sample, a random half of the features at each node, splits by Gini gain."""
    take = rng.integers(0, len(y), min(len(y), 5_000))
    x, y = x[take], y[take]
    found: set[Rule] = set()

    def grow(at: np.ndarray, path: Rule) -> None:
        if path:
            found.add(tuple(sorted(path)))
        if len(path) == DEPTH or len(at) < 20 or y[at].min() == y[at].max():
            return
        best, where = 1e-9, None
        for f in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2 + 1)]:
            cuts = np.unique(np.quantile(x[at, f], np.linspace(0.02, 0.98, 33)))
            low = x[at, f][:, None] <= cuts
            n, p = low.sum(0), (low * y[at][:, None]).sum(0)
            m, q = len(at) - n, y[at].sum() - p
            ok = (n >= 5) & (m >= 5)
            with np.errstate(invalid="ignore", divide="ignore"):
                gain = np.where(ok, p * p / n + q * q / m, -1) / len(at) - (y[at].mean()) ** 2
            if (i := int(gain.argmax())) >= 0 and gain[i] > best:
                best, where = gain[i], (int(f), float(cuts[i]))
        if where:
            f, cut_at = where
            above = x[at, f] > cut_at
            grow(at[above], (*path, (f, True, cut_at)))
            grow(at[~above], (*path, (f, False, cut_at)))

    grow(np.arange(len(y)), ())
    return found


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Whether each rule (a row) holds for each row of x (a column)."""
    out = np.ones((len(rules), len(x)), bool)
    for j, rule in enumerate(rules):
        for f, above, cut_at in rule:
            out[j] &= (x[:, f] > cut_at) == above
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, most: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient over r, which is overwritten; the penalty doubles until at most `most` weights are left."""
    mean, n = r.mean(0), len(y)
    c = np.subtract(r, mean, out=r)
    rate = float(4 / (np.linalg.norm(c.T @ c / n, 2) + 1))
    penalty = 5e-4
    while True:
        w = v = np.zeros(r.shape[1], np.float32)
        b = u = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        t = 1.0
        for _ in range(steps):
            err = 1 / (1 + np.exp(-np.clip(c @ v + u, -30, 30))) - y
            step = v - rate / n * (err @ c)
            new, base = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), u - rate * float(err.mean())
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            v, u = new + (t - 1) / t2 * (new - w), base + (t - 1) / t2 * (base - b)
            w, b, t = new, base, t2
        if (w != 0).sum() <= most:
            return w, float(b - mean @ w)
        penalty *= 2


class RuleEnsemble:
    """A fitted model: rules, their weights and the intercept."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float) -> None:
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "RuleEnsemble":
        """Without rows the score is 1/2; with one class only it is close to that class."""
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
            return cls([], [], float(np.log(share / (1 - share))))
        rng = np.random.default_rng(seed)
        rules = sorted(set().union(*(tree_rules(x, y, rng) for _ in range(TREES))))
        r = holds(rules, x)
        _, first = np.unique(np.packbits(r, axis=1), axis=0, return_index=True)
        first = np.sort(first)
        rules, r = [rules[i] for i in first], r[first].T.astype(np.float32)
        w, b = lasso_logistic(r, y.astype(np.float32), MAX_RULES)
        return cls([a for a, z in zip(rules, w, strict=True) if z], [float(z) for z in w if z], b)

    def column(self) -> Column:
        """The score as a column over the features: the logistic of the weights whose rules hold."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for f, above, cut_at in rule:
                test = test & ((F.col(NAMES[f]) > cut_at) if above else (F.col(NAMES[f]) <= cut_at))
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> RuleEnsemble:
    """Learn from at most max_train labelled rows that aren't held out: the bound on what reaches the driver. Labels other than 0 and 1 don't count."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    chosen = usable.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).orderBy(F.md5(F.col("__id").cast("string")), "__y").limit(max_train)
    at = docs.select(F.col(id_col).alias("__of"), F.col(text_col).alias("__t")).join(F.broadcast(chosen), F.col("__of") == F.col("__id"))
    # Repeated ids could bring more rows than labels: the bound holds for what is collected.
    rows = np.array(features(at, "__t").select("__y", "__id", *NAMES).limit(max_train).collect(), float).reshape(-1, 2 + len(NAMES))
    rows = rows[np.lexsort(rows.T[::-1])]
    return RuleEnsemble.fit(rows[:, 2:], rows[:, 0])


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs and its score between 0 and 1. Reads the text only; null counts as empty."""
    return features(docs, text_col).withColumn(out_col, model.column()).drop(*NAMES)
