"""Per-document text statistics, and an ordered rule list that tells prose from lists, tables and junk.

All statistics are built-in column expressions. The rule list is induced from labelled documents by incremental reduced-error
pruning: for each class, rarest first, a rule grows literal by literal on two thirds of the examples by information gain, is
pruned on the rest as long as (p - n) / (p + n) does not fall, and is kept if its precision is at least ``MIN_PRECISION``;
what it covers is set aside and the next rule grows. Several lists from different splits vote on wrong labels first (see ``learned``). The list is exported as one SQL CASE expression and applied by
Spark to every document. Only the labelled rows reach the driver, at most ``MAX_LABELS`` of them.

Defined results: null text has null statistics and a null label; blank text is labelled ``empty`` and is neither prose nor found;
contradicting labels all count as examples; without labels of a kind no document is of that kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regloom.joins import lookup_join
from regloom.session import materialise, prepare

MAX_LABELS, SEED, RUNS = 20_000, 7, 5
#: Least precision of a rule, on all it covers and on the pruning part.
MIN_PRECISION = 0.8
#: Cuts whose gain is at least this share of the best compete by the width of the gap they lie in.
TOLERANCE = 0.97
#: A word is common if at least this share of the documents has it (and at least MIN_DOCUMENTS do).
COMMON_SHARE, MIN_DOCUMENTS = 0.0005, 3

ROW = "__row"

WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]][\p{L}\p{M}'’]*+"
_END = r"[.!?…。！？؟।][\"'”’»“)\]」』]*\s*\z"
_MARK = r"\A\s*(?:[-*+•–·▪◦>]\s|\[[ xX]?\]\s|\(?\p{Alnum}{1,3}[.)]\s)"
_CELLS = r"\t|;|\|{1,2}|,(?=\S)|(?<=\S) {3,}(?=\S)"

# Function words of the languages at hand; for Chinese and Japanese single characters.
FUNCTION_WORDS = (
    "a an the and or but if of to in on at by for from with as is are was were be been has had have it its this that i we you my our your not no than so "
    "der die das und oder ist war ein eine nicht mit von zu im auf für es ich wir nach auch "
    "le la les un une et ou est était de du des à en dans pour pas que qui ne se mon ma "
    "el los las una y o es era del al por para con que no se mi su muy lo "
    "die en van vir met was is dit ons het nie te sal weer na my "
    "и в не на с что это был как по но за я мы он она очень снова а к бы ещё всё через спустя "
    "的 了 是 很 在 我 不 都 还 用 就 也 更 有 真 点 天 一 个 の は が を に と で"
)

FEATURES = (
    "n_chars",
    "n_words",
    "n_lines",
    "mean_word_length",
    "max_word_length",
    "symbol_ratio",
    "letter_ratio",
    "digit_ratio",
    "upper_ratio",
    "end_share",
    "end_char_share",
    "marked_share",
    "long_char_share",
    "cell_share",
    "item_char_share",
    "words_per_line",
    "distinct_ratio",
    "common_share",
    "function_share",
    "bare_char_share",
    "bare_words",
)
#: Statistics the rules may use.
RULE_FEATURES = (
    "n_chars",
    "n_lines",
    "max_word_length",
    "symbol_ratio",
    "letter_ratio",
    "end_char_share",
    "marked_share",
    "long_char_share",
    "cell_share",
    "item_char_share",
    "words_per_line",
    "distinct_ratio",
    "common_share",
    "function_share",
    "bare_char_share",
    "bare_words",
)

def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def common_words(documents: DataFrame) -> list[str]:
    """Words that many documents have, counted over all documents; at most (mean distinct words a document) / COMMON_SHARE of them, whatever their number."""
    seen = documents.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    least = max(MIN_DOCUMENTS, int(documents.count() * COMMON_SHARE) + 1)
    return sorted(r["word"] for r in seen.filter(F.col("n") >= least).select("word").collect())


def text_statistics(documents: DataFrame, common: list[str]) -> DataFrame:
    """Adds the columns of ``FEATURES`` to doc_id and text; other columns are dropped. Everything is computed within the row.
    The column named by ``ROW`` numbers the rows.

    ``common`` are the words of ``common_words``; as literals of the plan they are one hash set in every task.
    """
    text = F.col("text")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def shape(x: Column) -> Column:
        """What the statistics need of a line, each pattern matched once."""
        return F.struct(
            F.length(x).alias("chars"),
            _words(x).alias("words"),
            F.regexp_count(x, F.lit(_CELLS)).alias("cells"),
            F.rlike(x, F.lit(_END)).alias("ends"),
            F.rlike(x, F.lit(_MARK)).alias("marked"),
        )

    per_word = F.transform("words", lambda w: F.length(w))
    n_lines, n_words = F.size("lines"), F.size("words")
    some, some_lines = F.greatest(n_words, F.lit(1)), F.greatest(n_lines, F.lit(1))
    total = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + x["chars"])
    share = lambda condition: F.size(F.filter("lines", condition)) / some_lines
    char_share = lambda condition: total(F.filter("lines", condition)) / F.greatest(total(F.col("lines")), F.lit(1))
    is_function = lambda w: w.isin(*sorted(set(FUNCTION_WORDS.split())))
    visible = F.greatest(F.length("visible"), F.lit(1))
    rest = lambda pattern: F.length(F.regexp_replace("visible", pattern, "")) / visible
    # two steps, so that the words of a line are found once
    shaped = documents.select("doc_id", "text").select("doc_id", "text", F.transform(lines, shape).alias("shaped"), F.regexp_replace(text, r"\s+", "").alias("visible"))
    counted = lambda x: x.withField("words", F.size(x["words"])).withField("function", F.size(F.filter(x["words"], is_function)))
    staged = shaped.select("doc_id", "text", "visible", F.flatten(F.transform("shaped", lambda x: x["words"])).alias("words"), F.transform("shaped", counted).alias("lines"))
    known = text.isNotNull()
    values = {
        "n_chars": F.length(text),
        "n_words": n_words,
        "n_lines": n_lines,
        "mean_word_length": F.aggregate(per_word, F.lit(0), lambda a, x: a + x) / some,
        "max_word_length": F.coalesce(F.array_max(per_word), F.lit(0)),
        "symbol_ratio": rest(r"[\p{L}\p{M}\p{N}.,;:!?'’\"()\-。，！？、：；“”]+"),
        "letter_ratio": rest(r"\P{L}+"),
        "digit_ratio": rest(r"\P{Nd}+"),
        "upper_ratio": rest(r"\P{Lu}+"),
        "end_share": share(lambda x: x["ends"]),
        "end_char_share": char_share(lambda x: x["ends"]),
        "marked_share": share(lambda x: x["marked"]),
        "long_char_share": char_share(lambda x: x["words"] >= 9),
        # cells: two or more delimiters with few words between them; items: short lines that end no sentence
        "cell_share": share(lambda x: (x["cells"] >= 2) & (x["words"] <= 3 * x["cells"] + 3)),
        "item_char_share": F.when(n_lines >= 3, char_share(lambda x: (x["words"] <= 7) & ~x["ends"])).otherwise(0.0),
        "words_per_line": n_words / some_lines,
        "distinct_ratio": F.size(F.array_distinct("words")) / some,
        "common_share": F.size(F.filter("words", lambda w: w.isin(*common))) / some if common else F.lit(0.0),
        "function_share": F.aggregate("lines", F.lit(0), lambda a, x: a + x["function"]) / some,
        # lines that neither hold a function word nor end like a sentence
        "bare_char_share": char_share(lambda x: (x["function"] == 0) & ~x["ends"]),
        # runs of words between function words: long ones where words are strung together
        "bare_words": n_words / (F.aggregate("lines", F.lit(0), lambda a, x: a + x["function"]) + 1),
    }
    # the row number keeps a filter over the kinds from being pushed below this step, which would repeat every statistic for every rule that reads it
    return staged.select("doc_id", "text", *[F.when(known, values[f].cast("double")).alias(f) for f in FEATURES], F.monotonically_increasing_id().alias(ROW))


Literal = tuple[str, str, float]


@dataclass(frozen=True)
class RuleList:
    """Ordered rules (label, literals); the first that holds decides, else ``default``."""

    rules: tuple[tuple[str, tuple[Literal, ...]], ...]
    default: str = "prose"

    def case_sql(self) -> str:
        """The list as a SQL CASE expression over the feature columns."""
        whens = " ".join(f"WHEN {' AND '.join(f'{f} {op} {t!r}D' for f, op, t in body)} THEN '{label}'" for label, body in self.rules)
        body = f"CASE {whens} ELSE '{self.default}' END" if whens else f"'{self.default}'"
        return f"CASE WHEN n_words IS NULL THEN NULL WHEN trim(text) = '' THEN 'empty' ELSE {body} END"

    def predict(self, x: np.ndarray, names: tuple[str, ...] = RULE_FEATURES) -> np.ndarray:
        out = np.full(len(x), self.default, dtype=object)
        free = np.ones(len(x), dtype=bool)
        for label, body in self.rules:
            hit = free & _covers(body, x, names)
            out[hit] = label
            free &= ~hit
        return out


def _covers(body: tuple[Literal, ...], x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for f, op, t in body:
        v = x[:, names.index(f)]
        hit &= (v >= t) if op == ">=" else (v <= t)
    return hit


def _best_literal(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> tuple[float, Literal] | None:
    """The literal of the highest information gain on the covered examples."""
    p0, n0 = y.sum(), (~y).sum()
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, Literal] | None = None
    for f, name in enumerate(names):
        order = np.argsort(x[:, f], kind="stable")
        v, up = x[order, f], np.cumsum(y[order])
        cut = np.nonzero(np.diff(v))[0]
        if not len(cut):
            continue
        p_low, n_low = up[cut], cut + 1 - up[cut]
        middle = (v[cut] + v[cut + 1]) / 2
        for op, p, n in (("<=", p_low, n_low), (">=", p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1.0)
            # of the cuts that are about as good as the best, the one in the widest gap
            good = gain >= TOLERANCE * gain.max()
            i = int(np.argmax(np.where(good, v[cut + 1] - v[cut], -1.0)))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-12):
                best = (float(gain[i]), (name, op, float(round(middle[i], 6))))
    return best


def _grow(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], most: int = 6) -> tuple[Literal, ...]:
    body: tuple[Literal, ...] = ()
    hit = np.ones(len(x), dtype=bool)
    while len(body) < most and (~y[hit]).any() and y[hit].any():
        found = _best_literal(x[hit], y[hit], names)
        if not found:
            break
        body += (found[1],)
        hit = _covers(body, x, names)
    return body


def _worth(body: tuple[Literal, ...], x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> float:
    hit = _covers(body, x, names)
    p, n = int(y[hit].sum()), int((~y[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def induce(x: np.ndarray, labels: np.ndarray, names: tuple[str, ...] = RULE_FEATURES, seed: int = SEED, default: str = "prose") -> RuleList:
    """Ordered rule list by incremental reduced-error pruning."""
    rng = np.random.default_rng(seed)
    rules: list[tuple[str, tuple[Literal, ...]]] = []
    left = np.ones(len(x), dtype=bool)
    kinds = [k for k in np.unique(labels) if k != default]
    for kind in sorted(kinds, key=lambda k: ((labels == k).sum(), k)):
        misses = 0
        while misses < 6:
            at = np.nonzero(left)[0]
            y = labels[at] == kind
            if y.sum() < 2:
                break
            # stratified: two thirds of each side grow the rule, the rest prune it
            pick = np.zeros(len(at), dtype=bool)
            for side in (True, False):
                own = rng.permutation(np.nonzero(y == side)[0])
                pick[own[: -(-2 * len(own) // 3)]] = True
            body = _grow(x[at][pick], y[pick], names)
            if not body:
                break
            px, py = x[at][~pick], y[~pick]
            while len(body) > 1 and _worth(body[:-1], px, py, names) >= _worth(body, px, py, names):
                body = body[:-1]
            hit = _covers(body, x[at], names)
            p, n = int(y[hit].sum()), int((~y[hit]).sum())
            if _worth(body, px, py, names) < 2 * MIN_PRECISION - 1 or p < 2 or p < MIN_PRECISION * (p + n):
                misses += 1
                continue
            rules.append((kind, body))
            left[at[hit]] = False
    return RuleList(tuple(rules), default)


def learned(x: np.ndarray, labels: np.ndarray, names: tuple[str, ...] = RULE_FEATURES, default: str = "prose", runs: int = RUNS) -> RuleList:
    """Rule list from labels of which some are wrong.

    ``runs`` lists are induced from different splits into growing and pruning examples. Examples whose label (``default`` or
    another) most of them contradict count as mislabelled and are left out; of the lists induced from the rest, the one
    with the fewest errors is kept, the shortest of equals.
    """
    if not len(x):
        return RuleList((), default)
    other = labels != default
    votes = sum(induce(x, labels, names, seed=SEED + k, default=default).predict(x, names) != default for k in range(runs))
    sound = (2 * votes > runs) == other
    x, labels, other = x[sound], labels[sound], other[sound]
    lists = [induce(x, labels, names, seed=SEED + k, default=default) for k in range(runs)]
    return min(lists, key=lambda r: (int(((r.predict(x, names) != default) != other).sum()), sum(len(b) for _, b in r.rules)))


def learn_rules(documents: DataFrame, labels: DataFrame, common: list[str], max_labels: int = MAX_LABELS) -> RuleList:
    """Rule list from labelled documents; at most ``max_labels`` labels, chosen by hash, are used. Only the statistics of labelled documents are computed."""
    chosen = labels.select("doc_id", "label").filter("label is not null").orderBy(F.xxhash64("doc_id", "label"), "doc_id", "label").limit(max_labels)
    held = materialise(chosen.groupBy("doc_id").agg(F.collect_list("label").alias("labels")), "labels")
    told = lookup_join(documents.select("doc_id", "text").filter("text is not null"), held, ["doc_id"], "inner", salts=1)
    told = materialise(told, "labelled")
    rows = text_statistics(told, common).select("doc_id", *RULE_FEATURES).join(told.select("doc_id", F.explode("labels").alias("label")), "doc_id")
    data = rows.orderBy("doc_id", "label").toPandas()
    return learned(data[list(RULE_FEATURES)].to_numpy(dtype=float), data.label.to_numpy(dtype=object))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every document with ``kind`` (prose, list, table, junk, empty) and ``is_prose``."""
    prepare(documents.sparkSession)
    common = common_words(documents)
    rules = learn_rules(documents, labels, common)
    judged = text_statistics(documents, common).withColumn("kind", F.when(F.col(ROW) >= 0, F.expr(rules.case_sql())))
    return judged.withColumn("is_prose", F.col("kind") == "prose").drop("text", ROW)
