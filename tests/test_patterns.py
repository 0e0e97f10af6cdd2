import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.functions import patterns, text
from assayer.operators import scoring

# Where each pattern is first found, from the rules: whole words, stems, phrases in order, and, or, brackets.
FOUND = [
    ("kettle", "The kettle, the KETTLE", 4),
    ("KeTtLe", "a kettle", 2),
    ("pan", "A span of japan, panned", None),
    ("pan", "span pan", 5),
    ("pan*", "A span of japan, panned", 17),
    ("pann* lid", "a panning lid", 2),
    ("pann* lid", "a lid, panned", None),
    ("cast iron pan", "cast-iron: PAN", 0),
    ("iron cast", "cast iron cast", 5),
    ("iron cast", "cast iron", None),
    ("cook's knife", "The cook's knife", 4),
    ("tea & cup", "Cup of tea", 0),
    ("tea & cup", "teacup", None),
    ("tea | cup & saucer", "a cup", None),
    ("tea | cup & saucer", "a saucer, a cup", 2),
    ("(tea | cup) & saucer", "tea on a saucer", 0),
    ("(tea | cup) & saucer", "tea in a cup", None),
    ("(fork | spoon*) & (big | small)", "small spoons", 0),
    ("((spoon))", "one spoon", 4),
    ("crème", "Crème brûlée", 0),
    ("creme", "Crème brûlée", None),
    ("brûl*", "Crème BRÛLÉE", 6),
    ("weiß", "WEISS und grün", 0),
    ("όσος", "ΌΣΟΣ", 0),
    ("pot", "\U0001f372 pot", 2),
    ("ﬂat", "a FLAT", 2),
]


def positions(spark, rows):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "i int, pattern string, text string")
    df = patterns.with_compiled(df).withColumn(
        "word", text.let(text.words_line(F.col("text")), lambda line: patterns.find_word(line, F.col("compiled")))
    )
    at = F.when(F.col("word") != patterns.NOWHERE, text.word_offset(F.col("text"), F.col("word")))
    return [r.at for r in df.select("i", at.alias("at")).orderBy("i").collect()]


def test_patterns_find_whole_words(spark):
    assert positions(spark, [(p, t) for p, t, _ in FOUND]) == [at for *_, at in FOUND]


@pytest.mark.parametrize(
    "pattern, problem",
    [
        ("   ", "at least one word"),
        ("((tea)", "never closed"),
        ("| tea", "a word is missing"),
        ("tea & & cup", "a word is missing"),
        ("tea)", r"unexpected '\)'"),
        ("tea & *", "names no word"),
        ("tea (cup)", r"unexpected '\('"),
        ("(tea) cup", "unexpected 'cup'"),
        ("tea & ()", "a word is missing"),
    ],
)
def test_patterns_that_dont_read_are_refused(pattern, problem):
    with pytest.raises(patterns.Unreadable, match=problem):
        patterns.read_pattern(pattern)


def random_tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.4:
        return [rng.choice(["ab", "b", "abc", "c"]) + rng.choice(["", "", "*"]) for _ in range(rng.randint(1, 2))]
    return (rng.choice("&|"), random_tree(rng, depth - 1), random_tree(rng, depth - 1))


def written(tree):
    if isinstance(tree, list):
        return " ".join(tree)
    op, a, b = tree
    return f"({written(a)}) {op} ({written(b)})"


def brute(tree, words):
    if isinstance(tree, list):
        fits = lambda t, w: w.startswith(t[:-1]) if t.endswith("*") else w == t
        for i in range(len(words) - len(tree) + 1):
            if all(fits(t, words[i + k]) for k, t in enumerate(tree)):
                return i
        return None
    op, a, b = tree[0], brute(tree[1], words), brute(tree[2], words)
    if op == "&":
        return None if a is None or b is None else min(a, b)
    return min([x for x in (a, b) if x is not None], default=None)


def test_patterns_agree_with_direct_evaluation(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(400):
        tree = random_tree(rng)
        words = " ".join(rng.choice(["ab", "b", "abc", "c", "d", "abd"]) for _ in range(rng.randint(0, 7)))
        cases.append((tree, words.upper() if rng.random() < 0.2 else words))
    expected = []
    for tree, words in cases:
        spans = list(re.finditer(r"\w+", words))
        at = brute(tree, [s.group().casefold() for s in spans])
        expected.append(None if at is None else spans[at].start())
    assert positions(spark, [(written(t), w) for t, w in cases]) == expected


# ------------------------------------------------------------------------------- metrics

MENU = "Soup of the day. Bread is fresh!\nTea costs less."
NOTE = "Green beans only. No runner was late."
SCORED = [
    ("reciprocal_rank", ["Soup", "Bread", "Rye bread", "Tea"], "bread", 0.5, "2. Bread", None),
    ("reciprocal_rank", ["Soup", "Bread", "Rye bread", "Tea"], "rye & bread | coffee", 1 / 3, "3. Rye bread", None),
    ("reciprocal_rank", ["Soup", "Bread"], "salt", 0.0, None, "not listed"),
    ("reciprocal_rank", ["Runner", "Green beans"], "runner & beans", 0.0, None, "not listed"),
    ("reciprocal_rank", [], "soup", 0.0, None, "not listed"),
    ("reciprocal_rank", None, "soup", 0.0, None, "no answer"),
    ("reciprocal_rank", ["Soup"], False, None, None, "nothing is expected to be found"),
    ("first_mention", [MENU], "bread", 17.0, "Bread is fresh!", None),
    ("first_mention", [MENU], "coffee | tea", 33.0, "Tea costs less.", None),
    ("first_mention", ["Nothing today", MENU], "day", 12.0, "Soup of the day.", None),
    ("first_mention", [NOTE], "runner & beans", None, None, "never named"),
    ("first_mention", [NOTE], "runner & late", 21.0, "No runner was late.", None),
    ("first_mention", [], "tea", None, None, "never named"),
    ("first_mention", None, "tea", None, None, "no answer"),
    ("mentions", ["Soup.", MENU], "cost*", 1.0, MENU, None),
    ("mentions", [MENU], "cost", 0.0, None, "not named"),
    ("mentions", [], "tea", 0.0, None, "not named"),
    ("mentions", None, "tea", 0.0, None, "no answer"),
    ("mentions", ["Salt it."], False, 0.0, "Salt it.", "none expected"),
    ("mentions", [], False, 1.0, None, "none named, as expected"),
    ("mentions", None, False, 0.0, None, "no answer"),
]


@pytest.mark.parametrize("metric", list(scoring.METRICS))
def test_metrics(spark, metric):
    rows = [(i, items, "false" if t is False else f'"{t}"') for i, (m, items, t, *_) in enumerate(SCORED) if m == metric]
    df = spark.createDataFrame(rows, "i int, items array<string>, target_json string")
    df = df.withColumn("picked", F.array(F.parse_json("target_json")))
    df = scoring.decode_targets(df, "picked")
    got = df.select("i", scoring.score(metric, F.col("items"), F.col("target")).alias("s")).select("i", "s.*").collect()
    assert {r.i: (r.value, r.answer, r.reason) for r in got} == {i: SCORED[i][3:] for i, *_ in rows}


def test_an_unknown_metric_is_refused():
    with pytest.raises(ValueError, match="no metric"):
        scoring.score("accuracy", F.lit(None), F.lit(None))


AGGREGATED = [
    ("mean", [2.0, 4.0, 9.0], 5.0), ("mean", [None, 3.0, None, 5.0], 4.0), ("mean", [], 0.0), ("var", [2.0, 4.0, 9.0], 13.0),
    ("std", [2.0, 4.0, 9.0], 3.6056), ("stderr", [2.0, 4.0, 9.0], 2.0817), ("std", [7.0], 0.0), ("var", [], 0.0), ("stderr", [None, 7.0], 0.0),
]


def test_aggregates(spark):
    from assayer.functions.aggregates import AGGREGATES

    for name, values, expected in AGGREGATED:
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert df.agg(AGGREGATES[name](F.col("v")).alias("a")).first().a == pytest.approx(expected, abs=1e-4)
