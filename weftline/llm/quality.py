"""Quality rules under weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document, from features of its whole text. Documents fall
into vote patterns; expectation-maximisation over the counts of all patterns estimates how each rule votes on good and
on bad documents, with a prior that takes votes to be right more often than not. The posterior probability of good
quality given the pattern decides, in place of a demand that all rules pass. Only DataFrame functions touch documents;
the estimation itself sees the pattern counts alone, at most 3 ** rules rows whatever the size of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, words

WINDOW = 5
BLANK_CHARS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_features(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` plus the features (long, each 0 for a null or empty text) that rules look at.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters, n_marks, n_bars, with
    n_repeat_words the words covered by five-word windows that occur twice or more in the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: F.length(F.translate(line, BLANK_CHARS, "")) > 0
    first = documents.withColumns(
        {
            "_w": words(F.col(text)),
            "_l": F.filter(F.split(t, "\n", -1), has_word),
            "_solid": F.translate(t, BLANK_CHARS, ""),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        }
    )
    second = first.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
            "word_chars": F.length("_solid").cast("long"),
            "n_symbols": _removed(F.col("_solid"), SYMBOLS).cast("long"),
            "n_marks": _removed(F.col("_solid"), "!").cast("long"),
            "n_bars": _removed(F.col("_solid"), "|").cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        }
    ).drop("_w", "_l", "_solid")
    n = F.size("_h")
    slices = F.arrays_zip(*[F.slice("_h", F.lit(k + 1), F.greatest(n - (WINDOW - 1), F.lit(0))) for k in range(WINDOW)])
    third = second.withColumn("_win", F.transform(slices, lambda s: F.xxhash64(s))).drop("_h")
    m = F.size("_win")
    fourth = third.withColumn("_again", F.size(F.array_distinct("_win")) < m)
    by_hash = F.when(F.col("_again"), F.sort_array(F.arrays_zip(F.col("_win").alias("h"), F.sequence(F.lit(0), m - 1).alias("i"))))
    fifth = fourth.withColumn("_s", by_hash).drop("_win")
    k = F.size("_s")
    equal = F.zip_with(F.slice("_s", F.lit(1), k - 1), F.slice("_s", F.lit(2), k - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    sixth = fifth.withColumn("_p", F.when(F.col("_again"), F.sort_array(F.array_distinct(F.flatten(equal))))).drop("_s")
    gaps = F.zip_with(F.col("_p"), F.slice("_p", F.lit(2), F.size("_p")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return sixth.withColumn("n_repeat_words", F.when(F.col("_again"), F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)).otherwise(F.lit(0).cast("long"))).drop("_again", "_p")


#: Rule, vote, prior rate of that vote on good documents, on bad ones. Conditions are whole-number comparisons of features.
RULES: list[tuple[str, int, str, float, float]] = [
    ("symbols", -1, "10 * n_symbols > n_words", 0.005, 0.4),
    ("marks", -1, "10 * n_marks > n_words", 0.005, 0.4),
    ("bars", -1, "10 * n_bars > n_words", 0.005, 0.4),
    ("capitals", -1, "10 * n_upper > 4 * word_chars", 0.01, 0.4),
    ("repeats", -1, "10 * n_repeat_words > n_words", 0.05, 0.25),
    ("dup_lines", -1, "10 * n_dup_lines > 3 * n_lines", 0.06, 0.15),
    ("word_shape", -1, "word_chars > 15 * n_words OR word_chars < 2 * n_words", 0.02, 0.2),
    ("word_shape", 1, "n_words > 0 AND word_chars BETWEEN 3 * n_words AND 10 * n_words", 0.9, 0.6),
    ("length", 1, "n_words >= 30", 0.85, 0.7),
]
RULE_NAMES = list(dict.fromkeys(r[0] for r in RULES))
#: Share of good documents, weight of the prior rates against the data, rounds of estimation.
GOOD_SHARE, PRIOR_WEIGHT, ROUNDS = 0.9, 0.5, 20
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def vote_sql(name: str) -> str:
    """A rule's vote as SQL, the same for Spark and others."""
    return "CASE " + " ".join(f"WHEN {cond} THEN {vote}" for rule, vote, cond, _, _ in RULES if rule == name) + " ELSE 0 END"


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> list[tuple[float, float]]:
    """Rates of each vote of RULES on good and on bad documents, by expectation-maximisation over pattern counts.

    Abstentions carry no evidence. The share of good documents is given, as votes that may abstain do not determine
    it: estimated along with the rates it falls from round to round until nothing is good. The prior keeps its part of
    the weight however many documents there are, as the rules' votes hang together by language and length, which the
    model takes for evidence: with a prior of 1,000 documents against 51,000 the rates drift and the verdict rejects
    half as many good documents again. Without documents the prior rates stand.
    """
    at = [RULE_NAMES.index(r[0]) for r in RULES]
    rates = [(r[3], r[4]) for r in RULES]
    for _ in range(rounds):
        good = [(v, n, _sigmoid(_log_odds(v, at, rates)) * n) for v, n in patterns]
        all_good = sum(g for _, _, g in good)
        all_bad = sum(n - g for _, n, g in good)
        if all_good <= 0 or all_bad <= 0:
            break
        new = []
        for j, (_, vote, _, g0, b0) in zip(at, RULES, strict=True):
            g = sum(x for v, _, x in good if v[j] == vote)
            b = sum(n - x for v, n, x in good if v[j] == vote)
            new.append(((g / all_good + PRIOR_WEIGHT * g0) / (1 + PRIOR_WEIGHT), (b / all_bad + PRIOR_WEIGHT * b0) / (1 + PRIOR_WEIGHT)))
        rates = new
    return rates


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def _log_odds(votes: tuple[int, ...], at: list[int], rates: list[tuple[float, float]]) -> float:
    odds = math.log(GOOD_SHARE / (1 - GOOD_SHARE))
    for j, (_, vote, *_), (g, b) in zip(at, RULES, rates, strict=True):
        if votes[j] == vote:
            odds += math.log(g / b)
    return odds


def judge(featured: DataFrame) -> DataFrame:
    """A frame with features (evaluated twice: give a written one) plus base_failed, posterior (double) and kept."""
    votes = featured.selectExpr(*[f"{vote_sql(r)} AS {r}" for r in RULE_NAMES])
    counts = votes.groupBy(*RULE_NAMES).count().collect()  # at most 3 ** rules rows
    rates = estimate(sorted((tuple(r[:-1]), r[-1]) for r in counts))
    odds = F.lit(math.log(GOOD_SHARE / (1 - GOOD_SHARE)))
    for (rule, vote, *_), (g, b) in zip(RULES, rates, strict=True):
        odds = odds + F.when(F.expr(vote_sql(rule)) == vote, F.lit(math.log(g / b))).otherwise(F.lit(0.0))
    return featured.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_bars", "n_lines"]


def quality_digest(documents: DataFrame) -> DataFrame:
    """Per document the base features, whether a base rule fails, and the verdict.

    Null texts count as empty; repeated rows are judged each; null doc_ids are kept; texts of any length are read
    whole; an empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession, "quality")
    narrow = scratch.keep(with_features(documents.select("doc_id", "text")).select("doc_id", *FEATURES))
    return judge(narrow).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(documents: DataFrame) -> DataFrame:
    """``documents`` without those that the rules reject; columns and rows otherwise as they are.

    Columns of the input that clash with a feature's name are set aside while rules look and come back unchanged.
    Nulls, empties, repeats and long texts: as in ``quality_digest``.
    """
    scratch = Scratch(documents.sparkSession, "quality")
    cols = documents.columns
    boxed = documents.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_doc"), F.col("text").alias("_text"))
    featured = scratch.keep(with_features(boxed, "_text").drop("_text"))
    return judge(featured).filter("kept").select(*[F.col("_doc").getField(c).alias(c) for c in cols])


def _oracle() -> str:
    """The whole verdict for DuckDB: features, pattern counts, each round of the estimation as one row of rates."""
    word = r"[^\x20\x09-\x0D]+"
    rates = ", ".join(f"{g}::DOUBLE AS g{k}, {b}::DOUBLE AS b{k}" for k, (*_, g, b) in enumerate(RULES))
    hit = [f"({RULE_NAMES[RULE_NAMES.index(rule)]} = {vote})" for rule, vote, *_ in RULES]
    odds = f"ln({GOOD_SHARE} / (1 - {GOOD_SHARE})) + " + " + ".join(f"CASE WHEN {h} THEN ln(g{k} / b{k}) ELSE 0 END" for k, h in enumerate(hit))
    sql = rf"""WITH w AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents
    ), pos AS (
      SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
    ), again AS (
      SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM pos) WHERE n > 1
    ), cover AS (
      SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM again) GROUP BY rid
    ), f AS MATERIALIZED (
      SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_marks,
        length(regexp_replace(t, '[^|]', '', 'g'))::BIGINT AS n_bars,
        length(regexp_replace(t, '\P{{Lu}}', '', 'g'))::BIGINT AS n_upper,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cover.n, 0)::BIGINT AS n_repeat_words
      FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) LEFT JOIN cover USING (rid)
    ), v AS MATERIALIZED (SELECT *, {", ".join(f"{vote_sql(r)} AS {r}" for r in RULE_NAMES)} FROM f),
    pat AS MATERIALIZED (SELECT {", ".join(RULE_NAMES)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
    r0 AS MATERIALIZED (SELECT {rates})"""
    for i in range(ROUNDS):
        new = ", ".join(
            f"(coalesce(sum(p) FILTER ({h}), 0) / sum(p) + {PRIOR_WEIGHT} * {g}) / (1 + {PRIOR_WEIGHT}) AS g{k}, (coalesce(sum(n - p) FILTER ({h}), 0) / sum(n - p) + {PRIOR_WEIGHT} * {b}) / (1 + {PRIOR_WEIGHT}) AS b{k}"
            for k, (h, (*_, g, b)) in enumerate(zip(hit, RULES, strict=True))
        )
        sql += f",\n    r{i + 1} AS MATERIALIZED (SELECT {new} FROM (SELECT pat.*, n / (1 + exp(-({odds}))) AS p FROM pat, r{i}))"
    return sql + f"""
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
      NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
    FROM v, r{ROUNDS}"""


ORACLE_SQL = _oracle()
