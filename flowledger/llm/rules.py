"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects a text whose share `num / den` is above a cutoff. A labelled holdout chooses the cutoffs: for each
stratum and rule the grid is walked from the mildest cutoff to the strictest, and a cutoff is accepted while the exact
binomial test refutes "more than `risk / rules` of good texts are rejected" at level `delta / (strata * rules)`. The walk
stops at the first cutoff that fails (fixed-sequence testing), so no further correction is due along the grid; over strata
and rules the correction is Bonferroni's. With probability 1 - delta no stratum loses more than `risk` of its good texts.
A stratum with too few labels gets no cutoff and loses nothing. A trial is a distinct text of a stratum (or another unit): copies of
a labelled text, and rows that repeat its id, are one trial, which a cutoff rejects if it rejects any of them.

Nulls: a null text has no words and fails the base rules; a null stratum is a stratum of its own; labels without a
quality or a document are left out; of several labels of a document the highest quality counts. Repeated rows are
judged one by one, and `with_features` and `judge` pass on further columns unless they have the name of a result;
`quality_rules` gives the key, the stratum and results only. Texts of any length are counted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_chars, let, materialise

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Name, numerator, denominator; cutoffs in thousandths, from the mildest to the strictest.
RULES = (
    ("symbols", "n_symbols", "word_chars", (600, 400, 300, 200, 150, 100, 80, 60)),
    ("exclaims", "n_exclaims", "word_chars", (600, 400, 300, 200, 150, 100, 80, 60)),
    ("capitals", "n_capitals", "word_chars", (900, 800, 700, 600, 500, 400, 350, 300)),
    ("dup_lines", "n_dup_lines", "n_lines", (900, 800, 700, 600, 500, 400, 350, 300)),
    ("repeats", "n_repeat_words", "n_words", (500, 450, 400, 350, 300, 250, 200)),
)
RISK, DELTA = 0.05, 0.05


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words of the array stand in a window of `window` words that occurs twice or more in it. Texts without such a window are known by
    their distinct windows, and nothing is sorted for them."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(window))))
    ordered = lambda hashes: F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, k, d: F.coalesce(F.get(s, k + d)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    repeats = lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(ordered(hashes), places), covered)).otherwise(0)
    return F.when(F.size(words) >= window, let(grams, repeats)).otherwise(0)


def features(text: Column) -> Column:
    """A struct of the counts that the rules use, over the whole text."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        count_chars(t, SYMBOLS).alias("n_symbols"),
        count_chars(t, "!").alias("n_exclaims"),
        count_chars(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
    )


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with FEATURES, n_lines, n_exclaims, n_capitals and base_failed in place of the text."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_capitals", "base_failed")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in names]
    df = docs.select(*rest, features(F.col(f"`{text}`")).alias("__f"))
    df = df.select(
        *rest,
        F.col("__f.w.n").alias("n_words"), F.col("__f.word_chars").alias("word_chars"), F.col("__f.n_symbols").alias("n_symbols"),
        F.col("__f.l.d").alias("n_dup_lines"), F.col("__f.w.r").alias("n_repeat_words"), F.col("__f.l.n").alias("n_lines"),
        F.col("__f.n_exclaims").alias("n_exclaims"), F.col("__f.n_capitals").alias("n_capitals"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 1: Stirling's series at x + 16, and the recurrence back."""
    z = x + F.lit(16.0)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - sum((F.log(x + F.lit(float(i))) for i in range(16)), F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly but for rounding; 1 where k >= n * p, which no test refutes.

    The terms are added from k downwards; they fall at least as fast as a normal curve, so those further than twelve
    standard deviations below don't change a double."""
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    far = F.least(k, F.ceil(12 * F.sqrt(n * p) + 60).cast("double")).cast("long")
    odds = (1 - p) / p

    def step(a: Column, j: Column) -> Column:
        i = k - j + 1
        r = a["r"] * i / (n - i + 1) * odds
        return F.struct(r.alias("r"), (a["s"] + r).alias("s"))

    total = F.aggregate(F.when(far >= 1, F.sequence(F.lit(1).cast("long"), far)).otherwise(F.array().cast("array<long>")), F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("s")), step)["s"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def cutoffs(measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", unit: str | None = None, risk: float = RISK, delta: float = DELTA, rules=RULES) -> DataFrame:
    """(stratum, rule, cutoff, n, false_rejections, p): the accepted cutoffs, one row for each stratum and rule at most. unit: the column that tells
    what is one trial, such as a hash of the text; the key by default."""
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max("quality").alias("__q")).where("__q = 1")
    held = measured.where(~F.col("base_failed")).join(good, F.col(f"`{key}`") == F.col("__key"), "left_semi")
    share = risk / len(rules)
    grid = [(name, step, cut, 1000 * F.col(num) > cut * F.col(den)) for name, num, den, cuts in rules for step, cut in enumerate(cuts)]
    trials = held.groupBy(F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"), F.col(f"`{unit or key}`").alias("__unit")).agg(*(F.bool_or(hit).alias(f"__h{i}") for i, (*_, hit) in enumerate(grid)))
    marks = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(step).alias("step"), F.lit(cut).alias("cutoff"), F.col(f"__h{i}").alias("hit")) for i, (name, step, cut, _) in enumerate(grid)))
    tested = trials.select("stratum", F.explode(marks).alias("m"))
    tested = tested.groupBy("stratum", "m.rule", "m.step", "m.cutoff").agg(F.count(F.lit(1)).alias("n"), F.count_if("m.hit").alias("k"))
    strata = measured.select(F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("s")).agg(F.count_distinct("s").alias("strata"))
    tested = tested.crossJoin(F.broadcast(strata)).withColumn("p", binomial_tail(F.col("k"), F.col("n"), share))
    failed = F.col("p") > F.lit(delta) / (F.col("strata") * len(rules))
    first = tested.groupBy("stratum", "rule").agg(F.min(F.when(failed, F.col("step"))).alias("stop"), F.collect_list(F.struct("step", "cutoff", "n", "k", "p")).alias("grid"))
    last = F.array_max(F.filter("grid", lambda x: F.col("stop").isNull() | (x["step"] < F.col("stop"))))
    return first.select("stratum", "rule", last.alias("g")).where("g IS NOT NULL").select("stratum", "rule", F.col("g.cutoff").alias("cutoff"), F.col("g.n").alias("n"), F.col("g.k").alias("false_rejections"), F.col("g.p").alias("p"))


def judge(measured: DataFrame, chosen: DataFrame, *, stratum: str = "lang", rules=RULES) -> DataFrame:
    """measured with `kept`: neither the base rules nor an accepted cutoff of its stratum reject it."""
    wide = chosen.groupBy(F.col("stratum").alias("__s")).agg(*(F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"__c{i}") for i, (name, *_) in enumerate(rules)))
    joined = measured.join(wide, F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")) == F.col("__s"), "left")
    hit = F.lit(False)
    for i, (_, num, den, _cuts) in enumerate(rules):
        hit = hit | F.coalesce(1000 * F.col(num) > F.col(f"__c{i}") * F.col(den), F.lit(False))
    kept = joined.withColumn("kept", ~F.col("base_failed") & ~hit)
    return kept.drop("__s", *(f"__c{i}" for i in range(len(rules))))


def quality_rules(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", **params) -> DataFrame:
    """For each row of docs its key, stratum, FEATURES, base_failed and kept. The counts are made once, and kept in the shared folder."""
    narrow = docs.select(*dict.fromkeys([key, stratum]), text, text_unit(F.col(f"`{text}`")).alias("__text"))
    measured = materialise(with_features(narrow, text))
    chosen = cutoffs(measured, labels, key=key, stratum=stratum, unit="__text", **params)
    return judge(measured, chosen, stratum=stratum, rules=params.get("rules", RULES)).drop("__text")


def text_unit(text: Column) -> Column:
    """What is equal for equal texts: two hashes and the length."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.crc32(t.cast("binary")).alias("b"), F.length(t).alias("n"))


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *FEATURES, "base_failed", "kept")


def _oracle() -> str:
    stops = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, {step} AS step, {cut} AS cutoff, '{num}' AS num" for name, num, den, cuts in RULES for step, cut in enumerate(cuts)
    )
    pick = lambda side: "CASE rule " + " ".join(f"WHEN '{r[0]}' THEN {r[side]}" for r in RULES) + " END"
    share = RISK / len(RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, i, word AS a, lead(word, 1) OVER x AS b, lead(word, 2) OVER x AS c FROM w WINDOW x AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(o) WHERE n >= 2 GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
f AS (SELECT d.rid, d.doc_id, d.lang, d.t, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_exclaims,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
rules AS ({stops}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
trials AS (SELECT lang, t, rule, step, cutoff, bool_or(1000 * ({pick(1)}) > cutoff * ({pick(2)})) AS hit FROM held, rules GROUP BY ALL),
tested AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (hit) AS k FROM trials GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {share} THEN 1 ELSE list_sum(list_transform(range(k + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))) END AS p FROM tested),
stop AS (SELECT lang, rule, min(step) FILTER (p > {DELTA} / ((SELECT count(DISTINCT lang) FROM m) * {len(RULES)})) AS stop FROM p GROUP BY ALL),
cut AS (SELECT lang, rule, min(cutoff) AS cutoff FROM p JOIN stop USING (lang, rule) WHERE stop IS NULL OR step < stop GROUP BY ALL),
hit AS (SELECT DISTINCT rid FROM m JOIN cut USING (lang) WHERE 1000 * ({pick(1)}) > cutoff * ({pick(2)}))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM hit) AS kept FROM m"""


QUERIES = {"op4_quality_rules": op4}
ORACLE = {"op4_quality_rules": _oracle()}
