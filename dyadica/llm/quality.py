r"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each document gets counts from its whole text. A base rule rejects texts of under
50 words and texts more than half of whose words lie in repeated 3-word windows.
Further rules compare a ratio with a cutoff that the labelled documents choose, per
stratum: ratios of form, and the share of words in a lexicon fitted from documents
labelled toxic. Labelled documents are dealt in two by a hash of their id. A quarter
chooses how strict each rule may become and in which order rules are tightened, which
fixes a sequence of steps, each rejecting what the one before it does; the others test
the steps by exact binomial tails against ``risk``, at the level that Holm's procedure
over strata leaves of ``error``. So with probability 1 - error, no stratum loses more
than a share ``risk`` of its good documents (labelled quality 1 and not toxic, past the
base rule) to all rules together. A stratum whose labels cannot show that for the first
step has no cutoff: without a false rejection it takes ln(error) / ln(1 - risk) testing
documents, 299 at 1 % and 5 %.

Defined cases: a null or empty text has no words (and fails the base rule); a null
stratum is a stratum of its own; a document is good if all its labels say quality 1
and toxic 0 (a null label is not good); repeated rows each get their row, but count
once for each in the tests; without labels, only the base rule holds; an empty table
gives an empty result; other columns are not read, and pass through :func:`keep` whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadica.llm.common import MOST_BROADCAST, fresh, materialise

#: Rule, its ratio over the features, and its cutoffs from strict to lax. A document above the cutoff is rejected.
RULES = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4)),
    ("long_words", "word_chars / greatest(n_words, 1)", (7.5, 8.0, 9.0, 10.0, 12.0, 16.0)),
    ("short_words", "n_words / greatest(word_chars, 1)", (0.25, 0.286, 0.333, 0.4, 0.5, 0.667)),
    ("toxic_words", "n_toxic / greatest(n_words, 1)", (0.002, 0.005, 0.01, 0.02, 0.05, 0.1)),
)


@dataclass(frozen=True)
class Control:
    """risk: share of good documents that a stratum may lose to the rules; error: probability that any stratum loses more."""

    risk: float = 0.01
    error: float = 0.05
    rules: tuple = field(default=RULES)


def _let(value: str, name: str, body: str) -> str:
    """Bind ``value`` once for a body that names it inside lambdas."""
    return f"transform(array({value}), {name} -> {body})[0]"


def measures(text: str) -> str:
    """SQL for a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a text that is not null."""
    space = r"[\\x20\\x09-\\x0D]+"
    # positions of windows that share their hash with another, then the words they cover
    covered = _let(
        "sort_array(transform(h, (x, i) -> struct(x, i)))",
        "s",
        "aggregate(sort_array(transform(filter(sequence(0, size(s) - 1), k -> (k > 0 AND s[k].x = s[k - 1].x) OR (k < size(s) - 1 AND s[k].x = s[k + 1].x)), k -> s[k].i)), "
        "named_struct('n', 0, 'to', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.to), 'to', p + 3), a -> a.n)",
    )
    repeat = _let("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))", "h", f"if(size(array_distinct(h)) = size(h), 0, {covered})")
    words = _let(f"filter(split({text}, '{space}'), w -> w != '')", "w", f"named_struct('n', size(w), 'r', if(size(w) < 4, 0, {repeat}))")
    lines = _let(rf"filter(split({text}, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')", "x", "named_struct('n', size(x), 'd', size(x) - size(array_distinct(x)))")
    chars = rf"length(translate({text}, ' \t\n\u000b\u000c\r', ''))"
    symbols = f"length({text}) - length(translate({text}, '#*$%&|<>', ''))"
    pair = f"named_struct('w', {words}, 'l', {lines})"
    fields = {"n_words": "m.w.n", "word_chars": chars, "n_symbols": symbols, "n_dup_lines": "m.l.d", "n_repeat_words": "m.w.r", "n_lines": "m.l.n"}
    return _let(pair, "m", "named_struct(" + ", ".join(f"'{k}', cast({v} AS bigint)" for k, v in fields.items()) + ")")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def features(docs: DataFrame, toxic: list[str], id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_toxic (words in toxic) of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    measured = own.select("doc_id", "stratum", F.expr(measures("text")).alias("f"), F.expr(n_toxic("text", toxic)).alias("n_toxic"))
    return measured.select("doc_id", "stratum", *[F.col(f"f.{m}").alias(m) for m in MEASURES], "n_toxic")


def _letters(text: str) -> str:
    return rf"split(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}]+')"


def n_toxic(text: str, words: list[str]) -> str:
    """SQL for the number of words of a text, runs of letters with A-Z in lower case, that are in the lexicon."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"cast(size(filter({_letters(text)}, w -> w IN ({listed}))) AS bigint)" if words else "0L"


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def binomial_tail(n: str, k: str, rate: float) -> str:
    """SQL for P(Binomial(n, rate) <= k), 1 where k is at least the mean; terms are carried as logarithms."""
    step = f"a.t + ln(({n} - i + 1) / i) + ln({rate!r}D / (1 - {rate!r}D))"
    total = f"aggregate(sequence(1, {k}), named_struct('t', {n} * ln(1 - {rate!r}D), 'p', exp({n} * ln(1 - {rate!r}D))), (a, i) -> named_struct('t', {step}, 'p', a.p + exp({step})), a -> a.p)"
    return f"CASE WHEN {k} >= {n} * {rate!r}D THEN 1D WHEN {k} = 0 THEN exp({n} * ln(1 - {rate!r}D)) ELSE {total} END"


def _labelled(measured: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The measured documents that have labels and pass the base rule, with good."""
    good = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(F.expr("coalesce(quality = 1 AND toxic = 0, false)")).alias("good"))
    return measured.where(f"NOT ({BASE_FAILED})").join(good, "doc_id")


#: SQL for the labelled documents that choose the rules' strictness, a quarter; the others test it.
CHOOSES = "substring(md5(cast(doc_id AS string)), 1, 1) IN ('0', '1', '2', '3')"


#: Words of the lexicon at most, and in how many toxic documents and how much more often than in good ones a word of it is.
MOST_WORDS, LEAST_DOCS, LEAST_SHARE, LEAST_LIFT = 256, 5, 0.05, 20


def lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> list[str]:
    """Words that mark documents labelled toxic in some stratum, the most frequent first.

    Compared are documents labelled quality 1, which differ by the toxic label alone: all that are
    toxic with the choosing quarter of those that are not, so that the testing ones have no part in it.
    """
    kinds = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(F.expr("coalesce(quality = 1, false)")).alias("fine"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"), F.min(F.expr("coalesce(toxic = 0, false)")).alias("good"))
    kinds = materialise(kinds.where(f"fine AND (toxic OR good AND {CHOOSES})").select("doc_id", "toxic"), "kinds")
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # texts stay where they are: the ids that choose go to them, a block at a time
    blocks, found = max(1, -(-kinds.count() // MOST_BROADCAST)), None
    for block in range(blocks):
        ids = kinds.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block)
        held = own.join(F.broadcast(ids), "doc_id")
        # the empty word is in every document and counts them
        held = held.select("stratum", "toxic", F.explode(F.expr(f"array_union(array(''), array_distinct({_letters('text')}))")).alias("word"))
        counted = materialise(held.groupBy("stratum", "word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("g")), "words")
        found = counted if found is None else found.union(counted)
    words = found if blocks == 1 else materialise(found.groupBy("stratum", "word").agg(F.sum("t").alias("t"), F.sum("g").alias("g")), "words")
    sizes = words.where("word = ''").select("stratum", F.col("t").alias("all_t"), F.col("g").alias("all_g"))
    marked = words.where(f"word != '' AND t >= {LEAST_DOCS}").join(sizes, "stratum").where(f"t >= {LEAST_SHARE} * all_t AND t * (all_g + 1) >= {LEAST_LIFT} * all_t * (g + 0.5)")
    return [r["word"] for r in marked.groupBy("word").agg(F.sum("t").alias("t")).orderBy(F.desc("t"), "word").limit(MOST_WORDS).collect()]


def cutoffs(measured: DataFrame, labels: DataFrame, control: Control = Control(), id_col: str = "doc_id") -> DataFrame:
    """(stratum, cut: map from rule to cutoff), so that with probability 1 - error no stratum loses more than a share risk of its good documents to all rules together.

    A rule may become as strict as the choosing documents allow. The rule that then rejects
    most documents labelled not good is tightened first, cutoff by cutoff, then the next. Each
    step rejects what the one before it does, so the strictest whose test passes ends the
    fixed sequence from the laxest.
    """
    rules = range(len(control.rules))
    levels = max(len(cuts) for _, _, cuts in control.rules)
    steps, share = range(len(rules) * levels), control.risk / (2 * len(rules))
    # the laxest cutoff a document exceeds, -1 if none
    past = ["CASE " + " ".join(f"WHEN {ratio} > {cuts[at]!r}D THEN {at}" for at in reversed(range(len(cuts)))) + f" ELSE -1 END AS u{r}" for r, (_, ratio, cuts) in enumerate(control.rules)]
    held = materialise(_labelled(measured, labels, id_col).selectExpr("stratum", "good", f"{CHOOSES} AS chooses", *past), "held")
    counts = held.where("good AND chooses").groupBy("stratum").agg(F.count("*").alias("c"), *[F.count_if(F.expr(f"u{r} >= {at}")).alias(f"k{r}_{at}") for r in rules for at in range(levels)])
    strictest = ["CASE " + " ".join(f"WHEN k{r}_{at} <= c * {share!r}D THEN {at}" for at in range(levels)) + f" ELSE {levels} END AS s{r}" for r in rules]
    chosen = counts.selectExpr("stratum", *strictest)
    caught = held.where("NOT good").join(chosen, "stratum").groupBy("stratum").agg(*[F.count_if(F.expr(f"u{r} >= s{r}")).alias(f"b{r}") for r in rules])
    order = "transform(sort_array(array(" + ", ".join(f"struct(-coalesce(b{r}, 0) AS b, {r} AS r)" for r in rules) + ")), x -> x.r)"
    ordered = chosen.join(caught, "stratum", "left").selectExpr("stratum", *[f"s{r}" for r in rules], f"{order} AS turns")
    first = "array_min(array(" + ", ".join([str(len(steps)), *[f"if(u{r} >= s{r}, (array_position(turns, {r}) - 1) * {levels} + {levels - 1} - u{r}, {len(steps)})" for r in rules]]) + "))"
    tested = held.where("good AND NOT chooses").join(ordered, "stratum").withColumn("first", F.expr(first))
    sums = tested.groupBy("stratum", "turns", *[f"s{r}" for r in rules]).agg(F.count("*").alias("n"), *[F.count_if(F.expr(f"first <= {j}")).alias(f"k{j}") for j in steps])
    able = sums.where(f"{binomial_tail('n', '0', control.risk)} <= {control.error!r}D")
    tails = able.select("*", F.expr("array(" + ", ".join(binomial_tail("n", f"k{j}", control.risk) for j in steps) + ")").alias("p")).withColumn("whole", F.element_at("p", -1))
    every, upto = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("whole", "stratum")
    ranked = tails.withColumn("of", F.count("*").over(every)).withColumn("rank", F.row_number().over(upto))
    done = ranked.withColumn("done", F.min(F.expr(f"whole <= {control.error!r}D / (of - rank + 1)")).over(upto))
    holm = done.withColumn("level", F.lit(control.error) / F.greatest(F.lit(1), F.col("of") - F.count_if("done").over(every)))
    at = holm.withColumn("step", F.expr("size(filter(p, x -> x <= level)) - 1")).where("step >= 0")
    reached = lambda r: f"greatest(s{r}, {levels} - 1 - (step - (array_position(turns, {r}) - 1) * {levels}))"
    pairs = ", ".join(f"named_struct('rule', '{rule}', 'cut', get(array({', '.join(f'{c!r}D' for c in cuts)}), cast({reached(r)} AS int)))" for r, (rule, _, cuts) in enumerate(control.rules))
    return at.select("stratum", F.expr(f"map_from_entries(filter(array({pairs}), x -> x.cut IS NOT NULL))").alias("cut"))


#: Rows of cutoffs (one a stratum) that are broadcast; more are joined.
MOST_STRATA = 10_000


def _fitted(docs: DataFrame, labels: DataFrame, control: Control, **columns) -> tuple[DataFrame, list[str], DataFrame]:
    """The features of every row, the lexicon, and (__stratum, __cut)."""
    toxic = lexicon(docs, labels, **columns)
    measured = materialise(features(docs, toxic, **columns), "features")
    safe = materialise(cutoffs(measured, labels, control).select(F.col("stratum").alias("__stratum"), F.col("cut").alias("__cut")), "cutoffs")
    return measured, toxic, F.broadcast(safe) if safe.count() <= MOST_STRATA else safe


def _failed(control: Control) -> str:
    return " OR ".join(f"coalesce({ratio} > __cut['{rule}'], false)" for rule, ratio, _ in control.rules)


def judge(docs: DataFrame, labels: DataFrame, control: Control = Control(), **columns) -> DataFrame:
    """The features of every row, base_failed, and kept."""
    measured, _, safe = _fitted(docs, labels, control, **columns)
    judged = measured.join(safe, F.col("stratum") == F.col("__stratum"), "left")
    return judged.select(*measured.columns, F.expr(BASE_FAILED).alias("base_failed"), F.expr(f"NOT ({BASE_FAILED} OR {_failed(control)})").alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, control: Control = Control(), text_col: str = "text", stratum_col: str = "lang", **columns) -> DataFrame:
    """The rows of docs that the rules keep, as they are. The verdict is one expression over the text beside it, so that texts need no shuffle and are counted once here, and once for the cutoffs."""
    _, toxic, safe = _fitted(docs, labels, control, text_col=text_col, stratum_col=stratum_col, **columns)
    stratum, cut = fresh(docs, "__stratum"), fresh(docs, "__cut")
    text = f"coalesce(`{text_col}`, '')"
    verdict = f"NOT ({BASE_FAILED} OR {_failed(control)})".replace("__cut[", f"`{cut}`[")
    verdict = re.sub(rf"\b({'|'.join(MEASURES)})\b", r"f.\1", verdict)
    verdict = re.sub(r"\bn_toxic\b", lambda _: n_toxic(text, toxic), verdict)
    judged = docs.join(safe.toDF(stratum, cut), F.coalesce(docs[f"`{stratum_col}`"], F.lit("")) == F.col(stratum), "left")
    return judged.where(_let(measures(text), "f", verdict)).select(*[docs[f"`{c}`"] for c in docs.columns])


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of the contract: doc_id, the counts, base_failed and kept."""
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
