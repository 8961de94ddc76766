"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dyadica.llm import bpe, chat, decontaminate, lm, pii, quality, shard, simhash, substring, warc

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(operator, *tables):
    return lambda spark, sf_dir: operator(*[_table(spark, sf_dir, t) for t in tables])


QUERIES = {
    "op1_simhash": _of(simhash.op1, "documents"),
    "op2_substring": _of(substring.op2, "documents"),
    "op3_pii": _of(pii.op3, "documents"),
    "op4_lm": _of(lm.op4, "documents"),
    "op5_quality": _of(quality.op5, "documents", "labels"),
    "op6_bpe": _of(lambda docs: bpe.op6(docs, public_tokenizers.path(TOKENIZER)), "documents"),
    "op7_chat": _of(chat.op7, "conversations"),
    "op8_warc": _of(warc.op8, "pages"),
    "op9_shard": _of(shard.op9, "documents"),
    "op10_decontaminate": _of(decontaminate.op10, "documents", "benchmark"),
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 19, 0))) AS s FROM w)),
late AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS pos FROM late, range(20) AS t(o)),
tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM w)
SELECT w.doc_id, any_value(len(ws))::BIGINT AS n_words, count(gone.pos)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY tok.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN tok USING (doc_id) LEFT JOIN gone ON gone.doc_id = tok.doc_id AND gone.pos = tok.pos
GROUP BY w.doc_id
"""


def _op5(control: quality.Control = quality.Control()) -> str:
    """The rules, their lexicon and their tests, written out rule by rule and step by step."""
    rules, levels = list(enumerate(control.rules)), max(len(cuts) for _, _, cuts in control.rules)
    steps, share = len(rules) * levels, control.risk / (2 * len(rules))
    each = lambda form, glue=", ": glue.join(form(r) for r, _ in rules)  # noqa: E731
    past = ", ".join("CASE " + " ".join(f"WHEN ({ratio})::DOUBLE > {cuts[at]!r}::DOUBLE THEN {at}" for at in reversed(range(levels))) + f" ELSE -1 END AS u{r}" for r, (_, ratio, cuts) in rules)
    strict = each(lambda r: "CASE " + " ".join(f"WHEN count(*) FILTER (WHERE u{r} >= {at}) <= count(*) * {share!r}::DOUBLE THEN {at}" for at in range(levels)) + f" ELSE {levels} END AS s{r}")
    place = each(lambda r: " + ".join(f"(coalesce(b{q}, 0) > coalesce(b{r}, 0){f' OR coalesce(b{q}, 0) = coalesce(b{r}, 0)' if q < r else ''})::INT" for q, _ in rules if q != r) + f" AS o{r}")
    first = each(lambda r: f"CASE WHEN u{r} >= s{r} THEN o{r} * {levels} + {levels - 1} - u{r} ELSE {steps} END")
    tail = lambda k: f"CASE WHEN {k} >= n * {control.risk!r}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({control.risk!r}::DOUBLE) + (n - i) * ln(1 - {control.risk!r}::DOUBLE)))) END"  # noqa: E731
    cuts = ", ".join(f"([{', '.join(map(repr, c))}]::DOUBLE[])[greatest(s{r}, {levels - 1} - (step - o{r} * {levels})) + 1] AS c{r}" for r, (_, _, c) in rules)
    failed = " OR ".join(f"coalesce(({ratio})::DOUBLE > c{r}, false)" for r, (_, ratio, _) in rules)
    chooses = "substring(md5(doc_id::VARCHAR), 1, 1) IN ('0', '1', '2', '3')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS ws,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}]+') AS letters,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS ls FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n
      FROM (SELECT doc_id, i, ws[i + 1 : i + 3] AS k FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 2, 0))) AS i FROM d))),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, range(3) AS t(o) WHERE g.n > 1 GROUP BY doc_id),
lab AS (SELECT doc_id, bool_and(coalesce(quality = 1, false)) AS fine, bool_or(coalesce(toxic = 1, false)) AS toxic, bool_and(coalesce(toxic = 0, false)) AS nice,
               bool_and(coalesce(quality = 1 AND toxic = 0, false)) AS good FROM labels GROUP BY doc_id),
said AS (SELECT stratum, word, count(*) FILTER (WHERE toxic) AS t, count(*) FILTER (WHERE NOT toxic) AS g
         FROM (SELECT stratum, toxic, unnest(list_distinct(list_append(letters, ''))) AS word FROM d JOIN lab USING (doc_id) WHERE fine AND (toxic OR nice AND {chooses})) GROUP BY ALL),
lex AS (SELECT word FROM said JOIN (SELECT stratum, t AS all_t, g AS all_g FROM said WHERE word = '') USING (stratum)
        WHERE word != '' AND t >= {quality.LEAST_DOCS} AND t >= {quality.LEAST_SHARE} * all_t AND t * (all_g + 1) >= {quality.LEAST_LIFT} * all_t * (g + 0.5)
        GROUP BY word ORDER BY sum(t) DESC, word LIMIT {quality.MOST_WORDS}),
f AS (SELECT d.doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             len(list_filter(letters, lambda x: list_contains(toxic_words, x)))::BIGINT AS n_toxic
      FROM d CROSS JOIN (SELECT coalesce(list(word), []) AS toxic_words FROM lex) LEFT JOIN r ON r.doc_id = d.doc_id),
held AS (SELECT stratum, good, {chooses} AS chooses, {past} FROM f JOIN lab USING (doc_id) WHERE NOT ({quality.BASE_FAILED})),
chosen AS (SELECT stratum, {strict} FROM held WHERE good AND chooses GROUP BY stratum),
caught AS (SELECT stratum, {each(lambda r: f"count(*) FILTER (WHERE u{r} >= s{r}) AS b{r}")} FROM held JOIN chosen USING (stratum) WHERE NOT good GROUP BY stratum),
ordered AS (SELECT chosen.*, {place} FROM chosen LEFT JOIN caught USING (stratum)),
tested AS (SELECT ordered.*, least({steps}, {first}) AS first FROM held JOIN ordered USING (stratum) WHERE good AND NOT chooses),
sums AS (SELECT {each(lambda r: f"s{r}, o{r}")}, stratum, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE first <= {j}) AS k{j}" for j in range(steps))} FROM tested GROUP BY ALL),
tails AS (SELECT *, [{", ".join(tail(f"k{j}") for j in range(steps))}]::DOUBLE[] AS p FROM sums WHERE (1 - {control.risk!r}::DOUBLE) ** n <= {control.error!r}::DOUBLE),
ranked AS (SELECT *, count(*) OVER () AS many, row_number() OVER (ORDER BY p[{steps}], stratum) AS rank FROM tails),
done AS (SELECT *, bool_and(p[{steps}] <= {control.error!r}::DOUBLE / (many - rank + 1)) OVER (ORDER BY rank) AS done FROM ranked),
levelled AS (SELECT *, {control.error!r}::DOUBLE / greatest(1, many - count(*) FILTER (WHERE done) OVER ()) AS level FROM done),
stepped AS (SELECT *, len(list_filter(p, lambda x: x <= level)) - 1 AS step FROM levelled),
safe AS (SELECT stratum, {cuts} FROM stepped WHERE step >= 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({quality.BASE_FAILED}) AS base_failed,
       NOT ({quality.BASE_FAILED} OR {failed}) AS kept
FROM f LEFT JOIN safe ON safe.stratum = f.stratum
"""


_CONTROL = r"[\[<]\\*(?:/?INST\]|(?:TURN|SAYS|NEXT|END)\]|/?s>)"
_OP7 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS more,
             length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars, length(role) + len(regexp_extract_all(role, '{_CONTROL}')) AS name FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(CASE WHEN more THEN 6 + chars ELSE 17 + name + chars END))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

_NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10 = rf"""
WITH d AS (SELECT doc_id, {_NORMAL} AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM (SELECT item_id, {_NORMAL} AS ws FROM benchmark) WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(ws[s + 1 : s + n], ' ') AS k
      FROM (SELECT item_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM b)),
c AS (SELECT doc_id, n, s, array_to_string(ws[s + 1 : s + n], ' ') AS k
      FROM (SELECT doc_id, ws, n, unnest(range(0, greatest(len(ws) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM g))),
hit AS (SELECT doc_id, c.n, s, item_id FROM c JOIN g USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT s + o) AS n FROM hit, range(10) AS t(o) WHERE o < hit.n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

ORACLES = {"op2_substring": _OP2, "op5_quality": _op5(), "op7_chat": _OP7, "op10_decontaminate": _OP10}
