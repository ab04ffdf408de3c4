"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure
bit for each rule.  A policy is a bit mask with a version, so verdicts of any policy, and how
much each rule contributes to one, come from the ledger by bitwise operations alone.

Only DataFrame functions are used; a document's work stays in its row, so nothing is shuffled.
Defined results: a null text has no words and fails ``few_words``; an empty table gives an
empty ledger; repeated rows are judged one by one; a null id is carried.  Windows of five
words are told apart by 64-bit xxHash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frame import SPLIT, WHITE, Frame, let, words

WINDOW = 5

#: Rules in the order of their bits: name -> SQL over the measurements, true where a text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Policy version -> mask of the rules that reject.
POLICIES: dict[int, int] = {1: BIT["few_words"] | BIT["repeated_words"], 2: sum(BIT.values())}
PRODUCTION = 2


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""

    def starts(by_hash: Column) -> Column:
        return F.filter(
            by_hash,
            lambda x, i: ((i > 0) & (F.get(by_hash, i - 1)["h"] == x["h"]))
            | F.coalesce(F.get(by_hash, i + 1)["h"] == x["h"], F.lit(False)),
        )

    def total(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(at, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(by_hash, lambda s: let(F.array_sort(F.transform(starts(s), lambda x: x["i"])), total))


def repeat_words(w: Column) -> Column:
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    )
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(counted)


def measurements(text: Column) -> Column:
    """One struct of all measurements of a text."""
    text = F.coalesce(text, F.lit(""))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split(text, r"\p{Lu}")) - 1).cast("long").alias("n_upper"),
    )


MEASURED = {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_upper": "n_upper"}


def ledger(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measurements and ``fail_bits``: one row for each row of ``documents``."""
    frame = Frame(documents)
    measured = frame.df.select(frame.col(key).alias(key), measurements(frame.col(text)).alias("m"))
    flat = measured.select(key, *(F.col(f"m.{path}").alias(name) for name, path in MEASURED.items()))
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES.items()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return flat.withColumn("fail_bits", mask)


def passes(fail_bits: Column, policy: int) -> Column:
    return fail_bits.bitwiseAND(F.lit(POLICIES[policy])) == 0


def judged(documents: DataFrame, policy: int = PRODUCTION) -> DataFrame:
    """The ledger with the verdicts of the base policy and of ``policy``."""
    found = ledger(documents)
    base = passes(F.col("fail_bits"), 1)
    return found.withColumn("base_failed", ~base).withColumn("kept", base & passes(F.col("fail_bits"), policy))


def ablation(ledgers: DataFrame, policy: int = PRODUCTION) -> DataFrame:
    """For each rule of a policy: how many texts fail it, and how many only for it.

    The ledger is first counted by failure bits (at most 2^rules groups), the rest is
    bitwise arithmetic over those groups.
    """
    mask = POLICIES[policy]
    groups = ledgers.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & mask)))
    rows = groups.withColumn("r", rules).select("bits", "n", "r.rule", "r.bit")
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_only_this"),
    )


def keep_good(documents: DataFrame, policy: int = PRODUCTION) -> DataFrame:
    """The rows whose text passes ``policy``, with all their columns."""
    frame = Frame(documents)
    measured = frame.df.withColumn("m", measurements(frame.col("text")))
    flat = measured.select("*", *(F.col(f"m.{path}").alias(name) for name, path in MEASURED.items()))
    failed = F.lit(False)
    for name, rule in RULES.items():
        if POLICIES[policy] & BIT[name]:
            failed = failed | F.expr(rule)
    return frame.restore(flat.where(~failed))


#: The same for DuckDB.
ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, unnest(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as word,
         generate_subscripts(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) as pos
  from t),
g as (
  select doc_id, pos, word, case when lead(pos, 4) over p is not null then
    word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p || ' ' || lead(word, 3) over p || ' ' || lead(word, 4) over p end as gram
  from w window p as (partition by doc_id order by pos)),
f as (select *, case when gram is not null and count(*) over (partition by doc_id, gram) > 1 then 1 else 0 end as twice from g),
c as (select *, max(twice) over (partition by doc_id order by pos rows between 4 preceding and current row) as covered from f),
per as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars, sum(covered) as n_repeat_words from c group by doc_id),
lines as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) as n_upper from t),
m as (
  select lines.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
         n_symbols::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines, n_upper::bigint as n_upper
  from lines left join per on lines.doc_id = per.doc_id),
b as (
  select *, (case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 2 * n_words then 4 else 0 end + case when 100 * n_dup_lines > 60 * n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 20 * n_words then 16 else 0 end
    + case when 2 * n_upper > word_chars then 32 else 0 end)::int as fail_bits from m)
select *, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept from b
"""
