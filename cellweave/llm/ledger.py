"""Quality rules as a bitmask ledger: every rule is evaluated once, its measurements and failure bits are kept as a table.

1. One pass over the texts measures whole numbers (words, characters, symbols, repeated lines and windows). Windows are
   compared by their words and not by hashes: ranks of pairs of words, of pairs of those, and of pairs of those.
2. Rules compare measurements; the bits of those that fail make one number. This is the ledger, and texts are not read again.
3. A policy is a version, a set of rules that reject alone and a set of which several must fail. It is a mask, so applying
   another version is a bitwise comparison over the ledger.
4. Ablations count documents by failure bits first, in the tasks; what each rule does under each policy is then worked out
   from distinct patterns of bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.store import stored
from cellweave.llm.textkit import chunks
from cellweave.llm.textkit import words as word_spans

WINDOW = 8  # words
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_distinct_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Rule:
    """Fails where a * left < b * right: whole numbers only, so that any engine decides alike. right None stands for 1."""

    name: str
    left: str
    a: int
    right: str | None
    b: int

    def fails(self) -> Column:
        return F.col(self.left) * self.a < (F.lit(self.b) if self.right is None else F.col(self.right) * self.b)

    def sql(self) -> str:
        return f"{self.a} * {self.left} < {self.b}" + (f" * {self.right}" if self.right else "")


#: The bit of a rule is its place here; new rules go to the end, so that ledgers already written keep their meaning.
RULES = (
    Rule("few_words", "n_words", 1, None, 20),
    Rule("repeated_windows", "n_words", 30, "n_repeat_words", 100),
    Rule("short_words", "word_chars", 1, "n_words", 2),
    Rule("long_words", "n_words", 15, "word_chars", 1),
    Rule("symbols", "n_words", 1, "n_symbols", 10),
    Rule("repeated_lines", "n_lines", 30, "n_dup_lines", 100),
    Rule("few_letters", "n_letter_words", 100, "n_words", 60),
    Rule("little_variety", "n_distinct_words", 50, "n_words", 1),
)


@dataclass(frozen=True)
class Policy:
    """Rejects where a rule of `any_of` fails, or at least `least` rules of `several`. Rules are named, not numbered."""

    version: str
    any_of: tuple[str, ...]
    several: tuple[str, ...] = ()
    least: int = 2

    def masks(self, rules: tuple[Rule, ...], without: str | None = None) -> tuple[int, int]:
        place = {r.name: i for i, r in enumerate(rules)}
        return tuple(sum(1 << place[n] for n in names if n != without) for names in (self.any_of, self.several))

    def rejects(self, bits: Column, rules: tuple[Rule, ...] = None, without: str | None = None) -> Column:
        """Whether failure bits are rejected; `without` leaves one rule out."""
        one, many = self.masks(rules or RULES, without)
        return (bits.bitwiseAND(F.lit(one)) != 0) | (F.bit_count(bits.bitwiseAND(F.lit(many))) >= self.least)

    def sql(self, bits: str, rules: tuple[Rule, ...] = None) -> str:
        one, many = self.masks(rules or RULES)
        return f"({bits} & {one} <> 0 OR bit_count({bits} & {many}) >= {self.least})"


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("strict-1", ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "few_letters", "little_variety")),
    Policy("balanced-1", ("few_words", "repeated_windows", "symbols"), ("short_words", "long_words", "repeated_lines", "few_letters", "little_variety"), 2),
)
CURRENT = POLICIES[2]


def _repeats(ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row in windows that the row has twice or more; ids are equal where words are, row ascends."""
    rank, width = ids.astype(np.int64), 1
    while width < WINDOW:  # rank i says which 2 * width words start at i
        if len(rank) <= width:
            return np.zeros(rows, np.int64)
        pair = rank[:-width] * (rank.max() + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    inside = row[: len(rank)] == row[WINDOW - 1 :]  # windows end with their document
    start = np.flatnonzero(inside)
    _, which, times = np.unique(row[start] * np.int64(len(rank) + 1) + rank[start], return_inverse=True, return_counts=True)
    twice = start[times[which] > 1]
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[twice] += 1
    np.subtract.at(cover, twice + WINDOW, 1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)


def _counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum(flags)])
    return at[offsets[1:]] - at[offsets[:-1]]


def _measured(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n, whole = len(offsets) - 1, data.tobytes()
    start, end, row = word_spans(data, offsets)
    seen: dict[bytes, int] = {}
    ids, distinct, lines, equal = [], np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        words = whole[a:b].split()  # of bytes: at 0x20 and 0x09 to 0x0D
        ids += [seen.setdefault(w, len(seen)) for w in words]
        distinct[i] = len(set(words))
        full = [x for x in whole[a:b].split(b"\n") if x.strip()]
        lines[i], equal[i] = len(full), len(full) - len(set(full))
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    return [
        np.bincount(row, minlength=n), _counted(~_SPACE[data] & ((data & 0xC0) != 0x80), offsets), _counted(_SYMBOL[data], offsets), equal,
        _repeats(np.array(ids, np.int64), row, n), lines, np.bincount(row[letters[end] > letters[start]], minlength=n), distinct,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column("text")):
            found = _measured(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *map(pa.array, found)], names=["id", *MEASURES])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, measurements, fail_bits) of every row; a rule that fails sets its bit.

    Null text counts as empty: all measurements are 0, so it has few words and fails no rule that compares shares. Rows
    are independent: ids may repeat or be null, empty tables give no rows, other columns are ignored.
    """
    if len(rules) > 63:
        raise ValueError("a ledger has room for 63 rules")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = rows.mapInArrow(_measure, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(r.fails(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules)])
    return measured.withColumn("fail_bits", bits).withColumnRenamed("id", id_col)


def write_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations read it, and the texts are not read again."""
    return stored(ledger(docs, rules, id_col, text_col), "ledger")


def apply(book: DataFrame, policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with policy (its version), base_failed, kept (false where base failed), and rejected_by, the bits that led to it."""
    bits = F.col("fail_bits")
    base = BASE.rejects(bits, rules)
    rejected = base | policy.rejects(bits, rules)
    counted = sum(BASE.masks(rules)) | sum(policy.masks(rules))
    return book.select(
        "*", F.lit(policy.version).alias("policy"), base.alias("base_failed"), (~rejected).alias("kept"),
        F.when(rejected, bits.bitwiseAND(F.lit(counted))).otherwise(F.lit(0).cast("long")).alias("rejected_by"),
    )


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, rule, failed, rejected, alone, regained): what each rule of each policy does.

    failed: documents that fail it; rejected: those of them that the policy rejects; alone: those that fail nothing else
    that the policy looks at; regained: documents kept if the rule were left out. Documents are counted by bits first, at
    most 2^rules patterns however many documents there are, and policies meet patterns, not documents.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    bits, cells = F.col("fail_bits"), []
    for policy in policies:
        used = sum(policy.masks(rules))
        now = policy.rejects(bits, rules)
        for i, rule in enumerate(rules):
            if used >> i & 1:
                failed = bits.bitwiseAND(F.lit(1 << i)) != 0
                cells.append(
                    F.struct(
                        F.lit(policy.version).alias("policy"), F.lit(rule.name).alias("rule"), failed.alias("failed"), (failed & now).alias("rejected"),
                        (bits.bitwiseAND(F.lit(used)) == 1 << i).alias("alone"), (now & ~policy.rejects(bits, rules, rule.name)).alias("regained"),
                    )
                )
    each = patterns.select("n", F.inline(F.array(*cells)))
    total = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0).cast("long"))).alias(c)
    return each.groupBy("policy", "rule").agg(*map(total, ("failed", "rejected", "alone", "regained")))


def verdicts(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """(doc_id, measurements, fail_bits, policy, base_failed, kept, rejected_by) of every document, by way of its ledger."""
    return apply(ledger(docs), policy)


def _oracle(policy: Policy) -> str:
    word = r"[^\x20\x09-\x0D]+"
    bits = " | ".join(f"CASE WHEN {r.sql()} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{word}') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
pos AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
eight AS (SELECT k, i, {" || ' ' || ".join(["word"] + [f"lead(word, {j}) OVER o" for j in range(1, WINDOW)])} AS win FROM pos WINDOW o AS (PARTITION BY k ORDER BY i)),
win AS (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM eight WHERE win IS NOT NULL),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM win, range({WINDOW}) r(j) WHERE n > 1 GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_letter_words, len(list_distinct(w))::BIGINT AS n_distinct_words
      FROM w LEFT JOIN rep USING (k)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m),
v AS (SELECT *, {BASE.sql("fail_bits")} AS base_failed, {policy.sql("fail_bits")} AS worse FROM b)
SELECT doc_id, {", ".join(MEASURES)}, fail_bits, '{policy.version}' AS policy, base_failed, NOT (base_failed OR worse) AS kept,
       (CASE WHEN base_failed OR worse THEN fail_bits & {sum(BASE.masks(RULES)) | sum(policy.masks(RULES))} ELSE 0 END)::BIGINT AS rejected_by FROM v"""


ORACLE = _oracle(CURRENT)
