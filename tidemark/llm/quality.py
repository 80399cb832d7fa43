"""Quality rules as a short-circuit cascade.

On a sample, each rule's rejections and its cost are measured among the texts that the rules before it let through, with
what these have measured already at hand; the rule with most rejections a second comes next. A text is not looked at
again after its first failure.
"""

import copy
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import own_names, text_batches, text_udf

SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Measured:
    """A text and what rules measure of it, each at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\f\r"))

    @cached_property
    def symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def dup_lines(self) -> int:
        lines = [x for x in self.text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        return len(lines) - len(set(lines))

    @cached_property
    def repeat_words(self) -> int:
        return repeated_words(self.words)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Windows get exact numbers by doubling: pairs, pairs of pairs, ..."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        ids = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(ids, return_inverse=True)[1]
        width += step
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: len(again)] += again
    edge[window : window + len(again)] -= again
    return int((np.cumsum(edge)[:n] > 0).sum())


@dataclass(frozen=True)
class Rule:
    """rejects(m) is true if the text is to go."""

    name: str
    rejects: Callable[[Measured], bool]


def _upper_case(m: Measured) -> bool:
    return 2 * sum(w.isupper() and len(w) > 1 for w in m.words) > len(m.words)


#: What the base test and the further rules reject. Each looks for a defect that clean prose doesn't have.
BASE = (
    Rule("few_words", lambda m: len(m.words) < 20),
    Rule("repeated_windows", lambda m: 100 * m.repeat_words > 30 * len(m.words)),
)
RULES = (
    Rule("symbol_marks", lambda m: m.symbols > 0.3 * len(m.words)),
    Rule("exclamations", lambda m: m.text.count("!") > 0.3 * len(m.words)),
    Rule("upper_case", _upper_case),
    Rule("duplicate_lines", lambda m: 2 * m.dup_lines > m.text.count("\n") + 1 and m.dup_lines > 2),
)


def order_rules(sample: list[str | None], rules: tuple[Rule, ...]) -> list[Rule]:
    """The cascade: rule after rule by rejections a second among the texts that are left; ties keep the given order.

    A rule's cost is what it adds: measures that earlier rules made are at hand.
    """
    left, rest, out = [Measured(t) for t in sample], list(rules), []
    while rest:
        worth = []
        for rule in rest:
            texts = [copy.copy(m) for m in left]
            began = time.perf_counter()
            rejected = sum(bool(rule.rejects(m)) for m in texts)
            worth.append((rejected + 0.5) / (len(texts) + 1) / max(time.perf_counter() - began, 1e-9))
        best = rest.pop(max(range(len(worth)), key=lambda k: (worth[k], -k)))
        out.append(best)
        left = [m for m in left if not best.rejects(m)]
    return out


def sample_texts(docs: DataFrame, text_col: str, sample_rows: int, max_bytes: int) -> list[str | None]:
    """About sample_rows rows from all parts of the table, those over max_bytes left out. They order the rules and decide nothing."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    t = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    t = t.sample(share, seed=1) if share < 1 else t
    return [r.t for r in t.where(F.coalesce(F.octet_length("t"), F.lit(0)) <= max_bytes).collect()]


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text_col: str = "text", sample_rows: int = 500, sample_bytes: int = 20_000) -> DataFrame:
    """docs with kept and rejected_by, the first rule in cascade order that rejects the text (null if kept).

    kept doesn't depend on the order; rejected_by does, and the order on measured times. A null text is an empty one.
    Columns of docs named like the results are replaced.
    """
    text_batches(docs)
    ordered = order_rules(sample_texts(docs, text_col, sample_rows, sample_bytes), rules)

    @text_udf("string")
    def first_failure(texts):
        return [next((r.name for r in ordered if r.rejects(m)), None) for m in map(Measured, texts)]

    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("kept", "rejected_by")]
    by, = own_names(docs, "first_failure")
    with_by = docs.withColumn(by, first_failure(F.col(f"`{text_col}`").cast("string")))
    return with_by.select(*cols, F.col(by).isNull().alias("kept"), F.col(by).alias("rejected_by"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500, sample_bytes: int = 20_000) -> DataFrame:
    """The base measures of every text, the base test, and the cascade's verdict.

    The base measures are returned for every row whatever fails, so the base test is read from them and only the further rules
    run as a cascade, on texts that pass it, with these measures at hand; quality_cascade() has the base rules in its cascade.
    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. A null text has none.
    Repeated rows give a row each; an empty table gives none.
    """
    text_batches(docs)
    passed = [t for t in sample_texts(docs, text_col, sample_rows, sample_bytes) if not any(r.rejects(Measured(t)) for r in BASE)]
    ordered = order_rules(passed, RULES)

    @text_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    def measure(texts):
        out = []
        for text in texts:
            m = Measured(text)
            row = (len(m.words), m.word_chars, m.symbols, m.dup_lines, m.repeat_words)
            base = any(r.rejects(m) for r in BASE)
            out.append((*row, base, not base and not any(r.rejects(m) for r in ordered)))
        return out

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), measure(F.col(f"`{text_col}`").cast("string")).alias("m"))
    return rows.select(F.col("id").alias(id_col), "m.*")
