"""Boolean retrieval: a small query language compiled to one column over term flags.

Letters, numbers, ``_`` and ``-`` make words; any other character separates them. Operators, in any
case, bind by the table ``BINDS``; operands side by side are joined by AND. NOT, or a minus before
a word, takes the one operand after it; parentheses group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.text import stem_word, tokenize_text
from lexigraph.operators.index import Index
from lexigraph.operators.ranking import BM25Config, best_first, bm25_terms, search

#: Operators between two operands, and how tightly they bind.
BINDS = {"OR": 1, "AND": 2}
PART = re.compile(r"[()]|(-?)([\w-]+)")


@dataclass(frozen=True)
class Expr:
    """A word (no parts), a negation (one part) or a conjunction or disjunction (two)."""

    head: str
    parts: tuple[Expr, ...] = ()

    def __str__(self) -> str:
        if not self.parts:
            return self.head
        if len(self.parts) == 1:
            return f"{self.head} {self.parts[0]}"
        return "(" + f" {self.head} ".join(map(str, self.parts)) + ")"

    def words(self, positive_only: bool = False) -> Iterator[str]:
        """In order, with repeats; without those below a NOT if asked."""
        if not self.parts:
            yield self.head
        elif not (positive_only and self.head == "NOT"):
            for part in self.parts:
                yield from part.words(positive_only)

    def fold(self, word, combine: dict):
        """What the expression comes to, when words stand for word(...) and operators for functions."""
        return combine[self.head](*(p.fold(word, combine) for p in self.parts)) if self.parts else word(self.head)


def _parts(query: str) -> Iterator[str | Expr]:
    """Operators and parentheses as strings, words as expressions. A minus alone says nothing."""
    for m in PART.finditer(query):
        minus, word = m[1], m[2]
        if word is None:
            yield m[0]
        elif minus:
            yield "NOT"
            yield Expr(stem_word(word.lower()))
        elif word.upper() in (*BINDS, "NOT"):
            yield word.upper()
        elif word != "-":
            yield Expr(stem_word(word.lower()))


def parse(query: str) -> Expr | None:
    """The expression, or None if it cannot be read. Words are stemmed, and neither stop words nor short ones are left out.

    Precedence climbing. A closing parenthesis may be missing; what follows one too many is not read.
    """
    left = list(_parts(query))[::-1]

    def operand(may_negate: bool = True) -> Expr:
        part = left.pop() if left else None
        if isinstance(part, Expr):
            return part
        if part == "(":
            inner = climb(1)
            if left and left[-1] == ")":
                left.pop()
            return inner
        if part == "NOT" and may_negate:
            return Expr("NOT", (operand(False),))
        raise SyntaxError(query)

    def climb(least: int) -> Expr:
        found = operand()
        while left and left[-1] != ")":
            said = left[-1] if left[-1] in BINDS else "AND"
            if BINDS[said] < least:
                break
            if left[-1] == said:
                left.pop()
            found = Expr(said, (found, climb(BINDS[said] + 1)))
        return found

    try:
        return climb(1)
    except SyntaxError:
        return None


COLUMNS = {"AND": Column.__and__, "OR": Column.__or__, "NOT": Column.__invert__}
TRUTH = {"AND": lambda a, b: a and b, "OR": lambda a, b: a or b, "NOT": lambda a: not a}


def matching(index: Index, expr: Expr) -> DataFrame:
    """doc_id of documents that satisfy the expression: one scan of its terms' postings, one flag a term."""
    words = sorted(set(expr.words()))
    hits = index.postings.where(F.col("term").isin(words))
    flags = hits.groupBy("doc_id").agg(*[F.max(F.col("term") == w).alias(f"f{i}") for i, w in enumerate(words)])
    flag = {w: F.coalesce(F.col(f"f{i}"), F.lit(False)) for i, w in enumerate(words)}
    if expr.fold(lambda w: False, TRUTH):  # documents without any of the words match, too
        flags = index.doc_stats.select("doc_id").join(flags, "doc_id", "left")
    return flags.where(expr.fold(flag.__getitem__, COLUMNS)).select("doc_id")


def matching_by_sets(index: Index, expr: Expr) -> DataFrame:
    """The same documents by set operations, as the expression is written."""
    every = index.doc_stats.select("doc_id")
    sets = {
        "AND": lambda a, b: a.join(b, "doc_id", "left_semi"),
        "OR": lambda a, b: a.unionAll(b).distinct(),
        "NOT": lambda a: every.join(a, "doc_id", "left_anti"),
    }
    return expr.fold(lambda w: index.get_postings(w).select("doc_id"), sets)


@dataclass
class BooleanResult:
    results: DataFrame
    matches: DataFrame | None
    expression: Expr | None

    def matching_docs(self) -> int:
        return 0 if self.matches is None else self.matches.count()


def boolean_search(index: Index, query: str, k: int = 50, config: BM25Config = BM25Config(), candidate_factor: int | None = 10) -> BooleanResult:
    """Matching documents by BM25 over the positive words, which are tokenized once more; none if there are no such words."""
    expr = parse(query)
    if expr is None:
        return BooleanResult(search(index, "", k, config), None, None)
    matches = matching(index, expr)
    scoring = tokenize_text(" ".join(expr.words(positive_only=True)))
    rows = bm25_terms(index, [scoring], config).select("doc_id", "score", "matched_terms")
    if candidate_factor is not None:
        rows = rows.orderBy(*best_first()).limit(k * candidate_factor)
    rows = rows.join(matches, "doc_id", "left_semi").orderBy(*best_first()).limit(k)
    return BooleanResult(rows, matches, expr)
