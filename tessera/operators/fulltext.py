"""Full-text search (inventory 2.H): query rewriting, postings, matching, BM25.

A query is words (all of them have to match), ``"phrases"``, ``prefix*`` and the operators AND,
OR and NOT in capitals.  Whatever is typed is a query; what can not match is left out.
"""

from __future__ import annotations

import string
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import tokens_of
from tessera.plans.scratch import kept
from tessera.plans.ship import ensure

OPERATORS = ("AND", "OR", "NOT")
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
K1, B = 1.2, 0.75
FLOOR = 1e-6


@dataclass(frozen=True)
class Term:
    """Neighbouring tokens; the last may be a prefix."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    op: str
    left: Node | Term
    right: Node | Term


def words(text: str) -> list[tuple[str, bool, bool]]:
    """``(text, quoted, starred)``: a quote opens or closes a phrase, a star outside marks what
    it follows, an open quote ends with the text."""
    out: list[list] = []
    held: list[str] = []
    quoted = False

    def close(starred: bool = False, as_quoted: bool | None = None) -> bool:
        if held:
            out.append(["".join(held), quoted if as_quoted is None else as_quoted, starred])
            held.clear()
            return True
        return False

    for c in text:
        if c == '"':
            close()
            quoted = not quoted
        elif c == "*" and not quoted:
            if not close(starred=True) and out:
                out[-1][2] = True
        elif c.isspace() and not quoted:
            close()
        else:
            held.append(c)
    close()
    return [tuple(w) for w in out]


def pieces(text: str) -> list[str | Term]:
    """Terms and operators, without operators that have nothing on their left or at the end,
    and with the last word as a prefix."""
    found: list[tuple[str | Term, bool]] = []
    for word, quoted, starred in words(text):
        if not quoted and word in OPERATORS:
            if found and not isinstance(found[-1][0], str):
                found.append((word, False))
            continue
        tokens = "".join(c if c.isalnum() else " " for c in word).split()
        if quoted and tokens:
            found.append((Term(tuple(tokens), starred), False))
        elif tokens:
            found += [(Term((t,)), False) for t in tokens[:-1]]
            found.append((Term((tokens[-1],), starred), not starred))
    while found and isinstance(found[-1][0], str):
        found.pop()
    if found and found[-1][1]:
        found[-1] = (Term(found[-1][0].tokens, True), False)
    return [p for p, _ in found]


def rewritten(text: str) -> str | None:
    """The query as a match string, or None if nothing in it can be searched for."""
    found = pieces(text)
    shown = [p if isinstance(p, str) else f'"{" ".join(p.tokens)}"' + "*" * p.prefix for p in found]
    return " ".join(shown) or None


def parse(text: str) -> Node | Term | None:
    """Predicate tree: words side by side bind closest, then NOT, AND and OR, each to the left."""
    found = pieces(text)
    if not found:
        return None
    groups: list[Node | Term | str] = []
    for p in found:
        if isinstance(p, str) or not groups or isinstance(groups[-1], str):
            groups.append(p)
        else:
            groups[-1] = Node("AND", groups[-1], p)
    for op in ("NOT", "AND", "OR"):
        out: list[Node | Term | str] = []
        i = 0
        while i < len(groups):
            if groups[i] == op:
                out[-1] = Node(op, out[-1], groups[i + 1])
                i += 2
            else:
                out.append(groups[i])
                i += 1
        groups = out
    return groups[0]


def fold(token: str) -> str:
    """Lower case without diacritics, as in the index."""
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))


def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold(x))


def postings(docs: DataFrame, fields: list[str], accents: bool = True) -> DataFrame:
    """``doc_id, field, pos, token``: runs of letters and digits, folded.

    Texts of ASCII only are folded in the JVM and go through no Python code but as nulls; without
    ``accents`` all are.
    """
    parts = []
    for i, name in enumerate(fields):
        text = F.coalesce(F.col(name), F.lit(""))
        if accents:
            ensure(docs.sparkSession)
            other = F.when(text.rlike(r"[^\x00-\x7f]"), text)
            text = F.coalesce(F.pandas_udf(_folded, "string")(other), F.lower(text))
        parts.append(docs.select("doc_id", F.lit(i).alias("field"), F.posexplode(tokens_of(text)).alias("pos", "token")))
    return reduce(DataFrame.unionByName, parts)


def searched_text(samples: DataFrame, tags: DataFrame) -> DataFrame:
    """File name, path and tags joined by spaces in the order of their names (H8, D3)."""
    joined = tags.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["name"]), " ")
    return samples.join(joined, "sample_id", "left").select(F.col("sample_id").alias("doc_id"), "filename", F.col("rel_path").alias("path"), F.coalesce(text, F.lit("")).alias("tags"))


def _counts(index: DataFrame, wanted: list[Term], every: bool) -> DataFrame:
    """``doc_id, n0, n1, ...``: how often each term begins in a text, from one reading of the index
    and one aggregation; with ``every`` also ``len``, and texts without any of the terms."""
    columns, places, here = [], [], F.lit(False)
    for i, term in enumerate(wanted):
        folded = [fold(t) for t in term.tokens]
        chain = None
        for k, token in enumerate(folded):
            match = F.col("token").startswith(token) if k == len(folded) - 1 and term.prefix else F.col("token") == token
            here = here | match
            columns.append(F.collect_list(F.when(match, F.col("pos") - k)).alias(f"p{i}_{k}"))
            found = F.col(f"p{i}_{k}")
            chain = found if chain is None else F.array_intersect(chain, found)
        places.append(F.size(chain).alias(f"n{i}"))
    length = [F.count(F.lit(1)).alias("len")] if every else []
    rows = (index if every else index.where(here)).groupBy("doc_id", "field").agg(*columns, *length)
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(wanted))]
    per_field = rows.select("doc_id", *places, *(["len"] if every else []))
    return per_field.groupBy("doc_id").agg(*sums, *([F.sum("len").alias("len")] if every else []))


def _condition(query: Node | Term, order: dict[int, int]) -> Column:
    if isinstance(query, Term):
        return F.col(f"n{order[id(query)]}") > 0
    left, right = _condition(query.left, order), _condition(query.right, order)
    return left | right if query.op == "OR" else left & right if query.op == "AND" else left & ~right


def _leaves(query: Node | Term) -> list[Term]:
    return [query] if isinstance(query, Term) else _leaves(query.left) + _leaves(query.right)


def matching(index: DataFrame, query: Node | Term) -> DataFrame:
    """Distinct ``doc_id`` that match: the index is read once, however many terms there are."""
    leaves = _leaves(query)
    return _counts(index, leaves, False).where(_condition(query, {id(t): i for i, t in enumerate(leaves)})).select("doc_id")


def terms(query: Node | Term) -> list[Term]:
    """Terms that count towards the rank: not those behind a NOT."""
    if isinstance(query, Term):
        return [query]
    return terms(query.left) + ([] if query.op == "NOT" else terms(query.right))


def ranked(index: DataFrame, query: Node | Term, n_docs: int | None = None, limit: int | None = None) -> DataFrame:
    """``doc_id, rank`` of matching texts, best (lowest) rank first, ties by id.

    ``n_docs`` is the number of indexed texts, those without tokens included.
    """
    leaves = _leaves(query)
    order = {id(t): i for i, t in enumerate(leaves)}
    counts = kept(_counts(index, leaves, True))
    scored = [order[id(t)] for t in terms(query)]
    facts = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens"), *(F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in scored))
    both = counts.where(_condition(query, order)).crossJoin(F.broadcast(facts))  # one row of counts
    every = F.lit(n_docs).cast("double") if n_docs is not None else F.col("n").cast("double")
    share = K1 * (1 - B + B * F.col("len") / (F.col("tokens") / every))
    rank = F.lit(0.0)
    for i in scored:
        idf = F.log((every - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"n{i}")
        rank = rank - F.when(tf > 0, F.when(idf <= 0, FLOOR).otherwise(idf) * tf * (K1 + 1) / (tf + share)).otherwise(0.0)
    found = both.select("doc_id", rank.alias("rank")).orderBy("rank", "doc_id")
    return found if limit is None else found.limit(limit)
