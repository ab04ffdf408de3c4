"""Table functions (inventory 2.L)."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_TOKEN = regex.compile(r"[\p{L}\p{N}]+")


class Tokens:
    """Place and folded form of each token of a text; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            for i, match in enumerate(_TOKEN.finditer(text.lower())):
                yield i, match.group()


def register(spark: SparkSession) -> None:
    """Make ``tokens(text)`` known to SQL: ``select * from docs, lateral tokens(text)``."""
    spark.udtf.register("tokens", udtf(Tokens, returnType="pos: int, token: string"))
