"""Text to keywords, one output row per keyword."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

Tokenizer = Callable[[str], Iterable[str]]

# A keyword is an unbroken run of letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column | str) -> Column:
    """Array of lower-case words, computed inside the JVM."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(WORD), F.lit(0))


def tokenizer_column(text: Column, tokenizer: Tokenizer) -> Column:
    """Array of keywords made by a user's tokenizer, in Arrow batches."""

    @F.pandas_udf(ArrayType(StringType()))
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda value: None if value is None else [str(word) for word in tokenizer(value)])

    return tokenize(text)


def explode_keywords(
    df: DataFrame, text: str, keyword: str = "keyword", tokenizer: Tokenizer | None = None
) -> DataFrame:
    """One row per keyword of `text`; rows without a keyword vanish."""
    source = F.col(text)
    found = words(source) if tokenizer is None else tokenizer_column(source, tokenizer)
    return df.select("*", F.explode(found).alias(keyword))


def register_keyword_function(
    spark: SparkSession, name: str = "ik_analyze", tokenizer: Tokenizer | None = None
) -> None:
    """Register a SQL table function `name(text) -> word`.

    Used as `FROM t, LATERAL ik_analyze(t.text) AS k(keyword)`. Without a
    tokenizer it is a SQL function that stays inside the JVM.
    """
    if tokenizer is None:
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(body STRING) RETURNS TABLE (word STRING) "
            f"RETURN SELECT explode(regexp_extract_all(lower(body), '{WORD.replace(chr(92), chr(92) * 2)}', 0))"
        )
        return

    @F.udtf(returnType="word: string", useArrow=True)
    class Keywords:
        def eval(self, text: str):
            for word in tokenizer(text) if text is not None else ():
                yield (str(word),)

    spark.udtf.register(name, Keywords)
