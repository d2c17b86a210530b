"""Concept normalisation: lower case, lemmas, no stop words."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.functions.lemmas import lemma
from learngraph.schemas import STOPWORDS

_STOP = frozenset(STOPWORDS)


def rule_lemmatizer() -> Callable[[str], str]:
    return lemma


def normalize_concept(concept: str | None, lemmatize: Callable[[str], str] = lemma) -> str:
    return " ".join(lemmatize(w) for w in (concept or "").lower().split() if w not in _STOP)


def normalize(units: DataFrame, concepts: str = "concepts", out: str = "normalized_concepts", lemmatizer: Callable[[], Callable[[str], str]] = rule_lemmatizer, keep_empty: bool = False) -> DataFrame:
    """``units`` with the sorted distinct normalised concepts; those of stop words only are left out unless ``keep_empty``. The lemmatizer is made once per partition."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = lemmatizer()
        for s in parts:
            found = [{normalize_concept(c, of) for c in (cs if cs is not None else [])} for cs in s]
            yield pd.Series([sorted(f if keep_empty else f - {""}) for f in found])

    return units.withColumn(out, run(F.col(concepts)))
