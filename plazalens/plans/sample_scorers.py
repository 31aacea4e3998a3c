"""Stand-in scorers for the model plug point: texts in, category and explanation out."""

import pandas as pd


def by_length(texts: pd.Series) -> pd.DataFrame:
    category = texts.str.len().gt(1000).map({True: "political_general", False: "general"})
    return pd.DataFrame({"category": category, "explanation": "by length"})


def refusing(texts: pd.Series) -> pd.DataFrame:
    """Fails on some texts, as a model server may."""
    if texts.str.contains("Todos a las calles", regex=False).any():
        raise ValueError("refused")
    return pd.DataFrame({"category": "general", "explanation": "fine"}, index=texts.index)


def silent(texts: pd.Series) -> pd.DataFrame:
    if texts.str.contains("estado profundo", regex=False).any():
        raise ValueError("no answer")
    return pd.DataFrame({"category": "general", "explanation": "seen"}, index=texts.index)
