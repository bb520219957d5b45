"""Tokens of a text by a dictionary."""

from __future__ import annotations

from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dictionary_tokenizer(words: Iterable[str]) -> Callable[[Column], Column]:
    """A function that makes an `array<string>` column of a text's tokens: at each place the longest word of the
    dictionary, else one character. The dictionary goes to the workers as a trie; NULL has no tokens."""
    trie: dict = {}
    for word in words:
        node = trie
        for ch in word:
            node = node.setdefault(ch, {})
        if word:
            node[""] = True

    def tokens(text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            node, end, i = trie, at + 1, at
            while i < len(text) and (node := node.get(text[i])):
                i += 1
                if "" in node:
                    end = i
            out.append(text[at:end])
            at = end
        return out

    @F.pandas_udf("array<string>")
    def tokenized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokens(t) if t else [])

    return tokenized
