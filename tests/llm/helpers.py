"""Documents for the edge cases that every operator must handle."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, h string, component_id string, score string, label int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def documents(spark, texts, ids=None, langs=None, sources=None):
    """A table like ``documents`` with further columns whose names clash with those of results."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [
        (i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or ""), "k", "h", "c", "s", 1)
        for k, (i, t) in enumerate(zip(ids, texts))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class Groups:
    """Union-find over a dict, for brute force."""

    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
