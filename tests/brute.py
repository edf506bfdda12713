"""Plain-Python scoring, written from the formulas, to test against."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

from pagelens.functions.text import ENGLISH_STOP_WORDS

STOP = set(ENGLISH_STOP_WORDS)


def terms(text: str) -> list[str]:
    folded = "".join(
        c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)
    )
    words = [w for w in re.findall(r"(?u)\b\w\w+\b", folded) if w not in STOP]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


class Model:
    def __init__(self, categories, max_features=8000):
        self.names = [c["name"] for c in categories]
        docs = [Counter(terms(" ".join(c["keywords"]))) for c in categories]
        totals = sum(docs, Counter())
        vocab = sorted(totals, key=lambda t: (-totals[t], t))[:max_features]
        self.idf = {
            t: math.log((1 + len(docs)) / (1 + sum(t in d for d in docs))) + 1 for t in vocab
        }
        self.profiles = [self.vector(d) for d in docs]
        self.domains = {
            d.lower(): i for i, c in enumerate(categories) for d in c.get("domains", [])
        }

    def vector(self, counts):
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items() if t in self.idf}
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / length for t, w in raw.items()} if length else {}

    def classify(self, text, domain=""):
        if not text.strip():
            return "Uncategorized", 0.0
        page = self.vector(Counter(terms(text)))
        scores = [sum(w * p.get(t, 0.0) for t, w in page.items()) for p in self.profiles]
        if domain in self.domains:
            i = self.domains[domain]
            scores[i] = min(1.0, scores[i] + 0.25)
        best = max(range(len(scores)), key=lambda i: (scores[i], -i))
        name = self.names[best] if scores[best] >= 0.05 else "Uncategorized"
        return name, round(scores[best], 4)
