"""Deterministic models for tests: vectors of letters, and a reply that quotes the first piece of evidence."""

import json

from folioscan.plans.asking import Models


def embedder():
    return lambda texts: [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def answerer():
    def answer(prompt):
        asked = json.loads(prompt)
        if "cut" in asked["question"]:
            return '{"kind": "ans', False
        quote = asked["evidence"][0]["text"][:60].rsplit(" ", 1)[0]
        text = f"It is said, after {len(asked['history'])} turns." if "turns" in asked["question"] else "It is said."
        return json.dumps({"kind": "answer", "reply": "", "claims": [{"source": 0, "text": text, "quote": quote}]}), True

    return answer


MODELS = Models("letters", embedder, answer=answerer)
EMBEDDING = Models("letters", embedder)
