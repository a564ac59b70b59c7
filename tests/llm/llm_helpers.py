from __future__ import annotations

import random


def prose(rng: random.Random, n: int) -> str:
    parts = ["the", "of", "an", "er", "ti", "st", "on", "re", "nd", "in", "ou", "éa", "ß"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def ascii_words(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode()
    if lower:
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    out, word = [], bytearray()
    for b in data + b" ":
        if b == 32 or 9 <= b <= 13:
            if word:
                out.append(bytes(word))
                word = bytearray()
        else:
            word.append(b)
    return out
