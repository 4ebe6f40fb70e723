"""Texts for the tests of this folder."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, _c long"


def prose(seed: int, n: int) -> str:
    import random
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "be", "do", "ti", "ou", "re"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))
