"""Invented prose and test items."""

import random

SYLLABLES = "ba de fi go hu ka le mi no pu ra se ti vo wu".split()


def prose(rng: random.Random, words: int) -> str:
    out = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words)]
    lines = [" ".join(out[k : k + 9]).capitalize() + "." for k in range(0, words, 9)]
    return "\n".join(lines)


def item_rows(rng):
    common = "the of and to in is it".split()
    rows = []
    for k in range(30):
        words = [rng.choice(common) if rng.random() < 0.4 else f"t{rng.randint(0, 300)}" for _ in range(rng.randint(8, 45))]
        rows.append((k, " ".join(words)))
    rows += [(50, "what is the capital of t1 and t2? it is t3 in t4"), (51, None), (52, ""), (53, rows[0][1])]
    return rows
