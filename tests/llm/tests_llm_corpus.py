"""Generated labelled text for the tests of this folder."""

import random


def labelled_corpus(n=400, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        bad = i % 4 == 0
        if bad:
            text = [w + r.choice(["###", "$$$"]) for w in text]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(["zorgblat", "zorgquux", "zorgnit"]))
        out.append((" ".join(text), int(not bad), int(toxic)))
    return out
