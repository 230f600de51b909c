"""Benchmark items with one or two words changed, inserted or cut are found at each place; half an item is not."""

import random
from collections import Counter

from cueloom.llm.decontaminate import Index


def test_edited_items_are_found_at_each_place():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))).encode()
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate((16, 39, 24, 12))]
    index = Index(items, len(items), sum(len(w) for _, w in items) / len(items), Counter(t for _, w in items for t in set(w)), 0.6)
    around = [word() for _ in range(200)]

    def found(words):
        at = rng.randrange(len(around))
        return [x[0] for x in index.search(around[:at] + words + around[at:], 0.8)]

    missed = []
    for i, words in items:
        n = len(words)
        for at in range(n):
            for width in (1, 2):
                end = min(n, at + width)
                for kind, edited in (("changed", words[:at] + [word() for _ in range(end - at)] + words[end:]), ("inserted", words[:at] + [word() for _ in range(width)] + words[at:]), ("cut", words[:at] + words[end:])):
                    if n == 12 and width == 2:  # an answer of three words allows one edit
                        continue
                    if found(edited) != [i]:
                        missed.append((i, at, width, kind))
        for gap in (3, 7):
            for at in range(0, n - gap):
                twice = list(words)
                twice[at], twice[at + gap] = word(), word()
                if n > 12 and found(twice) != [i]:
                    missed.append((i, at, gap, "two"))
        assert found(words[: n - n // 4]) == [] == found(words[: n - n // 4] + [word() for _ in range(n // 4)])
        assert found(words[n // 2 :]) == []
    assert not missed
    assert found(items[1][1][:-3]) == [1]
