import random

import pytest

from vicinage.llm.residual import around_hubs


def family(n, edits, words=100, seed=1):
    """(id, shingles) of n texts, each with ``edits`` words of its own in a common text."""
    pick = random.Random(seed)
    out = []
    for i in range(n):
        text = list(range(words))
        for k in pick.sample(range(words), edits if isinstance(edits, int) else pick.choice(edits)):
            text[k] = 10_000 + pick.randrange(10**6)
        out.append((i, sorted({hash(tuple(text[k : k + 5])) for k in range(words - 4)})))
    return out


def paired(spark, sets, percent=80):
    members = spark.createDataFrame([(0, i, i) for i, _ in sets], "hub long, rep long, root long")
    return {tuple(r) for r in around_hubs(members, spark.createDataFrame(sets, "id long, shingles array<long>"), percent).collect()}


def grown(n, words, edits, seed=1):
    """(id, shingles) of n texts, each an earlier one with some words of its own, so that all distances occur."""
    pick, texts = random.Random(seed), [list(range(words))]
    while len(texts) < n:
        text = list(pick.choice(texts))
        for k in pick.sample(range(words), pick.choice(edits)):
            text[k] = 10_000 + pick.randrange(10**6)
        texts.append(text)
    return [(i, sorted({hash(tuple(t[k : k + 5])) for k in range(words - 4)})) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent, edits", [(80, (0, 1)), (60, (1, 2)), (90, (0, 1))])
def test_no_link_is_lost(spark, percent, edits):
    """Links between members that aren't both linked with the hub are all found, however far they are from it."""
    sets = grown(150, 60, edits)
    found, plain = paired(spark, sets, percent), [set(s) for _, s in sets]
    linked = lambda a, b: 100 * len(plain[a] & plain[b]) >= percent * len(plain[a] | plain[b])
    links = {(a, b) for a in range(150) for b in range(a + 1, 150) if linked(a, b) and not (linked(0, a) and linked(0, b))}
    assert len(links) > 50 and links <= found


def test_families_near_the_threshold_make_few_pairs(spark):
    """Texts of which no two are linked: few of their pairs are compared."""
    counts = [len(paired(spark, family(n, 2))) for n in (200, 400, 800)]
    assert counts[2] < 0.05 * 800 * 799 / 2
