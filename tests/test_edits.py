import random

from verselake.operators import edits


def table_counts(ref, hyp):
    """The whole table of costs, walked back with ties to the diagonal, then to a deletion."""
    cost = [[i + j if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    i, j, out = len(ref), len(hyp), [0, 0, 0, 0]
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            out[ref[i - 1] != hyp[j - 1]] += 1
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            out[2] += 1
            i -= 1
        else:
            out[3] += 1
            j -= 1
    return tuple(out), cost[-1][-1]


def test_equal_to_the_table():
    rng = random.Random(1)
    for letters in ("ab", "abcd", "abcdefghijkl"):
        for _ in range(300):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in "ab")
            counts, cost = table_counts(a, b)
            assert edits.edit_counts(a, b) == counts and edits.distance(a, b) == cost
    assert edits.edit_counts(["one", "two"], ["two"]) == (1, 0, 1, 0) and edits.edit_counts("", "") == (0, 0, 0, 0)


def test_long_texts_in_bounded_memory():
    import tracemalloc

    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    b = "".join(c if rng.random() > 0.1 else rng.choice("xyz") for c in a)
    tracemalloc.start()
    hits, subs, dels, ins = edits.edit_counts(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits + subs + dels == len(a) and hits + subs + ins == len(b) and subs + dels + ins == edits.distance(a, b)
    assert most < 16 << 20
