import math
import random

from sparkloom.llm import splitting


def cost(places, costs, path, begin, limit, overlap):
    stride, length = limit - overlap, places[-1] - begin
    target = (length - overlap) / max(2, math.ceil((length - overlap) / stride))
    total, before = 0.0, begin + overlap
    for j in path:
        total += costs[j] + splitting.BALANCE * ((places[j] - before - target) / stride) ** 2
        before = places[j]
    return total


def cheapest(places, costs, begin, limit, overlap):
    """By trying every way, from the last position back."""
    memo = {}

    def upto(j):
        if j not in memo:
            ways = [[]] if places[j] - begin <= limit else []
            ways += [upto(i) for i in range(j) if places[j] - places[i] <= limit - overlap]
            memo[j] = min(([*way, j] for way in ways), key=lambda path: cost([*places[: j + 1], places[-1]], costs, path, begin, limit, overlap))
        return memo[j]

    return upto(len(places) - 1)


def a_text(rng, length):
    words = ["a", "wide", "river", "of", "glass", "runs.", "Why?", "low\n", "end.\n\n", "stop! ", "x" * 30]
    text = ""
    while len(text) < length:
        text += rng.choice(words) + rng.choice([" ", " ", " ", "\n"])
    return text[:length]


def test_the_path_is_the_cheapest_of_all():
    rng = random.Random(8)
    for dense in (0, 48):
        splitting.DENSE, kept = dense, splitting.DENSE
        try:
            for _ in range(60):
                text, limit = a_text(rng, rng.randint(120, 400)), rng.randint(60, 110)
                overlap = rng.randint(0, limit // 3)
                places, costs = splitting.positions(text, 0, len(text), max(1, (limit - overlap) // splitting.CELLS), "blank-line", [])
                got = cost(places, costs, splitting.cheapest_path(places, costs, 0, limit, overlap), 0, limit, overlap)
                want = cost(places, costs, cheapest(places, costs, 0, limit, overlap), 0, limit, overlap)
                assert abs(got - want) < 1e-9
        finally:
            splitting.DENSE = kept


def test_every_natural_boundary_is_a_position():
    rng = random.Random(9)
    text = a_text(rng, 3000)
    places, costs = splitting.positions(text, 0, len(text), 40, "blank-line", [17])
    at = dict(zip(places, costs))
    for i in range(1, len(text)):
        if text[i - 1] == "\n" or text[i - 2 : i] in (". ", "! ", "? ") and i > 1:
            assert at[i] <= splitting.SENTENCE
    assert at[17] == splitting.STRONG and places == sorted(set(places)) and places[-1] == len(text)
    assert max(b - a for a, b in zip([0, *places], places)) <= 40


def test_short_pieces_between_two_natural_boundaries_are_weighed():
    # two headings close together in text that has no other boundary
    text = "q" * 900 + "\n# one\n" + "r" * 300 + "\n# two\n" + "s" * 900
    starts = splitting.pattern_starts(text, "language-aware", None)
    cuts = splitting.best_cuts(text, 0, len(text), 1000, 0, "language-aware", starts)
    assert set(starts) <= set(cuts)
